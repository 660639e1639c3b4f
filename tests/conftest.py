import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(base / "shared"))
        .config("spark.sql.warehouse.dir", str(base / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def history10(spark):
    """Ten made-up visits; the raw times are 40 000 seconds apart, the last one first."""
    from histlab.functions.times import unix_seconds
    from pyspark.sql import functions as F

    visited = [
        ("https://gitlab.com/tools/loom/-/issues/7", "Loom: broken shuttle", 22, 4, "2025-03-03T08:15:00Z"),
        ("https://duckduckgo.com/?q=rye+bread", "rye bread at DuckDuckGo", 61, 17, "2025-03-03T09:05:00Z"),
        ("https://de.wikipedia.org/wiki/Roggenbrot", "Roggenbrot – Wikipedia", 9, 0, "2025-03-02T19:30:00Z"),
        ("https://reuters.com/markets/", "Markets", 34, 6, "2025-03-04T07:45:00Z"),
        ("https://open.spotify.com/album/42", "Evening jazz", 47, 0, "2025-03-01T21:10:00Z"),
        ("https://etsy.com/listing/88", "Linen apron", 15, 3, "2025-03-02T10:00:00Z"),
        ("https://proton.me/inbox", "Inbox", 83, 31, "2025-03-04T07:10:00Z"),
        ("https://pypi.org/project/numpy/", "numpy · PyPI", 12, 2, "2025-02-28T13:00:00Z"),
        ("https://podcasts.spotify.com/show/5", "Kiln talk", 27, 0, "2025-03-03T12:40:00Z"),
        ("https://recipes.example.org/bread?part=2", "Bread, step 2", 6, 1, "2025-02-27T18:20:00Z"),
    ]
    rows = [(i, *v, 13_390_000_000_000_000 - i * 40_000_000_000) for i, v in enumerate(visited)]
    df = spark.createDataFrame(rows, "pos long, url string, title string, visit_count long, typed_count long, last_visit_time string, last_visit_raw long")
    return df.withColumn("last_visit", F.timestamp_seconds(unix_seconds(F.col("last_visit_raw"), "chromium"))).cache()
