import pytest
from pyspark.sql import functions as F

from histlab.operators import sessions, tabs
from histlab.plans.queries import tab_events
from histlab.schema import read
from histlab.streaming import capture
from histlab.streaming.sessions import stream_sessions, stream_tab_sessions

from .conftest import DATA


@pytest.fixture(scope="module")
def stream_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stream") / "events")
    rows = tab_events(spark, DATA).withColumn("ts", F.col("ts").cast("timestamp"))
    for part in range(2):  # two files in the order of time
        rows.orderBy("ts").where(f"event_id % 1000 {'<' if part == 0 else '>='} 500").coalesce(1).write.mode("append").parquet(path)
    return path


def drained(query):
    query.processAllAvailable()
    query.stop()


def test_sessions(spark, stream_dir):
    schema = spark.read.parquet(stream_dir).schema
    out = stream_sessions(spark.readStream.schema(schema).parquet(stream_dir))
    drained(out.writeStream.format("memory").queryName("sess").outputMode("complete").start())
    want = sessions.sessions_builtin(read(spark, DATA, "events"))
    key = lambda df: sorted((r["user_id"], r["start"], r["page_count"]) for r in df.collect())
    assert key(spark.table("sess")) == key(want)


def test_tab_machine(spark, tmp_path):
    path = str(tmp_path / "e")
    rows = tab_events(spark, DATA).withColumn("ts", F.col("ts").cast("timestamp")).cache()
    middle = rows.agg(F.percentile_approx(F.unix_micros("ts"), 0.5)).first()[0]
    rows.where(F.unix_micros("ts") <= middle).coalesce(1).write.parquet(path)
    stream = stream_tab_sessions(spark.readStream.schema(rows.schema).parquet(path))
    query = stream.writeStream.format("memory").queryName("tabs").outputMode("update").start()
    query.processAllAvailable()
    rows.where(F.unix_micros("ts") > middle).coalesce(1).write.mode("append").parquet(path)
    drained(query)
    got = {}
    for r in spark.table("tabs").collect():
        old = got.get((r["user_id"], r["session_no"]))
        got[r["user_id"], r["session_no"]] = max(filter(None, (old, tuple(r))), key=lambda x: (x[3], x[4], sum(x[10].values())))
    want = {(r["user_id"], r["session_no"]): tuple(r) for r in tabs.tab_sessions(rows).collect()}
    assert got.keys() == want.keys()
    assert sum(got[k][:9] == want[k][:9] for k in want) == len(want)


def test_capture(spark, tmp_path):
    rows = [("https://a.com/", "A", 1, False, "complete"), ("chrome://x", "", 2, False, "complete"), ("https://b.com/", "B", 3, True, "complete"), ("https://c.com/", "C", 4, True, "loading"), (None, "", 5, False, "complete")]
    df = spark.createDataFrame(rows, "url string, title string, s long, incognito boolean, status string").withColumn("ts", F.timestamp_seconds("s"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = capture.write_log(capture.captured(stream), str(tmp_path / "log"), str(tmp_path / "ckpt"), available_now=True)
    query.awaitTermination()
    log = spark.read.parquet(str(tmp_path / "log"))
    assert {r["url"] for r in log.collect()} == {"https://a.com/", "https://b.com/"}
    assert [r["url"] for r in capture.compacted(spark, str(tmp_path / "log"), 1).collect()] == ["https://b.com/"]
    assert capture.requests(df).count() == 3
    drained(capture.counters(stream).writeStream.format("memory").queryName("counts").outputMode("complete").start())
    assert {(r["incognito"], r["count"]) for r in spark.table("counts").collect()} == {(False, 3), (True, 2)}


def test_metadata_join(spark, tmp_path):
    spark.sql("select 1 tab_id, timestamp'2024-01-01 00:00:00' ts, 'u' url").write.parquet(str(tmp_path / "v"))
    spark.sql("select 1 tab_id, timestamp'2024-01-01 00:00:05' ts, 'd' description, 'k' keywords").write.parquet(str(tmp_path / "m"))
    v = spark.readStream.schema("tab_id int, ts timestamp, url string").parquet(str(tmp_path / "v"))
    m = spark.readStream.schema("tab_id int, ts timestamp, description string, keywords string").parquet(str(tmp_path / "m"))
    drained(capture.with_stream_metadata(v, m).writeStream.format("memory").queryName("meta").outputMode("append").start())
    assert [(r["url"], r["description"]) for r in spark.table("meta").collect()] == [("u", "d")]
