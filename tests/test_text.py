import random
import re

from histlab.functions.text import decode_entities, glob_regex, posix_regex


def test_entities():
    assert decode_entities("Test &amp; Demo &lt;Page&gt;") == "Test & Demo <Page>"
    assert decode_entities("a&hellip;b &#8230; &#x2014;") == "a...b … —"
    assert decode_entities("&copy; &unknown; & &amp") == "(c) &unknown; & &amp"
    assert decode_entities("&#0; &#xD800; &#1114112;") == "&#0; &#xD800; &#1114112;"
    assert decode_entities("&&amp;") == "&&"
    assert decode_entities("&amp;amp;") == "&amp;"
    assert decode_entities(None) is None


def direct(pattern: str, text: str) -> bool:
    if not pattern:
        return not text
    if pattern[0] == "*":
        return any(direct(pattern[1:], text[i:]) for i in range(len(text) + 1))
    if not text:
        return False
    if pattern[0] == "?":
        return direct(pattern[1:], text[1:])
    return pattern[0].lower() == text[0].lower() and direct(pattern[1:], text[1:])


def test_globs():
    rng = random.Random(1)
    for _ in range(2000):
        pattern = "".join(rng.choice("ab*?/.") for _ in range(rng.randint(0, 6)))
        text = "".join(rng.choice("abAB/.") for _ in range(rng.randint(0, 8)))
        assert bool(re.match(glob_regex(pattern).replace(r"\z", r"\Z"), text)) == direct(pattern, text), (pattern, text)
    def fits(pattern, text):
        return bool(re.match(glob_regex(pattern).replace(r"\z", r"\Z"), text))

    assert fits("/[a-c]x", "/bX") and not fits("/[a-c]x", "/Bx") and fits("[!a]", "b") and not fits("[!a]", "a") and fits("[]", "") is False


def test_posix():
    assert posix_regex("[[:digit:]]+") == r"(?i)[\p{Digit}]+"
    assert posix_regex("(") is None and posix_regex("[a") is None and posix_regex("[[:nope:]]") is None
    assert posix_regex(r"[\w]") == r"(?i)[\x5cw]"


def test_ranges_are_one_order(spark):
    """Ranks and sessions over many ranges are those of one window over all rows."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from histlab.operators.ranges import in_ranges, numbered
    from histlab.operators.sessions import with_session

    rows = [(i, (i * 7919) % 3000 * 700 + (i % 5), None if i % 97 == 0 else i) for i in range(3000)]
    df = spark.createDataFrame(rows, "pos long, s long, x long").withColumn("ts", F.when(F.col("x").isNotNull(), F.timestamp_seconds("s"))).repartition(7)
    order = [F.asc("ts"), F.asc("pos")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert in_ranges(df, order).select("_range").distinct().count() > 1
        every = Window.orderBy(*order)
        assert not numbered(df, order).withColumn("want", F.row_number().over(every)).where("rank <> want").count()
        apart = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(every))
        want = df.withColumn("b", F.when(apart.isNull() | (apart > 1_800_000_000), 1).otherwise(0)).withColumn("want", F.sum("b").over(every))
        both = with_session(df, None, "ts", "pos").select("pos", "session_no").join(want.select("pos", "want"), "pos")
        assert both.count() == 3000 and not both.where("session_no <> want").count()
        assert numbered(df.limit(0), order).count() == 0 and with_session(df.limit(0), None, "ts", "pos").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
