"""Named queries over the synthetic tables, one per operator."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times, urls, web
from ..functions.text import contains_nocase, glob_match, valid_utf8
from ..operators import domains, rules, search, sessions, sets, stats, tabs
from ..operators.ranges import numbered
from ..schema import EVENT_KINDS, history, read, shared_folder, visits
from ..streaming import capture

Query = Callable[[SparkSession, str], DataFrame]

NOW = datetime(2024, 1, 31)

#: The rules file of the rule queries: the test pages lie on hosts that no built-in rule knows.
RULES = """
[Social Media]
domains = example.net
keywords = like
[Docs]
domains = *.example.com
color = #123456
paths[example.org] = /*/[a-m]*
[Shops]
domains = shop.*
keywords = the, of
"""


def _h(spark: SparkSession, d: str) -> DataFrame:
    return history(spark, d)


def categories() -> list[rules.Category]:
    return rules.load_rules(RULES)


# Projections of the history.


def history_view(spark: SparkSession, d: str) -> DataFrame:
    return history(spark, d, weighted=False)


def url_parts(spark: SparkSession, d: str) -> DataFrame:
    parts = urls.with_url_parts(read(spark, d, "pages").select("page_id", "url"))
    return parts.select("page_id", *urls.PARTS)


def registrable_domain(spark: SparkSession, d: str) -> DataFrame:
    parts = urls.with_url_parts(read(spark, d, "pages").select("page_id", "url"))
    return parts.select("page_id", "full_host", "registrable_domain", "tld", "subdomain")


def hosts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return read(spark, d, "pages").select("page_id", urls.authority_text(u).alias("authority"), urls.search_host(u).alias("search_host"), urls.rules_host(u).alias("rules_host"), urls.rules_path(u).alias("rules_path"))


def host_kind(spark: SparkSession, d: str) -> DataFrame:
    """The pages' hosts and some made of their numbers."""
    made = F.when(F.col("page_id") % 3 == 0, F.concat_ws(".", *(((F.col("page_id") * k) % 300).cast("string") for k in (1, 7, 11, 13))))
    made = made.when(F.col("page_id") % 3 == 1, F.concat(F.lit("[::"), F.hex("page_id"), F.lit("]"))).otherwise(urls.rules_host(F.col("url")))
    out = read(spark, d, "pages").select("page_id", made.alias("host"))
    return out.select("page_id", "host", urls.is_ipv4(F.col("host")).alias("is_ipv4"), urls.is_ipv6(F.col("host")).alias("is_ipv6"))


def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    """The pages' URLs with needless parts put in, normalised."""
    messy = F.regexp_replace("url", r"^(https?)://([^/]*)/", "$1://$2:443/a/.././/")
    out = urls.normalize(read(spark, d, "pages").select("page_id", F.upper(F.substring("url", 1, 4)).alias("head"), messy.alias("messy")).select("page_id", F.concat("head", F.expr("substring(messy, 5)")).alias("url")))
    return out.select("page_id", "normalized")


def url_round_trip(spark: SparkSession, d: str) -> DataFrame:
    out = read(spark, d, "pages").withColumn("p", urls.parsed(F.col("url")))
    return out.select("page_id", urls.reconstruct(F.col("p")).alias("url"))


def query_params(spark: SparkSession, d: str) -> DataFrame:
    out = read(spark, d, "pages").select("page_id", F.posexplode(urls.query_params(urls.parsed(F.col("url"))["query"])).alias("pos", "p"))
    return out.select("page_id", F.col("pos").cast("long").alias("pos"), "p.key", "p.value")


def percent_codes(spark: SparkSession, d: str) -> DataFrame:
    """Titles encoded in full and decoded again."""
    out = _h(spark, d).select("pos", "title").withColumn("coded", urls.percent_encode(F.col("title")))
    return out.select("pos", F.length("coded").cast("long").alias("coded_length"), urls.percent_decode(F.col("coded"), plus_as_space=False).alias("decoded"))


def utf8_valid(spark: SparkSession, d: str) -> DataFrame:
    """Titles, and titles with a byte that is not UTF-8 behind."""
    raw = F.col("title").cast("binary")
    return _h(spark, d).select("pos", valid_utf8(F.col("title")).alias("valid"), valid_utf8(F.concat(raw, F.unhex(F.lit("C3"))).cast("string")).alias("valid_cut"))


def epoch_normalize(spark: SparkSession, d: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    kinds = {0: "chromium", 1: "firefox", 2: "unix_ms", 3: "unix"}
    raw, kind = F.lit(None).cast("long"), F.lit(None).cast("string")
    for k, name in kinds.items():
        value = {"chromium": us + times.CHROMIUM_SHIFT * 1_000_000, "firefox": us, "unix_ms": F.expr("unix_micros(cast(ts as timestamp)) div 1000"), "unix": F.expr("unix_micros(cast(ts as timestamp)) div 1000000")}[name]
        chosen = F.col("event_id") % 4 == k
        raw, kind = F.when(chosen, value).otherwise(raw), F.when(chosen, name).otherwise(kind)
    out = read(spark, d, "events").select("event_id", raw.alias("raw"), kind.alias("ts_format"))
    return out.select("event_id", "raw", "ts_format", times.unix_seconds(F.col("raw"), F.col("ts_format")).alias("unix_seconds"))


def iso_time(spark: SparkSession, d: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    raw = F.when(F.col("event_id") % 10 == 0, F.lit(0)).otherwise(us + times.CHROMIUM_SHIFT * 1_000_000)
    return read(spark, d, "events").select("event_id", times.chromium_iso(raw).alias("iso"))


def display_text(spark: SparkSession, d: str) -> DataFrame:
    h = _h(spark, d)
    title = F.when(F.coalesce("title", F.lit("")) == "", "(untitled)").otherwise(F.col("title"))
    return h.select("pos", web.shortened(F.col("url"), 30).alias("short_url"), web.html_escape(title).alias("escaped"), F.concat(F.lit("["), F.col("typed_count").cast("string"), F.lit("] "), title).alias("decorated"))


def relative_times(spark: SparkSession, d: str) -> DataFrame:
    ages = read(spark, d, "events").select("event_id", (F.lit(NOW).cast("timestamp") - F.expr("make_dt_interval(0, 0, cast(event_id * 7 as int), 0)")).alias("seen"))
    return ages.select("event_id", web.relative_time(F.col("seen"), F.lit(NOW)).alias("shown"))


def page_metadata(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", web.page_metadata(F.col("html")).alias("m")).select("page_id", "m.*")


# Statistics.


def history_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.history_stats(_h(spark, d))


def unique_authorities(spark: SparkSession, d: str) -> DataFrame:
    return _h(spark, d).agg(F.countDistinct(urls.authority_text(F.col("url"))).alias("unique_authorities"))


def unique_hosts(spark: SparkSession, d: str) -> DataFrame:
    return stats.unique_hosts(_h(spark, d))


def hourly_visits(spark: SparkSession, d: str) -> DataFrame:
    return stats.hourly_visits(_h(spark, d))


def weekday_visits(spark: SparkSession, d: str) -> DataFrame:
    return stats.weekday_visits(_h(spark, d))


def peak_hours(spark: SparkSession, d: str) -> DataFrame:
    return stats.peaks(_h(spark, d))


def browsing_analysis(spark: SparkSession, d: str) -> DataFrame:
    h = _h(spark, d)
    return stats.analysis(rules.classify_substrings(h), h)


def bar_scaling(spark: SparkSession, d: str) -> DataFrame:
    """Visits by hour with the bar that each gets, in percent of the longest."""
    return stats.bars(stats.hourly_visits(_h(spark, d)))


def capture_counters(spark: SparkSession, d: str) -> DataFrame:
    """Visits in all, private and normal; errors of the synthetic stream stand for private ones."""
    return capture.totals(visits(spark, d).withColumn("incognito", F.col("event_type") == "error"))


# Sets, filters, limits.


def dedup_merge(spark: SparkSession, d: str) -> DataFrame:
    """The history, and half of it again with other counts, merged by URL."""
    h = _h(spark, d)
    again = h.where("pos % 2 = 0").select(
        (F.col("pos") + 1_000_000).alias("pos"), "url", F.concat(F.lit("again "), "title").alias("title"), ((F.col("visit_count") * 7) % 100).alias("visit_count"), F.lit(0).cast("long").alias("typed_count"), "last_visit"
    )
    return sets.merge_by_url(sets.bag_union(h, again))


def bag_union(spark: SparkSession, d: str) -> DataFrame:
    h = _h(spark, d)
    return sets.bag_union(h, h.where("visit_count > 60"), h.where("pos < 10"))


def days_back_gt(spark: SparkSession, d: str) -> DataFrame:
    return sets.since(visits(spark, d).select("event_id", "ts", "url"), NOW, 7, inclusive=False, column="ts")


def days_back_ge(spark: SparkSession, d: str) -> DataFrame:
    return sets.since(visits(spark, d).select("event_id", "ts", "url"), NOW, 7, inclusive=True, column="ts")


def consecutive_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user whose kind differs from the event before."""
    return sets.drop_consecutive(read(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")


def last_n(spark: SparkSession, d: str) -> DataFrame:
    """The 1000 latest visits, a retention limit."""
    return sets.last_n(visits(spark, d).select("event_id", "ts", "url"), 1000, "ts", "event_id")


def last_n_per_user(spark: SparkSession, d: str) -> DataFrame:
    kept = sets.keep_latest(read(spark, d, "events").select("user_id", "event_id", "ts"), 5, ["user_id"], [F.desc("ts"), F.asc("event_id")])
    return kept


def scan_order(spark: SparkSession, d: str) -> DataFrame:
    """Rows with their rank in scan order: newest first, then by page."""
    return numbered(_h(spark, d).select("pos", "last_visit"), [F.desc("last_visit"), F.asc("pos")]).select("pos", "rank")


def capture_filter(spark: SparkSession, d: str) -> DataFrame:
    """URLs that are captured: some, none of the browser's own."""
    u = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("chrome://page/"), F.col("page_id").cast("string"))).when(F.col("page_id") % 7 == 0, F.lit("about:blank")).otherwise(F.col("url"))
    p = read(spark, d, "pages").select("page_id", u.alias("url"), F.lit("complete").alias("status"))
    return capture.captured(p).select("page_id", "url")


def http_only(spark: SparkSession, d: str) -> DataFrame:
    return capture.requests(read(spark, d, "pages")).select("page_id", "url")


def csv_row_filter(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.csv_files import is_address

    u = F.when(F.col("page_id") % 4 == 0, F.expr("substring(url, 9)")).when(F.col("page_id") % 9 == 0, F.lit("about:home")).otherwise(F.col("url"))
    return read(spark, d, "pages").select("page_id", u.alias("url")).where(is_address(F.col("url")))


def history_query(spark: SparkSession, d: str) -> DataFrame:
    """Normal visits of the last 10 days, the 500 newest."""
    v = visits(spark, d).where(F.col("event_type") != "error").select("event_id", "ts", "url", "title")
    return sets.last_n(sets.since(v, NOW, 10, inclusive=True, column="ts"), 500, "ts", "event_id")


def popup_search(spark: SparkSession, d: str) -> DataFrame:
    h = _h(spark, d)
    return h.where(contains_nocase(F.col("title"), "TH") | contains_nocase(F.col("url"), "docs")).select("pos", "url", "title")


def metadata_asof(spark: SparkSession, d: str) -> DataFrame:
    """Clicks enriched by the metadata that views of the same user give within an hour after."""
    e = read(spark, d, "events").withColumn("tab_id", F.col("user_id"))
    v = e.where(F.col("event_type") == "click").select("event_id", "tab_id", "ts")
    m = e.where(F.col("event_type") == "view").select("tab_id", "ts", F.concat(F.lit("d"), F.col("event_id").cast("string")).alias("description"), F.lit("").alias("keywords"))
    return sets.with_metadata(v, m, "1 hour").select("event_id", "tab_id", "ts", "description")


# Categories.


def categorize(spark: SparkSession, d: str) -> DataFrame:
    return rules.categorize(_h(spark, d), categories()).select("pos", "category_idx", "category", "confidence")


def categorize_builtin(spark: SparkSession, d: str) -> DataFrame:
    return rules.categorize(_h(spark, d)).select("pos", "category_idx", "category", "confidence")


def category_stats(spark: SparkSession, d: str) -> DataFrame:
    own = categories()
    return rules.category_stats(rules.categorize(_h(spark, d), own), own)


def substring_categories(spark: SparkSession, d: str) -> DataFrame:
    return rules.classify_substrings(_h(spark, d)).select("pos", "category", "category_idx")


def substring_category_stats(spark: SparkSession, d: str) -> DataFrame:
    return rules.substring_stats(rules.classify_substrings(_h(spark, d)))


def glob_paths(spark: SparkSession, d: str) -> DataFrame:
    p = urls.rules_path(F.col("url"))
    return read(spark, d, "pages").select("page_id", p.alias("path"), glob_match(p, "/*[0-9]*").alias("digits"), glob_match(p, "/?[!a-m]*").alias("second"), glob_match(p, "/[a-m]*/*").alias("deep"))


def domain_patterns(spark: SparkSession, d: str) -> DataFrame:
    host = urls.rules_host(F.col("url"))
    tests = {"exact": "example.com", "below": "*.example.net", "prefix": "www.*"}
    return read(spark, d, "pages").select("page_id", *(rules.domain_match(p, host).alias(n) for n, p in tests.items()))


def rules_table(spark: SparkSession, d: str) -> DataFrame:
    return rules.rules_table(spark).groupBy("cat_idx", "cat_name", "type").agg(F.count("*").alias("n"))


# Domains.


def domain_topk(spark: SparkSession, d: str) -> DataFrame:
    return domains.top_domains(_h(spark, d)).select("domain", "url_count", "visit_count")


def host_topk(spark: SparkSession, d: str) -> DataFrame:
    counts = domains.domain_counts(domains.registrable(_h(spark, d)), F.col("full_host"))
    return counts.orderBy(F.desc("visit_count"), "first_pos").limit(32)


def domain_rollup(spark: SparkSession, d: str) -> DataFrame:
    return domains.rollup(_h(spark, d))


def domain_lookup(spark: SparkSession, d: str) -> DataFrame:
    h = _h(spark, d)
    return sets.bag_union(*(domains.lookup(h, x) for x in ("therha.example.com", "therin.example.net", "nowhere.test")))


def domain_aggregate(spark: SparkSession, d: str) -> DataFrame:
    h = _h(spark, d)
    return sets.bag_union(*(domains.aggregate(h, x).select("domain", "url_count", "visit_count") for x in ("com", "example.org", "nowhere.test")))


def unique_domains(spark: SparkSession, d: str) -> DataFrame:
    return domains.unique_domains(_h(spark, d))


# Search.

SEARCHES = {
    "search_substring": "th",
    "search_boolean": "th AND docs OR net -on",
    "search_domain": "domain:example.com",
    "search_tld": "tld:org NOT of",
    "search_regex": 'regex:"^https?://[a-z]+[[:alnum:].]*\\.(com|net)/"',
    "search_dates": "e after:2024-01-29 before:2024-01-30T12 visits:40",
    "search_quoted": '"of the" OR "in th"',
}


def _search(text: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = search.search(_h(spark, d), text, NOW, None)
        return found.select("pos", "url_hit", "title_hit", "match_count", "score")

    return run


def search_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The first 100 matches in scan order, ranked."""
    found = search.search(_h(spark, d), "th OR docs", NOW, 100)
    return numbered(found.select("pos", "score"), [F.desc("score"), F.asc("pos")])


# Sessions.


def _sessions(gap: int) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return sessions.sessions(read(spark, d, "events").select("user_id", "ts", "event_id"), gap=gap)

    return run


def history_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of one person's history: all rows are one sequence."""
    return sessions.sessions(_h(spark, d), key=None, ts="last_visit", tie="pos")


def session_stats(spark: SparkSession, d: str) -> DataFrame:
    found = sessions.sessions(read(spark, d, "events").select("user_id", "ts", "event_id"), gap=12 * 3600)
    return sessions.session_stats(found, ["user_id", "session_no"])


def session_window_builtin(spark: SparkSession, d: str) -> DataFrame:
    return sessions.sessions_builtin(read(spark, d, "events"))


def tab_events(spark: SparkSession, d: str) -> DataFrame:
    """The synthetic stream as tab events."""
    kind = F.lit(None).cast("string")
    for event, name in EVENT_KINDS.items():
        kind = F.when(F.col("event_type") == event, name).otherwise(kind)
    return visits(spark, d).select("user_id", "event_id", kind.alias("type"), (F.col("event_id") % 5 + 1).cast("int").alias("tab_id"), "url", "title", "ts")


def tab_state_machine(spark: SparkSession, d: str) -> DataFrame:
    out = tabs.tab_sessions(tab_events(spark, d))
    return out.withColumn("transitions", F.to_json("transitions"))


# Files and streams.


def csv_import(spark: SparkSession, d: str) -> DataFrame:
    """The history exported as CSV files and imported again."""
    from ..sinks.exports import write_csv_parts
    from ..sources.csv_files import read_csv

    path = shared_folder(spark, "csv")
    write_csv_parts(_h(spark, d), path)
    return read_csv(spark, path).select("url", "title", "visit_count", "typed_count", "last_visit_time", "last_visit")


def chromium_import(spark: SparkSession, d: str) -> DataFrame:
    """The history as Chromium databases, scanned for the last 7 days; the filter runs in the databases."""
    from ..sinks.databases import write_databases
    from ..sources.sqlite_source import read_chromium

    raw = F.unix_micros(F.col("last_visit").cast("timestamp")) + times.CHROMIUM_SHIFT * 1_000_000
    paths = write_databases(_h(spark, d).withColumn("last_visit_time", raw).repartition(3), shared_folder(spark, "chromium"), "chromium")
    cutoff = int((NOW - datetime(1970, 1, 1)).total_seconds()) - 7 * 86400 + times.CHROMIUM_SHIFT
    return read_chromium(spark, paths, cutoff * 1_000_000).select("url", "title", "visit_count", "typed_count", "last_visit_time")


def firefox_import(spark: SparkSession, d: str) -> DataFrame:
    """The visits as Firefox databases; places with their last visit among those of the last 10 days."""
    from ..sinks.databases import write_databases
    from ..sources.sqlite_source import read_firefox

    h = _h(spark, d).select(F.col("pos").alias("page_id"), "visit_count", F.col("typed_count").alias("typed"))
    rows = visits(spark, d).join(h, "page_id").withColumnRenamed("page_id", "place_id").withColumn("visit_date", F.unix_micros(F.col("ts").cast("timestamp")))
    paths = write_databases(rows.repartition(3, "place_id"), shared_folder(spark, "firefox"), "firefox")
    cutoff = int((NOW - datetime(1970, 1, 1)).total_seconds()) - 10 * 86400
    return read_firefox(spark, paths, cutoff * 1_000_000).select("url", "title", "visit_count", "typed_count", "last_visit_time")


def json_export(spark: SparkSession, d: str) -> DataFrame:
    """The history exported as one JSON file with its statistics, and imported again."""
    from pathlib import Path

    from ..sinks.exports import write_json
    from ..sources.extension_json import read_json

    folder = Path(shared_folder(spark, "export").removeprefix("file:"))
    folder.mkdir(parents=True)
    write_json(_h(spark, d), folder / "history.json", NOW)
    return read_json(spark, str(folder / "history.json")).select("url", "title", "visit_count", "typed_count", "last_visit_time")


def bookmark_import(spark: SparkSession, d: str) -> DataFrame:
    """The history written as bookmark files and imported again."""
    from ..sources.bookmarks import read_bookmarks

    path = shared_folder(spark, "bookmarks")
    seconds = F.unix_timestamp(F.col("last_visit").cast("timestamp")).cast("string")
    link = F.concat(F.lit('<DT><A HREF="'), web.html_escape(F.col("url")), F.lit('" ADD_DATE="'), seconds, F.lit('">'), web.html_escape(F.col("title")), F.lit("</A>"))
    _h(spark, d).select(link.alias("value")).write.text(path)
    return read_bookmarks(spark, path).select("url", "title", "visit_count", "last_visit_time")


def json_import(spark: SparkSession, d: str) -> DataFrame:
    """The history written as one JSON export per page, and imported again."""
    from ..functions.times import iso_of_timestamp
    from ..sources.extension_json import read_json

    path = shared_folder(spark, "json")
    row = F.struct("url", "title", "visit_count", "typed_count", iso_of_timestamp(F.col("last_visit")).alias("last_visit_time"))
    _h(spark, d).select(F.to_json(F.struct(F.lit(True).alias("success"), F.array(row).alias("data"))).alias("value")).write.text(path)
    return read_json(spark, path, lines=True).select("url", "title", "visit_count", "typed_count", "last_visit_time")


def stream_capture(spark: SparkSession, d: str) -> DataFrame:
    """The synthetic stream through the capture filter into a log, as a stream; then the log."""
    from ..streaming.capture import captured, write_log

    path, checkpoint = shared_folder(spark, "log"), shared_folder(spark, "log-checkpoint")
    schema = read(spark, d, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")  # a pattern may name a single file
    kind = F.when(F.col("event_type") == "view", "chrome://newtab").otherwise(F.concat(F.lit("https://a.com/"), "event_type"))
    shaped = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("url"), (F.col("user_id") % 2 == 0).alias("incognito"), F.when(F.col("event_type") == "error", "loading").otherwise("complete").alias("status"))
    write_log(captured(shaped), path, checkpoint, available_now=True).awaitTermination()
    return spark.read.parquet(path).select("event_id", "url", "incognito")


def stream_tab_machine(spark: SparkSession, d: str) -> DataFrame:
    """The state machine as a stream over the tab events; each session as its last update leaves it."""
    from ..streaming.sessions import stream_tab_sessions

    source, path, checkpoint = (shared_folder(spark, x) for x in ("tab-events", "tab-sessions", "tab-checkpoint"))
    tab_events(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(source)
    events = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    stream = stream_tab_sessions(events).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint)
    stream.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(path)
    last = rows.groupBy("user_id", "session_no").agg(F.max_by(F.struct("start_us", "end_us", "page_count", "state"), F.struct("batch", "end_us", "page_count")).alias("s"))
    return last.select("user_id", "session_no", "s.*")


def queries() -> dict[str, Query]:
    own = [
        history_view, url_parts, registrable_domain, hosts, host_kind, url_normalize, url_round_trip, query_params, percent_codes, utf8_valid,
        epoch_normalize, iso_time, display_text, relative_times, page_metadata, history_stats, unique_authorities, unique_hosts, hourly_visits,
        weekday_visits, peak_hours, browsing_analysis, bar_scaling, capture_counters, dedup_merge, bag_union, days_back_gt, days_back_ge,
        consecutive_dedup, last_n, last_n_per_user, scan_order, capture_filter, http_only, csv_row_filter, history_query, popup_search, metadata_asof,
        categorize, categorize_builtin, category_stats, substring_categories, substring_category_stats, glob_paths, domain_patterns, rules_table,
        domain_topk, host_topk, domain_rollup, domain_lookup, domain_aggregate, unique_domains, search_ranked, history_sessions, session_stats,
        session_window_builtin, tab_state_machine, csv_import, chromium_import, firefox_import, json_export, bookmark_import, json_import, stream_capture, stream_tab_machine,
    ]
    out: dict[str, Query] = {f.__name__: f for f in own}
    out |= {name: _search(text) for name, text in SEARCHES.items()}
    out |= {"sessions_30m": _sessions(1800), "sessions_12h": _sessions(12 * 3600)}
    return out
