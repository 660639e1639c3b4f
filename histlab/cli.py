"""The command line: sources, search, analyses and exports over one history."""

from __future__ import annotations

import argparse
import logging
from datetime import UTC, datetime, timedelta
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .functions.times import CHROMIUM_SHIFT
from .operators import domains, rules, search, sessions, stats
from .schema import conform
from .sinks import exports, pdf
from .sources import config as config_files
from .sources import discover
from .sources.importer import auto_import
from .sources.sqlite_source import read_chromium

log = logging.getLogger("histlab")
MAX_IMPORTS = 16


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("histlab", description="Analyses of browsing history.")
    p.add_argument("--browser")
    p.add_argument("--all-browsers", action="store_true")
    p.add_argument("--db")
    p.add_argument("--no-db", action="store_true")
    p.add_argument("--import", dest="imports", action="append", default=[])
    p.add_argument("--days", type=int)
    p.add_argument("--search")
    p.add_argument("--categorize", action="store_true")
    p.add_argument("--rules")
    p.add_argument("--sessions", action="store_true")
    p.add_argument("--domains", action="store_true")
    for form in ("json", "pdf", "csv", "html", "markdown"):
        p.add_argument(f"--{form}")
    p.add_argument("--config")
    p.add_argument("--home")
    p.add_argument("--log")
    p.add_argument("--verbose", "-v", action="store_true")
    p.add_argument("--quiet", "-q", action="store_true")
    p.add_argument("--version", "-V", action="version", version=__version__)
    return p


def load(spark: SparkSession, args: argparse.Namespace, now: datetime) -> DataFrame:
    """The history of the sources asked for: all browsers, one browser, a database, else the default; then imports."""
    cutoffs: dict[str, int] = {}
    if args.days and args.days > 0:
        us = int((now - timedelta(days=args.days)).timestamp() * 1_000_000)
        cutoffs = {"firefox": us, "chromium": us + CHROMIUM_SHIFT * 1_000_000}
    parts: list[DataFrame] = []
    if not args.no_db:
        if args.all_browsers:
            parts.append(discover.read_all_browsers(spark, args.home, cutoffs))
        elif args.browser:
            kind = discover.browser_type(args.browser)
            parts.append(discover.read_profiles(spark, [p for p in discover.scan(args.home) if p.browser == kind], cutoffs))
        elif args.db:
            parts.append(read_chromium(spark, [args.db], cutoffs.get("chromium")))
        else:
            parts.append(discover.read_profiles(spark, [p for p in discover.scan(args.home) if p.browser == "brave"][:1], cutoffs))
    parts += [auto_import(spark, path) for path in args.imports[:MAX_IMPORTS]]
    if not parts:
        return conform(spark.createDataFrame([], "url string"))
    # Sources number their rows on their own; a source's number puts them one behind the other.
    numbered = [conform(p).withColumn("pos", F.col("pos") + F.lit(i << 40)) for i, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, numbered)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, now: datetime | None = None) -> int:
    args = parser().parse_args(argv)
    now = now or datetime.now(UTC)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.WARNING if args.quiet else logging.INFO, filename=args.log)
    if args.config:
        conf = config_files.load(args.config)
        args.days = conf.get("general", "default_days") if args.days is None else args.days
        args.rules = args.rules or conf.get_string("categories", "config_file") or None
    spark = spark or SparkSession.builder.appName("histlab").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    history = load(spark, args, now).cache()
    if history.isEmpty():
        print("No history found.")
        return 0
    own = rules.load_rules(Path(args.rules).expanduser().read_text("utf-8")) if args.rules else rules.built_in()
    categories = rules.category_stats(rules.categorize(history, own), own) if args.categorize or args.rules or args.html or args.markdown else None
    say = (lambda *_: None) if args.quiet else print
    if (args.categorize or args.rules) and categories is not None:
        say("Categories\n" + exports.table_text(categories.where("url_count > 0"), 50))
    if args.search:
        found = search.search(history, args.search, now)
        print("Search\n" + exports.table_text(found.select("score", "title", "url", "visit_count"), 20))
    if args.sessions:
        seen = history.where(F.col("last_visit").isNotNull())
        found = sessions.sessions(seen, None, "last_visit", "pos")
        say("Sessions\n" + exports.table_text(found.orderBy(F.desc("session_no")), 5))
    if args.domains:
        say("Domains\n" + exports.table_text(domains.top_domains(history).drop("first_pos"), 15))
    analysis = stats.analysis(rules.classify_substrings(history), history)
    if not args.search:
        say(exports.summary(history))
        say(exports.table_text(analysis.select("insight_primary", "insight_focus", "insight_habit", "insight_recommendation"), 1))
    if args.json:
        exports.write_json(history, args.json, now)
    if args.pdf:
        pdf.write_pdf(history, args.pdf, analysis, stats.hourly_visits(history), rules.substring_stats(rules.classify_substrings(history)), now)
    if args.csv:
        exports.write_csv(history, args.csv)
    if args.html:
        exports.write_html(history, args.html, categories, now)
    if args.markdown:
        exports.write_markdown(history, args.markdown, categories, now)
    history.unpersist()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
