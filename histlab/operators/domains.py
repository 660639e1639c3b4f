"""Domain roll-ups: exact counts, sums over subdomains, top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower
from ..functions.urls import domain_info, parsed


def labels(domain: Column) -> Column:
    """Labels of a domain in lower case, empty ones dropped."""
    return F.filter(F.split(ascii_lower(domain), r"\."), lambda x: x != "")


def suffixes(domain: Column) -> Column:
    """The domain and every domain above it."""
    parts = labels(domain)
    n = F.size(parts)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, n - i + 1, i), ".")))


def domain_counts(history: DataFrame, domain: Column) -> DataFrame:
    """domain, url_count, visit_count, first_pos for each exact domain."""
    return history.where(F.coalesce(domain, F.lit("")) != "").groupBy(domain.alias("domain")).agg(
        F.count("*").alias("url_count"), F.sum("visit_count").alias("visit_count"), F.min("pos").alias("first_pos")
    )


def with_host(history: DataFrame) -> DataFrame:
    """``history`` with the parsed host in lower case. A step of its own, so that what builds on it names a column."""
    return history.withColumn("_p", parsed(F.col("url"))).withColumn("host", ascii_lower(F.col("_p.host"))).drop("_p")


def registrable(history: DataFrame) -> DataFrame:
    """``history`` with its registrable domain and full host."""
    df = with_host(history).withColumn("_i", domain_info(F.col("host")))
    return df.withColumns({"registrable_domain": F.col("_i.registrable_domain"), "full_host": F.col("_i.full_host")}).drop("_i", "host")


def top_domains(history: DataFrame, k: int = 15, legacy: bool = False) -> DataFrame:
    """The k registrable domains with most visits, the first met first among equals.

    ``legacy`` ranks by the number of URLs instead, and takes equals in the order of a tree
    of reversed labels: by when the last label was first met, then the domain.
    """
    counts = domain_counts(registrable(history), F.col("registrable_domain"))
    if not legacy:
        return counts.orderBy(F.desc("visit_count"), "first_pos").limit(k)
    counts = counts.withColumn("_last", F.element_at(labels(F.col("domain")), -1))
    met = counts.groupBy("_last").agg(F.min("first_pos").alias("_met"))
    return counts.join(met, "_last").orderBy(F.desc("url_count"), "_met", "first_pos").limit(k).drop("_last", "_met")


def rollup(history: DataFrame, host: Column | None = None) -> DataFrame:
    """suffix, url_count, visit_count over each domain and everything below it.

    Counts are summed per exact domain before the suffixes are exploded, so what is shuffled
    grows with distinct domains, not with rows.
    """
    exact = domain_counts(with_host(history), F.col("host")) if host is None else domain_counts(history, host)
    below = exact.select(F.explode(suffixes(F.col("domain"))).alias("suffix"), "url_count", "visit_count")
    return below.groupBy("suffix").agg(F.sum("url_count").alias("url_count"), F.sum("visit_count").alias("visit_count"))


def lookup(history: DataFrame, domain: str) -> DataFrame:
    """url_count and visit_count of exactly this domain; no row where it does not occur."""
    host = F.col("host")
    return domain_counts(with_host(history).where(host == domain.lower()), host).select("domain", "url_count", "visit_count")


def aggregate(history: DataFrame, domain: str) -> DataFrame:
    """url_count and visit_count of a domain with all its subdomains; -1 where there is none."""
    host = F.col("host")
    own = with_host(history).where((host == domain.lower()) | host.endswith("." + domain.lower()))
    return own.agg(
        F.when(F.count("*") > 0, F.count("*")).otherwise(-1).alias("url_count"), F.coalesce(F.sum("visit_count"), F.lit(-1)).cast("long").alias("visit_count")
    ).withColumn("domain", F.lit(domain))


def unique_domains(history: DataFrame) -> DataFrame:
    return registrable(history).agg(F.countDistinct("registrable_domain").alias("unique_domains"))
