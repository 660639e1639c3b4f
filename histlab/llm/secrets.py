"""Secret scan with multipart credential linking, in DataFrame operations only.

Base findings (assignments, access identifiers, long hexadecimal strings) are reported as
they stand. Weaker candidates are the parts of credentials that mean little alone: names of
accounts, random-looking strings, and endpoints. Parts become intervals of their document;
an interval join over scopes of SCOPE code points, keyed by document and bin, reports a
weak candidate only where a complementary part lies in the same scope.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, text_of

#: Fixed patterns of the base findings.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

#: Patterns of the weak candidates.
LOGIN = r"""(?i:user(?:_?name)?|login|client_?id|account(?:_?id)?|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
#: An opaque string needs a digit and letters of either case; that is tested on whole runs, so a run is read once.
OPAQUE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ENDPOINT = r"(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x00-\x20\x22'<>]+"

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "login", "opaque", "endpoint")
PART = {"assign": "secret", "hex": "secret", "opaque": "secret", "access": "identifier", "login": "identifier", "endpoint": "endpoint"}
#: What a weak candidate needs next to it.
NEEDS = {"login": ("secret",), "opaque": ("identifier", "endpoint"), "endpoint": ("secret",)}

SCOPE = 300
_BLOCK = 64


def match_spans(df: DataFrame, text: str, kind: str, pattern: str, gate: Column | None = None, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add column ``kind``: array of (start, stop) of the leftmost matches, in code points.

    Splitting at the pattern gives what lies between the matches, so starts are prefix sums
    of lengths. They are summed in blocks, and blocks in larger blocks, which keeps texts with
    millions of matches cheap.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    none = F.array().cast("array<string>")
    df = df.withColumn("_found", found if gate is None else F.when(gate, found).otherwise(none))
    gaps = F.transform(F.slice(F.split(F.col(text), pattern, -1), 1, F.size("_found")), lambda x: F.length(x))
    df = df.withColumn("_gaps", F.when(F.size("_found") > 0, gaps).otherwise(F.array().cast("array<int>")))
    df = df.withColumn("_steps", F.zip_with("_gaps", "_found", lambda gap, m: gap + F.length(m)))

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def blocks(values: str) -> Column:
        return F.sequence(F.lit(0), F.expr(f"(size({values}) + {_BLOCK - 1}) div {_BLOCK}").cast("int"))

    def sums(values: str) -> Column:
        return F.transform(blocks(values), lambda b: total(F.slice(F.col(values), b * _BLOCK + 1, F.lit(_BLOCK))))

    def before(values: str, bases: str, i: Column) -> Column:
        """The sum of the first ``i`` values, whose blocks start from ``bases``."""
        block = F.floor(i / _BLOCK).cast("int")
        return F.get(F.col(bases), block) + total(F.slice(F.col(values), block * _BLOCK + 1, i - block * _BLOCK))

    df = df.withColumn("_sums", sums("_steps")).withColumn("_tops", sums("_sums"))
    df = df.withColumn("_highs", F.transform(blocks("_sums"), lambda b: total(F.slice(F.col("_tops"), F.lit(1), b))))
    df = df.withColumn("_bases", F.transform(blocks("_steps"), lambda b: before("_sums", "_highs", b)))

    def span(gap: Column, i: Column) -> Column:
        start = before("_steps", "_bases", i) + gap
        match = F.get(F.col("_found"), i)
        return F.struct(start.alias("start"), (start + F.length(match)).alias("stop"), match.alias("match"))

    spans = F.transform("_gaps", span)
    if keep is not None:
        spans = F.filter(spans, lambda s: keep(s["match"]))
    spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))
    empty = F.array().cast("array<struct<start:int,stop:int>>")
    return df.withColumn(kind, F.when(F.size("_found") > 0, spans).otherwise(empty)).drop("_found", "_gaps", "_steps", "_sums", "_tops", "_highs", "_bases")


def candidates(docs: DataFrame) -> DataFrame:
    """From (id, text): id, mark, and one array of spans for each kind. mark stands for the text."""
    t = F.col("text")
    df = docs.select("id", F.xxhash64("text").alias("mark"), "text")
    sign = t.contains("=") | t.contains(":")
    long_value = lambda m: F.length(F.regexp_extract(m, f"^{ASSIGN}", 2)) >= 6
    df = match_spans(df, "text", "assign", ASSIGN, sign, long_value)
    df = match_spans(df, "text", "access", ACCESS, t.contains("AKIA"))
    df = match_spans(df, "text", "hex", HEX)
    # Weak candidates matter only where two parts can meet.
    df = match_spans(df, "text", "login", LOGIN, sign)
    df = match_spans(df, "text", "endpoint", ENDPOINT, t.contains("://"))
    some = (F.size("access") > 0) | (F.size("login") > 0) | (F.size("endpoint") > 0)
    mixed = lambda m: m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]")
    df = match_spans(df, "text", "opaque", OPAQUE, some, mixed)
    return df.select("id", "mark", *KINDS)


def _tagged(kind: str) -> Column:
    """The spans of a kind as (start, kind number, stop), which is also their order."""
    number = F.lit(KINDS.index(kind)).alias("kind")
    return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), number, s["stop"].alias("stop")))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak candidates that a complementary part supports: id, mark, kind, start, stop."""
    has = {part: sum((F.size(k) for k in KINDS if PART[k] == part), F.lit(0)) > 0 for part in ("secret", "identifier", "endpoint")}
    able = found.where(has["secret"] & (has["identifier"] | has["endpoint"])).dropDuplicates(["id", "mark"])
    tagged = F.concat(*(_tagged(k) for k in KINDS))
    parts = able.select("id", "mark", F.explode(tagged).alias("p")).select("id", "mark", "p.*")
    names = F.create_map(*(F.lit(x) for k in KINDS for x in (KINDS.index(k), PART[k])))
    parts = materialize(parts.withColumn("part", names[F.col("kind")]), "secret-parts")
    # A weak candidate that a base finding covers is reported already.
    # A span has a row for every bin it touches, so long ones meet whatever lies along them.
    width = max(scope, 1)

    def bins(margin: int) -> Column:
        first, last = (F.floor((F.col(c) + d) / width) for c, d in (("start", -margin), ("stop", margin)))
        return F.explode(F.sequence(first, last))

    base = parts.where(F.col("kind") < 3).select(F.col("id").alias("b_id"), F.col("mark").alias("b_mark"), F.col("start").alias("b_start"), F.col("stop").alias("b_stop"), bins(0).alias("b_bin"))
    weak = parts.where(F.col("kind") >= 3).select("id", "mark", "kind", "start", "stop", bins(scope).alias("bin"))
    same = lambda p: F.col("id").eqNullSafe(F.col(f"{p}_id")) & (F.col("mark") == F.col(f"{p}_mark")) & (F.col("bin") == F.col(f"{p}_bin"))
    other = parts.select(F.col("id").alias("o_id"), F.col("mark").alias("o_mark"), F.col("start").alias("o_start"), F.col("stop").alias("o_stop"), F.col("part").alias("o_part"), bins(0).alias("o_bin"))
    helps = F.lit(False)
    for kind, needs in NEEDS.items():
        helps = helps | ((F.col("kind") == KINDS.index(kind)) & F.col("o_part").isin(*needs))
    apart = (F.col("start") - F.col("o_stop") <= scope) & (F.col("o_start") - F.col("stop") <= scope)
    overlap = (F.col("start") < F.col("o_stop")) & (F.col("o_start") < F.col("stop"))
    good = weak.join(other, same("o") & helps & apart & ~overlap, "left_semi").select("id", "mark", "kind", "start", "stop").distinct()
    covered = (F.col("start") < F.col("b_stop")) & (F.col("b_start") < F.col("stop"))
    good = good.withColumn("bin", bins(0))
    hit = good.join(base, same("b") & covered, "left_semi").select("id", "mark", "kind", "start", "stop").distinct()
    good = good.select("id", "mark", "kind", "start", "stop").distinct()
    hit = hit.select(*(F.col(c).alias(f"h_{c}") for c in hit.columns))
    on = F.col("id").eqNullSafe(F.col("h_id"))
    for c in ("mark", "kind", "start", "stop"):
        on = on & (F.col(c) == F.col(f"h_{c}"))
    return good.join(hit, on, "left_anti")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    Spans are kind:start:end in code points, end exclusive, by start and then by the order of
    KINDS, comma-joined; base_sha256 is the digest of the base ones. Base matches are leftmost
    and do not overlap within a kind; matches that fail are dropped. Null text counts as empty
    and has no spans. Rows with equal id and text have equal results; rows with equal id and
    other texts, or without an id, are told apart by their text. Only the two columns named
    are read, so other columns cannot clash; an empty table gives none.
    """
    found = materialize(candidates(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))), "secret-candidates")
    added = linked(found, scope).groupBy("id", "mark").agg(F.collect_list(F.struct("start", "kind", "stop")).alias("added"))
    added = broadcast_if_small(materialize(added, "secret-links")).select(F.col("id").alias("a_id"), F.col("mark").alias("a_mark"), "added")
    rows = found.join(added, F.col("id").eqNullSafe(F.col("a_id")) & (F.col("mark") == F.col("a_mark")), "left")
    base = F.concat(*(_tagged(k) for k in KINDS[:3]))
    rows = rows.select("id", *KINDS[:3], F.sort_array(base).alias("base"), F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,stop:int>>")).alias("added"))
    names = F.array(*map(F.lit, KINDS))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")

    return rows.select(
        F.col("id").alias(id_col),
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.sort_array(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_linked"),
    )
