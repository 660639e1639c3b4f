"""N-gram Jaccard join with grouped prefixes.

Documents become sets of hashed word shingles. Equal sets collapse to one class, and
classes with the same prefix and size to one group: prefixes follow a global order of
shingles, the frequent ones last, and two similar sets must share a shingle of their
prefixes. Groups that meet in a prefix shingle are filtered by size, by position and by the
overlap of their prefixes; only then are members expanded and verified on the full sets.

Large clusters of near copies would make candidate pairs without number. So each posting
list is first compared with its pivot alone; what that links has one label, and only pairs
with different labels are compared after that. No link between components is lost. Links
inside components are then counted on request: the different sets of a component are dealt
into blocks of bounded size, and each pair of blocks is compared by one matrix product, so
no pair is ever a row. Members of groups that are no singles are compared in the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, map_batches, materialize, release, release_under, resting_on, tidy
from .components import components

WIDTH = 5
PERCENT = 80

#: The frequent shingles that are put last are at most this many, so they can be sent to all tasks.
MAX_FREQUENT = 1_000_000
#: A shingle is frequent from this many prefixes on, or from more where they are too many.
FREQUENT = 50
#: Share by which prefixes are longer when frequent shingles are counted.
MARGIN = 0.25

#: Bits of a shingle, 32 at most, by which prefixes are compared before sets are.
FILTER_BITS = 32
#: Size of the sets in a block, with so much more for each of them; two blocks are compared at a time.
BLOCK_BYTES, ROW_BYTES = 4 << 20, 2048
#: Cells of the matrices whose product counts what sets share.
CELLS = 1 << 22

#: Tokens that are counted before they are sent on.
COUNT_TOKENS = 1 << 21

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text (no nulls), the sorted distinct hashes of its shingles.

    Words are what ASCII white space separates, A-Z lower-cased. A text with fewer words
    than ``width`` has one shingle of them all; without words it has none.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = pc.list_flatten(split).dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    codes = coded.indices.to_numpy()
    text_of = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
    if b"" in words:  # beside white space at the ends
        real = codes != words.index(b"")
        codes, text_of = codes[real], text_of[real]
    values = hashes[codes]
    ends = np.searchsorted(text_of, np.arange(len(texts)), side="right")
    n = max(0, len(values) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled = _mix(rolled * _ODD[0] + values[k : k + n])
    start = 0
    for end in ends.tolist():
        if end - start >= width:
            yield np.unique(rolled[start : end - width + 1])
        elif end > start:
            short = np.zeros(1, np.uint64)
            for value in values[start:end]:
                short = _mix(short * _ODD[0] + value)
            yield _mix(short + np.uint64(end - start))
        else:
            yield np.zeros(0, np.uint64)
        start = end


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set similar to one of size n must share with it."""
    return -(-percent * n // 100)


def prefix_length(n: int, percent: int) -> int:
    return n - least_overlap(n, percent) + 1 if n else 0


def _short(hashes: np.ndarray) -> np.ndarray:
    """32 bits of the hashes, for counting; what shares them is counted together."""
    return (hashes >> np.uint64(32)).astype(np.uint32)


def _is_frequent(shorts: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(frequent, shorts), len(frequent) - 1)
    return frequent[at] == shorts


def _counted(docs: DataFrame, width: int, choose: Callable[[np.ndarray], np.ndarray | None]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted short hashes, among those that ``choose`` takes of each set, that are frequent; and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values.view(np.int32)), pa.array(counts)], names=["short", "n"])

        for batch in batches:
            for found in shingle_sets(pc.fill_null(batch.column(0), ""), width):
                chosen = choose(found)
                if chosen is not None:
                    held.append(np.unique(chosen))
                    size += len(chosen)
            if size >= COUNT_TOKENS:
                yield counted()
                held, size = [], 0
        if size:
            yield counted()

    counts = map_batches(docs, run, "short int, n long").groupBy("short").agg(F.sum("n").alias("n")).where(F.col("n") > FREQUENT)
    counts = materialize(counts, "shingle-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(FREQUENT, -(-total // MAX_FREQUENT))
    # Their counts add up to ``total`` at most, so there are at most MAX_FREQUENT above ``least``.
    rows = counts.where(F.col("n") > least).toPandas()
    release(counts)
    shorts = rows["short"].to_numpy(np.int32).view(np.uint32)
    order = np.argsort(shorts)
    return shorts[order], rows["n"].to_numpy(np.int64)[order]


def frequent_shingles(docs: DataFrame, width: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted short hashes of frequent shingles, and their counts, over all documents of (text).

    First the shingles in prefixes by hash are counted. A document whose prefix reaches beyond
    what was counted, because too much of it is frequent, then has all of its shingles counted;
    so every shingle that near copies or shared passages bring into prefixes is known.
    """

    def zone(found: np.ndarray) -> np.ndarray:
        return _short(found[: int((1 + MARGIN) * prefix_length(len(found), percent)) + 1])

    first, first_counts = _counted(docs, width, zone)
    if not len(first):
        return first, first_counts

    def whole(found: np.ndarray) -> np.ndarray | None:
        low = zone(found)
        enough = len(low) - _is_frequent(low, first).sum() >= prefix_length(len(found), percent)
        return None if enough else _short(found)

    second, second_counts = _counted(docs, width, whole)
    shorts, place = np.unique(np.concatenate([first, second]), return_inverse=True)
    counts = np.zeros(len(shorts), np.int64)
    np.maximum.at(counts, place, np.concatenate([first_counts, second_counts]))
    return shorts, counts


def ordered_prefix(found: np.ndarray, percent: int, frequent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The first shingles by the global order (rare ones by hash, then frequent ones by count and
    hash), and how many rare ones the whole set has."""
    length = prefix_length(len(found), percent)
    if len(frequent):
        shorts = _short(found)
        often = _is_frequent(shorts, frequent)
        if often.any():
            first = found[~often]
            n_rare = len(first)
            if n_rare < length:
                rest, n = found[often], counts[np.searchsorted(frequent, shorts[often])]
                first = np.concatenate([first, rest[np.lexsort((rest, n))]])
            return first[:length], n_rare
    return found[:length], len(found)


def described(docs: DataFrame, width: int, percent: int, frequent: np.ndarray, counts: np.ndarray) -> DataFrame:
    """From (id, text): id, n, rare, the digests of the set (s1, s2) and of prefix and rare (p1, p2), and the prefix."""
    kind = docs.schema["id"].dataType.simpleString()
    names = ["id", "n", "rare", "s1", "s2", "p1", "p2", "prefix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, rares, digests, prefixes = [], [], [], []
            for found in shingle_sets(pc.fill_null(batch.column(1), ""), width):
                prefix, rare = ordered_prefix(found, percent, frequent, counts)
                sizes.append(len(found))
                rares.append(rare)
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) + xxhash.xxh3_128_digest(prefix.tobytes(), seed=rare))
                prefixes.append(prefix.view(np.int64))
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 4)
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype(np.int32)
            arrays = [batch.column(0), pa.array(np.array(sizes, np.int64)), pa.array(np.array(rares, np.int64)), *(pa.array(halves[:, k]) for k in range(4)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return map_batches(docs, run, f"id {kind}, n long, rare long, s1 long, s2 long, p1 long, p2 long, prefix array<long>")


def stored_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, width: int, have: DataFrame | None = None) -> DataFrame:
    """Stored (cid, members) for the classes of ``wanted`` (cid) that ``have`` lacks; members are the sorted hashes."""
    wanted = wanted.distinct()
    if have is not None:
        wanted = wanted.join(have.select("cid"), "cid", "left_anti")
    need = materialize(classes.join(wanted, "cid").select("cid", "rep", "s1", "s2"), "join-wanted")
    reps = materialize(need.select(F.col("rep").alias("w_rep")).distinct(), "join-reps")
    texts = docs.join(broadcast_if_small(reps), F.col("id").eqNullSafe(F.col("w_rep")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.tobytes() for x in shingle_sets(pc.fill_null(batch.column(0), ""), width)]
            halves = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, found)), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(found, pa.binary())], names=["s1", "s2", "members"])

    sets = map_batches(texts, run, "s1 long, s2 long, members binary")
    sets = sets.join(broadcast_if_small(need).select("cid", "s1", "s2"), ["s1", "s2"])
    out = materialize(sets.groupBy("cid").agg(F.first("members").alias("members")), "join-sets")
    release(need, reps)
    return out


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough."""
    both = pairs.join(sets.select(F.col("cid").alias("b"), F.col("members").alias("mb")), "b")
    both = both.join(sets.select(F.col("cid").alias("a"), F.col("members").alias("ma")), "a").select("a", "b", "ma", "mb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return map_batches(both, run, "a long, b long")


def _similar_sizes(n: str, m: str, percent: int):
    return (F.col(n) * 100 >= F.col(m) * percent) & (F.col(m) * 100 >= F.col(n) * percent)


def _needed(n: str, m: str, percent: int):
    """The overlap that sets of these sizes need."""
    return F.ceil(F.lit(percent) * (F.col(n) + F.col(m)) / (100 + percent) - 1e-9)


def _common_enough(n: str, rare: str, m: str, rare_m: str, percent: int):
    """For sets that meet in a frequent shingle: whether their frequent ones alone can be enough.

    A prefix that reaches the frequent shingles holds all rare ones of its set. So if two such
    sets share a rare one, they meet there too; if not, only frequent ones are left to share.
    """
    return F.least(F.col(n) - F.col(rare), F.col(m) - F.col(rare_m)) >= _needed(n, m, percent)


def prefix_filter(pairs: DataFrame, groups: DataFrame, percent: int, label: str) -> DataFrame:
    """Pairs (a, b) of groups, stored, whose prefixes overlap enough for the sets to be similar.

    Of two prefixes, the one that ends first in the global order shares nothing with what
    follows the other, so the overlap is at most that of the prefixes and of one remainder.
    Only groups that are in a pair are read on, with FILTER_BITS of each shingle. What shares
    these counts as shared, and as many more as either prefix has shingles that share theirs
    with others of it; so no pair is lost.
    """
    pairs = materialize(pairs, f"{label}-pairs")
    met = materialize(pairs.select(F.col("a").alias("gid")).unionByName(pairs.select(F.col("b").alias("gid"))).distinct(), f"{label}-met")
    short = F.transform("prefix", lambda x: F.shiftright(x, 64 - FILTER_BITS).cast("int"))
    involved = groups.join(broadcast_if_small(met), "gid", "left_semi").select("gid", "n", short.alias("prefix"))
    involved = involved.withColumn("twice", F.size("prefix") - F.size(F.array_distinct("prefix")))
    involved = materialize(involved, f"{label}-involved")
    tidy(pairs.sparkSession)
    # Prefixes are joined by shuffle at every size, so disk grows in proportion.
    side = lambda x: involved.select(F.col("gid").alias(x), F.col("n").alias(f"n{x}"), F.col("prefix").alias(f"p{x}"), F.col("twice").alias(f"t{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    rest = F.greatest(F.col("na") - F.size("pa"), F.col("nb") - F.size("pb"))
    enough = F.size(F.array_intersect("pa", "pb")) + F.least("ta", "tb") + rest >= _needed("na", "nb", percent)
    out = materialize(both.where(_similar_sizes("na", "nb", percent) & enough).select("a", "b"), label)
    release(pairs, met, involved)
    tidy(out.sparkSession)
    return out


#: The side of rows whose block is compared with itself.
SELF = -1


def _band(n: str, percent: int):
    """Size bands: similar sets lie in the same band or in neighbouring ones."""
    return F.floor(F.log(F.col(n).cast("double")) / F.log(F.lit(max(100.0 / percent, 1.0001))) + 1e-9).cast("int")


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """How many members each of ``left`` shares with each of ``right``, or with each other of ``left``.

    Sets are sorted and without repeats. Columns of the two matrices are the members that
    more than one set has; as many are multiplied at a time as CELLS allows.
    """
    sides = [left] if right is None else [left, right]
    sizes = [np.fromiter(map(len, side), np.int64, len(side)) for side in sides]
    values, place = np.unique(np.concatenate([x for side in sides for x in side]), return_inverse=True)
    places = np.split(place, [int(sizes[0].sum())])[: len(sides)]
    counts = [np.bincount(p, minlength=len(values)) for p in places]
    common = counts[0] > 1 if right is None else (counts[0] > 0) & (counts[1] > 0)
    column = np.where(common, np.cumsum(common) - 1, -1)
    entries = []
    for own, size in zip(places, sizes, strict=True):
        row, at = np.repeat(np.arange(len(size)), size), column[own]
        by = np.argsort(at, kind="stable")
        by = by[np.searchsorted(at[by], 0) :]
        entries.append((row[by], at[by]))
    out = np.zeros((len(left), len(left if right is None else right)), np.int64)
    step = max(1, CELLS // max(out.shape))
    for low in range(0, int(common.sum()), step):
        parts = []
        for (row, at), size in zip(entries, sizes, strict=True):
            first, last = np.searchsorted(at, (low, low + step))
            part = np.zeros((len(size), min(step, int(common.sum()) - low)), np.float32)
            part[row[first:last], at[first:last] - low] = 1
            parts.append(part)
        out += (parts[0] @ parts[-1].T).astype(np.int64)
    return out


def _forest(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """Those linked (row, column) that join what the ones before them left apart."""
    root = list(range(sum(linked.shape)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i, j in np.argwhere(linked).tolist():
        a, b = find(i), find(linked.shape[0] + j)
        if a != b:
            root[a] = b
            yield i, j


def block_pairs(members: DataFrame, percent: int) -> DataFrame:
    """From (bucket, cid, n): each row once for every pair of blocks that its block is compared in.

    A bucket that fits is one block. A larger one is cut by size bands, and these into blocks
    by the hash of cid; only blocks of the same or of neighbouring bands are compared. ``pair``
    names the two blocks within the bucket, ``side`` tells which of them the row is in; it is
    SELF where a block is compared with itself.
    """
    sized = members.withColumn("band", _band("n", percent))
    cut = sized.groupBy("bucket", "band").agg(F.sum(8 * F.col("n") + ROW_BYTES).alias("bytes"))
    cut = cut.withColumn("blocks", F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int"))
    # The bands of a bucket are bounded by the logarithm of the longest text.
    cut = cut.groupBy("bucket").agg(F.sum("bytes").alias("bytes"), F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("blocks"))
    cut = materialize(cut.where(F.col("bytes") > BLOCK_BYTES).select("bucket", "blocks"), "join-blocks")
    sized = sized.join(broadcast_if_small(cut), "bucket", "left")
    own = F.struct("band", F.expr("pmod(xxhash64(cid), blocks[band])").cast("int").alias("block"))
    sized = sized.withColumn("own", own)
    near = F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)
    others = F.flatten(
        F.transform(
            F.filter(near, lambda k: F.col("blocks")[k].isNotNull()),
            lambda k: F.transform(F.sequence(F.lit(0), F.col("blocks")[k] - 1), lambda m: F.struct(k.alias("band"), m.alias("block"))),
        )
    )
    whole = F.array(F.struct(F.lit("").alias("pair"), F.lit(SELF).alias("side")))

    def named(other):
        low, high = F.least("own", other), F.greatest("own", other)
        pair = F.concat_ws(":", low["band"], low["block"], high["band"], high["block"])
        return F.struct(pair.alias("pair"), F.when(low == high, SELF).when(F.col("own") == low, 0).otherwise(1).alias("side"))

    chosen = F.when(F.col("blocks").isNull(), whole).otherwise(F.transform(others, named))
    names = [c for c in members.columns if c != "bucket"]
    return resting_on(sized.select("bucket", *names, F.explode(chosen).alias("to")).select("bucket", "to.pair", "to.side", *names), cut)


def block_links(members: DataFrame, sets: DataFrame, percent: int, forest: bool, label: str) -> DataFrame:
    """Compare all members (bucket, cid, n, copies) of each bucket, whose sets are given; stored.

    Returns (cid, links): the copies in classes of the bucket that a class is linked with. Or,
    as a ``forest``, links (a, b) that connect whatever is linked.
    """
    dealt = block_pairs(members, percent)
    rows = dealt.join(sets, "cid").select("bucket", "pair", "side", "cid", "copies", "members")
    rows = rows.repartition("bucket", "pair").sortWithinPartitions("bucket", "pair", "side", "cid")
    names = ["a", "b"] if forest else ["cid", "links"]

    def compared(group: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        one = group[0][2] == SELF
        n_left = len(group) if one else sum(r[2] == 0 for r in group)
        ids = np.array([r[3] for r in group], np.int64)
        copies = np.array([r[4] for r in group], np.int64)
        found = [np.frombuffer(r[5], np.uint64) for r in group]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        if len(group) < 2 or not one and n_left in (0, len(group)):
            return ids[:0], ids[:0]
        right = slice(0, None) if one else slice(n_left, None)
        shared = overlaps(found[:n_left], None if one else found[n_left:])
        linked = 100 * shared >= percent * (sizes[:n_left, None] + sizes[None, right] - shared)
        if one:
            np.fill_diagonal(linked, False)
        if forest:
            pairs = np.array(list(_forest(np.triu(linked) if one else linked)), np.int64).reshape(-1, 2)
            return ids[:n_left][pairs[:, 0]], ids[right][pairs[:, 1]]
        totals = linked @ copies[right]
        return (ids, totals) if one else (ids, np.concatenate((totals, copies[:n_left] @ linked)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in compared(group)], names=names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[:2] != group[0][:2]:
                    yield out()
                    group = []
                group.append(row)
        if group:
            yield out()

    found = map_batches(rows, run, ", ".join(f"{x} long" for x in names))
    if not forest:
        found = found.groupBy("cid").agg(F.sum("links").alias("links"))
    found = materialize(found, label)
    release_under(dealt)
    return found


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, links: bool = False) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, class_id, class_size; n_links if ``links``.

    Two documents are linked when 100 * |intersection| >= percent * |union| of their shingle
    sets (hashed to 64 bits). component_id is the smallest id reachable by links, the own
    included; class_id is the smallest id among documents with the same set. n_links counts the
    documents that a document is linked with, copies too; every link between different sets is
    verified for it, so its cost grows with the square of the different sets of a component.
    Documents without
    words are linked with nothing and keep their own id. Rows with equal ids are separate
    documents; null ids count only where a component has no other. Only the two columns named
    are read. An empty table gives none.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    frequent, counts = frequent_shingles(docs.select("text"), width, percent)
    rows = described(docs, width, percent, frequent, counts).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "join-rows")

    # Equal sets are one class, named by one of its rows.
    classes = rows.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.min("row").alias("cid"), F.first("p1").alias("p1"), F.first("p2").alias("p2"))
    classes = materialize(classes, "join-classes")
    # Equal prefixes and sizes are one group, headed by its most copied class, whose row has the prefix.
    heads = classes.groupBy("p1", "p2", "n").agg(F.max(F.struct("copies", (-F.col("cid")).alias("less"))).alias("head"), F.count("*").alias("members"))
    heads = materialize(heads.select((-F.col("head.less")).alias("gid"), "p1", "p2", "members", F.col("head.copies").alias("copies")), "join-heads")
    groups = rows.select(F.col("row").alias("gid"), "n", "rare", "prefix").join(broadcast_if_small(heads), "gid")
    groups = materialize(groups, "join-groups")
    whole, rows = rows, materialize(rows.select("id", "n", "s1", "s2"), "join-slim-rows")
    release(whole)
    tidy(docs.sparkSession)
    crowded = groups.where("members > 1").select("gid", "p1", "p2", "n")
    member = materialize(classes.select("cid", "p1", "p2", "n").join(crowded, ["p1", "p2", "n"]).select("gid", "cid").where("cid <> gid"), "join-members")

    # Postings that meet another group in their shingle. The list's pivot is the group with the
    # fewest rare shingles: near copies are told from what they were made of by those.
    postings = groups.select("gid", "n", "rare", "copies", F.posexplode("prefix").alias("at", "token"))
    order = F.struct((-F.col("rare")).alias("common"), "copies", (-F.col("gid")).alias("less"), "n")
    of = Window.partitionBy("token")
    pivot = [(-F.col("pivot.less")).alias("pivot"), F.col("pivot.n").alias("pivot_n"), (-F.col("pivot.common")).alias("pivot_rare")]
    columns = ["token", "gid", "n", "rare", "at", *pivot]
    # What is not frequent was counted in few prefixes, so those lists are short; the others are aggregated.
    lists = postings.where("at < rare").withColumn("pivot", F.max(order).over(of)).withColumn("size", F.count("*").over(of))
    often = postings.where("at >= rare")
    pivots = materialize(often.groupBy("token").agg(F.max(order).alias("pivot"), F.count("*").alias("size")).where("size > 1"), "join-pivots")
    often = often.join(broadcast_if_small(pivots.select("token", "pivot"), pivots), "token")
    met = materialize(lists.where("size > 1").select(columns).unionByName(often.select(columns)), "join-met")
    release(pivots)
    tidy(docs.sparkSession)

    stars = met.where(F.col("gid") != F.col("pivot")).where(_similar_sizes("n", "pivot_n", percent))
    stars = stars.where((F.col("at") < F.col("rare")) | _common_enough("n", "rare", "pivot_n", "pivot_rare", percent))
    stars = prefix_filter(stars.select(F.col("pivot").alias("a"), F.col("gid").alias("b")).distinct(), groups, percent, "join-stars")
    first = stars.unionByName(member.select(F.col("gid").alias("a"), F.col("cid").alias("b")))
    sets = first_sets = stored_sets(docs, classes, first.select(F.col("a").alias("cid")).unionByName(first.select(F.col("b").alias("cid"))), width)
    found = materialize(verified(first, sets, percent), "join-links")
    release(stars)
    tidy(docs.sparkSession)
    label = materialize(components(found.select(F.col("a").alias("u"), F.col("b").alias("v"))), "join-labels")

    second, buckets = _rest(met, groups, classes, member, label, percent)
    release(met, groups)
    if second.isEmpty() and buckets.isEmpty():
        linked, more_sets = label, None
    else:
        wanted = second.select(F.col("a").alias("cid")).unionByName(second.select(F.col("b").alias("cid"))).unionByName(buckets.select("cid"))
        more_sets = stored_sets(docs, classes, wanted, width, sets)
        all_sets = sets.unionByName(more_sets)
        more = materialize(verified(second, all_sets, percent), "join-more")
        inside = block_links(buckets, all_sets, percent, True, "join-inside")
        release(label)
        edges = found.unionByName(more).unionByName(inside)
        linked = materialize(components(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), "join-components")
        release(more, inside)
        sets = all_sets if links else sets
    if links:
        own = linked.select(F.col("node").alias("cid"), F.col("root").alias("bucket"))
        counted = block_links(own.join(classes.select("cid", "n", "copies"), "cid"), sets, percent, False, "join-counted")
    # From classes back to rows; classes alone are their own component.
    rooted = classes.select("s1", "s2", "rep", "copies", "cid").join(linked.select(F.col("node").alias("cid"), "root"), "cid", "left")
    if links:
        rooted = rooted.join(counted, "cid", "left")
    rooted = materialize(rooted, "join-rooted")
    # Stored, so that a component with very many classes is either broadcast to or split, not gathered.
    least = materialize(rooted.where("root is not null").groupBy("root").agg(F.min("rep").alias("least")), "join-least")
    member_of = rooted.join(broadcast_if_small(least), "root", "left")
    count = [F.coalesce("links", F.lit(0)).alias("links")] if links else []
    member_of = materialize(member_of.select("s1", "s2", "rep", "copies", F.coalesce("least", "rep").alias("component"), *count), "join-result")
    out = rows.select("id", "n", "s1", "s2").join(member_of, ["s1", "s2"], "left")
    release(heads, member, second, buckets, classes, found, linked, rooted, least, first_sets, *([more_sets] if more_sets else []), *([counted] if links else []))
    tidy(docs.sparkSession)
    out = out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce("rep", "id").alias("class_id"),
        F.coalesce("copies", F.lit(1)).alias("class_size"),
        *([(F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links")] if links else []),
    )
    return resting_on(out, rows, member_of)


def _rest(met: DataFrame, groups: DataFrame, classes: DataFrame, member: DataFrame, label: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """What is left to compare, stored: pairs (a, b) of classes with different labels that the
    prefixes allow to be similar; and buckets (bucket, cid, n, copies) of classes to be compared
    with each other, which stand for mixed groups and for pairs of groups with several members."""
    names = label.select(F.col("node").alias("gid"), F.col("root"))
    labelled = met.select("token", "gid", "n", "rare", "at").join(names, "gid", "left").withColumn("label", F.coalesce("root", "gid")).drop("root")
    # Members not linked with their head have labels of their own, so their groups count as mixed.
    of_member = member.join(label.select(F.col("node").alias("cid"), F.col("root")), "cid", "left").select("gid", "cid", F.coalesce("root", "cid").alias("label"))
    heads = member.select("gid").distinct().join(names, "gid", "left").select("gid", F.col("gid").alias("cid"), F.coalesce("root", "gid").alias("label"))
    everyone = materialize(of_member.unionByName(heads), "join-everyone")
    mixed = everyone.groupBy("gid").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    mixed = materialize(mixed.where("lo < hi").select("gid"), "join-mixed")
    labelled = labelled.join(mixed.withColumn("mixed", F.lit(True)), "gid", "left").withColumn("mixed", F.coalesce("mixed", F.lit(False)))
    labelled = labelled_table = materialize(labelled, "join-labelled")
    tokens = labelled.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("mixed").alias("mixed"))
    labelled = labelled.join(tokens.where("lo < hi or mixed").select("token"), "token")
    # The larger set lies in the size band of the smaller one or in the next.
    band = _band("n", percent)
    frequent = F.col("at") >= F.col("rare")
    # Where only frequent shingles are shared, neither the smaller nor the larger set can have more rare ones than this.
    few = F.col("rare") * (100 + percent) <= F.col("n") * (100 - percent)
    left = labelled.where(~frequent | few).select("token", F.col("gid").alias("a"), F.col("n").alias("na"), F.col("rare").alias("ra"), F.col("at").alias("ia"), F.col("label").alias("la"), F.col("mixed").alias("xa"), F.explode(F.array(band, band + 1)).alias("band"))
    some = F.col("rare") * 100 <= F.col("n") * (100 - percent)
    right = labelled.where(~frequent | some).select("token", F.col("gid").alias("b"), F.col("n").alias("nb"), F.col("rare").alias("rb"), F.col("at").alias("ib"), F.col("label").alias("lb"), F.col("mixed").alias("xb"), band.alias("band"))
    ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    different = (F.col("la") != F.col("lb")) | F.col("xa") | F.col("xb")
    bound = F.least("ia", "ib") + 1 + F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) - 1
    enough = (F.col("ia") < F.col("ra")) | _common_enough("na", "ra", "nb", "rb", percent)
    pairs = left.join(right, ["token", "band"]).where(ordered & different & enough & _similar_sizes("na", "nb", percent) & (bound >= _needed("na", "nb", percent)))
    pairs = stored = prefix_filter(pairs.select("a", "b").distinct(), groups, percent, "join-across")
    # Groups of one class are that class. The others are compared in buckets, member by member.
    crowded = materialize(everyone.select("gid").distinct(), "join-crowded")
    many = lambda x: crowded.select(F.col("gid").alias(x), F.lit(True).alias(f"m{x}"))
    pairs = pairs.join(many("b"), "b", "left").join(many("a"), "a", "left")
    out = materialize(pairs.where("ma is null and mb is null").select("a", "b"), "join-rest")
    met_groups = pairs.where("ma or mb").select(F.xxhash64("a", "b").alias("bucket"), F.explode(F.array("a", "b")).alias("gid"))
    met_groups = met_groups.unionByName(mixed.select(F.xxhash64("gid").alias("bucket"), "gid"))
    inside = met_groups.join(everyone.select("gid", "cid"), "gid", "left").select("bucket", F.coalesce("cid", "gid").alias("cid")).distinct()
    inside = materialize(inside.join(classes.select("cid", "n", "copies"), "cid").select("bucket", "cid", "n", "copies"), "join-buckets")
    release(labelled_table, everyone, mixed, stored, crowded)
    return out, inside
