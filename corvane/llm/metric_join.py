"""Problem 1: near-duplicate records, by an exact join in the Jaccard metric space of word shingles.

Pivots and regions. Every shingle p is a pivot, as the set {p}; d(x, {p}) = 1 - 1/|x| if p is in x, else 1, so all pivots in x are
equally near, and the tie goes to the rarest. The Voronoi region of p holds the records whose rarest shingle is p.
Windows. Let A(p) be the pivots rarer than p. For y in the region of p, y and A(p) are disjoint, so by the triangle inequality
of the symmetric difference restricted to A(p), x within distance r of y has |x & A(p)| <= |x - y| <= r |x|. A record is therefore
replicated to the regions of its rarest shingles until r |x| of them are spent, and two records within r meet in the region of
the rarest pivot that they share.
Recursion. In a region of more than HOT records the pivot is spent and the same rule is applied to what is left: a region
(p1, p2), then (p1, p2, p3), each level with one more unit of window; what DEPTH levels leave crowded is joined in pairs of blocks.
Regions join exactly, by size, place and then full sets.

Any order of pivots gives the same pairs, so "rarest" needs no exact count: shingles are counted by places of a table of fixed size.

Document pivots with windows d(x, q) <= d(x, p) + 2 r are of no use at these thresholds: for r = 0.5 a window covers all of the space,
and each record falls into every region. The README has the figures of that window and of two others.

Records with the same words in the same order are one class, joined once. A record without a shingle (null, empty, fewer words
than a shingle) is similar to none. Equal row_ids within a class count once. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.windows import mix, signed
from corvane.operators.components import components
from corvane.store import bounded, table, written

HOT, DEPTH = 4096, 3
WORD = re.compile(r"[a-z0-9_]+")
#: Places of the table of shingle frequencies by which shingles are ordered; its size is fixed.
PLACES = 1 << 20
_HELD = 1 << 20


def sorted_within(owner: np.ndarray, level: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The order by owner, level and hash, by one sort of packed numbers where these tell all apart."""
    bits = int(owner[-1]).bit_length() if len(owner) else 0
    if bits > 32:
        return np.lexsort((h, level, owner))
    packed = (level.astype(np.uint64) << np.uint64(56 - bits)) | (h >> np.uint64(8 + bits))
    if bits:
        packed |= owner.astype(np.uint64) << np.uint64(64 - bits)
    order = np.argsort(packed)
    same = packed[order[1:]] == packed[order[:-1]]
    if (same & (h[order[1:]] != h[order[:-1]])).any():
        return np.lexsort((h, level, owner))
    return order


def shingled(rows: DataFrame, n: int) -> DataFrame:
    """(row_id, text) -> (row_id, key, grams): a digest of the words and the distinct hashes of their runs of n. Rows with fewer words
    give none. A word is hashed once a batch of texts; runs are hashed by columns of numbers."""

    def run(batches):
        known: dict[str, int] = {}
        for b in batches:
            at, keys, words, counts = [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                w = WORD.findall(text)
                if len(w) >= n:
                    at.append(i)
                    keys.append(hashlib.md5(" ".join(w).encode()).digest())
                    words += w
                    counts.append(len(w))
            if len(known) > _HELD:
                known.clear()
            for w in set(words).difference(known):
                known[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            m = max(0, len(words) - n + 1)
            h = np.zeros(m, np.uint64)
            for k in range(n):
                h += codes[k : k + m] * np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64))
            ends = np.cumsum(counts, dtype=np.int64)
            owner = np.repeat(np.arange(len(counts)), counts)[:m]
            whole = np.arange(m) + n <= ends[owner] if m else np.zeros(0, bool)
            owner, h = owner[whole], mix(h[whole])
            order = sorted_within(owner, np.zeros(len(h), np.uint8), h)
            owner, h = owner[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
            edges = np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(counts)))]).astype(np.int32)
            yield pa.record_batch([b.column(0).take(pa.array(at, pa.int64())), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(edges), pa.array(signed(h[new])))], ["row_id", "key", "grams"])

    return rows.select(F.col("row_id").cast("long"), F.lower(F.coalesce("text", F.lit(""))).alias("text")).mapInArrow(run, "row_id long, key binary, grams array<long>")


def classes(rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(row_id, text) -> members (row_id, rep) and sets (rep, n, grams). Rows without a shingle are left out; of rows that repeat a
    row_id, the one with the least digest of its words counts."""
    base = written(shingled(rows, n).select(F.monotonically_increasing_id().alias("i"), "*"), "shingles")
    one = base.groupBy("row_id").agg(F.min(F.struct("key", "i")).alias("x")).select("row_id", "x.key", "x.i")
    least = one.groupBy("key").agg(F.min(F.struct("row_id", "i")).alias("y"))
    members = written(one.join(least, "key").select("row_id", "i", F.col("y.row_id").alias("rep"), F.col("y.i").alias("first")), "members")
    # The arrays stay where they are unless more rows than can be broadcast repeat another's words.
    firsts = members.filter("i = first")
    more = base.select("i").join(firsts.select("i"), "i", "left_anti")
    sets = base.join(bounded(written(more, "repeats")), "i", "left_anti").select(F.col("row_id").alias("rep"), F.size("grams").alias("n"), "grams")
    return members.select("row_id", "rep"), sets


def need(n: Column, t: float) -> Column:
    """Shingles that a record must share with any record at similarity t or more."""
    return F.ceil(n * t - 1e-9).cast("int")


def levels(sets: DataFrame) -> np.ndarray:
    """The order of shingles: how often the shingles of each of PLACES places are met, in steps of a quarter power of two. Any order
    gives exact results; this one puts the rare first. The counts are made where the records stand and summed."""

    def run(batches):
        counts = np.zeros(PLACES, np.int64)
        for b in batches:
            g = b.column(0).flatten().to_numpy().view(np.uint64)
            counts += np.bincount((g & np.uint64(PLACES - 1)).astype(np.int64), minlength=PLACES)
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["place", "c"])

    got = sets.select("grams").mapInArrow(run, "place int, c long").groupBy("place").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(PLACES, np.uint8)
    out[got.column("place").to_numpy()] = np.minimum(255, 4 * np.log2(got.column("c").to_numpy() + 1.0)).astype(np.uint8)
    return out


def ordered(sets: DataFrame, order: np.ndarray, t: float, every: bool = False, above: int | None = None) -> DataFrame:
    """(rep, n, grams) -> (rep, n, take, ord): the shingles of the window, rarest first (all of them, if every), and its length. With
    above, only records whose window reaches a shingle of that level; what isn't asked for isn't sorted."""
    held = sets.sparkSession.sparkContext.broadcast(order)

    def run(batches):
        level = held.value
        for b in batches:
            lists = b.column(2)
            edges = lists.offsets.to_numpy().astype(np.int64)
            g = lists.flatten().to_numpy()
            edges -= edges[0]
            owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            n = np.diff(edges)
            take = n - np.ceil(n * t - 1e-9).astype(np.int64) + 1
            h = g.view(np.uint64)
            at = level[(h & np.uint64(PLACES - 1)).astype(np.int64)]
            if above is not None:
                kept = np.flatnonzero(take > np.bincount(owner[at < above], minlength=len(n)))
                mine = np.isin(owner, kept)
                g, h, at, n, take = g[mine], h[mine], at[mine], n[kept], take[kept]
                owner, edges, b = np.repeat(np.arange(len(kept)), n), np.concatenate([[0], np.cumsum(n)]), b.take(pa.array(kept))
            g = g[sorted_within(owner, at, h)]
            keep = n if every else take
            got = np.arange(len(g)) - edges[:-1][owner] < keep[owner]
            cut = np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(take.astype(np.int32)), pa.ListArray.from_arrays(pa.array(cut), pa.array(g[got]))], ["rep", "n", "take", "ord"])

    return sets.select("rep", "n", "grams").mapInArrow(run, "rep long, n int, take int, ord array<long>")


#: Bits of the table of asked shingles, a fixed size. Those that share a place pass it and are told apart by the join.
BITS = 1 << 22


def asked_places(asked: DataFrame, column: str) -> np.ndarray:
    """Which of BITS places an asked hash falls into."""
    got = asked.select(F.pmod(column, F.lit(BITS)).cast("int").alias("place")).distinct().toArrow()
    out = np.zeros(BITS, bool)
    out[got.column("place").to_numpy()] = True
    return np.packbits(out)


def is_asked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h.astype(np.int64) % BITS
    return (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1


def windows_of(sets: DataFrame, order: np.ndarray, t: float, names: tuple[str, str, str] = ("rep", "n", "place"), asked: np.ndarray | None = None, hot: int = HOT, only_big: bool = False) -> DataFrame:
    """(path, rep, n, place, big), three under the names given, of the shingles in each record's window; only asked ones, if they are
    given, and only big ones, if told. What isn't big stands in at most hot records."""
    held = sets.sparkSession.sparkContext.broadcast((order, asked))
    limit = int(4 * np.log2(hot + 1.0))

    def run(batches):
        level, bits = held.value
        for b in batches:
            lists = b.column(3)
            n = np.diff(lists.offsets.to_numpy())
            g = lists.flatten().to_numpy()
            owner = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n) + 1
            keep = np.flatnonzero(is_asked(bits, g)) if bits is not None else np.arange(len(g))
            who, g = pa.array(owner[keep]), g[keep]
            big = level[(g.view(np.uint64) & np.uint64(PLACES - 1)).astype(np.int64)] >= limit
            if only_big:
                who, g, keep, big = who.filter(pa.array(big)), g[big], keep[big], big[big]
            yield pa.record_batch([pa.array(g), b.column(0).take(who), b.column(1).take(who), pa.array(place[keep].astype(np.int32)), pa.array(big)], ["path", *names, "big"])

    return ordered(sets, order, t, above=limit if only_big else None).mapInArrow(run, f"path long, {names[0]} long, {names[1]} int, {names[2]} int, big boolean")


def regions(sets: DataFrame, order: np.ndarray, t: float, hot: int = HOT, depth: int = DEPTH) -> DataFrame:
    """(path, rep, n, place, level, block, other): the regions that each record is replicated to. Regions of more than hot records are
    split by the next shared pivot, depth - 1 times; what is crowded even then by blocks (in_blocks()), so no key has more than about
    2 * hot records. Neither changes the result. Only shingles that the order has as frequent are counted one by one."""
    at = lambda first, last: F.posexplode(F.slice("ord", first, F.greatest(F.lit(0), last - first + 1)))
    whole = (F.lit(0).alias("block"), F.lit(0).alias("other"))
    every = windows_of(sets, order, t, hot=hot)
    count = lambda rows, k: written(rows.groupBy("path").agg(F.count("*").alias("c")).filter(F.col("c") > hot), f"hot-regions-{k}")
    big = windows_of(sets, order, t, hot=hot, only_big=True)
    crowded = count(big, 1)
    if crowded.isEmpty():
        return every.select("path", "rep", "n", "place", F.lit(1).alias("level"), *whole)
    done = [every.join(bounded(crowded), "path", "left_anti").select("path", "rep", "n", "place", F.lit(1).alias("level"), *whole)]
    split = big.join(bounded(crowded), "path").select("path", "rep", "n", "place", "c")
    for level in range(1, depth):
        # Records that may share fewer than level + 1 shingles with a partner meet such partners here.
        done.append(in_blocks(split.filter(need(F.col("n"), t) <= level), level, hot))
        docs = ordered(sets.join(split.select("rep").distinct(), "rep", "left_semi"), order, t, True)
        left = split.select("path", "rep", "place").join(docs, "rep").withColumn("from_", F.col("place") + 1)
        now = left.select("path", "rep", "n", "place", at(F.col("from_"), F.col("take") + level).alias("i", "g")).select(F.xxhash64("path", "g").alias("path"), "rep", "n", (F.col("place") + 1 + F.col("i")).alias("place"))
        now = written(now, f"regions-{level + 1}")
        few = bounded(count(now, level + 1))
        done.append(now.join(few, "path", "left_anti").select("*", F.lit(level + 1).alias("level"), *whole))
        split = now.join(few, "path")
    out = in_blocks(split, depth, hot)
    for d in done:
        out = out.unionByName(d)
    return out


def in_blocks(crowded: DataFrame, level: int, hot: int) -> DataFrame:
    """(path, rep, n, place, c) -> (path, rep, n, place, level, block, other): a region of c records in blocks of about hot; each pair of blocks is a key of its own."""
    k = F.ceil(F.col("c") / hot).cast("int")
    cut = crowded.withColumn("block", F.pmod(F.xxhash64("rep"), k).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), k - 1)))
    return cut.withColumn("path", F.xxhash64("path", F.least("block", "other"), F.greatest("block", "other"))).drop("c").withColumn("level", F.lit(level))


def met(r: DataFrame, t: float) -> DataFrame:
    """(a, b), a < b: the pairs that meet in a region and can still share enough behind it."""
    one = r.select("path", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), "level", "block", "other")
    two = r.select("path", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), F.col("level").alias("level_b"), F.col("block").alias("block_b"))
    here = (F.col("block") != F.col("block_b")) | (F.col("block") == F.col("other"))  # each pair of blocks once
    pairs = one.join(two, "path").filter((F.col("a") < F.col("b")) & here & (F.col("level") == F.col("level_b")) & may_reach(t, F.col("level")))
    return pairs.select("a", "b").distinct()


def may_reach(t: float, met: Column | int = 1) -> Column:
    """Whether records of na and nb shingles that meet at their places pa and pb, as their met-th, may still be similar."""
    most = met + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    return (F.least("na", "nb") >= F.greatest("na", "nb") * t) & (most >= (F.col("na") + F.col("nb")) * (t / (1 + t)) - 1e-9)


def links(sets: DataFrame, t: float, hot: int = HOT, depth: int = DEPTH) -> DataFrame:
    """(a, b, containment, similarity), a < b: all pairs of classes at similarity t or more."""
    return confirmed(met(regions(sets, levels(sets), t, hot, depth), t), sets, sets, t)


def confirmed(pairs: DataFrame, left: DataFrame, right: DataFrame, t: float) -> DataFrame:
    """(a, b, containment of a in b, similarity) of the pairs whose full sets reach t."""
    pairs = written(pairs, "candidates")
    asked = lambda sets, c: sets.join(bounded(pairs.select(F.col(c).alias("rep")).distinct()), "rep", "left_semi")
    x = asked(left, "a").select(F.col("rep").alias("a"), F.col("grams").alias("ga"))
    y = asked(right, "b").select(F.col("rep").alias("b"), F.col("grams").alias("gb"))
    both = F.size(F.array_intersect("ga", "gb"))
    got = pairs.join(x, "a").join(y, "b").select("a", "b", both.alias("both"), F.size("ga").alias("na"), (F.size("ga") + F.size("gb") - both).alias("either"))
    return got.filter(F.col("both") >= F.col("either") * t - 1e-9).select("a", "b", (F.col("both") / F.col("na")).alias("containment"), (F.col("both") / F.col("either")).alias("similarity"))


def expanded(link: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of rows, smaller first, from links of classes and the classes themselves."""
    many = members.groupBy("rep").agg(F.count("*").alias("c")).filter("c > 1")
    all_links = link.select("a", "b").unionByName(many.select(F.col("rep").alias("a"), F.col("rep").alias("b")))
    x = members.select(F.col("rep").alias("a"), F.col("row_id").alias("row_a"))
    y = members.select(F.col("rep").alias("b"), F.col("row_id").alias("row_b"))
    got = all_links.join(x, "a").join(y, "b").filter((F.col("a") != F.col("b")) | (F.col("row_a") < F.col("row_b")))
    return got.select(F.least("row_a", "row_b").alias("row_id_a"), F.greatest("row_a", "row_b").alias("row_id_b"))


SIMILARITY, RUN = 0.5, 3


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "train_v1")
    return t.select("row_id", F.concat(F.coalesce("nl", F.lit("")), F.lit(" "), F.coalesce("mlir", F.lit(""))).alias("text"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, sets = classes(tasks(spark, sf_dir), RUN)
    return expanded(links(sets, SIMILARITY), members)


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of train_v1 with its group (the least row_id that it is linked to, over any number of links), the number of rows
    with its very words and its links to other texts."""
    members, sets = classes(tasks(spark, sf_dir), RUN)
    link = written(links(sets, SIMILARITY), "links")
    groups = components(link.select("a", "b"))
    ends = link.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    per_class = members.groupBy("rep").agg(F.count("*").alias("copies")).join(groups.select(F.col("id").alias("rep"), "component"), "rep", "left").join(ends, "rep", "left")
    every = table(spark, sf_dir, "train_v1").select("row_id")
    got = every.join(members, "row_id", "left").join(per_class, "rep", "left")
    return got.select("row_id", F.coalesce("component", "rep", "row_id").alias("group_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


SQL = {
    "p1_found": r"""
  WITH t AS (SELECT row_id, regexp_extract_all(lower(coalesce(nl, '') || ' ' || coalesce(mlir, '')), '[a-z0-9_]+') AS w FROM train_v1),
  g AS (SELECT DISTINCT row_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT row_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
  n AS (SELECT row_id, count(*) AS n FROM g GROUP BY row_id),
  p AS (SELECT a.row_id AS x, b.row_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.row_id < b.row_id GROUP BY 1, 2)
  SELECT x AS row_id_a, y AS row_id_b FROM p JOIN n a ON a.row_id = x JOIN n b ON b.row_id = y WHERE c * 2 >= a.n + b.n - c""",
    # Group and links of each row: the classes of equal word lists, their pairs, and what a class reaches over pairs.
    "p1_groups": r"""
  WITH RECURSIVE t AS (SELECT row_id, regexp_extract_all(lower(coalesce(nl, '') || ' ' || coalesce(mlir, '')), '[a-z0-9_]+') AS w FROM train_v1),
  m AS (SELECT row_id, w, min(row_id) OVER (PARTITION BY w) AS rep, count(*) OVER (PARTITION BY w) AS copies FROM t WHERE len(w) >= 3),
  g AS (SELECT DISTINCT row_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT row_id, w, unnest(range(1, len(w) - 1)) AS i FROM m WHERE row_id = rep)),
  n AS (SELECT row_id, count(*) AS n FROM g GROUP BY row_id),
  p AS (SELECT a.row_id AS x, b.row_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.row_id < b.row_id GROUP BY 1, 2),
  e AS (SELECT x, y FROM p JOIN n a ON a.row_id = x JOIN n b ON b.row_id = y WHERE c * 2 >= a.n + b.n - c),
  f AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
  r AS (SELECT DISTINCT x, x AS y FROM f UNION SELECT r.x, f.y FROM r JOIN f ON f.x = r.y),
  c AS (SELECT x AS rep, min(y) AS component FROM r GROUP BY x), d AS (SELECT x AS rep, count(*) AS n_links FROM f GROUP BY x)
  SELECT t.row_id, coalesce(component, m.rep, t.row_id) AS group_id, coalesce(copies, 1) AS n_copies, coalesce(n_links, 0) AS n_links FROM t LEFT JOIN m USING (row_id) LEFT JOIN c USING (rep) LEFT JOIN d USING (rep)""",
}
