"""Decontamination and deduplication of a candidate pool against protected records."""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import norm_mlir, norm_nl, word_grams
from corvane.store import bounded, written


def first_wins(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """rows with first: whether the row is the earliest of its key. The key is pre-aggregated, so no key is one task."""
    keyed = rows.withColumn("_k", key)
    firsts = keyed.groupBy("_k").agg(F.min(order).alias("_first"))
    return keyed.join(firsts, keyed["_k"].eqNullSafe(firsts["_k"])).select(*rows.columns, (F.col(order) == F.col("_first")).alias("first"))


def decontaminated(candidates: DataFrame, protected: DataFrame, n: int = 8) -> DataFrame:
    """candidates (pos, nl, mlir), protected (nl, mlir) -> (pos, reason): the first rule that drops a candidate, or 'kept'.

    Only survivors of the three rules against protected records can occupy a prompt in the pool. Null texts count as empty;
    empty protected texts protect nothing. pos is the input order and is unique.

    Protected texts and their n-grams are sent to the candidates where they are few (store.bounded). The candidates' texts are normalised
    once, into a narrow table of digests and verdicts, from which the rest is told."""
    p = protected.select(F.coalesce("nl", F.lit("")).alias("nl"), F.coalesce("mlir", F.lit("")).alias("mlir"))
    p_nl = written(p.filter("nl <> ''").select(norm_nl(F.col("nl")).alias("nl")).distinct(), "protected-nl")
    p_mlir = written(p.filter("mlir <> ''").select(F.md5(norm_mlir(F.col("mlir"))).alias("mlir_d")).distinct().withColumn("by_mlir", F.lit(True)), "protected-mlir")
    p_gram = written(p_nl.select(F.explode(word_grams(F.col("nl"), n)).alias("g")).distinct(), "protected-grams")
    c = candidates.select("pos", norm_nl(F.coalesce("nl", F.lit(""))).alias("nl"), F.md5(norm_mlir(F.coalesce("mlir", F.lit("")))).alias("mlir_d"))
    c = c.select("pos", "mlir_d", F.md5("nl").alias("nl_d"), word_grams(F.col("nl"), n).alias("gs"))
    told = c.join(bounded(p_nl.select(F.md5("nl").alias("nl_d"), F.lit(True).alias("by_nl"))), "nl_d", "left").join(bounded(p_mlir), "mlir_d", "left")
    told = written(told.select("pos", "nl_d", "by_nl", "by_mlir", F.when(F.col("by_nl").isNull() & F.col("by_mlir").isNull(), F.col("gs")).alias("gs")), "told")
    hit = told.select("pos", F.explode("gs").alias("g")).join(bounded(p_gram), "g", "left_semi").select("pos", F.lit(True).alias("by_gram")).distinct()
    reason = F.when(F.col("by_nl"), "exact_nl_vs_protected").when(F.col("by_mlir"), "exact_mlir_vs_protected").when(F.col("by_gram"), f"nl_{n}gram_overlap_vs_protected")
    ruled = written(told.drop("gs").join(bounded(written(hit, "gram-hits")), "pos", "left").select("pos", "nl_d", reason.alias("reason")), "ruled")
    first = ruled.filter("reason is null").groupBy("nl_d").agg(F.min("pos").alias("first_pos"))
    free = ruled.filter("reason is null").join(first, "nl_d").select("pos", F.when(F.col("pos") == F.col("first_pos"), "kept").otherwise("dup_nl_within_pool").alias("reason"))
    return ruled.filter("reason is not null").select("pos", "reason").unionByName(free)


def report(ruled: DataFrame) -> DataFrame:
    return ruled.groupBy("reason").agg(F.count("*").alias("n"))


#: Sides of gram_rows.
GIVEN, ASKED, COUNT = 0, 1, 2

#: Leading bits of a hash: those that name its bucket, those that are its place in marks(), those that are moved to see whether both sides hold it.
BUCKET, PLACE, MOVED = 10, 27, 36

#: Grams whose hashes marks() packs together.
PACKED = 1 << 21


def hashes(texts: list[str], n: int, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of the texts' runs of n tokens, and the place of each one's text. known: the tokens' codes, for the next call."""
    t = [re.findall(r"\w+|[^\w\s]", x, re.A) for x in texts]
    if len(known) > 1 << 20:
        known.clear()
    for w in set(chain.from_iterable(t)).difference(known):
        known[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    of = np.repeat(np.arange(len(t)), [len(x) for x in t])
    codes = np.fromiter(map(known.__getitem__, chain.from_iterable(t)), np.uint64, len(of))
    h = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    for k in range(n):
        h = (h ^ codes[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    whole = of[: len(h)] == of[n - 1 :]
    return of[: len(h)][whole], h[whole]


def held(batches, column: int):
    """(batch, first row, texts): the texts of Arrow batches, about 2^19 characters at a time."""
    for b in batches:
        at, size, texts = 0, 0, b.column(column).to_pylist()
        for i, text in enumerate(texts):
            size += len(text)
            if size > 1 << 19 or i + 1 == len(texts):
                yield b, at, texts[at : i + 1]
                at, size = i + 1, 0


def once(x: np.ndarray) -> np.ndarray:
    """x sorted, equal values once. np.unique() finds integers by a hash table, which takes many times as long."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])[: len(x)]]


def marks(asked: DataFrame, given: DataFrame, n: int) -> np.ndarray:
    """asked, given (text) -> 2^PLACE bits: 0 where no gram of that place is on both sides.

    Only the leading bits of the hashes are moved, as packed differences, without ids; so what one side alone holds costs some two bytes
    a gram. A bit may be 1 without cause, at any size, and never 0."""
    low, base = np.uint64(64 - MOVED), np.arange((1 << BUCKET) + 1, dtype=np.uint64) << np.uint64(MOVED - BUCKET)

    def packed(side: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        h = once(np.concatenate(parts))
        cut, rows = np.searchsorted(h, base), []
        for i in np.flatnonzero(np.diff(cut)).tolist():
            d = np.diff(h[cut[i] : cut[i + 1]], prepend=base[i])
            high = pa.compress((d >> np.uint64(16)).astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes(), "zstd", asbytes=True)
            rows.append((i, len(d), (d & np.uint64(0xFFFF)).astype("<u2").tobytes() + high))
        k, size, data = zip(*rows)
        return pa.record_batch([pa.array(k, pa.int32()), pa.array([side] * len(k), pa.int8()), pa.array(size, pa.int32()), pa.array(data, pa.binary())], ["bucket", "side", "size", "packed"])

    def told(side: int):
        def run(batches):
            known, parts, size = {}, [], 0
            for _, _, texts in held(batches, 0):
                parts.append(hashes(texts, n, known)[1] >> low)
                size += len(parts[-1])
                if size > PACKED:
                    yield packed(side, parts)
                    parts, size = [], 0
            if size:
                yield packed(side, parts)

        return run

    def unpacked(size: int, data: bytes) -> np.ndarray:
        high = np.frombuffer(pa.decompress(data[2 * size :], decompressed_size=2 * size, codec="zstd", asbytes=True), np.uint8).reshape(2, -1).astype(np.uint64)
        return np.cumsum(np.frombuffer(data, "<u2", size).astype(np.uint64) | (high[0] << np.uint64(16)) | (high[1] << np.uint64(24)), dtype=np.uint64)

    def both(rows: pa.Table) -> pa.Table:
        sides: list[list[np.ndarray]] = [[], []]
        for side, size, data in zip(*(rows[c].to_pylist() for c in ("side", "size", "packed"))):
            sides[side].append(unpacked(size, data))
        common = np.intersect1d(*(once(np.concatenate(x)) for x in sides), assume_unique=True) if all(sides) else np.zeros(0, np.uint64)
        bits = np.zeros(1 << (PLACE - BUCKET), np.uint8)
        bits[(common >> np.uint64(MOVED - PLACE)).astype(np.int64)] = 1
        k = 1 if len(common) else 0
        return pa.table({"bucket": rows["bucket"][:k], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()][:k], pa.binary())})

    schema = "bucket int, side byte, size int, packed binary"
    rows = asked.select("text").mapInArrow(told(ASKED), schema).unionByName(given.select("text").mapInArrow(told(GIVEN), schema))
    out = np.zeros(1 << (PLACE - 3), np.uint8)
    for r in rows.groupBy("bucket").applyInArrow(both, "bucket int, bits binary").collect():  # a row for each bucket, 2^PLACE bits in all
        step = len(r.bits)
        out[r.bucket * step : (r.bucket + 1) * step] = np.frombuffer(r.bits, np.uint8)
    return out


def gram_rows(rows: DataFrame, n: int, side: int, marked: Broadcast) -> DataFrame:
    """(id, text) -> (side, id, g): the distinct 64-bit hashes of each text's runs of n tokens that are marked. ASKED: and a row COUNT of each
    text with the number of all its distinct ones."""

    def batch(kind: int, ids: np.ndarray, g: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.full(len(ids), kind, np.int8)), pa.array(ids), pa.array(g)], ["side", "id", "g"])

    def likely(of: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = (h >> np.uint64(64 - PLACE)).astype(np.int64)
        keep = (marked.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
        return of[keep], h[keep]

    def distinct(of: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        o = np.lexsort((h, of))
        of, h = of[o], h[o]
        new = np.append(True, (of[1:] != of[:-1]) | (h[1:] != h[:-1]))[: len(h)]
        return of[new], h[new]

    def run(batches):
        known: dict[str, int] = {}
        for b, at, texts in held(batches, 1):
            ids, (of, h) = b.column(0).to_numpy(zero_copy_only=False)[at : at + len(texts)], hashes(texts, n, known)
            if side == ASKED:
                of, h = distinct(of, h)
                yield batch(COUNT, ids, np.bincount(of, minlength=len(ids)))
                of, h = likely(of, h)
            else:
                of, h = distinct(*likely(of, h))
            yield batch(side, ids[of], h.view(np.int64))

    return rows.select(F.col("id").cast("long"), "text").mapInArrow(run, "side byte, id long, g long")


def in_both(rows: DataFrame) -> DataFrame:
    """rows (side, id, g), GIVEN or ASKED, whose g is on both sides. Each is moved once, with its id; what one side alone holds ends here."""
    w = Window.partitionBy("g")
    return rows.withColumn("least", F.min("side").over(w)).withColumn("most", F.max("side").over(w)).filter(F.col("least") < F.col("most")).select("side", "id", "g")


#: Pairs of sets that a level of shared_most() counts, at least, and for each gram that is asked; and pairs and grams of theirs that are held at once.
PAIRS, PAIRS_PER_GRAM, ROOM = 1 << 20, 4, 1 << 20

#: Cells of most_shared() that either side is split into, at least, and grams of a side that a cell has, about.
CELLS, CELL = 4, 1 << 22


class Sets:
    """Sets of numbered grams: g[at[i] : at[i + 1]] is the i-th, sorted."""

    def __init__(self, of: np.ndarray, g: np.ndarray, n: int):
        """of: the set of each gram, sorted."""
        self.of, self.g, self.n, self.sizes = of, g, n, np.bincount(of, minlength=n)
        self.at = np.append(0, np.cumsum(self.sizes))

    def only(self, keep: np.ndarray) -> Sets:
        """The same sets with these grams only."""
        return Sets(self.of[keep], self.g[keep], self.n)

    def once(self) -> tuple[Sets, np.ndarray]:
        """Equal sets as one, and which one each is now."""
        data, ends, seen = self.g.astype(np.int32).tobytes(), (4 * self.at).tolist(), {}
        now = np.array([seen.setdefault(data[x:y], len(seen)) for x, y in zip(ends, ends[1:])], np.int64)
        first = np.zeros(self.n, bool)
        first[np.unique(now, return_index=True)[1]] = True
        keep = first[self.of]
        return Sets(now[self.of[keep]], self.g[keep], len(seen)), now


def runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def pieces(size: np.ndarray):
    """(x, y): ranges of rows of about ROOM together, or one row."""
    total, x = np.cumsum(size), 0
    while x < len(size):
        y = max(x + 1, int(np.searchsorted(total, (total[x - 1] if x else 0) + ROOM, "right")))
        yield x, y
        x = y


def met(a: Sets, rare: np.ndarray, start: np.ndarray, nt: np.ndarray, owner: np.ndarray, n: int):
    """(asked, given, count): the pairs of sets that meet in a rare gram and in how many, all pairs of an asked set together. owner[start[g] :]
    are the nt[g] given sets that hold g; n is their number."""
    e = np.flatnonzero(rare[a.g])
    of, g = a.of[e], a.g[e]
    cut = np.append(0, np.cumsum(np.bincount(of, minlength=a.n)))
    total = np.append(0, np.cumsum(nt[g]))
    for x, y in pieces(total[cut[1:]] - total[cut[:-1]]):
        count = np.zeros(n, np.int64)  # for a set with more than fit
        for u, v in pieces(nt[g[cut[x] : cut[y]]]):
            gs = g[cut[x] + u : cut[x] + v]
            t = owner[runs(start[gs], nt[gs])]
            if y == x + 1:
                count += np.bincount(t, minlength=n)
            else:
                pair, c = np.unique(np.repeat(of[cut[x] + u : cut[x] + v], nt[gs]) * n + t, return_counts=True)
                yield pair // n, pair % n, c
        if y == x + 1 and cut[x] < cut[y]:
            t = np.flatnonzero(count)
            yield np.full(len(t), x), t, count[t]


def shared_most(a: Sets, t: Sets, n_grams: int, pairs: int, per_gram: int) -> np.ndarray:
    """The most grams that each set of a shares with one set of t.

    In levels. Pairs that meet in a gram which few given sets hold are counted in full. Then these grams are taken out of all sets, which
    changes nothing for pairs that haven't met, and sets that have become equal are one: so what nearly all sets hold is left in few sets
    when it's followed. An asked set is done once what is left of it can't beat its best."""
    best = np.zeros(a.n, np.int64)
    a, link = a.once()
    while True:
        asking = np.zeros(a.n, bool)
        asking[link[a.sizes[link] > best]] = True
        a = a.only(asking[a.of])
        if not len(a.g):
            return best
        na = np.bincount(a.g, minlength=n_grams)
        t = t.only(na[t.g] > 0).once()[0]
        nt = np.bincount(t.g, minlength=n_grams)
        a = a.only(nt[a.g] > 0)
        na = np.where(nt > 0, na, 0)
        # A step for each power of two.
        k = np.ceil(np.log2(np.maximum(nt, 1))).astype(np.int64)
        work, limit, room = np.bincount(k, na * nt), 0, max(pairs, per_gram * int(na.sum()))
        for step in np.unique(k[na > 0]).tolist():
            room -= work[step]
            if limit and room < 0:
                break
            limit = 1 << step
        rare = nt <= limit
        hot_a, hot_t = a.only(~rare[a.g]), t.only(~rare[t.g])
        keys, more = hot_a.of * n_grams + hot_a.g, np.zeros(a.n, np.int64)
        for i, j, c in met(a, rare, np.cumsum(nt) - nt, nt, t.of[np.argsort(t.g, kind="stable")], t.n):
            np.maximum.at(more, i, c)
            open_ = c + np.minimum(hot_a.sizes[i], hot_t.sizes[j]) > more[i]
            i, j, c = i[open_], j[open_], c[open_]
            for x, y in pieces(hot_t.sizes[j]):
                size = hot_t.sizes[j[x:y]]
                key = np.repeat(i[x:y], size) * n_grams + hot_t.g[runs(hot_t.at[j[x:y]], size)]
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                np.maximum.at(more, i[x:y], c[x:y] + np.bincount(np.repeat(np.arange(y - x), size), keys[at] == key, y - x).astype(np.int64))
        best = np.maximum(best, more[link])
        a, now = hot_a.once()
        t, link = hot_t, now[link]


def most_shared(asked: DataFrame, given: DataFrame, pairs: int = PAIRS, per_gram: int = PAIRS_PER_GRAM) -> DataFrame:
    """asked (key, grams) and given (gid, grams) -> (key, best): the most grams that an asked set shares with one given set, if any.

    Equal sets are one. Both sides are split by hash, and each part of one meets each part of the other in a cell, where shared_most() counts:
    so sets are moved once for each part of the other side, and never for a pair."""
    digest = lambda g: F.md5(F.array_join(F.transform(g, lambda x: x.cast("string")), ","))
    known = written(asked.select("key", F.sort_array(F.array_distinct("grams")).alias("of")).withColumn("d", digest(F.col("of"))), "known")
    first = written(known.groupBy("d").agg(F.min("key").alias("same"), F.first("of").alias("of")), "known-sets")
    sets = written(given.select(F.sort_array(F.array_distinct("grams")).alias("of")).distinct(), "given-sets")
    parts = lambda x: max(CELLS, -(-(x.agg(F.sum(F.size("of"))).first()[0] or 0) // CELL))
    n_a, n_t = parts(first), parts(sets)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = first.select(F.pmod(F.xxhash64("d"), F.lit(n_a)).cast("int").alias("i"), each(n_t).alias("j"), "same", "of")
    t = sets.select(F.pmod(F.xxhash64("of"), F.lit(n_t)).cast("int").alias("j"), each(n_a).alias("i"), F.lit(None).cast(first.schema["same"].dataType).alias("same"), "of")

    def cell(rows: pa.Table) -> pa.Table:
        def of(x: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            sizes = pa.compute.list_value_length(x["of"]).to_numpy()
            return np.repeat(np.arange(len(sizes)), sizes), pa.compute.list_flatten(x["of"]).to_numpy()

        told = pa.compute.is_valid(rows["same"])
        a, t = rows.filter(told), rows.filter(pa.compute.invert(told))
        (of_a, g_a), (of_t, g_t) = of(a), of(t)
        names, g_t = np.unique(g_t, return_inverse=True)
        if not len(names):
            return pa.table({"same": a["same"][:0], "best": pa.array([], pa.int32())})
        at = np.minimum(np.searchsorted(names, g_a), len(names) - 1)
        here = names[at] == g_a
        best = shared_most(Sets(of_a[here], at[here], len(a)), Sets(of_t, g_t, len(t)), len(names), pairs, per_gram)
        return pa.table({"same": a["same"], "best": pa.array(best, pa.int32())}).filter(pa.array(best > 0))

    rows = a.unionByName(t).select((F.col("i") * n_t + F.col("j")).alias("cell"), "same", "of").repartition(n_a * n_t, "cell")
    got = rows.groupBy("cell").applyInArrow(cell, first.select("same", F.lit(0).alias("best")).schema)
    best = written(got.groupBy("same").agg(F.max("best").alias("best")), "best")
    return known.select("key", "d").join(first.select("d", "same"), "d").join(best, "same").select("key", "best")


def memorized(gens: DataFrame, golds: DataFrame, n: int = 8) -> DataFrame:
    """gens (id, text), golds (gold_id, text) -> (id, n_grams, best, exact): the most token n-grams shared with one gold, as a share.

    Ids are unique. Grams are compared by 64-bit hashes. Those of one side alone are dropped first: nearly all by marks(), before any
    is moved with its id. An exact copy is told by a digest of the squeezed text. Texts of fewer than n tokens have no grams and are 0."""
    squeeze = lambda s: F.md5(F.trim(F.regexp_replace(s, r"\s+", " ")))
    gens, golds = gens.filter("text is not null"), golds.filter("text is not null")
    marked = gens.sparkSession.sparkContext.broadcast(marks(gens, golds, n))
    rows = written(gram_rows(gens, n, ASKED, marked).unionByName(gram_rows(golds.select(F.col("gold_id").alias("id"), "text"), n, GIVEN, marked)), "likely-grams")
    marked.unpersist()
    shared = written(in_both(rows.filter(F.col("side") != COUNT)), "shared-grams")
    of = lambda side, name: shared.filter(F.col("side") == side).groupBy(F.col("id").alias(name)).agg(F.collect_list("g").alias("grams"))
    best = most_shared(of(ASKED, "key"), of(GIVEN, "gid")).withColumnRenamed("key", "id")
    exact = bounded(written(golds.select(squeeze(F.col("text")).alias("s")).distinct(), "gold-digests"))
    same = gens.select("id", squeeze(F.col("text")).alias("s")).join(exact, "s", "left_semi").select("id", F.lit(True).alias("exact"))
    g = rows.filter(F.col("side") == COUNT).select("id", F.col("g").cast("int").alias("n_grams"))
    out = g.join(best, "id", "left").join(same, "id", "left")
    return out.select("id", "n_grams", F.when(F.col("n_grams") > 0, F.coalesce("best", F.lit(0)) / F.col("n_grams")).otherwise(0.0).alias("best"), (F.coalesce("exact", F.lit(False)) & (F.col("n_grams") > 0)).alias("exact"))
