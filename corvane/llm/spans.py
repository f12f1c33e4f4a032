"""Problem 3: long exact spans shared between records, by super-k-mers.

Windows of K code points are cut into runs that share a minimiser (an M-gram); a run is a super-k-mer. Two rows can share a
window only if they share its minimiser, so:
1. one pass over the texts gives each super-k-mer's place, its minimiser's hash and its own hash, and no text;
2. minimisers of one row only drop out (pre-aggregated); equal super-k-mers of two rows settle all their windows at once;
3. of the rest, one exemplar per distinct super-k-mer travels as one packed string to its minimiser's bucket, where all windows
   are sorted by hash and counted; windows that fall together are compared code point by code point;
4. buckets of more than HOT distinct strings would burden one task: they are split by their windows, which are grouped as text,
   with partial aggregation. The result is the same at any HOT.
The flags go back to all occurrences and are merged into spans per row.

Null texts and texts shorter than K have no span. Rows that repeat a row_id are one record. Texts of any length are handled whole.
Runs with equal (minimiser, run) hashes, 128 bits together, are taken as equal; windows are compared code point by code point.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.merkle import programs
from corvane.llm.windows import Stretch, blocks, cut_long, minimised, signed
from corvane.store import written

K, M, HOT = 120, 32, 20_000
RUNS = "row_id long, start int, n_win int, mz long, sk long"


def super_kmers(texts: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """(row_id, text) -> (row_id, start, n_win, mz, sk), one row per super-k-mer."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            whole, at, parts = cut_long(b.column(1).to_pylist(), k)
            for first, codes, edges in blocks(parts):
                owner, starts, runs, place, s = minimised(codes, edges, m, k - m + 1)
                if len(starts):
                    i = first + owner
                    yield pa.record_batch([pa.array(ids[whole[i]]), pa.array((starts - edges[owner] + at[i]).astype(np.int32)), pa.array(runs.astype(np.int32)), pa.array(signed(s.of(place, place + m))), pa.array(signed(s.of(starts, starts + runs + k - 1)))], ["row_id", "start", "n_win", "mz", "sk"])

    long_enough = texts.filter(F.length("text") >= k).select(F.col("row_id").cast("long"), "text")
    return long_enough.mapInArrow(run, RUNS)


def _flag_runs(flags: np.ndarray, run_of: np.ndarray, j: np.ndarray):
    """Stretches of flagged consecutive windows: (run, first window, last window)."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at, at
    cut = np.r_[True, (run_of[at[1:]] != run_of[at[:-1]]) | (j[at[1:]] != j[at[:-1]] + 1)]
    ends = np.r_[np.flatnonzero(cut)[1:] - 1, len(at) - 1]
    return run_of[at[cut]], j[at[cut]], j[at[ends]]


def count_bucket(strings: list[str], lo: np.ndarray, hi: np.ndarray, k: int):
    """Of the packed strings of whole buckets, the windows met in two rows: (string, first window, last window)."""
    codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    edges = np.cumsum([0, *map(len, strings)])
    wins = np.diff(edges) - k + 1
    run_of = np.repeat(np.arange(len(strings)), wins)
    j = np.arange(len(run_of)) - np.repeat(np.cumsum(wins) - wins, wins)
    at = edges[:-1][run_of] + j
    h = Stretch(codes).of(at, at + k)
    order = np.argsort(h, kind="stable")
    hs = h[order]
    new = np.r_[True, hs[1:] != hs[:-1]]
    starts = np.flatnonzero(new)
    low, high = np.minimum.reduceat(lo[run_of[order]], starts), np.maximum.reduceat(hi[run_of[order]], starts)
    group = np.cumsum(new) - 1
    shared = (low < high)[group]
    # Windows that fell together are compared in full with the first of their group.
    pick = np.flatnonzero(shared & ~new)
    for c in range(0, len(pick), 20_000):
        p = pick[c : c + 20_000]
        a, b = at[order[p]], at[order[starts[group[p]]]]
        span = np.arange(k)
        bad = (codes[a[:, None] + span] != codes[b[:, None] + span]).any(1)
        for g in np.unique(group[p[bad]]):  # different windows of one hash: settled by their text
            seen: dict[bytes, list[int]] = {}
            members = np.flatnonzero(group == g)
            for x in members:
                seen.setdefault(codes[at[order[x]] : at[order[x]] + k].tobytes(), []).append(x)
            for same in seen.values():
                rows = run_of[order[same]]
                shared[same] = lo[rows].min() < hi[rows].max()
    flags = np.zeros(len(run_of), bool)
    flags[order] = shared
    return _flag_runs(flags, run_of, j)


def counted(packed: DataFrame, k: int) -> DataFrame:
    """(mz, sk, lo, hi, s), sorted by mz within partitions that hold whole buckets -> (mz, sk, w0, w1)."""

    def run(batches):
        held = None
        for b in batches:
            t = b.to_pandas()
            held = t if held is None else pd.concat([held, t], ignore_index=True)
            if len(held) < 2_000:
                continue
            last = held["mz"].iloc[-1]
            whole = held[held["mz"] != last]
            if len(whole):
                yield from out(whole)
                held = held[held["mz"] == last]
        if held is not None and len(held):
            yield from out(held)

    def out(t):
        run_i, w0, w1 = count_bucket(t["s"].tolist(), t["lo"].to_numpy(), t["hi"].to_numpy(), k)
        yield pa.record_batch([pa.array(t["mz"].to_numpy()[run_i]), pa.array(t["sk"].to_numpy()[run_i]), pa.array(w0.astype(np.int32)), pa.array(w1.astype(np.int32))], ["mz", "sk", "w0", "w1"])

    return packed.repartition("mz").sortWithinPartitions("mz").mapInArrow(run, "mz long, sk long, w0 int, w1 int")


def counted_by_window(packed: DataFrame, k: int) -> DataFrame:
    """The same for hot buckets, split by the window itself: each window is a group of its own, compared as text and partially
    aggregated before the shuffle."""

    def run(batches):
        for b in batches:
            t = b.to_pandas()
            for i, s in enumerate(t["s"]):
                n = len(s) - k + 1
                yield pa.record_batch([pa.array([t[c][i]] * n, pa.int64()) for c in ("mz", "sk", "lo", "hi")] + [pa.array(np.arange(n, dtype=np.int32)), pa.array([s[j : j + k] for j in range(n)], pa.string())], ["mz", "sk", "lo", "hi", "w", "window"])

    wins = packed.mapInArrow(run, "mz long, sk long, lo long, hi long, w int, window string")
    shared = wins.groupBy("window").agg(F.min("lo").alias("a"), F.max("hi").alias("b")).filter("a < b").select("window")
    return wins.join(shared, "window").select("mz", "sk", F.col("w").alias("w0"), F.col("w").alias("w1"))


def shared_spans(texts: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """(row_id, text) -> (row_id, a, b): stretches [a, b) of each row all of whose windows also stand in another row."""
    runs = written(super_kmers(texts, k, m), "super-kmers")
    multi = runs.groupBy("mz").agg(F.min("row_id").alias("lo"), F.max("row_id").alias("hi")).filter("lo < hi").select("mz")
    live = written(runs.join(multi, "mz"), "live-super-kmers")
    first = F.min(F.struct("row_id", "start", "n_win")).alias("x")
    distinct = live.groupBy("mz", "sk").agg(F.min("row_id").alias("lo"), F.max("row_id").alias("hi"), first)
    buckets = distinct.groupBy("mz").agg(F.count("*").alias("n_sk"), F.min("lo").alias("all_lo"), F.max("hi").alias("all_hi"))
    asked = written(distinct.join(buckets.filter("n_sk > 1"), "mz"), "asked-super-kmers")
    # The exemplars' strings: one visit to each text that holds some.
    wanted = asked.groupBy(F.col("x.row_id").alias("row_id")).agg(F.collect_list(F.struct("mz", "sk", "lo", "hi", "n_sk", F.col("x.start").alias("start"), F.col("x.n_win").alias("n_win"))).alias("w"))
    one = texts.filter(F.length("text") >= k).select(F.col("row_id").cast("long").alias("row_id"), "text")
    cut = wanted.join(one, "row_id").select("text", F.explode("w").alias("w")).select("w.mz", "w.sk", "w.lo", "w.hi", "w.n_sk", F.substring("text", F.col("w.start") + 1, F.col("w.n_win") + (k - 1)).alias("s"))
    packed = cut.repartition("mz").dropDuplicates(["mz", "sk"])  # one exchange: by bucket
    if asked.filter(F.col("n_sk") > HOT).isEmpty():
        hits = counted(packed.drop("n_sk"), k)
    else:
        packed = written(packed, "packed-super-kmers")
        hits = counted(packed.filter(F.col("n_sk") <= HOT).drop("n_sk"), k).unionByName(counted_by_window(packed.filter(F.col("n_sk") > HOT).drop("n_sk"), k))
    hits = written(hits, "shared-windows")
    whole = live.join(distinct.filter("lo < hi").select("mz", "sk"), ["mz", "sk"]).select("row_id", F.col("start").alias("a"), (F.col("start") + F.col("n_win") + (k - 1)).alias("b"))
    partly = live.join(hits.join(distinct.filter("lo < hi").select("mz", "sk"), ["mz", "sk"], "left_anti"), ["mz", "sk"]).select("row_id", (F.col("start") + F.col("w0")).alias("a"), (F.col("start") + F.col("w1") + k).alias("b"))
    return whole.unionByName(partly)


def coverage(texts: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """(row_id, n_spans, n_shared) of each row with a shared span; spans that touch or overlap are one. A row's spans are bounded by its text."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("covered"), F.lit(-1).alias("end"))

    def add(acc, s):
        return F.struct(
            F.when(s["a"] > acc["end"], acc["n"] + 1).otherwise(acc["n"]).alias("n"),
            (acc["covered"] + F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], acc["end"]))).cast("long").alias("covered"),
            F.greatest(acc["end"], s["b"]).alias("end"),
        )

    per_row = shared_spans(texts, k, m).groupBy("row_id").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans"))
    folded = per_row.select("row_id", F.aggregate("spans", start, add).alias("f"))
    return folded.select("row_id", F.col("f.n").alias("n_spans"), F.col("f.covered").alias("n_shared"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(programs(spark, sf_dir)).select("row_id").distinct()


def p3_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every row with a text: its length, the code points that also stand in another row, their share and the number of spans."""
    texts = programs(spark, sf_dir)
    base = texts.filter("text is not null").select("row_id", F.length("text").alias("n_chars"))
    got = base.join(coverage(texts), "row_id", "left").na.fill(0, ["n_spans", "n_shared"])
    return got.select("row_id", "n_chars", "n_spans", "n_shared", F.when(F.col("n_chars") > 0, F.col("n_shared") / F.col("n_chars")).otherwise(0.0).alias("share"))


# All windows as strings: for small tables.
_WINDOWS = f"""
  WITH t AS (SELECT row_id, mlir AS t FROM train_v1 UNION ALL SELECT row_id, generated FROM ladder),
  w AS (SELECT row_id, i, substr(t, i, {K}) AS s FROM (SELECT row_id, t, unnest(range(1, length(t) - {K - 2})) AS i FROM t)),
  m AS (SELECT s FROM w GROUP BY s HAVING min(row_id) < max(row_id))"""
SQL = {
    "p3_found": f"{_WINDOWS} SELECT DISTINCT row_id FROM w SEMI JOIN m USING (s)",
    # A span ends where no shared window begins within or right behind it.
    "p3_coverage": f"""{_WINDOWS}, f AS (SELECT row_id, i, (i > lag(i) OVER (PARTITION BY row_id ORDER BY i) + {K}) IS NOT FALSE AS new FROM w SEMI JOIN m USING (s)),
  n AS (SELECT row_id, i, count(*) FILTER (new) OVER (PARTITION BY row_id ORDER BY i) AS span FROM f), p AS (SELECT row_id, span, max(i) - min(i) + {K} AS c FROM n GROUP BY 1, 2),
  c AS (SELECT row_id, count(*) AS n_spans, sum(c)::BIGINT AS n_shared FROM p GROUP BY 1)
  SELECT row_id, length(t)::INT AS n_chars, coalesce(n_spans, 0)::INT AS n_spans, coalesce(n_shared, 0) AS n_shared, CASE WHEN length(t) > 0 THEN coalesce(n_shared, 0) / length(t) ELSE 0.0 END AS share FROM t LEFT JOIN c USING (row_id) WHERE t IS NOT NULL""",
}
