"""Problem 5: evaluation records that are also in the training split.

A pair counts if (a) the canonical programs agree, (b) the word-run sets of the programs reach the similarity, or (c) the letters and
digits of the question stand in one piece in those of the training program.
(a) is an equi-join on a digest of the renamed token sequence; the programs of equal digests are compared themselves.
(b) The evaluation records' n-gram hashes are partitioned, those that can't all be missing at the similarity: the rarest by their
frequency in training. Training is scanned for hits; a table of fixed size tells at once which hashes nobody asked for. What two
records can share behind a hit bounds them, and the containment of the evaluation record in the training record, and the similarity,
are computed in full for the rest (metric_join.confirmed).
(c) follows each question's least character-gram, which any text that holds the question has among its minimisers, and confirms by the
text itself; questions shorter than one window are asked for by their first characters, at every place, in the same scan.
Copies within a split are collapsed before and expanded after. Null or empty programs and questions are in no pair by that rule.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.metric_join import asked_places, classes, confirmed, is_asked, levels, may_reach, windows_of
from corvane.llm.windows import Stretch, blocks, cut_long, minimised, signed
from corvane.store import bounded, table, written

SIMILARITY, RUN = 0.5, 3
GRAM, WINDOW = 16, 32

_COMMENT = re.compile(r"//[^\n\r]*")
_TOKEN = re.compile(r"[%@][\w$.-]+|\w+|[^\s\w]", re.A)


def canonical_program(text: str) -> str:
    """Tokens without comments, layout and case; functions are @F, values numbered by first occurrence. For text in lower case."""
    number: dict[str, str] = {}
    out = []
    for x in _TOKEN.findall(_COMMENT.sub("", text)):
        if len(x) > 1 and x[0] == "%":
            x = number.setdefault(x, f"%{len(number) + 1}")
        elif len(x) > 1 and x[0] == "@":
            x = "@f"
        out.append(x)
    return " ".join(out)


def canonical(rows: DataFrame, name: str, whole: bool = False) -> DataFrame:
    """(row_id, mlir) -> (name, d), a digest of each canonical program that isn't empty; with whole, the program in its place."""

    def run(batches):
        for b in batches:
            texts = [canonical_program(x) for x in b.column(1).to_pylist()]
            at = [i for i, x in enumerate(texts) if x]
            d = [texts[i].encode() if whole else hashlib.blake2b(texts[i].encode(), digest_size=16).digest() for i in at]
            yield pa.record_batch([b.column(0).take(pa.array(at, pa.int64())), pa.array(d, pa.binary())], [name, "d"])

    return rows.filter("mlir is not null").select(F.col("row_id").cast("long"), F.lower("mlir").alias("mlir")).mapInArrow(run, f"{name} long, d binary")


def same_program(ev: DataFrame, tr: DataFrame) -> DataFrame:
    """(dev, train) of (row_id, mlir) with equal canonical programs; digests first, then the programs of those that agree."""
    hits = written(canonical(ev, "dev").join(canonical(tr, "train"), "d").select("dev", "train"), "same-digest")
    only = lambda rows, name: rows.join(bounded(hits.select(F.col(name).alias("row_id")).distinct()), "row_id", "left_semi")
    x, y = canonical(only(ev, "dev"), "dev", True), canonical(only(tr, "train"), "train", True)
    return hits.join(x.withColumnRenamed("d", "c"), "dev").join(y, "train").filter("c = d").select("dev", "train")


def similar_classes(ev_sets: DataFrame, tr_sets: DataFrame, t: float = SIMILARITY) -> DataFrame:
    """(a, b, containment, similarity) of the classes of both splits whose similarity reaches t."""
    order = levels(tr_sets)
    asked = written(windows_of(ev_sets, order, t, ("a", "na", "pa")), "asked")
    hits = windows_of(tr_sets, order, t, ("b", "nb", "pb"), asked_places(asked, "path"))
    met = hits.drop("big").join(asked.drop("big"), "path").filter(may_reach(t)).select("a", "b").distinct()
    return confirmed(met, ev_sets, tr_sets, t)


def similar_program(ev: DataFrame, tr: DataFrame, t: float = SIMILARITY, n: int = RUN) -> DataFrame:
    """(dev, train, containment, similarity) of all pairs of rows whose programs reach t."""
    ev_members, ev_sets = classes(ev.select("row_id", F.col("mlir").alias("text")), n)
    tr_members, tr_sets = classes(tr.select("row_id", F.col("mlir").alias("text")), n)
    x, y = ev_members.select(F.col("rep").alias("a"), F.col("row_id").alias("dev")), tr_members.select(F.col("rep").alias("b"), F.col("row_id").alias("train"))
    return similar_classes(ev_sets, tr_sets, t).join(x, "a").join(y, "b").select("dev", "train", "containment", "similarity")


def letters(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def least_grams(questions: DataFrame, m: int = GRAM, w: int = WINDOW) -> DataFrame:
    """(row_id, s) -> (dev, m, h): of each question its least m-gram; of one too short for a window, its first characters."""

    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_numpy(), b.column(1).to_pylist()
            where = [np.array([i for i, t in enumerate(texts) if (len(t) >= m + w - 1) == long], np.int64) for long in (True, False)]
            whole, _, parts = cut_long([texts[i] for i in where[0]], m + w - 1)
            best: dict[int, int] = {}
            for first, codes, edges in blocks(parts):
                owner, starts, _, place, s = minimised(codes, edges, m, w)
                if len(starts):
                    for o, h in zip((first + owner).tolist(), s.of(place, place + m).tolist()):
                        i = int(whole[o])
                        if i not in best or h >> 32 < best[i] >> 32:  # ordered as minimisers are, the leftmost of equals
                            best[i] = h
            got = [(int(ids[where[0][i]]), m, h) for i, h in best.items()]
            for i in where[1]:
                k = min(len(texts[i]), m)
                codes = np.frombuffer(texts[i][:k].encode("utf-32-le", "surrogatepass"), np.uint32)
                got.append((int(ids[i]), k, int(Stretch(codes).of(np.array([0]), np.array([k]))[0])))
            rows = list(zip(*got)) or [(), (), ()]
            yield pa.record_batch([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(signed(np.array(rows[2], np.uint64)))], ["dev", "m", "h"])

    return questions.mapInArrow(run, "dev long, m int, h long")


def asked_grams(programs: DataFrame, bits: np.ndarray, lengths: list[int], m: int = GRAM, w: int = WINDOW) -> DataFrame:
    """(row_id, s) -> (train, m, h): the minimisers of each text, and its grams of the given lengths at every place, that are asked for."""
    held = programs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        bits = held.value
        for b in batches:
            ids = b.column(0).to_numpy()
            whole, _, parts = cut_long(b.column(1).to_pylist(), m + w - 1)
            for first, codes, edges in blocks(parts):
                found = []
                owner, starts, _, place, s = minimised(codes, edges, m, w)
                if len(starts):
                    found.append((owner, m, s.of(place, place + m)))
                if lengths:
                    s = s or Stretch(codes)
                    owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
                    at = np.arange(len(codes))
                    for k in lengths:
                        fits = np.flatnonzero(at + k <= edges[1:][owner])
                        found.append((owner[fits], k, s.of(fits, fits + k)))
                for owner, k, h in found:
                    keep = is_asked(bits, signed(h))
                    if keep.any():
                        got = np.unique(np.rec.fromarrays([ids[whole[first + owner[keep]]], signed(h[keep])], names="i,h"))
                        yield pa.record_batch([pa.array(np.ascontiguousarray(got.i)), pa.array(np.full(len(got), k, np.int32)), pa.array(np.ascontiguousarray(got.h))], ["train", "m", "h"])

    return programs.mapInArrow(run, "train long, m int, h long")


def held_question(ev: DataFrame, tr: DataFrame) -> DataFrame:
    """(dev, train): the question's letters and digits stand in one piece in those of the program."""
    q = written(ev.select(F.col("row_id").cast("long").alias("row_id"), letters(F.col("nl")).alias("s")).filter("s <> ''"), "questions")
    p = tr.select(F.col("row_id").cast("long").alias("row_id"), letters(F.col("mlir")).alias("s")).filter("s <> ''")
    asked = written(least_grams(q), "least-grams")
    short = [r["m"] for r in q.filter(F.length("s") < GRAM + WINDOW - 1).select(F.least(F.length("s"), F.lit(GRAM)).alias("m")).distinct().collect()]  # at most GRAM rows
    met = written(asked_grams(p, asked_places(asked, "h"), sorted(short)).join(asked, ["m", "h"]).select("dev", "train").distinct(), "held")
    texts = p.join(bounded(met.select(F.col("train").alias("row_id")).distinct()), "row_id", "left_semi").withColumnRenamed("row_id", "train")
    return met.join(q.select(F.col("row_id").alias("dev"), F.col("s").alias("q")), "dev").join(texts, "train").filter(F.contains("s", "q")).select("dev", "train")


def pairs(ev: DataFrame, tr: DataFrame) -> DataFrame:
    """(dev, train, how) by each rule; a pair may come by several."""
    rules = (("same_program", same_program(ev, tr)), ("similar_program", similar_program(ev, tr).select("dev", "train")), ("question_held", held_question(ev, tr)))
    out = None
    for how, found in rules:
        found = found.withColumn("how", F.lit(how))
        out = found if out is None else out.unionByName(found)
    return out


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pairs(table(spark, sf_dir, "dev_v1"), table(spark, sf_dir, "train_v1"))
    return got.select(F.col("dev").alias("dev_row_id"), F.col("train").alias("train_row_id")).distinct()


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and source of the evaluation rows: rows, rows also in training, and by which rule."""
    ev = table(spark, sf_dir, "dev_v1")
    got = pairs(ev, table(spark, sf_dir, "train_v1")).select(F.col("dev").alias("row_id"), "how").distinct()
    ways = got.groupBy("row_id").agg(*[F.max(F.when(F.col("how") == h, 1).otherwise(0)).alias(h) for h in ("same_program", "similar_program", "question_held")])
    both = ev.select("row_id", "split", "source").join(ways, "row_id", "left")
    n = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("long")
    return both.groupBy("split", "source").agg(F.count("*").alias("n"), F.count("same_program").alias("n_overlap"), *[n(h).alias("n_" + h) for h in ("same_program", "similar_program", "question_held")])


def p5_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation and training record of similar programs: how much of the evaluation record the training record holds, and how
    alike they are."""
    got = similar_program(table(spark, sf_dir, "dev_v1"), table(spark, sf_dir, "train_v1"))
    return got.select(F.col("dev").alias("dev_row_id"), F.col("train").alias("train_row_id"), F.round("containment", 9).alias("containment"), F.round("similarity", 9).alias("similarity"))


_RULES = r"""
  WITH tok AS (SELECT 'd' AS side, row_id, mlir, nl FROM dev_v1 UNION ALL SELECT 't', row_id, mlir, NULL FROM train_v1),
  tk AS (SELECT side, row_id, regexp_extract_all(lower(regexp_replace(mlir, '//[^\n\r]*', '', 'g')), '[%@][\w$.-]+|\w+|[^\s\w]') AS t FROM tok WHERE mlir IS NOT NULL),
  fx AS (SELECT side, row_id, i, t[i] AS x FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM tk)),
  ord AS (SELECT side, row_id, x, row_number() OVER (PARTITION BY side, row_id ORDER BY min(i)) AS k FROM fx WHERE x LIKE '\%_%' ESCAPE '\' GROUP BY 1, 2, 3),
  canon AS (SELECT fx.side, fx.row_id, string_agg(CASE WHEN k IS NOT NULL THEN '%' || k WHEN fx.x LIKE '@_%' THEN '@f' ELSE fx.x END, ' ' ORDER BY i) AS c FROM fx LEFT JOIN ord USING (side, row_id, x) GROUP BY 1, 2),
  w AS (SELECT side, row_id, regexp_extract_all(lower(coalesce(mlir, '')), '[a-z0-9_]+') AS w FROM tok),
  g AS (SELECT DISTINCT side, row_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT side, row_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
  n AS (SELECT side, row_id, count(*) AS n FROM g GROUP BY 1, 2),
  p AS (SELECT a.row_id AS x, b.row_id AS y, count(*) AS c FROM g a JOIN g b ON a.side = 'd' AND b.side = 't' AND a.s = b.s GROUP BY 1, 2),
  l AS (SELECT side, row_id, lower(regexp_replace(nl, '[^\p{L}\p{N}]+', '', 'g')) AS q, lower(regexp_replace(mlir, '[^\p{L}\p{N}]+', '', 'g')) AS s FROM tok)
"""
_SIMILAR = "FROM p JOIN n a ON a.side = 'd' AND a.row_id = x JOIN n b ON b.side = 't' AND b.row_id = y WHERE c * 2 >= a.n + b.n - c"
_SAME = "FROM canon a JOIN canon b ON a.side = 'd' AND b.side = 't' AND a.c = b.c"
_HELD = "FROM l a JOIN l b ON a.side = 'd' AND b.side = 't' AND a.q <> '' AND contains(b.s, a.q)"
SQL = {
    "p5_links": f"{_RULES} SELECT x AS dev_row_id, y AS train_row_id, round(c / a.n, 9) AS containment, round(c / (a.n + b.n - c), 9) AS similarity {_SIMILAR}",
    "p5_found": f"{_RULES} SELECT x AS dev_row_id, y AS train_row_id {_SIMILAR} UNION SELECT a.row_id, b.row_id {_SAME} UNION SELECT a.row_id, b.row_id {_HELD}",
    "p5_report": f"""{_RULES}, h AS (SELECT DISTINCT x AS row_id, 'similar' AS how {_SIMILAR} UNION SELECT a.row_id, 'same' {_SAME} UNION SELECT a.row_id, 'held' {_HELD}),
      k AS (SELECT row_id, bool_or(how = 'same') AS same, bool_or(how = 'similar') AS sim, bool_or(how = 'held') AS held FROM h GROUP BY 1)
      SELECT split, source, count(*) AS n, count(k.row_id) AS n_overlap, count(*) FILTER (same) AS n_same_program, count(*) FILTER (sim) AS n_similar_program, count(*) FILTER (held) AS n_question_held FROM dev_v1 d LEFT JOIN k USING (row_id) GROUP BY 1, 2""",
}
