"""Problem 9: subject areas of each document.

Per subject two interpolated bigram models (bigram, unigram, shared unigram, uniform) are trained: one on the labelled documents about
the subject, its background on those that aren't. Both hold the same wording and the same other sentences, so what sets them
apart is the subject; a second fit counts the sentences of documents about several subjects for those they are about. A word's cross-entropy difference counts if it is more than DEAD; a sentence is about a subject if the sum over
its words is beyond the calibrated margin, and a document if MIN_SENTENCES of its sentences are. Several subjects may be accepted.
The margin is the one with the best F1 on labelled documents that weren't trained on; then the models are fitted on all.

Labels: at most LABELLED documents, chosen by hash, a documented bound; the model has at most as many n-grams as they hold. All
documents are scored, whole. More than SUBJECTS subjects are an error. Names, numbers and program lines are no words. Null, empty and blank texts have no subject; unknown
words say nothing; repeated ids are scored apart; without labels nothing is found.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.store import table

LABELLED, SUBJECTS, MIN_SENTENCES = 4000, 1000, 3
UNIGRAM, SHARED, UNIFORM, PRIOR, DEAD = 0.9, 0.098, 0.002, 6.0, 1.2
CLEAR, SECOND = 3.0, 0.6

_CODE = re.compile(r"^\s*(?:[%}{]|module\b|func\.|linalg\.|arith\.|memref\.|scf\.|return\b|```)")
_SPLIT = re.compile(r"(?<=[.!?])\s+|[\r\n]+")
_TOKEN = re.compile(r"[`%@]?[^\W_]+(?:_[^\W_]+)*")


def sentences(text: str | None) -> list[list[str]]:
    """Lists of words; names and numbers are '#'."""
    out = []
    for line in re.split(r"[\r\n]+", text or ""):
        if not line.strip() or _CODE.match(line):
            continue
        for s in _SPLIT.split(line):
            w = ["#" if t[0] in "`%@" or "_" in t or any(c.isdigit() for c in t) else t for t in _TOKEN.findall(s.lower())]
            if any(x != "#" for x in w):
                out.append(w)
    return out


class Models:
    """Gains in cross-entropy of words after words, under each subject's model over its background. Row 0 is the unknown word."""

    def __init__(self, docs: list[tuple[list[list[str]], set[str]]], subjects: list[str], first: "Models | None" = None):
        """docs: (sentences, subjects). With first models, a sentence of a document about several subjects counts for those it is about."""
        self.subjects = sorted(subjects)
        k = len(self.subjects)
        col = {s: i for i, s in enumerate(self.subjects)}
        uni, bi, prev = (defaultdict(lambda: np.zeros(k + 1)) for _ in range(3))
        for sents, labels in docs:
            mark = np.zeros(k + 1)
            mark[k] = 1  # the last column counts all documents
            mark[[col[s] for s in labels if s in col]] = 1
            marks = np.tile(mark, (len(sents), 1))
            if first is not None and len(labels) > 1:
                m = np.where(mark[:k] > 0, first.margins(sents), -np.inf)
                top = m.max(1, keepdims=True)
                marks[:, :k][(top > CLEAR) & (m < SECOND * top)] = 0
            for s, mark in zip(sents, marks):
                for p, w in zip(["^", *s], s):
                    uni[w] += mark
                    bi[p, w] += mark
                    prev[p] += mark
        words, pairs = sorted(uni), sorted(bi)
        self.index = {w: i + 1 for i, w in enumerate(words)}
        self.pair = {p: i + 1 + len(words) for i, p in enumerate(pairs)}
        n_uni, n_bi, n_prev = (np.array(x, float).reshape(-1, k + 1) for x in ([uni[w] for w in words], [bi[p] for p in pairs], [prev[p] for p, _ in pairs]))
        every = n_uni[:, k:] / max(n_uni[:, k:].sum(), 1)
        at = np.array([self.index[w] - 1 for _, w in pairs], int)

        def log(u, b, p):
            p_uni = UNIGRAM * u / np.maximum(u.sum(0), 1) + SHARED * every + UNIFORM / (len(words) + 1)
            trust = p / (p + PRIOR)
            return np.log(np.vstack([np.full((1, k), UNIFORM / (len(words) + 1)), p_uni, trust * b / np.maximum(p, 1) + (1 - trust) * p_uni[at]]))

        own, rest = (lambda x: x[:, :k]), (lambda x: x[:, k:] - x[:, :k])
        gain = log(own(n_uni), own(n_bi), own(n_prev)) - log(rest(n_uni), rest(n_bi), rest(n_prev))
        self.gain = np.where(np.abs(gain) > DEAD, gain, 0).astype("float32")

    def margins(self, sents: list[list[str]]) -> np.ndarray:
        """(sentence, subject): the sum of its words' gains."""
        if not sents:
            return np.zeros((0, len(self.subjects)))
        pair, index = self.pair, self.index
        ids = [pair.get(x) or index.get(x[1], 0) for s in sents for x in zip(["^", *s], s)]
        return np.add.reduceat(self.gain[ids], np.cumsum([0, *map(len, sents)])[:-1], axis=0)


def fit(docs, subjects: list[str]) -> Models:
    return Models(docs, subjects, Models(docs, subjects))


def f1(model: Models, docs, margin: float) -> float:
    hit = said = true = 0
    for sents, labels in docs:
        got = {s for s, n in zip(model.subjects, (model.margins(sents) > margin).sum(0)) if n >= MIN_SENTENCES}
        hit, said, true = hit + len(got & labels), said + len(got), true + len(labels)
    return 2 * hit / max(said + true, 1)


def trained(docs, subjects: list[str]) -> tuple[Models, float, float]:
    """The models, the margin calibrated on held-out documents, and the held-out F1."""
    half = fit(docs[::2], subjects)
    grid = [x / 2 for x in range(1, 25)]
    scores = [f1(half, docs[1::2], m) for m in grid]
    best = max(scores, default=0)
    good = [m for m, s in zip(grid, scores) if s >= best - 1e-12]
    return fit(docs, subjects), good[len(good) // 2] if good else 2.0, best


def labelled(documents: DataFrame, labels: DataFrame, bound: int = LABELLED) -> list:
    """The sentences and subjects of at most bound labelled documents. The ids go to the documents by broadcast, so no other text moves;
    Of documents that repeat an id, the one of the least digest counts."""
    per_doc = labels.filter("subject is not null").groupBy("doc_id").agg(F.collect_set("subject").alias("subjects")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    mine = documents.filter("text is not null").select("doc_id", "text").join(F.broadcast(per_doc), "doc_id")
    one = mine.groupBy("doc_id").agg(F.min_by(F.struct("text", "subjects"), F.md5("text")).alias("x")).select("doc_id", "x.*")
    rows = one.orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return [(sentences(r["text"]), set(r["subjects"])) for r in rows]


def classify(documents: DataFrame, model: Models, margin: float) -> DataFrame:
    """(doc_id, subject, n_sentences) of every document."""

    def run(batches):
        for b in batches:
            ids, subject, count, sents, owner = b.column(0).to_pylist(), [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                s = sentences(text)
                sents += s
                owner += [i] * len(s)
            about = model.margins(sents) > margin
            n = np.zeros((len(ids), len(model.subjects)), int)
            np.add.at(n, owner, about)
            d, s = np.nonzero(n >= MIN_SENTENCES)
            yield pa.record_batch([pa.array([ids[i] for i in d], pa.int64()), pa.array([model.subjects[j] for j in s], pa.string()), pa.array(n[d, s].astype(np.int32))], ["doc_id", "subject", "n_sentences"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, subject string, n_sentences int")


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    subjects = [r["subject"] for r in table(spark, sf_dir, "subjects").select("subject").filter("subject is not null").distinct().orderBy("subject").limit(SUBJECTS + 1).collect()]
    if len(subjects) > SUBJECTS:
        raise ValueError(f"more than {SUBJECTS} subjects")
    docs = labelled(documents, table(spark, sf_dir, "subject_labels"))
    model, margin, _ = trained(docs, subjects)
    return classify(documents, model, margin)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("doc_id", "subject").distinct()


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source and subject: documents, and their share of the source's documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    n = d.groupBy("source").agg(F.count("*").alias("n_source"))
    got = d.join(p9_found(spark, sf_dir), "doc_id").groupBy("source", "subject").agg(F.count("*").alias("n"))
    return got.join(n, got["source"].eqNullSafe(n["source"])).select(got["source"], "subject", "n", (F.col("n") / F.col("n_source")).alias("share"))


SQL: dict[str, str] = {}
