"""Problem 6: broken prompt and response pairs.

Each answer gets at most one defect, the first that holds of: empty, truncated (operator of problem 4, with its end-of-text n-gram
likelihood), copies_question, refusal, other_language.

other_language: the posteriors of the question's and of the answer's language, by naive Bayes over character n-grams (1 to 3) within
words. The classes are the labels of documents but for `und`, and one class more for what none of them explains, where all n-grams
are alike, in any script: a script or language that the model never saw. A letter's script counts beside its n-grams. The pair differs if the languages agree with a probability below AGREE;
a text of few letters has a flat posterior and proves nothing. Fitted on about PER_LANGUAGE documents of each label, chosen by hash:
a documented bound. The model has BUCKETS hashed n-grams a label. Words of the program (names with digits, underscores or inner
capitals, anything in backquotes, sigils) are not prose.

refusal: likelihood ratio of word n-grams over the prose of all answers, self-trained from few seed words (refusal_model()). What
stands beside programs, or in questions, doesn't decline, whatever its words; an answer with a program isn't asked. Each distinct
prose counts once, so copies don't shift the model, and a prose's own counts are left out of its ratio.

Null nl: no comparison with the question is made. Null or blank answers are `empty`. Texts are read whole. Repeated rows are
judged alike. Without labelled documents no other_language is given; no refusal is found in
answers whose n-grams none with a seed word shares. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import grams
from corvane.llm.merkle import FENCE, is_empty
from corvane.llm.truncation import answers, is_program, judged
from corvane.store import bounded, table, written

PER_LANGUAGE, LABELS, BUCKETS, AGREE, FREE = 400, 200, 1 << 16, 0.02, 0.2
SCRIPTS, OTHER_SCRIPT = 1024, 1e-3
COPY_SHARE = 0.55
RATIO, ROUNDS = 0.0, 5
#: Where the model of refusals starts from. Few words, which needn't be in most refusals.
SEEDS = r"(?U)\b(sorry|apologi[sz]e|decline|unable to|cannot|leider|lehne|désolée?|refuse|lo siento|no puedo|não posso|извините|не могу)\b|抱歉|无法|申し訳|できません"


def own_words(text: Column) -> Column:
    """The prose of an answer: comments and the lines that aren't program, without names and numbers."""
    no_names = F.regexp_replace(text, r"`[^`\n]*`|\"[^\"\n]*\"", " ")
    lines = F.split(no_names, r"[\r\n]+")
    program = r"(?i)^\s*([%}{^#]|\"?module\b[^.]*\{|module\s*$|func\.|linalg\.|arith\.|memref\.|scf\.|return\b|```|ins\(|outs\()"
    comment = F.transform(lines, lambda x: F.when(x.rlike(program), F.regexp_extract(x, r"//(.*)$", 1)).otherwise(x))
    return F.trim(F.regexp_replace(F.array_join(comment, "\n"), r"(?U)[%@]?\b\w*[\d_]\w*|\b\p{Ll}+\p{Lu}\w*|[%@]\w+", " "))


_WORD = re.compile(r"[^\W\d_]+")


def ngram_ids(word: str) -> list[int]:
    w = f" {word} "
    return [zlib.crc32(w[i : i + n].encode()) % BUCKETS for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def script_ids(word: str) -> list[int]:
    """Of each letter, the stretch of 256 code points that it is in: what tells scripts apart."""
    return [BUCKETS + (ord(c) >> 8) % SCRIPTS for c in word]


def fit_languages(docs: DataFrame) -> dict:
    """{langs, log}: the labels and one more, and the log-likelihood of each bucket under them. One pass over docs counts the n-grams of
    the sample where it stands; only the counts, at most LABELS * BUCKETS of them, reach the driver. More labels than LABELS are an error."""
    told = docs.filter("text is not null").select("doc_id", "text", F.trim(F.lower("lang")).alias("lang")).filter("lang <> '' and lang <> 'und'")
    labels = told.groupBy("lang").count().orderBy("lang").limit(LABELS + 1).collect()
    if len(labels) > LABELS:
        raise ValueError(f"more than {LABELS} language labels")
    langs = [r["lang"] for r in labels]
    if not langs:
        return {"langs": [], "log": np.zeros((0, BUCKETS + SCRIPTS), "float32")}
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, PER_LANGUAGE / r["count"])) for r in labels], "lang string, share double")
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 33) / float(1 << 31)
    sample = told.join(F.broadcast(share), "lang").filter(place < F.col("share")).select("lang", own_words(F.col("text")).alias("text"))

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = counts.setdefault(lang, np.zeros(BUCKETS + SCRIPTS, np.int64))
                for w in _WORD.findall(text.lower()):
                    np.add.at(c, ngram_ids(w), 1)
                    np.add.at(c, script_ids(w), 1)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.record_batch([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "bucket", "n"])

    got = sample.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    every = np.zeros((len(langs), BUCKETS + SCRIPTS))
    every[got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), got["bucket"].to_numpy(int)] = got["n"]
    counts, scripts = every[:, :BUCKETS], every[:, BUCKETS:]
    n, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    free = np.maximum(FREE, kinds / np.maximum(n + kinds, 1))  # the share of all buckets alike: at least as often as a new kind was met
    log = np.log((1 - free) * counts / np.maximum(n, 1) + free / BUCKETS)
    script = np.log((1 - OTHER_SCRIPT) * scripts / np.maximum(scripts.sum(1, keepdims=True), 1) + OTHER_SCRIPT / SCRIPTS)
    log = np.hstack([log / 3, script])  # each letter is in three n-grams, so their likelihoods count a third
    unseen = np.hstack([np.full((1, BUCKETS), -np.log(BUCKETS) / 3), np.zeros((1, SCRIPTS))])  # it writes in whatever script is met
    return {"langs": [*langs, ""], "log": np.vstack([log, unseen]).astype("float32")}


def posteriors(model: dict):
    """A function from texts to the posterior of each of the model's languages, all alike before."""
    log, known = model["log"], {}

    def one(text: str | None) -> np.ndarray:
        total = np.zeros(len(log))
        for w in _WORD.findall((text or "").lower()):
            v = known.get(w)
            if v is None:
                v = log[:, ngram_ids(w) + script_ids(w)].sum(1)
                if len(known) < 200_000:
                    known[w] = v
            total = total + v
        p = np.exp(total - total.max())
        return p / p.sum()

    return one


def differs(model: dict):
    """A pandas UDF: whether the prose is in another language than the question."""

    @F.pandas_udf("boolean")
    def run(prose: pd.Series, nl: pd.Series) -> pd.Series:
        of, memo, out = posteriors(model), {}, []
        for p, q in zip(prose, nl):
            if q is None or not model["langs"]:
                out.append(False)
                continue
            if q not in memo:
                memo[q] = of(q)
            out.append(bool(memo[q] @ of(p) < AGREE))
        return pd.Series(out)

    return run


def bigrams(text: Column) -> Column:
    """The distinct pairs of successive words."""
    return grams(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_.]*[\p{L}\p{N}_])"), F.lit(1)), 2)


def has_program(text: Column) -> Column:
    """Whether an answer holds more of a program than an empty shell with comments."""
    shell = F.regexp_replace(text, r"//[^\n\r]*", "").rlike(r"(?i)\bfunc\b|%\w")
    return text.contains("func.func") | (is_program(text) & shell)


def phrases(prose: Column) -> Column:
    """The distinct n-grams of a prose that tell what it says: pairs and triples of words, or its words where there are no more."""
    words = F.regexp_extract_all(F.lower(prose), F.lit(r"\p{L}+(?:['’‘]\p{L}+)*"), F.lit(0))
    return F.when(F.size(words) < 2, F.array_distinct(words)).otherwise(F.array_union(grams(words, 2), grams(words, 3)))


def looked_at(rows: DataFrame) -> DataFrame:
    """One pass over the texts: (row_id, nl, text) -> row_id, nl, empty, copy, program and prose: its words, where anything is asked of them.

    The costly parts are computed once a row, and only for answers that can need them."""
    t = F.coalesce("text", F.lit(""))
    one = rows.select("row_id", "nl", t.alias("t"), is_empty(F.col("text")).alias("empty"), has_program(t).alias("program"))
    talk = ~F.col("empty") & ~F.col("program")
    two = one.withColumn("a", F.when(talk, bigrams(F.col("t")))).withColumn("b", F.when(talk, bigrams(F.col("nl"))))
    three = two.withColumn("copy", F.coalesce(F.size(F.array_intersect("a", "b")) >= F.greatest(F.lit(3), F.size("a")) * COPY_SHARE, F.lit(False))).drop("a", "b")
    bare = F.col("program") & F.col("t").startswith("module") & F.col("t").endswith("}") & ~F.col("t").contains("//")
    return written(three.select("row_id", "nl", "empty", "copy", "program", F.when(~F.col("empty") & ~F.col("copy") & ~bare, own_words(F.col("t"))).alias("prose")), "answers")


def refusal_model(looked: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(prose, ratio, seeded) of each distinct prose that is only met without a program: the mean log ratio of its n-grams' counts in
    answers that decline to those in all other prose, its own left out. Self-trained: at first those with a SEED decline and what
    stands beside programs or in questions doesn't; then each round counts anew by the last round's ratios, until nothing
    changes or for so many rounds."""
    worded = r"prose rlike '\\p{L}'"
    talk = looked.filter(worded).groupBy("prose").agg(F.max("program").alias("beside"))
    asked = looked.filter("nl is not null").select(F.btrim("nl", F.lit(" \t\r\n")).alias("nl")).distinct().select(own_words(F.col("nl")).alias("prose")).filter(worded).distinct().withColumn("beside", F.lit(True))
    kinds = talk.unionByName(asked).groupBy("prose").agg(F.max("beside").alias("beside"))
    kinds = written(kinds.select("prose", F.xxhash64("prose").alias("id"), "beside", F.lower("prose").rlike(SEEDS).alias("seeded")), "prose")
    alone = written(kinds.filter("not beside").select("id", "seeded", F.explode(phrases(F.col("prose"))).alias("gram")), "phrases")
    beside = kinds.filter("beside").select(F.explode(phrases(F.col("prose"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("beside"))
    beside = written(beside.join(alone.select("gram").distinct(), "gram", "left_semi"), "phrases-beside")
    now, before = kinds.filter("not beside and seeded").select("id", F.lit(1).alias("pos")), None
    for k in range(rounds):
        marked = alone.join(now, "id", "left").withColumn("neg", 1 - F.col("pos")).na.fill(0, ["pos", "neg"])
        sums = marked.groupBy("gram").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q")).join(beside, "gram", "left").na.fill(0, ["beside"])
        ratio = F.log((F.col("p") - F.col("pos") + 0.5) / (F.col("q") - F.col("neg") + F.col("beside") + 0.5))
        scored = written(marked.join(sums, "gram").groupBy("id").agg(F.avg(ratio).alias("ratio")), f"ratios-{k}")
        now = scored.select("id", (F.col("ratio") > RATIO).cast("int").alias("pos"))
        state = now.agg(F.sum("pos"), F.sum(F.col("pos") * F.pmod("id", F.lit(1_000_003)))).first()
        if state == before:  # the same rows decline as in the round before
            break
        before = state
    return kinds.filter("not beside").join(scored, "id").select("prose", "ratio", "seeded")


def defects(rows: DataFrame, cut: DataFrame, docs: DataFrame) -> DataFrame:
    """(row_id, nl, text) and the cut rows' ids -> (row_id, defect)."""
    looked = looked_at(rows)
    declines = bounded(written(refusal_model(looked).filter(F.col("ratio") > RATIO).select("prose", F.lit(True).alias("refuse")), "refusals"))
    flags = looked.join(cut.select("row_id", F.lit(True).alias("is_cut")), "row_id", "left").join(declines, "prose", "left")
    kind = F.when(F.col("empty"), "empty").when(F.col("is_cut"), "truncated").when(F.col("copy"), "copies_question").when(F.col("refuse") & ~F.col("program"), "refusal")
    base = flags.select("row_id", "nl", "prose", kind.alias("defect"))
    asked = base.filter(F.col("defect").isNull() & F.col("prose").rlike(r"\p{L}"))
    foreign = asked.filter(differs(fit_languages(docs))("prose", "nl")).select("row_id", F.lit("other_language").alias("defect"))
    return base.filter("defect is not null").select("row_id", "defect").unionByName(foreign)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = judged(answers(spark, sf_dir)).filter("cut and source = 'ladder.generated'").select("row_id")
    rows = table(spark, sf_dir, "ladder").select("row_id", "nl", F.col("generated").alias("text"))
    return defects(rows, cut, table(spark, sf_dir, "documents"))


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per model and defect: rows and their share of the model's rows."""
    rows = table(spark, sf_dir, "ladder").select("row_id", "model")
    n = rows.groupBy("model").agg(F.count("*").alias("n"))
    got = rows.join(p6_found(spark, sf_dir), "row_id").groupBy("model", "defect").agg(F.count("*").alias("n_defect"))
    return got.join(n, "model").select("model", "defect", "n_defect", (F.col("n_defect") / F.col("n")).alias("share"))


SQL: dict[str, str] = {}
