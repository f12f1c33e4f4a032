"""Problem 4: text cut off by field limits or on the way.

Three rules over all rows, the first that holds decides:
- limit: per source and column, histograms of the lengths in characters and in bytes. A length met far more often than its
  neighbours, mostly by values without a terminal end, is a field limit (spikes()); a value of that length without a terminal
  end (a mark that ends things, or an end that the model below finds LIKELY) was cut by it;
- likelihood: an end-of-text n-gram model over the tokens of all texts. A text that ends where texts of that n-gram nearly always go
  on, about as seldom as anywhere inside a word or name, was cut on the way (end_model());
- structure: a program, code fence or quoted name that is still open, whatever its last token. Braces in comments and strings don't count.
What follows a cut (blanks, a mark of omission) is taken off first.

The model: tokens are words in lower case; names, numbers, quoted names and strings by their class; marks. The context of an end
is its two tokens before and its last one; words, names and numbers are all 'w' there, since the last one may be half of one. P(end | context) is
interpolated with the shorter contexts (PRIOR pseudo-counts), without the text's own end. Equal texts count one end, so copies of a
cut text don't make its end natural. A context is no end if P is below the root of the rate of ends at words, in lines of its
kind (program or talk): half way, in logarithms, from that rate to certainty. A sentence of words that has its end mark is complete, however often texts go on behind it.

Null and empty texts, and those of blanks, punctuation or a bare fence, are no cases. Very long texts are handled whole; repeated
rows are judged alike; extra columns are ignored. Tables without rows give none.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.merkle import FENCE, is_empty
from corvane.store import bounded, table, written

#: Marks of omission and blanks after a cut.
MARKS = r"(?iU)(?:[\s​﻿�…]|\.{3}|\[[ .…]*(?:\p{L}[\p{L} ]*)?[ .…]*\]|<[ .…]*(?:more|cut|snip|truncated|continued|omitted)[ .…]*>|\((?:[ .…]*(?:more|cut|snip|truncated|continued|omitted|cont)[ .…]*)\))+$"
PROGRAM = r"(?i)module[^{\n]*\{|func\.func"
#: Marks that end a sentence, a program, a fence or a quotation.
TERMINAL = r"""[.!?。！？؟।;}`)\]"'”’»]$"""
SPIKE_TIMES, SPIKE_ROWS, NEIGHBOURS = 4.0, 5, 16
PRIOR, LIKELY = 20.0, 0.25


def body(text: Column) -> Column:
    """The text without what follows a cut. Only ends that can be a mark are searched."""
    return F.when(F.right(text, F.lit(1)).rlike(r"[}`A-Za-z0-9_,:;%(]"), text).otherwise(F.regexp_replace(text, MARKS, ""))


def is_program(text: Column) -> Column:
    return text.contains("func.func") | text.rlike(PROGRAM)


def _count(text: Column, what: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(what)))) / len(what)


def still_open(text: Column) -> Column:
    """Whether a brace of a program, a code fence or a quoted name is open at the end. For text that body() gave."""
    quoted = F.when(F.left(text, F.lit(1)).isin('"', "'", "“"), F.substring(text, 2, 1 << 30)).otherwise(text)
    code = F.when(quoted.contains("//") | quoted.contains('"'), F.regexp_replace(quoted, r'//[^\n]*+|"[^"\n]*+"', "")).otherwise(quoted)
    open_fence = _count(text, "```").cast("int") % 2 == 1
    half_fence = F.right(text, F.lit(3)).rlike(r"(^|[\n\r])`{1,2}$")
    open_fence = open_fence | (_count(text, "`").cast("int") % 2 == 1)
    return open_fence | (is_program(text) & ((_count(code, "{") > _count(code, "}")) | half_fence))


_TOKEN = re.compile(r"[\n\r]|```|`[^`\n]*`?|\"[^\"\n]*\"|[%@][\w$]+|[^\W\d_]+(?:[\d_]\w*)?|\d+|[^\w\s]|_\w*")
#: What a line of program begins with; such a line's tokens are told from those of talk.
_CODE = frozenset("<n> { } % @ module func linalg arith memref scf return ins outs".split())
_STOPS, _QUOTES = frozenset(".!?。！？؟।"), frozenset("\"'”’»;")


def tokens(text: str) -> tuple[list[str], list[str]]:
    """The tokens of a text, and what each is as the last one: w for all that can be half of something, $ for the end of a sentence
    of words, marks themselves; with ~ in lines of talk."""
    whole, last = [], []
    first, talk, before = True, "~", False
    for t in _TOKEN.findall(text):
        c = t[0]
        if c in "\n\r":
            first = True
            continue
        end, word = "w", True
        if c.isalpha():
            t = t.lower() if t.isalpha() else "<n>"
        elif c.isdigit():
            t, word = "<0>", False
        elif c == "_" or (c in "%@" and len(t) > 1):
            t = "<n>"
        elif c in '`"' and len(t) > 1 and t != "```":
            t = "<q>"
        else:
            end, word = t, False
        if first:
            first, talk = False, "" if t in _CODE else "~"
        if before and talk and t in _STOPS:
            end = "$"
        whole.append(t)
        last.append(end + talk)
        before = word
    return whole, last


HELD = 400_000
_MEASURED = "row_id long, source string, model string, n_chars int, n_bytes int, empty boolean, is_open boolean, terminal boolean, digest binary, a string, b string, t string, c string, n long"


def measured(rows: DataFrame) -> DataFrame:
    """One pass over the texts, (row_id, source, text) -> a row for each text, with the tokens (a, b, t) that it ends in, c what t is as the last one, and n null;
    and rows of the n inner places of such tokens, summed by task. model goes along, where there is one. No text is kept."""
    t = body(F.col("text"))
    model = F.col("model") if "model" in rows.columns else F.lit(None).cast("string").alias("model")
    base = rows.select(F.col("row_id").cast("long"), "source", model, F.length("text").alias("n_chars"), F.octet_length("text").alias("n_bytes"), is_empty(F.col("text")).alias("empty"), t.alias("b"))
    base = base.select("row_id", "source", "model", "n_chars", "n_bytes", "empty", still_open(F.col("b")).alias("is_open"), F.col("b").rlike(TERMINAL).alias("terminal"), F.unhex(F.md5("b")).alias("digest"), F.when(~F.col("empty"), F.col("b")).alias("text"))
    names = [x.split()[0] for x in _MEASURED.split(", ")]

    def run(batches):
        inner, seen = Counter(), set()

        def sums():
            k = list(inner)
            n = len(k)
            cols = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary())]
            cols += [pa.array([x[i] for x in k], pa.string()) for i in range(4)] + [pa.array([inner[x] for x in k], pa.int64())]
            inner.clear()
            return pa.record_batch(cols, names)

        for batch in batches:
            ends = []
            for digest, text in zip(batch.column(8).to_pylist(), batch.column(9).to_pylist()):
                if text is None:
                    ends.append((None,) * 4)
                    continue
                whole, last = tokens(text[1:] if text[0] in "\"'“" else text)
                whole = ["^", "^", *whole]
                if digest not in seen:  # copies within a task count once
                    seen.add(digest)
                    inner.update(zip(whole, whole[1:], whole[2:], last[:-1]))
                while len(last) > 1 and (whole[-1] == ";" or (whole[-1] in _QUOTES and last[-2].rstrip("~") in ("$", "}", "."))):
                    whole.pop()
                    last.pop()
                ends.append((*whole[-3:], last[-1]) if last else (None,) * 4)
            if len(seen) > HELD:
                seen.clear()
            yield pa.record_batch([*batch.columns[:9], *(pa.array([e[i] for e in ends], pa.string()) for i in range(4)), pa.nulls(len(ends), pa.int64())], names)
            if len(inner) > HELD:
                yield sums()
        if inner:
            yield sums()

    return base.mapInArrow(run, _MEASURED)


LENGTHS = "map('chars', n_chars, 'bytes', n_bytes)"


def spikes(rows: DataFrame) -> DataFrame:
    """(source, unit, len, n, n_open): lengths met SPIKE_TIMES as often as the mean of their NEIGHBOURS on either side, by at least
    SPIKE_ROWS rows, most of which have no terminal end. The histogram has one row per length; its windows are bounded."""
    long = rows.select("source", "terminal", F.explode(F.expr(LENGTHS)).alias("unit", "len"))
    hist = long.groupBy("source", "unit", "len").agg(F.count("*").alias("n"), F.sum((~F.col("terminal")).cast("long")).alias("n_open"))
    near = Window.partitionBy("source", "unit", F.floor(F.col("band"))).orderBy("len").rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    # Lengths fall into bands of 4096 with NEIGHBOURS of overlap, so no window grows with the longest text.
    width = 4096
    banded = hist.withColumn("band", F.explode(F.array_distinct(F.array(F.floor((F.col("len") - NEIGHBOURS) / width), F.floor(F.col("len") / width), F.floor((F.col("len") + NEIGHBOURS) / width)))))
    near_n = (F.sum("n").over(near) - F.col("n")) / (2 * NEIGHBOURS)
    seen = banded.withColumn("near_n", near_n).filter(F.col("band") == F.floor(F.col("len") / width))
    return seen.filter((F.col("n") >= SPIKE_ROWS) & (F.col("n") >= SPIKE_TIMES * F.col("near_n")) & (F.col("n_open") * 2 > F.col("n"))).select("source", "unit", "len", "n", "n_open")


def end_model(base: DataFrame) -> DataFrame:
    """(a, b, t, c, p, floor) of all last tokens: the likelihood of an end there, and the rate of ends at words in lines of that kind.

    A last word t may be half of a longer one, so what goes on is all words behind (a, b) that begin with t, and all names."""
    keys = ["a", "b", "t", "c"]
    ends = base.filter("n is null and c is not null").groupBy(keys).agg(F.count_distinct("digest").alias("e"))
    inner = base.filter("n is not null").groupBy(keys).agg(F.sum("n").alias("i"))
    both = written(ends.join(inner, keys, "full").na.fill(0, ["e", "i"]), "end-counts")
    sums = lambda k, *by: both.groupBy(*by).agg(F.sum("e").alias(f"e{k}"), (F.sum("e") + F.sum("i")).alias(f"n{k}"))
    at = sums("", "c").filter("c in ('w', 'w~')").collect()  # two rows
    rates = {r["c"]: r["e"] / max(r["n"], 1) for r in at}
    floor = F.when(F.col("c").endswith("~"), rates.get("w~", 0.0)).otherwise(rates.get("w", 0.0))
    begins = F.when(F.col("t").rlike(r"^\p{L}"), F.transform(F.sequence(F.lit(1), F.length("t")), lambda k: F.left("t", k))).otherwise(F.array("t"))
    on = both.filter("i > 0").select("a", "b", "c", "i", F.explode(begins).alias("t")).groupBy(keys).agg(F.sum("i").alias("on"))
    names = both.filter("t = '<n>'").groupBy("a", "b", "c").agg(F.sum("i").alias("names"))  # any of them may begin with t
    on = both.filter("e > 0").join(on, keys, "left").join(names, ["a", "b", "c"], "left").na.fill(0, ["on", "names"])
    on = on.withColumn("on", F.col("on") + F.when(F.col("t").rlike(r"^\p{L}"), F.col("names")).otherwise(0))
    got = on.join(sums(3, "a", "b", "c"), ["a", "b", "c"]).join(sums(2, "b", "c"), ["b", "c"]).join(sums(1, "c"), "c")
    less = lambda e, n, p: (F.greatest(F.col(e) - 1, F.lit(0)) + PRIOR * p) / (F.greatest(n - 1, F.lit(0)) + PRIOR)
    p = less("e", F.col("e") + F.col("on"), less("e3", F.col("n3"), less("e2", F.col("n2"), less("e1", F.col("n1"), floor))))
    return got.select(*keys, p.alias("p"), floor.alias("floor"))


def judged(rows: DataFrame) -> DataFrame:
    """(row_id, source, text) -> row_id, source, model, n_chars, n_bytes, rule and cut: whether the text stops before its end, and by which rule."""
    base = written(measured(rows), "ends")
    full = base.filter("n is null and not empty")
    limits = bounded(spikes(full).select("source", "unit", "len").withColumn("hit", F.lit(True)))
    ends = end_model(base).select("a", "b", "t", "c", (F.col("p") >= LIKELY).alias("likely"), ((F.col("p") < F.sqrt("floor")) & ~F.col("c").startswith("$")).alias("unlikely"))
    model = bounded(written(ends.filter("likely or unlikely"), "judged-ends"))
    out = base.filter("n is null").join(model, ["a", "b", "t", "c"], "left")
    for unit, n in (("chars", "n_chars"), ("bytes", "n_bytes")):
        at = limits.filter(F.col("unit") == unit).select("source", F.col("len").alias(n), F.col("hit").alias("at_" + unit))
        out = out.join(at, ["source", n], "left")
    at_limit = (F.col("at_chars").isNotNull() | F.col("at_bytes").isNotNull()) & ~F.col("terminal") & ~F.coalesce("likely", F.lit(False))
    rule = F.when(F.col("empty"), None).when(at_limit, "limit").when(F.col("unlikely"), "likelihood").when(F.col("is_open"), "structure")
    return out.select("row_id", "source", "model", "n_chars", "n_bytes", rule.alias("rule"), rule.isNotNull().alias("cut"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ladder.generated and gen_out.text as one collection (row_id, source, model, text)."""
    a = table(spark, sf_dir, "ladder").select("row_id", F.lit("ladder.generated").alias("source"), "model", F.col("generated").alias("text"))
    return a.unionByName(table(spark, sf_dir, "gen_out").select(F.col("gen_id").alias("row_id"), F.lit("gen_out.text").alias("source"), "model", "text"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(answers(spark, sf_dir)).filter("cut").select("row_id")


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source and model: rows, cut rows, their share, and how many each rule decided."""
    both = judged(answers(spark, sf_dir))
    by = [F.sum((F.coalesce("rule", F.lit("")) == r).cast("long")).alias("n_" + r) for r in ("limit", "likelihood", "structure")]
    return both.groupBy("source", "model").agg(F.count("*").alias("n"), F.sum(F.col("cut").cast("long")).alias("n_cut"), F.avg(F.col("cut").cast("double")).alias("rate"), *by)


def p4_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field limits that the length histograms show."""
    return spikes(written(measured(answers(spark, sf_dir)), "ends").filter("n is null and not empty"))


SQL: dict[str, str] = {}
