"""Problem 7: encoding of a corpus with a public byte-level BPE.

A byte-level BPE never merges across the borders of its pre-tokenizer's words, so a text's ids are its words' ids one
after the other. The corpus is split into words in the JVM and each distinct word is encoded once, into the word table. The ids are
joined back by position. The words met most often (HEAD of them, of at most HEAD_CHARS characters: a fixed bound, whatever the
corpus) are looked up where the text stands, in Arrow batches; only occurrences of the others, the tail, travel to the word table and
come back to their places between the segments of known ids. Texts without a tail aren't moved.

Null, empty: an empty list. Blank texts, text that looks like special tokens, any Unicode: encoded as ordinary text.
Repeated ids: documents are numbered within the run, so rows with equal or null doc_id stay apart. Extra columns are ignored.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.store import table, written

#: The pre-tokenizer's pattern of this tokenizer, as published with its vocabulary. (?U) makes Java's classes Unicode.
WORD = r"(?U)('(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+)"
HEAD, HEAD_CHARS = 1 << 17, 48


def vocabulary(path: str | None = None) -> str:
    """Path of byte_bpe_50k.json: the parameter, else CORVANE_TOKENIZERS, else the place of the public files."""
    return path or os.path.join(os.environ.get("CORVANE_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.json")


def _encoder(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """(word, ..) -> the same columns and ids, one call of the tokenizer per batch of distinct words."""

    def run(batches):
        t = _encoder(path)
        for b in batches:
            yield b.assign(ids=[e.ids for e in t.encode_batch(b["word"].tolist(), add_special_tokens=False)])

    return words.mapInPandas(run, T.StructType([*words.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def split_words(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(n, doc_id, words): n is unique. Texts with code points that this JVM's Unicode tables lack go to the tokenizer's own splitter."""
    base = docs.select(F.monotonically_increasing_id().alias("n"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def by_tokenizer(s: pd.Series) -> pd.Series:
        odd = s.notna()
        pre = _encoder(path).pre_tokenizer if odd.any() else None
        return s.map(lambda x: None if x is None else [x[a:b] for _, (a, b) in pre.pre_tokenize_str(x)])

    odd = F.when(F.col("t").rlike(r"\p{Cn}"), F.col("t"))  # null for nearly all texts
    return base.select("n", "doc_id", F.coalesce(by_tokenizer(odd), F.regexp_extract_all("t", F.lit(WORD), F.lit(1))).alias("words"))


def word_table(words: DataFrame, path: str) -> DataFrame:
    """(word, n_seen, ids) of each distinct word of (.., words)."""
    seen = words.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n_seen"))
    return encode_words(seen, path)


def looked_up(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(n, doc_id, words) -> (n, doc_id, segments, tail): the ids of the words of the dictionary's head, cut where a word isn't in it, and
    those words, one fewer than the segments."""
    head = dictionary.filter(F.length("word") <= HEAD_CHARS).orderBy(F.desc("n_seen"), "word").limit(HEAD).select("word", "ids").toArrow()
    known, ids = head.column("word").combine_chunks(), head.column("ids").combine_chunks()
    values, at = ids.flatten().to_numpy().astype(np.int32), np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))]).astype(np.int64)
    held = words.sparkSession.sparkContext.broadcast((known, values, at))

    def run(batches):
        known, values, at = held.value
        size = np.append(np.diff(at), 0)
        for b in batches:
            lists = b.column(2)
            edges = lists.offsets.to_numpy().astype(np.int64)
            edges = edges - edges[0]
            flat = lists.flatten()
            i = pc.fill_null(pc.index_in(flat, known), len(known)).to_numpy()
            n = size[i]
            ends = np.concatenate([[0], np.cumsum(n)])
            got = values[np.repeat(np.append(at[:-1], 0)[i] - ends[:-1], n) + np.arange(ends[-1])] if len(i) else values[:0]
            tail = np.flatnonzero(i == len(known))
            before = np.searchsorted(tail, edges)
            # A segment begins at each text and behind each word of the tail.
            order = np.argsort(np.concatenate([2 * edges[:-1], 2 * tail + 1]), kind="stable")
            cuts = np.concatenate([edges[:-1], tail])[order]
            inner = pa.ListArray.from_arrays(pa.array(np.append(ends[cuts], ends[-1]).astype(np.int32)), pa.array(got))
            segments = pa.ListArray.from_arrays(pa.array((before + np.arange(len(edges))).astype(np.int32)), inner)
            rest = pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), flat.take(pa.array(tail)))
            yield pa.record_batch([b.column(0), b.column(1), segments, rest], ["n", "doc_id", "segments", "tail"])

    ints = T.ArrayType(T.ArrayType(T.IntegerType()))
    return words.mapInArrow(run, T.StructType([*words.schema.fields[:2], T.StructField("segments", ints), T.StructField("tail", T.ArrayType(T.StringType()))]))


def _tables(docs: DataFrame, path: str | None, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Each document's segments and tail, and the word table."""
    path = vocabulary(path)
    words = split_words(docs, path, id_col, text_col)
    dictionary = written(word_table(words, path), "word-table")
    return looked_up(words, dictionary), dictionary


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row of docs."""
    coded, dictionary = _tables(docs, path, id_col, text_col)
    coded = written(coded, "coded")
    whole = coded.filter(F.size("tail") == 0).select("doc_id", F.flatten("segments").alias("ids"))
    left = coded.filter(F.size("tail") > 0)
    rest = left.select("n", F.posexplode("tail").alias("pos", "word")).join(dictionary.select("word", "ids").hint("merge"), "word")
    rest = rest.groupBy("n").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ids"))), lambda x: x["ids"]).alias("rest"))
    none = F.array().cast("array<int>")
    ids = F.flatten(F.zip_with("segments", "rest", lambda a, b: F.concat(a, F.coalesce(b, none))))
    return whole.unionByName(left.join(rest, "n").select("doc_id", ids.alias("ids")))


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every row; the ids themselves are not moved."""
    coded, dictionary = _tables(docs, path, id_col, text_col)
    known = F.aggregate("segments", F.lit(0).cast("long"), lambda s, x: s + F.size(x))
    coded = written(coded.select("n", "doc_id", known.alias("known"), "tail"), "counted")
    rest = coded.select("n", F.explode("tail").alias("word")).join(dictionary.select("word", F.size("ids").alias("k")).hint("merge"), "word").groupBy("n").agg(F.sum("k").alias("k"))
    whole = coded.filter(F.size("tail") == 0).select("doc_id", F.col("known").alias("n_tokens"))
    return whole.unionByName(coded.filter(F.size("tail") > 0).join(rest, "n").select("doc_id", (F.col("known") + F.col("k")).alias("n_tokens")))


def pieces(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(id, piece): the vocabulary with its bytes, a table of fixed size."""
    import json

    # The published byte alphabet: printable bytes stand for themselves, the others for code points from 256 on.
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    byte_of = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}
    vocab = json.load(open(vocabulary(path), encoding="utf-8"))["model"]["vocab"]
    rows = [(i, bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()) for piece, i in vocab.items()]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["id", "piece"]), "id int, piece binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids), by a join of ids to pieces; the bytes of a document are put together in order."""
    base = encoded.select(F.monotonically_increasing_id().alias("n"), "doc_id", "ids")
    occ = base.select("n", "doc_id", F.posexplode_outer("ids").alias("pos", "id"))
    got = occ.join(F.broadcast(pieces(encoded.sparkSession, path)), "id", "left").groupBy("n", "doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.hex("piece").alias("h")))).alias("x"))
    return got.select("doc_id", F.decode(F.unhex(F.array_join(F.transform("x", lambda p: F.coalesce(p["h"], F.lit(""))), "")), "UTF-8").alias("text"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id of every document and whether its decoded ids give its text again; a digest of the text goes along with the id."""
    docs = table(spark, sf_dir, "documents").select(F.struct("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest")).alias("id"), "text")
    return decode(encode(docs, id_col="id")).select("doc_id.doc_id", (F.col("doc_id.digest") == F.md5("text")).alias("same"))


SQL = {"p7_round_trip": "SELECT doc_id, true AS same FROM documents"}
