"""Problem 2: records that differ only in layout, letter case, punctuation or the order of unordered parts.

A text is a small tree: the root's children are, in order, runs of text and `attributes {...}` nodes, whose entries are
unordered. Leaves are normalised (letters and digits of any script, lower case) and hashed; the child digests of an
unordered node are sorted; the root's digest is that of its children's. Rows are grouped by root digest, which is
pre-aggregated before the shuffle, and each row is confirmed against the first of its group by the full canonical form.

Null texts and empty ones (no letter or digit outside code fence marks) don't count. Repeated rows are copies; equal row_ids
give no row. Very long texts are handled whole. The digest has 128 bits; a collision would be found by the confirmation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import let
from corvane.store import table, written

NODE = r"(?iU)\battributes\s*\{((?:[^{}]|\{[^{}]*\})*)\}"
FENCE = r"(`{3,}|~{3,})[A-Za-z0-9_+-]*"


def leaf(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def is_empty(text: Column) -> Column:
    """Null, or neither a line of program nor a word of prose: blanks, punctuation, a bare code fence."""
    return text.isNull() | ~(F.left(F.ltrim(text), F.lit(1)).rlike("[A-Za-z0-9]") | F.regexp_replace(text, FENCE, "").rlike(r"[\p{L}\p{N}]"))


def canonical(text: Column) -> Column:
    """array<array<string>>: ordered children; an unordered node has its sorted leaves, a run of text has one."""
    entries = lambda node: F.array_sort(F.filter(F.transform(F.split(node, ","), leaf), lambda e: e != ""))
    child = lambda run, i, nodes: F.when(i < F.size(nodes), F.concat(F.array(F.concat(leaf(run), F.lit("attributes"))), entries(F.get(nodes, i)))).otherwise(F.array(leaf(run)))
    return let(F.regexp_extract_all(text, F.lit(NODE), F.lit(1)), lambda nodes: F.transform(F.split(text, NODE, -1), lambda run, i: child(run, i, nodes)))


def root(canon: Column) -> Column:
    """128 bits as two longs' worth of a hexadecimal digest, built bottom-up."""
    node = lambda leaves: F.md5(F.concat_ws(",", F.concat(F.slice(leaves, 1, 1), F.array_sort(F.transform(F.slice(leaves, 2, 1 << 30), lambda x: F.md5(x))))))
    return F.unhex(F.md5(F.concat_ws(";", F.transform(canon, node))))


def collapse(rows: DataFrame) -> DataFrame:
    """(row_id, text) -> (first_row_id, row_id, copies) of each row in a group of two or more; copies counts the group's rows."""
    base = rows.filter(~is_empty(F.col("text"))).select("row_id", canonical(F.col("text")).alias("canon")).withColumn("digest", root(F.col("canon")))
    base = written(base, "records")  # the forms are computed once; the grouping then reads digests only
    groups = base.groupBy("digest").agg(F.min("row_id").alias("first_row_id"), F.count("*").alias("copies")).filter("copies > 1")
    members = base.join(groups, "digest")
    firsts = members.filter("row_id = first_row_id").dropDuplicates(["first_row_id"]).select("digest", F.col("canon").alias("of_first"))
    return members.join(firsts, "digest").filter(F.col("canon") == F.col("of_first")).select("first_row_id", "row_id", "copies")


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """train_v1.mlir and ladder.generated as one collection (row_id, text)."""
    a = table(spark, sf_dir, "train_v1").select("row_id", F.col("mlir").alias("text"))
    return a.unionByName(table(spark, sf_dir, "ladder").select("row_id", F.col("generated").alias("text")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(programs(spark, sf_dir)).filter("row_id > first_row_id").select("first_row_id", "row_id")


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each row_id that stands for a record with copies, how many rows hold it."""
    return collapse(programs(spark, sf_dir)).filter("row_id = first_row_id").select("row_id", "copies").distinct()


_CANON = r"""
  WITH rows_ AS (SELECT row_id, mlir AS t FROM train_v1 UNION ALL SELECT row_id, generated FROM ladder),
  kept AS (SELECT row_id, t, regexp_extract_all(t, '(?i)\battributes\s*\{((?:[^{}]|\{[^{}]*\})*)\}', 1) AS nodes,
           string_split(regexp_replace(t, '(?i)\battributes\s*\{((?:[^{}]|\{[^{}]*\})*)\}', chr(1), 'g'), chr(1)) AS runs
           FROM rows_ WHERE regexp_matches(regexp_replace(t, '(`{3,}|~{3,})[A-Za-z0-9_+-]*', '', 'g'), '[\p{L}\p{N}]')),
  canon AS (SELECT row_id, array_to_string(list_transform(range(1, len(runs) + 1), lambda i:
      lower(regexp_replace(runs[i], '[^\p{L}\p{N}]+', '', 'g')) || CASE WHEN i <= len(nodes) THEN 'attributes|' || array_to_string(list_sort(list_filter(
      list_transform(string_split(nodes[i], ','), lambda e: lower(regexp_replace(e, '[^\p{L}\p{N}]+', '', 'g'))), lambda e: e <> '')), ',') ELSE '' END), ';') AS c FROM kept),
  g AS (SELECT c, min(row_id) AS first_row_id, count(*) AS copies FROM canon GROUP BY c HAVING count(*) > 1)
"""
SQL = {
    "p2_found": _CANON + "SELECT first_row_id, row_id FROM canon JOIN g USING (c) WHERE row_id > first_row_id",
    "p2_records": _CANON + "SELECT first_row_id AS row_id, copies FROM g",
}
