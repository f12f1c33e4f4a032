"""JSON-lines sources, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POOL = "prompt_id int, pool string, dialect string, source string, nl string, gold_mlir string, mlir string, id string"


def load_pool(spark: SparkSession, path: str | list[str], schema: str = POOL) -> DataFrame:
    """The rows of one or more files; blank lines are skipped, malformed ones are an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def load_set(spark: SparkSession, path: str, schema: str = POOL) -> DataFrame:
    """A benchmark file; a missing prompt_id is the row's place in the file. Read as one text, since places are asked for: a
    benchmark is small by nature. Use load_pool for corpora."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")).alias("place", "line"))
    rows = lines.select("place", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("place", "r.*")
    return rows.withColumn("prompt_id", F.coalesce("prompt_id", "place")).drop("place")


def load_protected(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(src, nl, mlir) of all protected files; mlir falls back to gold_mlir. A missing file is an error, and
    so is a malformed line, since either would protect nothing."""
    rows = spark.read.schema(POOL).option("mode", "FAILFAST").json(paths)
    return rows.select(F.col("_metadata.file_path").alias("src"), F.coalesce("nl", F.lit("")).alias("nl"), F.coalesce("mlir", "gold_mlir", F.lit("")).alias("mlir"))


def spec_rows(rows: DataFrame, dialect: str) -> DataFrame:
    return rows.select(F.lit(dialect).alias("dialect"), F.concat(F.lit("spec:"), "id").alias("source"), "nl", F.col("mlir").alias("gold_mlir"))


def test_files(spark: SparkSession, root: str, suffix: str = "mlir") -> DataFrame:
    """(path, text) of all files below root with the suffix, those named invalid left out; texts that aren't UTF-8 are dropped."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}").load(root)
    ok = raw.filter(~F.lower(F.substring_index("path", "/", -1)).contains("invalid")).filter(F.is_valid_utf8(F.col("content").cast("string")))
    return ok.select("path", F.col("content").cast("string").alias("text"))


def pin_list(spark: SparkSession, path: str) -> DataFrame:
    """(repo, sha) of a list of repo@sha lines; comments and blank lines are skipped."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*", "")).alias("v")).filter("v <> ''")
    return lines.select(F.substring_index("v", "@", 1).alias("repo"), F.when(F.col("v").contains("@"), F.substring_index("v", "@", -1)).alias("sha"))


def candidates(rows: DataFrame, dialect: str | None = None, model_part: str | None = None, seed: int | None = None, stacks: tuple[str, ...] | None = None, order: str = "ingest_seq") -> DataFrame:
    """One candidate per prompt, the last written; rows without a seed or a stack pass those filters."""
    if dialect is not None:
        rows = rows.filter(F.col("dialect") == dialect)
    if model_part is not None:
        rows = rows.filter(F.col("model").contains(model_part))
    if seed is not None:
        rows = rows.filter(F.col("seed").isNull() | (F.col("seed") == seed))
    if stacks is not None:
        rows = rows.filter(F.col("constraint_stack").isNull() | F.col("constraint_stack").isin(*stacks))
    rest = [c for c in rows.columns if c != "prompt_id"]
    return rows.groupBy("prompt_id").agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select("prompt_id", "_r.*")


def parse_cells(specs: list[str], revisions: dict[str, str] | None = None) -> list[dict]:
    """Cells of a grid from 'TAG MODEL [CKPT]': tag, model, its pinned revision, ckpt and whether it is trained. Other forms, and a tag
    that is there already, are errors."""
    out: list[dict] = []
    for spec in specs:
        parts = spec.split()
        if len(parts) not in (2, 3):
            raise ValueError(f"a cell is TAG MODEL [CKPT], not {spec!r}")
        if any(c["tag"] == parts[0] for c in out):
            raise ValueError(f"tag {parts[0]!r} is there already")
        out.append({"tag": parts[0], "model": parts[1], "revision": (revisions or {}).get(parts[1]), "ckpt": parts[2] if len(parts) == 3 else None, "trained": len(parts) == 3})
    return out
