"""Queries: validators, generators, probes, splits, sources and sinks."""

from __future__ import annotations

import bisect
import hashlib

import pandas as pd
from pyspark.sql import functions as F

from corvane.functions import harness
from corvane.functions import text as T
from corvane.operators import generators, probe, split
from corvane.sources import jsonl, sinks
from corvane.store import shared_dir, table
from corvane.streaming import ingest
from corvane.validators import as_udf, grammar, mlir, synth


def programs(spark, d):
    a = table(spark, d, "train_v1").select("row_id", F.col("mlir").alias("text"))
    return a.unionByName(table(spark, d, "ladder").select("row_id", F.col("generated").alias("text"))).filter("text is not null")


def scope_verdicts(spark, d):
    return programs(spark, d).select("row_id", as_udf(mlir.check)(F.col("text"))["passed"].alias("passed"))


def scope_violations(spark, d):
    v = programs(spark, d).select(F.explode(as_udf(mlir.check)(F.col("text"))["violations"]).alias("v"))
    return v.groupBy(F.col("v.kind").alias("kind")).agg(F.count("*").alias("n"))


def parse_verdicts(spark, d):
    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return s.map(mlir.parses)

    return programs(spark, d).select("row_id", run("text").alias("parses"))


def domain_violations(spark, d):
    v = programs(spark, d).select(F.explode(as_udf(mlir.type_domains)(F.col("text"))["violations"]).alias("v"))
    return v.groupBy(F.col("v.name").alias("op")).agg(F.count("*").alias("n"))


def use_sites(spark, d):
    """Per program: uses, and those defined before."""

    @F.pandas_udf("n_uses int, n_defined int")
    def run(s: pd.Series) -> pd.DataFrame:
        sites = s.map(mlir.use_sites)
        return pd.DataFrame({"n_uses": sites.map(len), "n_defined": sites.map(lambda x: sum(y[2] for y in x))})

    return table(spark, d, "train_v1").filter("mlir is not null").select("row_id", run("mlir").alias("u")).select("row_id", "u.*")


def synth_grid(spark, d):
    """Programs over a grid of distances, sizes and depths, generated and checked: all valid, with the distance asked for."""
    grid = None
    for name, values in (("d", (2, 4, 8, 16, 32, 64)), ("n", (1, 3, 6)), ("nesting", (0, 1, 2)), ("seed", (0, 1, 2))):
        axis = spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(name))
        grid = axis if grid is None else grid.crossJoin(axis)  # a grid of settings

    @F.pandas_udf("valid boolean, distance int")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"valid": s.map(lambda t: not synth.check(t)), "distance": s.map(lambda t: max((x[3] for x in synth.distances(t)), default=-1))})

    made = generators.synthetic(grid)
    return made.select("d", "n", "nesting", "seed", run("gold").alias("r")).select("d", "n", "nesting", "seed", "r.*")


def template_pool(spark, d):
    """Generated records by family, with those that the scope validator passes."""
    made = generators.templates(spark, 2000, 7)
    checked = made.select("family", as_udf(mlir.check)(F.col("mlir"))["passed"].alias("ok"))
    return checked.groupBy("family").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"))


def second_pool(spark, d):
    """Generated records of the second set of families mixed into the first: how many of each pass the scope validator and the grammar."""
    made = generators.templates(spark, 3000, 7, second=0.5).filter(F.col("family").isin(*generators.SECOND))

    @F.pandas_udf("boolean")
    def form(s: pd.Series) -> pd.Series:
        return s.map(lambda t: grammar.parses(t, "mlir_c1_c2"))

    checked = made.select("family", as_udf(mlir.check)(F.col("mlir"))["passed"].alias("ok"), form("mlir").alias("form"))
    return checked.groupBy("family").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), F.count_if("form").alias("n_form"))


def stratified_split(spark, d):
    rows = table(spark, d, "train_v1").filter("dialect is not null").select("row_id", "dialect")
    return split.stratified(rows, "row_id", "dialect", {"arith+func": (50, 200), "linalg": (25, 75)}, 3)


def topped_up_pool(spark, d):
    rows = table(spark, d, "eval_pool").select("prompt_id", "source")
    return split.topped_up(rows.filter("source = 'spec'"), rows.filter("source = 'mined'"), "prompt_id", 40, 5)


def group_folds(spark, d):
    return split.folds(table(spark, d, "train_v1").select("row_id", "prompt_id"), "prompt_id", 5, 11)


def probe_accuracy(spark, d):
    """A probe per design on the embeddings, cross-validated over groups, with shuffled labels as control."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 4).alias("grp"), "embedding", (F.col("label") % 2).cast("double").alias("y"))
    both = e.select(F.explode(F.array(F.lit("all"), F.lit("half"))).alias("design"), "id", "grp", "embedding", "y")
    cut = both.withColumn("embedding", F.when(F.col("design") == "half", F.slice("embedding", 1, 16)).otherwise(F.col("embedding")))
    return probe.cross_validated(cut, ["design"], "grp", "embedding", "y", 3)


def hashed_features(spark, d):
    rows = table(spark, d, "gen_out").filter(F.size("tokens") > 0)
    f = rows.select("gen_id", F.explode(probe.hashed_bag(F.col("tokens"), 64)).alias("x"))
    return f.select("gen_id", "x.bucket", F.round("x.weight", 6).alias("weight"))


def last_windows(spark, d):
    rows = table(spark, d, "gen_out").filter(F.size("tokens") > 0)
    return rows.select("gen_id", F.array_join(probe.window_features(F.col("tokens")).cast("array<string>"), " ").alias("features"))


def legal_tokens(spark, d):
    """How many of a row's tokens a packed mask of the ids divisible by three allows."""
    ids = F.transform("tokens", lambda t: F.pmod(t, F.lit(256)))
    words = [sum(1 << (b % 32) for b in range(w * 32, w * 32 + 32) if b % 3 == 0) for w in range(8)]
    mask = F.array(*[F.lit(w).cast("long") for w in words])
    rows = table(spark, d, "gen_out").select("gen_id", ids.alias("ids"), mask.alias("mask"))
    return rows.select("gen_id", F.size(F.filter("ids", lambda t: probe.allowed(F.col("mask"), t))).alias("n_legal"))


def token_entropy(spark, d):
    n = F.size("tokens")
    buckets = F.transform("tokens", lambda t: F.pmod(t, F.lit(16)))
    p = T.let(buckets, lambda bs: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda b: F.size(F.filter(bs, lambda x: x == b)) / F.size(bs)))
    return table(spark, d, "gen_out").filter(n > 0).select("gen_id", F.round(probe.entropy_bits(p), 6).alias("bits"))


def pair_differences(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    pairs = v.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))
    diff = probe.differences(v, pairs, "vec_id", "embedding")
    return diff.select("a", "b", F.round(F.aggregate("diff", F.lit(0.0), lambda s, x: s + x.cast("double") * x), 3).alias("sq"))


def patch_recovery(spark, d):
    rows = table(spark, d, "gen_out").filter("dt is not null")
    r = probe.recovery(F.col("dt"), F.lit(0.3), (F.col("dt") + 0.3) / 2)
    return rows.select("gen_id", F.round(r, 6).alias("recovery"))


def number_outputs(spark, d):
    """Numbers of each answer compared with those of its raw text, within tolerance."""
    a, b = table(spark, d, "ladder").select("gen_id", "generated"), table(spark, d, "gen_out").select("gen_id", "text")
    j = a.join(b, "gen_id").filter("generated is not null and text is not null")
    x, y = T.numbers(F.col("generated")), T.numbers(F.col("text"))
    return j.select("gen_id", F.size(x).alias("n"), T.outputs_equal(x, y).alias("same"))


def content_keys(spark, d):
    return table(spark, d, "train_v1").filter("mlir is not null").select("row_id", T.content_key(F.col("mlir"), F.lit("--verify")).alias("key"))


def jsonl_round_trip(spark, d):
    """The pool written as JSON lines and read by the explicit schema."""
    rows = table(spark, d, "eval_pool")
    path = f"{shared_dir(spark)}/pool-jsonl-{spark.sparkContext.applicationId}-{abs(hash(d))}"
    rows.write.mode("overwrite").json(path)
    return jsonl.load_pool(spark, path).select("prompt_id", "pool", "dialect", "source", "nl", "gold_mlir")


def resumed_log(spark, d):
    """The log appended twice: the second run, over all rows, adds what the first left out and nothing else."""
    import uuid

    path, keys = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}", ["model", "pool", "constraint_stack", "prompt_id"]
    rows = table(spark, d, "ladder").select(*keys)
    sinks.append_new(rows.filter("pool <> 'linalg_big'"), path, keys)
    sinks.append_new(rows, path, keys)
    sinks.append_new(rows, path, keys)
    return spark.read.parquet(path).groupBy("model", "pool").agg(F.count("*").alias("n"))


def upserted_cells(spark, d):
    """Summaries by pool: written, then one pool's partition replaced; the others stay."""
    import uuid

    path = f"{shared_dir(spark)}/cells-{uuid.uuid4().hex}"
    rows = table(spark, d, "ladder").groupBy("pool", "method").agg(F.count("*").alias("n"))
    sinks.replace_partitions(rows, path, ["pool"])
    sinks.replace_partitions(rows.filter("pool = 'spec_mix'").withColumn("n", F.col("n") + 1000), path, ["pool"])
    return spark.read.parquet(path).select("pool", "method", "n")


def replaced_rows(spark, d):
    old = table(spark, d, "model_pins").select("model", "params_m")
    new = old.filter("params_m is null").withColumn("params_m", F.lit(0.0))
    return sinks.replace_tagged(old, new, ["model"])


def verdict_cache(spark, d):
    """Verdicts of distinct programs through a content cache, called twice."""
    import uuid

    path = f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}"
    rows = table(spark, d, "train_v1").filter("mlir is not null").select("row_id", "mlir", T.content_key(F.col("mlir"), F.lit("")).alias("key"))
    compute = lambda r: r.select("key", F.size(T.values(F.col("mlir"))).alias("n_values"))
    sinks.cached_call(rows.filter("row_id % 2 = 0"), "key", path, compute, "key string, n_values int")
    return sinks.cached_call(rows, "key", path, compute, "key string, n_values int").select("row_id", "n_values")


def streamed_log(spark, d):
    """The raw generations ingested as a stream, twice over the same checkpoint: each key once."""
    import uuid

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = table(spark, d, "gen_out").select("gen_id", "model", "attempts")
    rows.write.parquet(f"{base}/in")
    for _ in range(2):
        ingest.ingest(spark, f"{base}/in", rows.schema, f"{base}/out", ["gen_id"], f"{base}/check", "parquet").awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("model").agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"))


def candidate_rows(spark, d):
    rows = table(spark, d, "ladder").select("prompt_id", "model", "seed", "constraint_stack", "row_id", "ingest_seq")
    return jsonl.candidates(rows, None, "_ssd_", 0, ("c1_c2_c3",)).select("prompt_id", "row_id")


def trial_inputs(spark, d):
    """Per gold that the harness can run, and trial: the inputs drawn for it and the driver that runs it, as digests."""

    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()

    @F.pandas_udf("inputs string, driver string")
    def run(pid: pd.Series, trial: pd.Series, name: pd.Series, args: pd.Series, ret: pd.Series) -> pd.DataFrame:
        rows = []
        for p, k, n, a, r in zip(pid, trial, name, args, ret):
            types = list(a)
            values = harness.drawn(str(p), int(k), types)
            made = harness.memref_driver(n, types, values, int(k), r) if any(t.startswith("memref") for t in types) else harness.driver(n, types, values, r)
            rows.append((md5(harness.shown(values)), md5(made)))  # after the driver, whose literals it is told from
        return pd.DataFrame(rows, columns=["inputs", "driver"])

    sig = table(spark, d, "eval_pool").filter("gold_mlir is not null").select("prompt_id", T.public_signature(F.col("gold_mlir")).alias("s"))
    each = sig.filter(T.exclusion(F.col("s")).isNull()).select("prompt_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("trial"), "s")
    # A row is up to some MB of literals, so a small table is spread over all cores.
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return each.repartition(parts, "prompt_id", "trial").select("prompt_id", "trial", run("prompt_id", "trial", "s.name", "s.args", "s.ret").alias("r")).select("prompt_id", "trial", "r.*")


def unwrapped_programs(spark, d):
    """The function inside each program's module, by both rules for a module that never closes."""

    @F.pandas_udf("stripped string, kept string")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"stripped": s.map(harness.unwrap_module), "kept": s.map(lambda t: harness.unwrap_module(t, "keep"))})

    r = programs(spark, d).select("row_id", run("text").alias("r"))
    return r.select("row_id", F.md5("r.stripped").alias("stripped"), (F.col("r.stripped") == F.col("r.kept")).alias("balanced"))


def scope_events(spark, d):
    """Uses and definitions with their places, and how many names are visible at each use."""

    @F.pandas_udf("array<struct<kind: string, name: string, at: int, visible: int>>")
    def run(s: pd.Series) -> pd.Series:
        def one(text):
            events = harness.scope_events(text)
            defs = sorted(v for k, _, _, v in events if k == "def")
            return [{"kind": k, "name": n, "at": a, "visible": bisect.bisect_right(defs, a)} for k, n, a, _ in events]

        return s.map(one)

    e = table(spark, d, "train_v1").filter("mlir is not null").select("row_id", F.explode(run("mlir")).alias("e")).select("row_id", "e.*")
    return e.groupBy("row_id").agg(F.count_if(F.col("kind") == "use").alias("uses"), F.count_if(F.col("kind") == "def").alias("defs"), F.max("visible").alias("most_visible"))


def corrupted_uses(spark, d):
    """Each program with its last use renamed to another name of the program; the scope validator's verdict before and after."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(text):
            events = harness.scope_events(text)
            uses = [a for k, _, a, _ in events if k == "use"]
            return harness.corrupted(text, uses[-1], [*(n for _, n, _, _ in events), "nowhere"]) if uses else text

        return s.map(one)

    rows = table(spark, d, "train_v1").filter("mlir is not null").select("row_id", "mlir", run("mlir").alias("bad"))
    check = as_udf(mlir.check)
    return rows.select("row_id", (F.col("mlir") != F.col("bad")).alias("changed"), check("mlir")["passed"].alias("before"), check("bad")["passed"].alias("after"))


def surface_baseline(spark, d):
    """A one-rule baseline for parse_valid from surface features alone: the majority outcome of each (length band, ends in a brace) cell."""
    rows = table(spark, d, "ladder").filter("generated is not null").select(F.floor(F.length("generated") / 200).alias("band"), F.rtrim("generated").endswith("}").alias("closed"), F.col("parse_valid").cast("int").alias("y"))
    cell = rows.groupBy("band", "closed").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    return cell.agg(F.sum("n").alias("n"), F.round(F.sum(F.greatest("pos", F.col("n") - F.col("pos"))) / F.sum("n"), 6).alias("accuracy"))


def windowed_stream(spark, d):
    """Daily rates of the event stream, by a streaming aggregation with a watermark."""
    import uuid

    out = f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    src = f"{out}-in"
    table(spark, d, "events").write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("ok", F.col("value") > 50)
    rates = ingest.windowed_rates(stream, "ts", "1 day", "2 days", ["event_type"], "ok")
    q = rates.writeStream.outputMode("complete").foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(out)).option("checkpointLocation", f"{out}-check").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).select(F.unix_timestamp("start").alias("start"), "event_type", "n", "n_ok")


QUERIES = {
    f.__name__: f
    for f in (
        trial_inputs, unwrapped_programs, scope_events, corrupted_uses, surface_baseline, windowed_stream, scope_verdicts, scope_violations, parse_verdicts, domain_violations, use_sites, synth_grid, template_pool, second_pool, stratified_split, topped_up_pool, group_folds, probe_accuracy, hashed_features, last_windows, legal_tokens,
        token_entropy, pair_differences, patch_recovery, number_outputs, content_keys, jsonl_round_trip, resumed_log, upserted_cells, replaced_rows, verdict_cache, streamed_log, candidate_rows,
    )
}

_NUMS = r"list_transform(regexp_extract_all({c}, '-?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|nan|inf)'), lambda x: x::DOUBLE)"
SQL = {
    "surface_baseline": "WITH c AS (SELECT length(generated) // 200 AS band, rtrim(generated, ' ') LIKE '%}' AS closed, count(*) AS n, sum(parse_valid::INT) AS pos FROM ladder WHERE generated IS NOT NULL GROUP BY 1, 2) SELECT sum(n) AS n, round(sum(greatest(pos, n - pos)) / sum(n), 6) AS accuracy FROM c",
    "windowed_stream": "SELECT epoch(date_trunc('day', ts))::BIGINT AS start, event_type, count(*) AS n, count(*) FILTER (value > 50) AS n_ok FROM events GROUP BY 1, 2",
    "synth_grid": "SELECT d, n, nesting, seed, true AS valid, d::INT AS distance FROM unnest([2, 4, 8, 16, 32, 64]) AS a(d), unnest([1, 3, 6]) AS b(n), unnest([0, 1, 2]) AS c(nesting), unnest([0, 1, 2]) AS e(seed)",
    "stratified_split": "SELECT row_id, dialect, CASE WHEN r <= q THEN 'dev' ELSE 'train' END AS split FROM (SELECT row_id, dialect, CASE dialect WHEN 'linalg' THEN 25 ELSE 50 END AS q, row_number() OVER (PARTITION BY dialect ORDER BY md5('3:' || row_id), row_id) AS r FROM train_v1 WHERE dialect IN ('arith+func', 'linalg')) WHERE r <= q * CASE dialect WHEN 'linalg' THEN 4 ELSE 5 END",
    "topped_up_pool": "SELECT prompt_id, source FROM eval_pool WHERE source IN ('spec', 'mined') ORDER BY source = 'mined', md5('5:' || prompt_id), prompt_id LIMIT 40",
    "group_folds": "WITH g AS (SELECT prompt_id, (row_number() OVER (ORDER BY md5('11:' || prompt_id), prompt_id) - 1) % 5 AS fold FROM (SELECT DISTINCT prompt_id FROM train_v1)) SELECT row_id, prompt_id, fold FROM train_v1 JOIN g USING (prompt_id)",
    "hashed_features": "SELECT gen_id, b AS bucket, round(ln(1 + count(*)), 6) AS weight FROM (SELECT gen_id, unnest(tokens) % 64 AS b FROM gen_out) GROUP BY 1, 2",
    "last_windows": "WITH w AS (SELECT gen_id, tokens[greatest(1, len(tokens) - 3):] AS t FROM gen_out WHERE len(tokens) > 0) SELECT gen_id, array_to_string(list_transform(range(1, len(t) + 1), lambda i: (i - 1) * 512 + t[i] % 512), ' ') AS features FROM w",
    "legal_tokens": "SELECT gen_id, len(list_filter(tokens, lambda t: (t % 256) % 3 = 0)) AS n_legal FROM gen_out",
    "token_entropy": "WITH b AS (SELECT gen_id, x, count(*) AS c FROM (SELECT gen_id, unnest(tokens) % 16 AS x FROM gen_out) GROUP BY 1, 2), n AS (SELECT gen_id, sum(c) AS n FROM b GROUP BY 1) SELECT gen_id, round(-sum(c / n * log2(c / n)), 6) + 0.0 AS bits FROM b JOIN n USING (gen_id) GROUP BY 1",
    "pair_differences": "SELECT a.vec_id AS a, b.vec_id AS b, round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: (a.embedding[i] - b.embedding[i])::DOUBLE * (a.embedding[i] - b.embedding[i]))), 3) AS sq FROM embeddings a JOIN embeddings b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1",
    "patch_recovery": "SELECT gen_id, round(CASE WHEN dt - 0.3 > 0.1 THEN ((dt + 0.3) / 2 - 0.3) / (dt - 0.3) END, 6) AS recovery FROM gen_out WHERE dt IS NOT NULL",
    "number_outputs": f"WITH j AS (SELECT gen_id, {_NUMS.format(c='generated')} AS x, {_NUMS.format(c='text')} AS y FROM ladder JOIN gen_out USING (gen_id) WHERE generated IS NOT NULL AND text IS NOT NULL) SELECT gen_id, len(x) AS n, len(x) = len(y) AND len(list_filter(range(1, len(x) + 1), lambda i: NOT (x[i] = y[i] OR abs(x[i] - y[i]) <= 1e-5 + 1e-4 * greatest(abs(x[i]), abs(y[i]))))) = 0 AS same FROM j",
    "content_keys": "SELECT row_id, sha256(encode(mlir) || '\\x00'::BLOB || encode('--verify')) AS key FROM train_v1 WHERE mlir IS NOT NULL",
    "jsonl_round_trip": "SELECT prompt_id, pool, dialect, source, nl, gold_mlir FROM eval_pool",
    "resumed_log": "SELECT model, pool, count(*) AS n FROM (SELECT DISTINCT model, pool, constraint_stack, prompt_id FROM ladder) GROUP BY 1, 2",
    "upserted_cells": "SELECT pool, method, count(*) + CASE WHEN pool = 'spec_mix' THEN 1000 ELSE 0 END AS n FROM ladder GROUP BY 1, 2",
    "replaced_rows": "SELECT model, coalesce(params_m, 0.0) AS params_m FROM model_pins",
    "verdict_cache": "SELECT row_id, len(list_distinct(regexp_extract_all(mlir, '%[A-Za-z0-9_$.]+'))) AS n_values FROM train_v1 WHERE mlir IS NOT NULL",
    "streamed_log": "SELECT model, count(*) AS n, sum(attempts) AS attempts FROM gen_out GROUP BY 1",
    "candidate_rows": "SELECT prompt_id, arg_max(row_id, ingest_seq) AS row_id FROM ladder WHERE contains(model, '_ssd_') AND (seed IS NULL OR seed = 0) AND constraint_stack = 'c1_c2_c3' GROUP BY 1",
}
