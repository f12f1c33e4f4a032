"""Queries: evaluation logs, samples, fits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import fit, ladder, passk, stats
from corvane.plans.pool import known_ops
from corvane.store import table

#: Resamples of the queries, as in the studied statistics; of the size fit.
RESAMPLES, SIZE_RESAMPLES = 10_000, 2000
#: How many prompts of each pool of the test tables are of the specification.
SPEC_ROWS = {"arith_func_big": 24, "linalg_big": 30}


def cells(spark, d, *keep):
    return ladder.latest(table(spark, d, "ladder"), keep=list(keep))


def ladder_latest(spark, d):
    return cells(spark, d, "row_id").select(*ladder.CELL, "row_id")


def ladder_summary(spark, d):
    return ladder.summary(cells(spark, d, "parse_valid", "verify_valid", "attempts", "dt", "finished"), ["model", "pool", "constraint_stack"], RESAMPLES)


def _rounded(df, *cols):
    return df.select(*[F.round(c, 6).alias(c) if c in ("point", "ci_low", "ci_high", "p_value") else c for c in cols])


def ladder_deltas(spark, d):
    counts = stats.pair_counts(ladder.rung_pairs(cells(spark, d, "verify_valid")), ["model", "pool", "rung"])
    got = stats.pair_count_interval(counts, RESAMPLES)
    return got.select("model", "pool", "rung", F.col("n").alias("n_pairs"), F.round(100 * F.col("point"), 6).alias("pp"), F.round("p_value", 6).alias("p_value"))


def rates(spark, d, keys):
    return cells(spark, d, "verify_valid", *keys).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("verify_valid").alias("s"))


def rate_intervals(spark, d):
    return _rounded(stats.count_interval(rates(spark, d, ["method", "constraint_stack"]), RESAMPLES), "method", "constraint_stack", "n", "point", "ci_low", "ci_high")


def rank_intervals(spark, d):
    return _rounded(stats.count_interval(rates(spark, d, ["method"]), RESAMPLES, ranks=True), "method", "ci_low", "ci_high")


def delta_intervals(spark, d):
    counts = stats.pair_counts(ladder.rung_pairs(cells(spark, d, "verify_valid")), ["rung"])
    return _rounded(stats.pair_count_interval(counts, RESAMPLES), "rung", "n", "point", "ci_low", "ci_high", "p_value")


def numpy_intervals(spark, d):
    """The row bootstrap on numpy's own draws, a group of the benchmark at a time."""
    rows = cells(spark, d, "method", "row_id", "verify_valid").withColumn("ok", F.col("verify_valid").cast("double"))
    return stats.numpy_interval(rows, ["method", "constraint_stack"], "row_id", "ok", None, RESAMPLES)


def flagged(spark, d, *keep):
    known = known_ops(spark, d)
    return ladder.flags(cells(spark, d, "generated", "parse_valid", "verify_valid", "scope_passed_per_try", "error", *keep).crossJoin(F.broadcast(known)), F.col("known"))  # one row: the vocabulary


def residual_rates(spark, d):
    return ladder.flag_rates(flagged(spark, d), ["pool", "constraint_stack"])


def category_histogram(spark, d):
    return flagged(spark, d).groupBy("constraint_stack", "cat").agg(F.count("*").alias("n"))


def residuals(spark, d):
    return ladder.residual_pairs(flagged(spark, d)).groupBy("pool", "layer").agg(F.count("*").alias("n"), F.round(100 * (F.avg("a") - F.avg("b")), 6).alias("pp"))


def residuals_by_subset(spark, d):
    pairs = ladder.residual_pairs(flagged(spark, d)).filter("layer = 'v3'")
    out = None
    for which in ("all", "spec", "mined"):
        x = ladder.subset(pairs, which, SPEC_ROWS).groupBy("pool").agg(F.count("*").alias("n"), F.round(100 * (F.avg("a") - F.avg("b")), 6).alias("pp")).withColumn("which", F.lit(which))
        out = x if out is None else out.unionByName(x)
    return out


def conditional_residual(spark, d):
    """Scope residual over prompts whose free output parses."""
    p = ladder.residual_pairs(flagged(spark, d)).filter("layer = 'v3' and free_parses = 1")
    return p.groupBy("pool").agg(F.count("*").alias("n"), F.round(100 * (F.avg("a") - F.avg("b")), 6).alias("pp"))


def internalized_gate(spark, d):
    """Per model, pool and layer: the rate without constraints, the residual with its interval, and whether what the constraint holds back
    has gone without it."""
    pairs = ladder.residual_pairs(flagged(spark, d))
    keys = ["model", "pool", "layer"]
    counts = stats.pair_counts(pairs, keys).join(pairs.groupBy(*keys).agg(F.round(F.avg("a"), 6).alias("free_rate")), keys)
    return _rounded(ladder.internalized(stats.pair_count_interval(counts, RESAMPLES)), *keys, "n", "free_rate", "point", "ci_low", "ci_high", "internalized")


def resume_todo(spark, d):
    wanted = table(spark, d, "model_pins").select("model").crossJoin(table(spark, d, "eval_pool").select("pool", "prompt_id"))  # the campaign's grid: what is to run
    return ladder.todo(wanted, table(spark, d, "ladder"), ["model", "pool", "prompt_id"])


def completed_cells(spark, d):
    have = cells(spark, d).groupBy("model", "pool", "constraint_stack").agg(F.countDistinct("prompt_id").alias("n_done"))
    want = table(spark, d, "eval_pool").groupBy("pool").agg(F.count("*").alias("n_pool"))
    return have.join(want, "pool").select("model", "pool", "constraint_stack", "n_done", (F.col("n_done") == F.col("n_pool")).alias("done"))


def ablation_grid(spark, d):
    """Settings of each model against each stack and method, those already covered by a base row marked."""
    pins = table(spark, d, "model_pins").select("family", "method").distinct()
    grid = pins.crossJoin(spark.range(4).select(F.element_at(F.array(*map(F.lit, ("none", "c1", "c1_c2", "c1_c2_c3"))), (F.col("id") + 1).cast("int")).alias("constraint_stack")))
    base = table(spark, d, "ladder").join(table(spark, d, "model_pins").select("model", "family"), "model").select("family", "method", "constraint_stack").distinct().withColumn("covered", F.lit(True))
    return grid.join(base, ["family", "method", "constraint_stack"], "left").select("family", "method", "constraint_stack", F.concat_ws("__", "family", "method", "constraint_stack").alias("tag"), F.coalesce("covered", F.lit(False)).alias("covered"))


def samples(spark, d):
    return passk.numbered(table(spark, d, "ladder").select("model", "prompt_id", "ingest_seq", "verify_valid", "attempts", "constraint_stack"), ["model", "prompt_id"], ["ingest_seq"])


def hits(spark, d):
    return passk.first_hits(samples(spark, d), ["model", "prompt_id"], "verify_valid")


def passk_first_hits(spark, d):
    return hits(spark, d)


def passk_curve(spark, d):
    return passk.curve(hits(spark, d), ["model"], 6)


def passk_grid(spark, d):
    return passk.curve(hits(spark, d), ["model"], 4).filter(F.col("k").isin(1, 2, 4))


def passk_overlap(spark, d):
    greedy = table(spark, d, "ladder").filter("verify_valid and constraint_stack = 'c1_c2_c3'")
    return passk.overlap(greedy, hits(spark, d).filter("first_hit <= 2"), ["model", "prompt_id"])


def sampled_pass1(spark, d):
    per_prompt = samples(spark, d).groupBy("model", "prompt_id").agg(F.avg(F.col("verify_valid").cast("double")).alias("p"))
    return per_prompt.groupBy("model").agg(F.count("*").alias("prompts"), F.round(F.avg("p"), 6).alias("pass1"))


def sampled_pass1_intervals(spark, d):
    """Sampled pass@1 with an interval by resampling prompts."""
    per_prompt = samples(spark, d).groupBy("model", "prompt_id").agg(F.avg(F.col("verify_valid").cast("double")).alias("p"))
    return _rounded(stats.value_interval(per_prompt, ["model"], "p", RESAMPLES), "model", "n", "point", "ci_low", "ci_high")


def _token_gaps(spark, d):
    """(model, prompt_id, gap): the mean difference per token of two series of a prompt, its first and its last generation; a token's
    score is made of its id. Series of unequal or no length give none."""
    one = table(spark, d, "gen_out").groupBy("model", "prompt_id").agg(F.min_by("tokens", "gen_id").alias("a"), F.max_by("tokens", "gen_id").alias("b"))
    score = lambda c: F.transform(c, lambda t: -F.log(t + 1.0))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    gap = total(F.zip_with(score("a"), score("b"), lambda x, y: x - y)) / F.size("a")
    return one.select("model", "prompt_id", F.when((F.size("a") > 0) & (F.size("a") == F.size("b")), gap).alias("gap"))


def token_gaps(spark, d):
    """Per model: prompts, those with two series of one length, and the mean of their mean differences per token."""
    return _token_gaps(spark, d).groupBy("model").agg(F.count("*").alias("n"), F.count("gap").alias("n_used"), F.round(F.avg("gap"), 6).alias("gap"))


def token_gap_intervals(spark, d):
    return _rounded(stats.value_interval(_token_gaps(spark, d), ["model"], "gap", SIZE_RESAMPLES), "model", "n", "point", "ci_low", "ci_high")


def next_sample(spark, d):
    per = samples(spark, d).groupBy("model", "prompt_id").agg((F.max("sample") + 1).alias("next"))
    return per.groupBy("model").agg(F.min("next").cast("int").alias("start"))


def first_divergence(spark, d):
    tries = table(spark, d, "ladder").select("model", "row_id", F.posexplode("scope_passed_per_try").alias("trial", "ok"))
    return tries.filter("not ok").groupBy("model", "row_id").agg(F.min("trial").alias("first_fail"))


def retry_outcome(spark, d):
    tries = table(spark, d, "ladder").select("row_id", F.posexplode("scope_passed_per_try").alias("attempt", "ok"))
    return passk.first_ok(tries, ["row_id"], "ok", "attempt")


def group_advantages(spark, d):
    rows = table(spark, d, "ladder").select("row_id", "prompt_id", "verify_valid", "attempts")
    got = passk.advantages(rows, "prompt_id", F.col("verify_valid").cast("double") / F.greatest("attempts", F.lit(1)))
    return got.select("row_id", F.round("adv", 6).alias("adv"))


def replaced_lowest(spark, d):
    rows = table(spark, d, "ladder").select("row_id", "prompt_id", (F.col("verify_valid").cast("int") * 100 - F.col("attempts")).alias("reward"))
    return passk.without_lowest(rows, "prompt_id", "reward", "row_id", 2).select("row_id")


def best_checkpoint(spark, d):
    per = cells(spark, d, "ckpt", "verify_valid").join(table(spark, d, "model_pins").select("model", "family"), "model").groupBy("family", "ckpt").agg(F.avg(F.col("verify_valid").cast("double")).alias("rate"), F.count("*").alias("n"))
    best = F.max_by(F.struct("ckpt", "rate", "n"), F.struct("rate", "n", "ckpt"))
    return per.groupBy("family").agg(best.alias("b")).select("family", "b.ckpt", F.round("b.rate", 6).alias("rate"), "b.n")


def error_histogram(spark, d):
    rows = table(spark, d, "ladder").filter("error is not null").join(table(spark, d, "eval_pool").select("prompt_id", "dialect"), "prompt_id", "left")
    return rows.groupBy("model", "constraint_stack", "dialect", T.error_category(F.col("error")).alias("category")).agg(F.count("*").alias("n"))


def attempt_reasons(spark, d):
    """Why rows didn't pass, by the first gate that stopped them."""
    reason = F.when(F.col("error").isNotNull(), "error").when(~F.col("parse_valid"), "parse_fail").when(F.exists("scope_passed_per_try", lambda x: ~x), "scope_retry").when(~F.col("verify_valid"), "verify_fail").otherwise("pass")
    return table(spark, d, "ladder").groupBy("method", reason.alias("reason")).agg(F.count("*").alias("n"))


def family_gate(spark, d):
    rows = cells(spark, d, "parse_valid", "verify_valid").join(table(spark, d, "model_pins").select("model", "family"), "model")
    n = F.count("*")
    return rows.groupBy("family").agg(n.alias("n"), F.count_if(~F.col("parse_valid")).alias("parse_fail"), F.count_if(F.col("parse_valid") & ~F.col("verify_valid")).alias("verify_fail"), F.count_if(F.col("verify_valid")).alias("passed"), F.round(F.count_if(F.col("verify_valid")) / n, 6).alias("pass_rate"))


def dialect_rollup(spark, d):
    rows = cells(spark, d, "verify_valid").join(table(spark, d, "eval_pool").select("prompt_id", "dialect"), "prompt_id")
    return rows.rollup("dialect").agg(F.grouping("dialect").cast("int").alias("is_total"), F.count("*").alias("n"), F.round(F.avg(F.col("verify_valid").cast("double")), 6).alias("verify_rate"))


def dev_rollup(spark, d):
    squeezed = F.md5(F.trim(F.regexp_replace("generated", r"\s+", " ")))
    return cells(spark, d, "generated", "n_tokens", "finished").groupBy("model").agg(F.count("*").alias("n"), F.countDistinct(squeezed).alias("distinct_programs"), F.round(F.avg("n_tokens"), 6).alias("mean_len"), F.count_if(~F.coalesce("finished", F.lit(True))).alias("unfinished"))


def token_curve(spark, d):
    """Mean token id at each place up to the longest row's last: a ragged mean."""
    return table(spark, d, "gen_out").select(F.posexplode("tokens").alias("pos", "tok")).groupBy("pos").agg(F.count("*").alias("n"), F.round(F.avg("tok"), 6).alias("mean"))


def candidate_status(spark, d):
    """Each prompt of the pool against one model's answers: scored, missing, or asked with another prompt."""
    one = cells(spark, d, "method", "nl", "verify_valid", "row_id").filter("constraint_stack = 'c1_c2_c3' and method = 'sft'").groupBy("prompt_id").agg(F.max_by(F.struct("nl", "verify_valid"), F.col("row_id")).alias("c"))
    pool = table(spark, d, "eval_pool").join(one, "prompt_id", "left")
    status = F.when(F.col("c").isNull(), "no_candidate_row").when(F.trim("c.nl") != F.trim("nl"), "nl_mismatch").when(F.col("gold_mlir").isNull(), "no_reference").otherwise("scored")
    return pool.select("prompt_id", status.alias("status"))


def gold_positions(spark, d):
    w = Window.orderBy("prompt_id")  # the pool's file order; the pool is the benchmark, not the corpus
    return table(spark, d, "eval_pool").select("prompt_id", (F.row_number().over(w) - 1).alias("position"))


def task_parts(spark, d):
    """Of each answer to a prompt with a gold: how far its signature and its operations are the gold's."""
    gold = table(spark, d, "eval_pool").filter("gold_mlir is not null").select("prompt_id", "gold_mlir")
    rows = table(spark, d, "ladder").filter("generated is not null").select("row_id", "prompt_id", "generated", "parse_valid", "verify_valid", "scope_passed_per_try").join(gold, "prompt_id")
    parts = rows.withColumn("sig", T.signature_score(F.col("generated"), F.col("gold_mlir"))).withColumn("a", T.body_ops(F.col("generated"))).withColumn("b", T.body_ops(F.col("gold_mlir")))
    return parts.select("row_id", "parse_valid", "verify_valid", "scope_passed_per_try", "sig", T.multiset_jaccard(F.col("a"), F.col("b")).alias("jac"))


def task_rewards(spark, d):
    return task_parts(spark, d).select("row_id", F.round("sig", 6).alias("sig"), F.round("jac", 6).alias("jac"), F.round(F.when(F.col("verify_valid"), F.col("sig") * F.col("jac")).otherwise(0.0), 6).alias("reward"))


def signature_matches(spark, d):
    gold = table(spark, d, "eval_pool").filter("gold_mlir is not null").select("prompt_id", T.public_signature(F.col("gold_mlir")).alias("g"))
    rows = table(spark, d, "ladder").filter("generated is not null").select("prompt_id", T.public_signature(F.col("generated")).alias("c")).join(gold, "prompt_id")
    return rows.groupBy(T.signature_match(F.col("g"), F.col("c")).alias("match")).agg(F.count("*").alias("n"))


def model_tags(spark, d):
    tag = r"^(.*)_(ssd|rft|grpo|sft)_s(\d+)$"
    rows = table(spark, d, "model_pins")
    return rows.select("model", F.when(F.col("model").rlike(tag), F.regexp_extract("model", tag, 1)).alias("base"), F.when(F.col("model").rlike(tag), F.regexp_extract("model", tag, 2)).alias("tuned"), F.coalesce("params_m", F.regexp_extract("model", r"(\d+)m", 1).try_cast("double")).alias("size_m"))


def points(spark, d):
    pins = table(spark, d, "model_pins").select("model", "family", "params_m").filter("params_m is not null")
    t = cells(spark, d, "train_seed", "verify_valid").join(pins, "model").join(table(spark, d, "eval_pool").select("prompt_id", F.length("nl").alias("len")), "prompt_id")
    return t.withColumn("d", F.floor(F.col("len") / 100) + 1)


def seed_averages(spark, d):
    per = points(spark, d).groupBy("family", "params_m", "d", "train_seed").agg(F.avg((~F.col("verify_valid")).cast("double")).alias("residual"))
    got = fit.seed_average(per, ["family", "params_m", "d"], "residual")
    return got.select("family", "params_m", "d", F.round("residual", 6).alias("residual"), "n_seeds")


def size_fits(spark, d):
    per = points(spark, d).groupBy("family", "params_m").agg(F.avg((~F.col("verify_valid")).cast("double")).alias("residual"))
    got = fit.log_fit(per, ["family"], F.col("params_m"), F.col("residual")).filter("n >= 2")
    return got.select("family", *[F.round(c, 5).alias(c) for c in ("a", "beta", "r2")], "n", "n_clipped", "degenerate")


def power_law(spark, d):
    per = points(spark, d).groupBy("params_m", "d").agg(F.avg((~F.col("verify_valid")).cast("double")).alias("residual"))
    got = fit.power_law(per, F.col("d"), F.col("params_m"), F.col("residual"))
    return got.select(*[F.round(c, 5).alias(c) for c in ("a", "alpha", "beta", "r2")], "n", "n_clipped")


def size_fit_resamples(spark, d):
    """The size exponent refitted on resamples of prompts that all models share."""
    per = points(spark, d).groupBy("prompt_id", "params_m").agg(F.avg((~F.col("verify_valid")).cast("double")).alias("r"))
    ids = per.select("prompt_id").distinct().withColumn("i", F.row_number().over(Window.orderBy("prompt_id")) - 1)  # the benchmark's prompts
    n = ids.agg(F.count("*").alias("n"))
    picks = ids.select("i").crossJoin(F.broadcast(n)).select(F.explode(F.sequence(F.lit(0), F.lit(SIZE_RESAMPLES - 1))).alias("b"), "i", "n").select("b", stats.draw(F.col("b"), F.col("i"), F.col("n")).alias("i"))
    means = picks.join(ids, "i").join(per, "prompt_id").groupBy("b", "params_m").agg(F.avg("r").alias("residual"))
    return fit.log_fit(means, ["b"], F.col("params_m"), F.col("residual")).select("b", F.round("beta", 5).alias("beta"), "n")


def detectable_effects(spark, d):
    n = table(spark, d, "ladder").groupBy("method").agg(F.count("*").alias("n"))
    z = stats.min_detectable_effect(1)
    return n.select("method", "n", F.round(F.lit(z) / F.sqrt("n"), 6).alias("mde"))


QUERIES = {
    f.__name__: f
    for f in (
        ladder_latest, ladder_summary, ladder_deltas, rate_intervals, rank_intervals, delta_intervals, numpy_intervals, residual_rates, category_histogram, residuals, residuals_by_subset, conditional_residual,
        internalized_gate, resume_todo, completed_cells, ablation_grid, passk_first_hits, passk_curve, passk_grid, passk_overlap, sampled_pass1, sampled_pass1_intervals, token_gaps, token_gap_intervals, next_sample, first_divergence, retry_outcome,
        group_advantages, replaced_lowest, best_checkpoint, error_histogram, attempt_reasons, family_gate, dialect_rollup, dev_rollup, token_curve, candidate_status, gold_positions, task_rewards,
        signature_matches, model_tags, seed_averages, size_fits, power_law, size_fit_resamples, detectable_effects,
    )
}

_CELLS = "c AS (SELECT * FROM ladder QUALIFY row_number() OVER (PARTITION BY model, pool, constraint_stack, prompt_id ORDER BY ingest_seq DESC) = 1)"
_ARM = lambda v, s: f"max(({v})::INT) FILTER (constraint_stack = '{s}')"
_RUNGS = ", ".join(f"('{a}-{b}', {_ARM('verify_valid', a)}, {_ARM('verify_valid', b)})" for a, b in ladder.RUNGS)
_PAIRS = f"""{_CELLS}, w AS (SELECT model, pool, prompt_id, unnest([{", ".join(f"struct_pack(rung := '{a}-{b}', a := {_ARM('verify_valid', a)}, b := {_ARM('verify_valid', b)})" for a, b in ladder.RUNGS)}]) AS x FROM c GROUP BY 1, 2, 3),
  p AS (SELECT model, pool, prompt_id, x.rung AS rung, x.a AS a, x.b AS b FROM w WHERE x.a IS NOT NULL AND x.b IS NOT NULL)"""
_CAT = "CASE WHEN regexp_matches(error, '(?i)parse error|error: expected') THEN 'syntax' ELSE 'other' END"
_FLAGS = rf"""{_CELLS}, v AS (SELECT list(op) AS known FROM (SELECT op FROM (SELECT unnest(regexp_extract_all(mlir, '\b((?:arith|memref|linalg|func|stablehlo|scf|math|cf|tensor|vector|affine)\.[a-z_]+)\b', 1)) AS op FROM train_v1) GROUP BY op HAVING count(*) >= 5)),
  u AS (SELECT c.*, len(list_filter(regexp_extract_all(coalesce(generated, ''), '\b((?:arith|memref|linalg|func|stablehlo|scf|math|cf|tensor|vector|affine)\.[a-z_]+)\b', 1), lambda o: NOT list_contains(known, o))) > 0 AS vocab FROM c, v),
  f AS (SELECT *, NOT parse_valid AS v1, NOT parse_valid AND vocab AS v1_vocab, NOT parse_valid AND NOT vocab AS v1_struct, false AS v2, parse_valid AND NOT coalesce(scope_passed_per_try[-1], true) AS v3,
    parse_valid AND NOT verify_valid AND coalesce(regexp_matches(error, '(?i)shape|rank|dimension|dim |inner dimension|incompatible|expected .*tensor|expected .*memref|number of operands'), false) AS v4, parse_valid AND verify_valid AS verify,
    CASE WHEN NOT parse_valid AND vocab THEN 'vocab' WHEN NOT parse_valid THEN 'syntax' WHEN verify_valid THEN 'passed' ELSE {_CAT} END AS cat FROM u)"""
_RES = f"""{_FLAGS}, rw AS (SELECT model, pool, prompt_id, {_ARM('parse_valid', 'none')} AS free_parses, unnest([{", ".join(f"struct_pack(layer := '{v}', a := {_ARM(v, 'none')}, b := {_ARM(v, s)})" for v, s in ladder.STACK.items())}]) AS x FROM f GROUP BY 1, 2, 3),
  r AS (SELECT model, pool, prompt_id, free_parses, x.layer AS layer, x.a AS a, x.b AS b FROM rw WHERE x.a IS NOT NULL AND x.b IS NOT NULL)"""
_DRAW = "('0x' || substr(md5(b || ':' || i), 1, 8))::BIGINT % n"
_PP = "round(100 * (avg(a) - avg(b)), 6) AS pp"
_U = lambda salt: f"(SELECT b, ('0x' || substr(md5('{salt}:' || b), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM range({RESAMPLES}) AS g(b))"


def _cdf(source: str, keys: str, n: str, p: str) -> str:
    """SQL of (keys, k, c): the cumulative probabilities of a binomial of n and p for each row of source."""
    weight = f"CASE WHEN {p} <= 0 THEN (k = 0)::INT WHEN {p} >= 1 THEN (k = {n})::INT ELSE exp(lgamma({n} + 1) - lgamma(k + 1) - lgamma({n} - k + 1) + k * ln({p}) + ({n} - k) * ln(1 - {p})) END"
    return f"(SELECT {keys}, k, sum(w) OVER (PARTITION BY {keys} ORDER BY k) AS c FROM (SELECT {keys}, k, {weight} AS w FROM (SELECT *, unnest(range({n} + 1)) AS k FROM {source})) WHERE w > 0)"


def _rate_draws(source: str, rows: str, keys: str, more: str = "") -> str:
    """SQL with k(keys, n, s) and m(keys, rate): the resampled rates."""
    return f"""{source}, k AS (SELECT {keys}, count(*) AS n, count(*) FILTER (verify_valid) AS s{more} FROM {rows} GROUP BY ALL), f1 AS {_cdf("k", keys, "n", "(s / n)")},
      m AS (SELECT {", ".join("x." + k.strip() for k in keys.split(","))}, f1.k / x.n AS rate FROM (SELECT * FROM k, {_U("rate")}) x ASOF JOIN f1 ON {" AND ".join(f"x.{k.strip()} = f1.{k.strip()}" for k in keys.split(","))} AND x.u <= f1.c)"""


def _pair_draws(source: str, rows: str, keys: str, more: str = "") -> str:
    """SQL with k(keys, n, up, down) and m(keys, d): the resampled differences."""
    ks = [k.strip() for k in keys.split(",")]
    on = lambda t: " AND ".join(f"x.{k} = {t}.{k}" for k in ks)
    xs = ", ".join("x." + k for k in ks)
    return f"""{source}, k AS (SELECT {keys}, count(*) AS n, count(*) FILTER (a > b) AS up, count(*) FILTER (a < b) AS down{more} FROM {rows} GROUP BY ALL), f1 AS {_cdf("k", keys, "n", "((up + down) / n)")},
      m1 AS (SELECT {xs}, x.n, x.up, x.down, x.b AS b, f1.k AS m FROM (SELECT * FROM k, {_U("differ")}) x ASOF JOIN f1 ON {on("f1")} AND x.u <= f1.c),
      f2 AS {_cdf("(SELECT DISTINCT " + keys + ", up, down, m FROM m1)", keys + ", m", "m", "(up / greatest(up + down, 1))")},
      m AS (SELECT {xs}, (2 * f2.k - x.m) / x.n AS d FROM (SELECT m1.*, u FROM m1 JOIN {_U("up")} w ON w.b = m1.b) x ASOF JOIN f2 ON {on("f2")} AND x.m = f2.m AND x.u <= f2.c)"""


_HALF = "(up - down) / n"
_HITS = "s AS (SELECT *, row_number() OVER (PARTITION BY model, prompt_id ORDER BY ingest_seq) AS sample FROM ladder), h AS (SELECT model, prompt_id, count(*) AS n, min(sample) FILTER (verify_valid) AS first_hit FROM s GROUP BY 1, 2)"
_POINTS = _CELLS + ", pt AS (SELECT c.*, m.family, m.params_m, length(e.nl) // 100 + 1 AS d, (NOT verify_valid)::INT::DOUBLE AS r FROM c JOIN model_pins m USING (model) JOIN eval_pool e USING (prompt_id) WHERE params_m IS NOT NULL)"
_LOGFIT = lambda src, k: f"SELECT {k}, exp(regr_intercept(y, x)) AS a, -regr_slope(y, x) AS beta, CASE WHEN var_pop(y) > 1e-20 THEN regr_r2(y, x) ELSE 1.0 END AS r2, count(*) AS n, sum(cl) AS n_clipped FROM (SELECT {k}, ln(params_m) AS x, ln(greatest(residual, 0.001)) AS y, (residual <= 0.001)::INT AS cl FROM {src}) GROUP BY {k}"
_OPSQL = r"list_filter(regexp_extract_all({c}, '\b((?:arith|memref|linalg|func|stablehlo|scf|math|cf|tensor)\.[a-z_]+)\b', 1), lambda o: o NOT IN ('func.func', 'func.return'))"
_SIGP = r"(?s)func\.func\s+@[\w$.]+\s*\(([^)]*)\)\s*(?:->\s*([^{]+?))?\s*\{"
_SIGA = lambda c: f"list_transform(list_filter(string_split(regexp_extract({c}, '{_SIGP}', 1), ','), lambda a: contains(a, ':')), lambda a: regexp_replace(regexp_replace(a, '(?s)^[^:]*:', ''), '\\s+', '', 'g'))"
_SIGR = lambda c: f"regexp_replace(regexp_extract({c}, '{_SIGP}', 2), '\\s+', '', 'g')"
_PUBP = r"func\.func\s+@(\w+)\s*\(([^)]*)\)\s*(?:->\s*([^{]+?))?\s*\{"
_PUBA = lambda c: f"list_transform(list_filter(string_split(regexp_extract({c}, '{_PUBP}', 2), ','), lambda a: trim(a) <> ''), lambda a: replace(regexp_replace(a, '.*:', ''), ' ', ''))"
_PUBR = lambda c: f"replace(trim(regexp_extract({c}, '{_PUBP}', 3)), ' ', '')"


def match_sql(source: str, keys: str) -> str:
    """SQL of (keys, match) for each row of source: how generated's public signature fits that of gold_mlir."""
    return rf"""(WITH j AS (SELECT {keys}, coalesce(regexp_matches(generated, '{_PUBP}'), false) AS oc, coalesce(regexp_matches(gold_mlir, '{_PUBP}'), false) AS og, {_PUBA('generated')} AS ca, {_PUBA('gold_mlir')} AS ga, {_PUBR('generated')} AS cr, {_PUBR('gold_mlir')} AS gr FROM {source}),
      k AS (SELECT *, list_transform(range(1, len(ga) + 1), lambda i: ga[i] = ca[i] OR coalesce(len(string_split(ga[i], 'x')) = len(string_split(ca[i], 'x')) AND ga[i] LIKE 'memref<%' AND ca[i] LIKE 'memref<%' AND len(list_filter(range(1, len(string_split(ga[i], 'x')) + 1), lambda q: NOT (string_split(ga[i], 'x')[q] = string_split(ca[i], 'x')[q] OR string_split(ca[i], 'x')[q] IN ('?', 'memref<?')))) = 0, false)) AS fit FROM j)
      SELECT {keys}, CASE WHEN NOT (oc AND og) OR cr <> gr OR len(ca) <> len(ga) THEN 'mismatch' WHEN ca = ga THEN 'exact' WHEN list_bool_and(fit) THEN 'dim_relaxed' ELSE 'mismatch' END AS match FROM k)"""


reward_sql = f"""j AS (SELECT row_id, generated AS g, gold_mlir AS d, verify_valid, {_OPSQL.format(c='generated')} AS a, {_OPSQL.format(c='gold_mlir')} AS b FROM ladder JOIN eval_pool USING (prompt_id) WHERE generated IS NOT NULL AND gold_mlir IS NOT NULL),
      s AS (SELECT *, regexp_matches(g, '{_SIGP}') AND regexp_matches(d, '{_SIGP}') AS ok, {_SIGA('g')} AS ga, {_SIGA('d')} AS da, {_SIGR('g')} AS gr, {_SIGR('d')} AS dr,
        coalesce(list_sum(list_transform(list_distinct(a), lambda o: least(len(list_filter(a, lambda x: x = o)), len(list_filter(b, lambda x: x = o))))), 0) AS sh FROM j),
      kk AS (SELECT *, CASE WHEN ok THEN (len(list_filter(range(1, least(len(ga), len(da)) + 1), lambda i: ga[i] = da[i])) + (gr = dr)::INT) / (greatest(len(ga), len(da)) + 1) ELSE 0.0 END AS sig, CASE WHEN len(a) + len(b) - sh = 0 THEN 1.0 ELSE sh / (len(a) + len(b) - sh) END AS jac FROM s)"""
SQL = {
    "ladder_latest": f"WITH {_CELLS} SELECT model, pool, constraint_stack, prompt_id, row_id FROM c",
    "ladder_summary": f"WITH {_rate_draws(_CELLS, 'c', 'model, pool, constraint_stack', ', avg(parse_valid::INT) AS pr, avg(attempts) AS ma, avg(dt) AS md, count(*) FILTER (NOT coalesce(finished, true)) AS unfinished')}, q AS (SELECT model, pool, constraint_stack, round(quantile_cont(rate, 0.025), 6) AS ci_low, round(quantile_cont(rate, 0.975), 6) AS ci_high FROM m GROUP BY 1, 2, 3) SELECT model, pool, constraint_stack, n, round(pr, 6) AS parse_rate, round(s / n, 6) AS verify_rate, ci_low, ci_high, round(ma, 6) AS mean_attempts, round(md, 6) AS mean_dt, unfinished FROM k JOIN q USING (model, pool, constraint_stack)",
    "ladder_deltas": f"WITH {_pair_draws(_PAIRS, 'p', 'model, pool, rung')}, q AS (SELECT model, pool, rung, round(avg((d <= 0)::INT), 6) AS p_value FROM m GROUP BY 1, 2, 3) SELECT model, pool, rung, n AS n_pairs, round(100 * {_HALF}, 6) AS pp, p_value FROM k JOIN q USING (model, pool, rung)",
    "rate_intervals": f"WITH {_rate_draws(_CELLS, 'c', 'method, constraint_stack')}, q AS (SELECT method, constraint_stack, round(quantile_cont(rate, 0.025), 6) AS ci_low, round(quantile_cont(rate, 0.975), 6) AS ci_high FROM m GROUP BY 1, 2) SELECT method, constraint_stack, n, round(s / n, 6) AS point, ci_low, ci_high FROM k JOIN q USING (method, constraint_stack)",
    "rank_intervals": f"WITH {_rate_draws(_CELLS, 'c', 'method')} SELECT method, round(list_sort(list(rate))[{int(0.025 * RESAMPLES) + 1}], 6) AS ci_low, round(list_sort(list(rate))[{int(0.975 * RESAMPLES) + 1}], 6) AS ci_high FROM m GROUP BY 1",
    "delta_intervals": f"WITH {_pair_draws(_PAIRS, 'p', 'rung')}, q AS (SELECT rung, round(quantile_cont(d, 0.025), 6) AS ci_low, round(quantile_cont(d, 0.975), 6) AS ci_high, round(avg((d <= 0)::INT), 6) AS p_value FROM m GROUP BY 1) SELECT rung, n, round({_HALF}, 6) AS point, ci_low, ci_high, p_value FROM k JOIN q USING (rung)",
    "residual_rates": f"WITH {_FLAGS} SELECT pool, constraint_stack, count(*) AS n, {', '.join(f'round(avg({v}::INT), 6) AS {v}' for v in ladder.LAYERS)} FROM f GROUP BY 1, 2",
    "category_histogram": f"WITH {_FLAGS} SELECT constraint_stack, cat, count(*) AS n FROM f GROUP BY 1, 2",
    "residuals": f"WITH {_RES} SELECT pool, layer, count(*) AS n, {_PP} FROM r GROUP BY 1, 2",
    "residuals_by_subset": f"WITH {_RES}, z AS (SELECT *, prompt_id < CASE pool WHEN 'arith_func_big' THEN 24 WHEN 'linalg_big' THEN 30 ELSE 1000000000 END AS spec FROM r WHERE layer = 'v3') SELECT pool, count(*) AS n, {_PP}, 'all' AS which FROM z GROUP BY pool UNION ALL SELECT pool, count(*), round(100 * (avg(a) - avg(b)), 6), 'spec' FROM z WHERE spec GROUP BY pool UNION ALL SELECT pool, count(*), round(100 * (avg(a) - avg(b)), 6), 'mined' FROM z WHERE NOT spec GROUP BY pool",
    "conditional_residual": f"WITH {_RES} SELECT pool, count(*) AS n, {_PP} FROM r WHERE layer = 'v3' AND free_parses = 1 GROUP BY 1",
    "internalized_gate": f"WITH {_pair_draws(_RES, 'r', 'model, pool, layer', ', avg(a) AS fr')}, q AS (SELECT model, pool, layer, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi FROM m GROUP BY 1, 2, 3) SELECT model, pool, layer, n, round(fr, 6) AS free_rate, round({_HALF}, 6) AS point, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, lo <= 0 AND hi >= 0 AND {_HALF} * 100 <= 2 AS internalized FROM k JOIN q USING (model, pool, layer)",
    "resume_todo": "SELECT model, pool, prompt_id FROM (SELECT model, pool, prompt_id FROM (SELECT model FROM model_pins), (SELECT pool, prompt_id FROM eval_pool)) g ANTI JOIN ladder USING (model, pool, prompt_id)",
    "completed_cells": f"WITH {_CELLS} SELECT model, pool, constraint_stack, count(DISTINCT prompt_id) AS n_done, count(DISTINCT prompt_id) = any_value(n_pool) AS done FROM c JOIN (SELECT pool, count(*) AS n_pool FROM eval_pool GROUP BY 1) USING (pool) GROUP BY 1, 2, 3",
    "ablation_grid": "WITH g AS (SELECT DISTINCT family, method, s AS constraint_stack FROM model_pins, unnest(['none', 'c1', 'c1_c2', 'c1_c2_c3']) AS t(s)), b AS (SELECT DISTINCT m.family, l.method, constraint_stack, true AS covered FROM ladder l JOIN model_pins m USING (model)) SELECT family, method, constraint_stack, family || '__' || method || '__' || constraint_stack AS tag, coalesce(covered, false) AS covered FROM g LEFT JOIN b USING (family, method, constraint_stack)",
    "passk_first_hits": f"WITH {_HITS} SELECT * FROM h",
    "passk_curve": f"WITH {_HITS} SELECT model, k::INT AS k, count(*) AS prompts, count(*) FILTER (first_hit <= k) AS solved FROM h, range(1, 7) AS g(k) GROUP BY 1, 2",
    "passk_grid": f"WITH {_HITS} SELECT model, k::INT AS k, count(*) AS prompts, count(*) FILTER (first_hit <= k) AS solved FROM h, unnest([1, 2, 4]) AS g(k) GROUP BY 1, 2",
    "passk_overlap": f"WITH {_HITS}, a AS (SELECT DISTINCT model, prompt_id FROM ladder WHERE verify_valid AND constraint_stack = 'c1_c2_c3'), b AS (SELECT model, prompt_id FROM h WHERE first_hit <= 2) SELECT (SELECT count(*) FROM a SEMI JOIN b USING (model, prompt_id)) AS both, (SELECT count(*) FROM a ANTI JOIN b USING (model, prompt_id)) AS only_a, (SELECT count(*) FROM b ANTI JOIN a USING (model, prompt_id)) AS only_b",
    "sampled_pass1": "SELECT model, count(*) AS prompts, round(avg(p), 6) AS pass1 FROM (SELECT model, prompt_id, avg(verify_valid::INT) AS p FROM ladder GROUP BY 1, 2) GROUP BY 1",
    "token_gaps": "WITH o AS (SELECT model, prompt_id, arg_min(tokens, gen_id) AS a, arg_max(tokens, gen_id) AS b FROM gen_out GROUP BY 1, 2), g AS (SELECT model, CASE WHEN len(a) > 0 AND len(a) = len(b) THEN list_sum(list_transform(range(1, len(a) + 1), lambda i: ln(b[i] + 1.0) - ln(a[i] + 1.0))) / len(a) END AS gap FROM o) SELECT model, count(*) AS n, count(gap) AS n_used, round(avg(gap), 6) AS gap FROM g GROUP BY 1",
    "next_sample": "SELECT model, min(n)::INT AS start FROM (SELECT model, prompt_id, count(*) + 1 AS n FROM ladder GROUP BY 1, 2) GROUP BY 1",
    "first_divergence": "SELECT model, row_id, list_position(scope_passed_per_try, false) - 1 AS first_fail FROM ladder WHERE list_contains(scope_passed_per_try, false)",
    "retry_outcome": "SELECT row_id, CASE WHEN list_contains(scope_passed_per_try, true) THEN list_position(scope_passed_per_try, true) ELSE len(scope_passed_per_try) END - 1 AS attempt, list_contains(scope_passed_per_try, true) AS ok FROM ladder WHERE len(scope_passed_per_try) > 0",
    "group_advantages": "WITH r AS (SELECT row_id, prompt_id, verify_valid::INT::DOUBLE / greatest(attempts, 1) AS reward FROM ladder), g AS (SELECT prompt_id, avg(reward) AS m, stddev_pop(reward) AS s FROM r GROUP BY 1) SELECT row_id, round(CASE WHEN s > 0 THEN (reward - m) / (s + 1e-6) ELSE 0 END, 6) AS adv FROM r JOIN g USING (prompt_id)",
    "replaced_lowest": "SELECT row_id FROM ladder QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY verify_valid::INT * 100 - attempts, row_id) > 2",
    "best_checkpoint": f"WITH {_CELLS}, g AS (SELECT family, c.ckpt, avg(verify_valid::INT) AS rate, count(*) AS n FROM c JOIN model_pins USING (model) GROUP BY 1, 2) SELECT family, ckpt, round(rate, 6) AS rate, n FROM g QUALIFY row_number() OVER (PARTITION BY family ORDER BY rate DESC, n DESC, ckpt DESC) = 1",
    "error_histogram": f"SELECT model, constraint_stack, dialect, {_CAT} AS category, count(*) AS n FROM ladder LEFT JOIN (SELECT prompt_id, dialect FROM eval_pool) USING (prompt_id) WHERE error IS NOT NULL GROUP BY 1, 2, 3, 4",
    "attempt_reasons": "SELECT method, CASE WHEN error IS NOT NULL THEN 'error' WHEN NOT parse_valid THEN 'parse_fail' WHEN list_contains(scope_passed_per_try, false) THEN 'scope_retry' WHEN NOT verify_valid THEN 'verify_fail' ELSE 'pass' END AS reason, count(*) AS n FROM ladder GROUP BY 1, 2",
    "family_gate": f"WITH {_CELLS} SELECT family, count(*) AS n, count(*) FILTER (NOT parse_valid) AS parse_fail, count(*) FILTER (parse_valid AND NOT verify_valid) AS verify_fail, count(*) FILTER (verify_valid) AS passed, round(count(*) FILTER (verify_valid) / count(*), 6) AS pass_rate FROM c JOIN model_pins USING (model) GROUP BY 1",
    "dialect_rollup": f"WITH {_CELLS} SELECT e.dialect, grouping(e.dialect)::INT AS is_total, count(*) AS n, round(avg(verify_valid::INT), 6) AS verify_rate FROM c JOIN eval_pool e USING (prompt_id) GROUP BY ROLLUP (e.dialect)",
    "dev_rollup": f"WITH {_CELLS} SELECT model, count(*) AS n, count(DISTINCT trim(regexp_replace(generated, '\\s+', ' ', 'g'))) AS distinct_programs, round(avg(n_tokens), 6) AS mean_len, count(*) FILTER (NOT coalesce(finished, true)) AS unfinished FROM c GROUP BY 1",
    "token_curve": "SELECT i - 1 AS pos, count(*) AS n, round(avg(tok), 6) AS mean FROM (SELECT unnest(tokens) AS tok, generate_subscripts(tokens, 1) AS i FROM gen_out) GROUP BY 1",
    "candidate_status": f"WITH {_CELLS}, o AS (SELECT prompt_id, arg_max(nl, row_id) AS nl FROM c WHERE constraint_stack = 'c1_c2_c3' AND method = 'sft' GROUP BY 1) SELECT e.prompt_id, CASE WHEN o.prompt_id IS NULL THEN 'no_candidate_row' WHEN trim(o.nl) <> trim(e.nl) THEN 'nl_mismatch' WHEN gold_mlir IS NULL THEN 'no_reference' ELSE 'scored' END AS status FROM eval_pool e LEFT JOIN o USING (prompt_id)",
    "gold_positions": "SELECT prompt_id, row_number() OVER (ORDER BY prompt_id) - 1 AS position FROM eval_pool",
    "task_rewards": f"WITH {reward_sql} SELECT row_id, round(sig, 6) AS sig, round(jac, 6) AS jac, round(CASE WHEN verify_valid THEN sig * jac ELSE 0.0 END, 6) AS reward FROM kk",
    "signature_matches": f"SELECT match, count(*) AS n FROM {match_sql('(SELECT generated, gold_mlir FROM ladder JOIN eval_pool USING (prompt_id) WHERE generated IS NOT NULL AND gold_mlir IS NOT NULL)', 'generated')} GROUP BY 1",
    "model_tags": r"SELECT model, nullif(regexp_extract(model, '^(.*)_(ssd|rft|grpo|sft)_s(\d+)$', 1), '') AS base, nullif(regexp_extract(model, '^(.*)_(ssd|rft|grpo|sft)_s(\d+)$', 2), '') AS tuned, coalesce(params_m, try_cast(regexp_extract(model, '(\d+)m', 1) AS DOUBLE)) AS size_m FROM model_pins",
    "seed_averages": f"WITH {_POINTS} SELECT family, params_m, d, round(avg(residual), 6) AS residual, count(*) AS n_seeds FROM (SELECT family, params_m, d, train_seed, avg(r) AS residual FROM pt GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3",
    "size_fits": f"WITH {_POINTS}, z AS (SELECT family, params_m, avg(r) AS residual FROM pt GROUP BY 1, 2), y AS ({_LOGFIT('z', 'family')}) SELECT family, round(a, 5) AS a, round(beta, 5) AS beta, round(r2, 5) AS r2, n, n_clipped, n_clipped >= n - 1 AS degenerate FROM y WHERE n >= 2",
    "power_law": f"""WITH {_POINTS}, z AS (SELECT ln(d) AS x, -ln(params_m) AS z, ln(greatest(avg(r), 0.001)) AS y, (avg(r) <= 0.001)::INT AS cl FROM pt GROUP BY params_m, d),
      s AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_pop(x, x) AS xx, covar_pop(z, z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy, covar_pop(y, y) AS yy, count(*) AS n, sum(cl) AS n_clipped FROM z),
      c3 AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS alpha, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS beta FROM s)
      SELECT round(exp(my - alpha * mx - beta * mz), 5) AS a, round(alpha, 5) AS alpha, round(beta, 5) AS beta, round((alpha * xy + beta * zy) / yy, 5) AS r2, n, n_clipped FROM c3""",
    "size_fit_resamples": f"""WITH {_POINTS}, per AS (SELECT prompt_id, params_m, avg(r) AS r FROM pt GROUP BY 1, 2), ids AS (SELECT prompt_id, row_number() OVER (ORDER BY prompt_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT prompt_id FROM per)),
      pk AS (SELECT g.b AS b, {_DRAW.replace('md5(b ', 'md5(g.b ')} AS i FROM ids, range({SIZE_RESAMPLES}) AS g(b)), z AS (SELECT b, params_m, avg(r) AS residual FROM pk JOIN ids USING (i) JOIN per USING (prompt_id) GROUP BY 1, 2), y AS ({_LOGFIT('z', 'b')}) SELECT b, round(beta, 5) AS beta, n FROM y""",
    "detectable_effects": f"SELECT method, count(*) AS n, round({stats.min_detectable_effect(1)!r} / sqrt(count(*)), 6) AS mde FROM ladder GROUP BY 1",
}
