"""Queries: differential scoring, functional roll-ups, deltas of trained models, transfer residuals and rewards.

The test tables hold no executed programs. trials() and gold_runs() write their outcomes in the shape of the real logs, from a digest of
the row and the trial, in the same way in SQL: what is tested is everything that is made of such logs, not the outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import differential, ladder, passk, stats
from corvane.plans import evaluation as E
from corvane.plans import pool as P
from corvane.store import table

K = 5
STACKS = ("none", "c1", "c1_c2", "c1_c2_c3")
TAG = r"^(.*)_(ssd|rft|grpo|sft)_s(\d+)$"


def _digit(*parts, at=1):
    return F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), at, 1)


def trials(spark, d):
    """(row_id, trial, lower_ok, exec_ok, match) of each row of the ladder, K trials."""
    rows = table(spark, d, "ladder").select("row_id", "parse_valid", "verify_valid", F.explode(F.sequence(F.lit(0), F.lit(K - 1))).alias("trial"))
    ran = F.col("parse_valid") & (_digit(F.col("row_id"), F.col("trial")) != "0")
    return rows.select("row_id", "trial", F.col("parse_valid").alias("lower_ok"), ran.alias("exec_ok"), (ran & F.col("verify_valid") & (_digit(F.col("row_id"), F.col("trial"), at=2) != "0")).alias("match"))


def gold_runs(spark, d):
    """(prompt_id, trial, run, out) of each gold: two runs of K trials; the second run of an unsteady gold differs at trial 3."""
    each = table(spark, d, "eval_pool").filter("gold_mlir is not null").select("prompt_id", F.explode(F.sequence(F.lit(0), F.lit(K - 1))).alias("trial"))
    each = each.select("prompt_id", "trial", F.explode(F.array(F.lit(1), F.lit(2))).alias("run"))
    unsteady = (F.col("run") == 2) & (F.col("trial") == 3) & _digit(F.lit("gold"), F.col("prompt_id")).isin("0", "1")
    return each.select("prompt_id", "trial", "run", F.md5(F.concat_ws(":", "prompt_id", "trial", F.when(unsteady, "x").otherwise(""))).alias("out"))


def gold_gate(spark, d):
    """Every gold's gate: excluded with its reason, failed, or passed."""
    golds = table(spark, d, "eval_pool").select("prompt_id", T.exclusion(T.public_signature(F.col("gold_mlir"))).alias("reason"))
    return differential.gold_gate(golds, gold_runs(spark, d), ["prompt_id"], K)


def _prompts(spark, d):
    """Each gate-passed gold under each stack with one candidate, the latest of the fine-tuned models, and its status."""
    pool = table(spark, d, "eval_pool").select("prompt_id", "dialect", T.public_signature(F.col("gold_mlir")).alias("g"))
    asked = gold_gate(spark, d).filter("gate = 'pass'").join(pool, "prompt_id").select("prompt_id", "dialect", "g", F.explode(F.array(*map(F.lit, STACKS))).alias("constraint_stack"))
    cells = E.cells(spark, d, "method", "row_id", "verify_valid", "generated").filter("method = 'sft'")
    one = cells.groupBy("prompt_id", "constraint_stack").agg(F.max_by(F.struct("row_id", "verify_valid", "generated"), F.col("row_id")).alias("c"))
    j = asked.join(one, ["prompt_id", "constraint_stack"], "left").join(differential.outcomes(trials(spark, d), ["row_id"], K).withColumnRenamed("row_id", "of"), F.col("c.row_id") == F.col("of"), "left")
    match = F.when(F.col("c").isNotNull(), T.signature_match(F.col("g"), T.public_signature(F.col("c.generated"))))
    return j.select("prompt_id", "dialect", "constraint_stack", differential.status(F.col("c").isNotNull(), F.col("c.verify_valid"), match).alias("status"), (match == "dim_relaxed").alias("dim_relaxed"), "functional_match")


def differential_status(spark, d):
    return differential.histogram(_prompts(spark, d), ["constraint_stack", "dialect"], "status")


def differential_summary(spark, d):
    gates = gold_gate(spark, d).join(table(spark, d, "eval_pool").select("prompt_id", "dialect"), "prompt_id")
    got = differential.aggregate(gates, _prompts(spark, d), ["constraint_stack", "dialect"], ["dialect"], E.RESAMPLES)
    rounded = [F.round(f"{k}_{of}", 6).alias(f"{k}_{of}") for of in ("scored", "gate") for k in ("rate", "low", "high")]
    return got.select("constraint_stack", "dialect", "n_gold", "n_excluded", "n_fail", "n_pass", "n_scored", "n_dim_relaxed", "n_match", *rounded)


def _scored(spark, d, *keep):
    return E.cells(spark, d, "row_id", "verify_valid", *keep).join(differential.outcomes(trials(spark, d), ["row_id"], K), "row_id")


def functional_rollup(spark, d):
    rows = _scored(spark, d).join(table(spark, d, "eval_pool").select("prompt_id", "dialect"), "prompt_id")
    return differential.rollup(rows, ["constraint_stack"], "dialect")


def dev_functional(spark, d):
    """Per model, without constraints and under the masked stack: verified and matching rows, and the others by what stopped them."""
    rows = _scored(spark, d).filter("constraint_stack in ('none', 'c1_c2')")
    ok = F.coalesce("verify_valid", F.lit(False))
    what = F.when(~ok, "not_verified").when(F.col("functional_match"), "match").when(~F.col("exec_ok"), "exec_fail").otherwise("mismatch")
    count = lambda s: F.count_if(F.col("status") == s).alias("n_" + s)
    return rows.withColumn("status", what).groupBy("model", "constraint_stack").agg(F.count("*").alias("n"), *map(count, ("not_verified", "exec_fail", "mismatch", "match")), F.round(F.avg((F.col("status") == "match").cast("double")), 6).alias("match_rate"))


def all_trials(spark, d):
    """A row is right if exactly K trials were made and all match."""
    return passk.all_trials(trials(spark, d), ["row_id"], "match", K)


def rate_composition(spark, d):
    """Right answers as a share of verified ones and of those whose gold passed its gate."""
    gate = gold_gate(spark, d).select("prompt_id", (F.col("gate") == "pass").alias("gate"))
    j = _scored(spark, d, "method").join(gate, "prompt_id")
    right = F.col("verify_valid") & F.col("gate") & F.col("functional_match")
    return j.groupBy("method").agg(F.count_if(right).alias("n_right"), F.round(F.try_divide(F.count_if(right), F.count_if("verify_valid")), 6).alias("of_verified"), F.round(F.try_divide(F.count_if(right), F.count_if("gate")), 6).alias("of_gate"))


def trained_delta(spark, d):
    """Per tag and pool: the shape flag of the trained model less that of the model it was trained from, over prompts both answered without
    constraints; and the trained model's rate under the full stack."""
    base = F.regexp_extract("model", TAG, 1)
    wide = ladder.arms(E.flagged(spark, d), ["model", "pool", "prompt_id"], {"v4": F.col("v4")}).select("model", "pool", "prompt_id", "v4_none", "v4_c1_c2_c3")
    trained = wide.filter(F.col("model").rlike(TAG)).withColumn("base_model", base)
    full = trained.groupBy("model", "pool").agg(F.round(F.avg("v4_c1_c2_c3"), 6).alias("full_rate"))
    other = wide.select(F.col("model").alias("base_model"), "pool", "prompt_id", F.col("v4_none").alias("b")).filter("b is not null")
    pairs = trained.filter("v4_none is not null").withColumn("a", F.col("v4_none")).join(other, ["base_model", "pool", "prompt_id"])
    got = stats.pair_count_interval(stats.pair_counts(pairs, ["model", "base_model", "pool"]), E.RESAMPLES).join(full, ["model", "pool"])
    return E._rounded(got, "model", "base_model", "pool", "n", "point", "ci_low", "ci_high", "p_value", "full_rate")


def signature_mismatch_rates(spark, d):
    """Per method and stack: the share of another signature among candidates of gate-passed golds, with an interval from the counts."""
    gold = gold_gate(spark, d).filter("gate = 'pass'").join(table(spark, d, "eval_pool"), "prompt_id").select("prompt_id", T.public_signature(F.col("gold_mlir")).alias("g"))
    rows = E.cells(spark, d, "method", "generated").join(gold, "prompt_id")
    bad = F.coalesce(T.signature_match(F.col("g"), T.public_signature(F.col("generated"))) == "mismatch", F.lit(True))
    got = stats.count_interval(rows.groupBy("method", "constraint_stack").agg(F.count("*").alias("n"), F.count_if(bad).alias("s")), E.RESAMPLES)
    return E._rounded(got, "method", "constraint_stack", "n", "point", "ci_low", "ci_high")


TRANSFER = {"v1": "c1", "v2": "c1_c2", "v3": "c1_c2_c3", "v4": "c1_c2_c3"}


def transfer_rates(spark, d):
    """Per pool and stack: the layers' violation rates without a vocabulary split, the verified and the functional rate."""
    rows = E.flagged(spark, d, "row_id").join(differential.outcomes(trials(spark, d), ["row_id"], K), "row_id")
    rate = lambda c: F.round(F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double")), 6)
    return rows.groupBy("pool", "constraint_stack").agg(F.count("*").alias("n"), *[rate(c).alias(c) for c in (*TRANSFER, "verify")], rate("functional_match").alias("functional_rate"))


def transfer_residuals(spark, d):
    """Per pool and layer: the rate without constraints less that under the layer's stack, with an interval."""
    pairs = ladder.residual_pairs(E.flagged(spark, d)).filter(F.col("layer").isin(*TRANSFER))
    return E._rounded(stats.pair_count_interval(stats.pair_counts(pairs, ["pool", "layer"]), E.RESAMPLES), "pool", "layer", "n", "point", "ci_low", "ci_high")


def portability_deltas(spark, d):
    """Per pool and rung: what each stack adds in verified and in functionally matching answers."""
    rows = _scored(spark, d)
    out = None
    for metric in ("verify_valid", "functional_match"):
        got = stats.pair_count_interval(stats.pair_counts(ladder.rung_pairs(rows, metric), ["pool", "rung"]), E.RESAMPLES).withColumn("metric", F.lit(metric))
        out = got if out is None else out.unionByName(got)
    return E._rounded(out, "metric", "pool", "rung", "n", "point", "ci_low", "ci_high", "p_value")


def reward_kinds(spark, d):
    """Each kind of reward of each row: verified; times signature and operations; with a bonus if the first trial matches; and all of them
    without the scope validator in the gate."""
    rows = E.task_parts(spark, d)
    first = trials(spark, d).filter("trial = 0").select("row_id", F.col("match").alias("hit"))
    scope = F.coalesce(F.element_at(F.when(F.size("scope_passed_per_try") > 0, F.col("scope_passed_per_try")), -1), F.lit(True))
    parts = rows.join(first, "row_id").withColumn("open", (F.col("parse_valid") & F.col("verify_valid")).cast("double")).withColumn("gate", (F.col("parse_valid") & scope & F.col("verify_valid")).cast("double"))
    task = F.col("sig") * F.col("jac")
    kind = lambda g: {"verify": g, "task": g * task, "functional": g * task + g * F.col("hit").cast("double")}
    cols = {k: v for k, v in kind(F.col("gate")).items()} | {f"{k}_noc3": v for k, v in kind(F.col("open")).items()}
    return parts.select("row_id", *[F.round(v, 6).alias(k) for k, v in cols.items()])


QUERIES = {
    f.__name__: f
    for f in (
        gold_gate, differential_status, differential_summary, functional_rollup, dev_functional, all_trials, rate_composition, trained_delta, signature_mismatch_rates, transfer_rates, transfer_residuals,
        portability_deltas, reward_kinds,
    )
}

_TRIALS = f"""tr AS (SELECT row_id, trial, parse_valid AS lower_ok, parse_valid AND substr(md5(row_id || ':' || trial), 1, 1) <> '0' AS exec_ok, parse_valid AND substr(md5(row_id || ':' || trial), 1, 1) <> '0' AND verify_valid AND substr(md5(row_id || ':' || trial), 2, 1) <> '0' AS match FROM ladder, range({K}) AS g(trial)),
  oc AS (SELECT row_id, bool_and(lower_ok) AS lower_ok, bool_and(exec_ok) AS exec_ok, count(*) = {K} AND bool_and(match) AS functional_match FROM tr GROUP BY 1)"""
_EXCLUDED = P.excluded_sql("eval_pool", "gold_mlir", "prompt_id, dialect")
_GATE = f"""{_EXCLUDED}, gg AS (SELECT prompt_id, dialect, CASE WHEN reason <> 'supported' THEN 'excluded' WHEN substr(md5('gold:' || prompt_id), 1, 1) IN ('0', '1') THEN 'fail' ELSE 'pass' END AS gate, CASE WHEN reason <> 'supported' THEN reason END AS reason FROM ex)"""
_MATCH = E.match_sql
_PROMPTS = f"""{_GATE}, {_TRIALS}, {E._CELLS}, one AS (SELECT prompt_id, constraint_stack, max(row_id) AS row_id FROM c WHERE method = 'sft' GROUP BY 1, 2),
  ask AS (SELECT gg.prompt_id, gg.dialect, s AS constraint_stack, gold_mlir FROM gg JOIN eval_pool USING (prompt_id), unnest({list(STACKS)}) AS t(s) WHERE gate = 'pass'),
  jj AS (SELECT ask.*, one.row_id, l.verify_valid, l.generated, functional_match FROM ask LEFT JOIN one USING (prompt_id, constraint_stack) LEFT JOIN ladder l ON l.row_id = one.row_id LEFT JOIN oc ON oc.row_id = one.row_id),
  mm AS {_MATCH("jj", "prompt_id, dialect, constraint_stack, row_id, verify_valid, functional_match")},
  pr AS (SELECT *, CASE WHEN row_id IS NULL THEN 'no_candidate_row' WHEN NOT coalesce(verify_valid, false) THEN 'not_verified' WHEN match = 'mismatch' THEN 'signature_mismatch' ELSE 'scored' END AS status FROM mm)"""
_SCORED = f"{E._CELLS}, {_TRIALS}, sc AS (SELECT c.*, lower_ok, exec_ok, functional_match FROM c JOIN oc USING (row_id))"
_Q = lambda v, q, n: f"round(quantile_cont({v}, {q}), 6) AS {n}"


def _interval(keys):
    return f"q AS (SELECT {keys}, {_Q('d', 0.025, 'ci_low')}, {_Q('d', 0.975, 'ci_high')}, round(avg((d <= 0)::INT), 6) AS p_value FROM m GROUP BY ALL)"


def _rates_of(n):
    return f"""(WITH k AS (SELECT constraint_stack, dialect, {n} AS n, count(*) FILTER (status = 'scored' AND functional_match) AS s FROM pr GROUP BY 1, 2), f1 AS {E._cdf("k", "constraint_stack, dialect", "n", "(s / n)")},
      m AS (SELECT x.constraint_stack, x.dialect, f1.k / x.n AS rate FROM (SELECT * FROM k, {E._U("rate")} WHERE n > 0) x ASOF JOIN f1 ON x.constraint_stack = f1.constraint_stack AND x.dialect = f1.dialect AND x.u <= f1.c)
      SELECT k.constraint_stack, k.dialect, any_value(round(s / n, 6)) FILTER (n > 0) AS rate, {_Q('m.rate', 0.025, 'low')}, {_Q('m.rate', 0.975, 'high')} FROM k LEFT JOIN m ON k.constraint_stack = m.constraint_stack AND k.dialect = m.dialect GROUP BY ALL)"""


SQL = {
    "gold_gate": f"WITH {_GATE} SELECT prompt_id, gate, reason FROM gg",
    "differential_status": f"WITH {_PROMPTS} SELECT constraint_stack, dialect, status, count(*) AS n FROM pr GROUP BY 1, 2, 3",
    "differential_summary": f"""WITH {_PROMPTS}, a AS (SELECT constraint_stack, dialect, count(*) FILTER (status = 'scored') AS n_scored, count(*) FILTER (status = 'scored' AND match = 'dim_relaxed') AS n_dim_relaxed, count(*) FILTER (status = 'scored' AND functional_match) AS n_match FROM pr GROUP BY 1, 2),
      g AS (SELECT dialect, count(*) AS n_gold, count(*) FILTER (gate = 'excluded') AS n_excluded, count(*) FILTER (gate = 'fail') AS n_fail, count(*) FILTER (gate = 'pass') AS n_pass FROM gg GROUP BY 1),
      x AS {_rates_of("count(*) FILTER (status = 'scored')")}, y AS {_rates_of("count(*)")}
      SELECT a.constraint_stack, a.dialect, n_gold, n_excluded, n_fail, n_pass, n_scored, n_dim_relaxed, n_match, x.rate AS rate_scored, x.low AS low_scored, x.high AS high_scored, y.rate AS rate_gate, y.low AS low_gate, y.high AS high_gate
      FROM a JOIN g USING (dialect) JOIN x USING (constraint_stack, dialect) JOIN y USING (constraint_stack, dialect)""",
    "functional_rollup": f"WITH {_SCORED} SELECT constraint_stack, dialect, grouping(dialect)::INT AS is_total, count(*) AS n, round(avg(verify_valid::INT), 6) AS verify_rate, round(avg(lower_ok::INT), 6) AS lower_rate, round(avg(exec_ok::INT), 6) AS exec_rate, round(avg(functional_match::INT), 6) AS match_rate FROM sc JOIN (SELECT prompt_id, dialect FROM eval_pool) USING (prompt_id) GROUP BY GROUPING SETS ((constraint_stack, dialect), (constraint_stack))",
    "dev_functional": f"WITH {_SCORED}, z AS (SELECT *, CASE WHEN NOT verify_valid THEN 'not_verified' WHEN functional_match THEN 'match' WHEN NOT exec_ok THEN 'exec_fail' ELSE 'mismatch' END AS st FROM sc WHERE constraint_stack IN ('none', 'c1_c2')) SELECT model, constraint_stack, count(*) AS n, count(*) FILTER (st = 'not_verified') AS n_not_verified, count(*) FILTER (st = 'exec_fail') AS n_exec_fail, count(*) FILTER (st = 'mismatch') AS n_mismatch, count(*) FILTER (st = 'match') AS n_match, round(avg((st = 'match')::INT), 6) AS match_rate FROM z GROUP BY 1, 2",
    "all_trials": f"WITH {_TRIALS} SELECT row_id, functional_match AS correct FROM oc",
    "rate_composition": f"WITH {_GATE}, {_SCORED}, z AS (SELECT method, verify_valid, gate = 'pass' AS ok, verify_valid AND gate = 'pass' AND functional_match AS r FROM sc JOIN gg USING (prompt_id)) SELECT method, count(*) FILTER (r) AS n_right, round(count(*) FILTER (r) / nullif(count(*) FILTER (verify_valid), 0), 6) AS of_verified, round(count(*) FILTER (r) / nullif(count(*) FILTER (ok), 0), 6) AS of_gate FROM z GROUP BY 1",
    "trained_delta": f"""WITH {E._pair_draws(E._FLAGS + rf", w AS (SELECT model, pool, prompt_id, {E._ARM('v4', 'none')} AS v, {E._ARM('v4', 'c1_c2_c3')} AS vf, nullif(regexp_extract(model, '{TAG}', 1), '') AS base_model FROM f GROUP BY 1, 2, 3), pp AS (SELECT t.model, t.base_model, t.pool, t.v AS a, o.v AS b FROM w t JOIN w o ON o.model = t.base_model AND o.pool = t.pool AND o.prompt_id = t.prompt_id WHERE t.v IS NOT NULL AND o.v IS NOT NULL)", "pp", "model, base_model, pool")},
      {_interval("model, base_model, pool")}, fu AS (SELECT model, pool, round(avg(vf), 6) AS full_rate FROM w WHERE base_model IS NOT NULL GROUP BY 1, 2) SELECT model, base_model, pool, n, round({E._HALF}, 6) AS point, ci_low, ci_high, p_value, full_rate FROM k JOIN q USING (model, base_model, pool) JOIN fu USING (model, pool)""",
    "signature_mismatch_rates": f"""WITH {E._rate_draws(_GATE + ', ' + E._CELLS + ", jj AS (SELECT c.method, c.constraint_stack, c.generated, gold_mlir FROM c JOIN gg USING (prompt_id) JOIN eval_pool USING (prompt_id) WHERE gate = 'pass'), mm AS " + _MATCH('jj', 'method, constraint_stack') + ", m0 AS (SELECT method, constraint_stack, match = 'mismatch' AS verify_valid FROM mm)", 'm0', 'method, constraint_stack')}, q AS (SELECT method, constraint_stack, {_Q('rate', 0.025, 'ci_low')}, {_Q('rate', 0.975, 'ci_high')} FROM m GROUP BY 1, 2) SELECT method, constraint_stack, n, round(s / n, 6) AS point, ci_low, ci_high FROM k JOIN q USING (method, constraint_stack)""",
    "transfer_rates": f"WITH {E._FLAGS}, {_TRIALS} SELECT pool, constraint_stack, count(*) AS n, {', '.join(f'round(avg({v}::INT), 6) AS {v}' for v in (*TRANSFER, 'verify'))}, round(avg(functional_match::INT), 6) AS functional_rate FROM f JOIN oc USING (row_id) GROUP BY 1, 2",
    "transfer_residuals": f"WITH {E._pair_draws(E._RES + ', r2 AS (SELECT * FROM r WHERE layer IN ' + str(tuple(TRANSFER)) + ')', 'r2', 'pool, layer')}, {_interval('pool, layer')} SELECT pool, layer, n, round({E._HALF}, 6) AS point, ci_low, ci_high FROM k JOIN q USING (pool, layer)",
    "portability_deltas": " UNION ALL ".join(
        f"""SELECT * FROM (WITH {E._pair_draws(_SCORED + ", w AS (SELECT model, pool, prompt_id, unnest([" + ", ".join(f"struct_pack(rung := '{a}-{b}', a := {E._ARM(metric, a)}, b := {E._ARM(metric, b)})" for a, b in ladder.RUNGS) + "]) AS x FROM sc GROUP BY 1, 2, 3), p AS (SELECT pool, x.rung AS rung, x.a AS a, x.b AS b FROM w WHERE x.a IS NOT NULL AND x.b IS NOT NULL)", "p", "pool, rung")}, {_interval("pool, rung")} SELECT '{metric}' AS metric, pool, rung, n, round({E._HALF}, 6) AS point, ci_low, ci_high, p_value FROM k JOIN q USING (pool, rung))"""
        for metric in ("verify_valid", "functional_match")
    ),
    "reward_kinds": f"""WITH {E.reward_sql}, {_TRIALS}, z AS (SELECT p.row_id, sig * jac AS t, (l.parse_valid AND l.verify_valid)::INT AS o, (l.parse_valid AND coalesce(l.scope_passed_per_try[-1], true) AND l.verify_valid)::INT AS g, tr.match::INT AS hit FROM kk p JOIN ladder l USING (row_id) JOIN tr ON tr.row_id = p.row_id AND trial = 0)
      SELECT row_id, round(g::DOUBLE, 6) AS verify, round(g * t, 6) AS task, round(g * t + g * hit, 6) AS functional, round(o::DOUBLE, 6) AS verify_noc3, round(o * t, 6) AS task_noc3, round(o * t + o * hit, 6) AS functional_noc3 FROM z""",
}
