"""Queries: planning of runs, prompts with examples, verifiers by command, lowered pools, patch pairs, layers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from corvane import registry
from corvane.functions import harness
from corvane.functions import text as T
from corvane.operators import lowering, probe
from corvane.plans import evaluation as E
from corvane.sources.jsonl import parse_cells
from corvane.store import table, written

SPECS = ("base brindle-150m", "tuned brindle-150m ckpt/step_100", "large cobalt-1500m")


def cell_specs(spark, d):
    """Cells of a grid from their specs, with what the pins say of each model."""
    cells = spark.createDataFrame([(c["tag"], c["model"], c["ckpt"], c["trained"]) for c in parse_cells(list(SPECS))], "tag string, model string, ckpt string, trained boolean")
    pins = table(spark, d, "model_pins").select("model", "family")
    return cells.join(pins, "model", "left")


#: (ablation, value, method, n_train, low-rank): null keeps the base's.
ABLATIONS = (("base", "1", None, None, None), ("lora_vs_full", "full", None, None, False), ("reward_only", "1", "grpo", None, None), *(("pool_size", f"{n // 1000}k", None, n, None) for n in (1000, 3000, 8000)))


def ablation_plan(spark, d):
    """Each family's runs of each ablation: its setting, why it is skipped, and the first run with the very same setting that covers it."""
    pool = table(spark, d, "train_v1").agg(F.count("*").alias("pool_rows"))
    base = table(spark, d, "model_pins").groupBy("family").agg(F.max("params_m").alias("size")).select("family", (F.coalesce("size", F.lit(0.0)) >= 1000).alias("low_rank"))
    grid = spark.createDataFrame([(i, *a) for i, a in enumerate(ABLATIONS)], "place int, ablation string, value string, method string, n_train int, low boolean")
    every = base.crossJoin(F.broadcast(grid)).crossJoin(F.broadcast(pool))  # the families by the settings, and one row
    setting = F.struct("family", F.coalesce("method", F.lit("ssd")).alias("method"), F.least(F.coalesce("n_train", F.lit(3000)), "pool_rows").alias("n_train"), F.coalesce("low", "low_rank").alias("low_rank"))
    rows = every.select("place", "ablation", "value", setting.alias("s"), F.when((F.col("ablation") == "lora_vs_full") & ~F.col("low_rank"), "is full already").alias("skip"), (F.col("n_train") > F.col("pool_rows")).alias("whole_pool"))
    first = rows.groupBy("s").agg(F.min_by(F.concat_ws("__", "s.family", "ablation", "value"), "place").alias("covered_by"))
    tag = F.concat_ws("__", "s.family", "ablation", "value")
    return rows.join(first, "s").select(tag.alias("tag"), "s.method", F.col("s.n_train").cast("long").alias("n_train"), "s.low_rank", "skip", F.coalesce("whole_pool", F.lit(False)).alias("whole_pool"), F.when(F.col("covered_by") != tag, F.col("covered_by")).alias("covered_by"))


EXAMPLES = (("Add two numbers.", "module {}"), ("Give one.", "func.func @one() -> i32 {}"))


def few_shot_prompts(spark, d):
    return table(spark, d, "eval_pool").select("prompt_id", F.md5(T.few_shot_prompt(F.col("nl"), list(EXAMPLES))).alias("prompt"))


def command_verdicts(spark, d):
    """Golds by the exit code of a command that reads them; those without a function aren't run."""
    golds = table(spark, d, "eval_pool").select("prompt_id", "gold_mlir")
    got = registry.RUNNERS["command"](golds, "gold_mlir", ["grep", "-q", "arith[.]add"], needs="func.func @")
    return got.select("prompt_id", "returncode")


def known_outputs(spark, d):
    """The same rows by a runner whose outputs are a table that lacks the odd prompts."""
    golds = table(spark, d, "eval_pool").select("prompt_id")
    outputs = golds.filter("prompt_id % 2 = 0").select("prompt_id", F.lit(0).alias("returncode"), F.lit("").alias("stdout"), F.lit("").alias("stderr"))
    return registry.RUNNERS["table"](golds, outputs, ["prompt_id"]).select("prompt_id", "returncode")


KEEP = 300


def _lowered(spark, d):
    rows = table(spark, d, "train_v1").filter("mlir is not null").select("row_id", "mlir", "nl")
    return lowering.until_kept(written(lowering.lowered(rows, ["row_id", "nl"], "mlir"), "lowered"), "row_id", KEEP)


def llvm_pool(spark, d):
    """The first KEEP programs that can be lowered, with their prompts said of LLVM."""
    return _lowered(spark, d).filter("reason = 'kept'").select("row_id", F.md5(F.regexp_replace("nl", r"\bMLIR\b", "LLVM IR")).alias("prompt"), F.md5("ir").alias("ir"))


def llvm_pool_reasons(spark, d):
    return _lowered(spark, d).groupBy("reason").agg(F.count("*").alias("n"))


def patch_pairs(spark, d):
    """Per program, the clean and the corrupted pieces around its last use of a name in scope."""

    @F.pandas_udf("n_clean int, n_changed int, clean_at int, corrupt_at int, target string, n_inside int, n_outside int")
    def run(s: pd.Series) -> pd.DataFrame:
        def one(text):
            for _, _, at, _ in reversed([e for e in harness.scope_events(text) if e[0] == "use"]):
                p = harness.patch_pair(text, at)
                if p:
                    changed = abs(len(p["clean"]) - len(p["corrupt"])) + sum(a != b for a, b in zip(p["clean"], p["corrupt"]))
                    return len(p["clean"]), changed, p["clean_at"], p["corrupt_at"], p["target"], len(p["inside"]), len(p["outside"])
            return (None,) * 7

        return pd.DataFrame([one(t) for t in s], columns=["n_clean", "n_changed", "clean_at", "corrupt_at", "target", "n_inside", "n_outside"])

    rows = table(spark, d, "train_v1").filter("mlir is not null").select("row_id", run("mlir").alias("p")).select("row_id", "p.*")
    return rows.filter("n_clean is not null")


def best_layers(spark, d):
    """Per design, its best, first and last layer. A place of the embeddings stands for a layer: how often its sign tells the label's parity."""
    e = table(spark, d, "embeddings").select((F.col("label") % 3).alias("design"), "label", F.posexplode(F.slice("embedding", 1, 16)).alias("layer", "x"))
    acc = e.groupBy("design", "layer").agg(F.avg(((F.col("x") > 0) == (F.col("label") % 2 == 1)).cast("double")).alias("acc"))
    got = probe.best_layer(acc, ["design"])
    return got.select(F.col("design").cast("long").alias("design"), F.col("best").cast("long").alias("best"), *[F.round(c, 6).alias(c) for c in ("best_acc", "first_acc", "last_acc")])


def task_registry(spark, d):
    """The reward of each task kind by the registry, summed over the golds' answers."""
    parts = E.task_parts(spark, d)
    scope = F.coalesce(F.element_at(F.when(F.size("scope_passed_per_try") > 0, F.col("scope_passed_per_try")), -1), F.lit(True))
    task = registry.TASKS["mlir"]
    kinds = ("verify", "verify_noc3", "task", "task_noc3")
    cols = [F.round(F.sum(task.reward(F.col("parse_valid"), scope, F.col("verify_valid"), F.col("sig"), F.col("jac"), F.lit(False), k)), 4).alias(k) for k in kinds]
    return parts.agg(*cols)


QUERIES = {f.__name__: f for f in (cell_specs, ablation_plan, few_shot_prompts, command_verdicts, known_outputs, llvm_pool, llvm_pool_reasons, patch_pairs, best_layers, task_registry)}

_SHOTS = "".join(f"<|im_start|>user\n{q}<|im_end|>\n<|im_start|>assistant\n{a}<|im_end|>\n" for q, a in EXAMPLES)
_NULL = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v)
SQL = {
    "cell_specs": "SELECT t.*, family FROM (VALUES ('base', 'brindle-150m', NULL, false), ('tuned', 'brindle-150m', 'ckpt/step_100', true), ('large', 'cobalt-1500m', NULL, false)) AS t(tag, model, ckpt, trained) LEFT JOIN model_pins USING (model)",
    "ablation_plan": f"""WITH b AS (SELECT family, coalesce(max(params_m), 0) >= 1000 AS low_rank FROM model_pins GROUP BY 1), g(place, ablation, value, method, n_train, low) AS (VALUES {", ".join("(" + ", ".join(_NULL(x) for x in (i, *a)) + ")" for i, a in enumerate(ABLATIONS))}),
      e AS (SELECT *, (SELECT count(*) FROM train_v1) AS pool FROM b, g), r AS (SELECT place, family || '__' || ablation || '__' || value AS tag, family, coalesce(method, 'ssd') AS method, least(coalesce(n_train, 3000), pool) AS n, coalesce(low::BOOLEAN, low_rank) AS low_rank, CASE WHEN ablation = 'lora_vs_full' AND NOT e.low_rank THEN 'is full already' END AS skip, coalesce(n_train > pool, false) AS whole_pool FROM e),
      f AS (SELECT *, first_value(tag) OVER (PARTITION BY family, method, n, low_rank ORDER BY place) AS c FROM r) SELECT tag, method, n AS n_train, low_rank, skip, whole_pool, CASE WHEN c <> tag THEN c END AS covered_by FROM f""",
    "few_shot_prompts": "SELECT prompt_id, md5('" + _SHOTS.replace("'", "''") + "' || '<|im_start|>user' || chr(10) || nl || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) AS prompt FROM eval_pool",
    "command_verdicts": "SELECT prompt_id, CASE WHEN NOT coalesce(contains(gold_mlir, 'func.func @'), false) THEN -3 WHEN regexp_matches(gold_mlir, 'arith[.]add') THEN 0 ELSE 1 END AS returncode FROM eval_pool",
    "known_outputs": "SELECT prompt_id, CASE WHEN prompt_id % 2 = 0 THEN 0 ELSE -2 END AS returncode FROM eval_pool",
    "best_layers": """WITH e AS (SELECT label, embedding, unnest(range(1, 17)) AS i FROM embeddings), a AS (SELECT label % 3 AS design, i - 1 AS layer, avg(((embedding[i] > 0) = (label % 2 = 1))::INT) AS acc FROM e GROUP BY 1, 2)
      SELECT design::BIGINT AS design, arg_max(layer, acc * 1000 - layer / 1e9)::BIGINT AS best, round(max(acc), 6) AS best_acc, round(arg_min(acc, layer), 6) AS first_acc, round(arg_max(acc, layer), 6) AS last_acc FROM a GROUP BY 1""",
    "task_registry": f"""WITH {E.reward_sql}, z AS (SELECT sig * jac AS t, (l.parse_valid AND l.verify_valid)::INT AS o, (l.parse_valid AND coalesce(l.scope_passed_per_try[-1], true) AND l.verify_valid)::INT AS g FROM kk JOIN ladder l USING (row_id))
      SELECT round(sum(g)::DOUBLE, 4) AS verify, round(sum(o)::DOUBLE, 4) AS verify_noc3, round(sum(g * t), 4) AS task, round(sum(o * t), 4) AS task_noc3 FROM z""",
}
