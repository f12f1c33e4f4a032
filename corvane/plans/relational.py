"""Queries: set operations, fallbacks and summaries over several logs; and conventional analytics on the star schema and the
event stream, which are extensions that Spark gives for free."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import decontam, ladder, split
from corvane.plans.evaluation import cells
from corvane.plans.pool import known_ops, memorization
from corvane.sources import ods
from corvane.store import table
from corvane.validators import as_udf, mlir


def program_source(spark, d):
    """Golds and the distinct parsing answers without constraints, in seeded order, at most 200 of each: the rows probes are asked about."""
    golds = table(spark, d, "train_v1").filter("mlir is not null").select("row_id", F.lit("gold").alias("kind"))
    free = table(spark, d, "ladder").filter("generated is not null and parse_valid and constraint_stack = 'none'").select("row_id", "generated")
    gens = decontam.first_wins(free, F.md5("generated"), "row_id").filter("first").select("row_id", F.lit("generated").alias("kind"))
    w = Window.partitionBy("kind").orderBy(split.order_key(1, F.col("row_id")))
    return golds.unionByName(gens).withColumn("r", F.row_number().over(w)).filter("r <= 200").drop("r")


def rewritten_pool(spark, d):
    """The pool with rewritten prompts; where a rewrite isn't acceptable the original stays, so rows stay aligned."""
    new = F.regexp_replace("nl", "constant|`", "fixed")
    rows = table(spark, d, "train_v1").filter("nl is not null").select("row_id", "nl", new.alias("new"))
    ok = T.rewrite_acceptable(F.col("nl"), F.col("new"))
    return rows.select("row_id", F.md5(F.when(ok, F.col("new")).otherwise(F.col("nl"))).alias("digest"), ok.alias("rewritten"))


def shared_ops(spark, d):
    """Counts of each operation in golds and answers: the multisets' intersection and union."""
    count = lambda t, c, n: t.select(F.explode(T.ops(F.col(c))).alias("op")).groupBy("op").agg(F.count("*").alias(n))
    both = count(table(spark, d, "train_v1"), "mlir", "a").join(count(table(spark, d, "ladder"), "generated", "b"), "op", "full_outer").na.fill(0, ["a", "b"])
    return both.select("op", F.least("a", "b").alias("shared"), F.greatest("a", "b").alias("joined"))


def prompt_sets(spark, d):
    """Prompts solved without constraints, under the full stack, by both and by one only."""
    c = cells(spark, d, "verify_valid").filter("verify_valid")
    s = lambda stack: c.filter(F.col("constraint_stack") == stack).select("pool", "prompt_id").distinct()
    free, full = s("none"), s("c1_c2_c3")
    tag = lambda t, n: t.groupBy("pool").agg(F.count("*").alias("n")).withColumn("which", F.lit(n))
    return tag(free.intersect(full), "both").unionByName(tag(free.exceptAll(full), "free_only")).unionByName(tag(full.exceptAll(free), "full_only"))


def portability(spark, d):
    """Per method without constraints: rates, the scope validator's rate, and how much of the answers is in one gold."""
    text = F.col("generated")
    scope = F.when(text.isNotNull(), as_udf(mlir.check)(F.coalesce(text, F.lit("")))["passed"])  # of these rows alone; the verdicts of others aren't asked for
    rows = table(spark, d, "ladder").filter("constraint_stack = 'none'").select("row_id", "method", "parse_valid", "verify_valid", scope.alias("scope_ok"))
    m = memorization(spark, d).withColumnRenamed("id", "row_id")
    j = rows.join(m, "row_id", "left")
    rate = lambda c: F.round(F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double")), 6)
    return j.groupBy("method").agg(F.count("*").alias("n"), rate("parse_valid").alias("parse_rate"), rate("scope_ok").alias("scope_rate"), rate("verify_valid").alias("verify_rate"), F.round(F.avg("best"), 6).alias("mean_overlap"), F.max("best").alias("max_overlap"), F.count_if("exact").alias("n_exact"))


def arm_fallback(spark, d):
    """Per pool the free rate against the full stack's, or against the masked arm's if any prompt lacks the full stack."""
    wide = ladder.arms(cells(spark, d, "verify_valid"), ["pool", "model", "prompt_id"], {"v": ~F.col("verify_valid")}).filter("v_none is not null and v_c1_c2 is not null")
    g = wide.groupBy("pool").agg(F.bool_and(F.col("v_c1_c2_c3").isNotNull()).alias("has"), F.avg("v_none").alias("free"), F.avg("v_c1_c2").alias("masked"), F.avg("v_c1_c2_c3").alias("full"), F.count("*").alias("n"))
    return g.select("pool", "n", F.when(F.col("has"), "c1_c2_c3").otherwise("c1_c2").alias("arm"), F.round(F.col("free") - F.when(F.col("has"), F.col("full")).otherwise(F.col("masked")), 6).alias("residual"))


def run_outcomes(spark, d):
    """Every (model, pool) of the campaign with its rows, none included: empty groups don't vanish."""
    spine = table(spark, d, "model_pins").select("model").crossJoin(table(spark, d, "eval_pool").select("pool").distinct())  # the campaign's grid
    got = cells(spark, d, "verify_valid").groupBy("model", "pool").agg(F.count("*").alias("n"), F.avg(F.col("verify_valid").cast("double")).alias("rate"))
    return spine.join(got, ["model", "pool"], "left").select("model", "pool", F.coalesce("n", F.lit(0)).alias("n"), F.round("rate", 6).alias("rate"))


DEFINITIONS = """def Arith_AddIOp : Arith_Op<"addi", [Pure, SameOperandsAndResultType]> {
  let arguments = (ins SignlessIntegerLike:$lhs, SignlessIntegerLike:$rhs);
  let results = (outs SignlessIntegerLike:$result);
}
def MemRef_LoadOp : MemRef_Op<"load", []> {
  let arguments = (ins AnyMemRef:$memref, Variadic<Index>:$indices);
  let results = (outs AnyType:$result);
}
"""


def definition_lattice(spark, d):
    """The type lattice of two operation definitions, against the vocabulary of the pool."""
    lat = ods.lattice(ods.td_records(spark.createDataFrame([("ops.td", DEFINITIONS)], "path string, text string")))
    seen = known_ops(spark, d).select(F.explode("known").alias("op")).select(F.substring_index("op", ".", -1).alias("mnemonic")).distinct().withColumn("seen", F.lit(True))
    return lat.join(seen, "mnemonic", "left").select("mnemonic", F.get("operand_arity", F.lit(0)).alias("least"), F.get("operand_arity", F.lit(1)).alias("most"), F.size(F.get("operand_types", F.lit(0))).alias("n_first"), F.coalesce("seen", F.lit(False)).alias("in_pool"))


# Extensions.


def pricing_summary(spark, d):
    li = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(net), 2).alias("sum_net"), F.round(F.sum(net * (1 + F.col("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


def regional_revenue(spark, d):
    t = lambda n: table(spark, d, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def order_cube(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def top_suppliers(spark, d):
    """The three best suppliers of each part by revenue: a top-k report."""
    g = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
    w = Window.partitionBy("l_partkey").orderBy(F.desc("revenue"), "l_suppkey")
    return g.withColumn("rank", F.row_number().over(w)).filter("rank <= 3")


def hourly_events(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_timestamp("w.start").alias("start"), "event_type", "n", "total")


def user_sessions(spark, d):
    """Sessions of a user: gaps of over 12 hours start a new one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.coalesce((F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w)) > 12 * 3600).cast("int"), F.lit(1))
    s = table(spark, d, "events").withColumn("new", new).withColumn("session", F.sum("new").over(w))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (program_source, rewritten_pool, shared_ops, prompt_sets, portability, arm_fallback, run_outcomes, definition_lattice, pricing_summary, regional_revenue, order_cube, top_suppliers, hourly_events, user_sessions)}

_CELLS = "c AS (SELECT * FROM ladder QUALIFY row_number() OVER (PARTITION BY model, pool, constraint_stack, prompt_id ORDER BY ingest_seq DESC) = 1)"
_OPS = r"regexp_extract_all({c}, '\b((?:arith|memref|linalg|func|stablehlo|scf|math|cf|tensor|vector|affine)\.[a-z_]+)\b', 1)"
_KEEP = r"'`[^`]+`|\b(?:i1|i8|i16|i32|i64|f16|f32|f64|index)\b|(?:tensor|memref)<[^>]*>|\b\d+\b'"
SQL = {
    # The two definitions' arity and how many types the first operand may have, read off by hand.
    "definition_lattice": r"""WITH v AS (SELECT op FROM (SELECT unnest(regexp_extract_all(mlir, '\b((?:arith|memref|linalg|func|stablehlo|scf|math|cf|tensor|vector|affine)\.[a-z_]+)\b', 1)) AS op FROM train_v1) GROUP BY op HAVING count(*) >= 5)
      SELECT t.*, mnemonic IN (SELECT string_split(op, '.')[-1] FROM v) AS in_pool FROM (VALUES ('addi', 2, 2, 6), ('load', 1, 1000000, 1)) AS t(mnemonic, least, most, n_first)""",
    "program_source": "WITH g AS (SELECT row_id, 'gold' AS kind FROM train_v1 WHERE mlir IS NOT NULL UNION ALL SELECT min(row_id), 'generated' FROM ladder WHERE generated IS NOT NULL AND parse_valid AND constraint_stack = 'none' GROUP BY generated) SELECT row_id, kind FROM g QUALIFY row_number() OVER (PARTITION BY kind ORDER BY md5('1:' || row_id)) <= 200",
    "rewritten_pool": f"WITH n AS (SELECT row_id, nl, regexp_replace(nl, 'constant|`', 'fixed', 'g') AS new FROM train_v1 WHERE nl IS NOT NULL), k AS (SELECT *, length(new) >= 10 AND lower(new) <> lower(nl) AND len(list_filter(regexp_extract_all(nl, {_KEEP}), lambda x: NOT list_contains(regexp_extract_all(new, {_KEEP}), x))) = 0 AS ok FROM n) SELECT row_id, md5(CASE WHEN ok THEN new ELSE nl END) AS digest, ok AS rewritten FROM k",
    "shared_ops": f"WITH a AS (SELECT op, count(*) AS a FROM (SELECT unnest({_OPS.format(c='mlir')}) AS op FROM train_v1) GROUP BY 1), b AS (SELECT op, count(*) AS b FROM (SELECT unnest({_OPS.format(c='generated')}) AS op FROM ladder) GROUP BY 1) SELECT op, least(coalesce(a, 0), coalesce(b, 0)) AS shared, greatest(coalesce(a, 0), coalesce(b, 0)) AS joined FROM a FULL JOIN b USING (op)",
    "prompt_sets": f"WITH {_CELLS}, f AS (SELECT DISTINCT pool, prompt_id FROM c WHERE verify_valid AND constraint_stack = 'none'), g AS (SELECT DISTINCT pool, prompt_id FROM c WHERE verify_valid AND constraint_stack = 'c1_c2_c3') SELECT pool, count(*) AS n, 'both' AS which FROM (FROM f INTERSECT FROM g) GROUP BY 1 UNION ALL SELECT pool, count(*), 'free_only' FROM (FROM f EXCEPT FROM g) GROUP BY 1 UNION ALL SELECT pool, count(*), 'full_only' FROM (FROM g EXCEPT FROM f) GROUP BY 1",
    "arm_fallback": f"WITH {_CELLS}, w AS (SELECT pool, model, prompt_id, max((NOT verify_valid)::INT) FILTER (constraint_stack = 'none') AS a, max((NOT verify_valid)::INT) FILTER (constraint_stack = 'c1_c2') AS b, max((NOT verify_valid)::INT) FILTER (constraint_stack = 'c1_c2_c3') AS c FROM c GROUP BY 1, 2, 3), g AS (SELECT pool, count(*) AS n, bool_and(c IS NOT NULL) AS has, avg(a) AS f, avg(b) AS m, avg(c) AS u FROM w WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1) SELECT pool, n, CASE WHEN has THEN 'c1_c2_c3' ELSE 'c1_c2' END AS arm, round(f - CASE WHEN has THEN u ELSE m END, 6) AS residual FROM g",
    "run_outcomes": f"WITH {_CELLS}, s AS (SELECT model, pool FROM model_pins, (SELECT DISTINCT pool FROM eval_pool)), g AS (SELECT model, pool, count(*) AS n, avg(verify_valid::INT) AS rate FROM c GROUP BY 1, 2) SELECT model, pool, coalesce(n, 0) AS n, round(rate, 6) AS rate FROM s LEFT JOIN g USING (model, pool)",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "regional_revenue": "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    "order_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "top_suppliers": "SELECT l_partkey, l_suppkey, revenue, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY revenue DESC, l_suppkey) AS rank FROM (SELECT l_partkey, l_suppkey, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY 1, 2)) WHERE rank <= 3",
    "hourly_events": "SELECT epoch(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2000-01-01'))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "user_sessions": "WITH n AS (SELECT *, coalesce((floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) > 43200)::INT, 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM n) SELECT user_id, session::BIGINT AS session, count(*) AS n FROM s GROUP BY 1, 2",
}
