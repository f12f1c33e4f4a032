"""Queries: pools, decontamination, text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import decontam
from corvane.store import table, written


def candidates(spark, d):
    return table(spark, d, "train_v1").select(F.col("row_id").alias("pos"), "nl", "mlir")


def protected(spark, d):
    dev = table(spark, d, "dev_v1").select("nl", "mlir")
    return dev.unionByName(table(spark, d, "eval_pool").select("nl", F.col("gold_mlir").alias("mlir")))


def decontam_rows(spark, d):
    return decontam.decontaminated(candidates(spark, d), protected(spark, d))


def decontam_report(spark, d):
    return decontam.report(decontam_rows(spark, d))


def normalized_prompts(spark, d):
    return table(spark, d, "train_v1").select("row_id", T.norm_nl(F.col("nl")).alias("norm"))


def normalized_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", T.norm_nl(F.col("text")).alias("norm"))


def normalized_programs(spark, d):
    return table(spark, d, "train_v1").select("row_id", T.norm_mlir(F.col("mlir")).alias("norm"))


def first_deliveries(spark, d):
    return decontam.first_wins(table(spark, d, "train_v1").select("row_id", "id"), F.col("id"), "row_id").filter("first").select("row_id", "id")


def keep_first_generations(spark, d):
    rows = table(spark, d, "ladder").filter("generated is not null and parse_valid and constraint_stack = 'none'").select("row_id", "generated")
    return decontam.first_wins(rows, F.md5("generated"), "row_id").filter("first").select("row_id")


def memorization(spark, d):
    gens = table(spark, d, "ladder").filter("constraint_stack = 'none'").select(F.col("row_id").alias("id"), F.col("generated").alias("text"))
    golds = table(spark, d, "train_v1").select(F.col("row_id").alias("gold_id"), F.col("mlir").alias("text"))
    return decontam.memorized(gens, golds)


def memorization_summary(spark, d):
    m = memorization(spark, d)
    return m.agg(F.count("*").alias("n"), F.round(F.avg("best"), 9).alias("mean_best"), F.max("best").alias("max_best"), F.count_if(F.col("best") >= 0.5).alias("n_half"), F.count_if("exact").alias("n_exact"))


def op_vocabulary(spark, d):
    known = table(spark, d, "train_v1").select(F.explode(T.ops(F.col("mlir"))).alias("op"))
    return known.groupBy("op").agg(F.count("*").alias("n"))


#: Names that the vocabulary of operations may have; more are an error, since it is sent to all rows.
VOCABULARY = 20_000


def known_ops(spark, d):
    names = written(op_vocabulary(spark, d).filter("n >= 5"), "vocabulary")
    if names.limit(VOCABULARY + 1).count() > VOCABULARY:
        raise ValueError(f"more than {VOCABULARY} operations are met five times")
    return names.agg(F.collect_set("op").alias("known"))


def unknown_ops(spark, d):
    rows = table(spark, d, "ladder").filter("generated is not null").select("row_id", F.lower("generated").alias("g"))
    # One row: the vocabulary.
    out = rows.crossJoin(F.broadcast(known_ops(spark, d))).select("row_id", T.unknown_ops(F.col("g"), F.col("known")).alias("u"))
    return out.filter(F.size("u") > 0).select("row_id", F.array_join("u", " ").alias("unknown"))


def program_signatures(spark, d):
    s = T.signature(F.col("mlir"))
    return table(spark, d, "train_v1").filter("mlir is not null").select("row_id", F.array_join(s["args"], "|").alias("args"), s["ret"].alias("ret"))


def signature_exclusions(spark, d):
    rows = table(spark, d, "train_v1").select(T.exclusion(T.public_signature(F.col("mlir"))).alias("reason"))
    return rows.groupBy(F.coalesce("reason", F.lit("supported")).alias("reason")).agg(F.count("*").alias("n"))


def value_counts(spark, d):
    return table(spark, d, "train_v1").filter("mlir is not null").select("row_id", F.size(T.values(F.col("mlir"))).alias("n_values"))


def mined_cases(spark, d):
    """Test files: each source's programs, two to a file, with directives; cut into cases again."""
    rows = table(spark, d, "train_v1").filter("source = 'mined_tests' and mlir is not null")
    file = F.concat(F.lit("// RUN: tool %s\n// CHECK-LABEL: @f\n"), F.col("mlir"), F.lit("\n// -----\n// CHECK: second\n"), F.col("mlir"))
    cases = rows.select("row_id", F.posexplode(T.split_cases(file)).alias("case_idx", "case"), F.size(T.check_hints(file)).alias("n_hints"))
    return cases.select("row_id", "case_idx", F.md5("case").alias("digest"), "n_hints")


def program_dialects(spark, d):
    rows = table(spark, d, "train_v1").filter("mlir is not null").select("row_id", F.array_sort(T.dialects(F.regexp_replace("mlir", r"//[^\n]*", ""))).alias("ds"))
    return rows.filter(F.arrays_overlap("ds", F.array(F.lit("linalg"), F.lit("memref")))).select("row_id", F.array_join("ds", " ").alias("dialects"))


def linalg_only(spark, d):
    target = ("linalg.add", "linalg.sub", "linalg.mul", "linalg.div", "linalg.fill", "linalg.max", "linalg.min")
    used = F.array_distinct(F.filter(T.ops(F.col("mlir")), lambda o: o.startswith("linalg.")))
    return table(spark, d, "train_v1").filter((F.size(used) > 0) & (F.size(F.array_except(used, F.array(*map(F.lit, target)))) == 0) & ~F.col("mlir").contains("tensor<")).select("row_id")


def rewrites(spark, d):
    """Prompts rewritten as the answers that repeat them: cleaned, and whether they keep what they must."""
    new = T.clean_rewrite(F.concat(F.lit("Rewritten: "), F.regexp_replace("nl", "constant", "fixed value")))
    return table(spark, d, "train_v1").filter("nl is not null").select("row_id", F.md5(new).alias("digest"), T.rewrite_acceptable(F.col("nl"), new).alias("ok"))


def prompts(spark, d):
    rows = table(spark, d, "eval_pool")
    header = F.when(F.col("gold_mlir").isNotNull(), F.regexp_extract("gold_mlir", r"(func\.func @[\w$.]+\s*\([^)]*\))", 1))
    return rows.select("prompt_id", F.md5(T.chat_prompt(F.col("nl"))).alias("plain"), F.md5(T.chat_prompt(F.col("nl"), header)).alias("with_interface"))


QUERIES = {
    f.__name__: f
    for f in (decontam_report, decontam_rows, normalized_prompts, normalized_documents, normalized_programs, first_deliveries, keep_first_generations, memorization, memorization_summary, op_vocabulary, unknown_ops, program_signatures, signature_exclusions, value_counts, mined_cases, program_dialects, linalg_only, rewrites, prompts)
}

_NL = lambda c: f"trim(regexp_replace(regexp_replace(replace(lower({c}), '`', ''), '[^a-z0-9%?<>.]', ' ', 'g'), ' +', ' ', 'g'))"
_VALUE = "%[A-Za-z0-9_#$.]+"
_STRIPPED = lambda c: f"regexp_replace(regexp_replace({c}, '//[^\\n]*', '', 'g'), '@[A-Za-z_][A-Za-z0-9_]*', '@F', 'g')"


def _mlir(t: str) -> str:
    """SQL: t must be the text with comments and function names already replaced."""
    names, parts = f"regexp_extract_all({t}, '{_VALUE}')", f"string_split_regex({t}, '{_VALUE}')"
    uniq = f"list_transform(list_filter(range(1, len({names}) + 1), lambda i: list_position({names}, ({names})[i]) = i), lambda i: ({names})[i])"
    joined = f"array_to_string(list_transform(range(1, len({parts}) + 1), lambda i: ({parts})[i] || CASE WHEN i <= len({names}) THEN '%v' || (list_position({uniq}, ({names})[i]) - 1)::VARCHAR ELSE '' END), '')"
    return f"trim(regexp_replace(regexp_replace({joined}, '\\s*([,:=\\[\\](){{}}<>])\\s*', '\\1', 'g'), '\\s+', ' ', 'g'))"


_GRAMS = lambda c, n: f"CASE WHEN len({c}) >= {n} THEN list_distinct(list_transform(range(1, len({c}) - {n - 2}), lambda i: array_to_string({c}[i:i+{n - 1}], ' '))) ELSE [] END"
_DECONTAM = f"""
  WITH c0 AS (SELECT row_id AS pos, {_NL("coalesce(nl, '')")} AS nl, {_STRIPPED("coalesce(mlir, '')")} AS m FROM train_v1),
  c AS (SELECT pos, nl, {_mlir("m")} AS mlir FROM c0),
  p0 AS (SELECT nl, mlir FROM dev_v1 UNION ALL SELECT nl, gold_mlir FROM eval_pool),
  pn AS (SELECT DISTINCT {_NL("nl")} AS nl FROM p0 WHERE nl <> ''),
  pm0 AS (SELECT DISTINCT {_STRIPPED("mlir")} AS m FROM p0 WHERE mlir <> ''), pm AS (SELECT DISTINCT {_mlir("m")} AS mlir FROM pm0),
  pw AS (SELECT string_split(nl, ' ') AS w FROM pn), pg AS (SELECT DISTINCT unnest({_GRAMS("w", 8)}) AS g FROM pw),
  cw AS (SELECT pos, string_split(nl, ' ') AS w FROM c), cg AS (SELECT pos, unnest({_GRAMS("w", 8)}) AS g FROM cw),
  r AS (SELECT pos, nl, CASE WHEN nl IN (FROM pn) THEN 'exact_nl_vs_protected' WHEN mlir IN (FROM pm) THEN 'exact_mlir_vs_protected'
        WHEN pos IN (SELECT pos FROM cg WHERE g IN (FROM pg)) THEN 'nl_8gram_overlap_vs_protected' END AS reason FROM c),
  rows_ AS (SELECT pos, coalesce(reason, CASE WHEN pos = min(pos) OVER (PARTITION BY nl, reason IS NULL) THEN 'kept' ELSE 'dup_nl_within_pool' END) AS reason FROM r)
"""
_TOK = r"regexp_extract_all({c}, '\w+|[^\w\s]')"
_MEM = rf"""
  WITH g0 AS (SELECT row_id AS id, generated AS t, regexp_extract_all(generated, '[0-9A-Za-z_]+|[^0-9A-Za-z_\s]') AS w FROM ladder WHERE constraint_stack = 'none' AND generated IS NOT NULL),
  g AS (SELECT id, t, {_GRAMS("w", 8)} AS gs FROM g0), ge AS (SELECT id, unnest(gs) AS g FROM g),
  t0 AS (SELECT row_id AS gold_id, mlir AS t, regexp_extract_all(mlir, '[0-9A-Za-z_]+|[^0-9A-Za-z_\s]') AS w FROM train_v1 WHERE mlir IS NOT NULL),
  te AS (SELECT gold_id, unnest({_GRAMS("w", 8)}) AS g FROM t0),
  h AS (SELECT id, max(c) AS best FROM (SELECT id, gold_id, count(*) AS c FROM ge JOIN te USING (g) GROUP BY 1, 2) GROUP BY 1),
  x AS (SELECT DISTINCT trim(regexp_replace(t, '\s+', ' ', 'g')) AS s FROM t0),
  m AS (SELECT id, len(gs) AS n_grams, CASE WHEN len(gs) > 0 THEN coalesce(best, 0) / len(gs) ELSE 0.0 END AS best, len(gs) > 0 AND trim(regexp_replace(t, '\s+', ' ', 'g')) IN (FROM x) AS exact FROM g LEFT JOIN h USING (id))
"""
_OPS = r"regexp_extract_all({c}, '\b((?:arith|memref|linalg|func|stablehlo|scf|math|cf|tensor|vector|affine)\.[a-z_]+)\b', 1)"
_SIG = r"func\.func\s+@[\w$.]+\s*\(([^)]*)\)\s*(?:->\s*([^{]+?))?\s*\{"
_PUB = r"func\.func\s+@(\w+)\s*\(([^)]*)\)\s*(?:->\s*([^{]+?))?\s*\{"
_ARGS = lambda c, p, g: f"list_transform(list_filter(string_split(regexp_extract({c}, '(?s){p}', {g}), ','), lambda a: contains(a, ':')), lambda a: regexp_replace(regexp_replace(a, '(?s)^[^:]*:', ''), '\\s+', '', 'g'))"
def excluded_sql(table: str, column: str, keys: str = "") -> str:
    """SQL with ex(keys, reason): why each program can't be run by the differential harness, or 'supported'."""
    more = keys + ", " if keys else ""
    return f"""s AS (SELECT {more}regexp_matches({column}, '{_PUB}') AS ok, regexp_extract({column}, '{_PUB}', 1) AS name, replace(trim(regexp_extract({column}, '{_PUB}', 3)), ' ', '') AS ret,
        list_transform(list_filter(string_split(regexp_extract({column}, '{_PUB}', 2), ','), lambda a: trim(a) <> ''), lambda a: replace(regexp_replace(a, '.*:', ''), ' ', '')) AS args FROM {table}),
      ex AS (SELECT {more}CASE WHEN NOT coalesce(ok, false) THEN 'no_public_fn' WHEN name = 'main' THEN 'fn_named_main' WHEN ret <> '' AND (ret LIKE '(%' OR ret LIKE '%,%') THEN 'multi_result'
        WHEN ret <> '' AND ret NOT IN ('i1','i8','i16','i32','i64','f16','f32','f64','index') THEN 'unsupported_ret_type'
        WHEN len(list_filter(args, lambda t: t LIKE 'memref%' AND NOT regexp_matches(t, '^memref<(\\?|\\d+)(x(\\?|\\d+))*x[fi]\\d+>$'))) > 0 THEN 'unsupported_memref_type'
        WHEN len(list_filter(args, lambda t: t LIKE 'memref%' AND NOT regexp_matches(t, 'x(f32|f64|i32|i64)>$'))) > 0 THEN 'unprintable_memref_dtype'
        WHEN len(list_filter(args, lambda t: t NOT LIKE 'memref%' AND t NOT IN ('i1','i8','i16','i32','i64','f16','f32','f64','index'))) > 0 THEN 'unsupported_arg_type'
        WHEN ret = '' AND len(list_filter(args, lambda t: t LIKE 'memref%')) = 0 THEN 'no_observable_output' ELSE 'supported' END AS reason FROM s)"""


SQL = {
    "decontam_report": _DECONTAM + "SELECT reason, count(*) AS n FROM rows_ GROUP BY reason",
    "decontam_rows": _DECONTAM + "SELECT pos, reason FROM rows_",
    "normalized_prompts": f"SELECT row_id, {_NL('nl')} AS norm FROM train_v1",
    "normalized_documents": f"SELECT doc_id, {_NL('text')} AS norm FROM documents",
    "normalized_programs": f"SELECT row_id, {_mlir('m')} AS norm FROM (SELECT row_id, {_STRIPPED('mlir')} AS m FROM train_v1)",
    "first_deliveries": "SELECT min(row_id) AS row_id, id FROM train_v1 GROUP BY id",
    "keep_first_generations": "SELECT min(row_id) AS row_id FROM ladder WHERE generated IS NOT NULL AND parse_valid AND constraint_stack = 'none' GROUP BY generated",
    "memorization": _MEM + "SELECT * FROM m",
    "memorization_summary": _MEM + "SELECT count(*) AS n, round(avg(best), 9) AS mean_best, max(best) AS max_best, count(*) FILTER (best >= 0.5) AS n_half, count(*) FILTER (exact) AS n_exact FROM m",
    "op_vocabulary": f"SELECT op, count(*) AS n FROM (SELECT unnest({_OPS.format(c='mlir')}) AS op FROM train_v1) GROUP BY op",
    "unknown_ops": f"""WITH v AS (SELECT op FROM (SELECT unnest({_OPS.format(c='mlir')}) AS op FROM train_v1) GROUP BY op HAVING count(*) >= 5),
      u AS (SELECT DISTINCT row_id, unnest({_OPS.format(c='lower(generated)')}) AS op FROM ladder WHERE generated IS NOT NULL)
      SELECT row_id, string_agg(op, ' ' ORDER BY op) AS unknown FROM u WHERE op NOT IN (FROM v) GROUP BY row_id""",
    "program_signatures": f"""SELECT row_id, CASE WHEN regexp_matches(mlir, '(?s){_SIG}') THEN array_to_string({_ARGS('mlir', _SIG, 1)}, '|') END AS args,
      CASE WHEN regexp_matches(mlir, '(?s){_SIG}') THEN regexp_replace(regexp_extract(mlir, '(?s){_SIG}', 2), '\\s+', '', 'g') END AS ret FROM train_v1 WHERE mlir IS NOT NULL""",
    "signature_exclusions": f"WITH {excluded_sql('train_v1', 'mlir')} SELECT reason, count(*) AS n FROM ex GROUP BY reason",
    "value_counts": "SELECT row_id, len(list_distinct(regexp_extract_all(mlir, '%[A-Za-z0-9_$.]+'))) AS n_values FROM train_v1 WHERE mlir IS NOT NULL",
    "mined_cases": """SELECT row_id, i - 1 AS case_idx, md5(trim(mlir, chr(32) || chr(9) || chr(10) || chr(13)) || chr(10)) AS digest, 2 AS n_hints FROM
      (SELECT row_id, array_to_string(list_filter(string_split_regex(mlir, '\\r?\\n'), lambda x: NOT regexp_matches(trim(x), '^//\\s*([A-Z][A-Z0-9_]*)(-(NEXT|SAME|DAG|NOT|LABEL|EMPTY|COUNT-\\d+))*\\s*:')), chr(10)) AS mlir, unnest([1, 2]) AS i FROM train_v1 WHERE source = 'mined_tests' AND mlir IS NOT NULL)""",
    "program_dialects": """SELECT row_id, array_to_string(list_sort(ds), ' ') AS dialects FROM (SELECT row_id, list_distinct(regexp_extract_all(regexp_replace(mlir, '//[^\\n]*', '', 'g'), '([a-z_][a-z_0-9]*)\\.[a-z_]', 1)) AS ds FROM train_v1 WHERE mlir IS NOT NULL)
      WHERE list_has_any(ds, ['linalg', 'memref'])""",
    "linalg_only": f"""SELECT row_id FROM (SELECT row_id, mlir, list_filter({_OPS.format(c='mlir')}, lambda o: o LIKE 'linalg.%') AS u FROM train_v1) WHERE len(u) > 0
      AND len(list_filter(u, lambda o: o NOT IN ('linalg.add','linalg.sub','linalg.mul','linalg.div','linalg.fill','linalg.max','linalg.min'))) = 0 AND NOT contains(mlir, 'tensor<')""",
    "rewrites": r"""WITH n AS (SELECT row_id, nl, trim(trim(trim(regexp_replace(trim(string_split_regex(trim('Rewritten: ' || replace(nl, 'constant', 'fixed value'), chr(32) || chr(9) || chr(10) || chr(13)), '\r?\n')[1]), '(?i)^(?:rewritten(?: instruction)?|instruction)\s*:\s*', '')), '"')) AS new FROM train_v1 WHERE nl IS NOT NULL),
      k AS (SELECT *, regexp_extract_all(nl, '`[^`]+`|\b(?:i1|i8|i16|i32|i64|f16|f32|f64|index)\b|(?:tensor|memref)<[^>]*>|\b\d+\b') AS a, regexp_extract_all(new, '`[^`]+`|\b(?:i1|i8|i16|i32|i64|f16|f32|f64|index)\b|(?:tensor|memref)<[^>]*>|\b\d+\b') AS b FROM n)
      SELECT row_id, md5(new) AS digest, length(new) >= 10 AND lower(new) <> lower(nl) AND len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS ok FROM k""",
    "prompts": r"""SELECT prompt_id, md5('<|im_start|>user' || chr(10) || nl || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) AS plain,
      md5('<|im_start|>user' || chr(10) || nl || coalesce(chr(10) || 'Use exactly this interface: ' || CASE WHEN gold_mlir IS NOT NULL THEN regexp_extract(gold_mlir, '(func\.func @[\w$.]+\s*\([^)]*\))', 1) END, '') || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) AS with_interface FROM eval_pool""",
}
