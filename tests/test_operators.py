import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane import store
from corvane.operators import components, decontam, fit, generators, ladder, passk, probe, split, stats
from corvane.sources import jsonl, ods, sinks
from corvane.streaming import ingest
from corvane.validators import as_udf, llvm, mlir, synth


def test_decontamination_order(spark):
    long = "one two three four five six seven eight nine"
    cand = [(1, "Alpha!", "m1"), (2, "new words", "func @x"), (3, f"say {long}", "m3"), (4, "fresh", "m4"), (5, "FRESH", "m5"), (6, "new words", "m6"), (7, None, None), (8, None, "m8")]
    prot = [("alpha", ""), ("", "func @y"), (long, None)]
    got = dict(decontam.decontaminated(spark.createDataFrame(cand, "pos long, nl string, mlir string"), spark.createDataFrame(prot, "nl string, mlir string")).collect())
    assert got == {1: "exact_nl_vs_protected", 2: "exact_mlir_vs_protected", 3: "nl_8gram_overlap_vs_protected", 4: "kept", 5: "dup_nl_within_pool", 6: "kept", 7: "kept", 8: "dup_nl_within_pool"}


def test_decontamination_is_the_same_at_any_partitioning(spark):
    rows = spark.createDataFrame([(i, f"prompt {i % 7}", f"m{i % 3}") for i in range(100)], "pos long, nl string, mlir string")
    none = rows.limit(0).select("nl", "mlir")
    a, b = (sorted(decontam.decontaminated(rows.repartition(n), none).collect()) for n in (1, 13))
    assert a == b and sum(r.reason == "kept" for r in a) == 7


def test_memorization(spark):
    words = [f"w{i}" for i in range(12)]
    gens = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:9]) + " z z z z"), (3, "few"), (4, None)], "id long, text string")
    golds = spark.createDataFrame([(1, "  ".join(words)), (2, None)], "gold_id long, text string")
    got = {r.id: (r.n_grams, round(r.best, 4), r.exact) for r in decontam.memorized(gens, golds).collect()}
    assert got == {1: (5, 1.0, True), 2: (6, 0.3333, False), 3: (0, 0.0, False)}


def test_memorization_keeps_no_grams_of_one_side_alone(spark):
    rng = random.Random(3)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(400))
    gens, golds = ([(i, text() + " a b c d e f g h") for i in range(100)] for _ in range(2))
    before = len(store._tables)
    got = decontam.memorized(spark.createDataFrame(gens, "id long, text string"), spark.createDataFrame(golds, "gold_id long, text string")).collect()
    assert {(r.n_grams, round(r.best * r.n_grams), r.exact) for r in got} == {(401, 1, False)} and len(got) == 100
    kept = sum(p.stat().st_size for t in store._tables[before:] for p in Path(t.removeprefix("file:")).rglob("*.parquet"))
    assert kept < 8 * 401 * 100 / 2  # half of what the hashes of the generations take


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges for x in e if e[0] != e[1]}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rates_and_intervals(spark):
    rows = spark.createDataFrame([("g", i, int(i % 4 != 0)) for i in range(40)], "k string, id long, x int")
    r = stats.interval(rows, ["k"], "id", "x", 200).first()
    assert r.n == 40 and r.point == 0.75 and r.ci_low < 0.75 < r.ci_high
    q = stats.rank_interval(rows, ["k"], "id", "x", 200).first()
    assert abs(q.ci_low - r.ci_low) < 0.05
    assert math.isnan(rows.limit(0).agg(stats.pass_rate(F.col("x"))).first()[0])
    n = stats.numpy_interval(rows, ["k"], "id", "x", None, 500).first()
    x = np.array([float(i % 4 != 0) for i in range(40)])
    assert (n.ci_low, n.ci_high) == tuple(np.quantile(np.random.default_rng(0).choice(x, size=(500, 40), replace=True).mean(axis=1), [0.025, 0.975]))


def test_paired_residual(spark):
    rows = spark.createDataFrame([("g", i, int(i % 4 == 0), int(i % 10 == 0)) for i in range(200)], "k string, id long, a int, b int")
    r = stats.paired_interval(rows, ["k"], "id", "a", "b", 200).first()
    assert r.n == 200 and abs(r.point - 0.15) < 1e-12 and r.ci_low < 0.15 < r.ci_high and r.p_value == 0.0
    m = stats.numpy_interval(rows, ["k"], "id", "a", "b", 500).first()
    assert abs(m.point - 0.15) < 1e-12 and m.p_value == 0.0


def test_detectable_effect():
    assert stats.min_detectable_effect(0) == math.inf and stats.min_detectable_effect(100) > stats.min_detectable_effect(400)
    assert abs(stats.min_detectable_effect(150) - 0.1617) < 1e-3


def test_power_law_is_recovered(spark):
    pts = [(float(d), s, 0.3 * d**0.6 * s**-0.25) for d in (2, 4, 8, 16, 32, 64) for s in (1e8, 4e8, 2e9)]
    df = spark.createDataFrame(pts, "d double, s double, r double")
    got = fit.power_law(df, F.col("d"), F.col("s"), F.col("r")).first()
    assert abs(got.a - 0.3) < 1e-9 and abs(got.alpha - 0.6) < 1e-9 and abs(got.beta - 0.25) < 1e-9 and abs(got.r2 - 1) < 1e-9 and got.n == 18
    assert fit.power_law(df.limit(2), F.col("d"), F.col("s"), F.col("r")).first().alpha is None
    zero = spark.createDataFrame([("m", 1.0, 0.0), ("m", 2.0, 0.1)], "k string, x double, y double")
    assert fit.log_fit(zero, ["k"], F.col("x"), F.col("y")).first().n_clipped == 1


def test_passk(spark):
    s = spark.createDataFrame([("m", p, k, (p, k) in {(1, 1), (2, 3), (2, 1)} and not (p, k) == (2, 1)) for p in (1, 2, 3) for k in (1, 2, 3)], "model string, p int, sample int, ok boolean")
    got = {r.k: r.solved for r in passk.curve(passk.first_hits(s, ["model", "p"], "ok"), ["model"], 3).collect()}
    assert got == {1: 1, 2: 1, 3: 2}
    t = spark.createDataFrame([(1, True), (1, True), (2, True), (2, False), (3, True)], "p int, ok boolean")
    assert {r.p: r.correct for r in passk.all_trials(t, ["p"], "ok", 2).collect()} == {1: True, 2: False, 3: False}
    o = passk.overlap(spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,), (4,)], "k int"), ["k"]).first()
    assert (o.both, o.only_a, o.only_b) == (1, 1, 2)
    a = spark.createDataFrame([(1, 1.0), (1, 0.0), (2, 0.5), (2, 0.5)], "g int, r double")
    assert sorted(round(x.adv, 3) for x in passk.advantages(a, "g", F.col("r")).collect()) == [-1.0, 0.0, 0.0, 1.0]
    tries = spark.createDataFrame([(1, 0, False), (1, 1, True), (1, 2, True), (2, 0, False), (2, 1, False)], "p int, t int, ok boolean")
    assert {r.p: r.t for r in passk.first_ok(tries, ["p"], "ok", "t").collect()} == {1: 1, 2: 1}


def test_ladder_last_write_wins(spark):
    rows = spark.createDataFrame([("m", "p", "none", 1, 5, True), ("m", "p", "none", 1, 2, False), ("m", "p", "c1", 1, 3, True), ("m", "p", "c1", 2, 4, True)], "model string, pool string, constraint_stack string, prompt_id int, ingest_seq long, verify_valid boolean")
    cells = ladder.latest(rows)
    assert cells.count() == 3 and cells.filter("constraint_stack = 'none'").first().verify_valid
    assert [(r.rung, r.a, r.b) for r in ladder.rung_pairs(cells).collect()] == [("c1-none", 1, 1)]


def test_splits_dont_depend_on_partitioning(spark):
    rows = spark.range(200).select("id", F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("s"))
    a, b = (sorted(split.stratified(rows.repartition(n), "id", "s", {"a": (10, 20), "b": (5, 5)}, 1).collect()) for n in (1, 9))
    assert a == b and len(a) == 40 and sum(r.split == "dev" for r in a) == 15
    f = split.folds(rows.withColumn("g", F.col("id") % 17), "g", 4, 0)
    assert f.groupBy("g").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0 and f.select("fold").distinct().count() == 4
    top = split.topped_up(rows.filter("s = 'b'").limit(3), rows.filter("s = 'a'"), "id", 10, 2)
    assert top.count() == 10 and top.filter("s = 'b'").count() == 3
    assert split.dev_quotas({"a": 300, "l": 100}, "a", 10) == {"a": 7, "l": 3}


def test_probe_learns_and_control_does_not(spark):
    rng = np.random.default_rng(0)
    rows = [("d", int(i), int(i // 2), [float(x) for x in v], float(v[0] > 0)) for i, v in enumerate(rng.normal(size=(240, 6)))]
    got = probe.cross_validated(spark.createDataFrame(rows, "design string, id long, g long, v array<double>, y double"), ["design"], "g", "v", "y", 3).collect()
    assert len(got) == 3 and min(r.accuracy for r in got) > 0.85 and max(r.control for r in got) < 0.75


def test_arrays(spark):
    e = lambda c: spark.range(1).select(c.alias("x")).first().x
    lits = lambda xs: F.array(*map(F.lit, xs))
    words = e(probe.packed(lits([0, 33, 34, 63]), 2))
    assert words == [1, 2 + 4 + 2**31]
    assert [e(probe.allowed(lits(words), F.lit(b))) for b in (0, 1, 33, 63, 64)] == [True, False, True, True, False]
    assert e(probe.entropy_bits(lits([0.5, 0.5, 0.0]))) == 1.0
    assert abs(e(probe.legal_mass(lits([0.0, 0.0, 0.0, 0.0]), lits([5]))) - 0.5) < 1e-12
    assert [(x.bucket, round(x.weight, 9)) for x in e(probe.hashed_bag(lits([1, 65, 2]), 64))] == [(1, round(math.log(3), 9)), (2, round(math.log(2), 9))]
    assert e(probe.recovery(F.lit(1.0), F.lit(0.0), F.lit(0.25))) == 0.25 and e(probe.recovery(F.lit(0.05), F.lit(0.0), F.lit(0.2))) is None


@pytest.mark.parametrize("d", [2, 4, 8, 16, 32, 64])
def test_synthetic_programs_have_the_distance_asked_for(d):
    for n in (1, 3, 6):
        for z in (0, 1, 2):
            for s in range(3):
                p = synth.generate(d, n, z, s)
                assert p == synth.generate(d, n, z, s)
                assert synth.check(p) == [] and max(x[3] for x in synth.distances(p)) == d and synth.reward(p, p) == 1.0


def test_synthetic_violations():
    kind = lambda body: {k for k, _, _ in synth.check("prog {\n" + body + "\n}")}
    c = "%a = const 1 : int[2]\n"
    assert kind(c + "ret %a : int[2]") == set() and kind(c + "ret %b : int[2]") == {"undef_use"} and kind(c + "ret %a : flt[2]") == {"type_mismatch"} and kind(c + "ret %a : int[3]") == {"shape_mismatch"}
    assert kind(c + c + "ret %a : int[2]") == {"redef"} and kind("%a = const 1.5 : int[2]\nret %a : int[2]") == {"literal"} and kind(c + "%b = addf %a , %a : int[2]\nret %b : int[2]") == {"type_domain"}
    assert kind("{ %b = const 1 : int[2] }\nret %b : int[2]") == {"dead_use"} and kind("{ }\n" + c + "ret %a : int[2]") == {"parse"} and kind(c) == {"parse"} and kind("ret %a : int[2]\n" + c) == {"parse"}
    assert synth.accept("prog { " + c + "ret %a : int[3] }") and not synth.accept("prog { ret %a : int[2] }")


def fn(body, params="%a : i32, %f : f32, %m : memref<4xf32>", ret="i32"):
    return f"module {{\n func.func @f({params}) -> {ret} {{\n{body}\n }}\n}}"


MLIR_CASES = [
    ("%r = arith.addi %a, %a : i32\nreturn %r : i32", set()), ("%r = arith.addi %a, %b : i32\nreturn %r : i32", {"undef_use"}), ("%r = arith.addi %a, %f : i32\nreturn %r : i32", {"type_mismatch"}), ("%r = arith.addf %f, %f : f32\nreturn %r : i32", {"type_mismatch"}),
    ("%c = arith.cmpi slt, %a, %a : i32\n%r = arith.select %c, %a, %a : i32\nreturn %r : i32", set()), ("%r = arith.select %a, %a, %a : i32\nreturn %r : i32", {"type_mismatch"}), ("%r = arith.fptosi %f : f32 to i32\nreturn %r : i32", set()), ("%r = arith.fptosi %a : f32 to i32\nreturn %a : i32", {"type_mismatch"}),
    ("%i = arith.constant 0 : index\n%x = memref.load %m[%i] : memref<4xf32>\n%y = arith.addf %x, %f : f32\nreturn %a : i32", set()), ("%x = memref.load %m[%a] : memref<4xf32>\nreturn %a : i32", {"type_mismatch"}), ("%i = arith.constant 0 : index\nmemref.store %a, %m[%i] : memref<4xf32>\nreturn %a : i32", {"type_mismatch"}),
    ("linalg.fill ins(%f : f32) outs(%m : memref<4xf32>)\nreturn %a : i32", set()), ("linalg.fill ins(%a : i32) outs(%m : memref<4xf32>)\nreturn %a : i32", {"type_mismatch"}), ("linalg.add ins(%m, %q : memref<4xf32>, memref<4xf32>) outs(%m : memref<4xf32>)\nreturn %a : i32", {"undef_use"}),
    ("%z = odd.op %nothing\nreturn %a : i32", set()), ("%d = memref.dim %m, %a : memref<4xf32>\nreturn %a : i32", {"type_mismatch"}), ("// uses %nothing\n%r = arith.muli %a,\n  %a : i32\nreturn %r : i32", set()), ("%r = arith.constant 1 : i32 %s = arith.addi %r, %a : i32 return %s : i32", set()),
    ("%c0 = arith.constant 0 : index\n%s = scf.for %i = %c0 to %c0 step %c0 iter_args(%acc = %f) -> (f32) {\n%t = arith.addf %acc, %f : f32\nscf.yield %t : f32\n}\n%u = arith.addf %s, %f : f32\nreturn %a : i32", set()),
    ("%c0 = arith.constant 0 : index\nscf.for %i = %c0 to %c0 step %c0 {\n%t = arith.addf %f, %f : f32\n}\n%u = arith.addf %t, %f : f32\nreturn %a : i32", {"undef_use"}), ("%c0 = arith.constant 0 : index\n%s = scf.for %i = %c0 to %c0 step %c0 iter_args(%acc = %f) -> (f32) {\n}\nreturn %a : i32", {"yield_mismatch"}),
    ("%c = arith.cmpi eq, %a, %a : i32\n%r = scf.if %c -> (i32) {\nscf.yield %a : i32\n} else {\nscf.yield %f : f32\n}\nreturn %r : i32", {"yield_mismatch"}), ("%c = arith.cmpi eq, %a, %a : i32\n%r = scf.if %c -> (i32) {\nscf.yield %a : i32\n} else {\nscf.yield %a : i32\n}\nreturn %r : i32", set()),
    ("%c = arith.cmpi eq, %a, %a : i32\n%r = scf.if %c -> (i32) {\nscf.yield %a : i32\n}\nreturn %r : i32", {"yield_mismatch"}), ("else {\n}\nreturn %a : i32", {"parse"}), ("return %a : i32\n}\n}", {"parse"}),
]


@pytest.mark.parametrize(("body", "want"), MLIR_CASES)
def test_mlir_scope(body, want):
    assert {k for k, _, _ in mlir.check(fn(body))} == want


def test_mlir_scope_is_the_same_in_every_layout():
    for body, want in MLIR_CASES:
        if "//" not in body:
            assert {k for k, _, _ in mlir.check(fn(body).replace("\n", " "))} == want


def test_mlir_form():
    ok = fn("%r = arith.addi %a, %a : i32\nreturn %r : i32")
    assert mlir.parses(ok) and mlir.parses(ok.replace("-> i32 {", '-> i32 attributes {tag = "a } b"} {'))
    assert not any(map(mlir.parses, ["", "text", ok[:-1], ok + "}", ok.replace("arith.addi", "arith addi"), ok.replace("return %r : i32", ""), ok.replace("%a, %a", "%a %a")]))
    assert mlir.type_domains(fn("%r = arith.addi %f, %f : f32\nreturn %a : i32"))[0][1] == "arith.addi" and not mlir.type_domains(ok)
    assert mlir.use_sites(ok)[-1][2] == 1 and mlir.use_sites(ok.replace("return %r", "return %q"))[-1][2] == 0
    assert mlir.check("no function") == []


LLVM = "define i32 @f(i32 %a, i1 %c) {\nentry:\n  %x = add i32 %a, 1\n  br i1 %c, label %t, label %e\nt:\n  %y = mul i32 %x, 2\n  br label %e\ne:\n  %p = phi i32 [ %x, %entry ], [ %y, %t ]\n  ret i32 %p\n}\n"


@pytest.mark.parametrize(
    ("change", "want"),
    [(("", ""), set()), (("ret i32 %p", "ret i32 %y"), {"not_dominated"}), (("ret i32 %p", "ret i32 %q"), {"undef_use"}), (("label %e\nt", "label %z\nt"), {"undef_label", "bad_phi"}), (("[ %y, %t ]", "[ %x, %entry ]"), {"bad_phi"}), (("%y = mul i32 %x", "%y = mul i32 %y"), {"use_before_def"}), (("%y = mul", "%x = mul"), {"redefinition", "undef_use", "use_before_def", "bad_phi"}), (("[ %x, %entry ]", "[ %y, %entry ]"), {"bad_phi"}), (("add i32 %a, 1", "add i32 %a,\n    1 ; %nothing"), set())],
)
def test_llvm_scope(change, want):
    assert {k for k, _, _ in llvm.check(LLVM.replace(*change))} == want


def test_llvm_dominators():
    succ = {"a": ["b", "c"], "b": ["d"], "c": ["d"], "d": ["b", "e"], "e": [], "lost": ["e"]}
    assert llvm.dominators(succ, "a") == {"a": {"a"}, "b": {"a", "b"}, "c": {"a", "c"}, "d": {"a", "d"}, "e": {"a", "d", "e"}}


def test_validator_udf(spark):
    rows = spark.createDataFrame([(1, fn("return %a : i32")), (2, fn("return %z : i32")), (3, None)], "id long, t string")
    got = {r.id: (r.v["passed"], [x["kind"] for x in r.v["violations"]] if r.v["violations"] is not None else None) if r.v is not None else None for r in rows.select("id", as_udf(mlir.check)(F.col("t")).alias("v")).collect()}
    assert got[1] == (True, []) and got[2] == (False, ["undef_use"]) and got[3] in (None, (None, None))


def test_templates_are_valid_and_the_same_at_any_partitioning(spark):
    rows = generators.templates(spark, 300, 3).collect()
    assert len({r.family for r in rows}) == len(generators.FAMILIES) and all(mlir.check(r.mlir) == [] and mlir.parses(r.mlir) for r in rows)
    assert {r.nl for r in rows} == {r.nl for r in generators.templates(spark, 300, 3).repartition(7).collect()}


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"nl": "x", "gold_mlir": "m"}\n\n{"nl": "y", "mlir": "n", "prompt_id": 9}\n')
    got = jsonl.load_set(spark, str(tmp_path / "a.jsonl")).collect()
    assert [(r.prompt_id, r.nl) for r in got] == [(0, "x"), (9, "y")]
    assert {(r.nl, r.mlir) for r in jsonl.load_protected(spark, [str(tmp_path / "a.jsonl")]).collect()} == {("x", "m"), ("y", "n")}
    with pytest.raises(Exception, match="(?i)path"):
        jsonl.load_protected(spark, [str(tmp_path / "missing.jsonl")]).count()
    assert jsonl.load_pool(spark, str(tmp_path / "a.jsonl")).count() == 2
    (tmp_path / "t" / "u").mkdir(parents=True)
    (tmp_path / "t" / "u" / "x.mlir").write_text("a")
    (tmp_path / "t" / "invalid.mlir").write_text("b")
    (tmp_path / "t" / "bad.mlir").write_bytes(b"\xff\xfe")
    assert [r.text for r in jsonl.test_files(spark, str(tmp_path / "t")).collect()] == ["a"]
    (tmp_path / "pins").write_text("# c\norg/a@123\n\norg/b\n")
    assert {tuple(r) for r in jsonl.pin_list(spark, str(tmp_path / "pins")).collect()} == {("org/a", "123"), ("org/b", None)}


def test_sinks(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    assert [sinks.append_new(rows, log, ["k"]), sinks.append_new(rows, log, ["k"]), spark.read.parquet(log).count()] == [2, 0, 2]
    calls = []

    def compute(missing):
        calls.append(missing.count())
        return missing.select("k", F.length("v").alias("n"))

    for part in (rows.filter("k = 1"), rows):
        got = sinks.cached_call(part, "k", str(tmp_path / "cache"), compute, "k int, n int")
    assert calls == [1, 1] and got.count() == 3 and got.filter("n is null").count() == 0
    assert sinks.replace_tagged(rows, spark.createDataFrame([(2, "z")], "k int, v string"), ["k"]).count() == 2
    assert sinks.markdown(spark.createDataFrame([(1, None)], "a int, b string")) == "| a | b |\n| --- | --- |\n| 1 |  |"


def test_streamed_ingestion_takes_each_key_once(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "k int, v string"
    for batch in ([(1, "a"), (1, "b")], [(1, "c"), (2, "d")]):
        spark.createDataFrame(batch, schema).write.mode("append").json(src)
        ingest.ingest(spark, src, schema, out, ["k"], check).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [1, 2]


def test_operation_definitions(spark):
    td = 'def Arith_AddIOp : Arith_Op<"addi", [Pure, SameOperandsAndResultType]> {\n  let summary = "adds";\n  let arguments = (ins SignlessIntegerLike:$lhs, SignlessIntegerLike:$rhs, DefaultValuedAttr<X, "y">:$flags);\n  let results = (outs SignlessIntegerLike:$result);\n}\ndef Other : Arith_Op<"cat", []> {\n  let arguments = (ins Variadic<AnyMemRef>:$xs, Odd:$o);\n  let results = (outs);\n}\n'
    got = {r.mnemonic: r for r in ods.lattice(ods.td_records(spark.createDataFrame([("a.td", td)], "path string, text string"))).collect()}
    add, cat = got["addi"], got["cat"]
    assert add.operand_types == [["i1", "i8", "i16", "i32", "i64", "index"]] * 2 and add.operand_arity == [2, 2] and add.attributes == ["flags"] and add.same_type == [0, 1] and add.result_arity == [1, 1]
    assert cat.operand_types == [["memref"], ["ANY"]] and cat.operand_arity == [1, ods.MANY] and cat.result_types == [] and cat.same_type == []
    dump = '{"!instanceof": {"Op": ["A"]}, "A": {"!superclasses": ["Op<x>"], "opName": "addi", "opDialect": {"def": "Arith"}, "summary": "s", "arguments": {"args": [[{"def": "I32"}, "lhs"]]}, "results": {"args": []}, "traits": [{"def": "Pure"}]}, "B": {"!superclasses": ["Attr"]}}'
    recs = ods.json_records(spark.createDataFrame([("d", dump)], "source string, json string")).collect()
    assert [(r.mnemonic, r["class"], r.traits, [tuple(o) for o in r.operands]) for r in recs] == [("addi", "Arith", ["Pure"], [("I32", "lhs")])]


def test_written_tables(spark):
    from corvane.store import clear, written

    t = written(spark.createDataFrame([(1, None), (2, "b")], "k int, v string"), "two")
    assert sorted(r.k for r in t.collect()) == [1, 2]
    assert clear(spark) >= 1 and clear(spark) == 0
    with pytest.raises(Exception):  # noqa: B017
        t.count()
