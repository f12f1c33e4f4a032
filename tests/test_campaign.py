"""Trials, registries, external commands, lowering, grammars, generators and patch pairs, on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from corvane import registry, store
from corvane.functions import harness
from corvane.functions import text as T
from corvane.operators import decontam, differential, generators, lowering, probe
from corvane.sources.jsonl import parse_cells
from corvane.validators import external, grammar, llvm, mlir


def test_gold_gate_and_outcomes(spark):
    golds = spark.createDataFrame([(1, None), (2, None), (3, "multi_result"), (4, None), (5, None)], "id long, reason string")
    runs = [(i, t, r, f"o{t}") for i in (1, 2, 3, 4) for t in range(3) for r in (1, 2)]
    runs = [(i, t, r, "x" if (i, t, r) == (2, 1, 2) else None if (i, t, r) == (4, 0, 1) else o) for i, t, r, o in runs]
    got = {r.id: (r.gate, r.reason) for r in differential.gold_gate(golds, spark.createDataFrame(runs, "id long, trial int, run int, out string"), ["id"], 3).collect()}
    assert got == {1: ("pass", None), 2: ("fail", None), 3: ("excluded", "multi_result"), 4: ("fail", None), 5: ("fail", None)}
    trials = [(1, t, True, True, True) for t in range(3)] + [(2, t, True, True, t < 2) for t in range(3)] + [(3, t, True, t > 0, True) for t in range(2)] + [(4, 0, True, None, None)]
    got = {r.id: (r.lower_ok, r.exec_ok, r.functional_match) for r in differential.outcomes(spark.createDataFrame(trials, "id long, trial int, lower_ok boolean, exec_ok boolean, match boolean"), ["id"], 3).collect()}
    assert got == {1: (True, True, True), 2: (True, True, False), 3: (True, False, False), 4: (True, False, False)}


def test_differential_aggregate(spark):
    gates = spark.createDataFrame([("a", "pass")] * 4 + [("a", "fail"), ("b", "pass")], "dialect string, gate string")
    prompts = [("a", "scored", False, True), ("a", "scored", True, False), ("a", "not_verified", None, None), ("a", "no_candidate_row", None, None), ("b", "no_candidate_row", None, None)]
    got = {r.dialect: r for r in differential.aggregate(gates, spark.createDataFrame(prompts, "dialect string, status string, dim_relaxed boolean, functional_match boolean"), ["dialect"], ["dialect"], 500).collect()}
    a, b = got["a"], got["b"]
    assert (a.n_gold, a.n_pass, a.n_fail, a.n_scored, a.n_dim_relaxed, a.n_match, a.rate_scored, a.rate_gate) == (5, 4, 1, 2, 1, 1, 0.5, 0.25)
    assert (b.n_scored, b.rate_scored, b.low_scored, b.rate_gate, b.low_gate) == (0, None, None, 0.0, 0.0)


def test_registries(spark):
    assert set(registry.TARGETS) == set(registry.TASKS) == {"mlir", "scf", "stablehlo", "llvm", "synth"}
    with pytest.raises(KeyError, match="known: command, table"):
        registry.RUNNERS["nothing"]
    with pytest.raises(ValueError, match="there already"):
        registry.TASKS.register("mlir", None)
    with pytest.raises(ValueError, match="no kind"):
        registry.reward(*[F.lit(1)] * 6, kind="other")
    rows = spark.createDataFrame([(True, True, True, 0.5, 0.5, True), (True, False, True, 1.0, 1.0, True), (None, True, True, 1.0, 1.0, True)], "p boolean, s boolean, v boolean, sig double, jac double, m boolean")
    kinds = ("verify", "verify_noc3", "task", "functional", "functional_noc3")
    got = rows.select(*[registry.reward(*map(F.col, rows.columns), kind=k).alias(k) for k in kinds]).collect()
    assert [tuple(r) for r in got] == [(1.0, 1.0, 0.25, 1.25, 1.25), (0.0, 1.0, 0.0, 0.0, 2.0), (0.0, 0.0, 0.0, 0.0, 0.0)]


def test_commands(spark):
    rows = spark.createDataFrame([(1, "yes x"), (2, "no x"), (3, None), (4, "yes"), (5, "yes x")], "id long, t string")
    got = {r.id: r.returncode for r in external.run_command(rows, "t", ["grep", "-q", "yes"], needs="x").collect()}
    assert got == {1: 0, 2: 1, 3: external.UNFIT, 4: external.UNFIT, 5: 0}
    slow = external.run_command(rows.filter("id = 1"), "t", ["sleep", "5"], timeout=0.2).first()
    assert (slow.returncode, slow.stderr) == (external.TIMED_OUT, "no answer in 0.2 s")


BODY = "%c = arith.constant 3 : i32\n%x = arith.addi %a, %c : i32\n%t = arith.cmpi slt, %x, %a : i32\n%0 = arith.select %t, %x, %a : i32\nreturn %0 : i32"


def test_lowering(spark):
    text = "module { func.func @f(%a : i32) -> i32 {\n" + BODY + "\n} }"
    ir = lowering.lower(text)
    assert ir == "define i32 @f(i32 %a) {\nentry:\n  %x = add i32 %a, 3\n  %t = icmp slt i32 %x, %a\n  %v0 = select i1 %t, i32 %x, i32 %a\n  ret i32 %v0\n}\n"
    assert llvm.check(ir) == [] and grammar.parses(ir, "llvm_c1_c2")
    rows = [(1, text), (2, "module {"), (3, text.replace("%a, %c", "%z, %c")), (4, text.replace("@f", "@g")), (5, None), (6, text.replace("i32", "memref<4xi32>")), (7, text.replace("@f", "@h"))]
    out = lowering.lowered(spark.createDataFrame(rows, "pos long, t string"), ["pos"], "t")
    assert {r.pos: r.reason for r in out.collect()} == {1: "kept", 2: "lower_fail", 3: "lower_fail", 4: "kept", 5: "lower_fail", 6: "lower_fail", 7: "kept"}
    assert sorted(r.pos for r in lowering.until_kept(out, "pos", 2).collect()) == [1, 2, 3, 4]
    assert lowering.until_kept(out, "pos", 9).count() == 7 and lowering.until_kept(out.limit(0), "pos", 2).count() == 0


def test_second_families():
    for family in generators.SECOND:
        made = {generators.second_record(family, random.Random(i)) for i in range(40)}
        assert len(made) > 20
        for _, nl, program in made:
            assert mlir.check(program) == [] and mlir.type_domains(program) == [] and grammar.parses(program, "mlir_c1_c2") and nl.startswith("Write `g")


def test_rendered_grammars_are_bounded():
    for language, (_, statements) in grammar.LANGUAGES.items():
        rules = grammar.rendered(language, depth=1, chain=5)
        assert "{0,5}" in rules["block_1"] and "block_2" not in rules and "<block>" not in "".join(rules.values())
        assert all(f"<{s}" in rules["block_1"] for s in statements)
    two = "prog { %a = const 3 : int[4] %b = const 3 : int[4] ret %a : int[4] }"
    assert grammar.recogniser("synth", 2, 2).fullmatch(two) and not grammar.recogniser("synth", 2, 1).fullmatch(two)


def test_patch_pairs():
    text = "func.func @f(%a : i32) -> i32 {\n  %b = arith.addi %a, %a : i32\n  return %b : i32\n}"
    at = text.rindex("%b")
    p = harness.patch_pair(text, at)
    assert p["clean"][p["clean_at"]] == "return" == p["corrupt"][p["corrupt_at"]] and p["clean"][p["clean_at"] + 1] == "%b" == p["target"]
    assert p["corrupt"][p["corrupt_at"] + 1] == "%a" and p["inside"] == ["%a", "%b"] and p["outside"] == []
    assert harness.patch_pair(text.replace("return %b", "return %q"), at) is None and harness.patch_pair(text, 0) is None


def test_best_layer(spark):
    rows = spark.createDataFrame([("x", 0, 0.5), ("x", 3, 0.9), ("x", 7, 0.9), ("x", 9, 0.7), ("y", 2, 0.1)], "design string, layer long, acc double")
    assert {tuple(r) for r in probe.best_layer(rows, ["design"]).collect()} == {("x", 3, 0.9, 0.5, 0.7), ("y", 2, 0.1, 0.1, 0.1)}


def test_cells_and_prompts(spark):
    assert parse_cells(["a m", "b m ck"], {"m": "r1"}) == [{"tag": "a", "model": "m", "revision": "r1", "ckpt": None, "trained": False}, {"tag": "b", "model": "m", "revision": "r1", "ckpt": "ck", "trained": True}]
    for bad in (["a"], ["a b c d"], ["a m", "a n"]):
        with pytest.raises(ValueError):
            parse_cells(bad)
    got = spark.createDataFrame([("q",)], "nl string").select(T.few_shot_prompt(F.col("nl"), [("x", "y")])).first()[0]
    assert got == "<|im_start|>user\nx<|im_end|>\n<|im_start|>assistant\ny<|im_end|>\n<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n"


def test_drivers():
    assert harness.dense([1, 2, 3, 4, 5, 6], [2, 3], "i32") == "[[1, 2, 3], [4, 5, 6]]" and harness.dense([1.5], [], "f32") == "1.5"
    types = ["memref<?x2xf32>", "i32"]
    text = harness.memref_driver("f", types, harness.draws("k", 1, types), 1, "i32")
    assert "memref<4x2xf32> = dense<[[" in text and "memref.cast %b0 : memref<4x2xf32> to memref<?x2xf32>" in text and "call @printMemrefF32" in text and "vector.print %r : i32" in text
    ir = harness.llvm_driver("f", ["i32", "double"], [3, 0.25], "i32")
    assert "call i32 @f(i32 3, double 0.25)" in ir and "sext i32 %r to i64" in ir and ir.count("{") == ir.count("}")


def test_a_folder_of_one_machine_is_none_for_a_cluster(spark):
    class Context:
        master, applicationId = "spark://host:7077", "x"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.shared_dir(Session())


def test_most_shared_against_brute_force(spark):
    rng = random.Random(6)
    given = [(i, sorted(rng.sample(range(40), rng.randint(0, 12)) + [100, 101])) for i in range(60)] + [(99, [])]
    asked = [(f"k{i}", sorted(rng.sample(range(60), rng.randint(1, 12)) + [100] * (i % 2) + [101] * (i % 3))) for i in range(50)]
    got = {r.key: r.best for r in decontam.most_shared(spark.createDataFrame(asked, "key string, grams array<long>"), spark.createDataFrame(given, "gid long, grams array<long>")).collect()}
    want = {k: max(len(set(a) & set(g)) for _, g in given) for k, a in asked}
    assert got == {k: n for k, n in want.items() if n}


def test_most_shared_by_levels(spark):
    rng = random.Random(8)
    given = [(i, sorted({i % 50, 60 + i % 7, 70 + i % 2, 80, 81} | set(rng.sample(range(50), 3)))) for i in range(200)]
    asked = [(i, sorted(set(rng.sample(range(90), rng.randint(1, 30))))) for i in range(60)]
    rows = lambda x, k: spark.createDataFrame(x, f"{k} long, grams array<long>")
    got = {r.key: r.best for r in decontam.most_shared(rows(asked, "key"), rows(given, "gid"), 1, 0).collect()}
    want = {k: max(len(set(a) & set(g)) for _, g in given) for k, a in asked}
    assert got == {k: n for k, n in want.items() if n}
