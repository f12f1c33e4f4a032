import hashlib
import math
import random
import re
import time

from pyspark.sql import functions as F

from corvane.functions import harness
from corvane.functions import text as T


def one(spark, expr, **cols):
    df = spark.range(1).select(*[(F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v))).alias(k) for k, v in cols.items()])
    return df.select(expr.alias("x")).first()["x"]


def test_norms(spark):
    assert one(spark, T.norm_nl(F.col("s")), s="Add `%a`, then\tB!  10%") == "add %a then b 10%"
    a = "func.func @abc(%x : i32) { // note\n %y = arith.addi %x , %x : i32\n return %y : i32 }"
    b = "func.func @z9(%q:i32){ %r=arith.addi %q,%q:i32\n\n return %r:i32}"
    assert one(spark, T.norm_mlir(F.col("s")), s=a) == one(spark, T.norm_mlir(F.col("s")), s=b) == "func.func @F(%v0:i32){%v1=arith.addi %v0,%v0:i32 return %v1:i32}"


def test_grams(spark):
    assert one(spark, T.word_grams(F.col("s"), 2), s=" a b  a b ") == ["a b", "b a"]
    assert one(spark, T.word_grams(F.col("s"), 3), s="a b") == []
    assert one(spark, T.tokens(F.col("s")), s="%a=b+1") == ["%", "a", "=", "b", "+", "1"]


def test_error_categories(spark):
    cases = {"expected 2 operands but found 3": "arity", "": "other", "odd": "other", "use of value '%a' expects different type than prior uses: type mismatch": "type_ssa", "error: type mismatch; expected ')'": "type", "unregistered operation 'x'": "dialect_misuse", "custom op 'x' parsing failed": "syntax", "Expected attribute": "syntax"}
    df = spark.createDataFrame([*cases.items(), (None, "other")], "s string, want string")
    assert df.filter(T.error_category(F.col("s")) != F.col("want")).count() == 0
    llvm = {"use of undefined value '%x'": "scope", "'%x' defined with type 'i32' but expected 'i64'": "type", "expected instruction opcode": "syntax"}
    assert spark.createDataFrame([*llvm.items()], "s string, want string").filter(T.llvm_category(F.col("s")) != F.col("want")).count() == 0


def test_signatures(spark):
    gold = "func.func @f(%a : i32, %m : memref<4x8xf32>) -> i32 {"
    assert one(spark, T.signature_score(F.col("a"), F.col("b")), a=gold, b=gold) == 1.0
    assert one(spark, T.signature_score(F.col("a"), F.col("b")), a=gold.replace("4x8", "?x8"), b=gold) == 2 / 3
    assert one(spark, T.signature_score(F.col("a"), F.col("b")), a="no", b=gold) == 0.0
    match = lambda c: one(spark, T.signature_match(T.public_signature(F.col("g")), T.public_signature(F.col("c"))), g=gold, c=c)
    assert [match(gold), match(gold.replace("4x8", "?x8")), match(gold.replace("4x8", "5x8")), match(gold.replace("f32", "f64"))] == ["exact", "dim_relaxed", "mismatch", "mismatch"]
    why = lambda s: one(spark, T.exclusion(T.public_signature(F.col("s"))), s=s)
    assert why(gold) is None and why("x") == "no_public_fn" and why("func.func @main() {") == "fn_named_main" and why("func.func @f(%a : i32) {") == "no_observable_output"
    assert why("func.func @f(%a : tensor<4xf32>) -> i32 {") == "unsupported_arg_type" and why("func.func @f(%a : memref<4xf16>) {") == "unprintable_memref_dtype" and why("func.func @f(%a : memref<f32>) {") == "unsupported_memref_type"
    assert one(spark, T.llvm_signature_score(F.col("a"), F.col("b")), a="define i32 @f(i32 %a) {", b="define i64 @f(i32 %b) {") == 2 / 3


def test_multiset_jaccard(spark):
    j = lambda a, b, e=1.0: one(spark, T.multiset_jaccard(F.col("a"), F.col("b"), e), a=a, b=b)
    assert j(["x", "x", "y"], ["x", "y", "y"]) == 0.5
    empty = F.array().cast("array<string>")
    assert [one(spark, T.multiset_jaccard(empty, empty, e), z=1) for e in (1.0, 0.0)] == [1.0, 0.0]


def test_outputs(spark):
    eq = lambda a, b, exact=False: one(spark, T.outputs_equal(T.numbers(F.col("a")), T.numbers(F.col("b")), exact), a=a, b=b)
    assert eq("1.0 nan 3", "1.000001 nan 3.0001") and not eq("1 2", "1") and not eq("1.0", "1.1") and not eq("nan", "1") and eq("inf", "inf") and not eq("1.0", "1.00001", True)
    text = "7\nUnranked Memref base@ 0x1 rank = 2 sizes = [1, 2] strides = [2, 1] data =\n[[1.5, -2]]\n0"
    p = one(spark, harness.printed(F.col("s")), s=text)
    assert p["scalars"] == [7.0] and p["memrefs"][0]["sizes"] == [1, 2] and p["memrefs"][0]["data"] == [1.5, -2.0]
    assert one(spark, harness.same_output(harness.printed(F.col("a")), harness.printed(F.col("b"))), a=text, b=text.replace("-2]", "-2.00001]"))
    assert not one(spark, harness.same_output(harness.printed(F.col("a")), harness.printed(F.col("b"))), a=text, b=text.replace("[1, 2]", "[2, 1]"))


def test_mining(spark):
    src = "// RUN: opt %s\nfunc.func @a() {\n}\n// CHECK-NEXT: foo\n// -----\n\n  // -----\nfunc.func @b() {\n}\n"
    assert one(spark, T.split_cases(F.col("s")), s=src) == ["func.func @a() {\n}\n", "func.func @b() {\n}\n"]
    assert one(spark, T.check_hints(F.col("s")), s=src) == ["foo"]
    assert one(spark, T.weak_prompt(F.col("s")), s="mlir/test/Dialect/Arith/fold_it-now.mlir") == "arith fold it now"
    assert one(spark, T.dialects(F.col("s")), s="arith.addi memref.load arith.muli") == ["arith", "memref"]


def test_rewrites(spark):
    ok = lambda a, b: one(spark, T.rewrite_acceptable(F.col("a"), F.col("b")), a=a, b=b)
    assert ok("Add 3 to `x` of i32", "To `x` of i32, add 3") and not ok("Add 3 to `x` of i32", "To `x` add three i32") and not ok("Add 3 to it", "add 3 TO it") and not ok("a", "short")
    assert one(spark, T.clean_rewrite(F.col("s")), s='\n Rewritten instruction: "Do it."\nmore') == "Do it."


def test_harness():
    assert harness.unwrap_module("module {\nfunc\n}") == "func"
    assert harness.unwrap_module("module {\nfunc {", "strip") == "func {" and harness.unwrap_module("module {\nfunc {", "keep") == "module {\nfunc {"
    types = ["i32", "f32", "index", "memref<2x?xf32>", "i1"]
    assert harness.draws("k", 1, types) == harness.draws("k", 1, types) != harness.draws("k", 2, types)
    assert len(harness.draws("k", 1, types)[3]) == 8 and all(math.isclose(x * 4 % 1, 0) for x in harness.draws("k", 1, types)[3])
    assert "%x0 = arith.constant -3 : i32" in harness.driver("f", ["i32", "i1"], [-3, 1], "i32") and "%x1 = arith.constant true" in harness.driver("f", ["i32", "i1"], [-3, 1], "i32")
    text = "func.func @f(%a : i32) {\n  %b = arith.addi %a, %c : i32\n}"
    events = harness.scope_events(text)
    assert [(k, n) for k, n, _, _ in events] == [("def", "a"), ("def", "b"), ("use", "a"), ("use", "c")]
    at = events[2][2]
    assert re.search(r"addi %(b|c), %c", harness.corrupted(text, at, ["a", "b", "c"])) and harness.corrupted(text, at, ["a"]) == text


def test_drawn_is_random_randint_and_fast():
    types = ["i32", "memref<?x2x3xf32>", "index", "memref<2x?xi1>", "memref<4xbf16>", "i1", "memref<0x2xi64>", "f64"]
    rng = random.Random(int(hashlib.sha256(b"k/2").hexdigest()[:12], 16))
    one = {"f": lambda: rng.randint(-32, 32) / 4, "1": lambda: rng.randint(0, 1), "x": lambda: rng.randint(0, 5)}
    kinds, sizes = ["i", "f", "x", "1", "i", "1", "i", "f"], [None, 30, None, 10, 4, None, 0, None]
    draw = lambda k: one.get(k, lambda: rng.randint(-50, 50))()
    want = [draw(k) if n is None else [draw(k) for _ in range(n)] for k, n in zip(kinds, sizes)]
    drawn = harness.drawn("k", 2, types)
    assert repr(harness.draws("k", 2, types)) == repr(want) == harness.shown(drawn)
    assert harness.memref_driver("f", types, drawn, 2) == harness.memref_driver("f", types, want, 2) and harness.shown(drawn) == repr(want)
    began = time.process_time()
    for trial in range(2):
        values = harness.drawn("k", trial, ["memref<600x700xf32>"])
        harness.memref_driver("f", ["memref<600x700xf32>"], values, trial)
        harness.shown(values)
    spent = time.process_time() - began
    began = time.process_time()
    for _ in range(840_000):
        rng.randint(-32, 32)
    assert spent < time.process_time() - began  # all of it takes less than the draws alone, one by one
