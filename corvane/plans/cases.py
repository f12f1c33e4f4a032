"""Queries over hand-written cases: programs with the verdict that a validator must give, which the SQL states as a table."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F

from corvane.validators import grammar, llvm, mlir, synth


def _fn(body: str, params: str = "%a : i32, %b : i32, %c : i1, %f : f32, %m : memref<4xf32>, %i : index", ret: str = " -> i32") -> str:
    return f"module {{\n  func.func @f({params}){ret} {{\n{body}\n  }}\n}}"


_IF = "%r = scf.if %c -> (i32) {{\n scf.yield {0} : i32\n}} else {{\n scf.yield {1} : i32\n}}\nreturn %r : i32"
_FOR = "%s = scf.for %k = %i to %i step %i iter_args(%x = {0}) -> (i32) {{\n %y = arith.addi %x, {1} : i32\n scf.yield {2} : {3}\n}}\nreturn {4} : i32"
#: (name, program, kinds of violations, in order and once each).
SCOPE = (
    ("plain", _fn("%r = arith.addi %a, %b : i32\nreturn %r : i32"), ""),
    ("one line", _fn("%r = arith.addi %a, %b : i32 return %r : i32").replace("\n", " "), ""),
    ("undefined operand", _fn("%r = arith.addi %a, %z : i32\nreturn %r : i32"), "undef_use"),
    ("undefined result", _fn("return %z : i32"), "undef_use"),
    ("used before", _fn("%r = arith.addi %q, %b : i32\n%q = arith.addi %a, %b : i32\nreturn %r : i32"), "undef_use"),
    ("two undefined", _fn("%r = arith.addi %y, %z : i32\nreturn %r : i32"), "undef_use"),
    ("operand of another type", _fn("%r = arith.addi %a, %f : i32\nreturn %r : i32"), "type_mismatch"),
    ("result of another type", _fn("%r = arith.addi %a, %b : i32\nreturn %r : i64", ret=" -> i64"), "type_mismatch"),
    ("comparison gives i1", _fn("%t = arith.cmpi slt, %a, %b : i32\n%r = arith.select %t, %a, %b : i32\nreturn %r : i32"), ""),
    ("select by an integer", _fn("%r = arith.select %a, %a, %b : i32\nreturn %r : i32"), "type_mismatch"),
    ("cast", _fn("%r = arith.fptosi %f : f32 to i32\nreturn %r : i32"), ""),
    ("cast of another type", _fn("%r = arith.fptosi %a : f32 to i32\nreturn %r : i32"), "type_mismatch"),
    ("load", _fn("%v = memref.load %m[%i] : memref<4xf32>\n%r = arith.fptosi %v : f32 to i32\nreturn %r : i32"), ""),
    ("load at an integer", _fn("%v = memref.load %m[%a] : memref<4xf32>\nreturn %a : i32"), "type_mismatch"),
    ("store", _fn("memref.store %f, %m[%i] : memref<4xf32>\nreturn %a : i32"), ""),
    ("store of another type", _fn("memref.store %a, %m[%i] : memref<4xf32>\nreturn %a : i32"), "type_mismatch"),
    ("linalg", _fn("linalg.add ins(%m, %m : memref<4xf32>, memref<4xf32>) outs(%m : memref<4xf32>)\nreturn %a : i32"), ""),
    ("linalg of undefined", _fn("linalg.add ins(%m, %z : memref<4xf32>, memref<4xf32>) outs(%m : memref<4xf32>)\nreturn %a : i32"), "undef_use"),
    ("comment names nothing", _fn("// %z is no name\n%r = arith.addi %a, %b : i32\nreturn %r : i32"), ""),
    ("unknown operation abstains", _fn('%r = "other.thing"(%a) : (i32) -> i32\nreturn %a : i32'), ""),
    ("if", _fn(_IF.format("%a", "%b")), ""),
    ("if without else", _fn("%r = scf.if %c -> (i32) {\n scf.yield %a : i32\n}\nreturn %r : i32"), "yield_mismatch"),
    ("if without a yield", _fn("%r = scf.if %c -> (i32) {\n} else {\n scf.yield %a : i32\n}\nreturn %r : i32"), "yield_mismatch"),
    ("if yields another type", _fn(_IF.format("%a", "%f")), "type_mismatch"),
    ("if by an integer", _fn(_IF.format("%a", "%b").replace("%c ", "%a ")), "type_mismatch"),
    ("name of a branch outside", _fn("scf.if %c {\n %q = arith.addi %a, %b : i32\n}\nreturn %q : i32"), "undef_use"),
    ("name of one branch in the other", _fn("scf.if %c {\n %q = arith.addi %a, %b : i32\n} else {\n %p = arith.addi %q, %b : i32\n}\nreturn %a : i32"), "undef_use"),
    ("for", _fn(_FOR.format("%a", "%b", "%y", "i32", "%s")), ""),
    ("for carries an undefined", _fn(_FOR.format("%z", "%b", "%y", "i32", "%s")), "undef_use"),
    ("for yields another type", _fn(_FOR.format("%a", "%b", "%f", "f32", "%s")), "yield_mismatch"),
    ("carried name outside", _fn(_FOR.format("%a", "%b", "%y", "i32", "%x")), "undef_use"),
    ("counter outside", _fn("scf.for %k = %i to %i step %i {\n}\n%r = arith.index_cast %k : index to i32\nreturn %r : i32"), "undef_use"),
    ("for by integers of another type", _fn("scf.for %k = %a to %b step %a {\n}\nreturn %a : i32"), "type_mismatch"),
    ("yield in a function", _fn("scf.yield %a : i32\nreturn %a : i32"), "yield_mismatch"),
    ("never closed", _fn("return %a : i32")[:-2], "parse"),
    ("closed twice", _fn("return %a : i32") + "}", "parse"),
    ("else of nothing", _fn("else {\n}\nreturn %a : i32"), "parse"),
    ("two functions", _fn("return %a : i32") + "\n" + _fn("return %a : i32", params="%b : i32"), "undef_use"),
    ("no function", "text with %z", ""),
)
_OP = lambda op, t: _fn(f"%r = arith.{op} %x, %x : {t}\nreturn %r : {t}", params=f"%x : {t}", ret=f" -> {t}")
DOMAINS = (
    ("integers", _OP("addi", "i32"), ""), ("index", _OP("muli", "index"), ""), ("floats", _OP("mulf", "f64"), ""), ("integer operation on floats", _OP("addi", "f32"), "type_domain"), ("float operation on integers", _OP("maximumf", "i16"), "type_domain"),
    ("float operation on index", _OP("divf", "index"), "type_domain"), ("comparison isn't told", _fn("%t = arith.cmpi slt, %f, %f : f32\nreturn %a : i32"), ""), ("in a loop", _fn("scf.for %k = %i to %i step %i {\n%y = arith.xori %f, %f : f32\n}\nreturn %a : i32"), "type_domain"),
)
_LL = "define i32 @f(i32 %a, i1 %c) {\nentry:\n  %x = add i32 %a, 1\n  br i1 %c, label %t, label %e\nt:\n  %y = mul i32 %x, 2\n  br label %e\ne:\n  %p = phi i32 [ %x, %entry ], [ %y, %t ]\n  ret i32 %p\n}\n"
DOMINANCE = (
    ("plain", _LL, ""), ("no entry label", _LL.replace("entry:\n", "", 1), ""), ("undefined", _LL.replace("ret i32 %p", "ret i32 %q"), "undef_use"), ("not on every way", _LL.replace("ret i32 %p", "ret i32 %y"), "not_dominated"),
    ("used before in its block", _LL.replace("%y = mul i32 %x", "%y = mul i32 %y"), "use_before_def"), ("defined twice", _LL.replace("%y = mul i32 %x, 2", "%y = mul i32 %x, 2\n  %y = mul i32 %x, 3"), "redefinition"), ("a parameter again", _LL.replace("%y = mul", "%a = mul").replace("[ %y,", "[ %x,"), "redefinition"),
    ("phi lacks an edge", _LL.replace(", [ %y, %t ]", ""), "bad_phi"), ("phi from another block", _LL.replace("[ %y, %t ]", "[ %y, %e ]"), "bad_phi"), ("phi behind another", _LL.replace("  %p = phi", "  %w = add i32 %a, 2\n  %p = phi"), "bad_phi"), ("value not at the arm's end", _LL.replace("[ %x, %entry ]", "[ %y, %entry ]"), "bad_phi"),
    ("jump to nowhere", _LL.replace("ret i32 %p", "br label %nowhere"), "undef_label"), ("unreachable block", _LL.replace("  ret i32 %p\n}", "  ret i32 %p\nlost:\n  ret i32 %y\n}"), ""), ("comment", _LL.replace("%a, 1", "%a, 1 ; %nothing"), ""), ("no function", "declare i32 @g(i32)", ""),
)
_SY = "prog {{ %a = const 3 : int[4] {0} ret %a : int[4] }}"
LAYERS = (
    ("plain", _SY.format(""), ""), ("nested", _SY.format("{ %b = addi %a , %a : int[4] }"), ""), ("empty block", _SY.format("{ }"), "parse"), ("no result", "prog { %a = const 3 : int[4] }", "parse"), ("other operation", _SY.format("%b = divi %a , %a : int[4]"), "parse"),
    ("integer operation on floats", "prog { %a = const 1.5 : flt[4] %b = addi %a , %a : flt[4] ret %b : flt[4] }", "type_domain"), ("float literal of an integer", "prog { %a = const 1.5 : int[4] ret %a : int[4] }", "literal"), ("undefined", _SY.format("%b = addi %a , %z : int[4]"), "undef_use"),
    ("out of its block", _SY.format("{ %b = addi %a , %a : int[4] } %c = addi %b , %a : int[4]"), "dead_use"), ("defined twice", _SY.format("%a = const 4 : int[4]"), "redef"), ("operand of the other domain", _SY.format("%b = const 1.5 : flt[4] %c = addf %b , %a : flt[4]"), "type_mismatch"), ("other shape", _SY.format("%b = addi %a , %a : int[2x2]"), "shape_mismatch"),
)
_G = _fn("%r = arith.addi %a, %b : i32\nreturn %r : i32")
_GF = _fn(_FOR.format("%a", "%b", "%y", "i32", "%s"))
_HLO = "func.func @f(%a : tensor<2x3xf32>) -> tensor<2x3xf32> { %0 = stablehlo.add %a, %a : tensor<2x3xf32> return %0 : tensor<2x3xf32> }"
#: (language, name, program, whether the language has it).
GRAMMAR = (
    ("mlir_c1", "plain", _G, True), ("mlir_c1", "wrong domain", _G.replace("arith.addi", "arith.addf"), True), ("mlir_c1_c2", "plain", _G, True), ("mlir_c1_c2", "wrong domain", _G.replace("arith.addi", "arith.addf"), False), ("mlir_c1", "no colon", _G.replace("%b : i32\nreturn", "%b i32\nreturn"), False), ("mlir_c1", "two words as one", _G.replace("return %r", "return%r"), True),
    ("mlir_c1", "joined words", _G.replace("func.func @f", "func.funcprivate @f"), False), ("mlir_c1", "loop", _GF, False), ("scf_c1", "loop", _GF, True), ("scf_c1_c2", "loop", _GF, True), ("scf_c1_c2", "wrong domain in a loop", _GF.replace("arith.addi", "arith.mulf"), False), ("scf_c1", "three deep", _fn("scf.if %c {\n" * 3 + "}\n" * 3 + "return %a : i32"), False), ("scf_c1", "two deep", _fn("scf.if %c {\n" * 2 + "}\n" * 2 + "return %a : i32"), True),
    ("mlir_c1", "chain of 128", _fn("%r = arith.addi %a, %b : i32\n" * 128 + "return %r : i32"), True), ("mlir_c1", "chain of 129", _fn("%r = arith.addi %a, %b : i32\n" * 129 + "return %r : i32"), False), ("stablehlo", "plain", _HLO, True), ("stablehlo", "other dialect", _HLO.replace("stablehlo.add", "arith.addf"), False),
    ("llvm_c1", "plain", _LL, True), ("llvm_c1_c2", "plain", _LL, True), ("llvm_c1", "wrong domain", _LL.replace("add i32 %a", "fadd i32 %a"), True), ("llvm_c1_c2", "wrong domain", _LL.replace("add i32 %a", "fadd i32 %a"), False), ("llvm_c1", "never closed", _LL[:-3], False), ("synth", "plain", LAYERS[0][1], True), ("synth", "nested", LAYERS[1][1], True), ("synth", "other operation", LAYERS[4][1], False),
)


def _verdicts(spark, cases, check):
    """(name, kinds) of each case: the kinds of its violations, sorted, once each."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: " ".join(sorted({k for k, _, _ in check(t)})))

    return spark.createDataFrame([c[:2] for c in cases], "name string, program string").select("name", run("program").alias("kinds"))


def scope_cases(spark, d):
    return _verdicts(spark, SCOPE, mlir.check)


def domain_cases(spark, d):
    return _verdicts(spark, DOMAINS, mlir.type_domains)


def dominance_cases(spark, d):
    return _verdicts(spark, DOMINANCE, llvm.check)


def layer_cases(spark, d):
    return _verdicts(spark, LAYERS, synth.check)


def grammar_cases(spark, d):
    @F.pandas_udf("boolean")
    def run(language: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([grammar.parses(t, x) for x, t in zip(language, s)])

    rows = spark.createDataFrame([c[:3] for c in GRAMMAR], "language string, name string, program string")
    return rows.select("language", "name", run("language", "program").alias("accepted"))


@lru_cache(maxsize=None)
def _values(cases) -> str:
    quote = lambda v: str(v).lower() if isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(quote(x) for x in c) + ")" for c in cases)


QUERIES = {f.__name__: f for f in (scope_cases, domain_cases, dominance_cases, layer_cases, grammar_cases)}
SQL = {
    "scope_cases": f"SELECT * FROM (VALUES {_values(tuple((n, k) for n, _, k in SCOPE))}) AS t(name, kinds)",
    "domain_cases": f"SELECT * FROM (VALUES {_values(tuple((n, k) for n, _, k in DOMAINS))}) AS t(name, kinds)",
    "dominance_cases": f"SELECT * FROM (VALUES {_values(tuple((n, k) for n, _, k in DOMINANCE))}) AS t(name, kinds)",
    "layer_cases": f"SELECT * FROM (VALUES {_values(tuple((n, k) for n, _, k in LAYERS))}) AS t(name, kinds)",
    "grammar_cases": f"SELECT * FROM (VALUES {_values(tuple((a, b, x) for a, b, _, x in GRAMMAR))}) AS t(language, name, accepted)",
}
