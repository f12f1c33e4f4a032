"""Operation definitions: records of TableGen text and of its JSON dump, and the lattice of types that they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Type classes and the types that they stand for. A class that isn't here stands for ANY.
CLASSES = {
    "I1": ("i1",), "I8": ("i8",), "I16": ("i16",), "I32": ("i32",), "I64": ("i64",), "Index": ("index",), "F16": ("f16",), "BF16": ("bf16",), "F32": ("f32",), "F64": ("f64",),
    "AnyInteger": ("i1", "i8", "i16", "i32", "i64"), "AnySignlessInteger": ("i1", "i8", "i16", "i32", "i64"), "SignlessIntegerLike": ("i1", "i8", "i16", "i32", "i64", "index"),
    "SignlessIntegerOrIndexLike": ("i1", "i8", "i16", "i32", "i64", "index"), "AnyFloat": ("f16", "bf16", "f32", "f64"), "FloatLike": ("f16", "bf16", "f32", "f64"),
    "BoolLike": ("i1",), "AnyMemRef": ("memref",), "AnyTensor": ("tensor",), "AnyVector": ("vector",), "AnyShaped": ("memref", "tensor", "vector"),
}
MANY = 10**6
SAME = ("SameOperandsAndResultType", "SameTypeOperands", "SameOperandsElementType", "SameOperandsAndResultElementType")

_RECORD = r"(?s)\bdef\s+\w+\s*:\s*\w+<\s*\"[\w.]+\".*?\n\}"
_HEAD = r"(?s)\bdef\s+(\w+)\s*:\s*(\w+)<\s*\"([\w.]+)\"\s*(?:,\s*\[(.*?)\])?"


def dag(body: Column, field: str) -> Column:
    """array(struct(type, name)) of the (ins ..) or (outs ..) list of a record."""
    inner = F.regexp_extract(body, rf"(?s)\({field}\b\s*(.*?)\)\s*;", 1)
    parts = F.filter(F.split(inner, r",(?![^<]*>)"), lambda p: F.trim(p) != "")
    return F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, ":$", 1)).alias("type"), F.trim(F.substring_index(p, ":$", -1)).alias("name")))


def td_records(files: DataFrame) -> DataFrame:
    """(path, text) of TableGen files -> op records (path, def, mnemonic, class, traits, summary, operands, results)."""
    rec = files.select("path", F.explode(F.regexp_extract_all("text", F.lit(_RECORD), F.lit(0))).alias("r"))
    g = lambda i: F.regexp_extract("r", _HEAD, i)
    traits = F.filter(F.transform(F.split(g(4), ","), lambda t: F.trim(t)), lambda t: t != "")
    return rec.select("path", g(1).alias("def"), g(3).alias("mnemonic"), g(2).alias("class"), traits.alias("traits"), F.regexp_extract("r", r"summary\s*=\s*\"([^\"]*)\"", 1).alias("summary"), dag(F.col("r"), "ins").alias("operands"), dag(F.col("r"), "outs").alias("results"))


def json_records(dumps: DataFrame) -> DataFrame:
    """(source, json) of dumps, an object of records -> the operations: a record whose superclasses hold Op or Op<..>."""
    records = dumps.select("source", F.explode(F.from_json("json", "map<string,string>")).alias("def", "body"))
    arg = "array<array<string>>"
    schema = f"`!superclasses` array<string>, opName string, opDialect struct<`def`: string>, summary string, arguments struct<args: {arg}>, results struct<args: {arg}>, traits array<struct<`def`: string>>"
    r = records.filter("def not like '!%'").select("source", "def", F.from_json("body", schema).alias("r"))
    is_op = F.exists(F.col("r")["!superclasses"], lambda c: (c == "Op") | c.startswith("Op<"))
    typed = lambda c: F.transform(F.coalesce(c, F.array().cast(arg)), lambda a: F.struct(F.coalesce(F.get_json_object(F.get(a, 0), "$.def"), F.get(a, 0)).alias("type"), F.get(a, 1).alias("name")))
    return r.filter(is_op).select(F.col("source").alias("path"), "def", F.col("r.opName").alias("mnemonic"), F.col("r.opDialect.def").alias("class"), F.transform("r.traits", lambda t: t["def"]).alias("traits"), "r.summary", typed(F.col("r.arguments.args")).alias("operands"), typed(F.col("r.results.args")).alias("results"))


def expand(cls: Column) -> Column:
    """The types that a class stands for; Optional<..>, Variadic<..> and the like are unwrapped."""
    inner = F.regexp_replace(F.regexp_replace(cls, r"^(?:Arg|Res|Optional|Variadic|VariadicOfVariadic|Confined)<\s*", ""), r"[<>,].*$", "")
    table = F.create_map(*[x for k, v in CLASSES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.element_at(table, F.trim(inner)), F.array(F.lit("ANY")))


def lattice(records: DataFrame) -> DataFrame:
    """One entry per operation: the types of each operand and result, arities (from, to; MANY if variadic), same-type operands, attributes."""
    is_attr = lambda a: a["type"].rlike(r"Attr\b|Attr<|Attr$|Prop$")
    arity = lambda xs: F.array(F.size(F.filter(xs, lambda a: ~a["type"].rlike("^(Variadic|Optional)"))), F.when(F.exists(xs, lambda a: a["type"].startswith("Variadic")), MANY).otherwise(F.size(xs)))
    ops = F.filter("operands", lambda a: ~is_attr(a))
    same = F.when(F.exists("traits", lambda t: t.isin(*SAME)) & (F.size(ops) > 1), F.sequence(F.lit(0), F.size(ops) - 1)).otherwise(F.array().cast("array<int>"))
    return records.select(
        "path", "mnemonic", F.transform(ops, lambda a: expand(a["type"])).alias("operand_types"), F.transform("results", lambda a: expand(a["type"])).alias("result_types"),
        arity(ops).alias("operand_arity"), arity(F.col("results")).alias("result_arity"), F.transform(F.filter("operands", is_attr), lambda a: a["name"]).alias("attributes"), same.alias("same_type"),
    )
