"""Column functions on texts and program texts. All of them stay in the JVM; null gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with the value computed once. Inside the lambda of a higher-order function an expression is computed for
    every element; a lambda's own variable isn't."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def norm_nl(s: Column) -> Column:
    """Lower case, backticks dropped, anything but [a-z0-9%?<>.] a space, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(F.lower(s), F.lit("`"), F.lit("")), r"[^a-z0-9%?<>.]", " "), " +", " "))


def norm_mlir(s: Column) -> Column:
    """Comments dropped, functions @F, values renamed by first occurrence, punctuation tightened, single spaces."""
    t = F.regexp_replace(F.regexp_replace(s, r"//[^\n]*", ""), r"@[A-Za-z_][A-Za-z0-9_]*", "@F")
    value = r"%[A-Za-z0-9_#$.]+"
    number = lambda order, name: F.concat(F.lit("%v"), (F.array_position(order, name) - 1).cast("string"))
    renamed = lambda t, names, order: F.array_join(F.transform(F.split(t, value, -1), lambda p, i: F.concat(p, F.when(i < F.size(names), number(order, F.get(names, i))).otherwise(""))), "")
    text = let(t, lambda t: let(F.regexp_extract_all(t, F.lit(value), F.lit(0)), lambda names: let(F.array_distinct(names), lambda order: renamed(t, names, order))))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s*([,:=\[\](){}<>])\s*", "$1"), r"\s+", " "))


def grams(words: Column, n: int) -> Column:
    """The distinct runs of n successive words, joined by spaces."""
    none = F.array().cast("array<string>")
    runs = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " ")))
    return let(words, lambda w: F.when(F.size(w) >= n, runs(w)).otherwise(none))


def word_grams(s: Column, n: int) -> Column:
    return grams(F.filter(F.split(s, r"\s+"), lambda w: w != ""), n)


def tokens(s: Column) -> Column:
    """Words and single marks."""
    return F.regexp_extract_all(s, F.lit(r"\w+|[^\w\s]"), F.lit(0))


def token_grams(s: Column, n: int) -> Column:
    return grams(tokens(s), n)


#: Categories of verifier messages, most specific first, with the messages that tell them.
ERROR_PATTERNS = (
    ("type_ssa", r"use of value .*? expects different type than prior uses|SSA value .*? has different type|block argument .*? has different type|prior use here"),
    ("type", r"type mismatch|expected .*? but got|incompatible (?:operand|result) types|mismatched operand types|op requires all (?:operands|results) to have the same type|op requires the same (?:element )?type|operand type .*? does not match|result #\d+ type .*? does not match|failed to verify that .*?(?:types? match|same type)"),
    ("arity", r"expected \d+ (?:operand|result|argument)s?|op has \d+ operands? but expected|too few operands|too many operands|incorrect number of (?:operand|result|argument)s?|number of (?:operand|result|argument)s? does not match"),
    ("dialect_misuse", r"unregistered operation|unknown operation|operation .*? not (?:registered|defined) in dialect|use of unregistered dialect|operation has no verifier"),
    ("syntax", r"expected '[^']+'|custom op .*? parsing failed|error: expected|parse error|expected (?:SSA|attribute|type|operation)"),
)
#: The same for LLVM assembler messages.
LLVM_PATTERNS = (
    ("scope", r"use of undefined value|does not dominate all uses|PHINode should have one entry|PHI node entries do not match predecessors|PHI nodes not grouped|multiple definition of local value|only PHI nodes may reference their own value|PHI node has multiple entries|Instruction does not dominate"),
    ("type", r"defined with type .* but expected|invalid operand type|both operands .* same type|expected (?:icmp|fcmp) predicate|floating point constant invalid for type|integer constant must have integer type|constant expression type mismatch|invalid cast opcode|cast .* invalid|type mismatch|must be (?:integer|floating.point)|invalid type for|explicit pointee type doesn't match|stored value and pointer type|expected .* type|does not match|is not a valid .* type|requires .* type"),
)
#: What tells a message about shapes, and the names of operations.
SHAPE_PATTERN = r"(?i)shape|rank|dimension|dim |inner dimension|incompatible|expected .*tensor|expected .*memref|number of operands"
OP_PATTERN = r"\b((?:arith|memref|linalg|func|stablehlo|scf|math|cf|tensor|vector|affine)\.[a-z_]+)\b"
REWARD_OP_PATTERN = r"\b((?:arith|memref|linalg|func|stablehlo|scf|math|cf|tensor)\.[a-z_]+)\b"
WRAPPERS = ("func.func", "func.return")


def first_match(s: Column, patterns, blank: str, other: str) -> Column:
    out = F.when(F.coalesce(F.trim(s), F.lit("")) == "", blank)
    for name, pattern in patterns:
        out = out.when(s.rlike("(?i)" + pattern), name)
    return out.otherwise(other)


def error_category(s: Column) -> Column:
    """Blank and null messages are 'other'."""
    return first_match(s, ERROR_PATTERNS, "other", "other")


def llvm_category(s: Column) -> Column:
    return first_match(s, LLVM_PATTERNS, "syntax", "syntax")


def shape_error(s: Column) -> Column:
    return F.coalesce(s.rlike(SHAPE_PATTERN), F.lit(False))


def ops(s: Column, pattern: str = OP_PATTERN) -> Column:
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(1))


def unknown_ops(s: Column, known: Column) -> Column:
    """Sorted distinct operations that aren't in the vocabulary."""
    return F.array_sort(F.array_except(F.array_distinct(ops(s)), known))


def body_ops(s: Column) -> Column:
    """The operations of a program with repeats, without the function wrapper."""
    return F.filter(ops(s, REWARD_OP_PATTERN), lambda o: ~o.isin(*WRAPPERS))


def llvm_opcodes(s: Column) -> Column:
    found = F.regexp_extract_all(s, F.lit(r"(?m)^\s*(?:%[\w.]+\s*=\s*)?([a-z][a-z0-9_.]*)"), F.lit(1))
    return F.filter(found, lambda o: ~o.isin("define", "entry", "ret", "br", "declare"))


def multiset_jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Shared over joined counts of two arrays taken as multisets."""
    count = lambda x, v: F.size(F.filter(x, lambda e: e == v))
    shared = lambda x, y: F.aggregate(F.array_distinct(x), F.lit(0), lambda acc, v: acc + F.least(count(x, v), count(y, v)))
    share = lambda x, y, s: F.when(F.size(x) + F.size(y) - s == 0, both_empty).otherwise(s / (F.size(x) + F.size(y) - s))
    return let(a, lambda x: let(b, lambda y: let(shared(x, y), lambda s: share(x, y, s))))


def values(s: Column) -> Column:
    """Ordered distinct value names, without result indices."""
    return F.array_distinct(F.transform(F.regexp_extract_all(s, F.lit(r"%[A-Za-z0-9_$.]+"), F.lit(0)), lambda x: F.regexp_replace(x, r"^%", "")))


FUNCTION = r"(?s)func\.func\s+@[\w$.]+\s*\(([^)]*)\)\s*(?:->\s*([^{]+?))?\s*\{"
PUBLIC_FUNCTION = r"func\.func\s+(?!private\b)@(\w+)\s*\(([^)]*)\)\s*(?:->\s*([^{]+?))?\s*\{"


def arg_types(args: Column) -> Column:
    typed = F.filter(F.split(args, ","), lambda a: a.contains(":"))
    return F.transform(typed, lambda a: F.regexp_replace(F.regexp_replace(a, r"(?s)^[^:]*:", ""), r"\s+", ""))


def signature(s: Column) -> Column:
    """struct(args, ret) of the first function; null without one."""
    return F.when(s.rlike(FUNCTION), F.struct(arg_types(F.regexp_extract(s, FUNCTION, 1)).alias("args"), F.regexp_replace(F.regexp_extract(s, FUNCTION, 2), r"\s+", "").alias("ret")))


def signature_score(gen: Column, gold: Column) -> Column:
    """Places with equal argument types, plus one for the result, over the longer list plus one; 0 without a signature."""
    a, b = signature(gen), signature(gold)
    hits = F.aggregate(F.zip_with(a["args"], b["args"], lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0))), F.lit(0), lambda acc, x: acc + x)
    score = (hits + (a["ret"] == b["ret"]).cast("int")) / (F.greatest(F.size(a["args"]), F.size(b["args"])) + 1)
    return F.when(a.isNull() | b.isNull(), 0.0).otherwise(score)


def define(s: Column) -> Column:
    """struct(name, ret, args) of an LLVM function definition; null without one."""
    p = r"define\s+([\w.]+)\s+@([\w.]+)\s*\(([^)]*)\)"
    args = F.filter(F.split(F.regexp_extract(s, p, 3), ","), lambda a: F.trim(a) != "")
    return F.when(s.rlike(p), F.struct(F.regexp_extract(s, p, 2).alias("name"), F.regexp_extract(s, p, 1).alias("ret"), F.transform(args, lambda a: F.element_at(F.split(F.trim(a), r"\s+"), 1)).alias("args")))


def llvm_signature_score(gen: Column, gold: Column) -> Column:
    a, b = define(gen), define(gold)
    return F.when(a.isNull() | b.isNull(), 0.0).otherwise(((a["name"] == b["name"]).cast("int") + (a["ret"] == b["ret"]).cast("int") + (a["args"] == b["args"]).cast("int")) / 3.0)


INTS, FLOATS = ("i1", "i8", "i16", "i32", "i64"), ("f16", "f32", "f64")
PRINTABLE = ("f32", "f64", "i32", "i64")
#: Types that can be run and printed; a ranked memref.
MEMREF = r"^memref<(\?|\d+)((?:x(?:\?|\d+))*)x([fi]\d+)>$"


def memref_type(t: Column) -> Column:
    """struct(dims, dtype) of a ranked memref; null otherwise, and for rank 0."""
    return F.when(t.rlike(MEMREF), F.struct(F.split(F.concat(F.regexp_extract(t, MEMREF, 1), F.regexp_extract(t, MEMREF, 2)), "x").alias("dims"), F.regexp_extract(t, MEMREF, 3).alias("dtype")))


def public_signature(s: Column) -> Column:
    """struct(name, args, ret) of the first function that isn't private; null without one or if an argument has no type."""
    args = F.regexp_extract(s, PUBLIC_FUNCTION, 2)
    pieces = F.when(F.trim(args) == "", F.array().cast("array<string>")).otherwise(F.split(args, ","))
    types = F.transform(pieces, lambda a: F.replace(F.substring_index(a, ":", -1), F.lit(" "), F.lit("")))
    return F.when(s.rlike(PUBLIC_FUNCTION) & F.forall(pieces, lambda a: a.contains(":")), F.struct(F.regexp_extract(s, PUBLIC_FUNCTION, 1).alias("name"), types.alias("args"), F.replace(F.trim(F.regexp_extract(s, PUBLIC_FUNCTION, 3)), F.lit(" "), F.lit("")).alias("ret")))


def exclusion(sig: Column) -> Column:
    """Why a gold function can't be run by the differential harness; null if it can."""
    scalar = (*INTS, *FLOATS, "index")
    bad = lambda test: F.exists(sig["args"], test)
    is_memref = lambda t: t.startswith("memref")
    return (
        F.when(sig.isNull(), "no_public_fn").when(sig["name"] == "main", "fn_named_main")
        .when((sig["ret"] != "") & (sig["ret"].startswith("(") | sig["ret"].contains(",")), "multi_result")
        .when((sig["ret"] != "") & ~sig["ret"].isin(*scalar), "unsupported_ret_type")
        .when(bad(lambda t: is_memref(t) & memref_type(t).isNull()), "unsupported_memref_type")
        .when(bad(lambda t: is_memref(t) & ~memref_type(t)["dtype"].isin(*PRINTABLE)), "unprintable_memref_dtype")
        .when(bad(lambda t: ~is_memref(t) & ~t.isin(*scalar)), "unsupported_arg_type")
        .when((sig["ret"] == "") & ~bad(is_memref), "no_observable_output")
    )


def signature_match(gold: Column, cand: Column) -> Column:
    """'exact', 'dim_relaxed' (a candidate's unknown dimension stands for the gold's) or 'mismatch'."""

    def fits(g, c):
        gm, cm = memref_type(g), memref_type(c)
        dims = F.size(gm["dims"]) == F.size(cm["dims"])
        return F.coalesce((g == c) | ((gm["dtype"] == cm["dtype"]) & dims & F.forall(F.zip_with(gm["dims"], cm["dims"], lambda a, b: (b == "?") | (a == b)), lambda ok: F.coalesce(ok, F.lit(False)))), F.lit(False))

    same_shape = (gold["ret"] == cand["ret"]) & (F.size(gold["args"]) == F.size(cand["args"]))
    return F.when(gold.isNull() | cand.isNull() | ~same_shape, "mismatch").when(gold["args"] == cand["args"], "exact").when(F.forall(F.zip_with(gold["args"], cand["args"], fits), lambda ok: ok), "dim_relaxed").otherwise("mismatch")


NUMBER = r"-?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|nan|inf)"


def numbers(s: Column) -> Column:
    """The numbers of a program's output as doubles; nan and inf are kept."""
    to = lambda x: F.when(x == "nan", F.lit(float("nan"))).when(x == "-nan", F.lit(float("nan"))).when(x == "inf", F.lit(float("inf"))).when(x == "-inf", F.lit(float("-inf"))).otherwise(x.try_cast("double"))
    return F.transform(F.regexp_extract_all(s, F.lit(NUMBER), F.lit(0)), to)


def outputs_equal(a: Column, b: Column, exact: bool = False, abs_tol: float = 1e-5, rel_tol: float = 1e-4) -> Column:
    """Two arrays of doubles of equal length, equal up to tolerance place by place; NaN equals NaN."""

    def same(x, y):
        near = (x == y) if exact else ((x == y) | (F.abs(x - y) <= abs_tol + rel_tol * F.greatest(F.abs(x), F.abs(y))))
        return (F.isnan(x) & F.isnan(y)) | (~F.isnan(x) & ~F.isnan(y) & near)

    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, same), lambda ok: F.coalesce(ok, F.lit(False)))


#: A check line of a test file.
DIRECTIVE = r"^//\s*([A-Z][A-Z0-9_]*)(?:-(?:NEXT|SAME|DAG|NOT|LABEL|EMPTY|COUNT-\d+))*\s*:\s*(.*)$"


def strip_directives(s: Column) -> Column:
    """A test file without RUN lines, check lines and case separators."""
    keep = F.filter(F.split(s, "\r?\n"), lambda x: ~(x.rlike(r"//\s*RUN:") | F.trim(x).rlike(DIRECTIVE) | (F.trim(x) == "// -----")))
    return F.concat(F.btrim(F.array_join(keep, "\n"), F.lit(" \t\r\n")), F.lit("\n"))


def split_cases(s: Column) -> Column:
    """The independent cases of a test file, cleaned, blank ones dropped."""
    return F.filter(F.transform(F.split(s, r"(?m)^[ \t]*//[ \t]*-----[ \t]*$"), strip_directives), lambda x: F.btrim(x, F.lit(" \t\r\n")) != "")


def check_hints(s: Column) -> Column:
    lines = F.transform(F.split(s, "\r?\n"), lambda x: F.trim(x))
    return F.transform(F.filter(lines, lambda x: x.rlike(DIRECTIVE) & ~x.rlike(r"//\s*RUN:")), lambda x: F.trim(F.regexp_extract(x, DIRECTIVE, 2)))


def dialects(s: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(s, F.lit(r"([a-z_][a-z_0-9]*)\.[a-z_]"), F.lit(1)))


def weak_prompt(path: Column) -> Column:
    """A weak prompt from a test file's path: its dialect folders and its name."""
    parts = F.filter(F.split(F.lower(path), "/"), lambda p: p.isin("arith", "func", "linalg", "memref", "scf", "affine"))
    stem = F.translate(F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", ""), "_-", "  ")
    return F.array_join(F.concat(parts, F.array(stem)), " ")


#: Names, types and numbers that a rewrite must keep.
KEEP = r"`[^`]+`|\b(?:i1|i8|i16|i32|i64|f16|f32|f64|index)\b|(?:tensor|memref)<[^>]*>|\b\d+\b"


def clean_rewrite(s: Column) -> Column:
    """The first line of a rewritten instruction without its label and quotes."""
    line = F.trim(F.element_at(F.split(F.btrim(s, F.lit(" \t\r\n")), "\r?\n"), 1))
    return F.trim(F.btrim(F.trim(F.regexp_replace(line, r"(?i)^(?:rewritten(?: instruction)?|instruction)\s*:\s*", "")), F.lit('"')))


def rewrite_acceptable(orig: Column, new: Column) -> Column:
    """Ten characters or more, not the original, and all names, types and numbers kept."""
    need = lambda s: F.array_distinct(F.regexp_extract_all(s, F.lit(KEEP), F.lit(0)))
    return F.coalesce((F.length(new) >= 10) & (F.lower(new) != F.lower(orig)) & (F.size(F.array_except(need(orig), need(new))) == 0), F.lit(False))


def content_key(text: Column, flags: Column) -> Column:
    return F.sha2(F.concat(text.cast("binary"), F.unhex(F.lit("00")), flags.cast("binary")), 256)


def chat_prompt(nl: Column, header: Column | None = None) -> Column:
    """A chat-markup prompt; header, where not null, is the interface to keep."""
    task = nl if header is None else F.concat(nl, F.coalesce(F.concat(F.lit("\nUse exactly this interface: "), header), F.lit("")))
    return F.concat(F.lit("<|im_start|>user\n"), task, F.lit("<|im_end|>\n<|im_start|>assistant\n"))


def few_shot_prompt(nl: Column, examples: list[tuple[str, str]]) -> Column:
    """A chat-markup prompt behind worked examples: each an instruction and its answer, as earlier turns."""
    turn = lambda who, what: f"<|im_start|>{who}\n{what}<|im_end|>\n"
    return F.concat(F.lit("".join(turn("user", q) + turn("assistant", a) for q, a in examples)), chat_prompt(nl))
