"""A pool of LLVM functions from MLIR ones: straight-line scalar functions are lowered here; whatever isn't is told by its reason."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.validators import grammar, llvm, mlir

#: The instruction of each operation, and the name of each type.
INSTRUCTIONS = {
    "addi": "add", "subi": "sub", "muli": "mul", "divsi": "sdiv", "divui": "udiv", "remsi": "srem", "remui": "urem", "andi": "and", "ori": "or", "xori": "xor", "shli": "shl", "shrsi": "ashr", "shrui": "lshr",
    "addf": "fadd", "subf": "fsub", "mulf": "fmul", "divf": "fdiv", "remf": "frem", "extsi": "sext", "extui": "zext", "trunci": "trunc", "extf": "fpext", "truncf": "fptrunc", "sitofp": "sitofp", "uitofp": "uitofp",
    "fptosi": "fptosi", "fptoui": "fptoui", "bitcast": "bitcast",
}
TYPES = {"f16": "half", "f32": "float", "f64": "double", "index": "i64"}
_HEAD = re.compile(r"func\.func\s+@([\w$.]+)\s*\(([^)]*)\)\s*(?:->\s*([\w]+))?")


class NotLowered(ValueError):
    pass


def _type(t: str) -> str:
    t = t.strip()
    if t in TYPES or re.fullmatch(r"i\d+", t):
        return TYPES.get(t, t)
    raise NotLowered(t)


def lower(text: str) -> str:
    """The LLVM text of a module with one function of arith operations on scalars, or NotLowered."""
    parts = [p for p in mlir.pieces(text) if p[1] not in ("module", "}")]
    head = _HEAD.search(parts[0][2]) if parts and parts[0][1] == "func.func" else None
    if not head or any(p[1] == "func.func" for p in parts[1:]) or mlir.check(text):
        raise NotLowered("form")
    number = {}  # numbered values get a letter, since bare numbers are counted
    name = lambda v: number.setdefault(v, f"%v{v}" if v.isdigit() else f"%{v}")
    params = [p.partition(":") for p in mlir.split_top(head.group(2))]
    lines = [f"define {_type(head.group(3)) if head.group(3) else 'void'} @{head.group(1)}({', '.join(f'{_type(t)} {name(v.strip().lstrip('%'))}' for v, _, t in params)}) {{", "entry:"]
    constant: dict[str, str] = {}
    for results, op, rest in parts[1:]:
        dialect, _, what = op.partition(".")
        body, _, typed = rest[len(op) :].rpartition(":") if ":" in rest else (rest[len(op) :], "", "")
        used = [constant.get(v) or name(v) for v in re.findall(r"%([\w$.]+)", body)]
        if op in ("return", "func.return"):
            lines.append(f"  ret {_type(typed)} {used[0]}" if used else "  ret void")
        elif dialect != "arith":
            raise NotLowered(op)
        elif what == "constant":
            constant[results[0]] = body.strip() if typed else re.sub(r".*\b(true|false)\b.*", r"\1", rest)
        elif what in ("cmpi", "cmpf"):
            lines.append(f"  {name(results[0])} = {what[3]}cmp {body.split(',')[0].strip()} {_type(typed)} {used[0]}, {used[1]}")
        elif what == "select":
            lines.append(f"  {name(results[0])} = select i1 {used[0]}, {_type(typed)} {used[1]}, {_type(typed)} {used[2]}")
        elif what in INSTRUCTIONS and " to " in typed:
            a, _, b = typed.partition(" to ")
            lines.append(f"  {name(results[0])} = {INSTRUCTIONS[what]} {_type(a)} {used[0]} to {_type(b)}")
        elif what in INSTRUCTIONS:
            lines.append(f"  {name(results[0])} = {INSTRUCTIONS[what]} {_type(typed)} {used[0]}, {used[1]}")
        else:
            raise NotLowered(op)
    return "\n".join([*lines, "}"]) + "\n"


def lowered(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, ir and reason: 'kept', or the first gate that a row didn't pass: lower_fail, grammar, scope."""

    def run(batches):
        for b in batches:
            out = []
            for t in b.column(b.schema.names.index(text)).to_pylist():
                try:
                    ir = lower(t or "")
                except NotLowered:
                    out.append((None, "lower_fail"))
                    continue
                out.append((ir, "grammar" if not grammar.parses(ir, "llvm_c1_c2") else "scope" if llvm.check(ir) else "kept"))
            yield pa.record_batch([*(b.column(b.schema.names.index(k)) for k in keys), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.string())], [*keys, "ir", "reason"])

    fields = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, text).mapInArrow(run, f"{fields}, ir string, reason string")


def until_kept(rows: DataFrame, order: str, n_keep: int) -> DataFrame:
    """rows up to the one that is the n_keep-th kept, in order: a scan that stops early, told from the kept rows' order alone."""
    last = rows.filter("reason = 'kept'").select(order).orderBy(order).limit(n_keep).agg(F.max(order).alias("_last"), F.count("*").alias("_n"))
    return rows.crossJoin(F.broadcast(last)).filter((F.col("_n") < n_keep) | (F.col(order) <= F.col("_last"))).drop("_last", "_n")  # one row
