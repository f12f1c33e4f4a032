"""Functions around running programs: inputs drawn from a key, literals, drivers, unwrapping, outputs."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def unwrap_module(text: str, unbalanced: str = "strip") -> str:
    """What is inside an outer module. A module that never closes: its tail ('strip'), or the text as it was ('keep')."""
    m = re.match(r"\s*module\b[^{]*\{", text)
    if not m:
        return text
    depth = 1
    for i in range(m.end(), len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0:
            return text[m.end() : i].strip("\n")
    return text[m.end() :].strip("\n") if unbalanced == "strip" else text


class Drawn:
    """Drawn values: places in a list of all values that their type can have."""

    def __init__(self, of: list, at: np.ndarray):
        self.of, self.at, self.made = of, at, ([], "")

    def __len__(self):
        return len(self.at)

    def values(self) -> list:
        return [self.of[i] for i in self.at.tolist()]

    def text(self, words: list[str], shape: list[int]) -> str:
        """Nested brackets of the values in a shape, none of it 0, each value as its word. In bytes: a value is a few of them, padded
        with 0, and the last of a row ends with a byte that tells how many brackets close there."""
        depth = len(shape)
        if depth == 1 and self.made[0] == words:
            return "[" + self.made[1].encode().translate(None, b"[]").decode() + "]"
        ends = [", ", *map(chr, range(1, depth))]
        table = np.array([w + e for e in ends for w in words], "S")
        wide = max(8, table.itemsize)
        table = table.astype(f"S{wide}")
        table = table.view(np.uint64) if wide == 8 else table
        at, step = self.at.astype(np.intp), 1
        for d in shape[:0:-1]:
            step *= d
            at[step - 1 :: step] += len(words)
        out = b"".join(table[at[i : i + BLOCK]].tobytes().translate(None, b"\0") for i in range(0, len(at), BLOCK))
        for k in range(1, depth):
            out = out.replace(bytes([k]), b"]" * k + b", " + b"[" * k)
        self.made = words, "[" * depth + out[: -1 - depth].decode() + "]"
        return self.made[1]


#: Values that are made into text at once.
BLOCK = 1 << 16


class _Words:
    """Many randint() of a random.Random at once: the words of its generator, cut and rejected as it does."""

    def __init__(self, rng: random.Random):
        state = rng.getstate()[1]
        self.bits, self.words = np.random.MT19937(), np.zeros(0, np.uint32)
        self.bits.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[:-1], np.uint32), "pos": state[-1]}}

    def below(self, n: int, count: int) -> np.ndarray:
        bits, got = n.bit_length(), []
        while count:
            if not len(self.words):
                self.words = self.bits.random_raw(min(BLOCK, count * 2 + 16)).astype(np.uint32)
            x = self.words >> np.uint32(32 - bits)
            fits = np.flatnonzero(x < n)[:count]
            self.words = self.words[fits[-1] + 1 if len(fits) == count else len(x) :]
            got.append(x[fits])
            count -= len(fits)
        return np.concatenate(got) if got else np.zeros(0, np.uint32)


def drawn(key: str, trial: int, types: list[str]) -> list:
    """draws(), with Drawn in place of the lists."""
    words, n = _Words(random.Random(int(hashlib.sha256(f"{key}/{trial}".encode()).hexdigest()[:12], 16))), 3 + trial

    def some(t: str, size: int) -> Drawn:
        of = [x / 4 for x in range(-32, 33)] if t.startswith("f") else [0, 1] if t == "i1" else list(range(n + 1)) if t == "index" else list(range(-50, 51))
        return Drawn(of, words.below(len(of), size))

    def one(t: str):
        m = re.fullmatch(r"memref<((?:[\d?]+x)+)([a-z]+\d*)>", t)
        if not m:
            return some(t, 1).values()[0]
        size = 1
        for d in m.group(1).split("x")[:-1]:
            size *= n if d == "?" else int(d)
        return some(m.group(2), size)

    return [one(t) for t in types]


def draws(key: str, trial: int, types: list[str]) -> list:
    """One input per type, the same for the same key and trial: integers, quarter steps for floats, n x .. lists for memrefs."""
    return [x.values() if isinstance(x, Drawn) else x for x in drawn(key, trial, types)]


def shown(values: list) -> str:
    """repr() of draws(), from drawn()."""
    return "[" + ", ".join((x.text([repr(v) for v in x.of], [len(x)]) if len(x) else "[]") if isinstance(x, Drawn) else repr(x) for x in values) + "]"


def literal(value, type_: str) -> str:
    """A value as program text."""
    if type_ == "i1":
        return "true" if value else "false"
    return repr(float(value)) if type_.startswith(("f", "bf")) else str(int(value))


def driver(name: str, types: list[str], values: list, ret: str) -> str:
    """A main function that calls a scalar function on literals and prints its result."""
    lines = [f"%x{i} = arith.constant {literal(v, t)}" + ("" if t == "i1" else f" : {t}") for i, (v, t) in enumerate(zip(values, types))]
    call = f"%r = func.call @{name}({', '.join(f'%x{i}' for i in range(len(types)))}) : ({', '.join(types)}) -> {ret}"
    return "\n".join(["func.func @main() {", *("  " + x for x in lines), f"  {call}", f"  vector.print %r : {ret}", "  return", "}"])


def printed(out: Column) -> Column:
    """struct(scalars, memrefs) of printed output: numbers before the first memref block, then each block's sizes and data."""
    from corvane.functions.text import numbers

    parts = F.split(out, "Unranked Memref")
    data = lambda p: F.regexp_extract(p, r"(?s)data =\s*(\[.*\])", 1)
    block = lambda p: F.struct(F.transform(F.filter(F.split(F.regexp_extract(p, r"sizes = \[([^\]]*)\]", 1), ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).try_cast("int")).alias("sizes"), numbers(data(p)).alias("data"))
    return F.struct(numbers(F.get(parts, 0)).alias("scalars"), F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), block).alias("memrefs"))


def same_output(a: Column, b: Column, exact: bool = False) -> Column:
    """Whether two printed() outputs agree: as many scalars and memrefs, equal sizes, values within tolerance, NaN equal to NaN."""
    from corvane.functions.text import outputs_equal

    pairs = F.forall(F.zip_with(a["memrefs"], b["memrefs"], lambda x, y: (x["sizes"] == y["sizes"]) & outputs_equal(x["data"], y["data"], exact)), lambda ok: F.coalesce(ok, F.lit(False)))
    return outputs_equal(a["scalars"], b["scalars"], exact) & (F.size(a["memrefs"]) == F.size(b["memrefs"])) & pairs


def scope_events(text: str) -> list[tuple[str, str, int, int]]:
    """('use' | 'def', name, start, visible from): uses with their place; definitions are visible from the end of their line."""
    out = []
    for line in re.finditer(r"[^\n]+", text):
        head = re.match(r"\s*((?:%[\w$.]+\s*,?\s*)+)=", line.group())
        made = set(re.findall(r"%([\w$.]+)", head.group(1))) if head else set()
        skip = head.end() if head else 0
        is_function = "func.func" in line.group()
        for m in re.finditer(r"%([\w$.]+)", line.group()):
            kind = "def" if is_function or m.start() < skip and m.group(1) in made else "use"
            out.append((kind, m.group(1), line.start() + m.start(), line.end() if kind == "def" else line.start() + m.start()))
    return out


def corrupted(text: str, at: int, names: list[str], seed: int = 0) -> str:
    """The text with the use at a place renamed to another of names; the same text if there is no other."""
    m = re.compile(r"%([\w$.]+)").match(text, at)
    others = sorted(set(names) - {m.group(1)}) if m else []
    if not others:
        return text
    return text[: m.start()] + "%" + random.Random(f"{seed}/{at}").choice(others) + text[m.end() :]


_PIECE = re.compile(r"%?[A-Za-z_$.]+|\d+|[^\s\w]")


def patch_pair(text: str, site: int, seed: int = 0) -> dict | None:
    """Clean and corrupted tokens of a program around one use: the use at a place in the text is renamed to another name in it, and both
    are cut into pieces. Gives the pieces, the place of the piece before the name in either, the name's first piece, and the first
    pieces of names in scope and out of it. None if the name isn't in scope there or there is no other."""
    events = scope_events(text)
    visible = {n for k, n, _, v in events if k == "def" and v <= site}
    every = {n for _, n, _, _ in events}
    name = next((n for k, n, at, _ in events if k == "use" and at == site), None)
    other = corrupted(text, site, sorted(every), seed)
    if name is None or name not in visible or other == text:
        return None
    first = lambda n: _PIECE.findall("%" + n)[0]
    cut = lambda t: [(m.start(), m.group()) for m in _PIECE.finditer(t)]
    clean, corrupt = cut(text), cut(other)
    before = lambda p: max((i for i, (at, _) in enumerate(p) if at < site), default=-1)
    inside = sorted({first(n) for n in visible})
    return {"clean": [x for _, x in clean], "corrupt": [x for _, x in corrupt], "clean_at": before(clean), "corrupt_at": before(corrupt), "target": first(name), "inside": inside, "outside": sorted({first(n) for n in every - visible | {name}} - set(inside))}


_LLVM_TYPES = {"half": "%.6e", "float": "%.9e", "double": "%.17e"}


def dense(values: list | Drawn, shape: list[int], type_: str) -> str:
    """Nested brackets of a flat list in a shape, as a dense literal."""
    if isinstance(values, Drawn):
        if len(values) and len(shape) < 32:
            return values.text([literal(v, type_) for v in values.of], shape)
        values = values.values()
    if not shape:
        return literal(values[0], type_)
    step = len(values) // shape[0] if shape[0] else 0
    return "[" + ", ".join(dense(values[i * step : (i + 1) * step], shape[1:], type_) for i in range(shape[0])) + "]"


def memref_driver(name: str, types: list[str], values: list, trial: int, ret: str = "") -> str:
    """A main function that fills memrefs from dense globals, calls a function and prints its result and every memref."""
    lines, globals_, args, shown = [], [], [], []
    for i, (v, t) in enumerate(zip(values, types)):
        m = re.fullmatch(r"memref<((?:[\d?]+x)+)([a-z]+\d*)>", t)
        if not m:
            lines.append(f"%x{i} = arith.constant {literal(v, t)}" + ("" if t == "i1" else f" : {t}"))
            args.append(f"%x{i}")
            continue
        shape = [3 + trial if d == "?" else int(d) for d in m.group(1).split("x")[:-1]]
        whole = f"memref<{''.join(f'{d}x' for d in shape)}{m.group(2)}>"
        globals_.append(f"memref.global \"private\" @g{i} : {whole} = dense<{dense(v, shape, m.group(2))}>")
        lines += [f"%g{i} = memref.get_global @g{i} : {whole}", f"%b{i} = memref.alloc() : {whole}", f"memref.copy %g{i}, %b{i} : {whole} to {whole}"]
        if "?" in m.group(1):
            lines.append(f"%x{i} = memref.cast %b{i} : {whole} to {t}")
        args.append(f"%x{i}" if "?" in m.group(1) else f"%b{i}")
        flat = f"memref<*x{m.group(2)}>"
        shown += [f"%u{i} = memref.cast %b{i} : {whole} to {flat}", f"call @printMemref{m.group(2).upper()}(%u{i}) : ({flat}) -> ()"]
    call = f"func.call @{name}({', '.join(args)}) : ({', '.join(types)}) -> " + (ret or "()")
    body = [*lines, ("%r = " if ret else "") + call, *([f"vector.print %r : {ret}"] if ret else []), *shown, "return"]
    used = sorted({m.group(1) for t in types if (m := re.search(r"x([a-z]+\d*)>$", t))})
    return "\n".join([*globals_, *(f"func.func private @printMemref{u.upper()}(memref<*x{u}>)" for u in used), "func.func @main() {", *("  " + x for x in body), "}"])


def llvm_driver(name: str, types: list[str], values: list, ret: str) -> str:
    """A main function in LLVM IR that calls a function on constants and prints its result by printf."""
    value = lambda v, t: repr(float(v)) if t in _LLVM_TYPES else str(int(v))
    shape = _LLVM_TYPES.get(ret, "%lld")
    wide = "double" if ret in _LLVM_TYPES else "i64"
    widen = [] if ret == wide else [f"  %w = {'fpext' if ret in _LLVM_TYPES else 'sext'} {ret} %r to {wide}"]
    return "\n".join([
        f'@fmt = private constant [{len(shape) + 2} x i8] c"{shape}\\0A\\00"', "declare i32 @printf(ptr, ...)", "define i32 @main() {", "entry:",
        f"  %r = call {ret} @{name}({', '.join(f'{t} {value(v, t)}' for v, t in zip(values, types))})", *widen, f"  %n = call i32 (ptr, ...) @printf(ptr @fmt, {wide} {'%w' if widen else '%r'})", "  ret i32 0", "}",
    ])
