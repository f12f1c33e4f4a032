"""Table functions that make records: prompts with programs, and synthetic programs. A row depends on its number and the seed alone."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corvane.validators import synth

_WORDS = {"addi": "adds {0} and {1}", "subi": "subtracts {1} from {0}", "muli": "multiplies {0} by {1}", "andi": "masks {0} with {1}", "maxsi": "keeps the larger of {0} and {1}", "minsi": "keeps the smaller of {0} and {1}", "addf": "adds {0} and {1}", "subf": "subtracts {1} from {0}", "mulf": "multiplies {0} by {1}", "divf": "divides {0} by {1}"}
_INT, _FLOAT = ("addi", "subi", "muli", "andi", "maxsi", "minsi"), ("addf", "subf", "mulf", "divf")
_CASTS = (("extsi", "i16", "i32"), ("extsi", "i32", "i64"), ("trunci", "i64", "i32"), ("sitofp", "i32", "f32"), ("fptosi", "f32", "i32"), ("extf", "f32", "f64"), ("truncf", "f64", "f32"))


def _function(name: str, params: list[str], body: list[str], ret: str | None) -> str:
    head = f"  func.func @{name}({', '.join(f'%a{i} : {t}' for i, t in enumerate(params))})" + (f" -> {ret}" if ret else "") + " {"
    return "\n".join(["module {", head, *("    " + x for x in body), "  }", "}"])


def record(family: str, rng: random.Random) -> tuple[str, str, str]:
    """(dialect, prompt, program) of a family."""
    name = f"f{rng.randrange(10**6)}"
    ints = rng.random() < 0.5
    t = rng.choice(("i16", "i32", "i64") if ints else ("f32", "f64"))
    ops = _INT if ints else _FLOAT
    lit = str(rng.randint(-999, 999)) if ints else f"{rng.randint(-99, 99)}.{rng.randint(0, 9)}"
    if family == "binop":
        op = rng.choice(ops)
        return "arith+func", f"Write `{name}`, which {_WORDS[op].format('its first', 'its second')} argument ({t}).", _function(name, [t, t], [f"%r = arith.{op} %a0, %a1 : {t}", f"return %r : {t}"], t)
    if family == "chain":
        n = rng.randint(2, 6)
        body, said, last = [], [], "%a0"
        for i in range(n):
            op, other = rng.choice(ops), rng.choice(["%a0", "%a1", last])
            body.append(f"%s{i} = arith.{op} {last}, {other} : {t}")
            said.append(_WORDS[op].format("the value so far", "an earlier value"))
            last = f"%s{i}"
        return "arith+func", f"Write `{name}` of two {t} values, which {', then '.join(said)}.", _function(name, [t, t], [*body, f"return {last} : {t}"], t)
    if family == "constant":
        return "arith+func", f"Write `{name}`, which returns {lit} as {t}.", _function(name, [], [f"%c = arith.constant {lit} : {t}", f"return %c : {t}"], t)
    if family == "compare":
        how, cmp = (rng.choice(("slt", "sgt", "eq")), "cmpi") if ints else (rng.choice(("olt", "ogt", "oeq")), "cmpf")
        return "arith+func", f"Write `{name}`, which compares two {t} values by `{how}`.", _function(name, [t, t], [f"%r = arith.{cmp} {how}, %a0, %a1 : {t}", "return %r : i1"], "i1")
    if family == "cast":
        op, src, dst = rng.choice(_CASTS)
        return "arith+func", f"Write `{name}`, which turns {src} into {dst}.", _function(name, [src], [f"%r = arith.{op} %a0 : {src} to {dst}", f"return %r : {dst}"], dst)
    if family == "minmax3":
        how, cmp = ("slt", "cmpi") if ints else ("olt", "cmpf")
        body = [f"%b = arith.{cmp} {how}, %a0, %a1 : {t}", f"%m = arith.select %b, %a0, %a1 : {t}", f"%d = arith.{cmp} {how}, %m, %a2 : {t}", f"%r = arith.select %d, %m, %a2 : {t}", f"return %r : {t}"]
        return "arith+func", f"Write `{name}`, which returns the least of three {t} values.", _function(name, [t] * 3, body, t)
    if family == "memref_load":
        m = f"memref<{rng.randint(2, 64)}x{t}>"
        return "memref", f"Write `{name}`, which reads place 0 of a {m}.", _function(name, [m], ["%i = arith.constant 0 : index", f"%r = memref.load %a0[%i] : {m}", f"return %r : {t}"], t)
    m, op = f"memref<{rng.randint(2, 64)}x{rng.randint(2, 64)}x{t}>", rng.choice(("add", "sub", "mul"))
    return "linalg", f"Write `{name}`, which puts the {op} of two {m} into a third.", _function(name, [m] * 3, [f"linalg.{op} ins(%a0, %a1 : {m}, {m}) outs(%a2 : {m})", "return"], None)


def _memref(rng: random.Random, t: str, rank: int = 1, free: float = 0.0) -> str:
    return "memref<" + "".join(("?" if rng.random() < free else str(rng.randint(2, 64))) + "x" for _ in range(rank)) + f"{t}>"


def _said(name: str, what: str) -> str:
    return f"Write `{name}`, which {what}."


def second_record(family: str, rng: random.Random) -> tuple[str, str, str]:
    """(dialect, prompt, program) of a family of the second set: each is a recipe of parameters, lines and result."""
    name, ints = f"g{rng.randrange(10**6)}", rng.random() < 0.5
    t = rng.choice(("i8", "i16", "i32", "i64") if ints else ("f16", "f32", "f64"))
    lit = lambda: str(rng.randint(-60, 60)) if ints else f"{rng.randint(-60, 60)}.{rng.randint(0, 9)}"
    kind, cmp = ("i", "cmpi") if ints else ("f", "cmpf")
    how = rng.choice(("slt", "sgt", "sle", "eq") if ints else ("olt", "ogt", "ole", "oeq"))
    less = "slt" if ints else "olt"
    add, sub, mul = (f"arith.{o}{kind}" for o in ("add", "sub", "mul"))
    dialect, ret = "arith+func", t
    if family == "alloc_dealloc":
        m, place = _memref(rng, t), rng.randint(0, 1)
        params, body = [t], [f"%b = memref.alloc() : {m}", f"%i = arith.constant {place} : index", f"memref.store %a0, %b[%i] : {m}"]
        body += [f"%r = memref.load %b[%i] : {m}"] if rng.random() < 0.6 else []
        ret = t if len(body) == 4 else None
        body += [f"memref.dealloc %b : {m}"] + ([f"return %r : {t}"] if ret else ["return"])
        what = f"allocates a {m}, puts its argument at place {place}, {'reads it again, ' if ret else ''}and frees the buffer"
    elif family == "negate":
        params, body = [t], [f"%z = arith.constant {'0' if ints else '0.0'} : {t}", f"%n = {sub} %z, %a0 : {t}"]
        size = rng.random() < 0.5
        body += [f"%b = arith.{cmp} {less}, %a0, %z : {t}", f"%r = arith.select %b, %n, %a0 : {t}", f"return %r : {t}"] if size else [f"return %n : {t}"]
        what = f"gives the {'size' if size else 'negative'} of a {t} value by taking it from zero"
    elif family == "clamp":
        t = ret = rng.choice(("i16", "i32", "i64"))
        sign = rng.choice("su")
        params, body = [t] * 3, [f"%l = arith.max{sign}i %a0, %a1 : {t}", f"%r = arith.min{sign}i %l, %a2 : {t}", f"return %r : {t}"]
        what = f"keeps a {t} value between two bounds ({'signed' if sign == 's' else 'unsigned'})"
    elif family == "cmp_const":
        v = lit()
        params, body = [t], [f"%c = arith.constant {v} : {t}", f"%b = arith.{cmp} {how}, %a0, %c : {t}"]
        pick = rng.random() < 0.5
        ret = t if pick else "i1"
        body += [f"%r = arith.select %b, %a0, %c : {t}", f"return %r : {t}"] if pick else ["return %b : i1"]
        what = f"compares a {t} value with {v} by `{how}`" + (" and gives the value where that holds, else the constant" if pick else "")
    elif family == "const_op2":
        t = ret = rng.choice(("i16", "i32", "i64"))
        op, v = rng.choice((("shli", 3), ("shrsi", 2), ("shrui", 4), ("andi", 255), ("ori", 16), ("xori", 7), ("remsi", 9), ("divsi", 5), ("maxsi", 0), ("minsi", 100)))
        params, body = [t], [f"%c = arith.constant {v} : {t}", f"%r = arith.{op} %a0, %c : {t}", f"return %r : {t}"]
        what = f"applies `{op}` to a {t} value and {v}"
    elif family == "cast_chain":
        steps = rng.choice((("extsi", "i8", "i16", "extsi", "i32"), ("extui", "i16", "i32", "extui", "i64"), ("extf", "f16", "f32", "extf", "f64"), ("truncf", "f64", "f32", "truncf", "f16"), ("sitofp", "i16", "f32", "extf", "f64"), ("fptosi", "f64", "i64", "trunci", "i32"), ("index_cast", "i64", "index", "index_cast", "i32")))
        one, t0, t1, two, ret = steps
        params, body = [t0], [f"%s = arith.{one} %a0 : {t0} to {t1}", f"%r = arith.{two} %s : {t1} to {ret}", f"return %r : {ret}"]
        what = f"turns {t0} into {t1} and that into {ret}"
    elif family == "bitcast":
        t, ret = rng.choice((("i16", "f16"), ("i32", "f32"), ("i64", "f64"), ("f16", "i16"), ("f32", "i32"), ("f64", "i64")))
        params, body = [t], [f"%r = arith.bitcast %a0 : {t} to {ret}", f"return %r : {ret}"]
        what = f"reads the bits of a {t} value as {ret}"
    elif family == "fminmax":
        t = ret = rng.choice(("f16", "f32", "f64"))
        big, n = rng.random() < 0.5, rng.randint(2, 4)
        params, body, last = [t] * n, [], "%a0"
        for k in range(1, n):
            body += [f"%b{k} = arith.cmpf {'ogt' if big else 'olt'}, {last}, %a{k} : {t}", f"%m{k} = arith.select %b{k}, {last}, %a{k} : {t}"]
            last = f"%m{k}"
        body.append(f"return {last} : {t}")
        what = f"finds the {'greatest' if big else 'least'} of {n} {t} values by comparing in turn"
    elif family == "cond_select":
        after = rng.random() < 0.5
        params, body = ["i1", t, t], [f"%s = arith.select %a0, %a1, %a2 : {t}"]
        body += [f"%r = {rng.choice((add, mul))} %s, %a1 : {t}", f"return %r : {t}"] if after else [f"return %s : {t}"]
        what = f"picks one of two {t} values by a flag" + (" and works on with it" if after else "")
    elif family == "mem_elem":
        m, dialect, ret = _memref(rng, t, free=0.5), "arith+func", None
        swap = rng.random() < 0.5
        params, body = [m, "index", "index"], [f"%x = memref.load %a0[%a1] : {m}"]
        body += ([f"%y = memref.load %a0[%a2] : {m}", f"memref.store %y, %a0[%a1] : {m}"] if swap else []) + [f"memref.store %x, %a0[%a2] : {m}", "return"]
        what = f"{'swaps two places' if swap else 'copies one place to another'} of a {m}"
    elif family == "dim_cast":
        m, k = _memref(rng, t, rng.randint(2, 3), 0.4), rng.randint(0, 1)
        ret = rng.choice(("i32", "i64", "index"))
        params, body = [m], [f"%k = arith.constant {k} : index", f"%d = memref.dim %a0, %k : {m}"]
        body += ["return %d : index"] if ret == "index" else [f"%r = arith.index_cast %d : index to {ret}", f"return %r : {ret}"]
        what = f"tells dimension {k} of a {m} as {ret}"
    elif family == "poly":
        degree, params = rng.randint(2, 4), [t]
        coefficients = [lit() for _ in range(degree + 1)]
        body, last = [f"%c0 = arith.constant {coefficients[0]} : {t}"], "%c0"
        for k in range(1, degree + 1):
            body += [f"%c{k} = arith.constant {coefficients[k]} : {t}", f"%p{k} = {mul} {last}, %a0 : {t}", f"%q{k} = {add} %p{k}, %c{k} : {t}"]
            last = f"%q{k}"
        body.append(f"return {last} : {t}")
        what = f"evaluates the {t} polynomial with coefficients {', '.join(coefficients)}, highest first, step by step"
    else:
        t, dialect, ret = rng.choice(("f16", "f32", "f64")), "linalg", None
        m = _memref(rng, t, rng.randint(1, 2), 0.3)
        if family == "linalg_pair":
            op = rng.choice(("add", "sub", "mul", "div"))
            params, body = [m] * 3, [f"linalg.{op} ins(%a0, %a1 : {m}, {m}) outs(%a2 : {m})", "return"]
            what = f"applies `{op}` place by place to two {m} and writes a third"
        else:
            op = rng.choice(("exp", "log", "abs", "sqrt", "negf", "floor"))
            params, body = [m] * 2, [f"linalg.{op} ins(%a0 : {m}) outs(%a1 : {m})", "return"]
            what = f"applies `{op}` to each place of a {m} and writes another"
    return dialect, _said(name, what), _function(name, params, body, ret)


#: Weights of the families, and of those of the second set, which are mixed in at a rate.
FAMILIES = {"binop": 4, "chain": 5, "constant": 1, "compare": 2, "cast": 2, "minmax3": 2, "memref_load": 2, "linalg": 4}
SECOND = {"alloc_dealloc": 2, "negate": 1, "clamp": 1, "cmp_const": 1, "const_op2": 1, "cast_chain": 2, "bitcast": 1, "fminmax": 1, "cond_select": 1, "mem_elem": 2, "dim_cast": 1, "poly": 1, "linalg_pair": 1, "linalg_one": 1}


def templates(spark: SparkSession, n: int, seed: int, families: dict[str, int] = FAMILIES, second: float = 0.0) -> DataFrame:
    """(id, dialect, family, nl, mlir) of n draws with equal records dropped; made where the rows are. A share `second` of the draws is of
    the second set of families. A given draw is the same record at any n."""

    def run(batches):
        for b in batches:
            rows = []
            for i in b.column(0).to_pylist():
                rng = random.Random(f"{seed}/{i}")
                new = second > 0 and rng.random() < second
                family = rng.choices([*(SECOND if new else families)], [*(SECOND if new else families).values()])[0]
                rows.append((i, family, *(second_record if new else record)(family, rng)))
            yield pa.record_batch([pa.array(c) for c in zip(*rows)] if rows else [pa.array([], t) for t in (pa.int64(), *[pa.string()] * 4)], ["id", "family", "dialect", "nl", "mlir"])

    return spark.range(n).mapInArrow(run, "id long, family string, dialect string, nl string, mlir string").dropDuplicates(["nl", "mlir"])


def synthetic(grid: DataFrame) -> DataFrame:
    """(d, n, nesting, seed) -> the same with nl and gold, a program whose longest dependency spans d statements."""

    def run(batches):
        for b in batches:
            cols = {k: b.column(k).to_pylist() for k in ("d", "n", "nesting", "seed")}
            gold = [synth.generate(*x) for x in zip(*cols.values())]
            nl = [f"Write a program with {n} values in use whose longest dependency spans {d} statements." for d, n in zip(cols["d"], cols["n"])]
            yield pa.record_batch([*(pa.array(v, pa.int64()) for v in cols.values()), pa.array(nl, pa.string()), pa.array(gold, pa.string())], [*cols, "nl", "gold"])

    return grid.select(*[grid[c].cast("long") for c in ("d", "n", "nesting", "seed")]).mapInArrow(run, "d long, n long, nesting long, seed long, nl string, gold string")
