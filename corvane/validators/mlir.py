"""MLIR programs of the arith, memref, linalg, stablehlo, func and scf dialects: structure, type domains, and scope with regions.

A text is cut where a statement can begin (a result list or an operation name, `return`, `else`, `module`, a closing brace), so
any layout gives the same statements. Each operation has one line of rules: how its operands are typed by the statement's type, and
what it defines. Operations without a rule are abstained on; what they define has an unknown type that agrees with all.
"""

from __future__ import annotations

import re
from collections import ChainMap
from typing import NamedTuple

#: The operations of each kind.
INT_BINARY = "addi subi muli divsi divui andi ori xori shli shrsi shrui maxsi maxui minsi minui remsi remui".split()
FLOAT_BINARY = "addf subf mulf divf remf maxf minf maximumf minimumf".split()
CASTS = "extsi extui trunci sitofp uitofp fptosi fptoui extf truncf index_cast index_castui bitcast".split()
#: How operations are typed. Kinds are explained in uses_of() and defined().
RULES = (
    {f"arith.{o}": "same" for o in (*INT_BINARY, *FLOAT_BINARY, "negf")}
    | {f"arith.{o}": "cast" for o in CASTS}
    | {"arith.constant": "const", "arith.cmpi": "compare", "arith.cmpf": "compare", "arith.select": "select"}
    | {"memref.alloc": "const", "memref.alloca": "const", "memref.load": "load", "memref.store": "store", "memref.dealloc": "same", "memref.dim": "dim"}
    | {f"stablehlo.{o}": "same" for o in "add subtract multiply divide abs exponential".split()}
    | {f"stablehlo.{o}": "listed" for o in "transpose broadcast_in_dim reshape convert dot_general".split()}
)
_NAME = re.compile(r"%([A-Za-z0-9_$.]+)(?:#\d+)?")
_NOISE = re.compile(r'//[^\n]*|"[^"\n]*"')
_RESULTS = r"(%[\w$.]+(?:\s*:\s*\d+)?(?:\s*,\s*%[\w$.]+(?:\s*:\s*\d+)?)*)\s*=\s*"
_START = re.compile(_RESULTS + r"([a-z_][\w.]*)|\b((?:arith|memref|linalg|stablehlo|func|scf|math|cf|tensor|vector|affine)\.[a-z_]+|return|else|module)\b|(\})")
_FUNC = re.compile(r"func\.func\s+(?:private\s+|public\s+)?@[\w$.-]+\s*\((?P<params>[^)]*)\)")
_ATTRS = re.compile(r"\battributes\s*\{[^{}]*\}|\{\s*[A-Za-z_][\w.]*\s*=[^{}%]*\}")


def split_top(s: str) -> list[str]:
    """Pieces between commas outside of brackets."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(s):
        depth += (c in "(<[{") - (c in ")>]}" and s[i - 1 : i] != "-")
        if c == "," and depth == 0:
            out.append(s[last:i])
            last = i + 1
    out.append(s[last:])
    return [x.strip() for x in out if x.strip()]


def tight(t: str) -> str:
    return re.sub(r"\s+", "", t)


def element(memref: str) -> str | None:
    m = re.fullmatch(r"(?:memref|tensor|vector)<(?:[\d?]+x)*([a-z]+\d*)(?:,.*)?>", tight(memref))
    return m and m.group(1)


def after_colon(s: str) -> str | None:
    """What stands after the last colon outside of brackets."""
    depth = 0
    for i in range(len(s) - 1, -1, -1):
        depth += (s[i] in ")>]" and s[i - 1 : i] != "-") - (s[i] in "(<[")
        if s[i] == ":" and depth == 0:
            return s[i + 1 :].strip()
    return None


def clauses(s: str) -> list[tuple[str, str]]:
    """(name, type) of the operands in ins(..) and outs(..)."""
    out = []
    for inner in re.findall(r"\b(?:ins|outs)\s*\(((?:[^()]|\([^()]*\))*)\)", s):
        names, _, types = inner.partition(":")
        out += zip(_NAME.findall(names), split_top(types), strict=False)
    return out


def results_of(head: str) -> list[str]:
    """The types behind an arrow."""
    m = re.search(r"->\s*(?:\(([^)]*)\)|([^\s{(]+))", head)
    return split_top(m.group(1) if m.group(1) is not None else m.group(2)) if m else []


def typing(op: str, rest: str, n_results: int) -> tuple[list[tuple[str, str | None]], list[str | None], bool]:
    """What one operation asks and gives: its operands with the types they must have, the types of its results, and whether its
    operands agree among themselves. None is a type that agrees with all."""
    rule, type_, used = RULES.get(op), after_colon(rest), _NAME.findall(rest)
    if op.startswith("linalg."):
        pairs = clauses(rest)
        return pairs, [None], len({element(t) or tight(t) for _, t in pairs}) <= 1
    if rule == "const":
        return [], [type_], True
    if rule == "same":
        return [(n, type_) for n in used], [type_], True
    if rule == "compare":
        return [(n, type_) for n in used], ["i1"], True
    if rule == "select":
        return [(n, type_ if i else "i1") for i, n in enumerate(used)], [type_], True
    if rule == "cast":
        source, _, target = (type_ or "").partition(" to ")
        return [(n, source or None) for n in used], [target.strip() or None], True
    if rule in ("load", "dim"):
        return [(n, "index" if i else type_) for i, n in enumerate(used)], [element(type_ or "") if rule == "load" else "index"], True
    if rule == "store":
        return list(zip(used, [element(type_ or ""), type_, *["index"] * len(used)])), [type_], True
    if rule == "listed":
        m = re.search(r":\s*\(([^)]*)\)\s*->\s*(.+)$", rest, re.S)
        return list(zip(used, split_top(m.group(1)) if m else [None] * len(used))), [m.group(2).strip() if m else None], True
    return [], [None] * n_results, True


class Node(NamedTuple):
    """A statement; of a module, function, loop or branch with what stands in it. orelse is None where there is no else."""

    results: list[str]
    op: str
    rest: str
    body: list
    orelse: list | None


def tree(text: str) -> tuple[list[Node], list[str]]:
    """The statements as a tree of regions, and what is wrong with its form: closing braces too many, an else without an if, regions that
    stay open. An else without an if is a branch of its own."""
    top: list[Node] = []
    open_, wrong = [top], []
    for results, op, rest in pieces(text):
        here = open_[-1]
        if op == "}":
            if len(open_) == 1:
                wrong.append("}")
            else:
                open_.pop()
        elif op == "else":
            if here and here[-1].op == "scf.if" and here[-1].orelse is None:
                here[-1] = here[-1]._replace(orelse=[])
            else:
                wrong.append("else")
                here.append(Node([], "scf.if", "", [], []))
            open_.append(here[-1].orelse)
        else:
            here.append(Node(results, op, rest, [], None))
            if op in ("module", "scf.for", "scf.if") or (op == "func.func" and "{" in rest):
                open_.append(here[-1].body)
    return top, wrong + ["unclosed"] * (len(open_) > 1)


class Scopes:
    """Checks a tree against the names in scope. A scope is a map of names to types, in which those of the regions around are found too."""

    def __init__(self):
        self.bad: list[tuple[str, str, str]] = []

    def ask(self, uses, scope: ChainMap, line: str) -> None:
        for name, type_ in uses:
            if name not in scope:
                self.bad.append(("undef_use", name, line))
            elif scope[name] is not None and type_ and tight(scope[name]) != tight(type_):
                self.bad.append(("type_mismatch", name, line))

    def give(self, names: list[str], types: list, scope: ChainMap) -> None:
        scope.update(zip(names, [*types, *[None] * len(names)]))

    def unless(self, ok: bool, kind: str, what: str, line: str) -> None:
        if not ok:
            self.bad.append((kind, what, line))

    def region(self, nodes: list[Node], scope: ChainMap, gives: list[str] | None, line: str) -> None:
        """The statements of a region; gives are the types that its yields must have, None where nothing can be yielded."""
        for node in nodes:
            at = node.rest[:160]
            if node.op == "scf.yield":
                names, _, types = node.rest[len("scf.yield") :].partition(":")
                names, types = _NAME.findall(names), split_top(types)
                self.ask(zip(names, types), scope, at)
                fits = gives is not None and len(names) == len(types) and [*map(tight, types)] == [*map(tight, gives)]
                self.unless(fits, "yield_mismatch", "yield", at)
            else:
                self.statement(node, scope, at)
        self.unless(not gives or any(n.op == "scf.yield" for n in nodes), "yield_mismatch", "no yield", line)

    def statement(self, node: Node, scope: ChainMap, at: str) -> None:
        if node.op in ("module", "func.func"):
            m = _FUNC.search(node.rest)
            typed = [p.partition(":") for p in split_top(m.group("params"))] if m and node.op == "func.func" else []
            self.region(node.body, scope.new_child({n.strip().lstrip("%"): t.strip() for n, _, t in typed}), None, at)
        elif node.op == "scf.for":
            self.loop(node, scope, at)
        elif node.op == "scf.if":
            types = results_of(node.rest)
            self.ask([(n, "i1") for n in _NAME.findall(node.rest)[:1]], scope, at)
            self.unless(not node.results or len(node.results) == len(types), "yield_mismatch", "results", at)
            self.region(node.body, scope.new_child(), types, at) if node.rest else None
            if node.orelse is not None:
                self.region(node.orelse, scope.new_child(), types, at)
            self.unless(not types or node.orelse is not None, "yield_mismatch", "no else", at)
            self.give(node.results, types, scope)
        elif node.op in ("return", "func.return"):
            names, _, types = node.rest.partition(":")
            types = split_top(types)
            self.ask([(n, types[i] if i < len(types) else None) for i, n in enumerate(_NAME.findall(names))], scope, at)
        else:
            uses, makes, agree = typing(node.op, node.rest[len(node.op) :], len(node.results))
            self.ask(uses, scope, at)
            self.unless(agree, "type_mismatch", node.op, at)
            self.give(node.results, makes, scope)

    def loop(self, node: Node, scope: ChainMap, at: str) -> None:
        m = _FOR.match(node.rest)
        if not m:
            self.unless(False, "parse", "scf.for", at)
            self.region(node.body, scope.new_child(), [], at)
            return
        kind = (_COUNTER.search(m["head"]) or {"kind": "index"})["kind"]
        self.ask([(n, kind) for n in (m["low"], m["high"], m["step"])], scope, at)
        inits = re.search(r"iter_args\s*\(([^)]*)\)", m["head"])
        carried = [_NAME.findall(p) for p in split_top(inits.group(1))] if inits else []
        types = results_of(m["head"])
        self.unless((not inits or len(carried) == len(types)) and (not node.results or len(node.results) == len(types)), "yield_mismatch", "results", at)
        typed = list(zip(carried, [*types, *[None] * len(carried)]))
        self.ask([(names[1], t) for names, t in typed if len(names) > 1], scope, at)
        self.region(node.body, scope.new_child({m["counter"]: kind} | {names[0]: t for names, t in typed if names}), types, at)
        self.give(node.results, types, scope)


_FOR = re.compile(r"scf\.for\s+%(?P<counter>[\w$.]+)\s*=\s*%(?P<low>[\w$.]+)\s+to\s+%(?P<high>[\w$.]+)\s+step\s+%(?P<step>[\w$.]+)(?P<head>.*)", re.S)
#: The type of a loop's counter, if it is told: the last thing of the head.
_COUNTER = re.compile(r":\s*(?P<kind>i\d+|index)\s*\{?\s*$")


def pieces(text: str) -> list[tuple[list[str], str, str]]:
    """(results, operation or mark, the statement's text without its results)."""
    clean = _ATTRS.sub(" ", _NOISE.sub(lambda m: '""' if m.group()[0] == '"' else " ", text))
    marks = list(_START.finditer(clean))
    out = []
    for m, end in zip(marks, [*(x.start() for x in marks[1:]), len(clean)]):
        names = [x.split(":")[0].strip() for x in _NAME.findall(m.group(1) or "")]
        op = m.group(2) or m.group(3) or "}"
        out.append((names, op, clean[m.start(2) if m.group(2) else m.start() : end].strip(" \t\r\n;")))
    return out


def check(text: str) -> list[tuple[str, str, str]]:
    """Scope violations (kind, name, line). A text without a function passes."""
    if "func.func" not in text:
        return []
    top, wrong = tree(text)
    scopes = Scopes()
    scopes.region(top, ChainMap(), None, "")
    return scopes.bad + [("parse", w, "") for w in wrong]


_TYPE = r"(?:i\d+|index|b?f\d+|(?:memref|tensor|vector)<[^>]*>)"
_STATEMENT = re.compile(rf"""
    arith\.constant\s+(?:-?\d[\d.]*(?:e[+-]?\d+)?|true|false|dense<.*>)\s*(?::\s*{_TYPE})?
  | arith\.cmp[if]\s+[a-z]+\s*,\s*%[\w$.]+\s*,\s*%[\w$.]+\s*:\s*{_TYPE}
  | (?:arith|stablehlo|math)\.[a-z_]+\s+%[\w$.]+(?:\s*,\s*%[\w$.]+)*\s*:\s*{_TYPE}(?:\s+to\s+{_TYPE})?
  | stablehlo\.[a-z_]+\s+%[\w$.]+.*->\s*{_TYPE}
  | memref\.alloca?\s*\([^)]*\)\s*:\s*{_TYPE}
  | memref\.load\s+%[\w$.]+\s*\[[^\]]*\]\s*:\s*{_TYPE}
  | memref\.store\s+%[\w$.]+\s*,\s*%[\w$.]+\s*\[[^\]]*\]\s*:\s*{_TYPE}
  | memref\.(?:dealloc|dim)\s+%[\w$.]+(?:\s*,\s*%[\w$.]+)?\s*:\s*{_TYPE}
  | memref\.global\s+.*
  | linalg\.[a-z_]+\s+ins\s*\([^)]*\)\s*outs\s*\([^)]*\)
  | (?:func\.)?return(?:\s+%[\w$.]+(?:\s*,\s*%[\w$.]+)*\s*:\s*{_TYPE}(?:\s*,\s*{_TYPE})*)?
  | scf\.(?:for|if|yield)\b.*
""", re.X | re.S)


def parses(text: str) -> bool:
    """Whether the text is one well-formed program of the subset: balanced, every statement of a known form, functions returning."""
    clean = _NOISE.sub(lambda m: '""' if m.group()[0] == '"' else " ", text)
    if not re.match(r"\s*(?:module\b|func\.func\b)", clean) or clean.count("{") != clean.count("}"):
        return False
    returned = True
    for _, op, rest in pieces(text):
        if op in ("}", "else", "module"):
            if rest.lstrip("}").strip() not in ("", ";") and op == "}":
                return False
            continue
        if op == "func.func":
            if not re.fullmatch(rf"func\.func\s+(?:private\s+|public\s+)?@[\w$.-]+\s*\((?:\s*%[\w$.]+\s*:\s*{_TYPE}\s*,?)*\s*\)\s*(?:->\s*\(?\s*{_TYPE}(?:\s*,\s*{_TYPE})*\s*\)?)?\s*\{{?", rest):
                return False
            returned = False
            continue
        returned = returned or op in ("return", "func.return")
        if not _STATEMENT.fullmatch(rest.rstrip(" ;\n\t{")):
            return False
    return returned


def type_domains(text: str) -> list[tuple[str, str, str]]:
    """Statements whose operation is of one domain (integers, floats) and whose type is of another."""
    out = []
    for _, op, rest in pieces(text):
        name = op.partition(".")[2]
        t = tight(after_colon(rest) or "")
        if op.startswith("arith.") and (name in INT_BINARY and re.fullmatch(r"b?f\d+", t) or name in FLOAT_BINARY and re.fullmatch(r"i\d+|index", t)):
            out.append(("type_domain", op, rest[:160]))
    return out


def use_sites(text: str) -> list[tuple[int, str, int]]:
    """(statement, name, defined): each use with whether the name is defined before it; the sites a probe is asked about."""
    known, out = set(), []
    for i, (results, op, rest) in enumerate(pieces(text)):
        if op == "func.func":
            known = set(_NAME.findall(rest))
        else:
            out += [(i, n, int(n in known)) for n in _NAME.findall(rest)]
        known |= set(results)
    return out
