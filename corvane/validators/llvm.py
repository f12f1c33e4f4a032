"""LLVM IR functions: scope by dominance. Instructions are read into flat facts, which are checked kind by kind. Dominators are found on immediate-dominator chains in reverse postorder."""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

_VALUE, _LABEL = re.compile(r"%([\w.$-]+)"), re.compile(r"label\s+%([\w.$-]+)")
_DEFINE = re.compile(r"define\b[^@]*@[\w.$-]+\s*\(([^)]*)\)[^{]*\{(.*?)^\s*\}", re.S | re.M)
_BEGIN = re.compile(r"\s*(?:%[\w.$-]+\s*=|[\w.$-]+:|(?:ret|br|store|call|unreachable|switch)\b|\})")
_PHI = re.compile(r"\[\s*([^,\]]+?)\s*,\s*%([\w.$-]+)\s*\]")


def blocks_of(body: str) -> list[tuple[str, list[tuple[str | None, str, str]]]]:
    """(label, instructions (result, operation, text)) in order; lines that don't begin an instruction belong to the one before."""
    lines: list[str] = []
    for raw in body.splitlines():
        line = raw.partition(";")[0].strip()
        if line and lines and not _BEGIN.match(line):
            lines[-1] += " " + line
        elif line:
            lines.append(line)
    out: list[tuple[str, list]] = []
    for line in lines:
        m = re.match(r"([\w.$-]+):\s*", line)
        if m:
            out.append((m.group(1), []))
            line = line[m.end() :]
            if not line:
                continue
        if not out:
            out.append(("entry", []))
        m = re.match(r"%([\w.$-]+)\s*=\s*", line)
        rest = line[m.end() :] if m else line
        out[-1][1].append((m and m.group(1), rest.split(None, 1)[0], rest))
    return out


def dominators(succ: dict[str, list[str]], entry: str) -> dict[str, set[str]]:
    """The dominators of each block that can be reached."""
    post, seen = [], set()
    stack = [(entry, iter(succ[entry]))]
    seen.add(entry)
    while stack:
        b, it = stack[-1]
        nxt = next((s for s in it if s in succ and s not in seen), None)
        if nxt is None:
            post.append(b)
            stack.pop()
        else:
            seen.add(nxt)
            stack.append((nxt, iter(succ[nxt])))
    rank = {b: i for i, b in enumerate(post)}
    preds = {b: [p for p in post if b in succ[p]] for b in post}
    idom = {entry: entry}
    changed = True
    while changed:
        changed = False
        for b in reversed(post[:-1]):
            new = None
            for p in preds[b]:
                if p in idom:
                    q = p
                    while new is not None and q != new:
                        if rank[q] < rank[new]:
                            q = idom[q]
                        else:
                            new = idom[new]
                    new = q
            if idom.get(b) != new:
                idom[b], changed = new, True
    out = {}
    for b in post:
        chain = {b}
        x = b
        while x != entry:
            x = idom[x]
            chain.add(x)
        out[b] = chain
    return out


class Fact(NamedTuple):
    """One thing that an instruction says: it defines a value, uses one, jumps to a label, or is a phi with an arm from a block."""

    kind: str  # def, use, jump, phi, arm
    name: str
    block: str
    at: int
    text: str
    source: str = ""  # the block that an arm comes from


def facts(blocks) -> list[Fact]:
    out = []
    for block, instructions in blocks:
        for at, (result, op, text) in enumerate(instructions):
            if result is not None:
                out.append(Fact("def", result, block, at, text))
            labels = _LABEL.findall(text)
            out += [Fact("jump" if op in ("br", "switch") else "label", x, block, at, text) for x in labels]
            if op == "phi":
                out.append(Fact("phi", "", block, at, text))
                out += [Fact("arm", v, block, at, text, source) for v, source in _PHI.findall(text)]
            else:
                out += [Fact("use", v, block, at, text) for v in _VALUE.findall(_LABEL.sub(" ", text))]
    return out


def _redefined(said: list[Fact], params: set[str]):
    counts = Counter(params)
    for f in said:
        if f.kind == "def":
            counts[f.name] += 1
            if counts[f.name] > 1:
                yield "redefinition", f.name, f.text


def _phis(said: list[Fact], blocks, dom: dict[str, set[str]]):
    """Phis behind other instructions, and phis whose arms aren't the edges into their block."""
    edges = Counter((f.name, f.block) for f in said if f.kind == "jump")
    arms: dict[tuple, Counter] = {}
    for f in said:
        if f.kind == "arm":
            arms.setdefault((f.block, f.at), Counter())[f.source] += 1
    begin = {block: next((i for i, x in enumerate(ins) if x[1] != "phi"), len(ins)) for block, ins in blocks}
    into: dict[str, Counter] = {}
    for (target, source), n in edges.items():
        into.setdefault(target, Counter())[source] = n
    for f in said:
        if f.kind == "phi":
            if f.at > begin[f.block]:
                yield "bad_phi", "", f.text
            if f.block in dom and arms.get((f.block, f.at), Counter()) != into.get(f.block, Counter()):
                yield "bad_phi", "", f.text


def _uses(said: list[Fact], params: set[str], dom: dict[str, set[str]]):
    """Values that aren't defined, not yet, or not on every way to their use. An arm is a use at the end of the block it comes from."""
    place = {f.name: (f.block, f.at) for f in said if f.kind == "def"}
    for f in said:
        if f.kind not in ("use", "arm") or (f.kind == "arm" and f.name[:1] != "%"):
            continue
        name = f.name.removeprefix("%") if f.kind == "arm" else f.name
        if name in params:
            continue
        if name not in place:
            yield "undef_use", name, f.text
            continue
        block, at = place[name]
        if f.kind == "arm":
            if f.block in dom and f.source in dom and block not in dom[f.source]:
                yield "bad_phi", name, f.text
        elif block == f.block:
            if at >= f.at:
                yield "use_before_def", name, f.text
        elif f.block in dom and block not in dom[f.block]:
            yield "not_dominated", name, f.text


def check(text: str) -> list[tuple[str, str, str]]:
    """Violations (kind, name, line) over all functions."""
    bad: list[tuple[str, str, str]] = []
    for heads, body in _DEFINE.findall(text):
        params, blocks = set(_VALUE.findall(heads)), blocks_of(body)
        if not blocks:
            continue
        said, labels = facts(blocks), {b for b, _ in blocks}
        succ: dict[str, list[str]] = {b: [] for b, _ in blocks}
        for f in said:
            if f.kind == "jump":
                succ[f.block].append(f.name)
        dom = dominators(succ, blocks[0][0])
        bad += _redefined(said, params)
        bad += [("undef_label", f.name, f.text) for f in said if f.kind in ("jump", "label") and f.name not in labels]
        bad += _phis(said, blocks, dom)
        bad += _uses(said, params, dom)
    return bad
