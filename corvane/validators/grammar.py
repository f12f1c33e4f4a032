"""Grammars of the generated languages: what a constrained generator may write, as tables of statement forms.

A language is a table of forms. Forms may name each other as <name>; <block> stands for a nested block. rendered() writes a language out
with its bounds, since a generator needs finite chains: at most CHAIN statements in a block, blocks DEPTH deep. recogniser() compiles
the same text. The c1 languages tell form only; the c1_c2 languages also tie operations to the domain of their types."""

from __future__ import annotations

import re
from functools import lru_cache

from corvane.validators.mlir import FLOAT_BINARY, INT_BINARY

CHAIN, DEPTH = 128, 2
_INT, _FLOAT = r"(?:i(?:64|32|16|8|1)\b|index)", r"(?:bf16|f16|f32|f64)"
_COMMON = {
    "value": r"%[A-Za-z0-9_$.]+(?:#\d+)?", "int": r"-?\d+", "float": r"-?\d+(?:\.\d*)?(?:[eE][+-]?\d+)?", "symbol": r"@[A-Za-z0-9_$.-]+",
    "dims": r"(?:(?:\?|\d+)x)*+", "scalar": f"(?:{_INT}|{_FLOAT})", "memref": r"memref< <dims><scalar> >", "tensor": r"tensor< <dims><scalar> >",
    "type": r"(?:<memref>|<tensor>|<scalar>)", "values": r"<value>(?: , <value>)*+", "types": r"<type>(?: , <type>)*+", "set": r"<value> =",
    "attributes": r"(?: attributes \{[^{}]*+\})?", "params": r"(?:<value> : <type>(?: , <value> : <type>)*+)?", "result": r"(?: -> (?:<type>|\( <types> \)))?",
    "return": r"(?:func\.)?return(?: <values> : <types>)?", "function": r"func\.func (?:private |public )?<symbol> \( <params> \)<result><attributes> \{ <block> <return> \}",
    "program": r"(?:module<attributes> \{ (?:<function> )++\}|<function>)",
}
_MEMORY = {
    "alloc": r"<set> memref\.alloca? \( (?:<values>)? \) : <memref>", "load": r"<set> memref\.load <value> \[ (?:<values>)? \] : <memref>", "store": r"memref\.store <value> , <value> \[ (?:<values>)? \] : <memref>",
    "free": r"memref\.dealloc <value> : <memref>", "dim": r"<set> memref\.dim <value> , <value> : <memref>", "linalg": r"linalg\.[a-z_]+ ins \( <values> : <types> \) outs \( <values> : <types> \)",
}
_FORM = {
    "constant": r"<set> arith\.constant (?:true|false|(?:<float>|dense<[^>]*+>) : <type>)", "binary": rf"<set> arith\.(?:{'|'.join([*INT_BINARY, *FLOAT_BINARY])}) <value> , <value> : <type>",
    "negate": r"<set> arith\.negf <value> : <type>", "compare": r"<set> arith\.cmp[if] [a-z]+ , <value> , <value> : <type>", "select": r"<set> arith\.select <value> , <value> , <value> : <type>", "cast": r"<set> arith\.[a-z_]+ <value> : <type> to <type>",
}
_DOMAIN = _FORM | {
    "constant": rf"<set> arith\.constant (?:true|false|<int> : {_INT}|-?\d+\.\d*(?:[eE][+-]?\d+)? : {_FLOAT}|dense<[^>]*+> : <type>)",
    "binary": rf"<set> (?:arith\.(?:{'|'.join(INT_BINARY)}) <value> , <value> : {_INT}|arith\.(?:{'|'.join(FLOAT_BINARY)}) <value> , <value> : {_FLOAT})",
    "negate": rf"<set> arith\.negf <value> : {_FLOAT}", "compare": rf"<set> (?:arith\.cmpi (?:eq|ne|[su][lg][te]) , <value> , <value> : {_INT}|arith\.cmpf [ou](?:eq|ne|[lg][te]) , <value> , <value> : {_FLOAT})",
    "cast": rf"<set> arith\.(?:(?:ext[su]i|trunci|index_castu?i?) <value> : {_INT} to {_INT}|(?:extf|truncf) <value> : {_FLOAT} to {_FLOAT}|[su]itofp <value> : {_INT} to {_FLOAT}|fpto[su]i <value> : {_FLOAT} to {_INT}|bitcast <value> : <scalar> to <scalar>)",
}
_REGIONS = {
    "yield": r"scf\.yield(?: <values> : <types>)?", "for": r"(?:<values> = )?scf\.for <value> = <value> to <value> step <value>(?: iter_args \( <value> = <value>(?: , <value> = <value>)*+ \) -> \( <types> \))?(?: : <scalar>)? \{ <block> (?:<yield> )?\}",
    "if": r"(?:<values> = )?scf\.if <value>(?: -> \( <types> \))? \{ <block> (?:<yield> )?\}(?: else \{ <block> (?:<yield> )?\})?",
}
_STABLEHLO = {
    "constant": r"<set> stablehlo\.constant dense<[^>]*+> : <tensor>", "unary": r"<set> stablehlo\.(?:abs|negate|exponential|log|sqrt|tanh) <value> : <tensor>",
    "binary": r"<set> stablehlo\.(?:add|subtract|multiply|divide|maximum|minimum) <value> , <value> : <tensor>", "shaped": r"<set> stablehlo\.(?:reshape|convert|transpose|broadcast_in_dim|dot_general) <values>(?: , [a-z_]+ = [^:]*+)* : \( <types> \) -> <tensor>",
}
_LL = r"(?:i\d+|float|double|half|ptr)"
_LLVM = {
    "value": r"%[\w.$-]+", "operand": r"(?:<value>|-?\d+(?:\.\d+(?:e[+-]?\d+)?)?|true|false)", "set": r"<value> =",
    "binary": rf"<set> (?:add|sub|mul|[su]div|[su]rem|and|or|xor|shl|[la]shr|f(?:add|sub|mul|div|rem))(?: (?:nsw|nuw|exact|fast))*+ {_LL} <operand> , <operand>",
    "compare": rf"<set> [if]cmp [a-z]+ {_LL} <operand> , <operand>", "select": rf"<set> select i1 <operand> , {_LL} <operand> , {_LL} <operand>", "cast": rf"<set> (?:[sz]ext|trunc|fpext|fptrunc|[su]itofp|fpto[su]i|bitcast) {_LL} <operand> to {_LL}",
    "phi": rf"<set> phi {_LL} \[ <operand> , <value> \](?: , \[ <operand> , <value> \])*+", "jump": r"br (?:label <value>|i1 <operand> , label <value> , label <value>)", "ret": rf"ret (?:void|{_LL} <operand>)", "label": r"[\w.$-]+:",
    "program": rf"(?:define (?:void|{_LL}) @[\w.$-]+ \( (?:{_LL} <value>(?: , {_LL} <value>)*+)? \) \{{ <block> \}} )++",
}
_LLVM_DOMAIN = {
    "binary": r"<set> (?:(?:add|sub|mul|[su]div|[su]rem|and|or|xor|shl|[la]shr)(?: (?:nsw|nuw|exact))*+ i\d+ <operand> , <operand>|f(?:add|sub|mul|div|rem)(?: fast)? (?:float|double|half) <operand> , <operand>)",
    "compare": r"<set> (?:icmp (?:eq|ne|[su][lg][te]) (?:i\d+|ptr) <operand> , <operand>|fcmp [a-z]+ (?:float|double|half) <operand> , <operand>)",
}
_SYNTH_TYPE = r"[1-9]\d?(?:x[1-9]\d?)?\]"
_SYNTH = {
    "value": r"%[a-z][a-z0-9]{0,7}", "set": r"<value> =", "nested": r"\{ <block> \}", "program": rf"prog \{{ <block> ret <value> : (?:int|flt)\[{_SYNTH_TYPE} \}}",
    "constant": rf"<set> const (?:-?\d{{1,4}} : int\[{_SYNTH_TYPE}|-?\d{{1,4}}\.\d{{1,3}} : flt\[{_SYNTH_TYPE})", "binary": rf"<set> (?:(?:add|sub|mul)i <value> , <value> : int\[{_SYNTH_TYPE}|(?:add|sub|mul)f <value> , <value> : flt\[{_SYNTH_TYPE})",
}
#: Each language: its forms and which of them are statements.
LANGUAGES: dict[str, tuple[dict[str, str], tuple[str, ...]]] = {
    "mlir_c1": (_COMMON | _FORM | _MEMORY, (*_FORM, *_MEMORY)),
    "mlir_c1_c2": (_COMMON | _DOMAIN | _MEMORY, (*_DOMAIN, *_MEMORY)),
    "scf_c1": (_COMMON | _FORM | _MEMORY | _REGIONS, (*_FORM, *_MEMORY, "for", "if")),
    "scf_c1_c2": (_COMMON | _DOMAIN | _MEMORY | _REGIONS, (*_DOMAIN, *_MEMORY, "for", "if")),
    "stablehlo": (_COMMON | _STABLEHLO, tuple(_STABLEHLO)),
    "llvm_c1": (_LLVM, ("binary", "compare", "select", "cast", "phi", "jump", "ret", "label")),
    "llvm_c1_c2": (_LLVM | _LLVM_DOMAIN, ("binary", "compare", "select", "cast", "phi", "jump", "ret", "label")),
    "synth": (_SYNTH, ("constant", "binary", "nested")),
}
_NAMED = re.compile(r"<([a-z]+)>")


def rendered(language: str, depth: int = DEPTH, chain: int = CHAIN) -> dict[str, str]:
    """The language written out: rule by rule, block_0 (no nested block) to block_depth, each a chain of statements."""
    forms, statements = LANGUAGES[language]
    nests = {s for s in statements if "<block>" in forms[s]}
    out = {name: form for name, form in forms.items() if "<block>" not in form}
    for d in range(depth + 1):
        inner = {s: forms[s].replace("<block>", f"<block_{d - 1}>") for s in nests} if d else {}
        out |= {f"{s}_{d}": form for s, form in inner.items()}
        every = [f"<{s}_{d}>" if s in nests else f"<{s}>" for s in statements if s not in nests or d]
        out[f"block_{d}"] = f"(?:(?>{'|'.join(every)}) ){{0,{chain}}}+"
    for s in forms:
        if "<block>" in forms[s] and s not in nests:
            out[s] = forms[s].replace("<block>", f"<block_{depth}>")
    return out


@lru_cache(maxsize=None)
def recogniser(language: str, depth: int = DEPTH, chain: int = CHAIN) -> re.Pattern:
    """The rendered language as one pattern. A blank in a form is any space, or none where no two words meet."""
    rules = rendered(language, depth, chain)
    named = re.compile(r"<([a-z]+(?:_\d+)?)>")

    def full(form: str) -> str:
        return named.sub(lambda m: f"(?:{full(rules[m.group(1)])})" if m.group(1) in rules else m.group(), form)

    blank = r"(?:\s++|(?<!\w)|(?!\w))"
    return re.compile(full("<program>").replace(" ", blank))


_COMMENT = {"llvm": re.compile(r";[^\n]*"), "synth": re.compile(r"(?!)")}


def parses(text: str, language: str) -> bool:
    clean = _COMMENT.get(language.split("_")[0], re.compile(r"//[^\n]*")).sub("", text).strip()
    return recogniser(language).fullmatch(clean) is not None
