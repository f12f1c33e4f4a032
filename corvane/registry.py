"""Plug-ins by name: target languages, tasks and runners. New ones register themselves; an unknown name tells the known ones."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.validators import external, grammar, llvm, mlir, synth


class Registry(dict):
    """Names to plug-ins. Each name once."""

    def __init__(self, what: str):
        super().__init__()
        self.what = what

    def register(self, name: str, plugin: Any) -> Any:
        if name in self:
            raise ValueError(f"{self.what} {name!r} is there already")
        self[name] = plugin
        return plugin

    def __missing__(self, name: str):
        raise KeyError(f"no {self.what} {name!r}; known: {', '.join(sorted(self))}")


class Target(NamedTuple):
    """A language: whether a text parses, its violations, the column of operations, the score of a signature and the categories of messages."""

    parses: Callable[[str], bool]
    check: Callable[[str], list]
    operations: Callable[[Column], Column]
    signature: Callable[[Column, Column], Column]
    category: Callable[[Column], Column]


class Task(NamedTuple):
    """What is asked of a model: the prompt of an instruction, and the reward from a row's flags (parsed, in scope, verified), signature
    score, operations' similarity and match."""

    target: str
    prompt: Callable[[Column], Column]
    reward: Callable[..., Column]


def reward(parsed: Column, scoped: Column, verified: Column, signature: Column, similar: Column, match: Column, kind: str = "task") -> Column:
    """verify: 1 for a verified text; task: times signature and operations; functional: plus 1 for a match of a verified text. With _noc3
    the scope validator isn't in the gate. Null flags are false."""
    name, _, without = kind.partition("_")
    if name not in ("verify", "task", "functional") or without not in ("", "noc3"):
        raise ValueError(f"no kind of reward {kind!r}")
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    gate = yes(parsed) * yes(verified) * (F.lit(1.0) if without else yes(scoped))
    if name == "verify":
        return gate
    return gate * signature * similar + (gate * yes(match) if name == "functional" else F.lit(0.0))


TARGETS, TASKS, RUNNERS = Registry("target"), Registry("task"), Registry("runner")
for _name, _language in (("mlir", "mlir_c1_c2"), ("scf", "scf_c1_c2"), ("stablehlo", "stablehlo")):
    TARGETS.register(_name, Target(lambda t, g=_language: grammar.parses(t, g), mlir.check, T.body_ops, T.signature_score, T.error_category))
    TASKS.register(_name, Task(_name, T.chat_prompt, reward))
TARGETS.register("llvm", Target(lambda t: grammar.parses(t, "llvm_c1_c2"), llvm.check, T.llvm_opcodes, T.llvm_signature_score, T.llvm_category))
TASKS.register("llvm", Task("llvm", lambda nl: T.chat_prompt(F.regexp_replace(nl, r"\bMLIR\b", "LLVM IR")), reward))
TARGETS.register("synth", Target(lambda t: grammar.parses(t, "synth"), synth.check, lambda s: F.filter(F.regexp_extract_all(s, F.lit(r"=\s*([a-z]+)"), F.lit(1)), lambda o: o != "const"), T.signature_score, T.error_category))
TASKS.register("synth", Task("synth", T.chat_prompt, reward))


def from_table(rows: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    """A runner whose outputs are known: rows with returncode, stdout and stderr from a table; a row that isn't there has code -2."""
    got = rows.join(outputs.select(*keys, "returncode", "stdout", "stderr"), keys, "left")
    return got.withColumn("returncode", F.coalesce("returncode", F.lit(-2)))


RUNNERS.register("table", from_table)
RUNNERS.register("command", external.run_command)
