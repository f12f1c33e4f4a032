"""Linear probes with grouped cross-validation, and array features."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import let
from corvane.operators.split import folds


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.05, l2: float = 0.01) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model by full-batch Adam."""
    w, b = np.zeros(x.shape[1]), 0.0
    m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = np.append(x.T @ (p - y) / len(y) + l2 * w, (p - y).mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def cross_validated(rows: DataFrame, cells: list[str], group: str, features: str, label: str, k: int = 5, seed: int = 0) -> DataFrame:
    """cells, fold, n, accuracy and control (the same with shuffled labels): one model per cell and fold, one task each.

    Features are standardised on the training folds. A cell's rows must fit one task; cells are layers or designs of a probe."""
    split = folds(rows, group, k, seed)
    each = split.withColumn("_test", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(group)
        x, y, test = np.array(t[features].tolist(), float), t[label].to_numpy(float), (t["fold"] == t["_test"]).to_numpy()
        if not test.any() or test.all():
            return pd.DataFrame([], columns=[*cells, "fold", "n", "accuracy", "control"])
        mean, std = x[~test].mean(0), x[~test].std(0)
        x = (x - mean) / np.where(std > 0, std, 1)
        mixed = np.random.default_rng(seed).permutation(y)
        score = lambda z: float((((x[test] @ (f := fit_logistic(x[~test], z[~test]))[0] + f[1]) > 0) == (z[test] > 0.5)).mean())
        return pd.DataFrame([{**{c: t[c].iloc[0] for c in cells}, "fold": int(t["_test"].iloc[0]), "n": int(test.sum()), "accuracy": score(y), "control": score(mixed)}])

    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema if f.name in cells)
    return each.groupBy(*cells, "_test").applyInPandas(run, f"{fields}fold int, n int, accuracy double, control double")


def hashed_bag(ids: Column, buckets: int = 2048) -> Column:
    """array(bucket, log1p(count)) of token ids modulo buckets, by bucket; a sparse vector."""
    of = lambda b: F.transform(F.array_sort(F.array_distinct(b)), lambda x: F.struct(x.alias("bucket"), F.log1p(F.size(F.filter(b, lambda y: y == x)).cast("double")).alias("weight")))
    return let(F.transform(ids, lambda i: F.pmod(i, F.lit(buckets))), of)


def window_features(ids: Column, width: int = 4, buckets: int = 512) -> Column:
    """The buckets of the last width ids, each place with its own range."""
    last = F.slice(ids, F.greatest(F.lit(1), F.size(ids) - width + 1), width)
    return F.transform(last, lambda x, i: i * buckets + F.pmod(x, F.lit(buckets)))


def allowed(mask: Column, bit: Column) -> Column:
    """Whether a bit is set in a packed array of 32-bit words."""
    word = F.get(mask, F.floor(bit / 32).cast("int"))
    return F.coalesce(F.getbit(word.cast("long"), (bit % 32).cast("int")) == 1, F.lit(False))


def packed(bits: Column, words: int) -> Column:
    """An array of bit numbers as an array of 32-bit words."""
    one = lambda w: F.aggregate(F.filter(bits, lambda b: F.floor(b / 32) == w), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(F.expr("1L") * F.pow(F.lit(2), b % 32).cast("long")))
    return F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda w: one(w).cast("long"))


def legal_mass(logits: Column, mask: Column) -> Column:
    """The share of softmax mass on the allowed ids."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    kept = F.aggregate(F.zip_with(logits, F.sequence(F.lit(0), F.size(logits) - 1), lambda x, i: F.when(allowed(mask, i), F.exp(x - top)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    return kept / total


def entropy_bits(p: Column) -> Column:
    """Entropy in bits of an array of probabilities; zeros count as none."""
    return -F.aggregate(p, F.lit(0.0), lambda s, x: s + F.when(x > 0, x * F.log2(x)).otherwise(0.0))


def recovery(clean: Column, corrupt: Column, patched: Column, gap: float = 0.1) -> Column:
    """(patched - corrupt) / (clean - corrupt) where the clean run leads by more than gap; null elsewhere."""
    return F.when(clean - corrupt > gap, (patched - corrupt) / (clean - corrupt))


def differences(vectors: DataFrame, pairs: DataFrame, key: str, vec: str) -> DataFrame:
    """The difference of two rows' vectors for each pair (a, b) of keys."""
    v = lambda n: vectors.select(F.col(key).alias(n), F.col(vec).alias("_" + n))
    return pairs.join(v("a"), "a").join(v("b"), "b").select(*pairs.columns, F.zip_with("_a", "_b", lambda x, y: x - y).alias("diff"))


def best_layer(accuracies: DataFrame, keys: list[str], layer: str = "layer", acc: str = "acc") -> DataFrame:
    """(keys, layer, acc) -> keys, best, best_acc, first_acc, last_acc: the layer of the highest accuracy (the lowest of equals), and the
    accuracies of the first and the last layer."""
    best = F.max_by(F.struct(layer, acc), F.struct(F.col(acc), -F.col(layer))).alias("b")
    return accuracies.groupBy(*keys).agg(best, F.min_by(acc, layer).alias("first_acc"), F.max_by(acc, layer).alias("last_acc")).select(*keys, F.col(f"b.{layer}").alias("best"), F.col(f"b.{acc}").alias("best_acc"), "first_acc", "last_acc")
