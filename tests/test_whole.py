"""Queries do the whole job: fixtures on which a cut would show."""

import math
import os
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest

from corvane import store
from corvane.operators import decontam, stats
from corvane.plans import evaluation, registry


def test_token_curve_runs_to_the_longest_row(spark, tmp_path):
    rows = [(1, list(range(70))), (2, [10] * 100), (3, []), (4, None)]
    spark.createDataFrame(rows, "gen_id long, tokens array<int>").write.parquet(f"{tmp_path}/gen_out.parquet")
    got = {r["pos"]: (r["n"], r["mean"]) for r in registry.queries()["token_curve"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(100))
    assert got[63] == (2, 36.5) and got[64] == (2, 37.0) and got[69] == (2, 39.5) and got[70] == (1, 10.0) and got[99] == (1, 10.0)


def test_legal_tokens_counts_past_the_64th(spark, tmp_path):
    rows = [(1, [3] * 64 + [1, 6, 256 + 9]), (2, [1] * 64 + [0] * 40), (3, [0, 1]), (4, [])]
    spark.createDataFrame(rows, "gen_id long, tokens array<int>").write.parquet(f"{tmp_path}/gen_out.parquet")
    got = {r["gen_id"]: r["n_legal"] for r in registry.queries()["legal_tokens"](spark, str(tmp_path)).collect()}
    assert got == {1: 66, 2: 40, 3: 1, 4: 0}


def test_bootstraps_take_the_full_number_of_resamples():
    assert (evaluation.RESAMPLES, evaluation.SIZE_RESAMPLES) == (10_000, 2000)


def brute(n, p, u):
    """Inversion over all places, by exact sums."""
    weights, total, out = [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)], 0.0, []
    sums = [total := total + w for w in weights]
    for x in u:
        out.append(next((k for k, c in enumerate(sums) if c >= x), n))
    return np.array(out)


def test_binomial_draws_by_inversion():
    u = stats.uniforms(500, "t")
    assert 0 <= u.min() < 0.02 and 0.98 < u.max() < 1 and len(set(u)) == 500
    for n, p in ((1, 0.5), (7, 1 / 7), (60, 0.2), (60, 59 / 60), (300, 0.01)):
        assert (stats.binomials(n, p, u) == brute(n, p, u)).all()
    assert set(stats.binomials(9, 0.0, u)) == {0} and set(stats.binomials(9, 1.0, u)) == {9} and set(stats.binomials(0, 0.5, u)) == {0}
    big = stats.binomials(10**12, 0.3, u)  # as many places as the root of n
    assert abs(big.mean() / 10**12 - 0.3) < 1e-6 and abs(big.std() / (10**12 * 0.21) ** 0.5 - 1) < 0.1


def test_rate_and_rank_intervals_are_those_of_10_000_draws(spark, monkeypatch):
    rows = spark.createDataFrame([("m", "s", f"{i:03}", i % 3 == 0) for i in range(50)], "method string, constraint_stack string, row_id string, verify_valid boolean")
    monkeypatch.setattr(evaluation, "cells", lambda spark, d, *keep: rows)
    means = brute(50, 17 / 50, stats.uniforms(10_000, "rate")) / 50
    low, high = np.quantile(means, [0.025, 0.975])
    r = registry.queries()["rate_intervals"](spark, "").first()
    assert (r.n, r.ci_low, r.ci_high) == (50, round(low, 6), round(high, 6))
    # The bootstrap of the rows themselves has the same distribution.
    x = np.array([float(i % 3 == 0) for i in range(50)])
    rowwise = np.random.default_rng(0).choice(x, size=(10_000, 50), replace=True).mean(axis=1)
    assert np.abs(np.quantile(rowwise, [0.025, 0.975]) - [low, high]).max() <= 0.02
    r = registry.queries()["rank_intervals"](spark, "").first()
    assert (r.ci_low, r.ci_high) == tuple(np.round(np.sort(means)[[250, 9750]], 6))
    r = registry.queries()["numpy_intervals"](spark, "").first()
    assert (r.n, round(r.ci_low, 6), round(r.ci_high, 6)) == (50, *np.round(np.quantile(rowwise, [0.025, 0.975]), 6))


def test_paired_intervals_are_those_of_10_000_draws(spark, monkeypatch):
    pairs = [("m", "p", i, "v1", int(i % 4 == 0), int(i % 5 == 0), 1) for i in range(60)]
    made = spark.createDataFrame(pairs, "model string, pool string, prompt_id long, layer string, a int, b int, free_parses int")
    monkeypatch.setattr(evaluation, "cells", lambda spark, d, *keep: made)
    monkeypatch.setattr(evaluation, "flagged", lambda spark, d: made)
    monkeypatch.setattr(evaluation.ladder, "residual_pairs", lambda t: t)
    monkeypatch.setattr(evaluation.ladder, "rung_pairs", lambda t: t.withColumnRenamed("layer", "rung"))
    up, down = sum(p[4] > p[5] for p in pairs), sum(p[4] < p[5] for p in pairs)
    differ, v = brute(60, (up + down) / 60, stats.uniforms(10_000, "differ")), stats.uniforms(10_000, "up")
    rise = np.array([brute(m, up / (up + down), [x])[0] for m, x in zip(differ, v)])
    means = (2 * rise - differ) / 60
    low, high = np.round(np.quantile(means, [0.025, 0.975]), 6)
    r = registry.queries()["delta_intervals"](spark, "").first()
    assert (r.n, r.ci_low, r.ci_high, r.p_value) == (60, low, high, round((means <= 0).mean(), 6))
    r = registry.queries()["internalized_gate"](spark, "").first()
    assert (r.model, r.pool, r.n, r.free_rate, r.ci_low, r.ci_high) == ("m", "p", 60, 0.25, low, high)
    a, b = np.array([p[4] for p in pairs], float), np.array([p[5] for p in pairs], float)
    i = np.random.default_rng(0).integers(0, 60, size=(10_000, 60))
    rowwise = a[i].mean(axis=1) - b[i].mean(axis=1)
    assert np.abs(np.quantile(rowwise, [0.025, 0.975]) - [low, high]).max() <= 0.02


def test_intervals_of_no_rows(spark):
    rows = spark.createDataFrame([("a", 0, 0), ("b", 4, 4), ("c", 4, 0)], "k string, n long, s long")
    got = {r.k: (r.ci_low, r.ci_high) for r in stats.count_interval(rows).collect()}
    assert got == {"a": (None, None), "b": (1.0, 1.0), "c": (0.0, 0.0)}
    pairs = spark.createDataFrame([("a", 0, 0, 0), ("b", 4, 4, 0), ("c", 4, 0, 0)], "k string, n long, up long, down long")
    got = {r.k: (r.ci_low, r.ci_high, r.p_value) for r in stats.pair_count_interval(pairs).collect()}
    assert got == {"a": (None, None, None), "b": (1.0, 1.0, 0.0), "c": (0.0, 0.0, 1.0)}


def test_blocks_of_draws_are_one_stream(spark):
    n = 2011  # blocks of 2085 rows, an odd number of draws, and over 2**22 draws: the generator is left amid a word between blocks
    rows = spark.createDataFrame([("g", i, int(i % 7 == 0)) for i in range(n)], "k string, id long, x int")
    r = stats.numpy_interval(rows, ["k"], "id", "x", None, 3000).first()
    x = np.array([float(i % 7 == 0) for i in range(n)])
    assert (r.ci_low, r.ci_high) == tuple(np.quantile(np.random.default_rng(0).choice(x, size=(3000, n), replace=True).mean(axis=1), [0.025, 0.975]))


@pytest.mark.skipif(not os.path.isdir(os.environ.get("CORVANE_TEST_DATA", "/root/testdata/sf0.001")), reason="no test tables")
def test_size_fit_resamples_gives_the_2000_of_the_sql(spark):
    data = os.environ.get("CORVANE_TEST_DATA", "/root/testdata/sf0.001")
    got = {r["b"]: (r["beta"], r["n"]) for r in registry.queries()["size_fit_resamples"](spark, data).collect()}
    assert sorted(got) == list(range(2000))
    db = duckdb.connect()
    for f in os.listdir(data):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    want = {b: (beta, n) for b, beta, n in db.execute(f"SELECT b, beta, n FROM ({registry.oracle_sql()['size_fit_resamples']})").fetchall()}
    assert len(want) == 2000 and all(abs(got[b][0] - want[b][0]) < 1e-4 and got[b][1] == want[b][1] for b in want)


def test_intervals_of_values_are_those_of_the_rows(spark):
    x = [[0.0, 0.25, 0.5, 1.0][i % 4] for i in range(80)]
    rows = spark.createDataFrame([("g", v) for v in x] + [("h", 0.5), ("g", None)], "k string, v double")
    got = {r.k: r for r in stats.value_interval(rows, ["k"], "v").collect()}
    means = np.random.default_rng(1).choice(np.array(x), size=(10_000, 80), replace=True).mean(axis=1)
    assert got["g"].n == 80 and got["g"].point == sum(x) / 80 and np.abs(np.quantile(means, [0.025, 0.975]) - [got["g"].ci_low, got["g"].ci_high]).max() < 0.01
    assert (got["h"].n, got["h"].ci_low, got["h"].ci_high) == (1, 0.5, 0.5)


@pytest.mark.parametrize("name", ["memorization_summary", "portability"])
def test_overlap_queries_keep_no_grams_of_one_side_alone(spark, tmp_path, name):
    rng = random.Random(5)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(400)) + " a b c d e f g h"
    ladder = [(1000 + i, "none", "m", text(), True, False) for i in range(100)]
    spark.createDataFrame(ladder, "row_id long, constraint_stack string, method string, generated string, parse_valid boolean, verify_valid boolean").write.parquet(f"{tmp_path}/ladder.parquet")
    spark.createDataFrame([(i, text()) for i in range(100)], "row_id long, mlir string").write.parquet(f"{tmp_path}/train_v1.parquet")
    before = len(store._tables)
    r = registry.queries()[name](spark, str(tmp_path)).first()
    assert r["n"] == 100 and r["n_exact"] == 0 and math.isclose(r["max_best" if name == "memorization_summary" else "max_overlap"], 1 / 401)
    kept = sum(p.stat().st_size for t in store._tables[before:] for p in Path(t.removeprefix("file:")).rglob("*.parquet"))
    assert kept < 8 * 401 * 100 / 2  # half of what the hashes of the generations take


def test_memorization_summary_moves_less_than_the_hashes_of_one_side_alone(spark, tmp_path):
    rng = random.Random(7)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(800)) + " a b c d e f g h"
    spark.createDataFrame([(1000 + i, "none", text()) for i in range(200)], "row_id long, constraint_stack string, generated string").write.parquet(f"{tmp_path}/ladder.parquet")
    spark.createDataFrame([(i, text()) for i in range(200)], "row_id long, mlir string").write.parquet(f"{tmp_path}/train_v1.parquet")

    def moved():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty(30_000)
        ran = sc.statusStore().executorList(False)
        return sum(ran.apply(i).totalShuffleWrite() for i in range(ran.size()))

    before = moved()
    r = registry.queries()["memorization_summary"](spark, str(tmp_path)).first()
    assert (r["n"], r["n_half"], r["n_exact"]) == (200, 0, 0) and math.isclose(r["max_best"], 1 / 801) and math.isclose(r["mean_best"], 1 / 801, abs_tol=1e-9)
    assert 0 < moved() - before < 8 * 801 * 400


@pytest.mark.parametrize("room", [1, 7, 1 << 20])
def test_most_shared_in_pieces(monkeypatch, room):
    monkeypatch.setattr(decontam, "ROOM", room)
    rng = random.Random(11)
    sets = lambda n, most: [sorted(set(rng.sample(range(30), rng.randint(0, most)) + [i for i in (40, 41, 42) if rng.random() < 0.9])) for _ in range(n)]
    asked, given = sets(80, 20), sets(120, 8)
    of = lambda x: decontam.Sets(np.repeat(np.arange(len(x)), [len(s) for s in x]), np.array([g for s in x for g in s], np.int64), len(x))
    for pairs, per_gram in ((1, 0), (decontam.PAIRS, decontam.PAIRS_PER_GRAM)):
        assert decontam.shared_most(of(asked), of(given), 50, pairs, per_gram).tolist() == [max(len(set(a) & set(g)) for g in given) for a in asked]
