"""Mixing keeps rows whose ids are null or repeated."""

from corvane.llm import mixing


def test_mixing_keeps_rows_with_null_and_repeated_ids(spark, tmp_path):
    rows = [(1, "a", "one two"), (1, "b", "one two three"), (None, "a", "one two"), (2, "b", "")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], "source string, target_share double, max_repeats int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    sizes, _ = mixing._inputs(spark, str(tmp_path))
    got = sorted(((r.doc_id, r.source, r.n_tokens > 0) for r in sizes.collect()), key=str)
    assert got == sorted(((1, "a", True), (1, "b", True), (None, "a", True), (2, "b", False)), key=str)
    has = {r["source"]: r["has"] for r in mixing.p8_mix(spark, str(tmp_path)).collect()}
    assert has == {s: sum(r.n_tokens for r in sizes.collect() if r.source == s) for s in "ab"}
