import numpy as np
import pytest

from pairmend.config import SieveConfig
from pairmend.operators import quantiles
from pairmend.operators import sieve as S
from pairmend.streaming.sieve import sieve_stream

SCORED = "row_id string, category string, sim_score double, is_image_missing boolean, is_text_missing boolean"


def scored(spark, rows):
    return spark.createDataFrame(rows, SCORED)


@pytest.mark.parametrize(("in_task", "small"), [(0, 0), (0, 100_000), (1_000_000, 0)])
def test_quantiles_are_numpys(spark, monkeypatch, in_task, small):
    monkeypatch.setattr(quantiles, "IN_TASK", in_task)
    monkeypatch.setattr(quantiles, "SMALL", small)
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=30_000), "b": np.round(rng.normal(size=20_000), 1), "c": np.full(9_000, 2.5)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None), ("a", float("nan")), ("d", None)]
    got = quantiles.exact_quantiles(spark.createDataFrame(rows, "g string, x double"), "g", "x", [0.0, 0.05, 0.25, 0.75, 1.0]).collect()
    assert {r["g"] for r in got} == {"a", "b", "c"}
    for r in got:
        want = np.quantile(groups[r["g"]], [0.0, 0.05, 0.25, 0.75, 1.0])
        assert r["n"] == len(groups[r["g"]]) and np.allclose([r[f"q{k}"] for k in range(5)], want, atol=1e-12)


def test_quantiles_of_one_and_none(spark):
    one = spark.createDataFrame([(1.5,)], "x double")
    assert quantiles.exact_quantiles(one, None, "x", [0.25]).collect()[0]["q0"] == 1.5
    assert quantiles.exact_quantiles(one.limit(0), None, "x", [0.25]).collect() == []


def test_small_categories_take_the_global_threshold(spark):
    rows = [(str(i), "seven" if i < 7 else "eight", float(i), False, False) for i in range(15)] + [("n", None, 3.0, False, False), ("u", "unscored", None, True, False)]
    got = {r["category"]: r for r in S.category_thresholds(scored(spark, rows)).collect()}
    every = [r[2] for r in rows if r[2] is not None]
    assert set(got) == {"seven", "eight"}
    assert got["seven"]["threshold_source"] == "global" and got["seven"]["sieve_threshold"] == pytest.approx(np.quantile(every, 0.1))
    own = np.arange(7.0, 15.0)
    a, b = np.quantile(own, [0.25, 0.75])
    assert got["eight"]["threshold_source"] == "category" and got["eight"]["sieve_threshold"] == pytest.approx(a - 1.5 * (b - a))
    low = S.category_thresholds(scored(spark, rows), SieveConfig(threshold_method="quantile", min_category_samples=2)).collect()
    assert {r["category"]: r["sieve_threshold"] for r in low}["eight"] == pytest.approx(np.quantile(own, 0.05))


def test_flags_and_reasons(spark):
    rows = [(str(i), "c", 0.9, False, False) for i in range(20)]
    rows += [("low", "c", 0.1, False, False), ("noimage", "c", None, True, True), ("notext", "c", 0.9, None, True), ("nocat", None, 0.0, False, False), ("at", "d", 0.5, False, False)]
    got = {r["row_id"]: r for r in S.sieve(scored(spark, rows)).collect()}
    reasons = {k: r["flag_reason"] for k, r in got.items()}
    assert reasons["low"] == "low_similarity" and reasons["noimage"] == "missing_image" and reasons["notext"] == "missing_text"
    assert reasons["nocat"] == "ok" and got["nocat"]["threshold_source"] == "unknown" and got["nocat"]["sieve_threshold"] is None
    assert all(r["flagged"] == (r["flag_reason"] != "ok") for r in got.values())


def test_at_the_threshold_is_not_flagged(spark):
    rows = scored(spark, [(str(i), "c", 0.5, False, False) for i in range(9)])
    assert not S.sieve(rows).filter("flagged").collect()


def test_no_rows(spark):
    none = scored(spark, [])
    assert S.sieve(none).collect() == []
    assert S.global_threshold(none).first()["global_threshold"] == -1.0


def test_sieve_adds_absent_columns_and_passes_others(spark):
    rows = spark.createDataFrame([("1", "c", [1.0, 0.0], [1.0, 0.0], "kept")], "row_id string, category string, text_emb array<float>, image_emb array<float>, extra string")
    row = S.sieve(rows).first()
    assert row["extra"] == "kept" and row["sim_score"] == pytest.approx(1.0) and not row["flagged"]


def test_export(spark):
    rows = spark.createDataFrame([("1", [1.0, 2.0], None, None, None, True)], "row_id string, text_emb array<float>, image_emb array<float>, sim_score double, sieve_threshold double, flagged boolean")
    row = S.export_embeddings(rows, 3).first()
    assert row["text_emb"] == [1.0, 2.0, 0.0] and row["image_emb"] == [0.0] * 3 and row["sim_score"] == -1.0 and row["flagged"] == 1


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = scored(spark, [(str(i), "c", 0.9, False, False) for i in range(20)] + [("low", "c", 0.1, False, False), ("x", "new", 0.1, False, True)])
    rows.write.parquet(str(tmp_path / "in"))
    thresholds, overall = S.category_thresholds(rows.filter("category = 'c'")), S.global_threshold(rows)
    stream = sieve_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), thresholds, overall)
    query = stream.select("row_id", "flag_reason").writeStream.format("memory").queryName("flags").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    got = {r["row_id"]: r["flag_reason"] for r in spark.table("flags").collect()}
    assert len(got) == 22 and got["low"] == "low_similarity" and got["x"] == "missing_text" and got["3"] == "ok"


def test_thresholds_keep_up_with_a_stream(spark, tmp_path):
    """After each batch within the stated rank error of all scores so far, one category being hot; a restarted query goes on."""
    import numpy as np

    from pairmend.config import SieveConfig
    from pairmend.streaming import thresholds as T

    rng, every = np.random.default_rng(1), []
    for part in range(3):
        rows = [(str(k), "hot" if rng.random() < 0.8 else rng.choice(["a", "b"]), float(rng.normal()), False, False) for k in range(3000)]
        rows += [("x", "few", 0.5, False, False), ("y", None, float(part), False, False), ("z", "a", None, False, False)]
        every += rows
        scored(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(scored(spark, []).schema).parquet(str(tmp_path / "in"))
        query = T.keeping_up(stream, str(tmp_path / "out"), str(tmp_path / "c")).trigger(availableNow=True).start()  # started again for each part
        query.awaitTermination()
        made = T.latest(spark, str(tmp_path / "out"))
        counts = {(r["category"], r["overall"]): r["n"] for r in made.collect()}
        assert counts[(None, True)] == sum(r[2] is not None for r in every) and counts[("few", False)] == part + 1
        own, overall = T.thresholds(made, SieveConfig(threshold_method="quantile"))
        got = {r["category"]: r for r in own.collect()}
        for c in ("hot", "a", "b"):
            values = np.sort([r[2] for r in every if r[1] == c and r[2] is not None])
            assert abs(np.searchsorted(values, got[c]["sieve_threshold"]) / len(values) - 0.05) < 0.01
        assert got["few"]["threshold_source"] == "global" and got["few"]["sieve_threshold"] == overall.first()["global_threshold"]
    exact = {r["category"]: r["sieve_threshold"] for r in S.category_thresholds(scored(spark, every)).collect()}
    close = {r["category"]: r["sieve_threshold"] for r in T.thresholds(made)[0].collect()}
    assert set(exact) == set(close) and all(abs(exact[c] - close[c]) < 0.1 for c in ("hot", "a", "b"))
