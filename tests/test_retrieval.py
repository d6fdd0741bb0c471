import numpy as np
import pytest

from pairmend.operators import retrieval

KIND = "row_id string, image_emb array<double>, text_emb array<double>"


def brute(rows):
    names = np.array([r[0] for r in rows])
    unit = lambda k: np.array([np.array(r[k]) / (np.linalg.norm(r[k]) or 1) for r in rows])
    sims = unit(1) @ unit(2).T
    out = {}
    for k, name in enumerate(names):
        own = sorted(((-round(s, 9), n) for s, n in zip(sims[k], names, strict=True) if n != name))
        out[name] = (own[0][1], -own[0][0])
    return out


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_pruned_search_is_exhaustive_search(spark, spread):
    """With tight clusters few pairs are compared; without any, the answers are the same. Zeros, copies and ties included."""
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(20, 16))
    v = middles[rng.integers(0, 20, 1500)] + spread * rng.normal(size=(1500, 16))
    w = v + spread * rng.normal(size=v.shape)
    w[100:400] = w[100]  # a hot vector: more copies than a block holds
    w[7] = v[9] = 0
    rows = [(f"r{k:04d}", v[k].tolist(), w[k].tolist()) for k in range(1500)]
    given = spark.createDataFrame(rows, KIND)
    got = retrieval.searched(given.limit(1500), given, block=60, cell=50).collect()
    want = brute(rows)
    assert len(got) == 1500
    for r in got:
        assert r["best_other_sim"] == pytest.approx(want[r["row_id"]][1], abs=1e-8)
    same = [r["best_other_row"] == want[r["row_id"]][0] for r in got]
    assert sum(same) >= 1490  # equal but for the last bits of a product
    share = sum(r["pairs"] for r in got) / 1500**2
    print("share of pairs compared:", share)
    assert share <= (0.2 if spread < 1 else 1.0)


def test_small_and_empty_tables(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0], [1.0, 0.0]), ("b", [0.0, 1.0], [1.0, 0.0]), ("c", None, [0.0, 1.0])], KIND)
    got = {r["row_id"]: (r["best_other_row"], r["best_other_sim"]) for r in retrieval.best_other(rows, rows).collect()}
    assert got == {"a": ("b", pytest.approx(1.0)), "b": ("c", pytest.approx(1.0))}
    assert retrieval.best_other(rows.limit(0), rows).collect() == [] == retrieval.best_other(rows, rows.limit(0)).collect()
    alone = rows.filter("row_id = 'a'")
    assert retrieval.best_other(alone, alone).collect() == []


def test_products_are_held_in_slices(monkeypatch):
    """A task holds SLICE products at once; the answers are those of the whole product, own rows and ties included."""
    rng = np.random.default_rng(2)
    v, w = rng.normal(size=(50, 4)), rng.normal(size=(40, 4))
    w[7] = w[3]
    names, others = np.array([f"r{k:02d}" for k in range(50)], object), np.array([f"r{k:02d}" for k in range(40)], object)
    sims = v @ w.T
    sims[np.arange(40), np.arange(40)] = -np.inf
    monkeypatch.setattr(retrieval, "SLICE", 120)
    best, sim = retrieval._best(v, others, w, retrieval._own(names, others))
    assert sim == pytest.approx(sims.max(1)) and list(best) == list(others[sims.argmax(1)])
