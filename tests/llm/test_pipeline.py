import numpy as np
import pytest

import corpus_pipeline
from pairmend.llm import secrets, spm
from pairmend.llm.queries import TOKENIZER


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(0)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdehinorst"), 5)) for _ in range(n))
    texts = [prose(120) for _ in range(80)]
    texts += [t + " end" for t in texts[:5]] + [(prose(50) + "!!").upper() for _ in range(30)] + [texts[6] + ' token = "0123456789abcdef0123456789abcdef01234567"', None, ""]
    docs = spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(k, int(not 85 <= k < 115)) for k in range(115)], "doc_id long, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path)).cache()
        seen[name] = now
    kept = {r["doc_id"] for r in seen["quality classifier"].collect()}
    assert set(range(85)) <= kept and not kept & set(range(85, 115))
    one = {r["doc_id"] for r in seen["MinHash near-dedup"].collect()}
    assert one == kept - {80, 81, 82, 83, 84, 115}
    assert all(not secrets.brute_force(r["text"]) for r in seen["secret scans"].collect())
    mixed = seen["mixing sources to target weights"].collect()
    size = lambda rows: sum(len((r["text"] or "").split()) for r in rows)
    assert size(mixed) == pytest.approx(1.5 * size(seen["secret scans"].collect()), rel=0.02)
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert seen[name].columns == docs.columns
    assert all(r["n_tokens"] == len(r["tokens"]) > 0 for r in seen["SentencePiece encoding"].collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(mixed)


def test_the_last_stage_decodes(spark):
    texts = ["Two words.\n\nAnd  more", " \tx", "a \u2581 mark", "", None, "日本 naïve"]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()}
    want = {r["doc_id"]: r for r in spm.round_trips(docs, TOKENIZER).collect()}
    assert all(got[k][c] == want[k][c] for k in want for c in ("n_tokens", "decoded_sha256", "round_trip")) and len(got) == len(texts)
    assert got[0]["round_trip"] and not got[2]["round_trip"]


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "kept boolean, component_id long, score double, size string, shard string, place_key string, tokens string, set_key string"


def test_stages_on_odd_rows(spark, tmp_path):
    """Null and repeated ids, texts and sources, repeated rows, a long text, and columns with names that stages use themselves."""
    rng = np.random.default_rng(1)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdehinorst"), 5)) for _ in range(n))
    good, bad, long = [prose(120) for _ in range(40)], [(prose(50) + "!!").upper() for _ in range(20)], prose(60_000)
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(good + bad)]
    rows += [(None, prose(90), None, None, None), (None, prose(80), "en", "s", 0), (0, good[0], "en", "s", 600), (0, good[0], "en", "s", 600), (1, prose(70), "en", None, 5), (99, long, "en", "t", 1)]
    rows += [(200, None, None, None, None), (201, "", "en", "s", 0), (202, " \n\t ", "en", "s", 4)]
    docs = spark.createDataFrame([(*r, True, 7, 0.5, "x", "x", "x", "x", "x") for r in rows], f"{DOCUMENTS}, {CLASHING}")
    labels = spark.createDataFrame([(k, int(k < 40)) for k in [*range(60), 5, 5]] + [(None, 1), (3, None)], "doc_id long, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path)).cache()
        seen[name] = now.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns, name
    texts = lambda name: [r["text"] for r in seen[name]]
    accepted, one = texts("quality classifier"), texts("MinHash near-dedup")
    assert not set(accepted) & set(bad) and set(good) | {long} <= set(accepted) and accepted.count(good[0]) == 3
    assert one.count(good[0]) == 1 and set(filter(None, accepted)) - {" \n\t "} <= set(one) and len(one) >= 44
    assert len(texts("secret scans")) == len(one)
    words = lambda name: sum(len((t or "").split()) for t in texts(name))
    assert words("secret scans") < words("mixing sources to target weights") <= 2 * words("secret scans")
    assert len(seen["SentencePiece encoding"]) == len(seen["mixing sources to target weights"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["SentencePiece encoding"])


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    before = spark.conf.get(corpus_pipeline.BATCH)
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == [] and spark.conf.get(corpus_pipeline.BATCH) == before
