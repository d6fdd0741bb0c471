import struct
import zlib

import pytest

from pairmend import config
from pairmend.__main__ import main
from pairmend.operators import build, simulate
from pairmend.schema import RAW
from pairmend.sources import files, images


def test_build(spark):
    raw = [
        ("001", " Red shoe ", "c", '{"size": 3}', "a.png", "http://x"), ("2", None, None, "[]", None, "http://x"), ("3", "", "", "{bad", "", ""),
        ("4", "t", "c", None, "gone.png", "http://x"), (None, "t", "c", "{}", "", ""),
    ]
    listed = spark.createDataFrame([("001", True), ("2", False), ("3", True)], "row_id string, ok boolean")
    got = {r["row_id"]: r for r in build.build(spark.createDataFrame(raw, RAW), listed).collect()}
    a = got["001"]
    assert (a["title"], a["attributes"], a["image_path"], a["is_image_missing"], a["is_text_missing"]) == ("Red shoe", '{"size":3}', "data/processed/images/001.jpg", False, False)
    assert a["canonical_text"] == "Red shoe. Category: c. Attributes: size=3." and a["source_image_path"] == "a.png"
    assert got["2"]["is_image_missing"] and got["2"]["image_path"] == "" and got["2"]["is_text_missing"]
    assert got["3"]["is_image_missing"] and got["4"]["is_image_missing"] and not got["4"]["is_text_missing"]
    assert got[""]["title"] == "t"
    counts = build.counters(build.build(spark.createDataFrame(raw, RAW), listed)).first()
    assert counts.asDict() == {"rows": 5, "normalized_images": 1, "missing_images": 4, "missing_text": 2}


def test_a_path_suppresses_the_url(spark):
    rows = build.image_source(build.normalize(spark.createDataFrame([("1", "broken.png", "http://x"), ("2", "", "http://x"), ("3", "", "")], "row_id string, image_path string, image_url string")))
    assert [r["image_source"] for r in rows.orderBy("row_id").collect()] == ["local", "url", "none"]


def test_noise(spark):
    rows = spark.createDataFrame([(str(i), f"t{i}", "c", '{"color": "red"}', "old", f"{i}.png") for i in range(40)], "row_id string, title string, category string, attributes string, canonical_text string, image_path string")
    many = simulate.replicate(rows, 15)
    noisy = simulate.add_noise(many).cache()
    assert many.count() == noisy.count() == 600 and many.select("row_id").distinct().count() == 600
    assert simulate.noise_counts(noisy).first().asDict() == {"rows": 600, "noisy": 180}
    kinds = {r["noise_label"]: r["count"] for r in noisy.groupBy("noise_label").count().collect()}
    assert 50 < kinds["swap_image"] < 130
    before = sorted(r["image_path"] for r in many.collect())
    assert sorted(r["image_path"] for r in noisy.collect()) == before
    for r in noisy.filter("noise_label = 'mutate_text'").collect():
        assert '"red"' not in r["attributes"] and r["attributes"].split('"')[3] in simulate.NOISE_COLORS and r["canonical_text"].startswith(r["title"])
    again = simulate.add_noise(simulate.replicate(rows, 15))
    assert again.exceptAll(noisy).isEmpty()
    assert simulate.replicate(rows, 0).count() == 0


def test_exchanges_come_to_what_making_them_in_turn_does(spark):
    import random

    rng, lies = random.Random(3), {k: k for k in range(40)}
    swaps = [(t, rng.choice([0, rng.randrange(40)]), rng.randrange(40)) for t in range(300)]  # position 0 is in every other one
    for _, a, b in swaps:
        lies[a], lies[b] = lies[b], lies[a]
    got = simulate.exchanged(spark.createDataFrame(swaps, "step long, a long, b long")).collect()
    assert {r["position"]: r["origin"] for r in got} == {k: lies[k] for k in {x for _, a, b in swaps if a != b for x in (a, b)}}
    assert simulate.exchanged(spark.createDataFrame([(1, 2, 2)], "step long, a long, b long")).collect() == []


def test_noise_with_free_partners(spark):
    rows = spark.createDataFrame([(str(i), f"t{i}", "c", '{"color": "red"}', "old", f"{i}.png") for i in range(60)], "row_id string, title string, category string, attributes string, canonical_text string, image_path string")
    many = simulate.replicate(rows, 5)
    noisy = simulate.add_noise(many, partners="free").cache()
    before = {r["row_id"]: r["image_path"] for r in many.collect()}
    got = noisy.collect()
    assert len(got) == 300 and sorted(r["image_path"] for r in got) == sorted(before.values())
    assert sum(r["noise_label"] != "clean" for r in got) == 90
    touched = [r for r in got if r["image_path"] != before[r["row_id"]]]
    assert {"clean", "swap_image"} <= {r["noise_label"] for r in touched}
    assert simulate.add_noise(many, partners="free").exceptAll(noisy).isEmpty()


def test_attributes_keep_their_types(spark):
    given = '{"b": true, "size": 3, "part": 2.5, "none": null, "list": [1, "x"], "in": {"k": 1}, "text": "3", "size": 4}'
    rows = build.build(spark.createDataFrame([("1", "t", "c", given)], "row_id string, title string, category string, attributes_json string"))
    one = rows.first()
    assert one["attributes"] == '{"b":true,"size":4,"part":2.5,"none":null,"list":[1,"x"],"in":{"k":1},"text":"3"}'
    assert one["canonical_text"] == 't. Category: c. Attributes: b=true, size=4, part=2.5, none=None, list=[1,"x"], in={"k":1}, text=3.'
    noisy = simulate.add_noise(simulate.replicate(rows, 4), rate=1.0)
    mutated = noisy.filter("noise_label = 'mutate_text'").collect()
    assert mutated and all(r["attributes"].startswith(one["attributes"][:-1] + ',"color":"') for r in mutated)


def png(color, side=70):
    raw = b"".join(b"\0" + bytes(color) * side for _ in range(side))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", side, side, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "red.png").write_bytes(png((200, 40, 60)))
    (tmp_path / "sub" / "white.png").write_bytes(png((255, 255, 255)))
    (tmp_path / "bad.png").write_bytes(b"no image")
    listed = {r["path"] for r in images.listing(spark, str(tmp_path), str(tmp_path)).collect()}
    assert listed == {"red.png", "sub/white.png", "bad.png"}
    got = {r["origin"].rsplit("/", 1)[-1]: r for r in images.dominant_colors(images.read_images(spark, str(tmp_path))).collect()}
    assert got["red.png"]["img_color"] == "red" and got["red.png"]["img_rgb"] == [200, 40, 60]
    assert got["white.png"]["img_color"] == "white" and got["white.png"]["img_rgb"] == [255, 255, 255]
    assert not got["bad.png"]["ok"] and got["bad.png"]["img_color"] is None


def test_fetch_isolates_failures(spark):
    def fetcher(url):
        if "bad" in url:
            raise OSError(url)
        return url.encode()

    rows = spark.createDataFrame([("http://a",), ("http://bad",), ("",), (None,)], "image_url string")
    assert [r["content"] for r in images.fetch(rows, fetcher).collect()] == [b"http://a", None, None, None]


def test_embed_skips_rows_without_images(spark):
    def model():
        return lambda texts, contents: ([[float(len(t)), 1.0] for t in texts], [[float(len(c)), 2.0] for c in contents])

    rows = spark.createDataFrame([("1", "abc", b"xy"), ("2", "d", None)], "row_id string, canonical_text string, content binary")
    got = {r["row_id"]: r for r in images.embed(rows, model).collect()}
    assert got["1"]["text_emb"] == [3.0, 1.0] and got["1"]["image_emb"] == [2.0, 2.0] and got["2"]["text_emb"] is None


def test_csv_keeps_ids_and_nas(spark, tmp_path):
    (tmp_path / "r.csv").write_text('row_id,title,extra\n001,"a ""b"", c",x\nNA,,y\n')
    rows = files.read_raw(spark, str(tmp_path / "r.csv")).collect()
    assert [(r["row_id"], r["title"], r["category"]) for r in rows] == [("001", 'a "b", c', None), ("NA", None, None)]
    assert files.read_raw(spark, str(tmp_path / "r.csv"), pandas_na=True).collect()[1]["row_id"] is None
    files.write_csv(spark.createDataFrame([], files.PLAN), str(tmp_path / "plan"))
    assert files.read_plan(spark, str(tmp_path / "plan")).collect() == []


def test_names():
    assert files.stem_of("/a/sieve_results_toy.csv") == "toy" and files.stem_of("processed_rows.parquet") == "processed_rows"
    assert files.artifact("plan", "out/", "x/arbiter_queue_toy.csv") == "out/arbiter_plan_toy.csv"


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("data:\n  raw_csv: r.csv\nsieve:\n  iqr_k: 2\n  device: cpu\n")
    data, sieve = config.load(tmp_path / "c.yaml")
    assert data.raw_csv == "r.csv" and data.processed_dir == "data/processed" and sieve.iqr_k == 2.0 and sieve.min_category_samples == 8


def test_mandatory_settings(tmp_path):
    (tmp_path / "c.yaml").write_text("data:\n  processed_dir: p\nmodels:\n  clip_model_name: m\nsieve:\n  device: gpu\n")
    assert config.missing(tmp_path / "c.yaml") == ["data.outputs_dir", "data.cache_dir"] and config.model_name(tmp_path / "c.yaml") == "m"
    assert config.load(tmp_path / "c.yaml")[1].device == "gpu"
    with pytest.raises(ValueError, match="data.cache_dir"):
        config.load(tmp_path / "c.yaml", strict=True)


def test_stages_tell_what_they_made(spark, tmp_path, capfd):
    (tmp_path / "raw.csv").write_text("row_id,title,category,attributes_json,image_path\n" + "".join(f'{i},t{i},c,{{}},{i}.png\n' for i in range(10)))
    main(["build", str(tmp_path / "raw.csv"), str(tmp_path / "rows.parquet")], spark)
    main(["simulate", str(tmp_path / "rows.parquet"), str(tmp_path / "toy.parquet"), "--copies-per-row", "3"], spark)
    said = capfd.readouterr().out
    assert "normalized_images" in said and "RECORD 0" in said and "noise_label" in said and "30" in said


def test_stages_from_files(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("row_id,title,category,attributes_json,image_path\n" + "".join(f'{i},t{i},c,"{{""k"": {i}}}",{i}.png\n' for i in range(20)))
    main(["build", str(tmp_path / "raw.csv"), str(tmp_path / "rows.parquet")], spark)
    rows = spark.read.parquet(str(tmp_path / "rows.parquet"))
    angle = "CAST(row_id AS DOUBLE) / 3"
    other = f"({angle} + IF(row_id = '7', 2, 0.01))"
    rows.selectExpr("*", f"array(cos({angle}), sin({angle})) AS text_emb", f"array(cos({other}), sin({other})) AS image_emb").write.parquet(str(tmp_path / "toy.parquet"))
    main(["sieve", str(tmp_path / "toy.parquet"), str(tmp_path)], spark)
    main(["diagnose", str(tmp_path / "clip_embeddings_toy.parquet"), str(tmp_path)], spark)
    main(["arbitrate", str(tmp_path / "arbiter_queue_toy.csv"), str(tmp_path / "arbiter_plan_toy.csv")], spark)
    main(["repair", str(tmp_path / "toy.parquet"), str(tmp_path / "arbiter_plan_toy.csv"), str(tmp_path)], spark)
    flagged = files.read_csv(spark, str(tmp_path / "flagged_rows_toy.csv"), "row_id STRING, flag_reason STRING").collect()
    assert [(r["row_id"], r["flag_reason"]) for r in flagged] == [("7", "low_similarity")]
    fixed = spark.read.parquet(str(tmp_path / "repaired_toy.parquet")).filter("repaired").collect()
    log = files.read_log(spark, str(tmp_path / "repair_log_toy.csv")).collect()
    assert [r["row_id"] for r in fixed] == ["7"] and [(r["row_id"], r["status"]) for r in log] == [("7", "ok")]


def test_stages_read_images(spark, tmp_path):
    """Colours of image files go from the folder through build and diagnose to a patch; a broken file is found out."""
    (tmp_path / "img").mkdir()
    for name, color in (("1", (200, 40, 60)), ("2", (60, 90, 210)), ("3", (200, 40, 60))):
        (tmp_path / "img" / f"{name}.png").write_bytes(png(color))
    (tmp_path / "img" / "4.png").write_bytes(b"no image")
    (tmp_path / "raw.csv").write_text("row_id,title,category,attributes_json,image_path,image_url\n" + "".join(f"{i},red shoe,c,{{}},{i}.png,\n" for i in range(1, 6)))
    main(["build", str(tmp_path / "raw.csv"), str(tmp_path / "rows.parquet"), "--images", str(tmp_path / "img")], spark)
    rows = spark.read.parquet(str(tmp_path / "rows.parquet"))
    assert {r["row_id"]: r["is_image_missing"] for r in rows.collect()} == {"1": False, "2": False, "3": False, "4": True, "5": True}
    angle = "CAST(row_id AS DOUBLE) / 9"
    rows.selectExpr("row_id", f"array(cos({angle}), sin({angle})) AS text_emb", f"array(cos({angle}), sin({angle})) AS image_emb").write.parquet(str(tmp_path / "emb.parquet"))
    rows.filter("row_id <= '3'").selectExpr("*", "true AS flagged", "1.0D AS sim_score").write.parquet(str(tmp_path / "clip_embeddings_toy.parquet"))
    (tmp_path / "img" / "3.png").unlink()
    main(["diagnose", str(tmp_path / "clip_embeddings_toy.parquet"), str(tmp_path), "--images", str(tmp_path / "img"), "--embeddings", str(tmp_path / "emb.parquet")], spark)
    got = {r["row_id"]: r for r in files.read_queue(spark, str(tmp_path / "arbiter_queue_toy.csv")).collect()}
    assert got["1"]["error_type"] == "Unknown" and got["3"]["mismatch_aspects"] == "missing_image_file"
    assert got["2"]["mismatch_aspects"] == "color" and '"attributes.color":"blue"' in got["2"]["proposed_fix"]


def test_copies_are_made_and_noised_where_they_lie(spark):
    """Rows of one partition are dealt out before they are copied, and noise joins nothing: what is swapped alone is shuffled."""
    rows = spark.createDataFrame([(k, f"t{k}", "c", "{}", "x", f"{k}.jpg") for k in range(40)], "row_id long, title string, category string, attributes string, canonical_text string, image_path string")
    many = simulate.replicate(rows.coalesce(1), 5)
    assert many.rdd.getNumPartitions() == 12
    noisy = simulate.add_noise(many)
    assert "Join" not in noisy._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["image_path"] for r in noisy.collect()) == sorted(r["image_path"] for r in many.collect())


def test_no_table_of_copies_is_broadcast(spark):
    from pairmend.plans import queries

    found = queries.noise_invariants(spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.first().asDict() == {"rows": 3000, "noisy": 900, "colors_kept": 0, "texts_wrong": 0, "others_touched": 0, "images_lost": 0}
