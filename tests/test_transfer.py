"""Bytes from servers and files: fetching with failures, whole copies under retries, vectors from files, and the stages from raw rows to repaired images."""

import os
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from test_build import png

from pairmend.__main__ import main
from pairmend.sources import embedding, files, transfer

RED, BLUE, GREEN = (200, 40, 60), (60, 90, 210), (60, 160, 80)

MODEL = """
import numpy as np
ANGLES = {"red": 0.1, "blue": 1.6, "green": 3.0}

class Model:
    def encode_texts(self, texts):
        words = [next((w for w in ANGLES if w in t.lower()), "red") for t in texts]
        return np.array([[np.cos(ANGLES[w]), np.sin(ANGLES[w])] for w in words])

    def encode_images(self, contents):
        out = []
        for c in contents:
            if not c.startswith(b"\\x89PNG"):
                raise ValueError("no image")
            color = max(ANGLES, key=lambda w: c.count(w.encode()))
            out.append([np.cos(ANGLES[color] + 0.01), np.sin(ANGLES[color] + 0.01)])
        return np.array(out)

def make():
    return Model()
"""


def named_png(color, name):
    return png(color) + name.encode()  # what the model looks at; readers stop before it


@pytest.fixture
def server():
    """Serves /ok..., fails once for /once..., always for /gone..., and breaks off /short..."""
    seen, now, most, lock = Counter(), Counter(), Counter(), threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            with lock:
                seen[self.path] += 1
                now["all"] += 1
                most["all"] = max(most["all"], now["all"])
            body = named_png(BLUE, "blue") + b"x" * 600_000
            try:
                if "gone" in self.path or ("once" in self.path and seen[self.path] == 1):
                    self.send_error(503)
                else:
                    self.send_response(200)
                    self.send_header("Content-Length", str(len(body) + 5 * ("short" in self.path)))
                    self.end_headers()
                    self.wfile.write(body)
            finally:
                with lock:
                    now["all"] -= 1

        def log_message(self, *_):
            pass

    running = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{running.server_port}", seen, most
    running.shutdown()


def test_fetching_tries_again_and_keeps_failures_apart(spark, server):
    base, seen, most = server
    urls = [f"{base}/{x}" for x in ("ok1", "ok2", "once", "gone", "short", *(f"ok{k}" for k in range(10, 40)))]
    rows = spark.createDataFrame([(u,) for u in [*urls, urls[0], " " + urls[1] + " ", "", None, "http://nowhere.invalid/x", "no address"]], "image_url string")
    got = {r["url"]: r for r in transfer.fetch_all(rows, per_host=2, pause=0.01).collect()}
    assert len(got) == len(urls) + 2
    for name, tries, fine in (("ok1", 1, True), ("once", 2, True), ("gone", 3, False), ("short", 3, False)):
        r = got[f"{base}/{name}"]
        assert (r["tries"], r["content"] is not None, r["error"] is None) == (tries, fine, fine)
    assert len(got[urls[0]]["content"]) > 600_000 and got["no address"]["error"] and got["http://nowhere.invalid/x"]["content"] is None
    assert seen["/ok1"] == 1 and most["all"] <= 2


def test_copies_read_everything_before_they_replace_anything(spark, tmp_path):
    for name in "abc":
        (tmp_path / name).write_text(name)
    at = lambda x: str(tmp_path / x)
    jobs = spark.createDataFrame([(at("a"), at("b")), (at("b"), at("a")), (at("c"), at("deep/d")), (at("gone"), at("c")), (at("c"), at("b")), ("", at("e"))], "source string, target string")
    got = {os.path.basename(r["target"]): r for r in transfer.copy_files(jobs).collect()}
    assert {k: r["ok"] for k, r in got.items()} == {"a": True, "b": True, "d": True, "c": False} and "FileNotFound" in got["c"]["error"]
    assert [(tmp_path / x).read_text() for x in ("a", "b", "c", "deep/d")] == ["b", "a", "c", "c"]
    assert sorted(os.listdir(tmp_path)) == ["a", "b", "c", "deep"]


def test_a_copy_that_dies_leaves_the_old_file_or_the_new(tmp_path):
    target = tmp_path / "t"
    target.write_text("old")

    def half(aside):
        with open(aside, "w") as f:
            f.write("ne")
            raise KeyboardInterrupt  # the task is killed half-way

    with pytest.raises(KeyboardInterrupt):
        transfer._into_place(str(target), half)
    assert target.read_text() == "old" and os.listdir(tmp_path) == ["t"]
    for _ in range(2):  # the task is tried again, and once more by speculation
        transfer._into_place(str(target), lambda aside: transfer._dump(aside, b"new"))
    assert target.read_text() == "new" and os.listdir(tmp_path) == ["t"]


def test_a_killed_task_is_tried_again(spark, tmp_path):
    rows = spark.createDataFrame([(str(tmp_path / f"f{k}"), f"text {k}".encode()) for k in range(20)], "t string, c binary")
    once = str(tmp_path / "died")

    def fatal(data):
        if not os.path.exists(once):
            open(once, "w").close()
            os._exit(1)  # the whole worker goes
        return data

    from pyspark.sql import functions as F

    dying = F.udf(lambda c: bytes(fatal(c)), "binary")
    conf = spark.sparkContext.getConf().get("spark.master")
    if conf == "local[4]":  # a local master doesn't try tasks again; the write itself is what is repeated
        with pytest.raises(Exception, match="."):
            transfer.write_files(rows, F.col("t"), dying("c"))
    got = transfer.write_files(rows, F.col("t"), dying("c")).collect()
    assert all(r["ok"] for r in got) and len(got) == 20
    assert [(tmp_path / f"f{k}").read_text() for k in range(20)] == [f"text {k}" for k in range(20)]
    assert not [f for f in os.listdir(tmp_path) if "aside" in f or "staged" in f]


def test_a_broken_image_costs_its_own_row(spark, tmp_path):
    (tmp_path / "deterministic_model.py").write_text(MODEL)
    spark.sparkContext.addPyFile(str(tmp_path / "deterministic_model.py"))
    rows = [(str(k), f"{c} shoe", named_png(RED, c) if k != 2 else b"no image") for k, c in enumerate(["red", "blue", "green", "red"])] + [("9", None, None)]
    made = embedding.with_vectors(spark.createDataFrame(rows, "row_id string, canonical_text string, content binary"), embedding.factory_of("deterministic_model:make"), 16)
    got = {r["row_id"]: r for r in made.collect()}
    assert got["2"]["image_emb"] is None and got["9"]["image_emb"] is None and got["1"]["image_emb"][1] > 0.9 and all(r["text_emb"] for r in got.values())
    with pytest.raises(ValueError):
        embedding.factory_of("nothing")


def test_stages_from_raw_rows_to_repaired_files(spark, server, tmp_path):
    """Files and URLs to processed images, to vectors, to flags, to a plan, to copies that are there."""
    base, _, _ = server
    (tmp_path / "deterministic_model.py").write_text(MODEL)
    spark.sparkContext.addPyFile(str(tmp_path / "deterministic_model.py"))
    source, root = tmp_path / "img", tmp_path / "root"
    source.mkdir()
    root.mkdir()
    names = ["red"] * 6 + ["green"] * 5
    for k, name in enumerate(names):
        (source / f"{k}.png").write_bytes(named_png(RED if name == "red" else GREEN, name))
    (source / "4.png").write_bytes(b"no image")
    lines = [f"{k},{n} shoe,c,{{}},{k}.png," for k, n in enumerate(names)]
    lines += [f"20,blue shoe,c,{{}},,{base}/ok", f"21,blue shoe,c,{{}},,{base}/gone", f"22,green shoe,c,{{}},,{base}/once"]
    (tmp_path / "raw.csv").write_text("row_id,title,category,attributes_json,image_path,image_url\n" + "\n".join(lines) + "\n")
    main(["build", str(tmp_path / "raw.csv"), str(tmp_path / "rows.parquet"), "--images", str(source), "--root", str(root), "--fetch"], spark)
    rows = spark.read.parquet(str(tmp_path / "rows.parquet"))
    missing = {r["row_id"] for r in rows.filter("is_image_missing").collect()}
    assert missing == {"4", "21"} and (root / "data/processed/images/20.jpg").read_bytes().startswith(b"\x89PNG")
    main(["sieve", str(tmp_path / "rows.parquet"), str(tmp_path), "--root", str(root), "--model", "deterministic_model:make"], spark)
    sieved = {r["row_id"]: r for r in spark.read.parquet(str(tmp_path / "clip_embeddings_rows.parquet")).collect()}
    assert sieved["22"]["flag_reason"] == "low_similarity" and sieved["4"]["flag_reason"] == "missing_image" and sieved["20"]["flag_reason"] == "ok"
    main(["diagnose", str(tmp_path / "clip_embeddings_rows.parquet"), str(tmp_path), "--root", str(root)], spark)
    main(["arbitrate", str(tmp_path / "arbiter_queue_rows.csv"), str(tmp_path / "arbiter_plan_rows.csv")], spark)
    plan = {r["row_id"]: r for r in files.read_plan(spark, str(tmp_path / "arbiter_plan_rows.csv")).collect()}
    assert plan["22"]["action"] == "replace_image_from_row"
    main(["repair", str(tmp_path / "rows.parquet"), str(tmp_path / "arbiter_plan_rows.csv"), str(tmp_path), "--root", str(root)], spark)
    fixed = {r["row_id"]: r for r in spark.read.parquet(str(tmp_path / "repaired_rows.parquet")).collect()}
    now = fixed["22"]
    assert now["image_path"] == "data/processed/repaired_images/22.jpg"
    assert (root / now["image_path"]).read_bytes() == (root / now["image_origin_path"]).read_bytes()
