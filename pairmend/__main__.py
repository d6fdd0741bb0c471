"""python -m pairmend STAGE ...: the stages over files."""

from __future__ import annotations

import argparse
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmend import config
from pairmend.functions.text import resolve_path
from pairmend.operators import arbitrate, build, diagnose, repair, sieve, simulate
from pairmend.sources import files, jpeg
from pairmend.sources.embedding import embedded, factory_of
from pairmend.sources.images import copy_jobs, images_of, listing, read_images
from pairmend.sources.shared import delete
from pairmend.sources.transfer import copy_files, fetch_all, write_files


def placed(spark: SparkSession, rows: DataFrame, folder: str | None, root: str, images_dir: str, fetch: bool, as_jpeg: bool = False) -> DataFrame:
    """row_id and ok for rows whose image was copied or fetched to its place under root and can be decoded there.

    With as_jpeg what came is kept aside only until RGB JPEG files of it are in their places; what can't be decoded leaves none.
    """
    rows = build.image_source(rows)
    name = os.path.basename(images_dir) + (f"-given-{uuid.uuid4().hex}" if as_jpeg else "")
    final, given = f"{root}/{images_dir}", f"{root}/{os.path.join(os.path.dirname(images_dir), name)}"
    target = F.concat(F.lit(f"{given}/"), "row_id", F.lit(".jpg"))
    if folder:
        local = rows.filter("image_source = 'local'").select(resolve_path(folder, F.col("image_path")).alias("source"), target.alias("target"))
        copy_files(local)
    if fetch:
        asked = rows.filter("image_source = 'url'")
        got = fetch_all(asked).filter("content is not null").select(F.col("url").alias("__url"), "content")
        write_files(asked.join(got, F.trim("image_url") == F.col("__url")), target, F.col("content"))
    os.makedirs(given, exist_ok=True)
    seen = read_images(spark, given)
    if as_jpeg:
        place = F.concat(F.lit(f"{final}/"), F.substring_index("origin", f"{name}/", -1))
        seen = write_files(jpeg.normalized(seen), place, F.col("content")).withColumnRenamed("target", "origin")
        delete(spark, given)
    seen = seen.select("origin", "ok")
    there = rows.select("row_id", F.concat(F.lit(f"{final}/"), "row_id", F.lit(".jpg")).alias("__t"))
    return there.join(seen, F.col("__t") == F.col("origin")).select("row_id", "ok")


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="pairmend", description=__doc__)
    stages = parser.add_subparsers(dest="stage", required=True)
    for name, inputs in (("build", ["raw"]), ("simulate", ["rows"]), ("sieve", ["rows"]), ("diagnose", ["sieved"]), ("arbitrate", ["queue"]), ("repair", ["rows", "plan"])):
        stage = stages.add_parser(name)
        for x in inputs:
            stage.add_argument(x)
        stage.add_argument("out", help="a folder" if name in ("sieve", "diagnose", "repair") else "a path")
        if name in ("build", "sieve"):
            stage.add_argument("--config", default=None)
        if name in ("build", "diagnose"):
            stage.add_argument("--images", default=None, help="the folder that image paths are relative to; without it every named image counts as there")
        if name in ("build", "sieve", "diagnose", "repair"):
            stage.add_argument("--root", default=None, help="where rows' image paths start from; build puts images there, sieve and diagnose read them, repair lists and copies them")
        if name == "build":
            stage.add_argument("--fetch", action="store_true", help="fetch the images of rows that name a URL and no file; needs --root")
            stage.add_argument("--jpeg", action="store_true", help="write the images as RGB JPEG of quality 92, whatever they were; needs --root")
        if name == "sieve":
            stage.add_argument("--model", default=None, help="module:function that makes a model of texts and images; needs --root")
        if name in ("diagnose", "repair"):
            stage.add_argument("--position", default=None, help="a column that orders rows of one id; the last one counts")
        if name in ("sieve", "diagnose"):
            stage.add_argument("--embeddings", default=None, help="a table of row_id, text_emb, image_emb; without it the rows carry their vectors")
        if name == "simulate":
            stage.add_argument("--copies-per-row", type=int, default=15)
            stage.add_argument("--noise-rate", type=float, default=0.30)
            stage.add_argument("--partners", choices=("paired", "free"), default="free", help="whom a row swaps its image with: the other of a pair, or any row")
            stage.add_argument("--seed", type=int, default=7)
        if name == "repair":
            stage.add_argument("--semantics", choices=("sequential", "snapshot"), default="sequential")
    a = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("pairmend").getOrCreate()
    settings = config.load(a.config, strict=a.stage == "sieve") if getattr(a, "config", None) else (config.BuildConfig(), config.SieveConfig())
    if a.stage == "build":
        raw = files.read_raw(spark, a.raw)
        images = a.images and images_of(spark, build.normalize(raw), a.images)
        if a.root:
            images = placed(spark, build.normalize(raw), a.images, a.root.rstrip("/"), f"{settings[0].processed_dir}/images", a.fetch, a.jpeg)
        files.write_parquet(build.build(raw, images or None, f"{settings[0].processed_dir}/images"), a.out)
        for told in (build.counters, build.downloads):
            told(spark.read.parquet(a.out)).show()
        spark.read.parquet(a.out).show(1, truncate=False, vertical=True)
    elif a.stage == "simulate":
        noisy = simulate.add_noise(simulate.replicate(spark.read.parquet(a.rows), a.copies_per_row), a.noise_rate, a.seed, partners=a.partners)
        files.write_parquet(noisy, a.out)
        made = spark.read.parquet(a.out)
        simulate.noise_counts(made).show()
        made.select("row_id", "category", "noise_label", "image_path").show(5, truncate=False)
    elif a.stage == "sieve":
        rows = spark.read.parquet(a.rows)
        if a.embeddings:
            rows = rows.drop("text_emb", "image_emb").join(spark.read.parquet(a.embeddings).select("row_id", "text_emb", "image_emb"), "row_id", "left")
        if a.model:
            rows = embedded(spark, rows, a.root, factory_of(a.model), settings[1].batch_size)
        found = sieve.sieve(rows, settings[1])
        files.write_parquet(found, files.artifact("embeddings", a.out, a.rows))
        flat = spark.read.parquet(files.artifact("embeddings", a.out, a.rows)).drop("text_emb", "image_emb")
        files.write_csv(flat, files.artifact("sieve", a.out, a.rows))
        files.write_csv(flat.filter("flagged"), files.artifact("flagged", a.out, a.rows))
        flat.groupBy("flag_reason").count().orderBy("flag_reason").show()
        flat.select("row_id", "category", "sim_score", "sieve_threshold", "threshold_source", "flagged", "flag_reason").show(20, truncate=False)
    elif a.stage == "diagnose":
        sieved = spark.read.parquet(a.sieved)
        found = diagnose.evidence(sieved, a.embeddings and spark.read.parquet(a.embeddings) or None, a.position)
        if a.images or a.root:
            given = "source_image_path" if a.images and "source_image_path" in found.columns else "image_path"
            seen = images_of(spark, found, a.images or a.root, given)
            found = found.join(seen, "row_id", "left").withColumn("image_exists", F.coalesce("ok", F.lit(False))).drop("ok")
        reports = diagnose.diagnose(found)
        files.write_jsonl(reports, files.artifact("reports", a.out, a.sieved))
        files.write_csv(diagnose.queue(reports), files.artifact("queue", a.out, a.sieved))
        queued = files.read_queue(spark, files.artifact("queue", a.out, a.sieved))
        print(f"Flagged rows analyzed: {queued.count()}")
        queued.show(10, truncate=False)
    elif a.stage == "arbitrate":
        files.write_csv(arbitrate.arbitrate(files.read_queue(spark, a.queue)), a.out)
        files.read_plan(spark, a.out).orderBy("step").show(20)
    else:
        rows, root = spark.read.parquet(a.rows), a.root and a.root.rstrip("/")
        there = listing(spark, root, root) if root else None
        fixed, log = repair.repair(rows, files.read_plan(spark, a.plan), there, a.semantics, position=a.position, root=root)
        if root:
            jobs = copy_jobs(fixed).select(*[resolve_path(root, F.col(c)).alias(c) for c in ("source", "target")])
            copy_files(jobs).groupBy("ok").count().show()
        files.write_parquet(fixed, files.artifact("repaired", a.out, a.rows))
        files.write_csv(log.orderBy(F.col("step")), files.artifact("log", a.out, a.rows))
        repair.status_counts(log).show()


if __name__ == "__main__":
    main()
