"""The registered queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmend.config import SieveConfig
from pairmend.functions.colors import nearest_color
from pairmend.functions.text import canonical_text, first_color, json_map
from pairmend.operators import arbitrate, build, diagnose, repair, simulate
from pairmend.operators import sieve as S
from pairmend.operators.quantiles import exact_quantiles
from pairmend.operators.retrieval import best_other
from pairmend.plans.fixtures import catalog, pairs, plain_catalog, table
from pairmend.plans.oracles import ORACLES
from pairmend.sources.images import pixel_colors
from pairmend.sources.shared import settle


def _r6(c: str):
    return F.round(c, 6).alias(c)


def pair_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.score(pairs(spark, sf_dir)).select("row_id", "category", _r6("sim_score"))


def sieve_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.category_thresholds(settle(S.score(pairs(spark, sf_dir))))
    return found.select("category", "n_scored", _r6("sieve_threshold"), "threshold_source")


def sieve_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.category_thresholds(settle(S.score(pairs(spark, sf_dir))), SieveConfig(threshold_method="quantile"))
    return found.select("category", "n_scored", _r6("sieve_threshold"), "threshold_source")


def sieve_global_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.global_threshold(settle(S.score(pairs(spark, sf_dir))), SieveConfig(global_threshold_method="iqr"))
    return found.select(_r6("global_threshold"))


def sieve_global_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "source").alias("category"), F.col("n_chars").cast("double").alias("sim_score"))
    found = S.category_thresholds(rows, replace(SieveConfig(), iqr_k=1.0))
    return found.select("category", "n_scored", _r6("sieve_threshold"), "threshold_source")


def _sieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(S.sieve(settle(S.score(pairs(spark, sf_dir)))))


def sieve_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.sieve(settle(S.score(pairs(spark, sf_dir))))
    return S.summary(found.withColumns({c: F.round(c, 6) for c in ("sim_score", "sieve_threshold")}))


def flag_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.sieve(settle(S.score(pairs(spark, sf_dir))))
    return found.groupBy("flag_reason").agg(F.count("*").alias("n"), F.count_if("flagged").alias("n_flagged"))


def threshold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    found = exact_quantiles(rows, "l_returnflag", "l_extendedprice", [0.05, 0.25, 0.75])
    return found.select("l_returnflag", "n", _r6("q0"), _r6("q1"), _r6("q2"))


def embedding_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.export_embeddings(_sieved(spark, sf_dir), 48)
    size = lambda c: F.size(c).cast("long")
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double")), 4)
    return out.select(
        "row_id", size("text_emb").alias("n_text"), size("image_emb").alias("n_image"), total("text_emb").alias("text_sum"), total("image_emb").alias("image_sum"),
        F.round(F.col("sim_score").cast("double"), 4).alias("sim_score"), F.col("flagged").cast("long").alias("flagged"),
    )


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(diagnose.evidence(_sieved(spark, sf_dir)))


def retrieve_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).filter("best_other_row is not null").select("row_id", "best_other_row", _r6("own_sim"), _r6("best_other_sim"))


def retrieve_every_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best other text of every row's image, by blocks that bounds leave over."""
    rows = settle(pairs(spark, sf_dir))
    found = best_other(rows, rows, block=200, cell=50)
    return found.select("row_id", "best_other_row", _r6("best_other_sim"))


def diagnose_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = diagnose.diagnose(_evidence(spark, sf_dir))
    return r.select(
        "row_id", "error_type", F.array_join("mismatch_aspects", ",").alias("mismatch_aspects"), "suggested_direction",
        F.col("confidence.image_trust").alias("image_trust"), F.col("confidence.text_trust").alias("text_trust"),
        F.col("proposed_fix.image_replacement_candidate_row_id").alias("candidate"), F.col("proposed_fix.text_patch")["title"].alias("new_title"),
        "notes", F.round("debug.margin", 6).alias("margin"),
    )


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arbitrate.arbitrate(diagnose.queue(diagnose.diagnose(_evidence(spark, sf_dir))))


def arbiter_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = diagnose.queue(diagnose.diagnose(_evidence(spark, sf_dir)))
    return q.withColumn("candidate", arbitrate.candidate("proposed_fix")).drop("proposed_fix")


def arbiter_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).withColumn("tier", F.col("tier").cast("long")).drop("proposed_fix")


def plan_cost_by_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arbitrate.cost_by_action(_plan(spark, sf_dir)).withColumn("tier", F.col("tier").cast("long"))


def _repaired(spark: SparkSession, sf_dir: str, semantics: str) -> DataFrame:
    fixed, _ = repair.repair(pairs(spark, sf_dir).drop("text_emb", "image_emb"), _plan(spark, sf_dir), semantics=semantics)
    return fixed.select("row_id", "title", "canonical_text", "image_path", "repaired", "repair_action", "repair_notes", "repair_source_row_id", "image_origin_row_id")


def repair_images_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repaired(spark, sf_dir, "sequential")


def repair_images_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repaired(spark, sf_dir, "snapshot")


def repair_log_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan from orders: replacements, patches, reviews, unknown actions, rows and candidates."""
    rows = plain_catalog(spark, sf_dir)
    k = F.col("o_orderkey")
    action = F.element_at(F.array(*map(F.lit, ("replace_image_from_row", "apply_text_patch", "human_review", "t2v_generate_image_unimplemented", "replace_image_from_row"))), (k % 5 + 1).cast("int"))
    fix = F.when(k % 5 == 0, F.concat(F.lit('{"image_replacement_candidate_row_id": "'), (F.col("o_custkey") * 2).cast("string"), F.lit('"}'))).when((k % 5 == 1) & (k % 2 == 0), F.lit('{"text_patch": {"title": "x"}}')).otherwise(F.lit("{}"))
    plan = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("row_id"), action.alias("action"), fix.alias("proposed_fix"), F.lit("").alias("notes"), k.alias("step"))
    logged = repair.log(repair.log_of(rows.withColumn("__pos", F.lit(0)), plan))
    return logged.groupBy("action", "status", "reason").agg(F.count("*").alias("n"))


def text_patch_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two patches for every third row, one of which sets a category."""
    rows = plain_catalog(spark, sf_dir)
    k = F.col("row_id").cast("long")
    fixes = F.array(F.lit('{"text_patch": {"attributes.color": "blue", "category": "NEW"}}'), F.lit('{"text_patch": {"title": "patched", "attributes.a.b": "1"}}'))
    plan = rows.filter(k % 3 == 0).select("row_id", F.posexplode(fixes).alias("n", "proposed_fix"), k.alias("k"))
    plan = plan.select("row_id", F.lit("apply_text_patch").alias("action"), "proposed_fix", F.lit("p").alias("notes"), (F.col("k") * 2 + F.col("n")).alias("step"))
    fixed, _ = repair.repair(rows, plan)
    return fixed.select("row_id", "title", "category", "canonical_text", "repaired", "repair_action", "repair_notes")


def canonical_text_of_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.build(catalog(spark, sf_dir)).select("row_id", "canonical_text")


def typed_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.build(catalog(spark, sf_dir)).select("row_id", "attributes")


def json_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select("event_id", canonical_text(F.col("event_type"), F.lit("event"), json_map("props")).alias("canonical_text"))


def missing_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.build(catalog(spark, sf_dir)).select("row_id", "title", "image_path", "is_image_missing", "is_text_missing")


def build_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.counters(build.build(catalog(spark, sf_dir)))


def build_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.downloads(build.build(catalog(spark, sf_dir)))


def image_source_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.image_source(build.normalize(catalog(spark, sf_dir))).groupBy("image_source").agg(F.count("*").alias("n"))


def image_listing_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that a listing holds and could be read: every third row's, but for every ninth."""
    listed = catalog(spark, sf_dir).select("row_id", F.substring("row_id", 2, 20).cast("long").alias("k")).filter("k % 3 = 0").select("row_id", (F.col("k") % 9 != 0).alias("ok"))
    return build.build(catalog(spark, sf_dir), listed).select("row_id", "image_path", "is_image_missing")


def text_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", first_color(F.col("p_name")).alias("color"))


def nearest_color_of_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    channel = lambda m, a: ((F.col("p_partkey") * m + a) % 256).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", nearest_color(channel(37, 11), channel(91, 5), channel(53, 77)).alias("color"))


def dominant_pixel_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as pixels of their parts' pictures, a supplier a picture."""
    channel = lambda m, a: ((F.col("l_partkey") * m + F.col("l_linenumber") * a) % 256).alias
    pixels = table(spark, sf_dir, "lineitem").select("l_suppkey", channel(3, 17)("red"), channel(5, 29)("green"), channel(7, 41)("blue"))
    out = pixel_colors(pixels, "l_suppkey")
    return out.select("l_suppkey", *[F.col(c).cast("long").alias(c) for c in ("red", "green", "blue")], "img_color")


def replicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("title"))
    return simulate.replicate(rows, 15)


def noise_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each kind the simulator makes, and that all images are still there."""
    noisy = simulate.add_noise(simulate.replicate(plain_catalog(spark, sf_dir), 15))
    return noisy.groupBy((F.col("noise_label") != "clean").alias("noisy")).agg(F.count("*").alias("n"))


def noise_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.add_noise(simulate.replicate(plain_catalog(spark, sf_dir), 15))


def noise_free_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whose image each part has after three of ten parts exchanged theirs with any other, in turn."""
    parts = table(spark, sf_dir, "part").select("p_partkey")
    n, k = parts.count(), F.col("p_partkey")
    swaps = parts.filter(k < n * 3 // 10).select(k.alias("step"), ((k * 7919 + 5) % n).alias("a"), ((k * k * 31 + k * 104729 + 13) % n).alias("b"))
    moved = simulate.exchanged(swaps)
    return parts.join(moved, k == F.col("position"), "left").select("p_partkey", F.coalesce("origin", k).alias("origin"))


def noise_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for noisy rows whatever is drawn: no image lost or doubled, no colour kept, no clean row touched."""
    rows = simulate.replicate(plain_catalog(spark, sf_dir), 15)
    noisy = simulate.add_noise(rows).withColumn("noisy_there", F.lit(True))
    before = rows.select("row_id", F.col("image_path").alias("i"), F.col("attributes").alias("a"), F.col("canonical_text").alias("t"), F.lit(True).alias("there"))
    # Sizes are estimated by part's file, which says nothing about copies: without the hint they may be broadcast.
    both = noisy.join(before.hint("merge"), "row_id", "full")
    color = lambda c: F.get_json_object(c, "$.color")
    swapped, mutated = F.col("noise_label") == "swap_image", F.col("noise_label") == "mutate_text"
    text = canonical_text(F.col("title"), F.col("category"), json_map("attributes"))
    met = F.col("there") & F.col("noisy_there")
    facts = {
        "rows": met, "noisy": met & (swapped | mutated),
        "colors_kept": met & mutated & (color("attributes").eqNullSafe(color("a")) | ~color("attributes").isin(*simulate.NOISE_COLORS)),
        "texts_wrong": met & mutated & (F.col("canonical_text") != text),
        "others_touched": met & ((~mutated & ((F.col("attributes") != F.col("a")) | (F.col("canonical_text") != F.col("t")))) | (~swapped & (F.col("image_path") != F.col("i")))),
    }
    one = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    after = F.struct(F.col("image_path").alias("image"), one(F.col("noisy_there")).alias("n"), *[one(c).alias(name) for name, c in facts.items()])
    given = F.struct(F.col("i").alias("image"), (-one(F.col("there"))).alias("n"), *[F.lit(0).cast("long").alias(name) for name in facts])
    images = both.select(F.inline(F.array(after, given))).groupBy("image").agg(F.sum("n").alias("n"), *[F.sum(name).alias(name) for name in facts])
    return images.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in facts], F.count_if(F.col("n") != 0).alias("images_lost"))


def _catalog_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports on catalog rows with images of made colours: all rules but the swap."""
    k = F.col("row_id").cast("long")
    channel = lambda m, a: ((k * m + a) % 256).cast("int")
    rgb = F.array(channel(37, 11), channel(91, 5), channel(53, 77))
    rows = plain_catalog(spark, sf_dir).withColumns({
        "is_image_missing": k % 13 == 0, "is_text_missing": k % 11 == 0, "image_exists": k % 7 != 0, "img_rgb": rgb,
        "img_color": nearest_color(channel(37, 11), channel(91, 5), channel(53, 77)),
    })
    return diagnose.diagnose(rows)


def diagnose_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, fix = _catalog_reports(spark, sf_dir), F.col("proposed_fix")
    return r.select(
        "row_id", "error_type", F.array_join("mismatch_aspects", ",").alias("mismatch_aspects"), "suggested_direction", "notes",
        F.col("confidence.image_trust").alias("image_trust"), F.col("confidence.text_trust").alias("text_trust"),
        fix["text_patch"]["attributes.color"].alias("new_color"), fix["text_patch"]["title"].alias("new_title"), fix["text_color"].alias("text_color"),
        F.array_join(fix["observed_image_rgb"], ",").alias("rgb"),
    )


def queue_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixes of a queue, as the JSON that the arbiter reads."""
    q = diagnose.queue(_catalog_reports(spark, sf_dir))
    return q.select("row_id", "image_trust", "text_trust", "proposed_fix")


def arbiter_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue from orders with every direction, with and without a fix, and fixes that are no objects."""
    k = F.col("o_orderkey")
    direction = F.element_at(F.array(*map(F.lit, ("t2v", " V2T ", "HUMAN", "", "T2V", "V2T"))), (k % 6 + 1).cast("int"))
    fix = F.when(k % 4 == 0, F.concat(F.lit('{"image_replacement_candidate_row_id": '), F.col("o_custkey").cast("string"), F.lit("}"))).when(k % 4 == 1, '{"text_patch": {"title": "t"}}').when(k % 4 == 2, "[1]").otherwise("")
    queue = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("row_id"), F.lit("E").alias("error_type"), F.lit("a").alias("mismatch_aspects"), direction.alias("suggested_direction"), fix.alias("proposed_fix"), k.alias("k"))
    plan = arbitrate.arbitrate(queue, "k")
    return plan.select("row_id", "action", F.col("tier").cast("long").alias("tier"), "cost_units", "notes", "step")


def repair_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacements from a row without an image, one whose file is gone, the row itself where the copy would go, and others."""
    rows = plain_catalog(spark, sf_dir)
    k = F.col("row_id").cast("long")
    path = F.when(k % 5 == 0, "").when(k % 5 == 1, F.concat(F.lit(repair.IMAGES + "/"), "row_id", F.lit(".jpg"))).otherwise(F.col("image_path"))
    rows = rows.withColumn("image_path", path).withColumn("__pos", F.lit(0))
    listed = rows.filter(k % 5 != 2).select(F.col("image_path").alias("path")).filter("path <> ''")
    fix = F.concat(F.lit('{"image_replacement_candidate_row_id": "'), F.when(k % 5 < 3, F.col("row_id")).otherwise(F.concat(F.lit("no-"), "row_id")), F.lit('"}'))
    action = F.when(k % 5 == 4, "human_review").otherwise("replace_image_from_row")
    plan = rows.select("row_id", action.alias("action"), fix.alias("proposed_fix"), F.lit("").alias("notes"), k.alias("step"))
    logged = repair.log(repair.log_of(rows, plan, listed))
    kinds = logged.withColumn("reason", F.regexp_replace("reason", ":[^:]*$", "")).groupBy("status", "reason").agg(F.count("*").alias("n"))
    totals = repair.status_counts(logged).select("status", F.lit("all").alias("reason"), "n")
    return kinds.union(totals)


def _changing_paths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, plan and listing: ten rounds over groups of four parts, with copies onto themselves, patched paths and files that steps make."""
    p = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 4).alias("g"), (F.col("p_partkey") % 4).alias("slot"), "p_name", "p_type")
    name = lambda slot: F.concat(F.col("g").cast("string"), F.lit("-"), slot.cast("string"))
    put = lambda slot: F.concat(F.lit(repair.IMAGES + "/"), name(slot), F.lit(".jpg"))
    slot = F.col("slot")
    path = F.when(slot == 3, "").when((slot == 2) & (F.col("g") % 2 == 0), put(F.lit(0))).otherwise(F.concat(F.lit("images/"), name(slot), F.lit(".jpg")))
    rows = p.select(name(slot).alias("row_id"), F.col("p_name").alias("title"), F.col("p_type").alias("category"), F.lit("{}").alias("attributes"), F.lit("").alias("canonical_text"), path.alias("image_path"), slot.alias("slot"), "g")
    listed = rows.filter((slot < 2) | ((slot == 2) & (F.col("g") % 3 != 0))).select(F.col("image_path").alias("path"))
    groups = rows.filter("slot = 0").select("g")
    n, many = F.col("n"), groups.count()
    # A group gives ten steps with JSON to write and read, so few tasks over a small file would take long.
    spread = groups.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "g")
    steps = spread.select("g", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("n"))
    row, cand = (F.col("g") * 7 + n * 3 + F.floor(n / 4)) % 4, (F.col("g") * 5 + n * n + F.floor(n / 3)) % 4
    to = F.when((F.col("g") + n) % 12 == 5, put(F.lit(1))).otherwise("images/gone.jpg")
    patches = (F.col("g") + n) % 6 == 5
    fix = F.when(patches, F.to_json(F.struct(F.struct(to.alias("image_path")).alias("text_patch")))).otherwise(F.to_json(F.struct(name(cand).alias("image_replacement_candidate_row_id"))))
    action = F.when(patches, "apply_text_patch").otherwise("replace_image_from_row")
    plan = steps.select((n * many + F.col("g")).alias("step"), name(row).alias("row_id"), action.alias("action"), fix.alias("proposed_fix"), F.lit("n").alias("notes"))
    return rows.drop("slot", "g"), plan, listed


def repair_changing_paths_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, plan, listed = _changing_paths(spark, sf_dir)
    return repair.repair(rows, plan, listed, root="/data")[1].select("step", "row_id", "status", "reason")


def repair_changing_paths_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, plan, listed = _changing_paths(spark, sf_dir)
    return repair.repair(rows, plan, listed)[0].select("row_id", "image_path", "repaired", "repair_action", "repair_source_row_id", "image_origin_row_id", "image_origin_path")


def dedup_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose.last_of_each(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        pair_cosine, sieve_iqr, sieve_quantile, sieve_global_iqr, sieve_global_fallback, sieve_flags, flag_reason_counts, threshold_table, embedding_export,
        retrieve_top1, retrieve_every_image, diagnose_reports, arbiter_queue, arbiter_plan, plan_cost_by_action, repair_images_sequential, repair_images_snapshot, repair_log_status,
        text_patch_apply, canonical_text_of_part, typed_attributes, json_attributes, missing_flags, build_counters, build_downloads, image_source_resolution, image_listing_join, text_color,
        nearest_color_of_part, dominant_pixel_colors, replicate_rows, noise_sample, noise_rows, noise_free_partners, noise_invariants, diagnose_catalog, queue_fixes, arbiter_actions,
        repair_status_counts, repair_changing_paths_log, repair_changing_paths_rows, dedup_last_wins,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
