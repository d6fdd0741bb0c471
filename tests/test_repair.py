import json
from contextlib import contextmanager

import pytest

from pairmend.operators import arbitrate, diagnose, repair

ROW = "row_id string, title string, category string, attributes string, canonical_text string, image_path string"
PLAN = "step long, row_id string, action string, proposed_fix string, notes string"
REPORT_ROW = "row_id string, is_image_missing boolean, is_text_missing boolean, image_exists boolean, own_sim double, best_other_row string, best_other_sim double, margin double, attributes string, title string, img_color string, image_path string"


def swap(cand):
    return json.dumps({"image_replacement_candidate_row_id": cand})


def patch(**given):
    return json.dumps({"text_patch": {k.replace("__", "."): v for k, v in given.items()}})


@pytest.mark.parametrize(
    ("row", "want"),
    [
        ((True, True, False, 0.1, "b", 0.9, "red"), ("Type III", "missing_image", "HUMAN", 0.0, 0.5)),
        ((False, True, False, 0.1, "b", 0.9, "red"), ("Type III", "missing_text", "V2T", 0.7, 0.0)),
        ((False, False, False, 0.1, "b", 0.9, "red"), ("Type III", "missing_image_file", "HUMAN", 0.0, 0.5)),
        ((False, False, True, 0.1, "b", 0.9, "red"), ("Type I", "image_relevance", "T2V", 0.3, 0.8)),
        ((False, False, True, 0.5, "b", 0.51, "red"), ("Type II", "color", "V2T", 0.75, 0.4)),
        ((False, None, True, None, None, None, "red"), ("Type II", "color", "V2T", 0.75, 0.4)),
        ((False, False, True, 0.5, "b", 0.4, "blue"), ("Unknown", "unknown", "HUMAN", 0.5, 0.5)),
        ((False, False, True, 0.5, "b", 0.4, None), ("Unknown", "unknown", "HUMAN", 0.5, 0.5)),
    ],
)
def test_the_first_rule_that_holds_decides(spark, row, want):
    no_image, no_text, exists, own, other, sim, color = row
    rows = spark.createDataFrame([("a", no_image, no_text, exists, own, other, sim, None, '{"color": "Blue"}', None, color, "p.jpg")], REPORT_ROW)
    r = diagnose.diagnose(rows).first()
    assert (r["error_type"], r["mismatch_aspects"][0], r["suggested_direction"], *r["confidence"]) == want


def test_a_margin_of_exactly_the_limit_is_no_swap(spark):
    rows = spark.createDataFrame([("a", False, False, True, 0.0, "b", 0.01, 0.01, "{}", "", "", "p")], REPORT_ROW)
    assert diagnose.diagnose(rows).first()["error_type"] == "Unknown"


def test_retrieval_excludes_the_row_itself(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0], [0.0, 1.0], True, False, False), ("b", [0.0, 1.0], [1.0, 0.0], True, False, False), ("c", None, None, True, True, False)], "row_id string, text_emb array<float>, image_emb array<float>, flagged boolean, is_image_missing boolean, is_text_missing boolean")
    got = {r["row_id"]: r["best_other_row"] for r in diagnose.evidence(rows).collect()}
    assert got == {"a": "b", "b": "a", "c": None}
    alone = diagnose.evidence(rows.filter("row_id = 'a'")).first()
    assert alone["best_other_row"] is None and alone["own_sim"] == pytest.approx(0.0)


@pytest.mark.parametrize(
    ("direction", "fix", "want"),
    [
        (" t2v ", swap("7"), ("replace_image_from_row", 1, 1.0, "Replace image using candidate row 7")),
        ("T2V", "{}", ("t2v_generate_image_unimplemented", 3, 10.0, "Would require generative T2V editing; not implemented in MVP.")),
        ("T2V", "[]", ("t2v_generate_image_unimplemented", 3, 10.0, "Would require generative T2V editing; not implemented in MVP.")),
        ("V2T", patch(title="x"), ("apply_text_patch", 1, 0.5, "Apply text_patch to row fields/attributes.")),
        ("V2T", None, ("v2t_generate_text_unimplemented", 2, 4.0, "Would require VLM-based text generation; not implemented in MVP.")),
        ("HUMAN", swap("7"), ("human_review", 0, 0.0, "Low confidence or missing modalities.")),
        (None, None, ("human_review", 0, 0.0, "Low confidence or missing modalities.")),
    ],
)
def test_arbitration(spark, direction, fix, want):
    q = spark.createDataFrame([("1", "e", direction, "a", 0.1, 0.2, fix)], "row_id string, error_type string, suggested_direction string, mismatch_aspects string, image_trust double, text_trust double, proposed_fix string")
    p = arbitrate.arbitrate(q).first()
    assert (p["action"], p["tier"], p["cost_units"], p["notes"]) == want and p["step"] == 0


def test_an_empty_queue_gives_an_empty_plan_and_log(spark):
    q = spark.createDataFrame([], "row_id string, error_type string, suggested_direction string, mismatch_aspects string, image_trust double, text_trust double, proposed_fix string")
    plan = arbitrate.arbitrate(q)
    rows = spark.createDataFrame([("a", "t", "c", "{}", "x", "p")], ROW)
    fixed, log = repair.repair(rows, plan)
    assert plan.collect() == [] and log.collect() == [] and fixed.first()["repaired"] is False


def rows_of(spark, names, **paths):
    return spark.createDataFrame([(n, f"T{n}", "C", "{}", "old", paths.get(n, f"{n}.png")) for n in names], ROW)


def test_sequence_and_snapshot(spark):
    plan = spark.createDataFrame([(k, row, "replace_image_from_row", swap(cand), "n") for k, (row, cand) in enumerate([("A", "B"), ("B", "A"), ("C", "A"), ("D", "C")])], PLAN)
    origins = lambda how: {r["row_id"]: r["image_origin_row_id"] for r in repair.repair(rows_of(spark, "ABCD"), plan, semantics=how)[0].collect()}
    assert origins("sequential") == dict.fromkeys("ABCD", "B")
    assert origins("snapshot") == {"A": "B", "B": "A", "C": "A", "D": "C"}


def fold(names, paths, plan):
    """One step after the other, on plain dictionaries."""
    image = {n: (n if paths.get(n, "x") else None) for n in names}
    moved, log = {}, []
    for step, row, cand in plan:
        if row not in image:
            log.append((step, "fail", "row_id_not_found"))
        elif cand not in image:
            log.append((step, "fail", "candidate_missing_or_not_found"))
        elif image[cand] is None:
            log.append((step, "fail", "candidate_has_no_image_path"))
        elif cand == row and row in moved:
            log.append((step, "fail", f"exception:SameFileError:{repair.IMAGES}/{row}.jpg"))
        else:
            image[row] = moved[row] = image[cand]
            log.append((step, "ok", ""))
    return moved, log


@pytest.mark.parametrize("seed", range(4))
def test_sequence_is_the_fold(spark, seed):
    import random

    rng = random.Random(seed)
    names, paths = "ABCDEF", {"E": "", "F": ""}
    plan = [(k, rng.choice(names + "?"), rng.choice(names + "!")) for k in range(25)]
    df = spark.createDataFrame([(k, row, "replace_image_from_row", swap(cand), "") for k, row, cand in plan], PLAN)
    fixed, log = repair.repair(rows_of(spark, names, **paths), df)
    moved, want = fold(names, paths, plan)
    assert {r["row_id"]: r["image_origin_row_id"] for r in fixed.collect() if r["image_origin_row_id"]} == moved
    assert [(r["step"], r["status"], r["reason"]) for r in log.orderBy("step").collect()] == want


def test_text_patches(spark):
    steps = [("apply_text_patch", patch(attributes__color="blue", category="NEW", nothing="1")), ("apply_text_patch", patch(title="X", attributes__a__b="1", canonical_text="lost"))]
    plan = spark.createDataFrame([(k, "A", action, fix, f"n{k}") for k, (action, fix) in enumerate(steps)], PLAN)
    rows = spark.createDataFrame([("A", "T", "C", '{"color": "red", "z": 1}', "old", "p"), ("B", "T", "C", "{}", "old", "p")], ROW)
    got = {r["row_id"]: r for r in repair.repair(rows, plan)[0].collect()}
    a = got["A"]
    assert (a["title"], a["category"], a["repaired"], a["repair_notes"], a["repair_source_row_id"]) == ("X", "NEW", True, "n1", "")
    assert json.loads(a["attributes"]) == {"color": "blue", "z": 1, "a.b": "1"} and list(json.loads(a["attributes"])) == ["color", "z", "a.b"]
    assert a["canonical_text"] == "X. Category: NEW. Attributes: color=blue, z=1, a.b=1."
    first = repair.repair(rows, plan.filter("step = 0"))[0].filter("row_id = 'A'").first()
    assert first["category"] == "NEW" and first["canonical_text"].startswith("T. Category: C.")
    assert got["B"]["canonical_text"] == "old" and got["B"]["repaired"] is False


def test_patched_attributes_keep_their_types(spark):
    fix = json.dumps({"text_patch": {"attributes.n": 5, "attributes.ok": False, "attributes.none": None, "title": 7}})
    plan = spark.createDataFrame([(0, "A", "apply_text_patch", fix, "n")], PLAN)
    rows = spark.createDataFrame([("A", "T", "C", '{"z": 1.5, "n": "x"}', "old", "p")], ROW)
    a = repair.repair(rows, plan)[0].first()
    assert a["attributes"] == '{"z":1.5,"n":5,"ok":false,"none":null}' and a["title"] == "7"
    assert a["canonical_text"] == "7. Category: C. Attributes: z=1.5, n=5, ok=false, none=None."


def test_log_reasons_and_reviews(spark):
    steps = [("?", "human_review", "{}"), ("A", "apply_text_patch", "{}"), ("A", "apply_text_patch", '{"text_patch": 3}'), ("A", "what", "{}"), ("A", "replace_image_from_row", swap("gone")), ("A", "replace_image_from_row", swap("B")), ("A", "replace_image_from_row", swap("C")), ("A", "apply_text_patch", patch(title="x")), ("A", "human_review", "{}")]
    plan = spark.createDataFrame([(k, *s, "n") for k, s in enumerate(steps)], PLAN)
    listed = spark.createDataFrame([("A.png",)], "path string")
    fixed, log = repair.repair(rows_of(spark, "ABC", B=""), plan, existing=listed)
    assert [(r["status"], r["reason"]) for r in log.orderBy("step").collect()] == [
        ("fail", "row_id_not_found"), ("fail", "missing_text_patch"), ("fail", "missing_text_patch"), ("skip", "action_not_supported:what"), ("fail", "candidate_missing_or_not_found"),
        ("fail", "candidate_has_no_image_path"), ("fail", "candidate_image_file_missing:C.png"), ("ok", ""), ("ok", ""),
    ]
    a = fixed.filter("row_id = 'A'").first()
    assert a["repaired"] is False and a["repair_action"] == "human_review" and a["title"] == "x"
    assert {r["status"]: r["n"] for r in repair.status_counts(log).collect()} == {"fail": 6, "ok": 2, "skip": 1}


def test_the_last_of_repeated_rows_is_repaired(spark):
    rows = spark.createDataFrame([("A", "1", "C", "{}", "x", "p", 1), ("A", "2", "C", "{}", "x", "p", 2)], ROW + ", pos int")
    plan = spark.createDataFrame([(0, "A", "apply_text_patch", patch(title="new"), "")], PLAN)
    got = repair.repair(rows, plan, position="pos")[0].orderBy("pos").collect()
    assert [r["title"] for r in got] == ["1", "new"]


def test_the_last_of_repeated_vectors_asks(spark):
    rows = [("a", [1.0, 0.0], [1.0, 0.0], 1), ("a", [0.0, 1.0], [1.0, 0.0], 2), ("b", [1.0, 0.0], [0.0, 1.0], 3)]
    vectors = spark.createDataFrame(rows, "row_id string, text_emb array<float>, image_emb array<float>, pos int")
    sieved = spark.createDataFrame([("a", True, False, False)], "row_id string, flagged boolean, is_image_missing boolean, is_text_missing boolean")
    got = diagnose.evidence(sieved, vectors, "pos").collect()
    assert [(r["own_sim"], r["best_other_row"], r["best_other_sim"]) for r in got] == [(0.0, "b", pytest.approx(1.0))]


def test_an_image_is_not_copied_onto_itself(spark):
    rows = rows_of(spark, "AB", A=f"{repair.IMAGES}/A.jpg", B=f"{repair.IMAGES}/A.jpg")
    plan = spark.createDataFrame([(0, "A", "replace_image_from_row", swap("A"), ""), (1, "A", "replace_image_from_row", swap("B"), ""), (2, "B", "replace_image_from_row", swap("A"), "")], PLAN)
    fixed, log = repair.repair(rows, plan)
    same = ("fail", f"exception:SameFileError:{repair.IMAGES}/A.jpg")
    assert [(r["status"], r["reason"]) for r in log.orderBy("step").collect()] == [same, same, ("ok", "")]
    assert {r["row_id"]: r["repaired"] for r in fixed.collect()} == {"A": False, "B": True}


def whole_fold(names, paths, files, plan):
    """The plan step after step on plain dictionaries: paths of rows, what each file shows (None: files are not looked at), and the log."""
    target = lambda n: f"{repair.IMAGES}/{n}.jpg"
    path, shows, origin, log, open_ = dict(paths), {}, {}, [], files is None
    for step, row, action, arg in plan:
        if row not in path:
            log.append((step, "fail", "row_id_not_found"))
        elif action == "patch":
            path[row] = arg
            log.append((step, "ok", ""))
        elif arg not in path:
            log.append((step, "fail", "candidate_missing_or_not_found"))
        else:
            src, dst = path[arg].strip(), target(row)
            if not src:
                log.append((step, "fail", "candidate_has_no_image_path"))
            elif not (open_ or src in files or src in shows):
                log.append((step, "fail", f"candidate_image_file_missing:{src}"))
            elif src == dst:
                log.append((step, "fail", f"exception:SameFileError:{src}"))
            else:
                shows[dst] = shows.get(src, (arg, src))
                path[row], origin[row] = dst, shows[dst]
                log.append((step, "ok", ""))
    return path, origin, log


def folded(spark, names, paths, files, plan, **how):
    rows = spark.createDataFrame([(n, f"T{n}", "C", "{}", "old", paths[n]) for n in names], ROW)
    action = {"copy": ("replace_image_from_row", swap), "patch": ("apply_text_patch", lambda v: patch(image_path=v))}
    df = spark.createDataFrame([(k, row, action[a][0], action[a][1](arg), "") for k, row, a, arg in plan], PLAN)
    listed = None if files is None else spark.createDataFrame([(f,) for f in files] or [("none",)], "path string")
    fixed, log = repair.repair(rows, df, existing=listed, **how)
    got = fixed.collect()
    return (
        {r["row_id"]: r["image_path"] for r in got}, {r["row_id"]: (r["image_origin_row_id"], r["image_origin_path"]) for r in got if r["image_origin_row_id"]},
        [(r["step"], r["status"], r["reason"]) for r in log.orderBy("step").collect()],
    )


def test_copies_onto_themselves_after_a_change(spark):
    plan = [(0, "A", "copy", "A"), (1, "A", "copy", "A"), (2, "B", "copy", "A"), (3, "B", "copy", "B")]
    path, origin, log = folded(spark, "AB", {"A": "A.png", "B": "B.png"}, None, plan)
    same = "exception:SameFileError:" + repair.IMAGES
    assert log == [(0, "ok", ""), (1, "fail", f"{same}/A.jpg"), (2, "ok", ""), (3, "fail", f"{same}/B.jpg")]
    assert origin == {"A": ("A", "A.png"), "B": ("A", "A.png")} and path["B"] == f"{repair.IMAGES}/B.jpg"
    rows = spark.createDataFrame([("A", "T", "C", "{}", "old", "A.png")], ROW)
    df = spark.createDataFrame([(k, "A", "replace_image_from_row", swap("A"), "") for k in range(2)], PLAN)
    where = f"PosixPath('/data/{repair.IMAGES}/A.jpg')"
    assert repair.repair(rows, df, root="/data")[1].filter("step = 1").first()["reason"] == f"exception:SameFileError:{where} and {where} are the same file"


@pytest.mark.parametrize("listed", [True, False])
def test_paths_and_files_are_those_of_the_fold(spark, listed):
    """Patched paths, files that a step makes before another reads them, rows that lie where copies go, copies onto themselves: eight groups of rows."""
    import random

    rng, paths, files, plan = random.Random(listed), {}, set(), []
    for group in range(8):
        names = [f"{x}{group}" for x in "ABCDEFG"]
        where = ["", f"x{group}.png", "gone.png", *(f"{repair.IMAGES}/{n}.jpg" for n in (names[0], names[1], f"H{group}"))]
        paths |= {n: rng.choice(where) if n[0] in "CDEFG" else f"{n}.png" for n in names}
        files |= {where[1], f"A{group}.png", f"B{group}.png", *rng.sample(where[3:], 1)}
        for _ in range(40):
            row = rng.choice([*names, "?"])
            plan.append((rng.random(), row, "patch", rng.choice(where)) if group % 2 and rng.random() < 0.2 else (rng.random(), row, "copy", rng.choice([row, *names, "!"])))
    plan = [(k, *step[1:]) for k, step in enumerate(sorted(plan))]
    want = whole_fold(list(paths), paths, files if listed else None, plan)
    got = folded(spark, list(paths), paths, files if listed else None, plan)
    assert got[2] == want[2] and got[1] == want[1] and got[0] == want[0]


@pytest.mark.parametrize("first", ["r0.png", ""])
def test_rounds_grow_with_the_logarithm_of_a_chain(spark, monkeypatch, first):
    """1,000 rows without a path, each copied from the one before; the first has a path, or hasn't."""
    rounds, real = [], repair.kept

    @contextmanager
    def counted(spark):
        with real(spark) as keep:
            yield lambda df: rounds.append(1) or keep(df)

    monkeypatch.setattr(repair, "kept", counted)
    n = 1000
    names = [f"r{k}" for k in range(n + 1)]
    paths = dict.fromkeys(names, "") | {"r0": first}
    plan = [(k, names[k + 1], "copy", names[k]) for k in range(n)]
    path, origin, log = folded(spark, names, paths, None, plan)
    assert {s for _, s, _ in log} == {"ok" if first else "fail"}
    assert origin == ({x: ("r0", "r0.png") for x in names[1:]} if first else {})
    assert len(rounds) < 30


def test_a_candidate_that_many_steps_name(spark, monkeypatch):
    """One row is the candidate of all steps but a few that replace it; look-ups go stretch by stretch of steps."""
    look = repair.last_before
    monkeypatch.setattr(repair, "last_before", lambda asked, events: look(asked, events, stretch=64))
    names = ["hot", "p", "q", *(f"n{k}" for k in range(300))]
    paths = {n: f"{n}.png" for n in names}
    plan = [(k, "hot", "copy", "pq"[k // 97 % 2]) if k % 97 == 50 else (k, f"n{k % 300}", "copy", "hot") for k in range(900)]
    assert folded(spark, names, paths, None, plan) == whole_fold(names, paths, None, plan)


def test_candidates_that_no_table_has(spark, tmp_path):
    """Rows a million apart: the query's missing candidates are missing however many parts there are."""
    from pairmend.plans import queries

    parts = [(k, f"n{k}", "b", "t", 1) for k in (3, 1_000_003, 4, 10)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r["status"], r["reason"]): r["n"] for r in queries.repair_status_counts(spark, str(tmp_path)).collect()}
    assert got == {("fail", "candidate_missing_or_not_found"): 2, ("ok", ""): 1, ("fail", "candidate_has_no_image_path"): 1, ("fail", "all"): 3, ("ok", "all"): 1}


def test_steps_are_dealt_out_before_their_json_is_read(spark):
    """A small file of parts gives many steps; they don't all go through the task that reads it."""
    from pairmend.plans import queries

    plan = queries._changing_paths(spark, "/root/testdata/sf0.01")[1]
    assert plan.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_no_candidate_is_missing_even_if_a_row_has_no_id(spark):
    rows = spark.createDataFrame([("", "T", "C", "{}", "old", "p.png"), ("A", "T", "C", "{}", "old", "A.png")], ROW)
    plan = spark.createDataFrame([(0, "A", "replace_image_from_row", swap(""), "")], PLAN)
    assert [(r["status"], r["reason"]) for r in repair.repair(rows, plan)[1].collect()] == [("fail", "candidate_missing_or_not_found")]
