"""The same queries in SQL that DuckDB runs."""

from __future__ import annotations

from pairmend.functions.colors import PROTOTYPES
from pairmend.functions.text import BASIC_COLORS

_PAIRS = """
e AS (SELECT vec_id AS i, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
size AS (SELECT count(*) AS n FROM e),
clean AS (
  SELECT a.i, a.v, a.label, [a.v[k] + 0.5::DOUBLE * b.v[k] for k in range(1, len(a.v) + 1)] AS image
  FROM e a CROSS JOIN size JOIN e b ON b.i = (7 * a.i + 3) % size.n),
pairs AS (
  SELECT CAST(c.i AS VARCHAR) AS row_id, CAST(c.label AS VARCHAR) AS category, c.i % 50 = 0 AS no_image, c.i % 50 = 1 AS no_text,
         c.v AS t, p.image AS im
  FROM clean c JOIN clean p ON p.i = CASE WHEN c.i % 20 = 4 THEN c.i + 1 WHEN c.i % 20 = 5 THEN c.i - 1 ELSE c.i END),
scored AS (SELECT *, CASE WHEN NOT no_image THEN list_cosine_similarity(t, im) END AS sim FROM pairs)"""

_FLAGS = f"""{_PAIRS},
overall AS (SELECT quantile_cont(sim, 0.10) AS g FROM scored),
fences AS (
  SELECT category, count(sim) AS n_scored, quantile_cont(sim, 0.25) AS a, quantile_cont(sim, 0.75) AS b, quantile_cont(sim, 0.05) AS q
  FROM scored WHERE sim IS NOT NULL GROUP BY category),
flags AS (
  SELECT s.*, CASE WHEN n_scored < 8 THEN g ELSE a - 1.5 * (b - a) END AS thr, CASE WHEN n_scored < 8 THEN 'global' ELSE 'category' END AS source
  FROM scored s CROSS JOIN overall LEFT JOIN fences f ON s.category = f.category),
reasons AS (
  SELECT *, CASE WHEN no_image THEN 'missing_image' WHEN no_text THEN 'missing_text' WHEN sim < thr THEN 'low_similarity' ELSE 'ok' END AS reason FROM flags)"""

_BEST = f"""{_FLAGS},
asked AS (SELECT * FROM reasons WHERE reason = 'low_similarity'),
rivals AS (
  SELECT q.row_id, c.row_id AS other, list_cosine_similarity(q.im, c.t) AS s, list_cosine_similarity(q.im, q.t) AS own
  FROM asked q JOIN pairs c ON q.row_id <> c.row_id),
best AS (
  SELECT row_id, other, s, own FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY s DESC, other) AS k FROM rivals) WHERE k = 1)"""

_REPORTS = f"""{_BEST},
reports AS (
  SELECT r.row_id, r.reason, b.other, b.s - b.own AS margin, coalesce(b.s > b.own + 0.01, false) AS swap
  FROM reasons r LEFT JOIN best b ON r.row_id = b.row_id WHERE r.reason <> 'ok'),
verdicts AS (
  SELECT *,
    CASE WHEN reason LIKE 'missing%' THEN 'Type III' WHEN swap THEN 'Type I' ELSE 'Unknown' END AS error_type,
    CASE WHEN reason LIKE 'missing%' THEN reason WHEN swap THEN 'image_relevance' ELSE 'unknown' END AS mismatch_aspects,
    CASE WHEN reason = 'missing_text' THEN 'V2T' WHEN reason = 'missing_image' THEN 'HUMAN' WHEN swap THEN 'T2V' ELSE 'HUMAN' END AS suggested_direction,
    CAST(CASE WHEN reason = 'missing_image' THEN 0.0 WHEN reason = 'missing_text' THEN 0.7 WHEN swap THEN 0.3 ELSE 0.5 END AS DOUBLE) AS image_trust,
    CAST(CASE WHEN reason = 'missing_image' THEN 0.5 WHEN reason = 'missing_text' THEN 0.0 WHEN swap THEN 0.8 ELSE 0.5 END AS DOUBLE) AS text_trust,
    CASE WHEN reason NOT LIKE 'missing%' AND swap THEN other END AS candidate
  FROM reports)"""

_PLAN = f"""{_REPORTS},
plan AS (
  SELECT row_id, error_type, mismatch_aspects, suggested_direction, candidate,
    CASE suggested_direction WHEN 'T2V' THEN 'replace_image_from_row' WHEN 'V2T' THEN 'apply_text_patch' ELSE 'human_review' END AS action,
    CAST(CASE suggested_direction WHEN 'HUMAN' THEN 0 ELSE 1 END AS BIGINT) AS tier,
    CAST(CASE suggested_direction WHEN 'T2V' THEN 1.0 WHEN 'V2T' THEN 0.5 ELSE 0.0 END AS DOUBLE) AS cost_units,
    CASE suggested_direction WHEN 'T2V' THEN 'Replace image using candidate row ' || candidate WHEN 'V2T' THEN 'Apply text_patch to row fields/attributes.'
      ELSE 'Low confidence or missing modalities.' END AS notes,
    row_number() OVER (ORDER BY row_id) - 1 AS step
  FROM verdicts)"""


def _repaired(origins: str) -> str:
    return f"""WITH RECURSIVE {_PLAN},
moves AS (SELECT step, row_id, candidate FROM plan WHERE action = 'replace_image_from_row'),
parents AS (
  SELECT s.step, s.row_id, s.candidate, max(p.step) AS parent FROM moves s LEFT JOIN moves p ON p.row_id = s.candidate AND p.step < s.step
  GROUP BY s.step, s.row_id, s.candidate),
chain AS (
  SELECT step, candidate, parent FROM parents
  UNION ALL
  SELECT c.step, p.candidate, p.parent FROM chain c JOIN parents p ON c.parent = p.step),
origins AS ({origins})
SELECT r.row_id, CASE p.action WHEN 'apply_text_patch' THEN 'NEEDS_CAPTION' ELSE 'item ' || r.row_id END AS title,
  CASE p.action WHEN 'apply_text_patch' THEN 'NEEDS_CAPTION' ELSE 'item ' || r.row_id END || '. Category: ' || r.category || '. Attributes: .' AS canonical_text,
  CASE WHEN o.source IS NOT NULL THEN 'data/processed/repaired_images/' || r.row_id || '.jpg' WHEN r.no_image THEN '' ELSE 'images/' || r.row_id || '.jpg' END AS image_path,
  coalesce(p.action <> 'human_review', false) AS repaired, coalesce(p.action, '') AS repair_action, coalesce(p.notes, '') AS repair_notes,
  coalesce(p.candidate, '') AS repair_source_row_id, o.source AS image_origin_row_id
FROM reasons r LEFT JOIN plan p ON r.row_id = p.row_id LEFT JOIN origins o ON o.row_id = r.row_id"""


_CATALOG = """
catalog AS (
  SELECT 'p' || p_partkey AS row_id, p_partkey AS k, CASE WHEN p_partkey % 10 = 3 THEN '' ELSE p_name END AS title, p_type AS category,
    NOT (p_partkey % 5 = 3 OR p_partkey % 7 IN (2, 4)) AS good, p_brand, p_size,
    CASE WHEN p_partkey % 3 = 0 THEN 'local' WHEN p_partkey % 2 = 0 THEN 'url' ELSE 'none' END AS source
  FROM part)"""

_COLOR_CASE = " ".join(f"WHEN regexp_matches(lower(p_name), '\\b{c}\\b') THEN '{c}'" for c in BASIC_COLORS)
_PROTOTYPES = ", ".join(f"({k}, '{name}', {r}, {g}, {b})" for k, (name, (r, g, b)) in enumerate(PROTOTYPES.items()))
_CATALOG_REPORTS = f"""WITH x AS (
  SELECT p_partkey AS k, (p_partkey * 37 + 11) % 256 AS r, (p_partkey * 91 + 5) % 256 AS g, (p_partkey * 53 + 77) % 256 AS b,
    CASE WHEN p_partkey % 4 = 0 THEN 'red' {_COLOR_CASE} ELSE '' END AS text_color FROM part),
p(n, name, pr, pg, pb) AS (VALUES {_PROTOTYPES}),
near AS (SELECT k, arg_min(name, ((r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb)) * 100 + n) AS seen FROM x CROSS JOIN p GROUP BY k),
v AS (
  SELECT x.*, seen, CASE WHEN k % 13 = 0 THEN 'missing_image' WHEN k % 11 = 0 THEN 'missing_text' WHEN k % 7 = 0 THEN 'missing_image_file'
    WHEN text_color <> '' AND text_color <> seen THEN 'color' ELSE 'unknown' END AS what FROM x JOIN near USING (k)),
reports AS (
  SELECT CAST(k AS VARCHAR) AS row_id, CASE WHEN what LIKE 'missing%' THEN 'Type III' WHEN what = 'color' THEN 'Type II' ELSE 'Unknown' END AS error_type, what AS mismatch_aspects,
    CASE WHEN what IN ('missing_text', 'color') THEN 'V2T' ELSE 'HUMAN' END AS suggested_direction,
    CASE what WHEN 'missing_image' THEN 'Image is missing.' WHEN 'missing_text' THEN 'Text is missing; likely generate/fill text from image.'
      WHEN 'missing_image_file' THEN 'Image file not found at: images/' || k || '.jpg' END AS notes,
    CAST(CASE what WHEN 'missing_text' THEN 0.7 WHEN 'color' THEN 0.75 WHEN 'unknown' THEN 0.5 ELSE 0 END AS DOUBLE) AS image_trust,
    CAST(CASE what WHEN 'missing_text' THEN 0 WHEN 'color' THEN 0.4 ELSE 0.5 END AS DOUBLE) AS text_trust,
    CASE what WHEN 'color' THEN seen END AS new_color, CASE what WHEN 'missing_text' THEN 'NEEDS_CAPTION' END AS new_title,
    CASE what WHEN 'color' THEN text_color END AS text_color, CASE what WHEN 'color' THEN r || ',' || g || ',' || b END AS rgb FROM v)"""

#: The plan step after step: groups are independent, so each round makes one step of every group on lists of its rows' paths and files.
_CHANGING_PATHS = """WITH RECURSIVE groups AS (SELECT p_partkey // 4 AS g, count(*) AS n FROM part GROUP BY 1),
total AS (SELECT count(*) AS many FROM groups),
begun AS (
  SELECT g, n, list_transform(range(n), lambda s: 'data/processed/repaired_images/' || g || '-' || s || '.jpg') AS puts,
    list_transform(range(n), lambda s: CASE WHEN s = 3 THEN '' WHEN s = 2 AND g % 2 = 0 THEN 'data/processed/repaired_images/' || g || '-0.jpg' ELSE 'images/' || g || '-' || s || '.jpg' END) AS paths
  FROM groups),
state AS (
  SELECT 0 AS n, g, puts, paths, list_filter(list_transform(range(n), lambda s: CASE WHEN s < 2 OR (s = 2 AND g % 3 <> 0) THEN paths[s + 1] END), lambda x: x IS NOT NULL) AS listed,
    list_transform(range(n), lambda s: CAST(NULL AS BIGINT)) AS shows, list_transform(range(n), lambda s: CAST(NULL AS VARCHAR)) AS shown,
    list_transform(range(n), lambda s: CAST('' AS VARCHAR)) AS acted, list_transform(range(n), lambda s: CAST('' AS VARCHAR)) AS froms,
    CAST(NULL AS BIGINT) AS r, CAST('' AS VARCHAR) AS reason
  FROM begun
  UNION ALL
  SELECT n + 1, g, puts,
    list_transform(range(len(paths)), lambda s: CASE WHEN s = nr AND fails = '' AND patches THEN value WHEN s = nr AND fails = '' THEN puts[s + 1] ELSE paths[s + 1] END), listed,
    list_transform(range(len(paths)), lambda s: CASE WHEN s = nr AND fails = '' AND NOT patches THEN coalesce(shows[file], nc) ELSE shows[s + 1] END),
    list_transform(range(len(paths)), lambda s: CASE WHEN s = nr AND fails = '' AND NOT patches THEN coalesce(shown[file], src) ELSE shown[s + 1] END),
    list_transform(range(len(paths)), lambda s: CASE WHEN s = nr AND fails = '' THEN CASE WHEN patches THEN 'apply_text_patch' ELSE 'replace_image_from_row' END ELSE acted[s + 1] END),
    list_transform(range(len(paths)), lambda s: CASE WHEN s = nr AND fails = '' THEN CASE WHEN patches THEN '' ELSE g || '-' || nc END ELSE froms[s + 1] END),
    nr, fails
  FROM (
    SELECT *, CASE WHEN nr >= len(paths) THEN 'row_id_not_found' WHEN patches THEN '' WHEN nc >= len(paths) THEN 'candidate_missing_or_not_found' WHEN src = '' THEN 'candidate_has_no_image_path'
      WHEN NOT (list_contains(listed, src) OR coalesce(shown[file], '') <> '') THEN 'candidate_image_file_missing:' || src
      WHEN src = puts[nr + 1] THEN 'exception:SameFileError:' || whole || ' and ' || whole || ' are the same file' ELSE '' END AS fails
    FROM (
      SELECT *, paths[nc + 1] AS src, list_position(puts, paths[nc + 1]) AS file, 'PosixPath(' || chr(39) || '/data/' || paths[nc + 1] || chr(39) || ')' AS whole
      FROM (
        SELECT *, (g * 7 + n * 3 + n // 4) % 4 AS nr, (g * 5 + n * n + n // 3) % 4 AS nc, (g + n) % 6 = 5 AS patches,
          CASE WHEN (g + n) % 12 = 5 THEN 'data/processed/repaired_images/' || g || '-1.jpg' ELSE 'images/gone.jpg' END AS value FROM state WHERE n < 10))))"""

ORACLES = {
    "repair_changing_paths_log": f"""{_CHANGING_PATHS} SELECT (n - 1) * many + g AS step, g || '-' || r AS row_id, CASE WHEN reason = '' THEN 'ok' ELSE 'fail' END AS status, reason FROM state, total WHERE n > 0""",
    "repair_changing_paths_rows": f"""{_CHANGING_PATHS} SELECT g || '-' || s AS row_id, paths[s + 1] AS image_path, acted[s + 1] <> '' AS repaired, acted[s + 1] AS repair_action, froms[s + 1] AS repair_source_row_id,
CASE WHEN shows[s + 1] IS NOT NULL THEN g || '-' || shows[s + 1] END AS image_origin_row_id, shown[s + 1] AS image_origin_path FROM (SELECT *, unnest(range(len(paths))) AS s FROM state WHERE n = 10)""",
    "pair_cosine": f"WITH {_PAIRS} SELECT row_id, category, round(sim, 6) AS sim_score FROM scored",
    "sieve_iqr": f"""WITH {_FLAGS} SELECT category, n_scored, round(CASE WHEN n_scored < 8 THEN g ELSE a - 1.5 * (b - a) END, 6) AS sieve_threshold,
CASE WHEN n_scored < 8 THEN 'global' ELSE 'category' END AS threshold_source FROM fences CROSS JOIN overall""",
    "sieve_quantile": f"""WITH {_FLAGS} SELECT category, n_scored, round(CASE WHEN n_scored < 8 THEN g ELSE q END, 6) AS sieve_threshold,
CASE WHEN n_scored < 8 THEN 'global' ELSE 'category' END AS threshold_source FROM fences CROSS JOIN overall""",
    "sieve_global_iqr": f"""WITH {_PAIRS} SELECT round(quantile_cont(sim, 0.25) - 1.5 * (quantile_cont(sim, 0.75) - quantile_cont(sim, 0.25)), 6) AS global_threshold FROM scored""",
    "sieve_global_fallback": """WITH d AS (SELECT lang || '/' || source AS category, CAST(n_chars AS DOUBLE) AS x FROM documents),
g AS (SELECT quantile_cont(x, 0.10) AS g FROM d),
f AS (SELECT category, count(*) AS n, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM d GROUP BY category)
SELECT category, n AS n_scored, round(CASE WHEN n < 8 THEN g ELSE a - 1.0 * (b - a) END, 6) AS sieve_threshold,
CASE WHEN n < 8 THEN 'global' ELSE 'category' END AS threshold_source FROM f CROSS JOIN g""",
    "sieve_flags": f"""WITH {_FLAGS} SELECT row_id, category, round(sim, 6) AS sim_score, round(thr, 6) AS sieve_threshold, source AS threshold_source,
reason <> 'ok' AS flagged, reason AS flag_reason FROM reasons""",
    "flag_reason_counts": f"WITH {_FLAGS} SELECT reason AS flag_reason, count(*) AS n, count(*) FILTER (reason <> 'ok') AS n_flagged FROM reasons GROUP BY reason",
    "threshold_table": """SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.05), 6) AS q0, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1,
round(quantile_cont(l_extendedprice, 0.75), 6) AS q2 FROM lineitem GROUP BY l_returnflag""",
    "embedding_export": f"""WITH {_FLAGS} SELECT row_id, CAST(48 AS BIGINT) AS n_text, CAST(48 AS BIGINT) AS n_image,
round(list_sum([CAST(CAST(x AS FLOAT) AS DOUBLE) for x in t[1:48]]), 4) AS text_sum,
CASE WHEN no_image THEN 0.0::DOUBLE ELSE round(list_sum([CAST(CAST(x AS FLOAT) AS DOUBLE) for x in im[1:48]]), 4) END AS image_sum,
round(CAST(CAST(coalesce(sim, -1) AS FLOAT) AS DOUBLE), 4) AS sim_score, CAST(reason <> 'ok' AS BIGINT) AS flagged FROM reasons""",
    "retrieve_top1": f"WITH {_BEST} SELECT row_id, other AS best_other_row, round(own, 6) AS own_sim, round(s, 6) AS best_other_sim FROM best",
    "retrieve_every_image": f"""WITH {_PAIRS},
met AS (SELECT q.row_id, c.row_id AS other, list_cosine_similarity(q.im, c.t) AS s FROM pairs q JOIN pairs c ON q.row_id <> c.row_id WHERE NOT q.no_image)
SELECT row_id, arg_max(other, s) AS best_other_row, round(max(s), 6) AS best_other_sim FROM met GROUP BY row_id""",
    "diagnose_reports": f"""WITH {_REPORTS} SELECT row_id, error_type, mismatch_aspects, suggested_direction, image_trust, text_trust, candidate,
CASE reason WHEN 'missing_text' THEN 'NEEDS_CAPTION' END AS new_title,
CASE reason WHEN 'missing_image' THEN 'Image is missing.' WHEN 'missing_text' THEN 'Text is missing; likely generate/fill text from image.' END AS notes,
CASE WHEN reason = 'low_similarity' THEN round(margin, 6) END AS margin FROM verdicts""",
    "arbiter_queue": f"WITH {_REPORTS} SELECT row_id, error_type, suggested_direction, mismatch_aspects, image_trust, text_trust, coalesce(candidate, '') AS candidate FROM verdicts",
    "arbiter_plan": f"WITH {_PLAN} SELECT row_id, error_type, mismatch_aspects, suggested_direction, action, tier, cost_units, notes, step FROM plan",
    "plan_cost_by_action": f"WITH {_PLAN} SELECT action, tier, count(*) AS steps, sum(cost_units) AS cost_units FROM plan GROUP BY action, tier",
    "repair_images_sequential": _repaired("SELECT m.row_id, c.candidate AS source FROM chain c JOIN moves m ON c.step = m.step WHERE c.parent IS NULL"),
    "repair_images_snapshot": _repaired("SELECT row_id, candidate AS source FROM moves"),
    "repair_log_status": """WITH s AS (
  SELECT o_orderkey % 5 AS m, o_orderkey % 2 AS h, CASE o_orderkey % 5 WHEN 1 THEN 'apply_text_patch' WHEN 2 THEN 'human_review' WHEN 3 THEN 't2v_generate_image_unimplemented' ELSE 'replace_image_from_row' END AS action,
    o_custkey IN (SELECT p_partkey FROM part) AS found, o_custkey * 2 IN (SELECT p_partkey FROM part) AS cand,
    o_custkey = 0 AND row_number() OVER (PARTITION BY o_custkey, o_orderkey % 5 ORDER BY o_orderkey) > 1 AS again FROM orders),
r AS (SELECT action, CASE WHEN NOT found THEN 'row_id_not_found' WHEN action = 'replace_image_from_row' AND (m = 4 OR NOT cand) THEN 'candidate_missing_or_not_found'
  WHEN action = 'replace_image_from_row' AND again THEN 'exception:SameFileError:data/processed/repaired_images/0.jpg'
  WHEN action = 'apply_text_patch' AND h = 1 THEN 'missing_text_patch' WHEN m = 3 THEN 'action_not_supported:t2v_generate_image_unimplemented' ELSE '' END AS reason FROM s)
SELECT action, CASE WHEN reason = '' THEN 'ok' WHEN reason LIKE 'action_not%' THEN 'skip' ELSE 'fail' END AS status, reason, count(*) AS n FROM r GROUP BY action, reason""",
    "text_patch_apply": """WITH p AS (SELECT *, p_partkey % 3 = 0 AS hit, '. Attributes: brand=' || p_brand || ', size=' || p_size AS a FROM part)
SELECT CAST(p_partkey AS VARCHAR) AS row_id, CASE WHEN hit THEN 'patched' ELSE p_name END AS title, CASE WHEN hit THEN 'NEW' ELSE p_type END AS category,
CASE WHEN hit THEN 'patched. Category: NEW' || a || ', color=blue, a.b=1.' ELSE p_name || '. Category: ' || p_type || a || CASE WHEN p_partkey % 4 = 0 THEN ', color=red' ELSE '' END || '.' END AS canonical_text,
hit AS repaired, CASE WHEN hit THEN 'apply_text_patch' ELSE '' END AS repair_action, CASE WHEN hit THEN 'p' ELSE '' END AS repair_notes FROM p""",
    "canonical_text_of_part": f"""WITH {_CATALOG} SELECT row_id, title || '. Category: ' || category || '. Attributes: ' || CASE WHEN good THEN 'brand=' || p_brand || ', size=' || p_size ELSE '' END || '.' AS canonical_text FROM catalog""",
    "typed_attributes": f"""WITH {_CATALOG} SELECT row_id, CASE WHEN good THEN '{{"brand":"' || p_brand || '","size":' || p_size || '}}' ELSE '{{}}' END AS attributes FROM catalog""",
    "json_attributes": "SELECT event_id, event_type || '. Category: event. Attributes: k=' || json_extract_string(props, '$.k') || '.' AS canonical_text FROM events",
    "missing_flags": f"""WITH {_CATALOG} SELECT row_id, title, CASE source WHEN 'none' THEN '' ELSE 'data/processed/images/' || row_id || '.jpg' END AS image_path,
source = 'none' AS is_image_missing, title = '' AND NOT good AS is_text_missing FROM catalog""",
    "build_counters": f"""WITH {_CATALOG} SELECT count(*) AS rows, count(*) FILTER (source <> 'none') AS normalized_images, count(*) FILTER (source = 'none') AS missing_images,
count(*) FILTER (title = '' AND NOT good) AS missing_text FROM catalog""",
    "build_downloads": f"WITH {_CATALOG} SELECT count(*) FILTER (source = 'url') AS downloaded FROM catalog",
    "image_source_resolution": f"WITH {_CATALOG} SELECT source AS image_source, count(*) AS n FROM catalog GROUP BY source",
    "image_listing_join": f"""WITH {_CATALOG} SELECT row_id, CASE WHEN k % 3 = 0 AND k % 9 <> 0 THEN 'data/processed/images/' || row_id || '.jpg' ELSE '' END AS image_path,
NOT (k % 3 = 0 AND k % 9 <> 0) AS is_image_missing FROM catalog""",
    "text_color": f"SELECT p_partkey, CASE {_COLOR_CASE} ELSE '' END AS color FROM part",
    "nearest_color_of_part": f"""WITH c AS (SELECT p_partkey, (p_partkey * 37 + 11) % 256 AS r, (p_partkey * 91 + 5) % 256 AS g, (p_partkey * 53 + 77) % 256 AS b FROM part),
p(k, name, pr, pg, pb) AS (VALUES {_PROTOTYPES}),
d AS (SELECT p_partkey, name, row_number() OVER (PARTITION BY p_partkey ORDER BY (r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb), k) AS n FROM c CROSS JOIN p)
SELECT p_partkey, name AS color FROM d WHERE n = 1""",
    "dominant_pixel_colors": f"""WITH x AS (SELECT l_suppkey, (l_partkey * 3 + l_linenumber * 17) % 256 AS r, (l_partkey * 5 + l_linenumber * 29) % 256 AS g, (l_partkey * 7 + l_linenumber * 41) % 256 AS b FROM lineitem),
y AS (SELECT *, (r + g + b) / 3.0::DOUBLE > 15 AND (r + g + b) / 3.0::DOUBLE < 245 AS kept FROM x),
a AS (SELECT l_suppkey,
  CAST(floor(CASE WHEN count(*) FILTER (kept) > 100 THEN avg(r) FILTER (kept) ELSE avg(r) END) AS BIGINT) AS red,
  CAST(floor(CASE WHEN count(*) FILTER (kept) > 100 THEN avg(g) FILTER (kept) ELSE avg(g) END) AS BIGINT) AS green,
  CAST(floor(CASE WHEN count(*) FILTER (kept) > 100 THEN avg(b) FILTER (kept) ELSE avg(b) END) AS BIGINT) AS blue FROM y GROUP BY l_suppkey),
p(k, name, pr, pg, pb) AS (VALUES {_PROTOTYPES}),
d AS (SELECT a.*, name, row_number() OVER (PARTITION BY l_suppkey ORDER BY (red - pr) * (red - pr) + (green - pg) * (green - pg) + (blue - pb) * (blue - pb), k) AS n FROM a CROSS JOIN p)
SELECT l_suppkey, red, green, blue, name AS img_color FROM d WHERE n = 1""",
    "replicate_rows": "SELECT p_partkey || '_' || k AS row_id, p_name AS title, 'clean' AS noise_label FROM part, (SELECT unnest(range(15)) AS k)",
    "noise_sample": """WITH n AS (SELECT 15 * count(*) AS n, CAST(floor(15 * count(*) * 0.30::DOUBLE) AS BIGINT) AS m FROM part)
SELECT true AS noisy, m AS n FROM n UNION ALL SELECT false, n - m FROM n""",
    "noise_free_partners": """WITH RECURSIVE total AS (SELECT count(*) AS n FROM part),
state AS (
  SELECT 0 AS k, n, range(n) AS lies FROM total
  UNION ALL
  SELECT k + 1, n, list_transform(lies, lambda x, i: CASE WHEN i - 1 = a THEN lies[b + 1] WHEN i - 1 = b THEN lies[a + 1] ELSE x END)
  FROM (SELECT *, (k * 7919 + 5) % n AS a, (CAST(k AS BIGINT) * k * 31 + k * 104729 + 13) % n AS b FROM state WHERE k < n * 3 // 10))
SELECT unnest(range(n)) AS p_partkey, unnest(lies) AS origin FROM state WHERE k = n * 3 // 10""",
    "noise_invariants": """SELECT 15 * count(*) AS rows, CAST(floor(15 * count(*) * 0.30::DOUBLE) AS BIGINT) AS noisy, CAST(0 AS BIGINT) AS colors_kept,
CAST(0 AS BIGINT) AS texts_wrong, CAST(0 AS BIGINT) AS others_touched, CAST(0 AS BIGINT) AS images_lost FROM part""",
    "diagnose_catalog": f"{_CATALOG_REPORTS} SELECT * FROM reports",
    "queue_fixes": f"""{_CATALOG_REPORTS} SELECT row_id, image_trust, text_trust, CASE mismatch_aspects
WHEN 'missing_text' THEN '{{"text_patch":{{"title":"NEEDS_CAPTION"}}}}'
WHEN 'color' THEN '{{"text_patch":{{"attributes.color":"' || new_color || '"}},"observed_image_color":"' || new_color || '","observed_image_rgb":[' || rgb || '],"text_color":"' || text_color || '"}}'
ELSE '{{}}' END AS proposed_fix FROM reports""",
    "arbiter_actions": """WITH q AS (
  SELECT o_orderkey AS k, o_custkey, CASE WHEN o_orderkey % 6 IN (0, 4) THEN 'T2V' WHEN o_orderkey % 6 IN (1, 5) THEN 'V2T' ELSE '' END AS way FROM orders),
a AS (
  SELECT *, CASE WHEN way = 'T2V' AND k % 4 = 0 THEN 'replace_image_from_row' WHEN way = 'T2V' THEN 't2v_generate_image_unimplemented'
    WHEN way = 'V2T' AND k % 4 = 1 THEN 'apply_text_patch' WHEN way = 'V2T' THEN 'v2t_generate_text_unimplemented' ELSE 'human_review' END AS action FROM q)
SELECT CAST(k AS VARCHAR) AS row_id, action,
  CAST(CASE action WHEN 'human_review' THEN 0 WHEN 't2v_generate_image_unimplemented' THEN 3 WHEN 'v2t_generate_text_unimplemented' THEN 2 ELSE 1 END AS BIGINT) AS tier,
  CAST(CASE action WHEN 'human_review' THEN 0 WHEN 't2v_generate_image_unimplemented' THEN 10 WHEN 'v2t_generate_text_unimplemented' THEN 4 WHEN 'apply_text_patch' THEN 0.5 ELSE 1 END AS DOUBLE) AS cost_units,
  CASE action WHEN 'human_review' THEN 'Low confidence or missing modalities.' WHEN 'replace_image_from_row' THEN 'Replace image using candidate row ' || o_custkey
    WHEN 'apply_text_patch' THEN 'Apply text_patch to row fields/attributes.' WHEN 't2v_generate_image_unimplemented' THEN 'Would require generative T2V editing; not implemented in MVP.'
    ELSE 'Would require VLM-based text generation; not implemented in MVP.' END AS notes,
  row_number() OVER (ORDER BY k) - 1 AS step FROM a""",
    "repair_status_counts": """WITH l AS (
  SELECT CASE p_partkey % 5 WHEN 0 THEN 'candidate_has_no_image_path' WHEN 1 THEN 'exception:SameFileError' WHEN 2 THEN 'candidate_image_file_missing'
    WHEN 3 THEN 'candidate_missing_or_not_found' ELSE '' END AS reason FROM part),
s AS (SELECT *, CASE reason WHEN '' THEN 'ok' ELSE 'fail' END AS status FROM l)
SELECT status, reason, count(*) AS n FROM s GROUP BY status, reason UNION ALL SELECT status, 'all', count(*) FROM s GROUP BY status""",
    "dedup_last_wins": "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k = 1",
}
