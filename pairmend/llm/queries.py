"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from pairmend.llm import hostpaths, importance, lthash, maglev, merkle, mixing, nbsvm, pivots, secrets, spm, urlcascade
from pairmend.llm.anchors import repeated_passages
from pairmend.llm.common import table
from pairmend.llm.minhash import near_duplicates

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
SHARDS = tuple(f"shard-{k:03d}" for k in range(64))


def op1_pivot_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)


def op3_maglev_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document goes, and where it would if the last shard were lost."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    now = maglev.place(docs, SHARDS)
    later = maglev.place(now.withColumnRenamed("shard", "now").drop("slot"), SHARDS[:-1])
    return later.select("doc_id", "source", "slot", F.col("now").alias("shard"), F.col("shard").alias("shard_after_loss"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = nbsvm.train(docs, labels.filter(~nbsvm.held_out()))
    return nbsvm.score(docs, model).select("doc_id", nbsvm.held_out().alias("held_out"), "score", "predicted")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lthash.edited(table(spark, sf_dir, "documents"))


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostpaths.main_text(table(spark, sf_dir, "pages"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.round_trips(table(spark, sf_dir, "documents"), TOKENIZER)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"), digest=True)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", mixing.words_taken().alias("taken"), mixing.words_by_shard().alias("shards"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"CAST(size(filter(base, s -> s.kind = '{kind}')) AS BIGINT) AS n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secrets.joined("base"), 256).alias("base_sha256"), secrets.joined("spans").alias("spans"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_evidence(table(spark, sf_dir, "documents"))


#: Host, path and verdict.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlcascade.judge(table(spark, sf_dir, "pages"), rules)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def _choose(n: str, k: str) -> str:
    return f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"


#: The mix in SQL: targets by the same level, what the permuted blocks take, and the tree's draws, node by
#: node and source by source, from log-gamma functions; a corpus of up to 2 ** 24 words, so 16 shards.
MIX_SQL = rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
own AS (
  SELECT source, count(*) AS n_docs, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source),
weighed AS (SELECT *, CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM own),
levels AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
             - CAST(coalesce(sum(2 * source_size) OVER (ORDER BY (2 * source_size)::DOUBLE / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
            / CAST(sum(w) OVER (ORDER BY (2 * source_size)::DOUBLE / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lev FROM weighed),
goals AS (
  SELECT source, rank, source_size, 1 + n_docs // 10000 AS n_strips,
         least(CAST(2 * source_size AS DOUBLE), max(lev) OVER () * w) AS target,
         greatest(16, least(512, source_size // 1000), source_size // 1073741824) AS block FROM levels),
placed AS (
  SELECT d.doc_id, d.size, g.*, CAST('0x' || substr(d.key, 1, 8) AS BIGINT) % g.n_strips AS strip, d.key
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source),
streamed AS (SELECT *, CAST(sum(size) OVER (PARTITION BY rank, strip ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS beg FROM placed),
strips AS (SELECT rank, strip, CAST(ceil(sum(size) / max(block)) AS BIGINT) AS n FROM streamed GROUP BY rank, strip),
firsts AS (SELECT rank, strip, CAST(sum(n) OVER (PARTITION BY rank ORDER BY strip) AS BIGINT) - n AS first_block, CAST(sum(n) OVER (PARTITION BY rank) AS BIGINT) AS n_blocks FROM strips),
quotas AS (
  SELECT s.*, f.first_block, f.n_blocks,
         CASE WHEN source_size = 0 THEN 0 ELSE least(2 * n_blocks, CAST(floor(target * n_blocks / source_size + 0.5) AS BIGINT)) END AS quota
  FROM streamed s JOIN firsts f USING (rank, strip)),
blocks AS (
  SELECT doc_id, size, source_size, target, rank, quota, n_blocks, first_block, block, beg,
         unnest(range(first_block + beg // block, first_block + (beg + size - 1) // block + 1)) AS b
  FROM quotas WHERE size > 0),
draws AS (
  SELECT doc_id, rank, least(size, (b - first_block + 1) * block - beg) - greatest(0, (b - first_block) * block - beg) AS part,
         e * n_blocks + ((b % n_blocks) * (coalesce(list_filter(list_transform(range({len(mixing.PRIMES)}), lambda k: {list(mixing.PRIMES)}[1 + (rank * 5 + e * 3 + k) % {len(mixing.PRIMES)}]),
           lambda p: p % n_blocks BETWEEN n_blocks // 4 AND n_blocks - n_blocks // 4)[1], {mixing.PRIMES[0]}) % n_blocks) + (rank * 7919 + e * 104729) % n_blocks) % n_blocks AS place, quota
  FROM blocks, (VALUES (0), (1)) AS epochs(e)),
deal AS (
  SELECT 0 AS level, 1 AS node, 1 AS i, CAST(list_sum(q) AS BIGINT) AS total, CAST(list_sum(q) // 2 AS BIGINT) AS goes, q, CAST([] AS BIGINT[]) AS l
  FROM (SELECT list(quota ORDER BY rank) AS q FROM (SELECT DISTINCT rank, quota FROM quotas))
  UNION ALL
  SELECT level + c.down, CASE WHEN c.down = 0 THEN node ELSE 2 * node + c.side END, CASE WHEN c.down = 0 THEN i + 1 ELSE 1 END,
         CASE WHEN c.down = 0 THEN total - q[i] ELSE CAST(list_sum(c.nextq) AS BIGINT) END,
         CASE WHEN c.down = 0 THEN goes - k ELSE CAST(list_sum(c.nextq) // 2 AS BIGINT) END,
         c.nextq, CASE WHEN c.down = 0 THEN list_append(l, k) ELSE CAST([] AS BIGINT[]) END
  FROM (
    SELECT *, CASE WHEN i > len(q) THEN 0 WHEN lo >= hi THEN lo WHEN u < top THEN m
                   ELSE m + CASE WHEN u - top - coalesce(list_sum(ups[:j - 1]), 0) - coalesce(list_sum(downs[:j - 1]), 0) < ups[j] THEN j ELSE -j END END AS k
    FROM (
      SELECT *, 1 + len(list_filter(range(1, steps + 1), lambda t: u - top - list_sum(ups[:t]) - list_sum(downs[:t]) >= 0)) AS j
      FROM (
        SELECT *, list_transform(range(1, steps + 1), lambda t: CASE WHEN m + t > hi THEN 0.0::DOUBLE ELSE exp({_choose('marked', '(m + t)')} + {_choose('(total - marked)', '(goes - m - t)')} - whole) END) AS ups,
               list_transform(range(1, steps + 1), lambda t: CASE WHEN m - t < lo THEN 0.0::DOUBLE ELSE exp({_choose('marked', '(m - t)')} + {_choose('(total - marked)', '(goes - m + t)')} - whole) END) AS downs
        FROM (
          SELECT *, CASE WHEN lo < hi THEN exp({_choose('marked', 'm')} + {_choose('(total - marked)', '(goes - m)')} - {_choose('total', 'goes')}) END AS top,
                 CASE WHEN lo < hi THEN {_choose('total', 'goes')} END AS whole,
                 CASE WHEN lo < hi THEN CAST(floor(20 + 10 * sqrt(goes * (marked / total) * (1 - marked / total) * ((total - goes) / greatest(1, total - 1)))) AS BIGINT) ELSE 0 END AS steps
          FROM (
            SELECT *, least(hi, greatest(lo, CAST(floor((goes + 1::DOUBLE) * (marked + 1) / (total + 2)) AS BIGINT))) AS m
            FROM (
              SELECT *, greatest(0, goes + marked - total) AS lo, least(goes, marked) AS hi,
                     (CAST('0x' || substr(md5(node || '-' || (i - 1) || '-0'), 1, 12) AS BIGINT) + 0.5) / 281474976710656::DOUBLE AS u
              FROM (SELECT *, CASE WHEN i <= len(q) THEN q[i] ELSE 0 END AS marked FROM deal WHERE level < 4))))))) d,
       LATERAL (
         SELECT 0 AS down, 0 AS side, d.q AS nextq WHERE d.i <= len(d.q)
         UNION ALL SELECT 1, 0, d.l WHERE d.i > len(d.q)
         UNION ALL SELECT 1, 1, list_transform(d.q, lambda x, z: x - d.l[z]) WHERE d.i > len(d.q)) c),
leaf AS (SELECT node - 16 AS shard, unnest(range(0, len(q))) AS rank, unnest(q) AS n FROM deal WHERE level = 4 AND i = 1),
ends AS (SELECT rank, list(e ORDER BY shard) AS ends FROM (SELECT rank, shard, sum(n) OVER (PARTITION BY rank ORDER BY shard) AS e FROM leaf) GROUP BY rank),
cuts AS (SELECT doc_id, part, len(list_filter(ends, lambda x: x <= place)) AS shard FROM draws JOIN ends USING (rank) WHERE place < quota),
got AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS taken, string_agg(shard || ':' || n, ',' ORDER BY shard) AS shards
  FROM (SELECT doc_id, shard, CAST(sum(part) AS BIGINT) AS n FROM cuts GROUP BY doc_id, shard) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(g.taken, 0) AS taken, coalesce(g.shards, '') AS shards
FROM quotas q LEFT JOIN got g ON q.doc_id IS NOT DISTINCT FROM g.doc_id
"""


_REACH = """
arcs AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN arcs l ON r.b = l.a),
parts AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""

#: All pairs of vectors, and what is reachable.
LINKS_SQL = f"""
WITH RECURSIVE e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
links AS (SELECT x.id AS a, y.id AS b FROM e x JOIN e y ON x.id < y.id WHERE list_cosine_similarity(x.v, y.v) >= 0.9),
nodes AS (SELECT id FROM e), {_REACH},
degree AS (SELECT a AS id, count(*) AS n FROM arcs GROUP BY a)
SELECT p.id AS vec_id, coalesce(n, 0) AS n_links, component_id, p.id = component_id AS kept FROM parts p LEFT JOIN degree d ON p.id = d.id
"""

#: All documents that share a shingle, by exact set sizes.
NEAR_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[k] || ' ' || w[k + 1] END AS x
  FROM (SELECT id, w, unnest(range(1, greatest(len(w), 2))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
met AS (SELECT p.id AS a, q.id AS b, count(*) AS i FROM s p JOIN s q ON p.x = q.x AND p.id < q.id GROUP BY p.id, q.id),
links AS (SELECT a, b FROM met JOIN n f ON f.id = a JOIN n g ON g.id = b WHERE 100 * i >= 80 * (f.n + g.n - i)),
nodes AS (SELECT id FROM d), {_REACH}
SELECT p.id AS doc_id, coalesce(n.n, 0) AS n_shingles, component_id, p.id = component_id AS kept FROM parts p LEFT JOIN n ON n.id = p.id
"""

#: Every window as a string.
REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
win AS (
  SELECT doc_id, p, array_to_string(w[p:p + 34], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
again AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS k FROM win WHERE s IN (SELECT s FROM again)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM d),
kept AS (
  SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.k) AS t, count(*) AS n
  FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.k = gone.k WHERE gone.k IS NULL GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: CRC-32 of a text, byte by byte, by a table of the 256 steps in crc_steps(t).
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen({0}) + 1), lambda k: CAST('0x' || substr(hex(encode({0})), CAST(2 * k - 1 AS BIGINT), 2) AS BIGINT))),
           lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"""
_CRC_STEPS = """
crc_steps AS MATERIALIZED (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i))"""

#: Every run of words as a text, hashed byte by byte.
RESAMPLE_SQL = rf"""
WITH {_CRC_STEPS},
d AS (SELECT doc_id, regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
runs AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS f FROM d),
aims AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS f FROM b),
named AS (SELECT f, {_CRC.format("f")} % 10000 AS bucket FROM (SELECT f FROM runs UNION SELECT f FROM aims), crc_steps),
own AS (SELECT bucket, count(*) AS s FROM runs JOIN named USING (f) GROUP BY bucket),
aim AS (SELECT bucket, count(*) AS t FROM aims JOIN named USING (f) GROUP BY bucket),
sums AS (SELECT (SELECT count(*) FROM runs)::DOUBLE AS ss, (SELECT count(*) FROM aims)::DOUBLE AS tt),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ss + 10000) / ((s + 1)::DOUBLE * (tt + 10000)))) AS BIGINT) AS g
  FROM own LEFT JOIN aim USING (bucket), sums),
weights AS (SELECT doc_id, count(*) AS n, CAST(floor(CAST(sum(g) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM runs JOIN named USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, len(w) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN weights ON d.doc_id = weights.doc_id),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM scored WHERE words >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= 25 * able // 100 THEN place END AS rank FROM scored s LEFT JOIN placed p ON s.doc_id = p.doc_id
"""

_ENCODED = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in merkle.COLUMNS)

#: The trees level by level, each document's way up, and the fold along it.
MANIFEST_SQL = f"""
WITH RECURSIVE {_CRC_STEPS},
cut AS (
  SELECT doc_id, source, sha256({_ENCODED}) AS leaf, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS n,
         source AS g, lang, n_chars, CASE WHEN {_CRC.format("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS text
  FROM documents, crc_steps),
d AS (SELECT doc_id, g, leaf, k, n, sha256({_ENCODED}) AS seen FROM cut),
up AS (
  SELECT 0 AS lvl, g, k, n, leaf AS h FROM d
  UNION ALL SELECT lvl + 1, g, k // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY k)) FROM up WHERE n > 1 GROUP BY lvl, g, k // 3, n),
tops AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS k, count(*) OVER () AS n FROM up WHERE n = 1),
over AS (
  SELECT 0 AS lvl, k, n, subroot AS h FROM tops
  UNION ALL SELECT lvl + 1, k // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY k)) FROM over WHERE n > 1 GROUP BY lvl, k // 3, n),
runs AS (SELECT lvl, g, k // 3 AS run, list(h ORDER BY k) AS hs FROM up WHERE n > 1 GROUP BY lvl, g, k // 3),
over_runs AS (SELECT lvl, k // 3 AS run, list(h ORDER BY k) AS hs FROM over WHERE n > 1 GROUP BY lvl, k // 3),
ways AS (
  SELECT d.doc_id, r.lvl, (d.k // CAST(pow(3, r.lvl) AS BIGINT)) % 3 AS own, hs
  FROM d JOIN runs r ON d.g IS NOT DISTINCT FROM r.g AND d.k // CAST(pow(3, r.lvl + 1) AS BIGINT) = r.run
  UNION ALL
  SELECT d.doc_id, 100 + r.lvl, (t.k // CAST(pow(3, r.lvl) AS BIGINT)) % 3, hs
  FROM d JOIN tops t ON d.g IS NOT DISTINCT FROM t.g JOIN over_runs r ON t.k // CAST(pow(3, r.lvl + 1) AS BIGINT) = r.run),
paths AS (
  SELECT doc_id, list(array_to_string(hs[1:own], '') || '|' || array_to_string(hs[own + 2:], '') ORDER BY lvl) AS path FROM ways GROUP BY doc_id),
folded AS (
  SELECT d.doc_id, leaf, subroot, (SELECT h FROM over WHERE n = 1) AS root, coalesce(path, CAST([] AS VARCHAR[])) AS path, seen
  FROM d JOIN tops t ON d.g IS NOT DISTINCT FROM t.g LEFT JOIN paths p ON d.doc_id = p.doc_id)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256, up_to AS folded_root, up_to = root AS verified
FROM (SELECT *, list_reduce(list_prepend(seen, path), lambda h, p: sha256(split_part(p, '|', 1) || h || split_part(p, '|', 2))) AS up_to FROM folded)
"""

#: Every rule against every host and path.
URLS_SQL = f"""
WITH rules(rule_host, rule_path, says) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, {_LOWERED.format("regexp_extract(r, '^[^/?#]*')")} AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(says, length(rule_host || rule_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path)
SELECT page_id, p.host, p.path, rule, coalesce(verdict, 'allow') AS verdict FROM parts p LEFT JOIN fits f ON p.host = f.host AND p.path = f.path
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_pivot_near_dedup": LINKS_SQL, "op2_minhash_near_dedup": NEAR_SQL, "op8_substring_dedup": REPEATS_SQL, "op9_mixing": MIX_SQL,
        "op11_importance_resampling": RESAMPLE_SQL, "op12_merkle_manifest": MANIFEST_SQL, "op13_url_filter": URLS_SQL,
    }
