"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents, in hash order, make one stream of words, which is cut into blocks. A source's
target fixes how many blocks it gives in all (its quota; past its number of blocks, a second epoch).
From the root down, every node deals its quotas to two children of equal size: the numbers of blocks
that the left child gets are one multivariate-hypergeometric draw, so the mix of any shard is that of
a random sample. A leaf's quotas say which run of each source's permuted blocks its shard takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairmend.llm.common import n_words, settle, small

#: Documents of one source in a strip, which one task orders.
STRIP_DOCS = 10_000
#: Words in a block: a thousandth of the source, within these bounds; at most 2 ** 30 blocks a source.
LEAST_BLOCK, MOST_BLOCK = 16, 512
#: Levels of the tree: so many that a shard has about as many words, within these bounds.
LEAST_LEVELS, MOST_LEVELS, SHARD_WORDS = 4, 10, 1 << 24
#: Words of a shard that one task sorts and writes, about.
TASK_WORDS = 1 << 22
#: A word with what stands before it, and for the last one what stands after it.
SPACED_WORD = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++(?:[\x20\x09-\x0D]++\z)?"


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """One row a source: source, n_docs, source_size, rank, target.

    Sources by code point, null last, weigh weights[0], weights[1], ..., repeating. They share `share`
    times all sizes; no target is above cap times its source's size, and what is above is shared
    again by weight until none is (in one step: the level at which the capped sources stop).
    """
    own = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    own = own.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("w", w.cast("long"))
    tight = Window.orderBy((cap * F.col("source_size")) / F.col("w"), "rank")
    before, after = tight.rowsBetween(Window.unboundedPreceding, -1), tight.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    capped = F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0))
    level = (share * F.sum("source_size").over(everything) - capped) / F.sum("w").over(after)
    own = own.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    goal = F.least((cap * F.col("source_size")).cast("double"), F.col("level") * F.col("w"))
    return own.select("source", "n_docs", "source_size", "rank", goal.alias("target"))


def _let(name: str, fields: dict[str, str], body: str) -> str:
    """SQL: the body with `name` bound to a struct of the fields, each computed once."""
    made = ", ".join(f"'{k}', {v}" for k, v in fields.items())
    return f"transform(array(named_struct({made})), {name} -> {body})[0]"


def _log_factorial(x: str) -> str:
    series = f"({x} + 0.5D) * ln({x}) - {x} + 0.918938533204672742D + 1D / (12D * {x}) - 1D / (360D * {x} * {x} * {x})"
    return f"(CASE WHEN {x} <= 20 THEN ln(CAST(factorial(CAST({x} AS INT)) AS DOUBLE)) ELSE {series} END)"


def _log_choose(n: str, k: str) -> str:
    return f"({_log_factorial(n)} - {_log_factorial(k)} - {_log_factorial(f'({n} - {k})')})"


def hypergeometric(total: str, marked: str, drawn: str, chance: str) -> str:
    """SQL for how many of `drawn` out of `total` items are among the `marked` ones; chance is uniform in (0, 1).

    It subtracts probabilities from chance, outward from the mode m, until nothing is left.
    """
    up = "IF(p.m + j > p.hi, 0D, s.up * (p.marked - p.m - j + 1) * (p.drawn - p.m - j + 1) / ((p.m + j) * (p.rest - p.drawn + p.m + j)))"
    down = "IF(p.m - j < p.lo, 0D, s.down * (p.m - j + 1) * (p.rest - p.drawn + p.m - j + 1) / ((p.marked - p.m + j) * (p.drawn - p.m + j)))"
    after = "named_struct('left', s.left - w.up - w.down, 'up', w.up, 'down', w.down, 'found', IF(s.left < w.up, j, -j))"
    step = _let("w", {"up": up, "down": down}, after)
    start = "named_struct('left', p.u - p.top, 'up', p.top, 'down', p.top, 'found', 0L)"
    walk = f"aggregate(sequence(1L, p.steps), {start}, (s, j) -> IF(s.left < 0, s, {step}), s -> p.m + s.found)"
    part = "(y.marked / y.total)"
    spread = f"sqrt(greatest(0D, y.drawn * {part} * (1 - {part}) * ((y.total - y.drawn) / greatest(1D, y.total - 1))))"
    top = f"exp({_log_choose('y.marked', 'y.m')} + {_log_choose('(y.total - y.marked)', '(y.drawn - y.m)')} - {_log_choose('y.total', 'y.drawn')})"
    sized = {k: f"y.{k}" for k in ("marked", "drawn", "u", "lo", "hi", "m")} | {"rest": "y.total - y.marked", "top": top, "steps": f"CAST(20 + 10 * {spread} AS BIGINT)"}
    mode = "least(x.hi, greatest(x.lo, CAST(floor((x.drawn + 1D) * (x.marked + 1D) / (x.total + 2D)) AS BIGINT)))"
    centred = {k: f"x.{k}" for k in ("total", "marked", "drawn", "u", "lo", "hi")} | {"m": mode}
    ends = {"lo": f"greatest(0L, {drawn} + {marked} - {total})", "hi": f"least({drawn}, {marked})"}
    given = {"total": total, "marked": marked, "drawn": drawn, "u": chance}
    return _let("x", given | ends, f"IF(x.lo >= x.hi, x.lo, {_let('y', centred, _let('p', sized, walk))})")


def splitting_tree(quotas: DataFrame, levels: int, seed: int = 0) -> DataFrame:
    """(rank, shard, quota) for 2 ** levels shards, from one row (rank, quota) a source.

    The quotas of a source over all shards add up to its own; shards differ by one block at most at
    each level. The tree holds one number for each source and shard: none of the data's rows.
    """
    all_of = F.array_sort(F.collect_list(F.struct("rank", "quota"))).alias("q")
    nodes = quotas.agg(all_of).select(F.lit(1).alias("node"), F.transform("q", lambda x: x["quota"]).alias("q"))
    for _ in range(levels):
        name = f"concat_ws('-', CAST(node AS STRING), CAST(i AS STRING), '{seed}')"
        chance = f"(CAST(conv(substring(md5({name}), 1, 12), 16, 10) AS BIGINT) + 0.5D) / 281474976710656D"
        draw = hypergeometric("a.total", "q[i]", "a.goes", chance)
        deal = _let("d", {"k": draw}, "named_struct('total', a.total - q[i], 'goes', a.goes - d.k, 'out', concat(a.out, array(d.k)))")
        whole = "aggregate(q, 0L, (t, x) -> t + x)"
        start = f"named_struct('total', {whole}, 'goes', {whole} div 2, 'out', CAST(array() AS ARRAY<BIGINT>))"
        fold = f"IF(size(q) = 0, CAST(array() AS ARRAY<BIGINT>), aggregate(sequence(0, size(q) - 1), {start}, (a, i) -> {deal}, a -> a.out))"
        dealt = nodes.selectExpr("node", "q", f"{fold} AS l")
        nodes = dealt.selectExpr("inline(array(named_struct('node', 2 * node, 'q', l), named_struct('node', 2 * node + 1, 'q', zip_with(q, l, (x, y) -> x - y))))")
    leaves = nodes.select((F.col("node") - 2**levels).alias("shard"), F.posexplode("q").alias("rank", "quota"))
    return leaves.select("rank", "shard", "quota")


def _primes() -> tuple[int, ...]:
    """Sixteen primes from 1.2 to 2.1 thousand million, each the first from an even step on: more than any source has blocks."""
    small_ones = [p for p in range(3, 46_341, 2) if all(p % q for q in range(3, int(p**0.5) + 1, 2))]
    return tuple(next(n for n in range(1_200_000_001 + k * 56_000_000, 1 << 31, 2) if all(n % q for q in small_ones)) for k in range(16))


PRIMES = _primes()


def levels_for(words: int) -> int:
    """Levels of the tree for so many words."""
    return min(MOST_LEVELS, max(LEAST_LEVELS, (words // SHARD_WORDS).bit_length()))


def plan_mix(docs: DataFrame, levels: int | None = None, seed: int = 0, **mix) -> DataFrame:
    """One row per row of docs: doc_id, mark (a hash of the text), size, source_size, target, pieces.

    Without levels, levels_for() says how many the tree has.

    size counts words. A piece is a run of the document's words that lies in one drawn block: shard
    (of 2 ** levels), epoch, block (its number in the source), place (in the source's draws), first
    and last (word places, last excluded). mix goes to targets().

    Defined results: a null or empty text has size 0 and no pieces; a null source is a source of its
    own, the last; a source without words has target 0; no rows in, no rows out. Null doc_ids are ids like any
    other, equal rows are told apart by nothing and drawn one after another. Reruns agree. One row
    holds a quota for each source and shard, so this is for some ten thousand sources at most.
    """
    # A source is many strips, each ordered in a task of its own, so a hot source is spread as well.
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    slim = settle(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("mark"), key.alias("key")))
    goal = targets(slim.select("source", "size"), **mix)
    goal = goal.withColumn("n_strips", F.expr(f"1 + n_docs div {STRIP_DOCS}"))
    goal = goal.withColumn("block", F.expr(f"greatest({LEAST_BLOCK}, least({MOST_BLOCK}, source_size div 1000), source_size div {2**30})"))
    goal = settle(goal)
    by_rank = small(goal.select(F.col("source").alias("s"), "rank", "n_strips", "block"))
    slim = slim.join(by_rank, F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
    slim = slim.withColumn("strip", F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), "n_strips"))
    order = Window.partitionBy("rank", "strip").orderBy("key", "doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, 0)
    placed = slim.withColumn("at", F.sum("size").over(order) - F.col("size"))
    placed = settle(placed.select("rank", "strip", "block", "doc_id", "mark", "size", "at"))

    strips = placed.groupBy("rank", "strip").agg(F.expr("CAST(ceil(sum(size) / first(block)) AS BIGINT)").alias("n"))
    along = Window.partitionBy("rank").orderBy("strip")
    strips = settle(strips.withColumn("first_block", F.sum("n").over(along) - F.col("n")))
    count = strips.groupBy("rank").agg(F.sum("n").alias("n_blocks"))
    wanted = "CAST(floor(target * n_blocks / source_size + 0.5D) AS BIGINT)"
    quota = F.expr(f"IF(source_size = 0, 0L, least(2 * n_blocks, {wanted}))")
    quotas = settle(goal.join(count, "rank").withColumn("quota", quota).select("rank", "source_size", "target", "n_blocks", "quota"))
    levels = levels_for(goal.agg(F.coalesce(F.sum("target"), F.lit(0)).cast("long")).first()[0]) if levels is None else levels
    tree = splitting_tree(quotas.select("rank", "quota"), levels, seed)
    ends = Window.partitionBy("rank").orderBy("shard")
    tree = tree.withColumn("end", F.sum("quota").over(ends)).groupBy("rank").agg(F.array_sort(F.collect_list("end")).alias("ends"))
    quotas = settle(quotas.join(tree, "rank"))

    # Block b of n stands at place (b * stride + shift) mod n of its source's permutation, another for each
    # epoch; the first `quota` places, in epoch order, are drawn, and each shard takes a run of them. The stride is a prime above n, so
    # coprime to it, and the first from the source's and epoch's own place in the list that keeps neighbours a quarter of n apart.
    primes = f"transform(sequence(0, {len(PRIMES) - 1}), k -> array({', '.join(f'{p}L' for p in PRIMES)})[CAST((rank * 5 + e * 3 + {seed} + k) % {len(PRIMES)} AS INT)])"
    stride = f"coalesce(get(filter({primes}, p -> p % n_blocks BETWEEN n_blocks div 4 AND n_blocks - n_blocks div 4), 0), {PRIMES[0]}L)"
    place = f"e * n_blocks + pmod((b % n_blocks) * ({stride} % n_blocks) + (rank * 7919 + e * 104729 + {seed} * 1299709) % n_blocks, n_blocks)"
    fields = "'epoch', e, 'block', b, 'first', greatest(0L, (b - first_block) * block - at), 'last', least(size, (b - first_block + 1) * block - at), 'place', d.place"
    drawn = _let("d", {"place": place}, f"named_struct('shard', size(filter(ends, x -> x <= d.place)), {fields})")
    blocks = "sequence(first_block + at div block, first_block + (at + size - 1) div block)"
    every = f"flatten(transform({blocks}, b -> transform(array(0L, 1L), e -> {drawn})))"
    pieces = f"filter(IF(size = 0, NULL, {every}), x -> x.place < quota)"
    taken = placed.join(small(strips.select("rank", "strip", "first_block")), ["rank", "strip"]).join(small(quotas), "rank")
    return taken.select("doc_id", "mark", "size", "source_size", "target", F.coalesce(F.expr(pieces), F.array()).alias("pieces"))


def words_taken(pieces: str = "pieces") -> F.Column:
    """How many words the pieces hold, repeats counted."""
    return F.expr(f"aggregate({pieces}, 0L, (t, x) -> t + x.last - x.first)")


def words_by_shard(pieces: str = "pieces") -> F.Column:
    """shard:words of each shard that takes pieces, comma-joined, by shard."""
    taken = f"aggregate(filter({pieces}, x -> x.shard = s), 0L, (t, x) -> t + x.last - x.first)"
    return F.expr(f"array_join(transform(array_sort(array_distinct(transform({pieces}, x -> x.shard))), s -> concat(CAST(s AS STRING), ':', CAST({taken} AS STRING))), ',')")


def mix(docs: DataFrame, levels: int | None = None, seed: int = 0, shuffle: bool = True, **how) -> DataFrame:
    """The mixed corpus: one row a piece, with all columns of docs, then shard and place_key
    (replacing columns of these names).

    text is the piece's words with what stands before each, and what stands after the text's last: the
    pieces of one document and epoch, joined in order, are its text. Rows that repeat a doc_id and text are one document here, drawn as often as all of
    them. With shuffle, each shard is a run of partitions, in the order of place_key, a random one: equal
    ranges of it go to as many tasks as the shard's words ask for.
    """
    plan = settle(plan_mix(docs, levels, seed, **how))
    words, last = plan.agg(F.coalesce(F.sum(words_taken()), F.lit(0)), F.coalesce(F.max(F.expr("array_max(transform(pieces, x -> x.shard))")), F.lit(0))).first()
    again = plan.groupBy("doc_id", "mark", "size").count().filter("count > 1")
    pieces = plan.select("doc_id", "mark", "size", "pieces")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.xxhash64("text").alias("__mark"), F.col("doc_id").alias("__doc_id"))
    if not again.isEmpty():  # else neither side repeats a row
        pieces = pieces.groupBy("doc_id", "mark", "size").agg(F.flatten(F.collect_list("pieces")).alias("pieces"))
        whole = whole.groupBy("__doc_id", "__mark").agg(F.first("__doc").alias("__doc"))
    pieces = pieces.filter(F.size("pieces") > 0).select(F.col("doc_id").alias("__id"), F.col("mark").alias("__m"), "size", "pieces")
    met = whole.join(pieces, F.col("__doc_id").eqNullSafe(F.col("__id")) & (F.col("__mark") == F.col("__m")))
    # Each piece is cut before the pieces are told apart, so none carries the whole text with it.
    lit = SPACED_WORD.replace("\\", "\\\\")
    span = "slice(w, CAST(x.first AS INT) + 1, CAST(x.last - x.first AS INT))"
    cut = f"transform(pieces, x -> named_struct('shard', x.shard, 'place', x.place, 'text', IF(x.last - x.first = size, __doc.text, array_join({span}, ''))))"
    split = f"IF(exists(pieces, x -> x.last - x.first < size), regexp_extract_all(__doc.text, '{lit}', 0), CAST(array() AS ARRAY<STRING>))"
    met = met.withColumn("__p", F.expr(f"transform(array({split}), w -> {cut})[0]"))
    others = F.struct(*[F.col(f"__doc.`{c}`").alias(c) for c in docs.columns if c != "text"]).alias("__doc")
    met = met.select(others, F.explode("__p").alias("__p"))
    kept = [(F.col("__p.text") if c == "text" else F.col(f"__doc.`{c}`")).alias(c) for c in docs.columns if c.lower() not in ("shard", "place_key")]
    key = F.xxhash64("__p.shard", "__doc.source", "__p.place", F.lit(seed))
    out = met.select(*kept, F.col("__p.shard").alias("shard"), key.alias("place_key"))
    if not shuffle:
        return out
    n, tasks = last + 1, max(1, round(words / (last + 1) / TASK_WORDS))
    part = F.col("shard").cast("long") * tasks + F.expr(f"least({tasks - 1}L, CAST((place_key / 18446744073709551616D + 0.5D) * {tasks} AS BIGINT))")
    return out.repartitionById(n * tasks, part.cast("int")).sortWithinPartitions("shard", "place_key")
