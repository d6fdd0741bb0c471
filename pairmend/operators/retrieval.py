"""Top-1 retrieval: for each query vector the most similar vector of another row, exactly.

Candidates are dealt into blocks around sampled centres, each with the least and greatest angle of its members to its centre. The
angle between a query and a centre then bounds how similar any member can be, so a query visits its most promising block, then
some more, and at last those that can still win; the rest are never compared. Without clusters in the data all blocks may have to be
visited, which is what an exhaustive search costs. A visit is a matrix product of bounded blocks in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmend.functions.vectors import normalize
from pairmend.sources.shared import settle

QUERY_BLOCK, CANDIDATE_BLOCK = 2_000, 20_000
#: Candidates around a centre, as aimed at, and the most centres (the driver and every task hold them).
CELL, MOST_CENTRES = 5_000, 1_024
#: Rings of different angles that a centre's candidates are parted into, at most.
RINGS = 16
#: Blocks that a query visits before the best found so far decides about all others.
EARLY = 8
#: Candidates of a chunk, and queries that meet it in one task, in the last round.
CHUNK = 10_000
#: Bounds are loosened by this angle, and by this cosine, for rounding.
SLACK, LOOSE = 1e-6, 1e-9

#: Products that a task holds at once.
SLICE = 2_000_000

FOUND = "row_id string, best string, sim double, pairs long"


def best_other(queries: DataFrame, candidates: DataFrame, vector: str = "image_emb", other: str = "text_emb", block: int = CANDIDATE_BLOCK, cell: int = CELL) -> DataFrame:
    """row_id, best_other_row, best_other_sim for each query that has a vector and a rival.

    A row is no rival of its own (by row_id). Of equal similarities the smallest row_id wins. Rows
    without a vector take no part.
    """
    return searched(queries, candidates, vector, other, block, cell).drop("pairs")


def searched(queries: DataFrame, candidates: DataFrame, vector: str = "image_emb", other: str = "text_emb", block: int = CANDIDATE_BLOCK, cell: int = CELL) -> DataFrame:
    """best_other()'s rows with pairs, how many candidates the query was compared with."""
    q = queries.select(F.col("row_id").cast("string").alias("row_id"), normalize(F.col(vector)).alias("v")).filter("v is not null").dropDuplicates(["row_id"])
    c = candidates.select(F.col("row_id").cast("string").alias("row_id"), normalize(F.col(other)).alias("v")).filter("v is not null")
    n = c.count()
    if n <= block:  # one block that all queries visit
        found = _visited(q.withColumn("block", F.lit(0)), c.withColumn("block", F.lit(0)))
    else:
        found = _pruned(settle(q), settle(c), n, block, cell)
    first = F.min_by(F.struct("best", "sim"), F.struct(-F.col("sim"), F.col("best")))
    best = found.groupBy("row_id").agg(first.alias("b"), F.sum("pairs").alias("pairs")).filter("b.best is not null")
    return best.select("row_id", F.col("b.best").alias("best_other_row"), F.col("b.sim").alias("best_other_sim"), "pairs")


def _own(names: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of queries and of candidates of the same name."""
    where: dict[str, list[int]] = {}
    for k, name in enumerate(names):
        where.setdefault(name, []).append(k)
    met = [(k, j) for j, name in enumerate(others) for k in where.get(name, ())]
    return np.array([k for k, _ in met], int), np.array([j for _, j in met], int)


def _best(v: np.ndarray, others: np.ndarray, w: np.ndarray, own: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each query the best candidate but its own (null: none) and how similar it is. Candidates are in order of name; SLICE products are held at once."""
    best, sim = np.full(len(v), None, object), np.full(len(v), -np.inf)
    step = max(1, SLICE // len(w))
    for at in range(0, len(v), step):
        sims = v[at : at + step] @ w.T
        here = (own[0] >= at) & (own[0] < at + step)
        sims[own[0][here] - at, own[1][here]] = -np.inf
        j = sims.argmax(1)
        most = sims[np.arange(len(sims)), j]
        sim[at : at + step] = most
        best[at : at + step] = np.where(most > -np.inf, others[j], None)
    return best, sim


def _visited(visits: DataFrame, blocks: DataFrame) -> DataFrame:
    """FOUND for visits (row_id, v, block) to blocks' rows (row_id, v, block): the best of the block, which may be null."""
    asked = visits.groupBy("block").agg(F.count("*").alias("n")).select("block", F.expr(f"1 + n div {QUERY_BLOCK}").alias("parts"))
    left = visits.join(asked, "block").select("block", F.pmod(F.xxhash64("row_id"), "parts").cast("int").alias("part"), F.lit(True).alias("query"), "row_id", "v")
    right = blocks.join(asked, "block").select("block", F.explode(F.expr("sequence(0, CAST(parts AS INT) - 1)")).alias("part"), F.lit(False).alias("query"), "row_id", "v")

    def top(group: pd.DataFrame) -> pd.DataFrame:
        a, b = group[group["query"]], group[~group["query"]].sort_values("row_id")
        if not len(a) or not len(b):
            return pd.DataFrame({"row_id": [], "best": [], "sim": [], "pairs": []}).astype({"row_id": str, "best": str, "sim": float, "pairs": int})
        names, others = a["row_id"].to_numpy(), b["row_id"].to_numpy()
        best, sim = _best(np.stack(a["v"].to_list()), others, np.stack(b["v"].to_list()), _own(names, others))
        return pd.DataFrame({"row_id": a["row_id"].to_numpy(), "best": best, "sim": sim, "pairs": len(b)})

    return left.union(right).groupBy("block", "part").applyInPandas(top, FOUND)


def _odd(v: np.ndarray) -> np.ndarray:
    """-1 for vectors of zeros, which are similar to nothing (0), and -2 for those so short that they didn't get length 1: angles don't bound them."""
    size = (v * v).sum(1)
    return np.where(size == 0, -1, np.where(size < 0.999, -2, 0))


def _pruned(q: DataFrame, c: DataFrame, n: int, block: int, cell: int) -> DataFrame:
    """FOUND of three rounds of visits over n candidates."""
    wanted = min(MOST_CENTRES, -(-n // cell))
    centres = c.filter(F.pmod(F.xxhash64("row_id"), F.lit(n)) < 2 * wanted).limit(wanted).select("v").collect()
    middle = np.stack([r["v"] for r in centres]) if centres else np.stack([c.first()["v"]])

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                v = np.stack(rows["v"].to_list())
                cos = v @ middle.T
                own = np.where(_odd(v) == 0, cos.argmax(1), _odd(v))
                yield rows.assign(cell=own, angle=np.arccos(np.clip(cos.max(1), -1, 1)))

    dealt = settle(c.mapInPandas(near, "row_id string, v array<double>, cell int, angle double"))
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
    sizes = sizes.withColumn("rings", F.least(F.lit(RINGS), F.ceil(F.col("n") / cell)).cast("int"))
    ring = F.when(F.col("high") > F.col("low"), F.least(F.col("rings") - 1, F.floor((F.col("angle") - F.col("low")) / (F.col("high") - F.col("low")) * F.col("rings")))).otherwise(0).cast("int")
    ringed = dealt.join(F.broadcast(sizes.drop("n")), "cell").withColumn("ring", ring)  # a row a centre
    shapes = ringed.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
    shapes = shapes.orderBy("cell", "ring").collect()  # MOST_CENTRES * RINGS rows at most
    # Shapes lie in chunks, in order; one that is larger than a chunk has several of its own. The last round goes by chunks.
    begins, chunks, filled, at = [], [], CHUNK, -1
    for r in shapes:
        own = -(-r["n"] // CHUNK)
        if own > 1 or filled + r["n"] > CHUNK:
            at, filled = at + 1, 0
        begins.append(at)
        chunks.append(own)
        at, filled = at + own - 1, CHUNK if own > 1 else filled + r["n"]
    begins, chunks = np.array(begins), np.array(chunks)
    named = [(r["cell"], r["ring"], k, -(-r["n"] // block), int(begins[k]), int(chunks[k])) for k, r in enumerate(shapes)]
    names = q.sparkSession.createDataFrame(named, "cell int, ring int, shape int, parts int, begins int, chunks int")
    # A ring of more than a block is several blocks, all of which its visitors see.
    part = F.pmod(F.xxhash64("row_id", F.lit(1)), "parts").cast("int")
    chunk = F.col("begins") + F.pmod(F.xxhash64("row_id", F.lit(2)), "chunks").cast("int")
    dealt = settle(ringed.join(F.broadcast(names), ["cell", "ring"]).select("shape", part.alias("part"), chunk.alias("chunk"), "row_id", "v"))
    members = dealt.select(F.concat_ws(":", "shape", "part").alias("block"), "row_id", "v")
    of, low, high = (np.array([r[x] for r in shapes]) for x in ("cell", "low", "high"))

    def bounds(v: np.ndarray) -> np.ndarray:
        """How similar to each query a member of each shape can be."""
        angle = np.arccos(np.clip(v @ middle.T, -1, 1))[:, np.maximum(of, 0)]
        gap = np.maximum(0, np.maximum(angle - high, low - angle) - SLACK)
        most = np.cos(np.minimum(gap, np.pi)) + LOOSE
        most[:, of == -1] = LOOSE
        most[_odd(v) == -1] = LOOSE
        most[:, of == -2] = 1 + LOOSE
        most[_odd(v) == -2] = 1 + LOOSE
        return most

    def ahead(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each query's bounds, and its EARLY + 1 most promising shapes in order."""
        most = bounds(v)
        k = min(EARLY + 1, most.shape[1])
        top = np.argpartition(-most, k - 1, 1)[:, :k]
        top = np.take_along_axis(top, np.lexsort((top, -np.take_along_axis(most, top, 1)), axis=1), 1)
        return most, top

    def chosen(first: int, last: int | None):
        """Visits to the shapes first to last; without a last one to chunks, where any other shape can still win."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            step = max(1, 2_000_000 // len(of))
            for rows in batches:
                for at in range(0, len(rows), step):
                    some = rows.iloc[at : at + step]
                    most, top = ahead(np.stack(some["v"].to_list()))
                    least = some["least"].to_numpy()[:, None]
                    if last is None:
                        fine = most >= least
                        np.put_along_axis(fine, top, False, 1)
                        wanted = np.zeros((len(some), begins[-1] + chunks[-1]), bool)
                        k, j = np.nonzero(fine)
                        for n in range(chunks.max()):
                            more = chunks[j] > n
                            wanted[k[more], begins[j[more]] + n] = True
                        k, j = np.nonzero(wanted)
                        seen = list(top.astype("int32"))
                        if len(k):
                            yield pd.DataFrame({"row_id": some["row_id"].to_numpy()[k], "v": some["v"].to_numpy()[k], "chunk": j, "least": least[k, 0], "seen": [seen[x] for x in k]})
                        continue
                    order = top[:, first:last]
                    k, j = np.nonzero(np.take_along_axis(most, order, 1) >= least)
                    if len(k):
                        yield pd.DataFrame({"row_id": some["row_id"].to_numpy()[k], "v": some["v"].to_numpy()[k], "shape": order[k, j]})

        return run

    def rest(group: pd.DataFrame) -> pd.DataFrame:
        """The best of a chunk's shapes that can still win, for each of its queries."""
        a, b = group[group["query"]], group[~group["query"]].sort_values(["shape", "row_id"])
        if not len(a) or not len(b):
            return pd.DataFrame({"row_id": [], "best": [], "sim": [], "pairs": []}).astype({"row_id": str, "best": str, "sim": float, "pairs": int})
        ids, others = a["row_id"].to_numpy(), b["row_id"].to_numpy()
        v, w = np.stack(a["v"].to_list()), np.stack(b["v"].to_list())
        least, pairs = a["least"].to_numpy().copy(), np.zeros(len(a), "int64")
        best, sim = np.full(len(a), None, object), np.full(len(a), -np.inf)
        here, begin = np.unique(b["shape"].to_numpy().astype(int), return_index=True)
        end = [*begin[1:], len(b)]
        step = max(1, 2_000_000 // len(of))
        wanted = np.zeros((len(a), len(here)), bool)
        for at in range(0, len(a), step):
            most = bounds(v[at : at + step])
            np.put_along_axis(most, np.stack(a["seen"].iloc[at : at + step].to_list()).astype(int), -np.inf, 1)
            wanted[at : at + step] = most[:, here] >= least[at : at + step, None]
        own = _own(ids, others)
        for s in range(len(here)):
            k = np.nonzero(wanted[:, s])[0]
            if not len(k):
                continue
            mine = (own[1] >= begin[s]) & (own[1] < end[s]) & wanted[own[0], s]
            one, much = _best(v[k], others[begin[s] : end[s]], w[begin[s] : end[s]], (np.searchsorted(k, own[0][mine]), own[1][mine] - begin[s]))
            pairs[k] += end[s] - begin[s]
            more = much > sim[k]
            for x in np.nonzero((much == sim[k]) & (much > -np.inf))[0]:
                more[x] = one[x] < best[k[x]]
            best[k[more]], sim[k[more]] = one[more], much[more]
        return pd.DataFrame({"row_id": ids, "best": best, "sim": sim, "pairs": pairs})

    parts = F.broadcast(names.select("shape", "parts"))
    found = None
    for first, last in ((0, 1), (1, 1 + EARLY), (1 + EARLY, None)):
        if first >= len(of):
            break
        least = q.withColumn("least", F.lit(-2.0))
        if found is not None:
            best = found.groupBy("row_id").agg(F.max("sim").alias("least"))
            least = q.join(best.hint("merge"), "row_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
        if last is None:
            asked = settle(least.mapInPandas(chosen(first, last), "row_id string, v array<double>, chunk int, least double, seen array<int>"))
            counts = asked.groupBy("chunk").agg(F.expr(f"1 + count(*) div {CHUNK}").cast("int").alias("of"))
            left = asked.join(F.broadcast(counts), "chunk").select("chunk", F.pmod(F.xxhash64("row_id"), "of").cast("int").alias("part"), F.lit(True).alias("query"), "row_id", "v", F.lit(0).alias("shape"), "least", "seen")
            right = dealt.drop("part").join(F.broadcast(counts), "chunk")
            right = right.select("chunk", F.explode(F.expr("sequence(0, of - 1)")).alias("part"), F.lit(False).alias("query"), "row_id", "v", "shape", F.lit(0.0).alias("least"), F.array().cast("array<int>").alias("seen"))
            return found.union(settle(left.union(right).groupBy("chunk", "part").applyInPandas(rest, FOUND)))
        visits = least.mapInPandas(chosen(first, last), "row_id string, v array<double>, shape int").join(parts, "shape")
        visits = visits.select("row_id", "v", "shape", F.explode(F.expr("sequence(0, parts - 1)")).alias("part")).select("row_id", "v", F.concat_ws(":", "shape", "part").alias("block"))
        now = settle(_visited(settle(visits), members))
        found = now if found is None else found.union(now)
    return found
