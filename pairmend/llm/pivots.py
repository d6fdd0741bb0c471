"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by its nearest pivots, nearest first. It is posted in the inverted lists of the
first of them, and names some more. Two vectors of one list are candidates if they name enough pivots
both; the lists carry no vectors, only numbers of pivots. Vectors are fetched for those that have a
candidate, and candidates are verified by cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmend.llm.common import settle, small
from pairmend.llm.components import connected_components

#: Nearest pivots in whose lists a vector is posted, pivots it names in all, and how many of these
#: candidates have in common.
POSTED, NAMED, SHARED = 6, 16, 3
#: Pivots in all: four times the root of the number of vectors, within these bounds.
LEAST_PIVOTS, MOST_PIVOTS = 32, 2048
#: Pairs whose counts or cosines are held at a time.
PAIRS = 1_000_000
#: Vectors in a block of a list; a longer list is compared block by block, in groups of two.
BLOCK = 4096
#: Rows of a block that are counted at a time.
TILE = 1024


def _clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors as doubles; none that is null, empty, zero, or has a null or non-finite part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    fine = "vec_id is not null and size(v) > 0 and exists(v, x -> x <> 0) and forall(v, x -> x is not null and abs(x) < double('Infinity'))"
    return rows.filter(f"coalesce({fine}, false)")


def _padded(column: pd.Series, width: int) -> np.ndarray:
    """The vectors as rows; shorter ones are padded with zeros."""
    out = np.zeros((len(column), width))
    for k, v in enumerate(column):
        out[k, : len(v)] = v
    return out


def _units(column: pd.Series, width: int) -> np.ndarray:
    """Rows of length 1; shorter vectors are padded with zeros."""
    return _scaled(_padded(column, width))


def _scaled(out: np.ndarray) -> np.ndarray:
    """The rows at length 1."""
    out = out / np.abs(out).max(1, keepdims=True)  # squares of tiny or huge parts stay in range
    return out / np.sqrt((out * out).sum(1, keepdims=True))


def choose_pivots(distinct: DataFrame, n: int, width: int) -> np.ndarray:
    """Pivots: a sample of the vectors by hash, of at most MOST_PIVOTS."""
    count = int(min(max(LEAST_PIVOTS, 4 * n**0.5), MOST_PIVOTS, n))
    rows = distinct.orderBy(F.xxhash64("v"), "vec_id").select("v").limit(count).toPandas()
    return _units(rows["v"], width)


def permutations(distinct: DataFrame, pivots: np.ndarray, width: int, kind: str = "<f8") -> DataFrame:
    """(id, copies, raw, near, posted): the vector, padded, in numbers of a kind that holds it exactly, its
    nearest pivots, nearest first (of equally near ones the one with the smaller number), and the first of them."""
    named = min(NAMED, len(pivots))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            unit = _units(batch["v"], width)
            close = unit @ pivots.T
            top = np.argpartition(-close, named - 1, axis=1)[:, :named]
            order = np.lexsort((top, -np.take_along_axis(close, top, 1)), axis=1)
            near = np.take_along_axis(top, order, 1).astype("<i2")
            raw = _padded(batch["v"], width).astype(kind)
            yield pd.DataFrame({"id": batch["id"], "copies": batch["copies"], "raw": [x.tobytes() for x in raw], "near": [x.tobytes() for x in near], "posted": near[:, :POSTED].tolist()})

    return distinct.mapInPandas(run, "id long, copies long, raw binary, near binary, posted array<int>")


def _candidates(near: np.ndarray, block: np.ndarray, across: bool, shared: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Paired rows of a list that name `shared` pivots or more both, the first before the second.

    Where few rows name one pivot, the rows of each are paired and the pairs counted; where many do, the
    counts are a product of matrices. Across two blocks only pairs of one row from each are made.
    """
    n, each = near.shape
    local = np.unique(near, return_inverse=True)[1].reshape(n, each)
    width = int(local.max()) + 1
    for i in range(0, n, TILE):
        a = local[i : i + TILE]
        many = np.bincount(a.ravel(), minlength=width)
        for j in range(i, n, TILE):
            b = local[j : j + TILE]
            both = many * np.bincount(b.ravel(), minlength=width)
            if both.sum() * 200 < len(a) * len(b) * width and both.sum() < 8 * PAIRS:
                x, y = _met(a, b, width)
                count = np.bincount(x * len(b) + y, minlength=1)
                x, y = np.divmod(np.flatnonzero(count >= shared), len(b))
            else:
                x, y = np.nonzero(_marks(a, width) @ _marks(b, width).T >= shared - 0.5)
            x, y = x + i, y + j
            fits = (block[x] != block[y]) & (x < y) if across else x < y
            yield x[fits], y[fits]


def _marks(rows: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.float32)
    np.put_along_axis(out, rows, 1, axis=1)
    return out


def _met(a: np.ndarray, b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A pair of rows for each pivot that a row of a and one of b name both."""
    order = np.argsort(b.ravel(), kind="stable")
    first = np.searchsorted(b.ravel()[order], np.arange(width + 1))
    pivot = a.ravel()
    times = first[pivot + 1] - first[pivot]
    x = np.repeat(np.repeat(np.arange(len(a)), a.shape[1]), times)
    at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[pivot], times)
    return x, order[at] // b.shape[1]


def _grouped(work: Callable[[pd.DataFrame], Iterator[pd.DataFrame]]):
    """A function over batches of rows in the order of (pivot, i, j) that gives each such group to work."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            marks = batch[["pivot", "i", "j"]].to_numpy()
            cuts = (np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist()
            if held and tuple(held[-1][["pivot", "i", "j"]].iloc[-1]) != tuple(marks[0]):
                yield from work(pd.concat(held, ignore_index=True))
                held = []
            for a, b in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                held.append(batch.iloc[a:b])
                if b < len(batch):
                    yield from work(pd.concat(held, ignore_index=True))
                    held = []
        if held:
            yield from work(pd.concat(held, ignore_index=True))

    return run


def _near_of(rows: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(rows["near"]), "<i2").reshape(len(rows), -1)


def _with_candidates(shared: int):
    """A function from a group of a list to its rows that have a candidate there, without what they name."""

    def work(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        some = np.zeros(len(rows), bool)
        for x, y in _candidates(_near_of(rows), rows["own"].to_numpy(), rows["i"].iat[0] != rows["j"].iat[0], shared):
            some[x] = some[y] = True
        if some.any():
            yield rows.loc[some, ["id", "pivot", "own", "i", "j"]]

    return _grouped(work)


def _verified(threshold: float, shared: int, kind: str):
    """A function from a group of a list to (id, n, root): its links, and where they lead.

    A link is counted in the list of the smallest pivot in whose lists both its vectors are posted.
    """

    def work(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        unit = _scaled(np.frombuffer(b"".join(rows["raw"]), kind).reshape(len(rows), -1).astype(np.float64))
        near, pivot = _near_of(rows), rows["pivot"].iat[0]
        posted = near[:, :POSTED]
        ids, copies = rows["id"].to_numpy(), rows["copies"].to_numpy()
        counts, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for left, right in _candidates(near, rows["own"].to_numpy(), rows["i"].iat[0] != rows["j"].iat[0], shared):
            for k in range(0, len(left), PAIRS // 8):
                x, y = left[k : k + PAIRS // 8], right[k : k + PAIRS // 8]
                linked = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
                x, y = x[linked], y[linked]
                if not len(x):
                    continue
                here = posted[x]
                common = (here[:, :, None] == posted[y][:, None, :]).any(2)
                first = np.where(common, here, np.iinfo(np.int16).max).min(1) == pivot
                np.add.at(counts, x[first], copies[y[first]])
                np.add.at(counts, y[first], copies[x[first]])
                while True:
                    new = root.copy()
                    np.minimum.at(new, root[x], root[y])
                    np.minimum.at(new, root[y], root[x])
                    new = new[new]
                    if (new == root).all():
                        break
                    root = new
        met = np.flatnonzero((counts > 0) | (root != np.arange(len(ids))) | np.isin(np.arange(len(ids)), root[root != np.arange(len(ids))]))
        if len(met):
            yield pd.DataFrame({"id": ids[met], "n": counts[met], "root": ids[root[met]]})

    return _grouped(work)


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, shared: int = SHARED) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    vectors needs vec_id and embedding; labels and other columns are not looked at. Links join
    vectors whose cosine is threshold or more; n_links counts the other rows linked directly, and
    component_id is the smallest vec_id reachable. Bitwise copies are compared once and counted as
    often as they are there, so a hot group of copies is one vector.

    Every vector is indexed, none is left out of a long list, and no link below the threshold is
    reported; by one rule at every size, a link is missed only if its vectors are posted in no common list or share
    fewer than `shared` of the pivots that they name.
    Defined results: a vector that is null, empty, zero, or holds a null or non-finite part links with
    nothing and is kept; a shorter vector counts as padded with zeros; rows without a vec_id link with nothing;
    rows that repeat a vec_id are rows of their own, each linked by its own vector.
    """
    spark: SparkSession = vectors.sparkSession
    good = _clean(vectors)
    distinct = good.groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    distinct = settle(distinct.withColumn("id", F.monotonically_increasing_id()))
    n, width = distinct.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    if n:
        index = settle(permutations(distinct, choose_pivots(distinct, n, width), width, kind))
    else:
        index = spark.createDataFrame([], "id long, copies long, raw binary, near binary, posted array<int>")
    lists = index.select("id", "near", F.explode("posted").alias("pivot"))
    # One row a pivot at most: of a bounded size.
    long = F.broadcast(settle(lists.groupBy("pivot").agg(F.count("*").alias("n")).filter("n > 1").selectExpr("pivot", f"1 + (n - 1) div {BLOCK} AS blocks")))
    rows = lists.join(long, "pivot").withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("id", "near", "pivot", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rows = rows.repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j")
    some = settle(rows.mapInPandas(_with_candidates(shared), "id long, pivot int, own long, i long, j long"))
    rows = some.join(index, "id").repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j")
    met = settle(rows.select("id", "pivot", "own", "i", "j", "copies", "raw", "near").mapInPandas(_verified(threshold, shared, kind), "id long, n long, root long"))
    # From numbers of vectors to vec_ids: a component is named by the smallest of its vectors' rows.
    found = settle(connected_components(met, "id", "root").withColumnRenamed("component_id", "comp"))
    ids = distinct.select("id", "vec_id")
    names = small(settle(found.join(ids, "id").groupBy("comp").agg(F.min("vec_id").alias("component_id"))))
    found = found.join(names, "comp").select("id", "component_id")
    counts = met.groupBy("id").agg(F.sum("n").alias("n"))
    reps = settle(distinct.join(counts, "id", "left").join(found, "id", "left").selectExpr("v", "copies - 1 + coalesce(n, 0) AS n_links", "coalesce(component_id, vec_id) AS component_id"))
    own = good.join(reps, "v").select("vec_id", "n_links", "component_id")
    rest = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).exceptAll(own.select("vec_id"))
    rest = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return own.union(rest).select("*", F.coalesce(F.expr("vec_id = component_id"), F.lit(True)).alias("kept"))

