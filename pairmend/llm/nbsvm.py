"""Quality classifier: naive Bayes support vectors.

Features say which character n-grams (bytes, n = 1 to 3, hashed) and hashed words a text has, and how
much its word n-grams repeat, by steps. Each is scaled by its class log-count ratio, and a linear model with hinge loss is fitted by dual coordinate descent.
Scores are the margins through a logistic curve fitted to margins of rows that the fold's model had not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmend.llm import kernels as K
from pairmend.llm.common import settle

WIDTH = 1 << 16
#: Labelled rows that the model is fitted on, at most about this many, chosen by hash.
TRAIN_ROWS = 8_000
FOLDS = 3
#: Documents scoring this or more are predicted good.
LINE = 0.3


def features(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each text the sorted distinct features it has, in 0 .. WIDTH - 1, as uint16."""
    one = data.astype(np.uint32)
    grams = [one]
    if len(data) > 1:
        grams.append(one[:-1] << np.uint32(8) | one[1:] | np.uint32(1 << 24))
    if len(data) > 2:
        grams.append(grams[1][:-1] << np.uint32(8) & np.uint32(0xFFFFFF) | one[2:] | np.uint32(2 << 24))
    hashed = [((g * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16) for g in grams]
    starts, ends, first = K.word_bounds(data, offsets)
    full = K.word_hashes(data, starts, ends)
    words = (full >> np.uint64(48)).astype(np.uint16)
    seen, out = np.zeros(WIDTH, bool), []
    for k in range(len(offsets) - 1):
        a, b = offsets[k], offsets[k + 1]
        for n, h in enumerate(hashed):
            seen[h[a : max(a, b - n)]] = True
        seen[words[first[k] : first[k + 1]]] = True
        seen[_repeats(full[first[k] : first[k + 1]])] = True
        own = np.flatnonzero(seen)
        seen[own] = False
        out.append(own.astype(np.uint16))
    return out


_STEPS = np.array([0.0, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])
_NAMES = (np.arange(3 * len(_STEPS)) * 1_300_021 % WIDTH).astype(np.uint16).reshape(3, -1)


def _repeats(words: np.ndarray) -> np.ndarray:
    """Features for the parts of words, of pairs and of triples of words that were there before."""
    out = []
    for n in (1, 2, 3):
        keys = words if n == 1 else K.window_hashes(words, n)
        if len(keys):
            out.append(_NAMES[n - 1][_STEPS <= 1 - len(np.unique(keys)) / len(keys)])
    return np.concatenate(out) if out else np.zeros(0, np.uint16)


def _all_features(column: pa.Array) -> list[np.ndarray]:
    data, at = K.text_bytes(column)
    out: list[np.ndarray] = []
    for i, j in K.slices(at):
        out += features(data[at[i] : at[j]], at[i : j + 1] - at[i])
    return out


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """For each feature the log of its part of class 1's counts over its part of class 0's."""
    part = []
    for c in (1, 0):
        count = np.full(WIDTH, alpha)
        for k in np.flatnonzero(labels == c):
            count[rows[k]] += 1
        part.append(np.log(count / count.sum()))
    return part[0] - part[1]


def descend(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2 / 2 + cost * sum of hinge losses, by dual coordinate descent.

    A row's vector is the ratios at its features over its own length; the bias is a constant feature.
    Rows of the rarer class cost as much in all as those of the other.
    """
    sign = np.where(labels == 1, 1.0, -1.0)
    size = np.array([(sign == s).sum() for s in (-1.0, 1.0)], float)
    most = cost * len(rows) / 2 / np.maximum(size, 1)[(sign > 0).astype(int)]
    vectors = [ratios[x] / max(np.sqrt(ratios[x] @ ratios[x]), 1e-9) for x in rows]
    square = np.array([v @ v + 1 for v in vectors])
    w, bias, alpha = np.zeros(WIDTH), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for k in rng.permutation(len(rows)):
            slope = sign[k] * (w[rows[k]] @ vectors[k] + bias) - 1
            new = min(max(alpha[k] - slope / square[k], 0.0), most[k])
            if step := (new - alpha[k]) * sign[k]:
                w[rows[k]] += step * vectors[k]
                bias += step
                alpha[k] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, bias


def margins(rows: list[np.ndarray], w: np.ndarray, bias: float, ratios: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows))
    for k, x in enumerate(rows):
        r = ratios[x]
        out[k] = (w[x] @ r) / max(np.sqrt(r @ r), 1e-9) + bias
    return out


def logistic(margin: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of the curve that gives label 1's chance, by Newton's method; slope is positive."""
    n1, n0 = (labels == 1).sum(), (labels == 0).sum()
    goal = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        d, s = p - goal, np.maximum(p * (1 - p), 1e-9)
        g = np.array([d @ margin, d.sum()]) + 1e-3 * np.array([a, b])
        h = np.array([[s @ margin**2, s @ margin], [s @ margin, s.sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = max(a - step[0], 1e-3), b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights, shift): a text's log-odds are the sum of its features' weights over its length, plus shift.

    Without rows of both classes every text gets the chance of the only class seen, or a half.
    """
    if len(set(labels.tolist())) < 2:
        odds = 0.0 if not len(labels) else 3.0 if labels[0] == 1 else -3.0
        return np.zeros((2, WIDTH)), odds
    held, mine = np.arange(len(rows)) % FOLDS, np.zeros(len(rows))
    for fold in range(FOLDS):
        train = np.flatnonzero(held != fold)
        some, y = [rows[k] for k in train], labels[train]
        if len(set(y.tolist())) < 2:
            continue
        ratios = log_count_ratios(some, y)
        w, bias = descend(some, y, ratios)
        test = np.flatnonzero(held == fold)
        mine[test] = margins([rows[k] for k in test], w, bias, ratios)
    slope, shift = logistic(mine, labels)
    ratios = log_count_ratios(rows, labels)
    w, bias = descend(rows, labels, ratios)
    return np.stack([slope * w, ratios]), slope * bias + shift


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """A model from the texts of about `most` labelled documents, fitted in one task.

    labels needs doc_id and the label (1 or 0; other rows are left out). Only labelled ids chosen by
    hash are broadcast, and only the model (2 * WIDTH numbers) comes back to the driver. Of rows that repeat a labelled doc_id
    one is fitted on, the one of the least features, so the task gets no more rows than ids.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    n = known.count()
    some = settle(known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n))) < most).groupBy("doc_id").agg(F.max("label").alias("label")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.released(batches):
            packed = pa.array([x.tobytes() for x in _all_features(batch.column(2))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], ["doc_id", "label", "x"])

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(batches)
        every = pd.concat(frames).sort_values(["doc_id", "x"]) if frames else pd.DataFrame({"label": [], "x": []})
        model, shift = fit([np.frombuffer(x, np.uint16) for x in every["x"]], every["label"].to_numpy(np.int64))
        yield pd.DataFrame({"model": [model.astype(np.float32).tobytes()], "shift": [shift]})

    sample = rows.join(F.broadcast(some), "doc_id").select("doc_id", "label", "text").mapInArrow(found, "doc_id long, label int, x binary").groupBy("doc_id").agg(F.min(F.struct("x", "label")).alias("r")).select("doc_id", "r.label", "r.x")
    model = sample.repartition(1).mapInPandas(fitted, "model binary, shift double").first()
    if model is None:
        return np.zeros((2, WIDTH), np.float32), 0.0
    return np.frombuffer(model["model"], np.float32).reshape(2, WIDTH), model["shift"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], line: float = LINE) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier) and predicted, one row per row of docs.

    Whole texts are scored where they are read. A null or empty text has no features and gets the
    score of the shift alone. Only doc_id and text are read; null and repeated ids are rows like any others.
    """
    weights, shift = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.released(batches):
            m = margins(_all_features(batch.column(1)), weights[0], 0.0, weights[1]) + shift
            p = 1 / (1 + np.exp(-np.clip(m, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= line).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, model: tuple[np.ndarray, float], line: float = LINE) -> DataFrame:
    """The rows of docs, all columns, whose score is line or more."""
    weights, shift = model

    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.released(batches):
            text = batch.column(place).cast(pa.string())
            m = margins(_all_features(text), weights[0], 0.0, weights[1]) + shift
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(m, -30, 30))) >= line))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a document's label is kept for testing: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
