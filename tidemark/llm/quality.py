"""Quality classifier: linear support vectors on n-grams scaled by naive Bayes ratios.

Features are indicators of hashed n-grams: single tokens and pairs, and runs of
one to three token shapes. Indicators are scaled by the log ratio of their smoothed
class frequencies; a hinge-loss linear model is fit by dual coordinate descent and
drawn towards its mean weight. Out-of-fold margins of the training rows give a
logistic curve from margin to probability, weighted to the class shares of all
labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import Rolling, mix

BITS = 18
DIMENSIONS = 1 << BITS
#: Labelled rows of each class that training takes, in order of a hash of their id.
SAMPLE_PER_CLASS = 2500
HELD_OUT_FOLDS = 5
THRESHOLD = 0.3
EPOCHS = 12
COST = 1.0
MEAN_SHARE = 0.25

_KIND = np.full(256, 4, np.uint8)  # 0 space, 1 lower, 2 upper, 3 digit, 4 other
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[97:123] = 1
_KIND[128:] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_GROUP = np.array([0, 1, 1, 3, 4], np.uint8)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature numbers of a text; an empty text has the bias alone."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.zeros(1, np.int64)
    kind = _KIND[data]
    group = _GROUP[kind]
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    end = np.concatenate([start[1:], [len(data)]])
    real = group[start] != 0
    start, end = start[real], end[real]
    if not len(start):
        return np.zeros(1, np.int64)
    token = Rolling(_LOWER[data]).of(start, end)
    upper = np.concatenate([[0], np.cumsum(kind == 2)])
    capitals = np.minimum(upper[end] - upper[start], 2)
    size = np.minimum(end - start, 12)
    gap = np.concatenate([[2], np.minimum(start[1:] - end[:-1], 2)])
    shape = ((group[start].astype(np.uint64) * np.uint64(3) + capitals.astype(np.uint64)) * np.uint64(13) + size.astype(np.uint64)) * np.uint64(3)
    shape = np.where(group[start] == 4, token ^ np.uint64(77), mix(shape + gap.astype(np.uint64)))
    odd = np.uint64(0x9E3779B97F4A7C15)
    grams = [token, mix(token[:-1] * odd + token[1:]), shape + np.uint64(1)]
    grams.append(mix(shape[:-1] * odd + shape[1:]))
    again = token[1:] == token[:-1]
    grams.append(mix(shape[1:][again] ^ np.uint64(1234567)))
    if len(shape) > 2:
        grams.append(mix((shape[:-2] * odd + shape[1:-1]) * odd + shape[2:]))
    found = np.unique(np.concatenate(grams) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.union1d([0], found)


@dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * margin + shift))); margin = weights of the features, over the root of their number."""

    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def score(self, found: np.ndarray) -> float:
        margin = float(self.weights[found].sum() / np.sqrt(len(found)))
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30))))


def log_ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """log of each feature's smoothed share in good rows over that in bad ones."""
    share = []
    for label in (True, False):
        counts = np.ones(DIMENSIONS)
        for i in np.flatnonzero(good == label):
            counts[rows[i]] += 1
        share.append(counts / counts.sum())
    return np.log(share[0] / share[1])


def fit_weights(rows: list[np.ndarray], good: np.ndarray, epochs: int = EPOCHS, cost: float = COST, seed: int = 7) -> np.ndarray:
    """Weights on plain indicators of a hinge-loss fit to ratio-scaled ones."""
    ratios = log_ratios(rows, good)
    sign = np.where(good, 1.0, -1.0)
    bound = cost * np.where(good, len(good) / (2 * max(good.sum(), 1)), len(good) / (2 * max((~good).sum(), 1)))
    values = [(ratios[r] / np.sqrt(len(r))).astype(np.float32) for r in rows]
    square = np.array([float(v @ v) for v in values]) + 1e-12
    dual, weights = np.zeros(len(rows)), np.zeros(DIMENSIONS)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(rows)):
            slack = sign[i] * float(weights[rows[i]] @ values[i]) - 1
            new = min(max(dual[i] - slack / square[i], 0.0), bound[i])
            if new != dual[i]:
                weights[rows[i]] += (new - dual[i]) * sign[i] * values[i]
                worst = max(worst, abs(new - dual[i]))
                dual[i] = new
        if worst < 1e-4:
            break
    used = np.abs(weights) > 1e-9  # of what is rounding alone the sign is chance
    mean = np.abs(weights[used]).mean() if used.any() else 0.0
    drawn = np.where(used, (1 - MEAN_SHARE) * weights + MEAN_SHARE * mean * np.sign(weights), 0)
    return drawn * ratios


def fit(rows: list[np.ndarray], good: np.ndarray, good_share: float, folds: int = 4) -> Model:
    """A calibrated model; with one class or none the score is that class's share, or one half."""
    if good.all() or not good.any():
        share = 0.5 if not len(good) else (len(good) * float(good[0]) + 1) / (len(good) + 2)
        return Model(np.zeros(DIMENSIONS), 0.0, float(np.log(share / (1 - share))))
    fold = np.arange(len(good)) % folds
    margin = np.zeros(len(good))
    for k in range(folds):
        inside = fold != k
        weights = fit_weights([r for r, x in zip(rows, inside) if x], good[inside])
        for i in np.flatnonzero(~inside):
            margin[i] = weights[rows[i]].sum() / np.sqrt(len(rows[i]))
    share = min(max(good_share, 1e-3), 1 - 1e-3)
    weight = np.where(good, share / good.mean(), (1 - share) / (1 - good.mean()))
    slope, shift = _logistic(margin, good.astype(float), weight)
    return Model(fit_weights(rows, good), slope, shift)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift by damped Newton steps, labels softened as in Platt's method."""
    n1, n0 = y.sum(), len(y) - y.sum()
    y = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    design = np.stack([x, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weight * (y - p)) - 1e-3 * beta
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta += step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fold_of(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo the number of folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % HELD_OUT_FOLDS


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fit on at most ``per_class`` labelled rows of each class outside the held-out fold.

    ``labels`` has (doc_id, quality); other qualities than 0 and 1, and ids without
    a text, are ignored. Only features of the sampled rows come to the driver.
    """
    usable = labels.where("doc_id is not null and quality in (0, 1)").where(fold_of() != 0).select("doc_id", "quality")
    usable = usable.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    shares = {r[0]: r[1] for r in usable.groupBy("quality").count().collect()}
    if not shares:
        return fit([], np.zeros(0, bool), 0.5)
    place = F.xxhash64("doc_id", F.lit(5))
    picked = None
    for quality in sorted(shares):
        part = usable.where(F.col("quality") == quality).orderBy(place, "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    small = F.broadcast(picked.select(F.col("doc_id").alias("_id"), "quality"))  # at most 2 * per_class rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t).astype(np.int32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2)], ["doc_id", "found", "quality"])

    joined = docs.select("doc_id", "text").join(small, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "quality")
    sample = joined.mapInArrow(run, "doc_id bigint, found binary, quality int")
    # An id that several rows share may give more rows than were picked: one of each id is kept.
    rows = sample.groupBy("doc_id").agg(F.min("found").alias("found"), F.max("quality").alias("quality")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    found = [np.frombuffer(r["found"], np.int32) for r in rows]
    good = np.array([r["quality"] == 1 for r in rows], bool)
    return fit(found, good, shares.get(1, 0) / sum(shares.values()))


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``: the probability of good quality, from the text alone.

    Null and empty texts get the score of a text without features. A column of
    that name in ``docs`` is replaced. The model has a fixed size.
    """
    keep = [c for c in docs.columns if c != name]
    at = keep.index(text_col)
    weights, slope, shift = model.weights.astype(np.float32), model.slope, model.shift

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Model(weights.astype(np.float64), slope, shift)
        for batch in batches:
            scores = [held.score(features(t)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*plain, "score"])

    # mapInArrow cannot take names with dots.
    plain = [f"_c{i}" for i in range(len(keep))]
    schema = ", ".join(f"{p} {docs.schema[c].dataType.simpleString()}" for p, c in zip(plain, keep))
    rows = docs.select(*[F.col(f"`{c}`").alias(p) for p, c in zip(plain, keep)])
    return rows.mapInArrow(run, f"{schema}, score double").toDF(*keep, name)
