"""Quality classifier by positive-unlabelled learning.

A linear model on features of form (shares of single byte values, word lengths, repetition) minimises the
non-negative unbiased risk: trusted positives against unlabelled web text, given an estimated prior of
good text. Rows known to be bad never enter the risk; they only help to place the cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, bucket_of, chunks, cut_words, others, text_rows

N_SHAPE = 8
N_FEATURES = 256 + N_SHAPE


class QualityModel(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    cut: float
    steep: float
    prior: float


def text_features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of features per text of a chunk; all zero for an empty text."""
    n = len(offs) - 1
    size = np.maximum(np.diff(offs), 1).astype(np.float64)
    row = np.repeat(np.arange(n), np.diff(offs))
    bytes_of = np.bincount(row * 256 + data, minlength=n * 256).reshape(n, 256)
    out = np.zeros((n, N_FEATURES), np.float32)
    out[:, :256] = np.sqrt(bytes_of / size[:, None])
    w = cut_words(data, offs)
    count = np.bincount(w.row, minlength=n).astype(np.float64)
    some = np.maximum(count, 1)
    length = (w.end - w.start).astype(np.float64)
    order = np.lexsort((w.hash, w.row))
    h, r = w.hash[order], w.row[order]
    again = np.bincount(r[1:][(h[1:] == h[:-1]) & (r[1:] == r[:-1])], minlength=n) if len(h) > 1 else np.zeros(n)
    mean = np.bincount(w.row, length, n) / some
    square = np.bincount(w.row, length**2, n) / some
    first = data[w.start] if len(w.start) else data[:0]
    last = data[w.end - 1] if len(w.start) else data[:0]
    shape = [
        np.log1p(count) / 10,
        mean / 10,
        np.sqrt(np.maximum(square - mean**2, 0)) / 10,
        again / some,
        np.bincount(w.row, (first >= 65) & (first <= 90), n) / some,
        np.bincount(w.row, (last < 48) | ((last > 57) & (last < 65)), n) / some,
        np.bincount(w.row, length == 1, n) / some,
        np.sqrt(count / size),
    ]
    out[:, 256:] = np.stack(shape, 1)
    return out


def with_features(df: DataFrame, text: str = "text", *kept: str) -> DataFrame:
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [text_features(data, offs) for _, _, data, offs in chunks(text_rows(batch, text))]
            flat = np.concatenate(parts).ravel() if parts else np.zeros(0, np.float32)
            ends = np.arange(0, len(flat) + 1, N_FEATURES, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in kept), pa.ListArray.from_arrays(ends, pa.array(flat))], [*kept, "features"])

    return df.select(*kept, text).mapInArrow(run, ", ".join([*(f"`{k}` {fields[k]}" for k in kept), "features array<float>"]))


def _adam(gradient, w: np.ndarray, steps: int, rate: float = 0.05) -> np.ndarray:
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def estimate_prior(score_p: np.ndarray, score_u: np.ndarray, least: float = 0.5) -> float:
    """Share of positives in the unlabelled rows: the least ratio of the two tails above any cut.

    Above a high cut unlabelled rows are nearly all positive, so the ratio of tails nears the prior from
    above. Cuts that keep under ``least`` of the positives are too noisy to use.
    """
    cuts = np.quantile(score_p, np.linspace(0.02, 1 - least, 25))
    ratio = [(score_u > c).mean() / max((score_p > c).mean(), 1e-9) for c in cuts]
    return float(np.clip(min(ratio), 0.05, 0.98))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 400, ridge: float = 5.0) -> QualityModel:
    """Minimise the non-negative unbiased risk with the logistic loss; ``ridge`` counts as so many rows."""
    ridge = ridge / len(positive)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    p, u = (np.hstack([np.clip((x - mean) / scale, -6, 6), np.ones((len(x), 1), np.float32)]).astype(np.float32) for x in (positive, unlabelled))
    w = np.zeros(p.shape[1], np.float32)

    def apart(w: np.ndarray) -> np.ndarray:  # plain positives against unlabelled, for the prior
        return ridge * w - p.T @ _sigmoid(-(p @ w)) / len(p) + u.T @ _sigmoid(u @ w) / len(u)

    first = _adam(apart, w, steps // 2)
    prior = estimate_prior(p @ first, u @ first)

    def risk(w: np.ndarray) -> np.ndarray:
        gp, gu = p @ w, u @ w
        as_negative_u, as_negative_p = np.logaddexp(0, gu).mean(), np.logaddexp(0, gp).mean()
        down = u.T @ _sigmoid(gu) / len(u) - prior * (p.T @ _sigmoid(gp)) / len(p)
        if as_negative_u - prior * as_negative_p < 0:  # the estimated negative risk cannot be below 0
            return ridge * w - down
        return ridge * w - prior * (p.T @ _sigmoid(-gp)) / len(p) + down

    w = _adam(risk, w, steps)
    return QualityModel(mean, scale, w[:-1], float(w[-1]), 0.0, 1.0, prior)


def _margin(model: QualityModel, x: np.ndarray) -> np.ndarray:
    return np.clip((x - model.mean) / model.scale, -6, 6) @ model.weights + model.bias


def scores(model: QualityModel, x: np.ndarray) -> np.ndarray:
    """0 to 1; the cut lies at 0.7."""
    return _sigmoid(model.steep * (_margin(model, x) - model.cut) + np.log(0.7 / 0.3))


def fit_quality(docs: DataFrame, labels: DataFrame, max_positive: int = 6000, max_unlabelled: int = 10_000, held_out: int = 2, folds: int = 4) -> QualityModel | None:
    """Learn from a bounded sample of rows outside the held-out fold; None without trusted positives.

    ``max_positive`` and ``max_unlabelled`` bound the sample. Rows labelled bad only place the cut: the
    margin with the best mean of both hit rates among labelled rows. Without any, the cut stays at even odds.
    """
    open_rows = docs.select("doc_id", "text").where(bucket_of("doc_id", folds) != held_out)
    known = labels.where(bucket_of("doc_id", folds) != held_out).where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    marked = bounded_sample(known.where("quality = 1"), max_positive, "doc_id").unionByName(bounded_sample(known.where("quality = 0"), max_positive // 3, "doc_id"))
    # an id may stand for many rows: what comes of the join is bounded again
    rows = bounded_sample(open_rows.join(F.broadcast(marked), "doc_id"), max_positive + max_positive // 3, "doc_id", "text")
    good = with_features(rows, "text", "quality").toArrow()
    free = with_features(bounded_sample(open_rows, max_unlabelled, "doc_id", "text"), "text").toArrow()
    x, y = _matrix(good), good.column("quality").to_numpy()
    if not (y == 1).any() or not free.num_rows:
        return None
    model = fit_pu(x[y == 1], _matrix(free))
    margin = _margin(model, x)
    spread = max(float(np.std(margin)), 1e-6)
    if (y == 0).any():
        cuts = np.unique(np.quantile(margin, np.linspace(0, 1, 401)))
        hit = [(margin[y == 1] >= c).mean() + (margin[y == 0] < c).mean() for c in cuts]
        best = np.flatnonzero(np.array(hit) >= max(hit) - 1e-9)
        cut = float((cuts[best[0]] + cuts[max(best[0] - 1, 0)]) / 2)
    else:
        cut = 0.0
    return model._replace(cut=cut, steep=2.0 / spread)


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("features").combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)


def score_quality(docs: DataFrame, model: QualityModel | None, text: str = "text", score: str = "score") -> DataFrame:
    """Adds ``score`` to a table; an own column of that name (in any case) is replaced.

    Null and empty texts have all features zero and are scored as such. Without a model nothing is known
    and every score is 0.7, the least that is accepted. Repeated rows are scored alike.
    """
    kept = others(docs.columns, (score,))
    if model is None:
        return docs.select(*kept, F.lit(0.7).alias(score))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [scores(shared.value, text_features(data, offs)) for _, _, data, offs in chunks(text_rows(batch, text))]
            found = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*kept, score])

    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields), f"`{score}` double"])
    return docs.select(*kept).mapInArrow(run, schema)
