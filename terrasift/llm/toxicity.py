"""Toxicity: a convolutional text classifier in numpy.

Hashed word embeddings, filters of several widths, max pooling over the whole text, and a logistic
output. Gradients flow only through the pooled positions. The cut is calibrated by language, which is
told from the text's own function words, never from a column.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, bounded_sample, bucket_of, chunks, cut_words, others, text_rows

BUCKETS = 1 << 17
DIMENSIONS = 12
WIDTHS = (1, 2, 3)
FILTERS = 8

#: Letters, digits and all bytes of characters beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[48:58] = LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True

# Frequent function words by language.
FUNCTION_WORDS = {
    "de": "auf das dem den der die ein eine für im ist mit nicht sich und von zu",
    "en": "a and are as at be by for from in is it of on that the this to was with",
    "es": "al como con del el en es la las lo los no para por que se su un una y",
    "fr": "au avec ce dans de des du est et la le les ne pas plus pour qui sur un une",
}
LANGUAGES = tuple(FUNCTION_WORDS)


class ToxicityModel(NamedTuple):
    tables: list[list[np.ndarray]]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    cut: np.ndarray
    steep: float


def _hash_of(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(cut_words(data, np.array([0, len(data)]), solid_bytes=LETTERS).hash[0])


_function_hashes = np.array([_hash_of(w) for words in FUNCTION_WORDS.values() for w in words.split()], np.uint64)
_function_language = np.array([k for k, words in enumerate(FUNCTION_WORDS.values()) for _ in words.split()])
_by_hash = np.argsort(_function_hashes)


def word_ids(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words of a chunk, their rows, and each row's language (the one with most function words)."""
    w = cut_words(LOWER[data], offs, solid_bytes=LETTERS)
    ordered = _function_hashes[_by_hash]
    at = np.minimum(np.searchsorted(ordered, w.hash), len(ordered) - 1)
    hit = ordered[at] == w.hash
    n = len(offs) - 1
    votes = np.zeros((n, len(LANGUAGES)))
    # a word of several languages votes for each
    for k in range(len(LANGUAGES)):
        own = np.sort(_function_hashes[_function_language == k])
        at = np.minimum(np.searchsorted(own, w.hash[hit]), len(own) - 1)
        votes[:, k] = np.bincount(w.row[hit], own[at] == w.hash[hit], n)
    return (w.hash & np.uint64(BUCKETS - 1)).astype(np.int64), w.row, votes.argmax(1)


def pooled(tables: list[list[np.ndarray]], ids: np.ndarray, row: np.ndarray, n: int, positions: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    """Largest response of each filter in each row; words beyond the row's end count as zeros.

    tables[k][j] holds, for filter width k, what the word at offset j adds. Rows without words pool to 0.
    """
    out = np.zeros((n, len(tables) * FILTERS), np.float32)
    where = []
    if not len(ids):
        return out, where
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    rows = row[starts]
    for k, offsets in enumerate(tables):
        y = offsets[0][ids]
        for j in range(1, len(offsets)):
            more = offsets[j][ids[j:]]
            more[row[j:] != row[:-j]] = 0
            y[: len(ids) - j] += more
        best = np.maximum.reduceat(y, starts, axis=0)
        out[rows, k * FILTERS : (k + 1) * FILTERS] = best
        if positions:
            group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(ids)]))
            at = np.empty((len(starts), FILTERS), np.int64)
            for f in range(FILTERS):
                hit = np.flatnonzero(y[:, f] == best[group, f])
                first = np.r_[True, group[hit][1:] != group[hit][:-1]]
                at[:, f] = hit[first]
            where.append(at)
    return out, where


def fit_cnn(ids: list[np.ndarray], label: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.08, seed: int = 5) -> tuple:
    """Train on whole texts (arrays of hashed words) with Adagrad.

    The first embedding dimension starts as each word's shrunk log-odds among the training rows; the
    others start at random.
    """
    rng = np.random.default_rng(seed)
    base = float(np.clip(label.mean(), 0.01, 0.99))
    seen, bad = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for x, y in zip(ids, label, strict=True):
        u = np.unique(x)
        seen[u] += 1
        bad[u] += y
    share = (bad + 5 * base) / (seen + 5)
    odds = np.log(share / (1 - share)) - np.log(base / (1 - base))
    emb = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    emb[:, 0] = odds / 2
    filters = [rng.normal(0, 0.2, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[0, 0, :2] += 1.0
    bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
    out = rng.normal(0.1, 0.1, len(bias)).astype(np.float32)
    out_bias = np.float32(np.log(base / (1 - base)))
    memory = {"e": np.full(BUCKETS, 1e-2, np.float32), "f": [np.full_like(f, 1e-2) for f in filters], "b": np.full_like(bias, 1e-2), "o": np.full_like(out, 1e-2), "c": np.float32(1e-2)}
    weight = np.where(label == 1, 0.5 / base, 0.5 / (1 - base)) ** 0.5
    for _ in range(epochs):
        order = rng.permutation(len(ids))
        for lo in range(0, len(order), batch):
            part = order[lo : lo + batch]
            flat = np.concatenate([ids[i] for i in part])
            row = np.repeat(np.arange(len(part)), [len(ids[i]) for i in part])
            local, inverse = np.unique(flat, return_inverse=True)
            tables = [[emb[local] @ f[j] for j in range(len(f))] for f in filters]
            top, where = pooled(tables, inverse, row, len(part), True)
            hidden = np.maximum(top + bias, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ out + out_bias, -30, 30)))
            err = ((p - label[part]) * weight[part] / len(part)).astype(np.float32)
            d_top = err[:, None] * out * (top + bias > 0)
            d_out, d_c = hidden.T @ err + 1e-4 * out, err.sum()
            memory["o"] += d_out**2
            out -= rate * d_out / np.sqrt(memory["o"])
            memory["c"] += d_c**2
            out_bias -= rate * d_c / np.sqrt(memory["c"])
            d_b = d_top.sum(0)
            memory["b"] += d_b**2
            bias -= rate * d_b / np.sqrt(memory["b"])
            if not len(flat):
                continue
            rows = np.unique(row)
            d_emb = np.zeros((len(local), DIMENSIONS), np.float32)
            for k, f in enumerate(filters):
                d = d_top[rows, k * FILTERS : (k + 1) * FILTERS]
                d_f = np.zeros_like(f)
                for j in range(len(f)):
                    at = where[k] + j
                    inside = (at < len(flat)) & (row[np.minimum(at, len(flat) - 1)] == rows[:, None]) & (d != 0)
                    if not inside.any():
                        continue
                    b, c = np.nonzero(inside)
                    word = inverse[at[b, c]]
                    x = emb[local[word]]
                    g = d[b, c][:, None]
                    np.add.at(d_f[j].T, c, x * g)
                    np.add.at(d_emb, word, f[j][:, c].T * g)
                memory["f"][k] += d_f**2
                f -= rate * d_f / np.sqrt(memory["f"][k])
            moved = np.flatnonzero(d_emb.any(1))
            memory["e"][local[moved]] += (d_emb[moved] ** 2).mean(1)
            emb[local[moved]] -= rate * d_emb[moved] / np.sqrt(memory["e"][local[moved]])[:, None]
    return emb, filters, bias, out, out_bias


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def margins(model: ToxicityModel, ids: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    top, _ = pooled(model.tables, ids, row, n)
    return np.maximum(top + np.concatenate(model.bias), 0) @ model.out + model.out_bias


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_toxic: int = 1500, max_clean: int = 3500, held_out: int = 0, folds: int = 5) -> ToxicityModel | None:
    """Learn from a bounded sample of labelled rows outside the held-out fold; None unless both labels occur.

    The cut of each language is the margin with the best mean of both hit rates among a quarter of the
    sample kept from training, drawn towards the common cut where a language has few rows.
    """
    known = labels.where(bucket_of("doc_id", folds) != held_out).where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = bounded_sample(known.where("toxic = 1"), max_toxic, "doc_id").unionByName(bounded_sample(known.where("toxic = 0"), max_clean, "doc_id"))
    # an id may stand for many rows: what comes of the join is bounded again
    rows = bounded_sample(docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id"), max_toxic + max_clean, "doc_id", "text").select("text", "toxic", "doc_id").toArrow()
    label = rows.column("toxic").to_numpy().astype(np.int64) if rows.num_rows else np.zeros(0, np.int64)
    if len(np.unique(label)) < 2:
        return None
    ids, language = [], []
    for _, _, data, offs in chunks(rows.column("text").combine_chunks()):
        x, row, lang = word_ids(data, offs)
        ids += np.split(x, np.searchsorted(row, np.arange(1, len(offs) - 1)))
        language.append(lang)
    language = np.concatenate(language)
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    ids, label, language = [ids[i] for i in order], label[order], language[order]
    check = np.random.default_rng(1).random(len(ids)) < 0.25
    if len(np.unique(label[check])) < 2 or len(np.unique(label[~check])) < 2:
        check[:] = False
    train = np.flatnonzero(~check)
    emb, filters, bias, out, out_bias = fit_cnn([ids[i] for i in train], label[train])
    tables = [[(emb @ f[j]).astype(np.float32) for j in range(len(f))] for f in filters]
    model = ToxicityModel(tables, [bias[k * FILTERS : (k + 1) * FILTERS] for k in range(len(WIDTHS))], out, float(out_bias), np.zeros(len(LANGUAGES)), 1.0)
    at = np.flatnonzero(check) if check.any() else train
    margin = np.array([margins(model, ids[i], np.zeros(len(ids[i]), np.int64), 1)[0] for i in at])
    y = label[at]

    def best(m: np.ndarray, t: np.ndarray) -> float:
        cuts = np.unique(m)
        cuts = np.r_[cuts[0] - 1, (cuts[1:] + cuts[:-1]) / 2, cuts[-1] + 1]
        ranked = np.sort(m[t == 1]), np.sort(m[t == 0])
        hit = (1 - np.searchsorted(ranked[0], cuts) / len(ranked[0])) + np.searchsorted(ranked[1], cuts) / len(ranked[1])
        good = np.flatnonzero(hit >= hit.max() - 1e-9)
        return float(cuts[good[len(good) // 2]])

    common = best(margin, y)
    cut = np.full(len(LANGUAGES), common)
    for k in range(len(LANGUAGES)):
        own = language[at] == k
        few = min((y[own] == 1).sum(), (y[own] == 0).sum())
        if few:
            cut[k] = (few * best(margin[own], y[own]) + 20 * common) / (few + 20)
    return model._replace(cut=cut, steep=4.0 / max(float(margin.std()), 1e-6))


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, text: str = "text") -> DataFrame:
    """Adds ``score``, 0 to 1 with the cut of the text's language at 0.5; an own column of that name is replaced.

    Every whole text is read. Null and empty texts pool to nothing and get the model's score for that.
    Without a model every score is 0. Repeated rows are scored alike.
    """
    kept = others(docs.columns, ("score",))
    if model is None:
        return docs.select(*kept, F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            parts = []
            for _, _, data, offs in chunks(text_rows(batch, text)):
                ids, row, language = word_ids(data, offs)
                parts.append(_sigmoid(m.steep * (margins(m, ids, row, len(offs) - 1) - m.cut[language])))
            found = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.astype(np.float64))], [*kept, "score"])

    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields), "score double"])
    return docs.select(*kept).mapInArrow(run, schema)
