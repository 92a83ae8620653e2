"""Hierarchical Pitman-Yor language models, counted and sampled with Spark.

``score_texts`` (of ``word_contexts``) is the model of whole previous words. What is below it is a smaller one whose
number of restaurants is fixed, so that all their totals fit the driver; no registered query uses it. It has three levels:
one restaurant for each context, whose parent is shared by the contexts of its family, whose parent in turn is the root, over
a uniform base of all training words and one unknown word. The context of a word is the ending of the word before it
(512 endings in 32 families by last byte).

Seating is sampled by blocked Gibbs, a dish of a restaurant at a time: the number of tables given the
customers, the mass of a new table, and all other seating. All dishes of a sweep use the totals of the
sweep before, so words are independent within a sweep and any task can sample any of them. Draws are hashes
of word, restaurant and sweep: a lost task samples the same seating again. After each sweep the strengths of the
three levels are sampled from the totals of their restaurants.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, chunks, cut_words, mixed, text_rows
from .seating import END, _stirling, sample_strength, sample_tables, tables_beyond_one  # noqa: F401
from .word_contexts import score_texts  # noqa: F401

CONTEXTS = 512
FAMILIES = 32
SHIFT = 4  # context >> SHIFT is its family


class Totals(NamedTuple):
    """Tables and customers of all restaurants after a sweep."""

    leaf: np.ndarray  # tables by context
    mid_customers: np.ndarray
    mid: np.ndarray
    root_customers: float
    root: float
    strength: tuple[float, float, float] = (10.0, 10.0, 10.0)  # root, family, context


class Setting(NamedTuple):
    """Sizes that do not change with the seating: customers of contexts, discounts."""

    customers: np.ndarray
    discount: tuple[float, float, float]  # root, family, context
    words: int
    tokens: int


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hash, context and row of each token of a chunk; each row closes with an end token."""
    low = LOWER[data]
    w = cut_words(low, offs)
    n = len(offs) - 1
    b = low[w.end - 1].astype(np.int64)
    size = w.end - w.start
    two = np.where(size > 1, low[np.maximum(w.end - 2, 0)], 0).astype(np.int64)
    three = np.where(size > 2, low[np.maximum(w.end - 3, 0)], 0).astype(np.int64)
    own = 1 + (b * 7 + (b >> 5)) % (FAMILIES - 1)
    ending = (own << SHIFT) | ((two * 31 + three * 17 + np.minimum(size, 4)) % (1 << SHIFT))
    count = np.bincount(w.row, minlength=n)
    total = len(w.row) + n
    close = np.cumsum(count + 1) - 1
    is_end = np.zeros(total, bool)
    is_end[close] = True
    word = np.empty(total, np.uint64)
    word[is_end], word[~is_end] = END, w.hash
    row = np.repeat(np.arange(n), count + 1)
    after = np.zeros(total, np.int64)
    after[~is_end] = ending
    context = np.zeros(total, np.int64)
    context[1:] = after[:-1]
    context[np.r_[0, close[:-1] + 1] if n else []] = 0
    return word, context, row


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Larger batches: the fixed cost of a batch is that of some ten thousand dishes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


class Dishes(NamedTuple):
    """The words of a batch with the contexts they were seen in, sorted by word and context."""

    word: np.ndarray
    of: np.ndarray  # word index of each pair
    context: np.ndarray
    count: np.ndarray
    mid_of: np.ndarray  # (word, family) index of each pair
    mid_word: np.ndarray
    family: np.ndarray


def dishes(batch: pa.RecordBatch) -> Dishes:
    word = batch.column(0).to_numpy().view(np.uint64)
    contexts, counts = batch.column(1), batch.column(2)
    of = np.repeat(np.arange(len(word)), contexts.value_lengths().to_numpy())
    context = contexts.flatten().to_numpy().astype(np.int64)
    count = counts.flatten().to_numpy().astype(np.int64)
    mid = (of * FAMILIES) + (context >> SHIFT)
    first = np.r_[True, mid[1:] != mid[:-1]] if len(mid) else np.zeros(0, bool)
    at = mid[first]
    return Dishes(word, of, context, count, np.cumsum(first) - 1, at // FAMILIES, at % FAMILIES)


class Predictive(NamedTuple):
    root: np.ndarray
    mid: np.ndarray
    leaf: np.ndarray


def backoff(setting: Setting, t: Totals) -> tuple[float, np.ndarray, np.ndarray]:
    """Mass that root, families and contexts leave to what is above them."""
    (d0, d1, d2), (s0, s1, s2) = setting.discount, t.strength
    return (s0 + d0 * t.root) / (s0 + t.root_customers), (s1 + d1 * t.mid) / (s1 + t.mid_customers), (s2 + d2 * t.leaf) / (s2 + setting.customers)


def seat(d: Dishes, setting: Setting, history: list[Totals], stirling: list[np.ndarray], burn_in: int) -> tuple[list[np.ndarray], list[Predictive]]:
    """Sweeps over the words of a batch, one for each entry of ``history`` but the last sampled from it.

    Returns the last tables (context, family, root) and the predictive probabilities of each sweep whose own
    totals are known and that comes after the burn-in.
    """
    d0, d1, d2 = setting.discount
    n = len(d.word)
    leaf = np.ones(len(d.of), np.int64)
    mid_customers = np.bincount(d.mid_of, leaf, len(d.mid_word)).astype(np.int64)
    mid = np.ones(len(d.mid_word), np.int64)
    root_customers = np.bincount(d.mid_word, mid, n).astype(np.int64)
    root = np.ones(n, np.int64)
    leaf_key = mixed(d.word[d.of] + d.context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    mid_key = mixed(d.word[d.mid_word] + (d.family + 10_000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    found = []

    def predict(t: Totals) -> Predictive:
        s0, s1, s2 = t.strength
        b0, b1, b2 = backoff(setting, t)
        p0 = (root_customers - d0 * root) / (s0 + t.root_customers) + b0 / (setting.words + 1)
        p1 = (mid_customers - d1 * mid) / (s1 + t.mid_customers[d.family]) + b1[d.family] * p0[d.mid_word]
        p2 = (d.count - d2 * leaf) / (s2 + setting.customers[d.context]) + b2[d.context] * p1[d.mid_of]
        return Predictive(p0, p1, p2)

    for sweep, t in enumerate(history):
        s0, s1, s2 = t.strength
        p = predict(t)
        if sweep > burn_in:
            found.append(p)
        leaf = sample_tables(d.count, (s2 + d2 * t.leaf[d.context]) * p.mid[d.mid_of], d2, stirling[2], leaf_key, 3 * sweep)
        mid_customers = np.bincount(d.mid_of, leaf, len(d.mid_word)).astype(np.int64)
        mid = sample_tables(mid_customers, (s1 + d1 * t.mid[d.family]) * p.root[d.mid_word], d1, stirling[1], mid_key, 3 * sweep + 1)
        root_customers = np.bincount(d.mid_word, mid, n).astype(np.int64)
        root = sample_tables(root_customers, np.full(n, (s0 + d0 * t.root) / (setting.words + 1)), d0, stirling[0], d.word, 3 * sweep + 2)
    return [leaf, mid_customers, mid, root_customers, root], found


def count_contexts(docs: DataFrame) -> DataFrame:
    """One row per word of a table with a ``text``: word hash, its contexts in order, and their counts."""

    def pairs(word: np.ndarray, context: np.ndarray, times: np.ndarray | None) -> pa.RecordBatch:
        order = np.lexsort((context, word))
        word, context = word[order], context[order]
        new = np.r_[True, (word[1:] != word[:-1]) | (context[1:] != context[:-1])] if len(word) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        n = np.add.reduceat(times[order], at) if times is not None and len(at) else np.diff(np.r_[at, len(word)])
        word, context = word[at], context[at]
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
        ends = pa.array(np.r_[first, len(word)].astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(word[first].view(np.int64)), pa.ListArray.from_arrays(ends, pa.array(context.astype(np.int16))), pa.ListArray.from_arrays(ends, pa.array(n.astype(np.int64)))], ["word", "contexts", "counts"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, held = [], 0
            for _, _, data, offs in chunks(text_rows(batch, "text")):
                parts.append(tokens(data, offs)[:2])
                held += len(parts[-1][0])
                if held > 3_000_000:
                    yield pairs(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), None)
                    parts, held = [], 0
            if parts:
                yield pairs(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), None)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, context, count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            d_word = batch.column(0).to_numpy().view(np.uint64)
            word = np.r_[word, np.repeat(d_word, batch.column(1).value_lengths().to_numpy())]
            context = np.r_[context, batch.column(1).flatten().to_numpy().astype(np.int64)]
            count = np.r_[count, batch.column(2).flatten().to_numpy().astype(np.int64)]
            if not len(word):
                continue
            done = word != word[-1]  # rows come sorted: the last word may go on in the next batch
            if done.any():
                yield pairs(word[done], context[done], count[done])
            kept = pairs(word[~done], context[~done], count[~done])
            d = dishes(kept)
            word, context, count = d.word[d.of], d.context, d.count
        if len(word):
            yield pairs(word, context, count)

    schema = "word bigint, contexts array<smallint>, counts array<bigint>"
    rows = docs.select("text").mapInArrow(local, schema)
    return rows.repartition("word").sortWithinPartitions("word").mapInArrow(merge, schema)


class Model(NamedTuple):
    setting: Setting
    history: list[Totals]
    burn_in: int


def fit(table: DataFrame, sweeps: int = 4, burn_in: int = 1) -> Model:
    """Gibbs sweeps over a table of ``count_contexts``. Only totals of restaurants come to the driver."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = dishes(batch)
            mids = np.bincount(d.mid_of, minlength=len(d.mid_word))
            total = np.bincount(d.of, d.count, len(d.word))
            width = np.bincount(d.mid_word, minlength=len(d.word))
            out = [np.bincount(d.context, d.count, CONTEXTS), np.bincount(d.context, minlength=CONTEXTS), np.bincount(d.family, mids, FAMILIES), np.bincount(d.family, minlength=FAMILIES), [len(d.word), total.sum(), len(d.mid_word)], [(total == 1).sum(), (total == 2).sum(), (mids == 1).sum(), (mids == 2).sum(), (d.count == 1).sum(), (d.count == 2).sum(), (width == 1).sum()]]
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(out).astype(np.float64)], pa.list_(pa.float64()))], ["sums"])

    def added(run) -> np.ndarray:
        rows = table.mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(max((r.k for r in rows), default=2 * CONTEXTS + 2 * FAMILIES + 9) + 1)
        for r in rows:
            out[r.k] = r.v
        return out

    x = added(sizes)
    customers, leaf, mid_customers, mid, (words, total, pairs), seen = np.split(x, np.cumsum([CONTEXTS, CONTEXTS, FAMILIES, FAMILIES, 3]))

    def discount(one: float, two: float) -> float:
        return float(np.clip(one / max(one + 2 * two, 1), 0.3, 0.95))

    setting = Setting(customers, (discount(seen[0], seen[1]), discount(seen[2], seen[3]), discount(seen[4], seen[5])), int(words), int(total))
    stirling = [_stirling(v) for v in setting.discount]
    history = [Totals(leaf, mid_customers, mid, float(pairs), float(words))]
    for _ in range(sweeps):

        def sweep(batches: Iterator[pa.RecordBatch], history: list[Totals] = list(history)) -> Iterator[pa.RecordBatch]:
            for batch in gathered(batches, 40_000):
                d = dishes(batch)
                (leaf, mid_customers, mid, root_customers, root), _ = seat(d, setting, history, stirling, burn_in)
                out = [np.bincount(d.context, leaf, CONTEXTS), np.bincount(d.family, mid_customers, FAMILIES), np.bincount(d.family, mid, FAMILIES), [root_customers.sum(), root.sum()]]
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(out).astype(np.float64)], pa.list_(pa.float64()))], ["sums"])

        x = added(sweep)
        leaf, mid_customers, mid, rest = np.split(x[: CONTEXTS + 2 * FAMILIES + 2] if len(x) >= CONTEXTS + 2 * FAMILIES + 2 else np.zeros(CONTEXTS + 2 * FAMILIES + 2), np.cumsum([CONTEXTS, FAMILIES, FAMILIES]))
        before, now = history[-1].strength, len(history)
        levels = ((np.array([rest[0]]), np.array([rest[1]])), (mid_customers, mid), (customers, leaf))
        strength = tuple(sample_strength(c, t, d, s, 10 * now + k) for k, ((c, t), d, s) in enumerate(zip(levels, setting.discount, before, strict=True)))
        history.append(Totals(leaf, mid_customers, mid, float(rest[0]), float(rest[1]), strength))
    return Model(setting, history, burn_in)


class Known(NamedTuple):
    """Averaged predictive probabilities of words: of seen (word, context) pairs, and what contexts back off to."""

    word: np.ndarray
    total: np.ndarray
    pair: np.ndarray  # word index * CONTEXTS + context, sorted
    chance: np.ndarray
    mid: np.ndarray  # samples x words x families


def known(batch: pa.RecordBatch, model: Model, stirling: list[np.ndarray]) -> Known:
    d = dishes(batch)
    _, samples = seat(d, model.setting, model.history, stirling, model.burn_in)
    mid = np.empty((len(samples), len(d.word), FAMILIES), np.float32)
    for k, (p, t) in enumerate(zip(samples, model.history[model.burn_in + 1 :], strict=True)):
        _, b1, _ = backoff(model.setting, t)
        mid[k] = b1 * p.root[:, None]
        mid[k][d.mid_word, d.family] = p.mid
    return Known(d.word, np.bincount(d.of, d.count, len(d.word)), d.of * CONTEXTS + d.context, np.mean([p.leaf for p in samples], 0), mid)


def unseen(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """By sample and context: mass that a context leaves to its family, and the chance of an unknown word."""
    down, none = [], []
    for t in model.history[model.burn_in + 1 :]:
        b0, b1, b2 = backoff(model.setting, t)
        down.append(b2)
        none.append(b2 * b1[np.arange(CONTEXTS) >> SHIFT] * b0 / (model.setting.words + 1))
    return np.array(down), np.mean(none, 0)


def chances(k: Known, at: np.ndarray, context: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Averaged probability of words ``at`` (indices into ``k``) in contexts."""
    p = sum(down[s][context] * k.mid[s][at, context >> SHIFT] for s in range(len(k.mid))) / len(k.mid)
    pair = at * CONTEXTS + context
    hit = np.minimum(np.searchsorted(k.pair, pair), len(k.pair) - 1)
    return np.where(k.pair[hit] == pair, k.chance[hit], p)
