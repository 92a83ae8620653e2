"""Hierarchical Pitman-Yor bigram model over whole previous words, counted, sampled and scored with Spark.

A restaurant is the word before (or the start of a text); all of them share the root, over a uniform base of the training
words and one unknown word. Neither words nor contexts are bounded, so nothing of their number is broadcast: words are
dealt to buckets by hash, and a bucket holds the counts of its words in all their contexts. What a context has in all
(customers, tables) is added up in the bucket of the context: every bucket sends its part there, and gets the sums back in
the order in which it sent them. Both travel as packed arrays, a row for each two buckets.

Seating is sampled by blocked Gibbs (``seating``), 4 sweeps, probabilities averaged over the last 3: all dishes of a sweep use the totals of the sweep before, and
draws are hashes, so that a task that runs again samples the same. Tables of dishes with several customers are kept with the totals.

Probabilities are kept in the order of the bucket's pairs, without the pairs, which the bucket has. Texts are scored in
``SCORE_PARTS`` parts, one after the other, so that what all of them need of the buckets never lies on disk at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, bucket_of, chunks, cut_words, forget, mixed, setting, stored, text_rows
from .seating import END, _stirling, sample_strength, sample_tables

START = np.uint64(0x3C6EF372FE94F82B)
ODD = np.uint64(0x9E3779B97F4A7C15)
#: About so many bytes of text make one bucket of words.
BUCKET_BYTES = 1 << 22
#: Pairs whose scores are broadcast, a fixed number: the most frequent ones. All others are joined.
HOT_PAIRS = 1 << 20
#: Rows go to Python in batches of so many bytes: packed rows are large, and a JVM holds its batches outside its heap.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
#: Parts of the texts that are scored one after the other.
SCORE_PARTS = 2
#: Tokens that are counted or scored at once.
BLOCK = 1_000_000
GRID = np.logspace(-2, 6, 161)  # strengths of contexts
LEVELS = 8 * 64


def word_pairs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, hash of the word before, and row of each token of a chunk; each row closes with an end token."""
    w = cut_words(LOWER[data], offs)
    n = len(offs) - 1
    count = np.bincount(w.row, minlength=n) + 1
    word = np.full(len(w.row) + n, END, np.uint64)
    close = np.cumsum(count) - 1
    inner = np.ones(len(word), bool)
    inner[close] = False
    word[inner] = w.hash
    before = np.r_[START, word[:-1]][: len(word)]
    before[close[:-1] + 1] = START
    return word, before, np.repeat(np.arange(n), count)


def pair_key(word: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mixed(word + before * ODD)


def bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of hashes: what is sorted by hash is sorted by bucket."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def planes(x: np.ndarray) -> bytes:
    """Bytes of an array; of signed integers all first bytes, then all second ones, and so on: high ones are mostly 0 and compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes() if x.dtype.kind == "i" else x.tobytes()


def packed(x: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of consecutive pieces of an array."""
    x = np.ascontiguousarray(x)
    return pa.array([planes(x[lo:hi]) for lo, hi in zip(np.r_[0, ends], ends, strict=False)], pa.binary())


def blob(x: np.ndarray) -> pa.Array:
    """A whole array in one row."""
    return packed(x, np.array([len(x)]))


def unpacked(column: pa.Array, kind: type) -> np.ndarray:
    kind = np.dtype(kind)
    pieces = [np.frombuffer(x, np.uint8) for x in column.to_pylist() if x]
    if kind.kind == "i":
        pieces = [x.reshape(kind.itemsize, -1).T.ravel() for x in pieces]
    return np.concatenate(pieces).view(kind) if pieces else np.zeros(0, kind)


def lengths(column: pa.Array, kind: type) -> np.ndarray:
    return np.array([len(x or b"") for x in column.to_pylist()], np.int64) // np.dtype(kind).itemsize


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where rows of sorted keys begin to differ from the row before."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows of each value of the first column, by which they come sorted."""
    held, now = [], None
    for batch in batches:
        key = batch.column(0).to_numpy()
        at = runs(key)
        for lo, hi in zip(at, np.r_[at[1:], len(key)], strict=True):
            if held and key[lo] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = int(key[lo])
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield now, pa.Table.from_batches(held)


def counted(rows: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket: its words, its contexts, how many words each has, and for each pair the word's place and the count.

    Counts are those of training rows. Pairs of rows that are held out are in the table too, with a count of 0 if no training row has them.
    """

    def summed(word: np.ndarray, before: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((before, word))
        word, before = word[order], before[order]
        at = runs(word, before)
        n = np.add.reduceat(n[order], at) if len(at) else n
        word, before = word[at], before[at]
        first = runs(word)
        return word[first], np.diff(np.r_[first, len(word)]).astype(np.int32), before, n

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []

        def block() -> pa.RecordBatch:
            word, width, before, n = summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            b = bucket(word, buckets)
            at = runs(b)
            ends = np.r_[at[1:], len(b)]
            far = np.cumsum(width)[ends - 1]
            return pa.RecordBatch.from_arrays([pa.array(b[at].astype(np.int32)), packed(word, ends), packed(width, ends), packed(before, far), packed(n.astype(np.int64), far)], ["bucket", "word", "width", "before", "n"])

        for batch in batches:
            train = ~batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, _, data, offs in chunks(text_rows(batch, "text")):
                word, before, row = word_pairs(data, offs)
                parts.append((word, before, train[lo + row].astype(np.int64)))
                if sum(len(p[0]) for p in parts) >= BLOCK:
                    yield block()
                    parts.clear()
        if parts:
            yield block()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, t in grouped(batches):
            width = unpacked(t["width"], np.int32)
            word, width, before, n = summed(np.repeat(unpacked(t["word"], np.uint64), width), unpacked(t["before"], np.uint64), unpacked(t["n"], np.int64))
            order = np.argsort(before, kind="stable")
            before, of = before[order], np.repeat(np.arange(len(word), dtype=np.int32), width)[order]
            at = runs(before)
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *map(blob, (word, np.diff(np.r_[at, len(before)]).astype(np.int32), before[at], of, n[order]))], ["bucket", "word", "width", "before", "of", "n"])

    schema = "bucket int, word binary, width binary, before binary, n binary"
    blocks = rows.select("text", "held").mapInArrow(local, schema)
    return blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merge, schema.replace("n binary", "of binary, n binary"))


class Totals(NamedTuple):
    """The root after a sweep, and the strengths sampled from it."""

    customers: float
    tables: float
    strength: tuple[float, float]  # root, contexts


class Model(NamedTuple):
    words: int
    tokens: int
    discount: tuple[float, float]  # root, contexts
    history: list[Totals]


class Bucket(NamedTuple):
    """The dishes of a bucket by context, with what was sent of past sweeps."""

    word: np.ndarray
    asked: np.ndarray  # distinct contexts, sorted
    first: np.ndarray  # first pair of each
    at: np.ndarray  # context index of each pair
    of: np.ndarray  # word index of each pair
    n: np.ndarray
    customers: np.ndarray  # of asked contexts
    tables: dict[int, np.ndarray]  # of asked contexts, by sweep
    seats: dict[int, np.ndarray]  # tables of pairs with several customers, by sweep


def unpack_bucket(t: pa.Table) -> Bucket:
    kind, home = t["sweep"].to_numpy(), t["home"].to_numpy()
    own = t.slice(int(np.flatnonzero(kind == -1)[0]), 1)
    word, width, before, of, n = (unpacked(own[c], k) for c, k in (("word", np.uint64), ("width", np.int32), ("before", np.uint64), ("of", np.int32), ("n", np.int64)))
    tables, seats, customers = {}, {}, np.zeros(0, np.int64)
    for s in sorted(set(kind[kind >= 0].tolist())):
        i = np.flatnonzero((kind == s) & (home >= 0))
        sent = t.take(pa.array(i[np.argsort(home[i])]))
        tables[s] = unpacked(sent["tables"], np.int64)
        seats[s] = unpacked(t.filter(pa.array((kind == s) & (home < 0)))["tables"], np.int32).astype(np.int64)
        customers = unpacked(sent["customers"], np.int64)
    return Bucket(word, before, (np.cumsum(width) - width).astype(np.int64), np.repeat(np.arange(len(before), dtype=np.int32), width), of, n, customers, tables, seats)


def root_chance(m: Model, t: Totals, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
    d, s = m.discount[0], t.strength[0]
    return (customers - d * tables + (s + d * t.tables) / (m.words + 1)) / (s + t.customers)


def several_tables(d: Bucket, m: Model, now: int, stirling: list[np.ndarray]) -> np.ndarray:
    """Tables of pairs with several customers in a sweep, drawn given the sweep before."""
    h = m.history[now - 1]
    _, customers, tables = seating(d, m, now - 1, stirling)
    several = np.flatnonzero(d.n > 1)
    of, at = d.of[several], d.at[several]
    mass = (h.strength[1] + m.discount[1] * d.tables[now - 1][at]) * root_chance(m, h, customers, tables)[of]
    return sample_tables(d.n[several], mass, m.discount[1], stirling[1], pair_key(d.word[of], d.asked[at]), 2 * now)


def seating(d: Bucket, m: Model | None, now: int, stirling: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of pairs, and customers and tables of words at the root, after a sweep; at first one table a dish."""
    t = np.minimum(d.n, 1)
    if now:
        t[d.n > 1] = d.seats[now]
    customers = np.bincount(d.of, t, len(d.word)).astype(np.int64)
    if not now:
        return t, customers, np.minimum(customers, 1)
    h = m.history[now - 1]
    mass = np.full(len(customers), (h.strength[0] + m.discount[0] * h.tables) / (m.words + 1))
    return t, customers, sample_tables(customers, mass, m.discount[0], stirling[0], d.word, 2 * now + 1)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series, eight steps up."""
    y = x + 8
    down = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) - down


def strength_likelihood(customers: np.ndarray, tables: np.ndarray, discount: float) -> np.ndarray:
    """Log likelihood of restaurants' seatings at each strength of ``GRID``, but for what does not depend on it."""
    out = np.zeros(len(GRID))
    on = customers > 1
    if on.any():
        ct, times = np.unique(np.c_[customers[on], tables[on]], axis=0, return_counts=True)
        for part in np.array_split(np.arange(len(ct)), len(ct) // 20_000 + 1):
            c, t = ct[part, :1].astype(float), ct[part, 1:].astype(float)
            made = log_gamma(GRID / discount + t) - log_gamma(GRID / discount + 1) - log_gamma(GRID + c) + log_gamma(GRID + 1)
            out += times[part] @ made
    return out


def with_replies(state: DataFrame, replies: dict[int, DataFrame]) -> DataFrame:
    """Buckets with what contexts have in all, and what was seated, after some sweeps: a group of rows each."""
    names = ("word", "width", "before", "of", "n")
    nothing = lambda *names: [F.lit(None).cast("binary").alias(c) for c in names]
    both = state.select("bucket", F.lit(-1).alias("sweep"), F.lit(-1).alias("home"), *names, *nothing("customers", "tables"))
    for s, r in replies.items():
        both = both.unionByName(r.where("bucket >= 0").select("bucket", F.lit(s).alias("sweep"), "home", *nothing(*names), "customers", "tables"))
    return both.repartition("bucket").sortWithinPartitions("bucket")


def fit(state: DataFrame, buckets: int, sweeps: int = 4, burn_in: int = 1) -> tuple[Model, list[DataFrame], np.ndarray]:
    """The model, the totals of contexts after each sweep by bucket, and a histogram of the pairs' counts (eighths of log2)."""
    model: Model | None = None
    replies: list[DataFrame] = []
    histogram = np.zeros(LEVELS)
    for now in range(sweeps + 1):
        stirling = [_stirling(v) for v in model.discount] if model else []

        def asks(batches: Iterator[pa.RecordBatch], now: int = now, model: Model | None = model, stirling: list = stirling) -> Iterator[pa.RecordBatch]:
            for b, rows in grouped(batches):
                d = unpack_bucket(rows)
                if now:
                    d.seats[now] = several_tables(d, model, now, stirling)
                t, customers, tables = seating(d, model, now, stirling)
                total, width = np.bincount(d.of, d.n, len(d.word)), np.bincount(d.of[d.n > 0], minlength=len(d.word))
                sums = [customers.sum(), tables.sum(), (total > 0).sum(), total.sum(), (d.n == 1).sum(), (d.n == 2).sum(), (width == 1).sum(), (width == 2).sum()]
                levels = np.bincount((np.log2(d.n[d.n > 0]) * 8).astype(np.int64), minlength=LEVELS)
                to = bucket(d.asked, buckets)
                at = runs(to)
                ends = np.r_[at[1:], len(to)]
                whole = [np.add.reduceat(x, d.first) for x in (d.n, t)]
                m = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(to[at].astype(np.int32)), pa.array(np.full(m, b, np.int32)), packed(d.asked, ends), packed(whole[0], ends), packed(whole[1], ends)], names)
                seats = d.seats[now].astype(np.int32) if now else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([-1 - b], pa.int32()), pa.array([b], pa.int32()), blob(np.r_[sums, levels].astype(np.float64)), pa.nulls(1, pa.binary()), blob(seats)], names)

        def adds(batches: Iterator[pa.RecordBatch], now: int = now, model: Model | None = model) -> Iterator[pa.RecordBatch]:
            for q, rows in grouped(batches):
                if q < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([-1, -1 - q], pa.int32()), pa.array([0, -1], pa.int32()), pa.nulls(2, pa.binary()), pa.concat_arrays([rows[x].combine_chunks() for x in ("before", "tables")])], out)
                    continue
                _, at = np.unique(unpacked(rows["before"], np.uint64), return_inverse=True)
                c, t = (np.bincount(at, unpacked(rows[x], np.int64)).astype(np.int64) for x in ("customers", "tables"))
                ends = np.cumsum(lengths(rows["before"], np.uint64))
                yield pa.RecordBatch.from_arrays([rows["bucket"].combine_chunks(), pa.array(np.full(len(ends), q, np.int32)), packed(c[at], ends) if now == sweeps else pa.nulls(len(ends), pa.binary()), packed(t[at], ends)], out)
                if model:
                    yield pa.RecordBatch.from_arrays([pa.array([-2], pa.int32()), pa.array([q], pa.int32()), pa.nulls(1, pa.binary()), blob(strength_likelihood(c, t, model.discount[1]))], out)

        names, out = ["home", "bucket", "before", "customers", "tables"], ["bucket", "home", "customers", "tables"]
        sent = with_replies(state, {now - 1: replies[-1]} if now else {}).mapInArrow(asks, "home int, bucket int, before binary, customers binary, tables binary")
        replies.append(stored(sent.repartition("home").sortWithinPartitions("home").mapInArrow(adds, "bucket int, home int, customers binary, tables binary")))
        if 0 < now <= burn_in + 1:
            forget(replies[now - 1])
        found = sorted(replies[-1].where("bucket < 0").select("bucket", "home", "tables").collect(), key=lambda r: (r[0], r[1], bytes(r[2])))
        sums = np.sum([np.frombuffer(r[2]) for r in found if r[0] == -1] or [np.zeros(8 + LEVELS)], 0)
        likely = np.sum([np.frombuffer(r[2]) for r in found if r[0] == -2] or [np.zeros(len(GRID))], 0)
        if model is None:
            discount = lambda one, two: float(np.clip(one / max(one + 2 * two, 1), 0.3, 0.95))
            model = Model(int(sums[2]), int(sums[3]), (discount(sums[6], sums[7]), discount(sums[4], sums[5])), [])
            strength, histogram = (10.0, 10.0), sums[8:]
        else:
            root = sample_strength(sums[:1], sums[1:2], model.discount[0], model.history[-1].strength[0], 10 * now)
            logit = likely + np.log(GRID) - 1e-4 * GRID  # the prior's mean is 10,000, as in ``sample_strength``
            p = np.exp(logit - logit.max()).cumsum()
            strength = (root, float(GRID[np.searchsorted(p, np.random.default_rng(10 * now + 1).random() * p[-1])]))
        model.history.append(Totals(float(sums[0]), float(sums[1]), strength))
    return model, replies, histogram


def pair_chances(d: Bucket, m: Model, stirling: list[np.ndarray]) -> np.ndarray:
    """Probability of each pair of a bucket, its word after its context, averaged over the sweeps that were sent."""
    total, c, d1 = np.zeros(len(d.n)), d.customers[d.at], m.discount[1]
    sent = [s for s in d.tables if s]
    for i in sent:
        h = m.history[i]
        t, customers, tables = seating(d, m, i, stirling)
        p = root_chance(m, h, customers, tables)
        s = h.strength[1]
        total += (d.n - d1 * t + (s + d1 * d.tables[i][d.at]) * p[d.of]) / (s + c)
    return total / len(sent)


def score_texts(df: DataFrame, held_out: int = 2, folds: int = 7, sweeps: int = 4, burn_in: int = 1, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Per row: its id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity.

    The model learns from rows whose crc32 of the id, modulo ``folds``, is not ``held_out``. Scores are log10
    probabilities of the whole text and its end; base_score is that of add-one word frequencies. Null and
    empty texts are just their end. Without training rows every probability is that of the uniform base. Ids
    may be null or repeat. Other columns are left out.

    Frequent pairs (``HOT_PAIRS``) are scored where the text is read, all others in the bucket of their word; what
    buckets find is added up by blocks of texts. A hash of id and text says in which part a row is scored.
    """
    with setting(df.sparkSession, *BATCH):
        return _score_texts(df, held_out, folds, sweeps, burn_in, text, row_id)


def _score_texts(df: DataFrame, held_out: int, folds: int, sweeps: int, burn_in: int, text: str, row_id: str) -> DataFrame:
    spark = df.sparkSession
    rows = df.select(F.col(row_id).alias("id"), F.col(text).alias("text"), (bucket_of(row_id, folds) == held_out).alias("held"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = size // BUCKET_BYTES + 1
    state = stored(counted(rows, buckets))
    model, replies, histogram = fit(state, buckets, sweeps, burn_in)
    stirling = [_stirling(v) for v in model.discount]
    above = np.cumsum(histogram[::-1])[::-1]
    least = int(np.argmax(np.r_[above, 0] <= HOT_PAIRS))

    def chances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, t in grouped(batches):
            d = unpack_bucket(t)
            score = np.log10(pair_chances(d, model, stirling)).astype(np.float32)
            known = np.bincount(d.of, d.n, len(d.word)).astype(np.int64)
            hot = np.flatnonzero((np.log2(np.maximum(d.n, 1)) * 8).astype(np.int64) >= least)
            hot = hot[d.n[hot] > 0]
            columns = (known, score, pair_key(d.word[d.of[hot]], d.asked[d.at[hot]]), score[hot], known[d.of[hot]])
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *map(blob, columns)], ["bucket", "known", "score", "hot_key", "hot_score", "hot_known"])

    table = stored(with_replies(state, {s: r for s, r in enumerate(replies) if s > burn_in}).mapInArrow(chances, "bucket int, known binary, score binary, hot_key binary, hot_score binary, hot_known binary"))
    forget(*replies[burn_in + 1 :])
    hot = table.select("hot_key", "hot_score", "hot_known").toArrow()
    hot_key, hot_score, hot_known = (unpacked(hot.column(i), k) for i, k in enumerate((np.uint64, np.float32, np.int64)))
    order = np.argsort(hot_key)
    shared = spark.sparkContext.broadcast((hot_key[order], hot_score[order], hot_known[order]))
    base = np.log10(1.0 / (model.tokens + model.words + 1))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["bucket", "block", "ids", "held", "rows", "n", "known", "base", "score", "key"]
    schema = f"bucket int, block bigint, ids array<{kind}>, held array<boolean>, rows binary, n binary, known binary, base binary, score binary, key binary"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h_key, h_score, h_known = shared.value
        block = TaskContext.get().partitionId() << 32
        parts: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            starts = np.cumsum([0] + [len(p[3]) for p in parts])
            word, before = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            row = np.concatenate([p[2] + s for p, s in zip(parts, starts, strict=False)])
            ids, held = pa.concat_arrays([p[3] for p in parts]), pa.concat_arrays([p[4] for p in parts])
            n, key = len(ids), pair_key(word, before)
            at = np.minimum(np.searchsorted(h_key, key), max(len(h_key) - 1, 0))
            is_hot = h_key[at] == key if len(h_key) else np.zeros(len(key), bool)
            r, a = row[is_hot], at[is_hot]
            own = [np.bincount(row, minlength=n).astype(np.int64), np.bincount(r, h_known[a] > 0, n).astype(np.int64), np.bincount(r, np.log10(h_known[a] + 1.0), n), np.bincount(r, h_score[a], n)]
            whole = lambda x: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), x)
            yield pa.RecordBatch.from_arrays([pa.array([block % buckets], pa.int32()), pa.array([block]), whole(ids), whole(held), pa.nulls(1, pa.binary()), *map(blob, own), pa.nulls(1, pa.binary())], names)
            rest = np.flatnonzero(~is_hot)
            b = bucket(word[rest], buckets)
            o = np.argsort(b.astype(np.uint16) if buckets < 1 << 16 else b, kind="stable")
            b, rest = b[o], rest[o]
            first = runs(b)
            ends = np.r_[first[1:], len(b)]
            m = len(first)
            if m:
                empty = pa.nulls(m, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(b[first].astype(np.int32)), pa.array(np.full(m, block)), pa.nulls(m, pa.list_(ids.type)), pa.nulls(m, pa.list_(pa.bool_())), packed(row[rest].astype(np.int32), ends), empty, empty, empty, empty, packed(key[rest], ends)], names)

        for batch in batches:
            for lo, hi, data, offs in chunks(text_rows(batch, "text")):
                parts.append((*word_pairs(data, offs), batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo)))
                if sum(len(p[0]) for p in parts) >= BLOCK:
                    yield from flush()
                    parts.clear()
                    block += 1
        if parts:
            yield from flush()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def summed(block: np.ndarray, row: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
            order = np.lexsort((row, block))
            block, row = block[order], row[order]
            at = runs(block, row)
            return block[at], row[at], *(np.add.reduceat(x[order], at) for x in columns)

        def flush() -> pa.RecordBatch:
            block, row, *sums = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            first = runs(block)
            ends, m = np.r_[first[1:], len(block)], len(first)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(block[first]), pa.nulls(m, kinds[0]), pa.nulls(m, kinds[1]), packed(row, ends), pa.nulls(m, pa.binary()), *(packed(x, ends) for x in sums)], names[1:9])

        for _, t in grouped(batches):
            kinds = [t.schema.field(c).type for c in ("ids", "held")]
            own, use = t["ids"].is_valid().to_numpy(), np.flatnonzero(t["key"].is_valid().to_numpy())
            for row in np.flatnonzero(own):
                yield from t.slice(int(row), 1).select(names[1:9]).combine_chunks().to_batches()
            if not len(use):
                continue
            # the bucket's rows: one with its pairs, one with their scores in the same order
            word, width, before, of, known, score = (unpacked(t[c], k) for c, k in (("word", np.uint64), ("width", np.int32), ("before", np.uint64), ("of", np.int32), ("known_words", np.int64), ("pair_score", np.float32)))
            key, known = pair_key(word[of], np.repeat(before, width)), known[of]
            order = np.argsort(key)
            asked = t.take(pa.array(use))
            at = order[np.searchsorted(key[order], unpacked(asked["key"], np.uint64))]
            block = np.repeat(asked["block"].to_numpy(), lengths(asked["rows"], np.int32))
            held.append(summed(block, unpacked(asked["rows"], np.int32), (known[at] > 0).astype(np.int64), np.log10(known[at] + 1.0), score[at].astype(np.float64)))
            if sum(len(h[0]) for h in held) > BLOCK:
                yield flush()
        if held:
            yield flush()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in grouped(batches):
            own = t["ids"].is_valid().to_numpy()
            mine, rest = t.filter(pa.array(own)), t.filter(pa.array(~own))
            n, row = unpacked(mine["n"], np.int64), unpacked(rest["rows"], np.int32)
            known, plain, score = (unpacked(mine[c], k) + np.bincount(row, unpacked(rest[c], k), len(n)) for c, k in (("known", np.int64), ("base", np.float64), ("score", np.float64)))
            yield pa.RecordBatch.from_arrays([mine["ids"].combine_chunks().flatten(), mine["held"].combine_chunks().flatten(), pa.array(n), pa.array(known.astype(np.int64)), pa.array(plain + n * base), pa.array(score)], ["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    pairs = state.select("bucket", "word", "width", "before", "of")
    scores = table.select("bucket", F.col("known").alias("known_words"), F.col("score").alias("pair_score"))
    parts = []
    for part in range(SCORE_PARTS):
        needed = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(SCORE_PARTS)) == part).mapInArrow(local, schema)
        met = needed.unionByName(pairs.unionByName(scores, True), True).repartition("bucket").sortWithinPartitions("bucket")
        sums = met.mapInArrow(joined, schema[len("bucket int, ") : -len(", key binary")])
        parts.append(stored(sums.repartition("block").sortWithinPartitions("block").mapInArrow(added, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")))
    forget(state, table)
    out = reduce(DataFrame.unionByName, parts)
    return out.select(F.col("id").alias(row_id), "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
