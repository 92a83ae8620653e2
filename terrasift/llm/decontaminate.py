"""Benchmark decontamination by latent semantic retrieval.

Passages are overlapping windows of documents. Their TF-IDF vectors over the words of the benchmark are
projected into a latent space: the leading right singular vectors of passages and items, found by a randomised
SVD. Its sketch is one pass over all passages as a Spark job; a small decomposition on the driver turns the
sketch into singular vectors. What is compared there is bounded by the subsequence that a leak must have: around it, enough of the
item's rarer words must stand. A passage near a benchmark item is held against the item by the longest common
subsequence of words, which paraphrases with inserted, lost or changed words still pass, and by the words of
its answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, chunks, cut_words, others, spare, text_rows

#: Lower-case letters, digits and bytes beyond ASCII make words here, so punctuation cannot hide a copy.
LETTERS = np.zeros(256, bool)
LETTERS[48:58] = LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True

WINDOW = 64
STRIDE = 32
RANK = 160
#: Columns of the SVD: words share them beyond that many, so that what tasks add up has a fixed size.
SLOTS = 1 << 14
#: More draws than singular vectors kept.
EXTRA = 8
#: Characters of the items that one model holds; a longer benchmark is searched block by block.
ITEM_CHARACTERS = 1 << 23
NEAR = 0.3
FILTER_BITS = 20
#: Most frequent columns that the SVD multiplies as a dense matrix; the others stay sparse.
DENSE = 512
#: Occurrences of item words that are looked at together.
EVENTS = 1 << 21


class Items(NamedTuple):
    ids: list
    words: list[np.ndarray]
    vocabulary: np.ndarray
    bitmap: np.ndarray


class Index(NamedTuple):
    """What a leak must hold: of some positions of each item, its rarest words, at least ``need``.

    Entries are sorted by item; those of item i are ``start[i]:start[i + 1]``, a column and its number of positions.
    """

    start: np.ndarray
    column: np.ndarray
    weight: np.ndarray
    need: np.ndarray
    length: np.ndarray


class Latent(NamedTuple):
    idf: np.ndarray
    basis: np.ndarray  # slots x rank, orthonormal columns
    singular: np.ndarray
    items: np.ndarray  # items x rank, unit rows
    index: Index


def item_words(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return cut_words(LOWER[data], np.array([0, len(data)]), solid_bytes=LETTERS).hash


def prepare(rows: list[tuple]) -> Items:
    words = [item_words(text) for _, text in rows]
    keep = [i for i, w in enumerate(words) if len(w)]
    words = [words[i] for i in keep]
    return with_vocabulary([rows[i][0] for i in keep], words, np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64))


def with_vocabulary(ids: list, words: list[np.ndarray], vocabulary: np.ndarray) -> Items:
    bitmap = np.zeros(1 << FILTER_BITS, bool)
    bitmap[(vocabulary & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
    return Items(ids, words, vocabulary, bitmap)


class Passages(NamedTuple):
    """Words of a chunk, the benchmark words among them (place, column), and passages as ranges of those, with their first word."""

    hash: np.ndarray
    row: np.ndarray
    place: np.ndarray
    column: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    start: np.ndarray


def passages(data: np.ndarray, offs: np.ndarray, items: Items) -> Passages:
    w = cut_words(LOWER[data], offs, solid_bytes=LETTERS)
    place = np.flatnonzero(items.bitmap[(w.hash & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)])
    column = np.minimum(np.searchsorted(items.vocabulary, w.hash[place]), len(items.vocabulary) - 1)
    hit = items.vocabulary[column] == w.hash[place]
    place, column = place[hit], column[hit]
    count = np.bincount(w.row, minlength=len(offs) - 1)
    n = np.where(count > 0, np.maximum(-(-(count - WINDOW) // STRIDE), 0) + 1, 0)
    first = np.repeat(np.cumsum(count) - count, n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = first + step * STRIDE
    end = np.minimum(start + WINDOW, np.repeat(np.cumsum(count), n))
    return Passages(w.hash, w.row, place, column, np.searchsorted(place, start), np.searchsorted(place, end), start)


def index_of(items: Items, seen: np.ndarray, least_overlap: float) -> Index:
    """Bounds that a common subsequence of ``least_overlap`` of an item's words implies.

    Such a subsequence leaves out at most ``lost`` positions of the item. Of any ``lost + m`` positions it therefore
    has ``m``; those of the rarest words are taken, as they lead to the fewest passages.
    """
    start, columns, weights, needs = [0], [], [], []
    for w in items.words:
        column = np.searchsorted(items.vocabulary, w)
        lost = len(w) - max(1, int(np.ceil(least_overlap * len(w) - 1e-9)))
        rare = column[np.lexsort((column, seen[column]))][: lost + max(1, len(w) // 4)]
        own, weight = np.unique(rare, return_counts=True)
        columns.append(own)
        weights.append(weight)
        needs.append(max(1, len(rare) - lost))
        start.append(start[-1] + len(own))
    return Index(np.array(start), np.concatenate(columns), np.concatenate(weights), np.array(needs), np.array([len(w) for w in items.words]))


def _ranges(lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the range, and value, of all values of the ranges lo..lo + size."""
    of = np.repeat(np.arange(len(size)), size)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)


def bounded(p: Passages, index: Index, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passages and items, in order of both, where the item's words around the passage reach the item's bound.

    Around a passage is as much room as the item has words, within the row. Repeats count again, so no leak is lost.
    """
    n = np.int64(len(p.hash))
    order = np.argsort(p.column, kind="stable")
    at = np.searchsorted(p.column[order], np.r_[index.column, index.column + 1])
    lo, size = at[: len(index.column)], at[len(index.column) :] - at[: len(index.column)]
    events = np.r_[0, np.cumsum(size)][index.start]
    out = []
    a = 0
    while a < len(index.need):
        b = max(a + 1, int(np.searchsorted(events, events[a] + EVENTS, side="right")) - 1)
        entry = np.arange(index.start[a], index.start[b])
        of, k = _ranges(lo[entry], size[entry])
        item = np.repeat(np.arange(a, b), np.diff(index.start[a : b + 1]))[of]
        key = item * n + p.place[order[k]]
        by = np.argsort(key, kind="stable")
        key, item, total = key[by], item[by], np.r_[0, np.cumsum(index.weight[entry][of][by])]
        place, room = key - item * n, index.length[item]
        row = p.row[place]
        # from each of the item's words on, as far as a passage's surroundings can reach
        end = np.searchsorted(key, item * n + np.minimum(place + WINDOW + 2 * room, last[row]))
        hot = np.flatnonzero(total[end] - total[:-1] >= index.need[item])
        place, room, row, item = place[hot], room[hot], row[hot], item[hot]
        low = np.searchsorted(p.start, np.maximum(first[row], place - WINDOW - room + 1))
        high = np.searchsorted(p.start, np.minimum(last[row] - 1, place + room), side="right")
        of, passage = _ranges(low, high - low)
        pair = np.unique(passage * len(index.need) + item[of])
        passage, item = np.divmod(pair, len(index.need))
        start, room = p.start[passage], index.length[item]
        row = p.row[start]
        low = np.searchsorted(key, item * n + np.maximum(first[row], start - room))
        high = np.searchsorted(key, item * n + np.minimum(last[row], start + WINDOW + room))
        out.append(pair[total[high] - total[low] >= index.need[item]])
        a = b
    return np.divmod(np.sort(np.concatenate(out)), len(index.need))


def _spread(p: Passages, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the range of benchmark words, and column, of each distinct word in it; sorted by the number."""
    of, at = _ranges(lo, hi - lo)
    order = np.argsort(p.column, kind="stable")
    same = p.column[order][1:] == p.column[order][:-1]
    before = np.full(len(p.column), -1)
    before[order[1:][same]] = order[:-1][same]
    new = before[at] < lo[of]
    return of[new], p.column[at[new]]


def _sums(of: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows by their number, which are sorted, as n rows."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    if len(of):
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        out[of[starts]] = np.add.reduceat(rows, starts, axis=0)
    return out


def _added(df: DataFrame, run, width: int, height: int, block: int) -> np.ndarray:
    """Adds up the arrays that tasks make (height x width), block by block of rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = v.values.to_numpy()
                sums[k] = sums[k] + v if k in sums else v
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["k", "v"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = run(batches)
        for k in range(0, height, block):
            yield pa.RecordBatch.from_arrays([pa.array([k // block], pa.int32()), pa.array([total[k : k + block].ravel()], pa.list_(pa.float64()))], ["k", "v"])

    schema = "k int, v array<double>"
    out = np.zeros((height, width))
    table = df.select("text").mapInArrow(parts, schema).repartition("k").mapInArrow(add, schema).toArrow()
    for k, v in zip(table.column("k").to_pylist(), table.column("v").to_pylist(), strict=True):
        out[k * block : k * block + len(v) // width] = np.reshape(v, (-1, width))
    return out


def fit(docs: DataFrame, items: Items, least_overlap: float = 0.6, seed: int = 3) -> Latent:
    """Document frequencies of benchmark words, then the randomised SVD, each in one pass over all passages."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    size = len(items.vocabulary)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((size + 1, 1))
        for batch in batches:
            for _, _, data, offs in chunks(text_rows(batch, "text")):
                p = passages(data, offs, shared.value)
                total[:size, 0] += np.bincount(p.column, minlength=size)
                total[size, 0] += len(p.start)
        return total

    seen = _added(docs, frequencies, 1, size + 1, 1024)[:, 0]
    idf = np.log1p(max(seen[size], 2.0) / (1 + seen[:size])).astype(np.float32)
    slots = min(size, SLOTS)
    owned = [np.searchsorted(items.vocabulary, np.unique(w)) for w in items.words]
    of_item, column = np.repeat(np.arange(len(owned)), [len(x) for x in owned]), np.concatenate(owned)
    value = idf[column]
    value /= np.sqrt(np.bincount(of_item, value**2, len(owned)))[of_item].astype(np.float32)
    draws = min(RANK + EXTRA, slots)
    start = np.random.default_rng(seed).normal(size=(slots, draws)).astype(np.float32)
    load = np.bincount(np.arange(size) % slots, seen[:size], slots)
    often = np.argsort(-load, kind="stable")[:DENSE]
    dense_at = np.full(slots, -1)
    dense_at[often] = np.arange(len(often))

    def sketch(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((slots, draws), np.float32)
        for batch in batches:
            for _, _, data, offs in chunks(text_rows(batch, "text")):
                p = passages(data, offs, shared.value)
                of, column = _spread(p, p.lo, p.hi)
                value = idf[column]
                value /= np.sqrt(np.bincount(of, value**2, len(p.lo)))[of].astype(np.float32)
                column = column % slots
                cuts = np.arange(0, len(p.lo) + 2048, 2048)
                for lo, a, b in zip(cuts, np.searchsorted(of, cuts), np.searchsorted(of, cuts[1:]), strict=False):
                    n, own, col, v = min(2048, len(p.lo) - lo), of[a:b] - lo, column[a:b], value[a:b]
                    dense = dense_at[col] >= 0
                    matrix = np.zeros((n, len(often)), np.float32)
                    np.add.at(matrix, (own[dense], dense_at[col[dense]]), v[dense])
                    own, col, v = own[~dense], col[~dense], v[~dense]
                    y = matrix @ start[often] + _sums(own, start[col] * v[:, None], n)
                    total[often] += matrix.T @ y
                    order = np.argsort(col, kind="stable")
                    col, first = np.unique(col[order], return_index=True)
                    if len(col):
                        total[col] += np.add.reduceat(y[own[order]] * v[order, None], first, axis=0)
        return total

    corpus = _added(docs, sketch, draws, slots, 32)
    own = np.zeros((slots, draws))
    np.add.at(own, column % slots, _sums(of_item, start[column % slots] * value[:, None], len(owned))[of_item] * value[:, None])
    # items and corpus enter with equal weight, however large the corpus is
    basis, singular = singular_vectors(own + corpus * (np.linalg.norm(own) / max(np.linalg.norm(corpus), 1e-9)), start.astype(np.float64), min(RANK, slots))
    latent = _sums(of_item, basis[column % slots] * value[:, None], len(owned))
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    return Latent(idf, basis, singular, latent, index_of(items, seen[:size], least_overlap))


def singular_vectors(sketch: np.ndarray, start: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors and values of A, from A.T @ A @ start: a small decomposition of the sketch.

    A.T A is about B B.T with B = sketch @ (start.T @ sketch) ** -1/2 (Nystroem), whose left singular vectors
    and values are those of A, the values squared by themselves. A tiny shift keeps the root stable.
    """
    shift = 1e-7 * np.linalg.norm(sketch)
    moved = sketch + shift * start
    core = start.T @ moved
    level, turn = np.linalg.eigh((core + core.T) / 2)
    good = level > 1e-10 * max(level.max(initial=0.0), 1e-300)
    left, value, _ = np.linalg.svd(moved @ (turn[:, good] / np.sqrt(level[good])), full_matrices=False)
    return left[:, :rank].astype(np.float32), np.sqrt(np.maximum(value[:rank] ** 2 - shift, 0))


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit per word of ``a``."""
    at: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        at[x] = at.get(x, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for x in b.tolist():
        m = at.get(x)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def answer_share(item: np.ndarray, region: np.ndarray) -> float:
    """Share of the item's answer, its last quarter of words, that the region has."""
    answer = item[-max(1, len(item) // 4) :]
    return float(np.isin(answer, region).mean())


def leaks_of(data: np.ndarray, offs: np.ndarray, items: Items, latent: Latent, least_overlap: float) -> list[list[dict]]:
    n = len(offs) - 1
    found: list[dict] = [{} for _ in range(n)]
    p = passages(data, offs, items)
    first = np.searchsorted(p.row, np.arange(n))
    last = np.searchsorted(p.row, np.arange(n), side="right")
    if not len(p.column):
        return [[] for _ in range(n)]
    passage, number = bounded(p, latent.index, first, last)
    # an item longer than a passage is held against as many words
    lo = p.lo[passage]
    hi = np.searchsorted(p.place, np.minimum(last[p.row[p.start[passage]]], p.start[passage] + np.maximum(WINDOW, latent.index.length[number])))
    for a in range(0, len(passage), 2048):
        part, which = passage[a : a + 2048], number[a : a + 2048]
        of, column = _spread(p, lo[a : a + 2048], hi[a : a + 2048])
        y = _sums(of, latent.basis[column % len(latent.basis)] * latent.idf[column][:, None], len(part))
        y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)
        near = np.einsum("ij,ij->i", y, latent.items[which])
        for k in np.flatnonzero(near >= NEAR).tolist():
            i = int(which[k])
            start = p.start[part[k]]
            row = p.row[start]
            item = items.words[i]
            # as much room around the window as the item has words
            region = p.hash[max(first[row], start - len(item)) : min(last[row], start + WINDOW + len(item))]
            there = set(region.tolist())
            if sum(w in there for w in item.tolist()) < least_overlap * len(item):
                continue
            overlap = common_subsequence(item, region)
            answer = answer_share(item, region)
            if overlap < least_overlap * len(item) or (answer < 0.5 and overlap < 0.8 * len(item)):
                continue
            old = found[row].get(i)
            if old is None or (overlap, near[k]) > (old["overlap"], old["cosine"]):
                found[row][i] = {"item_id": items.ids[i], "overlap": overlap, "item_words": len(item), "answer": answer, "cosine": float(near[k]), "start": int(start - first[row])}
    return [[x[i] for i in sorted(x)] for x in found]


def find_leaks(df: DataFrame, benchmark: DataFrame, least_overlap: float = 0.6, text: str = "text", leaks: str = "leaks") -> DataFrame:
    """Adds ``leaks``, the benchmark items found in each text; an own column of that name (in any case) is replaced.

    A leak names the item (item_id), the length of the longest common subsequence (overlap), the item's words,
    the share of its answer that is there, the passage's cosine and first word. An item counts if the overlap
    is at least ``least_overlap`` of its words and half its answer is there, or the overlap is at least 0.8; its
    cosine must be ``NEAR``, so that chance runs of the commonest words are no leaks.
    Whole texts are searched. Null and empty texts, and items without words, have no leaks; an item given
    twice is found twice. The benchmark is read in blocks of ``ITEM_CHARACTERS`` by id: up to that size the number of
    passes over the corpus does not depend on it, and any number of items works.
    """
    kept = others(df.columns, (leaks,))
    kind = benchmark.schema["item_id"].dataType
    leak = f"array<struct<item_id: {kind.simpleString()}, overlap: int, item_words: int, answer: double, cosine: double, start: bigint>>"
    id_type = pa.int64() if kind.simpleString() == "bigint" else pa.int32() if kind.simpleString() == "int" else pa.string()
    leak_type = pa.list_(pa.struct([("item_id", id_type), ("overlap", pa.int32()), ("item_words", pa.int32()), ("answer", pa.float64()), ("cosine", pa.float64()), ("start", pa.int64())]))
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.select(*kept).schema.fields)
    out = df.select(*kept).withColumn(leaks, F.array().cast(leak))
    earlier = spare("earlier", [*df.columns, leaks])
    docs = df.select(F.col(text).alias("text"))

    def search(rows: list[tuple], out: DataFrame) -> DataFrame:
        items = prepare(rows)
        if not items.ids:
            return out
        shared = df.sparkSession.sparkContext.broadcast((items, fit(docs, items, least_overlap)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, latent = shared.value
            for batch in batches:
                found = [x for _, _, data, offs in chunks(text_rows(batch, text)) for x in leaks_of(data, offs, items, latent, least_overlap)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, leak_type)], [*kept, earlier, leaks])

        more = out.withColumnRenamed(leaks, earlier).mapInArrow(run, f"{fields}, `{earlier}` {leak}, `{leaks}` {leak}")
        return more.withColumn(leaks, F.concat(earlier, leaks)).drop(earlier)

    rows: list[tuple] = []
    size = 0
    for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        rows.append((r[0], r[1]))
        size += len(r[1] or "")
        if size >= ITEM_CHARACTERS:
            out, rows, size = search(rows, out), [], 0
    return search(rows, out) if rows else out
