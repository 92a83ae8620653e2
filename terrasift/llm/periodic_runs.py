"""Maximal periodic runs of words, from the longest-previous-factor array.

A chunk of texts is one sequence of (text, word) symbols, so nothing matches across texts. Sorting by prefixes of
1, 2, 4, ... words gives the suffix array, and the ranks on the way tell in logarithmic time how far any two places
agree, forwards or backwards. Suffix array and LCP array give for each place the longest factor that starts earlier,
and with it the LZ blocks. A run that ends in a block either touches the block's borders, and is then found by
extending from a border by every period that block and the one before leave room for, or lies within the block, and
is then a copy of a run of the block's earlier occurrence: those are copied in the order of their starts.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut_words, mixed, text_rows, windows

#: Pairs of border and period that are extended at once.
SLICE = 1 << 20


class Ranks:
    """Ranks of all places by their first 1, 2, 4, ... symbols, until all differ; equal ranks are equal words."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = self.n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        rank = _numbered(symbols[order], order, n)
        self.levels = [rank]
        active, step = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1), 1
        while len(active):
            after = active + step
            key = rank[active].astype(np.int64) * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
            order = np.argsort(key, kind="stable")
            key, active, old = key[order], active[order], rank[active[order]]
            at = np.arange(len(key))
            group = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], at, 0))
            new = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], at, 0))
            rank = rank.copy()
            rank[active] = old + (new - group)
            self.levels.append(rank)
            several = np.bincount(new, minlength=len(key))[new] > 1
            active, step = np.sort(active[several]), 2 * step
        self.suffixes = np.empty(n, np.int64)
        self.suffixes[rank] = np.arange(n)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on are those from j on."""
        same, last = np.zeros(len(i), np.int64), self.n - 1
        for k in range(len(self.levels) - 1, -1, -1):
            a, b, rank = i + same, j + same, self.levels[k]
            fits = (np.maximum(a, b) <= last) & (rank[np.minimum(a, last)] == rank[np.minimum(b, last)])
            same[fits] += 1 << k
        return same

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i are those before j."""
        same = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            a, b, rank = i - same - (1 << k), j - same - (1 << k), self.levels[k]
            fits = (np.minimum(a, b) >= 0) & (rank[np.maximum(a, 0)] == rank[np.maximum(b, 0)])
            same[fits] += 1 << k
        return same


def _numbered(keys: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    """Ranks of sorted keys, equal ones by the first of them."""
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(np.r_[True, keys[1:] != keys[:-1]], np.arange(n), 0))
    return rank


def _minima(x: np.ndarray) -> list[np.ndarray]:
    """Minima of all stretches of 1, 2, 4, ... values."""
    out = [x]
    while 2 << (len(out) - 1) <= len(x):
        half = 1 << (len(out) - 1)
        out.append(np.minimum(out[-1][:-half], out[-1][half:]))
    return out


def longest_previous(ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """For each place the length of the longest factor there that also starts earlier, and where it does.

    It is one of the two suffixes next in the suffix array that start earlier; common prefixes are minima of LCP.
    """
    n, suffixes = ranks.n, ranks.suffixes
    lcp = np.r_[0, ranks.ahead(suffixes[:-1], suffixes[1:])].astype(np.int32)
    starts, commons = _minima(suffixes.astype(np.int32)), _minima(lcp)
    length, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    at = np.arange(n)
    for forward in (False, True):
        edge, common = at + forward, np.full(n, np.iinfo(np.int32).max, np.int64) if forward else lcp.astype(np.int64)
        # forwards, edge is the first place not yet passed, common the least LCP up to the one before it
        for k in range(len(starts) - 1, -1, -1):
            lo = edge if forward else edge - (1 << k)
            fits = (lo + (1 << k) <= n) if forward else lo >= 0
            where = np.clip(lo, 0, len(starts[k]) - 1)
            fits &= starts[k][where] > suffixes
            common[fits] = np.minimum(common[fits], commons[k][where[fits]])
            edge = edge + np.where(fits, (1 << k) if forward else -(1 << k), 0)
        other = edge if forward else edge - 1
        ok = (other < n) & (other >= 0)
        here = np.minimum(common[ok], lcp[other[ok]]) if forward else common[ok]
        place, from_ = suffixes[ok], suffixes[other[ok]]
        better = here > length[place]
        length[place[better]], source[place[better]] = here[better], from_[better]
    return length, source


def lz_blocks(length: np.ndarray) -> np.ndarray:
    """Where the blocks begin: each is the longest previous factor at its place, or one new word."""
    step, at, out = np.maximum(length, 1).tolist(), 0, []
    while at < len(step):
        out.append(at)
        at += step[at]
    return np.array(out, np.int64)


def find_runs(symbols: np.ndarray, row: np.ndarray, least: int = 24, exponent: int = 3) -> np.ndarray:
    """(start, length, period) of all maximal runs of at least ``least`` words and ``exponent`` periods.

    ``row`` tells the texts apart, in order; words of different texts never match. Sorted by start, then period.
    """
    if not len(symbols):
        return np.zeros((0, 3), np.int64)
    _, word = np.unique(symbols, return_inverse=True)
    ranks = Ranks(row.astype(np.int64) * (int(word.max()) + 1) + word)
    length, source = longest_previous(ranks)
    begin = lz_blocks(length)
    size = np.diff(np.r_[begin, len(symbols)])
    first = np.searchsorted(row, row)  # where each text begins
    last = np.searchsorted(row, row, side="right")
    opens = first[begin] == begin
    before = np.where(opens, 0, np.r_[0, size[:-1]])
    room = (last - first)[begin] // exponent
    # to the right of a block's begin, to the left of it, and to the left of a text's end
    ends = np.flatnonzero(np.r_[opens[1:], True])
    border = np.r_[begin, begin, begin[ends] + size[ends]]
    periods = np.r_[np.minimum(size, room), np.minimum(np.minimum(before + size, room), begin - first[begin]), np.minimum(size[ends], room[ends])]
    left = np.repeat([False, True, True], [len(begin), len(begin), len(ends)])
    found: dict[tuple[int, int], int] = {}
    total = np.cumsum(periods)
    lo = 0
    while lo < len(border):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + SLICE, side="right")))
        many = periods[lo:hi]
        q = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + 1
        i = np.repeat(border[lo:hi], many) - np.where(np.repeat(left[lo:hi], many), q, 0)
        back = ranks.behind(i, i + q)
        reach = back + q + ranks.ahead(i, i + q)
        good = np.flatnonzero(reach >= np.maximum(least, exponent * q))
        for s, n, p in zip((i[good] - back[good]).tolist(), reach[good].tolist(), q[good].tolist(), strict=True):
            found[s, n] = min(p, found.get((s, n), p))
        lo = hi
    runs = sorted((s, n, p) for (s, n), p in found.items())
    for k in np.flatnonzero(size > least + 1).tolist():  # the others have no room for a run and a word on each side
        b, n, p = int(begin[k]), int(size[k]), int(source[begin[k]])
        if length[b] == 0:
            continue
        at = bisect.bisect_right(runs, (p, len(symbols), 0))
        while at < len(runs) and runs[at][0] + least < p + n:
            s, r, q = runs[at]
            copy = (s + b - p, r, q)
            if s + r < p + n and (copy[0], r) not in found:
                found[copy[0], r] = q
                bisect.insort(runs, copy)
            at += 1
    out = np.array(sorted(((s, n, p) for (s, n), p in found.items()), key=lambda x: (x[0], x[2])), np.int64)
    return out.reshape(-1, 3)


def may_repeat(h: np.ndarray, row: np.ndarray, rows: int, least: int, exponent: int) -> np.ndarray:
    """By row, whether some stretch of words occurs twice that is as long as any run makes occur twice.

    A run of n words with period q holds its first n - q words again, and n - q >= n - n / exponent.
    """
    again = least - least // exponent
    w, at = windows(h, row, again)
    w = mixed(w ^ (row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(w)
    twice = np.flatnonzero(w[order][1:] == w[order][:-1])
    out = np.zeros(rows, bool)
    out[row[at[order[twice]]]] = True
    return out


def periodic_runs(df: DataFrame, least: int = 24, exponent: int = 3, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Per row of ``df``: its id, n_words, runs (array of start, length, period; by start, then period) and kept, the
    words joined by one space without those that lie in a run after its first period.

    Words are runs of characters other than 0x20 and 0x09-0x0D. A run is a stretch of at least ``least`` words and
    ``exponent`` (2 or more) times its smallest period that no neighbouring word extends. Null and empty texts have no
    words, no runs and keep nothing. Rows are judged one by one, so ids may be null or repeat. Texts are never cut: a
    long one is a chunk of its own and takes about 600 bytes of memory a word if it has runs. Words are compared by
    64-bit hashes. Other columns are left out.
    """
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    kind = df.schema[row_id].dataType.simpleString()
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in chunks(text_rows(batch, "text")):
                n = hi - lo
                w = cut_words(data, offs)
                count = np.bincount(w.row, minlength=n)
                kept = [b" ".join(data[a:b].tobytes().split()) for a, b in zip(offs[:-1], offs[1:], strict=True)]
                some = may_repeat(w.hash, w.row, n, least, exponent)
                own = np.flatnonzero(some[w.row])
                runs = find_runs(w.hash[own], w.row[own], least, exponent)
                of = w.row[own][runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
                head = np.searchsorted(w.row[own], of)  # of each run, where its text begins
                for r in np.unique(of).tolist():
                    mine = runs[np.searchsorted(of, r) : np.searchsorted(of, r, side="right")]
                    at = int(np.searchsorted(w.row[own], r))
                    edge = np.zeros(count[r] + 1, np.int64)
                    np.add.at(edge, mine[:, 0] + mine[:, 2] - at, 1)
                    np.add.at(edge, mine[:, 0] + mine[:, 1] - at, -1)
                    words = data[offs[r] : offs[r + 1]].tobytes().split()
                    kept[r] = b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])
                values = pa.StructArray.from_arrays([pa.array(runs[:, 0] - head), pa.array(runs[:, 1]), pa.array(runs[:, 2])], fields=list(struct))
                ends = np.r_[0, np.cumsum(np.bincount(of, minlength=n))].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), values)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(count.astype(np.int64)), lists, pa.array([k.decode() for k in kept], pa.string())], ["id", "n_words", "runs", "kept"])

    schema = f"id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, kept string"
    return df.select(F.col(row_id).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", row_id)
