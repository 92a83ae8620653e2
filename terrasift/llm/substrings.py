"""Substring dedup: removes every word that lies in a repeated run of ``length`` words.

Repeated runs are found with suffix automata over shards of reference text. One automaton of the whole
corpus cannot be broadcast, so text goes to the shard that can match it: every window of ``length`` words
is represented by its smallest 8-word hash (its anchor), and equal windows have equal anchors at equal
places. Neighbouring windows with the same anchor form a segment. Then

* an anchor met once has only unique windows;
* an anchor with one distinct segment, met more than once, has only repeated windows;
* else a suffix automaton of the anchor's distinct segments, weighted by their counts, gives for each
  window the number of places where its words end.

Anchors with more than ``MANY`` distinct segments (the edges of passages that very many documents share)
would make groups without bound: their windows are counted by hash instead, which any number of tasks can
share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _power_tables, bitmap, chunks, cut_words, in_bitmap, mixed, stored, text_rows

GRAM = 8
#: Distinct segments of an anchor that one automaton holds.
MANY = 2048
BITS = 26


def segments(h: np.ndarray, row: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchor, content hash, first window, number of windows and anchor's place, of each segment of a chunk."""
    n = len(h) - length + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    powers, inverses = _power_tables(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers[: len(h)], out=sums[1:])
    size = min(GRAM, length)
    m = len(h) - size + 1
    gram = mixed((sums[size:] - sums[:m]) * inverses[:m])
    # place of the leftmost smallest gram among the next 1, 2, 4 ... grams, then among all of a window
    span, best = 1, np.arange(m)
    grams = length - size + 1
    while span * 2 <= grams:
        left, right = best[:-span], best[span:]
        best = np.where(gram[left] <= gram[right], left, right)
        span *= 2
    if span < grams:
        left, right = best[: m - grams + 1], best[grams - span :]
        best = np.where(gram[left] <= gram[right], left, right)
    at = np.flatnonzero(row[:n] == row[length - 1 :])
    if not len(at):
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    place = best[at]
    new = np.r_[True, (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)]
    first = at[new]
    count = np.diff(np.r_[np.flatnonzero(new), len(at)])
    place = place[new]
    last = first + count + length - 1
    content = (sums[last] - sums[first]) * inverses[first]
    shape = (count * 1000 + (place - first)).astype(np.uint64)
    return gram[place], mixed(content + shape * np.uint64(0x9FB21C651E98DF25)), first, count, place


def window_counts(texts: list[np.ndarray], counts: list[int], length: int) -> list[np.ndarray]:
    """For each text, how often the words of each of its windows occur in all texts, taken ``counts`` times.

    A suffix automaton of the texts, set apart by separators, with occurrences summed along suffix links;
    then each text is streamed and its matching state cut back to ``length`` words.
    """
    step: list[dict[int, int]] = [{}]
    link, size, count = [-1], [0], [0]
    last = 0
    for k, (text, times) in enumerate(zip(texts, counts, strict=True)):
        for c in [*text.tolist(), -1 - k]:
            new = len(step)
            step.append({})
            link.append(0)
            size.append(size[last] + 1)
            count.append(times)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if size[q] == size[p] + 1:
                    link[new] = q
                else:
                    copy = len(step)
                    step.append(dict(step[q]))
                    link.append(link[q])
                    size.append(size[p] + 1)
                    count.append(0)
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
    for v in sorted(range(1, len(step)), key=size.__getitem__, reverse=True):
        count[link[v]] += count[v]
    found = []
    for text in texts:
        v, out = 0, []
        for i, c in enumerate(text.tolist(), 1):
            v = step[v][c]
            if i >= length:
                while size[link[v]] >= length:
                    v = link[v]
                out.append(count[v])
        found.append(np.array(out))
    return found


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def find_segments(df: DataFrame, length: int) -> DataFrame:
    """One row per segment of a table (id, th, text): anchor, seg, id, th, first (window within the text), n."""
    kind = df.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offs in chunks(text_rows(batch, "text")):
                w = cut_words(data, offs)
                anchor, seg, first, n, _ = segments(w.hash, w.row, length)
                row = w.row[first]
                begin = np.searchsorted(w.row, row)
                take = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays([_signed(anchor), _signed(seg), batch.column(0).take(take), batch.column(1).take(take), pa.array((first - begin).astype(np.int32)), pa.array(n.astype(np.int32))], ["anchor", "seg", "id", "th", "first", "n"])

    return df.mapInArrow(run, f"anchor bigint, seg bigint, id {kind}, th bigint, first int, n int")


def _texts_of(df: DataFrame, known: np.ndarray, length: int) -> DataFrame:
    """Words (32 bits each) and window hashes of the segments whose anchors are in the bitmap."""
    shared = df.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for _, _, data, offs in chunks(text_rows(batch, "text")):
                w = cut_words(data, offs)
                anchor, seg, first, n, _ = segments(w.hash, w.row, length)
                hit = np.flatnonzero(in_bitmap(bits, anchor.view(np.int64)))
                if not len(hit):
                    continue
                _, once = np.unique(np.stack([anchor[hit], seg[hit]], 1), axis=0, return_index=True)
                hit = hit[once]
                short = w.hash.astype(np.uint32)
                words = [short[first[i] : first[i] + n[i] + length - 1].tobytes() for i in hit]
                yield pa.RecordBatch.from_arrays([_signed(anchor[hit]), _signed(seg[hit]), pa.array(words, pa.binary())], ["anchor", "seg", "words"])

    return df.mapInArrow(run, "anchor bigint, seg bigint, words binary")


def _by_automaton(groups: DataFrame, length: int) -> DataFrame:
    """Repeated runs of windows in each segment; rows of an anchor come together and sorted."""

    def solve(anchor: int, rows: list[tuple[int, int, bytes]]) -> list[tuple[int, int, int, int]]:
        texts = [np.frombuffer(words, np.uint32) for _, _, words in rows]
        found = window_counts(texts, [n for _, n, _ in rows], length)
        return [(anchor, seg, lo, hi) for (seg, _, _), c in zip(rows, found, strict=True) for lo, hi in _runs(c > 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            out = []
            for anchor, seg, times, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if anchor != now:
                    out += solve(now, rows) if rows else []
                    now, rows = anchor, []
                if not rows or rows[-1][0] != seg:
                    rows.append((seg, times, words))
            yield _ranges(out)
        yield _ranges(solve(now, rows) if rows else [])

    def _ranges(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())], ["anchor", "seg", "lo", "hi"])

    return groups.repartition("anchor").sortWithinPartitions("anchor", "seg").mapInArrow(run, "anchor bigint, seg bigint, lo int, hi int")


def _hot_windows(df: DataFrame, known: np.ndarray, length: int) -> DataFrame:
    """(anchor, seg, place, window): hashes of the single windows of segments whose anchors are in the bitmap."""
    shared = df.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for _, _, data, offs in chunks(text_rows(batch, "text")):
                w = cut_words(data, offs)
                anchor, seg, first, n, _ = segments(w.hash, w.row, length)
                hit = np.flatnonzero(in_bitmap(bits, anchor.view(np.int64)))
                if not len(hit):
                    continue
                powers, inverses = _power_tables(len(w.hash) + 1)
                sums = np.zeros(len(w.hash) + 1, np.uint64)
                np.cumsum(w.hash * powers[: len(w.hash)], out=sums[1:])
                of = np.repeat(hit, n[hit])
                place = np.arange(len(of)) - np.repeat(np.cumsum(n[hit]) - n[hit], n[hit])
                at = first[of] + place
                window = mixed((sums[at + length] - sums[at]) * inverses[at])
                yield pa.RecordBatch.from_arrays([_signed(anchor[of]), _signed(seg[of]), pa.array(place.astype(np.int32)), _signed(window)], ["anchor", "seg", "place", "window"])

    return df.mapInArrow(run, "anchor bigint, seg bigint, place int, window bigint")


def repeated_ranges(df: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Segments of a table (id, th, text), and the repeated runs [lo, hi) of windows of (anchor, seg)."""
    found = stored(find_segments(df, length))
    segs = stored(found.groupBy("anchor", "seg").agg(F.count(F.lit(1)).alias("times"), F.first("n").alias("n")))
    anchors = stored(segs.groupBy("anchor").agg(F.sum("times").alias("all"), F.count(F.lit(1)).alias("kinds")).where("all > 1"))
    several = anchors.where(f"kinds > 1 and kinds <= {MANY}")
    hot = anchors.where(f"kinds > {MANY}")

    same = segs.where("times > 1").select("anchor", "seg", F.lit(0).alias("lo"), F.col("n").alias("hi"))
    texts = _texts_of(df, bitmap(several, "anchor", BITS), length)
    groups = segs.join(several.select("anchor"), "anchor").select("anchor", "seg", "times")
    groups = texts.dropDuplicates(["anchor", "seg"]).join(groups, ["anchor", "seg"]).select("anchor", "seg", "times", "words")
    ranges = same.unionByName(_by_automaton(groups, length))
    if hot.head(1):
        # other anchors that share the bitmap's bits come along: their windows are judged rightly too
        windows = stored(_hot_windows(df, bitmap(hot, "anchor", BITS), length).groupBy("anchor", "seg", "place", "window").agg(F.count(F.lit(1)).alias("times")))
        again = windows.groupBy("anchor", "window").agg(F.sum("times").alias("times")).where("times > 1").select("anchor", "window")
        ranges = ranges.unionByName(windows.join(again, ["anchor", "window"]).select("anchor", "seg", F.col("place").alias("lo"), (F.col("place") + 1).alias("hi")))
    return found, stored(ranges.distinct())


def remove_repeats(df: DataFrame, length: int = 35, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Per row of ``df``: its id, n_words, n_removed and kept (the words left, joined by one space).

    A word goes if any window of ``length`` words over it occurs anywhere else, in the same text or another;
    windows are judged on the input. Null and empty texts have no words; texts shorter than ``length`` lose
    none. Equal rows are copies of each other and lose all their windows. Ids may be null or repeat. Other
    columns are left out.
    """
    rows = df.select(F.col(row_id).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), F.col(text).alias("text"))
    found, ranges = repeated_ranges(rows, length)
    lost = found.join(ranges, ["anchor", "seg"]).select("id", "th", (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi")).alias("hi"))
    lost = lost.groupBy("id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("lost")).withColumnRenamed("id", "lost_id").withColumnRenamed("th", "lost_th")
    joined = rows.join(lost, F.col("id").eqNullSafe(F.col("lost_id")) & (F.col("th") == F.col("lost_th")), "left").select("id", "text", "lost")
    kind = df.schema[row_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for text, lost in zip(batch.column(1), batch.column(2), strict=True):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                n = len(words)
                if lost.is_valid:
                    spans = lost.values.flatten()
                    edge = np.zeros(n + 1, np.int32)
                    np.add.at(edge, spans[0].to_numpy(zero_copy_only=False), 1)
                    np.add.at(edge, spans[1].to_numpy(zero_copy_only=False) + length - 1, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:n]) == 0)]
                total.append(n)
                removed.append(n - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])

    out = joined.mapInArrow(run, f"id {kind}, n_words bigint, n_removed bigint, kept string")
    return out.withColumnRenamed("id", row_id)


