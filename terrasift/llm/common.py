"""Shared helpers: keys, samples, and word arrays cut straight out of Arrow text buffers.

Words are runs of bytes other than 0x20 and 0x09-0x0D. In UTF-8 these bytes occur only as
themselves, so cutting bytes gives the same words as the pattern ``[^\\x20\\x09-\\x0D]+`` on text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import forget, scratch_dir, setting, stored  # noqa: F401

#: Java and DuckDB pattern of a word.
WORD = r"[^\x20\x09-\x0D]+"

SOLID = np.ones(256, bool)
SOLID[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


class Words(NamedTuple):
    """Words of consecutive rows: byte range, row within the chunk, 64-bit hash."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(name: str, columns: list[str]) -> str:
    """The name, with underscores in front until no column has it (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def bucket_of(doc_id: Column | str, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; a null id counts as empty text."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % buckets


def text_key(text: Column | str) -> Column:
    """16 bytes that stand for a text (md5; null counts as empty)."""
    text = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def row_key(row_id: Column | str, text: Column | str) -> Column:
    """16 bytes that stand for a row's id and text; a null id is no text's id."""
    row_id, text = (F.col(c) if isinstance(c, str) else c for c in (row_id, text))
    return F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("="), row_id.cast("string")), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))))


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64, vectorised."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 1 << 20)
        _powers = np.full(size, _ODD, np.uint64)
        _powers[0] = 1
        _powers = np.cumprod(_powers, dtype=np.uint64)
        _inverses = np.full(size, _ODD_INVERSE, np.uint64)
        _inverses[0] = 1
        _inverses = np.cumprod(_inverses, dtype=np.uint64)
    return _powers, _inverses


def chunks(column: pa.Array, max_bytes: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo..hi of a text column with their bytes and offsets, at most ``max_bytes`` at a time.

    A longer text makes a chunk of its own; no text is cut. Nulls count as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + max_bytes, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def cut_words(data: np.ndarray, offs: np.ndarray, hashed: bool = True, solid_bytes: np.ndarray = SOLID) -> Words:
    """The words of a chunk: runs of ``solid_bytes``. Row boundaries end words."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, none.astype(np.uint64))
    solid = solid_bytes[data]
    other = np.empty(n, bool)
    other[0], other[1:] = False, solid[:-1]
    first = offs[:-1]
    other[first[first < n]] = False
    start = np.flatnonzero(solid & ~other)
    other[-1], other[:-1] = False, solid[1:]
    last = offs[1:] - 1
    other[last[last >= 0]] = False
    end = np.flatnonzero(solid & ~other) + 1
    row = np.searchsorted(offs, start, side="right") - 1
    if not hashed:
        return Words(start, end, row, np.zeros(0, np.uint64))
    powers, inverses = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
    h = (sums[end] - sums[start]) * inverses[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return Words(start, end, row, mixed(h))


def windows(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words within a row, with the index of their first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    powers, inverses = _power_tables(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers[: len(h)], out=sums[1:])
    w = (sums[k:] - sums[:n]) * inverses[:n]
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return mixed(w[at] ^ np.uint64(k * 0x2545F4914F6CDD1D & _MASK)), at


def others(columns: list[str], replaced: tuple[str, ...]) -> list[str]:
    """The columns that are not replaced; names count as equal in any case, as Spark resolves them."""
    gone = {c.lower() for c in replaced}
    return [c for c in columns if c.lower() not in gone]


def sample_bound(limit: int, n: int) -> int:
    """Signed 64-bit bound that hashes of about ``limit`` of ``n`` rows do not pass: a little more, six deviations, so that fewer are as good as impossible."""
    wanted = limit + 6 * math.isqrt(limit) + 36
    return (1 << 63) - 1 if wanted >= n else (wanted << 64) // n - (1 << 63)


def bounded_sample(df: DataFrame, limit: int, *by: str, seed: int = 7) -> DataFrame:
    """``limit`` rows, or all if there are fewer, drawn by a hash of the columns ``by``.

    Rows that are equal in ``by`` must be equal in all columns. They are told apart by a number within their group:
    n of them get n places spread evenly over the range of the draw, so repeated keys neither flood the sample nor
    empty it. No row's position counts: any partitioning gives the same rows, and so does a task that runs again.
    Only hashes and their counts are shuffled, and what is broadcast has at most ``limit`` rows.
    """
    h, n, m = (spare(x, df.columns) for x in ("draw_hash", "draw_rows", "draw_times"))
    hashed = df.withColumn(h, F.xxhash64(F.lit(seed), *[F.col(c) for c in by]))
    counts = hashed.groupBy(h).agg(F.count(F.lit(1)).alias(n))
    total = counts.agg(F.sum(n)).first()[0] or 0
    # of n equal rows those with a place up to the bound, and one more, can be drawn
    bound = (sample_bound(limit, total) + (1 << 63)) / 2.0**64
    places = F.explode(F.sequence(F.lit(0), F.least(F.col(n) - 1, F.ceil(F.col(n) * bound)).cast("int"))).alias("i")
    uniform = (F.xxhash64(F.col(h), F.col("i")).cast("double") + float(1 << 63)) / 2.0**64
    drawn = counts.select(h, n, places).select(h, ((F.col("i") + uniform) / F.col(n)).alias("at"), "i").where(F.col("at") <= bound)
    times = drawn.orderBy("at", h, "i").limit(limit).groupBy(h).agg(F.count(F.lit(1)).alias(m))
    one = hashed.join(F.broadcast(times), h).groupBy(h, m).agg(F.min(F.struct(*df.columns)).alias("row"))
    return one.select("row.*", F.explode(F.sequence(F.lit(1), F.col(m).cast("int"))).alias(m)).drop(m)


def bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of fixed size, 2 ** bits, of the low bits of a table's integers: for filters ahead of joins."""
    low = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = df.select(F.shiftright(low, 6).alias("k"), F.expr(f"shiftleft(1L, cast({column} & 63L as int))").alias("bit")).groupBy("k").agg(F.bit_or("bit").alias("word")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("k").to_numpy()] = words.column("word").to_numpy()
    return out


def in_bitmap(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    low = (values & (len(words) * 64 - 1)).astype(np.int64)
    return ((words[low >> 6] >> (low & 63)) & 1).astype(bool)


def text_rows(batch: pa.RecordBatch, name: str) -> pa.Array:
    column = batch.column(batch.schema.get_field_index(name))
    return column if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.cast(pa.string())
