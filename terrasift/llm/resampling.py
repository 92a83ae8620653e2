"""Importance resampling towards a target corpus, by bags of hashed word runs.

Features are runs of one to three words, hashed into buckets. The postings (bucket, document, count) are inverted:
a block of up to 256 documents is turned into one row for each group of buckets, which lists for every bucket of
the group the documents that hold it. These rows are dealt out by bucket group; there they meet the totals of both
corpora for the same buckets, so gains are worked out where the buckets are, and what leaves is one sum for each
document of the block. The sums of all bucket groups are added up by block, that is, by document.

A bucket that a third of all documents hold is no hot key: a group of buckets is dealt out in as many parts as
there are blocks to keep a part small, and only the totals, one row for each bucket group, are repeated.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, chunks, cut_words, spare, stored, text_rows

#: Documents of a block (a document's place in it is one byte), and bytes of text, unless one text is longer.
BLOCK, BLOCK_BYTES = 256, 1 << 20
#: Groups of buckets.
GROUPS = 50
#: Blocks that meet in one task's group at most, about.
MEET = 64
#: Words of more bytes are hashed one by one.
LONG_WORD = 64

LETTERS = np.zeros(256, bool)
LETTERS[0x30:0x3A] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True


def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 by bytes, and for each n up to 3 * (LONG_WORD + 1) what n zero bytes make of each byte of a state."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    shift = np.zeros((3 * (LONG_WORD + 1) + 1, 4, 256), np.uint32)
    for k in range(4):
        shift[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, len(shift)):
        shift[n] = table[shift[n - 1] & 0xFF] ^ (shift[n - 1] >> np.uint32(8))
    return table, shift


TABLE, SHIFT = _crc_tables()


def _moved(state: np.ndarray, n: np.ndarray) -> np.ndarray:
    """States after n zero bytes."""
    return SHIFT[n, 0, state & 0xFF] ^ SHIFT[n, 1, (state >> 8) & 0xFF] ^ SHIFT[n, 2, (state >> 16) & 0xFF] ^ SHIFT[n, 3, state >> 24]


def feature_hashes(data: np.ndarray, offs: np.ndarray, most: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and CRC-32 of each run of 1 to ``most`` words, joined by one space, and the number of words by row.

    ``data`` is in lower case. A CRC is linear: that of a longer run is that of the shorter one, moved on by as many
    bytes as are added, and what these would give alone.
    """
    w = cut_words(data, offs, hashed=False, solid_bytes=LETTERS)
    size = w.end - w.start
    own = np.zeros(len(size), np.uint32)
    brief = size <= LONG_WORD
    live = np.flatnonzero(brief)
    for k in range(LONG_WORD):
        live = live[size[live] > k]
        if not len(live):
            break
        own[live] = TABLE[(own[live] ^ data[w.start[live] + k]) & 0xFF] ^ (own[live] >> np.uint32(8))
    length = np.where(brief, size, 0)
    spaced = own ^ _moved(np.full(len(own), TABLE[32]), length)
    rows, hashes, state, total, at = [], [], own, length, np.arange(len(own))
    for n in range(1, most + 1):
        if n > 1:
            at = at[: len(at) - 1] if len(at) else at
            last = at + n - 1
            state = _moved(state[: len(at)], length[last] + 1) ^ spaced[last]
            total = total[: len(at)] + length[last] + 1
        inside = w.row[at] == w.row[at + n - 1] if len(at) else np.zeros(0, bool)
        crc = state ^ _moved(np.full(len(at), 0xFFFFFFFF, np.uint32), total) ^ np.uint32(0xFFFFFFFF)
        for i in np.unique(np.concatenate([np.flatnonzero(~brief) - k for k in range(n)])).tolist() if not brief.all() else []:
            if 0 <= i < len(at) and inside[i]:
                crc[i] = zlib.crc32(b" ".join(data[w.start[j] : w.end[j]].tobytes() for j in range(i, i + n)))
        rows.append(w.row[at][inside])
        hashes.append(crc[inside])
    return np.concatenate(rows), np.concatenate(hashes), np.bincount(w.row, minlength=len(offs) - 1)


POSTINGS = "block string, group int, salt int, held binary, docs binary, more_at binary, more binary, ids {ids}, words array<bigint>, features array<bigint>"


def postings(df: DataFrame, buckets: int, most: int, salts: int, only_totals: bool = False) -> DataFrame:
    """Inverted postings of a table (id, text).

    A row is a block's part of a bucket group: ``held`` counts the documents of each bucket, ``docs`` lists their
    places in the block, bucket by bucket, and ``more_at``, ``more`` are the counts above 1. The rows of group -1 name
    the block's ids and how many words and features they have. With ``only_totals`` a task gives one row a group,
    in which ``held`` sums up the counts of each bucket.
    """
    kind = df.schema["id"].dataType
    edges = np.linspace(0, buckets, GROUPS + 1).astype(int)
    schema = POSTINGS.format(ids=f"array<{kind.simpleString()}>") if not only_totals else "group int, held binary"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            texts = text_rows(batch, "text")
            for start in range(0, len(batch), BLOCK):
                for lo, hi, data, offs in chunks(texts.slice(start, BLOCK), BLOCK_BYTES):
                    row, crc, words = feature_hashes(LOWER[data], offs, most)
                    cell = (crc % np.uint32(buckets)).astype(np.int64) * BLOCK + row
                    cell, count = np.unique(cell, return_counts=True)
                    yield batch.column(0).slice(start + lo, hi - lo), words, cell, count

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, number, of = b"", 0, TaskContext.get().partitionId()
        for ids, words, cell, count in blocks(batches):
            block, number = f"{of}-{number}", number + 1
            salt = zlib.crc32(block.encode()) % salts
            bucket, place = cell // BLOCK, (cell % BLOCK).astype(np.uint8)
            at = np.searchsorted(bucket, edges)
            out = []
            for g in range(GROUPS):
                a, b = at[g], at[g + 1]
                if a < b:
                    more = np.flatnonzero(count[a:b] > 1)
                    held = np.bincount(bucket[a:b] - edges[g], minlength=edges[g + 1] - edges[g])
                    out.append((block, g, salt, held.astype(np.uint16).tobytes(), place[a:b].tobytes(), more.astype(np.uint32).tobytes(), count[a:b][more].astype(np.uint32).tobytes(), None, None, None))
            n = np.sum([np.maximum(words - k, 0) for k in range(most)], axis=0)
            out.append((block, -1, salt, none, none, none, none, ids.to_pylist(), words.tolist(), n.tolist()))
            columns = list(zip(*out, strict=True))
            types = [pa.string(), pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.list_(ids.type), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["block", "group", "salt", "held", "docs", "more_at", "more", "ids", "words", "features"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, _, cell, count in blocks(batches):
            total += np.bincount(cell // BLOCK, count, buckets).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(GROUPS), pa.int32()), pa.array([total[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary())], ["group", "held"])

    return df.select("id", "text").mapInArrow(add if only_totals else invert, schema)


def _counts(held: bytes, more_at: bytes, more: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bucket in the group and count of each posting of a row."""
    held = np.frombuffer(held, np.uint16)
    bucket = np.repeat(np.arange(len(held)), held)
    count = np.ones(len(bucket), np.int64)
    count[np.frombuffer(more_at, np.uint32)] = np.frombuffer(more, np.uint32)
    return bucket, count


def _sums(rows: DataFrame) -> DataFrame:
    """(group, held): counts of a group's buckets added up, first in each task, then by group."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for g, *row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                bucket, count = _counts(*row)
                own = np.bincount(bucket, count, len(row[0]) // 2).astype(np.int64)
                sums[g] = sums[g] + own if g in sums else own
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["group", "held"])

    return added(rows.where("group >= 0").select("group", "held", "more_at", "more").mapInArrow(partial, "group int, held binary"))


def added(sums: DataFrame) -> DataFrame:
    """One row a group. What tasks give is added up in two steps, so no group waits for one row from every task."""

    def add(group: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(b, np.int64) for b in group.column("held").to_pylist()], axis=0)
        return pa.table({"group": group.column("group")[:1], "held": pa.array([total.tobytes()], pa.binary())})

    some = sums.withColumn("part", F.pmod(F.xxhash64("held"), F.lit(64)))
    some = some.groupBy("group", "part").applyInArrow(lambda t: add(t), "group int, held binary")
    return some.groupBy("group").applyInArrow(lambda t: add(t), "group int, held binary")


def document_weights(docs: DataFrame, target: DataFrame, buckets: int, most: int) -> DataFrame:
    """(id, n_words, n_features, weight) of each row of a table (id, text)."""
    n = docs.count()
    salts = max(1, n // (BLOCK * MEET))
    rows = stored(postings(docs, buckets, most, salts))
    source = _sums(rows).withColumnRenamed("held", "s")
    wanted = added(postings(target, buckets, most, 1, True)).withColumnRenamed("held", "t")
    groups = docs.sparkSession.range(GROUPS).select(F.col("id").cast("int").alias("group"))
    both = stored(groups.join(wanted, "group", "left").join(source, "group", "left"))  # a row for each of the groups, whatever the size of the corpora

    def total(column: str) -> int:
        return sum(int(np.frombuffer(b[0], np.int64).sum()) for b in both.select(column).collect() if b[0] is not None)

    s_all, t_all = total("s"), total("t")
    totals = both.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select("group", "salt", "s", "t")

    def contribute(left: pa.Table, right: pa.Table) -> pa.Table:
        blocks, sums = [], []
        if len(left):
            s = np.frombuffer(right.column("s")[0].as_py(), np.int64).astype(float)
            t = np.frombuffer(right.column("t")[0].as_py() or bytes(8 * len(s)), np.int64).astype(float)
            gain = np.floor(1000 * np.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets))))
            for part in left.to_batches(64):
                for block, held, docs, more_at, more in zip(*(part.column(k).to_pylist() for k in ("block", "held", "docs", "more_at", "more")), strict=True):
                    bucket, count = _counts(held, more_at, more)
                    weight = np.bincount(np.frombuffer(docs, np.uint8), gain[bucket] * count)
                    blocks.append(block)
                    sums.append(weight.astype(np.int64).tobytes())
        return pa.table({"block": pa.array(blocks, pa.string()), "sums": pa.array(sums, pa.binary())})

    kind = docs.schema["id"].dataType

    def reduce(group: pa.Table) -> pa.Table:
        whole = group.filter(pc.is_valid(group.column("ids")))
        ids = whole.column("ids")[0].values
        weight = np.zeros(len(ids), np.int64)
        for sums in group.column("sums").to_pylist():
            if sums:
                own = np.frombuffer(sums, np.int64)
                weight[: len(own)] += own
        return pa.table({"id": ids, "n_words": whole.column("words")[0].values, "n_features": whole.column("features")[0].values, "weight": pa.array(weight)})

    dealt = rows.where("group >= 0").select("group", "salt", "block", "held", "docs", "more_at", "more")
    sums = dealt.groupBy("group", "salt").cogroup(totals.groupBy("group", "salt")).applyInArrow(contribute, "block string, sums binary")
    names = rows.where("group = -1").select("block", F.lit(None).cast("binary").alias("sums"), "ids", "words", "features")
    all_sums = names.unionByName(sums.select("block", "sums"), allowMissingColumns=True)
    out = all_sums.groupBy("block").applyInArrow(reduce, f"id {kind.simpleString()}, n_words bigint, n_features bigint, weight bigint")
    return stored(out)


def ranked(df: DataFrame, rank: str, eligible: str, order: list, share: tuple[int, int]) -> DataFrame:
    """``rank`` of the first ``share`` of the eligible rows in an order, null for all others.

    Rows are sorted by ranges and numbered within; only one count for each range reaches the driver.
    """
    spark = df.sparkSession
    place, part = spare("place", df.columns), spare("part", [*df.columns, spare("place", df.columns)])
    keys = [F.col(eligible).desc(), *order]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = stored(rows.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.count_if(eligible).alias("fit")).orderBy(part).collect()
    drawn = sum(r["fit"] for r in counts) * share[0] // share[1]
    before, first = 0, {}
    for r in counts:
        first[r[part]] = before
        before += r["n"]
    firsts = spark.createDataFrame(list(first.items()) or [(0, 0)], f"`{part}` int, `__before` bigint")
    at = F.col("__before") + F.col(place) + 1
    return rows.join(F.broadcast(firsts), part).withColumn(rank, F.when(F.col(eligible) & (at <= drawn), at)).drop(part, place, "__before")


def resample(df: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = 10_000, most: int = 3, text: str = "text", row_id: str = "doc_id", target_text: str = "text") -> DataFrame:
    """Per row of ``df``: its id, n_words, n_features, weight, score and rank (null unless drawn).

    Words are runs of ASCII letters and digits (A-Z in lower case) and of all characters beyond ASCII; features are
    runs of 1 to ``most`` words, repeats counted. weight adds up the gains of a row's features, floor(1000 ln ((t+1)
    (S+buckets) / ((s+1) (T+buckets)))) for a bucket that holds s of the S features of ``df`` and t of the T of
    ``target``. score adds Gumbel noise drawn from ``seed`` and the id, so the ``percent`` of the rows of at least
    ``least_words`` words with the highest scores are drawn without replacement in proportion to exp(weight / 1000).

    Null and empty texts have no features and weight 0; null ids are drawn as an empty id and come last among ties, as
    do, of rows with equal id and score, those with more features. Repeated rows count each. An empty ``target`` favours
    rare buckets. Other columns are left out. Rows of ``df`` must come in the same
    order when a part is read again, as those of files do.
    """
    docs = df.select(F.col(row_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    wanted = target.select(F.lit(0).alias("id"), F.coalesce(F.col(target_text), F.lit("")).alias("text"))
    out = document_weights(docs, wanted, buckets, most)
    own = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(own, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(float(1 << 32)))))
    out = out.withColumn("score", F.col("weight") + noise).withColumn("fit", F.col("n_words") >= least_words)
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features").asc(), F.col("weight").asc()]
    return ranked(out, "rank", "fit", order, (percent, 100)).select(F.col("id").alias(row_id), "n_words", "n_features", "weight", "score", "rank")
