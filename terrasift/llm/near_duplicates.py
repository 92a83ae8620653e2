"""Near-duplicate texts by improved consistent weighted sampling over TF-IDF shingles.

Equal texts are one from the start, by a 16-byte key. Each distinct text gets samples whose chance to agree
is the weighted Jaccard similarity of two texts; bands of samples make buckets; in each bucket every text is
held against a few leaders, first by how many samples agree, then by the weighted Jaccard similarity itself,
over whole texts. Links that hold make classes by connected components. Later rounds pick other leaders, outside
a bucket's largest class, and look only at texts that share a bucket but not yet a class, so a group of n copies
costs about n comparisons. They go on until all pairs of a bucket are of one class or were compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import components
from .common import bitmap, chunks, cut_words, forget, in_bitmap, mixed, row_key, stored, text_key, text_rows, windows

BANDS, ROWS = 12, 3
SAMPLES = BANDS * ROWS
#: Texts of at least this weight deal their shingles out to the samples, each to one; lighter texts draw each
#: sample from all shingles. Texts near the border do both, as similar ones can lie on either side of it.
HEAVY = 150.0
#: Fixed size of the table of document frequencies, by shingle hash.
FREQUENCIES = 1 << 20
BLOCK = 1024
#: Bits of the filter of texts that have a candidate.
KEY_BITS = 23
IDF = 0.2
#: How many times as many leaders each round has: a round costs more than comparing blocks does.
GROWTH = 32
#: Texts of a block, by their mean size: as many as hold about ``LOAD`` bytes, from 16 to ``SIDE``. Two blocks meet in a group.
SIDE, LOAD = 1024, 1 << 21
#: Cells of the tables by which blocks are compared; more shingles are taken in slices.
CELLS = 1 << 22
#: Buckets of at most this many texts compare all their pairs, in the first round and later.
SMALL = (4, 64)


def shingles(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a chunk: row, hash, count, sorted by row. Texts under k words are one shingle."""
    w = cut_words(data, offs)
    h, at = windows(w.hash, w.row, k)
    row = w.row[at]
    n = len(offs) - 1
    count = np.bincount(w.row, minlength=n)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = np.searchsorted(w.row, short)
        whole = np.array([int(np.bitwise_xor.reduce(mixed(w.hash[f : f + c] + np.arange(c, dtype=np.uint64)))) for f, c in zip(first, count[short], strict=True)], np.uint64)
        h, row = np.r_[h, whole], np.r_[row, short]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.zeros(0, np.int64)
    return row[new], h[new], np.diff(np.r_[new, len(h)])


def weights(h: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """(1 + ln tf) times 1 to 1 + ``IDF`` by inverse document frequency: rare edits must not outweigh what is shared."""
    return (1 + np.log(count)) * idf[(h & np.uint64(FREQUENCIES - 1)).astype(np.int64)]


def document_frequencies(df: DataFrame, k: int) -> np.ndarray:
    """The IDF factor of each slot, from all texts. Slots hold several shingles; their mean is taken off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(FREQUENCIES, np.int64)
        for batch in batches:
            for _, _, data, offs in chunks(text_rows(batch, "text")):
                _, h, _ = shingles(data, offs, k)
                seen += np.bincount((h & np.uint64(FREQUENCIES - 1)).astype(np.int64), minlength=FREQUENCIES)
        if seen.any():
            ends = np.arange(0, FREQUENCIES + 1, BLOCK, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(FREQUENCIES // BLOCK, dtype=np.int32)), pa.ListArray.from_arrays(ends, pa.array(seen))], ["block", "seen"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            values = batch.column(1).flatten().to_numpy().reshape(-1, BLOCK)
            for block, v in zip(batch.column(0).to_pylist(), values, strict=True):
                sums[block] = sums[block] + v if block in sums else v
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.int64()))], ["block", "seen"])

    schema = "block int, seen array<bigint>"
    table = df.select("text").mapInArrow(run, schema).repartition("block").mapInArrow(add, schema).toArrow()
    total = np.zeros((FREQUENCIES // BLOCK, BLOCK))
    for block, v in zip(table.column("block").to_pylist(), table.column("seen").to_pylist(), strict=True):
        total[block] = v
    total = total.ravel()
    n = max(df.count(), 2)
    frequency = np.clip(total - total.mean(), 1, n)
    return 1 + IDF * np.log(n / frequency) / np.log(n)


def _uniforms(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = 1.0 / 2.0**32
    return ((x >> np.uint64(32)).astype(np.float64) + 0.5) * scale, ((x & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5) * scale


def consistent_samples(h: np.ndarray, weight: np.ndarray, salt: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Ln of each shingle's arrival, and what its sample says if it is first: the shingle and its step."""
    key = h + (np.atleast_1d(salt) + 1).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    x1 = mixed(key)
    x2 = mixed(x1 ^ np.uint64(0xE7037ED1A0B428DB))
    x3 = mixed(x2 ^ np.uint64(0x8EBC6AF09C88C6E3))
    u1, u2 = _uniforms(x1)
    u3, u4 = _uniforms(x2)
    beta, _ = _uniforms(x3)
    r, c = -np.log(u1 * u2), -np.log(u3 * u4)
    t = np.floor(np.log(weight) / r + beta)
    arrival = np.log(c) - r * (t - beta) - r
    said = mixed(x1 ^ t.astype(np.int64).view(np.uint64))
    return arrival, said


def signatures(row: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, heavy: bool) -> np.ndarray:
    """Samples of the rows 0..n-1, 32 bits each; 0 where a row has nothing to draw from."""
    out = np.zeros((n, SAMPLES), np.uint32)
    if not len(row):
        return out
    if heavy:
        slot = (mixed(h ^ np.uint64(0x589965CC75374CC3)) % np.uint64(SAMPLES)).astype(np.int64)
        arrival, said = consistent_samples(h, weight, slot)
        cell = row * SAMPLES + slot
        order = np.lexsort((arrival, cell))
        first = order[np.r_[True, cell[order][1:] != cell[order][:-1]]]
        out.ravel()[cell[first]] = said[first].astype(np.uint32)
        return out
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(row)]))
    for s in range(SAMPLES):
        arrival, said = consistent_samples(h, weight, s)
        at = np.flatnonzero(arrival == np.minimum.reduceat(arrival, starts)[group])
        at = at[np.r_[True, group[at][1:] != group[at][:-1]]]
        out[row[at], s] = said[at].astype(np.uint32)
    return out


def sign(df: DataFrame, idf, k: int, threshold: float) -> DataFrame:
    """(key, kind, signature, bytes) of a table (key, text); texts without words have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            new = []
            for i, key in enumerate(keys):  # copies near each other are signed once; the rest go later
                if key not in known:
                    known.add(key)
                    new.append(i)
            if len(known) > 200_000:
                known = set()
            texts = text_rows(batch, "text").take(pa.array(new, pa.int64()))
            for lo, hi, data, offs in chunks(texts):
                n = hi - lo
                row, h, count = shingles(data, offs, k)
                w = weights(h, count, idf.value)
                total = np.bincount(row, w, n)
                for kind, of in ((0, (total > 0) & (total < HEAVY / threshold)), (1, total >= HEAVY)):
                    if not of.any():
                        continue
                    own = of[row]
                    place = np.cumsum(of) - 1
                    sig = signatures(place[row[own]], h[own], w[own], int(of.sum()), kind == 1)
                    yield pa.RecordBatch.from_arrays([pa.array([keys[new[lo + i]] for i in np.flatnonzero(of)], pa.binary()), pa.array(np.full(len(sig), kind, np.int8)), pa.array([s.tobytes() for s in sig], pa.binary()), pa.array(np.diff(offs)[of])], ["key", "kind", "signature", "bytes"])

    return df.select("key", "text").mapInArrow(run, "key binary, kind tinyint, signature binary, bytes bigint").dropDuplicates(["key", "kind"])


def bands(signed: DataFrame) -> DataFrame:
    """(bucket, key, kind): a bucket holds texts of a kind that agree in all samples of a band."""
    part = [F.xxhash64(F.lit(b), "kind", F.substring("signature", 1 + 4 * ROWS * b, 4 * ROWS)) for b in range(BANDS)]
    return signed.select(F.explode(F.array(*part)).alias("bucket"), "key", "kind")


def shared(buckets: DataFrame, signed: DataFrame) -> DataFrame:
    """(bucket, key, kind, company, bytes) of the buckets with several texts; company adds up the sizes of a text's buckets."""
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    several = stored(buckets.join(sizes, "bucket"))
    company = several.groupBy("key", "kind").agg(F.sum("size").alias("company"))
    return several.drop("size").join(company, ["key", "kind"]).join(signed.drop("signature"), ["key", "kind"]).select("bucket", "key", "kind", "company", "bytes")


def comparisons(rest: DataFrame, i: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """What meets in round ``i``, (bucket, key) of the texts that are then compared with all of their bucket, and the tables these read.

    ``rest`` (bucket, key, kind, root) has the texts that were not leaders yet. Buckets of one class are settled,
    and small ones settle by all pairs. In others the texts meet leaders: two in the first round, then ``GROWTH`` times
    as many each round, from outside the largest class. Leaders are the texts with the most company (texts that share a
    bucket with them): what others were made from is near all of them, and comes first.

    A bucket's texts and its leaders are dealt into blocks (see ``SIDE``); each block of texts meets each block of
    leaders in one group, whose rows are the two blocks and not their pairs.
    """
    classes = rest.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    state = classes.groupBy("bucket").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("roots"), F.max(F.struct("n", "root"))["root"].alias("largest"), F.sum("bytes").alias("load"))
    side = F.greatest(F.lit(16), F.least(F.lit(SIDE), F.floor(LOAD * F.col("size") / F.greatest("load", F.lit(1))))).cast("int")
    state = state.where("roots > 1").select("bucket", "size", "largest", side.alias("side"))
    now = stored(rest.join(state, "bucket"))
    small = F.col("size") <= (SMALL[1] if i else SMALL[0])
    few = now.where(small).select("bucket", "kind", "key", "root")
    outside = now.where(~small if not i else ~small & (F.col("root") != F.col("largest")))
    hashed = F.struct((-F.col("company")).alias("d"), F.xxhash64(F.lit(10 * i), "key").alias("h"), "key", "root", "kind", "size", "side")
    leaders = least_of(outside.select("bucket", hashed.alias("leader")), 2 * GROWTH**i)
    columns = ("bucket", "mine", "theirs", "leads", "kind", "key", "root")
    both = few.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("leads")).select("bucket", F.lit(0).alias("mine"), F.lit(0).alias("theirs"), "leads", "kind", "key", "root")
    blocks = F.ceil(F.col("size") / F.col("side")).cast("int")
    wide = F.least(blocks, F.ceil(F.lit(2 * GROWTH**i) / F.col("side")).cast("int"))  # a bucket has no more leaders than texts
    part = lambda n: F.pmod(F.xxhash64("key", F.lit(3)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    texts = now.where(~small).select("bucket", part(blocks).alias("mine"), every(wide).alias("theirs"), F.lit(False).alias("leads"), "kind", "key", "root")
    led = leaders.select("bucket", "leader.*").select("bucket", every(blocks).alias("mine"), part(wide).alias("theirs"), F.lit(True).alias("leads"), "kind", "key", "root")
    done = few.select("bucket", "key").unionByName(leaders.select("bucket", F.col("leader.key").alias("key")))
    return both.select(*columns).unionByName(texts.select(*columns)).unionByName(led.select(*columns)), done, [now, leaders]


def least_of(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` least leaders of each bucket; ranked in parts first, so that no task sorts a whole bucket."""
    part = df.withColumn("part", F.pmod(F.col("leader.h"), F.lit(64)))
    for by in (["bucket", "part"], ["bucket"]):
        part = part.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("leader"))).where(F.col("rank") <= n)
    return stored(part.select("bucket", "leader"))


def candidates(meeting: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """(group, leads, texts, hits): of each group of ``comparisons`` the keys that have partners, and which have which.

    ``hits`` is a bit for each pair, texts by leads: a group's pairs are never rows. A pair is hit if it is of two
    classes and its samples agree at least as often as chance would leave to 1 in 10,000 pairs at the threshold.
    Of the buckets that two texts share only that of the first band looks at the pair.
    """
    least = int(SAMPLES * threshold - 3.9 * (SAMPLES * threshold * (1 - threshold)) ** 0.5)
    rows = meeting.join(signed.drop("bytes"), ["key", "kind"]).select(F.xxhash64("bucket", "mine", "theirs").alias("group"), "leads", "key", "root", "signature")

    def agreeing(leads: list[tuple], texts: list[tuple]) -> np.ndarray:
        first = np.frombuffer(b"".join(x[2] for x in leads), np.uint32).reshape(-1, SAMPLES)
        second = np.frombuffer(b"".join(x[2] for x in texts), np.uint32).reshape(-1, SAMPLES)
        own = ((first == first[0]).all(0) & (second == first[0]).all(0)).reshape(BANDS, ROWS).all(1)  # the bucket's band is one of these
        number = {r: i for i, r in enumerate({x[1] for x in leads} | {x[1] for x in texts})}
        roots = [np.array([number[x[1]] for x in side]) for side in (texts, leads)]
        hits = roots[0][:, None] != roots[1][None, :]
        for lo in range(0, len(texts), 64):
            equal = second[lo : lo + 64, None, :] == first[None, :, :]
            shared = equal.reshape(*equal.shape[:2], BANDS, ROWS).all(3)
            hits[lo : lo + 64] &= (equal.sum(2) >= least) & (own[shared.argmax(2)] | ~own.any())
        # two keys that both lead and are texts meet twice: the greater one is the text
        place = {key: i for i, key in enumerate(sorted({x[0] for x in leads} | {x[0] for x in texts}))}
        mine, theirs = (np.array([place[x[0]] for x in side]) for side in (texts, leads))
        hits &= ~(np.isin(mine, theirs)[:, None] & np.isin(theirs, mine)[None, :] & (mine[:, None] < theirs[None, :]))
        return hits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leads, texts = None, [], []

        def out() -> Iterator[pa.RecordBatch]:
            if leads and texts and (hits := agreeing(leads, texts)).any():
                t, d = np.flatnonzero(hits.any(1)), np.flatnonzero(hits.any(0))
                keys = [[side[i][0] for i in at.tolist()] for side, at in ((leads, d), (texts, t))]
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), *[pa.array([k], pa.list_(pa.binary())) for k in keys], pa.array([np.packbits(hits[np.ix_(t, d)]).tobytes()], pa.binary())], ["group", "leads", "texts", "hits"])

        for batch in batches:
            for group, lead, *row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if group != now:
                    yield from out()
                    now, leads, texts = group, [], []
                (leads if lead else texts).append(tuple(row))
        yield from out()

    dealt = rows.repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(run, "group bigint, leads array<binary>, texts array<binary>, hits binary")


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the lesser weights over the sum of the greater ones; hashes are sorted and distinct."""
    common, at, bt = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][at], b[1][bt]).sum()
    total = a[1].sum() + b[1].sum() - low
    return float(low / total) if total else 0.0


def texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, text) of the keys, each once. A bitmap of fixed size keeps most other texts out of the shuffle."""
    first = F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long").alias("first")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(keys.select(first), "first", KEY_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            first = np.array([int.from_bytes(k[:4], "big") for k in own], np.int64)
            seen: dict[bytes, int] = {}
            for i in np.flatnonzero(in_bitmap(shared.value, first)).tolist():
                seen.setdefault(own[i], i)
            yield batch.take(pa.array(list(seen.values()), pa.int64()))

    some = docs.select("key", "text").mapInArrow(run, "key binary, text string")
    return some.join(keys, "key", "left_semi").dropDuplicates(["key"])


def common_weights(left: list[tuple[np.ndarray, np.ndarray]], right: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sums of the lesser weights of the shingles (sorted hash, weight) of every left and every right text.

    A shingle is split into the steps between its distinct weights; two texts share the steps that both reach, so
    that the sums are products of two tables, taken in slices of a fixed size.
    """
    low = np.zeros((len(left), len(right)))
    both = [*left, *right]
    h, w = np.concatenate([x[0] for x in both]), np.concatenate([x[1] for x in both])
    row = np.repeat(np.arange(len(both)), [len(x[0]) for x in both])
    order = np.lexsort((w, h))
    h, w, row = h[order], w[order], row[order]
    if not len(h):
        return low
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    size = np.diff(np.r_[starts, len(h)])
    of_left = np.add.reduceat((row < len(left)).astype(np.int64), starts)
    kept = np.repeat((of_left > 0) & (of_left < size), size)
    h, w, row = h[kept], w[kept], row[kept]
    if not len(h):
        return low
    fresh = np.r_[True, h[1:] != h[:-1]]
    new = fresh | np.r_[True, w[1:] != w[:-1]]
    at = np.flatnonzero(new)
    step = w[at] - np.where(fresh[at], 0.0, w[at - 1])
    lowest = np.maximum.accumulate(np.where(fresh[at], np.arange(len(at)), 0))
    level = np.cumsum(new) - 1
    reach = level - lowest[level] + 1
    row = np.repeat(row, reach)
    column = np.arange(len(row)) - np.repeat(np.cumsum(reach) - reach, reach) + np.repeat(lowest[level], reach)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = max(CELLS // len(both), 1)
    for lo in range(0, len(at), width):
        hi = min(lo + width, len(at))
        part = slice(*np.searchsorted(column, (lo, hi)))
        table = np.zeros((len(both), hi - lo))
        table[row[part], column[part] - lo] = 1.0
        low += (table[: len(left)] * step[lo:hi]) @ table[len(left) :].T
    return low


def similar(leads: list[bytes], texts: list[bytes], hits: np.ndarray, known: dict[bytes, tuple[np.ndarray, np.ndarray]], threshold: float) -> list[tuple[bytes, bytes]]:
    """The hit pairs whose weighted Jaccard similarity reaches the threshold. The lesser total over the greater one bounds it."""
    least = threshold - 1e-9
    t, d = (np.array([float(known[k][1].sum()) for k in side]) for side in (texts, leads))
    hits = hits & (np.minimum(t[:, None], d[None, :]) >= least * np.maximum(t[:, None], d[None, :]))
    y, x = np.nonzero(hits)
    mine, theirs = np.unique(y), np.unique(x)
    if len(y) > len(mine) + len(theirs):
        low = common_weights([known[texts[i]] for i in mine.tolist()], [known[leads[i]] for i in theirs.tolist()])
        low = low[np.searchsorted(mine, y), np.searchsorted(theirs, x)]
        good = low >= least * (t[y] + d[x] - low)
    else:
        good = np.array([weighted_jaccard(known[texts[i]], known[leads[j]]) >= least for i, j in zip(y.tolist(), x.tolist(), strict=True)], bool)
    return [(texts[i], leads[j]) for i, j in zip(y[good].tolist(), x[good].tolist(), strict=True)]


def verify(groups: DataFrame, texts: DataFrame, idf, k: int, threshold: float) -> DataFrame:
    """The pairs hit in ``candidates`` whose whole texts are similar enough. A group gets each of its texts once, and cuts it once."""
    needed = groups.select("group", F.explode(F.array_union("leads", "texts")).alias("key")).distinct().join(texts, "key")
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("leads", "array<binary>"), ("texts", "array<binary>"), ("hits", "binary"))]
    rows = needed.select("group", F.lit(0).alias("t"), "key", "text", *empty)
    rows = rows.unionByName(groups.select("group", F.lit(1).alias("t"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast("string").alias("text"), "leads", "texts", "hits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, {}
        for batch in batches:
            group, t, key = (batch.column(i).to_pylist() for i in range(3))
            column = text_rows(batch, "text")
            lo = 0
            while lo < len(group):
                hi = lo
                while hi < len(group) and (group[hi], t[hi]) == (group[lo], t[lo]):
                    hi += 1
                if group[lo] != now:
                    now, known = group[lo], {}
                if t[lo]:  # after all texts of the group
                    for i in range(lo, hi):
                        leads, others, bits = (batch.column(c)[i].as_py() for c in (4, 5, 6))
                        hits = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(others) * len(leads)).reshape(len(others), len(leads)).astype(bool)
                        if found := similar(leads, others, hits, known, threshold):
                            yield pa.RecordBatch.from_arrays([pa.array(side, pa.binary()) for side in zip(*found, strict=True)], ["a", "b"])
                else:
                    for start, _, data, offs in chunks(column.slice(lo, hi - lo)):
                        row, h, count = shingles(data, offs, k)
                        w = weights(h, count, idf.value)
                        cut = np.searchsorted(row, np.arange(1, len(offs) - 1))
                        for j, own in enumerate(zip(np.split(h, cut), np.split(w, cut), strict=True)):
                            known[key[lo + start + j]] = own
                lo = hi

    return rows.repartition("group").sortWithinPartitions("group", "t").mapInArrow(run, "a binary, b binary")


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Classes (node, root) after new links (a, b): only the roots that these link are joined, and their texts follow."""
    if labels is None:
        return stored(components(links))
    root = lambda x: labels.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
    ends = links.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    moved = stored(components(ends)).select(F.col("node").alias("was"), F.col("root").alias("now"))
    old = labels.join(moved, F.col("root") == F.col("was"), "left").select("node", F.coalesce("now", "root").alias("root"))
    fresh = moved.select(F.col("was").alias("node"), F.col("now").alias("root")).join(labels.select("node"), "node", "left_anti")
    return stored(old.unionByName(fresh))


def near_duplicates(df: DataFrame, threshold: float = 0.8, words: int = 5, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Per row: its id, class_id (least id of its class), class_size, class_key and row_key.

    Rows are of one class if a chain of texts links them whose weighted Jaccard similarity over shingles of
    ``words`` words is at least ``threshold``. Equal texts are always linked. Texts under ``words`` words are a
    single shingle. Null and empty texts have no shingles: each such row is a class of its own. Null ids count
    in classes but are no class_id unless all are null. Repeated rows are copies. Other columns are left out.
    """
    spark = df.sparkSession
    docs = df.select(F.col(row_id).alias("id"), text_key(text).alias("key"), F.col(text).alias("text"), row_key(row_id, text).alias("row_key"))
    idf = spark.sparkContext.broadcast(document_frequencies(docs, words))
    signed = stored(sign(docs, idf, words, threshold))
    buckets = stored(shared(bands(signed), signed))
    labels = None
    rest, i = buckets, 0
    while True:
        now = rest.withColumn("root", F.col("key"))
        if labels is not None:
            now = stored(rest.join(labels, F.col("key") == F.col("node"), "left").select("bucket", "key", "kind", "company", "bytes", F.coalesce("root", "key").alias("root")))
        meeting, done, used = comparisons(now, i)
        done = stored(done)
        if i and done.isEmpty():
            forget(now, done, rest, signed, *used)
            break
        groups = stored(candidates(meeting, signed, threshold))
        if labels is None or not groups.isEmpty():
            keys = stored(groups.select(F.explode(F.array_union("leads", "texts")).alias("key")).distinct())
            found = stored(verify(groups, texts_of(docs, keys), idf, words, threshold))
            old, labels = labels, merged(labels, found)
            forget(keys, old)
        forget(groups)
        # only buckets with leaders can have more to compare
        old, rest = rest, stored(rest.join(done.select("bucket").distinct(), "bucket", "left_semi").join(done, ["bucket", "key"], "left_anti"))
        forget(now, old, done, *used)
        i += 1
    empty = F.unhex(F.md5(F.concat(F.lit("no words:"), F.coalesce(F.col("id").cast("string"), F.lit("")))))
    rows = docs.select("id", "key", "row_key", (~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")).alias("blank"))
    rows = rows.join(labels, F.col("key") == F.col("node"), "left").select("id", "row_key", F.when(F.col("blank"), empty).otherwise(F.coalesce("root", "key")).alias("class_key"))
    rows = stored(rows)
    sizes = stored(rows.groupBy(F.col("class_key").alias("c")).agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size")))
    return rows.join(sizes, F.col("class_key") == F.col("c")).select(F.col("id").alias(row_id), "class_id", "class_size", "class_key", "row_key")
