"""Encoding and decoding of whole texts by a public byte-level BPE vocabulary.

A text of up to ``LONG`` bytes is encoded where it is. A longer one is halved until its parts are short; the
parts are encoded in parallel, wherever Spark puts them, and put together again in a tree of joins. A join does
not encode its sides anew: a window around it, which grows until both sides agree with it, is all that is cut into
pieces and merged again. Two facts make that exact:

* The pattern that cuts text into pieces looks at most two characters past a piece, and never back. So a side's
  pieces that end ``MARGIN`` bytes before the join stand, and as soon as the window's pieces and the right side's
  begin one at the same place, all further ones are the right side's.
* Within a piece, tokens are those of the whole piece if and only if each two neighbours are those of their own
  concatenation. So if the merged window begins with the token that the left side has there and ends with the token
  that the right side has there, the rest of both sides stands.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, row_key, text_rows

#: Texts of more bytes are encoded in parts of at most ``LEAF`` bytes and a character.
LONG, LEAF = 1 << 15, 1 << 14
#: What a piece may look at past its end, in bytes, and more.
MARGIN = 16
#: Set in an id that begins a piece.
FIRST = 1 << 30
#: Fragments that a task remembers, and the longest in bytes.
KNOWN, KNOWN_BYTES = 300_000, 256

# A space is the first byte of a piece if what follows is no white space: always so for these next bytes (of the
# lead bytes, C2 and E1 to E3 may begin one of Unicode's white space characters).
SOLID_NEXT = np.zeros(256, bool)
SOLID_NEXT[0x21:0x7F] = True
SOLID_NEXT[0xC3:0xE1] = True
SOLID_NEXT[0xE4:0xF5] = True
# What always ends a run of letters or digits.
STOPS = np.zeros(256, bool)
STOPS[list(b".,;:!?")] = True
LETTERS = np.zeros(256, bool)
LETTERS[0x30:0x3A] = LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = True
#: Fragments that are a piece in themselves: letters of the Latin blocks, or digits, behind one space at most.
WORD = re.compile("\x20?(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|[0-9]+)")
SOLID = np.zeros(256, bool)
SOLID[0x21:0x7F] = True


class Vocabulary:
    """The tokenizer of a file, its tokens' bytes, and a memory of fragments that were encoded."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        cut, model = told.get("pre_tokenizer") or {}, told["model"]
        plain = {k for k in ("lstrip", "rstrip", "single_word", "normalized") for t in told["added_tokens"] if t.get(k)}
        if model.get("type") != "BPE" or told.get("normalizer") or plain or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError(f"{path}: only byte-level BPE without normalizer or prefix space can be encoded in parts")
        if model.get("dropout") or model.get("ignore_merges"):
            raise ValueError(f"{path}: merges must be applied in order, without dropout")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model, self.pieces = self.tokenizer.model, self.tokenizer.pre_tokenizer
        added = {t["id"]: t["content"] for t in told["added_tokens"]}
        if any(re.search(r"[\s.,;:!?]", c) for c in added.values()):
            raise ValueError(f"{path}: added tokens with spaces or stops can't be told from text in parts")
        self.added = {content: i for i, content in added.items()}
        self.margin = MARGIN + max([0, *(len(c.encode()) for c in self.added)])
        longest = sorted(self.added, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        letters = {c: b for b, c in enumerate(_alphabet())}
        self.alphabet = _alphabet()
        self.shown = dict(enumerate(self.alphabet))
        found = {i: bytes(letters[c] for c in t) for t, i in self.tokenizer.get_vocab(False).items() if i not in added}
        found |= {i: c.encode() for i, c in added.items()}
        self.bytes = [found.get(i, b"") for i in range(max(found) + 1)]
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        #: Separates fragments that are encoded together: an added token cuts its text apart.
        self.between = min(self.added).encode() if self.added else None
        self.known: dict[bytes, bytes] = {}

    def text(self, ids: np.ndarray) -> bytes:
        return b"".join([self.bytes[i] for i in ids.tolist()])

    def merge(self, piece: bytes) -> np.ndarray:
        """The tokens of one piece."""
        return np.array([t.id for t in self.model.tokenize(piece.decode("latin-1").translate(self.shown))], np.int32)

    def cut(self, text: bytes) -> list[tuple[int, int, int]]:
        """The pieces of a text: begin, end, and the id if it is an added token, else -1."""
        out, at, text = [], 0, text.decode()
        for part in self.split.split(text) if self.split else [text]:
            if part in self.added:
                out.append((at, at := at + len(part.encode()), self.added[part]))
                continue
            for mapped, _ in self.pieces.pre_tokenize_str(part) if part else []:
                out.append((at, at := at + len(mapped), -1))
        return out

    def fragments(self, data: bytes, ends: list[int]) -> tuple[list[bytes], list[int]]:
        """Consecutive texts cut where a piece begins whatever is around it, and how many fragments end by each text's end.

        A piece always begins at a space before what is no white space, at a comma or stop after an ASCII letter or
        digit, and after a lone line feed.
        """
        raw = np.frombuffer(data, np.uint8)
        first = np.zeros(len(raw) + 1, bool)
        if len(raw) > 2:
            first[:-2] = (raw[:-1] == 32) & SOLID_NEXT[raw[1:]]
            first[[e - 1 for e in ends if e]] = False  # what follows is another text
            first[1:-1] |= STOPS[raw[1:]] & LETTERS[raw[:-1]]
            line = (raw[1:-1] == 10) & SOLID_NEXT[raw[2:]] & SOLID[raw[:-2]]
            near = np.array([0, *ends])
            line[np.clip(near[near >= 1] - 1, 0, len(line) - 1)] = False  # the three bytes are of one text
            line[np.clip(near[near >= 2] - 2, 0, len(line) - 1)] = False
            first[2:-1] |= line
        first[[0, *ends]] = True
        at = np.flatnonzero(first)
        cut = at.tolist()
        return [data[a:b] for a, b in zip(cut, cut[1:], strict=False)], np.searchsorted(at, [0, *ends]).tolist()

    def encode(self, data: bytes, ends: list[int]) -> list[bytes]:
        """Ids of consecutive texts, as 32-bit integers; those that begin a piece have ``FIRST`` set.

        Equal fragments have equal ids wherever they stand, so each is encoded once, and remembered.
        """
        parts, places = self.fragments(data, ends)
        if len(self.known) > KNOWN:
            self.known = {}
        known, long = self.known, {}
        new = [p for p in dict.fromkeys(parts) if p not in known]
        spaced, others = [], []
        for p in new:
            if WORD.fullmatch(p.decode()):
                ids = [t.id for t in self.model.tokenize(p.decode("latin-1").translate(self.shown))]
                ids[0] |= FIRST
                (known if len(p) <= KNOWN_BYTES else long)[p] = np.array(ids, np.int32).tobytes()
            else:
                (spaced if p[0] == 32 and len(p) > 1 and SOLID_NEXT[p[1]] else others).append(p)
        for some, between in ((spaced, b""), (others, self.between)):
            for lo in range(0, len(some), 4096):
                group = some[lo : lo + 4096]
                for p, ids in zip(group, self.encode_new(group, between), strict=True):
                    (known if len(p) <= KNOWN_BYTES else long)[p] = ids
        if long:
            known = _Both(known, long)
        return [b"".join(map(known.__getitem__, parts[a:b])) for a, b in zip(places, places[1:], strict=False)]

    def encode_new(self, parts: list[bytes], between: bytes | None) -> list[bytes]:
        """Ids of fragments: encoded as one text, with ``between`` between them, or each by itself if that is None."""
        texts = [between.join(parts)] if between is not None else parts
        out = []
        for text, e in zip(texts, self.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False), strict=True):
            ids, word = np.array(e.ids, np.int32), np.array(e.word_ids, np.int32)
            sizes = np.array([len(p) for p in (parts if between is not None else [text])])
            end = np.cumsum(sizes + len(between or b"")) - len(between or b"")
            ends = np.cumsum(self.size[ids])
            last = np.searchsorted(ends, end) + 1
            begin = np.searchsorted(ends, end - sizes, side="right")
            ids[np.flatnonzero(np.r_[True, word[1:] != word[:-1]])] |= FIRST
            raw = ids.tobytes()
            out += [raw[4 * a : 4 * b] for a, b in zip(begin.tolist(), last.tolist(), strict=True)]
        return out

    def mend(self, piece: bytes, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Tokens of a piece that begins with the tokens ``left`` and ends with the tokens ``right`` of its sides."""
        sizes_left, sizes_right = np.r_[0, np.cumsum(self.size[left])], np.r_[0, np.cumsum(self.size[right])]
        n = 8
        while True:
            i, j = max(0, len(left) - n), min(len(right), n)
            own = self.merge(piece[sizes_left[i] : len(piece) - (sizes_right[-1] - sizes_right[j])])
            if (i == 0 or own[0] == left[i]) and (j == len(right) or own[-1] == right[j - 1]):
                return np.r_[left[:i], own, right[j:]].astype(np.int32)
            n *= 2

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of two texts put together, from the ids of each; ``FIRST`` marks pieces."""
        if not len(left) or not len(right):
            return np.r_[left, right].astype(np.int32)
        # only what lies near the join is looked at; in long pieces that is the piece
        ends, reach = (left & FIRST) > 0, self.margin
        head, tail = left & (FIRST - 1), right & (FIRST - 1)
        before = np.cumsum(self.size[head][::-1])[::-1]  # bytes from a token to the join
        after = np.r_[0, np.cumsum(self.size[tail])]
        begins = np.flatnonzero((right & FIRST) > 0)
        sure = np.flatnonzero(ends & (before >= reach))
        a = int(sure[-1]) if len(sure) else 0
        while True:
            far = begins[after[begins] >= 2 * reach]
            c = int(far[0]) if len(far) else len(right)
            text = self.text(head[a:]) + self.text(tail[:c])
            seam, whole = int(before[a]), c == len(right)
            pieces = self.cut(text)
            own = {b for b, _, _ in pieces if b >= seam and (whole or b <= len(text) - reach)}
            meet = [k for k in begins[: np.searchsorted(begins, c, "right")].tolist() if seam + int(after[k]) in own]
            if meet or whole:
                break
            reach *= 2
        q = meet[0] if meet else len(right)
        stop = seam + int(after[q])
        starts_left = {seam - int(before[k]): k for k in (np.flatnonzero(ends[a:]) + a).tolist()}
        starts_right = {seam + int(after[k]): k for k in begins.tolist() if k <= q} | {seam + int(after[-1]): len(right)}
        out = [left[:a]]
        for b, e, added in pieces:
            if b >= stop:
                break
            i, j = starts_left.get(b), starts_right.get(e)
            if added >= 0:
                ids = np.array([added], np.int32)
            else:
                l_ids = r_ids = head[:0]
                if i is not None:  # tokens of the left side's piece that lie within
                    end = i + 1
                    while end < len(left) and not ends[end]:
                        end += 1
                    l_ids = head[i:end][np.cumsum(self.size[head[i:end]]) <= e - b]
                if j is not None and j > 0:
                    begin = int(begins[begins < j][-1])
                    r_ids = tail[begin:j]
                    r_ids = r_ids[np.cumsum(self.size[r_ids][::-1])[::-1] <= e - max(b, seam)]
                ids = l_ids.copy() if e <= seam and len(l_ids) and int(self.size[l_ids].sum()) == e - b else self.mend(text[b:e], l_ids, r_ids)
            ids[0] |= FIRST
            out.append(ids)
        return np.concatenate([*out, right[q:]]).astype(np.int32)

    def tree(self, parts: list[np.ndarray]) -> np.ndarray:
        """Ids of consecutive parts put together, halves of halves first."""
        while len(parts) > 1:
            parts = [self.join(parts[k], parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0]


class _Both(dict):
    """Two dictionaries read as one."""

    def __init__(self, first: dict, second: dict) -> None:
        super().__init__(second)
        self.first = first

    def __missing__(self, key: bytes) -> bytes:
        return self.first[key]


def _alphabet() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next free one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, loaded once in a process."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def _lists(ids: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(b) // 4 for b in ids)], dtype=np.int64)
    flat = np.frombuffer(b"".join(ids), np.int32) & (FIRST - 1)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


def leaves(data: bytes, size: int) -> list[int]:
    """Where the parts of a text end: a power of two of parts, of equal size but for whole characters."""
    parts = 1
    while len(data) > parts * size:
        parts *= 2
    ends = []
    for k in range(1, parts + 1):
        end = len(data) * k // parts
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        ends.append(end)
    return ends


def encode_texts(df: DataFrame, path: str, text: str = "text", row_id: str = "doc_id", long: int = LONG, leaf: int = LEAF) -> DataFrame:
    """Per row of ``df``: its id and ids (array of int), as the tokenizers library encodes the text with the file at
    ``path``, without special tokens of its own, padding or truncation.

    The contents of added tokens in a text become these tokens, as the library has it. Null and empty texts have no
    tokens. Texts of more than ``long`` bytes are encoded in parts of about ``leaf`` bytes and joined exactly; a row
    that repeats is then encoded once. Ids may be null or repeat. Other columns are left out. ``path`` must be
    readable on every executor.
    """
    rows = df.select(F.col(row_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = df.schema[row_id].dataType.simpleString()
    size = F.octet_length("text")

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            for lo, hi, data, offs in chunks(text_rows(batch, "text")):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), _lists(own.encode(data.tobytes(), offs[1:].tolist()))], ["id", "ids"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for lo, hi, data, offs in chunks(text_rows(batch, "text")):
                for k in range(lo, hi):
                    whole = data[offs[k - lo] : offs[k - lo + 1]].tobytes()
                    ends = leaves(whole, leaf)
                    parts = [whole[a:b].decode() for a, b in zip([0, *ends], ends, strict=False)]
                    yield pa.RecordBatch.from_arrays([pa.array([keys[k]] * len(parts), pa.binary()), pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(parts, pa.string())], ["key", "part", "text"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            for lo, hi, data, offs in chunks(text_rows(batch, "text")):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(own.encode(data.tobytes(), offs[1:].tolist()), pa.binary())], ["key", "part", "marked"])

    def join(group: pa.Table) -> pa.Table:
        own = vocabulary(path)
        part = np.argsort(group.column("part").to_numpy())
        marked = [np.frombuffer(b, np.int32) for b in group.column("marked").to_pylist()]
        ids = own.tree([marked[k] for k in part.tolist()])
        return pa.table({"key": pa.array(group.column("key")[:1].to_pylist(), pa.binary()), "ids": _lists([ids.tobytes()])})

    few = rows.where(size <= long).mapInArrow(short, f"id {kind}, ids array<int>")
    some = rows.where(size > long).withColumn("key", row_key("id", "text"))
    some = some.groupBy("key").agg(F.first("id").alias("id"), F.first("text").alias("text"), F.count(F.lit(1)).alias("times"))
    parts = some.select("key", "text").mapInArrow(split, "key binary, part int, text string").repartition("key", "part")
    joined = parts.mapInArrow(encode, "key binary, part int, marked binary").groupBy("key").applyInArrow(join, "key binary, ids array<int>")
    many = joined.join(some.select("key", "id", "times"), "key").select("id", "ids", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")).drop("copy")
    return few.unionByName(many).withColumnRenamed("id", row_id)


def decode_tokens(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The rows of ``df`` and the text of their ids, as the library decodes them, special tokens included.

    Null ids give null, no ids an empty text; bytes that are no UTF-8 become U+FFFD. Ids must be of the vocabulary. A column named ``text`` is replaced.
    """
    columns = [c for c in df.columns if c.lower() != text.lower()]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    at = columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                out = [None if x is None else b"".join([own.bytes[i] for i in x]).decode("utf-8", "replace") for x in part.column(at).to_pylist()]
                out = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, out], [*columns, text])

    return df.select(*columns).mapInArrow(run, f"{schema}, `{text}` string")
