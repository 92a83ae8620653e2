import numpy as np
import pyarrow as pa

from terrasift.llm.common import chunks, cut_words, spare, windows


def words_of(texts, max_bytes=1 << 19):
    out = [[] for _ in texts]
    hashes = [[] for _ in texts]
    for lo, _, data, offs in chunks(pa.array(texts, pa.string()), max_bytes):
        w = cut_words(data, offs)
        for s, e, r, h in zip(w.start, w.end, w.row, w.hash, strict=True):
            out[lo + r].append(data[s:e].tobytes().decode())
            hashes[lo + r].append(int(h))
    return out, hashes


def test_words_match_split():
    texts = ["a b\tc\n", None, "", "  ", "ä b c", "x" * 5000 + " y", "one", "\x0b\x0cq\r"]
    for size in (1, 7, 1 << 19):
        got, _ = words_of(texts, size)
        assert got == [[x.decode() for x in (t or "").encode().split()] for t in texts]


def test_hash_depends_on_the_word_alone():
    _, h = words_of(["ab cd ab", "zz ab", "abcd"])
    assert h[0][0] == h[0][2] == h[1][1]
    assert len({h[0][0], h[0][1], h[1][0], h[2][0]}) == 4


def test_windows_stay_within_rows():
    h = np.arange(1, 8, dtype=np.uint64)
    row = np.array([0, 0, 0, 1, 1, 1, 1])
    w, at = windows(h, row, 3)
    assert at.tolist() == [0, 3, 4] and len(set(w.tolist())) == 3
    assert len(windows(h[:2], row[:2], 3)[0]) == 0


def test_spare_names():
    assert spare("row_key", ["Row_Key", "_row_key"]) == "__row_key"
