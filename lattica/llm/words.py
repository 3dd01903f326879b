"""Words and shingles as 64-bit numbers, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_MEMO_LIMIT = 1 << 20


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO_LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * _ODD[3]
    x = (x ^ (x >> np.uint64(32))) * _ODD[4]
    return x ^ (x >> np.uint64(29))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows, in their order; of a shorter sequence, one hash of the whole (none for no words)."""
    if not len(h):
        return h
    n = min(k, len(h))
    x = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        x = mixed(x + h[i : len(h) - n + 1 + i] * _ODD[i % 8] + np.uint64(i))
    return x


def lower_words(text: str | bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z alone in lower case."""
    if text is None:
        return []
    return (text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")).lower().split()


def split_batch(texts, separator: str | None = None):
    """Words of an Arrow string array: (offsets of each text's words, index of each word, distinct words).

    Without ``separator`` words stand between ASCII white space; empty words are left in place.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    lists = pc.ascii_split_whitespace(texts) if separator is None else pc.split_pattern(texts, separator)
    coded = lists.flatten().dictionary_encode()
    offsets = np.asarray(lists.offsets)
    distinct = coded.dictionary
    # no word holds a blank: joined and split again, they become Python strings several times faster
    joined = pc.binary_join_element_wise(distinct, pa.scalar("", distinct.type), pa.scalar(" ", distinct.type))
    words = joined.buffers()[2].to_pybytes()[: pc.sum(pc.binary_length(joined)).as_py()].decode().split(" ")[:-1] if len(distinct) else []
    return offsets - offsets[0], np.asarray(coded.indices), words


def hashed_batch(texts) -> list[np.ndarray]:
    """For each text of an Arrow string array (null: no words) the 64-bit hashes of its words, A-Z alone in lower case."""
    import pyarrow.compute as pc

    offsets, index, words = split_batch(pc.fill_null(pc.ascii_lower(texts), ""))
    h = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in words), np.uint64, len(words))
    empty = np.fromiter((not w for w in words), bool, len(words))
    if empty.any():
        stay = ~empty[index]
        upto = np.concatenate([[0], np.cumsum(stay)])
        offsets, index = upto[offsets], index[stay]
    values = h[index] if len(index) else np.zeros(0, np.uint64)
    return [values[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
