"""Text as arrays: code points, words and n-gram hashes of a whole batch at once.

Every operator that needs Python in the executors gets Arrow batches and works on the
concatenated code points of many texts with NumPy, so the cost is a few array passes and
not a loop over words. Hashes are the same on every machine and in every run.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np

TOP = 0x3000
#: Odd 64-bit multipliers of the mixing steps.
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
LONGEST = 64


def _tables() -> tuple[np.ndarray, ...]:
    fold, kind, cased = np.arange(TOP + 1, dtype=np.uint32), np.zeros(TOP + 1, np.uint8), np.zeros(TOP + 1, np.uint8)
    lower = fold.copy()
    for i in range(TOP):
        c = chr(i)
        low = c.lower()[0]
        base = unicodedata.normalize("NFD", low)[0]
        fold[i], lower[i] = ord(base), ord(low)
        kind[i] = 1 if c.isalpha() else 2 if c.isdecimal() else 0
        cased[i] = c.isupper()
    kind[TOP] = 1
    return fold, kind, cased, lower


FOLD, KIND, UPPER, LOWER = _tables()
POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(LONGEST - 1, B)]), dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finishes 64-bit hashes so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * A
    h ^= h >> np.uint64(29)
    h = h * B
    return h ^ (h >> np.uint64(32))


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by one line break, and the start of each text (and the end)."""
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    if ((codes >= 0x300) & (codes < 0x370)).any():  # decomposed accents
        texts = [unicodedata.normalize("NFC", t) for t in texts]
        codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))])
    return np.minimum(codes, np.uint32(TOP)), starts


def word_spans(is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], is_word.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def hash_runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of values; runs are not empty and do not overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    inside = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    place = (inside - np.repeat(starts, lengths)) % LONGEST
    terms = (values[inside].astype(np.uint64) + np.uint64(1)) * POWERS[place]
    return mix(np.add.reduceat(terms, np.concatenate([[0], np.cumsum(lengths)[:-1]])) + lengths.astype(np.uint64) * A)


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting beats hashing for integer keys."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


class Words:
    """Words of a batch: runs of letters and digits, without case and accents."""

    def __init__(self, texts: list[str]) -> None:
        self.codes, self.text_starts = codes_of(texts)
        self.kind = KIND[self.codes]
        self.starts, self.ends = word_spans(self.kind > 0)
        self.hash = hash_runs(FOLD[self.codes], self.starts, self.ends)
        self.text = np.searchsorted(self.text_starts, self.starts, "right") - 1
        self.first = np.searchsorted(self.starts, self.text_starts)


def hash_word(word: str) -> int:
    """The hash Words gives a single word."""
    return int(Words([word]).hash[0])


def ngrams(h: np.ndarray, group: np.ndarray, n: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams within groups, and the index of each one's first element."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = h[: len(h) - n + 1] + np.uint64(salt)
    for k in range(1, n):
        acc = mix(acc) + h[k : len(h) - n + 1 + k]
    inside = np.flatnonzero(group[: len(h) - n + 1] == group[n - 1 :])
    return mix(acc[inside]), inside


def chunks(texts: list[str], limit: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters; a longer text is a range of its own."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)
