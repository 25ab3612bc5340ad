"""Languages of texts and of their segments, by string kernels.

The kernel of two segments is the number of character n-grams (of all orders in ``ORDERS``) that
occur in both, divided by the square root of the product of their own numbers: the blended
spectrum with presence instead of counts. Some training segments are Nyström landmarks; kernel
ridge regression, one class against the rest, is solved on them.

Scoring a batch is K W with K = X Z' scaled by the segments' norms, where X holds the presence of
hashed n-grams in the batch and Z in the landmarks. The product Z' W does not depend on the batch,
so it is formed once (a table of n-gram by class); a batch then needs the product of its sparse X
with that table and nothing else. The result is the same as with the kernel matrix written out.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rdfloom.functions.text import label_code  # noqa: F401 - part of this module's interface
from rdfloom.llm.phrases import REFUSALS, SEEDS
from rdfloom.llm.textvec import FOLD, KIND, LOWER, UPPER, chunks, codes_of, distinct, mix, word_spans

LANGUAGES = ("en", "es", "ca", "fr")
ORDERS = (2, 3, 4)
BUCKETS = 1 << 18
#: The fit uses at most so many segments of each language, and so many of them as landmarks.
SEGMENTS, LANDMARKS = 2_500, 400
#: So many segments of a text, drawn from all of it, are taken before further ones of any text.
TURN = 12
#: At most so many labelled rows of each language and table are drawn for the fit.
SAMPLE_ROWS = 250
#: A segment of so many words or more is of no known language if its best score is below all but this share of
#: held-out segments.
OTHER_WORDS, OTHER_SHARE = 4, 0.002
#: What such segments are labelled with.
OTHER = "und"
RIDGE = 0.3
#: A segment is running text with so many words. It is in another language than most of its text
#: with this confidence, if the text's own language gets at most the second value.
LEAST_WORDS, LEAST_CONFIDENCE, LEFT_CONFIDENCE = 2, 0.6, 0.04

_STRONG = np.zeros(len(KIND), bool)
_STRONG[[ord(c) for c in ".!?;\n\r|…"]] = True
_ALWAYS = np.zeros(len(KIND), bool)
_ALWAYS[[ord(c) for c in ";\n\r|"]] = True


@dataclass
class Segments:
    """Segments of a batch: the text each belongs to, its words, and its distinct n-grams as (segment, bucket)."""

    text: np.ndarray
    words: np.ndarray
    row: np.ndarray
    gram: np.ndarray
    size: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def segments(texts: list[str]) -> Segments:
    """Cuts texts at sentence ends, semicolons and line breaks, and takes the n-grams of each piece.

    Only letters count, without names; everything else is one blank. A mark ends a piece before white space only.
    """
    codes, starts = codes_of(texts)
    letter = KIND[codes] == 1
    letter |= codes == ord("·")
    following = np.append(codes[1:], np.uint32(10))
    blank_next = (following <= 32) | (following == 0xA0) | (following == ord('"'))
    cut = _ALWAYS[codes] | (_STRONG[codes] & blank_next)
    cut[starts[1:] - 1] = True
    piece = np.concatenate([[0], np.cumsum(cut)[:-1]])
    # names say nothing about the language: words in capital and small letters, but for one at the start
    # of a piece that no other such word follows
    begin, end = word_spans(letter)
    if len(begin):
        capital = (UPPER[codes[begin]] == 1) & (end - begin > 1) & (UPPER[codes[np.minimum(begin + 1, len(codes) - 1)]] == 0)
        at_start = np.concatenate([[True], piece[begin[1:]] != piece[begin[:-1]]])
        then_capital = np.concatenate([capital[1:] & ~at_start[1:], [False]])
        name = capital & (~at_start | then_capital)
        mark = np.zeros(len(codes) + 1, np.int32)
        np.add.at(mark, begin[name], 1)
        np.add.at(mark, end[name], -1)
        letter &= np.cumsum(mark[:-1]) == 0
    previous = np.concatenate([[True], (~letter[:-1]) | cut[:-1]])
    keep = letter | ~previous
    keep &= ~cut | ~previous
    at = np.flatnonzero(keep)
    symbols = np.where(letter[at] & ~cut[at], LOWER[codes[at]], np.uint32(32)).astype(np.uint64)
    own = piece[at]
    # a leading blank for each piece
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    symbols = np.insert(symbols, first, 32)
    own = np.insert(own, first, own[first]) if len(own) else own
    word_start = np.flatnonzero((symbols[:-1] == 32) & (symbols[1:] != 32) & (own[:-1] == own[1:])) if len(own) else np.zeros(0, np.int64)
    fresh = np.concatenate([[True], own[1:] != own[:-1]])[: len(own)]
    names, row = own[fresh], np.cumsum(fresh) - 1
    words = np.bincount(row[word_start], minlength=len(names))
    parts = []
    for n in ORDERS:
        if len(symbols) < n:
            continue
        h = symbols[: len(symbols) - n + 1] + np.uint64(n)
        for k in range(1, n):
            h = h * np.uint64(0x100000001B3) + symbols[k : len(symbols) - n + 1 + k]
        same = row[: len(symbols) - n + 1] == row[n - 1 :]
        parts.append((row[: len(symbols) - n + 1][same].astype(np.uint64) << np.uint64(18)) | (mix(h[same]) >> np.uint64(46)))
    keys = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    keys = distinct(keys.astype(np.uint32) if len(names) < 1 << 14 else keys).astype(np.uint64)
    piece_end = np.flatnonzero(cut)[names]
    piece_begin = np.concatenate([[0], np.flatnonzero(cut)[:-1] + 1])[names]
    gram_row = (keys >> np.uint64(18)).astype(np.int64)
    return Segments(
        np.searchsorted(starts, piece_begin, "right") - 1,
        words,
        gram_row,
        (keys & np.uint64(BUCKETS - 1)).astype(np.int64),
        np.bincount(gram_row, minlength=len(names)),
        piece_begin - starts[np.searchsorted(starts, piece_begin, "right") - 1],
        piece_end + 1 - starts[np.searchsorted(starts, piece_begin, "right") - 1],
    )


def _in_parts(texts: list[str]) -> Segments:
    """``segments`` of many texts, some at a time, so that the passes over their characters need little memory."""
    parts, rows = [], 0
    for begin, end in chunks(texts, 300_000):
        p = segments(texts[begin:end])
        parts.append(Segments(p.text + begin, p.words, (p.row + rows).astype(np.int32), p.gram.astype(np.int32), p.size, p.begin, p.end))
        rows += len(p.words)
    return Segments(*(np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(Segments)))


class Found(NamedTuple):
    """Languages with running text and their confidence, the text's own one, and each one's probability for the whole."""

    held: list[str]
    sure: list[float]
    own: str
    whole: dict[str, float]

    def may_be(self, language: str | None, least: float = 0.05) -> bool:
        """Whether the text holds the language, or is of one language and too short to rule it out."""
        return language in self.held or len(self.held) == 1 and self.whole.get(language or "", 0.0) >= least


class LanguageModel:
    """Kernel ridge classifier on Nyström landmarks, folded into a table of n-gram by class."""

    def __init__(self, table: np.ndarray, classes: tuple[str, ...], sharpness: float, floor: float = -np.inf) -> None:
        self.table, self.classes, self.sharpness, self.floor = table, classes, sharpness, floor

    @classmethod
    def fit(cls, texts: list[str], labels: list[str], seed: int = 11) -> LanguageModel:
        """From labelled texts; each is also taken without its accents and in capitals."""
        texts, labels = list(texts), list(labels)
        for language, seeds in SEEDS.items():
            texts += [seeds, " ".join(REFUSALS[language]).replace("{}", "")] * 2
            labels += [language] * 4
        plain = ["".join(map(chr, FOLD[codes_of([t])[0]])) for t in texts]
        found = _in_parts(texts + plain)
        classes = tuple(c for c in LANGUAGES if c in set(labels))
        own = np.array([classes.index(x) for x in labels] * 2)[found.text]
        order = np.random.default_rng(seed).permutation(len(own))
        order = order[found.words[order] >= LEAST_WORDS]
        # TURN segments of every text before further ones of any, so that long texts do not stand for all
        by_text = order[np.argsort(found.text[order], kind="stable")]
        start = np.concatenate([[True], found.text[by_text[1:]] != found.text[by_text[:-1]]]) if len(by_text) else np.zeros(0, bool)
        turn = np.arange(len(by_text)) - np.maximum.accumulate(np.where(start, np.arange(len(by_text)), 0))
        rank = np.empty(len(own), np.int64)
        rank[by_text] = turn
        order = order[np.argsort(rank[order] // TURN, kind="stable")]
        chosen = np.concatenate([order[own[order] == c][:SEGMENTS] for c in range(len(classes))])
        marks = np.concatenate([order[own[order] == c][:LANDMARKS] for c in range(len(classes))])
        held = np.random.default_rng(seed + 1).random(len(chosen)) < 0.15
        norm = 1 / np.sqrt(np.maximum(found.size, 1))
        place = np.full(len(own), -1)
        place[marks] = np.arange(len(marks))
        # the landmarks that hold each n-gram, one list after the other
        entry = np.flatnonzero(place[found.row] >= 0)
        entry = entry[np.argsort(found.gram[entry], kind="stable")]
        mark, gram = place[found.row[entry]], found.gram[entry]
        first = np.searchsorted(gram, np.arange(BUCKETS + 1))
        edges = np.searchsorted(found.row, np.arange(len(own) + 1))

        def kernel(rows: np.ndarray) -> np.ndarray:
            out = np.empty((len(rows), len(marks)), np.float32)
            for begin in range(0, len(rows), 100):
                part = rows[begin : begin + 100]
                size = edges[part + 1] - edges[part]
                g = found.gram[np.repeat(edges[part] - np.cumsum(size) + size, size) + np.arange(size.sum())]
                many = first[g + 1] - first[g]
                own_row = np.repeat(np.repeat(np.arange(len(part)), size), many)
                at = np.repeat(first[g] - np.cumsum(many) + many, many) + np.arange(many.sum())
                hit = np.bincount(own_row * len(marks) + mark[at], minlength=len(part) * len(marks)).reshape(len(part), -1)
                out[begin : begin + 100] = hit * norm[marks] * norm[part, None]
            return out

        k, y = kernel(chosen), np.where(own[chosen][:, None] == np.arange(len(classes)), 1.0, -1.0)
        middle = kernel(marks).astype(float)

        def solve(rows: np.ndarray) -> np.ndarray:
            left, right = RIDGE * middle + 1e-6 * np.eye(len(marks)), np.zeros((len(marks), len(classes)))
            at = np.flatnonzero(rows)
            for begin in range(0, len(at), 1_000):
                part = k[at[begin : begin + 1_000]].astype(float)
                left += part.T @ part
                right += part.T @ y[at[begin : begin + 1_000]]
            return np.linalg.solve(left, right)

        trial = k[held] @ solve(~held)
        sharpness, floor = 1.0, -np.inf
        if len(trial):
            enough = trial.max(1)[found.words[chosen[held]] >= OTHER_WORDS]
            floor = float(np.quantile(enough, OTHER_SHARE)) if len(enough) else -np.inf
            grid = [1, 2, 3, 4, 6, 8, 12]
            sharpness = min(grid, key=lambda s: -np.log(_softmax(trial * s)[np.arange(len(trial)), own[chosen][held]] + 1e-9).mean())
        weights = solve(np.ones(len(chosen), bool))
        table = np.zeros((BUCKETS, len(classes)), np.float32)
        for c in range(len(classes)):
            table[:, c] = np.bincount(gram, (norm[marks, None] * weights)[mark, c], minlength=BUCKETS)
        return cls(table, classes, float(sharpness), floor)

    def scores(self, found: Segments) -> np.ndarray:
        """Regression value of each segment and class."""
        out = np.stack([np.bincount(found.row, self.table[found.gram, c], minlength=len(found.size)) for c in range(len(self.classes))], 1)
        return out / np.sqrt(np.maximum(found.size, 1))[:, None]

    def confidence(self, found: Segments) -> np.ndarray:
        return _softmax(self.scores(found) * self.sharpness)

    def languages(self, texts: list[str]) -> list[Found]:
        """The languages of each text."""
        out: list[Found] = []
        for begin, end in chunks(texts, 300_000):
            found = segments(texts[begin:end])
            score = self.scores(found)
            sure = _softmax(score * self.sharpness)
            best, p = sure.argmax(1), sure.max(1)
            n = end - begin
            running = found.words >= LEAST_WORDS
            weight = np.sqrt(np.maximum(found.size, 1))
            total = np.stack([np.bincount(found.text, score[:, c] * weight, minlength=n) for c in range(score.shape[1])], 1)
            mass = np.sqrt(np.maximum(np.bincount(found.text, found.size, minlength=n), 1))
            whole = _softmax(total / mass[:, None] * self.sharpness)
            # the text's own language has most of its running text
            share = np.zeros((n, len(self.classes)))
            np.add.at(share, (found.text[running], best[running]), weight[running] * p[running])
            top = np.where(share.any(1), share.argmax(1), whole.argmax(1))
            own = top[found.text]
            other = running & (best != own) & (p >= LEAST_CONFIDENCE) & (sure[np.arange(len(own)), own] <= LEFT_CONFIDENCE)
            held = np.zeros((n, len(self.classes)))
            np.maximum.at(held, (found.text[other], best[other]), p[other])
            home = running & (best == own)
            np.maximum.at(held, (found.text[home], own[home]), p[home])
            held[np.arange(n), top] = np.maximum(held[np.arange(n), top], whole[np.arange(n), top])
            for i in range(n):
                mine = np.flatnonzero(held[i])
                out.append(
                    Found([self.classes[c] for c in mine], held[i, mine].tolist(), self.classes[top[i]], dict(zip(self.classes, whole[i].tolist(), strict=True)))
                )
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True)) if len(x) else x
    return e / e.sum(1, keepdims=True) if len(x) else x


def sample_labelled(frame: DataFrame, key: str, text: str, label: Column, rows: int = SAMPLE_ROWS) -> tuple[list[str], list[str]]:
    """At most ``rows`` texts of each language, whole, the ones whose key has the least hash.

    The labels are counted first; a bound on the hash then lets about twice as many rows of each language through to
    the driver, where those of least hash are taken. Nothing is sorted or shuffled but the counts.
    """
    known = frame.select(F.col(text).alias("t"), label.alias("l"), F.xxhash64(F.col(key).cast("string"), F.lit(7)).alias("h")).where(
        F.col("l").isin(*LANGUAGES) & (F.length("t") > 20)
    )
    counts = {r["l"]: r["n"] for r in known.groupBy("l").agg(F.count("*").alias("n")).collect()}
    below = F.lit(False)
    for code, n in counts.items():
        share = min(1.0, (2 * rows + 50) / n)
        below = below | ((F.col("l") == code) & (F.col("h") <= int(-(2**63) + share * (2**64 - 2**12))))
    found: list = []
    taken: dict[str, int] = {}
    for r in sorted(known.where(below).collect() if counts else [], key=lambda r: (r["h"], r["t"])):
        taken[r["l"]] = taken.get(r["l"], 0) + 1
        if taken[r["l"]] <= rows:
            found.append(r)
    return [r["t"] for r in found], [r["l"] for r in found]


def fit_sample(tables: list[tuple[DataFrame, str, str, Column]]) -> LanguageModel:
    """A model from bounded samples of labelled tables: (table, key column, text column, language)."""
    texts, labels = [], []
    for frame, key, text, label in tables:
        t, c = sample_labelled(frame, key, text, label)
        texts += t
        labels += c
    return LanguageModel.fit(texts, labels)
