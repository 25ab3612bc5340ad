"""Abusive, hateful and sexual language: FTRL-proximal logistic regression per kind.

Features of a sentence are hashed word n-grams (one to three words) and skip-grams (two words with
one or two between). Per-coordinate learning rates and L1 sparsity leave few weights that are not zero;
only those go to the executors. A document's score of a kind is that of its worst sentence.

The first model comes from training sentences (``abuse_seeds``) and raters' labels teach the rest. Labels
hold for whole documents and some are wrong. So of a document labelled with a kind the sentence is learned
that the model, or what it shares with other documents of the kind and not with plain ones, points at;
documents without such a sentence take no part. Sentences of plain documents are learned as plain unless
they look like a kind. Thresholds are calibrated on labelled documents held out from the fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rdfloom.llm import abuse_seeds as seeds
from rdfloom.llm.textvec import FOLD, KIND, chunks, codes_of, distinct, hash_runs, mix, word_spans

KINDS = ("abusive", "hateful", "sexual")
BITS = 20
#: At most so many labelled texts and so many others, all distinct and whole, take part in the fit.
LABELLED, BACKGROUND = 4_000, 1_000
#: Learning rate, its offset, L1 and L2 of FTRL-proximal.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.15, 0.3
EPOCHS, BATCH = 4, 128
#: Rows the learner errs on by less take no step in an epoch.
EASY = 0.05
#: The logit of a sentence without known features: few sentences are of any kind.
PRIOR = -3.0
#: Weight of a plain sentence.
PLAIN_WEIGHT = 1.0
#: The evidence of a sentence is the model's logit plus the logarithm of the likelihood ratio of how often its features
#: come in other documents of the kind, against plain ones. A labelled document's best sentence is learned for its label
#: from the evidence on that tells documents of the kind from plain ones best (by the difference of their shares, at
#: least this one), which some wrong labels on either side do not move. A document rated plain keeps back from learning
#: sentences for which the second part alone is beyond such a bound, a document without label those beyond the first,
#: and those that score so much.
LEAST_DIFFERENCE, UNSURE = 0.25, 0.5
#: Of the labelled documents with a feature that tells a kind, about this share has the kind as label; the others are wrong
#: labels and mentions.
TELLING = 0.75

#: Labelled documents are held out in so many parts for the thresholds, which lie in this range and are the
#: middle one where fewer than the last number of held-out documents have the kind.
FOLDS, LOW, MIDDLE, HIGH, FEW = 3, 0.35, 0.5, 0.8, 10

_LEET = {ord(a): ord(b) for a, b in zip("@$013457!", "asoieasti", strict=True)}


@dataclass
class Sentences:
    """n-grams of a batch: bucket, and the sentence and the line each lies in (-1 where it crosses lines)."""

    bucket: np.ndarray
    sentence: np.ndarray
    line: np.ndarray
    sentence_text: np.ndarray
    line_text: np.ndarray
    sentence_first: np.ndarray
    words: np.ndarray


def _plain(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, text starts and word marks, with spaced-out and starred words put together again."""
    codes, starts = codes_of(texts)
    kind = KIND[codes]
    word = kind > 0
    # f-o-u-r: a mark between single letters
    letter = np.concatenate([[False, False], word, [False, False]])
    single_before = letter[1:-3] & ~letter[:-4]
    single_after = letter[3:-1] & ~letter[4:]
    sign = (codes == ord("-")) | (codes == ord(".")) | (codes == ord("*")) | (codes == ord("_")) | (codes == ord("·"))
    glue = sign & single_before & single_after
    if glue.any():
        # only where at least two such marks follow each other
        at = np.flatnonzero(glue)
        near = np.zeros(len(at), bool)
        close = np.diff(at) == 2
        near[1:] |= close
        near[:-1] |= close
        keep = np.ones(len(codes), bool)
        keep[at[near]] = False
        gone = np.concatenate([[0], np.cumsum(~keep)])
        codes, starts = codes[keep], starts - gone[starts]
        word = KIND[codes] > 0
    folded = FOLD[codes]
    # a letter three times or more in a row counts once
    same = np.concatenate([[False], (folded[1:] == folded[:-1]) & word[1:] & (KIND[codes[1:]] == 1)])
    third = same & np.concatenate([[False], same[:-1]])
    if third.any():
        drop = third | (same & np.append(third[1:], False))
        gone = np.concatenate([[0], np.cumsum(drop)])
        codes, folded, word, starts = codes[~drop], folded[~drop], word[~drop], starts - gone[starts]
    # stars after a letter hide letters
    star = codes == ord("*")
    if star.any():
        begin = star & np.concatenate([[False], word[:-1] & (KIND[codes[:-1]] == 1)])
        run = np.flatnonzero(begin)
        for r in run:
            e = r
            while e < len(codes) and codes[e] == ord("*"):
                e += 1
            if e - r >= 2 or e < len(codes) and word[e]:
                word[r:e] = True
    # digits and signs inside words stand for letters
    for a, b in _LEET.items():
        hit = codes == a
        if hit.any():
            left = np.concatenate([[False], KIND[codes[:-1]] == 1])
            right = np.concatenate([KIND[codes[1:]] == 1, [False]])
            use = hit & left & right
            folded = np.where(use, np.uint32(b), folded)
            word |= use
    return np.where(word, folded, codes), starts, word


def sentences(texts: list[str]) -> Sentences:
    codes, starts, word = _plain(texts)
    begin, end = word_spans(word)
    h = hash_runs(codes, begin, end)
    blank = np.append(codes[1:] <= 32, True)
    stop = ((codes == ord(".")) | (codes == ord("!")) | (codes == ord("?")) | (codes == ord("…"))) & blank & ~word
    newline = codes == 10
    empty_line = newline & np.concatenate([[False], newline[:-1]])
    last = np.zeros(len(codes), bool)
    last[starts[1:] - 1] = True
    sentence = np.cumsum(np.concatenate([[0], (stop | empty_line | last)[:-1]]))
    line = np.cumsum(np.concatenate([[0], (stop | newline)[:-1]]))
    s, ln = sentence[begin], line[begin]
    # dense numbers
    s_new = np.concatenate([[True], s[1:] != s[:-1]])[: len(s)]
    l_new = np.concatenate([[True], ln[1:] != ln[:-1]])[: len(ln)]
    text = np.searchsorted(starts, begin, "right") - 1
    sentence_text, line_text = text[s_new], text[l_new]
    s, ln = np.cumsum(s_new) - 1, np.cumsum(l_new) - 1
    buckets, s_of, l_of = [], [], []
    n = len(h)
    for offsets, salt in (((0,), 1), ((0, 1), 2), ((0, 1, 2), 3), ((0, 2), 4), ((0, 3), 5)):
        reach = offsets[-1]
        if n <= reach:
            continue
        acc = h[: n - reach] + np.uint64(salt)
        for o in offsets[1:]:
            acc = mix(acc) + h[o : n - reach + o]
        acc = mix(acc) >> np.uint64(64 - BITS)
        inside = s[: n - reach] == s[reach:]
        buckets.append(acc[inside].astype(np.int64))
        s_of.append(s[: n - reach][inside])
        l_of.append(np.where(ln[: n - reach] == ln[reach:], ln[: n - reach], -1)[inside])
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return Sentences(cat(buckets), cat(s_of), cat(l_of), sentence_text, line_text, begin[s_new], h)


def _rows(found: Sentences) -> list[np.ndarray]:
    """Distinct buckets of each sentence."""
    keys = distinct((found.sentence.astype(np.uint64) << np.uint64(BITS)) | found.bucket.astype(np.uint64))
    edges = np.searchsorted(keys >> np.uint64(BITS), np.arange(len(found.sentence_text) + 1).astype(np.uint64))
    b = (keys & np.uint64((1 << BITS) - 1)).astype(np.int32)
    return [b[edges[i] : edges[i + 1]] for i in range(len(edges) - 1)]


class Rows:
    """Distinct features of many sentences, one after the other."""

    def __init__(self, rows: list[np.ndarray]) -> None:
        self.size = np.array([len(r) for r in rows], np.int64)
        self.flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features of the chosen rows, and the place of each one's row among them."""
        size = self.size[which]
        own = np.repeat(np.arange(len(which)), size)
        return self.flat[np.repeat(self.first[which] - np.cumsum(size) + size, size) + np.arange(size.sum())], own


class Ftrl:
    """FTRL-proximal logistic regression with one output per kind, learned in small batches."""

    def __init__(self, width: int) -> None:
        self.z = np.zeros((width, len(KINDS)), np.float32)
        self.n = np.zeros((width, len(KINDS)), np.float32)
        self.bias_z, self.bias_n = np.zeros(len(KINDS)), np.zeros(len(KINDS))

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def bias(self) -> np.ndarray:
        return PRIOR - self.bias_z / ((BETA + np.sqrt(self.bias_n)) / ALPHA)

    def learn(self, flat: np.ndarray, own: np.ndarray, y: np.ndarray, importance: np.ndarray) -> None:
        names, back = np.unique(flat, return_inverse=True)
        w, b = self.weights(names), self.bias()
        each = w[back]
        total = np.stack([np.bincount(own, each[:, k], minlength=len(y)) for k in range(len(KINDS))], 1)
        error = (1 / (1 + np.exp(-np.clip(total + b, -35, 35))) - y) * importance[:, None]
        g = np.stack([np.bincount(back, error[own, k], minlength=len(names)) for k in range(len(KINDS))], 1)
        n = self.n[names]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        self.z[names] += g - sigma * w
        self.n[names] += g * g
        e = error.sum(0)
        sigma = (np.sqrt(self.bias_n + e * e) - np.sqrt(self.bias_n)) / ALPHA
        self.bias_z += e - sigma * (b - PRIOR)
        self.bias_n += e * e

    def copy(self) -> Ftrl:
        out = Ftrl(0)
        out.z, out.n, out.bias_z, out.bias_n = self.z.copy(), self.n.copy(), self.bias_z.copy(), self.bias_n.copy()
        return out


def seed_sentences(rng: np.random.Generator, copies: int = 6, frames: dict | None = None, neutral: dict | None = None) -> tuple[list[str], list[int]]:
    """Training sentences with their slots filled, some of them masked, capitalised or spelled out; kind -1 is none."""
    texts, kinds = [], []

    def fill(frame: str, language: str) -> str:
        for slot, words in seeds.SLOTS[language].items():
            choice = words.split("|")
            while "{" + slot + "}" in frame:
                frame = frame.replace("{" + slot + "}", choice[rng.integers(len(choice))], 1)
        return frame[0].upper() + frame[1:]

    def disguise(text: str) -> str:
        style = rng.integers(8)
        if style > 1:
            return text
        words = text.split()
        long = [i for i, w in enumerate(words) if len(w) > 3]
        if not long:
            return text
        i = long[rng.integers(len(long))]
        words[i] = words[i][0] + "*" * (len(words[i].rstrip(".,")) - 1) if style else "-".join(words[i])
        return " ".join(words)

    for kind, by_language in (frames or seeds.POSITIVE).items():
        for language, known in by_language.items():
            for frame in known:
                for _ in range(copies if "{" in frame else 4):
                    texts.append(disguise(fill(frame, language)))
                    kinds.append(KINDS.index(kind))
    for language, known in (neutral or seeds.NEUTRAL).items():
        for frame in known:
            for _ in range(2 * copies if "{" in frame else 4):
                texts.append(fill(frame, language))
                kinds.append(-1)
    return texts, kinds


class AbuseModel:
    """The weights that are not zero, one column a kind, and a threshold each."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, bias: np.ndarray, thresholds: np.ndarray) -> None:
        self.buckets, self.weights, self.bias, self.thresholds = buckets, weights, bias, thresholds
        self._table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None}

    def table(self) -> np.ndarray:
        """All buckets' weights, laid out where they are used."""
        if self._table is None:
            self._table = np.zeros((len(KINDS), 1 << BITS), np.float32)
            self._table[:, self.buckets] = self.weights.T
        return self._table

    @classmethod
    def fit(cls, labelled: list[tuple[str, list[list[str]]]], seed: int = 3, frames: dict | None = None, neutral: dict | None = None) -> AbuseModel:
        """labelled: (text, labels, one list for each rater); an empty list of raters stands for a text without label."""
        rng = np.random.default_rng(seed)
        texts, kinds = seed_sentences(rng, frames=frames, neutral=neutral)
        cut = sentences(texts)
        seed_rows = _rows(cut)
        seed_y = np.zeros((len(seed_rows), len(KINDS)))
        known = np.array(kinds)[cut.sentence_text]
        seed_y[known >= 0, known[known >= 0]] = 1
        bag_parts, doc_rows = [np.zeros(0, np.int64)], []
        whole = [t for t, _ in labelled]
        for low, high in chunks(whole, 300_000):  # the passes over characters need little memory
            found = sentences(whole[low:high])
            bag_parts.append(found.sentence_text + low)
            doc_rows += _rows(found)
        bags = np.concatenate(bag_parts)
        # how many raters say so, and whether any does; raters who disagree make half a label
        share = np.array([[sum(k in rater for rater in raters) / max(1, len(raters)) for k in KINDS] for _, raters in labelled]).reshape(-1, len(KINDS))
        plain = np.array([all(set(rater) <= {"none"} for rater in raters) for _, raters in labelled], bool)
        rows = Rows(seed_rows + doc_rows)
        names, dense = np.unique(rows.flat, return_inverse=True)
        rows.flat = dense
        rated = np.array([bool(raters) for _, raters in labelled], bool)
        fit = _Fit(rows, len(names), seed_y, bags, share, plain, rated, rng)
        everything = np.ones(len(labelled), bool)
        learner, held = fit.run(everything), np.zeros((len(labelled), len(KINDS)))
        thresholds = np.full(len(KINDS), MIDDLE)
        if len(labelled):
            part = rng.integers(FOLDS, size=len(labelled))
            for f in range(FOLDS if ((share > 0).sum(0) >= FEW).any() else 0):
                held[part == f] = fit.documents(fit.run(part != f))[part == f]
            thresholds = np.array([_threshold(held[rated, k], share[rated, k]) if (share[:, k] > 0).sum() >= FEW else MIDDLE for k in range(len(KINDS))])
        weights = learner.weights(slice(None)).astype(np.float32)
        kept = weights.any(1)
        return cls(names[kept], weights[kept], learner.bias(), thresholds)

    def scores(self, texts: list[str]) -> np.ndarray:
        """The probability of each kind in the worst sentence of each text; 0 where there are no words."""
        out = np.zeros((len(texts), len(KINDS)))
        table = self.table()
        for low, high in chunks(texts):
            found = sentences(texts[low:high])
            for k in range(len(KINDS)):
                w = table[k][found.bucket]
                for part, text in ((found.sentence, found.sentence_text), (found.line, found.line_text)):
                    if not len(text):
                        continue
                    inside = part >= 0
                    total = np.bincount(part[inside], w[inside], minlength=len(text))
                    np.maximum.at(out[low:high, k], text, 1 / (1 + np.exp(-np.clip(total + self.bias[k], -35, 35))))
        return out


class _Fit:
    """Learning from training sentences and labelled documents; rows of the latter follow those of the former."""

    def __init__(self, rows: Rows, width: int, seed_y: np.ndarray, bags: np.ndarray, share: np.ndarray, plain: np.ndarray, rated: np.ndarray, rng: np.random.Generator) -> None:
        self.rows, self.width, self.seed_y, self.bags, self.share, self.plain, self.rated, self.rng = rows, width, seed_y, bags, share, plain, rated, rng
        self.base = len(seed_y)
        # one sentence that many documents hold is one row to learn
        content = np.array([int.from_bytes(blake2b(rows.flat[a:b].tobytes(), digest_size=7).digest()) for a, b in zip(rows.first[self.base : -1], rows.first[self.base + 1 :], strict=True)], np.int64)
        _, self.same = np.unique(content, return_inverse=True)
        self.flat, self.own = rows.take(np.arange(self.base, len(rows.size)))
        key = distinct(bags[self.own].astype(np.uint64) * np.uint64(width) + self.flat.astype(np.uint64))
        self.pair_bag, self.pair_feature = (key // np.uint64(width)).astype(np.int64), (key % np.uint64(width)).astype(np.int64)
        self.first = self.train(Ftrl(width), np.arange(self.base), seed_y, np.ones(self.base))

    def train(self, learner: Ftrl, at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Ftrl:
        for _ in range(EPOCHS):
            error = np.abs(self.predict(learner, at) - y).max(1)
            order = self.rng.permutation(np.flatnonzero(error >= EASY))
            for begin in range(0, len(order), BATCH):
                part = order[begin : begin + BATCH]
                learner.learn(*self.rows.take(at[part]), y[part], weight[part])
        return learner

    def predict(self, learner: Ftrl, at: np.ndarray) -> np.ndarray:
        flat, own = self.rows.take(at)
        w = learner.weights(slice(None))
        total = np.stack([np.bincount(own, w[flat, k], minlength=len(at)) for k in range(len(KINDS))], 1) + learner.bias()
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))

    def probability(self, learner: Ftrl) -> np.ndarray:
        """Of every sentence of the labelled documents."""
        return self.predict(learner, np.arange(self.base, len(self.rows.size)))

    def documents(self, learner: Ftrl) -> np.ndarray:
        out = np.zeros((len(self.share), len(KINDS)))
        np.maximum.at(out, self.bags, self.probability(learner))
        return out

    def support(self, used: np.ndarray) -> np.ndarray:
        """Of every sentence and kind: the mean of its three best features' logarithmic likelihood ratios, the own document aside.

        A feature's is the lesser of two: how much more often documents of the kind have it than plain ones, and how much
        likelier the labels of the documents with it are if it tells the kind than if it is as mixed as all documents.
        """
        flat, own, b, f = self.flat, self.own, self.pair_bag, self.pair_feature
        bag, first = self.bags[own], self.rows.first[self.base : -1] - self.rows.first[self.base]
        calm = self.plain & used
        less = np.bincount(f, calm[b], minlength=self.width)[flat]
        out = np.zeros((len(self.bags), len(KINDS)))
        for k in range(len(KINDS)):
            mine = (self.share[:, k] > 0) & used
            often = np.bincount(f, mine[b], minlength=self.width)[flat] - mine[bag]
            at = np.flatnonzero(often > 0)
            expected = (less[at] + 0.5) / (calm.sum() + 1) * max(1, mine.sum() - 1)
            ratio = often[at] * np.log(often[at] / expected) - (often[at] - expected)
            # what only comes more often with the kind has other labels in most documents; those without label say nothing
            other = self.rated & used & ~mine
            against = np.bincount(f, other[b], minlength=self.width)[flat] - other[bag]
            usual = (mine.sum() + 1) / (mine.sum() + other.sum() + 2)
            telling = max(TELLING, (1 + usual) / 2)
            mostly = often[at] * np.log(telling / usual) + against[at] * np.log((1 - telling) / (1 - usual))
            rate = np.zeros(len(flat))
            rate[at] = np.where(often[at] > expected, np.maximum(np.minimum(ratio, mostly), 0.0), 0.0)
            for _ in range(3):  # the best, the second and the third
                top = np.maximum.reduceat(rate, first)
                out[:, k] += top / 3
                hit = np.flatnonzero((rate > 0) & (rate == top[own]))
                rate[hit[np.concatenate([[True], own[hit[1:]] != own[hit[:-1]]])] if len(hit) else hit] = 0.0
        return out

    def settled(self, used: np.ndarray) -> np.ndarray:
        """Whether a sentence and kind are settled as plain: several documents with the sentence are rated plain, and fewer are of the kind."""
        _, one = np.unique(self.bags * (self.same.max(initial=0) + 1) + self.same, return_index=True)
        same, bag = self.same[one], self.bags[one]
        calm = np.bincount(same, (self.plain & self.rated & used)[bag])
        mine = np.stack([np.bincount(same, ((self.share[:, k] > 0) & used)[bag]) for k in range(len(KINDS))], 1)
        return ((calm >= 2)[:, None] & (calm[:, None] > mine))[self.same]

    def bounds(self, value: np.ndarray, used: np.ndarray) -> np.ndarray:
        """The value of each kind from which on the best sentences are of the kind; a sentence of many plain documents counts in one."""
        once = np.unique(self.same, return_index=True)[1]
        best, plain = (np.full((len(self.share), len(KINDS)), -np.inf) for _ in range(2))
        np.maximum.at(best, self.bags, value)
        np.maximum.at(plain, self.bags[once], value[once])
        calm = self.plain & used & np.isfinite(plain[:, 0])
        out = np.full(len(KINDS), np.inf)
        for k in range(len(KINDS)):
            mine = np.sort(best[(self.share[:, k] > 0) & used, k])
            others = np.sort(plain[calm, k])
            if not len(mine):
                continue
            every = np.unique(np.concatenate([mine, others]))
            difference = (len(mine) - np.searchsorted(mine, every)) / len(mine) - (len(others) - np.searchsorted(others, every)) / max(1, len(others))
            at = int(difference.argmax())
            if difference[at] >= LEAST_DIFFERENCE:
                # the middle of the gap below the best bound
                out[k] = (every[at] + every[max(0, at - 1)]) / 2
        return out

    def run(self, used: np.ndarray, rounds: int = 2) -> Ftrl:
        """A model from the training sentences and the documents used."""
        ones, learner = np.ones(self.base), self.first
        if not len(self.bags):
            return learner
        support, settled = self.support(used), self.settled(used)
        calm = np.flatnonzero((self.plain & used)[self.bags])
        calm = calm[np.unique(self.same[calm], return_index=True)[1]]
        for _ in range(rounds):
            p = self.probability(learner)
            value = np.log(p + 1e-9) - np.log(1 - p + 1e-9) + support
            least, own_least = np.maximum(self.bounds(value, used), 0.0), self.bounds(support, used)
            at, y, weight = [np.arange(self.base)], [self.seed_y], [ones]
            plain = calm[np.where(self.rated[self.bags[calm], None], (support[calm] <= own_least) | settled[calm], (value[calm] <= least) & (p[calm] < UNSURE)).all(1)]
            at.append(self.base + plain)
            y.append(np.zeros((len(plain), len(KINDS))))
            weight.append(np.full(len(plain), PLAIN_WEIGHT))
            for k in range(len(KINDS)):
                inside = np.flatnonzero(((self.share[:, k] > 0) & used)[self.bags] & ~settled[:, k])
                if not len(inside):
                    continue
                order = inside[np.lexsort((-value[inside, k], self.bags[inside]))]
                best = order[np.concatenate([[True], self.bags[order[1:]] != self.bags[order[:-1]]])]
                best = best[value[best, k] > least[k]]
                at.append(self.base + best)
                y.append(np.eye(len(KINDS))[np.full(len(best), k)])
                weight.append(0.5 + 0.5 * self.share[self.bags[best], k])
            learner = self.train(self.first.copy(), np.concatenate(at), np.concatenate(y), np.concatenate(weight))
        return learner


def _threshold(p: np.ndarray, share: np.ndarray) -> float:
    """The threshold of best F1 on held-out documents; the middle of those that are equally good."""
    grid = np.linspace(LOW, HIGH, 19)
    f1 = np.array([2 * share[p >= t].sum() / max(1e-9, (p >= t).sum() + share.sum()) for t in grid])
    return float(np.median(grid[f1 >= f1.max() - 1e-9]))


def fit_sample(documents: DataFrame, labels: DataFrame) -> AbuseModel:
    """A model from raters' labels of at most LABELLED texts, and at most BACKGROUND others, those of least hash, all whole.

    Documents with the same text are one text with all their labels, so copies take no place of another text.
    """
    by_rater = (
        labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
        .select("doc_id", F.coalesce(F.col("rater"), F.lit("")).alias("rater"), F.lower(F.trim("label")).alias("label"))
        .distinct()
    )
    texts = documents.where(F.length("text") > 0).select("doc_id", "text", F.xxhash64("text", F.lit(9)).alias("h"))
    said = texts.select("doc_id", "h").join(by_rater, "doc_id").groupBy("h").agg(F.collect_set(F.struct("rater", "label")).alias("said"))
    raters: dict[int, list[list[str]]] = {}
    for r in said.orderBy("h").limit(LABELLED).collect():
        by: dict[str, set[str]] = {}
        for s in r["said"]:
            by.setdefault(s["rater"], set()).add(s["label"])
        raters[r["h"]] = [sorted(by[k]) for k in sorted(by)]
    for r in texts.select("h").distinct().orderBy("h").limit(BACKGROUND).collect():
        raters.setdefault(r["h"], [])
    drawn = texts.where(F.col("h").isin(list(raters))).groupBy("h").agg(F.min("text").alias("text")).collect() if raters else []
    return AbuseModel.fit([(r["text"], raters[r["h"]]) for r in sorted(drawn, key=lambda r: r["h"])])


def score_documents(documents: DataFrame, model: AbuseModel, *keep: str) -> DataFrame:
    """(doc_id, the columns to keep, abusive, hateful, sexual): a score per kind for every document.

    NULL and empty texts score 0; rows without an id are left out.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", *keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            score = known.scores(batch["text"].tolist())
            out = batch[names].copy()
            for k, kind in enumerate(KINDS):
                out[kind] = score[:, k]
            yield out

    chosen = documents.where(F.col("doc_id").isNotNull()).select(*names, F.coalesce("text", F.lit("")).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.select(*names).schema) + "".join(f", {k} double" for k in KINDS)
    return chosen.mapInPandas(run, schema)


def kinds_found(scores: DataFrame, model: AbuseModel) -> DataFrame:
    """(doc_id, kind) wherever a score reaches the kind's threshold."""
    flags = F.array(*[F.when(F.col(k) >= float(t), F.lit(k)) for k, t in zip(KINDS, model.thresholds, strict=True)])
    return scores.select("doc_id", F.explode(F.array_compact(flags)).alias("kind")).dropDuplicates(["doc_id", "kind"])


def source_rates(scores: DataFrame, model: AbuseModel) -> DataFrame:
    """(source, documents, and of each kind the number and the rate): rows with a NULL source form one group."""
    flag = {k: (F.col(k) >= float(t)).cast("int") for k, t in zip(KINDS, model.thresholds, strict=True)}
    counts = scores.dropDuplicates(["doc_id"]).groupBy("source").agg(F.count("*").alias("documents"), *[F.sum(flag[k]).alias(f"{k}_documents") for k in KINDS])
    return counts.select("*", *[(F.col(f"{k}_documents") / F.col("documents")).alias(f"{k}_rate") for k in KINDS])
