"""Sentences of rough translations that render each other: a hidden Markov model per document pair.

Sentences are cut into clauses. The target clauses are emissions; a state is a span of one to ``SPANS``
neighbouring source clauses (so merges need no cut), or null. A clause's words come from the words of
the state through a lexicon (Model 1 style), or from the background; null draws what the second-best
clause explains too, so that names common to several clauses prove nothing. Transitions are jumps with
a preference for the next clause, and may go anywhere (reordering) or to null (additions). What a
decoding leaves over on both sides is decoded once more as a pair of its own, where names that only the
paired clauses had in common prove something.

Of a document of more than ``BEAM`` source clauses each target clause has as states those that explain it
best and a band around the diagonal, so memory grows with the length and not with its square. Emissions
are still computed for all of them.

The lexicon is learned from all distinct pairs by alternating alignment and counting, both in the
executors; what is aligned is counted once by its words that differ, and expectation steps run on these
counts. The driver holds word frequencies and translations, which are bounded by shares.

Batches of pairs are padded and decoded together; words are hashed, and all sums are array passes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rdfloom.llm.textvec import Words, mix
from rdfloom.session import cut

ROUNDS = 3
#: Expectation steps of Model 1 in each round.
STEPS = 5
#: Words of at least this share have their own frequency, hence at most 1 / LEAST_SHARE; others have this one.
LEAST_SHARE = 1e-6
#: Translations below this probability count as this probability in the next expectation step.
PRUNED = 0.003
#: So many translations a model has at most, those of the largest expected count.
TRANSLATIONS = 2_000_000
BACKGROUND = 0.12
NULL, STAY, NEXT, SKIP, BACK = 0.1, 0.015, 0.55, 0.12, 0.06
IDENTITY = 0.85
#: A state must explain a clause better than null by this much (natural logarithm).
LEAST_GAIN = 1.5
#: So much where clause and state have no word (a name, a number) in common as it is.
STRONG_GAIN = 6.0
#: A state that explains this share of a clause needs no gain over null, which Viterbi handicaps by SPARE.
EXPLAINED, SPARE = 0.6, 1.5
#: Cells of word by clause that are held at once.
CELLS = 3_000_000
#: Source clauses a state may span, and what each further one has to add to it (natural logarithm), within a
#: sentence and across two.
SPANS = 4
SPAN = (4.0, 12.0)
#: States of one length that a target clause has at most, and how many of them lie around the diagonal.
BEAM, BAND = 128, 32
PAIRS_AT_ONCE = 300
_SENTENCE = re.compile(r"\S.*?[.!?](?=\s|$)|\S.*$", re.S)
_CLAUSE = re.compile(
    r";\s+|,?\s+(?:and furthermore|and|while|whereas|y además|y|mientras que|i a més|i|mentre que|et de plus|et|tandis que)\s+(?=\S+(?:\s+\S+){3})", re.I
)


def clauses(text: str) -> tuple[list[str], list[int]]:
    """The clauses of a text and the number of the sentence each is in, from 1."""
    out: list[str] = []
    number: list[int] = []
    for i, found in enumerate(_SENTENCE.finditer(text), 1):
        for part in _CLAUSE.split(found.group()):
            if part.strip():
                out.append(part)
                number.append(i)
    return out, number


class Lexicon:
    """Translations of hashed words: for each source word the target words and their probability."""

    def __init__(self, source: np.ndarray, target: np.ndarray, probability: np.ndarray, background: tuple[np.ndarray, np.ndarray], rare: float = 2e-5) -> None:
        order = np.argsort(source, kind="stable")
        self.words, first = np.unique(source[order], return_index=True)
        self.first = np.append(first, len(order))
        self.target, self.probability = target[order], probability[order]
        self.known, self.frequency = background
        self.rare = rare

    def expand(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the source word, target word, probability), identity included."""
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            hit = self.words[at] == h
            count = np.where(hit, self.first[at + 1] - self.first[at], 0)
        else:
            at, count = np.zeros(len(h), int), np.zeros(len(h), int)
        own = np.repeat(np.arange(len(h)), count)
        pick = np.repeat(self.first[at], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return (
            np.concatenate([np.arange(len(h)), own]),
            np.concatenate([h, self.target[pick]]),
            np.concatenate([np.full(len(h), IDENTITY), self.probability[pick]]),
        )

    def chance(self, h: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(h), 1e-4)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.where(self.known[at] == h, self.frequency[at], self.rare)


Clauses = tuple[list[str], list[int]]


class Batch:
    """Pairs of texts, cut into clauses, as hashed words by clause."""

    def __init__(self, source: list[Clauses], target: list[Clauses]) -> None:
        self.size = len(source)
        self.source, self.target = source, target
        self.n = np.array([len(c) for c, _ in source], int)
        self.m = np.array([len(c) for c, _ in target], int)
        s = Words([c for part, _ in source for c in part])
        t = Words([c for part, _ in target for c in part])
        self.s_word, self.s_unit = s.hash, s.text
        self.t_word, self.t_unit = t.hash, t.text
        self.s_first = np.concatenate([[0], np.cumsum(self.n)])
        self.t_first = np.concatenate([[0], np.cumsum(self.m)])
        self.s_length = np.bincount(self.s_unit, minlength=self.s_first[-1])
        self.s_pair = np.repeat(np.arange(self.size), self.n)
        self.t_pair = np.repeat(np.arange(self.size), self.m)
        self.s_place = np.arange(len(self.s_pair)) - self.s_first[self.s_pair]
        self.t_place = np.arange(len(self.t_pair)) - self.t_first[self.t_pair]
        self.s_sentence = np.array([k for _, number in source for k in number], int)

    @classmethod
    def of(cls, sources: list[str], targets: list[str]) -> Batch:
        return cls([clauses(t) for t in sources], [clauses(t) for t in targets])


@dataclass
class Emissions:
    """Of each target clause: states by span length and column, their source clause (-1: none), null, and evidence."""

    score: np.ndarray
    place: np.ndarray
    null: np.ndarray
    shared: np.ndarray
    explained: np.ndarray


def _spread(values: np.ndarray, length: int) -> np.ndarray:
    """Sums of ``length`` neighbours along the last axis; the last places, where a span does not fit, are 0."""
    out = values.copy()
    for k in range(1, length):
        out[..., :-k] += values[..., k:]
    if length > 1:
        out[..., max(0, out.shape[-1] - length + 1) :] = 0
    return out


def _emissions(batch: Batch, lexicon: Lexicon) -> Emissions:
    """The logarithmic probability of every target clause under its states; words a state does not explain cost the same for all."""
    width = max(1, int(batch.n.max(initial=1)))
    spans = min(SPANS, width)
    own, word, p = lexicon.expand(batch.s_word)
    unit = batch.s_unit[own]
    pair = batch.s_pair[unit].astype(np.uint64)
    key = mix(word + pair * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    key, unit, p = key[order], unit[order], p[order]
    equal = order < len(batch.s_word)  # the first expansions are the words themselves
    want = mix(batch.t_word + batch.t_pair[batch.t_unit].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    low, high = np.searchsorted(key, want, "left"), np.searchsorted(key, want, "right")
    place = batch.s_place[unit]
    length, sentence = np.zeros((batch.size, width)), np.zeros((batch.size, width), int)
    length[batch.s_pair, batch.s_place] = batch.s_length
    sentence[batch.s_pair, batch.s_place] = batch.s_sentence
    noise = BACKGROUND * lexicon.chance(batch.t_word)
    units, beam = int(batch.t_first[-1]), min(width, BEAM)
    # a further clause has to earn its place, more so in another sentence
    step = np.where(sentence[:, 1:] == sentence[:, :-1], *SPAN)
    cost = np.zeros((spans, batch.size, width))
    for k in range(1, spans):
        cost[k] = np.inf
        cost[k, :, : width - k] = cost[k - 1, :, : width - k] + step[:, k - 1 :]
    fits = np.arange(width) + np.arange(spans)[:, None, None] < batch.n[:, None]
    out = Emissions(np.empty((units, spans, beam)), np.empty((units, beam), np.int64), np.zeros(units), np.zeros((units, beam), bool), np.zeros((units, beam)))
    edge = np.searchsorted(batch.t_unit, np.arange(units + 1))
    begin = 0
    while begin < units:
        end = begin + 1
        while end < units and (edge[end + 1] - edge[begin]) * width <= CELLS and (end - begin) * width * spans <= CELLS:
            end += 1
        at, size, here = slice(edge[begin], edge[end]), edge[end] - edge[begin], end - begin
        row = batch.t_unit[at] - begin
        who = batch.t_pair[begin:end]
        count = high[at] - low[at]
        occurrence = np.repeat(np.arange(size), count)
        pick = np.repeat(low[at], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        mass = np.bincount(occurrence * width + place[pick], p[pick], minlength=size * width).reshape(size, width)
        shared = np.zeros((here, width), bool)
        same = equal[pick]
        shared[row[occurrence[same]], place[pick][same]] = True
        ground = noise[at]
        base = np.bincount(row, np.log(ground), minlength=here)
        score = np.empty((here, spans, width))
        long = length[who]
        for k in range(spans):
            total = _spread(mass, k + 1)
            hit = np.flatnonzero(total)
            o, i = hit // width, hit % width
            r = row[o]
            room = _spread(long, k + 1)[r, i] + 1
            share = (1 - BACKGROUND) * np.minimum(total.ravel()[hit], 1.0) / room
            gain = np.bincount(r * width + i, np.log1p(share / ground[o]), minlength=here * width).reshape(here, width)
            score[:, k] = np.where(fits[k, who], base[:, None] + gain - cost[k, who], -np.inf)
            if k == 0:
                # null knows what another clause than the best one explains: names of the subject, but not its values
                best, second = np.zeros(size), np.zeros(size)
                if len(hit):
                    first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
                    best[o[first]] = np.maximum.reduceat(share, first)
                    top = np.flatnonzero(share == best[o])
                    top = top[np.concatenate([[True], o[top[1:]] != o[top[:-1]]])]
                    rest = share.copy()
                    rest[top] = 0.0
                    second[o[first]] = np.maximum.reduceat(rest, first)
                null = np.bincount(row, np.log(second + ground), minlength=here)
                # names common to several clauses explain little
                value = np.minimum(total.ravel()[hit], 1.0)
                several = np.bincount(o[value > 0.5], minlength=size) > 1
                weight = -np.log(ground) * np.where(several, 0.3, 1.0)
                told = value > 0.04
                explained = np.bincount((r * width + i)[told], weight[o[told]], minlength=here * width).reshape(here, width)
                # not in place: without any match bincount gives integers
                explained = explained / np.maximum(np.bincount(row, weight, minlength=here), 1e-9)[:, None]
        out.null[begin:end] = null
        if beam == width:
            out.score[begin:end], out.shared[begin:end], out.explained[begin:end] = score, shared, explained
            out.place[begin:end] = np.arange(width)
        else:
            middle = (batch.t_place[begin:end] * (batch.n[who] / batch.m[who]))[:, None]
            near = np.abs(np.arange(width) - middle) <= BAND / 2
            wanted = np.where(near, np.inf, score.max(1))
            kept = np.sort(np.argpartition(-wanted, beam, axis=1)[:, :beam], axis=1)
            out.place[begin:end] = kept
            out.score[begin:end] = np.take_along_axis(score, kept[:, None], 2)
            out.shared[begin:end], out.explained[begin:end] = np.take_along_axis(shared, kept, 1), np.take_along_axis(explained, kept, 1)
        begin = end
    return out


def _viterbi(batch: Batch, found: Emissions) -> tuple[np.ndarray, np.ndarray]:
    """(column, span) of each target clause's state on its pair's best path; column -1 is null."""
    width = max(1, int(batch.n.max(initial=1)))
    units, spans, beam = found.score.shape
    real = spans * width
    deep = int(batch.m.max(initial=0))
    if not units:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    unit = np.full((batch.size, deep), -1)
    unit[batch.t_pair, batch.t_place] = np.arange(units)
    n = np.maximum(batch.n, 1)
    free = np.log((1 - NULL - STAY - NEXT - SKIP - BACK) / n)
    jumps = ((1, np.log(NEXT)), (0, np.log(STAY)), (2, np.log(SKIP / 2)), (3, np.log(SKIP / 2)), (-1, np.log(BACK)))
    rows = np.arange(batch.size)
    back = np.full((units, spans * beam + 1), -1, np.int32)
    best = np.zeros((batch.size, real + 1))
    for j in range(deep):
        live = np.flatnonzero(j < batch.m)
        u = unit[live, j]
        if j == 0:
            value = np.tile(np.log((1 - NULL) / n[live])[:, None], (1, width))
            value[:, 0] += np.log(2.0)
            source = np.full((len(live), width), -1)
            null, null_from = np.full(len(live), np.log(NULL)), np.full(len(live), -1)
        else:
            before = best[live]
            # the best state that ends at each source clause
            ending, which = before[:, :width].copy(), np.tile(np.arange(width), (len(live), 1))
            for k in range(1, spans):
                offer = before[:, k * width : (k + 1) * width - k]
                use = offer > ending[:, k:]
                ending[:, k:] = np.where(use, offer, ending[:, k:])
                which[:, k:] = np.where(use, np.arange(k * width, (k + 1) * width - k), which[:, k:])
            # from anywhere, from null, or by a short jump
            far = before[:, :real].argmax(1)
            value = np.tile((before[np.arange(len(live)), far] + free[live])[:, None], (1, width))
            source = np.tile(far[:, None], (1, width))
            from_null = (before[:, real] + np.log((1 - NULL) / n[live]))[:, None]
            source = np.where(from_null > value, real, source)
            value = np.maximum(value, from_null)
            for d, cost in jumps:
                if abs(d) >= width:
                    continue
                to, at_end = slice(max(d, 0), width + min(d, 0)), slice(max(-d, 0), width - max(d, 0))
                offer = ending[:, at_end] + cost
                use = offer > value[:, to]
                value[:, to] = np.where(use, offer, value[:, to])
                source[:, to] = np.where(use, which[:, at_end], source[:, to])
            null_from = before.argmax(1)
            null = before[np.arange(len(live)), null_from] + np.log(NULL)
        now = np.full((len(live), real + 1), -np.inf)
        place = found.place[u]
        into, origin = np.take_along_axis(value, place, 1), np.take_along_axis(source, place, 1)
        for k in range(spans):
            np.put_along_axis(now, place + k * width, into + found.score[u, k], 1)
            back[u, k * beam : (k + 1) * beam] = origin
        now[:, real] = null + found.null[u] - SPARE
        back[u, -1] = null_from
        best[live] = now
    # paths backwards; states are span * width + source clause, and real for null
    state = best.argmax(1)
    column, span = np.full(units, -1), np.ones(units, np.int64)
    for j in range(deep - 1, -1, -1):
        live = np.flatnonzero(j < batch.m)
        u, mine = unit[live, j], state[live]
        null = mine == real
        k, i = np.where(null, 0, mine // width), np.where(null, 0, mine % width)
        c = (found.place[u] < i[:, None]).sum(1)
        column[u] = np.where(null, -1, c)
        span[u] = k + 1
        state[live] = np.where(null, back[u, -1], back[u, np.minimum(k * beam + c, spans * beam - 1)])
    return column, span


def _states(batch: Batch, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each target clause the first source clause of its state (-1: null), the span's length and the gain over null."""
    units = int(batch.t_first[-1])
    if not units or not batch.s_first[-1]:
        return np.full(units, -1), np.ones(units, np.int64), np.zeros(units)
    found = _emissions(batch, lexicon)
    column, span = _viterbi(batch, found)
    row, at = np.arange(units), np.maximum(column, 0)
    gain = found.score[row, span - 1, at] - found.null
    first = found.place[row, at]
    named, told = np.zeros(units, bool), np.zeros(units)
    for k in range(found.score.shape[1]):
        c = np.minimum(at + k, found.place.shape[1] - 1)
        inside = (k < span) & (found.place[row, c] == first + k)
        named |= inside & found.shared[row, c]
        told = np.maximum(told, np.where(inside, found.explained[row, c], 0.0))
    enough = (gain > 0) & np.where(named, (gain > LEAST_GAIN) | (told >= EXPLAINED), gain > STRONG_GAIN)
    null = (column < 0) | (batch.n[batch.t_pair] == 0) | ~enough
    return np.where(null, -1, first), np.where(null, 1, span), np.where(null, 0.0, gain)


def decode(batch: Batch, lexicon: Lexicon, again: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The states of a batch's target clauses: first source clause (-1: null), span and gain over null, which is above 0.

    With ``again`` the clauses left over on both sides of a pair are decoded once more by themselves.
    """
    first, span, gain = _states(batch, lexicon)
    if not again:
        return first, span, gain
    taken = np.zeros(len(batch.s_pair) + SPANS + 1, bool)
    done = np.flatnonzero(first >= 0)
    for k in range(SPANS):
        use = done[span[done] > k]
        taken[batch.s_first[batch.t_pair[use]] + first[use] + k] = True
    free_s, free_t = np.flatnonzero(~taken[: len(batch.s_pair)]), np.flatnonzero(first < 0)
    both = np.intersect1d(batch.s_pair[free_s], batch.t_pair[free_t])
    if not len(both):
        return first, span, gain
    rest_s = [free_s[a:b] for a, b in zip(np.searchsorted(batch.s_pair[free_s], both), np.searchsorted(batch.s_pair[free_s], both, "right"), strict=True)]
    rest_t = [free_t[a:b] for a, b in zip(np.searchsorted(batch.t_pair[free_t], both), np.searchsorted(batch.t_pair[free_t], both, "right"), strict=True)]
    # neighbours that were none before are told apart by their sentence numbers, which are wide apart here
    part = lambda texts, place: [([texts[p][0][i] for i in place[u]], [int(i) * 1_000 + texts[p][1][i] for i in place[u]]) for p, u in zip(both, groups, strict=True)]
    groups = rest_s
    source = part(batch.source, batch.s_place)
    groups = rest_t
    target = part(batch.target, batch.t_place)
    more = Batch(source, target)
    again_first, _, again_gain = _states(more, lexicon)
    for u in np.flatnonzero(again_first >= 0):
        p = more.t_pair[u]
        to = rest_t[p][more.t_place[u]]
        first[to], span[to], gain[to] = batch.s_place[rest_s[p][again_first[u]]], 1, again_gain[u]
    return first, span, gain


def _parts(sources: list[str], targets: list[str]) -> Iterator[np.ndarray]:
    """Indices of pairs to decode together: like sizes pad least."""
    size = [len(s) + len(t) for s, t in zip(sources, targets, strict=True)]
    order = np.argsort(size, kind="stable")
    begin = 0
    while begin < len(order):
        end = begin
        while end < len(order) and end - begin < PAIRS_AT_ONCE and (end == begin or (end - begin + 1) * size[order[end]] < 600_000 and size[order[end]] < 2 * size[order[begin]] + 400):
            end += 1
        yield order[begin:end]
        begin = end


def _frequencies(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of either side, for sentences may stand untranslated, and their shares of all words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            word, n = np.unique(Words([*frame["source"], *frame["target"]]).hash, return_counts=True)
            yield pd.DataFrame({"word": word.view(np.int64), "n": n})

    counts = texts.select("source", "target").mapInPandas(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    share = (F.col("n") + 0.5) / F.lit(float(total + 1))
    found = counts.select("word", share.alias("share")).where(F.col("share") >= LEAST_SHARE).toPandas()
    word = found["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(word)
    return word[order], found["share"].to_numpy(float)[order]


def _links(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(source, target, n): sorted words of aligned target clauses and of their states that the other does not have, and how often."""
    shared = texts.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            sources, targets = frame["source"].tolist(), frame["target"].tolist()
            seen: Counter = Counter()
            for part in _parts(sources, targets):
                b = Batch.of([sources[i] for i in part], [targets[i] for i in part])
                first, span, gain = decode(b, shared.value, again=False)
                s_edge = np.searchsorted(b.s_unit, np.arange(b.s_first[-1] + 1))
                t_edge = np.searchsorted(b.t_unit, np.arange(b.t_first[-1] + 1))
                for u in np.flatnonzero((first >= 0) & (gain > 2.0)):
                    a = b.s_first[b.t_pair[u]] + first[u]
                    e, f = set(b.s_word[s_edge[a] : s_edge[a + span[u]]].tolist()), set(b.t_word[t_edge[u] : t_edge[u + 1]].tolist())
                    if e - f and f - e:
                        seen[tuple(sorted(e - f)), tuple(sorted(f - e))] += 1
            yield pd.DataFrame({
                "source": [np.array(e, np.uint64).view(np.int64) for e, _ in seen],
                "target": [np.array(f, np.uint64).view(np.int64) for _, f in seen],
                "n": pd.Series(list(seen.values()), dtype="int64"),
            })

    return texts.select("source", "target").mapInPandas(run, "source array<bigint>, target array<bigint>, n bigint").groupBy("source", "target").agg(F.sum("n").alias("n"))


def _expected(links: DataFrame, known: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """(s, t, n, c) of one expectation step: how often words meet and the expected count of the translation.

    known: sorted keys of translations and their probabilities; without it all are equally likely. With it
    only known translations have rows, and a row with NULL as t holds what a source word's others count.
    """
    shared = links.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if not len(frame):
                continue
            e_size, f_size = frame["source"].map(len).to_numpy(), frame["target"].map(len).to_numpy()
            e = np.concatenate(frame["source"].tolist()).view(np.uint64)
            f = np.concatenate(frame["target"].tolist()).view(np.uint64)
            clause = np.repeat(np.arange(len(frame)), f_size)
            many = e_size[clause]
            g = np.repeat(np.arange(len(f)), many)
            s = e[np.repeat((np.cumsum(e_size) - e_size)[clause], many) + np.arange(len(g)) - np.repeat(np.cumsum(many) - many, many)]
            t, often = f[g], frame["n"].to_numpy()[clause][g]
            key = mix(s) ^ t
            if shared.value is None:
                x, kept = often / many[g], np.ones(len(g), bool)
            else:
                keys, p = shared.value
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                kept = keys[at] == key
                x = np.where(kept, p[at], PRUNED)
                x = often * x / np.bincount(g, x, minlength=len(f))[g]
                other, of = np.unique(s[~kept], return_inverse=True)
                yield pd.DataFrame({"s": other.view(np.int64), "t": pd.Series([None] * len(other), dtype="Int64"), "n": 0, "c": np.bincount(of, x[~kept], minlength=len(other))})
            _, one, of = np.unique(key[kept], return_index=True, return_inverse=True)
            n, c = np.bincount(of, often[kept], minlength=len(one)).astype(np.int64), np.bincount(of, x[kept], minlength=len(one))
            yield pd.DataFrame({"s": s[kept][one].view(np.int64), "t": pd.Series(t[kept][one].view(np.int64), dtype="Int64"), "n": n, "c": c})

    counts = links.mapInPandas(run, "s bigint, t bigint, n bigint, c double").groupBy("s", "t").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    p = F.col("c") / (F.sum("c").over(Window.partitionBy("s")) + 0.5)
    return counts.withColumn("p", p).where(F.col("t").isNotNull() & (F.col("n") >= 2))


def learn_all(texts: DataFrame, rounds: int = ROUNDS) -> Lexicon:
    """A lexicon from all distinct pairs of texts, by alternately aligning clauses and counting words, in the executors.

    Between the steps of Model 1 only translations that come twice and reach PRUNED are kept.
    """
    pairs = cut(texts.where((F.length("source") > 0) & (F.length("target") > 0)).select("source", "target").distinct())
    background = _frequencies(pairs)
    none = np.zeros(0, np.uint64)
    lexicon = Lexicon(none, none, np.zeros(0), background, LEAST_SHARE)
    for _ in range(rounds):
        links = cut(_links(pairs, lexicon))
        known = None
        for step in range(STEPS):
            least = 0.03 if step == STEPS - 1 else PRUNED
            found = _expected(links, known).where(F.col("p") >= least).orderBy(F.desc("c"), "s", "t").limit(TRANSLATIONS).select("s", "t", "p").toPandas()
            s, t = (found[c].to_numpy(np.int64).view(np.uint64) for c in ("s", "t"))
            p = found["p"].to_numpy(float)
            if not len(s):
                break
            key = mix(s) ^ t
            order = np.argsort(key)
            known = key[order], p[order]
        if not len(s):
            break
        lexicon = Lexicon(s, t, np.minimum(p, 0.9), background, LEAST_SHARE)
    return lexicon


def align(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(id, source_pos, target_pos, gain) of sentences that render each other; positions from 1.

    texts: (id string, source string, target string). NULL and blank texts and NULL ids give no row;
    rows that come twice count once.
    """
    shared = texts.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for frame in batches:
            ids, sources, targets = (frame[c].tolist() for c in ("id", "source", "target"))
            rows = []
            for part in _parts(sources, targets):
                batch = Batch.of([sources[i] for i in part], [targets[i] for i in part])
                first, span, gain = decode(batch, known)
                for u in np.flatnonzero(first >= 0):
                    p = batch.t_pair[u]
                    j = batch.target[p][1][u - batch.t_first[p]]
                    for k in range(first[u], first[u] + span[u]):
                        rows.append((ids[part[p]], batch.source[p][1][k], j, float(gain[u])))
            out = pd.DataFrame(rows, columns=["id", "source_pos", "target_pos", "gain"])
            yield out.groupby(["id", "source_pos", "target_pos"], as_index=False).max() if len(out) else out

    chosen = texts.select("id", "source", "target").where(F.col("id").isNotNull() & (F.length(F.trim("source")) > 0) & (F.length(F.trim("target")) > 0))
    return chosen.mapInPandas(run, "id string, source_pos int, target_pos int, gain double").dropDuplicates(["id", "source_pos", "target_pos"])
