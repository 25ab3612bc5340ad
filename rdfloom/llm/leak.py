"""Passages of held-out items inside a corpus, found through an FM-index per shard.

Each shard of documents becomes a sequence of word identifiers (words outside the items share
one identifier) and gets an FM-index, once for all items. Every run of ``seed`` words of an item is
searched backwards through it; the occurrences, located by sampled suffixes, say on which diagonal of
which document an item may lie. The exact check counts differing words along the diagonal; what
belongs together is merged into removal spans.

A passage counts with at least ``least`` consecutive words of the item of which at most one in
``tolerance`` differs. A differing word may be another word, a word too much or one too few.
Such a passage always holds ``seed_length(least, tolerance)`` equal words in a row, so the
seeds lose none. Every document is read whole, with every seed, at every size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rdfloom.llm.fm_index import FMIndex
from rdfloom.llm.textvec import Words, distinct

LEAST, TOLERANCE = 16, 10
#: Hyphens at line ends inside words, and marks of no width; the characters one of which a text with any of them holds.
JOINED = r"[-\u2010](?<=\p{Ll}[-\u2010])\r?\n\s{0,8}(?=\p{Ll})|[\u00ad\u200b-\u200d\u2060\ufeff]"
JOINING = ("-\n", "-\r", "\u2010", "\u00ad", "\u200b", "\u200c", "\u200d", "\u2060", "\ufeff")
#: Words of a shard that get one index together; a longer document is a shard of its own.
SHARD_WORDS = 400_000
#: Words of items that go to the executors together, a bound on what is broadcast; more are taken in several passes.
PASS_WORDS = 4_000_000
#: Words of items whose seeds are searched at once, and cells of padded comparisons.
BLOCK_WORDS, CELLS = 200_000, 2_000_000
#: Tags, character references and reference marks, which passages may hold between their words, and their first characters.
MARKUP = r"</?[a-zA-Z][^<>|]*>|&[a-zA-Z]{2,8};|&#\d{1,6};|\[\s*(?:\d{1,4}|[a-z]|\^|citation needed|note \d{1,3}|ref\.?|nota \d{1,3}|sic)\s*\]|\{\{[^{}]*\}\}|\^\d{1,3}\b"
MARKS = ("<", "&", "[", "{{", "^")


def clean_text(text: Column) -> Column:
    """The text without markup and with words put together again; a text without their characters is not searched for them."""
    has = lambda c, marks: reduce(or_, [c.contains(m) for m in marks])
    joined = F.when(has(text, JOINING), F.regexp_replace(text, JOINED, "")).otherwise(text)
    return F.when(has(text, MARKS), F.regexp_replace(joined, MARKUP, " ")).otherwise(joined)


def seed_length(least: int = LEAST, tolerance: int = TOLERANCE) -> int:
    """Equal words in a row that every passage must hold.

    A passage of n words with d <= n / tolerance differing ones has a run of at least
    (n - d) / (d + 1) equal words, rounded up; the least over all n is reached just below or at the
    next multiple of the tolerance.
    """
    best = least
    for n in range(least, 40 * tolerance):
        d = n // tolerance
        best = min(best, -(-(n - d) // (d + 1)))
    return max(2, best)


class Items:
    """The items as word identifiers, one after the other: 1 ends a document, 2 is any word outside the items."""

    def __init__(self, ids: list[int], texts: list[str], least: int, tolerance: int) -> None:
        self.ids = np.array(ids, np.int64)
        words = Words(texts)
        self.vocabulary, codes = np.unique(words.hash, return_inverse=True)
        self.codes = codes.astype(np.int32) + 3
        self.symbols = len(self.vocabulary) + 3
        self.seed, self.least = seed_length(least, tolerance), least
        self.lengths = np.bincount(words.text, minlength=len(texts)) if len(texts) else np.zeros(0, int)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])
        self._seeds: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_seeds": None}

    def blocks(self) -> Iterator[tuple[int, int]]:
        """Ranges of items of about BLOCK_WORDS words."""
        begin = 0
        while begin < len(self.ids):
            end = max(begin + 1, int(np.searchsorted(self.first, self.first[begin] + BLOCK_WORDS, "right")) - 1)
            yield begin, min(end, len(self.ids))
            begin = end

    def seeds(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct runs of seed words of a range of items, their (item, offset) sorted by run, and where each run's begin."""
        if self._seeds is None or self._seeds[0] != (begin, end):
            item = np.repeat(np.arange(begin, end), self.lengths[begin:end])
            offset = np.arange(len(item)) + self.first[begin] - self.first[item]
            good = (self.lengths[item] >= self.least) & (offset + self.seed <= self.lengths[item])
            item, offset = item[good], offset[good]
            grams = self.codes[self.first[item, None] + offset[:, None] + np.arange(self.seed)]
            phrases, back = np.unique(grams, axis=0, return_inverse=True)
            order = np.argsort(back.ravel(), kind="stable")
            edges = np.concatenate([[0], np.cumsum(np.bincount(back.ravel(), minlength=len(phrases)))])
            self._seeds = ((begin, end), (phrases.astype(np.int64), np.stack([item, offset], 1)[order], edges))
        return self._seeds[1]

    def words(self, item: np.ndarray, width: int) -> np.ndarray:
        """The words of the items, one row each, padded with -2."""
        at = np.arange(width)
        place = np.minimum(self.first[item, None] + at, max(0, len(self.codes) - 1))
        return np.where(at < self.lengths[item, None], self.codes[place] if len(self.codes) else -2, -2)

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.full(len(hashes), 2, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 3, 2)


def _windows(differs: np.ndarray, least: int, tolerance: int) -> np.ndarray:
    """For each row of word comparisons whether some window of ``least`` or more passes, its first and last word equal."""
    rows, n = differs.shape
    g = np.zeros((rows, n + 1), np.int64)
    np.cumsum(differs * tolerance - 1, axis=1, out=g[:, 1:])
    if n < least:
        return np.zeros(rows, bool)
    begins = np.where(differs[:, : n + 1 - least], -(10**6), g[:, : n + 1 - least])
    best = np.maximum.accumulate(begins, axis=1)
    return ((g[:, least:] <= best) & ~differs[:, least - 1 :]).any(1)


def _spans(differs: np.ndarray, least: int, tolerance: int) -> list[tuple[int, int]]:
    """The places that windows which pass cover, of one row of comparisons: first and last, merged."""
    g = np.concatenate([[0], np.cumsum(differs * tolerance - 1)])
    n = len(differs)
    best = np.maximum.accumulate(np.where(differs[: n + 1 - least], -(10**6), g[: n + 1 - least]))
    ends = np.flatnonzero((g[least:] <= best) & ~differs[least - 1 :])
    return merge_spans([(int(np.searchsorted(best, g[e + least])), int(e) + least - 1) for e in ends])


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans, first and last place included, with those that overlap or touch put together."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _gapped(document: np.ndarray, item: np.ndarray, least: int, tolerance: int) -> np.ndarray:
    """Of each row the last place of the document at which an alignment with words too much or too few ends a passage, -1 if none.

    Scores a word of the item -1 where equal and tolerance - 1 where it differs or is missing, and an inserted word
    tolerance; a passage has at least ``least`` words of the item and a sum of at most 0. Rows are padded with
    different negative numbers. Kept as the least cost by place in the item and words taken, ``least`` or more as one.
    """
    rows, n = document.shape
    m = item.shape[1]
    infinite = 10**6
    taken = np.arange(least + 1) > 0
    previous = np.full((rows, m + 1, least + 1), infinite, np.int32)
    previous[:, :, 0] = 0
    last = np.full(rows, -1)
    for d in range(n):
        current = np.where(taken, previous + tolerance, 0).astype(np.int32)
        same = item == document[:, d, None]
        # a word of the item stands against this one: no step depends on another
        gain = np.where(same, -1, tolerance - 1)[:, :, None]
        step = previous[:, :-1] + gain
        step[:, :, 0] = np.where(same, -1, infinite)
        current[:, 1:, 1:] = np.minimum(current[:, 1:, 1:], step[:, :, :-1])
        current[:, 1:, least] = np.minimum(current[:, 1:, least], step[:, :, least])
        last[((current[:, 1:, least] <= 0) & same).any(1)] = d
        # words of the item left out, one after the other
        for i in range(m):
            skip = current[:, i, 1:] + tolerance - 1
            current[:, i + 1, 2:] = np.minimum(current[:, i + 1, 2:], skip[:, :-1])
            current[:, i + 1, least] = np.minimum(current[:, i + 1, least], skip[:, -1])
        previous = current
    return last


def scan_shard(items: Items, codes: np.ndarray, document: np.ndarray, least: int, tolerance: int) -> np.ndarray:
    """Rows (document, item, first, last place of the passage) of one shard, indexed once for all items."""
    index = FMIndex(codes, items.symbols)
    found = [_scan_block(items, index, codes, document, begin, end, least, tolerance) for begin, end in items.blocks()]
    return np.concatenate(found) if found else np.zeros((0, 4), np.int64)


def _by_length(lengths: np.ndarray, extra: int) -> Iterator[np.ndarray]:
    """Candidates to compare together, of like item lengths, so that padding is bounded."""
    order = np.argsort(lengths, kind="stable")
    begin = 0
    while begin < len(order):
        end = begin + 1
        while end < len(order) and (end + 1 - begin) * (lengths[order[end]] + extra) <= CELLS:
            end += 1
        yield order[begin:end]
        begin = end


def _scan_block(items: Items, index: FMIndex, codes: np.ndarray, document: np.ndarray, begin: int, end: int, least: int, tolerance: int) -> np.ndarray:
    phrases, owner_of, edges = items.seeds(begin, end)
    phrase, place = index.locate(*index.search(phrases))
    fan = edges[phrase + 1] - edges[phrase]
    pick = np.repeat(edges[phrase], fan) + np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan)
    item, offset = owner_of[pick, 0], owner_of[pick, 1]
    place = np.repeat(place, fan)
    doc = document[place]
    reach = int(items.lengths.max(initial=0))
    size = len(codes) + reach + 1
    key = distinct(((doc * len(items.ids) + item) * size + (place - offset + reach)).astype(np.uint64)).astype(np.int64)
    candidates = np.stack([key // size // len(items.ids), key // size % len(items.ids), key % size - reach], 1)
    out: list[tuple[int, int, int, int]] = []
    hit = np.zeros(len(candidates), bool)
    near = np.zeros(len(candidates), bool)

    def against(part: np.ndarray, wanted: np.ndarray, shift: int) -> np.ndarray:
        at = part[:, 2, None] + shift + np.arange(wanted.shape[1])
        inside = (at >= 0) & (at < len(codes))
        at = np.where(inside, at, 0)
        return ~inside | (codes[at] != wanted) | (document[at] != part[:, 0, None])

    for chosen in _by_length(items.lengths[candidates[:, 1]], 0):
        part = candidates[chosen]
        wanted = items.words(part[:, 1], int(items.lengths[part[:, 1]].max()))
        differs = against(part, wanted, 0)
        hit[chosen] = _windows(differs, least, tolerance)
        for r in np.flatnonzero(hit[chosen]):
            d, i, diagonal = part[r].tolist()
            out += [(d, i, diagonal + a, diagonal + b) for a, b in _spans(differs[r], least, tolerance)]
        # the others are checked with gaps, if words on the near diagonals leave that possible
        rest = np.flatnonzero(~hit[chosen])
        if len(rest):
            part, wanted, differs = part[rest], wanted[rest], differs[rest]
            for shift in range(1, wanted.shape[1] // tolerance + 2):
                differs &= against(part, wanted, shift) & against(part, wanted, -shift)
            near[chosen[rest]] = _windows(differs, least, tolerance)
    known = set(map(tuple, candidates[hit][:, :2].tolist()))
    rest = np.array([c for c in np.flatnonzero(near) if tuple(candidates[c, :2].tolist()) not in known], np.int64)
    for chosen in _by_length(items.lengths[candidates[rest, 1]], 0):
        for some in np.array_split(rest[chosen], max(1, len(chosen) // 256)):
            part = candidates[some]
            lengths = items.lengths[part[:, 1]]
            width = int(lengths.max(initial=0))
            wanted = items.words(part[:, 1], width)
            gap = width // tolerance + 1
            at = part[:, 2, None] - gap + np.arange(width + 2 * gap)
            inside = (at >= 0) & (at < len(codes)) & (at < (part[:, 2] + lengths + gap)[:, None])
            inside &= document[np.where(inside, at, 0)] == part[:, 0, None]
            text = np.where(inside, codes[np.where(inside, at, 0)], -1)
            last = _gapped(text, wanted, least, tolerance)
            good = np.flatnonzero(last >= 0)
            if not len(good):
                continue
            backward = _gapped(text[good, ::-1], wanted[good, ::-1], least, tolerance)
            for r, b in zip(good, backward, strict=True):
                out.append((*part[r, :2].tolist(), int(at[r, 0]) + text.shape[1] - 1 - int(b), int(at[r, 0]) + int(last[r])))
    return np.array(out, np.int64).reshape(-1, 4)


def passages(
    documents: DataFrame,
    items: DataFrame,
    least: int = LEAST,
    tolerance: int = TOLERANCE,
    shard_words: int = SHARD_WORDS,
    pass_words: int = PASS_WORDS,
) -> DataFrame:
    """(doc_id, item_id, first_word, last_word) for every passage of an item in a document; words of ``clean_text`` count from 1.

    documents: (doc_id bigint, text string); items: (item_id bigint, text string). NULL and empty
    texts leak nothing, and rows without an id are left out. Items with fewer than ``least`` words cannot leak. Ids that
    come twice count once. Items go to all executors, ``pass_words`` words at a time (a single longer item alone);
    each pass indexes a shard of documents once. The documents are neither shuffled nor collected.
    """
    clean = documents.select("doc_id", clean_text(F.col("text")).alias("text")).where((F.length("text") > 0) & F.col("doc_id").isNotNull())
    chosen = items.select("item_id", clean_text(F.col("text")).alias("text")).where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).dropDuplicates(["item_id"])
    parts = []
    for rows in _blocks(chosen.orderBy("item_id").toLocalIterator(), pass_words):
        known = Items([r["item_id"] for r in rows], [r["text"] for r in rows], least, tolerance)
        parts.append(_scan(clean, documents.sparkSession.sparkContext.broadcast(known), least, tolerance, shard_words))
    if not parts:
        return clean.limit(0).select("doc_id", *[F.lit(0).cast(t).alias(c) for c, t in (("item_id", "bigint"), ("first_word", "int"), ("last_word", "int"))])
    return reduce(DataFrame.unionAll, parts)


def leaks(documents: DataFrame, items: DataFrame, **parameters: int) -> DataFrame:
    """(doc_id, item_id) for every document that holds a passage of an item; see ``passages``."""
    return passages(documents, items, **parameters).select("doc_id", "item_id").dropDuplicates(["doc_id", "item_id"])


def removal_spans(found: DataFrame) -> DataFrame:
    """(doc_id, first_word, last_word, items): what to take out of each document, passages that overlap or touch merged.

    found: as ``passages`` gives it. A running maximum over the sorted passages of a document finds where a new span begins.
    """
    before = Window.partitionBy("doc_id").orderBy("first_word", "last_word")
    fresh = F.coalesce(F.col("first_word") > F.max("last_word").over(before.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True))
    numbered = found.distinct().withColumn("fresh", fresh).withColumn("span", F.sum(F.col("fresh").cast("int")).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "span").agg(
        F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.array_sort(F.collect_set("item_id")).alias("items")
    ).drop("span")


def _blocks(rows: Iterator, words: int) -> Iterator[list]:
    block, size = [], 0
    for row in rows:
        own = len(row["text"]) // 2 + 1  # no text has more words
        if block and size + own > words:
            yield block
            block, size = [], 0
        block.append(row)
        size += own
    if block:
        yield block


def _scan(documents: DataFrame, known, least: int, tolerance: int, shard_words: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = known.value
        ids: list[np.ndarray] = []
        codes: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        words = 0

        def flush() -> pd.DataFrame:
            doc_ids = np.concatenate(ids)
            found = scan_shard(items, np.concatenate(codes), np.concatenate(owners), least, tolerance)
            owner = np.concatenate(owners)
            start = np.searchsorted(owner, found[:, 0])
            return pd.DataFrame({
                "doc_id": doc_ids[found[:, 0]], "item_id": items.ids[found[:, 1]],
                "first_word": (found[:, 2] - start + 1).astype("int32"), "last_word": (found[:, 3] - start + 1).astype("int32"),
            }).drop_duplicates()

        for batch in batches:
            texts = batch["text"].tolist()
            begin = 0
            while begin < len(texts):
                end, size = begin, 0
                while end < len(texts) and (end == begin or size + len(texts[end]) < 1_000_000):
                    size += len(texts[end])
                    end += 1
                part = Words(texts[begin:end])
                encoded = items.encode(part.hash)
                count = np.bincount(part.text, minlength=end - begin)
                # each document ends with the mark 1
                last = np.cumsum(count)
                sequence = np.insert(encoded, last, 1)
                base = sum(len(x) for x in ids)
                owner = np.repeat(np.arange(end - begin) + base, count + 1)
                ids.append(batch["doc_id"].to_numpy()[begin:end])
                codes.append(sequence)
                owners.append(owner)
                words += len(sequence)
                begin = end
                if words >= shard_words:
                    yield flush()
                    ids.clear(), codes.clear(), owners.clear()
                    words = 0
        if ids:
            yield flush()

    return documents.mapInPandas(run, "doc_id bigint, item_id bigint, first_word int, last_word int")
