"""Similarities of texts: sequence ratio, longest common subsequence, n-gram scores, vectors."""

from __future__ import annotations

import math
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of the normalised lower-case texts; NULL counts as ''."""
    plain = lambda s: " ".join((s or "").split()).lower()
    return pd.Series([1.0 if x == y else SequenceMatcher(None, plain(x), plain(y)).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _common(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@F.pandas_udf(T.DoubleType())
def rouge_l(candidate: pd.Series, reference: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of lower-case words; 0 where either is blank."""
    out = []
    for c, r in zip(candidate, reference, strict=True):
        x, y = (c or "").lower().split(), (r or "").lower().split()
        n = _common(x, y) if x and y else 0
        out.append(2 * n / (len(x) + len(y)) if n else 0.0)
    return pd.Series(out, dtype="float64")


def _grams(items: list[str] | str, n: int) -> Counter:
    return Counter(tuple(items[i : i + n]) for i in range(len(items) - n + 1))


@F.pandas_udf(T.DoubleType())
def chrf_pp(candidate: pd.Series, reference: pd.Series) -> pd.Series:
    """chrF++ in [0, 1]: F2 averaged over character 1- to 6-grams and word 1- and 2-grams."""
    out = []
    for c, r in zip(candidate, reference, strict=True):
        scores = []
        for text, other, orders in (("".join((c or "").split()), "".join((r or "").split()), range(1, 7)), ((c or "").split(), (r or "").split(), range(1, 3))):
            for n in orders:
                x, y = _grams(text, n), _grams(other, n)
                if not x and not y:
                    continue
                same = sum((x & y).values())
                p, q = same / max(1, sum(x.values())), same / max(1, sum(y.values()))
                scores.append(5 * p * q / (4 * p + q) if p + q else 0.0)
        out.append(sum(scores) / len(scores) if scores else 0.0)
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.ArrayType(T.LongType()))
def bleu_counts(candidate: pd.Series, references: pd.Series) -> pd.Series:
    """Per segment: matches and totals of 1- to 4-grams, candidate length, nearest reference length."""
    out = []
    for c, refs in zip(candidate, references, strict=True):
        words, known = (c or "").split(), [(r or "").split() for r in (refs if refs is not None else [])]
        row = []
        for n in range(1, 5):
            x, most = _grams(words, n), Counter()
            for r in known:
                most |= _grams(r, n)
            row += [sum((x & most).values()), max(0, len(words) - n + 1)]
        lengths = sorted((abs(len(r) - len(words)), len(r)) for r in known)
        out.append([*row, len(words), lengths[0][1] if lengths else 0])
    return pd.Series(out)


def bleu(counts: Column) -> Column:
    """BLEU in [0, 1] from summed counts (ARRAY of ten numbers); 0 where an order has no match."""
    match, total = [counts[2 * i].cast("double") for i in range(4)], [counts[2 * i + 1].cast("double") for i in range(4)]
    precision = [F.when((t > 0) & (m > 0), F.log(m / t)) for m, t in zip(match, total, strict=True)]
    mean = sum(precision[1:], precision[0]) / 4
    penalty = F.when(counts[8] >= counts[9], 0.0).otherwise(1 - counts[9] / F.greatest(counts[8], F.lit(1)))
    return F.coalesce(F.exp(mean + penalty), F.lit(0.0))


@F.pandas_udf(T.DoubleType())
def sentence_bleu(candidate: pd.Series, references: pd.Series) -> pd.Series:
    """BLEU in [0, 1] of one segment over the orders it has (effective order), exponentially smoothed."""
    out = []
    for c, refs in zip(candidate, references, strict=True):
        words, known = (c or "").split(), [(r or "").split() for r in (refs if refs is not None else [])]
        logs, smooth = [], 1.0
        for n in range(1, 5):
            x, most = _grams(words, n), Counter()
            for r in known:
                most |= _grams(r, n)
            total = sum(x.values())
            if not total:
                break
            same = sum((x & most).values())
            if not same:
                smooth *= 2
            logs.append(math.log((same or 1 / smooth) / total))
        if not logs or not known or not any(w in {v for r in known for v in r} for w in words):
            out.append(0.0)
            continue
        near = min((abs(len(r) - len(words)), len(r)) for r in known)[1]
        penalty = 1.0 if len(words) >= near else math.exp(1 - near / len(words))
        out.append(penalty * math.exp(sum(logs) / len(logs)))
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def meteor_exact(candidate: pd.Series, reference: pd.Series) -> pd.Series:
    """METEOR with exact matches only (no stems or synonyms, which need data that is not at hand)."""
    out = []
    for c, r in zip(candidate, reference, strict=True):
        x, y = (c or "").lower().split(), (r or "").lower().split()
        free: dict[str, list[int]] = {}
        for j, w in enumerate(y):
            free.setdefault(w, []).append(j)
        pairs = [(i, free[w].pop(0)) for i, w in enumerate(x) if free.get(w)]
        if not pairs:
            out.append(0.0)
            continue
        chunks = 1 + sum(b[0] != a[0] + 1 or b[1] != a[1] + 1 for a, b in zip(pairs, pairs[1:], strict=False))
        p, q = len(pairs) / len(x), len(pairs) / len(y)
        out.append(10 * p * q / (q + 9 * p) * (1 - 0.5 * (chunks / len(pairs)) ** 3))
    return pd.Series(out, dtype="float64")


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays as doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity clipped to [-1, 1]; NULL where a vector is NULL or zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size)))
