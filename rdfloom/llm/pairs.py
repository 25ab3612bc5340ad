"""Broken prompt and response pairs: empty, truncated, refused, copied, in another language.

A multi-label linear classifier over hashed n-grams (names masked) and features of the pair: which
of the values in the prompt the response states, how it ends, how much of it the prompt already
says, and in which language it is. It is trained on a bounded sample of pairs of the table itself,
broken on purpose; thresholds are calibrated on pairs held out from the fit.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rdfloom.llm.langid import Found, LanguageModel
from rdfloom.llm.phrases import REFUSALS
from rdfloom.llm.textvec import chunks

DEFECTS = ("empty", "truncated", "refusal", "copy", "other_language")
#: Hashed features: those of the pair serve every defect, those of the end only ``truncated``,
#: the words only ``refusal``.
GROUPS = {"pair": (0, 1 << 12), "end": (1 << 12, 1 << 15), "word": (1 << 15, 1 << 17)}
WIDTH = 1 << 17
#: The fit draws at most so many entries (with all their languages) of the table.
SAMPLE_PAIRS = 1_500

#: Names of the languages a prompt may ask for.
LANGUAGE_NAMES = {
    "en": ("english", "ingles", "angles", "anglais"),
    "es": ("spanish", "espanol", "castellano", "espanyol", "castella", "espagnol"),
    "ca": ("catalan", "catala", "valencian", "valenciano", "valencia"),
    "fr": ("french", "frances", "francais"),
}
_ASKED = {name: code for code, names in LANGUAGE_NAMES.items() for name in names}
#: Months in the four languages, without accents.
MONTHS = (
    "january enero gener janvier", "february febrero febrer fevrier", "march marzo marc mars", "april abril avril", "may mayo maig mai",
    "june junio juny juin", "july julio juliol juillet", "august agosto agost aout", "september septiembre setembre septembre",
    "october octubre octobre", "november noviembre novembre", "december diciembre desembre decembre",
)
_MONTH = {name: i + 1 for i, names in enumerate(MONTHS) for name in names.split()}
PLACEHOLDERS = frozenset(
    "null none nil nan na n/a n.a. n.d. n/d nd - -- --- — – _ ... … . .. ? ?? ??? [] {} () [ ] \"\" '' `` tbd todo void empty blank undefined unknown "
    "vacio vacío buit vide ninguno cap #n/a [0] [empty] <empty> (empty) [null] <null> xxx n\\a".split()
)
_WORD = re.compile(r"[^\W_]+(?:[.,  ](?=\d{3}(?!\d))\d+)*(?:[.,]\d+)?")
_PLAIN = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case without accents."""
    text = text.lower()
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def words(text: str) -> list[str]:
    return _PLAIN.findall(fold(text))


def is_empty(text: str | None) -> bool:
    """No content: NULL, only blanks, marks or a placeholder."""
    if text is None:
        return True
    bare = fold(text).strip().strip("​﻿⁠").strip()
    return bare in PLACEHOLDERS or not any(c.isalpha() for c in bare) and (len(bare) < 8 or not any(c.isdigit() for c in bare)) or bare.strip(" []{}()<>\"'`.") in PLACEHOLDERS | {""}


def _grams(tokens: list[str], n: int = 3) -> set[tuple[str, ...]]:
    return {tuple(tokens[i : i + n]) for i in range(max(1, len(tokens) - n + 1))}


def copy_share(prompt: str | None, target: str | None) -> float:
    """Share of the response's word trigrams that the prompt holds; marks, case and packing aside."""
    t = words(target or "")
    if not t:
        return 0.0
    p = words(prompt or "")
    n = min(3, len(t))
    mine = _grams(t, n)
    return len(mine & _grams(p, n)) / len(mine)


def is_copy(prompt: str | None, target: str | None) -> bool:
    """Repeats the prompt or its triples. A cut last word leaves two trigrams that the prompt lacks."""
    t = words(target or "")
    if not t:
        return False
    share = copy_share(prompt, target)
    return share >= 0.8 or len(t) > 3 and share >= (len(t) - 3.5) / (len(t) - 2) and " | " in (target or "")


def asked_language(prompt: str | None) -> str | None:
    """The language the prompt asks for, from its instruction lines."""
    for line in (prompt or "").split("\n"):
        if "|" in line:
            continue
        for w in words(line):
            if w in _ASKED:
                return _ASKED[w]
    return None


def facts(prompt: str | None) -> list[tuple[str, str, str]]:
    """The triples of a prompt, in whatever packing."""
    out = []
    for piece in re.split(r"\n|&&|>\s*<|\s##\s|<br\s*/?>", prompt or ""):
        fields = piece.split(" | ")
        if len(fields) == 3:
            out.append(tuple(f.strip(" \t<>-*•\"'[](),;") for f in fields))
        elif len(fields) > 3:  # several in one line
            for i in range(2, len(fields), 2):
                left = re.split(r"[;,]\s|\s[;,/~]\s?", fields[i - 2])[-1] if i > 2 else fields[0]
                right = re.split(r"[;,]\s*(?=\S+$)", fields[i])[0] if i + 1 < len(fields) else fields[i]
                out.append((left.strip(" <>-*•\"'"), fields[i - 1].strip(), right.strip(" <>\"'")))
    return out


def _number(token: str) -> str:
    return re.sub(r"[.,  ]", "", token)


def _stated(value: str, present: set[str], numbers: set[str]) -> float:
    """How much of a value a response states."""
    date = re.fullmatch(r"(\d{1,4})[-/](\d{1,2})[-/](\d{1,4})", value)
    if date:
        parts = {str(int(x)) for x in date.groups()}
        months = {str(_MONTH[w]) for w in present if w in _MONTH}
        have = {str(int(x)) for x in numbers if x.isdigit() and len(x) < 5} | months
        return len(parts & have) / len(parts)
    if re.fullmatch(r"[\d., ]+", value):
        return float(_number(value) in numbers)
    mine = words(value.replace("_", " "))
    return sum(w in present for w in mine) / len(mine) if mine else 1.0


@dataclass
class Pair:
    prompt: str | None
    target: str | None


_MARK = re.compile(r"(?:\s*\[\s*\d{1,3}\s*\])+$")
_TAG = re.compile(r"</?[a-zA-Z][^<>|]{0,40}>")


def describe(prompt: str | None, target: str | None, languages: Found) -> list[tuple[str, str]]:
    """(group, name) of the active features of one pair."""
    out = ["bias"]
    target = target or ""
    text = _TAG.sub(" ", target) if "<" in target and "|" not in target else target
    low = fold(text)
    known = facts(prompt)
    tokens = _WORD.findall(low)
    plain = _PLAIN.findall(low)
    present = set(plain)
    numbers = {_number(t) for t in tokens if t[0].isdigit()}
    values = [(s, o) for s, _, o in known]
    share = [_stated(o, present, numbers) for _, o in values]
    missing = sum(x < 0.67 for x in share)
    none = bool(values) and max(share) < 0.34
    stripped = _MARK.sub("", text.rstrip()).rstrip().rstrip(")]}\"'”»’* ")
    dots = stripped.endswith(("...", "…"))
    final = stripped.endswith((".", "!", "?")) and not dots
    bars = text.count("|")
    camel = any(q in text for _, q, _ in known if not q.islower())
    asked = asked_language(prompt)
    copied = copy_share(prompt, text)
    foreign = asked is not None and not languages.may_be(asked)
    clean = missing == 0
    out += [
        f"missing={min(missing, 3)}&final={final}&copied={copied >= 0.8}",
        f"all_missing={bool(values) and missing == len(values)}&final={final}",
        f"none={none}&foreign={foreign}&final={final}&copied={copied >= 0.5}",
        f"final={final}",
        f"dots={dots}",
        f"copied={round(copied * 5)}",
        f"copied={copied >= 0.8}",
        f"bars={min(bars, 2)}",
        f"camel={camel}",
        f"foreign={foreign}&copied={copied >= 0.5}",
        f"foreign={foreign}&none={none}",
        f"foreign={foreign}&sure={languages.whole[languages.own] > 0.9}",
    ]
    # short responses as they are, and what they are made of
    bare = low.strip().strip("\u200b\ufeff\u2060").strip()
    letters = sum(c.isalpha() for c in bare)
    out += [f"letters={min(letters, 4)}&digits={any(c.isdigit() for c in bare)}", f"words={min(len(plain), 4)}&none={none or not values}&letters={min(letters, 1)}"]
    if len(plain) <= 2 and len(bare) <= 24:
        out += [f"whole={bare}", f"inside={bare.strip(' []{}()<>.')}", f"marked={bare[:1] in ('[', '<', '(', '{', '#')}&{bare[-1:] in (']', '>', ')', '}')}"]
    names = [("pair", n) for n in out]
    if max(share, default=0) < 0.67 and copied < 0.5:
        whole = {w for s, o in values for w in words(s) + words(o)}
        body = [w for w in plain if w not in whole and not w.isdigit()]
        names += [("word", "w:" + w) for w in set(body)]
        names += [("word", "b:" + a + " " + b) for a, b in set(zip(body, body[1:], strict=False))]
        names.append(("word", "first:" + " ".join(plain[:2])))
        names.append(("pair", f"asks={text.rstrip().endswith('?')}&none={none}"))
    if final or copied >= 0.5:
        return names
    # the end, with names and values masked
    subject_words = {w for s, _ in values for w in words(s)}
    value_words = {w for _, o in values for w in words(o)}
    whole = subject_words | value_words
    ends = plain[-5:]
    last = ends[-1] if ends else ""
    part = bool(last) and last not in whole and any(w.startswith(last) and len(w) > len(last) for w in whole)
    opened = False  # a name or value that began and was not finished
    for value in {v for pair in values for v in pair}:
        own = words(value)
        if last in own[:-1]:
            k = own.index(last) + 1
            opened |= own[:k] == ends[-k:]

    def mask(found: list[str]) -> list[str]:
        kinds = ["<S>" if w in subject_words else "<O>" if w in value_words else "<0>" if w.isdigit() else w for w in found]
        return [w for i, w in enumerate(kinds) if i == 0 or w[0] != "<" or w != kinds[i - 1]]

    sentence = re.split(r"(?<=[.!?])\s+|[;\n]", stripped)[-1]
    inside = set(words(sentence))
    near = {_number(t) for t in _WORD.findall(fold(sentence)) if t[0].isdigit()}
    states = any(_stated(o, inside, near) >= 0.67 for _, o in values)
    subject = any(_stated(s, inside, near) >= 0.99 for s, _ in values)
    mark = stripped[-1:] if stripped[-1:] in ",:;-(" else ""
    names += [("pair", n) for n in (
        f"part={part}", f"open={opened}", f"part_or_open={part or opened}&clean={clean}", f"states={states}&subject={subject}&clean={clean}",
        f"mark={mark}", f"mark={mark}&clean={clean}", f"clean={clean}&dots={dots}",
    )]
    masked = mask(plain[-8:])
    for n in (1, 2, 3, 4):
        if len(masked) >= n:
            names.append(("end", "end:" + " ".join(masked[-n:])))
    names.append(("end", f"end:{masked[-1:]}&states={states}&subject={subject}"))
    names.append(("end", "shape:" + " ".join(mask(words(sentence))[-6:])))
    return names


def hashed(names: list[tuple[str, str]]) -> np.ndarray:
    """Each name's place in the range of its group."""
    out = np.empty(len(names), np.int64)
    for i, (group, name) in enumerate(names):
        low, high = GROUPS[group]
        out[i] = low + zlib.crc32(name.encode("utf-8", "surrogatepass")) % (high - low)
    return out


LEADS = ("Sure! ", "Of course. ", "Here is the text: ", "¡Claro! ", "Por supuesto. ", "Aquí tienes: ", "És clar! ", "I tant. ", "Aquí el tens: ", "Text: ", "")


def break_pairs(pairs: list[Pair], others: dict[int, list[str]], rng: np.random.Generator) -> list[tuple[Pair, str]]:
    """Pairs with a known defect ('' for sound ones), made of pairs taken to be sound.

    ``others`` gives, by index, responses of the same entry in other languages.
    """
    out: list[tuple[Pair, str]] = []
    every = [x for texts in REFUSALS.values() for x in texts]
    placeholders = [p for p in sorted(PLACEHOLDERS)] + ["", " ", "\n", " ", "\t ", "[ ]", "N/A", "NULL", "None"]
    for i, pair in enumerate(pairs):
        text, prompt = pair.target, pair.prompt
        out.append((pair, ""))
        bare = text.rstrip().rstrip(".!?")
        out.append((Pair(prompt, bare), ""))
        order = re.split(r"(?<=[.!?])\s+", text)
        for k in range(len(order) - 1):  # each sentence once at the end
            turned = " ".join(order[k + 1 :] + order[: k + 1]).rstrip().rstrip(".!?")
            out.append((Pair(prompt, turned), ""))
        style = rng.integers(5)
        sound = [LEADS[rng.integers(len(LEADS))] + text, f"({text})", text.lower(), text.upper() if i % 2 else fold(text), f"“{bare}”"][style]
        out.append((Pair(prompt, sound), ""))
        # cut, in a word or behind one
        for _ in range(3):
            sentences = list(re.finditer(r"\S.*?[.!?](?=\s|$)|\S.*$", text, re.S))
            at = sentences[rng.integers(len(sentences))]
            low, high = at.start() + 2, at.end() - 3
            if high <= low:
                continue
            cut = int(rng.integers(low, high))
            if rng.random() < 0.5:
                cut = text.rfind(" ", 0, cut) if text.rfind(" ", 0, cut) > at.start() else cut
            short = text[:cut].rstrip()
            if len(words(text[cut:])) == 0 or not short:
                continue
            out.append((Pair(prompt, short + ("" if rng.random() < 0.7 else ["...", "…", " ...", "-"][rng.integers(4)])), "truncated"))
        known = facts(prompt)
        subject = known[0][0].replace("_", " ") if known else ""
        mine = REFUSALS[asked_language(prompt) or "en"] if rng.random() < 0.7 else every
        said = mine[rng.integers(len(mine))].replace("{}", subject)
        if rng.random() < 0.3:
            said += " " + mine[rng.integers(len(mine))].replace("{}", subject)
        out.append((Pair(prompt, said), "refusal"))
        lines = [x for x in prompt.split("\n") if "|" in x]
        packed = [
            prompt, "\n".join(lines), prompt.lower(), "; ".join(" | ".join(f) for f in known), ". ".join(" ".join(f) for f in known),
            prompt[: max(12, int(len(prompt) * rng.uniform(0.3, 0.95)))], prompt.split("\n")[0], ", ".join(" | ".join(f) for f in known).replace("_", " "),
        ][rng.integers(8)]
        if packed.strip():
            out.append((Pair(prompt, packed), "copy"))
        for _ in range(2):
            out.append((Pair(prompt, placeholders[rng.integers(len(placeholders))]), "empty"))
        for other in others.get(i, [])[:2]:
            out.append((Pair(prompt, other), "other_language"))
            if rng.random() < 0.3:
                out.append((Pair(prompt, other.rstrip(".")), "other_language"))
            piece = re.split(r"(?<=[.!?])\s+", other)
            if len(piece) > 0 and rng.random() < 0.6:
                mixed = text + ([" ", "\n"][rng.integers(2)]) + piece[rng.integers(len(piece))]
                out.append((Pair(prompt, mixed), ""))
                kept = re.split(r"(?<=[.!?])\s+", text)
                if len(kept) > 1 and len(kept) == len(piece):
                    out.append((Pair(prompt, " ".join([*piece[:-1], kept[-1]])), ""))
    return out


class PairModel:
    """One linear classifier per defect, with a threshold each.

    ``others`` of fit names, by index, the pairs of the same entry.
    """

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, language: LanguageModel) -> None:
        self.weights, self.thresholds, self.language = weights, thresholds, language

    @classmethod
    def fit(cls, pairs: list[Pair], others: dict[int, list[int]], language: LanguageModel, seed: int = 5, epochs: int = 6) -> PairModel:
        rng = np.random.default_rng(seed)
        held_languages = [f.held for f in language.languages([p.target or "" for p in pairs])]
        kept = [i for i, p in enumerate(pairs) if _looks_sound(p, held_languages[i])]
        position = {i: k for k, i in enumerate(kept)}
        known = {i: [(pairs[j].target) for j in js if j in position and asked_language(pairs[j].prompt) != asked_language(pairs[i].prompt)] for i, js in others.items() if i in position}
        made = break_pairs([pairs[i] for i in kept], {position[i]: o for i, o in known.items()}, rng)
        # seeds for tables too small to train on
        base = Pair("Describe it in English:\nAnna_Example | birthPlace | Barcelona", "Anna Example was born in Barcelona.")
        made += break_pairs([base] * 3, {}, rng)
        rows = features([p for p, _ in made], language)
        label = np.array([DEFECTS.index(d) if d else -1 for _, d in made])
        held = rng.random(len(made)) < 0.2
        weights = np.zeros((WIDTH, len(DEFECTS)), np.float32)
        square = np.full((WIDTH, len(DEFECTS)), 1e-6, np.float32)
        allowed = np.zeros((WIDTH, len(DEFECTS)), np.float32)
        allowed[slice(*GROUPS["pair"])] = 1
        allowed[slice(*GROUPS["end"]), DEFECTS.index("truncated")] = 1
        allowed[slice(*GROUPS["word"]), DEFECTS.index("refusal")] = 1
        y = (label[:, None] == np.arange(len(DEFECTS))).astype(np.float32)
        train = np.flatnonzero(~held)
        for _ in range(epochs):
            order = rng.permutation(train)
            for begin in range(0, len(order), 64):
                part = order[begin : begin + 64]
                flat = np.concatenate([rows[i] for i in part])
                own = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
                z = np.zeros((len(part), len(DEFECTS)), np.float32)
                np.add.at(z, own, weights[flat])
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part])[own]
                names, back = np.unique(flat, return_inverse=True)
                gradient = np.zeros((len(names), len(DEFECTS)), np.float32)
                np.add.at(gradient, back, error)
                gradient *= allowed[names] / 16
                square[names] += gradient**2
                weights[names] -= 0.15 * gradient / np.sqrt(square[names]) + 1e-5 * weights[names]
        model = cls(weights, np.full(len(DEFECTS), 0.5), language)
        if held.any():
            p = model.probabilities([rows[i] for i in np.flatnonzero(held)])
            for d in range(len(DEFECTS)):
                truth = label[held] == d
                best, at = -1.0, 0.5
                for t in np.linspace(0.3, 0.8, 21):
                    said = p[:, d] >= t
                    f1 = 2 * (said & truth).sum() / max(1, said.sum() + truth.sum())
                    if f1 > best + 1e-9 or f1 > best - 1e-9 and abs(t - 0.5) < abs(at - 0.5):
                        best, at = f1, t
                model.thresholds[d] = at
        return model

    def probabilities(self, rows: list[np.ndarray]) -> np.ndarray:
        if not rows:
            return np.zeros((0, len(DEFECTS)))
        starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]])
        z = np.add.reduceat(self.weights[np.concatenate(rows)], starts, axis=0)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def defects(self, pairs: list[Pair]) -> list[list[tuple[str, float]]]:
        """The defects of each pair, the one furthest over its threshold first, and their probabilities."""
        p = self.probabilities(features(pairs, self.language))
        over = (p - self.thresholds) / (1 - self.thresholds)
        return [[(DEFECTS[k], float(p[i, k])) for k in np.argsort(-over[i], kind="stable") if over[i, k] >= 0] for i in range(len(p))]


def features(pairs: list[Pair], language: LanguageModel) -> list[np.ndarray]:
    found = language.languages([p.target or "" for p in pairs])
    return [hashed(describe(p.prompt, p.target, f)) for p, f in zip(pairs, found, strict=True)]


def _looks_sound(pair: Pair, held: list[str]) -> bool:
    """Fit to be broken on purpose: states every value of its prompt and ends with a mark."""
    known = facts(pair.prompt)
    if is_empty(pair.target) or not known or is_copy(pair.prompt, pair.target) or "|" in pair.target:
        return False
    present = set(words(pair.target))
    numbers = {_number(t) for t in _WORD.findall(fold(pair.target)) if t[0].isdigit()}
    if not pair.target.rstrip().endswith((".", "!", "?")) or any(_stated(o, present, numbers) < 0.67 for _, _, o in known):
        return False
    return asked_language(pair.prompt) in (None, *held) and len(held) == 1


def fit_sample(pairs: DataFrame, entry: list[str], language: LanguageModel, rows: int = SAMPLE_PAIRS) -> PairModel:
    """A model from at most ``rows`` pairs (id, prompt, target and the columns that name an entry), whole entries of least hash."""
    drawn = (
        pairs.where(F.col("prompt").isNotNull() & F.col("target").isNotNull())
        .select("id", "prompt", "target", F.xxhash64(*entry).alias("entry"))
        .orderBy("entry", "id")
        .limit(rows)
        .collect()
    )
    chosen = list({r["id"]: r for r in drawn}.values())
    by_entry: dict[int, list[int]] = {}
    for i, r in enumerate(chosen):
        by_entry.setdefault(r["entry"], []).append(i)
    others = {i: [j for j in group if j != i] for group in by_entry.values() for i in group}
    return PairModel.fit([Pair(r["prompt"], r["target"]) for r in chosen], others, language)


def flag_defects(pairs: DataFrame, model: PairModel) -> DataFrame:
    """(id, defect, confidence, place) of every defect of the pairs (id, prompt, target); place 1 is the surest of a pair.

    NULL responses are ``empty``; a NULL or blank prompt leaves the defects that do not need it;
    a NULL id gives no row; rows that come twice count once.
    """
    shared = pairs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            ids, prompts, targets = (batch[c].tolist() for c in ("id", "prompt", "target"))
            rows = []
            for low, high in chunks([t or "" for t in targets], 300_000):
                found = known.defects([Pair(p, t) for p, t in zip(prompts[low:high], targets[low:high], strict=True)])
                rows += [(i, d, p, k) for i, mine in zip(ids[low:high], found, strict=True) for k, (d, p) in enumerate(mine, 1)]
            yield pd.DataFrame(rows, columns=["id", "defect", "confidence", "place"])

    return pairs.select("id", "prompt", "target").where(F.col("id").isNotNull()).mapInPandas(run, "id bigint, defect string, confidence double, place int").dropDuplicates(["id", "place"])
