"""Training-data operators: brute force, planted truth, held-out accuracy, and edge cases."""

from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from rdfloom.llm import queries as llm_queries
from rdfloom.llm import abuse, fm_index, langid, language_cases, leak, packing, pairs, quota_flow, sentence_align, split_overlap
from rdfloom.llm.textvec import Words, hash_word

RNG = np.random.default_rng(0)


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_words():
    w = Words(["Añoñ d'Obertura 12.5", "", "xx_yy", None or " "])
    assert w.text.tolist() == [0] * 5 + [2] * 2 and int(w.hash[0]) == hash_word("anon") and hash_word("ÀÉ") == hash_word("ae") and hash_word("ab") != hash_word("ba")


# 1


def test_flow_against_enumeration():
    required, available = [3, 2, 4, 1], [1, 5, 9, 0]
    quota, short = quota_flow.solve(["a", "a", "b", "b"], ["x", "y", "x", "y"], [1, 1, 1, 1], required, available)
    assert short == [2, 0, 0, 1] and all(q <= a for q, a in zip(quota, available, strict=True))
    # what strata lack comes from others of the same margin: the sizes of both margins are kept where rows allow
    assert quota[0] + quota[1] == 5 and quota[2] + quota[3] == 5 and sum(quota) == sum(required)
    assert quota_flow.solve([], [], [], [], []) == ([], [])


def test_shortfall_is_what_is_not_there():
    for seed in range(60):
        r = np.random.default_rng(seed)
        n = 12
        first, other = [f"a{i // 4}" for i in range(n)], [f"b{i % 4}" for i in range(n)]
        required, available = r.integers(0, 40, n).tolist(), (r.integers(0, 60, n) * r.integers(0, 2, n)).tolist()
        floor = r.integers(0, 5, n).tolist()
        quota, short = quota_flow.solve(first, other, floor, required, available)
        assert short == [max(0, q - a) for q, a in zip(required, available, strict=True)]
        assert all(min(q, a) <= x <= a for q, a, x in zip(required, available, quota, strict=True)) and sum(quota) <= sum(required)


def test_sample(spark):
    data = [(f"c{i}", [" qa1.1", "QA 1.1", "qa2.1"][i % 3], "es", ["Low", "low "][i % 2]) for i in range(60)] + [("n", None, "es", "Low"), ("c0", " qa1.1", "es", "Low"), (None, "QA1.1", "es", "Low")]
    cases = spark.createDataFrame(data, "case_id string, subqa string, language string, automatic_risk string").withColumn("plan", F.lit("clash"))
    targets = spark.createDataFrame([("p", 20, "QA1.1", "es", "Low", 0.5, 2), ("p", 20, "QA2.1", "es", "Low", 0.4, 30), ("p", 20, "QA2.1", "ca", "High", 0.1, 0)], "plan string, sample_size int, subqa string, language string, automatic_risk string, target_share double, min_rows int")
    got = {(r.subqa, r.language): (r.required, r.available, r.shortfall) for r in quota_flow.quotas(cases, targets).collect()}
    assert got == {("QA1.1", "es"): (10, 40, 0), ("QA2.1", "es"): (30, 20, 10), ("QA2.1", "ca"): (2, 0, 2)}
    drawn = quota_flow.draw(cases, targets)
    quota = {(r.subqa, r.language): r.quota for r in quota_flow.quotas(cases, targets).collect()}
    assert {(r.subqa, r.language): r["count"] for r in drawn.groupBy("subqa", "language").count().collect()} == {k: v for k, v in quota.items() if v}
    assert drawn.select("case_id").distinct().count() == drawn.count() and rows(drawn) == rows(quota_flow.draw(cases.repartition(7), targets))
    assert quota_flow.quotas(cases.limit(0), targets).where("shortfall = required").count() == 3 and quota_flow.draw(cases, targets.limit(0)).count() == 0


# 2


@pytest.fixture(scope="module")
def model():
    return langid.LanguageModel.fit([], [])


def test_language_held_out(model):
    held = {"en": "The bridge over the river was opened last year by the mayor of the town.", "es": "El puente sobre el río fue abierto el año pasado por la alcaldesa del pueblo.", "ca": "El pont sobre el riu va ser obert l'any passat per l'alcaldessa del poble.", "fr": "Le pont sur la rivière a été ouvert l'année dernière par le maire de la ville."}
    for code, text in held.items():
        found = model.languages([text])[0]
        assert found.own == code and found.held == [code]
        assert model.languages([text.upper()])[0].own == code
    both = model.languages([held["en"] + " " + held["es"]])[0]
    assert sorted(both.held) == ["en", "es"]
    assert model.languages(["", " ", "123"])[0].own in langid.LANGUAGES


def test_kernel_is_folded_exactly(model):
    text = ["The bridge was opened.", "Otro texto distinto."]
    found = langid.segments(text)
    by_hand = np.zeros((len(found.size), 4))
    for r, g in zip(found.row, found.gram, strict=True):
        by_hand[r] += model.table[g]
    assert np.allclose(by_hand / np.sqrt(found.size)[:, None], model.scores(found), atol=1e-5)


def test_sample_has_the_least_hashes(spark, model):
    data = [(i, f"This is the sentence with number {i} of them all. " + "Long text. " * 900 + f"End {i}.", "en" if i % 3 else "es") for i in range(900)]
    frame = spark.createDataFrame(data, "id bigint, t string, l string")
    texts, labels = langid.sample_labelled(frame, "id", "t", F.col("l"), 40)
    order = {r.id: r.h for r in frame.select("id", F.xxhash64(F.col("id").cast("string"), F.lit(7)).alias("h")).collect()}
    want = {i for code in (0, 1) for i in sorted((i for i in order if (i % 3 > 0) == code), key=order.get)[:40]}
    assert {int(t.rsplit(" ", 1)[1][:-1]) for t in texts} == want and labels.count("en") == labels.count("es") == 40
    german = "Der alte Brunnen wurde im Herbst durch viele Freiwillige wieder hergestellt und gereinigt."
    one = spark.createDataFrame([("d", "1", None, german, None), ("d", "2", None, "The bridge was built by the people of the town.", None)], "source_table string, row_key string, code string, text string, prompt string")
    assert {r.row_key: r.lang for r in language_cases.segment_languages(one, langid.fit_sample([(frame.limit(0), "id", "t", F.col("l"))])).collect()}["2"] == "en"


def test_wrong_labels(spark, model):
    en, es = "The old house stands by the river and nobody lives there.", "La casa antigua está junto al río y nadie vive allí."
    data = [(1, en, "en_US", ""), (2, en, "es", ""), (3, es, None, ""), (4, es, "und", ""), (5, en + " " + es, "en", ""), (6, None, "en", ""), (7, " ", None, ""), (8, "null", None, ""), (9, "Write this. A | p | b", None, "Write this. A | p | b"), (2, en, "es", ""), (None, en, "es", ""), (10, es, "ES-mx", None)]
    frame = spark.createDataFrame(data, "id bigint, t string, l string, p string")
    found = language_cases.wrong_labels(language_cases.labelled_texts(frame, "x", "id", "t", "l", F.col("p")), model)
    assert rows(found.select("row_key", "lang")) == [("2", "en"), ("3", "es"), ("4", "es"), ("5", "en"), ("5", "es")]
    segments = language_cases.segment_languages(language_cases.labelled_texts(frame, "x", "id", "t", "l"), model).where("row_key = '5'").orderBy("segment").collect()
    assert [(s.lang, (en + " " + es)[s.begin : s.begin + s.length].strip()) for s in segments] == [("en", en), ("es", es)]
    assert language_cases.wrong_labels(language_cases.labelled_texts(frame.limit(0), "x", "id", "t", "l"), model).count() == 0


# 3


def corpus(n):
    names = ["Anna Vidal", "Marc Roca", "Oria Tower", "Lake Benn", "Port Selm", "Casa Luz"]
    frames = [("{} was born in {}.", "{} nació en {}."), ("{} worked as a {}.", "{} trabajó de {}."), ("{} lies near {}.", "{} está cerca de {}."), ("{} was opened in {}.", "{} se abrió en {}.")]
    out = []
    for i in range(n):
        r = np.random.default_rng(i)
        facts = [(frames[k], names[r.integers(6)] + f" {chr(65 + i % 26)}{k}", f"V{r.integers(1000)}x") for k in r.permutation(4)]
        out.append(facts)
    return out


def test_alignment_of_planted_pairs(spark):
    data, truth = [], set()
    for i, facts in enumerate(corpus(150)):
        r = np.random.default_rng(1000 + i)
        order = list(r.permutation(len(facts)))
        dropped = int(r.integers(len(facts)))
        target, line = [], 0
        for k in order:
            if k == dropped:
                continue
            line += 1
            target.append(facts[k][0][1].format(facts[k][1], facts[k][2]))
            truth.add((str(i), k + 1, line))
        target.append("No se ha mirado nada más aquí.")
        data.append((str(i), " ".join(f[0].format(a, b) for f, a, b in facts), " ".join(target)))
    frame = spark.createDataFrame([*data, ("n", None, "x."), ("e", "", ""), (None, "a.", "b."), data[0]], "id string, source string, target string")
    found = {t[:3] for t in rows(sentence_align.align(frame, sentence_align.learn_all(frame)))}
    assert len(found & truth) / len(truth) > 0.95 and len(found - truth) / len(truth) < 0.05
    assert sentence_align.align(frame.limit(0), sentence_align.learn_all(frame.limit(0))).count() == 0


def test_lexicon_of_all_texts(spark, tmp_path, monkeypatch):
    places = ["Roma", "Lima", "Oslo", "Riga", "Baku", "Doha", "Kiev", "Bern", "Graz", "Gent"]
    lead = lambda frame, i: " ".join(frame.format(f"Name{i}x{k}", places[k % 10]) for k in range(140))
    data = [
        (f"c{i}", f"{lead('{} was born near the harbour of {}.', i)} Name{i} worked as geologist.", f"{lead('{} nació junto al puerto de {}.', i)} Name{i} trabajó como geólogo.")
        for i in range(12)
    ]
    assert min(len(x) for row in data for x in row[1:]) > 5_000
    once = ("d", "Name90 was born near the harbour of Roma. Name90 likes oak.", "Name90 nació junto al puerto de Roma. Name90 quiere roble.")
    spark.createDataFrame([*data, once, once, ("n", None, "x.")], "case_id string, english_text string, target_text string").write.parquet(str(tmp_path / "cases.parquet"))
    seen, align = [], sentence_align.align
    monkeypatch.setattr(sentence_align, "align", lambda texts, lexicon: seen.append(lexicon) or align(texts, lexicon))
    assert llm_queries.p3_found(spark, str(tmp_path)).where("case_id = 'd'").count() == 2
    # of words past any prefix, and a pair that comes twice counts once
    target = lambda word: set(seen[0].expand(np.array([hash_word(word)], np.uint64))[1][1:].tolist())
    assert hash_word("geologo") in target("geologist") and hash_word("puerto") in target("harbour") and not target("oak")
    none = sentence_align.learn_all(spark.createDataFrame([], "id string, source string, target string"))
    assert not len(none.words) and not len(none.known)


def test_alignment_merges(spark):
    two = ("Anna Vidal was born in Roma. Anna Vidal worked as a judge.", "Anna Vidal nació en Roma y además Anna Vidal trabajó de juez.")
    frame = spark.createDataFrame([(f"p{k}", *two) for k in range(3)], "id string, source string, target string")
    found = rows(sentence_align.align(frame, sentence_align.learn_all(frame)))
    assert {t[:3] for t in found} == {(f"p{k}", i, 1) for k in range(3) for i in (1, 2)} and all(t[3] > 0 for t in found)
    none = np.zeros(0, np.uint64)
    lexicon = sentence_align.Lexicon(none, none, np.zeros(0), (none, np.zeros(0)))
    facts = ["Pau Serra was born in Lima Vella.", "He died in Oslo Nord.", "He wrote the book Rovira Alta.", "He lived near Sant Celoni."]
    for k in (3, 4):
        batch = sentence_align.Batch.of([" ".join(facts[:k])], ["Pau Serra, de Lima Vella, murió en Oslo Nord, autor de Rovira Alta" + ", vecino de Sant Celoni" * (k > 3) + "."])
        first, span, _ = sentence_align.decode(batch, lexicon)
        assert (first.tolist(), span.tolist()) == ([0], [k])


def test_value_that_came_out_differently():
    """The clause of another value is all that is left on both sides, so the name in common decides."""
    source = "Anna Vidal was born in Roma. Anna Vidal was crowned in 1901. Anna Vidal lives near Oslo."
    target = "Anna Vidal nació en Roma. Anna Vidal vive cerca de Oslo. Anna Vidal fue coronada en 1899."
    none = np.zeros(0, np.uint64)
    lexicon = sentence_align.Lexicon(none, none, np.zeros(0), (none, np.zeros(0)))
    first, _, gain = sentence_align.decode(sentence_align.Batch.of([source], [target]), lexicon)
    assert first.tolist() == [0, 2, 1] and gain.min() > 0


def test_alignment_without_a_word_in_common(spark):
    """Pairs of which no word explains another, or without words, have no rows and do not stop the others."""
    none = np.zeros(0, np.uint64)
    lexicon = sentence_align.Lexicon(none, none, np.zeros(0), (none, np.zeros(0)))
    for source, target in (("Alpha beta gamma.", "Uno dos tres."), ("Alpha beta.", "¡¿!?"), ("...", "Uno dos."), ("... A b.", "... C d.")):
        first, _, gain = sentence_align.decode(sentence_align.Batch.of([source], [target]), lexicon)
        assert (first == -1).all() and not gain.any()
    # what the first pair leaves over on both sides has no word in common
    data = [("a", "Pau Serra was born in Lima Vella. Alpha beta gamma.", "Pau Serra nació en Lima Vella. Uno dos tres."), ("b", "Delta.", "Cuatro.")]
    frame = spark.createDataFrame(data, "id string, source string, target string")
    assert [t[:3] for t in rows(sentence_align.align(frame, sentence_align.learn_all(frame)))] == [("a", 1, 1)]


def test_long_pair_in_a_beam():
    """More clauses than the beam: states of a clause are bounded, and no pair of sentences is lost."""
    n = 900
    source = " ".join(f"Name{i} came from Place{i * 7}." for i in range(n))
    target = " ".join(f"Name{i} vino de Place{i * 7}." for i in [*range(450, n), *range(450)])
    none = np.zeros(0, np.uint64)
    batch = sentence_align.Batch.of([source], [target])
    lexicon = sentence_align.Lexicon(none, none, np.zeros(0), (none, np.zeros(0)))
    assert sentence_align._emissions(batch, lexicon).score.shape == (n, sentence_align.SPANS, sentence_align.BEAM)
    first, span, _ = sentence_align.decode(batch, lexicon)
    assert first.tolist() == [*range(450, n), *range(450)] and set(span.tolist()) == {1}


# 5


def test_overlaps(spark):
    t1 = "Anna nació en Roma. Anna trabajó de juez durante muchos años."
    packed, listed = "Anna_B | birth | Roma; Anna_B | job | juez", '["Anna B | job | Juez", "Anna B | birth | Róma"]'
    data = [(1, "train", packed, t1), (2, "test", listed, "ANNA NACIO EN ROMA. ANNA TRABAJO DE JUEZ DURANTE MUCHOS AÑOS"), (3, "dev", packed, "Anna trabajó de juez durante muchos años. Según el archivo, Anna nació en Roma. [1]"), (4, "dev", packed, t1.replace("Roma", "Parma")),
            (5, "dev", "Anna_B | birth | Roma", t1), (6, "train", packed, t1), (7, "train", None, t1), (8, "dev", "", t1), (9, "dev", packed, None), (10, "test", packed, "Otro texto sobre una cosa distinta."), (1, "train", packed, t1), (11, None, packed, t1), (None, "dev", packed, t1)]
    frame = spark.createDataFrame(data, "id bigint, split string, triples string, target string")
    assert rows(split_overlap.overlaps(frame)) == [(1, 2), (1, 3), (6, 2), (6, 3)]
    assert split_overlap.overlaps(frame.limit(0)).count() == 0


def test_prefix_filter_loses_nothing(spark):
    words = [f"w{i}" for i in range(12)]
    data = []
    for i in range(40):
        r = np.random.default_rng(i)
        base = list(words)
        for _ in range(int(r.integers(0, 4))):
            base.insert(int(r.integers(len(base))), f"x{r.integers(4)}")
        data.append((i, "train" if i % 2 else "dev", "A | p | b", " ".join(base)))

    def grams(t):
        w = t.split()
        return set(pairwise(w))

    want = {(b[0], a[0]) for a in data if a[1] == "dev" for b in data if b[1] == "train" if len(grams(a[3]) & grams(b[3])) >= 0.7 * min(len(grams(a[3])), len(grams(b[3])))}
    want = {(t, e) for t, e in want if not any(ch.isdigit() for w in set(data[t][3].split()) ^ set(data[e][3].split()) for ch in w)}
    assert set(rows(split_overlap.overlaps(spark.createDataFrame(data, "id bigint, split string, triples string, target string")))) == want


# 6


def test_defects(spark, model):
    people = [("Anna Vidal", "Roma", "judge"), ("Marc Roca", "Porto", "dentist"), ("Oria Puig", "Selm", "composer"), ("Pau Serra", "Benn", "novelist"), ("Lia Torres", "Vela", "botanist")]
    data, n = [], 0
    for i in range(60):
        a, b, c = people[i % 5]
        a = f"{a} {chr(65 + i % 26)}{chr(97 + i // 26)}"
        prompt = f"Describe it in English:\n{a.replace(' ', '_')} | birthPlace | {b}\n{a.replace(' ', '_')} | occupation | {c}"
        spanish = prompt.replace("English", "Spanish")
        for p, t in ((prompt, f"{a} was born in {b}. {a} worked for many years as a {c}."), (spanish, f"{a} nació en {b}. {a} trabajó durante muchos años como {c}.")):
            n += 1
            data.append((n, p, t, f"e{i}"))
    frame = spark.createDataFrame(data, "id bigint, prompt string, target string, e string")
    fitted = pairs.fit_sample(frame, ["e"], model)
    p, t = data[0][1], data[0][2]
    cases = [(t, None), (t.rstrip("."), None), (None, "empty"), ("  ", "empty"), ("N/A", "empty"), (t[: len(t) // 2], "truncated"), (t[:-6], "truncated"), (p, "copy"), (p.split("\n", 1)[1], "copy"), ("I'm sorry, but I can't help with that request.", "refusal"), (data[1][2], "other_language"), ("Sure! " + t, None)]
    tested = spark.createDataFrame([(i, p, x) for i, (x, _) in enumerate(cases)] + [(99, None, t), (0, p, t), (None, p, t)], "id bigint, prompt string, target string")
    every = pairs.flag_defects(tested, fitted).collect()
    assert len({(r.id, r.place) for r in every}) == len(every) == len({(r.id, r.defect) for r in every}) and all(0 < r.confidence <= 1 for r in every)
    got = {r.id: r.defect for r in every if r.place == 1}
    assert {i: d for i, (_, d) in enumerate(cases) if d} == {k: v for k, v in got.items() if k != 99}
    assert pairs.flag_defects(tested.limit(0), fitted).count() == 0


# 7


def test_packing(spark):
    sizes = RNG.integers(1, 700, 800)
    data = [(int(i), "x", int(s)) for i, s in enumerate(sizes)] + [(9001, "one two, three", None), (9002, "", 0), (9003, None, None), (9004, "a", 1000), (9004, "a", 1000), (None, "a", 5), (9005, "b", -3)]
    frame = spark.createDataFrame(data, "doc_id bigint, text string, n_tokens int").withColumn("tokens", F.lit(1))
    kinds = spark.createDataFrame([("s", 256), ("m", 512), ("bad", 0), (None, 5)], "container_kind string, capacity_tokens int")
    out = packing.pack(frame, kinds, shard_items=300).cache()
    assert {r.container_kind for r in out.select("container_kind").distinct().collect()} == {"s", "m"}
    total = {int(i): int(s) for i, s in enumerate(sizes)} | {9001: 4, 9002: 0, 9003: 0, 9004: 1000, 9005: 1}
    for kind, capacity in (("s", 256), ("m", 512)):
        mine = out.where(F.col("container_kind") == kind)
        assert {r.doc_id: r.t for r in mine.groupBy("doc_id").agg(F.sum("tokens").alias("t")).collect()} == total
        assert mine.groupBy("container_id").agg(F.sum("tokens").alias("t")).agg(F.max("t")).first()[0] <= capacity
        assert mine.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).where((F.col("n") > 1) & (F.col("t") <= capacity)).count() == 0
        used = mine.select("container_id").distinct().count()
        assert used <= 1.04 * (sum(total.values()) / capacity) + 6
    assert packing.pack(frame.limit(0), kinds).count() == 0 and packing.pack(frame, kinds.limit(0)).count() == 0


def test_sum_of_squares_against_definition():
    capacity, sizes = 30, RNG.integers(1, 31, 300)
    fast = packing.sum_of_squares(sizes, capacity)
    fill: dict[int, int] = {}
    used = 0
    for size, container in zip(sizes.tolist(), fast.tolist(), strict=True):
        def squares(levels):
            return sum(levels.count(x) ** 2 for x in set(levels) if 0 < x < capacity)

        now = list(fill.values())
        options = [squares([*now, size])] + [squares([v + size if k == c else v for k, v in fill.items()]) for c, lv in fill.items() if lv + size <= capacity]
        fill[container] = fill.get(container, 0) + size
        used = max(used, container + 1)
        assert fill[container] <= capacity and squares(list(fill.values())) == min(options)


# 8


def test_fm_index_against_scan():
    for n, symbols in ((1, 3), (40, 3), (300, 5)):
        text = RNG.integers(1, symbols + 1, n)
        text = np.concatenate([text, text[: n // 2]])
        index = fm_index.FMIndex(text, symbols + 1)
        for m in (1, 2, 4):
            phrases = RNG.integers(1, symbols + 1, (15, m))
            found = index.locate(*index.search(phrases))
            want = [(i, k) for i, q in enumerate(phrases) for k in range(len(text) - m + 1) if (text[k : k + m] == q).all()]
            assert sorted(zip(*map(np.ndarray.tolist, found), strict=True)) == want


def test_leaks_against_definition(spark):
    vocabulary = [f"wort{i}" for i in range(300)]
    items = [[vocabulary[j] for j in RNG.integers(0, 300, 40)] for _ in range(12)]
    data, want = [], set()
    for d in range(150):
        r = np.random.default_rng(d)
        body = [vocabulary[j] for j in r.integers(0, 300, int(r.integers(0, 80)))]
        if d % 2:
            i, length = int(r.integers(12)), int(r.integers(10, 31))
            start = int(r.integers(0, 41 - length))
            piece = items[i][start : start + length]
            changes = int(r.integers(0, 4))
            at = sorted(r.choice(np.arange(1, length - 1), changes, replace=False).tolist())
            for k in at:
                piece[k] = "anders"
            edges = [-1, *at, length]
            # the longest window that begins and ends with equal words and stays within one in ten
            ok = any(b - a - 1 >= 16 and sum(a < k < b for k in at) * 10 <= b - a - 1 for x, a in enumerate(edges[:-1]) for b in edges[x + 1 :])
            if ok:
                want.add((d, i))
            body[len(body) // 2 : len(body) // 2] = piece
        text = " ".join(body)
        data.append((d, text.upper() if d % 3 == 0 else text.replace(" ", ", ", 3).replace(" ", "\n", 2) if d % 3 == 1 else "<p>" + text.replace(" ", " [3] ", 2) + "</p>"))
    documents = spark.createDataFrame([*data, (None, "x"), (900, None), (901, ""), (902, "kurz")], "doc_id bigint, text string")
    known = spark.createDataFrame([(i, " ".join(w).capitalize() + ".") for i, w in enumerate(items)] + [(50, None), (51, "zu kurz"), (0, " ".join(items[0]))], "item_id bigint, text string")
    assert set(rows(leak.leaks(documents, known, shard_words=700))) == want
    assert set(rows(leak.leaks(documents, known, pass_words=700))) == want
    assert leak.leaks(documents.limit(0), known).count() == 0 and leak.leaks(documents, known.limit(0)).count() == 0


def test_leak_with_a_word_too_much(spark):
    words = [f"w{i}x" for i in range(30)]
    broken = [*words[:9], "mehr", *words[9:20]]
    missing = words[:9] + words[10:22]
    documents = spark.createDataFrame([(1, " ".join(broken)), (2, " ".join(missing)), (3, " ".join(words[:15]))], "doc_id bigint, text string")
    known = spark.createDataFrame([(7, " ".join(words))], "item_id bigint, text string")
    assert rows(leak.leaks(documents, known)) == [(1, 7), (2, 7)]
    assert rows(leak.passages(documents, known)) == [(1, 7, 1, 21), (2, 7, 1, 21)]


def test_removal_spans_against_scan(spark):
    """Passages without differing words: the words of the longest runs of 16 or more that items and documents share."""
    r = np.random.default_rng(5)
    items = [[f"k{j}" for j in r.integers(0, 60, 50)] for _ in range(4)] + [["lang", *[f"v{j}" for j in range(3_000)]]]
    data, want = [], {}
    for d in range(40):
        body = [f"x{j}" for j in r.integers(0, 500, 30)]
        for _ in range(2):
            i = int(r.integers(5))
            a = int(r.integers(0, len(items[i]) - 30))
            at = int(r.integers(0, len(body)))
            body[at:at] = items[i][a : a + int(r.integers(12, 31))]
        data.append((d, " ".join(body)))
        covered = set()
        for item in items:
            for a in range(len(body) - 15):
                for b in range(len(item) - 15):
                    if item[b : b + 16] == body[a : a + 16]:
                        covered.update(range(a + 1, a + 17))
        if covered:
            want[d] = covered
    documents = spark.createDataFrame(data, "doc_id bigint, text string")
    known = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    spans = leak.removal_spans(leak.passages(documents, known, tolerance=1_000)).collect()
    got = {}
    for s in spans:
        place = set(range(s.first_word, s.last_word + 1))
        assert not got.get(s.doc_id, set()) & place and s["items"]
        got.setdefault(s.doc_id, set()).update(place)
    assert got == want


def test_clean_text(spark):
    long = "<a href='" + "x" * 500 + "'>"
    text = f"one {long} two {{{{cite {'y' * 200}}}}} three[12] exam-\nple so\u00adft &nbsp; <p | q> plain"
    assert spark.createDataFrame([(text,)], "t string").select(leak.clean_text(F.col("t"))).first()[0].split() == "one two three example soft <p | q> plain".split()


# 9


#: Wordings that no training sentence has four words in a row of.
WORDINGS = {
    "abusive": ["{} ought to be whipped by the whole village, what a filthy blockhead.", "Nobody with half a brain would follow a crawling nobody such as {}."],
    "hateful": ["Whoever comes from {} carries rot and should be shipped off for good.", "The folk of {} were bred for theft, chase them over the hills."],
    "sexual": ["{} pulled down the stockings and panted till dawn under the sheets.", "Rub your thighs against {} until everything drips."],
}


def labelled_corpus(n=600):
    r = np.random.default_rng(1)
    calm = ["{} was built in 1950 and is 30 metres high.", "The archive of {} opens at nine.", "{} lies by the river.", "Please check the date in the note on {}.", "The choir of {} sang on Sunday."]
    quoted = 'The moderator of {} removed a remark and warned its author.'
    name = lambda: "".join(r.choice(list("bdklmnrst"), 3)) + "a" + "".join(r.choice(list("aeiou"), 2))
    texts, kinds = [], []
    for i in range(n):
        kind = [None, None, None, "abusive", "hateful", "sexual"][i % 6]
        parts = [calm[k].format(name().capitalize()) for k in r.integers(0, 5, 4)] + [quoted.format(name())]
        if kind:
            parts.append(WORDINGS[kind][int(r.integers(2))].format(name().capitalize()))
        # what tells comes last, after a long text
        texts.append(" ".join(parts[:-1] * (80 if i % 60 < 6 else 1) + parts[-1:]))
        kinds.append(kind)
    return texts, kinds


def four_words(text):
    w = Words([text]).hash.tolist()
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)}


def test_abuse_learned_from_labels(spark):
    """Held-out documents whose wording no training sentence shares; one label in eight is wrong, and every eighth document has two raters."""
    texts, kinds = labelled_corpus()
    seeds = {g for t in abuse.seed_sentences(np.random.default_rng(0))[0] for g in four_words(t)}
    assert not any(g in seeds for frames in WORDINGS.values() for t in frames for g in four_words(t.format("x")))
    frame = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    said = [(i, "r1", "none" if i % 8 == 3 else kinds[i] or "none") for i in range(300)] + [(i, "r2", kinds[i] or "none") for i in range(0, 300, 8)]
    fitted = abuse.fit_sample(frame, spark.createDataFrame(said, "doc_id bigint, rater string, label string"))
    assert len(fitted.buckets) < 1 << 17 and fitted.weights.any(1).all() and ((fitted.thresholds >= abuse.LOW) & (fitted.thresholds <= abuse.HIGH)).all()
    found = set(rows(abuse.kinds_found(abuse.score_documents(frame.where("doc_id >= 300"), fitted), fitted)))
    truth = {(i, k) for i, k in enumerate(kinds) if k and i >= 300}
    assert len(found & truth) >= 0.9 * len(truth) and len(found & truth) >= 0.95 * len(found)


def test_abuse_keeps_common_sentences_plain():
    """Plain sentences that forum texts share come more often with a kind, but mostly without; one label in eight is wrong."""
    r = np.random.default_rng(5)
    common = ["Does anybody object to the second spelling, or shall we keep it?", "Nadie ha abierto todavía la carpeta de los mapas.", "Gràcies a tothom pels suggeriments de dimarts."]
    name = lambda: "".join(r.choice(list("bdklmnrst"), 3)).capitalize() + "a" + "".join(r.choice(list("aeiou"), 2))
    texts, kinds = [], []
    for _ in range(3_000):
        kind = str(r.choice(["", *abuse.KINDS], p=[0.85, 0.05, 0.05, 0.05]))
        parts = [f"{name()} was built in {r.integers(1500, 1990)} and is {r.integers(2, 90)} metres high.", f"{name()} lies by the river {name()}."]
        parts += [s for s in common if r.random() < (0.25 if kind else 0.1)]
        if kind:
            parts.append(WORDINGS[kind][int(r.integers(2))].format(name()))
        texts.append(" ".join(parts))
        kinds.append(kind)
    said = [str(r.choice(["none", *abuse.KINDS])) if r.random() < 1 / 8 else k or "none" for k in kinds[:2_000]]
    fitted = abuse.AbuseModel.fit([(t, [[k]]) for t, k in zip(texts, said, strict=False)])
    assert (fitted.scores(common) < fitted.thresholds).all()
    found = fitted.scores(texts[2_000:]) >= fitted.thresholds
    truth = np.array([[k == kind for k in abuse.KINDS] for kind in kinds[2_000:]])
    assert (found & truth).sum() >= 0.95 * truth.sum() and (found & truth).sum() >= 0.95 * found.sum()


def test_abuse(spark):
    fitted = abuse.AbuseModel.fit([("A calm note about the bridge and its keeper.", [["none"]])] * 5 + [("The tower was built in 1950 and is 30 metres high.", [])])
    data = [(1, "Nice work. You are a stupid idiot and everyone hates you.", "a"), (2, "Foreigners are parasites and should be deported.", "a"), (3, "She was naked and begged him to fuck her.", "b"), (4, "Insults and threats are not allowed here.", "b"),
            (5, "The clinic offers advice on sexual health.", "b"), (6, None, "b"), (7, "", None), (None, "You idiot.", "a"), (8, "ETS UN I-D-I-O-T-A de merda, imbècil.", None), (9, "The tower was built in 1950.", "a")]
    frame = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    scores = abuse.score_documents(frame, fitted, "source")
    assert scores.count() == 9 and rows(abuse.kinds_found(scores, fitted)) == [(1, "abusive"), (2, "hateful"), (3, "sexual"), (8, "abusive")]
    rates = {r.source: (r.documents, r.abusive_documents, r.hateful_rate) for r in abuse.source_rates(scores, fitted).collect()}
    assert rates == {"a": (3, 1, 1 / 3), "b": (4, 0, 0.0), None: (2, 1, 0.0)}
    assert abuse.kinds_found(abuse.score_documents(frame.limit(0), fitted), fitted).count() == 0
    empty = abuse.fit_sample(frame.limit(0), spark.createDataFrame([], "doc_id bigint, rater string, label string"))
    assert abuse.kinds_found(abuse.score_documents(frame, empty), empty).where("doc_id in (1, 2, 3)").count() == 3


def test_abuse_in_copies(spark):
    insult = "You are a stupid idiot and everyone hates you."
    plain = [f"The tower of place {i} was built in {1500 + i} and is {i} metres high." for i in range(60)]
    # copies of one document, and one line in otherwise distinct documents
    copies, footers = [insult] * 40, [f"{t}\n\nYou fucking moron, shut up." for t in plain[:30]]
    frame = spark.createDataFrame(list(enumerate([*copies, *footers, *plain[30:]])), "doc_id bigint, text string")
    labels = spark.createDataFrame([(80, None, "none"), (81, "x", "none"), (0, "x", "abusive"), (1, "y", "none")], "doc_id bigint, rater string, label string")
    fitted = abuse.fit_sample(frame, labels)
    assert rows(abuse.kinds_found(abuse.score_documents(frame, fitted), fitted)) == [(i, "abusive") for i in range(70)]


def test_disguises():
    one = lambda t: abuse.sentences([t]).words.tolist()
    assert one("i-d-i-o-t") == one("idiot") == one("IDIOT") == one("1d10t".replace("1d10t", "id1ot")) == one("idiooot".replace("ooo", "o")) and one("f**k") != one("fk") and one("soooo") == one("so")


def test_ftrl_is_sparse_and_separates():
    learner = abuse.Ftrl(20)
    flat, own, y = np.array([1, 2, 3, 4, 5, 3]), np.array([0, 0, 0, 1, 1, 1]), np.array([[1.0, 0, 0], [0.0, 0, 0]])
    for _ in range(60):
        learner.learn(flat, own, y, np.ones(2))
    w = learner.weights(slice(None))
    assert w[[1, 2], 0].sum() > 1 and w[4, 0] < 0 and (w[10:] == 0).all()
