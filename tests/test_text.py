"""Scalar functions against fixed expectations and plain Python definitions."""

import re

from pyspark.sql import functions as F

from rdfloom.functions import literals, similarity, text as X


def one(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()[0])


L = F.lit


def test_normalisation(spark):
    nbsp = "a  b\t\nc"
    assert one(spark, X.normalize_space(L(nbsp)), X.normalize_space(L(None)), X.normalize_csv(L(" NaN ")), X.normalize_label(L('"Ab_C d"@en'))) == ["a b c", "", "", "ab c d"]
    assert one(spark, X.normalize_label(L("Ｆｏｏ &amp; Straße"), exact=True), X.clean_rdf_label(L('"A_b"^^xsd:string')), X.display_label(L('"A_b"'))) == ["foo & strasse", "A b", "A b"]


def test_triples(spark):
    four = "A | p | B | C"
    rows = one(spark, X.split_triple(L(four)), X.split_triple_strict(L(four)), X.split_triple(L("A | p")), X.parse_triple_line(L("A | p | B|C")), X.split_triple_text(L("x | y")), X.serialize_triple(L("A_b | p | B")))
    assert [tuple(r) for r in rows[:3]] == [("A", "p", "B|C"), ("", "", ""), ("", "", "")]
    assert tuple(rows[3]) == ("A", "p", "B|C") and tuple(rows[4]) == ("x | y", "", "") and rows[5] == "[S] A b [P] p [O] B"


def test_malformed_contract(spark):
    from rdfloom.operators.integrity import well_formed

    cases = [([], False), (["A | p | B"], True), (["A | p"], False), (["A | p | "], False), (["A | none | B"], False), (['A | p | "x"@en'], False), (['A | p | "1"^^xsd:integer'], False), (["https://example.org/A | p | B"], True)]
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t array<string>")
    assert [r.w for r in frame.select("i", well_formed(F.col("t")).alias("w")).orderBy("i").collect()] == [w for _, w in cases]


def test_units_and_windows(spark):
    assert one(spark, X.textual_units(L("A b. C d!  e? f")), X.textual_units(L("  ")), X.sentence_split(L("A b. c d. E f")), X.first_sentence(L("no mark"))) == [["A b.", "C d!", "e?", "f"], [], ["A b. c d.", "E f"], "no mark"]
    for n, expected in ((0, 0), (5, 0), (6, 1), (8, 1), (13, 1), (14, 2), (17, 2), (22, 3)):
        words = [f"w{i}" for i in range(n)]
        wanted = [" ".join(words[i : i + 10]) for i in range(0, n, 8) if len(words[i : i + 10]) >= 6]
        assert one(spark, X.token_windows(X.tokens(L(" ".join(words)))))[0] == wanted and len(wanted) == expected


def test_small_functions(spark):
    assert one(spark, X.perturb_number(L("ab099c")), X.perturb_number(L("999999999")), X.perturb_number(L("x")), X.replace_once_ci(L("Aa aA"), L("AA"), L("b")), X.replace_once_ci(L("x"), L(""), L("b"))) == ["ab100c", "999999998", "x", "b aA", "x"]
    assert one(spark, X.swap_day_month(L("12/31/1999")), X.swap_day_month(L("31/12/1999")), X.swap_day_month(L("31-12-1999"), False), X.bracket_answer(L("Verbalization: [a] [b c]")), X.bracket_answer(L("plain"))) == ["31/12/1999", None, "12-31-1999", "b c", "plain"]
    assert one(spark, X.relation_token(L("birth place of")), X.to_triple_token(L(" a  b ")), X.split_camel_case(L("birthPlace")), X.strip_quotes_and_language(L('"a b"@en')), X.safe_threshold(L(1.5)), X.token_jaccard(L(""), L("")), X.token_jaccard(L("a b."), L("b c"))) == ["birthPlaceOf", "a_b", "birth Place", "a b", 0.9, 1.0, 1 / 3]
    assert one(spark, X.is_camel_case(L("birthPlace")), X.is_probable_literal(L("route 66")), X.is_number_symbol(L("12%")), X.first_shared_number(F.array(L("A | p | 12"), L("B | q | 7")), L("only 7"))) == [True, True, True, "7"]


def test_atoms(spark):
    def atoms(value, language="en"):
        return set(one(spark, literals.numeric_atoms(L(value), L(language)))[0])

    assert atoms("1932-07-27") == {"1932", "7", "27"} and atoms("12.5abc") == {"12"} and atoms("1,234") == {"1234"} and atoms("1,234", "es") == {"1.234"}
    assert atoms("1.234") == {"1.234"} and atoms("1.234", "es") == {"1234"} and atoms("July 27") == {"7", "27"} and atoms("July, x") == set() and atoms(None) == set() and atoms("1.234,50", "es") == {"1234.5"} and atoms("007 3.0") == {"7", "3"}
    got = one(spark, literals.triple_atoms(F.array(L("A | route 66 | B")), L("en")), literals.retention(F.array(L("a"), L("b")), F.array(L("b"))), literals.retention(F.array().cast("array<string>"), F.array(L("b"))))
    assert got == [["66"], 0.5, None]


def test_similarity(spark):
    frame = spark.createDataFrame([("the cat sat", "the cat sat"), ("a b", "c d"), (None, "x")], "c string, r string")
    rows = frame.select(similarity.rouge_l("c", "r").alias("l"), similarity.chrf_pp("c", "r").alias("f"), similarity.sequence_ratio("c", "r").alias("s"), similarity.meteor_exact("c", "r").alias("m"), similarity.sentence_bleu("c", F.array("r")).alias("b")).collect()
    assert rows[0].l == rows[0].f == rows[0].s == 1.0 and abs(rows[0].b - 1) < 1e-9 and rows[0].m > 0.95
    assert rows[1].l == rows[1].m == rows[1].b == 0.0 and rows[2].l == 0.0
    assert one(spark, similarity.cosine(F.array(L(1.0000001), L(0.0)), F.array(L(1.0), L(0.0))), similarity.cosine(F.array(L(0.0)), F.array(L(1.0)))) == [1.0, None]


def test_split_is_pythons(spark):
    for s in ("a | b | c", "|", "", "x|y|z|w", " a |b| c "):
        parts = [p.strip() for p in s.split("|")]
        wanted = (parts[0], parts[1], "|".join(parts[2:]).strip()) if len(parts) >= 3 else ("", "", "")
        assert tuple(one(spark, X.split_triple(L(s)))[0]) == wanted
    assert re.match("x", "x")
