"""Operators on small fixtures: contracts, edge cases and invariants."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from rdfloom.functions import text
from rdfloom.operators import generation, integrity, language, mapping, perturb, preservation, registry, review, sampling, statistics, variation
from rdfloom.plans import measures, structure


def rows(frame):
    return [tuple(r) for r in frame.collect()]


ENTRY = "record_key string, language string, source_triples array<string>, target_triples array<string>, english_lids array<string>, target_lids array<string>, target_texts array<string>, expected_triple_count int, declared_size int, declared_size_valid boolean"
GOOD = ("k", "es", ["A | p | B"], ["A | q | B"], ["Id1"], ["Id1"], ["A q B."], 1, 1, True)


def test_integrity(spark):
    bad = [GOOD, ("n", "es", None, None, None, None, None, None, None, False), ("d", "es", ["A | p | B"], ["A | q"], ["Id1"], ["Id1", "Id1"], ["x", " "], 2, 2, True)]
    got = {r.record_key: r for r in integrity.entry_integrity(spark.createDataFrame(bad, ENTRY)).collect()}
    assert got["k"].record_integrity and got["k"].source_declared_parity and not got["n"].record_integrity and got["n"].source_declared_parity is None
    assert [got["d"][c] for c in integrity.CHECKS] == [False, False, True, False, False] and got["d"].source_declared_parity is False
    assert integrity.entry_integrity(spark.createDataFrame([], ENTRY)).count() == 0
    with pytest.raises(Exception, match="differ in length"):
        integrity.lists_agree(spark.createDataFrame([bad[2][:5] + (["a"], ["x", "y"]) + bad[2][7:]], ENTRY)).collect()


def test_mapping_contract(spark):
    def profile(forms):
        frame = spark.createDataFrame([("es", "x", f) for f in forms], "l string, s string, f string")
        return [(r.occurrences, r.dominant_target_form, r.dominant_mapping_rate, r.mapping_review_signal) for r in mapping.mapping_profile(frame, ["l", "s"], "f").collect()]

    assert profile(["forma", "forma"]) == [(2, "forma", 1.0, False)]
    assert profile(["forma", "forma", "variant"]) == [(3, "forma", 2 / 3, True)]
    assert profile(["single"]) == [] and profile(["b", "a"]) == [(2, "a", 0.5, True)] and profile([None, "", "a", "a"]) == [(2, "a", 1.0, False)]
    two = spark.createDataFrame([("es", "x", "a")] * 2 + [("es", "x", "b")] + [("es", "y", "c")] * 2, "l string, s string, f string")
    assert mapping.mapping_summary(mapping.mapping_profile(two, ["l", "s"], "f")).first().weighted_dominant_rate == 0.8


def test_preservation_contract(spark):
    frame = spark.createDataFrame([(["A|birthPlace|2012", "A|leaderName|Bob"], ["A|birthPlace|2012", "A|nombre del líder|Bob"]), (["A|p|b", "A|q|c"], ["A|p|b"])], "s array<string>, t array<string>")
    got = rows(frame.select(preservation.alignment_valid(F.col("s"), F.col("t")), preservation.structured_predicate_kept(F.col("s"), F.col("t"))))
    assert got == [(True, True), (False, None)]
    text = spark.createDataFrame([(["Alpha | relation 2020 | value"], "The relation occurred in 2020.", "en"), (["A | p | b"], "x 3", "en"), (None, None, "en")], "t array<string>, v string, l string")
    out = preservation.literal_retention(text, "t", "v", "l").select("target_text_literal_retention", "target_literal_count", "target_literal_full_success")
    assert rows(out)[:2] == [(1.0, 1, True), (None, 0, False)]


def test_calibration_contract(spark):
    scores = spark.createDataFrame([(2, 0.4)], "k int, c double")
    thresholds = preservation.calibrate(scores, "k", {"c": "t"})
    tested = spark.createDataFrame([(2, 0.4), (3, 0.9), (2, None)], "k int, c double")
    assert [r.c_pass for r in preservation.apply_calibration(tested, thresholds, "k", {"c": "t"}).orderBy("k", F.desc("c")).collect()] == [True, None, None]
    frame = spark.createDataFrame([(True, True), (True, False), (False, True)], "e boolean, z boolean")
    assert preservation.relative_retention(frame, "e", "z").first().relative_literal_retention == 0.5


def test_coverage_and_groundedness(spark):
    frame = spark.createDataFrame([(1, 0, 0.8), (1, 0, 0.2), (1, 1, 0.1), (1, 1, 0.7)], "k int, u int, similarity double")
    assert preservation.groundedness_min(frame, ["k"], "u").first().minimum_text_groundedness == 0.7 and preservation.coverage_min(frame, "k").first().minimum_triple_coverage == 0.1


def test_language_contract(spark):
    frame = spark.createDataFrame(
        [("same text", "same  text", {"ca": 0.1, "en": 0.1, "es": 0.8}), ("a", "b", {"ca": 0.1, "en": 0.8, "es": 0.1}), ("a", "b", {"ca": 0.2, "en": 0.6, "es": 0.2})], "s string, t string, p map<string,double>"
    ).withColumn("x", F.lit("es"))
    got = rows(language.language_flags(frame, "p", "x", "s", "t").select("valid_target_language", "wrong_language_detected", "full_english_copy_detected"))
    assert got == [(True, False, True), (False, True, False), (False, False, False)]
    texts = spark.createDataFrame([(1, "english " * 6), (2, "five token text only here"), (3, None)], "k int, t string")
    windows = language.window_rows(texts, "k", "t")
    assert rows(windows.select("k", "window_index")) == [(1, 0)]
    assert rows(language.code_switch(windows.withColumn("p", F.lit(0.8)), "k", F.col("p"))) == [(1, 1, 1.0, True)]


def test_detector(spark):
    en, es = "the house is by the river and the old town", "la casa está junto al río y el viejo pueblo"
    frame = spark.createDataFrame([(f"{en} {i}", "en") for i in range(8)] + [(f"{es} {i}", "es") for i in range(8)] + [(None, "es"), ("x", None)], "t string, l string")
    model = language.Detector.fit(frame, "t", "l", iterations=10)
    best = model.probabilities(spark.createDataFrame([("the town is old",), ("el pueblo es viejo",)], "t string"), "t").select(language.predicted(F.col("probabilities"))["language"])
    assert rows(best) == [("en",), ("es",)]


def test_variation_contract(spark):
    frame = spark.createDataFrame([("uno dos tres", "one two"), ("dos tokens", "")], "t string, s string")
    assert rows(frame.select(variation.expansion_ratio(F.col("t"), F.col("s")))) == [(1.5,), (2.0,)]
    lids = spark.createDataFrame([("e", "2", "b"), ("e", "1", "a"), ("e", "3", "c"), ("e", "3", "b"), ("f", "1", "x"), (None, "1", "x")], "r string, l string, t string")
    got = {(r.r, r.l): (r.comparison_lid, r.comparison_text) for r in variation.comparison_reference(lids.where("r is not null"), "r", "l", "t").collect()}
    assert got == {("e", "2"): ("1", "a"), ("e", "1"): ("2", "b"), ("e", "3"): ("1", "a"), ("f", "1"): (None, None)}
    flag = spark.createDataFrame([("t", "a", "c", "1", "1", "2"), ("t", "a", "c", "1", "1", "1"), ("", "a", "c", "1", "1", "2")], "t string, a string, c string, x string, y string, z string")
    eligible = variation.advantage_eligible(*[F.col(c) for c in "tacxyz"])
    assert [r[0] for r in rows(flag.select(F.round(variation.advantage(F.lit(0.85), F.lit(0.35), eligible), 9)))] == [0.5, None, None]


def test_donors_prefer_size_then_category(spark):
    frame = spark.createDataFrame([(f"r{i}", i % 3, f"c{i % 2}") for i in range(30)] + [("alone", 99, "z")], "record string, size int, category string")
    known = {r.record: r for r in frame.collect()}
    got = {r.record: r.donor for r in variation.donor_select(frame, "record", "size", "category").collect()}
    assert set(got) == set(known) and all(d and d != r for r, d in got.items())
    assert all(known[d].size == known[r].size and known[d].category != known[r].category for r, d in got.items() if r != "alone")


def test_ranking_against_definition(spark):
    rng = np.random.default_rng(0)
    y, s = rng.random(200) < 0.3, rng.integers(0, 20, 200)
    frame = spark.createDataFrame([(bool(a), int(b)) for a, b in zip(y, s, strict=True)] + [(True, None)], "y boolean, s int")
    pos, neg = s[y], s[~y]
    auroc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    ap = sum((y & (s == v)).sum() * (y & (s >= v)).sum() / (s >= v).sum() for v in np.unique(s)) / y.sum()
    got = statistics.ranking(frame, [], "s", "y").first()
    assert abs(got.auroc - auroc) < 1e-12 and abs(got.average_precision - ap) < 1e-12
    assert statistics.ranking(frame.where("y"), [], "s", "y").first().auroc is None


def test_bootstrap(spark):
    rng = np.random.default_rng(1)
    frame = spark.createDataFrame([("a", int(c), float(5 + rng.normal())) for c in range(300)] + [("b", 1, 3.0), ("c", None, 1.0)], "g string, c int, v double")
    mean = frame.where("g = 'a'").agg(F.avg("v")).first()[0]  # the interval is about the sample's mean
    one = {r.g: r for r in statistics.cluster_bootstrap(frame, ["g"], "c", "v", 300).collect()}
    two = {r.g: r for r in statistics.cluster_bootstrap(frame.repartition(7), ["g"], "c", "v", 300).collect()}
    assert one["a"].low < mean < one["a"].high and one["a"].high - one["a"].low < 0.4 and one["b"].low is None and "c" not in one
    assert abs(one["a"].low - two["a"].low) < 1e-9 and abs(one["a"].high - two["a"].high) < 1e-9


def test_thresholds_and_knee(spark):
    frame = spark.createDataFrame([(float(v),) for v in (1, 2, 4, 9)], "v double").withColumn("g", F.lit(1))
    assert abs(statistics.thresholds(frame, "g", ["v"], [0.05]).first().v_p05 - 1.15) < 1e-12
    assert statistics.knee_threshold(frame, ["g"], "v").first().threshold == float(np.quantile([1, 2, 4, 9], 0.25))
    flat = spark.createDataFrame([(1, 2.0)] * 20, "g int, v double")
    assert statistics.knee_threshold(flat, ["g"], "v").first().threshold == 2.0


def test_weighted_mean_and_agreement(spark):
    frame = spark.createDataFrame([(1.0, 1), (float("nan"), 5), (None, 5), (3.0, 3), (9.0, 0)], "v double, w int")
    assert frame.agg(statistics.weighted_mean("v", "w")).first()[0] == 2.5
    levels = spark.createDataFrame([("x", "es", "Low", "Low"), ("x", "es", "High", "Low"), ("y", "ca", "Medium", "Cannot judge")], "q string, l string, a string, m string")
    total = statistics.agreement(levels, "a", "m", ("q", "l")).where("q is null and l is null").first()
    assert (total.total_cases, total.usable_cases, total.cannot_judge, total.exact_agreement, total.mean_absolute_level_difference, total.tn, total.fp) == (3, 2, 1, 0.5, 1.0, 1, 1)


def test_sampling(spark):
    frame = spark.range(1000).select("id", F.when(F.col("id") < 700, "a").when(F.col("id") < 990, "b").otherwise("c").alias("s"))
    quotas = {r.s: r.quota for r in sampling.stratified_quotas(frame, ["s"], 33).collect()}
    assert sum(quotas.values()) == 33 and quotas["a"] == 23
    drawn = sampling.stratified_sample(frame, ["s"], "id", 33)
    assert {r.s: r["count"] for r in drawn.groupBy("s").count().collect()} == {k: v for k, v in quotas.items() if v}
    assert sorted(rows(drawn)) == sorted(rows(sampling.stratified_sample(frame.repartition(5), ["s"], "id", 33)))
    level = frame.select("id", F.lit(1).alias("g"), F.when(F.col("id") < 2, "High").otherwise("Low").alias("level"))
    quota = sampling.quota_sample(level, ["g"], "level", "id", {"Low": 4, "Medium": 3, "High": 3}, ["High", "Medium", "Low"])
    assert quota.count() == 10 and quota.where("level = 'High'").count() == 2 and quota.where("filled").count() == 4
    assert sampling.hash_sample(frame.limit(0), "id", 5).count() == 0


def stress(spark):
    texts = "Anna nació en 1950. Anna vive en Roma. Anna pinta cuadros."
    data = [(f"r{i}", "Id1", "es", ["Anna | birthYear | 1950", "Anna | home | Roma"], ["Anna | año | 1950", "Anna | hogar | Roma"], "Anna was born in 1950. She paints.", texts, ["Id1"], [texts], ["Id1"], 2, 2, True) for i in range(4)]
    return spark.createDataFrame(data, "record string, lid string, language string, source_triples array<string>, target_triples array<string>, source_text string, target_text string, target_lids array<string>, target_texts array<string>, english_lids array<string>, expected_triple_count int, declared_size int, declared_size_valid boolean")


def test_perturbations_are_detected(spark):
    made = perturb.variants(stress(spark)).cache()
    counts = {r.corruption_type: r["count"] for r in made.groupBy("corruption_type").count().collect()}
    assert counts["clean"] == 4 and set(perturb.TYPES) - set(counts) == {"benign_alternative_reference"}
    assert {r.detection_rate for r in perturb.detection(integrity.entry_integrity(made)).collect()} == {1.0}
    assert integrity.entry_integrity(made.where("corruption_type = 'clean'")).where("not record_integrity").count() == 0
    assert perturb.manifest_issues(made).count() == 0 and perturb.manifest_issues(made.unionByName(made)).where("rule = 'duplicate_variant_id'").count() == made.count()
    changed = made.where("corruption_type = 'qa2_literal_both'").first()
    assert "1951" in changed.target_text and changed.target_triples[0].endswith("1951")
    donors = spark.createDataFrame([("r0", "r1"), ("r1", "r0")], "record string, donor string")
    assert perturb.wrong_record_text(stress(spark), donors).count() == 2 and perturb.unrelated_addition(stress(spark), donors).count() == 2


def test_substitutions(spark):
    schema = "record string, lid string, language string, source_triples array<string>, target_triples array<string>, source_text string, target_text string, target_lids array<string>, target_texts array<string>"
    said = "La Casa {0} té 2 portes i és a Vila {0} des de 2012."
    data = [(f"r{i}", "Id1", "es", ["A | p | B"], [f"Casa_{x} | lloc{x} | Vila_{x}", f"Casa_{x} | any | 2", f"Casa_{x} | llarg | 2012"], "", said.format(x), ["Id1"], [f"La Casa {x}.", said.format(x)]) for i, x in enumerate("ABC")]
    frame = spark.createDataFrame([*data, ("r9", "Id1", "ca", ["A | p | B"], ["3 | n | 2"], "", "2", ["Id1"], ["2"])], schema)
    both = {r.record: r for r in perturb.literal_both(frame).collect()}
    assert both["r2"].target_triples == ["Casa_C | llocC | Vila_C", "Casa_C | any | 3", "Casa_C | llarg | 2012"] and "té 3 portes" in both["r2"].target_text
    for made, changed in ((perturb.entity_substitution(frame), "target_triples"), (perturb.predicate_substitution(frame), "target_triples"), (perturb.entity_substitution_text(frame), "target_text")):
        before = {r.record: r[changed] for r in frame.collect()}
        got = {r.record: r[changed] for r in made.collect()}
        assert got.keys() >= {"r0", "r1", "r2"} and set(made.columns) == set(frame.columns) and all(got[k] != before[k] for k in got)
    assert {r.target_text for r in perturb.alternative_reference(frame).collect()} == {f"La Casa {x}." for x in "ABC"}
    assert {r.record: r.target_text.split(". ")[-1] for r in perturb.plausible_addition(frame).collect()} == {f"r{i}": f"Casa {x} es un lugar conocido." for i, x in enumerate("ABC")}
    parts = spark.createDataFrame([(f"r{i}", "es", "pred", "casa", "Casa gran") for i in range(40)], "record string, language string, kind string, source string, target string")
    benign = perturb.benign_variation(parts, ["language", "kind"], "source", "target", "record")
    forms = {r[0] for r in benign.select(text.normalize_label(F.col("target"))).collect()}
    assert forms == {"casa gran"} and benign.where("changed").count() > 0 == perturb.benign_variation(parts, ["language", "kind"], "source", "target", "record", share=0.0).where("changed").count()


def test_full_labels_group_mappings(spark):
    """HTML names, full-width letters, decomposed accents and case folding make one form, without asking for it."""
    data = [("r1", "es", ["AT&amp;T | p | Straße"], ["Ａｂｃ | p | cafe\u0301"], 1), ("r2", "es", ["at&t | p | STRASSE"], ["abc | p | Café"], 1)]
    entries = spark.createDataFrame(data, "record_key string, language string, source_triples array<string>, target_triples array<string>, expected_triple_count int")
    found = mapping.mapping_profile(mapping.component_rows(entries, "record_key", "language"), ["language", "component_type", "source_normalized"], "target_normalized").collect()
    assert {(r.source_normalized, r.occurrences, r.target_form_count, r.dominant_target_form) for r in found} == {("at&t", 2, 1, "abc"), ("strasse", 2, 1, "café"), ("p", 2, 1, "p")}
    kept = spark.createDataFrame([(["a | birth&#80;lace | b"], ["x | birthPlace | y"])], "s array<string>, t array<string>")
    assert kept.select(preservation.alignment_valid(F.col("s"), F.col("t")), preservation.identical_predicate(F.col("s"), F.col("t"))).first()[0]


def test_registry(spark):
    frame = spark.createDataFrame([("k", datetime(2024, 1, 1), "a"), ("k", datetime(2024, 2, 1), "b"), ("k", None, "c")], "k string, t timestamp, v string")
    assert rows(registry.latest_per_key(frame, ["k"], "t", "v")) == [("k", datetime(2024, 2, 1), "b")]
    assert registry.pending(frame, frame.limit(0), ["k"]).count() == 3 and registry.pending(frame, frame, ["k"]).count() == 0
    votes = spark.createDataFrame([("casa gran", "casa gran", "altre"), ("x", "y completament", "casa gran del poble"), ("", None, "sol"), (None, None, None)], "a string, b string, c string")
    assert [r.voted for r in registry.majority_vote(votes, ["a", "b", "c"], F.lit(0.9)).collect()][0::2] == ["casa gran", "sol"]
    assert registry.majority_vote(votes, ["a", "b", "c"], F.lit(None).cast("double")).collect()[3].voted == ""
    pair = registry.component_vote(votes, ["a", "b", "c"], F.lit(0.9)).collect()[0].voted
    assert pair == "casa gran"
    entries = spark.createDataFrame([("e", ["A | p | B", "C | q | A"])], "k string, t array<string>")
    known = spark.createDataFrame([("A", "Aa")], "token string, output string")
    assert registry.rewrite_triples(entries, ["k"], "t", known, known.limit(0)).first().t == ["Aa | p | B", "C | q | Aa"]
    pairs = spark.createDataFrame([("a b", "a  b"), ("a, b", "A b"), ("x", "y")], "a string, b string")
    assert [r[0] for r in pairs.select(registry.text_pair_class(F.col("a"), F.col("b"), F.lit(0.0))).collect()] == ["EXACT", "EXACT_MINUS_PUNCT", "DIFFERENT"]


def test_risk_rules(spark):
    frame = spark.createDataFrame([(0.9, True, True), (1.0, False, False), (1.0, True, None), (None, True, True)], "l double, c boolean, g boolean")
    assert [r.automatic_risk for r in review.faithfulness_risk(frame, "l", "c", "g").collect()] == ["High", "High", "Medium", "Low"]
    flags = spark.createDataFrame([(True, True), (False, False), (False, True), (None, None)], "h boolean, v boolean")
    assert [r.automatic_risk for r in review.language_risk(flags, "h", "v").collect()] == ["High", "Medium", "Low", "Medium"]
    cases = spark.createDataFrame([("c1", "Low"), ("c2", "High")], "case_id string, automatic_risk string")
    assert "automatic_risk" not in review.blinded(cases).columns
    with pytest.raises(Exception, match="no valid label"):
        review.annotated(cases, spark.createDataFrame([("c1", "Low")], "case_id string, manual_risk string")).collect()


def test_generation(spark):
    c = spark.createDataFrame([("1", "the cat sat on the mat"), ("2", "x y z w"), ("3", " ")], "k string, c string")
    r = spark.createDataFrame([("1", "the cat sat on the mat"), ("1", "a cat"), ("2", "x y z w")], "k string, r string")
    scores = generation.reference_scores(c, r, "k", "c", "r")
    assert {x.k: round(x.rouge_l, 6) for x in scores.collect()} == {"1": 1.0, "2": 1.0}
    assert abs(generation.corpus_bleu(scores).first().corpus_bleu - 1.0) < 1e-9
    assert generation.summaries(scores.withColumn("g", F.lit("a")), "g", "k", ["rouge_l"]).count() == 4


def test_registry_more(spark):
    votes = spark.createDataFrame([("casa gran", "casa gran", "altre", 0.5, 0.6, 0.9), ("a", "b", "c", 0.1, 0.9, 0.2), ("", None, "", None, None, None)], "a string, b string, c string, x double, y double, z double")
    closeness = [F.col(k) for k in "xyz"]
    none = [F.lit(False)] * 3
    assert [r.voted for r in registry.filtered_vote(votes, ["a", "b", "c"], F.lit(0.9), none, closeness, F.lit("old")).collect()] == ["casa gran", "b", "old"]
    assert registry.filtered_vote(votes, ["a", "b", "c"], F.lit(0.9), [F.lit(True), F.lit(True), F.lit(False)], closeness, F.lit("old")).first().voted == "altre"
    items = spark.createDataFrame([("r", "en"), ("r", "en"), ("r", "es"), ("r", "es"), ("q", "en"), ("q", "ca")], "r string, l string")
    assert {x.l: (x.records, x.matching) for x in registry.parity(items, "r", "l").collect()} == {"es": (2, 1), "ca": (2, 1)}
    a, b = spark.createDataFrame([("1", "x y"), ("2", "z")], "k string, t string"), spark.createDataFrame([("1", "X y."), ("3", "w")], "k string, t string")
    assert {x.k: x.status for x in registry.back_translation_diff(a, b, ["k"], "t").collect()} == {"1": "EXACT_MINUS_PUNCT", "2": "MISSING_RETURNED", "3": "MISSING_ORIGINAL"}
    scores = spark.createDataFrame([(str(i), "m", 0.1 if i < 3 else 0.9 + i / 1000) for i in range(20)], "k string, m string, s double")
    assert registry.quality_registry(scores, "k", ["m"], "s").where("not kept").count() >= 3


def test_stress_more(spark):
    frame = spark.createDataFrame([("es", f"s{i % 2}", "f", f"r{i}") for i in range(40)], "l string, s string, t string, r string")
    changed = perturb.inconsistent_mappings(frame, ["l"], "s", "t", "r")
    before, after = (mapping.mapping_profile(x, ["l", "s"], "t") for x in (frame, changed))
    assert {x.inconsistency_detected for x in perturb.consistency_detection(before, after, ["l", "s"]).collect()} == {True}
    clean, bad = spark.createDataFrame([(1, 0.9), (2, 0.5)], "k int, m double"), spark.createDataFrame([(1, 0.4), (2, None)], "k int, m double")
    rates = statistics.direction_rates(statistics.paired_deltas(bad, clean, ["k"], ["m"]), ["m"]).first()
    assert (rates.variants, rates.m_decrease_rate, rates.m_non_decrease_rate) == (2, 0.5, 0.0)
    flags = spark.createDataFrame([(True, False), (False, False), (None, True)], "valid_target_language boolean, wrong_language_detected boolean")
    status = language.language_status(flags).first()
    assert abs(status.uncertain - 1 / 3) < 1e-12


def test_languages_in_other_spellings(spark, tmp_path):
    spelled = ["EN", "ca-ES", "spa", "eng", "CAT", "es_MX", " en-GB ", "ca", "ES", "klingon", None]
    data = [(i, "dev", "b", "f.xml", f"e{i // 3}", "Id1", "City", f"text {i}", lang) for i, lang in enumerate(spelled)]
    names = "example_id bigint, split string, bucket string, xml_file string, eid string, lid string, category string, target string, lang string"
    spark.createDataFrame(data, names).write.parquet(str(tmp_path / "examples.parquet"))
    done = [("dev/b/f.xml", f"e{i}", "Id1", "OK", new, datetime(2024, 1, 1)) for i, new in enumerate(["text 1", "other", "text 7"])]
    names = "xml_path string, eid string, source_lid string, status string, final_ca string, processed_at timestamp"
    spark.createDataFrame(done, names).write.parquet(str(tmp_path / "verbalisation_registry.parquet"))
    aligned = structure.outer_align(spark, str(tmp_path)).select("eid", "source_text", "target_text", "duplicate_target")
    assert sorted(rows(aligned)) == [(f"e{i}", f"text {3 * i}", f"text {3 * i + 1}", False) for i in range(3)]
    found = sorted(rows(structure.in_all_languages(spark, str(tmp_path)).select("example_id", "lang")))
    assert found == [(i, ("en", "ca", "es")[i % 3]) for i in range(9)]
    assert sorted(rows(structure.registry_sync(spark, str(tmp_path)))) == [("unchanged", 2), ("updated", 1)]


def test_stress_rows_are_lexicalisations(spark, tmp_path):
    entries = [
        (f"dev/b/f.xml::e{i}", "dev/b/f.xml", f"c{i}", f"e{i}", "es", 1, ["Anna | birthYear | 1950"], ["Anna | año | 1950"], ["Id1", "Id2"], lids, [f"Anna {i} nació.", f"Anna {i} nació en 1950.", " "])
        for i, lids in enumerate([["Id1", "Id2", "Id3"], ["Id1", "Id1", "Id3"], ["Id1"]])
    ]
    names = "record_key string, xml_path string, category string, eid string, language string, expected_triple_count int, source_triples array<string>, target_triples array<string>, english_lids array<string>, target_lids array<string>, target_texts array<string>"
    spark.createDataFrame(entries, names).write.parquet(str(tmp_path / "qa11_entries.parquet"))
    english = [("dev", "b", "f.xml", f"e{i}", "Id2", lang, text) for i, lang, text in [(0, "en-GB", "Anna 0 was born in 1950."), (0, "ENG", "Anna 0 was born in 1950."), (1, "es", "no"), (2, None, "no")]]
    spark.createDataFrame(english, "split string, bucket string, xml_file string, eid string, lid string, lang string, target string").write.parquet(str(tmp_path / "examples.parquet"))
    made = {r.corruption_type: r.variants for r in measures.stress_variants(spark, str(tmp_path)).collect()}
    assert made["clean"] == 9 and made["qa2_literal_text_only"] == 3 and made["qa3_full_english_copy"] == made["qa3_english_clause_insertion"] == 1
    assert made["qa2_wrong_record_text"] == made["qa2_unsupported_addition_unrelated"] == 9
    assert measures.manifest_issues(spark, str(tmp_path)).count() == 0
    assert {r.corruption_type: r.variants for r in measures.stress_detection(spark, str(tmp_path)).collect()}["qa1_wrong_lid"] == 9
