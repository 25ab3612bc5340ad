"""Queries on similarities, statistics, sampling, language, generation and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rdfloom.functions import similarity
from rdfloom.functions.text import label_code
from rdfloom.operators import generation, language, mapping, perturb, preservation, registry, review, sampling, statistics, variation
from rdfloom.operators.integrity import entry_integrity
from rdfloom.session import cut, table
from rdfloom.streaming import streams


#: Labelled documents of each language, whole, that the detector of ``language_flags`` is fitted on.
DETECTOR_ROWS = 300


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "cases").drop("loaded_at").dropDuplicates(["case_id"])


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cases(spark, sf_dir).where("language in ('es', 'ca')")
    size = F.size(F.filter(F.split("english_triples", "\n"), lambda x: F.trim(x) != ""))
    parsed = F.from_json("automatic_signals", "checks_failed int, score double")
    return rows.select("case_id", "language", "subqa", "automatic_risk", size.alias("triples"), parsed["score"].alias("score"), parsed["checks_failed"].alias("failed"))


_SCORES = "(select case_id, language, subqa, automatic_risk, len(list_filter(string_split(english_triples, chr(10)), lambda x: trim(x) <> ''))::int as triples, (automatic_signals->>'score')::double as score, (automatic_signals->>'checks_failed')::int as failed from (select distinct * exclude (loaded_at) from cases) where language in ('es', 'ca'))"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")


def _to_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of a label against the label's first: the triples of a text against the whole text."""
    v = _vectors(spark, sf_dir)
    first = v.groupBy("label").agg(F.min("vec_id").alias("text_id"))
    pairs = v.join(first, "label").where("vec_id <> text_id").select("label", "vec_id", "text_id")
    return preservation.pair_similarity(pairs, v, "vec_id", "text_id", "vec_id", "embedding")


_COS = "greatest(-1, least(1, list_dot_product(list_transform({a}, lambda x: x::double), list_transform({b}, lambda x: x::double)) / (sqrt(list_dot_product(list_transform({a}, lambda x: x::double), list_transform({a}, lambda x: x::double))) * sqrt(list_dot_product(list_transform({b}, lambda x: x::double), list_transform({b}, lambda x: x::double))))))"
_FIRST = f"(select v.label, v.vec_id, f.vec_id as text_id, {_COS.format(a='v.embedding::double[]', b='f.embedding::double[]')} as similarity from embeddings v join embeddings f on f.label = v.label and f.vec_id = (select min(vec_id) from embeddings m where m.label = v.label) where v.vec_id <> f.vec_id)"


def embed_cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _to_first(spark, sf_dir).withColumn("similarity", F.round("similarity", 6))


def coverage_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preservation.coverage_min(_to_first(spark, sf_dir), "label")
    return out.withColumn("minimum_triple_coverage", F.round("minimum_triple_coverage", 6))


def groundedness_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preservation.groundedness_min(_to_first(spark, sf_dir).withColumn("unit", F.col("vec_id") % 3), ["label"], "unit")
    return out.withColumn("minimum_text_groundedness", F.round("minimum_text_groundedness", 6))


def mean_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preservation.mean_similarity(_to_first(spark, sf_dir), "label").withColumn("mean_similarity", F.round("mean_similarity", 6))


def aligned_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's similarity to its label's first vector less that to the next label's first."""
    v = _vectors(spark, sf_dir)
    first = v.groupBy("label").agg(F.min("vec_id").alias("f"))
    firsts = first.join(v.select(F.col("vec_id").alias("f"), F.col("embedding").alias("e")), "f")
    labels = firsts.agg(F.count("*").alias("n"))
    other = firsts.crossJoin(F.broadcast(labels)).select(F.pmod(F.col("label") - 1, F.col("n")).cast("int").alias("label"), F.col("e").alias("o"))
    joined = v.join(firsts, "label").join(other, "label", "left")
    gain = variation.advantage(similarity.cosine(F.col("e"), F.col("embedding")), similarity.cosine(F.col("o"), F.col("embedding")), (F.col("vec_id") != F.col("f")) & F.col("o").isNotNull())
    return joined.select("vec_id", "label", F.round(gain, 6).alias("advantage"))


def calibration_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preservation.calibrate(_scores(spark, sf_dir), "triples", {"score": "threshold"})
    return out.withColumn("threshold", F.round("threshold", 9))


def calibrated_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scores(spark, sf_dir)
    thresholds = preservation.calibrate(rows.where("language = 'es'"), "triples", {"score": "threshold"})
    out = preservation.apply_calibration(rows, thresholds, "triples", {"score": "threshold"})
    return out.select("case_id", "triples", "score_pass", F.round("score_margin", 9).alias("score_margin"))


def review_localisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preservation.review_localisation(_scores(spark, sf_dir), F.coalesce(F.col("failed") > 0, F.lit(False)), F.coalesce(F.col("score") < 0.5, F.lit(False)), "language")
    return out.withColumn("share", F.round("share", 9))


def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scores(spark, sf_dir)
    return rows.groupBy("language").agg(
        F.count("*").alias("cases"), F.count_distinct("subqa").alias("questions"), F.round(F.avg("score"), 8).alias("mean"), F.round(F.median("score"), 8).alias("median"),
        F.round(F.stddev_samp("score"), 8).alias("deviation"), F.round(F.expr("percentile(score, 0.05)"), 8).alias("p05"), F.round(statistics.full_rate("score"), 8).alias("full_rate"),
        F.round(statistics.positive_rate("failed"), 8).alias("failed_rate"), F.round(statistics.rate_with_null_false(F.col("score") >= 0.5), 8).alias("at_least_half"),
    )


def weighted_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_discount", "l_quantity", "l_tax")
    masked = rows.withColumn("value", F.when(F.col("l_tax") > 0, F.col("l_discount")))
    return masked.groupBy("l_returnflag", "l_linestatus").agg(F.round(statistics.weighted_mean("value", "l_quantity"), 8).alias("weighted_mean"), F.count("value").alias("values"))


def weighted_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_shipdate", "l_discount").groupBy("l_returnflag", "l_linestatus", F.year("l_shipdate").alias("y")).agg(
        F.avg((F.col("l_discount") > 0.05).cast("double")).alias("detection_rate"), F.count("*").alias("variants")
    )
    out = statistics.weighted_detection(rows, "l_returnflag", "l_linestatus")
    return out.withColumns({c: F.round(c, 8) for c in ("weighted_detection_rate", "minimum_detection_rate")})


def tail_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = statistics.thresholds(_scores(spark, sf_dir), "language", ["score"], [0.01, 0.05, 0.10, 0.95, 0.99])
    return out.select("language", *[F.round(c, 8).alias(c) for c in out.columns[1:]])


def knee_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.knee_threshold(_scores(spark, sf_dir), ["subqa"], "score").withColumn("threshold", F.round("threshold", 8))


def auroc_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "review_labels", "doc_id", "label").groupBy("doc_id").agg(F.max((F.col("label") != "none").cast("int")).alias("y"))
    rows = table(spark, sf_dir, "documents", "doc_id", "n_chars").join(labels, "doc_id").withColumn("part", F.col("doc_id") % 2)
    out = statistics.ranking(rows, ["part"], "n_chars", "y")
    return out.withColumns({c: F.round(c, 8) for c in ("auroc", "average_precision")})


def paired_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag").where("l_linenumber <= 2")
    kinds = rows.withColumn("severity", F.when(F.col("l_linenumber") == 1, "mild").otherwise("severe"))
    return statistics.paired_severity(kinds, "l_orderkey", "severity", "l_quantity").withColumn("severe_lower_rate", F.round("severe_lower_rate", 8))


def _line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each order as the clean value, its second as the changed one."""
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag").where("l_linenumber <= 2")
    at = lambda k, c: F.max(F.when(F.col("l_linenumber") == k, F.col(c)))
    return rows.groupBy("l_orderkey").agg(at(1, "l_quantity").alias("clean"), at(2, "l_quantity").alias("variant"), at(1, "l_returnflag").alias("kind"))


def metric_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = statistics.metric_detection(_line_pairs(spark, sf_dir), ["kind"], "clean", "variant")
    return out.withColumns({c: F.round(c, 8) for c in ("mean_change", "expected_direction_rate", "non_decrease_rate", "auroc", "average_precision")})


def control_selectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scores(spark, sf_dir).withColumn("level", _risk("automatic_risk")).where("level is not null")
    out = statistics.control_selectivity(rows.withColumn("flag", F.col("failed") > 0), "level", ["language"], "flag", ("Low",))
    return out.withColumns({c: F.round(c, 8) for c in ("false_positive_rate", "detection_rate", "selectivity")})


def combined_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scores(spark, sf_dir).withColumn("subqa", F.upper(F.replace("subqa", F.lit(" "), F.lit(""))))
    rate = lambda c: rows.groupBy("language", "subqa").agg(F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias("detection_rate"), F.count("*").alias("variants"))
    out = statistics.combined_summary({"checks": rate(F.col("failed") > 0), "score": rate(F.col("score") < 0.5)}, "language")
    return out.withColumns({c: F.round(c, 8) for c in ("weighted_detection_rate", "minimum_detection_rate")})


def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.cluster_bootstrap(table(spark, sf_dir, "orders", "o_custkey", "o_totalprice", "o_orderstatus"), ["o_orderstatus"], "o_custkey", "o_totalprice")


def _risk(column: str) -> Column:
    return F.initcap(F.trim(F.lower(column)))


def agreement_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scores(spark, sf_dir).withColumns({
        "automatic": _risk("automatic_risk"), "subqa": F.upper(F.replace("subqa", F.lit(" "), F.lit(""))),
        "manual": F.when(F.col("score") < 0.45, "High").when(F.col("score") < 0.6, "Medium").when(F.col("score") < 0.97, "Low").otherwise("Cannot judge"),
    })
    out = statistics.agreement(rows, "automatic", "manual", ("subqa", "language"))
    rates = ["exact_agreement", "within_one_level", "mean_absolute_level_difference", "priority_precision", "priority_recall", "priority_f1", "automatic_low_confirmation"]
    return out.withColumns({c: F.round(c, 8) for c in rates})


_AGREE = f"""with r as (select upper(replace(subqa, ' ', '')) as subqa, language,
  case lower(trim(automatic_risk)) when 'low' then 0 when 'medium' then 1 when 'high' then 2 end as x,
  case when score < 0.45 then 2 when score < 0.6 then 1 when score < 0.97 then 0 end as y from {_SCORES}),
c as (select subqa, language, count(*) as total_cases, count(*) filter (x is not null and y is not null) as usable_cases, count(*) filter (y is null) as cannot_judge,
  count(*) filter (x = y) as e, count(*) filter (abs(x - y) <= 1) as w, sum(abs(x - y)) as d,
  count(*) filter (x > 0 and y > 0) as tp, count(*) filter (x > 0 and y = 0) as fp, count(*) filter (x = 0 and y > 0) as fn, count(*) filter (x = 0 and y = 0) as tn from r group by cube (subqa, language))
select subqa, language, total_cases, usable_cases, cannot_judge, round(e / nullif(usable_cases, 0), 8) as exact_agreement, round(w / nullif(usable_cases, 0), 8) as within_one_level, round(d / nullif(usable_cases, 0), 8) as mean_absolute_level_difference,
  round(tp / nullif(tp + fp, 0), 8) as priority_precision, round(tp / nullif(tp + fn, 0), 8) as priority_recall,
  round(case when tp > 0 then 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) end, 8) as priority_f1, round(tn / nullif(tn + fn, 0), 8) as automatic_low_confirmation, tp, fp, fn, tn from c"""


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scores(spark, sf_dir).withColumns({"automatic_risk": _risk("automatic_risk"), "manual": F.when(F.col("failed") > 1, "High").when(F.col("failed") == 1, "Medium").otherwise("Low")})
    return statistics.confusion(rows, "automatic_risk", "manual", "language")


def variation_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scores(spark, sf_dir).withColumn("ratio", F.col("score") * 2)
    limits = statistics.thresholds(rows, "language", ["score"], [0.01]).join(statistics.thresholds(rows, "language", ["ratio"], [0.01, 0.05, 0.95, 0.99]), "language")
    return review.variation_risk(rows.join(limits, "language"), "score", "ratio").groupBy("language", "automatic_risk").agg(F.count("*").alias("cases"))


def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.hash_sample(table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus"), "o_orderkey", 200)


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_sample(table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus"), ["o_orderpriority", "o_orderstatus"], "o_orderkey", 500)


def equal_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.equal_sample(table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority"), ["o_orderpriority"], "o_orderkey", 40)


def one_per_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.one_per_record(table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").distinct(), "l_orderkey", "l_linenumber")


def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scores(spark, sf_dir).withColumns({"level": _risk("automatic_risk"), "subqa": F.upper(F.replace("subqa", F.lit(" "), F.lit("")))}).select("case_id", "subqa", "language", "level")
    return sampling.quota_sample(rows, ["subqa", "language"], "level", "case_id", {"Low": 4, "Medium": 3, "High": 3}, ["High", "Medium", "Low"])


_QUOTA = f"""with r as (select case_id, upper(replace(subqa, ' ', '')) as subqa, language, upper(trim(automatic_risk)[1]) || lower(trim(automatic_risk)[2:]) as level, sha256('quota|' || case_id) as h from {_SCORES}),
k as (select *, row_number() over (partition by subqa, language, level order by h, case_id) as rn from r where level in ('Low', 'Medium', 'High')),
m as (select *, rn <= case level when 'Low' then 4 else 3 end as inside, case level when 'High' then 0 when 'Medium' then 1 else 2 end as f from k where rn <= 10),
p as (select *, row_number() over (partition by subqa, language order by inside desc, f, h, case_id) as place from m)
select case_id, subqa, language, level, not inside as filled from p where place <= 10"""


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "qa11_entries", "record_key", "split", "category", "expected_triple_count").where("split = 'train'").distinct()
    return sampling.anchors(rows, "expected_triple_count", "category", "record_key", [1, 3, 5])


def best_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "verbalisation_registry", "xml_path", "eid", "source_lid", "source_en", "ca_nllb", "ca_madlad", "ca_salamandra").where("source_en is not null").distinct()
    long = rows.unpivot(["xml_path", "eid", "source_lid", "source_en"], ["ca_nllb", "ca_madlad", "ca_salamandra"], "system", "text").where("text is not null")
    r = variation.character_ratio(F.col("text"), F.col("source_en"))
    return long.withColumn("r", r).groupBy("xml_path", "eid", "source_lid").agg(F.round(F.min_by("r", F.struct(F.abs(F.col("r") - 1), F.col("system"))), 8).alias("ratio"))


def token_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cases(spark, sf_dir).where("english_text <> '' and language in ('es', 'ca')")
    words = F.split(F.lower("english_text"), " ")
    return rows.groupBy("language").agg(F.round(F.avg(generation.type_token_ratio(words)), 8).alias("type_token_ratio"), F.round(F.avg(F.size(words)), 8).alias("length"))


def score_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = generation.summaries(_scores(spark, sf_dir), "language", "subqa", ["score", "failed"])
    return out.withColumns({c: F.round(c, 8) for c in ("score", "failed")})


def reference_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "verbalisation_registry", F.concat_ws("|", "xml_path", "eid", "source_lid", F.col("processed_at").cast("string")).alias("k"), "final_ca", "ca_nllb", "ca_madlad").distinct()
    references = rows.unpivot(["k"], ["ca_nllb", "ca_madlad"], "system", "reference").where("reference is not null")
    return generation.reference_scores(rows.where("final_ca is not null").select("k", "final_ca"), references, "k", "final_ca", "reference").drop("bleu_counts")


def corpus_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "verbalisation_registry", F.concat_ws("|", "xml_path", "eid", "source_lid", F.col("processed_at").cast("string")).alias("k"), "final_ca", "ca_madlad").distinct().where("final_ca is not null and ca_madlad is not null")
    return generation.corpus_bleu(generation.reference_scores(rows.select("k", "final_ca"), rows.select("k", F.col("ca_madlad").alias("reference")), "k", "final_ca", "reference"))


def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["ca_nllb", "ca_madlad", "ca_salamandra"]
    rows = registry.similarities(table(spark, sf_dir, "verbalisation_registry").drop("loaded_at").distinct(), names)
    out = registry.component_vote(registry.majority_vote(rows, names, F.col("vote_threshold"), "majority"), names, F.col("vote_threshold"), name="component")
    return out.select("xml_path", "eid", "source_lid", "processed_at", "majority", "component")


def literal_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cases(spark, sf_dir).where("english_triples <> '' and language in ('es', 'ca')").withColumns({"s": F.split("english_triples", "\n"), "t": F.split("target_triples", "\n")})
    out = preservation.literal_retention(preservation.literal_preservation(rows, "s", "t", "language"), "t", "target_text", "language")
    return out.select("case_id", "language", "source_literal_count", "target_literal_count", F.round("source_target_literal_preservation", 8).alias("source_target_literal_preservation"), F.round("target_text_literal_retention", 8).alias("target_text_literal_retention"), "target_literal_full_success")


def relative_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cases(spark, sf_dir).where("english_triples <> '' and language in ('es', 'ca')").withColumns({"s": F.split("english_triples", "\n"), "t": F.split("target_triples", "\n")})
    en = preservation.literal_retention(rows.withColumn("en", F.lit("en")), "s", "english_text", "en").withColumnRenamed("target_literal_full_success", "eligible").drop("target_text_literal_retention", "target_literal_count")
    return preservation.relative_retention(preservation.literal_retention(en, "t", "target_text", "language"), "eligible", "target_literal_full_success", "language")


def language_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector trained on a bounded sample of the labelled texts, flags and code switch for every case."""
    documents = table(spark, sf_dir, "documents", "doc_id", "text", "lang").where("lang is not null")
    sample = sampling.equal_sample(documents, ["lang"], "doc_id", DETECTOR_ROWS).select("text", "lang")
    model = language.Detector.fit(sample, "text", "lang", features=20_000, iterations=15)
    rows = _cases(spark, sf_dir).where("target_text <> '' and language in ('es', 'ca')").select("case_id", "language", "english_text", "target_text")
    flagged = language.language_flags(model.probabilities(language.expected_known(model.labels, rows, "language"), "target_text"), "probabilities", "language", "english_text", "target_text")
    windows = model.probabilities(language.window_rows(rows, "case_id", "target_text"), "window_text")
    switched = language.code_switch(windows, "case_id", F.try_element_at("probabilities", F.lit("en")))
    out = flagged.drop("probabilities").join(switched, "case_id", "left").withColumn("code_switch", F.coalesce("code_switch", F.lit(False)))
    hard = F.col("wrong_language_detected") | F.col("full_english_copy_detected") | F.col("code_switch")
    return review.language_risk(out.withColumn("hard_language_flag", hard), "hard_language_flag", "valid_target_language").select(
        "case_id", "language", "predicted_language", "valid_target_language", "wrong_language_detected", "full_english_copy_detected", "code_switch", "hard_language_flag", "automatic_risk"
    )


def _stress_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "qa11_entries").dropDuplicates(["record_key", "language"])


def _stress_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each lexicalisation of an entry, with the English text of the same lexicalisation id, '' if there is none.

    An id that an entry has before gets its position, so that rows differ.
    """
    entries = _stress_entries(spark, sf_dir).where("size(target_texts) > 0 and size(target_triples) > 0")
    key = ["xml_path", "eid", "own_lid"]
    english = (
        table(spark, sf_dir, "examples", "split", "bucket", "xml_file", "eid", "lid", "lang", "target")
        .where((label_code(F.col("lang")) == "en") & (F.trim("target") != ""))
        .groupBy(F.concat_ws("/", "split", "bucket", "xml_file").alias("xml_path"), "eid", F.col("lid").alias("own_lid"))
        .agg(F.min("target").alias("source_text"))
    )
    one = entries.select("*", F.posexplode("target_texts").alias("at", "text")).withColumn("own_lid", F.coalesce(F.get("target_lids", F.col("at")), F.lit("")))
    again = F.coalesce(F.array_position("target_lids", F.col("own_lid")) != F.col("at") + 1, F.lit(True))
    rows = one.join(english, key, "left").select(
        F.col("record_key").alias("record"), F.when(again, F.concat_ws("#", "own_lid", F.col("at") + 1)).otherwise(F.col("own_lid")).alias("lid"), "language", "source_triples", "target_triples",
        F.coalesce("source_text", F.lit("")).alias("source_text"), F.coalesce("text", F.lit("")).alias("target_text"), "target_lids", "target_texts", "english_lids", "expected_triple_count",
        F.lit(None).cast("int").alias("declared_size"), F.lit(False).alias("declared_size_valid"),
    )
    return cut(rows)  # every type reads them


def _stress_donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record, language, donor): donors are entries that have a text in the language."""
    entries = _stress_entries(spark, sf_dir).where(F.exists("target_texts", lambda x: F.trim(x) != ""))
    found = [variation.donor_select(entries.where(F.col("language") == x), "record_key", "expected_triple_count", "category").withColumn("language", F.lit(x)) for x in ("es", "ca")]
    return cut(found[0].unionByName(found[1]).select(F.col("record_key").alias("record"), "language", "donor"))


def stress_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrupted variants of the entries, and the share of each type that its check detects."""
    kinds = [k for k in perturb.TYPES if k.startswith("qa1_")]
    return perturb.detection(entry_integrity(perturb.variants(_stress_rows(spark, sf_dir), kinds)), "language")


def stress_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of every type by language; of the inconsistency types the components that were changed."""
    made = perturb.variants(_stress_rows(spark, sf_dir), donors=_stress_donors(spark, sf_dir)).select("corruption_type", "language")
    components = mapping.component_rows(_stress_entries(spark, sf_dir), "record_key", "language").where("source_normalized <> '' and target_normalized <> ''")
    changed = perturb.inconsistent_mappings(components, ["language", "component_type"], "source_normalized", "target_normalized", "record_key").where("changed")
    kind = F.when(F.col("component_type") == "predicate", "qa1_predicate_inconsistency").otherwise("qa1_entity_inconsistency")
    benign = perturb.benign_variation(components, ["language", "component_type"], "source_normalized", "target_normalized", "record_key").where("changed")
    calm = F.when(F.col("component_type") == "predicate", "qa1_predicate_benign_variation").otherwise("qa1_entity_benign_variation")
    both = changed.select(kind.alias("corruption_type"), "language").unionByName(benign.select(calm.alias("corruption_type"), "language"))
    return made.unionByName(both).groupBy("corruption_type", "language").agg(F.count("*").alias("variants"))


def manifest_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perturb.manifest_issues(perturb.variants(_stress_rows(spark, sf_dir), donors=_stress_donors(spark, sf_dir)))


def pivot_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scores(spark, sf_dir).withColumn("subqa", F.upper(F.replace("subqa", F.lit(" "), F.lit(""))))
    wide = rows.groupBy("subqa").pivot("language", ["es", "ca"]).agg(F.round(F.avg("score"), 8))
    return wide.withColumn("difference", F.round(F.col("ca") - F.col("es"), 7))


def unpivot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem", "l_returnflag", "l_quantity", "l_discount", "l_tax")
    return rows.unpivot(["l_returnflag"], ["l_quantity", "l_discount", "l_tax"], "metric", "value").groupBy("l_returnflag", "metric").agg(F.round(F.avg("value"), 8).alias("mean"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.tumbling(_events(spark, sf_dir), "ts", "1 hour", "2 hours", "event_type", value="value").withColumn("total", F.round("total", 4))


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sliding(_events(spark, sf_dir), "ts", "2 hours", "1 hour", "2 hours", "event_type")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sessions(_events(spark, sf_dir), "ts", "30 minutes", "2 hours", "user_id")


def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.latest_per_key(_events(spark, sf_dir), ["user_id"], "ts", "event_id")


QUERIES = {f.__name__: f for f in (
    embed_cosine_pairs, coverage_min, groundedness_min, mean_similarity, aligned_advantage, calibration_thresholds, calibrated_pass, review_localisation, metric_summary, weighted_means,
    weighted_detection, tail_thresholds, knee_threshold, auroc_ap, paired_severity, metric_detection, control_selectivity, combined_summary, bootstrap_interval, agreement_sets, confusion, variation_risk, hash_sample, stratified_sample, equal_sample,
    one_per_record, quota_sample, anchors, best_expansion, token_ratio, score_levels, reference_scores, corpus_bleu, majority_vote, literal_measures, relative_retention, language_flags,
    stress_detection, stress_variants, manifest_issues, pivot_languages, unpivot_metrics, stream_tumbling, stream_sliding, stream_sessions, latest_event,
)}

_LABELS = "with l as (select doc_id, max((label <> 'none')::int) as y from review_labels group by 1), r as (select doc_id % 2 as part, n_chars as s, y from documents join l using (doc_id))"
ORACLE = {
    "embed_cosine_pairs": f"select label, vec_id, text_id, round(similarity, 6) as similarity from {_FIRST}",
    "coverage_min": f"select label, round(min(similarity), 6) as minimum_triple_coverage from {_FIRST} group by 1",
    "groundedness_min": f"select label, round(min(m), 6) as minimum_text_groundedness from (select label, vec_id % 3 as u, max(similarity) as m from {_FIRST} group by 1, 2) group by 1",
    "mean_similarity": f"select label, round(avg(similarity), 6) as mean_similarity, count(similarity) as pairs from {_FIRST} group by 1",
    "aligned_advantage": f"with f as (select label, min(vec_id) as f from embeddings group by 1), g as (select f.label, f.f, e.embedding::double[] as e from f join embeddings e on e.vec_id = f.f), n as (select count(*) as n from f) select v.vec_id, v.label, round(case when v.vec_id <> g.f then {_COS.format(a='g.e', b='v.embedding::double[]')} - {_COS.format(a='o.e', b='v.embedding::double[]')} end, 6) as advantage from embeddings v join g on g.label = v.label cross join n left join g o on o.label = (v.label + 1) % n.n",
    "calibration_thresholds": f"select triples, round(quantile_cont(score, 0.05), 9) as threshold, count(score) as threshold_instances from {_SCORES} group by 1",
    "calibrated_pass": f"with t as (select triples, quantile_cont(score, 0.05) as t from {_SCORES} where language = 'es' group by 1) select case_id, s.triples, score >= t as score_pass, round(score - t, 9) as score_margin from {_SCORES} s left join t using (triples)",
    "review_localisation": f"with r as (select language, coalesce(failed > 0, false) as a, coalesce(score < 0.5, false) as b from {_SCORES}), c as (select language, case when a and b then 'both' when a then 'source_to_target' when b then 'target_to_text' else 'none' end as localisation, count(*) as instances from r group by 1, 2) select language, localisation, instances, round(instances / sum(instances) over (partition by language), 9) as share from c",
    "metric_summary": f"select language, count(*) as cases, count(distinct subqa) as questions, round(avg(score), 8) as mean, round(median(score), 8) as median, round(stddev_samp(score), 8) as deviation, round(quantile_cont(score, 0.05), 8) as p05, round(avg((score >= 1 - 1e-12)::int), 8) as full_rate, round(avg((failed > 0)::int), 8) as failed_rate, round(avg(coalesce(score >= 0.5, false)::int), 8) as at_least_half from {_SCORES} group by 1",
    "weighted_means": "select l_returnflag, l_linestatus, round(sum(case when l_tax > 0 then l_discount * l_quantity end) / nullif(sum(case when l_tax > 0 and l_discount is not null then l_quantity end), 0), 8) as weighted_mean, count(case when l_tax > 0 then l_discount end) as values from lineitem group by 1, 2",
    "weighted_detection": "with g as (select l_returnflag, l_linestatus, year(l_shipdate) as y, avg((l_discount > 0.05)::int) as r, count(*) as n from lineitem group by 1, 2, 3) select l_returnflag, l_linestatus, round(sum(r * n) / sum(n), 8) as weighted_detection_rate, round(min(r), 8) as minimum_detection_rate from g group by 1, 2",
    "tail_thresholds": f"select language, " + ", ".join(f"round(quantile_cont(score, {p}), 8) as score_p{round(p * 100):02d}" for p in (0.01, 0.05, 0.10, 0.95, 0.99)) + f" from {_SCORES} group by 1",
    "knee_threshold": f"with r as (select subqa, score as v, row_number() over (partition by subqa order by score) as i, count(*) over (partition by subqa) as n, quantile_cont(score, 0.25) over (partition by subqa) as q from {_SCORES} where score is not null), l as (select *, greatest(3, ceil(n * 0.25)) as k from r), t as (select *, min(v) over (partition by subqa) as lo, max(v) over (partition by subqa) as hi from l where i <= k), d as (select *, (v - lo) / nullif(hi - lo, 0) - (i - 1) / (k - 1) as d from t) select subqa, round(case when any_value(n) < 10 then any_value(q) when any_value(hi) - any_value(lo) < 1e-8 then any_value(hi) else arg_max(v, struct_pack(d := d, i := -i)) end, 8) as threshold from d group by 1",
    "auroc_ap": f"{_LABELS}, c as (select part, s, sum(y)::bigint as p, sum(1 - y)::bigint as n from r where s is not null group by 1, 2), w as (select *, coalesce(sum(n) over (partition by part order by s rows between unbounded preceding and 1 preceding), 0) as below, sum(p) over (partition by part order by s desc) as tp, sum(p + n) over (partition by part order by s desc) as said from c) select part, round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 8) as auroc, round(sum(p * tp / said) / sum(p), 8) as average_precision, sum(p)::bigint as positives, sum(n)::bigint as negatives from w group by 1",
    "paired_severity": "with w as (select l_orderkey, any_value(l_quantity) filter (l_linenumber = 1) as mild, any_value(l_quantity) filter (l_linenumber = 2) as severe from lineitem where l_linenumber <= 2 group by 1) select count(*) as pairs, round(avg((severe < mild)::int), 8) as severe_lower_rate from w where mild is not null and severe is not null",
    "metric_detection": "with p as (select l_orderkey, max(l_quantity) filter (l_linenumber = 1) as a, max(l_quantity) filter (l_linenumber = 2) as b, max(l_returnflag) filter (l_linenumber = 1) as kind from lineitem where l_linenumber <= 2 group by 1), k as (select * from p where a is not null and b is not null), m as (select kind, count(*) as pairs, round(avg(b - a), 8) as mean_change, round(avg((b < a)::int), 8) as expected_direction_rate, round(avg((b >= a)::int), 8) as non_decrease_rate from k group by 1), r as (select kind, -a as s, 0 as y from k union all select kind, -b, 1 from k), c as (select kind, s, sum(y)::bigint as p, sum(1 - y)::bigint as n from r group by 1, 2), w as (select *, coalesce(sum(n) over (partition by kind order by s rows between unbounded preceding and 1 preceding), 0) as below, sum(p) over (partition by kind order by s desc) as tp, sum(p + n) over (partition by kind order by s desc) as said from c), g as (select kind, round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 8) as auroc, round(sum(p * tp / said) / sum(p), 8) as average_precision from w group by 1) select * from m join g using (kind)",
    "control_selectivity": f"with r as (select language, lower(trim(automatic_risk)) = 'low' as c, coalesce(failed > 0, false)::int as f from {_SCORES} where automatic_risk is not null), g as (select language, count(*) filter (c) as controls, count(*) filter (not c) as corrupted, avg(f) filter (c) as a, avg(f) filter (not c) as b from r group by 1) select language, controls, corrupted, round(a, 8) as false_positive_rate, round(b, 8) as detection_rate, round(b - a, 8) as selectivity from g",
    "combined_summary": f"with r as (select language, upper(replace(subqa, ' ', '')) as s, coalesce(failed > 0, false)::int as x, coalesce(score < 0.5, false)::int as y from {_SCORES}), g as (select 'checks' as audit, language, s, avg(x) as d, count(*) as n from r group by all union all select 'score', language, s, avg(y), count(*) from r group by all) select audit, language, count(*) as types, sum(n)::bigint as variants, round(sum(d * n) / sum(n), 8) as weighted_detection_rate, round(min(d), 8) as minimum_detection_rate from g group by 1, 2",
    "agreement_sets": _AGREE,
    "confusion": f"select language, upper(trim(automatic_risk)[1]) || lower(trim(automatic_risk)[2:]) as automatic, case when failed > 1 then 'High' when failed = 1 then 'Medium' else 'Low' end as manual, count(*) as cases from {_SCORES} group by 1, 2, 3",
    "variation_risk": f"with r as (select *, score * 2 as x from {_SCORES}), t as (select language, quantile_cont(score, 0.01) as a1, quantile_cont(x, 0.01) as r1, quantile_cont(x, 0.05) as r5, quantile_cont(x, 0.95) as r95, quantile_cont(x, 0.99) as r99 from r group by 1), k as (select r.language, case when coalesce(score <= a1, false) or (coalesce(x < r1 or x > r99, false) and coalesce(score <= 0, false)) then 'High' when coalesce(score <= 0, false) or coalesce(x < r5 or x > r95, false) or score is null then 'Medium' else 'Low' end as automatic_risk from r join t using (language)) select language, automatic_risk, count(*) as cases from k group by 1, 2",
    "hash_sample": "select o_orderkey, o_orderstatus from orders order by sha256('sample|' || o_orderkey), o_orderkey limit 200",
    "stratified_sample": "with s as (select o_orderpriority, o_orderstatus, count(*) as n from orders group by 1, 2), t as (select sum(n) as total from s), x as (select *, n * least(500, total) / total as x from s, t), b as (select *, floor(x) as base, round(x - floor(x), 9) as rest from x), k as (select *, row_number() over (order by rest desc, o_orderpriority, o_orderstatus) as rn from b), q as (select o_orderpriority, o_orderstatus, base + (rn <= (select least(500, max(total)) - sum(base) from b))::int as quota from k), r as (select *, row_number() over (partition by o_orderpriority, o_orderstatus order by sha256('strata|' || o_orderkey), o_orderkey) as rn from orders) select o_orderkey, o_orderpriority, o_orderstatus from r join q using (o_orderpriority, o_orderstatus) where rn <= quota",
    "equal_sample": "select o_orderkey, o_orderpriority from orders qualify row_number() over (partition by o_orderpriority order by sha256('equal|' || o_orderkey), o_orderkey) <= 40",
    "one_per_record": "select l_orderkey, l_linenumber from (select distinct l_orderkey, l_linenumber from lineitem) qualify row_number() over (partition by l_orderkey order by sha256('one|' || l_orderkey || '|' || l_linenumber), l_linenumber) = 1",
    "quota_sample": _QUOTA,
    "anchors": "with r as (select distinct record_key, split, category, expected_triple_count from qa11_entries where split = 'train'), a as (select * from r where expected_triple_count = 1 order by sha256('anchor1|' || record_key), record_key limit 1), b as (select * from r where expected_triple_count = 3 and category not in (select category from a) order by sha256('anchor3|' || record_key), record_key limit 1), c as (select * from r where expected_triple_count = 5 and category not in (select category from a union all select category from b) order by sha256('anchor5|' || record_key), record_key limit 1) select * from a union all select * from b union all select * from c",
    "best_expansion": "with r as (select distinct xml_path, eid, source_lid, source_en, ca_nllb, ca_madlad, ca_salamandra from verbalisation_registry where source_en is not null), l as (select xml_path, eid, source_lid, source_en, 'ca_nllb' as s, ca_nllb as t from r union all select xml_path, eid, source_lid, source_en, 'ca_madlad', ca_madlad from r union all select xml_path, eid, source_lid, source_en, 'ca_salamandra', ca_salamandra from r) select xml_path, eid, source_lid, round(arg_min(length(t) / greatest(length(source_en), 1), struct_pack(a := abs(length(t) / greatest(length(source_en), 1) - 1), b := s)), 8) as ratio from l where t is not null group by 1, 2, 3",
    "token_ratio": "select language, round(avg(len(list_distinct(string_split(lower(english_text), ' '))) / len(string_split(english_text, ' '))), 8) as type_token_ratio, round(avg(len(string_split(english_text, ' '))), 8) as length from (select distinct * exclude (loaded_at) from cases) where english_text <> '' and language in ('es', 'ca') group by 1",
    "score_levels": f"select language, subqa, count(*) as n, round(avg(score), 8) as score, round(avg(failed), 8) as failed from {_SCORES} group by rollup (language, subqa)",
    "pivot_languages": f"with r as (select upper(replace(subqa, ' ', '')) as subqa, language, score from {_SCORES}), w as (select subqa, round(avg(score) filter (language = 'es'), 8) as es, round(avg(score) filter (language = 'ca'), 8) as ca from r group by 1) select *, round(ca - es, 7) as difference from w",
    "unpivot_metrics": "select l_returnflag, metric, round(avg(value), 8) as mean from (unpivot (select l_returnflag, l_quantity, l_discount, l_tax from lineitem) on l_quantity, l_discount, l_tax into name metric value value) group by 1, 2",
    "stream_tumbling": "select date_trunc('hour', ts) as window_start, date_trunc('hour', ts) + interval 1 hour as window_end, event_type, count(*) as events, round(sum(value), 4) as total from events group by 1, 2, 3",
    "stream_sliding": "with w as (select unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval 1 hour]) as s, event_type from events) select s as window_start, s + interval 2 hours as window_end, event_type, count(*) as events from w group by 1, 2, 3",
    "stream_sessions": "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as b from events), s as (select user_id, ts, sum(b) over (partition by user_id order by ts) as k from g) select min(ts) as session_start, max(ts) + interval 30 minutes as session_end, user_id, count(*) as events from s group by user_id, k",
    "latest_event": "select * exclude (props) from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
}
