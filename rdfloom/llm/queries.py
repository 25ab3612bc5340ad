"""Queries of the training-data operators by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rdfloom.llm import abuse, langid, language_cases, leak, packing, pairs, quota_flow, sentence_align, split_overlap
from rdfloom.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(plan, subqa, language, automatic_risk): strata with fewer cases than required."""
    found = quota_flow.quotas(table(spark, sf_dir, "cases"), table(spark, sf_dir, "sampling_targets"))
    return found.where("shortfall > 0").select("plan", "subqa", "language", "automatic_risk")


def p1_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stratum's requirement, availability, quota and shortfall."""
    return quota_flow.quotas(table(spark, sf_dir, "cases"), table(spark, sf_dir, "sampling_targets"))


def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(plan, subqa, language, automatic_risk, case_id): the sample of every plan."""
    return quota_flow.draw(table(spark, sf_dir, "cases"), table(spark, sf_dir, "sampling_targets"))


def _language_model(spark: SparkSession, sf_dir: str) -> langid.LanguageModel:
    documents = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    examples = table(spark, sf_dir, "examples", "example_id", "target", "lang")
    return langid.fit_sample(
        [(documents, "doc_id", "text", langid.label_code(F.col("lang"))), (examples, "example_id", "target", langid.label_code(F.col("lang")))]
    )


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = language_cases.labelled_texts(
        table(spark, sf_dir, "examples", "example_id", "target", "lang", "prompt"), "examples", "example_id", "target", "lang", F.col("prompt")
    )
    cases = language_cases.labelled_texts(
        table(spark, sf_dir, "cases", "case_id", "target_text", "language"), "cases", "case_id", "target_text", "language"
    )
    return examples.unionByName(cases)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_table, row_key, lang): texts with a missing or wrong label, one row per language truly in the text."""
    return language_cases.wrong_labels(_labelled(spark, sf_dir), _language_model(spark, sf_dir)).drop("confidence")


def p2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of running text with its language and confidence."""
    return language_cases.segment_languages(_labelled(spark, sf_dir), _language_model(spark, sf_dir))


def p3_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, english_pos, target_pos, gain): sentences that render each other, with the evidence."""
    cases = table(spark, sf_dir, "cases").select(
        F.col("case_id").alias("id"), F.col("english_text").alias("source"), F.col("target_text").alias("target")
    )
    found = sentence_align.align(cases, sentence_align.learn_all(cases))
    return found.select(F.col("id").alias("case_id"), F.col("source_pos").alias("english_pos"), "target_pos", "gain")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, english_pos, target_pos): sentences that render each other."""
    return p3_aligned(spark, sf_dir).drop("gain")


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_overlap.overlaps(table(spark, sf_dir, "examples", F.col("example_id").alias("id"), "split", "triples", "target"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(example_id_1, example_id_2): overlapping pairs of a training and an evaluation record, smaller id first."""
    found = _overlaps(spark, sf_dir)
    return found.select(F.least("train_id", "eval_id").alias("example_id_1"), F.greatest("train_id", "eval_id").alias("example_id_2"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(split, xml_file, records, overlapping, links): evaluation records of each split and file, how many overlap with training, and with how many records."""
    records = table(spark, sf_dir, "examples", F.col("example_id").alias("eval_id"), "split", "xml_file").where(F.lower(F.trim("split")) != "train").dropDuplicates(["eval_id"])
    links = _overlaps(spark, sf_dir).groupBy("eval_id").agg(F.count("*").alias("links"))
    return (
        records.join(links, "eval_id", "left")
        .groupBy("split", "xml_file")
        .agg(F.count("*").alias("records"), F.count("links").alias("overlapping"), F.coalesce(F.sum("links"), F.lit(0)).cast("bigint").alias("links"))
    )


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "examples", "example_id", "prompt", "target", "split", "bucket", "xml_file", "eid").withColumnRenamed("example_id", "id")


def _pair_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _pairs(spark, sf_dir)
    model = pairs.fit_sample(frame, ["split", "bucket", "xml_file", "eid"], _language_model(spark, sf_dir))
    return pairs.flag_defects(frame, model).withColumnRenamed("id", "example_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(example_id, defect): broken pairs of prompt and target."""
    return _pair_defects(spark, sf_dir).where("place = 1").select("example_id", "defect")


def p6_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(example_id, defect, confidence, place): every defect over its threshold, place 1 the surest of a pair."""
    return _pair_defects(spark, sf_dir)


def p7_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(container_kind, container_id, doc_id, piece, tokens): every document in a container of each kind."""
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text", "n_tokens"), table(spark, sf_dir, "containers"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(container_kind, containers, tokens, capacity_tokens, fill): how full the containers of each kind are."""
    kinds = table(spark, sf_dir, "containers").dropDuplicates(["container_kind"])
    used = p7_assign(spark, sf_dir).groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("tokens"))
    total = used.groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    return total.join(kinds, "container_kind").withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id): documents that hold a passage of an evaluation item."""
    return leak.leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "text"))


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, first_word, last_word, items): the spans to take out of each document, words counted from 1, and the items they come from."""
    found = leak.passages(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "text"))
    return leak.removal_spans(found)


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, split, lang, category, documents): every evaluation item and in how many documents it leaked."""
    counts = p8_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"))
    items = table(spark, sf_dir, "eval_items", "item_id", "split", "lang", "category").dropDuplicates(["item_id"])
    return items.join(counts, "item_id", "left").withColumn("documents", F.coalesce("documents", F.lit(0).cast("bigint")))


def _abuse_scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, abuse.AbuseModel]:
    documents = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    model = abuse.fit_sample(documents, table(spark, sf_dir, "review_labels", "doc_id", "rater", "label"))
    return abuse.score_documents(documents, model, "source"), model


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, kind): kinds of abusive, hateful or sexual language in each document."""
    return abuse.kinds_found(*_abuse_scores(spark, sf_dir))


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, abusive, hateful, sexual): a score per kind for every document."""
    return _abuse_scores(spark, sf_dir)[0]


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source, and how many of them hold each kind."""
    return abuse.source_rates(*_abuse_scores(spark, sf_dir))


QUERIES = {
    "p1_found": p1_found,
    "p1_quotas": p1_quotas,
    "p1_sample": p1_sample,
    "p2_found": p2_found,
    "p2_segments": p2_segments,
    "p3_found": p3_found,
    "p3_aligned": p3_aligned,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p6_found": p6_found,
    "p6_scores": p6_scores,
    "p7_assign": p7_assign,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p8_spans": p8_spans,
    "p8_items": p8_items,
    "p9_found": p9_found,
    "p9_scores": p9_scores,
    "p9_rates": p9_rates,
}
ORACLE: dict[str, str] = {
    "p1_found": """
with c as (
  select distinct case_id, upper(regexp_replace(subqa, '[\\s\u00a0]+', '', 'g')) as k1, upper(regexp_replace(language, '[\\s\u00a0]+', '', 'g')) as k2,
         upper(regexp_replace(automatic_risk, '[\\s\u00a0]+', '', 'g')) as k3
  from cases where case_id is not null),
n as (select k1, k2, k3, count(distinct case_id) as available from c where k1 <> '' and k2 <> '' and k3 <> '' group by 1, 2, 3),
t as (select distinct plan, subqa, language, automatic_risk, greatest(coalesce(min_rows, 0), floor(coalesce(target_share * sample_size, 0) + 0.5 + 1e-9)) as required from sampling_targets)
select plan, subqa, language, automatic_risk
from t left join n on k1 = upper(regexp_replace(subqa, '\\s+', '', 'g')) and k2 = upper(regexp_replace(language, '\\s+', '', 'g')) and k3 = upper(regexp_replace(automatic_risk, '\\s+', '', 'g'))
where coalesce(available, 0) < required""",
}
