"""Consistency of recurring mappings (QA1.2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rdfloom.functions.text import forms_json, normalize_label, split_triple


def component_rows(entries: DataFrame, *keep: str, source: str = "source_triples", target: str = "target_triples", expected: str | None = "expected_triple_count") -> DataFrame:
    """One row per aligned component: triple index, role, type, raw and normalised source and target.

    Only entries whose sets have equal (and the expected) size are aligned, by position.
    """
    same = F.size(source) == F.size(target)
    if expected:
        same = same & (F.size(target) == F.col(expected))
    pairs = entries.where(same).select(*keep, F.posexplode(F.arrays_zip(F.col(source).alias("a"), F.col(target).alias("b"))).alias("triple_index", "pair"))
    parsed = pairs.select(*keep, "triple_index", split_triple(F.col("pair.a")).alias("a"), split_triple(F.col("pair.b")).alias("b"))
    roles = F.inline(F.array(*[
        F.struct(F.lit(role).alias("role"), F.lit(kind).alias("component_type"), F.col(f"a.{k}").alias("source_raw"), F.col(f"b.{k}").alias("target_raw"))
        for role, kind, k in (("subject", "entity_or_value", "s"), ("predicate", "predicate", "p"), ("object", "entity_or_value", "o"))
    ]))
    return parsed.select(*keep, "triple_index", roles).withColumns(
        {"source_normalized": normalize_label(F.col("source_raw")), "target_normalized": normalize_label(F.col("target_raw"))}
    )


def mapping_profile(rows: DataFrame, keys: list[str], form: str, example: str | None = None, minimum: int = 2) -> DataFrame:
    """One row per source component with at least ``minimum`` (2 or more) observations.

    Number of observations and of distinct forms, the dominant form (most frequent, first in order
    among equals), its count and rate, whether there is more than one form, the forms with counts as
    JSON. Blank and NULL sources and forms do not count. Two aggregations, the first one map-side
    combined per form, so a component that a third of all rows name meets one task with its distinct
    forms only.
    """
    minimum = max(2, minimum)
    usable = rows
    for c in (keys[-1], form):
        usable = usable.where(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    first = [F.min(example).alias("_example")] if example else []
    counted = usable.groupBy(*keys, form).agg(F.count("*").alias("n"), *first)
    profile = counted.groupBy(*keys).agg(
        F.sum("n").alias("occurrences"),
        F.count("*").alias("target_form_count"),
        F.min_by(F.col(form), F.struct(-F.col("n"), F.col(form))).alias("dominant_target_form"),
        F.max("n").alias("dominant_target_count"),
        forms_json(F.collect_list(F.struct(F.col(form).cast("string").alias("form"), "n"))).alias("target_forms"),
        *([F.min_by("_example", F.struct(-F.col("n"), F.col("_example"))).alias("source_example")] if example else []),
    )
    return profile.where(F.col("occurrences") >= minimum).withColumns({
        "dominant_mapping_rate": F.col("dominant_target_count") / F.col("occurrences"),
        "mapping_review_signal": F.col("target_form_count") > 1,
    })


def mapping_summary(profile: DataFrame, *by: str) -> DataFrame:
    """Items, observations, weighted dominant rate, and number and rate of items to review, by group."""
    return profile.groupBy(*by).agg(
        F.count("*").alias("recurring_items"),
        F.sum("occurrences").alias("observations"),
        (F.sum("dominant_target_count") / F.sum("occurrences")).alias("weighted_dominant_rate"),
        F.sum(F.col("mapping_review_signal").cast("int")).alias("review_items"),
        F.avg(F.col("mapping_review_signal").cast("double")).alias("review_rate"),
    )


def mapping_risk(profile: DataFrame) -> DataFrame:
    """High: several forms and a dominant rate below 0.9; Medium: several forms; else Low."""
    m = F.coalesce("mapping_review_signal", F.lit(False))
    return profile.withColumn("automatic_risk", F.when(m & (F.col("dominant_mapping_rate") < 0.9), "High").when(m, "Medium").otherwise("Low"))


def context_examples(rows: DataFrame, keys: list[str], value: str, order: str, most: int = 4) -> DataFrame:
    """The first distinct examples of each key in the given order, joined.

    Each value keeps its first place only, so the window sees distinct values.
    """
    first = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("_o"))
    ranked = first.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_o", value))).where(F.col("_r") <= most)
    return ranked.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(value).alias("v")))), lambda x: x["v"]), "; ").alias("examples"))
