"""Preservation from source to target and from data to text (QA2), with calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rdfloom.functions.literals import numeric_atoms, retention, triple_atoms
from rdfloom.functions.similarity import cosine
from rdfloom.functions.text import is_camel_case, normalize_labels, split_triple


def literal_preservation(rows: DataFrame, source: str, target: str, language: str, source_language: str = "en") -> DataFrame:
    """Share of the source triples' atoms that the target triples hold (NULL without atoms), and their number."""
    atoms = rows.withColumns({"_s": triple_atoms(F.col(source), F.lit(source_language)), "_t": triple_atoms(F.col(target), F.col(language))})
    return atoms.withColumns({
        "source_target_literal_preservation": retention(F.col("_s"), F.col("_t")), "source_literal_count": F.size("_s"),
    }).drop("_s", "_t")


def literal_retention(rows: DataFrame, triples: str, text: str, language: str) -> DataFrame:
    """Share of the triples' atoms that the text states (NULL without atoms), their number, and whether all are."""
    atoms = rows.withColumns({"_t": triple_atoms(F.col(triples), F.col(language)), "_v": numeric_atoms(F.col(text), F.col(language))})
    return atoms.withColumns({
        "target_text_literal_retention": retention(F.col("_t"), F.col("_v")),
        "target_literal_count": F.size("_t"),
        "target_literal_full_success": (F.size("_t") > 0) & (F.size(F.array_except("_t", "_v")) == 0),
    }).drop("_t", "_v")


def relative_retention(rows: DataFrame, eligible: str, success: str, *by: str) -> DataFrame:
    """Of the instances whose source states all its atoms, the share whose target does."""
    e, z = F.coalesce(F.col(eligible), F.lit(False)), F.coalesce(F.col(success), F.lit(False))
    return rows.groupBy(*by).agg(
        F.count("*").alias("tested_instances"), F.count_if(e).alias("eligible_instances"), F.count_if(e & z).alias("successful_instances")
    ).withColumn("relative_literal_retention", F.try_divide("successful_instances", "eligible_instances"))


def predicates(triples: Column) -> Column:
    return F.transform(triples, lambda t: split_triple(t)["p"])


def _same_labels(source: Column, target: Column) -> Column:
    return F.zip_with(normalize_labels(predicates(source)), normalize_labels(predicates(target)), lambda a, b: a == b)


def alignment_valid(source: Column, target: Column) -> Column:
    """Equal numbers of triples, some, and no blank predicate on either side."""
    blank = lambda ts: F.array_contains(normalize_labels(predicates(ts)), "")
    return F.coalesce((F.size(source) == F.size(target)) & (F.size(source) > 0) & ~blank(source) & ~blank(target), F.lit(False))


def structured_predicate_kept(source: Column, target: Column) -> Column:
    """Some aligned pair has the same label and a camel-case source predicate; NULL where the sets do not align."""
    pairs = F.zip_with(_same_labels(source, target), predicates(source), lambda same, a: same & is_camel_case(a))
    return F.when(alignment_valid(source, target), F.exists(pairs, lambda x: x))


def identical_predicate(source: Column, target: Column) -> Column:
    """Some pair, as far as both sets go, has the same label and no camel-case source predicate."""
    named = F.transform(normalize_labels(predicates(source)), lambda a: a != "")
    plain = F.zip_with(named, predicates(source), lambda x, a: x & ~is_camel_case(a))
    return F.exists(F.zip_with(_same_labels(source, target), plain, lambda x, y: x & y), lambda x: F.coalesce(x, F.lit(False)))


def pair_similarity(pairs: DataFrame, vectors: DataFrame, left: str, right: str, key: str, vector: str, name: str = "similarity") -> DataFrame:
    """The pairs with the cosine of their vectors, looked up by key; NULL where one is missing.

    Each distinct pair is scored once and joined back.
    """
    distinct = pairs.select(left, right).distinct()
    a = vectors.select(F.col(key).alias(left), F.col(vector).alias("_a"))
    b = vectors.select(F.col(key).alias(right), F.col(vector).alias("_b"))
    scored = distinct.join(a, left, "left").join(b, right, "left").select(left, right, cosine(F.col("_a"), F.col("_b")).alias(name))
    return pairs.join(scored, [left, right], "left")


def mean_similarity(scored: DataFrame, *by: str, score: str = "similarity") -> DataFrame:
    return scored.groupBy(*by).agg(F.avg(score).alias("mean_similarity"), F.count(score).alias("pairs"))


def coverage_min(scored: DataFrame, *by: str, score: str = "similarity") -> DataFrame:
    """The least similarity of a triple to its whole text."""
    return scored.groupBy(*by).agg(F.min(score).alias("minimum_triple_coverage"))


def groundedness_min(scored: DataFrame, keys: list[str], unit: str, score: str = "similarity") -> DataFrame:
    """Each unit's best triple, then the least of the units."""
    return scored.groupBy(*keys, unit).agg(F.max(score).alias("_m")).groupBy(*keys).agg(F.min("_m").alias("minimum_text_groundedness"))


def calibrate(scores: DataFrame, size: str, columns: dict[str, str], share: float = 0.05) -> DataFrame:
    """By exact number of triples: the given percentile (linear) of each column and the number of values.

    ``columns`` maps score columns to threshold names.
    """
    out = []
    for column, name in columns.items():
        out += [F.expr(f"percentile(`{column}`, {share})").alias(name), F.count(column).alias(f"{name}_instances")]
    return scores.groupBy(size).agg(*out)


def apply_calibration(rows: DataFrame, thresholds: DataFrame, size: str, columns: dict[str, str]) -> DataFrame:
    """Pass flags and margins against the thresholds of exactly the same size; NULL where score or threshold is.

    One row per size: the join is many to one, and the side that is sent to all tasks is an aggregate
    that Spark broadcasts only below its own size limit.
    """
    joined = rows.join(thresholds, size, "left")
    for column, name in columns.items():
        joined = joined.withColumns({f"{column}_pass": F.col(column) >= F.col(name), f"{column}_margin": F.col(column) - F.col(name)})
    return joined


def review_localisation(rows: DataFrame, source: Column, text: Column, *by: str) -> DataFrame:
    """Where review is due: both comparisons, source only, text only, or neither; numbers and shares by group."""
    label = F.when(source & text, "both").when(source, "source_to_target").when(text, "target_to_text").otherwise("none")
    counted = rows.withColumn("localisation", label).groupBy(*by, "localisation").agg(F.count("*").alias("instances"))
    total = counted.groupBy(*by).agg(F.sum("instances").alias("_total"))
    return counted.join(total, list(by)).select(*by, "localisation", "instances", (F.col("instances") / F.col("_total")).alias("share"))
