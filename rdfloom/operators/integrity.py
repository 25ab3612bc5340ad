"""Structural integrity of entries (QA1.1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rdfloom.functions.text import is_malformed_component, normalize_space, split_triple

CHECKS = ("target_triple_parity", "target_text_present", "lexicalisation_id_alignment", "lexicalisation_id_unique", "target_rdf_well_formed")


def triple_parity(triples: Column, expected: Column) -> Column:
    """As many triples as expected; an expectation that is NULL or negative is never met."""
    return F.coalesce((expected >= 0) & (F.size(F.coalesce(triples, F.array().cast("array<string>"))) == expected), F.lit(False))


def text_present(texts: Column) -> Column:
    """At least one text, and none blank."""
    known = F.coalesce(texts, F.array().cast("array<string>"))
    return (F.size(known) > 0) & F.forall(known, lambda t: normalize_space(t) != "")


def _ids(ids: Column) -> Column:
    return F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda x: normalize_space(x))


def ids_aligned(source: Column, target: Column) -> Column:
    """The source has ids and the target has the same set."""
    a, b = F.array_sort(F.array_distinct(_ids(source))), F.array_sort(F.array_distinct(_ids(target)))
    return (F.size(a) > 0) & (a == b)


def ids_unique(ids: Column) -> Column:
    """Some ids, none blank, none twice."""
    known = _ids(ids)
    return (F.size(known) > 0) & ~F.array_contains(known, "") & (F.size(F.array_distinct(known)) == F.size(known))


def well_formed(triples: Column) -> Column:
    """Some triples, and no malformed component in any."""
    known = F.coalesce(triples, F.array().cast("array<string>"))

    def sound(triple: Column) -> Column:
        t = split_triple(triple)
        return ~(is_malformed_component(t["s"]) | is_malformed_component(t["p"]) | is_malformed_component(t["o"]))

    return (F.size(known) > 0) & F.forall(known, sound)


def entry_integrity(entries: DataFrame) -> DataFrame:
    """Every entry's five checks, their conjunction, and the parity of the declared size (NULL where it is invalid)."""
    checked = entries.withColumns({
        "target_triple_parity": triple_parity(F.col("target_triples"), F.col("expected_triple_count")),
        "target_text_present": text_present(F.col("target_texts")),
        "lexicalisation_id_alignment": ids_aligned(F.col("english_lids"), F.col("target_lids")),
        "lexicalisation_id_unique": ids_unique(F.col("target_lids")),
        "target_rdf_well_formed": well_formed(F.col("target_triples")),
        "source_declared_parity": F.when(F.col("declared_size_valid"), F.size("source_triples") == F.col("declared_size")),
    })
    every = F.lit(True)
    for name in CHECKS:
        every = every & F.col(name)
    return checked.withColumn("record_integrity", every)


def lists_agree(entries: DataFrame, first: str = "target_lids", second: str = "target_texts") -> DataFrame:
    """The entries, failing at run time if two lists differ in length."""
    message = F.concat(F.lit(f"{first} and {second} differ in length"))
    return entries.withColumn(first, F.when(F.size(first) == F.size(second), F.col(first)).otherwise(F.raise_error(message)))


def integrity_summary(checked: DataFrame, *by: str) -> DataFrame:
    """Entries and the share that passes each check, by group."""
    rate = lambda c: F.avg(F.col(c).cast("double")).alias(f"{c}_rate")
    return checked.groupBy(*by).agg(F.count("*").alias("entries"), *[rate(c) for c in (*CHECKS, "record_integrity", "source_declared_parity")])


def declared_size(raw: Column) -> Column:
    """The declared size where it is a whole number of at least 0, else NULL."""
    size = F.trim(raw).try_cast("int")
    return F.when(size >= 0, size)


def integrity_risk(row: DataFrame) -> DataFrame:
    """Risk by failed checks: High with two, or with identifiers or form; Medium with one; else Low."""
    failed = sum((F.when(F.col(c), 0).otherwise(1) for c in CHECKS), F.lit(0))
    severe = ~F.coalesce("lexicalisation_id_alignment", F.lit(False)) | ~F.coalesce("target_rdf_well_formed", F.lit(False))
    return row.withColumn("failed_checks", failed).withColumn(
        "automatic_risk", F.when((F.col("failed_checks") >= 2) | severe, "High").when(F.col("failed_checks") == 1, "Medium").otherwise("Low")
    )
