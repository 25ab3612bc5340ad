"""Review priorities: risk rules on metrics, and the cases they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _below(value: str, threshold: str) -> Column:
    return F.coalesce(F.col(value) < F.col(threshold), F.lit(False))


def _count(conditions: list[Column]) -> Column:
    return sum((c.cast("int") for c in conditions), F.lit(0))


def preservation_risk(rows: DataFrame, scores: list[str], literal: str, flag: str) -> DataFrame:
    """High: a literal lost, a score below p01, or two below p05; Medium: the flag or a score below p10; else Low.

    The thresholds are columns ``score_p01`` and so on (see statistics.thresholds).
    """
    lost = F.coalesce(F.col(literal) < 1 - 1e-12, F.lit(False))
    p01, p05, p10 = ([_below(s, f"{s}_{p}") for s in scores] for p in ("p01", "p05", "p10"))
    high = lost | (_count(p01) > 0) | (_count(p05) >= 2)
    medium = F.coalesce(F.col(flag), F.lit(False)) | (_count(p10) > 0)
    return rows.withColumn("automatic_risk", F.when(high, "High").when(medium, "Medium").otherwise("Low"))


def faithfulness_risk(rows: DataFrame, literal: str, coverage: str, groundedness: str) -> DataFrame:
    """High: a literal lost or both directions fail; Medium: one fails or is undefined; else Low."""
    lost = F.coalesce(F.col(literal) < 1 - 1e-12, F.lit(False))
    c, g = F.col(coverage), F.col(groundedness)
    both = F.coalesce(~c & ~g, F.lit(False))
    one = ~F.coalesce(c, F.lit(False)) | ~F.coalesce(g, F.lit(False))
    return rows.withColumn("automatic_risk", F.when(lost | both, "High").when(one, "Medium").otherwise("Low"))


def language_risk(rows: DataFrame, hard: str, valid: str) -> DataFrame:
    """High: a hard flag; Medium: not valid; else Low."""
    return rows.withColumn(
        "automatic_risk", F.when(F.coalesce(F.col(hard), F.lit(False)), "High").when(~F.coalesce(F.col(valid), F.lit(False)), "Medium").otherwise("Low")
    )


def variation_risk(rows: DataFrame, advantage: str, ratio: str) -> DataFrame:
    """High: advantage at most p01, or none and a ratio outside p01 to p99; Medium: none or unknown, or a ratio outside p05 to p95; else Low."""
    a, r = F.col(advantage), F.col(ratio)
    no = lambda c: F.coalesce(c, F.lit(False))
    outside = lambda lo, hi: no((r < F.col(f"{ratio}_{lo}")) | (r > F.col(f"{ratio}_{hi}")))
    high = no(a <= F.col(f"{advantage}_p01")) | (outside("p01", "p99") & no(a <= 0))
    medium = no(a <= 0) | outside("p05", "p95") | a.isNull()
    return rows.withColumn("automatic_risk", F.when(high, "High").when(medium, "Medium").otherwise("Low"))


def case_id(subqa: Column, language: Column, source: Column) -> Column:
    """``QA11-ES-`` and twelve digits of SHA-256 over question, language and source."""
    digest = F.substring(F.sha2(F.concat_ws("|", subqa, language, source), 256), 1, 12)
    return F.concat_ws("-", F.replace(subqa, F.lit("."), F.lit("")), F.upper(language), digest)


def blinded(cases: DataFrame) -> DataFrame:
    """The cases as raters see them: without risk, basis and signals, with empty answer columns, in hash order."""
    hidden = [c for c in cases.columns if c.startswith("automatic_")]
    return cases.drop(*hidden).withColumns({"manual_risk": F.lit(None).cast("string"), "comment": F.lit(None).cast("string")}).orderBy(F.sha2("case_id", 256))


def annotated(cases: DataFrame, annotations: DataFrame) -> DataFrame:
    """Cases with their annotation, failing at run time on a missing or unknown label."""
    joined = cases.join(annotations, "case_id", "left")
    ok = F.col("manual_risk").isin("Low", "Medium", "High", "Cannot judge")
    return joined.withColumn(
        "manual_risk", F.when(F.coalesce(ok, F.lit(False)), F.col("manual_risk")).otherwise(F.raise_error(F.concat(F.lit("no valid label for case "), F.col("case_id"))))
    )
