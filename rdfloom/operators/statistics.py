"""Ranking statistics, thresholds, bootstrap intervals, weighted means and agreement."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_mean(value: str, weight: str) -> Column:
    """Weighted mean over finite values with positive weight; NULL where their weights sum to nothing."""
    ok = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.abs(F.col(value).cast("double")) < float("inf")) & (F.col(weight) > 0)
    return F.try_divide(F.sum(F.when(ok, F.col(value) * F.col(weight))), F.sum(F.when(ok, F.col(weight))))


def full_rate(value: str) -> Column:
    """Share of the known values that are 1, up to rounding."""
    return F.avg(F.when(F.col(value).isNotNull(), (F.col(value) >= 1 - 1e-12).cast("double")))


def positive_rate(value: str) -> Column:
    """Share of the known values above 0."""
    return F.avg(F.when(F.col(value).isNotNull(), (F.col(value) > 0).cast("double")))


def rate_with_null_false(condition: Column) -> Column:
    """Share of rows that meet a condition; NULL counts as not met."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def thresholds(rows: DataFrame, by: str, columns: list[str], shares: list[float]) -> DataFrame:
    """Exact linear percentiles of each column by group, one column each, named ``column_pNN``."""
    return rows.groupBy(by).agg(*[F.expr(f"percentile(`{c}`, {p})").alias(f"{c}_p{round(p * 100):02d}") for c in columns for p in shares])


def ranking(rows: DataFrame, by: list[str], score: str, positive: str) -> DataFrame:
    """(by, auroc, average_precision, positives, negatives); NULL where a class is missing.

    Scores are counted first, so ties are one row and the windows run over distinct scores. Higher
    scores speak for the positive class; NULL scores are left out.
    """
    y = F.col(positive).cast("boolean")
    counted = rows.where(F.col(score).isNotNull() & F.col(positive).isNotNull()).groupBy(*by, F.col(score).alias("_v")).agg(F.count_if(y).alias("_p"), F.count_if(~y).alias("_n"))
    ordered = lambda *c: (Window.partitionBy(*by) if by else Window).orderBy(*c)
    up = ordered("_v").rowsBetween(Window.unboundedPreceding, -1)
    down = ordered(F.desc("_v")).rowsBetween(Window.unboundedPreceding, 0)
    w = counted.withColumns({
        "_below": F.coalesce(F.sum("_n").over(up), F.lit(0)), "_tp": F.sum("_p").over(down), "_said": F.sum(F.col("_p") + F.col("_n")).over(down),
    })
    total = w.groupBy(*by).agg(
        F.sum("_p").alias("positives"), F.sum("_n").alias("negatives"),
        F.sum(F.col("_p") * (F.col("_below") + F.col("_n") / 2)).alias("_wins"), F.sum(F.col("_p") * F.col("_tp") / F.col("_said")).alias("_ap"),
    )
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return total.select(
        *by, F.when(both, F.col("_wins") / (F.col("positives") * F.col("negatives"))).alias("auroc"),
        F.when(both, F.col("_ap") / F.col("positives")).alias("average_precision"), "positives", "negatives",
    )


def knee_threshold(rows: DataFrame, by: list[str], score: str, tail: float = 0.25) -> DataFrame:
    """(by, threshold): the knee of the lower tail of the scores.

    Under ten values the tail percentile. Otherwise the lowest max(3, ceil(n tail)) values are scaled to
    the unit square and the one farthest above the diagonal is taken, the first among equals; a flat
    tail gives its last value.
    """
    known = rows.where(F.col(score).isNotNull()).select(*by, F.col(score).cast("double").alias("_v"))
    stats = known.groupBy(*by).agg(F.count("*").alias("_n"), F.expr(f"percentile(_v, {tail})").alias("_q"))
    size = F.greatest(F.lit(3), F.ceil(F.col("_n") * tail)).cast("int")
    w = Window.partitionBy(*by).orderBy("_v")
    low = known.withColumn("_r", F.row_number().over(w)).join(stats, by).withColumn("_k", size).where(F.col("_r") <= F.col("_k"))
    ends = low.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    scaled = low.join(ends, by).withColumn("_d", F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo")) - (F.col("_r") - 1) / (F.col("_k") - 1))
    best = scaled.groupBy(*by).agg(
        F.max_by("_v", F.struct("_d", -F.col("_r"))).alias("_knee"), F.first("_n").alias("_n"), F.first("_q").alias("_q"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi")
    )
    flat = F.abs(F.col("_hi") - F.col("_lo")) < 1e-8
    return best.select(*by, F.when(F.col("_n") < 10, F.col("_q")).when(flat, F.col("_hi")).otherwise(F.col("_knee")).alias("threshold"))


def cluster_bootstrap(rows: DataFrame, by: list[str], cluster: str, value: str, replicates: int = 1_000, seed: int = 42, parts: int = 8) -> DataFrame:
    """(by, low, high): percentile interval of the mean over resampled clusters; NULL with fewer than two clusters.

    Clusters come down to sums and counts first. Every cluster draws Poisson weights for all replicates
    from its own hash, so replicates are sums that combine from any partition: no group is gathered and
    the result does not depend on the partitioning.
    """
    sums = rows.where(F.col(value).isNotNull() & F.col(cluster).isNotNull()).groupBy(*by, cluster).agg(F.sum(value).alias("_s"), F.count("*").alias("_n"))
    keyed = sums.withColumn("_h", F.xxhash64(F.col(cluster).cast("string"), F.lit(seed)))
    names = [*by, "replicate", "s", "n"]

    def weights(batches):
        for frame in batches:
            if not len(frame):
                continue
            draws = np.stack([np.random.default_rng(int(h) & 0x7FFFFFFFFFFFFFFF).poisson(1.0, replicates) for h in frame["_h"]])
            parts_ = []
            for key, index in frame.groupby(by, dropna=False).indices.items() if by else [((), np.arange(len(frame)))]:
                key = key if isinstance(key, tuple) else (key,)
                w = draws[index]
                part = pd.DataFrame({"replicate": np.arange(replicates, dtype="int32"), "s": w.T @ frame["_s"].to_numpy(float)[index], "n": w.T @ frame["_n"].to_numpy(float)[index]})
                for name, k in zip(by, key, strict=True):
                    part[name] = k
                parts_.append(part[names])
            yield pd.concat(parts_)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in sums.select(*by).schema] + ["replicate int", "s double", "n double"])
    means = keyed.mapInPandas(weights, schema).groupBy(*by, "replicate").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0.0))).alias("m"))
    interval = means.groupBy(*by).agg(F.expr("percentile(m, 0.025)").alias("low"), F.expr("percentile(m, 0.975)").alias("high"))
    clusters = sums.groupBy(*by).agg(F.count("*").alias("clusters"))
    joined = clusters.join(interval, by, "left") if by else clusters.crossJoin(F.broadcast(interval))
    enough = F.col("clusters") >= 2
    return joined.select(*by, "clusters", F.when(enough, F.col("low")).alias("low"), F.when(enough, F.col("high")).alias("high"))


def agreement(rows: DataFrame, automatic: str, manual: str, by: tuple[str, str]) -> DataFrame:
    """Agreement of two risk levels over all, by either column, and by both (NULL marks a total).

    Levels are Low, Medium and High; other manual values count as not judged.
    """
    level = lambda c: F.when(F.col(c) == "Low", 0).when(F.col(c) == "Medium", 1).when(F.col(c) == "High", 2)
    a, b = by
    base = rows.select(F.coalesce(a, F.lit("")).alias(a), F.coalesce(b, F.lit("")).alias(b), level(automatic).alias("x"), level(manual).alias("y")).withColumn("ok", F.col("x").isNotNull() & F.col("y").isNotNull())
    ok, x, y = F.col("ok"), F.col("x"), F.col("y")
    counts = base.cube(a, b).agg(
        F.count("*").alias("total_cases"), F.count_if(ok).alias("usable_cases"), F.count_if(y.isNull()).alias("cannot_judge"),
        F.count_if(ok & (x == y)).alias("exact"), F.count_if(ok & (F.abs(x - y) <= 1)).alias("near"), F.sum(F.when(ok, F.abs(x - y))).alias("distance"),
        F.count_if(ok & (x > 0) & (y > 0)).alias("tp"), F.count_if(ok & (x > 0) & (y == 0)).alias("fp"),
        F.count_if(ok & (x == 0) & (y > 0)).alias("fn"), F.count_if(ok & (x == 0) & (y == 0)).alias("tn"),
    )
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return counts.select(
        a, b, "total_cases", "usable_cases", "cannot_judge",
        F.try_divide("exact", "usable_cases").alias("exact_agreement"), F.try_divide("near", "usable_cases").alias("within_one_level"),
        F.try_divide("distance", "usable_cases").alias("mean_absolute_level_difference"),
        precision.alias("priority_precision"), recall.alias("priority_recall"), F.try_divide(2 * precision * recall, precision + recall).alias("priority_f1"),
        F.try_divide("tn", F.col("tn") + F.col("fn")).alias("automatic_low_confirmation"), "tp", "fp", "fn", "tn",
    )


def confusion(rows: DataFrame, automatic: str, manual: str, *by: str) -> DataFrame:
    return rows.groupBy(*by, F.col(automatic).alias("automatic"), F.col(manual).alias("manual")).agg(F.count("*").alias("cases"))


def paired_severity(rows: DataFrame, pair: str, severity: str, value: str, *by: str) -> DataFrame:
    """(by, pairs, severe_lower_rate): pairs with both severities, and the share whose severe value is lower."""
    wide = rows.groupBy(*by, pair).pivot(severity, ["mild", "severe"]).agg(F.first(value)).where(F.col("mild").isNotNull() & F.col("severe").isNotNull())
    return wide.groupBy(*by).agg(F.count("*").alias("pairs"), F.avg((F.col("severe") < F.col("mild")).cast("double")).alias("severe_lower_rate"))


def weighted_detection(rows: DataFrame, *by: str, rate: str = "detection_rate", weight: str = "variants") -> DataFrame:
    return rows.groupBy(*by).agg(weighted_mean(rate, weight).alias("weighted_detection_rate"), F.min(rate).alias("minimum_detection_rate"))


def paired_deltas(variants: DataFrame, clean: DataFrame, key: list[str], metrics: list[str]) -> DataFrame:
    """The variants with each metric's difference to their clean row, ``delta_metric``; NULL where either is."""
    base = clean.select(*key, *[F.col(m).alias(f"clean_{m}") for m in metrics])
    return variants.join(base, key, "left").withColumns({f"delta_{m}": F.col(m) - F.col(f"clean_{m}") for m in metrics})


def direction_rates(deltas: DataFrame, metrics: list[str], *by: str, tolerance: float = 0.05) -> DataFrame:
    """By group: the share of variants whose metric falls, and the share that falls by no more than the tolerance; NULL counts as neither."""
    out = [F.count("*").alias("variants")]
    for m in metrics:
        d = F.col(f"delta_{m}")
        out += [rate_with_null_false(d < 0).alias(f"{m}_decrease_rate"), rate_with_null_false(d >= -tolerance).alias(f"{m}_non_decrease_rate")]
    return deltas.groupBy(*by).agg(*out)


def metric_detection(pairs: DataFrame, by: list[str], clean: str, variant: str, lower: bool = True) -> DataFrame:
    """Of clean and corrupted values of a metric, by group: pairs, mean change, the share that moves as expected, that does
    not decrease, and AUROC and average precision of telling corrupted from clean. NULL on either side is no pair."""
    known = pairs.where(F.col(clean).isNotNull() & F.col(variant).isNotNull())
    sign = -1.0 if lower else 1.0
    moved = known.groupBy(*by).agg(
        F.count("*").alias("pairs"), F.avg(F.col(variant) - F.col(clean)).alias("mean_change"),
        F.avg(((F.col(variant) - F.col(clean)) * sign > 0).cast("double")).alias("expected_direction_rate"),
        F.avg((F.col(variant) >= F.col(clean)).cast("double")).alias("non_decrease_rate"),
    )
    sides = known.select(*by, F.inline(F.array(F.struct((F.col(clean) * sign).alias("_s"), F.lit(0).alias("_y")), F.struct((F.col(variant) * sign).alias("_s"), F.lit(1).alias("_y")))))
    return moved.join(ranking(sides, by, "_s", "_y").select(*by, "auroc", "average_precision"), by)


def control_selectivity(flags: DataFrame, kind: str, by: list[str], flag: str, controls: tuple[str, ...]) -> DataFrame:
    """By group: how often harmless controls are flagged, how often corrupted rows are, and the difference; NULL flags count as not raised."""
    raised = F.coalesce(F.col(flag), F.lit(False)).cast("double")
    calm = F.col(kind).isin(*controls)
    return flags.groupBy(*by).agg(
        F.count_if(calm).alias("controls"), F.count_if(~calm).alias("corrupted"), F.avg(F.when(calm, raised)).alias("false_positive_rate"), F.avg(F.when(~calm, raised)).alias("detection_rate")
    ).withColumn("selectivity", F.col("detection_rate") - F.col("false_positive_rate"))


def combined_summary(parts: dict[str, DataFrame], language: str) -> DataFrame:
    """(audit, language, types, variants, weighted and minimum detection rate) of each audit's (language, detection_rate, variants) rows."""
    out = None
    for audit, rows in parts.items():
        one = rows.groupBy(language).agg(
            F.count("*").alias("types"), F.sum("variants").alias("variants"), (F.sum(F.col("detection_rate") * F.col("variants")) / F.sum("variants")).alias("weighted_detection_rate"),
            F.min("detection_rate").alias("minimum_detection_rate"),
        ).select(F.lit(audit).alias("audit"), language, "types", "variants", "weighted_detection_rate", "minimum_detection_rate")
        out = one if out is None else out.unionByName(one)
    return out
