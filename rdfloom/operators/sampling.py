"""Deterministic sampling by hash order, quotas by strata, and few-shot anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(key: Column, seed: str) -> Column:
    """SHA-256 of seed and key: an order any engine can reproduce."""
    return F.sha2(F.concat_ws("|", F.lit(seed), key.cast("string")), 256)


def _ranked(rows: DataFrame, strata: list[str], key: str, seed: str, most: Column, salts: int = 32) -> DataFrame:
    """The rows of rank up to ``most`` in their stratum's hash order; salted parts keep hot strata in many tasks."""
    h = rows.withColumn("_h", hash_order(F.col(key), seed)).withColumn("_salt", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(salts)))
    part = h.withColumn("_r", F.row_number().over(Window.partitionBy(*strata, "_salt").orderBy("_h", key))).where(F.col("_r") <= most)
    return part.withColumn("_r", F.row_number().over(Window.partitionBy(*strata).orderBy("_h", key))).where(F.col("_r") <= most)


def hash_sample(rows: DataFrame, key: str, n: int, seed: str = "sample") -> DataFrame:
    """The n rows that come first in hash order."""
    return rows.withColumn("_h", hash_order(F.col(key), seed)).orderBy("_h", key).limit(n).drop("_h")


def stratified_quotas(rows: DataFrame, strata: list[str], n: int) -> DataFrame:
    """(strata, size, quota): proportional quotas for n rows, floors first, then the largest remainders."""
    sizes = rows.groupBy(*strata).agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size").alias("total"))
    exact = sizes.crossJoin(F.broadcast(total)).withColumn("x", F.col("size") * F.least(F.lit(n), F.col("total")) / F.col("total"))
    floor = exact.withColumn("base", F.floor("x")).withColumn("rest", F.round(F.col("x") - F.col("base"), 9))
    left = floor.agg((F.least(F.lit(n), F.max("total")) - F.sum("base")).alias("left"))
    ranked = floor.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rest"), *strata)))
    return ranked.crossJoin(F.broadcast(left)).select(*strata, "size", (F.col("base") + (F.col("rank") <= F.col("left")).cast("bigint")).alias("quota"))


def stratified_sample(rows: DataFrame, strata: list[str], key: str, n: int, seed: str = "strata") -> DataFrame:
    """n rows in proportion to the strata, each stratum's first in hash order."""
    quotas = stratified_quotas(rows, strata, n)
    joined = rows.join(quotas.select(*strata, "quota"), strata)
    return _ranked(joined, strata, key, seed, F.col("quota")).drop("_h", "_salt", "_r", "quota")


def one_per_record(rows: DataFrame, record: str, key: str, seed: str = "one") -> DataFrame:
    """One row a record, the one whose key has the least hash."""
    best = rows.groupBy(record).agg(F.min_by(F.col(key), F.struct(hash_order(F.concat_ws("|", F.col(record).cast("string"), F.col(key).cast("string")), seed), F.col(key))).alias(key))
    return rows.join(best, [record, key], "left_semi")


def equal_sample(rows: DataFrame, strata: list[str], key: str, each: int, seed: str = "equal") -> DataFrame:
    """Up to ``each`` rows of every stratum."""
    return _ranked(rows, strata, key, seed, F.lit(each)).drop("_h", "_salt", "_r")


def quota_sample(rows: DataFrame, group: list[str], level: str, key: str, quotas: dict[str, int], fill: list[str], seed: str = "quota") -> DataFrame:
    """Rows of each group by level quotas; what a level lacks is filled from the other levels in the given order."""
    total = sum(quotas.values())
    known = rows.where(F.col(level).isin(list(quotas)))
    ranked = _ranked(known, [*group, level], key, seed, F.lit(total)).drop("_salt")
    quota = F.lit(0)
    for name, n in quotas.items():
        quota = F.when(F.col(level) == name, n).otherwise(quota)
    order = F.lit(len(fill))
    for i, name in enumerate(fill):
        order = F.when(F.col(level) == name, i).otherwise(order)
    marked = ranked.withColumn("_in", F.col("_r") <= quota).withColumn("_fill", order)
    w = Window.partitionBy(*group).orderBy(F.desc("_in"), "_fill", "_h", key)
    return marked.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= total).select(*rows.columns, (~F.col("_in")).alias("filled"))


def anchors(rows: DataFrame, size: str, category: str, key: str, sizes: list[int], seed: str = "anchor") -> DataFrame:
    """One row of each size, each of a category not used by an earlier one: a short loop over the sizes, one row each."""
    used = None
    out = None
    for s in sizes:
        pool = rows.where(F.col(size) == s)
        if used is not None:
            pool = pool.join(used, category, "left_anti")
        one = hash_sample(pool, key, 1, f"{seed}{s}")
        out = one if out is None else out.unionByName(one)
        used = one.select(category) if used is None else used.unionByName(one.select(category))
    return out.select(*rows.columns)


def in_all_languages(rows: DataFrame, key: str, language: str, n: int) -> DataFrame:
    """The rows whose key occurs in at least n languages."""
    full = rows.groupBy(key, language).count().groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= n).select(key)
    return rows.join(full, key, "left_semi")
