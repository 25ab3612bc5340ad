"""Length and reference variation (QA3.2), and alignment of lexicalisations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rdfloom.functions.text import normalize_space, tokens


def expansion_ratio(target: Column, source: Column) -> Column:
    """Target tokens per source token, the source counting at least one."""
    return F.size(tokens(target)) / F.greatest(F.size(tokens(source)), F.lit(1))


def character_ratio(candidate: Column, reference: Column) -> Column:
    return F.length(F.coalesce(candidate, F.lit(""))) / F.greatest(F.length(F.coalesce(reference, F.lit(""))), F.lit(1))


def comparison_reference(rows: DataFrame, record: str, lid: str, text: str) -> DataFrame:
    """(record, lid, comparison_lid, comparison_text): for each lid the first other one of its record with its first text.

    The two smallest lids of a record are all that is needed: no self join, no pairs.
    """
    usable = rows.where((normalize_space(F.col(lid)) != "") & (normalize_space(F.col(text)) != ""))
    first = usable.groupBy(record, lid).agg(F.min(text).alias("_t"))
    # all lids of a record are not gathered: min, and min beyond it
    lowest = first.groupBy(record).agg(F.min(F.struct(F.col(lid).alias("l"), F.col("_t").alias("t"))).alias("a"))
    second = first.join(lowest, record).where(F.col(lid) != F.col("a.l")).groupBy(record).agg(F.min(F.struct(F.col(lid).alias("l"), F.col("_t").alias("t"))).alias("b"))
    both = lowest.join(second, record)
    other = lambda f: F.when(F.col(lid) == F.col("a.l"), F.col(f"b.{f}")).otherwise(F.col(f"a.{f}"))
    return first.select(record, lid).join(both, record, "left").select(record, lid, other("l").alias("comparison_lid"), other("t").alias("comparison_text"))


def outer_align(source: DataFrame, target: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Full outer alignment by key: first text of either side, and whether the target has several."""
    a = source.groupBy(*keys).agg(F.min(text).alias("source_text"))
    b = target.groupBy(*keys).agg(F.min(text).alias("target_text"), F.count("*").alias("_n"))
    return a.join(b, keys, "full").select(*keys, "source_text", "target_text", (F.coalesce("_n", F.lit(0)) > 1).alias("duplicate_target"))


def advantage(aligned: Column, comparison: Column, eligible: Column) -> Column:
    """How much closer the aligned reference is than the comparison; NULL where not eligible."""
    return F.when(eligible, aligned - comparison)


def advantage_eligible(target: Column, aligned: Column, comparison: Column, target_lid: Column, aligned_lid: Column, comparison_lid: Column) -> Column:
    """All texts and ids present, the target's id that of the aligned reference and not of the comparison."""
    full = lambda c: normalize_space(c) != ""
    ids = [full(x) for x in (target, aligned, comparison, target_lid, aligned_lid, comparison_lid)]
    return F.coalesce(_all(ids) & (target_lid == aligned_lid) & (target_lid != comparison_lid), F.lit(False))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def first_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def _leaders(keyed: DataFrame, by: list[str], record: str, category: str) -> DataFrame:
    """(by, a, b, c): of each group the record of least hash, the least of another category than it, and the least of the rest."""
    row = F.struct("_h", F.col(record).alias("r"), F.col(category).alias("k"))
    best = keyed.groupBy(*by).agg(F.min(row).alias("a"))
    rest = (keyed.join(best, by) if by else keyed.crossJoin(F.broadcast(best))).where(F.col(record) != F.col("a.r"))
    more = rest.groupBy(*by).agg(F.min(F.when(~F.col(category).eqNullSafe(F.col("a.k")), row)).alias("b"), F.min(row).alias("c"))
    return best.join(more, by, "left") if by else best.crossJoin(F.broadcast(more))


def donor_select(rows: DataFrame, record: str, size: str, category: str, seed: str = "donor", buckets: int = 64) -> DataFrame:
    """(record, donor): another record of the same size if there is one, of another category if possible, else any.

    Every size keeps, for each hash bucket and as a whole, its record of least hash, the least of another
    category, and the next; a record takes the first of these that fits. These are aggregations that
    combine before the shuffle: no pairs are formed and no size is gathered. NULL sizes are no size.
    """
    keyed = (
        rows.select(record, size, category).dropDuplicates([record])
        .withColumn("_h", F.sha2(F.concat_ws("|", F.lit(seed), F.col(record).cast("string")), 256))
        .withColumn("_b", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int") % buckets)
    )
    near = _leaders(keyed, [size, "_b"], record, category).select(size, "_b", *[F.col(x).alias(f"n{x}") for x in "abc"])
    own = _leaders(keyed, [size], record, category).select(size, *[F.col(x).alias(f"s{x}") for x in "abc"])
    every = _leaders(keyed, [], record, category).select(*[F.col(x).alias(f"e{x}") for x in "abc"])
    joined = keyed.join(near, [size, "_b"], "left").join(own, size, "left").crossJoin(F.broadcast(every))
    other = [F.when(~F.col(f"{x}.k").eqNullSafe(F.col(category)), F.col(f"{x}.r")) for x in ("na", "nb", "sa", "sb")]
    any_ = [F.when(F.col(f"{x}.r") != F.col(record), F.col(f"{x}.r")) for x in ("sa", "sc", "ea", "ec")]
    return joined.select(record, F.coalesce(*other, *any_).alias("donor"))
