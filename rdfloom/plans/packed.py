"""Query on packed fields (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rdfloom.operators.packed import explode_packed, form_items, triple_items
from rdfloom.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_table, row_id, pos, item): one row per value of the two packed fields."""
    examples = explode_packed(table(spark, sf_dir, "examples"), "example_id", triple_items(F.col("triples")), "examples")
    mappings = explode_packed(
        table(spark, sf_dir, "qa12_variable_mappings"), "mapping_id", form_items(F.col("target_forms")), "qa12_variable_mappings"
    )
    return examples.unionByName(mappings)


QUERIES = {"p4_found": p4_found}
ORACLE: dict[str, str] = {}
