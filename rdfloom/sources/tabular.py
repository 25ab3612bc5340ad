"""Tables as sources and sinks: CSV with list columns, Parquet, JSON lines, XML, registries, metadata."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rdfloom.session import path_exists


def read_csv(spark: SparkSession, path: str, lists: tuple[str, ...] = (), source: str | None = None) -> DataFrame:
    """A CSV file, or several by a pattern, all columns text; list columns are read as JSON, and ``source`` names a column for the file."""
    frame = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    if source:
        frame = frame.withColumn(source, F.regexp_extract(F.col("_metadata.file_name"), "^(.*?)\\.[^.]*$", 1))
    return frame.withColumns({c: F.from_json(c, "array<string>") for c in lists}) if lists else frame


def read_first(spark: SparkSession, *paths: str) -> DataFrame | None:
    """The first path that exists, read by its ending; None if there is none."""
    for path in paths:
        if path_exists(spark, path):
            return spark.read.json(path) if path.endswith((".json", ".jsonl")) else read_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)
    return None


def write_csv(frame: DataFrame, path: str) -> None:
    """CSV with arrays, maps and structures as JSON."""
    nested = {f.name: F.to_json(f.name) for f in frame.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))}
    (frame.withColumns(nested) if nested else frame).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_parquet(frame: DataFrame, path: str, *partition_by: str) -> None:
    """Parquet, partitioned where reads will prune."""
    writer = frame.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_jsonl(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_xml(frame: DataFrame, path: str, *partition_by: str, row: str = "entry", root: str = "benchmark") -> None:
    """XML entries; columns that begin with ``_`` are attributes."""
    writer = frame.write.mode("overwrite").format("xml").option("rowTag", row).option("rootTag", root)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_views(frame: DataFrame, path: str, track: str, views: dict[str, list[str]]) -> None:
    """One directory a view: the rows of its tracks."""
    for name, tracks in views.items():
        write_parquet(frame.where(F.col(track).isin(tracks)), f"{path}/{name}")


def append_registry(spark: SparkSession, rows: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append the rows whose keys the registry lacks, and return the registry."""
    new = rows
    if path_exists(spark, path):
        new = rows.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    new.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def write_metadata(path: str, settings: dict, code: list[str] = ()) -> dict:
    """Settings and the SHA-256 of code files as one JSON file."""
    data = settings | {"code_sha256": {str(c): hashlib.sha256(Path(c).read_bytes()).hexdigest() for c in code}}
    Path(path).write_text(json.dumps(data, indent=2, sort_keys=True, ensure_ascii=False))
    return data


def latex_table(rows: list[dict], columns: list[str]) -> str:
    """A small result as a LaTeX table body."""
    show = lambda v: "--" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = [" & ".join(c.replace("_", "\\_") for c in columns) + " \\\\", "\\midrule"]
    return "\n".join([*lines, *(" & ".join(show(r[c]).replace("_", "\\_").replace("%", "\\%") for c in columns) + " \\\\" for r in rows)])


def macros(values: dict[str, float]) -> str:
    """``\\newcommand`` lines of named values."""
    return "\n".join(f"\\newcommand{{\\{n}}}{{{v:.4f}}}" for n, v in values.items())
