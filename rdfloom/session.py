"""Session, table and lineage helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings a fresh session gets. Existing sessions keep theirs.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the library's defaults; ``conf`` keys are given with ``__`` for dots."""
    builder = SparkSession.builder.master(master).appName("rdfloom")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session, through Spark's own file server."""
    context = spark.sparkContext
    if getattr(context, "_rdfloom_shipped", False):
        return
    root = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="rdfloom_")) / "rdfloom.zip"
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(target))
    atexit.register(shutil.rmtree, target.parent, True)
    context._rdfloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A Parquet table of the data directory, pruned to ``columns`` if any are named."""
    ship(spark)
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on the file system it names, as Spark would read it."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset, as in tests on one machine, a temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = getattr(spark.sparkContext, "_rdfloom_shared", None)
        if not found:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            found = tempfile.mkdtemp(prefix="rdfloom_")
            atexit.register(shutil.rmtree, found, True)
            spark.sparkContext._rdfloom_shared = found
    return found


def cut(frame: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write the frame as a table in the shared folder and read it back.

    The lineage ends there, a lost executor costs one task, and the second reader
    does not compute the input again.
    """
    spark = frame.sparkSession
    path = os.path.join(shared_dir(spark), f"cut_{uuid.uuid4().hex}")
    writer = frame.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
