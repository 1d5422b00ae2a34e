"""Helpers that several operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skywake.session import work_path

#: Rows of a batch that are Python objects at a time.
SLICE = 256
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, unless their path has it."""
    root = Path(__file__).resolve().parents[2]
    context = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_skywake_sent", False):
        return
    folder = tempfile.TemporaryDirectory(prefix="skywake-")
    archive = f"{folder.name}/skywake_modules.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for file in sorted((root / "skywake").rglob("*.py")):
            packed.write(file, file.relative_to(root))
    context.addPyFile(archive)
    context._skywake_files = folder  # the driver serves it as long as it runs
    context._skywake_sent = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts lineage, and lost executors cost no recomputation.

    The table stands in for what made it: the shuffle files go when it is written, and the driver is asked to collect the plans
    and broadcasts they belong to, which by itself it would only do when its memory is full.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Delete the files of tables made by `written` that nothing reads any more."""
    for frame in frames:
        spark = frame.sparkSession
        for file in {name.rsplit("/", 1)[0] for name in frame.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def merging(df: DataFrame) -> DataFrame:
    """`df` as a side of a join that is sorted and merged, however small it is.

    Every side that Spark broadcasts takes a thread of the driver, whose stack and buffers stay for a minute. Loops over many small
    tables had 128 of them at a time, as many as there can be.
    """
    return df.hint("merge")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[dict[str, list]]:
    """The batches in small slices, as lists by column."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows).to_pydict()


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.record_batch([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def crc_mod(doc_id: Column, by: int) -> Column:
    """crc32 of the id's decimal text, modulo `by`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def fresh(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:12]}"
