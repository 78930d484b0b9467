"""Small Spark helpers shared by the operators: durable intermediate tables and bounded Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which every executor reaches. Where it is unset, a folder of our own, but only
    if all executors are in this process; on a cluster it has to be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='sitefold-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: the lineage ends there and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._sitefold_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete the table behind a frame that :func:`materialize` returned, once nothing reads it any more."""
    path = getattr(df, "_sitefold_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def bounded_batches(spark: SparkSession, rows: int = 1000, size: str = "2m") -> None:
    """Keep Arrow batches small whatever the length of the texts, so that a Python worker's memory stays bounded. Frames are
    planned when they are used, so the settings stay; a smaller number of rows that the session has already is left."""
    set_rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(rows, set_rows) if set_rows > 0 else rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def text_bytes_in(docs: DataFrame) -> int:
    """Bytes of all texts: what numbers of partitions are derived from."""
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def partitions_for(spark: SparkSession, total: int, each: int) -> int:
    """Partitions that hold about ``each`` bytes, and no fewer than the session shuffles into."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // each))


def packed(columns: list[str]) -> Column:
    """The caller's columns as one struct ``row``, so that none can clash with an operator's own."""
    return F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in columns]).alias("row")


def unpacked(columns: list[str]) -> list[Column]:
    return [F.col(f"row.`{c}`").alias(c) for c in columns]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
