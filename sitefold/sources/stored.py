"""Tables that are kept between jobs: frequency tables in buckets by position, and folders that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def stored_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``. Where that is unset, in a folder of our own, if all executors are in
    this process; on a cluster it has to be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='sitefold-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` as a written table, so that what is read more than once is made once."""
    path = stored_path(rows.sparkSession, label)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_by_position(rows: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """``rows`` as table ``name`` at ``path``, in buckets by (chr, pos), each one file in order; the table. Whatever groups it by position
    afterwards, once or many times, needs no shuffle."""
    dealt = rows.repartition(buckets, "chr", "pos").sortWithinPartitions("chr", "pos")
    dealt.write.bucketBy(buckets, "chr", "pos").sortBy("chr", "pos").option("path", path).saveAsTable(name)
    return rows.sparkSession.table(name)
