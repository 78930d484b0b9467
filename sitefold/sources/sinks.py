"""Writers. Tables go out as Spark writes them, one file a partition; text formats keep their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_patterns(table: DataFrame, path: str) -> None:
    """label and value as two text columns under a ``# SitePat`` line. A pattern table has at most 2**K rows."""
    head = table.sparkSession.range(1).select(F.lit(-1).cast("long").alias("rank"), F.format_string("%15s %20s", F.lit("# SitePat"), F.lit("E[count]")).alias("value"))
    rows = table.select("rank", F.format_string("%15s %20.7f", "label", "value").alias("value"))
    head.unionByName(rows).coalesce(1).sortWithinPartitions("rank").select("value").write.text(path)


def write_replicates(counts: DataFrame, path: str) -> None:
    """A folder for each bootstrap replicate."""
    counts.write.partitionBy("rep").option("sep", "\t").csv(path)


def write_frequencies(rows: DataFrame, path: str) -> None:
    rows.write.option("sep", "\t").csv(path)


def write_by_chromosome(rows: DataFrame, path: str) -> None:
    """A folder for each chromosome; fails if the place is taken."""
    rows.write.partitionBy("chr").mode("errorifexists").option("sep", "\t").csv(path)


def write_rejected(sites: DataFrame, path: str) -> None:
    """Sites that were not used, by the reason."""
    sites.where("status <> 'OK'").write.partitionBy("status").option("sep", "\t").csv(path)
