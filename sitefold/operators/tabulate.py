"""Tabulation in one pass: pattern sums, counters and a log of sites, from one derivation of the sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sitefold.functions.patterns import masks, pattern_probability

from .sites import ALLELE, ALT, MONOMORPHIC, NO_ANCESTRAL, OK, REF

STATUSES = [OK, REF, ALT, ALLELE, MONOMORPHIC, NO_ANCESTRAL]
#: Populations whose patterns are few enough to be metrics of a job.
MOST = 6


def tabulated(sites: DataFrame, frequencies: list[str], path: str, logged: list[str] | None = None, singletons: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pat, value) of the sites that are OK and (status, n_sites) of all; sites (chr, pos) with a status of ``logged`` (all but OK)
    are written at ``path``, a folder for each status. Sums and counters are metrics that Spark observes while it writes the log, so
    sites are aligned once and nothing is kept."""
    if len(frequencies) > MOST:
        raise ValueError(f"sums of more than {MOST} populations are no metrics of a job")
    every, columns, seen = masks(len(frequencies), singletons), [F.col(c) for c in frequencies], Observation()
    ok = F.col("status") == OK
    sums = [F.sum(F.when(ok, pattern_probability(columns, m))).alias(f"sum_{m}") for m in every]
    watched = sites.observe(seen, *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], *sums)
    log = watched.where(F.col("status").isin(STATUSES[1:] if logged is None else logged)).select("chr", "pos", "status")
    log.write.partitionBy("status").option("sep", "\t").csv(path)
    told, spark = seen.get, sites.sparkSession
    patterns = spark.createDataFrame([(m, told[f"sum_{m}"] or 0.0) for m in every], "pat long, value double")
    return patterns, spark.createDataFrame([(s, told[s]) for s in STATUSES if told[s]], "status string, n_sites long")
