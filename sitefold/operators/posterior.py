"""Posterior probability of admixture, given expected pattern tables with (p1) and without (p0) it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefold.functions.patterns import is_pattern, masks, occurring_patterns, pattern_probability


def conditional(zero: DataFrame, one: DataFrame, admix: float) -> DataFrame:
    """pat and c = a p1 / ((1 - a) p0 + a p1); null where both are 0."""
    both = zero.select("pat", F.col("value").alias("p0")).join(one.select("pat", F.col("value").alias("p1")), "pat")
    return both.select("pat", F.try_divide(admix * F.col("p1"), (1 - admix) * F.col("p0") + admix * F.col("p1")).alias("c"))


def site_posterior(sites: DataFrame, frequencies: list[str], c: DataFrame, singletons: bool = False, wide: int = 6) -> DataFrame:
    """chr, pos, posterior: the mean of c weighted by each pattern's probability at the site; null where all are 0. Beyond ``wide``
    populations only patterns that a site shows are looked up."""
    k = len(frequencies)
    if k > wide:
        shown = occurring_patterns(sites, frequencies, ["chr", "pos"]).withColumn("z", F.when(is_pattern(k, singletons), F.col("z")))
        told = shown.join(c.select("pat", "c"), "pat", "left").groupBy("chr", "pos").agg(F.sum("z").alias("_z"), F.sum(F.col("z") * F.coalesce("c", F.lit(0.0))).alias("_zc"))
        return told.select("chr", "pos", F.try_divide("_zc", "_z").alias("posterior"))
    every, z, held = _weights(sites, frequencies, c, singletons)
    total, weighted = F.lit(0.0), F.lit(0.0)
    for m in every:
        total, weighted = total + z[m], weighted + z[m] * F.coalesce(F.col(f"_c{m}"), F.lit(0.0))
    return held.select("chr", "pos", F.try_divide(weighted, total).alias("posterior"))


def _weights(sites: DataFrame, frequencies: list[str], c: DataFrame, singletons: bool) -> tuple[list[int], dict[int, Column], DataFrame]:
    """The patterns, the probability of each at a site, and sites with a column of c for each."""
    every, columns = masks(len(frequencies), singletons), [F.col(f) for f in frequencies]
    one = c.agg(*[F.max(F.when(F.col("pat") == m, F.col("c"))).alias(f"_c{m}") for m in every])
    return every, {m: pattern_probability(columns, m) for m in every}, sites.join(F.broadcast(one))  # one row


def pattern_frequencies(sites: DataFrame, frequencies: list[str], c: DataFrame, singletons: bool = False, wide: int = 6) -> DataFrame:
    """pat, frequency, c, mean_posterior and n_sites: each pattern's share of the weights of all sites (a site's weights add up to
    1; one that shows no pattern has none), and the mean posterior, from the same pass. The frequencies' mean of c is that mean."""
    k = len(frequencies)
    if k > wide:
        shown = occurring_patterns(sites, frequencies, ["chr", "pos"]).where(is_pattern(k, singletons))
        total = shown.groupBy("chr", "pos").agg(F.sum("z").alias("_z")).where("_z > 0")
        weights = shown.join(total, ["chr", "pos"]).groupBy("pat").agg(F.sum(F.col("z") / F.col("_z")).alias("w"))
        told = weights.join(c.select("pat", "c"), "pat", "left")
        whole = told.agg(F.sum("w").alias("_w"), F.sum(F.col("w") * F.coalesce("c", F.lit(0.0))).alias("_wc"))
        both = told.join(F.broadcast(whole))  # one row
        return both.select("pat", (F.col("w") / F.col("_w")).alias("frequency"), "c", (F.col("_wc") / F.col("_w")).alias("mean_posterior"), F.round("_w").cast("long").alias("n_sites"))
    every, z, held = _weights(sites, frequencies, c, singletons)
    total = reduce(lambda a, b: a + b, [z[m] for m in every])
    share = {m: F.try_divide(z[m], F.col("_total")) for m in every}
    mean = reduce(lambda a, b: a + b, [share[m] * F.coalesce(F.col(f"_c{m}"), F.lit(0.0)) for m in every])
    sums = held.withColumn("_total", total).agg(
        *[F.sum(share[m]).alias(f"_w{m}") for m in every], *[F.max(f"_c{m}").alias(f"_c{m}") for m in every],
        F.avg(mean).alias("mean_posterior"), F.count(mean).alias("n_sites"),
    )
    rows = [F.struct(F.lit(m).cast("long").alias("pat"), F.try_divide(F.col(f"_w{m}"), F.col("n_sites")).alias("frequency"), F.col(f"_c{m}").alias("c")) for m in every]
    return sums.select(F.inline(F.array(*rows)), "mean_posterior", "n_sites")


def mean_posterior(posteriors: DataFrame) -> DataFrame:
    return posteriors.agg(F.avg("posterior").alias("mean_posterior"), F.count("posterior").alias("n_sites"))


def pattern_posterior(observed: DataFrame, c: DataFrame) -> DataFrame:
    """The mean of c over the shares of an observed table."""
    both = observed.select("pat", "value").join(c, "pat")
    return both.agg(F.try_divide(F.sum(F.col("value") * F.col("c")), F.sum("value")).alias("mean_posterior"))
