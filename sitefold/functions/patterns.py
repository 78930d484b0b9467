"""Site patterns as bit masks: bit j is on where population j carries the derived allele."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A mask, and its rank with the number of its bits above it, are non-negative LONGs.
MAX_POPULATIONS = 56
#: Populations whose products are multiplied out in one array: no array holds more than 2**CHUNK patterns.
CHUNK = 8


def check_labels(labels: list[str]) -> list[str]:
    """Distinct names that start with a letter and hold letters, digits, ``_``, ``:`` and ``.`` only."""
    import re

    if not 0 < len(labels) <= MAX_POPULATIONS or len(set(labels)) != len(labels) or not all(re.fullmatch(r"[A-Za-z][\w:.]*", x) for x in labels):
        raise ValueError(f"1 to {MAX_POPULATIONS} distinct legal labels are needed, not {labels}")
    return labels


def bit(mask: Column, j: int) -> Column:
    return mask.bitwiseAND(F.lit(1 << j)) != 0


def pattern_label(mask: Column, labels: list[str]) -> Column:
    """Labels of the bits that are on, in order of bits, joined by ``:``."""
    return F.array_join(F.array_compact(F.array(*[F.when(bit(mask, j), F.lit(x)) for j, x in enumerate(labels)])), ":")


def label_mask(label: Column, labels: list[str]) -> Column:
    """The mask of a pattern label; 0 if a part of it is unknown."""
    parts = F.split(label, ":")
    known = F.size(F.array_except(parts, F.array(*map(F.lit, labels)))) == 0
    total = reduce(lambda a, b: a + b, [F.when(F.array_contains(parts, x), F.lit(1 << j)).otherwise(F.lit(0)) for j, x in enumerate(labels)])
    return F.when(known, total.cast("long")).otherwise(F.lit(0).cast("long"))


def pattern_rank(mask: Column, k: int) -> Column:
    """Sorts patterns by the number of bits, then as their labels are sorted (low bits first)."""
    reverse = reduce(lambda a, b: a + b, [F.when(bit(mask, j), F.lit(1 << (k - 1 - j))).otherwise(F.lit(0)) for j in range(k)])
    return (F.bit_count(mask).cast("long") * F.lit(1 << k) + F.lit((1 << k) - 1) - reverse).cast("long")


def masks(k: int, singletons: bool = False) -> list[int]:
    """All masks but none and all; without ``singletons`` those with one bit are left out too."""
    return [m for m in range(1, (1 << k) - 1) if singletons or m & (m - 1)]


def pattern_domain(spark: SparkSession, labels: list[str], singletons: bool = False) -> DataFrame:
    """pat, label, rank of every pattern."""
    k = len(check_labels(labels))
    every = spark.range(1, (1 << k) - 1).select(F.col("id").alias("pat"))
    return every.where(singletons | (F.bit_count("pat") > 1)).select("pat", pattern_label(F.col("pat"), labels).alias("label"), pattern_rank(F.col("pat"), k).alias("rank"))


def remap(mask: Column, to: list[int]) -> Column:
    """OR of ``to[j]`` over the bits j that are on."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(bit(mask, j), F.lit(t).cast("long")).otherwise(F.lit(0).cast("long")) for j, t in enumerate(to)])


def removal_map(k: int, removed: set[int]) -> list[int]:
    """Removed bits go; the others close up."""
    kept = [j for j in range(k) if j not in removed]
    return [1 << kept.index(j) if j in kept else 0 for j in range(k)]


def collapse_map(k: int, collapsed: set[int]) -> list[int]:
    """Collapsed bits become the lowest of them; the bits above close up."""
    kept = [j for j in range(k) if j not in collapsed or j == min(collapsed)]
    return [1 << kept.index(min(collapsed) if j in collapsed else j) for j in range(k)]


def pattern_probability(frequencies: list[Column], mask: int) -> Column:
    """Product of p_j over the bits that are on and 1 - p_j over the others."""
    return reduce(lambda a, b: a * b, [p if mask >> j & 1 else 1 - p for j, p in enumerate(frequencies)])


def occurring_patterns(sites: DataFrame, frequencies: list[str], keep: list[str]) -> DataFrame:
    """``keep``, pat and z: a row for each pattern that a site shows with a probability z other than 0, monomorphic ones included.

    A population at 0 or 1 does not branch, so a site makes 2 ** (undecided populations) rows, however many populations there
    are. Undecided ones are multiplied out ``CHUNK`` at a time, each product of a chunk with all of the next, so that arrays stay small.
    Sites with a null frequency show nothing."""
    columns = [F.col(c) for c in frequencies]
    known = reduce(lambda a, b: a & b, [p.isNotNull() for p in columns])
    fixed = reduce(lambda a, b: a.bitwiseOR(b), [F.when(p == 1, F.lit(1 << j)).otherwise(F.lit(0)).cast("long") for j, p in enumerate(columns)])
    branches = F.array(*[F.struct(F.lit(1 << j).cast("long").alias("bit"), p.cast("double").alias("p")) for j, p in enumerate(columns)])
    undecided = F.filter(branches, lambda b: (b["p"] != 0) & (b["p"] != 1))
    rows = sites.where(known).select(*keep, undecided.alias("_u"), fixed.alias("pat"), F.lit(1.0).alias("z"))

    def both(products: Column, b: Column) -> Column:
        without = lambda e: F.struct(e["pat"].alias("pat"), (e["z"] * (1 - b["p"])).alias("z"))
        with_it = lambda e: F.struct(e["pat"].bitwiseOR(b["bit"]).alias("pat"), (e["z"] * b["p"]).alias("z"))
        return F.concat(F.transform(products, without), F.transform(products, with_it))

    for first in range(0, len(columns), CHUNK):
        start = F.array(F.struct("pat", "z"))
        rows = rows.select(*keep, "_u", F.inline(F.aggregate(F.slice("_u", first + 1, CHUNK), start, both)))
    return rows.drop("_u")


def is_pattern(k: int, singletons: bool) -> Column:
    """Of ``pat``: neither none nor all of ``k`` populations and, without ``singletons``, more than one."""
    some = (F.col("pat") > 0) & (F.col("pat") < (1 << k) - 1)
    return some if singletons else some & (F.bit_count("pat") > 1)


def pattern_sums(sites: DataFrame, frequencies: list[str], singletons: bool = False, by: list[str] | None = None, wide: int = 6) -> DataFrame:
    """``by``, pat and value: the sum over sites of each pattern's probability.

    Up to ``wide`` populations every pattern is a sum of its own, so sites are never multiplied and partial sums are all
    that is shuffled. Beyond that, sites are expanded to the patterns they show; patterns that no site shows have no row.
    """
    by, columns = by or [], [F.col(c) for c in frequencies]
    if len(frequencies) <= wide:
        every = masks(len(frequencies), singletons)
        sums = sites.groupBy(*by).agg(*[F.sum(pattern_probability(columns, m)).alias(f"_{m}") for m in every])
        pairs = F.array(*[F.struct(F.lit(m).cast("long").alias("pat"), F.coalesce(F.col(f"_{m}"), F.lit(0.0)).alias("value")) for m in every])
        return sums.select(*by, F.inline(pairs))
    if len(frequencies) > MAX_POPULATIONS:
        raise ValueError(f"at most {MAX_POPULATIONS} populations")
    rows = occurring_patterns(sites, frequencies, by).where(is_pattern(len(frequencies), singletons))
    return rows.groupBy(*by, "pat").agg(F.sum("z").alias("value"))
