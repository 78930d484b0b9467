"""Sites that several populations share: alignment by position, allele checks, polarisation and converters of tables.

Rows of a population: pop, chr, pos, ref, alt, raf (reference-allele frequency) or pop, chr, pos, aa, da, daf
(derived-allele frequency). A missing allele is ``.``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OK, REF, ALT, ALLELE = "OK", "REF_MISMATCH", "MULTIPLE_ALT", "ALLELE_MISMATCH"
MONOMORPHIC, NO_ANCESTRAL = "MONOMORPHIC_SITE", "NO_ANCESTRAL_ALLELE"


def align(rows: DataFrame, pops: list[str], fields: list[str]) -> DataFrame:
    """chr, pos and a struct ``s<i>`` for each population, for positions that all of them have. One shuffle, however many
    populations: rows are grouped by position, and no pair is joined."""
    sides = [F.max(F.when(F.col("pop") == p, F.struct(*fields))).alias(f"s{i}") for i, p in enumerate(pops)]
    together = rows.where(F.col("pop").isin(pops)).groupBy("chr", "pos").agg(*sides)
    return together.where(reduce(lambda a, b: a & b, [F.col(f"s{i}").isNotNull() for i in range(len(pops))]))


def first_allele(alleles: list[Column]) -> Column:
    """The first that is not missing, or ``.``."""
    return F.coalesce(*[F.when(a != ".", a) for a in alleles], F.lit("."))


def allele_status(n: int) -> Column:
    """Of aligned reference-allele rows: the first population that breaks the rules tells how; at one population another
    reference is tested before another alternative."""
    alt = first_allele([F.col(f"s{i}.alt") for i in range(n)])
    out = None
    for i in range(1, n):
        other_ref = F.col(f"s{i}.ref") != F.col("s0.ref")
        other_alt = (F.col(f"s{i}.alt") != ".") & (F.col(f"s{i}.alt") != alt)
        out = (F if out is None else out).when(other_ref, F.lit(REF)).when(other_alt, F.lit(ALT))
    return out


def monomorphic(frequencies: list[Column]) -> Column:
    top = F.greatest(*frequencies) if len(frequencies) > 1 else frequencies[0]
    low = F.least(*frequencies) if len(frequencies) > 1 else frequencies[0]
    return (top == 0) | (low == 1)


def polarised(rows: DataFrame, pops: list[str], outgroup: str) -> DataFrame:
    """chr, pos, ref, alt, status and daf0...: derived-allele frequencies, by what the outgroup carries."""
    n = len(pops)
    sites = align(rows, [*pops, outgroup], ["ref", "alt", "raf"])
    out = F.col(f"s{n}.raf")
    alleles = allele_status(n + 1)
    status = (
        alleles.when(monomorphic([F.col(f"s{i}.raf") for i in range(n)]), F.lit(MONOMORPHIC))
        .when((out != 0) & (out != 1), F.lit(NO_ANCESTRAL)).otherwise(F.lit(OK))
    )
    daf = [F.when(out == 0, F.col(f"s{i}.raf")).when(out == 1, 1 - F.col(f"s{i}.raf")).alias(f"daf{i}") for i in range(n)]
    return sites.select("chr", "pos", F.col("s0.ref").alias("ref"), first_allele([F.col(f"s{i}.alt") for i in range(n + 1)]).alias("alt"), status.alias("status"), (out == 0).alias("ref_derived"), *daf)


def derived(rows: DataFrame, pops: list[str]) -> DataFrame:
    """The same from derived-allele rows, whose ancestral alleles must be equal; da ``.`` fits any."""
    n = len(pops)
    sites = align(rows, pops, ["aa", "da", "daf"])
    da = first_allele([F.col(f"s{i}.da") for i in range(n)])
    other = reduce(lambda a, b: a | b, [(F.col(f"s{i}.aa") != F.col("s0.aa")) | ((F.col(f"s{i}.da") != ".") & (F.col(f"s{i}.da") != da)) for i in range(n)])
    status = F.when(monomorphic([F.col(f"s{i}.daf") for i in range(n)]), F.lit(MONOMORPHIC)).when(other, F.lit(ALLELE)).otherwise(F.lit(OK))
    return sites.select("chr", "pos", F.col("s0.aa").alias("aa"), da.alias("da"), status.alias("status"), *[F.col(f"s{i}.daf").alias(f"daf{i}") for i in range(n)])


def status_counts(sites: DataFrame) -> DataFrame:
    return sites.groupBy("status").agg(F.count(F.lit(1)).alias("n_sites"))


def join_raf(rows: DataFrame, pops: list[str]) -> DataFrame:
    """One table from several: the unweighted mean of frequencies where alleles agree."""
    n = len(pops)
    sites = align(rows, pops, ["ref", "alt", "raf"]).where(allele_status(n).isNull() if n > 1 else F.lit(True))
    mean = reduce(lambda a, b: a + b, [F.col(f"s{i}.raf") for i in range(n)]) / n
    return sites.select("chr", "pos", F.col("s0.ref").alias("ref"), first_allele([F.col(f"s{i}.alt") for i in range(n)]).alias("alt"), mean.alias("raf"))


def raf_to_daf_wide(rows: DataFrame, pops: list[str], outgroup: str) -> DataFrame:
    return polarised(rows, pops, outgroup).where(F.col("status") == OK).select("chr", "pos", *[f"daf{i}" for i in range(len(pops))])


def raf_to_daf_long(rows: DataFrame, pops: list[str], outgroup: str) -> DataFrame:
    """pop, chr, pos, aa, da, daf. The ancestral allele is the one that the outgroup carries."""
    sites = polarised(rows, pops, outgroup).where(F.col("status") == OK)
    each = F.array(*[F.struct(F.lit(p).alias("pop"), F.col(f"daf{i}").alias("daf")) for i, p in enumerate(pops)])
    aa, da = F.when(F.col("ref_derived"), F.col("alt")).otherwise(F.col("ref")), F.when(F.col("ref_derived"), F.col("ref")).otherwise(F.col("alt"))
    return sites.select("chr", "pos", aa.alias("aa"), da.alias("da"), F.inline(each)).select("pop", "chr", "pos", "aa", "da", "daf")


def duplicate_sites(rows: DataFrame) -> DataFrame:
    """Positions that a population has more than once (sorted input must not)."""
    return rows.groupBy("pop", "chr", "pos").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def best_quality(rows: DataFrame) -> DataFrame:
    """Of rows at one position the first of the highest quality; a null quality never wins over another."""
    from pyspark.sql import Window

    at = Window.partitionBy("chr", "pos").orderBy(F.col("qual").desc_nulls_last(), "line_no")
    return rows.withColumn("_n", F.row_number().over(at)).where("_n = 1").drop("_n")


def sites_per_chromosome(sites: DataFrame) -> DataFrame:
    return sites.where(F.col("status") == OK).groupBy("chr").agg(F.count(F.lit(1)).alias("n_snps"))
