"""Moving-blocks bootstrap of pattern counts, with equi-joins on running sums instead of a range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitefold.functions.patterns import masks, pattern_probability

#: Positions of one chromosome that are numbered in one task.
BIN = 1_000_000


def numbered(sites: DataFrame, width: int = BIN) -> DataFrame:
    """``sites`` with ``idx``, their number in order of (chr, pos) from 0. Sites are numbered within bins of positions,
    and only counts of bins pass through one task."""
    binned = sites.withColumn("_bin", F.floor(F.col("pos") / width))
    order = Window.orderBy("chr", "_bin")
    before = binned.groupBy("chr", "_bin").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.sum("_n").over(order) - F.col("_n"))
    within = Window.partitionBy("chr", "_bin").orderBy("pos")
    placed = binned.withColumn("_place", F.row_number().over(within) - 1).join(before, ["chr", "_bin"])
    return placed.withColumn("idx", F.col("_before") + F.col("_place")).drop("_bin", "_n", "_before", "_place")


def n_blocks(n: int, length: int) -> int:
    """n / length rounded half up."""
    return (2 * n + length) // (2 * length)


#: A multiplicative generator modulo a prime (so that every engine with 64-bit integers draws the same).
PRIME, FACTOR = 2_147_483_647, 48_271


def seeded_draw(seed: int, rep: Column, block: Column, below: int) -> Column:
    """A number from 0 to below - 1 for each replicate and block: squared and multiplied in turn, so that neighbours differ."""

    def turned(x: Column) -> Column:
        for k in range(3):
            x = ((x * x) % PRIME * FACTOR + (seed + k + 1)) % PRIME
        return x

    first = turned(((rep + 1) * 7_919 + (block + 1) * 104_729 + seed) % PRIME)
    return (first * PRIME + turned((first + block + 1) % PRIME)) % below


def block_starts(spark: SparkSession, n: int, length: int, reps: int, seed: int | None = None) -> DataFrame:
    """rep, block, start: starts from 0 to n - length, drawn with ``seed``. Without one they are spread by integer arithmetic."""
    if not 0 < length < n:
        raise ValueError(f"blocks of {length} need more than {n} sites")
    blocks = n_blocks(n, length)
    every = spark.range(reps * blocks).select((F.col("id") / blocks).cast("long").alias("rep"), (F.col("id") % blocks).alias("block"))
    r, b, below = F.col("rep"), F.col("block"), n - length + 1
    # remainders are taken between products, so that none leaves 64 bits for any number of blocks
    square = ((b + 1) % below * ((b + 1) % below)) % below * 104_729
    spread = ((r + 1) * 7_919 % below + square % below + ((r + 1) * (b + 3)) % below * 15_485_863 % below) % below
    return every.withColumn("start", spread if seed is None else seeded_draw(seed, r, b, below))


def multiplicity(starts: DataFrame, sites: DataFrame, length: int) -> DataFrame:
    """rep, idx, w: in how many of a replicate's blocks a site lies. Blocks are cut at multiples of their length, so each
    meets the sites of two cells and the join is an equi-join."""
    cell = lambda c: F.floor(c / length)
    blocks = starts.select("rep", "start", F.explode(F.array(cell(F.col("start")), cell(F.col("start")) + 1)).alias("cell"))
    met = sites.withColumn("cell", cell(F.col("idx"))).join(blocks, "cell").where((F.col("idx") >= F.col("start")) & (F.col("idx") < F.col("start") + length))
    return met.groupBy("rep", "idx").agg(F.count(F.lit(1)).alias("w"))


def replicate_counts(sites: DataFrame, frequencies: list[str], starts: DataFrame, length: int, singletons: bool = False) -> DataFrame:
    """rep, pat, value. Sites are summed up within cells of ``length``, so a block is the end of one cell and the begin of the
    next: two equi-joins on running sums, nothing is multiplied out, and no sum is longer than a cell."""
    every = masks(len(frequencies), singletons)
    columns = [F.col(c) for c in frequencies]
    named = sites.select("idx", F.floor(F.col("idx") / length).alias("_cell"), *[pattern_probability(columns, m).alias(f"_{m}") for m in every])
    upto, whole = Window.partitionBy("_cell").orderBy("idx"), Window.partitionBy("_cell")
    run = named.select("idx", *[F.sum(f"_{m}").over(upto).alias(f"_r{m}") for m in every], *[F.sum(f"_{m}").over(whole).alias(f"_t{m}") for m in every])
    after = F.col("idx") + 1
    first = run.where(after % length != 0).select(after.alias("start"), *[(F.col(f"_t{m}") - F.col(f"_r{m}")).alias(f"first_{m}") for m in every])
    last = run.select(after.alias("end"), *[F.col(f"_r{m}").alias(f"last_{m}") for m in every])
    blocks = starts.withColumn("end", F.col("start") + length).join(last, "end").join(first, "start", "left")
    wide = blocks.groupBy("rep").agg(*[F.sum(F.col(f"last_{m}") + F.coalesce(f"first_{m}", F.lit(0.0))).alias(f"_{m}") for m in every])
    pairs = F.array(*[F.struct(F.lit(m).cast("long").alias("pat"), F.col(f"_{m}").alias("value")) for m in every])
    return wide.select("rep", F.inline(pairs))


def percentile_interval(counts: DataFrame, by: list[str], value: str = "value", confidence: float = 0.95) -> DataFrame:
    """``by``, low, high: percentile limits by linear interpolation."""
    tail = (1 - confidence) / 2
    told = counts.groupBy(*by).agg(F.expr(f"percentile({value}, array({tail}D, {1 - tail}D))").alias("_p"))
    return told.select(*by, F.get("_p", F.lit(0)).alias("low"), F.get("_p", F.lit(1)).alias("high"))
