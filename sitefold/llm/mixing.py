"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are dealt into blocks by a seeded hash of ``doc_id``. A source's target is a number of whole
passes over its blocks and a number of blocks of one more pass; both are exact quotas of block draws. A binary tree over
the output shards splits the quotas by multivariate-hypergeometric draws, as dealing a shuffled deck of all block draws to
the shards would. Every shard owns a run of each source's permuted blocks, disjoint from those of other shards, and draws
as many of them as the tree gave it; of whole passes it takes a run of the permuted draws. So the tree decides which
blocks are drawn and where they go. Since blocks are not equally long, the difference to the target is then taken from, or
added to, documents in permuted order, and each shard orders its documents by a seeded hash (the local shuffle).

Only per-source totals (one row a source) and quotas (sources x shards) reach the driver. Defined results: a null text
has size 0; a null source is a source of its own, after all others; documents without words take part with nothing;
repeated rows are documents of their own; empty tables give empty results; other columns pass through, whatever their
names, and those named like a result column are replaced. Reruns agree: every draw depends on the seed and the rows only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import discard, materialize, packed, read_table, unpacked

#: Production parameters: weights by source order, most repeats of a document, blocks a source (more where they would hold
#: over BLOCK_ROWS documents), output shards, seed.
WEIGHTS, MAX_REPEATS, BLOCKS, BLOCK_ROWS, SHARDS, SEED = (5.0, 2.0, 1.0), 3, 1024, 1 << 18, 64, 11
#: Rounds that bring a source nearer to its target: documents that fit what is missing, or the one that comes nearest. A
#: source within TOLERANCE of its target is left as it is.
ROUNDS, TOLERANCE = ("fit", "fit", "nearest", "fit", "fit", "nearest", "fit", "nearest"), 0.0005
WORD = r"[^\x20\x09-\x0D]+"
#: Sources up to which a row for each (some hundred bytes) is broadcast, so that rows of a large source need not meet in one task.
MOST_SENT = 100_000
RESULTS = ["size", "source_size", "target", "taken", "draws"]


def by_source(rows: DataFrame, sources: int) -> DataFrame:
    """A table of one row a source, to be sent to all tasks unless there are too many sources."""
    return F.broadcast(rows) if sources <= MOST_SENT else rows


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: list[int], weights: list[float], cap: float = MAX_REPEATS) -> list[float]:
    """Targets that share the sum of ``sizes`` by weight, none above ``cap`` times its size; the excess is reshared."""
    target = [0.0] * len(sizes)
    left, rest = float(sum(sizes)), [i for i in range(len(sizes)) if sizes[i] > 0]
    while rest:
        unit = left / sum(weights[i] for i in rest)
        full = [i for i in rest if unit * weights[i] > cap * sizes[i]]
        for i in full or rest:
            target[i] = cap * float(sizes[i]) if full else unit * weights[i]
        left -= sum(target[i] for i in full)
        rest = [i for i in rest if i not in set(full)] if full else []
    return target


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """quotas: draws of each source. Returns shards x sources; columns sum to the quotas, rows differ by one draw at most."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(counts: np.ndarray, first: int, n: int) -> None:
        if n == 1:
            out[first] = counts
            return
        half, total = n // 2, int(counts.sum())
        # shards get equal numbers of draws, the first ones one more
        left = (total // n) * half + min(total % n, half)
        rng = np.random.Generator(np.random.PCG64([seed, first, n]))
        taken = rng.multivariate_hypergeometric(counts, left, method="marginals") if total else counts
        split(taken, first, half)
        split(counts - taken, first + half, n - half)

    split(np.asarray(quotas, np.int64), 0, shards)
    return out


def draw_plan(spark: SparkSession, sources: list[tuple[str, int, int, int]], shards: int, seed: int) -> DataFrame:
    """sources: (src, blocks, whole passes, blocks of the part pass). A row for each source and shard: the run ``first`` to
    ``end`` of draws of whole passes, and the run ``own`` to ``own_end`` of permuted blocks, drawn up to ``drawn_end``."""
    n = len(sources)
    quotas = np.array([b * p for _, b, p, _ in sources] + [r for *_, r in sources], np.int64)
    dealt = split_quotas(quotas, shards, seed) if n else np.zeros((shards, 0), np.int64)
    whole, part = dealt[:, :n], dealt[:, n:]
    # blocks that are not drawn are owned in equal numbers
    spare = np.array([b - r for _, b, _, r in sources], np.int64)
    owned = part + np.diff(spare[None, :] * np.arange(shards + 1)[:, None] // shards, axis=0)
    whole_end, own_end = np.cumsum(whole, axis=0), np.cumsum(owned, axis=0)
    rows = [
        (src, k, int(whole_end[k, i] - whole[k, i]), int(whole_end[k, i]), int(own_end[k, i] - owned[k, i]), int(own_end[k, i] - owned[k, i] + part[k, i]), int(own_end[k, i]))
        for i, (src, *_) in enumerate(sources) for k in range(shards)
    ]
    return spark.createDataFrame(rows, "src string, shard int, first long, end long, own long, drawn_end long, own_end long")


def block_draws(per_block: DataFrame, plan: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """per_block: (src, block). Adds whole, the (pass, shard) of its draws in whole passes, own, the shard that owns it, and
    drawn, whether that shard draws it once more."""
    turn = Window.partitionBy("src").orderBy(F.xxhash64(F.lit(seed + 1), "src", "block"), "block")
    ranked = per_block.select("src", "block", (F.row_number().over(turn) - 1).cast("long").alias("rank")).join(sources, "src")
    run = lambda a, b, name: F.explode(F.sequence(F.col(a), F.col(b) - 1)).alias(name)
    # each whole pass is turned anew
    turned = F.pmod(F.col("rank") + F.pmod(F.xxhash64(F.lit(seed), "src", "pass"), F.col("n")), F.col("n"))
    every = ranked.where("passes > 0").select("src", "block", "rank", "n", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("pass"))
    every = every.withColumn("draw", F.col("pass") * F.col("n") + turned)
    whole = every.join(plan.where("end > first").select("src", "shard", run("first", "end", "draw")), ["src", "draw"])
    whole = whole.groupBy("src", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("whole"))  # one a pass
    owners = plan.where("own_end > own").select("src", "shard", "drawn_end", run("own", "own_end", "rank"))
    owners = ranked.join(owners, ["src", "rank"]).select("src", "block", F.col("shard").alias("own"), (F.col("rank") < F.col("drawn_end")).alias("drawn"))
    none = F.array().cast("array<struct<pass:int,shard:int>>")
    return ranked.join(owners, ["src", "block"]).join(whole, ["src", "block"], "left").select("src", "block", "own", "drawn", F.coalesce("whole", none).alias("whole"))


def towards_targets(placed: DataFrame, needs: dict[str, tuple[int, float]], seed: int) -> DataFrame:
    """placed: (src, block, pos, size, part), a row a document; part: whether its block is drawn in the part pass. needs: the
    words of a source's part pass and its target. Turns ``part`` of documents in permuted order so long as they fit what
    their source has too little or too much."""
    spark = placed.sparkSession
    for turn, kind in enumerate(ROUNDS):
        got = {r["src"]: int(r["got"]) for r in placed.where("part").groupBy("src").agg(F.sum("size").alias("got")).collect()}  # a row a source
        gaps = [(n, need - got.get(n, 0)) for n, (need, target) in needs.items() if abs(need - got.get(n, 0)) > TOLERANCE * target]
        if not gaps:
            break
        room = F.abs("gap")
        open_ = placed.join(by_source(spark.createDataFrame(gaps, "src string, gap long"), len(gaps)), "src", "left")
        open_ = open_.withColumn("open", F.coalesce((F.col("size") > 0) & (F.col("part") == (F.col("gap") < 0)), F.lit(False)))
        if kind == "fit":
            open_ = open_.withColumn("w", F.when(F.col("open") & (F.col("size") <= room), F.col("size")).otherwise(0))
            order = Window.partitionBy("src").orderBy(F.xxhash64(F.lit(seed + 3 + turn), "src", "block"), "block")
            before = open_.where("w > 0").groupBy("src", "block").agg(F.sum("w").alias("all")).select("src", "block", (F.sum("all").over(order) - F.col("all")).alias("before"))
            upto = F.sum("w").over(Window.partitionBy("src", "block").orderBy("pos"))
            picked = (F.col("w") > 0) & (F.col("before") + upto <= room)
            turned = open_.join(before, ["src", "block"], "left").withColumn("part", F.col("part") != F.coalesce(picked, F.lit(False)))
        else:  # one more document, if one comes nearer to what is still missing
            off = F.abs(room - F.col("size"))
            best = open_.where("open").where(off < room).groupBy("src").agg(F.min(F.struct(off.alias("off"), "block", "pos")).alias("best"))
            picked = (F.col("block") == F.col("best.block")) & (F.col("pos") == F.col("best.pos"))
            turned = open_.join(by_source(best, len(gaps)), "src", "left").withColumn("part", F.col("part") != F.coalesce(picked, F.lit(False)))
        was, placed = placed, materialize(turned.select(*placed.columns), "mix-part")
        discard(was)
    return placed


def mix_sources(
    docs: DataFrame, columns: list[str] | None = None, weights: tuple[float, ...] = WEIGHTS, cap: int = MAX_REPEATS,
    blocks: int = BLOCKS, shards: int = SHARDS, seed: int = SEED,
) -> DataFrame:
    """``columns`` of ``docs`` (default all) with size, source_size, target, taken and ``draws``: the (pass, shard, place)
    of each copy that the mix takes. Sizes are counted once, and all statistics come from that narrow table."""
    spark = docs.sparkSession
    kept = [c for c in (docs.columns if columns is None else columns) if c not in RESULTS]
    slim = set(kept) <= {"doc_id", "source"}
    size = word_count(F.col("text"))
    keyed = docs.select(
        packed(kept), F.col("doc_id").alias("id"), size.alias("size"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("src"),
        F.xxhash64(F.lit(seed), "doc_id", size).alias("deal"), F.xxhash64("text").alias("tie"),
    )
    narrow = materialize(keyed if slim else keyed.drop("row"), "mix-sizes")
    found = {r["src"]: (int(r["words"]), r["docs"]) for r in narrow.groupBy("src").agg(F.sum("size").alias("words"), F.count_if(F.col("size") > 0).alias("docs")).collect()}
    names = sorted(k for k in found if k != "n") + ["n"] * ("n" in found)
    sizes = [found[n][0] for n in names]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(names))], cap)
    passes = [min(int(t // s), cap) if s else 0 for t, s in zip(targets, sizes, strict=True)]

    # documents have a place in their block, the same in every run
    deals = spark.createDataFrame([(n, max(blocks, -(-found[n][1] // BLOCK_ROWS))) for n in names], "src string, deals long")

    def dealt(rows: DataFrame) -> DataFrame:
        inside = Window.partitionBy("src", "block").orderBy("deal", "id", "size", "tie")
        return rows.join(by_source(deals, len(names)), "src").withColumn("block", F.pmod("deal", "deals")).withColumn("pos", F.row_number().over(inside))

    places = materialize(dealt(narrow).drop("tie", "deals"), "mix-places")
    discard(narrow)
    per_block = places.where("size > 0").select("src", "block").distinct()
    n_blocks = {r["src"]: r["n"] for r in per_block.groupBy("src").agg(F.count(F.lit(1)).alias("n")).collect()}
    needs = {n: round(t - p * s) for n, t, p, s in zip(names, targets, passes, sizes, strict=True)}
    part = {n: min(round(needs[n] / s * n_blocks[n]), n_blocks[n]) if s else 0 for n, s in zip(names, sizes, strict=True)}
    plan = draw_plan(spark, [(n, n_blocks.get(n, 0), p, part[n]) for n, p in zip(names, passes, strict=True)], shards, seed)
    told = [(n, s, t, p, n_blocks.get(n, 0)) for n, s, t, p in zip(names, sizes, targets, passes, strict=True)]
    sources = spark.createDataFrame(told, "src string, source_size long, target double, passes int, n long")
    drawn = materialize(block_draws(per_block, plan, sources.select("src", "passes", "n"), seed), "mix-blocks")
    placed = places.join(drawn.select("src", "block", "drawn"), ["src", "block"], "left")
    placed = placed.select("src", "block", "pos", "size", ((F.col("size") > 0) & F.coalesce("drawn", F.lit(False))).alias("part"))
    placed = towards_targets(materialize(placed, "mix-part"), {n: (needs[n], t) for n, t in zip(names, targets, strict=True)}, seed)

    rows = (places if slim else dealt(keyed)).join(placed.select("src", "block", "pos", "part"), ["src", "block", "pos"])
    rows = rows.join(drawn.drop("drawn"), ["src", "block"], "left").join(by_source(sources.drop("n"), len(names)), "src")
    none = F.array().cast("array<struct<pass:int,shard:int>>")
    last = F.when(F.col("part"), F.array(F.struct(F.col("passes").alias("pass"), F.col("own").alias("shard")))).otherwise(none)
    copies = F.when(F.col("size") > 0, F.concat(F.coalesce("whole", none), last)).otherwise(none)
    place = lambda d: F.xxhash64(F.lit(seed + 2), F.col("deal"), F.col("block"), F.col("pos"), d["pass"])
    draws = F.transform(copies, lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), place(d).alias("place")))
    rows = rows.withColumn("draws", draws)
    return rows.select(*unpacked(kept), "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), "draws")


def mixed_rows(mixed: DataFrame) -> DataFrame:
    """One row for each copy the mix takes, with its shard and place."""
    kept = [c for c in mixed.columns if c not in ("draws", "pass", "shard", "place")]
    return mixed.select(*[F.col(f"`{c}`") for c in kept], F.inline("draws"))


def shuffled_rows(mixed: DataFrame) -> DataFrame:
    """The rows of the mix, each shard's together and in the order of their places: the local shuffle."""
    return mixed_rows(mixed).repartition("shard").sortWithinPartitions("shard", "place")


def write_mix(mixed: DataFrame, path: str) -> None:
    """Write the mix as one folder a shard, each shuffled locally."""
    shuffled_rows(mixed).write.partitionBy("shard").parquet(path)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs, columns=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")
