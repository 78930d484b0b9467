"""Quality rules with robust multivariate outliers. DataFrame functions only.

Statistics of each text (words, symbols, repeated lines, words in repeated three-word windows) are transformed into a
vector. For each language and source, each language, and all documents, a minimum-covariance-determinant estimate is made
of the vectors that pass the base rules. From several starts (the coordinate-wise median, and small sets of vectors drawn
by hashes) concentration steps take mean and covariance of the nearest three quarters by Mahalanobis distance again. The weight
of the nearest is fixed: distances are binned, and the last bin counts with the part of it that is needed. A start is done when a
step does not lower its determinant, and keeps the estimate before that step; of all starts the least determinant wins. Each
coordinate has a scale below
which differences do not count; its square is added to the variance (the regularised form of the estimator), so that
statistics that are constant in most documents do not make the covariance singular. A document is rejected if its distance
is beyond a chi-square quantile.

Every group has an estimate of its own. That of a group with fewer than ``FULL`` documents is mixed with that of its
language, in proportion to its documents, and a language's with that of all documents in the same way. Vectors that fall
into one cell of a fine grid are one weighted point, and moments are summed by bins of the distance, so no group is
gathered in one task and results do not depend on the partitioning.

Defined results: a null text has no words, and fails the base rules as an empty one does; null languages and sources are
groups of their own; repeated rows are judged alike, each on its own; empty tables give empty results; other columns
pass through, whatever their names, and those named like a result column are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import discard, materialize, packed, read_table, unpacked

WORD, SPACE, SYMBOL = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+", r"[#*$%&|<>]"
#: Base rules: least words, largest percentage of words in repeated windows.
MIN_WORDS, MAX_REPEATED = 50, 50
#: Documents of a group whose estimate stands alone; share of them that it rests on; most steps; starts besides the median;
#: quantile of the distance.
FULL, SHARE, STEPS, STARTS, QUANTILE = 100, 0.75, 60, 3, 0.99999
#: A determinant's logarithm that falls by less has settled.
SETTLED = 1e-9
#: What each coordinate is and the scale below which differences do not count.
COORDINATES = {
    "_z0": (lambda: F.col("word_chars") / F.col("n_words"), 0.3),
    "_z1": (lambda: F.log1p(100 * F.col("n_symbols") / F.col("n_words")), 0.25),
    "_z2": (lambda: F.sqrt(F.col("n_repeat_words") / F.col("n_words")), 0.15),
    "_z3": (lambda: F.log1p(100 * F.col("n_dup_lines") / F.col("n_words")), 0.5),
}
Z = list(COORDINATES)
RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
#: Values are clipped to +-LIMIT scales; medians are read off a grid of 1/GRID scales; points are cells of 1/CELL scales.
LIMIT, GRID, CELL = 1000.0, 16, 1024
#: Parts of a group's points that meet its estimate apart from one another: all documents are one of the groups.
SALTS = 64


def chi_square_cdf(x: float, even: int) -> float:
    """Of a chi-square variable with an even number of degrees of freedom."""
    term = total = math.exp(-x / 2)
    for k in range(1, even // 2):
        term *= x / 2 / k
        total += term
    return 1 - total


def chi_square_quantile(p: float, even: int) -> float:
    low, high = 0.0, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, even) < p else (low, mid)
    return (low + high) / 2


CUTOFF = chi_square_quantile(QUANTILE, len(Z))
#: Makes the covariance of the nearest SHARE consistent for normal vectors.
CONSISTENCY = SHARE / chi_square_cdf(chi_square_quantile(SHARE, len(Z)), len(Z) + 2)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_window_words(words: Column) -> Column:
    """Words in three-word windows that are found at least twice."""

    def marked(grams: Column) -> Column:
        pairs = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda k, by: F.coalesce(F.get(s, k + by)["g"] == F.get(s, k)["g"], F.lit(False))
            again = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, -1) | same(k, 1))
            return F.array_sort(F.transform(again, lambda k: F.get(s, k)["i"]))

        covered = lambda at: F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(3), p - F.coalesce(F.get(at, k - 1), F.lit(-3)))), F.lit(0), lambda a, x: a + x)
        return let(let(pairs, places), covered)

    windows = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    counted = lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(marked(g))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(windows(words), counted))


def text_statistics(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` with the statistics of the whole text and base_failed."""
    text = F.coalesce("text", F.lit(""))
    lines = lambda t: F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    of_words = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        repeated_window_words(w).cast("long").alias("n_repeat_words"),
    )
    told = docs.select(
        *columns,
        let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of_words).alias("_w"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        let(lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    flat = told.select(*columns, "_w.n_words", "_w.word_chars", "n_symbols", "n_dup_lines", "_w.n_repeat_words")
    return flat.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED} * n_words"))


def group_keys(lang: Column, source: Column) -> Column:
    """Of the document's group, its language, and all documents."""
    mark = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("?"))
    return F.array(F.concat(F.lit("2"), mark(lang), F.lit("\n"), mark(source)), F.concat(F.lit("1"), mark(lang)), F.lit("0"))


def clipped() -> dict[str, Column]:
    return {z: F.least(F.greatest(value() / scale, F.lit(-LIMIT)), F.lit(LIMIT)) for z, (value, scale) in COORDINATES.items()}


def points(stats: DataFrame) -> DataFrame:
    """(key, n, _z0..., _salt): for each group the occupied cells of the grid, with their documents and mean vector."""
    rows = stats.where(~F.col("base_failed")).select("lang", "source", *[x.alias(z) for z, x in clipped().items()])
    cells = rows.groupBy("lang", "source", *[F.floor(F.col(z) * CELL).alias(f"{z}c") for z in Z]).agg(F.count(F.lit(1)).alias("n"), *[F.sum(z).alias(z) for z in Z])
    cells = cells.withColumn("key", F.explode(group_keys(F.col("lang"), F.col("source"))))
    every = cells.groupBy("key", *[f"{z}c" for z in Z]).agg(F.sum("n").alias("n"), *[F.sum(z).alias(z) for z in Z])
    return every.select("key", "n", *[(F.col(z) / F.col("n")).alias(z) for z in Z], F.pmod(F.xxhash64(*[f"{z}c" for z in Z]), F.lit(SALTS)).cast("int").alias("_salt"))


def grid_quantile(rows: DataFrame, keys: list[str], share: float) -> DataFrame:
    """keys and q: the smallest ``bin`` up to which a share of the documents (``n``) lies."""
    counts = rows.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    upto, whole = Window.partitionBy(*keys).orderBy("bin"), Window.partitionBy(*keys)
    told = counts.withColumns({"upto": F.sum("n").over(upto), "whole": F.sum("n").over(whole)})
    return told.where(F.col("upto") >= share * F.col("whole")).groupBy(*keys).agg(F.min("bin").alias("q"))


def moments() -> list[str]:
    return [f"_m{i}" for i in range(len(Z))] + [f"_v{i}_{j}" for i in range(len(Z)) for j in range(i, len(Z))]


def factors() -> list[str]:
    return [f"_l{i}_{j}" for i in range(len(Z)) for j in range(i + 1)]


def with_factor(estimate: DataFrame, consistency: float = CONSISTENCY) -> DataFrame:
    """Adds _l, the Cholesky factor of the covariance with the scales' squares (1) added, and its determinant's logarithm."""
    told = []  # each refers to those before it in the same projection
    for i in range(len(Z)):
        for j in range(i + 1):
            value = f"_v{j}_{i} * {consistency!r}D + {1.0 if i == j else 0.0}D" + "".join(f" - _l{i}_{k} * _l{j}_{k}" for k in range(j))
            told.append(f"sqrt(greatest({value}, 1e-6D)) AS _l{i}_{j}" if i == j else f"({value}) / _l{j}_{j} AS _l{i}_{j}")
    return estimate.selectExpr("*", *told, " + ".join(f"2 * ln(_l{i}_{i})" for i in range(len(Z))) + " AS logdet")


def with_distance(rows: DataFrame) -> DataFrame:
    """Adds _d2, the squared Mahalanobis distance, by forward substitution."""
    told = [f"({z} - _m{i}" + "".join(f" - _l{i}_{k} * _y{k}" for k in range(i)) + f") / _l{i}_{i} AS _y{i}" for i, z in enumerate(Z)]
    return rows.selectExpr("*", *told, " + ".join(f"_y{i} * _y{i}" for i in range(len(Z))) + " AS _d2")


def distance_bin(d2: Column) -> Column:
    return F.floor(F.log1p(d2) * 256).cast("int")


def first_estimates(rows: DataFrame) -> DataFrame:
    """key, start, _m and _l of each start: the median with the scales, and sets of one vector more than coordinates."""
    bins = F.array(*[F.struct(F.lit(i).alias("coordinate"), F.floor(F.col(z) * GRID).cast("int").alias("bin")) for i, z in enumerate(Z)])
    middles = grid_quantile(rows.select("key", "n", F.inline(bins)), ["key", "coordinate"], 0.5)
    median = middles.groupBy("key").agg(*[F.max(F.when(F.col("coordinate") == i, (F.col("q") + 0.5) / GRID)).alias(f"_m{i}") for i in range(len(Z))])
    median = median.select("key", F.lit(0).alias("start"), *[f"_m{i}" for i in range(len(Z))], *[F.lit(float(i == j)).alias(f"_l{i}_{j}") for i in range(len(Z)) for j in range(i + 1)])
    some = len(Z) + 1
    pick = lambda s, k: F.min(F.struct(F.xxhash64(F.lit(1000 * s + k), *Z).alias("h"), *Z)).alias(f"p{s}_{k}")
    drawn = rows.groupBy("key").agg(*[pick(s, k) for s in range(1, STARTS + 1) for k in range(some)])
    starts = median
    ij = [(i, j) for i in range(len(Z)) for j in range(i, len(Z))]
    for s in range(1, STARTS + 1):
        mean = [f"({' + '.join(f'p{s}_{k}.{z}' for k in range(some))}) / {some}" for z in Z]
        means = drawn.selectExpr("*", *[f"{m} AS _m{i}" for i, m in enumerate(mean)])
        spread = [" + ".join(f"(p{s}_{k}.{Z[i]} - _m{i}) * (p{s}_{k}.{Z[j]} - _m{j})" for k in range(some)) for i, j in ij]
        mine = with_factor(means.selectExpr("key", *[f"_m{i}" for i in range(len(Z))], *[f"({x}) / {some} AS _v{i}_{j}" for (i, j), x in zip(ij, spread, strict=True)]), 1.0)
        starts = starts.unionByName(mine.select("key", F.lit(s).alias("start"), *[f"_m{i}" for i in range(len(Z))], *factors()))
    return starts.withColumn("logdet", F.lit(float("inf")))


def concentrated(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """One concentration step of every start: mean and covariance of the nearest share. Sums are made by bins of the distance
    (around the last mean, so that they lose no digits), in one pass over the points."""
    told = estimates.groupBy("key").agg(F.collect_list(F.struct("start", *[f"_m{i}" for i in range(len(Z))], *factors(), "logdet")).alias("e"))  # a few starts
    met = rows.join(told.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["key", "_salt"])
    each = with_distance(met.select("key", "n", *Z, F.inline("e"))).withColumn("bin", distance_bin(F.col("_d2")))
    ij = [(i, j) for i in range(len(Z)) for j in range(i, len(Z))]
    off = [f"({z} - _m{i})" for i, z in enumerate(Z)]
    sums = {f"s{i}": f"sum(n * {x})" for i, x in enumerate(off)} | {f"s{i}_{j}": f"sum(n * {off[i]} * {off[j]})" for i, j in ij}
    same = [F.expr(f"first(_m{i})").alias(f"_m{i}") for i in range(len(Z))]
    binned = each.groupBy("key", "start", "bin").agg(F.sum("n").alias("n"), *[F.expr(x).alias(k) for k, x in sums.items()], *same, F.first("logdet").alias("was"))
    upto, whole = Window.partitionBy("key", "start").orderBy("bin"), Window.partitionBy("key", "start")
    near = binned.withColumns({"upto": F.sum("n").over(upto), "whole": F.sum("n").over(whole)})
    # the last bin counts with the part that makes the share full
    want = f"({SHARE}D * whole - upto + n)"
    near = near.where(f"{want} > 0").withColumn("part", F.expr(f"least(1.0D, {want} / n)")).groupBy("key", "start")
    near = near.agg(F.expr("sum(n * part)").alias("h"), F.first("whole").alias("n"), F.first("was").alias("was"), *[F.expr(f"sum({k} * part)").alias(k) for k in sums], *same)
    spread = [f"s{i}_{j} / h - s{i} / h * s{j} / h AS _v{i}_{j}" for i, j in ij]
    near = near.selectExpr("key", "start", "n", "was", *spread, *[f"_m{i} + s{i} / h AS _m{i}" for i in range(len(Z))])
    return with_factor(near).select("key", "start", "n", "was", "logdet", *moments(), *factors())


def mcd_estimates(stats: DataFrame) -> DataFrame:
    """key, n, logdet, _m, _v and _l of each group, language and all documents: the least determinant over all starts and steps.
    Only starts whose determinant fell take another step; the others' points are not looked at any more."""
    rows = materialize(points(stats), "points")
    moving, done = materialize(first_estimates(rows), "mcd"), []
    for step in range(STEPS):
        stepped = materialize(concentrated(rows, moving), "mcd")
        fell = F.col("was") - F.col("logdet") > SETTLED
        if step:  # a start's first estimate is no estimate of the share
            done.append(moving.join(stepped.where(~fell).select("key", "start"), ["key", "start"]).select("key", "start", "n", "logdet", *moments(), *factors()))
        moving = stepped.where(fell)
        if moving.isEmpty():
            break
    else:
        done.append(moving.select("key", "start", "n", "logdet", *moments(), *factors()))
    every = reduce(DataFrame.unionByName, done or [moving.select("key", "start", "n", "logdet", *moments(), *factors())])
    best = every.groupBy("key").agg(F.min_by(F.struct("n", "logdet", *moments(), *factors()), F.struct("logdet", "start")).alias("e"))
    out = materialize(best.select("key", "e.*"), "mcd-best")
    discard(rows)
    return out


def mixed_with(groups: DataFrame, own: str, parent: str) -> DataFrame:
    """``groups`` with the moments of ``own`` mixed with those of ``parent`` in proportion to the documents of ``own``. Written,
    since the optimizer would otherwise put one mixture's expressions into the next one's again and again."""
    w = F.least(F.lit(1.0), F.coalesce(F.col(f"{own}.n"), F.lit(0)) / F.lit(float(FULL)))
    # without a document that passes the base rules, a group is its parent
    mine = lambda c: F.coalesce(F.col(f"{own}.{c}"), F.col(f"{parent}.{c}"))
    blend = lambda c: w * mine(c) + (1 - w) * F.col(f"{parent}.{c}")
    apart = lambda i: mine(f"_m{i}") - F.col(f"{parent}._m{i}")
    means = [blend(f"_m{i}").alias(f"_m{i}") for i in range(len(Z))]
    # the covariance is that of a mixture: the distance of the means counts as well
    spread = [(blend(f"_v{i}_{j}") + w * (1 - w) * apart(i) * apart(j) / CONSISTENCY).alias(f"_v{i}_{j}") for i in range(len(Z)) for j in range(i, len(Z))]
    return materialize(groups.withColumn(own, F.struct(F.col(f"{own}.n").alias("n"), *means, *spread)), "mixtures")


def group_estimates(stats: DataFrame) -> DataFrame:
    """lang, source, _m and _l: what documents of each language and source are judged by."""
    estimates = materialize(mcd_estimates(stats).select("key", F.struct("n", *moments()).alias("e")), "estimates")
    combos = stats.select("lang", "source").distinct().withColumn("keys", group_keys(F.col("lang"), F.col("source")))
    for k, name in enumerate(("own", "tongue", "every")):
        combos = combos.withColumn("key", F.get("keys", F.lit(k))).join(estimates.withColumnRenamed("e", name), "key", "left").drop("key")
    combos = mixed_with(mixed_with(combos.drop("keys"), "tongue", "every"), "own", "tongue")
    return materialize(with_factor(combos.select("lang", "source", "own.*")).select("lang", "source", *[f"_m{i}" for i in range(len(Z))], *factors()), "groups")


def judge_quality(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (default all) with the statistics, base_failed, distance2 and kept."""
    kept = [c for c in (docs.columns if columns is None else columns) if c not in (*RESULTS, "distance2")]
    slim = set(kept) <= {"doc_id", "lang", "source"}
    stats = text_statistics(docs.select(packed(kept), "text", "lang", "source"), ["row", "lang", "source"])
    narrow = materialize(stats if slim else stats.drop("row"), "stats")
    named = group_estimates(narrow).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    rows = narrow if slim else stats
    joined = rows.join(named, rows["lang"].eqNullSafe(named["_lang"]) & rows["source"].eqNullSafe(named["_source"]), "left")
    judged = with_distance(joined.withColumns({z: F.when(F.col("n_words") > 0, x) for z, x in clipped().items()}))
    judged = judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("_d2") <= CUTOFF, F.lit(True)))
    return judged.select(*unpacked(kept), *RESULTS, F.col("_d2").alias("distance2"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judge_quality(docs, columns=["doc_id"]).select("doc_id", *RESULTS)
