"""Comparing and averaging fitted models, and statistics of estimates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import normalised


def mean_squared_difference(tables: DataFrame, fits: DataFrame) -> DataFrame:
    """i, j, msd of each table i against each fit j. tables: i, pat, value; fits: j, pat, value."""
    a = normalised(tables, ["i"]).withColumnRenamed("value", "x")
    b = normalised(fits, ["j"]).withColumnRenamed("value", "y")
    return a.join(b, "pat").groupBy("i", "j").agg(F.avg((F.col("x") - F.col("y")) ** 2).alias("msd"))


def bootstrap_prediction_error(tables: DataFrame, fits: DataFrame) -> DataFrame:
    """i, bepe: the mean over j <> i of what fit j makes of data i and fit i of data j. Both are numbered alike."""
    msd = mean_squared_difference(tables, fits).where("i <> j")
    each = msd.select(F.col("i").alias("k"), "msd").union(msd.select(F.col("j").alias("k"), "msd"))
    return each.groupBy("k").agg((F.sum("msd") * 2 / F.count(F.lit(1))).alias("bepe")).withColumnRenamed("k", "i")


def covariance(rows: DataFrame, names: list[str]) -> DataFrame:
    """a, b, cov: population covariances of all pairs of columns, from one pass of partial sums."""
    pairs = [(a, b) for a in names for b in names]
    told = rows.agg(*[F.covar_pop(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return told.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("cov")) for a, b in pairs])))


def hessian(points: DataFrame, names: list[str]) -> np.ndarray:
    """Second derivatives of lnL at the first point (ord 0) by quadratic regression. The normal equations are sums over
    the points, made on the executors; only as many numbers as there are coefficients squared are solved here."""
    first = points.where("ord = 0").select("lnL", *names).first()
    d = [F.col(n) - F.lit(float(first[n])) for n in names]
    terms = [F.lit(1.0), *d, *[d[j] * d[k] for j in range(len(d)) for k in range(j, len(d))]]
    y = F.col("lnL") - F.lit(float(first["lnL"]))
    n = len(terms)
    sums = points.agg(*[F.sum(terms[i] * terms[j]).alias(f"a{i}_{j}") for i in range(n) for j in range(i, n)], *[F.sum(terms[i] * y).alias(f"b{i}") for i in range(n)]).first()
    a = np.array([[sums[f"a{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
    scale = 1 / np.sqrt(np.maximum(np.diag(a), 1e-300))
    beta = np.linalg.lstsq(a * scale[:, None] * scale, np.array([sums[f"b{i}"] for i in range(n)]) * scale, rcond=None)[0] * scale
    out, at = np.zeros((len(d), len(d))), 1 + len(d)
    for j in range(len(d)):
        for k in range(j, len(d)):
            out[j, k] = out[k, j] = beta[at] * (2 if j == k else 1)
            at += 1
    return out


def clic(lnl: float, hess: DataFrame, cov: DataFrame) -> DataFrame:
    """The composite-likelihood information criterion -(lnL + tr(H C)). hess: a, b, h; cov: a, b, cov."""
    return hess.join(cov, (hess.a == cov.b) & (hess.b == cov.a)).agg((-(F.lit(lnl) + F.sum(F.col("h") * F.col("cov")))).alias("clic"))


def hessians(points: DataFrame, names: list[str]) -> DataFrame:
    """file, lnL, a, b, h: as :func:`hessian` for each file of points. The sums of the normal equations are made by partial
    aggregation; each file's small system is then solved where its row of sums is."""
    first = points.where("ord = 0").select("file", F.col("lnL").alias("_l"), *[F.col(n).alias(f"_0{n}") for n in names])
    d = [F.col(n) - F.col(f"_0{n}") for n in names]
    terms = [F.lit(1.0), *d, *[d[j] * d[k] for j in range(len(d)) for k in range(j, len(d))]]
    n, y = len(terms), F.col("lnL") - F.col("_l")
    sums = [F.sum(terms[i] * terms[j]).alias(f"a{i}_{j}") for i in range(n) for j in range(i, n)] + [F.sum(terms[i] * y).alias(f"b{i}") for i in range(n)]
    told = points.join(first, "file").groupBy("file", "_l").agg(*sums)

    def solve(frames):
        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
                scale = 1 / np.sqrt(np.maximum(np.diag(a), 1e-300))
                beta = np.linalg.lstsq(a * scale[:, None] * scale, np.array([r[f"b{i}"] for i in range(n)]) * scale, rcond=None)[0] * scale
                at = 1 + len(names)
                for j in range(len(names)):
                    for k in range(j, len(names)):
                        h = beta[at] * (2 if j == k else 1)
                        out += [(r["file"], r["_l"], x, z, h) for x, z in {(names[j], names[k]), (names[k], names[j])}]
                        at += 1
            yield pd.DataFrame(out, columns=["file", "lnL", "a", "b", "h"])

    return told.mapInPandas(solve, f"file {dict(points.dtypes)['file']}, lnL double, a string, b string, h double")


def clic_by_file(hessians: DataFrame, cov: DataFrame) -> DataFrame:
    """file, clic of each file of points, with the covariance of the bootstrap estimates. Parameters of a file that are not those
    of the estimates are an error."""
    known = cov.select("a").distinct().agg(F.sort_array(F.collect_list("a")).alias("_known"))
    held = hessians.groupBy("file", "lnL").agg(F.sort_array(F.collect_set("a")).alias("_held"))
    checked = held.join(F.broadcast(known)).select("file", F.when(F.col("_known") == F.col("_held"), F.col("lnL")).otherwise(F.raise_error(F.lit("points and estimates have other parameters")).cast("double")).alias("lnL"))  # one row
    trace = hessians.join(cov.select(F.col("b").alias("a"), F.col("a").alias("b"), "cov"), ["a", "b"]).groupBy("file").agg(F.sum(F.col("h") * F.col("cov")).alias("_t"))
    return checked.join(trace, "file", "left").select("file", (-(F.col("lnL") + F.col("_t"))).alias("clic"))


def data_name(name: Column, kind: str) -> Column:
    """What a row of a table of criteria is told by: the data file itself, or the middle part of a points file ``x-name-y.pts``."""
    if kind != "clic":
        return name
    middle = F.regexp_extract(name, r"^[^-]*-([^-]*)-[^-]*$", 1)
    return F.when(name.rlike(r"^[^-]*-[^-]*-[^-]*$"), middle).otherwise(F.raise_error(F.concat(F.lit("illegal name of a points file: "), name)).cast("string"))


def aligned_criteria(criteria: DataFrame, kind: str) -> DataFrame:
    """row, model, crit of criteria (model, name, crit): rows are told by their data, and every model has to have the same."""
    rows = criteria.select(data_name(F.col("name"), kind).alias("row"), "model", "crit")
    models = criteria.select("model").distinct().agg(F.count(F.lit(1)).alias("_all"))
    per_row = rows.groupBy("row").agg(F.count_distinct("model").alias("_n"), F.count(F.lit(1)).alias("_rows")).join(F.broadcast(models))  # one row
    odd = F.raise_error(F.concat(F.lit("models have no one row each for "), F.col("row"))).cast("double")
    fits = (F.col("_n") == F.col("_all")) & (F.col("_rows") == F.col("_all"))
    return rows.join(per_row, "row").select("row", "model", F.when(fits, F.col("crit")).otherwise(odd).alias("crit"))


def model_weights(criteria: DataFrame) -> DataFrame:
    """model, weight. criteria: row, model, crit. In each row the least criterion wins; ties share it."""
    row = Window.partitionBy("row")
    best = criteria.withColumn("_best", (F.col("crit") == F.min("crit").over(row)).cast("double"))
    shared = best.withColumn("_w", F.col("_best") / F.sum("_best").over(row))
    return shared.groupBy("model").agg(F.avg("_w").alias("weight"))


def model_average(estimates: DataFrame, weights: DataFrame) -> DataFrame:
    """row, name, value: weighted means over the models that have the parameter; null if their weights are 0."""
    both = estimates.join(weights, "model")
    return both.groupBy("row", "name").agg(F.try_divide(F.sum(F.col("weight") * F.col("value")), F.sum("weight")).alias("value"))


def estimate_intervals(flat: DataFrame, confidence: float = 0.95, include_estimate: bool = True) -> DataFrame:
    """name, estimate (row 0), low, high over the rows. flat: row, name, value. The estimate counts as a replicate unless
    told otherwise."""
    tail = (1 - confidence) / 2
    used = F.col("value") if include_estimate else F.when(F.col("row") > 0, F.col("value"))
    told = flat.withColumn("_u", used).groupBy("name").agg(
        F.max(F.when(F.col("row") == 0, F.col("value"))).alias("estimate"), F.expr(f"percentile(_u, array({tail}D, {1 - tail}D))").alias("_p")
    )
    return told.select("name", "estimate", F.get("_p", F.lit(0)).alias("low"), F.get("_p", F.lit(1)).alias("high"))


def principal_components(rows: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Means, standard deviations (n - 1), shares of variance and components (rows) of standardised columns; moments are
    summed on the executors."""
    told = rows.agg(*[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_samp(n).alias(f"s_{n}") for n in names], *[F.corr(a, b).alias(f"{a}|{b}") for a in names for b in names]).first()
    values, vectors = np.linalg.eigh(np.array([[told[f"{a}|{b}"] for b in names] for a in names]))
    order = np.argsort(values)[::-1]
    return np.array([told[f"m_{n}"] for n in names]), np.array([told[f"s_{n}"] for n in names]), values[order] / values.sum(), vectors[:, order].T


def component_shares(rows: DataFrame, names: list[str]) -> DataFrame:
    _, _, shares, _ = principal_components(rows, names)
    return rows.sparkSession.createDataFrame([(k, float(s)) for k, s in enumerate(shares)], "component int, fraction double")
