"""Centroid clustering with an annulus search, in integers.

Components are ``floor(scale * x)``, so sums, means (floored) and squared distances are exact and every run, whatever its
partitions, gives the same centroids. A round is one pass over the written integer vectors and one small shuffle:

* Centroids are sorted by their norm. A vector's exact distance to a few of them, evenly spaced in that order, is an upper
  bound ``u`` of the distance to its nearest. By the triangle inequality the nearest has a norm in the annulus
  ``[|x| - u, |x| + u]``, whose ends are found by binary search (both ends, and some rounding slack, count).
* Only candidates of the annulus are compared, by exact integer distances; of equal ones the smaller number wins. Vectors whose
  annuli begin alike are compared together.
* Each task adds up its vectors by centroid; sums of tasks meet by centroid and component, so no cluster, however large, is a key
  of the vectors.

Only the centroids (at most ``MOST`` integers) are on the driver and sent to the tasks. A round depends on the written vectors and
the centroids alone, so a lost executor costs its tasks of one round. Rounds end early where no centroid moves.

Defined results: vectors that are null, of another length or hold null or non-finite components are left out; scaled
components beyond ``+-BOUND`` count as ``+-BOUND``, so that squared distances fit a long; an inertia beyond a long is null;
a null ``vec_id`` is a vector like others, but starts no cluster unless there are too few others; rows that repeat a
``vec_id`` are vectors of their own, and of equal ids the lesser vector starts first; fewer vectors than ``k`` start fewer clusters;
no vectors give no rows; other columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import bounded_batches, materialize, read_table

#: Clusters, rounds, factor of the components, components of a vector, and what is hashed before the id to choose starts.
CLUSTERS, ROUNDS, SCALE, DIM, SEED = 8, 10, 1024, 64, 3
BOUND = 1 << 27
#: Integers of all centroids together; vectors that are compared together.
MOST, TOGETHER = 1 << 22, 512
_LAST = np.iinfo(np.int64).max


def integer_vectors(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """vec_id and ``v`` (array of integers) of the usable vectors."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    clipped = lambda x: F.greatest(F.least(x * float(scale), F.lit(float(BOUND))), F.lit(-float(BOUND)))
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(clipped(x)).cast("int"))
    return vectors.where((F.size("embedding") == dim) & ~odd).select("vec_id", v.alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors of least hash, in its order."""
    told = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r["v"] for r in rows.orderBy(told.asc_nulls_last(), "v").limit(k).select("v").collect()], dtype=np.int64)


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of all rows of ``x`` to all of ``y``, exactly; in doubles where no sum of products can leave 53 bits."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)))
    if top * top * x.shape[1] < 1 << 53:
        products = (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    else:
        products = x @ y.T
    return (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * products


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's nearest centroid (of equal ones the smallest) and its squared distance."""
    number, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    if not len(x):
        return number, distance
    squares = (centroids * centroids).sum(axis=1)
    order = np.argsort(squares, kind="stable")
    c, norm = centroids[order], np.sqrt(squares[order].astype(np.float64))
    probes = np.unique(np.linspace(0, len(c) - 1, int(np.ceil(np.sqrt(len(c))))).round().astype(int))
    upper = np.sqrt(squared_distances(x, c[probes]).min(axis=1).astype(np.float64))
    own = np.sqrt((x * x).sum(axis=1).astype(np.float64))
    slack = 1e-9 * (own + upper + 1)  # far more than the rounding of norms, roots and of their sum
    low, high = np.searchsorted(norm, own - upper - slack, "left"), np.searchsorted(norm, own + upper + slack, "right")
    rows = np.lexsort((high, low))
    for k in range(0, len(rows), TOGETHER):
        some = rows[k : k + TOGETHER]
        a, b = low[some].min(), high[some].max()
        d = squared_distances(x[some], c[a:b])
        place = np.arange(a, b)
        d[(place < low[some][:, None]) | (place >= high[some][:, None])] = _LAST
        distance[some] = d.min(axis=1)
        number[some] = np.where(d == distance[some][:, None], order[a:b], len(c)).min(axis=1)
    return number, distance


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def cluster_sums(rows: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, list[list[int]], list[int]]:
    """Count, sum and inertia of the vectors that are nearest to each centroid: one pass, summed in each task first."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        count, total, inertia = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64), [0] * len(c)
        for batch in batches:
            x = _matrix(batch.column("v"))
            number, distance = nearest(x, c)
            count += np.bincount(number, minlength=len(c))
            np.add.at(total, number, x)
            for j in np.unique(number):
                inertia[j] += sum(distance[number == j].tolist())
        some = np.flatnonzero(count)
        decimals = pa.array([Decimal(inertia[j]) for j in some], pa.decimal128(38, 0))
        sums = pa.array(total[some].tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), decimals, sums], names=["cluster", "n", "inertia", "total"])

    told = rows.mapInArrow(add, "cluster long, n long, inertia decimal(38,0), total array<long>")
    each = told.select("cluster", "n", "inertia", F.posexplode("total").alias("j", "x"))
    met = each.groupBy("cluster", "j").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), F.sum(F.col("x").cast("decimal(20,0)")).alias("x"))
    n, total, inertia = np.zeros(len(centroids), np.int64), [[0] * centroids.shape[1] for _ in centroids], [0] * len(centroids)
    for r in met.collect():  # a row for each number of the centroids
        n[r["cluster"]], inertia[r["cluster"]], total[r["cluster"]][r["j"]] = r["n"], int(r["inertia"]), int(r["x"])
    sent.unpersist()
    return n, total, inertia


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid (array of integers) of each usable vector (vec_id,
    embedding). ``rounds`` times vectors are assigned and centroids become the floored means of theirs (empty ones stay); then
    vectors are assigned once more."""
    if not 0 < k * dim <= MOST:
        raise ValueError(f"centroids of more than {MOST} integers are not kept in memory")
    spark = vectors.sparkSession
    bounded_batches(spark, 8192)
    rows = materialize(integer_vectors(vectors, dim, scale), "integer-vectors")
    centroids = first_centroids(rows, k, seed)
    schema = f"vec_id {dict(vectors.dtypes)['vec_id']}, cluster int, distance long"
    if not len(centroids):
        return spark.createDataFrame([], f"{schema}, cluster_inertia long, inertia long, centroid array<long>")
    for _ in range(rounds):
        n, total, inertia = cluster_sums(rows, centroids)
        moved = np.array([[x // int(m) for x in t] if m else c.tolist() for m, t, c in zip(n, total, centroids, strict=True)], dtype=np.int64)
        if (moved == centroids).all():
            break
        centroids = moved
    else:
        n, total, inertia = cluster_sums(rows, centroids)
    sent = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, distance = nearest(_matrix(batch.column("v")), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    fits = lambda x: x if x <= _LAST else None
    table = [(j, fits(inertia[j]), fits(sum(inertia)), c.tolist()) for j, c in enumerate(centroids)]
    told = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return rows.mapInArrow(assign, schema).join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")  # MOST integers


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster(read_table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256)
    return found.withColumn("centroid_sha256", digest).drop("centroid")


def _sql() -> str:
    """Each vector and centroid as rows of (id, component, value); ten rounds, and the last assignment."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM})""",
        f"x AS MATERIALIZED (SELECT id, unnest(range(1, {DIM + 1})) AS j, unnest(v) AS x FROM kept)",
        f"first AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT v, sha256('{SEED}:' || vec_id) AS h FROM kept ORDER BY h LIMIT {CLUSTERS}))",
        f"c0 AS MATERIALIZED (SELECT c, unnest(range(1, {DIM + 1})) AS j, unnest(v) AS m FROM first)",
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"d{r} AS (SELECT id, c, sum((x - m) * (x - m))::BIGINT AS d FROM x JOIN c{r} USING (j) GROUP BY id, c)")
        parts.append(f"a{r} AS MATERIALIZED (SELECT id, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, c) = 1)")
        if r < ROUNDS:
            parts.append(f"s{r} AS (SELECT c, j, sum(x)::BIGINT AS s, count(*) AS n FROM x JOIN a{r} USING (id) GROUP BY c, j)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c, j, CASE WHEN n IS NULL THEN m ELSE (s - (s % n + n) % n) // n END AS m FROM c{r} LEFT JOIN s{r} USING (c, j))")
    last = f"a{ROUNDS}"
    parts.append(f"digest AS (SELECT c, sha256(string_agg(m::BIGINT::VARCHAR, ',' ORDER BY j)) AS h FROM c{ROUNDS} GROUP BY c)")
    parts.append(f"told AS (SELECT c, sum(d)::BIGINT AS of_cluster FROM {last} GROUP BY c)")
    return f"""WITH {', '.join(parts)}
SELECT vec_id, c::INT AS cluster, d AS distance, of_cluster AS cluster_inertia, (SELECT sum(d)::BIGINT FROM {last}) AS inertia, h AS centroid_sha256
FROM {last} JOIN kept USING (id) JOIN told USING (c) JOIN digest USING (c)"""


OP11_SQL = _sql()
