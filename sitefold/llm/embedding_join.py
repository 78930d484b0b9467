"""Embedding near-dedup as an exact metric range join.

Cosine at least 0.98 is a distance of unit vectors of at most r = sqrt(2 - 2 * 0.98). Pivots, drawn by a hash from the
vectors of each label, partition them: each belongs to the cell of its nearest pivot. By the triangle inequality a vector
v can have a partner in the cell of pivot p only if d(v, p) - d(v, nearest pivot) <= 2 r (in Euclidean space also only if
it is within r of the plane between the two pivots), and it is copied to those cells. So every cell holds all partners of
its own vectors. A cell that is still large is partitioned again by pivots of its own, where its vectors and the copies in
it obey the same inequality, until cells are small or pivots no longer halve the comparisons. Cells are joined
independently: exact dot products in double precision, a count of links for each own vector, and links as a star for each
group of linked vectors rather than as pairs. A cell larger than ``BLOCK`` that pivots do not take apart is dealt out as
pairs of blocks, so no task holds more than two blocks, whatever the density of the data.

Equal vectors are one class from the start: a class of m copies is one vector with m - 1 links of its own. Classes are
numbered when they are written; a repeated vec_id is in as many classes as it has vectors.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and vectors without a label,
link with nothing; vectors of different lengths link with nothing; rows that repeat a vec_id are vectors of their own
(each counts the others), a null vec_id has a null component and is kept; empty tables give empty results; other columns
are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ._components import components, linked_groups
from ._spark import bounded_batches, materialize, read_table

#: Least cosine; vectors a cell should hold; pivots that part a cell; times that cells are parted; vectors of a block.
COSINE, CELL, FAN, LEVELS, BLOCK = 0.98, 1024, 256, 8, 4096
_SLACK = 1e-9


def _class_key() -> list[Column]:
    """What vectors must have in common to link at all (label and length), and the vector in double precision."""
    label = F.when(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull(), F.col("label").cast("string"))
    return [F.concat(label, F.lit("/"), F.size("embedding").cast("string")).alias("group"), F.col("embedding").cast("array<double>").alias("embedding")]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, group (label and length) and embedding of the vectors that can link with anything."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return (
        vectors.where("label is not null and embedding is not null and vec_id is not null").where(~odd & some)
        .select("vec_id", *_class_key())
    )


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(column: pa.Array) -> pa.Array:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    at = np.r_[0, np.cumsum(column.value_lengths().to_numpy())]
    # scaled first, so that squares neither overflow nor vanish
    top = np.maximum.reduceat(np.abs(flat), at[:-1]) if len(column) else np.zeros(0)
    flat = flat / np.repeat(top, np.diff(at))
    norm = np.sqrt(np.add.reduceat(flat * flat, at[:-1])) if len(column) else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat / np.repeat(norm, np.diff(at))))


def near_pivots(x: np.ndarray, own: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``x`` with the cells they go to, and whether a row belongs there: an own vector belongs to the cell of its
    nearest pivot, and all vectors are copied to the other cells that can hold a partner."""
    squared = np.maximum(2 - 2 * (x @ pivots.T), 0)
    near = squared.argmin(axis=1)
    least = squared[np.arange(len(x)), near]
    between = np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 0))[near]
    possible = np.sqrt(squared) - np.sqrt(least)[:, None] <= 2 * radius + _SLACK
    possible &= squared - least[:, None] <= 2 * radius * between + _SLACK
    possible[np.arange(len(x)), near] = True
    row, cell = np.nonzero(possible)
    return row, cell, own[row] & (cell == near[row])


def parted(rows: DataFrame, big: DataFrame, cell: int, fan: int, block: int, radius: float) -> DataFrame:
    """rows (group, cell, cls, n, unit, own) of the cells in big (group, cell, rows, owns) with ``part``, the cell of the
    cell's own pivots. Vectors and pivots meet in pieces of about ``block`` vectors."""
    told = big.select("group", "cell", F.least(F.ceil(F.col("owns") / cell), F.lit(fan)).cast("int").alias("wanted"), "owns", F.ceil(F.col("rows") / block).cast("int").alias("pieces"))
    placed = rows.join(told, ["group", "cell"])
    # drawn by a hash: about twice as many as wanted, of which the first are taken
    chance = (2 * F.col("wanted") + 16) / F.col("owns")
    first = Window.partitionBy("group", "cell").orderBy(F.xxhash64(F.lit(11), "cls"), "cls")
    drawn = placed.where(F.col("own") & (F.pmod(F.xxhash64(F.lit(7), "cls", "cell"), F.lit(1 << 30)) < chance * (1 << 30)))
    drawn = materialize(drawn.withColumn("nth", F.row_number().over(first)).where("nth <= wanted").select("group", "cell", "pieces", "nth", "unit"), "pivots")
    pivots = drawn.select("group", "cell", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "nth", "unit")
    dealt_ = placed.select("group", "cell", F.pmod(F.xxhash64(F.lit(3), "cls"), F.col("pieces")).cast("int").alias("piece"), "cls", "n", "unit", "own")

    def assign(vectors: pa.Table, drawn: pa.Table) -> pa.Table:
        out = vectors.select(["group", "cell", "cls", "n", "unit", "own"])
        if drawn.num_rows < 2 or not out.num_rows:
            return out.append_column("part", pa.array(np.zeros(out.num_rows, np.int32)))
        own = out.column("own").to_numpy(zero_copy_only=False)
        row, part, mine = near_pivots(_matrix(out.column("unit")), own, _matrix(drawn.sort_by("nth").column("unit")), radius)
        out = out.take(pa.array(row)).set_column(5, "own", pa.array(mine))
        return out.append_column("part", pa.array(part.astype(np.int32)))

    keys = ["group", "cell", "piece"]
    schema = "group string, cell string, cls long, n long, unit array<double>, own boolean, part int"
    return dealt_.groupBy(*keys).cogroup(pivots.groupBy(*keys)).applyInArrow(assign, schema)


def cells(classes: DataFrame, cell: int, fan: int, block: int, radius: float) -> DataFrame:
    """classes (cls, group, n, unit) with cell and own: once with own = true, and once for each cell it is copied to."""
    key, done = ["group", "cell"], []
    rows = classes.select("group", F.lit("").alias("cell"), "cls", "n", "unit", F.lit(True).alias("own"))
    for _ in range(LEVELS):
        counts = [F.count(F.lit(1)).alias("rows"), F.count_if("own").alias("owns")]
        big = materialize(rows.groupBy(*key).agg(*counts).where(F.col("rows") > 2 * cell), "large-cells")
        if big.isEmpty():
            break
        parts = materialize(parted(rows, big, cell, fan, block, radius), "cells")
        after = parts.groupBy(*key, "part").agg(*counts).groupBy(*key).agg(F.sum(F.col("rows") * F.col("owns")).alias("after"))
        better = materialize(big.join(after, key).where(F.col("after") * 2 <= F.col("rows") * F.col("owns")).select(*key), "parted-cells")
        done.append(rows.join(better, key, "left_anti"))
        rows = parts.join(better, key).select("group", F.concat_ws("/", "cell", "part").alias("cell"), "cls", "n", "unit", "own")
    for part in done:
        rows = rows.unionByName(part)
    return rows


def dealt(rows: DataFrame, block: int) -> DataFrame:
    """Rows of cells of more than ``block`` vectors once for each pair of blocks they take part in: left and right tell as
    which side."""
    spread = rows.groupBy("group", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    keyed = rows.join(spread, ["group", "cell"]).withColumn("b", F.pmod(F.xxhash64(F.lit(5), "cls"), F.col("blocks")).cast("int"))
    blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    left = F.transform(blocks, lambda j: F.struct(F.col("b").alias("i"), j.alias("j"), F.col("own").alias("left"), (j == F.col("b")).alias("right")))
    right = F.transform(F.filter(blocks, lambda i: i != F.col("b")), lambda i: F.struct(i.alias("i"), F.col("b").alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right")))
    parts = F.filter(F.concat(left, right), lambda p: p["left"] | p["right"])
    return keyed.select("group", "cell", "cls", "n", "unit", F.inline(parts))


def joined_cells(rows: DataFrame, cosine: float) -> DataFrame:
    """(cls, links, root): links of an own vector in its cell; or, with links null, a link to the root of its group."""

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("cls")
        cls, n = table.column("cls").to_numpy(), table.column("n").to_numpy()
        x = _matrix(table.column("unit"))
        left, right = (np.flatnonzero(table.column(c).to_numpy(zero_copy_only=False)) for c in ("left", "right"))
        links = np.zeros(len(left), np.int64)

        def similar() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            y = x[right].T.copy()
            for k in range(0, len(left), 512):
                some = left[k : k + 512]
                near = x[some] @ y >= cosine
                near &= some[:, None] != right[None, :]
                links[k : k + 512] = near @ n[right]
                i, j = np.nonzero(near)
                yield some[i], right[j]

        root = linked_groups(similar(), len(cls))
        tied = np.flatnonzero(root != np.arange(len(cls)))
        return pa.table({
            "cls": np.r_[cls[left], cls[tied]],
            "links": pa.array(np.r_[links, np.zeros(len(tied), np.int64)], mask=np.r_[np.zeros(len(left), bool), np.ones(len(tied), bool)]),
            "root": pa.array(np.r_[cls[left], cls[root[tied]]]),
        })

    return rows.groupBy("group", "cell", "i", "j").applyInArrow(join, "cls long, links long, root long")


def near_dedup(vectors: DataFrame, cosine: float = COSINE, cell: int = CELL, fan: int = FAN, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row for each row of ``vectors`` (vec_id, embedding, label)."""
    bounded_batches(vectors.sparkSession)
    radius = math.sqrt(max(0.0, 2 - 2 * cosine))
    good = usable(vectors)
    classes = good.groupBy("group", "embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = classes.withColumn("unit", arrow_udf(_unit, "array<double>")("embedding")).withColumn("cls", F.monotonically_increasing_id())
    classes = materialize(classes, "classes")
    found = materialize(joined_cells(dealt(cells(classes.select("cls", "group", "n", "unit"), cell, fan, block, radius), block), cosine), "found")
    links = found.where("links is not null").groupBy("cls").agg(F.sum("links").alias("links"))
    groups = components(found.where("links is null").select(F.col("cls").alias("a"), F.col("root").alias("b")))
    told = classes.select("group", "embedding", "cls", "least", "n").join(links, "cls").join(groups, F.col("cls") == F.col("node"), "left")
    told = told.withColumn("component", F.coalesce("component", "cls"))
    # a component is named by its smallest vec_id
    smallest = told.groupBy("component").agg(F.min("least").alias("component_id"))
    told = told.join(smallest, "component").select("group", "embedding", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    # rows are matched by their vector's class, as a vec_id may be repeated
    out = vectors.select("vec_id", *_class_key()).join(told, ["group", "embedding"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read_table(spark, sf_dir, "embeddings"))


OP5_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}::DOUBLE),
r(vec_id, other) AS (SELECT a, b FROM links UNION SELECT r.vec_id, links.b FROM r JOIN links ON r.other = links.a),
least_of AS (SELECT vec_id, min(other) AS c FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, least(e.vec_id, coalesce(c, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(c, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n USING (vec_id) LEFT JOIN least_of USING (vec_id)
"""
