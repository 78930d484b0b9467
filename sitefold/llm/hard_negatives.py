"""Hard-negative mining by an orthogonal rotation to principal components.

Scores are inner products of integer vectors (``floor(scale * x)``). A rotation keeps inner products and puts most of each
vector's length into its leading components, so the product over the first few of them, give or take the product of the two
residual norms (and some slack for rounding), brackets the score. Anchors and rows meet in pairs of blocks. In each:

* products over the leading components of all pairs come first; a pair goes as soon as the bracket tells that its score is
  too small (or, for negatives, too large) to be in the answer, or else gets the next components added;
* pairs that are left are verified by exact integer products;
* only a block's best few rows for each question leave the task. A window with a limit of ranks, which Spark applies before
  the shuffle as well, merges them.

First an anchor's positives are found (rows of its label, best scores first), then for each positive the best rows of
other labels whose scores lie within ``low`` to 1 times the positive's. The rotation is made of the second moments of all rows; it
decides what is discarded early and never what is returned. Anchors are a stated query set and meet all rows: rows travel once for each
block of anchors, and no block depends on the density or on copies, as rows are dealt by a hash of their number.

Defined results: rows with a null id, label or vector, an empty vector, or null or non-finite components take no part; rows
meet rows with as many components only; scaled components beyond ``+-BOUND`` count as ``+-BOUND``; rows that repeat an id are rows of
their own, and equally good rows of one id are all named; an anchor with fewer rows of its label has fewer positives, one without
has no rows; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import bounded_batches, materialize, read_table

#: Factor of the components, positives of an anchor, negatives of a positive, and least share of the positive's score in hundredths.
SCALE, POSITIVES, NEGATIVES, LOW = 256, 5, 5, 80
BOUND = 1 << 22
#: Rows and anchors of a block; anchors that are compared at once; leading components that are added in turn.
ROWS, ANCHORS, AT_ONCE, CUTS = 4096, 1024, 32, (8, 16, 32)
#: Rotations are made for so many lengths of vectors (the most frequent ones) of up to so many components.
ROTATIONS, WIDEST = 2, 256


def integer_rows(vectors: DataFrame, scale: int, anchor: Column) -> DataFrame:
    """vec_id, label, dim, v (array of integers) and is_anchor of the rows that take part."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    clipped = lambda x: F.greatest(F.least(x * float(scale), F.lit(float(BOUND))), F.lit(-float(BOUND)))
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(clipped(x)).cast("int"))
    good = vectors.where("vec_id is not null and label is not null and size(embedding) > 0").where(~odd)
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.size("embedding").alias("dim"), v.alias("v"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))


def _matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)


def rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """For the most frequent lengths the orthogonal matrix of the principal axes of all their rows, the longest axis first."""
    dims = [r["dim"] for r in rows.where(F.col("dim") <= WIDEST).groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(ROTATIONS).collect()]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {d: np.zeros((d, d)) for d in dims}
        for batch in batches:
            dim = batch.column("dim").to_numpy()
            for d in np.unique(dim):
                some = batch.filter(pa.array(dim == d))
                x = _matrix(some.column("v"), some.num_rows).astype(np.float64)
                sums[int(d)] += x.T @ x
        for d, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(m.tolist(), pa.list_(pa.float64()))], names=["dim", "i", "m"])

    told = rows.where(F.col("dim").isin(dims)).select("dim", "v").mapInArrow(moments, "dim int, i int, m array<double>")
    met = told.select("dim", "i", F.posexplode("m").alias("j", "m")).groupBy("dim", "i", "j").agg(F.sum("m").alias("m")).toArrow()
    out = {}
    for d in dims:  # at most ROTATIONS matrices of WIDEST rows and columns
        some = met.filter(pa.array(met.column("dim").to_numpy() == d))
        m = np.zeros((d, d))
        m[some.column("i").to_numpy(), some.column("j").to_numpy()] = some.column("m").to_numpy()
        out[d] = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy()
    return out


class Side:
    """Integer vectors, their rotated coordinates, and the norm of what follows each cut."""

    def __init__(self, v: np.ndarray, rotation: np.ndarray | None):
        self.v = v
        x = v.astype(np.float64)
        self.x = x if rotation is None else x @ rotation
        rest = np.cumsum((self.x * self.x)[:, ::-1], axis=1)[:, ::-1]
        self.cuts = [c for c in CUTS if c < v.shape[1]]
        self.tail = np.sqrt(np.column_stack([rest[:, c] for c in self.cuts])) if self.cuts else np.zeros((len(v), 0))
        self.norm = np.sqrt(rest[:, 0])
        self.top = int(np.abs(v).max(initial=0))


def exact_products(a: Side, b: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a.v[i], b.v[j])


def left_over(a: Side, b: Side, some: slice, allowed: np.ndarray, least: np.ndarray | None, most: np.ndarray | None, best: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of the allowed pairs of anchors ``some`` with all rows of ``b`` that can have a score of at least ``least``
    and at most ``most``. Without ``least``: that can be among the ``best`` rows of their anchor."""
    start, rows_of = some.start, np.arange(some.start, some.stop)
    slack = 1e-9 * (a.norm[some][:, None] * b.norm[None, :] + 1)
    if not a.cuts:
        i, j = np.nonzero(allowed)
        i += start
        score = exact_products(a, b, i, j)
        keep = np.ones(len(i), bool) if least is None else (score >= least[i - start]) & (score <= most[i - start])
        return i[keep], j[keep], score[keep]
    first = a.cuts[0]
    partial = a.x[some, :first] @ b.x[:, :first].T
    if least is None:
        # the exact score of the row that is best-th by the leading components is one that the answer reaches
        least = np.full(len(rows_of), -np.inf)
        for r in range(len(rows_of)):
            own = np.flatnonzero(allowed[r])
            if len(own) >= best:
                pick = own[np.argpartition(-partial[r, own], best - 1)[:best]]
                least[r] = exact_products(a, b, np.full(best, start + r), pick).min()
    bracket = a.tail[some, 0][:, None] * b.tail[:, 0] + slack
    keep = allowed & (partial + bracket >= least[:, None])
    if most is not None:
        keep &= partial - bracket <= most[:, None]
    i, j = np.nonzero(keep)
    product, slack = partial[i, j], slack[i, j]
    ends = [*a.cuts[1:], a.v.shape[1]]
    for at, (c, end) in enumerate(zip(a.cuts, ends, strict=True), start=1):
        product = product + np.einsum("ij,ij->i", a.x[start + i, c:end], b.x[j, c:end])
        bracket = slack + (a.tail[start + i, at] * b.tail[j, at] if at < len(a.cuts) else 0)
        keep = product + bracket >= least[i]
        if most is not None:
            keep &= product - bracket <= most[i]
        i, j, product, slack = i[keep], j[keep], product[keep], slack[keep]
    score = exact_products(a, b, start + i, j)
    keep = score >= least[i]
    if most is not None:
        keep &= score <= most[i]
    return start + i[keep], j[keep], score[keep]


def best_of(i: np.ndarray, score: np.ndarray, vec_id: np.ndarray, number: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` best of each ``i``: higher scores first, then smaller ids."""
    order = np.lexsort((number, vec_id, -score, i))
    new = np.r_[True, i[order][1:] != i[order][:-1]] if len(order) else np.zeros(0, bool)
    at = np.arange(len(order))
    return order[at - np.maximum.accumulate(np.where(new, at, 0)) < n] if len(order) else order


def _pairs(rows: DataFrame, anchors: DataFrame, turned: dict[int, np.ndarray], n_rows: int, n_anchors: int):
    """Rows and anchors grouped by (dim, i, j), each row with every block of anchors and the other way round."""
    left, right = max(1, -(-n_anchors // ANCHORS)), max(1, -(-n_rows // ROWS))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(n)).cast("int")
    dealt = rows.select("*", block(right, 1).alias("j"), each(left).alias("i"))
    met = anchors.select("*", block(left, 2).alias("i"), each(right).alias("j"))
    return dealt.groupBy("dim", "i", "j").cogroup(met.groupBy("dim", "i", "j"))


def _sides(rows: pa.Table, anchors: pa.Table, sent) -> tuple[Side, Side, np.ndarray, np.ndarray]:
    turn = sent.value.get(rows.column("dim")[0].as_py())
    told = pa.concat_tables([anchors.select(["label"]), rows.select(["label"])]).column("label").combine_chunks().dictionary_encode().indices.to_numpy()
    return Side(_matrix(anchors.column("v"), anchors.num_rows), turn), Side(_matrix(rows.column("v"), rows.num_rows), turn), told[: anchors.num_rows], told[anchors.num_rows :]


def positives(rows: DataFrame, anchors: DataFrame, turned: dict[int, np.ndarray], n_rows: int, n_anchors: int, best: int) -> DataFrame:
    """row (of the anchor), vec_id, positive_id, score: the ``best`` other rows of the anchor's label."""
    sent = rows.sparkSession.sparkContext.broadcast(turned)
    schema = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("other", pa.int64()), ("positive_id", pa.int64()), ("score", pa.int64())])

    def find(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return schema.empty_table()
        a, b, mine, theirs = _sides(rows, anchors, sent)
        row, own, ids, anchor_ids = (t.column(c).to_numpy() for t, c in ((anchors, "row"), (rows, "row"), (rows, "vec_id"), (anchors, "vec_id")))
        parts = []
        for k in range(0, len(row), AT_ONCE):
            some = slice(k, min(k + AT_ONCE, len(row)))
            allowed = (mine[some][:, None] == theirs) & (row[some][:, None] != own)
            i, j, score = left_over(a, b, some, allowed, None, None, best)
            top = best_of(i, score, ids[j], own[j], best)
            parts.append((row[i[top]], anchor_ids[i[top]], own[j[top]], ids[j[top]], score[top]))
        return pa.table([np.concatenate(c) for c in zip(*parts, strict=True)], schema=schema)

    found = _pairs(rows, anchors, turned, n_rows, n_anchors).applyInArrow(find, "row long, vec_id long, other long, positive_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "positive_id", "other")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= best)


def negatives(rows: DataFrame, asked: DataFrame, turned: dict[int, np.ndarray], n_rows: int, n_anchors: int, best: int, low: int) -> DataFrame:
    """row, nth, rank, negative_id, negative_score for each positive (``scores``: an anchor's positive scores by ``nth``)."""
    sent = rows.sparkSession.sparkContext.broadcast(turned)
    schema = pa.schema([("row", pa.int64()), ("nth", pa.int32()), ("other", pa.int64()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])

    def find(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return schema.empty_table()
        a, b, mine, theirs = _sides(rows, anchors, sent)
        row, own, ids = anchors.column("row").to_numpy(), rows.column("row").to_numpy(), rows.column("vec_id").to_numpy()
        scores = anchors.column("scores").to_pylist()
        width = max(map(len, scores))
        wanted = np.array([s + s[-1:] * (width - len(s)) for s in scores], dtype=np.int64)  # scores fall, so repeats of the last change no bound
        count = np.array([len(s) for s in scores])
        parts = []
        for k in range(0, len(row), AT_ONCE):
            some = slice(k, min(k + AT_ONCE, len(row)))
            allowed = mine[some][:, None] != theirs
            least = -(-low * wanted[some].min(axis=1) // 100)
            i, j, score = left_over(a, b, some, allowed, least.astype(np.float64), wanted[some].max(axis=1).astype(np.float64), best)
            for nth in range(width):
                ps = wanted[i, nth]
                fits = (count[i] > nth) & (100 * score >= low * ps) & (score <= ps)
                x, y, z = i[fits], j[fits], score[fits]
                top = best_of(x, z, ids[y], own[y], best)
                parts.append((row[x[top]], np.full(len(top), nth + 1, np.int32), own[y[top]], ids[y[top]], z[top]))
        return pa.table([np.concatenate(c) for c in zip(*parts, strict=True)], schema=schema)

    found = _pairs(rows, asked, turned, n_rows, n_anchors).applyInArrow(find, "row long, nth int, other long, negative_id long, negative_score long")
    order = Window.partitionBy("row", "nth").orderBy(F.desc("negative_score"), "negative_id", "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def mine(vectors: DataFrame, anchor: Column, scale: int = SCALE, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = LOW) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from rows (vec_id, embedding, label); ``anchor``
    tells the rows that are anchors."""
    spark = vectors.sparkSession
    bounded_batches(spark, 4096)
    rows = materialize(integer_rows(vectors, scale, anchor).withColumn("row", F.monotonically_increasing_id()), "integer-rows")
    n_rows, n_anchors = rows.agg(F.count(F.lit(1)), F.count_if("is_anchor")).first()
    turned = rotations(rows)
    anchors, every = rows.where("is_anchor").drop("is_anchor"), rows.drop("is_anchor")
    found = materialize(positives(every, anchors, turned, n_rows, n_anchors, n_positives), "positives")
    scores = found.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "score"))), lambda s: s["score"]).alias("scores"))  # n_positives of an anchor
    asked = materialize(anchors.join(scores, "row"), "asked")
    out = negatives(every, asked, turned, n_rows, n_anchors, n_negatives, low).join(found, ["row", "nth"])
    return out.select(F.col("vec_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", F.col("score").alias("positive_score"), "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


OP12_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, a.label AS mine, v.vec_id, v.label, list_inner_product(a.e, v.e)::BIGINT AS score
  FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, mine, vec_id, score FROM s WHERE label = mine QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INT AS rank,
         s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.mine WHERE {LOW} * p.score <= 100 * s.score AND s.score <= p.score)
SELECT * FROM n WHERE rank <= {NEGATIVES}
"""
