"""Views of the driver's order tables as population-genetic tables, and the SQL that defines the same views.

Populations are return flags, positions are part keys, and a chromosome is a residue of the part key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POPS = ["A", "N", "R"]
OUTGROUP = "O"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chromosome(key):
    return (key % 22 + 1).cast("string")


def daf_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pop, chr, pos, aa, da, daf."""
    items = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey", "l_tax")
    rows = items.groupBy(F.col("l_returnflag").alias("pop"), F.col("l_partkey").alias("pos")).agg((F.sum((F.col("l_tax") > 0.04).cast("int")) / F.count(F.lit(1))).alias("daf"))
    pos = F.col("pos")
    aa = F.when((F.col("pop") == "N") & (pos % 53 == 0), letter(pos + 2)).otherwise(letter(pos))
    da = F.when((F.col("pop") == "A") & (pos % 11 == 0), F.lit(".")).when((F.col("pop") == "R") & (pos % 47 == 0), letter(pos + 3)).otherwise(letter(pos + 1))
    return rows.select("pop", chromosome(pos).alias("chr"), "pos", aa.alias("aa"), da.alias("da"), "daf")


def letter(n):
    return F.substring(F.lit("acgt"), (n % 4 + 1).cast("int"), F.lit(1))


DAF = """daf_rows AS (
  SELECT l_returnflag AS pop, CAST(l_partkey % 22 + 1 AS VARCHAR) AS chr, l_partkey AS pos,
         CASE WHEN l_returnflag = 'N' AND l_partkey % 53 = 0 THEN substr('acgt', CAST(1 + (l_partkey + 2) % 4 AS INT), 1)
              ELSE substr('acgt', CAST(1 + l_partkey % 4 AS INT), 1) END AS aa,
         CASE WHEN l_returnflag = 'A' AND l_partkey % 11 = 0 THEN '.'
              WHEN l_returnflag = 'R' AND l_partkey % 47 = 0 THEN substr('acgt', CAST(1 + (l_partkey + 3) % 4 AS INT), 1)
              ELSE substr('acgt', CAST(1 + (l_partkey + 1) % 4 AS INT), 1) END AS da,
         CAST(sum(CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS daf
  FROM lineitem GROUP BY l_returnflag, l_partkey)"""

WIDE = """wide AS (
  SELECT chr, pos, max(CASE WHEN pop = 'A' THEN daf END) AS p0, max(CASE WHEN pop = 'N' THEN daf END) AS p1, max(CASE WHEN pop = 'R' THEN daf END) AS p2,
         max(CASE WHEN pop = 'A' THEN aa END) AS a0, max(CASE WHEN pop = 'N' THEN aa END) AS a1, max(CASE WHEN pop = 'R' THEN aa END) AS a2,
         max(CASE WHEN pop = 'A' THEN da END) AS d0, max(CASE WHEN pop = 'N' THEN da END) AS d1, max(CASE WHEN pop = 'R' THEN da END) AS d2
  FROM daf_rows GROUP BY chr, pos HAVING count(DISTINCT pop) = 3),
da AS (SELECT *, CASE WHEN d0 <> '.' THEN d0 WHEN d1 <> '.' THEN d1 ELSE d2 END AS d FROM wide),
sites AS (
  SELECT *, CASE WHEN greatest(p0, p1, p2) = 0 OR least(p0, p1, p2) = 1 THEN 'MONOMORPHIC_SITE'
                 WHEN a1 <> a0 OR a2 <> a0 OR (d0 <> '.' AND d0 <> d) OR (d1 <> '.' AND d1 <> d) OR (d2 <> '.' AND d2 <> d) THEN 'ALLELE_MISMATCH'
                 ELSE 'OK' END AS status FROM da)"""


def raf_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pop, chr, pos, ref, alt, raf: the three populations and the outgroup, whose frequency is 1, 0 or 0.5."""
    ours = daf_rows(spark, sf_dir).select("pop", "chr", "pos", F.col("aa").alias("ref"), F.col("da").alias("alt"), (1 - F.col("daf")).alias("raf"))
    pos = F.col("pos")
    share = pos * 31 % 10
    out = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos")).select(
        F.lit(OUTGROUP).alias("pop"), chromosome(pos).alias("chr"), "pos", letter(pos).alias("ref"), letter(pos + 1).alias("alt"),
        F.when(share < 6, 1.0).when(share < 9, 0.0).otherwise(0.5).alias("raf"),
    )
    return ours.unionByName(out)


RAF = DAF + """,
raf_rows AS (
  SELECT pop, chr, pos, aa AS ref, da AS alt, 1 - daf AS raf FROM daf_rows
  UNION ALL
  SELECT 'O', CAST(p_partkey % 22 + 1 AS VARCHAR), p_partkey, substr('acgt', CAST(1 + p_partkey % 4 AS INT), 1), substr('acgt', CAST(1 + (p_partkey + 1) % 4 AS INT), 1),
         CASE WHEN p_partkey * 31 % 10 < 6 THEN 1.0::DOUBLE WHEN p_partkey * 31 % 10 < 9 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END FROM part),
w4 AS (
  SELECT chr, pos, """ + ", ".join(f"max(CASE WHEN pop = '{p}' THEN {c} END) AS {n}{i}" for i, p in enumerate("ANRO") for c, n in (("ref", "f"), ("alt", "t"), ("raf", "r"))) + """
  FROM raf_rows GROUP BY chr, pos HAVING count(DISTINCT pop) = 4),
w4a AS (SELECT *, coalesce(nullif(t0, '.'), nullif(t1, '.'), nullif(t2, '.'), nullif(t3, '.'), '.') AS t FROM w4),
polar AS (
  SELECT *, CASE WHEN f1 <> f0 THEN 'REF_MISMATCH' WHEN t1 <> '.' AND t1 <> t THEN 'MULTIPLE_ALT' WHEN f2 <> f0 THEN 'REF_MISMATCH'
                 WHEN t2 <> '.' AND t2 <> t THEN 'MULTIPLE_ALT' WHEN f3 <> f0 THEN 'REF_MISMATCH' WHEN t3 <> '.' AND t3 <> t THEN 'MULTIPLE_ALT'
                 WHEN greatest(r0, r1, r2) = 0 OR least(r0, r1, r2) = 1 THEN 'MONOMORPHIC_SITE'
                 WHEN r3 <> 0 AND r3 <> 1 THEN 'NO_ANCESTRAL_ALLELE' ELSE 'OK' END AS status,
         CASE WHEN r3 = 0 THEN r0 WHEN r3 = 1 THEN 1 - r0 END AS y0, CASE WHEN r3 = 0 THEN r1 WHEN r3 = 1 THEN 1 - r1 END AS y1,
         CASE WHEN r3 = 0 THEN r2 WHEN r3 = 1 THEN 1 - r2 END AS y2 FROM w4a)"""


def genotype_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """value: lines of chr, pos, ref, alt, aa and three genotypes, tab-separated, with some that must be rejected."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    k = F.col("k")
    gt = lambda a, b: F.concat(mark(k + a), F.lit("|"), mark(F.col("c") + b))
    ref = F.when(k % 19 == 0, F.lit("ac")).when(k % 23 == 0, F.lit("a,c")).otherwise(letter(k))
    alt = F.when(k % 29 == 0, F.lit("g,t")).when(k % 7 == 0, F.lit(".")).otherwise(letter(k + 1))
    aa = F.when(k % 31 == 0, F.lit("a|c")).when(k % 13 == 0, F.lit(".")).when(k % 37 == 0, letter(k + 2)).when(k % 3 == 0, letter(k + 1)).otherwise(letter(k))
    return rows.select(F.concat_ws("\t", (k % 22 + 1).cast("string"), k.cast("string"), ref, alt, aa, gt(0, 0), gt(1, 1), gt(2, 3)).alias("value"))


def mark(n):
    return F.substring(F.lit("01.10"), (n % 5 + 1).cast("int"), F.lit(1))


_GT = ", ".join(f"substr('01.10', CAST(1 + (k + {a}) % 5 AS INT), 1) || '|' || substr('01.10', CAST(1 + (c + {b}) % 5 AS INT), 1)" for a, b in ((0, 0), (1, 1), (2, 3)))
_L = lambda x: f"substr('acgt', CAST(1 + ({x}) % 4 AS INT), 1)"
GENOTYPES = f"""g AS (
  SELECT k, CAST(k % 22 + 1 AS VARCHAR) AS chr,
         CASE WHEN k % 19 = 0 THEN 'ac' WHEN k % 23 = 0 THEN 'a,c' ELSE {_L("k")} END AS ref,
         CASE WHEN k % 29 = 0 THEN 'g,t' WHEN k % 7 = 0 THEN '.' ELSE {_L("k + 1")} END AS alt,
         CASE WHEN k % 31 = 0 THEN 'a|c' WHEN k % 13 = 0 THEN '.' WHEN k % 37 = 0 THEN {_L("k + 2")} WHEN k % 3 = 0 THEN {_L("k + 1")} ELSE {_L("k")} END AS aa,
         concat({_GT}) AS gt
  FROM (SELECT o_orderkey AS k, o_custkey AS c FROM orders)),
gc AS (SELECT *, length(gt) - length(replace(gt, '0', '')) AS zeros, length(gt) - length(replace(gt, '1', '')) AS ones FROM g)"""


def opf_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tab (0..9), pat (1..6) and value: pattern tables made of order priorities and prices."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy((F.col("o_custkey") % 10).alias("tab"), (F.col("o_orderkey") % 6 + 1).alias("pat")).agg(F.sum("o_totalprice").alias("value"))


OPF = "opf AS (SELECT o_custkey % 10 AS tab, o_orderkey % 6 + 1 AS pat, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2)"


def parameters(n: int) -> list:
    """Columns p1..pn of an estimate: p_j is the sum of the components whose numbers leave j - 1 when divided by n, so that all are used."""
    total = lambda j: reduce(lambda a, b: a + b, [F.get("embedding", F.lit(k)).cast("double") for k in range(j, COMPONENTS, n)])
    return [total(j).alias(f"p{j + 1}") for j in range(n)]


def parameter_sql(j: int, n: int) -> str:
    """The SQL of p_j of n."""
    return f"({' + '.join(f'embedding[{k + 1}]::DOUBLE' for k in range(j - 1, COMPONENTS, n))})"


COMPONENTS = 64


def estimate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, model, name (p1..p4) and value: replicates of estimates."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", *parameters(4))
    each = F.array(*[F.struct(F.lit(f"p{j}").alias("name"), F.col(f"p{j}").alias("value")) for j in range(1, 5)])
    return e.select(F.col("vec_id").alias("row"), F.concat(F.lit("m"), F.col("label").cast("string")).alias("model"), F.inline(each))


EST = "est AS (" + " UNION ALL ".join(f"SELECT vec_id AS row, 'm' || label AS model, 'p{j}' AS name, {parameter_sql(j, 4)} AS value FROM embeddings" for j in range(1, 5)) + ")"


MANY = [f"q{j}" for j in range(32)]


def many_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and a frequency of each of 32 populations, most of them 0 or 1: sums of components j and j + 32, folded into [0, 1]."""
    x = lambda j: F.get("embedding", F.lit(j)).cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", *[F.least(F.lit(1.0), F.greatest(F.lit(0.0), 50 * (x(j) + x(j + 32) + 0.01))).alias(q) for j, q in enumerate(MANY)])


#: Rows (vec_id, pat, z) of the patterns that each vector shows, one population after the other.
MANY_SQL = """folded AS (SELECT vec_id, j, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 50 * (embedding[j + 1]::DOUBLE + embedding[j + 33]::DOUBLE + 0.01::DOUBLE))) AS p FROM embeddings, (SELECT unnest(range(32)) AS j)),
grown(vec_id, j, pat, z) AS (
  SELECT vec_id, 0::BIGINT, 0::BIGINT, 1.0::DOUBLE FROM embeddings
  UNION ALL SELECT vec_id, g.j + 1, g.pat + b * (1::BIGINT << g.j), z * (CASE WHEN b = 1 THEN p ELSE 1 - p END) FROM grown g JOIN folded USING (vec_id, j), (SELECT unnest([0, 1]) AS b) WHERE CASE WHEN b = 1 THEN p ELSE 1 - p END > 0),
shown AS (SELECT vec_id, pat, z FROM grown WHERE j = 32 AND pat > 0 AND pat < (1::BIGINT << 32) - 1)"""
