"""Registered queries over the driver's tables, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefold.functions import numeric
from sitefold.functions import patterns as P
from sitefold.operators import bootstrap, model_choice, posterior, rewriting, sites, tables, tabulate
from sitefold.sources import ms, samples, sinks, site_lines, stored, text

from . import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FREQ = ["daf0", "daf1", "daf2"]
MASKS, MASKS1 = P.masks(3), P.masks(3, True)
LABELS = A.POPS


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def r6(c: str | Column, name: str) -> Column:
    return F.round(c, 6).alias(name)


def product(m: int, names: tuple[str, ...] = ("p0", "p1", "p2")) -> str:
    return " * ".join(n if m >> j & 1 else f"(1 - {n})" for j, n in enumerate(names))


def pattern_sql(masks: list[int], source: str, where: str, names: tuple[str, ...] = ("p0", "p1", "p2"), extra: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {extra}{m}::BIGINT AS pat, round(sum({product(m, names)}), 6) AS value FROM {source} WHERE {where}" + (" GROUP BY 1" if extra else "") for m in masks)


def _derived(spark: SparkSession, d: str) -> DataFrame:
    return sites.derived(A.daf_rows(spark, d), A.POPS)


def _good(spark: SparkSession, d: str) -> DataFrame:
    return _derived(spark, d).where("status = 'OK'")


def _polarised(spark: SparkSession, d: str) -> DataFrame:
    return sites.polarised(A.raf_rows(spark, d), A.POPS, A.OUTGROUP)


# Tabulation


@query("daf_patterns", f"WITH {A.DAF}, {A.WIDE} {pattern_sql(MASKS, 'sites', 'status = $$OK$$').replace('$$', chr(39))}")
def _(spark, d):
    return P.pattern_sums(_good(spark, d), FREQ).select("pat", r6("value", "value"))


@query("daf_patterns_singletons", f"WITH {A.DAF}, {A.WIDE} {pattern_sql(MASKS1, 'sites', 'status = $$OK$$').replace('$$', chr(39))}")
def _(spark, d):
    return P.pattern_sums(_good(spark, d), FREQ, singletons=True).select("pat", r6("value", "value"))


@query("daf_patterns_long_form", f"WITH {A.DAF}, {A.WIDE} {pattern_sql(MASKS1, 'sites', 'status = $$OK$$').replace('$$', chr(39))}")
def _(spark, d):
    return P.pattern_sums(_good(spark, d), FREQ, singletons=True, wide=2).select("pat", r6("value", "value"))


@query("daf_patterns_by_chromosome", f"WITH {A.DAF}, {A.WIDE} {pattern_sql(MASKS, 'sites', 'status = $$OK$$', extra='chr, ').replace('$$', chr(39))}")
def _(spark, d):
    return P.pattern_sums(_good(spark, d), FREQ, by=["chr"]).select("chr", "pat", r6("value", "value"))


@query("many_population_patterns", f"WITH RECURSIVE {A.MANY_SQL} SELECT pat, round(sum(z), 6) AS value FROM shown WHERE bit_count(pat) > 1 GROUP BY pat")
def _(spark, d):
    return P.pattern_sums(A.many_frequencies(spark, d), A.MANY).select("pat", r6("value", "value"))


@query("raf_patterns", f"WITH {A.RAF} {pattern_sql(MASKS, 'polar', 'status = $$OK$$', ('y0', 'y1', 'y2')).replace('$$', chr(39))}")
def _(spark, d):
    return P.pattern_sums(_polarised(spark, d).where("status = 'OK'"), FREQ).select("pat", r6("value", "value"))


@query("daf_status_counts", f"WITH {A.DAF}, {A.WIDE} SELECT status, count(*) AS n_sites FROM sites GROUP BY status")
def _(spark, d):
    return sites.status_counts(_derived(spark, d))


@query("site_status_counts", f"WITH {A.RAF} SELECT status, count(*) AS n_sites FROM polar GROUP BY status")
def _(spark, d):
    return sites.status_counts(_polarised(spark, d))


@query("rejected_sites", f"WITH {A.RAF} SELECT chr, pos, status FROM polar WHERE status <> 'OK'")
def _(spark, d):
    return _polarised(spark, d).where("status <> 'OK'").select("chr", "pos", "status")


@query("aligned_daf", f"WITH {A.DAF}, {A.WIDE} SELECT chr, pos, a0 AS aa, d AS da, status, round(p0, 6) AS daf0, round(p1, 6) AS daf1, round(p2, 6) AS daf2 FROM sites")
def _(spark, d):
    return _derived(spark, d).select("chr", "pos", "aa", "da", "status", *[r6(c, c) for c in FREQ])


def _one_pass(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, str]:
    path = stored.stored_path(spark, "rejected")
    return *tabulate.tabulated(_polarised(spark, d), FREQ, path), path


@query("observed_patterns", ORACLE_SQL["raf_patterns"])
def _(spark, d):
    return _one_pass(spark, d)[0].select("pat", r6("value", "value"))


@query("observed_counters", ORACLE_SQL["site_status_counts"])
def _(spark, d):
    return _one_pass(spark, d)[1]


@query("rejected_log", ORACLE_SQL["rejected_sites"])
def _(spark, d):
    path = _one_pass(spark, d)[2]
    return spark.read.schema("chr string, pos long, status string").option("sep", "\t").csv(path).select("chr", "pos", "status")


@query("aligned_by_position", ORACLE_SQL["aligned_daf"])
def _(spark, d):
    """The same from a table in buckets by position."""
    path = stored.stored_path(spark, "frequencies")
    table = stored.write_by_position(A.daf_rows(spark, d), path.rpartition("/")[2].replace("-", "_"), path, 8)
    return sites.derived(table, A.POPS).select("chr", "pos", "aa", "da", "status", *[r6(c, c) for c in FREQ])


@query("raf_mean", f"""WITH {A.RAF} SELECT chr, pos, f0 AS ref, coalesce(nullif(t0, '.'), nullif(t1, '.'), nullif(t2, '.'), '.') AS alt, round((r0 + r1 + r2) / 3, 6) AS raf
FROM (SELECT *, coalesce(nullif(t0, '.'), nullif(t1, '.'), nullif(t2, '.'), '.') AS u FROM w4) WHERE f1 = f0 AND f2 = f0 AND t1 IN ('.', u) AND t2 IN ('.', u)""")
def _(spark, d):
    return sites.join_raf(A.raf_rows(spark, d), A.POPS).select("chr", "pos", "ref", "alt", r6("raf", "raf"))


@query("raf_to_daf_wide", f"WITH {A.RAF} SELECT chr, pos, round(y0, 6) AS daf0, round(y1, 6) AS daf1, round(y2, 6) AS daf2 FROM polar WHERE status = 'OK'")
def _(spark, d):
    return sites.raf_to_daf_wide(A.raf_rows(spark, d), A.POPS, A.OUTGROUP).select("chr", "pos", *[r6(c, c) for c in FREQ])


@query("raf_to_daf_long", f"WITH {A.RAF} " + " UNION ALL ".join(f"SELECT '{p}' AS pop, chr, pos, CASE WHEN r3 = 0 THEN t ELSE f0 END AS aa, CASE WHEN r3 = 0 THEN f0 ELSE t END AS da, round(y{i}, 6) AS daf FROM polar WHERE status = 'OK'" for i, p in enumerate(A.POPS)))
def _(spark, d):
    return sites.raf_to_daf_long(A.raf_rows(spark, d), A.POPS, A.OUTGROUP).select("pop", "chr", "pos", "aa", "da", r6("daf", "daf"))


@query("dup_site_check", "SELECT l_returnflag AS pop, CAST(l_partkey % 22 + 1 AS VARCHAR) AS chr, l_partkey AS pos, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    items = A.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("pop"), A.chromosome(F.col("l_partkey")).alias("chr"), F.col("l_partkey").alias("pos"))
    return sites.duplicate_sites(items)


@query("snp_per_chr", f"WITH {A.RAF} SELECT chr, count(*) AS n_snps FROM polar WHERE status = 'OK' GROUP BY chr")
def _(spark, d):
    return sites.sites_per_chromosome(_polarised(spark, d))


@query("qual_dedup", """SELECT chr, pos, qual, line_no FROM (
  SELECT *, row_number() OVER (PARTITION BY chr, pos ORDER BY qual DESC NULLS LAST, line_no) AS n FROM (
    SELECT CAST(l_partkey % 22 + 1 AS VARCHAR) AS chr, l_partkey AS pos, CASE WHEN l_quantity < 5 THEN NULL ELSE l_quantity END AS qual, l_orderkey * 10 + l_linenumber AS line_no FROM lineitem)) WHERE n = 1""")
def _(spark, d):
    x = A.table(spark, d, "lineitem")
    rows = x.select(A.chromosome(F.col("l_partkey")).alias("chr"), F.col("l_partkey").alias("pos"), F.when(F.col("l_quantity") >= 5, F.col("l_quantity")).alias("qual"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"))
    return sites.best_quality(rows)


# Sources


RAF_REJECT = """CASE WHEN ref LIKE '%,%' THEN 'multref' WHEN alt LIKE '%,%' THEN 'multalt' WHEN length(ref) <> 1 THEN 'indelref' WHEN length(alt) <> 1 THEN 'indelalt'
  WHEN ref = '.' THEN 'missref' WHEN zeros + ones = 0 THEN 'zerogtype' END"""
DAF_REJECT = """CASE WHEN ref LIKE '%,%' THEN 'multref' WHEN alt LIKE '%,%' THEN 'multalt' WHEN aa LIKE '%|%' THEN 'multaa' WHEN length(ref) <> 1 THEN 'indelref'
  WHEN length(alt) <> 1 THEN 'indelalt' WHEN length(aa) <> 1 THEN 'indelaa' WHEN ref = '.' THEN 'missref' WHEN aa = '.' THEN 'missaa'
  WHEN aa <> ref AND aa <> alt AND NOT (alt = '.') THEN 'threealleles' WHEN zeros + ones = 0 THEN 'zerogtype' END"""
NO_AA = "regexp_replace(value, '^([^\\t]*\\t[^\\t]*\\t[^\\t]*\\t[^\\t]*)\\t[^\\t]*', '$1')"


def _raf_lines(spark: SparkSession, d: str) -> DataFrame:
    return A.genotype_lines(spark, d).withColumn("value", F.regexp_replace("value", "^([^\t]*\t[^\t]*\t[^\t]*\t[^\t]*)\t[^\t]*", "$1"))


@query("raf_from_genotypes", f"WITH {A.GENOTYPES} SELECT chr, k AS pos, ref, alt, round(CAST(zeros AS DOUBLE) / (zeros + ones), 6) AS raf FROM gc WHERE ({RAF_REJECT}) IS NULL")
def _(spark, d):
    return text.genotype_raf(_raf_lines(spark, d)).where("reject is null").select("chr", "pos", "ref", "alt", r6("raf", "raf"))


@query("daf_from_genotypes", f"""WITH {A.GENOTYPES} SELECT chr, k AS pos, aa, CASE WHEN aa = ref THEN (CASE WHEN alt = '.' AND aa <> ref THEN aa ELSE alt END) ELSE ref END AS da,
  round(CAST(CASE WHEN aa = ref THEN ones ELSE zeros END AS DOUBLE) / (zeros + ones), 6) AS daf FROM gc WHERE ({DAF_REJECT}) IS NULL""")
def _(spark, d):
    return text.genotype_daf(A.genotype_lines(spark, d)).where("reject is null").select("chr", "pos", "aa", "da", r6("daf", "daf"))


@query("reject_counters", f"WITH {A.GENOTYPES} SELECT coalesce({DAF_REJECT}, 'good') AS reason, count(*) AS n_rows FROM gc GROUP BY 1")
def _(spark, d):
    return text.reject_counts(text.genotype_daf(A.genotype_lines(spark, d)))


@query("raf_scan", f"WITH {A.DAF} SELECT chr, pos, aa AS ref, da AS alt, round(daf, 6) AS raf, 'OK' AS status FROM daf_rows WHERE pos % 5 <> 0 UNION ALL SELECT chr, pos, aa, da, NULL, 'EINVAL' FROM daf_rows WHERE pos % 5 = 0")
def _(spark, d):
    rows = A.daf_rows(spark, d)
    value = F.concat_ws("\t", "chr", F.col("pos").cast("string"), F.upper("aa"), "da", F.when(F.col("pos") % 5 == 0, F.lit("x")).otherwise(F.col("daf").cast("string")))
    lines = rows.select(value.alias("value")).union(rows.limit(1).select(F.lit("# chr pos ref alt raf")))
    return text.read_raf(lines).select("chr", "pos", "ref", "alt", r6("raf", "raf"), "status")


@query("daf_scan", f"WITH {A.DAF} SELECT chr, pos, aa, da, round(daf, 6) AS daf FROM daf_rows")
def _(spark, d):
    rows = A.daf_rows(spark, d)
    lines = rows.select(F.concat_ws("  ", "chr", F.col("pos").cast("string"), "aa", "da", F.col("daf").cast("string")).alias("value"))
    return text.read_daf(lines).select("chr", "pos", "aa", "da", r6("daf", "daf"))


def _site_files(spark: SparkSession, d: str) -> DataFrame:
    """Derived-allele rows as files in order of (chr, pos), by the data source of site lines."""
    path = stored.stored_path(spark, "sites")
    rows = A.daf_rows(spark, d).repartitionByRange(4, "chr", "pos").sortWithinPartitions("chr", "pos")
    rows.select(F.concat_ws("\t", "chr", F.col("pos").cast("string"), "aa", "da", F.col("daf").cast("string")).alias("value")).write.text(path)
    site_lines.register(spark)
    return spark.read.format("site_lines").option("sorted", "true").load(path)


@query("site_lines_daf", ORACLE_SQL["daf_scan"])
def _(spark, d):
    return text.read_daf(_site_files(spark, d).drop("chr")).select("chr", "pos", "aa", "da", r6("daf", "daf"))


@query("site_lines_chromosomes", ORACLE_SQL["daf_scan"] + " WHERE chr IN ('7', '21')")
def _(spark, d):
    """Two chromosomes: other splits are not read."""
    lines = _site_files(spark, d).where(F.col("chr").isin("7", "21"))
    return text.read_daf(lines.drop("chr")).select("chr", "pos", "aa", "da", r6("daf", "daf"))


@query("sort_check", """WITH r AS (SELECT o_orderstatus AS file, o_orderkey AS line_no, CAST(o_custkey % 3 AS VARCHAR) AS chr, o_custkey AS pos FROM orders),
l AS (SELECT *, lag(chr) OVER (PARTITION BY file ORDER BY line_no) AS c, lag(pos) OVER (PARTITION BY file ORDER BY line_no) AS p FROM r)
SELECT file, line_no, chr, pos FROM l WHERE chr < c OR (chr = c AND pos <= p)""")
def _(spark, d):
    o = A.table(spark, d, "orders")
    return text.out_of_order(o.select(F.col("o_orderstatus").alias("file"), F.col("o_orderkey").alias("line_no"), (F.col("o_custkey") % 3).cast("string").alias("chr"), F.col("o_custkey").alias("pos")))


AXT = """rec AS (SELECT c_custkey AS rec, 'chr' || (c_custkey % 5) AS chr, c_custkey * 7 AS s, 'acg-tn' || 'gat-' AS a, substr('acgtacgtnacgt-acgtacgtaccgt', CAST(1 + c_custkey % 13 AS INT), 10) AS b FROM customer),
base AS (SELECT rec, chr, s, s + 7 AS e, s + row_number() OVER (PARTITION BY rec ORDER BY j) - 1 AS pos, substr(a, j, 1) AS ref, substr(b, j, 1) AS o
         FROM rec, (SELECT unnest(range(1, 11))::INT AS j) WHERE substr(a, j, 1) <> '-'),
bases AS (SELECT rec, chr, s, e, pos, ref, CASE WHEN ref = o THEN '.' ELSE o END AS alt, CASE WHEN ref = o THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS raf FROM base WHERE ref <> 'n')"""


def _axt(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    b = F.substring(F.lit("acgtacgtnacgt-acgtacgtaccgt"), (k % 13 + 1).cast("int"), F.lit(10))
    rows = A.table(spark, d, "customer").select(k.alias("rec"), F.concat(F.lit("chr"), (k % 5).cast("string")).alias("chr"), (k * 7).alias("start"), (k * 7 + 7).alias("end"), F.lit(9).alias("score"), F.lit("acg-tngat-").alias("a"), b.alias("b"))
    return text.axt_bases(rows)


@query("axt_bases", f"WITH {AXT} SELECT rec, chr, pos, ref, alt, raf FROM bases WHERE alt NOT IN ('-', 'n')")
def _(spark, d):
    return _axt(spark, d).select("rec", "chr", "pos", "ref", "alt", "raf")


@query("axt_merged", f"""WITH {AXT}, ok AS (SELECT * FROM bases WHERE alt NOT IN ('-', 'n')), spans AS (SELECT DISTINCT rec, chr, s, e FROM ok),
o AS (SELECT rec FROM (SELECT rec, e, max(e) OVER (PARTITION BY chr ORDER BY s, rec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM spans) WHERE r IS NULL OR e > r)
SELECT chr, pos, arg_max(ref, s) AS ref, arg_max(alt, s) AS alt, arg_max(raf, s) AS raf FROM ok JOIN o USING (rec) GROUP BY chr, pos""")
def _(spark, d):
    return text.axt_merged(_axt(spark, d))


@query("sim_daf", " UNION ALL ".join(f"SELECT l_orderkey AS chr, l_linenumber AS pos, '{p}' AS pop, {e} AS daf FROM lineitem" for p, e in (
    ("x", "(CAST(l_partkey AS BIGINT) % 2)::DOUBLE"), ("y", "(l_partkey // 2 % 2 + l_suppkey % 2)::DOUBLE / 2"), ("z", "(l_suppkey // 2 % 2)::DOUBLE"))))
def _(spark, d):
    g = F.expr("array(cast(l_partkey % 2 as int), cast(l_partkey div 2 % 2 as int), cast(l_suppkey % 2 as int), cast(l_suppkey div 2 % 2 as int))")
    rows = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chr"), F.col("l_linenumber").alias("pos"), g.alias("g"))
    return text.sim_frequencies(rows, {"x": 1, "y": 2, "z": 1})


@query("scrm_daf", """WITH s AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n, o_custkey AS c FROM orders WHERE o_orderkey % 8 <> 0),
b AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rep FROM orders WHERE o_orderkey % 8 = 0),
j AS (SELECT s.o_orderkey, s.c, max(b.rep) AS rep FROM s JOIN b ON b.o_orderkey < s.o_orderkey GROUP BY 1, 2),
i AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY o_orderkey) - 1 AS idx FROM j)
SELECT rep, idx, 'x' AS pop, (c % 2)::DOUBLE AS daf FROM i UNION ALL SELECT rep, idx, 'y', ((c // 2) % 2 + (c // 4) % 2)::DOUBLE / 2 FROM i""")
def _(spark, d):
    c = F.col("o_custkey")
    row = F.concat_ws(" ", F.lit("0.5"), F.lit("1.25"), (c % 2).cast("string"), F.expr("cast(o_custkey div 2 % 2 as string)"), F.expr("cast(o_custkey div 4 % 2 as string)"))
    lines = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("line_no"), F.when(F.col("o_orderkey") % 8 == 0, F.lit("position time 1 2 3")).otherwise(row).alias("value"))
    return text.sim_frequencies(text.scrm_sites(lines), {"x": 1, "y": 2})


@query("ms_transpose", """WITH s AS (SELECT s_nationkey AS rep, s_suppkey AS sample, substr('0110100110010110', CAST(1 + s_suppkey % 9 AS INT), 6) AS v FROM supplier)
SELECT rep, (j - 1)::INT AS site, string_agg(substr(v, j, 1), '' ORDER BY sample) AS alleles FROM s, (SELECT unnest(range(1, 7))::INT AS j) GROUP BY rep, j""")
def _(spark, d):
    v = F.substring(F.lit("0110100110010110"), (F.col("s_suppkey") % 9 + 1).cast("int"), F.lit(6))
    return text.ms_transposed(A.table(spark, d, "supplier").select(F.col("s_nationkey").alias("rep"), F.col("s_suppkey").alias("sample"), v.alias("value")))


def _ms_lines(spark: SparkSession, d: str) -> DataFrame:
    """Two files (one of each line status) of ms output, written and read again: an order's items of that status are the sites of a
    replicate of four haplotypes."""
    x = A.table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("file"), "l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("s"))
    hap = lambda h: F.array_join(F.transform("s", lambda r: F.pmod(F.shiftright(r["l_partkey"], h), F.lit(2)).cast("string")), "")
    block = [F.lit("//"), F.concat(F.lit("segsites: "), F.size("s").cast("string")), F.concat(F.lit("positions: "), F.array_join(F.transform("s", lambda r: F.format_string("%.4f", r["l_linenumber"] / 10)), " ")), *[hap(h) for h in range(4)], F.lit("")]
    lines = x.select("file", "l_orderkey", F.posexplode(F.array(*block)).alias("k", "value")).select("file", (F.col("l_orderkey") * 10 + F.col("k")).alias("line_no"), "value")
    heads = lines.select("file").distinct().select("file", F.posexplode(F.array(F.lit("ms 4 9 -t 5 -I 2 2 1 -eA 0.5 1 1 -n 1 2"), F.lit("1 2 3"))).alias("line_no", "value"))
    return stored.kept(lines.unionByName(heads.withColumn("line_no", F.col("line_no").cast("long"))), "ms-lines")


MS = """m AS (SELECT l_linestatus AS file, l_orderkey, l_linenumber, l_partkey % 2 AS h0, (l_partkey >> 1) % 2 AS h1, (l_partkey >> 2) % 2 AS h2, (l_partkey >> 3) % 2 AS h3,
  dense_rank() OVER (PARTITION BY l_linestatus ORDER BY l_orderkey) - 1 AS rep, row_number() OVER (PARTITION BY l_linestatus, l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS site FROM lineitem)"""


@query("ms_sim_lines", f"WITH {MS} SELECT file, (rep + 1) * 4294967296 + site AS line_no, concat_ws(' ', rep, h2, h3, h0, h1) AS value FROM m UNION ALL SELECT DISTINCT file, u.k, u.v FROM m, (VALUES (0, 'npops = 3'), (1, 'pop sampsize'), (2, 'y 1'), (3, 'z 1'), (4, 'x 2')) u(k, v)")
def _(spark, d):
    return ms.sim_lines(_ms_lines(spark, d), ["x:1", "y:2", "z:0"]).select("file", "line_no", "value")


@query("ms_sim_patterns", f"WITH {MS}, f AS (SELECT file, h2::DOUBLE AS p0, h3::DOUBLE AS p1, (h0 + h1) / 2.0::DOUBLE AS p2 FROM m) {pattern_sql(MASKS1, 'f', 'true', extra='file, ')}")
def _(spark, d):
    lines = stored.kept(ms.sim_lines(_ms_lines(spark, d), ["x:1", "y:2", "z:0"]), "sim-lines")
    sizes = samples.sim_samples(lines)
    rows = samples.frequency_columns(samples.sim_sites(lines, sizes), sizes)
    return P.pattern_sums(rows, list(sizes), singletons=True, by=["file"]).select("file", "pat", r6("value", "value"))


def _label(spark: SparkSession, d: str) -> DataFrame:
    return tables.labelled(A.opf_rows(spark, d), LABELS)


LABEL_SQL = "CASE pat WHEN 1 THEN 'A' WHEN 2 THEN 'N' WHEN 3 THEN 'A:N' WHEN 4 THEN 'R' WHEN 5 THEN 'A:R' ELSE 'N:R' END"


@query("opf_parse", f"WITH {A.OPF} SELECT pat::BIGINT AS pat, round(sum(round(value, 2)), 4) AS value FROM opf GROUP BY pat")
def _(spark, d):
    lines = _label(spark, d).select(F.concat(F.lit("  "), "label", F.lit("  "), F.format_string("%.2f", "value"), F.lit("  # note")).alias("value"))
    return tables.by_mask(text.pattern_rows(lines), LABELS).select("pat", F.round("value", 4).alias("value"))


@query("pattern_table_parse", f"WITH {A.OPF} SELECT tab AS file, {LABEL_SQL} AS label, round(value, 2) AS value FROM opf")
def _(spark, d):
    rows = _label(spark, d).select(F.col("tab").alias("file"), (F.col("pat") + 10).alias("line_no"), F.concat_ws(" ", "label", F.format_string("%.2f", "value")).alias("value"))
    heads = rows.select("file").distinct().select("file", F.explode(F.array(F.struct(F.lit(1).cast("long").alias("line_no"), F.lit("Fitted parameter values").alias("value")), F.struct(F.lit(2).cast("long").alias("line_no"), F.lit("Txy = 3").alias("value")), F.struct(F.lit(3).cast("long").alias("line_no"), F.lit("#   SitePat BranchLen").alias("value")))).alias("l")).select("file", "l.line_no", "l.value")
    return text.pattern_section(rows.unionByName(heads)).select("file", "label", "value")


def _fit_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "supplier").select(F.col("s_nationkey").alias("file"), F.col("s_suppkey").alias("k"), F.round("s_acctbal", 2).alias("v"))
    p = F.concat(F.lit("p"), F.col("k").cast("string"))
    first = rows.select("file", F.col("k").alias("line_no"), F.concat(p, F.lit(" = 1")).alias("value"))
    second = rows.select("file", (F.col("k") + F.when(F.col("k") % 2 == 0, 10_000_000).otherwise(30_000_000)).alias("line_no"), F.concat(p, F.lit(" = "), F.format_string("%.2f", "v")))
    marks = rows.select("file").distinct().select("file", F.explode(F.expr("array(struct(9000000L as line_no, 'Fitted parameter values' as value), struct(20000000L as line_no, 'Constrained parameters' as value), struct(90000000L as line_no, '# SitePat BranchLen' as value))")).alias("m")).select("file", "m.line_no", "m.value")
    return first.union(second).union(marks)


@query("fit_parse", "SELECT s_nationkey AS file, 'p' || s_suppkey AS name, round(s_acctbal, 2) AS value, s_suppkey % 2 = 0 AS is_free FROM supplier")
def _(spark, d):
    return text.fitted_parameters(_fit_lines(spark, d)).select("file", "name", "value", "is_free")


@query("flatfile_parse", "SELECT s_nationkey AS file, 'p' || s_suppkey AS name, round(s_acctbal, 2) AS value FROM supplier")
def _(spark, d):
    return text.second_sightings(_fit_lines(spark, d))


@query("state_merge", "SELECT file, pt, cost FROM (SELECT *, row_number() OVER (ORDER BY n, file) AS t FROM (SELECT s_nationkey AS file, s_suppkey AS pt, s_acctbal AS cost, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS n FROM supplier)) WHERE t <= 60")
def _(spark, d):
    return text.merged_states(A.table(spark, d, "supplier").select(F.col("s_nationkey").alias("file"), F.col("s_suppkey").alias("pt"), F.col("s_acctbal").alias("cost")), 60)


# Patterns and pattern tables


BITS = "list_filter(range(0, 32), lambda j: (pat >> j) & 1 = 1)"


def _shown(spark: SparkSession, d: str) -> DataFrame:
    """Every pattern of many populations that some site shows."""
    return P.pattern_sums(A.many_frequencies(spark, d), A.MANY, singletons=True).select("pat")


@query("pattern_domain", f"WITH RECURSIVE {A.MANY_SQL}, d AS (SELECT DISTINCT pat FROM shown) SELECT pat, array_to_string(list_transform({BITS}, lambda j: 'q' || j), ':') AS label FROM d")
def _(spark, d):
    return _shown(spark, d).select("pat", P.pattern_label(F.col("pat"), A.MANY).alias("label"))


@query("pattern_order", f"WITH RECURSIVE {A.MANY_SQL}, d AS (SELECT DISTINCT pat FROM shown) SELECT pat, (bit_count(pat)::BIGINT << 32) + 4294967295 - list_sum(list_transform({BITS}, lambda j: 1::BIGINT << (31 - j)))::BIGINT AS rank FROM d")
def _(spark, d):
    """What sorts patterns by the number of populations, then by their labels."""
    return _shown(spark, d).select("pat", P.pattern_rank(F.col("pat"), len(A.MANY)).alias("rank"))


@query("label_masks", f"WITH {A.OPF} SELECT tab, {LABEL_SQL} AS label, pat FROM opf")
def _(spark, d):
    return _label(spark, d).select("tab", "label", P.label_mask(F.col("label"), LABELS).alias("pat"))


@query("normalize", f"WITH {A.OPF} SELECT tab, pat, round(value / sum(value) OVER (PARTITION BY tab), 9) AS value FROM opf")
def _(spark, d):
    return tables.normalised(A.opf_rows(spark, d), ["tab"]).select("tab", "pat", F.round("value", 9).alias("value"))


def _pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All tables: the first five as observed, each with one of the others as fitted."""
    rows = A.opf_rows(spark, d).withColumn("file", F.col("tab") % 5)
    return rows.where("tab < 5").select("file", "pat", "value"), rows.where("tab >= 5").select("file", "pat", "value")


@query("table_minus", f"WITH {A.OPF} SELECT tab % 5 AS file, pat, round(sum(CASE WHEN tab < 5 THEN value ELSE -value END), 4) AS value FROM opf GROUP BY 1, 2")
def _(spark, d):
    return tables.combined(*_pairs(spark, d), -1, ["file"]).select("file", "pat", F.round("value", 4).alias("value"))


@query("table_plus", f"WITH {A.OPF} SELECT tab % 5 AS file, pat, round(sum(value), 4) AS value FROM opf GROUP BY 1, 2")
def _(spark, d):
    return tables.combined(*_pairs(spark, d), by=["file"]).select("file", "pat", F.round("value", 4).alias("value"))


@query("rm_pops", f"WITH {A.OPF} SELECT tab, pat // 2 AS pat, round(sum(value), 4) AS value FROM opf WHERE pat // 2 > 0 GROUP BY 1, 2")
def _(spark, d):
    return tables.without_populations(A.opf_rows(spark, d), 3, {0}, ["tab"]).select("tab", "pat", F.round("value", 4).alias("value"))


@query("collapse_pops", f"WITH {A.OPF} SELECT tab, (CASE WHEN pat & 3 > 0 THEN 1 ELSE 0 END + CASE WHEN pat & 4 > 0 THEN 2 ELSE 0 END)::BIGINT AS pat, round(sum(value), 4) AS value FROM opf GROUP BY 1, 2")
def _(spark, d):
    return tables.with_collapsed(A.opf_rows(spark, d), 3, {0, 1}, ["tab"]).select("tab", "pat", F.round("value", 4).alias("value"))


TWO = f"WITH {A.OPF}, t AS (SELECT tab % 5 AS file, pat, sum(CASE WHEN tab < 5 THEN value END) AS a, sum(CASE WHEN tab >= 5 THEN value END) AS b FROM opf GROUP BY 1, 2), n AS (SELECT file, pat, a, a / sum(a) OVER (PARTITION BY file) AS p, b / sum(b) OVER (PARTITION BY file) AS q FROM t)"


@query("resid", f"{TWO} SELECT file, pat, round(p, 9) AS observed, round(q, 9) AS fitted, round(p - q, 9) AS residual FROM n")
def _(spark, d):
    return tables.residuals(*_pairs(spark, d), ["file"]).select("file", "pat", *[F.round(c, 9).alias(c) for c in ("observed", "fitted", "residual")])


@query("resid_matrix", f"""WITH {A.OPF}, s AS (SELECT tab % 5 AS file, tab < 5 AS obs, (pat & 1) | (CASE WHEN pat & 6 > 0 THEN 2 ELSE 0 END) AS pat, sum(value) AS v FROM opf GROUP BY 1, 2, 3),
n AS (SELECT file, obs, pat, v / sum(v) OVER (PARTITION BY file, obs) AS v FROM s)
SELECT file, pat::BIGINT AS pat, round(sum(CASE WHEN obs THEN v ELSE -v END), 9) AS value FROM n GROUP BY 1, 2""")
def _(spark, d):
    return tables.residual_matrix(*_pairs(spark, d), 3, collapsed=[{1, 2}]).select("file", "pat", F.round("value", 9).alias("value"))


@query("share_matrix", f"WITH {A.OPF}, s AS (SELECT tab AS file, pat // 2 AS pat, sum(value) AS v FROM opf WHERE pat // 2 > 0 GROUP BY 1, 2) SELECT file, pat, round(v / sum(v) OVER (PARTITION BY file), 9) AS value FROM s")
def _(spark, d):
    rows = A.opf_rows(spark, d).withColumnRenamed("tab", "file")
    return tables.residual_matrix(rows, None, 3, removed={0}).select("file", "pat", F.round("value", 9).alias("value"))


@query("diverg_kl", f"{TWO} SELECT file, pat, round(p, 9) AS p, round(q, 9) AS q, round(p * ln(p / q), 9) AS kl, abs(p * ln(p / q)) >= 0.01 AS flag FROM n")
def _(spark, d):
    return tables.divergence(*_pairs(spark, d), by=["file"]).select("file", "pat", *[F.round(c, 9).alias(c) for c in ("p", "q", "kl")], "flag")


@query("fit_kl", f"{TWO} SELECT file, round(sum(p * ln(p / q)), 9) AS kl FROM n GROUP BY file")
def _(spark, d):
    return tables.kl_cost(*_pairs(spark, d), ["file"]).select("file", F.round("kl", 9).alias("kl"))


@query("neg_lnl", f"{TWO} SELECT file, round(-sum(a * ln(q)) / 1e6, 6) AS neg_lnl FROM n GROUP BY file")
def _(spark, d):
    return tables.negative_log_likelihood(*_pairs(spark, d), ["file"]).select("file", F.round(F.col("neg_lnl") / 1e6, 6).alias("neg_lnl"))


@query("entropy", f"WITH {A.OPF} SELECT tab, round(-sum(p * ln(p)), 9) AS entropy FROM (SELECT tab, value / sum(value) OVER (PARTITION BY tab) AS p FROM opf) GROUP BY tab")
def _(spark, d):
    return tables.entropy(A.opf_rows(spark, d), ["tab"]).select("tab", F.round("entropy", 9).alias("entropy"))


@query("has_singletons", f"WITH {A.OPF} SELECT bool_or(bit_count(pat) = 1 AND value <> 0) AS has_singletons FROM opf")
def _(spark, d):
    return tables.has_singletons(A.opf_rows(spark, d))


@query("flatpat", f"WITH {A.OPF} SELECT {LABEL_SQL} AS label, " + ", ".join(f"round(max(CASE WHEN tab = {k} THEN value END), 4) AS t{k}" for k in range(10)) + " FROM opf GROUP BY 1")
def _(spark, d):
    rows = _label(spark, d).withColumn("table", F.concat(F.lit("t"), F.col("tab").cast("string")))
    return tables.table_matrix(rows, [f"t{k}" for k in range(10)]).select("label", *[F.round(f"t{k}", 4).alias(f"t{k}") for k in range(10)])


@query("flatfile", f"WITH {A.EST} SELECT row AS file, " + ", ".join(f"round(max(CASE WHEN name = 'p{j}' THEN value END), 6) AS p{j}" for j in range(1, 5)) + " FROM est GROUP BY row")
def _(spark, d):
    rows = A.estimate_rows(spark, d).withColumnRenamed("row", "file")
    return tables.parameter_matrix(rows, ["p1", "p2", "p3", "p4"]).select("file", *[r6(f"p{j}", f"p{j}") for j in range(1, 5)])


@query("flatfile_t", f"WITH {A.EST} SELECT name, model, " + ", ".join(f"round(avg(CASE WHEN row % 4 = {k} THEN value END), 6) AS f{k}" for k in range(4)) + " FROM est GROUP BY name, model")
def _(spark, d):
    """One row a parameter and model, one column a quarter of the replicates."""
    rows = A.estimate_rows(spark, d).groupBy("name", "model", (F.col("row") % 4).alias("k")).agg(F.avg("value").alias("value"))
    rows = rows.select(F.struct("name", "model").alias("of"), F.concat(F.lit("f"), F.col("k").cast("string")).alias("table"), "value")
    return tables.table_matrix(rows, [f"f{k}" for k in range(4)], "of").select("of.name", "of.model", *[r6(f"f{k}", f"f{k}") for k in range(4)])


@query("label_index", """WITH n AS (SELECT o_orderkey AS ord, unnest(['c' || o_custkey % 1000, 's' || o_orderstatus]) AS name, unnest([0, 1]) AS place FROM orders),
f AS (SELECT name, min(ord * 2 + place) AS first_at FROM n GROUP BY name) SELECT name, row_number() OVER (ORDER BY first_at) - 1 AS bit FROM f""")
def _(spark, d):
    label = F.concat(F.lit("c"), (F.col("o_custkey") % 1000).cast("string"), F.lit(":s"), "o_orderstatus")
    return tables.label_index(A.table(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), label.alias("label")))


# Bootstrap

LENGTH, REPS = 100, 5
BOOT = f"""WITH {A.DAF}, {A.WIDE}, ix AS (SELECT chr, pos, p0, p1, p2, row_number() OVER (ORDER BY chr, pos) - 1 AS idx FROM sites WHERE status = 'OK'),
tot AS (SELECT count(*) AS n, (2 * count(*) + {LENGTH}) // {2 * LENGTH} AS nb FROM ix),
st AS (SELECT r AS rep, b AS block, ((r + 1) * 7919 + (b + 1) * (b + 1) * 104729 + (r + 1) * (b + 3) * 15485863) % (n - {LENGTH} + 1) AS start
       FROM tot, (SELECT unnest(range({REPS})) AS r), LATERAL (SELECT unnest(range(nb)) AS b))"""


def _indexed(spark: SparkSession, d: str) -> DataFrame:
    """Sites with their numbers, derived and numbered once for all that reads them."""
    return stored.kept(bootstrap.numbered(stored.kept(_good(spark, d), "good-sites")), "numbered-sites")


def _starts(spark: SparkSession, sites_: DataFrame) -> DataFrame:
    return bootstrap.block_starts(spark, sites_.count(), LENGTH, REPS)


@query("boot_index", f"{BOOT} SELECT chr, pos, idx FROM ix")
def _(spark, d):
    return _indexed(spark, d).select("chr", "pos", "idx")


@query("boot_blocks", f"{BOOT} SELECT rep, block, start FROM st")
def _(spark, d):
    return _starts(spark, _good(spark, d))


SEED = 20_301


def _seeded_sql() -> str:
    rows = f"{BOOT}, f0 AS (SELECT rep, block, (((rep + 1) * 7919 + (block + 1) * 104729 + {SEED}) % {bootstrap.PRIME})::BIGINT AS x FROM st)"
    last = "f0"
    for step in range(6):
        name, k = f"f{step + 1}", step % 3
        first = ", first_" if step > 3 else ""
        if step == 3:
            rows += f", g AS (SELECT rep, block, x AS first_, ((x + block + 1) % {bootstrap.PRIME})::BIGINT AS x FROM {last})"
            last, first = "g", ", first_"
        rows += f", {name} AS (SELECT rep, block{first}, ((x * x) % {bootstrap.PRIME} * {bootstrap.FACTOR} + {SEED + k + 1}) % {bootstrap.PRIME} AS x FROM {last})"
        last = name
    return f"{rows} SELECT rep, block, (first_ * {bootstrap.PRIME} + x) % (SELECT n - {LENGTH} + 1 FROM tot) AS start FROM {last}"


@query("boot_blocks_seeded", _seeded_sql())
def _(spark, d):
    return bootstrap.block_starts(spark, _good(spark, d).count(), LENGTH, REPS, SEED)


@query("boot_multiplicity", f"{BOOT} SELECT rep, idx, count(*) AS w FROM ix JOIN st ON idx >= start AND idx < start + {LENGTH} GROUP BY rep, idx")
def _(spark, d):
    placed = _indexed(spark, d)
    return bootstrap.multiplicity(_starts(spark, placed), placed, LENGTH)


BOOT_COUNTS = " UNION ALL ".join(f"SELECT rep, {m}::BIGINT AS pat, sum({product(m)}) AS v FROM ix JOIN st ON idx >= start AND idx < start + {LENGTH} GROUP BY rep" for m in MASKS)


def _counts(spark: SparkSession, d: str) -> DataFrame:
    placed = _indexed(spark, d)
    return bootstrap.replicate_counts(placed, FREQ, _starts(spark, placed), LENGTH)


@query("boot_counts", f"{BOOT} SELECT rep, pat, round(v, 6) AS value FROM ({BOOT_COUNTS})")
def _(spark, d):
    return _counts(spark, d).select("rep", "pat", r6("value", "value"))


@query("boot_ci", f"{BOOT} SELECT pat, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM ({BOOT_COUNTS}) GROUP BY pat")
def _(spark, d):
    return bootstrap.percentile_interval(_counts(spark, d), ["pat"]).select("pat", r6("low", "low"), r6("high", "high"))


# Posterior probability of admixture

ADMIX = 0.1
COND = f"WITH {A.OPF}, {A.DAF}, {A.WIDE}, c AS (SELECT pat, {ADMIX}::DOUBLE * q / ((1 - {ADMIX}::DOUBLE) * p + {ADMIX}::DOUBLE * q) AS c FROM (SELECT pat, a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM (SELECT pat, sum(CASE WHEN tab < 5 THEN value END) AS a, sum(CASE WHEN tab >= 5 THEN value END) AS b FROM opf GROUP BY pat)))"


def _cond(spark: SparkSession, d: str) -> DataFrame:
    sums = [t.groupBy("pat").agg(F.sum("value").alias("value")) for t in _pairs(spark, d)]
    return posterior.conditional(tables.normalised(sums[0]), tables.normalised(sums[1]), ADMIX)


def _site_sql() -> str:
    z = " + ".join(f"{product(m)}" for m in MASKS)
    zc = " + ".join(f"{product(m)} * (SELECT c FROM c WHERE pat = {m})" for m in MASKS)
    return f"SELECT chr, pos, CASE WHEN {z} = 0 THEN NULL ELSE ({zc}) / ({z}) END AS posterior FROM sites WHERE status = 'OK'"


@query("admix_cond", f"{COND} SELECT pat, round(c, 9) AS c FROM c")
def _(spark, d):
    return _cond(spark, d).select("pat", F.round("c", 9).alias("c"))


@query("admix_site", f"{COND} SELECT chr, pos, round(posterior, 6) AS posterior FROM ({_site_sql()})")
def _(spark, d):
    return posterior.site_posterior(_good(spark, d), FREQ, _cond(spark, d)).select("chr", "pos", r6("posterior", "posterior"))


@query("admix_mean", f"{COND} SELECT round(avg(posterior), 6) AS mean_posterior, count(posterior) AS n_sites FROM ({_site_sql()})")
def _(spark, d):
    return posterior.mean_posterior(posterior.site_posterior(_good(spark, d), FREQ, _cond(spark, d))).select(r6("mean_posterior", "mean_posterior"), "n_sites")


def _frequency_sql() -> str:
    z = " + ".join(product(m) for m in MASKS)
    each = " UNION ALL ".join(f"SELECT {m}::BIGINT AS pat, avg(({product(m)}) / z) AS frequency FROM s" for m in MASKS)
    return f"{COND}, s AS (SELECT *, {z} AS z FROM sites WHERE status = 'OK' AND {z} > 0), f AS ({each}) SELECT pat, round(frequency, 6) AS frequency, round(c, 9) AS c, round((SELECT sum(f.frequency * c.c) FROM f JOIN c USING (pat)), 6) AS mean_posterior, (SELECT count(*) FROM s) AS n_sites FROM f JOIN c USING (pat)"


@query("admix_pattern_frequencies", _frequency_sql())
def _(spark, d):
    told = posterior.pattern_frequencies(_good(spark, d), FREQ, _cond(spark, d))
    return told.select("pat", r6("frequency", "frequency"), F.round("c", 9).alias("c"), r6("mean_posterior", "mean_posterior"), "n_sites")


@query("many_population_posterior", f"""WITH RECURSIVE {A.MANY_SQL}, c AS (SELECT bit_count(pat) AS n, avg(z) AS c FROM shown GROUP BY 1)
SELECT vec_id, round(sum(z * c) / sum(z), 6) AS posterior FROM shown JOIN c ON n = bit_count(pat) WHERE n > 1 GROUP BY vec_id""")
def _(spark, d):
    """Each pattern's c is the mean probability of the patterns with as many populations."""
    rows = A.many_frequencies(spark, d)
    shown = P.occurring_patterns(rows, A.MANY, []).where(P.is_pattern(len(A.MANY), True)).withColumn("n", F.bit_count("pat"))
    c = shown.groupBy("n").agg(F.avg("z").alias("c")).join(shown.select("n", "pat").distinct(), "n")
    at = rows.withColumns({"chr": F.lit("1"), "pos": F.col("vec_id")})
    return posterior.site_posterior(at, A.MANY, c).where("posterior is not null").select(F.col("pos").alias("vec_id"), r6("posterior", "posterior"))


@query("pattern_posterior", f"{COND} SELECT round(sum(value * c) / sum(value), 6) AS mean_posterior FROM (SELECT pat, sum(value) AS value FROM opf GROUP BY pat) JOIN c USING (pat)")
def _(spark, d):
    return posterior.pattern_posterior(A.opf_rows(spark, d).groupBy("pat").agg(F.sum("value").alias("value")), _cond(spark, d)).select(r6("mean_posterior", "mean_posterior"))


# Comparing models

NORM = f"WITH {A.OPF}, nrm AS (SELECT tab, pat, value / sum(value) OVER (PARTITION BY tab) AS v FROM opf), msd AS (SELECT a.tab AS i, b.tab - 5 AS j, avg((a.v - b.v) * (a.v - b.v)) AS msd FROM nrm a JOIN nrm b USING (pat) WHERE a.tab < 5 AND b.tab >= 5 GROUP BY 1, 2)"


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = A.opf_rows(spark, d)
    return rows.where("tab < 5").withColumnRenamed("tab", "i"), rows.where("tab >= 5").withColumn("j", F.col("tab") - 5).drop("tab")


@query("msd", f"{NORM} SELECT i, j, round(msd, 12) AS msd FROM msd")
def _(spark, d):
    return model_choice.mean_squared_difference(*_halves(spark, d)).select("i", "j", F.round("msd", 12).alias("msd"))


@query("prediction_error", f"{NORM} SELECT k AS i, round(sum(msd) / 4, 12) AS bepe FROM (SELECT i AS k, msd FROM msd WHERE i <> j UNION ALL SELECT j, msd FROM msd WHERE i <> j) GROUP BY k")
def _(spark, d):
    return model_choice.bootstrap_prediction_error(*_halves(spark, d)).select("i", F.round("bepe", 12).alias("bepe"))


NAMES = ["p1", "p2", "p3", "p4"]


def _estimates(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), *A.parameters(4))


COV = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, covar_pop({A.parameter_sql(i + 1, 4)}, {A.parameter_sql(j + 1, 4)}) AS cov FROM embeddings" for i, a in enumerate(NAMES) for j, b in enumerate(NAMES))


@query("covar", f"SELECT a, b, round(cov, 9) AS cov FROM ({COV})")
def _(spark, d):
    return model_choice.covariance(_estimates(spark, d), NAMES).select("a", "b", F.round("cov", 9).alias("cov"))


#: Coefficients of a quadratic of four parameters: a log likelihood whose second derivatives are known.
QUADRATIC = {("p1", "p1"): -3.0, ("p1", "p2"): 1.0, ("p2", "p2"): -2.0, ("p3", "p3"): -4.0, ("p1", "p4"): 0.5, ("p4", "p4"): -5.0}
SECOND = "(VALUES " + ", ".join(f"('{a}', '{b}', {QUADRATIC.get((min(a, b), max(a, b)), 0.0) * (2 if a == b else 1)}::DOUBLE)" for a in NAMES for b in NAMES) + ")"


def _points(spark: SparkSession, d: str) -> DataFrame:
    lnl = sum((F.lit(w) * F.col(a) * F.col(b) for (a, b), w in QUADRATIC.items()), F.lit(0.0))
    return _estimates(spark, d).withColumnRenamed("row", "ord").withColumn("lnL", lnl)


@query("clic_trace", f"WITH c AS ({COV}), h AS (SELECT * FROM {SECOND} h(a, b, h)), e AS (SELECT vec_id, {', '.join(f'{A.parameter_sql(j + 1, 4)} AS {n}' for j, n in enumerate(NAMES))} FROM embeddings), l AS (SELECT {' + '.join(f'{w} * {a} * {b}' for (a, b), w in QUADRATIC.items())} AS lnl FROM e ORDER BY vec_id LIMIT 1) SELECT round(-((SELECT lnl FROM l) + sum(h.h * c.cov)), 4) AS clic FROM h JOIN c ON h.a = c.b AND h.b = c.a")
def _(spark, d):
    points = _points(spark, d)
    h = model_choice.hessian(points, NAMES)
    hess = spark.createDataFrame([(a, b, float(h[i, j])) for i, a in enumerate(NAMES) for j, b in enumerate(NAMES)], "a string, b string, h double")
    lnl = points.where("ord = 0").first()["lnL"]
    return model_choice.clic(lnl, hess, model_choice.covariance(points, NAMES)).select(F.round("clic", 4).alias("clic"))


CRIT = "crit AS (SELECT o_custkey % 50 AS row, o_orderpriority AS model, min(floor(o_totalprice / 1000)) AS crit FROM orders GROUP BY 1, 2)"
WEIGHTS = f"{CRIT}, win AS (SELECT row, model, CASE WHEN crit = min(crit) OVER (PARTITION BY row) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS b FROM crit), wts AS (SELECT model, avg(b / s) AS weight FROM (SELECT model, b, sum(b) OVER (PARTITION BY row) AS s FROM win) GROUP BY model)"


def _weights(spark: SparkSession, d: str) -> DataFrame:
    o = A.table(spark, d, "orders")
    crit = o.groupBy((F.col("o_custkey") % 50).alias("row"), F.col("o_orderpriority").alias("model")).agg(F.min(F.floor(F.col("o_totalprice") / 1000)).alias("crit"))
    return model_choice.model_weights(crit)


@query("model_weights", f"WITH {WEIGHTS} SELECT model, round(weight, 9) AS weight FROM wts")
def _(spark, d):
    return _weights(spark, d).select("model", F.round("weight", 9).alias("weight"))


@query("model_average", f"WITH {WEIGHTS}, e AS (SELECT o_custkey % 20 AS row, o_orderpriority AS model, o_orderstatus AS name, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2, 3) SELECT row, name, round(sum(weight * value) / sum(weight), 4) AS value FROM e JOIN wts USING (model) GROUP BY row, name HAVING sum(weight) > 0")
def _(spark, d):
    o = A.table(spark, d, "orders")
    e = o.groupBy((F.col("o_custkey") % 20).alias("row"), F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("name")).agg(F.avg("o_totalprice").alias("value"))
    return model_choice.model_average(e, _weights(spark, d)).where("value is not null").select("row", "name", F.round("value", 4).alias("value"))


@query("estimate_intervals", f"WITH {A.EST} SELECT name, round(max(CASE WHEN row = 0 THEN value END), 6) AS estimate, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM est GROUP BY name")
def _(spark, d):
    return model_choice.estimate_intervals(A.estimate_rows(spark, d)).select("name", r6("estimate", "estimate"), r6("low", "low"), r6("high", "high"))


def _shares_sql() -> str:
    """Eigenvalues of the matrix of correlations: its power sums give the characteristic polynomial; Newton's steps from above find
    the largest root, which is divided out, and so on. No power of the matrix depends on the signs of components."""
    corr = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS v FROM est" for a in NAMES for b in NAMES)
    step = "x - CASE WHEN g = 0 THEN 0 ELSE f / g END"
    return f"""WITH RECURSIVE est AS (SELECT {', '.join(f'{A.parameter_sql(j + 1, 4)} AS {n}' for j, n in enumerate(NAMES))} FROM embeddings), r AS MATERIALIZED ({corr}),
r2 AS (SELECT x.a, y.b, sum(x.v * y.v) AS v FROM r x JOIN r y ON x.b = y.a GROUP BY 1, 2),
p AS (SELECT (SELECT sum(v) FROM r WHERE a = b) AS p1, (SELECT sum(v) FROM r2 WHERE a = b) AS p2, (SELECT sum(r.v * r2.v) FROM r JOIN r2 USING (a, b)) AS p3, (SELECT sum(v * v) FROM r2) AS p4),
e AS (SELECT *, (e2 * p1 - p1 * p2 + p3) / 3 AS e3 FROM (SELECT *, (p1 * p1 - p2) / 2 AS e2 FROM p)),
n(k, step, x, a4, a3, a2, a1, a0) AS (
  SELECT 0, 0, 5.0::DOUBLE, 1.0::DOUBLE, -p1, e2, -e3, (e3 * p1 - e2 * p2 + p1 * p3 - p4) / 4 FROM e
  UNION ALL SELECT CASE WHEN step < 100 THEN k ELSE k + 1 END, CASE WHEN step < 100 THEN step + 1 ELSE 0 END, CASE WHEN step < 100 THEN {step} ELSE 5.0::DOUBLE END,
    CASE WHEN step < 100 THEN a4 ELSE 0 END, CASE WHEN step < 100 THEN a3 ELSE a4 END, CASE WHEN step < 100 THEN a2 ELSE a3 + x * a4 END,
    CASE WHEN step < 100 THEN a1 ELSE a2 + x * (a3 + x * a4) END, CASE WHEN step < 100 THEN a0 ELSE a1 + x * (a2 + x * (a3 + x * a4)) END
  FROM (SELECT *, (((a4 * x + a3) * x + a2) * x + a1) * x + a0 AS f, ((4 * a4 * x + 3 * a3) * x + 2 * a2) * x + a1 AS g FROM n) WHERE k < 4 AND NOT (k = 3 AND step = 100))
SELECT k AS component, round(x / 4, 5) AS fraction FROM n WHERE step = 100"""


@query("pca_fracvar", _shares_sql())
def _(spark, d):
    return model_choice.component_shares(_estimates(spark, d), NAMES).select("component", F.round("fraction", 5).alias("fraction"))


@query("pca_correlations", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({A.parameter_sql(i + 1, 4)}, {A.parameter_sql(j + 1, 4)}), 9) AS value FROM embeddings" for i, a in enumerate(NAMES) for j, b in enumerate(NAMES)))
def _(spark, d):
    """The correlations that the components and their shares make up: the same whatever the components' signs."""
    _, _, shares, parts = model_choice.principal_components(_estimates(spark, d), NAMES)
    made = (parts.T * shares * len(NAMES)) @ parts
    return spark.createDataFrame([(a, b, float(made[i, j])) for i, a in enumerate(NAMES) for j, b in enumerate(NAMES)], "a string, b string, value double").select("a", "b", F.round("value", 9).alias("value"))


@query("hessian_regression", f"SELECT * FROM {SECOND} v(a, b, h) WHERE (SELECT count(*) FROM embeddings) > 0")
def _(spark, d):
    """The regression over the estimates gets the second derivatives back."""
    h = model_choice.hessian(_points(spark, d), NAMES)
    return spark.createDataFrame([(a, b, float(h[i, j])) for i, a in enumerate(NAMES) for j, b in enumerate(NAMES)], "a string, b string, h double").select("a", "b", (F.round("h", 4) + 0.0).alias("h"))


# Functions and rewriting


@query("reflect_values", "SELECT l_orderkey, l_linenumber, round(-1 + least(y, 4 - y), 6) AS folded FROM (SELECT l_orderkey, l_linenumber, (l_extendedprice / 1000 + 1) - 4 * floor((l_extendedprice / 1000 + 1) / 4) AS y FROM lineitem)")
def _(spark, d):
    x = A.table(spark, d, "lineitem")
    return x.select("l_orderkey", "l_linenumber", r6(numeric.reflect(F.col("l_extendedprice") / 1000, -1.0, 1.0), "folded"))


@query("sorted_searches", "SELECT l_orderkey, l_linenumber, (CASE WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 20 THEN 1 WHEN l_quantity <= 40 THEN 2 ELSE 3 END)::INT AS first_geq, (CASE WHEN l_quantity < 10 THEN -1 WHEN l_quantity < 20 THEN 0 WHEN l_quantity < 40 THEN 1 ELSE 2 END)::INT AS last_leq FROM lineitem")
def _(spark, d):
    values = F.array(*[F.lit(v) for v in (10.0, 20.0, 40.0)])
    q = F.col("l_quantity")
    return A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", numeric.first_at_least(values, q).alias("first_geq"), numeric.last_at_most(values, q).alias("last_leq"))


@query("fitted_lines", "SELECT s_suppkey AS line_no, CASE WHEN s_suppkey % 3 = 0 THEN 'segment s' || s_suppkey || ' t=T twoN=N' WHEN s_suppkey % 3 = 1 THEN 'time free T' || s_suppkey || ' = ' || (s_nationkey * 4) || ' # old' ELSE 'twoN fixed [1, 2] N' || s_suppkey || '=7' END AS value FROM supplier")
def _(spark, d):
    x = A.table(spark, d, "supplier")
    k = F.col("s_suppkey").cast("string")
    value = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("segment s"), k, F.lit(" t=T twoN=N"))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("time free T"), k, F.lit(" = 1.5 # old"))).otherwise(F.concat(F.lit("twoN fixed [1, 2] N"), k, F.lit("=7")))
    fitted = x.select(F.concat(F.lit("T"), k).alias("name"), (F.col("s_nationkey") * 4).cast("double").alias("fit"))
    return rewriting.with_fitted_values(x.select(F.col("s_suppkey").alias("line_no"), value.alias("value")), fitted)


@query("component_lines")
def _(spark, d):
    lines = rewriting.component_lines(_estimates(spark, d), NAMES, 0.2)
    return spark.createDataFrame(list(enumerate(lines)), "line_no int, value string")


@query("component_values", f"WITH {A.EST} SELECT row, name, round(value, 6) AS value, true AS bounded FROM est")
def _(spark, d):
    """Every estimate as the statements of components make it, and whether all its components lie within their bounds: neither
    depends on the components' signs."""
    rows = _estimates(spark, d)
    means, coefficients, bounds = rewriting.component_coefficients(rewriting.component_lines(rows, NAMES))
    spread = rows.agg(*[F.stddev_samp(n).alias(n) for n in NAMES]).first()
    score = {pc: sum(((F.col(n) - means[n]) * (coefficients[n][pc] / spread[n] ** 2) for n in NAMES), F.lit(0.0)) for pc in bounds}
    value = lambda n: sum((coefficients[n][pc] * F.col(pc) for pc in bounds), F.lit(means[n]))
    within = sum((F.when(F.abs(F.col(pc)) <= b, 0).otherwise(1) for pc, b in bounds.items()), F.lit(0)) == 0
    scored = rows.select("row", *[x.alias(pc) for pc, x in score.items()])
    return scored.select("row", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), r6(value(n), "value")) for n in NAMES])), within.alias("bounded"))


@query("fitted_statements", """SELECT s_suppkey * 4 + k AS line_no, CASE
  WHEN k = 0 THEN 'param constrained x' || s_suppkey || (CASE WHEN s_suppkey % 2 = 0 THEN ' = ' || (s_nationkey * 2) ELSE ' = a +' END) || ' # first'
  WHEN k = 1 THEN (CASE WHEN s_suppkey % 2 = 0 THEN '# second' ELSE '  b * # second' END) WHEN k = 2 THEN '# all comment' ELSE '  c' END AS value
FROM supplier, (SELECT unnest(range(4)) AS k) WHERE k < 3 OR s_suppkey % 2 = 1""")
def _(spark, d):
    x = A.table(spark, d, "supplier")
    k = F.col("s_suppkey").cast("string")
    texts = F.array(F.concat(F.lit("param constrained x"), k, F.lit(" = a + # first")), F.lit("  b * # second"), F.lit("# all comment"), F.lit("  c"))
    lines = x.select("s_suppkey", F.posexplode(texts).alias("k", "value")).select((F.col("s_suppkey") * 4 + F.col("k")).alias("line_no"), "value")
    fitted = x.where("s_suppkey % 2 = 0").select(F.concat(F.lit("x"), k).alias("name"), (F.col("s_nationkey") * 2).cast("double").alias("fit"))
    return rewriting.with_fitted_values(lines, fitted).select("line_no", "value")


@query("pts_parse", f"WITH {A.EST} SELECT row, name, round(value, 6) AS value FROM est")
def _(spark, d):
    e = _estimates(spark, d)
    rows = e.select((F.col("row") + 2).alias("line_no"), F.concat_ws(" ", *[F.col(n).cast("string") for n in NAMES]).alias("value"))
    head = spark.createDataFrame([(0, "# points"), (1, " ".join(NAMES))], "line_no long, value string")
    return text.flat_rows(rows.unionByName(head)).select("row", "name", r6("value", "value"))


# Readers with headers, and what is made of several files


@query("daf_scan_status", f"WITH {A.DAF} SELECT chr, pos, aa, da, round(daf, 6) AS daf, 'OK' AS status FROM daf_rows WHERE pos % 7 > 1 UNION ALL SELECT chr, pos, aa, da, NULL, 'EINVAL' FROM daf_rows WHERE pos % 7 = 0 UNION ALL SELECT chr, pos, aa, NULL, NULL, 'BAD_DAF_INPUT' FROM daf_rows WHERE pos % 7 = 1")
def _(spark, d):
    k = F.col("pos") % 7
    last = F.when(k == 0, F.concat("da", F.lit(" x"))).when(k == 1, F.lit("")).otherwise(F.concat("da", F.lit(" "), F.col("daf").cast("string")))
    lines = A.daf_rows(spark, d).select(F.concat_ws(" ", "chr", F.col("pos").cast("string"), F.upper("aa"), last).alias("value"))
    return text.read_daf(lines, status=True).select("chr", "pos", "aa", "da", r6("daf", "daf"), "status")


_CHECKS = (
    (("multref", "ref LIKE '%,%'"), ("multalt", "alt LIKE '%,%'"), ("multaa", "aa LIKE '%|%'")),
    (("indelref", "length(ref) <> 1"), ("indelalt", "length(alt) <> 1"), ("indelaa", "length(aa) <> 1")),
    (("missref", "ref = '.'"), ("missaa", "aa = '.'")),
)


def _counter_sql() -> str:
    parts, before = [], "true"
    for group in _CHECKS:
        parts += [f"SELECT '{name}' AS reason FROM gc WHERE {before} AND {test}" for name, test in group]
        before += "".join(f" AND NOT ({test})" for _, test in group)
    parts.append(f"SELECT CASE WHEN aa <> ref AND aa <> alt AND alt <> '.' THEN 'threealleles' WHEN zeros + ones = 0 THEN 'zerogtype' ELSE 'good' END FROM gc WHERE {before}")
    parts.append(f"SELECT 'bad' FROM gc WHERE NOT ({before}) OR (aa <> ref AND aa <> alt AND alt <> '.') OR zeros + ones = 0")
    return f"WITH {A.GENOTYPES} SELECT reason, count(*) AS n_rows FROM ({' UNION ALL '.join(parts)}) GROUP BY reason"


@query("genotype_counters", _counter_sql())
def _(spark, d):
    return text.genotype_counters(A.genotype_lines(spark, d))


def _sim_lines(spark: SparkSession, d: str) -> DataFrame:
    """Two files with headers, one of each line status."""
    x = A.table(spark, d, "lineitem")
    bit = lambda e: F.expr(f"cast({e} % 2 as string)")
    row = F.concat_ws(" ", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), bit("l_partkey"), bit("l_partkey div 2"), bit("l_suppkey"), bit("l_suppkey div 2"))
    rows = x.select(F.col("l_linestatus").alias("file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber") + 10).alias("line_no"), row.alias("value"))
    head = ["nchromosomes = 3", "chrlen = 1000", "npops = 3", "pop sampsize", "x 1", "y 2", "z 1"]
    heads = rows.select("file").distinct().select("file", F.posexplode(F.array(*[F.lit(h) for h in head])).alias("line_no", "value"))
    return rows.unionByName(heads.withColumn("line_no", F.col("line_no").cast("long")))


SIM = "sim AS (SELECT l_linestatus AS file, (CAST(l_partkey AS BIGINT) % 2)::DOUBLE AS p0, (l_partkey // 2 % 2 + l_suppkey % 2)::DOUBLE / 2 AS p1, (l_suppkey // 2 % 2)::DOUBLE AS p2 FROM lineitem)"


@query("sim_patterns", f"WITH {SIM} {pattern_sql(MASKS1, 'sim', 'true', extra='file, ')}")
def _(spark, d):
    lines = _sim_lines(spark, d)
    sizes = samples.sim_samples(lines)
    sites_ = samples.frequency_columns(samples.sim_sites(lines, sizes), sizes)
    return P.pattern_sums(sites_, list(sizes), singletons=True, by=["file"]).select("file", "pat", r6("value", "value"))


SCRM = "scrm AS (SELECT o_orderstatus AS file, (c % 2)::DOUBLE AS p0, ((c // 2) % 2 + (c // 4) % 2)::DOUBLE / 2 AS p1 FROM (SELECT o_orderstatus, o_orderkey, o_custkey AS c, sum(CASE WHEN o_orderkey % 8 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS b FROM orders) WHERE b > 0 AND o_orderkey % 8 <> 0)"


@query("scrm_patterns", f"WITH {SCRM} {pattern_sql(P.masks(2, True), 'scrm', 'true', ('p0', 'p1'), 'file, ')}")
def _(spark, d):
    c = F.col("o_custkey")
    row = F.concat_ws(" ", F.lit("0.5"), F.lit("1.25"), (c % 2).cast("string"), F.expr("cast(o_custkey div 2 % 2 as string)"), F.expr("cast(o_custkey div 4 % 2 as string)"))
    lines = A.table(spark, d, "orders").select(F.col("o_orderstatus").alias("file"), F.col("o_orderkey").alias("line_no"), F.when(F.col("o_orderkey") % 8 == 0, F.lit("position time 1 2 3")).otherwise(row).alias("value"))
    sizes = dict(zip(("x", "y"), samples.scrm_samples("scrm 3 9 -transpose-segsites -I 2 1 0 -eI 0.5 0 2"), strict=True))
    return P.pattern_sums(samples.frequency_columns(text.scrm_sites(lines), sizes), ["x", "y"], singletons=True, by=["file"]).select("file", "pat", r6("value", "value"))


def _state_lines(spark: SparkSession, d: str) -> DataFrame:
    x = A.table(spark, d, "supplier")
    row = F.concat_ws(" ", F.format_string("%.2f", "s_acctbal"), F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string"))
    rows = x.select(F.col("s_nationkey").alias("file"), (F.col("s_suppkey") + 2).cast("long").alias("line_no"), row.alias("value"))
    old = F.col("file") % 2 == 1
    first = F.concat(F.col("n").cast("string"), F.when(old, F.lit(" 2")).otherwise(F.lit(" 2 fmt2")))
    heads = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n")).select("file", F.inline(F.filter(F.array(F.struct(F.lit(0).cast("long").alias("line_no"), first.alias("value")), F.struct(F.lit(1).cast("long").alias("line_no"), F.when(~old, F.lit("cost T N")).alias("value"))), lambda h: h["value"].isNotNull())))
    return rows.unionByName(heads)


@query("state_parse", "SELECT s_nationkey AS file, dense_rank() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS pt, round(s_acctbal, 2) AS cost, u.name AS name, (CASE WHEN u.k = 0 THEN s_suppkey ELSE s_nationkey END)::DOUBLE AS value FROM supplier, (VALUES (0, 0, 'T'), (0, 1, 'N'), (1, 0, 'p0'), (1, 1, 'p1')) u(old, k, name) WHERE u.old = s_nationkey % 2")
def _(spark, d):
    return text.state_points(_state_lines(spark, d)).select("file", "pt", "cost", "name", "value")


@query("state_of_model", "SELECT s_nationkey AS file, dense_rank() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS pt, round(s_acctbal, 2) AS cost, u.name AS name, (CASE WHEN u.k = 0 THEN s_suppkey ELSE s_nationkey END)::DOUBLE AS value FROM supplier, (VALUES (0, 'T'), (1, 'N')) u(k, name)")
def _(spark, d):
    lines = _state_lines(spark, d).withColumn("value", F.regexp_replace("value", " fmt2$", " format-2"))
    return text.state_points(lines, ["T", "N"]).select("file", "pt", "cost", "name", "value")


@query("model_weights_by_file", f"WITH f AS (SELECT o_custkey % 10 AS row, o_orderpriority AS model, min(floor(o_totalprice / 1000)) AS crit FROM orders GROUP BY 1, 2), win AS (SELECT row, model, CASE WHEN crit = min(crit) OVER (PARTITION BY row) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS b FROM f) SELECT model, round(avg(b / s), 9) AS weight FROM (SELECT model, b, sum(b) OVER (PARTITION BY row) AS s FROM win) GROUP BY model")
def _(spark, d):
    o = A.table(spark, d, "orders")
    name = F.concat(F.lower(F.substring("o_orderpriority", 1, 1)), F.lit("-data"), (F.col("o_custkey") % 10).cast("string"), F.lit("-x.pts"))
    crit = o.groupBy(name.alias("name"), F.col("o_orderpriority").alias("model")).agg(F.min(F.floor(F.col("o_totalprice") / 1000)).alias("crit"))
    return model_choice.model_weights(model_choice.aligned_criteria(crit, "clic")).select("model", F.round("weight", 9).alias("weight"))


def _quadratic(p1, p2):
    return -3 * p1 * p1 + p1 * p2 - 2 * p2 * p2


COV2 = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, covar_pop({A.parameter_sql(i, 2)}, {A.parameter_sql(j, 2)}) AS cov FROM embeddings" for i, a in ((1, "p1"), (2, "p2")) for j, b in ((1, "p1"), (2, "p2")))


@query("clic_by_file", f"WITH c AS ({COV2}), h(a, b, h) AS (VALUES ('p1', 'p1', -6.0::DOUBLE), ('p1', 'p2', 1.0::DOUBLE), ('p2', 'p1', 1.0::DOUBLE), ('p2', 'p2', -4.0::DOUBLE)), tr AS (SELECT sum(h.h * c.cov) AS t FROM h JOIN c ON h.a = c.b AND h.b = c.a), first AS (SELECT label AS file, arg_min({A.parameter_sql(1, 2)}, vec_id) AS x, arg_min({A.parameter_sql(2, 2)}, vec_id) AS y FROM embeddings GROUP BY label) SELECT file, round(-(-3 * x * x + x * y - 2 * y * y + t), 4) AS clic FROM first, tr")
def _(spark, d):
    """Points of a quadratic for each label; the regression finds its second derivatives."""
    from pyspark.sql import Window

    rows = A.table(spark, d, "embeddings").select(F.col("label").alias("file"), "vec_id", *A.parameters(2))
    nth = F.row_number().over(Window.partitionBy("file").orderBy("vec_id")) - 1
    points = rows.withColumns({"ord": nth, "lnL": _quadratic(F.col("p1"), F.col("p2"))})
    hess = model_choice.hessians(points, ["p1", "p2"])
    return model_choice.clic_by_file(hess, model_choice.covariance(rows, ["p1", "p2"])).select("file", F.round("clic", 4).alias("clic"))


# What is written and read again


@query("gz_scan", ORACLE_SQL["daf_scan"])
def _(spark, d):
    """Gzipped lines."""
    path = stored.stored_path(spark, "lines-gz")
    rows = A.daf_rows(spark, d)
    rows.select(F.concat_ws("\t", "chr", F.col("pos").cast("string"), "aa", "da", F.col("daf").cast("string")).alias("value")).write.option("compression", "gzip").text(path)
    return text.read_daf(text.read_lines(spark, path)).select("chr", "pos", "aa", "da", r6("daf", "daf"))


@query("axt_from_lines", f"WITH {AXT} SELECT chr, pos, ref, alt, raf FROM bases WHERE alt NOT IN ('-', 'n') AND 5 + rec % 10 >= 8")
def _(spark, d):
    """From the lines of records, of which those with low scores are left out."""
    k = F.col("c_custkey")
    b = F.substring(F.lit("acgtacgtnacgt-acgtacgtaccgt"), (k % 13 + 1).cast("int"), F.lit(10))
    head = F.format_string("%d chr%d %d %d chrB 1 %d + %d", k, k % 5, k * 7, k * 7 + 7, F.length(F.replace(b, F.lit("-"), F.lit(""))), 5 + k % 10)
    lines = A.table(spark, d, "customer").select("c_custkey", F.posexplode(F.array(head, F.lit("ACG-TNGAT-"), b, F.lit(""))).alias("j", "value"))
    records = text.axt_records(lines.select((k * 4 + F.col("j")).alias("line_no"), "value"))
    return text.axt_bases(records, min_length=8, min_score=8).select("chr", "pos", "ref", "alt", "raf")


@query("bad_genotypes", f"WITH {A.GENOTYPES} SELECT coalesce({DAF_REJECT.replace('WHEN zeros + ones = 0', 'WHEN k % 41 = 0 THEN $$badgtype$$ WHEN zeros + ones = 0').replace('$$', chr(39))}, 'good') AS reason, count(*) AS n_rows FROM gc GROUP BY 1")
def _(spark, d):
    """One genotype of some lines is malformed."""
    odd = F.split("value", "\t")[1].cast("long") % 41 == 0
    broken = F.regexp_replace("value", "^((?:[^\t]*\t){5})[^\t]*", "$12|0")
    lines = A.genotype_lines(spark, d).withColumn("value", F.when(odd, broken).otherwise(F.col("value")))
    return text.reject_counts(text.genotype_daf(lines))


@query("patterns_file", ORACLE_SQL["daf_patterns_singletons"])
def _(spark, d):
    sums = P.pattern_sums(_good(spark, d), FREQ, singletons=True)
    path = stored.stored_path(spark, "patterns")
    sinks.write_patterns(sums.select(P.pattern_label(F.col("pat"), LABELS).alias("label"), P.pattern_rank(F.col("pat"), 3).alias("rank"), "value"), path)
    return tables.by_mask(text.pattern_section(text.read_lines(spark, path, ordered=True).drop("file")), LABELS).select("pat", r6("value", "value"))


@query("chromosome_files", f"WITH {A.DAF} SELECT pop, chr, pos, aa, da, round(daf, 6) AS daf FROM daf_rows")
def _(spark, d):
    path = stored.stored_path(spark, "by-chromosome")
    sinks.write_by_chromosome(A.daf_rows(spark, d), path)
    back = spark.read.schema("pop string, pos long, aa string, da string, daf double, chr string").option("sep", "\t").csv(path)
    return back.select("pop", "chr", "pos", "aa", "da", r6("daf", "daf"))


@query("replicate_files", ORACLE_SQL["boot_counts"])
def _(spark, d):
    path = stored.stored_path(spark, "replicates")
    sinks.write_replicates(_counts(spark, d), path)
    back = spark.read.schema("pat long, value double, rep long").option("sep", "\t").csv(path)
    return back.select("rep", "pat", r6("value", "value"))


@query("frequency_files", f"SELECT chr, pos, aa, da, daf FROM ({ORACLE_SQL['raf_to_daf_long']})")
def _(spark, d):
    path = stored.stored_path(spark, "frequencies")
    sinks.write_frequencies(sites.raf_to_daf_long(A.raf_rows(spark, d), A.POPS, A.OUTGROUP).select("chr", "pos", "aa", "da", "daf"), path)
    return text.read_daf(text.read_lines(spark, path)).select("chr", "pos", "aa", "da", r6("daf", "daf"))
