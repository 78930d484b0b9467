"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join. DataFrame functions only.

Listed entries are canonical URLs (host, then path). Every URL gives probe keys: each suffix of its host that starts at
a label, joined to each prefix of its path that is as long as some listed path. The Bloom filter has a number of blocks of
four 64-bit words, one bit a word for each key, so a probe reads one block; its size is a parameter, to be chosen by the
length of the list, and not a function of the pages. Keys that pass are joined exactly with the list, which removes false
positives (so a list too long for the filter costs time and changes nothing); of the entries that fit, the longest wins.

Defined results: a null URL or one without ``://`` has an empty host and path and matches nothing; ties between equally
long entries go to the longer host, then to ``allow``; repeated rows are judged alike, each on its own; empty tables
give empty results; an empty list gives every URL the default verdict. Other columns of the pages pass through; those
named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import packed, read_table, unpacked

#: Production rules: (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
DEFAULT_VERDICT = "allow"
RESULTS = ["host", "path", "rule", "verdict"]
#: Blocks of 4 x 64 bits: 4096 blocks take 128 KB and serve some 50,000 entries at a false-positive rate near 1 %.
BLOOM_BLOCKS = 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return F.when(F.locate("://", url) > 0, host).otherwise(F.lit(""))


def url_path(url: Column) -> Column:
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.when(F.locate("://", url) > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules])
    return spark.range(1).select(F.inline(entries.cast("array<struct<host:string,path:string,verdict:string>>")))


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\n"), path)


def _bit(hashed: Column, word: int) -> Column:
    place = F.shiftrightunsigned(hashed, 8 + 6 * word).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def _block(hashed: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(hashed, 32), F.lit(blocks)).cast("int")


def bloom_words(listed: DataFrame, blocks: int = BLOOM_BLOCKS) -> DataFrame:
    """One row, one array: the ``4 * blocks`` words of the filter over the keys of ``listed``."""
    h = F.xxhash64("key")
    words = listed.select(_block(h, blocks).alias("block"), *[_bit(h, w).alias(f"w{w}") for w in range(4)])
    filled = words.groupBy("block").agg(*[F.expr(f"bit_or(w{w})").alias(f"w{w}") for w in range(4)])
    every = listed.sparkSession.range(0, blocks, 1, 4).select(F.col("id").cast("int").alias("block"))
    dense = every.join(filled, "block", "left").select("block", F.array(*[F.coalesce(f"w{w}", F.lit(0).cast("long")) for w in range(4)]).alias("words"))
    return dense.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "words"))), lambda b: b["words"])).alias("bloom"))


def might_contain(bloom: Column, key: Column, blocks: int = BLOOM_BLOCKS) -> Column:
    h = F.xxhash64(key)
    tests = [F.get(bloom, _block(h, blocks) * 4 + w).bitwiseAND(_bit(h, w)) != 0 for w in range(4)]
    return tests[0] & tests[1] & tests[2] & tests[3]


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT_VERDICT, blocks: int = BLOOM_BLOCKS) -> DataFrame:
    """``pages`` with host, path, rule (null without one) and verdict. ``rules``: host, path, verdict."""
    listed = (
        rules.where("host is not null and path is not null and verdict in ('allow', 'block')")
        .groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
        .select(_key(F.col("host"), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), F.length("host").alias("host_chars"), "verdict", F.length("path").alias("path_chars"))
    )
    bloom = bloom_words(listed, blocks).scalar()
    lengths = listed.agg(F.coalesce(F.collect_set("path_chars"), F.array().cast("array<int>"))).scalar()
    kept = [c for c in pages.columns if c not in RESULTS]
    judged = pages.select(packed(kept), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))

    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.transform(F.col("lengths"), lambda n: F.when(F.length("path") >= n, F.substring(F.col("path"), F.lit(1), n))), lambda p: p.isNotNull())
    keys = F.flatten(F.transform("suffixes", lambda s: F.transform("prefixes", lambda p: _key(s, p))))
    urls = judged.where("host <> ''").select("host", "path").distinct().withColumns({"bloom": bloom, "lengths": lengths})
    hits = (
        urls.withColumns({"suffixes": suffixes, "prefixes": prefixes})
        .select("host", "path", F.explode(F.filter(keys, lambda k: might_contain(F.col("bloom"), k, blocks))).alias("key"))
    )
    best = hits.join(listed, "key").groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "host_chars", "rule")).alias("hit"))
    # URLs without a host have no rule, and would all be one key of the join
    out = [*unpacked(kept), "host", "path"]
    told = judged.where("host <> ''").join(best, ["host", "path"], "left").select(*out, F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))
    return told.unionAll(judged.where("host = ''").select(*out, F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = f"""
WITH urls AS (
  SELECT page_id,
         CASE WHEN instr(url, '://') > 0
              THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') ELSE '' END AS host,
         CASE WHEN instr(url, '://') > 0
              THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
rules(rule_host, rule_path, verdict) AS (VALUES {", ".join(str(r) for r in RULES)}),
hits AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, verdict
  FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
best AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM hits GROUP BY page_id)
SELECT u.page_id, u.host, u.path, b.rule, coalesce(b.verdict, '{DEFAULT_VERDICT}') AS verdict
FROM urls u LEFT JOIN best b ON u.page_id = b.page_id
"""
