"""Line dedup by pairwise alignment: shared rare line hashes find overlapping documents, patience diff aligns them, and
aligned common blocks are deleted from the later document.

The shortest runs of lines that reach ``MIN_WORDS`` words found pairs, most of them single lines, and whole texts too. A
run is rare if at most ``RARE`` documents hold it: then each of them is paired with every earlier holder. Of more frequent
runs no cap loses any: a document is paired with the earliest holder, with the earliest that holds the run only once, and
with the holder before it (of those with its salt, where a run is in more than ``HOT`` documents), so that a line shared by
a third of all documents gives at most three pairs a document and not all pairs of a group. Anchors of the alignment are
lines unique in both documents of a pair. What an alignment leaves is matched where it is alone in both, and aligned again
without all that was matched, until nothing is; so passages that stand in another order are found too: every line that is alone
in the later document and in some earlier one goes, if its block is long enough, whatever short lines the alignment preferred. Only arrays of line hashes travel to the pairs, not texts. Blocks of aligned lines with
``MIN_WORDS`` words or more are deleted from the later document, with the short and blank lines inside them; the owner
keeps them.

Defined results: documents are ordered by (doc_id, text), a null doc_id first; rows that repeat both are one document;
a null text has no lines and stays null; an empty text is one empty line; a text of which every line goes becomes empty;
empty tables give empty results; other columns pass through, whatever their names, and those named like a result column
are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ._spark import bounded_batches, materialize, packed, read_table, unpacked

#: Words that a line must have to found a pair, and a block to be deleted.
MIN_WORDS = 5
#: Documents that hold a rare run (three earlier ones at most for each); documents beyond which holders are salted; salts.
RARE, HOT, SALTS = 4, 1024, 64
#: An odd number and its inverse modulo 2^64, for hashes of runs.
_UP = np.uint64(0x9FB21C651E98DF25)
_DOWN = np.uint64(pow(0x9FB21C651E98DF25, -1, 1 << 64))
_WORD = r"[^\x20\x09-\x0D]+"


def patience_matches(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned equal elements of two sequences: common ends, then the longest increasing run of elements unique in
    both, then the gaps between them in the same way."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            found.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        once: dict = {}
        for k in range(j, j_end):
            once[b[k]] = -1 if b[k] in once else k
        seen: dict = {}
        for k in range(i, i_end):
            seen[a[k]] = -1 if a[k] in seen else k
        common = [(k, once[x]) for x, k in seen.items() if k >= 0 and once.get(x, -1) >= 0]  # in order of a
        # patience: piles by their top, each card pointing at the top of the pile before
        tops: list[int] = []
        cards: list[int] = []
        back: list[int] = []
        for n, (_, q) in enumerate(common):
            pile = bisect_left(tops, q)
            back.append(cards[pile - 1] if pile else -1)
            if pile == len(tops):
                tops.append(q)
                cards.append(n)
            else:
                tops[pile], cards[pile] = q, n
        chain: list[tuple[int, int]] = []
        n = cards[-1] if cards else -1
        while n >= 0:
            chain.append(common[n])
            n = back[n]
        if chain:
            edges = [*reversed(chain), (i_end, j_end)]
            for p, q in edges:
                if i < p and j < q:
                    todo.append((i, p, j, q))
                if p < i_end:
                    found.append((p, q))
                i, j = p + 1, q + 1
    return sorted(found)


def lone_matches(a: list, b: list) -> list[tuple[int, int]]:
    """Equal elements that are unique in both sequences, in order of the first; they may cross."""
    seen, once = Counter(a), Counter(b)
    place = {x: q for q, x in enumerate(b) if once[x] == 1}
    return [(p, place[x]) for p, x in enumerate(a) if seen[x] == 1 and x in place]


def common_blocks(a: list, a_words: list, b: list, min_words: int = MIN_WORDS) -> list[int]:
    """Positions in ``a`` of aligned blocks (runs that are adjacent in both) with at least ``min_words`` words. What an alignment
    leaves, in another order in ``b``, is matched where it is alone in both; then all that was matched, in whatever block, is taken
    out of ``a``, and the rest is aligned again until nothing is."""
    out: list[int] = []
    left: list = list(a)
    while True:
        aligned = patience_matches(left, b)
        for p, _ in aligned:
            left[p] = None  # equals no line
        crossing = lone_matches(left, b)
        for p, _ in crossing:
            left[p] = None
        if not aligned and not crossing:
            return sorted(out)
        for matches in (aligned, crossing):
            block: list[int] = []
            last = (-2, -2)
            for p, q in [*matches, (-2, -2)]:
                if (p, q) != (last[0] + 1, last[1] + 1) or p < 0:
                    if sum(a_words[k] for k in block) >= min_words:
                        out += block
                    block = []
                block.append(p)
                last = (p, q)


def line_table(docs: DataFrame) -> DataFrame:
    """Each distinct document once: key (doc_id, hash of the text), hashes of its lines, words of its lines."""
    lines = F.split("text", "\n", -1)
    return docs.where("text is not null").select(
        F.struct("doc_id", F.xxhash64("text").alias("tie")).alias("key"),
        F.transform(lines, lambda x: F.xxhash64(x)).alias("hashes"),
        F.transform(lines, lambda x: F.regexp_count(x, F.lit(_WORD))).alias("words"),
    )


def line_runs(hashes: np.ndarray, words: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shortest runs of lines that reach ``min_words`` words, from each line with a word, each run once; and
    whether the run is there only once. A line with enough words is a run of its own."""
    n = len(hashes)
    total = np.r_[0, np.cumsum(words)]
    start = np.flatnonzero(words > 0)
    end = np.searchsorted(total, total[start] + min_words)
    start, end = start[end <= n], end[end <= n]
    with np.errstate(over="ignore"):
        up = np.r_[np.uint64(1), np.cumprod(np.full(n, _UP))]
        down = np.r_[np.uint64(1), np.cumprod(np.full(n, _DOWN))]
        sums = np.r_[np.uint64(0), np.cumsum(hashes.view(np.uint64) * up[:n])]
        runs = (sums[end] - sums[start]) * down[start]
    found, times = np.unique(runs.view(np.int64), return_counts=True)
    return found, times == 1


def overlapping_pairs(lines: DataFrame, min_words: int = MIN_WORDS, rare: int = RARE, hot: int = HOT) -> DataFrame:
    """(key, owner): a document and an earlier one that share a run of lines, each pair once; see above for which."""

    def runs(hashes: pa.Array, words: pa.Array) -> pa.Array:
        told = [line_runs(np.array(h, np.int64), np.array(w, np.int64), min_words) for h, w in zip(hashes.to_pylist(), words.to_pylist(), strict=True)]
        at = pa.array(np.cumsum([0, *[len(r) for r, _ in told]]), pa.int32())
        run, alone = (pa.array(np.concatenate([np.zeros(0, t), *x])) for t, x in ((np.int64, [r for r, _ in told]), (bool, [o for _, o in told])))
        return pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([run, alone], ["run", "alone"]))

    kind = "array<struct<run:long,alone:boolean>>"
    whole = F.array(F.struct(F.xxhash64(F.lit("whole"), "hashes").alias("run"), F.lit(True).alias("alone"))).cast(kind)
    enough = F.aggregate("words", F.lit(0), lambda a, x: a + x) >= min_words
    held = lines.where(enough).select("key", F.inline(F.concat(arrow_udf(runs, kind)("hashes", "words"), whole)))
    held = materialize(held, "runs")
    owners = held.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first"), F.min(F.when(F.col("alone"), F.col("key"))).alias("other")).where("n > 1")
    owners = materialize(owners, "owners")
    few = held.join(owners.where(F.col("n") <= hot), "run").withColumn("salt", F.lit(0))
    salted = owners.where(F.col("n") > hot).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    many = held.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, ["run", "salt"]).select(*few.columns)

    def earlier(met: DataFrame) -> DataFrame:
        at = Window.partitionBy("run", "salt").orderBy("key")
        before = F.array(*[F.lag("key", k).over(at) for k in range(1, rare)])
        known = F.when(F.col("n") <= rare, before).otherwise(F.array("first", "other", F.get(before, F.lit(0))))
        return met.select("key", known.alias("known")).select("key", F.explode("known").alias("owner")).where("key > owner")

    return earlier(few).union(earlier(many)).distinct()


def deleted_lines(docs: DataFrame, min_words: int = MIN_WORDS, rare: int = RARE, hot: int = HOT) -> DataFrame:
    """(key, gone): positions of the lines that are deleted from a document."""
    bounded_batches(docs.sparkSession)
    lines = materialize(line_table(docs).dropDuplicates(["key"]), "lines")
    pairs = overlapping_pairs(lines, min_words, rare, hot)
    both = pairs.join(lines, "key").join(lines.select(F.col("key").alias("owner"), F.col("hashes").alias("owned")), "owner")

    def aligned(hashes: pa.Array, words: pa.Array, owned: pa.Array) -> pa.Array:
        rows = zip(hashes.to_pylist(), words.to_pylist(), owned.to_pylist(), strict=True)
        return pa.array([common_blocks(a, w, b, min_words) for a, w, b in rows], pa.list_(pa.int32()))

    gone = both.select("key", arrow_udf(aligned, "array<int>")("hashes", "words", "owned").alias("gone")).where("size(gone) > 0")
    return gone.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, rare: int = RARE, hot: int = HOT) -> DataFrame:
    """``docs`` with the kept text, n_lines and n_removed_lines; the documents' other columns stay."""
    gone = deleted_lines(docs.select("doc_id", "text"), min_words, rare, hot)
    results = ("n_lines", "n_removed_lines")
    passed = [c for c in docs.columns if c not in (*results, "text")]
    keyed = docs.select(packed(passed), "text", F.struct("doc_id", F.xxhash64("text").alias("tie")).alias("key"))
    joined = keyed.join(gone, "key", "left")
    lines = F.split("text", "\n", -1)
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone", i)), "\n")
    told = {
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"),
        "n_removed_lines": F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long"),
        "text": F.when(F.col("gone").isNull(), F.col("text")).otherwise(left),
    }
    order = [c for c in docs.columns if c not in results]
    row = dict(zip(passed, unpacked(passed), strict=True)) | told
    return joined.select(*[row[c].alias(c) for c in (*order, *results)])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed_lines", F.sha2("text", 256).alias("kept_sha256"))
