"""N-gram Jaccard join with set-relation skipping.

A document's set is its distinct 5-word shingles (64-bit hashes). All sets are ordered by one global order, rare
shingles first as far as a fixed-size sketch of counts tells, so that two sets of Jaccard similarity 0.8 share a
shingle among the first fifth of each (prefix filter). The inverted lists of prefix shingles are ordered by set size and
then by position; whole blocks of a list are skipped where size or position already rule a link out.

Answers are shared between similar sets: equal sets are one class, and each set first verifies only the candidate it
shares most lists with, its head. Sets that are linked so have one component, whose answers they inherit: every pair
inside it is skipped. Sets that candidates tie together are a family: those outside its largest component are compared
with all others of the family. Where a list still holds sets of different families and components, those of the smaller
component ask the other family, if they share enough lists with it for a link. Both comparisons take blocks of sets: their
overlaps follow from the few shingles in which each differs from one highly similar set of the block, whose overlaps are
counted once. So a group of thousands of near copies costs about one verification a set, sets are never rows of pairs,
and no link between components is lost.

Defined results: null texts and texts without words have an empty set, linked with nothing; a null doc_id is a row of its
own with a null component; rows that repeat a doc_id count as one document whose rows are linked, each row keeps its own
set; equal sets are linked whatever their size; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ._components import components, linked_groups
from ._spark import bounded_batches, discard, materialize, partitions_for, read_table, text_bytes_in
from ._words import mix64, text_bytes, tidy, word_hashes, word_spans

#: Words a shingle; similarity as a ratio of integers; counters of the sketch (32 bits each, whatever the corpus).
WORDS, NUM, DEN, SKETCH = 5, 80, 100, 1 << 19
_SLICES = 32
#: Bytes of input for each bucket of the lists.
BUCKET_BYTES = 1 << 26
#: Sets of a block of a family; pairs of equal shingles counted at once; bytes of text hashed at once.
FAMILY, PAIRS, BYTES = 768, 1 << 20, 1 << 20
_STEP = np.uint64(0x9FB21C651E98DF25)


def shingle_sets(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other; and where each text's begin."""
    raw, at = text_bytes(column)
    cuts, n = [0], len(at) - 1
    while cuts[-1] < n:  # runs of whole texts of about BYTES bytes
        cuts.append(max(int(np.searchsorted(at, at[cuts[-1]] + BYTES, side="right")) - 1, cuts[-1] + 1))
    parts = [_shingle_sets(raw[at[a] : at[b]], at[a : b + 1] - at[a], words) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    sizes = np.concatenate([np.zeros(1, np.int64), *[np.diff(x) for _, x in parts]])
    return np.concatenate([np.zeros(0, np.uint64), *[t for t, _ in parts]]), np.cumsum(sizes)


def _shingle_sets(raw: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_spans(raw, at)
    hashed = word_hashes(raw, starts, ends)
    n = np.diff(first)
    rolled = np.zeros(max(len(hashed) - words + 1, 0), np.uint64)
    for k in range(words):
        rolled = (rolled ^ hashed[k : len(hashed) - words + 1 + k]) * _STEP
        rolled ^= rolled >> np.uint64(29)
    rolled = mix64(rolled)
    found, size = [], np.zeros(len(n) + 1, np.int64)
    for i in range(len(n)):
        if n[i] >= words:
            mine = np.unique(rolled[first[i] : first[i + 1] - words + 1])
        elif n[i]:
            mine = np.array([n[i]], np.uint64)
            for k in range(first[i], first[i + 1]):
                mine = mix64((mine * _STEP) ^ hashed[k : k + 1])
        else:
            mine = np.zeros(0, np.uint64)
        found.append(mine)
        size[i + 1] = len(mine)
    return np.concatenate(found) if found else np.zeros(0, np.uint64), np.cumsum(size)


def prefix_length(n: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """How many of the first shingles of a set of size ``n`` every similar set must share one of."""
    return n - -(-n * num // den) + 1


def index_length(n: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """The same for similar sets that are at least as large."""
    return n - -(-2 * n * num // (num + den)) + 1


def set_stats(docs: DataFrame) -> DataFrame:
    """(kind, doc_id, n, s1, s2, block): a row of kind 0 for each document with the size and a 128-bit hash of its set;
    rows of kind 1 with counters of the sketch: slice ``n``, ``block`` of 32-bit counts."""
    schema = f"kind int, doc_id {dict(docs.dtypes)['doc_id']}, n long, s1 long, s2 long, block binary"

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, names = np.zeros(SKETCH, np.uint32), [f.split(" ")[0] for f in schema.split(", ")]
        id_type = pa.int64()
        for batch in batches:
            tokens, at = shingle_sets(batch.column("text"))
            np.add.at(counts, (tokens & np.uint64(SKETCH - 1)).astype(np.int64), 1)
            n = np.diff(at)
            sums = np.zeros((2, len(tokens) + 1), np.uint64)
            np.cumsum(mix64(tokens), out=sums[0, 1:])
            np.cumsum(mix64(tokens ^ _STEP), out=sums[1, 1:])
            hashes = [(s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums]
            id_type = batch.column("doc_id").type
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), batch.column("doc_id"), pa.array(n), *map(pa.array, hashes), pa.nulls(len(n), pa.binary())], names)
        none = pa.nulls(_SLICES, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(_SLICES, np.int32)), none.cast(id_type), pa.array(np.arange(_SLICES)), none, none, pa.array([x.tobytes() for x in np.split(counts, _SLICES)], pa.binary())], names)

    return docs.select("doc_id", "text").mapInArrow(tidy(stats), schema)


def shingle_counts(stats: DataFrame) -> np.ndarray:
    """The sketch over all documents; its size is a parameter. Slices are added up on the executors."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, block in zip(batch.column("n").to_pylist(), batch.column("block").to_pylist(), strict=True):
                part = np.frombuffer(block, np.uint32).astype(np.uint64)
                total[k] = total[k] + part if k in total else part
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["n", "block"])

    rows = stats.where("kind = 1").select("n", "block").repartition(_SLICES, "n").mapInArrow(tidy(add), "n long, block binary").toPandas()
    out = np.zeros((_SLICES, SKETCH // _SLICES), np.uint64)
    for k, block in zip(rows["n"], rows["block"], strict=True):
        out[k] = np.frombuffer(block, np.uint64)
    return np.minimum(out.ravel(), 2**32 - 1).astype(np.uint32)


def prefix_blocks(docs: DataFrame, counts: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, tokens, docs, sizes, places): the prefix shingles of all sets, packed by bucket. Equal sets of one task are
    sent once."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)  # SKETCH counters

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, seen, kept, held = sent.value, set(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            tokens, ids, sizes, places = (np.concatenate(x) for x in zip(*kept, strict=True))
            bucket = (mix64(tokens ^ _STEP) >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(cuts))
            parts = [pa.array([x[order[cuts[k] : cuts[k + 1]]].tobytes() for k in full], pa.binary()) for x in (tokens, ids, sizes, places)]
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *parts], ["bucket", "tokens", "docs", "sizes", "places"])

        for batch in batches:
            tokens, at = shingle_sets(batch.column("text"))
            heavy = weight[(tokens & np.uint64(SKETCH - 1)).astype(np.int64)]
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                mine, rank = tokens[at[i] : at[i + 1]], heavy[at[i] : at[i + 1]]
                if doc is None or not len(mine):
                    continue
                same = (len(mine), int(mine.sum()), int(np.bitwise_xor.reduce(mine)))
                if same in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(same)
                long = int(prefix_length(np.int64(len(mine))))
                first = mine[np.lexsort((mine, rank))[:long]]
                kept.append((first, np.full(long, doc, np.int64), np.full(long, len(mine), np.int32), np.arange(long, dtype=np.int32)))
                held += long
            if held > 1_000_000:
                yield from flush()
                kept, held = [], 0
        if held:
            yield from flush()

    return docs.select("doc_id", "text").mapInArrow(tidy(blocks), "bucket int, tokens binary, docs binary, sizes binary, places binary")


def candidate_heads(token: np.ndarray, doc: np.ndarray, size: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of the lists (ordered by token, size, place, doc) the first entry of its list that could be a
    similar set of at most its size; pairs of row numbers. Blocks of a list that sizes or positions rule out are skipped."""
    usable = np.flatnonzero(place < index_length(size.astype(np.int64)))
    starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(token)]))
    key = group[usable] * (1 << 32) + size[usable]
    least = -(-size.astype(np.int64) * NUM // DEN)
    at = np.searchsorted(key, group * (1 << 32) + least)
    block_end = np.searchsorted(key, key, side="right")  # where the block of one size ends
    row, found = np.arange(len(token)), []
    while len(row):
        inside = at < len(usable)
        row, at = row[inside], at[inside]
        other = usable[at]
        inside = (group[other] == group[row]) & (size[other] <= size[row])
        row, at, other = row[inside], at[inside], other[inside]
        need = -(-(size[row].astype(np.int64) + size[other]) * NUM // (NUM + DEN))
        fits = np.minimum(size[row] - place[row], size[other] - place[other]) >= need
        mine = doc[other] == doc[row]
        # sets of one size are taken in order of doc, so that a pair is met from one side only
        before = (size[other] < size[row]) | (doc[other] < doc[row])
        good = fits & ~mine & before
        found.append((row[good], other[good]))
        row, at, fits = row[~good], at[~good], fits[~good]
        # positions rise within a block: if one is too far down the list, so is the rest of the block
        at = np.where(fits, at + 1, block_end[at]) if len(at) else at
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def list_entries(blocks: DataFrame, buckets: int) -> DataFrame:
    """(token, doc, size, place, early, head): entries of the inverted lists with a set of similar size in their list, whether
    the places allow a link there, and the head that each could be linked to first (null: none)."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for batch in batches:
            for k, (name, kind) in enumerate((("tokens", np.uint64), ("docs", np.int64), ("sizes", np.int32), ("places", np.int32))):
                parts[k] += [np.frombuffer(x, kind) for x in batch.column(name).to_pylist()]
        if not parts[0]:
            return
        token, doc, size, place = (np.concatenate(x) for x in parts)
        order = np.argsort(token, kind="stable")
        ordered = token[order]
        again = np.r_[False, ordered[1:] == ordered[:-1]]
        shared = order[again | np.r_[again[1:], False]]
        if not len(shared):
            return
        token, doc, size, place = (x[shared] for x in (token, doc, size, place))
        order = np.lexsort((doc, place, size, token))
        token, doc, size, place = (x[order] for x in (token, doc, size, place))
        head = np.full(len(token), -1, np.int64)
        row, other = candidate_heads(token, doc, size, place)
        head[row] = other
        # lists are in order of size: with the next size on both sides too far off, an entry has no partner in its list.
        # Places do not count here: what two sets share is bounded by how many lists of their whole prefixes they share
        like = (token[1:] == token[:-1]) & (NUM * size[1:].astype(np.int64) <= DEN * size[:-1].astype(np.int64))
        usable = np.r_[like, False] | np.r_[False, like]
        # a link has its first common shingle early in both sets; the smaller one need not be a head there
        same = (token[1:] == token[:-1]) & (size[1:] == size[:-1])
        early = (head >= 0) | ((place < index_length(size.astype(np.int64))) & (np.r_[like, False] | np.r_[False, same]))
        heads = np.where(head >= 0, doc[head], 0)[usable]
        token, doc, size, place, head, early = (x[usable] for x in (token, doc, size, place, head, early))
        heads = pa.array(heads, mask=head < 0)
        table = pa.Table.from_arrays([pa.array(token.view(np.int64)), pa.array(doc), pa.array(size), pa.array(place), pa.array(early), heads], ["token", "doc", "size", "place", "early", "head"])
        yield from table.to_batches(max_chunksize=50_000)

    return blocks.repartition(buckets, "bucket").drop("bucket").mapInArrow(tidy(lists), "token long, doc long, size int, place int, early boolean, head long")


def verified_heads(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """pairs: (a, head). Those whose whole sets are similar enough."""
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("head"), F.col("text").alias("text_head"))

    def compare(one: pa.Array, two: pa.Array) -> pa.Array:
        (x, x_at), (y, y_at) = shingle_sets(one), shingle_sets(two)
        similar = []
        for i in range(len(one)):
            p, q = x[x_at[i] : x_at[i + 1]], y[y_at[i] : y_at[i + 1]]
            common = int(np.isin(p, q, assume_unique=True).sum())
            similar.append(common > 0 and DEN * common >= NUM * (len(p) + len(q) - common))
        return pa.array(similar, pa.bool_())

    return pairs.join(left, "a").join(right, "head").where(arrow_udf(compare, "boolean")("text_a", "text_head")).select("a", "head")


def overlaps(tokens: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, like: int) -> np.ndarray:
    """How many tokens each set of ``left`` shares with each of ``right``, derived from set ``like``: sets that are much
    like it differ in few tokens, and only those are counted pair by pair."""
    x = tokens[at[like] : at[like + 1]]
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    known = x[np.minimum(np.searchsorted(x, tokens), max(len(x) - 1, 0))] == tokens if len(x) else np.zeros(len(tokens), bool)
    held = np.bincount(row[known], minlength=len(at) - 1)
    place = {int(r): k for k, r in enumerate(right)}
    side_l, side_r = np.full(len(at) - 1, -1), np.full(len(at) - 1, -1)
    side_l[left], side_r[list(place)] = np.arange(len(left)), list(place.values())
    # what sets have more than x, and what they lack of it
    lacks_row, lacks = [], []
    for r in range(len(at) - 1):
        lost = x[~np.isin(x, tokens[at[r] : at[r + 1]], assume_unique=True)]
        lacks_row.append(np.full(len(lost), r))
        lacks.append(lost)
    shared = np.zeros(len(left) * len(right), np.int32)
    for values, rows in ((tokens[~known], row[~known]), (np.concatenate(lacks), np.concatenate(lacks_row))):
        order = np.argsort(values, kind="stable")
        values, rows = values[order], rows[order]
        one, two = rows[side_l[rows] >= 0], rows[side_r[rows] >= 0]
        v1, v2 = values[side_l[rows] >= 0], values[side_r[rows] >= 0]
        begin, end = np.searchsorted(v2, v1), np.searchsorted(v2, v1, side="right")
        many = end - begin
        cut = np.r_[0, np.searchsorted(np.cumsum(many), np.arange(PAIRS, many.sum() + PAIRS, PAIRS), side="right")]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            n = many[a:b]
            other = np.repeat(begin[a:b], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            flat = np.repeat(side_l[one[a:b]] * len(right), n) + side_r[two[other]]
            shared += np.bincount(flat, minlength=len(shared)).astype(np.int32)
    lost = len(x) - held
    return shared.reshape(len(left), len(right)) + len(x) - lost[left][:, None] - lost[right][None, :]


def links_in_families(families: DataFrame, groups: DataFrame, docs: DataFrame) -> DataFrame:
    """families: (node, family). Links between different components of a family: sets outside its largest component
    against all of its sets."""
    sets = families.join(groups, "node", "left").select("family", F.col("node").alias("doc"), F.coalesce("component", "node").alias("component"))
    parts = sets.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"))
    shape = parts.groupBy("family").agg(F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("top")).where("all > top.n")
    placed = sets.join(shape.select("family", F.col("top.component").alias("top")), "family")
    return links_by_blocks(placed.where("component <> top").drop("top"), placed.drop("top"), docs)


def links_by_blocks(asking: DataFrame, members: DataFrame, docs: DataFrame) -> DataFrame:
    """asking and members: (family, doc, component). Links of the asking sets of a family with its members of other components,
    dealt out in pairs of blocks."""
    sizes = lambda rows, name: rows.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / FAMILY).cast("int").alias(name))
    shape = sizes(asking, "ni").join(sizes(members, "nj"), "family")
    mine = lambda n: F.pmod(F.xxhash64(F.lit(3), "doc"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asking.join(shape, "family").select("family", "doc", "component", F.lit(True).alias("asks"), mine("ni").alias("i"), every("nj").alias("j"))
    right = members.join(shape, "family").select("family", "doc", "component", F.lit(False).alias("asks"), every("ni").alias("i"), mine("nj").alias("j"))
    rows = left.unionByName(right).join(docs.where("doc_id is not null").select(F.col("doc_id").alias("doc"), "text"), "doc")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc", "ascending"), ("asks", "ascending")])  # the same links in whatever order rows arrive
        doc, component, asks = (table.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "component", "asks"))
        left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
        tokens, at = shingle_sets(table.column("text").combine_chunks())
        size = np.diff(at)
        least = np.arange(len(doc))
        if len(left) and len(right):
            names, counts = np.unique(component[right], return_counts=True)
            like = right[component[right] == names[counts.argmax()]][0]
            common = overlaps(tokens, at, left, right, int(like))
            near = (DEN * common >= NUM * (size[left][:, None] + size[right][None, :] - common)) & (common > 0)
            i, j = np.nonzero(near & (component[left][:, None] != component[right][None, :]))
            least = linked_groups(iter([(left[i], right[j])]), len(doc))
        tied = np.flatnonzero(least != np.arange(len(doc)))
        return pa.table({"a": pa.array(doc[tied], pa.int64()), "b": pa.array(doc[least[tied]], pa.int64())})

    return rows.groupBy("family", "i", "j").applyInArrow(compare, "a long, b long")


def asks_of_lists(open_lists: DataFrame) -> DataFrame:
    """open_lists: (token, z, size, rest, early, family, component, members). (z, kin, other, component): sets ``z`` that share enough
    lists with component ``other`` of family ``kin``, another one and no smaller, for a link."""
    sides = [F.col("component").alias("other"), F.col("members").alias("others"), F.col("family").alias("kin")]
    span = [F.min("size").alias("low"), F.max("size").alias("high")]
    fits = f"{DEN} * high >= {NUM} * size and {NUM} * low <= {DEN} * size"
    smallest = lambda n: F.greatest(F.col("low"), F.ceil(F.col(n) * NUM / DEN))
    need = lambda n: F.ceil((F.col(n) + smallest(n)) * NUM / (NUM + DEN))
    # the first shingle that two linked sets share is early in both, and no more can be common than is left of each from there on.
    # Frequent shingles are late, so few sets meet in long lists
    early = open_lists.where("early")
    first = early.groupBy("token", "z", "size", "component", "members", "family").agg(F.max("rest").alias("rest"))
    meant = (
        first.join(early.groupBy("token", *sides).agg(*span, F.max("rest").alias("left")), "token")
        .where("family <> kin and component <> other and (members < others or (members = others and component > other))").where(fits)
        .where(F.least("rest", "left") >= need("size")).select("z", "kin", "other").distinct()
    )
    # those pairs alone count all lists they share
    asking = open_lists.select("token", "z", "size", "component").distinct().join(meant, "z")
    counted = [F.count(F.lit(1)).alias("lists"), F.first("size").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.first("component").alias("component")]
    # of what the prefixes do not hold, all may be common at best; ``lists`` counts all that the whole prefixes share
    beyond = F.ceil(F.greatest("n", "high") * NUM / DEN) - 1
    # a set shares no more lists with a set of a family's component than with all of them together
    return (
        asking.join(open_lists.groupBy("token", *sides).agg(*span), ["token", "kin", "other"]).where(fits)
        .groupBy("z", "kin", "other").agg(*counted).where(F.col("lists") + beyond >= need("n")).select("z", "kin", "other", "component")
    )


def ngram_jaccard_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id): a row for each row of ``docs``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    buckets = partitions_for(spark, text_bytes_in(docs), BUCKET_BYTES)
    stats = materialize(set_stats(docs), "set-stats")
    sets = stats.where("kind = 0").select("doc_id", "n", "s1", "s2")
    # equal sets are one class, named by its smallest document
    classes = sets.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("last"))
    same = sets.join(classes.where("b <> last"), ["n", "s1", "s2"]).select(F.col("doc_id").alias("a"), "b").where("a <> b").distinct()
    same = materialize(same, "same")
    entries = materialize(list_entries(prefix_blocks(docs, shingle_counts(stats), buckets), buckets), "entries")
    # texts of the sets that have a possible partner, under the name of their class: they alone are joined by what follows
    met = entries.where("early").select("doc").distinct()
    named = met.join(same.select(F.col("a").alias("doc"), F.col("b").alias("rep")), "doc", "left").select(F.coalesce("rep", "doc").alias("doc_id")).distinct()
    docs = materialize(docs.select("doc_id", "text").join(named, "doc_id", "left_semi"), "texts")

    # first step: each set and the candidate that it shares most lists with
    shared = entries.where("head is not null").groupBy(F.col("doc").alias("a"), "head").agg(F.count(F.lit(1)).alias("lists"))
    for side in ("a", "head"):
        shared = shared.join(same.select(F.col("a").alias(side), F.col("b").alias("rep")), side, "left").withColumn(side, F.coalesce("rep", side)).drop("rep")
    best = shared.where("a <> head").groupBy("a").agg(F.max_by("head", F.struct("lists", -F.col("head"))).alias("head"))
    groups = components(same.union(verified_heads(best, docs)))
    linked = lambda: groups.select(F.col("node").alias("a"), F.col("component").alias("b"))

    # second step: within families, that is sets tied by candidates, sets outside the largest component against all others
    families = components(best.select("a", F.col("head").alias("b"))).select("node", F.col("component").alias("family"))
    groups = components(linked().union(links_in_families(families, groups, docs)))

    # third step: lists that hold sets of several components and families. Those of the smaller component ask the other family
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    # sets with a candidate have a family, whether a link was found or not
    everyone = groups.join(families.select("node"), "node", "full_outer").select(F.col("node").alias("doc"), F.coalesce("component", "node").alias("component"))
    known = everyone.join(sizes, "component", "left").join(same.select(F.col("a").alias("doc"), F.col("b").alias("rep")), "doc", "left")
    known = known.select("doc", F.coalesce("rep", "doc").alias("rep"), "component", "members").join(families.withColumnRenamed("node", "rep"), "rep", "left")
    named = entries.drop("head").join(met, "doc", "left_semi").join(known, "doc", "left").select(
        "token", "size", (F.col("size") - F.col("place")).alias("rest"), "early", F.coalesce("rep", "doc").alias("z"), F.coalesce("family", "rep", "doc").alias("family"),
        F.coalesce("component", "doc").alias("component"), F.coalesce("members", F.lit(1)).alias("members"),
    )
    split = named.groupBy("token").agg(*[f(c).alias(f"{c}_{n}") for c in ("component", "family") for f, n in ((F.min, "low"), (F.max, "high"))])
    split = split.where("component_low < component_high and family_low < family_high").select("token")
    open_lists = materialize(named.join(split, "token"), "open")
    asked = materialize(asks_of_lists(open_lists), "asked")
    if not asked.isEmpty():
        kin = asked.select(F.col("kin").alias("family"), F.col("other").alias("component")).distinct()
        told = families.select(F.col("node").alias("doc"), "family").join(groups.select(F.col("node").alias("doc"), "component"), "doc", "left")
        told = told.select("family", "doc", F.coalesce("component", "doc").alias("component"))
        # a set without candidates is a family of its own, named by itself
        alone = kin.join(families.select(F.col("node").alias("family")), "family", "left_anti").select("family", F.col("family").alias("doc"), "component")
        members = told.join(kin, ["family", "component"]).unionByName(alone).distinct()
        asks = asked.select(F.col("kin").alias("family"), F.col("z").alias("doc"), "component").distinct()
        groups = components(linked().union(links_by_blocks(asks, members.select("family", "doc", "component"), docs)))
    for table in (asked, open_lists, docs, entries, same):
        discard(table)
    return sets.join(groups, sets.doc_id == groups.node, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The documents whose doc_id is the smallest of their group; documents linked with nothing stay."""
    classes = ngram_jaccard_classes(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(classes, "doc_id", "left_anti")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_classes(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP8_SQL = """
WITH words AS (
  SELECT doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (
  WITH RECURSIVE r(doc_id, other) AS (
    SELECT a, b FROM links UNION SELECT r.doc_id, links.b FROM r JOIN links ON r.other = links.a)
  SELECT doc_id, min(other) AS least FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(sizes.n, 0) AS n_shingles, least(d.doc_id, coalesce(reach.least, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN reach USING (doc_id)
"""
