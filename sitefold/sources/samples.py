"""Which genotypes of a simulated site belong to which population: headers and command lines of simulation output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import file_key


def scrm_samples(command: str) -> list[int]:
    """Sample sizes from the -I and -eI arguments, population by population and by argument within each; zeros are no samples."""
    words = command.split()
    if not words or words[0] != "scrm":
        raise ValueError("not the command line of scrm")
    if "-transpose-segsites" not in words:
        raise ValueError("sites have to be transposed")
    at = words.index("-I") if "-I" in words else len(words)
    pops = int(words[at + 1]) if at + 1 < len(words) else 0  # -I tells how many sizes it has, and each -eI has as many after its time
    listed = [[int(n) for n in words[i + 2 : i + 2 + pops]] for i, word in enumerate(words) if word in ("-I", "-eI")]
    if any(len(sizes) != pops for sizes in listed):
        raise ValueError("an option without a size for each population")
    sizes = [[n for n in mine if n > 0] for mine in zip(*listed, strict=True)]
    found = [n for mine in sizes for n in mine]
    if not found:
        raise ValueError("no samples")
    return found


def ms_samples(command: str) -> list[tuple[int, float, int]]:
    """(population, age, size) of the samples of an ms command line, in the order of its haplotypes: those of -I have age 0, those
    of -eA theirs; younger ones first, then as they are listed; samples of one population and age are one; zeros are none."""
    words, found = command.split(), {}
    for i, word in enumerate(words):
        if word == "-I":
            for k in range(int(words[i + 1])):
                found[k + 1, 0.0] = found.get((k + 1, 0.0), 0) + int(words[i + 2 + k])
        elif word == "-eA":
            key = int(words[i + 2]), float(words[i + 1])
            found[key] = found.get(key, 0) + int(words[i + 3])
    return sorted(((pop, age, n) for (pop, age), n in found.items() if n), key=lambda s: s[1])


def output_order(arguments: list[str]) -> tuple[list[str], list[int]]:
    """The labels of arguments ``label`` or ``label:index``, and which of them is printed in each place: its index, or its own place
    without one. The indexes have to be a permutation of 0..n-1."""
    labels, order = [], []
    for place, argument in enumerate(arguments):
        label, colon, index = argument.rpartition(":") if ":" in argument else (argument, "", "")
        labels.append(label)
        order.append(int(index) if colon else place)
    if sorted(order) != list(range(len(arguments))):
        raise ValueError("indexes are no permutation")
    return labels, order


def label_order(arguments: list[str]) -> list[str]:
    """Labels in the order in which they are printed."""
    labels, order = output_order(arguments)
    return [labels[k] for k in order]


#: A header is within the first lines of its file, which are numbered from 0.
MOST_HEADER = 100


def sim_samples(lines: DataFrame) -> dict[str, int]:
    """Population labels and sample sizes from the headers of simulation files, which all have to be the same. A header names
    the number of populations, and each of them after a line ``pop sampsize``. Only the first ``MOST_HEADER`` lines of a file are looked
    at; headers are gathered by file and compared on the executors, and at most two kinds of them reach the driver."""
    keys = file_key(lines)
    head = lines.where((F.col("line_no") < MOST_HEADER) & ~F.col("value").rlike(r"^\s*(\d|$)"))
    told = head.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line_no", F.trim("value").alias("value")))).alias("h"))  # MOST_HEADER a file
    kinds = told.select(F.transform("h", lambda x: x["value"]).alias("h"))
    npops = F.filter("h", lambda v: v.rlike(r"^npops\s*=\s*\d+$"))
    pops = F.filter("h", lambda v: v.rlike(r"^[A-Za-z_]\S*\s+\d+$"))
    one = kinds.select(F.element_at(npops, -1).alias("npops"), F.transform(pops, lambda v: F.regexp_replace(v, r"\s+", " ")).alias("pops")).distinct().limit(2).collect()
    n = int(one[0]["npops"].rpartition("=")[2]) if len(one) == 1 and one[0]["npops"] else 0
    if n <= 0 or n != len(one[0]["pops"]):
        raise ValueError("bad or unlike headers of simulation files")
    return {label: int(size) for label, size in (p.split(" ") for p in one[0]["pops"])}


def sim_sites(lines: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """chr, pos and g (and file) of simulation files: positions in files that tell numbers of chromosomes, none in others. Another
    number of fields, or a genotype other than 0 and 1, is an error."""
    keys = file_key(lines)
    second = lines.where(F.col("value").rlike(r"^\s*nchromosomes\s*=")).select(*keys, F.lit(1).alias("_with_pos")).distinct()
    rows = lines.where(F.col("value").rlike(r"^\s*\d"))
    rows = rows.join(second, keys, "left") if keys else rows.join(F.broadcast(second.agg(F.max("_with_pos").alias("_with_pos"))))  # one row
    f, skip = F.split(F.trim("value"), r"\s+"), F.coalesce("_with_pos", F.lit(0)) + 1
    g = F.slice(f, skip + 1, F.greatest(F.size(f) - skip, F.lit(0)))
    bad = (F.size(g) != sum(sizes.values())) | (F.size(F.array_except(g, F.array(F.lit("0"), F.lit("1")))) > 0)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("bad line: "), "value")).cast("array<int>")).otherwise(g.cast("array<int>"))
    return rows.select(*keys, f[0].cast("long").alias("chr"), F.when(skip == 2, F.get(f, F.lit(1)).try_cast("double")).alias("pos"), checked.alias("g"))


#: Genotypes of a population that are added up term by term, which Spark compiles; it walks through arrays otherwise.
FEW = 16


def frequency_columns(sites: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """``sites`` with a column of frequencies for each population instead of ``g``; consecutive genotypes belong to one."""
    out, at = [], 1
    for pop, n in sizes.items():
        total = F.aggregate(F.slice("g", at, n), F.lit(0), lambda a, x: a + x)
        if 0 < n <= FEW:
            terms = reduce(lambda a, b: a + b, [F.get("g", F.lit(at - 1 + k)) for k in range(n)])
            total = F.when(F.size("g") >= at - 1 + n, terms).otherwise(total)
        out.append((total / float(n)).alias(pop))
        at += n
    return sites.select(*[c for c in sites.columns if c != "g"], *out)
