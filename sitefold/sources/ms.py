"""Output of the simulator ms as simulation text: haplotypes by replicate become lines by site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .samples import MOST_HEADER, ms_samples, output_order
from .text import file_key, running_count
from .transpose import SAMPLES, transposed


def command_lines(lines: DataFrame) -> DataFrame:
    """The command line of each file, which is among its first lines."""
    return lines.where((F.col("line_no") < MOST_HEADER) & F.col("value").rlike(r"^ms\s"))


def command_samples(lines: DataFrame) -> list[tuple[int, float, int]]:
    """(population, age, size) by the command lines of all files, which have to sample alike; only the options that tell
    samples reach the driver, once."""
    options = F.concat_ws(" ", F.regexp_extract_all("value", F.lit(r"(-I(?:\s+\d+)+|-eA(?:\s+\S+){3})"), F.lit(1)))
    told = command_lines(lines).select(options.alias("o")).distinct().limit(2).collect()
    if len(told) != 1:
        raise ValueError("no command line of ms, or files that sample differently")
    found = ms_samples(f"ms {told[0]['o']}")
    if not found:
        raise ValueError("no samples")
    return found


def haplotypes(lines: DataFrame, n: int) -> DataFrame:
    """rep, sample (from 0) and value (and file) of each haplotype. A replicate without its numbers of sites and of ``n`` haplotypes,
    or with a haplotype of another length, is an error."""
    keys = file_key(lines)
    told = running_count(lines, F.col("value").startswith("segsites:"), "_block").where("_block > 0")
    is_hap, begins = F.col("value").rlike(r"^[01]+\s*$"), F.col("value").startswith("segsites:")
    replicate = Window.partitionBy(*keys, "_block")  # as many lines as there are haplotypes, and some more
    sites = F.max(F.when(begins, F.trim(F.substring("value", 10, 20)).try_cast("int"))).over(replicate)
    at = F.min(F.when(F.col("value").startswith("positions:"), F.col("line_no"))).over(replicate)
    rows = told.withColumns({"_hap": is_hap, "_sites": sites, "_at": at, "_n": F.count_if(is_hap).over(replicate)})
    fault = (
        F.when(F.col("_sites").isNull() | (F.col("_sites") <= 0), F.lit("illegal number of sites")).when(F.col("_at").isNull(), F.lit("positions not found"))
        .when(F.col("_n") != n, F.lit("another number of haplotypes than the command tells"))
    )
    # a faulty replicate without a haplotype is told by its first line
    rows = rows.withColumn("_fault", fault).where(F.col("_hap") | (begins & F.col("_fault").isNotNull()))
    fault = F.coalesce("_fault", F.when(F.length(F.trim("value")) != F.col("_sites"), F.lit("a haplotype of another length")))
    rep = F.col("_block") - 1
    checked = F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit("replicate "), rep.cast("string"), F.lit(": "), fault)).cast("string")).otherwise(F.trim("value"))
    return rows.select(*keys, rep.alias("rep"), (F.col("line_no") - F.col("_at") - 1).alias("sample"), checked.alias("value"))


def sim_lines(lines: DataFrame, arguments: list[str], genotypes: bool = True) -> DataFrame:
    """line_no and value (and file): a header, and a line a site, of all replicates of ms output. ``arguments`` are labels in the order
    of the samples (by age, then as listed), each with ``:index`` of the sample that is printed in its place. Lines hold genotypes, as
    readers of simulation files take them, or the frequency of each sample. Lines in order of ``line_no`` are the file."""
    keys = file_key(lines)
    sizes = [n for *_, n in command_samples(lines)]
    labels, order = output_order(arguments)
    if len(labels) != len(sizes):
        raise ValueError(f"{len(labels)} labels for {len(sizes)} samples")
    rows = transposed(haplotypes(lines, sum(sizes)), [*keys, "rep"], one_block=sum(sizes) <= SAMPLES)

    def told(k: int) -> Column:
        part = F.substring("alleles", sum(sizes[:k]) + 1, sizes[k])
        if genotypes:
            return F.array_join(F.split(part, ""), " ")
        return F.format_string("%f", F.length(F.replace(part, F.lit("0"), F.lit(""))) / float(sizes[k]))

    # replicates follow each other, sites within them
    body = rows.select(*keys, ((F.col("rep") + 1) * (1 << 32) + F.col("site")).alias("line_no"), F.concat_ws(" ", F.col("rep").cast("string"), *[told(k) for k in order]).alias("value"))
    head = [f"npops = {len(labels)}", "pop sampsize", *[f"{labels[k]} {sizes[k]}" for k in order]]
    texts = F.posexplode(F.array(*map(F.lit, head))).alias("line_no", "value")
    heads = command_lines(lines).select(*keys).distinct().select(*keys, texts) if keys else lines.sparkSession.range(1).select(texts)
    return heads.withColumn("line_no", F.col("line_no").cast("long")).unionByName(body)
