"""Readers of population-genetic text formats. Each takes lines (line_no, value), so a table of lines serves as a file
does; ``read_lines`` gets them from files, gzipped or not. Where lines come with a column ``file``, each file is read by
itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .transpose import transposed


def read_lines(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """file, line_no and value. Large files are read in splits; for ordered reading lines are numbered within each split,
    and only counts of splits are summed up within a file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), "value")
    if not ordered:
        return lines.select("file", F.lit(None).cast("long").alias("line_no"), "value")
    # ids rise within a split, which one task reads
    lines = lines.withColumn("_id", F.monotonically_increasing_id())
    place = F.row_number().over(Window.partitionBy("file", "_split").orderBy("_id")) - 1
    before = lines.groupBy("file", "_split").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("file", "_split", (F.sum("_n").over(Window.partitionBy("file").orderBy("_split")) - F.col("_n")).alias("_before"))
    return lines.withColumn("_place", place).join(before, ["file", "_split"]).select("file", (F.col("_before") + F.col("_place")).alias("line_no"), "value")


def file_key(lines: DataFrame) -> list[str]:
    """What lines of several files are kept apart by."""
    return [c for c in lines.columns if c == "file"]


def running_count(lines: DataFrame, mark: Column, name: str, width: int = 4096) -> DataFrame:
    """``lines`` with ``name``: how many lines of their file up to and including each have ``mark``. Lines are counted within
    ranges of ``width`` line numbers, and only counts of ranges are summed up within a file."""
    keys = file_key(lines)
    told = lines.withColumn("_mark", mark.cast("long")).withColumn("_bin", F.coalesce(F.floor(F.col("line_no") / width), F.lit(-1)))
    whole = Window.partitionBy(*keys).orderBy("_bin")
    before = told.groupBy(*keys, "_bin").agg(F.sum("_mark").alias("_in")).withColumn("_before", F.sum("_in").over(whole) - F.col("_in")).drop("_in")
    within = F.sum("_mark").over(Window.partitionBy(*keys, "_bin").orderBy("line_no"))
    return told.withColumn("_within", within).join(before, [*keys, "_bin"]).withColumn(name, F.col("_before") + F.col("_within")).drop("_mark", "_bin", "_within", "_before")


def with_previous(rows: DataFrame, keys: list[str], at: str, columns: list[str], width: int) -> DataFrame:
    """``rows`` with ``_before``, a struct of ``columns`` of the row before by ``at`` within ``keys``. Rows are put in order within
    segments of ``width``; of each segment only its last row meets those of the other segments."""
    told = rows.withColumn("_segment", F.coalesce(F.floor(F.col(at) / width), F.lit(-1)))
    value = F.struct(*columns)
    last = told.groupBy(*keys, "_segment").agg(F.max_by(value, at).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_segment")
    borders = last.select(*keys, "_segment", F.lag("_last").over(across).alias("_border"))
    within = Window.partitionBy(*keys, "_segment").orderBy(at)
    both = told.withColumn("_within", F.lag(value).over(within)).join(borders, [*keys, "_segment"])
    return both.withColumn("_before", F.coalesce("_within", "_border")).drop("_segment", "_within", "_border")


def not_comment(value: Column) -> Column:
    return ~value.rlike(r"^\s*#") & value.rlike(r"\S")


def _fields(value: Column, separator: str) -> Column:
    return F.filter(F.transform(F.split(value, separator), lambda x: F.trim(x)), lambda x: x != "")


def read_raf(lines: DataFrame) -> DataFrame:
    """chr, pos, ref, alt, raf and status (OK, BAD_RAF_INPUT, EINVAL, ERANGE). Tabs separate five fields; alleles of more
    than one letter are left out."""
    f = F.col("_f")
    parsed = lines.where(not_comment(F.col("value"))).withColumn("_f", _fields(F.col("value"), "\t")).withColumn("_n", F.size("_f"))
    raf = F.get(f, F.lit(4)).try_cast("double")
    zero = F.get(f, F.lit(4)).rlike("[1-9].*[eE]") & (raf == 0)
    status = F.when(F.col("_n") != 5, F.lit("BAD_RAF_INPUT")).when(raf.isNull(), F.lit("EINVAL")).when((raf == float("inf")) | zero, F.lit("ERANGE")).otherwise(F.lit("OK"))
    kept = [c for c in lines.columns if c != "value"]
    out = parsed.select(*kept, F.get(f, F.lit(0)).alias("chr"), F.get(f, F.lit(1)).try_cast("long").alias("pos"), F.lower(F.get(f, F.lit(2))).alias("ref"), F.lower(F.get(f, F.lit(3))).alias("alt"), raf.alias("raf"), status.alias("status"))
    return out.where((F.col("status") == "BAD_RAF_INPUT") | ((F.length("ref") == 1) & (F.length("alt") == 1)))


def read_daf(lines: DataFrame, status: bool = False) -> DataFrame:
    """chr, pos, aa, da, daf; spaces or tabs separate the fields. With ``status`` (OK, BAD_DAF_INPUT for another number of fields,
    EINVAL, ERANGE) every line that is not a comment has a row; without, lines of another number of fields have none."""
    f = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    kept = [c for c in lines.columns if c != "value"]
    rows = lines.where(not_comment(F.col("value"))).withColumn("_n", F.size(f))
    daf = F.get(f, F.lit(4)).try_cast("double")
    told = F.when(F.col("_n") != 5, F.lit("BAD_DAF_INPUT")).when(daf.isNull() | F.get(f, F.lit(1)).try_cast("long").isNull(), F.lit("EINVAL"))
    told = told.when((F.abs(daf) == float("inf")) | (F.get(f, F.lit(4)).rlike("[1-9].*[eE]") & (daf == 0)), F.lit("ERANGE")).otherwise(F.lit("OK"))
    fields = [F.get(f, F.lit(0)).alias("chr"), F.get(f, F.lit(1)).try_cast("long").alias("pos"), F.lower(F.get(f, F.lit(2))).alias("aa"), F.lower(F.get(f, F.lit(3))).alias("da"), daf.alias("daf")]
    return rows.select(*kept, *fields, told.alias("status")) if status else rows.where("_n = 5").select(*kept, *fields)


def out_of_order(rows: DataFrame, width: int = 1 << 14) -> DataFrame:
    """Rows whose position does not follow the one before in their file (strict order by chr, pos). A file is looked at in segments
    of ``width`` line numbers."""
    was = with_previous(rows, ["file"], "line_no", ["chr", "pos"], width)
    chr_, pos = F.col("_before.chr"), F.col("_before.pos")
    return was.where((F.col("chr") < chr_) | ((F.col("chr") == chr_) & (F.col("pos") <= pos))).drop("_before")


def _genotypes(value: Column, first: int) -> Column:
    parts = F.split(value, "\t")
    return F.slice(parts, first + 1, F.greatest(F.size(parts) - first, F.lit(0)))


def _counts(genotypes: Column, allele: str) -> tuple[Column, Column, Column]:
    """Copies of an allele, called alleles, and whether a genotype is malformed."""
    text = F.array_join(F.transform(genotypes, lambda g: F.concat(F.substring(g, 1, 1), F.substring(g, 3, 1))), "")
    bad = F.exists(genotypes, lambda g: ~g.rlike(r"^[.01].[.01]$"))
    return F.length(F.translate(text, {"0": "1.", "1": "0."}[allele], "")), F.length(F.translate(text, ".", "")), bad


def genotype_raf(lines: DataFrame) -> DataFrame:
    """Rows chr, pos, ref, alt, genotypes... to chr, pos, ref, alt, raf and reject (null: a good row)."""
    p = F.split("value", "\t")
    ref, alt = (F.translate(F.lower(p[i]), "-", ".") for i in (2, 3))
    zeros, called, bad = _counts(_genotypes(F.col("value"), 4), "0")
    reject = (
        F.when(ref.contains(","), F.lit("multref")).when(alt.contains(","), F.lit("multalt"))
        .when(F.length(ref) != 1, F.lit("indelref")).when(F.length(alt) != 1, F.lit("indelalt"))
        .when(ref == ".", F.lit("missref")).when(bad, F.lit("badgtype")).when(called == 0, F.lit("zerogtype"))
    )
    return lines.where(not_comment(F.col("value"))).select(p[0].alias("chr"), p[1].cast("long").alias("pos"), ref.alias("ref"), alt.alias("alt"), F.try_divide(zeros.cast("double"), called).alias("raf"), reject.alias("reject"))


def genotype_daf(lines: DataFrame) -> DataFrame:
    """Rows chr, pos, ref, alt, aa, genotypes... to chr, pos, aa, da, daf and reject."""
    p = F.split("value", "\t")
    ref, raw_alt, aa = (F.translate(F.lower(p[i]), "-", ".") for i in (2, 3, 4))
    alt = F.when((raw_alt == ".") & (aa != ref), aa).otherwise(raw_alt)
    zeros, called, bad = _counts(_genotypes(F.col("value"), 5), "0")
    ones, _, _ = _counts(_genotypes(F.col("value"), 5), "1")
    reject = (
        F.when(ref.contains(","), F.lit("multref")).when(raw_alt.contains(","), F.lit("multalt")).when(aa.contains("|"), F.lit("multaa"))
        .when(F.length(ref) != 1, F.lit("indelref")).when(F.length(raw_alt) != 1, F.lit("indelalt")).when(F.length(aa) != 1, F.lit("indelaa"))
        .when(ref == ".", F.lit("missref")).when(aa == ".", F.lit("missaa")).when((aa != ref) & (aa != alt), F.lit("threealleles"))
        .when(bad, F.lit("badgtype")).when(called == 0, F.lit("zerogtype"))
    )
    daf = F.try_divide(F.when(aa == ref, ones).otherwise(zeros).cast("double"), called)
    return lines.where(not_comment(F.col("value"))).select(p[0].alias("chr"), p[1].cast("long").alias("pos"), aa.alias("aa"), F.when(aa == ref, alt).otherwise(ref).alias("da"), daf.alias("daf"), reject.alias("reject"))


def reject_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("reject", F.lit("good")).alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))


def genotype_counters(lines: DataFrame) -> DataFrame:
    """reason, n_rows of rows chr, pos, ref, alt, aa, genotypes...: of the first group of checks that a row fails (numbers of
    alleles, lengths, missing alleles) every counter that applies goes up; ``bad`` goes up once a row."""
    p = F.split("value", "\t")
    ref, alt, aa = (F.translate(F.lower(p[i]), "-", ".") for i in (2, 3, 4))
    _, called, odd = _counts(_genotypes(F.col("value"), 5), "0")
    name = lambda test, word: F.when(test, F.lit(word))
    many = F.array_compact(F.array(name(ref.contains(","), "multref"), name(alt.contains(","), "multalt"), name(aa.contains("|"), "multaa")))
    longer = F.array_compact(F.array(name(F.length(ref) != 1, "indelref"), name(F.length(alt) != 1, "indelalt"), name(F.length(aa) != 1, "indelaa")))
    missing = F.array_compact(F.array(name(ref == ".", "missref"), name(aa == ".", "missaa")))
    other = F.array(F.when((aa != ref) & (aa != F.when(alt == ".", aa).otherwise(alt)), F.lit("threealleles")).when(odd, F.lit("badgtype")).when(called == 0, F.lit("zerogtype")))
    reasons = F.when(F.size(many) > 0, many).when(F.size(longer) > 0, longer).when(F.size(missing) > 0, missing).otherwise(F.array_compact(other))
    told = lines.where(not_comment(F.col("value"))).select(reasons.alias("_r"))
    counted = F.when(F.size("_r") > 0, F.concat("_r", F.array(F.lit("bad")))).otherwise(F.array(F.lit("good")))
    return told.select(F.explode(counted).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"))


def axt_records(lines: DataFrame) -> DataFrame:
    """rec, chr, start, end, score, a, b (and file) from lines (line_no, value) of three-line records. Sequences of unlike
    length, or with other numbers of bases than the header says, are an error."""
    keys = file_key(lines)
    full = running_count(lines.where(not_comment(F.col("value"))), F.lit(True), "_n").withColumn("_n", F.col("_n") - 1)
    parts = full.select(*keys, F.floor(F.col("_n") / 3).alias("rec"), (F.col("_n") % 3).alias("part"), "value")
    wide = parts.groupBy(*keys, "rec").agg(*[F.max(F.when(F.col("part") == i, F.trim("value"))).alias(x) for i, x in enumerate(("head", "a", "b"))])
    h = F.split("head", r"\s+")
    bases = lambda c: F.length(F.replace(F.col(c), F.lit("-"), F.lit("")))
    spans = lambda i: h[i + 1].cast("long") - h[i].cast("long") + 1
    fault = F.when(F.length("a") != F.length("b"), F.lit("sequences of unlike length")).when((bases("a") != spans(2)) | (bases("b") != spans(5)), F.lit("other numbers of bases than the header says"))
    checked = F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit("alignment "), h[0], F.lit(": "), fault)).cast("string")).otherwise(F.lower("a"))
    whole = wide.where("a is not null and b is not null")
    return whole.select(*keys, "rec", h[1].alias("chr"), h[2].cast("long").alias("start"), h[3].cast("long").alias("end"), h[8].cast("long").alias("score"), checked.alias("a"), F.lower("b").alias("b"))


def axt_bases(records: DataFrame, min_length: int = 1, min_score: int = 0) -> DataFrame:
    """rec, start, chr, pos, ref, alt, raf (and file): bases of A that are not gaps, against B. Bases are numbered within their
    record's array, so nothing is shuffled."""
    keys = file_key(records)
    good = records.where((F.length("a") == F.length("b")) & (F.col("end") - F.col("start") + 1 >= min_length) & (F.col("score") >= min_score))
    pairs = F.filter(F.arrays_zip(F.split("a", "").alias("x"), F.split("b", "").alias("y")), lambda p: p["x"] != "-")
    each = good.select(*keys, "rec", "chr", "start", "end", F.posexplode(pairs).alias("j", "p"))
    same = F.col("p.x") == F.col("p.y")
    rows = each.select(*keys, "rec", "start", "end", "chr", (F.col("start") + F.col("j")).alias("pos"), F.col("p.x").alias("ref"), F.when(same, F.lit(".")).otherwise(F.col("p.y")).alias("alt"), same.cast("double").alias("raf"))
    return rows.where("ref <> 'n' and alt not in ('-', 'n')")


def with_reach(spans: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``spans`` (``keys``, start, end, rec) with ``_reach``, the largest end of all spans before each in order of (start, rec): the
    largest within its range of ``width`` starts, or of the ranges before, of which each tells one number."""
    told = spans.withColumn("_range", F.floor(F.col("start") / width))
    tops = told.groupBy(*keys, "_range").agg(F.max("end").alias("_top"))
    ranges = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = tops.select(*keys, "_range", F.max("_top").over(ranges).alias("_earlier"))
    within = Window.partitionBy(*keys, "_range").orderBy("start", "rec").rowsBetween(Window.unboundedPreceding, -1)
    both = told.withColumn("_own", F.max("end").over(within)).join(before, [*keys, "_range"])
    return both.withColumn("_reach", F.greatest("_own", "_earlier")).drop("_range", "_own", "_earlier")


def axt_merged(bases: DataFrame, width: int = 1 << 12) -> DataFrame:
    """One row a position (of a file): of overlapping records the one that starts last, unless it is nested in an earlier one."""
    keys = file_key(bases)
    spans = bases.select(*keys, "rec", "chr", "start", "end").distinct()
    outer = with_reach(spans, [*keys, "chr"], width).where("_reach is null or end > _reach").select(*keys, "rec")
    best = bases.join(outer, [*keys, "rec"]).groupBy(*keys, "chr", "pos").agg(F.max_by(F.struct("ref", "alt", "raf"), "start").alias("r"))
    return best.select(*keys, "chr", "pos", "r.ref", "r.alt", "r.raf")


def sim_frequencies(rows: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """chr and genotypes ``g`` (array of 0 and 1) to pop, frequency: consecutive genotypes belong to one population."""
    out, at = [], 1
    for pop, n in sizes.items():
        total = F.aggregate(F.slice("g", at, n), F.lit(0), lambda a, x: a + x)
        out.append(F.struct(F.lit(pop).alias("pop"), (total / float(n)).alias("daf")))
        at += n
    return rows.select(*[c for c in rows.columns if c != "g"], F.inline(F.array(*out)))


def scrm_sites(lines: DataFrame) -> DataFrame:
    """rep, idx, g (and file) from the transposed segregating sites of blocks that begin with a ``position`` line."""
    keys = file_key(lines)
    numbered = running_count(lines, F.col("value").startswith("position"), "_block").withColumn("rep", F.col("_block") - 1)
    rows = numbered.where((F.col("rep") >= 0) & F.col("value").rlike(r"^[0-9.eE+-]+\s+[0-9.eE+-]+\s+[01]"))
    f = F.split(F.trim("value"), r"\s+")
    idx = F.row_number().over(Window.partitionBy(*keys, "rep").orderBy("line_no")) - 1
    return rows.select(*keys, "rep", idx.cast("long").alias("idx"), F.slice(f, 3, F.size(f)).cast("array<int>").alias("g"))


def ms_transposed(rows: DataFrame) -> DataFrame:
    """rep, sample and ``value`` (a string of 0 and 1, one a site) to rep, site and the alleles of all samples in order."""
    return transposed(rows, ["rep"])


def pattern_rows(lines: DataFrame) -> DataFrame:
    """label and value of a pattern file: two columns, ``#`` begins a comment."""
    text = F.trim(F.regexp_replace("value", "#.*", ""))
    f = F.split(text, r"\s+")
    return lines.withColumn("_t", text).where("_t <> ''").select(*[c for c in lines.columns if c != "value"], f[0].alias("label"), f[1].cast("double").alias("value"))


def pattern_section(lines: DataFrame) -> DataFrame:
    """label and value of the rows after a ``# SitePat`` line, in any file that holds such a table."""
    keys = [c for c in lines.columns if c == "file"]
    head = lines.where(F.col("value").rlike(r"^\s*#\s*SitePat")).groupBy(*keys).agg(F.min("line_no").alias("_from"))
    rows = (lines.join(head, keys) if keys else lines.join(F.broadcast(head))).where("line_no > _from")  # one row a file
    return pattern_rows(rows.drop("_from"))


def fitted_parameters(lines: DataFrame, free_only: bool = False) -> DataFrame:
    """name, value, is_free of ``name = value`` lines after the line that begins with Fitted."""
    keys = [c for c in lines.columns if c == "file"]
    first = lambda word: F.min(F.when(F.col("value").startswith(word), F.col("line_no")))
    cut = lines.groupBy(*keys).agg(first("Fitted").alias("_fit"), first("# SitePat").alias("_end"))
    bounds = lines.join(cut, keys) if keys else lines.join(F.broadcast(cut))  # one row a file
    after = bounds.where("line_no > _fit and (_end is null or line_no < _end)")
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("line_no")
    constrained = F.max(F.col("value").startswith("Constrained").cast("int")).over(order)
    rows = after.withColumn("is_free", constrained == 0).where(F.col("value").rlike(r"^\s*\w[\w.]*\s*=\s*\S"))
    out = rows.select(*[c for c in lines.columns if c != "value"], F.trim(F.split("value", "=")[0]).alias("name"), F.trim(F.split("value", "=")[1]).cast("double").alias("value"), "is_free")
    return out.where("is_free") if free_only else out


def second_sightings(lines: DataFrame) -> DataFrame:
    """name and value of each parameter's second ``name = value`` line: its estimate after the initial value."""
    keys = [c for c in lines.columns if c == "file"]
    rows = lines.where(F.col("value").contains("=")).withColumns({"name": F.trim(F.split("value", "=")[0]), "_v": F.trim(F.split("value", "=")[1])})
    nth = F.row_number().over(Window.partitionBy(*keys, "name").orderBy("line_no"))
    value = F.when(F.col("_v").startswith("Gaussian"), F.lit(1.0)).otherwise(F.col("_v").try_cast("double"))
    return rows.withColumn("_n", nth).where("_n = 2").select(*keys, "name", value.alias("value"))


def flat_rows(lines: DataFrame, width: int = 4096) -> DataFrame:
    """row, name, value (and file) of a matrix with a header of names; ``#`` begins a comment."""
    keys = file_key(lines)
    told = lines.withColumn("_t", F.trim(F.regexp_replace("value", "#.*", ""))).where("_t <> ''")
    nth = running_count(told, F.lit(True), "_n", width).withColumn("_n", F.col("_n") - 1).withColumn("_f", F.split("_t", r"\s+"))
    head = nth.where("_n = 0").select(*keys, F.col("_f").alias("_names"))
    rows = nth.where("_n > 0")
    both = rows.join(head, keys) if keys else rows.join(F.broadcast(head))  # one row
    each = both.select(*keys, (F.col("_n") - 1).cast("long").alias("row"), F.explode(F.arrays_zip(F.col("_names").alias("name"), F.col("_f").alias("value"))).alias("p"))
    return each.select(*keys, "row", "p.name", F.col("p.value").cast("double").alias("value"))


#: The format that the first line of a state file names if a line with names follows (a fixed value of the format).
STATE_FORMAT = "format-2"


def state_points(lines: DataFrame, model: list[str] | None = None) -> DataFrame:
    """pt, cost, name, value (and file) of state files. Their first line tells the numbers of points and parameters; if it also
    names a format, a line with ``cost`` and the parameters' names follows, else the names are those of the ``model`` (p0, p1, ...
    without one). Another number of points or of values in a row than announced is an error; with a ``model``, so are another format, and other names or numbers
    of parameters than the model's."""
    keys = file_key(lines)
    nth = running_count(lines.where(F.col("value").rlike(r"\S")), F.lit(True), "_n").withColumn("_f", F.split(F.trim("value"), r"\s+"))
    head = nth.groupBy(*keys).agg(F.max(F.when(F.col("_n") == 1, F.col("_f"))).alias("_h"), F.max(F.when(F.col("_n") == 2, F.col("_f"))).alias("_names"), F.max("_n").alias("_last"))
    npar, fresh = F.col("_h")[1].cast("int"), F.size("_h") > 2
    known = None if model is None else F.array(*map(F.lit, model))
    unnamed = F.transform(F.sequence(F.lit(0), npar - 1), lambda i: F.concat(F.lit("p"), i.cast("string"))) if model is None else known
    names = F.when(fresh, F.slice("_names", 2, F.greatest(npar, F.lit(1)))).otherwise(unnamed)
    if model is not None:
        odd = fresh & ((F.size("_h") > 3) | ~F.get("_h", F.lit(2)).eqNullSafe(F.lit(STATE_FORMAT)) | ~F.get("_names", F.lit(0)).eqNullSafe(F.lit("cost")))
        fault = F.when(odd, F.lit("state file of another format")).when((npar != len(model)) | ~names.eqNullSafe(known), F.lit("state file with other parameters than the model's"))
        names = F.when(fault.isNotNull(), F.raise_error(fault).cast("array<string>")).otherwise(names)
    told = head.select(*keys, names.alias("_p"), F.when(fresh, F.lit(2)).otherwise(F.lit(1)).alias("_skip"), F.col("_h")[0].cast("long").alias("_pts"), npar.alias("_npar"), "_last")
    rows = (nth.join(told, keys) if keys else nth.join(F.broadcast(told))).where("_n > _skip")  # one row a file
    bad = (F.size("_f") != F.col("_npar") + 1) | (F.col("_last") - F.col("_skip") != F.col("_pts"))
    cost = F.when(bad, F.raise_error(F.lit("state file with other numbers than announced")).cast("double")).otherwise(F.col("_f")[0].cast("double"))
    values = F.arrays_zip(F.col("_p").alias("name"), F.slice("_f", 2, F.size("_f")).alias("value"))
    each = rows.select(*keys, (F.col("_n") - F.col("_skip") - 1).alias("pt"), cost.alias("cost"), F.explode(values).alias("v"))
    return each.select(*keys, "pt", "cost", "v.name", F.col("v.value").cast("double").alias("value"))


def merged_states(points: DataFrame, n: int) -> DataFrame:
    """``n`` points of several swarms: the best of each file in turn. points: file, pt, cost, params."""
    nth = Window.partitionBy("file").orderBy("cost", "pt")
    return points.withColumn("_n", F.row_number().over(nth)).orderBy("_n", "file").limit(n).drop("_n")
