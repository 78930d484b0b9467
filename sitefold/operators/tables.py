"""Algebra of pattern tables: rows (table, label or pat, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitefold.functions.patterns import collapse_map, label_mask, pattern_label, remap, removal_map


def normalised(table: DataFrame, by: list[str] | None = None, value: str = "value") -> DataFrame:
    """Values as shares of their sum; null where the sum is 0."""
    total = F.sum(value).over(Window.partitionBy(*by)) if by else F.sum(value).over(Window.partitionBy(F.lit(0)))
    return table.withColumn(value, F.try_divide(F.col(value), total))


def combined(a: DataFrame, b: DataFrame, sign: int = 1, by: list[str] | None = None) -> DataFrame:
    """pat and the sum or difference of two tables (of each ``by``); a missing pattern is 0."""
    keys = [*(by or []), "pat"]
    both = a.select(*keys, "value").union(b.select(*keys, (sign * F.col("value")).alias("value")))
    return both.groupBy(*keys).agg(F.sum("value").alias("value"))


def without_populations(table: DataFrame, k: int, removed: set[int], by: list[str] | None = None) -> DataFrame:
    """Values of patterns that become equal are summed; those that become empty go."""
    new = remap(F.col("pat"), removal_map(k, removed))
    return table.withColumn("pat", new).where("pat <> 0").groupBy(*(by or []), "pat").agg(F.sum("value").alias("value"))


def with_collapsed(table: DataFrame, k: int, collapsed: set[int], by: list[str] | None = None) -> DataFrame:
    new = remap(F.col("pat"), collapse_map(k, collapsed))
    return table.withColumn("pat", new).groupBy(*(by or []), "pat").agg(F.sum("value").alias("value"))


def residuals(observed: DataFrame, fitted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """pat, observed, fitted and residual shares (of each ``by``). Tables of unlike patterns are an error."""
    keys = [*(by or []), "pat"]
    a = normalised(observed, by).select(*keys, F.col("value").alias("observed"))
    b = normalised(fitted, by).select(*keys, F.col("value").alias("fitted"), F.lit(True).alias("_held"))
    both = a.withColumn("_seen", F.lit(True)).join(b, keys, "full")
    lone = F.col("_held").isNull() | F.col("_seen").isNull()
    checked = F.when(lone, F.raise_error(F.concat(F.lit("pattern of one table only: "), F.col("pat").cast("string"))).cast("double")).otherwise(F.col("observed"))
    return both.select(*keys, checked.alias("observed"), "fitted").withColumn("residual", F.col("observed") - F.col("fitted"))


def residual_matrix(observed: DataFrame, fitted: DataFrame | None, k: int, removed: set[int] = frozenset(), collapsed: list[set[int]] = ()) -> DataFrame:
    """file, pat and value: shares, or residuals where there are fitted tables, of every file after populations are removed and
    then sets of those that are left collapsed one after the other. The pattern of all ``k`` populations is left out, unless
    there are fewer now."""

    def reduced(table: DataFrame) -> DataFrame:
        out, n = normalised(table, ["file"]), k
        if removed:
            out, n = without_populations(out, n, removed, ["file"]), n - len(removed)
        for some in collapsed:
            out, n = with_collapsed(out, n, some, ["file"]), n - len(some) + 1
        return normalised(out, ["file"])

    if fitted is None:
        rows = reduced(observed).select("file", "pat", "value")
    else:
        rows = residuals(reduced(observed), reduced(fitted), ["file"]).select("file", "pat", F.col("residual").alias("value"))
    return rows.where(F.col("pat") != (1 << k) - 1)


def divergence(p: DataFrame, q: DataFrame, threshold: float = 0.01, by: list[str] | None = None) -> DataFrame:
    """pat, p, q, kl = p ln(p / q) of shares, and whether it stands out. 0 ln 0 is 0; q = 0 < p gives infinity."""
    both = residuals(p, q, by).select(*(by or []), "pat", F.col("observed").alias("p"), F.col("fitted").alias("q"))
    kl = F.when(F.col("p") == 0, F.lit(0.0)).when(F.col("q") == 0, F.lit(float("inf"))).otherwise(F.col("p") * F.ln(F.try_divide(F.col("p"), F.col("q"))))
    return both.withColumn("kl", kl).withColumn("flag", F.abs("kl") >= threshold)


def kl_cost(observed: DataFrame, model: DataFrame, by: list[str] | None = None) -> DataFrame:
    return divergence(observed, model, by=by).groupBy(*(by or [])).agg(F.sum("kl").alias("kl"))


def negative_log_likelihood(observed: DataFrame, model: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Minus the multinomial log likelihood of counts under the model's shares."""
    keys = [*(by or []), "pat"]
    q = normalised(model, by).select(*keys, F.col("value").alias("q"))
    both = observed.select(*keys, "value").join(q, keys, "left")
    term = F.when(F.col("value") == 0, F.lit(0.0)).when(F.coalesce("q", F.lit(0.0)) == 0, F.lit(float("inf"))).otherwise(-F.col("value") * F.ln("q"))
    return both.groupBy(*(by or [])).agg(F.sum(term).alias("neg_lnl"))


def entropy(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    return normalised(table, by).where("value > 0").groupBy(*(by or [])).agg((-F.sum(F.col("value") * F.ln("value"))).alias("entropy"))


def has_singletons(table: DataFrame) -> DataFrame:
    return table.agg(F.coalesce(F.bool_or((F.bit_count("pat") == 1) & (F.col("value") != 0)), F.lit(False)).alias("has_singletons"))


def table_matrix(tables: DataFrame, names: list[str], key: str = "label") -> DataFrame:
    """One row a pattern and one column a table."""
    return tables.groupBy(key).pivot("table", names).agg(F.first("value"))


def parameter_matrix(estimates: DataFrame, names: list[str]) -> DataFrame:
    """One row a file and one column a parameter; parameters that a file does not have are null."""
    return estimates.groupBy("file").pivot("name", names).agg(F.first("value"))


def label_index(patterns: DataFrame) -> DataFrame:
    """label and bit of each population, in order of first appearance over (ord, place in the pattern's label)."""
    parts = patterns.select("ord", F.posexplode(F.split("label", ":")).alias("place", "name"))
    first = parts.groupBy("name").agg(F.min(F.struct("ord", "place")).alias("at"))
    return first.select("name", (F.row_number().over(Window.orderBy("at")) - 1).cast("long").alias("bit"))


def by_mask(table: DataFrame, labels: list[str]) -> DataFrame:
    """pat and value of labelled rows; repeated labels add up, unknown ones are an error."""
    mask = label_mask(F.col("label"), labels)
    checked = F.when(mask == 0, F.raise_error(F.concat(F.lit("unknown label "), "label")).cast("long")).otherwise(mask)
    return table.groupBy(checked.alias("pat")).agg(F.sum("value").alias("value"))


def labelled(table: DataFrame, labels: list[str]) -> DataFrame:
    return table.withColumn("label", pattern_label(F.col("pat"), labels))
