"""Model texts with other values: lines in, lines out."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.sources.text import file_key, running_count, with_previous

from .model_choice import principal_components

_ASSIGNS = r"^(\s*(?:twoN|time|mixFrac|param)\s+\w+\s*(?:\[[^\]]*\])?\s*(\w[\w.]*)\s*=\s*)([^#]*?)(\s*(?:#.*)?)$"


def with_fitted_values(lines: DataFrame, fitted: DataFrame, width: int = 1 << 14) -> DataFrame:
    """``lines`` (line_no, value, and file) of a model in which parameters have their fitted values (name, fit); others, and lines
    that assign nothing, stay as they are.

    A line that ends with an operator goes on in the next one that is neither blank nor all comment. Of a statement that gets a
    value, the first line holds it; what the others said goes, and so do they, but for their comments."""
    keys = file_key(lines)
    code = F.regexp_replace("value", r"\s*(#.*)?$", "")
    told = lines.withColumns({"_blank": code == "", "_open": code.rlike(r"[-+*/]$")})
    seen = with_previous(told.where("not _blank"), keys, "line_no", ["_open"], width)
    seen = seen.withColumn("_first", ~F.coalesce("_before._open", F.lit(False))).drop("_before")
    numbered = running_count(seen, F.col("_first"), "_statement").withColumn("_name", F.when(F.col("_first"), F.regexp_extract("value", _ASSIGNS, 2)))
    # six significant digits, without zeros at the end
    number = F.regexp_replace(F.regexp_replace(F.format_string("%.6g", "fit"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    values = fitted.select(F.col("name").alias("_name"), number.alias("_fit"))
    given = numbered.where("_name <> ''").join(values, "_name").select(*keys, "_statement", "_fit")
    both = numbered.join(given, [*keys, "_statement"], "left")
    new = F.concat(F.regexp_extract("value", _ASSIGNS, 1), "_fit", F.regexp_extract("value", _ASSIGNS, 4))
    comment = F.regexp_extract("value", r"#.*$", 0)
    kept = [c for c in lines.columns if c != "value"]
    changed = both.where("_fit is null or _first or value like '%#%'").select(*kept, F.when(F.col("_fit").isNull(), F.col("value")).when(F.col("_first"), new).otherwise(comment).alias("value"))
    return changed.unionByName(told.where("_blank").select(*kept, "value"))


def component_lines(rows: DataFrame, names: list[str], least_share: float = 0.0) -> list[str]:
    """Statements that put principal components in the place of free parameters: each component is free between plus and
    minus a power of two beyond its largest score, and each parameter is its mean plus loadings times components."""
    mean, sd, shares, parts = principal_components(rows, names)
    kept = [k for k in range(len(names)) if shares[k] >= least_share]
    scores = [sum((F.col(n) - float(m)) / float(s) * float(w) for n, m, s, w in zip(names, mean, sd, parts[k], strict=True)) for k in kept]
    top = rows.agg(*[F.max(F.abs(x)).alias(f"s{k}") for k, x in zip(kept, scores, strict=True)]).first()
    lines = [f"param free [-{b:g}, {b:g}] pc{k + 1} = 0" for k in kept for b in [2.0 ** math.ceil(math.log2(top[f"s{k}"]))]]
    for j, n in enumerate(names):
        terms = "".join(f" {'+' if c >= 0 else '-'} {abs(c):.16g}*pc{k + 1}" for k in kept for c in [float(np.multiply(parts[k][j], sd[j]))])
        lines.append(f"param constrained {n} = {mean[j]:.16g}{terms}")
    return lines


def component_coefficients(lines: list[str]) -> tuple[dict[str, float], dict[str, dict[str, float]], dict[str, float]]:
    """Of the statements of :func:`component_lines`: each parameter's mean, its coefficients by component, and each component's bound."""
    means, coefficients, bounds = {}, {}, {}
    for line in lines:
        if found := re.fullmatch(r"param free \[-(\S+), \S+\] (\w+) = 0", line):
            bounds[found[2]] = float(found[1])
        else:
            name, mean, terms = re.fullmatch(r"param constrained (\S+) = (\S+)(.*)", line).groups()
            means[name] = float(mean)
            coefficients[name] = {pc: float(sign + c) for sign, c, pc in re.findall(r"([+-]) (\S+?)\*(\w+)", terms)}
    return means, coefficients, bounds
