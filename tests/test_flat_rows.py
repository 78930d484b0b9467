"""Numbering of matrix lines."""

import re

from sitefold.sources import text


def test_lines_are_numbered_within_ranges(spark):
    lines = [(0, "# points"), (1, "p q"), *[(3 * k + 2, f"{k} {k + 0.5} # note") for k in range(50)], (40, ""), (43, "# more")]
    got = text.flat_rows(spark.createDataFrame(lines, "line_no long, value string"))
    want = {(k, n, k + d) for k in range(50) for n, d in (("p", 0.0), ("q", 0.5))}
    assert {tuple(r) for r in got.collect()} == want and got.count() == 100
    # no window puts all lines in one order: those over line numbers are partitioned
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition" in plan and not re.search(r"windowspecdefinition\(line_no", plan)
