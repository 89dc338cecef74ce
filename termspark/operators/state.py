"""Context counts as saved state that new text is merged into (A7 partial and merged).

The state of a corpus is two tables: its distinct lines, and counts ``c`` that the contexts
of all grams follow from, rare ones too, since later text may lift them over a floor:
(gram, side, ctx, c), or a row for each window (s, p, c) of ``growth.windows``, which
has all grams that start at a place.  Counts are sums, so states of disjoint sets of
lines merge by adding up; entropy follows from the merged counts without a second
pass over old text.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_lines(lines: DataFrame, seen: DataFrame, line_col: str = "line") -> DataFrame:
    """Distinct lines that the state does not have (a corpus counts each line once)."""
    return lines.select(line_col).distinct().join(seen.select(line_col), line_col, "left_anti")


def merge_counts(state: DataFrame, *more: DataFrame) -> DataFrame:
    """The counts ``c`` of disjoint sets of lines, added up."""
    keys = [k for k in state.columns if k != "c"]
    for m in more:
        state = state.unionByName(m)
    return state.groupBy(*keys).agg(F.sum("c").alias("c"))
