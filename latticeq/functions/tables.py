"""Table functions for SQL: aligned columns of gapped strings, and runs as their pairs. They are used by lateral join."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

#: Markers of an aligned column.
MARKERS = ":. "


@udtf(returnType="pos int, i bigint, j bigint, a string, marker string, b string", useArrow=True)
class AlignedColumns:
    """aligned_columns(first, marker, second): the columns with a letter on both sides and a known marker. Strings of unequal length raise, null ones give no rows."""

    def eval(self, first: str, marker: str, second: str) -> Iterator[tuple]:
        if first is None or marker is None or second is None:
            return
        if not len(first) == len(marker) == len(second):
            raise ValueError(f"unequal lengths: {len(first)}, {len(marker)}, {len(second)}")
        i = j = -1
        for pos, (a, m, b) in enumerate(zip(first, marker, second, strict=True)):
            i, j = i + (a != "-"), j + (b != "-")
            if a != "-" and b != "-" and m in MARKERS:
                yield pos, i, j, a, m, b


@udtf(returnType="i bigint, j bigint", useArrow=True)
class ExpandedRun:
    """expanded_run(i0, j0, len): the pairs of a run in which both places grow by one."""

    def eval(self, i0: int, j0: int, size: int) -> Iterator[tuple]:
        for k in range(size or 0):
            yield i0 + k, j0 + k


def register(spark: SparkSession) -> None:
    """Make the functions known to a session's SQL."""
    spark.udtf.register("aligned_columns", AlignedColumns)
    spark.udtf.register("expanded_run", ExpandedRun)
