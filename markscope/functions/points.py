"""Point / range tests on (row, column) points, both ends inclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(row, column) -> Column:
    return F.struct(F.col(row).alias("row") if isinstance(row, str) else row.alias("row"),
                    F.col(column).alias("col") if isinstance(column, str) else column.alias("col"))


def is_before(p: Column, start: Column) -> Column:
    return p < start


def is_after(p: Column, end: Column) -> Column:
    return p > end


def is_member_of(p: Column, start: Column, end: Column) -> Column:
    return ~is_before(p, start) & ~is_after(p, end)
