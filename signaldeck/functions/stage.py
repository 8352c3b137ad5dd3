"""Columns that are computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters and explodes use without recomputing them.

    A filter on a plain computed column moves below the projection and carries a copy of
    the expression with it, and an explode adds such a filter by itself; for a parsed
    JSON document that means parsing it several times.  The output of a one-row generator
    stays where it is, so the expression runs once per row.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    kept = [F.col(f"`{name}`") for name in df.columns if name not in columns]
    return df.select(*kept, F.inline(F.array(row)))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that it names several times; the value is computed once.

    Inside lambda functions nothing else keeps Spark from computing it at each mention.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
