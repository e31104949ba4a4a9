"""Evaluate columns exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add or replace columns so that later steps read them as plain columns.

    A filter on a computed column is pushed below the projection by copying its
    expression, and a copy inside an array lambda is evaluated for each element.
    Going through a one-row generator keeps every expression in one place.
    """
    keep = [c for c in df.columns if c not in columns]
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*keep, F.inline(F.array(row)))
