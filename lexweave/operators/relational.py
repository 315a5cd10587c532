"""Joins of generic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def merge_dataframes(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left join where null keys match each other; then numbers that are missing become 0 and strings ''. The right key is
    dropped; columns of both sides get the suffixes _x and _y."""
    clash = (set(left.columns) & set(right.columns)) - {left_key, right_key}
    clash |= {c for c in right.columns if c == left_key and c != right_key}
    a = left.select(*(left[c].alias(f"{c}_x" if c in clash and c != left_key else c) for c in left.columns))
    b = right.select(*(right[c].alias("_right_key" if c == right_key else f"{c}_y" if c in clash or c in a.columns else c) for c in right.columns))
    out = a.join(b, a[left_key].eqNullSafe(b["_right_key"]), "left").drop("_right_key")
    numbers = [f.name for f in out.schema if isinstance(f.dataType, T.NumericType)]
    strings = [f.name for f in out.schema if isinstance(f.dataType, T.StringType)]
    return out.na.fill(0, numbers).na.fill("", strings)
