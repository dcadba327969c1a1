"""Restrict an operational table to the look-back window."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def window_bounds(as_of: dt.date, days: int) -> tuple[dt.date, dt.date]:
    """``[as_of - days, as_of + 1 day)``: the lower bound of the reference plus "now"."""
    return as_of - dt.timedelta(days=days), as_of + dt.timedelta(days=1)


def _literal_like(field_type: T.DataType, value: dt.date) -> Column:
    # Compare the raw column with a literal of its own type so the predicate
    # reaches the parquet scan (and date partitions) without a cast on the column.
    if isinstance(field_type, T.TimestampNTZType):
        return F.lit(dt.datetime(value.year, value.month, value.day)).cast("timestamp_ntz")
    if isinstance(field_type, T.TimestampType):
        return F.lit(dt.datetime(value.year, value.month, value.day))
    return F.lit(value)


def recent(df: DataFrame, ts_col: str, as_of: dt.date, days: int = 30) -> DataFrame:
    """Rows of ``df`` whose ``ts_col`` falls in the window ending at ``as_of``."""
    lo, hi = window_bounds(as_of, days)
    ftype = df.schema[ts_col].dataType
    c = F.col(ts_col)
    return df.where((c >= _literal_like(ftype, lo)) & (c < _literal_like(ftype, hi)))
