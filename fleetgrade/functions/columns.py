"""Column-expression helpers shared by metrics, rules and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MS_PER_HOUR = 3_600_000.0


def pick(df: DataFrame, *candidates: str) -> Column:
    """First candidate column path that resolves on ``df``.

    Operational tables arrive nested in production (``usage_metadata.cluster_id``)
    and flat in fixtures (``usage_cluster_id``); operators accept both.
    """
    for name in candidates:
        head, *rest = name.split(".")
        if head not in df.columns:
            continue
        if not rest:
            return F.col(name)
        dtype = df.schema[head].dataType
        ok = True
        for part in rest:
            names = getattr(dtype, "names", None) or []
            if part not in names:
                ok = False
                break
            dtype = dtype[part].dataType
        if ok:
            return F.col(name)
    raise ValueError(f"none of {candidates} found in {df.columns}")


def count_if(cond: Column) -> Column:
    """Conditional count as BIGINT (0 on no rows, never NULL)."""
    return F.coalesce(F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))), F.lit(0)).cast("bigint")


def hours(ms: Column) -> Column:
    """Milliseconds to hours as DOUBLE (integer ms, one IEEE division)."""
    return ms.cast("double") / F.lit(MS_PER_HOUR)


def ratio_pct(num: Column, den: Column) -> Column:
    """``num / den * 100`` as DOUBLE, NULL when ``den`` is 0 (ANSI-safe)."""
    return F.try_divide(num.cast("double"), den.cast("double")) * F.lit(100.0)


def round_half_even(c: Column, digits: int) -> Column:
    """Python ``round`` semantics for reported numbers."""
    return F.bround(c, digits)
