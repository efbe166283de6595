"""Column expressions shared by the operators (all JVM-side, codegen-able)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cobframe.schema import FLOAT_EPSILON, SAFE_ID_PATTERN

_INF = float("inf")


def to_double(c: Column | str) -> Column:
    """NUMERIC -> double, NULL -> 0.0 (staging coercion)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("double"), F.lit(0.0))


def or_default(c: Column | str, default: str) -> Column:
    """``value or default``: NULL and the empty string both count as missing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def safe_id(c: Column | str) -> Column:
    """True when the whole value matches the id alphabet (no trailing newline)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.rlike(SAFE_ID_PATTERN), F.lit(False))


def is_finite(c: Column | str) -> Column:
    """False for NaN and +-Inf; NULL counts as finite (missing values are V6's job)."""
    c = F.col(c) if isinstance(c, str) else c
    return ~F.coalesce(F.isnan(c) | c.isin(_INF, -_INF), F.lit(False))


def map_values_finite(m: Column | str) -> Column:
    m = F.col(m) if isinstance(m, str) else m
    return ~F.coalesce(F.exists(F.map_values(m), lambda v: F.isnan(v) | v.isin(_INF, -_INF)),
                       F.lit(False))


def floats_differ(a: Column, b: Column) -> Column:
    """Not ``abs(a - b) < 1e-9``; a missing side always differs."""
    return F.coalesce(~(F.abs(a - b) < F.lit(FLOAT_EPSILON)), F.lit(True))


def as_date(d) -> Column:
    if isinstance(d, Column):
        return d
    if isinstance(d, str):
        d = dt.date.fromisoformat(d)
    return F.lit(d)


def date_range(col: str, from_date=None, to_date=None, month_col: str | None = None) -> Column:
    """Inclusive optional date bounds.  ``month_col``: the partition column
    holding the month of ``col``, bounded as well so that directories prune."""
    cond = F.lit(True)
    if from_date is not None:
        cond = cond & (F.col(col) >= as_date(from_date))
        if month_col:
            cond = cond & (F.col(month_col) >= F.trunc(as_date(from_date), "month"))
    if to_date is not None:
        cond = cond & (F.col(col) <= as_date(to_date))
        if month_col:
            cond = cond & (F.col(month_col) <= as_date(to_date))
    return cond


def month_col_of(df) -> str | None:
    """The month partition column, where a stored table still carries it."""
    return "cob_month" if "cob_month" in df.columns else None


def sliced(df: DataFrame, cols: list[Column | str], n: int) -> list[DataFrame]:
    """``df`` in ``n`` parts; rows with equal ``cols`` are in one of them."""
    return [df] if n == 1 else [df.where(F.pmod(F.xxhash64(*cols), F.lit(n)) == i) for i in range(n)]


def typed_empty_map(key_type: str, value_type: str) -> Column:
    return F.create_map().cast(f"map<{key_type},{value_type}>")
