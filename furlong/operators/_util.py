from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def int64(df: DataFrame, name: str) -> Column:
    """CAST(x AS INT64) with warehouse semantics: fractions round half away
    from zero (Spark's cast would truncate), text must be integral."""
    dt = col_type(df, name)
    c = F.col(name)
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return F.round(c).cast("long")
    return c.cast("long")


def default_tiebreak(df: DataFrame, exclude: list[str]) -> list[Column]:
    """Every other column, descending with NULLs last, in name order.

    Rows that tie on all of them are identical, so whichever is kept the
    result is the same: this turns the reference's arbitrary tie into a
    deterministic one without changing any non-tied choice.
    """
    skip = set(exclude)


    def comparable(c: str) -> Column:   # maps have no order of their own
        return F.to_json(F.sort_array(F.map_entries(c))) if isinstance(df.schema[c].dataType, T.MapType) else F.col(c)

    return [comparable(c).desc_nulls_last() for c in sorted(df.columns) if c not in skip]
