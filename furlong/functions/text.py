"""Text helpers with the reference's whitespace, padding and null rules."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Every character Python's str.strip() removes, derived from the rule itself
# (str.isspace) rather than listed. SQL TRIM / Python strip / JS trim all strip
# Unicode whitespace, including the full-width space U+3000 that pads
# fixed-width Japanese text; Spark's one-argument trim removes only U+0020.
WHITESPACE = "".join(chr(i) for i in range(0x110000) if chr(i).isspace())


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_str(c) -> Column:
    return _c(c).cast("string")


def trim_ws(c) -> Column:
    """Strip leading and trailing Unicode whitespace."""
    return F.trim(to_str(c), F.lit(WHITESPACE))


def trim_ws_by_ends(c) -> Column:
    """The same as :func:`trim_ws`, for columns with many rows: a text whose first
    and last characters are plain (printable ASCII, or beyond the last whitespace
    character) is left as it is, without a search through all whitespace."""
    s = to_str(c)
    beyond = F.lit(chr(ord(max(WHITESPACE)) + 1))
    plain = lambda x: ((x >= F.lit("!")) & (x < F.lit("\x7f"))) | (x >= beyond)
    return F.when(plain(s) & plain(F.substring(s, -1, 1)), s).otherwise(trim_ws(s))


def number(c) -> Column:
    """A double, with NaN as missing: Spark orders NaN above every number, so
    ``NaN > 0`` would hold and one NaN would spoil any mean."""
    x = _c(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def blank_to_null(c) -> Column:
    """NULLIF(TRIM(c), '')."""
    return F.nullif(trim_ws(c), F.lit(""))


def sql_lpad(c, n: int, pad: str = "0") -> Column:
    """SQL LPAD: pads, and truncates to ``n`` when longer."""
    return F.lpad(to_str(c), n, pad)


def pad_start(c, n: int, pad: str = "0") -> Column:
    """JavaScript padStart: pads, never truncates."""
    s = to_str(c)
    return F.when(F.length(s) >= n, s).otherwise(F.lpad(s, n, pad))


def leading_digits(c) -> Column:
    """REGEXP_EXTRACT(c, '^[0-9]+'), NULL when there is no match."""
    return F.nullif(F.regexp_extract(to_str(c), r"^[0-9]+", 0), F.lit(""))


def trailing_digits(c) -> Column:
    """REGEXP_EXTRACT(c, '[0-9]+$'), NULL when there is no match."""
    return F.nullif(F.regexp_extract(to_str(c), r"[0-9]+\z", 0), F.lit(""))


# Text the index builder treats as a missing category.
NULL_MARKERS = ["", "None", "nan", "NaN"]


def clean_null_markers(c) -> Column:
    """Trim, then map the null markers to a real NULL."""
    t = trim_ws(c)
    return F.when(~t.isin(NULL_MARKERS), t)


def _nfkc_series(s: pd.Series) -> pd.Series:
    """Each distinct value of the batch is normalised once."""
    code, values = pd.factorize(s)
    table = pd.array([unicodedata.normalize("NFKC", v) for v in values] + [None], dtype=object)
    return pd.Series(table[code], index=s.index)


@F.pandas_udf(T.StringType())
def _nfkc_udf(s: pd.Series) -> pd.Series:
    return _nfkc_series(s)


def nfkc(c) -> Column:
    """NORMALIZE(c, NFKC) (X11).

    Spark SQL has no Unicode normalisation function, so this is the one
    Arrow-batched Python helper besides the record parser; it normalises the
    distinct values of a batch. Pure-ASCII values are already NFKC-normal.
    """
    s = to_str(c)
    ascii_only = s.rlike(r"^[\x00-\x7F]*$")
    # A Python UDF runs on every row even inside CASE, so ASCII rows (already
    # NFKC-normal) send a NULL instead of their text across the Arrow bridge.
    return F.when(ascii_only, s).otherwise(_nfkc_udf(F.when(~ascii_only, s)))
