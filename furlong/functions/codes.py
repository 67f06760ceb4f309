"""Code lookups as literal CASE expressions (constant-folded by Catalyst)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from furlong.functions.text import to_str

# Venue name -> two-digit venue code.
VENUE_CODES = {
    "札幌": "01", "函館": "02", "福島": "03", "新潟": "04", "東京": "05",
    "中山": "06", "中京": "07", "京都": "08", "阪神": "09", "小倉": "10",
}

# Track code -> description.
TRACK_CODES = {
    "10": "芝・左", "11": "芝・左外", "12": "芝・左内", "17": "芝・右", "18": "芝・右外",
    "19": "芝・右内", "20": "芝・直線", "23": "ダ・右", "24": "ダ・左", "29": "芝→ダ",
}

# Analysis-score display bands (lower bound, band), checked in order.
SCORE_BANDS = [(80.0, "high"), (65.0, "good"), (50.0, "fair")]
SCORE_BAND_LOW = "low"


def _case(c: Column, mapping: dict[str, str], default) -> Column:
    items = list(mapping.items())
    k0, v0 = items[0]
    expr = F.when(c == F.lit(k0), F.lit(v0))
    expr = reduce(lambda e, kv: e.when(c == F.lit(kv[0]), F.lit(kv[1])), items[1:], expr)
    return expr.otherwise(F.lit(default).cast("string"))


def venue_code(venue, default: str | None = None) -> Column:
    """Venue name -> code; unknown names give ``default``."""
    return _case(to_str(venue if not isinstance(venue, str) else F.col(venue)), VENUE_CODES, default)


def venue_name(code) -> Column:
    """Venue code -> name, NULL when unknown."""
    c = F.col(code) if isinstance(code, str) else code
    return _case(to_str(c), {v: k for k, v in VENUE_CODES.items()}, None)


def track_name(code) -> Column:
    """Track code -> description, NULL when unknown."""
    c = F.col(code) if isinstance(code, str) else code
    return _case(to_str(c), TRACK_CODES, None)


def score_band(score) -> Column:
    """Display band of an analysis score; NULL score -> NULL."""
    s = F.col(score) if isinstance(score, str) else score
    (b0, n0), *rest = SCORE_BANDS
    expr = F.when(s.isNull(), F.lit(None).cast("string")).when(s >= b0, F.lit(n0))
    for b, n in rest:
        expr = expr.when(s >= b, F.lit(n))
    return expr.otherwise(F.lit(SCORE_BAND_LOW))
