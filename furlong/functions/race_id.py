"""Race keys and the 16-digit race id ``yyyy mmdd jj kk nn rr``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from furlong.functions.text import leading_digits, pad_start, sql_lpad, to_str, trailing_digits, trim_ws_by_ends

# `\z`, not `$`: Java's `$` also matches before a final newline.
RACE_ID_PATTERN = r"^[0-9]{16}\z"

RACE_KEY = ["Year", "MonthDay", "JyoCD", "Kaiji", "Nichiji", "RaceNum"]
RUNNER_KEY = RACE_KEY + ["Umaban"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_race_id(c) -> Column:
    return to_str(_c(c)).rlike(RACE_ID_PATTERN)


def race_id_parts(c) -> Column:
    """Split a race id into its six parts; NULL when the id is not 16 digits."""
    s = to_str(_c(c))
    parts = F.struct(
        F.substring(s, 1, 4).alias("year"), F.substring(s, 5, 4).alias("month_day"),
        F.substring(s, 9, 2).alias("jyo_cd"), F.substring(s, 11, 2).alias("kaiji"),
        F.substring(s, 13, 2).alias("nichiji"), F.substring(s, 15, 2).alias("race_num"))
    return F.when(s.rlike(RACE_ID_PATTERN), parts)


def build_race_id(year, month_day, jyo_cd, kaiji, nichiji, race_num) -> Column:
    """Concatenate the parts as they are (NULL if any part is NULL)."""
    return F.concat(*[to_str(_c(p)) for p in (year, month_day, jyo_cd, kaiji, nichiji, race_num)])


def format_race_date(year, month_day) -> Column:
    """'yyyy-mm-dd' from a year and an unpadded month-day (padStart, no truncation)."""
    md = pad_start(_c(month_day), 4)
    return F.concat(to_str(_c(year)), F.lit("-"), F.substring(md, 1, 2), F.lit("-"), F.substring(md, 3, 2))


def kaiji_nichiji(kaisai) -> Column:
    """Leading and trailing digits of a meeting text, padStart to 2; NULL if either is absent."""
    k, n = leading_digits(_c(kaisai)), trailing_digits(_c(kaisai))
    return F.when(k.isNotNull() & n.isNotNull(),
                  F.struct(pad_start(k, 2).alias("kaiji"), pad_start(n, 2).alias("nichiji")))


def race_key_exprs(prefix: str = "") -> list[Column]:
    """The warehouse's normalised race key: Year as text, other parts LPAD to 4/2/2/2/2."""
    return [
        to_str(F.col(prefix + "Year")).alias("_k_year"),
        sql_lpad(F.col(prefix + "MonthDay"), 4).alias("_k_md"),
        sql_lpad(F.col(prefix + "JyoCD"), 2).alias("_k_jyo"),
        sql_lpad(F.col(prefix + "Kaiji"), 2).alias("_k_kaiji"),
        sql_lpad(F.col(prefix + "Nichiji"), 2).alias("_k_nichiji"),
        sql_lpad(F.col(prefix + "RaceNum"), 2).alias("_k_race"),
    ]


def runner_key_exprs(prefix: str = "") -> list[Column]:
    return race_key_exprs(prefix) + [sql_lpad(trim_ws_by_ends(F.col(prefix + "Umaban")), 2).alias("_k_umaban")]
