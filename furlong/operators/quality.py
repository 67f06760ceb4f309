"""Data-quality checks on the serving tables.

Each check is one small aggregate (partial aggregation, one shuffle of
distinct keys at most); the report is their union, one row per check.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from furlong.functions.text import trim_ws
from furlong.operators.form import _as_of_col

REPORT_COLS = ["check_name", "issue_count", "issue_rate", "lag_days"]


def _row(df: DataFrame, name: str, count=None, rate=None, lag=None) -> DataFrame:
    return df.select(F.lit(name).alias("check_name"),
                     (count if count is not None else F.lit(None)).cast("long").alias("issue_count"),
                     (rate if rate is not None else F.lit(None)).cast("double").alias("issue_rate"),
                     (lag if lag is not None else F.lit(None)).cast("long").alias("lag_days"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Number of key groups holding more than one row (A19 + F12)."""
    return df.groupBy(*keys).count().filter(F.col("count") > 1).agg(F.count(F.lit(1)).alias("n"))


def duplicate_races(races: DataFrame) -> DataFrame:
    return _row(duplicate_keys(races, ["race_id"]), "serving_races_duplicate_race_id", count=F.col("n"))


def duplicate_entries(entries: DataFrame) -> DataFrame:
    return _row(duplicate_keys(entries, ["race_id", "umaban"]), "serving_entries_duplicate_race_horse",
                count=F.col("n"))


def null_rate(races: DataFrame) -> DataFrame:
    """Share of races with no distance or no course (A18, X15: NULL on an empty table)."""
    bad = bad_race()
    agg = races.agg(F.count_if(bad).alias("b"), F.count(F.lit(1)).alias("n"))
    return _row(agg, "serving_races_null_kyori_or_course_rate",
                rate=F.try_divide(F.col("b").cast("double"), F.col("n").cast("double")))


def freshness(races: DataFrame, as_of=None) -> DataFrame:
    """Days between ``as_of`` (default: today in Asia/Tokyo) and the newest race."""
    agg = races.agg(F.max("kaisai_date").alias("d"))
    return _row(agg, "serving_races_freshness_days", lag=F.datediff(_as_of_col(as_of), F.col("d")))


def orphan_entries(races: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries whose race id has no race row (e.g. the '00' unknown-venue ids)."""
    o = entries.select("race_id").join(races.select("race_id").distinct(), "race_id", "left_anti")
    return _row(o.agg(F.count(F.lit(1)).alias("n")), "serving_entries_orphan_race_id", count=F.col("n"))


def bad_race() -> Column:
    return F.col("kyori").isNull() | F.col("course").isNull() | (trim_ws("course") == "")


def observed(races: DataFrame) -> tuple[DataFrame, Observation]:
    """``races`` with the figures of the null-rate and freshness checks
    gathered by whatever job reads or writes it (A18)."""
    seen = Observation(f"races-{uuid.uuid4().hex[:8]}")
    one = F.lit(1)
    return races.observe(seen, F.count(one).alias("n"), F.count_if(bad_race()).alias("bad"), F.max("kaisai_date").alias("newest")), seen


def report_of_observed(races: DataFrame, entries: DataFrame, figures: dict, as_of=None) -> DataFrame:
    """The report, with the null rate and freshness from the figures observed
    when the races were written; only keys are read again, for the duplicate
    and orphan checks."""
    n, bad, newest = figures["n"] or 0, figures["bad"] or 0, figures["newest"]
    keys = quality_report(races.select("race_id", F.lit(1).alias("kyori"), F.lit("-").alias("course"), F.lit(None).cast("date").alias("kaisai_date")), entries, as_of)
    lag = F.datediff(_as_of_col(as_of), F.lit(newest).cast("date"))
    is_rate, is_lag = F.col("check_name") == "serving_races_null_kyori_or_course_rate", F.col("check_name") == "serving_races_freshness_days"
    return keys.select("check_name", "issue_count",
                       F.when(is_rate, F.lit(bad / n if n else None).cast("double")).otherwise(F.col("issue_rate")).alias("issue_rate"),
                       F.when(is_lag, lag.cast("long")).otherwise(F.col("lag_days")).alias("lag_days"))


def quality_report(races: DataFrame, entries: DataFrame, as_of=None, orphans: bool = True) -> DataFrame:
    """All checks, one row each (C18), from one pass over each table. The
    reference runs the first four and discards the rows; here they are a
    DataFrame, plus the orphan count.

    Races are reduced to one row per race id and entries to one per race id;
    these two small tables meet in a full join, whose one aggregate holds all
    five figures.
    """
    bad = bad_race()
    one = F.lit(1)
    r = races.groupBy("race_id").agg(F.count(one).alias("n_races"), F.count_if(bad).alias("n_bad"),
                                     F.max("kaisai_date").alias("newest"))
    e = (entries.groupBy("race_id", "umaban").agg(F.count(one).alias("n"))
         .groupBy("race_id").agg(F.sum("n").alias("n_entries"), F.count_if(F.col("n") > 1).alias("n_twice"))
         .withColumnRenamed("race_id", "entry_race"))
    total = r.join(e, F.col("race_id") == F.col("entry_race"), "full").agg(
        F.count_if(F.col("n_races") > 1).alias("dup_races"), F.coalesce(F.sum("n_twice"), F.lit(0)).alias("dup_entries"),
        F.sum("n_bad").cast("double").alias("n_bad"), F.sum("n_races").cast("double").alias("n_races"),
        F.max("newest").alias("newest"),
        F.coalesce(F.sum(F.when(F.col("n_races").isNull(), F.col("n_entries"))), F.lit(0)).alias("orphans"))

    def check(name: str, count=None, rate=None, lag=None):
        none = F.lit(None)
        return F.struct(F.lit(name).alias("check_name"), (none if count is None else count).cast("long").alias("issue_count"),
                        (none if rate is None else rate).cast("double").alias("issue_rate"),
                        (none if lag is None else lag).cast("long").alias("lag_days"))

    checks = [check("serving_races_duplicate_race_id", count=F.col("dup_races")),
              check("serving_entries_duplicate_race_horse", count=F.col("dup_entries")),
              check("serving_races_null_kyori_or_course_rate", rate=F.try_divide("n_bad", "n_races")),
              check("serving_races_freshness_days", lag=F.datediff(_as_of_col(as_of), F.col("newest")))]
    if orphans:
        checks.append(check("serving_entries_orphan_race_id", count=F.col("orphans")))
    return total.select(F.inline(F.array(*checks)))
