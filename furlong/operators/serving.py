"""Warehouse model and serving tables.

Shuffles: one aggregate each for C3/C4 (partial aggregation before the
exchange), one window for C6's priority pick, sorted once, after the exchange.
C5 is narrow. C7 is a TakeOrderedAndProject (per-task top-k, then a k-row merge). C8 filters on ``race_id`` so the predicate reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furlong.functions.codes import venue_code
from furlong.functions.race_id import RACE_ID_PATTERN, build_race_id, is_race_id
from furlong.functions.text import blank_to_null, leading_digits, sql_lpad, trailing_digits, trim_ws, trim_ws_by_ends
from furlong.operators._util import int64

RACE_GROUP = ["ymd", "venue", "kaisai", "race_num"]


def _results_keyed(results: DataFrame, extra_not_null: list[str] = ()) -> DataFrame:
    cond = F.lit(True)
    for c in ["date", "venue", "kaisai", "race_num", *extra_not_null]:
        cond = cond & F.col(c).isNotNull()
    return results.filter(cond)


def _by_race(keyed: DataFrame, more_keys: list[str], *aggs: Column) -> DataFrame:
    """Aggregates by ``RACE_GROUP`` and ``more_keys``. The maximum of a text
    sorts its rows by the keys: a hash of the race leads them, so that one number
    decides nearly every comparison, and rows of a race stay together."""
    return keyed.withColumn("_race", F.hash(*RACE_GROUP)).groupBy("_race", *RACE_GROUP, *more_keys).agg(*aggs).drop("_race")


def race_summary(results: DataFrame) -> DataFrame:
    """One row per (ymd, venue, kaisai, race_num) with max name/distance/surface."""
    keyed = _results_keyed(results).select(
        F.date_format("date", "yyyyMMdd").alias("ymd"), "venue", "kaisai",
        int64(results, "race_num").alias("race_num"),
        trim_ws_by_ends("race_name").alias("_name"), int64(results, "distance").alias("_dist"),
        trim_ws_by_ends("surface").alias("_surf"))
    return _by_race(keyed, [], F.max("_name").alias("race_name"), F.max("_dist").alias("kyori"), F.max("_surf").alias("course"))


def entry_fallback(results: DataFrame) -> DataFrame:
    """One row per race and horse number, frame number derived."""
    keyed = _results_keyed(results, ["horse_num"]).select(
        F.date_format("date", "yyyyMMdd").alias("ymd"), "venue", "kaisai",
        int64(results, "race_num").alias("race_num"),
        sql_lpad(int64(results, "horse_num").cast("string"), 2).alias("umaban"),
        F.ceil(F.col("horse_num").cast("double") / F.lit(2.0)).cast("long").alias("wakuban"),
        trim_ws_by_ends(F.col("horse_id").cast("string")).alias("_id"),
        trim_ws_by_ends(F.col("horse_name").cast("string")).alias("_name"))
    return _by_race(keyed, ["umaban", "wakuban"], F.max("_id").alias("ketto_num"), F.max("_name").alias("bamei"))


def _meeting_id(ymd: Column, jyo: Column, kaisai: Column, race_no: Column) -> Column:
    return F.concat(ymd, jyo, sql_lpad(leading_digits(kaisai), 2), sql_lpad(trailing_digits(kaisai), 2),
                    sql_lpad(race_no.cast("string"), 2))


def serving_races(summary: DataFrame) -> DataFrame:
    """Serving race table (C5): venue code (unknown -> dropped), meeting digits,
    16-digit id, name defaulting to '<n>R'.

    The id parts are computed once as columns and the id is built from them,
    so the CASE lookup and the two regex extracts appear once in the
    generated code rather than once per use.
    """
    parts = summary.select(
        "ymd", "venue", "race_num", "race_name", "kyori", "course",
        venue_code(F.col("venue"), None).alias("_jyo"),
        sql_lpad(leading_digits("kaisai"), 2).alias("_kaiji"),
        sql_lpad(trailing_digits("kaisai"), 2).alias("_nichiji"))
    rid = F.concat("ymd", "_jyo", "_kaiji", "_nichiji", sql_lpad(F.col("race_num").cast("string"), 2))
    return (parts
            .filter(F.col("_jyo").isNotNull() & F.col("_kaiji").isNotNull() & F.col("_nichiji").isNotNull())
            .withColumn("race_id", rid)
            .filter(F.col("race_id").rlike(RACE_ID_PATTERN))
            .select("race_id",
                    F.to_date("ymd", "yyyyMMdd").alias("kaisai_date"),
                    F.col("venue").alias("kaisai_basho"),
                    F.col("race_num").alias("race_no"),
                    F.coalesce(blank_to_null("race_name"),
                               F.concat(F.col("race_num").cast("string"), F.lit("R"))).alias("race_name"),
                    "kyori", "course"))


def se_entries(se_latest: DataFrame) -> DataFrame:
    """Priority-1 entries from the latest runner records."""
    return se_latest.filter(F.col("Umaban").isNotNull()).select(
        build_race_id(F.col("Year").cast("string"), sql_lpad("MonthDay", 4), sql_lpad("JyoCD", 2),
                      sql_lpad("Kaiji", 2), sql_lpad("Nichiji", 2), sql_lpad("RaceNum", 2)).alias("race_id"),
        trim_ws_by_ends("Wakuban").alias("wakuban"),
        sql_lpad(trim_ws_by_ends("Umaban"), 2).alias("umaban"),
        trim_ws_by_ends("KettoNum").alias("ketto_num"),
        trim_ws_by_ends("Bamei").alias("bamei"),
        F.lit(1).alias("source_priority"))


def fallback_entries(fallback: DataFrame, unknown_venue: str = "00") -> DataFrame:
    """Priority-2 entries from race results; an unknown venue becomes ``'00'``,
    so its id is well-formed but has no race row (counted by the quality report)."""
    return fallback.select(
        _meeting_id(F.col("ymd"), venue_code(F.col("venue"), unknown_venue), F.col("kaisai"),
                    F.col("race_num")).alias("race_id"),
        F.col("wakuban").cast("string").alias("wakuban"),
        "umaban", "ketto_num", "bamei",
        F.lit(2).alias("source_priority"))


def serving_entries(se_latest: DataFrame, fallback: DataFrame) -> DataFrame:
    """Union of feed entries and result-derived entries; best source per
    (race_id, umaban) (C6: U1 + W4). Ties inside one source are broken by the
    remaining columns so the pick is deterministic.

    An id is 16 digits here, so it is shuffled and sorted as a number. Both
    sources have had a row per key of their own, so that dropping rows before
    the exchange would sort all of them once more for nothing: they are dealt
    out first."""
    u = se_entries(se_latest).unionByName(fallback_entries(fallback))
    u = u.filter(F.col("race_id").isNotNull() & is_race_id("race_id") & F.col("umaban").isNotNull())
    u = u.select(F.col("race_id").cast("long").alias("_rid"), "wakuban", "umaban", "ketto_num", "bamei", "source_priority")
    w = Window.partitionBy("_rid", "umaban").orderBy(
        F.col("source_priority").asc(), F.col("wakuban").desc_nulls_last(),
        F.col("ketto_num").desc_nulls_last(), F.col("bamei").desc_nulls_last())
    return (u.repartition("_rid", "umaban").withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1)
            .select(F.lpad(F.col("_rid").cast("string"), 16, "0").alias("race_id"), "wakuban", "umaban", "ketto_num", "bamei"))


def race_list(races: DataFrame, limit: int = 50) -> DataFrame:
    """Most recent races in display order (C7): date DESC, venue, race number,
    then race_id so the top-k is unique; then display coercions (F11)."""
    top = (races.select(
        "race_id", F.date_format("kaisai_date", "yyyy-MM-dd").alias("kaisai_date"), "kaisai_basho",
        F.col("race_no").cast("long").alias("race_no"), "race_name",
        F.col("kyori").cast("long").alias("kyori"), "course")
        .orderBy(F.col("kaisai_date").desc_nulls_last(), F.col("kaisai_basho").asc_nulls_first(),
                 F.col("race_no").asc_nulls_first(), F.col("race_id").asc_nulls_first())
        .limit(limit))
    race_no = F.coalesce(F.col("race_no"), F.lit(0))
    return top.select(
        F.coalesce(F.col("race_id"), F.lit("")).alias("race_id"),
        F.coalesce(F.col("kaisai_date"), F.lit("")).alias("kaisai_date"),
        F.coalesce(F.col("kaisai_basho"), F.lit("")).alias("kaisai_basho"),
        race_no.alias("race_no"),
        F.coalesce(blank_to_null("race_name"), F.concat(race_no.cast("string"), F.lit("R"))).alias("race_name"),
        F.when(F.col("kyori").isNull() | (F.col("kyori") == 0), F.lit("")).otherwise(
            F.col("kyori").cast("string")).alias("kyori"),
        F.coalesce(trim_ws("course"), F.lit("")).alias("course"),
    ).filter(F.length("race_id") > 0)


def race_header(races: DataFrame, race_id: str | None = None) -> DataFrame:
    """One header row per race (T3). With ``race_id`` the filter is pushed to
    the scan; without it every race gets one row under a total order."""
    r = races if race_id is None else races.filter(F.col("race_id") == F.lit(race_id))
    w = Window.partitionBy("race_id").orderBy(
        F.col("kaisai_date").desc_nulls_last(), F.col("kaisai_basho").desc_nulls_last(),
        F.col("race_no").desc_nulls_last(), F.col("race_name").desc_nulls_last(),
        F.col("kyori").desc_nulls_last(), F.col("course").desc_nulls_last())
    return r.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


class InvalidRaceId(ValueError):
    pass


def validate_race_id(race_id: str) -> str:
    import re
    if not isinstance(race_id, str) or not re.fullmatch(r"[0-9]{16}", race_id):
        raise InvalidRaceId("Invalid race ID format.")
    return race_id


def race_card(races: DataFrame, entries: DataFrame, race_id: str | None = None) -> DataFrame:
    """Race card (C8): header fields beside each runner, runners in numeric
    horse-number order (T2). ``race_id`` None gives every race's card.

    An invalid id raises ``InvalidRaceId``; a valid id with no race row gives
    an empty result (the reference's "race not found"), since the inner join
    on the header drops the runners.
    """
    if race_id is not None:
        validate_race_id(race_id)
        entries = entries.filter(F.col("race_id") == F.lit(race_id))
    h = race_header(races, race_id).select(
        "race_id",
        F.coalesce(blank_to_null("race_name"),
                   F.concat(F.coalesce(F.col("race_no"), F.lit(0)).cast("string"), F.lit("R"))).alias("race_name"),
        F.date_format("kaisai_date", "yyyy-MM-dd").alias("kaisai_date"),
        F.coalesce(F.col("kaisai_basho"), F.lit("")).alias("kaisai_basho"),
        F.coalesce(F.col("race_no"), F.lit(0)).cast("string").alias("race_no"),
        F.when(F.col("kyori").isNull() | (F.col("kyori") == 0), F.lit("")).otherwise(
            F.col("kyori").cast("string")).alias("kyori"),
        F.coalesce(trim_ws("course"), F.lit("")).alias("course"))
    e = entries.select(
        "race_id",
        F.coalesce(trim_ws("wakuban"), F.lit("")).alias("wakuban"),
        F.coalesce(trim_ws("umaban"), F.lit("")).alias("umaban"),
        F.coalesce(trim_ws("ketto_num"), F.lit("")).alias("ketto_num"),
        F.coalesce(trim_ws("bamei"), F.lit("")).alias("bamei"),
        F.col("umaban").try_cast("long").alias("_uma_n"), F.col("umaban").alias("_uma"))
    card = e.join(h, "race_id", "inner")
    order = ["race_id", F.col("_uma_n").asc_nulls_first(), F.col("_uma").asc_nulls_first()]
    if race_id is not None:
        return card.orderBy(*order).drop("_uma_n", "_uma")
    # every card: clustered by race and sorted within partitions, no global sort
    return card.repartition("race_id").sortWithinPartitions(*order).drop("_uma_n", "_uma")


def race_page(races: DataFrame, entries: DataFrame, race_ids: list[str]) -> DataFrame:
    """One row per asked race id (C8, C14): whether the race exists, how many
    runners it has, and its header (NULL when there is no such race). A race
    without runners is found, with none. Ids are validated first."""
    spark = races.sparkSession
    asked = spark.createDataFrame([(validate_race_id(i),) for i in race_ids], "race_id string").distinct()
    header = race_header(races.filter(F.col("race_id").isin(race_ids)))
    runners = entries.filter(F.col("race_id").isin(race_ids)).groupBy("race_id").agg(F.count(F.lit(1)).alias("n_runners"))
    return (asked.join(header, "race_id", "left").join(runners, "race_id", "left")
            .select("race_id", F.col("kaisai_basho").isNotNull().alias("found"), F.coalesce("n_runners", F.lit(0)).alias("n_runners"),
                    "kaisai_date", "kaisai_basho", "race_no", "race_name", "kyori", "course"))
