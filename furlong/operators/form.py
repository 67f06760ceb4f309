"""Recent form, field speed, speed-index lookup and the analysis score
(C9-C14), for one race or for every race in one plan.

The reference scores one race per request; here ``race_id=None`` scores all
races at once. Partitioning plan (all races):

1. history runs -> newest ``n`` per normalised name (row_number <= n; Catalyst
   adds a partial WindowGroupLimit *before* the shuffle, so a very common name
   ships at most ``n`` rows per map task).
2. entries LEFT JOIN that on the name: at most ``n`` rows per entry. Any
   top-n of a union lies in the union of top-ns, so this pre-limit is exact
   (the reference joins first and limits after, which in batch mode would
   multiply each entry by the horse's whole career).
3. everything after is keyed by ``race_id``: the runs are repartitioned once
   by ``race_id``; the pooled top-n per (race_id, ketto_num), the aggregate,
   the join back to the entries and the per-race field statistics all reuse
   that partitioning. A race holds a bounded number of runners (horse numbers
   are two characters), so this key cannot be skewed.
4. the speed-index master is looked up by (surface, key); its two lookup
   sides are made unique first, so the joins cannot fan out, and AQE turns
   them into broadcast joins only when their measured size is small.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong.functions.text import nfkc, number, sql_lpad, trim_ws
from furlong.operators.serving import race_header, validate_race_id
from furlong.session import materialize
from furlong.sources.stored import store_sorted

HISTORY_COLS = ["race_date", "rank", "popularity", "distance", "surface", "time_sec"]

MASTER_SCHEMA = T.StructType([
    T.StructField("horse_key", T.StringType()), T.StructField("horse_name", T.StringType()),
    T.StructField("surface", T.StringType()), T.StructField("speed_index", T.DoubleType()),
    T.StructField("run_count", T.LongType()),
])


def null_spread_key(key: Column, *row_cols: str) -> Column:
    """A LEFT-join key in which NULLs never match and do not pile up.

    SQL NULL keys never match, but a hash partitioner sends every NULL to one
    reducer: with a third of the rows lacking a key, that reducer would get a
    third of the data. A NULL key becomes a per-row value that no right-side
    key can equal (a NUL-prefixed hash of the row, deterministic on retry),
    so the rows spread and still find no partner. Hot non-NULL keys are split
    by AQE's skew-join handling.
    """
    return F.coalesce(key, F.concat(F.lit("\u0000"), F.xxhash64(*row_cols).cast("string")))


def history_order() -> list[Column]:
    """Most recent first (the reference's only key), then every value the
    aggregates read, so tied runs are interchangeable and results are exact."""
    return [F.col("race_date").desc_nulls_last(), F.col("rank").asc_nulls_last(),
            F.col("popularity").asc_nulls_last(), F.col("distance").asc_nulls_last(),
            F.col("surface").asc_nulls_last(), F.col("time_sec").asc_nulls_last()]


def target_races(races: DataFrame, race_id: str | None = None) -> DataFrame:
    """Distance and surface initial of each target race (one row per race)."""
    h = race_header(races, race_id)
    course = trim_ws("course")
    return h.select(
        "race_id", F.col("kaisai_date").alias("target_date"),
        F.col("kyori").cast("long").alias("target_distance"),
        F.when(F.col("course").isNull() | (course == ""), F.lit(None).cast("string"))
        .otherwise(F.substring(course, 1, 1)).alias("target_surface"))


def analysis_entries(entries: DataFrame, race_id: str | None = None) -> DataFrame:
    e = entries if race_id is None else entries.filter(F.col("race_id") == F.lit(race_id))
    return e.select(
        "race_id", trim_ws("wakuban").alias("wakuban"), sql_lpad(trim_ws("umaban"), 2).alias("umaban"),
        trim_ws("ketto_num").alias("ketto_num"), trim_ws("bamei").alias("bamei"))


def history_runs(history: DataFrame) -> DataFrame:
    """Typed past runs keyed by the NFKC-normalised, trimmed horse name; a
    history that was stored in this form is taken as it is."""
    if {"name_norm", *HISTORY_COLS} == set(history.columns):
        return history
    return history.select(
        nfkc(trim_ws("horse_name")).alias("name_norm"),
        F.col("race_date").cast("date").alias("race_date"),
        number("rank").alias("rank"),
        number("popularity").alias("popularity"),
        number("distance").alias("distance"),
        trim_ws("surface").alias("surface"),
        number("time_sec").alias("time_sec"),
    ).filter(F.col("name_norm").isNotNull())


def runs_as_of(entries: DataFrame, runs: DataFrame, n: int) -> DataFrame:
    """The runs of :func:`newest_as_of`, one a row; an all-NULL run where there
    is none."""
    return newest_as_of(entries, runs, n).select(*entries.columns, F.explode_outer("newest").alias("run")).select(*entries.columns, "run.*")


def newest_as_of(entries: DataFrame, runs: DataFrame, n: int) -> DataFrame:
    """Each entry (with ``name_norm`` and ``_tdate``) with the newest ``n`` runs
    of its name dated before ``_tdate``, as the list ``newest`` (NULL or empty
    where there is none).

    A blocked prefix scan. The block is a name's day: of its runs only the best
    ``n`` can ever be among the newest, and that limit already holds in the map
    tasks, so a name with most of the runs is work for all of them. Blocks are
    mergeable (the last ``n`` of several days are the last ``n`` of their
    lists); they are combined over the days of a year and over the years, which
    the calendar bounds, for each different (name, day) that is asked for. The
    entries then join what was found for their day; a hot name is split there.
    """
    day = Window.partitionBy("name", "race_date").orderBy(*history_order()[1:])
    best = (runs.filter(F.col("race_date").isNotNull()).withColumnRenamed("name_norm", "name")
            .withColumn("nth", F.row_number().over(day)).filter(F.col("nth") <= n))
    run = F.struct(*HISTORY_COLS)
    days = best.groupBy("name", "race_date").agg(F.sort_array(F.collect_list(F.struct("nth", run.alias("run")))).alias("x"))
    days = days.select("name", F.year("race_date").alias("year"), F.col("race_date").alias("at"), F.col("x.run").alias("runs"))
    lists = days.schema["runs"].dataType
    key = F.nullif("name_norm", F.lit(""))
    asked = entries.select(key.alias("name"), F.year("_tdate").alias("year"), F.col("_tdate").alias("at")).dropna().distinct()
    newest_of = lambda lists: F.slice(F.flatten(F.reverse(lists)), 1, n)
    # The days and what is asked cross one shuffle, each run once. A day asked
    # for comes before the runs of that day; "nth" numbers the days of a year,
    # so a range of it holds the last n of them however many were asked for.
    events = days.withColumn("runs_day", F.lit(True)).unionByName(asked.withColumns({"runs": F.lit(None).cast(lists), "runs_day": F.lit(False)}))
    year = Window.partitionBy("name", "year")
    events = events.withColumn("nth", F.count_if("runs_day").over(year.orderBy("at", "runs_day").rowsBetween(Window.unboundedPreceding, 0)))
    events = events.withColumn("hist", newest_of(F.collect_list("runs").over(year.orderBy("nth").rangeBetween(-(n - 1), 0)))).drop("runs")
    # stored: read once for the years and once for the days asked for, of which no other has a list
    last = F.row_number().over(year.orderBy(F.col("nth").desc(), F.col("runs_day").desc())) == 1
    events = materialize(events.withColumn("last", last).filter(~F.col("runs_day") | F.col("last")), "runs-by-year")
    before = F.collect_list("hist").over(Window.partitionBy("name").orderBy("year").rowsBetween(Window.unboundedPreceding, -1))
    years = events.filter("last").select("name", "year", newest_of(before).alias("earlier"))
    found = events.filter(~F.col("runs_day")).join(years, ["name", "year"], "left")
    empty = F.array().cast(lists)
    newest = F.slice(F.concat(F.coalesce("hist", empty), F.coalesce("earlier", empty)), 1, n)
    # stored, so that the join shuffles both sides and AQE can split a hot name
    found = materialize(found.select(F.col("name").alias("_name"), F.col("at").alias("_at"), newest.alias("newest")), "runs-as-of")
    e = entries.withColumn("_key", null_spread_key(key, *entries.columns))
    met = e.join(found, (F.col("_key") == F.col("_name")) & (F.col("_tdate") == F.col("_at")), "left")
    return met.select(*entries.columns, "newest")


ENTRY_COLS = ["race_id", "wakuban", "umaban", "ketto_num", "bamei"]


def form_runs(entries: DataFrame, history: DataFrame, n: int = 5, before_race: bool = False,
              races: DataFrame | None = None, only_entry_names: bool = False) -> DataFrame:
    """Every entry with its candidate runs, ranked per (race_id, ketto_num).

    Each entry has at least one row (an all-NULL run when nothing matched, as
    the reference's LEFT JOIN gives) and at most ``n`` matched runs; ``rn``
    ranks the pooled runs of all entries sharing (race_id, ketto_num). The
    result is hash-partitioned by ``race_id`` and carries ``name_norm`` (the
    NFKC name of the entry) for the later name lookup.

    ``only_entry_names`` (used for a single race) first keeps only the runs
    whose name belongs to one of the entries; exact, because the top-n window
    below is partitioned by that same name.
    """
    runs = history_runs(history)
    e = entries.withColumn("name_norm", nfkc(F.col("bamei")))
    if only_entry_names:
        # a race has at most a hundred runners; the literal names reach the scan,
        # where a history stored by name prunes all other row groups
        names = [r.name_norm for r in e.select("name_norm").filter(F.col("name_norm").isNotNull()).distinct().collect()]
        runs = runs.filter(F.col("name_norm").isin(names))
    r = runs.withColumnRenamed("name_norm", "_run_name")
    if before_race:
        if races is None:
            raise ValueError("before_race=True needs races")
        dates = race_header(races).select("race_id", F.col("kaisai_date").alias("_tdate"))
        j = newest_as_of(e.join(dates, "race_id", "left"), runs, n)
    else:
        top = (r.withColumn("_r", F.row_number().over(
            Window.partitionBy("_run_name").orderBy(*history_order())))
            .filter(F.col("_r") <= n).drop("_r"))
        # one row a name: an entry crosses the shuffles once, its runs in a list
        top = top.groupBy("_run_name").agg(F.collect_list(F.struct(*HISTORY_COLS)).alias("newest"))
        if not only_entry_names:
            # stored, so that the join shuffles this side too: AQE splits a hot
            # name only where both sides of the join are plain shuffles
            top = materialize(top, "newest-runs")
        j = e.join(top, null_spread_key(F.col("name_norm"), "race_id", "umaban", "bamei") == F.col("_run_name"),
                   "left")
    j = j.select(*e.columns, "newest").repartition("race_id").select(*e.columns, F.explode_outer("newest").alias("run"))
    j = j.select(*e.columns, "run.*")
    w = Window.partitionBy("race_id", "ketto_num").orderBy(
        *history_order(), F.col("umaban").asc_nulls_last(), F.col("wakuban").asc_nulls_last(),
        F.col("bamei").asc_nulls_last())
    return j.withColumn("rn", F.row_number().over(w))


def store_history(history: DataFrame, path: str) -> None:
    """Store past runs normalised once and sorted by name, for single reads."""
    store_sorted(history_runs(history), path, "name_norm")


def form_history(entries: DataFrame, history: DataFrame, n: int = 5,
                 before_race: bool = False, races: DataFrame | None = None) -> DataFrame:
    """Last ``n`` runs per entry, matched by normalised name and pooled per
    (race_id, ketto_num) (C9: J1 + W5).

    Plan: newest ``n`` runs per normalised name first (row_number <= n, with
    a partial WindowGroupLimit before the shuffle), then the LEFT JOIN, then
    the pooled rank. Any top-n of a union lies in the union of top-ns, so the
    pre-limit is exact; ``before_race=True`` (needs ``races``) takes the newest
    ``n`` runs dated before the target race (:func:`runs_as_of`).
    """
    return form_runs(entries, history, n, before_race, races).filter(F.col("rn") <= n)


def form_features(runs: DataFrame, targets: DataFrame, n: int = 5) -> DataFrame:
    """Per-entry form aggregates over the pooled history (C10: J2, J5, A2-A7).

    ``runs`` is the output of :func:`form_runs` (every entry present). It is
    joined to ``targets`` on race_id (the batch form of the reference's
    one-row CROSS JOIN: an entry whose race is missing yields no row, in
    both). Both sides are partitioned by race_id already, so the join and the
    aggregate per (race_id, ketto_num), which also holds the entries (a race's
    runners at most), add no shuffle, and the runs are shuffled and ranked
    once. An entry without a usable history gets starts 0, NULL
    averages and rates 0.0, exactly as the reference's LEFT JOIN gives.
    """
    rt = runs.join(targets, "race_id")
    target_cols = [c for c in targets.columns if c != "race_id"]
    used = (F.col("rn") <= n) & F.col("ketto_num").isNotNull()
    of = {c: F.when(used, F.col(c)) for c in HISTORY_COLS}
    rate = lambda pred: F.avg(F.when(used, F.when(pred, F.lit(1.0)).otherwise(F.lit(0.0))))
    f = rt.groupBy("race_id", "ketto_num").agg(
        F.collect_set(F.struct(*[c for c in ENTRY_COLS if c not in ("race_id", "ketto_num")], "name_norm", *target_cols)).alias("_entries"),
        F.count(of["race_date"]).alias("starts"),
        F.avg(of["rank"]).alias("avg_rank"),
        F.avg(F.when(F.col("rn") <= 3, of["rank"])).alias("avg_rank_recent"),
        rate(F.col("rank") == 1).alias("win_rate"),
        rate(F.col("rank") <= 3).alias("top3_rate"),
        rate(F.substring(trim_ws("surface"), 1, 1) == F.col("target_surface")).alias("surface_match_rate"),
        rate(F.abs(F.col("distance") - F.col("target_distance")) <= 200).alias("distance_match_rate"),
        F.avg(F.when(F.col("time_sec") > 0, of["distance"] / F.col("time_sec"))).alias("avg_speed"),
        F.avg(of["popularity"]).alias("avg_popularity"),
        F.max(of["race_date"]).alias("last_race_date"))
    f = f.select("*", F.explode("_entries").alias("_e")).select("_e.*", *[c for c in f.columns if c != "_entries"])
    zero = F.lit(0.0)
    return f.select(
        *ENTRY_COLS, "name_norm", *target_cols, "starts",
        "avg_rank", "avg_rank_recent",
        F.coalesce("win_rate", zero).alias("win_rate"),
        F.coalesce("top3_rate", zero).alias("top3_rate"),
        F.coalesce("surface_match_rate", zero).alias("surface_match_rate"),
        F.coalesce("distance_match_rate", zero).alias("distance_match_rate"),
        "avg_speed", "avg_popularity", "last_race_date")


def field_speed_z(features: DataFrame) -> DataFrame:
    """z-score of average speed within the field (C11, A8): a window over
    race_id (no self-join); 0 when the sd is NULL or 0 or the speed is NULL."""
    w = Window.partitionBy("race_id")
    mean = F.avg("avg_speed").over(w)
    sd = F.stddev_pop("avg_speed").over(w)
    return (features.withColumn("_mean", mean).withColumn("_sd", sd)
            .withColumn("speed_z", F.when(F.col("_sd").isNull() | (F.col("_sd") == 0) |
                                          F.col("avg_speed").isNull(), F.lit(0.0))
                        .otherwise((F.col("avg_speed") - F.col("_mean")) / F.col("_sd")))
            .drop("_mean", "_sd"))


def empty_master(spark: SparkSession) -> DataFrame:
    """The typed empty master of the reference's fallback branch."""
    return spark.createDataFrame([], MASTER_SCHEMA)


def master_lookups(master: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unique lookup sides of the speed-index master."""
    m = master.select(
        trim_ws(F.col("horse_key").cast("string")).alias("horse_key"),
        nfkc(trim_ws(F.col("horse_name").cast("string"))).alias("horse_name_norm"),
        trim_ws(F.col("surface").cast("string")).alias("surface"),
        number("speed_index").alias("speed_index"),
        F.col("run_count").try_cast("long").alias("run_count"),
    ).filter(F.col("speed_index").isNotNull())
    by_id = (m.filter(F.col("horse_key").isNotNull() & (F.col("horse_key") != ""))
             .groupBy("surface", "horse_key").agg(F.max("speed_index").alias("speed_index_id")))
    by_name = (m.filter(F.col("horse_name_norm").isNotNull() & (F.col("horse_name_norm") != ""))
               .groupBy("surface", "horse_name_norm")
               .agg(F.max_by("speed_index", F.struct("run_count", "speed_index")).alias("speed_index_name")))
    return by_id, by_name


def speed_lookup(scored: DataFrame, master: DataFrame | None) -> DataFrame:
    """Master speed index by horse id, else by normalised name, else
    ``100 + 10 * speed_z`` (C12: S8, J3, J4)."""
    if master is None:
        master = empty_master(scored.sparkSession)
    by_id, by_name = master_lookups(master)
    s = scored if "name_norm" in scored.columns else scored.withColumn("name_norm", nfkc(F.col("bamei")))
    # blank keys are in no lookup side, so they are spread like NULLs
    id_key = null_spread_key(F.nullif(s.ketto_num, F.lit("")), "race_id", "umaban")
    name_key = null_spread_key(F.nullif(s.name_norm, F.lit("")), "race_id", "umaban")
    s = s.join(by_id, (by_id.surface == s.target_surface) & (by_id.horse_key == id_key), "left") \
         .drop("surface", "horse_key")
    s = s.join(by_name, (by_name.surface == s.target_surface) & (by_name.horse_name_norm == name_key),
               "left").drop("surface", "horse_name_norm")
    sid, snm = F.col("speed_index_id"), F.col("speed_index_name")
    return (s.withColumn("speed_index_final", F.coalesce(sid, snm, F.lit(100.0) + F.col("speed_z") * 10.0))
             .withColumn("speed_factor", F.coalesce(F.try_divide(sid - 100.0, F.lit(10.0)),
                                                    F.try_divide(snm - 100.0, F.lit(10.0)), F.col("speed_z")))
             .withColumn("speed_source", F.when(sid.isNotNull(), F.lit("master_id"))
                         .when(snm.isNotNull(), F.lit("master_name")).otherwise(F.lit("fallback"))))


def tokyo_date(local: Column) -> Column:
    """Date in Tokyo at a local (session time zone) time without zone."""
    return F.to_date(F.convert_timezone(None, F.lit("Asia/Tokyo"), local))


def default_as_of() -> Column:
    """CURRENT_DATE('Asia/Tokyo') regardless of the session time zone."""
    return tokyo_date(F.localtimestamp())


def score_expr(as_of: Column) -> Column:
    """The clamped linear analysis score (C13), rounded to 1 decimal."""
    def z(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0))
    starts, last = F.col("starts"), F.col("last_race_date")
    raw = (F.lit(52.0)
           + z((F.lit(8.0) - F.col("avg_rank_recent")) * 5.0)
           + z(F.col("top3_rate") * 16.0) + z(F.col("win_rate") * 10.0)
           + z(F.col("surface_match_rate") * 8.0) + z(F.col("distance_match_rate") * 6.0)
           + z(F.col("speed_factor") * 6.0)
           - z(F.greatest(F.col("avg_popularity") - 8.0, F.lit(0.0)) * 1.2)
           - F.when(starts.isNull() | (starts == 0), F.lit(14.0)).when(starts < 3, F.lit(4.0)).otherwise(F.lit(0.0))
           - F.when(last.isNull(), F.lit(2.0)).when(F.datediff(as_of, last) > 180, F.lit(3.0))
           .otherwise(F.lit(0.0)))
    return F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw)), 1)


def _as_of_col(as_of) -> Column:
    if as_of is None:
        return default_as_of()
    if isinstance(as_of, (str, _dt.date)):
        return F.lit(str(as_of)).cast("date")
    return as_of


def analysis_score(enriched: DataFrame, as_of=None) -> DataFrame:
    """Final analysis rows (C13): rounded outputs and the score."""
    return enriched.select(
        "race_id", "wakuban", "umaban", "ketto_num", "bamei",
        F.col("starts").cast("long").alias("starts"),
        F.round("avg_rank", 2).alias("avg_rank"),
        F.round(F.col("win_rate") * 100.0, 1).alias("win_rate"),
        F.round(F.col("top3_rate") * 100.0, 1).alias("top3_rate"),
        F.round(F.col("surface_match_rate") * 100.0, 1).alias("surface_match_rate"),
        F.round(F.col("distance_match_rate") * 100.0, 1).alias("distance_match_rate"),
        F.round("speed_index_final", 1).alias("speed_index"),
        "speed_source",
        score_expr(_as_of_col(as_of)).alias("analysis_score"),
        F.date_format("last_race_date", "yyyy-MM-dd").alias("last_race_date"))


def race_analysis(races: DataFrame, entries: DataFrame, history: DataFrame,
                  master: DataFrame | None = None, race_id: str | None = None,
                  as_of=None, n: int = 5, before_race: bool = False, ordered: bool = False) -> DataFrame:
    """Form-and-score analysis (C14) of one race (``race_id``) or of all races.

    The single-race form validates the id (``InvalidRaceId``) and pushes the
    id filter to both serving-table scans, and is in display order (numeric
    horse number). All races come unsorted; ``ordered=True`` clusters them by
    race, in display order within each partition, at the cost of a shuffle.
    """
    if race_id is not None:
        validate_race_id(race_id)
    targets = target_races(races, race_id)
    e = analysis_entries(entries, race_id)
    runs = form_runs(e, history, n=n, before_race=before_race, races=races,
                     only_entry_names=race_id is not None)
    feats = form_features(runs, targets, n)
    scored = field_speed_z(feats)
    enriched = speed_lookup(scored, master)
    out = analysis_score(enriched, as_of)
    order = ["race_id", F.col("umaban").try_cast("long").asc_nulls_first(), "umaban"]
    if race_id is not None:
        return out.orderBy(*order)
    return out.repartition("race_id").sortWithinPartitions(*order) if ordered else out
