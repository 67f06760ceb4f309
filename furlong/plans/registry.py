"""Registered query keys: Spark plans over the provided tables, and their
DuckDB oracle statements."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.functions import codes, race_id as rid
from furlong.operators import form, latest, parse, quality, serving, speed_index as SI
from furlong.plans import bindings as B
from furlong.plans import oracle_sql as O

AS_OF = O.AS_OF


def model(spark: SparkSession, d: str, *names: str) -> dict[str, DataFrame]:
    """Serving tables and history; ``names`` are the bindings that are used."""
    names = names or ("results", "raw_se", "history")
    with B.shared_base(spark, d, list(names)):
        m: dict[str, DataFrame] = {}
        if "results" in names:
            m["results"] = B.results(spark, d)
            m["summary"] = serving.race_summary(m["results"])
            m["races"] = serving.serving_races(m["summary"])
        if "raw_se" in names:
            fallback = serving.entry_fallback(m["results"])
            m["entries"] = serving.serving_entries(latest.latest_entries(B.raw_se(spark, d)), fallback)
        if "history" in names:
            m["history"] = B.history(spark, d)
        return m


def _r6(cols):
    return [F.round(c, 6).alias(c) for c in cols]


def q_latest_races(spark, d):
    return latest.latest_races(B.raw_ra(spark, d))


def q_latest_entries(spark, d):
    return latest.latest_entries(B.raw_se(spark, d))


def q_stage_dedup(spark, d):
    return latest.stage_dedup(B.stage_rows(spark, d).drop("l_suppkey"), latest.MERGE_KEYS["SE"])


def q_upsert_latest(spark, d):
    first, second = B.stage_batches(spark, d)
    keys = latest.MERGE_KEYS["SE"]
    return latest.upsert_latest(latest.upsert_latest(None, first, keys), second, keys)


def q_race_summary(spark, d):
    return serving.race_summary(B.results(spark, d))


def q_entry_fallback(spark, d):
    return serving.entry_fallback(B.results(spark, d))


def q_serving_races(spark, d):
    return model(spark, d, "results")["races"]


def q_serving_entries(spark, d):
    return model(spark, d, "results", "raw_se")["entries"]


def q_race_list(spark, d):
    return serving.race_list(model(spark, d, "results")["races"], 50)


def q_race_card_all(spark, d):
    m = model(spark, d, "results", "raw_se")
    return serving.race_card(m["races"], m["entries"])


def _min_race(races: DataFrame) -> str:
    # One bounded value (an explicit single-race read), not data.
    return races.agg(F.min("race_id")).first()[0]


def _served(spark, d, *names):
    """The named serving tables, stored for point reads: a build step writes
    them, and a single-race read prunes them by race id and by name."""
    from furlong.sources.stored import store_sorted
    base = _scratch(spark, "served")
    needs = {"races": ["results"], "entries": ["results", "raw_se"], "history": ["history"], "master": ["history"]}
    m = model(spark, d, *dict.fromkeys(x for n in names for x in needs[n]))

    def write(n):
        if n == "history":
            form.store_history(m[n], f"{base}/{n}")
        elif n == "master":
            store_sorted(B.derived_master(m["history"]), f"{base}/{n}", "horse_name")
        else:
            store_sorted(m[n], f"{base}/{n}", "race_id")
    with ThreadPoolExecutor(len(names)) as pool:   # independent tables: their jobs run side by side
        list(pool.map(write, names))
    return {n: spark.read.parquet(f"{base}/{n}") for n in names}


def q_race_card_one(spark, d):
    m = _served(spark, d, "races", "entries")
    return serving.race_card(m["races"], m["entries"], _min_race(m["races"]))


def q_race_id_parts(spark, d):
    r = model(spark, d, "results")["races"]
    p = rid.race_id_parts("race_id")
    return r.select(
        "race_id", p["year"].alias("year"), p["month_day"].alias("month_day"), p["jyo_cd"].alias("jyo_cd"),
        p["kaiji"].alias("kaiji"), p["nichiji"].alias("nichiji"), p["race_num"].alias("race_num"),
        rid.build_race_id(p["year"], p["month_day"], p["jyo_cd"], p["kaiji"], p["nichiji"], p["race_num"])
        .alias("rebuilt_id"),
        rid.format_race_date(p["year"], p["month_day"]).alias("race_date_text"),
        codes.venue_name(p["jyo_cd"]).alias("venue"),
        rid.is_race_id("race_id").alias("is_valid"))


def q_code_lookup(spark, d):
    s = model(spark, d, "results")["summary"]
    kn = rid.kaiji_nichiji("kaisai")
    return s.select("ymd", "venue", "kaisai", "race_num",
                    codes.venue_code("venue").alias("code_or_null"),
                    codes.venue_code("venue", "00").alias("code_or_00"),
                    codes.venue_name(codes.venue_code("venue")).alias("venue_back"),
                    kn["kaiji"].alias("kaiji"), kn["nichiji"].alias("nichiji"))


def _analysis_parts(spark, d):
    from furlong.session import materialize
    m = model(spark, d)
    targets = form.target_races(m["races"])
    # stored, so that what the entries were shuffled in goes before the runs join them
    e = materialize(form.analysis_entries(m["entries"]), "entries")
    runs = form.form_runs(e, m["history"])
    return m, targets, e, runs


def q_form_history(spark, d):
    m = model(spark, d)
    hist = form.form_history(form.analysis_entries(m["entries"]), m["history"])
    return hist.select("race_id", "wakuban", "umaban", "ketto_num", "bamei", "race_date", "rank", "popularity",
                       "distance", "surface", "time_sec", F.col("rn").cast("long").alias("rn"))


def q_form_history_before(spark, d):
    """The newest runs before each race, as known on the race's day."""
    m = model(spark, d)
    hist = form.form_history(form.analysis_entries(m["entries"]), m["history"], before_race=True, races=m["races"])
    return hist.select("race_id", "wakuban", "umaban", "ketto_num", "bamei", "race_date", "rank", "popularity",
                       "distance", "surface", "time_sec", F.col("rn").cast("long").alias("rn"))


def q_form_features(spark, d):
    _, targets, e, runs = _analysis_parts(spark, d)
    f = form.form_features(runs, targets)
    return f.select("race_id", "wakuban", "umaban", "ketto_num", "bamei", "target_date", "target_distance",
                    "target_surface", "starts", *_r6(O.FEATURE_DOUBLES), "last_race_date")


def q_field_speed_z(spark, d):
    _, targets, e, runs = _analysis_parts(spark, d)
    z = form.field_speed_z(form.form_features(runs, targets))
    return z.select("race_id", "umaban", "ketto_num", *_r6(["avg_speed", "speed_z"]))


def q_speed_lookup(spark, d):
    m, targets, e, runs = _analysis_parts(spark, d)
    z = form.field_speed_z(form.form_features(runs, targets))
    s = form.speed_lookup(z, B.derived_master(m["history"]))
    return s.select("race_id", "umaban", "ketto_num", *_r6(["speed_index_final", "speed_factor"]), "speed_source")


def q_race_analysis_all(spark, d):
    m = model(spark, d)
    return form.race_analysis(m["races"], m["entries"], m["history"], B.derived_master(m["history"]),
                              as_of=AS_OF)


def q_race_analysis_one(spark, d):
    m = _served(spark, d, "races", "entries", "history", "master")
    return form.race_analysis(m["races"], m["entries"], m["history"], m["master"],
                              race_id=_min_race(m["races"]), as_of=AS_OF)


UNKNOWN_RACE = "0000000000000000"


def q_race_page(spark, d):
    m = _served(spark, d, "races", "entries")
    return serving.race_page(m["races"], m["entries"], [_min_race(m["races"]), UNKNOWN_RACE])


def q_analysis_no_master(spark, d):
    """The analysis where no index was ever built: speed from the field alone."""
    from furlong.sources import tables
    m = model(spark, d)
    master = tables.optional_table(spark, _scratch(spark, "no-master"), form.MASTER_SCHEMA)
    return form.race_analysis(m["races"], m["entries"], m["history"], master, as_of=AS_OF)


def q_analysis_score(spark, d):
    a = q_race_analysis_all(spark, d)
    return a.select("race_id", "umaban", "analysis_score", codes.score_band("analysis_score").alias("score_band"))


def _history_min(spark, d):
    return B.history(spark, d).select("ketto_num", "horse_name", "surface", "time_sec", "distance")


def q_index_source(spark, d):
    n = SI.normalize_source(SI.index_source(B.history(spark, d)))
    return n.select("horse_key", "horse_name", "surface", "time_sec", "distance", "weight", "num_horses", "age",
                    "track_condition", "venue", "class_name", "sex",
                    F.round("log_time", 9).alias("log_time"), F.round("log_dist", 9).alias("log_dist"))


def q_speed_index_log_dist(spark, d):
    return SI.speed_index_master(_history_min(spark, d), as_of=AS_OF)


def q_speed_index_full(spark, d):
    return SI.speed_index_master(B.history(spark, d), as_of=AS_OF)


def q_speed_index_three(spark, d):
    """Three predictors: log distance, weight and a one-hot category with
    NULLs (track condition; NULL pools with the dropped first level)."""
    src = B.history(spark, d).select("ketto_num", "horse_name", "surface", "time_sec", "distance", "weight",
                                     "track_condition")
    return SI.speed_index_master(src, as_of=AS_OF)


def q_speed_baseline(spark, d):
    return SI.speed_index_baseline(q_speed_index_log_dist(spark, d))


FETCHED_AT = "2026-01-01T00:00:00"


def q_parse_fixed_width(spark, d):
    return parse.parse_records(B.text_records(spark, d), fetched_at=FETCHED_AT)


def q_parse_lanes(spark, d):
    p = parse.parse_records(B.docs_raw(spark, d), fetched_at=FETCHED_AT)
    return p.groupBy("record_type", parse.lane(p).alias("lane")).agg(F.count(F.lit(1)).alias("n"))


def q_record_census(spark, d):
    return parse.record_census(q_parse_fixed_width(spark, d))


def q_sample_by_type(spark, d):
    s = parse.sample_by_type(q_parse_fixed_width(spark, d), ["RA", "SE", "JG"])
    return s.select("record_type", "RaceNum", "Hondai", "Kyori", "TrackCD",
                    codes.track_name("TrackCD").alias("track"), "Umaban", "Bamei", "KettoNum", "HorseName",
                    "raw_data")


def q_layout_profile(spark, d):
    t = B.text_records(spark, d)
    return parse.layout_profile(t.withColumn("record_type", F.substring("raw_data", 1, 2)))


def q_layout_cuts(spark, d):
    """Field cuts that the bytes of all records propose, by type."""
    t = B.text_records(spark, d)
    cuts = parse.layout_cuts(t.withColumn("record_type", F.substring("raw_data", 1, 2)))
    return cuts.select("record_type", "offset", "n_records", F.round("entropy", 6).alias("entropy"), F.round("change", 6).alias("change"), "cut")


def q_layout_ranges(spark, d):
    """Chosen byte ranges of each type's first records, in hex and decoded."""
    return parse.layout_ranges(q_parse_fixed_width(spark, d), {"RA": [(0, 2), (27, 36), (697, 701)], "SE": [(11, 19), (28, 30), (40, 76)]}, 3)


def q_check_projection(spark, d):
    return parse.check_projection(q_parse_fixed_width(spark, d), "RA", ["RaceNum", "Hondai", "Kyori", "TrackCD"], 5)


FULL_WIDTH = str.maketrans("H0123456789", "Ｈ０１２３４５６７８９")


def q_nfkc_match(spark, d):
    """Runs whose name is written in full-width forms (every even rank) must
    still match the ASCII names of the results through NFKC."""
    h = B.history(spark, d)
    src, dst = "H0123456789", "H0123456789".translate(FULL_WIDTH)
    h = h.withColumn("horse_name", F.when(F.col("rank") % 2 == 0, F.translate("horse_name", src, dst))
                     .otherwise(F.col("horse_name")))
    runs = form.history_runs(h)
    names = B.results(spark, d).select(F.col("horse_name").alias("name")).distinct()
    j = names.join(runs, names.name == runs.name_norm)
    return j.groupBy("name").agg(F.count(F.lit(1)).alias("n_runs"), F.max("race_date").alias("last_date"))


def _quality_inputs(spark, d):
    m = model(spark, d, "results", "raw_se")
    return m["races"], m["entries"]


def _races(spark, d):
    return model(spark, d, "results")["races"]


def q_dup_races(spark, d):
    return quality.duplicate_races(_races(spark, d))


def q_dup_entries(spark, d):
    return quality.duplicate_entries(_quality_inputs(spark, d)[1])


def q_null_rate(spark, d):
    return quality.null_rate(_races(spark, d))


def q_freshness(spark, d):
    return quality.freshness(_races(spark, d), AS_OF)


def q_quality_report(spark, d):
    r, e = _quality_inputs(spark, d)
    return quality.quality_report(r, e, AS_OF)


def _scratch(spark, name):
    import uuid
    from furlong.session import scratch_path
    return scratch_path(spark, "runs", f"{name}-{uuid.uuid4().hex[:12]}")


def _landed(spark, d):
    from furlong.sources import landing
    root = _scratch(spark, "landing")
    landing.write_landing(q_parse_fixed_width(spark, d), root)
    B.bad_json_lines(spark, d).write.mode("append").text(f"{root}/type_tag=BAD/ingest_date=00000000")
    return root


def q_jsonl_land_and_load(spark, d):
    from furlong.sources import landing
    df = landing.read_landing(spark, _landed(spark, d))
    return parse.record_census(df, corrupt_col=landing.CORRUPT)


def q_reparse_backfill(spark, d):
    from furlong.operators.parse import LANDING_SCHEMA
    from furlong.sources import landing
    root = _landed(spark, d)
    B.no_raw_lines(spark, d).write.mode("append").text(f"{root}/type_tag=NORAW/ingest_date=00000000")
    out_dir = _scratch(spark, "backfill")
    landing.write_lines(landing.reparse_lines(spark, root), out_dir)
    raw = F.get_json_object("line", "$.raw_data")
    lines = spark.read.text(out_dir).select(F.col("value").alias("line")).select(
        "line", F.from_json("line", LANDING_SCHEMA).alias("rec"), (raw.isNull() | (raw == "")).alias("passthrough"))
    passthrough = F.col("passthrough")
    return lines.select(
        *[F.when(~passthrough, F.col("rec")[c]).alias(c) for c in
          ["record_type", "_parsed", "error", "Year", "RaceNum", "Hondai", "Bamei", "HorseName", "raw_body",
           "fetched_at", "raw_data"]],
        passthrough.alias("passthrough"), F.when(passthrough, F.col("line")).alias("line"))


def _built(spark, d, only=None):
    from furlong.plans import runner
    from furlong.sources import landing, tables
    base = _scratch(spark, "warehouse")
    raw = tables.layer_path(base, "raw")
    if only:
        tables.replace_table(B.history(spark, d), f"{raw}/analysis_view")
    landing.append_raw(B.raw_ra(spark, d), raw, "RA")
    landing.append_raw(B.raw_se(spark, d), raw, "SE")
    tables.replace_table(B.results(spark, d), f"{raw}/race_results")
    prefix = "w" + base.rsplit("-", 1)[-1]
    try:
        return runner.run_steps(spark, base, only or sorted(runner.STEPS)[:3], as_of=AS_OF, prefix=prefix)
    finally:
        tables.drop_layers(spark, prefix)   # the result is read from the tables' files


def q_layered_build(spark, d):
    return _built(spark, d).outputs["quality_report"]


def q_fitted_speed_lookup(spark, d):
    """Raw tables -> serving tables and fitted index, all stored -> every
    runner's speed figures from the stored master."""
    from furlong.plans import runner
    ctx = _built(spark, d, sorted(runner.STEPS))
    races, entries = ctx.read("serving", "serving_races"), ctx.read("serving", "serving_entries")
    runs = form.form_runs(form.analysis_entries(entries), ctx.read("raw", "analysis_view"))
    z = form.field_speed_z(form.form_features(runs, form.target_races(races)))
    s = form.speed_lookup(z, ctx.read("ml", "speed_index_master"))
    return s.select("race_id", "umaban", "ketto_num", F.round("speed_index_final", 4).alias("speed_index_final"),
                    F.round("speed_factor", 5).alias("speed_factor"), "speed_source")


def _streamed(spark, d, merge_types=None, replay=False, second_run=False):
    """Two landings whose keys overlap, each ingested as a micro-batch: all
    records, then the runners with an odd number again, renamed. In a second
    run the other landing is ingested by a query of its own. A landing goes
    when nothing reads it any more: its rows are in the raw tables."""
    from furlong.sources import fs, landing
    from furlong.streaming import ingest
    land, work = _scratch(spark, "stream-landing"), _scratch(spark, "stream")
    again, batch = ("first", 0) if second_run else ("second", 1)   # a batch of before, by hand; where there was one query, it is its last
    landing.write_landing(q_parse_fixed_width(spark, d), f"{land}/first")
    runs = []
    for name in ("first", "second"):
        if name == "second":   # of the runners as they were landed: the feed is not built and parsed again
            runners = landing.read_landing(spark, f"{land}/first").filter((F.col("file_type") == "SE") & (F.col("Umaban").try_cast("int") % 2 == 1))
            landing.write_landing(runners.withColumn("Bamei", F.concat(F.lit("R"), "Bamei")), f"{land}/second")
            if not (replay and again == "first"):
                fs.delete(spark, f"{land}/first")
        source, mark = (f"{land}/{name}", f"_checkpoint-{name}") if second_run else (land, "_checkpoint")
        q = ingest.run_ingest(spark, source, f"{work}/raw", f"{work}/core", f"{work}/{mark}", merge_types)
        runs.append(str(q.id))
    if replay:
        if again == "first":
            fs.delete(spark, f"{land}/second")
        lines = spark.read.option("recursiveFileLookup", "true").text(f"{land}/{again}")
        ingest.make_batch_handler(f"{work}/raw", f"{work}/core", merge_types, runs[0])(landing.parse_json_lines(lines), batch)
    fs.delete(spark, land)
    return work


def q_stream_ingest(spark, d):
    from furlong.operators.parse import LANDING_COLUMNS
    from furlong.sources import tables
    return tables.read_latest(spark, f"{_streamed(spark, d)}/core/SE_latest").select(*LANDING_COLUMNS)


def _latest_and_raw(spark, work):
    from furlong.operators.parse import LANDING_COLUMNS
    from furlong.sources import landing, tables
    latest_se = tables.read_latest(spark, f"{work}/core/SE_latest").select(F.lit("latest").alias("kind"), *LANDING_COLUMNS)
    return latest_se.unionByName(landing.read_raw(spark, f"{work}/raw", "SE").select(F.lit("raw").alias("kind"), *LANDING_COLUMNS))


def q_stream_replay(spark, d):
    """A replayed micro-batch leaves both the raw and the latest table alone."""
    return _latest_and_raw(spark, _streamed(spark, d, replay=True))


def q_stream_second_run(spark, d):
    """A second load run, with a checkpoint of its own, adds to the first; a
    replay of the first run's batch after it changes nothing."""
    return _latest_and_raw(spark, _streamed(spark, d, replay=True, second_run=True))


def q_stream_ledger(spark, d):
    """What the ledger has of two runs and a replay: a row a run and type."""
    from furlong.streaming import ingest
    work = _streamed(spark, d, replay=True, second_run=True)
    return ingest.read_ledger(spark, f"{work}/core").groupBy("record_type").agg(
        F.count_distinct("query_id").alias("n_queries"), F.count(F.lit(1)).alias("n_merges"), F.max("batch_id").alias("last_batch"))


def q_stream_raw_latest(spark, d):
    """The build's latest table from streamed raw rows."""
    from furlong.operators.parse import LANDING_COLUMNS
    from furlong.sources import landing, tables
    rows = landing.read_raw(spark, f"{_streamed(spark, d)}/raw", "SE").select(*LANDING_COLUMNS)
    return tables.store_by_key(rows, rid.runner_key_exprs(), latest.latest_entries, _scratch(spark, "stream-latest"))


def q_merge_types(spark, d):
    """Only the selected types have a latest table."""
    from furlong.sources import tables
    work = _streamed(spark, d, merge_types=" ra, jg")
    out = None
    for t in sorted(latest.MERGE_KEYS):
        table = tables.read_latest(spark, f"{work}/core/{t}_latest")
        n = (table if table is not None else spark.createDataFrame([], "x int")).agg(F.lit(t).alias("record_type"), F.count(F.lit(1)).alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


def _json(*extra):
    from furlong.operators.parse import LANDING_COLUMNS
    return F.to_json(F.struct(*LANDING_COLUMNS, *extra)).alias("value")


def q_landing_file_names(spark, d):
    """Files of every type named <TYPE>_<day>_<part>.jsonl.gz: the type comes from
    the name; records without a type are in files with a blank one, which are
    skipped."""
    from furlong.sources import fs, landing
    root = _scratch(spark, "named-landing")
    p = q_parse_fixed_width(spark, d)
    with landing.open_files(spark):
        landing.packed_by(p.select(F.coalesce("record_type", F.lit("none")).alias("t"), _json()), "t").text(f"{root}/in")
    for folder in fs.list_dirs(spark, f"{root}/in"):
        t = folder[2:] if folder != "t=none" else ""
        for k, name in enumerate(x for x in fs.list_files(spark, f"{root}/in/{folder}") if x.startswith("part-")):
            fs.rename(spark, f"{root}/in/{folder}/{name}", f"{root}/in/{folder}/{t}_20240101_{k}.jsonl.gz")
    both = landing.read_landing(spark, f"{root}/in/*", reference_names=True)
    return both.groupBy("file_type", "Year").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("raw_data").alias("n_raw"))


def q_landing_quarantine(spark, d):
    """Packed landing files of every type, those of one type cut off in the
    middle: all others load, and the damaged type is in the rejects."""
    from furlong.sources import fs, landing
    root = _scratch(spark, "packed-landing")
    p = q_parse_fixed_width(spark, d)
    rows = p.select(F.coalesce("record_type", F.lit("UNKNOWN")).alias("type_tag"), F.lit("20240101").alias("ingest_date"), _json())
    with landing.open_files(spark):
        landing.packed_by(rows.filter("type_tag <> 'JG'"), "type_tag", "ingest_date").text(f"{root}/land")
    rows.filter("type_tag = 'JG'").select("value").write.option("compression", "gzip").text(f"{root}/whole")
    for name in fs.list_files(spark, f"{root}/whole"):
        if name.startswith("part-"):
            fs.copy_head(spark, f"{root}/whole/{name}", f"{root}/land/type_tag=JG/ingest_date=20240101/{name}", 0.5)
    loaded, rejects = landing.load_landing(spark, f"{root}/land")
    good = loaded.groupBy(F.col("file_type").alias("record_type")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("raw_data").alias("n_raw"), F.lit(False).alias("quarantined"))
    bad = rejects.select(F.regexp_extract("path", "type_tag=([^/]*)/", 1).alias("record_type"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("n_raw"), F.lit(True).alias("quarantined"))
    return good.unionByName(bad.distinct())


def _raw_with_extras(spark, d):
    """Two raw batches of all types; the second has fields that the layout lacks."""
    from furlong.sources import landing
    land, raw = _scratch(spark, "extra-landing"), _scratch(spark, "extra-raw")
    n, batch = F.col("n"), F.pmod(F.crc32("raw_data"), F.lit(2))
    extras = {"weather": F.concat(F.lit("w"), (n % 5).cast("string")), "temp": F.when(n % 3 == 0, (n % 40).cast("string")).otherwise(F.concat((n % 40).cast("string"), F.lit(".5"))),
              "checked": F.concat(F.lit("2024-01-1"), (n % 9).cast("string")), "live": (n % 2 == 0).cast("string"), "heat": (n % 7).cast("string"), "code": F.concat(F.lit("0"), (n % 7).cast("string"))}
    # both landings in one write, so that the feed is built and parsed once; a NULL field is left out of its line
    feed = B.text_records(spark, d).withColumns({"n": F.length("raw_data"), "batch": batch}).filter(F.col("batch").isNotNull())
    p = parse.parse_records(feed, fetched_at=FETCHED_AT, keep=["n", "batch"])
    line = _json(*[F.when(F.col("batch") == 1, x).alias(c) for c, x in extras.items()])
    with landing.open_files(spark):
        landing.packed_by(p.select(line, "batch", F.coalesce("record_type", F.lit("UNKNOWN")).alias("type_tag"), F.lit("20240101").alias("ingest_date")),
                          "batch", "type_tag", "ingest_date").text(land)
    for k in (0, 1):
        landing.append_raw_batch(landing.landing_rows(landing.read_landing(spark, f"{land}/batch={k}")), raw, F.coalesce("record_type", F.lit("UNKNOWN")), k)
    return raw


def _raw_types(spark, raw):
    from furlong.sources import fs
    return [x[5:] for x in fs.list_dirs(spark, raw) if x.startswith("type=")]


def q_landing_extra_fields(spark, d):
    """JSON fields outside the layout survive landing, raw append and read, of every type."""
    from furlong.sources import landing
    raw, out = _raw_with_extras(spark, d), None
    for t in _raw_types(spark, raw):
        back = landing.read_raw(spark, raw, t, typed=False).withColumn("record_type", F.lit(t))
        g = back.groupBy("record_type", F.col("extra_fields")["weather"].alias("weather"), F.coalesce(F.size("extra_fields"), F.lit(0)).alias("n_extra")).agg(F.count(F.lit(1)).alias("n"))
        out = g if out is None else out.unionByName(g)
    return out


def q_raw_typed_fields(spark, d):
    """The same fields as columns of the type that their values have; rows of
    the batch before they came are NULL."""
    from furlong.sources import landing
    raw, out = _raw_with_extras(spark, d), None
    for t in _raw_types(spark, raw):
        back = landing.read_raw(spark, raw, t)
        kinds = {c: back.schema[c].dataType.simpleString() for c in ("weather", "temp", "checked", "live", "heat", "code")}
        g = back.agg(F.lit(t).alias("record_type"), F.count(F.lit(1)).alias("n"), F.count("temp").alias("n_temp"), F.round(F.sum("temp"), 6).alias("temp"),
                     F.max("checked").alias("checked"), F.count_if("live").alias("n_live"), F.sum("heat").alias("heat"), F.max("code").alias("code"), F.min("weather").alias("weather"),
                     F.lit(" ".join(f"{c}:{kinds[c]}" for c in sorted(kinds))).alias("kinds"))
        out = g if out is None else out.unionByName(g)
    return out


def q_text_steps(spark, d):
    """The steps kept as SQL text, with a day and a layer prefix as parameters."""
    from furlong.plans import sql_steps
    base = _scratch(spark, "sql-warehouse")
    prefix = "s" + base.rsplit("-", 1)[-1]
    m = model(spark, d, "results", "raw_se")
    sql_steps.run_files(spark, plans={"serving_races": m["races"], "serving_entries": m["entries"]}, **sql_steps.layer_params(base, prefix, AS_OF))
    report = spark.table(f"{prefix}_serving.day_report").crossJoin(F.broadcast(spark.table(f"{prefix}_ml.venue_baseline").agg(
        F.count(F.lit(1)).alias("venues"), F.sum("starts").alias("starts"), F.max("horses").alias("most_horses"))))
    from furlong.session import materialize
    out = materialize(report, "day-report")   # a row
    for layer in ("raw", "core", "serving", "ml"):
        spark.sql(f"DROP DATABASE IF EXISTS {prefix}_{layer} CASCADE")
    return out


def q_parse_full_width(spark, d):
    """Runner records whose names are full-width: two cp932 bytes a character."""
    names = F.rpad(F.translate(F.concat(F.lit("H"), F.col("l_partkey").cast("string")), "H0123456789", "Ｈ０１２３４５６７８９"), 18, "　")
    ln = F.col("l_linenumber")
    raw = B.table(spark, d, "lineitem").select(F.concat(
        F.lit("SE7"), F.date_format("l_shipdate", "yyyyMMdd"), F.date_format("l_shipdate", "yyyyMMdd"), F.lit("05010203"),
        ((ln + 1) / 2).cast("long").cast("string"), F.lpad(ln.cast("string"), 2, "0"), F.lpad(F.col("l_partkey").cast("string"), 10, "0"),
        names, F.lit(" 後"), F.col("l_returnflag")).alias("raw_data"))
    p = parse.parse_records(raw, fetched_at=FETCHED_AT)
    return p.select("record_type", "MakeDate", "Year", "MonthDay", "JyoCD", "Kaiji", "Nichiji", "RaceNum", "Wakuban", "Umaban", "KettoNum", "Bamei", "raw_body")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "latest_races": q_latest_races,
    "latest_entries": q_latest_entries,
    "stage_dedup": q_stage_dedup,
    "upsert_latest": q_upsert_latest,
    "race_summary": q_race_summary,
    "entry_fallback": q_entry_fallback,
    "serving_races": q_serving_races,
    "serving_entries": q_serving_entries,
    "race_list": q_race_list,
    "race_card": q_race_card_all,
    "race_card_one": q_race_card_one,
    "race_id_parts": q_race_id_parts,
    "code_lookup": q_code_lookup,
    "form_history": q_form_history,
    "form_history_before": q_form_history_before,
    "form_features": q_form_features,
    "field_speed_z": q_field_speed_z,
    "speed_lookup": q_speed_lookup,
    "analysis_score": q_analysis_score,
    "race_analysis_all": q_race_analysis_all,
    "race_analysis_one": q_race_analysis_one,
    "index_source": q_index_source,
    "speed_index_log_dist": q_speed_index_log_dist,
    "speed_index_full": q_speed_index_full,
    "speed_index_three": q_speed_index_three,
    "speed_baseline": q_speed_baseline,
    "parse_fixed_width": q_parse_fixed_width,
    "parse_lanes": q_parse_lanes,
    "record_census": q_record_census,
    "sample_by_type": q_sample_by_type,
    "layout_profile": q_layout_profile,
    "layout_cuts": q_layout_cuts,
    "layout_ranges": q_layout_ranges,
    "dup_races": q_dup_races,
    "dup_entries": q_dup_entries,
    "null_rate": q_null_rate,
    "freshness": q_freshness,
    "quality_report": q_quality_report,
    "check_projection": q_check_projection,
    "nfkc_match": q_nfkc_match,
    "jsonl_land_and_load": q_jsonl_land_and_load,
    "reparse_backfill": q_reparse_backfill,
    "layered_build": q_layered_build,
    "stream_ingest": q_stream_ingest,
    "stream_replay": q_stream_replay,
    "stream_second_run": q_stream_second_run,
    "stream_ledger": q_stream_ledger,
    "stream_raw_latest": q_stream_raw_latest,
    "merge_types": q_merge_types,
    "landing_file_names": q_landing_file_names,
    "landing_extra_fields": q_landing_extra_fields,
    "landing_quarantine": q_landing_quarantine,
    "raw_typed_fields": q_raw_typed_fields,
    "text_steps": q_text_steps,
    "parse_full_width": q_parse_full_width,
    "race_page": q_race_page,
    "analysis_no_master": q_analysis_no_master,
    "fitted_speed_lookup": q_fitted_speed_lookup,
}

ORACLE: dict[str, Callable[[], str]] = {
    "latest_races": O.q_latest_races,
    "latest_entries": O.q_latest_entries,
    "stage_dedup": O.q_stage_dedup,
    "upsert_latest": O.q_upsert_latest,
    "race_summary": O.q_race_summary,
    "entry_fallback": O.q_entry_fallback,
    "serving_races": O.q_serving_races,
    "serving_entries": O.q_serving_entries,
    "race_list": O.q_race_list,
    "race_card": lambda: O.q_race_card(False),
    "race_card_one": lambda: O.q_race_card(True),
    "race_id_parts": O.q_race_id_parts,
    "code_lookup": O.q_code_lookup,
    "form_history": O.q_form_history,
    "form_history_before": O.q_form_history_before,
    "form_features": O.q_form_features,
    "field_speed_z": O.q_field_speed_z,
    "speed_lookup": O.q_speed_lookup,
    "analysis_score": O.q_analysis_score,
    "race_analysis_all": lambda: O.q_race_analysis(False),
    "race_analysis_one": lambda: O.q_race_analysis(True),
    "index_source": O.q_index_source,
    "speed_index_log_dist": O.q_speed_index_log_dist,
    "speed_index_full": O.q_speed_index_full,
    "speed_index_three": O.q_speed_index_three,
    "speed_baseline": O.q_speed_baseline,
    "parse_fixed_width": O.q_parse_fixed_width,
    "parse_lanes": O.q_parse_lanes,
    "record_census": O.q_record_census,
    "sample_by_type": O.q_sample_by_type,
    "layout_profile": O.q_layout_profile,
    "layout_cuts": O.q_layout_cuts,
    "layout_ranges": O.q_layout_ranges,
    "dup_races": lambda: O.q_quality(["dup_races"]),
    "dup_entries": lambda: O.q_quality(["dup_entries"]),
    "null_rate": lambda: O.q_quality(["null_rate"]),
    "freshness": lambda: O.q_quality(["freshness"]),
    "quality_report": lambda: O.q_quality(["dup_races", "dup_entries", "null_rate", "freshness", "orphans"]),
    "check_projection": O.q_check_projection,
    "nfkc_match": O.q_nfkc_match,
    "jsonl_land_and_load": O.q_jsonl_land_and_load,
    "reparse_backfill": O.q_reparse_backfill,
    "layered_build": lambda: O.q_quality(["dup_races", "dup_entries", "null_rate", "freshness", "orphans"]),
    "stream_ingest": O.q_stream_ingest,
    "stream_replay": O.q_stream_replay,
    "stream_second_run": O.q_stream_replay,
    "stream_ledger": O.q_stream_ledger,
    "stream_raw_latest": O.q_stream_raw_latest,
    "merge_types": O.q_merge_types,
    "landing_file_names": O.q_landing_file_names,
    "landing_extra_fields": O.q_landing_extra_fields,
    "landing_quarantine": O.q_landing_quarantine,
    "raw_typed_fields": O.q_raw_typed_fields,
    "text_steps": O.q_text_steps,
    "parse_full_width": O.q_parse_full_width,
    "race_page": lambda: O.q_race_page(UNKNOWN_RACE),
    "analysis_no_master": O.q_analysis_no_master,
    "fitted_speed_lookup": O.q_fitted_speed_lookup,
}
