import json
import os

import pytest
from pyspark.sql import functions as F

from furlong.operators import parse
from furlong.plans import runner
from furlong.sources import landing, tables
from furlong.streaming import ingest

SE = "SE7202401012024010105010102" + "1" + "03" + "0000000123" + "H123".ljust(36)


def write(path, name, lines):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def test_read_reference_named_files(spark, local_dir):
    write(local_dir, "SE_20240101.jsonl", [json.dumps({"record_type": "SE", "Umaban": "01", "raw_data": SE},
                                                      ensure_ascii=False), '{"raw_data": "SE'])
    write(local_dir, "_20240101.jsonl", [json.dumps({"record_type": "RA"})])     # blank type: skipped
    write(local_dir, "notes.txt", ["not a landing file"])
    df = landing.read_landing(spark, local_dir, reference_names=True)
    rows = df.select("file_type", "Umaban", landing.CORRUPT).collect()
    assert sorted(((r[0], r[1], r[2] is not None) for r in rows), key=str) == [("SE", "01", False), ("SE", None, True)]


def test_land_then_read_round_trip(spark, scratch):
    raw = spark.createDataFrame([(SE,), ("X",), ("ZZ1",)], "raw_data string")
    landing.land_records(raw, scratch, fetched_at="t0")
    back = landing.read_landing(spark, scratch)
    got = {r["file_type"]: r for r in back.collect()}
    assert set(got) == {"SE", "UNKNOWN", "ZZ"}
    assert got["SE"]["Umaban"] == "03" and got["SE"]["Bamei"] == "H123" and got["SE"]["_parsed"] is True
    assert got["UNKNOWN"]["error"] == "Too short" and got["UNKNOWN"]["record_type"] is None


def test_reparse_keeps_metadata_and_passes_lines_through(spark, local_dir):
    lines = [json.dumps({"raw_data": SE, "fetched_at": "2024-01-01T00:00:00", "Umaban": "old"}),
             json.dumps({"raw_data": SE}),
             '{"note": 1,  "x": [1, 2]}', "{broken", "[1, 2]", json.dumps({"raw_data": ""})]
    write(local_dir, "SE_20240101.jsonl", lines)
    out = landing.reparse_lines(spark, local_dir).collect()
    texts = [r["line"] for r in out]
    for keep in lines[2:]:
        assert keep in texts                     # byte-for-byte passthrough
    parsed = [json.loads(t) for t in texts if '"record_type"' in t]
    assert sorted(p["fetched_at"] for p in parsed) == ["", "2024-01-01T00:00:00"]
    assert all(p["Umaban"] == "03" and p["raw_data"] == SE for p in parsed)


def test_step_selection():
    assert runner.resolve_steps(None) == sorted(runner.STEPS)
    assert runner.resolve_steps("03_quality_checks, 02_build_serving_tables") == [
        "03_quality_checks", "02_build_serving_tables"]
    with pytest.raises(runner.UnknownStep, match="99_missing"):
        runner.resolve_steps("99_missing")
    with pytest.raises(runner.UnknownStep):
        runner.resolve_steps(" , ")


def test_optional_table_and_create_like(spark, scratch):
    from furlong.operators.form import MASTER_SCHEMA
    assert tables.optional_table(spark, f"{scratch}/none", MASTER_SCHEMA).count() == 0
    like = spark.createDataFrame([("a",)], "k string")
    assert tables.create_like(spark, like, f"{scratch}/t") is True
    assert tables.create_like(spark, like, f"{scratch}/t") is False
    assert tables.read_table(spark, f"{scratch}/t").count() == 0


def test_stream_ingest_and_replay_is_idempotent(spark, scratch):
    raw = spark.createDataFrame([(SE,), (SE.replace("H123", "H999"),), ("ZZ1",)], "raw_data string")
    land = f"{scratch}/landing"
    landing.land_records(raw, land, fetched_at="2024-01-01T00:00:00")
    spark.createDataFrame([("{bad json",)], "value string").write.text(f"{land}/type_tag=BAD/ingest_date=00000000")
    ingest.run_ingest(spark, land, f"{scratch}/raw", f"{scratch}/core", f"{scratch}/ckpt")
    se = tables.read_latest(spark, f"{scratch}/core/SE_latest")
    first = sorted(tuple(r) for r in se.select(*parse.LANDING_COLUMNS).collect())
    assert len(first) == 1 and first[0][parse.LANDING_COLUMNS.index("Bamei")] == "H999"   # tie: deterministic
    assert landing.read_raw(spark, f"{scratch}/raw", ingest.REJECTS).select(landing.CORRUPT).collect()[0][0] == "{bad json"
    assert landing.read_raw(spark, f"{scratch}/raw", "SE").count() == 2
    assert tables.read_latest(spark, f"{scratch}/core/RA_latest") is None    # no such rows: not merged
    # replay the same batch: the same files from the same input
    lines = spark.read.option("recursiveFileLookup", "true").text(land)
    run = ingest.read_ledger(spark, f"{scratch}/core").collect()
    assert [(r.record_type, r.batch_id) for r in run] == [("SE", 0)]
    handle = ingest.make_batch_handler(f"{scratch}/raw", f"{scratch}/core", query_id=run[0].query_id)
    handle(landing.parse_json_lines(lines), 0)
    again = tables.read_latest(spark, f"{scratch}/core/SE_latest")
    assert sorted(tuple(r) for r in again.select(*parse.LANDING_COLUMNS).collect()) == first
    assert landing.read_raw(spark, f"{scratch}/raw", "SE").count() == 2
    with pytest.raises(RuntimeError, match="query_id"):
        ingest.make_batch_handler(f"{scratch}/raw", f"{scratch}/core")(landing.parse_json_lines(lines), 0)


def test_a_second_run_adds_and_an_old_batch_is_not_merged_again(spark, scratch):
    """Two landings, two checkpoints, the same raw and latest tables."""
    names = {}
    for k, name in enumerate(("H123", "H777")):
        landing.land_records(spark.createDataFrame([(SE.replace("H123", name),)], "raw_data string"), f"{scratch}/land{k}", fetched_at=f"t{k}")
        other = SE.replace("103" + "0000000123", f"10{5 + k}0000000123")
        landing.land_records(spark.createDataFrame([(other,)], "raw_data string"), f"{scratch}/land{k}", fetched_at=f"t{k}")
        q = ingest.run_ingest(spark, f"{scratch}/land{k}", f"{scratch}/raw", f"{scratch}/core", f"{scratch}/ckpt{k}")
        names[k] = str(q.id)
    latest = lambda: sorted((r.Umaban, r.Bamei) for r in tables.read_latest(spark, f"{scratch}/core/SE_latest").collect())
    assert landing.read_raw(spark, f"{scratch}/raw", "SE").count() == 4
    assert latest() == [("03", "H777"), ("05", "H123"), ("06", "H123")]
    lines = spark.read.option("recursiveFileLookup", "true").text(f"{scratch}/land0")
    ingest.make_batch_handler(f"{scratch}/raw", f"{scratch}/core", query_id=names[0])(landing.parse_json_lines(lines), 0)
    assert latest() == [("03", "H777"), ("05", "H123"), ("06", "H123")] and landing.read_raw(spark, f"{scratch}/raw", "SE").count() == 4
    ledger = ingest.read_ledger(spark, f"{scratch}/core").collect()
    assert sorted((r.query_id, r.batch_id) for r in ledger) == sorted((n, 0) for n in names.values())


def test_fields_outside_the_layout_are_kept(spark, local_dir):
    write(local_dir, "SE_20240101.jsonl", [json.dumps({"record_type": "SE", "weather": "rain", "temp": 21}), json.dumps({"record_type": "SE"}), "", "{oops"])
    rows = landing.read_landing(spark, local_dir, reference_names=True).collect()
    assert {tuple(sorted((r[landing.EXTRA] or {}).items())) for r in rows} == {(), (("temp", "21"), ("weather", "rain"))}
    assert len(rows) == 3 and sum(r[landing.CORRUPT] is not None for r in rows) == 1


KEYS = ["Year", "Umaban"]


def rows_of(df):
    return sorted((r.Year, r.Umaban, r.Bamei) for r in df.collect())


def stage_of(spark, *rows):
    return spark.createDataFrame(rows, "Year string, Umaban string, Bamei string")


def test_upsert_rewrites_only_touched_partitions(spark, scratch):
    from furlong.sources import fs
    path = f"{scratch}/latest"
    assert tables.upsert_table(spark, path, stage_of(spark, ("2023", "1", "a"), ("2024", "1", "b"), (None, "1", "n")), KEYS)
    before = fs.list_files(spark, f"{path}/part=p2023")
    assert tables.upsert_table(spark, path, stage_of(spark, ("2024", "1", "c"), ("2024", "2", "d"), ("", "1", "m")), KEYS)
    assert fs.list_files(spark, f"{path}/part=p2023") == before
    want = [("", "1", "m"), ("2023", "1", "a"), ("2024", "1", "c"), ("2024", "2", "d")]
    assert rows_of(tables.read_latest(spark, path)) == want
    assert tables.upsert_table(spark, path, stage_of(spark), KEYS) is False
    assert tables.upsert_table(spark, path, stage_of(spark, ("2024", "1", "x")).drop("Umaban"), KEYS) is False
    assert rows_of(tables.read_latest(spark, path)) == want and fs.list_dirs(spark, f"{path}.pending") == []


def test_a_broken_off_upsert_is_finished_from_its_pending_rows(spark, scratch):
    from furlong.sources import fs
    path = f"{scratch}/latest"
    tables.upsert_table(spark, path, stage_of(spark, ("2023", "1", "a"), ("2024", "1", "b")), KEYS, batch="one")
    # the merge of batch two is complete, and its overwrite ended between delete and write
    merged = stage_of(spark, ("2023", "1", "a"), ("2023", "2", "z")).withColumn("part", F.lit("p2023"))
    merged.write.parquet(f"{path}.pending/two")
    fs.delete(spark, f"{path}/part=p2023")
    assert tables.upsert_table(spark, path, stage_of(spark, ("2023", "2", "z")), KEYS, batch="two")
    assert rows_of(tables.read_latest(spark, path)) == [("2023", "1", "a"), ("2023", "2", "z"), ("2024", "1", "b")]


def shuffle_files(spark):
    found = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def test_an_upsert_leaves_no_shuffle_files(spark, scratch):
    rows = spark.range(2000).select(F.lit("2024").alias("Year"), F.col("id").cast("string").alias("Umaban"), F.lit("a").alias("Bamei"))
    before = shuffle_files(spark)
    for _ in range(2):
        tables.upsert_table(spark, f"{scratch}/latest", rows, KEYS)
    assert shuffle_files(spark) <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_a_large_batch_is_merged_in_slices(spark, scratch, monkeypatch):
    from furlong.sources import fs
    monkeypatch.setattr(tables, "SLICE_ROWS", 2)
    assert tables.slices({"pb": 1, "pa": 1, "pc": 5, "pd": 1, "pe": 1, "pf": 1}) == [["pa", "pb"], ["pc"], ["pd", "pe"], ["pf"]]
    assert tables.slices({}) == [] and tables.slices({f"p{i:03d}": 1 for i in range(160)})[0] == [f"p{i:03d}" for i in range(20)]
    path, years = f"{scratch}/latest", ["2020", "2021", "2022", None]
    first = [(y, str(u), "a") for y in years for u in range(3)]
    assert tables.upsert_table(spark, path, stage_of(spark, *first), KEYS)
    second = [(y, str(u), "b") for y in ["2021", "2022", "2023", ""] for u in (2, 3)]
    assert tables.upsert_table(spark, path, stage_of(spark, *second), KEYS, batch="two")
    want = {(y or "", str(u)): "a" for y in years for u in range(3)} | {(y, u): b for y, u, b in second}
    assert rows_of(tables.read_latest(spark, path).fillna("")) == sorted((y, u, b) for (y, u), b in want.items())
    # broken off in the overwrite of a later slice: the replay finishes it from its pending rows
    merged = tables.read_latest(spark, path).filter("Year = '2022'").withColumn("part", F.lit("p2022"))
    k = next(i for i, names in enumerate(tables.slices({f"p{y}": 2 for y in ["2021", "2022", "2023", ""]})) if "p2022" in names)
    merged.write.parquet(f"{path}.pending/two-{k}")
    fs.delete(spark, f"{path}/part=p2022")
    assert tables.upsert_table(spark, path, stage_of(spark, *second), KEYS, batch="two")
    assert rows_of(tables.read_latest(spark, path).fillna("")) == sorted((y, u, b) for (y, u), b in want.items())
    assert fs.list_dirs(spark, f"{path}.pending") == []


def test_a_large_partition_is_written_by_many_tasks(spark, scratch):
    from furlong.sources import fs
    rows = spark.range(40_000).select(F.when(F.col("id") % 10 > 0, F.lit("2024")).otherwise(F.lit("2023")).alias("Year"), F.col("id").cast("string").alias("Umaban"),
                                      F.sha2(F.col("id").cast("string"), 256).alias("Bamei"))
    sizes = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes")
    before = {k: spark.conf.get(k) for k in sizes}
    try:
        for k in sizes:
            spark.conf.set(k, "200k")
        tables.upsert_table(spark, f"{scratch}/latest", rows, KEYS)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    count = lambda y: sum(x.startswith("part-") for x in fs.list_files(spark, f"{scratch}/latest/part=p{y}"))
    assert count("2024") > 1
    assert tables.read_latest(spark, f"{scratch}/latest").exceptAll(rows).isEmpty() and tables.read_latest(spark, f"{scratch}/latest").count() == 40_000


def test_replace_may_read_the_table_it_replaces(spark, scratch):
    spark.range(5).write.parquet(f"{scratch}/t")
    tables.replace_table(tables.read_table(spark, f"{scratch}/t").filter("id > 2"), f"{scratch}/t")
    assert sorted(r.id for r in tables.read_table(spark, f"{scratch}/t").collect()) == [3, 4]


def test_a_reader_never_misses_a_table_while_it_is_replaced(spark, scratch):
    import threading
    tables.create_layers(spark, scratch, "gap")
    view, path = "gap_core.t", f"{scratch}/core/t"
    tables.replace_table(spark.range(100), path, view)
    seen, failed, stop = set(), [], threading.Event()

    def read():
        while not stop.is_set():
            try:
                seen.add(spark.table(view).count())
                seen.add(tables.read_table(spark, path).count())
            except Exception as e:
                failed.append(e)
    reader = threading.Thread(target=read)
    reader.start()
    for k in range(1, 6):
        tables.replace_table(spark.range(100 + k), path, view)
    stop.set()
    reader.join()
    tables.drop_layers(spark, "gap")
    assert not failed and seen <= set(range(100, 106)) and len(tables.versions(spark, path)) == 2
    assert tables.read_table(spark, path).count() == 105


def test_damaged_files_are_set_aside(spark, local_dir):
    import gzip
    line = lambda k: (json.dumps({"record_type": "SE", "Umaban": f"{k:02d}", "raw_data": f"{SE}{k}"}) + "\n").encode()
    good = gzip.compress(b"".join(map(line, range(50))))
    twice = gzip.compress(line(60)) + gzip.compress(line(61))       # two members
    spoilt = bytearray(gzip.compress(b"".join(map(line, range(2000)))))
    spoilt[len(spoilt) // 2] ^= 0xFF
    for name, data in (("SE_1.jsonl.gz", good), ("SE_2.jsonl.gz", twice), ("SE_3.jsonl.gz", good[: len(good) // 2]), ("SE_4.jsonl.gz", bytes(spoilt)),
                       ("SE_5.jsonl.gz", b"no gzip at all"), ("SE_6.jsonl", line(70))):
        with open(os.path.join(local_dir, name), "wb") as f:
            f.write(data)
    rows, rejects = landing.load_landing(spark, local_dir, reference_names=True)
    assert sorted(int(r.Umaban) for r in rows.collect()) == [*range(50), 60, 61, 70]
    found = {r.path.rsplit("/", 1)[1]: r.reason for r in rejects.collect()}
    assert set(found) == {"SE_3.jsonl.gz", "SE_4.jsonl.gz", "SE_5.jsonl.gz"} and found["SE_3.jsonl.gz"] == "cut off"


def test_value_kinds_and_the_widest_type(spark):
    from furlong.sources import fields
    values = {"12": "long", "-3": "long", "012": "string", "1.5": "double", "1e3": "double", "99999999999999999999": "double", "true": "boolean", "2024-02-30": "string",
              "2024-02-03": "date", "2024-02-03T10:00:00": "timestamp", " ": None, "x": "string"}
    df = spark.createDataFrame([(k,) for k in values], "v string")
    assert {r.v: r.k for r in df.select("v", fields.value_kind(F.col("v")).alias("k")).collect()} == values
    mixed = {("long",): "bigint", ("double", "long"): "double", ("date",): "date", ("date", "timestamp"): "timestamp", ("boolean", "long"): "string", (): "string", ("date", "long"): "string"}
    for kinds, kind in mixed.items():
        got = spark.createDataFrame([(list(kinds),)], "k array<string>").select(fields.widest(F.col("k")).alias("w")).first().w
        assert spark.createDataFrame([], f"x {got}").schema["x"].dataType.simpleString() == kind


def test_a_later_batch_widens_a_field(spark, scratch):
    row = lambda **extra: spark.createDataFrame([("SE", extra)], "record_type string, extra_fields map<string,string>")
    landing.append_raw(spark.createDataFrame([("SE", None)], "record_type string, extra_fields map<string,string>"), scratch, "SE", 0)
    assert landing.read_raw(spark, scratch, "SE").columns == ["record_type", "extra_fields"]
    landing.append_raw(row(temp="7", Record_Type="odd"), scratch, "SE", 1)
    got = landing.read_raw(spark, scratch, "SE")
    assert dict(got.dtypes)["temp"] == "bigint" and "Record_Type" not in got.columns    # its name differs in case only
    landing.append_raw(row(temp="7.5"), scratch, "SE", 2)
    got = landing.read_raw(spark, scratch, "SE")
    assert dict(got.dtypes)["temp"] == "double" and sorted((r.temp for r in got.collect()), key=str) == [7.0, 7.5, None]
    landing.append_raw(row(temp="warm"), scratch, "SE", 2)    # the batch again, with other rows
    assert sorted((r.temp for r in landing.read_raw(spark, scratch, "SE").collect()), key=str) == ["7", None, "warm"]


def test_text_steps(spark, scratch, local_dir):
    from furlong.plans import sql_steps
    for name, text in (("02_b.sql", "-- a comment; with a semicolon\nCREATE OR REPLACE VIEW IDENTIFIER(:prefix || '_b') AS\nSELECT day, ';' AS x FROM IDENTIFIER(:prefix || '_a');\n"),
                       ("01_a.sql", "CREATE OR REPLACE VIEW IDENTIFIER(:prefix || '_a') AS SELECT CAST(:as_of AS DATE) AS day, n FROM plan_rows;")):
        with open(os.path.join(local_dir, name), "w", encoding="utf-8") as f:
            f.write(text)
    plans = {"rows": spark.range(1).select(F.col("id").alias("n"))}
    spark.range(3).write.parquet(f"{scratch}/rows")
    plans = {"rows": spark.read.parquet(f"{scratch}/rows").withColumnRenamed("id", "n")}
    with pytest.raises(Exception, match="temporary"):      # a stored view can't hang on a plan
        sql_steps.run_files(spark, local_dir, plans=plans, prefix="st", as_of="2024-01-02")
    with open(os.path.join(local_dir, "01_a.sql"), "w", encoding="utf-8") as f:
        f.write("CREATE OR REPLACE VIEW IDENTIFIER(:prefix || '_a') AS SELECT CAST(:as_of AS DATE) AS day;")
    assert sql_steps.run_files(spark, local_dir, prefix="st", as_of="2024-01-02") == ["01_a.sql", "02_b.sql"]
    assert [(str(r.day), r.x) for r in spark.table("st_b").collect()] == [("2024-01-02", ";")]
    assert sql_steps.run_files(spark, local_dir, "02_b, 01_a.sql", prefix="st", as_of="2024-01-03") == ["02_b.sql", "01_a.sql"]
    for only, error in (("03_c", "03_c"), (" , ", "no step was named")):
        with pytest.raises(runner.UnknownStep, match=error):
            sql_steps.run_files(spark, local_dir, only, prefix="st", as_of="2024-01-03")
    with pytest.raises(runner.UnknownStep, match="no step in"):
        sql_steps.run_files(spark, scratch, prefix="st")
    with pytest.raises(ValueError, match="no value for as_of"):
        sql_steps.run_files(spark, local_dir, prefix="st")
    for v in ("st_a", "st_b"):
        spark.sql(f"DROP VIEW {v}")


def test_scratch_needs_a_shared_folder_off_local_masters(monkeypatch):
    from furlong import session

    class Context:
        master = "spark://cluster:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_landing_is_packed_and_backfilled_in_one_pass(spark, scratch):
    """Landing files, backfilled ones and their plans: mostly blank records
    take a fraction of their size, and no row is sorted by folder."""
    from furlong.sources import fs
    raw = spark.range(2000).select(F.concat(F.lit("RA7"), F.rpad(F.col("id").cast("string"), 700, " ")).alias("raw_data"))
    landing.land_records(raw, f"{scratch}/land", fetched_at="t")
    day = fs.list_dirs(spark, f"{scratch}/land/type_tag=RA")[0]
    files = [x for x in fs.list_files(spark, f"{scratch}/land/type_tag=RA/{day}") if x.startswith("part-")]
    assert files and all(x.endswith(".json.gz") for x in files)
    assert spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{scratch}/land").agg(F.sum("length")).first()[0] < 2000 * 700 / 5
    lines = landing.reparse_lines(spark, f"{scratch}/land")
    assert lines._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    landing.write_lines(lines, f"{scratch}/out")
    assert {d for d in fs.list_dirs(spark, f"{scratch}/out")} == {f"source_file={x}" for x in files}
    assert spark.read.text(f"{scratch}/out").count() == 2000
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_rows_of_whole_keys_are_built_in_slices(spark, scratch, monkeypatch):
    from furlong.functions import race_id
    from furlong.operators import latest
    year = F.when(F.col("id") % 7 == 0, F.lit(None).cast("string")).otherwise((F.col("id") % 5 + 2019).cast("string"))
    horse = F.when(F.col("id") % 11 == 0, F.lit(None).cast("string")).when(F.col("id") % 2 == 0, F.lit(" 3")).otherwise((F.col("id") % 9).cast("string"))
    rows = spark.range(3000).select(year.alias("Year"), *[F.lit("1").alias(c) for c in ("MonthDay", "JyoCD", "Kaiji", "Nichiji", "RaceNum")],
                                    horse.alias("Umaban"), F.sha2(F.col("id").cast("string"), 256).alias("Bamei"), F.lit("t").alias("fetched_at"))
    rows.unionByName(rows.limit(50)).write.parquet(f"{scratch}/rows")
    rows = spark.read.parquet(f"{scratch}/rows")
    want = latest.latest_entries(rows)
    seen, build = [], lambda some: seen.append(some.count()) or latest.latest_entries(some)
    before = shuffle_files(spark)
    whole = tables.store_by_key(rows, race_id.runner_key_exprs(), build, f"{scratch}/whole")
    monkeypatch.setattr(tables, "SLICE_ROWS", 1000)
    cut = tables.store_by_key(rows, race_id.runner_key_exprs(), build, f"{scratch}/cut")
    assert len(seen) == 1 + 4 and sum(seen[1:]) == seen[0] == 3050
    assert shuffle_files(spark) <= before
    for got in (whole, cut):
        assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    empty = tables.store_by_key(rows.limit(0), race_id.runner_key_exprs(), latest.latest_entries, f"{scratch}/none")
    assert empty.columns == want.columns and empty.isEmpty()


def test_files_of_a_latest_table_are_sorted_by_key(spark, scratch):
    from furlong.sources import fs
    rows = spark.range(500).select(F.when(F.col("id") % 3 == 0, F.lit("2024")).otherwise(F.lit("2023")).alias("Year"),
                                   F.lpad((F.col("id") * 37 % 500).cast("string"), 3, "0").alias("Umaban"), F.lit("a").alias("Bamei"))
    tables.upsert_table(spark, f"{scratch}/latest", rows.repartition(4), KEYS)
    for y in ("2023", "2024"):
        for name in fs.list_files(spark, f"{scratch}/latest/part=p{y}"):
            if name.startswith("part-"):
                found = [r.Umaban for r in spark.read.parquet(f"{scratch}/latest/part=p{y}/{name}").coalesce(1).collect()]
                assert found == sorted(found)
    assert tables.read_latest(spark, f"{scratch}/latest").count() == 500


def feed_tables(spark, d):
    """Three races of two runners each, as the tables that the feed is made of."""
    orders = [(k, 10 + k, "O", f"1995-0{k}-01", "5-LOW") for k in (1, 2, 3)]
    lines = [(k, 100 + k, 1, n, 3.0, "A", "F", "1995-08-01") for k in (1, 2, 3) for n in (1, 2)]
    o = spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate string, o_orderpriority string")
    li = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, "
                                      "l_linestatus string, l_shipdate string")
    o.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")).write.parquet(f"{d}/orders.parquet")
    li.withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp")).write.parquet(f"{d}/lineitem.parquet")


@pytest.mark.parametrize(("query", "during", "n"), [
    ("stream_ingest", [["first"], ["second"]], 6),
    ("stream_raw_latest", [["first"], ["second"]], 6),
    ("stream_replay", [["first"], ["second"], ["second"]], 6 + 9),
    ("stream_ledger", [["first"], ["first", "second"], ["first"]], 2),
])
def test_a_landing_goes_when_nothing_reads_it_any_more(spark, local_dir, monkeypatch, query, during, n):
    from furlong.plans import registry
    from furlong.sources import fs
    feed_tables(spark, local_dir)
    roots, seen = [], []
    scratch_of, ingested, handler = registry._scratch, ingest.run_ingest, ingest.make_batch_handler

    def scratch_path(s, name):
        path = scratch_of(s, name)
        roots.extend([path] if name == "stream-landing" else [])
        return path

    def listed():
        seen.append(fs.list_dirs(spark, roots[0]))

    monkeypatch.setattr(registry, "_scratch", scratch_path)
    monkeypatch.setattr(ingest, "run_ingest", lambda *a: (listed(), ingested(*a))[1])
    monkeypatch.setattr(ingest, "make_batch_handler", lambda *a: (listed() if len(a) == 4 else None, handler(*a))[1])
    assert registry.QUERIES[query](spark, local_dir).count() == n
    assert seen == during and fs.list_dirs(spark, roots[0]) == []


def test_both_landings_of_extra_fields_are_built_in_one_write(spark, local_dir, monkeypatch):
    from furlong.plans import registry
    feed_tables(spark, local_dir)
    written, packed = [], landing.packed_by
    monkeypatch.setattr(landing, "packed_by", lambda df, *columns: (written.append(columns), packed(df, *columns))[1])
    raw = registry._raw_with_extras(spark, local_dir)
    assert written == [("batch", "type_tag", "ingest_date")]
    rows = [landing.read_raw(spark, raw, "SE", k, typed=False).select("raw_data", landing.EXTRA, "fetched_at").collect() for k in (0, 1)]
    assert rows[0] and rows[1] and all(r[landing.EXTRA] is None and r.fetched_at == registry.FETCHED_AT for r in rows[0])
    n = {len(r.raw_data): r[landing.EXTRA] for r in rows[1]}
    assert all(x == {"weather": f"w{k % 5}", "temp": f"{k % 40}" if k % 3 == 0 else f"{k % 40}.5", "checked": f"2024-01-1{k % 9}", "live": str(k % 2 == 0).lower(),
                     "heat": f"{k % 7}", "code": f"0{k % 7}"} for k, x in n.items())


def test_only_a_line_that_may_have_other_fields_is_parsed_again(spark):
    """Plain lines, spaced ones, other orders, nulls, doubled keys, nested and malformed text: the fields of a parse of each line."""
    plain = json.dumps({"record_type": "SE", "_parsed": True, "Umaban": "03", "raw_data": 'a"\\b 馬'}, ensure_ascii=False, separators=(",", ":"))
    lines = [plain, plain[:-1] + ',"weather":"rain"}', plain.replace(",", " , "), '{"x":null,"Umaban":"1"}', '{"Umaban":"1","Umaban":"2"}', '{"Umaban":1,"x":2}', "{'x':'y'}",
             '{"Umaban":{"a":1},"x":[1, 2]}', '{"_corrupt_record":"c"}', '{"_parsed":"maybe","x":"1"}', '{"Umaban":"1"', "null", "[]", "3", '{"Umaban":"1"} rest', "{}"]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(lines)], "k int, value string")
    every = F.from_json("value", "map<string,string>")
    want = {r.k: {x: v for x, v in (r.m or {}).items() if x not in parse.LANDING_COLUMNS and v is not None} for r in rows.select("k", every.alias("m")).collect()}
    out = landing.parse_json_lines(rows)
    assert {r.k: r[landing.EXTRA] or {} for r in out.collect()} == want and want[1] == {"weather": "rain"} and want[0] == {}
    assert "CASE WHEN NOT (value" in out._jdf.queryExecution().analyzed().toString()


def test_partitions_that_a_table_lacks_are_merged_without_a_join(spark, scratch, monkeypatch):
    monkeypatch.setattr(tables, "SLICE_ROWS", 2)
    plans, upsert = [], tables.upsert_latest

    def merged(*a, **k):
        out = upsert(*a, **k)
        plans.append(out._jdf.queryExecution().optimizedPlan().toString())
        return out

    monkeypatch.setattr(tables, "upsert_latest", merged)
    path = f"{scratch}/latest"
    assert tables.upsert_table(spark, path, stage_of(spark, *[(y, u, "a") for y in ("2020", "2021", "2022") for u in "12"]), KEYS)
    assert len(plans) == 3 and not any("Join" in p for p in plans)
    wider = spark.createDataFrame([("2023", "1", "b", 7), ("2022", "2", "b", 8)], "Year string, Umaban string, Bamei string, extra int")
    monkeypatch.setattr(tables, "SLICE_ROWS", 1)
    assert tables.upsert_table(spark, path, wider, KEYS)
    assert len(plans) == 5 and "Join" in plans[3] and "Join" not in plans[4]
    assert sorted((r.Year, r.Umaban, r.Bamei, r.extra) for r in tables.read_latest(spark, path).collect() if r.Bamei == "b") == [("2022", "2", "b", 8), ("2023", "1", "b", 7)]


def test_a_stored_table_leaves_no_shuffle_files(spark):
    from furlong.session import materialize
    before = shuffle_files(spark)
    stored = materialize(spark.range(3000).groupBy((F.col("id") % 100).alias("k")).count(), "counts")
    assert shuffle_files(spark) <= before and stored.count() == 100
