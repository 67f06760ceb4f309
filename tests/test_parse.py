from pyspark.sql import functions as F

from furlong.operators import parse


def se_record(name: str, body: str = "") -> str:
    return "SE7202401012024010105010102" + "1" + "03" + "0000000123" + name + body


def test_lanes_of_the_record_helper():
    assert parse.parse_record(None) == {"error": "Too short"}
    assert parse.parse_record("X") == {"error": "Too short"}
    assert parse.parse_record("ZZabc") == {"record_type": "ZZ", "_parsed": False}
    assert parse.parse_record("SE café") == {"record_type": "SE", "error": "Encoding failed"}


def test_fixed_width_fields_by_cp932_bytes():
    # a 36-byte name: 4 full-width characters (8 bytes) padded with U+3000 (2 bytes each)
    name = "ウマノコ" + "　" * 14
    r = parse.parse_record(se_record(name, " tail\r\n"))
    assert r["_parsed"] is True and r["record_type"] == "SE"
    assert (r["Year"], r["MonthDay"], r["JyoCD"], r["RaceNum"]) == ("2024", "0101", "05", "02")
    assert (r["Wakuban"], r["Umaban"], r["KettoNum"]) == ("1", "03", "0000000123")
    assert r["Bamei"] == "ウマノコ"                 # U+3000 padding stripped
    assert r["raw_body"] == "tail"                 # CRLF stripped


def test_cut_mid_character_and_short_records():
    # 1 + 18 * 2 = 37 bytes: the 36-byte field ends inside the 18th character
    r = parse.parse_record(se_record("a" + "ア" * 18))
    assert r["Bamei"] == "a" + "ア" * 17 + "\ufffd"
    assert r["raw_body"] == "A"                    # the orphan trail byte 0x41
    ra = "RA7202401012024010105010101" + "1" + "0001" + "x" * 620
    r = parse.parse_record(ra[:650])
    assert r["Kyori"] == "" and r["TrackCD"] == "xx" and "raw_body" not in r
    hr = parse.parse_record("HR720240101")
    assert hr["RaceNum"] == "" and hr["_parsed"] is True


def test_spark_parse_matches_helper_and_ignores_partitioning(spark):
    rows = [se_record("ウマ" + " " * 32, "b"), "X", None, "ZZ1", "SEé", "HR7202401012024010105010101 x"]
    df = spark.createDataFrame([(r,) for r in rows], "raw_data string")
    out = parse.parse_records(df, fetched_at="t")
    for n in (1, 5):
        got = {tuple(r) for r in parse.parse_records(df.repartition(n), fetched_at="t").collect()}
        assert got == {tuple(r) for r in out.collect()}
    by_raw = {r["raw_data"]: r.asDict() for r in out.collect()}
    for raw in rows:
        exp = parse.parse_record(raw)
        got = by_raw[raw]
        for k in parse.LANDING_COLUMNS[:-2]:
            assert got[k] == exp.get(k), (raw, k)
        assert got["fetched_at"] == "t"


def test_type_tag_and_census(spark):
    df = spark.createDataFrame([("RA", "RAxx", None), (None, "X", None), (None, None, None), (None, None, "{bad")],
                               "record_type string, raw_data string, _corrupt_record string")
    tags = [r[0] for r in df.select(parse.type_tag(corrupt="_corrupt_record")).collect()]
    assert tags == ["RA", "X", "UNKNOWN", "ERROR"]
    census = {r["tag"]: r["n"] for r in parse.record_census(df, "_corrupt_record").collect()}
    assert census == {"RA": 1, "X": 1, "UNKNOWN": 1, "ERROR": 1, None: 4}


def test_layout_profile_counts_records_reaching_each_offset(spark):
    df = spark.createDataFrame([("ABC",), ("AB",), ("AZ",)], "raw_data string").withColumn("record_type", F.lit("T"))
    prof = {r["offset"]: r for r in parse.layout_profile(df, 0, 3).collect()}
    assert prof[0]["n_records"] == 3 and prof[0]["n_distinct"] == 1 and prof[0]["min_hex"] == "41"
    assert prof[1]["n_distinct"] == 2 and prof[1]["max_hex"] == "5A"
    assert prof[2]["n_records"] == 1


def test_layout_cuts_find_the_fields_of_a_number(spark):
    """Zero-padded numbers side by side, then text: cuts where the first digit
    of the next number is and where the letters begin."""
    rows = [(f"RA{k % 100:03d}{k % 7 + 100:04d}{'abcdefgh'[k % 8] * 3}",) for k in range(400)]
    got = {r.offset: r for r in parse.layout_cuts(spark.createDataFrame(rows, "raw_data string").withColumn("record_type", F.lit("RA"))).collect()}
    assert {o for o, r in got.items() if r.cut} == {0, 2, 5, 9}
    assert got[0].entropy == 0 and abs(got[4].entropy - 3.3219) < 1e-3 and got[9].change == 1.0
    assert got[11].n_records == 400 and len(got) == 12


def test_layout_cuts_of_the_feed(spark):
    from furlong.plans import bindings as B
    t = B.text_records(spark, "/root/testdata/sf0.001").withColumn("record_type", F.substring("raw_data", 1, 2))
    cuts = {(r.record_type, r.offset) for r in parse.layout_cuts(t).filter("cut").collect()}
    # where the layouts say that a field begins: day, course code, meeting, day number, race number, distance
    assert {("RA", o) for o in (2, 19, 21, 23, 25, 697)} <= cuts
    assert {("SE", o) for o in (2, 19, 21, 23, 25, 40)} <= cuts
    assert 6 <= sum(t == "RA" for t, _ in cuts) < 100   # of 708 offsets


def test_layout_ranges_show_hex_and_text(spark):
    rows = [("SE", "SE馬x"), ("SE", "SE"), ("SE", "SEab"), ("RA", "RA1"), ("ZZ", "ZZ1")]
    got = [tuple(r) for r in parse.layout_ranges(spark.createDataFrame(rows, "record_type string, raw_data string"), {"SE": [(0, 2), (2, 5)], "RA": [(1, 9)]}, 3).collect()]
    assert sorted(got, key=str) == sorted([
        ("RA", 1, 1, 9, "4131", "A1"), ("SE", 1, 0, 2, "5345", "SE"), ("SE", 1, 2, 5, None, None), ("SE", 2, 0, 2, "5345", "SE"), ("SE", 2, 2, 5, "6162", "ab"),
        ("SE", 3, 0, 2, "5345", "SE"), ("SE", 3, 2, 5, "946E78", "馬x")], key=str)


def test_ascii_records_are_sliced_as_the_helper_slices_them(spark):
    """Plain, wide and control characters around every layout's edges; a read
    of the type alone does not go through Python."""
    rows = ["SE \n", " S", "S馬", ""]
    for t in ("RA", "SE", "JG", "HR", "O1", "ZZ"):
        rows += [t + (text * 400)[:n] for n in (0, 25, 28, 30, 40, 73, 74, 75, 98, 650, 699, 700, 790) for text in ("ab  12 ", "a \t\x00", "馬 ア", "~\x7f ")]
    out = parse.parse_records(spark.createDataFrame([(r,) for r in rows], "raw_data string"), fetched_at="t")
    for r in out.collect():
        exp = parse.parse_record(r["raw_data"])
        assert {k: r[k] for k in parse.LANDING_COLUMNS[:-2]} == {k: exp.get(k) for k in parse.LANDING_COLUMNS[:-2]}, r["raw_data"]
    plan = out.filter("record_type = 'SE'").groupBy("record_type").count()._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan


def test_wide_records_come_back_from_python_as_one_column(spark):
    raw = "SE7202401012024010105010203" + "1" + "03" + "0000000123" + "馬".ljust(35) + "後"
    out = parse.parse_records(spark.createDataFrame([(raw,), ("SE\U0001f40e",), (None,)], "raw_data string"), fetched_at="t")
    rows = [r.asDict() for r in out.collect()]
    for r in rows:
        assert {k: r[k] for k in parse.LANDING_COLUMNS[:-2]} == {k: parse.parse_record(r["raw_data"]).get(k) for k in parse.LANDING_COLUMNS[:-2]}
    assert rows[0]["Bamei"] == "馬" and rows[0]["raw_body"] == "後" and rows[1]["_parsed"] is None and rows[1]["error"] == parse.ERROR_ENCODING
    assert "array<string>" in str(parse._parse_udf.returnType.simpleString())
