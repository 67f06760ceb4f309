from pyspark.sql import functions as F

from furlong.functions import codes, race_id as rid, text


def one(spark, col, value, typ="string"):
    return spark.createDataFrame([(value,)], f"v {typ}").select(col.alias("r")).first()["r"]


def test_trim_ws_strips_unicode_whitespace(spark):
    assert one(spark, text.trim_ws("v"), "　 ab　\t") == "ab"
    assert one(spark, F.trim("v"), "　ab") == "　ab"      # why F.trim is not enough
    assert one(spark, text.trim_ws("v"), None) is None


def test_padding_rules(spark):
    assert one(spark, text.sql_lpad("v", 2), "101") == "10"       # SQL LPAD truncates
    assert one(spark, text.pad_start("v", 2), "101") == "101"     # JS padStart does not
    assert one(spark, text.pad_start("v", 2), "7") == "07"


def test_digit_extracts_null_on_no_match(spark):
    assert one(spark, text.leading_digits("v"), "東京2") is None
    assert one(spark, text.trailing_digits("v"), "1東京") is None
    assert one(spark, text.leading_digits("v"), "12東京3") == "12"
    assert one(spark, text.trailing_digits("v"), "1東京2\n") is None   # end of text, as RE2


def test_null_markers(spark):
    for v in ["", " None ", "nan", "NaN"]:
        assert one(spark, text.clean_null_markers("v"), v) is None
    assert one(spark, text.clean_null_markers("v"), " 良 ") == "良"


def test_nfkc(spark):
    df = spark.createDataFrame([("ﾍﾞｰﾀ",), ("Ｈ１２",), ("abc",), (None,), ("ベータ",)], "v string")
    got = [r[0] for r in df.select(text.nfkc("v")).collect()]
    assert got == ["ベータ", "H12", "abc", None, "ベータ"]


def test_race_id(spark):
    p = rid.race_id_parts("v")
    r = spark.createDataFrame([("2024010105010203",)], "v string").select(p.alias("p")).first()["p"]
    assert (r.year, r.month_day, r.jyo_cd, r.kaiji, r.nichiji, r.race_num) == ("2024", "0101", "05", "01", "02", "03")
    assert one(spark, rid.race_id_parts("v"), "2024010105010203\n") is None
    assert one(spark, rid.is_race_id("v"), "123") is False
    assert one(spark, rid.format_race_date(F.lit("2024"), F.col("v")), "105") == "2024-01-05"
    kn = spark.createDataFrame([("101東京2",)], "v string").select(rid.kaiji_nichiji("v").alias("k")).first()["k"]
    assert (kn.kaiji, kn.nichiji) == ("101", "02")


def test_codes(spark):
    assert one(spark, codes.venue_code("v"), "東京") == "05"
    assert one(spark, codes.venue_code("v"), "大井") is None
    assert one(spark, codes.venue_code("v", "00"), "大井") == "00"
    assert one(spark, codes.venue_name("v"), "10") == "小倉"
    assert one(spark, codes.track_name("v"), "23") == "ダ・右"
    bands = [one(spark, codes.score_band("v"), x, "double") for x in [None, 80.0, 79.9, 65.0, 50.0, 49.9]]
    assert bands == [None, "high", "good", "good", "fair", "low"]


def test_trim_by_ends_is_trim(spark):
    spaces = [chr(i) for i in range(0x110000) if chr(i).isspace()]
    texts = [None, "", "a", "、", "　", "~\x7f", "\x7f", "\x00a", "é", "a b", "芝"]
    texts += [x for s in spaces for x in (s, f"a{s}", f"{s}a", f"芝{s}", f"{s}芝", f"a{s}a", f"{s}a{s}")]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    for r in df.select("v", text.trim_ws("v").alias("a"), text.trim_ws_by_ends("v").alias("b")).collect():
        assert r.a == r.b == (None if r.v is None else r.v.strip()), repr(r.v)
