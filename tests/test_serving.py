import datetime as dt

import pytest

from furlong.operators import quality, serving

RES = ("date date, venue string, kaisai string, race_num double, race_name string, distance double, "
       "surface string, horse_num double, horse_id string, horse_name string")


@pytest.fixture()
def results(spark):
    d = dt.date(2024, 1, 6)
    return spark.createDataFrame([
        (d, "東京", "1東京2", 11.0, " 有馬 ", 2500.0, "芝", 1.0, " 7 ", "A"),
        (d, "東京", "1東京2", 11.0, "有馬", 2500.0, "芝", 2.5, "8", "B"),       # 2.5 -> umaban '03', frame 2
        (d, "大井", "1大井2", 3.0, "x", 1200.0, "ダート", 1.0, "9", "C"),       # unknown venue
        (d, "中山", "101中山2", 4.0, " ", 1800.0, None, 4.0, "1", "D"),        # 3 digits, blank name
        (d, "中山", "中山", 5.0, "y", 1800.0, "芝", 1.0, "2", "E"),            # no meeting digits
        (None, "中山", "1中山1", 5.0, "y", 1800.0, "芝", 1.0, "3", "F"),       # NULL date
    ], RES)


def test_summary_and_serving_races(spark, results):
    races = {r["race_id"]: r for r in serving.serving_races(serving.race_summary(results)).collect()}
    assert set(races) == {"2024010605010211", "2024010606100204"}
    r = races["2024010605010211"]
    assert (r["race_name"], r["kyori"], r["course"], r["race_no"]) == ("有馬", 2500, "芝", 11)
    assert races["2024010606100204"]["race_name"] == "4R" and races["2024010606100204"]["course"] is None


def test_fallback_and_serving_entries(spark, results):
    fb = {(r["kaisai"], r["umaban"]): r for r in serving.entry_fallback(results).collect()}
    assert fb[("1東京2", "03")]["wakuban"] == 2 and fb[("1東京2", "01")]["ketto_num"] == "7"
    se = spark.createDataFrame([("2024", "106", "5", "1", "2", "11", "1", " 1", "K1", "SEname")],
                               "Year string, MonthDay string, JyoCD string, Kaiji string, Nichiji string, "
                               "RaceNum string, Wakuban string, Umaban string, KettoNum string, Bamei string")
    ent = {(r["race_id"], r["umaban"]): r for r in serving.serving_entries(se, serving.entry_fallback(results)).collect()}
    assert ent[("2024010605010211", "01")]["bamei"] == "SEname"            # feed beats fallback
    assert ent[("2024010605010211", "03")]["bamei"] == "B"
    assert ("2024010600010203", "01") in ent                                # unknown venue -> '00', kept
    report = {r["check_name"]: r for r in quality.quality_report(
        serving.serving_races(serving.race_summary(results)), serving.serving_entries(
            se, serving.entry_fallback(results)), "2024-01-31").collect()}
    assert report["serving_entries_orphan_race_id"]["issue_count"] == 1
    assert report["serving_races_freshness_days"]["lag_days"] == 25
    assert report["serving_races_null_kyori_or_course_rate"]["issue_rate"] == 0.5


def test_race_card_errors_and_order(spark, results):
    races = serving.serving_races(serving.race_summary(results))
    entries = serving.serving_entries(
        spark.createDataFrame([], "Year string, MonthDay string, JyoCD string, Kaiji string, Nichiji string, "
                                  "RaceNum string, Wakuban string, Umaban string, KettoNum string, Bamei string"),
        serving.entry_fallback(results))
    with pytest.raises(serving.InvalidRaceId):
        serving.race_card(races, entries, "2024-01")
    assert serving.race_card(races, entries, "2099010105010101").count() == 0     # race not found
    card = serving.race_card(races, entries, "2024010605010211").collect()
    assert [r["umaban"] for r in card] == ["01", "03"]
    assert card[0]["kaisai_date"] == "2024-01-06" and card[0]["kyori"] == "2500"


def test_race_list_top_k(spark, results):
    lst = serving.race_list(serving.serving_races(serving.race_summary(results)), limit=1).collect()
    assert len(lst) == 1 and lst[0]["kaisai_basho"] == "中山"      # same date: venue ascending (byte order)


SE = ("Year string, MonthDay string, JyoCD string, Kaiji string, Nichiji string, RaceNum string, "
      "Wakuban string, Umaban string, KettoNum string, Bamei string")


def test_ids_with_leading_zeros_and_wide_digits(spark, results):
    se = spark.createDataFrame([("0000", "106", "5", "1", "2", "3", "1", " 1", "K", "zero"),
                                ("２０２４", "106", "5", "1", "2", "3", "1", " 1", "K", "wide")], SE)
    ids = [r["race_id"] for r in serving.serving_entries(se, serving.entry_fallback(results).limit(0)).collect()]
    assert ids == ["0000010605010203"]


def test_sorts_of_the_serving_tables_are_led_by_a_number(spark, results, capsys):
    """Texts of many rows are grouped and ranked behind one number, and the
    entries are sorted once, after the exchange."""
    def plan(df):
        df.explain()
        return capsys.readouterr().out.split("AdaptiveSparkPlan")[-1]
    for df in (serving.race_summary(results), serving.entry_fallback(results)):
        assert "Sort [_race#" in plan(df)
    entries = plan(serving.serving_entries(spark.createDataFrame([], SE).limit(1), serving.entry_fallback(results)))
    lines = entries.splitlines()
    sorts = [k for k, x in enumerate(lines) if "Sort [_rid#" in x]
    deals = [k for k, x in enumerate(lines) if "hashpartitioning(_rid#" in x]
    assert len(sorts) == 1 and len(deals) == 1 and sorts[0] < deals[0]
