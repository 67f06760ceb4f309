"""Race analysis against a brute-force re-statement of the reference query,
race by race, on a hand-made fixture covering FIXTURES.md section 5."""

import datetime as dt
import math
import os
import random
import statistics
import unicodedata
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from furlong.operators import form

D = dt.date
AS_OF = D(2024, 6, 30)
RACES = [  # race_id, kaisai_date, kaisai_basho, race_no, race_name, kyori, course
    ("2024063005010101", D(2024, 6, 30), "東京", 1, "A", 1600, "芝"),
    ("2024063005010102", D(2024, 6, 30), "東京", 2, "B", 1200, " "),        # blank course
    ("2024063005010103", D(2024, 6, 30), "東京", 3, "C", 1800, "ダート"),    # one-runner field
]
ENTRIES = [  # race_id, wakuban, umaban, ketto_num, bamei
    ("2024063005010101", "1", "1", "K1", "Alpha"),      # more than five runs
    ("2024063005010101", "1", "2", "K2", "ﾍﾞｰﾀ"),       # half-width name, full-width history
    ("2024063005010101", "2", "3", "K3", "Gamma"),      # no history
    ("2024063005010101", "2", "4", "K1", "Alpha2"),     # shares K1: pooled history
    ("2024063005010101", "3", "5", None, "Delta"),      # NULL id: starts 0
    ("2024063005010101", "3", "6", "K6", "Eps"),        # last run 181 days ago
    ("2024063005010101", "4", "7", "K7", "Zeta"),       # last run 180 days ago, fewer than 3 runs
    ("2024063005010101", "4", "8", "K8", None),         # NULL name: matches nothing
    ("2024063005010102", "1", "1", "K1", "Alpha"),
    ("2024063005010103", "1", "1", "K9", "Solo"),
    ("2099010105010101", "1", "1", "K1", "Alpha"),      # race missing: no rows
]


def run(name, date, rank, pop, dist, surf, t):
    return (name, date, rank, pop, dist, surf, t)


HISTORY = [  # horse_name, race_date, rank, popularity, distance, surface, time_sec
    *[run(" Alpha ", D(2024, 1, m), m % 4 + 1, m, 1600.0 + 100 * m, "芝", 95.0 + m) for m in range(1, 8)],
    run("Alpha", D(2024, 1, 7), 2, 3, 1400.0, "ダート", 90.0),    # same date as another run
    run("Alpha2", D(2024, 6, 1), 1, 1, 1600.0, "芝", 96.0),
    run("ベータ", D(2024, 3, 1), 3, 12, 2000.0, "ダート", 0.0),     # time 0: no speed
    run("ベータ", D(2024, 2, 1), 5, 15, 1700.0, "芝", 101.0),
    run("Delta", D(2024, 5, 1), 1, 2, 1600.0, "芝", 97.0),
    run("Eps", D(2023, 12, 31), 4, 9, 1000.0, "芝", 60.0),        # 181 days before AS_OF
    run("Zeta", D(2024, 1, 2), 2, 5, 1800.0, "芝", 110.0),        # 180 days before AS_OF
    run("Solo", D(2024, 4, 1), 1, 1, 1800.0, "ダ", 108.0),
    run("Solo", D(2024, 4, 2), None, 1, 1800.0, "ダ", 107.0),    # NULL rank
    run(None, D(2024, 4, 3), 1, 1, 1800.0, "芝", 100.0),
]
MASTER = [  # horse_key, horse_name, surface, speed_index, run_count
    ("K1", "Alpha", "芝", 110.0, 5),
    ("", "ベータ", "芝", 95.0, 2),
    (None, "ベータ", "芝", 97.0, 2),              # tie on run_count: higher index wins
    ("K6", "Eps", "ダ", 120.0, 3),               # other surface: unused
    ("K7", "Zeta", "芝", None, 1),               # NULL index: dropped
]


def nf(s):
    return None if s is None else unicodedata.normalize("NFKC", s)


def half_up(x, n):
    return None if x is None else float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-n), ROUND_HALF_UP))


def avg(xs):
    xs = [x for x in xs if x is not None]
    return sum(xs) / len(xs) if xs else None


def brute(race_id):
    t = [r for r in RACES if r[0] == race_id]
    if not t:
        return []
    _, _, _, _, _, kyori, course = t[0]
    tdist = kyori
    tsurf = None if course is None or course.strip() == "" else course.strip()[0]
    ents = [e for e in ENTRIES if e[0] == race_id]
    raw = []
    for e in ents:
        m = [h for h in HISTORY if h[0] is not None and nf(h[0].strip()) == nf(e[4])]
        for h in (m or [None]):
            raw.append((e, h))

    def key(row):
        e, h = row
        if h is None:
            vals = (None,) * 6
        else:
            vals = (h[1], h[2], h[3], h[4], h[5].strip(), h[6])
        return ((vals[0] is None, -(vals[0].toordinal()) if vals[0] else 0),
                *[(v is None, v if v is not None else 0) for v in vals[1:]], e[2], e[1], e[4])
    hist = []
    for k in {e[3] for e in ents}:
        part = sorted([r for r in raw if r[0][3] == k], key=key)
        hist += [(r, i + 1) for i, r in enumerate(part[:5])]
    out = []
    agg = []
    for e in ents:
        hs = [(h, rn) for (ee, h), rn in hist if e[3] is not None and ee[3] == e[3]] or [(None, None)]
        g = lambda i: [None if h is None else h[i] for h, _ in hs]
        rank = [None if v is None else float(v) for v in g(2)]
        dates = g(1)
        starts = sum(d is not None for d in dates)
        rates = lambda f: sum(1.0 if f(h) else 0.0 for h, _ in hs) / len(hs)
        a = dict(
            e=e, starts=starts, avg_rank=avg(rank),
            avg_rank_recent=avg([r if rn is not None and rn <= 3 else None for r, (_, rn) in zip(rank, hs)]),
            win=rates(lambda h: h is not None and h[2] == 1),
            top3=rates(lambda h: h is not None and h[2] is not None and h[2] <= 3),
            surf=rates(lambda h: h is not None and tsurf is not None and h[5].strip()[0] == tsurf),
            dist=rates(lambda h: h is not None and abs(h[4] - tdist) <= 200),
            speed=avg([h[4] / h[6] if h is not None and h[6] > 0 else None for h, _ in hs]),
            pop=avg([None if h is None else h[3] for h, _ in hs]),
            last=max([d for d in dates if d is not None], default=None))
        agg.append(a)
    sp = [a["speed"] for a in agg if a["speed"] is not None]
    mu = statistics.fmean(sp) if sp else None
    sd = statistics.pstdev(sp) if sp else None
    m = [(None if k is None else k.strip(), nf(n.strip()), s.strip(), si, rc) for k, n, s, si, rc in MASTER
         if si is not None]
    for a in agg:
        e = a["e"]
        z = 0.0 if sd is None or sd == 0 or a["speed"] is None else (a["speed"] - mu) / sd
        ids = [x for x in m if x[0] and x[2] == tsurf and x[0] == e[3]]
        names = sorted([x for x in m if x[1] and x[2] == tsurf and x[1] == nf(e[4])],
                       key=lambda x: (-(x[4] or 0), -x[3]))
        sid = max(x[3] for x in ids) if ids else None
        snm = names[0][3] if names else None
        final = sid if sid is not None else snm if snm is not None else 100.0 + z * 10.0
        factor = (sid - 100.0) / 10.0 if sid is not None else (snm - 100.0) / 10.0 if snm is not None else z
        src = "master_id" if sid is not None else "master_name" if snm is not None else "fallback"
        st, last = a["starts"], a["last"]
        score = (52.0 + (0.0 if a["avg_rank_recent"] is None else (8.0 - a["avg_rank_recent"]) * 5.0)
                 + a["top3"] * 16.0 + a["win"] * 10.0 + a["surf"] * 8.0 + a["dist"] * 6.0 + factor * 6.0
                 - (0.0 if a["pop"] is None else max(a["pop"] - 8.0, 0.0) * 1.2)
                 - (14.0 if not st else 4.0 if st < 3 else 0.0)
                 - (2.0 if last is None else 3.0 if (AS_OF - last).days > 180 else 0.0))
        out.append(dict(race_id=e[0], wakuban=e[1], umaban=e[2].zfill(2), ketto_num=e[3], bamei=e[4],
                        starts=st, avg_rank=half_up(a["avg_rank"], 2),
                        win_rate=half_up(a["win"] * 100.0, 1), top3_rate=half_up(a["top3"] * 100.0, 1),
                        surface_match_rate=half_up(a["surf"] * 100.0, 1),
                        distance_match_rate=half_up(a["dist"] * 100.0, 1),
                        speed_index=half_up(final, 1), speed_source=src,
                        analysis_score=half_up(min(100.0, max(0.0, score)), 1),
                        last_race_date=None if last is None else last.isoformat()))
    return out


@pytest.fixture(scope="module")
def frames(spark):
    races = spark.createDataFrame(RACES, "race_id string, kaisai_date date, kaisai_basho string, race_no long, "
                                         "race_name string, kyori long, course string")
    entries = spark.createDataFrame(ENTRIES, "race_id string, wakuban string, umaban string, ketto_num string, "
                                             "bamei string")
    history = spark.createDataFrame(HISTORY, "horse_name string, race_date date, rank long, popularity long, "
                                             "distance double, surface string, time_sec double")
    master = spark.createDataFrame(MASTER, "horse_key string, horse_name string, surface string, "
                                           "speed_index double, run_count long")
    return races, entries, history, master


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, abs_tol=1e-9)
    return a == b


def test_all_races_match_brute_force(frames):
    races, entries, history, master = frames
    got = [r.asDict() for r in form.race_analysis(races, entries, history, master, as_of=AS_OF).collect()]
    exp = [row for rid in sorted({e[0] for e in ENTRIES}) for row in brute(rid)]
    key = lambda r: (r["race_id"], r["umaban"])
    got, exp = sorted(got, key=key), sorted(exp, key=key)
    assert len(got) == len(exp) == 10
    for g, e in zip(got, exp):
        for k in e:
            assert close(g[k], e[k]), (key(e), k, g[k], e[k])
    by = {key(r): r for r in got}
    assert by[("2024063005010101", "02")]["speed_source"] == "master_name"
    assert by[("2024063005010101", "02")]["speed_index"] == 97.0
    assert by[("2024063005010101", "05")]["starts"] == 0
    assert by[("2024063005010103", "01")]["speed_index"] == 100.0     # one-runner field: sd 0
    assert all(0.0 <= r["analysis_score"] <= 100.0 for r in got)


def test_single_race_matches_batch_and_validates_id(frames):
    races, entries, history, master = frames
    one = [r.asDict() for r in form.race_analysis(races, entries, history, master,
                                                  race_id="2024063005010101", as_of=AS_OF).collect()]
    assert [r["umaban"] for r in one] == ["01", "02", "03", "04", "05", "06", "07", "08"]
    exp = {r["umaban"]: r for r in brute("2024063005010101")}
    for r in one:
        for k, v in exp[r["umaban"]].items():
            assert close(r[k], v), (k, r[k], v)
    from furlong.operators.serving import InvalidRaceId
    with pytest.raises(InvalidRaceId):
        form.race_analysis(races, entries, history, master, race_id="bad")


def test_empty_master_falls_back(frames):
    races, entries, history, _ = frames
    got = form.race_analysis(races, entries, history, None, as_of=AS_OF).collect()
    assert {r["speed_source"] for r in got} == {"fallback"}


def test_runs_before_the_race_match_brute_force(spark):
    """As-of runs over several years, with ties, several runs a day, runs on
    the day itself, runs without a date, and entries without a match."""
    import random
    rnd = random.Random(4)
    days = [D(2019, 1, 1) + dt.timedelta(days=37 * k) for k in range(45)]
    runs = [(rnd.choice("abc"), rnd.choice(days), rnd.choice([1, 2, None]), rnd.choice([3, None]), 1000.0, rnd.choice(["芝", None]), rnd.choice([60.0, 61.0])) for _ in range(400)]
    runs += [("a", None, 1, 1, 1000.0, "芝", 60.0), (None, days[3], 1, 1, 1000.0, "芝", 60.0), ("", days[3], 1, 1, 1000.0, "芝", 60.0)]
    races = [(f"{k:016d}", rnd.choice(days), "東京", 1, "r", 1600, "芝") for k in range(30)] + [(f"{99:016d}", None, "東京", 1, "r", 1600, "芝")]
    entries = [(r[0], "1", str(n), f"{r[0]}-{n}", name) for r in races for n, name in enumerate(["a", "b", "z", None, ""], 1)]
    history = spark.createDataFrame(runs, "horse_name string, race_date date, rank int, popularity int, distance double, surface string, time_sec double")
    race_df = spark.createDataFrame(races, "race_id string, kaisai_date date, kaisai_basho string, race_no int, race_name string, kyori int, course string")
    entry_df = spark.createDataFrame(entries, "race_id string, wakuban string, umaban string, ketto_num string, bamei string")
    got: dict = {}
    for n in (1, 3, 5):
        got = {}
        for r in form.form_history(form.analysis_entries(entry_df), history, n=n, before_race=True, races=race_df).collect():
            got.setdefault(r.ketto_num, []).append((r.rn, r.race_date, r.rank, r.popularity, r.surface, r.time_sec))
        low = lambda x: (x is None, x)
        date_of = {r[0]: r[1] for r in races}
        for race, _, _, key, name in entries:
            mine = [r for r in runs if name and r[0] == name and r[1] and date_of[race] and r[1] < date_of[race]]
            mine.sort(key=lambda r: (-r[1].toordinal(), low(r[2]), low(r[3]), low(r[5]), low(r[6])))
            want = [(i, r[1], r[2], r[3], r[5], r[6]) for i, r in enumerate(mine[:n], 1)] or [(1, None, None, None, None, None)]
            assert sorted(got[key]) == want, (n, key)
    with pytest.raises(ValueError):
        form.form_history(form.analysis_entries(entry_df), history, before_race=True)


def test_hot_name_is_split(spark):
    """Four fifths of the entries share one name: the executed join is a skew join."""
    from pyspark.sql import functions as F
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        name = F.when(F.col("id") % 5 > 0, F.lit("hot")).otherwise(F.concat(F.lit("h"), F.col("id").cast("string")))
        e = spark.range(0, 60_000, 1, 12).select(F.format_string("%016d", (F.col("id") / 10).cast("long")).alias("race_id"), F.lit("1").alias("wakuban"),
                                                 (F.col("id") % 10).cast("string").alias("umaban"), F.col("id").cast("string").alias("ketto_num"), name.alias("bamei"))
        h = spark.range(200).select(F.lit("hot").alias("horse_name"), F.date_add(F.lit("2020-01-01"), F.col("id").cast("int")).alias("race_date"), F.lit(1).alias("rank"),
                                    F.lit(1).alias("popularity"), F.lit(1000.0).alias("distance"), F.lit("芝").alias("surface"), F.lit(60.0).alias("time_sec"))
        out = form.form_runs(form.analysis_entries(e), h)
        rows = out.filter("race_date is not null").collect()   # of this very plan
        plan = out.filter("race_date is not null")
        n = plan.groupBy().count()
        assert len(rows) == 48_000 * 5 and n.collect()[0][0] == 48_000 * 5
        assert "skew=true" in n._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_one_nan_changes_no_other_runner(frames, spark):
    races, entries, history, master = frames
    nan = float("nan")
    odd = history.unionByName(spark.createDataFrame([("Gamma", D(2024, 6, 1), 9, 3, 1600.0, "芝", nan)], history.schema))
    score = lambda h: {(r.race_id, r.umaban): r.analysis_score for r in form.race_analysis(races, entries, h, None, as_of=AS_OF).collect()}
    before, after = score(history), score(odd)
    assert {k: v for k, v in after.items() if k[1] != "03"} == {k: v for k, v in before.items() if k[1] != "03"}
    assert all(v == v for v in after.values()) and after[("2024063005010101", "03")] < 100


def test_race_page_tells_missing_from_empty(frames, spark):
    from furlong.operators.serving import InvalidRaceId, race_page
    races, entries, _, _ = frames
    ids = ["2024063005010101", "2024063005010103", "2000010105010101"]
    got = {r.race_id: r for r in race_page(races, entries.filter("race_id != '2024063005010103'"), ids).collect()}
    assert [(got[i].found, got[i].n_runners) for i in ids] == [(True, 8), (True, 0), (False, 0)]
    assert got[ids[1]].race_name == "C" and got[ids[2]].race_name is None
    with pytest.raises(InvalidRaceId):
        race_page(races, entries, ["x"])


def test_null_keys_spread_and_never_match(spark):
    from pyspark.sql import functions as F
    left = spark.range(2000).select(F.col("id").cast("string").alias("race_id"),
                                    F.lit("01").alias("umaban"), F.lit(None).cast("string").alias("k"))
    key = form.null_spread_key(F.col("k"), "race_id", "umaban")
    keys = left.select(key.alias("j"))
    assert keys.distinct().count() == 2000                       # spread, not one hot value
    right = keys.limit(0).union(spark.createDataFrame([("x",), ("",)], "j string"))
    assert left.join(right, key == right.j, "inner").count() == 0
    assert left.join(right, key == right.j, "left").count() == 2000


def test_as_of_history_of_a_hot_name(spark):
    """One name with most of the runs and entries, many runs a day, equal to brute force."""
    import datetime as dt
    rng = random.Random(4)
    day = lambda k: dt.date(2019, 11, 1) + dt.timedelta(days=k)
    runs = [(rng.choice(["hot"] * 5 + ["a", "b"]), day(rng.randrange(0, 120)), float(rng.randrange(1, 9)), float(rng.randrange(1, 5)), 1000.0, "芝", float(k)) for k in range(3000)]
    runs += [("hot", None, 1.0, 1.0, 1.0, "芝", 1.0), ("c", day(3), None, None, None, None, None)]
    entries = [(k, rng.choice(["hot"] * 5 + ["a", "c", "none", "", None]), None if k % 37 == 0 else day(rng.randrange(-5, 130))) for k in range(600)]
    cols = ["race_date", "rank", "popularity", "distance", "surface", "time_sec"]
    r = spark.createDataFrame(runs, "name_norm string, race_date date, rank double, popularity double, distance double, surface string, time_sec double")
    e = spark.createDataFrame(entries, "k int, name_norm string, _tdate date")
    got = {}
    for x in form.runs_as_of(e, r, 4).collect():
        got.setdefault(x.k, []).append(tuple(x[c] for c in cols))
    last = lambda v: (v is None, v or 0)
    for k, name, at in entries:
        mine = [x[1:] for x in runs if x[0] == name and name and at and x[1] and x[1] < at]
        mine.sort(key=lambda x: (-x[0].toordinal(), last(x[1]), last(x[2]), last(x[3]), x[4] is None, x[4] or "", last(x[5])))
        assert sorted(got[k], key=str) == sorted(mine[:4] or [(None,) * 6], key=str), (k, name, at)


def test_tokyo_date_across_a_day_boundary(spark):
    """The default day of the analysis is Tokyo's, whatever the session's zone."""
    zone = "spark.sql.session.timeZone"
    before = spark.conf.get(zone)
    try:
        for tz, local, want in (("UTC", "2024-03-01 14:59:59", "2024-03-01"), ("UTC", "2024-03-01 15:00:00", "2024-03-02"),
                                ("America/New_York", "2024-03-01 09:59:59", "2024-03-01"), ("America/New_York", "2024-03-01 10:00:00", "2024-03-02"),
                                ("Asia/Tokyo", "2024-03-01 23:59:59", "2024-03-01"), ("Asia/Tokyo", "2024-03-02 00:00:00", "2024-03-02")):
            spark.conf.set(zone, tz)
            got = spark.range(1).select(form.tokyo_date(F.lit(local).cast("timestamp_ntz")).cast("string").alias("d")).first().d
            assert got == want, (tz, local)
        import datetime as dt
        from zoneinfo import ZoneInfo
        days = [dt.datetime.now(ZoneInfo("Asia/Tokyo")).date() for _ in range(2)]
        spark.conf.set(zone, "America/Los_Angeles")
        now = spark.range(1).select(form.default_as_of().alias("d")).first().d
        assert days[0] <= now <= dt.datetime.now(ZoneInfo("Asia/Tokyo")).date()
    finally:
        spark.conf.set(zone, before)


def test_a_point_read_skips_row_groups(spark, scratch):
    """Bloom filters: of many row groups that all span the key, few are read."""
    from furlong.sources.stored import store_sorted
    rows = spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), F.sha2((F.col("id") * 7).cast("string"), 512).alias("body"))
    wanted = rows.first().key
    store_sorted(rows, f"{scratch}/t", "key")
    table = spark.read.parquet(f"{scratch}/t").filter(F.col("key") == wanted)
    assert table.count() == 1
    import pyarrow.parquet as pq
    folder = f"{scratch}/t"
    groups = sum(pq.ParquetFile(os.path.join(folder, f)).num_row_groups for f in os.listdir(folder) if f.endswith(".parquet"))
    plan = table.select("body")
    plan.collect()
    scan = plan._jdf.queryExecution().executedPlan().toString()
    assert groups > 1 and "PushedFilters: [IsNotNull(key), EqualTo(key," in scan
    read = max(int(v) for v in metric_values(plan, "number of output rows", "Scan"))
    assert read < 200_000 / 2


def metric_values(df, name, node):
    """Values of a metric of the plan's nodes whose name begins with ``node``."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        for child in ("children", "innerChildren"):
            it = getattr(p, child)().iterator()
            while it.hasNext():
                todo.append(it.next())
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        if p.nodeName().startswith(node):
            m = p.metrics().get("numOutputRows")
            if m.isDefined():
                out.append(m.get().value())
    return out


def test_runs_cross_the_shuffles_once(spark):
    """An entry is one row of the shuffle by race, its runs a list, and the
    features read that shuffle once."""
    e = spark.createDataFrame([(f"R{k % 40}", "1", f"{k % 9:02d}", None if k % 7 == 0 else str(k), f"H{k}") for k in range(200)],
                              "race_id string, wakuban string, umaban string, ketto_num string, bamei string")
    h = spark.sql("select 'H' || (id % 150) horse_name, date'2024-01-01' + int(id / 150) race_date, id % 9 + 1 rank, id % 5 popularity, 1600.0 distance, 'T' surface, 95.0 time_sec from range(1500)")
    t = spark.sql("select 'R' || id race_id, date'2024-06-01' target_date, 1600L target_distance, 'T' target_surface from range(40)")
    f = form.form_features(form.form_runs(e, h), t)
    got = f.collect()
    assert len(got) == 200 and {r.starts for r in got if r.ketto_num is None} == {0}
    assert {(r.starts, r.surface_match_rate) for r in got if r.ketto_num and int(r.bamei[1:]) < 150} == {(5, 1.0)}
    plan = f._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("newest-runs") <= 1 and plan.count("Repartition") == 1
    assert plan.index("explode(newest") < plan.index("Repartition")   # the list is opened above the shuffle


def test_what_the_entries_were_shuffled_in_goes_before_their_runs_are_joined(spark, local_dir):
    from furlong.plans import registry
    from tests.test_io import feed_tables, shuffle_files
    feed_tables(spark, local_dir)
    li = spark.read.parquet(f"{local_dir}/lineitem.parquet").withColumns({"l_extendedprice": F.col("l_orderkey") * 100.0, "l_tax": F.lit(0.02)})
    li.write.parquet(f"{local_dir}/whole/lineitem.parquet")
    spark.read.parquet(f"{local_dir}/orders.parquet").write.parquet(f"{local_dir}/whole/orders.parquet")
    before = shuffle_files(spark)
    _, _, e, _ = registry._analysis_parts(spark, f"{local_dir}/whole")
    assert shuffle_files(spark) <= before
    assert e.count() > 0 and e.columns == form.ENTRY_COLS and "Exchange" not in e._jdf.queryExecution().executedPlan().toString()
