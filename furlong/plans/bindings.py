"""Bindings of the provided TPC-H-like tables to the race data model.

The operators never see TPC-H names. These builders derive race-shaped inputs
from ``orders`` and ``lineitem`` (so work grows with the tables), and each
has a DuckDB SQL twin with the same expressions for the independent oracle.

Mapping (one order = one race, one line = one runner):

- date = o_orderdate; venue by o_custkey % 11 (1..10 the ten venues, 0 an
  unknown venue); meeting text from o_custkey and o_orderkey, with variants
  that lack leading digits or carry three of them; race number
  o_orderkey % 12 + 1; race name = order priority, blank for status P
- distance 1000 + 200 * (o_custkey % 13); surface by l_returnflag
  (R turf, A dirt, N steeplechase - an invalid surface for the index)
- horse number = l_linenumber, horse id = l_partkey, name 'H' || l_partkey;
  results have extra runners that only the fallback source can serve
- history: rank = l_linenumber, popularity = l_quantity % 18 + 1,
  time = l_extendedprice / 1000 + 60, weight = 50 + 100 * l_tax
"""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.functions.codes import VENUE_CODES

UNKNOWN_VENUE = "大井"
SURFACE_BY_FLAG = {"R": "芝", "A": "ダート", "N": "障害"}
TRACK_BY_FLAG = {"R": "10", "A": "23", "N": "29"}
CONDITION_BY_STATUS = {"O": "良", "F": "稍重"}  # status P -> NULL category


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read a provided table, as it is stored."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- Spark side

def _venue(k: str) -> Column:
    return F.expr(_sql_venue(k))


def _case_str(c: str, mapping: dict[str, str]) -> Column:
    return F.expr(_sql_case(c, mapping))


def _kaisai(ck: Column, ok: Column, venue: Column) -> Column:
    nichi = (ok % 8 + 1).cast("string")
    kai = (ck % 5 + 1)
    lead = (F.when(ck % 7 == 0, F.lit(""))
            .when(ck % 13 == 0, (kai * 101).cast("string"))
            .when(ck % 17 == 0, (kai * 10).cast("string"))
            .otherwise(kai.cast("string")))
    return F.concat(lead, venue, nichi)


# Columns of lineitem and orders that each binding reads.
NEEDS: dict[str, tuple[list[str], list[str]]] = {
    "results": (["l_partkey", "l_linenumber", "l_returnflag"],
                ["o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"]),
    "history": (["l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax", "l_returnflag"],
                ["o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"]),
    "raw_se": (["l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"], ["o_custkey", "o_orderdate"]),
    "raw_ra": (["l_suppkey", "l_shipdate", "l_returnflag"], ["o_custkey", "o_orderdate", "o_orderpriority"]),
}
_BASE: ContextVar[tuple[str, DataFrame] | None] = ContextVar("race_base", default=None)


def _needed(names: list[str]) -> tuple[list[str], list[str]]:
    return tuple(list(dict.fromkeys(c for n in names for c in NEEDS[n][k])) for k in (0, 1))


def _with_race_text(j: DataFrame) -> DataFrame:
    # venue first, as a column: the meeting text refers to it four times
    j = j.select("*", _venue("o_custkey % 11").alias("venue"))
    return j.select("*", _kaisai(F.col("o_custkey"), F.col("o_orderkey"), F.col("venue")).alias("kaisai"))


@contextmanager
def shared_base(spark: SparkSession, sf_dir: str, names: list[str]):
    """Within this block the bindings ``names`` of ``sf_dir`` are derived from
    one ``lineitem JOIN orders`` of the columns they need, written once under
    the shared checkpoint folder (instead of one join per binding). A single
    binding is left to its own join."""
    from furlong.session import materialize
    if len(names) < 2:
        yield None
        return
    line_cols, order_cols = _needed(names)
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", *line_cols)
    od = table(spark, sf_dir, "orders").select("o_orderkey", *order_cols)
    # the synthetic race attributes are materialised with the join, so the
    # predicates Catalyst pushes down later meet plain columns, as on real data
    token = _BASE.set((sf_dir, materialize(_with_race_text(li.join(od, li.l_orderkey == od.o_orderkey)), "race-base")))
    try:
        yield _BASE.get()[1]
    finally:
        _BASE.reset(token)


def _joined(spark: SparkSession, sf_dir: str, binding: str) -> DataFrame:
    line_cols, order_cols = NEEDS[binding]
    base = _BASE.get()
    if base is not None and base[0] == sf_dir and {*line_cols, *order_cols} <= set(base[1].columns):
        return base[1].select("l_orderkey", *line_cols, "o_orderkey", *order_cols, "venue", "kaisai")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", *line_cols)
    od = table(spark, sf_dir, "orders").select("o_orderkey", *order_cols)
    return li.join(od, li.l_orderkey == od.o_orderkey)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_race_results``: one row per runner of every race. Each line 1 or 2
    adds a runner (horse number + 10, horse id + ten million) that no raw
    record has, so that only the fallback source can serve it."""
    j = _joined(spark, sf_dir, "results")
    ck, ok, ln = F.col("o_custkey"), F.col("o_orderkey"), F.col("l_linenumber")
    if "venue" not in j.columns:
        j = _with_race_text(j)
    extra = F.explode(F.when(ln <= 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    j = j.select("*", extra.alias("extra"))
    horse = F.col("l_partkey") + F.col("extra") * 10_000_000
    return j.select(
        F.col("o_orderdate").cast("date").alias("date"),
        "venue", "kaisai",
        (ok % 12 + 1).alias("race_num"),
        F.when(F.col("o_orderstatus") == "P", F.lit(" ")).otherwise(F.col("o_orderpriority")).alias("race_name"),
        (F.lit(1000) + F.lit(200) * (ck % 13)).alias("distance"),
        _case_str("l_returnflag", SURFACE_BY_FLAG).alias("surface"),
        (ln.cast("long") + F.col("extra") * 10).alias("horse_num"),
        horse.alias("horse_id"),
        F.concat(F.lit("H"), horse.cast("string")).alias("horse_name"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``analysis_view``: past runs of every horse. Some times and weights are
    NaN, some weights NULL, and the age is the same everywhere."""
    j = _joined(spark, sf_dir, "history")
    ck, ok = F.col("o_custkey"), F.col("o_orderkey")
    nan = F.lit(float("nan"))
    return j.select(
        F.col("l_partkey").cast("string").alias("ketto_num"),
        F.concat(F.lit("H"), F.col("l_partkey").cast("string")).alias("horse_name"),
        _case_str("l_returnflag", SURFACE_BY_FLAG).alias("surface"),
        (F.lit(1000) + F.lit(200) * (ck % 13)).cast("double").alias("distance"),
        F.when(ok % 97 == 0, nan).otherwise(F.col("l_extendedprice") / 1000 + 60).alias("time_sec"),
        F.col("o_orderdate").cast("date").alias("race_date"),
        F.col("l_linenumber").cast("long").alias("rank"),
        (F.col("l_quantity").cast("long") % 18 + 1).alias("popularity"),
        F.when(ok % 89 == 0, nan).when(ok % 83 != 0, F.lit(50.0) + F.lit(100.0) * F.col("l_tax")).alias("weight"),
        F.lit(4).alias("age"),
        (F.col("venue") if "venue" in j.columns else _venue("o_custkey % 11")).alias("venue"),
        F.col("o_orderpriority").alias("class_name"),
        _case_str("o_orderstatus", CONDITION_BY_STATUS).alias("track_condition"),
    )


def _raw_key_cols() -> list[Column]:
    d, ck, ok = F.col("o_orderdate"), F.col("o_custkey"), F.col("o_orderkey")
    return [
        F.year(d).cast("string").alias("Year"),
        (F.month(d) * 100 + F.dayofmonth(d)).cast("string").alias("MonthDay"),
        (ck % 11).cast("string").alias("JyoCD"),
        (ck % 5 + 1).cast("string").alias("Kaiji"),
        (ok % 8 + 1).cast("string").alias("Nichiji"),
        (ok % 12 + 1).cast("string").alias("RaceNum"),
    ]


def _fetched_at() -> Column:
    s = F.col("l_suppkey")
    return (F.when(s % 50 == 0, F.lit(""))
            .when(s % 50 == 1, F.lit("not-a-time"))
            .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss")))


def raw_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw runner records (unpadded key parts, repeated fetches)."""
    j = _joined(spark, sf_dir, "raw_se")
    ln = F.col("l_linenumber")
    return j.select(
        F.lit("SE").alias("RecordSpec"), *_raw_key_cols(),
        F.concat(F.lit(" "), ln.cast("string")).alias("Umaban"),
        ((ln + 1) / 2).cast("long").cast("string").alias("Wakuban"),
        F.col("l_partkey").cast("string").alias("KettoNum"),
        F.concat(F.lit("H"), F.col("l_partkey").cast("string")).alias("Bamei"),
        _fetched_at().alias("fetched_at"),
    )


def raw_ra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw race records: one per runner line, so every race is fetched repeatedly."""
    j = _joined(spark, sf_dir, "raw_ra")
    return j.select(
        F.lit("RA").alias("RecordSpec"), *_raw_key_cols(),
        F.col("o_orderpriority").alias("Hondai"),
        _case_str("l_returnflag", TRACK_BY_FLAG).alias("TrackCD"),
        (F.lit(1000) + F.lit(200) * (F.col("o_custkey") % 13)).cast("string").alias("Kyori"),
        _fetched_at().alias("fetched_at"),
    )


def stage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load rows of every line; ``l_suppkey`` tells the two batches apart."""
    j = _joined(spark, sf_dir, "raw_se")
    ln, pk = F.col("l_linenumber"), F.col("l_partkey")
    keys = _raw_key_cols()
    # NULL and '' in one key part of one batch: the MERGE treats them as one key.
    keys[3] = (F.when(pk % 89 == 0, F.lit(None).cast("string"))
               .when(pk % 89 == 1, F.lit(""))
               .otherwise((F.col("o_custkey") % 5 + 1).cast("string")).alias("Kaiji"))
    return j.select(
        "l_suppkey", *keys,
        F.concat(F.lit(" "), ln.cast("string")).alias("Umaban"),
        ((ln + 1) / 2).cast("long").cast("string").alias("Wakuban"),
        F.col("l_partkey").cast("string").alias("KettoNum"),
        F.concat(F.lit("H"), pk.cast("string")).alias("Bamei"),
        _fetched_at().alias("fetched_at"),
    )


def stage_batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two load batches of runner records that share keys: every line is in
    the first or the second by supplier, and every fourth supplier's in both.
    The first lacks ``Wakuban`` (a stage column the target does not have yet)."""
    rows, s = stage_rows(spark, sf_dir), F.col("l_suppkey")
    first = rows.filter((s % 2 == 0) | (s % 4 == 1)).drop("l_suppkey", "Wakuban")
    return first, rows.filter(s % 2 == 1).drop("l_suppkey")


def text_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-width feed records (``raw_data``) built from orders and lines.

    One RA per order (every tenth cut at byte 650), and per line an SE (lines
    1-4), a JG (5), an HR header-only record (6) or an undefined type (7);
    status-P orders with key % 50 == 0 also emit a one-character record.
    """
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate",
                                              "o_orderpriority")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag",
                                                "l_linestatus", "l_quantity", "l_shipdate")
    def header(spec: Column, d: Column, ck: Column, ok: Column, made: Column) -> Column:
        return F.concat(spec, F.lit("7"), F.date_format(made, "yyyyMMdd"), F.date_format(d, "yyyy"),
                        F.date_format(d, "MMdd"), F.lpad((ck % 11).cast("string"), 2, "0"),
                        F.lpad((ck % 5 + 1).cast("string"), 2, "0"), F.lpad((ok % 8 + 1).cast("string"), 2, "0"),
                        F.lpad((ok % 12 + 1).cast("string"), 2, "0"))
    d, ck, ok = F.col("o_orderdate"), F.col("o_custkey"), F.col("o_orderkey")
    ra_full = F.concat(
        header(F.lit("RA"), d, ck, ok, d), F.lit("1"), F.lpad((ok % 1000).cast("string"), 4, "0"),
        F.rpad(F.col("o_orderpriority"), 60, " "), F.rpad(F.concat(F.lit("sub "), ck.cast("string")), 60, " "),
        F.rpad(F.lit(""), 60, " "), F.rpad(F.lit(""), 616 - 212, " "),
        F.lpad((ok % 30).cast("string"), 2, "1"), F.rpad(F.lit(""), 697 - 618, " "),
        F.lpad((F.lit(1000) + F.lit(200) * (ck % 13)).cast("string"), 4, "0"),
        F.concat(F.lit(" body "), F.col("o_orderstatus")))
    ra = od.select(F.when(ok % 10 == 0, F.substring(ra_full, 1, 650)).otherwise(ra_full).alias("raw_data"))
    short = od.filter((F.col("o_orderstatus") == "P") & (ok % 50 == 0)).select(F.lit("X").alias("raw_data"))
    j = li.join(od, li.l_orderkey == od.o_orderkey)
    ln, pk = F.col("l_linenumber"), F.col("l_partkey")
    sd = F.col("l_shipdate")
    se = F.concat(header(F.lit("SE"), d, ck, ok, sd), ((ln + 1) / 2).cast("long").cast("string"),
                  F.lpad(ln.cast("string"), 2, "0"), F.lpad(pk.cast("string"), 10, "0"),
                  F.rpad(F.concat(F.lit("H"), pk.cast("string")), 36, " "),
                  F.concat(F.col("l_returnflag"), F.col("l_linestatus"), F.lit(" q"),
                           F.col("l_quantity").cast("long").cast("string")))
    jg = F.concat(header(F.lit("JG"), d, ck, ok, sd), F.lpad(pk.cast("string"), 10, "0"),
                  F.rpad(F.concat(F.lit("H"), pk.cast("string")), 36, " "))
    hr = F.concat(header(F.lit("HR"), d, ck, ok, sd), F.lit(" pay "), F.col("l_returnflag"))
    zz = F.concat(F.lit("ZZ"), F.lit(" undefined "), pk.cast("string"))
    lines = j.select(F.when(ln <= 4, se).when(ln == 5, jg).when(ln == 6, hr).otherwise(zz).alias("raw_data"))
    return ra.unionByName(short).unionByName(lines)


def docs_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free text as feed records: a third get an SE prefix and a third an RA
    prefix, so the cp932 encoding lane is exercised on real prose."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    k = F.col("doc_id") % 3
    return d.select(F.when(k == 0, F.concat(F.lit("SE"), F.col("text")))
                    .when(k == 1, F.concat(F.lit("RA"), F.col("text")))
                    .otherwise(F.col("text")).alias("raw_data"))


# --------------------------------------------------------------- DuckDB side

def _sql_case(expr: str, mapping: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {k!r} THEN '{v}'" if isinstance(k, str) else f"WHEN {k} THEN '{v}'"
                     for k, v in mapping.items())
    return f"CASE {expr} {whens} ELSE {default} END"


def _sql_venue(expr: str) -> str:
    m = {0: UNKNOWN_VENUE, **{int(code): name for name, code in VENUE_CODES.items()}}
    return _sql_case(expr, m)


def _sql_kaisai(venue: str) -> str:
    nichi = "CAST(o_orderkey % 8 + 1 AS VARCHAR)"
    kai = "(o_custkey % 5 + 1)"
    return (f"CASE WHEN o_custkey % 7 = 0 THEN {venue} || {nichi} "
            f"WHEN o_custkey % 13 = 0 THEN CAST({kai} * 101 AS VARCHAR) || {venue} || {nichi} "
            f"WHEN o_custkey % 17 = 0 THEN CAST({kai} * 10 AS VARCHAR) || {venue} || {nichi} "
            f"ELSE CAST({kai} AS VARCHAR) || {venue} || {nichi} END")


SQL_RESULTS = f"""
SELECT CAST(o_orderdate AS DATE) AS date,
       {_sql_venue('o_custkey % 11')} AS venue,
       {_sql_kaisai(_sql_venue('o_custkey % 11'))} AS kaisai,
       o_orderkey % 12 + 1 AS race_num,
       CASE WHEN o_orderstatus = 'P' THEN ' ' ELSE o_orderpriority END AS race_name,
       1000 + 200 * (o_custkey % 13) AS distance,
       {_sql_case('l_returnflag', SURFACE_BY_FLAG)} AS surface,
       CAST(l_linenumber AS BIGINT) + 10 * x.extra AS horse_num,
       l_partkey + 10000000 * x.extra AS horse_id,
       'H' || CAST(l_partkey + 10000000 * x.extra AS VARCHAR) AS horse_name
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN (VALUES (0), (1)) x(extra) ON x.extra = 0 OR l_linenumber <= 2
"""

SQL_HISTORY = f"""
SELECT CAST(l_partkey AS VARCHAR) AS ketto_num,
       'H' || CAST(l_partkey AS VARCHAR) AS horse_name,
       {_sql_case('l_returnflag', SURFACE_BY_FLAG)} AS surface,
       CAST(1000 + 200 * (o_custkey % 13) AS DOUBLE) AS distance,
       CASE WHEN o_orderkey % 97 = 0 THEN 'NaN'::DOUBLE ELSE l_extendedprice / 1000 + 60 END AS time_sec,
       CAST(o_orderdate AS DATE) AS race_date,
       CAST(l_linenumber AS BIGINT) AS rank,
       CAST(l_quantity AS BIGINT) % 18 + 1 AS popularity,
       CASE WHEN o_orderkey % 89 = 0 THEN 'NaN'::DOUBLE WHEN o_orderkey % 83 != 0 THEN 50.0 + 100.0 * l_tax END AS weight,
       4 AS age,
       {_sql_venue('o_custkey % 11')} AS venue,
       o_orderpriority AS class_name,
       {_sql_case('o_orderstatus', CONDITION_BY_STATUS)} AS track_condition
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

_SQL_KEYS = """
       CAST(year(o_orderdate) AS VARCHAR) AS Year,
       CAST(month(o_orderdate) * 100 + day(o_orderdate) AS VARCHAR) AS MonthDay,
       CAST(o_custkey % 11 AS VARCHAR) AS JyoCD,
       CAST(o_custkey % 5 + 1 AS VARCHAR) AS Kaiji,
       CAST(o_orderkey % 8 + 1 AS VARCHAR) AS Nichiji,
       CAST(o_orderkey % 12 + 1 AS VARCHAR) AS RaceNum"""

_SQL_FETCHED = """CASE WHEN l_suppkey % 50 = 0 THEN '' WHEN l_suppkey % 50 = 1 THEN 'not-a-time'
            ELSE strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') END"""

SQL_RAW_SE = f"""
SELECT 'SE' AS RecordSpec, {_SQL_KEYS},
       ' ' || CAST(l_linenumber AS VARCHAR) AS Umaban,
       CAST((l_linenumber + 1) // 2 AS VARCHAR) AS Wakuban,
       CAST(l_partkey AS VARCHAR) AS KettoNum,
       'H' || CAST(l_partkey AS VARCHAR) AS Bamei,
       {_SQL_FETCHED} AS fetched_at
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

SQL_RAW_RA = f"""
SELECT 'RA' AS RecordSpec, {_SQL_KEYS},
       o_orderpriority AS Hondai,
       {_sql_case('l_returnflag', TRACK_BY_FLAG)} AS TrackCD,
       CAST(1000 + 200 * (o_custkey % 13) AS VARCHAR) AS Kyori,
       {_SQL_FETCHED} AS fetched_at
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""


STAGE_FIRST, STAGE_SECOND = "l_suppkey % 2 = 0 OR l_suppkey % 4 = 1", "l_suppkey % 2 = 1"


def sql_stage(where: str, with_wakuban: bool) -> str:
    waku = "CAST((l_linenumber + 1) // 2 AS VARCHAR) AS Wakuban," if with_wakuban else ""
    keys = _SQL_KEYS.replace(
        "CAST(o_custkey % 5 + 1 AS VARCHAR) AS Kaiji",
        "CASE WHEN l_partkey % 89 = 0 THEN NULL WHEN l_partkey % 89 = 1 THEN '' "
        "ELSE CAST(o_custkey % 5 + 1 AS VARCHAR) END AS Kaiji")
    return f"""
SELECT {keys},
       ' ' || CAST(l_linenumber AS VARCHAR) AS Umaban, {waku}
       CAST(l_partkey AS VARCHAR) AS KettoNum,
       'H' || CAST(l_partkey AS VARCHAR) AS Bamei,
       {_SQL_FETCHED} AS fetched_at
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE {where}
"""


def _sql_header(spec: str, made: str) -> str:
    return (f"'{spec}' || '7' || strftime({made}, '%Y%m%d') || strftime(o_orderdate, '%Y') || "
            "strftime(o_orderdate, '%m%d') || lpad(CAST(o_custkey % 11 AS VARCHAR), 2, '0') || "
            "lpad(CAST(o_custkey % 5 + 1 AS VARCHAR), 2, '0') || lpad(CAST(o_orderkey % 8 + 1 AS VARCHAR), 2, '0') || "
            "lpad(CAST(o_orderkey % 12 + 1 AS VARCHAR), 2, '0')")


_SQL_RA_FULL = (
    f"{_sql_header('RA', 'o_orderdate')} || '1' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 4, '0') || "
    "rpad(o_orderpriority, 60, ' ') || rpad('sub ' || CAST(o_custkey AS VARCHAR), 60, ' ') || "
    f"rpad('', 60, ' ') || rpad('', {616 - 212}, ' ') || lpad(CAST(o_orderkey % 30 AS VARCHAR), 2, '1') || "
    f"rpad('', {697 - 618}, ' ') || lpad(CAST(1000 + 200 * (o_custkey % 13) AS VARCHAR), 4, '0') || "
    "' body ' || o_orderstatus")

SQL_TEXT = f"""
SELECT CASE WHEN o_orderkey % 10 = 0 THEN substr({_SQL_RA_FULL}, 1, 650) ELSE {_SQL_RA_FULL} END AS raw_data
FROM orders
UNION ALL
SELECT 'X' AS raw_data FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 50 = 0
UNION ALL
SELECT CASE
  WHEN l_linenumber <= 4 THEN {_sql_header('SE', 'l_shipdate')} || CAST((l_linenumber + 1) // 2 AS VARCHAR)
       || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || lpad(CAST(l_partkey AS VARCHAR), 10, '0')
       || rpad('H' || CAST(l_partkey AS VARCHAR), 36, ' ')
       || l_returnflag || l_linestatus || ' q' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)
  WHEN l_linenumber = 5 THEN {_sql_header('JG', 'l_shipdate')} || lpad(CAST(l_partkey AS VARCHAR), 10, '0')
       || rpad('H' || CAST(l_partkey AS VARCHAR), 36, ' ')
  WHEN l_linenumber = 6 THEN {_sql_header('HR', 'l_shipdate')} || ' pay ' || l_returnflag
  ELSE 'ZZ' || ' undefined ' || CAST(l_partkey AS VARCHAR) END AS raw_data
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

SQL_DOCS = """
SELECT CASE doc_id % 3 WHEN 0 THEN 'SE' || text WHEN 1 THEN 'RA' || text ELSE text END AS raw_data
FROM documents
"""


def derived_master(hist: DataFrame) -> DataFrame:
    """A speed-index master derived from the history (twin of the oracle's):
    some keys blank (forces the name lookup), some indexes NULL (dropped)."""
    k = F.col("ketto_num").cast("long")
    g = hist.groupBy("ketto_num", "horse_name", F.substring("surface", 1, 1).alias("surface")).agg(
        F.sum("rank").alias("_s"), F.count(F.lit(1)).alias("run_count"))
    return g.select(
        F.when(k % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("ketto_num")).alias("horse_key"),
        "horse_name", "surface",
        F.when(k % 7 == 0, F.lit(None).cast("double"))
        .otherwise(F.lit(80.0) + (F.col("_s") % 41).cast("double")).alias("speed_index"),
        "run_count")


def bad_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Malformed landing lines (cut-off JSON), one per 500 orders."""
    od = table(spark, sf_dir, "orders").select("o_orderkey")
    return od.filter(F.col("o_orderkey") % 500 == 0).select(
        F.concat(F.lit('{"raw_data": "RA'), F.col("o_orderkey").cast("string")).alias("value"))


def no_raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landing lines without ``raw_data`` (pass through a backfill unchanged)."""
    od = table(spark, sf_dir, "orders").select("o_orderkey")
    return od.filter(F.col("o_orderkey") % 100 == 0).select(
        F.concat(F.lit('{"fetched_at": "x", "note": '), F.col("o_orderkey").cast("string"), F.lit("}"))
        .alias("value"))


SQL_BAD_LINES = "SELECT '{\"raw_data\": \"RA' || CAST(o_orderkey AS VARCHAR) AS line FROM orders WHERE o_orderkey % 500 = 0"
SQL_NO_RAW_LINES = ("SELECT '{\"fetched_at\": \"x\", \"note\": ' || CAST(o_orderkey AS VARCHAR) || '}' AS line "
                    "FROM orders WHERE o_orderkey % 100 = 0")
