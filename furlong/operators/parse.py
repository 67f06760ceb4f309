"""Fixed-width feed records -> typed landing rows (P1-P10), as a Spark job.

Layouts are cp932 *byte* offsets, so slicing needs the cp932 encoding of
each record. In a record of printable ASCII alone the cp932 bytes are its
characters: it is sliced and trimmed by built-in columns, of which Catalyst
evaluates only those that are read. Spark has no cp932 codec without legacy
flags, so for all other records one Arrow ``pandas_udf`` encodes a whole batch
at once, slices it field by field and decodes each field at once, returning
every field in one list. Everything else (lanes, metadata, tags, census,
profiles) is built-in column work.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Record layouts, (field, byte offset, byte length) in cp932.
HEADER = [
    ("RecordSpec", 0, 2), ("DataKubun", 2, 1), ("MakeDate", 3, 8), ("Year", 11, 4), ("MonthDay", 15, 4),
    ("JyoCD", 19, 2), ("Kaiji", 21, 2), ("Nichiji", 23, 2), ("RaceNum", 25, 2),
]
RA_FIELDS = [("YoubiCD", 27, 1), ("TokuNum", 28, 4), ("Hondai", 32, 60), ("Fukudai", 92, 60),
             ("Kakko", 152, 60), ("TrackCD", 616, 2), ("Kyori", 697, 4)]
SE_FIELDS = [("Wakuban", 27, 1), ("Umaban", 28, 2), ("KettoNum", 30, 10), ("Bamei", 40, 36)]
JG_FIELDS = [("HorseID", 27, 10), ("HorseName", 37, 36)]
HEADER_ONLY_TYPES = ["HR", "H1", "H6", "WF", "O1", "O2", "O3", "O4", "O5", "O6"]

SPECS: dict[str, list[tuple[str, int, int]]] = {
    "JG": HEADER + JG_FIELDS, "RA": HEADER + RA_FIELDS, "SE": HEADER + SE_FIELDS,
    **{t: HEADER for t in HEADER_ONLY_TYPES},
}

FIELD_NAMES: list[str] = []
for _fields in (HEADER, RA_FIELDS, SE_FIELDS, JG_FIELDS):
    FIELD_NAMES += [f[0] for f in _fields if f[0] not in FIELD_NAMES]

ERROR_TOO_SHORT = "Too short"
ERROR_ENCODING = "Encoding failed"

PARSED_SCHEMA = T.StructType(
    [T.StructField("record_type", T.StringType()), T.StructField("_parsed", T.BooleanType()),
     T.StructField("error", T.StringType())]
    + [T.StructField(n, T.StringType()) for n in FIELD_NAMES]
    + [T.StructField("raw_body", T.StringType())])

LANDING_COLUMNS = [f.name for f in PARSED_SCHEMA.fields] + ["fetched_at", "raw_data"]
LANDING_SCHEMA = T.StructType(list(PARSED_SCHEMA.fields) + [T.StructField("fetched_at", T.StringType()),
                                                            T.StructField("raw_data", T.StringType())])


def _encoded(values: list[str]) -> list[bytes | None]:
    """cp932 of each value, None where it has none: one encoding of the whole
    batch, cut at a separator that no value holds. Only a batch with a value
    that can't be encoded is encoded value by value."""
    if not any("\x00" in v for v in values):
        try:
            return "\x00".join(values).encode("cp932").split(b"\x00") if values else []
        except UnicodeEncodeError:
            pass
    out: list[bytes | None] = []
    for v in values:
        try:
            out.append(v.encode("cp932"))
        except UnicodeEncodeError:
            out.append(None)
    return out


def _texts(pieces: list[bytes]) -> list[str]:
    """Stripped text of each piece, broken bytes replaced. No cp932 sequence
    reaches past a zero byte, so pieces without one are decoded together."""
    if any(b"\x00" in p for p in pieces):
        return [p.decode("cp932", errors="replace").strip() for p in pieces]
    return [t.strip() for t in b"\x00".join(pieces).decode("cp932", errors="replace").split("\x00")] if pieces else []


_STRING_FIELDS = [f.name for f in PARSED_SCHEMA.fields if f.name != "_parsed"]


def parse_batch(raw: list[str | None]) -> dict[str, np.ndarray]:
    """Landing fields of a batch of records, as columns: records are grouped by
    type, and each field of a layout is one slice of all its records."""
    n = len(raw)
    out = {name: np.full(n, None, dtype=object) for name in [f.name for f in PARSED_SCHEMA.fields]}
    spec = np.array([v[:2] if v is not None and len(v) >= 2 else None for v in raw], dtype=object)
    short = np.array([s is None for s in spec], dtype=bool)
    out["error"][short] = ERROR_TOO_SHORT
    out["record_type"][~short] = spec[~short]
    known = np.array([s in SPECS for s in spec], dtype=bool)
    out["_parsed"][~short & ~known] = False
    for name in {s for s in spec[known]}:
        at = np.flatnonzero(spec == name)
        body = _encoded([raw[i] for i in at])
        bad = np.array([b is None for b in body], dtype=bool)
        out["error"][at[bad]] = ERROR_ENCODING
        at, body = at[~bad], [b for b in body if b is not None]
        out["_parsed"][at] = True
        for field, start, length in SPECS[name]:
            out[field][at] = _texts([b[start:start + length] for b in body])
        end = max(start + length for _, start, length in SPECS[name])
        longer = np.array([len(b) > end for b in body], dtype=bool)
        out["raw_body"][at[longer]] = _texts([b[end:] for b in body if len(b) > end])
    return out


def parse_record(raw: str | None) -> dict:
    """One record -> dict of present keys."""
    return {k: v[0] for k, v in parse_batch([raw]).items() if v[0] is not None}


@F.pandas_udf(T.ArrayType(T.StringType()))
def _parse_udf(raw: pd.Series) -> pd.Series:
    """Text fields (in the order of ``_STRING_FIELDS``) of the records that are
    sent, as a list each: one column comes back, and a NULL gives a NULL."""
    at = np.flatnonzero(raw.notna().to_numpy())
    out = np.full(len(raw), None, dtype=object)
    if len(at):
        fields = parse_batch(raw.iloc[at].tolist())
        for i, values in zip(at, zip(*(fields[n] for n in _STRING_FIELDS), strict=True), strict=True):
            out[i] = list(values)
    return pd.Series(out, dtype=object)


def _wide(field: str) -> Column:
    """A field of a record that was cut in Python."""
    return F.get("_p", F.lit(_STRING_FIELDS.index(field)))


# Record types of equal layout, by the number of the layout.
_LAYOUTS: dict[int, list[str]] = {}
for _type, _spec in SPECS.items():
    _k = next((k for k, types in _LAYOUTS.items() if SPECS[types[0]] == _spec), len(_LAYOUTS) + 1)
    _LAYOUTS.setdefault(_k, []).append(_type)


def _sliced(field: str) -> Column:
    """A field of a printable ASCII record (bytes ``_b``, layout ``_k``): a
    slice without the blanks around it, which are the only whitespace there."""
    places: dict[tuple[int, int], list[int]] = {}
    for k, types in _LAYOUTS.items():
        spec = SPECS[types[0]]
        if field == "raw_body":
            places.setdefault((max(start + length for _, start, length in spec), 1 << 30), []).append(k)
        for name, start, length in spec:
            if name == field:
                places.setdefault((start, length), []).append(k)
    out = None
    for (start, length), ks in places.items():
        here = F.col("_k") > 0 if len(ks) == len(_LAYOUTS) else reduce(or_, [F.col("_k") == k for k in ks])
        if field == "raw_body":
            here = here & (F.octet_length("_b") > start)
        text = F.trim(F.substring("_b", start + 1, length).cast("string"))
        out = F.when(here, text) if out is None else out.when(here, text)
    return out


def ingest_time() -> Column:
    """ISO local time of the batch, evaluated once per query."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def parse_records(df: DataFrame, raw_col: str = "raw_data", fetched_at: Column | str | None = None,
                  keep: list[str] = ()) -> DataFrame:
    """Parse a column of fixed-width records into landing rows.

    Lanes: NULL / shorter than 2 -> ``error='Too short'`` and no type;
    undefined type -> ``_parsed=false``, nothing sliced; not cp932-encodable
    -> ``error='Encoding failed'``; otherwise every field of the layout,
    sliced by byte range (short records give what is left, possibly ''),
    decoded with U+FFFD for broken bytes and stripped, plus ``raw_body``.
    Fields absent from a lane are NULL (omitted when written as JSON).
    ``keep`` names input columns carried through unchanged.
    """
    fa = ingest_time() if fetched_at is None else (F.lit(fetched_at) if isinstance(fetched_at, str) else fetched_at)
    raw, wide, k = F.col("_raw"), F.col("_wide"), F.col("_k")
    p = df.select(*keep, F.col(raw_col).alias("_raw"), fa.alias("_fa"))
    spec = F.when(F.length(raw) >= 2, F.substring(raw, 1, 2))
    layout = reduce(lambda e, item: e.when(spec.isin(item[1]), F.lit(item[0])), _LAYOUTS.items(), F.when(spec.isNull(), F.lit(-1)))
    p = p.select("*", layout.otherwise(F.lit(0)).alias("_k"), raw.rlike("[^ -~]").alias("_wide"))
    # a record that no layout cuts needs no bytes, and only wide ones go to Python
    p = p.select("*", F.when(~wide & (k > 0), raw).cast("binary").alias("_b"), _parse_udf(F.when(wide & (k > 0), raw)).alias("_p"))
    is_wide = F.coalesce(wide, F.lit(False)) & (k > 0)
    own = {"record_type": spec,
           "_parsed": F.when(k == 0, F.lit(False)).when(is_wide, F.when(_wide("error").isNull(), F.lit(True))).when(k > 0, F.lit(True)),
           "error": F.when(k < 0, F.lit(ERROR_TOO_SHORT)).when(is_wide, _wide("error"))}
    cols = [own[n] if n in own else F.when(is_wide, _wide(n)).otherwise(_sliced(n)) for n in PARSED_SCHEMA.names]
    return p.select(*keep, *[c.alias(n) for n, c in zip(PARSED_SCHEMA.names, cols, strict=True)], F.col("_fa").alias("fetched_at"), raw.alias("raw_data"))


def type_tag(record_type: Column | str = "record_type", raw_data: Column | str = "raw_data",
             corrupt: Column | str | None = None) -> Column:
    """Record type with fallback (P8): type, else first two characters of the
    raw text, else 'UNKNOWN'; an unparsable JSON line is 'ERROR'."""
    rt = F.col(record_type) if isinstance(record_type, str) else record_type
    raw = F.col(raw_data) if isinstance(raw_data, str) else raw_data
    tag = F.coalesce(F.nullif(rt, F.lit("")), F.nullif(F.substring(raw, 1, 2), F.lit("")), F.lit("UNKNOWN"))
    if corrupt is not None:
        c = F.col(corrupt) if isinstance(corrupt, str) else corrupt
        tag = F.when(c.isNotNull(), F.lit("ERROR")).otherwise(tag)
    return tag


def lane(df: DataFrame) -> Column:
    """Which parse lane a landing row took."""
    return (F.when(F.col("error") == ERROR_TOO_SHORT, F.lit("too_short"))
            .when(F.col("error") == ERROR_ENCODING, F.lit("encoding_failed"))
            .when(F.col("_parsed") == F.lit(False), F.lit("undefined"))
            .otherwise(F.lit("parsed")))


def _byte_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records by (type, offset, byte), counted per batch and type."""
    for batch in batches:
        types = batch.column("record_type").to_pylist()
        groups: dict[str | None, list[bytes]] = {}
        for t, v in zip(types, batch.column("raw").to_pylist(), strict=True):
            if v is not None:
                groups.setdefault(t, []).append(v.encode("cp932", errors="replace"))
        cols: list[list] = [[], [], [], []]
        for t, records in groups.items():
            size = np.array([len(b) for b in records])
            begin = np.cumsum(size) - size
            offset = np.arange(size.sum()) - np.repeat(begin, size)
            key, n = np.unique(offset * 256 + np.frombuffer(b"".join(records), np.uint8), return_counts=True)
            for col, v in zip(cols, ([t] * len(key), (key // 256).tolist(), (key % 256).tolist(), n.tolist()), strict=True):
                col += v
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *[pa.array(c, pa.int64()) for c in cols[1:]]],
                                         names=["record_type", "offset", "byte", "n"])


def layout_profile(df: DataFrame, lo: int = 0, hi: int | None = None, raw_col: str = "raw_data",
                   by: str | None = "record_type") -> DataFrame:
    """Byte-layout profile over *all* records (P9): for each offset in
    [lo, hi), or of the whole record, how many records reach it, how many
    distinct byte values it takes and the smallest / largest byte (hex). Each
    batch sends counts by type, offset and byte, not its bytes."""
    src = df.select((F.col(by) if by else F.lit(None)).cast("string").alias("record_type"), F.col(raw_col).alias("raw"))
    x = src.mapInArrow(_byte_counts, "record_type string, offset long, byte long, n long").filter(F.col("offset") >= lo)
    if hi is not None:
        x = x.filter(F.col("offset") < hi)
    keys = (["record_type"] if by else []) + ["offset"]
    two = lambda c: F.lpad(F.hex(c), 2, "0")
    return (x.groupBy(*keys).agg(F.sum("n").alias("n_records"), F.count_distinct("byte").alias("n_distinct"),
                                 F.min("byte").alias("_lo"), F.max("byte").alias("_hi"))
            .select(*[F.col(k).cast("int") if k == "offset" else F.col(k) for k in keys], "n_records", "n_distinct",
                    two("_lo").alias("min_hex"), two("_hi").alias("max_hex")))


#: First and last byte of each class; all other bytes are a class of their own.
BYTE_CLASSES = {"blank": [(0x20, 0x20)], "digit": [(0x30, 0x39)], "upper": [(0x41, 0x5A)], "lower": [(0x61, 0x7A)], "wide": [(0x80, 0xFF)]}


def layout_cuts(df: DataFrame, raw_col: str = "raw_data", by: str = "record_type",
                least_drop: float = 0.5, least_change: float = 0.5) -> DataFrame:
    """Where the bytes of *all* records say that a field begins.

    For each type and offset: the entropy (bits) of the byte there, and the
    change of the byte classes from the offset before (half the sum of the
    differences of their shares). A fixed-width number grows more random from
    its first digit to its last, so a field begins where the entropy falls by
    ``least_drop`` bits, and where the classes change by ``least_change``.
    Offset 0 always begins a field. Columns: the type, ``offset``,
    ``n_records``, ``entropy``, ``change``, ``cut``.
    """
    src = df.select(F.col(by).cast("string").alias("record_type"), F.col(raw_col).alias("raw"))
    counts = (src.mapInArrow(_byte_counts, "record_type string, offset long, byte long, n long")
              .groupBy("record_type", "offset", "byte").agg(F.sum("n").alias("n")))
    n, b = F.col("n"), F.col("byte")
    of = {k: F.lit(False) for k in BYTE_CLASSES}
    for k, ranges in BYTE_CLASSES.items():
        for lo, hi in ranges:
            of[k] = of[k] | b.between(lo, hi)
    total = F.sum(n)
    at = counts.groupBy("record_type", "offset").agg(
        total.alias("n_records"), (F.log2(total.cast("double")) - F.sum(n * F.log2(n.cast("double"))) / total).alias("entropy"),
        *[(F.coalesce(F.sum(F.when(c, n)), F.lit(0)) / total).alias(k) for k, c in of.items()])
    at = at.withColumn("other", F.lit(1.0) - sum((F.col(k) for k in of), F.lit(0.0)))
    before = Window.partitionBy("record_type").orderBy("offset")   # at most a record's length of rows
    change = sum((F.abs(F.col(k) - F.lag(k).over(before)) for k in [*of, "other"]), F.lit(0.0)) / 2
    drop = F.lag("entropy").over(before) - F.col("entropy")
    at = at.withColumns({"change": F.coalesce(change, F.lit(0.0)), "drop": drop})
    cut = (F.col("offset") == 0) | F.coalesce(F.col("drop") >= least_drop, F.lit(False)) | (F.col("change") >= least_change)
    return at.select(F.col("record_type").alias(by), F.col("offset").cast("int").alias("offset"), "n_records", "entropy", "change", cut.alias("cut"))


def layout_ranges(landing: DataFrame, ranges: dict[str, list[tuple[int, int]]], n: int = 5,
                  order: list[str] = ("raw_data",)) -> DataFrame:
    """Byte ranges [lo, hi) of the first ``n`` records of each type, as hex and
    decoded from cp932 (P9): record_type, nth, lo, hi, hex, text. A range that
    begins after the record's end has neither."""
    w = Window.partitionBy("record_type").orderBy(*order)
    rows = landing.filter(F.col("record_type").isin(list(ranges))).withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n)
    wanted = F.create_map(*[x for t, r in ranges.items() for x in (F.lit(t), F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in r]))])
    rows = rows.select("record_type", "nth", "raw_data", F.explode(wanted[F.col("record_type")]).alias("r")).select("record_type", "nth", "r.*", "raw_data")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [v.encode("cp932", errors="replace")[a:b] or None for v, a, b in zip(*(batch.column(c).to_pylist() for c in ("raw_data", "lo", "hi")), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("record_type", "nth", "lo", "hi")), pa.array([v and v.hex().upper() for v in raw], pa.string()),
                 pa.array([v and v.decode("cp932", errors="replace") for v in raw], pa.string())],
                names=["record_type", "nth", "lo", "hi", "hex", "text"])

    return rows.mapInArrow(cut, "record_type string, nth int, lo int, hi int, hex string, text string")


def check_projection(landing: DataFrame, record_type: str, fields: list[str], n: int = 5,
                     order: list[str] = ("raw_data",)) -> DataFrame:
    """A few named fields of the first ``n`` rows of a type (P10, T4)."""
    return (landing.filter(F.col("record_type") == record_type)
            .orderBy(*order).select("record_type", *fields).limit(n))


def record_census(landing: DataFrame, corrupt_col: str | None = None) -> DataFrame:
    """Rows per type tag, sorted, with a total row (``tag`` NULL)."""
    tag = type_tag(corrupt=corrupt_col if corrupt_col and corrupt_col in landing.columns else None)
    return (landing.select(tag.alias("tag")).rollup("tag").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("tag").asc_nulls_last()))


def sample_by_type(landing: DataFrame, types: list[str], order: list[str] = ("fetched_at", "raw_data")) -> DataFrame:
    """First record of each requested type under ``order``."""
    t = landing.withColumn("_tag", type_tag())
    w = Window.partitionBy("_tag").orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return (t.filter(F.col("_tag").isin(list(types)))
            .withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn", "_tag"))
