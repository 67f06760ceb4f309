"""JSONL landing files and raw tables.

- landing layout: ``<root>/type_tag=<TYPE>/ingest_date=<yyyyMMdd>/part-*.json.gz``
  (the reference writes ``<TYPE>_<yyyyMMdd>.jsonl``; both are readable, packed
  or not). Records are mostly blanks, so packed files are a tenth as large;
- every landing read uses an explicit all-string schema (a leading zero in
  ``"01"`` survives), PERMISSIVE mode and a ``_corrupt_record`` column, so a
  malformed line becomes a visible reject row instead of failing the job or
  silently vanishing (S13);
- raw tables are appended per batch into their own folder, so a replayed
  batch overwrites itself instead of appending twice.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong.functions.text import WHITESPACE, trim_ws
from furlong.operators.parse import LANDING_COLUMNS, LANDING_SCHEMA, parse_records
from furlong.session import brief_shuffles, materialize, session_conf
from furlong.sources import fields, fs, quarantine
from furlong.sources.fields import EXTRA

CORRUPT = "_corrupt_record"
NAMED = "*.jsonl*"
READ_SCHEMA = T.StructType(list(LANDING_SCHEMA.fields) + [T.StructField(CORRUPT, T.StringType())])
RAW_COLUMNS = [*LANDING_COLUMNS, EXTRA]
#: A line with a character that trim_ws leaves; the search ends at the first.
NOT_BLANK = "[^" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE) + "]"
#: Files a task keeps open by partition, so that its rows need no sort; with more partitions Spark sorts the rest.
OPEN_FILES = 64


def packed_by(df: DataFrame, *columns: str) -> DataFrameWriter:
    """A writer of packed text files (JSON or lines), partitioned by ``columns``.
    Level 5 takes half the time of 6 for files a few hundredths larger."""
    return df.write.option("compression", "gzip").option("zlib.compress.level", "FIVE").partitionBy(*columns)


@contextmanager
def open_files(spark: SparkSession):
    """Within this block a partitioned write keeps ``OPEN_FILES`` files open a
    task instead of sorting (and spilling) all rows by partition, and leaves no
    shuffle files behind."""
    with brief_shuffles(spark), session_conf(spark, "spark.sql.maxConcurrentOutputFileWriters", str(OPEN_FILES)):
        yield


def parse_json_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """JSON text lines -> landing columns, a ``map`` of all fields outside the
    landing schema (NULL when there are none), and the malformed line, if it is
    one. Blank lines are dropped; other columns of ``lines`` are kept. A line
    that is just what its landing columns are written as has no other fields:
    only the rest are parsed again for them."""
    rec = F.from_json(value, READ_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rest = F.map_filter(F.from_json(value, T.MapType(T.StringType(), T.StringType())), lambda k, v: ~k.isin(LANDING_COLUMNS) & v.isNotNull())
    others = [c for c in lines.columns if c != value]
    return (lines.filter(F.col(value).rlike(NOT_BLANK)).withColumn("_rec", rec).withColumn("_rest", F.when(~F.col(value).eqNullSafe(F.to_json("_rec")), rest))
            .select(*others, "_rec.*", F.when(F.size("_rest") > 0, F.col("_rest")).alias(EXTRA)))


def file_record_type(file_name: Column) -> Column:
    """Text before the first '_' of a file name, trimmed; blank -> NULL."""
    return F.nullif(trim_ws(F.split_part(file_name, F.lit("_"), F.lit(1))), F.lit(""))


def read_landing(spark: SparkSession, path: str, reference_names: bool = False, rejects: DataFrame | None = None) -> DataFrame:
    """Read landing JSONL (S1, S2, S13). With ``reference_names`` the record
    type comes from ``<TYPE>_<date>.jsonl`` file names (files with a blank
    type are skipped); otherwise from the ``type_tag`` partition folder.
    Files among ``rejects`` (of :func:`load_landing`) are left out."""
    r = spark.read if rejects is None else spark.read.option("ignoreCorruptFiles", "true")
    if reference_names:
        lines = r.option("pathGlobFilter", NAMED).text(path)
    else:
        lines = r.schema("value string, type_tag string, ingest_date string").text(path)
    lines = lines.withColumns({"source_file": F.col("_metadata.file_name"), "file_path": F.col("_metadata.file_path")})
    df = parse_json_lines(lines if rejects is None else quarantine.without_damaged(lines, rejects)).drop("file_path")
    if reference_names:
        return df.withColumn("file_type", file_record_type(F.col("source_file"))).filter(F.col("file_type").isNotNull())
    return df.withColumnRenamed("type_tag", "file_type")


def load_landing(spark: SparkSession, path: str, reference_names: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows of the sound files, and the damaged files as rows."""
    rejects = materialize(quarantine.damaged_files(spark, path, NAMED if reference_names else None), "rejects")
    return read_landing(spark, path, reference_names, rejects), rejects


def write_landing(parsed: DataFrame, path: str, mode: str = "append") -> None:
    """Landing sink (S3): split by record type (missing -> UNKNOWN) and
    ingest day, packed UTF-8 JSON lines, NULL fields omitted."""
    day = F.date_format(F.current_timestamp(), "yyyyMMdd")
    rows = parsed.select(*LANDING_COLUMNS,
                         F.coalesce(F.col("record_type"), F.lit("UNKNOWN")).alias("type_tag"), day.alias("ingest_date"))
    with open_files(parsed.sparkSession):
        packed_by(rows, "type_tag", "ingest_date").mode(mode).json(path)


def land_records(raw: DataFrame, path: str, raw_col: str = "raw_data", fetched_at=None) -> None:
    """Parse fixed-width records and write them to the landing layout."""
    write_landing(parse_records(raw, raw_col, fetched_at), path)


def landing_rows(df: DataFrame) -> DataFrame:
    """Only the landing columns of a read (drops read metadata)."""
    return df.select(*[c for c in RAW_COLUMNS if c in df.columns])


def append_raw(df: DataFrame, raw_root: str, record_type: str, batch: str | int | None = None) -> None:
    """Append a batch to the raw table of a type (S4), in a folder of its own:
    ``type=<TYPE>/batch=<batch>``, overwritten when the batch is replayed. New
    columns are allowed: raw tables are read with ``mergeSchema``, and fields
    outside the layout become typed columns."""
    name = uuid.uuid4().hex if batch is None else str(batch)
    df.write.mode("overwrite").parquet(f"{raw_root}/type={record_type}/batch={name}")
    stored = df.sparkSession.read.parquet(f"{raw_root}/type={record_type}/batch={name}")
    fields.record_fields(stored, raw_root, F.lit(record_type), f"{record_type}-{name}")


def append_raw_batch(df: DataFrame, raw_root: str, record_type: Column, batch: str | int) -> None:
    """The same for a batch of many types, in one write."""
    with open_files(df.sparkSession):
        (df.withColumns({"type": record_type, "batch": F.lit(str(batch))}).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("type", "batch").parquet(raw_root))
    written = [t for t in fs.list_dirs(df.sparkSession, raw_root) if t.startswith("type=") and fs.exists(df.sparkSession, f"{raw_root}/{t}/batch={batch}")]
    if EXTRA in df.columns and written:   # from the rows as stored: the batch is not computed again
        kept = df.select(EXTRA, record_type.alias("type")).schema
        stored = df.sparkSession.read.schema(kept).option("basePath", raw_root).parquet(*[f"{raw_root}/{t}/batch={batch}" for t in written])
        fields.record_fields(stored, raw_root, F.col("type"), str(batch))


def read_raw(spark: SparkSession, raw_root: str, record_type: str, batch: str | int | None = None, typed: bool = True) -> DataFrame:
    """Raw rows of a type, or of one batch of it, with a typed column for each
    field outside the layout (S4); ``typed=False`` leaves those in their map."""
    path = f"{raw_root}/type={record_type}"
    if batch is not None:
        rows = spark.read.parquet(f"{path}/batch={batch}")
    else:
        rows = spark.read.option("mergeSchema", "true").parquet(path).drop("batch")
    return fields.with_typed_fields(rows, raw_root, record_type) if typed else rows


def reparse_lines(spark: SparkSession, input_path: str, fetched_default: str = "") -> DataFrame:
    """Backfill (S12): re-parse the stored ``raw_data`` of every landing line
    with the current layouts. Output: ``source_file`` and the output ``line``.

    Lines that have a non-empty ``raw_data`` are re-parsed, keeping their
    ``fetched_at`` ('' when missing) and ``raw_data``; every other line
    (no ``raw_data``, malformed JSON, not an object) passes through as text.
    Read as text, so a passthrough line is byte-for-byte the input line.
    """
    lines = spark.read.text(input_path).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("source_file"),
                                               F.get_json_object("value", "$.raw_data").alias("_raw_data"))
    todo = F.col("_raw_data") != ""   # one pass: a line without text has nothing to parse, and stays
    fa = F.when(todo, F.coalesce(F.get_json_object("line", "$.fetched_at"), F.lit(fetched_default)))
    parsed = parse_records(lines, "_raw_data", fa, keep=["source_file", "line"])
    new = F.to_json(F.struct(*LANDING_COLUMNS))
    return parsed.select("source_file", F.when(F.col("raw_data") != "", new).otherwise(F.col("line")).alias("line"))


def write_lines(df: DataFrame, path: str) -> None:
    """Write backfilled lines, packed, one folder per source file name."""
    with open_files(df.sparkSession):
        packed_by(df, "source_file").mode("overwrite").text(path)
