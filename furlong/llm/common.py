"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.session import scratch_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back: the
    lineage is cut and the written files survive a lost executor. The shuffle
    files of the write are not needed again and go with its end."""
    spark = df.sparkSession
    path = scratch_path(spark, "llm", f"{name}-{uuid.uuid4().hex[:12]}")
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def with_uid(df: DataFrame, name: str = "uid") -> DataFrame:
    """Number the rows. The number is stable only after ``store``."""
    return df.withColumn(name, F.monotonically_increasing_id())


def octets(col: Column) -> Column:
    return F.coalesce(F.octet_length(col), F.lit(0)).cast("long")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that extra
    columns of the input can never clash with columns the operator adds."""
    return df.select(*[df[src].alias(dst) for dst, src in columns.items()])
