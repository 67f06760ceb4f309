"""Tables stored for point reads."""

from __future__ import annotations

from pyspark.sql import DataFrame

ROW_GROUP = 8 << 20


def store_sorted(df: DataFrame, path: str, key: str) -> None:
    """Write ``df`` clustered and sorted by ``key``, with a Parquet bloom filter
    on it: an equality on the key reads the row groups that may hold it and
    skips all others, in files where its range would not tell.

    Rows are clustered by a rebalance: the plan runs once (a range partitioning
    would run it twice, to sample), and a key with most of the rows is split.
    """
    (df.hint("rebalance", key).sortWithinPartitions(key).write
     .option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.block.size", str(ROW_GROUP)).parquet(path))
