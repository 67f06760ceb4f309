"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm.common import store


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (a, b) with b the smallest node of a's component; nodes
    that are smallest themselves have no row. Each round first hangs every
    node's larger neighbours on its smallest one, then its smaller neighbours;
    the rounds are stored tables, and the links never reach the driver."""
    e = store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "links")
    last = _signature(e)
    while last[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        e = store(small.filter("a > b").distinct(), "links")
        now = _signature(e)
        if now == last:
            break
        last = now
    return e


class Forest:
    """Union-find over 0..n-1 that takes whole arrays of links."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.label[a], self.label[b]
        far = a != b
        if not far.any():
            return
        pairs = np.unique(np.stack([np.minimum(a, b)[far], np.maximum(a, b)[far]], 1), axis=0)
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while x in up:
                if up[x] in up:
                    up[x] = up[up[x]]
                x = up[x]
            return x

        for x, y in pairs.tolist():
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        to = np.arange(len(self.label))
        for x in up:
            to[x] = root(x)
        self.label = to[self.label]
