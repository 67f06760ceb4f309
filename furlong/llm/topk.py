"""Exact top-k by inner product over a pivot-distance index (operator 11).

Vectors become integer vectors; equal ones are one point with its ``k + 1``
smallest ids, as no more copies can rank. Pivots are the centres of a bounded
sample. Each point is keyed by its nearest pivot and its distance from it; the
quantiles of the distances cut each pivot's points into annuli, each with its
range of distances and largest length. For a query at distance D of a pivot
no point of an annulus lies nearer than its gap (lo - D or D - hi, or 0), so
by ``2 <q, x> = |q|^2 + |x|^2 - |q - x|^2`` no score there passes
``(|q|^2 + max |x|^2 - gap^2) / 2``.

A query expands its annuli in the order of that bound, ``FIRST`` of them and
then ``GROWTH`` times as many each round, and stops once no bound reaches its
k-th best score. Rounds are stored tables: a query's row has its distances,
so the order is the same in every round. Annuli live in blocks of at most
``BLOCK`` points of one or more annuli; a larger annulus is several blocks.
Queries go to the blocks they must visit in chunks of ``CHUNK``, and a block
answers with at most k ids for a query that can still rank. Pivots (``PIVOTS``
of ``PIVOT_WIDTH`` components) and annuli (``RINGS`` a pivot) have a fixed
bound and are broadcast; points, queries and results are not.

Defined results: vectors that are null or hold null or non-finite components
take no part; of two vectors the shorter counts as padded with zeros, so an
empty vector scores 0 with all; a query is a row, and leaves out only its own
row; ties go to the smaller id, null ids last; repeated rows rank one after
the other; a null id is no query; sums that are not exact in a double are
taken in whole numbers, and a score beyond a long is its nearest end; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furlong.llm import bytesops as B
from furlong.llm.common import pick, read_table, store, with_uid

SCALE = 64
TOP = 20
EVERY = 20
SAMPLE = 4096
PIVOTS = 512
PIVOT_WIDTH = 1024
POINTS_A_PIVOT = 512
RINGS = 8
LLOYD = 6
BLOCK = 1024
CHUNK = 8192
FIRST = 8
GROWTH = 8
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """Stored uid, vec_id and x (whole numbers as doubles) of the sound rows."""
    v = with_uid(pick(vectors, vec_id="vec_id", vec="embedding"))
    y = F.transform("vec", lambda c: c.cast("double") * scale)
    v = v.withColumn("y", y).filter(F.col("vec").isNotNull() & F.forall("y", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    whole = F.transform("y", lambda c: F.when(F.abs(c) >= _EXACT, c).otherwise(F.floor(c).cast("double")))
    return store(v.select("uid", "vec_id", whole.alias("x")), "integer-vectors")


def distinct_points(rows: DataFrame, k: int) -> DataFrame:
    """Stored pid, x, ids: each vector once, with its k + 1 smallest (none, vec_id, uid)."""
    nth = F.row_number().over(Window.partitionBy("x").orderBy(F.col("vec_id").asc_nulls_last(), "uid"))
    few = rows.withColumn("nth", nth).filter(F.col("nth") <= k + 1)
    ids = F.sort_array(F.collect_list(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id", "uid")))
    return store(with_uid(few.groupBy("x").agg(ids.alias("ids")), "pid"), "vector-points")


def _ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows padded with zeros to the longest, and their lengths."""
    n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(n.max(initial=0))
    if len(n) and (n == width).all():
        return flat.reshape(len(n), width), n
    out = np.zeros((len(n), width))
    out[np.repeat(np.arange(len(n)), n), np.concatenate([np.arange(k) for k in n]) if len(n) else []] = flat
    return out, n


def fit_pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """k centres of the sample; centres without points stay where they began."""
    rng = np.random.default_rng(11)
    at = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(LLOYD):
        near = (distances(sample, at)).argmin(axis=1)
        n = np.bincount(near, minlength=len(at))
        sums = np.zeros_like(at)
        np.add.at(sums, near, sample)
        at = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], at)
    return at


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """From each row to each pivot; the shorter side is padded with zeros."""
    m = min(x.shape[1], pivots.shape[1])
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * (x[:, :m] @ pivots[:, :m].T)
    return np.sqrt(np.maximum(square, 0))


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, as doubles where those are exact, else as integers."""
    m = min(q.shape[1], x.shape[1])
    q, x = q[:, :m], x[:, :m]
    if not m or m * np.abs(q).max(initial=0) * np.abs(x).max(initial=0) < _EXACT:
        return q @ x.T
    whole = [[int(a) for a in r] for r in x.tolist()]
    rows = [[int(a) for a in r] for r in q.tolist()]
    return np.array([[max(-_LONG - 1, min(_LONG, sum(a * b for a, b in zip(r, s, strict=True)))) for s in whole] for r in rows], object).reshape(len(q), len(x))


class Index:
    """Points keyed by pivot, annulus and block, and the directory of annuli."""

    def __init__(self, points: DataFrame, pivots: int | None = None, rings: int = RINGS, block: int = BLOCK) -> None:
        spark = points.sparkSession
        n = points.count()
        self.empty = not n
        if self.empty:
            return
        k = pivots or min(PIVOTS, max(1, n // POINTS_A_PIVOT))
        head = points.orderBy(F.xxhash64("pid"), "pid").limit(SAMPLE).select(F.slice("x", 1, PIVOT_WIDTH).alias("x")).toArrow()
        self.pivots = fit_pivots(_ragged(head.column("x").combine_chunks())[0], k)
        shared = spark.sparkContext.broadcast(self.pivots)

        def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, _ = _ragged(batch.column("x"))
                d = distances(x, shared.value)
                near = d.argmin(axis=1) if len(x) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(x)), near]), pa.array((x * x).sum(axis=1))],
                                                 names=[*batch.schema.names, "pivot", "dist", "square"])

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)
        keyed = store(points.mapInArrow(key, f"{fields}, pivot int, dist double, square double"), "keyed-points")
        cuts = [i / rings for i in range(1, rings)]
        edges = keyed.groupBy("pivot").agg(F.percentile_approx("dist", cuts, 1000).alias("edges")) if cuts else keyed.select("pivot", F.array().cast("array<double>").alias("edges")).distinct()
        ring = F.size(F.filter("edges", lambda e: e < F.col("dist")))
        keyed = keyed.join(F.broadcast(edges), "pivot").withColumn("ring", ring).drop("edges")
        found = keyed.groupBy("pivot", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.max("square").alias("square")).orderBy("pivot", "ring").collect()
        self.pivot, self.lo, self.hi, self.square = (np.array([r[c] for r in found]) for c in ("pivot", "lo", "hi", "square"))
        self.first, self.parts, blocks, room = [], [], 0, 0
        for r in found:  # annuli fill blocks one after the other; a large one has blocks of its own
            parts = -(-r.n // block)
            if parts > 1 or r.n > room:
                self.first.append(blocks)
                blocks += parts
                room = 0 if parts > 1 else block - r.n
            else:
                self.first.append(blocks - 1)
                room -= r.n
            self.parts.append(parts)
        self.first, self.parts = np.array(self.first), np.array(self.parts)
        table = spark.createDataFrame([(r.pivot, r.ring, i, int(f), int(p)) for i, (r, f, p) in enumerate(zip(found, self.first, self.parts, strict=True))], "pivot int, ring int, annulus int, first int, parts int")
        part = F.pmod(F.xxhash64("pid"), F.col("parts")).cast("int")
        self.points = store(keyed.join(F.broadcast(table), ["pivot", "ring"]).select((F.col("first") + part).alias("block"), "annulus", "x", "ids"), "index-points")

    def bounds(self, square: np.ndarray, d: np.ndarray) -> np.ndarray:
        """The largest score that each query may have in each annulus, with room for rounding."""
        at = d[:, self.pivot]
        gap = np.maximum(0, np.maximum(self.lo - at, at - self.hi))
        most = square[:, None] + self.square
        return (most - gap * gap) / 2 + 1e-6 * most


def _visits(index: Index, start: int, stop: int, chunks: int):
    """Of queries: one row for each block to visit, with the annuli wanted there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                d, _ = _ragged(some.column("d"))
                bound = index.bounds(some.column("square").to_numpy(), d)
                order = np.argsort(-bound, axis=1, kind="stable")[:, start:stop]
                least = some.column("least").cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                row, col = np.nonzero(np.take_along_axis(bound, order, 1) >= least[:, None])
                annulus = order[row, col]
                times = index.parts[annulus]
                row, first = np.repeat(row, times), np.repeat(index.first[annulus], times)
                inner = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                block, annulus = first + inner, np.repeat(annulus, times)
                by = np.lexsort((annulus, block, row))
                row, block, annulus = row[by], block[by], annulus[by]
                new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (block[1:] != block[:-1])])) if len(row) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([new, [len(row)]]), pa.int32()), pa.array(annulus.astype(np.int32)))
                at = pa.array(row[new])
                chunk = (some.column("uid").to_numpy()[row[new]] * 0x9E3779B1 >> 7) % chunks
                yield pa.RecordBatch.from_arrays([pa.array(block[new].astype(np.int32)), pa.array(chunk.astype(np.int32)), some.column("uid").take(at), some.column("x").take(at), some.column("least").take(at), lists],
                                                 names=["block", "chunk", "uid", "x", "least", "wanted"])
    return run


def _best(score: np.ndarray, wanted: np.ndarray, least: list, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, point) pairs of each query's k + 1 best points that reach its least score; points come in the order of ids."""
    rows, cols = [], []
    for i in range(len(score)):
        at = np.flatnonzero(wanted[i])
        s = score[i, at]
        if least[i] is not None:
            keep = s >= least[i]
            at, s = at[keep], s[keep]
        if len(at) > k + 1:
            if s.dtype != object:
                cut = np.partition(s, len(s) - k - 1)[len(s) - k - 1]
                at, s = at[s >= cut], s[s >= cut]
            at = at[sorted(range(len(s)), key=lambda j: -s[j])[: k + 1]] if s.dtype == object else at[np.argsort(-s, kind="stable")[: k + 1]]
        rows.append(np.full(len(at), i))
        cols.append(at)
    return np.concatenate(rows), np.concatenate(cols)


def _answer(k: int):
    """Of (block, chunk) groups of points, then queries: hits (uid, vec_id, other, score)."""
    names = ["uid", "other", "vec_id", "score"]

    def answer(x: np.ndarray, annulus: np.ndarray, ids: list, queries: pa.RecordBatch) -> pa.RecordBatch:
        q, _ = _ragged(queries.column("q"))
        uid, least = queries.column("uid").to_numpy(), queries.column("least").to_pylist()
        lists = queries.column("wanted")
        of = np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy(zero_copy_only=False))
        want = lists.flatten().to_numpy()
        wanted, score = np.zeros((len(q), len(x)), bool), None
        for a in np.unique(want):
            rows, cols = of[want == a], np.flatnonzero(annulus == a)
            if not len(cols):
                continue
            s = exact_scores(q[rows], x[cols])
            if score is None:
                score = np.zeros(wanted.shape, s.dtype)
            if s.dtype == object and score.dtype != object:
                score = np.array([[int(v) for v in r] for r in score.tolist()], object).reshape(score.shape)
            score[np.ix_(rows, cols)] = s
            wanted[np.ix_(rows, cols)] = True
        out: list[list] = [[], [], [], []]
        if score is not None:
            for i, j in zip(*_best(score, wanted, least, k), strict=True):
                s, me = int(score[i, j]), int(uid[i])
                for one in ids[j]:
                    if one["uid"] != me:
                        for column, value in zip(out, (me, one["uid"], one["vec_id"], s), strict=True):
                            column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in B.whole_groups(batches, ["block", "chunk"]):
            for s, e in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                group = table.slice(s, e - s).combine_chunks().to_batches()[0]
                n = int((~group.column("asks").to_numpy(zero_copy_only=False)).sum())
                if not n or n == group.num_rows:
                    continue
                ids = group.column("ids").slice(0, n).to_pylist()
                by = sorted(range(n), key=lambda j: (ids[j][0]["none"], ids[j][0]["vec_id"] or 0, ids[j][0]["uid"]))
                x, _ = _ragged(group.column("q").slice(0, n))
                annulus = group.column("annulus").slice(0, n).to_numpy()
                for i in range(n, group.num_rows, 512):
                    yield answer(x[by], annulus[by], [ids[j] for j in by], group.slice(i, 512))
    return run


def _rank(hits: DataFrame, k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("uid").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "other"))
    return hits.withColumn("rank", nth).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = TOP, scale: int = SCALE, pivots: int | None = None, rings: int = RINGS,
          block: int = BLOCK, chunk: int = CHUNK, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """query_id, rank, vec_id and score of ``vectors`` (vec_id, embedding);
    ``is_query`` is a condition on vec_id."""
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, scale)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    index = Index(distinct_points(rows, k), pivots, rings, block)
    if index.empty:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score long")
    shared = spark.sparkContext.broadcast(index.pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = _ragged(batch.column("x"))
            d = distances(x, shared.value)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, d.size + 1, d.shape[1]), pa.int32()), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array((x * x).sum(axis=1))], names=[*batch.schema.names, "d", "square"])

    queries = store(rows.filter(F.col("vec_id").isNotNull() & is_query).mapInArrow(measure, f"uid long, vec_id {kind}, x array<double>, d array<double>, square double"), "queries")
    chunks = max(1, -(-queries.count() // chunk))
    annuli, start, size, best = len(index.pivot), 0, first, None
    points = index.points.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).select(
        "block", "chunk", F.lit(False).alias("asks"), F.col("x").alias("q"), "annulus", "ids", F.lit(None).cast("long").alias("uid"), F.lit(None).cast("long").alias("least"), F.lit(None).cast("array<int>").alias("wanted"))
    directory = _Directory(index)
    while start < annuli:
        open_queries = queries.withColumn("least", F.lit(None).cast("long"))
        if best is not None:
            last = best.filter(F.col("rank") == k).select("uid", F.col("score").alias("least"))
            open_queries = queries.join(last, "uid", "left")
        visits = store(open_queries.select("uid", "x", "d", "square", "least").mapInArrow(
            _visits(directory, start, min(annuli, start + size), chunks), "block int, chunk int, uid long, x array<double>, least long, wanted array<int>"), "visits")
        asked = visits.select("block", "chunk").distinct()
        asks = visits.select("block", "chunk", F.lit(True).alias("asks"), F.col("x").alias("q"), F.lit(None).cast("int").alias("annulus"),
                             F.lit(None).cast(points.schema["ids"].dataType).alias("ids"), "uid", "least", "wanted")
        both = points.join(asked, ["block", "chunk"], "left_semi").unionByName(asks)
        hits = both.repartition("block", "chunk").sortWithinPartitions("block", "chunk", "asks").mapInArrow(_answer(k), "uid long, other long, vec_id long, score long")
        best = store(_rank(hits if best is None else best.drop("rank").unionByName(hits), k), "best")
        start, size = start + size, size * growth
    return best.join(queries.select("uid", F.col("vec_id").alias("query_id")), "uid").select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").cast(kind).alias("vec_id"), "score")


class _Directory:
    """The annuli alone, as tasks need them."""

    def __init__(self, index: Index) -> None:
        self.pivot, self.lo, self.hi, self.square, self.first, self.parts = index.pivot, index.lo, index.hi, index.square, index.first, index.parts

    bounds = Index.bounds


def q_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


#: All queries against all rows.
ORACLE_TOPK = f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda c: floor({SCALE} * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0
), scored AS (
  SELECT q.rid, q.vec_id AS query_id, v.vec_id, v.rid AS other,
         CAST(coalesce(list_sum(list_transform(list_zip(q.x, v.x), lambda p: coalesce(p[1] * p[2], 0))), 0) AS BIGINT) AS score
  FROM v q JOIN v ON q.rid <> v.rid WHERE q.vec_id % {EVERY} = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST, other) AS INT) AS rank, vec_id, score
FROM scored QUALIFY rank <= {TOP}
"""
