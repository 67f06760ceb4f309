"""SimHash near-duplicates through vantage-point trees (operator 6).

Fingerprints are made in Arrow tasks and reduced to the distinct ones, so any
number of copies is one point. The top of one vantage-point tree is fitted on
a bounded sample (``SAMPLE`` fingerprints, the smallest by hash) and only
decides where a point lives: every distinct fingerprint has one home leaf, and
is sent as a query to each other leaf that the triangle bound can't rule out.
Of two points on either side of a node's radius it is the inner one that
visits the outer side, so each pair is met once. The top has at most
``TOP_DEPTH`` levels, as many as the sample can place; a leaf with more than
``LEAF_ROWS`` fingerprints is cut into blocks, each pair of which is a task's
group, so a group is bounded at any size. Inside a group a local tree is
searched the same way, down to blocks compared bit by bit.

A leaf returns a spanning forest of its links, never its pairs: at most one
row per point that it saw. Components of these are the groups.

Defined results: null, empty and wordless texts have fingerprint zero and link
like any other; very long texts are hashed whole, some shingles at a time; null
ids count as larger than all others; repeated rows share fingerprint and
component, so ties don't arise; extra columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm import bytesops as B
from furlong.llm.common import pick, read_table, store, with_uid
from furlong.llm.components import Forest, components

SHINGLE = 3
SEED = 42
MAX_BITS = 2
SAMPLE = 1 << 15
LEAF_POINTS = 2048
TOP_DEPTH = 12
LEAF_ROWS = 1 << 15
BLOCK = 1 << 21


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """Majority of the bits of XXH64 over all shingles of ``size`` words."""
    words = text.lower().split()
    if not words:
        return 0
    xx = xxhash.xxh64_intdigest
    if len(words) <= size:
        return xx(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - size + 1
    ones = np.zeros(64, np.int64)
    at, to = starts.tolist(), ends[size - 1 :].tolist()
    for i in range(0, n, 1 << 14):
        h = np.array([xx(line[a:b], seed) for a, b in zip(at[i : i + (1 << 14)], to[i : i + (1 << 14)])], dtype=np.uint64)  # noqa: B905
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Stored uid, doc_id, k_text, fp (as a signed long)."""
    d = with_uid(pick(docs, doc_id="doc_id", text="text")).withColumn("k_text", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = B.buffers(batch.column("text"))
            fps = np.fromiter((fingerprint(data[a:b].tobytes(), size) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())), np.uint64, batch.num_rows)  # noqa: B905
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), batch.column("k_text"), pa.array(B.signed(fps))], names=["uid", "doc_id", "k_text", "fp"])

    kind = d.schema["doc_id"].dataType.simpleString()
    return store(d.mapInArrow(run, f"uid long, doc_id {kind}, k_text long, fp long"), "fingerprints")


def _bits(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _split(points: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """The vantage point and radius that halve ``points`` best with the fewest
    points near the radius, of a few tried."""
    best = None
    for v in points[rng.integers(0, len(points), 8)]:
        d = np.bincount(_bits(points, v), minlength=65)
        inner = np.cumsum(d)
        mu = int(np.argmin(np.abs(inner - len(points) / 2)))
        small = min(inner[mu], len(points) - inner[mu])
        if small > 0:
            worth = small - 0.5 * d[max(0, mu - 1) : mu + 1].sum()
            if best is None or worth > best[0]:
                best = (worth, v, mu)
    return best and (best[1], best[2])


def fit_tree(sample: np.ndarray, depth: int) -> list[tuple]:
    """Nodes (vantage, radius, inner, outer); a child below 0 is leaf ~child."""
    rng = np.random.default_rng(SEED)
    nodes: list[list] = []
    leaves = 0

    def build(points: np.ndarray, left: int) -> int:
        nonlocal leaves
        at = _split(points, rng) if left and len(points) > 1 else None
        if at is None:
            leaves += 1
            return -leaves
        d = _bits(points, at[0])
        nodes.append([int(at[0]), at[1], 0, 0])
        me = len(nodes) - 1
        nodes[me][2] = build(points[d <= at[1]], left - 1)
        nodes[me][3] = build(points[d > at[1]], left - 1)
        return me

    build(sample, depth)
    return [tuple(n) for n in nodes]


def route(nodes: list[tuple], points: np.ndarray, reach: int = MAX_BITS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, points, whether at home) for every leaf that a point lives in or must visit."""
    todo = [(0 if nodes else -1, points, np.ones(len(points), bool))]
    while todo:
        at, p, home = todo.pop()
        if not len(p):
            continue
        if at < 0:
            yield ~at, p, home
            continue
        v, mu, inner, outer = nodes[at]
        d = _bits(p, np.uint64(v)).astype(np.int16)
        go_in = np.where(home, d <= mu, d - reach <= mu)
        go_out = d + reach > mu
        todo.append((inner, p[go_in], home[go_in]))
        todo.append((outer, p[go_out], (home & (d > mu))[go_out]))


def near(queries: np.ndarray, points: np.ndarray, reach: int = MAX_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index arrays of all (query, point) at most ``reach`` bits apart, block by block."""
    rng = np.random.default_rng(SEED)
    todo = [(np.arange(len(queries)), np.arange(len(points)))]
    while todo:
        q, p = todo.pop()
        if not len(q) or not len(p):
            continue
        at = _split(points[p], rng) if len(p) > 512 and len(q) > 64 else None
        if at is not None:
            v, mu = at
            dq, dp = _bits(queries[q], v).astype(np.int16), _bits(points[p], v)
            q_in, q_out = dq - reach <= mu, dq + reach > mu
            if q_in.mean() + q_out.mean() < 1.9:
                todo += [(q[q_in], p[dp <= mu]), (q[q_out], p[dp > mu])]
                continue
        step = max(1, BLOCK // len(p))
        for i in range(0, len(q), step):
            a, b = np.nonzero(_bits(queries[q[i : i + step], None], points[None, p]) <= reach)
            if len(a):
                yield q[i + a], p[b]


_BOTH, _POINT, _QUERY = 0, 1, 2  # what a fingerprint is in its group


def _group_links(table: pa.Table) -> pa.Table:
    fps, at = np.unique(table.column("fp").to_numpy().view(np.uint64), return_inverse=True)
    role = table.column("role").to_numpy()
    queries, points = np.unique(at[role != _POINT]), np.unique(at[role != _QUERY])
    forest = Forest(len(fps))
    for a, b in near(fps[queries], fps[points]):
        forest.add(queries[a], points[b])
    linked = np.flatnonzero(forest.label != np.arange(len(fps)))
    return pa.table({"a": B.signed(fps[linked]), "b": B.signed(fps[forest.label[linked]])})


def group_blocks(dealt: DataFrame, most: int = LEAF_ROWS) -> DataFrame:
    """leaf, hb, qb, role, fp: the groups of ``dealt`` (leaf, home, fp), none
    with more than about ``most`` points and ``most`` queries. A leaf that fits
    is one group; of a larger one every block of its points meets every block
    of all that is asked there."""
    part = lambda n: F.ceil(n / F.lit(most)).cast("int")
    sizes = dealt.groupBy("leaf").agg(F.greatest(part(F.count_if("home")), F.lit(1)).alias("hbs"), part(F.count(F.lit(1))).alias("qbs"))
    rows = dealt.join(F.broadcast(sizes), "leaf")   # a row a leaf: at most 2**TOP_DEPTH
    spread = lambda n: F.pmod(F.xxhash64("fp"), n).cast("int")
    cell = lambda h, q, role: F.struct(h.alias("hb"), q.alias("qb"), F.lit(role).alias("role"))
    asks = F.transform(F.sequence(F.lit(0), F.col("hbs") - 1), lambda h: cell(h, spread(F.col("qbs")), _QUERY))
    lives = F.transform(F.sequence(F.lit(0), F.col("qbs") - 1), lambda q: cell(spread(F.col("hbs")), q, _POINT))
    whole = F.array(F.struct(F.lit(0).alias("hb"), F.lit(0).alias("qb"), F.when(F.col("home"), F.lit(_BOTH)).otherwise(F.lit(_QUERY)).alias("role")))
    cells = F.when(F.col("qbs") == 1, whole).when(F.col("home"), F.concat(asks, lives)).otherwise(asks)
    return rows.select("leaf", "fp", F.inline(cells))


def near_links(points: DataFrame, reach: int = MAX_BITS) -> DataFrame:
    """Links (a, b) that connect what lies within ``reach`` bits, of distinct column fp."""
    spark = points.sparkSession
    n = points.count()
    depth = min(TOP_DEPTH, max(0, int(np.ceil(np.log2(max(n, 1) / LEAF_POINTS)))))
    sample = np.array([r.fp for r in points.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    nodes = spark.sparkContext.broadcast(fit_tree(sample, depth))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for leaf, p, home in route(nodes.value, batch.column("fp").to_numpy().view(np.uint64), reach):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), leaf, np.int32)), pa.array(home), pa.array(B.signed(p))], names=["leaf", "home", "fp"])

    dealt = store(points.select("fp").mapInArrow(deal, "leaf int, home boolean, fp long"), "dealt-points")
    return group_blocks(dealt, LEAF_ROWS).groupBy("leaf", "hb", "qb").applyInArrow(_group_links, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, reach: int = MAX_BITS) -> DataFrame:
    """uid, doc_id, k_text, fp, component_id; component_id is the smallest doc_id reachable."""
    fps = fingerprints(docs, size)
    points = store(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "points")
    to = components(near_links(points, reach)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    rooted = points.join(to, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return fps.join(rooted.join(ids, "root").select("fp", "root", "component_id"), "fp")


def q_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: its smallest doc_id, then the smallest text
    hash; of rows that are equal in both, one.

    Defined results: null, empty and wordless texts are one group; null ids
    come last; very long texts are hashed whole; an empty table stays empty;
    extra columns stay, those of one of several equal rows."""
    found = near_duplicates(docs).groupBy("root", "doc_id", "k_text").agg(F.count(F.lit(1)).alias("n"))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k_text", "n")).alias("x"))
    keep = store(first.select(F.col("x.doc_id").alias("keep_id"), F.col("x.k_text").alias("keep_text"), F.col("x.n").alias("n")), "kept-keys")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id_"), F.xxhash64("text").alias("text_"))
    same = F.col("id_").eqNullSafe(F.col("keep_id")) & (F.col("text_") == F.col("keep_text"))
    if keep.filter("n > 1").isEmpty():
        return rows.join(keep, same, "left_semi").select("row.*")
    once = rows.join(keep.filter("n = 1"), same, "left_semi").select("row")
    again = rows.join(keep.filter("n > 1"), same, "left_semi").groupBy("id_", "text_").agg(F.first("row").alias("row")).select("row")
    return once.union(again).select("row.*")
