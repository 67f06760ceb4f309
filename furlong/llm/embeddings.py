"""Embedding near-duplicates by iterative quantisation (operator 8).

Equal vectors are one point with a count. A rotation of the leading principal
axes is learned on a bounded sample (``SAMPLE`` vectors, the smallest by hash)
so that the signs of the rotated vectors are balanced binary codes. How far
apart the codes of two vectors at the threshold lie depends on the data (a
direction that all vectors share shrinks what the codes can tell apart), so it
is measured: pairs at just the threshold are made from the sample, the reach is
the bit distance that all but ``LOST`` of them stay within, and the number of
Hamming tables the least that brings all but ``LOST`` of them together. Each
table is keyed by a part of the code; a code is looked up under every key at
most one bit from its own. ``exact=True`` compares all points, block against
block, without codes. A table's bucket returns a
spanning forest of such code pairs, and their components are the candidate
sets. Within a set, the original vectors are compared in double precision,
block against block, so a set of any size is work for many tasks; a block
returns counts of links and a spanning forest, never the pairs.

Defined results: vectors that are null, empty, zero or hold null or
non-finite components have no links and their own id as component; vectors of
different lengths are never linked; ties and repeated rows link like any
others; extra columns are not read; rows with a null id are kept and count as links; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm import bytesops as B
from furlong.llm.common import pick, read_table, store, with_uid
from furlong.llm.components import Forest, components

THRESHOLD = 0.95
BITS = 64
TABLES = (4, 5, 6, 7, 8, 10, 12, 16)
LOST = 0.002
TRIALS = 4000
SAMPLE = 20_000
ROUNDS = 40
BLOCK_VECTORS = 2048
CELLS = 1 << 21


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of unit length; scaled first, so that neither tiny nor huge components are lost."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_rotation(sample: np.ndarray, bits: int = BITS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): the signs of (x - mean) @ projection are the code."""
    x = unit(sample.astype(np.float64))
    mean = x.mean(axis=0)
    _, vec = np.linalg.eigh((x - mean).T @ (x - mean))
    axes = vec[:, ::-1][:, : min(bits, x.shape[1])]
    v = (x - mean) @ axes
    r, _ = np.linalg.qr(np.random.default_rng(7).standard_normal((axes.shape[1], axes.shape[1])))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return mean, axes @ r


def codes(x: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    on = (unit(x.astype(np.float64)) - model[0]) @ model[1] >= 0
    out = np.zeros((len(x), 64), bool)
    out[:, : on.shape[1]] = on
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64).ravel()


def _matrix(array: pa.Array, dim: int) -> np.ndarray:
    return array.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _parts(bits: int, tables: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each table's part."""
    edges = [bits * k // tables for k in range(tables + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _deal(bits: int, tables: int):
    parts = _parts(bits, tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column("code").to_numpy().view(np.uint64)
            for t, (first, n) in enumerate(parts):
                own = (code >> np.uint64(first)) & np.uint64((1 << n) - 1)
                for flip in (0, *(1 << k for k in range(n))):
                    key = (own ^ np.uint64(flip)).astype(np.int64) | t << 32
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(code), flip == 0)), pa.array(B.signed(code))], names=["key", "home", "code"])
    return run


def _bucket_links(reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in B.whole_groups(batches, ["key"]):
            codes_of, at_home = table.column("code").to_numpy().view(np.uint64), table.column("home").to_numpy()
            a_out, b_out = [], []
            for s, e in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                code, home = codes_of[s:e], at_home[s:e]
                n = int(home.sum())
                if not n or e - s < 2:
                    continue
                code = np.concatenate([code[home], code[~home]])
                forest = Forest(len(code))
                step = max(1, CELLS // n)
                for i in range(0, len(code), step):
                    a, b = np.nonzero(np.bitwise_count(code[i : i + step, None] ^ code[None, :n]) <= reach)
                    forest.add(i + a, b)
                linked = np.flatnonzero(forest.label != np.arange(len(code)))
                a_out.append(code[linked])
                b_out.append(code[forest.label[linked]])
            a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a_out, b_out))
            yield pa.RecordBatch.from_arrays([pa.array(B.signed(a)), pa.array(B.signed(b))], names=["a", "b"])
    return run


def _block_links(threshold: float):
    """Of pairs of blocks: counts of links (a, null, n) and a forest (a, b, null)."""
    def one(cid: np.ndarray, n: np.ndarray, x: np.ndarray, p: np.ndarray, q: np.ndarray, same: bool) -> tuple[np.ndarray, Forest]:
        links, forest = np.zeros(len(x), np.int64), Forest(len(x))
        step = max(1, CELLS // max(1, len(q)))
        for i in range(0, len(p), step):
            a, b = np.nonzero(x[p[i : i + step]] @ x[q].T >= threshold)
            a, b = p[i + a], q[b]
            if same:
                a, b = a[a < b], b[a < b]
            links += np.bincount(a, n[b], len(x)).astype(np.int64) + np.bincount(b, n[a], len(x)).astype(np.int64)
            forest.add(a, b)
        return links, forest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in B.whole_groups(batches, ["root", "lo", "hi"]):
            cids, ns, blocks, los, his = (table.column(c).to_numpy() for c in ("cid", "n", "block", "lo", "hi"))
            vecs = table.column("vec").combine_chunks()
            a, b, n = [], [], []
            for s, e in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                cid, lo, hi = cids[s:e], los[s], his[s]
                x = unit(vecs.slice(s, e - s).flatten().to_numpy(zero_copy_only=False).reshape(e - s, -1).astype(np.float64))
                links, forest = one(cid, ns[s:e], x, np.flatnonzero(blocks[s:e] == lo), np.flatnonzero(blocks[s:e] == hi), lo == hi)
                hung, some = np.flatnonzero(forest.label != np.arange(len(x))), np.flatnonzero(links)
                a += [*cid[hung].tolist(), *cid[some].tolist()]
                b += [*cid[forest.label[hung]].tolist(), *[None] * len(some)]
                n += [*[None] * len(hung), *links[some].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (a, b, n)], names=["a", "b", "n"])
    return run


def threshold_flips(sample: np.ndarray, model: tuple[np.ndarray, np.ndarray], threshold: float) -> np.ndarray:
    """Differing bits, as codes, of pairs at just the threshold: vectors of the
    sample, and what they become when turned towards another one or at random."""
    rng = np.random.default_rng(5)
    x = unit(sample[rng.integers(0, len(sample), TRIALS)].astype(np.float64))
    to = np.where(np.arange(TRIALS)[:, None] % 2 == 0, unit(sample[rng.integers(0, len(sample), TRIALS)].astype(np.float64)), rng.standard_normal(x.shape))
    to = to - (to * x).sum(axis=1, keepdims=True) * x
    size = np.sqrt((to * to).sum(axis=1, keepdims=True))
    x, to = x[size[:, 0] > 1e-9], (to / np.maximum(size, 1e-9))[size[:, 0] > 1e-9]
    return codes(x, model) ^ codes(threshold * x + np.sqrt(1 - threshold * threshold) * to, model)


def plan_tables(flips: np.ndarray, bits: int) -> tuple[int, int]:
    """(reach, tables) that lose at most ``LOST`` of the pairs each."""
    if not len(flips):
        return 0, 1
    apart = np.bitwise_count(flips)
    reach = int(np.quantile(apart, 1 - LOST, method="higher"))
    for tables in [t for t in TABLES if t <= bits] or [bits]:
        met = np.zeros(len(flips), bool)
        for first, n in _parts(bits, tables):
            met |= np.bitwise_count((flips >> np.uint64(first)) & np.uint64((1 << n) - 1)) <= 1
        if met.mean() >= 1 - LOST:
            break
    return reach, tables


def _candidate_sets(points: DataFrame, dim: int, threshold: float) -> DataFrame:
    """Column ``root`` added: two points are compared only if it is equal."""
    spark = points.sparkSession
    sample = points.orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).select("vec").toPandas()["vec"]
    bits = min(BITS, dim)
    sample = np.stack(sample.to_list())
    fitted = fit_rotation(sample, bits)
    reach, tables = plan_tables(threshold_flips(sample, fitted, threshold), bits)
    model = spark.sparkContext.broadcast(fitted)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = codes(_matrix(batch.column("vec"), dim), model.value) if batch.num_rows else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(B.signed(code))], names=[*batch.schema.names, "code"])

    coded = store(points.mapInArrow(encode, "cid long, vec array<float>, n long, code long"), "codes")
    dealt = coded.select("code").distinct().mapInArrow(_deal(bits, tables), "key long, home boolean, code long")
    near = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_links(reach), "a long, b long")
    roots = components(near).select(F.col("a").alias("code"), F.col("b").alias("root"))
    return coded.join(roots, "code", "left").withColumn("root", F.coalesce("root", "code"))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, exact: bool = False) -> DataFrame:
    """uid, vec_id, n_links, component_id of ``vectors`` (vec_id, embedding).
    ``exact`` compares all points of a length with each other."""
    v = with_uid(pick(vectors, vec_id="vec_id", vec="embedding")).withColumn("vec", F.col("vec").cast("array<float>"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = F.coalesce((F.size("vec") > 0) & F.forall("vec", fine) & F.exists("vec", lambda x: x != 0), F.lit(False))
    v = store(v.withColumn("point", F.when(sound, F.transform("vec", lambda x: x + F.lit(0.0).cast("float")))).drop("vec"), "vectors")
    points = store(with_uid(v.filter("point is not null").groupBy(F.col("point").alias("vec")).agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id")), "cid"), "vector-points")
    dims = sorted(r.d for r in points.select(F.size("vec").alias("d")).distinct().collect())
    found = None
    for dim in dims:
        of_dim = points.filter(F.size("vec") == dim).select("cid", "vec", "n")
        sets = of_dim.withColumn("root", F.lit(0).cast("long")) if exact else store(_candidate_sets(of_dim, dim, threshold), "candidate-sets")
        sizes = sets.groupBy("root").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        blocks = F.ceil(F.col("size") / BLOCK_VECTORS).cast("int")
        rows = sets.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("cid"), blocks).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        rows = rows.select("root", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "cid", "n", "vec")
        part = rows.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi").mapInArrow(_block_links(threshold), "a long, b long, n long")
        found = part if found is None else found.union(part)
    if found is None:
        return v.select("uid", "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    found = store(found, "vector-links")
    links = found.filter("n is not null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("links"))
    to = components(found.filter("b is not null").select("a", "b")).select(F.col("a").alias("cid"), F.col("b").alias("root"))
    rooted = points.join(to, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = rooted.join(ids, "root").join(links, "cid", "left").select(
        F.col("vec").alias("point"), "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return (v.join(known, "point", "left").select(
        "uid", "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")))


def q_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(read_table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: All pairs. The query may miss a link (its recall is measured); where it finds all, the two agree.
ORACLE_EMBEDDINGS = f"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS e,
         len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS sound
  FROM embeddings
), link AS (
  SELECT a.rid AS x, b.rid AS y FROM v a JOIN v b ON a.sound AND b.sound AND len(a.e) = len(b.e) AND a.rid <> b.rid
  WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}
), met AS (
  SELECT rid AS x, rid AS y FROM v UNION SELECT met.x, link.y FROM met JOIN link ON met.y = link.x
), root AS (
  SELECT met.x AS rid, min(vec_id) AS component_id FROM met JOIN v ON v.rid = met.y GROUP BY met.x
)
SELECT vec_id, (SELECT count(*) FROM link WHERE x = rid) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN root USING (rid)
"""
