"""Mixing sources to target weights by a low-discrepancy schedule (operator 9).

Every source's documents are laid end to end, in the order of a hash, as one
stream of words that is cut into blocks of ``block_words``. A schedule of
``2**k`` slots maps the van der Corput points of base 2 through the cumulative
weights of the sources; a source's r-th slot takes the r-th block of its
stream, and its second pass starts when the blocks are used up. With ``2**k``
points the number of slots that fall into a source's interval is exactly the
number it asked for, and they are spread evenly over the schedule.

DataFrame functions only. No window runs over a whole source: streams are
numbered in 4096 hash buckets a source, ranks in chunks of the schedule, and
only the sums of buckets and chunks are accumulated along a source. The
windows without partitions run over the table of sources, one row each.

Defined results: a null text has size 0; a null source is a source, last in
the order; a document without words is taken 0 times; repeated rows are
separate documents; a very long text is a document of its size; ties in the
order go by id, text and row number; extra columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furlong.llm.common import pick, read_table, store, with_uid

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_EPOCHS = 2
BLOCK_WORDS = 256
BUCKET_HEX = 3
CELL_BITS = 12


@dataclass
class Mix:
    documents: DataFrame  # uid, doc_id, source, size, crc, source_size, target, taken
    sources: DataFrame  # sid, source, source_size, weight, target, quota, n_blocks, n_slots, first
    schedule: DataFrame  # i, sid, rank, epoch, block, words


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET,
                   max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of (source, source_size): ``budget`` times all sizes, shared by
    weight, none above ``max_epochs`` times its source. Sorted by cap / weight
    the capped sources are a prefix, so one pass finds the final level."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    s = (sizes.withColumn("sid", F.row_number().over(by_name).cast("long") - 1).withColumn("weight", w)
         .withColumn("cap", F.col("source_size") * float(max_epochs))
         .withColumn("budget", F.sum("source_size").over(every) * budget))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    s = (s.withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("weight_left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
         .withColumn("capped", F.col("left") * F.col("weight") >= F.col("cap") * F.col("weight_left")))
    level = F.max(F.when(~F.col("capped"), F.struct(-F.col("cap") / F.col("weight"), -F.col("sid"), F.col("left") / F.col("weight_left")).cast("struct<a:double,b:long,level:double>"))).over(every)["level"]
    return (s.withColumn("level", level)
            .withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight"))))
            .select("sid", "source", "source_size", "weight", "target"))


def slot_schedule(sources: DataFrame, block_words: int) -> DataFrame:
    """One row per used slot i of the schedule, with the block it takes."""
    spark = sources.sparkSession
    total = sources.agg(F.sum("n_slots")).first()[0] or 0
    k = max(1, (int(total) - 1).bit_length())
    cell_shift = max(0, k - CELL_BITS)
    chunk_shift = (k + 1) // 2
    cells = (sources.filter("n_slots > 0")
             .withColumn("cell", F.explode(F.sequence(F.shiftright("first", cell_shift), F.shiftright(F.col("first") + F.col("n_slots") - 1, cell_shift)))))
    point = F.conv(F.reverse(F.lpad(F.bin("i"), k, "0")), 2, 10).cast("long")
    slots = (spark.range(1 << k).withColumnRenamed("id", "i").withColumn("x", point)
             .withColumn("cell", F.shiftright("x", cell_shift))
             .join(cells, "cell").filter("x >= first and x < first + n_slots")
             .select("i", "sid", "source_size", "quota", "n_blocks", F.shiftright("i", chunk_shift).alias("chunk")))
    per_chunk = slots.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    base = per_chunk.select("sid", "chunk", F.coalesce(before, F.lit(0)).alias("base"))
    in_chunk = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("i"))
    b = F.lit(block_words)
    return (slots.withColumn("in_chunk", in_chunk).join(base, ["sid", "chunk"])
            .withColumn("rank", F.col("base") + F.col("in_chunk") - 1)
            .withColumn("epoch", F.when(F.col("rank") >= F.col("n_blocks"), 1).otherwise(0))
            .withColumn("block", F.col("rank") - F.col("epoch") * F.col("n_blocks"))
            .withColumn("words", F.least(b, F.col("source_size") - F.col("block") * b,
                                         F.col("quota") - F.col("epoch") * F.col("source_size") - F.col("block") * b))
            .select("i", "sid", "rank", "epoch", "block", "words"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET,
        max_epochs: int = MAX_EPOCHS, block_words: int = BLOCK_WORDS) -> Mix:
    """Mix ``docs`` (doc_id, text, source); ``max_epochs`` is 1 or 2."""
    if max_epochs not in (1, 2):
        raise ValueError("max_epochs is 1 or 2")
    d = pick(docs, doc_id="doc_id", source="source", text="text")
    narrow = store(with_uid(d.select(
        "doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("ord"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"))), "mix-sizes")
    b = F.lit(block_words)
    sources = source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, max_epochs)
    blocks = lambda n: F.ceil(n / b).cast("long")
    sources = (sources.withColumn("quota", F.floor("target").cast("long")).withColumn("n_blocks", blocks(F.col("source_size")))
               .withColumn("n_slots", F.when(F.col("quota") <= F.col("source_size"), blocks(F.col("quota")))
                           .otherwise(F.col("n_blocks") + blocks(F.col("quota") - F.col("source_size")))))
    up_to = F.sum("n_slots").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1))
    sources = store(sources.withColumn("first", F.coalesce(up_to, F.lit(0))), "mix-sources")
    schedule = slot_schedule(sources, block_words)

    rows = (narrow.join(sources.select(F.col("source").alias("source_"), "sid", "source_size", "target"),
                        narrow["source"].eqNullSafe(F.col("source_"))).drop("source_")
            .withColumn("bucket", F.substring("ord", 1, BUCKET_HEX)))
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    along = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("sid", "bucket", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "bucket").orderBy("ord", "crc", "size", "uid").rowsBetween(Window.unboundedPreceding, 0)
    rows = store(rows.withColumn("upto", F.sum("size").over(inside)).join(base, ["sid", "bucket"])
                 .withColumn("start", F.col("base") + F.col("upto") - F.col("size"))
                 .select("uid", "doc_id", "source", "size", "crc", "sid", "source_size", "target", "start"), "mix-streams")

    taken_of = lambda e: F.max(F.when(F.col("epoch") == e, F.col("words")).otherwise(0)).alias(f"w{e}")
    used = schedule.groupBy("sid", "block").agg(taken_of(0), taken_of(1))
    last = F.floor((F.col("start") + F.col("size") - 1) / b).cast("long")
    pieces = (rows.filter("size > 0").select("uid", "sid", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / b).cast("long"), last)).alias("block"))
              .join(used, ["sid", "block"]))
    lo = F.col("block") * b
    part = lambda w: F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), lo + F.col(w)) - F.greatest(F.col("start"), lo))
    taken = pieces.groupBy("uid").agg(F.sum(part("w0") + part("w1")).cast("long").alias("taken"))
    out = rows.join(taken, "uid", "left").select(
        "uid", "doc_id", "source", "size", "crc", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
    return Mix(out, sources, schedule)


def q_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).documents.select("doc_id", "size", "source_size", "target", "taken")


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mixed proportions: a document appears once for each
    pass the mix makes over it, rounded; repeated rows share their passes.

    Defined results: null and wordless texts go; a null source is a source;
    texts of any length are one document; ties go by id; an empty table stays
    empty; extra columns stay."""
    passes = F.sum("taken") / F.sum("size")
    times = (mix(docs).documents.filter("size > 0").groupBy("doc_id", "source", "crc", "size")
             .agg(F.floor(passes + 0.5).cast("int").alias("times")).filter("times > 0"))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id_"), F.col("source").alias("source_"), crc.alias("crc_"))
    on = F.col("id_").eqNullSafe(F.col("doc_id")) & F.col("source_").eqNullSafe(F.col("source")) & (F.col("crc_") == F.col("crc"))
    return rows.join(times, on).select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")


ORACLE_MIXING = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS ord,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), n AS (
  SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w,
         2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s
), r AS (
  SELECT a.source, a.source_size, a.w, a.cap,
         a.budget - coalesce(sum(c.cap) FILTER (c.cap / c.w < a.cap / a.w), 0) AS room,
         sum(c.w) FILTER (c.cap / c.w >= a.cap / a.w) AS w_room
  FROM n a CROSS JOIN n c GROUP BY a.source, a.source_size, a.w, a.cap, a.budget
), lv AS (
  SELECT arg_min(room / w_room, cap / w) AS lvl FROM r WHERE room * w < cap * w_room
), t AS (
  SELECT source, source_size, CASE WHEN room * w >= cap * w_room THEN cap ELSE least(cap, lvl * w) END AS target
  FROM r LEFT JOIN lv ON true
), p AS (
  SELECT d.*, t.source_size, t.target, floor(t.target)::BIGINT AS quota,
         (sum(size) OVER (PARTITION BY d.source ORDER BY ord ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS a
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(a + size, least(quota, source_size)) - a)
        + greatest(0, least(a + size, quota - source_size) - a))::BIGINT AS taken
FROM p
"""
