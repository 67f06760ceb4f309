"""Sharding by fixed virtual slots (operator 2).

A record's virtual slot is a hash of its content modulo ``n_slots``; it never
changes, whatever the number of shards. Bytes are aggregated per slot and a slot-to-shard map, stored as a
versioned table, says where each slot lives. Rebalancing edits the map and
leaves the records' slots alone. The law held is ``bytes``: slots go largest
first to the lightest shard, so shard sizes end up within one small slot of
each other.

Records that are equal in id, checksum and size are numbered 1, 2, 3..., and
the number is part of what is hashed, so any number of them spreads over the
slots. The numbers are given without a window over all of them: rows are
numbered inside each task's share, and the shares' sizes say where each begins.

The map has at most ``n_slots`` rows, a fixed bound, and is the only thing
that reaches the driver or is broadcast. Positions inside a shard are slot
offsets plus a row number inside the slot, so no window covers a whole shard.

Defined results: a null text has size 1 and checksum 0; null ids are hashed as
such; repeated rows are separate records and tie in any order, as they are
equal; very long texts count their bytes like any other and are not moved; extra
columns are not read; an empty table gives no rows and an empty map.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furlong.llm.common import octets, pick, read_table, store, with_uid
from furlong.session import scratch_path

N_SLOTS = 4096
_ROW_BITS = 33  # of a row number, below the partition that gave it
MAP_SCHEMA = "vslot int, shard int, bytes long, rows long, start long, version int"


def number_equals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Column ``nth``: 1, 2, 3... among the stored rows that are equal in ``keys``."""
    share = F.shiftright("uid", _ROW_BITS).alias("share")
    inside = F.row_number().over(Window.partitionBy(*keys, "share").orderBy("uid"))
    sizes = rows.groupBy(*keys, share).agg(F.count(F.lit(1)).alias("in_share"))
    before = F.sum("in_share").over(Window.partitionBy(*keys).orderBy("share").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn("before", F.coalesce(before, F.lit(0)))
    same = [F.col(f"rows.{k}").eqNullSafe(F.col(f"starts.{k}")) for k in [*keys, "share"]]
    numbered = rows.withColumn("share", share).withColumn("inside", inside).alias("rows")
    # only a key's later shares have anything before them
    return (numbered.join(starts.filter("before > 0").alias("starts"), same, "left")
            .select("rows.*", (F.col("inside") + F.coalesce("before", F.lit(0))).alias("nth")).drop("share", "inside"))


def record_slots(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """Stored narrow records: uid, doc_id, size, text_crc32, vslot."""
    d = pick(docs, doc_id="doc_id", text="text")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    d = store(with_uid(d.select("doc_id", (octets(F.col("text")) + 1).alias("size"), crc.alias("text_crc32"))), "shard-rows")
    slot = F.pmod(F.xxhash64("doc_id", "text_crc32", "size", "nth"), F.lit(n_slots)).cast("int")
    return store(number_equals(d, ["doc_id", "text_crc32", "size"]).withColumn("vslot", slot).drop("nth"), "shard-records")


def slot_sizes(records: DataFrame) -> list[tuple[int, int, int]]:
    """(vslot, bytes, rows): at most ``n_slots`` rows."""
    rows = records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
    return sorted((r.vslot, r.bytes, r.rows) for r in rows)


def place(sizes: list[tuple[int, int, int]], n_shards: int) -> dict[int, int]:
    """Largest slot first to the lightest shard."""
    heap = [(0, s) for s in range(n_shards)]
    to = {}
    for slot, size, _ in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(heap)
        to[slot] = s
        heapq.heappush(heap, (load + size, s))
    return to


def rebalance(sizes: list[tuple[int, int, int]], to: dict[int, int], n_shards: int) -> dict[int, int]:
    """Edit a map for ``n_shards``: slots of shards that are gone and of shards
    above the mean move, largest that fits first; all others stay."""
    bytes_of = {s: b for s, b, _ in sizes}
    mean = sum(bytes_of.values()) / n_shards
    load = dict.fromkeys(range(n_shards), 0)
    stay: dict[int, int] = {}
    moving = []
    for slot in sorted(bytes_of, key=lambda s: (-bytes_of[s], s)):
        s = to.get(slot, n_shards)
        if s < n_shards and load[s] + bytes_of[slot] <= mean:
            stay[slot] = s
            load[s] += bytes_of[slot]
        else:
            moving.append(slot)
    heap = [(b, s) for s, b in load.items()]
    heapq.heapify(heap)
    for slot in moving:
        b, s = heapq.heappop(heap)
        stay[slot] = s
        heapq.heappush(heap, (b + bytes_of[slot], s))
    return stay


def map_table(spark: SparkSession, sizes: list[tuple[int, int, int]], to: dict[int, int], version: int) -> DataFrame:
    """The map as a table; ``start`` is the slot's first position in its shard."""
    at: dict[int, int] = {}
    rows = []
    for slot, size, n in sizes:
        s = to[slot]
        rows.append((slot, s, size, n, at.get(s, 0), version))
        at[s] = at.get(s, 0) + n
    return spark.createDataFrame(rows, MAP_SCHEMA)


def write_map(table: DataFrame, path: str, version: int) -> None:
    """Each version is its own folder, so an edit never touches an older one."""
    table.coalesce(1).write.parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/version={version}").withColumn("version", F.lit(version))


def shard(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """Rows doc_id, size, text_crc32, shard, slot (position in the shard) and
    virtual_slot; version 1 of the map is written to ``map_path``."""
    spark = docs.sparkSession
    records = record_slots(docs, n_slots)
    sizes = slot_sizes(records)
    path = map_path or scratch_path(spark, "llm", f"slot-map-{uuid.uuid4().hex[:12]}")
    write_map(map_table(spark, sizes, place(sizes, n_shards), 1), path, 1)
    slots = F.broadcast(read_map(spark, path, 1).select("vslot", "shard", "start"))
    within = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size", "uid"))
    return (records.withColumn("nth", within).join(slots, "vslot")
            .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"),
                    F.col("vslot").alias("virtual_slot")))


def digest(shards: DataFrame) -> DataFrame:
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def q_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(shard(read_table(spark, sf_dir, "documents")))


def stage_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digest of :func:`shard` for all documents, with its defined results."""
    return digest(shard(docs))
