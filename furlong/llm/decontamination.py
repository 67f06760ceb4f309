"""Benchmark decontamination by a prefix-filtered set join (operator 1).

An item's windows are its runs of ``WINDOW`` words; a window is a set of word
shingles (three words, or all of a shorter window). Shingles are ordered by
rarity, their count over all documents. Containment of a whole window needs
every shingle of it, so its prefix is one shingle, the rarest. Documents are
probed for prefix shingles only; the position of a hit, the window's length
and the document's length bound where the window could lie, and the words
around the hit are compared with the window's words one by one.

Two fixed-size bit tables (``BITS`` bits) are all that is broadcast: they tell
which shingles may matter, whatever the size of the benchmark. Hits carry at
most 17 words, never a document. Equal windows of several items are one
window; equal items are matched once.

Defined results: null or wordless texts have no words and no hits, null or
wordless items have no windows; an item with a null id marks words but is not
listed; repeated rows are judged separately; very long texts are read whole;
shingles that are equally rare are ordered by their hash, which decides what is
joined but not what is hit; extra columns are not read; empty tables give no
hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm import bytesops as B
from furlong.llm.common import pick, read_table, store, with_uid

WINDOW = 10
SHINGLE = 3
BITS = 22
WORD = B.byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
_ODD = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


@dataclass
class Contamination:
    documents: DataFrame  # uid, doc_id, k_text, n_words, n_hit, n_items, items
    hits: DataFrame  # uid, start, length, window


class Shingles:
    """Words of a slice and the hashes of its shingles of k words."""

    def __init__(self, data: np.ndarray, offs: np.ndarray) -> None:
        self.data = B.LOWER[data]
        self.start, self.end, self.first = B.words(self.data, offs, WORD)
        p = B.prefix(self.data)
        self.hash = B.span(p, self.start, self.end)

    def of(self, k: int) -> np.ndarray:
        """Hash at each word; 0 where k words do not fit into the row."""
        n = len(self.hash)
        out = np.zeros(n, np.uint64)
        if n >= k:
            g = np.full(n - k + 1, np.uint64(k))
            for j in range(k):
                g += self.hash[j : n - k + 1 + j] * _ODD[j]
            out[: n - k + 1] = B.mix(g)
        for j in range(1, k):
            ends = self.first[1:] - j
            ends = ends[(ends >= self.first[:-1]) & (ends >= 0)]
            out[ends] = 0
        return out

    def text(self, a: int, b: int) -> str:
        return b" ".join([self.data[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b], strict=True)]).decode("utf-8", "replace")


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        rows: list[tuple] = []
        for i, j, data, offs in B.slices(batch.column(1)):
            s = Shingles(data, offs)
            by_k = {k: B.signed(s.of(k)) for k in range(1, SHINGLE + 1)}
            for r in range(j - i):
                a, b = int(s.first[r]), int(s.first[r + 1])
                size = min(WINDOW, b - a)
                k = min(SHINGLE, size)
                for w in range(a, b - size + 1) if size else ():
                    rows.append((ids[i + r], s.text(w, w + size), size, k, by_k[k][w : w + size - k + 1].tolist()))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()),
                                          pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.list_(pa.int64()))],
                                         names=["item_id", "window", "length", "k", "shingles"])


def bit_table(hashes: DataFrame) -> np.ndarray:
    """Packed table of ``2**BITS`` bits, of the column g; at most 2**BITS / 64
    rows reach the driver."""
    at = hashes.select(F.shiftrightunsigned("g", 64 - BITS).alias("at"))
    rows = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 AS int)))").alias("b")).collect()
    table = np.zeros(1 << (BITS - 6), np.int64)
    for r in rows:
        table[r.w] = r.b
    return table


def _unpack(table: np.ndarray) -> np.ndarray:
    return np.unpackbits(table.view(np.uint8), bitorder="little").view(bool)


def _counter(bits, ks: list[int]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _unpack(bits.value)
        for batch in batches:
            seen = []
            for _, _, data, offs in B.slices(batch.column(0)):
                s = Shingles(data, offs)
                for k in ks:
                    g = s.of(k)
                    seen.append(g[table[g >> np.uint64(64 - BITS)] & (g != 0)])
            g, n = np.unique(np.concatenate(seen or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(B.signed(g)), pa.array(n.astype(np.int64))], names=["g", "n"])
    return count


def _prober(bits, ks: list[int]):
    kind = pa.struct([("g", pa.int64()), ("pos", pa.int32()), ("left", pa.int32()), ("words", pa.string())])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _unpack(bits.value)
        for batch in batches:
            n_words, per_row, found = [], [], []
            for _, _, data, offs in B.slices(batch.column("text")):
                s = Shingles(data, offs)
                n_words.append(np.diff(s.first))
                hits = [(np.flatnonzero(table[(g := s.of(k)) >> np.uint64(64 - BITS)] & (g != 0)), g, k) for k in ks]
                at = np.concatenate([h[0] for h in hits]) if hits else np.zeros(0, np.int64)
                g = np.concatenate([x[h] for h, x, _ in hits]) if hits else np.zeros(0, np.uint64)
                reach = np.concatenate([np.full(len(h), k) for h, _, k in hits]) if hits else at
                order = np.argsort(at, kind="stable")
                at, g, reach = at[order], g[order], reach[order]
                row = np.searchsorted(s.first, at, "right") - 1
                lo = np.maximum(s.first[row], at - (WINDOW - reach))
                hi = np.minimum(s.first[row + 1], at + WINDOW)
                short = reach < SHINGLE  # such a shingle is its window
                lo, hi = np.where(short, at, lo), np.where(short, at + reach, hi)
                per_row.append(np.bincount(row, minlength=len(offs) - 1))
                found += zip(B.signed(g).tolist(), (at - s.first[row]).tolist(), (at - lo).tolist(), map(s.text, lo.tolist(), hi.tolist()), strict=True)
            ends = np.concatenate([[0], np.concatenate(per_row).cumsum()]) if per_row else np.zeros(1)
            cols = list(zip(*found, strict=True)) or [[]] * 4
            items = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kind, strict=True)], fields=list(kind))
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), batch.column("doc_id"), batch.column("k_text"), pa.array(np.concatenate(n_words or [np.zeros(0)]).astype(np.int64)),
                 pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), items)],
                names=["uid", "doc_id", "k_text", "n_words", "found"])
    return probe


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> Contamination:
    """Mark the words of ``docs`` (doc_id, text) inside windows of ``benchmark`` (item_id, text)."""
    spark = docs.sparkSession
    d = pick(docs, doc_id="doc_id", text="text")
    items = pick(benchmark, item_id="item_id", text="text").withColumn("item_id", F.col("item_id").cast("string"))
    listed = store(items.mapInArrow(_windows, "item_id string, window string, length int, k int, shingles array<long>"), "bench-windows")
    windows = listed.groupBy("window", "length", "k").agg(F.first("shingles").alias("shingles"))
    ks = sorted(r.k for r in listed.select("k").distinct().collect())
    bits = spark.sparkContext.broadcast(bit_table(listed.select(F.explode("shingles").alias("g"))))
    counts = d.select("text").mapInArrow(_counter(bits, ks), "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    # a window with an uncounted shingle occurs nowhere
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g", "off")).alias("p")
    prefixes = store(windows.select("window", "length", F.posexplode("shingles").alias("off", "g")).join(counts, "g", "left")
                     .groupBy("window", "length").agg(rarest).filter("p.n > 0")
                     .select("p.g", "p.off", "length", "window"), "bench-prefixes")
    chosen = spark.sparkContext.broadcast(bit_table(prefixes.select("g")))
    probed = with_uid(d).withColumn("k_text", F.xxhash64("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    probed = store(probed.mapInArrow(_prober(chosen, ks), f"uid long, doc_id {kind}, k_text long, n_words long, found array<struct<g:long,pos:int,left:int,words:string>>"), "bench-probed")

    at = F.col("pos") - F.col("off")
    here = F.array_join(F.slice(F.split("words", " "), F.greatest(F.col("left") - F.col("off") + 1, F.lit(1)), F.col("length")), " ")
    found = probed.select("uid", "n_words", F.inline("found"))
    hits = store(found.join(prefixes, "g").filter((at >= 0) & (at + F.col("length") <= F.col("n_words")) & (here == F.col("window")))
                 .select("uid", at.cast("long").alias("start"), F.col("length").cast("long").alias("length"), "window"), "bench-hits")
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], acc["upto"]))).alias("n"),
                                F.greatest(acc["upto"], x["end"]).alias("upto")), lambda acc: acc["n"])
    n_hit = hits.groupBy("uid").agg(covered.alias("n_hit"))
    owners = listed.select("window", "item_id").distinct()
    by_doc = hits.select("uid", "window").distinct().join(owners, "window").groupBy("uid").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = (probed.select("uid", "doc_id", "k_text", "n_words").join(n_hit, "uid", "left").join(by_doc, "uid", "left")
           .withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))
           .withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
           .withColumn("n_items", F.size("items").cast("long")))
    return Contamination(out, hits)


def q_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).documents
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with no word inside a benchmark window.

    Defined results: null and wordless texts stay; there are no ties; repeated rows are judged alike; texts of any
    length are read whole; an empty table stays empty; extra columns stay.
    """
    bad = (decontaminate(docs, read_table(spark, sf_dir, "benchmark")).documents.filter("n_hit > 0")
           .select(F.col("doc_id").alias("bad_id"), F.col("k_text").alias("bad_text")).distinct())
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id_"), F.xxhash64("text").alias("text_"))
    return rows.join(bad, F.col("id_").eqNullSafe(F.col("bad_id")) & (F.col("text_") == F.col("bad_text")), "left_anti").select("row.*")


ORACLE_DECONTAMINATION = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), item_window AS (
  SELECT DISTINCT item, least(10, len(w)) AS size, w[k : k + least(10, len(w)) - 1] AS words
  FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k) r WHERE len(w) > 0
), doc_window AS (
  SELECT rid, size, k, w[k : k + size - 1] AS words
  FROM d, (SELECT DISTINCT size FROM item_window) z, LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS k) r
), hit AS (
  SELECT rid, k, x.size, item FROM doc_window x JOIN item_window i ON x.words = i.words
), marked AS (
  SELECT rid, count(DISTINCT p) AS n FROM hit, LATERAL (SELECT unnest(range(k, k + size)) AS p) r GROUP BY rid
), listed AS (
  SELECT rid, list_sort(list(DISTINCT item)) AS items FROM hit GROUP BY rid
)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
       sha256(array_to_string(coalesce(items, []), ',')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (rid) LEFT JOIN listed USING (rid)
"""
