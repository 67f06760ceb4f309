"""Language identification by prediction by partial matching (operator 5).

For each language a context tree over bytes is counted from all of its
training texts: orders 3 to 0, the lower orders being sums of the highest.
Escapes follow method C: in a context seen ``n`` times with ``d`` different
next bytes, a byte seen ``c`` times costs ``-log2(c / (n + d))`` bits and an
escape to the next shorter context ``-log2(d / (n + d))``; contexts never seen
are skipped for nothing, and below order 0 every byte costs 8 bits. Scoring
never changes the counts: a text's code length under a language is the exact
sum over its bytes, and the shortest code wins.

Tasks add up their own counts before the shuffle; the trees keep every gram
met and are built by Spark as tables: of each order the codes met by any
language with their bits by language, and the contexts with the bits to leave
them. A byte's bits need one row of such a table, or the context's row and the
shorter code, so the tables are cut by ranges of codes into parts of at most
``MODEL_CELLS`` cells, or of one two-byte prefix, whose 65,536 codes bound it.
Each part is a broadcast of its own and passes the driver by itself. Where
there are several, a task holds one at a time, the longest order first, and
keeps the bits of each text so far and the order in which each byte is still
to be looked up. Orders 1 and 0 have 65,536 rows and go with the last part.

Defined results: null texts and texts without a letter are ``und`` with score
0; with nothing to learn from, all are; ties go to the first language in code
point order; repeated rows are scored alike; very long texts are read whole;
extra columns stay beside the result; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong.llm import bytesops as B
from furlong.llm.common import read_table, store

ORDER = 3
PAD = 0x0A
SURE = 0.9
HOLD_OUT = (5, 0)
UNKNOWN = "und"
MODEL_CELLS = 1 << 24
LOWEST = 1  # the order of the last table, which has all codes
PREFIX = 16  # bits of a code below those that parts are cut at
FLUSH = 1 << 20
SLICE = 1 << 19  # a score takes some 60 bytes a byte of text


def grams(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """At each byte the code of the three bytes before it and itself; a text starts after ``PAD`` bytes."""
    sizes = np.diff(offs)
    padded = np.full(len(data) + ORDER * len(sizes), PAD, np.uint32)
    at = np.arange(len(data)) + np.repeat(np.arange(ORDER, ORDER * (len(sizes) + 1), ORDER), sizes)
    padded[at] = data
    code = padded.copy()
    for k in range(1, ORDER + 1):
        code[k:] |= padded[:-k] << np.uint32(8 * k)
    return code[at]


def _add_up(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names: dict[str, int] = {}
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def flushed() -> pa.RecordBatch:
        keys, n = _add_up(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        langs = pa.array(list(names), pa.string())
        return pa.RecordBatch.from_arrays([langs.take(pa.array((keys >> np.uint64(32)).astype(np.int64))), pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    for batch in batches:
        which = np.array([names.setdefault(x, len(names)) for x in batch.column("lang").to_pylist()], np.uint64)
        for i, j, data, offs in B.slices(batch.column("text"), SLICE):
            keys = grams(data, offs) | (np.repeat(which[i:j], np.diff(offs)) << np.uint64(32))
            keys, n = np.unique(keys, return_counts=True)
            parts.append((keys, n.astype(np.int64)))
            held += len(keys)
            if held > FLUSH:
                parts = [_add_up(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))]
                held = len(parts[0][0])
                if held > FLUSH // 2:
                    yield flushed()
                    parts, held = [], 0
    if parts:
        yield flushed()


@dataclass
class Level:
    """A range of codes of one order; a code holds a context and the byte after it."""
    order: int
    first: int
    last: int
    keys: np.ndarray
    bits: np.ndarray  # by key and language
    contexts: np.ndarray
    leave: np.ndarray  # bits to leave a context, by language

    def look(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits by code and language, and the places of codes not met: their bits only leave the context."""
        if not len(self.keys):
            return np.zeros((len(code), self.bits.shape[1]), np.float32), np.arange(len(code))
        at = np.searchsorted(self.keys, code)
        at[at == len(self.keys)] = 0
        out = self.bits[at]
        new = np.flatnonzero(self.keys[at] != code)
        ctx = code[new] >> np.uint32(8)
        i = np.searchsorted(self.contexts, ctx)
        i[i == len(self.contexts)] = 0
        out[new] = np.where((self.contexts[i] == ctx)[:, None], self.leave[i], 0)
        return out, new


@dataclass
class Part:
    levels: list[Level]  # the longest order first
    lowest: np.ndarray | None  # bits of every two bytes, in the last part

    def add_bits(self, code: np.ndarray, order: np.ndarray) -> np.ndarray:
        """What this part adds to the bits of each byte by language. ``order``
        is the order that a byte is looked up in next (0: no more) and is
        brought up to date."""
        out = None
        for level in self.levels:
            if out is None and level.order == ORDER and level.last - level.first == (1 << 8 * (ORDER + 1)) - 1:
                out, new = level.look(code)
                order[:] = 0
                order[new] = ORDER - 1
                continue
            out = np.zeros((len(code), level.bits.shape[1]), np.float32) if out is None else out
            low = code & np.uint32((1 << 8 * (level.order + 1)) - 1)
            at = np.flatnonzero((order == level.order) & (low >= level.first) & (low <= level.last))
            bits, new = level.look(low[at])
            out[at] += bits
            order[at] = 0
            order[at[new]] = level.order - 1
        if self.lowest is not None:
            out = np.zeros((len(code), self.lowest.shape[1]), np.float32) if out is None else out
            at = np.flatnonzero(order == LOWEST)
            out[at] += self.lowest[code[at] & np.uint32(0xFFFF)]
            order[at] = 0
        return out


@dataclass
class Trained:
    langs: list[str]
    parts: list[Broadcast]  # of Part


def lowest_orders(lang: np.ndarray, code: np.ndarray, n: np.ndarray, n_langs: int) -> np.ndarray:
    """Bits of every two bytes by language, from the counts of those met."""
    met = np.zeros((n_langs, 256, 256))
    met.reshape(n_langs, -1)[lang, code] = n

    def cost(met: np.ndarray, below: np.ndarray | float) -> np.ndarray:
        total, kinds = met.sum(axis=-1, keepdims=True), (met > 0).sum(axis=-1, keepdims=True)
        room = np.maximum(total + kinds, 1)
        return np.where(met > 0, -np.log2(np.maximum(met, 1) / room), np.where(kinds > 0, -np.log2(np.maximum(kinds, 1) / room), 0) + below)

    one = cost(met, cost(met.sum(axis=1), 8.0)[:, None, :])
    return np.ascontiguousarray(one.reshape(n_langs, -1).T, np.float32)


def tree_level(counts: DataFrame, below: DataFrame, order: int, n_langs: int) -> tuple[DataFrame, DataFrame]:
    """Of the counts (k, code, n) of an order: code and bits by language, and
    code (of the context) and leave. ``below``: code and bits of the order
    below, of at least the codes met here without their first byte."""
    def by_language(entries, other):
        return F.transform(F.sequence(F.lit(0), F.lit(n_langs - 1)), lambda k: F.coalesce(F.try_element_at(entries, k), other(k)).cast("float"))

    ctx = F.shiftright("code", 8)
    context = Window.partitionBy("k", "ctx")  # of at most 256 codes
    room = F.col("total") + F.col("kinds")
    costs = counts.withColumn("ctx", ctx).select("k", "code", "n", F.sum("n").over(context).alias("total"), F.count(F.lit(1)).over(context).alias("kinds"))
    keys = costs.groupBy("code").agg(F.map_from_entries(F.collect_list(F.struct("k", -F.log2(F.col("n") / room)))).alias("met"))
    left = counts.groupBy("k", ctx.alias("ctx")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    contexts = left.groupBy("ctx").agg(F.map_from_entries(F.collect_list(F.struct("k", -F.log2(F.col("kinds") / room)))).alias("met"))
    contexts = store(contexts.select(F.col("ctx").alias("code"), by_language(F.col("met"), lambda k: F.lit(0.0)).alias("leave")), f"language-contexts-{order}")
    shorter = below.select(F.col("code").alias("short"), F.col("bits").alias("below"))
    joined = keys.withColumn("ctx", ctx).join(contexts.withColumnRenamed("code", "ctx"), "ctx").join(shorter, F.col("code").bitwiseAND((1 << 8 * order) - 1) == F.col("short"))
    bits = by_language(F.col("met"), lambda k: F.get("leave", k) + F.get("below", k))
    return store(joined.select("code", bits.alias("bits")), f"language-codes-{order}"), contexts


def cut_parts(sizes: list[tuple[int, int, int]], n_langs: int) -> list[list[tuple[int, int, int]]]:
    """Ranges (order, first, last) of codes by part, from the number of codes
    of each (order, prefix), sorted from the longest order. All codes of an order are covered."""
    out: list[list[tuple[int, int, int]]] = [[]]
    held = 0
    for order in range(ORDER, LOWEST, -1):
        mine = [x for x in sizes if x[0] == order] or [(order, 0, 0)]
        out[-1].append((order, 0, 0))
        for _, prefix, n in mine:
            if held and (held + n) * n_langs > MODEL_CELLS:
                at = prefix << PREFIX
                if out[-1][-1][1] < at:
                    out[-1][-1] = (order, out[-1][-1][1], at - 1)
                else:
                    out[-1].pop()
                out.append([(order, at, at)])
                held = 0
            held += n
        out[-1][-1] = (order, out[-1][-1][1], (1 << 8 * (order + 1)) - 1)
    return [x for x in out if x]


def _matrix(rows: DataFrame, value: str, n_langs: int) -> tuple[np.ndarray, np.ndarray]:
    table = rows.select("code", value).toArrow().combine_chunks()
    code = table.column("code").to_numpy().astype(np.uint32)
    held = table.column(value).combine_chunks()
    cells = held.flatten().to_numpy(zero_copy_only=False).reshape(-1, n_langs) if len(code) else np.zeros((0, n_langs), np.float32)
    order = np.argsort(code)
    return code[order], cells[order]


def train(docs: DataFrame) -> Trained | None:
    """Count all of ``docs`` (text, lang) with both not null."""
    spark = docs.sparkSession
    known = docs.select("lang", "text").filter("lang is not null and text is not null")
    # languages that have only empty texts have no grams
    langs = sorted(r.lang for r in known.select("lang").distinct().collect())
    if not langs:
        return None
    rows = known.mapInArrow(_count, "lang string, gram long, n long")
    k = (F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")) - 1).cast("int")
    counts = store(rows.groupBy("lang", "gram").agg(F.sum("n").alias("n")).select(k.alias("k"), F.col("gram").alias("code"), "n"), "language-grams")

    def shorter(counts: DataFrame, order: int) -> DataFrame:
        return counts.groupBy("k", F.col("code").bitwiseAND((1 << 8 * (order + 1)) - 1).alias("code")).agg(F.sum("n").alias("n"))

    by_order = {ORDER: counts}
    for order in range(ORDER - 1, LOWEST - 1, -1):
        by_order[order] = store(shorter(by_order[order + 1], order), f"language-grams-{order}")
    pairs = by_order[LOWEST].toArrow()
    lowest = lowest_orders(*(pairs.column(c).to_numpy() for c in ("k", "code", "n")), len(langs))
    bits = pa.FixedSizeListArray.from_arrays(pa.array(lowest.ravel()), len(langs)).cast(pa.list_(pa.float32()))
    below = spark.createDataFrame(pa.table({"code": pa.array(np.arange(len(lowest))), "bits": bits}), "code long, bits array<float>")
    tables = {}
    for order in range(LOWEST + 1, ORDER + 1):
        tables[order] = tree_level(by_order[order], below, order, len(langs))
        below = tables[order][0]
    sizes = [(order, r.prefix, r.n) for order in range(ORDER, LOWEST, -1)
             for r in tables[order][0].groupBy(F.shiftright("code", PREFIX).alias("prefix")).agg(F.count(F.lit(1)).alias("n")).orderBy("prefix").collect()]
    out = Trained(langs, [])
    cuts = cut_parts(sizes, len(langs))
    for i, ranges in enumerate(cuts):
        levels = []
        for order, first, last in ranges:
            codes, contexts = tables[order]
            levels.append(Level(order, first, last, *_matrix(codes.filter(F.col("code").between(first, last)), "bits", len(langs)),
                                *_matrix(contexts.filter(F.col("code").between(first >> 8, last >> 8)), "leave", len(langs))))
        out.parts.append(spark.sparkContext.broadcast(Part(levels, lowest if i == len(cuts) - 1 else None)))
    return out


def identify(docs: DataFrame, model: Trained | None) -> DataFrame:
    """lang_pred and score of each text of ``docs``, with its other columns as a
    struct ``row``; the text itself isn't sent back."""
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("row"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    langs, parts = (model.langs, model.parts) if model else ([], [])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letter = batch.column("letter").to_numpy(zero_copy_only=False) & (len(langs) > 0)
            bits = np.zeros((batch.num_rows, max(1, len(langs))))  # of each text so far
            orders: dict[int, np.ndarray] = {}  # by slice, where several parts need them
            for held in parts:
                part = held.value
                for i, _, data, offs in B.slices(batch.column("text"), SLICE):
                    full = np.flatnonzero(np.diff(offs))
                    if not len(full):
                        continue
                    order = orders[i] if i in orders else np.full(len(data), ORDER, np.int8)
                    bits[i + full] += np.add.reduceat(part.add_bits(grams(data, offs), order), offs[:-1][full], axis=0, dtype=np.float64)
                    if len(parts) > 1:
                        orders[i] = order
                del part
                if len(parts) > 1:
                    held.__dict__.pop("_value", None)  # read again from the worker's file for the next batch
            least = bits.min(axis=1)
            p = np.where(letter, 1 / np.exp2(least[:, None] - bits).sum(axis=1), 0)
            names = pa.array([*langs, UNKNOWN], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row"), names.take(pa.array(np.where(letter, bits.argmin(axis=1), len(langs)))), pa.array(p)], names=["row", "lang_pred", "score"])

    kind = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(score, kind)


def held_out(doc_id, n: int = HOLD_OUT[0], rest: int = HOLD_OUT[1]):
    """Null ids are checksummed as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n == rest


def q_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"))
    found = identify(docs.select("doc_id", "text"), train(docs.filter(~out)))
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, under that language: those without
    a letter go. A missing ``lang`` becomes the predicted one, and so does one
    that a prediction with a score of ``SURE`` or more contradicts.

    Defined results: nulls and empty texts go; texts of any length are read
    whole; repeated rows stay repeated; ties go to the first language by name;
    an empty table stays empty; extra columns stay as they are.
    """
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    keyed = docs.select(F.col("doc_id").alias("its_id"), F.xxhash64("text").alias("its_text"), F.col("lang").alias("its_lang"), "text")
    told, label = F.col("lang_pred"), F.col("row.its_lang")
    moved = (told == UNKNOWN) | label.isNull() | ((told != label) & (F.col("score") >= SURE))
    changes = store(identify(keyed, model).filter(moved).select("row.*", "lang_pred").distinct(), "relabelled")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id_"), F.xxhash64("text").alias("text_"))
    same = F.col("id_").eqNullSafe(F.col("its_id")) & (F.col("text_") == F.col("its_text")) & F.col("row.lang").eqNullSafe(F.col("its_lang"))
    met = rows.join(changes, same, "left").filter(told.isNull() | (told != UNKNOWN))
    return met.select(F.col("row").withField("lang", F.coalesce(told, F.col("row.lang"))).alias("row")).select("row.*")
