"""Repeated passages by an enhanced suffix array (operator 7).

A byte is removed if it lies in a string of ``LEAST`` bytes that starts
anywhere else too. Suffixes are gathered where they can meet:

1. Anchors. Every window of ``LEAST`` bytes names the first of its smallest
   hashed ``SEED`` byte seeds; equal windows name equal seeds. About one byte
   in sixty is an anchor.
2. Counts of anchors by seed, and by seed and context (the bytes that any
   window around the anchor can cover). A seed met once rules its windows out;
   a context met twice proves all of its windows repeated. Neither needs more
   than aggregates, so copies cost a hash and a count each.
3. Only around the edges of repeats is text moved: for a seed with several
   contexts, the stretch of windows that name the anchor, once per context
   that is itself repeated and once per anchor otherwise, goes to the seed.
4. There, windows that are equal form the top intervals of the suffix array.
   Those whose left neighbours all agree are part of a longer repeat further
   left; the others are sorted by their bytes, the array of common prefixes is
   scanned with a stack, and each interval of the common-prefix tree whose
   occurrences differ in the byte to their left is put out with those
   occurrences that were sent.

A seed of more than ``HOT`` stretches is not gathered in one task. Its windows
are counted by their hash in Spark, with the smallest and largest byte to
their left; only the windows of groups that vary there are cut out, sorted by
hash and bytes, and read as a stream that keeps places but no bytes.

``Repeats.groups`` has the repeats of step 4, with all their occurrences: where
one sample was sent for a repeated context, its copies are joined to the group
again. It is not the list of all maximal repeats: texts that step 2 settles
(exact copies, the inside of long passages) have no group, and a length ends
with the stretch, after ``2 * LEAST - SEED`` bytes.

The texts are read twice, and found the second time by id and text: an input
may come in another order, but its rows must be the same.

Step 2's equality, and the prefilter of step 4, are by 64-bit hashes; the
repeats of step 4 are compared byte by byte.

Defined results: a null text is empty; repeated rows are separate texts, so
each is removed wholly if it has ``LEAST`` bytes; very long texts are cut into
slices inside a task but matched whole; of equal hashes the first place stands
for the others; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm import bytesops as B
from furlong.llm.common import pick, read_table, store, with_uid

LEAST = 200
SEED = 64
CHUNK = 1 << 14  # windows sorted at once
HOT = 1 << 12  # stretches of a seed that one task compares
BATCH = 1 << 16  # rows put out at once
ALONE, EDGE, INNER, SAMPLE = 0, 1, 2, 3  # an anchor's seed or context: met once; context met once; context repeated; its chosen one
SPANS = "array<struct<start:int,end:int>>"
GROUPS = "seed long, length int, first_uid long, first_start int, uid long, start int"  # a group: length and first place


@dataclass
class Repeats:
    documents: DataFrame  # uid, doc_id, n_bytes, n_removed, n_spans, kept_sha256
    groups: DataFrame  # GROUPS: the repeats of step 4, each with all its occurrences; worked out when read


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over each run of w."""
    n = 1
    while n * 2 <= w:
        x = f(x[:-n], x[n:])
        n *= 2
    return f(x[: len(x) - (w - n)], x[w - n :]) if w > n else x


class Anchors:
    """Seeds, windows and anchors of one text of ``least`` bytes or more."""

    def __init__(self, data: np.ndarray, least: int, seed: int) -> None:
        self.width = least - seed + 1  # seeds in a window
        self.sums = B.prefix(data)
        at = np.arange(len(data) - seed + 1)
        self.hash = B.span(self.sums, at, at + seed)
        self.low = _slide(self.hash, self.width, np.minimum)
        edge = np.zeros(self.width - 1, np.uint64)
        self.pos = np.flatnonzero(_slide(np.concatenate([edge, self.low, edge]), self.width, np.maximum) == self.hash)
        lo, hi = np.maximum(0, self.pos - (least - seed)), np.minimum(len(data), self.pos + least)
        self.seed = self.hash[self.pos]
        self.context = B.mix(B.span(self.sums, lo, hi) + ((self.pos - lo) * (2 * least) + (hi - self.pos)).astype(np.uint64))

    def named(self) -> np.ndarray:
        """The anchor (an index into pos) that each window names."""
        at = np.searchsorted(self.pos, np.arange(len(self.low)))
        todo = np.flatnonzero(self.seed[at] != self.low)
        while len(todo):
            at[todo] += 1
            todo = todo[self.seed[at[todo]] != self.low[todo]]
        return at


def _runs(on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of True."""
    step = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _find_anchors(least: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = B.buffers(batch.column("text"))
            sizes, digests, ends, seeds, contexts, places = np.diff(offs), [], [0], [], [], []
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                digests.append(hashlib.sha256(data[a:b]).hexdigest())
                if b - a >= least:
                    x = Anchors(data[a:b], least, seed)
                    seeds.append(x.seed)
                    contexts.append(x.context)
                    places.append(x.pos.astype(np.int32))
                ends.append(ends[-1] + (len(places[-1]) if b - a >= least else 0))
            cat = lambda x, t: pa.array(B.signed(np.concatenate(x)) if t == 64 else np.concatenate(x)) if x else pa.array([], pa.int64() if t == 64 else pa.int32())
            found = pa.StructArray.from_arrays([cat(places, 32), cat(seeds, 64), cat(contexts, 64)], names=["pos", "seed", "context"])
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), batch.column("k_text"), pa.array(sizes), pa.array(digests, pa.string()),
                                              pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)], names=["uid", "doc_id", "k_text", "n_bytes", "sha256", "anchors"])
    return run


def _cut_pieces(least: int, seed: int):
    """Spans proved by contexts, and the stretches of windows to compare."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    piece = pa.struct([("seed", pa.int64()), ("start", pa.int32()), ("before", pa.bool_()), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = B.buffers(batch.column("text"))
            spans, pieces = [], []
            for r, marks in enumerate(batch.column("marks").to_pylist()):
                text = data[offs[r] : offs[r + 1]]
                x = Anchors(text, least, seed)
                kind = np.zeros(len(x.pos), np.int8)
                kind[np.searchsorted(x.pos, np.fromiter((m["pos"] for m in marks), np.int64, len(marks)))] = [m["kind"] for m in marks]
                n = len(x.low)
                inner = np.zeros(len(text) + 1, np.int32)
                inner[x.pos[kind >= INNER] + 1] = 1
                inner = np.cumsum(inner)
                windows = np.arange(n)
                a, b = _runs(inner[windows + x.width] > inner[windows])
                spans.append([{"start": s, "end": e} for s, e in zip(a.tolist(), (b - 1 + least).tolist(), strict=True)])
                of = x.named()
                on = (kind[of] == EDGE) | (kind[of] == SAMPLE)
                out = []
                a, b = _runs(on)
                for s, e in zip(a.tolist(), b.tolist(), strict=True):
                    cuts = [s, *(np.flatnonzero(of[s + 1 : e] != of[s : e - 1]) + s + 1).tolist(), e]
                    for s0, s1 in zip(cuts[:-1], cuts[1:], strict=True):
                        # the byte before the stretch comes along, if there is one
                        out.append({"seed": int(x.seed[of[s0]].view(np.int64)), "start": s0, "before": s0 > 0, "body": text[max(0, s0 - 1) : s1 - 1 + least].tobytes()})
                pieces.append(out)
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(spans, pa.list_(span)), pa.array(pieces, pa.list_(piece))], names=["uid", "spans", "pieces"])
    return run


def lcp_intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of each interval of the common-prefix tree with a
    length of ``least`` or more; lcp[k] is of the suffixes k and k + 1."""
    stack: list[tuple[int, int]] = []  # length, first suffix
    for k, length in enumerate([*lcp.tolist(), 0]):
        first = k
        while stack and stack[-1][0] > length:
            at, first = stack.pop()
            yield at, first, k
        if length >= least and (not stack or stack[-1][0] < length):
            stack.append((length, first))


def maximal_repeats(rows: np.ndarray, room: np.ndarray, left: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, occurrences) of maximal repeats among suffixes. rows: a matrix of
    their bytes; room: how many of them are theirs; left: the byte before, or a
    number below 0 that is theirs alone."""
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")
    rows, room, left = rows[order], room[order], left[order]
    differ = rows[1:] != rows[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    lcp = np.minimum(lcp, np.minimum(room[1:], room[:-1]))
    turns = np.concatenate([[0], np.cumsum(left[1:] != left[:-1])])
    for length, a, b in lcp_intervals(lcp, least):
        if turns[b] > turns[a]:
            yield length, order[a : b + 1]


def _first(uid: np.ndarray, start: np.ndarray) -> tuple[int, int]:
    low = uid.min()
    return int(low), int(start[uid == low].min())


def _grouped(found: list[tuple]) -> pa.RecordBatch:
    """Rows of GROUPS from (seed, length, uids, starts, first place or None for the first of these)."""
    n = [len(x[2]) for x in found]
    first = [x[4] or _first(x[2], x[3]) for x in found]
    each = lambda values, kind: pa.array(np.repeat(np.array(values, kind), n))
    return pa.RecordBatch.from_arrays([each([x[0] for x in found], np.int64), each([x[1] for x in found], np.int32), each([f[0] for f in first], np.int64), each([f[1] for f in first], np.int32),
                                       pa.array(np.concatenate([x[2] for x in found])), pa.array(np.concatenate([x[3] for x in found]).astype(np.int32))],
                                      names=["seed", "length", "first_uid", "first_start", "uid", "start"])


def _compare(least: int, seed: int):
    reach = 2 * least - seed  # longest body

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in B.whole_groups(batches, ["seed"]):
            uid, start, before, seeds = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("uid", "start", "before", "seed"))
            data, offs = B.buffers(table.column("body").combine_chunks())
            sizes = np.diff(offs)
            lone = np.repeat(np.diff(begins) == 1, np.diff(begins))
            n = np.where(lone, 0, sizes - before - least + 1)  # windows of each piece
            piece = np.repeat(np.arange(len(n)), n)
            nth = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
            at = offs[:-1][piece] + before[piece] + nth
            out: list[tuple] = []
            if len(at):
                sums = B.prefix(data)
                same = B.span(sums, at, at + least)
                order = np.argsort(same, kind="stable")
                at, piece, nth, same = at[order], piece[order], nth[order], same[order]
                left = np.where((nth > 0) | before[piece], data[at - 1].astype(np.int64), -1 - np.arange(len(at)))
                first = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
                size = np.diff(np.concatenate([first, [len(at)]]))
                # a stretch's first window may go on to the left in another piece: it counts as a beginning
                own = np.where(nth == 0, -1 - np.arange(len(at)), left)
                varied = np.maximum.reduceat(own, first) != np.minimum.reduceat(own, first)
                use = np.flatnonzero(np.repeat((size > 1) & varied, size))
                edges = np.concatenate([[0], np.cumsum(size[(size > 1) & varied])])
                padded = np.concatenate([data, np.zeros(reach, np.uint8)])
                i = 0
                while i < len(edges) - 1:
                    j = max(i + 1, int(np.searchsorted(edges, edges[i] + CHUNK, "right")) - 1)
                    w = use[edges[i] : edges[j]]
                    rows = padded[at[w][:, None] + np.arange(reach)]
                    room = offs[1:][piece[w]] - at[w]
                    rows[np.arange(reach) >= room[:, None]] = 0
                    for length, group in maximal_repeats(rows, room, own[w], least):
                        g = w[group]
                        out.append((seeds[piece[g[0]]], length, uid[piece[g]], start[piece[g]] + nth[g], None))
                    i = j
            if out:
                yield _grouped(out)
    return run


def _windows(least: int):
    """The windows of stretches: their hash and the byte before (-1: none, or in another stretch)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                data, offs = B.buffers(batch.column("body"))
                before = batch.column("before").to_numpy(zero_copy_only=False)
                n = np.diff(offs) - before - least + 1
                piece = np.repeat(np.arange(len(n)), n)
                nth = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
                at = offs[:-1][piece] + before[piece] + nth
                same = B.span(B.prefix(data), at, at + least)
                prior = np.where(nth > 0, data[at - 1].astype(np.int32), -1).astype(np.int32)
                take = pa.array(piece)
                yield pa.RecordBatch.from_arrays([batch.column("seed").take(take), batch.column("uid").take(take), batch.column("start").take(take), pa.array(nth.astype(np.int32)),
                                                  pa.array(B.signed(same)), pa.array(prior)], names=["seed", "uid", "start", "nth", "same", "prior"])
    return run


def _scan_suffixes(least: int, seed: int):
    """Maximal repeats among suffixes sorted by (seed, same, body)."""
    reach = 2 * least - seed  # longest body

    def found(parts: list[tuple]) -> Iterator[tuple]:
        seeds, uid, start, prior, lcp = (np.concatenate(c) for c in zip(*parts, strict=True))
        left = np.where(prior < 0, -1 - np.arange(len(prior)), prior)
        turns = np.concatenate([[0], np.cumsum(left[1:] != left[:-1])])
        for length, a, b in lcp_intervals(lcp[1:], least):
            if turns[b] > turns[a]:
                first = _first(uid[a : b + 1], start[a : b + 1])
                for i in range(a, b + 1, BATCH):
                    j = min(b + 1, i + BATCH)
                    yield int(seeds[0]), length, uid[i:j], start[i:j], first

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last_key, last_row, last_room, held = None, np.zeros((1, reach), np.uint8), 0, []
        for batch in batches:
            if not batch.num_rows:
                continue
            seeds, same, uid, start, prior = (batch.column(c).to_numpy() for c in ("seed", "same", "uid", "start", "prior"))
            data, offs = B.buffers(batch.column("body"))
            room = np.diff(offs)
            rows = np.concatenate([data, np.zeros(reach, np.uint8)])[offs[:-1][:, None] + np.arange(reach)]
            rows[np.arange(reach) >= room[:, None]] = 0
            rows, room = np.concatenate([last_row, rows]), np.concatenate([[last_room], room])
            differ = rows[1:] != rows[:-1]
            lcp = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), reach), np.minimum(room[1:], room[:-1]))
            new = np.flatnonzero((seeds[1:] != seeds[:-1]) | (same[1:] != same[:-1])) + 1
            if last_key != (seeds[0], same[0]):
                new = np.concatenate([[0], new])
            cuts = [0, *new.tolist(), len(seeds)]
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if k and held:
                    yield from found(held)
                    held = []
                if b > a:
                    held.append((seeds[a:b], uid[a:b], start[a:b], prior[a:b], lcp[a:b]))
            last_key, last_row, last_room = (seeds[-1], same[-1]), rows[-1:], room[-1]
        if held:
            yield from found(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0

        for group in groups(batches):
            out.append(group)
            size += len(group[2])
            if size >= BATCH:
                yield _grouped(out)
                out, size = [], 0
        if out:
            yield _grouped(out)
    return run


def _hot_groups(pieces: DataFrame, least: int, seed: int) -> DataFrame:
    """As ``_compare`` of stretches, window group by window group."""
    windows = pieces.mapInArrow(_windows(least), "seed long, uid long, start int, nth int, same long, prior int")
    seen = windows.groupBy("seed", "same").agg(F.count(F.lit(1)).alias("n"), F.min("prior").alias("lo"), F.max("prior").alias("hi"))
    varied = store(seen.filter("n > 1 and (lo < hi or lo < 0)").select("seed", "same"), "repeat-varied")
    wanted = windows.join(varied, ["seed", "same"]).select("uid", "start", "nth", "same", "prior")
    suffixes = pieces.join(wanted, ["uid", "start"]).selectExpr("seed", "same", "uid", "start + nth AS start", "prior", "substring(body, int(before) + nth + 1, length(body)) AS body")
    return suffixes.repartition("seed", "same").sortWithinPartitions("seed", "same", "body").mapInArrow(_scan_suffixes(least, seed), GROUPS)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = B.buffers(batch.column("text"))
        removed, runs, digests = [], [], []
        for r, spans in enumerate(batch.column("spans").to_pylist()):
            text = data[offs[r] : offs[r + 1]]
            cover = np.zeros(len(text) + 1, np.int64)
            np.add.at(cover, [s["start"] for s in spans], 1)
            np.add.at(cover, [s["end"] for s in spans], -1)
            gone = np.cumsum(cover[:-1]) > 0
            removed.append(int(gone.sum()))
            runs.append(len(_runs(gone)[0]))
            digests.append(hashlib.sha256(text[~gone]).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())], names=["uid", "n_removed", "n_spans", "kept"])


def _all_occurrences(groups: DataFrame, met: DataFrame, least: int, seed: int) -> DataFrame:
    """The groups with every copy of a context of which one sample was sent. A
    stretch lies within the context of the anchor that its windows name, so what
    was found there stands in all of the context's copies, as far from the anchor."""
    near = groups.join(met.select("uid", "seed", "context", "pos"), ["uid", "seed"]).filter(F.col("pos").between(F.col("start"), F.col("start") + (least - seed)))
    keys = ["seed", "length", "first_uid", "first_start", "uid", "start"]
    named = near.groupBy(keys).agg(F.min(F.struct("pos", "context")).alias("anchor"))
    sent = named.select("seed", "length", "first_uid", "first_start", (F.col("anchor.pos") - F.col("start")).alias("ahead"), F.col("anchor.context").alias("context"))
    return sent.join(met.select("seed", "context", "uid", "pos"), ["seed", "context"]).select(*keys[:5], (F.col("pos") - F.col("ahead")).alias("start"))


def find_repeats(docs: DataFrame, least: int = LEAST, seed: int = SEED, hot: int = HOT) -> Repeats:
    """Remove repeated strings of ``least`` bytes from ``docs`` (doc_id, text)."""
    texts = with_uid(pick(docs, doc_id="doc_id", text="text")).withColumn("k_text", F.xxhash64("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    info = store(texts.mapInArrow(_find_anchors(least, seed), f"uid long, doc_id {kind}, k_text long, n_bytes long, sha256 string, anchors array<struct<pos:int,seed:long,context:long>>"), "repeat-anchors")
    anchors = info.select("uid", F.inline("anchors"))
    seeds = anchors.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), (F.min("context") != F.max("context")).alias("several")).filter("n > 1").select("seed", "several")
    met = store(anchors.join(seeds, "seed"), "repeat-seeds")
    contexts = met.groupBy("seed", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("uid", "pos")).alias("first"))
    chosen = F.col("several") & (F.struct("uid", "pos") == F.col("first"))
    marked = met.join(contexts, ["seed", "context"]).select("uid", "pos", F.when(F.col("n") == 1, EDGE).when(chosen, SAMPLE).otherwise(INNER).cast("byte").alias("kind"))
    marks = store(marked.groupBy("uid").agg(F.collect_list(F.struct("pos", "kind")).alias("marks")).join(info.select("uid", "doc_id", "k_text"), "uid"), "repeat-marks")
    # a second read may number the texts otherwise, so they are found by id and text
    k_doc = F.xxhash64("doc_id").alias("k_doc")  # not null, so that the join keeps the partitions of dropDuplicates
    again = texts.select(k_doc, "k_text", "text").dropDuplicates(["k_doc", "k_text"])
    with_marks = store(again.join(marks.select("uid", k_doc, "k_text", "marks"), ["k_doc", "k_text"]).select("uid", "text", "marks"), "repeat-texts")
    if with_marks.count() != marks.count():
        raise RuntimeError("the documents changed between two reads")
    cut = store(with_marks.mapInArrow(_cut_pieces(least, seed), f"uid long, spans {SPANS}, pieces array<struct<seed:long,start:int,before:boolean,body:binary>>"), "repeat-pieces")
    pieces = cut.select("uid", F.inline("pieces"))
    crowded = store(cut.select(F.explode("pieces.seed").alias("seed")).groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("seed"), "repeat-hot")
    some = not crowded.isEmpty()
    calm = (pieces.join(crowded, "seed", "left_anti") if some else pieces).select("uid", "seed", "start", "before", "body")
    groups = store(calm.repartition("seed").sortWithinPartitions("seed").mapInArrow(_compare(least, seed), GROUPS), "repeat-groups")
    if some:
        groups = groups.unionByName(store(_hot_groups(pieces.join(crowded, "seed", "left_semi"), least, seed), "repeat-hot-groups"))
    edges = groups.groupBy("uid", "start").agg(F.max("length").alias("length")).groupBy("uid").agg(
        F.collect_list(F.struct("start", (F.col("start") + F.col("length")).alias("end"))).alias("more"))
    spans = cut.select("uid", "spans").join(edges, "uid", "left").select("uid", F.concat("spans", F.coalesce("more", F.array().cast(SPANS))).alias("spans")).filter(F.size("spans") > 0)
    left = with_marks.select("uid", "text").join(spans, "uid").mapInArrow(_remove, "uid long, n_removed long, n_spans long, kept string")
    none = F.lit(0).cast("long")
    out = info.select("uid", "doc_id", "n_bytes", "sha256").join(left, "uid", "left").select(
        "uid", "doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept", "sha256").alias("kept_sha256"))
    return Repeats(out, _all_occurrences(groups, met, least, seed))


def q_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repeats(read_table(spark, sf_dir, "documents")).documents.drop("uid")


#: Every window of every text, its digest counted; kept bytes are put together as hexadecimal text.
ORACLE_REPEATS = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents
), w AS (
  SELECT rid, s, md5(array_slice(b, s, s + {LEAST} - 1)) AS h
  FROM d, LATERAL (SELECT unnest(range(1, CAST(octet_length(b) AS BIGINT) - {LEAST} + 2)) AS s) r
), met AS (
  SELECT rid, s, s - lag(s) OVER (PARTITION BY rid ORDER BY s) > {LEAST} AS apart
  FROM w SEMI JOIN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) t USING (h)
), run AS (
  SELECT rid, s, sum(CAST(coalesce(apart, true) AS INTEGER)) OVER (PARTITION BY rid ORDER BY s) AS k FROM met
), span AS (
  SELECT rid, min(s) AS a, max(s) + {LEAST} - 1 AS z FROM run GROUP BY rid, k
), gap AS (
  SELECT rid, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) + 1 AS x, a - 1 AS y FROM span
  UNION ALL SELECT rid, coalesce(max(z), 0) + 1, any_value(octet_length(b)) FROM d LEFT JOIN span USING (rid) GROUP BY rid
), kept AS (
  SELECT rid, string_agg(CASE WHEN y >= x THEN hex(array_slice(b, x, y)) ELSE '' END, '' ORDER BY x) AS body FROM gap JOIN d USING (rid) GROUP BY rid
), lost AS (
  SELECT rid, sum(z - a + 1) AS n, count(*) AS k FROM span GROUP BY rid
)
SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(k, 0) AS n_spans, sha256(unhex(body)) AS kept_sha256
FROM d JOIN kept USING (rid) LEFT JOIN lost USING (rid)
"""
