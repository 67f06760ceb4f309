"""Target-distribution importance resampling (operator 13).

Texts are lower-cased (A-Z only) and every run of separators becomes a single
space. One overlapped scan with word-boundary lookarounds then matches at each
word start: its groups are the words of the longest n-gram there, and the CRC
is carried on from group to group, so every span of 1 to ``SIZE`` words is
counted straight from the scan. A text is kept as the counts of its buckets.

Bucket counts of the whole corpus and of the target set, ``BUCKETS`` rows
each, give the log-ratio gains; a text's weight is the floored mean gain of
its features. A Gumbel draw of the id makes the score, and the highest scores
are drawn. Ranks are exact: rows are dealt by range of (score, id), numbered
inside each range, and the sizes of the ranges, one figure a partition, say
where each begins, so no window covers the table and ties split like any rows.

Defined results: null, empty and wordless texts have no features, weight 0
and are never drawn; a very long text is scanned in chunks of ``CHUNK``
word starts; ties go to the smaller id, null ids last; a null id is hashed as
empty text; repeated rows count each time and are ranked one after the other;
an empty table gives an empty result, an empty target set gains that only
reflect the corpus; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm import bytesops as B
from furlong.llm.common import pick, read_table, store, with_uid

SIZE = 2
BUCKETS = 10_000
SEED = 7
LEAST_WORDS = 20
PERCENT = 25
CHUNK = 1 << 16
_ROW_BITS = 33  # of monotonically_increasing_id, below the partition

#: Every byte that is no part of a word becomes a space.
_SPACED = bytes(32 if c < 0x30 or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))


def span_pattern(size: int) -> regex.Pattern:
    """Matches at each word start; group k is the k-th word with the space before it."""
    more = b""
    for _ in range(size - 1):
        more = rb"(?:( [^ ]+)" + more + rb")?"
    return regex.compile(rb"(?<![^ ])([^ ]+)" + more + rb"(?![^ ])")


def feature_crcs(text: bytes, spans: regex.Pattern) -> Iterator[np.ndarray]:
    """Checksums of all spans of a text, in chunks."""
    found = spans.finditer(b" ".join(text.lower().translate(_SPACED).split()), overlapped=True)
    groups = range(1, spans.groups + 1)
    while True:
        out: list[int] = []
        add = out.append
        for m in islice(found, CHUNK):
            crc = 0
            for word in m.group(*groups) if spans.groups > 1 else m.groups():
                if word is None:
                    break
                crc = crc32(word, crc)
                add(crc)
        if not out:
            return
        yield np.array(out, np.int64)


def count_features(text: bytes, spans: regex.Pattern, buckets: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Features of a text, its buckets and how often each occurs."""
    n, bucket, times = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part in feature_crcs(text, spans):
        n += len(part)
        b, t = np.unique(part % buckets, return_counts=True)
        if len(bucket):
            bucket, at = np.unique(np.concatenate([bucket, b]), return_inverse=True)
            times = np.bincount(at, np.concatenate([times, t]), len(bucket)).astype(np.int64)
        else:
            bucket, times = b, t
    return n, bucket, times


def words_of(features: int, size: int) -> int:
    """Words of a text with so many features: n words have n + (n - 1) + ... runs."""
    short = size * (size + 1) // 2
    if features >= short:
        return (features + size * (size - 1) // 2) // size
    n = 0
    while n * (n + 1) // 2 < features:
        n += 1
    return n


def hashed_features(docs: DataFrame, size: int = SIZE, buckets: int = BUCKETS) -> DataFrame:
    """Stored uid, doc_id, n_words, n_features, bucket, times of ``docs`` (doc_id, text)."""
    d = with_uid(pick(docs, doc_id="doc_id", text="text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = span_pattern(size)
        for batch in batches:
            for i, j, data, offs in B.slices(batch.column("text")):
                found = [count_features(data[a:b].tobytes(), spans, buckets) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                ends = pa.array(np.concatenate([[0], np.cumsum([len(f[1]) for f in found])]).astype(np.int32))
                flat = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([f[k] for f in found]).astype(np.int32))) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("uid").slice(i, j - i), batch.column("doc_id").slice(i, j - i), pa.array([words_of(f[0], size) for f in found], pa.int64()),
                     pa.array([f[0] for f in found], pa.int64()), *flat],
                    names=["uid", "doc_id", "n_words", "n_features", "bucket", "times"])

    kind = d.schema["doc_id"].dataType.simpleString()
    return store(d.mapInArrow(run, f"uid long, doc_id {kind}, n_words long, n_features long, bucket array<int>, times array<int>"), "hashed-features")


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs: ``buckets`` numbers, summed in tasks first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(total, batch.column("bucket").flatten().to_numpy(), batch.column("times").flatten().to_numpy())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["bucket", "n"])

    rows = features.select("bucket", "times").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the smoothed log ratio of each bucket, floored."""
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    k, n_s, n_t = len(s), float(int(corpus.sum()) + len(s)), float(int(target.sum()) + len(s))
    assert len(t) == k
    return np.floor(1000 * np.log(((t + 1) * n_s) / ((s + 1) * n_t))).astype(np.int64)


def weigh(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """Column ``weight`` in place of the buckets: the floored mean gain."""
    shared = features.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, n = batch.column("bucket"), batch.column("n_features").to_numpy()
            each = shared.value[lists.flatten().to_numpy()] * batch.column("times").flatten().to_numpy()
            sums = np.concatenate([[0], np.cumsum(each)])
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            weight = (sums[ends[1:]] - sums[ends[:-1]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("uid", "doc_id", "n_words", "n_features")), pa.array(weight)], names=["uid", "doc_id", "n_words", "n_features", "weight"])

    kind = features.schema["doc_id"].dataType.simpleString()
    return features.mapInArrow(run, f"uid long, doc_id {kind}, n_words long, n_features long, weight long")


def gumbel(doc_id, seed: int = SEED):
    """1000 times a Gumbel draw that only the id decides, floored."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def number_in_order(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Column ``name``: 1, 2, 3... in the given order over all rows."""
    spark = rows.sparkSession
    at = F.monotonically_increasing_id()
    dealt = store(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", at), "numbered")
    part = F.shiftright("at_", _ROW_BITS)
    first, begins = 1, []
    for r in dealt.groupBy(part.alias("part_")).agg(F.count(F.lit(1)).alias("n")).orderBy("part_").collect():
        begins.append((r.part_, first))
        first += r.n
    starts = spark.createDataFrame(begins, "part_ long, first_ long")
    nth = F.col("first_") + F.col("at_").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return dealt.withColumn("part_", part).join(F.broadcast(starts), "part_").withColumn(name, nth).drop("part_", "at_", "first_")


def resample(docs: DataFrame, target: DataFrame, size: int = SIZE, buckets: int = BUCKETS, seed: int = SEED,
             least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null: not drawn) of
    ``docs`` (doc_id, text), towards ``target`` (item_id, text)."""
    f = hashed_features(docs, size, buckets)
    t = hashed_features(pick(target, doc_id="item_id", text="text"), size, buckets)
    scored = weigh(f, gains(bucket_counts(f, buckets), bucket_counts(t, buckets)))
    scored = store(scored.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("out", F.col("n_words") < least_words), "scored")
    draw = percent * scored.filter(~F.col("out")).count() // 100
    ranked = number_in_order(scored, [F.col("out"), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight"), F.col("uid")], "nth")
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("nth") <= draw, F.col("nth")).cast("long").alias("rank"))


def drawn_documents(docs: DataFrame, ranks: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id was drawn, with all their columns."""
    return docs.join(ranks.filter("rank IS NOT NULL").select(F.col("doc_id").alias("drawn_id")), F.col("doc_id") == F.col("drawn_id"), "left_semi")


def q_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: The features by SQL word lists, their checksums by SQL bit operations. 3988292384 is the polynomial of CRC-32.
ORACLE_IMPORTANCE = f"""
WITH texts AS (
  SELECT 'd' AS side, row_number() OVER () AS rid, doc_id AS id, text FROM documents
  UNION ALL SELECT 't', row_number() OVER (), item_id, text FROM benchmark
), worded AS (
  SELECT side, rid, id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM texts
), runs AS (
  SELECT side, rid, unnest(w) AS f FROM worded
  UNION ALL
  SELECT side, rid, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2])) FROM worded WHERE len(w) > 1
), counted AS (
  SELECT side, rid, f, count(*) AS times FROM runs GROUP BY ALL
), step AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))
), hashed AS (
  SELECT f, xor(list_reduce(list_transform(range(octet_length(encode(f))), lambda k: CAST('0x' || substr(hex(encode(f)), CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT)),
                            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT DISTINCT f FROM counted), step
), bucketed AS (
  SELECT side, rid, bucket, sum(times) AS times FROM counted JOIN hashed USING (f) GROUP BY ALL
), tally AS (
  SELECT b.bucket, coalesce(sum(times) FILTER (side = 'd'), 0) AS s, coalesce(sum(times) FILTER (side = 't'), 0) AS t
  FROM range({BUCKETS}) b(bucket) LEFT JOIN bucketed USING (bucket) GROUP BY ALL
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t + 1 AS DOUBLE) * CAST(sum(s) OVER () + {BUCKETS} AS DOUBLE)) / (CAST(s + 1 AS DOUBLE) * CAST(sum(t) OVER () + {BUCKETS} AS DOUBLE)))) AS HUGEINT) AS g
  FROM tally
), weighed AS (
  SELECT rid, CAST(sum(times) AS BIGINT) AS n, CAST(sum(times * g) AS BIGINT) AS total FROM bucketed JOIN gain USING (bucket) WHERE side = 'd' GROUP BY rid
), scored AS (
  SELECT rid, id AS doc_id, len(w) AS words, coalesce(n, 0) AS n_features,
         CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight,
         CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS g
  FROM worded LEFT JOIN weighed USING (rid) WHERE side = 'd'
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY words >= {LEAST_WORDS} ORDER BY weight + g DESC, doc_id NULLS LAST, n_features, weight, rid) AS nth,
         count(*) OVER (PARTITION BY words >= {LEAST_WORDS}) AS among
  FROM scored
)
SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(weight + g AS BIGINT) AS score,
       CASE WHEN words >= {LEAST_WORDS} AND nth <= {PERCENT} * among // 100 THEN nth END AS rank
FROM ranked
"""
