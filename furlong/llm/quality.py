"""Quality classifier by positive-unlabelled learning (operator 3).

Each text becomes ``len(FEATURES)`` numbers (shares of characters, words,
lines and repeats) in one pass over its bytes; everything else works on those.
The classifier is an additive model over quantile bins of the features. It is
fitted on trusted positives and unlabelled web text only, by the non-negative
risk: with class prior ``p`` and the sigmoid loss ``l(z) = 1 / (1 + e^z)``,

    p * E_pos[l(z)] + |N|,   N = E_unl[l(-z)] - p * E_pos[l(-z)]

which is the unbiased risk where N, the negatives' part, is not below zero, and
steps back along N where it is; |N| is rounded at zero, so that the risk has a
gradient everywhere. A bounded loss is what keeps a prior that is a little high
from undoing the negatives. The unlabelled set is all text to learn from, whatever its
label, as its prior is the one that scores are to be calibrated to.

Fitting covers all rows to learn from, with no sample: quantiles come from
counts by the features' leading bits, and each step of the descent (limited
memory quasi-Newton) is one Spark pass that sums ``len(FEATURES) * BINS + 1``
gradients and the losses. Only such sums reach the driver. At most ``ROUNDS``
steps are made; more only sharpen the fit.

The prior is estimated first: a positive-against-unlabelled classifier is
fitted to half of the rows, by the logistic loss, whose least risk is a ratio of
densities, and the least ratio of the two shares above a
score, over the scores of the other half, bounds the prior.

Defined results: null and empty texts have zero features and are scored like
any other; a null or unlabelled quality is unlabelled, a document labelled
both ways is not a positive; without positives every score is 0; repeated rows
are scored alike; very long texts are read whole; ties in a feature fall into
one bin; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm import bytesops as B
from furlong.llm.common import pick, read_table, store

FEATURES = ("log_bytes", "log_words", "bytes_per_word", "upper", "digits", "stops", "marks", "not_ascii", "space", "words_per_line", "distinct_words",
            "top_word", "distinct_pairs", "distinct_lines", "words_without_letter", "words_capital", "words_upper", "words_marked", "long_words")
BINS = 24
ROUNDS = 60
HOLD_OUT = (3, 1)
RIDGE = 1e-3
ROUNDING = 1e-3  # of |N|
LEADING = 44  # bits of a double that the counts for quantiles leave out: 256 values from one power of two to the next
SCORE_BINS = 4096

_CELLS = len(FEATURES) * BINS

_WORD = ~B.byte_class((0x09, 0x0D), (0x20, 0x20))
_LINE = ~B.byte_class((0x0A, 0x0A))
_UPPER, _LOWER, _DIGIT = B.byte_class((65, 90)), B.byte_class((97, 122)), B.byte_class((48, 57))
_STOP = B.byte_class(*((c, c) for c in b".,;:'\"()?-"))
_MARK = B.byte_class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)) & ~_STOP
_HIGH = B.byte_class((0x80, 0xFF))
_LETTER = _UPPER | _LOWER | _HIGH


def _per_row(first: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sum of x over each row's items."""
    c = np.concatenate([[0], np.cumsum(x, dtype=np.float64)])
    return c[first[1:]] - c[first[:-1]]


def _kinds(first: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values in each row, and the count of the most frequent."""
    n = len(first) - 1
    if not len(h):
        return np.zeros(n), np.zeros(n)
    row = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((h, row))
    new = np.flatnonzero(np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])]))
    size = np.diff(np.concatenate([new, [len(h)]]))
    most = np.zeros(n)
    np.maximum.at(most, row[order][new], size)
    return np.bincount(row[order][new], minlength=n).astype(float), most


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text of a slice."""
    size = np.diff(offs).astype(np.float64)
    share = lambda table: _per_row(offs, table[data]) / np.maximum(size, 1)
    sums = B.prefix(B.LOWER[data])
    ws, we, wf = B.words(data, offs, _WORD)
    ls, le, lf = B.words(data, offs, _LINE)
    n = np.diff(wf).astype(np.float64)
    some = np.maximum(n, 1)
    h = B.span(sums, ws, we)
    kinds, most = _kinds(wf, h)
    last = np.zeros(len(h), bool)
    last[wf[1:][np.diff(wf) > 0] - 1] = True
    pair = B.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[~last[:-1]] if len(h) else h
    pf = np.concatenate([[0], np.cumsum(np.maximum(n - 1, 0))]).astype(np.int64)
    pairs, _ = _kinds(pf, pair)
    lines, _ = _kinds(lf, B.span(sums, ls, le))
    n_lines = np.diff(lf).astype(np.float64)
    inside = lambda table: (c := np.concatenate([[0], np.cumsum(table[data])]))[we] - c[ws]
    letters, uppers = inside(_LETTER), inside(_UPPER)
    of_words = lambda x: _per_row(wf, x) / some
    out = [np.log1p(size), np.log1p(n), _per_row(wf, we - ws) / some, share(_UPPER), share(_DIGIT), share(_STOP), share(_MARK), share(_HIGH), share(~_WORD),
           n / np.maximum(n_lines, 1), kinds / some, most / some, pairs / np.maximum(n - 1, 1), lines / np.maximum(n_lines, 1), of_words(letters == 0),
           of_words(_UPPER[data[ws]]), of_words((uppers > 1) & (uppers >= letters - 1)), of_words(inside(_MARK) > 0), of_words(we - ws > 18)]
    return np.stack(out, 1)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [features(data, offs) for _, _, data, offs in B.slices(batch.column("text"))]
        flat = np.concatenate(x or [np.zeros((0, len(FEATURES)))]).ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(FEATURES)), pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "x"])


@dataclass
class Scorer:
    edges: np.ndarray  # inner edges of the bins, by feature
    weight: np.ndarray  # by feature and bin
    bias: float
    prior: float

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Flat index of each feature's bin."""
        return np.stack([np.searchsorted(e, x[:, k], "right") + k * BINS for k, e in enumerate(self.edges)], 1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.weight.ravel()[self.cells(x)].sum(axis=1) + self.bias


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def _leading_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by feature and leading bits, whose order is the numbers' own: features are never negative."""
    for batch in batches:
        code = np.ascontiguousarray(_matrix(batch.column("x"))).view(np.int64) >> LEADING
        for k in range(code.shape[1]):
            v, n = np.unique(code[:, k], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)), pa.array(v), pa.array(n.astype(np.int64))], names=["k", "code", "n"])


def quantile_edges(rows: DataFrame) -> np.ndarray:
    """Inner edges of each feature's bins over all rows of ``rows`` (x)."""
    counts = rows.select("x").mapInArrow(_leading_bits, "k int, code long, n long").groupBy("k", "code").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((len(FEATURES), BINS - 1))
    for k, c in counts.sort_values("code").groupby("k"):
        upto = np.cumsum(c["n"].to_numpy(np.int64))
        at = np.searchsorted(upto, upto[-1] * np.arange(1, BINS) / BINS)
        out[k] = (c["code"].to_numpy(np.int64)[at] << LEADING).view(np.float64)
    return out


def _to_cells(edges: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"))
            bins = np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)], 1).astype(np.uint8)
            cells = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, bins.size + 1, len(FEATURES), dtype=np.int32)), pa.py_buffer(bins.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), cells], names=["doc_id", "cells"])
    return run


def _sums(rows: DataFrame, of_batch, width: int) -> np.ndarray:
    """Sum over all rows of what ``of_batch`` makes of (flat cell indices, trusted)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(width)
        for batch in batches:
            data, _ = B.buffers(batch.column("cells"))
            idx = data.reshape(-1, len(FEATURES)) + np.arange(0, _CELLS, BINS)
            out += of_batch(idx, batch.column("trusted").to_numpy(zero_copy_only=False).astype(bool))
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(out[at])], names=["at", "v"])

    out = np.zeros(width)
    for r in rows.select("cells", "trusted").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out


def _loss_sums(w: np.ndarray, bounded: bool):
    """For all rows and for the trusted: rows, sum of l(-z), and its gradient."""
    def of_batch(idx: np.ndarray, trusted: np.ndarray) -> np.ndarray:
        z = w[idx].sum(axis=1) + w[-1]
        p = _sigmoid(z)
        loss, slope = (p, p * (1 - p)) if bounded else (np.logaddexp(0, z), p)
        out = []
        for some in (slice(None), trusted):
            g = slope[some]
            out += [[len(g), loss[some].sum()], np.bincount(idx[some].ravel(), np.repeat(g, idx.shape[1]), _CELLS), [g.sum()]]
        return np.concatenate(out)
    return of_batch


def _cell_counts(idx: np.ndarray, trusted: np.ndarray) -> np.ndarray:
    return np.append(np.bincount(idx[trusted].ravel(), minlength=_CELLS), trusted.sum()).astype(float)


class Risk:
    """The non-negative risk over ``rows`` (cells, trusted), with the sigmoid (``bounded``) or the logistic loss. Every call is one pass."""

    def __init__(self, rows: DataFrame, prior: float, bounded: bool):
        self.rows, self.prior, self.bounded = rows, prior, bounded
        counts = _sums(rows, _cell_counts, _CELLS + 1)
        self.positives = counts[-1]
        self.share = counts / max(self.positives, 1)  # of positives by cell

    def parts(self, w: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray]:
        """p * E_pos[l(z)] and N, with their gradients."""
        sums = _sums(self.rows, _loss_sums(w, self.bounded), 2 * (_CELLS + 3)).reshape(2, -1)
        (unl, of_unl), (pos, of_pos) = ((s[1] / max(s[0], 1), s[2:] / max(s[0], 1)) for s in sums)
        good, of_good = (1 - pos, -of_pos) if self.bounded else (pos - self.share @ w, of_pos - self.share)  # l(z) from l(-z)
        p = self.prior
        return p * good, p * of_good, unl - p * pos, of_unl - p * of_pos

    def __call__(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        good, of_good, n, of_n = self.parts(w)
        size = np.hypot(n, ROUNDING)
        return good + size + RIDGE / 2 * w @ w, of_good + n / size * of_n + RIDGE * w


def minimise(risk, w: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of least risk, by limited-memory quasi-Newton steps that each lower it."""
    f, g = risk(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, kept = -g, []
        for s, y in reversed(past):
            a = (s @ d) / (s @ y)
            kept.append(a)
            d = d - a * y
        if past:
            s, y = past[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(kept), strict=True):
            d = d + (a - (y @ d) / (s @ y)) * s
        step = 1.0 if past else 1 / max(np.abs(g).max(), 1e-12)
        while True:
            then, of_then = risk(w + step * d)
            if then <= f + 1e-4 * step * (g @ d):
                break
            step /= 4
            if step < 1e-6:
                return w
        if step * np.abs(d).max() < 1e-4:
            return w + step * d
        if (of_then - g) @ d > 0:
            past = [*past, (step * d, of_then - g)][-10:]
        w, f, g = w + step * d, then, of_then
    return w


def estimate_prior(rows: DataFrame) -> float:
    """Share of positives among the unlabelled, from ``rows`` (cells, trusted, half)."""
    risk = Risk(rows.filter("half = 0"), 0.5, bounded=False)
    if not risk.positives:
        return 0.5
    w = minimise(risk, np.zeros(_CELLS + 1))

    def by_score(idx: np.ndarray, trusted: np.ndarray) -> np.ndarray:
        at = np.minimum((_sigmoid(w[idx].sum(axis=1) + w[-1]) * SCORE_BINS).astype(np.int64), SCORE_BINS - 1)
        return np.concatenate([np.bincount(at, minlength=SCORE_BINS), np.bincount(at[trusted], minlength=SCORE_BINS)]).astype(float)

    su, sp = _sums(rows.filter("half = 1"), by_score, 2 * SCORE_BINS).reshape(2, -1)
    if not sp.sum():
        return 0.5
    qu, qp = (np.cumsum(s[::-1])[::-1] / s.sum() for s in (su, sp))
    slack = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(sp.sum()) + 1 / np.sqrt(su.sum()))
    best = int(np.argmin((qu + slack) / np.maximum(qp, 1e-9)))
    return float(np.clip(qu[best] / max(qp[best], 1e-9), 0.01, 0.99))


def fit(rows: DataFrame, trusted: DataFrame) -> Scorer | None:
    """From features ``rows`` (doc_id, x) and the distinct ids of positives among them."""
    edges = quantile_edges(rows)
    kind = rows.schema["doc_id"].dataType.simpleString()
    cells = rows.select("doc_id", "x").mapInArrow(_to_cells(edges), f"doc_id {kind}, cells binary").join(trusted.withColumn("yes", F.lit(True)), "doc_id", "left")
    cells = store(cells.select("cells", F.col("yes").isNotNull().alias("trusted"), F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half")), "quality-cells")
    if cells.filter("trusted").isEmpty():
        return None
    prior = estimate_prior(cells)
    w = minimise(Risk(cells, prior, bounded=True), np.zeros(_CELLS + 1))
    return Scorer(edges, w[:-1].reshape(len(FEATURES), BINS), float(w[-1]), prior)


def held_out(doc_id):
    """Null ids are checksummed as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % HOLD_OUT[0] == HOLD_OUT[1]


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out and score of ``docs`` (doc_id, text), learnt from ``labels`` (doc_id, quality)."""
    d = pick(docs, doc_id="doc_id", text="text")
    kind = d.schema["doc_id"].dataType.simpleString()
    x = store(d.mapInArrow(_extract, f"doc_id {kind}, x array<double>"), "quality-features").withColumn("held_out", held_out(F.col("doc_id")))
    trusted = pick(labels, doc_id="doc_id", quality="quality").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")
    learn = x.filter(~F.col("held_out"))
    model = x.sparkSession.sparkContext.broadcast(fit(learn, trusted))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            v = _matrix(batch.column("x"))
            p = _sigmoid(m.logit(v)) if m is not None else np.zeros(len(v))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p)], names=["doc_id", "held_out", "score"])

    return x.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double")


def q_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
