"""Embedding whitening by Chebyshev-filtered subspace iteration (operator 12).

Vectors become fixed-point integers; the fit list holds each distinct one
once. Its covariance is never formed: one distributed pass over the list
returns V Q for a block Q, as sums of centred products made in each task. A few
Lanczos passes bound the spectrum from below; then, round by round, the
Chebyshev recurrence over such passes damps everything under the block's last
Ritz value, QR makes the block orthonormal, and Rayleigh-Ritz turns it into
Ritz vectors. The wanted vectors are certified by their residuals
``|V u - e u|``, which must fall under ``CERTIFIED`` of the largest eigenvalue
and are then refined until they stop falling; else an error is raised. A block
as wide as the vectors is the whole space, and one pass is exact.

Only figures whose size is that of a vector times the block reach the driver.

Defined results: vectors that are null or hold null or non-finite components,
or components of more than 2**45 in size (their fixed point would not be exact
in a double), are left out; vectors shorter than the longest count as padded
with zeros, the empty one included; a component with eigenvalue zero (fewer
distinct vectors than components, constant data) can't be whitened and is not
returned; ``deviation`` is null where it does not fit a long; ties between
eigenvalues may turn the components within their space; repeated rows are
returned each, and count once in the fit; null ids are kept; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm.common import pick, read_table, store

SCALE = 256
COMPONENTS = 4
BLOCK = 32
DEGREE = 10
LANCZOS = 8
ROUNDS = 200
CERTIFIED = 1e-11
FINEST = 1e-15
LARGEST = 2.0**45
_STEEPEST = 27.0  # log of how much more a round may raise the first vector than the last


def fixed_point(vectors: DataFrame, scale: int = SCALE) -> tuple[DataFrame, int]:
    """Stored vec_id and x, all of one width, and the width."""
    v = pick(vectors, vec_id="vec_id", vec="embedding")
    sound = F.col("vec").isNotNull() & F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) <= LARGEST))
    v = v.filter(sound).select("vec_id", F.transform("vec", lambda c: F.floor(c.cast("double") * scale)).cast("array<long>").alias("x"))
    v = store(v, "fixed-point")
    least, width = v.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if least != width:
        v = v.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))))
    return v, width or 0


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def column_sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Rows and exact sums of the columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.arange(-1, width), pa.int32()), pa.array(np.concatenate([[rows], total]))], names=["j", "s"])
        total, rows, top = np.zeros(width, np.int64), 0, 0
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            for i in range(0, len(x), 256):
                part = x[i : i + 256]
                top = max(top, int(np.abs(part).max()))
                if rows and (rows + len(part)) * top >= 1 << 62:
                    yield out()
                    total, rows = np.zeros(width, np.int64), 0
                total += part.sum(axis=0)
                rows += len(part)
        if rows:
            yield out()

    sums = {r.j: int(r.s) for r in fit.select("x").mapInArrow(run, "j int, s long").groupBy("j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    return sums.get(-1, 0), [sums.get(j, 0) for j in range(width)]


class Covariance:
    """V of the fit list, known only by its products."""

    def __init__(self, fit: DataFrame, n: int, sums: list[int]) -> None:
        self.fit, self.n, self.width = fit, n, len(sums)
        self.mean = np.array([s / n for s in sums])
        self.trace = 0.0

    def _sums(self, task: Callable[[np.ndarray, np.ndarray], np.ndarray], q: np.ndarray, height: int) -> np.ndarray:
        """Sum over all rows of ``task(centred rows, q)``, of ``height`` rows,
        and of the squared lengths."""
        k, width = q.shape[1], self.width
        shared = self.fit.sparkSession.sparkContext.broadcast((q, self.mean))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, mean = shared.value
            total, squares = np.zeros((height, k)), 0.0
            for batch in batches:
                for i in range(0, batch.num_rows, 2048):
                    y = _matrix(batch.column("x").slice(i, 2048), width) - mean
                    total += task(y, block)
                    squares += float((y * y).sum())
            table = np.concatenate([np.full((1, k), squares), total])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, height), pa.int32()), *(pa.array(np.ascontiguousarray(c)) for c in table.T)], names=["j", *(f"q{i}" for i in range(k))])

        schema = ", ".join(["j int", *(f"q{i} double" for i in range(k))])
        rows = self.fit.select("x").mapInArrow(run, schema).groupBy("j").agg(*(F.sum(f"q{i}").alias(f"q{i}") for i in range(k))).collect()
        shared.destroy()
        out = np.zeros((height, k))
        for r in rows:
            if r.j < 0:
                self.trace = r.q0 / self.n
            else:
                out[r.j] = r[1:]
        return out / self.n

    def times(self, q: np.ndarray) -> np.ndarray:
        """V q, in one pass."""
        return self._sums(lambda y, b: y.T @ (y @ b), q, self.width)

    def within(self, q: np.ndarray) -> np.ndarray:
        """Covariance of the rows' projections on q, in one pass."""
        return self._sums(lambda y, b: (w := y @ b).T @ w, q, q.shape[1])


def least_eigenvalue(v: Covariance, rng: np.random.Generator) -> float:
    """A bound from below, by a few Lanczos steps."""
    q, last, beta, alphas, betas = rng.standard_normal(v.width), np.zeros(v.width), 0.0, [], []
    q /= np.linalg.norm(q)
    for _ in range(min(LANCZOS, v.width)):
        r = v.times(q[:, None])[:, 0] - beta * last
        alphas.append(float(r @ q))
        r -= alphas[-1] * q
        beta = float(np.linalg.norm(r))
        betas.append(beta)
        if beta <= 1e-12 * abs(alphas[0]):
            break
        last, q = q, r / beta
    ritz = np.linalg.eigvalsh(np.diag(alphas) + np.diag(betas[:-1], 1) + np.diag(betas[:-1], -1))
    return max(0.0, float(ritz[0]) - beta)


def chebyshev(v: Covariance, q: np.ndarray, vq: np.ndarray, low: float, high: float, top: float) -> np.ndarray:
    """The block after a filter that is small on [low, high]; ``vq`` is V q."""
    mid, half = (high + low) / 2, (high - low) / 2
    degree = int(np.clip(_STEEPEST / np.arccosh(max((top - mid) / half, 1 + 1e-9)), 1, DEGREE))
    before, now = q, (vq - mid * q) / half
    for _ in range(degree - 1):
        before, now = now, 2 / half * (v.times(now) - mid * now) - before
    return now / np.linalg.norm(now, axis=0)


def leading(v: Covariance, k: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of V, falling, and their unit eigenvectors as columns."""
    rng = np.random.default_rng(12)
    block = min(v.width, max(block, 2 * k))
    whole = block == v.width
    q = np.eye(block) if whole else np.linalg.qr(rng.standard_normal((v.width, block)))[0]
    low = 0.0 if whole else least_eigenvalue(v, rng)
    worst = np.inf
    for _ in range(ROUNDS):
        vq = v.times(q)
        h = q.T @ vq
        e, u = np.linalg.eigh((h + h.T) / 2)
        e, u = e[::-1], u[:, ::-1]
        q, vq = q @ u, vq @ u
        if whole or e[0] <= 0:
            return e[:k], q[:, :k]
        left = float(np.linalg.norm(vq[:, :k] - q[:, :k] * e[:k], axis=0).max() / e[0])
        if left <= FINEST or (left <= CERTIFIED and left > worst / 2):
            return e[:k], q[:, :k]
        worst = min(worst, left)
        high = max(e[-1], 1e-13 * e[0])
        q = np.linalg.qr(chebyshev(v, q, vq, min(low, high * (1 - 1e-3)), high, e[0]))[0]
    raise RuntimeError(f"the components are not certified after {ROUNDS} rounds: residual {worst:.1e} of the largest eigenvalue")


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error
    of ``vectors`` (vec_id, embedding)."""
    rows, width = fixed_point(vectors, scale)
    spark, kind = rows.sparkSession, rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not width:
        return spark.createDataFrame([], schema)
    fit = store(rows.select("x").distinct(), "fit-list")
    n, sums = column_sums(fit, width)
    v = Covariance(fit, n, sums)
    e, u = leading(v, min(components, width))
    good = e > 1e-13 * v.trace * width
    e, u = e[good], u[:, good]
    if not len(e):
        return spark.createDataFrame([], schema)
    u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(len(e))] < 0, -1, 1)
    explained = e / v.trace
    project = u / np.sqrt(e)
    error = float(np.abs(v.within(project) - np.eye(len(e))).max())
    shared = spark.sparkContext.broadcast((project, v.mean, sums, explained))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, mean, s, share = shared.value
        k = p.shape[1]
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            if not len(x):
                continue
            far = n * int(np.abs(x).max()) + max(map(abs, s))
            if far * far * width < 1 << 63:
                d = n * x - np.array(s, np.int64)
                deviation = pa.array((d * d).sum(axis=1))
            else:
                whole = [sum((n * a - b) ** 2 for a, b in zip(row, s, strict=True)) for row in x.tolist()]
                deviation = pa.array([a if a < 1 << 63 else None for a in whole], pa.int64())
            at = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(len(at), n)), deviation.take(at),
                 pa.array(((x - mean) @ p).ravel()), pa.array(np.tile(share, len(x))), pa.array(np.full(len(at), error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def q_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))
