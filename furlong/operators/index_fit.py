"""Least squares of the speed index over a cell cube.

One aggregate over the rows makes the cube: a row per surface, combination of
categories and set of optional numbers that are there, with the count, means,
co-moments and ranges of the numbers. Everything the fit needs is a sum over
cells: which predictors take part, their means, the columns of the one-hot
categories, the normal equations, and the residuals that correct the solution.
The rows are not read again for any of it.

Co-moments are taken about each cell's own means, so nothing is lost to large
common parts of the numbers. A cube of at most ``DRIVER_CELLS`` cells is solved
directly; a larger one stays a table, and conjugate gradients run over its
level pairs until the residual test holds, or an error is raised. Both solve
the same system.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.session import materialize as write_back

log = logging.getLogger(__name__)

NUMERIC_OPTIONAL = ["weight", "num_horses", "age"]
CATEGORICAL = ["track_condition", "venue", "class_name", "sex"]
NUMBERS = ["log_time", "log_dist", *NUMERIC_OPTIONAL]

# Cells and design columns of a surface that are solved on the driver.
DRIVER_CELLS = 1 << 15
DRIVER_COLUMNS = 1024
TOLERANCE = 1e-13
MAX_STEPS = 2000
ON = ["surface", "col", "level"]


class FitError(ValueError):
    pass


@dataclass
class SurfaceFit:
    surface: str
    num_cols: list[str]                       # varying numeric predictors
    cat_cols: list[str]                       # categories with any value
    rows: int
    means: dict[str, float]                   # of log_time and the numeric predictors
    whole: list[str] = field(default_factory=list)         # optional numbers that every row must have
    n_columns: int = 0                        # design columns, without the intercept
    coef: dict[str, float] = field(default_factory=dict)   # of the numeric predictors
    intercept: float = 0.0


def pair(a: str, b: str) -> str:
    return f"{min(a, b)}*{max(a, b)}"


def by_surface(values: dict[str, Column], default=None) -> Column:
    out = F.lit(default)
    for s, v in values.items():
        out = F.when(F.col("surface") == s, v).otherwise(out)
    return out


def cell_cube(norm: DataFrame) -> DataFrame:
    """surface, categories, have (bits of the optional numbers), n, and of each
    number its mean (its own name), ``min_``, ``max_``; ``a*b``: co-moment."""
    have = F.lit(0)
    for k, c in enumerate(NUMERIC_OPTIONAL):
        have = have + F.when(F.col(c).isNotNull(), F.lit(1 << k)).otherwise(F.lit(0))
    n = F.count(F.lit(1))
    together = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i:] if b != "log_time"]
    return norm.withColumn("have", have).groupBy("surface", *CATEGORICAL, "have").agg(
        n.alias("n"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in NUMBERS],
        *[f(c).alias(f"{name}_{c}") for c in NUMBERS[1:] for name, f in (("min", F.min), ("max", F.max))],
        *[F.coalesce(F.covar_pop(a, b) * n, F.lit(0.0)).alias(pair(a, b)) for a, b in together])


def plan(cube: DataFrame, min_rows: int) -> tuple[DataFrame, dict[str, SurfaceFit]]:
    """Cells that take part, and the predictors of each surface."""
    n = F.col("n")
    bit = {c: F.col("have").bitwiseAND(F.lit(1 << k)) > 0 for k, c in enumerate(NUMERIC_OPTIONAL)}
    counts = cube.groupBy("surface").agg(
        F.sum(n).alias("n"), *[F.sum(F.when(bit[c], n)).alias(c) for c in NUMERIC_OPTIONAL],
        *[F.sum(F.when(F.col(c).isNotNull(), n)).alias(c) for c in CATEGORICAL]).collect()
    if not counts:
        raise FitError("the source has no valid row")
    fits: dict[str, SurfaceFit] = {}
    complete: dict[str, Column] = {}
    for r in counts:
        if r["n"] < min_rows:
            log.warning("surface %s is left out: %d rows, %d needed", r["surface"], r["n"], min_rows)
            continue
        whole = [c for c in NUMERIC_OPTIONAL if r[c]]
        fits[r["surface"]] = SurfaceFit(r["surface"], ["log_dist", *whole], [c for c in CATEGORICAL if r[c]], 0, {}, whole)
        complete[r["surface"]] = F.lit(True)
        for c in whole:
            complete[r["surface"]] = complete[r["surface"]] & bit[c]
    cells = cube.filter(by_surface(complete, False))
    moments = {r["surface"]: r for r in cells.groupBy("surface").agg(
        F.sum(n).alias("n"), *[(F.sum(n * F.col(c)) / F.sum(n)).alias(c) for c in NUMBERS],
        *[F.min(f"min_{c}").alias(f"min_{c}") for c in NUMBERS[1:]], *[F.max(f"max_{c}").alias(f"max_{c}") for c in NUMBERS[1:]]).collect()}
    for s, f in list(fits.items()):
        m = moments.get(s)
        if m is None or m["n"] < min_rows:
            log.warning("surface %s is left out: %d complete rows, %d needed", s, m["n"] if m else 0, min_rows)
            del fits[s]
            continue
        f.rows = m["n"]
        f.num_cols = [c for c in f.num_cols if m[f"min_{c}"] < m[f"max_{c}"]]   # no NULLs are left
        f.means = {c: m[c] for c in ["log_time", *f.num_cols]}
    return cells.filter(F.col("surface").isin(list(fits))), fits


def centred(fits: dict[str, SurfaceFit], c: str) -> Column:
    """A number less its mean, 0 where it is no predictor."""
    return by_surface({s: F.col(c) - F.lit(f.means[c]) for s, f in fits.items() if c in f.means}, 0.0)


def with_residual(rows: DataFrame, fits: dict[str, SurfaceFit], coefs: DataFrame) -> DataFrame:
    """``rows`` (or cells) with ``residual``: the centred log time less the
    centred numeric part and the coefficients of the levels, joined by level."""
    y = centred(fits, "log_time")
    for c in sorted({c for f in fits.values() for c in f.num_cols}):
        y = y - centred(fits, c) * by_surface({s: F.lit(f.coef.get(c, 0.0)) for s, f in fits.items()}, 0.0)
    rows = rows.withColumn("residual", y)
    for c in sorted({c for f in fits.values() for c in f.cat_cols}):
        b = coefs.filter(F.col("col") == c).select("surface", F.col("level").alias(c), F.col("beta").alias("_b"))
        rows = rows.join(b, ["surface", c], "left").withColumn("residual", F.col("residual") - F.coalesce("_b", F.lit(0.0))).drop("_b")
    return rows


def solve_gram(gram: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Least-squares solution of ``gram @ b = rhs`` for a Gram matrix.

    Columns are scaled to unit length and directions below the rounding error
    of the matrix are dropped, so a rank-deficient design still reaches the
    minimum (residuals are unique even when b is not).
    """
    d = np.sqrt(np.clip(np.diag(gram), 0.0, None))
    d[d == 0] = 1.0
    w, v = np.linalg.eigh(gram / np.outer(d, d))
    keep = w > w.max() * np.finfo(float).eps * len(d)
    return (v[:, keep] / w[keep]) @ (v[:, keep].T @ (rhs / d)) / d


class DriverCells:
    """The cells of one surface as arrays, and their system."""

    def __init__(self, f: SurfaceFit, cells: list) -> None:
        nums = f.num_cols
        self.f, self.k = f, len(nums)
        self.n = np.array([r["n"] for r in cells], float)
        self.x = np.array([[r[c] - f.means[c] for c in nums] for r in cells]).reshape(len(cells), self.k)
        self.y = np.array([r["log_time"] - f.means["log_time"] for r in cells])
        self.xx = np.array([[[r[pair(a, b)] for b in nums] for a in nums] for r in cells]).reshape(len(cells), self.k, self.k)
        self.xy = np.array([[r[pair(c, "log_time")] for c in nums] for r in cells]).reshape(len(cells), self.k)
        self.keys = [("", c) for c in nums]
        self.at = np.full((len(cells), len(f.cat_cols)), -1)   # design column of each category's level
        for j, c in enumerate(f.cat_cols):
            levels = sorted({r[c] for r in cells} - {None})
            size = dict.fromkeys(levels, 0)
            for r in cells:
                if r[c] is not None:
                    size[r[c]] += r["n"]
            column = {}
            for v in levels[1:]:                              # the first level is the baseline
                if size[v] < f.rows:                          # a constant column is no predictor
                    column[v] = len(self.keys)
                    self.keys.append((c, v))
            self.at[:, j] = [column.get(r[c], -1) for r in cells]
        f.n_columns = len(self.keys)

    def _by_level(self, value: np.ndarray) -> np.ndarray:
        """Sums of a value of the cells over each level's cells."""
        out = np.zeros((len(self.keys), *value.shape[1:]))
        for j in range(self.at.shape[1]):
            on = self.at[:, j] >= 0
            np.add.at(out, self.at[on, j], value[on])
        return out

    def gram(self) -> np.ndarray:
        p, k = len(self.keys), self.k
        g = np.zeros((p, p))
        g[:k, :k] = self.xx.sum(axis=0) + (self.x * self.n[:, None]).T @ self.x
        of = self._by_level(self.n[:, None] * self.x)
        g[k:, :k], g[:k, k:] = of[k:], of[k:].T
        for i in range(self.at.shape[1]):
            for j in range(self.at.shape[1]):
                on = (self.at[:, i] >= 0) & (self.at[:, j] >= 0)
                np.add.at(g, (self.at[on, i], self.at[on, j]), self.n[on])
        count = self._by_level(self.n)[k:]
        g[k:, k:] -= np.outer(count, count) / self.f.rows
        return g

    def solve(self) -> dict:
        g, k = self.gram(), self.k
        beta = np.zeros(len(self.keys))
        for _ in range(3):   # the residuals give back the digits that the normal equations lose
            left = self.y - self.x @ beta[:k]
            for j in range(self.at.shape[1]):
                left = left - np.where(self.at[:, j] >= 0, beta[self.at[:, j]], 0.0) if len(beta) else left
            left = left - (self.n @ left) / self.f.rows
            rhs = self._by_level(self.n * left)
            rhs[:k] = (self.xy - np.einsum("cij,j->ci", self.xx, beta[:k])).sum(axis=0) + (self.n * left) @ self.x
            beta = beta + solve_gram(g, rhs)
        return dict(zip(self.keys, beta.tolist(), strict=True))


def _levels_of(fits: dict[str, SurfaceFit]) -> Column:
    """(col, level) of each category that has a value in the cell."""
    used = sorted({c for f in fits.values() for c in f.cat_cols}, key=CATEGORICAL.index)
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("level")) for c in used]) if used else \
        F.array().cast("array<struct<col:string,level:string>>")
    return F.filter(pairs, lambda x: x["level"].isNotNull())


def _level_sums(cells: DataFrame, fits: dict[str, SurfaceFit], values: dict[str, Column]) -> DataFrame:
    """Sums of ``values`` by (surface, col, level)."""
    return (cells.select("surface", *[v.alias(k) for k, v in values.items()], F.explode(_levels_of(fits)).alias("x"))
            .groupBy("surface", "x.col", "x.level").agg(*[F.sum(k).alias(k) for k in values]))


def _level_pairs(cells: DataFrame, fits: dict[str, SurfaceFit]) -> DataFrame:
    """Rows by pair of levels of different categories, each pair both ways."""
    x = cells.select("surface", "n", _levels_of(fits).alias("xs"))
    both = F.flatten(F.transform("xs", lambda a: F.transform(F.filter("xs", lambda b: b["col"] != a["col"]),
                                                             lambda b: F.struct(a["col"].alias("col"), a["level"].alias("level"),
                                                                                b["col"].alias("col2"), b["level"].alias("level2")))))
    return x.select("surface", "n", F.inline(both)).groupBy(*ON, "col2", "level2").agg(F.sum("n").cast("double").alias("v"))


def _conjugate_gradients(state: DataFrame, cells: DataFrame, fits: dict[str, SurfaceFit]) -> DataFrame:
    """Solve the system kept as tables. state: surface, col, level, c (the
    column's sum), diag, b; cells: surface, col, level, col2, level2, v, the
    uncentred products. Returns surface, col, level, beta."""
    of = lambda values: by_surface({s: F.lit(float(v)) for s, v in values.items()}, 0.0)
    st = write_back(state.select(*ON, "c", "diag", F.lit(0.0).alias("x"), F.col("b").alias("r"), (F.col("b") / F.col("diag")).alias("p")), "cg")
    sums = lambda df, **e: {r["surface"]: r for r in df.groupBy("surface").agg(*[F.sum(v).alias(k) for k, v in e.items()]).collect()}
    rz = {s: r["rz"] for s, r in sums(st, rz=F.col("r") * F.col("r") / F.col("diag")).items()}
    first = dict(rz)
    for _ in range(MAX_STEPS):
        live = [s for s in rz if rz[s] > first[s] * TOLERANCE**2]
        if not live:
            return st.select(*ON, F.col("x").alias("beta"))
        cp = {s: r["cp"] / fits[s].rows for s, r in sums(st, cp=F.col("c") * F.col("p")).items()}
        other = st.select("surface", F.col("col").alias("col2"), F.col("level").alias("level2"), "p")
        q = cells.join(other, ["surface", "col2", "level2"]).groupBy(*ON).agg(F.sum(F.col("v") * F.col("p")).alias("q"))
        st = write_back(st.join(q, ON, "left").withColumn("q", F.coalesce("q", F.lit(0.0)) - F.col("c") * of(cp)), "cg")
        alpha = {s: rz[s] / r["pq"] if s in live and r["pq"] > 0 else 0.0 for s, r in sums(st, pq=F.col("p") * F.col("q")).items()}
        st = st.select(*ON, "c", "diag", (F.col("x") + of(alpha) * F.col("p")).alias("x"), (F.col("r") - of(alpha) * F.col("q")).alias("r"), "p")
        new = {s: r["rz"] for s, r in sums(st, rz=F.col("r") * F.col("r") / F.col("diag")).items()}
        beta = {s: new[s] / rz[s] if rz[s] else 0.0 for s in new}
        st = st.withColumn("p", F.col("r") / F.col("diag") + of(beta) * F.col("p"))
        rz = {s: new[s] if alpha.get(s) else 0.0 for s in new}
    raise FitError(f"no solution within {MAX_STEPS} steps: residual "
                   + ", ".join(f"{(rz[s] / first[s]) ** 0.5:.1e} on {s}" for s in live))


def coef_table(df: DataFrame, found: dict[str, dict]) -> DataFrame:
    rows = [(s, col, level, float(b)) for s, x in found.items() for (col, level), b in x.items()]
    return df.sparkSession.createDataFrame(rows, "surface string, col string, level string, beta double")


def _take_numeric(fits: dict[str, SurfaceFit], coefs: DataFrame) -> None:
    for r in coefs.filter(F.col("col") == "").collect():   # a few predictors a surface
        fits[r["surface"]].coef[r["level"]] = r["beta"]


def _solve_wide(cells: DataFrame, fits: dict[str, SurfaceFit]) -> DataFrame:
    """Coefficients from a cube that stays a table."""
    spark, n = cells.sparkSession, F.col("n")
    rows = by_surface({s: F.lit(float(f.rows)) for s, f in fits.items()})
    levels = _level_sums(cells, fits, {"n": n})
    first = levels.groupBy("surface", "col").agg(F.min("level").alias("first"))
    levels = write_back(levels.join(first, ["surface", "col"]).filter((F.col("level") != F.col("first")) & (F.col("n") < rows)).drop("first"), "levels")
    widths = {r["surface"]: r["count"] for r in levels.groupBy("surface").count().collect()}
    for s, f in list(fits.items()):
        f.n_columns = len(f.num_cols) + widths.get(s, 0)
        if not f.n_columns:
            del fits[s]
    if not fits:
        return coef_table(cells, {})
    nums = sorted({c for f in fits.values() for c in f.num_cols})
    # co-moments count only between numbers that are predictors of the surface
    real = lambda a, b: by_surface({s: F.col(pair(a, b)) for s, f in fits.items() if {a, b} <= {*f.num_cols, "log_time"}}, 0.0)
    x = cells.filter(F.col("surface").isin(list(fits))).select(
        "surface", *CATEGORICAL, "n", centred(fits, "log_time").alias("y"), *[centred(fits, c).alias(f"d_{c}") for c in nums],
        *[real(a, b).alias(pair(a, b)) for i, a in enumerate(nums) for b in nums[i:]], *[real(a, "log_time").alias(pair(a, "log_time")) for a in nums])
    grams = {r["surface"]: r.asDict() for r in x.groupBy("surface").agg(
        *[F.sum(F.col(pair(a, b)) + n * F.col(f"d_{a}") * F.col(f"d_{b}")).alias(pair(a, b)) for i, a in enumerate(nums) for b in nums[i:]]).collect()}
    sums = write_back(levels.join(_level_sums(x, fits, {c: n * F.col(f"d_{c}") for c in nums}), ON) if nums else levels, "level-sums")
    keep = levels.select(*ON)
    pairs = _level_pairs(x, fits).join(keep, ON).join(keep.select("surface", F.col("col").alias("col2"), F.col("level").alias("level2")), ["surface", "col2", "level2"])
    own = sums.select(*ON, F.col("col").alias("col2"), F.col("level").alias("level2"), F.col("n").cast("double").alias("v"))
    num_cells = spark.createDataFrame([(s, "", a, "", b, float(grams[s][pair(a, b)])) for s, f in fits.items() for a in f.num_cols for b in f.num_cols],
                                      "surface string, col string, level string, col2 string, level2 string, v double")
    by_num = sums.select(*ON, F.explode(F.array(*[F.struct(F.lit(c).alias("num"), F.col(c).alias("v")) for c in nums])).alias("z")).select(*ON, "z.*") if nums else \
        spark.createDataFrame([], "surface string, col string, level string, num string, v double")
    of_num = by_num.select(*ON, F.lit("").alias("col2"), F.col("num").alias("level2"), "v")
    to_num = by_num.select("surface", F.lit("").alias("col"), F.col("num").alias("level"), F.col("col").alias("col2"), F.col("level").alias("level2"), "v")
    products = write_back(num_cells.unionByName(pairs.select(num_cells.columns)).unionByName(own).unionByName(of_num).unionByName(to_num), "cells")

    coefs = None
    for _ in range(2):   # the second time from the residuals, which gives back lost digits
        left = x.withColumn("r", F.col("y"))
        if coefs is not None:
            for s, f in fits.items():
                f.coef = {}
            _take_numeric(fits, coefs)
            # with_residual reads the numbers by their names
            named = cells.filter(F.col("surface").isin(list(fits)))
            left = with_residual(named, fits, coefs).select(
                "surface", *CATEGORICAL, "n", F.col("residual").alias("r"), *[centred(fits, c).alias(f"d_{c}") for c in nums],
                *[real(a, b).alias(pair(a, b)) for i, a in enumerate(nums) for b in nums[i:]], *[real(a, "log_time").alias(pair(a, "log_time")) for a in nums])
        mean = {r["surface"]: r["m"] for r in left.groupBy("surface").agg((F.sum(n * F.col("r")) / F.sum(n)).alias("m")).collect()}
        left = left.withColumn("r", F.col("r") - by_surface({s: F.lit(float(m)) for s, m in mean.items()}, 0.0))

        def inner(c: str) -> Column:
            out = F.col(pair(c, "log_time"))
            for b in nums:
                out = out - F.col(pair(c, b)) * by_surface({s: F.lit(float(f.coef.get(b, 0.0))) for s, f in fits.items()}, 0.0)
            return out
        numeric = {r["surface"]: r.asDict() for r in left.groupBy("surface").agg(F.count(F.lit(1)).alias("_"), *[F.sum(inner(c) + n * F.col(f"d_{c}") * F.col("r")).alias(c) for c in nums]).collect()}
        num = spark.createDataFrame([(s, "", c, 0.0, float(grams[s][pair(c, c)]), float(numeric[s][c])) for s, f in fits.items() for c in f.num_cols],
                                    "surface string, col string, level string, c double, diag double, b double")
        lv = levels.join(_level_sums(left, fits, {"b": n * F.col("r")}), ON).select(*ON, n.cast("double").alias("c"), (n - n * n / rows).alias("diag"), "b")
        step = _conjugate_gradients(num.unionByName(lv), products, fits)
        coefs = step if coefs is None else write_back(coefs.unionByName(step).groupBy(*ON).agg(F.sum("beta").alias("beta")), "coefs")
    return coefs


def fit_cube(cube: DataFrame, min_rows: int, driver_cells: int = DRIVER_CELLS) -> tuple[DataFrame, dict[str, SurfaceFit]]:
    """(surface, col, level, beta) of every valid surface, and the fits; a
    number's coefficient has a blank ``col`` and its name as ``level``."""
    cells, fits = plan(cube, min_rows)
    narrow = cells.limit(driver_cells + 1).collect() if fits else []
    if len(narrow) <= driver_cells:
        systems = {s: DriverCells(f, [r for r in narrow if r["surface"] == s]) for s, f in fits.items()}
    if len(narrow) > driver_cells or any(f.n_columns > DRIVER_COLUMNS for f in fits.values()):
        coefs = _solve_wide(cells, fits)
    else:
        coefs = coef_table(cube, {s: x.solve() for s, x in systems.items() if x.keys})
    for s in [s for s, f in fits.items() if not f.n_columns]:
        log.warning("surface %s is left out: no predictor varies", s)
        del fits[s]
    for f in fits.values():
        f.coef = {}
    _take_numeric(fits, coefs)
    return coefs, fits
