"""Linear systems and decompositions over matrices in coordinates (i, j, v), 0-based.

Factors of up to MOST rows are made by numpy in one task; larger matrices are factored tile by tile (see tiles), by
Cholesky or, where rows must be exchanged, by elimination. Conjugate gradients and the randomised decomposition work on joins
and have no bound either.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genospark.functions.draws import normal
from genospark.model import INDIV, SNP
from genospark.operators import tiles
from genospark.operators.products import dot, geno_product, matmul, matvec
from genospark.plans.batches import runs
from genospark.plans.tables import collected, read_by, removed, tidy, written

#: Rows that one task may factor, columns of B that it may take at once, and the side of a tile beyond.
MOST, SIDE = 1500, 1000
SINGULAR = 1e-12


def _dense(rows: pd.DataFrame, n: int, m: int | None = None) -> np.ndarray:
    out = np.zeros((n, n if m is None else m))
    np.add.at(out, (rows["i"].to_numpy(), rows["j"].to_numpy()), rows["v"].to_numpy())
    return out


def _coordinates(a: np.ndarray) -> pd.DataFrame:
    i, j = np.indices(a.shape)
    return pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": a.ravel()})


def size_of(a: DataFrame) -> int:
    n = a.agg(F.max(F.greatest("i", "j"))).first()[0]
    return 0 if n is None else n + 1


def _with_kernel(a: DataFrame, b: DataFrame | None, kernel: Callable, schema: str = "i bigint, j bigint, v double") -> DataFrame:
    """kernel(A, B) with the matrices dense, A square: in one task, or, where B has many columns, in one for each MOST of
    them, all of which get A."""
    n = size_of(a)
    cells = lambda m, which: m.select(F.lit(which).alias("which"), F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.col("v").cast("double").alias("v"))
    width = 0 if b is None else (b.agg(F.max("j")).first()[0] or 0) + 1
    groups = max(1, -(-width // MOST))
    parts = cells(a, 0).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    if b is not None:
        parts = parts.unionByName(cells(b, 1).withColumn("part", F.expr(f"int(j div {MOST})")))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        first = _dense(rows[rows["which"] == 0], n)
        if not width:
            return kernel(first, None)
        start = int(key[0]) * MOST
        second = rows[rows["which"] == 1]
        out = kernel(first, _dense(second.assign(j=second["j"] - start), n, min(MOST, width - start)))
        return out.assign(j=out["j"] + start) if "j" in out else out

    return parts.groupBy("part").applyInPandas(run, schema)


def _tiled(a: DataFrame, b: DataFrame | None, n: int, side: int, methods: tuple[str, ...]) -> DataFrame:
    """(i, j, v) of A^-1 B by tiles, by the first method that works."""
    if unknown := [m for m in methods if m not in ("cholesky", "lu", "qr", "svd", "eigen")]:
        raise ValueError(f"no method {unknown[0]}")
    if b is None:
        b, width = a.sparkSession.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v")), n
    else:
        width = (b.agg(F.max("j")).first()[0] or 0) + 1
    for method in methods:
        if method not in ("cholesky", "lu"):
            raise ValueError(f"a matrix of {n} rows is solved by tiles: by cholesky or lu, not by {method}")
        try:
            if method == "cholesky":
                f = tiles.factor(a, n, side)
                y = tiles.substituted(f, written(tiles.tiles_of(b, side), "right"), n, side, False)
            else:
                f, y = tiles.eliminated(a, b, n, side)
            return tiles.cells_of(tiles.substituted(f, y, n, side, True), side, n, width)
        except np.linalg.LinAlgError:
            if method == methods[-1]:
                raise
    raise ValueError("no method")


def cholesky_np(a: np.ndarray) -> np.ndarray:
    return np.linalg.cholesky((a + a.T) / 2)


def solve_np(a: np.ndarray, b: np.ndarray | None, methods: tuple[str, ...] = ("cholesky", "eigen")) -> np.ndarray:
    """A^-1 B (or A^-1) by the first method that works. A diagonal matrix is inverted by itself, where entries
    of 0 or less invert to 0 if there is no B."""
    diagonal = np.diag(a)
    if not (a - np.diag(diagonal)).any():
        if b is None:
            return np.diag(np.where(diagonal > 0, 1 / np.where(diagonal > 0, diagonal, 1), 0))
        return b / diagonal[:, None]
    right = np.eye(len(a)) if b is None else b
    for method in methods:
        try:
            if method == "cholesky":
                f = cholesky_np(a)
                return np.linalg.solve(f.T, np.linalg.solve(f, right))
            if method == "lu":
                return np.linalg.solve(a, right)
            if method == "qr":
                q, r = np.linalg.qr(a)
                return np.linalg.solve(r, q.T @ right)
            if method == "svd":
                u, w, vt = np.linalg.svd(a)
                left = u.T @ right
                keep = w > SINGULAR * max(1, w[0])
                if b is not None and np.abs(left[~keep]).max(initial=0) > 1e-8 * max(1, np.abs(right).max()):
                    raise np.linalg.LinAlgError("the singular system has no solution")
                return vt[keep].T @ (left[keep] / w[keep, None])
            if method == "eigen":
                w, q = np.linalg.eigh((a + a.T) / 2)
                if w.min() < -SINGULAR * max(1, abs(w).max()):
                    raise np.linalg.LinAlgError("not positive semidefinite")
                keep = w > SINGULAR * max(1, abs(w).max())
                left = q.T @ right
                if b is not None and np.abs(left[~keep]).max(initial=0) > 1e-8 * max(1, np.abs(right).max()):
                    raise np.linalg.LinAlgError("the singular system has no solution")
                return q[:, keep] @ (left[keep] / w[keep, None])
        except np.linalg.LinAlgError:
            if method == methods[-1]:
                raise
    raise ValueError(f"no method in {methods}")


@tidy
def solved(a: DataFrame, b: DataFrame | None = None, methods: tuple[str, ...] = ("cholesky", "eigen"), most: int = MOST, side: int = SIDE) -> DataFrame:
    """(i, j, v) of A^-1 B, or of A^-1, by the first of the methods that works. Beyond `most` rows these are cholesky and lu; when the
    others' turn comes there, that is an error that names them."""
    n = size_of(a)
    if n > most:
        return _tiled(a, b, n, side, methods)
    return _with_kernel(a, b, lambda x, y: _coordinates(solve_np(x, y, methods)))


@tidy
def cholesky(a: DataFrame, upper: bool = False, most: int = MOST, side: int = SIDE) -> DataFrame:
    n = size_of(a)
    if n > most:
        out = tiles.cells_of(tiles.factor(a, n, side), side, n, n, lower=True)
        return out.select(F.col("j").alias("i"), F.col("i").alias("j"), "v") if upper else out
    return _with_kernel(a, None, lambda x, _: _coordinates(cholesky_np(x).T if upper else cholesky_np(x)))


@tidy
def log_determinant(a: DataFrame, most: int = MOST, side: int = SIDE) -> DataFrame:
    """One row v: twice the sum of the logarithms of the factor's diagonal."""
    n = size_of(a)
    if n > most:
        return a.sparkSession.createDataFrame([(tiles.log_determinant(tiles.factor(a, n, side), n, side),)], "v double")
    return _with_kernel(a, None, lambda x, _: pd.DataFrame({"v": [2 * np.log(np.diag(cholesky_np(x))).sum()]}), "v double")


@tidy
def is_positive_definite(a: DataFrame, most: int = MOST, side: int = SIDE) -> DataFrame:
    """One row v: whether A is symmetric, within 1e-8 of its larger cell or so, and has a Cholesky factor."""
    n = size_of(a)
    if n > most:
        t = a.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("w"))
        off = a.join(t, ["i", "j"], "full").filter(F.abs(F.coalesce("v", F.lit(0.0)) - F.coalesce("w", F.lit(0.0))) > 1e-8 + 1e-5 * F.abs(F.coalesce("w", F.lit(0.0))))
        ok = off.isEmpty()
        try:
            if ok:
                tiles.factor(a, n, side)
        except np.linalg.LinAlgError:
            ok = False
        return a.sparkSession.createDataFrame([(ok,)], "v boolean")

    def test(x: np.ndarray, _) -> pd.DataFrame:
        try:
            cholesky_np(x)
            return pd.DataFrame({"v": [bool(np.allclose(x, x.T))]})
        except np.linalg.LinAlgError:
            return pd.DataFrame({"v": [False]})

    return _with_kernel(a, None, test, "v boolean")


def x_inverse_y(x: DataFrame, c: DataFrame, y: DataFrame) -> DataFrame:
    """One row: the sum over columns of x' C^-1 y, and log |C|."""
    z = solved(c, y)
    both = x.select("i", "j", F.col("v").alias("a")).join(z.withColumnRenamed("v", "b"), ["i", "j"])
    return both.agg(F.sum(F.col("a") * F.col("b")).alias("v")).join(F.broadcast(log_determinant(c).withColumnRenamed("v", "log_det")))


def root_times(a: DataFrame, b: DataFrame, most: int = MOST) -> DataFrame:
    """(i, j, v) of L' B, with L L' = A: normal draws of covariance A come of it for L instead; see normal_draws()."""
    if size_of(a) > most:
        return matmul(cholesky(a, upper=True, most=most), b)
    return _with_kernel(a, b, lambda x, y: _coordinates(cholesky_np(x).T @ y))


def normal_draws(a: DataFrame, draws: int, seed: int, most: int = MOST) -> DataFrame:
    """(i, j, v): draws from the normal law of covariance A, one a column: the factor times numbers that are functions of the seed and
    the cell."""
    n = size_of(a)
    z = written(a.sparkSession.range(n * draws).select(F.expr(f"id div {draws}").alias("i"), F.expr(f"id % {draws}").alias("j")).withColumn("v", normal(seed, F.col("i"), F.col("j"))), "draws")
    return matmul(cholesky(a, most=most).filter("j <= i"), z)


class Triangular:
    """A triangular matrix (i, j, v) made ready for many systems op(A) X = B: its tiles with the diagonal ones inverted, as a table, and
    the wavefronts of rows of tiles that do not wait for each other. free() deletes the table; solutions stay."""

    def __init__(self, a: DataFrame, lower: bool, transposed: bool = False, side: int = SIDE):
        self.n, self.side = size_of(a), side
        kept = a.filter("j <= i" if lower else "j >= i")
        kept = kept if lower else kept.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")  # the lower factor of the transpose
        self.transposed = transposed == lower
        with collected() as made:
            self.f = tiles.inverted_diagonal(written(tiles.tiles_of(kept, side), "tiles"), self.n, side)
        self.made = made
        pattern = [(r.p, r.q) for r in self.f.select("p", "q").collect()]  # at most one for each side^2 cells
        steps = -(-self.n // side)
        if sum(p == q for p, q in pattern) != steps:
            raise ZeroDivisionError("a zero on the diagonal")
        self.fronts = tiles.wavefronts(pattern, steps, self.transposed)

    @tidy
    def solve(self, b: DataFrame) -> DataFrame:
        """(i, j, v) of op(A)^-1 B, a table."""
        if not self.made:
            raise ValueError("this was freed")
        width = (b.agg(F.max("j")).first()[0] or 0) + 1
        right = written(tiles.tiles_of(b, self.side), "right")
        x = tiles.swept(self.f, self.fronts, right, self.side, self.transposed)
        return written(tiles.cells_of(x, self.side, self.n, width), "solution")

    def free(self) -> None:
        if not self.made:
            raise ValueError("this was freed")
        removed(self.f.sparkSession, self.made)


@tidy
def triangular(a: DataFrame, b: DataFrame, lower: bool, transposed: bool = False, most: int = MOST, side: int = SIDE) -> DataFrame:
    """op(A)^-1 B for a triangular A (i, j, v). Up to `most` rows one task substitutes; beyond, tiles, in as many steps as there
    are wavefronts of rows of them."""
    if size_of(a) <= most:

        def substituted(x: np.ndarray, y: np.ndarray) -> pd.DataFrame:
            t = np.tril(x) if lower else np.triu(x)
            t, out = (t.T if transposed else t), np.zeros_like(y)
            for k in range(len(t)) if lower != transposed else range(len(t) - 1, -1, -1):
                out[k] = (y[k] - t[k] @ out) / t[k, k]
            return _coordinates(out)

        return _with_kernel(a, b, substituted)
    handle = Triangular(a, lower, transposed, side)
    out = handle.solve(b)
    handle.free()
    return out


def factored(f: DataFrame, b: DataFrame, lower: bool, permutation: DataFrame | None = None, most: int = MOST, side: int = SIDE) -> DataFrame:
    """(F F')^-1 B for a lower factor, (F'F)^-1 B for an upper one; permutation (i, to): B is solved in its order."""
    if permutation is not None:
        b = b.join(permutation, "i").select(F.col("to").alias("i"), "j", "v")
    first = triangular(f, b, lower, not lower, most, side)
    out = triangular(f, first, lower, lower, most, side)
    if permutation is not None:
        out = out.withColumnRenamed("i", "to").join(permutation, "to").select("i", "j", "v")
    return out


def inverse_2x2(a: Column, b: Column, c: Column, d: Column) -> dict[str, Column]:
    """Entries of the inverse of [[a, b], [c, d]]; NULL if it is singular."""
    det = F.nullif(a * d - b * c, F.lit(0.0))
    return {"a": d / det, "b": -b / det, "c": -c / det, "d": a / det, "det": a * d - b * c}


def inverse_3x3(m: list[list[Column]]) -> list[list[Column]]:
    """Entries of the inverse by cofactors."""

    def cofactor(i: int, j: int) -> Column:
        (p, q), (r, s) = ([x for x in range(3) if x != i], [x for x in range(3) if x != j])
        return (m[p][r] * m[q][s] - m[p][s] * m[q][r]) * (-1) ** (i + j)

    det = F.nullif(sum((m[0][j] * cofactor(0, j) for j in range(3)), F.lit(0.0)), F.lit(0.0))
    return [[cofactor(j, i) / det for j in range(3)] for i in range(3)]


def conjugate_gradient(times: Callable[[DataFrame], DataFrame], b: DataFrame, tolerance: float = 1e-2, most: int = 1000) -> DataFrame:
    """(i, v): x with times(x) = b for a positive definite operator on (i, v); stops when the residual's norm is below
    tolerance, and raises ArithmeticError where `most` rounds do not get there. A round writes one table, of the solution, the residual,
    the direction and the operator's value of it side by side, and reads two sums off it; its table goes with the next one."""
    spark = b.sparkSession
    old: list[str] = []
    with collected() as made:
        v = F.col("v").cast("double")
        state = written(b.select("i", F.lit(0.0).alias("x"), v.alias("r"), v.alias("p")), "state")
        old.extend(made)
    rr = state.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
    for _ in range(most):
        if rr**0.5 < tolerance:
            break
        with collected() as made:
            q = times(state.select("i", F.col("p").alias("v"))).select("i", F.col("v").cast("double").alias("q"))
            state = written(state.join(q, "i", "full").na.fill(0.0, ["x", "r", "p", "q"]), "state")
        removed(spark, [path for path in made if path.rpartition("/")[2] not in read_by(state)])
        step = rr / state.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        state = state.select("i", (F.col("x") + step * F.col("p")).alias("x"), (F.col("r") - step * F.col("q")).alias("r"), "p")
        new = state.agg(F.sum(F.col("r") * F.col("r"))).first()[0]
        state, rr = state.select("i", "x", "r", (F.col("r") + (new / rr) * F.col("p")).alias("p")), new
        removed(spark, old)
        old.extend(made)
    if rr**0.5 >= tolerance:
        raise ArithmeticError(f"the residual is {rr**0.5:g} after {most} rounds")
    return state.select("i", F.col("x").alias("v"))


def solve_relationship(a: DataFrame, v: DataFrame, tau: float, beta: float | None = None) -> DataFrame:
    """(i, rest[, yhat]): (A + tau I)^-1 v, and A rest + beta."""
    if tau <= 0:
        raise ValueError("tau must be positive")
    ridge = a.withColumn("v", F.col("v") + F.when(F.col("i") == F.col("j"), tau).otherwise(0.0))
    rest = solved(ridge, v.select("i", F.lit(0).alias("j"), "v")).select("i", F.col("v").alias("rest"))
    if beta is None:
        return rest
    fitted = matvec(a, rest.withColumnRenamed("rest", "v"))
    return rest.join(fitted, "i").select("i", "rest", (F.col("v") + beta).alias("yhat"))


def triangle_of(y: DataFrame, columns: int) -> np.ndarray:
    """R of the QR factors of a tall matrix (idx, col, v): each partition folds its rows into one triangle, sixteen triangles fold into
    one until one is left. Its diagonal is not negative."""

    def folded(stack: np.ndarray) -> np.ndarray:
        r = np.zeros((columns, columns))
        q = np.linalg.qr(stack, mode="r")
        r[: len(q)] = q
        return r

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for t in runs(batches, 1):
            _, at = np.unique(np.asarray(t.column("idx")), return_inverse=True)
            m = np.zeros((at.max() + 1, columns))
            np.add.at(m, (at, np.asarray(t.column("col"))), np.asarray(t.column("v")))
            for a in range(0, len(m), 4096):
                r = folded(m[a : a + 4096] if r is None else np.concatenate([r, m[a : a + 4096]]))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([r.tobytes()], pa.binary())], names=["part", "r"])

    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        stack = np.concatenate([np.frombuffer(x).reshape(columns, columns) for x in rows.sort_values("part")["r"]])
        return pd.DataFrame({"part": np.array([key[0]], np.int32), "r": [folded(stack).tobytes()]})

    cells = y.select(F.col("idx").cast("bigint").alias("idx"), F.col("col").cast("int").alias("col"), F.col("v").cast("double").alias("v"))
    left = written(cells.repartition("idx").sortWithinPartitions("idx").mapInArrow(fold, "part int, r binary"), "triangles")
    while left.count() > 1:
        left = written(left.groupBy(F.expr("int(part div 16)").alias("g")).applyInPandas(join, "part int, r binary"), "triangles")
    row = left.first()
    r = np.zeros((columns, columns)) if row is None else np.frombuffer(bytes(row.r)).reshape(columns, columns)
    return r * np.where(np.diag(r) < 0, -1, 1)[:, None]


def orthogonalised(y: DataFrame, columns: int) -> DataFrame:
    """(idx, col, v): an orthonormal basis of the columns, by a tree of QR factors, twice; the driver sees triangles of `columns` only."""
    for _ in range(2):
        r = triangle_of(y, columns)
        back = np.linalg.inv(r + np.diag((np.diag(r) == 0) * 1.0))
        m = y.sparkSession.createDataFrame(pd.DataFrame({"col": np.repeat(np.arange(columns), columns), "to": np.tile(np.arange(columns), columns), "w": back.ravel()}))
        y = written(y.join(F.broadcast(m.filter("w <> 0")), "col").groupBy("idx", "to").agg(F.sum(F.col("v") * F.col("w")).alias("v")).withColumnRenamed("to", "col"))
    return y


def principal_components(geno: DataFrame, k: int, oversample: int = 40, power: int = 2, seed: int = 1) -> tuple[DataFrame, list[float]]:
    """(idx, col, v): leading left singular vectors of the centred genotypes over individuals, and the singular
    values. Products are joins; the driver sees matrices of k + oversample columns only."""
    freq = written(geno.groupBy(SNP).agg((F.sum("dosage") / (2 * F.count("dosage"))).alias("freq")))
    n, snps = geno.agg(F.countDistinct(INDIV), F.countDistinct(SNP)).first()
    width = min(k + oversample, n - 1, snps)
    spark = geno.sparkSession
    cols = spark.range(width).select(F.col("id").cast("int").alias("col"))
    omega = written(freq.select(F.col(SNP).alias("idx")).join(F.broadcast(cols)).select("idx", "col", normal(seed, F.col("idx"), F.col("col")).alias("v")))
    y = written(geno_product(geno, omega, False, True, freq))
    for _ in range(power):
        y = orthogonalised(y, width)
        z = orthogonalised(written(geno_product(geno, y, True, True, freq)), width)
        y = written(geno_product(geno, z, False, True, freq))
    q = orthogonalised(y, width)
    b = written(geno_product(geno, q, True, True, freq))
    gram = b.join(b.select("idx", F.col("col").alias("c2"), F.col("v").alias("w")), "idx").groupBy("col", "c2").agg(F.sum(F.col("v") * F.col("w")).alias("g")).collect()
    g = np.zeros((width, width))
    for r in gram:
        g[r["col"], r["c2"]] = r["g"]
    w, u = np.linalg.eigh(g)
    order = np.argsort(w)[::-1][:k]
    u = u[:, order]
    m = spark.createDataFrame(pd.DataFrame({"col": np.repeat(np.arange(width), k), "to": np.tile(np.arange(k), width), "w": u.ravel()}))
    vectors = q.join(F.broadcast(m), "col").groupBy("idx", "to").agg(F.sum(F.col("v") * F.col("w")).alias("v")).withColumnRenamed("to", "col")
    return vectors, np.sqrt(np.maximum(w[order], 0)).tolist()


def gblup(g: DataFrame, x: DataFrame, y: DataFrame, ridge: float = 1.0, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Fixed effects (i, v) and breeding values (i, v) for V = G + ridge I: beta by generalised least squares,
    then G V^-1 (y - X beta). x: (i, j, v), y: (i, v). V is factored once, for X and y side by side; no inverse is made."""
    v = g.withColumn("v", F.col("v") + F.when(F.col("i") == F.col("j"), ridge).otherwise(0.0))
    right = x.select("i", (F.col("j") + 1).alias("j"), F.col("v").cast("double").alias("v")).unionByName(y.select("i", F.lit(0).cast("bigint").alias("j"), F.col("v").cast("double").alias("v")))
    both = written(solved(v, right, most=most), "solved")
    w, z = both.filter("j = 0").select("i", "v"), both.filter("j > 0").select("i", (F.col("j") - 1).alias("j"), "v")
    beta = written(solved(matmul(x, z, ta=True), matmul(x, w.select("i", F.lit(0).alias("j"), "v"), ta=True)).select("i", "v"))
    fit = matvec(z, beta)
    rest = w.join(fit.withColumnRenamed("v", "f"), "i").select("i", (F.col("v") - F.col("f")).alias("v"))
    return beta, matvec(g, rest)
