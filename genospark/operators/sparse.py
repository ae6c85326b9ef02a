"""Sparse symmetric positive definite systems, eliminated in rounds of independent rows.

Each round takes rows of few neighbours, none next to another, least neighbours first: their elimination commutes, so that all are
eliminated at once, by one join of their neighbours with each other. That orders the matrix (minimum degree, many at a time) and
factors it in the same step: a round is a level of the elimination tree. Fill stays within rows of at most `degree` neighbours;
what is left when none has so few, or when little is left, is dense and solved in tiles. The factor is a table for each level, so
solving takes two passes over the levels.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genospark.operators import solve
from genospark.operators.select import placed
from genospark.plans.tables import collected, read_by, removed, tidy, written

#: Neighbours that a row to be eliminated has at most, rows that are left to the dense solver, and rounds.
DEGREE, LEFT, ROUNDS = 48, 200, 200


class SparseCholesky:
    """The factor of (i, j, v), both triangles or either; LinAlgError where a pivot is not positive. Rows without a cell are none of
    the matrix's. fill: cells of the factor below the diagonal, without the dense rest; free() deletes its tables."""

    def __init__(self, a: DataFrame, degree: int = DEGREE, left: int = LEFT):
        self.levels: list[tuple[DataFrame, DataFrame]] = []
        self.fill, self.logs = 0, 0.0
        spark = a.sparkSession
        with collected() as self.made:
            old: list[str] = []
            cells = a.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.col("v").cast("double").alias("v"))
            with collected() as made:
                cells = written(cells.groupBy("i", "j").agg(F.sum("v").alias("v")), "cells")
                other = cells.filter("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
                # a matrix given by one triangle gets the other; where both are given they must agree
                edges = written(cells.filter("i <> j").unionByName(other).groupBy("i", "j").agg(F.max("v").alias("v"), F.min("v").alias("w")), "edges")
                if not edges.filter("abs(v - w) > 1e-9 * greatest(abs(v), abs(w), 1)").isEmpty():
                    raise ValueError("the matrix is not symmetric")
                edges, diagonal = edges.drop("w"), written(cells.filter("i = j").select("i", F.col("v").alias("d")), "diagonal")
                if not edges.select("i").distinct().join(diagonal, "i", "left_anti").isEmpty():
                    raise np.linalg.LinAlgError("a row has no diagonal")
            old = made
            self.n = diagonal.count()
            for level in range(ROUNDS):
                if diagonal.count() <= left:
                    break
                with collected() as made:
                    picked = self._picked(edges, diagonal, degree, level)
                    pivots, lowest, logs = picked.agg(F.count("*"), F.min("d"), F.sum(F.log("d"))).first()
                    if not pivots:
                        removed(spark, made)
                        break
                    if lowest <= 0:
                        raise np.linalg.LinAlgError("the matrix is not positive definite")
                    columns = written(edges.join(picked, "i").select(F.col("i").alias("k"), F.col("j").alias("i"), "v", (F.col("v") / F.col("d")).alias("l")), "level")
                    self.levels.append((picked, columns))
                    kept = [x for x in made if x.rpartition("/")[2] in read_by(picked) + read_by(columns)]
                    pairs = columns.join(columns.select("k", F.col("i").alias("j"), F.col("l").alias("m")), "k")
                    less = written(pairs.groupBy("i", "j").agg((-F.sum(F.col("v") * F.col("m"))).alias("v")), "updates")
                    gone = picked.select("i")
                    stay = edges.join(gone, "i", "left_anti").join(gone.select(F.col("i").alias("j")), "j", "left_anti").select("i", "j", "v")
                    edges = written(stay.unionByName(less.filter("i <> j")).groupBy("i", "j").agg(F.sum("v").alias("v")), "edges")
                    own = less.filter("i = j").select("i", F.col("v").alias("d"))
                    diagonal = written(diagonal.join(gone, "i", "left_anti").unionByName(own).groupBy("i").agg(F.sum("d").alias("d")), "diagonal")
                    self.fill += columns.count()
                    self.logs += logs
                removed(spark, old)
                old = [x for x in made if x not in kept]
            names = diagonal.select("i")
            # the rest in its own numbers, which a dense solver takes
            number = written(placed(names, [F.asc("i")], "k").select("i", (F.col("k") - 1).cast("bigint").alias("k")), "rest")
            self.names, self.left = number, number.count()
            ids = lambda c, to: number.select(F.col("i").alias(c), F.col("k").alias(to))
            dense = edges.unionByName(diagonal.select("i", F.col("i").alias("j"), F.col("d").alias("v")))
            self.rest = written(dense.join(ids("i", "p"), "i").join(ids("j", "q"), "j").select(F.col("p").alias("i"), F.col("q").alias("j"), "v"), "rest")
            removed(spark, old)

    @staticmethod
    def _picked(edges: DataFrame, diagonal: DataFrame, degree: int, level: int) -> DataFrame:
        """(i, d): rows of at most so many neighbours, none next to another."""
        degrees = edges.groupBy("i").agg(F.count("*").alias("n"))
        rows = diagonal.join(degrees, "i", "left").select("i", "d", F.coalesce("n", F.lit(0)).alias("n")).filter(F.col("n") <= degree)
        first = F.struct("n", F.xxhash64("i", F.lit(level)).alias("h"), "i").alias("first")
        rows = written(rows.select("i", "d", first), "candidates")
        near = edges.join(rows.select("i"), "i", "left_semi").join(rows.select(F.col("i").alias("j"), F.col("first").alias("other")), "j").groupBy("i").agg(F.min("other").alias("other"))
        free = rows.join(near, "i", "left").filter(F.col("other").isNull() | (F.col("first") < F.col("other")))
        return written(free.select("i", "d"), "picked")

    @tidy
    def solve(self, b: DataFrame) -> DataFrame:
        """(i, j, v) of A^-1 B, a table."""
        if not self.made:
            raise ValueError("this was freed")
        left = written(b.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.col("v").cast("double").alias("v")), "right")
        right: list[DataFrame] = []
        for picked, columns in self.levels:
            own = written(left.join(picked.select("i"), "i", "left_semi"), "own")
            right.append(own)
            less = columns.join(own.select(F.col("i").alias("k"), "j", F.col("v").alias("y")), "k").select("i", "j", (-F.col("l") * F.col("y")).alias("v"))
            left = written(left.join(picked.select("i"), "i", "left_anti").unionByName(less).groupBy("i", "j").agg(F.sum("v").alias("v")), "right")
        done = None
        if self.left:
            rest = left.join(self.names, "i").select(F.col("k").alias("i"), "j", "v")
            x = solve.solved(self.rest, rest, ("cholesky",))
            done = written(x.withColumnRenamed("i", "k").join(self.names, "k").select("i", "j", "v"), "solution")
        for (picked, columns), own in zip(reversed(self.levels), reversed(right), strict=True):
            first = own.join(picked, "i").select("i", "j", (F.col("v") / F.col("d")).alias("v"))
            if done is not None:
                less = columns.join(done.select("i", "j", F.col("v").alias("x")), "i").select(F.col("k").alias("i"), "j", (-F.col("l") * F.col("x")).alias("v"))
                first = first.unionByName(less)
            now = first.groupBy("i", "j").agg(F.sum("v").alias("v"))
            done = written(now if done is None else done.unionByName(now), "solution")
        return done if done is not None else left

    def log_determinant(self) -> float:
        """Of the matrix."""
        return self.logs + (solve.log_determinant(self.rest).first()[0] if self.left else 0.0)

    def free(self) -> None:
        if not self.made:
            raise ValueError("this was freed")
        removed(self.names.sparkSession, self.made)


def solved(a: DataFrame, b: DataFrame, degree: int = DEGREE, left: int = LEFT) -> DataFrame:
    """(i, j, v) of A^-1 B for a sparse positive definite A."""
    f = SparseCholesky(a, degree, left)
    out = f.solve(b)
    f.free()
    return out
