"""Systems in tiles: methods that are obeyed, elimination with row exchanges, triangular systems made ready once."""

import os

import numpy as np
import pandas as pd
import pytest

from genospark.operators import solve, tiles


def coordinates(spark, a):
    i, j = np.nonzero(np.ones_like(a) if a.shape[1] < 4 else a)
    return spark.createDataFrame(pd.DataFrame({"i": i, "j": j, "v": a[i, j].astype(float)}))


def dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r[0], r[1]] = r[2]
    return out


def test_elimination_with_exchanges(spark):
    """A regular matrix that is neither symmetric nor definite, with zeros where elimination begins."""
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(11, 11)), rng.normal(size=(11, 2))
    a[:5, :5] = 0
    da, db = coordinates(spark, a), coordinates(spark, b)
    assert np.allclose(dense(solve.solved(da, db, ("lu",), most=4, side=4), (11, 2)), np.linalg.solve(a, b))
    assert np.allclose(dense(solve.solved(da, db, ("cholesky", "lu"), most=4, side=6), (11, 2)), np.linalg.solve(a, b))
    with pytest.raises(ValueError, match="not by svd"):
        solve.solved(da, db, ("svd",), most=4)
    with pytest.raises(ValueError, match="not by eigen"):
        solve.solved(da, db, most=4, side=4)
    with pytest.raises(ValueError, match="no method"):
        solve.solved(da, db, ("magic",), most=4)
    a[7] = a[3] * 2
    a[:, 9] = 0
    with pytest.raises(np.linalg.LinAlgError, match="singular"):
        solve.solved(coordinates(spark, a), db, ("lu",), most=4, side=4)


def test_wavefronts():
    assert tiles.wavefronts([(0, 0), (1, 1), (2, 2), (3, 3), (2, 0), (3, 2)], 4, False) == [[0, 1], [2], [3]]
    assert tiles.wavefronts([(0, 0), (1, 1), (2, 2), (3, 3), (2, 0), (3, 2)], 4, True) == [[1, 3], [2], [0]]
    assert tiles.wavefronts([(k, k) for k in range(5)], 5, False) == [[0, 1, 2, 3, 4]]


def test_triangular_systems_made_ready_once(spark):
    rng = np.random.default_rng(2)
    a = np.tril(rng.normal(size=(14, 14))) + 3 * np.eye(14)
    a[5:10, :5] = 0  # rows of tiles that wait for nothing
    for lower in (True, False):
        m = a if lower else a.T
        for transposed in (False, True):
            t = solve.Triangular(coordinates(spark, m), lower, transposed, side=5)
            for seed in (3, 4) if lower else (3,):
                b = np.random.default_rng(seed).normal(size=(14, 2))
                assert np.allclose(dense(t.solve(coordinates(spark, b)), (14, 2)), np.linalg.solve(m.T if transposed else m, b))
            last = t.solve(coordinates(spark, b))
            t.free()
            assert np.allclose(dense(last, (14, 2)), np.linalg.solve(m.T if transposed else m, b))
            for again in (t.free, lambda: t.solve(last)):
                with pytest.raises(ValueError, match="freed"):
                    again()


def test_triangular_by_tiles_leaves_nothing(spark):
    from genospark.plans.tables import shared_dir

    folder = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    n = 30
    a = np.tril(np.random.default_rng(5).normal(size=(n, n))) + 4 * np.eye(n)
    b = np.ones((n, 1))
    out = solve.triangular(coordinates(spark, a), coordinates(spark, b), True, most=4, side=10)
    assert np.allclose(dense(out, (n, 1)), np.linalg.solve(a, b))
    assert len(set(os.listdir(folder)) - before) <= 1  # the solution
    f = np.linalg.cholesky(a @ a.T)
    low = coordinates(spark, f)
    assert np.allclose(dense(solve.factored(low, coordinates(spark, b), True, most=4, side=10), (n, 1)), np.linalg.solve(a @ a.T, b))
    with pytest.raises(Exception, match="zero on the diagonal"):
        solve.triangular(coordinates(spark, a - np.diag(np.diag(a))), coordinates(spark, b), True, most=4, side=10)
