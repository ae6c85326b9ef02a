"""Draws that are functions of their cell, as-of scans, patched haplotypes, trees of QR factors, sparse factors."""

import hashlib
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from genospark.functions import draws
from genospark.operators import sim, solve, sparse


def test_draws_are_functions_of_the_cell(spark):
    cells = spark.range(4000).select((F.col("id") % 80).alias("i"), F.expr("id div 80").alias("j"))
    made = lambda n: cells.repartition(n).select("i", "j", draws.uniform(7, F.col("i"), F.col("j")).alias("u"), draws.normal(7, F.col("i"), F.col("j")).alias("z"))
    one, eight = (sorted(map(tuple, made(n).collect())) for n in (1, 8))
    assert one == eight
    for i, j, u, _ in one[:50]:
        assert u == int(hashlib.md5(f"7:{i}:{j}".encode()).hexdigest()[:13], 16) / 2**52
    u, z = (np.array([r[k] for r in one]) for k in (2, 3))
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.02 and abs(u.var() - 1 / 12) < 0.005
    assert abs(z.mean()) < 0.06 and abs(z.var() - 1) < 0.08 and abs(np.corrcoef(z[:-1], z[1:])[0, 1]) < 0.06


def test_draws_of_operators_do_not_depend_on_partitions(spark):
    f = spark.createDataFrame([(k, k / 40, None if k % 3 == 0 else 1 - k / 40) for k in range(40)], "snp_idx long, freq1 double, freq2 double")
    got = [sorted(map(tuple, sim.random_haplotypes(f.repartition(n), 50, 3).collect())) for n in (1, 8)]
    assert got[0] == got[1]
    ones = {(s, h): sum(r[3] for r in got[0] if r[0] == s and r[2] == h) / 50 for s in range(40) for h in (0, 1)}
    assert abs(np.mean([ones[s, 0] - s / 40 for s in range(40)])) < 0.05 and all(ones[s, 0] == ones[s, 1] for s in range(0, 40, 3))


@pytest.mark.parametrize("parts", ["1", "5"])
def test_last_at_or_before(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rng = np.random.default_rng(1)
        pos = np.sort(rng.integers(0, 300, 120)) / 2
        xs = [*rng.integers(-20, 400, 300) / 2, *[50.0] * 200, None, -math.inf, math.inf]
        positions = spark.createDataFrame([(k, float(p)) for k, p in enumerate(pos)], "snp_idx long, pos double").repartition(4)
        points = spark.createDataFrame([(k, None if x is None else float(x), f"p{k}") for k, x in enumerate(xs)], "k long, x double, till_name string").repartition(3)
        got = {r.k: r.till for r in sim.last_at_or_before(points, positions).collect()}
        assert got == {k: None if x is None else int(np.searchsorted(pos, x, "right")) - 1 for k, x in enumerate(xs)}
        assert {r.till for r in sim.last_at_or_before(points.filter("x IS NOT NULL"), positions.limit(0)).collect()} == {-1}
        assert sim.last_at_or_before(points.limit(0), positions).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("block", [4096, 16])
def test_haplotypes(spark, block, monkeypatch):
    monkeypatch.setattr(sim, "BLOCK", block)
    rng = np.random.default_rng(2)
    n, people = 90, 12
    pos = np.arange(n) * 2.0 + 1
    founders = rng.integers(0, 2, (6, n))
    breaks, origins, flips, want = [], [], [], {}
    for i in range(people):
        for h in (0, 1):
            cuts = [0.0, *np.sort(rng.random(3) * 2 * n).tolist(), 2.0 * n + 5][: 2 + (i + h) % 4]
            for k, x in enumerate(cuts):
                breaks.append((i, h, k, x))
                if k:
                    o = int(rng.integers(0, 6))
                    origins.append((i, h, k, o))
                    for s in np.flatnonzero((pos > cuts[k - 1]) & (pos <= x)):
                        want[int(s), i, h] = int(founders[o, s])
            for s in rng.integers(0, n, 4).tolist() + [int(rng.integers(0, n))] * 2:
                flips.append((i, h, s))
    for i, h, s in flips:
        if (s, i, h) in want:
            want[s, i, h] ^= 1
    frame = spark.createDataFrame
    got = sim.haplotypes(
        frame(breaks, "indiv_idx long, hap int, number long, x double").repartition(3),
        frame(origins, "indiv_idx long, hap int, number long, origin long"),
        frame([(o, s, int(founders[o, s])) for o in range(6) for s in range(n)], "origin long, snp_idx long, allele int").repartition(4),
        frame(flips, "indiv_idx long, hap int, snp_idx long"),
        frame([(k, float(p)) for k, p in enumerate(pos)], "snp_idx long, pos double"),
    )
    assert {(r.snp_idx, r.indiv_idx, r.hap): r.allele for r in got.collect()} == want


def test_tree_of_triangles(spark):
    m = np.random.default_rng(3).normal(size=(200, 6)) * [1, 1e6, 1, 1e-6, 1, 1]
    m[:, 4] = m[:, 0] + 1e-9 * m[:, 4]
    cells = spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i in range(200) for j in range(6)], "idx long, col int, v double").repartition(40)
    r = solve.triangle_of(cells, 6)
    want = np.linalg.qr(m, mode="r")
    assert np.allclose(r, want * np.where(np.diag(want) < 0, -1, 1)[:, None], rtol=1e-6, atol=1e-9) and not np.tril(r, -1).any()
    q = np.zeros((200, 6))
    for x in solve.orthogonalised(cells, 6).collect():
        q[x["idx"], x["col"]] = x["v"]
    assert np.allclose(q.T @ q, np.eye(6), atol=1e-10)


def _grid(n):
    """The five-point matrix of an n x n grid, with a row that is tied to all others."""
    a = np.zeros((n * n + 1, n * n + 1))
    for i in range(n):
        for j in range(n):
            k = i * n + j
            a[k, k] = 6
            for p, q in ((i + 1, j), (i, j + 1)):
                if p < n and q < n:
                    a[k, p * n + q] = a[p * n + q, k] = -1
    a[-1, :-1] = a[:-1, -1] = 0.05
    a[-1, -1] = 50
    return a


def test_sparse_factor(spark):
    """From the lower triangle alone."""
    from genospark.plans.tables import shared_dir

    a = _grid(6)
    n = len(a)
    cells = [(int(i) * 3, int(j) * 3, float(a[i, j])) for i, j in zip(*np.nonzero(np.tril(a)), strict=True)]
    b = np.random.default_rng(4).normal(size=(n, 2))
    rows = spark.createDataFrame([(i * 3, j, float(b[i, j])) for i in range(n) for j in (0, 1)], "i long, j long, v double")
    f = sparse.SparseCholesky(spark.createDataFrame(cells, "i long, j long, v double").repartition(3), degree=12, left=9)
    assert len(f.levels) > 2 and 0 < f.fill < n * n / 4
    for scale in (1.0, -2.0):
        got = np.zeros((n, 2))
        for r in f.solve(rows.withColumn("v", F.col("v") * scale)).collect():
            got[r.i // 3, r.j] = r.v
        assert np.allclose(got, np.linalg.solve(a, b * scale))
    assert np.isclose(f.log_determinant(), np.linalg.slogdet(a)[1])
    folder = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    had = len(os.listdir(folder))
    f.free()
    assert len(os.listdir(folder)) < had
    with pytest.raises(ValueError, match="freed"):
        f.solve(rows)


def test_sparse_factor_refuses(spark):
    frame = lambda rows: spark.createDataFrame(rows, "i long, j long, v double")
    with pytest.raises(np.linalg.LinAlgError, match="not positive"):
        sparse.SparseCholesky(frame([(0, 0, 1.0), (1, 1, 1.0), (0, 1, 2.0)]), left=0)
    with pytest.raises(ValueError, match="symmetric"):
        sparse.SparseCholesky(frame([(0, 0, 1.0), (1, 1, 1.0), (0, 1, 0.2), (1, 0, 0.1)]))
    with pytest.raises(np.linalg.LinAlgError, match="no diagonal"):
        sparse.SparseCholesky(frame([(0, 0, 1.0), (0, 1, 0.2)]))
    only = sparse.solved(frame([(k, k, float(k + 1)) for k in range(5)]), frame([(k, 0, 1.0) for k in range(5)]), left=0).collect()
    assert {r.i: r.v for r in only} == {k: 1 / (k + 1) for k in range(5)}


def test_integrals_hold_few_rows_at_once():
    """10,000 rows of 1,200 nodes took 384 MB; Struve's function takes rows together and agrees with its series, summed exactly."""
    import tracemalloc
    from fractions import Fraction

    from genospark.functions import scalar

    tracemalloc.start()
    y = np.linspace(0.01, 50, 10_000)
    out = scalar.log_bessel_k_np(y, np.full(len(y), 1.5))
    assert tracemalloc.get_traced_memory()[1] < 40e6
    tracemalloc.stop()
    assert np.allclose(out, 0.5 * np.log(np.pi / (2 * y)) - y + np.log1p(1 / y))
    for nu in (Fraction(1, 2), Fraction(7), Fraction(40)):
        for x in (Fraction(41, 2), Fraction(301, 4)):
            term = total = Fraction(1)
            for k in range(300):
                term = -term * x * x / 4 / ((k + Fraction(3, 2)) * (k + nu + Fraction(3, 2)))
                total += term
            due = float(total) * math.exp(float(nu + 1) * math.log(float(x) / 2) - math.lgamma(1.5) - math.lgamma(float(nu) + 1.5))
            got = scalar.struve_np(np.array([float(x)]), np.array([float(nu)]), -1.0)[0]
            if nu < 40:
                assert abs(got - due) < 1e-9 * max(1, abs(due)), (nu, x)
            else:  # cancels: Y and the difference to it are far larger
                assert abs(got - due) < max(1e-2, 1e-6 * abs(due)), (nu, x)
    x = np.linspace(21, 200, 700)
    assert np.allclose(scalar.struve_np(x, np.full(700, 0.5), -1.0), np.sqrt(2 / (np.pi * x)) * (1 - np.cos(x)), atol=1e-11)


def test_dense_products_join_tiles(spark, monkeypatch):
    """Cells, gaps and negative places as from the join by cell, and exact beyond 2^53; no join of cells is in the plan."""
    from genospark.operators import products

    monkeypatch.setattr(products, "TILE", 8)
    r = np.random.default_rng(3)
    rows = [(int(i) - 5, int(j), int(v)) for i in range(30) for j in range(11) if r.random() < 0.5 and i != 9 for v in r.integers(-(2**28), 2**28, 1)]
    a = spark.createDataFrame([*rows, rows[0]], "i long, j long, v long").repartition(3)
    for ta, tb in ((False, True), (True, False)):
        assert sorted(products.matmul_tiled(a, a, ta, tb).collect()) == sorted(products.matmul(a, a, ta, tb).collect())
    x = a.withColumn("v", F.col("v") / 7)
    got, due = (sorted(f(x, a, tb=True).collect()) for f in (products.matmul_tiled, products.matmul))
    assert [g[:2] for g in got] == [d[:2] for d in due] and np.allclose([g.v for g in got], [d.v for d in due])


def test_a_founder_that_many_take_is_sent_to_many_places(spark, monkeypatch):
    """Salted or not, haplotypes are the same, and no key holds more than its share of pieces."""
    monkeypatch.setattr(sim, "PIECES", 16)
    k = spark.range(300)
    breaks = k.select(F.col("id").alias("indiv_idx"), F.lit(0).alias("hap"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("number")).withColumn("x", F.col("number") * 40.0)
    origins = breaks.filter("number > 0").select("indiv_idx", "hap", "number", F.when(F.col("indiv_idx") < 280, 0).otherwise(1).cast("bigint").alias("origin"))
    founders = spark.range(40).select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("origin"), F.col("id").alias("snp_idx")).withColumn("allele", ((F.col("snp_idx") + F.col("origin")) % 2).cast("int"))
    flips = k.select(F.col("id").alias("indiv_idx"), F.lit(0).alias("hap"), (F.col("id") % 40).alias("snp_idx"))
    positions = spark.range(40).select(F.col("id").alias("snp_idx"), F.col("id").cast("double").alias("pos"))
    out = sim.haplotypes(breaks, origins, founders, flips, positions)
    assert "salt" in out._jdf.queryExecution().analyzed().toString()
    rows = {(r.indiv_idx, r.snp_idx): r.allele for r in out.collect()}
    assert rows == {(i, s): (s + (i >= 280) + (s == i % 40)) % 2 for i in range(300) for s in range(40)}


def test_tiles_go_to_groups_of_blocks(spark, monkeypatch):
    """A tile is sent to each group of blocks of the other side, not to each block; whole numbers travel in the narrowest type."""
    from genospark.operators import products

    r = np.random.default_rng(4)
    for places, side in ((6, 4), (11, 2)):
        monkeypatch.setattr(products, "TILE", 8)
        monkeypatch.setattr(products, "WIDE", side)
        monkeypatch.setattr(products, "SIDE", side)
        m = r.integers(-100, 100, (32 * 8, places))
        a = cells_of(spark, m)
        one = products._tiles(a.select("i", F.col("j").alias("k"), F.col("v").alias("x")), "i")
        assert {x.kind for x in one.collect()} == {"|i1"}
        met, alone = products._met_tiles(one, one)
        assert alone == (places <= 8)
        assert met.count() == 2 * 32 * (32 // side) * -(-places // 8)
        got = {(x.i, x.j): x.v for x in products.matmul_tiled(a, a, tb=True).collect()}
        due = m @ m.T
        assert len(got) == due.size and all(got[i, j] == due[i, j] for i in range(len(m)) for j in range(len(m)))
    for v in (127, -128, 128, -129, 2**31, -(2**63), 2**63 - 1):
        tile = products._tiles(spark.createDataFrame([(0, 0, v)], "i long, k long, x long"), "i").first()
        assert np.frombuffer(tile.data, tile.kind).tolist() == [v]


def cells_of(spark, m):
    return spark.createDataFrame([(i, j, int(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], "i long, j long, v long").coalesce(2)
