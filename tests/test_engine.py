"""The package's own operators against numpy and identities, and all queries against their SQL."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from genospark import model
from genospark.functions import scalar
from genospark.operators import products, select, sim, solve, stats
from genospark.plans import catalog
from genospark.sources import codec, plink
from genospark.streaming import running

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def geno_of(spark, m):
    s, i = np.indices(m.shape)
    rows = [(int(a), int(b), None if x < 0 else int(x)) for a, b, x in zip(s.ravel(), i.ravel(), m.ravel(), strict=True)]
    return spark.createDataFrame(rows, "snp_idx long, indiv_idx long, dosage int")


def coordinates(spark, a):
    i, j = np.indices(a.shape)
    return spark.createDataFrame(pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": a.ravel().astype(float)}))


def dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r[0], r[1]] = r[2]
    return out


@pytest.fixture(scope="module")
def m():
    return np.random.default_rng(1).integers(0, 3, (13, 11))


@pytest.fixture(scope="module")
def geno(spark, m):
    return geno_of(spark, m).cache()


def norm(x):
    return None if x is None or (isinstance(x, float) and math.isnan(x)) else round(x, 5) if isinstance(x, float) else x


#: Long ones, whose operators have tests of their own here, in test_tiles.py and in test_scans_and_sparse.py.
ELSEWHERE = {"triangular_reused", "dense_solve_exchanged", "sparse_solve", "principal_components"}


@needs_data
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - ELSEWHERE))
def test_query_against_sql(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(x) for x in r) for r in df.select(*columns).collect()), key=str)
    if name not in catalog.ORACLES:
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(norm(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=str)
    assert got == want


@needs_data
def test_products_of_whole_tables(spark):
    n = catalog.table(spark, SF, "embeddings").count()
    assert n > 64
    for name in ("matrix_vector", "matmul_transposed", "coo_file"):
        assert catalog.QUERIES[name](spark, SF).select("i").distinct().count() == n
    a = np.zeros((n, 64))
    for r in catalog.dense(spark, SF).collect():
        a[r.i, r.j] = r.v
    x = np.arange(1, 65)
    assert catalog.QUERIES["quadratic_form"](spark, SF).first()[0] == round(x @ (a.T @ a) @ x)


def test_products_against_numpy(spark, geno, m):
    p = m.mean(axis=1) / 2
    b = np.random.default_rng(2).normal(size=(13, 3))
    c = np.random.default_rng(3).normal(size=(11, 3))
    cells = lambda x: spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i in range(x.shape[0]) for j in range(x.shape[1])], "idx long, col long, v double")
    assert np.allclose(dense(products.geno_product(geno, cells(b), False), (11, 3)), (m.T - 2 * p) @ b)
    assert np.allclose(dense(products.geno_product(geno, cells(c), True), (13, 3)), (m.T - 2 * p).T @ c)
    with model.GenotypeMatrix(geno) as g:
        assert np.allclose(dense(g.multiply(cells(b), "n"), (11, 3)), (m.T - 2 * p) @ b)
    with pytest.raises(ValueError, match="flag"):
        model.transposed_flag("X")


@pytest.mark.parametrize("method", ["join", "blocked", "default"])
def test_crossproducts(spark, geno, m, method):
    kw = {"depth": 5, "width": 4} if method == "blocked" else {}
    method = "blocked" if method == "default" else method
    assert (dense(products.crossprod(geno, "snp_idx", method, **kw), (11, 11)) == m.T @ m).all()
    assert (dense(products.crossprod(geno, "indiv_idx", method, **kw), (13, 13)) == m @ m.T).all()


def test_relationship_identities(spark, geno, m):
    p = m.mean(axis=1) / 2
    z = m.T - 2 * p
    g = dense(products.grm(geno).select("i", "j", "g"), (11, 11))
    assert np.allclose(g, z @ z.T / (2 * p * (1 - p)).sum()) and np.allclose(g, g.T) and np.allclose(g.sum(axis=0), 0)
    r = dense(products.ld(geno), (13, 13))
    assert np.allclose(r, np.corrcoef(m)) and np.allclose(np.diag(r), 1)
    assert np.allclose(dense(products.centred_crossprod(geno, squared=True, normalize="global"), (11, 11)), g**2)


def test_crossproducts_in_slices(spark):
    """Gaps on both axes, absent cells, blocks of 3, slices of 2 places, larger dosages."""
    rng = np.random.default_rng(4)
    k, i = rng.integers(0, 40, 300) * 3, rng.integers(0, 25, 300) * 2 + 1
    cells = {(int(a), int(b)): int(c) for a, b, c in zip(k, i, rng.integers(0, 100, 300), strict=True)}
    df = spark.createDataFrame([(a, b, c) for (a, b), c in cells.items()], "snp_idx long, indiv_idx long, dosage int")
    x = np.zeros((120, 51))
    for (a, b), c in cells.items():
        x[a, b] = c
    there = sorted({b for _, b in cells})
    want = {(a, b): int(x[:, a] @ x[:, b]) for a in there for b in there}
    got = {(r.i, r.j): r.v for r in products.crossprod(df, depth=2, width=3).collect()}
    assert got == want
    assert products.crossprod(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="between"):
        products.crossprod(df.withColumn("dosage", F.lit(200)))


def test_centring_of_products(spark, geno, m):
    b, c = np.random.default_rng(2).normal(size=(13, 3)), np.random.default_rng(3).normal(size=(11, 3))
    cells = lambda x: spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i in range(x.shape[0]) for j in range(x.shape[1])], "idx long, col long, v double")
    p, z = m.mean(axis=1) / 2, m.T.astype(float)
    scale = np.sqrt((2 * p * (1 - p)).sum())
    for centring, centre in (("none", 0), ("row", 2 * p), ("column", m.mean(axis=0)[:, None])):
        for normalize, by in (("none", 1), ("global", scale)):
            kw = {"centring": centring, "normalize": normalize}
            assert np.allclose(dense(products.geno_product(geno, cells(b), False, **kw), (11, 3)), (z - centre) @ b / by)
            assert np.allclose(dense(products.geno_product(geno, cells(c), True, **kw), (13, 3)), (z - centre).T @ c / by)
            with model.GenotypeMatrix(geno, model.Options(**kw)) as h:
                assert np.allclose(dense(h.multiply(cells(b)), (11, 3)), (z - centre) @ b / by)
    with model.GenotypeMatrix(geno, model.Options(squared=True, centring="none")) as h:
        assert np.allclose(dense(h.crossprod(), (11, 11)), (m.T @ m) ** 2)
        h.check(13, 11)
        with pytest.raises(ValueError, match="not 13 of 12"):
            h.check(13, 12)
        with pytest.raises(ValueError, match="beyond"):
            h.multiply(cells(np.ones((14, 1))))
    with pytest.raises(ValueError):
        products.geno_product(geno, cells(b), False, centring="user")
    with pytest.raises(ValueError, match="multiple"):
        products.checked_length(spark.range(27).select(F.col("id").alias("pos"), F.col("id").alias("v")), 13)
    with pytest.raises(ValueError, match="every dosage"):
        products.ld(geno.filter("snp_idx > 0 OR indiv_idx > 0"))
    with pytest.raises(ValueError, match="square"):
        products.quadratic(spark.range(3).select(F.col("id").alias("i"), F.lit(1).alias("v")), coordinates(spark, np.ones((3, 4))))
    with pytest.raises(ValueError, match="unknown flags"):
        model.Options.of_flags(colour="red")


def test_missing_policies(spark):
    m = np.array([[0, -1, 2, 1], [1, 1, -1, 2]])
    g = geno_of(spark, m)
    assert dense(model.settled(g, "zero"), (2, 4)).tolist() == [[0, 0, 2, 1], [1, 1, 0, 2]]
    assert np.allclose(dense(model.settled(g, "mean"), (2, 4)), [[0, 1, 2, 1], [1, 1, 4 / 3, 2]])
    with pytest.raises(Exception, match="missing"):
        model.settled(g, "error").collect()
    assert {tuple(r) for r in stats.missing_cells(g).collect()} == {(0, 1), (1, 2)}


@pytest.mark.parametrize("coding,n", [("2bit", 4), ("plink", 5), ("5codes", 7), ("plink", 3), ("5codes", 10)])
def test_pack_and_unpack(spark, coding, n):
    m = np.random.default_rng(n).integers(-1 if coding == "plink" else 0, 3, (6, n))
    back = codec.unpacked(codec.packed(geno_of(spark, m), coding), n, coding)
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in geno_of(spark, m).collect()}


def test_any_coding_to_any(spark):
    m = np.random.default_rng(3).integers(0, 3, (5, 7))
    plain = geno_of(spark, m)
    for a in ("tidy", "2bit", "plink", "5codes"):
        data = plain if a == "tidy" else codec.packed(plain, a)
        for b in ("tidy", "2bit", "plink", "5codes"):
            out = codec.transformed(data, a, b, 7)
            out = out if b == "tidy" else codec.unpacked(out, 7, b)
            assert (dense(out, (5, 7)) == m).all()
    with pytest.raises(ValueError, match="haplotype"):
        codec.transformed(plain, "tidy", "haplotype", 7)


def test_byte_tables():
    there, back = codec.byte_table("plink", "2bit"), codec.byte_table("2bit", "plink")
    plain = [b for b in range(256) if all(b >> 2 * k & 3 != 1 for k in range(4))]
    assert all(back[there[b]] == b for b in plain) and there[0b00000001] == 0xFF and back[0b00000011] == 0x55


def test_bed_files(spark, tmp_path):
    m = np.random.default_rng(5).integers(-1, 3, (9, 6))
    g = geno_of(spark, m)
    stem = str(tmp_path / "x")
    plink.write_bed(g, stem, 6, 9)
    assert {tuple(r) for r in plink.read_bed(spark, stem + ".bed").collect()} == {tuple(r) for r in g.collect()}
    assert plink.read_bim(spark, "file://" + stem + ".bim").count() == 9 and plink.read_fam(spark, "file://" + stem + ".fam").count() == 6
    with open(stem + ".bed", "ab") as f:
        f.write(b"\0")
    with pytest.raises(Exception, match="bytes"):
        plink.read_bed(spark, stem + ".bed").collect()
    with pytest.raises(Exception, match="not complete"):
        plink.write_bed(g.filter("snp_idx <> 3 OR indiv_idx < 4"), str(tmp_path / "y"), 6, 9)
    with pytest.raises(Exception, match="8 SNPs"):
        plink.write_bed(g.filter("snp_idx <> 3"), str(tmp_path / "y"), 6, 9)
    raw = np.random.default_rng(6).normal(size=(7, 5))
    plink.write_raw(coordinates(spark, raw).repartition(4), str(tmp_path / "raw"), 7, 5)
    assert (np.fromfile(tmp_path / "raw").reshape(5, 7).T == raw).all()
    (tmp_path / "t.txt").write_text("header\n0129\n1120\n")
    with pytest.raises(Exception, match="missing or unknown"):
        plink.read_text(spark, f"file://{tmp_path}/t.txt", header=1).collect()
    (tmp_path / "u.txt").write_text("header\n0010\n1101\n")
    doubled = plink.read_text(spark, f"file://{tmp_path}/u.txt", header=1, doubled=True)
    assert {tuple(r) for r in doubled.collect()} == {(0, 0, 0), (0, 1, 1), (1, 0, 2), (1, 1, 1)}


def test_systems(spark):
    rng = np.random.default_rng(7)
    a = rng.normal(size=(9, 9))
    a, b = a @ a.T + np.eye(9), rng.normal(size=(9, 2))
    da, db = coordinates(spark, a), coordinates(spark, b)
    assert np.allclose(dense(solve.solved(da, db), (9, 2)), np.linalg.solve(a, b))
    assert np.allclose(dense(solve.solved(da), (9, 9)) @ a, np.eye(9))
    for method in ("lu", "qr", "svd", "eigen"):
        assert np.allclose(solve.solve_np(a, b, (method,)), np.linalg.solve(a, b))
    assert np.isclose(solve.log_determinant(da).first()[0], np.linalg.slogdet(a)[1])
    assert not solve.is_positive_definite(coordinates(spark, -a)).first()[0]
    f = np.linalg.cholesky(a)
    low = coordinates(spark, f).filter("j <= i")
    for most in (5000, 1):
        assert np.allclose(dense(solve.triangular(low, db, True, most=most), (9, 2)), np.linalg.solve(f, b))
    assert np.allclose(dense(solve.triangular(low, db, True, True), (9, 2)), np.linalg.solve(f.T, b))
    assert np.allclose(dense(solve.factored(low, db, True), (9, 2)), np.linalg.solve(a, b))
    for upper in (False, True):
        want = np.linalg.cholesky(a).T if upper else np.linalg.cholesky(a)
        assert np.allclose(dense(solve.cholesky(da, upper, most=4, side=4), (9, 9)), want)
    assert np.allclose(dense(solve.solved(da, db, most=4, side=4), (9, 2)), np.linalg.solve(a, b))
    assert np.allclose(dense(solve.solved(da, most=4, side=3), (9, 9)) @ a, np.eye(9))
    assert np.isclose(solve.log_determinant(da, most=4, side=2).first()[0], np.linalg.slogdet(a)[1])
    assert solve.is_positive_definite(da, most=4, side=4).first()[0] and not solve.is_positive_definite(coordinates(spark, -a), most=4, side=4).first()[0]
    assert not solve.is_positive_definite(coordinates(spark, a + np.triu(np.ones((9, 9)), 1)), most=4, side=4).first()[0]
    singular = np.ones((3, 3))
    assert np.allclose(singular @ solve.solve_np(singular, np.ones((3, 1))), 1)
    with pytest.raises(np.linalg.LinAlgError):
        solve.solve_np(singular, np.array([[1.0], [2], [3]]))
    assert solve.solve_np(np.diag([2.0, 0.0]), None).tolist() == [[0.5, 0], [0, 0]]


def test_systems_beyond_one_task(spark):
    """6,000 rows, in tiles; most of them are empty and never made."""
    n = 6000
    i = F.col("id")
    band = spark.range(n).select(F.explode(F.array(F.struct(i.alias("i"), i.alias("j"), F.lit(2.5).alias("v")), F.struct(i.alias("i"), (i + 1).alias("j"), F.lit(-1.0).alias("v")), F.struct((i + 1).alias("i"), i.alias("j"), F.lit(-1.0).alias("v")))).alias("c")).select("c.*").filter(f"i < {n} AND j < {n}")
    b = spark.range(n).select(i.alias("i"), F.lit(0).cast("bigint").alias("j"), (i % 7 + 1).cast("double").alias("v"))
    got = {r.i: r.v for r in solve.solved(band, b).collect()}
    x = np.array([got[k] for k in range(n)])
    back = 2.5 * x - np.r_[x[1:], 0] - np.r_[0, x[:-1]]
    assert np.allclose(back, np.arange(n) % 7 + 1)


def test_iterations(spark, geno, m):
    a = np.eye(6) * 4 + np.ones((6, 6))
    da = coordinates(spark, a)
    b = spark.createDataFrame([(k, float(k + 1)) for k in range(6)], "i long, v double")
    got = {r.i: r.v for r in solve.conjugate_gradient(lambda x: products.matvec(da, x), b, 1e-8).collect()}
    assert np.allclose([got[k] for k in range(6)], np.linalg.solve(a, np.arange(1, 7)))
    with pytest.raises(ArithmeticError, match="rounds"):
        solve.conjugate_gradient(lambda x: products.matvec(da, x), b, 1e-8, most=1)
    vectors, values = solve.principal_components(geno, 2, oversample=8)
    z = m.T - m.mean(axis=1)
    u, w, _ = np.linalg.svd(z)
    assert np.allclose(values, w[:2], rtol=1e-6)
    v = dense(vectors.select("idx", "col", "v"), (11, 2))
    assert np.allclose(np.abs((v * u[:, :2]).sum(axis=0)), 1, atol=1e-5)


def test_mixed_model(spark):
    rng = np.random.default_rng(8)
    z = rng.normal(size=(10, 20))
    g, x, y = z @ z.T / 20, np.c_[np.ones(10), np.arange(10.0)], rng.normal(size=10)
    dy = spark.createDataFrame([(k, float(v)) for k, v in enumerate(y)], "i long, v double")
    beta, values = solve.gblup(coordinates(spark, g), coordinates(spark, x), dy)
    v = np.linalg.inv(g + np.eye(10))
    want = np.linalg.solve(x.T @ v @ x, x.T @ v @ y)
    assert np.allclose([r.v for r in beta.orderBy("i").collect()], want)
    assert np.allclose([r.v for r in values.orderBy("i").collect()], g @ v @ (y - x @ want))


def test_special_functions():
    x = np.array([0.2, 1.0, 3.5])
    assert np.allclose(scalar.struve_np(x, 0.5, -1), np.sqrt(2 / (np.pi * x)) * (1 - np.cos(x)))
    assert np.allclose(scalar.struve_np(x, 0.5, 1, True), np.sqrt(2 / (np.pi * x)) * (np.cosh(x) - 1) * np.exp(-x))
    assert np.isnan(scalar.struve_np(-1, 0, 1)) and scalar.struve_np(0, 0, 1) == 0
    assert np.allclose(np.diff(scalar.i0_minus_l0_np([39.999, 40.001])), -2.5e-5 * 2e-0 * 0.2 / 0.2 * 0.0159, atol=1e-5)
    assert np.isclose(scalar.i0_minus_l0_np([1.0])[0], 1.2660658777520084 - 0.7102431859378909)
    assert np.allclose(scalar.matern_np(x, 2.5), (1 + x + x * x / 3) * np.exp(-x))
    for order in (1, 2, 3, 4):
        h = 1e-4
        slope = (scalar.matern_np(x + h, 3.2, 1.3, order - 1) - scalar.matern_np(x - h, 3.2, 1.3, order - 1)) / (2 * h)
        assert np.allclose(scalar.matern_np(x, 3.2, 1.3, order), slope, rtol=1e-4, atol=1e-6)
    assert np.allclose(scalar.matern_np(x, 1e7, 1.0), np.exp(-x * x / 4), rtol=1e-3)
    assert math.isnan(scalar.incomplete_gamma_py(0, 1, 1)) and np.isclose(scalar.incomplete_gamma_py(1, math.inf, 0), 0.21938393439552)
    assert np.isclose(scalar.incomplete_gamma_py(0.5, 2, -1.5), np.trapezoid(np.linspace(0.5, 2, 100001) ** -2.5 * np.exp(-np.linspace(0.5, 2, 100001)), dx=1.5 / 100000))
    with pytest.raises(ValueError):
        scalar.gauss(F.lit(1.0), 5)


def test_limits_at_zero():
    """The value at 0 is what the function tends to from the right."""
    for nu in (0.3, 0.5, 0.7, 1.0, 1.2, 1.5, 1.8, 2.0, 2.3, 2.5, 3.2):
        for order in range(5):
            at = float(scalar.matern_np(np.array([0.0]), nu, 0.0, order)[0])
            far, near = (float(scalar.matern_np(np.array([x]), nu, 0.0, order)[0]) for x in (3e-2, 1e-3))  # nearer, its terms cancel
            if math.isinf(at):
                assert at * near > 0 and abs(near) > abs(far) + 0.1, (nu, order)
            else:
                assert abs(near - at) <= max(0.6 * abs(far - at), 0.05 * max(1, abs(at))), (nu, order, at, near)
    assert scalar.matern_np(np.array([0.0]), 0.5, 0.0, 1)[0] == -1 and scalar.matern_np(np.array([0.0]), 0.3, 0.0, 1)[0] == -math.inf


def test_closed_forms(spark):
    x = np.r_[0, np.linspace(0.01, 30, 50), math.inf]
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    for nu in (0.5, 1.5, 3.5, 10.5):
        for order in range(5):
            for factor in (0.0, 1.4):
                got = [r.v for r in df.select(scalar.matern(F.col("x"), nu, factor, order).alias("v")).collect()]
                assert np.allclose(got, scalar.matern_np(x, nu, factor, order), rtol=1e-6, atol=1e-9), (nu, order)
    for s in (1, 2, 5):
        got = [r.v for r in df.select(scalar.incomplete_gamma(F.lit(0.25), F.lit(0.25) + F.col("x"), s).alias("v")).collect()]
        assert np.allclose(got, scalar.incomplete_gamma_np(np.full(len(x), 0.25), 0.25 + x, np.full(len(x), float(s))), atol=1e-12)
    assert math.isnan(df.select(scalar.incomplete_gamma(F.lit(0.0), F.col("x"), 1).alias("v")).first()[0])
    assert scalar.incomplete_gamma_np(np.array([0.0]), np.array([math.inf]), np.array([2.0]))[0] == 1


def test_order_in_ranges(spark):
    rng = np.random.default_rng(9)
    rows = [(int(k), int(v), None if w < 0.1 else float("nan") if w < 0.2 else float(round(w, 1))) for k, (v, w) in enumerate(zip(rng.integers(0, 3, 500), rng.random(500), strict=True))]
    df = spark.createDataFrame(rows, "id long, g long, x double").repartition(7)
    got = [(r["place"], r["index"]) for r in select.order_of(df, ["g"], "id").orderBy("place").collect()]
    assert got == [(p + 1, k) for p, (_, k) in enumerate(sorted((g, k) for k, g, _ in rows))]
    clean = [(k, None if x is None or math.isnan(x) else x) for k, _, x in rows]
    for last in (True, False):
        want = sorted(clean, key=lambda r: ((r[1] is None) == last, r[1] or 0, r[0]))
        part = select.sorted_slice(df, "x", 51, 300, last, "id").collect()
        assert [r.id for r in part] == [k for k, _ in want[50:300]]
    assert select.order_of(df.limit(0), ["g"], "id").count() == 0


def test_slices_and_orders_without_a_whole_sort(spark, monkeypatch):
    rng = np.random.default_rng(10)
    kinds = ((20, rng.normal(size=300), 5), (20, rng.integers(0, 3, 300).astype(float), 2), (100_000, rng.normal(size=300), 1))
    for few, values, cases in kinds:
        monkeypatch.setattr(select, "FEW", few)
        rows = [(int(k), None if w < 0.1 else float("nan") if w < 0.2 else float(v)) for k, (v, w) in enumerate(zip(values, rng.random(300), strict=True))]
        df = spark.createDataFrame(rows, "id long, x double").repartition(3).cache()
        clean = [(k, None if x is None or math.isnan(x) else x) for k, x in rows]
        for last, start, stop in ((False, 40, 90), (None, 230, 330), (True, 1, 15), (True, 120, 160), (True, 235, 305))[-cases:]:
            want = sorted((r for r in clean if last is not None or r[1] is not None), key=lambda r: ((r[1] is None) == bool(last), r[1] or 0, r[0]))
            part = [k for k, _ in want[start - 1 : stop]]
            assert [r.id for r in select.sorted_slice(df, "x", start, stop, last, "id").collect()] == part
            order = sorted(tuple(r) for r in select.order_of(df, ["x"], "id", start, stop, last).collect())
            assert order == list(enumerate(part, start))
    first = select.order_of(df, ["x"], "id").filter("place = 1").first()["index"]
    assert first == min((k for k, x in clean if x is not None), key=lambda k: (clean[k][1], k))


def test_sparse_rows(spark):
    df = spark.createDataFrame([(0, 0, 2.0), (0, 1, 3.0), (0, 2, 4.0), (1, 1, 5.0)], "i long, j long, v double")
    assert {r.i: r.v for r in stats.row_means(df).collect()} == {0: 3.0, 1: 5 / 3}
    assert {r.i: r.v for r in stats.row_prod(df).collect()} == {0: 24.0, 1: 0.0}
    assert {r.i: r.v for r in stats.row_prod(df, 4).collect()} == {0: 0.0, 1: 0.0}


def test_selection_edges(spark):
    with pytest.raises(ValueError):
        select.trimmed([9, 10], 9)
    df = spark.createDataFrame([(3.0,), (None,), (float("nan"),), (1.0,)], "x double")
    assert [r.x for r in select.sorted_slice(df, "x", -4, 2).collect()] == [1.0, 3.0]
    assert select.sorted_slice(df, "x", 3, 2).count() == 0
    with pytest.raises(Exception, match="out of range"):
        spark.range(1).select(select.origin_code(generation=F.lit(65), sex=F.lit(1), nr=F.lit(1), haplo=F.lit(1))).collect()
    with pytest.raises(ValueError):
        model.Options.matched(cent=True)
    assert sim.random_haplotypes(spark.createDataFrame([(0, 0.5, None)], "snp_idx long, freq1 double, freq2 double"), 40, 1).groupBy("indiv_idx").agg(F.countDistinct("allele").alias("n")).filter("n <> 1").count() == 0


def test_running_frequencies(spark, tmp_path, geno, m):
    geno.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(geno.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = running.running_allele_freq(stream).writeStream.outputMode("complete").format("memory").queryName("running_freq").start()
    q.processAllAvailable()
    q.stop()
    got = {r.snp_idx: r.freq for r in spark.table("running_freq").collect()}
    assert np.allclose([got[k] for k in range(13)], m.mean(axis=1) / 2)


def stored_size(df, path):
    df.write.parquet(str(path))
    return sum(f.stat().st_size for f in path.iterdir())


def test_all_cells_of_a_matrix(spark, tmp_path):
    """Each once, also where the last stripe is narrower, and stored in a small part of a byte each."""
    for snps, individuals in ((7, 600), (5, 256), (3, 1), (0, 4), (4, 0)):
        got = sorted(tuple(r) for r in model.zero_matrix(spark, snps, individuals).collect())
        assert got == [(s, i, 0) for s in range(snps) for i in range(individuals)]
    assert stored_size(model.zero_matrix(spark, 3000, 600), tmp_path / "zero") < 3000 * 600 / 3


def test_all_cells_of_the_pattern(spark, tmp_path):
    got = {(r.snp_idx, r.indiv_idx): r.dosage for r in sim.patterned(spark, 9, 300).collect()}
    assert got == {(k % 9, k // 9): sim.PATTERN[k % 17] for k in range(9 * 300)}
    assert stored_size(sim.patterned(spark, 3000, 600), tmp_path / "pattern") < 3000 * 600 / 3


def test_a_task_has_few_runs_of_snps(spark, monkeypatch):
    """All cells once each, and in a task the SNPs of a few runs only."""
    monkeypatch.setattr(model, "RUN", 16)
    monkeypatch.setattr(model, "STRIPE", 4)
    cells = model.every_cell(spark, 101, 31)
    rows = [tuple(r) for r in cells.collect()]
    assert len(rows) == 101 * 31 and set(rows) == {(s, i) for s in range(101) for i in range(31)}
    tasks = cells.groupBy(F.spark_partition_id()).agg(F.countDistinct("snp_idx").alias("n")).collect()
    assert len(tasks) == 4 and max(r.n for r in tasks) <= 3 * 16
