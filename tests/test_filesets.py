"""Filesets: conditions that bound what is read, writing in two steps, ids from tables."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from genospark.sources import codec, files, plink


def geno(spark, m):
    rows = [(int(i), int(j), None if m[i, j] < 0 else int(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])]
    return spark.createDataFrame(rows, "snp_idx long, indiv_idx long, dosage int").repartition(3)


@pytest.fixture
def m():
    return np.random.default_rng(3).integers(-1, 3, (31, 23))


@pytest.fixture
def stem(spark, m, tmp_path):
    plink.write_bed(geno(spark, m), str(tmp_path / "x"), 23, 31)
    return str(tmp_path / "x")


CONDITIONS = {
    "snp_idx = 7": (7, 8, 0, 23),
    "snp_idx BETWEEN 4 AND 9 AND indiv_idx < 6": (4, 10, 0, 6),
    "snp_idx > 28 AND indiv_idx >= 21": (29, 31, 21, 23),
    "snp_idx IN (3, 5, 12)": (3, 13, 0, 23),
    "snp_idx < 0": (0, 0, 0, 23),
    "snp_idx = 2 AND snp_idx > 5": (6, 3, 0, 23),
    "indiv_idx = 9 AND dosage = 1": (0, 31, 9, 10),
    "snp_idx + 1 = 4 OR indiv_idx = 2": (0, 31, 0, 23),
}


@pytest.mark.parametrize("condition", list(CONDITIONS))
def test_conditions_reach_the_reader(spark, stem, m, condition):
    df = plink.read_bed(spark, stem + ".bed").filter(condition)
    everything = [(i, j, None if m[i, j] < 0 else int(m[i, j])) for i in range(31) for j in range(23)]
    table = spark.createDataFrame(everything, "snp_idx long, indiv_idx long, dosage int").filter(condition)
    assert sorted(map(str, df.collect())) == sorted(map(str, table.collect()))


def test_ranges_bound_what_is_read(stem, monkeypatch):
    """The bytes that a reader asks for are those of the SNPs in the range."""
    for filters, (start, stop, low, high) in (
        ([plink.GreaterThan(("snp_idx",), 4), plink.LessThanOrEqual(("snp_idx",), 9)], (5, 10, 0, 23)),
        ([plink.EqualTo(("snp_idx",), 30), plink.LessThan(("indiv_idx",), 5)], (30, 31, 0, 5)),
        ([plink.In(("snp_idx",), (8, 4)), plink.EqualTo(("dosage",), 1)], (4, 9, 0, 23)),
    ):
        reader = plink.BedReader({"path": stem + ".bed", "individuals": "23", "snps": "31", "rows": "4"})
        left = list(reader.pushFilters(filters))
        assert left == [f for f in filters if isinstance(f, plink.In) or f.attribute == ("dosage",)]
        parts = reader.partitions()
        assert (parts[0].start, parts[-1].stop) == (start, stop)
        rows = [b for p in parts for b in reader.read(p)]
        assert sum(b.num_rows for b in rows) == (stop - start) * (high - low)
        assert {x for b in rows for x in b.column("indiv_idx").to_pylist()} == set(range(low, high))


def test_plan_shows_the_conditions(spark, stem):
    df = plink.read_bed(spark, stem + ".bed").filter("snp_idx BETWEEN 4 AND 9")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "Filter" not in plan.replace("RuntimeFilters", "")


def test_task_that_runs_twice(tmp_path):
    """A task's first attempt dies half way, its second one and the others write all: one right file, once it is committed."""
    lines = [bytes([k, 255 - k]) for k in range(9)]
    batch = lambda ks: pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array([lines[k] for k in ks], pa.binary())], names=["snp_idx", "codes"])
    path = str(tmp_path / "y.bed")
    writer = plink.BedWriter({"path": path, "individuals": "8", "snps": "9"})

    def dying():
        yield batch([0, 1])
        raise OSError("killed")

    with pytest.raises(OSError):
        writer.write(dying())
    done = [writer.write(iter([batch([0, 1, 2])])), writer.write(iter([batch([3, 4, 5]), batch([6, 7, 8])])), None]
    assert not os.path.exists(path)
    writer.commit(done)
    assert open(path, "rb").read() == plink.MAGIC + b"".join(lines) and os.listdir(tmp_path) == ["y.bed"]
    again = plink.BedWriter({"path": path, "individuals": "8", "snps": "9"})
    with pytest.raises(ValueError, match="some twice"):
        again.commit([again.write(iter([batch([0, 1, 2, 3, 4, 5, 6, 7, 7])]))])
    third = plink.BedWriter({"path": path, "individuals": "8", "snps": "9"})
    third.abort([])
    assert open(path, "rb").read() == plink.MAGIC + b"".join(lines) and os.listdir(tmp_path) == ["y.bed"]


def test_failure_leaves_the_old_file(spark, m, stem):
    before = open(stem + ".bed", "rb").read()
    with pytest.raises(Exception, match="not complete|SNPs, not"):
        plink.write_bed(geno(spark, m).filter("snp_idx <> 3"), stem, 23, 31)
    with pytest.raises(Exception, match="not complete|SNPs, not"):
        plink.write_bed(geno(spark, m).filter("snp_idx <> 3 OR indiv_idx < 4"), stem, 23, 31)
    assert open(stem + ".bed", "rb").read() == before
    assert not [x for x in os.listdir(os.path.dirname(stem)) if x.count(".") > 1]


def test_ids_from_tables(spark, m, tmp_path):
    stem = str(tmp_path / "ids")
    fam = spark.range(23).select(F.col("id").alias("indiv_idx"), F.concat(F.lit("i"), F.col("id")).alias("iid"), F.when(F.col("id") % 2 == 0, 1).alias("sex"))
    plink.write_bed(geno(spark, m), stem, 23, 31, fam=fam.repartition(5))
    got = {r.iid: r.sex for r in plink.read_fam(spark, "file://" + stem + ".fam").collect()}
    assert got == {f"i{k}": 1 if k % 2 == 0 else 0 for k in range(23)}
    assert open(stem + ".fam").read().split("\n")[0] == "fam0 i0 0 0 1 -9"
    for bad, message in ((fam.filter("indiv_idx <> 5"), "missing or repeated"), (fam.unionByName(fam.limit(1)), "missing or repeated"), (fam.withColumn("iid", F.lit("a b")), "white space")):
        with pytest.raises(Exception, match=message):
            plink.write_bed(geno(spark, m), stem, 23, 31, fam=bad)


def test_lines_of_many_pieces(spark, tmp_path):
    n = 250_001
    rows = spark.range(n).select(F.col("id").alias("at"), F.concat(F.lit("line "), F.col("id") * F.col("id")).alias("line")).repartition(7)
    files.write_lines(rows, str(tmp_path / "t"), n)
    assert open(tmp_path / "t").read() == "".join(f"line {k * k}\n" for k in range(n))
    with pytest.raises(Exception, match="not 400000 lines|missing or repeated"):
        files.write_lines(rows, str(tmp_path / "u"), 400_000)


def test_spaces_and_tabs(spark, tmp_path):
    (tmp_path / "f.fam").write_text("a\tb  0 0 1   2.5\n c d\t\t0 0 2 -9\n")
    assert [tuple(r) for r in plink.read_fam(spark, f"file://{tmp_path}/f.fam").collect()] == [("a", "b", "0", "0", 1, 2.5), ("c", "d", "0", "0", 2, -9.0)]


def test_products_of_a_file(spark, tmp_path):
    m = np.random.default_rng(4).integers(0, 3, (37, 29))
    stem = str(tmp_path / "z")
    plink.write_bed(geno(spark, m), stem, 29, 37)
    x, y = np.random.default_rng(5).normal(size=37), np.random.default_rng(6).normal(size=29)
    rows = lambda v: spark.createDataFrame([(k, float(a)) for k, a in enumerate(v)], "i long, v double")
    got = {r.i: r.v for r in plink.file_product(spark, stem + ".bed", rows(x)).collect()}
    assert np.allclose([got[k] for k in range(29)], m.T @ x)
    got = {r.i: r.v for r in plink.file_product(spark, stem + ".bed", rows(y), True).collect()}
    assert np.allclose([got[k] for k in range(37)], m @ y)


def test_a_long_line_is_written_in_pieces(spark, tmp_path, monkeypatch):
    """No task collects a line: its bytes are written piece by piece; a piece that is missing is an error."""
    monkeypatch.setattr(codec, "PIECE", 8)
    monkeypatch.setattr(plink, "PIECE", 8)
    m = np.random.default_rng(12).integers(-1, 3, (5, 101))
    rows = [(i, j, None if m[i, j] < 0 else int(m[i, j])) for i in range(5) for j in range(101)]
    geno = spark.createDataFrame(rows, "snp_idx long, indiv_idx long, dosage int").repartition(3)
    assert {len(r.codes) for r in codec.pieces(geno, "plink").collect()} == {8, 2}
    stem = str(tmp_path / "long")
    plink.write_bed(geno, stem, 101, 5)
    assert sorted(plink.read_bed(spark, stem + ".bed").collect(), key=lambda r: (r.snp_idx, r.indiv_idx)) == sorted(rows, key=lambda r: r[:2])
    assert {r.snp_idx: r.codes for r in codec.packed(geno, "plink").collect()} == {r.snp_idx: r.codes for r in plink.read_lines(spark, stem + ".bed").collect()}
    with pytest.raises(Exception, match="not complete|pieces"):
        plink.write_bed(geno.filter("NOT (snp_idx = 2 AND indiv_idx BETWEEN 32 AND 63)"), str(tmp_path / "gap"), 101, 5)


def test_cells_become_pieces_where_they_are(spark):
    """No cell and no byte is a row of a shuffle or an aggregate: parts of pieces are, and of text files no list of lines is collected."""
    from genospark.sources import codec

    cell = spark.range(3 * 50).select(F.expr("id % 3").alias("snp_idx"), F.expr("id div 3").alias("indiv_idx"), F.expr("cast(if(id % 11 = 4, null, id % 3) as int)").alias("dosage"))
    for coding in ("plink", "2bit", "5codes"):
        made = codec.pieces(cell.repartition(7), coding)
        assert "Aggregate" not in made._jdf.queryExecution().analyzed().toString()
        assert sorted((r.snp_idx, r.piece, bytes(r.codes)) for r in made.collect()) == sorted((s, 0, bytes(c)) for s, c in _bytes_of(codec.packed_bytes(cell, coding)).items())


def _bytes_of(codes):
    out = {}
    for r in codes.orderBy("snp_idx", "byte_idx").collect():
        out.setdefault(r.snp_idx, []).append(r.code)
    return out
