"""PLINK filesets and the text formats around them."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from genospark.model import DOSAGE, INDIV, SNP
from genospark.sources.codec import PIECE, pieces
from genospark.sources.files import local, opened, size_of, write_at, write_lines

#: Fixed value: the first bytes of a SNP-major bed file.
MAGIC = b"\x6c\x1b\x01"
BIM = "chr string, snp_id string, cm double, bp bigint, a1 string, a2 string"
FAM = "fam_id string, iid string, father string, mother string, sex int, pheno double"


class Range(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class BedReader(DataSourceReader):
    """Ranges of SNPs, each read with one seek. Options: individuals, snps, header (bytes to skip; 3, and then
    checked), coding (plink or 2bit), rows (SNPs a partition), layout (cells, or lines of packed bytes). Conditions on snp_idx bound
    the range that is read; those on indiv_idx the cells that are made of it."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.n, self.snps = int(options["individuals"]), int(options["snps"])
        self.header, self.coding = int(options.get("header", 3)), options.get("coding", "plink")
        self.rows = int(options.get("rows", max(1, (64 << 20) // max(1, self.n))))
        self.lines = options.get("layout", "cells") == "lines"
        self.width = -(-self.n // 4)
        self.bounds = {SNP: [0, self.snps], INDIV: [0, self.n]}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what bounds an index from below or above, whose range then holds; gives the rest back."""
        for f in filters:
            column, value = getattr(f, "attribute", ("",))[0], getattr(f, "value", None)
            if isinstance(f, IsNotNull) and column in self.bounds:
                continue  # an index always is
            if column not in self.bounds or len(f.attribute) > 1 or not isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) or value is None:
                yield f
                continue
            low, high = self.bounds[column]
            if isinstance(f, In):
                own = [v for v in value if v is not None]
                low, high = (max(low, min(own)), min(high, max(own) + 1)) if own else (low, low)
                yield f  # the range may hold more
            elif isinstance(f, EqualTo):
                low, high = max(low, value), min(high, value + 1)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                low = max(low, value + isinstance(f, GreaterThan))
            else:
                high = min(high, value + isinstance(f, LessThanOrEqual))
            self.bounds[column] = [low, high]

    def partitions(self) -> list[Range]:
        size = size_of(self.path)
        if self.coding == "plink" and self.header == 3:
            if not self.path.endswith(".bed"):
                raise ValueError("the file's name must end in .bed")
            with opened(self.path) as f:
                if f.read(3) != MAGIC:
                    raise ValueError("not a SNP-major bed file")
        if size != self.header + self.snps * self.width:
            raise ValueError(f"{size} bytes; {self.snps} SNPs of {self.n} individuals take {self.header + self.snps * self.width}")
        start, stop = self.bounds[SNP]
        return [Range(a, min(a + self.rows, stop)) for a in range(start, stop, self.rows)] or [Range(0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        codes = [0, -1, 1, 2] if self.coding == "plink" else [0, 1, 2, -1]
        table = np.array([[codes[b >> 2 * k & 3] for k in range(4)] for b in range(256)], np.int8)
        low, high = self.bounds[INDIV]
        high = max(low, high)
        step = max(1, (1 << 20) // max(1, self.n))
        with opened(self.path) as f:
            f.seek(self.header + part.start * self.width)
            for a in range(part.start, part.stop, step):
                k = min(step, part.stop - a)
                data = f.read(k * self.width)
                if self.lines:
                    lines = [data[x : x + self.width] for x in range(0, len(data), self.width)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + k)), pa.array(lines, pa.binary())], names=[SNP, "codes"])
                    continue
                codes = np.frombuffer(data, np.uint8).reshape(k, -1)
                for lo in range(low, high, 1 << 18):  # a line may be long
                    hi = min(high, lo + (1 << 18))
                    x = table[codes[:, lo // 4 : -(-hi // 4)]].reshape(k, -1)[:, lo % 4 :][:, : hi - lo].ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(a, a + k), hi - lo)), pa.array(np.tile(np.arange(lo, hi), k)), pa.array(x.astype(np.int32), mask=x < 0)], names=[SNP, INDIV, DOSAGE])


@dataclass
class Written(WriterCommitMessage):
    """SNPs, or pieces of them, that a task has written: how many, and the sum of their numbers' hashes modulo 2^64."""

    count: int
    hashes: int


def _hash_sum(numbers: np.ndarray) -> int:
    x = numbers.astype(np.uint64) + np.uint64(1)
    for factor in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(factor)
    return int((x ^ (x >> np.uint64(32))).sum(dtype=np.uint64))


class BedWriter(DataSourceArrowWriter):
    """Writes lines of SNPs, or their pieces of PIECE bytes, at their places in a file beside the right one, which a commit renames to it once every SNP has been
    written, and an abort removes. A task that runs twice writes the same bytes twice; nothing passes through the driver. The
    path must be mounted by all machines."""

    def __init__(self, options: dict):
        self.path = local(options["path"])
        if self.path is None:
            raise ValueError("a bed file is written where all machines mount its path")
        self.n, self.snps = int(options["individuals"]), int(options["snps"])
        self.width = -(-self.n // 4)
        self.step = PIECE if options.get("layout") == "pieces" else max(1, self.width)
        self.each = max(1, -(-self.width // self.step))
        self.staged = f"{self.path}.{uuid.uuid4().hex}"
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        with open(self.staged, "wb") as f:
            f.write(MAGIC)
            f.truncate(len(MAGIC) + self.snps * self.width)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        count = hashes = 0
        with open(self.staged, "r+b") as f:
            for batch in iterator:
                snps = batch.column(SNP).to_numpy()
                pieces = batch.column("piece").to_numpy() if "piece" in batch.schema.names else np.zeros_like(snps)
                count, hashes = count + len(snps), hashes + _hash_sum(snps * self.each + pieces)
                for snp, piece, codes in zip(snps.tolist(), pieces.tolist(), batch.column("codes").to_pylist(), strict=True):
                    if not (0 <= snp < self.snps and 0 <= piece < self.each) or len(codes) != min(self.step, self.width - piece * self.step):
                        raise ValueError(f"not complete: SNP {snp}")
                    f.seek(len(MAGIC) + snp * self.width + piece * self.step)
                    f.write(codes)
            f.flush()
            os.fsync(f.fileno())
        return Written(count, hashes)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        count, hashes = (sum(getattr(m, c) for m in messages if m is not None) for c in ("count", "hashes"))
        n = self.snps * self.each
        due = sum(_hash_sum(np.arange(a, min(a + (1 << 20), n))) for a in range(0, n, 1 << 20))
        if count != n or (hashes - due) % 2**64:
            os.unlink(self.staged)
            raise ValueError(f"{count} {'SNPs' if self.each == 1 else 'pieces'}, not {n}, or some twice")
        os.replace(self.staged, self.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        if os.path.exists(self.staged):
            os.unlink(self.staged)


class BedSource(DataSource):
    """spark.read.format("plink_bed"): geno with NULL for missing dosages, or with the option layout=lines (snp_idx, codes) as it is
    stored; such lines can be written, also as pieces (snp_idx, piece, codes) with layout=pieces. Executors open the path themselves."""

    @classmethod
    def name(cls) -> str:
        return "plink_bed"

    def schema(self) -> str:
        if self.options.get("layout") == "pieces":
            return f"{SNP} bigint, piece bigint, codes binary"
        return f"{SNP} bigint, codes binary" if self.options.get("layout") == "lines" else f"{SNP} bigint, {INDIV} bigint, {DOSAGE} int"

    def reader(self, schema) -> BedReader:
        return BedReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> BedWriter:
        return BedWriter(dict(self.options))


def count_lines(path: str) -> int:
    with opened(path) as f:
        return sum(block.count(b"\n") for block in iter(lambda: f.read(1 << 20), b""))


def _source(spark: SparkSession) -> None:
    spark.dataSource.register(BedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def sizes_of(path: str) -> tuple[int, int]:
    """SNPs and individuals of a fileset, by the lines of its .bim and .fam."""
    stem = path.removesuffix(".bed")
    return count_lines(stem + ".bim"), count_lines(stem + ".fam")


def read_bed(spark: SparkSession, path: str, missing: str = "keep") -> DataFrame:
    """geno of a fileset: .bim and .fam beside the .bed give its dimensions. missing: "keep" or "error". A filter on snp_idx
    reads those SNPs' bytes only, one on indiv_idx unpacks those individuals only."""
    _source(spark)
    snps, individuals = sizes_of(path)
    geno = spark.read.format("plink_bed").options(individuals=individuals, snps=snps).load(path)
    if missing == "error":
        from genospark.model import settled

        return settled(geno, "error")
    return geno


def read_binary(spark: SparkSession, path: str, snps: int, individuals: int, header: int = 0) -> DataFrame:
    """geno of a file of 2-bit dosages after `header` bytes."""
    _source(spark)
    return spark.read.format("plink_bed").options(individuals=individuals, snps=snps, header=header, coding="2bit").load(path)


def minor_recoded(geno: DataFrame) -> DataFrame:
    """Dosages of the rarer allele: 2 - x where the frequency is at least a half; missing ones stay."""
    from genospark.operators.stats import allele_freq

    flip = F.col("freq") >= 0.5
    return geno.join(allele_freq(geno), SNP, "left").select(SNP, INDIV, F.when(flip, 2 - F.col(DOSAGE)).otherwise(F.col(DOSAGE)).alias(DOSAGE))


def with_threes(geno: DataFrame) -> DataFrame:
    """(snp_idx, indiv_idx, v): doubles, 3 for a missing dosage."""
    return geno.select(SNP, INDIV, F.coalesce(F.col(DOSAGE).cast("double"), F.lit(3.0)).alias("v"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(snp_idx, codes): the lines of a fileset as they are stored, a SNP each."""
    _source(spark)
    snps, individuals = sizes_of(path)
    return spark.read.format("plink_bed").options(individuals=individuals, snps=snps, layout="lines").load(path)


def read_packed(spark: SparkSession, path: str):
    """A fileset as a packed matrix; see operators.packed. No dosage is unpacked."""
    from genospark.operators import packed

    snps, individuals = sizes_of(path)
    return packed.of_lines(packed.cut(read_lines(spark, path)), snps, individuals)


def write_bed(geno: DataFrame, stem: str, individuals: int, snps: int, bim: DataFrame | None = None, fam: DataFrame | None = None) -> None:
    """A fileset. bim: (snp_idx and the columns of BIM), fam: (indiv_idx and those of FAM); of columns that are not given, and
    without the tables, ids are numbered, positions count from 1 and the rest is unknown. SNPs and individuals
    must be complete. The bed file appears, whole, when all else is written; see BedWriter."""
    spark = geno.sparkSession
    _source(spark)
    write_lines(_filled(spark, bim, SNP, snps, _BIM_ELSE, "\t"), stem + ".bim", snps)
    write_lines(_filled(spark, fam, INDIV, individuals, _FAM_ELSE, " "), stem + ".fam", individuals)
    pieces(geno, "plink").write.format("plink_bed").options(individuals=individuals, snps=snps, layout="pieces").mode("append").save(stem + ".bed")


def _filled(spark: SparkSession, given: DataFrame | None, key: str, n: int, other: dict[str, str], sep: str) -> DataFrame:
    """(at, line) of a table's rows by key, which must be 0 to n - 1, with other columns in the place of those that it lacks."""
    rows = spark.range(n).select(F.col("id").alias(key)) if given is None else given
    column = lambda c, e: F.coalesce(F.col(c).cast("string"), F.expr(e)) if c in rows.columns else F.expr(e)
    values: list[Column] = [column(c, e) for c, e in other.items()]
    whole = F.when(F.rlike(F.concat(*values), F.lit(r"[\s]")), F.raise_error(F.lit("white space in an id"))).otherwise(F.concat_ws(sep, *values))
    return rows.select(F.col(key).cast("bigint").alias("at"), whole.alias("line"))


#: What a column of a .bim or .fam file holds where the table does not say.
_BIM_ELSE = {"chr": "'1'", "snp_id": f"concat('snp', {SNP})", "cm": "'0'", "bp": f"string({SNP} + 1)", "a1": "'A'", "a2": "'C'"}
_FAM_ELSE = {"fam_id": f"concat('fam', {INDIV})", "iid": f"concat('ind', {INDIV})", "father": "'0'", "mother": "'0'", "sex": "'0'", "pheno": "'-9'"}


def read_bim(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=BIM)


def read_fam(spark: SparkSession, path: str) -> DataFrame:
    """Columns parted by any runs of spaces and tabs."""
    parts = F.split(F.trim(F.translate("value", "\t", " ")), " +")
    kinds = [c.split() for c in FAM.split(", ")]
    return spark.read.text(path).select(*[parts[k].cast(kind).alias(name) for k, (name, kind) in enumerate(kinds)])


def read_freq(spark: SparkSession, path: str) -> DataFrame:
    """(snp_ord, freq) from lines of an ordinal and a frequency, parted by any space."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(parts[0].cast("bigint").alias("snp_ord"), parts[1].cast("double").alias("freq"))


def read_coo(spark: SparkSession, path: str, one_based: bool = True) -> DataFrame:
    """(i, j, v), 0-based, from lines I J V."""
    rows = spark.read.csv(path, sep=" ", schema="i bigint, j bigint, v double")
    return rows.select((F.col("i") - int(one_based)).alias("i"), (F.col("j") - int(one_based)).alias("j"), "v")


def parsed_lines(lines: DataFrame, codes: str = "012", na: str = "9", leading: int = 0, sep: str = "", by_snp: bool = True, doubled: bool = False) -> DataFrame:
    """geno from (line_idx, value): one character a dosage, in the order of codes, after `leading` columns.
    by_snp: a line is a SNP. doubled: two alleles a dosage, side by side. Missing or unknown is an error."""
    pattern = sep if sep else ""
    cells = F.slice(F.split(F.rtrim("value"), pattern), leading + 1, 1 << 30)
    at = lines.select("line_idx", F.posexplode(F.filter(cells, lambda x: x != "")).alias("pos", "c"))
    place = F.instr(F.lit(codes), F.col("c")) - 1
    value = F.when((F.col("c") == na) | (place < 0), F.raise_error(F.lit("a genotype is missing or unknown")).cast("int")).otherwise(F.expr(f"instr('{codes}', c) - 1"))
    cell = at.select(F.col("line_idx").cast("bigint").alias("a"), F.col("pos").cast("bigint").alias("b"), value.alias("x"))
    if doubled:
        cell = cell.groupBy("a", F.expr("b div 2").alias("b")).agg(F.sum("x").cast("int").alias("x"))
    first, second = (SNP, INDIV) if by_snp else (INDIV, SNP)
    return cell.select(F.col("a").alias(first), F.col("b").alias(second), F.col("x").alias(DOSAGE)).select(SNP, INDIV, DOSAGE)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_idx, value) of the text files of a path, from 0, in order of their names and of place within."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("__f"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__k"))
    sizes = lines.groupBy("__f", "__b").agg(F.count("*").alias("n"), F.min("__k").alias("first"))
    upto = Window.orderBy("__f", "__b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split of a file
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("n")
    return lines.join(F.broadcast(starts), ["__f", "__b"]).select((F.col("start") + F.col("__k") - F.col("first")).alias("line_idx"), "value")


def read_text(spark: SparkSession, path: str, header: int = 0, **layout) -> DataFrame:
    """geno of a text file, whose first `header` lines are left out; see parsed_lines()."""
    lines = numbered_lines(spark, path).withColumn("line_idx", F.col("line_idx") - header)
    return parsed_lines(lines.filter("line_idx >= 0"), **layout)


def file_product(spark: SparkSession, path: str, x: DataFrame, transposed: bool = False) -> DataFrame:
    """(i, v): the file's matrix, individuals by SNPs, times x (i, v), or x times it; read once, kept nowhere, a missing dosage being
    an error. Lines stay packed: x times the matrix looks their bytes up in tables, block by block; the matrix times x adds up whole
    lines within each task, whose sums are all that leaves it."""
    from genospark.operators import packed

    snps, individuals = sizes_of(path)
    lines = packed.cut(read_lines(spark, path))
    if transposed:
        m = packed.Packed(lines, snps, individuals)
        return packed.product(m, x.select(F.col("i").alias("idx"), F.lit(0).alias("col"), "v"), True).select(F.col("idx").alias("i"), "v")
    return packed.added_lines(lines, x, individuals)


def write_matrix(m: DataFrame, path: str) -> None:
    """(i, j, v) as tab-separated rows in order of i, and of j within; as many files as partitions."""
    rows = m.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("c"))
    line = F.array_join(F.transform("c", lambda x: x["v"].cast("string")), "\t")
    rows.orderBy("i").select(line.alias("value")).write.mode("overwrite").text(path)


def write_raw(m: DataFrame, path: str, rows: int, columns: int) -> None:
    """(i, j, v) as raw little-endian doubles, column by column; absent cells are 0."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = (batch.column("j").to_numpy() * rows + batch.column("i").to_numpy()) * 8
            order = np.argsort(at, kind="stable")
            at, v = at[order], batch.column("v").to_numpy()[order].astype("<f8")
            cuts = [0, *(np.flatnonzero(np.diff(at) != 8) + 1).tolist(), len(at)]
            parts = [v[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]
            yield pa.RecordBatch.from_arrays([pa.array(at[cuts[:-1]] if len(at) else at), pa.array(parts, pa.binary())], names=["at", "data"])

    cells = m.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.col("v").cast("double").alias("v"))
    dealt = cells.repartitionByRange("j", "i").sortWithinPartitions("j", "i")
    write_at(dealt.mapInArrow(pack, "at bigint, data binary"), path, rows * columns * 8)


def read_raw(spark: SparkSession, path: str, rows: int, columns: int) -> DataFrame:
    """(i, j, v) of a file of raw doubles, column by column; executors read ranges of columns."""
    if size_of(path) != rows * columns * 8:
        raise ValueError(f"{size_of(path)} bytes do not hold {rows} x {columns}")
    step = max(1, (1 << 17) // max(1, rows))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with opened(path) as f:
            for batch in batches:
                for start in batch.column("id").to_pylist():
                    k = min(step, columns - start)
                    f.seek(start * rows * 8)
                    v = np.frombuffer(f.read(k * rows * 8), "<f8")
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(rows), k)), pa.array(np.repeat(np.arange(start, start + k), rows)), pa.array(v)], names=["i", "j", "v"])

    return spark.range(0, columns, step).mapInArrow(read, "i bigint, j bigint, v double")
