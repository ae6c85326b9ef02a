"""Byte formats of genotypes: 2 bits a dosage (2bit, plink) and five dosages a byte (5codes).

Low bits come first in a byte. Fixed values: 2bit 00 01 10 are 0 1 2; plink 00 10 11 are 0 1 2 and 01 is
missing; 5codes are x0 + 3 x1 + 9 x2 + 27 x3 + 81 x4.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genospark.model import DOSAGE, INDIV, SNP
from genospark.plans.batches import runs

CODE_OF = {"2bit": {0: 0, 1: 1, 2: 2}, "plink": {0: 0, None: 1, 1: 2, 2: 3}}
#: A byte with a missing dosage becomes this one when plink turns to 2bit, or 2bit to plink.
MISSING_BYTE = {"2bit": 0xFF, "plink": 0x55}


def byte_table(source: str, target: str) -> bytes:
    """256 bytes: each byte of one 2-bit format in the other."""
    back = {c: d for d, c in CODE_OF[source].items()}
    out = bytearray()
    for b in range(256):
        dosages = [back.get(b >> 2 * k & 3) for k in range(4)]
        codes = [CODE_OF[target].get(d) for d in dosages]
        out.append(MISSING_BYTE[target] if None in dosages or None in codes else sum(c << 2 * k for k, c in enumerate(codes)))
    return bytes(out)


def converted(packed: DataFrame, source: str, target: str) -> DataFrame:
    """(snp_idx, codes) with the bytes in another 2-bit format."""
    table = byte_table(source, target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [None if x is None else x.translate(table) for x in batch.column("codes").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(SNP), pa.array(codes, pa.binary())], names=[SNP, "codes"])

    return packed.select(F.col(SNP).cast("bigint").alias(SNP), "codes").mapInArrow(run, f"{SNP} bigint, codes binary")


def packed_bytes(geno: DataFrame, coding: str) -> DataFrame:
    """(snp_idx, byte_idx, code): four dosages a byte, or five for 5codes; absent ones add nothing."""
    per = 5 if coding == "5codes" else 4
    k = F.pmod(F.col(INDIV), F.lit(per))
    valid = F.col(DOSAGE).between(0, 2) | F.col(DOSAGE).isNull()
    dosage = F.when(valid, F.col(DOSAGE)).otherwise(F.raise_error(F.lit("a dosage beyond 2")).cast("int"))
    if coding == "5codes":
        part = F.coalesce(dosage, F.lit(0)) * F.pow(F.lit(3), k).cast("int")
    else:
        code = F.coalesce(F.create_map(*[F.lit(x) for d, c in CODE_OF[coding].items() if d is not None for x in (d, c)])[dosage], F.lit(CODE_OF[coding].get(None, 0)))
        part = code * F.pow(F.lit(4), k).cast("int")
    return geno.groupBy(SNP, F.expr(f"{INDIV} div {per}").alias("byte_idx")).agg(F.sum(part).cast("int").alias("code"))


#: Bytes of a piece of a line, and cells that a task gathers before it packs them.
PIECE, GATHER = 1 << 14, 1 << 18


def pieces(geno: DataFrame, coding: str) -> DataFrame:
    """(snp_idx, piece, codes): PIECE bytes of a SNP's line at a time, its last piece shorter. Cells are packed where they are, GATHER at a
    time; parts of pieces are what is shuffled, and a task joins one piece at a time. A byte that has no dosage at all must not lie between others."""
    per, base = (5, 3) if coding == "5codes" else (4, 4)
    known = {0: 0, 1: 1, 2: 2} if coding == "5codes" else CODE_OF[coding]
    code_of, powers = np.array([known.get(None, 0), *(known[d] for d in range(3))]), base ** np.arange(per)
    schema = f"{SNP} bigint, piece bigint, places binary, codes binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def taken() -> pa.RecordBatch:
            snp, at, x = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            byte = at // per
            order = np.lexsort((byte, snp))
            value = (code_of[x + 1] * powers[at - byte * per])[order]
            snp, byte = snp[order], byte[order]
            first = np.flatnonzero(np.r_[True, (np.diff(snp) != 0) | (np.diff(byte) != 0)])
            snp, byte, value = snp[first], byte[first], np.add.reduceat(value, first)
            piece = byte // PIECE
            cuts = np.flatnonzero(np.r_[True, (np.diff(snp) != 0) | (np.diff(piece) != 0), True])
            binaries = lambda v: pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * v.itemsize).astype(np.int32)), pa.py_buffer(v)])
            columns = [pa.array(snp[cuts[:-1]]), pa.array(piece[cuts[:-1]]), binaries((byte - piece * PIECE).astype(np.int16)), binaries(value.astype(np.uint8))]
            return pa.RecordBatch.from_arrays(columns, names=[SNP, "piece", "places", "codes"])

        for b in batches:
            if b.num_rows:
                held.append(tuple(b.column(c).to_numpy() for c in (SNP, INDIV, DOSAGE)))
                if sum(len(h[0]) for h in held) >= GATHER:
                    yield taken()
        if held:
            yield taken()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 2):
            snp, piece = (t.column(c).to_numpy() for c in (SNP, "piece"))
            places, codes = t.column("places").to_pylist(), t.column("codes").to_pylist()
            cuts = np.flatnonzero(np.r_[True, (np.diff(snp) != 0) | (np.diff(piece) != 0), True])
            for a, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                line, there = np.zeros(PIECE, np.uint8), np.zeros(PIECE, bool)
                for k in range(a, e):
                    at = np.frombuffer(places[k], np.int16)
                    line[at] += np.frombuffer(codes[k], np.uint8)
                    there[at] = True
                yield pa.RecordBatch.from_arrays([pa.array(snp[a : a + 1]), pa.array(piece[a : a + 1]), pa.array([line[there].tobytes()], pa.binary())], names=[SNP, "piece", "codes"])

    valid = F.col(DOSAGE).between(0, 2) | F.col(DOSAGE).isNull()
    dosage = F.when(valid, F.coalesce(F.col(DOSAGE).cast("int"), F.lit(-1))).otherwise(F.raise_error(F.lit("a dosage beyond 2")).cast("int"))
    cells = geno.select(F.col(SNP).cast("bigint").alias(SNP), F.col(INDIV).cast("bigint").alias(INDIV), dosage.alias(DOSAGE))
    dealt = cells.mapInArrow(pack, schema).repartition(SNP, "piece").sortWithinPartitions(SNP, "piece")
    return dealt.mapInArrow(join, f"{SNP} bigint, piece bigint, codes binary")


def packed(geno: DataFrame, coding: str) -> DataFrame:
    """(snp_idx, codes): one binary for each SNP. A byte that has no dosage at all must not lie between others."""
    rows = pieces(geno, coding).groupBy(SNP).agg(F.sort_array(F.collect_list(F.struct("piece", "codes"))).alias("b"))
    return rows.select(F.col(SNP).cast(geno.schema[SNP].dataType).alias(SNP), F.unhex(F.array_join(F.transform("b", lambda x: F.hex(x["codes"])), "")).alias("codes"))


def unpacked(packed: DataFrame, n: int, coding: str) -> DataFrame:
    """geno of n individuals from (snp_idx, codes); NULL for a missing dosage."""
    per = 5 if coding == "5codes" else 4
    if coding == "5codes":
        table = np.array([[b // 3**k % 3 for k in range(5)] for b in range(256)], np.int8)
    else:
        back = {c: -1 if d is None else d for d, c in CODE_OF[coding].items()}
        table = np.array([[back.get(b >> 2 * k & 3, -1) for k in range(4)] for b in range(256)], np.int8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for snp, codes in zip(batch.column(SNP).to_pylist(), batch.column("codes").to_pylist(), strict=True):
                if len(codes) != -(-n // per):
                    raise ValueError(f"{len(codes)} bytes do not hold {n} individuals")
                x = table[np.frombuffer(codes, np.uint8)].ravel()[:n]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, snp)), pa.array(np.arange(n)), pa.array(x.astype(np.int32), mask=x < 0)], names=[SNP, INDIV, DOSAGE])

    return packed.select(F.col(SNP).cast("bigint").alias(SNP), "codes").mapInArrow(run, f"{SNP} bigint, {INDIV} bigint, {DOSAGE} int")


def popcount_freq(codes: DataFrame, n: int) -> DataFrame:
    """(snp_idx, freq) from plink bytes (snp_idx, byte_idx, code) without missing dosages: bits that are set, over 2n."""
    return codes.groupBy(SNP).agg((F.sum(F.bit_count("code")) / F.lit(2 * n)).alias("freq"))


def transformed(data: DataFrame, source: str, target: str, individuals: int, snps: DataFrame | None = None, picks: DataFrame | None = None) -> DataFrame:
    """data of one coding (tidy, haplotype, 2bit, plink, 5codes) in another, of the SNPs and individuals picked, in their
    order. Codes of bytes hold `individuals` each. Haplotypes can become genotypes, not the other way round."""
    from genospark.operators.select import haplo_to_geno, selected_haplo

    if target == "haplotype":
        if source != "haplotype":
            raise ValueError("genotypes do not say which haplotype an allele is on")
        return selected_haplo(data, snps, picks)
    geno = haplo_to_geno(data) if source == "haplotype" else data if source == "tidy" else unpacked(data, individuals, source)
    chosen = recoded(geno, snps, picks)
    return chosen if target == "tidy" else packed(chosen, target)


def recoded(geno: DataFrame, snps: DataFrame | None = None, individuals: DataFrame | None = None) -> DataFrame:
    """A selection of geno with its dosages checked to be 0, 1, 2 or NULL."""
    from genospark.operators.select import selected

    ok = F.col(DOSAGE).isNull() | F.col(DOSAGE).between(0, 2)
    checked = geno.withColumn(DOSAGE, F.when(ok, F.col(DOSAGE)).otherwise(F.raise_error(F.lit("a dosage beyond 2")).cast("int")))
    return selected(checked, snps, individuals)
