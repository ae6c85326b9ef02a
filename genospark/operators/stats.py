"""Aggregates over genotypes and over matrices in coordinates (i, j, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genospark.model import DOSAGE, INDIV, SNP


def is_whole(geno: DataFrame) -> bool:
    """Whether dosages are integers; imputed ones are doubles."""
    return dict(geno.dtypes)[DOSAGE] not in ("float", "double")


def total(geno: DataFrame, x: Column | None = None) -> Column:
    """The sum of x, or of dosages: exact for integers, a double for others."""
    out = F.sum(F.col(DOSAGE) if x is None else x)
    return out.cast("bigint") if is_whole(geno) else out.cast("double")


def allele_freq(geno: DataFrame) -> DataFrame:
    """snp_idx, freq: half the mean dosage over what is not missing; NULL if all is."""
    return geno.groupBy(SNP).agg((F.sum(DOSAGE) / (2 * F.count(DOSAGE))).alias("freq"))


def allele_sum(geno: DataFrame) -> DataFrame:
    return geno.groupBy(SNP).agg(total(geno).alias("allele_sum"))


def sum_geno(geno: DataFrame) -> DataFrame:
    """indiv_idx, total; the row without indiv_idx is over all."""
    return geno.rollup(INDIV).agg(total(geno).alias("total"))


def pseudo_freq(geno: DataFrame, snps: int | None = None) -> DataFrame:
    """indiv_idx, freq: half the mean dosage over all SNPs, absent ones being 0. snps: those that have a cell, if not given."""
    n = geno.select(SNP).distinct().count() if snps is None else snps
    return geno.groupBy(INDIV).agg((F.sum(DOSAGE) / F.lit(2 * n)).alias("freq"))


def derived(geno: DataFrame, places: int | None = None) -> DataFrame:
    """One row: sum_freq, sigma2 (sum of 2p(1-p)), total and sq_total (sum of squared row totals). places: what a row's sum is
    divided by; its dosages that are not missing, if not given."""
    per = geno.groupBy(SNP).agg(total(geno).alias("s"), F.count(DOSAGE).alias("n"))
    p = F.col("s") / (2 * (F.col("n") if places is None else F.lit(places)))
    return per.agg(F.sum(p).alias("sum_freq"), F.sum(2 * p * (1 - p)).alias("sigma2"), F.sum("s").alias("total"), F.sum(F.col("s") * F.col("s")).alias("sq_total"))


def derived_by_individual(geno: DataFrame) -> DataFrame:
    """The same with individuals in the place of SNPs: sum_freq and sigma2 from pseudo-frequencies, total and sq_total from
    individuals' totals."""
    return derived(geno.select(F.col(INDIV).alias(SNP), F.col(SNP).alias(INDIV), DOSAGE), geno.select(SNP).distinct().count())


def pseudo_freq_times_geno(geno: DataFrame) -> DataFrame:
    """snp_idx, v: the matrix times pseudo-frequencies."""
    return geno.join(pseudo_freq(geno), INDIV).groupBy(SNP).agg(F.sum(F.col("freq") * F.col(DOSAGE)).alias("v"))


def freq_times_geno(geno: DataFrame) -> DataFrame:
    """indiv_idx, v: frequencies times the matrix."""
    return geno.join(allele_freq(geno), SNP).groupBy(INDIV).agg(F.sum(F.col("freq") * F.col(DOSAGE)).alias("v"))


def missing_cells(geno: DataFrame) -> DataFrame:
    return geno.filter(F.col(DOSAGE).isNull()).select(SNP, INDIV)


def col_maxs(m: DataFrame) -> DataFrame:
    return m.groupBy("j").agg(F.max("v").alias("v"))


def _columns(m: DataFrame, columns: int | None) -> int:
    return columns if columns is not None else (m.agg(F.max("j")).first()[0] or 0) + 1


def row_means(m: DataFrame, weights: DataFrame | None = None, columns: int | None = None) -> DataFrame:
    """Row sums, weighted by (j, w) if given, over the number of columns (not over the weights' sum); absent cells are 0.
    columns: up to the last one that has a cell, if not given."""
    n = _columns(m, columns)
    if weights is not None:
        m = m.join(weights, "j").withColumn("v", F.col("v") * F.col("w"))
    return m.groupBy("i").agg((F.sum("v") / F.lit(n)).alias("v"))


def row_prod(m: DataFrame, columns: int | None = None) -> DataFrame:
    """Products of rows; 0 where a cell is absent."""
    n = _columns(m, columns)
    return m.groupBy("i").agg(F.when(F.count("v") < n, 0.0).otherwise(F.product(F.col("v").cast("double"))).alias("v"))


def diagonal_product(m: DataFrame, log: bool = False) -> DataFrame:
    """One row: the product of the diagonal, or the sum of its logarithms."""
    d = m.filter("i = j")
    return d.agg((F.sum(F.log("v")) if log else F.product("v")).alias("v"))


def agreement(pairs: DataFrame) -> DataFrame:
    """One row from (x, y): their correlation, and the norms of x - y and of x."""
    d = F.col("x") - F.col("y")
    return pairs.agg(F.corr("x", "y").alias("corr"), F.sqrt(F.sum(d * d)).alias("residual"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
