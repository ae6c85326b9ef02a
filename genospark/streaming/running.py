"""Allele frequencies of genotypes that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genospark.model import DOSAGE, SNP


def running_allele_freq(stream: DataFrame) -> DataFrame:
    """(snp_idx, n, freq) over all dosages so far; the state is a sum and a count for each SNP. Write in update or complete mode."""
    return stream.groupBy(SNP).agg(F.count(DOSAGE).alias("n"), (F.sum(DOSAGE) / (2 * F.count(DOSAGE))).alias("freq"))
