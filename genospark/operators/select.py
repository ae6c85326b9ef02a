"""Selecting, overwriting and reshaping genotypes and haplotypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genospark.model import DOSAGE, INDIV, SNP
from genospark.plans.tables import written


def index_list(spark: SparkSession, indices: list[int], column: str) -> DataFrame:
    """(column, pos) of an ordered list; its size is the caller's."""
    return spark.createDataFrame(list(zip(indices, range(len(indices)), strict=True)), f"{column} bigint, pos bigint")


def selected(geno: DataFrame, snps: DataFrame | None = None, individuals: DataFrame | None = None) -> DataFrame:
    """Rows and columns in the order of the lists (idx, pos), renumbered by position. Indices beyond the
    matrix are skipped, repeated ones are kept, a negative individual is a column of zeros."""
    out = geno
    if snps is not None:
        out = out.join(snps.select(F.col("idx").alias(SNP), F.col("pos").alias("__s")), SNP).drop(SNP).withColumnRenamed("__s", SNP)
    if individuals is not None:
        picks = individuals.select(F.col("idx").alias(INDIV), F.col("pos").alias("__i"))
        zeros = out.select(SNP).distinct().join(picks.filter(F.col(INDIV) < 0).select(F.col("__i").alias(INDIV))).select(SNP, INDIV, F.lit(0).cast(dict(geno.dtypes)[DOSAGE]).alias(DOSAGE))
        out = out.join(picks, INDIV).drop(INDIV).withColumnRenamed("__i", INDIV).select(SNP, INDIV, DOSAGE).unionByName(zeros)
    return out.select(SNP, INDIV, DOSAGE)


def selected_haplo(haplo: DataFrame, snps: DataFrame | None = None, individuals: DataFrame | None = None, which: int | None = None) -> DataFrame:
    """The same for haplotypes (snp_idx, indiv_idx, hap, allele); which: only the first (1) or second set."""
    out = haplo if which is None else haplo.filter(F.col("hap") == which - 1)
    for rows, c in ((snps, SNP), (individuals, INDIV)):
        if rows is not None:
            out = out.join(rows.select(F.col("idx").alias(c), F.col("pos").alias("__p")), c).drop(c).withColumnRenamed("__p", c)
    return out.select(SNP, INDIV, "hap", "allele")


def trimmed(indices: list[int], size: int) -> list[int]:
    """The list without those at its end that lie beyond size; an error if all do."""
    n = len(indices)
    while n and indices[n - 1] >= size:
        n -= 1
    if not n:
        raise ValueError("every index lies beyond the matrix")
    return indices[:n]


def zeroed(geno: DataFrame, snps: DataFrame, individuals: DataFrame) -> DataFrame:
    """Dosage 0 where both the SNP and the individual are listed."""
    s = snps.select(F.col("idx").alias(SNP)).distinct().withColumn("__s", F.lit(1))
    i = individuals.select(F.col("idx").alias(INDIV)).distinct().withColumn("__i", F.lit(1))
    both = F.col("__s").isNotNull() & F.col("__i").isNotNull()
    return geno.join(s, SNP, "left").join(i, INDIV, "left").select(SNP, INDIV, F.when(both, 0).otherwise(F.col(DOSAGE)).alias(DOSAGE))


def filled(geno: DataFrame, other: DataFrame, places: DataFrame) -> DataFrame:
    """geno with the columns of other in place: places (pos, idx), 1-based, says for each column of other, in
    order, which individual it overwrites."""
    if geno.select(SNP).distinct().count() != other.select(SNP).distinct().count():
        raise ValueError("both matrices must have the same SNPs")
    to = places.select((F.col("pos") - 1).alias(INDIV), (F.col("idx") - 1).alias("__to"))
    new = other.join(to, INDIV).select(SNP, F.col("__to").alias(INDIV), DOSAGE)
    return geno.join(to.select(F.col("__to").alias(INDIV)), INDIV, "left_anti").select(SNP, INDIV, DOSAGE).unionByName(new)


def transposed(geno: DataFrame) -> DataFrame:
    return geno.select(F.col(INDIV).alias(SNP), F.col(SNP).alias(INDIV), DOSAGE)


def haplo_to_geno(haplo: DataFrame) -> DataFrame:
    return haplo.groupBy(SNP, INDIV).agg(F.sum("allele").cast("int").alias(DOSAGE))


LAYOUTS = ("snp_rows", "indiv_rows", "snp_rows_doubled", "indiv_columns_doubled")


def haplo_layout(haplo: DataFrame, layout: str) -> DataFrame:
    """Haplotypes as cells (i, j, v) of a user's matrix: one of the axes holds both sets in turn."""
    twice = lambda c: F.col(c) * 2 + F.col("hap")
    i, j = {"snp_rows": (F.col(SNP), twice(INDIV)), "indiv_rows": (twice(INDIV), F.col(SNP)), "snp_rows_doubled": (twice(SNP), F.col(INDIV)), "indiv_columns_doubled": (F.col(INDIV), twice(SNP))}[layout]
    return haplo.select(i.alias("i"), j.alias("j"), F.col("allele").alias("v"))


def haplo_from_layout(cells: DataFrame, layout: str) -> DataFrame:
    """The inverse of haplo_layout."""
    double, snp_first = {"snp_rows": ("j", True), "indiv_rows": ("i", False), "snp_rows_doubled": ("i", True), "indiv_columns_doubled": ("j", False)}[layout]
    half = lambda c: F.floor(F.col(c) / 2).cast("bigint") if c == double else F.col(c)
    snp, indiv = ("i", "j") if snp_first else ("j", "i")
    return cells.select(half(snp).alias(SNP), half(indiv).alias(INDIV), F.pmod(F.col(double), F.lit(2)).cast("int").alias("hap"), F.col("v").alias("allele"))


def centre_of(geno: DataFrame, centring: str = "row") -> DataFrame:
    """(snp_idx, centre): what centring takes off each SNP: twice its frequency, or 0 for "none". Individuals' means, for
    "column", come as (indiv_idx, centre)."""
    from genospark.operators.stats import allele_freq, pseudo_freq

    if centring == "column":
        return pseudo_freq(geno).select(INDIV, (2 * F.col("freq")).alias("centre"))
    f = allele_freq(geno)
    return f.select(SNP, (2 * F.col("freq") if centring == "row" else F.lit(0.0)).alias("centre"))


def centred(geno: DataFrame, centre: DataFrame) -> DataFrame:
    """(snp_idx, indiv_idx, v): dosage less the SNP's centre. A SNP without one is an error."""
    c = F.coalesce("centre", F.raise_error(F.lit("a SNP has no centre")).cast("double"))
    return geno.join(centre, SNP, "left").select(SNP, INDIV, (F.col(DOSAGE) - c).alias("v"))


#: Bits of an origin code, from the lowest: haplotype, individual, sex, generation.
ORIGIN_BITS = (("haplo", 3), ("nr", 22), ("sex", 1), ("generation", 6))


def origin_code(**parts: Column) -> Column:
    """A code from generation (1..64), sex (1..2), nr (1..2^22) and haplo (1..8)."""
    code, shift = F.lit(0).cast("bigint"), 0
    for name, bits in ORIGIN_BITS:
        ok = F.coalesce(parts[name].between(1, 1 << bits), F.lit(False))
        value = F.when(ok, parts[name].cast("bigint") - 1).otherwise(F.raise_error(F.lit(f"{name} out of range")).cast("bigint"))
        code, shift = code + value * (1 << shift), shift + bits
    return code


def origin_parts(code: Column) -> dict[str, Column]:
    out, shift = {}, 0
    for name, bits in ORIGIN_BITS:
        out[name] = (F.shiftright(code, shift).bitwiseAND((1 << bits) - 1) + 1).cast("int")
        shift += bits
    return out


def placed(df: DataFrame, order: list[Column], place: str = "place") -> DataFrame:
    """df with each row's place, from 1, in an order: ranges of the order are sorted each for itself, and only the sizes of
    the ranges meet in one place. Rows that the order does not part have neighbouring places."""
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id(), "__at": at}), "sorted")
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("__part").agg(F.count("*").alias("n")).withColumn("__start", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    return rows.join(F.broadcast(starts.drop("n")), "__part").withColumn(place, F.col("__start") + F.col("__at") + 1).drop("__part", "__at", "__start")


def _clean(df: DataFrame, value: str) -> Column:
    """The column with NaN as NULL."""
    v = F.col(value)
    return F.when(~F.isnan(v), v) if dict(df.dtypes)[value] in ("float", "double") else v


#: Accuracy of a selection's quantiles, and rows that are sorted at once.
ACCURACY, FEW = 10_000, 100_000


def _bounded(df: DataFrame, value: str, low: int, high: int) -> tuple[DataFrame, int]:
    """The rows whose value may have a place from low to high in ascending order (value not NULL), and how many lie below them.
    Each round takes a quantile just below the one place and one just above the other, and counts the rows beyond them: only these
    numbers come to the driver, and nothing is sorted or written."""
    below, v = 0, F.col(value)
    while True:
        n, first, last = df.count(), low - below, high - below
        if n <= max(FEW, 2 * (last - first + 1)):
            return df, below
        near = [max(0.0, (first - 1) / n - 2 / ACCURACY), min(1.0, last / n + 2 / ACCURACY)]
        bottom, top = (F.lit(x) for x in df.agg(F.percentile_approx(value, near, ACCURACY)).first()[0])
        under, upto = df.agg(F.count_if(v < bottom), F.count_if(v <= top)).first()
        kept, m = df, n
        if under < first:
            kept, below, m = kept.filter(v >= bottom), below + under, m - under
        if upto >= last:
            kept, m = kept.filter(v <= top), m - (n - upto)
        if m > n // 2:
            return kept, below  # the slice is large, or one value is frequent
        df = kept


def _slice(df: DataFrame, value: str, start: int, stop: int, nulls_last: bool | None, index: str | None) -> tuple[DataFrame, int]:
    """The rows that may stand in places start to stop, with __v, and how many stand before all of them."""
    rows = df.withColumn("__v", _clean(df, value))
    nulls, others = rows.agg(F.count_if(F.col("__v").isNull()), F.count("__v")).first()
    if nulls_last is None:
        rows, nulls = rows.filter(F.col("__v").isNotNull()), 0
    stop = min(stop, nulls + others)
    if start > stop:
        return rows.limit(0), 0
    begin = 0 if nulls_last is not False else nulls  # places before the first value
    parts: list[tuple[int, DataFrame]] = []
    if nulls and (start <= nulls if nulls_last is False else stop > others):
        own, n = rows.filter(F.col("__v").isNull()), 0
        if index is not None:
            base = 0 if nulls_last is False else others
            own, n = _bounded(own, index, max(1, start - base), min(nulls, stop - base))
        parts.append((n + (0 if nulls_last is False else others), own))
    low, high = max(1, start - begin), min(others, stop - begin)
    if low <= high:
        own, n = _bounded(rows.filter(F.col("__v").isNotNull()), "__v", low, high) if dict(rows.dtypes)["__v"] not in ("string", "boolean") else (rows.filter(F.col("__v").isNotNull()), 0)
        parts.append((begin + n, own))
    parts.sort(key=lambda p: p[0])
    out = parts[0][1]
    for _, own in parts[1:]:
        out = out.unionByName(own)
    return out, parts[0][0]


def sorted_slice(df: DataFrame, value: str, start: int, stop: int, nulls_last: bool | None = True, index: str | None = None) -> DataFrame:
    """Places start to stop, 1-based and inclusive, of the ascending order, ties by the index column if one is given; NaN
    counts as NULL. nulls_last: NULLs come last, first, or (None) not at all. Empty if start > stop.

    Quantiles narrow down the values that can stand there, so that only rows between them are sorted, and only the slice leaves the
    sort; with many equal values the index parts them within the sort."""
    start = max(start, 1)
    if start > stop:
        return df.limit(0)
    rows, before = _slice(df, value, start, stop, nulls_last, index)
    v = F.col("__v")
    order = [v.asc_nulls_first() if nulls_last is False else v.asc_nulls_last(), *([] if index is None else [F.col(index).asc()])]
    if stop - before > FEW:  # more than the first few: no single task should take them all
        return placed(rows, order, "__place").filter((F.col("__place") + before).between(start, stop)).orderBy("__place").drop("__place", "__v")
    return rows.orderBy(*order).offset(start - 1 - before).limit(stop - start + 1).drop("__v")


def order_of(df: DataFrame, keys: list[str], index: str, start: int = 1, stop: int | None = None, nulls_last: bool | None = True) -> DataFrame:
    """(place, index), both 1-based: the permutation that sorts by the keys, ties by index; NaN counts as NULL. start and stop: its
    places, as in sorted_slice(), which come without a sort of the whole where there is one key."""
    rows = df.select(*dict.fromkeys([*keys, index]))
    if nulls_last is None:
        for c in keys:
            rows = rows.filter(_clean(rows, c).isNotNull())
    before = 0
    if stop is not None or start > 1:
        start = max(start, 1)
        stop = rows.count() if stop is None else stop
        if start > stop:
            return rows.limit(0).select(F.lit(0).cast("bigint").alias("place"), F.col(index).alias("index"))
        if len(keys) == 1:
            found, before = _slice(rows, keys[0], start, stop, nulls_last, index)
            rows = found.drop("__v")
    order = [(_clean(rows, c).asc_nulls_first() if nulls_last is False else _clean(rows, c).asc_nulls_last()) for c in keys]
    out = placed(rows, [*order, F.col(index).asc()]).select((F.col("place") + before).alias("place"), F.col(index).alias("index"))
    return out if stop is None else out.filter(F.col("place").between(start, stop))
