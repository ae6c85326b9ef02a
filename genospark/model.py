"""Genotypes as a relation, and the options of the operators."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genospark.plans.tables import written

SNP, INDIV, DOSAGE = "snp_idx", "indiv_idx", "dosage"
NORMALIZE = ("none", "global", "centring")
MISSING = ("error", "zero", "mean")
CENTRING = ("none", "row", "column", "user")
FREQ = ("data", "given")
#: Flags without a counterpart here: results do not depend on them.
RUNTIME = ("use_gpu", "cores", "float_loop", "mean_subtract", "variant", "print_details", "verbose")


@dataclass(frozen=True)
class Options:
    """What changes results. center and centring: what products take off (see geno_product); normalize: "global" divides by
    the scale of the centred genotypes, "centring" crossproducts by the roots of their diagonal; squared: crossproducts
    cell by cell; missing: refuse NULL dosages, take them as 0, or as twice the frequency; freq: the data's own frequencies, or
    those that the handle is given."""

    center: bool = True
    centring: str = "row"
    normalize: str = "none"
    missing: str = "error"
    squared: bool = False
    freq: str = "data"

    def __post_init__(self):
        for value, allowed in ((self.centring, CENTRING), (self.normalize, NORMALIZE), (self.missing, MISSING), (self.freq, FREQ)):
            if value not in allowed:
                raise ValueError(f"{value!r} is not one of {allowed}")

    def set(self, **values) -> Options:
        return replace(self, **values)

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(f.name, str(getattr(self, f.name))) for f in fields(self)], "name string, value string")

    @classmethod
    def of_flags(cls, ignore_missings: bool = False, do_not_center: bool = False, do_normalize: bool = False, own_freq: bool = True, **runtime) -> Options:
        """From the flags of a foreign interface, two of which deny. Flags that choose a device, a kernel, threads or
        messages are taken and change nothing, as Spark plans that; others are an error."""
        if unknown := set(runtime) - set(RUNTIME):
            raise ValueError(f"unknown flags {sorted(unknown)}")
        return cls(center=not do_not_center, centring="none" if do_not_center else "row", normalize="global" if do_normalize else "none", missing="zero" if ignore_missings else "error", freq="data" if own_freq else "given")

    @classmethod
    def matched(cls, **values) -> Options:
        """Options by names that may be cut short, as long as one option begins so."""
        names = [f.name for f in fields(cls)]
        found = {}
        for key, value in values.items():
            hits = [n for n in names if n == key] or [n for n in names if n.startswith(key)]
            if len(hits) != 1:
                raise ValueError(f"{key!r} matches {hits or 'no option'}")
            found[hits[0]] = value
        return cls(**found)


def transposed_flag(flag: str) -> bool:
    """T, t, Y and y ask for the transpose, N and n do not."""
    if flag in ("T", "t", "Y", "y"):
        return True
    if flag in ("N", "n"):
        return False
    raise ValueError(f"unknown transposition flag {flag!r}")


def settled(geno: DataFrame, missing: str = "error") -> DataFrame:
    """geno (snp_idx, indiv_idx, dosage) without NULL dosages, by the policy."""
    if missing == "zero":
        return geno.withColumn(DOSAGE, F.coalesce(DOSAGE, F.lit(0)))
    if missing == "mean":
        freq = geno.groupBy(SNP).agg((F.sum(DOSAGE) / F.count(DOSAGE)).alias("__m"))
        return geno.join(freq, SNP).withColumn(DOSAGE, F.coalesce(F.col(DOSAGE).cast("double"), F.col("__m"))).drop("__m")
    if missing != "error":
        raise ValueError(f"{missing!r} is not one of {MISSING}")
    checked = F.when(F.col(DOSAGE).isNull(), F.raise_error(F.lit("a dosage is missing")).cast("int")).otherwise(F.col(DOSAGE))
    return geno.withColumn(DOSAGE, checked)


class GenotypeMatrix:
    """A handle on a genotype relation: kept in memory or disk of the executors while it is used. What it gives is computed at
    once, into a table, and so outlives it. freq: (snp_idx, freq), which the option "given" takes; centre: (snp_idx, centre), which
    the centring "user" takes off. layout: "cells", or "packed" for products from packed bytes, which are made once and deleted by
    free(); see operators.packed. Then cells are read twice, to be packed and for a table of each SNP's sums, and kept nowhere. geno
    may be a packed matrix itself, which free() deletes; its handle has products only. Absent cells are 0."""

    def __init__(self, geno, options: Options = Options(), freq: DataFrame | None = None, centre: DataFrame | None = None, layout: str = "cells"):
        if layout not in ("cells", "packed"):
            raise ValueError("layout is cells or packed")
        if options.freq == "given" and freq is None or options.center and options.centring == "user" and centre is None:
            raise ValueError("given frequencies and a user's centring need a table of them")
        self.options, self.centre, self.layout, self._packed = options, centre, layout, None
        if isinstance(geno, DataFrame):
            self._given = geno.select(SNP, INDIV, DOSAGE)
            self.df = settled(self._given, options.missing)
        elif layout == "packed":
            self._packed = geno
        else:
            raise ValueError("a packed matrix has no cells")
        self._freq: DataFrame | None = freq if options.freq == "given" else None
        self._sizes: tuple[int, int] | None = None if isinstance(geno, DataFrame) else (geno.snps, geno.individuals)
        self._sums: DataFrame | None = None

    def __enter__(self) -> GenotypeMatrix:
        if self.layout == "cells":
            self.df = self.df.persist()
        return self

    def __exit__(self, *error) -> None:
        self.free()

    def free(self) -> None:
        if self.layout == "cells":
            self.df.unpersist()
        if self._packed is not None:
            self._packed.free()
            self._packed = None

    def packed(self):
        """The matrix as packed lines, made at the first call; missing dosages stay missing."""
        from genospark.operators.packed import packed

        if self._packed is None:
            self._packed = packed(self._given, *self.sizes)
        return self._packed

    def _snp_sums(self) -> DataFrame:
        """(snp_idx, s, n, last), a table: sum and number of a SNP's dosages, missing ones by the policy, and its last individual."""
        if self._sums is None and not hasattr(self, "df"):
            from genospark.operators import packed

            n, m = F.lit(self._packed.individuals), packed.sums(self._packed)
            if self.options.missing == "error":
                m = m.withColumn("n", F.when(F.col("n") < n, F.raise_error(F.lit("a dosage is missing")).cast("bigint")).otherwise(F.col("n")))
            self._sums = written(m.select(SNP, F.col("s").cast("double").alias("s"), n.alias("n") if self.options.missing == "zero" else "n", (n - 1).alias("last")), "snp_sums")
        if self._sums is None:
            own = self._given if self.options.missing == "mean" else self.df
            per = own.groupBy(SNP).agg(F.sum(F.col(DOSAGE).cast("double")).alias("s"), F.count(DOSAGE).alias("n"), F.max(INDIV).alias("last"))
            self._sums = written(per, "snp_sums")
        return self._sums

    @property
    def sizes(self) -> tuple[int, int]:
        """SNPs and individuals, up to the last that has a cell."""
        if self._sizes is None:
            per = self._snp_sums().select(SNP, F.col("last").alias(INDIV)) if self.layout == "packed" else self.df
            a, b = per.agg(F.max(SNP), F.max(INDIV)).first()
            self._sizes = (0 if a is None else a + 1, 0 if b is None else b + 1)
        return self._sizes

    def check(self, snps: int, individuals: int) -> None:
        if self.sizes != (snps, individuals):
            raise ValueError(f"{self.sizes[0]} SNPs of {self.sizes[1]} individuals, not {snps} of {individuals}")

    def freq(self) -> DataFrame:
        from genospark.operators.stats import allele_freq

        if self._freq is None and self.layout == "packed":
            self._freq = self._snp_sums().select(SNP, (F.col("s") / (2 * F.nullif("n", F.lit(0)))).alias("freq"))
        if self._freq is None:
            self._freq = written(allele_freq(self.df), "freq")
        return self._freq

    def multiply(self, b: DataFrame, trans: str = "N") -> DataFrame:
        """The product with b (idx, col, v), as the options say. Rows of b beyond the matrix are an error."""
        from genospark.operators.products import geno_product

        transposed, o = transposed_flag(trans), self.options
        last = b.agg(F.max("idx")).first()[0]
        if last is not None and last >= self.sizes[int(transposed)]:
            raise ValueError(f"row {last} of the factor lies beyond {self.sizes[int(transposed)]}")
        if self.layout == "packed":
            from genospark.operators import packed

            out = packed.product(self.packed(), b, transposed, o.centring if o.center else "none", o.missing, self.freq(), self.centre)
            if o.normalize == "global":
                p = F.col("s") / (2 * F.nullif("n", F.lit(0)))
                sigma2 = self._snp_sums().agg(F.sum(2 * p * (1 - p)).alias("sigma2"))
                out = written(out.join(F.broadcast(sigma2)).select("idx", "col", (F.col("v") / F.sqrt("sigma2")).alias("v")), "product")
            return out
        return written(geno_product(self.df, b, transposed, o.center, self.freq(), o.centring, o.normalize, self.centre), "product")

    def crossprod(self, over: str = SNP) -> DataFrame:
        """(i, j, v) of the crossproduct, centred, divided and squared as the options say."""
        from genospark.operators.products import centred_crossprod

        o = self.options
        if o.centring == "user":
            raise ValueError("crossproducts take off means, not a user's centre")
        return written(centred_crossprod(self.df, over, o.centring if o.center else "none", o.normalize, o.squared), "crossprod")


#: Individuals that lie side by side in every_cell(), SNPs of a run in it, and its cells in a task.
STRIPE, RUN, CELLS = 256, 1 << 15, 1 << 27


def every_cell(spark: SparkSession, snps: int, individuals: int) -> DataFrame:
    """(snp_idx, indiv_idx) of all cells, RUN SNPs after RUN SNPs, in stripes of STRIPE individuals, SNP by SNP within each. Stored by columns the
    SNPs then lie in runs and the individuals repeat at a short period, so that a cell takes a small part of a byte; along whole lines it would
    take several. A task has few runs of SNPs, so that their dictionary does not overflow."""
    stripes = -(-individuals // STRIPE)
    lines = spark.range(0, snps * stripes, 1, max(spark.sparkContext.defaultParallelism, snps * individuals // CELLS))
    run, at = F.expr(f"id div {RUN * max(1, stripes)}") * RUN, F.expr(f"id % {RUN * max(1, stripes)}")
    lines = lines.select(run.alias("run"), at.alias("at")).withColumn("width", F.least(F.lit(RUN).cast("bigint"), F.lit(snps) - F.col("run")))
    first = F.expr("at div width") * STRIPE
    own = F.sequence(first, F.least(first + (STRIPE - 1), F.lit(individuals - 1).cast("bigint")))
    return lines.select(F.expr("run + at % width").alias(SNP), F.explode(own).alias(INDIV))


def zero_matrix(spark: SparkSession, snps: int, individuals: int) -> DataFrame:
    """All dosages 0."""
    return every_cell(spark, snps, individuals).withColumn(DOSAGE, F.lit(0))


def capabilities(spark: SparkSession) -> DataFrame:
    """Which codings exist and what can be done with them."""
    rows = [("tidy", True, True, True), ("2bit", True, False, True), ("plink", True, True, True), ("5codes", True, False, True), ("haplotype", True, False, True), ("3bit", False, False, False), ("4bit", False, False, False)]
    return spark.createDataFrame(rows, "coding string, exists boolean, keeps_missing boolean, converts boolean")
