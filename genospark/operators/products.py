"""Products: joins on the contracted index and sums. Centring is a rank-one correction of the sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genospark.model import CENTRING, DOSAGE, INDIV, NORMALIZE, SNP
from genospark.operators.stats import is_whole, total
from genospark.plans.batches import runs
from genospark.plans.tables import written


def matmul(a: DataFrame, b: DataFrame, ta: bool = False, tb: bool = False) -> DataFrame:
    """(i, j, v) of A B for matrices in coordinates; ta, tb: of their transposes."""
    left = a.select(F.col("j" if ta else "i").alias("i"), F.col("i" if ta else "j").alias("k"), F.col("v").alias("x"))
    right = b.select(F.col("j" if tb else "i").alias("k"), F.col("i" if tb else "j").alias("j"), F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


#: Places of a tile's side; blocks of a side that a task multiplies at most, where sums are kept over tiles and where each pair of tiles is whole;
#: bytes of tiles that a task keeps.
TILE, SIDE, WIDE, KEPT = 1024, 4, 8, 64 << 20


def _real(df: DataFrame, column: str) -> bool:
    kind = df.schema[column].dataType.simpleString()
    return kind in ("float", "double") or kind.startswith("decimal")


def _tiles(cells: DataFrame, outer: str) -> DataFrame:
    """(outer block, k block, data, there) of cells (outer, k, x): dense tiles, whole numbers in the narrowest type that holds them, and which
    places have a cell, nothing if all have."""
    real = _real(cells, "x")

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        at, k = rows["at"].to_numpy(), rows["k_at"].to_numpy()
        shape = (int(at.max()) + 1, int(k.max()) + 1)
        tile, there = np.zeros(shape, np.float64 if real else np.int64), np.zeros(shape, np.uint8)
        np.add.at(tile, (at, k), rows["x"].to_numpy())
        there[at, k] = 1
        if not real:
            tile = tile.astype(np.result_type(*(np.min_scalar_type(min(int(x), -1)) for x in (tile.min(), -int(tile.max()) - 1))))
        return pd.DataFrame({"b": [key[0]], "kb": [key[1]], "rows": [len(tile)], "kind": [tile.dtype.str], "data": [tile.tobytes()], "there": [b"" if there.all() else there.tobytes()]})

    at, k = F.pmod(F.col(outer).cast("bigint"), F.lit(TILE)), F.pmod(F.col("k").cast("bigint"), F.lit(TILE))
    placed = cells.filter("x IS NOT NULL").select(((F.col(outer) - at) / TILE).cast("bigint").alias("b"), ((F.col("k") - k) / TILE).cast("bigint").alias("kb"), at.alias("at"), k.alias("k_at"), F.col("x").cast("double" if real else "bigint").alias("x"))
    return placed.groupBy("b", "kb").applyInPandas(pack, "b bigint, kb bigint, rows int, kind string, data binary, there binary")


def _met_tiles(one: DataFrame, two: DataFrame) -> tuple[DataFrame, bool]:
    """Rows of both sides' tiles, in each partition those of pairs (p, q) of up to SIDE or WIDE blocks of one and of two: k block by k block, one's
    first. And whether there is one k block only. A tile goes to each group of blocks of the other side, not to each block."""
    (n, k, size), (m, _, _) = (df.agg(F.countDistinct("b"), F.countDistinct("kb"), F.max(F.length("data") + F.length("there"))).first() for df in (one, two))
    cores = 2 * one.sparkSession.sparkContext.defaultParallelism
    side = max(1, min(WIDE if k == 1 else SIDE, int((n * m / cores) ** 0.5), KEPT // (size or 1)))
    group = F.floor(F.col("b") / side)
    left, right = (df.withColumn(own, group) for df, own in ((one, "p"), (two, "q")))
    ps, qs = (written(df.select(own).distinct(), "groups") for df, own in ((left, "p"), (right, "q")))
    both = left.join(F.broadcast(qs)).withColumn("side", F.lit(0)).unionByName(right.join(F.broadcast(ps)).withColumn("side", F.lit(1)))
    (low, count), (least, width) = (df.agg(F.min(c), F.max(c) - F.min(c) + 1).first() for df, c in ((ps, "p"), (qs, "q")))
    tasks = max(1, min(-(-n // side) * -(-m // side), 1 << 16))
    at = (F.col("p") - F.lit(low or 0)) * F.lit(width or 1) + F.col("q") - F.lit(least or 0)
    return both.repartitionById(tasks, F.pmod(at, F.lit(tasks)).cast("int")).sortWithinPartitions("p", "q", "kb", "side", "b"), k == 1


def matmul_tiled(a: DataFrame, b: DataFrame, ta: bool = False, tb: bool = False) -> DataFrame:
    """matmul() of matrices that are dense or nearly so: tiles meet, not cells, and a task holds the tiles of a few blocks of a k block, and the sums
    of their pairs where there are several k blocks. Cells as from matmul(), NULL ones being absent; whole numbers stay exact, beyond 64 bits
    they are an error."""
    left = a.select(F.col("j" if ta else "i").alias("i"), F.col("i" if ta else "j").alias("k"), F.col("v").alias("x"))
    right = b.select(F.col("j" if tb else "i").alias("k"), F.col("i" if tb else "j").alias("j"), F.col("v").alias("x"))
    one, two = written(_tiles(left, "i"), "tiles"), written(_tiles(right, "j"), "tiles")
    whole = not (_real(left, "x") or _real(right, "x"))
    dealt, alone = _met_tiles(one, two)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tiles, sums = None, {}, {}  # the tiles of one by block; by pair of blocks their sums, which places have one, and a bound of them

        def result() -> Iterator[pa.RecordBatch]:
            for (p, q), (v, met, _) in sums.items():
                full, every = bool(met.all()), np.tile(np.arange(met.shape[1]) + q * TILE, min(64, len(v)))
                for a in range(0, len(v), 64):
                    if full:
                        x = v[a : a + 64].ravel()
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(a, min(a + 64, len(v))) + p * TILE, v.shape[1])), pa.array(every[: len(x)]), pa.array(x)], names=["i", "j", "v"])
                        continue
                    i, j = np.nonzero(met[a : a + 64])
                    if len(i):
                        i = i + a
                        yield pa.RecordBatch.from_arrays([pa.array(i + p * TILE), pa.array(j + q * TILE), pa.array(v[i, j])], names=["i", "j", "v"])
            sums.clear()

        def add(p: int, q: int, x: np.ndarray, u: np.ndarray | None, y: np.ndarray, w: np.ndarray | None) -> None:
            shape = (len(x), len(y)) if alone else (TILE, TILE)
            v, met, least = sums.get((p, q)) or (np.zeros(shape, np.int64 if whole else np.float64), np.zeros(shape, bool), 0.0)
            k = min(x.shape[1], y.shape[1])
            x, y = x[:, :k], y[:, :k]
            if whole:
                size = float(np.abs(x.astype(float)).max(initial=0)) * float(np.abs(y.astype(float)).max(initial=0)) * k
                least += size
                if least >= 2**63:
                    raise ValueError("sums may pass 64 bits")
                part = np.rint(x.astype(float) @ y.T.astype(float)).astype(np.int64) if size < 2**53 else x.astype(np.int64) @ y.T.astype(np.int64)
            else:
                part = x.astype(float) @ y.T.astype(float)
            v[: len(x), : len(y)] += part
            if u is None and w is None:
                met[: len(x), : len(y)] = True
            else:
                u, w = (np.ones(z.shape, np.float32) if o is None else o[:, :k].astype(np.float32) for o, z in ((u, x), (w, y)))
                met[: len(x), : len(y)] |= u @ w.T > 0
            sums[p, q] = v, met, least

        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                x = np.frombuffer(row["data"], row["kind"]).reshape(row["rows"], -1)
                u = np.frombuffer(row["there"], np.uint8).reshape(x.shape) if row["there"] else None
                if (row["p"], row["q"], row["kb"]) != now:
                    if now is not None and now[:2] != (row["p"], row["q"]):
                        yield from result()
                    now = row["p"], row["q"], row["kb"]
                    tiles.clear()
                if row["side"] == 0:
                    tiles[row["b"]] = x, u
                    continue
                for p, (y, w) in tiles.items():
                    add(p, row["b"], y, w, x, u)
                    if alone:
                        yield from result()
        yield from result()

    return dealt.mapInArrow(multiply, f"i bigint, j bigint, v {'bigint' if whole else 'double'}")


def matvec(a: DataFrame, x: DataFrame, ta: bool = False) -> DataFrame:
    """(i, v) of A x; x: (i, v)."""
    out = matmul(a, x.select("i", F.lit(0).alias("j"), "v"), ta)
    return out.select("i", "v")


def dot(x: DataFrame, y: DataFrame) -> DataFrame:
    """One row v: x'y of (i, v) each; 0 if they share no place."""
    both = x.select("i", F.col("v").alias("x")).join(y.select("i", F.col("v").alias("y")), "i")
    return both.agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("v"))


def dots(a: DataFrame, b: DataFrame) -> DataFrame:
    """(j, v): the dot product of each column of (i, j, v) with the column of that number of another matrix."""
    both = a.select("i", "j", F.col("v").alias("x")).join(b.select("i", "j", F.col("v").alias("y")), ["i", "j"])
    return both.groupBy("j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def quadratic(x: DataFrame, a: DataFrame) -> DataFrame:
    """One row v: x'A x. Cells of A beyond the places of x are an error: A is square and of its size."""
    places = x.select("i").distinct()
    outside = a.select(F.explode(F.array("i", "j")).alias("i")).distinct().join(places, "i", "left_anti")
    if not outside.isEmpty():
        raise ValueError("the matrix is not square of the vector's size")
    return dot(x, matvec(a, x))


def sandwich(x: DataFrame, a: DataFrame, y: DataFrame | None = None) -> DataFrame:
    """(i, j, v) of X A Y'; Y: X itself if it is not given."""
    return matmul(matmul(x, a), x if y is None else y, tb=True)


def bilinear(x: DataFrame, a: DataFrame, y: DataFrame) -> DataFrame:
    """One row v: x'A y."""
    return dot(x, matvec(a, y))


def scaled_rows(a: DataFrame, x: DataFrame) -> DataFrame:
    """diag(x) A."""
    return a.join(x.select("i", F.col("v").alias("x")), "i").select("i", "j", (F.col("v") * F.col("x")).alias("v"))


def divided_columns(a: DataFrame, x: DataFrame) -> DataFrame:
    """A diag(x)^-1; x: (j, v)."""
    return a.join(x.select("j", F.col("v").alias("x")), "j").select("i", "j", (F.col("v") / F.col("x")).alias("v"))


def checked_length(b: DataFrame, size: int) -> DataFrame:
    """(idx, col, v) from a vector (pos, v) of a length that is a multiple of size: one column for each time it fits."""
    n = b.count()
    if n % size:
        raise ValueError(f"{n} values are no multiple of {size}")
    return b.select(F.expr(f"pos % {size}").alias("idx"), F.expr(f"pos div {size}").alias("col"), "v")


def _centres(geno: DataFrame, centring: str, freq: DataFrame | None, centre: DataFrame | None) -> tuple[str, DataFrame]:
    """The axis that the centres belong to, and (k, c): twice the frequency of a SNP ("row"), the mean dosage of an
    individual over the SNPs ("column"), or a SNP's given centre ("user")."""
    from genospark.operators.stats import allele_freq, pseudo_freq

    if centring == "user":
        if centre is None:
            raise ValueError("a user's centring needs a centre for each SNP")
        return SNP, centre.select(F.col(SNP).alias("k"), F.col("centre").cast("double").alias("c"))
    if centring == "row":
        f = allele_freq(geno) if freq is None else freq
        return SNP, f.select(F.col(SNP).alias("k"), (2 * F.col("freq")).alias("c"))
    return INDIV, pseudo_freq(geno).select(F.col(INDIV).alias("k"), (2 * F.col("freq")).alias("c"))


def centred_product(raw: DataFrame, b: DataFrame, places: DataFrame, axis: str, outer: str, centres: DataFrame) -> DataFrame:
    """(idx, col, v): the product less that of the centres (k, c) of an axis, for each place (idx) of the outer axis and each
    column of b, also where raw, the product (idx, col, v), has no cell."""
    both = places.join(b.select("col").distinct()).join(raw, ["idx", "col"], "left")
    v = F.coalesce(F.col("v"), F.lit(0)).cast("double")
    if axis == outer:
        sums = b.groupBy("col").agg(F.sum("v").alias("__t"))
        out = both.join(sums, "col").join(centres.withColumnRenamed("k", "idx"), "idx", "left")
        return out.select("idx", "col", (v - F.coalesce("c", F.lit(0.0)) * F.col("__t")).alias("v"))
    sums = b.join(centres.withColumnRenamed("k", "idx"), "idx").groupBy("col").agg(F.sum(F.col("c") * F.col("v")).alias("__t"))
    return both.join(sums, "col", "left").select("idx", "col", (v - F.coalesce("__t", F.lit(0.0))).alias("v"))


def geno_product(geno: DataFrame, b: DataFrame, transposed: bool, center: bool = True, freq: DataFrame | None = None, centring: str = "row", normalize: str = "none", centre: DataFrame | None = None) -> DataFrame:
    """(idx, col, v) of (M - centres)B over individuals, or of its transpose's product over SNPs.
    geno: M by individuals; b: (idx, col, v) over the other axis; freq: (snp_idx, freq). centring: "row" takes twice a SNP's
    frequency off, "column" an individual's mean, "user" the SNP's value in centre (snp_idx, centre), "none" (or center=False)
    nothing. normalize "global" divides by the root of the sum of 2p(1-p). Absent cells are 0. A centred product has a row for
    each place of the axis and each column of b, others only where cells meet."""
    if centring not in CENTRING or normalize not in NORMALIZE:
        raise ValueError(f"centring is one of {CENTRING}, normalize one of {NORMALIZE}")
    inner, outer = (INDIV, SNP) if transposed else (SNP, INDIV)
    left = geno.select(F.col(inner).alias("__k"), F.col(outer).alias("idx"), DOSAGE)
    right = b.select(F.col("idx").alias("__k"), "col", F.col("v").alias("__b"))
    out = left.join(right, "__k").groupBy("idx", "col").agg(F.sum(F.col(DOSAGE) * F.col("__b")).alias("v"))
    if center and centring != "none":
        axis, centres = _centres(geno, centring, freq, centre)
        out = centred_product(out, b, geno.select(F.col(outer).alias("idx")).distinct(), axis, outer, centres)
    if normalize == "global":
        from genospark.operators.stats import derived

        out = out.join(F.broadcast(derived(geno).select("sigma2"))).select("idx", "col", (F.col("v") / F.sqrt("sigma2")).alias("v"))
    return out


def sparse_product(a: DataFrame, geno: DataFrame, transposed: bool = False) -> DataFrame:
    """(row, idx, v) of A M, A (row, col, v) over individuals, or over SNPs with the transpose of M."""
    inner, outer = (SNP, INDIV) if transposed else (INDIV, SNP)
    m = geno.select(F.col(inner).alias("col"), F.col(outer).alias("idx"), DOSAGE)
    return a.join(m, "col").groupBy("row", "idx").agg(F.sum(F.col("v") * F.col(DOSAGE)).alias("v"))


def times_012(a: DataFrame, x: DataFrame, transposed: bool = False, strict: bool = False) -> DataFrame:
    """A x (or x A) for a vector of 0, 1 and 2. Other values count as 0, or are an error if strict."""
    ok = F.col("v").isin(0, 1, 2)
    other = F.raise_error(F.lit("values other than 0, 1 and 2")).cast("double") if strict else F.lit(0.0)
    return matvec(a, x.select("i", F.when(ok, F.col("v")).otherwise(other).alias("v")), transposed)


def crossprod(geno: DataFrame, over: str = SNP, method: str = "blocked", depth: int | None = None, width: int | None = None) -> DataFrame:
    """(i, j, v bigint): sums of products over the axis `over`, for all pairs that the other one has, absent cells being 0.
    Dosages that are no integers, as imputed ones, give doubles.

    "blocked" packs the cells into lines of `width` places, four a byte, one for each place of `over` and block of the other axis, and
    multiplies two blocks at a time, line after line in order: a worker holds two batches of lines and width^2 sums. Cells
    are shuffled once, and lines as often as there are blocks, about 16 times a byte each for any size that `width` grows
    with. The axis `over` is cut into slices of a multiple of `depth` where there are fewer pairs of blocks than tasks.
    "join" joins the relation with itself: n^2 rows for each place of `over`."""
    keep, kind = INDIV if over == SNP else SNP, "bigint" if is_whole(geno) else "double"
    cells = geno.select(F.col(over).cast("bigint").alias("k"), F.col(keep).cast("bigint").alias("i"), F.col(DOSAGE).cast(kind).alias("x"))
    if method == "join":
        other = cells.select("k", F.col("i").alias("j"), F.col("x").alias("y"))
        upper = cells.join(other, "k").filter("i <= j").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))
    elif method == "blocked":
        upper = _blocked(cells, depth, width)
    else:
        raise ValueError(f"unknown method {method!r}")
    both = F.array(F.struct("i", "j", "v"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    return upper.select(F.explode(F.when(F.col("i") == F.col("j"), F.slice(both, 1, 1)).otherwise(both)).alias("c")).select("c.*")


def _blocked(cells: DataFrame, depth: int | None, width: int | None) -> DataFrame:
    spark = cells.sparkSession
    last, n, low, high = cells.agg(F.max("k"), F.max("i"), F.least(F.min("k"), F.min("i"), F.min("x")), F.max("x")).first()
    if last is None or n is None:
        return spark.createDataFrame([], f"i bigint, j bigint, v {cells.schema['x'].dataType.simpleString()}")
    whole = cells.schema["x"].dataType.simpleString() == "bigint"
    if low < 0 or (high or 0) > 127:
        raise ValueError("places are at least 0, and dosages between 0 and 127")
    last, n = last + 1, n + 1
    width = width or min(4096, max(64, -(-n // 1024) * 64))
    depth = depth or 4096
    blocks = -(-n // width)
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    slices = max(1, min(-(-last // depth), tasks // (blocks * (blocks + 1) // 2)))
    real = np.float32 if whole and (high or 0) ** 2 * 4096 < 2**24 else np.float64  # sums of up to 4,096 lines are exact
    cell, kind, four = (np.int8, "bigint", whole and (high or 0) < 4) if whole else (np.float64, "double", False)
    width = -(-width // 4) * 4 if four else width
    blocks = -(-n // width)
    powers = np.array([1, 4, 16, 64], np.uint8)
    opened = np.array([[b >> 2 * k & 3 for k in range(4)] for b in range(256)], real)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 2):
            b, k = t.column("b").to_numpy(), t.column("k").to_numpy()
            new = np.r_[True, (np.diff(b) != 0) | (np.diff(k) != 0)]
            line, at = np.cumsum(new) - 1, t.column("at").to_numpy()
            for a in range(0, int(line[-1]) + 1, 1024):
                lo, hi = np.searchsorted(line, [a, a + 1024])
                grid = np.zeros((line[hi - 1] - a + 1, width), cell)
                np.add.at(grid, (line[lo:hi] - a, at[lo:hi]), t.column("x").to_numpy()[lo:hi])
                if four:  # dosages of 2 bits travel four a byte
                    grid = (grid.reshape(len(grid), -1, 4).astype(np.uint8) * powers).sum(axis=2, dtype=np.uint8)
                first = np.flatnonzero(new[lo:hi]) + lo
                yield pa.RecordBatch.from_arrays([pa.array(b[first]), pa.array(k[first]), pa.array([row.tobytes() for row in grid], pa.binary())], names=["b", "k", "line"])

    placed = cells.select(F.expr(f"int(i div {width})").alias("b"), "k", F.expr(f"int(i % {width})").alias("at"), F.coalesce("x", F.lit(0)).cast("tinyint" if whole else "double").alias("x"))
    packed = placed.repartition(F.col("b"), F.expr(f"k div {depth}")).sortWithinPartitions("b", "k").mapInArrow(lines, "b int, k bigint, line binary")
    there = placed.select("b", "at").distinct().groupBy("b").agg(F.collect_list("at").alias("at"))
    present = spark.sparkContext.broadcast({r.b: np.sort(np.array(r["at"], np.int64)) for r in there.collect()})  # at most 8 bytes for each place of an axis whose pairs are the result

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, sums = None, None

        def result() -> Iterator[pa.RecordBatch]:
            p, q, _ = pair
            rows, columns = present.value[p], present.value[q]
            for a in range(0, len(rows), 64):
                some = rows[a : a + 64]
                i, j = (x.ravel() for x in np.meshgrid(some, columns, indexing="ij"))
                use = slice(None) if p < q else i <= j
                i, j = i[use], j[use]
                yield pa.RecordBatch.from_arrays([pa.array(i + p * width), pa.array(j + q * width), pa.array(sums[i, j])], names=["i", "j", "v"])

        for t in runs(batches, 4):
            keys = np.stack([t.column(c).to_numpy().astype(np.int64) for c in range(3)], axis=1)
            cuts = np.flatnonzero(np.r_[True, (np.diff(keys, axis=0) != 0).any(axis=1), True])
            k, side, data = t.column(3).to_numpy(), t.column(4).to_numpy(), t.column(5).to_pylist()
            for a, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                now = tuple(keys[a].tolist())
                if now != pair:
                    if pair is not None:
                        yield from result()
                    pair, sums = now, np.zeros((width, width), np.int64 if whole else np.float64)
                for x in range(a, e, 4096):
                    y = min(e, x + 4096)
                    while y < e and k[y] == k[y - 1]:  # both lines of a place together
                        y += 1
                    while a < x < y and k[x] == k[x - 1]:
                        x += 1
                    if x >= y:
                        continue
                    m = np.frombuffer(b"".join(data[x:y]), np.uint8 if four else cell).reshape(y - x, -1)
                    left = right = np.arange(y - x)
                    if now[0] != now[1]:
                        s = side[x:y]
                        one, two = np.flatnonzero(s == 0), np.flatnonzero(s == 1)
                        _, u, w = np.intersect1d(k[x:y][one], k[x:y][two], assume_unique=True, return_indices=True)
                        left, right = one[u], two[w]
                    if len(left):
                        taken = lambda at: opened[m[at]].reshape(len(at), width) if four else m[at].astype(real)
                        f = taken(left)
                        part = f.T @ (f if left is right else taken(right))
                        sums += np.rint(part).astype(np.int64) if whole else part
        if pair is not None:
            yield from result()

    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o")
    dealt = packed.select("b", "k", "line", other).select(F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"), F.expr(f"int(k div {depth} % {slices})").alias("s"), "k", (F.col("b") > F.col("o")).cast("tinyint").alias("side"), "line")
    parts = dealt.repartition("p", "q", "s").sortWithinPartitions("p", "q", "s", "k", "side").mapInArrow(products, f"i bigint, j bigint, v {kind}")
    return parts if slices == 1 else parts.groupBy("i", "j").agg(F.sum("v").alias("v"))


def row_sums(geno: DataFrame, over: str = SNP) -> DataFrame:
    """(i, s): sums of the rows of the crossproduct, as two products with a vector; a written table, which the planner broadcasts
    while it is small."""
    keep = INDIV if over == SNP else SNP
    line = geno.groupBy(over).agg(total(geno).alias("__s"))
    return written(geno.join(line, over).groupBy(F.col(keep).alias("i")).agg(total(geno, F.col(DOSAGE) * F.col("__s")).alias("s")), "row_sums")


def _doubly_centred(geno: DataFrame, m: DataFrame, over: str) -> DataFrame:
    """(i, j, n, g): n^2 times the doubly centred crossproduct, as an integer; refused where that is no longer exact in a double.
    A double where dosages are no integers."""
    r = row_sums(geno, over)
    tot, n = r.agg(F.sum("s"), F.count("*")).first()
    places = geno.select(over).distinct().count()
    if is_whole(geno) and 4 * places * n * n > 2**52:
        raise ValueError(f"{places} x {n} is too large for an exact relationship matrix")
    out = m.join(r.withColumnRenamed("s", "si"), "i").join(r.select(F.col("i").alias("j"), F.col("s").alias("sj")), "j")
    return out.select("i", "j", F.lit(n).cast("bigint").alias("n"), (n * n * F.col("v") - n * (F.col("si") + F.col("sj")) + F.lit(tot or 0)).alias("g"))


def grm(geno: DataFrame, scale: bool = True, method: str = "blocked") -> DataFrame:
    """(i, j, g_int, g) over individuals: n^2 times the doubly centred crossproduct as an integer (a double where dosages are
    imputed), and the relationship, divided by the sum of 2p(1-p) if scale."""
    from genospark.operators.stats import derived

    joined = _doubly_centred(geno, crossprod(geno, SNP, method), SNP).join(F.broadcast(derived(geno).select("sigma2")))
    real = F.col("g").cast("double") / (F.col("n") * F.col("n"))
    return joined.select("i", "j", F.col("g").alias("g_int"), (real / F.col("sigma2") if scale else real).alias("g"))


def _moments(geno: DataFrame, axis: str) -> DataFrame:
    """(k, s, n, q): sum, count and sum of squares of the dosages at each place of an axis, a written table. Every place
    must have a dosage for all places of the other axis: one mean for each holds for no pair else."""
    other = SNP if axis == INDIV else INDIV
    x = F.col(DOSAGE).cast("bigint" if is_whole(geno) else "double")
    per = written(geno.groupBy(F.col(axis).alias("k")).agg(F.sum(x).alias("s"), F.count(DOSAGE).alias("n"), F.sum(x * x).alias("q")), "moments")
    most, least = per.agg(F.max("n"), F.min("n")).first()
    if most is not None and not most == least == geno.select(other).distinct().count():
        raise ValueError("correlations need every dosage; settle missing ones first")
    return per


def ld(geno: DataFrame, squared: bool = False, method: str = "blocked") -> DataFrame:
    """(i, j, r) over SNPs: Pearson's correlation of dosages, or its square. NULL for a SNP without variation; a missing
    dosage is an error."""
    per = _moments(geno, SNP).withColumn("v", F.col("n") * F.col("q") - F.col("s") * F.col("s"))
    a, b = per.select(F.col("k").alias("i"), F.col("s").alias("si"), "n", F.col("v").alias("vi")), per.select(F.col("k").alias("j"), F.col("s").alias("sj"), F.col("v").alias("vj"))
    r = (F.col("n") * F.col("v") - F.col("si") * F.col("sj")) / F.nullif(F.sqrt(F.col("vi").cast("double")) * F.sqrt(F.col("vj").cast("double")), F.lit(0.0))
    return crossprod(geno, INDIV, method).join(a, "i").join(b, "j").select("i", "j", (r * r if squared else r).alias("r"))


def centred_crossprod(geno: DataFrame, over: str = SNP, centring: str = "row", normalize: str = "none", squared: bool = False, method: str = "blocked") -> DataFrame:
    """(i, j, v): the crossproduct over an axis, centred by the means along it ("row") or across it ("column"),
    then divided by the roots of its diagonal ("centring") or by the sum of 2p(1-p) ("global")."""
    if centring not in CENTRING or normalize not in NORMALIZE:
        raise ValueError(f"centring is one of {CENTRING}, normalize one of {NORMALIZE}")
    m = crossprod(geno, over, method)
    outer = INDIV if over == SNP else SNP
    if centring == "column":  # of each column of pairs: its own mean
        s = _moments(geno, outer).select(F.col("k").alias("i"), "s", "n")
        out = m.join(s, "i").join(s.select(F.col("i").alias("j"), F.col("s").alias("t")), "j").select("i", "j", (F.col("v") - F.col("s") * F.col("t") / F.col("n")).alias("v"))
    elif centring == "row":  # of each contracted row: the mean over the columns
        out = _doubly_centred(geno, m, over).select("i", "j", (F.col("g").cast("double") / (F.col("n") * F.col("n"))).alias("v"))
    else:
        out = m.select("i", "j", F.col("v").cast("double").alias("v"))
    if normalize == "global":
        from genospark.operators.stats import derived

        out = out.join(F.broadcast(derived(geno).select("sigma2"))).select("i", "j", (F.col("v") / F.col("sigma2")).alias("v"))
    elif normalize == "centring":
        out = written(out, "centred")
        d = written(out.filter("i = j").select("i", F.sqrt("v").alias("di")), "diagonal")
        out = out.join(d, "i").join(d.select(F.col("i").alias("j"), F.col("di").alias("dj")), "j").select("i", "j", (F.col("v") / F.nullif(F.col("di") * F.col("dj"), F.lit(0.0))).alias("v"))
    return out.select("i", "j", F.col("v") * F.col("v")).toDF("i", "j", "v") if squared else out


def relationship_vector(geno: DataFrame, x: DataFrame, over: str = SNP) -> DataFrame:
    """(i, v): the uncentred crossproduct over an axis times x, as two products; no matrix of pairs is made. Over SNPs x and the
    result lie over individuals, over individuals they lie over SNPs."""
    b = x.select(F.col("i").alias("idx"), F.lit(0).alias("col"), "v")
    first = geno_product(geno, b, over == SNP, center=False)
    return geno_product(geno, first, over != SNP, center=False).select(F.col("idx").alias("i"), "v")


def relationship_agreement(geno: DataFrame, x: DataFrame, over: str = SNP) -> DataFrame:
    """One row most, size: the largest difference between relationship_vector() and the product with the matrix of pairs, and
    the largest value of the latter."""
    m = matvec(crossprod(geno, over), x).withColumnRenamed("v", "w")
    both = relationship_vector(geno, x, over).join(m, "i", "full")
    return both.agg(F.max(F.abs(F.coalesce("v", F.lit(0)) - F.coalesce("w", F.lit(0)))).cast("double").alias("most"), F.max(F.abs("w")).cast("double").alias("size"))


def is_close(a: Column, b: Column, tolerance: float = 1e-10) -> Column:
    return F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))


