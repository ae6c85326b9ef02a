"""Symmetric systems of any size as tables of dense tiles: (p, q, data), data being the bytes of a side x side block.

Tiles without a cell are not stored, and those that stay without one are never made: a matrix with few
tiles near its diagonal is factored in that many steps' worth of work. The driver holds one tile at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genospark.plans.tables import written

TILES = "p bigint, q bigint, data binary"


def tiles_of(m: DataFrame, side: int) -> DataFrame:
    """Tiles of (i, j, v)."""

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((side, side))
        np.add.at(out, (rows["i"].to_numpy(), rows["j"].to_numpy()), rows["v"].to_numpy())
        return pd.DataFrame({"p": [key[0]], "q": [key[1]], "data": [out.tobytes()]})

    cells = m.select(F.expr(f"i div {side}").alias("p"), F.expr(f"j div {side}").alias("q"), F.expr(f"int(i % {side})").alias("i"), F.expr(f"int(j % {side})").alias("j"), F.col("v").cast("double").alias("v"))
    return cells.groupBy("p", "q").applyInPandas(pack, TILES)


def cells_of(tiles: DataFrame, side: int, rows: int, columns: int, lower: bool = False) -> DataFrame:
    """(i, j, v) of tiles within rows x columns; lower: not those above the diagonal."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, q, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                m = np.frombuffer(data).reshape(side, side)[: rows - p * side, : columns - q * side]
                for a in range(0, len(m), 64):
                    i, j = (x.ravel() for x in np.meshgrid(np.arange(a, min(a + 64, len(m))), np.arange(m.shape[1]), indexing="ij"))
                    use = slice(None) if not lower or p > q else j <= i
                    i, j = i[use], j[use]
                    yield pa.RecordBatch.from_arrays([pa.array(i + p * side), pa.array(j + q * side), pa.array(m[i, j])], names=["i", "j", "v"])

    return single(tiles).mapInArrow(unpack, "i bigint, j bigint, v double")


def single(tiles: DataFrame) -> DataFrame:
    """Tiles dealt out by place, so that no task has more than its part of them."""
    return tiles.repartition("p", "q")


def _each(tiles: DataFrame, f: Callable[[np.ndarray], np.ndarray], side: int) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(data=[np.ascontiguousarray(f(np.frombuffer(x).reshape(side, side))).tobytes() for x in rows["data"]])

    return tiles.groupBy("p", "q").applyInPandas(run, TILES)


def _less_products(tiles: DataFrame, left: DataFrame, right: DataFrame, side: int, transposed: bool, wanted: DataFrame | None = None) -> DataFrame:
    """tiles (p, q) less left (p) times right (q), or its transpose. left: (p, data), right: (q, data); each pair of them is a
    product, in wanted (p, q) if that is given."""
    pairs = left.select("p").join(F.broadcast(right.select("q"))) if wanted is None else wanted
    pairs = written(pairs, "pairs")
    parts = tiles.select("p", "q", F.lit(0).alias("kind"), "data")
    parts = parts.unionByName(left.join(pairs, "p").select("p", "q", F.lit(1).alias("kind"), "data"))
    parts = parts.unionByName(right.join(pairs, "q").select("p", "q", F.lit(2).alias("kind"), "data"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = {k: np.frombuffer(x).reshape(side, side) for k, x in zip(rows["kind"], rows["data"], strict=True)}
        out = found.get(0, np.zeros((side, side)))
        if 1 in found:
            out = out - found[1] @ (found[2].T if transposed else found[2])
        return pd.DataFrame({"p": [key[0]], "q": [key[1]], "data": [np.ascontiguousarray(out).tobytes()]})

    return written(parts.groupBy("p", "q").applyInPandas(run, TILES), "tiles")


def _at(tiles: DataFrame, k: int, side: int) -> np.ndarray | None:
    row = tiles.filter((F.col("p") == k) & (F.col("q") == k)).select("data").first()
    return None if row is None else np.frombuffer(bytes(row[0])).reshape(side, side)


def _filled(diagonal: np.ndarray, k: int, n: int) -> np.ndarray:
    """The last diagonal tile with ones beyond the matrix."""
    over = np.arange(len(diagonal)) + k * len(diagonal) >= n
    return diagonal + np.diag(over.astype(float))


def factor(a: DataFrame, n: int, side: int) -> DataFrame:
    """Tiles of the lower Cholesky factor of (i, j, v), column of tiles by column; LinAlgError where A is not positive definite."""
    rest = written(tiles_of(a.filter("i >= j").unionByName(a.filter(f"i < j AND i div {side} = j div {side}")), side), "tiles")
    done: DataFrame | None = None
    for k in range(-(-n // side)):
        diagonal = _at(rest, k, side)
        if diagonal is None:
            raise np.linalg.LinAlgError("a block of the diagonal is empty")
        diagonal = _filled(diagonal, k, n)
        f = np.linalg.cholesky((diagonal + diagonal.T) / 2)
        back = np.linalg.inv(f).T
        below = written(_each(rest.filter((F.col("q") == k) & (F.col("p") > k)), lambda x, back=back: x @ back, side), "panel")
        own = a.sparkSession.createDataFrame([(k, k, bytearray(f.tobytes()))], TILES)
        column = written(own.unionByName(below), "column")
        done = column if done is None else done.unionByName(column)
        places = below.select("p")
        pairs = places.join(F.broadcast(places.select(F.col("p").alias("q")))).filter("p >= q")
        rest = _less_products(rest.filter((F.col("q") > k)), below.select("p", "data"), below.select(F.col("p").alias("q"), "data"), side, True, pairs)
    return done if done is not None else rest


def substituted(f: DataFrame, b: DataFrame, n: int, side: int, transposed: bool) -> DataFrame:
    """Tiles of L^-1 B, or of L'^-1 B: a row of tiles at a time."""
    steps = -(-n // side)
    rest, done = b, None
    for k in reversed(range(steps)) if transposed else range(steps):
        d = _at(f, k, side)
        back = np.linalg.inv(_filled(d, k, n) if not d.any(axis=1).all() else d)
        back = back.T if transposed else back
        row = written(_each(rest.filter(F.col("p") == k), lambda x, back=back: back @ x, side), "row")
        done = row if done is None else done.unionByName(row)
        if transposed:  # rows above: L[k, p]'
            left = f.filter((F.col("p") == k) & (F.col("q") < k)).select(F.col("q").alias("p"), "data")
            left = _each(left.withColumn("q", F.lit(0).cast("bigint")), lambda x: x.T, side).select("p", "data")
            rest = rest.filter(F.col("p") < k)
        else:
            left = f.filter((F.col("q") == k) & (F.col("p") > k)).select("p", "data")
            rest = rest.filter(F.col("p") > k)
        rest = _less_products(rest, left, row.select("q", "data"), side, False)
    return done if done is not None else rest


def log_determinant(f: DataFrame, n: int, side: int) -> float:
    """Of A, from the tiles of its factor."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"v": [float(np.log(np.diag(np.frombuffer(x).reshape(side, side))[: n - p * side]).sum()) for p, x in zip(rows["p"], rows["data"], strict=True)]})

    diagonal = f.filter("p = q").groupBy("p", "q").applyInPandas(run, "v double")
    return 2 * (diagonal.agg(F.sum("v")).first()[0] or 0.0)


def flipped(tiles: DataFrame, side: int) -> DataFrame:
    """Tiles of the transpose."""
    turned = _each(tiles, lambda x: x.T, side)
    return turned.select(F.col("q").alias("p"), F.col("p").alias("q"), "data")


def inverted_diagonal(f: DataFrame, n: int, side: int) -> DataFrame:
    """f with its diagonal tiles inverted, ones standing in beyond n; ZeroDivisionError for a zero on the diagonal."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        k, data = int(rows["p"].iloc[0]), np.frombuffer(rows["data"].iloc[0]).reshape(side, side)
        d = np.tril(data)
        over = np.arange(side) + k * side >= n
        d = d + np.diag(over * (1.0 - np.diag(d)))
        if not np.diag(d).all():
            raise ZeroDivisionError("a zero on the diagonal")
        return rows.assign(data=[np.linalg.inv(d).tobytes()])

    diagonal = f.filter("p = q").groupBy("p", "q").applyInPandas(run, TILES)
    return written(diagonal.unionByName(f.filter("p > q")), "analysed")


def wavefronts(pattern: list[tuple[int, int]], steps: int, transposed: bool) -> list[list[int]]:
    """Rows of tiles of a lower factor that can be solved at once, in order, from the places of its tiles: a row waits for those that it
    refers to."""
    level = [0] * steps
    after: list[list[int]] = [[] for _ in range(steps)]
    for p, q in pattern:
        if p > q:
            after[p if transposed else q].append(q if transposed else p)
    for k in reversed(range(steps)) if transposed else range(steps):
        for other in after[k]:
            level[other] = max(level[other], level[k] + 1)
    out: list[list[int]] = [[] for _ in range(max(level, default=-1) + 1)]
    for k, x in enumerate(level):
        out[x].append(k)
    return out


def swept(f: DataFrame, fronts: list[list[int]], b: DataFrame, side: int, transposed: bool) -> DataFrame:
    """Tiles of L^-1 B or L'^-1 B, from a factor with inverted_diagonal() and the wavefronts for it: two jobs for each
    wavefront, all of whose rows of tiles are solved at once."""
    rest, done = b, None
    turned = lambda x: x.T if transposed else x
    for rows in fronts:
        ready = F.col("p").isin(rows)
        back = f.filter(ready & (F.col("p") == F.col("q"))).select("p", F.col("data").alias("back"))
        pairs = rest.filter(ready).join(back, "p")

        def solve(t: pd.DataFrame) -> pd.DataFrame:
            out = [np.ascontiguousarray(turned(np.frombuffer(d).reshape(side, side)) @ np.frombuffer(x).reshape(side, side)).tobytes() for d, x in zip(t["back"], t["data"], strict=True)]
            return t[["p", "q"]].assign(data=out)

        row = written(pairs.groupBy("p", "q").applyInPandas(solve, TILES), "row")
        done = row if done is None else done.unionByName(row)
        if rows is fronts[-1]:
            break
        left = f.filter(F.col("p" if transposed else "q").isin(rows) & (F.col("p") > F.col("q")))
        left = left.select(F.col("q" if transposed else "p").alias("to"), F.col("p" if transposed else "q").alias("p"), F.col("data").alias("l"))
        parts = left.join(row, "p").select(F.col("to").alias("p"), "q", "l", "data").unionByName(rest.filter(~ready).select("p", "q", F.lit(None).cast("binary").alias("l"), "data"))

        def less(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros((side, side))
            for lower, x in zip(t["l"], t["data"], strict=True):
                x = np.frombuffer(x).reshape(side, side)
                total += x if lower is None else -(turned(np.frombuffer(lower).reshape(side, side)) @ x)
            return pd.DataFrame({"p": [key[0]], "q": [key[1]], "data": [total.tobytes()]})

        rest = written(parts.groupBy("p", "q").applyInPandas(less, TILES), "tiles")
    return done if done is not None else rest


def _chosen(panel: DataFrame, side: int) -> list[int]:
    """The rows of a panel (p, q, data) that tournament pivoting picks: each tile's best by elimination with row exchanges, then the best
    of sixteen tiles' best, until one set is left."""

    def best(m: np.ndarray) -> np.ndarray:
        m, order = m.copy(), np.arange(len(m))
        for c in range(min(m.shape)):
            k = c + int(np.argmax(np.abs(m[c:, c])))
            m[[c, k]], order[[c, k]] = m[[k, c]], order[[k, c]]
            if m[c, c]:
                m[c + 1 :, c:] -= np.outer(m[c + 1 :, c] / m[c, c], m[c, c:])
        return order[: min(side, len(order))]

    def play(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("p")
        m = np.concatenate([np.frombuffer(x).reshape(-1, side) for x in t["data"]])
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in t["ids"]])
        pick = best(m)
        return pd.DataFrame({"p": [int(key[0])], "ids": [ids[pick].tobytes()], "data": [np.ascontiguousarray(m[pick]).tobytes()]})

    def named(t: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"p": t["p"], "ids": [(np.arange(side) + p * side).tobytes() for p in t["p"]], "data": t["data"]})

    schema = "p bigint, ids binary, data binary"
    field = panel.groupBy("p", "q").applyInPandas(named, schema)
    field = written(field.groupBy("p").applyInPandas(play, schema), "pivots")
    while field.count() > 1:
        field = written(field.groupBy(F.expr("p div 16").alias("r")).applyInPandas(play, schema), "pivots")
    return np.frombuffer(bytes(field.first().ids), np.int64).tolist()


def _exchanged(tiles: DataFrame, moves: dict[int, int], side: int) -> DataFrame:
    """tiles with rows moved: from -> to, a permutation of those rows (at most 2 sides of them)."""
    blocks = sorted({x // side for x in moves})

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            out: list[tuple] = []
            for p, q, data in zip(t["p"].tolist(), t["q"].tolist(), t["data"], strict=True):
                m = np.frombuffer(data).reshape(side, side)
                out.append((p, q, -1, data))
                out.extend((moves[p * side + r] // side, q, moves[p * side + r] % side, m[r].tobytes()) for r in range(side) if p * side + r in moves)
            yield pd.DataFrame(out, columns=["p", "q", "r", "data"])

    def put(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((side, side))
        for data in t["data"][t["r"] < 0]:
            m = np.frombuffer(data).reshape(side, side).copy()
        for old, new in moves.items():
            if new // side == key[0]:
                m[new % side] = 0
        for r, data in zip(t["r"], t["data"], strict=True):
            if r >= 0:
                m[r] = np.frombuffer(data)
        return pd.DataFrame({"p": [key[0]], "q": [key[1]], "data": [m.tobytes()]})

    own = F.col("p").isin(blocks)
    rows = tiles.filter(own).mapInPandas(take, "p bigint, q bigint, r int, data binary")
    return written(tiles.filter(~own).unionByName(rows.groupBy("p", "q").applyInPandas(put, TILES)), "tiles")


def eliminated(a: DataFrame, b: DataFrame, n: int, side: int) -> tuple[DataFrame, DataFrame]:
    """Tiles of U' (lower) and of L^-1 P B, with P A = L U, for cells (i, j, v) of a regular A: a panel of tiles at a time, whose
    pivot rows a tournament finds. LinAlgError where A is singular. The driver holds a diagonal tile and a panel's pivot rows."""
    steps = -(-n // side)
    ones = a.sparkSession.range(n, steps * side).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))
    cells = a.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.col("v").cast("double").alias("v"))
    right = b.select(F.col("i").cast("bigint").alias("i"), (F.col("j") + steps * side).cast("bigint").alias("j"), F.col("v").cast("double").alias("v"))
    rest = written(tiles_of(cells.unionByName(ones).unionByName(right), side), "tiles")
    upper: DataFrame | None = None
    for k in range(steps):
        panel = rest.filter((F.col("q") == k) & (F.col("p") >= k))
        if panel.isEmpty():
            raise np.linalg.LinAlgError("the matrix is singular")
        chosen = _chosen(panel, side)
        own = list(range(k * side, (k + 1) * side))
        stay = set(chosen) & set(own)
        out = [r for r in own if r not in stay]
        come = [r for r in chosen if r not in stay]
        moves = dict(zip(come, out, strict=False)) | dict(zip(out, come, strict=False))
        if moves:
            rest = _exchanged(rest, moves, side)
        d = _at(rest, k, side)
        order, low, up = np.arange(side), np.eye(side), (np.zeros((side, side)) if d is None else d.copy())
        for c in range(side):  # rows of the block among themselves
            r = c + int(np.argmax(np.abs(up[c:, c])))
            if abs(up[r, c]) < 1e-300:
                raise np.linalg.LinAlgError("the matrix is singular")
            up[[c, r]], order[[c, r]] = up[[r, c]], order[[r, c]]
            low[[c, r], :c] = low[[r, c], :c]
            f = up[c + 1 :, c] / up[c, c]
            low[c + 1 :, c] = f
            up[c + 1 :, c:] -= np.outer(f, up[c, c:])
            up[c + 1 :, c] = 0
        first, last = np.linalg.inv(low), np.linalg.inv(up)
        row = written(_each(rest.filter((F.col("p") == k) & (F.col("q") > k)), lambda x, first=first, order=order: first @ x[order], side), "row")
        column = written(_each(rest.filter((F.col("q") == k) & (F.col("p") > k)), lambda x, last=last: x @ last, side), "column")
        diagonal = a.sparkSession.createDataFrame([(k, k, bytearray(np.ascontiguousarray(up).tobytes()))], TILES)
        made = diagonal.unionByName(row)
        upper = made if upper is None else upper.unionByName(made)
        rest = _less_products(rest.filter((F.col("p") > k) & (F.col("q") > k)), column.select("p", "data"), row.select("q", "data"), side, False)
    everything = written(upper, "upper")
    u = written(flipped(everything.filter(F.col("q") < steps), side), "upper")
    y = everything.filter(F.col("q") >= steps).select("p", (F.col("q") - steps).alias("q"), "data")
    return u, y
