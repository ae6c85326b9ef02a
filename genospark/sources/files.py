"""Bytes at given places of one file, written by the executors where they can open its path.

A path with the scheme file, or none, is one that all machines mount; then each task writes its own bytes at
their places, and a task that runs again writes the same. Other paths are written through Hadoop by the driver, in order.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genospark.plans.batches import runs
from genospark.plans.tables import written


def local(path: str) -> str | None:
    """The path as open() takes it; None for one in another store."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return None if "://" in path else path


def opened(path: str):
    """A seekable binary file to read from, of any store that pyarrow knows."""
    if own := local(path):
        return open(own, "rb")
    from pyarrow import fs

    store, rest = fs.FileSystem.from_uri(path)
    return store.open_input_file(rest)


def size_of(path: str) -> int:
    if own := local(path):
        return os.path.getsize(own)
    with opened(path) as f:
        return f.size()


def write_at(rows: DataFrame, path: str, size: int, head: bytes = b"") -> int:
    """A file of that size: head, then data at each `at` of rows (at, data). Gives how many bytes of data there were; other bytes
    are 0. Data must not overlap, as where it does, any may win."""
    spark, own = rows.sparkSession, local(path)
    if own is None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
        out.write(bytearray(head))
        at, n = len(head), 0
        for r in rows.orderBy("at").toLocalIterator():
            out.write(bytearray(r["at"] - at) + r["data"])
            at, n = r["at"] + len(r["data"]), n + len(r["data"])
        out.write(bytearray(size - at))
        out.close()
        return n
    os.makedirs(os.path.dirname(own) or ".", exist_ok=True)
    with open(own, "wb") as f:
        f.write(head)
        f.truncate(size)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(own, "r+b") as f:
            for batch in batches:
                n = 0
                for at, data in zip(batch.column("at").to_pylist(), batch.column("data").to_pylist(), strict=True):
                    f.seek(at)
                    n += f.write(data)
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])
            f.flush()
            os.fsync(f.fileno())

    return rows.select(F.col("at").cast("bigint").alias("at"), "data").mapInArrow(put, "n bigint").agg(F.sum("n")).first()[0] or 0


def write_lines(rows: DataFrame, path: str, n: int) -> None:
    """One text file of rows (at, line), in order of `at`, which must be 0 to n - 1. Ranges of `at` are joined each to one piece;
    only the pieces' sizes meet in one place, to say where each begins."""
    spark = rows.sparkSession
    step = 100_000

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 1):
            piece, at = t.column("piece").to_numpy(), t.column("at").to_numpy()
            cuts = np.flatnonzero(np.r_[True, np.diff(piece) != 0, True])
            for a, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                first = int(piece[a]) * step
                if first < 0 or e - a != min(step, n - first) or (at[a:e] != np.arange(first, first + e - a)).any():
                    raise ValueError("places are missing or repeated")
                data = "\n".join([*t.column("line").slice(a, e - a).to_pylist(), ""]).encode()
                yield pa.RecordBatch.from_arrays([pa.array(piece[a : a + 1]), pa.array([data], pa.binary())], names=["piece", "data"])

    placed = rows.select(F.expr(f"cast(at div {step} as bigint)").alias("piece"), F.col("at").cast("bigint").alias("at"), "line")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // step))
    dealt = placed.repartition(tasks, "piece").sortWithinPartitions("piece", "at")
    made = written(dealt.mapInArrow(join, "piece bigint, data binary"), "lines")
    sizes = made.select("piece", F.length("data").cast("bigint").alias("size"))
    upto = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # a row for every 100,000 lines
    starts = sizes.withColumn("at", F.coalesce(F.sum("size").over(upto), F.lit(0)))
    total, count = starts.agg(F.sum("size"), F.count("*")).first()
    if count != -(-n // step):
        raise ValueError(f"there are not {n} lines")
    write_at(made.join(F.broadcast(starts.select("piece", "at")), "piece").select("at", "data"), path, total or 0)
