"""Arrow batches of sorted partitions, group by group, and the memory of those who read them."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc


def runs(batches: Iterable[pa.RecordBatch], by: int) -> Iterator[pa.Table]:
    """From batches of a partition that is sorted by its first columns (`by` of them), tables of whole
    groups: rows of a group never fall in two. Holds one batch and one group at most."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None or not held.num_rows else pa.concat_tables([held, t])
        n = held.num_rows
        if n < 2:
            continue
        last = pa.array([True] * n)
        for c in range(by):
            column = held.column(c).combine_chunks()
            last = pc.and_(last, pc.equal(column, column[n - 1]))
        start = pc.index(last, True).as_py()
        if start:
            yield held.slice(0, start).combine_chunks()
            held = held.slice(start).combine_chunks()
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def keep_freed_memory() -> None:
    """Lets this worker's allocator reuse the arrays of one step for the next, where it is glibc's; it
    would else give them back and have every page cleared anew."""
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt:
        mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        mallopt(-1, 128 << 20)  # M_TRIM_THRESHOLD
