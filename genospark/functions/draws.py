"""Random numbers as columns: functions of a seed and a cell.

The first 52 bits of an MD5 over the seed and the cell's keys. A cell's number is the same however rows are
partitioned, whatever else is drawn, and after a lost task; other engines can repeat it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *cell: Column) -> Column:
    """At least 0 and below 1. Keys are taken as text, NULL as none."""
    keys = [F.coalesce(c.cast("string"), F.lit("")) for c in cell]
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *keys)), 1, 13), 16, 10).cast("bigint")
    return bits / F.lit(float(1 << 52))


def normal(seed: int, *cell: Column) -> Column:
    """Of mean 0 and variance 1, from two uniform numbers."""
    radius = F.sqrt(-2 * F.log(1 - uniform(seed, *cell, F.lit("r"))))
    return radius * F.cos(2 * math.pi * uniform(seed, *cell, F.lit("a")))
