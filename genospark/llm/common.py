"""What the corpus operators share: words, row keys and tables in the shared folder."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genospark.plans.tables import written

#: The six code points that separate words.
SPACES = " \t\n\x0b\f\r"
#: A run of them, for split().
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: A word.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def kept_in_process(key: str, make: Callable, version: str = "", large: bool = False):
    """make(), once for each Python worker: what tasks of a reused worker can share. Another version
    takes the place of the one before, only the two used last are kept, and a large one only
    until something else is made."""
    holder = vars(sys.modules.setdefault("_genospark_kept", types.ModuleType("_genospark_kept"))).setdefault("kept", {})
    found = holder.pop(key, None)
    if found is None or found[0] != version:
        found = None
        for old in [k for k, x in holder.items() if x[2]] + list(holder)[:-1]:
            holder.pop(old, None)
        found = (version, make(), large)
    holder[key] = found
    return found[1]


def shipped(spark: SparkSession, key: str, value) -> Callable:
    """A function for the workers that gives value, sent as a broadcast and unpacked once for each worker.
    value: of bounded size."""
    data, version = spark.sparkContext.broadcast(cloudpickle.dumps(value)), uuid.uuid4().hex
    return lambda: kept_in_process(key, lambda: cloudpickle.loads(data.value), version)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of so many rows at most: a Python worker then holds a few MB of text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def words(text: Column) -> Column:
    """The words of a text in order; none for null and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row, not once for each use."""
    return F.transform(F.array(value), body)[0]


def hashed(bits: int, *parts: Column) -> Column:
    """The first bits (a multiple of 4) of an MD5 over the parts, as a long; null parts count as empty."""
    joined = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, bits // 4), 16, 10).cast("bigint")


def text_digest(text: Column) -> Column:
    """With doc_id it names a record: rows that agree in both are one record, repeated."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns named by number, so that no name of its own can clash with an operator's or needs
    quoting, and the number of each name (case as Spark takes it: the first of like names)."""
    names = [f"_c{k}_" for k in range(len(docs.columns))]
    places: dict[str, str] = {}
    for name, place in zip(docs.columns, names, strict=True):
        places.setdefault(name, place)
        places.setdefault(name.lower(), place)
    return docs.toDF(*names), places


def restored(df: DataFrame, docs: DataFrame, results: dict[str, Column], keep: tuple[str, ...] | None = None) -> DataFrame:
    """The numbered columns (those in keep, if given) under their own names again, then the results; a column of docs whose
    name, but for case, is a result's gives way."""
    given = {r.lower() for r in results}
    own = [(f"_c{k}_", name) for k, name in enumerate(docs.columns) if name.lower() not in given and (keep is None or name in keep)]
    return df.select(*[F.col(c) for c, _ in own], *[c.alias(r) for r, c in results.items()]).toDF(*[name for _, name in own], *results)


def record_key(doc_id: Column, th: Column) -> Column:
    """A string that names a record; never null."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), th.cast("string"))


#: A key with more than this part of the rows counts as hot: there are fewer than HOT such keys.
HOT = 1000


def joined_by_key(rows: DataFrame, groups: DataFrame, by: list[str], n: str, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with groups, which has one row for each key and in n how many of the rows have
    it, or about. Groups with more than 1 / HOT of all rows, fewer than HOT of them, are broadcast; so no
    task of the other join gets many rows of one key. Both should be written tables or cheap."""
    groups = written(groups, "groups")
    total, most = (x or 0 for x in groups.agg(F.sum(n), F.max(n)).first())
    if most * HOT <= total:
        return rows.join(groups.drop(n), by, how)
    hot = F.broadcast(groups.filter(F.col(n) * HOT > total))
    rest = rows.join(hot.select(*by), by, "left_anti").join(groups.filter(F.col(n) * HOT <= total).drop(n), by, how)
    return rows.join(hot.drop(n), by).unionByName(rest)
