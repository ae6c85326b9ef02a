"""Order-independent fingerprints of documents that follow edits without a second reading.

A paragraph is what line feeds part. It is hashed into a wide vector, and a text's
fingerprint is the sum of the vectors of its paragraphs: LANES lanes of 64 bits from BLAKE2b, added modulo 2^64, which
tell multisets of paragraphs apart, then SKETCH lanes of 16 bits, added modulo 2^16, which tell how
alike they are: every 8-byte gram of a paragraph adds 1 to one of them or takes 1 off, by its hash. Adding or
taking off a paragraph's vector is all that its insertion or deletion takes, and texts of
the same paragraphs in another order agree.

Likeness: 1 - |a - b|^2 / (|a|^2 + |b|^2) of the sketches, between 0 and 1. It estimates twice the common grams
over all grams, each gram weighing the square of its count (error about 1 / 16), and is 1 for equal fingerprints. A lane
whose sum passes 32,767 starts anew at -32,768, which a gram repeated so often in one text can bring about.

Documents follow one another by descending doc_id. Their keys alone are ranged first; then each text is shuffled once, to
the range it falls in, and the highest of each range also to the one above, whose lowest it follows.

Defined results: a null text counts as empty; an empty text is one empty paragraph; a null doc_id
counts as the least one; rows of one doc_id are in descending order of their texts' hashes; rows that agree in both
are one record, repeated, and get the same result; a single record is its own next one; an empty table gives an
empty table; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genospark.llm.common import HOT, shipped, small_batches
from genospark.plans.tables import tidy, written

LANES, SKETCH, GRAM = 16, 512, 8
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
RESULT = "doc_id bigint, n bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_paragraphs bigint"


def vector(paragraphs: str) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the vectors of the paragraphs that line feeds part in this text."""
    pieces = paragraphs.encode("utf-8", "surrogatepass").split(b"\n")
    digests = b"".join(hashlib.blake2b(p, person=s).digest() for p in pieces for s in (b"0", b"1"))
    lanes = np.frombuffer(digests, "<u8").reshape(-1, LANES).sum(axis=0, dtype=np.uint64)
    filled = (b"\0" * (GRAM - 1) + b"\n").join(pieces) + b"\0" * (GRAM - 1)  # as many grams as bytes
    data, n = np.frombuffer(filled + b"\0" * GRAM, np.uint8), len(filled) - GRAM + 1
    grams = np.empty((-(-n // GRAM), GRAM), np.uint64)
    for k in range(GRAM):
        grams[:, k] = np.frombuffer(filled + b"\0" * (2 * GRAM), "<u8", len(grams), k)
    grams = grams.ravel()[:n]
    if len(pieces) > 1:
        feeds = np.cumsum(data[: n + GRAM - 1] == 10)
        grams = grams[feeds[GRAM - 1 :] == np.r_[0, feeds[: n - 1]]]
    mixed = (grams ^ (grams >> np.uint64(31))) * _FACTOR
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _FACTOR
    counts = np.bincount((mixed >> np.uint64(54)).astype(np.int64), minlength=2 * SKETCH)
    return lanes, (counts[:SKETCH] - counts[SKETCH:]).astype(np.int16)


def packed(v: tuple[np.ndarray, np.ndarray]) -> str:
    """A vector as text."""
    return base64.b64encode(v[0].astype("<u8").tobytes() + v[1].astype("<i2").tobytes()).decode()


def unpacked(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    data = base64.b64decode(fingerprint)
    return np.frombuffer(data, "<u8", LANES), np.frombuffer(data, "<i2", SKETCH, 8 * LANES)


def changed(v: tuple[np.ndarray, np.ndarray], deleted: str | None = None, inserted: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A text's vector once these paragraphs are deleted from it and those inserted, wherever they stand."""
    lanes, sketch = v
    for paragraphs, less in ((deleted, True), (inserted, False)):
        if paragraphs is not None:
            a, b = vector(paragraphs)
            lanes, sketch = (lanes - a, sketch - b) if less else (lanes + a, sketch + b)
    return lanes, sketch


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    x, y = a[1].astype(np.int64), b[1].astype(np.int64)
    d, size = (a[1] - b[1]).astype(np.int64), int(x @ x + y @ y)
    return 1.0 if not d.any() else max(0.0, 1.0 - int(d @ d) / size) if size else 0.0


def _keys(doc_id: pd.Series, known: pd.Series, h: pd.Series) -> np.ndarray:
    """Bytes that sort as (known, doc_id, h)."""
    flip = np.uint64(1 << 63)
    out = np.empty((len(h), 17), np.uint8)
    out[:, 0] = known.to_numpy()
    for k, c in ((1, doc_id), (9, h)):
        out[:, k : k + 8] = (c.to_numpy(np.int64).view(np.uint64) ^ flip).astype(">u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(out).view("S17").ravel()


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range, highest first and the next range's highest last: each with its successor."""

    def result(row: tuple, text: str, v: tuple, after: str, w: tuple) -> tuple:
        half = len(text) // 2
        cut = len(text) - half
        begin = text.rfind("\n", 0, cut) + 1
        edited = text[:cut] + after[:half]
        u = changed(v, text[begin:], edited[begin:]) if half else v
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return (*row, len(text), sha, packed(v), packed(u), likeness(v, u), likeness(v, w), text.count("\n") + 1)

    held, found = None, []
    names = [c.split()[0] for c in RESULT.split(", ")]

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), _TYPES, strict=True)], names=names)

    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("doc_id", "h", "n", "text", "look")]
        for doc_id, h, n, text, look in zip(*columns, strict=True):
            if held and not look and held[0] == (doc_id, h):  # the record again
                held = (held[0], held[1] + n, *held[2:])
                continue
            if held:
                v = held[3] if held[2] == (text or "") else vector(text or "")
                found.append(result((held[0][0], held[1]), *held[2:], text or "", v))
            elif not look:
                v = vector(text or "")
            held = None if look else ((doc_id, h), n, text or "", v)
        if found:
            yield batch()
            found = []
    if held:
        raise RuntimeError("the highest record of the next range is missing")


_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]


@tidy
def compared(docs: DataFrame) -> DataFrame:
    """The columns of RESULT for docs (doc_id, text): each text's fingerprint, that of the text whose last half is
    replaced by the beginning of the next document, made from the former by deletion and insertion, and their
    likeness; n: how often the record is repeated."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    keys = rows.groupBy("doc_id", "h").agg(F.count("*").alias("n"))
    keys = written(keys.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("k"), F.col("doc_id").isNotNull().alias("known"), "h", "doc_id", "n"), "keys")
    total, most = (x or 0 for x in keys.agg(F.sum("n"), F.max("n")).first())
    if not total:
        return spark.createDataFrame([], RESULT)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("known"), F.desc("k"), F.desc("h")]
    tops = keys.repartitionByRange(parts, *order).groupBy(F.spark_partition_id().alias("p")).agg(F.max(F.struct("known", "k", "h")).alias("top"))
    top = tops.select("top.*").toPandas()  # one row for each partition of the shuffle
    tops = shipped(spark, "multiset_hash.tops", np.sort(_keys(top["k"], top["known"], top["h"])))

    if most > 1 and most * HOT > total:  # fewer than HOT records that are repeated so often: each is one row from here on
        often = F.broadcast(keys.filter((F.col("n") * HOT > total) & (F.col("n") > 1)).select(F.col("doc_id").alias("id2"), F.col("h").alias("h2")))
        same = F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2"))
        folded = rows.join(often, same, "left_semi").groupBy("doc_id", "h").agg(F.first("text").alias("text"), F.count("*").alias("n"))
        rows = rows.join(often, same, "left_anti").withColumn("n", F.lit(1).cast("bigint")).unionByName(folded)
    else:
        rows = rows.withColumn("n", F.lit(1).cast("bigint"))

    @F.pandas_udf("own int, above int")
    def ranged(k: pd.Series, known: pd.Series, h: pd.Series) -> pd.DataFrame:
        highest, own = tops(), _keys(k, known, h)
        at = np.searchsorted(highest, own)
        return pd.DataFrame({"own": at, "above": np.where(highest[at] == own, (at + 1) % len(highest), -1)})

    placed = rows.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("k"), F.col("doc_id").isNotNull().alias("known"), "h", "doc_id", "n", "text")
    placed = placed.withColumn("at", ranged("k", "known", "h"))
    own, above = F.struct(F.col("at.own").alias("p"), F.lit(0).alias("look")), F.struct(F.col("at.above").alias("p"), F.lit(1).alias("look"))
    dealt = placed.select("k", "known", "h", "doc_id", "n", "text", F.inline(F.when(F.col("at.above") < 0, F.array(own)).otherwise(F.array(own, above))))
    inside = dealt.repartitionById(parts, F.col("p")).sortWithinPartitions("look", *order)
    found = inside.select("doc_id", "h", "n", "text", "look").mapInArrow(_followed, RESULT)
    first = F.sequence(F.lit(0).cast("bigint"), F.expr("(n - 1) div 1000"))
    if most > 1 and most * HOT > total:  # results of a record that is repeated very often come from many tasks
        found = found.withColumn("part", F.explode(first)).repartition(parts, "doc_id", "part")
    else:
        found = found.withColumn("part", F.explode(first))
    return found.withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(1000), F.col("n") - F.col("part") * 1000)))).drop("part", "k")
