"""Collocations: phrases whose words stand together more often than their parts would suggest.

Texts are cut into pieces, and identical pieces of a language become one with a multiplicity. A task counts the phrases
of its pieces in chunks, weighted, and packs what it has counted into one compressed part for each hash
bucket. A bucket's parts meet in one task, where DuckDB sums them, on disk beyond a few hundred MB.
Frequent phrases are then cut in all ways, and ask for the counts of both parts: requests go to where the part is counted, and what
they find goes back to the phrase.

Scores are exact: integers of up to 38 digits hold 1,000,000 a^2, and a count beyond 10^15 is an error.

Defined results: a null text has no pieces; a null language is the language `und`; a piece without words is none;
words keep their case but for A-Z; repeated rows and identical pieces all count; an empty table gives an empty table, as does one
without frequent phrases; extra columns are not read.

DuckDB's overflow goes to a folder of the task's own, which goes with the task and nothing else reads, as Spark's own does.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genospark.llm.common import joined_by_key, small_batches
from genospark.plans.tables import tidy, written

#: Characters that end a piece, and the two that separate its words.
ENDS = r"[.,;:!?\x0A-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words that a task counts at once, memory of a bucket's DuckDB, and salts that a language is first ranked by.
CHUNK, MEMORY, SALTS = 400_000, "256MB", 64
_PARTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int8()), ("f", pa.int64())])
RESULT = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, m): distinct pieces of docs (text, lang), and how often each occurs."""
    text = F.translate(F.coalesce("text", F.lit("")), UPPER + "\t", LOWER + " ")
    each = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(F.split(text, ENDS)).alias("piece"))
    each = each.select("lang", F.btrim("piece", F.lit(" ")).alias("piece")).filter("piece <> ''")
    return each.groupBy("lang", "piece").agg(F.count("*").alias("m"))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + b
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _hashes(words: pa.Array) -> np.ndarray:
    """A hash of each word, the same in every task."""
    import zlib

    return np.array([zlib.crc32(w.encode()) | len(w) << 32 for w in words.to_pylist()], np.uint64)


def _packed(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _PARTS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t.cast(_PARTS))
    return sink.getvalue().to_pybytes()


def _counted(most: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches of pieces, one packed part for each chunk and bucket: phrases of up to `most` words with their
    weights, and the empty phrase with the weight of all words."""

    def parts(t: pa.Table, con: duckdb.DuckDBPyConnection) -> Iterator[pa.RecordBatch]:
        lang = pc.dictionary_encode(t.column("lang").combine_chunks())
        m, split = t.column("m").to_numpy(), t.column("words").combine_chunks()
        word = pc.dictionary_encode(split.flatten())
        order = pc.sort_indices(word.dictionary).to_numpy()  # codes in order of the words: a part compresses well
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        names = word.dictionary.take(pa.array(order))
        code = place[word.indices.to_numpy(zero_copy_only=False)]
        sizes = np.diff(split.offsets.to_numpy())
        of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        own, l = np.repeat(m, sizes), np.repeat(lang.indices.to_numpy(zero_copy_only=False), sizes)
        h = _hashes(names)
        lh = _hashes(lang.dictionary)
        for k in range(most + 1):
            if not k:
                con.register("grams", pa.table({"l": l, "w": own}))
                columns = []
            else:
                n = len(code) - k + 1
                if n <= 0:
                    continue
                use = np.flatnonzero(of[:n] == of[k - 1 :])
                columns = [f"c{i}" for i in range(k)]
                con.register("grams", pa.table({"l": l[use], "w": own[use]} | {c: code[use + i] for i, c in enumerate(columns)}))
            keys = ", ".join(["l", *columns])
            got = con.sql(f"SELECT {keys}, CAST(sum(w) AS BIGINT) AS f FROM grams GROUP BY {keys} ORDER BY {keys}").to_arrow_table()
            if not got.num_rows:
                continue
            codes = [got.column(c).combine_chunks() for c in columns]
            at = got.column("l").combine_chunks()
            hashed = lh[at.to_numpy()]
            for c in codes:
                hashed = _mixed(hashed, h[c.to_numpy()])
            bucket = (hashed >> np.uint64(20)) % np.uint64(buckets)
            by = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[by], np.arange(buckets + 1, dtype=np.uint64))
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                some = pa.array(by[cuts[p] : cuts[p + 1]])
                words = [names.take(c.take(some)) for c in codes]
                phrase = pc.binary_join_element_wise(*words, " ") if k > 1 else words[0] if k else pa.array([""] * len(some))
                part = pa.table({"lang": lang.dictionary.take(at.take(some)), "phrase": phrase, "k": pa.array(np.full(len(some), k, np.int8)), "f": got.column("f").combine_chunks().take(some)})
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([_packed(part)], pa.binary())], names=["bucket", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(config={"threads": 1, "memory_limit": MEMORY}) as con:
            held, n = [], 0
            for b in batches:
                words = pc.split_pattern(b.column("piece"), " ")
                if pc.any(pc.match_substring(b.column("piece"), "  ")).as_py():
                    words = pc.split_pattern(pc.replace_substring_regex(b.column("piece"), " +", " "), " ")
                held.append(pa.table({"lang": b.column("lang"), "m": b.column("m"), "words": words}))
                n += len(words.flatten())
                if n >= CHUNK:
                    yield from parts(pa.concat_tables(held), con)
                    held, n = [], 0
            if held:
                yield from parts(pa.concat_tables(held), con)

    return run


def _summed(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From the packed parts of a bucket, its phrases that occur so often, and all empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unpacked() -> Iterator[pa.RecordBatch]:
            for b in batches:
                for data in b.column("part").to_pylist():
                    yield from pa.ipc.open_stream(data)

        with tempfile.TemporaryDirectory() as own:
            con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": own, "preserve_insertion_order": False})
            try:
                con.register("parts", pa.RecordBatchReader.from_batches(_PARTS, unpacked()))
                con.execute(f"SELECT lang, phrase, k, CAST(sum(f) AS BIGINT) AS f FROM parts GROUP BY lang, phrase, k HAVING k = 0 OR sum(f) >= {least}")
                for b in con.to_arrow_reader(10_000):
                    yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(b.columns, _PARTS.types, strict=True)], names=_PARTS.names)
            finally:
                con.close()

    return run


@tidy
def counts(docs: DataFrame, most: int = 3, least: int = 10) -> DataFrame:
    """(lang, phrase, k, f): phrases of 1 to `most` words that occur `least` times in a language, their words and
    occurrences; the empty phrase (k = 0) has those of all words. A written table."""
    spark = docs.sparkSession
    small_batches(spark, 10_000)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = pieces(docs).mapInArrow(_counted(most, buckets), "bucket int, part binary")
    small = parts.repartitionById(buckets, F.col("bucket")).mapInArrow(_summed(least), "lang string, phrase string, k tinyint, f bigint")
    return written(small, "phrases")


def score(a: Column, left: Column, right: Column) -> Column:
    """1,000,000 a^2 / (l r), rounded down, exactly."""
    wide = lambda c: c.cast("decimal(15,0)")
    over = (F.lit(1_000_000).cast("decimal(7,0)") * wide(a) * wide(a)).cast("decimal(38,0)")
    return F.call_function("div", over, (wide(left) * wide(right)).cast("decimal(38,0)"))


@tidy
def collocations(docs: DataFrame, most: int = 3, least: int = 10, top: int = 2000, inside: int = 50) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` best phrases of 2 to `most` words of each language.

    a: occurrences, at least `least`; l, r: those of the parts that the lowest-scoring cut gives, n: all words. A phrase inside a
    longer candidate that has at least `inside` per cent of its occurrences is left out."""
    found = counts(docs, most, least)
    word = F.split("phrase", " ")
    asking = found.filter("k >= 2").withColumn("w", word)
    cuts = F.sequence(F.lit(1), F.col("k").cast("int") - 1)
    sides = lambda c: F.array(
        F.struct(c.alias("cut"), F.lit(0).alias("side"), F.concat_ws(" ", F.slice("w", F.lit(1), c)).alias("part")),
        F.struct(c.alias("cut"), F.lit(1).alias("side"), F.concat_ws(" ", F.slice("w", c + 1, F.size("w"))).alias("part")),
    )
    requests = asking.select("lang", "phrase", "k", F.col("f").alias("a"), F.inline(F.flatten(F.transform(cuts, sides))))
    # where a part is counted, it is told who asks: how many, and the most frequent phrase that is one word longer
    heads = F.when((F.col("k") >= 3) & (F.col("cut") == F.when(F.col("side") == 0, F.col("k") - 1).otherwise(1)), F.col("a"))
    asked = requests.groupBy("lang", F.col("part").alias("phrase")).agg(F.count("*").alias("n"), F.max(heads).alias("longer"))
    owned = written(found.filter("k >= 1").join(asked, ["lang", "phrase"], "left"), "owned")
    left = written(owned.filter(f"k >= 2 AND (longer IS NULL OR 100 * longer < {inside} * f)").select("lang", "phrase", "k", "f"), "candidates")
    wanted = left.withColumn("w", word).select("lang", "phrase", F.col("f").alias("a"), F.inline(F.flatten(F.transform(cuts, sides))))
    answers = joined_by_key(wanted, owned.filter("n IS NOT NULL").select("lang", F.col("phrase").alias("part"), "f", "n"), ["lang", "part"], "n")
    given = [F.max(F.when((F.col("cut") == c) & (F.col("side") == s), F.col("f"))).alias(f"p{c}{s}") for c in range(1, most) for s in (0, 1)]
    back = answers.groupBy("lang", "phrase", "a").agg(*given)
    each = [F.when(F.col(f"p{c}0").isNotNull(), F.struct(score(F.col("a"), F.col(f"p{c}0"), F.col(f"p{c}1")).alias("score"), F.lit(c).alias("cut"), F.col(f"p{c}0").alias("l"), F.col(f"p{c}1").alias("r"))) for c in range(1, most)]
    scored = back.select("lang", "phrase", "a", F.array_min(F.array(*each)).alias("x")).select("lang", "phrase", "a", "x.score", "x.l", "x.r")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("bigint")).filter(F.col("rank") <= top)
    words = found.filter("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(words, "lang").select(*RESULT)
