"""Quality rules with thresholds that follow the data, in DataFrame functions only.

Counts per document give four measures. A histogram whose buckets grow with the value (32
to each power of two, so a quantile is off by 1/32 at most) is summed for each language,
source and measure; such histograms merge by adding, so the ones of a language and of the
whole corpus come from them. Quartiles of a histogram give fences, and a document passes if
all of its measures lie within the fences of its group.

Defined results: a null or blank text has no words and fails the base; a null language or
source is a group of its own; repeated rows each get the same verdict; an empty table
gives an empty table; columns of the input that bear the name of a result give way to it,
and accepted() keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genospark.llm.common import SPACES, let, numbered, restored, words
from genospark.plans.tables import tidy, written

#: Measures with the spread that counts at least, so that a constant measure rejects nothing near it.
#: Word length is in hundredths of a code point, the rest in thousandths of words or lines.
MEASURES = {"word_len": 60, "symbols": 60, "dup_lines": 170, "repeats": 100}
WINDOW = 8
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *MEASURES, "kept")


def _repeat_words(hashes: Column) -> Column:
    """How many words lie in windows whose hash occurs twice or more. hashes: of the window at each position."""

    def covered(pairs: Column) -> Column:
        n = F.size(pairs)
        twice = F.filter(
            pairs,
            lambda e, k: ((k > 0) & (F.get(pairs, k - 1)["h"] == e["h"])) | ((k < n - 1) & (F.get(pairs, k + 1)["h"] == e["h"])),
        )
        at = F.sort_array(F.transform(twice, lambda e: e["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            at,
            start,
            lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n"), (i + WINDOW).alias("end")),
            lambda a: a["n"],
        )

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, covered))


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts of each whole text, base_failed and the measures (longs). No column of docs has such a name."""
    split = docs.withColumns(
        {
            "__w": words(F.col(text)),
            "__l": F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""),
        }
    )
    n = F.size("__w")
    hashes = F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__w", i, WINDOW))))
    split = split.withColumns({"n_words": n.cast("bigint"), "__h": F.coalesce(hashes, F.array().cast("array<bigint>"))})
    symbols = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^#*$%&|<>]+", "")
    counts = split.withColumns(
        {
            "word_chars": F.length(F.array_join("__w", "")).cast("bigint"),
            "n_symbols": F.length(symbols).cast("bigint"),
            "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("bigint"),
            "n_repeat_words": _repeat_words(F.col("__h")).cast("bigint"),
            "__n": F.size("__l").cast("bigint"),
        }
    ).drop("__w", "__h", "__l")
    per_word = F.greatest("n_words", F.lit(1))
    return counts.withColumns(
        {
            "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
            "word_len": F.floor(F.expr("word_chars * 100 div greatest(n_words, 1)")),
            "symbols": F.expr("n_symbols * 1000 div greatest(n_words, 1)"),
            "dup_lines": F.expr("n_dup_lines * 1000 div greatest(__n, 1)"),
            "repeats": F.expr("n_repeat_words * 1000 div greatest(n_words, 1)"),
        }
    ).drop("__n")


def bucket(value: Column) -> Column:
    """The bucket of a long of at least 0: itself below 64, then 32 to each power of two."""
    e = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return (e * 32 + F.call_function("shiftright", value, e)).cast("int")


def bucket_top(b: Column) -> Column:
    """The largest value of a bucket."""
    e = F.greatest(F.floor(b / 32) - 1, F.lit(0)).cast("int")
    return F.when(b < 64, b.cast("bigint")).otherwise(F.call_function("shiftleft", (b - 32 * e + 1).cast("bigint"), e) - 1)


def sketches(counts: DataFrame, *by: str) -> DataFrame:
    """(by..., measure, bucket, n) over documents that pass the base."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in MEASURES]))
    return counts.filter(~F.col("base_failed")).select(*by, each.alias("x")).groupBy(*by, "x.measure", "x.bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *by: str) -> DataFrame:
    """Sketches of coarser groups: the sums of those of their parts."""
    return sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, *by: str, reach: int = 3) -> DataFrame:
    """(by..., docs, and for each measure lo_ and hi_): the quartiles, widened by reach times their distance."""
    w = Window.partitionBy(*by, "measure")
    cum = sketch.withColumns({"__c": F.sum("n").over(w.orderBy("bucket")), "__t": F.sum("n").over(w)})
    quart = cum.groupBy(*by, "measure").agg(
        F.max("__t").alias("docs"),
        F.min(F.when(4 * F.col("__c") >= F.col("__t"), F.col("bucket"))).alias("q1"),
        F.min(F.when(4 * F.col("__c") >= 3 * F.col("__t"), F.col("bucket"))).alias("q3"),
    )
    quart = quart.withColumns({"q1": bucket_top(F.col("q1")), "q3": bucket_top(F.col("q3"))})
    least = F.create_map(*[F.lit(x) for kv in MEASURES.items() for x in kv])[F.col("measure")]
    wide = reach * F.greatest(F.col("q3") - F.col("q1"), least)
    at = quart.withColumns({"lo": F.col("q1") - wide, "hi": F.col("q3") + wide})
    picks = [F.max(F.when(F.col("measure") == m, F.col(x))).alias(f"{x}_{m}") for m in MEASURES for x in ("lo", "hi")]
    return at.groupBy(*by).agg(F.max("docs").alias("docs"), *picks)


def thresholds(counts: DataFrame, language: str, source: str, reach: int = 3, least_docs: int = 50) -> DataFrame:
    """(language, source, lo_..., hi_...). A group of under least_docs documents that pass the base
    takes the fences of its language, and of the whole corpus if that has as few. A written table: its size is known, so the planner
    broadcasts it while it is small and deals both sides out by its keys when it is not."""
    fine = written(sketches(counts, language, source), "sketch")
    groups = counts.groupBy(language, source).agg(F.count("*").alias("__rows")).select(language, source)
    names = [f"{x}_{m}" for m in MEASURES for x in ("lo", "hi")]
    a = fences(fine, language, source, reach=reach)
    b = fences(merged(fine, language), language, reach=reach)
    c = fences(merged(fine), reach=reach)
    enough = lambda t: F.coalesce(F.col(f"{t}.docs") >= least_docs, F.lit(False))
    same = lambda t, x: F.col(f"g.{x}").eqNullSafe(F.col(f"{t}.{x}"))
    joined = (
        groups.alias("g")
        .join(a.alias("a"), same("a", language) & same("a", source), "left")
        .join(b.alias("b"), same("b", language), "left")
        .join(F.broadcast(c).alias("c"), F.lit(True), "left")
    )
    pick = [F.when(enough("a"), F.col(f"a.{n}")).when(enough("b"), F.col(f"b.{n}")).otherwise(F.col(f"c.{n}")).alias(n) for n in names]
    return written(joined.select(f"g.{language}", f"g.{source}", *pick), "limits")


def _verdicts(docs: DataFrame, text: str, language: str, source: str, keep: tuple[str, ...] | None, reach: int, least_docs: int) -> DataFrame:
    """The numbered columns (those in keep, if given) and RESULTS."""
    numbers, at = numbered(docs)
    own = [at[c] for c in docs.columns if keep is None or c in keep]
    lang, src = at[language], at[source]
    counts = counted(numbers, at[text]).select(*own, *[c for c in (lang, src) if c not in own], *RESULTS[:-1])
    counts = written(counts, "counts")
    limits = thresholds(counts, lang, src, reach, least_docs).withColumnsRenamed({lang: "__lang", src: "__source"})
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & (F.col(m) >= F.col(f"lo_{m}")) & (F.col(m) <= F.col(f"hi_{m}"))
    both = counts.join(limits, F.col(lang).eqNullSafe(F.col("__lang")) & F.col(src).eqNullSafe(F.col("__source")), "left")
    return both.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))


@tidy
def judged(docs: DataFrame, text: str = "text", language: str = "lang", source: str = "source", keep: tuple[str, ...] | None = None, reach: int = 3, least_docs: int = 50) -> DataFrame:
    """docs (or its columns named in keep) with the counts, base_failed, the measures and kept."""
    out = _verdicts(docs, text, language, source, keep, reach, least_docs)
    return restored(out, docs, {r: F.col(r) for r in RESULTS}, keep)


@tidy
def accepted(docs: DataFrame, text: str = "text", language: str = "lang", source: str = "source", reach: int = 3, least_docs: int = 50) -> DataFrame:
    """The documents that pass, all columns their own."""
    return restored(_verdicts(docs, text, language, source, None, reach, least_docs).filter("kept"), docs, {})
