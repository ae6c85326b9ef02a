"""Repeated lines and paragraphs, found by digests of normalised units.

A text is cut into units: lines ("line"), runs of lines between blank ones ("paragraph"), both ("block": lines and the
paragraphs of several lines, the default) or, within lines, sentences, long ones in parts ("sentence"). A unit is
normalised (lower case, runs of spaces to one, trimmed) and digested (96 bits; grams, whose words are compared, 64). Over all documents the earliest
occurrence of a digest stays, in order of rank, doc_id, the text's own digest and place; every other one is
removed, with the offsets of what goes given in the original text. Units of under min_words words are never removed:
such short ones repeat by chance. Digests are grouped with the least occurrence as a partial aggregate, so that a unit
may stand in any share of the rows.

Whole units miss a passage that is set into other lines, so passages are found besides (unless passages=False): runs
of PASSAGE words or more, over lines and sentences, that repeat an earlier text word by word wherever they begin
and end. Runs of GRAM words whose hash is least among WINDOW successive ones are picked, so that any two equal runs of PASSAGE
words share one. It is digested with the words before it, more than SIDE of them, with the SIDE words after it, or both, as one of these
lies within the equal run; from there each occurrence is compared with the earliest of its digest, up to PASSAGE words to
both sides, and goes if they agree in PASSAGE words. In scripts without spaces a character is a word.

Defined results: a null text stays null and has no units; rows that agree in doc_id and text
are one record and lose the same spans; a null doc_id comes last in order; a text all of whose
units go becomes empty; an empty table gives an empty table; spans that overlap are given as one;
columns of the input named spans or n_removed give way to the results, and stripped() keeps them.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genospark.llm.common import SPACES, joined_by_key, numbered, record_key, restored, small_batches, text_digest
from genospark.plans.tables import tidy, written

UNITS = ("line", "paragraph", "block", "sentence")
LINE = re.compile(r"[^\n]+\n?|\n")
#: A sentence ends at one of its marks, with the marks and what closes after it, before white space. No part is matched twice.
SENTENCE = re.compile(r"(?:[^\n.!?]++|[.!?][.!?\"')\]]*+(?!\s|$))*+(?:[.!?][.!?\"')\]]*+[ \t]*+\n?|\n|$)")


#: A longer sentence is cut before words that their own hash picks (one in ANCHOR), LEAST words apart or more:
#: a passage set into other text is then cut in the same places wherever it stands.
LONG, ANCHOR, LEAST = 24, 4, 6
WORD = re.compile(r"[^ \t\n\x0b\f\r]+")


#: A passage has so many words; GRAM + WINDOW - 1 of them: such a run contains a gram that is picked.
PASSAGE, GRAM = 50, 16
WINDOW = PASSAGE - GRAM + 1
#: Of the PASSAGE - GRAM words around a gram within a passage half or more stand on one side.
SIDE = (PASSAGE - GRAM) // 2
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
UNSPACED = re.compile(f"[{_UNSPACED}]")
PASSAGE_WORD = re.compile(rf"[{_UNSPACED}]|[^ \t\n\x0b\f\r{_UNSPACED}]+")


def _word(text: str) -> re.Pattern:
    return WORD if text.isascii() or not UNSPACED.search(text) else PASSAGE_WORD


def passage_words(text: str) -> list[bytes]:
    """The words in lower case, as UTF-8."""
    if _word(text) is WORD:
        return text.lower().encode("utf-8", "surrogatepass").split()  # bytes split at the six ASCII spaces only
    return [w.encode("utf-8", "surrogatepass") for w in PASSAGE_WORD.findall(text.lower())]


def _highest(x: np.ndarray, first: int, last: int) -> np.ndarray:
    """For each place k up to len(x) + WINDOW - 1 the largest of x[k - last : k - first + 1], where x is 0 beyond its ends."""
    most, width, whole = np.concatenate([np.zeros(WINDOW - 1, np.uint64), x, np.zeros(WINDOW - 1, np.uint64)]), 1, last - first + 1
    while width < whole:
        step = min(width, whole - width)
        most, width = np.maximum(most[:-step], most[step:]), width + step
    return most[WINDOW - 1 - last :][: len(x) + WINDOW - 1]


def picked(words: list[bytes]) -> list[tuple[int, bool, bool]]:
    """The places of the grams that are least in some window, in order; every window has one of its least. Whether a window of
    theirs has more than SIDE words before the gram, and whether one has SIDE or fewer."""
    if len(words) < PASSAGE:
        return []
    x = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    n = 1
    while n < GRAM:  # GRAM is a power of 2
        x = (x[:-n] ^ (x[:-n] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (x[n:] ^ (x[n:] >> np.uint64(32)))
        n *= 2
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    least, width = x, 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    late, early = _highest(least, SIDE + 1, WINDOW - 1) == x, _highest(least, 0, SIDE) == x
    places = np.flatnonzero(late | early).tolist()
    out: list[int] = []
    value, a = x[places].tolist(), 0
    while a < len(places):  # of equal ones in a row the first two, the last, one PASSAGE before the end and some between do
        b = a + 1
        while b < len(places) and value[b] == value[a]:
            b += 1
        end = places[b - 1] - WINDOW + 1
        for k in range(a, b):
            p = places[k]
            if k < a + 2 or k == b - 1 or places[k + 1] - out[-1] > WINDOW or p <= end < places[k + 1]:
                out.append(p)
        a = b
    return list(zip(out, late[out].tolist(), early[out].tolist(), strict=True))


def _agree(a: list[bytes], b: list[bytes]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def agreeing(text: str, hits: list) -> list[tuple[int, int]]:
    """The spans in which text agrees with what stands around earlier grams; hits: place of a gram among its words, the
    words before the earlier one and after it."""
    words, found = passage_words(text), set()
    for h in hits:
        k = h["start"]
        a = _agree(words[max(k - PASSAGE, 0) : k][::-1], h["before"].split()[::-1])
        b = _agree(words[k + GRAM : k + GRAM + PASSAGE], h["after"].split())
        if a + GRAM + b >= PASSAGE:
            found.add((k - a, k + GRAM + b))
    if not found:
        return []
    starts = [m.start() for m in _word(text).finditer(text)] + [len(text)]
    return [(starts[a], starts[b]) for a, b in found]


def _anchored(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    words = list(WORD.finditer(text, a, b))
    last, n = a, 0
    if len(words) > LONG:
        for k, w in enumerate(words):
            if n >= LEAST and len(words) - k >= LEAST and zlib.crc32(w.group().lower().encode("utf-8", "surrogatepass")) % ANCHOR == 0:
                yield last, w.start()
                last, n = w.start(), 0
            n += 1
    yield last, b


def units(text: str, unit: str = "block") -> list[tuple[int, int]]:
    """(start, stop) of each unit that has a word; they include the space that follows. In order, but the paragraphs
    of "block" come after its lines."""
    if unit not in UNITS:
        raise ValueError(f"{unit!r} is not one of {UNITS}")
    if unit == "sentence":
        found = [m.span() for m in SENTENCE.finditer(text) if m.group().strip(SPACES)]
        return [x for s in found for x in _anchored(text, *s)]
    lines, runs, joins = [], [], False
    for m in LINE.finditer(text):
        filled = bool(m.group().strip(SPACES))
        if filled:
            lines.append(m.span())
            if joins:
                runs[-1][1:] = m.end(), True
            else:
                runs.append([m.start(), m.end(), False])
        joins = filled
    if unit == "line":
        return lines
    return [(a, b) for a, b, _ in runs] if unit == "paragraph" else lines + [(a, b) for a, b, several in runs if several]


def occurrences(docs: DataFrame, unit: str, min_words: int, rank: Column, passages: bool = False) -> DataFrame:
    """(digest, rank, doc_id, th, start, stop) of each unit with min_words words; with passages also of each
    picked gram and each of its sides, its place among the words for start and a null stop."""
    small_batches(docs.sparkSession)
    rows = docs.select(rank.alias("rank"), "doc_id", text_digest(F.col("text")).alias("th"), "text").filter("text IS NOT NULL")
    names = ["digest", "rank", "doc_id", "th", "start", "stop"]
    types = [pa.binary(), pa.float64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for r, doc_id, th, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for a, b in units(text, unit):
                    words = text[a:b].lower().split()
                    if len(words) >= min_words:
                        d = hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=12).digest()
                        for column, x in zip(out, (d, r, doc_id, th, a, b), strict=True):
                            column.append(x)
                if passages:
                    words = passage_words(text)
                    for k, late, early in picked(words):
                        for a, b, side in ((k - SIDE - 1, k + GRAM, b"before"), (k, k + GRAM + SIDE, b"after")):
                            if (late if side == b"before" else early) and a >= 0 and b <= len(words):
                                d = hashlib.blake2b(b" ".join(words[a:b]), digest_size=8, person=side).digest()
                                for column, x in zip(out, (d, r, doc_id, th, k, None), strict=True):
                                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=names)

    return rows.mapInArrow(run, "digest binary, rank double, doc_id long, th long, start int, stop int")


def repeated(found: DataFrame, texts: DataFrame) -> DataFrame:
    """(rk, spans, hits, n): of each record the units that repeat an earlier occurrence, its repeated grams with the words around
    the earliest, and about how many rows it has. found: occurrences(), written; texts: doc_id, text."""
    place = F.struct(F.col("rank").isNull().alias("a"), "rank", F.col("doc_id").isNull().alias("b"), "doc_id", "th", "start")
    first = found.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.max(F.col("stop").isNull()).alias("gram")).filter("n > 1").withColumn("m", F.col("n"))
    later = joined_by_key(found, first, ["digest"], "n").filter(place != F.col("first"))
    only = lambda c: F.when(F.col("gram"), F.col(c)).alias(c)
    later = written(later.select(only("digest"), "doc_id", "th", "start", "stop", only("first"), only("m")), "later")
    grams = later.filter("stop IS NULL")
    around = joined_by_key(grams.select("digest", "doc_id", "th", "start"), _surroundings(grams, texts), ["digest"], "n")
    span, hit = F.struct("start", "stop"), F.struct("start", "before", "after")
    rows = later.filter("stop IS NOT NULL").select("doc_id", "th", span.alias("span"), F.lit(None).cast("struct<start:int,before:binary,after:binary>").alias("hit"))
    rows = rows.unionByName(around.select("doc_id", "th", F.lit(None).cast("struct<start:int,stop:int>").alias("span"), hit.alias("hit")))
    sums = rows.groupBy("doc_id", "th").agg(F.collect_set("span").alias("spans"), F.collect_set("hit").alias("hits"), F.count("*").alias("all"))
    each = (F.col("all") / (F.size("spans") + F.size("hits"))).cast("bigint")
    return sums.select(record_key(F.col("doc_id"), F.col("th")).alias("rk"), "spans", "hits", each.alias("n"))


def _surroundings(grams: DataFrame, texts: DataFrame) -> DataFrame:
    """(digest, n, before, after): the words around the earliest occurrence of each gram."""
    firsts = grams.groupBy("digest").agg(F.min("first").alias("first"), F.count("*").alias("n"), F.max("m").alias("m"))
    by = firsts.groupBy(record_key(F.col("first.doc_id"), F.col("first.th")).alias("rk")).agg(F.collect_list(F.struct("digest", "n", F.col("first.start").alias("start"))).alias("grams"), F.max("m").alias("m"))
    keyed = texts.filter("text IS NOT NULL").select(record_key(F.col("doc_id"), text_digest(F.col("text"))).alias("rk"), "text")
    both = joined_by_key(keyed, by, ["rk"], "m").select("text", "grams")  # no record has more rows than its gram has places

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = passage_words(text)
                for g in found:
                    k = g["start"]
                    around = b" ".join(words[max(k - PASSAGE, 0) : k]), b" ".join(words[k + GRAM : k + GRAM + PASSAGE])
                    for column, x in zip(out, (g["digest"], g["n"], *around), strict=True):
                        column.append(x)
            types = pa.binary(), pa.int64(), pa.binary(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["digest", "n", "before", "after"])

    found = both.mapInArrow(run, "digest binary, n long, before binary, after binary")
    return found.groupBy("digest").agg(F.max("n").alias("n"), F.max("before").alias("before"), F.max("after").alias("after"))


def joint(spans: list[tuple[int, int]]) -> list[int]:
    """Starts and stops in turn; spans that overlap become one."""
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            ends += a, b
    return ends


def _cut(docs: DataFrame, unit: str, min_words: int, rank: Column | None, passages: bool) -> DataFrame:
    """The numbered columns, with __cut (the text that stays), spans and n_removed."""
    plain = docs.select("doc_id", "text", (F.lit(0.0) if rank is None else rank.cast("double")).alias("rank"))
    found = written(occurrences(plain, unit, min_words, F.col("rank"), passages), "units")
    gone = repeated(found, plain).withColumnRenamed("rk", "__rk")
    numbers, at = numbered(docs)
    text = F.col(at["text"])
    keyed = numbers.withColumn("__rk", record_key(F.col(at["doc_id"]), text_digest(text)))
    joined = joined_by_key(keyed, gone, ["__rk"], "n", "left")

    @F.pandas_udf("text string, ends array<int>")
    def cut(text: pd.Series, spans: pd.Series, hits: pd.Series) -> pd.DataFrame:
        left, gone = [], []
        for x, own, grams in zip(text, spans, hits, strict=True):
            if x is None:
                left.append(None)
                gone.append(None)
                continue
            ends = joint([(s["start"], s["stop"]) for s in own] + agreeing(x, grams))
            stay = [0, *ends, len(x)]
            left.append("".join([x[a:b] for a, b in zip(stay[::2], stay[1::2], strict=True)]))
            gone.append(ends)
        return pd.DataFrame({"text": left, "ends": gone})

    touched = F.col("spans").isNotNull()
    out = joined.withColumn("__new", cut(F.when(touched, text), "spans", "hits"))
    ends = F.coalesce("__new.ends", F.array().cast("array<int>"))
    pairs = F.transform(F.filter(ends, lambda x, k: k % 2 == 0), lambda x, k: F.struct(x.alias("start"), ends[2 * k + 1].alias("stop")))
    return out.withColumns({"__cut": F.when(touched, F.col("__new.text")).otherwise(text), "spans": pairs, "n_removed": F.floor(F.size(ends) / 2).cast("int")})


@tidy
def deduplicated(docs: DataFrame, unit: str = "block", min_words: int = 6, rank: Column | None = None, passages: bool = True) -> DataFrame:
    """docs with text without its repeated units, spans (what went: start and stop in the original
    text, in code points) and n_removed. The smallest rank comes first; then doc_id. passages: repeated
    passages go too."""
    out = _cut(docs, unit, min_words, rank, passages)
    place = numbered(docs)[1]["text"]
    return restored(out.withColumn(place, F.col("__cut")), docs, {"spans": F.col("spans"), "n_removed": F.col("n_removed")})


@tidy
def stripped(docs: DataFrame, unit: str = "block", min_words: int = 6, rank: Column | None = None, passages: bool = True) -> DataFrame:
    """docs, all columns its own, with text without its repeated units and passages; n_chars, if there is one, follows."""
    out = _cut(docs, unit, min_words, rank, passages)
    at = numbered(docs)[1]
    if "n_chars" in docs.columns:
        out = out.withColumn(at["n_chars"], F.coalesce(F.length("__cut"), F.lit(0)).cast(dict(docs.dtypes)["n_chars"]))
    return restored(out.withColumn(at["text"], F.col("__cut")), docs, {})
