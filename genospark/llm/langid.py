"""Languages of a text as a mixture.

Counts of letter trigrams, hashed into a fixed number of bins, give each language a
distribution. A document is taken as a mixture of languages; expectation-maximisation finds the
proportions under which its trigrams are likeliest. Then languages leave the set, the least
first, as long as the log-likelihood falls by less than a penalty for each language (half the
logarithm of the number of trigrams, as in BIC, times `weight`). The language of
the largest proportion is predicted, and the proportion is the score.

Learnt from are documents with a text and a language; the model has one row of n_bins counts
for each language and is all that reaches the driver. Where languages are so many that it would pass MODEL_BYTES, bins
are joined in twos until it does not; more than MODEL_BYTES / 4 / 256 languages are an error.

Defined results: a null text or one without letters is `und` with score 0 and no languages, and so
is every text where nothing can be learnt from; a letter is what Unicode calls one; repeated
rows get equal values; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genospark.llm.common import kept_in_process, shipped, small_batches
from genospark.plans.tables import tidy, written

N_BINS = 1 << 16
SPACE = 32
#: Most bytes of the model, which the driver gathers and broadcasts.
MODEL_BYTES = 256 << 20


def held_out(doc_id, remainder: int = 1, mod: int = 3):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == remainder


def letter_table() -> np.ndarray:
    return np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000)


def trigrams(text: str | None, letters: np.ndarray, n_bins: int = N_BINS) -> np.ndarray:
    """Bins of the trigrams of letters and word edges; empty if there is no letter. n_bins: a power of 2."""
    points = np.frombuffer(f" {text or ''} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters[points]
    if not is_letter.any():
        return np.zeros(0, np.int64)
    x = np.where(is_letter, points, np.uint32(SPACE))
    key = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1]) * np.uint32(0x85EBCA6B) + x[2:]
    key *= np.uint32(0xC2B2AE35)
    return (key[is_letter[1:-1]] >> np.uint32(33 - n_bins.bit_length())).astype(np.int64)


def profile(docs: DataFrame, n_bins: int = N_BINS) -> tuple[list[str], np.ndarray]:
    """Languages, and for each the smoothed probabilities of the bins: (bins, languages). docs: text, lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = kept_in_process("letters", letter_table)
        sums: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, n in sums.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bin", "n"])
            sums.clear()

        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                bins = trigrams(text, letters, n_bins)
                if len(bins):
                    if lang not in sums:
                        if len(sums) >= 64:
                            yield from flush()
                        sums[lang] = np.zeros(n_bins, np.int64)
                    sums[lang] += np.bincount(bins, minlength=n_bins)
        yield from flush()

    rows = docs.select("text", "lang").mapInArrow(run, "lang string, bin int, n long")
    summed = written(rows.groupBy("lang", "bin").agg(F.sum("n").alias("n")), "language_bins")
    known = summed.select("lang").distinct().count()
    if known * 4 * 256 > MODEL_BYTES:
        raise ValueError(f"{known} languages are too many for one model")
    shift = 0
    while known * 4 * (n_bins >> shift) > MODEL_BYTES:
        shift += 1
    bins = n_bins >> shift
    table = summed.groupBy("lang", F.shiftright("bin", shift).alias("bin")).agg(F.sum("n").alias("n")).toArrow() if shift else summed.toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    counts = np.full((bins, len(langs)), 0.5, np.float32)
    place = {x: k for k, x in enumerate(langs)}
    if langs:
        np.add.at(counts, (table.column("bin").to_numpy(), np.array([place[x] for x in table.column("lang").to_pylist()])), table.column("n").to_numpy())
    return langs, (counts / counts.sum(axis=0, dtype=np.float64)).astype(np.float32)


def _fit(p: np.ndarray, n: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Expectation-maximisation: proportions, and the log-likelihood."""
    total = n.sum()
    for _ in range(rounds):
        new = share * ((n / (p @ share)) @ p) / total
        done = np.abs(new - share).max() < 1e-3
        share = new
        if done:
            break
    return share, float(n @ np.log(p @ share))


def mixture(bins: np.ndarray, table: np.ndarray, weight: float = 1.0, rounds: int = 25) -> dict[int, float]:
    """Languages that stay and their proportions, which sum to 1."""
    hits = np.bincount(bins, minlength=len(table))
    at = np.flatnonzero(hits)
    n, p = hits[at].astype(np.float32), table[at]
    stay = np.arange(table.shape[1])
    penalty = weight * 0.5 * np.log(max(2, len(bins)))
    share, fit = _fit(p, n, np.full(len(stay), 1 / len(stay), np.float32), rounds)
    while len(stay) > 1:
        keep = np.arange(len(stay)) != share.argmin()
        start = share[keep] / max(share[keep].sum(), 1e-12)
        less = float(n @ np.log(p[:, keep] @ start + 1e-30))
        if fit - less >= penalty:
            start, less = _fit(p[:, keep], n, start.astype(np.float32), rounds)
            if fit - less >= penalty:
                break
        stay, share, p, fit = stay[keep], start.astype(np.float32), p[:, keep], less
    share = share / share.sum()
    return dict(zip(stay.tolist(), share.tolist(), strict=True))


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, langs array<struct<lang:string,share:double>>"
_TYPES = [pa.int64(), pa.bool_(), pa.string(), pa.float64(), pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))]


@tidy
def predicted(docs: DataFrame, n_bins: int = N_BINS, weight: float = 1.0) -> DataFrame:
    """doc_id, held_out, lang_pred, score and langs (the set, largest share first) of each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    model = shipped(spark, "language_profile", profile(docs.filter(~F.col("held_out") & F.col("text").isNotNull() & F.col("lang").isNotNull()), n_bins))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = kept_in_process("letters", letter_table)
        langs, table = model()
        bins_of = max(1, len(table)) if langs else n_bins
        for batch in batches:
            out: list[list] = [batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), [], [], []]
            for text in batch.column("text").to_pylist():
                bins = trigrams(text, letters, bins_of)
                found = mixture(bins, table, weight) if len(bins) and langs else {}
                ranked = sorted(found.items(), key=lambda x: (-x[1], langs[x[0]]))
                out[2].append(langs[ranked[0][0]] if ranked else "und")
                out[3].append(min(1.0, ranked[0][1]) if ranked else 0.0)
                out[4].append([{"lang": langs[k], "share": v} for k, v in ranked])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _TYPES, strict=True)], names=["doc_id", "held_out", "lang_pred", "score", "langs"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, SCHEMA)
