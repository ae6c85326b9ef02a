"""One query for each corpus operator, over the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genospark.llm import collocations, filter_audit, gru_lm, jaccard_join, langid, media_png, mixing, multiset_hash, quality, sharding, sp_tokens, sql, substring_dedup, token_counts
from genospark.llm.common import documents


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of every text, then their revision by three edits, which a hash of doc_id places: counts before and after. Edge
    cases: see token_counts."""
    docs = token_counts.revision(documents(spark, sf_dir, "doc_id", "text"))
    return token_counts.edited_counts(docs, token_counts.read_ranks(), keep_text=False)


def op2_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without repeated lines, paragraphs and passages, and what went. Edge cases: see substring_dedup."""
    return substring_dedup.deduplicated(documents(spark, sf_dir, "doc_id", "text"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, measures and the verdict on every document. Edge cases: see quality."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang", "source")
    return quality.judged(docs, keep=("doc_id",)).select("doc_id", *quality.RESULTS[:6], "kept", *quality.MEASURES)


def op4_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes. Edge cases: see sharding."""
    out, _ = sharding.sharded(documents(spark, sf_dir, "doc_id", "text"), 8)
    return out.selectExpr("doc_id", "size", "text_crc32", "'bytes' AS law", "shard", "slot", "CAST(NULL AS INT) AS grown_shard", "vslot")


def op7_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document. Edge cases: see mixing."""
    return mixing.mixture(documents(spark, sf_dir, "doc_id", "text", "source"))


def op5_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a PNG, read back, and its hash. Edge cases: see media_png."""
    out = media_png.stored(documents(spark, sf_dir, "doc_id", "text"), keep_media=False)
    return out.drop("media").withColumn("phash", F.lower(F.hex("phash"))).withColumnRenamed("phash", "feature")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded, with its parity. Edge cases: see sp_tokens."""
    with open(sp_tokens.MODEL, "rb") as f:
        return sp_tokens.encoded(documents(spark, sf_dir, "doc_id", "text"), f.read(), keep_ids=False).drop("ids", "decoded")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group, class and links of every document. Edge cases: see jaccard_join."""
    return jaccard_join.similar(documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "class_id", "n_links", "copy_id", "n_copies")


def op9_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log-likelihood of every text. Edge cases: see gru_lm."""
    return gru_lm.scored(documents(spark, sf_dir, "doc_id", "text"))


def op10_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, and the set it is mixed of. Edge cases: see langid."""
    return langid.predicted(documents(spark, sf_dir, "doc_id", "text", "lang"))


def op11_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness. Edge cases: see multiset_hash."""
    found = multiset_hash.compared(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_paragraphs")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of each language. Edge cases: see collocations."""
    return collocations.collocations(documents(spark, sf_dir, "text", "lang"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in all 120 orders, by source. Edge cases: see filter_audit."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return filter_audit.audited(filter_audit.failures(documents(spark, sf_dir, "doc_id", "text", "source"), labels))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_counts, op2_unit_dedup, op3_quality_rules, op4_virtual_slots, op5_png_media, op6_sentencepiece, op7_weighted_mix, op8_jaccard_join, op9_gru_scores, op10_language_mixture, op11_multiset_hash, op12_collocations, op13_filter_audit)
}
ORACLES = {"op3_quality_rules": sql.QUALITY, "op7_weighted_mix": sql.MIXING, "op12_collocations": sql.COLLOCATIONS, "op13_filter_audit": sql.AUDIT}
