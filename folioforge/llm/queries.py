"""The queries of the corpus operators: each applies one to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, conversations, decontaminate, jaccard, langid, lm, mixing, pii, sketch, spelling, topk, toxicity, warc
from .common import held_out, table


def op1_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("html")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op3_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return decontaminate.pairs(docs, decontaminate.fit(docs, table(spark, sf_dir, "benchmark")))


def op4_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.collapse(table(spark, sf_dir, "conversations"))


def op5_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out("doc_id", 4).alias("held_out"))
    net = langid.fit(docs.where(~F.col("held_out")))
    return langid.identify(docs, net).select("doc_id", "held_out", "lang_pred", "score")


def op6_vertical_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


def op7_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.detect(docs, pii.fit(docs)).drop("text", "redacted")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return topk.top_k(e.where(F.col("vec_id") % 50 == 0), e, "vec_id", "embedding", k=5)


def op9_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out("doc_id", 4).alias("held_out"))
    chain = toxicity.fit(docs.where(~F.col("held_out")), table(spark, sf_dir, "labels"))
    return toxicity.tag(docs, chain).select("doc_id", "held_out", "score", "predicted", "toxic_spans")


def op10_log_bilinear_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out("doc_id", 7).alias("held_out"))
    counts, head, model = lm.fit(docs.where(~F.col("held_out")))
    return lm.score(docs, counts, head, model)


def op11_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.dictionary(table(spark, sf_dir, "documents")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_capture_index": op1_warc_capture_index,
    "op2_source_mix": op2_source_mix,
    "op3_latent_decontamination": op3_latent_decontamination,
    "op4_snapshot_collapse": op4_snapshot_collapse,
    "op5_byte_cnn_language": op5_byte_cnn_language,
    "op6_vertical_jaccard_join": op6_vertical_jaccard_join,
    "op7_semi_markov_pii": op7_semi_markov_pii,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_crf_toxicity": op9_crf_toxicity,
    "op10_log_bilinear_scoring": op10_log_bilinear_scoring,
    "op11_bottom_k_fingerprints": op11_bottom_k_fingerprints,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_vector_codes": op13_vector_codes,
}
