"""Registered queries of the operators, with production parameters on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingloom.llm import common as C
from filingloom.llm import (
    conversations,
    fingerprint,
    html,
    jaccard,
    language,
    mixing,
    neighbours,
    packing,
    quality,
    spelling,
    substring,
    token_counts,
    warc,
)


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(C.table(spark, folder, "documents").select("doc_id", "text"))


def op2_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.link_documents(C.table(spark, folder, "documents").select("doc_id", "text"))


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = C.table(spark, folder, "pages").select("page_id", "url", "html")
    records = warc.read_records(warc.write_archives(pages), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    docs = C.table(spark, folder, "documents").select("doc_id", "text")
    return fingerprint.fingerprints(docs).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.as_text(F.col("hashes")).alias("fingerprint"),
        fingerprint.as_text(F.col("edited_hashes")).alias("edited_fingerprint"),
        fingerprint.jaccard(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        fingerprint.jaccard(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = C.table(spark, folder, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = C.table(spark, folder, "documents").select("doc_id", "text", "lang")
    held = language.held_out(F.col("doc_id"), 5, 0)
    model = language.fit(docs.where(~held))
    found = docs.select("doc_id", held.alias("held_out"), language.predict(docs, model).alias("p"))
    return found.select("doc_id", "held_out", "p.*")


def op7_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = C.table(spark, folder, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op8_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = C.table(spark, folder, "pages").select("page_id", "url", "html")
    text = html.main_text(F.col("html"))
    found = pages.select("page_id", "url", text.alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op9_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.link_vectors(C.table(spark, folder, "embeddings"))


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = C.table(spark, folder, "documents").select("doc_id", "text")
    held = language.held_out(F.col("doc_id"), 3, 1)
    labels = C.table(spark, folder, "labels").select("doc_id", "quality")
    model = quality.fit(docs, labels.where(~held))
    scored = docs.select("doc_id", held.alias("held_out"), quality.score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(C.table(spark, folder, "documents").select("doc_id", "text"), damage=True)


def op12_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(C.table(spark, folder, "documents").select("doc_id", "text"))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    given = C.table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.report(conversations.repair(conversations.damage(given)), given)


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op6_language_id": op6_language_id,
    "op7_source_mix": op7_source_mix,
    "op3_warc": op3_warc,
    "op4_document_fingerprints": op4_document_fingerprints,
    "op5_substring_dedup": op5_substring_dedup,
    "op8_html_extraction": op8_html_extraction,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_token_counts": op12_token_counts,
    "op13_conversation_repair": op13_conversation_repair,
}
