"""The corpus pipeline: from documents to packed training sequences.

Five stages, each on all its predecessor kept: documents whose language cannot be told go;
of every group of near-duplicates the first document stays; passages that an earlier document
has go; sources are brought to their target weights; what remains is tokenized and packed.
Every stage writes Parquet that the next one reads, so a lost executor costs single tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingloom.llm import common, jaccard, keys, language, mixing, packing, substring
from filingloom.runtime import durable_root

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Documents go only if no language reaches this share of the likelihoods.
LEAST_SCORE = 0.4


def own_keys(docs: DataFrame, repeats: bool = False) -> DataFrame:
    """``COLUMNS`` and ``key``: the id, or a number of its own for a row without one.

    With ``repeats`` rows that share an id have numbers of their own too.
    """
    return keys.numbered(docs.select(*COLUMNS, F.col("doc_id").cast("long").alias("key")), "key", repeats)[0]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: null or letterless texts, and undecided ones.

    The model is fitted on the labelled documents of the input. ``lang`` stays as it is.
    Without any label nothing can be told apart, and all texts with letters stay.
    """
    common.small_batches(spark)
    model = language.fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = docs.select(*COLUMNS, language.predict(docs, model).alias("found"))
    kept = (F.col("found.lang_pred") != language.UNKNOWN) & (F.col("found.score") >= LEAST_SCORE)
    return found.where(kept).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents keep the one with the smallest id.

    Every row is a document of its own: rows without an id, and rows whose id others have too,
    come before the others.
    """
    common.small_batches(spark)
    keyed = own_keys(docs, repeats=True)
    linked = jaccard.link_documents(keyed, id_col="key")
    first = linked.where("doc_id = component_id").select(F.col("doc_id").alias("key"))
    return keyed.join(first, "key", "left_semi").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that an earlier document has; documents with nothing left go.

    Texts that lose nothing keep their white space; ``n_chars`` follows the text.
    """
    common.small_batches(spark)
    cut = substring.remove_repeats(own_keys(docs, repeats=True), id_col="key")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    left = cut.where("n_removed = 0 OR n_removed < n_words").withColumn("text", text)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bring the sources to their target weights: a row for every time a document is taken."""
    common.small_batches(spark)
    keyed = own_keys(docs, repeats=True)
    mixed = mixing.mix(keyed, id_col="key").where("copies > 0").select(F.col("doc_id").alias("key"), "copies")
    rows = keyed.join(mixed, "key")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in the training sequences."""
    common.small_batches(spark)
    return packing.pack_documents(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("packed", packed),
]
# A learned model and best-fit rounds: no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each stored and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    app = spark.sparkContext.applicationId
    root = f"{durable_root(spark)}/filingloom/{app}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{root}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
