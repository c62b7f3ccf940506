"""Dictionary with document frequencies, and bags of words."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingloom.functions import text as X
from filingloom.runtime import broadcast_if_small, durable

# Dictionary rows that are sent to the documents rather than joined.
BROADCAST_TERMS = 100_000


def term_counts(tokens: DataFrame) -> DataFrame:
    """``(doc_id, token, cnt)``, counted inside each row: no shuffle."""
    return tokens.select("doc_id", F.inline(X.term_runs("tokens")))


def frequencies(tokens: DataFrame) -> DataFrame:
    """``(token, df, tf)`` over the corpus: one shuffle, combined map-side."""
    return (
        tokens.select(F.inline(X.marked_tokens("tokens")))
        .groupBy("token")
        .agg(F.sum("first").alias("df"), F.count("*").alias("tf"))
    )


def build_vocabulary(
    tokens: DataFrame,
    min_df: int = 3,
    max_share: float = 0.7,
    limit: int | None = None,
) -> DataFrame:
    """``(token, df, tf, id)`` with neither rare nor ubiquitous tokens.

    Ids follow falling document frequency, then the alphabet. With ``limit`` only that many
    of the most frequent stay. The result is stored.
    """
    documents = tokens.count()
    pruned = frequencies(tokens).where(
        (F.col("df") >= min_df) & (F.col("df") <= math.floor(max_share * documents))
    )
    pruned = durable(pruned, "frequencies")
    if limit is not None:
        pruned = _above_cut(pruned, limit).orderBy(F.desc("df"), "token").limit(limit)
    return durable(numbered(pruned), "vocabulary")


def numbered(terms: DataFrame) -> DataFrame:
    """Ids in the order of the terms: range sort, then a start for every partition."""
    parts = int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = terms.repartitionByRange(parts, F.desc("df"), "token")
    ranged = durable(ranged.withColumn("part", F.spark_partition_id()), "ranged-terms")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("part").orderBy(F.desc("df"), "token")
    return ranged.join(F.broadcast(starts), "part").select(
        "token", "df", "tf", (F.col("start") + F.row_number().over(order) - 1).cast("int").alias("id")
    )


def _above_cut(counts: DataFrame, limit: int) -> DataFrame:
    """Rows that can be among the ``limit`` most frequent.

    A histogram over powers of two (at most 64 rows) finds the lowest band that
    is needed, so the top-n never sorts the long tail.
    """
    band = F.floor(F.log2("df")).cast("int")
    histogram = counts.groupBy(band.alias("band")).agg(F.count("*").alias("n")).collect()
    total = 0
    for row in sorted(histogram, key=lambda r: -r.band):
        total += row.n
        if total >= limit:
            return counts.where(F.col("df") >= 2**row.band)
    return counts


def bag_of_words(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(doc_id, token, id, cnt)`` for the tokens that the vocabulary holds."""
    ids = broadcast_if_small(vocabulary.select("token", "id"), BROADCAST_TERMS)
    return term_counts(tokens).join(ids, "token").select("doc_id", "token", "id", "cnt")


def document_lengths(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(doc_id, length)``: tokens that the vocabulary holds, per document."""
    return (
        bag_of_words(tokens, vocabulary).groupBy("doc_id").agg(F.sum("cnt").alias("length"))
    )


def vocabulary_report(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Number of terms, of different tokens left out, and of documents."""
    tokens_all = tokens.select(F.explode(F.array_distinct("tokens")).alias("token"))
    return vocabulary.agg(F.count("*").alias("terms")).select(
        "terms",
        (tokens_all.agg(F.count_distinct("token")).scalar() - F.col("terms")).alias("dropped"),
        tokens.agg(F.count("*")).scalar().alias("documents"),
    )
