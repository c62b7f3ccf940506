"""Corpus filters and counts, and the split into paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingloom.functions import text as X


def in_period(
    corpus: DataFrame, first_year: int, last_year: int, tickers: list[str] | None = None
) -> DataFrame:
    """Filings of the given years, and of the given companies if any are named."""
    kept = corpus.where(F.col("year").between(first_year, last_year))
    return kept.where(F.col("ticker").isin(tickers)) if tickers else kept


def corpus_stats(corpus: DataFrame) -> DataFrame:
    """Counts of filings, companies, years and words.

    Grouped by company and year first, so the distinct counts see few rows.
    """
    groups = corpus.groupBy("ticker", "year").agg(
        F.count("*").alias("n"), F.sum("word_count").alias("w")
    )
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("documents"),
        F.count_distinct("ticker").alias("companies"),
        F.count_distinct("year").alias("years"),
        F.coalesce(F.sum("w"), F.lit(0)).alias("words"),
    )


def docs_per_year(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("year").agg(F.count("*").alias("documents")).orderBy("year")


def preview(corpus: DataFrame, n: int = 5) -> DataFrame:
    """First rows in document order: a top-n, not a full sort."""
    return corpus.orderBy("doc_id").limit(n)


def split_paragraphs(
    corpus: DataFrame, sep: str = "\n\n", min_chars: int = 100
) -> DataFrame:
    """One row per paragraph longer than ``min_chars``, with its place in the filing."""
    # the separator is taken literally
    pieces = F.split(X.squeeze("text"), r"\Q" + sep + r"\E")
    return (
        corpus.select("doc_id", "ticker", "year", F.posexplode(pieces).alias("para_pos", "raw"))
        .select("doc_id", "ticker", "year", "para_pos", X.strip("raw").alias("paragraph"))
        .where(F.length("paragraph") > min_chars)
        .select(
            F.concat_ws("-", "doc_id", "para_pos").alias("para_id"),
            "doc_id",
            "ticker",
            "year",
            "para_pos",
            "paragraph",
        )
    )


def excerpts(paragraphs: DataFrame, size: int = 200) -> DataFrame:
    return paragraphs.select("para_id", X.excerpt("paragraph", size).alias("excerpt"))
