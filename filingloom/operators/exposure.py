"""Company exposure to topics, and labels for topics and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.runtime import broadcast_if_small


def company_exposure(doc_topics: DataFrame, k: int) -> DataFrame:
    """``(ticker, exposure)``: mean topic weights of a company over all its filings.

    One average per topic in a single aggregate: rows are not multiplied by K,
    and a company with very many filings is combined before the shuffle.
    """
    means = [F.avg(F.get("theta", F.lit(i))) for i in range(k)]
    return doc_topics.groupBy("ticker").agg(F.array(*means).alias("exposure"))


def exposure_long(exposure: DataFrame) -> DataFrame:
    return exposure.select("ticker", F.posexplode("exposure").alias("topic", "exposure"))


def exposure_wide(exposure: DataFrame, k: int) -> DataFrame:
    return exposure.select(
        "ticker", *[F.get("exposure", F.lit(i)).alias(f"Topic_{i}") for i in range(k)]
    )


def exposure_total(exposure: DataFrame, k: int) -> DataFrame:
    """Sum over companies per topic, largest first."""
    sums = exposure.agg(
        F.array(*[F.sum(F.get("exposure", F.lit(i))) for i in range(k)]).alias("totals")
    )
    return sums.select(F.posexplode("totals").alias("topic", "total_exposure")).orderBy(
        F.desc("total_exposure"), "topic"
    )


def topic_name(topic: Column, label: Column) -> Column:
    """Display name of a topic; a topic without a label gets a generic one."""
    number = topic.cast("string")
    return F.concat(
        F.lit("Topic_"),
        number,
        F.lit(": "),
        F.coalesce(label, F.concat(F.lit("Generic Risk "), number)),
    )


def cluster_name(cluster: Column, label: Column) -> Column:
    return F.coalesce(
        label, F.concat(F.lit("Unnamed Embedding Topic "), cluster.cast("string"))
    )


def with_topic_names(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``label`` from a ``(topic, label)`` table."""
    named = labels.select("topic", F.col("label").alias("given"))
    return (
        df.join(broadcast_if_small(named), "topic", "left")
        .withColumn("label", topic_name(F.col("topic"), F.col("given")))
        .drop("given")
    )


def with_cluster_names(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``label`` from a ``(cluster, label)`` table."""
    named = labels.select("cluster", F.col("label").alias("given"))
    return (
        df.join(broadcast_if_small(named), "cluster", "left")
        .withColumn("label", cluster_name(F.col("cluster"), F.col("given")))
        .drop("given")
    )
