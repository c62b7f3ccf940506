"""Declared schemas of the tables that operators exchange, and typed empties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

RAW_FILING = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("value", T.StringType())]
)

CORPUS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("word_count", T.IntegerType()),
    ]
)

TOPIC_TERMS = T.StructType(
    [
        T.StructField("topic", T.IntegerType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("term", T.StringType()),
        T.StructField("weight", T.DoubleType()),
    ]
)

SCORES = T.StructType(
    [T.StructField("k", T.IntegerType()), T.StructField("score", T.DoubleType())]
)


def empty(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


# The tables of an analysis, for a corpus without any filing. Wide tables get their
# topic columns with the first topics.
RESULTS = {
    "corpus_stats": "documents long, companies long, years long, words long",
    "docs_per_year": "year int, documents long",
    "token_stats": "documents long, mean_tokens double",
    "vocabulary": "token string, df long, tf long, id int",
    "vocabulary_report": "terms long, dropped long, documents long",
    "coherence_scores": "k int, score double, reached boolean",
    "topic_terms": "topic int, rank int, term string, weight double",
    "topic_prevalence": "topic int, prevalence double",
    "term_relevance": "topic int, rank int, term string, relevance double",
    "topic_distance": "topic_a int, topic_b int, distance double",
    "doc_topics": "doc_id long, ticker string, year int, topic int, weight double",
    "exposure": "ticker string, topic int, exposure double, label string",
    "exposure_wide": "ticker string",
    "exposure_total": "topic int, total_exposure double",
    "edges": "src string, dst string, weight double, width double",
    "components": "ticker string, component string",
    "peer_groups": "component string, size long, ticker string",
    "drift": "ticker string, jsd double, flagged boolean",
    "drift_ranking": "ticker string, jsd double",
    "drift_table": "ticker string, jsd double",
    "drift_deltas": "ticker string, topic int, delta double, label string",
    "top_drifter": "ticker string, topic int, delta double, label string, sign int",
    "silhouette_scores": "k int, score double, reached boolean",
    "clusters": "para_id string, doc_id long, ticker string, year int, para_pos int, cluster int",
    "cluster_sizes": "cluster int, size long",
    "representatives": "cluster int, rank int, para_id string, distance double, excerpt string",
    "report": "method string, id int, label string, size long, rank int, summary string",
}
