"""LDA topics: bags, fit, search over K, term tables and document weights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingloom.functions import vectors as V
from filingloom.operators import lda
from filingloom.operators.coherence import coherence
from filingloom.operators.lda import LdaModel, Sweep
from filingloom.operators.vocabulary import bag_of_words, build_vocabulary
from filingloom.runtime import durable
from filingloom.schemas import SCORES


def prepare_bags(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """One stored row for each document, with the ``ids`` of its terms and their ``counts``.

    Documents without any term of the vocabulary have empty arrays. Ids of documents are unique.
    """
    attrs = ["doc_id", "ticker", "year", "n_tokens", *[c for c in ("source_path",) if c in tokens.columns]]
    entries = F.sort_array(F.collect_list(F.struct("id", "cnt"))).alias("entries")
    counted = bag_of_words(tokens, vocabulary).groupBy("doc_id").agg(entries)
    nothing = F.array().cast("array<int>")
    bags = tokens.select(attrs).join(counted, "doc_id", "left").select(
        *attrs,
        F.coalesce("entries.id", nothing).alias("ids"),
        F.coalesce("entries.cnt", nothing).alias("counts"),
    )
    return durable(bags, "bags")


def fit_lda(bags: DataFrame, k: int, passes: int = 15, seed: int = 42) -> LdaModel:
    """One model with a learned prior over terms; each pass reads every document once."""
    return lda.fit_sweep(bags, [k], passes, seed).model(k)


def topic_weights(model: LdaModel, vocabulary: DataFrame) -> DataFrame:
    """``(topic, term, weight)`` for all terms, joined by id; weights sum to 1 in a topic."""
    weights = F.transform("weights", lambda x, i: x / F.get(F.array(*map(F.lit, model.totals)), i))
    named = model.terms.join(vocabulary.select("id", F.col("token").alias("term")), "id")
    return named.select("term", F.posexplode(weights).alias("topic", "weight")).select("topic", "term", "weight")


def topic_terms(model: LdaModel, vocabulary: DataFrame, n: int = 10) -> DataFrame:
    """``(topic, rank, term, weight)``, the ``n`` heaviest terms of each topic."""
    return rank_terms(topic_weights(model, vocabulary), n)


def sweep_terms(sweep: Sweep, vocabulary: DataFrame, n: int = 20) -> DataFrame:
    """``(k, topic, rank, term, weight)``: heaviest terms of all topics of all models."""
    whole = LdaModel(len(sweep.totals), sweep.terms, sweep.totals, [])
    places = [(k, topic) for k in sorted(sweep.starts) for topic in range(k)]
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("topic")) for k, t in places])
    ranked = topic_terms(whole, vocabulary, n).withColumn("place", F.get(pairs, F.col("topic")))
    return ranked.select("place.k", "place.topic", "rank", "term", "weight")


def rank_terms(weights: DataFrame, n: int = 10) -> DataFrame:
    """``(topic, rank, term, weight)`` from any ``(topic, term, weight)`` table."""
    order = Window.partitionBy("topic").orderBy(F.desc("weight"), "term")
    return (
        weights.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
        .select("topic", "rank", "term", "weight")
    )


def topic_keywords(terms: DataFrame) -> DataFrame:
    """One line of text per topic: ``weight*"term" + ...`` in rank order."""
    piece = F.concat(F.format_string("%.3f", "weight"), F.lit('*"'), "term", F.lit('"'))
    return (
        terms.select("topic", F.struct("rank", piece.alias("piece")).alias("p"))
        .groupBy("topic")
        .agg(F.concat_ws(" + ", F.sort_array(F.collect_list("p"))["piece"]).alias("keywords"))
    )


def document_topics(model: LdaModel, bags: DataFrame) -> DataFrame:
    """``(doc_id, ticker, year, n_tokens, theta)``; weights always sum to 1.

    A document with no word in the vocabulary gets the prior.
    """
    return lda.infer_topics(model, bags)


def topics_long(doc_topics: DataFrame) -> DataFrame:
    """``(doc_id, ticker, year, topic, weight)`` from array weights."""
    return doc_topics.select(
        "doc_id", "ticker", "year", F.posexplode("theta").alias("topic", "weight")
    )


def topics_array(long: DataFrame, k: int) -> DataFrame:
    """Array weights from long ones; a missing topic counts 0."""
    parts = [
        F.coalesce(F.max(F.when(F.col("topic") == i, F.col("weight"))), F.lit(0.0))
        for i in range(k)
    ]
    return long.groupBy("doc_id", "ticker", "year").agg(F.array(*parts).alias("theta"))


def topics_wide(doc_topics: DataFrame, k: int) -> DataFrame:
    """Columns ``Topic_0`` to ``Topic_{k-1}``."""
    return doc_topics.select(
        "doc_id", "ticker", "year", *[F.get("theta", F.lit(i)).alias(f"Topic_{i}") for i in range(k)]
    )


def best_score(scores: DataFrame) -> DataFrame:
    """The row with the highest score; the smallest K among equals."""
    return scores.orderBy(F.desc("score"), "k").limit(1)


@dataclass
class TopicSearch:
    best_k: int
    sweep: Sweep
    scores: DataFrame
    vocabulary: DataFrame
    bags: DataFrame

    @property
    def model(self) -> LdaModel:
        return self.sweep.model(self.best_k)


def search_topics(
    tokens: DataFrame,
    min_topics: int = 5,
    max_topics: int = 15,
    passes: int = 15,
    seed: int = 42,
    measure: str = "c_v",
    min_df: int = 3,
    max_share: float = 0.7,
    limit: int | None = None,
) -> TopicSearch:
    """Fit every K in the range in the same passes and keep the most coherent.

    The tokens are read once for the coherence of all models.
    """
    vocabulary = build_vocabulary(tokens, min_df, max_share, limit)
    if vocabulary.isEmpty():
        raise ValueError("no token passes the document-frequency bounds")
    bags = prepare_bags(tokens, vocabulary)
    ks = list(range(min_topics, max_topics + 1))
    sweep = lda.fit_sweep(bags, ks, passes, seed)
    top = durable(sweep_terms(sweep, vocabulary), "sweep-terms")
    scored = coherence(tokens, top, measure=measure).groupBy("k").agg(F.avg("coherence").alias("score"))
    found = {r.k: r.score for r in scored.collect()}
    rows = [(k, float(found.get(k) or 0.0)) for k in ks]
    best_k = max(rows, key=lambda r: (r[1], -r[0]))[0]
    scores = tokens.sparkSession.createDataFrame(rows, SCORES)
    return TopicSearch(best_k, sweep, scores, vocabulary, bags)


def topic_prevalence(doc_topics: DataFrame, lengths: DataFrame, k: int) -> DataFrame:
    """Share of all vocabulary tokens that each topic accounts for.

    ``lengths`` is ``(doc_id, length)``; a document without a row counts 0.
    """
    sums = [F.sum(F.get("theta", F.lit(i)) * F.col("length")) for i in range(k)]
    parts = (
        doc_topics.select("doc_id", "theta")
        .join(lengths, "doc_id")
        .agg(F.array(*sums).alias("parts"))
        .select("parts", V.total("parts").alias("whole"))
    )
    return parts.select(F.posexplode("parts").alias("topic", "part"), "whole").select(
        "topic", (F.col("part") / F.col("whole")).alias("prevalence")
    )


def term_relevance(
    weights: DataFrame, frequencies: DataFrame, weight_on_topic: float = 0.6, n: int = 30
) -> DataFrame:
    """Most relevant terms per topic: lambda*ln(phi) + (1-lambda)*ln(phi/p).

    ``weights`` is ``(topic, term, weight)`` and ``p`` the term's share of all
    tokens in ``frequencies`` ``(token, tf)``.
    """
    all_tokens = frequencies.agg(F.sum("tf")).scalar()
    share = frequencies.select(
        F.col("token").alias("term"), (F.col("tf") / all_tokens).alias("p")
    )
    scored = weights.where("weight > 0").join(share, "term")
    relevance = weight_on_topic * F.log("weight") + (1 - weight_on_topic) * F.log(
        F.col("weight") / F.col("p")
    )
    return rank_terms(
        scored.select("topic", "term", F.round(relevance, 9).alias("weight")), n
    ).withColumnRenamed("weight", "relevance")


def topic_distance(weights: DataFrame, topics: list[int]) -> DataFrame:
    """Jensen-Shannon distance between the term distributions of each two topics.

    ``(topic, term, weight)`` is turned into one row per term with a column per
    topic, so that all pairs are plain sums of one pass. Weights sum to 1 per topic.
    """
    per_term = weights.groupBy("term").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("topic") == t, F.col("weight"))), F.lit(0.0)).alias(f"t{t}")
            for t in topics
        ]
    )

    def part(x, y):
        return F.when(x > 0, x * F.log(2 * x / (x + y))).otherwise(F.lit(0.0))

    pairs = [(a, b) for i, a in enumerate(topics) for b in topics[i + 1 :]]
    sums = [
        F.sum(part(F.col(f"t{a}"), F.col(f"t{b}")) + part(F.col(f"t{b}"), F.col(f"t{a}")))
        for a, b in pairs
    ]
    entries = F.array(
        *[
            F.struct(
                F.lit(a).alias("topic_a"),
                F.lit(b).alias("topic_b"),
                F.sqrt(F.greatest(s / 2, F.lit(0.0))).alias("distance"),
            )
            for (a, b), s in zip(pairs, sums)
        ]
    )
    return per_term.agg(entries.alias("pairs")).select(F.inline("pairs"))
