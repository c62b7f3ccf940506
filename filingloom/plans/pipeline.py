"""From corpus to report: every step as one function of DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from filingloom.operators import clusters as C
from filingloom.operators import corpus as CO
from filingloom.operators import drift as D
from filingloom.operators import embeddings as E
from filingloom.operators import exposure as EX
from filingloom.operators import network as N
from filingloom.operators import report as R
from filingloom.operators import tokens as T
from filingloom.operators import topics as TP
from filingloom.operators import vocabulary as VO
from filingloom.operators.svd import svd_vectors
from filingloom.runtime import durable
from filingloom.schemas import RESULTS, empty


@dataclass
class Config:
    start_year: int
    end_year: int
    tickers: list[str] | None = None
    stop_words: list[str] | None = None
    # words that more than this share of the filings use are stop words of the domain; None for none
    frequent_share: float | None = 0.9
    # known words for lemmas: a table, "corpus" for the corpus's own, None for no lemmas
    lexicon: DataFrame | str | None = "corpus"
    vocabulary_limit: int | None = None
    min_df: int = 3
    max_share: float = 0.7
    min_topics: int = 5
    max_topics: int = 15
    passes: int = 15
    measure: str = "c_v"
    separator: str = "\n\n"
    min_clusters: int = 6
    max_clusters: int = 15
    restarts: int = 10
    encoder: Callable[[DataFrame], DataFrame] | None = None
    similarity_threshold: float = 0.75
    drift_threshold: float = D.DRIFT_FLAG
    same_year: str = "first"
    samples_per_cluster: int = 1
    topic_labels: dict[int, str] = field(default_factory=dict)
    cluster_labels: dict[int, str] = field(default_factory=dict)
    seed: int = 42


def _labels(spark: SparkSession, key: str, labels: dict[int, str]) -> DataFrame:
    return spark.createDataFrame(list(labels.items()), f"{key} int, label string")


def run_pipeline(corpus: DataFrame, config: Config) -> dict[str, DataFrame]:
    """All result tables by name; for an empty corpus the same tables without rows.

    Tables that later steps read more than once (corpus, tokens, bags, vectors,
    document topics, exposure) are stored once; the model fits, the component
    rounds and the counts that choose a join are the only other actions.
    """
    spark = corpus.sparkSession
    cfg = config
    corpus = durable(
        CO.in_period(corpus, cfg.start_year, cfg.end_year, cfg.tickers), "corpus"
    )
    if corpus.isEmpty():
        return {name: empty(spark, schema) for name, schema in RESULTS.items()}
    stop = T.stop_words(spark, cfg.stop_words)
    tokens = durable(T.tokenize(corpus, stop, lexicon=cfg.lexicon), "tokens")
    if cfg.frequent_share is not None:
        common = T.frequent_words(tokens, cfg.frequent_share)
        tokens = durable(T.remove_stop_table(tokens, common), "tokens")

    search = TP.search_topics(
        tokens,
        cfg.min_topics,
        cfg.max_topics,
        cfg.passes,
        cfg.seed,
        cfg.measure,
        cfg.min_df,
        cfg.max_share,
        cfg.vocabulary_limit,
    )
    k = search.best_k
    terms = TP.topic_terms(search.model, search.vocabulary, 10)
    weights = durable(TP.topic_weights(search.model, search.vocabulary), "topic-weights")
    doc_topics = durable(TP.document_topics(search.model, search.bags), "doc-topics")
    lengths = VO.document_lengths(tokens, search.vocabulary)
    topic_labels = _labels(spark, "topic", cfg.topic_labels)
    cluster_labels = _labels(spark, "cluster", cfg.cluster_labels)

    paragraphs = durable(CO.split_paragraphs(corpus, cfg.separator), "paragraphs")
    if cfg.encoder:
        vectors = cfg.encoder(paragraphs)
    else:
        vectors = svd_vectors(E.paragraph_tokens(paragraphs, stop))
    vectors = durable(vectors, "vectors")
    found = C.search_clusters(
        vectors, cfg.min_clusters, cfg.max_clusters, cfg.seed, cfg.restarts
    )
    nearest = C.representative_texts(
        C.representatives(found.assigned, found.centroids, n=cfg.samples_per_cluster),
        paragraphs,
    )
    nearest = durable(nearest, "representatives")
    sizes = C.cluster_sizes(found.assigned, found.best_k)

    exposure = durable(EX.company_exposure(doc_topics, k), "exposure")
    components = durable(
        N.exposure_components(exposure, cfg.similarity_threshold), "components"
    )
    profiles = durable(
        D.yearly_profiles(doc_topics, cfg.start_year, cfg.end_year, cfg.same_year, k), "profiles"
    )
    drift = D.topic_drift(profiles)
    names = {t: f"Topic_{t}" for t in range(k)}
    return {
        "corpus_stats": CO.corpus_stats(corpus),
        "docs_per_year": CO.docs_per_year(corpus),
        "token_stats": T.token_stats(tokens),
        "vocabulary": search.vocabulary,
        "vocabulary_report": VO.vocabulary_report(tokens, search.vocabulary),
        "coherence_scores": D.flag_scores(search.scores, D.COHERENCE_TARGET),
        "topic_terms": terms,
        "topic_prevalence": TP.topic_prevalence(doc_topics, lengths, k),
        "term_relevance": TP.term_relevance(weights, search.vocabulary),
        "topic_distance": TP.topic_distance(weights, list(range(k))),
        "doc_topics": TP.topics_long(doc_topics),
        "exposure": EX.with_topic_names(EX.exposure_long(exposure), topic_labels),
        "exposure_wide": EX.exposure_wide(exposure, k),
        "exposure_total": EX.exposure_total(exposure, k),
        "edges": N.similarity_edges(exposure, cfg.similarity_threshold),
        "components": components,
        "peer_groups": N.peer_groups(components),
        "drift": D.flag_drift(drift, cfg.drift_threshold),
        "drift_ranking": D.drift_ranking(drift, 10),
        "drift_table": D.delta_table(drift, D.topic_deltas(profiles), names),
        "drift_deltas": EX.with_topic_names(D.topic_deltas(profiles), topic_labels),
        "top_drifter": D.top_drifter_deltas(profiles, topic_labels),
        "silhouette_scores": D.flag_scores(found.scores, D.SILHOUETTE_TARGET),
        "clusters": found.assigned.drop("embedding", "paragraph"),
        "cluster_sizes": sizes,
        "representatives": nearest,
        "report": R.comparison_report(terms, topic_labels, sizes, nearest, cluster_labels),
    }
