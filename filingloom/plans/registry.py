"""Registered queries: each runs one operator over whole tables of a test folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filingloom.functions import text as X
from filingloom.functions import vectors as V
from filingloom.operators import clusters as C
from filingloom.operators import coherence as CH
from filingloom.operators import corpus as CO
from filingloom.operators import drift as D
from filingloom.operators import embeddings as E
from filingloom.operators import exposure as EX
from filingloom.operators import network as N
from filingloom.operators import report as R
from filingloom.operators import svd as SVD
from filingloom.operators import tokens as T
from filingloom.operators import topics as TP
from filingloom.operators import vocabulary as VO
from filingloom.plans.pipeline import Config, run_pipeline
from filingloom.runtime import durable, durable_root, spread
from filingloom.sources import extract_filings, flat_filings, from_table, read_filings, read_flat, write_files

K = 8
FIRST, SECOND = 2023, 2024
TOPIC_LABELS = {0: "Regulation", 1: "Markets", 2: "Cyber", 4: "Supply", 5: "Climate"}
CLUSTER_LABELS = {0: "Cyber", 2: "Regulation", 3: "Labor"}


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _year(doc_id: Column) -> Column:
    return F.lit(FIRST) + F.floor(doc_id / 20) % 2


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(_table(spark, sf, "documents").select("doc_id", "source", "lang", "text"), "doc_id")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as filings: the source is the company, the year alternates."""
    return from_table(documents(spark, sf), "doc_id", "source", _year(F.col("doc_id")), "text")


def raw_filings(spark: SparkSession, sf: str) -> DataFrame:
    """Documents wrapped as raw submissions. Every 7th lacks the 10-K folder, every
    11th the period and every 13th the section."""
    d = F.col("doc_id")
    form = F.when(d % 7 == 0, F.lit("10-Q")).otherwise(F.lit("10-K"))
    path = F.concat(
        F.lit("file:/filings/"), "source", F.lit("/"), form, F.lit("/a"), d.cast("string"),
        F.lit("/full-submission.txt"),
    )
    period = F.when(d % 11 == 0, F.lit("NO PERIOD\n")).otherwise(
        F.concat(F.lit("CONFORMED PERIOD OF REPORT:\t"), _year(d).cast("string"), F.lit("1231\n"))
    )
    head = F.when(d % 13 == 0, F.lit("Item 7. Other ")).otherwise(F.lit("Item 1A. Risk Factors "))
    value = F.concat(period, head, "text", F.lit("\nItem 1B. Unresolved"))
    return documents(spark, sf).select(path.alias("path"), value.alias("value"))


def raw_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages wrapped as raw submissions: tags and entities inside Item 1A."""
    p = F.col("page_id")
    path = F.concat(
        F.lit("file:/filings/site"), (p % 50).cast("string"), F.lit("/10-K/a"), p.cast("string"),
        F.lit("/full-submission.txt"),
    )
    value = F.concat(
        F.lit("CONFORMED PERIOD OF REPORT:\t"), _year(p).cast("string"),
        F.lit("1231\nITEM 1A RISK  FACTORS&nbsp;&#160;\n \n"), "html", F.lit("\nItem 2. Properties"),
    )
    return _table(spark, sf, "pages").select(path.alias("path"), value.alias("value"))


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    return T.tokenize(corpus(spark, sf), T.stop_words(spark))


def stored_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return durable(tokens(spark, sf), "tokens")


def fold(values: Column) -> Column:
    """All dimensions of a vector in ``K`` sums: those with equal index modulo ``K``."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(K - 1)),
        lambda topic: V.total(F.filter(values, lambda _, i: i % K == topic)),
    )


def _embedding(value: Callable[[Column], Column]) -> Column:
    return F.transform("embedding", lambda x: value(x.cast("double")))


def theta(spark: SparkSession, sf: str) -> DataFrame:
    """Document topics made from all dimensions of ``embeddings``."""
    v = F.col("vec_id")
    weights = fold(_embedding(F.abs))
    return _table(spark, sf, "embeddings").select(
        v.alias("doc_id"),
        F.concat(F.lit("T"), (v % 10).cast("string")).alias("ticker"),
        (F.lit(FIRST) + F.floor(v / 10) % 2).cast("int").alias("year"),
        V.let(weights, lambda w: V.let(V.total(w), lambda s: F.transform(w, lambda x: x / s))).alias("theta"),
    )


def profiles_40(spark: SparkSession, sf: str) -> DataFrame:
    """Exposure of 40 companies that is spread out enough to make a network."""
    v = F.col("vec_id")
    docs = _table(spark, sf, "embeddings").select(
        F.concat(F.lit("C"), F.lpad((v % 40).cast("string"), 2, "0")).alias("ticker"),
        fold(_embedding(lambda x: F.greatest(x, F.lit(0.0)))).alias("theta"),
    )
    return EX.company_exposure(docs, K)


def points(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("para_id"), F.col("label").alias("cluster"), "embedding"
    )


def topic_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TOPIC_LABELS.items()), "topic int, label string")


def cluster_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CLUSTER_LABELS.items()), "cluster int, label string")


def language_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Stored tokens with the language of their document."""
    toks = T.tokenize(documents(spark, sf).drop("source"), T.stop_words(spark))
    return durable(toks, "language-tokens")


def language_topics(toks: DataFrame) -> DataFrame:
    """``(topic, term, weight)``: each language as a topic, weights are term shares."""
    topic = F.when(F.col("lang") == "de", 0).when(F.col("lang") == "en", 1).when(
        F.col("lang") == "es", 2
    ).otherwise(3)
    counts = (
        toks.select(topic.alias("topic"), F.explode("tokens").alias("term"))
        .groupBy("topic", "term")
        .agg(F.count("*").alias("n"))
    )
    counts = durable(counts, "language-topics")
    # four topics by construction
    sums = F.broadcast(counts.groupBy("topic").agg(F.sum("n").alias("all")))
    return counts.join(sums, "topic").select(
        "topic", "term", (F.col("n") / F.col("all")).alias("weight")
    )


def _text(df: DataFrame) -> DataFrame:
    return df.withColumn("tokens", F.concat_ws(" ", "tokens"))


def _big(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# --- corpus and text -------------------------------------------------------


def corpus_stats(spark, sf):
    return CO.corpus_stats(corpus(spark, sf))


def docs_per_year(spark, sf):
    return _big(CO.docs_per_year(corpus(spark, sf)), "year")


def corpus_preview(spark, sf):
    return _big(CO.preview(corpus(spark, sf)), "year", "word_count")


def period_filter(spark, sf):
    kept = CO.in_period(corpus(spark, sf), SECOND, SECOND, ["src1", "src3", "src12"])
    return _big(kept.select("doc_id", "ticker", "year"), "year")


def filing_extract(spark, sf):
    out = extract_filings(raw_filings(spark, sf)).drop("doc_id", "source_path")
    return _big(out, "year", "word_count")


def filing_extract_html(spark, sf):
    out = extract_filings(raw_pages(spark, sf)).drop("doc_id", "source_path")
    return _big(out, "year", "word_count")


def filing_longest(spark, sf):
    """Longest section of submissions that begin with a contents line."""
    raw = raw_filings(spark, sf).withColumn(
        "value", F.concat(F.lit("Item 1A. Risk Factors 12\nItem 2. 30\n"), "value")
    )
    return _big(extract_filings(raw, pick="longest").drop("doc_id", "source_path"), "year", "word_count")


def first_filings(spark, sf):
    """Word counts of each company's first filing of either year, by path: many a year."""
    found = extract_filings(raw_filings(spark, sf)).withColumn(
        "theta", F.array(F.col("word_count").cast("double"))
    )
    first = D.yearly_profiles(found, FIRST, SECOND)
    return first.select("ticker", F.get("before", F.lit(0)).alias("before"), F.get("after", F.lit(0)).alias("after"))


def flat_filings_query(spark, sf):
    d = F.col("doc_id")
    name = F.concat(
        F.lit("file:/flat/"), "source",
        F.when(d % 9 == 0, F.lit("")).otherwise(F.concat(F.lit("_"), _year(d).cast("string"))),
        F.lit("_risk_factors.txt"),
    )
    raw = documents(spark, sf).select(name.alias("path"), F.col("text").alias("value"))
    return _big(flat_filings(raw).drop("doc_id", "source_path"), "year", "word_count")


def filing_tree_round_trip(spark, sf):
    """Documents written as a filing tree, beside files of another name, and read back."""
    raw = raw_filings(spark, sf)
    name = F.replace(F.col("path"), F.lit("file:/filings/"), F.lit(""))
    strange = F.replace(name, F.lit("full-submission"), F.lit("other"))
    root = f"{durable_root(spark)}/filingloom/{spark.sparkContext.applicationId}/tree-{uuid.uuid4().hex}"
    files = raw.select(name.alias("name"), "value").union(raw.select(strange, "value"))
    write_files(files, root).write.format("noop").mode("overwrite").save()
    return _big(read_filings(spark, root).drop("doc_id", "source_path"), "year", "word_count")


def flat_files_round_trip(spark, sf):
    """Documents written as flat files, some with a malformed name, and read back."""
    d = F.col("doc_id")
    given = F.concat_ws("_", "source", _year(d).cast("string"), d.cast("string"), F.lit("risk_factors.txt"))
    malformed = F.concat_ws("_", "source", F.lit("x"), d.cast("string"), F.lit("risk_factors.txt"))
    name = F.when(d % 9 == 0, malformed).otherwise(given)
    root = f"{durable_root(spark)}/filingloom/{spark.sparkContext.applicationId}/flat-{uuid.uuid4().hex}"
    write_files(documents(spark, sf).select(name.alias("name"), F.col("text").alias("value")), root).write.format(
        "noop"
    ).mode("overwrite").save()
    return _big(read_flat(spark, root).drop("doc_id", "source_path"), "year", "word_count")


def html_clean(spark, sf):
    return _table(spark, sf, "pages").select("page_id", X.clean_markup("html").alias("text"))


def word_count(spark, sf):
    return documents(spark, sf).select("doc_id", X.word_count("text").cast("long").alias("word_count"))


def tokens_query(spark, sf):
    return _text(_big(tokens(spark, sf), "n_tokens").select("doc_id", "n_tokens", "tokens"))


def stopword_filter(spark, sf):
    """Drops the words that more than a tenth of the documents use, as a table."""
    toks = durable(T.tokenize(corpus(spark, sf), []), "tokens")
    return _without(toks, T.frequent_words(toks, 0.1))


def stopword_filter_joined(spark, sf):
    """The same by an anti join, as for a list of any size."""
    toks = durable(T.tokenize(corpus(spark, sf), []), "tokens")
    return _without(toks, T.frequent_words(toks, 0.1), 0)


def _without(toks, stop, lookup_limit=T.LOOKUP_LIMIT):
    out = T.remove_stop_table(toks, stop, lookup_limit)
    return _text(_big(out.select("doc_id", "n_tokens", "tokens"), "n_tokens"))


def lemmatize(spark, sf):
    c = corpus(spark, sf)
    out = T.tokenize(c, T.stop_words(spark), lexicon="corpus")
    return _text(_big(out.select("doc_id", "n_tokens", "tokens"), "n_tokens"))


def lemmatize_joined(spark, sf):
    """The same by a join, as for a lexicon of any size."""
    out = T.tokenize(corpus(spark, sf), T.stop_words(spark), lexicon="corpus", lookup_limit=0)
    return _text(_big(out.select("doc_id", "n_tokens", "tokens"), "n_tokens"))


def lemma_table(spark, sf):
    c = corpus(spark, sf)
    toks = T.tokenize(c, T.stop_words(spark))
    return T.lemma_table(T.distinct_tokens(toks), T.corpus_lexicon(c))


def mean_tokens(spark, sf):
    return T.token_stats(tokens(spark, sf)).withColumn("mean_tokens", F.round("mean_tokens", 6))


def token_preview(spark, sf):
    return _text(T.token_preview(tokens(spark, sf)))


def paragraphs(spark, sf):
    return _big(CO.split_paragraphs(corpus(spark, sf), sep="\n"), "year", "para_pos")


def paragraph_excerpt(spark, sf):
    return CO.excerpts(CO.split_paragraphs(corpus(spark, sf), sep="\n"))


# --- vocabulary ------------------------------------------------------------


def vocabulary(spark, sf):
    return _big(VO.build_vocabulary(tokens(spark, sf)), "id")


def vocabulary_capped(spark, sf):
    """The 500 most frequent tokens only: the row limit decides."""
    return _big(VO.build_vocabulary(tokens(spark, sf), limit=500), "id")


def vocabulary_size(spark, sf):
    toks = stored_tokens(spark, sf)
    return VO.vocabulary_report(toks, VO.build_vocabulary(toks))


def bag_of_words(spark, sf):
    toks = stored_tokens(spark, sf)
    return _big(VO.bag_of_words(toks, VO.build_vocabulary(toks)), "id", "cnt")


def document_lengths(spark, sf):
    toks = stored_tokens(spark, sf)
    return VO.document_lengths(toks, VO.build_vocabulary(toks))


# --- topic tables on given weights -----------------------------------------


def topic_keywords(spark, sf):
    top = TP.rank_terms(language_topics(language_tokens(spark, sf)), 10)
    return _big(TP.topic_keywords(top), "topic")


def topic_terms_ranked(spark, sf):
    top = TP.rank_terms(language_topics(language_tokens(spark, sf)), 30)
    return _big(top.withColumn("weight", F.round("weight", 9)), "topic", "rank")


def term_relevance(spark, sf):
    toks = language_tokens(spark, sf)
    freq = durable(VO.frequencies(toks), "frequencies")
    out = TP.term_relevance(language_topics(toks), freq)
    return _big(out.withColumn("relevance", F.round("relevance", 6)), "topic", "rank")


def topic_distance(spark, sf):
    weights = language_topics(language_tokens(spark, sf))
    out = TP.topic_distance(weights, [0, 1, 2, 3])
    return _big(out.withColumn("distance", F.round("distance", 6)), "topic_a", "topic_b")


def topic_prevalence(spark, sf):
    """Lengths are those of the documents with the same number."""
    out = TP.topic_prevalence(theta(spark, sf), document_lengths(spark, sf), K)
    return _big(out.withColumn("prevalence", F.round("prevalence", 9)), "topic")


def _language_coherence(spark, sf, measure):
    toks = language_tokens(spark, sf)
    top = TP.rank_terms(language_topics(toks), 20)
    out = CH.coherence(toks, top, measure=measure)
    return _big(out.withColumn("coherence", F.round("coherence", 6)), "topic")


def coherence_cv(spark, sf):
    return _language_coherence(spark, sf, "c_v")


def coherence_npmi(spark, sf):
    return _language_coherence(spark, sf, "npmi")


# --- exposure, network, drift ----------------------------------------------


def exposure_long(spark, sf):
    out = EX.exposure_long(EX.company_exposure(theta(spark, sf), K))
    return _big(out.withColumn("exposure", F.round("exposure", 9)), "topic")


def exposure_wide(spark, sf):
    out = EX.exposure_wide(EX.company_exposure(theta(spark, sf), K), K)
    return out.withColumns({f"Topic_{i}": F.round(f"Topic_{i}", 9) for i in range(K)})


def exposure_total(spark, sf):
    out = EX.exposure_total(EX.company_exposure(theta(spark, sf), K), K)
    return _big(out.withColumn("total_exposure", F.round("total_exposure", 9)), "topic")


def labelled_exposure(spark, sf):
    long = EX.exposure_long(EX.company_exposure(theta(spark, sf), K))
    out = EX.with_topic_names(long, topic_labels(spark))
    return out.select("ticker", "label", F.round("exposure", 9).alias("exposure"))


def doc_topic_normalise(spark, sf):
    """Folded weights as they come, negative ones included, floored and scaled."""
    out = _table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("doc_id"),
        F.posexplode(V.floor_and_scale(fold(_embedding(lambda x: x)))).alias("topic", "weight"),
    )
    return _big(out.withColumn("weight", F.round("weight", 9)), "topic")


def doc_topics_wide(spark, sf):
    long = TP.topics_long(theta(spark, sf))
    wide = TP.topics_wide(TP.topics_array(long, K), K)
    return _big(
        wide.withColumns({f"Topic_{i}": F.round(f"Topic_{i}", 9) for i in range(K)}), "year"
    )


def unit_vectors(spark, sf):
    """Length before and after, and cosine of each vector with its first half doubled."""
    raw = _table(spark, sf, "embeddings").select(
        "vec_id",
        F.col("embedding").cast("array<double>").alias("v"),
    )
    skewed = F.transform("v", lambda x, i: F.when(i < 4, 2 * x).otherwise(x))
    return raw.select(
        "vec_id",
        F.round(V.norm("v"), 9).alias("length"),
        F.round(V.norm(V.unit("v")), 9).alias("unit_length"),
        F.round(F.get(V.unit("v"), F.lit(0)), 9).alias("first"),
        F.round(V.cosine("v", skewed), 9).alias("cosine"),
    )


def company_similarity(spark, sf):
    out = N.similarity_edges(profiles_40(spark, sf))
    return out.select("src", "dst", F.round("weight", 6).alias("weight"))


def similarity_edges(spark, sf):
    out = N.similarity_edges(profiles_40(spark, sf), 0.97)
    return out.select(
        "src", "dst", F.round("weight", 6).alias("weight"), F.round("width", 6).alias("width")
    )


def companies(spark, sf):
    return N.vertices(profiles_40(spark, sf))


def company_components(spark, sf):
    return N.exposure_components(durable(profiles_40(spark, sf), "exposure"), 0.97)


def components_default(spark, sf):
    """At the default threshold, where most companies are connected."""
    return N.exposure_components(durable(profiles_40(spark, sf), "exposure"))


def similarity_classes(spark, sf):
    """Links at the default threshold as cells that are linked as wholes and single links,
    written out again."""
    found = N.similarity_classes(durable(profiles_40(spark, sf), "exposure"))
    return N.expand_classes(*found)


def similarity_edges_blocked(spark, sf):
    """Cells cut into blocks of a few companies, as for very many companies."""
    out = N.similarity_edges(profiles_40(spark, sf), 0.97, cell_limit=4)
    return out.select(
        "src", "dst", F.round("weight", 6).alias("weight"), F.round("width", 6).alias("width")
    )


def peer_components(spark, sf):
    exposure = durable(profiles_40(spark, sf), "exposure")
    edges = N.similarity_edges(exposure, 0.97)
    return N.peer_groups(N.connected_components(N.vertices(exposure), edges))


def topic_drift(spark, sf):
    drift = D.topic_drift(D.yearly_profiles(theta(spark, sf), FIRST, SECOND))
    return D.drift_ranking(drift)


def topic_drift_bits(spark, sf):
    """Mean of all filings of a year, base-2 distance."""
    profiles = D.yearly_profiles(theta(spark, sf), FIRST, SECOND, how="mean", k=K)
    drift = D.topic_drift(profiles, base=2)
    return drift.select("ticker", F.round("jsd", 6).alias("jsd"))


def drift_top10(spark, sf):
    """Forty companies, so that ten are a selection."""
    spread_out = theta(spark, sf).withColumn(
        "ticker", F.concat(F.lit("T"), (F.col("doc_id") % 40).cast("string"))
    )
    drift = D.topic_drift(D.yearly_profiles(spread_out.withColumn(
        "year", (F.lit(FIRST) + F.floor(F.col("doc_id") / 40) % 2).cast("int")), FIRST, SECOND))
    return D.drift_ranking(drift, 10)


def drift_top5(spark, sf):
    return D.drift_ranking(D.topic_drift(D.yearly_profiles(theta(spark, sf), FIRST, SECOND)), 5)


def drift_flags(spark, sf):
    drift = D.topic_drift(D.yearly_profiles(theta(spark, sf), FIRST, SECOND))
    return D.flag_drift(drift, 0.35).select("ticker", F.round("jsd", 6).alias("jsd"), "flagged")


def topic_deltas(spark, sf):
    deltas = D.topic_deltas(D.yearly_profiles(theta(spark, sf), FIRST, SECOND))
    named = EX.with_topic_names(deltas, topic_labels(spark))
    return named.select("ticker", "label", F.round("delta", 9).alias("delta"))


def drift_table(spark, sf):
    profiles = D.yearly_profiles(theta(spark, sf), FIRST, SECOND)
    names = {t: f"Topic_{t}" for t in range(K)}
    return D.delta_table(D.topic_drift(profiles), D.topic_deltas(profiles), names)


def top_drifter_deltas(spark, sf):
    out = D.top_drifter_deltas(
        D.yearly_profiles(theta(spark, sf), FIRST, SECOND), topic_labels(spark)
    )
    return _big(
        out.select("ticker", "label", F.round("delta", 9).alias("delta"), "sign"), "sign"
    )


# --- clusters --------------------------------------------------------------


def cluster_sizes(spark, sf):
    return _big(C.cluster_sizes(points(spark, sf), 12), "cluster", "size")


def cluster_representatives(spark, sf):
    p = points(spark, sf)
    out = C.representatives(p, C.label_means(p), n=3)
    out = EX.with_cluster_names(out, cluster_labels(spark))
    return _big(out.withColumn("distance", F.round("distance", 6)), "cluster", "rank")


def silhouette_exact(spark, sf):
    """Every point of the table."""
    out = C.silhouette_points(points(spark, sf))
    return _big(out.withColumn("silhouette", F.round("silhouette", 6)), "cluster")


def silhouette_squared(spark, sf):
    p = points(spark, sf)
    score = C.silhouette_squared(p)
    return p.agg(F.count("*").alias("points")).withColumn("silhouette", F.round(F.lit(score), 6))


def cluster_choice(spark, sf):
    """Best of five groupings of the given labels by exact silhouette."""
    p = points(spark, sf)
    rows = [
        (k, float(C.silhouette(p.withColumn("cluster", F.col("cluster") % k), "para_id")))
        for k in range(2, 7)
    ]
    best = TP.best_score(spark.createDataFrame(rows, "k long, score double"))
    out = D.flag_scores(best, D.SILHOUETTE_TARGET)
    return out.withColumn("score", F.round("score", 6))


# --- fits: no SQL counterpart ----------------------------------------------


def _five_topics(spark, sf):
    """A fit with five topics on all documents: its model, vocabulary and bags."""
    toks = stored_tokens(spark, sf)
    vocabulary = VO.build_vocabulary(toks)
    bags = TP.prepare_bags(toks, vocabulary)
    return TP.fit_lda(bags, 5), vocabulary, bags


def topic_terms(spark, sf):
    model, terms, _ = _five_topics(spark, sf)
    return TP.topic_terms(model, terms, 10)


def doc_topics(spark, sf):
    model, _, bags = _five_topics(spark, sf)
    return TP.topics_long(TP.document_topics(model, bags))


def lda_drift(spark, sf):
    """Which companies' topic mix moved most between the two years."""
    model, _, bags = _five_topics(spark, sf)
    weights = TP.document_topics(model, bags)
    return D.drift_ranking(D.topic_drift(D.yearly_profiles(weights, FIRST, SECOND)), 10)


def lda_search(spark, sf):
    """Default range: 5 to 15 topics, fitted and scored together."""
    return TP.search_topics(stored_tokens(spark, sf)).scores


def paragraph_vectors(spark, sf):
    paras = CO.split_paragraphs(corpus(spark, sf), sep="\n").select("para_id", "paragraph")
    toks = E.paragraph_tokens(paras, T.stop_words(spark)).drop("paragraph")
    return E.tfidf_vectors(durable(toks, "paragraph-tokens"))


def paragraph_word_vectors(spark, sf):
    paras = CO.split_paragraphs(corpus(spark, sf), sep="\n").select("para_id", "paragraph")
    toks = E.paragraph_tokens(paras, T.stop_words(spark)).drop("paragraph")
    return E.word2vec_vectors(durable(toks, "paragraph-tokens"), dim=32)


def kmeans_search(spark, sf):
    found = C.search_clusters(points(spark, sf).drop("cluster"), 2, 5, restarts=3)
    return found.scores


def comparison_report(spark, sf):
    """Languages as topics, given labels as clusters (two of them empty), documents as texts."""
    top = TP.rank_terms(language_topics(language_tokens(spark, sf)), 10)
    p = points(spark, sf)
    nearest = C.representatives(p, C.label_means(p), n=2)
    texts = documents(spark, sf).select(F.col("doc_id").alias("para_id"), F.col("text").alias("paragraph"))
    out = R.comparison_report(
        top, topic_labels(spark), C.cluster_sizes(p, 12), C.representative_texts(nearest, texts),
        cluster_labels(spark),
    )
    return _big(out, "id", "size", "rank")


def doc_topics_check(spark, sf):
    """Documents, topics, and documents whose weights sum to 1."""
    model, _, bags = _five_topics(spark, sf)
    weights = TP.document_topics(model, bags)
    sums = F.abs(V.total("theta") - 1) < 1e-6
    return weights.agg(
        F.count("*").alias("documents"),
        F.max(F.size("theta")).cast("long").alias("topics"),
        F.count_if(sums).alias("whole"),
    )


def lda_model_check(spark, sf):
    """Terms and topics of a fit, topics whose weights sum to 1, passes that raised the bound,
    and whether the learned prior differs between terms."""
    model, terms, _ = _five_topics(spark, sf)
    rising = sum(b > a for a, b in zip(model.bounds, model.bounds[1:]))
    sums = TP.topic_weights(model, terms).groupBy("topic").agg(F.sum("weight").alias("s"), F.count("*").alias("n"))
    return sums.agg(
        F.max("n").alias("terms"),
        F.count("*").alias("topics"),
        F.count_if(F.abs(F.col("s") - 1) < 1e-6).alias("whole"),
    ).withColumn("rising", F.lit(rising).cast("long"))


def kmeans_check(spark, sf):
    """Points, and points assigned to their nearest centroid; default restarts."""
    found = C.search_clusters(points(spark, sf).drop("cluster"), 5, 5)
    centres = F.broadcast(found.centroids.withColumnRenamed("cluster", "other"))  # five rows
    near = found.assigned.select("para_id", "cluster", F.col("embedding").alias("v")).join(centres, F.lit(True))
    nearest = near.groupBy("para_id", "cluster").agg(F.min_by("other", V.euclidean("v", "centroid")).alias("best"))
    return nearest.agg(F.count("*").alias("points"), F.count_if(F.col("best") == F.col("cluster")).alias("nearest"))


def paragraph_vectors_check(spark, sf):
    """Paragraphs, and those whose vector has length 1 (or 0 without any word)."""
    length = V.norm("embedding")
    whole = (F.abs(length - 1) < 1e-9) | (length == 0)
    return paragraph_vectors(spark, sf).agg(F.count("*").alias("paragraphs"), F.count_if(whole).alias("whole"))


def full_analysis(spark, sf):
    """The whole analysis with its default numbers of topics, passes, clusters and restarts:
    rows and a checksum of every result table."""
    config = Config(FIRST, SECOND, separator="\n", topic_labels=TOPIC_LABELS, cluster_labels=CLUSTER_LABELS)
    tables = run_pipeline(corpus(spark, sf), config)
    rows = []
    for name, table in tables.items():
        texts = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in table.columns]
        # one row for each result table
        found = table.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*texts)), F.lit(0)).alias("x")).first()
        rows.append((name, found.n, found.x))
    return spark.createDataFrame(rows, "name string, rows long, checksum long")


def encoded_paragraphs(spark, sf):
    """Vectors of a caller's model, here letter counts, loaded once a task."""
    paras = CO.split_paragraphs(corpus(spark, sf), sep="\n").select("para_id", "paragraph")

    def load():
        return lambda texts: [[float(t.count(letter)) for letter in "aeinorst"] for t in texts]

    out = E.encode(paras, load)
    return out.select("para_id", F.round(V.total("embedding"), 6).alias("total"), F.round(V.norm("embedding"), 6).alias("length"))


def paragraph_svd(spark, sf):
    """Vectors in the leading directions of weighted word counts."""
    paras = CO.split_paragraphs(corpus(spark, sf), sep="\n").select("para_id", "paragraph")
    return SVD.svd_vectors(E.paragraph_tokens(paras, T.stop_words(spark)).drop("paragraph"))


def paragraph_svd_check(spark, sf):
    """Paragraphs, and those whose vector has length 1 (or 0 without any word)."""
    length = V.norm("embedding")
    whole = (F.abs(length - 1) < 1e-9) | (length == 0)
    return paragraph_svd(spark, sf).agg(F.count("*").alias("paragraphs"), F.count_if(whole).alias("whole"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "corpus_stats": corpus_stats,
    "docs_per_year": docs_per_year,
    "corpus_preview": corpus_preview,
    "period_filter": period_filter,
    "filing_extract": filing_extract,
    "filing_extract_html": filing_extract_html,
    "filing_longest": filing_longest,
    "flat_filings": flat_filings_query,
    "html_clean": html_clean,
    "word_count": word_count,
    "tokens": tokens_query,
    "stopword_filter": stopword_filter,
    "lemmatize": lemmatize,
    "lemmatize_joined": lemmatize_joined,
    "stopword_filter_joined": stopword_filter_joined,
    "first_filings": first_filings,
    "components_default": components_default,
    "similarity_edges_blocked": similarity_edges_blocked,
    "lemma_table": lemma_table,
    "mean_tokens": mean_tokens,
    "token_preview": token_preview,
    "paragraphs": paragraphs,
    "paragraph_excerpt": paragraph_excerpt,
    "vocabulary": vocabulary,
    "vocabulary_capped": vocabulary_capped,
    "vocabulary_size": vocabulary_size,
    "bag_of_words": bag_of_words,
    "document_lengths": document_lengths,
    "topic_keywords": topic_keywords,
    "topic_terms_ranked": topic_terms_ranked,
    "term_relevance": term_relevance,
    "topic_distance": topic_distance,
    "topic_prevalence": topic_prevalence,
    "coherence_cv": coherence_cv,
    "coherence_npmi": coherence_npmi,
    "exposure_long": exposure_long,
    "exposure_wide": exposure_wide,
    "exposure_total": exposure_total,
    "labelled_exposure": labelled_exposure,
    "doc_topic_normalise": doc_topic_normalise,
    "doc_topics_wide": doc_topics_wide,
    "unit_vectors": unit_vectors,
    "company_similarity": company_similarity,
    "similarity_edges": similarity_edges,
    "company_components": company_components,
    "companies": companies,
    "peer_components": peer_components,
    "topic_drift": topic_drift,
    "topic_drift_bits": topic_drift_bits,
    "drift_top10": drift_top10,
    "drift_top5": drift_top5,
    "drift_flags": drift_flags,
    "topic_deltas": topic_deltas,
    "drift_table": drift_table,
    "top_drifter_deltas": top_drifter_deltas,
    "cluster_sizes": cluster_sizes,
    "cluster_representatives": cluster_representatives,
    "silhouette_exact": silhouette_exact,
    "silhouette_squared": silhouette_squared,
    "cluster_choice": cluster_choice,
    "topic_terms": topic_terms,
    "doc_topics": doc_topics,
    "lda_drift": lda_drift,
    "lda_search": lda_search,
    "paragraph_vectors": paragraph_vectors,
    "paragraph_word_vectors": paragraph_word_vectors,
    "kmeans_search": kmeans_search,
    "comparison_report": comparison_report,
    "doc_topics_check": doc_topics_check,
    "lda_model_check": lda_model_check,
    "kmeans_check": kmeans_check,
    "paragraph_vectors_check": paragraph_vectors_check,
    "paragraph_svd": paragraph_svd,
    "paragraph_svd_check": paragraph_svd_check,
    "encoded_paragraphs": encoded_paragraphs,
    "filing_tree_round_trip": filing_tree_round_trip,
    "flat_files_round_trip": flat_files_round_trip,
    "similarity_classes": similarity_classes,
    "full_analysis": full_analysis,
}
