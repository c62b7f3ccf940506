"""Tokenizing: stop words, length, and lemmas by a lexicon join."""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filingloom.functions import text as X
from filingloom.runtime import durable

# Up to this many entries a lookup table travels with the tasks (a few MB);
# beyond it the table is joined. A map is searched one entry after the other, a set is not.
LOOKUP_LIMIT = 50_000
LEMMA_LIMIT = 5_000

# Noun endings with what replaces them, and irregular plurals.
NOUN_ENDINGS = [
    ("s", ""),
    ("ses", "s"),
    ("xes", "x"),
    ("zes", "z"),
    ("ches", "ch"),
    ("shes", "sh"),
    ("men", "man"),
    ("ies", "y"),
    ("ves", "f"),
]
IRREGULAR_NOUNS = {
    "analyses": "analysis",
    "axes": "axis",
    "children": "child",
    "crises": "crisis",
    "criteria": "criterion",
    "diagnoses": "diagnosis",
    "feet": "foot",
    "halves": "half",
    "hypotheses": "hypothesis",
    "indices": "index",
    "knives": "knife",
    "lives": "life",
    "matrices": "matrix",
    "mice": "mouse",
    "phenomena": "phenomenon",
    "teeth": "tooth",
    "theses": "thesis",
    "vertices": "vertex",
    "wives": "wife",
}


def english_stop_words(spark: SparkSession) -> list[str]:
    """Spark's own general English list; a session must be running."""
    return StopWordsRemover.loadDefaultStopWords("english")


def stop_words(spark: SparkSession, extra: list[str] | None = None) -> list[str]:
    """General English words together with the caller's list.

    Words that all filings of a corpus use are best taken from it: see ``frequent_words``.
    """
    return sorted(set(english_stop_words(spark)) | set(extra or []))


def frequent_words(tokens: DataFrame, share: float) -> DataFrame:
    """``(token)``: what more than ``share`` of all documents use, for ``remove_stop_table``."""
    documents = tokens.count()
    per_document = tokens.select(F.explode(F.array_distinct("tokens")).alias("token"))
    counted = per_document.groupBy("token").agg(F.count("*").alias("df"))
    return counted.where(F.col("df") > share * documents).select("token")


def tokenize(
    corpus: DataFrame,
    stop: list[str],
    min_len: int = 4,
    lexicon: DataFrame | str | None = None,
    refilter: bool = False,
    lookup_limit: int = LEMMA_LIMIT,
) -> DataFrame:
    """Corpus without its text, plus ``tokens`` and ``n_tokens``.

    ``lexicon`` is a table ``(token)`` of known words, or ``"corpus"`` for the corpus's own;
    without one, tokens stay as they are. Lemmas come after the stop-word and length tests,
    so a lemma may itself be a stop word; ``refilter`` tests again.
    """
    attrs = [c for c in corpus.columns if c != "text"]
    if lexicon is None:
        out = corpus.select(*attrs, X.text_tokens("text", stop, min_len).alias("tokens"))
    else:
        raw = durable(corpus.select(*attrs, X.raw_tokens("text").alias("tokens")), "raw-tokens")
        out = raw.withColumn("tokens", X.keep_tokens("tokens", stop, min_len))
        own = durable(distinct_tokens(raw), "distinct-tokens")
        lemmas = lemma_table(own.where(F.length("token") >= min_len), own if isinstance(lexicon, str) else lexicon)
        out = apply_lemmas(out, lemmas, lookup_limit)
        if refilter:
            out = out.withColumn("tokens", X.keep_tokens("tokens", stop, min_len))
    return out.withColumn("n_tokens", F.size("tokens"))


def distinct_tokens(tokens: DataFrame) -> DataFrame:
    """Every token once. Repeats inside a document are dropped before the shuffle."""
    return tokens.select(F.explode(F.array_distinct("tokens")).alias("token")).distinct()


def corpus_lexicon(corpus: DataFrame) -> DataFrame:
    """Lexicon made of the corpus's own words, before any is filtered out."""
    return distinct_tokens(corpus.select(X.raw_tokens("text").alias("tokens")))


def _candidates(token: Column) -> Column:
    """The token itself and what each fitting noun ending turns it into."""
    shorter = [
        F.when(
            token.endswith(ending) & (F.length(token) > len(ending)),
            F.concat(token.substr(F.lit(1), F.length(token) - len(ending)), F.lit(new)),
        )
        for ending, new in NOUN_ENDINGS
    ]
    return F.array_compact(F.array(token, *shorter))


def _fits(token: Column) -> Column:
    """Whether a token may have another lemma than itself."""
    is_irregular = token.isin(list(IRREGULAR_NOUNS))
    return reduce(or_, [token.endswith(end) for end, _ in NOUN_ENDINGS], is_irregular)


def _all_candidates(token: Column) -> Column:
    """Irregular plurals keep only themselves and their singular."""
    irregular = F.create_map(*[F.lit(x) for pair in IRREGULAR_NOUNS.items() for x in pair])
    return F.when(
        token.isin(list(IRREGULAR_NOUNS)), F.array(token, F.element_at(irregular, token))
    ).otherwise(_candidates(token))


def _known_candidates(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``(token, lemma)``: the candidates that the lexicon holds, also the token itself."""
    words = lexicon.select(F.col("token").alias("lemma")).distinct()
    return (
        tokens.where(_fits(F.col("token")))
        .select("token", F.explode(F.array_distinct(_all_candidates(F.col("token")))).alias("lemma"))
        .join(words, "lemma")
    )


def _shortest(candidates: DataFrame) -> DataFrame:
    best = F.min(F.struct(F.length("lemma").alias("size"), "lemma"))["lemma"]
    return candidates.groupBy("token").agg(best.alias("lemma")).where("lemma <> token")


def lemma_table(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``(token, lemma)`` for those distinct tokens whose lemma differs.

    Candidates that the lexicon does not hold are no words; of the rest the
    shortest wins, then the alphabetically first.
    """
    return _shortest(_known_candidates(tokens, lexicon))


def lemmatize(tokens: DataFrame, lexicon: DataFrame, lookup_limit: int = LEMMA_LIMIT) -> DataFrame:
    """Replace tokens by their lemmas, order kept; lemmas are found for distinct tokens only."""
    return apply_lemmas(tokens, lemma_table(distinct_tokens(tokens), lexicon), lookup_limit)


def apply_lemmas(tokens: DataFrame, lemmas: DataFrame, lookup_limit: int = LEMMA_LIMIT) -> DataFrame:
    """Replace tokens by the lemmas of a table ``(token, lemma)`` of any size, order kept.

    The table holds only words that change. Up to ``lookup_limit`` of them are a constant in
    the row; otherwise each document gets the entries of its own words by a join.
    """
    lemmas = durable(lemmas.select("token", "lemma"), "lemmas")
    if lemmas.limit(lookup_limit + 1).count() > lookup_limit:
        return _lemmas_by_join(tokens, lemmas)
    found = {r.token: r.lemma for r in lemmas.collect()}
    if not found:
        return tokens
    # one text that becomes a constant map: a literal for each word would cost a call each
    constant = F.from_json(F.lit(json.dumps(found)), "map<string,string>")
    changed = sorted(found)
    return tokens.withColumn(
        "tokens",
        F.transform("tokens", lambda t: F.when(t.isin(changed), F.element_at(constant, t)).otherwise(t)),
    )


def _lemmas_by_join(tokens: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Only words that may change leave the document, each once; their lemmas come back as one
    small map for each document."""
    fitting = F.array_distinct(F.filter("tokens", _fits))
    own = (
        tokens.select("doc_id", F.explode(fitting).alias("token"))
        .join(lemmas, "token")
        .groupBy("doc_id")
        .agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("token", "lemma")))).alias("own_lemmas"))
    )

    def lemma(token: Column) -> Column:
        return F.coalesce(F.try_element_at("own_lemmas", token), token)

    changed = F.when(F.col("own_lemmas").isNull(), F.col("tokens")).otherwise(F.transform("tokens", lemma))
    return tokens.join(own, "doc_id", "left").withColumn("tokens", changed).select(*tokens.columns)


def remove_stop_table(
    tokens: DataFrame, stop: DataFrame, lookup_limit: int = LOOKUP_LIMIT
) -> DataFrame:
    """Drop tokens named in a table ``(token)``; repeats of kept tokens stay.

    A list of checked size is a constant set in each row, a longer one is an anti join.
    """
    stop = durable(stop.select("token").distinct(), "stop-words")
    if stop.count() <= lookup_limit:
        words = [r.token for r in stop.collect()]
        kept = tokens
        if words:
            kept = tokens.withColumn("tokens", F.filter("tokens", lambda t: ~t.isin(words)))
    else:
        kept = _stop_by_join(tokens, stop)
    return kept.withColumn("n_tokens", F.size("tokens"))


def _stop_by_join(tokens: DataFrame, stop: DataFrame) -> DataFrame:
    """Only the distinct words of a document are joined, and those that stop come back to it as one
    small set. Documents that share an id share their words, which are few and go one by one."""
    named = tokens.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"))
    shared = durable(named.where("n > 1").select("doc_id"), "shared-ids")
    if shared.isEmpty():
        return _stop_by_own_words(tokens, stop)
    alone = _stop_by_own_words(tokens.join(shared, "doc_id", "left_anti"), stop)
    return alone.unionByName(_stop_by_place(tokens.join(shared, "doc_id", "left_semi"), stop))


def _stop_by_own_words(tokens: DataFrame, stop: DataFrame) -> DataFrame:
    own = (
        tokens.select("doc_id", F.explode(F.array_distinct("tokens")).alias("token"))
        .join(stop, "token")
        .groupBy("doc_id")
        .agg(F.collect_list("token").alias("own_stop"))
    )
    kept = F.when(F.col("own_stop").isNull(), F.col("tokens")).otherwise(
        F.filter("tokens", lambda t: ~F.array_contains("own_stop", t))
    )
    # a document without an id has no words
    kept = F.when(F.col("doc_id").isNull() | F.col("tokens").isNull(), F.array().cast("array<string>")).otherwise(kept)
    return tokens.join(own, "doc_id", "left").withColumn("tokens", kept).select(*tokens.columns)


def _stop_by_place(tokens: DataFrame, stop: DataFrame) -> DataFrame:
    kept = (
        tokens.select("doc_id", F.posexplode("tokens").alias("pos", "token"))
        .join(stop, "token", "left_anti")
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("ats"))
        .select("doc_id", F.col("ats.token").alias("kept"))
    )
    nothing = F.array().cast("array<string>")
    return (
        tokens.join(kept, "doc_id", "left")
        .withColumn("tokens", F.coalesce("kept", nothing))
        .select(*tokens.columns)
    )


def token_stats(tokens: DataFrame) -> DataFrame:
    return tokens.agg(
        F.count("*").alias("documents"), F.avg("n_tokens").alias("mean_tokens")
    )


def token_preview(tokens: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` tokens of each document."""
    return tokens.select("doc_id", F.slice("tokens", 1, n).alias("tokens"))
