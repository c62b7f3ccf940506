"""The physical plans that large inputs depend on."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from filingloom.operators import clusters as C
from filingloom.operators import coherence as CH
from filingloom.operators import corpus as CO
from filingloom.operators import drift as D
from filingloom.operators import exposure as EX
from filingloom.operators import network as N
from filingloom.operators import tokens as T
from filingloom.operators import vocabulary as VO
from filingloom.plans import registry as R
from filingloom.runtime import CHECKPOINT_KEY, broadcast_if_small, durable, durable_root, release
from filingloom.sources import from_table, write_results

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return plan(df).count("Exchange hashpartitioning")


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return from_table(docs, "doc_id", "source", F.lit(2023), "text")


@pytest.fixture(scope="module")
def theta(spark):
    return durable(R.theta(spark, SF), "theta")


def test_filters_and_columns_reach_the_scan(spark, corpus):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = CO.in_period(from_table(docs, "doc_id", "source", F.col("n_chars"), "text"), 1, 9, ["src1"])
    text = plan(kept.select("doc_id", "ticker"))
    assert "EqualTo(source,src1)" in text
    assert "lang" not in text and "text" not in text.split("ReadSchema")[1]


def test_a_stored_corpus_is_pruned_by_year(spark, corpus, tmp_path):
    write_results({"corpus": corpus}, str(tmp_path))
    stored = spark.read.parquet(f"{tmp_path}/corpus")
    text = plan(CO.in_period(stored, 2024, 2025))
    assert "PartitionFilters: [isnotnull(year" in text and "year#" in text


def test_tokenizing_is_one_narrow_stage(spark, corpus):
    toks = T.tokenize(corpus, T.stop_words(spark))
    text = plan(toks)
    assert "Exchange" not in text and "Python" not in text
    assert "INSET" in text  # stop words are a hash set
    assert "Exchange" not in plan(VO.term_counts(toks))


def test_lemma_lookup_does_not_shuffle_tokens(spark, corpus):
    toks = durable(T.tokenize(corpus, []), "tokens")
    words = durable(T.distinct_tokens(toks), "words")
    for out in (T.lemmatize(toks, words), T.remove_stop_table(toks, words.limit(500))):
        assert "Exchange" not in plan(out) and "INSET" in plan(out)


def test_one_shuffle_each(spark, corpus, theta):
    toks = T.tokenize(corpus, [])
    assert shuffles(VO.frequencies(toks)) == 1
    assert shuffles(EX.company_exposure(theta, R.K)) == 1
    assert shuffles(D.topic_drift(D.yearly_profiles(theta, 2023, 2024))) == 1


def test_coherence_shuffles_occurrences_once(spark, corpus):
    toks = durable(T.tokenize(corpus, []), "tokens")
    terms = spark.createDataFrame([(0, 0, "ther", 0), (0, 0, "tion", 1)], "k int, topic int, term string, bit int")
    text = plan(CH.window_sets(CH.window_spans(toks, terms), terms))
    assert text.count("Exchange hashpartitioning(doc_id") == 1
    assert "Exchange hashpartitioning(k" in text  # the small aggregate of sets
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_ranking_drops_rows_before_the_shuffle(spark):
    points = R.points(spark, SF)
    text = plan(C.representatives(points, C.label_means(points), n=3))
    assert "WindowGroupLimit" in text and "Partial" in text
    assert "BroadcastHashJoin" in text


def test_network_joins_on_keys(spark):
    exposure = durable(R.profiles_40(spark, SF), "exposure")
    for threshold in (0.97, 0.75, 0.0):
        for limit in (4, 2000):
            text = plan(N.similarity_edges(exposure, threshold, limit))
            assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_broadcast_depends_on_the_checked_size(spark):
    small = spark.range(10)
    assert "broadcast" in broadcast_if_small(small, 10)._jdf.queryExecution().logical().toString().lower()
    assert broadcast_if_small(small, 9) is small


def session(conf, folder, master):
    """Stand-in with just what the folder choice reads."""
    state = {"dir": folder}
    context = SimpleNamespace(
        master=master,
        getCheckpointDir=lambda: state["dir"],
        setCheckpointDir=lambda d: state.update(dir=d),
    )
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: conf.get(k, d)), sparkContext=context)


def test_durable_folder_comes_from_the_session():
    named = session({CHECKPOINT_KEY: "hdfs://shared/x/"}, None, "spark://host")
    assert durable_root(named) == "hdfs://shared/x"
    assert durable_root(session({}, "hdfs://set/y", "spark://host")) == "hdfs://set/y"
    with pytest.raises(ValueError):
        durable_root(session({}, None, "spark://host"))
    local = session({}, None, "local[4]")
    assert durable_root(local) == durable_root(local)


def test_durable_tables_are_files_until_released(spark):
    copy = durable(spark.range(3), "x")
    assert copy.count() == 3
    assert "FileScan parquet" in plan(copy)
    path = copy._durable_path.removeprefix("file:")
    assert os.path.isdir(path)
    release(copy, spark.range(1))
    assert not os.path.exists(path)


def test_a_machine_local_folder_on_a_cluster_warns():
    with pytest.warns(UserWarning, match="every machine"):
        durable_root(session({CHECKPOINT_KEY: "file:/x"}, None, "spark://host"))
