import random

import pytest

from filingloom.operators import tokens as T
from filingloom.plans.pipeline import Config, run_pipeline
from filingloom.sources import extract_filings, read_filings, write_results
from filingloom.sources.filings import empty_corpus

THEMES = {
    "cyber": "ransomware intrusion malware phishing password firewall encryption hacker".split(),
    "climate": "drought hurricane flooding wildfire temperature rainfall storms glacier".split(),
    "labor": "strike union wages overtime pension hiring turnover bargaining".split(),
}


@pytest.fixture(scope="module")
def filings(tmp_path_factory):
    """Six companies, two years; company T0 moves from one theme to another."""
    root, rng = tmp_path_factory.mktemp("tree"), random.Random(11)
    names = list(THEMES)
    for t in range(6):
        for year in (2023, 2024):
            theme = names[t % 3] if (t, year) != (0, 2024) else "labor"
            paras = [" ".join(rng.choice(THEMES[theme]) for _ in range(25)) for _ in range(4)]
            folder = root / f"T{t}" / "10-K" / f"{year}"
            folder.mkdir(parents=True)
            (folder / "full-submission.txt").write_text(
                f"CONFORMED PERIOD OF REPORT:\t{year}1231\nItem 1A. Risk Factors\n"
                + "\n\n".join(paras)
                + "\nItem 1B. Unresolved"
            )
    return root


@pytest.fixture(scope="module")
def tables(spark, filings):
    corpus = read_filings(spark, str(filings))
    config = Config(
        2023, 2024, min_topics=3, max_topics=3, min_clusters=3, max_clusters=4, restarts=2,
        topic_labels={0: "First"}, cluster_labels={0: "Zero"},
    )
    return run_pipeline(corpus, config)


def test_every_table_has_rows(tables):
    assert {name for name, t in tables.items() if t.isEmpty()} == set()


def test_the_company_that_changed_theme_drifts_most(tables):
    top = tables["drift_ranking"].first()
    assert top.ticker == "T0" and top.jsd > 0.5
    flags = {r.ticker: r.flagged for r in tables["drift"].collect()}
    assert flags["T0"] and not flags["T4"]
    assert {r.ticker for r in tables["top_drifter"].collect()} == {"T0"}


def test_companies_with_the_same_theme_are_peers(tables):
    group = {r.ticker: r.component for r in tables["components"].collect()}
    assert group["T1"] == group["T4"] and group["T2"] == group["T5"]
    assert group["T1"] != group["T2"]


def test_report_shows_both_methods(tables):
    rows = tables["report"].collect()
    assert [r.method for r in rows if r.method == "lda"] == ["lda"] * 3
    clusters = [r for r in rows if r.method == "kmeans"]
    assert len(clusters) == 3
    assert clusters[0].label == "Zero" and clusters[1].label == "Unnamed Embedding Topic 1"
    assert all(r.summary.endswith("...") for r in clusters)
    assert sum(r.size for r in clusters) == 48


def test_tables_can_be_written(spark, tables, tmp_path):
    kept = {k: tables[k] for k in ("exposure", "drift", "doc_topics", "docs_per_year")}
    write_results(kept, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/doc_topics").count() == 36


def test_period_tickers_and_lexicon(spark, filings):
    corpus = read_filings(spark, str(filings))
    config = Config(
        2023, 2023, tickers=["T1", "T2", "T4"], min_df=1, max_share=1.0, min_topics=2, max_topics=2,
        passes=3, min_clusters=2, max_clusters=2, restarts=1, lexicon=T.corpus_lexicon(corpus),
    )
    out = run_pipeline(corpus, config)
    assert out["corpus_stats"].first().documents == 3
    assert out["drift_ranking"].first().jsd == 0  # one year compared with itself


def test_words_of_nearly_all_filings_are_stop_words(spark):
    themes = list(THEMES.values())
    rows = [
        (f"/F{i}/10-K/a{i}/full-submission.txt", f"CONFORMED PERIOD OF REPORT:\t202{3 + i % 2}1231\nItem 1A. Risk Factors "
         + " ".join(["company", *themes[i % 3] * 3]) + "\n\n" + " ".join(themes[i % 3] * 4) + "\nItem 2.")
        for i in range(12)
    ]
    corpus = extract_filings(spark.createDataFrame(rows, "path string, value string"))
    few = dict(max_share=1.0, min_topics=3, max_topics=3, passes=2, min_clusters=2, max_clusters=2, restarts=1)
    out = run_pipeline(corpus, Config(2023, 2024, **few))
    assert {r.token for r in out["vocabulary"].collect()} == {w for theme in themes for w in theme}
    tokens = T.tokenize(corpus, [])
    assert [r.token for r in T.frequent_words(tokens, 0.9).collect()] == ["company"]


def test_empty_corpus_gives_the_same_tables_without_rows(spark, tables, tmp_path):
    none = run_pipeline(empty_corpus(spark), Config(2023, 2024))
    assert list(none) == list(tables)
    for name, table in none.items():
        assert table.isEmpty()
        kinds = dict(tables[name].dtypes)
        assert {c: kinds.get(c) for c in table.columns} == dict(table.dtypes), name
    write_results({"edges": tables["edges"]}, str(tmp_path))
    write_results({"edges": none["edges"]}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/edges").count() == 0
