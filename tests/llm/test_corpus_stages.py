"""The pipeline's stages against brute force, and on rows that are hard to handle."""

from collections import defaultdict

import pytest
from test_operators import brute_cut, brute_links, prose, table, words

import corpus_pipeline as P
from filingloom.llm import jaccard


@pytest.fixture(scope="module")
def rows():
    base = prose(1, 80)
    near = base.split()
    near[40] = "other"
    out = [
        (0, base, "en", "a", 0), (1, base, "en", "b", 0), (2, " ".join(near), "en", "a", 0), (2, " ".join(near), "en", "a", 0),
        (3, None, None, None, None), (4, "", "en", "a", 0), (5, "12 345 !!", "en", "c", 0),
        (6, prose(2, 40) + " " + " ".join(base.split()[:30]), "en", "b", 0), (None, prose(3, 50), None, None, None),
        (7, " ".join(base.split()[5:60]), "en", "c", 0), (8, "short", "en", "c", 0), (9, prose(4, 7000, 4000), "de", None, 0),
    ]
    return out + [(20 + i, prose(50 + i, 30), "en", "abc"[i % 3], 0) for i in range(30)]


def test_stages_in_turn(spark, rows, tmp_path):
    docs, kept = table(spark, rows), {}
    for name, stage in P.STAGES:
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        if name != P.STAGES[-1][0]:
            assert docs.columns == P.COLUMNS
    first = [(r["doc_id"], r["text"]) for r in kept["language_id"]]
    assert sorted(map(str, first)) == sorted(str((d, t)) for d, t, *_ in rows if any(c.isalpha() for c in t or ""))
    # numbers stand for null ids, before all others
    first = [(-1 if d is None else d, t) for d, t in first]
    groups = defaultdict(set)
    for doc, _, group in brute_links(first):
        groups[group].add(doc)
    second = [(-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in kept["near_duplicates"]]
    assert sorted(d for d, _ in second) == sorted(groups)
    third = {-1 if r["doc_id"] is None else r["doc_id"]: r for r in kept["repeated_passages"]}
    for doc, n, removed, text in brute_cut(second, 13):
        if removed == n and n:
            assert doc not in third
        else:
            assert third[doc]["text"] == (text if removed else dict(second)[doc])
            assert third[doc]["n_chars"] == len(third[doc]["text"])
    copies = defaultdict(int)
    for r in kept["source_mix"]:
        copies[r["doc_id"]] += 1
        assert words(r["text"])
    assert max(copies.values()) <= 3
    fills = defaultdict(int)
    for r in kept["packed"]:
        fills[r["sequence_id"]] += r["length"]
    assert max(fills.values()) <= 2048
    assert sum(r["piece"] == 0 for r in kept["packed"]) == len(kept["source_mix"])


def test_empty_table(spark):
    docs = table(spark, [])
    for _, stage in P.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_run_on_the_tables(spark):
    out = P.run(spark, "/root/testdata/sf0.001")
    assert out.where("piece = 0").count() > 150
    assert P.ORACLE_SQL is None and [n for n, _ in P.STAGES][-1] == "packed"


def test_rows_without_id_are_documents_of_their_own(spark, tmp_path):
    base, other = prose(200, 60), prose(201, 60)
    # the shingles of the short clean text are each in one of the texts without id
    mixed = " ".join(base.split()[:20])
    texts = [base, other, base, "", prose(202, 40) + " " + mixed]
    rows = [(None, t, "en", "a", 0) for t in texts] + [(1, prose(203, 50), "en", "a", 0), (2, other, "en", "b", 0), (3, mixed, "en", "a", 0)]
    docs = table(spark, rows).repartition(3)
    linked = jaccard.link_documents(docs).collect()
    assert sorted(str(r["doc_id"]) for r in linked) == sorted(str(d) for d, *_ in rows)
    # numbers stand for null ids: the components are those of brute force
    brute = brute_links([(i - 10 if d is None else d, t) for i, (d, t, *_) in enumerate(rows)])
    sizes = defaultdict(int), defaultdict(int)
    for r in linked:
        sizes[0][r["component_id"]] += 1
    for _, _, group in brute:
        sizes[1][group] += 1
    assert sorted(sizes[0].values()) == sorted(sizes[1].values())
    assert sorted(r["n_shingles"] for r in linked) == sorted(n for _, n, _ in brute)

    P.near_duplicates(spark, docs, "").write.parquet(f"{tmp_path}/kept")
    kept = spark.read.parquet(f"{tmp_path}/kept")
    want = [(None, base), (None, other), (None, ""), (None, texts[4]), (1, rows[5][1]), (3, mixed)]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(str, want))
    # of repeats between rows without id one stays, and no other row loses its words
    cut = P.repeated_passages(spark, kept, "").collect()
    assert {prose(203, 50), other} <= {r["text"] for r in cut}
    assert not [r for r in cut if r["doc_id"] == 3]
    assert sum(base.split()[:20] == r["text"].split()[:20] or r["text"].endswith(mixed) for r in cut) >= 1
    taken = defaultdict(int)
    for r in P.source_mix(spark, kept, "").collect():
        taken[r["doc_id"], r["text"]] += 1
    assert max(taken.values()) <= 3


def test_without_labels_texts_with_letters_stay(spark):
    rows = [(1, "né", None, "a", 0), (2, "12 !!", None, "a", 0), (3, None, None, "a", 0), (4, "日本語", None, "a", 0)]
    assert sorted(r["doc_id"] for r in P.language_id(spark, table(spark, rows), "").collect()) == [1, 4]


def test_source_mix_takes_repeated_rows_by_themselves(spark):
    rows = [(7, prose(300 + i, 20), "en", "a", 0) for i in range(4)] + [(None, prose(310 + i, 20), "en", "b", 0) for i in range(4)]
    rows += [(i, prose(320 + i, 20), "en", "c", 0) for i in range(10, 14)]
    taken = defaultdict(int)
    for r in P.source_mix(spark, table(spark, rows), "").collect():
        taken[r["source"], r["doc_id"], r["text"]] += 1
    # 240 words by the weights 1, 2, 3 are 40, 80, 120
    by_source = {s: sum(n for (source, *_), n in taken.items() if source == s) for s in "abc"}
    assert max(taken.values()) <= 3 and by_source == {"a": 2, "b": 4, "c": 6}


def test_rows_that_share_an_id_all_stay(spark):
    texts = [prose(400 + i, 60) for i in range(3)]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[2]), (3, texts[0])]
    docs = table(spark, [(d, t, "en", "a", 0) for d, t in rows])
    kept = sorted((r["doc_id"], r["text"]) for r in P.near_duplicates(spark, docs, "").collect())
    # the copy under another id goes, or stays for it
    assert sorted(t for _, t in kept) == sorted(texts) and {d for d, _ in kept} <= {1, 2, 3}
    twice = table(spark, [(1, texts[0], "en", "a", 0), (1, texts[0] + " " + texts[1], "en", "a", 0)])
    cut = sorted(len(r["text"].split()) for r in P.repeated_passages(spark, twice, "").collect())
    assert sum(cut) == 120
