import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from filingloom.operators import coherence as CH
from filingloom.operators import lda as LDA
from filingloom.operators import topics as TP
from filingloom.operators import vocabulary as VO
from filingloom.runtime import durable


def token_table(spark, docs):
    rows = [(i, f"T{i % 4}", 2023 + i // 4 % 2, d, len(d)) for i, d in enumerate(docs)]
    return spark.createDataFrame(
        rows, "doc_id long, ticker string, year int, tokens array<string>, n_tokens int"
    )


def random_docs(seed, n, words, longest):
    rng = random.Random(seed)
    return [[rng.choice(words) for _ in range(rng.randint(0, longest))] for _ in range(n)]


def test_vocabulary_bounds_and_ids(spark):
    docs = [["a", "a", "b"], ["a", "b", "c"], ["a", "b", "c"], ["a", "d", "c", "c"]]
    toks = token_table(spark, docs)
    # floor(0.75 * 4) = 3: "a" is in 4 documents, "d" in one
    rows = VO.build_vocabulary(toks, min_df=2, max_share=0.75).orderBy("id").collect()
    assert [(r.token, r.df, r.tf, r.id) for r in rows] == [("b", 3, 3, 0), ("c", 3, 4, 1)]
    bag = VO.bag_of_words(toks, VO.build_vocabulary(toks, 2, 0.75))
    assert sorted((r.doc_id, r.token, r.cnt) for r in bag.collect()) == [
        (0, "b", 1), (1, "b", 1), (1, "c", 1), (2, "b", 1), (2, "c", 1), (3, "c", 2)
    ]
    report = VO.vocabulary_report(toks, VO.build_vocabulary(toks, 2, 0.75)).first()
    assert (report.terms, report.documents) == (2, 4)


@pytest.mark.parametrize("limit", [1, 5, 17, 1000])
def test_vocabulary_limit_keeps_the_most_frequent(spark, limit):
    docs = random_docs(1, 60, [f"w{i}" for i in range(40)], 30)
    toks = token_table(spark, docs)
    df = {w: sum(w in d for d in docs) for w in {w for d in docs for w in d}}
    want = sorted(df, key=lambda w: (-df[w], w))[:limit]
    got = VO.build_vocabulary(toks, 1, 1.0, limit)
    assert [r.token for r in got.orderBy("id").collect()] == want


def brute_coherence(docs, topics, window):
    words = {w for t in topics for w in t}
    windows = []
    for d in docs:
        if words & set(d):
            windows += [set(d[i : i + window]) for i in range(max(1, len(d) - window + 1))]
    n = len(windows)

    def p(*ws):
        return sum(all(w in s for w in ws) for s in windows) / n

    def npmi(a, b):
        if not p(a) or not p(b):
            return 0.0
        return math.log((p(a, b) + 1e-12) / (p(a) * p(b))) / -math.log(p(a, b) + 1e-12)

    out = []
    for t in topics:
        m = np.array([[npmi(a, b) for b in t] for a in t])
        s = m.sum(axis=0)
        cv = np.mean([r @ s / (np.linalg.norm(r) * np.linalg.norm(s)) if r.any() else 0 for r in m])
        pairs = [m[i, j] for i, j in itertools.combinations(range(len(t)), 2)]
        out.append((cv, np.mean(pairs)))
    return out


@pytest.mark.parametrize("seed, window, longest", [(1, 5, 30), (2, 110, 40), (3, 1, 12), (4, 7, 7)])
def test_coherence_against_explicit_windows(spark, seed, window, longest):
    words = [f"w{i}" for i in range(12)]
    docs = random_docs(seed, 25, words, longest)
    topics = [["w1", "w2", "w3", "w4"], ["w3", "w5", "w9", "never"], ["w0", "w11", "w2"]]
    terms = spark.createDataFrame(
        [(k, r + 1, w) for k, t in enumerate(topics) for r, w in enumerate(t)],
        "topic int, rank int, term string",
    )
    toks = token_table(spark, docs)
    want = brute_coherence(docs, topics, window)
    for at, measure in enumerate(("c_v", "npmi")):
        got = CH.coherence(toks, terms, window, 20, measure).orderBy("topic").collect()
        assert [r.coherence for r in got] == pytest.approx([w[at] for w in want], abs=1e-9)


def test_words_that_always_meet_score_one(spark):
    toks = token_table(spark, [["a", "b"], ["a", "b"], ["c", "x"]])
    terms = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (1, 1, "c"), (1, 2, "x")], "topic int, rank int, term string")
    table = {(r.topic, r.i, r.j): r.npmi for r in CH.npmi_table(toks, terms, 10, 2).collect()}
    assert table[0, 0, 1] == pytest.approx(1.0, abs=1e-9)
    with pytest.raises(ValueError):
        CH.coherence(toks, terms, measure="u_mass")


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(5)
    left, right = [f"left{i}" for i in range(8)], [f"right{i}" for i in range(8)]
    docs = [[rng.choice(left) for _ in range(30)] for _ in range(20)]
    docs += [[rng.choice(right) for _ in range(30)] for _ in range(20)]
    docs.append(["unseen"])
    toks = token_table(spark, docs)
    return toks, TP.search_topics(toks, 2, 3, passes=10)


def test_search_finds_planted_topics(planted):
    toks, found = planted
    assert sorted(found.sweep.starts) == [2, 3]
    rows = found.scores.orderBy("k").collect()
    assert found.best_k == TP.best_score(found.scores).first().k
    assert len(rows) == 2
    terms = TP.topic_terms(found.sweep.model(2), found.vocabulary, 8).collect()
    sides = [{r.term[:4] for r in terms if r.topic == t} for t in (0, 1)]
    assert sides in ([{"left"}, {"righ"}], [{"righ"}, {"left"}])
    assert sorted(r["rank"] for r in terms if r.topic == 0) == list(range(1, 9))


def test_scores_of_the_sweep_equal_single_scores(planted):
    toks, found = planted
    for r in found.scores.collect():
        top = TP.topic_terms(found.sweep.model(r.k), found.vocabulary, 20)
        single = CH.coherence(toks, top).agg(F.avg("coherence")).first()[0]
        assert r.score == pytest.approx(single)


def test_document_weights_sum_to_one(planted):
    toks, found = planted
    theta = TP.document_topics(found.sweep.model(2), found.bags).collect()
    assert len(theta) == 41
    for r in theta:
        assert sum(r.theta) == pytest.approx(1.0)
        assert min(r.theta) >= 0
    lost = next(r for r in theta if r.doc_id == 40)
    assert lost.theta == pytest.approx(LDA.document_prior(2))
    sides = {r.doc_id: int(np.argmax(r.theta)) for r in theta}
    assert len({sides[i] for i in range(20)}) == 1
    assert {sides[i] for i in range(20)} != {sides[i] for i in range(20, 40)}


def weights_of(model):
    return np.array([r.weights for r in model.terms.orderBy("id").collect()])


def test_seeded_fit_repeats_alone_and_in_a_sweep(planted):
    toks, found = planted
    again = TP.fit_lda(found.bags, 2, 10)
    assert np.allclose(weights_of(again), weights_of(found.sweep.model(2)))
    assert again.bounds == pytest.approx(found.sweep.model(2).bounds)


def reference_fit(bags, k, passes, start, prior):
    """The same inference document by document and topic by topic, without a learned prior."""
    weights, alpha = start.copy(), np.array(LDA.document_prior(k))
    for _ in range(passes):
        beta = np.exp(LDA.digamma(weights) - LDA.digamma(weights.sum(axis=0)))
        stats = np.zeros_like(weights)
        for ids, counts in bags:
            if not len(ids):
                continue
            gamma = alpha + counts.sum() / k
            for _ in range(LDA.ROUNDS):
                theta = np.exp(LDA.digamma(gamma) - LDA.digamma(gamma.sum()))
                share = theta * beta[ids]
                share /= share.sum(axis=1, keepdims=True)
                new = alpha + counts @ share
                done, gamma = np.abs(new - gamma).mean() < LDA.TOLERANCE / 100, new
                if done:
                    break
            theta = np.exp(LDA.digamma(gamma) - LDA.digamma(gamma.sum()))
            share = theta * beta[ids]
            stats[ids] += counts[:, None] * share / share.sum(axis=1, keepdims=True)
        weights = stats + prior
    return weights


def test_passes_equal_inference_document_by_document(spark):
    rng = random.Random(3)
    docs = [[f"w{rng.randrange(12)}" for _ in range(rng.randint(0, 25))] for _ in range(30)]
    toks = token_table(spark, docs)
    words = VO.build_vocabulary(toks, 1, 1.0)
    bags = TP.prepare_bags(toks, words)
    start = {r.id: r["values"][1:] for r in LDA._first_table(bags, [3], 42).collect()}
    start = np.array([start[i] for i in range(len(start))]) + 1 / 3
    rows = [(np.array(r.ids), np.array(r.counts, float)) for r in bags.collect()]
    got = weights_of(LDA.fit_sweep(bags, [3], 2, learn_prior=False).model(3))
    assert got == pytest.approx(reference_fit(rows, 3, 2, start, 1 / 3), rel=0.05, abs=0.05)


def test_every_pass_raises_the_bound_and_learns_the_prior(spark):
    rng = random.Random(12)
    words = [[f"{side}{i}" for i in range(30)] for side in "abc"]
    docs = [[rng.choice(words[d % 3][: 3 + d % 28]) for _ in range(40)] + ["all"] * 3 for d in range(90)]
    toks = token_table(spark, docs)
    vocabulary = VO.build_vocabulary(toks, 1, 1.0)
    bags = TP.prepare_bags(toks, vocabulary)
    fitted = TP.fit_lda(bags, 3, 12)
    assert len(fitted.bounds) == 12
    gains = np.diff(fitted.bounds)
    assert (gains > -1e-6 * abs(fitted.bounds[0])).all() and gains[0] > 0
    # frequent terms have a larger prior than rare ones, and learning it pays
    table = LDA.fit_sweep(bags, [3], 1)
    assert fitted.bounds[-1] > table.bounds[3][0]
    themes = TP.topic_terms(fitted, vocabulary, 5).where("term <> 'all'").collect()
    assert {len({r.term[0] for r in themes if r.topic == t}) for t in range(3)} == {1}


def test_special_functions():
    x = np.array([0.01, 0.3, 1.0, 2.5, 17.0, 400.0])
    assert LDA.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], abs=1e-9)
    h = 1e-5
    assert LDA.digamma(x) == pytest.approx([(math.lgamma(v + h) - math.lgamma(v - h)) / 2 / h for v in x], rel=1e-4)
    slope = (LDA.digamma(x * (1 + h)) - LDA.digamma(x * (1 - h))) / (2 * h * x)
    assert LDA.trigamma(x) == pytest.approx(slope, rel=1e-6)


def test_documents_of_other_words_have_the_prior(spark, planted):
    toks, found = planted
    strange = token_table(spark, [["left1", "left2"], []])
    extra = spark.createDataFrame([("left1", 0), ("left2", 10_000)], "token string, id int")
    bags = TP.prepare_bags(strange, extra)
    rows = {r.doc_id: r.theta for r in TP.document_topics(found.sweep.model(2), bags).collect()}
    assert rows[1] == pytest.approx(LDA.document_prior(2))
    assert sum(rows[0]) == pytest.approx(1.0)


def test_topic_views(spark, planted):
    toks, found = planted
    model = found.sweep.model(2)
    weights = TP.topic_weights(model, found.vocabulary)
    assert weights.groupBy("topic").agg(F.sum("weight").alias("s")).first().s == pytest.approx(1.0)
    distance = TP.topic_distance(weights, [0, 1]).first()
    assert 0.7 < distance.distance <= math.sqrt(math.log(2)) + 1e-9
    theta = durable(TP.document_topics(model, found.bags), "theta")
    share = TP.topic_prevalence(theta, VO.document_lengths(toks, found.vocabulary), 2).collect()
    assert sum(r.prevalence for r in share) == pytest.approx(1.0)
    best = TP.term_relevance(weights, found.vocabulary, n=3)
    assert best.count() == 6
    text = TP.topic_keywords(TP.topic_terms(model, found.vocabulary, 3)).first().keywords
    assert text.count('*"') == 3 and text.count(" + ") == 2
    long = TP.topics_long(theta)
    back = TP.topics_array(long, 2).orderBy("doc_id").collect()
    assert [r.theta for r in back] == [r.theta for r in theta.orderBy("doc_id").collect()]


def test_empty_vocabulary_is_reported(spark):
    with pytest.raises(ValueError):
        TP.search_topics(token_table(spark, [["a"], ["b"]]), 2, 2)


def test_best_score_prefers_the_smallest_k(spark):
    scores = spark.createDataFrame([(4, 0.5), (3, 0.5), (2, 0.1)], "k int, score double")
    assert TP.best_score(scores).first().k == 3


def test_models_are_units_of_their_own_and_each_unit_one_partition(spark):
    """Few chunks keep all cores busy: no unit waits for another in the same task."""
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import from_arrow_schema

    from filingloom.operators import chunks as CK

    bags = spark.range(300).selectExpr("id AS doc_id", "transform(sequence(0, 9), x -> int((x * 7 + id) % 50)) AS ids")
    bags = bags.selectExpr("*", "transform(ids, x -> 1) AS counts")
    needed = CK.needed_terms(packed := CK.pack(bags.select(CK.chunk(6), "ids", "counts"), 2), 5)
    assert needed.chunks == 3
    model = spark.range(50).selectExpr("id", "array(0.5D, 7D, double(id), 1D, 2D) AS values")
    shares, parts, chunks = [[1, 3, 4], [0, 2]], needed.parts, needed.chunks

    def run(docs, terms):
        unit = docs["unit"][0].as_py()
        ids, values = CK.terms_of(terms, len(shares[unit // chunks]))
        values = values.copy()
        values[:, 1:] *= sum(len(lengths) for lengths, *_ in CK.runs(docs, ids))
        where = np.zeros((1, values.shape[1]))
        where[0, 1] = 1 << TaskContext.get().partitionId()
        return CK.sent(np.concatenate([[-1], ids]), np.concatenate([where, values]), parts, unit // chunks)

    out = CK.meet(packed, model, needed, 5, run, from_arrow_schema(CK.SENT), shares)
    got = {r.id: r["values"] for r in CK.added_up(out, 5, 2, shares).collect()}
    # as many partitions as units: every power of two was added once
    assert int(got[-1][3]) + int(got[-1][2]) == 2 ** (chunks * len(shares)) - 1
    assert {i: v for i, v in got.items() if i >= 0} == {i: [0.5, 7.0, 300.0 * i, 300.0, 600.0] for i in range(50)}


def test_documents_of_any_length_are_inferred_as_one_by_one():
    rng = np.random.default_rng(6)
    k, n = 7, 90
    beta, alpha = rng.gamma(0.3, 1, (n, k)) + 1e-9, np.array(LDA.document_prior(k))
    lengths = np.concatenate([[1, 1, 2, 90], rng.integers(1, 60, 40)])
    local = np.concatenate([rng.permutation(n)[:m] for m in lengths])
    counts = rng.integers(1, 9, len(local)).astype(float)
    gamma, shares, bound = LDA.infer(beta, lengths, local, counts, alpha, rounds=6)
    ends, bounds = np.cumsum(lengths), 0.0
    for d, (low, high) in enumerate(zip(ends - lengths, ends)):
        own, c = beta[local[low:high]], counts[low:high]
        g = alpha + c.sum() / k
        for _ in range(6):
            theta = np.exp(LDA.digamma(g) - LDA.digamma(g.sum()))
            g = alpha + theta * (own * (c / (own @ theta))[:, None]).sum(axis=0)
        assert g == pytest.approx(gamma[d], rel=1e-2, abs=2e-2)
        theta = np.exp(LDA.digamma(gamma[d]) - LDA.digamma(gamma[d].sum()))
        assert shares[low:high] == pytest.approx(own * theta * (c / (own @ theta))[:, None])
        assert shares[low:high].sum(axis=1) == pytest.approx(c)
        bounds += LDA.infer(beta, lengths[d : d + 1], local[low:high], c, alpha, rounds=6)[2]
    assert bound == pytest.approx(bounds, rel=1e-4)


def test_single_precision_infers_the_same_topics():
    """Rows as parts of their largest number: terms that are rare in all topics, or held by a topic
    that a document hardly has, count as in double precision. Many topics stay double."""
    rng = np.random.default_rng(12)
    lengths = rng.integers(1, 300, 80)
    local = np.concatenate([rng.choice(400, n, replace=False) for n in lengths])
    counts = rng.integers(1, 9, len(local)).astype(float)
    for k, single in ((5, True), (15, True), (40, False)):
        alpha, beta = np.array(LDA.document_prior(k)), rng.gamma(0.1, 1, (400, k)) * np.exp(-rng.uniform(0, 190, (400, 1)))
        beta[:20] = np.exp(-200)
        beta[20:30], beta[20:30, k - 1] = np.exp(-199), 1e-9
        whole = LDA.infer(beta, lengths, local, counts, alpha, rounds=20)
        parts, logs = LDA.scaled(beta, alpha)
        assert parts.dtype == (np.float32 if single else float) and parts.max() == 1
        found = LDA.infer(parts, lengths, local, counts, alpha, rounds=20, logs=logs)
        assert found[1].dtype == parts.dtype
        np.testing.assert_allclose(found[0], whole[0], rtol=0.01, atol=0.05)
        np.testing.assert_allclose(found[1].sum(axis=1), counts, rtol=1e-5)
        assert found[2] == pytest.approx(whole[2], rel=1e-5)


def test_documents_come_by_length_and_small_blocks_are_joined(spark, monkeypatch):
    """Few blocks a round: documents of like length lie together, and what is left of blocks is joined."""
    from filingloom.operators import chunks as CK

    rows = [(i, list(range(1 + (i * 37) % 90)), [1 + i % 3] * (1 + (i * 37) % 90)) for i in range(300)]
    bags = spark.createDataFrame(rows, "doc_id long, ids array<int>, counts array<int>")
    packed = CK.pack(bags.select(CK.chunk(1), "ids", "counts")).collect()
    lengths = np.concatenate([CK.loosened(r.lengths) for r in packed])
    assert list(lengths) == sorted(len(r[1]) for r in rows)

    rng = np.random.default_rng(1)
    beta, alpha = rng.dirichlet(np.ones(90), 4).T.copy(), np.array(LDA.document_prior(4))
    local = np.concatenate([rng.permutation(90)[:n] for n in lengths])
    counts = rng.integers(1, 9, len(local)).astype(float)
    monkeypatch.setattr(LDA, "TOLERANCE", 1e-9)
    monkeypatch.setattr(LDA, "BLOCK_CELLS", 4000)
    calls, real = [], np.matmul
    monkeypatch.setattr(np, "matmul", lambda *a, **b: calls.append(1) or real(*a, **b))
    gamma, shares, bound = LDA.infer(beta, lengths, local, counts, alpha, rounds=2000)
    at_once, ends = len(calls), np.concatenate([[0], np.cumsum(lengths)])
    blocks = len(list(LDA._blocks(lengths, 4)))
    rounds, bounds = 0, 0.0
    for d, (low, high) in enumerate(itertools.pairwise(ends)):
        calls.clear()
        one, share, part = LDA.infer(beta, lengths[d : d + 1], local[low:high], counts[low:high], alpha, rounds=2000)
        rounds, bounds = max(rounds, len(calls) // 2), bounds + part
        assert gamma[d] == pytest.approx(one[0], abs=1e-6) and shares[low:high] == pytest.approx(share, abs=1e-6)
    assert bound == pytest.approx(bounds)
    assert blocks > 10 and at_once < 0.33 * 2 * blocks * rounds
