import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from filingloom.operators import drift as D
from filingloom.operators import exposure as EX
from filingloom.operators import network as N
from filingloom.operators import topics as TP


def exposure_table(spark, vectors):
    return spark.createDataFrame(
        [(f"c{i:03d}", [float(x) for x in v]) for i, v in enumerate(vectors)],
        "ticker string, exposure array<double>",
    )


def brute_edges(vectors, threshold):
    out = {}
    for i, a in enumerate(vectors):
        for j in range(i + 1, len(vectors)):
            b = vectors[j]
            size = np.linalg.norm(a) * np.linalg.norm(b)
            if size and a @ b / size > threshold:
                out[f"c{i:03d}", f"c{j:03d}"] = a @ b / size
    return out


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.75, 0.97, 0.999])
@pytest.mark.parametrize("cell_limit", [7, 2000])
def test_edges_match_all_pairs(spark, threshold, cell_limit):
    rng = np.random.default_rng(int(threshold * 1000))
    vectors = rng.dirichlet([0.4] * 6, 90)
    vectors[:30] = vectors[0] + rng.normal(0, 0.01, (30, 6))  # one crowded cell
    vectors[31] = vectors[30]
    vectors[32] = 0
    got = N.similarity_edges(exposure_table(spark, vectors), threshold, cell_limit).collect()
    want = brute_edges(vectors, threshold)
    assert len(got) == len(want)
    assert {(r.src, r.dst) for r in got} == set(want)
    for r in got:
        assert r.weight == pytest.approx(want[r.src, r.dst])
        assert r.width == pytest.approx(4 * r.weight)


def test_edges_of_few_companies_and_bad_threshold(spark):
    for vectors in ([], [[1, 0]], [[0, 0], [0, 0]]):
        assert N.similarity_edges(exposure_table(spark, vectors)).count() == 0
    assert N.similarity_edges(exposure_table(spark, [[1, 2], [1, 2]]), 1.0).columns == [
        "src", "dst", "weight", "width"
    ]
    with pytest.raises(ValueError):
        N.similarity_edges(exposure_table(spark, [[1, 2]]), 1.5)


def components(spark, n, pairs):
    nodes = spark.createDataFrame([(f"v{i:03d}",) for i in range(n)], "ticker string")
    edges = spark.createDataFrame(
        [(f"v{a:03d}", f"v{b:03d}", 1.0) for a, b in pairs], "src string, dst string, weight double"
    )
    return N.connected_components(nodes, edges)


def brute_components(n, pairs):
    root = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return {f"v{i:03d}": f"v{root[i]:03d}" for i in range(n)}


@pytest.mark.parametrize("kind", ["chain", "hub", "mixed", "random", "none"])
def test_components(spark, kind):
    rng = random.Random(3)
    n, pairs = {
        "chain": (30, [(i, i + 1) for i in range(29)]),
        "hub": (25, [(i, 24) for i in range(24)]),
        "mixed": (10, [(0, 1), (1, 2), (4, 5), (5, 6), (6, 4), (8, 8)]),
        "random": (40, [(rng.randrange(40), rng.randrange(40)) for _ in range(30)]),
        "none": (3, []),
    }[kind]
    rng.shuffle(pairs)
    got = {r.ticker: r.component for r in components(spark, n, pairs).collect()}
    assert got == brute_components(n, pairs)


def test_peer_groups_leave_out_singles(spark):
    rows = N.peer_groups(components(spark, 6, [(1, 3), (3, 4)])).collect()
    assert [tuple(r) for r in rows] == [("v001", 3, "v001"), ("v001", 3, "v003"), ("v001", 3, "v004")]


def test_higher_threshold_never_merges_groups(spark):
    rng = np.random.default_rng(8)
    table = exposure_table(spark, rng.dirichlet([0.5] * 4, 40))
    counts = []
    for t in (0.8, 0.95, 0.99):
        c = N.connected_components(N.vertices(table), N.similarity_edges(table, t))
        counts.append(c.select("component").distinct().count())
    assert counts == sorted(counts)


@pytest.mark.parametrize("threshold", [0.0, 0.95, 1.0])
def test_components_from_exposures_with_copies_and_zeros(spark, threshold):
    rng = np.random.default_rng(4)
    vectors = rng.dirichlet([0.4] * 5, 40)
    vectors[10:25] = vectors[3]
    vectors[30:33] = 0
    table = exposure_table(spark, vectors)
    got = {r.ticker: r.component for r in N.exposure_components(table, threshold).collect()}
    plain = N.connected_components(N.vertices(table), N.similarity_edges(table, threshold))
    assert got == {r.ticker: r.component for r in plain.collect()}
    assert {got[f"c{i:03d}"] for i in (30, 31, 32)} == {"c030", "c031", "c032"}


def doc_topics(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, ticker string, year int, theta array<double>")


def test_drift_values(spark):
    third = [0.2, 0.3, 0.5]
    theta = doc_topics(
        spark,
        [
            (1, "same", 2023, third), (2, "same", 2024, third),
            (3, "moved", 2023, [1.0, 0.0, 0.0]), (4, "moved", 2024, [0.0, 1.0, 0.0]),
            (5, "once", 2023, third),
            # the first filing of a year counts, not the later one
            (9, "many", 2023, [0.0, 0.0, 1.0]), (6, "many", 2023, third), (7, "many", 2024, third),
            (8, "other", 2020, third), (10, "other", 2024, third),
        ],
    )
    profiles = D.yearly_profiles(theta, 2023, 2024)
    drift = {r.ticker: r.jsd for r in D.topic_drift(profiles).collect()}
    assert set(drift) == {"same", "moved", "many"}
    assert drift["same"] == pytest.approx(0, abs=1e-7)
    assert drift["many"] == pytest.approx(0, abs=1e-7)
    assert drift["moved"] == pytest.approx(math.sqrt(math.log(2)), abs=1e-6)
    bits = {r.ticker: r.jsd for r in D.topic_drift(profiles, base=2).collect()}
    assert bits["moved"] == pytest.approx(1, abs=1e-6)
    mean = D.yearly_profiles(theta, 2023, 2024, how="mean", k=3)
    assert {r.ticker: r.before for r in mean.collect()}["many"] == pytest.approx([0.1, 0.15, 0.75])
    top = D.top_drifter_deltas(profiles, spark.createDataFrame([(1, "Cyber")], "topic int, label string"))
    assert [(r.ticker, r.label, r.delta, r.sign) for r in top.collect()] == [
        ("moved", "Topic_1: Cyber", 1.0, 1),
        ("moved", "Topic_2: Generic Risk 2", 0.0, 0),
        ("moved", "Topic_0: Generic Risk 0", -1.0, -1),
    ]
    ranked = D.drift_ranking(D.topic_drift(profiles), 1).collect()
    assert [tuple(r) for r in ranked] == [("moved", 0.8326)]
    flags = {r.ticker: r.flagged for r in D.flag_drift(D.topic_drift(profiles)).collect()}
    assert flags == {"same": False, "moved": True, "many": False}
    wide = D.delta_table(D.topic_drift(profiles), D.topic_deltas(profiles), {0: "A", 1: "B", 2: "C"})
    assert wide.columns == ["ticker", "jsd", "A_delta", "B_delta", "C_delta"]
    assert wide.first().B_delta == 1.0


def test_no_company_with_both_years_gives_an_empty_table(spark):
    theta = doc_topics(spark, [(1, "a", 2023, [1.0])])
    profiles = D.yearly_profiles(theta, 2023, 2024)
    assert D.drift_ranking(D.topic_drift(profiles)).collect() == []
    assert D.topic_deltas(profiles).count() == 0


VECTOR = st.lists(st.floats(0, 1), min_size=4, max_size=4)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(VECTOR, VECTOR), min_size=20, max_size=20))
def test_drift_is_symmetric_and_bounded(spark, pairs):
    def jsd(first, second):
        rows = [(f"t{i:02d}", a, b) for i, (a, b) in enumerate(zip(first, second))]
        df = spark.createDataFrame(rows, "ticker string, before array<double>, after array<double>")
        return [r.jsd for r in D.topic_drift(df).orderBy("ticker").collect()]

    a, b = zip(*pairs)
    forth, back = jsd(a, b), jsd(b, a)
    assert forth == pytest.approx(back, abs=1e-6)
    assert all(0 <= x <= math.sqrt(math.log(2)) + 1e-9 for x in forth)


def test_exposure_forms_agree(spark):
    theta = doc_topics(
        spark, [(1, "a", 2023, [0.2, 0.8]), (2, "a", 2024, [0.4, 0.6]), (3, "b", 2024, [1.0, 0.0])]
    )
    table = EX.company_exposure(theta, 2)
    wide = {r.ticker: (r.Topic_0, r.Topic_1) for r in EX.exposure_wide(table, 2).collect()}
    assert wide["a"] == pytest.approx((0.3, 0.7)) and wide["b"] == (1.0, 0.0)
    long = {(r.ticker, r.topic): r.exposure for r in EX.exposure_long(table).collect()}
    assert long["a", 1] == wide["a"][1]
    total = EX.exposure_total(table, 2).collect()
    assert [r.topic for r in total] == [0, 1] and total[0].total_exposure == pytest.approx(1.3)
    weights = TP.topics_wide(theta, 2).where("doc_id = 1").first()
    assert (weights.Topic_0, weights.Topic_1) == (0.2, 0.8)


@pytest.mark.parametrize("threshold", [0.0, 0.6, 0.75, 0.89])
def test_contracted_cells_give_the_same_components(spark, threshold):
    rng = np.random.default_rng(4)
    vectors = np.abs(rng.normal(size=(90, 4))) ** 4
    vectors[5] = vectors[6]
    vectors[7] = 0
    exposure = exposure_table(spark, vectors)
    plain = N.connected_components(N.vertices(exposure), N.similarity_edges(exposure, threshold))
    assert sorted(map(tuple, N.exposure_components(exposure, threshold).collect())) == sorted(map(tuple, plain.collect()))


def expanded(found):
    members, classes, pairs = (t.collect() for t in found)
    cells = {}
    for r in members:
        cells.setdefault(r.cell, []).append(r.ticker)
    out = [(r.src, r.dst) for r in pairs]
    for r in classes:
        for a in cells[r.cell_a]:
            for b in cells[r.cell_b]:
                if r.cell_a != r.cell_b or a < b:
                    out.append((min(a, b), max(a, b)))
    return out


@pytest.mark.parametrize("threshold", [0.2, 0.75, 0.95, 0.999])
@pytest.mark.parametrize("signs", [False, True])
def test_classes_hold_every_link_once(spark, threshold, signs):
    rng = np.random.default_rng(int(threshold * 100) + signs)
    vectors = rng.normal(size=(80, 4)) if signs else rng.dirichlet([0.4] * 4, 80)
    vectors[:30] = vectors[0] + rng.normal(0, 0.005, (30, 4))
    vectors[31] = vectors[30]
    vectors[32] = 0
    table = exposure_table(spark, vectors)
    found = N.similarity_classes(table, threshold)
    links = expanded(found)
    assert len(links) == len(set(links))
    assert set(links) == set(brute_edges(vectors, threshold))
    written = N.expand_classes(*found).collect()
    assert sorted((r.src, r.dst) for r in written) == sorted(links)
    for r in found[2].collect():
        a, b = int(r.src[1:]), int(r.dst[1:])
        assert r.weight == pytest.approx(brute_edges(vectors[[a, b]], -2)["c000", "c001"])


def test_classes_of_a_crowd_are_few(spark):
    """Two crowds: links grow with the square of their size, classes and members do not."""
    rows = []
    for size in (100, 200):
        rng = np.random.default_rng(1)
        crowd = np.vstack([c + rng.uniform(0, 0.002, (size, 3)) for c in ([0.503, 0.303, 0.203], [0.203, 0.703, 0.103])])
        members, classes, pairs = N.similarity_classes(exposure_table(spark, crowd))
        assert N.expand_classes(members, classes, pairs).count() >= size * (size - 1)
        rows.append((members.count(), classes.count() + pairs.count()))
    assert rows[0][0] == 200 and rows[1][0] == 400
    assert rows[1][1] <= 2 * rows[0][1] + 50
    for t in (0.0, 1.0):
        with pytest.raises(ValueError):
            N.similarity_classes(exposure_table(spark, [[1, 2]]), t)
    for vectors in ([], [[0, 0]], [[1, 0]]):
        assert N.expand_classes(*N.similarity_classes(exposure_table(spark, vectors))).count() == 0


@pytest.mark.parametrize("limit", [50_000, 0])
def test_components_of_stars_with_hubs(spark, monkeypatch, limit):
    """Hubs over the limit of links, sent to their links or spread over parts."""
    monkeypatch.setattr(N, "HUB_LINKS", 20)
    monkeypatch.setattr(N, "HUB_LIMIT", limit)
    monkeypatch.setattr(N, "HUB_PARTS", 5)
    pairs = [(500, i) for i in range(100)] + [(900, 1000 + i) for i in range(80)] + [(99, 901), (901, 902)]
    pairs += [(2000 + i, 2001 + i) for i in range(30)] + [(2000, 1001)]
    numbers = sorted({x for p in pairs for x in p})
    vertices = spark.createDataFrame([(n,) for n in numbers], "ticker long")
    edges = spark.createDataFrame(pairs, "src long, dst long")
    found = {r.ticker: r.component for r in N.connected_components(vertices, edges).collect()}
    assert {found[n] for n in numbers if n < 500 or n in (500, 901, 902)} == {0}
    assert {found[n] for n in numbers if n >= 1000 or n == 900} == {900}
