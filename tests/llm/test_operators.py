"""Each operator on rows with nulls, empty texts, repeats, ties and clashing columns, against brute force."""

import gzip
import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from filingloom.llm import common as C
from filingloom.llm import fingerprint, jaccard, language, mixing, neighbours, packing, quality, substring, warc
from filingloom.llm import html as H
from filingloom.llm.oracles import ORACLES
from filingloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
BLANK = re.compile(r"[\x20\x09-\x0D]+")
CLASHES = "kept key row size part bin member hashes place label digest text_ range_ span_doc n component".split()


def words(text):
    return [w for w in BLANK.split(text or "") if w]


def prose(seed, n, vocabulary=400):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


def texts():
    base, other, long = prose(1, 120), prose(2, 90), prose(3, 9_000, 5_000)
    near = base.split()
    near[60] = "changed"
    return [
        None, "", " \t\n ", "one", "one", "three short words", base, base, base.upper(), " ".join(near),
        prose(4, 30) + " " + " ".join(base.split()[20:60]) + " " + prose(5, 30), other, other + "\nend",
        "the the the the the the the the the the the the the the the the the the", long,
        prose(6, 13), prose(6, 13) + " tail", "né ü x   y", "日本語 テキスト です", prose(7, 12),
    ]


def table(spark, rows):
    """Documents with columns whose names the operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, 0) for i, t in enumerate(texts())]
    rows += [(6, texts()[6], "en", "s2", 0)]  # a repeated row
    return table(spark, rows).repartition(3)


@pytest.fixture(scope="module")
def with_null_id(spark):
    rows = [(None, prose(1, 40), None, None, None), (3, prose(1, 40), "en", "a", 1), (3, prose(1, 40), "en", "a", 1)]
    return table(spark, [*rows, (9, None, None, "a", None)])


@pytest.fixture(scope="module")
def nothing(spark):
    return table(spark, [])


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


# --- substring dedup ---------------------------------------------------------


def brute_cut(rows, size):
    first = {}
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < doc:
                gone.update(range(i, i + size))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


@pytest.mark.parametrize("size", [1, 5, 13])
def test_substring_equals_brute_force(docs, size):
    out = substring.remove_repeats(docs, size)
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in out.collect())
    assert got == brute_cut(pairs(docs), size)
    assert set(out.columns) == set(docs.columns) | {"n_words", "n_removed"}
    assert {r["key"] for r in out.collect()} == {"clash"}


def many_buckets(monkeypatch):
    """As in a large table: more buckets than tasks write to at once."""
    monkeypatch.setattr(C, "HOP_BUCKETS", 4)
    monkeypatch.setattr(C, "buckets_for", lambda *_: 64)


def test_substring_in_two_steps_equals_brute_force(docs, monkeypatch):
    many_buckets(monkeypatch)
    out = substring.remove_repeats(docs, 5)
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in out.collect())
    assert got == brute_cut(pairs(docs), 5)


@pytest.mark.parametrize("operator", [substring, jaccard])
def test_size_of_packed_entries_does_not_depend_on_buckets(operator):
    draw = random.Random(7)
    # every word its own, so all windows travel
    texts = [" ".join(f"w{draw.getrandbits(40)}" for _ in range(400)) for _ in range(600)]
    batch = pa.RecordBatch.from_pydict({"d": list(range(600)), "t": texts})

    def bytes_of(batches):
        columns = [c for b in batches for c in (b.column(b.schema.get_field_index("keys")),)]
        return sum(len(x) for c in columns for x in c.to_pylist() if x is not None)

    few = list(operator._send([batch], 5, 16))
    many = list(operator._resend(iter(few), 64 * 16))
    one_step = list(operator._send([batch], 5, 64 * 16))
    assert {r for b in many for r in b.column(0).to_pylist()} == {r for b in one_step for r in b.column(0).to_pylist()}
    assert bytes_of(many) < 1.25 * bytes_of(few)

    def values(batches):
        rows = pa.Table.from_batches(batches)
        return sorted(C.column(rows, "keys", "u8", True).tolist())

    assert values(few) == values(many) == values(one_step)


def test_substring_null_id_and_empty_table(with_null_id, nothing):
    got = {(r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.remove_repeats(with_null_id).collect()}
    assert got == {(None, 40, 0), (3, 40, 40), (9, 0, 0)}
    assert substring.remove_repeats(nothing).count() == 0


def test_substring_spans_over_batches(docs, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_WORDS", 64)
    sent = [list(C.chunks(b, "doc_id", "text")) for b in [docs.select("doc_id", "text").toArrow().to_batches()]]
    assert sum(len(c.ids) for c in sent[0]) == docs.count()
    assert sum(c.lengths.sum() for c in sent[0]) == sum(len(words(t)) for _, t in pairs(docs))


# --- jaccard join ------------------------------------------------------------


def brute_links(rows, percent=80):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = defaultdict(set)
    for doc, text in rows:
        w = words((text or "").translate(lower))
        sets[doc] |= {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    return sorted((d, len(sets[d]), root[d]) for d, _ in rows)


def near_copies(n, family):
    """A family of copies with single words changed: some link only through others."""
    draw, out = random.Random(5), []
    base = prose(10, 70).split()
    for i in range(n):
        own = list(base)
        for _ in range(draw.randrange(4)):
            own[draw.randrange(len(own))] = f"x{draw.randrange(50)}"
        out.append((family + i, " ".join(own), "en", "a", 0))
    return out


@pytest.mark.parametrize("limits", [(1 << 14, 256), (100, 3)])
def test_jaccard_equals_brute_force(spark, docs, limits, monkeypatch):
    # small groups make most links go through other groups
    grouped = jaccard._group
    monkeypatch.setattr(jaccard, "_group", _limited(grouped, limits))
    both = docs.select("doc_id", "text").union(spark.createDataFrame(near_copies(60, 100), "doc_id long, text string, a string, b string, c long").select("doc_id", "text"))
    got = sorted(tuple(r) for r in jaccard.link_documents(both).collect())
    assert got == brute_links(pairs(both))


def test_jaccard_in_two_steps_equals_brute_force(spark, docs, monkeypatch):
    many_buckets(monkeypatch)
    copies = spark.createDataFrame(near_copies(60, 100), "doc_id long, text string, a string, b string, c long")
    both = docs.select("doc_id", "text").union(copies.select("doc_id", "text"))
    got = sorted(tuple(r) for r in jaccard.link_documents(both).collect())
    assert got == brute_links(pairs(both))


def _limited(grouped, limits):
    def run(batches, percent):
        jaccard.GROUP_TOKENS, jaccard.GROUP_DOCS = limits
        yield from grouped(batches, percent)

    return run


def test_jaccard_rows_that_share_an_id(spark):
    a, b, z = prose(31, 60), prose(32, 60), prose(33, 60)
    rows = [(1, a), (1, b), (2, a), (3, b), (4, z), (5, z + " tail of it"), (None, z), (7, b), (7, b)]
    found = jaccard.link_documents(table(spark, [(d, t, None, None, None) for d, t in rows])).collect()
    size = {t: n for (_, n, _), t in zip(brute_links([(i, t) for i, (_, t) in enumerate(rows)]), [t for _, t in rows])}
    got = sorted(map(str, map(tuple, found)))
    name = {1: 1, 2: 1, 3: 1, 4: C.NULL_ID, 5: C.NULL_ID, None: C.NULL_ID, 7: 1}
    assert got == sorted(map(str, [(d, size[t], name[d]) for d, t in rows]))


def test_jaccard_null_id_and_empty_table(with_null_id, nothing):
    got = sorted(map(str, map(tuple, jaccard.link_documents(with_null_id).collect())))
    assert got == sorted([f"(None, 36, {C.NULL_ID})", f"(3, 36, {C.NULL_ID})", f"(3, 36, {C.NULL_ID})", "(9, 0, 9)"])
    assert jaccard.link_documents(nothing).count() == 0
    with pytest.raises(ValueError):
        jaccard.link_documents(nothing, percent=0)


# --- packing -----------------------------------------------------------------


@pytest.mark.parametrize("capacity", [7, 2048])
def test_packing_round_trip(docs, capacity):
    import public_tokenizers
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    rows = packing.pack_documents(docs, capacity, keep_ids=True).collect()
    want = sorted((doc, *encode(text or "", add_special_tokens=False).ids, 0) for doc, text in pairs(docs))
    found = defaultdict(list)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        assert r["length"] == len(r["ids"]) and r["start"] == r["piece"] * capacity
        found[r["doc_id"]].append((r["piece"], r["ids"]))
    whole = []
    for doc, parts in found.items():
        firsts = sum(p == 0 for p, _ in parts)  # repeated rows
        ids = [x for p, own in sorted(parts)[:: firsts] for x in own]
        whole += [(doc, *ids)] * firsts
    assert sorted(whole) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    least = -(-sum(r["length"] for r in rows) // capacity)
    assert len(bins) <= least * 1.05 + 1


def test_packing_words_of_every_kind():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encode, own = Tokenizer.from_file(path).encode, packing._tokens(None)
    for text in ["Don't STOP!!", "a<|endoftext|>B <|ENDOFTEXT|>", "x=́ é́!! 12,5%", "ΣΑΣ. Ἀ İ", "'s 'S s' it's.", "a b c d ², ½!"]:
        got = own.of([text.encode()])[0]
        assert np.frombuffer(got, "<u4").tolist() == encode(text, add_special_tokens=False).ids


def test_packing_words_of_any_characters():
    import public_tokenizers
    from tokenizers import Tokenizer

    encode, own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode, packing._tokens(None)
    draw = random.Random(21)
    pool = "aB,.!?-'()İıßẞΣς\u0307\u0301é½²ǅﬁ中😀\u200d \n" + "".join(chr(c) for c in range(0xC0, 0x180, 7))
    texts = ["İ?", "Aİ!", "ẞ."] + ["".join(draw.choices(pool, k=draw.randint(1, 12))) for _ in range(10_000)]
    for text, got in zip(texts, own.of([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == encode(text, add_special_tokens=False).ids, text


def test_packing_holds_words_of_one_text_at_a_time():
    import tracemalloc

    own, small = packing._tokens(None), [" ".join(["ab"] * 5_000).encode() for _ in range(100)]
    want = own.of(small)
    tracemalloc.start()
    try:
        assert own.of(small) == want
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # the ids, and little more than those
    assert peak < 1.5 * sum(map(len, want))


def test_packing_of_tables_sorted_by_length(spark):
    """Tasks of one length each would leave every sequence half empty."""
    lengths = [1100] * 3000 + [900] * 3000
    rows = spark.range(6000).select("id", F.when(F.col("id") < 3000, 1100).otherwise(900).alias("words"))
    docs = rows.select(F.col("id").alias("doc_id"), F.repeat(F.lit("a "), F.col("words") - 1).alias("text"))
    ordered = docs.repartitionByRange(8, "doc_id")
    out = packing.pack_documents(ordered, 2048)
    used = out.select("sequence_id").distinct().count()
    assert out.agg(F.sum("length")).first()[0] == sum(lengths)
    assert used <= sum(lengths) / 2048 * 1.03 and used >= 3000


def test_packing_merges_over_many_tasks(spark):
    rows = [(i, prose(i, 40 + 7 * (i % 9)), None, None, None) for i in range(120)]
    out = packing.pack_documents(table(spark, rows).repartition(40), 2048)
    total = out.agg(F.sum("length")).first()[0]
    # three documents to a task: sequences of one task stay together as items
    assert out.select("sequence_id").distinct().count() <= total / 2048 * 1.25 + 1
    assert packing.pack_documents(table(spark, [])).count() == 0


# --- warc --------------------------------------------------------------------


def test_warc_round_trip(spark):
    big = "<p>" + "x" * 2000
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, None), (4, "http://a/ü\r\nX: y", "é" * 600)]
    rows += [(5, "u", "small"), (6, "u", "small"), (7, "v", "é" * 600), (7, "v", "é" * 600), (None, "w", big), (8, "z", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    index = warc.write_archives(pages)
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_records(index).collect())
    lead = {big: 2, "é" * 600: 7}
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        first = lead.get(html, page)
        kind = "response" if first == page else "revisit"
        want.append((str(page), len(data), hashlib.sha1(data).hexdigest(), kind, None if first == page else first))
    assert got == sorted(want)
    payloads = {r["page_id"]: r["payload"] for r in warc.read_records(index.where("record_type = 'response'")).collect()}
    assert payloads[2] == big.encode() and payloads[3] == b"" and payloads[7] == ("é" * 600).encode()
    one = warc.read_records(index.where("page_id = 5")).collect()
    assert [bytes(r["payload"]) for r in one] == [b"small"]
    for name in {r["archive"] for r in index.select("archive").collect()}:
        with gzip.open(name.removeprefix("file://")) as file:
            assert file.read().startswith(b"WARC/1.1\r\n")
    assert warc.read_records(warc.write_archives(pages.where("false"))).count() == 0


# --- fingerprints ------------------------------------------------------------


def test_fingerprints_follow_the_edit(docs):
    out = fingerprint.fingerprints(docs)
    rows = sorted(out.collect(), key=lambda r: r["doc_id"])
    source = sorted({(d, t or "") for d, t in pairs(docs)})
    by_id = {r["doc_id"]: r for r in rows}
    repeated = {6}
    for at, (doc, text) in enumerate(source):
        after = source[(at + 1) % len(source)][1]
        half = len(text) // 2
        if doc not in repeated:
            assert by_id[doc]["edited"] == text[: len(text) - half] + after[:half]
            assert by_id[doc]["n_chars"] == len(text)
    same = defaultdict(set)
    for r in rows:
        same[r["text"]].add(tuple(r["hashes"]))
        assert bool(r["hashes"]) == bool(words(r["text"]))
    assert all(len(x) == 1 for x in same.values())


def test_fingerprints_estimate_likeness(spark):
    rows = []
    for i in range(40):
        a = prose(100 + i, 1500, 10**6).split()
        rows.append((i, " ".join(a), None, None, None))
    out = fingerprint.fingerprints(table(spark, rows))
    near = out.select(
        fingerprint.jaccard(F.col("hashes"), F.col("edited_hashes")).alias("j"),
        fingerprint.containment(F.col("hashes"), F.col("edited_hashes")).alias("c"),
        fingerprint.jaccard(F.col("hashes"), F.col("next_hashes")).alias("n"),
        fingerprint.containment(F.col("hashes"), fingerprint.merged(F.col("hashes"), F.col("next_hashes"))).alias("m"),
    ).agg(F.avg("j"), F.avg("c"), F.avg("n"), F.min("m")).first()
    assert abs(near[0] - 1 / 3) < 0.03 and abs(near[1] - 0.5) < 0.03 and near[2] == 0 and near[3] == 1


def test_fingerprints_over_ranges(spark, with_null_id, nothing, monkeypatch):
    monkeypatch.setattr(fingerprint, "ROWS_PER_RANGE", 2)
    rows = [(i * 3 - 200, f"text {i} " * 3, None, None, None) for i in range(150)]
    out = fingerprint.fingerprints(table(spark, rows).repartition(4)).collect()
    by_id = {r["doc_id"]: r for r in out}
    assert len(out) == 150
    for i, (doc, text, *_) in enumerate(rows):
        after = rows[(i + 1) % 150][1]
        assert by_id[doc]["edited"] == text[: len(text) - len(text) // 2] + after[: len(text) // 2]
    assert fingerprint.fingerprints(with_null_id).count() == 4
    assert fingerprint.fingerprints(nothing).count() == 0
    one = fingerprint.fingerprints(with_null_id.where("doc_id = 9")).first()
    assert one["edited"] == "" and one["hashes"] == []


# --- mixing ------------------------------------------------------------------


def test_mixing_meets_targets(spark):
    draw = random.Random(3)
    rows = [(i, prose(i, draw.randrange(1, 60)), None, draw.choice(["a", "b", "c", "d", None, ""]), None) for i in range(400)]
    rows += [(1000, None, None, "e", None), (None, "x y", None, "a", None), (5, "x y z", None, "a", None)]
    docs = table(spark, rows)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
    names = sorted((s for s in sizes if s is not None), key=str) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    want, free, total = {}, set(names), sum(sizes.values())
    while True:
        level = (total - sum(want.values())) / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not full:
            break
        want |= {s: 3.0 * sizes[s] for s in full}
        free -= full
    want |= {s: level * weight[s] for s in free}
    for s in names:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 60
    again = sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    assert again == sorted(map(str, out))
    assert mixing.mix(docs.where("false")).count() == 0


# --- embeddings --------------------------------------------------------------


def test_vectors_equal_brute_force(spark, monkeypatch):
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] + draw.normal(size=12) * 0.22).tolist(), int(i % 3)) for i in range(300)]
    rows += [(400 + i, rows[0][1], 0) for i in range(20)] + [(0, rows[0][1], 0)]
    rows += [(500, None, 1), (501, [0.0] * 12, 1), (502, [float("nan")] * 12, 1), (503, [1.0, None] + [0.0] * 10, 1)]
    rows += [(504, rows[1][1], None), (505, [], 1), (506, rows[1][1][:6], 1), (507, [1e-200] * 12, 1), (508, [1e200] * 12, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("clash"))
    got = sorted(tuple(r) for r in neighbours.link_vectors(df.repartition(5)).collect())
    links = {i: set() for i in range(len(rows))}
    ok = [v is not None and lab is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    units = [np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max()) if good else None for (_, v, _), good in zip(rows, ok, strict=True)]
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.93:
                links[i].add(j)
                links[j].add(i)
    want = []
    for i, (vec, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min(rows[j][0] for j in seen)
        want.append((vec, len(links[i]), least, vec == least))
    assert got == sorted(want)
    assert sum(n for _, n, _, _ in want) > 1000
    assert neighbours.link_vectors(df.where("false")).count() == 0


# --- learned operators -------------------------------------------------------


def test_language_held_out_and_edges(spark, docs, nothing):
    sf = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language.held_out(F.col("doc_id"), 5, 0)
    model = language.fit(sf.where(~held))
    found = sf.where(held).select("lang", language.predict(sf, model).alias("p"))
    right = found.agg(F.avg((F.col("lang") == F.col("p.lang_pred")).cast("double"))).first()[0]
    assert right >= 0.98
    edge = docs.select("text", language.predict(docs, model).alias("p")).collect()
    for r in edge:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["p"]["lang_pred"] == "und") != letters and 0 <= r["p"]["score"] <= 1
    empty = language.fit(nothing)
    assert docs.select(language.predict(docs, empty)["lang_pred"]).distinct().collect()[0][0] == "und"
    assert nothing.select(language.predict(nothing, model)).count() == 0
    unseen = language.Scores(model).predict("Unerhörtzungschaft")
    assert unseen[0] == "de"


def test_language_sample_keeps_rare_languages(spark):
    rare = [f"zug{chr(97 + i)} zug{chr(97 + i)} ende" for i in range(5)]
    rows = [(i, f"the word {'x' * (i % 9 + 1)} {prose(i, 5)}", "en", "a", 0) for i in range(2_000)]
    rows += [(5_000 + i, t, "de", "a", 0) for i, t in enumerate(rare)]
    model = language.fit(table(spark, rows), sample_rows=100)
    assert model.languages == ["de", "en"]
    assert all(t.split()[0] in model.words for t in rare)
    huge = language.shares({"a": 30 * 10**9, "b": 12 * 10**9, "c": 10**9, "d": 500}, 20_000)
    drawn = {x: C.below(share) / 2**63 * n for (x, share), n in zip(huge.items(), (500, 10**9, 12 * 10**9, 30 * 10**9))}
    assert all(drawn[x] == pytest.approx(6500) for x in "abc") and drawn["d"] == pytest.approx(500)
    assert C.below(1.0) == 2**63 - 1
    taken = language.shares({"a": 10_000, "b": 3, "c": 40}, 100)
    assert taken["b"] == taken["c"] == 1 and round(taken["a"] * 10_000) == 57


def test_quality_held_out_and_edges(spark, docs, nothing):
    sf = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = language.held_out(F.col("doc_id"), 3, 1)
    model = quality.fit(sf, labels.where(~held))
    scored = sf.where(held).withColumn("score", quality.score(sf, model)).join(labels, "doc_id")
    rows = scored.select("quality", "score").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) >= 0.95
    edge = docs.select("doc_id", quality.score(docs, model).alias("s")).collect()
    assert all(0 <= r["s"] <= 1 for r in edge) and len(edge) == docs.count()
    assert quality.fit(docs, labels.where("quality = 1")).scores(np.zeros((1, quality.N_FEATURES)))[0] > 0.5
    assert nothing.select(quality.score(nothing, model)).count() == 0


# --- pages -------------------------------------------------------------------

PAGES = {
    "": "",
    None: "",
    "<html><body></body></html>": "",
    "<p>Plain words without any structure at all.": "Plain words without any structure at all.",
    "<nav><a href=x>Home</a></nav><article><h1>Head &amp; line</h1><p>One  two\nthree.</p><aside><p>"
    + "side words " * 40
    + "</p></aside><p>Four five&nbsp;six.</p></article><footer>&copy; us</footer>": "Head & line\nOne two three.\nFour five six.",
    '<div class="cookie-notice">We use cookies</div><div class="post-content"><h2>Title</h2><p>Some real text of the'
    ' page here.</p><script>var a="<p>no</p>";</script><form><label>Mail</label></form></div><div id="comments">'
    '<article class="comment"><p>I liked this very much indeed.</p></article></div>': "Title\nSome real text of the page here.",
    "<main><p>" + "word " * 30_000 + "</p></main>": ("word " * 30_000).strip(),
}


def test_pages(spark):
    df = spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string")
    got = {r["page_id"]: r["t"] for r in df.select("page_id", H.main_text(F.col("html")).alias("t")).collect()}
    assert got == dict(enumerate(PAGES.values()))


def test_labelled_pages_are_found_again():
    from filingloom.llm.labelled_pages import pages

    weights = H.default_weights()
    for page in pages():
        kept = [" ".join(b.words) for b in H.scan(page) if isinstance(b, H.Block) and b.kept]
        assert H.extract(page, weights) == "\n".join(kept)


def test_pages_of_the_tables(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("html", H.main_text(F.col("html")).alias("t")).collect()
    for r in rows:
        inside = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        parts = [H.entities.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split() for b in re.split(r"</?(?:p|h1)>", inside)]
        assert r["t"] == "\n".join(" ".join(p) for p in parts if p)


WRAPPERS = ["<form id=aspnetForm>", "<div id=page class=has-sidebar>", '<div class="layout-sidebar">', "<fieldset>", "<header>"]
SECTIONS = ["id=discussion", "class=popular-science", "class=tabs", "class=alert", "class=disclaimer", "class=promotion", "class=search"]


@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_one_hint_word_does_not_drop_the_article(inner):
    """A wrapper of the page, a section of the article; what is boilerplate beside them goes."""
    weights = H.default_weights()
    first, second = "word " * 60, "other " * 50
    nav, foot = "<nav>" + "<a href=#>link</a>" * 6 + "</nav>", "<footer>legal words</footer>"
    want = "\n".join(["Head line", first.strip(), second.strip()])
    for wrapper in WRAPPERS:
        page = f"{nav}<{inner}><h1>Head line</h1><p>{first}</p><p>{second}</p></{inner}>{foot}"
        assert H.extract(f"<body>{wrapper}{page}</{wrapper[1:].split()[0].rstrip('>')}></body>", weights) == want, wrapper
    for section in SECTIONS:
        page = f"<{inner}><h1>Head line</h1><p>{first}</p><section {section}><p>{second}</p></section></{inner}>"
        assert H.extract(f"<body>{nav}{page}{foot}</body>", weights) == want, section
    article = f"<{inner}><h1>Head line</h1><p>{first}</p><p>{second}</p></{inner}>"
    cards = "<article><p>" + "card " * 90 + "</p></article>"
    for beside in (f"<div id=comments>{cards * 9}</div>", f"<aside>{cards}</aside>", f"<footer>{cards}</footer>"):
        assert H.extract(f"<body>{nav}{article}{beside}</body>", weights) == want, beside
    shared = article.replace(f"</{inner}>", f"<div class=share>To <a href=#>a</a> <a href=#>b</a></div></{inner}>")
    assert H.extract(f"<body>{shared}</body>", weights) == want


def test_all_of_a_marked_article_is_kept():
    weights = H.default_weights()
    prose, nav = "word " * 60, "<nav>" + "<a href=#>link</a>" * 6 + "</nav>"
    ends = {
        "<div>The end.</div>": ["The end."],
        "<ul>" + "<li><a href=#>a source</a></li>" * 5 + "</ul>": ["a source"] * 5,
        "<figure><img src=x><figcaption>Some caption</figcaption></figure>": ["Some caption"],
    }
    for inner in ("article", "main"):
        for end, lines in ends.items():
            page = f"<body>{nav}<{inner}>{{}}</{inner}><footer>legal words</footer>"
            assert H.extract(page.format(f"<p>{prose}</p>{end}"), weights) == "\n".join([prose.strip(), *lines])
            assert H.extract(page.format(f"{end}<p>{prose}</p>"), weights) == "\n".join([*lines, prose.strip()])
        for n in (2, 7):
            verse = "<div>" + " ".join(["verse"] * n) + "</div>"
            assert H.extract(page.format(verse * 30), weights) == "\n".join([" ".join(["verse"] * n)] * 30)
    # a main element round an article is not all article
    beside = f"<main><article><p>{prose}</p></article><div>" + "<h3><a href=#>teaser</a></h3>" * 4 + "</div></main>"
    assert H.extract(f"<body>{nav}{beside}", weights) == prose.strip()


# --- registered queries ------------------------------------------------------


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    sql = duck.sql(ORACLES[name])
    order = [sql.columns.index(c) for c in columns]
    want = sorted(repr(tuple(r[i] for i in order)) for r in sql.fetchall())
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == want


COLUMNS = {
    "op1_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op4_document_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op6_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op8_html_extraction": ["page_id", "url", "text", "n_chars"],
    "op10_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_covers_its_table(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns == COLUMNS[name]
    key = df.columns[0]
    base = spark.read.parquet(f"{SF}/{'pages' if key == 'page_id' else 'documents'}.parquet")
    assert df.select(key).distinct().count() == base.count()


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))
