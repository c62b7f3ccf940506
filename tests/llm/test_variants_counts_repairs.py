"""Spelling variants, token counts and conversation repair against brute force."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from filingloom.llm import common as C
from filingloom.llm import conversations as V
from filingloom.llm import spelling as S
from filingloom.llm import token_counts as T
from filingloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
CLASHES = "c at word n digest t node rows half key parts own other shares n_tokens copy h".split()


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASHES if c not in df.columns})


def documents(spark, rows):
    return clashing(spark.createDataFrame(rows, "doc_id long, text string"))


# --- spelling variants -------------------------------------------------------


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def letters(ch):
    return "a" <= ch <= "z" or "A" <= ch <= "Z" or "À" <= ch <= "ÿ"


def brute_words(rows):
    total = Counter()
    for doc, text in rows:
        for is_run, run in itertools.groupby(text or "", letters):
            if not is_run:
                continue
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def brute_groups(counts, ratio=10):
    out, forms = {}, {}
    for w, n in counts.items():
        near = [v for v in counts if one_apart(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * n else None
        out[w] = [forms[w], None, n, len(near), counts[best] if forms[w] else None]
    for w in counts:
        end = w
        while forms[end] is not None:
            end = forms[end]
        out[w][1] = end
    return {w: tuple(x) for w, x in out.items()}


def groups(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def variants(seed, n, alphabet="abé", low=7, high=9):
    draw = random.Random(seed)
    words = {"".join(draw.choices(alphabet, k=draw.randint(low, high))) for _ in range(n)}
    return {w: 10 ** draw.randrange(5) * draw.randint(2, 9) for w in words}


@pytest.mark.parametrize("size", [7, 64, S.BLOCK])
def test_groups_equal_brute_force_at_every_block_size(spark, size):
    """Few letters: long chains, repeated letters, and halves that very many words share."""
    counts = variants(1, 260) | {"x" * 40: 3, "x" * 41: 90, "x" * 39 + "y": 4}
    vocabulary = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert groups(S.group_variants(vocabulary, size=size)) == brute_groups(counts)


def test_chains_of_forms_end_at_their_last(spark):
    counts = {f"aaaaaaaa{'b' * i}": 2 * 10**i for i in range(12)}
    vocabulary = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = groups(S.group_variants(vocabulary))
    assert found == brute_groups(counts)
    assert {x[1] for x in found.values()} == {"aaaaaaaa" + "b" * 11}


def test_index_finds_every_edit():
    draw = random.Random(4)
    words = sorted({"".join(draw.choices("abc", k=draw.randint(5, 8))) for _ in range(400)})
    index = S.PositionIndex(words)
    for word in words:
        found = Counter()
        for shorter in (len(word), len(word) - 1):
            for half in (S.HEAD, S.TAIL):
                bits = index.near(word, shorter, half)
                found.update(w for i, w in enumerate(words) if bits >> i & 1)
        assert found == Counter(w for w in words if one_apart(w, word))


def test_words_of_all_texts(spark):
    prose = "Straße CAFÉ café résumé Éléphant éléphant naïveté × ÷×÷×÷×÷ " * 3
    long = " ".join("".join(random.Random(i).choices("abcdefgh", k=9)) for i in range(3000)) * 2
    rows = [(None, prose), (1, None), (2, ""), (3, "short a b"), (3, prose), (3, prose), (4, long), (5, "a" * 30_000)]
    rows += [(i, "government goverment governments Government!government") for i in range(10, 60)]
    found = S.spelling_variants(documents(spark, rows), damage=True)
    want = brute_words(rows)
    assert {w: x[2] for w, x in groups(found).items()} == want
    few = {w: n for w, n in want.items() if n > 2 or len(want) < 500}
    got = groups(S.group_variants(spark.createDataFrame(list(few.items()), "word string, n long")))
    assert got == brute_groups(few)


def test_spelling_without_words(spark):
    assert S.spelling_variants(documents(spark, [])).count() == 0
    assert S.spelling_variants(documents(spark, [(1, None), (2, "one two three")])).count() == 0


# --- token counts ------------------------------------------------------------


def library_counts(texts, name=T.TOKENIZER):
    import public_tokenizers as P

    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=P.path(name))
        return [len(model.encode(t)) for t in texts]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(P.path(name))
    return [len(model.encode(t, add_special_tokens=False).ids) for t in texts]


TEXTS = [
    "", " ", "  ", "a", " a", "a ", "a  b", "\n", "\n\n", " \n ", "a\nb", "a \n b", "\ta\r\nb", "▁", "a▁b", " ▁ ",
    "<s>", "</s> <unk> <0x0A>", "İ? é ﬁ ①", "日本語 テキスト", "\x00a", "word " * 3000, "x" * 5000, "1234 5678", " a b",
]


def test_piece_counts_equal_the_library():
    draw = random.Random(9)
    pool = "  \n\n\t▁abcdeéİ中1.?<>|" + chr(0x1F600) + "́ "
    texts = TEXTS + ["".join(draw.choices(pool, k=draw.randrange(40))) for _ in range(4000)]
    model = T.counter()
    assert model.identity
    assert model.counts(texts) == library_counts(texts)
    assert model.counts(texts[::-1]) == library_counts(texts[::-1])  # from what it remembers


def test_counts_of_whole_texts_if_a_model_is_of_another_kind():
    model = T.PieceModel(T._file(T.TOKENIZER))
    model.identity = False
    assert model.counts(TEXTS) == library_counts(TEXTS)


@pytest.mark.parametrize("name", [T.TOKENIZER, "byte_bpe_50k.json"])
def test_one_row_for_each_document(spark, name):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, None), (None, "a"), (3, "a"), (3, "a"), (7, "b")]
    found = T.count_tokens(documents(spark, rows).repartition(3), tokenizer=name, limit=100)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = []
    for (doc, text), n in zip(rows, library_counts([t or "" for _, t in rows], name)):
        want.append((doc, len((text or "").encode()), n, n > 100))
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    assert T.count_tokens(documents(spark, []), tokenizer=name).count() == 0


def test_cache_answers_what_it_holds(spark, tmp_path, monkeypatch):
    cache, version = str(tmp_path / "cache"), T.tokenizer_version()
    first = [(1, "one two"), (2, "one two"), (3, "a▁b"), (4, "a b"), (5, None), (6, "")]
    T.count_tokens(documents(spark, first), cache).collect()
    stored = {bytes(r.digest): r.n_tokens for r in T.stored_counts(spark, cache, version).collect()}
    assert len(stored) == 3  # equal for the tokenizer: (1, 2), (3, 4), (5, 6)

    # what the cache says is believed: change it, and hits show the change
    def altered(n):
        return spark.read.parquet(f"{cache}/version={version}").withColumn("n_tokens", F.col("n_tokens") + n)

    other = str(tmp_path / "other")
    altered(1000).write.parquet(f"{other}/version={version}")
    second = [*first, (7, "new text"), (8, "new text")]
    found = {r.doc_id: r.n_tokens for r in T.count_tokens(documents(spark, second), other).collect()}
    plain = dict(zip([d for d, _ in second], library_counts([t or "" for _, t in second])))
    assert found == {d: n + (1000 if d < 7 else 0) for d, n in plain.items()}
    appended = spark.read.parquet(f"{other}/version={version}")
    assert appended.count() == 4  # one distinct miss
    assert T.misses(appended, T.stored_counts(spark, other, version)).count() == 0

    # many misses, whose texts are joined rather than picked by a broadcast set
    monkeypatch.setattr(T, "FEW_MISSES", 0)
    third = [*second, (9, "third text"), (10, "fourth text")]
    again = {r.doc_id: r.n_tokens for r in T.count_tokens(documents(spark, third), other).collect()}
    assert {d: again[d] for d in found} == found and again[10] == library_counts(["fourth text"])[0]

    # another tokenizer version sees nothing of it, and doubled entries are one
    with_json = T.count_tokens(documents(spark, first), other, "byte_bpe_50k.json")
    assert [r.n_tokens for r in with_json.orderBy("doc_id").collect()][:2] == library_counts(["one two"] * 2, "byte_bpe_50k.json")
    spark.read.parquet(f"{cache}/version={version}").write.mode("append").parquet(f"{other}/version={version}")
    assert T.count_tokens(documents(spark, first), other).count() == len(first)


def test_registered_counts_equal_the_library(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], library_counts([r.text or "" for r in rows])))
    assert {r.doc_id: r.n_tokens for r in QUERIES["op12_token_counts"](spark, SF).collect()} == want


# --- conversation repair -----------------------------------------------------


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        place = ":".join(" " if x is None else str(x) for x in (conv, turn))
        h = zlib.crc32(place.encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else "".join(c for c in text if c not in ".!?") if h == 2 else text
        role = "user" if h == 4 else role
        out += [(conv, turn, role, text)] * (2 if h == 3 else 1)
    return out


def brute_repair(rows):
    """Faults, and the least of all cheapest audits by keeping the best text for every state."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], digest(r)))
    seen, faults = set(), []
    for _, _, role, text in rows:
        words = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not words else "duplicate" if (role, text) in seen else None
        faults.append(fault or ("truncated" if words[-1] not in ".!?" else None))
        seen.add((role, text))
    legal = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(states):
        todo = list(states.items())
        while todo:
            state, (cost, audit, turns) = todo.pop()
            to = "a" if state == "u" else "u"
            option = cost + 2, audit + "I", [*turns, ("assistant" if to == "a" else "user", "")]
            if to not in states or option[:2] < states[to][:2]:
                states[to] = option
                todo.append((to, option))
        return states

    # all audits of equal cost are kept: no reasoning about which prefix may be dropped
    layers = {"": {(0, "", ())}}

    def with_inserts(layers):
        out = {s: set(x) for s, x in layers.items()}
        for _ in range(3):
            for state, options in list(out.items()):
                to = "a" if state == "u" else "u"
                name = "assistant" if to == "a" else "user"
                out.setdefault(to, set()).update({(c + 2, a + "I", (*t, (name, ""))) for c, a, t in options})
            out = {s: {o for o in x if o[0] <= min(y[0] for y in x) + 6} for s, x in out.items()}
        return out

    for (_, _, role, text), fault in zip(rows, faults):
        found = {}
        for state, options in with_inserts(layers).items():
            for cost, audit, turns in options:
                found.setdefault(state, set()).add((cost + 3, audit + "D", turns))
                if fault in ("blank", "duplicate"):
                    continue
                more = cost + (fault == "truncated")
                to = legal.get((state, role[:1]))
                if to:
                    found.setdefault(to, set()).add((more, audit + "K", (*turns, (role, text))))
                to = "a" if state == "u" else "u"
                name = "assistant" if to == "a" else "user"
                found.setdefault(to, set()).add((more + 2, audit + "R", (*turns, (name, text))))
        layers = {s: {o for o in x if o[0] <= min(y[0] for y in x)} for s, x in found.items()}
    ends = [o for s, x in with_inserts(layers).items() if s in ("", "a") for o in x]
    cost, audit, turns = min(ends, key=lambda o: o[:2])
    numbers = [t for _, t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    text = "\n".join(f"{r}:{t}" for r, t in turns)
    counts = Counter(faults)
    sha = hashlib.sha256(text.encode()).hexdigest()
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha


def digest(row):
    return hashlib.sha256(f"{len(row[2])}:{row[2]}:{row[3]}".encode()).digest()


def brute_report(rows, damage):
    damaged = brute_damage(rows) if damage else [(c, t, r or " " if r is None else r, x or " " if x is None else x) for c, t, r, x in rows]
    return {c: brute_repair([r for r in damaged if r[0] == c]) for c in {r[0] for r in rows}}


def chats(spark, rows):
    return clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))


def conversations(seed, n, longest=7):
    draw = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", " ", None, "User", "agent", "u"]
    texts = ["Yes.", "No!", "cut", " \t\n", "", None, "Why? ", "é.\n", "end.", "more", "x "]
    rows = []
    for conv in range(n):
        for turn in range(draw.randint(1, longest)):
            role = draw.choices(roles, [9, 9, 3, 1, 1, 1, 1, 1, 1, 1])[0]
            rows.append((conv or None, draw.choice([turn, turn, turn + 2, None]), role, draw.choice(texts) if draw.random() < 0.4 else f"text {draw.random()}."))
    return rows


def answers(df):
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[c] for c in columns) for r in rows}


@pytest.mark.parametrize("damage", [True, False])
def test_repairs_equal_brute_force(spark, damage):
    rows = conversations(3, 250)
    given = chats(spark, rows).repartition(3)
    fixed = V.repair(V.damage(given) if damage else given)
    assert answers(V.report(fixed, given)) == brute_report(rows, damage)


def test_long_conversations_over_many_segments(spark):
    """Segments of four rows and nodes of two children give the whole tree."""
    rows = conversations(5, 12, 60)
    given = chats(spark, rows).repartition(3)
    want = answers(V.report(V.repair(given), given))
    place = F.col("at") % (1 << 33) + F.floor(F.col("at") / (1 << 33)) * 1024
    cut = V.edits(V.marked(given).withColumn("at", place), segment_bits=2, node_bits=1)
    audits = {}
    for r in sorted(cut.collect(), key=lambda r: (r["c"], r["at"], r["sub"])):
        audits[r["c"]] = audits.get(r["c"], "") + r["edit"]
    assert {None if c == C.NULL_ID else c: a for c, a in audits.items()} == {c: x[6] for c, x in want.items()}


def test_divide_and_conquer_against_all_audits():
    draw = random.Random(8)
    for _ in range(120):
        codes = bytes(draw.choices(range(12), k=draw.randint(1, 4)))
        rows, leave = V.repaired(codes, V.START, None)
        got = "".join(w for w, _ in rows) + V.CLOSING[leave][1]
        assert (price(codes, got), got) == cheapest(codes)
        middle = len(codes) // 2
        if middle:  # two halves that were summed up meet in the same state
            halves = [V.summed([V.row_moves(*divmod(c, 3)) for c in part]) for part in (codes[:middle], codes[middle:])]
            assert V.ending(halves) == leave
            state = V.crossings(halves, V.START, leave)[1]
            assert state == rows[middle][1]


def price(codes, audit):
    """Cost of an audit, None if it does not give a sound conversation."""
    state, cost, rest = V.START, 0, list(codes)
    for edit in audit:
        if edit == "I":
            state, cost = V.following(state), cost + 2
            continue
        if not rest:
            return None
        initial, kind = divmod(rest.pop(0), 3)
        if edit == "D":
            cost += 3
            continue
        if kind == V.MUST_GO:
            return None
        cost += kind == V.TRUNCATED
        if edit == "R":
            state, cost = V.following(state), cost + 2
        elif (initial, state) == (0, V.START) or initial + 1 == V.following(state):
            state = initial + 1
        else:
            return None
    return cost if not rest and state in (V.START, V.ASSISTANT) else None


def cheapest(codes):
    options = []
    pieces = [i + e for i in ("", "I", "II") for e in "KRD"]
    for parts in itertools.product(pieces, repeat=len(codes)):
        for end in ("", "I", "II"):
            audit = "".join(parts) + end
            cost = price(codes, audit)
            if cost is not None:
                options.append((cost, audit))
        if len(options) > 200_000:
            options = [min(options)]
    return min(options)


def test_conversations_without_rows(spark):
    nothing = chats(spark, [])
    assert V.report(V.repair(nothing), nothing).count() == 0
    given = chats(spark, [(5, 0, "user", "a."), (6, 0, "user", "b.")])
    found = answers(V.report(V.repair(given.where("conv_id = 6")), given))
    assert found[5] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert found[6][5:7] == (2, "KI")


def test_edits_carry_roles_and_texts(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "assistant", "a."), (1, 2, "assistant", "a."), (1, 3, "user", "b")]
    found = V.repair(chats(spark, rows)).orderBy("at", "sub").collect()
    assert [(r.edit, r.role, r.text) for r in found] == [
        ("K", "system", "s."), ("I", "user", ""), ("K", "assistant", "a."), ("D", None, None), ("D", None, None)
    ]


def test_registered_repair_equals_brute_force(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert answers(QUERIES["op13_conversation_repair"](spark, SF)) == brute_report(rows, True)


def test_registered_variants_equal_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    counts = brute_words([tuple(r) for r in table.select("doc_id", "text").collect()])
    found = groups(QUERIES["op11_spelling_variants"](spark, SF))
    assert {w: x[2] for w, x in found.items()} == counts
    draw = random.Random(2).sample(sorted(counts), 150)
    want = {w: [v for v in counts if one_apart(w, v)] for w in draw}
    assert {w: found[w][3] for w in draw} == {w: len(x) for w, x in want.items()}
    for w, near in want.items():
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        good = best is not None and counts[best] >= 10 * counts[w]
        assert found[w][0] == (best if good else None)
