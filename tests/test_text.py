import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from filingloom.functions import text as X
from filingloom.operators import corpus as CO
from filingloom.operators import embeddings as E
from filingloom.operators import tokens as T

PIECES = st.sampled_from(
    ["<b>", "<", ">", "a<b", "&#160;", "&nbsp;", "&NBSP;", "&amp;", " ", "   ", "\n", "\n \n", "\t",
     " ", "\x1c", "word", "Don't", "é", "x-y", "I", "cannot", "tariffs"]
)
TEXTS = st.lists(st.lists(PIECES, max_size=14).map("".join), min_size=30, max_size=30)


def column(spark, texts, expression):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def plain_clean(t):
    t = re.sub("<[^<]+?>", "", t)
    t = re.sub(r"&#\d+;", "", t)
    t = re.sub("&nbsp;", " ", t, flags=re.I)
    t = re.sub(" +", " ", t).strip()
    return re.sub(r"\n\s*\n", "\n\n", t)


@settings(max_examples=8, deadline=None)
@given(TEXTS)
def test_text_functions_match_python(spark, texts):
    assert column(spark, texts, X.strip("t")) == [t.strip() for t in texts]
    assert column(spark, texts, X.clean_markup("t")) == [plain_clean(t) for t in texts]
    assert column(spark, texts, X.word_count("t")) == [len(t.split()) for t in texts]
    want = [
        [w for w in re.sub(r"[^a-z\s]", "", t.lower()).split() if w != "cannot"] for t in texts
    ]
    assert column(spark, texts, X.raw_tokens("t")) == want
    runs = column(spark, texts, X.term_runs(X.raw_tokens("t")))
    assert [{r.token: r.cnt for r in row} for row in runs] == [dict(Counter(w)) for w in want]


def test_tokens_follow_the_fixed_order_of_steps(spark):
    text = "The Company's year-over-year tariffs: DON'T stop 2023 cannot analyses, café tariffs"
    c = spark.createDataFrame([(1, "A", 2023, text)], "doc_id long, ticker string, year int, text string")
    plain = T.tokenize(c, ["tariff", "stop"]).first()
    assert plain.tokens == ["companys", "yearoveryear", "tariffs", "dont", "analyses", "tariffs"]
    assert plain.n_tokens == 6
    lexicon = spark.createDataFrame([("tariff",), ("analysis",), ("company",)], "token string")
    lemmas = T.tokenize(c, ["tariff"], lexicon=lexicon).first().tokens
    # a lemma may be a stop word; "companys" is cut to a known word
    assert lemmas == ["company", "yearoveryear", "tariff", "dont", "stop", "analysis", "tariff"]
    again = T.tokenize(c, ["tariff"], lexicon=lexicon, refilter=True).first().tokens
    assert "tariff" not in again


def lemma_fixture(spark):
    words = ["boxes", "churches", "women", "cities", "wolves", "buses", "mice", "glass", "unknowns", "axes"]
    known = ["box", "church", "woman", "city", "wolf", "bus", "mouse", "glass", "buse", "axis", "ax", "axe"]
    toks = spark.createDataFrame(
        [(1, words + ["boxes"], 11), (2, ["mice"], 1), (3, [], 0)],
        "doc_id long, tokens array<string>, n_tokens int",
    )
    lexicon = spark.createDataFrame([(w,) for w in known], "token string")
    return toks, lexicon


def test_lemma_rules(spark):
    toks, lexicon = lemma_fixture(spark)
    got = dict(T.lemma_table(T.distinct_tokens(toks), lexicon).collect())
    assert got == {
        "boxes": "box", "churches": "church", "women": "woman", "cities": "city",
        "wolves": "wolf", "buses": "bus", "mice": "mouse", "axes": "axis",
    }


def test_lemma_lookup_and_join_agree(spark):
    toks, lexicon = lemma_fixture(spark)
    table = T.lemma_table(T.distinct_tokens(toks), lexicon)
    small = T.lemmatize(toks, lexicon).orderBy("doc_id").collect()
    large = T.lemmatize(toks, lexicon, lookup_limit=2).orderBy("doc_id").collect()
    assert small == large == T.apply_lemmas(toks, table).orderBy("doc_id").collect()
    assert small[0].tokens == [
        "box", "church", "woman", "city", "wolf", "bus", "mouse", "glass", "unknowns", "axis", "box"
    ]
    assert T.apply_lemmas(toks, table.where("false")).count() == 3


def test_stop_table_paths_agree_and_keep_repeats(spark):
    toks = spark.createDataFrame(
        [(1, ["aa", "bb", "aa", "cc"]), (2, ["bb"]), (3, [])], "doc_id long, tokens array<string>"
    )
    stop = spark.createDataFrame([("bb",), ("bb",), ("zz",)], "token string")
    want = [(1, ["aa", "aa", "cc"], 3), (2, [], 0), (3, [], 0)]
    as_set = T.remove_stop_table(toks, stop).orderBy("doc_id")
    assert [tuple(r) for r in as_set.collect()] == want
    as_join = T.remove_stop_table(toks, stop, lookup_limit=1).orderBy("doc_id")
    assert [tuple(r) for r in as_join.collect()] == want


def test_more_stop_words_never_add_tokens_and_tokenizing_repeats(spark):
    c = spark.createDataFrame(
        [(1, "A", 2023, "some Words here and there, words again")],
        "doc_id long, ticker string, year int, text string",
    )
    few = T.tokenize(c, ["some"]).first().tokens
    more = T.tokenize(c, ["some", "words"]).first().tokens
    assert Counter(more) <= Counter(few)
    again = spark.createDataFrame([(1, "A", 2023, " ".join(few))], c.schema)
    assert T.tokenize(again, ["some"]).first().tokens == few


def test_paragraphs(spark):
    long_a, long_b = "a" * 101, "b" * 60 + "  " + "c" * 45
    text = f"{long_a}\n\nshort\n\n  {long_b}  \n\n" + "d" * 100
    c = spark.createDataFrame([(7, "A", 2023, text)], "doc_id long, ticker string, year int, text string")
    rows = CO.split_paragraphs(c).orderBy("para_pos").collect()
    assert [(r.para_id, r.para_pos, r.paragraph) for r in rows] == [
        ("7-0", 0, long_a),
        ("7-2", 2, long_b.replace("  ", " ")),
    ]
    cut = CO.excerpts(CO.split_paragraphs(c), 10).orderBy("para_id").collect()
    assert cut[0].excerpt == "a" * 10 + "..."
    # the separator is literal text
    dots = spark.createDataFrame([(1, "A", 2023, long_a + "." + long_a)], c.schema)
    assert CO.split_paragraphs(dots, sep=".").count() == 2


def test_decode_drops_bad_bytes_only(spark):
    df = spark.createDataFrame([(bytearray(b"ab\xff\xfecd\r\ne\rf"),), (bytearray("x�y".encode()),)], "b binary")
    got = [r[0] for r in df.select(X.decode(F.col("b").cast("string"))).collect()]
    assert got == ["abcd\ne\nf", "x�y"]


def test_stop_words_by_join_leave_the_words_in_their_documents(spark):
    """Only distinct words are joined; ids that repeat or are null give what they gave by places."""
    from filingloom.operators import tokens as TK

    rows = [(1, ["b", "a", "b", "c"]), (2, ["a", "a"]), (3, []), (4, None), (None, ["a", "b"]), (5, ["c", "a", "d"])]
    rows += [(7, ["x", "a", "y"]), (7, ["x", "a", "y"]), (8, ["b"])]
    toks = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    stop = spark.createDataFrame([("a",), ("c",)], "token string")
    show = lambda df: sorted((str(r.doc_id), str(r.tokens)) for r in df.collect())
    assert show(TK._stop_by_join(toks, stop)) == show(TK._stop_by_place(toks, stop))
    plan = TK._stop_by_own_words(toks, stop)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan.lower() and "array_distinct" in plan.lower()


def test_text_tokens_look_at_each_word_once(spark):
    texts = [None, "", "  ", "Gonna cannot stop\u2003the risk-Factors, 10 \u00e4rger K\u0130T a bb", "the the word"]
    rows = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    for stop, min_len in [(["the"], 4), ([], 0), ([], 1), (["word", "a"], 2)]:
        both = rows.select(
            X.keep_tokens(X.raw_tokens("text"), stop, min_len).alias("want"), X.text_tokens("text", stop, min_len).alias("got")
        ).collect()
        assert [r.got for r in both] == [r.want for r in both]
    for out in (T.tokenize(rows, ["the"]), E.paragraph_tokens(rows.withColumnRenamed("text", "paragraph"), ["the"])):
        plan = out.select("tokens")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("filter(") == 1
