"""Grouping of spelling variants: words one edit apart, and the frequent word each belongs to.

Method: bit-sliced position index. For every (position, letter) a bitset over the vocabulary
tells which words have that letter there. A query word walks its letters once and updates, for
all words at a time, the set that matches so far and the sets with one replaced, one inserted
(positions shifted by one forwards) or one deleted letter (shifted backwards).

Plan: the corpus is read once into word counts, combined in tasks before the shuffle. Two words
one edit apart, the shorter of ``s`` letters, share their first ``s // 2`` letters or else their
last ``s - s // 2``; the walk tells which, so no pair is found twice. Words therefore meet only
in blocks of words that share such a half: four entries a word. Halves that very many words
share are cut into blocks that meet block by block, so no task holds more than two of them.
A query gets one row a block, with how many words are near and which is most frequent (words of
a block are numbered by falling count, so it is the lowest bit). Pairs are never listed.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.llm import common as C
from filingloom.runtime import broadcast_if_small, durable

RUN = "[A-Za-zÀ-ÿ]+"
DAMAGE_EVERY = 31
MIN_LENGTH = 7
MIN_COUNT = 2
# A word's form occurs at least this many times as often.
RATIO = 10
# Words that one bitset covers.
BLOCK = 1 << 14
# Which half two words share.
HEAD, TAIL = 0, 1

COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def damaged(run: str, start: int) -> str:
    """The run without one letter, if the checksum of ``<doc_id>:<run>`` says so.

    ``start`` is the checksum of ``<doc_id>:``.
    """
    h = zlib.crc32(run.encode(), start)
    if h % DAMAGE_EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(
    docs: DataFrame,
    min_length: int = MIN_LENGTH,
    damage: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(word, n)``: words of at least ``min_length`` letters and how often they occur.

    Only A-Z are lower-cased. Null texts have no words. With ``damage`` some runs lose a letter
    first, as a checksum of id and run decides; a null id counts as empty text there.
    """
    narrow = docs.select(docs[id_col].cast("string").alias("d"), docs[text_col].cast("string").alias("t"))
    counted = narrow.mapInArrow(lambda b: _count(b, min_length, damage), C.ddl(COUNTS))
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _count(batches, min_length: int, damage: bool):
    # a shorter run can only become shorter
    find = re.compile(RUN.replace("+", f"{{{min_length},}}")).findall
    for batch in batches:
        total: Counter = Counter()
        for doc, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
            raw = text.as_py()
            if not raw:
                continue
            own = Counter(find(raw.lower().decode()))  # bytes: only A-Z change
            if not damage:
                total.update(own)
                continue
            start = zlib.crc32(f"{doc.as_py() or ''}:".encode())
            for run, n in own.items():
                word = damaged(run, start)
                if len(word) >= min_length:
                    total[word] += n
        columns = [pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, schema=COUNTS)


class PositionIndex:
    """Bitsets over words, one for every letter at every position, as whole numbers."""

    def __init__(self, words: list[str]):
        self.all = (1 << len(words)) - 1
        self.bits: dict[tuple[int, str], int] = {}
        self.of_length: dict[int, int] = {}
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(lengths):
            self.of_length[int(n)] = self._set(lengths == n)
        longest = int(lengths.max(initial=0))
        common = int(np.quantile(lengths, 0.99)) if len(words) else 0
        table = np.array(words, f"<U{max(1, common)}").view(np.uint32).reshape(len(words), -1) if words else None
        for at in range(common):
            column = table[:, at]
            for letter in np.unique(column):
                if letter:
                    self.bits[at, chr(letter)] = self._set(column == letter)
        for number in np.flatnonzero(lengths > common) if longest > common else []:
            for at in range(common, len(words[number])):
                key = at, words[number][at]
                self.bits[key] = self.bits.get(key, 0) | 1 << int(number)

    @staticmethod
    def _set(member: np.ndarray) -> int:
        return int.from_bytes(np.packbits(member, bitorder="little").tobytes(), "little")

    def near(self, word: str, shorter: int, half: int) -> int:
        """Words one edit from ``word`` where the shorter of both has ``shorter`` letters and
        the first half of it is the same in both (``HEAD``), or is not (``TAIL``).

        A word of ``shorter`` letters finds those as long or longer, a longer one the shorter.
        """
        find, cut = self.bits.get, shorter // 2
        same, one, more, less = self.all, 0, 0, 0
        longer = len(word) > shorter
        for at in range(cut):
            here = find((at, word[at]), 0)
            if half == TAIL:
                if longer:
                    less = less & find((at - 1, word[at]), 0) | same
                else:
                    more = (more | same) & find((at + 1, word[at]), 0)
                    one = one & here | same & ~here
            same &= here
        if half == TAIL:
            one, more, less, same = one & ~same, more & ~same, less & ~same, 0
        for at in range(cut, len(word)):
            here = find((at, word[at]), 0)
            if longer:
                less = less & find((at - 1, word[at]), 0) | same
            else:
                more = (more | same) & find((at + 1, word[at]), 0)
                one = one & here | same & ~here
            same &= here
            if not (one or more or less or same):
                return 0
        if longer:
            return less & self.of_length.get(shorter, 0)
        more |= same
        return one & self.of_length.get(shorter, 0) | more & self.of_length.get(shorter + 1, 0)


def _meet(block: pa.Table) -> pa.Table:
    """Every query of a block against all its words."""
    if not block.num_rows:
        return pa.Table.from_batches([], schema=NEAR)
    shorter, half = block["shorter"][0].as_py(), block["half"][0].as_py()
    rows = zip(*(block[c].to_pylist() for c in ("word", "n", "listed", "asks")), strict=True)
    listed, asks = [], []
    for word, n, is_listed, is_asking in rows:
        if is_listed:
            listed.append((-n, word))
        if is_asking:
            asks.append(word)
    listed.sort()
    index = PositionIndex([word for _, word in listed])
    out = []
    for word in asks:
        found = index.near(word, shorter, half)
        if found:
            n, best = listed[(found & -found).bit_length() - 1]
            out.append((word, found.bit_count(), -n, best))
    columns = list(zip(*out, strict=True)) or [[]] * 4
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, NEAR, strict=True)], schema=NEAR)


def _halves() -> Column:
    """The four blocks of a word: head and tail, as the shorter word of a pair and as the longer."""
    entries = []
    for shorter in (F.length("word"), F.length("word") - 1):
        cut = F.floor(shorter / 2).cast("int")
        head, tail = F.col("word").substr(F.lit(1), cut), F.expr("word").substr(F.length("word") - (shorter - cut) + 1, shorter - cut)
        for half, key in ((HEAD, head), (TAIL, tail)):
            entries.append(
                F.struct(F.lit(half).alias("half"), shorter.cast("int").alias("shorter"), key.alias("key"))
            )
    return F.array(*entries)


def blocks(vocabulary: DataFrame, size: int = BLOCK) -> DataFrame:
    """``(half, shorter, key, i, q, word, n, listed, asks)``: who meets whom.

    Rare halves share blocks of about ``size`` words (``key`` empty, ``i`` a number). A half of
    more words is cut into parts: part ``i`` is asked by part ``q``, for all ``i`` and ``q``.
    """
    entries = vocabulary.select("word", "n", F.explode(_halves()).alias("e")).select("word", "n", "e.*")
    sizes = durable(entries.groupBy("half", "shorter", "key").agg(F.count("*").alias("words")), "half-sizes")
    heavy = sizes.where(F.col("words") > size).withColumn("parts", F.ceil(F.col("words") / size).cast("int"))
    heavy = broadcast_if_small(durable(heavy.drop("words"), "heavy-halves"))
    light = sizes.where(F.col("words") <= size).groupBy("half", "shorter").agg(F.sum("words").alias("words"))
    shares = light.select("half", "shorter", F.ceil(F.col("words") / size).cast("int").alias("shares"))
    shares = broadcast_if_small(durable(shares, "light-halves"))  # two rows for each length of a word

    placed = entries.join(heavy, ["half", "shorter", "key"], "left").join(shares, ["half", "shorter"], "left")
    few = placed.where("parts IS NULL").select(
        "half", "shorter", F.lit("").alias("key"),
        F.pmod(F.xxhash64("key"), "shares").cast("int").alias("i"), F.lit(0).alias("q"),
        "word", "n", F.lit(True).alias("listed"), F.lit(True).alias("asks"),
    )
    many = placed.where("parts IS NOT NULL").withColumn("own", F.pmod(F.xxhash64("word"), "parts").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    many = many.select("half", "shorter", "key", "word", "n", "own", other)
    apart = F.col("own") != F.col("other")
    as_listed = many.select(
        "half", "shorter", "key", F.col("own").alias("i"), F.col("other").alias("q"),
        "word", "n", F.lit(True).alias("listed"), (~apart).alias("asks"),
    )
    as_asking = many.where(apart).select(
        "half", "shorter", "key", F.col("other").alias("i"), F.col("own").alias("q"),
        "word", "n", F.lit(False).alias("listed"), F.lit(True).alias("asks"),
    )
    return few.union(as_listed).union(as_asking)


def near_words(vocabulary: DataFrame, size: int = BLOCK) -> DataFrame:
    """``(word, n_near, best_n, best)`` for words with a near word; ties by code point."""
    met = blocks(vocabulary, size).groupBy("half", "shorter", "key", "i", "q").applyInArrow(_meet, C.ddl(NEAR))
    best = F.min(F.struct((-F.col("best_n")).alias("n"), "best"))
    found = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return found.select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` from ``(word, form)``: where following forms ends.

    Every round doubles the steps taken. Counts grow by ``RATIO`` a step, so a chain of 64-bit
    counts has fewer than 20, and five rounds end any.
    """
    found = durable(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        # few words have one form: its near words
        stepped = durable(found.join(further, "root", "left").select("word", "root", "next"), "roots")
        if stepped.where("next IS NOT NULL").isEmpty():
            return stepped.select("word", "root")
        found = stepped.select("word", F.coalesce("next", "root").alias("root"))


def group_variants(vocabulary: DataFrame, ratio: int = RATIO, size: int = BLOCK) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every row of ``(word, n)``.

    Words are near if one replaced, inserted or deleted code point turns one into the other. A
    word's form is its most frequent near word (ties: the first by code point) if it occurs at
    least ``ratio`` times as often, else null; its root is where following forms ends, the word
    itself without a form. Words must be distinct and not null.
    """
    vocabulary = durable(vocabulary.select("word", "n"), "spelling-vocabulary")
    near = near_words(vocabulary, size)
    is_form = F.col("best_n") >= ratio * F.col("n")
    found = vocabulary.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("best")).alias("form"),
        F.when(is_form, F.col("best_n")).alias("form_n"),
    )
    found = durable(found, "spelling-forms")
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(
    docs: DataFrame,
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    ratio: int = RATIO,
    damage: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Words of a corpus (see ``word_counts``) that occur at least ``min_count`` times, grouped
    as ``group_variants`` tells. An empty table, or one without such words, gives no rows;
    repeated rows count as often as they occur; other columns are not looked at."""
    counted = word_counts(docs, min_length, damage, id_col, text_col)
    return group_variants(counted.where(F.col("n") >= min_count), ratio)
