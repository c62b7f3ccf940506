"""Language identification by known words, with character n-grams for unknown ones.

Method: word-first backoff. A known word scores by its log frequency in each language. An
unknown word falls back to its character n-grams of the greatest length of which any is known,
down to single characters. The scores of all words add up; the best language wins, and its
share of the likelihoods is the score.

The model is fitted on a sample of labelled rows with a fixed expected size (``sample_rows``)
and keeps a fixed number of words and n-grams per language, so it may be broadcast at any size
of the corpus. Prediction reads every whole text in one narrow stage.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.llm import common as C

UNKNOWN = "und"
# Expected number of training rows; words and n-grams (of each length) kept per language.
SAMPLE_ROWS = 20_000
WORDS = 30_000
GRAMS = 20_000
MAX_GRAM = 5
SMOOTHING = 0.5
# Unknown words whose scores a task remembers.
CACHE_WORDS = 200_000
LETTERS = re.compile(r"[^\W\d_]+")

COUNTED = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
PREDICTED = "struct<lang_pred: string, score: double>"


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def fit(
    labelled: DataFrame,
    sample_rows: int = SAMPLE_ROWS,
    text_col: str = "text",
    lang_col: str = "lang",
) -> Model:
    """Fit on a hash sample of about ``sample_rows`` rows; null texts and labels are left out.

    Every language has the same part of the sample, or all its rows if they are fewer. The hash
    covers the text, so copies are taken or left together. Without any labelled row the model
    knows no language.
    """
    rows = labelled.select(labelled[lang_col].cast("string").alias("lang"), labelled[text_col].alias("t"))
    rows = rows.where("lang IS NOT NULL AND t IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if sum(sizes.values()) > sample_rows:
        # one row for each language
        limits = [(lang, C.below(share)) for lang, share in shares(sizes, sample_rows).items()]
        limits = rows.sparkSession.createDataFrame(limits, "lang string, below long")
        drawn = C.unsigned(F.xxhash64("t")) <= F.col("below")
        rows = rows.join(F.broadcast(limits), "lang").where(drawn).select("lang", "t")
    counted = rows.mapInArrow(_count, C.ddl(COUNTED)).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    best = counted.groupBy("lang").agg(
        F.sum("n").alias("total"),
        F.slice(F.sort_array(F.collect_list(F.struct("n", "word")), asc=False), 1, WORDS).alias("top"),
    )
    found = {r["lang"]: (r["total"], [(w["word"], w["n"]) for w in r["top"]]) for r in best.collect()}
    return _model(dict(sorted(found.items())))


def shares(sizes: dict[str, int], sample_rows: int) -> dict[str, float]:
    """Share of its rows that each language gives: equal numbers, small languages in full."""
    left, out = float(sample_rows), {}
    for i, (lang, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        taken = min(n, left / (len(sizes) - i))
        out[lang] = taken / n
        left -= taken
    return out


def _count(batches):
    for batch in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(*batch.columns, strict=True):
            counts.setdefault(lang.as_py(), Counter()).update(words_of(text.as_py()))
        rows = [(lang, w, n) for lang, own in counts.items() for w, n in own.items()]
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, COUNTED, strict=True)], schema=COUNTED
        )


def _model(found: dict[str, tuple[int, list[tuple[str, int]]]]) -> Model:
    size = len(found)
    words: dict[str, int] = {}
    for _, top in found.values():
        for word, n in top:
            if n > 1:
                words.setdefault(word, len(words))
    word_counts = np.zeros((len(words), size))
    gram_counts: list[Counter] = []
    for i, (_, top) in enumerate(found.values()):
        own: Counter = Counter()
        for word, n in top:
            if word in words:
                word_counts[words[word], i] = n
            for gram in grams_of(word):
                own[gram] += 1  # each word once: unknown words resemble rare ones
        gram_counts.append(own)
    grams: dict[str, int] = {}
    for own in gram_counts:
        by_length: dict[int, list] = {}
        for gram, n in own.items():
            by_length.setdefault(len(gram), []).append((-n, gram))
        for kept in by_length.values():
            for _, gram in sorted(kept)[:GRAMS]:
                grams.setdefault(gram, len(grams))
    counts = np.zeros((len(grams), size))
    for i, own in enumerate(gram_counts):
        for gram, n in own.items():
            if gram in grams:
                counts[grams[gram], i] = n
    totals = np.array([total for total, _ in found.values()], float)
    lengths = np.array([len(g) for g in grams], int)
    scores = np.zeros_like(counts)
    for n in set(lengths.tolist()):
        own = counts[lengths == n]
        scores[lengths == n] = np.log((own + SMOOTHING) / (own.sum(0) + SMOOTHING * len(own)))
    word_scores = np.log((word_counts + SMOOTHING) / (totals + SMOOTHING * max(1, len(words))))
    return Model(list(found), words, word_scores, grams, scores)


def grams_of(word: str) -> list[str]:
    """Character n-grams of a word between two blanks, longest first."""
    padded = f" {word} "
    top = min(MAX_GRAM, len(padded))
    return [padded[i : i + n] for n in range(top, 0, -1) for i in range(len(padded) - n + 1)]


class Scores(dict):
    """Row of a word in the table of scores; unknown words get one when first seen."""

    def __init__(self, model: Model):
        super().__init__(model.words)
        self.model, self.used = model, len(model.words)
        self.table = np.vstack([model.word_scores, np.zeros((CACHE_WORDS, len(model.languages)))])

    def __missing__(self, word: str) -> int:
        if self.used < len(self.table):
            self.table[self.used] = self.unseen(word)
            self[word] = self.used
            self.used += 1
            return self.used - 1
        return -1

    def unseen(self, word: str) -> np.ndarray:
        """Mean score of the longest known n-grams; nothing known speaks for no language."""
        known: list[int] = []
        length = 0
        for gram in grams_of(word):
            if known and len(gram) < length:
                break
            at = self.model.grams.get(gram)
            if at is not None:
                known.append(at)
                length = len(gram)
        if not known:
            return np.zeros(len(self.model.languages))
        return self.model.gram_scores[known].mean(axis=0)

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.model.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        words = words_of(text)
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        total = self.table[rows[rows >= 0]].sum(axis=0)
        for at in np.flatnonzero(rows < 0):
            total = total + self.unseen(words[at])
        shares = np.exp(total - total.max())
        best = int(shares.argmax())
        return self.model.languages[best], float(1 / shares.sum())


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Struct ``(lang_pred, score)`` for a text column of ``docs``.

    Null texts and texts without a letter give ``und`` and 0, as does a model without
    languages. Equal texts get equal results; ties go to the first language by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        # the scores hold the model, so its identity names them
        scores = C.worker_cache(("language", id(model)), lambda: Scores(model))
        for texts in batches:
            pairs = [scores.predict(t.as_py()) for t in texts]
            langs = pa.array([p[0] for p in pairs], pa.string())
            shares = pa.array([p[1] for p in pairs], pa.float64())
            yield pa.StructArray.from_arrays([langs, shares], names=["lang_pred", "score"])
        C.give_back()

    return F.arrow_udf(run, PREDICTED)(docs[text_col].cast("string"))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """True for ids whose crc32 (as text) leaves ``part`` modulo ``parts``; null ids never."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))
