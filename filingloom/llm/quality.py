"""Document quality by Bradley-Terry ranking.

Method: a labelled good document is preferred to a labelled bad one. Scores are linear in the
features of a document; the weights minimise the logistic loss on feature differences of
preference pairs. A quantile of the scores of the training rows is the threshold.

Features are shares of neighbouring character classes (letters after letters, marks after
marks, capitals after blanks, ...), repetition of words and lines, and length: no vocabulary,
so the model has a fixed size. It is fitted on a sample of labelled rows with a fixed expected
size (``sample_rows``); scoring reads every whole text in one narrow stage.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.llm import common as C
from filingloom.runtime import broadcast_if_small, durable

SAMPLE_ROWS = 20_000
PAIRS = 60_000
RIDGE = 1e-3
STEPS = 25
SEED = 11

# Character classes of UTF-8 bytes: 0 other control, then blank, line end, lower case, upper
# case, digit, sentence mark, quote or bracket, bar, other mark, first and further bytes of
# characters beyond ASCII.
CLASSES = 12


def _classes() -> np.ndarray:
    table = np.zeros(256, np.int64)
    groups = [b" \t", b"\r\n", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".,;:?'-", b"()[]{}\"", b"|"]
    table[33:127] = 9
    for number, group in enumerate(groups, 1):
        table[list(group)] = number
    table[0xC0:] = 10
    table[0x80:0xC0] = 11
    return table


CLASS_OF = _classes()
N_FEATURES = CLASSES * CLASSES + 6
FEATURES = pa.schema([("label", pa.int32()), ("features", pa.list_(pa.float64()))])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        margin = ((features - self.mean) / self.scale) @ self.weights - self.cut
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def features_of(text: str | None) -> np.ndarray:
    """Feature vector of a whole text; null counts as empty."""
    data = (text or "").encode()
    out = np.zeros(N_FEATURES)
    kinds = CLASS_OF[np.frombuffer(data, np.uint8)]
    if len(kinds) > 1:
        pairs = np.bincount(kinds[:-1] * CLASSES + kinds[1:], minlength=CLASSES * CLASSES)
        out[: CLASSES * CLASSES] = np.log1p(1000 * pairs / len(kinds))
    words = data.split()
    lines = [line for line in data.split(b"\n") if line]
    if words:
        n = len(words)
        out[-6] = np.log1p(n)
        out[-5] = len(set(words)) / n
        out[-4] = np.log1p(n) * out[-5]
        out[-3] = len(data) / n
        out[-2] = 1 - len(set(lines)) / max(1, len(lines))
        out[-1] = n / max(1, len(lines))
        out[-1] = np.log1p(out[-1])
    return out


def fit(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = SAMPLE_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> Model:
    """Fit on a hash sample of about ``sample_rows`` labelled documents.

    Labels are 1 (good) and 0 (bad); others and nulls are left out, repeated rows count as
    often as they occur. With labels of one kind only, every text scores as that kind.
    """
    marks = labels.select(labels[id_col].alias("k"), labels[label_col].cast("int").alias("label"))
    marks = marks.where("k IS NOT NULL AND label IN (0, 1)")
    share = sample_rows / max(1, marks.count())
    if share < 1:
        marks = marks.where(C.unsigned(F.xxhash64("k")) <= C.below(share))
    # the sample is sent to the texts, once its rows have been counted
    marks = broadcast_if_small(durable(marks, "sampled-labels"))
    texts = docs.select(docs[id_col].alias("k"), docs[text_col].cast("string").alias("t"))
    rows = marks.join(texts, "k").select("label", "t").mapInArrow(_featured, C.ddl(FEATURES))
    found = rows.collect()  # about sample_rows vectors
    y = np.array([r["label"] for r in found], int)
    x = np.array([r["features"] for r in found], float).reshape(len(found), N_FEATURES)
    order = np.lexsort((*x.T[:8], y))  # the model does not depend on the order of rows
    return rank(x[order], y[order])


def _featured(batches):
    for batch in batches:
        values = [features_of(t.as_py()) for t in batch.column(1)]
        flat = np.concatenate(values) if values else np.empty(0)
        vectors = C.lists(flat, np.full(len(values), N_FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), vectors], schema=FEATURES)


def rank(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS) -> Model:
    """Bradley-Terry weights from labelled vectors, and the cut at the best quantile."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    mean = x.mean(axis=0) if len(x) else np.zeros(N_FEATURES)
    scale = x.std(axis=0) if len(x) else np.ones(N_FEATURES)
    scale[scale < 1e-9] = 1
    if not len(good) or not len(bad):
        return Model(mean, scale, np.zeros(len(mean)), 1.0 if len(bad) else -1.0)
    z = (x - mean) / scale
    draw = np.random.default_rng(SEED)
    n = max(pairs, len(good), len(bad))
    # every row takes part about equally often
    left = np.resize(draw.permutation(good), pairs if len(good) <= pairs else n)
    right = draw.permutation(np.resize(bad, len(left)))
    gaps = z[left] - z[right]
    weights = np.zeros(z.shape[1])
    for _ in range(STEPS):  # Newton steps on the logistic loss of the differences
        p = 1 / (1 + np.exp(np.clip(gaps @ weights, -500, 500)))
        slope = gaps.T @ p / len(gaps) - RIDGE * weights
        bend = (gaps * (p * (1 - p))[:, None]).T @ gaps / len(gaps) + RIDGE * np.eye(len(weights))
        step = np.linalg.solve(bend, slope)
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    scores = z @ weights
    quantiles = np.linspace(0.005, 0.995, 199)
    cuts = np.quantile(scores, quantiles)
    right_good = (scores[good][None] >= cuts[:, None]).mean(axis=1)
    right_bad = (scores[bad][None] < cuts[:, None]).mean(axis=1)
    best = np.flatnonzero(right_good + right_bad >= (right_good + right_bad).max() - 1e-12)
    return Model(mean, scale, weights, float(np.median(cuts[best])))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Score 0 to 1 of each text; null and empty texts have the score of an empty text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        if not len(texts):
            return pa.array([], pa.float64())
        return pa.array(shared.value.scores(np.array([features_of(t.as_py()) for t in texts])))

    return F.arrow_udf(run, "double")(docs[text_col].cast("string"))
