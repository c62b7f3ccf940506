"""Removal of passages that repeat an earlier document: exact substring deduplication.

Method: Rabin-Karp hashes of every window of ``size`` words are counted in Spark. A window
goes when the same words start in a document with a smaller id; the windows that go merge
into maximal intervals of words.

Plan: tasks hash the words of whole documents and send each distinct window of a batch once,
with the smallest document of the batch that has it (other documents of the batch are already
known to repeat it, so a passage that a third of all documents share costs one entry a batch).
Hash buckets find the smallest document of each window; what repeats goes to the document's
bucket, merges to intervals, and joins the documents again. Many buckets are reached in two
steps (``common.regrouped``). Windows are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingloom.llm import common as C

WINDOW_WORDS = 13

SENT = pa.schema(
    [
        ("bucket", pa.int32()),
        ("keys", pa.binary()),
        ("docs", pa.binary()),
        ("places", pa.binary()),
        ("gone_docs", pa.binary()),
        ("gone_places", pa.binary()),
    ]
)
GONE = pa.schema([("bucket", pa.int32()), ("gone_docs", pa.binary()), ("gone_places", pa.binary())])
SPANS = pa.schema(
    [
        ("span_doc", pa.int64()),
        ("starts", pa.list_(pa.int64())),
        ("ends", pa.list_(pa.int64())),
    ]
)
CUT = "struct<kept: string, n_words: bigint, n_removed: bigint>"


def repeated_spans(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``(span_doc, starts, ends)``: the word intervals [start, end) of each document to remove.

    Documents without any are left out.
    """
    narrow = docs.select(docs[id_col].cast("long").alias("d"), docs[text_col].alias("t"))
    n = C.buckets_for(narrow, "t")
    near = C.first_hop(n)
    sent = narrow.mapInArrow(lambda batches: _send(batches, size, near), C.ddl(SENT))
    sent = C.regrouped(sent, n, _resend, SENT)
    gone = sent.groupBy("bucket").applyInArrow(lambda part: _judge(part, near), C.ddl(GONE))
    gone = C.regrouped(gone, n, _regroup_gone, GONE)
    return gone.groupBy("bucket").applyInArrow(lambda part: _merge(part, size), C.ddl(SPANS))


def remove_repeats(
    docs: DataFrame, size: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with the columns ``kept``, ``n_words`` and ``n_removed`` (replaced if present).

    ``kept`` holds the words that stay, joined by one space. Every row stays. Null and
    empty texts have no words and give an empty ``kept``; texts shorter than ``size``
    words lose nothing. A null id counts as smaller than all others. Rows that share an id are one document:
    none makes the others' windows repeat, and equal rows get equal results; should their
    texts differ, each loses the positions found in any of them. Windows are compared by
    64-bit hashes.
    """
    if size < 1:
        raise ValueError("size must be at least 1")
    spans = repeated_spans(docs, size, id_col, text_col)
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    key = F.coalesce(docs[id_col].cast("long"), F.lit(C.NULL_ID)).alias("key")
    joined = docs.select(row, key).join(spans, F.col("key") == F.col("span_doc"), "left")
    cut = F.arrow_udf(_cut, CUT)
    out = joined.select("row", cut(F.col("row")[text_col], "starts", "ends").alias("cut"))
    extra = [c for c in docs.columns if c not in ("kept", "n_words", "n_removed")]
    return out.select(*[F.col("row")[c].alias(c) for c in extra], "cut.*")


def _by_doc(docs: np.ndarray, places: np.ndarray, n_buckets: int):
    """Rows of packed positions for the bucket of each document."""
    buckets = C.doc_bucket(docs, n_buckets)
    order = np.lexsort((places, docs, buckets))
    docs, places = docs[order], places[order]
    for bucket, at in C.cuts(buckets[order]):
        yield {
            "bucket": bucket,
            "gone_docs": C.pack(docs[at], rising=True),
            "gone_places": C.pack(places[at], rising=True),
        }


def _send(batches, size: int, n_buckets: int):
    for chunk in C.chunks(batches, "d", "t"):
        keys = C.windows(chunk.hashes, size)
        owner = C.owners(chunk.lengths)
        at = np.flatnonzero(owner[: len(keys)] == owner[size - 1 :]) if len(keys) else np.empty(0, np.int64)
        if not len(at):
            continue
        docs, places = chunk.ids[owner[at]], at - chunk.starts[owner[at]]
        yield _entries(keys[at], docs, places, n_buckets)


def _entries(keys, docs, places, n_buckets: int, gone_docs=(), gone_places=()) -> pa.RecordBatch:
    """Packed rows: the smallest document of each window, and the positions that repeat it."""
    order = np.argsort(keys)
    keys, docs, places = keys[order], docs[order], places[order]
    first = C.firsts(keys)
    least = np.minimum.reduceat(docs, first) if len(keys) else docs
    stays = docs == np.repeat(least, np.diff(first, append=len(keys)))
    gone_docs = np.concatenate([docs[~stays], np.asarray(gone_docs, np.int64)])
    gone_places = np.concatenate([places[~stays], np.asarray(gone_places, np.int64)])
    rows = list(_by_doc(gone_docs, gone_places, n_buckets))
    keys, docs, places = keys[stays], docs[stays], places[stays]
    for bucket, part in C.cuts(C.top_bits(keys, n_buckets)):
        rows.append(
            {
                "bucket": bucket,
                "keys": C.pack(keys[part], rising=True),
                "docs": C.pack(docs[part]),
                "places": C.pack(places[part].astype(np.uint32)),
            }
        )
    return C.rows_of(rows, SENT)


def _resend(batches, n_buckets: int):
    """Entries of a bucket's many senders, packed for the buckets inside it."""
    for part in C.held(batches, ("keys", "gone_docs")):
        places = C.column(part, "places", np.uint32).astype(np.int64)
        keys, docs = C.column(part, "keys", np.uint64, rising=True), C.column(part, "docs", np.int64)
        yield _entries(keys, docs, places, n_buckets, *_gone(part))
    C.give_back()


def _regroup_gone(batches, n_buckets: int):
    for part in C.held(batches, ("gone_docs", "gone_places")):
        yield C.rows_of(list(_by_doc(*_gone(part), n_buckets)), GONE)
    C.give_back()


def _gone(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(C.column(part, c, np.int64, rising=True) for c in ("gone_docs", "gone_places"))


def _judge(part: pa.Table, n_buckets: int) -> pa.Table:
    keys = C.column(part, "keys", np.uint64, rising=True)
    docs = C.column(part, "docs", np.int64)
    places = C.column(part, "places", np.uint32).astype(np.int64)
    if len(keys):
        order = np.argsort(keys)
        keys, docs, places = keys[order], docs[order], places[order]
        first = C.firsts(keys)
        least = np.minimum.reduceat(docs, first)
        gone = docs > np.repeat(least, np.diff(first, append=len(keys)))
        docs, places = docs[gone], places[gone]
    gone_docs, gone_places = _gone(part)
    docs, places = np.concatenate([docs, gone_docs]), np.concatenate([places, gone_places])
    out = pa.Table.from_pylist(list(_by_doc(docs, places, n_buckets)), schema=GONE)
    C.give_back()
    return out


def _merge(part: pa.Table, size: int) -> pa.Table:
    docs, places = _gone(part)
    order = np.lexsort((places, docs))
    docs, places = docs[order], places[order]
    apart = (np.diff(docs) != 0) | (np.diff(places) > size)
    first = np.concatenate([[0], np.flatnonzero(apart) + 1])
    last = np.concatenate([first[1:] - 1, [len(docs) - 1]])
    owner, count = np.unique(docs[first], return_counts=True)
    return pa.table(
        [
            pa.array(owner),
            C.lists(places[first], count),
            C.lists(places[last] + size, count),
        ],
        schema=SPANS,
    )


def _cut(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    kept, words, removed = [], [], []
    for text, low, high in zip(texts.cast(pa.binary()), starts, ends, strict=True):
        split = (text.as_py() or b"").split()
        words.append(len(split))
        # from the last interval, so that earlier positions stay right
        for a, b in zip(reversed(low.as_py() or []), reversed(high.as_py() or []), strict=True):
            del split[a:b]
        removed.append(words[-1] - len(split))
        kept.append(b" ".join(split))
    return pa.StructArray.from_arrays(
        [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(words, pa.int64()), pa.array(removed, pa.int64())],
        names=["kept", "n_words", "n_removed"],
    )
