"""Packing tokenized documents into sequences of bounded length by best fit.

Method: hierarchical residual packing. Tasks tokenize their documents; the pieces, numbers only,
are spread by a hash and packed by best fit, longest first. Nearly full sequences are final. The others become items themselves:
they meet those of neighbouring tasks in a tree of best-fit rounds, each of which closes what
is nearly full and passes on the emptiest rest.

Only numbers travel after tokenizing. Two sequences of one best-fit run never fit together, so
at most one of them is half empty or less; passing on a bounded number of the emptiest loses
next to nothing, and no round of the tree ever holds more than ``fan_in * carry`` of them.
"""

from __future__ import annotations

import os
import zlib
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingloom.llm import common as C
from filingloom.runtime import durable

CAPACITY = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"
# Pieces packed in one run, and as many at least where there are enough; sequences passed on by
# a run, runs that meet in one of the next round.
RUN_PIECES = 1 << 18
LEAST_RUN = 1 << 13
CARRY = 256
FAN_IN = 8
# Pieces (and bytes of ids, where kept) that a task hands on together.
HELD_PIECES = 1 << 16
HELD_BYTES = 64 << 20
# Sequences at least this full are final.
NEARLY_FULL = 0.995
# Words and parts of words whose ids a worker remembers; bytes of text looked up together;
# new parts encoded together.
CACHE_WORDS = 450_000
TEXT_BYTES = 4 << 20
ENCODED_PARTS = 2_000
ASCII_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("ids", pa.list_(pa.int32())),
    ]
)
PLACED = pa.schema(
    [("rid", pa.int64()), ("part", pa.int64()), ("bin", pa.int64()), ("fill", pa.int64())]
    + [("place", pa.int64()), ("goes_on", pa.bool_())]
)
BINS = pa.schema(
    [("part", pa.int64()), ("bin", pa.int64()), ("fill", pa.int64()), ("final", pa.bool_())]
    + [("members", pa.list_(pa.struct([("member", pa.int64()), ("base", pa.int64())])))]
)


def _words(text: bytes) -> list[bytes]:
    return (text if b"<|" in text else text.lower()).split()


def _ends_in_letter(word: bytes) -> bool:
    """Of a word in lower case, where one letter can have become a letter and a mark."""
    return word[-1:].isalpha() if word[-1] < 128 else word.decode().lower()[-1].isalpha()


class WordTokens(dict):
    """Token ids (little-endian unsigned 32 bits) of words and parts of words, remembered.

    Words are runs without ASCII white space, at which this tokenizer always splits. Case of
    ASCII letters does not matter to it, so texts are put in lower case first. Marks after a
    letter are tokens of their own, so words with marks are put together from their parts, of
    which there are far fewer. New parts of many texts are encoded as one text and told apart
    by the places of their tokens. What may hold a special token is left to the tokenizer as
    it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.encode = Tokenizer.from_file(path).encode

    def of(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text. Texts are split once to learn their new words and once more for their
        ids, so the words of one text at a time are objects of Python."""
        if len(self) >= CACHE_WORDS:
            self.clear()
        new: set[bytes] = set()
        for text in texts:
            new.update(filterfalse(self.__contains__, _words(text)))
        self._learn(new)
        find = self.__getitem__
        return [b"".join(map(find, _words(text))) for text in texts]

    def _learn(self, words: set[bytes]) -> None:
        marked, parts = [], set()
        for word in words:
            stem = word.rstrip(ASCII_MARKS)
            if b"<|" in word:
                ids = self.encode(word.decode(), add_special_tokens=False).ids
                self[word] = np.array(ids, "<u4").tobytes()
            elif stem and len(stem) < len(word) and _ends_in_letter(stem):
                marks = word[len(stem) :]
                marked.append((word, stem, marks))
                parts.add(stem)
                parts.add(marks)
            else:
                parts.add(word)
        new = list(parts.difference(self))
        for at in range(0, len(new), ENCODED_PARTS):
            self._encode(new[at : at + ENCODED_PARTS])
        for word, stem, marks in marked:
            self[word] = self[stem] + self[marks]

    def _encode(self, new: list[bytes]) -> None:
        texts = [part.decode() for part in new]
        found = self.encode(" ".join(texts), add_special_tokens=False)
        starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        places = np.array([a for a, _ in found.offsets], np.int64)
        owner = np.searchsorted(starts, places, "right") - 1
        ends = 4 * np.cumsum(np.bincount(owner, minlength=len(texts)))
        ids = np.array(found.ids, "<u4").tobytes()
        low = 0
        for part, high in zip(new, ends.tolist(), strict=True):
            self[part] = ids[low:high]
            low = high


def _tokens(path: str | None) -> WordTokens:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    return C.worker_cache(("tokens", path), lambda: WordTokens(path))


def pack_documents(
    docs: DataFrame,
    capacity: int = CAPACITY,
    tokenizer: str | None = None,
    keep_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, with ``ids`` on request.

    A document is its token ids and a closing 0; a null or empty text is the 0 alone. Longer
    documents are cut into pieces of ``capacity``. Every row is packed: repeated rows, null
    ids and ties are separate documents. Other columns are not looked at. ``tokenizer`` is a
    file of the public word tokenizer's kind, found on every executor.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    narrow = docs.select(docs[id_col].cast("long").alias("d"), docs[text_col].cast("string").alias("t"))
    pieces = narrow.mapInArrow(lambda b: _pieces(b, capacity, tokenizer, keep_ids), C.ddl(PIECES))
    pieces = durable(pieces.withColumn("rid", F.monotonically_increasing_id()), "pieces")
    # only numbers move: every run sees the mix of lengths, however the texts are ordered
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(parts, -(-pieces.count() // LEAST_RUN)))
    spread = pieces.select("rid", "length").repartition(parts, F.xxhash64("rid"))
    placed = durable(spread.mapInArrow(lambda b: _runs(b, capacity), C.ddl(PLACED)), "placed-pieces")

    alone = F.array(F.struct(F.col("bin").alias("member"), F.lit(0).cast("long").alias("base")))
    level = placed.where("goes_on AND place = 0").select("part", "bin", "fill", alone.alias("members"))
    done = []
    runs_left = placed.agg(F.max("part")).first()[0] or 0
    while True:
        level = level.withColumn("part", F.floor(F.col("part") / FAN_IN))
        level = level.groupBy("part").applyInArrow(lambda p: _round(p, capacity), C.ddl(BINS))
        level = durable(level, "packing-round")
        runs_left //= FAN_IN
        done.append(level if not runs_left else level.where("final"))
        if not runs_left:
            break
        level = level.where("NOT final").drop("final")
    moved = done[0].select("bin", "members")
    for other in done[1:]:
        moved = moved.union(other.select("bin", "members"))
    moved = moved.select(F.col("bin").alias("sequence"), F.inline("members"))
    moved = moved.where("sequence <> member OR base <> 0")
    found = placed.join(moved, placed["bin"] == moved["member"], "left").select(
        "rid",
        F.coalesce("sequence", "bin").alias("sequence_id"),
        (F.col("place") + F.coalesce("base", F.lit(0))).alias("offset"),
    )
    if not keep_ids:
        pieces = pieces.drop("ids")
    out = pieces.join(found, "rid").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if keep_ids else [])
    )
    return out


def unfinished(fills: np.ndarray, capacity: int) -> np.ndarray:
    """Which sequences of a run go on: the emptiest, unless nearly full."""
    on = np.zeros(len(fills), bool)
    on[np.argsort(fills, kind="stable")[:CARRY]] = True
    return on & (fills < int(NEARLY_FULL * capacity))


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(bin of each item, its offset there, fill of each bin)``, longest items first.

    Bins lie in stacks by free space; the set bits of one number tell which stacks have any.
    """
    bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fills: list[int] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_spaces = 0
    for i in np.argsort(-lengths, kind="stable"):
        length = int(lengths[i])
        wide = open_spaces >> length
        if wide:
            space = length + (wide & -wide).bit_length() - 1
            found = stacks[space].pop()
            if not stacks[space]:
                open_spaces &= ~(1 << space)
        else:
            space, found = capacity, len(fills)
            fills.append(0)
        bins[i], places[i] = found, fills[found]
        fills[found] += length
        left = space - length
        if left:
            stacks[left].append(found)
            open_spaces |= 1 << left
    return bins, places, np.array(fills, np.int64)


def _encoded(batches, tokenizer: str | None):
    """``(doc_id, ids as bytes)`` of every row."""
    words = _tokens(tokenizer)
    docs, texts, size = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
            docs.append(doc.as_py())
            texts.append(text.as_py() or b"")
            size += len(texts[-1])
            if size >= TEXT_BYTES:
                yield from zip(docs, words.of(texts), strict=True)
                docs, texts, size = [], [], 0
    yield from zip(docs, words.of(texts), strict=True)


def _pieces(batches, capacity: int, tokenizer: str | None, keep_ids: bool):
    end = np.array([END_ID], "<u4").tobytes()
    held: list[tuple] = []
    kept_bytes = 0
    for doc, ids in _encoded(batches, tokenizer):
        ids += end
        for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
            own = ids[at : at + 4 * capacity]
            kept = np.frombuffer(own, "<i4") if keep_ids else None
            held.append((doc, piece, at // 4, len(own) // 4, zlib.crc32(own), kept))
        kept_bytes += len(ids) if keep_ids else 0
        if len(held) >= HELD_PIECES or kept_bytes >= HELD_BYTES:
            yield _batch(held, PIECES)
            held, kept_bytes = [], 0
    if held:
        yield _batch(held, PIECES)
    C.give_back()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _runs(batches, capacity: int):
    """Best fit of a task's pieces, in runs of bounded length."""
    held: list[pa.RecordBatch] = []
    run = 0
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= RUN_PIECES:
            yield _packed(held, capacity, run)
            held, run = [], run + 1
    if any(b.num_rows for b in held):
        yield _packed(held, capacity, run)


def _packed(held: list[pa.RecordBatch], capacity: int, run: int) -> pa.RecordBatch:
    part = TaskContext.get().partitionId()
    rids, lengths = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
    bins, places, fills = best_fit(lengths, capacity)
    # part, run and bin of the run make the name of a bin
    names = bins + (part << 36) + (run << 19)
    columns = [rids, np.full(len(rids), part), names, fills[bins], places, unfinished(fills, capacity)[bins]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PLACED, strict=True)], schema=PLACED)


def _round(part: pa.Table, capacity: int) -> pa.Table:
    """Best fit of unfinished sequences; the emptiest of the result stay unfinished."""
    rows = part.to_pylist()
    bins, places, fills = best_fit(np.array([r["fill"] for r in rows], np.int64), capacity)
    members: list[list] = [[] for _ in fills]
    for row, found, place in zip(rows, bins, places, strict=True):
        for m in row["members"]:
            members[found].append({"member": m["member"], "base": m["base"] + int(place)})
    on = unfinished(fills, capacity)
    out = [
        {
            "part": rows[0]["part"],
            "bin": min(m["member"] for m in own),
            "fill": int(fill),
            "final": not go,
            "members": own,
        }
        for own, fill, go in zip(members, fills, on, strict=True)
    ]
    return pa.Table.from_pylist(out, schema=BINS)
