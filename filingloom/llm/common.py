"""What the text operators share: words, word hashes, packed columns, stored tables.

Text operators hash words in Arrow batches and move hashes between tasks as packed
columns: sorted, delta coded, transposed to byte planes and compressed. A row per word
window would cost the shuffle four times as much.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

# A word is a maximal run of other characters than ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
# Words that are hashed together; bounds the memory of a task, not the data.
CHUNK_WORDS = 1 << 19
# Word hashes a task remembers.
CACHE_WORDS = 150_000
# Buckets that tasks write to at once, so that a packed column keeps some tens of values; more
# buckets are reached in two steps, and entries that are regrouped together between them.
HOP_BUCKETS = 1 << 13
HOP_VALUES = 1 << 20
# Odd multiplier of the rolling hash and of the final mixing (64-bit golden ratio).
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


# Stands for a null document id; it orders before every other id.
NULL_ID = -(2**63) + 1


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def buckets_for(df: DataFrame, text: str, per_bucket: int = 4 << 20) -> int:
    """Power of two: about ``per_bucket`` bytes of text to a bucket, a bucket for each partition.

    Buckets answer buckets, so their number is kept low: raise ``per_bucket`` with the memory
    of the executors.
    """
    size = df.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 1 << max(1, max(partitions, size // per_bucket) - 1).bit_length()


def regrouped(sent: DataFrame, n_buckets: int, split: Callable, schema: pa.Schema) -> DataFrame:
    """``sent`` by its final buckets.

    Tasks send to ``first_hop(n_buckets)`` buckets; where there are more, entries of one of those
    meet again here, and ``split`` packs them for the buckets inside it. A task streams through
    its rows, bucket by bucket. So the size of a packed column does not fall as the table grows.
    """
    if n_buckets <= HOP_BUCKETS:
        return sent
    parts = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = sent.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return near.mapInArrow(lambda batches: split(batches, n_buckets), ddl(schema))


def first_hop(n_buckets: int) -> int:
    return min(n_buckets, HOP_BUCKETS)


def held(batches, blobs: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows of some batches together: about ``HOP_VALUES`` values of eight bytes in ``blobs``."""
    kept, size = [], 0
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(b)) for b in blobs]
        for at in range(batch.num_rows):
            kept.append(batch.slice(at, 1))
            size += sum(zstandard.frame_content_size(c[at].as_py()) // 8 for c in columns if c[at].is_valid)
            if size >= HOP_VALUES:
                yield pa.Table.from_batches(kept)
                kept, size = [], 0
    if kept:
        yield pa.Table.from_batches(kept)


def small_batches(spark: SparkSession, size: int = 2 << 20) -> None:
    """Bound the bytes of text that a task hands to Python at once, unless the session's own
    bound is lower: beside the heap an executor has little memory for its workers."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(key).rstrip("b"))
    if not 0 < now <= size:
        spark.conf.set(key, str(size))


def unsigned(hash_: Column) -> Column:
    """63 bits of a hash, for draws by ``below``."""
    return F.shiftrightunsigned(hash_, 1)


def below(share: float) -> int:
    """The largest 63-bit hash that a draw of ``share`` of all hashes takes, however small it is."""
    return max(0, min(2**63 - 1, int(share * 2**63) - 1))


def ddl(schema: pa.Schema) -> StructType:
    return from_arrow_schema(schema)


_SLOT: dict = {}


def worker_cache(key, make: Callable[[], object]):
    """The one object that a Python worker keeps between its tasks; another key replaces it."""
    if _SLOT.get("key") != key:
        _SLOT.clear()
        _SLOT.update(key=key, value=make())
    return _SLOT["value"]


def give_back() -> None:
    """Return freed memory to the system at the end of a task: Arrow and the allocator keep it,
    and later tasks of the worker, or the other worker, may not need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class WordHashes(dict):
    """64-bit hash of a word (bytes), remembered for the first words seen."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


@dataclass
class Chunk:
    """Whole documents of one batch: ids, numbers of words, hashes of all words in order."""

    ids: np.ndarray
    lengths: np.ndarray
    hashes: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.lengths) - self.lengths


def chunks(batches, id_name: str, text_name: str, lower: bool = False) -> Iterator[Chunk]:
    """Hash the words of every text. Null texts have no words; null ids become ``NULL_ID``."""
    cache = worker_cache("word hashes", WordHashes)
    ids, parts, size = [], [], 0
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text_name)).cast(pa.binary())
        keys = batch.column(batch.schema.get_field_index(id_name))
        for key, text in zip(keys, texts, strict=True):
            raw = text.as_py() or b""
            hashed = cache.of((raw.lower() if lower else raw).split())
            ids.append(NULL_ID if key.as_py() is None else key.as_py())
            parts.append(hashed)
            size += len(hashed)
            if size >= CHUNK_WORDS or len(ids) >= CHUNK_WORDS // 8:
                yield _chunk(ids, parts)
                ids, parts, size = [], [], 0
    if ids:
        yield _chunk(ids, parts)
    give_back()


def _chunk(ids: list[int], parts: list[np.ndarray]) -> Chunk:
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    return Chunk(np.array(ids, np.int64), lengths, np.concatenate(parts))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread hashes evenly over all 64 bits."""
    values = (values ^ (values >> np.uint64(32))) * MIX
    return values ^ (values >> np.uint64(29))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash of each ``size`` consecutive words, modulo 2**64."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, size):
        out *= BASE
        out += hashes[i : i + n]
    return mixed(out)


def owners(lengths: np.ndarray) -> np.ndarray:
    """Index of the document that each word belongs to."""
    return np.repeat(np.arange(len(lengths)), lengths)


# One of each for a worker: a new one for every column costs memory and time.
_ZIP, _UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(values: np.ndarray, rising: bool = False) -> bytes:
    """Compressed byte planes; ``rising`` values are stored as differences."""
    if rising and len(values):
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return _ZIP.compress(planes.tobytes())


def unpack(data: bytes, kind, rising: bool = False) -> np.ndarray:
    kind = np.dtype(kind)
    raw = np.frombuffer(_UNZIP.decompress(data), np.uint8)
    values = np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if rising else values


def cuts(buckets: np.ndarray) -> Iterator[tuple[int, slice]]:
    """``(bucket, slice)`` of each run of equal values."""
    if len(buckets):
        at = np.flatnonzero(np.diff(buckets)) + 1
        for low, high in zip([0, *at], [*at, len(buckets)], strict=True):
            yield int(buckets[low]), slice(int(low), int(high))


def top_bits(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket of a key by its leading bits; ``n_buckets`` is a power of two."""
    return (keys >> np.uint64(65 - n_buckets.bit_length())).astype(np.int64)


def doc_bucket(ids: np.ndarray, n_buckets: int) -> np.ndarray:
    return top_bits(mixed(ids.astype(np.uint64) * BASE), n_buckets)


def rows_of(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def column(part: pa.Table, name: str, kind, rising: bool = False) -> np.ndarray:
    """All packed values of a column, one blob after the other."""
    found = [unpack(x, kind, rising) for x in part[name].to_pylist() if x is not None]
    return np.concatenate(found) if found else np.empty(0, kind)


def firsts(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    if not len(sorted_values):
        return np.empty(0, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1])


def each(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch, one in Python at a time."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """One list for each length, cut from ``values`` in order."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
