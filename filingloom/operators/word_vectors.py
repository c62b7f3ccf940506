"""Word vectors by skip-gram with hierarchical softmax, trained by chunks of documents.

Words are hashes of 64 bits; each has a path in a Huffman tree, and the nodes are prefixes of
paths, so a task needs no more than the paths of its own words. Chunks of documents fetch these
(see ``chunks``), train for themselves and send back one row a word; a word's vectors are averaged,
weighted by how often they were moved, as Spark's trainer does with its partitions. The driver
holds how many words there are of each count, never words or vectors.

Inside a task some tokens at a time are trained together. A row that many of their pairs move is
moved as far as ``MOST_MOVES`` of them would, on average, so that frequent words and the upper
nodes of the tree do not overshoot.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type
from pyspark.sql.types import StructField, StructType

from filingloom.operators import chunks as CK
from filingloom.operators.vocabulary import numbered
from filingloom.runtime import durable, release

# Words on either side that a word is trained with at most (a random number for each), first rate.
WINDOW = 5
RATE = 0.025
# Tokens that are trained together, parts of them by length of path, pairs that move a row in full.
BATCH_TOKENS = 512
BLOCKS = 4
MOST_MOVES = 32
# Products beyond which a pair counts as learned.
EDGE = 6.0
# Tokens of a chunk at most, and of the runs it is trained in.
CHUNK_TOKENS = 16_000_000
# Numbers of a path's row: a whole number of up to 62 bits in two.
LOW_BITS = 31
SENT = from_arrow_schema(CK.SENT)


def words_by_depth(histogram: dict[int, int]) -> dict[int, int]:
    """How many words lie at each depth of a Huffman tree, from the number of words of each count.

    Equal nodes are paired together, so the work grows with the different counts.
    """
    heap = [(count, i, words) for i, (count, words) in enumerate(sorted(histogram.items()))]
    leaves, parents = len(heap), {}
    made = leaves
    heapq.heapify(heap)
    while len(heap) > 1 or heap[0][2] > 1:
        count, group, n = heapq.heappop(heap)
        if n > 1:
            # a parent for each two of the group
            parents[made] = [(group, 2)]
            heapq.heappush(heap, (2 * count, made, n // 2))
            if n % 2:
                heapq.heappush(heap, (count, group, 1))
        else:
            other, second, m = heapq.heappop(heap)
            parents[made] = [(group, 1), (second, 1)]
            heapq.heappush(heap, (count + other, made, 1))
            if m > 1:
                heapq.heappush(heap, (other, second, m - 1))
        made += 1
    depths: list[dict[int, int]] = [{} for _ in range(made)]
    depths[heap[0][1]] = {0: 1}
    for parent in range(made - 1, leaves - 1, -1):
        for child, each in parents[parent]:
            for depth, n in depths[parent].items():
                depths[child][depth + 1] = depths[child].get(depth + 1, 0) + each * n
    out: dict[int, int] = {}
    for own in depths[:leaves]:
        for depth, n in own.items():
            out[depth] = out.get(depth, 0) + n
    return out


def _path(rank: Column, by_depth: dict[int, int]) -> Column:
    """The path of the word of a rank by falling count: a leading 1, then its bits. More frequent
    words have shorter paths, and paths of one length are numbered in turn."""
    path, code, first, last = F.lit(None).cast("long"), 0, 0, 0
    for depth in sorted(by_depth):
        code <<= depth - last
        after = first + by_depth[depth]
        own = F.lit((1 << depth) + code - first).cast("long") + rank
        path = F.when((rank >= first) & (rank < after), own).otherwise(path)
        code, first, last = code + by_depth[depth], after, depth
    return path


def first_vectors(ids: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """Small random numbers by a hash of word and direction."""
    cells = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    cells = cells + np.arange(dim, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed)
    mixed = (cells ^ (cells >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (((mixed >> np.uint64(11)).astype(float) / 2.0**53 - 0.5) / dim).astype(np.float32)


def _summed(places: np.ndarray, values: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums by place, held back where many pairs meet; equal places lie side by side."""
    new = np.flatnonzero(np.diff(places, prepend=-1))
    pairs = np.add.reduceat(moves, new)
    sums = np.add.reduceat(values, new, axis=0)
    sums *= (MOST_MOVES / np.maximum(pairs, MOST_MOVES)).astype(np.float32)[:, None]
    return places[new], sums, pairs


class Trainer:
    """The words of a chunk: their vectors, and the nodes of the tree on their paths."""

    def __init__(self, vectors: np.ndarray, paths: np.ndarray):
        self.vectors, self.moves = vectors, np.zeros(len(paths), np.int64)
        self.depth = np.frexp(paths.astype(float))[1] - 1
        self.depth -= paths < np.int64(1) << self.depth  # rounded up to the next power
        # from left to right in the tree, shorter paths first
        self.order = paths << (62 - self.depth)
        deepest = int(self.depth.max(initial=0))
        self.node = np.zeros((deepest, len(paths)), np.int32)
        self.bit = np.zeros((deepest, len(paths)), np.float32)
        own = [np.flatnonzero(self.depth > d) for d in range(deepest)]
        prefixes = [paths[at] >> (self.depth[at] - d) for d, at in enumerate(own)]
        every = np.unique(np.concatenate([np.unique(p) for p in prefixes])) if own else paths[:0]
        for d, at in enumerate(own):
            self.node[d, at] = np.searchsorted(every, prefixes[d])
            self.bit[d, at] = 1 - (paths[at] >> (self.depth[at] - d - 1) & 1)
        self.inner = np.zeros((len(every), vectors.shape[1]), np.float32)

    def train(self, lengths: np.ndarray, local: np.ndarray, rng: np.random.Generator, done: float, share: float):
        """Train some documents; ``done`` of all work lies before them, ``share`` is theirs."""
        ends = np.repeat(np.cumsum(lengths), lengths)
        starts = ends - np.repeat(lengths, lengths)
        shifts = np.arange(-WINDOW, WINDOW + 1)
        padded = np.pad(local, WINDOW)
        for low in range(0, len(local), BATCH_TOKENS):
            at = np.arange(low, min(low + BATCH_TOKENS, len(local)))
            place = at[:, None] + shifts
            held = np.abs(shifts) <= rng.integers(1, WINDOW + 1, len(at))[:, None]
            held &= (shifts != 0) & (place >= starts[at][:, None]) & (place < ends[at][:, None])
            near = padded[low : low + len(at) + 2 * WINDOW]
            rate = RATE * max(1 - done - share * low / len(local), 1e-4)
            change = self._batch(self.vectors[near], local[at], held, np.float32(rate))
            moves = np.zeros(len(near), np.int64)
            for i, own in enumerate(held.T):
                moves[i : i + len(at)] += own
            by_word = np.argsort(near, kind="stable")
            words, sums, pairs = _summed(near[by_word], change[by_word], moves[by_word])
            self.vectors[words] += sums
            self.moves[words] += pairs

    def _batch(self, side: np.ndarray, words: np.ndarray, held: np.ndarray, rate: np.float32) -> np.ndarray:
        """Moves the nodes; returns how the vectors of the words around would move."""
        change, n = np.zeros_like(side), 2 * WINDOW + 1
        windows = np.lib.stride_tricks.sliding_window_view(side, n, axis=0)
        pairs = held.sum(axis=1)
        for own in np.array_split(np.argsort(self.order[words], kind="stable"), BLOCKS):
            deep = int(self.depth[words[own]].max(initial=0))
            if not deep:
                continue
            node, bit = self.node[:deep, words[own]], self.bit[:deep, words[own]]
            on = np.arange(deep)[:, None] < self.depth[words[own]]
            x = np.ascontiguousarray(windows[own].transpose(0, 2, 1))
            rows = self.inner.take(node.ravel(), axis=0).reshape(deep, len(own), -1).transpose(1, 0, 2)
            product = np.matmul(x, rows.transpose(0, 2, 1))
            step = bit.T[:, None, :] - 1 / (1 + np.exp(-np.maximum(product, -EDGE)))
            step *= held[own][:, :, None] & on.T[:, None, :] & (np.abs(product) < EDGE)
            step *= rate
            back = np.matmul(step, rows)
            for i in range(n):
                change[own + i] += back[:, i]
            # along each depth, words from left to right have equal nodes side by side
            out = np.matmul(step.transpose(0, 2, 1), x).transpose(1, 0, 2)[on]
            nodes, sums, _ = _summed(node[on], out, np.broadcast_to(pairs[own], on.shape)[on])
            self.inner[nodes] += sums
        return change


def _trained(docs: pa.Table, terms: pa.Table, dim: int, seed: int, parts: int) -> pa.Table:
    """A chunk's vectors by word, times their moves."""
    ids, values = CK.terms_of(terms, 2)
    own = Trainer(first_vectors(ids, dim, seed), (values[:, 0].astype(np.int64) << LOW_BITS) + values[:, 1].astype(np.int64))
    rng = np.random.default_rng((seed, docs["unit"][0].as_py()))
    share = 1 / docs.num_rows
    for i, (lengths, local, _) in enumerate(CK.runs(docs, ids)):
        # documents lie by length in a run: take them as they come
        order = rng.permutation(len(lengths))
        ends = np.cumsum(lengths)
        mixed = np.concatenate([np.arange(ends[d] - lengths[d], ends[d]) for d in order]) if len(local) else local
        own.train(lengths[order], local[mixed], rng, i * share, share)
    weights = own.moves[:, None].astype(float)
    return CK.sent(ids, np.concatenate([weights, weights * own.vectors], axis=1), parts)


def _means(docs: pa.Table, terms: pa.Table, dim: int, seed: int, schema: pa.Schema) -> pa.Table:
    """Unit mean of the vectors of a document's words."""
    ids, values = CK.terms_of(terms, 1 + dim)
    moved = values[:, :1] > 0
    vectors = np.where(moved, values[:, 1:] / np.maximum(values[:, :1], 1), first_vectors(ids, dim, seed))
    lengths, local, _ = CK.documents(docs, ids)
    out, held = np.zeros((len(lengths), dim)), np.flatnonzero(lengths)
    ends = np.concatenate([[0], np.cumsum(lengths[held])])
    for run in CK.cuts(lengths[held], CK.RUN_ENTRIES):
        at = slice(ends[run.start], ends[run.stop])
        out[held[run]] = np.add.reduceat(vectors.take(local[at], axis=0), ends[run] - ends[run.start], axis=0)
    size = np.sqrt((out * out).sum(axis=1, keepdims=True))
    unit = CK.rows(np.zeros(len(out), np.int64), out / np.where(size > 0, size, 1))["values"]
    return pa.table([*[docs[n] for n in schema.names[:-1]], unit], schema=schema)


def word2vec_vectors(
    tokens: DataFrame,
    dim: int = 100,
    seed: int = 42,
    partitions: int | None = None,
    min_count: int = 1,
) -> DataFrame:
    """Unit mean of word vectors trained on the corpus, for words seen ``min_count`` times.

    Every token is trained once with the words around it. There are ``partitions`` chunks, one for
    each core unless given, and more where they would hold over ``CHUNK_TOKENS``. Texts without a
    known word have zero vectors.
    """
    keep = [f for f in tokens.schema.fields if f.name != "tokens"]
    names = [f.name for f in keep]
    ids = F.coalesce(F.transform("tokens", lambda t: F.xxhash64(t)), F.array().cast("array<bigint>"))
    ones = F.transform("ids", lambda _: F.lit(1).cast("tinyint"))
    docs = durable(tokens.select(*names, ids.alias("ids"), F.monotonically_increasing_id().alias("row")), "word-ids")
    counts = docs.select(F.explode("ids").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    counts = durable(counts.where(F.col("df") >= min_count).withColumn("tf", F.col("df")), "word-counts")
    histogram = {r.df: r.n for r in counts.groupBy("df").agg(F.count("*").alias("n")).collect()}  # few counts differ
    if not histogram:
        raise ValueError("no word is seen often enough")
    path = _path(F.col("id").cast("long"), words_by_depth(histogram))
    paths = numbered(counts).select(F.col("token").alias("id"), path.alias("path"))
    halves = [F.shiftright("path", LOW_BITS).cast("double"), F.col("path").bitwiseAND((1 << LOW_BITS) - 1).cast("double")]
    paths = durable(paths.select("id", F.array(*halves).alias("values")), "word-paths")

    size = sum(count * words for count, words in histogram.items())
    parts = partitions or tokens.sparkSession.sparkContext.defaultParallelism
    chunks = parts * max(1, -(-size // (parts * CHUNK_TOKENS)))  # all cores have as many
    within = max(1, -(-size // (chunks * CK.RUN_ENTRIES)))
    inner = CK.chunk(chunks * within, "row")
    packed = CK.pack(docs.select(inner, "ids", ones.alias("counts")), within)
    needed = CK.needed_terms(packed, 1 + dim)
    back = needed.parts
    out = CK.meet(packed, paths, needed, 2, lambda d, t: _trained(d, t, dim, seed, back), SENT)
    vectors = durable(CK.added_up(out, 1 + dim), "word-vectors")
    release(packed, counts, paths)
    schema = StructType([*keep, StructField("embedding", CK.MODEL["values"].dataType)])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])
    outer = F.floor(inner / within).cast("int").alias("chunk")
    plain = docs.select(outer, *names, "ids", ones.alias("counts"))
    return CK.meet(plain, vectors, needed, 1 + dim, lambda d, t: _means(d, t, dim, seed, arrow), schema)
