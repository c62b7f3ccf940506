"""Near-duplicate embeddings of equal label by cosine: exact epsilon grid order join.

Method: on unit vectors a cosine of at least ``t`` is a distance of at most ``sqrt(2 - 2t)``.
Vectors are rotated to principal dimensions, laid on a grid of that width over the leading
ones and sorted by cell. The sorted sequence is cut into intervals; pairs of intervals whose
boxes are provably farther apart are skipped, the others are split and tested again, down to
small pieces that are multiplied out.

Plan: equal vectors collapse first, so thousands of copies are one. Intervals have two levels:
long ones are paired by label and distance of boxes, then their blocks; only block pairs that
may hold a link move vectors. A task halves its pair further. It returns link counts and one
edge per vector, never all links of a dense cluster.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.llm import common as C
from filingloom.operators.network import connected_components
from filingloom.runtime import durable

THRESHOLD = 0.93
# Leading principal dimensions of grid and boxes; vectors of a block; blocks of an interval.
GRID_DIMS = 6
BLOCK = 512
INTERVAL = 32
# Pieces of a block pair that are multiplied out.
LEAF = 64
SLACK = 1e-9

PREPARED = pa.schema(
    [("vec_id", pa.int64()), ("label", pa.string()), ("dim", pa.int64())]
    + [("hi", pa.int64()), ("node", pa.int64()), ("vector", pa.binary())]
)
MOMENTS = pa.schema([("place", pa.int64()), ("value", pa.float64())])
PLACED = pa.schema(
    [("label", pa.string()), ("dim", pa.int64()), ("node", pa.int64()), ("n", pa.int64())]
    + [("cells", pa.list_(pa.int32())), ("vector", pa.binary())]
)
BLOCKS = pa.schema(
    [("label", pa.string()), ("dim", pa.int64()), ("interval", pa.int64()), ("block", pa.int64())]
    + [("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]
    + [("nodes", pa.binary()), ("counts", pa.binary()), ("vectors", pa.binary())]
)
LINKS = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])


def link_vectors(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row.

    Vectors link when their labels are equal, their lengths are equal and their cosine in
    double precision is at least ``threshold``. Null labels, null, empty or zero vectors and
    vectors with a null or non-finite component link with nothing and are their own component.
    Repeated rows are separate vectors and link with each other; a null id counts as smaller
    than all others and comes back null. Other columns are not looked at.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie above 0 and at most at 1")
    rows = vectors.select(
        vectors[id_col].cast("long").alias("vec_id"),
        vectors[label_col].cast("string").alias("label"),
        vectors[vector_col].cast("array<double>").alias("vector"),
    )
    rows = durable(rows.mapInArrow(_prepare, C.ddl(PREPARED)), "vectors")
    valid = rows.where("vector IS NOT NULL")
    classes = valid.groupBy("hi", "node").agg(
        F.count("*").alias("n"), F.min(F.struct("label", "dim", "vector")).alias("v")
    )
    classes = durable(classes.select("node", "n", "v.*"), "vector-classes")
    links = durable(_links(classes, threshold), "vector-links")

    edges = links.where("node <> root").select(F.col("node").alias("src"), F.col("root").alias("dst"))
    nodes = classes.select(F.col("node").alias("ticker"))
    found = connected_components(nodes, edges).withColumnRenamed("ticker", "node")
    totals = links.groupBy("node").agg(F.sum("links").alias("links"))
    classes = classes.select("node", F.col("n") - 1).toDF("node", "copies")
    classes = classes.join(found, "node").join(totals, "node", "left")
    classes = classes.select(
        "node", "component", (F.col("copies") + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    named = durable(valid.select("vec_id", "node").join(classes, "node"), "vector-components")
    least = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    out = named.join(least, "component").select("vec_id", "n_links", "component_id")
    alone = rows.where("vector IS NULL").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    out = out.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
    return out.withColumn("vec_id", F.when(F.col("vec_id") != C.NULL_ID, F.col("vec_id")))


def _links(classes: DataFrame, threshold: float) -> DataFrame:
    """``(node, root, links)``: counts of linked vectors, and an edge for connectivity."""
    reach = 2 - 2 * threshold + SLACK
    axes = _axes(classes)
    placed = classes.mapInArrow(lambda b: _place(b, axes, reach**0.5), C.ddl(PLACED))
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["label", "dim", "cells", "node"]
    ranged = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    blocks = durable(ranged.mapInArrow(lambda b: _blocks(b, axes), C.ddl(BLOCKS)), "vector-blocks")

    boxes = blocks.select("label", "dim", "interval", "block", "low", "high")
    spans = boxes.groupBy("label", "dim", "interval").agg(
        F.array(*[F.min(F.get("low", F.lit(i))) for i in range(GRID_DIMS)]).alias("low"),
        F.array(*[F.max(F.get("high", F.lit(i))) for i in range(GRID_DIMS)]).alias("high"),
    )
    near = (_gap("a", "b") <= reach) & (F.col("a.interval") <= F.col("b.interval"))
    same = (F.col("a.label") == F.col("b.label")) & (F.col("a.dim") == F.col("b.dim"))
    spans = spans.alias("a").join(spans.alias("b"), same & near)
    spans = spans.select(F.col("a.interval").alias("left"), F.col("b.interval").alias("right"))
    near = (_gap("a", "b") <= reach) & (F.col("a.block") <= F.col("b.block"))
    pairs = (
        spans.join(boxes.alias("a"), F.col("a.interval") == F.col("left"))
        .join(boxes.alias("b"), (F.col("b.interval") == F.col("right")) & near)
        .select(F.col("a.block").alias("left"), F.col("b.block").alias("right"))
    )
    sides = [
        blocks.select(F.col("block").alias(side), F.struct("nodes", "counts", "vectors").alias(f"of_{side}"))
        for side in ("left", "right")
    ]
    met = pairs.join(sides[0], "left").join(sides[1], "right")
    met = met.select("of_left", "of_right", (F.col("left") == F.col("right")).alias("same"))
    return met.mapInArrow(lambda b: _join(b, axes, threshold, reach), C.ddl(LINKS))


def _gap(a: str, b: str) -> Column:
    """Squared distance of two boxes."""
    out = F.lit(0.0)
    for i in range(GRID_DIMS):
        over = F.get(f"{a}.low", F.lit(i)) - F.get(f"{b}.high", F.lit(i))
        under = F.get(f"{b}.low", F.lit(i)) - F.get(f"{a}.high", F.lit(i))
        gap = F.greatest(over, under, F.lit(0.0))
        out = out + gap * gap
    return out


def _axes(classes: DataFrame) -> np.ndarray:
    """Leading principal directions of all unit vectors, one column each.

    Only the second moments travel. Shorter vectors count as followed by zeros.
    """
    size = classes.agg(F.max("dim")).first()[0] or 1
    rows = (
        classes.select("vector").mapInArrow(lambda b: _moments(b, size), C.ddl(MOMENTS))
        .groupBy("place").agg(F.sum("value").alias("value")).collect()
    )  # size * size numbers, whatever the number of vectors
    matrix = np.zeros(size * size)
    matrix[[r["place"] for r in rows]] = [r["value"] for r in rows]
    directions = np.linalg.eigh(matrix.reshape(size, size))[1][:, ::-1][:, :GRID_DIMS]
    return np.pad(directions, ((0, 0), (0, GRID_DIMS - directions.shape[1])))


def _vector(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.float64)


def _units(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _prepare(batches):
    for batch in batches:
        rows = []
        for vec, label, value in zip(*batch.columns, strict=True):
            key = C.NULL_ID if vec.as_py() is None else vec.as_py()
            row = {"vec_id": key, "label": label.as_py()}
            if value.is_valid and label.is_valid and len(value.values):
                numbers = value.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                if np.isfinite(numbers).all() and numbers.any():
                    data = numbers.tobytes()
                    digest = xxhash.xxh3_128_intdigest(f"{row['label']}\0".encode() + data)
                    hi, lo = np.array([digest >> 64, digest & (2**64 - 1)], np.uint64).view(np.int64)
                    row |= {"dim": len(numbers), "hi": int(hi), "node": int(lo), "vector": data}
            rows.append(row)
        yield C.rows_of(rows, PREPARED)


def _matrix(data: list[bytes], size: int) -> np.ndarray:
    """Unit vectors, followed by zeros up to ``size``."""
    out = np.zeros((len(data), size))
    for i, x in enumerate(data):
        v = _vector(x)
        out[i, : len(v)] = v
    return _units(out)


def _moments(batches, size: int):
    total = np.zeros((size, size))
    for batch in batches:
        if batch.num_rows:
            units = _matrix(batch.column(0).to_pylist(), size)
            total += units.T @ units
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(total.ravel())], schema=MOMENTS)


def _place(batches, axes: np.ndarray, width: float):
    for batch in batches:
        if not batch.num_rows:
            continue
        row = batch.to_pydict()
        at = _matrix(row["vector"], len(axes)) @ axes
        cells = np.floor(at / width).astype(np.int32)
        lengths = np.full(len(cells), GRID_DIMS)
        columns = [row["label"], row["dim"], row["node"], row["n"], None, row["vector"]]
        columns = [pa.array(c, f.type) if c is not None else C.lists(cells.ravel(), lengths) for c, f in zip(columns, PLACED, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, schema=PLACED)


def _blocks(batches, axes: np.ndarray):
    from pyspark import TaskContext

    name = TaskContext.get().partitionId() << 32
    held: list[dict] = []
    n_blocks, interval, last = 0, name, None
    for batch in batches:
        for row in batch.to_pylist():
            group = (row["label"], row["dim"])
            if held and (group != last or len(held) == BLOCK):
                yield _block(held, axes, interval, name + n_blocks)
                held, n_blocks = [], n_blocks + 1
                if group != last or n_blocks - (interval - name) == INTERVAL:
                    interval = name + n_blocks
            held.append(row)
            last = group
    if held:
        yield _block(held, axes, interval, name + n_blocks)


def _block(held: list[dict], axes: np.ndarray, interval: int, block: int) -> pa.RecordBatch:
    at = _matrix([r["vector"] for r in held], len(axes)) @ axes
    row = {
        "label": held[0]["label"],
        "dim": held[0]["dim"],
        "interval": interval,
        "block": block,
        "low": at.min(axis=0).tolist(),
        "high": at.max(axis=0).tolist(),
        "nodes": C.pack(np.array([r["node"] for r in held], np.int64)),
        "counts": C.pack(np.array([r["n"] for r in held], np.int64)),
        "vectors": C.pack(np.concatenate([_vector(r["vector"]) for r in held])),
    }
    return C.rows_of([row], BLOCKS)


class Side:
    """Vectors of a block in grid order, with their places on the leading dimensions."""

    def __init__(self, row: dict, axes: np.ndarray):
        self.nodes = C.unpack(row["nodes"], np.int64)
        self.counts = C.unpack(row["counts"], np.int64)
        self.raw = C.unpack(row["vectors"], np.float64).reshape(len(self.nodes), -1)
        self.raw = self.raw / np.abs(self.raw).max(axis=1, keepdims=True)
        self.norms = np.sqrt((self.raw * self.raw).sum(axis=1))
        self.at = (self.raw / self.norms[:, None]) @ axes[: self.raw.shape[1]]


def _join(batches, axes: np.ndarray, threshold: float, reach: float):
    for batch in batches:
        for row in batch.to_pylist():
            left = Side(row["of_left"], axes)
            right = left if row["same"] else Side(row["of_right"], axes)
            hits: list[tuple[np.ndarray, np.ndarray]] = []
            _descend(left, right, (0, len(left.nodes)), (0, len(right.nodes)), threshold, reach, hits)
            if hits:
                yield _summary(left, right, row["same"], hits)


def _descend(left: Side, right: Side, a, b, threshold: float, reach: float, hits: list) -> None:
    """Compare interval ``a`` of the left with ``b`` of the right sequence."""
    if left is right and b[1] <= a[0]:
        return  # the mirror image of a pair that is compared
    x, y = left.at[a[0] : a[1]], right.at[b[0] : b[1]]
    gap = np.maximum(np.maximum(x.min(0) - y.max(0), y.min(0) - x.max(0)), 0)
    if (gap * gap).sum() > reach:
        return
    if max(a[1] - a[0], b[1] - b[0]) > LEAF:
        for low in _halves(a):
            for high in _halves(b):
                _descend(left, right, low, high, threshold, reach, hits)
        return
    dots = left.raw[a[0] : a[1]] @ right.raw[b[0] : b[1]].T
    cosine = dots / (left.norms[a[0] : a[1], None] * right.norms[None, b[0] : b[1]])
    i, j = np.nonzero(cosine >= threshold)
    i, j = i + a[0], j + b[0]
    if left is right:
        i, j = i[i < j], j[i < j]
    if len(i):
        hits.append((i, j))


def _halves(span: tuple[int, int]):
    low, high = span
    if high - low <= LEAF:
        return [span]
    return [(low, (low + high) // 2), ((low + high) // 2, high)]


def _summary(left: Side, right: Side, same: bool, hits: list) -> pa.RecordBatch:
    i, j = (np.concatenate(x) for x in zip(*hits, strict=True))
    shift = 0 if same else len(left.nodes)
    nodes = left.nodes if same else np.concatenate([left.nodes, right.nodes])
    j = j + shift
    counts = left.counts if same else np.concatenate([left.counts, right.counts])
    links = np.bincount(i, counts[j], len(nodes)) + np.bincount(j, counts[i], len(nodes))
    root = np.arange(len(nodes))
    while True:  # smallest linked place, until nothing changes
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    on = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays(
        [pa.array(nodes[on]), pa.array(nodes[root[on]]), pa.array(links[on].astype(np.int64))], schema=LINKS
    )
