"""Mixing sources to target weights.

Method: every document gets a hash-random key; documents are range-sorted by source and key;
a distributed prefix sum of their sizes runs over this order; each source is cut at its exact
budget, whole rounds over the source coming first when the budget exceeds it.

Plan: only (id, source, size, key) travels. The sorted rows are stored with the running sum
inside their partition; the totals of the partitions, one row each, give every partition its
start. A source with a third of all rows spans many partitions. Targets come from the table of
sources, also by range sort and prefix sum, so many sources need no single task either.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingloom.llm import common as C
from filingloom.runtime import durable

MAX_EPOCHS = 3
SEED = "mix-0"


def words_in(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(C.WORD_PATTERN)), F.lit(0)).cast("long")


def prefix_sums(df: DataFrame, order: list, values: dict[str, str], name: str) -> DataFrame:
    """``df`` range-sorted by ``order``, with the sum of each value over all earlier rows.

    ``values`` maps long columns to the names of their prefix sums.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("part", F.spark_partition_id())
    schema = T.StructType(
        [*ranged.schema.fields, *(T.StructField(out, T.LongType()) for out in values.values())]
    )
    stored = durable(ranged.mapInArrow(lambda batches: _running(batches, values), schema), name)
    totals = stored.groupBy("part").agg(*[F.sum(v).alias(f"{v}_total") for v in values])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition
    starts = totals.select(
        "part", *[F.coalesce(F.sum(f"{v}_total").over(earlier), F.lit(0)).alias(f"{v}_start") for v in values]
    )
    out = stored.join(F.broadcast(starts), "part")
    return out.select(
        *df.columns, *[(F.col(to) + F.col(f"{v}_start")).alias(to) for v, to in values.items()]
    )


def _running(batches, values: dict[str, str]):
    sums = dict.fromkeys(values, 0)
    for batch in batches:
        columns = list(batch.columns)
        for name in values:
            own = batch.column(name)
            until = pc.add(pc.cumulative_sum(own), pa.scalar(sums[name], pa.int64()))
            columns.append(pc.subtract(until, own))
            sums[name] += pc.sum(own).as_py() or 0
        names = [*batch.schema.names, *values.values()]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(source, source_size, source_start, target)`` from ``(source, source_size)``.

    Sources in code-point order, null last, weigh 1, 2, 3, repeating. The total is shared by
    weight; no target exceeds ``max_epochs`` times its source, what exceeds it is shared by
    weight among the others. With the sources sorted by size per weight those at their limit
    come first, and prefix sums tell where they end. ``source_start`` is the size of all
    sources before this one in code-point order.
    """
    by_name = F.col("source").asc_nulls_last()
    ranked = prefix_sums(
        sizes.withColumn("one", F.lit(1).cast("long")),
        [by_name],
        {"one": "rank", "source_size": "source_start"},
        "source-ranks",
    ).withColumn("weight", F.col("rank") % 3 + 1)
    swept = prefix_sums(
        ranked.select("source", "source_size", "source_start", "weight"),
        [F.col("source_size") / F.col("weight"), by_name],
        {"source_size": "size_before", "weight": "weight_before"},
        "source-sweep",
    )
    total = swept.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    if total["size"] is None:
        return ranked.select("source", "source_size", "source_start", F.lit(0.0).alias("target"))
    # the level per weight if just the sources before this one stand at their limit
    level = (F.lit(total["size"]) - max_epochs * F.col("size_before")) / (
        F.lit(total["weight"]) - F.col("weight_before")
    )
    limit = (max_epochs * F.col("source_size")).cast("double")
    below = level * F.col("weight") <= limit
    # the first source below its limit has the largest level of all that are below theirs
    final = swept.agg(F.max(F.when(below, level)).alias("level")).first()["level"]
    share = F.lit(final).cast("double") * F.col("weight")
    return swept.select(
        "source", "source_size", "source_start", F.least(share, limit).alias("target")
    )


def mix(
    docs: DataFrame,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``(doc_id, size, source, source_size, target, copies, taken)`` for every row.

    ``copies`` says how often the mix takes the document, ``taken = copies * size``. Every
    document of a source is taken as often as its target holds the whole source; the rest of
    the target goes to the first documents by key, the last of them if at least half of it
    fits. So a source misses its target by half a document at most. Null texts have size 0;
    they and empty texts are taken like others, with no words. Null sources are one source,
    the last; null ids share one key. Repeated rows are separate documents; ties of the key
    are broken by id and size, so reruns agree. An empty table gives no rows. Other columns
    are not looked at.
    """
    if max_epochs < 1:
        raise ValueError("max_epochs must be at least 1")
    seen = docs.select(
        docs[id_col].alias("doc_id"), docs[source_col].alias("source"), words_in(docs[text_col]).alias("size")
    )
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))
    seen = durable(seen.withColumn("key", key), "sizes")
    targets = source_targets(seen.groupBy("source").agg(F.sum("size").alias("source_size")), max_epochs)
    targets = durable(targets, "targets")
    order = [F.col("source").asc_nulls_last(), "key", F.col("doc_id").asc_nulls_last(), "size"]
    placed = prefix_sums(seen, order, {"size": "before"}, "documents-in-order")
    same = placed["source"].eqNullSafe(targets["source"])
    rounds = F.floor(F.col("target") / F.col("source_size"))
    rounds = F.when(F.col("source_size") > 0, F.least(rounds, F.lit(max_epochs))).otherwise(0)
    rest = F.col("target") - rounds * F.col("source_size")
    fits = (rest > 0) & (F.col("before") - F.col("source_start") + F.col("size") / 2 <= rest)
    copies = (rounds + F.when(fits, 1).otherwise(0)).cast("long")
    return (
        placed.join(targets, same)
        .select("doc_id", "size", targets["source"], "source_size", "target", copies.alias("copies"))
        .withColumn("taken", F.col("copies") * F.col("size"))
    )
