"""Keys of rows: every row without an id is a document of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingloom.llm import common as C
from filingloom.runtime import broadcast_if_small, durable

# Spark numbers rows by partition and place in it.
PLACE_BITS = 33


def numbered(
    docs: DataFrame, key: str, repeats: bool = False
) -> tuple[DataFrame, int, DataFrame | None]:
    """``docs`` with a number for every null in the long column ``key``, how many there are, and
    ``(number, given)``, stored: what the numbered rows had as their key.

    The numbers are ``C.NULL_ID`` and those after it, below all other ids, nulls first, then in
    the order of a hash of the row. The rows that get one are stored, so they keep it in every later job;
    ``release`` deletes them. With ``repeats`` rows whose key others have as well get numbers
    too, so no key comes twice. Without such rows ``docs`` comes back as it is.
    """
    lone, given = docs.where(F.col(key).isNull()), docs.where(F.col(key).isNotNull())
    if repeats:
        many = durable(given.groupBy(key).count().where("count > 1").select(key), "repeated-ids")
        if not many.isEmpty():
            few = broadcast_if_small(many)
            lone = lone.unionByName(given.join(few, key, "left_semi"))
            given = given.join(few, key, "left_anti").select(docs.columns)
    n = lone.count()
    if not n:
        return docs, 0, None
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = lone.select(F.struct("*").alias("row"), F.col(key).isNotNull().alias("has"), F.xxhash64("*").alias("hash"))
    # equal rows may have any order among them
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(parts, "has", "hash", "tie").sortWithinPartitions("has", "hash", "tie")
    stored = durable(ranged.select("row", F.monotonically_increasing_id().alias("at")), "rows-without-id")
    part = F.shiftright("at", PLACE_BITS).alias("part")
    # one row for each partition
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored.groupBy(part).count().select("part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("start"))
    placed = stored.select("row", part, F.col("at").bitwiseAND((1 << PLACE_BITS) - 1).alias("place"))
    placed = placed.join(F.broadcast(starts), "part")
    number = (F.lit(C.NULL_ID) + F.col("start") + F.col("place")).cast("long")
    given_keys = durable(placed.select(number.alias("number"), F.col("row")[key].alias("given")), "given-ids")
    lone = placed.select(*[number.alias(c) if c == key else F.col("row")[c].alias(c) for c in docs.columns])
    out = given.union(lone)
    out._durable_path = stored._durable_path
    return out, n, given_keys
