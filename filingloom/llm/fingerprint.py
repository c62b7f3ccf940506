"""Document fingerprints that keep a fixed share of all shingle hashes.

Method: threshold-scaled sketch. Of the hashes of a document's shingles of five words all
below ``2**64 / scale`` stay. The union of two sketches is the sketch of the union, and as the
share is the same for short and long documents, the overlap of two sketches estimates both
Jaccard similarity and how much of the one the other contains.

DataFrame functions only: words are split and hashed once per text, shingles hash five word
hashes, and all of it happens inside the row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingloom.llm import common as C

SHINGLE_WORDS = 5
SCALE = 4
BLANKS = r"[\x20\x09-\x0D]+"
# Rows between two bounds of the document order.
ROWS_PER_RANGE = 500
MAX_RANGES = 4_096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sketch(text: Column, scale: int = SCALE, size: int = SHINGLE_WORDS) -> Column:
    """Sorted distinct hashes (bigint) of a text's shingles that lie below the threshold.

    A text of fewer words than ``size`` is one shingle; null, empty and blank texts have none.
    A text none of whose hashes lies below the threshold keeps its smallest one, so short texts
    have a fingerprint too; ``merged`` drops it where the other text has hashes below.
    """
    bound = -(2**63) + 2**64 // scale
    words = F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        return F.transform(
            F.slice(h, F.lit(1), F.greatest(F.size(h) - (size - 1), F.lit(0))),
            lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, size)]),
        )

    def of(h: Column) -> Column:
        whole = F.when(F.size(h) > 0, F.array(F.xxhash64(F.concat_ws(" ", h.cast("array<string>")))))
        return F.when(F.size(h) >= size, shingles(h)).otherwise(F.coalesce(whole, F.array().cast("array<bigint>")))

    def below(s: Column) -> Column:
        least = F.when(F.size(s) > 0, F.array(F.array_min(s))).otherwise(F.array().cast("array<bigint>"))
        return F.array_sort(F.array_distinct(F.concat(F.filter(s, lambda x: x < bound), least)))

    return let(let(hashes, of), below)


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Sketch of two documents together, the same as that of the union of their shingles."""
    bound = -(2**63) + 2**64 // scale

    def kept(both: Column) -> Column:
        low = F.filter(both, lambda x: x < bound)
        return F.when(F.size(low) > 0, low).otherwise(F.slice(both, 1, 1))

    return let(F.array_sort(F.array_union(a, b)), kept)


def jaccard(a: Column, b: Column) -> Column:
    """Estimated share of common shingles among all; 1 for two empty sketches."""
    common = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - common
    return F.when(total > 0, common / total).otherwise(F.lit(1.0))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has; 1 for an empty ``a``."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(1.0))


def as_text(hashes: Column) -> Column:
    """Fingerprint as text: hexadecimal hashes in order, joined by blanks."""
    return F.concat_ws(" ", F.transform(hashes, lambda x: F.hex(x)))


def with_next(docs: DataFrame, order: str, following: dict[str, str]) -> DataFrame:
    """Every row with columns of the next one by ``order``; the first row follows the last.

    ``following`` maps columns to the names of their copies. The order is cut at actual values
    of ``order`` into ranges; the first rows of each range are also sent to the range before
    it. So one shuffle suffices and no task holds more than a range. Null ids come first; rows
    of equal ids follow each other by a hash of their values.
    """
    key = F.coalesce(F.col(order).cast("long"), F.lit(C.NULL_ID))
    ids = docs.select(key.alias("k"))
    seen = ids.agg(F.count("*").alias("n"), F.min("k").alias("low")).first()
    if not seen["n"]:
        return docs.select("*", *[F.col(c).alias(to) for c, to in following.items()])
    ranges = max(1, min(MAX_RANGES, seen["n"] // ROWS_PER_RANGE))
    cuts = [i / ranges for i in range(1, ranges)] or [1.0]
    found = ids.agg(F.percentile_approx("k", cuts, 10_000).alias("q")).first()["q"]
    bounds = sorted({seen["low"], *(found if ranges > 1 else [])})
    # two short searches instead of one long one
    groups = [bounds[i : i + 64] for i in range(0, len(bounds), 64)]
    heads = F.array(*[F.lit(g[0]).cast("long") for g in groups])
    table = F.array(*[F.array(*[F.lit(b).cast("long") for b in g]) for g in groups])

    def place(k: Column) -> Column:
        group = F.size(F.filter(heads, lambda b: b <= k)) - 1
        return let(group, lambda g: g * 64 + F.size(F.filter(F.get(table, g), lambda b: b <= k)))

    last = len(bounds)
    at = F.when(F.col("range_") > 1, F.col("range_") - 1).otherwise(last)
    wraps = F.col("range_") == 1
    bound = F.get(F.flatten(table), F.col("range_") - 1)
    here = F.struct(F.col("range_").alias("home"), F.lit(False).alias("wraps"), F.lit(False).alias("guest"))
    there = F.struct(at.alias("home"), wraps.alias("wraps"), F.lit(True).alias("guest"))
    sent = docs.withColumn("key_", key).withColumn("range_", place(F.col("key_")))
    sent = sent.select(
        "*", F.explode(F.when(F.col("key_") == bound, F.array(here, there)).otherwise(F.array(here))).alias("to_")
    )
    in_order = Window.partitionBy("to_.home").orderBy(
        "to_.wraps", "key_", F.xxhash64(*[F.col(c) for c in docs.columns]), "to_.guest"
    )
    after = [F.lead(c).over(in_order).alias(to) for c, to in following.items()]
    return sent.select("to_", *docs.columns, *after).where("NOT to_.guest").drop("to_")


def fingerprints(docs: DataFrame, scale: int = SCALE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sketches of every document, of its edited text and of the next document.

    ``(doc_id, text, n_chars, hashes, edited, edited_hashes, next_hashes)``. Null texts count
    as empty. The edited text has its last ``n_chars // 2`` code points replaced by the first
    as many of the next document by id (the first follows the last; a single document follows
    itself). Rows of equal id come in the order of a hash of their text; equal rows are
    neighbours. An empty table gives no rows. Other columns are not looked at.
    """
    if scale < 1:
        raise ValueError("scale must be at least 1")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    own = docs.select(docs[id_col].alias("doc_id"), text.alias("text"))
    own = own.withColumn("hashes", sketch(F.col("text"), scale))
    own = with_next(own, "doc_id", {"text": "next_text", "hashes": "next_hashes"})
    own = own.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half),
        F.substring("next_text", F.lit(1), half),
    )
    out = own.withColumn("edited", edited).drop("next_text")
    return out.withColumn("edited_hashes", sketch(F.col("edited"), scale))
