"""Exact similarity join of documents on word shingles: who is reachable by links.

Method: token-group matrix. Similar documents lie in one group (they share the smallest
mixed shingle); a group stores the union of its tokens. How much of a query document the
union of another group covers bounds the similarity to each of its members, and only groups
above the bound are opened.

Plan, exact at every step:
1. Tasks hash all shingles of whole documents. Shingles that two documents of a batch share
   are known to be shared; the others travel once, packed, to hash buckets that tell whether
   another batch has them too. Per document remain its shared shingles. A document with too
   few of them for any link is done. A shingle that a third of all documents has costs one
   entry a batch.
2. Equal sets collapse to one class. Classes are range-sorted by their smallest mixed shingle
   and cut into bounded groups; links inside a group are tested there.
3. Group unions go through the same buckets: which tokens lie in several groups, and in how
   many. The bound over all other groups drops members; of the rest the rarest tokens
   (prefix filter) name the groups worth opening.
4. Each group is first opened against one popular partner, which joins large families of
   copies with a number of tests linear in their size; then all remaining pairs of groups
   whose members are not yet connected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingloom.llm import common as C
from filingloom.llm import keys as K
from filingloom.operators.network import connected_components
from filingloom.runtime import durable, release

SHINGLE_WORDS = 5
PERCENT = 80
# Shingles and documents of a group; bounds memory, larger families get several groups.
GROUP_TOKENS = 1 << 14
GROUP_DOCS = 256
SHARED = -(2**63)

META = ("meta_docs", "meta_n", "meta_hi", "meta_lo")
SENT = pa.schema(
    [("bucket", pa.int32())] + [(c, pa.binary()) for c in ("keys", "docs", "own_keys", "own_docs", *META)]
)
OWNED = pa.schema([f for f in SENT if f.name not in ("keys", "docs")])
SETS = pa.schema(
    [("doc", pa.int64()), ("n", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64())]
    + [("anchor", pa.int64()), ("tokens", pa.binary())]
)
MEMBERS = [(c, pa.binary()) for c in ("docs", "ns", "roots", "counts", "tokens")]
GROUPS = pa.schema(
    [("gid", pa.int64()), *MEMBERS, ("union", pa.binary())]
    + [("members", pa.list_(pa.struct([("doc", pa.int64()), ("root", pa.int64())])))]
)
UNIONS = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("gids", pa.binary())])
COMMON = pa.schema([("gid", pa.int64()), ("keys", pa.binary()), ("freqs", pa.binary())])
PREFIX = pa.struct([("token", pa.int64()), ("root", pa.int64()), ("freq", pa.int64())])
QUERIES = pa.schema([("gid", pa.int64()), *MEMBERS, ("prefix", pa.list_(PREFIX))])
EDGES = pa.schema([("src", pa.int64()), ("dst", pa.int64())])


def link_documents(
    docs: DataFrame,
    percent: int = PERCENT,
    size: int = SHINGLE_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs``.

    A document's set holds its distinct shingles of ``size`` words, ASCII letters in lower
    case; a shorter text is one shingle. Two documents link when the intersection has at
    least ``percent`` hundredths of the union. Null, empty and blank texts have an empty set
    and link with nothing. Every row with a null id is a document of its own, smaller than all
    others; its id comes back null, and components with such rows have numbers from
    ``C.NULL_ID`` on. Rows that share an id are documents of their own too, each with its own
    set; a component is named by the smallest id in it. Other columns are not looked at.
    """
    if not 0 < percent <= 100 or size < 1:
        raise ValueError("percent must lie in 1..100, size must be positive")
    narrow = docs.select(docs[id_col].cast("long").alias("d"), docs[text_col].alias("t"))
    n = C.buckets_for(narrow, "t")
    narrow, missing, given = K.numbered(narrow, "d", repeats=True)
    near = C.first_hop(n)
    sent = narrow.mapInArrow(lambda batches: _send(batches, size, near), C.ddl(SENT))
    sent = C.regrouped(sent, n, _resend, SENT)
    owned = sent.groupBy("bucket").applyInArrow(lambda part: _share(part, near), C.ddl(OWNED))
    owned = C.regrouped(owned, n, _reown, OWNED)
    sets = owned.groupBy("bucket").applyInArrow(lambda part: _assemble(part, percent), C.ddl(SETS))
    sets = durable(sets, "shingle-sets")
    if missing:
        release(narrow)

    full = sets.where("n > 0")
    best = F.min_by(F.struct("n", "anchor", "tokens"), "doc").alias("s")
    reps = full.where("tokens IS NOT NULL").groupBy("hi", "lo").agg(F.min("doc").alias("doc"), best)
    linked = _link_classes(reps.select("doc", "s.*"), percent, n)
    tokens, sets = sets, durable(sets.select("doc", "n", "hi", "lo"), "documents-of-sets")
    release(tokens)
    full = sets.where("n > 0")
    classes = full.groupBy("hi", "lo").agg(F.min("doc").alias("rep"))
    named = classes.join(linked, classes["rep"] == linked["doc"], "left").select(
        "hi", "lo", F.coalesce("component", "rep").alias("component")
    )
    out = full.select("doc", "n", "hi", "lo").join(named, ["hi", "lo"]).select("doc", "n", "component")
    out = out.union(sets.where("n = 0").select("doc", "n", F.col("doc").alias("component")))
    if given is not None:
        out = _named(out, given, missing)
    return out.select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")
    )


def _named(out: DataFrame, given: DataFrame, missing: int) -> DataFrame:
    """``(doc, n, component)`` with the ids that numbered rows had.

    A component that holds rows without an id keeps the smallest of their numbers.
    """
    has_number = F.col("doc") < C.NULL_ID + missing
    own = out.join(given, out["doc"] == given["number"], "left")
    own = own.withColumn("id", F.when(has_number, F.col("given")).otherwise(F.col("doc")))
    own = durable(own.select("doc", "id", "n", "component"), "documents-with-ids")
    odd = own.where(F.col("component") < C.NULL_ID + missing)
    names = odd.groupBy("component").agg(
        F.coalesce(F.min(F.when(F.col("id").isNull(), F.col("doc"))), F.min("id")).alias("name")
    )
    named = own.join(durable(names, "component-names"), "component", "left")
    return named.select(F.col("id").alias("doc"), "n", F.coalesce("name", "component").alias("component"))


def _link_classes(reps: DataFrame, percent: int, n_buckets: int) -> DataFrame:
    """``(doc, component)`` of the class representatives ``(doc, n, anchor, tokens)``."""
    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = reps.repartitionByRange(parts, "anchor", "doc").sortWithinPartitions("anchor", "doc")
    groups = durable(ranged.mapInArrow(lambda b: _group(b, percent), C.ddl(GROUPS)), "groups")
    near = C.first_hop(n_buckets)
    unions = groups.select("gid", "union").mapInArrow(lambda b: _send_unions(b, near), C.ddl(UNIONS))
    unions = C.regrouped(unions, n_buckets, _resend_unions, UNIONS)
    common = unions.groupBy("bucket").applyInArrow(_common, C.ddl(COMMON))
    queries = (
        groups.drop("union", "members")
        .groupBy("gid")
        .cogroup(common.groupBy("gid"))
        .applyInArrow(lambda a, b: _prefixes(a, b, percent), C.ddl(QUERIES))
    )
    queries = durable(queries, "group-queries")

    member = groups.select(F.inline("members"))
    prefix = queries.select("gid", F.inline("prefix"))
    hubs = prefix.groupBy("token").agg(F.min("gid").alias("hub"), F.max("gid").alias("last"))
    partner = (
        prefix.join(hubs.where("hub < last"), "token")
        .where("gid <> hub")
        .groupBy("gid")
        .agg(F.max_by("hub", F.struct("freq", "hub")).alias("hub"))
    )
    first = durable(partner.select(F.col("hub").alias("a"), F.col("gid").alias("b")), "first-pairs")
    edges = durable(_open(first, queries, percent), "first-links")
    roots = member.select(F.col("root").alias("ticker")).distinct()
    joined = durable(connected_components(roots, edges), "first-components")

    # per token and group the components, where the token still spans several
    spans = prefix.join(joined, prefix["root"] == joined["ticker"])
    spans = spans.groupBy("token", "gid").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    torn = spans.groupBy("token").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l < h")
    spans = durable(spans.join(torn, "token").select("token", "gid", "low", "high"), "torn")
    other = spans.toDF("token", "b", "other_low", "other_high")
    rest = (
        spans.withColumnRenamed("gid", "a")
        .join(other, "token")
        .where("a < b AND least(low, other_low) < greatest(high, other_high)")
        .select("a", "b")
        .distinct()
        .join(first, ["a", "b"], "left_anti")
    )
    more = _open(rest, queries, percent)
    both = durable(edges.union(more), "links")
    final = connected_components(roots, both)
    named = member.join(final, member["root"] == final["ticker"]).select("doc", "component")
    named = durable(named, "class-components")
    release(groups, queries, first, edges, joined, spans, both)
    return named


def _open(pairs: DataFrame, queries: DataFrame, percent: int) -> DataFrame:
    """Links found between the groups of each pair ``(a, b)``."""
    sides = [
        queries.select(F.col("gid").alias(side), F.struct(*[c for c, _ in MEMBERS]).alias(f"m{side}"))
        for side in ("a", "b")
    ]
    return (
        pairs.join(sides[0], "a").join(sides[1], "b").select("ma", "mb")
        .mapInArrow(lambda b: _compare(b, percent), C.ddl(EDGES))
    )


def _shingles(chunk: C.Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``(document index, shingle)``, sorted."""
    owner = C.owners(chunk.lengths)
    keys = C.windows(chunk.hashes, size)
    at = np.flatnonzero(owner[: len(keys)] == owner[size - 1 :]) if len(keys) else np.empty(0, np.int64)
    keys, docs = keys[at], owner[at]
    short = np.flatnonzero((chunk.lengths > 0) & (chunk.lengths < size))
    whole = [
        C.windows(chunk.hashes[s : s + m], m)[0] ^ C.mixed(np.array([m], np.uint64))[0]
        for s, m in zip(chunk.starts[short], chunk.lengths[short], strict=True)
    ]
    keys = np.concatenate([keys, np.array(whole, np.uint64)])
    docs = np.concatenate([docs, short])
    order = np.lexsort((keys, docs))
    keys, docs = keys[order], docs[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    return docs[new], keys[new]


def _owned(docs: np.ndarray, keys: np.ndarray, n_buckets: int):
    buckets = C.doc_bucket(docs, n_buckets)
    order = np.lexsort((keys, docs, buckets))
    docs, keys = docs[order], keys[order]
    for bucket, at in C.cuts(buckets[order]):
        yield {"bucket": bucket, "own_docs": C.pack(docs[at], True), "own_keys": C.pack(keys[at], True)}


def _send(batches, size: int, n_buckets: int):
    for chunk in C.chunks(batches, "d", "t", lower=True):
        owner, keys = _shingles(chunk, size)
        n = np.bincount(owner, minlength=len(chunk.ids))
        ends = np.cumsum(n)
        digest = [xxhash.xxh3_128_intdigest(keys[e - m : e].tobytes()) for e, m in zip(ends, n, strict=True)]
        hi = np.array([d >> 64 for d in digest], np.uint64)
        lo = np.array([d & (2**64 - 1) for d in digest], np.uint64)
        rows = list(_met(chunk.ids, n.astype(np.int64), hi, lo, n_buckets))
        # of equal sets in this batch one speaks for all
        lead = np.lexsort((chunk.ids, lo, hi))
        new = np.ones(len(lead), bool)
        new[1:] = (hi[lead][1:] != hi[lead][:-1]) | (lo[lead][1:] != lo[lead][:-1])
        speaks = np.zeros(len(lead), bool)
        speaks[lead[new]] = True
        taken = speaks[owner]
        docs, keys = chunk.ids[owner[taken]], keys[taken]
        rows.extend(_entries(docs, keys, n_buckets))
        yield C.rows_of(rows, SENT)


def _met(docs: np.ndarray, n: np.ndarray, hi: np.ndarray, lo: np.ndarray, n_buckets: int):
    """Packed rows of size and digest of documents."""
    buckets = C.doc_bucket(docs, n_buckets)
    order = np.argsort(buckets, kind="stable")
    for bucket, at in C.cuts(buckets[order]):
        own = order[at]
        columns = zip(META, (docs, n, hi, lo), strict=True)
        yield {"bucket": bucket} | {c: C.pack(values[own]) for c, values in columns}


def _entries(docs: np.ndarray, keys: np.ndarray, n_buckets: int):
    """Packed rows: shingles with their only document, or ``SHARED``, and who has the shared ones."""
    order = np.argsort(keys)
    docs, keys = docs[order], keys[order]
    first = C.firsts(keys)
    count = np.diff(first, append=len(keys))
    here = np.repeat(count > 1, count) & (docs != SHARED)
    yield from _owned(docs[here], keys[here], n_buckets)
    docs = np.where(count > 1, SHARED, docs[first]) if len(first) else docs
    keys = keys[first]
    for bucket, at in C.cuts(C.top_bits(keys, n_buckets)):
        yield {"bucket": bucket, "keys": C.pack(keys[at], True), "docs": C.pack(docs[at])}


def _resend(batches, n_buckets: int):
    """Entries of a bucket's many senders, packed for the buckets inside it."""
    for part in C.held(batches, ("keys", "own_keys", "meta_docs")):
        docs, keys = C.column(part, "docs", np.int64), C.column(part, "keys", np.uint64, True)
        rows = [*_entries(docs, keys, n_buckets), *_passed(part, n_buckets)]
        yield C.rows_of(rows, SENT)
    C.give_back()


def _reown(batches, n_buckets: int):
    for part in C.held(batches, ("own_docs", "own_keys", "meta_docs")):
        yield C.rows_of(list(_passed(part, n_buckets)), OWNED)
    C.give_back()


def _passed(part: pa.Table, n_buckets: int):
    """What goes to the documents' buckets as it is."""
    docs, keys = C.column(part, "own_docs", np.int64, True), C.column(part, "own_keys", np.uint64, True)
    yield from _owned(docs, keys, n_buckets)
    kinds = (np.int64, np.int64, np.uint64, np.uint64)
    yield from _met(*[C.column(part, c, k) for c, k in zip(META, kinds, strict=True)], n_buckets)


def _share(part: pa.Table, n_buckets: int) -> pa.Table:
    keys, docs = C.column(part, "keys", np.uint64, True), C.column(part, "docs", np.int64)
    order = np.argsort(keys)
    keys, docs = keys[order], docs[order]
    rows = []
    if len(keys):
        first = C.firsts(keys)
        several = np.minimum.reduceat(docs, first) < np.maximum.reduceat(docs, first)
        shared = np.repeat(several, np.diff(first, append=len(keys))) & (docs != SHARED)
        rows = list(_owned(docs[shared], keys[shared], n_buckets))
    passed = part.filter(part["keys"].is_null()).drop_columns(["keys", "docs"])
    out = pa.concat_tables([passed.cast(OWNED), pa.Table.from_pylist(rows, schema=OWNED)])
    C.give_back()
    return out


def _assemble(part: pa.Table, percent: int) -> pa.Table:
    """One row per document; tokens only where a link is possible."""
    docs, keys = C.column(part, "own_docs", np.int64, True), C.column(part, "own_keys", np.uint64, True)
    order = np.lexsort((keys, docs))
    docs, keys = docs[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    docs, keys = docs[new], keys[new]
    meta = C.column(part, "meta_docs", np.int64)
    n = C.column(part, "meta_n", np.int64)
    low, high = np.searchsorted(docs, meta, "left"), np.searchsorted(docs, meta, "right")
    rows = []
    for i in range(len(meta)):
        own = keys[low[i] : high[i]]
        enough = n[i] > 0 and 100 * len(own) >= percent * n[i]
        rows.append(
            (int(C.mixed(own).min().view(np.int64)), C.pack(own, True)) if enough else (None, None)
        )
    return pa.table(
        [
            pa.array(meta),
            pa.array(n),
            pa.array(C.column(part, "meta_hi", np.uint64).view(np.int64)),
            pa.array(C.column(part, "meta_lo", np.uint64).view(np.int64)),
            pa.array([a for a, _ in rows], pa.int64()),
            pa.array([t for _, t in rows], pa.binary()),
        ],
        schema=SETS,
    )


class Members:
    """Documents of a group with their sorted tokens."""

    def __init__(self, docs, ns, roots, counts, tokens):
        self.docs, self.ns, self.roots, self.counts, self.tokens = docs, ns, roots, counts, tokens
        self.ends = np.cumsum(counts)

    @classmethod
    def read(cls, row: dict) -> Members:
        kinds = (np.int64, np.int64, np.int64, np.int64, np.uint64)
        return cls(*[C.unpack(row[c], k) for (c, _), k in zip(MEMBERS, kinds, strict=True)])

    def packed(self) -> dict:
        return {c: C.pack(getattr(self, c)) for c, _ in MEMBERS}

    def of(self, i: int) -> np.ndarray:
        return self.tokens[self.ends[i] - self.counts[i] : self.ends[i]]

    def some(self, mask: np.ndarray) -> Members:
        taken = np.repeat(mask, self.counts)
        return Members(self.docs[mask], self.ns[mask], self.roots[mask], self.counts[mask], self.tokens[taken])

    def index(self) -> None:
        """The group's row of the matrix: its token union, with the members of each token."""
        order = np.argsort(self.tokens, kind="stable")
        sorted_tokens = self.tokens[order]
        self.owner = C.owners(self.counts)[order]
        first = C.firsts(sorted_tokens)
        self.union = sorted_tokens[first]
        self.ptr = np.append(first, len(sorted_tokens))

    def covered(self, tokens: np.ndarray) -> np.ndarray:
        """Places in the union of those ``tokens`` that it has."""
        at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        return at[self.union[at] == tokens]

    def overlaps(self, places: np.ndarray) -> np.ndarray:
        """Intersection with each member, given the covered places."""
        low = self.ptr[places]
        many = self.ptr[places + 1] - low
        at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.bincount(self.owner[at], minlength=len(self.docs))


def _meets(common, n, ns, percent: int):
    return common * (100 + percent) >= percent * (n + ns)


def _group(batches, percent: int):
    """Cut the sorted classes into groups and link the members of each."""
    held, size, anchor, out = [], 0, None, []
    for batch in batches:
        for row in C.each(batch):
            full = size >= GROUP_TOKENS or len(held) >= GROUP_DOCS
            if held and (full or row["anchor"] != anchor):
                out.append(_grouped(held, percent))
                held, size = [], 0
            tokens = C.unpack(row["tokens"], np.uint64, True)
            held.append((row["doc"], row["n"], tokens))
            size += len(tokens)
            anchor = row["anchor"]
            if len(out) >= 256:
                yield C.rows_of(out, GROUPS)
                out = []
    if held:
        out.append(_grouped(held, percent))
    if out:
        yield C.rows_of(out, GROUPS)


def _grouped(held: list, percent: int) -> dict:
    docs = np.array([d for d, _, _ in held], np.int64)
    counts = np.array([len(t) for _, _, t in held], np.int64)
    ns = np.array([n for _, n, _ in held], np.int64)
    group = Members(docs, ns, docs.copy(), counts, np.concatenate([t for _, _, t in held]))
    group.index()
    for i in range(len(docs) - 1):
        linked = np.flatnonzero(_meets(group.overlaps(group.covered(group.of(i))), ns[i], ns, percent))
        merged = np.unique(group.roots[np.append(linked, i)])
        if len(merged) > 1:
            group.roots[np.isin(group.roots, merged)] = merged[0]
    members = [{"doc": int(d), "root": int(r)} for d, r in zip(docs, group.roots, strict=True)]
    return {"gid": int(docs[0]), "union": C.pack(group.union), "members": members} | group.packed()


def _send_unions(batches, n_buckets: int):
    held, size = [], 0
    for batch in batches:
        for row in C.each(batch):
            union = C.unpack(row["union"], np.uint64)
            held.append((row["gid"], union))
            size += len(union)
            if size >= C.CHUNK_WORDS:
                yield _union_rows(held, n_buckets)
                held, size = [], 0
    if held:
        yield _union_rows(held, n_buckets)


def _union_rows(held: list, n_buckets: int) -> pa.RecordBatch:
    keys = np.concatenate([u for _, u in held])
    gids = np.repeat(np.array([g for g, _ in held], np.int64), [len(u) for _, u in held])
    return _unions(keys, gids, n_buckets)


def _unions(keys: np.ndarray, gids: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    order = np.argsort(keys)
    keys, gids = keys[order], gids[order]
    rows = [
        {"bucket": bucket, "keys": C.pack(keys[at], True), "gids": C.pack(gids[at])}
        for bucket, at in C.cuts(C.top_bits(keys, n_buckets))
    ]
    return C.rows_of(rows, UNIONS)


def _resend_unions(batches, n_buckets: int):
    for part in C.held(batches, ("keys",)):
        yield _unions(C.column(part, "keys", np.uint64, True), C.column(part, "gids", np.int64), n_buckets)


def _common(part: pa.Table) -> pa.Table:
    """Tokens of several groups, for each of these groups, with the number of groups."""
    keys, gids = C.column(part, "keys", np.uint64, True), C.column(part, "gids", np.int64)
    order = np.argsort(keys)
    keys, gids = keys[order], gids[order]
    freq = np.diff(C.firsts(keys), append=len(keys))
    freqs = np.repeat(freq, freq)
    keys, gids, freqs = keys[freqs > 1], gids[freqs > 1], freqs[freqs > 1]
    order = np.lexsort((keys, gids))
    keys, gids, freqs = keys[order], gids[order], freqs[order].astype(np.uint32)
    rows = [
        {"gid": gid, "keys": C.pack(keys[at], True), "freqs": C.pack(freqs[at])}
        for gid, at in C.cuts(gids)
    ]
    return pa.Table.from_pylist(rows, schema=COMMON)


def _prefixes(own: pa.Table, common: pa.Table, percent: int) -> pa.Table:
    """Members that may link with another group, their tokens there, and the rarest of these."""
    if not own.num_rows or not common.num_rows:
        return QUERIES.empty_table()
    keys = C.column(common, "keys", np.uint64, True)
    freqs = C.column(common, "freqs", np.uint32).astype(np.int64)
    order = np.argsort(keys)
    keys, freqs = keys[order], freqs[order]
    group = Members.read(own.drop_columns("gid").to_pylist()[0])
    at = np.minimum(np.searchsorted(keys, group.tokens), len(keys) - 1)
    found = keys[at] == group.tokens
    count = np.bincount(C.owners(group.counts)[found], minlength=len(group.docs))
    group = Members(group.docs, group.ns, group.roots, count.astype(np.int64), group.tokens[found])
    freq = freqs[at[found]]
    likely = 100 * count >= percent * group.ns
    freq = freq[np.repeat(likely, group.counts)]
    group = group.some(likely)
    if not len(group.docs):
        return QUERIES.empty_table()
    seen = set()
    for i in range(len(group.docs)):
        low, high = group.ends[i] - group.counts[i], group.ends[i]
        need = -(-percent * group.ns[i] // 100)
        # tokens that no other group has come first in the order and are in no other prefix
        length = max(0, group.counts[i] - need + 1)
        rare = low + np.lexsort((group.tokens[low:high], freq[low:high]))[:length]
        tokens = group.tokens[rare].view(np.int64)
        seen.update((int(t), int(group.roots[i]), int(f)) for t, f in zip(tokens, freq[rare], strict=True))
    prefix = [{"token": t, "root": r, "freq": f} for t, r, f in sorted(seen)]
    row = {"gid": own["gid"][0].as_py(), "prefix": prefix} | group.packed()
    return pa.Table.from_pylist([row], schema=QUERIES)


def _compare(batches, percent: int):
    for batch in batches:
        edges = set()
        for row in C.each(batch):
            left, right = Members.read(row["ma"]), Members.read(row["mb"])
            right.index()
            for i in range(len(left.docs)):
                query = left.of(i)
                places = right.covered(query)
                if 100 * len(places) < percent * left.ns[i]:
                    continue  # the group's union covers too little of the query
                linked = _meets(right.overlaps(places), left.ns[i], right.ns, percent)
                edges.update((int(left.roots[i]), int(r)) for r in np.unique(right.roots[linked]))
        both = list(zip(*edges, strict=True)) if edges else ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in both], schema=EDGES)
