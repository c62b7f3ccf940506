"""Repair of the turn structure of conversations by the cheapest edits.

A sound conversation is empty, or an optional system turn and then user and assistant in turn.
Rows are kept, get another role, are deleted, and empty turns are inserted. What may follow
depends on one of four states: nothing yet, after system, after user, after assistant.

Method: Hirschberg's divide and conquer. From the first row forwards and from the last row
backwards, vectors with a cost for each of the four states meet in the middle; the cheapest
state there is fixed, and both halves are solved alone. Only two vectors are held at a time, so
space is linear in the rows. Forward vectors also rank the states by their least audit text, so
of several cheapest crossings the one with the least audit is taken. Inserts belong to the row
after them; then no audit of one state begins another's of the same rows, and ranks decide.

Plan: narrow rows (no text) are range-sorted by conversation and turn, so a conversation of any
length spans many tasks. Rows lie in segments of bounded length. One segment is nearly always a
whole conversation and solved at once. Longer ones are summed up segment by segment (cost and
rank from each state to each state), combined in a tree of bounded nodes, and the crossings are
handed down the tree to the segments. Texts of kept rows join afterwards by their digest.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingloom.llm import common as C
from filingloom.runtime import durable

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = "sua"  # codes 0 to 2; any other initial is 3
SOUND, TRUNCATED, MUST_GO = range(3)
BLANK, DUPLICATE, CUT_OFF = "blank", "duplicate", "truncated"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
WHITE = " \t\n\x0b\x0c\r"
# Rows of a segment and children of a tree node, as powers of two.
SEGMENT_BITS = 12
NODE_BITS = 10
# Behind all rows of a conversation.
END = 1 << 62

MOVES = pa.list_(pa.struct([(x, pa.int64()) for x in ("enter", "leave", "cost", "rank")]))
SUMMARY = pa.schema([("c", pa.int64()), ("node", pa.int64()), ("moves", MOVES)])
CROSSING = pa.schema([("c", pa.int64()), ("node", pa.int64()), ("enter", pa.int32()), ("leave", pa.int32())])
EDITS = pa.schema(
    [("c", pa.int64()), ("at", pa.int64()), ("sub", pa.int32()), ("edit", pa.string()), ("fault", pa.string())]
    + [("turn", pa.int64()), ("initial", pa.int32()), ("role", pa.string()), ("digest", pa.binary())]
)
REPORT = pa.schema(
    [("c", pa.int64())]
    + [(x, pa.int64()) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string()), ("repaired_sha256", pa.string())]
)


# --- one conversation, or a part of one --------------------------------------


def following(state: int) -> int:
    """The state that an inserted or renamed turn leads to."""
    return ASSISTANT if state == USER else USER


@lru_cache(None)
def words(initial: int, kind: int) -> dict[tuple[int, int], tuple[int, str]]:
    """Cheapest ``(cost, edits)`` of one row from state to state: inserts, then the row's edit."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for enter in range(4):
        state, cost, before = enter, 0, ""
        for _ in range(3):  # after two inserts every state has been reached that can be
            options = [(state, DELETE_COST, DELETE)]
            if kind != MUST_GO:
                more = TRUNCATED_COST if kind == TRUNCATED else 0
                options.append((following(state), REROLE_COST + more, REROLE))
                if (initial == 0 and state == START) or initial + 1 == following(state):
                    options.append((initial + 1, more, KEEP))  # the state after its role
            for leave, price, edit in options:
                found = cost + price, before + edit
                best[enter, leave] = min(found, best.get((enter, leave), found))
            state, cost, before = following(state), cost + INSERT_COST, before + INSERT
    return best


@lru_cache(None)
def row_moves(initial: int, kind: int) -> tuple[tuple[int, int, int, int], ...]:
    """``(enter, leave, cost, rank)`` of one row; ranks order the edits from one state."""
    best = words(initial, kind)
    out = []
    for enter in range(4):
        order = sorted(word for (e, _), (_, word) in best.items() if e == enter)
        out += [(e, leave, cost, order.index(word)) for (e, leave), (cost, word) in best.items() if e == enter]
    return tuple(out)


# How a conversation may end in each state: ``(cost, inserts)``.
CLOSING = {START: (0, ""), SYSTEM: (2 * INSERT_COST, "II"), USER: (INSERT_COST, "I"), ASSISTANT: (0, "")}


def forwards(vector: dict, moves) -> dict:
    """``{state: (cost, rank of its least audit)}`` one item further."""
    found: dict = {}
    for enter, leave, cost, rank in moves:
        if enter in vector:
            before, place = vector[enter]
            option = before + cost, place, rank
            if leave not in found or option < found[leave]:
                found[leave] = option
    order = sorted((x[1], x[2], leave) for leave, x in found.items())
    return {leave: (found[leave][0], i) for i, (_, _, leave) in enumerate(order)}


def backwards(vector: dict, moves) -> dict:
    """``{state: cost to the end}`` one item earlier."""
    found: dict = {}
    for enter, leave, cost, _ in moves:
        if leave in vector:
            found[enter] = min(cost + vector[leave], found.get(enter, END))
    return found


def crossings(items: list, enter: int, leave: int) -> list[int]:
    """The states between the items on the cheapest way, of least audit, from ``enter`` to
    ``leave``; both included. Items are rows or whole segments, given by their moves."""
    states = [enter] + [leave] * len(items)
    parts = [(0, len(items))]
    while parts:
        low, high = parts.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        ahead = {states[low]: (0, 0)}
        for i in range(low, middle):
            ahead = forwards(ahead, items[i])
        behind = {states[high]: 0}
        for i in range(high - 1, middle - 1, -1):
            behind = backwards(behind, items[i])
        met = [(ahead[s][0] + behind[s], ahead[s][1], s) for s in ahead if s in behind]
        states[middle] = min(met)[2]
        parts += [(low, middle), (middle, high)]
    return states


def ending(items: list) -> int:
    """The state in which the cheapest repair of a whole conversation leaves its rows."""
    vector = {START: (0, 0)}
    for moves in items:
        vector = forwards(vector, moves)
    return min((cost + CLOSING[s][0], rank, s) for s, (cost, rank) in vector.items())[2]


def summed(items: list) -> list[tuple[int, int, int, int]]:
    """The moves of all items together."""
    out = []
    for enter in range(4):
        vector = {enter: (0, 0)}
        for moves in items:
            vector = forwards(vector, moves)
        out += [(enter, leave, cost, rank) for leave, (cost, rank) in vector.items()]
    return out


def repaired(codes: bytes, enter: int, leave: int | None) -> tuple[tuple[tuple[str, int], ...], int]:
    """``((edits, state before them) of each row, state after all)``; codes are ``3 * initial +
    kind``. Without a ``leave`` the rows are a whole conversation."""
    items = [row_moves(*divmod(code, 3)) for code in codes]
    if leave is None:
        leave = ending(items)
    states = crossings(items, enter, leave)
    rows = [
        (words(*divmod(code, 3))[a, b][1], a) for code, a, b in zip(codes, states, states[1:], strict=False)
    ]
    return tuple(rows), leave


# Short conversations have few forms.
remembered = lru_cache(20_000)(repaired)
SHORT = 16


# --- tables -------------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` with planted faults, decided by a checksum of the place.

    Null roles and texts become one space; for the checksum null ids and turns do as well.
    """
    space = F.lit(" ")
    place = F.concat_ws(":", *[F.coalesce(conversations[c].cast("string"), space) for c in ("conv_id", "turn")])
    rows = conversations.select(
        conversations["conv_id"],
        conversations["turn"],
        F.coalesce(conversations["role"].cast("string"), space).alias("role"),
        F.coalesce(conversations["text"].cast("string"), space).alias("text"),
        (F.crc32(place) % 20).alias("h"),
    ).where("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    rows = rows.withColumn("role", F.when(F.col("h") == 4, "user").otherwise(F.col("role")))
    copies = F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("copy", copies).select("conv_id", "turn", "role", "text")


def _keyed(conversations: DataFrame) -> DataFrame:
    space = F.lit(" ")
    rows = conversations.select(
        F.coalesce(conversations["conv_id"].cast("long"), F.lit(C.NULL_ID)).alias("c"),
        conversations["turn"].cast("long").alias("turn"),
        F.coalesce(conversations["role"].cast("string"), space).alias("role"),
        F.coalesce(conversations["text"].cast("string"), space).alias("text"),
    )
    digest = F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    return rows.withColumn("digest", digest)


def marked(conversations: DataFrame) -> DataFrame:
    """``(c, at, turn, digest, initial, fault)``: rows in order with their first fault, no text.

    ``at`` rises through each conversation: by turn (null first), role, then digest, so equal
    rows are neighbours.
    """
    tail = F.substring(F.rtrim(F.col("text"), F.lit(WHITE)), -1, 1)
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1)) - 1
    known = (F.length("role") > 0) & (initial >= 0)
    narrow = _keyed(conversations).select(
        "c",
        "turn",
        "role",
        "digest",
        F.when(known, initial).otherwise(3).cast("int").alias("initial"),
        (tail == "").alias("is_blank"),
        (~tail.isin(".", "!", "?")).alias("is_cut"),
        F.monotonically_increasing_id().alias("tie"),
    )
    order = [F.col("c"), F.asc_nulls_first("turn"), F.col("role"), F.col("digest"), F.col("tie")]
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = narrow.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered = durable(ranged.drop("role", "tie").withColumn("at", F.monotonically_increasing_id()), "turns")
    # map-side combined, and joined back by place: a text that very many rows have is no hot key
    firsts = ordered.where("NOT is_blank").groupBy("c", "digest").agg(F.min("at").alias("at"))
    seen = ordered.join(firsts.select("at", F.lit(True).alias("is_first")), "at", "left")
    fault = (
        F.when(F.col("is_blank"), BLANK)
        .when(F.col("is_first").isNull(), DUPLICATE)
        .when(F.col("is_cut"), CUT_OFF)
    )
    return seen.select("c", "at", "turn", "digest", "initial", fault.alias("fault"))


def _codes(rows: list[dict]) -> bytes:
    kinds = {None: SOUND, CUT_OFF: TRUNCATED, BLANK: MUST_GO, DUPLICATE: MUST_GO}
    return bytes(3 * r["initial"] + kinds[r["fault"]] for r in rows)


def _items(rows: list[dict]) -> list:
    return [row_moves(*divmod(code, 3)) for code in _codes(rows)]


def _tuples(moves: list[dict]) -> list[tuple[int, int, int, int]]:
    return [(m["enter"], m["leave"], m["cost"], m["rank"]) for m in moves]


def _dicts(moves) -> list[dict]:
    return [dict(zip(("enter", "leave", "cost", "rank"), m, strict=True)) for m in moves]


def _solve(batches):
    """Edits of segments; one without an exit is a whole conversation."""
    for batch in batches:
        out = []
        for segment in C.each(batch):
            rows, c = segment["rows"], segment["c"]
            solve = remembered if len(rows) <= SHORT else repaired
            edits, leave = solve(_codes(rows), segment["enter"], segment["leave"])
            for row, (word, state) in zip(rows, edits, strict=True):
                for sub, edit in enumerate(word):
                    if edit == INSERT:
                        state = following(state)
                        out.append((c, row["at"], sub, INSERT, None, None, None, ROLES[state], None))
                        continue
                    role = ROLES[following(state)] if edit == REROLE else None
                    out.append((c, row["at"], sub, edit, row["fault"], row["turn"], row["initial"], role, row["digest"]))
            if segment["leave"] is None:
                out += _closing_rows(c, leave)
        yield _batch(out, EDITS)


def _closing_rows(c: int, state: int) -> list[tuple]:
    out = []
    for sub in range(len(CLOSING[state][1])):
        state = following(state)
        out.append((c, END, sub, INSERT, None, None, None, ROLES[state], None))
    return out


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def _sum_segments(batches):
    for batch in batches:
        yield _batch([(s["c"], s["node"], _dicts(summed(_items(s["rows"])))) for s in C.each(batch)], SUMMARY)


def _in_order(part: pa.Table) -> list[dict]:
    return sorted(part.to_pylist(), key=lambda r: r["node"])


def _combine(part: pa.Table, node_bits: int) -> pa.Table:
    nodes = _in_order(part)
    moves = summed([_tuples(n["moves"]) for n in nodes])
    row = (nodes[0]["c"], nodes[0]["node"] >> node_bits, _dicts(moves))
    return pa.Table.from_batches([_batch([row], SUMMARY)])


def _top(batches):
    for batch in batches:
        rows = [(n["c"], n["node"], START, ending([_tuples(n["moves"])])) for n in C.each(batch)]
        yield _batch(rows, CROSSING)


def _hand_down(part: pa.Table) -> pa.Table:
    nodes = _in_order(part)
    states = crossings([_tuples(n["moves"]) for n in nodes], nodes[0]["enter"], nodes[0]["leave"])
    rows = [(n["c"], n["node"], a, b) for n, a, b in zip(nodes, states, states[1:], strict=False)]
    return pa.Table.from_batches([_batch(rows, CROSSING)])


def _close(batches):
    for batch in batches:
        out = []
        for row in C.each(batch):
            out += _closing_rows(row["c"], row["leave"])
        yield _batch(out, EDITS)


def _long_crossings(segments: DataFrame, node_bits: int) -> tuple[DataFrame, DataFrame]:
    """For conversations of several segments ``(c, node, enter, leave)`` of each segment, and of
    the whole: up the tree with sums, down again with crossings."""
    levels = [durable(segments.mapInArrow(_sum_segments, C.ddl(SUMMARY)), "segment-sums")]
    while not levels[-1].groupBy("c").count().where("count > 1").isEmpty():
        parent = F.shiftright("node", node_bits).alias("parent")
        up = levels[-1].groupBy("c", parent).applyInArrow(lambda p: _combine(p, node_bits), C.ddl(SUMMARY))
        levels.append(durable(up, "node-sums"))
    whole = durable(levels[-1].mapInArrow(_top, C.ddl(CROSSING)), "crossings")
    down = whole
    for level in reversed(levels[:-1]):
        parents = down.select("c", F.col("node").alias("parent"), "enter", "leave")
        nodes = level.withColumn("parent", F.shiftright("node", node_bits)).join(parents, ["c", "parent"])
        down = durable(nodes.groupBy("c", "parent").applyInArrow(_hand_down, C.ddl(CROSSING)), "crossings")
    return down, whole


def edits(rows: DataFrame, segment_bits: int = SEGMENT_BITS, node_bits: int = NODE_BITS) -> DataFrame:
    """The cheapest edits of ``marked`` rows, without texts: one row an edit (``EDITS``)."""
    node = F.shiftright("at", segment_bits).alias("node")
    members = F.sort_array(F.collect_list(F.struct("at", "turn", "initial", "fault", "digest"))).alias("rows")
    segments = durable(rows.groupBy("c", node).agg(members), "segments")
    several = durable(segments.groupBy("c").count().where("count > 1").select("c"), "long-conversations")
    state = [F.lit(START).alias("enter"), F.lit(None).cast("int").alias("leave")]
    if several.isEmpty():
        return segments.select("c", "rows", *state).mapInArrow(_solve, C.ddl(EDITS))
    long = durable(segments.join(several, "c", "left_semi"), "long-segments")
    of_segments, of_wholes = _long_crossings(long.select("c", "node", "rows"), node_bits)
    alone = segments.join(several, "c", "left_anti").select("c", "rows", *state)
    inside = long.join(of_segments, ["c", "node"]).select("c", "rows", "enter", "leave")
    solved = alone.union(inside).mapInArrow(_solve, C.ddl(EDITS))
    return solved.union(of_wholes.mapInArrow(_close, C.ddl(EDITS)))


def repair(conversations: DataFrame) -> DataFrame:
    """The cheapest edits, one a row: ``(conv_id, at, sub, edit, fault, turn, initial, role, text)``.

    ``at`` and ``sub`` order a conversation's edits. ``edit`` is K(eep), R(erole), D(elete) or
    I(nsert); kept rows have their role and text, renamed ones the new role, inserted ones an
    empty text, deleted ones neither. Blank rows and repeats of a role and text are always
    deleted. Of equally cheap repairs the one whose edits, read as text, come first is taken.

    Rows lie by turn, null turns first; rows of one turn by role and then by a digest of the
    text. Null roles and texts are one space, null ids one conversation. Other columns are not
    looked at, and an empty table gives no rows.
    """
    found = durable(edits(marked(conversations)), "edits")
    kept = found.where(F.col("edit").isin(KEEP, REROLE))
    # a kept row is the first of its text, so no text is wanted twice
    texts = _keyed(conversations).groupBy("c", "digest").agg(F.first("role").alias("own_role"), F.first("text").alias("text"))
    columns = ["c", "at", "sub", "edit", "fault", "turn", "initial"]
    kept = kept.join(texts, ["c", "digest"]).select(*columns, F.coalesce("role", "own_role").alias("role"), "text")
    inserted = F.when(F.col("edit") == INSERT, "").alias("text")
    others = found.where(~F.col("edit").isin(KEEP, REROLE)).select(*columns, "role", inserted)
    return kept.union(others).select(_given("c").alias("conv_id"), *columns[1:], "role", "text")


def _given(name: str):
    return F.when(F.col(name) != C.NULL_ID, F.col(name))


def _report(batches):
    """Sums up rows sorted by conversation, one row at a time whatever their number."""
    own, out = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if own is None or own.c != row["c"]:
                if own is not None:
                    out.append(own.row())
                own = _Summary(row["c"])
            own.add(row)
        yield _batch(out, REPORT)
        out = []
    if own is not None:
        yield _batch([own.row()], REPORT)


class _Summary:
    LEGAL = {(0, 1), (1, 2), (2, 1)}

    def __init__(self, c: int):
        self.c, self.audit, self.hash, self.any = c, [], hashlib.sha256(), False
        self.faults = dict.fromkeys((BLANK, DUPLICATE, CUT_OFF), 0)
        self.least = self.last = self.initial = None
        self.distinct = self.illegal = self.cost = 0

    def add(self, row: dict) -> None:
        edit, fault = row["edit"], row["fault"]
        self.audit.append(edit)
        self.cost += {KEEP: 0, REROLE: REROLE_COST, DELETE: DELETE_COST, INSERT: INSERT_COST}[edit]
        if edit != DELETE:
            self.cost += TRUNCATED_COST * (fault == CUT_OFF)
            self.hash.update(f"{chr(10) * self.any}{row['role']}:{row['text']}".encode())
            self.any = True
        if edit == INSERT:
            return
        if fault:
            self.faults[fault] += 1
        if self.initial is not None and (self.initial, row["initial"]) not in self.LEGAL:
            self.illegal += 1
        self.initial = row["initial"]
        turn = row["turn"]
        if turn is not None and turn != self.last:
            self.distinct += 1
            self.last = turn
            if self.least is None:
                self.least = turn

    def row(self) -> tuple:
        gaps = self.last - self.least + 1 - self.distinct if self.distinct else 0
        return self.c, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def report(repairs: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for every ``conv_id`` of ``conversations``: faults of its rows, cost, audit and
    digest of its repair.

    The digest of a whole conversation can only be taken in order, so its rows pass one task
    one after the other, sorted with spill and never held together; everything before this
    splits long conversations. Conversations without rows in ``repairs`` have zeros, an empty
    audit and the digest of an empty text.
    """
    key = F.coalesce(F.col("conv_id").cast("long"), F.lit(C.NULL_ID)).alias("c")
    rows = repairs.select(key, "at", "sub", "edit", "fault", "turn", "initial", "role", "text")
    lined_up = rows.repartition("c").sortWithinPartitions("c", "at", "sub")
    found = lined_up.mapInArrow(_report, C.ddl(REPORT))
    every = conversations.select(key).distinct()
    numbers = [c for c in REPORT.names if REPORT.field(c).type == pa.int64() and c != "c"]
    nothing = hashlib.sha256().hexdigest()
    return every.join(found, "c", "left").select(
        _given("c").alias("conv_id"),
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )
