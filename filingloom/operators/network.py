"""Company similarity network: cosine edges above a threshold, and peer groups."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.functions import vectors as V
from filingloom.runtime import broadcast_if_small, durable, release

# Companies of one grid cell that meet in one task; larger cells are split.
CELL_LIMIT = 2_000
# Split cells are broadcast only up to this many rows (a few MB).
SPLIT_LIMIT = 100_000
GRID_DIMS = 3
# Below this threshold whole cells of connected companies are joined through one of them.
CONTRACT_BELOW = 0.9
# Links of a vertex from which on it is a hub, hubs that are sent to all tasks, and parts that
# the links of a hub are spread over otherwise.
HUB_LINKS = 100_000
HUB_LIMIT = 50_000
HUB_PARTS = 256
# Slack for rounding in the grid bound; the exact test follows anyway.
SLACK = 1e-6


def vertices(exposure: DataFrame) -> DataFrame:
    """Every company, also those without peers."""
    return exposure.select("ticker").distinct()


def similarity_edges(
    exposure: DataFrame,
    threshold: float = 0.75,
    cell_limit: int = CELL_LIMIT,
    apart: str | None = None,
) -> DataFrame:
    """``(src, dst, weight, width)`` for pairs ``src < dst`` with cosine above the threshold.

    Exact, without comparing all companies. On unit vectors a cosine above ``t``
    means a distance below ``sqrt(2 - 2t)``, hence also a difference below that in
    every coordinate. Companies are laid on a grid of that width over the widest
    coordinates and only meet those of neighbouring cells. Cells with very many
    companies are cut into blocks on both sides, so no key is one large task.
    With ``apart`` only pairs that differ in that column are made; its values come
    along as ``apart_src`` and ``apart_dst``.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must lie in 0..1")
    kept = F.col(apart) if apart else F.col("ticker")
    unit = exposure.select("ticker", V.unit("exposure").alias("u"), kept.alias("apart"))
    unit = unit.where(V.norm("u") > 0)
    unit = durable(unit, "unit-exposure")
    reach = math.sqrt(2 - 2 * threshold) + SLACK
    spans = (
        unit.select(F.posexplode("u").alias("dim", "x"))
        .groupBy("dim")
        .agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n"))
        .collect()
    )
    size = len(spans)
    wide = sorted(spans, key=lambda r: (r.low - r.high, r.dim))
    dims = [(r.dim, r.low) for r in wide[:GRID_DIMS] if r.high - r.low > reach]

    home = [
        F.floor((F.get("u", F.lit(d)) - F.lit(low)) / reach).cast("long") for d, low in dims
    ] or [_one_block().cast("long")]
    placed = unit.select("ticker", "u", "apart", F.array(*home).cast("array<bigint>").alias("cell"))
    around = placed.withColumn("cell", F.explode(_neighbours(F.col("cell"), len(dims))))
    if max((r.n for r in spans), default=0) > cell_limit:
        left, right = _blocked(placed, around, len(dims), cell_limit)
    else:
        left, right = (side.withColumn("block", _one_block()) for side in (placed, around))
    cosine = sum(
        (F.get("a.u", F.lit(i)) * F.get("b.u", F.lit(i)) for i in range(1, size)),
        F.get("a.u", F.lit(0)) * F.get("b.u", F.lit(0)),
    )
    meet = (
        (F.col("a.cell") == F.col("b.cell"))
        & (F.col("a.block") == F.col("b.block"))
        & (F.col("a.ticker") < F.col("b.ticker"))
        & (F.col("a.apart") != F.col("b.apart"))
        & (cosine > threshold)
    )
    ends = [F.col("a.apart").alias("apart_src"), F.col("b.apart").alias("apart_dst")]
    return (
        left.alias("a")
        .join(right.alias("b"), meet)
        .select(
            F.col("a.ticker").alias("src"),
            F.col("b.ticker").alias("dst"),
            cosine.alias("weight"),
            (cosine * 4).alias("width"),
            *(ends if apart else []),
        )
    )


def _one_block() -> Column:
    """Number 0 as a value of the row, for all companies in one cell or block. With a constant
    a low threshold would leave no key to join on."""
    return F.pmod(F.size("u"), F.lit(1))


def _neighbours(cell: Column, n_dims: int) -> Column:
    """The cell and those one step away in any of its coordinates."""
    if not n_dims:
        return F.array(cell)
    steps = itertools.product((-1, 0, 1), repeat=n_dims)
    return F.array(
        *[
            F.array(*[F.get(cell, F.lit(d)) + step for d, step in enumerate(move)]).cast(
                "array<bigint>"
            )
            for move in steps
        ]
    )


def _blocked(
    placed: DataFrame, around: DataFrame, n_dims: int, cell_limit: int
) -> tuple[DataFrame, DataFrame]:
    """Left side in its own cell, right side in all neighbouring ones, both with
    the block of the cell in which they meet.

    A cell with many companies gets a grid of blocks: left rows belong to one row
    of it, right rows to one column, and each pair meets in one block.
    """
    counts = placed.groupBy("cell").agg(F.count("*").alias("n_left"))
    visits = counts.select(
        F.explode(_neighbours(F.col("cell"), n_dims)).alias("cell"), "n_left"
    )
    visits = visits.groupBy("cell").agg(F.sum("n_left").alias("n_right"))
    splits = counts.join(visits, "cell").select(
        "cell",
        F.ceil(F.col("n_left") / cell_limit).cast("int").alias("rows"),
        F.ceil(F.col("n_right") / cell_limit).cast("int").alias("cols"),
    )
    splits = durable(splits.where("rows > 1 OR cols > 1"), "cell-splits")
    if splits.isEmpty():
        return placed.withColumn("block", _one_block()), around.withColumn("block", _one_block())
    splits = broadcast_if_small(splits, SPLIT_LIMIT)

    def cut(side: DataFrame, own: str, other: str, number) -> DataFrame:
        joined = side.join(splits, "cell", "left").fillna(1, ["rows", "cols"])
        mine = F.pmod(F.xxhash64("ticker"), F.col(own)).cast("int")
        return (
            joined.withColumn("mine", mine)
            .withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            .select("ticker", "u", "apart", "cell", number.alias("block"))
        )

    cols = F.col("cols")
    left = cut(placed, "rows", "cols", F.col("mine") * cols + F.col("theirs"))
    right = cut(around, "cols", "rows", F.col("theirs") * cols + F.col("mine"))
    return left, right


def similarity_classes(exposure: DataFrame, threshold: float = 0.75) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The links of ``similarity_edges`` in a form that stays small in crowded networks.

    ``(members, classes, pairs)``: ``(ticker, cell)``; ``(cell_a, cell_b)``, cells all of whose
    companies are linked with each other, a cell with itself included; and ``(src, dst,
    weight)`` for single links between other cells. Together exactly the links, each once.

    Cells are small cubes, each with its mean direction and the angle that holds all its
    members. By the triangle inequality on angles two cells are linked as wholes, not at all, or
    have to be opened; only companies of the last kind are compared. Companies without any
    exposure are in no cell and have no links.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")
    unit = exposure.select("ticker", V.unit("exposure").alias("u")).where(V.norm("exposure") > 0)
    unit = durable(unit, "unit-exposure")
    size = unit.select(F.max(F.size("u"))).first()[0] or 1
    reach = math.acos(threshold)
    # narrow enough for cells that have to be opened to lie less than a right angle apart
    side = min(reach / 4, (math.pi / 2 - reach) / 2.5) / math.sqrt(size)
    placed = unit.withColumn("cell", F.xxhash64(F.transform("u", lambda x: F.floor(x / F.lit(side)))))
    placed = durable(placed, "angular-cells")
    sums = [F.sum(F.get("u", F.lit(i))) for i in range(size)]
    centres = placed.groupBy("cell").agg(F.array(*sums).alias("s"), F.min("ticker").alias("lead"))
    centres = durable(centres.select("cell", "lead", V.unit("s").alias("c")), "cell-centres")
    off = placed.join(centres, "cell").groupBy("cell").agg(
        (F.max(_angle(V.dot("u", "c"))) + SLACK).alias("off"), F.count("*").alias("n")
    )
    centres = durable(centres.join(off, "cell"), "cell-angles")
    widest = centres.agg(F.max("off")).first()[0] or 0.0
    least = max(0.0, math.cos(min(math.pi / 2, reach + 2 * widest)) - SLACK)
    near = similarity_edges(centres.select(F.col("lead").alias("ticker"), F.col("c").alias("exposure")), least)
    ends = [
        centres.select(F.col("lead").alias(end), F.col("cell").alias(f"cell_{x}"), F.col("off").alias(f"off_{x}"))
        for x, end in (("a", "src"), ("b", "dst"))
    ]
    met = near.select("src", "dst", _angle(F.col("weight")).alias("apart")).join(ends[0], "src").join(ends[1], "dst")
    spread = F.col("off_a") + F.col("off_b")
    other = met.where(F.col("apart") - spread <= reach + SLACK).select(
        "cell_a", "cell_b", (F.col("apart") + spread + SLACK < reach).alias("whole")
    )
    own = centres.where("n > 1").select(
        F.col("cell").alias("cell_a"), F.col("cell").alias("cell_b"), (2 * F.col("off") + SLACK < reach).alias("whole")
    )
    kinds = durable(own.union(other), "cell-pairs")
    left, right = _members(placed, "a"), _members(placed, "b")
    cosine = V.dot("u_a", "u_b")
    opened = kinds.where("NOT whole").select("cell_a", "cell_b")
    pairs = opened.join(left, "cell_a").join(right, "cell_b").where(_once() & (cosine > threshold))
    pairs = pairs.select(
        F.least("t_a", "t_b").alias("src"), F.greatest("t_a", "t_b").alias("dst"), cosine.alias("weight")
    )
    return placed.select("ticker", "cell"), kinds.where("whole").select("cell_a", "cell_b"), pairs


def _members(placed: DataFrame, x: str) -> DataFrame:
    names = {"cell": f"cell_{x}", "ticker": f"t_{x}", "u": f"u_{x}"}
    return placed.select(*[F.col(c).alias(names[c]) for c in placed.columns if c in names])


def _once() -> Column:
    """Every pair of two cells, and each pair inside a cell once."""
    return (F.col("cell_a") != F.col("cell_b")) | (F.col("t_a") < F.col("t_b"))


def expand_classes(members: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(src, dst)`` of all links: as large as the network is dense."""
    whole = classes.join(_members(members, "a"), "cell_a").join(_members(members, "b"), "cell_b").where(_once())
    return whole.select(F.least("t_a", "t_b").alias("src"), F.greatest("t_a", "t_b").alias("dst")).union(
        pairs.select("src", "dst")
    )


def _angle(cosine: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(ticker, component)``; the component is named by its smallest member.

    Alternating star contraction: every vertex hands its larger neighbours, then
    its smaller ones, to its smallest neighbour. The number of rounds grows with
    the logarithm of the graph, also for long chains. Each round is stored, so
    its history is cut and lost executors cost one round.
    """
    links = (
        edges.where("src <> dst")
        .select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo"))
        .distinct()
    )
    links = _contracted(durable(links, "links"))
    while not _is_star(links):
        links = _contracted(links)
    return vertices.join(links.withColumnsRenamed({"hi": "ticker", "lo": "root"}), "ticker", "left").select(
        "ticker", F.coalesce("root", "ticker").alias("component")
    )


def _contracted(links: DataFrame) -> DataFrame:
    """One round over stored links, whose files are deleted."""
    if 2 * links.count() <= HUB_LINKS:  # no hub among so few
        small = durable(_small_star(_large_star(links, hubs=False), hubs=False), "links")
        release(links)
        return small
    large = durable(_large_star(links), "large-star")
    small = durable(_small_star(large), "links")
    release(links, large)
    return small


def exposure_components(exposure: DataFrame, threshold: float = 0.75) -> DataFrame:
    """``(ticker, component)`` straight from the exposures.

    Companies with the very same exposure are peers of each other, so one of them stands for
    all: a large group of copies adds one vertex instead of all its pairs. At low thresholds
    the same holds for all companies of a cell whose diagonal is as long as the threshold
    allows. Cells are joined through their leads first; then companies whose components still
    differ are compared, so the pairs inside a component are never made.
    """
    if threshold >= 1 - SLACK:
        return connected_components(vertices(exposure), similarity_edges(exposure, threshold))
    # an all-zero exposure resembles nobody, not even its copies
    alone = F.when(V.norm("exposure") == 0, F.col("ticker"))
    keyed = exposure.select("ticker", "exposure", alone.alias("alone"))
    wide = threshold < CONTRACT_BELOW
    if wide:
        side = F.lit(math.sqrt(2 - 2 * threshold) * (1 - SLACK)) / F.sqrt(F.size("exposure"))
        cell = F.transform(V.unit("exposure"), lambda x: F.floor(x / side))
        keyed = keyed.withColumn("cell", cell)
    else:
        keyed = keyed.withColumn("cell", F.col("exposure"))
    keyed = durable(keyed, "exposure-cells")
    groups = keyed.groupBy("cell", "alone").agg(
        F.min("ticker").alias("lead"), F.min_by("exposure", "ticker").alias("exposure")
    )
    groups = durable(groups, "exposure-groups")
    leads = groups.select(F.col("lead").alias("ticker"), "exposure")
    found = connected_components(leads.select("ticker"), similarity_edges(leads, threshold))
    same = (F.col("k.cell") == F.col("g.cell")) & F.col("k.alone").eqNullSafe(F.col("g.alone"))
    members = keyed.alias("k").join(groups.alias("g"), same).select("k.ticker", "k.exposure", "lead")
    named = members.join(found.withColumnRenamed("ticker", "lead"), "lead").select(
        "ticker", "exposure", "component"
    )
    if not wide:
        return named.select("ticker", "component")
    named = durable(named, "lead-components")
    roots = named.select(F.col("component").alias("ticker")).distinct()
    if roots.limit(2).count() < 2:
        return named.select("ticker", "component")
    rest = similarity_edges(named, threshold, apart="component").select("apart_src", "apart_dst")
    rest = rest.distinct().toDF("src", "dst")
    joined = connected_components(roots, rest).toDF("before", "component")
    return (
        named.select("ticker", F.col("component").alias("before"))
        .join(joined, "before")
        .select("ticker", "component")
    )


def _with_least(links: DataFrame, key: str, least: DataFrame, hubs: bool) -> DataFrame:
    """``links`` joined with ``(key, m, n)``, where ``n`` counts the links of the key.

    Links of hubs are not brought together: the few hubs are sent to their links, or, if there
    are too many for that, spread over parts by the other end.
    """
    if not hubs:
        return links.join(least.drop("n"), key)
    least = durable(least, "least-neighbours")
    large = least.where(F.col("n") > HUB_LINKS)
    if large.isEmpty():
        return links.join(least.drop("n"), key)
    other = next(c for c in links.columns if c != key)
    rest = least.where(F.col("n") <= HUB_LINKS).drop("n")
    if large.limit(HUB_LIMIT + 1).count() <= HUB_LIMIT:
        near = links.join(F.broadcast(large.drop("n")), key)  # its rows were counted
        return near.unionByName(links.join(rest, key))
    salt = F.pmod(F.xxhash64(other), F.lit(HUB_PARTS))
    parts = F.sequence(F.lit(0).cast("long"), F.lit(HUB_PARTS - 1).cast("long"))
    copies = large.drop("n").withColumn("salt", F.explode(parts))
    near = links.withColumn("salt", salt).join(copies, [key, "salt"]).drop("salt")
    return near.unionByName(links.join(rest, key))


def _large_star(links: DataFrame, hubs: bool = True) -> DataFrame:
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
        links.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
    return (
        _with_least(both, "u", least, hubs)
        .where("v > u")
        .select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        .distinct()
    )


def _small_star(links: DataFrame, hubs: bool = True) -> DataFrame:
    least = links.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n"))
    moved = (
        _with_least(links, "hi", least, hubs)
        .where("lo <> m")
        .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    )
    return moved.union(least.select("hi", F.col("m").alias("lo"))).distinct()


def _is_star(links: DataFrame) -> bool:
    """True when every vertex hangs on one root and no root hangs on another vertex."""
    ends = links.select(
        F.inline(
            F.array(
                F.struct(F.col("hi").alias("v"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")),
                F.struct(F.col("lo").alias("v"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")),
            )
        )
    )
    roles = ends.groupBy("v").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return roles.where("hangs > 1 OR (hangs = 1 AND holds = 1)").isEmpty()


def peer_groups(components: DataFrame) -> DataFrame:
    """``(component, size, ticker)`` for components of more than one company.

    One row per member: a component may hold a large part of all companies, so
    members are never gathered into one list.
    """
    sizes = (
        components.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    )
    sizes = broadcast_if_small(durable(sizes, "component-sizes"))
    return (
        components.join(sizes, "component")
        .select("component", "size", "ticker")
        .orderBy("component", "ticker")
    )
