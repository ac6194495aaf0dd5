"""Consolidating pairwise matches into groups (connected components of an edge list).

Rounds of rake and compress: vertices of degree one are stripped and remember the
neighbour they hung on; runs of degree-two vertices are cut at vertices whose hash is a
local minimum (a ruling set, so every run is short even on a long path or a pure circle)
and ranked by pointer doubling, the run becoming one edge between its ends. Rounds go on,
whatever the size, until there is no leaf and no run; what is left is the core, solved by
alternating star contractions. Labels then return to the removed vertices in reverse order of removal.
Every step is a join or a grouped minimum, which Spark combines before it shuffles; the
edges of a hub are never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch


def undirected(pairs: DataFrame, source: str, target: str) -> DataFrame:
    """Distinct edges (u < v); null ends and edges of a vertex to itself do not count."""
    return (
        pairs.select(F.col(source).alias("a"), F.col(target).alias("b"))
        .where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
        .distinct()
    )


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _strip(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """(edges without leaves, removed (vertex, parent), their number). Of an edge between two leaves the larger id goes."""
    sides = _both(edges).groupBy("u").agg(F.count("*").alias("deg"), F.min("v").alias("parent"))
    leaves = sides.where("deg = 1").select("u", "parent")
    other = leaves.select(F.col("u").alias("p"))
    gone, seen = scratch.counted(
        leaves.join(other, F.col("parent") == F.col("p"), "left")
        .where("p is null or u > parent")
        .select(F.col("u").alias("vertex"), "parent")
    )
    hit = gone.select(
        F.least("vertex", "parent").alias("u"), F.greatest("vertex", "parent").alias("v")
    )
    return scratch.cut(edges.join(hit, ["u", "v"], "left_anti")), gone, seen["n"]


def _compress(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """(edges with runs of degree-two vertices replaced, removed (vertex, parent), their number)."""
    mark = lambda c: F.xxhash64(F.lit("rule"), F.col(c))
    two = (
        _both(edges).groupBy("u")
        .agg(F.count("*").alias("deg"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        .where("deg = 2").select("u", "lo", "hi")
    )
    two = scratch.cut(two)
    inner = two.select(F.col("u").alias("k"))
    ends = two.select("u", F.explode(F.array("lo", "hi")).alias("w"))
    # a degree-two vertex stays as an end if its hash is below those of its degree-two neighbours
    near = ends.join(inner, F.col("w") == F.col("k")).groupBy("u").agg(F.min(F.struct(mark("w"), F.col("w"))).alias("least"))
    ruled = near.where(F.struct(mark("u"), F.col("u")) < F.col("least")).select("u")
    runs = scratch.cut(two.join(ruled, "u", "left_anti"))
    passable = runs.select(F.col("u").alias("k"))
    # darts run along a chain: (at, came from) -> next; rank counts steps to the end vertex
    darts = runs.select("u", F.explode(F.array(F.struct(F.col("lo").alias("b"), F.col("hi").alias("f")), F.struct(F.col("hi").alias("b"), F.col("lo").alias("f")))).alias("d")).select(
        "u", F.col("d.b").alias("back"), F.col("d.f").alias("to"), F.col("u").alias("via"), F.lit(1).cast("long").alias("rank")
    )
    open_darts = F.sum(F.when(F.col("done"), 0).otherwise(1))
    state, seen = scratch.counted(
        darts.join(passable, F.col("to") == F.col("k"), "left").select(*darts.columns, F.col("k").isNull().alias("done")), left=open_darts
    )
    while seen["left"]:
        target = state.select(
            F.col("u").alias("t_u"), F.col("back").alias("t_back"), F.col("to").alias("t_to"),
            F.col("via").alias("t_via"), F.col("rank").alias("t_rank"), F.col("done").alias("t_done"),
        )
        moved = (
            state.where("not done")
            .join(target, (F.col("to") == F.col("t_u")) & (F.col("via") == F.col("t_back")))
            .select(
                "u", "back", F.col("t_to").alias("to"), F.col("t_via").alias("via"),
                (F.col("rank") + F.col("t_rank")).alias("rank"), F.col("t_done").alias("done"),
            )
        )
        state, seen = scratch.counted(state.where("done").unionByName(moved), replaces=state, left=open_darts)
    ranked = state.groupBy("u").agg(
        F.min(F.struct("to", "rank")).alias("one"), F.max(F.struct("to", "rank")).alias("two")
    )
    gone, seen = scratch.counted(ranked.select(F.col("u").alias("vertex"), F.col("one.to").alias("parent"), F.col("two.to").alias("far")))
    removed = gone.select("vertex")
    kept = (
        edges.join(removed, edges.u == removed.vertex, "left_anti")
        .join(removed, F.col("v") == F.col("vertex"), "left_anti")
        .unionByName(
            gone.where("parent <> far").select(F.least("parent", "far").alias("u"), F.greatest("parent", "far").alias("v"))
        )
        .distinct()
    )
    scratch.drop(two, runs, state)
    return kept, gone.select("vertex", "parent"), seen["n"]


def _core(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(vertex, label) of the vertices of ``edges``, by alternating large and small stars."""
    vertices = _both(edges).select(F.col("u").alias("vertex")).distinct()
    before = None
    while True:
        around = _both(edges)
        low = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = around.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select(F.least("e.a", "e.b").alias("u"), F.greatest("e.a", "e.b").alias("v")).where("u <> v").distinct()
        )
        edges, now = scratch.counted(small, total=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        if now == before:
            break
        before = now
    stars = edges.groupBy("v").agg(F.min("u").alias("label"))
    return vertices.join(stars, F.col("vertex") == F.col("v"), "left").select(
        "vertex", F.coalesce("label", "vertex").alias("label")
    )


def connected_groups(pairs: DataFrame, source: str, target: str) -> DataFrame:
    """(vertex, group_id, links): every vertex with a partner, group_id the smallest id of its group.

    ``links`` is the vertex's number of distinct partners. Null ends and self links do not count,
    repeated and reversed pairs count once, further columns are ignored, an empty input gives an
    empty result.
    """
    scratch = Scratch(pairs.sparkSession, "components")
    all_edges, seen = scratch.counted(undirected(pairs, source, target))
    edges, removed = all_edges, []
    while seen["n"]:
        stripped, gone, leaves = _strip(edges, scratch)
        squeezed, over, inner = _compress(stripped, scratch)
        if not leaves + inner:
            break
        removed += [gone, over]
        edges, seen = scratch.counted(squeezed, replaces=None if edges is all_edges else edges)
        scratch.drop(stripped)
    labels = scratch.cut(_core(edges, scratch))
    for gone in reversed(removed):
        # a parent that kept no edge is the last of its group and labels itself
        known = labels.select(F.col("vertex").alias("k"), "label")
        below = gone.join(known, F.col("parent") == F.col("k"), "left").select(
            "vertex", "parent", F.coalesce("label", "parent").alias("label")
        )
        alone = below.join(known, F.col("parent") == F.col("k"), "left_anti").select(
            F.col("parent").alias("vertex"), F.col("parent").alias("label")
        ).distinct()
        labels = scratch.cut(
            labels.unionByName(below.select("vertex", "label")).unionByName(alone), replaces=labels
        )
    least = labels.groupBy("label").agg(F.min("vertex").alias("group_id"))
    degree = _both(all_edges).groupBy("u").agg(F.count("*").alias("links"))
    return (
        labels.join(least, "label")
        .join(degree, F.col("vertex") == F.col("u"))
        .select("vertex", "group_id", "links")
    )
