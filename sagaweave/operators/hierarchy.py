"""Parent-child links to full hierarchies, with circles reported.

A fixed share of the nodes, chosen by a hash of the id, are splitters. Every node
walks up to its next splitter or root (pointer doubling, so the walk takes a
logarithmic number of joins); the splitters alone form a reduced pointer graph,
solved the same way; exact depths and paths then follow from two short pieces.
While pointers double, the number of unfinished nodes falls in every round unless
all of them hang on circles; that is how circles with and without splitters show.
They are solved apart: after enough doublings a pointer stands on the circle and
the smallest id seen from there is the circle's smallest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch

SPLITTER_SHARE = 4


def _splitter(col: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("splitter"), F.col(col)), F.lit(SPLITTER_SHARE)) == 0


def _double(state: DataFrame, scratch: Scratch, paths: bool) -> DataFrame:
    """Double pointers until every node stands on a terminal or the rest is circular.

    state: id, ptr, dist, seg_min, done [, seg]; done: ptr is a terminal (or null for roots).
    Returned rows with done false never reach a terminal.
    """
    active = state.where("not done").count()
    while active:
        # only unfinished pointers look their target up; the target may itself be finished or not
        target = state.select(
            F.col("id").alias("t_id"), F.col("ptr").alias("t_ptr"), F.col("dist").alias("t_dist"),
            F.col("seg_min").alias("t_min"), F.col("done").alias("t_done"),
            *([F.col("seg").alias("t_seg")] if paths else []),
        )
        moved = (
            state.where("not done")
            .join(target, F.col("ptr") == F.col("t_id"))
            .select(
                "id",
                F.col("t_ptr").alias("ptr"),
                (F.col("dist") + F.col("t_dist")).alias("dist"),
                F.least("seg_min", "t_min").alias("seg_min"),
                F.col("t_done").alias("done"),
                *([F.concat("seg", "t_seg").alias("seg")] if paths else []),
            )
        )
        state = scratch.cut(state.where("done").unionByName(moved), replaces=state)
        left = state.where("not done").count()
        if left == active:
            break
        active = left
    return state


def _circle_minimum(loops: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, circle_min) for nodes of a functional graph (id, ptr, seg_min) without any end."""
    n = loops.count()
    state, steps = loops, 1
    while steps <= n:
        target = state.select(F.col("id").alias("t_id"), F.col("ptr").alias("t_ptr"), F.col("seg_min").alias("t_min"))
        state = scratch.cut(
            state.join(target, F.col("ptr") == F.col("t_id")).select(
                "id", F.col("t_ptr").alias("ptr"), F.least("seg_min", "t_min").alias("seg_min")
            ),
            replaces=state,
        )
        steps *= 2
    on_circle = state.select(F.col("id").alias("c_id"), F.col("seg_min").alias("circle_min"))
    return state.join(on_circle, F.col("ptr") == F.col("c_id")).select("id", "circle_min")


def resolve_hierarchy(links: DataFrame, id_col: str, parent_col: str, paths: bool = False) -> DataFrame:
    """(node_id, root_id, depth [, path]) for each distinct node.

    A root (no parent, or a parent that is no node) has depth 0. Nodes on a circle, or whose
    ancestors lead into one, get the circle's smallest id as root and depth -1 (path null).
    A node that is its own parent is a circle of one. Rows without id do not count; of repeated
    ids with different parents the smallest parent counts; further columns are ignored. ``path``
    runs from the root to the node.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "hierarchy")
    nodes = (
        links.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"))
        .where("id is not null")
        .groupBy("id")
        .agg(F.min("parent").alias("parent"))
    )
    known = nodes.select(F.col("id").alias("k"))
    nodes = nodes.join(known, F.col("parent") == F.col("k"), "left").select("id", F.col("k").alias("parent"))
    first = nodes.select(
        "id",
        F.col("parent").alias("ptr"),
        F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("dist"),
        F.col("id").alias("seg_min"),
        *([F.array("id").alias("seg")] if paths else []),
    )
    roots = first.where("ptr is null").select(F.col("id").alias("r"))
    first = first.join(roots, F.col("ptr") == F.col("r"), "left").select(
        *first.columns,
        (F.col("ptr").isNull() | F.col("r").isNotNull() | _splitter("ptr")).alias("done"),
    )
    walked = _double(scratch.cut(first), scratch, paths)

    # the reduced graph: splitters (terminals that are no roots) and where they point
    reduced = walked.where(_splitter("id") & F.col("done") & F.col("ptr").isNotNull())
    # a splitter whose own walk never ended hangs on a circle without splitters and is an end here
    ends = walked.where("ptr is null or not done").select(F.col("id").alias("r"))
    reduced = reduced.drop("done").join(ends, F.col("ptr") == F.col("r"), "left").select(
        *[c for c in walked.columns if c != "done"], F.col("r").isNotNull().alias("done")
    )
    solved = _double(scratch.cut(reduced), scratch, paths)

    loose = (
        solved.where("not done").select("id")
        .join(reduced.select("id", "ptr", "seg_min"), "id")
        .unionByName(first.join(walked.where("not done").select("id"), "id", "left_semi").select("id", "ptr", "seg_min"))
    )
    circles = scratch.cut(_circle_minimum(scratch.cut(loose), scratch))

    top = solved.where("done").select(
        F.col("id").alias("s_id"), F.col("ptr").alias("s_root"), F.col("dist").alias("s_dist"),
        *([F.col("seg").alias("s_seg")] if paths else []),
    )
    via = circles.select(F.col("id").alias("c_id"), F.col("circle_min"))
    own = via.select(F.col("c_id").alias("o_id"), F.col("circle_min").alias("o_min"))
    whole = (
        walked.join(top, F.col("ptr") == F.col("s_id"), "left")
        .join(via, F.coalesce("s_root", "ptr") == F.col("c_id"), "left")
        .join(own, F.col("id") == F.col("o_id"), "left")
    )
    caught = F.coalesce("o_min", "circle_min")
    root = F.coalesce(caught, "s_root", "ptr", "id")
    depth = F.when(caught.isNotNull(), -1).otherwise(F.col("dist") + F.coalesce("s_dist", F.lit(0)))
    columns = [F.col("id").alias("node_id"), root.alias("root_id"), depth.cast("int").alias("depth")]
    if paths:
        up = F.concat("seg", F.coalesce("s_seg", F.array().cast("array<string>")))
        up = F.when(F.col("ptr").isNull(), F.array("id")).otherwise(F.concat(up, F.array(root)))
        columns.append(F.when(caught.isNull(), F.reverse(up)).alias("path"))
    return whole.select(*columns)


def descendants(resolved: DataFrame) -> DataFrame:
    """(ancestor_id, node_id, distance) for every proper ancestor, from the paths of ``resolve_hierarchy``."""
    return resolved.where("depth > 0").select(
        F.posexplode(F.slice("path", F.lit(1), F.col("depth"))).alias("at", "ancestor_id"),
        "node_id",
        "depth",
    ).select("ancestor_id", "node_id", (F.col("depth") - F.col("at")).alias("distance"))
