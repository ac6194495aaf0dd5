"""Overlapping and gapped intervals: continuous covered periods and the gaps between them.

The aggregate state is a sorted list of disjoint intervals. Each input batch
first reduces its own rows to such lists per (entity, time slab), so what is
shuffled is already merged; the lists of one slab are then joined by linear
merges in a reduction tree of fixed fan-in. Slabs cut a hot entity into many
small states: no task holds an entity as a whole. Coverage that runs from one
slab into later ones is carried by a running maximum over one summary row per
slab, after which every slab emits its periods and gaps on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FAN_IN = 8
STATE = "entity string, slab long, node long, starts array<long>, ends array<long>"


def merge_sorted(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint intervals per group; touching ones are joined. ``group`` holds small ints."""
    if not len(start):
        return group, start, end
    order = np.lexsort((end, start, group))
    group, start, end = group[order], start[order], end[order]
    first = np.r_[True, group[1:] != group[:-1]]
    # a running maximum of the ends that restarts with each group: ranks keep groups apart
    rank = np.argsort(np.argsort(end, kind="stable"), kind="stable")
    by_rank = np.sort(end, kind="stable")
    block = np.cumsum(first) - 1
    reach = by_rank[np.maximum.accumulate(block * (len(end) + 1) + rank) - block * (len(end) + 1)]
    opens = first | (start > np.r_[end[0], reach[:-1]])
    at = np.flatnonzero(opens)
    return group[at], start[at], reach[np.r_[at[1:] - 1, len(end) - 1]]


def _pack(keys: pd.DataFrame, start: np.ndarray, end: np.ndarray) -> pd.DataFrame:
    """Merge the intervals of each (entity, slab, node) and return one state row for each."""
    code = keys.groupby(["entity", "slab", "node"], sort=False).ngroup().to_numpy()
    names = keys.assign(code=code).drop_duplicates("code").set_index("code")
    g, s, e = merge_sorted(code, start, end)
    cut = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    out = names.loc[g[cut]].reset_index(drop=True)
    out["starts"], out["ends"] = np.split(s, cut[1:]), np.split(e, cut[1:])
    return out[["entity", "slab", "node", "starts", "ends"]]


def _partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Reduce every batch to states of its own before anything is shuffled."""
    for pdf in batches:
        if len(pdf):
            yield _pack(pdf[["entity", "slab", "node"]], pdf["s"].to_numpy(), pdf["e"].to_numpy())


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merge lists of equal key in a partition sorted by key; the last key of a batch waits for the next."""
    held: pd.DataFrame | None = None

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["starts"].map(len).to_numpy()
        keys = pdf[["entity", "slab", "node"]].loc[pdf.index.repeat(n)].reset_index(drop=True)
        return _pack(keys, np.concatenate(pdf["starts"].to_list()), np.concatenate(pdf["ends"].to_list()))

    for pdf in batches:
        if held is not None:
            pdf = pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        out = merged(pdf)
        held = out.tail(1)
        if len(out) > 1:
            yield out.head(len(out) - 1)
    if held is not None:
        yield held


def interval_states(rows: DataFrame, slab_days: int = 3650, leaves: int = 64) -> DataFrame:
    """(entity, slab, starts, ends) with the disjoint sorted intervals that start in each slab.

    ``rows`` has entity string and s, e long (microseconds), s < e. ``leaves`` is the width of
    the reduction tree: no combining task reads more than FAN_IN lists of one (entity, slab).
    """
    width = slab_days * 86_400_000_000
    keyed = rows.select(
        "entity",
        F.floor(F.col("s") / F.lit(width)).cast("long").alias("slab"),
        F.pmod(F.spark_partition_id(), F.lit(leaves)).cast("long").alias("node"),
        "s",
        "e",
    )
    state = keyed.mapInPandas(_partials, STATE)
    nodes = leaves
    while nodes > 1:
        nodes = -(-nodes // FAN_IN)
        state = (
            state.withColumn("node", F.floor(F.col("node") / FAN_IN).cast("long"))
            .repartition("entity", "slab", "node")
            .sortWithinPartitions("entity", "slab", "node")
            .mapInPandas(_combine, STATE)
        )
    return state.drop("node")


def coverage(rows: DataFrame, entity: str, start: str, end: str, slab_days: int = 3650) -> DataFrame:
    """One row per continuous covered period: (entity, period_start, period_end, gap_from).

    gap_from is the end of the previous period of the entity, null for its first period, so
    (gap_from, period_start) are the gaps. Rows with a null entity, a null bound, or an end not
    after the start do not count; periods that touch are one. Repeated rows change nothing; an
    empty input gives an empty result; further columns are ignored, whatever their names.
    """
    clean = rows.select(
        F.col(entity).cast("string").alias("entity"),
        F.unix_micros(F.col(start).cast("timestamp")).alias("s"),
        F.unix_micros(F.col(end).cast("timestamp")).alias("e"),
    ).where("entity is not null and s < e")
    state = interval_states(clean, slab_days)
    per_entity = Window.partitionBy("entity").orderBy("slab")
    # one row per slab: how far coverage from earlier slabs reaches
    carried = state.withColumn(
        "carry", F.max(F.element_at("ends", -1)).over(per_entity.rowsBetween(Window.unboundedPreceding, -1))
    )
    pieces = carried.select(
        "entity", "slab", "carry", F.posexplode(F.arrays_zip("starts", "ends")).alias("pos", "iv")
    ).select("entity", "slab", "carry", F.col("iv.starts").alias("s"), F.col("iv.ends").alias("e"))
    in_slab = Window.partitionBy("entity", "slab").orderBy("s")
    before = F.greatest(F.lag("e").over(in_slab), F.col("carry"))
    marked = pieces.withColumn("gap_from", before).where("gap_from is null or s > gap_from")
    # the end of a period is the gap_from of the next one, in this slab or the next that has one
    heads = marked.groupBy("entity", "slab").agg(F.min("gap_from").alias("head"))
    tops = state.groupBy("entity", "slab").agg(F.max(F.element_at("ends", -1)).alias("top"))
    ahead = (
        tops.join(heads, ["entity", "slab"], "left")
        .withColumn(
            "next_head",
            F.first("head", ignorenulls=True).over(per_entity.rowsBetween(1, Window.unboundedFollowing)),
        )
        .withColumn("last_end", F.max("top").over(Window.partitionBy("entity")))
        .select("entity", "slab", "next_head", "last_end")
    )
    return (
        marked.withColumn("own_next", F.lead("gap_from").over(in_slab))
        .join(ahead, ["entity", "slab"])
        .select(
            "entity",
            F.timestamp_micros("s").alias("period_start"),
            F.timestamp_micros(F.coalesce("own_next", "next_head", "last_end")).alias("period_end"),
            F.timestamp_micros("gap_from").alias("gap_from"),
        )
    )


def gaps(rows: DataFrame, entity: str, start: str, end: str, slab_days: int = 3650) -> DataFrame:
    """(entity, gap_from, gap_to): each stretch between two consecutive covered periods."""
    return (
        coverage(rows, entity, start, end, slab_days)
        .where("gap_from is not null")
        .select("entity", "gap_from", F.col("period_start").alias("gap_to"))
    )
