"""Composition of episodes into arc instances, and the windows and joins around it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S


def resolved_scopes(episodes: DataFrame, registry: DataFrame) -> DataFrame:
    """``episodes`` with ``scope``: the registry id whose id, name or alias the raw scope is (J-18).

    Unknown scopes stay as they are; of several entries the smallest id counts.
    """
    listed = registry.select(
        F.col("id").alias("scope"),
        F.explode(F.array_union(F.array("id", "name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("raw"),
    )
    keys = listed.where("raw is not null").groupBy(S.scope_key(F.col("raw")).alias("scope_key")).agg(F.min("scope").alias("scope"))
    exact = registry.where("id is not null").select(F.col("id").alias("scope_id"), F.col("id").alias("own")).distinct()
    return (
        episodes.join(exact, "scope_id", "left").withColumn("scope_key", S.scope_key(F.col("scope_id")))
        .join(keys, "scope_key", "left")
        .withColumn("scope", F.coalesce("own", "scope", "scope_id")).drop("own", "scope_key")
    )


def adjacent(episodes: DataFrame, actors: DataFrame) -> DataFrame:
    """Every dated episode of a scope with its identity score to the one before it (W-03, M-09 to M-13)."""
    cast = actors.select("episode_id", S.actor_key(F.col("name")).alias("key")).where("key <> ''").groupBy(F.col("episode_id").alias("id")).agg(F.array_sort(F.collect_set("key")).alias("cast"))
    rows = episodes.where("scope is not null and start_date is not null").join(cast, "id", "left").select(
        "scope", "id", "start_date", "end_date", "arc_type", "arc_phase", "location", "phase_confidence", "extracted_from",
        F.coalesce("cast", F.array().cast("array<string>")).alias("cast"),
    )
    order = Window.partitionBy("scope").orderBy("start_date", "id")
    held = F.lag(F.struct("id", "start_date", "end_date", "arc_type", "arc_phase", "cast", "location")).over(order)
    df = rows.withColumn("p", held)
    p = lambda c: F.col(f"p.{c}")
    c = F.col
    temporal = S.temporal_proximity(p("end_date"), c("start_date"))
    people = S.jaccard(p("cast"), c("cast"))
    phase = S.phase_sequence(p("arc_type"), p("arc_phase"), c("arc_phase"))
    both_cast = (F.size(p("cast")) > 0) & (F.size(c("cast")) > 0)
    sure = lambda x: F.coalesce(x.cast("int"), F.lit(0))
    signals = (
        sure(p("end_date").isNotNull() & c("start_date").isNotNull()) + sure(both_cast) + sure(p("arc_phase").isNotNull() & c("arc_phase").isNotNull())
    )
    same_arc = p("arc_type").isNull() | c("arc_type").isNull() | (p("arc_type") == c("arc_type"))
    overall = F.round(temporal * 0.3 + people * 0.3 + 0.5 * 0.25 + phase * 0.15, 6)
    dates = p("start_date").isNotNull() & p("end_date").isNotNull() & c("start_date").isNotNull() & c("end_date").isNotNull()
    confidence = F.least(F.lit(1.0), 0.5 + 0.15 * sure(dates) + 0.15 * sure(both_cast) + 0.10 * sure(p("location").isNotNull() & c("location").isNotNull()))
    match = (~both_cast | (people >= 0.1)) & (temporal > 0) & same_arc & (phase > 0) & (signals >= 2)
    return df.select(
        *rows.columns, p("id").alias("previous_id"), F.round(temporal, 6).alias("temporal"), F.round(people, 6).alias("people"), F.round(phase, 6).alias("phase"),
        overall.alias("overall"), F.round(confidence, 6).alias("confidence"), F.coalesce(p("id").isNotNull() & match, F.lit(False)).alias("is_match"),
    )


def islands(scored: DataFrame) -> DataFrame:
    """``scored`` with ``island``: the number of breaks so far in its scope (W-03)."""
    order = Window.partitionBy("scope").orderBy("start_date", "id").rowsBetween(Window.unboundedPreceding, 0)
    return scored.withColumn("island", F.sum(F.when(F.col("is_match"), 0).otherwise(1)).over(order))


def coverage_by_phase(composed: DataFrame) -> DataFrame:
    """(scope, island, phase): distinct episodes and sources, mean confidence, score, first and last start (A-14, A-15)."""
    flat = composed.where("arc_phase is not null").select("scope", "island", F.col("arc_phase").alias("phase"), "id", "phase_confidence", "start_date", F.explode_outer("extracted_from").alias("source"))
    got = flat.groupBy("scope", "island", "phase").agg(
        F.countDistinct("id").alias("episodes"), F.countDistinct("source").alias("sources"), F.min("start_date").alias("first_start"), F.max("start_date").alias("last_start")
    )
    mean = composed.where("arc_phase is not null").groupBy("scope", "island", F.col("arc_phase").alias("phase")).agg(F.avg("phase_confidence").alias("mean"))
    score = F.when(F.col("sources") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.coalesce("mean", F.lit(0.0)) * (1 + 0.1 * (F.col("sources") - 1))))
    return got.join(mean, ["scope", "island", "phase"]).select(
        "scope", "island", "phase", "episodes", "sources", F.round("mean", 6).alias("confidence"), F.round(score, 6).alias("score"), "first_start", "last_start"
    )


def instance_status(composed: DataFrame) -> DataFrame:
    """(scope, island, ...): name, bounds, number of episodes, missing phases and status (A-18 to A-20, M-19)."""
    order = F.struct("start_date", "id")
    found = F.collect_set("arc_phase")
    base = composed.groupBy("scope", "island").agg(
        F.min_by(F.coalesce("arc_type", F.lit("unknown")), order).alias("arc"), F.min_by(F.coalesce("location", F.lit("Unknown Location")), order).alias("place"),
        F.min("start_date").alias("start_date"), F.max_by("end_date", order).alias("end_date"), F.count("*").alias("episodes"), found.alias("phases"),
    )
    expected = F.when(F.col("arc") == "credit_boom_and_bust", F.array(*map(F.lit, S.PHASE_ORDER["credit_boom_and_bust"]))).otherwise(F.array(*map(F.lit, S.PHASE_ORDER["hubris_nemesis"])))
    missing = F.array_except(expected, F.col("phases"))
    return base.select(
        "scope", "island", F.concat_ws(", ", "arc", "place").alias("name"), "start_date", "end_date", "episodes", F.array_join(missing, ",").alias("missing"),
        F.when(F.size("phases") == 0, "fragmented").when(F.size(missing) == 0, "complete").when(F.size(missing) <= 2, "gaps").otherwise("fragmented").alias("status"),
        F.when(F.col("episodes") > 2, "pending").otherwise("auto").alias("review"),
    )


def top_similar(vectors: DataFrame, queries: DataFrame, vec_id: str, vector: str, k: int) -> DataFrame:
    """(query_id, rank, neighbour_id, similarity): the ``k`` nearest of all rows for a stated set of queries (J-16, J-17, T-01)."""
    q = queries.select(F.col(vec_id).alias("query_id"), F.col(vector).alias("__q"))
    pairs = vectors.select(F.col(vec_id).alias("neighbour_id"), F.col(vector).alias("__v")).join(q, F.col("neighbour_id") != F.col("query_id"))
    scored = pairs.select("query_id", "neighbour_id", S.cosine(F.col("__q"), F.col("__v")).alias("similarity"))
    # the limit on the rank prunes every task's rows to k a query before anything is shuffled
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbour_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
