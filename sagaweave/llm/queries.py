"""Queries of the problems tagged llm, with their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from .components import connected_groups
from .leakage import leaked_items
from .names import name_pairs
from .neighbours import nearest
from .packing import packed_containers
from .residue import residue_documents
from .roles import mapped_roles
from .spectral import spectral_groups

ARC = ("id", "embedding_model", "embedding_centroid")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Arcs of a group of at least 5 that are all alike and like no arc outside."""
    members, _ = spectral_groups(table(spark, sf, "arcs").select(*ARC), *ARC, least=0.72, size=5)
    return members.select(F.col("id").alias("arc_id"), "group_id")


def p1_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Every group with its size, mean centroid and most typical arcs and episodes.

    Typical arcs are the 5 of largest affinity inside the group, typical episodes the
    representative episodes of those arcs in their order.
    """
    arcs = table(spark, sf, "arcs")
    members, groups = spectral_groups(arcs.select(*ARC), *ARC, least=0.72, size=5)
    shown = arcs.select("id", F.coalesce("representative_episode_ids", F.array()).alias("episodes"))
    typical = (
        members.where("place <= 5").join(shown, "id").groupBy("group_id")
        .agg(F.sort_array(F.collect_list(F.struct("place", "id", "episodes"))).alias("top"))
    )
    return groups.join(typical, "group_id").select(
        "group_id", "size", "centroid", F.col("top.id").alias("typical_arcs"),
        F.array_distinct(F.flatten("top.episodes")).alias("typical_episodes"),
    )


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of arcs with similarity 0.96 or more, each among the other's 5 most similar."""
    # who is above a pair of 0.96 in a list of 5 has 0.96 too, so nothing below is needed for the ranks
    near = nearest(table(spark, sf, "arcs").select(*ARC), *ARC, best=5, least=0.96, p_stop=0.999)
    pair = near.select(F.least("id", "neighbour").alias("arc_a"), F.greatest("id", "neighbour").alias("arc_b"))
    return pair.groupBy("arc_a", "arc_b").count().where("count = 2").drop("count")


def p5_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The 5 most similar other arcs of every arc with a usable centroid, with their similarity."""
    return nearest(table(spark, sf, "arcs").select(*ARC), *ARC, best=5).select(
        F.col("id").alias("arc_id"), F.col("neighbour").alias("other_id"), "rank", "similarity"
    )


def _same_event(spark: SparkSession, sf: str) -> DataFrame:
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z]", "")
    return table(spark, sf, "episode_links").where(
        (plain("edge_kind") == "sameeventas") & F.coalesce(plain("review_status") != "rejected", F.lit(True))
    )


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every episode joined to another by same-event links, with its group."""
    return connected_groups(_same_event(spark, sf), "source_episode_id", "target_episode_id").select(
        F.col("vertex").alias("episode_id"), "group_id"
    )


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of rows of one table that name the same person, organisation or unfolding."""
    return name_pairs(table(spark, sf, "actors"), table(spark, sf, "arc_instances"))


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its container of 2,048 tokens, or its containers, and the fill of each."""
    return packed_containers(table(spark, sf, "documents"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Actors whose canonical role is missing or weakly fitted, with the role their own words mean."""
    weak = "canonical_role is null or role_fit_confidence is null or isnan(role_fit_confidence) or role_fit_confidence < 0.5"
    return mapped_roles(table(spark, sf, "actors").where("id is not null").where(weak), table(spark, sf, "role_vocab"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a passage of a held-out evaluation item, with the item."""
    return leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in which an unfilled slot, filler, an error or a script notice stands for content."""
    return residue_documents(table(spark, sf, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p5_found": p5_found,
    "p5_nearest": p5_nearest,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p7_found": p7_found,
    "p8_containers": p8_containers,
    "p9_found": p9_found,
    "p10_found": p10_found,
}
ORACLE = {
    "p3_found": """WITH RECURSIVE e AS (
  SELECT source_episode_id a, target_episode_id b FROM episode_links
  WHERE regexp_replace(lower(edge_kind), '[^a-z]', '', 'g') = 'sameeventas'
    AND coalesce(regexp_replace(lower(review_status), '[^a-z]', '', 'g') <> 'rejected', true)
    AND source_episode_id <> target_episode_id),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a, a AS b FROM s UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a)
SELECT a AS episode_id, min(b) AS group_id FROM r GROUP BY a""",
}
