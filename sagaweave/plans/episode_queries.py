"""Queries of the reference's own operators on the project's tables, each with its SQL.

"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import episodes as E
from ..runtime import table
from ..streaming import windows as T

CUTOFF = "1900-01-01"
STAMP = "yyyy-MM-dd HH:mm:ss"


def _t(name):
    return lambda spark, sf: table(spark, sf, name)


episodes, actors, links, arcs, cycles, documents, events = map(_t, ("episodes", "actors", "episode_links", "arcs", "cycles", "documents", "events"))


def scope_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Raw scopes to registry ids. X-01, J-18, F-34"""
    rows = E.resolved_scopes(episodes(spark, sf).select("id", "scope_id"), table(spark, sf, "scope_registry"))
    return rows.select("id", "scope_id", "scope")


def actor_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised names with the number of distinct actors. X-02, A-01"""
    return actors(spark, sf).groupBy(S.actor_key(F.col("name")).alias("name_key")).agg(F.countDistinct("id").alias("actors"))


def work_slug(spark: SparkSession, sf: str) -> DataFrame:
    """Slugs of arc names. X-03"""
    return arcs(spark, sf).select("id", S.slug(F.col("name")).alias("name_slug"))


def doc_type(spark: SparkSession, sf: str) -> DataFrame:
    """Kind of each document by its source and element. X-04, P-11"""
    return documents(spark, sf).select("doc_id", S.document_kind(F.concat_ws(" ", "source", "element_type")).alias("kind"))


def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    """SHA-256 and token estimate of every text. X-05, X-06, F-08"""
    return documents(spark, sf).select("doc_id", F.sha2("text", 256).alias("hash"), S.token_estimate(F.col("text")).alias("tokens"))


def ledger_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with the first one of the same content. W-01, W-02, K-03, F-10"""
    w = Window.partitionBy("hash").orderBy("ingested_at", "doc_id")
    rows = documents(spark, sf).where("text is not null").select("doc_id", "ingested_at", F.sha2("text", 256).alias("hash"))
    return rows.select("doc_id", F.first("doc_id").over(w).alias("original_id"), F.when(F.row_number().over(w) == 1, "original").otherwise("duplicate").alias("status"))


def episodes_by_arc(spark: SparkSession, sf: str) -> DataFrame:
    """Classified episodes of an arc and phase. F-01 to F-03, F-29"""
    return episodes(spark, sf).where("arc_type = 'credit_boom_and_bust' and arc_phase = 'panic'").select("id", "title", "phase_confidence")


def tag_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Episodes that carry any of the given tags. F-13"""
    wanted = episodes(spark, sf).select(F.explode("mechanism_tags").alias("tag")).groupBy("tag").count().orderBy(F.desc("count"), "tag").limit(2)
    tagged = episodes(spark, sf).select("id", F.explode("mechanism_tags").alias("tag"))
    return tagged.join(wanted.select("tag"), "tag").groupBy("id").agg(F.countDistinct("tag").alias("tags"))


def mask_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus as it was known at the cutoff. F-14, F-16, Z-19"""
    cut = F.lit(CUTOFF).cast("timestamp_ntz")
    known = episodes(spark, sf).where(F.col("start_date") <= cut)
    return known.select("id", "start_date", F.when(F.col("end_date") <= cut, F.col("end_date")).alias("end_date"), (F.col("end_date") > cut).alias("masked"))


def backtest_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Episodes that run over the cutoff. F-15"""
    cut = F.lit(CUTOFF).cast("timestamp_ntz")
    return episodes(spark, sf).where((F.col("start_date") <= cut) & (F.col("end_date") > cut)).select("id", "start_date", "end_date")


def episode_residue(spark: SparkSession, sf: str) -> DataFrame:
    """Share of unresolved actors of every episode. A-11, J-01"""
    a = actors(spark, sf).dropDuplicates(["id"]).groupBy("episode_id").agg(F.round(F.avg(F.col("canonical_role").isNull().cast("double")), 6).alias("residue"))
    return episodes(spark, sf).select("id").join(a.withColumnRenamed("episode_id", "id"), "id", "left")


def residue_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """Share of unresolved actors by first source. A-12, J-01"""
    e = episodes(spark, sf).select(F.col("id").alias("episode_id"), F.coalesce(F.try_element_at("extracted_from", F.lit(1)), F.lit("unknown")).alias("source"))
    got = actors(spark, sf).dropDuplicates(["id"]).join(e, "episode_id").groupBy("source")
    return got.agg(F.count("*").alias("actors"), F.round(F.avg(F.col("canonical_role").isNull().cast("double")), 6).alias("residue"))


def residue_by_era(spark: SparkSession, sf: str) -> DataFrame:
    """Share of unresolved actors by half century. A-13"""
    e = episodes(spark, sf).select(F.col("id").alias("episode_id"), S.era(F.col("start_date")).alias("era"))
    got = actors(spark, sf).dropDuplicates(["id"]).join(e, "episode_id").groupBy("era")
    return got.agg(F.count("*").alias("actors"), F.round(F.avg(F.col("canonical_role").isNull().cast("double")), 6).alias("residue"))


def health_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Row counts and pending reviews in one row. A-01, A-03, F-25"""
    e = episodes(spark, sf).agg(F.count("*").alias("episodes"), F.count_if(F.col("classification_state") == "classified").alias("classified"))
    pending = F.count_if(F.lower(F.trim("review_status")) == "pending").alias("pending_links")
    return e.crossJoin(links(spark, sf).dropDuplicates(["id"]).agg(F.count("*").alias("links"), pending)).crossJoin(arcs(spark, sf).agg(F.count("*").alias("arcs")))


def stale_fraction(spark: SparkSession, sf: str) -> DataFrame:
    """Share of arcs that lack a vector of the current model. F-11, F-12, A-04"""
    models = arcs(spark, sf).where("embedding_model is not null").groupBy("embedding_model").agg(F.count("*").alias("n"))
    current = models.agg(F.max_by("embedding_model", F.struct("n", "embedding_model")).alias("current"))
    stale = F.col("embedding_centroid").isNull() | F.coalesce(F.col("embedding_model") != F.col("current"), F.lit(True))
    return arcs(spark, sf).crossJoin(F.broadcast(current)).agg(F.count("*").alias("arcs"), F.coalesce(F.round(F.avg(stale.cast("double")), 6), F.lit(0.0)).alias("stale"))


def _forecasts(spark: SparkSession, sf: str) -> DataFrame:
    rows = actors(spark, sf).where("role_fit_confidence between 0 and 1").dropDuplicates(["id"])
    return rows.select(F.col("role_fit_confidence").alias("p"), F.col("canonical_role").isNotNull().cast("int").alias("y"))


def calibration_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Ten bins of confidence against outcome, empty ones included. A-05, A-30"""
    b = _forecasts(spark, sf).withColumn("bin", F.least(F.floor(F.col("p") / F.lit(0.1)), F.lit(9)).cast("int"))
    got = b.groupBy("bin").agg(F.avg("p").alias("p"), F.avg("y").alias("y"), F.count("*").alias("n"))
    return spark.range(10).select(F.col("id").cast("int").alias("bin")).join(got, "bin", "left").select(
        "bin", F.round(F.coalesce("p", F.col("bin") / 10 + 0.05), 6).alias("predicted"), F.round(F.coalesce("y", F.lit(0.0)), 6).alias("observed"),
        F.coalesce("n", F.lit(0)).alias("forecasts"), F.round(F.abs(F.coalesce(F.col("p") - F.col("y"), F.col("bin") / 10 + 0.05)), 6).alias("error"),
    )


def ece(spark: SparkSession, sf: str) -> DataFrame:
    """Expected calibration error, mean Brier score and skill against the base rate. A-02, A-06, A-08, A-09, M-14"""
    f = _forecasts(spark, sf)
    binned = f.groupBy(F.least(F.floor(F.col("p") / F.lit(0.1)), F.lit(9)).alias("bin")).agg(F.avg("p").alias("p"), F.avg("y").alias("y"), F.count("*").alias("n"))
    e = binned.agg(F.round(F.sum(F.abs(F.col("p") - F.col("y")) * F.col("n")) / F.sum("n"), 6).alias("ece"))
    b = f.agg(F.avg(S.brier(F.col("p"), F.col("y"))).alias("b"), (F.avg("y") * (1 - F.avg("y"))).alias("r"))
    return e.crossJoin(b.select(F.round("b", 6).alias("brier"), F.round(F.when(F.col("r") == 0, 0.0).otherwise(1 - F.col("b") / F.col("r")), 6).alias("skill")))


def confidence_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Count and mean confidence by arc and phase, with totals. A-07, A-10"""
    r = episodes(spark, sf).where("arc_type is not null and arc_phase is not null").rollup("arc_type", "arc_phase")
    return r.agg(F.count("*").alias("episodes"), F.round(F.avg("phase_confidence"), 6).alias("confidence"), F.grouping_id().cast("long").alias("level"))


def per_source_cap(spark: SparkSession, sf: str) -> DataFrame:
    """The three surest episodes of every source; those without one are not capped. W-06, T-02"""
    rows = episodes(spark, sf).select("id", F.try_element_at("extracted_from", F.lit(1)).alias("source"), "phase_confidence")
    w = Window.partitionBy("source").orderBy(F.desc_nulls_last("phase_confidence"), "id")
    capped = rows.where("source is not null").withColumn("place", F.row_number().over(w)).where("place <= 3")
    return capped.unionByName(rows.where("source is null").withColumn("place", F.lit(None).cast("int"))).select("id", "source", "place")


def sequence_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Consecutive episodes of a scope and arc. W-05, J-13"""
    w = Window.partitionBy("scope_id", "arc_type").orderBy(F.asc_nulls_last("start_date"), "created_at", "id")
    rows = episodes(spark, sf).where("scope_id is not null and arc_type is not null").withColumn("next_id", F.lead("id").over(w))
    return rows.where("next_id is not null").select(F.col("id").alias("source_id"), F.col("next_id").alias("target_id"))


def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Links that wait for review, with both titles. F-25, J-07, J-08"""
    one = episodes(spark, sf).select(F.col("id").alias("source_episode_id"), F.col("title").alias("s"))
    two = episodes(spark, sf).select(F.col("id").alias("target_episode_id"), F.col("title").alias("t"))
    rows = links(spark, sf).dropDuplicates(["id"]).where(F.lower(F.trim("review_status")) == "pending")
    return rows.join(one, "source_episode_id", "left").join(two, "target_episode_id", "left").select("id", F.coalesce("s", F.lit("?")).alias("source_title"), F.coalesce("t", F.lit("?")).alias("target_title"))


def links_within(spark: SparkSession, sf: str) -> DataFrame:
    """Links by kind whose two ends are classified. J-10, J-11, U-01, U-05, P-12"""
    e = episodes(spark, sf).where("classification_state = 'classified'").select("id")
    kind = F.regexp_replace(F.lower(F.trim("edge_kind")), "[^a-z]", "")
    rows = links(spark, sf).select(kind.alias("kind"), F.least("source_episode_id", "target_episode_id").alias("a"), F.greatest("source_episode_id", "target_episode_id").alias("b")).where("a <> b").distinct()
    rows = rows.join(e.withColumnRenamed("id", "a"), "a", "left_semi").join(e.withColumnRenamed("id", "b"), "b", "left_semi")
    return rows.groupBy("kind").agg(F.count("*").alias("links"))


def cycle_context(spark: SparkSession, sf: str) -> DataFrame:
    """Children of every cycle by scale. F-04, F-05, F-32, P-08"""
    c = cycles(spark, sf).dropDuplicates(["id"]).select("id", "scale", "parent_cycle_id")
    p = c.select(F.col("id").alias("parent_cycle_id"), F.col("scale").alias("parent_scale"))
    return c.join(p, "parent_cycle_id").groupBy(F.col("parent_cycle_id").alias("cycle_id"), "parent_scale").agg(F.count("*").alias("children"), F.countDistinct("scale").alias("scales"))


def temporal_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    """Number of episodes of a scope that start within five years after another. F-28, D-04, J-14, J-15"""
    micros = F.unix_micros(F.col("start_date").cast("timestamp"))
    w = Window.partitionBy("scope_id").orderBy(micros).rangeBetween(0, 5 * 365 * 86_400_000_000)
    rows = episodes(spark, sf).where("scope_id is not null and start_date is not null")
    return rows.select("id", (F.count("*").over(w) - 1).alias("neighbors"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    rows = E.resolved_scopes(episodes(spark, sf), table(spark, sf, "scope_registry"))
    return E.adjacent(rows, actors(spark, sf))


def identity_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Identity score of neighbours in a scope. D-03, M-09 to M-13, U-04"""
    return _scored(spark, sf).where("previous_id is not null").select("id", "previous_id", "temporal", "people", "phase", "overall", "confidence", "is_match")


def split_points(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours too unlike to belong together. W-04, A-25"""
    return _scored(spark, sf).where("previous_id is not null and overall < 0.45").select("scope", "id")


def compose_islands(spark: SparkSession, sf: str) -> DataFrame:
    """Episodes of a scope cut into unfoldings. W-03, Z-03, Z-04, U-02"""
    return E.islands(_scored(spark, sf)).select("scope", "id", "island")


def compose_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage of each phase of each unfolding. A-14 to A-17"""
    return E.coverage_by_phase(E.islands(_scored(spark, sf))).select("scope", "island", "phase", "episodes", "sources", "confidence", "score")


def compose_status(spark: SparkSession, sf: str) -> DataFrame:
    """Each unfolding with name, bounds, missing phases and status. A-18 to A-20, N-06, N-07, M-19"""
    return E.instance_status(E.islands(_scored(spark, sf))).select(
        "scope", "island", "name", F.date_format("start_date", STAMP).alias("start_date"), F.date_format("end_date", STAMP).alias("end_date"), "episodes", "missing", "status", "review"
    )


def analog_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Partial and combined scores of an episode against the one before it in its scope. M-04 to M-08, U-03, U-07, F-38"""
    w = Window.partitionBy("scope_id").orderBy("start_date", "id")
    p = F.lag(F.struct("id", "arc_type", "arc_phase", "mechanism_tags")).over(w)
    r = episodes(spark, sf).where("scope_id is not null and start_date is not null").withColumn("p", p).where("p is not null")
    arc = S.arc_match(F.col("p.arc_type"), F.col("arc_type"))
    phase = S.phase_compatibility(F.col("p.arc_type"), F.col("p.arc_phase"), F.col("arc_type"), F.col("arc_phase"))
    tags = S.jaccard(F.col("p.mechanism_tags"), F.col("mechanism_tags"))
    score = S.combined_score(F.lit(0.5), arc, phase, F.lit(0.5), tags, F.col("p.arc_type").isNull())
    return r.select("id", F.round(arc, 6).alias("arc"), F.round(phase, 6).alias("phase"), F.round(tags, 6).alias("tags"), F.round(score, 6).alias("score"))


def outcome_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Whether neighbouring titles of a scope tell the same outcome. X-12 to X-15, X-22"""
    w = Window.partitionBy("scope_id").orderBy("start_date", "id")
    r = episodes(spark, sf).where("scope_id is not null and start_date is not null and title is not null").withColumn("before", F.lag("title").over(w)).where("before is not null")
    a, b = F.col("before"), F.col("title")
    return r.select("id", S.word_overlap(a, b).alias("overlap"), S.outcome_match(a, b, 0.3).alias("loose"), S.outcome_match(a, b, 0.5).alias("strict"))


def partial_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Dates of the stated precision padded to their first and last day. D-01"""
    d = F.col("start_date")
    first = F.when(F.col("date_precision") == "year", F.date_trunc("year", d)).when(F.col("date_precision") == "month", F.date_trunc("month", d)).otherwise(F.date_trunc("day", d))
    last = F.when(F.col("date_precision") == "year", F.make_date(F.year(d), F.lit(12), F.lit(31))).when(F.col("date_precision") == "month", F.last_day(d)).otherwise(F.to_date(d))
    return episodes(spark, sf).where(d.isNotNull()).select("id", F.date_format(first, "yyyy-MM-dd").alias("first_day"), F.date_format(last, "yyyy-MM-dd").alias("last_day"))


def surface_text(spark: SparkSession, sf: str) -> DataFrame:
    """Surface text and question of every episode. X-09, X-11"""
    arc = F.when(F.col("arc_type").isNull(), "").otherwise(F.concat(F.lit(" ("), F.col("arc_type"), F.lit(", "), F.coalesce("arc_phase", F.lit("unknown")), F.lit(" phase)")))
    return episodes(spark, sf).select("id", F.concat_ws("\n", "title", "summary").alias("surface"), F.concat(F.lit("What is the likely outcome of '"), F.coalesce("title", F.lit("")), F.lit("'"), arc, F.lit("?")).alias("question"))


def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Number of events by type and by whether their JSON reads. N-01, N-03"""
    ok = F.try_parse_json("props").isNotNull()
    return events(spark, sf).groupBy("event_type", ok.alias("valid")).agg(F.count("*").alias("events"))


def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest vectors of every hundredth one, among all. J-16, J-17, M-01, M-03, W-09, T-01"""
    v = table(spark, sf, "embeddings")
    got = E.top_similar(v, v.where("vec_id % 100 = 0"), "vec_id", "embedding", 5)
    return got.select("query_id", "rank", "neighbour_id", F.round("similarity", 5).alias("similarity"))


def cluster_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Size, mean and spread of the distance to the centroid by label. A-26"""
    v = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("at", "x"))
    centre = v.groupBy("label", "at").agg(F.avg("x").alias("c"))
    far = v.join(centre, ["label", "at"]).groupBy("label", "vec_id").agg(F.sqrt(F.sum((F.col("x") - F.col("c")) ** 2)).alias("d"))
    return far.groupBy("label").agg(F.count("*").alias("members"), F.round(F.avg("d"), 5).alias("mean"), F.round(F.stddev_pop("d"), 5).alias("spread"), F.min_by("vec_id", F.struct(F.round("d", 6), "vec_id")).alias("typical"))


def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """Events and values by hour and type."""
    return T.tumbling(events(spark, sf)).withColumn("window_start", F.date_format("window_start", STAMP))


def stream_sliding(spark: SparkSession, sf: str) -> DataFrame:
    """Events and values of every day that starts at a quarter of a day."""
    return T.sliding(events(spark, sf)).withColumn("window_start", F.date_format("window_start", STAMP))


def stream_session(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of a user, apart by half an hour or more."""
    got = T.sessions(events(spark, sf))
    return got.select("user_id", F.date_format("session_start", STAMP).alias("session_start"), "events", "total")


def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of user and type that occur. K-03"""
    return T.first_seen(events(spark, sf).select("user_id", "event_type", "ts"), ["user_id", "event_type"]).select("user_id", "event_type")


_NAMES = """scope_resolve actor_normalize work_slug doc_type content_hash ledger_dedupe episodes_by_arc tag_overlap mask_corpus backtest_cases
episode_residue residue_by_source residue_by_era health_counts stale_fraction calibration_bins ece confidence_rollup per_source_cap sequence_edges
review_queue links_within cycle_context temporal_neighbors identity_scores split_points compose_islands compose_coverage compose_status analog_scores
outcome_matches partial_dates surface_text json_fields knn_topk cluster_stats stream_tumbling stream_sliding stream_session stream_dedupe""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_KEY = r"trim(regexp_replace(regexp_replace(@, '[^\p{L}\p{M}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))"
_SCOPE_KEY = _KEY.replace("@", r"regexp_replace(trim(lower(@)), '^the\s+', '')")
_ACTORS = "(SELECT DISTINCT ON (id) * FROM actors ORDER BY id)"
_WORDS = r"regexp_extract_all(lower({}), '\S+')"
_OVERLAP = f"len(list_intersect({_WORDS.format('a')}, {_WORDS.format('b')}))"
_LEAST = f"least(len(list_distinct({_WORDS.format('a')})), len(list_distinct({_WORDS.format('b')})))"
_SCOPED = f"""listed AS (SELECT id AS scope, unnest(list_concat([id, name], coalesce(aliases, []))) AS raw FROM scope_registry),
keys AS (SELECT {_SCOPE_KEY.replace('@', 'raw')} AS k, min(scope) AS scope FROM listed WHERE raw IS NOT NULL GROUP BY 1),
scoped AS (SELECT e.*, coalesce(r.id, k.scope, e.scope_id) AS scope FROM episodes e LEFT JOIN (SELECT DISTINCT id FROM scope_registry) r ON r.id = e.scope_id
  LEFT JOIN keys k ON k.k = {_SCOPE_KEY.replace('@', 'e.scope_id')})"""


def _index(arc: str, phase: str) -> str:
    return (
        f"CASE {arc} WHEN 'credit_boom_and_bust' THEN list_position(['boom','euphoria','distress','panic','revulsion'], {phase})"
        f" WHEN 'hubris_nemesis' THEN list_position(['setup','rising_action','climax','falling_action','resolution'], {phase}) END"
    )


def _category(phase: str) -> str:
    return f"CASE WHEN {phase} IN ('setup','boom') THEN 1 WHEN {phase} IN ('rising_action','euphoria','climax','distress') THEN 2 WHEN {phase} IN ('falling_action','panic','resolution','revulsion') THEN 3 END"


_SCORED = f"""WITH {_SCOPED},
people AS (SELECT episode_id, list_sort(list(DISTINCT k)) AS cast_ FROM (SELECT episode_id, {_KEY.replace('@', 'lower(name)')} AS k FROM actors) WHERE k <> '' GROUP BY 1),
rows_ AS (SELECT s.*, coalesce(p.cast_, []) AS cast_ FROM scoped s LEFT JOIN people p ON p.episode_id = s.id WHERE scope IS NOT NULL AND start_date IS NOT NULL),
lagged AS (SELECT *, lag(id) OVER w AS p_id, lag(start_date) OVER w AS p_start, lag(end_date) OVER w AS p_end, lag(arc_type) OVER w AS p_arc,
  lag(arc_phase) OVER w AS p_phase, lag(cast_) OVER w AS p_cast, lag(location) OVER w AS p_place FROM rows_ WINDOW w AS (PARTITION BY scope ORDER BY start_date, id)),
parts AS (SELECT *, floor((epoch_us(start_date) - epoch_us(p_end)) / 86400000000.0) AS gap, len(p_cast) > 0 AND len(cast_) > 0 AS both_cast,
  {_index('p_arc', 'arc_phase')} - {_index('p_arc', 'p_phase')} AS step FROM lagged),
sc AS (SELECT *, CASE WHEN gap IS NULL THEN 0.5 WHEN gap < 0 THEN 1.0 WHEN gap > 3650 THEN 0.0 ELSE exp(-3.0 * gap / 1825) END AS t,
  CASE WHEN both_cast THEN len(list_intersect(p_cast, cast_)) / len(list_distinct(list_concat(p_cast, cast_)))::DOUBLE ELSE 0.5 END AS a,
  CASE WHEN step IS NULL THEN 0.5 WHEN step = 1 THEN 1.0 WHEN step > 0 THEN greatest(0.0, 1 - (step - 1) * 0.3) ELSE 0.0 END::DOUBLE AS ph FROM parts),
scored AS (SELECT *, round(t, 6) AS temporal, round(a, 6) AS people, round(ph, 6) AS phase, round(t * 0.3 + a * 0.3 + 0.5 * 0.25 + ph * 0.15, 6) AS overall,
  round(least(1.0, 0.5::DOUBLE + CASE WHEN p_start IS NOT NULL AND p_end IS NOT NULL AND end_date IS NOT NULL THEN 0.15::DOUBLE ELSE 0 END
    + CASE WHEN both_cast THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN p_place IS NOT NULL AND location IS NOT NULL THEN 0.1::DOUBLE ELSE 0 END), 6) AS confidence,
  coalesce(p_id IS NOT NULL AND (NOT coalesce(both_cast, false) OR a >= 0.1) AND t > 0 AND (p_arc IS NULL OR arc_type IS NULL OR p_arc = arc_type) AND ph > 0
    AND (p_end IS NOT NULL)::INT + coalesce(both_cast, false)::INT + (p_phase IS NOT NULL AND arc_phase IS NOT NULL)::INT >= 2, false) AS is_match FROM sc),
composed AS (SELECT *, sum(CASE WHEN is_match THEN 0 ELSE 1 END) OVER (PARTITION BY scope ORDER BY start_date, id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM scored)
"""
_FORECASTS = f"f AS (SELECT role_fit_confidence p, (canonical_role IS NOT NULL)::INT y FROM {_ACTORS} WHERE role_fit_confidence BETWEEN 0 AND 1)"
_BINNED = "b AS (SELECT least(floor(p / 0.1::DOUBLE), 9)::INT AS bin, avg(p) p, avg(y) y, count(*) n FROM f GROUP BY 1)"
_RESIDUE = "count(*) AS actors, round(avg((canonical_role IS NULL)::INT::DOUBLE), 6) AS residue"
_BOTH_KINDS = "regexp_replace(lower(trim(edge_kind)), '[^a-z]', '', 'g')"

ORACLE = {
    "scope_resolve": f"WITH {_SCOPED} SELECT id, scope_id, scope FROM scoped",
    "actor_normalize": f"SELECT {_KEY.replace('@', 'lower(name)')} AS name_key, count(DISTINCT id) AS actors FROM actors GROUP BY 1",
    "work_slug": "SELECT id, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS name_slug FROM arcs",
    "doc_type": """SELECT doc_id, CASE WHEN regexp_matches(n, 'timeline|chronology') THEN 'timeline' WHEN contains(n, 'chapter') THEN 'chapter'
  WHEN regexp_matches(n, 'article|paper') THEN 'article' ELSE 'book' END AS kind FROM (SELECT doc_id, lower(concat_ws(' ', source, element_type)) n FROM documents)""",
    "content_hash": r"""SELECT doc_id, sha256(text) AS hash, floor(len(regexp_extract_all(text, '\S+')) / 0.75::DOUBLE)::BIGINT AS tokens FROM documents""",
    "ledger_dedupe": """SELECT doc_id, first_value(doc_id) OVER w AS original_id, CASE WHEN row_number() OVER w = 1 THEN 'original' ELSE 'duplicate' END AS status
FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY text ORDER BY ingested_at NULLS FIRST, doc_id)""",
    "episodes_by_arc": "SELECT id, title, phase_confidence FROM episodes WHERE arc_type = 'credit_boom_and_bust' AND arc_phase = 'panic'",
    "tag_overlap": """WITH t AS (SELECT id, unnest(mechanism_tags) AS tag FROM episodes), w AS (SELECT tag FROM t GROUP BY tag ORDER BY count(*) DESC, tag LIMIT 2)
SELECT id, count(DISTINCT tag) AS tags FROM t JOIN w USING (tag) GROUP BY id""",
    "mask_corpus": f"""SELECT id, start_date, CASE WHEN end_date <= TIMESTAMP '{CUTOFF}' THEN end_date END AS end_date, end_date > TIMESTAMP '{CUTOFF}' AS masked
FROM episodes WHERE start_date <= TIMESTAMP '{CUTOFF}'""",
    "backtest_cases": f"SELECT id, start_date, end_date FROM episodes WHERE start_date <= TIMESTAMP '{CUTOFF}' AND end_date > TIMESTAMP '{CUTOFF}'",
    "episode_residue": f"SELECT e.id, round(avg(CASE WHEN a.id IS NOT NULL THEN (a.canonical_role IS NULL)::INT::DOUBLE END), 6) AS residue FROM episodes e LEFT JOIN {_ACTORS} a ON a.episode_id = e.id GROUP BY e.id",
    "residue_by_source": f"SELECT coalesce(extracted_from[1], 'unknown') AS source, {_RESIDUE} FROM {_ACTORS} a JOIN episodes e ON e.id = a.episode_id GROUP BY 1",
    "residue_by_era": f"SELECT coalesce(((year(start_date) // 50) * 50)::VARCHAR, 'undated') AS era, {_RESIDUE} FROM {_ACTORS} a JOIN episodes e ON e.id = a.episode_id GROUP BY 1",
    "health_counts": """SELECT (SELECT count(*) FROM episodes) AS episodes, (SELECT count(*) FROM episodes WHERE classification_state = 'classified') AS classified,
  (SELECT count(DISTINCT id) FROM episode_links) AS links, (SELECT count(DISTINCT id) FROM episode_links WHERE lower(trim(review_status)) = 'pending') AS pending_links, (SELECT count(*) FROM arcs) AS arcs""",
    "stale_fraction": """WITH c AS (SELECT embedding_model AS m FROM arcs WHERE embedding_model IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1)
SELECT count(*) AS arcs, coalesce(round(avg((embedding_centroid IS NULL OR coalesce(embedding_model <> c.m, true))::INT::DOUBLE), 6), 0.0) AS stale FROM arcs, c""",
    "calibration_bins": f"""WITH {_FORECASTS}, {_BINNED} SELECT k::INT AS bin, round(coalesce(p, k / 10.0::DOUBLE + 0.05::DOUBLE), 6) AS predicted, round(coalesce(y, 0.0), 6) AS observed, coalesce(n, 0) AS forecasts,
  round(abs(coalesce(p - y, k / 10.0::DOUBLE + 0.05::DOUBLE)), 6) AS error FROM range(10) r(k) LEFT JOIN b ON b.bin = k""",
    "ece": f"""WITH {_FORECASTS}, {_BINNED} SELECT (SELECT round(sum(abs(p - y) * n) / sum(n), 6) FROM b) AS ece, round(avg((p - y) ** 2), 6) AS brier,
  round(CASE WHEN avg(y) * (1 - avg(y)) = 0 THEN 0.0 ELSE 1 - avg((p - y) ** 2) / (avg(y) * (1 - avg(y))) END, 6) AS skill FROM f""",
    "confidence_rollup": """SELECT arc_type, arc_phase, count(*) AS episodes, round(avg(phase_confidence), 6) AS confidence, grouping_id(arc_type, arc_phase)::BIGINT AS level
FROM episodes WHERE arc_type IS NOT NULL AND arc_phase IS NOT NULL GROUP BY ROLLUP (arc_type, arc_phase)""",
    "per_source_cap": """SELECT id, source, CASE WHEN source IS NOT NULL THEN place END::INT AS place FROM (SELECT id, extracted_from[1] AS source,
  row_number() OVER (PARTITION BY extracted_from[1] ORDER BY phase_confidence DESC NULLS LAST, id) AS place FROM episodes) WHERE source IS NULL OR place <= 3""",
    "sequence_edges": """SELECT id AS source_id, n AS target_id FROM (SELECT id, lead(id) OVER (PARTITION BY scope_id, arc_type ORDER BY start_date NULLS LAST, created_at NULLS FIRST, id) AS n
  FROM episodes WHERE scope_id IS NOT NULL AND arc_type IS NOT NULL) WHERE n IS NOT NULL""",
    "review_queue": """SELECT l.id, coalesce(s.title, '?') AS source_title, coalesce(t.title, '?') AS target_title FROM (SELECT DISTINCT ON (id) * FROM episode_links) l
  LEFT JOIN episodes s ON s.id = source_episode_id LEFT JOIN episodes t ON t.id = target_episode_id WHERE lower(trim(review_status)) = 'pending'""",
    "links_within": f"""SELECT kind, count(*) AS links FROM (SELECT DISTINCT {_BOTH_KINDS} AS kind, least(source_episode_id, target_episode_id) a, greatest(source_episode_id, target_episode_id) b FROM episode_links
  WHERE source_episode_id <> target_episode_id) WHERE a IN (SELECT id FROM episodes WHERE classification_state = 'classified') AND b IN (SELECT id FROM episodes WHERE classification_state = 'classified') GROUP BY kind""",
    "cycle_context": """WITH c AS (SELECT DISTINCT ON (id) id, scale, parent_cycle_id FROM cycles)
SELECT p.id AS cycle_id, p.scale AS parent_scale, count(*) AS children, count(DISTINCT c.scale) AS scales FROM c JOIN c p ON p.id = c.parent_cycle_id GROUP BY 1, 2""",
    "temporal_neighbors": """SELECT id, count(*) OVER (PARTITION BY scope_id ORDER BY epoch_us(start_date) RANGE BETWEEN 0 PRECEDING AND 157680000000000 FOLLOWING) - 1 AS neighbors
FROM episodes WHERE scope_id IS NOT NULL AND start_date IS NOT NULL""",
    "identity_scores": _SCORED + "SELECT id, p_id AS previous_id, temporal, people, phase, overall, confidence, is_match FROM scored WHERE p_id IS NOT NULL",
    "split_points": _SCORED + "SELECT scope, id FROM scored WHERE p_id IS NOT NULL AND overall < 0.45",
    "compose_islands": _SCORED + "SELECT scope, id, island FROM composed",
    "compose_coverage": _SCORED + """, src AS (SELECT scope, island, arc_phase AS phase, count(DISTINCT s) AS sources FROM (SELECT scope, island, arc_phase, unnest(extracted_from) AS s FROM composed WHERE arc_phase IS NOT NULL) GROUP BY ALL),
g AS (SELECT scope, island, arc_phase AS phase, count(DISTINCT id) AS episodes, avg(phase_confidence) AS m FROM composed WHERE arc_phase IS NOT NULL GROUP BY ALL)
SELECT scope, island, phase, episodes, coalesce(sources, 0) AS sources, round(m, 6) AS confidence,
  round(CASE WHEN coalesce(sources, 0) = 0 THEN 0.0 ELSE least(1.0, coalesce(m, 0.0) * (1 + 0.1::DOUBLE * (sources - 1))) END, 6) AS score FROM g LEFT JOIN src USING (scope, island, phase)""",
    "compose_status": _SCORED + """, g AS (SELECT scope, island, arg_min(coalesce(arc_type, 'unknown'), (start_date, id)) AS arc, arg_min(coalesce(location, 'Unknown Location'), (start_date, id)) AS place,
  min(start_date) AS s, last(end_date ORDER BY start_date, id) AS e, count(*) AS episodes, coalesce(list(DISTINCT arc_phase) FILTER (arc_phase IS NOT NULL), []) AS phases FROM composed GROUP BY ALL),
m AS (SELECT *, [x FOR x IN CASE WHEN arc = 'credit_boom_and_bust' THEN ['boom','euphoria','distress','panic','revulsion'] ELSE ['setup','rising_action','climax','falling_action','resolution'] END
  IF NOT list_contains(phases, x)] AS missing FROM g)
SELECT scope, island, arc || ', ' || place AS name, strftime(s, '%Y-%m-%d %H:%M:%S') AS start_date, strftime(e, '%Y-%m-%d %H:%M:%S') AS end_date, episodes, array_to_string(missing, ',') AS missing,
  CASE WHEN len(phases) = 0 THEN 'fragmented' WHEN len(missing) = 0 THEN 'complete' WHEN len(missing) <= 2 THEN 'gaps' ELSE 'fragmented' END AS status,
  CASE WHEN episodes > 2 THEN 'pending' ELSE 'auto' END AS review FROM m""",
    "analog_scores": f"""WITH l AS (SELECT id, arc_type a2, arc_phase f2, mechanism_tags t2, lag(id) OVER w AS pid, lag(arc_type) OVER w AS a1, lag(arc_phase) OVER w AS f1, lag(mechanism_tags) OVER w AS t1
  FROM episodes WHERE scope_id IS NOT NULL AND start_date IS NOT NULL WINDOW w AS (PARTITION BY scope_id ORDER BY start_date, id)),
s AS (SELECT id, a1, CASE WHEN a1 IS NULL OR a2 IS NULL THEN 0.5 WHEN a1 = a2 THEN 1.0 WHEN (a1, a2) IN (('credit_boom_and_bust','rise_and_overextension'),('credit_boom_and_bust','hubris_nemesis'),
    ('hubris_nemesis','tragedy'),('hubris_nemesis','rise_and_overextension'),('hero_journey','rebirth'),('hero_journey','voyage_return')) THEN 0.6 ELSE 0.1 END::DOUBLE AS arc,
  CASE WHEN f1 IS NULL OR f2 IS NULL THEN 0.5 WHEN a1 = a2 AND f1 = f2 THEN 1.0 WHEN a1 = a2 AND abs({_index('a1', 'f1')} - {_index('a2', 'f2')}) = 1 THEN 0.7
    WHEN a1 = a2 AND abs({_index('a1', 'f1')} - {_index('a2', 'f2')}) = 2 THEN 0.4 WHEN {_category('f1')} = {_category('f2')} THEN 0.6 ELSE 0.3 END::DOUBLE AS phase,
  CASE WHEN len(t1) > 0 AND len(t2) > 0 THEN len(list_intersect(t1, t2)) / len(list_distinct(list_concat(t1, t2)))::DOUBLE ELSE 0.5 END AS tags FROM l WHERE pid IS NOT NULL)
SELECT id, round(arc, 6) AS arc, round(phase, 6) AS phase, round(tags, 6) AS tags,
  round(CASE WHEN a1 IS NULL THEN (0.4::DOUBLE * 0.5 + 0.15::DOUBLE * 0.5) / 0.55::DOUBLE ELSE 0.4::DOUBLE * 0.5 + 0.2::DOUBLE * arc + 0.15::DOUBLE * phase + 0.15::DOUBLE * 0.5 + 0.1::DOUBLE * tags END, 6) AS score FROM s""",
    "outcome_matches": f"""WITH l AS (SELECT id, title b, lag(title) OVER (PARTITION BY scope_id ORDER BY start_date, id) a FROM episodes WHERE scope_id IS NOT NULL AND start_date IS NOT NULL AND title IS NOT NULL)
SELECT id, {_OVERLAP}::INT AS overlap, {_OVERLAP} >= 2 OR coalesce({_OVERLAP} / nullif({_LEAST}, 0)::DOUBLE >= 0.3::DOUBLE, false) AS loose,
  {_OVERLAP} >= 2 OR coalesce({_OVERLAP} / nullif({_LEAST}, 0)::DOUBLE >= 0.5::DOUBLE, false) AS strict FROM l WHERE a IS NOT NULL""",
    "partial_dates": """SELECT id, strftime(CASE date_precision WHEN 'year' THEN date_trunc('year', start_date) WHEN 'month' THEN date_trunc('month', start_date) ELSE start_date END, '%Y-%m-%d') AS first_day,
  strftime(CASE date_precision WHEN 'year' THEN make_date(year(start_date), 12, 31) WHEN 'month' THEN last_day(start_date) ELSE start_date::DATE END, '%Y-%m-%d') AS last_day FROM episodes WHERE start_date IS NOT NULL""",
    "surface_text": r"""SELECT id, concat_ws(chr(10), title, summary) AS surface, 'What is the likely outcome of ''' || coalesce(title, '') || '''' ||
  CASE WHEN arc_type IS NULL THEN '' ELSE ' (' || arc_type || ', ' || coalesce(arc_phase, 'unknown') || ' phase)' END || '?' AS question FROM episodes""",
    "json_fields": "SELECT event_type, coalesce(json_valid(props), false) AS valid, count(*) AS events FROM events GROUP BY ALL",
    "knn_topk": """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS neighbour_id, list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[])
    / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))) AS s
  FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, neighbour_id)::INT AS rank FROM s)
SELECT query_id, rank, neighbour_id, round(s, 5) AS similarity FROM r WHERE rank <= 5""",
    "cluster_stats": """WITH v AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS pos_, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT label, pos_, avg(x) AS c FROM v GROUP BY ALL),
d AS (SELECT label, vec_id, sqrt(sum((x - c) ** 2)) AS d FROM v JOIN c USING (label, pos_) GROUP BY ALL)
SELECT label, count(*) AS members, round(avg(d), 5) AS mean, round(stddev_pop(d), 5) AS spread, arg_min(vec_id, (round(d, 6), vec_id)) AS typical FROM d GROUP BY label""",
    "stream_tumbling": "SELECT event_type, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_sliding": """SELECT event_type, strftime(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2000-01-01') - k * INTERVAL 6 HOURS, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS events, round(sum(value), 4) AS total
FROM events, range(4) r(k) GROUP BY ALL""",
    "stream_session": """WITH l AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS events, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""",
    "stream_dedupe": "SELECT DISTINCT user_id, event_type FROM events",
}
