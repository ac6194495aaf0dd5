"""Scores, normalisations and gates as column expressions; all stay inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: orders of phases, related arcs, phase categories, days per scale
PHASE_ORDER = {
    "credit_boom_and_bust": ["boom", "euphoria", "distress", "panic", "revulsion"],
    "hubris_nemesis": ["setup", "rising_action", "climax", "falling_action", "resolution"],
}
RELATED_ARCS = {
    "credit_boom_and_bust": ["rise_and_overextension", "hubris_nemesis"],
    "hubris_nemesis": ["tragedy", "rise_and_overextension"],
    "hero_journey": ["rebirth", "voyage_return"],
}
PHASE_CATEGORY = {
    "early": ["setup", "boom"],
    "middle": ["rising_action", "euphoria", "climax", "distress"],
    "late": ["falling_action", "panic", "resolution", "revulsion"],
}
SCALE_DAYS = {"episodic": 730, "institutional": 1825, "generational": 3650, "civilizational": 14600}


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def scope_key(c: Column) -> Column:
    """Lower case, no leading article, no punctuation, single spaces (X-01)."""
    bare = F.regexp_replace(F.trim(F.lower(c)), r"^the\s+", "")
    return collapse_space(F.regexp_replace(bare, r"(?U)[^\w\s]", ""))


def actor_key(c: Column) -> Column:
    """Lower case, no punctuation, single spaces (X-02)."""
    return collapse_space(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", ""))


def slug(c: Column) -> Column:
    """Lower case with hyphens for everything else (X-03)."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def document_kind(c: Column) -> Column:
    """Kind of a document by the words of its name (X-04)."""
    low = F.lower(c)
    return (
        F.when(low.rlike("timeline|chronology"), "timeline").when(low.contains("chapter"), "chapter")
        .when(low.rlike("article|paper"), "article").otherwise("book")
    )


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def token_estimate(c: Column) -> Column:
    """Words over 0.75, rounded down (X-06)."""
    return F.floor(F.size(words(c)) / F.lit(0.75)).cast("long")


def word_overlap(a: Column, b: Column) -> Column:
    """Number of distinct lower-case words in common (X-12)."""
    return F.size(F.array_intersect(words(F.lower(a)), words(F.lower(b))))


def outcome_match(a: Column, b: Column, share: float) -> Column:
    """At least two words in common, or ``share`` of the shorter text's distinct words (X-13, X-14, X-15)."""
    least = F.least(F.size(F.array_distinct(words(F.lower(a)))), F.size(F.array_distinct(words(F.lower(b)))))
    return (word_overlap(a, b) >= 2) | F.coalesce(word_overlap(a, b) / F.nullif(least, F.lit(0)) >= share, F.lit(False))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements; 0.5 where a side is missing or empty (U-03, U-04)."""
    some = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(some, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.5)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where a side has no length (M-01)."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def _cases(pairs: list[tuple[Column, object]], other: object) -> Column:
    return reduce(lambda acc, p: F.when(p[0], p[1]).otherwise(acc), reversed(pairs), other if isinstance(other, Column) else F.lit(other))


def arc_match(query: Column, candidate: Column) -> Column:
    """1 equal, 0.6 related (one way), 0.1 other, 0.5 unknown (M-04)."""
    related = reduce(lambda x, y: x | y, [(query == q) & candidate.isin(*cs) for q, cs in RELATED_ARCS.items()])
    return _cases([(query.isNull() | candidate.isNull(), 0.5), (query == candidate, 1.0), (related, 0.6)], 0.1)


def phase_index(arc: Column, phase: Column) -> Column:
    """Place of a phase in its arc's order from 0; null where there is none (M-06, W-11)."""
    known = [(arc == a, F.nullif(F.array_position(F.array(*map(F.lit, ps)), phase), F.lit(0)) - 1) for a, ps in PHASE_ORDER.items()]
    return _cases(known, F.lit(None).cast("long"))


def phase_category(phase: Column) -> Column:
    """early, middle or late (M-07)."""
    return _cases([(phase.isin(*ps), F.lit(c)) for c, ps in PHASE_CATEGORY.items()], F.lit(None).cast("string"))


def phase_compatibility(arc_a: Column, phase_a: Column, arc_b: Column, phase_b: Column) -> Column:
    """How near two phases are in their arc, or else by category (M-05)."""
    apart = F.abs(phase_index(arc_a, phase_a) - phase_index(arc_b, phase_b))
    return _cases(
        [
            (phase_a.isNull() | phase_b.isNull(), 0.5),
            ((arc_a == arc_b) & (phase_a == phase_b), 1.0),
            ((arc_a == arc_b) & (apart == 1), 0.7),
            ((arc_a == arc_b) & (apart == 2), 0.4),
            (phase_category(phase_a) == phase_category(phase_b), 0.6),
        ],
        0.3,
    )


def phase_sequence(arc: Column, phase_a: Column, phase_b: Column) -> Column:
    """1 for the next phase, less for later ones, 0 for the same or an earlier one, 0.5 unknown (M-09)."""
    step = phase_index(arc, phase_b) - phase_index(arc, phase_a)
    return _cases([(step.isNull(), 0.5), (step == 1, 1.0), (step > 0, F.greatest(F.lit(0.0), 1 - (step - 1) * 0.3))], 0.0)


def temporal_proximity(end_a: Column, start_b: Column, scale: str = "institutional") -> Column:
    """1 on overlap, fading with the gap in whole days, 0 beyond twice the scale's days, 0.5 unknown (D-03)."""
    days = SCALE_DAYS.get(scale, SCALE_DAYS["institutional"])
    gap = F.floor((F.unix_micros(start_b.cast("timestamp")) - F.unix_micros(end_a.cast("timestamp"))) / F.lit(86_400_000_000.0))
    return _cases([(gap.isNull(), 0.5), (gap < 0, 1.0), (gap > 2 * days, 0.0)], F.exp(-3.0 * gap / days))


def combined_score(vector: Column, arc: Column, phase: Column, cycle: Column, mechanism: Column, arcless: Column) -> Column:
    """Weighted sum of the partial scores; without an arc only vector and cycle count (M-08)."""
    return F.when(arcless, (0.4 * vector + 0.15 * cycle) / 0.55).otherwise(0.4 * vector + 0.2 * arc + 0.15 * phase + 0.15 * cycle + 0.1 * mechanism)


def brier(p: Column, outcome: Column) -> Column:
    """Squared error of a forecast; values outside their range are an error (M-14)."""
    bad = (p < 0) | (p > 1) | ~outcome.isin(0, 1)
    return F.when(bad, F.raise_error(F.lit("forecast outside [0, 1] or outcome not 0 or 1")).cast("double")).otherwise((p - outcome) ** 2)


def era(c: Column, years: int = 50) -> Column:
    """First year of the era, or ``undated`` (A-13)."""
    return F.coalesce((F.floor(F.year(c) / years) * years).cast("string"), F.lit("undated"))
