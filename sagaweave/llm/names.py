"""Linking the spellings of one person, organisation or unfolding.

Names are parsed into a core (surname; partners of a house; polity) and the rest (given names; line
of business; arc, form of state and period). Distinct cores are compared by MinHash banding over the
padded q-grams of their words, with the bands chosen from the collision curve so that a core with
the allowed typing errors is met with a wanted recall. Names whose cores meet are verified by
Monge-Elkan similarity, every word of the shorter name taking its best partner, where a nickname, an
abbreviation or an initial is a partner of the full word. The verified links are clustered by star
clustering: the fullest and best connected spelling of a neighbourhood is its centre.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Scratch

Q = 2
TARGET = 0.5  # Jaccard similarity of a core with two typing errors
RECALL = 0.98
ROWS = 4
ENOUGH = 0.86

# fixed values: given names with their familiar forms
_FAMILIAR = {
    "alexander": "alex alec sandy xander sascha lex", "augusta": "gussie gusta gus", "benjamin": "ben benny benji", "charlotte": "lottie lotte charlie",
    "dorothea": "dora dolly dot thea dorothy", "edward": "ned ed eddie ted teddy", "elizabeth": "liz eliza beth betty lizzie elsie bess libby",
    "frederick": "fred freddie fritz freddy", "gabriel": "gabe", "henry": "harry hal hank heinz", "isabella": "bella isa izzy belle",
    "james": "jim jamie jimmy", "john": "jack johnny jon", "katherine": "kate kitty kathy katie kay", "laurence": "larry laurie lorenz lars",
    "leopold": "leo poldi", "margaret": "maggie peggy greta meg daisy gretchen", "nicholas": "nick klaus nicky claus nico", "oliver": "ollie olly noll",
    "philip": "phil pip", "quentin": "quin", "robert": "bob rob bobby robin bert", "samuel": "sam sammy", "theodore": "theo ted teddy", "ursula": "ulla ursel uschi",
    "victoria": "vicky tori vic vicki", "william": "will bill wim billy willy", "xaver": "xavi xavier", "yolanda": "yola jola", "zachary": "zack zach zac",
    "thomas": "tom tommy", "richard": "dick rick richie", "anthony": "tony", "michael": "mike mick", "catherine": "cathy cate", "george": "georgie", "josephine": "josie jo",
    "maria": "mia mitzi", "eleanor": "nell nora ellie", "daniel": "dan danny", "matthew": "matt", "peter": "pete", "joseph": "joe joey", "helen": "nelly", "sarah": "sally sadie",
}
_TITLES = frozenset("mr mrs ms miss dr prof professor sir lady lord baron baroness count countess col colonel gen general minister president king queen prince princess duke duchess capt captain major lt rev father saint st".split())
# fixed values: words of business and of state with their short forms
_LINE = {
    "bnk": "bank", "bk": "bank", "banking": "bank", "house": "bank", "assurance": "insurance", "ins": "insurance", "soc": "society", "corp": "corporation", "mng": "mining", "mines": "mining",
    "co": "company", "trdg": "trading", "traders": "trading", "gld": "guild", "merch": "merchants", "ry": "railway", "rlwy": "railway", "railwaymens": "railway", "railwaymen": "railway",
    "bank": "bank", "insurance": "insurance", "society": "society", "corporation": "corporation", "mining": "mining", "company": "company", "trading": "trading", "guild": "guild",
    "merchants": "merchants", "railway": "railway", "union": "union",
}
_STATE = {
    "federation": "federation", "fed": "federation", "duchy": "duchy", "d": "duchy", "league": "league", "lg": "league", "republic": "republic", "rep": "republic", "r": "republic",
    "kingdom": "kingdom", "kgdm": "kingdom", "k": "kingdom", "l": "league", "f": "federation", "empire": "empire", "emp": "empire", "confederation": "confederation", "conf": "confederation",
}
_SMALL = frozenset("the of and u to in a an und et y de von van".split())
_FORMAL: dict[str, set[str]] = {}
for _full, _short in _FAMILIAR.items():
    _FORMAL.setdefault(_full, set()).add(_full)
    for _s in _short.split():
        _FORMAL.setdefault(_s, set()).add(_full)


def plain(text: str | None) -> str:
    """Lower case without accents, single spaces."""
    text = unicodedata.normalize("NFKD", (text or "").casefold()).replace("’", "'").replace("ß", "ss")
    return " ".join("".join(c for c in text if not unicodedata.combining(c)).split())


@lru_cache(maxsize=1 << 18)
def typos(a: str, b: str) -> int:
    """Edits between two words, a swap of neighbours being one."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 3:
        return 9
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(row[-1] + 1, one[j] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        two, one = one, row
    return one[-1]


def allowed(a: str, b: str) -> int:
    """Typing errors that two words of these lengths may differ by."""
    n = min(len(a), len(b))
    return 0 if n < 4 else 1 if n < 8 else 2


@lru_cache(maxsize=1 << 18)
def given_of(word: str) -> frozenset[str]:
    """The given names a word may stand for: itself, in full, or misspelled; empty if none is known."""
    if word in _FORMAL:
        return frozenset(_FORMAL[word])
    return frozenset(f for w, fs in _FORMAL.items() if len(w) >= 4 and typos(w, word) <= (1 if min(len(w), len(word)) < 7 else 2) for f in fs)


def _near(word: str, known: dict[str, str]) -> str | None:
    if word in known:
        return known[word]
    return next((v for w, v in known.items() if len(w) >= 5 and len(word) >= 5 and typos(w, word) <= (1 if len(w) < 8 else 2)), None)


def _person(name: str) -> tuple[list[str], list[str]]:
    words = re.findall(r"[^\W\d_]+\.?", plain(name).replace("'", ""))
    words = [w for w in words if w.rstrip(".") not in _TITLES]
    bare = [w.rstrip(".") for w in words]
    long = [i for i, w in enumerate(words) if len(bare[i]) >= 4 and not w.endswith(".") and not given_of(bare[i])]
    if not long:
        long = [i for i, w in enumerate(words) if len(bare[i]) >= 2 and not w.endswith(".")][-1:]
    core = max(long, key=lambda i: len(bare[i]), default=None)
    rest = [w for i, w in enumerate(words) if i != core]
    full = [w for w in rest if len(w.rstrip(".")) > 1]
    return [bare[core]] if core is not None else [], full or rest


def _firm(name: str) -> tuple[list[str], list[str]]:
    words = re.findall(r"[^\W\d_]+", plain(name).replace("'", ""))
    core, line = [], set()
    for w in words:
        if w in _SMALL:
            continue
        known = _near(w, _LINE)
        if known:
            line.add(known)
        elif len(w) > 1:
            core.append(w)
    return sorted(set(core)), sorted(line)


_YEARS = re.compile(r"(\d{3,4})\s*(?:[-–—/]|to|until|bis)\s*(\d{1,4})")


def _unfolding(name: str, arc: str | None, start: object, end: object) -> tuple[list[str], list[str]]:
    text = plain(name)
    found = _YEARS.search(text)
    years: list[int] = []
    if found:
        a, b = found.group(1), found.group(2)
        b = a[: len(a) - len(b)] + b if len(b) < len(a) else b
        years = sorted((int(a), int(b)))
    elif not (pd.isna(start) or pd.isna(end)):
        years = sorted((int(start), int(end)))
    kind = re.sub(r"[\W_]+", " ", plain(arc)).split()
    known = set(kind) | {w[0] for w in kind} | {"".join(w[0] for w in kind)}
    core, state = [], []
    for w in re.findall(r"[^\W\d_]+", text):
        form = _STATE.get(w) or (_near(w, _STATE) if len(w) >= 5 else None)
        if form and (len(w) > 1 or w not in known):
            state.append(form)
        elif w not in _SMALL and len(w) >= 4 and not any(typos(w, k) <= 2 for k in kind if len(k) >= 4):
            core.append(w)
    core = [max(core, key=len)] if core else []
    return core, [" ".join(kind), *state[:1], *map(str, years)]


def monge_elkan(tab: str, a: list[str], b: list[str]) -> float:
    """Mean over the words of the shorter list of the similarity to their best partner in the other."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 1.0 if not b else 0.0
    like = _alike_given if tab == "person" else _alike
    return sum(max(like(x, y) for y in b) for x in a) / len(a)


def _alike(x: str, y: str) -> float:
    if x == y:
        return 1.0
    d = typos(x, y)
    return 1 - 0.06 * d if d <= allowed(x, y) else 0.0


@lru_cache(maxsize=1 << 18)
def _alike_given(x: str, y: str) -> float:
    a, b = x.rstrip("."), y.rstrip(".")
    if a == b:
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 1:
        names = (given_of(b) | {b}) if not y.endswith(".") or len(b) > 1 else {b}
        return 0.9 if any(n.startswith(a) for n in names) else 0.0
    one, two = given_of(a), given_of(b)
    if one & two:
        return 0.97
    short = next((s for s in (x, y) if s.endswith(".")), None)
    if short and any(n.startswith(short[:-1]) for n in ((two | {b}) if short[:-1] == a else (one | {a}))):
        return 0.95
    return 1 - 0.05 * typos(a, b) if not (one and two) and typos(a, b) <= allowed(a, b) else 0.0


def same_name(tab: str, core_a: list[str], rest_a: list[str], core_b: list[str], rest_b: list[str]) -> float:
    """Similarity of two parsed names; 0 where they cannot be one entity."""
    if len(core_a) != len(core_b) or not core_a:
        return 0.0
    core = min(monge_elkan(tab="", a=core_a, b=core_b), monge_elkan(tab="", a=core_b, b=core_a))
    if core < 1 - 0.13:
        return 0.0
    if tab == "person":
        if not rest_a or not rest_b:
            return core if rest_a == rest_b else 0.0
        rest = monge_elkan(tab, rest_a, rest_b)
        return (core + rest) / 2 if rest >= 0.85 else 0.0
    if tab == "organisation":
        return core if rest_a == rest_b or (set(rest_a) & set(rest_b) and (not rest_a or not rest_b)) else 0.0
    if rest_a[:1] != rest_b[:1]:
        return 0.0
    years_a, years_b = ([int(w) for w in r[1:] if w.isdigit()] for r in (rest_a, rest_b))
    forms_a, forms_b = ([w for w in r[1:] if not w.isdigit()] for r in (rest_a, rest_b))
    if forms_a and forms_b and forms_a != forms_b:
        return 0.0
    if len(years_a) != len(years_b):
        return 0.0
    off = max((abs(x - y) for x, y in zip(years_a, years_b, strict=True)), default=0)
    return core - 0.03 * off if off <= 1 else 0.0


def bands(target: float, recall: float, rows: int = ROWS) -> int:
    """The least number of bands with which the collision curve 1 - (1 - t^rows)^b reaches ``recall`` at ``target``."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - target**rows)))


def q_grams(words: list[str]) -> set[str]:
    return {f"#{w}#"[i : i + Q] for w in words for i in range(len(w) + 3 - Q)}


_PRIME = (1 << 61) - 1


def _band_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n = bands(TARGET, RECALL)
    rng = np.random.default_rng(20011)
    mul = rng.integers(1, 1 << 31, n * ROWS, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 1 << 62, n * ROWS, dtype=np.uint64)
    cache: dict[str, int] = {}

    def code(g: str) -> int:
        if g not in cache:
            h = 1469598103934665603
            for byte in g.encode():
                h = ((h ^ byte) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
            cache[g] = h ^ (h >> 29)
        return cache[g]

    for pdf in batches:
        core_ids, keys = [], []
        for c, words in zip(pdf["core"], pdf["words"], strict=True):
            h = np.array([code(g) for g in q_grams(list(words))], dtype=np.uint64)
            mixed = h[:, None] * mul[None] + add[None]
            mixed ^= mixed >> np.uint64(31)
            low = (mixed * np.uint64(0x9E3779B97F4A7C15)).min(axis=0).reshape(n, ROWS)
            key = np.arange(n, dtype=np.uint64)
            for j in range(ROWS):
                key = (key ^ low[:, j]) * np.uint64(0xBF58476D1CE4E5B9)
                key ^= key >> np.uint64(27)
            core_ids += [c] * n
            keys.append(key.view(np.int64))
        yield pd.DataFrame({"core": core_ids, "band": np.concatenate(keys) if keys else np.zeros(0, np.int64)})


def star_clusters(vertices: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, centre): star clustering of ``links`` (a, b, similarity) over ``vertices`` (v, weight).

    A vertex of larger weight, then degree, then smaller id comes before its neighbours. Round by
    round the vertices that come before all their undecided neighbours become centres and take
    these neighbours in, each to its most similar centre. Vertices without links are centres.
    """
    both = links.select(F.col("a").alias("v"), F.col("b").alias("o"), "similarity")
    both = both.unionByName(links.select(F.col("b").alias("v"), F.col("a").alias("o"), "similarity"))
    degree = both.groupBy("v").agg(F.count("*").alias("degree"))
    rank = scratch.cut(vertices.join(degree, "v", "left").select("v", F.struct("weight", F.coalesce("degree", F.lit(0)).alias("degree"), F.col("v").alias("id")).alias("rank")))
    edges = both.join(rank, "v").join(rank.select(F.col("v").alias("o"), F.col("rank").alias("o_rank")), "o")
    edges = scratch.cut(edges)
    decided = [rank.join(edges.select("v").distinct(), "v", "left_anti").select("v", F.col("v").alias("centre"))]
    seen = {"n": 1}
    while seen["n"]:
        top = edges.groupBy("v").agg(F.max(F.struct(F.col("o_rank") > F.col("rank"))).alias("below"))
        centres = scratch.cut(top.where("not below.col1").select(F.col("v").alias("o")))
        taken = edges.join(centres, "o").groupBy("v").agg(F.max(F.struct("similarity", "o_rank", "o")).alias("best"))
        taken = scratch.cut(taken.select("v", F.col("best.o").alias("centre")))
        decided += [centres.select(F.col("o").alias("v"), F.col("o").alias("centre")), taken]
        gone = centres.select(F.col("o").alias("v")).unionByName(taken.select("v"))
        left = edges.join(gone, "v", "left_anti").join(gone.withColumnRenamed("v", "o"), "o", "left_anti").select(*edges.columns)
        alone = edges.select("v").distinct().join(gone, "v", "left_anti").join(left.select("v").distinct(), "v", "left_anti")
        decided.append(scratch.cut(alone.select("v", F.col("v").alias("centre"))))
        edges, seen = scratch.counted(left)
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out


FORM = "tab string, kind string, id string, core array<string>, rest array<string>"


def _parsed(rows: DataFrame, tab: str) -> DataFrame:
    """``rows``: id, name, kind (person, organisation, unfolding), arc, start, end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.kind == "unfolding":
                    core, rest = _unfolding(r.name, r.arc, r.start, r.end)
                else:
                    core, rest = (_firm if r.kind == "organisation" else _person)(r.name)
                if core:
                    out.append((tab, r.kind, r.id, core, rest))
            yield pd.DataFrame(out, columns=["tab", "kind", "id", "core", "rest"])

    return rows.mapInPandas(run, FORM)


def linked_names(parsed: DataFrame) -> DataFrame:
    """(tab, id, entity) of the parsed names; entity is the smallest id of the entity.

    Rows of one table and kind are linked, repeated ids count once, names without a usable word name
    nothing. Equal spellings are compared once, whatever their number.
    """
    scratch = Scratch(parsed.sparkSession, "names")
    rows = scratch.cut(parsed.withColumn("core_key", F.array_join("core", " ")).withColumn("rest_key", F.array_join("rest", " ")).dropDuplicates(["tab", "id"]))
    forms = scratch.cut(rows.groupBy("tab", "kind", "core_key", "rest_key").agg(F.first("core").alias("core"), F.first("rest").alias("rest"), F.count("*").alias("n")))
    cores = forms.groupBy("tab", "kind", "core_key").agg(F.first("core").alias("words"))
    keyed = cores.select(F.concat_ws("|", "tab", "kind", "core_key").alias("core"), "words").repartition("core").mapInPandas(_band_keys, "core string, band long")
    keyed = keyed.withColumn("group", F.substring_index("core", "|", 2))
    keyed = scratch.cut(keyed)
    # nothing is bounded: a bucket is met by its pairs, which are few as cores are distinct
    met = keyed.select(F.col("core").alias("a"), "band", "group").join(keyed.select(F.col("core").alias("b"), "band", "group"), ["band", "group"]).where("a < b").select("a", "b")
    # most meetings are chance, or houses that share one partner: before Python sees a pair, every word of a
    # core must have one within reach in the other (a swap counts 2 in this distance)
    word = lambda c: F.split(F.substring_index(c, "|", -1), " ")
    within = F.forall(word("a"), lambda x: F.exists(word("b"), lambda y: F.levenshtein(x, y, 4) >= 0))
    met = met.where((F.size(word("a")) == F.size(word("b"))) & within).distinct()

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for a, b in zip(pdf["a"], pdf["b"], strict=True):
                x, y = a.split("|", 2)[2].split(" "), b.split("|", 2)[2].split(" ")
                keep.append(len(x) == len(y) and min(monge_elkan("", x, y), monge_elkan("", y, x)) >= 1 - 0.13)
            yield pdf[keep]

    pairs = scratch.cut(met.mapInPandas(near, "a string, b string"))
    named = forms.select(F.concat_ws("|", "tab", "kind", "core_key").alias("c"), F.concat_ws("|", "tab", "kind", "core_key", "rest_key").alias("v"), "kind", "core", "rest", "n")
    named = scratch.cut(named)
    left, right = (named.select(*[F.col(x).alias(f"{s}_{x}") for x in named.columns]) for s in "ab")
    own = left.join(right, F.col("a_c") == F.col("b_c")).where("a_v < b_v")
    other = left.join(pairs, F.col("a_c") == F.col("a")).join(right, F.col("b_c") == F.col("b")).select(*own.columns)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = [same_name(r.a_kind, list(r.a_core), list(r.a_rest), list(r.b_core), list(r.b_rest)) for r in pdf.itertuples(index=False)]
            out = pd.DataFrame({"a": pdf["a_v"], "b": pdf["b_v"], "similarity": s})
            yield out[out["similarity"] >= ENOUGH]

    links = scratch.cut(own.unionByName(other).mapInPandas(verify, "a string, b string, similarity double"))
    # the fullest spelling leads: the one with the longest given name or word of business
    full = F.when(F.col("kind") == "person", F.aggregate("rest", F.lit(0), lambda n, w: n + F.when(w.endswith("."), 0).otherwise(F.least(F.length(w), F.lit(6))))).otherwise(F.lit(0))
    stars = star_clusters(named.select("v", F.struct(full.alias("full"), "n").alias("weight")), links, scratch)
    stars = scratch.cut(stars)
    told = rows.select("tab", "id", F.concat_ws("|", "tab", "kind", "core_key", "rest_key").alias("v")).join(stars, "v")
    least = Window.partitionBy("tab", "centre")
    return scratch.cut(told.withColumn("entity", F.min("id").over(least)).select("tab", "id", "entity"))


def name_rows(actors: DataFrame, instances: DataFrame) -> DataFrame:
    """The parsed names of both tables; actors of kind collective, null names and null ids name nothing."""
    none = F.lit(None).cast("int")
    kind = F.coalesce(F.lower(F.trim(F.col("attributes")["kind"])), F.lit("person"))
    people = actors.where("id is not null and name is not null").select(
        "id", "name", F.when(kind == "organisation", kind).when(kind == "collective", kind).otherwise("person").alias("kind"),
        F.lit(None).cast("string").alias("arc"), none.alias("start"), none.alias("end"),
    ).where("kind <> 'collective'")
    order = Window.partitionBy("id").orderBy(F.desc_nulls_last("updated_at"), "canonical_name")
    runs = instances.where("id is not null and canonical_name is not null").withColumn("__r", F.row_number().over(order)).where("__r = 1").select(
        "id", F.col("canonical_name").alias("name"), F.lit("unfolding").alias("kind"), F.col("arc_type").alias("arc"),
        F.year("start_date").alias("start"), F.year("end_date").alias("end"),
    )
    return _parsed(people, "actors").unionByName(_parsed(runs, "arc_instances"))


def name_pairs(actors: DataFrame, instances: DataFrame) -> DataFrame:
    """(tab, id_a, id_b): every pair of different ids of a table that name one entity, id_a < id_b."""
    told = linked_names(name_rows(actors, instances))
    other = told.select("tab", "entity", F.col("id").alias("id_b"))
    return told.withColumnRenamed("id", "id_a").join(other, ["tab", "entity"]).where("id_a < id_b").select("tab", "id_a", "id_b")
