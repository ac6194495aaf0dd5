"""Mapping free-text roles to the controlled vocabulary.

The words of all names, aliases and glosses form a BK-tree under the edit distance with
swaps, a true metric. A role means an entry if its words, hedges taken off, are those of the entry's name or
of an alias in any order, or at least two words of its gloss with at most one other; words may be misspelled, inflected
or abbreviated. Every distinct role is looked up once in every shard of the reference list, and
the winners of the shards merge by cost.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch

UNMATCHED = "unmatched"
SHARD = 4096  # reference entries searched at a time
_NONE = (1e9, UNMATCHED)
_STOP = frozenset("a an the of their its his her who whose by in to and or as for it those that on with yet at not one from be is".split())
_HEDGES = [
    re.compile(p)
    for p in (
        r"^(?:an?|the)\s+", r"^one\s+(?=.*\samong several$)", r"\s+among several$", r"^(?:acting|former|de facto|self styled|so called|alleged|supposed|then|ex)\s+",
        r"\s+(?:so called|at the time|in effect|of the (?:north|south|east|west)|of sorts|by name|in all but name)$",
    )
]
_SHORT = {"bk": "bank", "govt": "government", "gov": "government", "cttee": "committee", "dept": "department", "soc": "society"}
_SUFFIX = re.compile(r"(?:ings?|ers?|ors?|eds?|ies|es|s|y|ed|e)$")


def _plain(text: str) -> str:
    text = unicodedata.normalize("NFKD", text.casefold()).replace("’", "'")
    text = "".join(c for c in text if not unicodedata.combining(c)).replace("'s", "s").replace("'", "")
    return " ".join(re.sub(r"[^a-z.]+", " ", re.sub(r"\.(?=\w)", ". ", text)).split())


def _stem(word: str) -> str:
    short = _SUFFIX.sub("", word)
    return short if len(short) >= 3 else word


def distance(a: str, b: str) -> int:
    """Damerau-Levenshtein distance: inserted, dropped, changed or swapped letters; a true metric."""
    seen: dict[str, int] = {}
    far = len(a) + len(b)
    rows = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, swap = [far, i], 0
        for j, y in enumerate(b, 1):
            k, last = seen.get(y, 0), swap
            if x == y:
                swap = j
            row.append(
                min(rows[i][j] + (x != y), row[j] + 1, rows[i][j + 1] + 1, rows[k][last] + (i - k - 1) + 1 + (j - last - 1))
            )
        seen[x] = i
        rows.append(row)
    return rows[-1][-1]


class BKTree:
    """Words by their distance to the word above them."""

    def __init__(self, words: list[str]):
        self.root: tuple[str, dict] | None = None
        for w in words:
            self.add(w)

    def add(self, word: str) -> None:
        if self.root is None:
            self.root = (word, {})
            return
        node = self.root
        while d := distance(word, node[0]):
            if d not in node[1]:
                node[1][d] = (word, {})
                return
            node = node[1][d]

    def near(self, word: str, most: int) -> list[tuple[int, str]]:
        out, open_nodes = [], [self.root] if self.root else []
        while open_nodes:
            w, below = open_nodes.pop()
            d = distance(word, w)
            if d <= most:
                out.append((d, w))
            # by the triangle inequality nothing within reach lies under another edge
            open_nodes += [n for k, n in below.items() if d - most <= k <= d + most]
        return sorted(out)


class RoleIndex:
    """Entries of the vocabulary by the words of their phrases."""

    def __init__(self, entries: list[tuple[str, str | None, list[str] | None]]):
        self.exact: dict[str, str] = {}
        self.glosses: list[tuple[str, str]] = []
        self.phrases: list[tuple[str, frozenset[str], bool]] = []
        for name, gloss, aliases in sorted(entries, key=lambda e: e[0]):
            for phrase, whole in [(name, True), *((a, True) for a in aliases or [] if a), *([(gloss, False)] if gloss else [])]:
                plain = _plain(phrase)
                if not whole:
                    self.glosses.append((plain.replace(" ", "").replace(".", ""), name))
                if whole:
                    self.exact.setdefault(plain, name)
                self.phrases.append((name, frozenset(w for w in plain.replace(".", "").split() if w not in _STOP), whole))
        self.words = sorted({w for _, ws, _ in self.phrases for w in ws})
        self.known, self.stems = set(self.words), {}
        for w in self.words:
            self.stems.setdefault(_stem(w), []).append(w)
        self.tree, self.stem_tree = BKTree(self.words), BKTree(sorted(self.stems))
        self.joined = {p.replace(" ", ""): n for p, n in self.exact.items()}
        for phrase, name in self.glosses:
            self.joined.setdefault(phrase, name)
        self.joined_tree = BKTree(sorted(self.joined))
        self.match = lru_cache(maxsize=1 << 16)(self._match)
        self.alike = lru_cache(maxsize=1 << 16)(self._alike)

    def _alike(self, token: str) -> dict[str, float]:
        """Words of the vocabulary that ``token`` may stand for, with a cost."""
        bare = token.rstrip(".")
        stem = _stem(bare)
        out = {w: 0.2 for w in self.stems.get(stem, ())}
        if bare in self.known:
            out[bare] = 0
        for w in self.words if token.endswith(".") or bare in _SHORT or len(bare) >= 3 and _vowels(bare[1:-1]) == 0 else ():
            if w in out:
                continue
            if token.endswith(".") and len(bare) >= 2 and w.startswith(bare) or _SHORT.get(bare) == w:
                out[w] = 0.5
            elif len(w) - len(bare) >= 2 and bare[0] == w[0] and bare[-1] == w[-1] and _skips(bare, w):
                out[w] = 0.5
        if out:
            return out
        allow = 0 if len(bare) < 4 else 1 if len(bare) < 8 else 2
        if allow:
            out = {w: d for d, w in self.tree.near(bare, allow) if len(w) >= 4}
        if len(stem) >= 4:
            for d, found in self.stem_tree.near(stem, 1):
                for w in self.stems[found] if len(found) >= 4 else ():
                    out[w] = min(out.get(w, 9), d + 0.2)
        return out

    def _variants(self, plain: str) -> list[str]:
        out = [plain]
        for v in out:
            out += [s for h in _HEDGES if (s := h.sub("", v)) and s != v and s not in out]
        return out

    def _match(self, role: str | None) -> tuple[float, str]:
        """(cost, entry) of the entry the role means; the cost is infinite for ``unmatched``."""
        if not role or not (plain := _plain(role)):
            return _NONE
        variants = self._variants(plain)
        for v in variants:
            if (bare := v.replace(".", "")) in self.exact:
                return 0.0, self.exact[bare]
        best: tuple[float, str] | None = None
        for k, v in enumerate(variants):
            tokens = [t for t in v.split() if t.rstrip(".") and t.rstrip(".") not in _STOP]
            if not tokens:
                continue
            alike = [self.alike(t) for t in tokens]
            for name, words, whole in self.phrases:
                cost, used, missed = 0.1 * k, set(), 0
                for options in alike:
                    fit = min(((c, w) for w, c in options.items() if w in words and w not in used), default=None)
                    if fit is None:
                        missed += 1
                    else:
                        cost += fit[0]
                        used.add(fit[1])
                if whole:
                    ok = not missed and len(used) == len(words)
                else:
                    ok = len(used) >= 2 and missed <= 1
                    cost += 1 + missed
                if ok and cost <= 1 + 1.5 * len(tokens) and (best is None or (cost, name) < best):
                    best = (cost, name)
        return best or self._run_together(variants)

    def _run_together(self, variants: list[str]) -> tuple[float, str]:
        """The entry whose name or alias the role is, spaces left out or misplaced."""
        for v in variants:
            bare = v.replace(" ", "").replace(".", "")
            near = self.joined_tree.near(bare, 1 if len(bare) < 12 else 2) if len(bare) >= 7 else []
            if near:
                return 1e6 + near[0][0], self.joined[near[0][1]]
        return _NONE


def _vowels(letters: str) -> int:
    return sum(c in "aeiou" for c in letters)


def _skips(short: str, word: str) -> bool:
    """Whether ``short`` is ``word`` with letters left out."""
    letters = iter(word)
    return all(c in letters for c in short)


def mapped_roles(
    actors: DataFrame, vocabulary: DataFrame, actor_id: str = "id", role: str = "role", canonical: str = "canonical_role"
) -> DataFrame:
    """(actor_id, canonical_role): the entry each role means, or ``unmatched``; actors are given once each.

    Null or empty roles are unmatched, an empty reference list matches nothing, an actor that comes
    with several roles gets the entry of least cost. The reference list goes through the driver a
    shard of at most ``SHARD`` entries at a time; the actors never do.
    """
    scratch = Scratch(actors.sparkSession, "roles")
    known = scratch.cut(actors.select(F.col(actor_id).alias("actor_id"), F.col(role).alias("role")).distinct())
    roles = scratch.cut(known.where("role is not null").select("role").distinct())
    listed = vocabulary.select(canonical, "gloss", "aliases").where(F.col(canonical).isNotNull())
    found = None
    rows = listed.toLocalIterator()
    while entries := [tuple(r) for r in islice(rows, SHARD)]:
        part = roles.mapInPandas(_searcher(entries), "role string, cost double, name string")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return known.select("actor_id", F.lit(UNMATCHED).alias("canonical_role")).distinct()
    best = found.groupBy("role").agg(F.min(F.struct("cost", "name")).alias("best"))
    # the winners are as many as distinct roles; a hot role is one row on that side
    told = known.join(best, "role", "left").select("actor_id", F.coalesce("best", F.struct(F.lit(_NONE[0]).alias("cost"), F.lit(UNMATCHED).alias("name"))).alias("best"))
    return told.groupBy("actor_id").agg(F.min("best").alias("best")).select("actor_id", F.col("best.name").alias("canonical_role"))


def _searcher(entries: list[tuple]):
    index: list[RoleIndex] = []

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not index:
            index.append(RoleIndex(entries))
        for pdf in batches:
            told = [index[0].match(r) for r in pdf["role"]]
            yield pd.DataFrame({"role": pdf["role"], "cost": [float(c) for c, _ in told], "name": [n for _, n in told]})

    return scan
