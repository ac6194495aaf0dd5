"""Evaluation passages that occur, whole or in part, in a training corpus.

The test items form a BM25 inverted index whose terms are word trigrams. Every corpus text,
as a whole, is cut into overlapping training passages; each passage is a query, and
block-max WAND returns all items whose score reaches that item's own threshold. The
threshold is derived, not tuned: the least score that ``min_words`` consecutive words of
the item can have after the allowed number of edits, so no true case is lost. Retrieved
pairs are then verified exactly by counting words in order and edits between them.

The index is small and fixed in size next to the corpus; items beyond ``SHARD_WORDS`` words
are indexed in shards, each broadcast in turn, so what is broadcast has a bound.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch

SHARD_WORDS = 60_000
BLOCK = 8
K1, B = 1.2, 0.75
STRIDE = 16

# a number in brackets, or alone on its line, with at most one short word beside it
_PAGE = re.compile(r"[\[(]\s*(?:[^\W\d_]{1,6}\.?\s*)?\d{1,5}\s*[\])]|^[ \t>]*[-–—]?[ \t]*(?:[^\W\d_]{1,6}\.?[ \t]*)?\d{1,5}[ \t]*[-–—]?[ \t]*$", re.M)
_BROKEN = re.compile(r"(?<=\w)[-‐‑]\s*\n[\s>]*(?=\w)")
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str | None) -> list[str]:
    """The words of a text without regard to case, punctuation, typography, layout and page marks."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).replace("­", "").replace("​", "")
    text = text.casefold()
    if "[" in text or "(" in text or "\n" in text:
        text = _BROKEN.sub("", _PAGE.sub(" ", text))
    return _WORD.findall(text)


def split_closing(passage: str | None) -> tuple[str, str]:
    """(the passage without its last sentence, that sentence)."""
    whole = (passage or "").strip()
    last = _SENTENCE.split(whole)[-1]
    return whole[: len(whole) - len(last)], last


class PassageIndex:
    """BM25 over word trigrams with block maxima, and the thresholds of its items."""

    def __init__(self, items: list[tuple[int, list[str]]], min_words: int, per_edit: int):
        self.ids = [i for i, _ in items]
        self.min_words, self.per_edit = min_words, per_edit
        self.vocab: dict[str, int] = {}
        self.words = [np.array([self.vocab.setdefault(w, len(self.vocab)) for w in ws], dtype=np.int64) for _, ws in items]
        self.base = max(2, len(self.vocab))
        grams = [self.grams(w) for w in self.words]
        df = Counter(g for ks in grams for g in set(ks.tolist()))
        self.keys = np.array(sorted(df), dtype=np.int64)
        n, mean = len(items), max(1.0, float(np.mean([len(k) for k in grams] or [1])))
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        self.theta = np.full(n, np.inf)
        for at, ks in enumerate(grams):
            norm = K1 * (1 - B + B * len(ks) / mean)
            impact = {g: math.log(1 + (n - df[g] + 0.5) / (df[g] + 0.5)) * tf * (K1 + 1) / (tf + norm) for g, tf in Counter(ks.tolist()).items()}
            for g, s in impact.items():
                postings[g].append((at, s))
            self.theta[at] = self._least(ks, impact)
        where = {g: k for k, g in enumerate(self.keys.tolist())}
        self.posts = [None] * len(self.keys)
        self.top = np.zeros(len(self.keys))
        self.peaks = np.zeros((len(self.keys), n // BLOCK + 1), dtype=np.float32)
        self.least = np.full(n // BLOCK + 1, np.inf)
        np.minimum.at(self.least, np.arange(n) // BLOCK, self.theta)
        for g, ps in postings.items():
            at = np.array([p for p, _ in ps])
            s = np.array([x for _, x in ps])
            last = [int(at[min(b + BLOCK, len(at)) - 1]) for b in range(0, len(at), BLOCK)]
            peak = [float(s[b : b + BLOCK].max()) for b in range(0, len(at), BLOCK)]
            self.posts[where[g]] = (at.tolist(), s.tolist(), last, peak)
            self.top[where[g]] = s.max()
            np.maximum.at(self.peaks[where[g]], at // BLOCK, s)
        self.floor = float(self.theta.min()) if n else np.inf

    def grams(self, ids: np.ndarray) -> np.ndarray:
        """Trigram keys of known words; -1 where a word is unknown."""
        if len(ids) < 3:
            return np.empty(0, dtype=np.int64)
        a, b, c = ids[:-2], ids[1:-1], ids[2:]
        return np.where((a < 0) | (b < 0) | (c < 0), -1, (a * self.base + b) * self.base + c)

    def _least(self, ks: np.ndarray, impact: dict[int, float]) -> float:
        """The least score of any ``min_words`` words in a row after the allowed edits.

        An edit spoils at most three neighbouring trigrams; of repeated trigrams one counts.
        """
        edits, span = self.min_words // self.per_edit, self.min_words - 2
        if len(ks) < span or span < 1:
            return np.inf
        keys, best = ks.tolist(), np.inf
        for i in range(len(keys) - span + 1):
            seen, row = set(), []
            for g in keys[i : i + span]:
                row.append(0.0 if g in seen else impact[g])
                seen.add(g)
            runs = np.convolve(row, np.ones(3))
            best = min(best, sum(row) - edits * float(runs.max()))
        return max(best, 1e-9)

    def lookup(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word ids, trigram slots) of a text; -1 for what no item has."""
        ids = np.array(list(map(self.vocab.get, words, repeat(-1))), dtype=np.int64)
        ks = self.grams(ids)
        if not len(ks) or not len(self.keys):
            return ids, np.full(len(ks), -1)
        slot = np.full(len(ks), -1)
        known = np.flatnonzero(ks >= 0)
        if len(known):
            at = np.minimum(np.searchsorted(self.keys, ks[known]), len(self.keys) - 1)
            slot[known] = np.where(self.keys[at] == ks[known], at, -1)
        return ids, slot

    def wand(self, terms: list[int]) -> list[int]:
        """All items whose score over ``terms`` reaches their threshold, by block-max WAND."""
        cursor = {t: 0 for t in terms}
        live, found = list(terms), []
        while live:
            live.sort(key=lambda t: self.posts[t][0][cursor[t]])
            bound, pivot = 0.0, -1
            for k, t in enumerate(live):
                bound += self.top[t]
                if bound >= self.floor:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = self.posts[live[pivot]][0][cursor[live[pivot]]]
            while pivot + 1 < len(live) and self.posts[live[pivot + 1]][0][cursor[live[pivot + 1]]] == item:
                pivot += 1
            # the maxima of the blocks that would hold the pivot item
            block, ends = 0.0, []
            for t in live[: pivot + 1]:
                last, peak = self.posts[t][2], self.posts[t][3]
                b = cursor[t] // BLOCK
                while b < len(last) and last[b] < item:
                    b += 1
                if b < len(last):
                    block += peak[b]
                    ends.append(last[b])
            if block < self.floor:
                beyond = [self.posts[t][0][cursor[t]] for t in live[pivot + 1 : pivot + 2]]
                item = max(min([e + 1 for e in ends] + beyond), item + 1)
            elif self.posts[live[0]][0][cursor[live[0]]] == item:
                score = sum(self.posts[t][1][cursor[t]] for t in live[: pivot + 1])
                if score >= self.theta[item] - 1e-9:
                    found.append(item)
                item += 1
            for t in live[: pivot + 1]:
                at, c = self.posts[t][0], cursor[t]
                while c < len(at) and at[c] < item:
                    c += 1
                cursor[t] = c
            live = [t for t in live if cursor[t] < len(self.posts[t][0])]
        return found

    def candidates(self, slot: np.ndarray) -> dict[int, tuple[int, int]]:
        """item -> (first, last) word of the passages that retrieved it."""
        out: dict[int, tuple[int, int]] = {}
        if not len(slot):
            return out
        width = self.min_words + self.min_words // self.per_edit + STRIDE
        gain = np.r_[0.0, np.cumsum(np.where(slot >= 0, self.top[np.maximum(slot, 0)], 0.0))]
        if gain[-1] < self.floor:
            return out
        start = np.arange(0, max(1, len(slot) - (width - 2) + STRIDE), STRIDE)
        stop = np.minimum(start + width - 2, len(slot))
        for a, z in zip(*(x[gain[stop] - gain[start] >= self.floor].tolist() for x in (start, stop)), strict=True):
            terms = np.unique(slot[a:z])
            terms = terms[terms >= 0]
            # no item block can reach a threshold of its items: WAND would skip them all
            if not (self.peaks[terms].sum(axis=0) >= self.least - 1e-3).any():
                continue
            for item in self.wand(terms.tolist()):
                lo, hi = out.get(item, (a, z))
                out[item] = (min(lo, a), max(hi, z))
        return out

    def verify(self, ids: np.ndarray, item: int, lo: int, hi: int) -> bool:
        """Whether ``min_words`` words of the item stand in order there, one edit in ``per_edit`` allowed."""
        few, most = self.min_words // self.per_edit, len(self.words[item]) // self.per_edit
        return self._aligned(ids, item, lo, hi, few) or (most > few and self._aligned(ids, item, lo, hi, most))

    def _aligned(self, ids: np.ndarray, item: int, lo: int, hi: int, most: int) -> bool:
        """``verify`` with at most ``most`` edits: longest stretch by (edits, item word), row by row."""
        want = self.words[item]
        m = len(want)
        part = ids[max(0, lo - m) : hi + m + 2]
        best = np.zeros((most + 1, m + 1), dtype=np.int32)
        need = np.maximum(self.min_words, self.per_edit * np.arange(most + 1))[:, None]
        for w in part:
            hit = want == w
            new = np.zeros_like(best)
            new[:, 1:] = np.where(hit, best[:, :-1] + 1, 0)
            if most:
                np.maximum(new[1:, 1:], best[:-1, :-1] + 1, out=new[1:, 1:])
                np.maximum(new[1:], best[:-1], out=new[1:])
                for e in range(1, most + 1):
                    np.maximum(new[e, 1:], new[e - 1, :-1] + 1, out=new[e, 1:])
            if (new >= need).any():
                return True
            best = new
        return False

    def search(self, text: str | None) -> list[int]:
        """Ids of the items that leaked into ``text``."""
        ids, slot = self.lookup(words_of(text))
        return sorted(self.ids[i] for i, (lo, hi) in self.candidates(slot).items() if self.verify(ids, i, lo, hi))


def leaked_items(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", passage: str = "passage", min_words: int = 30, per_edit: int = 15,
    standing: int = 3,
) -> DataFrame:
    """(doc_id, item_id): each item of which at least ``min_words`` words stand in order in a document.

    Null or empty texts and passages, and items shorter than ``min_words``, match nothing; repeated
    documents are each reported; repeated items are reported under each id; an empty corpus or item
    table gives an empty result; further columns are ignored. Texts are read whole. A closing sentence
    that ``standing`` or more different passages share is a standing question and does not count.
    """
    scratch = Scratch(documents.sparkSession, "leakage")
    kind = dict(items.dtypes)[item_id]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [split_closing(p) for p in pdf[passage]]
            yield pd.DataFrame({"item": pdf[item_id], "body": [words_of(b) for b, _ in parts], "closing": [c for _, c in parts], "last": [words_of(c) for _, c in parts]})

    rows = items.select(item_id, passage).where(F.col(item_id).isNotNull() & F.col(passage).isNotNull())
    split = scratch.cut(rows.mapInPandas(parse, f"item {kind}, body array<string>, closing string, last array<string>"))
    common = split.groupBy("closing").agg(F.countDistinct(F.xxhash64("body")).alias("bodies")).where(F.col("bodies") >= standing)
    told = split.join(common, "closing", "left").select("item", F.when(F.col("bodies").isNull(), F.concat("body", "last")).otherwise(F.col("body")).alias("words"))
    parsed = scratch.cut(told.where(F.size("words") >= min_words).distinct().orderBy("item"))
    shards: list[list] = [[]]
    size = 0
    for i, ws in parsed.toLocalIterator():
        if size + len(ws) > SHARD_WORDS and shards[-1]:
            shards.append([])
            size = 0
        shards[-1].append((i, list(ws)))
        size += len(ws)
    types = dict(documents.dtypes), dict(items.dtypes)
    schema = f"{doc_id} {types[0][doc_id]}, {item_id} {types[1][item_id]}"
    texts = documents.select(doc_id, text).where(F.length(text) >= min_words)

    def searched(shard: list) -> DataFrame:
        index = documents.sparkSession.sparkContext.broadcast(PassageIndex(shard, min_words, per_edit))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                found = [(d, i) for d, t in zip(pdf[doc_id], pdf[text], strict=True) for i in index.value.search(t)]
                yield pd.DataFrame(found, columns=[doc_id, item_id])

        return texts.mapInPandas(scan, schema)

    return reduce(DataFrame.unionByName, map(searched, shards)).distinct()
