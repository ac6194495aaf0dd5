"""The k most similar vectors of every vector, by stable projections, a kd-tree and a chi-square stop.

Unit vectors are projected onto a few Gaussian directions. For two vectors at distance d the
squared projected distance over d^2 follows a chi-square law with as many degrees of freedom as
directions, so a kd-tree over the projections answers for the full space: a bucket of the tree
meets other buckets only as far as a vector nearer than the k-th best of its rows would have shown
by now with probability ``p_stop``; what it meets is verified by true cosine.

A bounded sample gives the middles of the places where vectors crowd. Every row lies in the home of
the middle it is near to, or, far from all, in a leaf of a tree fitted on the sample's projections;
homes and leaves are cut by hash into blocks of bounded size, each a kd-tree of its own with a cap
(the mean direction of its vectors and the widest angle to it). A block is searched by its own rows
first, which gives every query its bound. By the triangle inequality of angles the caps then tell
exactly which other blocks of its space any of its rows may still have a nearer vector in; only
these meet it, one pair at a time and both ways at once, read from the packed table, so that
nothing but the caps (one a block) leaves it.
Exact copies are indexed up to k + 1 times (the smallest ids), which no result can tell from all of
them; further copies get their answer from those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Scratch, batch_rows

DIRECTIONS = 8
P_STOP = 0.95
BLOCK = 4096
BUCKET = 128
SAMPLE = 8192  # rows the homes and the upper tree are fitted on; all rows are indexed
DEPTH = 12  # of the upper tree at most
HOME = 0.72  # cosine to a middle
FOUNDERS = 4  # rows of the sample that make a home
SHELF = 8  # blocks written side by side
SLACK = 3
PAIRS = 4  # of blocks in memory at a time
HELD = 24  # blocks kept open
PLACE = 1 << 24  # gid = block * PLACE + row in the block
ROUND = 4e-6  # error of a cosine in single precision, at most
EPS = 1e-6  # slack of angles
SPARSE = 16  # one pair in so many, or fewer, is verified on its own
PIECE = 11  # bits; sums of a block's pieces are exact in single precision


def usable(vectors: DataFrame, vec_id: str, space: str, vector: str) -> DataFrame:
    """(id, space, vector) of the rows whose vector has a direction; null spaces compare with nothing."""
    return (
        vectors.select(F.col(vec_id).alias("id"), F.col(space).alias("space"), F.col(vector).alias("vector"))
        .where("id is not null and space is not null and vector is not null")
        .where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
        .where(F.exists("vector", lambda x: x != 0))
        .withColumn("space", F.struct("space", F.size("vector").alias("length")))
    )


def chi_square_bound(p: float, freedom: int) -> float:
    """The value an even-numbered chi-square variable stays below with probability ``p``."""

    def cdf(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, freedom // 2):
            term *= x / 2 / i
            total += term
        return 1 - float(np.exp(-x / 2)) * total

    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def directions(length: int) -> np.ndarray:
    """The Gaussian directions for vectors of ``length``; the same on every machine."""
    return np.random.default_rng(7919 + length).normal(size=(length, DIRECTIONS))


def stacked(rows: pd.Series) -> np.ndarray:
    """The vectors as they came, in single precision only if they came so."""
    kind = np.float32 if getattr(rows.iloc[0], "dtype", None) == np.float32 else np.float64
    return np.stack([np.asarray(v, dtype=kind) for v in rows])


def unit(raw: np.ndarray) -> np.ndarray:
    m = raw.astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for length, part in pdf.groupby("length"):
            raw = stacked(part["vector"])
            low = (unit(raw) @ directions(int(length))).astype(np.float32)
            yield part[["id", "space", "sid", "length"]].assign(low=list(low), u=[r.tobytes() for r in raw])


def _open(rows: pd.Series, length: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(rows), f"f{len(rows.iloc[0]) // length}")
    return unit(raw.reshape(len(rows), length))


def _middles(units: np.ndarray) -> np.ndarray:
    """Mean directions of the sampled vectors that lie together."""
    single, out = units.astype(np.float32), []
    while len(single):
        near = single @ single[0] >= HOME
        if near.sum() >= FOUNDERS:
            middle = single[near].mean(axis=0)
            out.append(middle / np.linalg.norm(middle))
            near |= single @ out[-1] >= HOME
        near[0] = True
        single = single[~near] if near.sum() > 1 else single[1:]
    return np.stack(out) if out else np.zeros((0, units.shape[1]), np.float32)


class _Tree:
    """Median splits of a sample, to a fixed depth; node i has the children 2i + 1 and 2i + 2."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, self.dim, self.cut = depth, np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
        parts = {0: sample}
        for node in range(2**depth - 1):
            part = parts.pop(node, sample[:0])
            if len(part):
                self.dim[node] = d = int(part.var(axis=0).argmax())
                self.cut[node] = c = float(np.median(part[:, d]))
                parts[2 * node + 1], parts[2 * node + 2] = part[part[:, d] < c], part[part[:, d] >= c]

    def leaf(self, low: np.ndarray) -> np.ndarray:
        node = np.zeros(len(low), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (low[np.arange(len(low)), self.dim[node]] >= self.cut[node])
        return node


def _buckets(low: np.ndarray) -> list[np.ndarray]:
    """Rows in kd order: halves by the median of the widest direction, down to ``BUCKET`` rows."""
    out, stack = [], [np.arange(len(low))]
    while stack:
        rows = stack.pop()
        if len(rows) <= BUCKET:
            out.append(rows)
            continue
        part = low[rows]
        order = rows[np.argsort(part[:, int(part.var(axis=0).argmax())], kind="stable")]
        stack += [order[len(order) // 2 :], order[: len(order) // 2]]
    return out


class Block:
    """Vectors of one space in kd order, with the boxes of their buckets."""

    def __init__(self, r: object, side: str = ""):
        gids, raw, lows, starts, axis = (getattr(r, side + c) for c in ("gids", "raw", "lows", "starts", "axis"))
        self.gid = np.frombuffer(gids, np.int64)
        self.axis, self.turn = np.frombuffer(axis), getattr(r, side + "turn")
        n, wide = len(self.gid), len(self.axis)
        self.raw = np.frombuffer(raw, f"f{len(raw) // (n * wide)}").reshape(n, wide)
        self.single = unit(self.raw).astype(np.float32)
        self.low = np.frombuffer(lows, np.float32).reshape(n, -1)
        square = np.einsum("ij,ij->i", self.low, self.low)[:, None]
        # the product of these two is the squared distance of the projections
        self.far = np.hstack([-2 * self.low, square, np.ones_like(square)]), np.hstack([self.low, np.ones_like(square), square])
        self.starts = np.frombuffer(starts, np.int64)
        at = self.starts[:-1]
        self.lo, self.hi = np.minimum.reduceat(self.low, at), np.maximum.reduceat(self.low, at)
        self.marks = None

    def exact(self, rows: np.ndarray) -> np.ndarray:
        return unit(self.raw[rows])

    def pieces(self) -> np.ndarray:
        """A one and the pieces of its mark for every row."""
        if self.marks is None:
            m = mark(self.gid)
            parts = [np.ones(len(m))] + [(m >> np.uint64(p)) & np.uint64((1 << PIECE) - 1) for p in range(0, 64, PIECE)]
            self.marks = np.stack(parts, axis=1).astype(np.float32)
        return self.marks


def mark(gid: np.ndarray) -> np.ndarray:
    """64 mixed bits of every gid."""
    z = (gid.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Best:
    """The ``keep`` most similar vectors seen so far of every row of a block, above the row's floor."""

    def __init__(self, floor: np.ndarray, keep: int):
        self.keep = keep
        self.sims = np.tile(floor.astype(np.float32)[:, None], (1, keep))
        self.gids = np.full(self.sims.shape, -1, np.int64)
        self.exact = np.full(self.sims.shape, np.nan)

    @property
    def bound(self) -> np.ndarray:
        return self.sims[:, -1]

    def add(self, i: np.ndarray, gids: np.ndarray, sims: np.ndarray) -> None:
        rows = np.unique(i)
        at = np.concatenate([np.repeat(rows, self.keep), i])
        pool = [np.concatenate([old[rows].ravel(), new]) for old, new in ((self.sims, sims), (self.gids, gids), (self.exact, np.full(len(i), np.nan)))]
        order = np.lexsort((-pool[0], at))
        at = at[order]
        top = order[np.arange(len(at)) - np.searchsorted(at, at) < self.keep].reshape(len(rows), self.keep)
        self.sims[rows], self.gids[rows], self.exact[rows] = (p[top] for p in pool)

    def some(self, i: np.ndarray, gids: np.ndarray, sims: np.ndarray) -> None:
        hit = sims > self.bound[i]
        if hit.any():
            self.add(i[hit], gids[hit], sims[hit])

    def take(self, rows: np.ndarray, got: np.ndarray, gids: np.ndarray) -> None:
        """Rows against the vectors ``gids``, at the similarities ``got``."""
        hit = got > self.bound[rows][:, None]
        n, wide = np.count_nonzero(hit), got.shape[1]
        if n > 4 * self.keep * len(rows) and wide > 8 * self.keep:
            # the bound is loose: a part of the vectors tightens it first
            cut = max(wide // 8, 2 * self.keep)
            top = np.argpartition(got[:, :cut], cut - self.keep, axis=1)[:, cut - self.keep :]
            self.add(np.repeat(rows, self.keep), gids[top].ravel(), np.take_along_axis(got[:, :cut], top, 1).ravel())
            self.take(rows, got[:, cut:], gids[cut:])
        elif n:
            i, j = np.nonzero(hit)
            self.add(rows[i], gids[j], got[i, j])

    def score(self, mine: Block, other: Block) -> None:
        """Exact similarities of the vectors taken last, all of ``other``."""
        i, j = np.nonzero((self.gids >= 0) & np.isnan(self.exact))
        at = self.gids[i, j] % PLACE
        for c in range(0, len(i), 16384):
            x, y = i[c : c + 16384], at[c : c + 16384]
            self.exact[x, j[c : c + 16384]] = np.einsum("ij,ij->i", mine.exact(x), other.exact(y))


class Tally:
    """How many vectors reach ``least`` with every row of a block, and the sum of their marks, modulo 2^64."""

    def __init__(self, n: int):
        self.sums = np.zeros((n, 1 + -(-64 // PIECE)))

    def told(self) -> tuple[np.ndarray, np.ndarray]:
        s = self.sums.astype(np.uint64)
        return s[:, 0].astype(np.int64), sum((s[:, 1 + p] << np.uint64(PIECE * p) for p in range(s.shape[1] - 1)), np.zeros(len(s), np.uint64))


def _reached(a: Block, b: Block, rows: np.ndarray, columns: np.ndarray, got: np.ndarray, least: float, mine: Tally, theirs: Tally | None) -> None:
    yes = got >= least + ROUND
    maybe = got >= least - ROUND
    n = np.count_nonzero(yes)
    if n != np.count_nonzero(maybe):
        i, j = np.nonzero(maybe & ~yes)
        yes[i, j] = np.einsum("ij,ij->i", a.exact(rows[i]), b.exact(columns[j])) >= least
        n = np.count_nonzero(yes)
    if not n:
        return
    if n == yes.size:
        mine.sums[rows] += b.pieces()[columns].astype(np.float64).sum(axis=0)
        if theirs:
            theirs.sums[columns] += a.pieces()[rows].astype(np.float64).sum(axis=0)
        return
    r, c = np.flatnonzero(yes.any(axis=1)), np.flatnonzero(yes.any(axis=0))
    part = yes[np.ix_(r, c)].astype(np.float32)
    mine.sums[rows[r]] += part @ b.pieces()[columns[c]]
    if theirs:
        theirs.sums[columns[c]] += part.T @ a.pieces()[rows[r]]


def _within(x: np.ndarray, axes: np.ndarray, turns: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Whether each row may have a vector above its floor inside each cap."""
    wide = np.arccos(np.clip(floor, -1, 1))[:, None] + turns[None] + EPS
    return x @ axes.T.astype(np.float32) >= np.cos(np.minimum(wide, np.pi)) - EPS - ROUND


def meet(a: Block, b: Block, mine: Best, theirs: Best, floor: float, reach: float, tallies: tuple[Tally, Tally] | None) -> None:
    """Both blocks' rows against each other; within a block, every row against the others."""
    same = a is b
    ia, ib = np.arange(len(a.gid)), np.arange(len(b.gid))
    if not same:
        ia = ia[_within(a.single, b.axis[None], np.array([b.turn]), np.full(len(ia), floor))[:, 0]]
        ib = ib[_within(b.single, a.axis[None], np.array([a.turn]), np.full(len(ib), floor))[:, 0]]
        if not len(ia) or not len(ib):
            return
    of_b = np.searchsorted(b.starts, ib, "right") - 1
    gap = np.maximum(np.maximum(a.lo[:, None] - b.hi[None], b.lo[None] - a.hi[:, None]), 0)
    gap = np.einsum("ijk,ijk->ij", gap, gap)
    ends = np.searchsorted(ia, a.starts)
    for at, (s, e) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        if s == e:
            continue
        rows, columns = ia[s:e], ib
        if np.isfinite(reach):
            # the test: a nearer vector than the last kept one would lie within ``reach`` of its distance
            loosest = np.full(len(b.starts) - 1, mine.bound[rows].min())
            if not same:
                loosest = np.minimum(loosest, np.minimum.reduceat(theirs.bound, b.starts[:-1]))
            loosest = reach * (2.00001 - 2 * loosest)
            columns = ib[(gap[at] < loosest)[of_b]]
            if not len(columns):
                continue
            # and so row by row, where that spares most of them
            near = a.far[0][rows] @ (b.far[1] if len(columns) == len(b.gid) else b.far[1][columns]).T < loosest.max() * 1.0001 + 1e-3
            if np.count_nonzero(near) * SPARSE <= near.size:
                i, j = np.divmod(np.flatnonzero(near), len(columns))
                i, j = rows[i], columns[j]
                if same:
                    i, j = i[i != j], j[i != j]
                sims = np.einsum("ij,ij->i", a.single[i], b.single[j])
                mine.some(i, b.gid[j], sims)
                if not same:
                    theirs.some(j, a.gid[i], sims)
                continue
        got = a.single[rows] @ (b.single if len(columns) == len(b.gid) else b.single[columns]).T
        if same:
            i = np.flatnonzero(np.isin(rows, columns))
            got[i, np.searchsorted(columns, rows[i])] = -9
        mine.take(rows, got, b.gid[columns])
        if not same:
            theirs.take(columns, got.T, a.gid[rows])
        if tallies:
            _reached(a, b, rows, columns, got, floor, tallies[0], None if same else tallies[1])
    mine.score(a, b)
    if not same:
        theirs.score(b, a)


def _pack_one(pdf: pd.DataFrame) -> dict:
    low = np.stack(pdf["low"].to_numpy())
    parts = _buckets(low)
    order = np.concatenate(parts)
    starts = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)
    k, length = int(pdf["k"].iloc[0]), int(pdf["length"].iloc[0])
    units = _open(pdf["u"], length)
    axis = units.mean(axis=0)
    size = float(np.linalg.norm(axis))
    axis = axis / max(size, 1e-300)
    turn = float(np.arccos(np.clip((units @ axis).min(), -1, 1))) if size > 1e-9 else np.pi
    return {
        "k": k, "from": int(pdf["from"].iloc[0]), "to": int(pdf["to"].iloc[0]), "ids": pdf["id"].to_numpy()[order].tolist(),
        "gids": (k * PLACE + np.arange(len(order), dtype=np.int64)).tobytes(), "raw": b"".join(pdf["u"].to_numpy()[order]),
        "lows": low[order].astype(np.float32).tobytes(), "starts": starts.tobytes(), "axis": axis.tobytes(), "turn": turn,
    }


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([_pack_one(part) for _, part in pdf.groupby("k")])


PACKED = "k long, from long, to long, ids array<string>, gids binary, raw binary, lows binary, starts binary, axis binary, turn double"


def _hash(c: str) -> Column:
    return F.xxhash64(F.lit("place"), F.col(c))


def packed_index(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """One row a block; k numbers the blocks; those of one space are ``from`` to ``to``.

    ``rows`` has id, space (struct with length) and vector.
    """
    flat = rows.select("id", "space", F.xxhash64("space").alias("sid"), F.col("space.length").alias("length"), "vector")
    kind = f"id string, space {dict(flat.dtypes)['space']}, sid long, length int, low array<float>, u binary"
    low, seen = scratch.counted(flat.mapInPandas(_project, kind))
    sample = low.select("sid", "length", "low", "u").orderBy(_hash("id")).limit(SAMPLE).toPandas() if seen["n"] > BLOCK else None
    middles: dict[int, np.ndarray] = {}
    far = np.zeros((0, DIRECTIONS))
    if sample is not None:
        lows, loose = np.stack(sample["low"].to_numpy()).astype(np.float64), np.ones(len(sample), bool)
        for (sid, length), part in sample.groupby(["sid", "length"]):
            units = _open(part["u"], int(length))
            middles[int(sid)] = m = _middles(units)
            if len(m):
                loose[part.index] = (units @ m.T).max(axis=1) < HOME
        far = lows[loose]
    share = len(far) / len(sample) if sample is not None else 0
    depth = int(np.clip(np.ceil(np.log2(max(1, share * seen["n"]) / BLOCK)), 0, DEPTH))
    tree = _Tree(far, depth)

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            leaf = -1 - tree.leaf(np.stack(pdf["low"].to_numpy()).astype(np.float64))
            for (sid, length), at in pdf.groupby(["sid", "length"]).indices.items():
                if len(m := middles.get(int(sid), ())):
                    for c in range(0, len(at), 2048):
                        part = at[c : c + 2048]
                        near = _open(pdf["u"].iloc[part], int(length)).astype(np.float32) @ m.T
                        leaf[part] = np.where(near.max(axis=1) >= HOME, near.argmax(axis=1), leaf[part])
            yield pdf.assign(leaf=leaf)

    columns = f"{kind}, leaf long"
    placed = low.mapInPandas(leaves, columns).drop("sid")
    sizes = placed.groupBy("space", "leaf").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    order = Window.orderBy("space", "leaf")
    spots = sizes.select(
        "space", "leaf", "blocks", (F.sum("blocks").over(order) - F.col("blocks")).alias("first"),
        F.sum("blocks").over(Window.orderBy("space")).alias("end"), F.sum("blocks").over(Window.partitionBy("space")).alias("all"),
    )
    # a written table of one row a leaf: Spark knows its size and need not shuffle the vectors for this join
    spots = scratch.cut(spots.coalesce(1))
    keyed = placed.join(F.broadcast(spots), ["space", "leaf"]).select(
        "id", "length", "low", "u", (F.col("first") + F.pmod(_hash("id"), "blocks")).alias("k"),
        (F.col("end") - F.col("all")).alias("from"), (F.col("end") - 1).alias("to"),
    )
    # blocks of one home stay side by side, in files of a few shelves
    keyed = keyed.withColumn("shelf", F.floor(F.col("k") / SHELF)).repartition(max(8, -(-seen["n"] // (2 * SHELF * BLOCK))), "shelf")
    out = scratch.cut(keyed.groupBy("shelf").applyInPandas(lambda pdf: _pack(pdf.drop(columns="shelf")), PACKED))
    scratch.drop(low, spots)
    return out


FOUND = "g binary, o binary, s binary, n binary, h binary"


def _told(k: int, best: Best, tally: Tally | None, floor: float) -> dict:
    i, j = np.nonzero((best.gids >= 0) & (best.exact >= floor))
    n, h = tally.told() if tally else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    return {
        "k": k, "g": (k * PLACE + i).astype(np.int64).tobytes(), "o": best.gids[i, j].tobytes(), "s": best.exact[i, j].tobytes(),
        "n": n.tobytes() if n.any() else b"", "h": h.tobytes() if n.any() else b"",
    }


def neighbour_gids(packed: DataFrame, k: int, floor: float, p_stop: float, scratch: Scratch, count: bool = False) -> tuple[DataFrame, DataFrame]:
    """((gid, other, similarity): up to k + SLACK nearest of every indexed row, exact; (gid, n, h, own)).

    With ``count`` there is no stop: every pair of ``floor`` or more is seen, and of every row's
    neighbourhood (the row itself and all that reach ``floor`` with it) the second table holds the size n
    and the sum h of the marks modulo 2^64, ``own`` being the row's mark. Without, it is empty.
    """
    keep, reach = k + SLACK, np.inf if count else chi_square_bound(p_stop, DIRECTIONS)
    caps = packed.select(F.col("from").alias("of"), F.struct("k", "axis", "turn").alias("cap"))
    caps = scratch.cut(caps.groupBy("of").agg(F.collect_list("cap").alias("caps")).select("of", *[F.col(f"caps.{c}").alias(f"cap_{c}") for c in ("k", "axis", "turn")]))
    plain = [c for c in packed.columns if c != "ids"]

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.rename(columns={"from": "start"}).itertuples(index=False):
                a, best = Block(r), Best(np.full(len(np.frombuffer(r.gids, np.int64)), floor - 1e-5), keep)
                tally = Tally(len(a.gid)) if count else None
                meet(a, a, best, best, floor, reach, (tally, tally) if count else None)
                if count:  # a row is of its own neighbourhood
                    tally.sums += a.pieces()
                floors = best.bound.astype(np.float64) - 1e-6
                near = np.zeros(len(r.cap_k), bool)
                axes, turns = np.stack([np.frombuffer(x) for x in r.cap_axis]), np.array(r.cap_turn)
                for c in range(0, len(near), 1024):
                    test = np.full(len(a.gid), floor) if count else floors
                    near[c : c + 1024] = _within(a.single, axes[c : c + 1024], turns[c : c + 1024], test).any(axis=0)
                out.append(_told(r.k, best, tally, floor) | {"floors": floors.tobytes(), "reach": np.array(r.cap_k)[near]})
            yield pdf[plain].merge(pd.DataFrame(out), on="k")

    kinds = dict(packed.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in plain) + f", {FOUND}, floors binary, reach array<long>"
    # a range, not an equality: blocks are not gathered by their space
    with batch_rows(packed.sparkSession, PAIRS):
        beside = packed.drop("ids").join(caps, (F.col("of") >= F.col("from")) & (F.col("of") <= F.col("from")))
        first = scratch.cut(beside.mapInPandas(own, schema))

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks: dict[int, Block] = {}
        state: dict[int, tuple[Best, Tally | None]] = {}

        def opened(r: object, side: str) -> Block:
            k = getattr(r, f"{side}k")
            if k not in blocks:
                if len(blocks) >= HELD:
                    blocks.pop(next(iter(blocks)))
                blocks[k] = Block(r, side)
            if k not in state:
                state[k] = Best(np.frombuffer(getattr(r, f"{side}floors")), keep), Tally(len(blocks[k].gid)) if count else None
            return blocks[k]

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                a, b = opened(r, "a_"), opened(r, "b_")
                (x, tx), (y, ty) = state[r.a_k], state[r.b_k]
                meet(a, b, x, y, floor, reach, (tx, ty) if count else None)
        if state:
            yield pd.DataFrame([_told(k, best, tally, floor) for k, (best, tally) in state.items()])

    cols = [*[c for c in plain if c not in ("from", "to")], "floors", "reach"]
    left = first.select("from", "to", *[F.col(c).alias(f"a_{c}") for c in cols])
    right = first.select([F.col(c).alias(f"b_{c}") for c in cols])
    one, two = F.array_contains("a_reach", F.col("b_k")), F.array_contains("b_reach", F.col("a_k"))
    pairs = left.join(right, (F.col("b_k") <= F.col("to")) & (F.col("a_k") < F.col("b_k")) & ((one & two) if count else (one | two)))
    with batch_rows(packed.sparkSession, PAIRS):
        more = scratch.cut(pairs.drop("from", "to", "a_reach", "b_reach").mapInPandas(across, f"k long, {FOUND}"))

    def loose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                yield pd.DataFrame({"gid": np.frombuffer(r.g, np.int64), "other": np.frombuffer(r.o, np.int64), "similarity": np.frombuffer(r.s)})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        n = sum(np.frombuffer(x, np.int64) for x in pdf["n"])
        h = sum((np.frombuffer(x, np.uint64) for x in pdf["h"]), np.zeros(len(n), np.uint64))
        gid = int(pdf["k"].iloc[0]) * PLACE + np.arange(len(n), dtype=np.int64)
        return pd.DataFrame({"gid": gid, "n": n, "h": h.view(np.int64), "own": mark(gid).view(np.int64)})

    both = first.select("k", *"gosnh").unionByName(more)
    near = both.select("g", "o", "s").mapInPandas(loose, "gid long, other long, similarity double")
    hoods = both.where(F.length("n") > 0).select("k", "n", "h").groupBy("k").applyInPandas(total, "gid long, n long, h long, own long")
    found = scratch.cut(near)
    hoods = scratch.cut(hoods) if count else hoods
    if count:
        scratch.drop(first, more)
    return found, hoods


def names(packed: DataFrame) -> DataFrame:
    """(gid, id) of every indexed row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, gids in zip(pdf["ids"], pdf["gids"], strict=True):
                yield pd.DataFrame({"gid": np.frombuffer(gids, np.int64), "id": ids})

    return packed.select("ids", "gids").mapInPandas(run, "gid long, id string")


def nearest(
    vectors: DataFrame, vec_id: str, space: str, vector: str, best: int = 5, least: float = -1.0, p_stop: float = P_STOP
) -> DataFrame:
    """(id, neighbour, similarity, rank): the ``best`` most similar others of each vector in its space.

    Only similarities of ``least`` or more; of equal ones the smaller id comes first. Every row found
    carries its exact similarity; a true neighbour is missed with a probability of at most
    1 - ``p_stop``. Missing, all-zero and non-finite vectors are left out, vectors of unlike length
    are not compared; repeated ids are one row each; an empty table gives an empty result; further
    columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession, "nearest")
    rows = usable(vectors, vec_id, space, vector)
    rows = rows.withColumn("id", F.col("id").cast("string")).withColumn("h", F.xxhash64("vector"))
    alike = Window.partitionBy("space", "h", "vector").orderBy("id")
    kept = scratch.cut(rows.dropDuplicates(["id"]).withColumn("copy", F.row_number().over(alike)).where(F.col("copy") <= best + 1))
    packed = packed_index(kept.select("id", "space", "vector"), scratch)
    found, _ = neighbour_gids(packed, best, least, p_stop, scratch)
    known = names(packed)
    told = (
        found.join(known, "gid").drop("gid")
        .join(known.select(F.col("gid").alias("other"), F.col("id").alias("neighbour")), "other").drop("other")
    )
    # further copies: their nearest are the copies with the smallest ids
    full = kept.where(F.col("copy") == best + 1).select("space", "h", "vector")
    more = rows.join(full, ["space", "h", "vector"], "left_semi").join(kept.select("id"), "id", "left_anti")
    twins = kept.where(F.col("copy") <= best).select("space", "h", "vector", F.col("id").alias("neighbour"))
    more = more.join(twins, ["space", "h", "vector"]).select("id", F.lit(1.0).alias("similarity"), "neighbour")
    order = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    ranked = told.unionByName(more.where(F.lit(least <= 1)))
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).select("id", "neighbour", "similarity", "rank")
