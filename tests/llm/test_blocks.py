"""Problems 1 and 5: vectors that crowd share blocks, only blocks within reach meet, neighbourhoods are exact."""

import numpy as np
import pytest

from sagaweave.llm import neighbours as nb
from sagaweave.runtime import Scratch

LEAST = 0.72


@pytest.fixture(scope="module")
def crowded(spark):
    rng = np.random.default_rng(11)
    out = [c + rng.normal(size=64) * 0.05 for c in rng.normal(size=(6, 64)) / 8 for _ in range(90)]
    out = [*out, *rng.normal(size=(120, 64))]
    rows = [(f"v{k:04d}", "m", [float(x) for x in v]) for k, v in enumerate(out)]
    unit = np.array(out) / np.linalg.norm(out, axis=1)[:, None]
    return spark.createDataFrame(rows, "id string, space string, vector array<double>"), unit @ unit.T


@pytest.fixture
def packed(spark, crowded, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK", 40)
    scratch = Scratch(spark, "test")
    return nb.packed_index(nb.usable(crowded[0], "id", "space", "vector"), scratch), scratch


def test_p5_crowds_lie_in_blocks_with_narrow_caps(packed):
    blocks = packed[0].select("ids", "turn").collect()
    assert sorted(i for r in blocks for i in r["ids"]) == [f"v{k:04d}" for k in range(660)]
    for r in blocks:
        crowd = {int(i[1:]) // 90 for i in r["ids"] if int(i[1:]) < 540}
        if crowd:
            assert len(crowd) == 1 and all(int(i[1:]) < 540 for i in r["ids"]) and r["turn"] < 0.9


def test_p5_nearest_over_blocks(crowded):
    df, cos = crowded
    cos = cos - 3 * np.eye(len(cos))
    want = {(f"v{i:04d}", f"v{j:04d}") for i in range(len(cos)) for j in np.argsort(-cos[i], kind="stable")[:5] if cos[i, j] >= 0.9}
    got = nb.nearest(df, "id", "space", "vector", 5, least=0.9, p_stop=0.9999).collect()
    assert want and {(r["id"], r["neighbour"]) for r in got} == want


def test_p1_neighbourhoods_without_a_second_comparison(packed, crowded):
    index, scratch = packed
    found, hoods = nb.neighbour_gids(index, 8, LEAST, nb.P_STOP, scratch, count=True)
    ids = {r["gid"]: int(r["id"][1:]) for r in nb.names(index).collect()}
    reach = crowded[1] >= LEAST
    marks = {v: int(nb.mark(np.array([g]))[0]) for g, v in ids.items()}
    rows = hoods.collect()
    assert len(rows) == len(ids)
    for r in rows:
        near = np.flatnonzero(reach[ids[r["gid"]]])
        assert r["n"] == len(near) and (r["h"] - sum(marks[v] for v in near)) % 2**64 == 0
    assert all(reach[ids[r["gid"]], ids[r["other"]]] for r in found.collect())
