"""Problems 1 and 5 against brute force."""

import numpy as np
import pytest

import __spark_entry__
from sagaweave.llm import neighbours, spectral


def rows_and_cosines():
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for model, dim in (("m1", 16), ("m2", 16), ("m2", 8)):
        for _ in range(6):
            base = rng.normal(size=dim)
            for _ in range(int(rng.integers(4, 9))):
                v = base + rng.normal(size=dim) * rng.choice([0.02, 0.2, 0.5])
                rows.append((f"a{n:03d}", model, [float(x) for x in v * rng.uniform(0.1, 5)]))
                n += 1
    unit = [np.array(v) / np.linalg.norm(v) for _, _, v in rows]
    alike = lambda i, j: rows[i][1] == rows[j][1] and len(unit[i]) == len(unit[j])
    cos = {i: {j: float(unit[i] @ unit[j]) for j in range(n) if j != i and alike(i, j)} for i in range(n)}
    extra = [("z1", "m1", None), ("z2", "m1", [0.0] * 16), ("z3", None, rows[0][2]), ("z4", "m1", [float("nan")] * 16)]
    return rows + extra, cos


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    monkeypatch.setattr(neighbours, "BUCKET", 8)
    monkeypatch.setattr(spectral, "MEMBERS", 4)


@pytest.fixture
def arcs(spark, tmp_path):
    rows, cos = rows_and_cosines()
    df = spark.createDataFrame(rows, "id string, embedding_model string, embedding_centroid array<double>")
    df.write.parquet(f"{tmp_path}/arcs.parquet")
    top = {i: sorted(c, key=lambda j: (-c[j], rows[j][0]))[:5] for i, c in cos.items()}
    return str(tmp_path), rows, cos, top


def test_p5_pairs_and_neighbours(spark, arcs):
    path, rows, cos, top = arcs
    want = {(rows[i][0], rows[j][0]) for i in top for j in top[i] if i < j and i in top[j] and cos[i][j] >= 0.96}
    got = [tuple(r) for r in __spark_entry__.queries()["p5_found"](spark, path).collect()]
    assert want and len(got) == len(set(got)) and set(got) == want
    near = __spark_entry__.queries()["p5_nearest"](spark, path).collect()
    assert sorted((r[0], r[2], r[1]) for r in near) == sorted(
        (rows[i][0], k + 1, rows[j][0]) for i in top for k, j in enumerate(top[i])
    )


def test_p1_groups(spark, arcs):
    path, rows, cos, _ = arcs
    want = set()
    for i in cos:
        hood = {i} | {j for j, c in cos[i].items() if c >= 0.72}
        if len(hood) >= 5 and all({j} | {x for x, c in cos[j].items() if c >= 0.72} == hood for j in hood):
            want.add((rows[i][0], min(rows[j][0] for j in hood)))
    got = [tuple(r) for r in __spark_entry__.queries()["p1_found"](spark, path).collect()]
    assert want and len(got) == len(set(got)) and set(got) == want
