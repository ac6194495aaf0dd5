"""Connected groups of small graphs against brute force, by the rounds of strip and compress."""

import random

import pytest

from sagaweave.llm import components


def chain(p, n):
    return [(f"{p}{k:02d}", f"{p}{k + 1:02d}") for k in range(n)]


def circle(p, n):
    return [(f"{p}{k:02d}", f"{p}{(k + 1) % n:02d}") for k in range(n)]


def star(p, n):
    return [(f"{p}99", f"{p}{k:02d}") for k in range(n)]


def clique(p, n):
    return [(f"{p}{i:02d}", f"{p}{j:02d}") for i in range(n) for j in range(i)]


TREES = chain("a", 25) + star("b", 8) + [("c00", "c01"), ("c03", "c02"), ("c02", "c03"), ("c04", "c04"), (None, "c05")]
CIRCLES = circle("d", 3) + circle("e", 17) + circle("f", 6) + chain("g", 9) + [("f02", "g00")] + clique("h", 6) + [("h05", "i00"), ("i00", "i01")]


def groups(pairs):
    label = {}
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            label.setdefault(a, a), label.setdefault(b, b)
            one, two = label[a], label[b]
            label = {v: min(one, two) if x in (one, two) else x for v, x in label.items()}
    return label


@pytest.mark.parametrize("pairs", [TREES, CIRCLES], ids=["trees", "circles"])
def test_connected_groups(spark, monkeypatch, pairs):
    rounds, strip = [], components._strip
    monkeypatch.setattr(components, "_strip", lambda *a: rounds.append(1) or strip(*a))
    pairs = random.Random(5).sample(pairs, len(pairs))
    got = components.connected_groups(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()
    assert rounds  # the rounds are entered whatever the size
    assert sorted((r.vertex, r.group_id) for r in got) == sorted(groups(pairs).items())
