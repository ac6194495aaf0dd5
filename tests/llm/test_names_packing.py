"""Problems 4, 8 and 9: names, containers and leaked passages against plain versions."""

import itertools

import numpy as np

import __spark_entry__
from sagaweave.llm import names, packing

PEOPLE = [
    ["Benjamin Homihinabax", "Ben Homihinabax", "benj. homihinabax", "Homihinabax, B.", "Dr. Benjamin A. Homihinabax", "Benjamni Homihinabax"],
    ["Victoria Homihinabax", "Lady Victoria Homihinabax", "Vicky Homihinabax"],
    ["Gabriel Darirajozix", "DARIRAJOZIX GABRIEL", "Gabriel Darirajzoix"],
]
HOUSES = [
    ["Zovesopumuth & Rubomovadal Merchants Guild", "The Rubomovadal u. Zovesopumuth Guild of Merchants", "Rubomovadal-Zovesopumuth, Merch. Gld."],
    ["Zovesopumuth Insurance Society", "Zovesopumuth Ins. Soc."],
]
RUNS = [
    ["COMEDY, Padumimabon Republic, 1770–1788", "Comedy of the Padumimabon Rep. (1770–88)", "C., REPUBLIC OF PADUMIMABON, 1770 - 1788"],
    ["COMEDY, Padumimabon Republic, 1820–1830"],
]


def test_p4_found(spark, tmp_path):
    actors, want, n = [], set(), 0
    for kind, groups in (("person", PEOPLE), ("organisation", HOUSES)):
        for g in groups:
            ids = [f"a{n + k:03d}" for k in range(len(g))]
            n += len(g)
            actors += [(i, x, {"kind": kind}) for i, x in zip(ids, g, strict=True)]
            want |= {("actors", *p) for p in itertools.combinations(ids, 2)}
    actors += [("z1", "the weavers", {"kind": "collective"}), ("z2", "the weavers", {"kind": "collective"}), ("z3", None, None), ("z4", "", {"kind": "person"}), actors[0]]
    runs, n = [], 0
    for g in RUNS:
        ids = [f"i{n + k:03d}" for k in range(len(g))]
        n += len(g)
        runs += [(i, x, "comedy", None, None, None) for i, x in zip(ids, g, strict=True)]
        want |= {("arc_instances", *p) for p in itertools.combinations(ids, 2)}
    spark.createDataFrame(actors, "id string, name string, attributes map<string,string>").write.parquet(f"{tmp_path}/actors.parquet")
    spark.createDataFrame(runs, "id string, canonical_name string, arc_type string, start_date timestamp_ntz, end_date timestamp_ntz, updated_at timestamp_ntz").write.parquet(f"{tmp_path}/arc_instances.parquet")
    got = [tuple(r) for r in __spark_entry__.queries()["p4_found"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_collision_curve():
    n = names.bands(0.5, 0.98, 4)
    assert 1 - (1 - 0.5**4) ** n >= 0.98 > 1 - (1 - 0.5**4) ** (n - 1)


def test_sum_of_squares_rule():
    rng = np.random.default_rng(1)
    sizes = np.sort(rng.integers(1, 21, 400))[::-1]
    at = packing.sum_of_squares(sizes, 20)
    fill = np.bincount(at, weights=sizes)
    assert fill.max() <= 20 and (20 - fill).sum() <= 0.05 * sizes.sum()
    # the rule itself, step by step
    bins: list[int] = []
    for s, a in zip(sizes, at, strict=True):
        def squares(gaps):
            gaps = [g for g in gaps if g]
            return sum(gaps.count(g) ** 2 for g in set(gaps))
        options = [squares([*bins, 20 - s])] + [squares([g - s if i == j else g for j, g in enumerate(bins)]) for i, g in enumerate(bins) if g >= s]
        before = list(bins)
        bins.append(20 - s) if a == len(bins) else bins.__setitem__(a, bins[a] - s)
        assert squares(bins) == min(options), (s, before)


def test_p8_containers(spark):
    rows = [(1, "word " * 5000), (2, "a few words"), (3, None), (4, ""), (5, "a few words"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.packed_containers(df).collect()
    by = {k: [r for r in got if r.doc_id == k] for k in range(1, 6)}
    assert [r.tokens for r in sorted(by[1], key=lambda r: r.part)][:2] == [2048, 2048] and len(by[1]) == 3
    assert by[3][0].container is None and by[4][0].tokens == 0 and len(by[2]) == 1
    assert all(r.fill <= 2048 for r in got if r.container)
    assert packing.packed_containers(df.limit(0)).count() == 0


def test_p9_emphasis_and_page_marks(spark, tmp_path):
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}x" for k in range(60)]
    passage = " ".join(words) + ". What does the passage say of the town?"
    others = [(k, "s", " ".join(f"q{k}{w}" for w in words) + ". What does the passage say of the town?") for k in range(2, 6)]
    part = words[10:45]
    docs = [
        (1, "Before. " + " ".join(part[:12]) + " _" + part[12] + " " + part[13] + "_ " + " ".join(part[14:]) + " After."),
        (2, " ".join(part[:18]) + "\nPage 12\n" + " ".join(part[18:]).upper()), (3, " ".join(part[:18]) + " [495] " + " ".join(part[18:])),
        (4, " ".join(part[:27])), (5, " ".join(part[:10] + ["other"] + part[11:])), (6, None), (7, " ".join(reversed(part))),
    ]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "s", passage), *others], "item_id long, suite string, passage string").write.parquet(f"{tmp_path}/eval_items.parquet")
    got = {tuple(r) for r in __spark_entry__.queries()["p9_found"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (5, 1)}
