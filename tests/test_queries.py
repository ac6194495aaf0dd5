"""Every core query beside its SQL on the smallest tables, and the stream beside the batch."""

import datetime
import json
from pathlib import Path

import pytest

import oracle
from sagaweave.operators.hierarchy import resolve_hierarchy
from sagaweave.operators.intervals import coverage, gaps
from sagaweave.plans import registry
from sagaweave.streaming import windows

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_beside_sql(spark, name):
    oracle.compare(spark, registry.QUERIES[name], registry.ORACLE[name], DATA)


def day(k):
    return datetime.datetime(1900, 1, 1) + datetime.timedelta(days=k)


def test_periods_and_gaps(spark):
    spans = [("a", 0, 10), ("a", 5, 20), ("a", 20, 30), ("a", 40, 9000), ("a", 50, 60), ("a", 9001, 9002), ("b", 5, 5), ("b", 9, 3), (None, 1, 2), ("c", None, 4), ("d", 1, 2), ("d", 1, 2)]
    rows = [(e, None if s is None else day(s), day(t), "x") for e, s, t in spans]
    df = spark.createDataFrame(rows, "f string, s timestamp_ntz, e timestamp_ntz, gap_from string")
    got = sorted((r.entity, r.period_start, r.period_end) for r in coverage(df, "f", "s", "e").collect())
    assert [(e, (s - day(0)).days, (t - day(0)).days) for e, s, t in got] == [("a", 0, 30), ("a", 40, 9000), ("a", 9001, 9002), ("d", 1, 2)]
    assert sorted(((r.gap_from - day(0)).days, (r.gap_to - day(0)).days) for r in gaps(df, "f", "s", "e").collect()) == [(30, 40), (9000, 9001)]
    assert gaps(df.limit(0), "f", "s", "e").count() == 0


def test_hierarchy_shapes(spark):
    chain = [(f"c{k:03d}", f"c{k - 1:03d}" if k else None) for k in range(70)]
    ring = [(f"r{k}", f"r{(k + 1) % 5}") for k in range(5)] + [("t1", "r3"), ("t2", "t1"), ("s", "s"), ("u", "gone"), (None, "u"), ("u", "gone")]
    df = spark.createDataFrame(chain + ring, "id string, parent string")
    got = {r.node_id: (r.root_id, r.depth) for r in resolve_hierarchy(df, "id", "parent").collect()}
    want = {c: ("c000", k) for k, (c, _) in enumerate(chain)} | {f"r{k}": ("r0", -1) for k in range(5)} | {"t1": ("r0", -1), "t2": ("r0", -1), "s": ("s", -1), "u": ("u", 0)}
    assert got == want
    assert resolve_hierarchy(df.limit(0), "id", "parent").count() == 0


def test_stream_closes_the_same_windows(spark, tmp_path):
    rows = [{"event_id": k, "ts": f"2024-01-01T{k // 10:02d}:{k % 10 * 6:02d}:00", "user_id": k % 3, "event_type": "click", "value": 1.0} for k in range(100)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    schema = spark.read.json(f"{tmp_path}/in").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "value").schema
    stream = windows.settled_files(spark, f"{tmp_path}/in", schema)
    query = windows.tumbling(stream).writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    query.awaitTermination(120)
    closed = {tuple(r) for r in spark.table("closed").collect()}
    batch = {tuple(r) for r in windows.tumbling(spark.read.schema(schema).json(f"{tmp_path}/in")).collect()}
    assert closed and closed <= batch and len(closed) >= len(batch) - 2
