"""Lineage cuts, table access and small helpers shared by all operators.

Iterative operators cut their lineage with a Parquet table written to the
folder that the session names in ``spark.checkpoint.dir`` (shared by all
executors, so a lost executor costs a re-read and no recomputation). Only where
that setting is missing and the master is local, as in tests, a temporary folder
is used; on a cluster a missing setting is an error. Cuts that later ones make
obsolete are deleted at once, the rest by ``clear`` or when the process ends.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; under a local master else a temporary folder of this process."""
    global _local_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"master {master!r} needs spark.checkpoint.dir, a folder that all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="sagaweave-")
        atexit.register(shutil.rmtree, _local_dir, ignore_errors=True)
    return f"file://{_local_dir}"


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_bases: set[str] = set()


def clear(spark: SparkSession) -> None:
    """Delete every cut this process still holds; call it once the results are written."""
    while _bases:
        _delete(spark, _bases.pop())


@atexit.register
def _clear_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _bases:
        with contextlib.suppress(Exception):
            clear(spark)


class Scratch:
    """Writes intermediate tables; ``drop`` removes those that nothing reads any more."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/sagaweave/{label}-{uuid.uuid4().hex}"
        self.made = 0
        _bases.add(self.base)

    def cut(self, df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
        """Write ``df`` once and read it back; ``replaces`` is an earlier cut that ``df`` made obsolete."""
        out, _ = self._write(df)
        if replaces is not None:
            self.drop(replaces)
        return out

    def counted(self, df: DataFrame, replaces: DataFrame | None = None, **sums: Column) -> tuple[DataFrame, dict]:
        """``cut`` and, from the same write, the number of rows ``n`` and the given aggregates."""
        seen = Observation(uuid.uuid4().hex)
        exprs = [F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in sums.items()]]
        out, _ = self._write(df.observe(seen, *exprs))
        if replaces is not None:
            self.drop(replaces)
        return out, seen.get

    def _write(self, df: DataFrame) -> tuple[DataFrame, str]:
        path = f"{self.base}/{self.made:04d}"
        self.made += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._sagaweave_path = path
        return out, path

    def drop(self, *frames: DataFrame) -> None:
        """Delete the files of earlier cuts."""
        for df in frames:
            if path := getattr(df, "_sagaweave_path", None):
                _delete(self.spark, path)

    def close(self) -> None:
        """Delete all cuts of this scratch."""
        _delete(self.spark, self.base)
        _bases.discard(self.base)


def has_rows(df: DataFrame) -> bool:
    """Whether ``df`` has any row."""
    return bool(df.take(1))


def latest_by_id(df: DataFrame, key: str, version: str) -> DataFrame:
    """One row per ``key``: the largest ``version`` (null is smallest), ties by the remaining columns.

    Map columns take part in the order as sorted entries and come out as maps. Rows without a
    key are kept unless they repeat each other in full.
    """
    kinds = dict(df.dtypes)
    rest = [c for c in df.columns if c not in (key, version)]
    flat = {c: F.array_sort(F.map_entries(c)) if kinds[c].startswith("map") else F.col(c) for c in rest}
    keyed = df.where(F.col(key).isNotNull())
    best = F.max(F.struct(F.col(version), *[flat[c].alias(c) for c in rest])).alias("__best")
    back = [F.map_from_entries(f"__best.{c}").alias(c) if kinds[c].startswith("map") else F.col(f"__best.{c}").alias(c) for c in rest]
    order = {key: F.col(key), version: F.col(f"__best.{version}").alias(version)} | dict(zip(rest, back, strict=True))
    picked = keyed.groupBy(key).agg(best).select(*[order[c] for c in df.columns])
    lone = df.where(F.col(key).isNull()).select(*[flat.get(c, F.col(c)).alias(c) for c in df.columns]).distinct()
    lone = lone.select(*[F.map_from_entries(c).alias(c) if kinds[c].startswith("map") else F.col(c) for c in df.columns])
    return picked.unionByName(lone)


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Within the block, actions hand at most ``rows`` rows at a time to Python; for rows that are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
