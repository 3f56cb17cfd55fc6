"""Keyed tables with upsert, delete and compaction.

A table is a folder of segments. A segment is one write: rows of a batch, dealt
to ``bucket`` folders by a hash of their key, so that a reader of some keys and
the compaction work bucket by bucket. Writing a segment again replaces it. Of
several rows with a key the one of the highest order stands, whichever segment
it came in; a deleted scope (e.g. a repository) hides its rows up to an order,
so rows sent again later are back.

``compact`` writes the standing rows as one new segment and then removes the
ones it has read, oldest first and the deletions last: a reader in between, or
after a crash, sees the same rows, only more copies of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_if_written

BUCKETS = 32


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def upsert(rows: DataFrame, path: str, keys: list[str], segment: str, buckets: int = BUCKETS) -> None:
    """Write ``rows`` as a segment; a segment's name is a batch's own, so a batch run again replaces what it wrote."""
    (rows.withColumn("bucket", _bucket(keys, buckets)).repartition("bucket")
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/segments/segment={segment}"))


def delete(scopes: DataFrame, path: str, segment: str) -> None:
    """Hide all rows of the scopes, (scope columns, order): those of that order and before."""
    scopes.write.mode("overwrite").parquet(f"{path}/deleted/{segment}")


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``, oldest first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found = [s for s in fs.listStatus(at) if s.isDirectory()]
    return [s.getPath().getName() for s in sorted(found, key=lambda s: (s.getModificationTime(), s.getPath().getName()))]


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def read(spark: SparkSession, path: str, keys: list[str], order_col: str, scope: list[str] = (), segments: list[str] | None = None,
         deleted: list[str] | None = None) -> DataFrame | None:
    """The standing row of each key; None where nothing has been written. Partial aggregates keep one row per key and task."""
    segments = _folders(spark, f"{path}/segments") if segments is None else segments
    if not segments:
        return None
    rows = spark.read.option("basePath", f"{path}/segments").option("mergeSchema", "true").parquet(*[f"{path}/segments/{s}" for s in segments]).drop("bucket", "segment")
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order_col, F.xxhash64(*rest))).alias("r")).select(*keys, "r.*")
    hidden = _folders(spark, f"{path}/deleted") if deleted is None else deleted
    gone = read_if_written(spark, f"{path}/deleted/*") if hidden else None
    if gone is None or not scope:
        return last
    until = gone.groupBy(*scope).agg(F.max(order_col).alias("_until"))
    return last.join(until, list(scope), "left").where(F.col("_until").isNull() | (F.col(order_col) > F.col("_until"))).drop("_until").select(*rows.columns)


def compact(spark: SparkSession, path: str, keys: list[str], order_col: str, scope: list[str] = (), buckets: int = BUCKETS) -> int:
    """One segment of the standing rows in place of all that are there now; how many were merged."""
    segments, deleted = _folders(spark, f"{path}/segments"), _folders(spark, f"{path}/deleted")
    rows = read(spark, path, keys, order_col, scope, segments, deleted)
    if rows is None:
        return 0
    upsert(rows, path, keys, f"compacted-{uuid.uuid4().hex}", buckets)
    for s in segments:
        _remove(spark, f"{path}/segments/{s}")
    for s in deleted:
        _remove(spark, f"{path}/deleted/{s}")
    return len(segments)
