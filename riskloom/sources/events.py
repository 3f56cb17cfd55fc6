"""Outcome-event source (S8): revert / CI / GitHub pull-request / push bodies.

One explicit schema covers every body kind (the route or GitHub event name
arrives as ``kind``); JSON is never inferred, and a malformed record lands in
``_corrupt_record``. ``normalize_outcome_events`` flattens the bodies into one
event table (kind, ts, commit_sha, pipeline, merged, ...), keeping push
commit lists for ``push_reverts``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OUTCOME_EVENT = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("repo_id", T.StringType()),
    T.StructField("commit_sha", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("pipeline", T.StringType()),
    T.StructField("failure_message", T.StringType()),
    T.StructField("build_url", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("pull_request", T.StructType([
        T.StructField("number", T.LongType()), T.StructField("merged", T.BooleanType()),
        T.StructField("head", T.StructType([T.StructField("sha", T.StringType())]))])),
    T.StructField("commits", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()), T.StructField("message", T.StringType())]))),
    T.StructField("_corrupt_record", T.StringType()),
])


def read_outcome_events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return (reader.schema(OUTCOME_EVENT).option("mode", "PERMISSIVE")
                  .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))


def normalize_outcome_events(raw: DataFrame) -> DataFrame:
    """(event_id, ts, kind, commit_sha, pipeline, merged, closed, push_commits)."""
    pr = F.col("pull_request")
    sha = F.when(F.col("kind") == "pull_request", pr["head"]["sha"]).otherwise(F.col("commit_sha"))
    return raw.where(F.col("_corrupt_record").isNull()).select(
        "event_id", "ts", "kind", sha.alias("commit_sha"), "pipeline",
        F.coalesce(pr["merged"], F.lit(False)).alias("merged"),
        (F.col("action") == "closed").alias("closed"),
        F.col("commits").alias("push_commits"))
