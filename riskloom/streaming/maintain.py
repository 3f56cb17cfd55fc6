"""Stored warnings kept up to date with outcome events.

``store_matches`` keeps, beside the warnings, every match that a search fetched:
what a later outcome can change is their order and level, not their scores. An
event then touches only the functions that have a match in one of its commits:
their matches are ranked again under the outcomes known now, their warnings
written, and those that no longer stand marked so. Both tables are keyed
(``sources.keyed``) and ordered by batch, so a batch that is run again after a
failure replaces what it wrote. The result equals ranking everything anew.

Events of commits that no match names change nothing now; they stay in the log
and count once such a commit is matched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import risk as R
from ..session import materialize
from ..sources import keyed as K
from .incremental import outcome_view

MATCH_KEYS = ["repo_id", "query_id", "match_id"]
WARNING_KEYS = ["id"]


def store_matches(fetched: DataFrame, commits: DataFrame, functions: DataFrame, path: str, *, id_col: str = "seq", limit: int = 10, batch: int = 0) -> None:
    """Store a search's fetched matches, its functions and the warnings they give now."""
    fetched = materialize(fetched)
    K.upsert(fetched.withColumn("batch", F.lit(batch)), f"{path}/matches", MATCH_KEYS, f"b{batch}")
    warns = R.assemble_warnings(R.rerank(fetched, commits, limit), functions, id_col=id_col)
    K.upsert(warns.withColumns({"batch": F.lit(batch), "standing": F.lit(True)}), f"{path}/warnings", WARNING_KEYS, f"b{batch}")


def standing_warnings(spark: SparkSession, path: str) -> DataFrame:
    return K.read(spark, f"{path}/warnings", WARNING_KEYS, "batch").where("standing").drop("standing", "batch")


def apply_outcomes(events: DataFrame, commits: DataFrame, log: DataFrame, functions: DataFrame, path: str, *, batch: int, id_col: str = "seq", limit: int = 10) -> None:
    """Rank the functions again that have a match in a commit of ``events``; ``log`` has all events so far, these included."""
    spark = events.sparkSession
    matches = K.read(spark, f"{path}/matches", MATCH_KEYS, "batch").drop("batch")
    named = events.select("commit_sha").where("commit_sha is not null").distinct()
    queries = materialize(matches.join(named, "commit_sha", "left_semi").select("repo_id", "query_id").distinct())
    touched = matches.join(queries, ["repo_id", "query_id"], "left_semi")
    fns = functions.join(queries.withColumnRenamed("query_id", id_col), ["repo_id", id_col], "left_semi")
    new = R.assemble_warnings(R.rerank(touched, R.collapse_commits(outcome_view(commits, log)), limit), fns, id_col=id_col)
    new = materialize(new.withColumn("standing", F.lit(True)))
    before = K.read(spark, f"{path}/warnings", WARNING_KEYS, "batch").drop("batch")
    gone = (before.where("standing").join(queries.withColumnRenamed("query_id", "query_seq"), ["repo_id", "query_seq"], "left_semi")
                  .join(new.select("id"), "id", "left_anti").withColumn("standing", F.lit(False)))
    K.upsert(new.unionByName(gone).withColumn("batch", F.lit(batch)), f"{path}/warnings", WARNING_KEYS, f"b{batch}")


def maintain_stream(events_stream: DataFrame, commits: DataFrame, functions: DataFrame, path: str, checkpoint: str, *, id_col: str = "seq", limit: int = 10):
    """Apply outcome events as they come; returns the StreamingQuery."""

    def run(events: DataFrame, batch_id: int) -> None:
        spark, log = events.sparkSession, f"{path}/events"
        events.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")
        apply_outcomes(spark.read.parquet(f"{log}/batch={batch_id}"), commits, spark.read.parquet(log).drop("batch"), functions, path,
                       batch=batch_id + 1, id_col=id_col, limit=limit)

    return events_stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
