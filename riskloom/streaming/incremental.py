"""Incremental jobs with Structured Streaming.

T2 ``analyze_stream``: new functions arrive as a stream; every micro-batch is
embedded, searched against the stored vectors plus the earlier rows of the
same micro-batch (the as-of rule on ``seq``), its warnings are appended, then
its vectors are appended to the vector table — the same order as the
reference (search first, store after). ``foreachBatch`` plus idempotent
writes (deterministic ids; a batch re-run after a failure rewrites its own
``batch_id=`` folder) make a restart from the checkpoint safe.

T3 ``outcome_log_stream``: outcome events are appended to an event log; the
outcome view is an aggregate over commits and log (monotone flags), so event
order and replays do not change it. T4: events for commits not yet known
stay in the log and apply once the commit arrives (``mode='deferred'``);
``mode='compat'`` drops them at arrival like the reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import risk as R
from ..operators import vectors as V
from ..session import materialize, read_if_written


def _write_batch(df: DataFrame, path: str, batch_id: int, partition_by: tuple[str, ...] = ()) -> None:
    """Idempotent append: the micro-batch owns its ``batch_id=`` partitions and
    a retry overwrites exactly those (dynamic partition overwrite)."""
    (df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic")
       .partitionBy("batch_id", *partition_by).parquet(path))


def analyze_stream(functions_stream: DataFrame, commits: DataFrame, *, vectors_path: str,
                   warnings_path: str, checkpoint: str, threshold: float = 0.8, limit: int = 10,
                   text_col: str = "code_body", trigger_once: bool = True):
    """Start the T2 query; returns the StreamingQuery.

    ``functions_stream`` rows: (repo_id, seq, commit_sha, function_name,
    file_path, code_body). ``commits``: collapsed commits (outcome source).
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        fns = batch.select("repo_id", "seq", "commit_sha", "function_name", "file_path", text_col)
        vec = V.embed_hashed_sparse(fns, ["repo_id", "seq"], text_col)
        # read four times below (queries, history, metadata, sink): embed once
        vec = materialize(vec.join(fns.drop(text_col), ["repo_id", "seq"]))
        stored = read_if_written(spark, vectors_path)
        if stored is not None:
            stored = stored.drop("batch_id")
            # only the repositories of this micro-batch: the semi join on the
            # partition column lets dynamic partition pruning skip the others
            repos = vec.select("repo_id").distinct()
            history = stored.join(repos, "repo_id", "left_semi").unionByName(vec)
        else:
            history = vec
        ranked = R.rank_matches(history, commits, queries=vec, meta=history, threshold=threshold,
                                limit=limit, sparse=("indices", "values"))
        warns = R.assemble_warnings(ranked, fns).withColumn("created_at", F.current_timestamp())
        _write_batch(warns, warnings_path, batch_id)
        _write_batch(vec, vectors_path, batch_id, partition_by=("repo_id",))

    w = functions_stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()


def outcome_log_stream(events_stream: DataFrame, *, log_path: str, checkpoint: str,
                       trigger_once: bool = True):
    """Append outcome events to the event log."""
    w = (events_stream.writeStream.format("parquet").option("path", log_path)
                      .option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()


def outcome_view(commits: DataFrame, log: DataFrame, mode: str = "deferred") -> DataFrame:
    """Commits with flags from the event log (revert, CI failure, rejected PR).

    ``compat`` keeps only events whose commit was known when the event
    arrived (``seen_at <= event ts``; the commits must carry ``seen_at``)."""
    if mode not in ("deferred", "compat"):
        raise ValueError(f"unknown mode {mode!r}")
    ev = log
    if mode == "compat":
        if "seen_at" not in commits.columns:
            raise ValueError("compat mode needs commits with seen_at")
        known = commits.select(F.col("sha").alias("commit_sha"), "seen_at")
        ev = ev.join(known, "commit_sha").where(F.col("seen_at") <= F.col("ts")).drop("seen_at")
    marks = (ev.where((F.col("kind") == "revert") | (F.col("kind") == "ci")
                      | ((F.col("kind") == "pull_request") & S.rejected("closed", "merged")))
               .select(F.col("commit_sha").alias("_hit")).distinct())
    return (commits.join(marks, commits["sha"] == marks["_hit"], "left")
                   .withColumn("revert_status", F.col("revert_status") | F.col("_hit").isNotNull())
                   .drop("_hit"))
