"""Job-level entry points matching the reference's endpoints, over a parquet store.

Store layout under ``store``::

    repositories/        one row per repository (get-or-create)
    commits/             one row per stored commit row (duplicates allowed; read collapsed)
    vectors/repo_id=.../ function vectors (sparse hashed by default) + payload
    index/               bucket index of the vectors (operators/ann), a folder per call
    warnings/            warnings with deterministic ids
    edges/<type>/        modifies, imports, contains, uses_table, calls_api
    events/              outcome-event log (append only)

Every write is an append of rows with deterministic ids, and every read
collapses by id, so re-running a job after a failure does not duplicate
results. All work is Spark jobs over whole tables; nothing is collected.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import ann as A
from ..operators import clusters as CL
from ..operators import diffs as D
from ..operators import graph as G
from ..operators import history as H
from ..operators import imports as IM
from ..operators import reverts as RV
from ..operators import risk as R
from ..operators import vectors as V
from ..session import materialize, read_if_written
from ..sources import commits as SC
from ..sources import sinks as SK

# Production index of the 768 hashed dimensions at the threshold of 0.80.
INDEX = A.LshPlan()
EDGE_TYPES = ("modifies", "imports", "contains", "uses_table", "calls_api")


def _path(store: str, *parts: str) -> str:
    return os.path.join(store, *parts)


def _changed(files: DataFrame) -> DataFrame:
    """Changed functions of exploded file rows (repo_id, sha, file_pos, file_path, diff, file_content)."""
    f = files.withColumn("file_key", F.sha2(F.concat_ws("|", "repo_id", "sha", "file_path"), 256))
    f = D.by_file(f, ["file_key"])
    ch = D.changed_functions(f, ["file_key"])
    return ch.join(f.select("file_key", "repo_id", "sha"), "file_key")


def _store_repositories(spark: SparkSession, repo_ids: DataFrame, store: str) -> None:
    """Get-or-create — append only repositories not stored yet."""
    existing = read_if_written(spark, _path(store, "repositories"))
    if existing is None:
        existing = spark.createDataFrame([], "id string, repo_id string, name string")
    new = SC.upsert_repositories(existing, repo_ids.select("repo_id")).join(existing.select("repo_id"),
                                                                           "repo_id", "left_anti")
    SK.write_table(new.select("id", "repo_id", "name"), _path(store, "repositories"))


def _store_commits(commits: DataFrame, store: str, flags: DataFrame | None = None) -> None:
    c = commits.select("repo_id", "seq", "sha", "author", "message", F.current_timestamp().alias("date"))
    c = c.withColumn("revert_status", F.lit(False)).withColumn("bug_ids", F.array().cast("array<string>"))
    if flags is not None:
        c = RV.mark_reverted(c, flags.select("sha"))
    SK.write_table(SK.with_id(c, "repo_id", "sha", "seq"), _path(store, "commits"))


def _store_edges(files: DataFrame, store: str) -> None:
    edges = G.kg_edges(files.where(S.detect_language("file_path").isNotNull()), keys=["repo_id"])
    for name in EDGE_TYPES:
        SK.write_table(edges[name], _path(store, "edges", name))


def _store_vectors(fns: DataFrame, store: str) -> DataFrame:
    """Embed each distinct (repo, code hash) once and append the vectors."""
    fns = fns.withColumn("code_hash", S.code_hash("new_body"))
    known = read_if_written(fns.sparkSession, _path(store, "vectors"))
    known = None if known is None else known.select("repo_id", "code_hash", "indices", "values").dropDuplicates(
        ["repo_id", "code_hash"])
    vec = V.embed_dedup(fns, ["repo_id"], "code_hash", "new_body", known=known)
    vec = SK.with_id(vec, "repo_id", "sha", "file_path", "function_name")
    vec = vec.select("id", "repo_id", "seq", F.col("sha").alias("commit_sha"), "function_name", "file_path",
                     "start_line", "end_line", "code_hash", F.col("new_body").alias("code_body"),
                     "indices", "values")
    vec = materialize(vec)
    SK.write_vectors(vec, _path(store, "vectors"))
    _store_index(vec, store)
    return vec


def _store_index(vec: DataFrame, store: str) -> None:
    A.append_index(vec, _path(store, "index"), INDEX, uuid.uuid4().hex, id_col="id", order_col="seq", sparse=("indices", "values"))


def backfill(spark: SparkSession, batches: DataFrame, store: str, *, files_per_commit: int | None = None,
             max_lines: int | None = None) -> DataFrame:
    """POST /backfill for many repositories at once: detect reverts over each
    repository's commit list, store commits (flagged), changed-function
    vectors and graph edges. Returns the per-repository counters (A6). All files
    and lines count unless ``files_per_commit`` or ``max_lines`` set a limit."""
    sent = SC.explode_commits(batches).withColumn("seq", F.col("commit_pos").cast("long"))
    commits = SC.first_sent(sent, "seq")
    _store_repositories(spark, batches.select("repo_id").distinct(), store)
    reverted = RV.detect_reverts(commits)
    _store_commits(commits, store, reverted)
    files = SC.files_of(sent, "seq")
    with_files = files.where(F.col("file_path").isNotNull())
    capped = SC.cap_files_per_commit(with_files, commit_cols=("repo_id", "sha"), order_col="file_pos", n=files_per_commit)
    if max_lines is not None:
        capped = capped.withColumn("file_content", SC.truncate_lines(F.col("file_content"), max_lines))
    # no parent diff (root commit / new file): an all-added diff of the truncated content
    capped = capped.withColumn("diff", F.when(F.coalesce(F.length("diff"), F.lit(0)) == 0,
                                              SC.synthetic_diff(F.col("file_content"))).otherwise(F.col("diff")))
    fns = _changed(capped).join(commits.select("repo_id", "sha", "seq"), ["repo_id", "sha"])
    vec = _store_vectors(fns, store)
    _store_edges(capped, store)
    n_fn = vec.groupBy("repo_id").agg(F.count(F.lit(1)).alias("functions_embedded"))
    per_commit = files.groupBy("repo_id", "sha").agg(F.count("file_path").alias("_n"))
    summary = per_commit.groupBy("repo_id").agg(
        F.count_if(F.col("_n") > 0).alias("commits_with_diffs"), F.count_if(F.col("_n") == 0).alias("commits_skipped"))
    rv = reverted.groupBy("repo_id").agg(F.count(F.lit(1)).alias("reverts_detected"))
    return (summary.join(n_fn, "repo_id", "left").join(rv, "repo_id", "left")
                   .fillna(0, ["functions_embedded", "reverts_detected"]))


def collapsed_commits(spark: SparkSession, store: str) -> DataFrame:
    """The outcome source of truth: stored commit rows collapsed, with the event log applied."""
    c = spark.read.parquet(_path(store, "commits"))
    log = read_if_written(spark, _path(store, "events"))
    if log is not None:
        marks = (log.where((F.col("kind") == "revert") | (F.col("kind") == "ci")
                           | ((F.col("kind") == "pull_request") & S.rejected("closed", "merged")))
                    .select("commit_sha").distinct())
        c = RV.mark_reverted(c, marks.withColumnRenamed("commit_sha", "sha"))
        ci = log.where(F.col("kind") == "ci")
        c = RV.apply_ci_failures(c, ci, ci_as_bug_only=True)
    return R.collapse_commits(c)


def analyze(spark: SparkSession, batch: DataFrame, store: str, *, threshold: float = 0.80,
            limit: int = 10, search: str = "index") -> DataFrame:
    """POST /analyze for a batch of new commits (analyze-request rows with
    nested diffs): changed functions are searched against the stored vectors
    of their repository (and earlier functions of the batch), warnings are
    stored, then the new vectors, commits and edges are stored.

    ``search``: ``index`` probes the stored bucket index (exact scores, recall
    below 1), ``exact`` scores every stored vector of the repository."""
    if search not in ("index", "exact"):
        raise ValueError(f"unknown search {search!r}")
    sent = batch.select("repo_id", F.col("commit_sha").alias("sha"), "author", "message", "diffs", F.col("seq").cast("long").alias("seq"))
    commits = SC.first_sent(sent, "seq")
    _store_repositories(spark, commits.select("repo_id").distinct(), store)
    files = SC.files_of(sent, "seq").where(F.col("file_path").isNotNull())
    fns = _changed(files).join(commits.select("repo_id", "sha", "seq"), ["repo_id", "sha"])
    fns = SK.with_id(fns, "repo_id", "sha", "file_path", "function_name").withColumn("code_hash", S.code_hash("new_body"))
    stored = read_if_written(spark, _path(store, "vectors"))
    # embedding cache: a (repository, code hash) with a stored vector is not embedded again
    known = None if stored is None else stored.select("repo_id", "code_hash", "indices", "values").dropDuplicates(
        ["repo_id", "code_hash"])
    new = V.embed_dedup(fns, ["repo_id"], "code_hash", "new_body", known=known)
    new = materialize(new.select("id", "repo_id", "seq", F.col("sha").alias("commit_sha"), "function_name",
                                 "file_path", "start_line", "end_line", "code_hash",
                                 F.col("new_body").alias("code_body"), "indices", "values"))
    # as-of on t: stored vectors (t = -1) come before the batch; inside the
    # batch a function sees functions of earlier commits only
    q = new.select("id", "repo_id", F.col("seq").alias("t"), "commit_sha", "function_name", "file_path", "indices", "values")
    hist = q
    if stored is not None:
        repos = q.select("repo_id").distinct()
        # a commit sent to several calls has its vectors stored under one id each time
        old = (stored.join(repos, "repo_id", "left_semi").dropDuplicates(["repo_id", "id"])
                     .select("id", "repo_id", F.lit(-1).cast("long").alias("t"),
                             "commit_sha", "function_name", "file_path", "indices", "values"))
        hist = old.unionByName(q)
    if read_if_written(spark, _path(store, "commits")) is not None:
        outcome = collapsed_commits(spark, store)
    else:
        outcome = R.collapse_commits(commits.withColumn("revert_status", F.lit(False))
                                            .withColumn("bug_ids", F.array().cast("array<string>")))
    sparse = ("indices", "values")

    def probe(queries: DataFrame, k: int, least: float) -> DataFrame:
        own = A.bucketed(queries, INDEX, ["repo_id"], "id", "t", sparse=sparse)
        rows = A.read_index(spark, _path(store, "index"))
        if rows is not None:
            own = rows.withColumn("_ord", F.lit(-1).cast("long")).unionByName(own)
        return A.search(A.bucketed(queries, INDEX, ["repo_id"], "id", "t", sparse=sparse, probing=True), own, k=k, threshold=least, asof=True, dims=INDEX.dims)

    ranked = R.rank_matches(hist, outcome, queries=q, id_col="id", order_col="t", threshold=threshold, limit=limit,
                            sparse=sparse, search=probe if search == "index" else None)
    warns = R.assemble_warnings(ranked, new, id_col="id", graph_risk=_file_risk(spark, store))
    warns = warns.withColumn("created_at", F.current_timestamp())
    warns = materialize(warns)
    SK.write_table(warns, _path(store, "warnings"))
    _store_commits(commits, store)
    # the live path records graph edges only for files with changed functions
    _store_edges(files.join(fns.select("repo_id", "sha", "file_path").distinct(),
                            ["repo_id", "sha", "file_path"], "left_semi"), store)
    vec = new.select("id", "repo_id", "seq", "commit_sha", "function_name", "file_path", "start_line", "end_line",
                     "code_hash", "code_body", "indices", "values")
    SK.write_vectors(vec, _path(store, "vectors"))
    _store_index(vec, store)
    return warns


def _file_risk(spark: SparkSession, store: str) -> DataFrame | None:
    """The dependency risk of the files of earlier calls, for the warnings' extra column."""
    if read_if_written(spark, _path(store, "edges", "modifies")) is None:
        return None
    return dependency_risk(spark, store).select("repo_id", "file_path", "graph_risk_score")


def record_outcome_events(events: DataFrame, store: str) -> None:
    """POST /webhook/*: append normalised outcome events (kind, ts, commit_sha, pipeline, merged, closed).

    A push (``push_commits``, where the events have it) names commits that it
    reverts; each becomes a revert event of its own, so the outcome view and
    the stored warnings see it like any other."""
    cols = ["event_id", "ts", "kind", "commit_sha", "pipeline", "merged", "closed"]
    log = events.select(*cols)
    if "push_commits" in events.columns:
        pushed = (events.where(F.col("kind") == "push").select("event_id", "ts", F.posexplode("push_commits").alias("_pos", "c"))
                        .select("event_id", "ts", "_pos", F.col("c.id").alias("sha"), "c.message"))
        named = RV.push_reverts(pushed.drop("ts"), push_col="event_id").join(events.select("event_id", "ts"), "event_id")
        log = log.unionByName(named.select("event_id", "ts", F.lit("revert").alias("kind"), F.col("target_sha").alias("commit_sha"), F.lit(None).cast("string").alias("pipeline"),
                                           F.lit(False).alias("merged"), F.lit(False).alias("closed")))
    SK.write_table(log, _path(store, "events"))


def history_page(spark: SparkSession, store: str, page: int = 1, limit: int = 20) -> DataFrame:
    """GET /history/{repo}: one page of warnings per repository, newest first, with totals."""
    w = spark.read.parquet(_path(store, "warnings")).dropDuplicates(["id"])
    return H.history_page(w, page, limit)


def statistics(spark: SparkSession, store: str) -> DataFrame:
    """GET /history/{repo}/stats: commits analysed, warnings by level, top files, clusters of duplicated logic."""
    c = spark.read.parquet(_path(store, "commits"))
    w = spark.read.parquet(_path(store, "warnings")).dropDuplicates(["id"])
    cm = c.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total_commits_analyzed"))
    tf = (H.top_risky_files(w).groupBy("repo_id")
           .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "file_path"))),
                                         lambda s: s["file_path"]), ",").alias("top_risky_files")))
    v = spark.read.parquet(_path(store, "vectors")).dropDuplicates(["repo_id", "id"])
    dup = (CL.duplicate_clusters(v, v.select("repo_id", "id", "indices", "values"), id_col="id")
             .groupBy("repo_id").agg(F.countDistinct("cluster_id").alias("duplicate_clusters")))
    return (cm.join(H.warnings_by_risk(w), "repo_id", "left").join(tf, "repo_id", "left").join(dup, "repo_id", "left")
              .fillna(0, ["n_high", "n_medium", "n_low", "total_warnings", "duplicate_clusters"]))


def _edges(spark: SparkSession, store: str) -> dict[str, DataFrame]:
    """The stored edges; imports between files of a repository end at the file, not at the specifier."""
    e = {n: spark.read.parquet(_path(store, "edges", n)).dropDuplicates() for n in EDGE_TYPES}
    return e | {"imports": IM.file_edges(IM.resolve_imports(e["imports"], e["modifies"]))}


def dependency_risk(spark: SparkSession, store: str) -> DataFrame:
    """GET /graph/risk: graph risk per file; revert flags from the collapsed commits."""
    e = _edges(spark, store)
    flags = collapsed_commits(spark, store).select("repo_id", "sha", F.col("revert_status").alias("_r"))
    mods = (e["modifies"].join(flags, ["repo_id", "sha"], "left")
                         .withColumn("is_reverted", F.col("is_reverted") | F.coalesce("_r", F.lit(False)))
                         .drop("_r"))
    return G.graph_risk(e["uses_table"], e["calls_api"], mods, e["imports"], keys=["repo_id"])


def blast_radius(spark: SparkSession, store: str) -> DataFrame:
    """GET /graph/blast-radius: direct dependents with functions, plus indirect ones."""
    e = _edges(spark, store)
    direct = G.direct_dependents(e["imports"], e["contains"], keys=["repo_id"])
    indirect = G.indirect_dependents(e["imports"], keys=["repo_id"])
    return (direct.select("repo_id", "file_path", "dependent", "functions")
                  .unionByName(indirect.select("repo_id", "file_path", "dependent",
                                               F.array(F.lit("(indirect dependency)")).alias("functions"))))
