"""Similarity ranking and risk operators.

Pipeline per query function, as the reference does it one function at a time,
here for all query functions at once:

    top-(2·limit) by score  ->  drop matches of the query's own commit
    -> left join the collapsed commits (outcome source of truth)
    -> outcome, weight, risk = round(score, 4) · weight
    -> keep the best match per (query, matched commit)
    -> rerank by risk desc (stable: fetch order) -> first ``limit``

Every step is a window over the query id (bounded: at most 2·limit rows per
query) or an equi join on (repo, sha); AQE turns the commit join into a
broadcast when the collapsed commit table is small and keeps it a shuffle
join otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .vectors import DEFAULT_LIMIT, DEFAULT_THRESHOLD, cosine_topk, vector_id

COMMIT_FIELDS = ("author", "message", "date")


def collapse_commits(commits: DataFrame, key_cols=("repo_id", "sha"),
                     seq_col: str = "seq", bug_col: str = "bug_ids") -> DataFrame:
    """One row per (repo, sha): any revert flag, union of bug ids, latest metadata.

    The reference stores duplicate commit rows (no uniqueness on sha); this is
    the view every outcome lookup goes through. Every aggregate is partial:
    bug ids are exploded first and ``collect_set`` keeps only distinct ids per
    map task, so a sha stored a billion times costs its distinct bug ids.
    """
    key_cols = list(key_cols)
    is_array = dict(commits.dtypes).get(bug_col, "").startswith("array")
    if is_array:
        x = commits.select("*", F.posexplode_outer(bug_col).alias("_bpos", "_bug"))
        first = F.col("_bpos").isNull() | (F.col("_bpos") == 0)   # one per original row
    else:
        x = commits.withColumn("_bug", F.col(bug_col))
        first = F.lit(True)
    return (x.groupBy(*key_cols)
             .agg(F.bool_or(F.coalesce("revert_status", F.lit(False))).alias("revert_status"),
                  F.array_sort(F.collect_set("_bug")).alias("bug_ids"),
                  *[F.max_by(c, seq_col).alias(c) for c in COMMIT_FIELDS if c in commits.columns],
                  F.max(seq_col).alias(seq_col),
                  F.count_if(first).alias("n_rows")))


def enrich_matches(matches: DataFrame, commits: DataFrame, *,
                   repo_col: str = "repo_id", sha_col: str = "commit_sha") -> DataFrame:
    """J3 + F7 + F9: left join each match to its commit, derive outcome and risk.

    The commit's author, message and date, where ``commits`` has them, follow
    as ``matched_author``, ``matched_message`` and ``matched_date``."""
    c = commits.select(F.col("repo_id").alias(repo_col), F.col("sha").alias(sha_col),
                       F.col("revert_status").alias("_rs"), F.col("bug_ids").alias("_bugs"),
                       *[F.col(x).alias(f"matched_{x}") for x in COMMIT_FIELDS if x in commits.columns])
    m = matches.join(c, [repo_col, sha_col], "left")
    outcome = S.commit_outcome("_rs", "_bugs")
    return (m.withColumn("outcome", outcome)
             .withColumn("revert_status", F.coalesce("_rs", F.lit(False)))
             .withColumn("bug_ids", F.coalesce("_bugs", F.array().cast("array<string>")))
             .withColumn("score", F.round("score", 4))
             .withColumn("risk_score", S.risk_score("score", "outcome"))
             .drop("_rs", "_bugs"))


def rank_matches(vectors: DataFrame, commits: DataFrame, *,
                 queries: DataFrame | None = None, meta: DataFrame | None = None,
                 threshold: float = DEFAULT_THRESHOLD, limit: int = DEFAULT_LIMIT,
                 asof: bool = True, id_col: str = "seq", order_col: str | None = None,
                 block_rows: int = 2048, sparse: tuple[str, str] | None = None,
                 search: Callable[[DataFrame, int, float], DataFrame] | None = None) -> DataFrame:
    """V1–V8: outcome-aware ranked matches for every query function.

    ``vectors``: (repo_id, seq, commit_sha, function_name, file_path, vector, ...).
    ``queries`` defaults to ``vectors`` (replay: each function searched against
    the earlier ones when ``asof``). ``commits``: collapsed commits. ``meta``
    (id, commit_sha, function_name, file_path) defaults to ``vectors``; pass
    the cheap source table so the vector plan is not re-evaluated for it.
    ``search(queries, k, threshold)`` replaces the exact search, e.g. by that
    of a stored index; it gives (repo_id, query_id, match_id, score, rank).
    Returns (repo_id, query_seq, match_seq, commit_sha, score, outcome,
    risk_score, rank, ...match payload).
    """
    queries = vectors if queries is None else queries
    meta = vectors if meta is None else meta
    if search is not None:
        top = search(queries, 2 * limit, threshold)
    else:
        top = cosine_topk(queries, vectors, key_cols=["repo_id"], id_col=id_col,
                          threshold=threshold, k=2 * limit,
                          asof_col=(order_col or id_col) if asof else None, block_rows=block_rows, sparse=sparse)
    return rerank(fetched_matches(top, meta, id_col), commits, limit)


def fetched_matches(top: DataFrame, meta: DataFrame, id_col: str = "seq") -> DataFrame:
    """A search's rows with both commits and the match's place; matches of the query's own commit are left out (V4)."""
    top = top.withColumnRenamed("rank", "fetch_rank")
    mid = vector_id(meta, id_col)
    qmeta = meta.select("repo_id", mid.alias("query_id"), F.col("commit_sha").alias("query_sha"))
    hmeta = meta.select("repo_id", mid.alias("match_id"), "commit_sha",
                        "function_name", "file_path")
    return (top.join(qmeta, ["repo_id", "query_id"]).join(hmeta, ["repo_id", "match_id"])
            .where(F.col("commit_sha") != F.col("query_sha")))          # V4


def rerank(fetched: DataFrame, commits: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """V5–V8 of fetched matches (repo_id, query_id, match_id, score, fetch_rank, commit_sha, ...): outcome, one match
    per commit, order by risk, the first ``limit``. What a later outcome changes starts here again."""
    m = enrich_matches(fetched, commits)                                 # V5
    w_commit = Window.partitionBy("repo_id", "query_id", "commit_sha").orderBy("fetch_rank")
    m = m.withColumn("_k", F.row_number().over(w_commit)).where("_k = 1")  # V6
    w_rank = Window.partitionBy("repo_id", "query_id").orderBy(F.desc("risk_score"), "fetch_rank")
    m = m.withColumn("rank", F.row_number().over(w_rank)).where(F.col("rank") <= limit)  # V7, V8
    return (m.drop("_k")
             .withColumnRenamed("query_id", "query_seq")
             .withColumnRenamed("match_id", "match_seq"))


def high_risk(matches: DataFrame) -> DataFrame:
    """bad outcome and score >= 0.80."""
    return matches.where(S.is_high_risk("score", "outcome"))


def assemble_warnings(ranked: DataFrame, queries: DataFrame, *,
                      id_col: str = "seq", explanation=None,
                      graph_risk: DataFrame | None = None) -> DataFrame:
    """V9: one warning per high-risk match with all fields: the function's lines
    and the matched commit's fields too, where ``queries`` and ``ranked`` have them.

    ``explanation`` is an optional DataFrame (query_seq, match_seq, risk_level,
    explanation, historical_context, suggested_action) from a user scorer; the
    deterministic level rule and fallback texts fill the rest. ``graph_risk``
    (file_path, graph_risk_score [, repo_id]) adds the dependency risk of the
    warned file as an extra column (G12; the level is unchanged).
    """
    # ids may repeat across repositories
    q = queries.select("repo_id", vector_id(queries, id_col).alias("query_seq"),
                       F.col("commit_sha").alias("query_sha"),
                       F.col("function_name").alias("query_function"),
                       F.col("file_path").alias("query_path"),
                       *[c for c in ("start_line", "end_line") if c in queries.columns])
    given = [c for c in ("start_line", "end_line") if c in queries.columns]
    given += [f"matched_{c}" for c in COMMIT_FIELDS if f"matched_{c}" in ranked.columns]
    w = high_risk(ranked).drop("query_sha", "start_line", "end_line").join(q, ["repo_id", "query_seq"])
    fb = S.fallback_explanation("score", "outcome")
    if explanation is not None:
        keys = [c for c in ("repo_id",) if c in explanation.columns]
        w = w.join(explanation, [*keys, "query_seq", "match_seq"], "left")
        lvl = F.coalesce("risk_level", S.risk_level("score", "outcome"))
        exp = F.coalesce("explanation", fb["explanation"])
        ctx = F.coalesce("historical_context", fb["historical_context"])
        act = F.coalesce("suggested_action", fb["suggested_action"])
        w = w.drop("risk_level", "explanation", "historical_context", "suggested_action")
    else:
        lvl, exp, ctx, act = (S.risk_level("score", "outcome"), fb["explanation"],
                              fb["historical_context"], fb["suggested_action"])
    extra = []
    if graph_risk is not None:
        keys = [c for c in ("repo_id",) if c in graph_risk.columns]
        g = graph_risk.select(*keys, F.col("file_path").alias("query_path"), "graph_risk_score")
        w = w.join(g, [*keys, "query_path"], "left")
        extra = [F.coalesce("graph_risk_score", F.lit(0.0)).alias("graph_risk_score")]
    return w.select(
        F.sha2(F.concat_ws("|", "query_sha", "query_path", "query_function", "commit_sha"), 256).alias("id"),
        "repo_id", "query_seq", "query_sha", F.col("query_function").alias("function_name"),
        F.col("query_path").alias("file_path"), lvl.alias("risk_level"),
        F.col("score").alias("similarity_score"), F.col("commit_sha").alias("matched_commit_sha"),
        "match_seq", "outcome", "risk_score", exp.alias("explanation"),
        ctx.alias("historical_context"), act.alias("suggested_action"),
        F.lit(False).alias("dismissed"), *given, *extra)
