"""Revert detection and outcome updates.

All updates are monotone — a revert flag only turns on, bug ids are only
added — so the outcome view is an aggregate over the commit rows and an
append-only event log; replaying or reordering events gives the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

PREFIX_KEY = 7  # hash-join key length for sha-prefix references


def _strip(c):
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def revert_refs(commits: DataFrame, *, repo_col="repo_id", seq_col="seq",
                sha_col="sha", msg_col="message") -> DataFrame:
    """(repo, seq, sha, pattern, ref) for every commit whose message matches."""
    r = commits.select(repo_col, seq_col, sha_col, S.revert_ref(msg_col).alias("_r"))
    return (r.where(F.col("_r").isNotNull())
             .select(repo_col, seq_col, sha_col, F.col("_r.pattern").alias("pattern"),
                     F.col("_r.ref").alias("ref")))


def _first_two_by_prefix(commits: DataFrame, repo_col, seq_col, sha_col) -> DataFrame:
    """For every (repo, prefix of length 0..6): the two earliest commits.

    The empty and one-character prefixes are hot keys (they hold a sixteenth
    or all of a repository); ``row_number() <= 2`` is planned as a partial
    window-group limit before the shuffle, so each map task sends at most two
    rows per key.
    """
    p = commits.select(repo_col, seq_col, sha_col,
                       F.explode(F.sequence(F.lit(0), F.lit(PREFIX_KEY - 1))).alias("_len"))
    p = p.withColumn("prefix", F.substring(sha_col, 1, F.col("_len")))
    p = p.withColumn("prefix", F.when(F.col("_len") == 0, F.lit("")).otherwise(F.col("prefix")))
    w = Window.partitionBy(repo_col, "prefix").orderBy(seq_col, sha_col)
    return (p.withColumn("_k", F.row_number().over(w)).where("_k <= 2")
             .select(repo_col, "prefix", F.col(seq_col).alias("_oseq"), F.col(sha_col).alias("_osha")))


def detect_reverts(commits: DataFrame, *, repo_col="repo_id", seq_col="seq",
                   sha_col="sha", msg_col="message", with_source: bool = False) -> DataFrame:
    """Commits reverted according to the messages of a commit set.

    For every reverting commit (first matching pattern only), both cases apply:
    * sha case (J5): the first other commit in list order whose sha starts with
      the reference — refs of 7+ chars join on a 7-char prefix key with a
      ``startswith`` residual, shorter refs (even empty) on a table of the two
      earliest commits per short prefix;
    * message case (J6): the last commit in list order whose stripped message
      equals the reference, if it is not the reverting commit.
    Returns distinct (repo, sha) (plus the reverting sha with ``with_source``).
    """
    refs = revert_refs(commits, repo_col=repo_col, seq_col=seq_col, sha_col=sha_col, msg_col=msg_col)
    refs = refs.select(repo_col, F.col(seq_col).alias("_rseq"), F.col(sha_col).alias("_rsha"), "ref")

    # sha case, long refs
    long_refs = refs.where(F.length("ref") >= PREFIX_KEY).withColumn("prefix", F.substring("ref", 1, PREFIX_KEY))
    targets = commits.select(repo_col, F.col(seq_col).alias("_oseq"), F.col(sha_col).alias("_osha"),
                             F.substring(sha_col, 1, PREFIX_KEY).alias("prefix"))
    by_long = (long_refs.join(targets, [repo_col, "prefix"])
                        .where(F.col("_osha").startswith(F.col("ref")) & (F.col("_osha") != F.col("_rsha"))))
    # sha case, short refs
    short_refs = refs.where(F.length("ref") < PREFIX_KEY).withColumn("prefix", F.col("ref"))
    by_short = (short_refs.join(_first_two_by_prefix(commits, repo_col, seq_col, sha_col), [repo_col, "prefix"])
                          .where(F.col("_osha") != F.col("_rsha")))
    cols = [repo_col, "_rseq", "_rsha", "_oseq", "_osha"]
    by_sha = by_long.select(*cols).unionByName(by_short.select(*cols))
    w = Window.partitionBy(repo_col, "_rseq").orderBy("_oseq", "_osha")
    first = by_sha.withColumn("_k", F.row_number().over(w)).where("_k = 1").select(*cols)

    # message case
    msgs = (commits.select(repo_col, seq_col, sha_col, _strip(F.col(msg_col)).alias("_m"))
                   .where(F.col("_m") != "")
                   .groupBy(repo_col, "_m")
                   .agg(F.max_by(F.col(sha_col), F.col(seq_col)).alias("_osha")))
    by_msg = (refs.join(msgs, (refs[repo_col] == msgs[repo_col]) & (refs["ref"] == msgs["_m"]))
                  .where(F.col("_osha") != F.col("_rsha"))
                  .select(refs[repo_col].alias(repo_col), "_rsha", "_osha"))

    both = first.select(repo_col, "_rsha", "_osha").unionByName(by_msg)
    if with_source:
        return both.select(repo_col, F.col("_osha").alias(sha_col),
                           F.col("_rsha").alias("reverted_by")).distinct()
    return both.select(repo_col, F.col("_osha").alias(sha_col)).distinct()


def push_reverts(pushes: DataFrame, *, push_col="push_id", sha_col="sha",
                 msg_col="message") -> DataFrame:
    """R2: revert targets named inside one push (GitHub push event).

    ``This reverts commit <sha>`` (case-sensitive) names a sha that must match
    a stored sha exactly; otherwise an unanchored ``Revert "<msg>"`` looks the
    message up among the commits of the same push (last one wins).
    Returns (push_id, target_sha).
    """
    sha_ref = F.regexp_extract(msg_col, r"This reverts commit ([a-f0-9]{7,40})", 1)
    msg_ref = F.regexp_extract(msg_col, r'(?i)Revert "(.+)"', 1)
    p = pushes.select(push_col, F.col("_pos"), sha_col, msg_col,
                      sha_ref.alias("_sref"), msg_ref.alias("_mref"))
    by_sha = p.where(F.col("_sref") != "").select(push_col, F.col("_sref").alias("target_sha"))
    lookup = (pushes.groupBy(push_col, msg_col)
                    .agg(F.max_by(sha_col, "_pos").alias("target_sha"))
                    .withColumnRenamed(msg_col, "_mref"))
    by_msg = (p.where((F.col("_sref") == "") & (F.col("_mref") != ""))
               .join(lookup, [push_col, "_mref"]).select(push_col, "target_sha"))
    return by_sha.unionByName(by_msg).distinct()


def mark_reverted(commits: DataFrame, shas: DataFrame, *, sha_col="sha") -> DataFrame:
    """Turn the revert flag on for every commit row whose sha is listed
    (exact match; shas of unknown commits change nothing)."""
    hit = shas.select(F.col(sha_col).alias("_hit")).distinct().withColumn("_on", F.lit(True))
    return (commits.join(hit, commits[sha_col] == hit["_hit"], "left")
                   .withColumn("revert_status", F.col("revert_status") | F.coalesce("_on", F.lit(False)))
                   .drop("_hit", "_on"))


def apply_ci_failures(commits: DataFrame, ci_events: DataFrame, *, sha_col="sha",
                      ci_as_bug_only: bool = False) -> DataFrame:
    """Each CI failure adds ``ci:{pipeline}:{sha7}`` to the bug ids once and,
    as the reference does, also sets the revert flag (``ci_as_bug_only`` keeps
    the flag, so the outcome becomes bug_linked)."""
    refs = (ci_events.select(F.col("commit_sha").alias("_hit"),
                             S.ci_bug_ref("pipeline", "commit_sha").alias("_ref"))
                     .groupBy("_hit").agg(F.collect_set("_ref").alias("_refs")))
    j = commits.join(refs, commits[sha_col] == refs["_hit"], "left")
    flag = F.col("revert_status") if ci_as_bug_only else (F.col("revert_status") | F.col("_hit").isNotNull())
    return (j.withColumn("bug_ids", F.array_sort(F.array_union(
                F.coalesce("bug_ids", F.array().cast("array<string>")),
                F.coalesce("_refs", F.array().cast("array<string>")))))
             .withColumn("revert_status", flag)
             .drop("_hit", "_refs"))


def recent_commits(commits: DataFrame, n: int = 200, *, repo_col="repo_id",
                   order_col="seq") -> DataFrame:
    """The newest ``n`` commits of every repository (partial top-k per task)."""
    w = Window.partitionBy(repo_col).orderBy(F.desc(order_col))
    return commits.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)


def client_revert_marks(commits: DataFrame, *, repo_col="repo_id", sha_col="sha",
                        msg_col="message") -> DataFrame:
    """What the editor client marks when it sees a new commit.

    ``This reverts commit <sha>`` (case-insensitive) sends that sha as written;
    the webhook matches it exactly, so only full shas of stored commits count.
    Otherwise ``Revert "<msg>"`` looks for the newest commit whose message
    contains ``<msg>`` right after the revert was committed — which is the
    revert commit itself, so the client marks its own commit (the reference's
    behaviour; the grep pattern is taken literally here).
    Returns distinct (repo, sha) that get marked.
    """
    m = F.col(msg_col)
    sha_ref = F.regexp_extract(m, r"(?i)This reverts commit ([a-f0-9]{7,40})", 1)
    is_msg = m.rlike(r'(?i)^Revert "(.+)"')
    named = (commits.where(sha_ref != "")
                    .select(repo_col, sha_ref.alias("_ref"))
                    .join(commits.select(repo_col, F.col(sha_col).alias("_ref")), [repo_col, "_ref"], "left_semi")
                    .select(repo_col, F.col("_ref").alias(sha_col)))
    own = commits.where((sha_ref == "") & is_msg).select(repo_col, sha_col)
    return named.unionByName(own).distinct()
