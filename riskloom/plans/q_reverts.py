"""Revert, outcome and commit-table queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import reverts as RV
from ..operators.risk import collapse_commits
from ..session import ensure_checkpoint_dir
from ..sources import events as EV
from .catalog import query
from .fixtures import cte, fx

_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"

_REFS_SQL = """
m0 AS (SELECT repo_id, seq, sha, """ + _STRIP.format(x="message") + """ AS m FROM fx_commits),
refs AS (
  SELECT repo_id, seq, sha,
    CASE WHEN regexp_matches(m, '(?i)^Revert "(.+)"') THEN 1
         WHEN regexp_matches(m, '(?i)^Revert (.+)') THEN 2
         WHEN regexp_matches(m, '(?i)^revert\\s+([a-f0-9]{7,40})') THEN 3
         WHEN regexp_matches(m, '(?i)This reverts commit ([a-f0-9]{7,40})') THEN 4 END AS pattern,
    """ + _STRIP.format(x="""CASE WHEN regexp_matches(m, '(?i)^Revert "(.+)"') THEN regexp_extract(m, '(?i)^Revert "(.+)"', 1)
         WHEN regexp_matches(m, '(?i)^Revert (.+)') THEN regexp_extract(m, '(?i)^Revert (.+)', 1)
         WHEN regexp_matches(m, '(?i)^revert\\s+([a-f0-9]{7,40})') THEN regexp_extract(m, '(?i)^revert\\s+([a-f0-9]{7,40})', 1)
         WHEN regexp_matches(m, '(?i)This reverts commit ([a-f0-9]{7,40})') THEN regexp_extract(m, '(?i)This reverts commit ([a-f0-9]{7,40})', 1) END""") + """ AS ref
  FROM m0)
"""

_DETECT_SQL = cte("fx_commits") + ", " + _REFS_SQL + """,
r AS (SELECT * FROM refs WHERE pattern IS NOT NULL),
by_sha AS (SELECT r.repo_id, o.sha, row_number() OVER (PARTITION BY r.repo_id, r.seq ORDER BY o.seq, o.sha) AS k
           FROM r JOIN fx_commits o ON o.repo_id = r.repo_id AND starts_with(o.sha, r.ref) AND o.sha <> r.sha),
msgs AS (SELECT repo_id, m, max_by(sha, seq) AS sha FROM m0 WHERE m <> '' GROUP BY repo_id, m),
by_msg AS (SELECT r.repo_id, msgs.sha FROM r JOIN msgs ON msgs.repo_id = r.repo_id AND msgs.m = r.ref
           WHERE msgs.sha <> r.sha),
detected AS (SELECT repo_id, sha FROM by_sha WHERE k = 1 UNION SELECT repo_id, sha FROM by_msg)
"""


def _commits(spark, sf_dir):
    return fx(spark, sf_dir, "fx_commits").withColumn("bug_ids", F.array_compact(F.array("bug_id")))


@query("revert_refs", cte("fx_commits") + ", " + _REFS_SQL + """
SELECT repo_id, seq, sha, pattern, ref FROM refs WHERE pattern IS NOT NULL
""")
def revert_refs(spark, sf_dir):
    """first matching revert pattern and its reference per commit message."""
    return RV.revert_refs(fx(spark, sf_dir, "fx_commits"))


@query("detect_reverts", _DETECT_SQL + "SELECT repo_id, sha FROM detected")
def detect_reverts(spark, sf_dir):
    """R1 (J5 ∪ J6): commits reverted by messages of later commits of the same repository."""
    return RV.detect_reverts(fx(spark, sf_dir, "fx_commits"))


_PUSH_SQL = cte("fx_commits") + """,
p AS (SELECT CAST(floor(seq / 10) AS BIGINT) AS push_id, seq AS pos, sha, message FROM fx_commits),
s AS (SELECT push_id, regexp_extract(message, 'This reverts commit ([a-f0-9]{7,40})', 1) AS sref,
             regexp_extract(message, '(?i)Revert "(.+)"', 1) AS mref FROM p),
lk AS (SELECT push_id, message, max_by(sha, pos) AS target_sha FROM p GROUP BY push_id, message),
t AS (SELECT push_id, sref AS target_sha FROM s WHERE sref <> ''
      UNION SELECT s.push_id, lk.target_sha FROM s JOIN lk ON lk.push_id = s.push_id AND lk.message = s.mref
      WHERE s.sref = '' AND s.mref <> '')
"""


@query("push_reverts", _PUSH_SQL + """
SELECT DISTINCT t.push_id, c.repo_id, c.sha FROM t JOIN fx_commits c ON c.sha = t.target_sha
""")
def push_reverts(spark, sf_dir):
    """R2: push events (ten commits per push) -> stored commits they revert (exact sha)."""
    c = fx(spark, sf_dir, "fx_commits")
    pushes = c.select(F.floor(F.col("seq") / 10).cast("bigint").alias("push_id"),
                      F.col("seq").alias("_pos"), "sha", "message")
    t = RV.push_reverts(pushes)
    return (t.join(c.select("repo_id", F.col("sha").alias("target_sha"), "sha"), "target_sha")
             .select("push_id", "repo_id", "sha").distinct())


_EVENTS_COMMITS = cte("fx_commits", "fx_outcome_events")


@query("apply_reverts", _EVENTS_COMMITS + """
SELECT c.repo_id, c.sha, c.revert_status OR (e.commit_sha IS NOT NULL) AS revert_status
FROM fx_commits c LEFT JOIN (SELECT DISTINCT commit_sha FROM fx_outcome_events WHERE kind = 'revert') e
  ON e.commit_sha = c.sha
""")
def apply_reverts(spark, sf_dir):
    """Revert events turn the flag on for every row of a known sha."""
    c = fx(spark, sf_dir, "fx_commits")
    ev = fx(spark, sf_dir, "fx_outcome_events").where("kind = 'revert'")
    return RV.mark_reverted(c, ev.select(F.col("commit_sha").alias("sha"))).select("repo_id", "sha", "revert_status")


@query("apply_ci_failures", _EVENTS_COMMITS + """,
refs AS (SELECT commit_sha, list(DISTINCT concat_ws(':', 'ci', pipeline, substr(commit_sha, 1, 7))) AS r
         FROM fx_outcome_events WHERE kind = 'ci' GROUP BY commit_sha)
SELECT c.repo_id, c.sha, c.revert_status OR (refs.commit_sha IS NOT NULL) AS revert_status,
  array_to_string(list_sort(list_distinct(list_concat(CASE WHEN c.bug_id IS NULL THEN [] ELSE [c.bug_id] END,
                                                      coalesce(refs.r, [])))), ',') AS bug_ids
FROM fx_commits c LEFT JOIN refs ON refs.commit_sha = c.sha
""")
def apply_ci_failures(spark, sf_dir):
    """CI failures add a ci:{pipeline}:{sha7} bug id and set the revert flag."""
    c = _commits(spark, sf_dir)
    ev = fx(spark, sf_dir, "fx_outcome_events").where("kind = 'ci'")
    r = RV.apply_ci_failures(c, ev)
    return r.select("repo_id", "sha", "revert_status", F.array_join("bug_ids", ",").alias("bug_ids"))


@query("apply_pr_rejections", _EVENTS_COMMITS + """
SELECT c.repo_id, c.sha, c.revert_status OR (e.commit_sha IS NOT NULL) AS revert_status
FROM fx_commits c LEFT JOIN (SELECT DISTINCT commit_sha FROM fx_outcome_events
                             WHERE kind = 'pull_request' AND closed AND NOT merged) e ON e.commit_sha = c.sha
""")
def apply_pr_rejections(spark, sf_dir):
    """A pull request closed without merge marks its head commit reverted."""
    c = fx(spark, sf_dir, "fx_commits")
    ev = fx(spark, sf_dir, "fx_outcome_events").where("kind = 'pull_request' AND closed AND NOT merged")
    return RV.mark_reverted(c, ev.select(F.col("commit_sha").alias("sha"))).select("repo_id", "sha", "revert_status")


@query("outcome_events_norm", cte("fx_outcome_events") + """
SELECT event_id, kind, commit_sha, substr(commit_sha, 1, 7) AS short_sha,
  CASE WHEN kind = 'ci' THEN concat_ws(':', 'ci', pipeline, substr(commit_sha, 1, 7)) END AS bug_ref,
  kind IN ('revert', 'ci', 'pull_request', 'push') AS tracked,
  (kind = 'revert') OR (kind = 'ci') OR (kind = 'pull_request' AND closed AND NOT merged) AS marks_reverted
FROM fx_outcome_events
""")
def outcome_events_norm(spark, sf_dir):
    """Outcome event bodies, read as JSON lines and normalised to (kind, sha, bug reference, effect)."""
    given = fx(spark, sf_dir, "fx_outcome_events")
    is_pr = F.col("kind") == "pull_request"
    body = F.struct("event_id", "ts", "kind", F.when(~is_pr, F.col("commit_sha")).alias("commit_sha"), "pipeline",
                    F.when(F.col("closed"), "closed").otherwise("opened").alias("action"),
                    F.when(is_pr, F.struct("merged", F.struct(F.col("commit_sha").alias("sha")).alias("head"))).alias("pull_request"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/outcome-events-{uuid.uuid4().hex}"
    given.select(F.to_json(body).alias("value")).write.text(path)
    e = EV.normalize_outcome_events(EV.read_outcome_events(spark, path))
    return e.select("event_id", "kind", "commit_sha", S.short_sha("commit_sha").alias("short_sha"),
                    F.when(F.col("kind") == "ci", S.ci_bug_ref("pipeline", "commit_sha")).alias("bug_ref"),
                    F.col("kind").isin("revert", "ci", "pull_request", "push").alias("tracked"),
                    ((F.col("kind") == "revert") | (F.col("kind") == "ci")
                     | ((F.col("kind") == "pull_request") & S.rejected("closed", "merged"))).alias("marks_reverted"))


@query("outcome_event_counts", _EVENTS_COMMITS + """,
rows_per_sha AS (SELECT sha, count(*) AS n FROM fx_commits GROUP BY sha)
SELECT e.kind, count(*) AS n_events,
  CAST(coalesce(sum(CASE WHEN e.kind = 'revert' OR (e.kind = 'pull_request' AND e.closed AND NOT e.merged) THEN r.n
                WHEN e.kind = 'ci' AND r.n IS NOT NULL THEN 1 ELSE 0 END), 0) AS BIGINT) AS commits_affected
FROM fx_outcome_events e LEFT JOIN rows_per_sha r ON r.sha = e.commit_sha
GROUP BY e.kind
""")
def outcome_event_counts(spark, sf_dir):
    """Events per kind and commit rows they affect (unknown shas and untracked kinds: 0)."""
    c = fx(spark, sf_dir, "fx_commits").groupBy("sha").agg(F.count(F.lit(1)).alias("n"))
    e = fx(spark, sf_dir, "fx_outcome_events")
    j = e.join(c, e["commit_sha"] == c["sha"], "left")
    affected = (F.when((F.col("kind") == "revert") | ((F.col("kind") == "pull_request") & S.rejected("closed", "merged")), F.col("n"))
                 .when((F.col("kind") == "ci") & F.col("n").isNotNull(), F.lit(1)).otherwise(F.lit(0)))
    return j.groupBy("kind").agg(F.count(F.lit(1)).alias("n_events"),
                                 F.coalesce(F.sum(affected), F.lit(0)).cast("bigint").alias("commits_affected"))


@query("commit_outcome", cte("fx_vectors", "fx_commits") + """,
cc AS (SELECT repo_id, sha, bool_or(revert_status) AS rs, count(bug_id) AS nb FROM fx_commits GROUP BY repo_id, sha)
SELECT v.repo_id, v.commit_sha, coalesce(cc.rs, false) AS revert_status,
  CASE WHEN coalesce(cc.rs, false) THEN 'reverted' WHEN coalesce(cc.nb, 0) > 0 THEN 'bug_linked' ELSE 'clean' END AS outcome
FROM (SELECT DISTINCT repo_id, commit_sha FROM fx_vectors) v
LEFT JOIN cc ON cc.repo_id = v.repo_id AND cc.sha = v.commit_sha
""")
def commit_outcome(spark, sf_dir):
    """Outcome of every commit referenced by a stored vector (absent = clean)."""
    v = fx(spark, sf_dir, "fx_vectors").select("repo_id", "commit_sha").distinct()
    cc = collapse_commits(_commits(spark, sf_dir))
    j = v.join(cc.select("repo_id", F.col("sha").alias("commit_sha"), "revert_status", "bug_ids"),
               ["repo_id", "commit_sha"], "left")
    return j.select("repo_id", "commit_sha", F.coalesce("revert_status", F.lit(False)).alias("revert_status"),
                    S.commit_outcome("revert_status", "bug_ids").alias("outcome"))


@query("recent_commits", cte("fx_commits") + """
SELECT repo_id, sha, seq, recency FROM (
  SELECT repo_id, sha, seq, row_number() OVER (PARTITION BY repo_id ORDER BY seq DESC) AS recency FROM fx_commits) t
WHERE recency <= 200
""")
def recent_commits(spark, sf_dir):
    """Newest 200 commits per repository (recency 1 = the commit R8 marks)."""
    return RV.recent_commits(fx(spark, sf_dir, "fx_commits"), 200).select(
        "repo_id", "sha", "seq", F.col("recency").cast("bigint").alias("recency"))


_DUP_COMMITS = """
dup AS (SELECT seq, repo_id, sha, author, message, revert_status, bug_id FROM fx_commits
        UNION ALL SELECT seq + 100000000, repo_id, sha, author, message, false, NULL FROM fx_commits)
"""


@query("commits_collapsed", cte("fx_commits") + ", " + _DUP_COMMITS + """
SELECT repo_id, sha, bool_or(revert_status) AS revert_status,
  coalesce(array_to_string(list_sort(list_distinct(list(bug_id))), ','), '') AS bug_ids,
  max_by(message, seq) AS message, count(*) AS n_rows
FROM dup GROUP BY repo_id, sha
""")
def commits_collapsed(spark, sf_dir):
    """S10 + §1.3: a re-sent commit list stores every commit twice (default flags on the
    second insert); the collapsed view keeps one row per (repo, sha)."""
    c = _commits(spark, sf_dir)
    again = c.select((F.col("seq") + 100000000).alias("seq"), "repo_id", "sha", "author", "message",
                     F.lit(False).alias("revert_status"), F.lit(None).cast("string").alias("bug_id"),
                     F.array().cast("array<string>").alias("bug_ids"))
    dup = c.unionByName(again)
    cc = collapse_commits(dup)
    return cc.select("repo_id", "sha", "revert_status", F.array_join("bug_ids", ",").alias("bug_ids"),
                     "message", "n_rows")


@query("client_revert_marks", cte("fx_commits") + """
SELECT DISTINCT repo_id, sha FROM (
  SELECT c.repo_id, c.sha FROM fx_commits r JOIN fx_commits c ON c.repo_id = r.repo_id
    AND c.sha = regexp_extract(r.message, '(?i)This reverts commit ([a-f0-9]{7,40})', 1)
  UNION ALL
  SELECT repo_id, sha FROM fx_commits
  WHERE regexp_extract(message, '(?i)This reverts commit ([a-f0-9]{7,40})', 1) = ''
    AND regexp_matches(message, '(?i)^Revert "(.+)"')) t
""")
def client_revert_marks(spark, sf_dir):
    """Commits the editor client marks as reverted (sha references exact; message
    references resolve to the newest commit containing the text, i.e. the revert itself)."""
    return RV.client_revert_marks(fx(spark, sf_dir, "fx_commits"))
