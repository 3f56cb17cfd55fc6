"""Source/sink queries: repository dimension, backfill, vector table scans."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import diffs as D
from ..operators import reverts as RV
from ..operators import vectors as V
from ..session import ensure_checkpoint_dir
from ..sources import commits as SC
from ..sources import keyed as KS
from ..sources import sinks as SK
from .catalog import query
from .fixtures import cte, fx, table
from .q_diffs import _BLOCKS_SQL, _RANGES_SQL
from .q_reverts import _REFS_SQL

_NORM = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^git@', ''), '^https?://', ''), '^([^:]*):', '\\1/'), '\\.git$', '')"


@query("repo_dimension", cte("fx_commits") + f""",
ex AS (SELECT DISTINCT repo_id FROM fx_commits),
inc AS (SELECT DISTINCT {_NORM} AS repo_id FROM pages UNION SELECT repo_id FROM fx_commits),
nw AS (SELECT repo_id FROM inc EXCEPT SELECT repo_id FROM ex)
SELECT sha256(repo_id) AS id, repo_id, regexp_extract(repo_id, '([^/]*)$', 1) AS name FROM ex
UNION ALL SELECT sha256(repo_id), repo_id, regexp_extract(repo_id, '([^/]*)$', 1) FROM nw
""")
def repo_dimension(spark, sf_dir):
    """Get-or-create repositories (existing from the commits, incoming from page URLs as remotes)."""
    c = fx(spark, sf_dir, "fx_commits")
    existing = c.select("repo_id").distinct().select(F.sha2("repo_id", 256).alias("id"), "repo_id",
                                                     S.repo_name_from_id("repo_id").alias("name"))
    incoming = (table(spark, sf_dir, "pages").select(S.normalize_repo_id("url").alias("repo_id"))
                .unionByName(c.select("repo_id")))
    return SC.upsert_repositories(existing, incoming)


def _backfill_functions(spark, sf_dir):
    files = SC.cap_files_per_commit(fx(spark, sf_dir, "fx_file_diffs"), n=None)
    files = D.by_file(files, ["file_id"])
    ch = D.changed_functions(files, ["file_id"])
    meta = files.select("file_id", "repo_id", "sha")
    return ch.join(meta, "file_id")


_CAPPED = """
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, sha ORDER BY file_idx) AS kr
                          FROM fx_file_diffs WHERE file_path LIKE '%.py') t),"""
_BACKFILL_SQL = (cte("fx_file_diffs", "fx_commits") + "," + _CAPPED
                 + _RANGES_SQL.split(cte("fx_file_diffs") + ",", 1)[1].replace(
                     "FROM fx_file_diffs\n       WHERE file_path LIKE '%.py'", "FROM capped")
                 + ", " + _BLOCKS_SQL.replace("FROM fx_file_diffs WHERE file_path LIKE '%.py'", "FROM capped"))


_BACKFILL_VECTORS_SQL = _BACKFILL_SQL + r""",
hit AS (SELECT blk.*, row_number() OVER (PARTITION BY blk.file_id, blk.name ORDER BY rg.range_idx, blk.func_idx) AS k
        FROM rg JOIN blk ON blk.file_id = rg.file_id AND rg.start_line <= blk.end_line AND rg.end_line >= blk.start_line),
cf AS (SELECT c.repo_id, c.sha, c.file_path, hit.name AS function_name, hit.body FROM hit JOIN capped c ON c.file_id = hit.file_id
       WHERE k = 1),
tk AS (SELECT repo_id, sha, file_path, function_name,
         CAST(('0x' || substr(md5(lower(t)), 1, 8)) AS BIGINT) % 768 AS bucket
       FROM (SELECT *, unnest(regexp_extract_all(body, '[\p{L}\p{N}_]+')) AS t FROM cf) x),
bc AS (SELECT repo_id, sha, file_path, function_name, bucket, count(*) AS n FROM tk GROUP BY ALL),
nb AS (SELECT repo_id, sha, file_path, function_name, count(*) AS n_buckets, sum(n * n) AS s2 FROM bc GROUP BY ALL),
nm AS (SELECT bc.repo_id, bc.sha, bc.file_path, bc.function_name,
         round(sqrt(sum((bc.n / sqrt(nb.s2)) * (bc.n / sqrt(nb.s2)))), 6) AS norm
       FROM bc JOIN nb USING (repo_id, sha, file_path, function_name) GROUP BY ALL)
SELECT sha256(concat_ws('|', cf.repo_id, cf.sha, cf.file_path, cf.function_name)) AS id, cf.repo_id,
  cf.sha AS commit_sha, cf.function_name, cf.file_path,
  substr(sha256(regexp_replace(cf.body, '^\s+|\s+$', '', 'g')), 1, 16) AS code_hash,
  CAST(nb.n_buckets AS INTEGER) AS n_buckets, nm.norm
FROM cf JOIN nb USING (repo_id, sha, file_path, function_name) JOIN nm USING (repo_id, sha, file_path, function_name)
"""


@query("backfill_vectors", _BACKFILL_VECTORS_SQL)
def backfill_vectors(spark, sf_dir):
    """Backfill job — files -> changed functions -> embed once per
    code hash -> vector rows with deterministic ids ."""
    fns = _backfill_functions(spark, sf_dir).withColumn("code_hash", S.code_hash("new_body"))
    vec = V.embed_dedup(fns, ["repo_id"], "code_hash", "new_body")
    vec = SK.with_id(vec, "repo_id", "sha", "file_path", "function_name")
    return vec.select("id", "repo_id", F.col("sha").alias("commit_sha"), "function_name", "file_path", "code_hash",
                      F.size("indices").alias("n_buckets"),
                      F.round(F.sqrt(F.aggregate("values", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"))


@query("backfill_summary", _BACKFILL_SQL + """,
hit AS (SELECT blk.file_id, blk.name, row_number() OVER (PARTITION BY blk.file_id, blk.name ORDER BY rg.range_idx, blk.func_idx) AS k
        FROM rg JOIN blk ON blk.file_id = rg.file_id AND rg.start_line <= blk.end_line AND rg.end_line >= blk.start_line),
fnc AS (SELECT c.repo_id, count(*) AS n FROM hit JOIN capped c ON c.file_id = hit.file_id WHERE k = 1 GROUP BY c.repo_id),
cm AS (SELECT repo_id, sha FROM fx_commits UNION SELECT repo_id, sha FROM fx_file_diffs),
wd AS (SELECT DISTINCT repo_id, sha FROM capped),
""" + _REFS_SQL + """,
r AS (SELECT * FROM refs WHERE pattern IS NOT NULL),
by_sha AS (SELECT r.repo_id, o.sha, row_number() OVER (PARTITION BY r.repo_id, r.seq ORDER BY o.seq, o.sha) AS k
           FROM r JOIN fx_commits o ON o.repo_id = r.repo_id AND starts_with(o.sha, r.ref) AND o.sha <> r.sha),
msgs AS (SELECT repo_id, m, max_by(sha, seq) AS sha FROM m0 WHERE m <> '' GROUP BY repo_id, m),
by_msg AS (SELECT r.repo_id, msgs.sha FROM r JOIN msgs ON msgs.repo_id = r.repo_id AND msgs.m = r.ref
           WHERE msgs.sha <> r.sha),
detected AS (SELECT repo_id, sha FROM by_sha WHERE k = 1 UNION SELECT repo_id, sha FROM by_msg),
rv AS (SELECT repo_id, count(*) AS n FROM detected GROUP BY repo_id)
SELECT cm.repo_id, count(*) AS n_commits, count(wd.sha) AS commits_with_diffs, count(*) - count(wd.sha) AS commits_skipped,
  coalesce(any_value(fnc.n), 0) AS functions_embedded, coalesce(any_value(rv.n), 0) AS reverts_detected
FROM cm LEFT JOIN wd ON wd.repo_id = cm.repo_id AND wd.sha = cm.sha LEFT JOIN fnc ON fnc.repo_id = cm.repo_id
LEFT JOIN rv ON rv.repo_id = cm.repo_id
GROUP BY cm.repo_id
""")
def backfill_summary(spark, sf_dir):
    """Backfill counters per repository — commits, commits with (all their
    supported) diffs, skipped commits, functions embedded, reverts detected."""
    c = fx(spark, sf_dir, "fx_commits").select("repo_id", "sha")
    f = fx(spark, sf_dir, "fx_file_diffs")
    commits = c.unionByName(f.select("repo_id", "sha")).distinct()
    capped = SC.cap_files_per_commit(f, n=None)
    wd = capped.select("repo_id", "sha").distinct().withColumn("_has", F.lit(1))
    fns = _backfill_functions(spark, sf_dir).groupBy("repo_id").agg(F.count(F.lit(1)).alias("functions_embedded"))
    j = commits.join(wd, ["repo_id", "sha"], "left")
    agg = j.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_commits"),
                                   F.count("_has").alias("commits_with_diffs"))
    rv = RV.detect_reverts(fx(spark, sf_dir, "fx_commits")).groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("reverts_detected"))
    return (agg.join(fns, "repo_id", "left").join(rv, "repo_id", "left")
               .select("repo_id", "n_commits", "commits_with_diffs",
                       (F.col("n_commits") - F.col("commits_with_diffs")).alias("commits_skipped"),
                       F.coalesce("functions_embedded", F.lit(0)).alias("functions_embedded"),
                       F.coalesce("reverts_detected", F.lit(0)).alias("reverts_detected")))


@query("delete_repo", cte("fx_vectors") + """
SELECT repo_id, count(*) AS n_vectors FROM fx_vectors WHERE repo_id <> 'repo1' GROUP BY repo_id
""")
def delete_repo(spark, sf_dir):
    """The vector table after deleting one repository (repo1)."""
    v = SK.without_repo(fx(spark, sf_dir, "fx_vectors"), "repo1")
    return v.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_vectors"))


@query("vector_scan_preview", cte("fx_functions") + """
SELECT seq, substr(commit_sha, 1, 12) AS sha12, function_name, file_path, substr(code_body, 1, 80) AS body80
FROM fx_functions ORDER BY seq LIMIT 20
""")
def vector_scan_preview(spark, sf_dir):
    """Scroll preview — first 20 points, short sha, body prefix, no vectors (the limit is the feature)."""
    f = fx(spark, sf_dir, "fx_functions")
    return (f.select("seq", F.substring("commit_sha", 1, 12).alias("sha12"), "function_name", "file_path",
                     F.substring("code_body", 1, 80).alias("body80"))
             .orderBy("seq").limit(20))


@query("keyed_commits", cte("fx_commits") + """,
w AS (SELECT repo_id, sha, author, revert_status, seq FROM fx_commits WHERE seq % 3 <> 0
      UNION ALL SELECT repo_id, sha, author, NOT revert_status, seq + 100000 FROM fx_commits WHERE seq % 3 = 1
      UNION ALL SELECT repo_id, sha, author, revert_status, seq + 300000 FROM fx_commits WHERE seq % 4 = 0),
l AS (SELECT repo_id, sha, arg_max(author, seq) AS author, arg_max(revert_status, seq) AS revert_status, max(seq) AS seq FROM w GROUP BY repo_id, sha)
SELECT * FROM l WHERE repo_id <> 'repo2' OR seq > 200000
""")
def keyed_commits(spark, sf_dir):
    """Commits through the keyed sink: stored, a flag turned by a later write, a repository deleted, some sent again, then compacted."""
    c = fx(spark, sf_dir, "fx_commits").select("repo_id", "sha", "author", "revert_status", F.col("seq").cast("long").alias("seq"))
    path, keys, scope = f"{ensure_checkpoint_dir(spark).rstrip('/')}/commits-{uuid.uuid4().hex}", ["repo_id", "sha"], ["repo_id"]
    turned = c.where("seq % 3 = 1").withColumn("revert_status", ~F.col("revert_status")).withColumn("seq", F.col("seq") + 100000)
    for name, rows in (("first", c.where("seq % 3 <> 0")), ("turned", turned), ("turned", turned)):
        KS.upsert(rows, path, keys, name, buckets=8)
    KS.delete(c.where("repo_id = 'repo2'").select("repo_id").distinct().withColumn("seq", F.lit(200000).cast("long")), path, "repo2")
    KS.upsert(c.where("seq % 4 = 0").withColumn("seq", F.col("seq") + 300000), path, keys, "again", buckets=8)
    KS.compact(spark, path, keys, "seq", scope, buckets=8)
    return KS.read(spark, path, keys, "seq", scope).select("repo_id", "sha", "author", "revert_status", "seq")
