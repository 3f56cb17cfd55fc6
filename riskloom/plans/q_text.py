"""Text-embedding queries: hashed embedding, duplicate clusters and the
analyze pipeline on real function text (E1, E5, V9–V11, F8–F15, A6, A7, S11, S14, S15)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import clusters as C
from ..operators import history as H
from ..operators import risk as R
from ..operators import vectors as V
from ..session import ensure_checkpoint_dir, materialize
from ..sources import sinks as SK
from . import q_graph  # noqa: F401  (its queries are used below)
from .catalog import QUERIES, SQL, query
from .sqlgen import sql_render
from .fixtures import cte, fx

THRESHOLD = 0.80       # production search threshold (hashed text vectors are dense enough)
CLUSTER_THRESHOLD = 0.95
LIMIT = 10

# SQL twin of the hashed embedding (long form) and the dense vectors.
_EMBED_SQL = r""",
tok AS (SELECT repo_id, seq, lower(unnest(regexp_extract_all(code_body, '[\p{L}\p{N}_]+'))) AS t FROM fx_functions),
cnt AS (SELECT repo_id, seq, CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % 768 AS bucket, count(*) AS n
        FROM tok GROUP BY ALL),
wt AS (SELECT repo_id, seq, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY repo_id, seq)) AS weight FROM cnt)
"""
_DENSE_SQL = _EMBED_SQL + """,
grid AS (SELECT f.repo_id, f.seq, f.commit_sha, g.i FROM fx_functions f, range(768) g(i)),
vec AS (SELECT grid.repo_id, grid.seq, grid.commit_sha, list(coalesce(wt.weight, 0.0) ORDER BY grid.i) AS vector
        FROM grid LEFT JOIN wt ON wt.repo_id = grid.repo_id AND wt.seq = grid.seq AND wt.bucket = grid.i
        GROUP BY grid.repo_id, grid.seq, grid.commit_sha)
"""
_RANKED_SQL = cte("fx_functions", "fx_commits") + _DENSE_SQL + """,
p AS (SELECT q.repo_id, q.seq AS query_seq, q.commit_sha AS query_sha, h.seq AS match_seq, h.commit_sha,
        list_dot_product(q.vector, h.vector) AS s
      FROM vec q JOIN vec h ON q.repo_id = h.repo_id AND h.seq < q.seq),
cc AS (SELECT repo_id, sha, bool_or(coalesce(revert_status, false)) AS revert_status, count(bug_id) AS n_bugs
       FROM fx_commits GROUP BY repo_id, sha),
f AS (SELECT *, row_number() OVER (PARTITION BY query_seq ORDER BY s DESC, match_seq) AS fetch_rank FROM p WHERE s >= 0.8),
m AS (SELECT f.repo_id, f.query_seq, f.query_sha, f.match_seq, f.commit_sha, f.fetch_rank, round(f.s, 4) AS score,
        CASE WHEN coalesce(cc.revert_status, false) THEN 'reverted'
             WHEN coalesce(cc.n_bugs, 0) > 0 THEN 'bug_linked' ELSE 'clean' END AS outcome
      FROM f LEFT JOIN cc ON cc.repo_id = f.repo_id AND cc.sha = f.commit_sha
      WHERE f.fetch_rank <= 20 AND f.commit_sha <> f.query_sha),
e AS (SELECT *, CASE outcome WHEN 'reverted' THEN 1.0 WHEN 'bug_linked' THEN 0.8 WHEN 'unknown' THEN 0.3
                             WHEN 'clean' THEN 0.1 ELSE 0.3 END::DOUBLE AS weight FROM m),
d AS (SELECT *, score * weight AS risk,
        row_number() OVER (PARTITION BY query_seq, commit_sha ORDER BY fetch_rank) AS k FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY query_seq ORDER BY risk DESC, fetch_rank) AS rank FROM d WHERE k = 1),
rk AS (SELECT * FROM o WHERE rank <= 10),
hr AS (SELECT *, CASE WHEN score > 0.9 AND outcome = 'reverted' THEN 'HIGH'
                      WHEN score > 0.85 OR outcome = 'bug_linked' THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
         concat('This code is ', CAST(CAST(round_even(score * 100, 0) AS BIGINT) AS VARCHAR),
                '% semantically similar to historical code that was ', outcome,
                '. Gemini analysis was unavailable — please review manually.') AS explanation
       FROM rk WHERE outcome <> 'clean' AND score >= 0.8)
"""


def _functions(spark, sf_dir):
    return fx(spark, sf_dir, "fx_functions")


def _vectors(spark, sf_dir):
    """Sparse hashed vectors (repo_id, seq, indices, values) of every function."""
    return V.embed_hashed_sparse(_functions(spark, sf_dir), ["repo_id", "seq"], "code_body")


def _ranked(spark, sf_dir):
    f = _functions(spark, sf_dir)
    c = fx(spark, sf_dir, "fx_commits").withColumn("bug_ids", F.array_compact(F.array("bug_id")))
    return R.rank_matches(_vectors(spark, sf_dir), R.collapse_commits(c), meta=f, threshold=THRESHOLD,
                          limit=LIMIT, sparse=("indices", "values"))


def _smallest(rows, keys):
    """One row per keys, the smallest by its other columns; only rows whose keys come again are shuffled for it."""
    again = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*[F.col(c).alias(f"_again_{c}") for c in keys]))
    if again.isEmpty():
        return rows
    again = V.few(again)
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_again_{c}")) for c in keys])
    least = F.min(F.struct(*[c for c in rows.columns if c not in keys])).alias("_least")
    reduced = rows.join(again, same, "left_semi").groupBy(*keys).agg(least).select(*keys, "_least.*")
    return rows.join(again, same, "left_anti").unionByName(reduced)


@query("embed_hashed", cte("fx_functions") + _EMBED_SQL + "SELECT seq, CAST(bucket AS BIGINT) AS bucket, round(weight, 6) AS weight FROM wt")
def embed_hashed(spark, sf_dir):
    """Hashed term-count unit vectors of every function body, sparse long form."""
    long = V.embed_hashed_long(_functions(spark, sf_dir), ["repo_id", "seq"], "code_body")
    return long.select("seq", F.col("bucket").cast("bigint").alias("bucket"), F.round("weight", 6).alias("weight"))


@query("embed_dedup", cte("fx_functions") + """
SELECT repo_id, code_hash, count(*) AS n_functions FROM (
  SELECT repo_id, substr(sha256(regexp_replace(code_body, '^\\s+|\\s+$', '', 'g')), 1, 16) AS code_hash FROM fx_functions) t
GROUP BY repo_id, code_hash
""")
def embed_dedup(spark, sf_dir):
    """E5: each distinct (repository, code hash) embedded once and joined back;
    reports how many functions share each computed vector."""
    f = _functions(spark, sf_dir).withColumn("code_hash", S.code_hash("code_body"))
    e = V.embed_dedup(f, ["repo_id"], "code_hash", "code_body")
    return (e.where(F.col("indices").isNotNull()).groupBy("repo_id", "code_hash")
             .agg(F.count(F.lit(1)).alias("n_functions")))


@query("exact_duplicates", cte("fx_functions") + """
SELECT repo_id, code_hash, count(*) AS n_copies, min(seq) AS first_id FROM (
  SELECT repo_id, seq, substr(sha256(regexp_replace(code_body, '^\\s+|\\s+$', '', 'g')), 1, 16) AS code_hash FROM fx_functions) t
GROUP BY repo_id, code_hash HAVING count(*) > 1
""")
def exact_duplicates(spark, sf_dir):
    """V11 (exact): groups of identical function bodies per repository."""
    return C.exact_duplicates(_functions(spark, sf_dir))


@query("duplicate_clusters", cte("fx_functions") + _DENSE_SQL + """,
hx AS (SELECT repo_id, seq, substr(sha256(regexp_replace(code_body, '^\\s+|\\s+$', '', 'g')), 1, 16) AS h FROM fx_functions),
rep AS (SELECT repo_id, h, min(seq) AS rep FROM hx GROUP BY repo_id, h),
ed AS (SELECT a.repo_id, a.seq AS x, b.seq AS y FROM vec a JOIN vec b ON a.repo_id = b.repo_id AND a.seq <> b.seq
       WHERE a.seq IN (SELECT rep FROM rep) AND b.seq IN (SELECT rep FROM rep)
         AND list_dot_product(a.vector, b.vector) >= 0.95),
reach AS (SELECT * FROM (WITH RECURSIVE r(repo_id, x, y) AS (
            SELECT repo_id, rep, rep FROM rep
            UNION SELECT r.repo_id, r.x, ed.y FROM r JOIN ed ON ed.repo_id = r.repo_id AND ed.x = r.y)
          SELECT * FROM r) t),
comp AS (SELECT repo_id, x AS rep, min(y) AS component FROM reach GROUP BY repo_id, x),
mem AS (SELECT hx.repo_id, hx.seq, comp.component FROM hx JOIN rep ON rep.repo_id = hx.repo_id AND rep.h = hx.h
        JOIN comp ON comp.repo_id = rep.repo_id AND comp.rep = rep.rep),
sz AS (SELECT repo_id, component, count(*) AS cluster_size, min(seq) AS cluster_id FROM mem GROUP BY repo_id, component)
SELECT mem.repo_id, mem.seq, sz.cluster_id, sz.cluster_size FROM mem JOIN sz ON sz.repo_id = mem.repo_id
  AND sz.component = mem.component WHERE sz.cluster_size > 1
""")
def duplicate_clusters(spark, sf_dir):
    """Clusters of duplicated logic (exact copies + cosine >= 0.95) per repository."""
    f = _functions(spark, sf_dir)
    return C.duplicate_clusters(f, materialize(_vectors(spark, sf_dir)), threshold=CLUSTER_THRESHOLD)


@query("analyze_warnings", _RANKED_SQL + """
SELECT repo_id, query_seq, match_seq, commit_sha AS matched_commit_sha, score AS similarity_score, outcome,
       risk_level, round(risk, 6) AS risk_score, explanation FROM hr
""")
def analyze_warnings(spark, sf_dir):
    """V9 (+F10–F12): warnings for every function replayed against earlier
    history (hashed text vectors, threshold 0.80, as-of)."""
    f = _functions(spark, sf_dir)
    w = R.assemble_warnings(_ranked(spark, sf_dir), f)
    return w.select("repo_id", "query_seq", "match_seq", "matched_commit_sha", "similarity_score", "outcome",
                    "risk_level", F.round("risk_score", 6).alias("risk_score"), "explanation")


# Warnings as they are stored: lines of the function, the matched commit's author, message and date, the file's dependency risk.
_STORED_SQL = _RANKED_SQL + """,
g AS (SELECT concat('m', substr(file_path, 2), '.py') AS file_path, graph_risk_score FROM (""" + SQL["graph_risk"] + """) gr),
sw AS (SELECT sha256(concat_ws('|', hr.query_sha, fq.file_path, fq.function_name, hr.commit_sha)) AS id, hr.repo_id, fq.function_name, fq.file_path,
         fq.seq % 100 + 1 AS start_line, fq.seq % 100 + 1 + fq.seq % 17 AS end_line, hr.risk_level, hr.score AS similarity_score,
         hr.commit_sha AS matched_commit_sha, c.author AS matched_author, c.message AS matched_message,
         TIMESTAMP '2024-01-01' + to_minutes(c.seq) AS matched_date, hr.outcome, hr.explanation,
         concat('The historical code was ', hr.outcome, '.') AS historical_context,
         'Review the matched historical commit and verify your changes.' AS suggested_action, coalesce(g.graph_risk_score, 0) AS graph_risk_score
       FROM hr JOIN fx_functions fq ON fq.seq = hr.query_seq JOIN fx_commits c ON c.repo_id = hr.repo_id AND c.sha = hr.commit_sha
       LEFT JOIN g ON g.file_path = fq.file_path)
"""
_STORED = ["id", "repo_id", "function_name", "file_path", "start_line", "end_line", "risk_level", "similarity_score", "matched_commit_sha", "matched_author",
           "matched_message", "matched_date", "outcome", "explanation", "historical_context", "suggested_action", "graph_risk_score"]


def _stored(spark, sf_dir):
    """The warnings of the replay, written twice (a job that is run again) and read back by id."""
    f = _functions(spark, sf_dir).withColumn("start_line", F.col("seq") % 100 + 1).withColumn("end_line", F.col("seq") % 100 + 1 + F.col("seq") % 17)
    c = (fx(spark, sf_dir, "fx_commits").withColumn("bug_ids", F.array_compact(F.array("bug_id")))
         .withColumn("date", F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("seq"))))
    ranked = R.rank_matches(_vectors(spark, sf_dir), R.collapse_commits(c), meta=f, threshold=THRESHOLD, limit=LIMIT, sparse=("indices", "values"))
    graph = QUERIES["graph_risk"](spark, sf_dir).withColumn("file_path", F.concat(F.lit("m"), F.substr("file_path", F.lit(2)), F.lit(".py")))
    w = materialize(R.assemble_warnings(ranked, f, graph_risk=graph))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warnings-{uuid.uuid4().hex}"
    for _ in range(2):
        SK.write_table(w, path)
    return spark.read.parquet(path).dropDuplicates(["id"])


@query("stored_warnings", _STORED_SQL + "SELECT " + ", ".join(_STORED) + " FROM sw")
def stored_warnings(spark, sf_dir):
    """Whole warnings through the sink and back."""
    return _stored(spark, sf_dir).select(*_STORED)


@query("warning_hover", _STORED_SQL + """
SELECT id, md5(concat('### Risk: ', risk_level, chr(10), chr(10), CAST(floor(similarity_score * 100 + 0.5) AS BIGINT), '% similar to commit `', substr(matched_commit_sha, 1, 7), '` (',
  strftime(matched_date, '%Y-%m-%d'), ')', chr(10), chr(10), '**Outcome:** ', upper(outcome), chr(10), chr(10), '**Explanation:** ', explanation,
  chr(10), chr(10), '**History:** ', historical_context, chr(10), chr(10), '**Advice:** ', suggested_action)) AS hover_md5 FROM sw
""")
def warning_hover(spark, sf_dir):
    """the hover text of every stored warning."""
    return H.hover_report(_stored(spark, sf_dir)).select("id", F.md5("hover").alias("hover_md5"))


@query("warnings_in_files", _STORED_SQL + """
SELECT id, repo_id, file_path, row_number() OVER (PARTITION BY repo_id, file_path ORDER BY start_line, end_line, id) AS position,
  count(*) OVER (PARTITION BY repo_id, file_path) AS n_in_file FROM sw
""")
def warnings_in_files(spark, sf_dir):
    """The stored warnings, file by file."""
    return H.warnings_in_files(_stored(spark, sf_dir)).select("id", "repo_id", "file_path", "position", "n_in_file")


@query("risk_score", _RANKED_SQL + """
SELECT query_seq, match_seq, score, outcome, weight, round(risk, 6) AS risk_score, rank FROM rk
""")
def risk_score(spark, sf_dir):
    """Outcome weight and risk = round(score, 4) x weight for the top-10 matches."""
    r = _ranked(spark, sf_dir)
    return r.select("query_seq", "match_seq", "score", "outcome", S.outcome_weight("outcome").alias("weight"),
                    F.round("risk_score", 6).alias("risk_score"), F.col("rank").cast("bigint").alias("rank"))


@query("high_risk_filter", _RANKED_SQL + "SELECT query_seq, match_seq, score, outcome FROM hr")
def high_risk_filter(spark, sf_dir):
    """matches with a bad outcome and score >= 0.80."""
    r = R.high_risk(_ranked(spark, sf_dir))
    return r.select("query_seq", "match_seq", "score", "outcome")


@query("risk_level", _RANKED_SQL + """
SELECT query_seq, match_seq, CASE WHEN score > 0.9 AND outcome = 'reverted' THEN 'HIGH'
  WHEN score > 0.85 OR outcome = 'bug_linked' THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM rk
""")
def risk_level(spark, sf_dir):
    """deterministic level rule for every ranked match."""
    r = _ranked(spark, sf_dir)
    return r.select("query_seq", "match_seq", S.risk_level("score", "outcome").alias("risk_level"))


@query("fallback_explanation", _RANKED_SQL + """
SELECT query_seq, match_seq, CASE WHEN score > 0.9 THEN 'HIGH' ELSE 'MEDIUM' END AS risk_level, explanation,
  concat('The historical code was ', outcome, '.') AS historical_context,
  'Review the matched historical commit and verify your changes.' AS suggested_action FROM hr
""")
def fallback_explanation(spark, sf_dir):
    """fallback level and texts for every high-risk match."""
    r = R.high_risk(_ranked(spark, sf_dir))
    fb = S.fallback_explanation("score", "outcome")
    return r.select("query_seq", "match_seq", fb["risk_level"].alias("risk_level"),
                    fb["explanation"].alias("explanation"), fb["historical_context"].alias("historical_context"),
                    fb["suggested_action"].alias("suggested_action"))


_PCT_SQL = "concat(CAST(CAST(round_even(score * 100, 0) AS BIGINT) AS VARCHAR), '%')"


@query("explain_requests", _RANKED_SQL + """,
q AS (SELECT hr.*, substr(sha256(regexp_replace(fq.code_body, '^\\s+|\\s+$', '', 'g')), 1, 16) AS code_hash,
        fq.function_name, fq.file_path, fq.code_body AS cur, fh.code_body AS hist
      FROM hr JOIN fx_functions fq ON fq.seq = hr.query_seq JOIN fx_functions fh ON fh.seq = hr.match_seq),
k AS (SELECT *, row_number() OVER (PARTITION BY code_hash, commit_sha ORDER BY query_seq, rank) AS kk,
        count(*) OVER (PARTITION BY code_hash, commit_sha) AS n_warnings FROM q)
SELECT code_hash, commit_sha AS matched_commit_sha, n_warnings,
  md5(""" + sql_render(S.EXPLAIN_TEMPLATE, pct=_PCT_SQL, function_name="function_name", file_path="file_path",
                       current_code="cur", historical_code="hist",
                       outcome="outcome") + """) AS prompt_md5
FROM k WHERE kk = 1
""")
def explain_requests(spark, sf_dir):
    """One explanation request per (code hash, matched commit), with whole bodies.

    The first warning of each is chosen before a body is joined; then a request takes its two bodies by id."""
    f = _functions(spark, sf_dir)
    hr = R.high_risk(_ranked(spark, sf_dir)).select("query_seq", "match_seq", "commit_sha", "rank", "score", "outcome")
    theirs = f.groupBy(F.col("seq").alias("match_seq")).agg(F.count(F.lit(1)).alias("_n"))     # an id may come in several rows
    q = (hr.join(f.select(F.col("seq").alias("query_seq"), S.code_hash("code_body").alias("code_hash")), "query_seq")
           .join(theirs, "match_seq"))
    # one request per (code hash, matched commit): the first by (query, rank); partial aggregates only
    first = F.min(F.struct("query_seq", "rank", "score", "outcome", "match_seq")).alias("_f")
    k = q.groupBy("code_hash", "commit_sha").agg(first, F.sum("_n").alias("n_warnings")).select("code_hash", "commit_sha", "n_warnings", "_f.*")
    cur = _smallest(f.select(F.col("seq").alias("_seq"), S.code_hash("code_body").alias("_hash"), F.col("function_name").alias("qfn"),
                             F.col("file_path").alias("qpath"), F.col("code_body").alias("cur")), ["_seq", "_hash"])
    hist = _smallest(f.select(F.col("seq").alias("match_seq"), F.col("code_body").alias("hist")), ["match_seq"])
    k = k.join(cur, (F.col("query_seq") == F.col("_seq")) & F.col("code_hash").eqNullSafe(F.col("_hash"))).join(hist, "match_seq")
    prompt = S.explain_prompt("score", "qfn", "qpath", "cur", "hist", "outcome")
    return k.select("code_hash", F.col("commit_sha").alias("matched_commit_sha"), "n_warnings", F.md5(prompt).alias("prompt_md5"))


@query("analyze_summary", _RANKED_SQL + """,
per AS (SELECT query_sha AS sha, count(*) AS n_warnings FROM hr GROUP BY query_sha)
SELECT c.sha, c.n_functions, coalesce(per.n_warnings, 0) AS n_warnings
FROM (SELECT commit_sha AS sha, count(*) AS n_functions FROM fx_functions GROUP BY commit_sha) c
LEFT JOIN per ON per.sha = c.sha
""")
def analyze_summary(spark, sf_dir):
    """Per analysed commit, functions analysed and warnings raised."""
    f = _functions(spark, sf_dir)
    hr = R.high_risk(_ranked(spark, sf_dir)).join(
        f.select(F.col("seq").alias("query_seq"), F.col("commit_sha").alias("sha")), "query_seq")
    per = hr.groupBy("sha").agg(F.count(F.lit(1)).alias("n_warnings"))
    c = f.groupBy(F.col("commit_sha").alias("sha")).agg(F.count(F.lit(1)).alias("n_functions"))
    return c.join(per, "sha", "left").select("sha", "n_functions", F.coalesce("n_warnings", F.lit(0)).alias("n_warnings"))


_REPLIES = """
rp AS (SELECT conv_id, turn, role, text,
  CASE WHEN turn % 3 = 0 THEN concat('```json', chr(10), json_object('risk_level', CASE conv_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'MEDIUM' ELSE 'unsure' END,
                                                                      'explanation', text, 'historical_context', role, 'changes_made', json_array(role, 'turn'))::VARCHAR, chr(10), '```')
       WHEN turn % 3 = 1 THEN json_object('risk_level', CASE conv_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'MEDIUM' ELSE 'unsure' END,
                                          'explanation', text, 'historical_context', role, 'changes_made', json_array(role, 'turn'))::VARCHAR
       ELSE text END AS reply
  FROM conversations)
"""


def _replies(spark, sf_dir):
    from .fixtures import table
    c = table(spark, sf_dir, "conversations")
    lvl = F.when(F.col("conv_id") % 3 == 0, "high").when(F.col("conv_id") % 3 == 1, "MEDIUM").otherwise("unsure")
    js = F.to_json(F.struct(lvl.alias("risk_level"), F.col("text").alias("explanation"),
                            F.col("role").alias("historical_context"), F.array("role", F.lit("turn")).alias("changes_made")))
    reply = (F.when(F.col("turn") % 3 == 0, F.concat(F.lit("```json\n"), js, F.lit("\n```")))
              .when(F.col("turn") % 3 == 1, js).otherwise(F.col("text")))
    return c.select("conv_id", "turn", "role", "text", reply.alias("reply"))


_PARSE_BODY = """
b0 AS (SELECT *, regexp_replace(reply, '^\\s+|\\s+$', '', 'g') AS t FROM rp),
b1 AS (SELECT *, CASE WHEN starts_with(t, '```') AND strpos(t, chr(10)) > 0 THEN regexp_replace(t, '^[^\\n]*\\n', '')
                      WHEN starts_with(t, '```') THEN NULL ELSE t END AS u FROM b0),
b2 AS (SELECT *, regexp_replace(CASE WHEN ends_with(u, '```') THEN substr(u, 1, length(u) - 3) ELSE u END,
                                '^\\s+|\\s+$', '', 'g') AS body FROM b1)
"""


@query("explain_parse", "WITH " + _REPLIES + "," + _PARSE_BODY + """
SELECT conv_id, turn,
  CASE WHEN starts_with(body, '{') AND json_valid(body) THEN
         CASE upper(coalesce(json_extract_string(body, '$.risk_level'), 'LOW')) WHEN 'HIGH' THEN 'HIGH' WHEN 'MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END
       ELSE 'MEDIUM' END AS risk_level,
  md5(CASE WHEN starts_with(body, '{') AND json_valid(body) THEN coalesce(json_extract_string(body, '$.explanation'), '')
           WHEN coalesce(length(reply), 0) > 0 THEN substr(reply, 1, 500) ELSE 'Analysis unavailable' END) AS explanation_md5,
  CASE WHEN starts_with(body, '{') AND json_valid(body) THEN coalesce(json_extract_string(body, '$.historical_context'), '')
       ELSE 'Could not parse structured explanation' END AS historical_context,
  CASE WHEN starts_with(body, '{') AND json_valid(body) THEN coalesce(json_extract_string(body, '$.suggested_action'), '')
       ELSE 'Review the matched historical commit manually' END AS suggested_action
FROM b2
""")
def explain_parse(spark, sf_dir):
    """structured explanation replies parsed (fenced JSON, bare JSON, free text)."""
    r = _replies(spark, sf_dir)
    p = S.explain_parse("reply", F.lit(0.85), F.lit("reverted"))
    return r.select("conv_id", "turn", p["risk_level"].alias("risk_level"), F.md5(p["explanation"]).alias("explanation_md5"),
                    p["historical_context"].alias("historical_context"), p["suggested_action"].alias("suggested_action"))


@query("fix_parse", "WITH " + _REPLIES + "," + _PARSE_BODY + """
SELECT conv_id, turn, starts_with(body, '{') AND json_valid(body) AS success,
  md5(CASE WHEN starts_with(body, '{') AND json_valid(body) THEN coalesce(json_extract_string(body, '$.fixed_code'), '')
           ELSE role END) AS fixed_code_md5,
  CASE WHEN starts_with(body, '{') AND json_valid(body) THEN concat(json_extract_string(body, '$.changes_made[0]'), ',', json_extract_string(body, '$.changes_made[1]')) ELSE '' END AS changes_made
FROM b2
""")
def fix_parse(spark, sf_dir):
    """fix replies parsed; on failure the safe version (here: the role text) is returned."""
    r = _replies(spark, sf_dir)
    p = S.fix_parse("reply", "role")
    return r.select("conv_id", "turn", p["success"].alias("success"), F.md5(p["fixed_code"]).alias("fixed_code_md5"),
                    F.array_join(p["changes_made"], ",").alias("changes_made"))


@query("fix_requests", _RANKED_SQL + """,
q AS (SELECT hr.query_seq, hr.match_seq, hr.explanation, fq.function_name, fq.file_path,
        fq.code_body AS bad, fh.code_body AS safe
      FROM hr JOIN fx_functions fq ON fq.seq = hr.query_seq JOIN fx_functions fh ON fh.seq = hr.match_seq)
SELECT query_seq, match_seq,
  md5(""" + sql_render(S.FIX_TEMPLATE, function_name="function_name", file_path="file_path", language="'python'",
                       bad_code="bad", explanation="explanation",
                       safe_code="safe") + """) AS prompt_md5
FROM q
""")
def fix_requests(spark, sf_dir):
    """One fix request per high-risk warning (risky body, matched body
    as the safe version, the warning's explanation), with whole bodies."""
    f = _functions(spark, sf_dir)
    hr = R.high_risk(_ranked(spark, sf_dir))
    fb = S.fallback_explanation("score", "outcome")
    q = (hr.select("query_seq", "match_seq", fb["explanation"].alias("why"))
           .join(f.select(F.col("seq").alias("query_seq"), F.col("function_name").alias("qfn"),
                          F.col("file_path").alias("qpath"), F.col("code_body").alias("bad")), "query_seq")
           .join(f.select(F.col("seq").alias("match_seq"), F.col("code_body").alias("safe")), "match_seq"))
    prompt = S.fix_prompt("bad", "safe", "why", "qfn", "qpath", S.detect_language("qpath"))
    return q.select("query_seq", "match_seq", F.md5(prompt).alias("prompt_md5"))
