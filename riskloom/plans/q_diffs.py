"""Diff, function and source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import blocks as B
from ..operators import diffs as D
from ..sources import commits as SC
from .catalog import query
from .fixtures import cte, fx, table

IDS = ["file_id"]

# DuckDB twin of D1: explode, classify, segment, count.
_LINES_SQL = cte("fx_file_diffs") + """,
x0 AS (SELECT file_id, file_path, CAST(generate_subscripts(string_split(diff, chr(10)), 1) - 1 AS BIGINT) AS idx,
              unnest(string_split(diff, chr(10))) AS line FROM fx_file_diffs
       WHERE file_path LIKE '%.py'),
x1 AS (SELECT file_id, idx, line,
         CASE WHEN regexp_matches(line, '^@@ -\\d+(?:,\\d+)? \\+(\\d+)(?:,(\\d+))? @@')
              THEN CAST(regexp_extract(line, '^@@ -\\d+(?:,\\d+)? \\+(\\d+)(?:,(\\d+))? @@', 1) AS BIGINT) END AS hstart,
         starts_with(line, '+') AND NOT starts_with(line, '+++') AS is_add,
         starts_with(line, '-') AND NOT starts_with(line, '---') AS is_del FROM x0),
x2 AS (SELECT *, sum(CASE WHEN hstart IS NOT NULL THEN 1 ELSE 0 END)
                   OVER (PARTITION BY file_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS seg FROM x1),
x3 AS (SELECT *, coalesce(first_value(hstart) OVER (PARTITION BY file_id, seg ORDER BY idx ROWS UNBOUNDED PRECEDING), 0) AS st,
         coalesce(max(CASE WHEN is_add THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, seg ORDER BY idx
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS add_before FROM x2),
x4 AS (SELECT *, CASE WHEN is_add OR (hstart IS NULL AND NOT is_add AND NOT is_del AND (st > 0 OR add_before))
                      THEN 1 ELSE 0 END AS adv FROM x3),
x5 AS (SELECT *, st + coalesce(sum(adv) OVER (PARTITION BY file_id, seg ORDER BY idx
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_no FROM x4),
ch AS (SELECT file_id, idx, CAST(line_no AS BIGINT) AS line_no FROM x5 WHERE is_add OR is_del)
"""

_RANGES_SQL = _LINES_SQL + """,
r1 AS (SELECT *, lag(line_no) OVER (PARTITION BY file_id ORDER BY idx) AS prev FROM ch),
r2 AS (SELECT *, sum(CASE WHEN prev IS NULL OR line_no > prev + 2 THEN 1 ELSE 0 END)
                   OVER (PARTITION BY file_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS range_idx FROM r1),
rg AS (SELECT file_id, CAST(range_idx AS BIGINT) AS range_idx, arg_min(line_no, idx) AS start_line,
              arg_max(line_no, idx) AS end_line FROM r2 GROUP BY file_id, range_idx)
"""

# DuckDB twin of D3 for Python files: indentation scan (def .. last line
# before the next line indented no deeper).
_BLOCKS_SQL = """
l0 AS (SELECT file_id, CAST(generate_subscripts(string_split(file_content, chr(10)), 1) AS BIGINT) AS ln,
              unnest(string_split(file_content, chr(10))) AS line FROM fx_file_diffs WHERE file_path LIKE '%.py'),
l AS (SELECT *, length(line) - length(ltrim(line)) AS ind, trim(line) <> '' AS nb FROM l0),
d AS (SELECT file_id, ln, ind, regexp_extract(line, '^\\s*(?:async\\s+)?def\\s+(\\w+)', 1) AS name
      FROM l WHERE regexp_matches(line, '^\\s*(?:async\\s+)?def\\s+\\w+')),
stp AS (SELECT d.file_id, d.ln, min(l.ln) AS stop FROM d JOIN l ON l.file_id = d.file_id AND l.ln > d.ln
        AND l.nb AND l.ind <= d.ind GROUP BY d.file_id, d.ln),
en AS (SELECT d.file_id, d.ln, max(l.ln) AS end_ln FROM d LEFT JOIN stp ON stp.file_id = d.file_id AND stp.ln = d.ln
       JOIN l ON l.file_id = d.file_id AND l.ln >= d.ln AND l.nb AND l.ln < coalesce(stp.stop, 1000000000)
       GROUP BY d.file_id, d.ln),
blk AS (SELECT d.file_id, CAST(row_number() OVER (PARTITION BY d.file_id ORDER BY d.ln) - 1 AS INTEGER) AS func_idx,
          d.name, CAST(d.ln AS INTEGER) AS start_line, CAST(en.end_ln AS INTEGER) AS end_line,
          (SELECT string_agg(CASE WHEN l.ln = d.ln THEN substr(l.line, d.ind + 1) ELSE l.line END, chr(10) ORDER BY l.ln)
             FROM l WHERE l.file_id = d.file_id AND l.ln BETWEEN d.ln AND en.end_ln) AS body
        FROM d JOIN en ON en.file_id = d.file_id AND en.ln = d.ln)
"""


def _files(spark, sf_dir):
    return D.by_file(fx(spark, sf_dir, "fx_file_diffs"), IDS)


def _py(files):
    return files.where(S.detect_language("file_path").isNotNull())


@query("diff_changed_lines", _LINES_SQL + "SELECT file_id, idx, line_no FROM ch")
def diff_changed_lines(spark, sf_dir):
    """Line numbers of added/deleted lines of every supported file diff."""
    c = D.changed_lines(_py(_files(spark, sf_dir)), IDS)
    return c.select("file_id", F.col("idx").cast("bigint").alias("idx"), F.col("line_no").cast("bigint").alias("line_no"))


@query("diff_ranges", _RANGES_SQL + "SELECT file_id, range_idx, start_line, end_line FROM rg")
def diff_ranges(spark, sf_dir):
    """Changed lines merged into ranges (gap <= 2, encounter order)."""
    c = D.changed_lines(_py(_files(spark, sf_dir)), IDS)
    r = D.changed_ranges(c, IDS)
    return r.select("file_id", F.col("range_idx").cast("bigint").alias("range_idx"),
                    F.col("start_line").cast("bigint").alias("start_line"),
                    F.col("end_line").cast("bigint").alias("end_line"))


@query("function_blocks", cte("fx_file_diffs") + ", " + _BLOCKS_SQL + """
SELECT file_id, func_idx, name, start_line, end_line, trim(split_part(body, chr(10), 1)) AS signature, body FROM blk
""")
def function_blocks(spark, sf_dir):
    """Every function of every supported file (pre-order, 1-based lines)."""
    b = B.function_blocks(_files(spark, sf_dir), IDS)
    return b.select("file_id", "func_idx", "name", "start_line", "end_line", "signature", "body")


@query("changed_functions", _RANGES_SQL + ", " + _BLOCKS_SQL + """,
hit AS (SELECT blk.*, rg.range_idx,
          row_number() OVER (PARTITION BY blk.file_id, blk.name ORDER BY rg.range_idx, blk.func_idx) AS k
        FROM rg JOIN blk ON blk.file_id = rg.file_id AND rg.start_line <= blk.end_line AND rg.end_line >= blk.start_line)
SELECT hit.file_id, f.file_path, hit.name AS function_name, hit.start_line, hit.end_line, hit.body AS new_body,
       'python' AS language
FROM hit JOIN fx_file_diffs f ON f.file_id = hit.file_id WHERE k = 1
""")
def changed_functions(spark, sf_dir):
    """Functions overlapped by a changed range, one per name per file."""
    c = D.changed_functions(_files(spark, sf_dir), IDS)
    return c.select("file_id", "file_path", "function_name", "start_line", "end_line", "new_body", "language")


@query("commit_log_parse", cte("fx_commits") + """
SELECT trim(split_part(line, '|||', 1)) AS sha, trim(split_part(line, '|||', 2)) AS message,
       trim(split_part(line, '|||', 3)) AS author
FROM (SELECT concat(sha, '|||', message, '|||', author) AS line FROM fx_commits) t
WHERE trim(line) <> '' AND trim(split_part(line, '|||', 1)) <> ''
""")
def commit_log_parse(spark, sf_dir):
    """``sha|||subject|||author`` log lines (rendered from the commits) parsed back."""
    c = fx(spark, sf_dir, "fx_commits")
    lines = c.select(F.concat_ws("|||", "sha", "message", "author").alias("value"))
    return SC.parse_commit_log(lines)


@query("explode_diffs", cte("fx_file_diffs") + """
SELECT repo_id, sha, CAST(row_number() OVER (PARTITION BY repo_id, sha ORDER BY file_idx) - 1 AS INTEGER) AS file_pos,
       file_path, md5(diff) AS diff_md5
FROM fx_file_diffs
""")
def explode_diffs(spark, sf_dir):
    """S3: nested commit batches (commit -> array of file diffs) exploded in list order."""
    f = fx(spark, sf_dir, "fx_file_diffs")
    # Build the request bodies the reader receives (files nested per commit;
    # the view has eight files per commit by construction), then explode them.
    nested = (f.groupBy("repo_id", "sha")
               .agg(F.sort_array(F.collect_list(F.struct("file_idx", "file_path", F.lit(None).cast("string").alias("language"), "diff", "file_content"))).alias("d"))
               .select("repo_id", "sha", F.transform("d", lambda s: s.dropFields("file_idx")).alias("diffs")))
    e = SC.explode_diffs(nested)
    return e.select("repo_id", "sha", "file_pos", "file_path", F.md5("diff").alias("diff_md5"))


@query("patch_split", cte("fx_patches") + """,
c AS (SELECT seq, sha, CAST(generate_subscripts(string_split_regex(patch, '(?m)^diff --git '), 1) - 1 AS INTEGER) AS chunk_pos,
             unnest(string_split_regex(patch, '(?m)^diff --git ')) AS chunk FROM fx_patches)
SELECT seq, sha, chunk_pos, regexp_extract(chunk, 'a/(.+?) b/', 1) AS file_path, 'python' AS language,
       md5(concat('diff --git ', chunk)) AS diff_md5
FROM c WHERE chunk <> '' AND regexp_extract(chunk, 'a/(.+?) b/', 1) LIKE '%.py'
""")
def patch_split(spark, sf_dir):
    """Whole-commit patches split per file; unsupported (.md) files dropped."""
    p = SC.split_patch(fx(spark, sf_dir, "fx_patches"))
    return p.select("seq", "sha", "chunk_pos", "file_path", "language", F.md5("diff").alias("diff_md5"))


@query("files_per_commit_cap", cte("fx_file_diffs") + """
SELECT repo_id, sha, file_id, file_path, kept_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id, sha ORDER BY file_idx) AS kept_rank
  FROM fx_file_diffs WHERE file_path LIKE '%.py') t WHERE kept_rank <= 5
""")
def files_per_commit_cap(spark, sf_dir):
    """Supported files only, first five per commit in changed-path order."""
    f = SC.cap_files_per_commit(fx(spark, sf_dir, "fx_file_diffs"))
    return f.select("repo_id", "sha", "file_id", "file_path", F.col("kept_rank").cast("bigint").alias("kept_rank"))


@query("truncate_lines", """
SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines,
       CAST(len(string_split(array_to_string(string_split(text, chr(10))[1:500], chr(10)), chr(10))) AS BIGINT) AS n_kept,
       md5(array_to_string(string_split(text, chr(10))[1:500], chr(10))) AS kept_md5
FROM documents
""")
def truncate_lines(spark, sf_dir):
    """Every document cut to its first 500 lines (the client's file cap)."""
    d = table(spark, sf_dir, "documents")
    t = SC.truncate_lines(F.col("text"))
    return d.select("doc_id", F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"),
                    F.size(F.split(t, "\n")).cast("bigint").alias("n_kept"), F.md5(t).alias("kept_md5"))


@query("synthetic_diff", cte("fx_file_diffs") + """
SELECT file_id, md5(concat('@@ -0,0 +1,', CAST(len(string_split(file_content, chr(10))) AS VARCHAR), ' @@', chr(10),
           array_to_string(list_transform(string_split(file_content, chr(10)), lambda l: concat('+', l)), chr(10)))) AS diff_md5
FROM fx_file_diffs
""")
def synthetic_diff(spark, sf_dir):
    """All-added diffs for files without a parent version."""
    f = fx(spark, sf_dir, "fx_file_diffs")
    return f.select("file_id", F.md5(SC.synthetic_diff(SC.truncate_lines(F.col("file_content")))).alias("diff_md5"))


@query("detect_language", cte("fx_file_diffs", "fx_patches") + """,
p AS (SELECT file_path AS path FROM fx_file_diffs
      UNION ALL SELECT regexp_extract(patch, 'a/(.+?) b/', 1) FROM fx_patches)
SELECT path,
  CASE WHEN ends_with(path, '.py') THEN 'python' WHEN ends_with(path, '.js') THEN 'javascript'
       WHEN ends_with(path, '.jsx') THEN 'javascript' WHEN ends_with(path, '.ts') THEN 'typescript'
       WHEN ends_with(path, '.tsx') THEN 'tsx' WHEN ends_with(path, '.mjs') THEN 'javascript'
       WHEN ends_with(path, '.cjs') THEN 'javascript' END AS lang_backend,
  CASE WHEN ends_with(path, '.js') THEN 'javascript' WHEN ends_with(path, '.ts') THEN 'typescript'
       WHEN ends_with(path, '.py') THEN 'python' WHEN ends_with(path, '.java') THEN 'java'
       WHEN ends_with(path, '.go') THEN 'go' WHEN ends_with(path, '.rs') THEN 'rust'
       WHEN ends_with(path, '.rb') THEN 'ruby' END AS lang_cli
FROM p
""")
def detect_language(spark, sf_dir):
    """language per path under the backend and CLI profiles."""
    a = fx(spark, sf_dir, "fx_file_diffs").select(F.col("file_path").alias("path"))
    b = fx(spark, sf_dir, "fx_patches").select(F.regexp_extract("patch", r"a/(.+?) b/", 1).alias("path"))
    p = a.unionByName(b)
    return p.select("path", S.detect_language("path", "backend").alias("lang_backend"),
                    S.detect_language("path", "cli_commit").alias("lang_cli"))


@query("normalize_repo_id", """
SELECT page_id,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^git@', ''), '^https?://', ''), '^([^:]*):', '\\1/'), '\\.git$', '') AS repo_id,
  nullif(regexp_extract(url, '/([^/]+?)(\\.git)?$', 1), '') AS short_name
FROM pages
""")
def normalize_repo_id(spark, sf_dir):
    """remote URL -> host/user/repo id and short name."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", S.normalize_repo_id("url").alias("repo_id"), S.repo_short_name("url").alias("short_name"))


@query("code_hash", """
SELECT doc_id, substr(sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), 1, 16) AS code_hash FROM documents
""")
def code_hash(spark, sf_dir):
    """16-hex sha256 of the stripped text (the embedding cache key)."""
    return table(spark, sf_dir, "documents").select("doc_id", S.code_hash("text").alias("code_hash"))
