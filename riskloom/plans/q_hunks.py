"""Hunk attribution (D9) over the Python file diffs and all-added diffs of the JS/TS files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diffs as D
from ..sources import commits as SC
from .catalog import query
from .fixtures import cte, fx

JS_ID_OFFSET = 100_000_000

_CTX = r"@@ .+? @@\s*(?:.*?(?:function\s+(\w+)|def\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=))?"
_DECL = r"^[+ ]\s*(?:async\s+)?(?:function\s+(\w+)|def\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\()"
_START = r"@@ .+?\+(\d+)"


def _g(pattern: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(line, '{pattern}', {i}), '')" for i in (1, 2, 3)) + ")"


_ADDED = "starts_with(line, '+') AND NOT starts_with(line, '+++')"

_HUNKS_SQL = cte("fx_file_diffs", "fx_js_files") + f""",
src AS (SELECT file_id, file_path, diff FROM fx_file_diffs
        UNION ALL
        SELECT file_id + {JS_ID_OFFSET}, file_path,
          concat('@@ -0,0 +1,', CAST(len(string_split(file_content, chr(10))) AS VARCHAR), ' @@', chr(10),
                 array_to_string(list_transform(string_split(file_content, chr(10)), lambda l: concat('+', l)), chr(10)))
        FROM fx_js_files),
x AS (SELECT file_id, file_path, CAST(generate_subscripts(string_split(diff, chr(10)), 1) - 1 AS BIGINT) AS idx,
             unnest(string_split(diff, chr(10))) AS line FROM src),
y AS (SELECT *, regexp_matches(line, '{_CTX}') AS is_hdr FROM x),
z AS (SELECT *,
        CASE WHEN is_hdr THEN {_g(_CTX)} END AS hdr_name,
        CASE WHEN is_hdr THEN coalesce(TRY_CAST(regexp_extract(line, '{_START}', 1) AS INTEGER), 0) END AS hdr_start,
        CASE WHEN NOT is_hdr THEN {_g(_DECL)} END AS decl,
        (NOT is_hdr) AND {_ADDED} AS added,
        sum(CASE WHEN is_hdr THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS seg
      FROM y),
sg AS (SELECT file_id, file_path, seg,
         coalesce(arg_max(decl, idx) FILTER (WHERE decl IS NOT NULL), max(hdr_name)) AS name,
         coalesce(max(hdr_start), 0) AS start_line, max(idx) + 1 AS end_line,
         count(*) FILTER (WHERE added) AS n_added,
         coalesce(string_agg(substr(line, 2), chr(10) ORDER BY idx) FILTER (WHERE added), '') AS code
       FROM z GROUP BY file_id, file_path, seg),
nm AS (SELECT * FROM sg WHERE name IS NOT NULL AND n_added > 0),
fb AS (SELECT file_id, -1 AS seg,
         CASE WHEN strpos(substr(regexp_extract(file_path, '([^/]+)$', 1), 2), '.') > 0
              THEN regexp_replace(regexp_extract(file_path, '([^/]+)$', 1), '\\.[^.]*$', '')
              ELSE regexp_extract(file_path, '([^/]+)$', 1) END AS name,
         1 AS start_line, count(*) FILTER (WHERE {_ADDED}) AS end_line,
         count(*) FILTER (WHERE {_ADDED}) AS n_added,
         coalesce(string_agg(substr(line, 2), chr(10) ORDER BY idx) FILTER (WHERE {_ADDED}), '') AS code
       FROM z WHERE file_id NOT IN (SELECT file_id FROM nm)
       GROUP BY file_id, file_path
       HAVING max(CASE WHEN starts_with(line, '+') THEN 1 ELSE 0 END) = 1 AND count(*) FILTER (WHERE {_ADDED}) > 0)
SELECT file_id, CAST(seg AS BIGINT) AS seg, name, CAST(start_line AS BIGINT) AS start_line,
       CAST(end_line AS BIGINT) AS end_line, CAST(n_added AS BIGINT) AS n_added, md5(code) AS code_md5 FROM nm
UNION ALL
SELECT file_id, CAST(seg AS BIGINT), name, CAST(start_line AS BIGINT), CAST(end_line AS BIGINT),
       CAST(n_added AS BIGINT), md5(code) FROM fb
"""


@query("hunk_attribution", _HUNKS_SQL)
def hunk_attribution(spark, sf_dir):
    """Added lines attributed to function names from hunk headers and
    declarations (base-name fallback), over Python diffs and all-added JS/TS diffs."""
    py = fx(spark, sf_dir, "fx_file_diffs").select("file_id", "file_path", "diff")
    js = fx(spark, sf_dir, "fx_js_files").select(
        (F.col("file_id") + JS_ID_OFFSET).alias("file_id"), "file_path",
        SC.synthetic_diff(F.col("file_content")).alias("diff"))
    src = D.by_file(py.unionByName(js), ["file_id"])
    h = D.hunk_attribution(src, ["file_id"])
    return h.select("file_id", F.col("seg").cast("bigint").alias("seg"), "name",
                    F.col("start_line").cast("bigint").alias("start_line"),
                    F.col("end_line").cast("bigint").alias("end_line"),
                    F.col("n_added").cast("bigint").alias("n_added"), F.md5("code").alias("code_md5"))
