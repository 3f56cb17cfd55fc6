"""JavaScript / TypeScript queries: function blocks (D3/D4) and relationship
extraction (F17–F21) on the JS/TS file view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import blocks as B
from .catalog import query
from .fixtures import cte, fx

IDS = ["file_id"]

# DuckDB twin: a simpler line rule that holds for these files — blocks start at
# ``function`` declarations and at arrow functions assigned to constants, and a
# multi-line block ends at the first closing line.
_JS_BLOCKS_SQL = cte("fx_js_files") + r""",
l AS (SELECT file_id, CAST(generate_subscripts(string_split(file_content, chr(10)), 1) AS BIGINT) AS ln,
             unnest(string_split(file_content, chr(10))) AS line FROM fx_js_files),
st AS (SELECT file_id, ln, line,
         CASE WHEN regexp_matches(line, '^(export )?function \w+') THEN regexp_extract(line, 'function (\w+)', 1)
              WHEN regexp_matches(line, '^const \w+ = (async )?\(') THEN regexp_extract(line, '^const (\w+)', 1)
              WHEN regexp_matches(line, '^const \w+ = \w+ =>') THEN regexp_extract(line, '^const \w+ = (\w+) =>', 1)
              END AS name,
         CASE WHEN regexp_matches(line, '^(export )?function') THEN strpos(line, 'function')
              WHEN regexp_matches(line, '^const \w+ = ') THEN strpos(line, '= ') + 2 END AS col,
         ends_with(line, '{') AS multi
       FROM l),
b AS (SELECT st.file_id, st.ln AS start_line, st.name, st.col, st.multi,
        CASE WHEN st.multi THEN (SELECT min(l.ln) FROM l WHERE l.file_id = st.file_id AND l.ln > st.ln
                                 AND l.line IN ('}', '};')) ELSE st.ln END AS end_line
      FROM st WHERE st.name IS NOT NULL)
SELECT b.file_id, CAST(row_number() OVER (PARTITION BY b.file_id ORDER BY b.start_line) - 1 AS INTEGER) AS func_idx,
  b.name, CAST(b.start_line AS INTEGER) AS start_line, CAST(b.end_line AS INTEGER) AS end_line,
  (SELECT string_agg(CASE WHEN l.ln = b.start_line AND NOT b.multi THEN rtrim(substr(l.line, b.col), ';')
                          WHEN l.ln = b.start_line THEN substr(l.line, b.col)
                          WHEN l.ln = b.end_line THEN '}' ELSE l.line END, chr(10) ORDER BY l.ln)
     FROM l WHERE l.file_id = b.file_id AND l.ln BETWEEN b.start_line AND b.end_line) AS body
FROM b
"""


@query("function_blocks_js", _JS_BLOCKS_SQL)
def function_blocks_js(spark, sf_dir):
    """D3/D4 for JS/TS: declarations and arrow functions (named by the assigned
    constant, or by a bare parameter as the reference does); strings,
    templates and comments skipped."""
    b = B.function_blocks(fx(spark, sf_dir, "fx_js_files"), IDS)
    return b.select("file_id", "func_idx", "name", "start_line", "end_line", "body")


_JS_REL_SQL = cte("fx_js_files") + r"""
SELECT file_id,
  array_to_string(list_sort(list_distinct(list_concat(
      regexp_extract_all(file_content, 'import\s+.*?\s+from\s+[''"]([^''"]+)[''"]', 1),
      regexp_extract_all(file_content, 'require\s*\(\s*[''"]([^''"]+)[''"]\s*\)', 1)))), ',') AS imports,
  array_to_string(list_sort(list_distinct(list_concat(
      regexp_extract_all(file_content, '(?:async\s+)?function\s+(\w+)', 1),
      regexp_extract_all(file_content, '(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\(', 1),
      regexp_extract_all(file_content, '(?:const|let|var)\s+(\w+)\s*=\s*async\s*\(', 1),
      regexp_extract_all(file_content, 'export\s+(?:const|function)\s+(\w+)', 1)))), ',') AS function_names,
  array_to_string(list_sort(list_distinct(list_concat(
      regexp_extract_all(file_content, '\.from\s*\(\s*[''"](\w+)[''"]\s*\)', 1),
      regexp_extract_all(file_content, 'prisma\.(\w+)\.(?:find|create|update|delete|upsert)', 1),
      list_filter(list_transform(regexp_extract_all(file_content, '(?i)(?:FROM|INTO|UPDATE|JOIN)\s+["'']?(\w+)', 1),
                                 lambda x: lower(x)),
                  lambda x: x NOT IN ('select', 'where', 'set', 'values', 'and', 'or', 'not'))))), ',') AS table_usages,
  array_to_string(list_sort(list_distinct(list_transform(
      regexp_extract_all(file_content, '(?:fetch|axios\.\w+|http\.\w+)\s*\(\s*[''"`](https?://[^''"`\s]+)', 1),
      lambda u: split_part(u, '?', 1)))), ',') AS api_calls
FROM fx_js_files
"""


@query("extract_relationships_js", _JS_REL_SQL)
def extract_relationships_js(spark, sf_dir):
    """F17–F21 on JS/TS files: imports and requires, function names, tables, APIs."""
    f = fx(spark, sf_dir, "fx_js_files")
    r = f.select("file_id", S.extract_relationships(F.col("file_content"), S.detect_language("file_path")).alias("r"))

    def j(c):
        return F.array_join(F.array_sort(c), ",")

    return r.select("file_id", j("r.imports").alias("imports"), j("r.function_names").alias("function_names"),
                    j("r.table_usages").alias("table_usages"), j("r.api_calls").alias("api_calls"))
