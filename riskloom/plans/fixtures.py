"""Derived code-history views over the given tables.

The given tables hold no code history, so these views derive commits,
functions, vectors, file diffs, patches, graph edges, outcome events and
warnings from them. Each SQL text runs unchanged in Spark SQL and in DuckDB:
``register`` creates them as Spark temp views, ``cte`` renders the same text as
a WITH clause for the SQL twins in ``__spark_entry__.oracle_sql``. All of them
scale with their input table (no fixed inputs, no id subsets beyond the
fixture's own definition of which rows are e.g. reverted).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)

# Fixture view definitions (fixed values: these texts define the test data).
FX = {}

FX["fx_commits"] = """
SELECT doc_id AS seq,
  concat('repo', CAST(CAST(floor(doc_id / 10) AS BIGINT) % 4 AS STRING)) AS repo_id,
  md5(CAST(doc_id AS STRING)) AS sha,
  concat('dev', CAST(doc_id % 17 AS STRING), '@example.org') AS author,
  CASE WHEN doc_id % 10 = 3 THEN concat('Revert "change ', CAST(doc_id - 1 AS STRING), '"')
       WHEN doc_id % 10 = 6 THEN concat('Back out. This reverts commit ', substr(md5(CAST(doc_id - 2 AS STRING)), 1, 12), '.')
       WHEN doc_id % 50 = 9 THEN concat('revert ', substr(md5(CAST(doc_id - 4 AS STRING)), 1, 9))
       ELSE concat('change ', CAST(doc_id AS STRING)) END AS message,
  (doc_id % 10 = 2 OR doc_id % 10 = 4 OR doc_id % 50 = 5) AS revert_status,
  CASE WHEN doc_id % 7 = 0 THEN concat('bug:', CAST(doc_id AS STRING)) END AS bug_id
FROM documents
"""

FX["fx_functions"] = """
SELECT doc_id AS seq,
  concat('repo', CAST(CAST(floor(doc_id / 10) AS BIGINT) % 4 AS STRING)) AS repo_id,
  md5(CAST(doc_id AS STRING)) AS commit_sha,
  concat('fn_', CAST(doc_id % 50 AS STRING)) AS function_name,
  concat('m', CAST(doc_id % 13 AS STRING), '.py') AS file_path,
  text AS code_body
FROM documents
"""

FX["fx_vectors"] = """
SELECT vec_id AS seq,
  concat('repo', CAST(CAST(floor(vec_id / 10) AS BIGINT) % 4 AS STRING)) AS repo_id,
  md5(CAST(vec_id - vec_id % 2 AS STRING)) AS commit_sha,
  concat('fn_', CAST(vec_id % 50 AS STRING)) AS function_name,
  concat('m', CAST(vec_id % 13 AS STRING), '.py') AS file_path,
  embedding AS vector
FROM embeddings
"""

FX["fx_file_diffs"] = """
SELECT p_partkey AS file_id,
  concat('repo', CAST(CAST(floor(p_partkey / 8) AS BIGINT) % 4 AS STRING)) AS repo_id,
  md5(concat('c', CAST(CAST(floor(p_partkey / 8) AS BIGINT) AS STRING))) AS sha,
  p_partkey % 8 AS file_idx,
  concat('src/f', CAST(p_partkey AS STRING), CASE WHEN p_partkey % 5 = 4 THEN '.md' ELSE '.py' END) AS file_path,
  concat('import mod', CAST(p_size AS STRING), chr(10),
         'from pkg.sub', CAST(p_partkey % 11 AS STRING), ' import x', chr(10), chr(10),
         'def fn_', CAST(p_partkey AS STRING), '(a):', chr(10),
         '    db.run("SELECT * FROM tbl_', CAST(p_size AS STRING), '")', chr(10),
         '    return a', chr(10), chr(10),
         'def helper(b):', chr(10),
         '    fetch("https://api.example.org/v', CAST(p_partkey % 7 AS STRING), '?q=1")', chr(10),
         '    return b', chr(10)) AS file_content,
  concat('--- a/f', chr(10), '+++ b/f', chr(10),
         '@@ -', CAST(1 + p_partkey % 9 AS STRING), ',3 +', CAST(1 + p_partkey % 9 AS STRING), ',3 @@', chr(10),
         ' ctx', chr(10), '-old', chr(10), '+new', chr(10), ' ctx', chr(10)) AS diff
FROM part
"""

# JavaScript / TypeScript files in the same shape as fx_file_diffs' Python files.
FX["fx_js_files"] = r"""
SELECT p_partkey AS file_id,
  concat('repo', CAST(CAST(floor(p_partkey / 8) AS BIGINT) % 4 AS STRING)) AS repo_id,
  concat('web/c', CAST(p_partkey AS STRING),
         CASE WHEN p_partkey % 3 = 0 THEN '.ts' WHEN p_partkey % 3 = 1 THEN '.js' ELSE '.tsx' END) AS file_path,
  concat('import api from ', chr(39), './api', CAST(p_size AS STRING), chr(39), ';', chr(10),
         'const lib = require(', chr(39), 'lib', CAST(p_partkey % 5 AS STRING), chr(39), ');', chr(10), chr(10),
         'export function load', CAST(p_partkey AS STRING), '(id) {', chr(10),
         '  const s = ', chr(39), '}{', chr(39), ';', chr(10),
         '  return db.from(', chr(39), 'tbl_', CAST(p_size AS STRING), chr(39), ').select(s);', chr(10),
         '}', chr(10), chr(10),
         'const save = async (row) => {', chr(10),
         '  await fetch(`https://api.example.org/v', CAST(p_partkey % 7 AS STRING), '?x=1`);', chr(10),
         '  return prisma.item', CAST(p_partkey % 3 AS STRING), '.update(row);', chr(10),
         '};', chr(10), chr(10),
         'const inc = x => x + 1;', chr(10)) AS file_content
FROM part
"""

FX["fx_patches"] = """
SELECT p_partkey AS seq, md5(concat('p', CAST(p_partkey AS STRING))) AS sha,
  concat('diff --git a/src/a', CAST(p_partkey AS STRING), '.py b/src/a', CAST(p_partkey AS STRING), '.py', chr(10),
         '@@ -1,1 +1,1 @@', chr(10), '-x', chr(10), '+y', chr(10),
         'diff --git a/doc/b', CAST(p_partkey AS STRING), '.md b/doc/b', CAST(p_partkey AS STRING), '.md', chr(10),
         '@@ -1,1 +1,1 @@', chr(10), '-x', chr(10), '+y', chr(10)) AS patch
FROM part
"""

# The supplier count enters as a scalar subquery (one value), not a cross join.
FX["fx_imports"] = """
SELECT concat('f', CAST(s_suppkey AS STRING)) AS src,
       concat('f', CAST((s_suppkey * 7 + 3) % (SELECT count(*) FROM supplier) AS STRING)) AS dst
FROM supplier
UNION
SELECT concat('f', CAST(s_suppkey AS STRING)),
       concat('f', CAST(CAST(floor(s_suppkey / 3) AS BIGINT) AS STRING))
FROM supplier
"""

# Modules in Python packages and TypeScript folders, and the specifiers by which they name each other.
FX["fx_modules"] = """
SELECT s_suppkey AS k, concat('repo', CAST(s_suppkey % 2 AS STRING)) AS repo_id,
  concat(CASE WHEN s_suppkey % 2 = 0 THEN 'backend/app/p' ELSE 'web/src/p' END, CAST(CAST(floor(s_suppkey / 2) AS BIGINT) % 7 AS STRING), '/m', CAST(s_suppkey AS STRING),
    CASE s_suppkey % 6 WHEN 0 THEN '.py' WHEN 2 THEN '/__init__.py' WHEN 4 THEN '.py' WHEN 1 THEN '.ts' WHEN 3 THEN '/index.tsx' ELSE '.js' END) AS file_path
FROM supplier
"""

FX["fx_module_imports"] = """
SELECT concat('repo', CAST(k % 2 AS STRING)) AS repo_id, src,
  CASE WHEN k % 11 = 5 THEN CASE WHEN k % 2 = 0 THEN 'numpy.linalg' ELSE 'react' END
       WHEN k % 2 = 0 AND j % 14 = k % 14 THEN concat(CASE WHEN k % 6 = 2 THEN '..' ELSE '.' END, 'm', CAST(j AS STRING))
       WHEN k % 2 = 0 THEN concat('app.p', CAST(CAST(floor(j / 2) AS BIGINT) % 7 AS STRING), '.m', CAST(j AS STRING))
       ELSE concat(CASE WHEN k % 6 = 3 THEN '../../p' ELSE '../p' END, CAST(CAST(floor(j / 2) AS BIGINT) % 7 AS STRING), '/m', CAST(j AS STRING), CASE WHEN k % 5 = 1 THEN '.js' ELSE '' END) END AS dst
FROM (SELECT s_suppkey AS k, s_suppkey + 2 * (1 + s_suppkey * 13 % 23) AS j,
        concat(CASE WHEN s_suppkey % 2 = 0 THEN 'backend/app/p' ELSE 'web/src/p' END, CAST(CAST(floor(s_suppkey / 2) AS BIGINT) % 7 AS STRING), '/m', CAST(s_suppkey AS STRING),
          CASE s_suppkey % 6 WHEN 0 THEN '.py' WHEN 2 THEN '/__init__.py' WHEN 4 THEN '.py' WHEN 1 THEN '.ts' WHEN 3 THEN '/index.tsx' ELSE '.js' END) AS src
      FROM supplier) t
"""

FX["fx_uses_table"] = """
SELECT DISTINCT concat('f', CAST(l_suppkey AS STRING)) AS file_path,
  concat('t', CAST(l_partkey AS STRING)) AS table_name
FROM lineitem
"""

FX["fx_calls_api"] = """
SELECT DISTINCT concat('f', CAST(l_suppkey AS STRING)) AS file_path,
  concat('https://api.example.org/', CAST(l_partkey % 997 AS STRING)) AS url
FROM lineitem
"""

FX["fx_modifies"] = """
SELECT DISTINCT concat('c', CAST(l_orderkey AS STRING)) AS sha,
  concat('f', CAST(l_suppkey AS STRING)) AS file_path,
  l_orderkey % 997 = 0 AS is_reverted
FROM lineitem
"""

# Functions contained in the graph's files (for blast-radius function lists).
FX["fx_contains"] = """
SELECT DISTINCT concat('f', CAST(l_suppkey AS STRING)) AS file_path,
  concat('fn_', CAST(l_partkey % 7 AS STRING)) AS function_name
FROM lineitem
"""

FX["fx_outcome_events"] = """
SELECT event_id, ts, md5(CAST(user_id AS STRING)) AS commit_sha,
  CASE event_type WHEN 'error' THEN 'ci' WHEN 'purchase' THEN 'revert'
    WHEN 'signup' THEN 'pull_request' WHEN 'view' THEN 'push' ELSE 'other' END AS kind,
  concat('pipe', CAST(event_id % 3 AS STRING)) AS pipeline,
  event_id % 3 = 0 AS merged,
  event_id % 3 = 0 OR event_id % 5 < 3 AS closed
FROM events
"""

FX["fx_warnings"] = """
SELECT event_id AS id, md5(CAST(user_id AS STRING)) AS commit_sha,
  concat('repo', CAST(CAST(floor(user_id / 10) AS BIGINT) % 4 AS STRING)) AS repo_id,
  concat('fn_', CAST(event_id % 29 AS STRING)) AS function_name,
  concat('m', CAST(event_id % 13 AS STRING), '.py') AS file_path,
  event_id % 100 + 1 AS start_line, event_id % 100 + 1 + event_id % 17 AS end_line,
  CAST(8000 + event_id % 2000 AS DOUBLE) / 10000 AS similarity_score,
  CASE event_type WHEN 'error' THEN 'HIGH' WHEN 'purchase' THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  ts AS created_at
FROM events
"""


def register_base(spark: SparkSession, sf_dir: str, names=BASE_TABLES) -> None:
    """Register the given parquet tables of ``sf_dir`` as temp views."""
    for name in names:
        path = os.path.join(sf_dir, f"{name}.parquet")
        spark.read.parquet(path).createOrReplaceTempView(name)


def register(spark: SparkSession, sf_dir: str) -> None:
    """Register base tables and every fixture view for ``sf_dir``."""
    register_base(spark, sf_dir)
    for name, sql in FX.items():
        spark.sql(sql).createOrReplaceTempView(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table (parquet scan; filters and projections push into it)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# Which given tables each fixture reads.
FX_SOURCES = {
    "fx_commits": ("documents",), "fx_functions": ("documents",),
    "fx_vectors": ("embeddings",), "fx_file_diffs": ("part",),
    "fx_patches": ("part",), "fx_js_files": ("part",), "fx_imports": ("supplier",),
    "fx_modules": ("supplier",), "fx_module_imports": ("supplier",),
    "fx_uses_table": ("lineitem",), "fx_calls_api": ("lineitem",),
    "fx_modifies": ("lineitem",), "fx_contains": ("lineitem",), "fx_outcome_events": ("events",),
    "fx_warnings": ("events",),
}


# Views that make long texts of short rows: a file of a few MB, which is read in one or two tasks, is much work.
FX_SPREAD = ("fx_file_diffs", "fx_js_files", "fx_patches")


def fx(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view as a DataFrame (registers the base tables it reads)."""
    register_base(spark, sf_dir, FX_SOURCES[name])
    if name in FX_SPREAD:   # the short rows are dealt out before the texts are made
        n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        for base in FX_SOURCES[name]:
            table(spark, sf_dir, base).repartition(n).createOrReplaceTempView(base)
    return spark.sql(FX[name])


def cte(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` for the SQL twins."""
    return "WITH " + ",\n".join(f"{n} AS ({FX[n]})" for n in names) + "\n"
