"""Graph queries (G1–G12) over the graph fixtures and over edges extracted from diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graph as G
from ..operators import imports as IM
from .catalog import query
from .fixtures import cte, fx

_GRAPH = cte("fx_imports", "fx_uses_table", "fx_calls_api", "fx_modifies", "fx_contains")

_HOPS = """,
h1 AS (SELECT DISTINCT dst AS file_path, src AS dependent FROM fx_imports),
h2 AS (SELECT DISTINCT h1.file_path, e.src AS dependent FROM h1 JOIN fx_imports e ON e.dst = h1.dependent),
h3 AS (SELECT DISTINCT h2.file_path, e.src AS dependent FROM h2 JOIN fx_imports e ON e.dst = h2.dependent),
deps AS (SELECT file_path, dependent, min(hop) AS hop FROM (
           SELECT *, 1 AS hop FROM h1 UNION ALL SELECT *, 2 FROM h2 UNION ALL SELECT *, 3 FROM h3) t
         GROUP BY file_path, dependent)
"""

_SHARED = """,
rev AS (SELECT DISTINCT file_path, sha FROM fx_modifies WHERE is_reverted),
srt AS (SELECT DISTINCT u.file_path, u.table_name, o.file_path AS other_file, rev.sha AS reverted_sha
        FROM fx_uses_table u JOIN fx_uses_table o ON o.table_name = u.table_name
        JOIN rev ON rev.file_path = o.file_path WHERE o.file_path <> u.file_path),
sra AS (SELECT DISTINCT u.file_path, u.url, o.file_path AS other_file
        FROM fx_calls_api u JOIN fx_calls_api o ON o.url = u.url
        JOIN rev ON rev.file_path = o.file_path WHERE o.file_path <> u.file_path)
"""


def _g(spark, sf_dir):
    return {n: fx(spark, sf_dir, f"fx_{n}") for n in ("imports", "uses_table", "calls_api", "modifies", "contains")}


@query("shared_reverted_tables", _GRAPH + _SHARED + "SELECT file_path, table_name, other_file, reverted_sha FROM srt")
def shared_reverted_tables(spark, sf_dir):
    """Tables a file shares with other files modified by reverted commits."""
    g = _g(spark, sf_dir)
    return G.shared_reverted(g["uses_table"], g["modifies"], "table_name")


@query("shared_reverted_apis", _GRAPH + _SHARED + "SELECT file_path, url, other_file FROM sra")
def shared_reverted_apis(spark, sf_dir):
    """APIs a file shares with other files modified by reverted commits."""
    g = _g(spark, sf_dir)
    return G.shared_reverted(g["calls_api"], g["modifies"], "url", commits=False)


_GROUPS = """,
rv AS (SELECT file_path, count(DISTINCT sha) AS n FROM fx_modifies WHERE is_reverted GROUP BY file_path),
gr AS (SELECT table_name, u.file_path, coalesce(rv.n, 0) AS n_reverted_commits FROM fx_uses_table u LEFT JOIN rv ON rv.file_path = u.file_path)
"""


@query("shared_table_groups", _GRAPH + _GROUPS + """
SELECT *, count(*) OVER (PARTITION BY table_name) AS n_files, count(*) FILTER (WHERE n_reverted_commits > 0) OVER (PARTITION BY table_name) AS n_reverted_files FROM gr
""")
def shared_table_groups(spark, sf_dir):
    """G2/J7 factorised: every use of a table, with what a pair needs; rows linear in the uses."""
    g = _g(spark, sf_dir)
    return G.shared_groups(g["uses_table"], g["modifies"], "table_name")


@query("shared_tables_of", _GRAPH + _SHARED + """
SELECT DISTINCT table_name, file_path, other_file FROM srt WHERE CAST(substr(file_path, 2) AS BIGINT) % 100 = 0
""")
def shared_tables_of(spark, sf_dir):
    """The pairs of the files asked for (a search's queries: every hundredth file), from the groups."""
    g = _g(spark, sf_dir)
    groups = G.shared_groups(g["uses_table"], g["modifies"], "table_name")
    asked = g["uses_table"].where(F.expr("cast(substr(file_path, 2) as bigint) % 100 = 0")).select("file_path")
    return G.shared_of(groups, asked, "table_name")


@query("blast_radius_estimate", _GRAPH + _HOPS + "SELECT file_path, count(*) AS blast_radius FROM deps GROUP BY file_path")
def blast_radius_estimate(spark, sf_dir):
    """G4/G7 by merged sketches: exact for sets this small, within the sketch's error beyond."""
    return G.blast_radius_estimate(_g(spark, sf_dir)["imports"])


@query("reverted_neighbors", _GRAPH + _SHARED + """
SELECT file_path, array_to_string(list_sort(list(DISTINCT concat(other_file, ' (commit ', substr(reverted_sha, 1, 7), ')'))), ';') AS neighbors
FROM srt GROUP BY file_path
""")
def reverted_neighbors(spark, sf_dir):
    """``file (commit sha7)`` labels of reverted table neighbours per file."""
    g = _g(spark, sf_dir)
    r = G.reverted_neighbors(g["uses_table"], g["modifies"])
    return r.select("file_path", F.array_join("neighbors", ";").alias("neighbors"))


@query("k_hop_dependents", _GRAPH + _HOPS + "SELECT file_path, dependent, CAST(hop AS INTEGER) AS hop FROM deps")
def k_hop_dependents(spark, sf_dir):
    """Dependents within 1..3 import hops (shortest hop kept)."""
    return G.k_hop_dependents(_g(spark, sf_dir)["imports"]).select("file_path", "dependent", "hop")


@query("blast_radius_count", _GRAPH + _HOPS + "SELECT file_path, count(*) AS blast_radius FROM deps GROUP BY file_path")
def blast_radius_count(spark, sf_dir):
    """Blast radius = number of distinct dependents within three hops."""
    return G.blast_radius_count(_g(spark, sf_dir)["imports"])


@query("blast_radius_direct", _GRAPH + """,
fns AS (SELECT file_path, array_to_string(list_sort(list(DISTINCT function_name)), ',') AS functions
        FROM fx_contains GROUP BY file_path)
SELECT d.file_path, d.dependent, coalesce(fns.functions, '') AS functions
FROM (SELECT DISTINCT dst AS file_path, src AS dependent FROM fx_imports) d LEFT JOIN fns ON fns.file_path = d.file_path
""")
def blast_radius_direct(spark, sf_dir):
    """Direct importers with the functions of the imported file."""
    g = _g(spark, sf_dir)
    r = G.direct_dependents(g["imports"], g["contains"])
    return r.select("file_path", "dependent", F.array_join("functions", ",").alias("functions"))


@query("blast_radius_indirect", _GRAPH + _HOPS + """
SELECT file_path, dependent, '(indirect dependency)' AS uses FROM (
  SELECT file_path, dependent FROM h2 UNION SELECT file_path, dependent FROM h3
  EXCEPT SELECT file_path, dependent FROM h1) t
""")
def blast_radius_indirect(spark, sf_dir):
    """Dependents at 2..3 hops that do not import the file directly."""
    r = G.indirect_dependents(_g(spark, sf_dir)["imports"])
    return r.select("file_path", "dependent", F.lit("(indirect dependency)").alias("uses"))


@query("blast_radius_summary", _GRAPH + _HOPS + """,
d1 AS (SELECT file_path, count(*) AS n FROM h1 GROUP BY file_path),
d23 AS (SELECT file_path, count(*) AS n FROM (SELECT file_path, dependent FROM h2 UNION SELECT file_path, dependent FROM h3
                                              EXCEPT SELECT file_path, dependent FROM h1) t GROUP BY file_path),
fn AS (SELECT file_path, count(*) AS n FROM fx_contains GROUP BY file_path),
f AS (SELECT file_path FROM d1 UNION SELECT file_path FROM d23 UNION SELECT file_path FROM fn)
SELECT f.file_path, coalesce(d1.n, 0) AS n_direct, coalesce(d23.n, 0) AS n_indirect,
       coalesce(d1.n, 0) + coalesce(d23.n, 0) AS total_affected, coalesce(fn.n, 0) AS n_functions
FROM f LEFT JOIN d1 ON d1.file_path = f.file_path LEFT JOIN d23 ON d23.file_path = f.file_path
LEFT JOIN fn ON fn.file_path = f.file_path
""")
def blast_radius_summary(spark, sf_dir):
    """Per file, direct + indirect dependents (total affected) and its function count."""
    g = _g(spark, sf_dir)
    d1 = G.direct_dependents(g["imports"], g["contains"]).groupBy("file_path").agg(F.count(F.lit(1)).alias("n_direct"))
    d23 = G.indirect_dependents(g["imports"]).groupBy("file_path").agg(F.count(F.lit(1)).alias("n_indirect"))
    fn = g["contains"].groupBy("file_path").agg(F.count(F.lit(1)).alias("n_functions"))
    r = d1.join(d23, "file_path", "full").join(fn, "file_path", "full").fillna(0, ["n_direct", "n_indirect", "n_functions"])
    return r.select("file_path", "n_direct", "n_indirect",
                    (F.col("n_direct") + F.col("n_indirect")).alias("total_affected"), "n_functions")


@query("graph_risk", _GRAPH + _HOPS + _SHARED + """,
br AS (SELECT file_path, count(*) AS n FROM deps GROUP BY file_path),
files AS (SELECT file_path FROM fx_uses_table UNION SELECT file_path FROM fx_calls_api UNION SELECT file_path FROM fx_modifies
          UNION SELECT src FROM fx_imports UNION SELECT dst FROM fx_imports),
fl AS (SELECT files.file_path,
         files.file_path IN (SELECT file_path FROM srt) AS shares_table,
         files.file_path IN (SELECT file_path FROM sra) AS shares_api,
         coalesce(br.n, 0) AS blast_radius
       FROM files LEFT JOIN br ON br.file_path = files.file_path)
SELECT file_path, shares_table, shares_api, blast_radius > 3 AS many_dependents,
  round(least(1.0, CASE WHEN shares_table THEN 0.5 ELSE 0.0 END + CASE WHEN shares_api THEN 0.3 ELSE 0.0 END
                   + CASE WHEN blast_radius > 3 THEN 0.2 ELSE 0.0 END)::DOUBLE, 4) AS graph_risk_score
FROM fl
""")
def graph_risk(spark, sf_dir):
    """Graph risk score per file (linear min/max flags, no pair join)."""
    g = _g(spark, sf_dir)
    return G.graph_risk(g["uses_table"], g["calls_api"], g["modifies"], g["imports"])


_DIFF_REL = cte("fx_file_diffs") + """,
r AS (SELECT repo_id, sha, file_path,
  list_distinct(list_concat(regexp_extract_all(file_content, '(?m)^from\\s+([\\w.]+)\\s+import', 1),
                            regexp_extract_all(file_content, '(?m)^import\\s+([\\w.]+)', 1))) AS imports,
  list_distinct(regexp_extract_all(file_content, '(?:async\\s+)?def\\s+(\\w+)\\s*\\(', 1)) AS function_names,
  list_distinct(list_concat(regexp_extract_all(file_content, '\\.from\\s*\\(\\s*[''"](\\w+)[''"]\\s*\\)', 1),
                            regexp_extract_all(file_content, 'prisma\\.(\\w+)\\.(?:find|create|update|delete|upsert)', 1),
                            list_filter(list_transform(regexp_extract_all(file_content, '(?i)(?:FROM|INTO|UPDATE|JOIN)\\s+["'']?(\\w+)', 1), lambda x: lower(x)),
                                        lambda x: x NOT IN ('select', 'where', 'set', 'values', 'and', 'or', 'not')))) AS table_usages,
  list_distinct(list_transform(regexp_extract_all(file_content, '(?:fetch|axios\\.\\w+|http\\.\\w+)\\s*\\(\\s*[''"`](https?://[^''"`\\s]+)', 1),
                               lambda u: split_part(u, '?', 1))) AS api_calls
FROM fx_file_diffs WHERE file_path LIKE '%.py')
"""


def _diff_rel(spark, sf_dir):
    f = fx(spark, sf_dir, "fx_file_diffs").where(S.detect_language("file_path").isNotNull())
    return f.select("repo_id", "sha", "file_path",
                    S.extract_relationships(F.col("file_content"), S.detect_language("file_path")).alias("r"))


def _j(c):
    return F.array_join(F.array_sort(c), ",")


@query("extract_imports", _DIFF_REL + "SELECT sha, file_path, array_to_string(list_sort(imports), ',') AS imports FROM r")
def extract_imports(spark, sf_dir):
    """import specifiers per file."""
    return _diff_rel(spark, sf_dir).select("sha", "file_path", _j("r.imports").alias("imports"))


@query("extract_function_names", _DIFF_REL
       + "SELECT sha, file_path, array_to_string(list_sort(function_names), ',') AS function_names FROM r")
def extract_function_names(spark, sf_dir):
    """function names per file by regex."""
    return _diff_rel(spark, sf_dir).select("sha", "file_path", _j("r.function_names").alias("function_names"))


@query("extract_tables", _DIFF_REL + "SELECT sha, file_path, array_to_string(list_sort(table_usages), ',') AS table_usages FROM r")
def extract_tables(spark, sf_dir):
    """table usages (compat mode: import lines yield false tables, as in the reference)."""
    return _diff_rel(spark, sf_dir).select("sha", "file_path", _j("r.table_usages").alias("table_usages"))


@query("extract_apis", _DIFF_REL + "SELECT sha, file_path, array_to_string(list_sort(api_calls), ',') AS api_calls FROM r")
def extract_apis(spark, sf_dir):
    """external API URLs without query strings."""
    return _diff_rel(spark, sf_dir).select("sha", "file_path", _j("r.api_calls").alias("api_calls"))


@query("extract_relationships", _DIFF_REL + """
SELECT sha, file_path, array_to_string(list_sort(imports), ',') AS imports,
  array_to_string(list_sort(function_names), ',') AS function_names,
  array_to_string(list_sort(table_usages), ',') AS table_usages,
  array_to_string(list_sort(api_calls), ',') AS api_calls FROM r
""")
def extract_relationships(spark, sf_dir):
    """the combined relationship record per file."""
    r = _diff_rel(spark, sf_dir)
    return r.select("sha", "file_path", _j("r.imports").alias("imports"), _j("r.function_names").alias("function_names"),
                    _j("r.table_usages").alias("table_usages"), _j("r.api_calls").alias("api_calls"))


@query("kg_edges", _DIFF_REL + """
SELECT 'imports' AS edge, repo_id, file_path AS src, x AS dst FROM (SELECT repo_id, file_path, unnest(imports) AS x FROM r) t
UNION SELECT 'contains', repo_id, file_path, x FROM (SELECT repo_id, file_path, unnest(function_names) AS x FROM r) t
UNION SELECT 'uses_table', repo_id, file_path, x FROM (SELECT repo_id, file_path, unnest(table_usages) AS x FROM r) t
UNION SELECT 'calls_api', repo_id, file_path, x FROM (SELECT repo_id, file_path, unnest(api_calls) AS x FROM r) t
UNION SELECT 'modifies', repo_id, sha, file_path FROM r
""")
def kg_edges(spark, sf_dir):
    """G1: deduplicated edge tables of the code graph, extracted from every supported file diff."""
    f = fx(spark, sf_dir, "fx_file_diffs").where(S.detect_language("file_path").isNotNull())
    e = G.kg_edges(f, keys=["repo_id"])
    parts = [e["imports"].select(F.lit("imports").alias("edge"), "repo_id", "src", "dst"),
             e["contains"].select(F.lit("contains").alias("edge"), "repo_id", F.col("file_path").alias("src"),
                                  F.col("function_name").alias("dst")),
             e["uses_table"].select(F.lit("uses_table").alias("edge"), "repo_id", F.col("file_path").alias("src"),
                                    F.col("table_name").alias("dst")),
             e["calls_api"].select(F.lit("calls_api").alias("edge"), "repo_id", F.col("file_path").alias("src"),
                                   F.col("url").alias("dst")),
             e["modifies"].select(F.lit("modifies").alias("edge"), "repo_id", F.col("sha").alias("src"),
                                  F.col("file_path").alias("dst"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("graph_stats", _DIFF_REL + """,
fl AS (SELECT repo_id, file_path AS p FROM r UNION SELECT repo_id, unnest(imports) FROM r)
SELECT s.repo_id, (SELECT count(DISTINCT p) FROM fl WHERE fl.repo_id = s.repo_id) AS files,
  (SELECT count(*) FROM (SELECT DISTINCT file_path, unnest(function_names) FROM r WHERE r.repo_id = s.repo_id) t) AS functions,
  (SELECT count(DISTINCT x) FROM (SELECT unnest(table_usages) AS x FROM r WHERE r.repo_id = s.repo_id) t) AS tables,
  (SELECT count(DISTINCT sha) FROM r WHERE r.repo_id = s.repo_id) AS commits
FROM (SELECT DISTINCT repo_id FROM r) s
""")
def graph_stats(spark, sf_dir):
    """Node counts per repository (true counts)."""
    f = fx(spark, sf_dir, "fx_file_diffs").where(S.detect_language("file_path").isNotNull())
    return G.graph_stats(G.kg_edges(f, keys=["repo_id"]), keys=["repo_id"])


# The twin walks the path step by step: it drops one "folder/.." per round.
_RESOLVE_SQL = "WITH RECURSIVE " + cte("fx_modules", "fx_module_imports")[5:] + """,
i AS (SELECT DISTINCT repo_id, src, dst, regexp_extract(src, '^(.*)/[^/]*$', 1) AS dir FROM fx_module_imports),
walk AS (SELECT repo_id, src, dst, concat(dir, '/', dst) AS p FROM i WHERE dst LIKE '.%/%'
         UNION ALL
         SELECT repo_id, src, dst, regexp_replace(p, '[^/.]+/[.][.]/', '') FROM walk WHERE p LIKE '%/../%'),
js AS (SELECT repo_id, src, dst, p FROM walk WHERE p NOT LIKE '%/../%' UNION ALL SELECT repo_id, src, dst, dst FROM i WHERE src NOT LIKE '%.py' AND dst NOT LIKE '.%'),
ext(n, e) AS (VALUES (0, ''), (1, '.ts'), (2, '.tsx'), (3, '.js'), (4, '.jsx'), (5, '.mjs'), (6, '.cjs'), (7, '/index.ts'), (8, '/index.tsx'), (9, '/index.js'), (10, '/index.jsx')),
py AS (SELECT repo_id, src, dst, string_split(dir, '/') AS parts, length(dst) - length(ltrim(dst, '.')) AS dots, replace(ltrim(dst, '.'), '.', '/') AS rest FROM i WHERE src LIKE '%.py'),
up AS (SELECT *, unnest(CASE WHEN dots > 0 THEN [len(parts) - dots + 1] ELSE range(0, len(parts) + 1) END) AS depth FROM py),
tries AS (SELECT repo_id, src, dst, n, concat(p, e) AS path FROM js, ext
          UNION ALL SELECT repo_id, src, dst, 20 + n, concat(regexp_replace(p, '[.]js$', ''), e) FROM js, ext WHERE p LIKE '%.js' AND n IN (1, 2)
          UNION ALL SELECT repo_id, src, dst, 100 - 2 * depth + x, concat(CASE WHEN depth = 0 THEN '' ELSE concat(array_to_string(parts[1:depth], '/'), '/') END, rest, e)
                    FROM up, (VALUES (0, '.py'), (1, '/__init__.py')) v(x, e)),
hit AS (SELECT t.repo_id, src, dst, arg_min(file_path, n) AS target FROM tries t JOIN fx_modules m ON m.repo_id = t.repo_id AND m.file_path = t.path GROUP BY t.repo_id, src, dst)
"""


@query("resolve_imports", _RESOLVE_SQL + """
SELECT i.repo_id, i.src, i.dst AS specifier, hit.target FROM i LEFT JOIN hit ON hit.repo_id = i.repo_id AND hit.src = i.src AND hit.dst = i.dst
""")
def resolve_imports(spark, sf_dir):
    """Specifiers of Python and TypeScript modules resolved to files of their repository."""
    return IM.resolve_imports(fx(spark, sf_dir, "fx_module_imports"), fx(spark, sf_dir, "fx_modules"))


@query("resolved_dependents", _RESOLVE_SQL + """
SELECT repo_id, target AS file_path, count(DISTINCT src) AS n_importers FROM hit WHERE target <> src GROUP BY repo_id, target
""")
def resolved_dependents(spark, sf_dir):
    """G5 on resolved edges: how many files import each file directly."""
    edges = IM.resolve_imports(fx(spark, sf_dir, "fx_module_imports"), fx(spark, sf_dir, "fx_modules"))
    return (edges.where(F.col("target").isNotNull() & (F.col("target") != F.col("src")))
                 .groupBy("repo_id", F.col("target").alias("file_path")).agg(F.countDistinct("src").alias("n_importers")))
