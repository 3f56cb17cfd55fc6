"""Dependency-graph operators over edge tables.

The graph is a set of edge DataFrames, one per relationship type; node sets
are ``distinct`` projections of them. ``keys`` are the partition columns of
the graph (usually ``["repo_id"]``; empty for a single graph).

Scale notes
-----------
* ``graph_risk`` never forms file x file pairs: "another file modified by a
  reverted commit uses this table" holds iff the set of reverted files of the
  table contains a file other than this one, which a per-table ``min``/``max``
  over reverted files decides; "more than 3 dependents within 3 hops" is
  decided from importer counts without expanding hub files
  (``dependents_exceed``). Cost is linear in the edge tables; a table or file
  used by a third of all files is one partially-aggregated key.
* ``k_hop_dependents`` expands one hop per join and de-duplicates (dependent,
  target) after every hop, so the intermediate never exceeds the distinct
  reachability set of the previous hop.
* The pair-producing detail operators (``shared_reverted_tables/apis``) join
  only against the reverted side, which is small (reverted commits are rare).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def kg_edges(files: DataFrame, *, keys=("repo_id",), sha_col="sha", path_col="file_path",
             content_col="file_content", lang_col="language", reverted_col: str | None = None,
             table_mode: str = "compat", flag_mode: str = "any",
             order_col: str | None = None) -> dict[str, DataFrame]:
    """Relationship extraction per (commit, file) -> deduplicated edge tables.

    Returns {"modifies", "imports", "contains", "uses_table", "calls_api"}.
    A commit's ``is_reverted`` is ``flag_mode='any'`` (monotone OR over all
    writes) or ``'ingest'`` (the last write by ``order_col`` wins, as the
    reference's graph store does).
    """
    keys = list(keys)
    lang = F.col(lang_col) if lang_col in files.columns else S.detect_language(path_col)
    rel = files.select(*keys, sha_col, path_col,
                       *([reverted_col] if reverted_col else []), *([order_col] if order_col else []),
                       S.extract_relationships(F.col(content_col), lang, table_mode).alias("r"))
    flag = F.col(reverted_col) if reverted_col else F.lit(False)
    order = F.col(order_col) if order_col else F.lit(0)
    mods = rel.select(*keys, F.col(sha_col).alias("sha"), F.col(path_col).alias("file_path"),
                      flag.alias("is_reverted"), order.alias("_o"))
    if flag_mode == "ingest":
        last = mods.groupBy(*keys, "sha").agg(F.max_by("is_reverted", "_o").alias("_last"))
        modifies = (mods.select(*keys, "sha", "file_path").distinct().join(last, [*keys, "sha"])
                        .withColumnRenamed("_last", "is_reverted"))
    else:
        modifies = mods.groupBy(*keys, "sha", "file_path").agg(F.bool_or("is_reverted").alias("is_reverted"))

    def edge(arr, a, b):
        return (rel.select(*keys, F.col(path_col).alias(a), F.explode(f"r.{arr}").alias(b))
                   .dropDuplicates([*keys, a, b]))

    return {
        "modifies": modifies,
        "imports": edge("imports", "src", "dst"),
        "contains": edge("function_names", "file_path", "function_name"),
        "uses_table": edge("table_usages", "file_path", "table_name"),
        "calls_api": edge("api_calls", "file_path", "url"),
    }


def reverted_files(modifies: DataFrame, keys=()) -> DataFrame:
    """(keys, file_path, sha) of files modified by a reverted commit."""
    return modifies.where("is_reverted").select(*keys, "file_path", "sha").distinct()


def shared_reverted(uses: DataFrame, modifies: DataFrame, item_col: str, keys=(), commits: bool = True) -> DataFrame:
    """Distinct (keys, file, item, other file, reverted sha) where the
    other file uses the same item, is not the file, and a reverted commit
    modified it. Without ``commits`` the sha is left out, and an other file
    counts once however many reverted commits modified it.

    Both sides of the join are distinct first, so it makes no row twice."""
    keys = list(keys)
    sha = ["reverted_sha"] if commits else []
    uses = uses.select(*keys, "file_path", item_col).distinct()
    reverted = (reverted_files(modifies, keys).withColumnRenamed("file_path", "other_file")
                .withColumnRenamed("sha", "reverted_sha").select(*keys, "other_file", *sha).distinct())
    rev = uses.withColumnRenamed("file_path", "other_file").join(reverted, [*keys, "other_file"])
    return (uses.join(rev, [*keys, item_col]).where(F.col("file_path") != F.col("other_file"))
                .select(*keys, "file_path", item_col, "other_file", *sha))


def shared_groups(uses: DataFrame, modifies: DataFrame, item_col: str, keys=()) -> DataFrame:
    """G2/G3/J7 factorised: a row per use, (keys, item, file, reverted commits of the file), with the item's number
    of files and of reverted ones. As many rows as uses; ``shared_of`` makes the pairs of the files asked for."""
    keys = list(keys)
    per_file = reverted_files(modifies, keys).groupBy(*keys, "file_path").agg(F.count(F.lit(1)).alias("n_reverted_commits"))
    x = (uses.select(*keys, item_col, "file_path").distinct().join(per_file, [*keys, "file_path"], "left")
             .withColumn("n_reverted_commits", F.coalesce("n_reverted_commits", F.lit(0))))
    sizes = x.groupBy(*keys, item_col).agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("n_reverted_commits") > 0).alias("n_reverted_files"))
    return x.join(sizes, [*keys, item_col]).select(*keys, item_col, "file_path", "n_reverted_commits", "n_files", "n_reverted_files")


def shared_of(groups: DataFrame, files: DataFrame, item_col: str, keys=()) -> DataFrame:
    """(keys, file, item, other file): the reverted files that share an item with one of ``files`` (keys, file_path)."""
    keys = list(keys)
    asked = groups.where(F.col("n_reverted_files") > 0).join(files.select(*keys, "file_path").distinct(), [*keys, "file_path"], "left_semi")
    other = groups.where(F.col("n_reverted_commits") > 0).select(*keys, item_col, F.col("file_path").alias("other_file"))
    return asked.select(*keys, item_col, "file_path").join(other, [*keys, item_col]).where(F.col("file_path") != F.col("other_file"))


def shared_item_flags(uses: DataFrame, modifies: DataFrame, item_col: str, keys=()) -> DataFrame:
    """Per file: does some other reverted-modified file use one of its items?
    Linear min/max rewrite of ``shared_reverted`` (no file x file pairs)."""
    keys = list(keys)
    rev = reverted_files(modifies, keys).select(*keys, "file_path").distinct()
    per_item = (uses.join(rev, [*keys, "file_path"])
                    .groupBy(*keys, item_col)
                    .agg(F.min("file_path").alias("_lo"), F.max("file_path").alias("_hi")))
    return (uses.join(per_item, [*keys, item_col])
                .groupBy(*keys, "file_path")
                .agg(F.bool_or((F.col("_lo") != F.col("file_path")) | (F.col("_hi") != F.col("file_path")))
                     .alias("shared")))


def k_hop_dependents(imports: DataFrame, max_hops: int = 3, min_hops: int = 1, keys=(),
                     src_col="src", dst_col="dst") -> DataFrame:
    """(keys, file_path, dependent, hop) for dependents reaching the file
    through 1..max_hops import edges (a file in a cycle may depend on itself).
    ``hop`` is the shortest such length within [min_hops, max_hops]."""
    keys = list(keys)
    e = imports.select(*keys, F.col(src_col).alias("dependent"), F.col(dst_col).alias("via")).distinct()
    frontier = e.select(*keys, F.col("via").alias("file_path"), "dependent").distinct()
    levels = [frontier.withColumn("hop", F.lit(1))]
    for hop in range(2, max_hops + 1):
        frontier = (frontier.withColumnRenamed("dependent", "via")
                            .join(e, [*keys, "via"])
                            .select(*keys, "file_path", "dependent").distinct())
        levels.append(frontier.withColumn("hop", F.lit(hop)))
    allh = reduce(DataFrame.unionByName, levels)
    allh = allh.where(F.col("hop") >= min_hops)
    return allh.groupBy(*keys, "file_path", "dependent").agg(F.min("hop").alias("hop"))


def blast_radius_count(imports: DataFrame, keys=(), max_hops: int = 3) -> DataFrame:
    """Number of distinct dependents within ``max_hops`` per file."""
    d = k_hop_dependents(imports, max_hops, keys=keys)
    return d.groupBy(*keys, "file_path").agg(F.count(F.lit(1)).alias("blast_radius"))


def blast_radius_estimate(imports: DataFrame, keys=(), max_hops: int = 3, lg_k: int = 12, src_col="src", dst_col="dst") -> DataFrame:
    """G4/G7 without the reachability sets: a file's dependents within h hops are its importers and theirs within
    h - 1, and HyperLogLog sketches of such sets merge. Each hop is one join of the edges with a sketch per file, so a
    hub costs one sketch per edge instead of its dependents. Small sets (some hundreds at ``lg_k`` 12) are counted
    exactly, for others the standard error is 1.04 / sqrt(2^lg_k); ``blast_radius_count`` gives exact counts."""
    keys = list(keys)
    e = imports.select(*keys, F.col(src_col).alias("dep"), F.col(dst_col).alias("x")).distinct()
    direct = e.groupBy(*keys, "x").agg(F.hll_sketch_agg("dep", F.lit(lg_k)).alias("s"))
    reach = direct
    for _ in range(max_hops - 1):
        further = e.join(reach.withColumnRenamed("x", "dep"), [*keys, "dep"]).select(*keys, "x", "s")
        reach = direct.unionByName(further).groupBy(*keys, "x").agg(F.hll_union_agg("s").alias("s"))
    return reach.select(*keys, F.col("x").alias("file_path"), F.hll_sketch_estimate("s").alias("blast_radius"))


def dependents_exceed(imports: DataFrame, n: int = 3, max_hops: int = 3, keys=(),
                      src_col="src", dst_col="dst") -> DataFrame:
    """(keys, file_path, many): does the file have more than ``n`` distinct
    dependents within ``max_hops`` import edges? Exact, without building the
    reachability sets of hub files.

    Every node's direct importer count c(x) is one aggregate. A file with
    c(f) > n is decided at once. Otherwise its dependents are expanded hop by
    hop, never through a node x with c(x) > n: such a node alone gives the
    next hop more than n dependents, so its file is decided. Each expansion
    step therefore adds at most n rows per frontier row.
    """
    keys = list(keys)
    e = imports.select(*keys, F.col(src_col).alias("dep"), F.col(dst_col).alias("x")).distinct()
    cnt = e.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("_c"))
    small = cnt.where(F.col("_c") <= n).select(*keys, "x")          # nodes safe to expand
    hot_nodes = cnt.where(F.col("_c") > n).select(*keys, "x")
    # hop 1: files with at most n importers keep their importers as the frontier
    frontier = (e.join(small, [*keys, "x"], "left_semi")
                 .select(*keys, F.col("x").alias("file_path"), F.col("dep").alias("x")))
    seen, hot = [frontier], [hot_nodes.withColumnRenamed("x", "file_path")]
    for _ in range(2, max_hops + 1):
        hot.append(frontier.join(hot_nodes, [*keys, "x"], "left_semi").select(*keys, "file_path"))
        frontier = (frontier.join(small, [*keys, "x"], "left_semi")
                            .join(e, [*keys, "x"])
                            .select(*keys, "file_path", F.col("dep").alias("x")).distinct())
        seen.append(frontier)
    hot_files = reduce(DataFrame.unionByName, hot).distinct().withColumn("many", F.lit(True))
    counted = (reduce(DataFrame.unionByName, seen).distinct()
               .groupBy(*keys, "file_path").agg((F.count(F.lit(1)) > n).alias("_m")))
    return (counted.join(hot_files, [*keys, "file_path"], "full")
                   .select(*keys, "file_path", (F.coalesce("many", F.lit(False)) | F.coalesce("_m", F.lit(False)))
                           .alias("many")))


def direct_dependents(imports: DataFrame, contains: DataFrame, keys=(),
                      src_col="src", dst_col="dst") -> DataFrame:
    """(keys, file_path, dependent, functions) — every direct importer
    with the sorted distinct functions of the imported file (all of them, as
    the reference lists them; empty when the file has none)."""
    keys = list(keys)
    fns = (contains.groupBy(*keys, "file_path")
                   .agg(F.array_sort(F.collect_set("function_name")).alias("functions")))
    d = imports.select(*keys, F.col(dst_col).alias("file_path"), F.col(src_col).alias("dependent")).distinct()
    return (d.join(fns, [*keys, "file_path"], "left")
             .withColumn("functions", F.coalesce("functions", F.array().cast("array<string>"))))


def indirect_dependents(imports: DataFrame, keys=(), src_col="src", dst_col="dst") -> DataFrame:
    """Dependents over paths of exactly 2..3 edges that do not import
    the file directly."""
    keys = list(keys)
    e = imports.select(*keys, F.col(src_col).alias("dependent"), F.col(dst_col).alias("via")).distinct()
    p1 = e.select(*keys, F.col("via").alias("file_path"), "dependent")
    p2 = (p1.withColumnRenamed("dependent", "via").join(e, [*keys, "via"])
            .select(*keys, "file_path", "dependent").distinct())
    p3 = (p2.withColumnRenamed("dependent", "via").join(e, [*keys, "via"])
            .select(*keys, "file_path", "dependent").distinct())
    return p2.unionByName(p3).distinct().join(p1, [*keys, "file_path", "dependent"], "left_anti")


def graph_risk(uses_table: DataFrame, calls_api: DataFrame, modifies: DataFrame,
               imports: DataFrame, files: DataFrame | None = None, keys=()) -> DataFrame:
    """min(1, 0.5·shared table + 0.3·shared API + 0.2·[blast radius > 3]) per file.

    All three flags are linear in the edge tables: the table/API flags use
    per-item min/max over reverted files, and the blast-radius flag uses
    ``dependents_exceed``, which never builds a hub file's dependent set
    (``blast_radius_count`` gives the full counts when they are wanted)."""
    keys = list(keys)
    t = shared_item_flags(uses_table, modifies, "table_name", keys).withColumnRenamed("shared", "shares_table")
    a = shared_item_flags(calls_api, modifies, "url", keys).withColumnRenamed("shared", "shares_api")
    b = dependents_exceed(imports, 3, keys=keys).withColumnRenamed("many", "many_dependents")
    if files is None:
        parts = [uses_table.select(*keys, "file_path"), calls_api.select(*keys, "file_path"),
                 modifies.select(*keys, "file_path"),
                 imports.select(*keys, F.col("src").alias("file_path")),
                 imports.select(*keys, F.col("dst").alias("file_path"))]
        files = reduce(DataFrame.unionByName, parts).distinct()
    r = (files.join(t, [*keys, "file_path"], "left").join(a, [*keys, "file_path"], "left")
              .join(b, [*keys, "file_path"], "left"))
    st = F.coalesce("shares_table", F.lit(False))
    sa = F.coalesce("shares_api", F.lit(False))
    md = F.coalesce("many_dependents", F.lit(False))
    score = (F.when(st, 0.5).otherwise(0.0) + F.when(sa, 0.3).otherwise(0.0)
             + F.when(md, 0.2).otherwise(0.0))
    return r.select(*keys, "file_path", st.alias("shares_table"), sa.alias("shares_api"),
                    md.alias("many_dependents"),
                    F.round(F.least(F.lit(1.0), score), 4).alias("graph_risk_score"))


# Files of one list of an item's reverted users; a hot item has many lists.
LIST_ROWS = 1024


def reverted_neighbors(uses_table: DataFrame, modifies: DataFrame, keys=()) -> DataFrame:
    """Per file, sorted distinct labels ``other (commit sha7)`` of reverted
    files that share a table with it.

    A table's reverted users go to its users as lists of bounded length, not as
    a row per (file, table, other file, commit): a file's lists meet in one
    place, where an other file that shares many tables with it is kept once
    before its commits are looked up."""
    keys = list(keys)
    uses = uses_table.select(*keys, "file_path", "table_name").distinct()
    commits = reverted_files(modifies, keys).withColumnRenamed("file_path", "other_file")
    theirs = uses.withColumnRenamed("file_path", "other_file").join(commits.select(*keys, "other_file").distinct(), [*keys, "other_file"])
    place = F.row_number().over(Window.partitionBy(*keys, "table_name").orderBy("other_file"))
    lists = (theirs.withColumn("_list", F.floor((place - 1) / LIST_ROWS)).groupBy(*keys, "table_name", "_list")
                   .agg(F.collect_list("other_file").alias("_others")))
    pairs = (uses.join(lists, [*keys, "table_name"]).select(*keys, "file_path", "_others").repartition(*keys, "file_path")
                 .select(*keys, "file_path", F.explode("_others").alias("other_file")).where(F.col("file_path") != F.col("other_file")).distinct())
    lbl = F.concat(F.col("other_file"), F.lit(" (commit "), S.short_sha("sha"), F.lit(")"))
    d = pairs.join(commits, [*keys, "other_file"]).select(*keys, "file_path", lbl.alias("_label")).repartition(*keys, "file_path")
    return d.groupBy(*keys, "file_path").agg(F.array_sort(F.collect_set("_label")).alias("neighbors"))


def graph_stats(edges: dict[str, DataFrame], keys=()) -> DataFrame:
    """True node counts (files incl. import targets, functions, tables, commits)."""
    keys = list(keys)
    g = keys or ["_g"]

    def k(df):
        return df if keys else df.withColumn("_g", F.lit(0))

    files = reduce(DataFrame.unionByName, [
        edges["modifies"].select(*keys, "file_path"), edges["uses_table"].select(*keys, "file_path"),
        edges["calls_api"].select(*keys, "file_path"), edges["contains"].select(*keys, "file_path"),
        edges["imports"].select(*keys, F.col("src").alias("file_path")),
        edges["imports"].select(*keys, F.col("dst").alias("file_path"))])
    cnt = [
        k(files).groupBy(*g).agg(F.countDistinct("file_path").alias("files")),
        k(edges["contains"]).groupBy(*g).agg(F.countDistinct("file_path", "function_name").alias("functions")),
        k(edges["uses_table"]).groupBy(*g).agg(F.countDistinct("table_name").alias("tables")),
        k(edges["modifies"]).groupBy(*g).agg(F.countDistinct("sha").alias("commits")),
    ]
    out = reduce(lambda x, y: x.join(y, g, "full"), cnt).fillna(0, ["files", "functions", "tables", "commits"])
    return out if keys else out.drop("_g")
