"""Unified-diff operators.

Partitioning: every step is keyed by the file (``id_cols``). The caller's
file table is hash-partitioned on the file key once (``by_file``); the
exploded diff lines, their windows, the ranges and the overlap join then
reuse that partitioning, so one shuffle of the file rows serves the whole
pipeline. A window partition holds the lines of one diff, which is bounded by
one input row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

# Fixed value: hunk header pattern (new-file start in group 1).
HUNK_HEADER = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
# Consecutive changed lines at most this far apart merge into one range.
RANGE_GAP = 2


def by_file(files: DataFrame, id_cols: list[str], num_partitions: int | None = None) -> DataFrame:
    """Hash-partition the file rows on the file key (one shuffle for the pipeline)."""
    if num_partitions:
        return files.repartition(num_partitions, *id_cols)
    return files.repartition(*id_cols)


def diff_lines(files: DataFrame, id_cols: list[str], diff_col: str = "diff") -> DataFrame:
    """Explode a diff into (ids, idx, line) with its line kind and line number.

    ``line_no`` follows the reference's counter: a hunk header sets it, an
    added line records and advances, a deleted line records without advancing,
    any other line advances only when the counter is above 0 (i.e. the hunk
    starts above 0 or an addition was seen in the segment). ``---``/``+++``
    lines count as context.
    """
    x = files.select(*id_cols, F.posexplode(F.split(F.col(diff_col), "\n")).alias("idx", "line"))
    hdr = F.regexp_extract("line", HUNK_HEADER, 1)
    x = x.select(*id_cols, "idx", "line",
                 F.when(hdr != "", hdr.cast("bigint")).alias("_hstart"),
                 (F.col("line").startswith("+") & ~F.col("line").startswith("+++")).alias("is_add"),
                 (F.col("line").startswith("-") & ~F.col("line").startswith("---")).alias("is_del"))
    x = x.withColumn("is_header", F.col("_hstart").isNotNull())
    w_file = Window.partitionBy(*id_cols).orderBy("idx")
    x = x.withColumn("seg", F.sum(F.col("is_header").cast("int")).over(w_file))
    w_seg = Window.partitionBy(*id_cols, "seg").orderBy("idx")
    before = w_seg.rowsBetween(Window.unboundedPreceding, -1)
    x = (x.withColumn("_start", F.coalesce(F.first("_hstart").over(w_seg), F.lit(0)))
          .withColumn("_add_before", F.coalesce(F.max(F.col("is_add").cast("int")).over(before), F.lit(0)) > 0))
    is_ctx = ~F.col("is_header") & ~F.col("is_add") & ~F.col("is_del")
    adv = F.col("is_add") | (is_ctx & ((F.col("_start") > 0) | F.col("_add_before")))
    x = x.withColumn("_adv", adv.cast("bigint"))
    x = x.withColumn("line_no", F.col("_start") + F.coalesce(F.sum("_adv").over(before), F.lit(0)))
    return x.drop("_hstart", "_add_before", "_adv")


def changed_lines(files: DataFrame, id_cols: list[str], diff_col: str = "diff") -> DataFrame:
    """(ids, idx, line_no) of every added or deleted line, in diff order."""
    x = diff_lines(files, id_cols, diff_col)
    return x.where(F.col("is_add") | F.col("is_del")).select(*id_cols, "idx", "line_no")


def changed_ranges(changed: DataFrame, id_cols: list[str]) -> DataFrame:
    """Merge changed lines (encounter order) into ranges; a line more than
    two past the previous changed line opens a new range. A range runs from
    its first to its last line (which need not be the min and max)."""
    w = Window.partitionBy(*id_cols).orderBy("idx")
    x = changed.withColumn("_prev", F.lag("line_no").over(w))
    x = x.withColumn("_new", (F.col("_prev").isNull() | (F.col("line_no") > F.col("_prev") + RANGE_GAP)).cast("int"))
    x = x.withColumn("range_idx", F.sum("_new").over(w))
    return (x.groupBy(*id_cols, "range_idx")
             .agg(F.min_by("line_no", "idx").alias("start_line"),
                  F.max_by("line_no", "idx").alias("end_line")))


def overlap_functions(ranges: DataFrame, blocks: DataFrame, id_cols: list[str],
                      dedupe: str = "name") -> DataFrame:
    """Functions whose lines overlap a changed range.

    ``dedupe='name'`` keeps the reference's rule: one function per name per
    file, the first by (range order, function order); ``'position'`` keeps
    every overlapping function once.
    """
    r = ranges.select(*id_cols, "range_idx", F.col("start_line").alias("_rs"), F.col("end_line").alias("_re"))
    j = r.join(blocks, id_cols).where((F.col("_rs") <= F.col("end_line")) & (F.col("_re") >= F.col("start_line")))
    part = [*id_cols, "name"] if dedupe == "name" else [*id_cols, "func_idx"]
    w = Window.partitionBy(*part).orderBy("range_idx", "func_idx")
    return (j.withColumn("_k", F.row_number().over(w)).where("_k = 1")
             .drop("_k", "_rs", "_re", "range_idx"))


def changed_functions(files: DataFrame, id_cols: list[str], *, path_col: str = "file_path",
                      diff_col: str = "diff", content_col: str = "file_content",
                      dedupe: str = "name", blocks: DataFrame | None = None) -> DataFrame:
    """(ids, function_name, start_line, end_line, new_body, language) of the
    functions a diff changed. Files of unsupported languages give nothing."""
    from .blocks import function_blocks

    supported = files.where(S.detect_language(path_col).isNotNull())
    ranges = changed_ranges(changed_lines(supported, id_cols, diff_col), id_cols)
    if blocks is None:
        blocks = function_blocks(supported, id_cols, path_col=path_col, content_col=content_col, keep=(path_col,))
    hit = overlap_functions(ranges, blocks, id_cols, dedupe)
    keep = list(dict.fromkeys([*id_cols, path_col]))      # the path may be one of the ids
    if path_col not in hit.columns:
        hit = hit.join(supported.select(*keep), id_cols)
    return (hit.select(*keep, F.col("name").alias("function_name"), "start_line", "end_line",
                       F.col("body").alias("new_body"), "func_idx",
                       F.coalesce(S.detect_language(path_col), F.lit("unknown")).alias("language")))


# Fixed patterns of the hunk attribution helper (header with optional context
# name, declaration in a context/added line, new-file start in a header).
HUNK_CTX = r"@@ .+? @@\s*(?:.*?(?:function\s+(\w+)|def\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=))?"
HUNK_DECL = r"^[+ ]\s*(?:async\s+)?(?:function\s+(\w+)|def\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\()"
HUNK_START = r"@@ .+?\+(\d+)"


def _first_group(col, pattern: str, n: int):
    parts = [F.regexp_extract(col, pattern, i) for i in range(1, n + 1)]
    return F.coalesce(*[F.when(p != "", p) for p in parts])


def hunk_attribution(files: DataFrame, id_cols: list[str], path_col: str = "file_path",
                     diff_col: str = "diff") -> DataFrame:
    """Attribute the added lines of a diff to function names (the reference
    defines this for its CLI but never calls it).

    A line containing ``@@ .. @@`` opens a segment named by its context
    (``function f``, ``def f``, ``const f =``); a declaration in a context or
    added line renames the segment (the last one wins). A named segment with
    added lines yields (name, added code, start = header's new-file line,
    end = index of the next header or the line count). A file that yields none
    but has added lines gives one entry named after the file's base name.
    Returns (ids, seg, name, start_line, end_line, n_added, code).
    """
    keep = [*id_cols, path_col]
    x = files.select(*keep, F.posexplode(F.split(F.col(diff_col), "\n")).alias("idx", "line"))
    is_hdr = F.col("line").rlike(HUNK_CTX)
    x = x.select(*keep, "idx", "line", is_hdr.alias("is_hdr"),
                 F.when(is_hdr, _first_group(F.col("line"), HUNK_CTX, 3)).alias("hdr_name"),
                 F.when(is_hdr, F.coalesce(F.regexp_extract("line", HUNK_START, 1).try_cast("int"), F.lit(0)))
                  .alias("hdr_start"),
                 F.when(~is_hdr, _first_group(F.col("line"), HUNK_DECL, 3)).alias("decl"),
                 (~is_hdr & F.col("line").startswith("+") & ~F.col("line").startswith("+++")).alias("added"),
                 F.col("line").startswith("+").alias("plus"))
    w = Window.partitionBy(*id_cols).orderBy("idx")
    x = x.withColumn("seg", F.sum(F.col("is_hdr").cast("int")).over(w))
    segs = x.groupBy(*keep, "seg").agg(
        F.max(F.when(F.col("decl").isNotNull(), F.struct("idx", "decl"))).alias("_d"),
        F.max("hdr_name").alias("hdr_name"),
        F.coalesce(F.max("hdr_start"), F.lit(0)).alias("start_line"),
        (F.max("idx") + 1).alias("end_line"),
        F.sort_array(F.collect_list(F.when(F.col("added"), F.struct("idx", F.expr("substring(line, 2)")
                                                                           .alias("t"))))).alias("_a"))
    segs = segs.select(*keep, "seg", F.coalesce(F.col("_d.decl"), F.col("hdr_name")).alias("name"),
                       "start_line", "end_line", F.size("_a").alias("n_added"),
                       F.array_join(F.col("_a.t"), "\n").alias("code"))
    named = segs.where(F.col("name").isNotNull() & (F.col("n_added") > 0))
    # files with no named segment: one entry under the file's base name
    per_file = x.groupBy(*keep).agg(
        F.max(F.col("plus").cast("int")).alias("_plus"),
        F.sort_array(F.collect_list(F.when(F.col("line").startswith("+") & ~F.col("line").startswith("+++"),
                                           F.struct("idx", F.expr("substring(line, 2)").alias("t"))))).alias("_a"))
    base = F.regexp_extract(path_col, r"([^/]+)$", 1)
    stem = F.when(F.instr(F.substring(base, 2, 1 << 30), ".") > 0,
                  F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)
    fallback = (per_file.join(named.select(*id_cols).distinct(), id_cols, "left_anti")
                        .where((F.col("_plus") == 1) & (F.size("_a") > 0))
                        .select(*keep, F.lit(-1).cast("bigint").alias("seg"), stem.alias("name"),
                                F.lit(1).alias("start_line"), F.size("_a").cast("bigint").alias("end_line"),
                                F.size("_a").alias("n_added"), F.array_join(F.col("_a.t"), "\n").alias("code")))
    cols = [*id_cols, "seg", "name", "start_line", "end_line", "n_added", "code"]
    return named.select(*cols).unionByName(fallback.select(*cols))
