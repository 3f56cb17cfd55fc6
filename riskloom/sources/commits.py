"""Commit-history sources (S1–S7, S9): raw git output and request bodies -> tables.

Readers take an explicit schema (never inferred); malformed JSON records land
in ``_corrupt_record`` (PERMISSIVE) instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S

# Git log format separator and client limits.
LOG_SEPARATOR = "|||"
MAX_COMMITS = 200
MAX_FILES_PER_COMMIT = 5
MAX_FILE_LINES = 500

FILE_DIFF = T.StructType([T.StructField("file_path", T.StringType()),
                          T.StructField("language", T.StringType()),
                          T.StructField("diff", T.StringType()),
                          T.StructField("file_content", T.StringType())])
BACKFILL_BATCH = T.StructType([
    T.StructField("repo_id", T.StringType()),
    T.StructField("commits", T.ArrayType(T.StructType([
        T.StructField("sha", T.StringType()), T.StructField("message", T.StringType()),
        T.StructField("author", T.StringType()), T.StructField("diffs", T.ArrayType(FILE_DIFF))]))),
    T.StructField("_corrupt_record", T.StringType())])


def parse_commit_log(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """``sha|||subject|||author`` lines -> (sha, message, author).

    Parts are trimmed; empty lines and empty shas are dropped. A subject that
    contains the separator shifts the fields, as in the reference (parts 0-2).
    """
    parts = F.split(F.col(line_col), r"\|\|\|")
    keep = [c for c in lines.columns if c != line_col]
    out = lines.where(F.trim(F.col(line_col)) != "").select(
        *keep, F.trim(F.get(parts, 0)).alias("sha"),
        F.trim(F.coalesce(F.get(parts, 1), F.lit(""))).alias("message"),
        F.trim(F.coalesce(F.get(parts, 2), F.lit(""))).alias("author"))
    return out.where(F.col("sha") != "")


def read_commit_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_commit_log(spark.read.text(path))


def read_backfill_batches(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """S3: backfill request bodies (JSON lines) with an explicit schema."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(BACKFILL_BATCH).option("mode", "PERMISSIVE").json(path)


def explode_commits(batches: DataFrame) -> DataFrame:
    """S3: one row per commit, keeping list order; batches without commits vanish."""
    return batches.select("repo_id", F.posexplode("commits").alias("commit_pos", "c")) \
                  .select("repo_id", "commit_pos", "c.sha", "c.message", "c.author", "c.diffs")


def first_sent(commits: DataFrame, order_col: str) -> DataFrame:
    """One row per (repo_id, sha) of commits that batches sent again, the one of least ``order_col``, without diffs:
    a later copy may hold other files, so those are taken from all copies (``files_of``)."""
    rest = [c for c in commits.columns if c not in ("repo_id", "sha", "diffs")]
    return (commits.groupBy("repo_id", "sha").agg(F.min_by(F.struct(*rest), F.struct(order_col, F.xxhash64(*rest))).alias("c"))
                   .select("repo_id", "sha", "c.*"))


def files_of(commits: DataFrame, order_col: str) -> DataFrame:
    """One row per (repo_id, sha, file_path) over all copies of a commit: of the rows with a diff (else of all) the last
    sent. Commits without any file keep a row without path."""
    files = explode_diffs(commits.select("repo_id", "sha", order_col, "diffs"))
    keys = ("repo_id", "sha", "file_path")
    nth = F.struct(F.coalesce(F.length("diff"), F.lit(0)) > 0, order_col, F.coalesce("file_pos", F.lit(-1)), F.xxhash64("diff", "file_content"))
    return (files.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in files.columns if c not in (*keys, order_col)]), nth).alias("f"))
                 .select(*keys, "f.*"))


def explode_diffs(commits: DataFrame, keep_empty: bool = True) -> DataFrame:
    """S3: one row per file diff; ``keep_empty`` keeps commits without diffs
    (file fields null) so per-commit counters see them."""
    fn = F.posexplode_outer if keep_empty else F.posexplode
    cols = [c for c in commits.columns if c != "diffs"]
    return commits.select(*cols, fn("diffs").alias("file_pos", "d")) \
                  .select(*cols, "file_pos", "d.file_path", "d.language", "d.diff", "d.file_content")


def split_patch(patches: DataFrame, patch_col: str = "patch", profile: str = "cli_commit") -> DataFrame:
    """Whole-commit patch -> one row per supported, non-deleted file."""
    keep = [c for c in patches.columns if c != patch_col]
    x = patches.select(*keep, F.posexplode(F.split(F.col(patch_col), r"(?m)^diff --git ")).alias("chunk_pos", "chunk"))
    x = x.where(F.col("chunk") != "")
    x = x.withColumn("file_path", F.regexp_extract("chunk", r"a/(.+?) b/", 1))
    x = x.withColumn("language", S.detect_language(F.regexp_extract("file_path", r"(\.[^./]*)$", 1), profile))
    return (x.where((F.col("file_path") != "") & F.col("language").isNotNull()
                    & ~F.col("chunk").contains("\ndeleted file mode"))
             .select(*keep, "chunk_pos", "file_path", "language",
                     F.concat(F.lit("diff --git "), F.col("chunk")).alias("diff")))


def cap_files_per_commit(files: DataFrame, n: int | None = MAX_FILES_PER_COMMIT, *, commit_cols=("repo_id", "sha"),
                         order_col: str = "file_idx", path_col: str = "file_path",
                         profile: str = "extension") -> DataFrame:
    """Supported files only, then the first ``n`` per commit in changed-path order (None: all)."""
    if n is None:
        return files.where(S.detect_language(path_col, profile).isNotNull())
    w = Window.partitionBy(*commit_cols).orderBy(order_col)
    return (files.where(S.detect_language(path_col, profile).isNotNull())
                 .withColumn("kept_rank", F.row_number().over(w))
                 .where(F.col("kept_rank") <= n))


def truncate_lines(text, n: int = MAX_FILE_LINES):
    """The first ``n`` lines of a text (Column)."""
    return F.array_join(F.slice(F.split(text, "\n"), 1, n), "\n")


def synthetic_diff(content):
    """An all-added diff for a file without a parent version."""
    lines = F.split(content, "\n")
    return F.concat(F.lit("@@ -0,0 +1,"), F.size(lines).cast("string"), F.lit(" @@\n"),
                    F.array_join(F.transform(lines, lambda l: F.concat(F.lit("+"), l)), "\n"))


def upsert_repositories(existing: DataFrame, incoming_ids: DataFrame, id_col: str = "repo_id") -> DataFrame:
    """Get-or-create by id; new rows get name = last ``/`` segment and a
    deterministic key (sha256 of the id)."""
    new = incoming_ids.select(id_col).distinct().join(existing.select(id_col), id_col, "left_anti")
    new = new.select(F.sha2(F.col(id_col), 256).alias("id"), id_col,
                     S.repo_name_from_id(id_col).alias("name"))
    return existing.select("id", id_col, "name").unionByName(new)
