"""End to end through the job entry points: backfill, outcome events, analyze, read paths."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from riskloom.plans import jobs as J
from riskloom.plans.fixtures import fx

from conftest import SMALL


def _batches(files, sha_expr):
    """Backfill bodies: one row per repository with its commits and their file diffs."""
    f = files.withColumn("sha", sha_expr)
    per_commit = (f.groupBy("repo_id", "sha")
                   .agg(F.sort_array(F.collect_list(F.struct("file_idx", "file_path", F.lit("python").alias("language"),
                                                             "diff", "file_content"))).alias("d"))
                   .select("repo_id", "sha", F.concat(F.lit("change "), F.substring("sha", 1, 8)).alias("message"),
                           F.lit("dev@example.org").alias("author"),
                           F.transform("d", lambda s: s.dropFields("file_idx")).alias("diffs")))
    return (per_commit.groupBy("repo_id")
                      .agg(F.sort_array(F.collect_list(F.struct("sha", "message", "author", "diffs"))).alias("commits")))


def test_backfill_events_analyze_and_reads(spark):
    store = tempfile.mkdtemp(prefix="rl-store-")
    files = fx(spark, SMALL, "fx_file_diffs")
    summary = J.backfill(spark, _batches(files, F.col("sha")), store).collect()
    assert sum(r.functions_embedded for r in summary) > 0

    # every stored commit gets a revert event, so matches against them are risky
    commits = spark.read.parquet(f"{store}/commits").select("sha").distinct()
    events = commits.select(F.monotonically_increasing_id().alias("event_id"),
                            F.current_timestamp().cast("timestamp_ntz").alias("ts"), F.lit("revert").alias("kind"),
                            F.col("sha").alias("commit_sha"), F.lit("").alias("pipeline"), F.lit(False).alias("merged"), F.lit(True).alias("closed"))
    J.record_outcome_events(events, store)

    # the same files committed again under new shas: every changed function has a stored twin
    new = (_batches(files, F.md5(F.concat(F.lit("n"), F.col("sha"))))
           .select("repo_id", F.posexplode("commits").alias("seq", "c"))
           .select("repo_id", "seq", F.col("c.sha").alias("commit_sha"), "c.author", "c.message", "c.diffs"))
    warns = J.analyze(spark, new, store).collect()
    assert len(warns) > 0
    assert all(w.outcome == "reverted" and w.similarity_score >= 0.8 for w in warns)
    assert {w.risk_level for w in warns} <= {"HIGH", "MEDIUM", "LOW"}
    assert all(1 <= w.start_line <= w.end_line and w.matched_author and w.matched_message for w in warns)

    repos = spark.read.parquet(f"{store}/repositories")
    assert repos.count() == repos.select("repo_id").distinct().count() == files.select("repo_id").distinct().count()

    page = J.history_page(spark, store).collect()
    assert 0 < len(page) <= 20 * 4
    stats = {r.repo_id: r for r in J.statistics(spark, store).collect()}
    assert sum(r.total_warnings for r in stats.values()) == len(warns)
    risk = J.dependency_risk(spark, store).collect()
    assert len(risk) > 0 and all(0.0 <= r.graph_risk_score <= 1.0 for r in risk)
    assert J.blast_radius(spark, store).count() >= 0


def test_commits_sent_again_count_once(spark):
    once, twice = tempfile.mkdtemp(prefix="rl-once-"), tempfile.mkdtemp(prefix="rl-twice-")
    batches = _batches(fx(spark, SMALL, "fx_file_diffs"), F.col("sha"))
    doubled = batches.withColumn("commits", F.transform("commits", lambda c: c.withField("diffs", F.concat(c["diffs"], c["diffs"]))))
    want = {tuple(r) for r in J.backfill(spark, batches, once).collect()}
    assert {tuple(r) for r in J.backfill(spark, batches.unionByName(doubled), twice).collect()} == want
    count = lambda store, name: spark.read.parquet(f"{store}/{name}").count()
    assert all(count(once, t) == count(twice, t) > 0 for t in ("vectors", "commits"))


def test_push_reverts_dates_and_functions_without_words(spark):
    store = tempfile.mkdtemp(prefix="rl-push-")
    body = "def f_{0}(a):\n    total = a + {0}\n    return total\n\ndef g():\n    return 1\n"
    diff = "@@ -1,3 +1,6 @@\n+def f(a):\n+    total = a\n+    return total\n+\n+def g():\n+    return 1\n"
    batch = lambda sha, i: spark.createDataFrame([("r", sha, "dev", f"change {i}", i, [("a.py", "python", diff, body.format(i)), ("b.ts", "typescript", diff, "const _ = () => {}\n" * 2)])],
                                                 "repo_id string, commit_sha string, author string, message string, seq long, diffs array<struct<file_path string, language string, diff string, file_content string>>")
    assert J.analyze(spark, batch("a" * 40, 1), store).count() == 0
    push = spark.createDataFrame([(1, None, "push", None, None, False, False, [("b" * 40, "This reverts commit " + "a" * 40)])],
                                 "event_id long, ts timestamp_ntz, kind string, commit_sha string, pipeline string, merged boolean, closed boolean, push_commits array<struct<id string, message string>>")
    J.record_outcome_events(push, store)
    by = {search: J.analyze(spark, batch(c * 40, i), store, search=search).collect() for c, i, search in (("c", 2, "index"), ("d", 3, "exact"))}
    assert all(len(w) > 0 and all(x.outcome == "reverted" and x.matched_date is not None and x.matched_commit_sha == "a" * 40 for x in w) for w in by.values())
    assert J.statistics(spark, store).first().duplicate_clusters >= 1


def test_files_of_a_commit_sent_in_parts_are_united(spark):
    store = tempfile.mkdtemp(prefix="rl-parts-")
    diff, code = "@@ -0,0 +1,2 @@\n+def f():\n+    return 1\n", "def {}():\n    return one\n"
    row = lambda files: ("r", [("a" * 40, "m", "dev", [(p, "python", d, code.format(p[0])) for p, d in files])])
    sent = [row([]), row([("x.py", diff)]), row([("y.py", diff), ("x.py", "")])]
    schema = "repo_id string, commits array<struct<sha string, message string, author string, diffs array<struct<file_path string, language string, diff string, file_content string>>>>"
    got = J.backfill(spark, spark.createDataFrame(sent, schema), store).first()
    assert (got.commits_with_diffs, got.commits_skipped, got.functions_embedded) == (1, 0, 2)
    assert {r.file_path for r in spark.read.parquet(f"{store}/vectors").collect()} == {"x.py", "y.py"}
