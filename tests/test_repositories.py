"""Ids that repeat across repositories stay apart."""

from riskloom.operators import risk as R


def test_matches_stay_in_their_repository(spark):
    rows = [(repo, seq, f"{repo}-s{seq}", "f", f"{repo}.py", [1.0, 0.0], "x") for repo in ("a", "b") for seq in (1, 2, 3)]
    vectors = spark.createDataFrame(rows, "repo_id string, seq long, commit_sha string, function_name string, file_path string, vector array<double>, code_body string")
    commits = spark.createDataFrame([(r[0], r[2], True, []) for r in rows], "repo_id string, sha string, revert_status boolean, bug_ids array<string>")
    ranked = R.rank_matches(vectors, commits)
    got = sorted((r.repo_id, r.query_seq, r.commit_sha) for r in ranked.collect())
    assert got == [(repo, q, f"{repo}-s{m}") for repo in ("a", "b") for q, m in ((2, 1), (3, 1), (3, 2))]
    warned = R.assemble_warnings(ranked, vectors).collect()
    assert len(warned) == 6 and all(r.file_path == f"{r.repo_id}.py" and r.query_sha == f"{r.repo_id}-s{r.query_seq}" for r in warned)
