"""Import specifiers resolved to files."""

from __future__ import annotations

from riskloom.operators import graph as G
from riskloom.operators import imports as IM

FILES = ["web/a/x.ts", "web/a/index.tsx", "web/b/y.js", "web/b/y.ts", "web/top.ts", "src/lib/z.tsx", "pkg/core/util.py", "pkg/core/__init__.py", "pkg/util.py", "util.py",
         "pkg/core/deep/n.py", "index.js", "web/a/x"]
CASES = [("web/b/y.js", "../a/x", "web/a/x"), ("web/b/y.js", "../a", "web/a/index.tsx"), ("web/b/y.js", "./y", "web/b/y.ts"), ("web/b/y.js", "../top.js", "web/top.ts"),
         ("web/b/y.js", "./y.js", "web/b/y.js"), ("web/b/y.js", "@/lib/z", "src/lib/z.tsx"), ("web/b/y.js", "react", None), ("web/b/y.js", "../../../x", None), ("web/b/y.js", "../..", "index.js"),
         ("web/b/y.js", "", "index.js"), ("web/b/y.js", None, None), ("pkg/core/deep/n.py", "util", "pkg/core/util.py"), ("pkg/core/deep/n.py", "pkg.util", "pkg/util.py"),
         ("pkg/core/deep/n.py", "..util", "pkg/core/util.py"), ("pkg/core/deep/n.py", "...util", "pkg/util.py"), ("pkg/core/deep/n.py", "..", "pkg/core/__init__.py"),
         ("pkg/core/deep/n.py", "......x", None), ("pkg/core/deep/n.py", "os.path", None), ("util.py", "pkg.core", "pkg/core/__init__.py"), ("util.py", ".util", "util.py")]


def test_every_rule(spark):
    imports = spark.createDataFrame([("r", s, d) for s, d, _ in CASES] * 2, "repo_id string, src string, dst string")
    files = spark.createDataFrame([("r", f) for f in [*FILES, *FILES, None]] + [("other", "react.ts"), ("other", "os/path.py")], "repo_id string, file_path string")
    got = {(r.src, r.specifier): r.target for r in IM.resolve_imports(imports, files).collect()}
    assert got == {(s, d): t for s, d, t in CASES}
    assert IM.resolve_imports(imports, files.limit(0)).where("target is not null").count() == 0
    assert IM.resolve_imports(imports.limit(0), files).count() == 0


def test_dependents_run_on_resolved_paths(spark):
    imports = spark.createDataFrame([("r", "a/x.ts", "./y"), ("r", "a/y.ts", "../b"), ("r", "a/y.ts", "react")], "repo_id string, src string, dst string")
    files = spark.createDataFrame([("r", f) for f in ("a/x.ts", "a/y.ts", "b/index.ts")], "repo_id string, file_path string")
    raw = {r.file_path: r.blast_radius for r in G.blast_radius_count(imports, keys=["repo_id"]).collect()}
    edges = IM.file_edges(IM.resolve_imports(imports, files))
    resolved = {r.file_path: r.blast_radius for r in G.blast_radius_count(edges, keys=["repo_id"]).collect()}
    assert raw.get("b/index.ts", 0) == 0 and resolved["b/index.ts"] == 2 and resolved["react"] == 2


def test_sketched_radius_of_a_hub_is_within_its_error(spark):
    from pyspark.sql import functions as F

    hub = (spark.range(60_000).select(F.concat(F.lit("a"), "id").alias("src"), F.lit("hub").alias("dst"))
           .unionByName(spark.createDataFrame([("hub", "base"), ("hub", "other"), ("base", "root"), ("root", "hub")], "src string, dst string")))
    got = {r.file_path: r.blast_radius for r in G.blast_radius_estimate(hub).collect()}
    want = {r.file_path: r.blast_radius for r in G.blast_radius_count(hub).collect()}
    assert got.keys() == want.keys() and all(abs(got[f] - n) <= 0.05 * n for f, n in want.items()) and want["root"] > 60_000
