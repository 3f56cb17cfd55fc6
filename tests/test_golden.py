"""Golden cases derived from reading the reference (FIXTURES.md §3)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from riskloom.functions import scalars as S
from riskloom.operators import diffs as D
from riskloom.operators import graph as G
from riskloom.operators import reverts as RV
from riskloom.operators import blocks as B
from riskloom.streaming import ops as ST

NL = "\n"


def _ranges(spark, diff):
    df = spark.createDataFrame([(1, diff)], "file_id long, diff string")
    lines = D.changed_lines(df, ["file_id"])
    got_lines = [r.line_no for r in lines.orderBy("idx").collect()]
    rng = D.changed_ranges(lines, ["file_id"]).orderBy("range_idx").collect()
    return got_lines, [(r.start_line, r.end_line) for r in rng]


def test_diff_golden_cases(spark):
    g1 = "@@ -1,4 +1,2 @@\n-a\n-b\n-c\n-d\n+x\n+y"
    assert _ranges(spark, g1) == ([1, 1, 1, 1, 1, 2], [(1, 2)])
    assert _ranges(spark, "@@ -3,3 +3,3 @@\n ctx\n-old\n+new\n ctx\n") == ([4, 4], [(4, 4)])
    assert _ranges(spark, "@@ -1,6 +1,6 @@\n+a\n c\n+b\n c\n c\n+d") == ([1, 3, 6], [(1, 3), (6, 6)])
    assert _ranges(spark, "@@ -1,2 +1,1 @@\n--- sql comment\n+x") == ([2], [(2, 2)])
    assert _ranges(spark, "@@ -1,1 +1,2 @@\n+++i;\n+y") == ([2], [(2, 2)])
    assert _ranges(spark, "@@ -5 +5 @@\n-a\n+b") == ([5, 5], [(5, 5)])
    assert _ranges(spark, "+a\n+b") == ([0, 1], [(0, 1)])
    assert _ranges(spark, "-a\n-b") == ([0, 0], [(0, 0)])
    assert _ranges(spark, " a\n b") == ([], [])


def test_overlap_dedupes_by_name(spark):
    blocks = spark.createDataFrame(
        [(1, 0, "a", 1, 3, "", ""), (1, 1, "b", 5, 9, "", ""), (1, 2, "b2", 6, 7, "", ""), (1, 3, "a", 11, 12, "", "")],
        "file_id long, func_idx int, name string, start_line int, end_line int, signature string, body string")
    ranges = spark.createDataFrame([(1, 1, 2, 2), (1, 2, 6, 6), (1, 3, 11, 11)],
                                   "file_id long, range_idx long, start_line long, end_line long")
    got = D.overlap_functions(ranges, blocks, ["file_id"]).orderBy("func_idx").collect()
    assert [(r.name, r.start_line) for r in got] == [("a", 1), ("b", 5), ("b2", 6)]


def _reverted(spark, rows):
    df = spark.createDataFrame([(i, "r", sha, msg) for i, (sha, msg) in enumerate(rows)],
                               "seq long, repo_id string, sha string, message string")
    return sorted(r.sha for r in RV.detect_reverts(df).collect())


def test_revert_golden_cases(spark):
    a, b, c, d = "aaaaaaa1", "bbbbbbb2", "ccccccc3", "ddddddd4"
    assert _reverted(spark, [(a, "fix x"), (b, 'Revert "fix x"')]) == [a]
    assert _reverted(spark, [(a, "fix x"), (b, "Revert aaaaaaa")]) == [a]
    assert _reverted(spark, [(a, "fix x"), (b, "Oops. This reverts commit aaaaaaa1.")]) == [a]
    assert _reverted(spark, [(a, "fix x"), (c, "other"),
                             (b, 'Revert "fix x"\n\nThis reverts commit ccccccc3.')]) == [a]
    assert _reverted(spark, [(a, "fix x"), (c, "fix x"), (b, 'Revert "fix x"')]) == [c]
    assert _reverted(spark, [(b, 'Revert "Revert "fix x""'), (a, 'Revert "fix x"'), (d, "fix x")]) == [a, d]
    # short and empty references match by prefix, as the reference does
    assert _reverted(spark, [(a, "x"), (b, "Revert a")]) == [a]
    assert _reverted(spark, [(a, "x"), (b, 'Revert " "')]) == [a]


def test_relationship_golden_cases(spark):
    py = "import os\nfrom a.b import c\ndef f(x):\n  q(\"SELECT * FROM Users\")"
    js = "fetch(\"https://h/x?y=1\")\ndb.from('likes')\nprisma.post.findMany()"
    df = spark.createDataFrame([(py, "python"), (js, "javascript")], "c string, l string")
    r = df.select(S.extract_relationships("c", "l").alias("r"),
                  S.extract_tables("c", "strict").alias("strict")).collect()
    assert r[0].r.imports == ["a.b", "os"]
    assert r[0].r.function_names == ["f"]
    assert r[0].r.table_usages == ["a", "users"]
    assert r[0].strict == ["users"]
    assert r[0].r.api_calls == []
    assert r[1].r.api_calls == ["https://h/x"]
    assert r[1].r.table_usages == ["likes", "post"]


def test_outcome_and_risk_table(spark):
    rows = [(0.95, True, []), (0.88, False, ["b1"]), (0.99, False, []), (0.99, None, None),
            (0.79, True, []), (0.82, True, [])]
    df = spark.createDataFrame(rows, "s double, rs boolean, bugs array<string>")
    o = S.commit_outcome("rs", "bugs")
    out = df.select(o.alias("o"), F.round(S.risk_score("s", o), 4).alias("risk"),
                    S.is_high_risk("s", o).alias("hr"), S.risk_level("s", o).alias("lvl"),
                    S.fallback_level("s").alias("fb")).collect()
    assert [r.o for r in out] == ["reverted", "bug_linked", "clean", "clean", "reverted", "reverted"]
    assert [r.risk for r in out] == [0.95, 0.704, 0.099, 0.099, 0.79, 0.82]
    assert [r.hr for r in out] == [True, True, False, False, False, True]
    assert out[0].lvl == "HIGH" and out[1].lvl == "MEDIUM" and out[5].lvl == "LOW"
    assert out[0].fb == "HIGH" and out[1].fb == "MEDIUM" and out[5].fb == "MEDIUM"


def test_graph_risk_components(spark):
    uses = spark.createDataFrame([("f1", "t"), ("f2", "t")], "file_path string, table_name string")
    apis = spark.createDataFrame([("f1", "u"), ("f2", "u")], "file_path string, url string")
    mods = spark.createDataFrame([("c1", "f2", True)], "sha string, file_path string, is_reverted boolean")
    imports = spark.createDataFrame([(f"d{i}", "f1") for i in range(4)] + [("d0", "f2"), ("d1", "f2"), ("d2", "f2")],
                                    "src string, dst string")
    r = {x.file_path: x for x in G.graph_risk(uses, apis, mods, imports).collect()}
    assert r["f1"].graph_risk_score == 1.0       # table 0.5 + api 0.3 + 4 dependents 0.2
    assert r["f2"].graph_risk_score == 0.0       # only reverted file itself; exactly 3 dependents add 0
    assert r["f2"].many_dependents is False and r["f1"].many_dependents is True


def test_quota_golden_case(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(1, i, base + dt.timedelta(seconds=s)) for i, s in enumerate([0, 10, 20, 59, 61])]
    df = spark.createDataFrame(rows, "api_key long, event_id long, ts timestamp_ntz")
    out = ST.quota_audit(df, limit=2, window_s=60).orderBy("event_id").collect()
    assert [r.allowed for r in out] == [True, True, False, False, True]
    assert [r.remaining for r in out] == [1, 0, 0, 0, 1]


def test_statistics_levels(spark):
    from riskloom.operators import history as H

    df = spark.createDataFrame([("r", "HIGH", "a"), ("r", "LOW", "b"), ("r", None, "b"), ("r", "OTHER", "c")],
                               "repo_id string, risk_level string, file_path string")
    r = H.warnings_by_risk(df).collect()[0]
    assert (r.n_high, r.n_medium, r.n_low, r.total_warnings) == (1, 0, 1, 2)


def _blocks(spark, code, path):
    """(name, start_line, end_line, body) of one file's functions."""
    df = spark.createDataFrame([(1, path, code)], "id int, file_path string, file_content string")
    return [(r.name, r.start_line, r.end_line, r.body) for r in B.function_blocks(df, ["id"]).orderBy("func_idx").collect()]


def _js(spark, code):
    return [x[:3] for x in _blocks(spark, code, "a.ts")]


def test_python_function_blocks(spark):
    code = "@dec\ndef a(x):\n    def b():\n        return 1\n    return b\n\nasync def c():\n    pass\n"
    got = _blocks(spark, code, "a.py")
    assert [(n, s, e) for n, s, e, _ in got] == [("a", 2, 5), ("b", 3, 4), ("c", 7, 8)]
    assert got[1][3] == "def b():\n        return 1"
    # unparsable code falls back to the indentation scan
    bad = "def ok(a):\n    return a\n\ndef broken(:\n    pass\n"
    assert [n for n, *_ in _blocks(spark, bad, "a.py")] == ["ok", "broken"]


def test_js_function_blocks(spark):
    code = (
        "import x from 'y';\n"
        "function foo(a) {\n  const s = \"}{\";\n  return a;\n}\n"
        "const bar = (b) => {\n  return b * 2; // }\n};\n"
        "class K {\n  method(c) {\n    return `${c}}`;\n  }\n  static async other() { return /}/.test(x); }\n}\n"
        "const inc = x => x + 1;\n"
        "function* gen() { yield 1; }\n"
    )
    got = _js(spark, code)
    assert ("foo", 2, 5) in got
    assert ("bar", 6, 8) in got
    assert ("method", 10, 12) in got
    assert ("other", 13, 13) in got
    assert ("x", 15, 15) in got        # the reference's quirk: a bare parameter names the arrow
    assert all(n != "gen" for n, *_ in got)
    assert _blocks(spark, code, "a.txt") == [] and _blocks(spark, None, "a.ts") == [] and _blocks(spark, "", "a.py") == []


def test_js_types_decorators_and_generics(spark):
    code = ("export const add: Op = (a: number, b: number): number => {\n  return a + b;\n};\n"
            "const f: (a: number) => void = async <T>(x: Map<string, T>) => { x; };\n"
            "@Injectable()\nexport class S {\n  @Input() get<T, U>(k: T): Promise<Map<T, U>> {\n    return g(k);\n  }\n"
            "  @Get('/x')\n  async list(@Query() q: { a: string }): { n: number } {\n    return q\n  }\n"
            "  abstract none(): void;\n  bare = () => 1\n}\n"
            "const a = x => x + 1\nconst b = [1].map(y => y * 2)\nx.y = () => {};\nz = () => ({ k: 1 });\n"
            "if (a) { call(b) }\nconst h = function named(q) { return q }\n")
    assert _js(spark, code) == [("add", 1, 3), ("f", 4, 4), ("get", 7, 9), ("list", 11, 13), ("<anonymous>", 15, 15), ("x", 17, 17), ("y", 18, 18),
                                ("<anonymous>", 19, 19), ("z", 20, 20)]
    bodies = {n: b for n, _, _, b in _blocks(spark, code, "a.ts")}
    assert bodies["x"] == "x => x + 1" and bodies["z"] == "() => ({ k: 1 })" and bodies["f"].startswith("async <T>(x") and bodies["get"].startswith("get<T, U>(k")


def test_python_lines_that_are_not_code(spark):
    code = ('def a(x=(1,\n2)):\n    """doc\nnot dedented\n    """\n    s = "def no():" + \\\n"y"\n# comment at the margin\n    return [\n1]\n    # tail\n\n'
            'class C:\n\tdef m(self):\n\t\tif x:\n\t\t\treturn 1\n\n\tasync def n(self): return 2\nx = 1\ndef last(): pass')
    assert [x[:3] for x in _blocks(spark, code, "a.py")] == [("a", 1, 10), ("m", 14, 16), ("n", 18, 18), ("last", 20, 20)]


def test_many_files_at_once_and_broken_ones(spark):
    rows = [(i, "a.ts" if i % 2 else "a.py", ["function f(a) { return [a] }", "function g( { ) => } ]", "def p():\n  return 1\n", "def q(:\n  x"][i % 4]) for i in range(40)]
    got = B.function_blocks(spark.createDataFrame(rows, "id int, file_path string, file_content string"), ["id"]).collect()
    assert {(r.id % 4, r.name) for r in got} >= {(3, "<anonymous>")} or len(got) >= 10
    assert sum(r.name == "p" for r in got) == 10 and sum(r.name == "q" for r in got) == 0


def test_fence_and_json_parse(spark):
    df = spark.createDataFrame([
        ('```json\n{"risk_level": "high", "explanation": "e"}\n```',),
        ('{"risk_level": "medium"}',),
        ("not json at all",),
        ("```no newline",),
        ("[1, 2]",),
    ], "reply string")
    out = df.select(S.explain_parse("reply", F.lit(0.95), F.lit("reverted")).alias("p")).collect()
    assert out[0].p.risk_level == "HIGH" and out[0].p.explanation == "e"
    assert out[1].p.risk_level == "MEDIUM" and out[1].p.explanation == ""
    assert out[2].p.risk_level == "MEDIUM" and out[2].p.explanation == "not json at all"
    assert out[3].p.risk_level == "HIGH" and out[3].p.explanation.startswith("This code is 95%")
    assert out[4].p.historical_context == "The historical code was reverted."


def test_normalize_repo_id(spark):
    df = spark.createDataFrame([("git@github.com:user/repo.git",), ("https://github.com/user/repo",)], "u string")
    out = df.select(S.normalize_repo_id("u").alias("id"), S.repo_short_name("u").alias("n")).collect()
    assert [r.id for r in out] == ["github.com/user/repo", "github.com/user/repo"]
    assert [r.n for r in out] == ["repo", "repo"]


def test_quota_split_equals_scan_with_one_hot_key(spark):
    from riskloom.plans.fixtures import table

    from conftest import SMALL

    ev = table(spark, SMALL, "events")
    for key in (F.col("user_id"), F.lit(1).cast("long")):   # many keys; one key holding every row
        e = ev.select(key.alias("api_key"), "event_id", "ts")
        for lim, win in ((3, 86400), (1, 600)):
            a = sorted(map(tuple, ST.quota_audit(e, limit=lim, window_s=win, method="scan").collect()))
            b = sorted(map(tuple, ST.quota_audit(e, limit=lim, window_s=win, method="split").collect()))
            assert a == b


def test_hunk_attribution_cases(spark):
    diff = "@@ -1,2 +1,3 @@ function foo() {\n ctx\n+a\n@@ -10 +11,2 @@\n def bar():\n+b\n+c"
    df = spark.createDataFrame([(1, "src/x.js", diff), (2, "lib/y.tar.py", "--- a\n+++ b\n@@ -1 +1 @@\n-z\n+w")],
                               "file_id long, file_path string, diff string")
    got = sorted((r.file_id, r.name, r.start_line, r.end_line, r.code)
                 for r in D.hunk_attribution(df, ["file_id"]).collect())
    assert got == [(1, "bar", 11, 7, "b\nc"), (1, "foo", 1, 3, "a"), (2, "y.tar", 1, 1, "w")]


def test_js_edge_cases(spark):
    nested = "const f = (a) => {\n  return `x ${a ? `y${a}}` : '}'} z`;\n};\nfunction g() { return 1; }\n"
    assert _js(spark, nested) == [("f", 1, 3), ("g", 4, 4)]
    cls = ("class A extends B {\n  static create(x: number): A {\n    return new A();\n  }\n"
           "  handle = () => {\n    this.x = 1;\n  };\n  get name() { return 'a'; }\n}\nconst top = () => 1;\n")
    assert _js(spark, cls) == [
        ("create", 2, 4), ("<anonymous>", 5, 7), ("name", 8, 8), ("top", 10, 10)]
    rx = "function r(s) {\n  return /[}{]/.test(s) ? s.split(/\\//) : s;\n}\nconst k = 1 / 2; const m = (x) => x / 3;\n"
    assert _js(spark, rx) == [("r", 1, 3), ("m", 4, 4)]
    com = "// function fake() {\n/* const no = () => { */\nfunction real(a /* } */) {\n  // }\n  return a;\n}\n"
    assert _js(spark, com) == [("real", 3, 6)]


def test_dependents_exceed_equals_full_count(spark):
    from riskloom.plans.fixtures import fx

    from conftest import MEDIUM

    hub = ([(f"a{i}", "H") for i in range(50)] + [("H", "t1"), ("b1", "t2"), ("b2", "b1"), ("b3", "b2"),
                                                   ("c1", "t3"), ("c2", "t3"), ("c3", "c1"), ("t3", "t3")])
    graphs = [fx(spark, MEDIUM, "fx_imports"), spark.createDataFrame(hub, "src string, dst string")]
    for imports in graphs:
        full = {r.file_path: r.blast_radius > 3 for r in G.blast_radius_count(imports).collect()}
        fast = {r.file_path: r.many for r in G.dependents_exceed(imports, 3).collect()}
        assert fast == full


def test_commit_flag_modes(spark):
    rows = [("r", "c1", "a.py", "import os\n", True, 1), ("r", "c1", "b.py", "import os\n", False, 2)]
    df = spark.createDataFrame(rows, "repo_id string, sha string, file_path string, file_content string, "
                                     "rev boolean, seq long")
    anyf = G.kg_edges(df, reverted_col="rev")["modifies"].select("file_path", "is_reverted").collect()
    last = G.kg_edges(df, reverted_col="rev", flag_mode="ingest", order_col="seq")["modifies"] \
            .select("file_path", "is_reverted").collect()
    assert {r.file_path: r.is_reverted for r in anyf} == {"a.py": True, "b.py": False}
    assert {r.file_path: r.is_reverted for r in last} == {"a.py": False, "b.py": False}


def test_python_regex_semantics(spark):
    df = spark.createDataFrame([("def café(x):\n    return x\n", 'Revert "fix x"\r\n\r\nbody', "  body  ")],
                               "code string, msg string, txt string")
    r = df.select(S.extract_function_names("code", F.lit("python")).alias("fns"),
                  S.revert_ref("msg").alias("ref"),
                  F.regexp_replace("txt", S.PY_RE + r"^\s+|\s+$", "").alias("stripped")).collect()[0]
    assert r.fns == ["café"]                      # \w is Unicode, as in Python
    assert (r.ref.pattern, r.ref.ref) == (1, "fix x")
    assert r.stripped == "body"                   # str.strip() removes no-break spaces too


def test_js_generator_methods_are_methods(spark):
    code = ("class K {\n  *gen() {\n    yield 1;\n  }\n  static async *agen() { yield 2; }\n}\n"
            "function* top() { yield 3; }\nconst o = { *g2() { yield 4; } };\n")
    assert _js(spark, code) == [("gen", 2, 4), ("agen", 5, 5), ("g2", 8, 8)]


def test_commit_log_and_patch_edges(spark):
    from riskloom.sources import commits as SC

    lines = spark.createDataFrame([("abc1234|||fix a|||dev",), ("",), ("   ",), ("|||no sha|||x",),
                                   ("def5678||| a|||b ||| c |||dev2",)], "value string")
    got = [(r.sha, r.message, r.author) for r in SC.parse_commit_log(lines).collect()]
    # a subject holding the separator shifts the fields, as in the reference
    assert got == [("abc1234", "fix a", "dev"), ("def5678", "a", "b")]
    patch = ("diff --git a/x.py b/x.py\n@@ -1 +1 @@\n-a\n+b\n"
             "diff --git a/old.py b/old.py\ndeleted file mode 100644\n--- a/old.py\n+++ /dev/null\n"
             "diff --git a/r.md b/r.md\n@@ -1 +1 @@\n-a\n+b\n"
             "diff --git a/lib/y.rb b/lib/y.rb\n@@ -1 +1 @@\n-a\n+b\n")
    df = spark.createDataFrame([(1, patch)], "seq long, patch string")
    out = [(r.file_path, r.language) for r in SC.split_patch(df).orderBy("chunk_pos").collect()]
    assert out == [("x.py", "python"), ("lib/y.rb", "ruby")]


def test_reply_json_is_strict_like_python(spark):
    df = spark.createDataFrame([('{"risk_level": "HIGH"} trailing',), ("{'risk_level': 'HIGH'}",),
                                ('"just a string"',)], "reply string")
    out = df.select(S.explain_parse("reply", F.lit(0.95), F.lit("reverted")).alias("p")).collect()
    assert out[0].p.risk_level == "MEDIUM" and out[0].p.explanation.startswith('{"risk_level"')   # not JSON
    assert out[1].p.risk_level == "MEDIUM"                                                         # not JSON
    assert out[2].p.historical_context == "The historical code was reverted."                     # JSON, not an object


def test_overlap_position_mode_and_ci_option(spark):
    blocks = spark.createDataFrame(
        [(1, 0, "a", 1, 3, "", ""), (1, 1, "a", 11, 12, "", "")],
        "file_id long, func_idx int, name string, start_line int, end_line int, signature string, body string")
    ranges = spark.createDataFrame([(1, 1, 2, 2), (1, 2, 11, 11)],
                                   "file_id long, range_idx long, start_line long, end_line long")
    by_name = D.overlap_functions(ranges, blocks, ["file_id"]).count()
    by_pos = D.overlap_functions(ranges, blocks, ["file_id"], dedupe="position").count()
    assert (by_name, by_pos) == (1, 2)
    commits = spark.createDataFrame([("r", "abcdef0123", False, [])],
                                    "repo_id string, sha string, revert_status boolean, bug_ids array<string>")
    ci = spark.createDataFrame([("abcdef0123", "build")], "commit_sha string, pipeline string")
    as_ref = RV.apply_ci_failures(commits, ci).first()
    as_bug = RV.apply_ci_failures(commits, ci, ci_as_bug_only=True).first()
    assert as_ref.revert_status is True and as_ref.bug_ids == ["ci:build:abcdef0"]
    assert as_bug.revert_status is False and as_bug.bug_ids == ["ci:build:abcdef0"]
