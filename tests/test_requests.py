"""Explanation requests are chosen before the bodies are joined, and an id may come in several rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from riskloom.functions import scalars as S
from riskloom.plans import catalog
from riskloom.plans import q_text


def _documents(spark, folder, again: bool) -> str:
    text = F.concat(F.expr("CASE WHEN id % 20 = 3 THEN ' ' ELSE '' END"), F.lit("a b c d e f g h "), F.expr("repeat('x ', cast(id % 5 as int))"), (F.col("id") % 3).cast("string"))
    df = spark.range(120).select(F.col("id").alias("doc_id"), text.alias("text"))
    if again:   # other texts of the same ids, one of them null
        df = df.unionByName(df.where("doc_id % 9 = 1").withColumn("text", F.concat("text", F.lit(" ")))).unionByName(
            spark.createDataFrame([(42, None), (None, "a b c")], "doc_id bigint, text string"))
    df.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def _want(spark, folder) -> dict:
    """The same by rows: every warning with every pair of bodies of its ids."""
    rows = [r.asDict() for r in q_text._functions(spark, folder).withColumn("h", S.code_hash("code_body")).collect()]
    by_id: dict = {}
    for r in rows:
        by_id.setdefault(r["seq"], []).append(r)
    hr = q_text.R.high_risk(q_text._ranked(spark, folder)).collect()
    nulls_first = lambda x: (x is not None, x or "")
    out: dict = {}
    for w in hr:
        for a in by_id.get(w.query_seq, ()):
            for b in by_id.get(w.match_seq, ()):
                out.setdefault((a["h"], w.commit_sha), []).append(
                    ((w.query_seq, w.rank, w.score, w.outcome, nulls_first(a["code_body"]), nulls_first(b["code_body"])), w, a, b))
    got = {}
    for key, found in out.items():
        _, w, a, b = min(found, key=lambda x: x[0])
        prompt = S.EXPLAIN_TEMPLATE      # nulls render as empty text
        for name, x in (("pct", f"{round(w.score * 100)}%"), ("outcome", w.outcome), ("function_name", a["function_name"]), ("file_path", a["file_path"]),
                        ("current_code", a["code_body"] or ""), ("historical_code", b["code_body"] or "")):
            prompt = prompt.replace(f"<<{name}>>", x)
        prompt = hashlib.md5(prompt.encode()).hexdigest()
        got[key] = (len(found), prompt)
    return got


def test_requests_are_those_of_the_rows(spark, tmp_path):
    for again in (False, True):
        folder = _documents(spark, tmp_path / str(again), again)
        rows = catalog.QUERIES["explain_requests"](spark, folder).collect()
        got = {(r.code_hash, r.matched_commit_sha): (r.n_warnings, r.prompt_md5) for r in rows}
        assert len(got) == len(rows) > 20 and got == _want(spark, folder)


def test_no_body_is_grouped_with_the_warnings(spark, tmp_path):
    df = catalog.QUERIES["explain_requests"](spark, _documents(spark, tmp_path / "d", False))
    grouped = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [" in x and "min(" in x]
    assert grouped and not any("text#" in x.split("min(")[1] or "code_body#" in x or "cur" in x or "hist" in x for x in grouped)
