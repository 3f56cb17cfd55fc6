"""The corpus pipeline on a small folder, stage by stage."""

import random

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _text(n, seed):
    return " ".join(random.Random(seed).choices([f"w{i}" for i in range(700)] + ["the", "of", "and"] * 60, k=n))


def test_every_stage_takes_effect(spark, tmp_path):
    clean = [(i, _text(400, i)) for i in range(20)]
    item = " ".join(_text(400, 77).split()[50:70])
    copy = clean[0][1].split()
    copy[200] = "edited"
    rows = clean + [(100, clean[1][1]), (101, " ".join(copy)), (102, "too short"), (103, "| $$$ ".join(_text(200, 78).split())), (104, None),
                    (105, _text(200, 79) + " " + item + " " + _text(200, 80)), (106, _text(300, 81) + " write to jo@mail1.example.com or jo (at) mail2 (dot) org today")]
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        ids[name] = {r.doc_id for r in docs.collect()}
    assert ids["quality_rules"] == set(range(20)) | {100, 101, 105, 106}
    assert ids["near_duplicates"] == set(range(20)) | {105, 106}
    assert ids["decontamination"] == ids["pii"] == ids["packing"] == set(range(20)) | {106}
    said = spark.read.parquet(f"{tmp_path}/3").where("doc_id = 106").first()
    assert said.text.endswith("write to <EMAIL> or <EMAIL> today") and said.n_chars == len(said.text)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_stages_keep_clashing_columns_and_drop_the_right_rows(spark, tmp_path):
    """Input that is no scan, in other partitions, with columns named like the operators' own."""
    clean = [(i, _text(300, 200 + i)) for i in range(40)]
    rows = clean + [(100 + i, clean[i][1]) for i in range(5)] + [(200, "too short"), (201, None), (202, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), f"r{i}", f"c{i}", i) for i, t in rows], DOCS + ", _row string, _clean string, key long")
    item = " ".join(clean[7][1].split()[30:50])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = docs.where("doc_id >= 0").repartition(5)
    got = dict(corpus_pipeline.STAGES)
    kept = got["quality_rules"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in rows[:45]}
    one = got["near_duplicates"](spark, kept.repartition(3), str(tmp_path))
    assert {r.doc_id for r in one.collect()} == set(range(40))
    left = got["decontamination"](spark, one.repartition(7), str(tmp_path)).collect()
    assert {r.doc_id for r in left} == set(range(40)) - {7} and all((r._row, r._clean, r.key) == (f"r{r.doc_id}", f"c{r.doc_id}", r.doc_id) for r in left)
    mail = docs.limit(3).selectExpr("doc_id", "'write a@b.co' as text", "lang", "source", "n_chars", "_row", "_clean", "key")
    assert {(r.text, r._clean[0], r.n_chars) for r in got["pii"](spark, mail, str(tmp_path)).collect()} == {("write <EMAIL>", "c", 13)}


def test_empty_table_passes_every_stage(spark, tmp_path):
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
