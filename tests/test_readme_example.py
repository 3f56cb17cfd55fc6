"""The usage example in README.md runs (on the fixture tables)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from riskloom.plans.fixtures import fx

from conftest import ROOT, SMALL


def test_readme_example_runs(spark):
    src = open(os.path.join(ROOT, "README.md")).read()
    start = src.index("```python\nfrom pyspark.sql import SparkSession") + len("```python\n")
    code = src[start:src.index("```", start)]
    # the example's three input lines read a cluster's tables; feed the fixtures instead
    code = (code.replace("spark = SparkSession.builder.getOrCreate()", "pass")
                .replace('files = spark.read.parquet(".../file_diffs")', "pass")
                .replace('commits = spark.read.parquet(".../commits")', "pass"))
    scope = {"spark": spark,
             "files": fx(spark, SMALL, "fx_file_diffs").withColumn("seq", F.col("file_id")),
             "commits": fx(spark, SMALL, "fx_commits")}
    exec(code, scope)  # noqa: S102 - the documented example itself
    assert scope["ranked"].count() > 0
    assert scope["warnings"].count() >= 0
