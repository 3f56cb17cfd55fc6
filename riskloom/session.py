"""Session helpers.

The library never creates its own session inside an operator; these helpers
are for tests, the bench and command-line use. On a cluster the session comes
from the platform and ``checkpoint_dir`` reads ``spark.checkpoint.dir`` from it.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

# Settings that matter at scale, applied on top of whatever the cluster sets.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Arrow batches for applyInPandas / mapInPandas: bounded per batch.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "riskloom", extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench (UI off, UTC, AQE on)."""
    ckpt = os.environ.get("RISKLOOM_CHECKPOINT_DIR") or tempfile.mkdtemp(
        prefix="riskloom-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.checkpoint.dir", ckpt)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
    )
    for k, v in {**SCALE_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder the cluster names in spark.checkpoint.dir.

    Only when the setting is unset (local tests) a fresh scratch folder is
    made and set; on a cluster the shared folder from the session is used.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        # Unset in a local session (tests): take a fresh scratch folder.
        current = tempfile.mkdtemp(prefix="riskloom-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def read_if_written(spark: SparkSession, path: str):
    """The table at ``path``, or None where none has been written; any other error is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def materialize(df):
    """Write ``df`` once to the session's checkpoint folder and read it back.

    Used where one computed table (e.g. freshly embedded vectors) feeds
    several consumers of a plan: the checkpoint is reliable (survives executor
    loss) and cuts the lineage, so the consumers scan files instead of
    re-running the computation.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
