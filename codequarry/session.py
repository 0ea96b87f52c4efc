"""Session with the settings the operators are designed for."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate files that the session names (``spark.checkpoint.dir``); a local session without one gets its own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def session(master: str | None = None, checkpoint_dir: str | None = None, **conf: str) -> SparkSession:
    """``checkpoint_dir``: a folder that all executors share, for intermediate tables; needed on a cluster that names none."""
    b = SparkSession.builder.appName("codequarry")
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if checkpoint_dir:
        base["spark.checkpoint.dir"] = checkpoint_dir
    return b.config(map=base | conf).getOrCreate()
