"""Session builder with the settings the engine relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "slidelake", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with AQE on; a cluster's own settings win over the defaults here.

    master: only set when the environment (spark-submit) has not chosen one.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.ui.enabled": os.environ.get("SLIDELAKE_UI", "false"),
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that all executors share: spark.checkpoint.dir.

    Only a local session, as in tests, may go without that setting and gets a folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all its executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="slidelake-"))
    return sc.getCheckpointDir()
