"""Session settings the operators are tuned for.

Nothing here is needed for correctness: a caller may hand any session to any
operator.  On a cluster set ``spark.checkpoint.dir`` to a folder every executor
can reach; see :mod:`quadrille.plans.staging`.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "quadrille", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    master = master or os.environ.get("SPARK_MASTER")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
