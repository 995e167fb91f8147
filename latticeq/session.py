"""Session factory. On a cluster, the submitting tool's own settings win."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def make_session(app: str = "latticeq", cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the operators are written for: ANSI, AQE, Arrow, UTC."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    builder = SparkSession.builder.appName(app).master(f"local[{cpus}]")
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.executorEnv.OMP_NUM_THREADS": "1",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
