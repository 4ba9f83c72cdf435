"""Session construction and cluster-safe checkpoint handling."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Defaults applied only when building a new session; a cluster's own settings win.
_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app_name: str = "shelfscope",
                conf: dict[str, str] | None = None) -> SparkSession:
    """Return the active session or build one with shelfscope's defaults.

    ``master`` is only for local runs (tests, bench); on a cluster leave it
    unset so that spark-submit decides.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**_DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """The shared folder named by ``spark.checkpoint.dir``.

    A fallback is applied only where the session has none (local tests); a
    cluster's setting is never replaced.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        spark.sparkContext.setCheckpointDir(current)
        return current
    if fallback:
        spark.conf.set("spark.checkpoint.dir", fallback)
        spark.sparkContext.setCheckpointDir(fallback)
        return fallback
    return None
