"""Session settings the operators rely on, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Runtime settings; none of them needs a new session.
SETTINGS = {
    # Malformed bytes become U+FFFD instead of failing the task.
    "spark.sql.legacy.codingErrorAction": "true",
    # Pages may come in any of ``config.CHARSETS``.
    "spark.sql.legacy.javaCharsets": "true",
    # JSON objects with a repeated key keep the last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session and hand it back."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it.

    A private folder is made only where ``spark.checkpoint.dir`` is unset and the session is a
    local one, as in tests; on a cluster other machines would not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="sitestance-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made
