"""Session settings and lineage cutting shared by the operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings the catalog jobs expect. They are applied to a builder by the
# caller; library code never changes the settings of a running session.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def with_defaults(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return builder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back from there.

    The folder is the one the session names in ``spark.checkpoint.dir``. In
    local mode a temporary folder is used when none is named; on a cluster that
    would not be visible to other machines, so the setting is required there.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
            folder = tempfile.mkdtemp(prefix="fotolake-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
