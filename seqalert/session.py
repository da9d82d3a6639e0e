"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoints go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build(master: str | None = None, name: str = "seqalert", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(shared: str | None, master: str) -> str:
    """The shared folder ``shared``; a private one where none is named and all work is done by this one machine."""
    if shared:
        return shared
    if master.split("[")[0] == "local":
        return tempfile.mkdtemp(prefix="seqalert-checkpoint-")
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(checkpoint_folder(spark.conf.get("spark.checkpoint.dir", None), sc.master))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder, so that later passes read it instead of recomputing it
    and the loss of an executor costs no upstream work."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
