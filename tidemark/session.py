"""Session set-up and the one way this package cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

#: Settings that do not depend on the size of the cluster; partition counts are left to AQE.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[8]", app: str = "tidemark", **extra: str) -> SparkSession:
    """A session for tests and benches; on a cluster, pass the session you have instead."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only where that is unset and the master is a plain local one (tests), a temporary folder."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"tidemark-checkpoint-{os.getuid()}")
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def packaged(spark: SparkSession, folder: str) -> str:
    """The package under ``folder`` as one archive in the shared folder, for executors that don't have it."""
    import io
    import zipfile

    from tidemark.sources.files import Files

    content = io.BytesIO()
    with zipfile.ZipFile(content, "w") as z:
        for root, _, names in sorted(os.walk(os.path.join(folder, "tidemark"))):
            for name in sorted(n for n in names if n.endswith(".py")):
                z.write(os.path.join(root, name), os.path.relpath(os.path.join(root, name), folder))
    path = f"{scratch(spark, 'tidemark')}.zip"
    Files(spark).write_new(path, content.getvalue())
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read on from there.

    Blocks survive the loss of executors, which localCheckpoint's would not. Where the session is set up by ``build_session``, files
    are removed when nothing refers to them any more.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def replicated(df: DataFrame) -> DataFrame:
    """Cache on disk and memory; a lost block is recomputed from its lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
