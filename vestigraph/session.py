"""Session set-up."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

#: The folder that holds the package.
ROOT = str(Path(__file__).resolve().parent.parent)
#: Bytes of an Arrow batch, as rows can be as large as a block of an index.
BATCH_BYTES, _BATCH = 16 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
_shipped: set[str] = set()


def build(app: str = "vestigraph", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; partitions are sized by the data, not by a constant."""
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", **conf}
    builder = SparkSession.builder.appName(app)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Gives Python workers this package: by its path in local mode and where all machines see it, and as a file on a cluster, once for each session."""
    context = spark.sparkContext
    env = context.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])
    if not context.master.startswith("local") and context.applicationId not in _shipped:
        folder = tempfile.mkdtemp(prefix="vestigraph-")
        context.addPyFile(shutil.make_archive(f"{folder}/vestigraph_package", "zip", ROOT, "vestigraph"))
        _shipped.add(context.applicationId)
    if not context.getConf().contains(_BATCH):
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder that driver and executors share. Where none is named, only local mode may use a temporary one: on a cluster each executor would write to its own disk."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    top = top or "file://" + tempfile.mkdtemp(prefix="vestigraph-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
