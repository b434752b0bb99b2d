"""Where intermediate files go: below spark.checkpoint.dir, which all machines share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: list[str] = []


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path, which is removed when the driver ends.

    Only where the setting is absent and all runs on one machine (tests) a temporary folder
    is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="tessera-"))
        base = _OWN[0]
    path = f"{base.rstrip('/')}/tessera/{tag}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "*")
        system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for found in system.globStatus(where) or ():  # callers may have added a suffix
            system.delete(found.getPath(), True)
    except Exception:  # the session has already ended
        pass
