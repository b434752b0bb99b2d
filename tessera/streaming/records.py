"""The same decoding over streams: layouts are columns, so they need no change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.layout import Layout
from tessera.sources.framing import frame


def stream_records(spark: SparkSession, path: str, layout: Layout, recfm: str = "F", lrecl: int | None = None) -> DataFrame:
    """Decoded records of files as they arrive below path."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    size_of = layout.sizer if recfm.upper() == "N" else None
    return frame(files, recfm, lrecl or (layout.size if recfm.upper() in ("F", "FB") else None), size_of).select(*layout.values())
