"""The converters over streams. All are stateless projections, so a streaming frame goes in and comes out."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def run_available(frame: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Applies work to all that a stream has now and appends it to Parquet files, exactly once by the checkpoint."""
    if not frame.isStreaming:
        raise ValueError("a streaming frame is needed")
    return work(frame).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)


#: By application, the folder of a Spark in one process that names none; a running session's setting can't be changed.
OWN: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; a local one only where that is unset and Spark runs in one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="schemaloom-"))
    return found.rstrip("/")
