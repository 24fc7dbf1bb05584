"""Where streams keep their checkpoints and results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the folder that driver and executors share (spark.checkpoint.dir); in local mode a temporary one if unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-quantloom-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# A side of a join is broadcast only when its counted rows times its row width stay below this.
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, marked for broadcast if its counted size is below BROADCAST_BYTES; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: what is used twice is made once, and a lost executor costs no recomputation."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
