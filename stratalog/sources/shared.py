"""Tables written to the folder that driver and executors share, which cut the lineage of iterative evaluation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a local session gets an own folder, and a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("stratalog.shared.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="stratalog-")
        spark.conf.set("stratalog.shared.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str = "rows") -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again. It outlives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
