"""Tables that several stages read, written below the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where all runs on this machine and none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
    return folder.rstrip("/")


def written(rows: DataFrame, tag: str) -> DataFrame:
    """Rows written to the shared folder and read back: worked out once, whatever reads them."""
    path = f"{shared_dir(rows.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
