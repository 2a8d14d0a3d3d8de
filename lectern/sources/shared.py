"""Working tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where none is set and driver and executors are one process, as in tests."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="lectern-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by ``keys`` over all of spark.sql.shuffle.partitions. Partitions asked for by number are not merged again, so a task of what follows holds that share of the rows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """``df`` written once and read from there: for what is read more than once, and to end its lineage."""
    path = f"{shared_dir(df.sparkSession)}/lectern/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
