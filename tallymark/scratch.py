"""Written tables that cut a plan: in the folder that driver and executors share, so lost executors cost a reread only."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset and the master is local (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _FALLBACK.setdefault("root", tempfile.mkdtemp(prefix="tallymark-tables-"))
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written once and read back, and the path of the table."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tallymark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Delete a written table that no returned plan reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
