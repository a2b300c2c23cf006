"""Tables between the steps of an operator, in the folder of ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether the shuffle files of a write are deleted when it ends, and rows that go to a Python worker at once.
_CLEANUP, _BATCH = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch"


def write(df: DataFrame, name: str, batch_rows: int = 10_000) -> tuple[DataFrame, str]:
    """``df`` written and read back, and its path; what the write shuffled is deleted when it ends."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        set_later = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not set_later.isDefined():
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = set_later.get()
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in (_CLEANUP, _BATCH)}
    spark.conf.set(_CLEANUP, "true")
    spark.conf.set(_BATCH, batch_rows)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    """Only once nothing that reads the table will run again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
