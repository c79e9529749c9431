"""Tables written in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str = "table") -> str:
    """A new path below ``spark.checkpoint.dir``; where that is unset, as in tests, a folder of this machine, for a local master alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and the executors share")
        base = "/tmp/tesserae-shared"
    return f"{base.rstrip('/')}/tesserae-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame) -> DataFrame:
    """``df`` written and read back: its lineage ends there, and a lost executor loses none of it."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` written in as many buckets of ``key`` as shuffles have partitions: what joins or groups it by ``key``, however often, has it where it lies.

    A task writes its buckets side by side, which spares it sorting whole rows by bucket.
    """
    spark = df.sparkSession
    name, writers = f"tesserae_{uuid.uuid4().hex}", "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(writers)
    spark.conf.set(writers, "64")
    try:
        df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", folder(spark, "dealt")).saveAsTable(name, format="parquet")
    finally:
        spark.conf.set(writers, before)
    return spark.table(name)
