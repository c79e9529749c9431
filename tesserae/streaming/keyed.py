"""A table of rows by key that micro-batches keep up to date: buckets of a hash of the key, each replaced whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    """The Hadoop path and its file system: the folder may be in any store that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _files(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    where, fs = _files(spark, path)
    fs.delete(where, True)


class KeyedTable:
    """Rows of ``schema`` (DDL) by ``keys`` below ``path``; the number of buckets is fixed when the table is made.

    A merge reads the buckets of the keys that it touches, and no others, and writes each anew, so the table is as large
    as its rows and not as its history. The new buckets are dealt and written beside the table first, each in one file,
    and then put in the place of the old ones, file by file as they lie, by dynamic partition overwrite. A batch that failed while they were being put there finds
    them complete and puts them there again; so a batch has effect once, however often it runs. Readers between two
    merges see whole batches; one that reads during a merge may see some buckets before and some after it.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets

    def _bucket(self):
        return F.pmod(F.xxhash64(self.keys[0]), F.lit(self.buckets)).cast("int")

    def _rows(self, path: str) -> DataFrame:
        schema = f"{self.schema}, _row boolean, _bucket int"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        return self._rows(f"{self.path}/rows").where("_row").drop("_row", "_bucket")

    def of(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys, from their buckets alone; ``keys`` has the first key at least."""
        names = [k for k in self.keys if k in keys.columns]
        rows = self._rows(f"{self.path}/rows").where(F.col("_row") & F.col("_bucket").isin(self._touched(keys)))
        return rows.join(keys.select(*names).distinct(), names, "left_semi").drop("_row", "_bucket")

    def _touched(self, keys: DataFrame) -> list[int]:
        return [r[0] for r in keys.select(self._bucket()).distinct().collect()]  # as many as buckets at most

    def merge(self, number: int, rows: DataFrame, touched: DataFrame) -> None:
        """Batch ``number``: what the table has of the keys of ``touched`` is replaced by ``rows``, which may be fewer or none."""
        staged = f"{self.path}/staged-{number}"
        if not exists(self.spark, f"{staged}/_SUCCESS"):
            names = [k for k in self.keys if k in touched.columns]
            keys = touched.select(*names).distinct()
            at = self._touched(keys)
            new = rows.withColumn("_row", F.lit(True)).withColumn("_bucket", self._bucket())
            old = self._rows(f"{self.path}/rows")
            kept = old.where(F.col("_row") & F.col("_bucket").isin(at)).join(keys, names, "left_anti")
            empty = self.spark.createDataFrame([(False, b) for b in at], "_row boolean, _bucket int")  # a bucket that loses its last row is replaced too
            every = kept.select(*old.columns).unionByName(new.select(*old.columns)).unionByName(empty, allowMissingColumns=True)
            every.repartition(max(1, len(at)), "_bucket").write.mode("overwrite").parquet(staged)
        self._rows(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(f"{self.path}/rows")
        if exists(self.spark, f"{self.path}/staged-{number - 1}"):
            delete(self.spark, f"{self.path}/staged-{number - 1}")
