"""Keys that a stream has seen, with values, as a table beside its output.

Each batch adds the folder of its own keys, dealt by a hash of the key, in one write; every so many batches all folders are
merged into a base, from which old keys may be left out. A batch reads the buckets that its own keys fall in, of the last base and
the folders after it. A repeated batch finds what it found before and replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

BUCKET, EPOCH = "key_bucket", "key_epoch"


def delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def ensure(spark: SparkSession, path: str) -> str:
    """Makes the folder of a table that may have no rows yet; unlike an empty write, this may happen while others write below it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
    return path


class KeyTable:
    """Rows (key, values) below `path`; `keep` says which rows a new base takes over."""

    def __init__(self, spark: SparkSession, path: str, fields: list[StructField], buckets: int = 64, every: int = 32, keep: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.path, self.buckets, self.every, self.keep = spark, path, buckets, every, keep
        self.fields = fields
        self.key = fields[0].name
        self.schema = StructType([*fields, StructField(EPOCH, IntegerType()), StructField(BUCKET, IntegerType())])

    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _read(self, kind: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(ensure(self.spark, f"{self.path}/{kind}"))

    def _before(self, number: int, base: int) -> DataFrame:
        old = self._read("base").where(F.col(EPOCH) == base)
        return old.unionByName(self._read("new").where((F.col(EPOCH) >= base) & (F.col(EPOCH) < number)))

    def known(self, number: int, keys: DataFrame) -> DataFrame:
        """What earlier batches know of the buckets of `keys`."""
        base = number // self.every * self.every
        if base == number > 0:
            merged = self._before(number, number - self.every)
            merged = self.keep(merged) if self.keep else merged
            merged.drop(EPOCH).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/base/{EPOCH}={number}")
            # folders that only batches before the last base would need
            delete(self.spark, f"{self.path}/base/{EPOCH}={number - 2 * self.every}")
            for k in range(number - 2 * self.every, number - self.every):
                delete(self.spark, f"{self.path}/new/{EPOCH}={k}")
        touched = [r[0] for r in keys.select(self.bucket()).distinct().collect()]  # `buckets` at most
        return self._before(number, base).where(F.col(BUCKET).isin(touched)).select(*(f.name for f in self.fields))

    def add(self, number: int, rows: DataFrame) -> None:
        """The batch's new keys; one write for all buckets."""
        rows.select(*(f.name for f in self.fields)).withColumn(BUCKET, self.bucket()).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/new/{EPOCH}={number}")
