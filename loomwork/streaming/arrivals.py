"""Files that arrive in a folder: each is claimed once, when it has not changed for some seconds.

A stream's file source takes a path when it first lists it, so a filter after it would lose what is still being written. Here each poll
lists the folder anew and compares it with the claims of earlier polls: a fresh file is left where it is and found by a later poll. A file
that changes after its claim is another arrival. Claims are a table with a folder for each poll, and the source of the streams that follow.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomwork.streaming.keytable import ensure

CLAIMS = "path string, modified timestamp, bytes long, poll int"
#: Names of files that are hidden or not complete.
UNFINISHED = r"^[.~]|\.(part|partial|tmp|crdownload)$"


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, modified, bytes of the files below a folder; contents are not read. No folder has no files; files without any byte are left out."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "path string, modified timestamp, bytes long")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
    return rows.where(~F.regexp_extract("path", r"([^/]*)$", 1).rlike(UNFINISHED))


def claims(spark: SparkSession, place: str) -> DataFrame:
    """All claims so far."""
    return spark.read.schema(CLAIMS).parquet(ensure(spark, f"{place}/claims"))


def poll(spark: SparkSession, path: str, place: str, number: int, seconds: int = 10, now: datetime | None = None) -> DataFrame:
    """Claims of this poll, the number-th: files whose last change is at least `seconds` before now and that no earlier poll claimed.

    A poll that is repeated under its number replaces its own claims.
    """
    at = F.current_timestamp() if now is None else F.lit(now)
    before = claims(spark, place).where(F.col("poll") < number).select("path", "modified")
    settled = listing(spark, path).where(F.col("modified") <= at - F.make_interval(secs=F.lit(seconds)))
    settled.join(before, ["path", "modified"], "left_anti").select("path", "modified", "bytes").write.mode("overwrite").parquet(f"{place}/claims/poll={number}")
    return claims(spark, place).where(F.col("poll") == number)


def start_intake(spark: SparkSession, path: str, place: str, seconds: int = 10, every: str = "10 seconds") -> StreamingQuery:
    """Polls a folder again and again; the number of a poll is that of the batch, which the checkpoint keeps."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    sink = ticks.writeStream.foreachBatch(lambda batch, number: poll(batch.sparkSession, path, place, number, seconds) and None)
    return sink.option("checkpointLocation", f"{place}/polls").trigger(processingTime=every).start()


def claimed_stream(spark: SparkSession, place: str, per_trigger: int = 1000) -> DataFrame:
    """The claims as a stream: path, modified, bytes, poll."""
    return spark.readStream.schema(CLAIMS).option("maxFilesPerTrigger", per_trigger).parquet(f"{place}/claims")


def contents(claimed: DataFrame, path: str) -> DataFrame:
    """The claims of a batch with the content and sha256 of their files, which are read by the executors."""
    files = claimed.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    same = files.select("path", F.col("modificationTime").alias("modified"), "content")
    return claimed.join(same, ["path", "modified"]).withColumn("sha256", F.sha2("content", 256))
