"""Helpers that several operators share: reading tables, Arrow batches, word hashes, staging."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.functions.names import fresh  # noqa: F401 (the operators take it from here)

#: Bytes of text that the vectorised helpers take at a time; their scratch arrays are about 60 times that.
CHUNK = 1 << 19
#: The doc of a null doc_id: the least integer, so that null comes first.
NONE = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which every executor sees; without that setting there is none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/loomwork-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again, which cuts its lineage durably."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what `staged` wrote, once everything that reads it has been staged itself."""
    for f in frames:
        if path := getattr(f, "_staged_at", None):
            jvm = f.sparkSession.sparkContext._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(f.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def text_hash(column: str = "text"):
    """64 bits that tell the texts of equal doc_ids apart; null is the empty text."""
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


def identified(docs: DataFrame) -> DataFrame:
    """(doc, twin, bytes, doc_id): integers that order the documents, the text, and the id as it is.

    doc is an integer doc_id itself. Ids of other types are numbered in their order, by a range sort of the
    distinct ids and the sizes of the partitions before; null is the least. twin is the text's whole hash.
    """
    ids = docs.select("doc_id", text_hash().alias("twin"), utf8().alias("bytes"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("doc"), "twin", "bytes", "doc_id")
    dealt = staged(docs.select("doc_id").where("doc_id is not null").distinct().repartitionByRange("doc_id").select("doc_id", F.spark_partition_id().alias("part")))
    # one row for each partition
    starts = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("doc_id")).cast("long")
    numbers = dealt.join(F.broadcast(starts), "part").select(F.col("doc_id").alias("id"), (F.col("start") + place).alias("doc"))
    return ids.join(numbers, F.col("doc_id") == F.col("id"), "left").select(F.coalesce("doc", F.lit(NONE)).alias("doc"), "twin", "bytes", "doc_id")


def utf8(column: str = "text"):
    """The column as UTF-8 bytes; null becomes empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def groups_of(values: list[bytes], limit: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, values) in runs of about `limit` bytes."""
    start, size = 0, 0
    for i, v in enumerate(values):
        size += len(v) + 1
        if size >= limit:
            yield start, values[start : i + 1]
            start, size = i + 1, 0
    if start < len(values):
        yield start, values[start:]


#: Lower-cases A-Z and turns what is neither a-z, 0-9 nor above ASCII into spaces.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: Lower-cases A-Z and turns the six ASCII white-space bytes into spaces.
SPACED = bytes(b + 32 if 65 <= b <= 90 else 32 if b in b"\t\n\x0b\x0c\r " else b for b in range(256))

_ODD = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK * 2)
        inverse = pow(_ODD, -1, 1 << 64)
        _powers[:] = [
            np.concatenate([[np.uint64(1)], np.full(size - 1, base, np.uint64)]).cumprod(dtype=np.uint64)
            for base in (_ODD, inverse)
        ]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Polynomial hashes modulo 2^64 have known equal strings from about 1,000 bytes on; longer words are hashed by BLAKE2.
LONG = 512


class Words:
    """The words of several texts: hash, byte span in the joined buffer, and bounds per text."""

    def __init__(self, texts: list[bytes], folding: bytes):
        self.buffer = b" ".join(texts).translate(folding) + b" "
        raw = np.frombuffer(self.buffer, np.uint8)
        solid = np.empty(len(raw) + 1, np.int8)
        solid[0] = 0
        np.not_equal(raw, 32, out=solid[1:].view(bool))
        edge = np.flatnonzero(np.diff(solid))
        self.start, self.end = edge[0::2], edge[1::2]
        power, inverse = _power_tables(len(raw) + 1)
        total = np.empty(len(raw) + 1, np.uint64)
        total[0] = 0
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
        self._total, self._inverse = total, inverse
        self.hash = self._spans(self.start, self.end)
        for k in np.flatnonzero(self.end - self.start > LONG).tolist():
            word = hashlib.blake2b(self.buffer[self.start[k] : self.end[k]], digest_size=8).digest()
            self.hash[k] = np.frombuffer(word, np.uint64)[0]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.offset = np.concatenate([[0], lengths.cumsum()])
        self.bounds = np.searchsorted(self.start, self.offset)

    def _spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._total[end] - self._total[start]) * self._inverse[start] + (end - start).astype(np.uint64))

    def beginnings(self, which: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the first n bytes of some words, which have as many; marked apart from whole words."""
        start = self.start[which]
        return self._spans(start, start + n) ^ np.uint64(0x5BD1E995)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n consecutive words; fewer words make one shingle, no words none."""
    if not len(words):
        return words
    n, out = min(n, len(words)), np.zeros(max(1, len(words) - min(n, len(words)) + 1), np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + len(out)]
    return mix(out + np.uint64(n))


def record_batch(columns: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def replace_text(batch: pa.RecordBatch, texts: list[str | None], keep: list[bool] | None = None) -> pa.RecordBatch:
    """The batch with another text, and with n_chars where it has that column."""
    for name, values in (("text", texts), ("n_chars", [None if t is None else len(t) for t in texts])):
        if (k := batch.schema.get_field_index(name)) >= 0:
            batch = batch.set_column(k, batch.schema.field(k), pa.array(values, batch.schema.field(k).type))
    return batch if keep is None else batch.filter(pa.array(keep, pa.bool_()))


#: Rows that functions over whole documents take at a time, which bounds their lists and scratch arrays.
ROWS = 2000


def sliced(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows; memory that a part has freed goes back to the system."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
        trim()


def trim() -> None:
    """Returns freed memory, which a reused worker would otherwise hold through later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """A string column's values as UTF-8; null becomes empty."""
    values = batch.column(batch.schema.get_field_index(column))
    return [x or b"" for x in values.cast(pa.binary()).to_pylist()]


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished steps: it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Rolling:
    """Hashes of any spans of a buffer."""

    def __init__(self, buffer: np.ndarray):
        power, self._inverse = _power_tables(len(buffer) + 1)
        self._total = np.empty(len(buffer) + 1, np.uint64)
        self._total[0] = 0
        np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * power[: len(buffer)], out=self._total[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._total[end] - self._total[start]) * self._inverse[start] + (end - start).astype(np.uint64))

    def every(self, n: int) -> np.ndarray:
        """Hashes of the n bytes from each place that has as many."""
        k = len(self._total) - n
        return mix((self._total[n:] - self._total[:k]) * self._inverse[:k] + np.uint64(n))
