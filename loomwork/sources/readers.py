"""Sources: files, JSON lines, indexes, CSV, texts and path lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loomwork.functions.text import extension


#: Bytes of a file beyond which its head is read without the rest: the source of whole files would hold all of it in a task.
LARGE = 1 << 24
HEAD = 4096


def scan_files(spark: SparkSession, roots: list[str], large: int = LARGE) -> DataFrame:
    """root_rank, path, modified, bytes, head (4 KB) and content of the files below the roots; hidden ones are left out.

    Not selecting head and content prunes the bytes from the scan. Heads of files of more than `large` bytes are read by the driver, as no
    source of Spark reads a part of a file; without the content, memory holds no such file.
    """
    out = None
    for rank, root in enumerate(roots):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        files = files.where(~F.regexp_extract("path", r"([^/]*)$", 1).rlike(r"^[.~]|\.(partial|tmp)$"))
        # the source leaves files out by their length before it reads them
        heads = [(r.path, head(spark, r.path)) for r in files.where(F.col("length") > large).select("path").toLocalIterator()]
        beyond = files.where(F.col("length") > large).join(spark.createDataFrame(heads, "path string, head binary"), "path")
        every = files.where(F.col("length") <= large).withColumn("head", F.substring("content", 1, HEAD)).unionByName(beyond)
        one = every.select(F.lit(rank).alias("root_rank"), "path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"), "head", "content")
        out = one if out is None else out.unionByName(one)
    return out


def head(spark: SparkSession, path: str) -> bytes:
    """The first bytes of a file that has as many, in any store of Spark."""
    jvm, file = spark.sparkContext._jvm, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(file)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, HEAD))
    finally:
        stream.close()


def read_records(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines) of a JSON-lines file."""
    kept = StructType([*schema.fields, StructField("_bad", StringType())])
    rows = spark.read.schema(kept).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    # Spark refuses to read the bad column alone, so the lines are read as text for it
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = lines.withColumn("r", F.from_json("value", kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return rows.where("_bad is null").drop("_bad"), parsed.where("r._bad is not null").select("value")


def read_index(spark: SparkSession, path: str, schema: StructType, key: str) -> DataFrame:
    """Rows of a JSON array; a malformed file fails the load, rows without a key are left out."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).where(F.col(key).isNotNull())


def read_verdicts(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def capped(rows: DataFrame, cap: int | None = None) -> DataFrame:
    """rows with `truncated`, and texts of cap characters at most; without a cap nothing is cut."""
    if cap is None:
        return rows.withColumn("truncated", F.lit(False))
    return rows.withColumn("truncated", F.length("text") > cap).withColumn("text", F.substring("text", 1, cap))


def charset(content: Column) -> Column:
    """UTF-8, UTF-16LE, UTF-16BE or ISO-8859-1, by byte order mark, noughts beside letters, and whether the bytes are UTF-8."""
    h = F.hex(F.substring(content, F.lit(1), F.lit(4)))
    return (
        F.when(F.startswith(h, F.lit("FFFE")) | h.rlike("^(?!00)..00(?!00)..00$"), "UTF-16LE")
        .when(F.startswith(h, F.lit("FEFF")) | h.rlike("^00(?!00)..00(?!00)..$"), "UTF-16BE")
        .when(F.is_valid_utf8(content.cast("string")), "UTF-8")
        .otherwise("ISO-8859-1")
    )


def decoded(content: Column, named: Column) -> Column:
    """Bytes in one of these character sets as text, without a byte order mark; any bytes have a text.

    In UTF-16 a last odd byte is left out, and halves of pairs that stand alone become U+FFFD.
    """
    h = F.hex(content)
    big = F.when(named == "UTF-16LE", F.regexp_replace(h, "(..)(..)", "$2$1")).otherwise(h)
    units = F.regexp_replace(F.substring(big, F.lit(1), F.length(big) - F.length(big) % 4), "(....)", "$1 ")
    whole = F.regexp_replace(F.regexp_replace(units, "D[89AB].. (?!D[C-F])", "FFFD "), "(?<!D[89AB].. )D[C-F].. ", "FFFD ")
    wide = F.decode(F.unhex(F.replace(whole, F.lit(" "), F.lit(""))), "UTF-16BE")
    text = F.when(named == "ISO-8859-1", F.decode(content, "ISO-8859-1")).when(named == "UTF-8", content.cast("string")).otherwise(wide)
    return F.regexp_replace(text, "^\ufeff", "")


def read_texts(spark: SparkSession, path: str, cap: int | None = None, allowed: list[str] | None = None) -> DataFrame:
    """path, text, truncated and charset of whole files, of some extensions if given.

    With a cap only the bytes that its characters can take are decoded. Files without any byte are left out, as Spark's source does.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.where(extension(F.col("path")).isin(allowed)) if allowed else files
    held, more = F.col("content"), F.lit(False)
    if cap is not None:
        # four bytes hold a character, and four the mark; a character that is cut off by this is beyond the cap
        room = 4 * cap + 4
        head = F.substring(held, F.lit(1), F.lit(room))
        cut = F.length(F.regexp_extract(F.hex(head), "([CD].|E.(?:[89AB].)?|F[0-7](?:[89AB].){0,2})$", 1)) / 2
        more = F.col("length") > room
        held = F.when(more & F.is_valid_utf8(F.substring(head, F.lit(1), (room - cut).cast("int")).cast("string")), F.substring(head, F.lit(1), (room - cut).cast("int"))).otherwise(head)
    rows = rows.select("path", held.alias("content"), more.alias("more")).withColumn("charset", charset(F.col("content")))
    rows = capped(rows.withColumn("text", decoded(F.col("content"), F.col("charset"))), cap)
    return rows.select("path", "text", (F.col("truncated") | F.col("more")).alias("truncated"), "charset")


def read_path_list(spark: SparkSession, path: str, allowed: list[str]) -> DataFrame:
    """Distinct paths of a list whose extension is allowed."""
    rows = spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''").distinct()
    return rows.where(extension(F.col("path")).isin(allowed))


def with_metadata(rows: DataFrame, column: str, review: bool = False) -> DataFrame:
    """rows with engine, passes and pages of a JSON text, with review its document type and review keys too.

    Malformed text gives nulls and the row stays.
    """
    v = F.try_parse_json(F.col(column))
    return rows.select(
        *rows.columns,
        F.try_variant_get(v, "$.engine", "string").alias("engine"),
        F.try_variant_get(v, "$.passes", "int").alias("passes"),
        F.try_variant_get(v, "$.pages", "int").alias("pages"),
        *([F.try_variant_get(v, "$.documentType", "string").alias("document_type"), F.try_variant_get(v, "$.review.keys", "array<string>").alias("review_keys")] if review else []),
    )
