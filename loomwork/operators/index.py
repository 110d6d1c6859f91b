"""Inverted index over texts and values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions.text import words


def postings(df: DataFrame, key: str, column: str) -> DataFrame:
    """token, key, n: one row for each token of each row. Long posting lists stay rows, spread over tasks."""
    return df.where(F.col(column).isNotNull()).select(key, F.explode(words(F.col(column))).alias("token")).groupBy("token", key).agg(F.count("*").alias("n"))


def token_counts(post: DataFrame) -> DataFrame:
    return post.groupBy("token").agg(F.count("*").alias("documents"), F.sum("n").alias("occurrences"))


def find_all(post: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """Keys that have every term."""
    asked = sorted({t.lower() for t in terms})
    return post.where(F.col("token").isin(asked)).groupBy(key).agg(F.count_distinct("token").alias("hits")).where(F.col("hits") == len(asked)).select(key)


BUCKET = "token_bucket"


def write_index(df: DataFrame, key: str, columns: list[str], path: str, buckets: int = 256) -> None:
    """Postings of several columns as a table: field, token, key, n, in folders by a hash of the token, sorted by token.

    Ranges of bucket, token and key are dealt to tasks, so the rows of a frequent token are spread over several files of its folder.
    """
    each = [postings(df, key, c).select(F.lit(c).alias("field"), "token", F.col(key).alias("key"), "n") for c in columns]
    rows = reduce(DataFrame.unionByName, each).withColumn(BUCKET, bucket(F.col("token"), buckets))
    rows.repartitionByRange(BUCKET, "token", "key").sortWithinPartitions(BUCKET, "token", "field").write.partitionBy(BUCKET).parquet(path)


def bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def lookup(spark: SparkSession, path: str, terms: list[str], fields: list[str] | None = None, buckets: int = 256) -> DataFrame:
    """Postings of some terms: only their folders are read, and of these the row groups that can hold them."""
    asked = sorted({t.lower() for t in terms})
    folders = [r[0] for r in spark.createDataFrame([(t,) for t in asked], "token string").select(bucket(F.col("token"), buckets)).distinct().collect()]
    rows = spark.read.parquet(path).where(F.col(BUCKET).isin(folders) & F.col("token").isin(asked))
    return (rows.where(F.col("field").isin(fields)) if fields else rows).drop(BUCKET)


def find_in(spark: SparkSession, path: str, terms: list[str], fields: list[str] | None = None, buckets: int = 256) -> DataFrame:
    """Keys of a written index that have every term, in any of the fields."""
    return find_all(lookup(spark, path, terms, fields, buckets), "key", terms)
