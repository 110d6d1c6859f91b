"""Queries that write files to the shared folder with the sinks and read them back with the sources."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from loomwork.operators.verify import sniff
from loomwork.plans import views
from loomwork.plans.registry import registry
from loomwork.plans.stream_queries import shared
from loomwork.sources import readers, writers

QUERIES, query = registry()
TURNS = StructType([StructField("conv_id", LongType()), StructField("turn", LongType()), StructField("role", StringType())])


@query()
def src1_file_scan(spark, sf_dir):
    """Files below the table folder; no SQL, since DuckDB sees tables only. Their heads tell that they are Parquet."""
    files = readers.scan_files(spark, [sf_dir])
    return files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "bytes", sniff(F.col("head")).alias("kind"), (F.col("head").substr(1, 4) == F.lit(b"PAR1")).alias("parquet"))


def turns_with_noise(spark, sf_dir):
    """Conversation turns as JSON lines; every line of turn 3 is cut short."""
    path = shared(spark)
    turns = views.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    line = F.to_json(F.struct("conv_id", "turn", "role"))
    writers.write_snapshot(turns.select(F.when(F.col("turn") == 3, F.substring(line, 1, 12)).otherwise(line).alias("value")), path, "text")
    return readers.read_records(spark, path, TURNS)


@query("select conv_id, turn, role from conversations where turn <> 3")
def src2_tolerant_jsonl(spark, sf_dir):
    return turns_with_noise(spark, sf_dir)[0]


@query("select count(*) as bad from conversations where turn = 3")
def src2_bad_lines(spark, sf_dir):
    return turns_with_noise(spark, sf_dir)[1].agg(F.count("*").alias("bad"))


@query(
    """select o_orderkey as id, o_orderpriority as name, false as rejected from orders where o_orderkey % 9 > 0
union all select null, null, true"""
)
def src3_index_scan(spark, sf_dir):
    """Indexes as JSON arrays in many files: rows without an id are left out; an index with one malformed file is rejected as a whole."""
    good, bad = shared(spark), shared(spark)
    schema = StructType([StructField("id", LongType()), StructField("name", StringType())])
    rows = views.table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderkey")).alias("id"), F.col("o_orderpriority").alias("name"), F.floor(F.col("o_orderkey") / 1000).alias("part"))
    # each file is an array of the rows of one part, a thousand at most, over several lines
    arrays = rows.groupBy("part").agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(F.to_json(F.struct("id", "name"))), ",\n"), F.lit("\n]")).alias("value"))
    arrays.write.partitionBy("part").text(good)
    arrays.union(spark.createDataFrame([(-1, '[{"id": 1')], "part long, value string")).write.partitionBy("part").text(bad)
    try:
        readers.read_index(spark, bad, schema, "id").write.format("noop").mode("overwrite").save()
        rejected = False
    except Exception as e:
        rejected = "MALFORMED" in str(e)
    mark = spark.createDataFrame([(None, None, rejected)], "id long, name string, rejected boolean")
    return readers.read_index(spark, good, schema, "id").select("id", "name", F.lit(False).alias("rejected")).unionByName(mark)


@query("select c_custkey as id, case when regexp_matches(c_mktsegment, '^[=+\\-@]') then '''' || c_mktsegment else c_mktsegment end as segment from customer")
def src5_csv_round_trip(spark, sf_dir):
    path = shared(spark)
    writers.write_csv(views.table(spark, sf_dir, "customer").selectExpr("c_custkey as id", "c_mktsegment as segment"), path)
    return readers.read_verdicts(spark, path, StructType([StructField("id", LongType()), StructField("segment", StringType())]))


@query("select doc_id, false as truncated, length(text) as n from documents")
def src6_whole_texts(spark, sf_dir):
    """The source's cap is optional; the query reads whole texts."""
    return readers.capped(views.table(spark, sf_dir, "documents")).select("doc_id", "truncated", F.length("text").cast("long").alias("n"))


@query(
    """with c as (select conv_id % 30 as bucket, conv_id % 3 as kind, conv_id, turn, text from conversations),
  t as (select bucket, kind, string_agg(replace(text, chr(10), ' ') || chr(10), '' order by conv_id, turn) as whole from c group by all)
select bucket, ['txt', 'json', 'xml'][kind + 1] as kind, ['UTF-8', 'UTF-16LE', 'UTF-8'][kind + 1] as charset, kind = 0 and length(whole) > 1000 as truncated, md5(case when kind = 0 then left(whole, 1000) else whole end) as digest from t"""
)
def src6_text_files(spark, sf_dir):
    """Turns written as text, as JSON lines in UTF-16 and as XML, and the files read back; text files up to 1,000 characters."""
    place = shared(spark)
    turns = views.table(spark, sf_dir, "conversations").select((F.col("conv_id") % 30).alias("bucket"), "conv_id", "turn", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    turns = turns.repartition("bucket").sortWithinPartitions("bucket", "conv_id", "turn")
    turns.where("bucket % 3 = 0").select("bucket", "text").write.partitionBy("bucket").text(f"{place}/txt")
    turns.where("bucket % 3 = 1").write.partitionBy("bucket").option("encoding", "UTF-16LE").json(f"{place}/json")
    turns.where("bucket % 3 = 2").write.partitionBy("bucket").option("rowTag", "turn").format("xml").save(f"{place}/xml")
    bucket = F.regexp_extract("path", r"bucket=(\d+)/", 1).cast("long").alias("bucket")
    plain = readers.read_texts(spark, f"{place}/txt", 1000).select(bucket, F.lit("txt").alias("kind"), "charset", "truncated", "text")
    lines = readers.read_texts(spark, f"{place}/json").select(bucket, F.lit("json").alias("kind"), "charset", "truncated", F.transform(F.split(F.rtrim("text"), "\n"), lambda x: F.concat(F.get_json_object(x, "$.text"), F.lit("\n"))).alias("rows"))
    tags = readers.read_texts(spark, f"{place}/xml").select(bucket, F.lit("xml").alias("kind"), "charset", "truncated", F.transform(F.regexp_extract_all("text", F.lit("(?s)<text>(.*?)</text>"), F.lit(1)), lambda x: F.concat(x, F.lit("\n"))).alias("rows"))
    joined = lines.unionByName(tags).withColumn("text", F.array_join("rows", "")).drop("rows")
    return plain.unionByName(joined).withColumn("digest", F.md5("text")).drop("text")


@query("select distinct '/d/' || c_mktsegment || '.pdf' as path from customer where c_custkey % 2 = 0")
def src7_path_list(spark, sf_dir):
    path = shared(spark)
    rows = views.table(spark, sf_dir, "customer").selectExpr("concat('/d/', c_mktsegment, case when c_custkey % 2 = 0 then '.pdf' else '.exe' end) as path")
    writers.write_snapshot(rows, path, "text")
    return readers.read_path_list(spark, path, [".pdf"])


@query("select o_orderkey, o_totalprice, o_orderstatus from orders")
def snk5_zstd_snapshot(spark, sf_dir):
    path = shared(spark)
    writers.write_snapshot(views.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path)
    return spark.read.parquet(path)


@query("select conv_id, turn, role from conversations")
def snk6_json_writer(spark, sf_dir):
    path = shared(spark)
    writers.write_snapshot(views.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), path, "json")
    return spark.read.schema(TURNS).json(path)
