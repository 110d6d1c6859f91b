"""Queries whose rows pass through Structured Streaming, over a table's files as the stream."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomwork.functions.keys import identity_id
from loomwork.operators.extract import extract_fields
from loomwork.plans import views
from loomwork.plans.registry import registry
from loomwork.plans.views import with_views
from loomwork.streaming import arrivals, jobs

QUERIES, query = registry()


def shared(spark: SparkSession) -> str:
    """A new folder in the cluster's shared checkpoint folder; without that setting there is none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a stream's source is a folder or a pattern, and the table may be one file
    return spark.readStream.schema(schema).parquet(f"{path}*")


def drained(stream: DataFrame) -> DataFrame:
    """All rows of a finite stream, by way of a table in the shared folder."""
    place = shared(stream.sparkSession)
    stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{place}/out")


@query()
def st2_stream_dedupe(spark, sf_dir):
    """First event of each user and type within a day; which one depends on the order of arrival."""
    keyed = event_stream(spark, sf_dir).withColumn("key", F.concat_ws("|", "user_id", "event_type"))
    return drained(jobs.once(keyed, "key", "ts").select("key", "event_id"))


@query("select user_id || '|' || event_type as key, count(*) as n from (select distinct user_id, event_type from events) group by 1")
def st2_all_time_dedupe(spark, sf_dir):
    """Each key once over all batches, by the key table; a small test sends keys again in later batches."""
    place = shared(spark)
    keyed = event_stream(spark, sf_dir).withColumn("key", F.concat_ws("|", "user_id", "event_type"))
    jobs.append_new(keyed, f"{place}/out", f"{place}/log", "key").awaitTermination()
    return spark.read.parquet(f"{place}/out").groupBy("key").agg(F.count("*").alias("n"))


def job_events(stream: DataFrame) -> DataFrame:
    return stream.select(
        (F.col("user_id") * 100 + F.col("event_id") % 100).alias("job_id"),
        F.when(F.col("event_type") == "click", "claimed").when(F.col("event_type") == "view", "done").otherwise("failed").alias("event"),
        F.col("ts").alias("at"),
    )


def in_waves(rows: DataFrame, waves: list[Column], run: Callable[[DataFrame], StreamingQuery]) -> None:
    """Writes the rows of one wave after the other to a folder and lets a stream over it take what is new each time."""
    spark, source = rows.sparkSession, shared(rows.sparkSession)
    for wave in waves:
        rows.where(wave).write.mode("append").parquet(source)
        run(spark.readStream.schema(rows.schema).parquet(source)).awaitTermination()


def halves(spark: SparkSession, sf_dir: str) -> Column:
    """Whether an event is of the earlier half."""
    return F.col("event_id") < views.table(spark, sf_dir, "events").count() // 2


@query(
    """with recursive j as (select user_id * 10 + event_id % 10 as job_id, case event_type when 'view' then 'done' when 'error' then 'failed' else 'claimed' end as event, epoch_ms(ts) as t from events),
  e as (select *, row_number() over (partition by job_id order by t, event) as n from j),
  s as (select job_id, 0::bigint as n, 'queued' as status, 0 as attempts, 0::bigint as until, null::varchar as lapsed, null::varchar as result, null::varchar as told from (select distinct job_id from j)
    union all
    select job_id, n, case when event = 'claimed' and was = 'queued' then 'processing' when event = 'claimed' or was in ('completed', 'failed') then was when event = 'done' then 'completed' else 'failed' end,
      case when event = 'claimed' and was = 'queued' then attempts + 1 else attempts end, case when event = 'claimed' and was = 'queued' then t + 259200000 else until end, gone,
      case when event = 'claimed' then case when was = 'queued' then 'claimed' end when was not in ('completed', 'failed') then 'accepted' when (was = 'completed') = (event = 'done') then 'repeat' else 'conflict' end,
      null::varchar
    from (select e.job_id, e.n, e.event, e.t, s.attempts, s.until, case when s.status <> 'processing' or e.t <= s.until then null when s.attempts >= 3 then 'failed' else 'queued' end as gone,
        coalesce(gone, s.status) as was from s join e on e.job_id = s.job_id and e.n = s.n + 1)),
  w as (select max(t) - 600000 as mark from j),
  l as (select * from s qualify n = max(n) over (partition by job_id)),
  o as (select job_id, lapsed as status, attempts - case when result = 'claimed' then 1 else 0 end as attempts, 'lease_over' as result from s where lapsed is not null
    union all select job_id, status, attempts, result from s where result is not null
    union all select job_id, case when attempts >= 3 then 'failed' else 'queued' end, attempts, 'lease_over' from l, w where status = 'processing' and mark > until)
select job_id, status, attempts::int as attempts, result from o"""
)
def st4_job_leases(spark, sf_dir):
    """Life of jobs over three batches in order of time, with leases of three days: claims, lapses, results."""
    place = shared(spark)
    events = views.table(spark, sf_dir, "events").select(
        "event_id",
        (F.col("user_id") * 10 + F.col("event_id") % 10).alias("job_id"),
        F.when(F.col("event_type") == "view", "done").when(F.col("event_type") == "error", "failed").otherwise("claimed").alias("event"),
        F.col("ts").alias("at"),
    )

    def run(stream: DataFrame) -> StreamingQuery:
        out = jobs.leases(stream, lease_s=259_200, keep_s=366 * 86_400).writeStream.format("parquet").option("path", f"{place}/out")
        return out.option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start()

    # by time and not by id: an event that is behind the watermark of the batches before would be dropped
    first, last = events.agg(F.min("at"), F.max("at")).first()
    early, half = (F.coalesce(F.col("at") < F.lit(first + (last - first) / n if first else None), F.lit(False)) for n in (100, 2))
    in_waves(events, [early, ~early & half, ~half], run)
    return spark.read.schema(jobs.LEASES).parquet(f"{place}/out")


LEASE_SQL = QUERIES["st4_job_leases"][1]


@query(LEASE_SQL)
def st4_lease_history(spark, sf_dir):
    """The batch twin: the same rows by a fold of each job's events, with the watermark that the stream ends with."""
    events = views.table(spark, sf_dir, "events").select(
        (F.col("user_id") * 10 + F.col("event_id") % 10).alias("job_id"),
        F.when(F.col("event_type") == "view", "done").when(F.col("event_type") == "error", "failed").otherwise("claimed").alias("event"),
        F.col("ts").alias("at"),
    )
    newest = events.agg(F.max(F.unix_millis(F.col("at").cast("timestamp")))).first()[0]
    return jobs.lease_history(events, newest - 600_000, lease_s=259_200)


@query(
    """with j as (select user_id * 100 + event_id % 100 as job_id, case event_type when 'view' then 'done' else 'failed' end as event, ts, event_type from events),
  f as (select job_id, event, row_number() over (partition by job_id order by ts, event) as n from j where event_type <> 'click')
select job_id, case event when 'done' then 'completed' else 'failed' end as status from f where n = 1"""
)
def st4_first_results(spark, sf_dir):
    """The accepted result of each job by the stream of leases over one batch: its first one, as in the batch twin."""
    # one batch, within which the watermark cannot pass: every result is seen
    events = job_events(event_stream(spark, sf_dir)).where("event <> 'claimed'")
    out = drained(jobs.leases(events))
    return out.where("result = 'accepted'").select("job_id", "status")


JOBS = """j as (select event_id, user_id * 10 + event_id % 10 as job_id, case event_type when 'view' then 'done' when 'click' then 'done' else 'failed' end as outcome, ts as t,
    case when event_id % 7 = 0 then 2 when event_id < (select count(*) // 2 from events) then 0 else 1 end as wave from events)"""


@query(
    f"""with {JOBS}, m as (select w.wave, max(j.t) as mark from (select unnest([0, 1, 2]) as wave) w left join j on j.wave < w.wave group by 1),
  l as (select j.*, coalesce(j.t < mark - interval 5 days, false) as late from j join m using (wave)),
  r as (select *, first_value(event_id) over w as first_id, first_value(outcome) over w as first_outcome from l where not late window w as (partition by job_id order by wave, t, outcome))
select event_id, case when event_id = first_id then 'kept' when outcome = first_outcome then 'repeat' else 'conflict' end as verdict from r
union all select event_id, 'more than 5 days behind' from l where late"""
)
def st6_first_results(spark, sf_dir):
    """Results in three batches, the last of which brings old ones: the first of each job is kept, the others are rejected with a reason."""
    place = shared(spark)
    results = views.table(spark, sf_dir, "events").select(
        "event_id",
        (F.col("user_id") * 10 + F.col("event_id") % 10).alias("job_id"),
        F.when(F.col("event_type").isin("view", "click"), "done").otherwise("failed").alias("outcome"),
        F.col("ts").alias("at"),
    )
    delayed, half = F.col("event_id") % 7 == 0, halves(spark, sf_dir)
    in_waves(
        results,
        [~delayed & half, ~delayed & ~half, delayed],
        lambda stream: jobs.first_or_rejected(stream, f"{place}/out", f"{place}/rejects", f"{place}/log", "job_id", "at", "outcome", "5 days", "90 days"),
    )
    kept, rejected = (spark.read.parquet(f"{place}/{t}") for t in ("out", "rejects"))
    return kept.select("event_id", F.lit("kept").alias("verdict")).union(rejected.select("event_id", F.col("reason").alias("verdict")))


@query("select event_id, ts as at from events")
def st6_late_results(spark, sf_dir):
    """Accepted and rejected results together are all of them; `st6_first_results` compares which are which."""
    place = shared(spark)
    stream = event_stream(spark, sf_dir).select("event_id", F.col("ts").alias("at"))
    jobs.first_or_rejected(stream, f"{place}/out", f"{place}/rejects", f"{place}/log", "event_id", "at").awaitTermination()
    kept, late = (spark.read.parquet(f"{place}/{t}").select("event_id", "at") for t in ("out", "rejects"))
    return kept.union(late)


@query("select user_id % 40 as bucket, 1 + user_id % 2 as poll, count(*) as lines from events group by all")
def st1_settled_files(spark, sf_dir):
    """Files of events that arrive in two waves, and four polls: a wave that is fresh in a poll is claimed by a later one, once."""
    source, place = shared(spark), shared(spark)
    events = views.table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("bucket"), "event_id")

    def write(odd: int) -> None:
        events.where(F.col("bucket") % 2 == odd).write.mode("append").partitionBy("bucket").json(source)

    def newest() -> datetime:
        return arrivals.listing(spark, source).agg(F.max("modified")).first()[0]

    def look(number: int, now: datetime) -> None:
        arrivals.poll(spark, source, place, number, now=now)
        taken = arrivals.claimed_stream(spark, place).writeStream.format("parquet").option("path", f"{place}/out")
        taken.option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start().awaitTermination()

    write(0)
    first = newest()
    look(0, first - timedelta(days=1))
    write(1)
    look(1, first + timedelta(seconds=10))
    look(2, newest() + timedelta(seconds=10))
    look(3, newest() + timedelta(days=1))
    files = arrivals.contents(spark.read.schema(arrivals.CLAIMS).parquet(f"{place}/out"), source)
    lines = F.length(F.regexp_replace(F.col("content").cast("string"), "[^\n]", ""))
    return files.groupBy(F.regexp_extract("path", r"bucket=(\d+)/", 1).cast("long").alias("bucket"), F.col("poll").cast("long").alias("poll")).agg(F.sum(lines).alias("lines"))


@query(
    """select event_id, case when event_id % 4 = 0 then 'junk' when event_type = 'error' then 'empty' when event_type = 'click' and value < 2 then 'no_content' else 'keep' end as reason,
  case when event_id % 4 = 0 or event_type = 'error' or (event_type = 'click' and value < 2) then 'noocr' else 'extract' end as decision from events"""
)
def st3_routing(spark, sf_dir):
    """Files by their bytes and the judgement of their page: programs, empty files and sure pictures without text go to noocr."""
    from loomwork.operators.verify import judge_labels, sniff

    place = shared(spark)

    def decide(batch: DataFrame) -> DataFrame:
        head = F.expr("case when event_id % 4 = 0 then X'4D5A90' when event_type = 'error' then X'' else cast(concat('text ', event_id) as binary) end")
        files = batch.select("event_id", sniff(head).alias("bytes"), F.lit("photo").alias("kind"), F.expr("not (event_type = 'click' and value < 2)").alias("has_text"), F.lit(0.9).alias("confidence"))
        judged = judge_labels(files)
        reason = F.when(F.col("bytes") == "program", "junk").when(F.col("bytes") == "empty", "empty").when(F.col("fails"), "no_content").otherwise("keep")
        return judged.select("event_id", reason.alias("reason")).withColumn("decision", F.when(F.col("reason") == "keep", "extract").otherwise("noocr"))

    jobs.routed(event_stream(spark, sf_dir), decide, f"{place}/out", f"{place}/log").awaitTermination()
    return spark.read.parquet(f"{place}/out").select("event_id", "reason", "decision")


@query("select user_id, min(event_type) is not null as seen from events group by 1")
def st1_append_new(spark, sf_dir):
    """Users as files of events arrive, each once, whichever batch brings them."""
    place = shared(spark)
    jobs.append_new(event_stream(spark, sf_dir), f"{place}/out", f"{place}/log", "user_id").awaitTermination()
    return spark.read.parquet(f"{place}/out").select("user_id", F.col("event_type").isNotNull().alias("seen"))


@query(with_views("form_lines") + " select doc_id, field_name, value from form_lines where value is not null and field_name in ('given_names', 'family_name', 'date_of_birth', 'mobile_number', 'email_address')")
def st5_incremental_extraction(spark, sf_dir):
    """The whole extraction over arriving forms."""
    place, source = shared(spark), shared(spark)
    views.forms(spark, sf_dir).write.parquet(source)
    stream = spark.readStream.schema("doc_id long, text string").parquet(source)
    jobs.extract_stream(stream, lambda batch: extract_fields(batch, "2025-06-30"), f"{place}/out", f"{place}/log").awaitTermination()
    kept = "given_names family_name date_of_birth mobile_number email_address".split()
    return spark.read.parquet(f"{place}/out").where(F.col("field_name").isin(kept)).select("doc_id", "field_name", "value")


@query(
    """with p as (select c_custkey as doc_id, lower(c_mktsegment) as given, 'fam' || (c_custkey % 97) as family, c_custkey % 4 = 0 as born from customer)
select sha256(family || '|' || given || '|19800214')[1:16] as identity_id, count(*) as documents, min(doc_id) as first_document from p where born group by 1
union all select 'unassigned', count(*), min(doc_id) from p where not born"""
)
def st5_identity_folders(spark, sf_dir):
    """The same people from three batches of forms, by fields in folders of identities: a batch reads the folders of its own people."""
    place = shared(spark)

    def people(fields: DataFrame) -> DataFrame:
        wide = fields.groupBy("doc_id").pivot("field_name", ["family_name", "given_names", "date_of_birth"]).agg(F.min("value"))
        return wide.select("doc_id", identity_id(F.col("family_name"), F.col("given_names"), F.col("date_of_birth")).alias("identity_id")).where("identity_id is not null")

    def refresh(fields: DataFrame) -> DataFrame:
        return fields.groupBy("identity_id").agg(F.count_distinct("doc_id").alias("documents"), F.min("doc_id").alias("first_document"))

    in_waves(
        views.forms(spark, sf_dir),
        [F.col("doc_id") % 3 == k for k in range(3)],
        lambda stream: jobs.identity_stream(stream, lambda batch: extract_fields(batch, "2025-06-30"), people, refresh, place, f"{place}/log", buckets=8),
    )
    rest = spark.read.parquet(f"{place}/unassigned").select("doc_id").distinct()
    return spark.read.parquet(f"{place}/people").select("identity_id", "documents", "first_document").unionByName(
        rest.agg(F.lit("unassigned").alias("identity_id"), F.count("*").alias("documents"), F.min("doc_id").alias("first_document"))
    )


@query(
    """with p as (select c_custkey as doc_id, lower(c_mktsegment) as given, 'fam' || (c_custkey % 97) as family from customer where c_custkey % 4 = 0)
select sha256(family || '|' || given || '|19800214')[1:16] as identity_id, count(*) as documents from p group by 1"""
)
def st5_identities(spark, sf_dir):
    """Identities that each batch of forms touches, made anew from all fields so far; the latest row of each counts."""
    place, source = shared(spark), shared(spark)
    views.forms(spark, sf_dir).repartition(3).write.parquet(source)
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(source)

    def people(fields: DataFrame) -> DataFrame:
        names = ["family_name", "given_names", "date_of_birth"]
        wide = fields.where(F.col("field_name").isin(names)).groupBy("doc_id").pivot("field_name", names).agg(F.min("value"))
        return wide.select("doc_id", identity_id(F.col("family_name"), F.col("given_names"), F.col("date_of_birth")).alias("identity_id")).where("identity_id is not null")

    def refresh(new: DataFrame, every: DataFrame) -> DataFrame:
        touched = people(new).select("identity_id").distinct()
        return people(every).join(touched, "identity_id", "left_semi").groupBy("identity_id").agg(F.count("*").alias("documents"))

    jobs.extract_stream(stream, lambda batch: extract_fields(batch, "2025-06-30"), f"{place}/out", f"{place}/log", refresh, f"{place}/people").awaitTermination()
    return spark.read.parquet(f"{place}/people").groupBy("identity_id").agg(F.max_by("documents", "batch").alias("documents"))
