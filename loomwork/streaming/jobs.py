"""Streams: duplicates, routing, job leases and incremental extraction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType, StructField, TimestampType

from loomwork.functions.names import fresh
from loomwork.streaming.keytable import KeyTable, delete, ensure


def once(stream: DataFrame, key: str, at: str, within: str = "1 day") -> DataFrame:
    """The first row of each key within a time; its state is dropped once the watermark has passed."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def append_new(stream: DataFrame, target: str, checkpoint: str, key: str, order: str | None = None, buckets: int = 64) -> StreamingQuery:
    """Appends what is new by key to a Parquet table, a folder for each batch, so that a repeated batch replaces itself.

    The keys seen so far are a table beside it (`KeyTable`). Of several rows of a key in one batch the first by `order` stays, else
    the least of all columns, so a repeated batch chooses the same.
    """

    def sink(batch: DataFrame, number: int) -> None:
        known = KeyTable(batch.sparkSession, f"{target}-keys", [StructField(key, batch.schema[key].dataType)], buckets)
        order_by = F.struct(*([order] if order else []), *batch.columns)
        own = batch.groupBy(F.col(key).alias("k")).agg(F.min_by(F.struct(*batch.columns), order_by).alias("r")).select("r.*")
        own.join(known.known(number, batch), key, "left_anti").write.mode("overwrite").parquet(f"{target}/batch={number}")
        known.add(number, batch.sparkSession.read.schema(batch.schema).parquet(f"{target}/batch={number}").select(key))

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def routed(stream: DataFrame, decide: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Writes each row below its batch and decision, as decide() adds it; a repeated batch replaces itself."""

    def sink(batch: DataFrame, number: int) -> None:
        decide(batch).write.mode("overwrite").partitionBy("decision").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_or_rejected(
    stream: DataFrame, target: str, rejects: str, checkpoint: str, key: str, at: str, outcome: str | None = None, within: str = "10 minutes", keep: str = "7 days", buckets: int = 64
) -> StreamingQuery:
    """The first result of each key goes to target, every other row to the reject table with its reason.

    Reasons: `more than .. behind` for rows older than `within` before the newest time of earlier batches, which count for
    nothing else; `no_key`; `repeat` where an earlier result of the key has the same outcome, `conflict` where it has another. Earlier is by batch,
    then by time and outcome. First results are kept in a `KeyTable`; they are forgotten `keep` of event time after their own, when
    the table is next merged. All three tables have a folder for each batch, so that a repeated batch replaces itself.
    """
    marks = f"{target}-marks"

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mark, place, first_place, first_outcome, why = fresh(batch, "newest", "place", "first_place", "first_outcome", "reason")
        # rows get numbers that stay, so that of equal rows one is the first
        taken = f"{target}-taken/batch={number}"
        numbered = batch.withColumn(at, F.col(at).cast("timestamp")).withColumn(place, F.monotonically_increasing_id())
        numbered.write.mode("overwrite").parquet(taken)
        rows = spark.read.schema(numbered.schema).parquet(taken)
        # one row for each batch
        newest = spark.read.schema(f"{mark} timestamp, batch int").parquet(ensure(spark, marks)).where(F.col("batch") < number).agg(F.max(mark)).first()[0]
        late = F.coalesce(F.col(at) < F.lit(newest).cast("timestamp") - F.expr(f"interval {within}"), F.lit(False))
        old = F.lit(newest).cast("timestamp") - F.expr(f"interval {keep}")
        own = F.col(outcome).cast("string") if outcome else F.lit(None).cast("string")
        fields = [StructField(key, batch.schema[key].dataType), StructField("first_at", TimestampType()), StructField("first_outcome", StringType())]
        known = KeyTable(spark, f"{target}-keys", fields, buckets, keep=lambda t: t if newest is None else t.where(~(F.col("first_at") < old) | F.col("first_at").isNull()))
        before = known.known(number, rows).select(F.col(key).alias(mark), F.lit(None).cast("long").alias(first_place), F.col("first_outcome").alias(first_outcome))
        on_time = rows.where(~late & F.col(key).isNotNull())
        best = on_time.groupBy(F.col(key).alias(mark)).agg(F.min(F.struct(F.col(at).alias("at"), own.alias("outcome"), F.col(place).alias("place"))).alias("f"))
        best = best.select(mark, F.col("f.place").alias(first_place), F.col("f.outcome").alias(first_outcome)).join(before, mark, "left_anti")
        winners = before.unionByName(best)
        reason = (
            F.when(F.col(key).isNull(), "no_key")
            .when(late, f"more than {within} behind")
            .when(F.coalesce(F.col(first_place) == F.col(place), F.lit(False)), None)
            .when(F.col(first_outcome).eqNullSafe(own), "repeat")
            .otherwise("conflict")
        )
        judged = rows.join(winners, F.col(key) == F.col(mark), "left").select(*batch.columns, reason.alias(why))
        judged.where(F.col(why).isNull()).drop(why).write.mode("overwrite").parquet(f"{target}/batch={number}")
        judged.where(F.col(why).isNotNull()).write.mode("overwrite").parquet(f"{rejects}/batch={number}")
        accepted = spark.read.schema(rows.drop(place).schema).parquet(f"{target}/batch={number}")
        known.add(number, accepted.select(key, F.col(at).alias("first_at"), own.alias("first_outcome")))
        rows.agg(F.max(at).alias(mark)).write.mode("overwrite").parquet(f"{marks}/batch={number}")
        delete(spark, taken)

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Lease:
    """State of one job; its methods give the changes that they make, as (status, attempts, result)."""

    def __init__(self, status: str = "queued", attempts: int = 0, until: int = 0, *, lease_s: int, most: int):
        self.status, self.attempts, self.until, self.lease_s, self.most = status, attempts, until, lease_s, most

    def lapse(self, now: int) -> list[tuple]:
        if self.status != "processing" or now <= self.until:
            return []
        self.status = "failed" if self.attempts >= self.most else "queued"
        return [(self.status, self.attempts, "lease_over")]

    def take(self, event: str, now: int) -> list[tuple]:
        rows = self.lapse(now)
        if event == "claimed" and self.status == "queued":
            self.status, self.attempts, self.until = "processing", self.attempts + 1, now + self.lease_s * 1000
            rows.append((self.status, self.attempts, "claimed"))
        elif event in ("done", "failed"):
            new = "completed" if event == "done" else "failed"
            ended = self.status in ("completed", "failed")
            rows.append((self.status if ended else new, self.attempts, ("repeat" if self.status == new else "conflict") if ended else "accepted"))
            self.status = self.status if ended else new
        return rows


LEASES = "job_id long, status string, attempts int, result string"
_STATUSES = ("queued", "processing", "completed", "failed")
#: A job in the state of its group; `none` marks the job without an id, `due` is when its time is over.
_JOB = np.dtype([("job", "i8"), ("none", "?"), ("status", "u1"), ("attempts", "i4"), ("until", "i8"), ("newest", "i8"), ("due", "i8")])


def leases(events: DataFrame, lease_s: int = 900, most: int = 3, keep_s: int = 86_400, groups: int = 4096) -> DataFrame:
    """Life of jobs from events (job_id, event: claimed or done or failed, at): a row for each change.

    A claim starts a lease in event time. When the watermark passes its end the job is queued again, or fails after
    `most` attempts. The first result counts: later ones come out as repeat or conflict. The state of a job that has ended is
    kept for `keep_s` of event time after its last event, in which repeats are told, and then dropped; that of a queued job too.

    Jobs are kept in `groups` by a hash of their ids, since a call of the function costs far more than the events of a job. A
    group's state is a table of its jobs, and its timeout that of the job that is due first. A checkpoint holds for one number of groups.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark, rows, seen = state.getCurrentWatermarkMs(), [], set()
        jobs = {(job, none): rest for job, none, *rest in np.frombuffer(state.get[0], _JOB).tolist()} if state.exists else {}

        def put(job_key: tuple, job: Lease, newest: int) -> None:
            # the job's own time counts: the watermark is nought until the first batch has ended
            due = max(job.until if job.status == "processing" else newest + keep_s * 1000, mark + 1)
            jobs[job_key] = (_STATUSES.index(job.status), job.attempts, job.until, newest, due)

        def told(job_key: tuple, changes: list[tuple]) -> None:
            rows.extend((None if job_key[1] else job_key[0], *r) for r in changes)

        def get(job_key: tuple) -> tuple[Lease, int]:
            status, attempts, until, newest, _ = jobs.get(job_key, (0, 0, 0, 0, 0))
            return Lease(_STATUSES[status], attempts, until, lease_s=lease_s, most=most), newest

        held = [f for f in frames if len(f)]
        if held:
            # a job's events may come in several frames: they are put in order as a whole
            held = pd.concat(held).sort_values(["none", "job", "ms", "event"])
            now, job, newest = None, None, 0
            for *job_key, event, at in zip(*(held[c].tolist() for c in ("job", "none", "event", "ms")), strict=True):
                if (own := tuple(job_key)) != now:
                    if job is not None:
                        put(now, job, newest)
                    now = own
                    job, newest = get(now)
                    seen.add(now)
                told(now, job.take(event, int(at)))
                newest = max(newest, int(at))
            put(now, job, newest)
        for job_key in [k for k, v in jobs.items() if v[-1] < mark and k not in seen]:
            job, newest = get(job_key)
            if job.status == "processing":
                told(job_key, job.lapse(mark))
                put(job_key, job, newest)
            else:
                del jobs[job_key]
        if jobs:
            state.update((np.array([(*k, *v) for k, v in jobs.items()], _JOB).tobytes(),))
            state.setTimeoutTimestamp(max(min(v[-1] for v in jobs.values()), mark + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=["job_id", "status", "attempts", "result"]).astype({"job_id": "Int64"})

    timed = events.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", "10 minutes")
    job = F.col("job_id").cast("long")
    # milliseconds since 1970, as the watermark is, whatever the session's time zone; `at` stays, as late rows are told by it
    timed = timed.select(F.pmod(F.xxhash64(job), F.lit(groups)).cast("int").alias("group"), F.coalesce(job, F.lit(0)).alias("job"), job.isNull().alias("none"), "event", F.unix_millis("at").alias("ms"), "at")
    return timed.groupBy("group").applyInPandasWithState(step, LEASES, "jobs binary", "append", GroupStateTimeout.EventTimeTimeout)


def lease_history(events: DataFrame, watermark_ms: int | None = None, lease_s: int = 900, most: int = 3) -> DataFrame:
    """The rows of `leases` over a table of events, by a fold of each job's events in order; leases that end before the watermark, in milliseconds, lapse.

    Tasks read the events of their jobs sorted and keep the state of one job at a time, however many events it has.
    """
    end = watermark_ms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, job = None, None
        for b in batches:
            rows: list[tuple] = []
            for key, event, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if job is None or key != now:
                    if job is not None and end is not None:
                        rows += ((now, *r) for r in job.lapse(end))
                    now, job = key, Lease(lease_s=lease_s, most=most)
                rows += ((key, *r) for r in job.take(event, at))
            yield _changes(rows)
        if job is not None and end is not None:
            yield _changes([(now, *r) for r in job.lapse(end)])

    timed = events.select("job_id", "event", F.unix_millis(F.col("at").cast("timestamp")).alias("at"))
    return timed.repartition("job_id").sortWithinPartitions("job_id", "at", "event").mapInArrow(run, LEASES)


def _changes(rows: list[tuple]) -> pa.RecordBatch:
    types = {"job_id": pa.int64(), "status": pa.string(), "attempts": pa.int32(), "result": pa.string()}
    return pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(types.items())})


def hourly(events: DataFrame, at: str, kind: str) -> DataFrame:
    """Counts by hour and kind, late rows of up to an hour included."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, "1 hour")
    return timed.groupBy(F.window(at, "1 hour").alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), kind, "n")


PEOPLE_BUCKET = "identity_bucket"


def identity_stream(
    stream: DataFrame, extract: Callable[[DataFrame], DataFrame], name: Callable[[DataFrame], DataFrame], refresh: Callable[[DataFrame], DataFrame], place: str, checkpoint: str, buckets: int = 256
) -> StreamingQuery:
    """Extracts the fields of new documents, and makes the rows of the identities that they touch anew.

    extract(documents) gives fields with doc_id; name(fields) gives doc_id and identity_id of the documents that name a person;
    refresh(fields with identity_id) gives a row for each identity. Fields lie below `place`/fields in folders by a hash of their
    identity, and within them by batch; a batch reads the folders alone that its own identities fall in, so what it reads grows
    with its people's documents and not with the number of batches before. The refreshed rows replace the bucket's earlier ones below `place`/people;
    fields of documents without an identity are kept below `place`/unassigned. A repeated batch writes the same again.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        found = extract(batch)
        fresh_fields = f"{place}/extracted/batch={number}"
        found.write.mode("overwrite").parquet(fresh_fields)
        own = spark.read.schema(found.schema).parquet(fresh_fields)
        people = own.join(name(own).select("doc_id", "identity_id"), "doc_id", "left")
        bucket = F.pmod(F.xxhash64("identity_id"), F.lit(buckets)).cast("int")
        people.where("identity_id is null").drop("identity_id").write.mode("overwrite").parquet(f"{place}/unassigned/batch={number}")
        named = people.where("identity_id is not null").withColumn(PEOPLE_BUCKET, bucket).withColumn("batch", F.lit(number))
        # replaces the folders of this batch and bucket, and no others
        named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PEOPLE_BUCKET, "batch").parquet(f"{place}/fields")
        touched = [r[0] for r in named.select(PEOPLE_BUCKET).distinct().collect()]  # `buckets` at most
        every = spark.read.schema(named.schema).parquet(f"{place}/fields").where(F.col(PEOPLE_BUCKET).isin(touched) & (F.col("batch") <= number))
        rows = refresh(every.drop(PEOPLE_BUCKET, "batch")).withColumn(PEOPLE_BUCKET, bucket)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PEOPLE_BUCKET).parquet(f"{place}/people")
        delete(spark, fresh_fields)

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def extract_stream(
    stream: DataFrame, extract: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, refresh: Callable[[DataFrame, DataFrame], DataFrame] | None = None, identities: str = ""
) -> StreamingQuery:
    """Extracts the fields of new documents and appends them, a folder for each batch.

    refresh(new fields, all fields) gives the rows of the identities that the new fields touch; they are written below
    `identities`, a folder for each batch, of which the latest counts for an identity. Documents are dealt by their doc_id first: a batch
    of one large file would else be one task. Their number is given, as texts that pack well would be merged into one task again.
    """

    def sink(batch: DataFrame, number: int) -> None:
        own = extract(batch.repartition(int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id"))
        own.write.mode("overwrite").parquet(f"{target}/batch={number}")
        if refresh is not None:
            spark = batch.sparkSession
            new = spark.read.schema(own.schema).parquet(f"{target}/batch={number}")
            every = spark.read.schema(own.schema).parquet(*(f"{target}/batch={k}" for k in range(number + 1)))
            refresh(new, every).write.mode("overwrite").parquet(f"{identities}/batch={number}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
