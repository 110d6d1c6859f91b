from datetime import datetime, timedelta


from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from loomwork.operators.queue import expire_leases, first_results
from loomwork.streaming import arrivals, jobs
from loomwork.streaming.keytable import KeyTable

START = datetime(2024, 1, 1)


def events(spark, folder, rows):
    for k, batch in enumerate(rows):
        spark.createDataFrame([(j, e, START + timedelta(seconds=s)) for j, e, s in batch], "job_id long, event string, at timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/b{k}")
    return spark.readStream.schema("job_id long, event string, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_leases(spark, tmp_path):
    stream = events(
        spark,
        str(tmp_path / "in"),
        [[(1, "claimed", 0), (2, "claimed", 0)], [(1, "done", 60), (1, "done", 70), (1, "failed", 80)], [(9, "claimed", 7200)], [(9, "done", 7300)]],
    )
    out = jobs.leases(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    out.awaitTermination()
    got = [(r.job_id, r.status, r.result) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert {(1, "completed", "accepted"), (1, "completed", "repeat"), (1, "completed", "conflict"), (2, "queued", "lease_over")} <= set(got)


def test_append_new_is_idempotent(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, v string").parquet(str(tmp_path / "in"))
    for _ in range(2):
        jobs.append_new(stream, str(tmp_path / "out"), str(tmp_path / "log"), "k").awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_hourly(spark, tmp_path):
    stream = events(spark, str(tmp_path / "in"), [[(1, "a", 0), (2, "a", 10), (3, "b", 4000)], [(4, "a", 20000)]])
    jobs.hourly(stream, "at", "event").writeStream.format("memory").queryName("hours").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert {(r.event, r.n) for r in spark.table("hours").collect()} >= {("a", 2), ("b", 1)}


def test_batch_twins(spark):
    rows = spark.createDataFrame([(1, "processing", START, 1), (2, "processing", START, 3), (3, "queued", START, 0)], "id int, status string, started_at timestamp, attempts int")
    assert sorted(map(tuple, expire_leases(rows, "2024-01-01 01:00:00").collect())) == [(1, "requeue"), (2, "fail")]
    late = spark.createDataFrame([(1, 1, "done"), (1, 2, "done"), (1, 3, "failed")], "job int, at int, outcome string")
    assert [r.state for r in first_results(late, "job", "at", "outcome").orderBy("at").collect()] == ["accepted", "repeat", "conflict"]


def test_keys_of_earlier_batches_are_known(spark, tmp_path):
    """Keys that come again in later batches, and a batch that is repeated, add nothing."""
    batches = [[(1, "a", 0), (2, "a", 1)], [(2, "b", 2), (3, "b", 3)], [(1, "c", 4), (3, "c", 5), (4, "c", 6)]]
    stream = events(spark, str(tmp_path / "in"), batches)
    jobs.append_new(stream, str(tmp_path / "out"), str(tmp_path / "log"), "job_id", buckets=4).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.job_id, r.event) for r in got.collect()) == [(1, "a"), (2, "a"), (3, "b"), (4, "c")]
    # the last batch once more, as after a failure
    import shutil

    shutil.rmtree(tmp_path / "log" / "commits")
    jobs.append_new(stream, str(tmp_path / "out"), str(tmp_path / "log"), "job_id", buckets=4).awaitTermination()
    assert sorted(r.job_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3, 4]


def test_late_results_are_rejected(spark, tmp_path):
    stream = events(spark, str(tmp_path / "in"), [[(1, "done", 3600)], [(2, "done", 10), (3, "done", 3300)], [(4, "done", 20)]])
    where = {k: str(tmp_path / k) for k in ("out", "late", "log")}
    jobs.first_or_rejected(stream, where["out"], where["late"], where["log"], "job_id", "at").awaitTermination()
    assert sorted(r.job_id for r in spark.read.parquet(where["out"]).collect()) == [1, 3]
    late = spark.read.parquet(where["late"]).collect()
    assert sorted(r.job_id for r in late) == [2, 4] and {r.reason for r in late} == {"more than 10 minutes behind"}


def test_routing_replaces_a_repeated_batch(spark, tmp_path):
    stream = events(spark, str(tmp_path / "in"), [[(1, "a", 0)], [(2, "b", 1)]])

    def decide(batch):
        return batch.selectExpr("job_id", "case when event = 'a' then 'x' else 'y' end as decision")

    import shutil

    for _ in range(2):
        jobs.routed(stream, decide, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
        shutil.rmtree(tmp_path / "log" / "commits")
    assert sorted((r.job_id, r.decision) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "x"), (2, "y")]


def test_state_of_ended_jobs_goes(spark, tmp_path):
    """A day of event time after its end a job is forgotten: the same result then counts as a first one."""
    day = 86_400
    stream = events(spark, str(tmp_path / "in"), [[(1, "claimed", 0), (1, "done", 60)], [(9, "done", 3 * day)], [(8, "done", 3 * day + 10)], [(1, "done", 3 * day + 20)]])
    out = jobs.leases(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    out.awaitTermination()
    got = [(r.status, r.result) for r in spark.read.parquet(str(tmp_path / "out")).where("job_id = 1").collect()]
    assert got.count(("completed", "accepted")) == 2 and not any(r == "repeat" for _, r in got)


def test_files_that_settle_later(spark, tmp_path):
    """A file that is fresh in a poll comes in a later one, once; a changed file comes again; a repeated poll replaces itself."""
    import os

    source, place = tmp_path / "in", str(tmp_path / "place")
    assert arrivals.poll(spark, str(source), place, 0).count() == 0
    (source / "sub").mkdir(parents=True)
    ages = {"old.txt": 3600, "fresh.txt": 2, "sub/old.txt": 100, ".hidden": 3600, "half.part": 3600}
    for name, age in ages.items():
        (source / name).write_text(name)
        os.utime(source / name, (START.timestamp() - age, START.timestamp() - age))

    def names(number, seconds):
        return sorted(r.path.split("/in/")[1] for r in arrivals.poll(spark, str(source), place, number, now=START + timedelta(seconds=seconds)).collect())

    assert names(1, 0) == ["old.txt", "sub/old.txt"]
    assert names(1, 0) == ["old.txt", "sub/old.txt"]
    assert names(2, 5) == []
    assert names(3, 9) == ["fresh.txt"]
    (source / "old.txt").write_text("again")
    os.utime(source / "old.txt", (START.timestamp() + 20, START.timestamp() + 20))
    assert names(4, 25) == [] and names(5, 60) == ["old.txt"] and names(6, 3600) == []
    claimed = arrivals.claims(spark, place)
    assert claimed.count() == 4
    assert {r.content.decode() for r in arrivals.contents(claimed, str(source)).collect()} == {"again", "fresh.txt", "sub/old.txt"}


def test_intake_polls(spark, tmp_path):
    import time

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("a")
    query = arrivals.start_intake(spark, str(tmp_path / "in"), str(tmp_path / "place"), seconds=1, every="500 milliseconds")
    try:
        for _ in range(60):
            time.sleep(0.5)
            if arrivals.claims(spark, str(tmp_path / "place")).count():
                break
    finally:
        query.stop()
    assert arrivals.claims(spark, str(tmp_path / "place")).count() == 1


def test_first_result_of_each_key(spark, tmp_path):
    """Three results of one key: one kept, two rejected; over batches too; null keys and equal rows have their reasons."""
    batches = [[(1, "done", 3600), (1, "done", 3600), (1, "failed", 3700), (None, "done", 3600)], [(1, "done", 3800), (2, "failed", 3900), (2, "failed", 3850)], [(2, "done", 4000), (3, "done", 10)]]
    stream = events(spark, str(tmp_path / "in"), batches)
    where = {k: str(tmp_path / k) for k in ("out", "no", "log")}
    for _ in range(2):
        jobs.first_or_rejected(stream, where["out"], where["no"], where["log"], "job_id", "at", "event").awaitTermination()
        kept = [(r.job_id, r.event, int((r["at"] - START).total_seconds())) for r in spark.read.parquet(where["out"]).collect()]
        assert sorted(kept) == [(1, "done", 3600), (2, "failed", 3850)]
        got = sorted((r.job_id or 0, r.event, r.reason) for r in spark.read.parquet(where["no"]).collect())
        assert got == [(0, "done", "no_key"), (1, "done", "repeat"), (1, "done", "repeat"), (1, "failed", "conflict"), (2, "done", "conflict"), (2, "failed", "repeat"), (3, "done", "more than 10 minutes behind")]
        # the last batch once more, as after a failure
        import shutil

        shutil.rmtree(tmp_path / "log" / "commits")


def test_key_table_merges_and_forgets(spark, tmp_path):
    fields = [StructField("k", LongType()), StructField("at", LongType())]
    for number in range(9):
        table = KeyTable(spark, str(tmp_path / "keys"), fields, buckets=4, every=3, keep=lambda t: t.where("at > 1"))
        rows = spark.createDataFrame([(number, number), (number + 100, 50)], "k long, at long")
        known = sorted(r.k for r in table.known(number, spark.createDataFrame([(k,) for k in range(200)], "k long")).collect())
        merged = number // 3 * 3
        assert known == sorted([k for k in range(number) if k > 1 or not merged] + [k + 100 for k in range(number)])
        table.add(number, rows)
        table.add(number, rows)
    few = KeyTable(spark, str(tmp_path / "keys"), fields, buckets=4, every=3).known(8, rows.where("k = 8"))
    assert few.count() < 16


def test_lease_history_is_the_stream(spark, tmp_path):
    rows = [[(1, "claimed", 0), (2, "claimed", 0), (3, "done", 5)], [(1, "done", 60), (1, "failed", 80), (2, "claimed", 2000)], [(2, "claimed", 4000), (2, "claimed", 6000), (9, "claimed", 7200)], [(9, "done", 7300)]]
    stream = events(spark, str(tmp_path / "in"), rows)
    out = jobs.leases(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    out.awaitTermination()
    table = spark.createDataFrame([(j, e, START + timedelta(seconds=s)) for batch in rows for j, e, s in batch], "job_id long, event string, at timestamp")
    mark = int((START.timestamp() + 7300 - 600) * 1000)
    want = sorted(map(tuple, jobs.lease_history(table, mark).collect()))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want
    assert (2, "failed", 3, "lease_over") in [tuple(r) for r in jobs.lease_history(table, mark + 10**6).collect()]


def test_identity_folders(spark, tmp_path):
    """A repeated batch changes nothing; what a batch reads is its own people's folders."""
    import shutil

    def fields(batch):
        return batch.selectExpr("job_id as doc_id", "'name' as field_name", "event as value")

    def name(own):
        return own.where("value <> 'none'").selectExpr("doc_id", "value as identity_id")

    read = []

    def refresh(every):
        read.append(sorted({r.identity_id for r in every.collect()}))
        return every.groupBy("identity_id").agg(F.count("*").alias("n"))

    stream = events(spark, str(tmp_path / "in"), [[(1, "ann", 0), (2, "bo", 0), (3, "none", 0)], [(4, "ann", 0), (5, "ann", 0)], [(6, "cy", 0)]])
    for _ in range(2):
        jobs.identity_stream(stream, fields, name, refresh, str(tmp_path / "place"), str(tmp_path / "log"), buckets=64).awaitTermination()
        assert sorted((r.identity_id, r.n) for r in spark.read.parquet(str(tmp_path / "place" / "people")).collect()) == [("ann", 3), ("bo", 1), ("cy", 1)]
        assert [r.doc_id for r in spark.read.parquet(str(tmp_path / "place" / "unassigned")).collect()] == [3]
        shutil.rmtree(tmp_path / "log" / "commits")
    assert read == [["ann", "bo"], ["ann"], ["cy"], ["cy"]]


def test_jobs_share_a_group_of_state(spark, tmp_path):
    """A call of the state function takes all jobs of a group, those without an id too; each job's rows are those of its own fold."""
    rows = [
        [(1, "claimed", 0), (2, "claimed", 0), (3, "done", 5), (None, "claimed", 7), (0, "claimed", 8)],
        [(1, "done", 60), (1, "failed", 80), (2, "claimed", 2000), (None, "done", 60)],
        [(2, "claimed", 4000), (2, "claimed", 6000), (2**60 + 1, "claimed", 7200)],
        [(2**60 + 1, "done", 7300)],
    ]
    stream = events(spark, str(tmp_path / "in"), rows)
    out = jobs.leases(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log"))
    table = spark.createDataFrame([(j, e, START + timedelta(seconds=s)) for batch in rows for j, e, s in batch], "job_id long, event string, at timestamp")
    want = sorted(map(str, jobs.lease_history(table, int((START.timestamp() + 7300 - 600) * 1000)).collect()))
    out.trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == want
    one = jobs.leases(stream, groups=1).writeStream.format("parquet").option("path", str(tmp_path / "one")).option("checkpointLocation", str(tmp_path / "one-log"))
    query = one.trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "one")).collect())) == want
    # five jobs, one row of state
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) == 1


def test_leases_of_events_whose_ids_are_not_in_order_of_time(spark, tmp_path):
    """The waves of the query are in order of time, so no event is behind the watermark of an earlier one."""
    import __spark_entry__

    rows = [(n, 1 + n % 7, ("click", "view", "error")[n % 3], START + timedelta(hours=7 * (1200 - n))) for n in range(1200)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    got, want = (sorted(map(str, __spark_entry__.queries()[q](spark, str(tmp_path)).collect())) for q in ("st4_job_leases", "st4_lease_history"))
    assert got == want and len(got) > 400


def test_documents_of_one_file_are_dealt(spark, tmp_path):
    """A batch of one file is extracted by as many tasks as there are partitions, and a document by one."""
    source = str(tmp_path / "in")
    spark.createDataFrame([(k % 40, "name: x") for k in range(80)], "doc_id long, text string").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("doc_id long, text string").parquet(source)
    extracted = jobs.extract_stream(stream, lambda batch: batch.select("doc_id", F.spark_partition_id().alias("part")), str(tmp_path / "out"), str(tmp_path / "log"))
    extracted.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "part").distinct().collect()
    assert len(got) == 40 and len({r.part for r in got}) > 2
