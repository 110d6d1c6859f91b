"""Queries of joins, windows and queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions.checks import digits
from loomwork.operators import joins, queue, verify, windows
from loomwork.plans import views
from loomwork.plans.registry import registry
from loomwork.plans.views import with_views

QUERIES, query = registry()
LATEST = "(select * from (select *, row_number() over (partition by document_id order by created_at desc, id desc) as n from extractions) where n = 1)"


@query(with_views("docs", "extractions") + f" select docs.id, e.id as extraction_id, e.created_at, e.raw_text from docs left join {LATEST} e on e.document_id = docs.id")
def j1_latest_extraction(spark, sf_dir):
    out = joins.latest_extraction(views.docs(spark, sf_dir), views.extractions(spark, sf_dir))
    return out.select("id", "extraction_id", "created_at", "raw_text")


@query(
    with_views("extractions", "fields")
    + f" select extraction_id, field_name, field_value, seq from fields where field_name in ('bsb', 'postcode') and extraction_id in (select id from {LATEST})"
)
def j2_latest_fields(spark, sf_dir):
    out = joins.latest_fields(views.extractions(spark, sf_dir), views.fields(spark, sf_dir), ["bsb", "postcode"])
    return out.select("extraction_id", "field_name", "field_value", "seq")


@query(with_views("jobs", "docs") + " select jobs.id, jobs.status, docs.filename from jobs join docs on docs.id = jobs.document_id where jobs.status = 'queued'")
def j3_jobs_documents(spark, sf_dir):
    j, d = views.jobs(spark, sf_dir).where("status = 'queued'"), views.docs(spark, sf_dir).select(F.col("id").alias("document_id"), "filename")
    return j.join(d, "document_id").select("id", "status", "filename")


@query(
    with_views("docs")
    + """, r as (select content_hash, count(*) as matches, min(id) as doc from docs group by 1),
  l as (select s_suppkey, sha256((s_suppkey * 13)::varchar) as content_hash from supplier)
select s_suppkey, coalesce(matches, 0) as matches, case when matches = 1 then doc end as id from l left join r using (content_hash)"""
)
def j4_unique_match(spark, sf_dir):
    left = views.table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "sha2(cast(s_suppkey * 13 as string), 256) as content_hash")
    return joins.unique_match(left, views.docs(spark, sf_dir).select("id", "content_hash"), "content_hash").select("s_suppkey", "matches", "id")


@query(
    with_views("docs")
    + """, l as (select s_suppkey, sha256((s_suppkey * 13)::varchar) as content_hash from supplier)
select count(*) filter (where content_hash in (select content_hash from docs)) as matched, count(*) filter (where content_hash not in (select content_hash from docs)) as unmatched from l"""
)
def j5_match_counts(spark, sf_dir):
    left = views.table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "sha2(cast(s_suppkey * 13 as string), 256) as content_hash")
    known = views.docs(spark, sf_dir).select("content_hash").distinct().withColumn("hit", F.lit(True))
    return left.join(known, "content_hash", "left").agg(F.count_if(F.col("hit")).alias("matched"), F.count_if(F.col("hit").isNull()).alias("unmatched"))


@query(
    with_views("docs")
    + """, l as (select s_suppkey, '/in/' || (['BUILDING', 'MACHINERY'])[(s_suppkey % 2 + 1)::int] || '/Customer#' || lpad(s_suppkey::varchar, 9, '0') as original_path, sha256((s_suppkey * 7)::varchar) as content_hash from supplier),
  p as (select original_path, min(id) as one from docs group by 1), h as (select content_hash, min(id) as two from docs group by 1)
select s_suppkey, coalesce(one, two) as id, case when one is not null then 'original_path' when two is not null then 'content_hash' end as matched_by
from l left join p using (original_path) left join h using (content_hash)"""
)
def j6_fallback_match(spark, sf_dir):
    left = views.table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey",
        "concat('/in/', element_at(array('BUILDING', 'MACHINERY'), cast(s_suppkey % 2 as int) + 1), '/Customer#', lpad(s_suppkey, 9, '0')) as original_path",
        "sha2(cast(s_suppkey * 7 as string), 256) as content_hash",
    )
    right = views.docs(spark, sf_dir).select("id", "original_path", "content_hash")
    return joins.fallback_match(left, right, "original_path", "content_hash", "id").select("s_suppkey", "id", "matched_by")


RUN_LOG = "(select l_partkey as file, l_returnflag = 'A' and l_tax < 0.02 as ok, l_returnflag = 'R' and l_tax > 0.07 as fatal from lineitem)"
TERMINAL = f"""(select file, case when bool_or(ok) then 'ok' when bool_or(fatal) then 'fatal' when count(*) filter (where not ok and not fatal) >= 2 then 'struck_out' end as reason from {RUN_LOG} group by file)"""


def run_log(spark, sf_dir):
    return views.table(spark, sf_dir, "lineitem").selectExpr("l_partkey as file", "l_returnflag = 'A' and l_tax < 0.02 as ok", "l_returnflag = 'R' and l_tax > 0.07 as fatal")


@query(f"select p_partkey as file from part where p_partkey not in (select file from {TERMINAL} where reason is not null)")
def j8_pending(spark, sf_dir):
    files = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"))
    return joins.pending(files, run_log(spark, sf_dir))


@query(f"select file, reason is not null as done, reason from {TERMINAL}")
def q3_terminal(spark, sf_dir):
    return joins.terminal(run_log(spark, sf_dir))


@query(
    with_views("docs")
    + """, i as (select o_orderkey as id, sha256((o_orderkey % 1500)::varchar) as content_hash from orders),
  f as (select * from (select *, row_number() over (partition by content_hash order by id) as n from i) where n = 1)
select content_hash, id from f where content_hash not in (select content_hash from docs)"""
)
def j9_insert_new(spark, sf_dir):
    incoming = views.table(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "sha2(cast(o_orderkey % 1500 as string), 256) as content_hash")
    return joins.insert_new(views.docs(spark, sf_dir), incoming, "content_hash", "id").select("content_hash", "id")


@query(
    """with f as (select c_custkey as id, sha256(c_name)[1:12] as key from customer),
  l as (select sha256('Customer#' || lpad((s_suppkey * 3)::varchar, 9, '0'))[1:12] as key, (['photo', 'form', 'blank'])[(s_suppkey % 3 + 1)::int] as kind from supplier)
select id, kind from f left join l using (key) where kind is null or kind not in ('photo', 'blank')"""
)
def j10_labels(spark, sf_dir):
    files = views.table(spark, sf_dir, "customer").selectExpr("c_custkey as id", "substring(sha2(c_name, 256), 1, 12) as key")
    labels = views.table(spark, sf_dir, "supplier").selectExpr(
        "substring(sha2(concat('Customer#', lpad(s_suppkey * 3, 9, '0')), 256), 1, 12) as key", "element_at(array('photo', 'form', 'blank'), cast(s_suppkey % 3 as int) + 1) as kind"
    )
    return joins.apply_labels(files, labels, ["photo", "blank"]).select("id", "kind")


@query(
    """with f as (select o_orderkey as doc_id, o_orderpriority as value, o_custkey % 100 / 100.0 as confidence from orders),
  v as (select c_custkey as doc_id, (['corrected', 'confirmed', 'unresolved'])[(c_custkey % 3 + 1)::int] as verdict, c_mktsegment as new_value from customer)
select doc_id, case when verdict = 'corrected' then new_value else value end as value,
  (case verdict when 'corrected' then greatest(confidence, 0.75) when 'confirmed' then greatest(confidence, 0.90) else confidence end)::double as confidence
from f left join v using (doc_id)"""
)
def j11_apply_verdicts(spark, sf_dir):
    f = views.table(spark, sf_dir, "orders").selectExpr("o_orderkey as doc_id", "o_orderpriority as value", "(o_custkey % 100) / 100D as confidence")
    v = views.table(spark, sf_dir, "customer").selectExpr("c_custkey as doc_id", "element_at(array('corrected', 'confirmed', 'unresolved'), cast(c_custkey % 3 as int) + 1) as verdict", "c_mktsegment as new_value")
    return joins.apply_verdicts(f, v, ["doc_id"]).select("doc_id", "value", "confidence")


@query(
    with_views("docs")
    + """, s as (select o_custkey * 2 as id, 'failed' as verdict from orders group by 1)
select s.id, original_path as path, case when original_path is null then 'no_document' when not starts_with(original_path, '/in/') then 'outside_root' when status <> 'failed' then 'other_status' end as skip,
  case when status = 'failed' then '/quarantine/' || substr(original_path, 5) end as target from s left join docs using (id)"""
)
def j12_move_plan(spark, sf_dir):
    s = views.table(spark, sf_dir, "orders").selectExpr("o_custkey * 2 as id").distinct()
    d = views.docs(spark, sf_dir).select("id", F.col("original_path").alias("path"), "status")
    return verify.move_plan(s, d, "/in/", "/quarantine/", "failed")


@query(
    """with m as (select l_orderkey as doc_id, l_linenumber * 10 as s, l_linenumber * 10 + 6 as e, l_partkey as p from lineitem where l_returnflag <> 'R'),
  c as (select l_orderkey as doc_id, l_linenumber * 10 + 3 as s, l_linenumber * 10 + 12 as e from lineitem where l_returnflag = 'R' and l_tax > 0.05)
select doc_id, p from m where not exists (select 1 from c where c.doc_id = m.doc_id and m.s < c.e and m.e > c.s)"""
)
def j17_span_anti_join(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem")
    m = rows.where("l_returnflag <> 'R'").selectExpr("l_orderkey as doc_id", "l_linenumber * 10 as s", "l_linenumber * 10 + 6 as e", "l_partkey as p")
    c = rows.where("l_returnflag = 'R' and l_tax > 0.05").selectExpr("l_orderkey as doc_id", "l_linenumber * 10 + 3 as s", "l_linenumber * 10 + 12 as e")
    return joins.drop_overlaps(m, c).select("doc_id", "p")


@query(
    """with n as (select lpad((n_nationkey * 41)::varchar, 3, '0') as prefix, n_name as name from nation union all select lpad((n_nationkey * 3)::varchar, 2, '0'), n_name || '*' from nation),
  o as (select o_orderkey, lpad((o_orderkey * 137 % 1000000)::varchar, 6, '0') as bsb from orders)
select o_orderkey, coalesce(a.name, b.name) as institution from o left join n a on length(a.prefix) = 3 and a.prefix = bsb[1:3] left join n b on length(b.prefix) = 2 and b.prefix = bsb[1:2]"""
)
def j18_prefix_lookup(spark, sf_dir):
    n = views.table(spark, sf_dir, "nation")
    prefixes = n.selectExpr("lpad(n_nationkey * 41, 3, '0') as prefix", "n_name as name").union(n.selectExpr("lpad(n_nationkey * 3, 2, '0')", "concat(n_name, '*')"))
    o = views.table(spark, sf_dir, "orders").selectExpr("o_orderkey", "lpad(o_orderkey * 137 % 1000000, 6, '0') as bsb")
    return joins.longest_prefix(o, digits(F.col("bsb")), prefixes).select("o_orderkey", "institution")


@query(
    with_views("fields")
    + """, c as (select (['family_name', 'given_names', 'bsb', 'postcode'])[(r_regionkey + 1)::int] as field_name, r_regionkey as number from region where r_regionkey < 4)
select number, field_name, count(*) as n from fields join c using (field_name) group by all"""
)
def j19_catalogue(spark, sf_dir):
    c = views.table(spark, sf_dir, "region").where("r_regionkey < 4").selectExpr("element_at(array('family_name', 'given_names', 'bsb', 'postcode'), r_regionkey + 1) as field_name", "r_regionkey as number")
    return joins.with_catalogue(views.fields(spark, sf_dir), c).groupBy("number", "field_name").agg(F.count("*").alias("n"))


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def j20_missing(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return joins.missing(views.table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey")


@query(
    """with f as (select user_id as doc_id, case when event_type = 'click' then 'other' else 'applicant' end as subject, trunc(value)::bigint as value from events),
  s as (select doc_id, value, count(*) as n from f where subject = 'applicant' group by all)
select doc_id, value from s where n = 1 and (doc_id, value) in (select (doc_id, value) from f where subject <> 'applicant')"""
)
def j16_collisions(spark, sf_dir):
    f = views.table(spark, sf_dir, "events").selectExpr("user_id as doc_id", "case when event_type = 'click' then 'other' else 'applicant' end as subject", "cast(value as bigint) as value")
    return joins.collisions(f).select("doc_id", "value")


@query(with_views("extractions") + f" select document_id, id, score from {LATEST}")
def w1_latest(spark, sf_dir):
    return windows.latest(views.extractions(spark, sf_dir), ["document_id"], [F.desc("created_at"), F.desc("id")]).select("document_id", "id", "score")


@query("select user_id, event_id, value from (select *, row_number() over (partition by user_id order by event_id desc) as n from events where event_type <> 'error') where n = 1")
def w2_last_usable(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").select("user_id", "event_id", "value", "event_type")
    return windows.last_rows(rows, "user_id", "event_id", F.col("event_type") != "error").select("user_id", "event_id", "value")


@query(
    with_views("jobs", "docs")
    + """ select j.id as job_id, j.document_id, ends_with(lower(filename), '.pdf') as is_pdf, started_at from jobs j join docs on docs.id = j.document_id
where j.status = 'queued' order by is_pdf, started_at, job_id limit 100"""
)
def w3_claim_plan(spark, sf_dir):
    return windows.claim_plan(views.jobs(spark, sf_dir), views.docs(spark, sf_dir), 100)


FILES = "(select c_custkey as id, (c_custkey % 3)::int as root_rank, '/r' || (c_custkey % 3) || '/' || c_name as path, (c_custkey % 211)::bigint as bytes, sha256((c_custkey % 633)::varchar) as sha256 from customer)"


@query(
    f"""with f as {FILES}, k as (select *, first_value(path) over (partition by bytes, sha256 order by root_rank, length(path), path) as keeper, count(*) over (partition by bytes, sha256) as copies from f)
select id, path, keeper, copies, case when path = keeper then 'keep' else 'duplicate' end as action from k"""
)
def w4_duplicate_plan(spark, sf_dir):
    f = views.table(spark, sf_dir, "customer").selectExpr("c_custkey as id", "cast(c_custkey % 3 as int) as root_rank", "concat('/r', c_custkey % 3, '/', c_name) as path", "c_custkey % 211 as bytes", "sha2(cast(c_custkey % 633 as string), 256) as sha256")
    return windows.duplicate_plan(f).select("id", "path", "keeper", "copies", "action")


@query(
    """with f as (select p_partkey as id, (case when p_partkey % 2 = 0 then p_name else upper(p_name) end) || (p_partkey % 40) || '.pdf' as name, '/x/' || p_partkey as path from part),
  n as (select *, count(*) over (partition by lower(name)) as c from f)
select id, case when c > 1 then regexp_extract(name, '^(.*?)(\\.[^.]*)?$', 1) || '~' || sha256(path)[1:8] || '.pdf' else name end as target from n"""
)
def w5_collision_names(spark, sf_dir):
    f = views.table(spark, sf_dir, "part").selectExpr("p_partkey as id", "concat(case when p_partkey % 2 = 0 then p_name else upper(p_name) end, p_partkey % 40, '.pdf') as name", "concat('/x/', p_partkey) as path")
    return windows.collision_names(f).select("id", "target")


@query(
    """with l as (select doc_id, unnest(range(len(string_split(text, chr(10))))) as line_no, string_split(text, chr(10)) as ls from documents),
  t as (select doc_id, line_no::int as line_no, ls[line_no + 1] as line from l)
select doc_id, line_no, last_value(case when length(line) < 20 then line end ignore nulls) over (partition by doc_id order by line_no) as section from t"""
)
def w6_sections(spark, sf_dir):
    lines = views.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return windows.with_sections(lines, F.length("line") < 20).select("doc_id", "line_no", "section")


@query("select user_id, event_id, row_number() over (partition by user_id, event_type order by ts, event_id)::int as entry from events")
def w9_owner_number(spark, sf_dir):
    return windows.numbered(views.table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.asc("ts"), F.asc("event_id")], "entry").select("user_id", "event_id", "entry")


READINGS = "(select l_orderkey as doc_id, l_linenumber % 3 as field_name, l_discount as confidence, l_partkey * 1000 + l_suppkey as seq, l_quantity as value from lineitem)"


@query(f"select doc_id, field_name, confidence, seq from (select *, row_number() over (partition by doc_id, field_name order by confidence desc, seq) as n from {READINGS}) where n = 1")
def w10_best_reading(spark, sf_dir):
    r = views.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as doc_id", "l_linenumber % 3 as field_name", "l_discount as confidence", "l_partkey * 1000 + l_suppkey as seq", "l_quantity as value")
    return windows.best_reading(r).select("doc_id", "field_name", "confidence", "seq")


PASSES = "(select l_orderkey % 500 as doc_id, l_linenumber as pass, l_suppkey % 12 as field_name, case when l_tax > 0.01 then l_partkey end as value from lineitem)"


def passes(spark, sf_dir):
    return views.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 500 as doc_id", "l_linenumber as pass", "l_suppkey % 12 as field_name", "case when l_tax > 0.01 then l_partkey end as value")


PASS_LOG = f"""f as (select doc_id, field_name, min(pass) as pass from {PASSES} where value is not null group by all),
  d as (select doc_id, pass, count(*) as delta from f group by all),
  p as (select distinct doc_id, pass from {PASSES}),
  g as (select p.doc_id, p.pass, coalesce(delta, 0) as delta from p left join d using (doc_id, pass)),
  w as (select *, sum(delta) over (partition by doc_id order by pass)::bigint as filled, lag(delta) over (partition by doc_id order by pass) as before from g),
  lg as (select doc_id, pass, delta, filled, before, round(filled * 100 / 12, 1) as recall from w)"""


@query(f"with {PASS_LOG} select doc_id, pass, delta, filled, recall from lg")
def w12_pass_log(spark, sf_dir):
    return windows.pass_log(passes(spark, sf_dir), 12).select("doc_id", "pass", "delta", "filled", "recall")


@query(
    f"""with {PASS_LOG} select doc_id, min(case when (delta = 0 and before = 0 and pass >= 3) or (recall >= 95 and pass >= 4) then pass end) as stop_pass, max(pass) as last_pass from lg group by 1"""
)
def m2_stop_pass(spark, sf_dir):
    return windows.stop_pass(windows.pass_log(passes(spark, sf_dir), 12))


@query(
    """with e as (select user_id as identity_id, event_id as doc_id, 1 as page, value > 30 as verified from events),
  p as (select *, row_number() over (partition by identity_id order by verified desc, doc_id, page)::int as place from e) select identity_id, doc_id, place, verified and place = 1 as thumbnail from p"""
)
def w8_gallery(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").selectExpr("user_id as identity_id", "event_id as doc_id", "1 as page", "value > 30 as verified")
    return windows.gallery(e).select("identity_id", "doc_id", "place", "thumbnail")


@query(
    with_views("jobs")
    + """ select id, case when attempts >= 3 then 'fail' else 'requeue' end as action from jobs where status = 'processing' and started_at < timestamp '1998-06-01 00:00:00' - interval 900 second"""
)
def q2_expire_leases(spark, sf_dir):
    return queue.expire_leases(views.jobs(spark, sf_dir), "1998-06-01 00:00:00")


@query(
    """with e as (select event_id, user_id * 7 + event_id % 5 as job_id, case when value > 10 then 'completed' else 'failed' end as outcome from events),
  f as (select *, first_value(outcome) over (partition by job_id order by event_id) as first_outcome, row_number() over (partition by job_id order by event_id) as n from e)
select event_id, case when n = 1 then 'accepted' when outcome = first_outcome then 'repeat' else 'conflict' end as state from f"""
)
def u6_first_results(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").selectExpr("event_id", "user_id * 7 + event_id % 5 as job_id", "case when value > 10 then 'completed' else 'failed' end as outcome")
    return queue.first_results(e, "job_id", "event_id", "outcome").select("event_id", "state")
