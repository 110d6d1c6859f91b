"""Queries of the catalogue matcher and of loads, audits and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions import dates, keys
from loomwork.operators import aggregates, joins, match, merges, select, verify, windows
from loomwork.plans import views
from loomwork.plans.aggregate_queries import DOB_KEY, effective
from loomwork.plans.registry import registry
from loomwork.plans.select_queries import EFFECTIVE, MONTH
from loomwork.plans.views import with_views

QUERIES, query = registry()


@query(
    with_views("docs", "people")
    + f""", i as (select document_id, case when family is not null then sha256(lower(trim(family)) || '|' || lower(trim(given)) || '|' || {DOB_KEY})[1:16] end as identity_id from people),
  e as (select event_id, '/in/' || (['BUILDING', 'MACHINERY', 'FURNITURE'])[(event_id % 3 + 1)::int] || '/Customer#' || lpad((user_id)::varchar, 9, '0') as path from events)
select event_id, docs.id as document_id, identity_id from e left join docs on original_path = path left join i on i.document_id = docs.id"""
)
def j7_attach_identity(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").selectExpr("event_id", "concat('/in/', element_at(array('BUILDING', 'MACHINERY', 'FURNITURE'), cast(event_id % 3 as int) + 1), '/Customer#', lpad(user_id, 9, '0')) as path")
    named = aggregates.identify(views.people(spark, sf_dir))
    return joins.attach_identity(e, views.docs(spark, sf_dir), named).select("event_id", "document_id", "identity_id")


@query(
    """with b as (select s_suppkey * 3 as path, case when s_suppkey % 2 = 0 then 'verified' else 'unverified' end as bucket from supplier)
select p_partkey, coalesce(bucket = 'verified', p_size > 25) as verified from part left join b on path = p_partkey"""
)
def j13_apply_buckets(spark, sf_dir):
    e = views.table(spark, sf_dir, "part").selectExpr("p_partkey as path", "p_partkey", "p_size > 25 as verified")
    b = views.table(spark, sf_dir, "supplier").selectExpr("s_suppkey * 3 as path", "case when s_suppkey % 2 = 0 then 'verified' else 'unverified' end as bucket")
    return joins.apply_buckets(e, b).select("p_partkey", "verified")


@query(
    with_views("docs", "extractions", "jobs")
    + """, h as (select count(*) as documents, count(*) filter (where id not in (select document_id from extractions)) as without_extraction, count(*) filter (where status = 'failed') as failed,
  (select count(*) from jobs where status = 'processing') as in_work from docs)
select *, concat_ws(',', case when without_extraction > 0 then 'missing_extractions' end, case when failed * 5 > documents then 'many_failures' end) as warnings from h"""
)
def a25_health(spark, sf_dir):
    return aggregates.health(views.docs(spark, sf_dir), views.extractions(spark, sf_dir), views.jobs(spark, sf_dir))


@query(
    "select l_orderkey as doc_id, l_returnflag as folder, l_linenumber as page, count(*) as crops, max(l_suppkey) as best, string_agg(l_suppkey::varchar, ';' order by l_suppkey::varchar) as scores from lineitem group by all"
)
def a28_regroup_evidence(spark, sf_dir):
    crops = views.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as doc_id", "l_returnflag as folder", "l_linenumber as page", "l_suppkey as score")
    return aggregates.regroup_evidence(crops)


@query(
    with_views("fields")
    + """, c as (select (['family_name', 'given_names', 'bsb'])[(r_regionkey + 1)::int] as field_name, 3 - r_regionkey as number from region where r_regionkey < 3),
  f as (select distinct extraction_id as doc_id, field_name from fields)
select doc_id, field_name, row_number() over (partition by doc_id order by number nulls last, field_name)::int as place from f left join c using (field_name)"""
)
def w11_catalogue_order(spark, sf_dir):
    c = views.table(spark, sf_dir, "region").where("r_regionkey < 3").selectExpr("element_at(array('family_name', 'given_names', 'bsb'), r_regionkey + 1) as field_name", "3 - r_regionkey as number")
    f = views.fields(spark, sf_dir).select(F.col("extraction_id").alias("doc_id"), "field_name").distinct()
    return windows.catalogue_order(f, c).select("doc_id", "field_name", "place")


@query("with p as (select user_id as path, count(*) as pages from events group by 1) select path, pages from p order by pages, path limit 20")
def w13_smallest_first(spark, sf_dir):
    return windows.smallest_first(views.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("path")).agg(F.count("*").alias("pages")), 20)


@query(
    """with f as (select c_custkey as doc_id, (c_custkey % 700)::varchar as value, case when c_custkey % 8 = 0 then 'fixed' end as corrected_value from customer where c_custkey % 3 > 0),
  s as (select o_custkey as doc_id, max((o_custkey % 500))::varchar as score from orders group by 1),
  j as (select coalesce(f.doc_id, s.doc_id) as doc_id, value as old, corrected_value, score as new from f full outer join s on f.doc_id = s.doc_id),
  a as (select *, case when new is null then 'kept' when corrected_value is not null then 'skipped' when old is null then 'inserted' when old = new then 'unchanged' else 'updated' end as action from j)
select doc_id, action, case when action in ('inserted', 'updated') then new else coalesce(corrected_value, old) end as value from a"""
)
def m8_load_scores(spark, sf_dir):
    f = views.table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").selectExpr("c_custkey as doc_id", "cast(c_custkey % 700 as string) as value", "case when c_custkey % 8 = 0 then 'fixed' end as corrected_value")
    s = views.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.max(F.col("o_custkey") % 500).cast("string").alias("score"))
    return merges.load_scores(f, s)


@query(
    with_views("docs")
    + """, r as (select distinct sha256((o_orderkey % 1400)::varchar) as content_hash, o_orderpriority as field_name, 'x' as value, case when o_orderkey % 7 = 0 then 'junk' else 'ok' end as verif from orders)
select distinct sha256('doc|' || content_hash)[1:16] as document_id, sha256('field|' || content_hash || '|' || field_name)[1:16] as field_id, field_name, value from r where verif = 'ok' and content_hash not in (select content_hash from docs)"""
)
def m9_load_verified(spark, sf_dir):
    r = views.table(spark, sf_dir, "orders").selectExpr("sha2(cast(o_orderkey % 1400 as string), 256) as content_hash", "o_orderpriority as field_name", "'x' as value", "case when o_orderkey % 7 = 0 then 'junk' else 'ok' end as verif")
    return merges.load_verified(r, views.docs(spark, sf_dir))


@query("select count(*) as row_count, true as same, true as differs from customer")
def m10_fingerprint(spark, sf_dir):
    """The fingerprint of a table does not depend on the order of its rows, and does on the rule."""
    c = views.table(spark, sf_dir, "customer")
    a = merges.fingerprint(c, "v1").select("row_count", F.col("fingerprint").alias("a"))
    b = merges.fingerprint(c.repartition(3, "c_nationkey"), "v1").select(F.col("fingerprint").alias("b"))
    d = merges.fingerprint(c, "v2").select(F.col("fingerprint").alias("d"))
    # three single rows
    return a.join(F.broadcast(b)).join(F.broadcast(d)).select("row_count", (F.col("a") == F.col("b")).alias("same"), (F.col("a") != F.col("d")).alias("differs"))


@query(
    with_views("docs")
    + """, k as (select c_custkey as id, (['pdf', 'text', 'text', 'program', 'office'])[((c_custkey + c_nationkey) % 5 + 1)::int] as kind from customer where c_custkey % 10 > 0),
  c as (select docs.id, status, kind, (['pdf', 'image', 'text', 'other', 'office'])[(docs.id % 5 + 1)::int] as category from docs left join k using (id)),
  b as (select *, kind is not null and (category = 'other' or category <> kind) as changed from c)
select id, case when changed then 'failed' else status end as status, changed from b"""
)
def m16_reaudit(spark, sf_dir):
    k = views.table(spark, sf_dir, "customer").where("c_custkey % 10 > 0").selectExpr("c_custkey as id", "element_at(array('pdf', 'text', 'text', 'program', 'office'), cast((c_custkey + c_nationkey) % 5 as int) + 1) as kind")
    return merges.reaudit(views.docs(spark, sf_dir), k)


@query(
    """with m as (select c_custkey as id, '/in/' || c_name as path, '/q/' || c_name as target from customer),
  l as (select '/q/' || c_name as path from customer where c_custkey % 4 > 0 union all select '/in/' || c_name from customer where c_custkey % 6 = 0)
select target as "from", path as "to" from m where target in (select path from l) and path not in (select path from l)"""
)
def v24_restore_plan(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer")
    m = c.selectExpr("c_custkey as id", "concat('/in/', c_name) as path", "concat('/q/', c_name) as target")
    listing = c.where("c_custkey % 4 > 0").selectExpr("concat('/q/', c_name) as path").union(c.where("c_custkey % 6 = 0").selectExpr("concat('/in/', c_name)"))
    return verify.restore_plan(m, listing)


@query(
    with_views("index")
    + f""", m as (select id, {MONTH} as month from idx) select id, strftime(month, '%Y-%m-01') as canonical, strftime(month, '%m/%Y') as display, ((year(month) - 2030) * 12 + month(month) - 6)::int as months from m"""
)
def v11_expiry_forms(spark, sf_dir):
    month = dates.expiry_month(F.col("expiry"))
    return views.index(spark, sf_dir).select(
        "id", F.date_format(month, "yyyy-MM-dd").alias("canonical"), F.date_format(month, "MM/yyyy").alias("display"), dates.months_until(month, F.lit("2030-06-15").cast("date")).alias("months")
    )


@query(
    """with v as (select o_orderkey, case when o_orderkey % 2 = 0 then 'passport' else 'licence' end as kind, case when o_orderkey % 2 = 0 then 'N' || lpad((o_orderkey % 1000)::varchar, (5 + o_orderkey % 4)::int, '0') else lpad((o_orderkey % 1000)::varchar, (6 + o_orderkey % 3)::int, '7') end as canonical, o_custkey % 3 as sources from orders)
select o_orderkey, canonical, case when (kind = 'passport' and not regexp_matches(canonical, '^[A-Z]{1,2}[0-9]{6,8}$')) or (kind = 'licence' and not regexp_matches(canonical, '^[A-Z0-9]{7,10}$')) then 'format_fail' when sources >= 2 then 'triple_checked' else 'single_source' end as tier from v"""
)
def v10_identifier_tier(spark, sf_dir):
    raw = F.expr("case when o_orderkey % 2 = 0 then concat('gbr n', lpad(o_orderkey % 1000, cast(5 + o_orderkey % 4 as int), '0')) else concat(lpad(o_orderkey % 1000, cast(6 + o_orderkey % 3 as int), '7'), ' ; other') end")
    kind = F.when(F.col("o_orderkey") % 2 == 0, "passport").otherwise("licence")
    canon = keys.identifier(raw)
    return views.table(spark, sf_dir, "orders").select("o_orderkey", canon.alias("canonical"), keys.tier(kind, canon, F.col("o_custkey") % 3).alias("tier"))


@query(
    """with e as (select user_id as doc_id, case when event_type = 'click' then 'person' when event_type = 'view' then 'organisation' else 'place' end as kind, event_id as pos, 'Ann Lee ' || event_id as text from events),
  f as (select doc_id, min_by(text, pos) filter (where kind = 'person') as person, min_by(text, pos) filter (where kind = 'organisation') as employer from e group by 1)
select c_custkey as doc_id, case when person is not null then 'Ann' end as given_names, person[5:] as family_name, employer from customer left join f on doc_id = c_custkey"""
)
def x7_entity_slots(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").selectExpr("user_id as doc_id", "case when event_type = 'click' then 'person' when event_type = 'view' then 'organisation' else 'place' end as kind", "event_id as pos", "concat('Ann Lee ', event_id) as text")
    return match.entity_slots(views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id")), e)


def matched_lines(spark, sf_dir):
    lines = views.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as doc_id", "l_partkey * 1000 + l_suppkey as line_no", "concat(element_at(array('Income: ', 'Rate - ', 'Income '), cast(l_linenumber % 3 as int) + 1), case when l_returnflag = 'N' then '' else cast(l_suppkey as string) end) as line"
    )
    return match.candidates(lines, [("income", "income", "[0-9]+"), ("rate", "rate", "[0-9]+")])


MATCHED = """l as (select l_orderkey as doc_id, l_partkey * 1000 + l_suppkey as line_no, case when l_linenumber % 3 = 1 then 'rate' else 'income' end as field_name, case when l_returnflag <> 'N' then l_suppkey::varchar end as value from lineitem)"""


@query(f"with {MATCHED} select doc_id, line_no, field_name, value from l")
def x8_catalogue_candidates(spark, sf_dir):
    return matched_lines(spark, sf_dir)


@query(
    f"""with {MATCHED}, r as (select *, row_number() over (partition by doc_id, field_name order by case when value is not null then length(value) end desc nulls last, line_no, value) as n from l),
  c as (select doc_id, field_name, count(distinct value) as vs from l group by all)
select doc_id, field_name, value, case when vs = 0 then 'missing' when vs = 1 then 'matched' else 'ambiguous' end as status from r join c using (doc_id, field_name) where n = 1"""
)
def x9_candidate_choice(spark, sf_dir):
    return match.choose(matched_lines(spark, sf_dir), F.length("value"))


@query("select o_orderkey, case when o_orderkey % 3 < 2 then lpad((o_custkey % 10000)::varchar, 4, '0') end as postcode from orders")
def x11_postcode_context(spark, sf_dir):
    text = F.expr("concat('at ', case o_orderkey % 3 when 0 then 'Town VIC ' when 1 then 'Postcode: ' else 'number ' end, lpad(o_custkey % 10000, 4, '0'), '.')")
    return views.table(spark, sf_dir, "orders").select("o_orderkey", match.postcode_by_context(text).alias("postcode"))


@query(
    with_views("fields")
    + f""", e as (select extraction_id, seq, field_name, {EFFECTIVE} as value from fields)
select extraction_id, seq, field_name, (case when value is null then 0 when field_name in ('passport_number', 'licence_number') then 0.9 when field_name = 'date_of_birth' then 0.9 else 0.7 end)::double as score from e"""
)
def x13_confidence(spark, sf_dir):
    kind = F.when(F.col("field_name").isin("passport_number", "licence_number"), "identifier").when(F.col("field_name") == "date_of_birth", "date").otherwise("text")
    return effective(spark, sf_dir).select("extraction_id", "seq", "field_name", match.confidence(kind, F.col("value")).cast("double").alias("score"))


@query(
    """with f as (select o_orderkey as doc_id, 'postcode' as field_name, (2000 + o_custkey % 6000)::varchar as value, o_custkey % 100 / 100.0::double as confidence from orders union all select o_orderkey, 'state', case when o_custkey % 5 > 0 then (['VIC', 'qld', 'SA'])[(o_orderkey % 3 + 1)::int] end, 0.5 from orders),
  s as (select *, max(upper(value)) filter (where field_name = 'state') over (partition by doc_id) as doc_state from f),
  p as (select *, case when value::int between 3000 and 3999 then 'VIC' when value::int between 4000 and 4999 then 'QLD' when value::int between 5000 and 5999 then 'SA' when value::int between 6000 and 6999 then 'WA' when value::int between 7000 and 7999 then 'TAS'
    when value::int between 2600 and 2618 or value::int between 2900 and 2920 then 'ACT' else 'NSW' end as own from s where field_name = 'postcode')
select doc_id, doc_state, round(case when doc_state is null then confidence when own = doc_state then least(0.99, confidence + 0.03) else greatest(0.45, confidence - 0.25) end, 6) as confidence from p"""
)
def x15_state_context(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    a = o.selectExpr("o_orderkey as doc_id", "'postcode' as field_name", "cast(2000 + o_custkey % 6000 as string) as value", "(o_custkey % 100) / 100D as confidence")
    b = o.selectExpr("o_orderkey as doc_id", "'state' as field_name", "case when o_custkey % 5 > 0 then element_at(array('VIC', 'qld', 'SA'), cast(o_orderkey % 3 as int) + 1) end as value", "0.5D as confidence")
    return match.with_state_context(a.union(b)).where("field_name = 'postcode'").select("doc_id", "doc_state", F.round("confidence", 6).alias("confidence"))


@query(
    """select event_id as doc_id, 'k' as field_name, event_type as value, (greatest(0.0, least(1.0, coalesce(value / 20, 0.5))))::double as confidence, case when event_type in ('spouse') then event_type else 'other' end as subject from events where event_id % 4 > 0"""
)
def x18_sanitised(spark, sf_dir):
    r = views.table(spark, sf_dir, "events").selectExpr("event_id as doc_id", "case when event_id % 4 > 0 then ' k ' else ' ' end as field_name", "event_type as value", "value / 20 as confidence", "event_type as subject")
    return match.sanitised(r)


@query(
    with_views("people")
    + f""", i as (select *, case when family is not null then sha256(lower(trim(family)) || '|' || lower(trim(given)) || '|' || {DOB_KEY})[1:16] end as identity_id from people)
select identity_id, min(trim(family)) as family, min(given) as given, count(*) as documents, min(document_id) as first_document from i where identity_id is not null and document_id in (select o_custkey from orders) group by 1"""
)
def snk2_identity_export(spark, sf_dir):
    named = aggregates.identify(views.people(spark, sf_dir)).where("identity_id is not null")
    chosen = select.select_ids(named, views.table(spark, sf_dir, "orders").select("o_custkey"), "document_id")
    return chosen.groupBy("identity_id").agg(F.min(F.trim("family")).alias("family"), F.min("given").alias("given"), F.count("*").alias("documents"), F.min("document_id").alias("first_document"))
