"""Queries of merges and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import merges, sets
from loomwork.plans import views
from loomwork.plans.registry import registry

QUERIES, query = registry()
PASSES = "(select l_orderkey % 800 as doc_id, l_suppkey % 9 as field_name, l_partkey * 1000 + l_suppkey * 10 + l_linenumber as pass, case when l_quantity > 10 then 'v' || (l_partkey % 30) else '' end as value, l_discount * 10 as confidence from lineitem)"


def passes(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey % 800 as doc_id",
        "l_suppkey % 9 as field_name",
        "l_partkey * 1000 + l_suppkey * 10 + l_linenumber as pass",
        "case when l_quantity > 10 then concat('v', l_partkey % 30) else '' end as value",
        "l_discount * 10 as confidence",
    )
    return rows.groupBy("doc_id", "field_name", "pass").agg(F.min("value").alias("value"), F.min("confidence").alias("confidence"))


@query(
    f"""with p as (select doc_id, field_name, pass, min(value) as value, min(confidence) as confidence from {PASSES} group by all),
  f as (select doc_id, field_name, min(pass) filter (where value <> '') as first from p group by all),
  c as (select p.*, first, value <> '' and (pass = first or confidence >= 0.60) as counts from p join f using (doc_id, field_name)),
  w as (select doc_id, field_name, max(pass) filter (where counts) as pass, count(*) filter (where value = '' and pass > first) as regressions from c group by all)
select w.doc_id, w.field_name, p.value, round(p.confidence, 6) as confidence, regressions from w left join p using (doc_id, field_name, pass)"""
)
def m1_merge_passes(spark, sf_dir):
    return merges.merge_passes(passes(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


LEFT = "(select c_custkey as doc_id, 'f' || (c_custkey % 3) as name, c_mktsegment as value, c_nationkey / 25.0::double as confidence, c_custkey % 4 > 0 as digits_ok from customer where c_custkey % 5 > 0)"
RIGHT = "(select c_custkey as doc_id, 'f' || (c_custkey % 3) as name, case when c_custkey % 2 = 0 then lower(c_mktsegment) else 'OTHER' end as value, (c_custkey % 25) / 25.0::double as confidence, c_custkey % 3 > 0 as digits_ok from customer where c_custkey % 7 > 0)"


def sources(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer")
    left = c.where("c_custkey % 5 > 0").selectExpr("c_custkey as doc_id", "concat('f', c_custkey % 3) as name", "c_mktsegment as value", "c_nationkey / 25D as confidence", "c_custkey % 4 > 0 as digits_ok")
    right = c.where("c_custkey % 7 > 0").selectExpr("c_custkey as doc_id", "concat('f', c_custkey % 3) as name", "case when c_custkey % 2 = 0 then lower(c_mktsegment) else 'OTHER' end as value", "(c_custkey % 25) / 25D as confidence", "c_custkey % 3 > 0 as digits_ok")
    return left, right


RECONCILED = f"""j as (select coalesce(l.doc_id, r.doc_id) as doc_id, coalesce(l.name, r.name) as name, l.value as lv, r.value as rv, l.confidence as lc, r.confidence as rc, l.digits_ok as lo, r.digits_ok as ro
    from {LEFT} l full outer join {RIGHT} r on l.doc_id = r.doc_id and l.name = r.name),
  k as (select *, lv is not null and rv is not null as two, lower(trim(lv)) = lower(trim(rv)) as same,
    case when coalesce(lo, true) <> coalesce(ro, true) then coalesce(lo, true) else lc > rc end as takes_left from j)"""


@query(
    f"""with {RECONCILED}
select doc_id, name, case when not two or same then coalesce(lv, rv) when takes_left then lv else rv end as value,
  round(case when two and same then least(0.97, greatest(lc, rc) + 0.05) when not two then coalesce(lc, rc) else least(0.6, case when takes_left then lc else rc end) end, 9) as confidence,
  case when two and same then 'both' when two then case when takes_left then 'left' else 'right' end when lv is not null then 'left' else 'right' end as origin,
  case when two and not same then case when takes_left then rv else lv end end as alternate_value from k"""
)
def m3_reconcile(spark, sf_dir):
    out = merges.reconcile(*sources(spark, sf_dir), ["doc_id", "name"])
    return out.withColumn("confidence", F.round("confidence", 9))


@query(f"with {RECONCILED} select count(*) filter (where two) as matched, count(*) filter (where lv is null) as right_only, count(*) filter (where rv is null) as left_only from k")
def j14_outer_counts(spark, sf_dir):
    left, right = sources(spark, sf_dir)
    j = left.select("doc_id", "name", F.col("value").alias("l")).join(right.select("doc_id", "name", F.col("value").alias("r")), ["doc_id", "name"], "full_outer")
    l, r = F.col("l").isNull(), F.col("r").isNull()
    return j.agg(F.count_if(~l & ~r).alias("matched"), F.count_if(l).alias("right_only"), F.count_if(r).alias("left_only"))


@query(
    f"""with r as (select doc_id, name as field_name, case when doc_id % 6 > 0 then value end as value, confidence from {LEFT}),
  m as (select doc_id, name as field_name, case when doc_id % 11 = 0 then 'spouse' else 'applicant' end as subject, value, confidence, digits_ok from {RIGHT}),
  j as (select r.*, m.value as mv, m.confidence as mc, m.digits_ok as md, lower(trim(r.value)) = lower(trim(m.value)) as same from r left join m on m.doc_id = r.doc_id and m.field_name = r.field_name and m.subject = 'applicant')
select doc_id, field_name, case when mv is null then value when value is null then mv when same or not md then value else mv end as value,
  round(case when mv is null then confidence when value is null then mc when same then greatest(confidence, mc) when not md then confidence else least(0.6, mc) end, 9) as confidence,
  case when mv is not null and value is not null and not same then 'warning' else 'ok' end as status from j
union all select doc_id, 'Spouse: ' || field_name, value, round(confidence, 9), 'warning' from m where subject = 'spouse'"""
)
def m4_merge_readings(spark, sf_dir):
    left, right = sources(spark, sf_dir)
    regex = left.selectExpr("doc_id", "name as field_name", "case when doc_id % 6 > 0 then value end as value", "confidence")
    model = right.selectExpr("doc_id", "name as field_name", "case when doc_id % 11 = 0 then 'spouse' else 'applicant' end as subject", "value", "confidence", "digits_ok")
    return merges.merge_readings(regex, model).drop("note").withColumn("confidence", F.round("confidence", 9))


@query(
    """with t as (select event_id, event_type as local_type, case when value > 3 then 'view' end as other, value / 50 as conf from events)
select event_id, case when other is not null and conf >= 0.6 then other else local_type end as type, other is not null and other <> local_type as differs from t"""
)
def m5_pick_type(spark, sf_dir):
    t = views.table(spark, sf_dir, "events").selectExpr("event_id", "event_type as local_type", "case when value > 3 then 'view' end as other", "value / 50 as conf")
    return merges.pick_type(t, "local_type", "other", "conf").select("event_id", "type", "differs")


UPSERT = """o as (select c_custkey as doc_id, c_mktsegment as value, c_custkey % 4 = 0 as approved, c_custkey % 9 = 0 as corrected from customer where c_custkey % 6 > 0),
  n as (select o_custkey as doc_id, min(case when o_custkey % 3 = 0 then 'NEW' else c_mktsegment end) as value from orders join customer on c_custkey = o_custkey group by 1),
  j as (select coalesce(o.doc_id, n.doc_id) as doc_id, o.value as ov, n.value as nv, coalesce(approved, false) as approved, corrected from o full outer join n on o.doc_id = n.doc_id),
  a as (select *, case when nv is null then 'kept' when ov is null then 'inserted' when ov = nv then 'unchanged' when approved or corrected then 'preserved' else 'updated' end as action from j)"""


@query(f"with {UPSERT} select doc_id, action, case when action in ('inserted', 'updated') then nv else ov end as value from a")
def m6_upsert_verified(spark, sf_dir):
    c, o = views.table(spark, sf_dir, "customer"), views.table(spark, sf_dir, "orders")
    old = c.where("c_custkey % 6 > 0").selectExpr("c_custkey as doc_id", "c_mktsegment as value", "c_custkey % 4 = 0 as approved", "case when c_custkey % 9 = 0 then 'x' end as corrected_value")
    new = o.join(c, F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("o_custkey").alias("doc_id")).agg(F.min(F.expr("case when o_custkey % 3 = 0 then 'NEW' else c_mktsegment end")).alias("value"))
    return merges.upsert_verified(old, new, ["doc_id"])


@query(f"with {UPSERT} select action, count(*) as n from a group by 1")
def m6_upsert_counts(spark, sf_dir):
    return m6_upsert_verified(spark, sf_dir).groupBy("action").agg(F.count("*").alias("n"))


@query(
    """with f as (select o_orderkey as id, (['bsb', 'date_of_birth', 'account_number', 'occupation'])[(o_orderkey % 4 + 1)::int] as name, o_custkey as c, o_orderstatus = 'F' as approved from orders),
  v as (select *, case when c % 5 = 0 then '' when name = 'bsb' then lpad((c % 1000)::varchar, 3, '0') || case when c % 2 = 0 then '-' else '' end || '123'
    when name = 'date_of_birth' then case c % 4 when 0 then '1980-02-' || (10 + c % 30) when 1 then (13 + c % 19) || '/02/1980' when 2 then (1 + c % 12) || '/11/1980' else 'soon' end
    when name = 'account_number' then case when c % 3 = 0 then 'x' else '' end || (c * 1000) when c % 2 = 0 then 'any' end as value from f)
select id, name, case when coalesce(value, '') = '' then 'empty' when name = 'occupation' then null
  when case name when 'bsb' then regexp_matches(value, '^[0-9]{3}-[0-9]{3}$') when 'account_number' then regexp_matches(value, '^[0-9]{6,10}$')
    else (c % 4 = 0 and 10 + c % 30 <= 29) or (c % 4 = 1 and 13 + c % 19 <= 29) or c % 4 = 2 end then 'valid' when approved then 'protected_invalid' else 'invalid' end as verdict from v"""
)
def m7_critical_fields(spark, sf_dir):
    """Branch and account numbers and dates of birth, which count whether or not day and month could be swapped; other fields have no verdict."""
    from loomwork.operators.verify import critical_valid

    f = views.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as id",
        "element_at(array('bsb', 'date_of_birth', 'account_number', 'occupation'), cast(o_orderkey % 4 as int) + 1) as name",
        "o_custkey as c",
        "o_orderstatus = 'F' as approved",
    )
    value = (
        "case when c % 5 = 0 then '' when name = 'bsb' then concat(lpad(c % 1000, 3, '0'), case when c % 2 = 0 then '-' else '' end, '123')"
        " when name = 'date_of_birth' then case c % 4 when 0 then concat('1980-02-', 10 + c % 30) when 1 then concat(13 + c % 19, '/02/1980') when 2 then concat(1 + c % 12, '/11/1980') else 'soon' end"
        " when name = 'account_number' then concat(case when c % 3 = 0 then 'x' else '' end, c * 1000) when c % 2 = 0 then 'any' end as value"
    )
    return merges.audit_critical(f.selectExpr("*", value), critical_valid(F.col("name"), F.col("value")), F.col("approved")).select("id", "name", F.when((F.col("name") != "occupation") | (F.col("verdict") == "empty"), F.col("verdict")).alias("verdict"))


@query(
    """with f as (select o_orderkey as id, case when o_custkey % 5 = 0 then '' else lpad((o_custkey % 1000)::varchar, 3, '0') || case when o_custkey % 2 = 0 then '-' else '' end || '123' end as value, o_orderstatus = 'F' as approved from orders)
select id, case when value = '' then 'empty' when regexp_matches(value, '^[0-9]{3}-[0-9]{3}$') then 'valid' when approved then 'protected_invalid' else 'invalid' end as verdict from f"""
)
def m7_critical_audit(spark, sf_dir):
    from loomwork.operators.verify import critical_valid

    f = views.table(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "case when o_custkey % 5 = 0 then '' else concat(lpad(o_custkey % 1000, 3, '0'), case when o_custkey % 2 = 0 then '-' else '' end, '123') end as value", "o_orderstatus = 'F' as approved")
    return merges.audit_critical(f, critical_valid(F.lit("bsb"), F.col("value")), F.col("approved")).select("id", "verdict")


REVIEWS = """f as (select c_custkey as field_id, case when c_custkey % 4 = 0 then '' else c_mktsegment end as value from customer),
  e as (select event_id as seq, user_id as field_id, case when event_type = 'click' then 'c' || (event_id % 9) end as correction, case when event_type = 'view' then value > 5 end as approve from events where user_id % 3 = 0),
  l as (select field_id, max_by(correction, seq) filter (where correction is not null) as correction, max_by(approve, seq) filter (where approve is not null) as approve from e group by 1)"""


def reviews(spark, sf_dir):
    f = views.table(spark, sf_dir, "customer").selectExpr("c_custkey as field_id", "case when c_custkey % 4 = 0 then '' else c_mktsegment end as value")
    e = views.table(spark, sf_dir, "events").where("user_id % 3 = 0").selectExpr("event_id as at", "user_id as field_id", "case when event_type = 'click' then concat('c', event_id % 9) end as correction", "case when event_type = 'view' then value > 5 end as approve")
    return merges.overlay_reviews(f, e)


@query(f"with {REVIEWS} select field_id, coalesce(correction, value) as value, coalesce(approve, false) and trim(coalesce(correction, value)) <> '' as approved from f left join l using (field_id)")
def m11_review_overlay(spark, sf_dir):
    return reviews(spark, sf_dir)[0]


@query(f"with {REVIEWS} select field_id from f left join l using (field_id) where coalesce(approve, false) and trim(coalesce(correction, value)) = ''")
def m11_rejected_approvals(spark, sf_dir):
    return reviews(spark, sf_dir)[1]


@query("select c_custkey as id, c_mktsegment as value from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F') union all select o_custkey, 'F' from orders where o_orderstatus = 'F' group by 1")
def m12_replace_by_key(spark, sf_dir):
    old = views.table(spark, sf_dir, "customer").selectExpr("c_custkey as id", "c_mktsegment as value")
    new = views.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").selectExpr("o_custkey as id", "'F' as value").distinct()
    return merges.replace_by_key(old, new, "id")


@query(
    """with f as (select o_orderkey as doc_id, 'bsb' as field_name, (o_custkey % 10000)::varchar as value from orders),
  v as (select o_orderkey as doc_id, (['corrected', 'confirmed', 'other'])[(o_orderkey % 3 + 1)::int] as verdict, o_orderpriority as new_value from orders where o_orderkey % 5 > 0),
  p as (select o_orderkey as doc_id, 'page ' || o_custkey || ' ' || lower(case when o_orderkey % 2 = 0 then o_orderpriority else '' end) as text from orders)
select doc_id, field_name, case when verdict = 'corrected' and contains(lower(text), lower(new_value)) then 'corrected'
  when verdict = 'confirmed' and (length(value) < 4 or contains(regexp_replace(text, '[^0-9]', '', 'g'), value)) then 'confirmed' else 'unresolved' end as state
from f left join v using (doc_id) left join p using (doc_id)"""
)
def m13_settle_verdicts(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    f = o.selectExpr("o_orderkey as doc_id", "'bsb' as field_name", "cast(o_custkey % 10000 as string) as value")
    v = o.where("o_orderkey % 5 > 0").selectExpr("o_orderkey as doc_id", "'bsb' as field_name", "element_at(array('corrected', 'confirmed', 'other'), cast(o_orderkey % 3 as int) + 1) as verdict", "o_orderpriority as new_value")
    p = o.selectExpr("o_orderkey as doc_id", "concat('page ', o_custkey, ' ', lower(case when o_orderkey % 2 = 0 then o_orderpriority else '' end)) as text")
    return merges.settle_verdicts(f, v, p).select("doc_id", "field_name", "state")


@query(
    """with e as (select distinct user_id as file, (event_id % 5)::int as page, event_type as part, case when user_id % 3 = 0 then 'review' else 'confirmed' end as decision, (user_id % 4)::bigint as matches, case when user_id % 5 > 0 then user_id end as identity_id from events)
select sha256(file || '|' || page || '|' || part) as occurrence, case when decision = 'confirmed' and matches = 1 and identity_id is not null then 'assigned' when decision = 'review' then 'needs_review' else 'unassigned' end as state from e"""
)
def m14_assign_evidence(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").selectExpr("user_id as file", "cast(event_id % 5 as int) as page", "event_type as part", "case when user_id % 3 = 0 then 'review' else 'confirmed' end as decision", "user_id % 4 as matches", "case when user_id % 5 > 0 then user_id end as identity_id")
    return merges.assign_evidence(e, include_review=True).select("occurrence", "state")


@query(
    """with a as (select p_partkey as line, p_name as text, p_size / 50.0::double as confidence from part where p_partkey % 3 > 0),
  b as (select p_partkey as line, case when p_partkey % 6 = 0 then '-' else upper(p_name) end as text, (p_partkey % 50) / 50.0::double as confidence from part where p_partkey % 2 = 0),
  j as (select coalesce(a.line, b.line) as line, a.text as ta, b.text as tb, a.confidence as ca, b.confidence as cb from a full outer join b on a.line = b.line),
  k as (select *, tb is not null and (ta is null or (cb >= 0.3 and cb > ca)) as better from j where ta is not null or length(regexp_replace(tb, '[^A-Za-z0-9]', '', 'g')) >= 2)
select line, case when better then tb else ta end as text, case when better then cb else ca end as confidence from k"""
)
def m15_choose_lines(spark, sf_dir):
    p = views.table(spark, sf_dir, "part")
    a = p.where("p_partkey % 3 > 0").selectExpr("p_partkey as line", "p_name as text", "p_size / 50D as confidence")
    b = p.where("p_partkey % 2 = 0").selectExpr("p_partkey as line", "case when p_partkey % 6 = 0 then '-' else upper(p_name) end as text", "(p_partkey % 50) / 50D as confidence")
    return merges.choose_lines(a, b, ["line"])


@query("select 'event' as kind, event_id as id, value as score, null::varchar as status from events where value > 30 union all select 'order', o_orderkey, null, o_orderstatus from orders where o_orderstatus = 'P'")
def u1_union_queue(spark, sf_dir):
    a = views.table(spark, sf_dir, "events").where("value > 30").selectExpr("'event' as kind", "event_id as id", "value as score")
    b = views.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").selectExpr("'order' as kind", "o_orderkey as id", "o_orderstatus as status")
    return sets.union_queue(a, b)


@query(
    """with t as (select o_orderkey, 'a ' || o_custkey || ' b ' || (o_orderkey % 100) as x, 'a ' || o_custkey || ' c ' || (o_orderkey % 90) as y from orders),
  r as (select o_orderkey, list_distinct(regexp_extract_all(x, '[0-9]+')) as p, list_distinct(regexp_extract_all(y, '[0-9]+')) as q from t)
select o_orderkey, array_to_string(list_sort(list_filter(p, lambda v: not list_contains(q, v))), ',') as only_a, array_to_string(list_sort(list_filter(q, lambda v: not list_contains(p, v))), ',') as only_b from r"""
)
def u3_digit_difference(spark, sf_dir):
    t = views.table(spark, sf_dir, "orders").selectExpr("o_orderkey", "concat('a ', o_custkey, ' b ', o_orderkey % 100) as x", "concat('a ', o_custkey, ' c ', o_orderkey % 90) as y")
    d = sets.digit_difference(F.col("x"), F.col("y"))
    return t.select("o_orderkey", F.array_join(d["only_a"], ",").alias("only_a"), F.array_join(d["only_b"], ",").alias("only_b"))


@query("select distinct o_custkey as id from orders where o_orderstatus = 'O' and o_custkey in (select c_custkey from customer where c_acctbal > 0)")
def u5_alive_selection(spark, sf_dir):
    chosen = views.table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("id"))
    return chosen.intersect(views.table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id")))
