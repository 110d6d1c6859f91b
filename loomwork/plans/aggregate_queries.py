"""Queries of aggregations and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import aggregates, select
from loomwork.plans import views
from loomwork.plans.registry import registry
from loomwork.plans.select_queries import EFFECTIVE, MONTH, STATE
from loomwork.plans.views import NAMES, with_views
from loomwork.sources import writers

QUERIES, query = registry()
#: SQL of the key of a date of birth, as the people view writes it.
DOB_KEY = """case when regexp_matches(dob, '^\\d{4}-') then replace(dob, '-', '')
  when regexp_matches(dob, '^14/') then dob[7:10] || dob[4:5] || '14'
  when regexp_matches(dob, '^14 ') then dob[-4:] || lpad((list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(dob[4:6])))::varchar, 2, '0') || '14'
  else regexp_replace(dob, '[^0-9]', '', 'g') end"""
IDENTIFIED = f"ided as (select *, case when family is not null then sha256(lower(trim(family)) || '|' || lower(trim(given)) || '|' || {DOB_KEY})[1:16] end as identity_id from people)"
VERDICT = f"""case when trim(coalesce(expiry, '')) = '' then 'absent' when ({MONTH}) is null then 'malformed' when ({MONTH}) < date '2024-03-01' then 'before_window'
  when ({MONTH}) > date '2034-12-01' then 'after_window' else 'valid' end"""


@query(with_views("docs") + " select status, count(*) as n from docs group by 1")
def a1_count_by_status(spark, sf_dir):
    return aggregates.count_by(views.docs(spark, sf_dir), "status")


@query(
    with_views("docs")
    + """ select count(*) as total, count(*) filter (where status = 'queued') as queued, count(*) filter (where status = 'processing') as processing,
  count(*) filter (where status = 'extracted') as extracted, count(*) filter (where status = 'failed') as failed from docs"""
)
def a1_status_totals(spark, sf_dir):
    return aggregates.status_counts(views.docs(spark, sf_dir))


@query(with_views("index") + " select coalesce(nullif(trim(sex), ''), '(blank)') as sex, count(*) as n from idx group by 1")
def a2_count_by_column(spark, sf_dir):
    return aggregates.count_by(views.index(spark, sf_dir), "sex")


@query(
    with_views("index")
    + f""" select count(*) as total, count(*) filter (where {STATE} = 'verified') as verified, count(*) filter (where {STATE} = 'failed') as failed,
  count(*) filter (where {STATE} = 'unverifiable') as unverifiable, count(*) filter (where {STATE} = 'absent') as absent, count(*) filter (where review) as to_review,
  count(expiry) as with_expiry, count(*) filter (where sex = '') as without_sex, sum(record_count)::bigint as records, count(distinct number) as numbers from idx"""
)
def a3_index_summary(spark, sf_dir):
    return aggregates.index_summary(views.index(spark, sf_dir))


@query(
    with_views("index")
    + f""", v as (select {VERDICT} as v from idx)
select count(*) filter (where v = 'valid') as valid, count(*) filter (where v = 'absent') as absent, count(*) filter (where v = 'malformed') as malformed,
  count(*) filter (where v = 'before_window') as before_window, count(*) filter (where v = 'after_window') as after_window, count(*) filter (where v not in ('valid', 'absent')) as rejected from v"""
)
def a4_expiry_census(spark, sf_dir):
    return aggregates.expiry_census(views.index(spark, sf_dir), "expiry", "2024-03", "2034-12")


@query(
    with_views("people")
    + f""", {IDENTIFIED}, p as (select *, row_number() over (partition by identity_id order by document_id) as place from ided where identity_id is not null)
select identity_id, count(*) as documents, count(*) filter (where status = 'extracted') as extracted, count(*) filter (where status = 'failed') as failed,
  array_to_string(list(document_id order by document_id) filter (where place <= 8), ',') as members from p group by 1"""
)
def a5_identity_groups(spark, sf_dir):
    return aggregates.identities(views.people(spark, sf_dir))[0]


@query(with_views("people") + f", {IDENTIFIED} select document_id, case when identity_id is null then 'unassigned' else 'grouped' end as side from ided")
def u2_grouped_split(spark, sf_dir):
    named = aggregates.identify(views.people(spark, sf_dir))
    return named.select("document_id", F.when(F.col("identity_id").isNull(), "unassigned").otherwise("grouped").alias("side"))


@query(
    with_views("people")
    + f" select lower(trim(family)) as family, lower(trim(given)) as given, count(distinct {DOB_KEY}) as dobs from people where family is not null group by all having count(distinct {DOB_KEY}) > 1"
)
def a6_name_clusters(spark, sf_dir):
    return aggregates.name_clusters(views.people(spark, sf_dir))


BEST = f"""e as (select extraction_id, field_name, approved, confidence, seq, {EFFECTIVE} as value from fields),
  b as (select *, row_number() over (partition by extraction_id, field_name order by approved desc, confidence desc, seq) as n from e where value is not null)"""


def effective(spark, sf_dir):
    return select.effective_values(views.fields(spark, sf_dir))


@query(with_views("fields") + f", {BEST} select extraction_id, field_name, value, approved, confidence from b where n = 1")
def a7_best_values(spark, sf_dir):
    return aggregates.best_values(effective(spark, sf_dir), ["extraction_id"])


IDENTIFIERS = """v as (select l_suppkey % 30 as identity_id, case when l_linenumber % 2 = 0 then 'passport' else 'licence' end as kind, l_orderkey % 400 as document_id,
  case when l_linenumber % 2 = 0 then 'aus n' || lpad((l_partkey % 90)::varchar, 7, '0') || ' / x' else case when l_partkey % 5 = 0 then 'abc.' else '' end || lpad((l_partkey % 70)::varchar, 8, '0') end as value from lineitem),
  c as (select identity_id, kind, document_id, case when kind = 'passport' then 'N' || value[6:12] else replace(upper(value), '.', '') end as canonical from v)"""
TIER = """case when (kind = 'passport' and not regexp_matches(canonical, '^[A-Z]{1,2}[0-9]{6,8}$'))
  or (kind = 'licence' and not (regexp_matches(canonical, '^[A-Z0-9]{7,10}$') and length(regexp_replace(canonical, '[^A-Z]', '', 'g')) <= 2)) then 'format_fail'
  when sources >= 2 then 'triple_checked' else 'single_source' end"""


def identifier_rows(spark, sf_dir):
    return views.table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey % 30 as identity_id",
        "case when l_linenumber % 2 = 0 then 'passport' else 'licence' end as kind",
        "l_orderkey % 400 as document_id",
        "case when l_linenumber % 2 = 0 then concat('aus n', lpad(l_partkey % 90, 7, '0'), ' / x') else concat(case when l_partkey % 5 = 0 then 'abc.' else '' end, lpad(l_partkey % 70, 8, '0')) end as value",
    )


@query(
    f"""with {IDENTIFIERS}, s as (select identity_id, kind, canonical, count(distinct document_id) as sources from c group by all)
select identity_id, kind, canonical, sources, {TIER} as tier, row_number() over (partition by identity_id, kind order by sources desc, canonical)::int as place from s"""
)
def a8_corroboration(spark, sf_dir):
    return aggregates.corroborate(identifier_rows(spark, sf_dir), ["identity_id"])


@query(f"with {IDENTIFIERS}, s as (select kind, canonical, count(distinct document_id) as sources from c group by all) select kind, sources, count(*) as identifiers from s group by all")
def a9_source_histogram(spark, sf_dir):
    return aggregates.source_histogram(aggregates.corroborate(identifier_rows(spark, sf_dir), []))


@query(
    with_views("fields")
    + f""", e as (select extraction_id, field_name, seq, {EFFECTIVE} as value from fields), f as (select *, row_number() over (partition by extraction_id order by seq, value) as n from e where field_name = 'bsb' and value is not null)
select extraction_id, min(value) filter (where n = 1) as bsb from f group by 1"""
)
def a10_promoted_first(spark, sf_dir):
    rows = effective(spark, sf_dir).withColumn("seq", F.struct("seq", "value"))
    return aggregates.promote_first(rows, "extraction_id", "bsb")


@query("select event_type, null as state, count(*) as n from events group by 1 union all select null, value > 20, count(*) from events group by value > 20")
def a11_grouping_sets(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select("event_type", (F.col("value") > 20).alias("state"))
    return e.groupingSets([["event_type"], ["state"]], "event_type", "state").agg(F.count("*").alias("n"))


@query(
    """with w as (select o_orderkey as id, nullif(o_orderstatus, 'P') as a, case when o_custkey % 3 > 0 then o_orderpriority else '' end as b from orders)
select count(*) as documents, sum((coalesce(a, '') <> '')::int + (coalesce(b, '') <> '')::int)::bigint as filled, count(*) filter (where a is not null and b <> '') as complete from w"""
)
def a12_pass_metrics(spark, sf_dir):
    w = views.table(spark, sf_dir, "orders").selectExpr("nullif(o_orderstatus, 'P') as a", "case when o_custkey % 3 > 0 then o_orderpriority else '' end as b")
    cells = F.size(F.filter(F.array("a", "b"), lambda x: F.coalesce(x, F.lit("")) != ""))
    return w.agg(F.count("*").alias("documents"), F.sum(cells).alias("filled"), F.count_if(cells == 2).alias("complete"))


@query(
    with_views("pages")
    + """, f as (select doc_id, 'LOW_CONF' as code from pages_v where probe_conf < 0.2 union all select doc_id, 'DARK' from pages_v where ink > 0.5)
select code, count(distinct doc_id) as documents, round(count(distinct doc_id) * 100 / (select count(distinct doc_id) from pages_v), 2) as percent from f group by 1"""
)
def a14_flag_rates(spark, sf_dir):
    from loomwork.operators.verify import flags

    p = views.pages(spark, sf_dir)
    found = flags(p, {"LOW_CONF": F.col("probe_conf") < 0.2, "DARK": F.col("ink") > 0.5})
    return aggregates.flag_rates(found, p.select("doc_id").distinct())


@query(
    with_views("pages")
    + """, w as (select doc_id, min(probe_conf) as conf, min(alnum) as alnum, max(ink) as ink, bool_and(kind = 'printed') as printed, count(*) as pages from pages_v group by 1)
select doc_id, pages, case when ink < 0.02 then 'blank' when printed and conf >= 0.6 and alnum >= 40 then 'parked' when conf < 0.1 then 'unreadable' else 'read' end as verdict from w"""
)
def a15_gate_survey(spark, sf_dir):
    return aggregates.gate_survey(views.pages(spark, sf_dir)).select("doc_id", "pages", "verdict")


@query(with_views("pages") + " select kind, count(*) as n, count(*) filter (where alnum >= 40) as with_text, round(avg(probe_conf), 6) as mean_conf from pages_v group by 1")
def a16_label_report(spark, sf_dir):
    p = views.pages(spark, sf_dir)
    return p.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("alnum") >= 40).alias("with_text"), F.round(F.avg("probe_conf"), 6).alias("mean_conf"))


@query(
    with_views("pages")
    + """ select case when probe_conf > 0.5 and ink > 0.2 then 'confirmed' when probe_conf > 0.5 then 'disputed' when ink > 0.2 then 'rescued' else 'rejected' end as cell, count(*) as n from pages_v group by 1"""
)
def a17_cross_tab(spark, sf_dir):
    return aggregates.cross_tab(views.pages(spark, sf_dir), F.col("probe_conf") > 0.5, F.col("ink") > 0.2)


@query(with_views("pages") + " select least(floor(probe_conf * 10), 9)::int as band, count(*) as n from pages_v group by 1")
def a17_score_bands(spark, sf_dir):
    return aggregates.score_bands(views.pages(spark, sf_dir), "probe_conf")


@query(
    with_views("pages")
    + """, r as (select doc_id, count(*) as n, round(avg((ink > 0.1)::int), 6) as ratio from pages_v group by 1 order by ratio, n, doc_id limit 12) select * from r where n >= 3"""
)
def a18_worst_groups(spark, sf_dir):
    return aggregates.worst_groups(views.pages(spark, sf_dir), "doc_id", F.col("ink") > 0.1)


@query(
    with_views("docs")
    + """, c as (select bytes, case lower(regexp_extract(filename, '(\\.[^.]+)$', 1)) when '.pdf' then 'pdf' when '.png' then 'image' when '.txt' then 'text' when '.docx' then 'office' else 'other' end as category from docs)
select category, count(*) as files, sum(bytes)::bigint as bytes from c group by 1"""
)
def a19_corpus_report(spark, sf_dir):
    from loomwork.functions.text import category

    return views.docs(spark, sf_dir).groupBy(category(F.col("filename")).alias("category")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


@query("with w as (select unnest(['license', 'apache', 'token', 'page', 'stupid']) as word) select word, count(*) as files from w, documents where regexp_matches(lower(text), '\\b' || word || '\\b') group by 1")
def a20_word_report(spark, sf_dir):
    from loomwork.operators.extract import word_hits

    hits = word_hits(views.table(spark, sf_dir, "documents"), ["license", "apache", "token", "page", "stupid"])
    return hits.groupBy("word").agg(F.count("*").alias("files"))


@query("with p as (select user_id, count(*) as pages from events group by 1) select pages, count(*) as n from p group by 1")
def a21_page_histogram(spark, sf_dir):
    p = views.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("pages"))
    return aggregates.histogram(p, "pages")


@query(
    with_views("pages")
    + """, c as (select doc_id, kind, count(*) as n from pages_v group by all), m as (select doc_id, max(n) filter (where kind <> 'blank') as most from c group by 1),
  t as (select c.doc_id, count(*) as ties, min(kind) as only_kind from c join m using (doc_id) where kind <> 'blank' and n = most group by 1)
select m.doc_id, case when most is null then 'other' when ties > 1 then 'mixed' else only_kind end as type from m left join t using (doc_id)"""
)
def a22_majority_type(spark, sf_dir):
    return aggregates.majority_type(views.pages(spark, sf_dir))


@query("select o_custkey % 300 as folder, count(distinct o_orderpriority) as n from orders group by 1 having count(distinct o_orderpriority) > 1")
def a23_ambiguous_folders(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").selectExpr("o_custkey % 300 as folder", "o_orderpriority")
    return aggregates.ambiguous(o, "folder", "o_orderpriority")


@query(with_views("docs") + " select content_hash, count(*) as n from docs group by 1 having count(*) > 1")
def a24_duplicate_hashes(spark, sf_dir):
    return aggregates.duplicate_groups(views.docs(spark, sf_dir), "content_hash")


@query("select c_custkey as id, (coalesce(max(o_orderkey % 9), 0) + 1)::bigint as next from customer left join orders on o_custkey = c_custkey group by 1")
def a26_next_version(spark, sf_dir):
    d = views.docs(spark, sf_dir)
    return aggregates.next_version(d, views.table(spark, sf_dir, "orders").selectExpr("o_custkey as document_id", "o_orderkey % 9 as version"))


@query(
    "select user_id as doc_id, event_type as subject, count(*) as n, array_to_string(list(distinct (trunc(value)::bigint % 10)::varchar order by (trunc(value)::bigint % 10)::varchar), ',') as entries from events group by all"
)
def a27_subjects(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").selectExpr("user_id as doc_id", "event_type as subject", "cast(cast(value as bigint) % 10 as string) as entry")
    return e.groupBy("doc_id", "subject").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("entry")), ",").alias("entries"))


@query(
    with_views("fields")
    + f""", {BEST} select extraction_id, """
    + ", ".join(f"min(value) filter (where field_name = '{n}' and n = 1) as {n}, bool_or(approved) filter (where field_name = '{n}' and n = 1) as {n}__approved" for n in NAMES)
    + " from b group by 1"
)
def snk1_consolidated(spark, sf_dir):
    return aggregates.consolidated(effective(spark, sf_dir), "extraction_id", list(NAMES))


@query(
    with_views("fields")
    + f""", e as (select extraction_id % 200 as identity_id, field_name, approved, confidence, seq, {EFFECTIVE} as value from fields),
  b as (select *, row_number() over (partition by identity_id, field_name order by approved desc, confidence desc, seq) as n from e where value is not null),
  l as (select identity_id, field_name || ': ' || value || ' [' || printf('%.2f', confidence) || case when approved then ', approved' else '' end || ']' as line from b where n = 1)
select identity_id, 'Identity ' || identity_id || chr(10) || 'Fields: ' || count(*) || chr(10) || string_agg(line, chr(10) order by line) as summary from l group by 1"""
)
def snk8_identity_summary(spark, sf_dir):
    rows = effective(spark, sf_dir).withColumn("identity_id", F.col("extraction_id") % 200)
    return writers.identity_summary(aggregates.best_values(rows, ["identity_id"]))
