"""Queries of filters, paging, projections, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions import keys, text
from loomwork.operators import select
from loomwork.plans import views
from loomwork.plans.registry import registry
from loomwork.plans.views import with_views
from loomwork.sources import readers, writers

QUERIES, query = registry()
AS_OF = "2030-06-15"
#: SQL of the month of an expiry, and of the state of a number, over the index view.
MONTH = """case when regexp_matches(trim(expiry), '^\\d{4}-\\d{2}(-\\d{2})?$') and substr(trim(expiry), 6, 2)::int between 1 and 12
   then make_date(substr(trim(expiry), 1, 4)::int, substr(trim(expiry), 6, 2)::int, 1)
  when regexp_matches(trim(expiry), '^\\d{1,2}/\\d{4}$') and split_part(trim(expiry), '/', 1)::int between 1 and 12
   then make_date(split_part(trim(expiry), '/', 2)::int, split_part(trim(expiry), '/', 1)::int, 1)
  when regexp_matches(trim(expiry), '^\\d{1,2}/\\d{2}$') and split_part(trim(expiry), '/', 1)::int between 1 and 12
   then make_date(2000 + split_part(trim(expiry), '/', 2)::int, split_part(trim(expiry), '/', 1)::int, 1) end"""
STATE = "case when number is null then 'absent' when valid is null then 'unverifiable' when valid then 'verified' else 'failed' end"
EXPIRY = f"""case when month is null then 'without' when month < date '2030-06-01' then 'expired'
  when month < date '2030-10-01' then 'expiring_soon' else 'with' end"""
EFFECTIVE = "coalesce(nullif(trim(corrected_value), ''), nullif(trim(field_value), ''))"


@query(with_views("fields") + f" select extraction_id, field_name, seq, {EFFECTIVE} as value from fields")
def f1_effective_value(spark, sf_dir):
    return select.effective_values(views.fields(spark, sf_dir)).select("extraction_id", "field_name", "seq", "value")


@query(
    with_views("fields")
    + f""", e as (select extraction_id, field_name, seq, {EFFECTIVE} as value from fields)
select extraction_id, field_name, value from (select *, row_number() over (partition by extraction_id, field_name order by seq, value) as n
  from e where value is not null) where n = 1"""
)
def f2_first_value(spark, sf_dir):
    return select.first_values(views.fields(spark, sf_dir))


@query(
    with_views("index")
    + """ select id, name from idx where contains(lower(concat_ws(' ', name, number, state, source_files)), 'customer')
  and contains(lower(concat_ws(' ', name, number, state, source_files)), '00')
  and contains(lower(concat_ws(' ', name, number, state, source_files)), 'mach')"""
)
def f3_term_search(spark, sf_dir):
    q = select.IndexQuery(text="Customer 00 MACH")
    return select.filter_index(views.index(spark, sf_dir), q, AS_OF).select("id", "name")


@query(with_views("index") + f" select id, {STATE} as number_state from idx where {STATE} = 'failed' and sex in ('M', 'F', '') and review = false")
def f4_enumerated_filters(spark, sf_dir):
    q = select.IndexQuery(number="failed", sex="nonsense", review=False)
    out = select.filter_index(views.index(spark, sf_dir), q, AS_OF)
    return out.select("id", select.number_state(F.col("number"), F.col("valid")).alias("number_state"))


@query(with_views("index") + f", m as (select id, {MONTH} as month from idx) select id, month, {EXPIRY} as state from m")
def f5_expiry_state(spark, sf_dir):
    from loomwork.functions.dates import expiry_month

    month = expiry_month(F.col("expiry"))
    return views.index(spark, sf_dir).select("id", month.alias("month"), select.expiry_state(month, AS_OF).alias("state"))


@query(with_views("index") + " select id, number from idx order by number desc nulls last, id limit 50 offset 20")
def f6_sorted_page(spark, sf_dir):
    return select.page(views.index(spark, sf_dir), "number", 50, 20, descending=True).select("id", "number")


@query(with_views("index") + " select id, name, record_count from idx where state = 'BUILDING' order by record_count, id limit 25 offset 10")
def f7_index_page(spark, sf_dir):
    q = select.IndexQuery(state="BUILDING", sort="record_count", limit=25, offset=10)
    return select.query_index(views.index(spark, sf_dir), q, AS_OF)[0].select("id", "name", "record_count")


@query(with_views("index") + " select count(*) as total from idx where state = 'BUILDING'")
def f7_index_total(spark, sf_dir):
    return select.query_index(views.index(spark, sf_dir), select.IndexQuery(state="BUILDING"), AS_OF)[1]


@query(with_views("docs") + " select count(*) as total, 120 < count(*) as has_more from docs where status = 'failed'")
def f8_page_info(spark, sf_dir):
    return select.page_info(views.docs(spark, sf_dir).where("status = 'failed'"), 100, 20)


@query(with_views("jobs") + " select id, status, started_at from jobs where document_id = 42")
def f9_lookup(spark, sf_dir):
    return select.lookup(views.jobs(spark, sf_dir), "document_id", 42).select("id", "status", "started_at")


@query(with_views("index") + " select id, name from idx where id in (select o_custkey from orders where o_orderstatus = 'F')")
def f10_select_ids(spark, sf_dir):
    ids = views.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey")
    return select.select_ids(views.index(spark, sf_dir), ids).select("id", "name")


EXTENSION = "lower(regexp_extract(filename, '(\\.[^.]+)$', 1))"


@query(
    with_views("docs")
    + f""" select id, case when {EXTENSION} not in ('.pdf', '.png', '.txt') then 'unsupported' when bytes > 500000 then 'too_large' else 'accepted' end as outcome from docs"""
)
def f11_accept(spark, sf_dir):
    d = views.docs(spark, sf_dir)
    return select.accept(d, text.extension(F.col("filename")), [".pdf", ".png", ".txt"], 500_000).select("id", "outcome")


@query(
    with_views("docs")
    + """,
  b as (select id, status || '-' || (id // 50)::varchar as batch, bytes + 100000 as bytes from docs),
  n as (select *, row_number() over (partition by batch order by id) as k from b)
select id, outcome from (
  with recursive w as (
    select batch, k, id, bytes, 1 <= 6 and bytes <= 2000000 as ok, case when bytes <= 2000000 then 1 else 0 end as c, case when bytes <= 2000000 then bytes else 0 end as s from n where k = 1
    union all
    select n.batch, n.k, n.id, n.bytes, w.c < 6 and w.s + n.bytes <= 2000000, w.c + (w.c < 6 and w.s + n.bytes <= 2000000)::int,
      w.s + case when w.c < 6 and w.s + n.bytes <= 2000000 then n.bytes else 0 end
    from w join n on n.batch = w.batch and n.k = w.k + 1)
  select id, case when ok then 'accepted' else 'limit' end as outcome from w)"""
)
def f12_greedy_cap(spark, sf_dir):
    d = views.docs(spark, sf_dir).selectExpr("id", "concat(status, '-', cast(id div 50 as string)) as batch", "bytes + 100000 as bytes")
    return select.greedy_cap(d, "batch", "id", 6, 2_000_000).select("id", "outcome")


@query(
    with_views("docs")
    + f""", e as (select id, filename, {EXTENSION} as ext from docs)
select id, ext, case ext when '.pdf' then 'application/pdf' when '.png' then 'image/png' when '.txt' then 'text/plain'
  when '.docx' then 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' else 'application/octet-stream' end as mime,
  case ext when '.pdf' then 'pdf' when '.png' then 'image' when '.txt' then 'text' when '.docx' then 'office' else 'other' end as category from e"""
)
def f13_mime_category(spark, sf_dir):
    name = F.col("filename")
    return views.docs(spark, sf_dir).select("id", text.extension(name).alias("ext"), text.mime(name).alias("mime"), text.category(name).alias("category"))


@query(with_views("docs") + " select id, case when starts_with(original_path, '/in/BUILDING/') then '/out/b' || substr(original_path, length('/in/BUILDING') + 1) end as path from docs")
def f14_remap(spark, sf_dir):
    return views.docs(spark, sf_dir).select("id", text.remap(F.col("original_path"), "/in/BUILDING/", "/out/b").alias("path"))


@query(
    with_views("docs")
    + """ select id, case when id % 7 in (0, 1) then null else '/assets/' || replace(replace(filename, '#', '%23'), ' ', '%20') end as url from docs"""
)
def f15_asset_url(spark, sf_dir):
    path = F.when(F.col("id") % 7 == 0, F.concat(F.lit("/"), "filename")).when(F.col("id") % 7 == 1, F.concat(F.lit("../"), "filename")).otherwise(F.concat(F.lit("assets/"), "filename"))
    return views.docs(spark, sf_dir).select("id", text.asset_url(path).alias("url"))


@query(with_views("docs") + " select id, filename, status, bytes from docs")
def f16_public_view(spark, sf_dir):
    return select.public_view(views.docs(spark, sf_dir), ["original_path", "content_hash"])


@query("select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), ' ') || '-' || upper(p_brand[1]) || lower(p_brand[2:]) as title from part")
def f17_title_case(spark, sf_dir):
    return views.table(spark, sf_dir, "part").select("p_partkey", text.title_case(F.concat("p_name", F.lit("-"), "p_brand")).alias("title"))


@query("select event_id, json_extract_string(props, '$.engine') as engine, json_extract(props, '$.k')::int as pages from events")
def f19_json_metadata(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").select("event_id", F.regexp_replace("props", '"k"', '"pages"').alias("meta"))
    return readers.with_metadata(rows, "meta").select("event_id", "engine", "pages")


@query("select user_id as doc_id, event_id as page from events where value < 2 and event_type = 'error'")
def f18_review_filter(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").where("event_type = 'error' and value < 2")
    return rows.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("page"))


@query(
    "select c_custkey, case when regexp_matches(v, '^[=+\\-@]') then '''' || v else v end as v from (select c_custkey, (['=', '+', '-', '@', 'x'])[(c_custkey % 5 + 1)::int] || c_name as v from customer)"
)
def snk4_csv_guard(spark, sf_dir):
    rows = views.table(spark, sf_dir, "customer").selectExpr("c_custkey", "concat(element_at(array('=', '+', '-', '@', 'x'), cast(c_custkey % 5 as int) + 1), c_name) as v")
    return writers.guard_csv(rows)


@query(
    with_views("index")
    + f""", m as (select *, {MONTH} as month from idx)
select id, name, coalesce(number, '') as number, case when valid then 'yes' when not valid then 'no' else '' end as number_state, sex, state,
  coalesce(strftime(month, '%m/%Y'), '') as expiry, case when review then 'yes' else 'no' end as review from m"""
)
def snk3_index_export(spark, sf_dir):
    return writers.index_export(views.index(spark, sf_dir))


@query(with_views("index") + " select distinct id, unnest(string_split(source_files, ';')) as part from idx")
def u4_patient_sources(spark, sf_dir):
    from loomwork.operators.sets import exploded_pairs

    return exploded_pairs(views.index(spark, sf_dir), "id", "source_files")


@query(
    """with d as (select c_custkey, sha256(c_name) as h from customer)
select c_custkey, list_reduce(list_transform(string_split(h, ''), lambda x: (position(x in '0123456789abcdef') - 1)::bigint), lambda a, x: (a * 16 + x) % 100) as bucket from d"""
)
def v18_sample_bucket(spark, sf_dir):
    return views.table(spark, sf_dir, "customer").select("c_custkey", keys.sample_bucket(F.col("c_name"), 100).alias("bucket"))


@query(
    with_views("docs")
    + """, r as (select id, status, row_number() over (partition by status order by sha256(id::varchar), id) as turn from docs)
select id, status, turn::int as turn from r order by turn, status limit 40"""
)
def v23_stratified_sample(spark, sf_dir):
    d = views.docs(spark, sf_dir).select("id", "status")
    return select.round_robin(d, "status", F.struct(F.sha2(F.col("id").cast("string"), 256), "id"), 40)
