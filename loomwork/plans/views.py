"""Operational tables (documents, extractions, fields, jobs, people, pages, index) derived from the test tables.

Each is a DataFrame function and, under the same name in `SQL`, the equal DuckDB common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Field names by line number.
NAMES = ("family_name", "given_names", "date_of_birth", "bsb", "passport_number", "licence_number", "postcode")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as id",
        "concat(c_name, element_at(array('.pdf', '.PNG', '.txt', '.exe', '.docx'), cast(c_custkey % 5 as int) + 1)) as filename",
        "concat('/in/', c_mktsegment, '/', c_name) as original_path",
        "sha2(cast(c_custkey % 997 as string), 256) as content_hash",
        "element_at(array('extracted', 'failed', 'queued', 'processing'), c_nationkey % 4 + 1) as status",
        "cast(c_acctbal * 100 as bigint) as bytes",
    )


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as id", "o_custkey as document_id", "o_orderdate as created_at", "o_orderpriority as raw_text", "o_totalprice as score"
    )


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ", ".join(f"'{n}'" for n in NAMES)
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as extraction_id",
        f"element_at(array({names}), l_linenumber) as field_name",
        "case when l_partkey % 11 = 0 then '' else concat('v', l_partkey % 50) end as field_value",
        "round(l_discount * 10, 2) as confidence",
        "case when l_returnflag = 'R' then concat('c', l_suppkey % 20) end as corrected_value",
        "l_linestatus = 'F' as approved",
        "l_partkey * 100000 + l_suppkey * 100 + cast(l_quantity as bigint) as seq",
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as id",
        "o_custkey as document_id",
        "case o_orderstatus when 'F' then 'completed' when 'O' then 'queued' else 'processing' end as status",
        "o_orderdate as started_at",
        "cast(o_orderkey % 5 as int) as attempts",
    )


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as document_id",
        "case when c_custkey % 13 = 0 then null else concat(' Fam', c_custkey % 97, ' ') end as family",
        "initcap(c_mktsegment) as given",
        "case c_custkey % 4 when 0 then concat(1950 + c_nationkey, '-', lpad(1 + c_nationkey % 12, 2, '0'), '-14')"
        " when 1 then concat('14/', lpad(1 + c_nationkey % 12, 2, '0'), '/', 1950 + c_nationkey)"
        " when 2 then concat('14 ', element_at(array('Jan','Feb','Mar','Apr','May','June','Jul','Aug','Sept','Oct','Nov','December'), c_nationkey % 12 + 1), ' ', 1950 + c_nationkey)"
        " else concat('03/0', 1 + c_nationkey % 9, '/', 50 + c_nationkey) end as dob",
        "concat(c_name, '.pdf') as filename",
        "element_at(array('extracted', 'failed', 'queued', 'processing'), c_nationkey % 4 + 1) as status",
    )


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as id",
        "c_name as name",
        "case when c_custkey % 3 = 0 then null else concat('2', lpad(c_custkey, 9, '0')) end as number",
        "case c_custkey % 3 when 1 then true when 2 then (case when c_custkey % 2 = 0 then false end) end as valid",
        "element_at(array('M', 'F', ''), cast(c_custkey % 3 as int) + 1) as sex",
        "c_mktsegment as state",
        "case c_custkey % 6 when 0 then null when 1 then concat('20', 20 + c_nationkey, '-0', 1 + c_nationkey % 9)"
        " when 2 then concat(lpad(1 + c_nationkey % 12, 2, '0'), '/', 10 + c_nationkey)"
        " when 3 then concat(lpad(c_nationkey % 15, 2, '0'), '/20', 15 + c_nationkey)"
        " when 4 then concat('20', 22 + c_nationkey % 9, '-11-30') else 'n/a' end as expiry",
        "concat_ws(';', concat('f', c_custkey % 50), concat('f', c_custkey % 7), concat('f', c_custkey % 50)) as source_files",
        "cast(1 + c_custkey % 4 as int) as record_count",
        "c_acctbal < 0 as review",
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "user_id as doc_id",
        "cast(event_id as int) as page",
        "case event_type when 'error' then 'blank' when 'click' then 'printed' when 'view' then 'printed' else 'handwritten' end as kind",
        "least(value / 40, 1.0) as probe_conf",
        "cast(value * 4 as int) as alnum",
        "least(value / 100, 1.0) as ink",
        "concat('k', get_json_object(props, '$.k')) as probe_text",
    )


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Application forms as texts, a line for each field, with values that hold and values that don't."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as doc_id",
        "concat_ws('\n', 'Application form', concat('Given Names: ', initcap(c_mktsegment)), concat('Surname = Fam', c_custkey % 97),"
        " concat('Date of Birth: ', element_at(array('14/02/1980', '31/02/1980', 'unknown', '05/06/2020'), cast(c_custkey % 4 as int) + 1)),"
        " concat('BSB - ', element_at(array('062-000', 'TBC', '000-000'), cast(c_custkey % 3 as int) + 1)),"
        " concat('ABN: 51 824 753 55', c_custkey % 10), concat('Mobile: 04', lpad(c_custkey, 8, '0')),"
        " concat('Email Address: p', c_custkey, '@mail.example.com'),"
        " case when c_custkey % 2 = 0 then 'Gross Annual Income: $85,000.00' else 'Gross annual income' end,"
        " concat('Total paid $91,500.00 and $', 100 + c_custkey % 900, '.50'),"
        " concat('Statement 01/01/2024, branch 013-', lpad(c_custkey % 1000, 3, '0')), 'Card 4111 1111 1111 1111') as text",
    )


_NAMES = ", ".join(f"'{n}'" for n in NAMES)
#: DuckDB expressions of the tables above, by name.
SQL = {
    "docs": """docs as (select c_custkey as id, c_name || (['.pdf', '.PNG', '.txt', '.exe', '.docx'])[(c_custkey % 5 + 1)::int] as filename,
  '/in/' || c_mktsegment || '/' || c_name as original_path, sha256((c_custkey % 997)::varchar) as content_hash,
  (['extracted', 'failed', 'queued', 'processing'])[(c_nationkey % 4 + 1)::int] as status, trunc(c_acctbal * 100)::bigint as bytes from customer)""",
    "extractions": "extractions as (select o_orderkey as id, o_custkey as document_id, o_orderdate as created_at, o_orderpriority as raw_text, o_totalprice as score from orders)",
    "fields": f"""fields as (select l_orderkey as extraction_id, ([{_NAMES}])[l_linenumber] as field_name,
  case when l_partkey % 11 = 0 then '' else 'v' || (l_partkey % 50) end as field_value, round(l_discount * 10, 2) as confidence,
  case when l_returnflag = 'R' then 'c' || (l_suppkey % 20) end as corrected_value, l_linestatus = 'F' as approved,
  l_partkey * 100000 + l_suppkey * 100 + trunc(l_quantity)::bigint as seq from lineitem)""",
    "jobs": """jobs as (select o_orderkey as id, o_custkey as document_id,
  case o_orderstatus when 'F' then 'completed' when 'O' then 'queued' else 'processing' end as status,
  o_orderdate as started_at, (o_orderkey % 5)::int as attempts from orders)""",
    "people": """people as (select c_custkey as document_id, case when c_custkey % 13 = 0 then null else ' Fam' || (c_custkey % 97) || ' ' end as family,
  upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) as given,
  case c_custkey % 4 when 0 then (1950 + c_nationkey) || '-' || lpad((1 + c_nationkey % 12)::varchar, 2, '0') || '-14'
   when 1 then '14/' || lpad((1 + c_nationkey % 12)::varchar, 2, '0') || '/' || (1950 + c_nationkey)
   when 2 then '14 ' || (['Jan','Feb','Mar','Apr','May','June','Jul','Aug','Sept','Oct','Nov','December'])[(c_nationkey % 12 + 1)::int] || ' ' || (1950 + c_nationkey)
   else '03/0' || (1 + c_nationkey % 9) || '/' || (50 + c_nationkey) end as dob,
  c_name || '.pdf' as filename, (['extracted', 'failed', 'queued', 'processing'])[(c_nationkey % 4 + 1)::int] as status from customer)""",
    "index": """idx as (select c_custkey as id, c_name as name, case when c_custkey % 3 = 0 then null else '2' || lpad(c_custkey::varchar, 9, '0') end as number,
  case c_custkey % 3 when 1 then true when 2 then (case when c_custkey % 2 = 0 then false end) end as valid,
  (['M', 'F', ''])[(c_custkey % 3 + 1)::int] as sex, c_mktsegment as state,
  case c_custkey % 6 when 0 then null when 1 then '20' || (20 + c_nationkey) || '-0' || (1 + c_nationkey % 9)
   when 2 then lpad((1 + c_nationkey % 12)::varchar, 2, '0') || '/' || (10 + c_nationkey)
   when 3 then lpad((c_nationkey % 15)::varchar, 2, '0') || '/20' || (15 + c_nationkey)
   when 4 then '20' || (22 + c_nationkey % 9) || '-11-30' else 'n/a' end as expiry,
  'f' || (c_custkey % 50) || ';f' || (c_custkey % 7) || ';f' || (c_custkey % 50) as source_files,
  (1 + c_custkey % 4)::int as record_count, c_acctbal < 0 as review from customer)""",
    # what the lines of the forms say, by construction: field, value, confidence, whether a line or a search for shapes gives it
    "form_lines": """form_lines as (select c_custkey as doc_id, unnest([
    {'line_no': 1, 'field_name': 'given_names', 'value': upper(c_mktsegment[1]) || lower(c_mktsegment[2:])}, {'line_no': 2, 'field_name': 'family_name', 'value': 'Fam' || (c_custkey % 97)},
    {'line_no': 3, 'field_name': 'date_of_birth', 'value': case c_custkey % 4 when 0 then '14/02/1980' end}, {'line_no': 4, 'field_name': 'bsb', 'value': case c_custkey % 3 when 0 then '062-000' end},
    {'line_no': 5, 'field_name': 'abn', 'value': case c_custkey % 10 when 6 then '51 824 753 556' end}, {'line_no': 6, 'field_name': 'mobile_number', 'value': '04' || lpad(c_custkey::varchar, 8, '0')},
    {'line_no': 7, 'field_name': 'email_address', 'value': 'p' || c_custkey || '@mail.example.com'}, {'line_no': 8, 'field_name': 'gross_annual_income', 'value': case c_custkey % 2 when 0 then '$85,000.00' end}
  ], recursive := true) from customer)""",
    "pages": """pages_v as (select user_id as doc_id, event_id::int as page,
  case event_type when 'error' then 'blank' when 'click' then 'printed' when 'view' then 'printed' else 'handwritten' end as kind,
  least(value / 40, 1.0) as probe_conf, trunc(value * 4)::int as alnum, least(value / 100, 1.0) as ink,
  'k' || json_extract_string(props, '$.k') as probe_text from events)""",
}


def with_views(*names: str) -> str:
    return "with " + ",\n".join(SQL[n] for n in names)
