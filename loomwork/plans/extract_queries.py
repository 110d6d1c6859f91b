"""Queries of text extraction, verification and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions import checks, dates, keys, vocabulary
from loomwork.operators import extract, index, verify
from loomwork.plans import views
from loomwork.plans.aggregate_queries import DOB_KEY
from loomwork.plans.registry import registry
from loomwork.plans.stream_queries import shared
from loomwork.plans.views import with_views

QUERIES, query = registry()
#: Patterns of the sweep without lookarounds, which DuckDB's engine lacks: (name, pattern).
PLAIN = [
    ("email", r"[A-Za-z0-9_.%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}"),
    ("phone_us", r"\+1 \([0-9]{3}\) 555-[0-9]{4}"),
    ("card", r"[0-9]{16}"),
    ("ipv4", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
    ("secret", r'[a-z_]+ = "[^"]+"'),
]
SHAPES = [(n, p, 0.9) for n, p in PLAIN]
_SWEEP = " union all ".join(f"select doc_id, '{n}' as field_name, unnest(regexp_extract_all(text, '{p}')) as value from documents" for n, p in PLAIN)


def documents(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", "text")


def matches(spark, sf_dir):
    return extract.sweep(documents(spark, sf_dir), SHAPES)


def found_values(spark, sf_dir):
    return extract.values_of(documents(spark, sf_dir), SHAPES)


@query(f"select doc_id, field_name, value, count(*) as n from ({_SWEEP}) group by all")
def x1_shape_sweep(spark, sf_dir):
    return found_values(spark, sf_dir).groupBy("doc_id", "field_name", "value").agg(F.count("*").alias("n"))


@query()
def x1_all_shapes(spark, sf_dir):
    """All shapes of the library. No SQL, as they need lookarounds; a small test compares them with a plain version."""
    return extract.values_of(documents(spark, sf_dir)).groupBy("doc_id", "field_name", "value").agg(F.count("*").alias("n"))


FORM_BSB = "'013-' || lpad((doc_id % 1000)::varchar, 3, '0')"


@query(
    """with f as (select c_custkey as doc_id from customer)
select doc_id, 'abn' as field_name, '51 824 753 55' || (doc_id % 10) as value from f
union all select doc_id, 'bsb', case doc_id % 3 when 0 then '062-000' else '000-000' end from f where doc_id % 3 <> 1
union all select doc_id, 'bsb', '013-' || lpad((doc_id % 1000)::varchar, 3, '0') from f
union all select doc_id, 'card', '4111 1111 1111 1111' from f
union all select doc_id, 'phone', '04' || lpad(doc_id::varchar, 8, '0') from f
union all select doc_id, 'date', d from f, (select unnest(['14/02/1980', '31/02/1980', null, '05/06/2020', '01/01/2024']) as d, unnest([0, 1, 2, 3, 4]) as k) where d is not null and (k = 4 or k = doc_id % 4)"""
)
def x4_form_ownership(spark, sf_dir):
    """Who owns which digits of the forms: none of a card, a phone or a labelled business number is read as a branch number or postcode."""
    # dealt by document, so that a few large files have all cores and the sweeps of a document need no other shuffle
    forms = views.forms(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    shapes = [s for s in extract.SHAPES if s[0] not in ("email", "currency")]
    return extract.owned(extract.sweep(forms, shapes)).select("doc_id", "field_name", "value")


@query(with_views("form_lines") + " select doc_id, line_no, field_name, value, 0.95::double as confidence from form_lines where value is not null")
def x5_label_scan(spark, sf_dir):
    """The whole label pack over forms; a failed check kills its line."""
    lines = extract.labelled_lines(views.forms(spark, sf_dir), valid=extract.validators("2025-06-30"))
    return lines.select("doc_id", "line_no", "field_name", "value", "confidence")


@query(
    with_views("form_lines")
    + """ select doc_id, line_no, field_name, value, case when doc_id % 5 = 0 then 0.5 else 0.75 end::double as confidence from form_lines where value is not null"""
)
def x5_read_lines(spark, sf_dir):
    """Lines of a reader: their own confidence where it is known, else the default."""
    f = views.forms(spark, sf_dir)
    known = f.where("doc_id % 5 = 0").select("doc_id", F.explode(F.split("text", "\n")).alias("line"), F.lit(0.5).alias("confidence"))
    lines = extract.labelled_lines(f, valid=extract.validators("2025-06-30"), readings=extract.line_confidence(known))
    return lines.select("doc_id", "line_no", "field_name", "value", "confidence")


FULL = (
    with_views("form_lines")
    + """, rows as (
  select doc_id, field_name, value, case field_name when 'abn' then 1.0 when 'email_address' then 0.98 else 0.95 end::double as confidence from form_lines where value is not null and field_name <> 'bsb'
  union all select c_custkey, 'bsb', case c_custkey % 3 when 0 then '062-000' else '013-' || lpad((c_custkey % 1000)::varchar, 3, '0') end, 0.95 from customer
  union all select c_custkey, 'gross_annual_income', '$91,500.00', 0.88 from customer where c_custkey % 2 = 1
  union all select c_custkey, 'net_monthly_income', case c_custkey % 2 when 0 then '$85,000.00' else '$' || (100 + c_custkey % 900) || '.50' end, 0.84 from customer)"""
)


@query(FULL + " select doc_id, field_name, value, confidence from rows")
def x22_full_job(spark, sf_dir):
    return extract.extract_fields(views.forms(spark, sf_dir), "2025-06-30")


@query(
    FULL
    + """ select doc_id, string_agg(field_name || '=' || value || '@' || round(confidence * 100)::int, ';' order by field_name) as fields,
  bool_or(field_name = 'abn') as valid_abn, bool_or(field_name = 'bsb') as valid_bsb, bool_or(field_name = 'date_of_birth') as valid_dob from rows group by 1"""
)
def x22_full_rows(spark, sf_dir):
    """Fields and confidences of a document as maps, and whether three of them hold; the maps as text."""
    rows = extract.extraction_rows(extract.extract_fields(views.forms(spark, sf_dir), "2025-06-30"), "2025-06-30")
    each = F.transform(F.map_keys("fields"), lambda k: F.concat(k, F.lit("="), F.col("fields")[k], F.lit("@"), F.round(F.col("confidences")[k] * 100).cast("int").cast("string")))
    return rows.select("doc_id", F.array_join(each, ";").alias("fields"), "valid_abn", "valid_bsb", "valid_dob")


@query("select c_custkey as doc_id, '51824753556' as abn, case when c_custkey % 10 = 6 then 150 else 50 end as score from customer where c_custkey % 10 = 6 union all select c_custkey, '5182475355' || (c_custkey % 10), 50 from customer where c_custkey % 10 <> 6")
def x10_choose_abn(spark, sf_dir):
    """The best business number of a form: a check sum counts 100, a label 50; slices of the card lose to it."""
    found = extract.sweep(views.forms(spark, sf_dir), [("abn", extract.SHAPE["abn"], 1.0)])
    return extract.choose_abn(found)


@query(
    r"""with m as (select doc_id, text, unnest(regexp_extract_all(text, '\+1 \([0-9]{3}\) 555-[0-9]{4}')) as value from documents)
select doc_id, value, position(value in text) - 1 as s, position(value in text) - 1 + length(value) as e from (select distinct * from m)"""
)
def x2_match_offsets(spark, sf_dir):
    m = matches(spark, sf_dir).where("field_name = 'phone_us'")
    return m.groupBy("doc_id", "value").agg(F.min("s").cast("long").alias("s")).select("doc_id", "value", "s", (F.col("s") + F.length("value")).alias("e"))


@query(
    r"""with m as (select doc_id, text, unnest(regexp_extract_all(text, '"[0-9a-f]{40}"')) as value from documents), p as (select distinct *, position(value in text) as pos from m)
select doc_id, value, regexp_matches(substr(text, greatest(1, pos - 12), least(pos - 1, 12)), '(?i)(token)[^a-zA-Z0-9_]{0,12}$') as labelled from p"""
)
def x3_near_label(spark, sf_dir):
    m = extract.sweep(documents(spark, sf_dir), [("hash", r'"[0-9a-f]{40}"', 0.9)]).groupBy("doc_id", "value").agg(F.min("s").alias("s"))
    d = documents(spark, sf_dir)
    return m.join(d, "doc_id").select("doc_id", "value", extract.near_label(F.col("text"), F.col("s"), "token", 12).alias("labelled"))


@query()
def x4_span_ownership(spark, sf_dir):
    """No SQL: the weak shapes need lookarounds; a small test compares spans by hand."""
    return extract.owned(extract.sweep(documents(spark, sf_dir))).select("doc_id", "field_name", "s", "e", "value")


@query(
    r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents),
  p as (select doc_id, line_no, regexp_extract(trim(line), '^([^:\t=-]*)[:\t=-](.*)$', 1) as label, trim(regexp_extract(trim(line), '^([^:\t=-]*)[:\t=-](.*)$', 2)) as value, trim(line) as line from l)
select doc_id, line_no::int as line_no, case when regexp_matches(line, '(?i)token') then 'secret' when regexp_matches(line, '(?i)licen[cs]e') then 'licence' else 'mail' end as field_name, label, value from p
where regexp_matches(line, '(?i)token|licen[cs]e|@') and length(value) > 1"""
)
def x5_labelled_lines(spark, sf_dir):
    found = extract.labelled_lines(documents(spark, sf_dir), [("secret", "token"), ("licence", "licen[cs]e"), ("mail", "@")])
    return found.select("doc_id", "line_no", "field_name", "label", "value")


@query(
    "with m as (select l_orderkey as doc_id, l_extendedprice as v from lineitem), t as (select doc_id, max(v) as gross, list_sort(list_distinct(list(v)), 'DESC') as every from m group by 1) select doc_id, case when gross > 30000 then gross end as gross, every[2] as net from t"
)
def x6_bind_currency(spark, sf_dir):
    m = views.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as doc_id", "'currency' as field_name", "concat('$', format_string('%.2f', l_extendedprice)) as value")
    return extract.bind_currency(m)


@query(
    r"select p_partkey, regexp_extract(p_name || ' ' || p_partkey || '@mail.com', '[^\s@]+@[^\s@]+\.[A-Za-z]{2,}') as mail, regexp_replace(trim(p_name || ';,. '), '[\s,;:.]+$', '') as bare from part"
)
def x12_clean_value(spark, sf_dir):
    p = views.table(spark, sf_dir, "part")
    mail = F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"), F.lit("@mail.com;"))
    return p.select("p_partkey", extract.clean_value(F.lit("email"), mail).alias("mail"), extract.clean_value(F.lit("text"), F.concat("p_name", F.lit(";,. "))).alias("bare"))


ABN = "lpad((o_orderkey * 7919 + 51824753000)::varchar, 11, '0')"
ABN_OK = f"list_sum(list_transform(range(1, 12), lambda i: ({ABN})[i]::int * ([10,1,3,5,7,9,11,13,15,17,19])[i])) - 10"


@query(f"select o_orderkey, ({ABN_OK}) % 89 = 0 as valid from orders")
def v1_abn_checksum(spark, sf_dir):
    return views.table(spark, sf_dir, "orders").select("o_orderkey", checks.abn_valid(F.expr("lpad(o_orderkey * 7919 + 51824753000, 11, '0')")).alias("valid"))


@query(
    f"""with a as (select o_orderkey, {ABN} as abn from orders) select o_orderkey, case when (list_sum(list_transform(range(1, 12), lambda i: abn[i]::int * ([10,1,3,5,7,9,11,13,15,17,19])[i])) - 10) % 89 = 0 then abn end as abn from a"""
)
def x10_repaired_abn(spark, sf_dir):
    """Zeros are written as O; the repair may read them only where six real digits are left."""
    abn = F.expr("lpad(o_orderkey * 7919 + 51824753000, 11, '0')")
    broken = F.when(F.length(F.replace(abn, F.lit("0"), F.lit(""))) >= 6, F.replace(abn, F.lit("0"), F.lit("O"))).otherwise(abn)
    return views.table(spark, sf_dir, "orders").select("o_orderkey", extract.repaired_abn(broken).alias("abn"))


@query(
    """with d as (select o_orderkey, lpad((o_orderkey * 104729 % 1000000000)::varchar, 9, '0') as t, lpad((2000000000 + o_orderkey * 15485863 % 4900000000)::varchar, 10, '0') as m from orders)
select o_orderkey, list_sum(list_transform(range(1, 10), lambda i: t[i]::int * ([1,4,3,7,5,8,6,9,10])[i])) % 11 = 0 as tfn,
  (10 - list_sum(list_transform(range(1, 9), lambda i: t[i]::int * (9 - i))) % 10) % 10 = t[9]::int as acn,
  m[1]::int between 2 and 6 and m[10] <> '0' and list_sum(list_transform(range(1, 9), lambda i: m[i]::int * ([1,3,7,9,1,3,7,9])[i])) % 10 = m[9]::int as medicare,
  list_sum(list_transform(range(1, 9), lambda i: t[i + 1]::int * ([10,7,8,4,6,3,5,1])[i])) % 11 = 0 as tfn_old from d"""
)
def v2_number_checksums(spark, sf_dir):
    t, m = F.expr("lpad(o_orderkey * 104729 % 1000000000, 9, '0')"), F.expr("lpad(2000000000 + o_orderkey * 15485863 % 4900000000, 10, '0')")
    return views.table(spark, sf_dir, "orders").select("o_orderkey", checks.tfn_valid(t).alias("tfn"), checks.acn_valid(t).alias("acn"), checks.medicare_valid(m).alias("medicare"), checks.tfn_valid(t.substr(2, 8)).alias("tfn_old"))


@query(
    r"""with c as (select distinct doc_id, unnest(regexp_extract_all(text, '[0-9]{16}')) as card from documents)
select doc_id, card, list_sum(list_transform(range(1, 17), lambda i: case when i % 2 = 0 then card[i]::int else (card[i]::int * 2) // 10 + (card[i]::int * 2) % 10 end)) % 10 = 0 as valid from c"""
)
def v2_card_luhn(spark, sf_dir):
    m = found_values(spark, sf_dir).where("field_name = 'card'").select("doc_id", F.col("value").alias("card")).distinct()
    return m.withColumn("valid", checks.card_valid(F.col("card")))


#: Postcodes of the states, written for the SQL alone.
_RANGES = (
    "when code::int between 2600 and 2618 or code::int between 2900 and 2920 or code::int between 200 and 299 then 'ACT' when code[1] in ('1', '2') then 'NSW' when code[1] in ('3', '8') then 'VIC' "
    "when code[1] in ('4', '9') then 'QLD' when code[1] = '5' then 'SA' when code[1] = '6' then 'WA' when code[1] = '7' then 'TAS' when code[1:2] in ('08', '09') then 'NT'"
)


@query(
    f"""with p as (select o_orderkey, lpad((o_orderkey * 37 % 10000)::varchar, 4, '0') as code, '0' || (o_orderkey % 9) || lpad((o_orderkey * 7919 % 100000000)::varchar, 8, '0') as phone, lpad((o_orderkey * 11 % 1000000)::varchar, 6, '0') as bsb from orders)
select o_orderkey, case {_RANGES} when code::int >= 200 then 'UNKNOWN' end as state, regexp_matches(phone, '^(04[0-9]{{8}}|0[2378][0-9]{{8}})$') as phone_ok, bsb <> '000000' as bsb_ok,
  bsb[1:3] || '-' || bsb[4:] as bsb_canonical from p"""
)
def v3_postcode_phone_bsb(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").selectExpr("o_orderkey", "lpad(o_orderkey * 37 % 10000, 4, '0') as code", "concat('0', o_orderkey % 9, lpad(o_orderkey * 7919 % 100000000, 8, '0')) as phone", "lpad(o_orderkey * 11 % 1000000, 6, '0') as bsb")
    return o.select("o_orderkey", checks.postcode_state(F.col("code")).alias("state"), checks.phone_valid(F.col("phone")).alias("phone_ok"), checks.bsb_valid(F.col("bsb")).alias("bsb_ok"), checks.bsb_canonical(F.col("bsb")).alias("bsb_canonical"))


@query(
    """with d as (select o_orderkey, (o_orderkey % 31 + 1)::int as d, (o_custkey % 12 + 1)::int as m, (1900 + o_orderkey % 130)::int as y from orders),
  b as (select *, try_cast(y || '-' || lpad(m::varchar, 2, '0') || '-' || lpad(d::varchar, 2, '0') as date) as born from d)
select o_orderkey, case when born is null then 'calendar' when born > date '2025-06-30' then 'future'
  when 2025 - y - ((m, d) > (6, 30))::int < 16 then 'too_young' when 2025 - y - ((m, d) > (6, 30))::int > 120 then 'too_old' end as error,
  d <= 12 and d <> m as ambiguous from b"""
)
def v4_dob_check(spark, sf_dir):
    dob = F.expr("concat(lpad(o_orderkey % 31 + 1, 2, '0'), '/', lpad(o_custkey % 12 + 1, 2, '0'), '/', 1900 + o_orderkey % 130)")
    return views.table(spark, sf_dir, "orders").select("o_orderkey", checks.dob_error(dob, F.lit("2025-06-30").cast("date")).alias("error"), checks.dob_ambiguous(dob).alias("ambiguous"))


CHECKED = """v as (select o_orderkey as id, (['abn', 'abn', 'tfn', 'acn', 'medicare', 'card', 'bsb', 'phone', 'postcode', 'date_of_birth', 'note', 'card'])[(o_orderkey % 12 + 1)::int] as field_name, o_orderkey as k, o_custkey as c from orders),
  w as (select *, case o_orderkey_mod when 0 then lpad((k * 7919 + 11824753000)::varchar, 11, '0') when 1 then '0' || lpad((k % 10000000000)::varchar, 10, '0') when 2 then lpad((k * 104729 % 1000000000)::varchar, 9, '0')
    when 3 then lpad((k * 104729 % 1000000000)::varchar, 9, '0') when 4 then '2' || lpad((k * 15485863 % 1000000000)::varchar, 9, '0') when 5 then '4' || lpad((k * 15485863 % 1000000000000000)::varchar, 15, '0')
    when 6 then lpad((k % 3 * 62000)::varchar, 6, '0') when 7 then '0' || (c % 10) || lpad(k::varchar, 8, '0') when 8 then lpad((c % 10000)::varchar, 4, '0')
    when 9 then lpad((k % 31 + 1)::varchar, 2, '0') || '/' || lpad((c % 12 + 1)::varchar, 2, '0') || '/' || (1950 + k % 40) when 10 then 'n' || k else '4111 **** **** ' || lpad((k % 10000)::varchar, 4, '0') end as value from (select *, k % 12 as o_orderkey_mod from v))"""
_SUM = "list_sum(list_transform({w}, lambda x, i: value[i]::int * x))"


@query(
    f"""with {CHECKED}, r as (select *, case k % 12
    when 0 then (list_sum(list_transform([10,1,3,5,7,9,11,13,15,17,19], lambda x, i: value[i]::int * x)) - 10) % 89 = 0 when 1 then false
    when 2 then {_SUM.format(w='[1,4,3,7,5,8,6,9,10]')} % 11 = 0 when 3 then (10 - {_SUM.format(w='[8,7,6,5,4,3,2,1]')} % 10) % 10 = value[9]::int
    when 4 then value[10] <> '0' and {_SUM.format(w='[1,3,7,9,1,3,7,9]')} % 10 = value[9]::int
    when 5 then list_sum(list_transform(range(1, 17), lambda i: case when i % 2 = 0 then value[i]::int else (value[i]::int * 2) // 10 + (value[i]::int * 2) % 10 end)) % 10 = 0
    when 6 then value <> '000000' when 7 then value[2] in ('2', '3', '4', '7', '8') when 8 then value::int >= 200
    when 9 then try_cast(value[7:] || '-' || value[4:5] || '-' || value[1:2] as date) is not null when 11 then true end as valid from w)
select id, field_name, value, valid, case when k % 12 = 10 then 'no_rule' when valid then 'ok' when k % 12 = 1 then 'abn_leading_zero' when k % 12 = 6 then 'bsb_unassigned' when k % 12 = 7 then 'phone_shape'
    when k % 12 = 8 then 'postcode_zone' when k % 12 = 9 then 'date_of_birth_calendar' else field_name || '_checksum' end as code,
  case when not valid then null when k % 12 = 0 then value[1:2] || ' ' || value[3:5] || ' ' || value[6:8] || ' ' || value[9:] when k % 12 = 6 then value[1:3] || '-' || value[4:]
    when k % 12 = 9 then value[7:] || '-' || value[4:5] || '-' || value[1:2] when k % 12 < 10 then value end as canonical,
  case when valid is null then null else (case when valid then 'a ' else 'not a ' end) || (['business number with its check sum', 'business number with its check sum', 'tax file number with its check sum', 'company number with its check digit',
    'card number with its check digit', 'card number', 'branch number', 'phone number', 'postcode', 'date of birth', '', 'card number'])[(k % 12 + 1)::int] end as message from r"""
)
def v5_validate_fields(spark, sf_dir):
    """Every rule of the dispatcher over made values of its kind, with code, canonical form and message."""
    v = views.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as id",
        "element_at(array('abn', 'abn', 'tfn', 'acn', 'medicare', 'card', 'bsb', 'phone', 'postcode', 'date_of_birth', 'note', 'card'), cast(o_orderkey % 12 as int) + 1) as field_name",
        "case o_orderkey % 12 when 0 then lpad(o_orderkey * 7919 + 11824753000, 11, '0') when 1 then concat('0', lpad(o_orderkey % 10000000000, 10, '0')) when 2 then lpad(o_orderkey * 104729 % 1000000000, 9, '0')"
        " when 3 then lpad(o_orderkey * 104729 % 1000000000, 9, '0') when 4 then concat('2', lpad(o_orderkey * 15485863 % 1000000000, 9, '0')) when 5 then concat('4', lpad(o_orderkey * 15485863 % 1000000000000000, 15, '0'))"
        " when 6 then lpad(o_orderkey % 3 * 62000, 6, '0') when 7 then concat('0', o_custkey % 10, lpad(o_orderkey, 8, '0')) when 8 then lpad(o_custkey % 10000, 4, '0')"
        " when 9 then concat(lpad(o_orderkey % 31 + 1, 2, '0'), '/', lpad(o_custkey % 12 + 1, 2, '0'), '/', 1950 + o_orderkey % 40) when 10 then concat('n', o_orderkey) else concat('4111 **** **** ', lpad(o_orderkey % 10000, 4, '0')) end as value",
    )
    return verify.validate_fields(v, "2025-06-30").select("id", "field_name", "value", "valid", "code", "canonical", "message")


#: Values of many kinds; # stands for a number.
TEXTS = (
    "Family Name", "Please enter", "Who is it?", "Doe#", "Mary Ann", "14/02/198#", "(in full)", "or family name Reddy", "# High Street, Town", "04 1234 567#", "a#@mail.com",
    "to request your tax file number you must complete the form", "N123456#", "the sum of all that is in it by then", "Full-time", "Date", "given all of it back", "Jan 1#, 1990", "张伟#", "---",
)
SANE_FIELDS = ("family_name", "given_names", "date_of_birth", "email_address", "mobile_number", "residential_address", "passport_details", "employer_details")


def _listed(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _count(words) -> str:
    return f"len(list_filter(w, lambda x: list_contains({_listed(words)}, x)))"


SANE = f"""s as (select l_orderkey as extraction_id, l_partkey * 100000 + l_suppkey * 100 + trunc(l_quantity)::bigint as seq, (['applicant', 'spouse'])[(l_suppkey % 2 + 1)::int] as subject,
    ({_listed(SANE_FIELDS)})[(l_orderkey % 8 + 1)::int] as field_name, replace(({_listed(TEXTS)})[(l_partkey % {len(TEXTS)} + 1)::int], '#', (l_suppkey % 10)::varchar) as value from lineitem),
  t as (select *, list_filter(regexp_split_to_array(lower(value), '[^a-z0-9]+'), lambda x: x <> '') as w, list_filter(regexp_split_to_array(lower(value), '[^a-z]+'), lambda x: x <> '') as a,
    list_transform(regexp_split_to_array(value, '\\s+'), lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))) as bare, regexp_split_to_array(value, '\\s+') as tokens, regexp_replace(value, '[^0-9]', '', 'g') as d from s),
  k as (select *, list_filter(range(1, len(tokens) + 1), lambda i: bare[i] <> '' and not list_contains({_listed(vocabulary.LABEL_WORDS)}, bare[i])) as own from t),
  n as (select *, case when len(own) > 0 then tokens[own[1]:own[len(own)]] else [] end as name from k),
  w as (select extraction_id, seq, subject, field_name, value, case when len(w) = 0 then 'label'
    when field_name = 'date_of_birth' then case when not (length(value) <= 24 and regexp_matches(value, '(?i)[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}|[a-z]{{3,9}} [0-9]{{1,2}}, [0-9]{{4}}|[0-9]{{2}} [0-9]{{4}} [0-9]{{3}}')) then 'not_a_date' end
    when value[length(value)] = '?' then 'question'
    when field_name in ('family_name', 'given_names') then case when len(name) = 0 then 'label' when len(name) > 4 or regexp_matches(array_to_string(name, ' '), '[0-9()/\\\\@#]') then 'not_a_name' end
    when field_name = 'email_address' then case when not regexp_matches(value, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]{{2,}}$') then 'not_an_email' end
    when field_name = 'mobile_number' then case when not (regexp_matches(d, '^(04[0-9]{{8}}|614[0-9]{{8}}|6104[0-9]{{8}})$') and not regexp_matches(value, '[A-Za-z]{{3}}')) then 'not_a_mobile' end
    when field_name = 'residential_address' then case when not (d <> '' and len(list_filter(a, lambda x: list_contains({_listed(vocabulary.STREET_WORDS)}, x))) > 0 and length(value) >= 8) then 'not_an_address' end
    when field_name = 'passport_details' then case when not (d <> '' and len(list_filter(tokens, lambda x: regexp_matches(x, '[A-Za-z]{{3}}'))) <= 2 and length(value) <= 24) then 'not_an_id' end
    when len(tokens) = 1 then case when list_contains({_listed(vocabulary.SINGLE_LABELS)}, array_to_string(w, ' ')) then 'label' end
    when len(w) <= 10 and {_count(vocabulary.LABEL_WORDS)} >= 0.8 * len(w) then 'label'
    when len(w) >= 4 and {_count(vocabulary.INSTRUCTION_WORDS)} >= 1 or {_count(vocabulary.INSTRUCTION_WORDS)} = len(w) then 'instruction'
    when len(w) >= 6 and {_count(vocabulary.STOP_WORDS)} >= 0.3 * len(w) then 'instruction' when len(w) >= 4 and regexp_matches(value, '^[a-z]') then 'instruction' end as reason from n),
  y as (select *, regexp_matches(value, '[\\p{{Han}}]') as cjk from w)"""


def sane(spark, sf_dir):
    v = views.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("extraction_id"),
        F.expr("l_partkey * 100000 + l_suppkey * 100 + cast(l_quantity as bigint)").alias("seq"),
        F.expr("element_at(array('applicant', 'spouse'), cast(l_suppkey % 2 as int) + 1)").alias("subject"),
        F.element_at(F.array(*map(F.lit, SANE_FIELDS)), F.expr("cast(l_orderkey % 8 as int) + 1")).alias("field_name"),
        F.replace(F.element_at(F.array(*map(F.lit, TEXTS)), F.expr(f"cast(l_partkey % {len(TEXTS)} as int) + 1")), F.lit("#"), F.expr("cast(l_suppkey % 10 as string)")).alias("value"),
    )
    return verify.verify_records(v)


@query(f"with {SANE} select extraction_id, seq, field_name, value, case when not cjk then reason end as reason, case when cjk then 'cjk' when reason is null then 'ok' else 'junk' end as verif from y")
def v6_value_sanity(spark, sf_dir):
    return sane(spark, sf_dir).select("extraction_id", "seq", "field_name", "value", "reason", "verif")


@query(f"with {SANE} select field_name, count(*) filter (where not cjk and reason is null) as ok, count(*) filter (where cjk) as cjk, count(*) filter (where not cjk and reason is not null) as junk from y group by 1")
def a13_verify_stats(spark, sf_dir):
    return verify.verify_stats(sane(spark, sf_dir))


@query(
    f"""with {SANE}, j as (select * from y where not cjk and reason is not null)
select 'reason' as level, null as subject, null as field_name, reason, count(*) as n from j group by reason union all select 'field', subject, field_name, reason, count(*) from j group by all"""
)
def a13_verify_reasons(spark, sf_dir):
    return verify.verify_reasons(sane(spark, sf_dir))


@query("select p_partkey, case p_partkey % 5 when 0 then '' when 1 then p_name || ' x' when 2 then 'Van ' || p_name else p_name end as name from part")
def v7_trim_labels(spark, sf_dir):
    text = F.expr("case p_partkey % 5 when 0 then 'Given Name: (in full)' when 1 then concat('or family name ', p_name, ' x Date') when 2 then concat('  Van ', p_name, ' - ') when 3 then p_name else concat('Given Name: ', p_name, ' (Signature)') end")
    return views.table(spark, sf_dir, "part").select("p_partkey", verify.trim_labels(text).alias("name"))


@query(with_views("people") + f" select document_id, {DOB_KEY} as dob_key from people")
def v12_dob_key(spark, sf_dir):
    return views.people(spark, sf_dir).select("document_id", dates.dob_key(F.col("dob")).alias("dob_key"))


@query(with_views("people") + " select document_id, true as reliable from people")
def v12_dob_reliable(spark, sf_dir):
    return views.people(spark, sf_dir).select("document_id", dates.dob_reliable(F.col("dob")).alias("reliable"))


@query(with_views("people") + f" select document_id, case when family is not null then sha256(lower(trim(family)) || '|' || lower(trim(given)) || '|' || {DOB_KEY})[1:16] end as identity_id from people")
def v13_identity_key(spark, sf_dir):
    return views.people(spark, sf_dir).select("document_id", keys.identity_id(F.col("family"), F.col("given"), F.col("dob")).alias("identity_id"))


@query("select doc_id, sha256(text) as content_hash from documents")
def v14_content_hash(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query(
    """select event_id, (['pdf', 'image', 'text', 'program', 'text'])[(event_id % 5 + 1)::int] as kind from events"""
)
def v15_content_sniff(spark, sf_dir):
    head = F.expr("case event_id % 5 when 0 then X'255044462D312E37' when 1 then X'89504E470D0A1A0A00' when 2 then cast(concat('plain ', event_id) as binary) when 3 then X'4D5A9000' else cast('text' as binary) end")
    return views.table(spark, sf_dir, "events").select("event_id", verify.sniff(head).alias("kind"))


@query(
    """with f as (select c_custkey as id, (case c_custkey % 4 when 0 then '.hidden' else c_name end) || (['.pdf', '.PNG', '.txt', '.exe', '.docx'])[(c_custkey % 5 + 1)::int] as name, trunc(c_acctbal)::bigint as bytes, (['pdf', 'text', 'text', 'program', 'office'])[(c_custkey % 5 + 1)::int] as kind, c_nationkey = 3 as is_blank from customer)
select id, case when name[1] = '.' then 'junk_name' when kind = 'program' then 'junk_type' when bytes < 100 then 'tiny' when id % 5 = 1 then 'corrupt' when is_blank then 'blank' end as stage from f"""
)
def v16_curation(spark, sf_dir):
    from loomwork.functions.text import category

    f = views.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as id",
        "concat('/x/', case c_custkey % 4 when 0 then '.hidden' else c_name end, element_at(array('.pdf', '.PNG', '.txt', '.exe', '.docx'), cast(c_custkey % 5 as int) + 1)) as path",
        "cast(c_acctbal as bigint) as bytes",
        "element_at(array('pdf', 'text', 'text', 'program', 'office'), cast(c_custkey % 5 as int) + 1) as kind",
        "c_nationkey = 3 as is_blank",
    )
    return verify.curation(f.withColumn("category", category(F.col("path")))).select("id", "stage")


@query(with_views("pages") + """ select doc_id, bool_and(kind = 'printed') and min(probe_conf) >= 0.6 and min(alnum) >= 40 and count(*) filter (where probe_text = 'k7') = 0 as park from pages_v group by 1""")
def v17_park_decision(spark, sf_dir):
    """Every page counts; a document with a hit in its probe text is not parked."""
    p = views.pages(spark, sf_dir)
    return verify.park(p, p.where("probe_text = 'k7'"))


@query(
    """select l_orderkey as doc_id, bool_and(l_linenumber <= 6) and min(l_tax) * 10 >= 0.1 and min(l_quantity) >= 4 as park from lineitem group by 1"""
)
def v17_park_pages(spark, sf_dir):
    """The same over lines as pages, where many documents are parked."""
    p = views.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as doc_id", "case when l_linenumber <= 6 then 'printed' else 'blank' end as kind", "l_tax * 10 as probe_conf", "l_quantity as alnum")
    return verify.park(p, sure=0.1, least=4)


FLAGGED = """f as (select l_orderkey as doc_id, l_linenumber as page, (['given_names', 'family_name', 'date_of_birth', 'bsb', 'account_number', 'passport_details', 'note'])[l_linenumber] as field_name,
    'v' || (l_partkey % 3) as value, (['applicant', 'unknown', 'spouse'])[(l_suppkey % 3 + 1)::int] as subject, case when l_returnflag = 'R' then 'handwriting' else 'print' end as source, l_discount * 10 as confidence,
    case l_partkey % 5 when 0 then false when 1 then true end as digits_read, case when l_partkey % 7 = 0 then 'w' end as alternate, case l_suppkey % 4 when 0 then false when 1 then true end as valid from lineitem),
  d as (select o_orderkey as doc_id, (['loan_application', 'passport', 'bank_statement', 'other', 'mixed'])[(o_custkey % 5 + 1)::int] as type, case when o_custkey % 11 = 0 then 'passport' end as other_type from orders),
  own as (select doc_id, field_name, count(distinct value) as n from f where subject in ('applicant', 'unknown') group by all),
  idf as (select unnest(['given_names', 'family_name', 'date_of_birth', 'passport_details']) as field_name),
  want as (select 'loan_application' as type, unnest(['given_names', 'family_name', 'date_of_birth']) as field_name union all select 'passport', unnest(['family_name', 'date_of_birth', 'passport_details']) union all select 'bank_statement', unnest(['account_number', 'bsb']))"""


@query(
    f"""with {FLAGGED}
select doc_id, 'PAGE_DEGRADED' as code, page, null as field_name from f where source = 'handwriting' union all select doc_id, 'PAGE_KIND_UNCERTAIN', page, null from f where page = 7
union all select doc_id, 'DOC_TYPE_UNSURE', null, null from d where type in ('other', 'mixed') union all select doc_id, 'DOC_TYPE_DISAGREE', null, null from d where other_type is not null
union all select doc_id, 'SOURCES_DISAGREE', page, field_name from f where alternate is not null union all select doc_id, 'DIGITS_NOT_READ', page, field_name from f where digits_read = false
union all select doc_id, 'LOW_CONFIDENCE', page, field_name from f where source = 'handwriting' and confidence < 0.6 union all select doc_id, 'INVALID_VALUE', page, field_name from f where valid = false
union all select doc_id, 'OWNER_UNKNOWN', page, field_name from f where subject = 'unknown' and field_name in (select field_name from idf)
union all select doc_id, 'OWNER_AMBIGUOUS', null, field_name from own where n > 1 and field_name in (select field_name from idf)
union all select doc_id, 'MISSING_EXPECTED', null, w.field_name from d join want w using (type) where not exists (select 1 from own where own.doc_id = d.doc_id and own.field_name = w.field_name)
union all select l_orderkey, 'READERS_DISAGREE', l_linenumber, null from lineitem where l_suppkey % 2 = 0"""
)
def v19_all_flags(spark, sf_dir):
    """The twelve rules."""
    line = views.table(spark, sf_dir, "lineitem")
    f = line.selectExpr(
        "l_orderkey as doc_id", "l_linenumber as page", "element_at(array('given_names', 'family_name', 'date_of_birth', 'bsb', 'account_number', 'passport_details', 'note'), l_linenumber) as field_name",
        "concat('v', l_partkey % 3) as value", "element_at(array('applicant', 'unknown', 'spouse'), cast(l_suppkey % 3 as int) + 1) as subject", "case when l_returnflag = 'R' then 'handwriting' else 'print' end as source",
        "cast(l_discount * 10 as double) as confidence", "case l_partkey % 5 when 0 then false when 1 then true end as digits_read", "case when l_partkey % 7 = 0 then 'w' end as alternate", "case l_suppkey % 4 when 0 then false when 1 then true end as valid",
    )
    d = views.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as doc_id", "element_at(array('loan_application', 'passport', 'bank_statement', 'other', 'mixed'), cast(o_custkey % 5 as int) + 1) as type", "case when o_custkey % 11 = 0 then 'passport' end as other_type"
    )
    pages = line.selectExpr("l_orderkey as doc_id", "l_linenumber as page", "case when l_linenumber = 7 then 'uncertain' else 'printed' end as kind", "l_returnflag = 'R' as degraded")
    readings = line.selectExpr("l_orderkey as doc_id", "l_linenumber as page", "concat('No. ', 100000 + l_partkey, ' of 12') as one", "concat('no ', cast((100000 + l_partkey) * case when l_suppkey % 2 = 0 then 10 else 1 end as string)) as two")
    return verify.question_flags(d, pages, f, readings)


@query(
    with_views("pages")
    + """ select doc_id, page, unnest(list_filter([case when probe_conf < 0.3 then 'LOW_CONF' end, case when alnum < 10 then 'FEW_CHARS' end, case when kind = 'handwritten' then 'HANDWRITTEN' end], lambda x: x is not null)) as code from pages_v"""
)
def v19_question_flags(spark, sf_dir):
    return verify.flags(views.pages(spark, sf_dir), {"LOW_CONF": F.col("probe_conf") < 0.3, "FEW_CHARS": F.col("alnum") < 10, "HANDWRITTEN": F.col("kind") == "handwritten"})


@query(with_views("pages") + " select doc_id as file, bool_or(not (kind = 'blank' and not alnum > 10 and ink >= 0.05)) as keep from pages_v group by 1")
def v20_file_keep(spark, sf_dir):
    p = views.pages(spark, sf_dir).selectExpr("doc_id as file", "kind", "alnum > 10 as has_text", "ink as confidence")
    return verify.file_keep(verify.judge_labels(p, 0.05))


@query(with_views("pages") + " select doc_id, page, case when ink < 0.02 then 'skip' when kind = 'handwritten' or probe_conf < 0.5 then 'model' else 'print' end as route from pages_v")
def v21_page_route(spark, sf_dir):
    return views.pages(spark, sf_dir).select("doc_id", "page", verify.page_route(F.col("kind"), F.col("probe_conf"), F.col("ink")).alias("route"))


@query(r"select doc_id, greatest(1, ceil(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) / 350))::int as pages from documents")
def v22_page_estimate(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", verify.page_estimate(F.col("text")).alias("pages"))


@query(
    f"select doc_id, min(value) filter (where field_name = 'email') as email, min(value) filter (where field_name = 'ipv4') as ipv4 from (select doc_id, field_name, min(value) as value, count(*) as n from ({_SWEEP}) group by all) where field_name in ('email', 'ipv4') group by 1"
)
def x22_extraction_fields(spark, sf_dir):
    m = found_values(spark, sf_dir).where("field_name in ('email', 'ipv4')")
    return m.groupBy("doc_id").pivot("field_name", ["email", "ipv4"]).agg(F.min("value"))


_FIRST = ", ".join(f"nullif(regexp_extract(text, '{p}'), '') as {n}" for n, p in PLAIN)


@query(f"with w as (select doc_id, {_FIRST} from documents) select doc_id, email, phone_us, card, ipv4, secret from w where coalesce(email, phone_us, card, ipv4, secret) is not null")
def x22_extraction_wide(spark, sf_dir):
    first = [F.nullif(F.regexp_extract("text", p, 0), F.lit("")).alias(n) for n, p in PLAIN]
    return documents(spark, sf_dir).select("doc_id", *first).where(F.coalesce(*(F.col(n) for n, _ in PLAIN)).isNotNull())


@query("select conv_id as doc_id, string_agg(text, chr(10) order by turn) as text from conversations group by 1")
def x23_assemble_pages(spark, sf_dir):
    c = views.table(spark, sf_dir, "conversations").selectExpr("conv_id as doc_id", "turn as page", "text")
    return extract.assemble_pages(c)


@query(
    r"with l as (select doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g')) as line, doc_id % 7 / 7.0::double as c from documents) select doc_id, line, max(c) as confidence from l group by all"
)
def x24_line_confidence(spark, sf_dir):
    lines = documents(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line"), (F.col("doc_id") % 7 / 7).alias("confidence"))
    return extract.line_confidence(lines)


@query(
    "select o_orderkey, case when length(o_custkey::varchar) >= 4 then contains(o_orderkey::varchar || o_custkey::varchar, o_custkey::varchar) end as seen from orders"
)
def x19_digits_read(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").selectExpr("o_orderkey", "cast(o_custkey as string) as v", "concat('n ', o_orderkey, '-', o_custkey) as t")
    return o.select("o_orderkey", extract.digits_read(F.col("v"), F.col("t")).alias("seen"))


@query("with w as (select unnest(['license', 'version', 'the']) as word) select doc_id, word, len(regexp_extract_all(lower(text), '\\b' || word || '\\b'))::int as n from w, documents where regexp_matches(lower(text), '\\b' || word || '\\b')")
def x20_word_hits(spark, sf_dir):
    return extract.word_hits(documents(spark, sf_dir), ["license", "version", "the"])


_NAMES = ", ".join(f"case when regexp_matches(text, '{p}') then '{n}' end" for n, p in PLAIN)


@query(f"select doc_id, array_to_string(list_filter([{_NAMES}], lambda x: x is not null), ',') as names from documents")
def x21_pattern_names(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.array_join(extract.pattern_names(F.col("text"), SHAPES), ",").alias("names"))


@query(
    "with d as (select o_orderkey as doc_id, 100 + o_orderkey % 1400 as s from orders) select doc_id, case when s between 200 and 1200 then s end::int as score from d"
)
def x16_heading_score(spark, sf_dir):
    d = views.table(spark, sf_dir, "orders").selectExpr("o_orderkey as doc_id", "concat('Other 999. Credit score: ', 100 + o_orderkey % 1400, ' points') as text")
    return extract.score_after_heading(d, "credit score").drop("others")


@query(
    """with o as (select o_orderkey as doc_id, o_custkey from orders)
select doc_id, 'applicant' as subject, 1 as entry, 'name' as field_name, o_custkey::varchar as value from o
union all select doc_id, 'child', 1, 'name', 'a' || doc_id from o union all select doc_id, 'child', 2, 'name', 'b' || doc_id from o union all select doc_id, 'spouse', 1, 'name', 's' from o"""
)
def x17_flatten_extract(spark, sf_dir):
    r = views.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as doc_id",
        "map('name', cast(o_custkey as string)) as applicant",
        "array(named_struct('relationship', 'child', 'fields', map('name', concat('a', o_orderkey))), named_struct('relationship', 'spouse', 'fields', map('name', 's')), named_struct('relationship', 'child', 'fields', map('name', concat('b', o_orderkey)))) as others",
    )
    return extract.flatten_extract(r)


@query(
    """select o_orderkey, (o_orderkey % 99)::varchar as number, 'Main' as name, 'Street' as type, 'Town' as suburb, 'VIC' as state, (3000 + o_orderkey % 2000)::varchar as postcode, 3000 + o_orderkey % 2000 < 4000 as coherent from orders"""
)
def x14_address(spark, sf_dir):
    a = F.expr("concat(o_orderkey % 99, ' Main Street, Town VIC ', 3000 + o_orderkey % 2000)")
    return views.table(spark, sf_dir, "orders").select("o_orderkey", extract.address(a).alias("a")).select("o_orderkey", *(f"a.{c}" for c in ("number", "name", "type", "suburb", "state", "postcode", "coherent")))


TOKENS = r"t as (select doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) as token from documents)"


@query(f"with {TOKENS}, p as (select token, doc_id, count(*) as n from t group by all) select token, count(*) as documents, sum(n)::bigint as occurrences from p group by 1")
def i1_inverted_index(spark, sf_dir):
    return index.token_counts(index.postings(documents(spark, sf_dir), "doc_id", "text"))


@query(f"with {TOKENS} select doc_id from t where token in ('licensed', 'apache', 'version') group by 1 having count(distinct token) = 3")
def i2_term_and(spark, sf_dir):
    return index.find_all(index.postings(documents(spark, sf_dir), "doc_id", "text"), "doc_id", ["Licensed", "apache", "version"])


@query(
    f"with {TOKENS}, u as (select doc_id, 'text' as field, token from t union all select doc_id, 'source', unnest(list_filter(regexp_split_to_array(lower(source), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) from documents) "
    "select 'text' as asked, doc_id from u where token in ('licensed', 'apache', 'version') and field = 'text' group by 2 having count(distinct token) = 3 "
    "union all select 'any', doc_id from u where token in ('the', 'src6') group by 2 having count(distinct token) = 2"
)
def i1_written_index(spark, sf_dir):
    """An index of two columns as a table, and two lookups that read the folders of their terms alone."""
    path = shared(spark)
    index.write_index(views.table(spark, sf_dir, "documents"), "doc_id", ["text", "source"], path)
    one = index.find_in(spark, path, ["Licensed", "apache", "version"], ["text"]).select(F.lit("text").alias("asked"), F.col("key").alias("doc_id"))
    return one.unionByName(index.find_in(spark, path, ["the", "src6"]).select(F.lit("any").alias("asked"), F.col("key").alias("doc_id")))


@query("with p as (select l_partkey as document_id, l_suppkey as id, l_quantity as q, row_number() over (partition by l_partkey order by l_quantity desc, l_suppkey, l_orderkey) as n from lineitem) select document_id, id, q from p where n = 1")
def w14_best_portrait(spark, sf_dir):
    from loomwork.operators.windows import latest

    p = views.table(spark, sf_dir, "lineitem").selectExpr("l_partkey as document_id", "l_suppkey as id", "l_quantity as q", "l_orderkey as o")
    return latest(p, ["document_id"], [F.desc("q"), F.asc("id"), F.asc("o")]).select("document_id", "id", "q")
