"""Queries of the finer rules of merging, matching and reporting."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions import dates, keys
from loomwork.operators import aggregates, extract, joins, match, merges, verify, windows
from loomwork.operators.labels import catalogue_pack
from loomwork.plans import views
from loomwork.plans.registry import registry
from loomwork.plans.views import with_views
from loomwork.sources import readers

QUERIES, query = registry()
READS = "r as (select l_orderkey as doc_id, 'f' || (l_partkey % 4) as field_name, l_linenumber as pass, max(case when l_suppkey % 3 > 0 then 'v' || (l_suppkey % 4) else ' ' end) as value from lineitem group by all)"


def readings(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as doc_id", "concat('f', l_partkey % 4) as field_name", "l_linenumber as pass", "case when l_suppkey % 3 > 0 then concat('v', l_suppkey % 4) else ' ' end as value"
    )
    return rows.groupBy("doc_id", "field_name", "pass").agg(F.max("value").alias("value"))


@query(
    f"""with {READS}, h as (select *, value <> ' ' as filled, exists (select 1 from r b where b.doc_id = r.doc_id and b.field_name = r.field_name and b.pass < r.pass and b.value <> ' ') as had from r),
  p as (select pass, count(distinct doc_id) as documents, count(*) filter (where filled and not had) as delta, count(*) filter (where not filled and had) as regressions, count(*) filter (where filled and value <> 'v1') as valid from h group by 1)
select *, (select sum(delta) from p q where q.pass <= p.pass)::bigint as filled from p"""
)
def a12_pass_totals(spark, sf_dir):
    """Filled cells, gains, regressions and valid values by pass."""
    return aggregates.pass_metrics(readings(spark, sf_dir), F.col("value") != "v1")


@query(
    with_views("pages")
    + """, l as (select kind, alnum > 10 as has_text, ink as confidence, page % 7 / 4.0::double as secs from pages_v)
select kind, count(*) as n, count(*) filter (where has_text) as with_text, count(*) filter (where kind in ('photo', 'blank') and not has_text and confidence >= 0.05) as would_fail, round(avg(secs), 6) as mean_secs from l group by 1"""
)
def a16_would_fail(spark, sf_dir):
    p = views.pages(spark, sf_dir).selectExpr("kind", "alnum > 10 as has_text", "ink as confidence", "page % 7 / 4.0D as secs")
    return aggregates.label_report(verify.judge_labels(p, 0.05))


@query(
    """with w as (select unnest(['license', 'apache', 'token']) as word), f as (select doc_id, source as root, lower(coalesce(text, '')) || ' ' || case when doc_id % 5 = 0 then 'the token file' else '' end as t from documents),
  h as (select doc_id, root, word from f, w where regexp_matches(t, '\\b' || word || '\\b'))
select root, word, count(*) as files from h group by all union all select root, null, count(*) from (select root, doc_id from h group by all having count(*) >= 2) group by 1"""
)
def a20_word_roots(spark, sf_dir):
    """Words in texts and file names by root, and files with two of them."""
    d = views.table(spark, sf_dir, "documents").selectExpr("doc_id", "source as root", "text", "case when doc_id % 5 = 0 then 'the_token-file.txt' else 'x.txt' end as name")
    return aggregates.word_report(extract.word_hits(d, ["license", "apache", "token"], "name"), d.select("doc_id", "root"))


@query("select count(distinct user_id) as identities, count(distinct user_id) filter (where value > 5) as with_photo from events")
def a23_with_photo(spark, sf_dir):
    return aggregates.with_photo(views.table(spark, sf_dir, "events").selectExpr("user_id as identity_id", "value > 5 as verified"))


@query(
    """with l as (select o_custkey as source, count(*) as loaded from orders group by 1), m as (select c_custkey as source, c_nationkey % 20 as row_count from customer where c_custkey % 7 > 0),
  b as (select coalesce(m.source, l.source) as source, coalesce(row_count, 0)::bigint as row_count, coalesce(loaded, 0)::bigint as loaded from m full outer join l on m.source = l.source) select * from b where row_count <> loaded"""
)
def j20_count_check(spark, sf_dir):
    m = views.table(spark, sf_dir, "customer").where("c_custkey % 7 > 0").selectExpr("c_custkey as source", "c_nationkey % 20 as row_count")
    return joins.count_check(views.table(spark, sf_dir, "orders").selectExpr("o_custkey as source"), m, "source")


@query(
    """with s as (select user_id, max_by(event_type, event_id) as kind, max_by(value, event_id) as value from events group by 1) select c_custkey as id, kind, value from customer left join s on user_id = c_custkey"""
)
def src8_sidecar(spark, sf_dir):
    """Customers with the last row of a sidecar index, which is read with the query."""
    side = views.table(spark, sf_dir, "events").selectExpr("user_id as id", "event_id as seq", "event_type as kind", "value")
    return joins.with_sidecar(views.table(spark, sf_dir, "customer").selectExpr("c_custkey as id"), side, "id")


@query(
    """with e as (select o_custkey as person, case o_orderkey % 3 when 0 then 'licence' when 1 then 'passport' else 'other' end as kind, 'n' || (o_orderkey % 5) as canonical, o_orderkey % 4 as sources from orders)
select person, kind, canonical, sources, row_number() over (partition by person order by case kind when 'passport' then 0 when 'licence' then 1 else 2 end, sources desc, canonical)::int as place from (select distinct * from e)"""
)
def w7_evidence_rank(spark, sf_dir):
    e = views.table(spark, sf_dir, "orders").selectExpr("o_custkey as person", "case o_orderkey % 3 when 0 then 'licence' when 1 then 'passport' else 'other' end as kind", "concat('n', o_orderkey % 5) as canonical", "o_orderkey % 4 as sources").distinct()
    return windows.evidence_rank(e, "person")


LOG = """g as (select l_orderkey as doc_id, l_linenumber as pass, max(l_suppkey % 3)::bigint as delta, max(l_quantity)::bigint as alnum, case when l_orderkey % 3 = 0 then 400 else 10 end as native_chars, l_orderkey % 5 = 0 as printed, (l_orderkey % 2000)::bigint as chars from lineitem group by all),
  k as (select *, lag(delta) over w as before, sum(delta) over w as filled, round(sum(delta) over w * 100 / 10, 1) as recall from g window w as (partition by doc_id order by pass))"""


def log(spark, sf_dir):
    from pyspark.sql import Window

    g = views.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as doc_id", "l_linenumber as pass", "l_suppkey % 3 as delta", "cast(l_quantity as bigint) as alnum", "case when l_orderkey % 3 = 0 then 400 else 10 end as native_chars", "l_orderkey % 5 = 0 as printed", "l_orderkey % 2000 as chars"
    ).groupBy("doc_id", "pass", "native_chars", "printed", "chars").agg(F.max("delta").alias("delta"), F.max("alnum").alias("alnum"))
    w = Window.partitionBy("doc_id").orderBy("pass")
    return g.withColumns({"before": F.lag("delta").over(w), "filled": F.sum("delta").over(w)}).withColumn("recall", F.round(F.col("filled") * 100 / 10, 1))


@query(
    f"""with {LOG} select doc_id, min(case when (delta = 0 and before = 0 and pass >= 3) or (recall >= 95 and pass >= 4) or pass >= 4 or native_chars >= 300 or (printed and (filled >= 4 or chars >= 1500)) then pass end) as stop_pass,
  max(pass) as last_pass, bool_or(pass >= 2 and filled = 0 and alnum < 25) as fails from k group by 1"""
)
def m2_stop_rules(spark, sf_dir):
    """All rules of a document: gain, recall, early stop, native text, a full print reading, and failure."""
    return windows.stop_pass(log(spark, sf_dir), early=True)


@query(
    f"""with {LOG}, s as (select pass, sum(delta) as delta, sum(filled) as filled from k group by 1), b as (select *, lag(delta) over (order by pass) as before from s)
select min(case when (delta = 0 and before = 0 and pass >= 3) or pass >= 4 or filled >= 25 * (select count(distinct doc_id) from k) then pass end) as stop_pass from b"""
)
def m2_corpus_stop(spark, sf_dir):
    every = log(spark, sf_dir)
    return windows.corpus_stop(every, every.select("doc_id").distinct().count(), early=True)


@query(
    """with r as (select o_orderkey as doc_id, 'name' as field_name, case when o_orderkey % 4 > 0 then 'n' || (o_custkey % 3) end as value, 0.7::double as confidence from orders),
  m as (select o_orderkey as doc_id, 'name' as field_name, (['applicant', 'unknown', 'spouse', 'child'])[(o_orderkey % 4 + 1)::int] as subject, (o_custkey % 3)::int as entry, 'N' || (o_custkey % 4) as value, 0.8::double as confidence, o_custkey % 5 > 0 as digits_ok, 'seen ' || (o_custkey % 2) as note from orders),
  j as (select r.doc_id, r.field_name, r.value as v, r.confidence as vc, m.value as m, m.confidence as mc, digits_ok, subject, note from r left join m on m.doc_id = r.doc_id and subject in ('applicant', 'unknown'))
select doc_id, field_name, case when m is null then v when v is null then m when lower(v) = lower(m) or not digits_ok then v else m end as value,
  case when m is null then vc when v is null then mc when lower(v) = lower(m) then greatest(vc, mc) when not digits_ok then vc else least(0.6, mc) end::double as confidence,
  case when m is not null and (subject = 'unknown' or v is not null and lower(v) <> lower(m)) then 'warning' else 'ok' end as status, note from j
union all select doc_id, upper(subject[1]) || subject[2:] || case when entry > 1 then ' ' || entry else '' end || ': ' || field_name, value, confidence, 'warning', note from m where subject in ('spouse', 'child')"""
)
def m4_owners_and_notes(spark, sf_dir):
    """Numbered owners, unknown owners and verdict notes."""
    o = views.table(spark, sf_dir, "orders")
    r = o.selectExpr("o_orderkey as doc_id", "'name' as field_name", "case when o_orderkey % 4 > 0 then concat('n', o_custkey % 3) end as value", "0.7D as confidence")
    m = o.selectExpr(
        "o_orderkey as doc_id", "'name' as field_name", "element_at(array('applicant', 'unknown', 'spouse', 'child'), cast(o_orderkey % 4 as int) + 1) as subject", "cast(o_custkey % 3 as int) as entry", "concat('N', o_custkey % 4) as value", "0.8D as confidence", "o_custkey % 5 > 0 as digits_ok", "concat('seen ', o_custkey % 2) as note"
    )
    return merges.merge_readings(r, m)


UPSERTED = """a as (select l_orderkey as doc_id, (['inserted', 'updated', 'unchanged', 'preserved', 'kept'])[(l_partkey % 5 + 1)::int] as action from lineitem where l_linenumber < 3),
  d as (select o_orderkey as id, (['approved', 'failed', 'queued'])[(o_custkey % 3 + 1)::int] as status from orders),
  n as (select doc_id, count(*) filter (where action = 'inserted') as inserted, count(*) filter (where action = 'updated') as updated, count(*) filter (where action = 'unchanged') as unchanged, count(*) filter (where action = 'preserved') as preserved from a group by 1)"""


def upserted(spark, sf_dir):
    a = views.table(spark, sf_dir, "lineitem").where("l_linenumber < 3").selectExpr("l_orderkey as doc_id", "element_at(array('inserted', 'updated', 'unchanged', 'preserved', 'kept'), cast(l_partkey % 5 as int) + 1) as action")
    d = views.table(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "element_at(array('approved', 'failed', 'queued'), cast(o_custkey % 3 as int) + 1) as status")
    return merges.upsert_outcome(d, a, "2025-06-30")


@query(f"with {UPSERTED} select id, case when coalesce(inserted + updated + unchanged, 0) > 0 and status <> 'approved' then 'extracted' else status end as status from d left join n on doc_id = id")
def m6_status_promotion(spark, sf_dir):
    return upserted(spark, sf_dir)[0]


@query(f"with {UPSERTED} select doc_id, 'upsert' as action, inserted, updated, preserved, timestamp '2025-06-30' as at from n where inserted + updated > 0")
def m6_audit_rows(spark, sf_dir):
    return upserted(spark, sf_dir)[1]


CORPUS = """r as (select 'h' || (l_orderkey % 500) as content_hash, '/c/' || (l_orderkey % 500) || (['.pdf', '.bin'])[(l_orderkey % 2 + 1)::int] as path, 'f' || l_linenumber as field_name, 'v' || (l_partkey % 9) as value, case when l_returnflag = 'N' then 'junk' else 'ok' end as verif from lineitem),
  k as (select 'h' || c_custkey as content_hash, '/c/' || (c_custkey + 100) || '.pdf' as path from customer where c_custkey % 3 = 0),
  n as (select * from r where verif = 'ok' and content_hash not in (select content_hash from k) and path not in (select path from k))"""


def corpus(spark, sf_dir):
    r = views.table(spark, sf_dir, "lineitem").selectExpr(
        "concat('h', l_orderkey % 500) as content_hash", "concat('/c/', l_orderkey % 500, element_at(array('.pdf', '.bin'), cast(l_orderkey % 2 as int) + 1)) as path", "concat('f', l_linenumber) as field_name", "concat('v', l_partkey % 9) as value", "case when l_returnflag = 'N' then 'junk' else 'ok' end as verif"
    )
    k = views.table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").selectExpr("concat('h', c_custkey) as content_hash", "concat('/c/', c_custkey + 100, '.pdf') as path")
    return merges.load_corpus(r, k)


@query(f"with {CORPUS} select sha256('doc|' || content_hash)[1:16] as id, content_hash, min(path) as path, 'extracted' as status, case when min(path) like '%.bin' then 'format' end as warning from n group by content_hash")
def m9_documents(spark, sf_dir):
    return corpus(spark, sf_dir)[0]


@query(f"with {CORPUS} select distinct sha256('extraction|' || content_hash)[1:16] as id, sha256('doc|' || content_hash)[1:16] as document_id, 1 as version from n")
def m9_extractions(spark, sf_dir):
    return corpus(spark, sf_dir)[1]


@query(f"with {CORPUS} select sha256('field|' || content_hash || '|' || field_name)[1:16] as id, sha256('extraction|' || content_hash)[1:16] as extraction_id, field_name, min(value) as value from n group by content_hash, field_name")
def m9_fields(spark, sf_dir):
    return corpus(spark, sf_dir)[2]


@query(
    """with o as (select o_orderkey as doc_id, (o_custkey % 10000)::varchar as value, 0.2 + o_orderkey % 7 / 10.0::double as confidence, case when o_orderkey % 5 > 0 then (['corrected', 'confirmed', 'other'])[(o_orderkey % 3 + 1)::int] end as verdict, o_orderpriority as new_value,
    case when o_orderkey % 4 > 0 then o_orderkey % 5 > 0 else false end as box, 'page ' || o_custkey || ' ' || case when o_orderkey % 2 = 0 then o_orderpriority else '' end || ' ' || case when o_orderkey % 7 = 0 then upper(o_orderpriority) else '' end as text from orders),
  s as (select *, case when verdict = 'corrected' and box and contains(lower(text), lower(new_value)) then 'corrected' when verdict = 'confirmed' and (length(value) < 4 or contains(regexp_replace(text, '[^0-9]', '', 'g'), value)) then 'confirmed' else 'unresolved' end as state from o)
select doc_id, state, case when state = 'corrected' then new_value else value end as value, round(case when state = 'unresolved' then least(confidence, 0.4) else confidence end, 6) as confidence from s"""
)
def m13_cited_boxes(spark, sf_dir):
    """A correction without a cited box or without its value in a reading is unresolved, and unresolved values are downgraded."""
    o = views.table(spark, sf_dir, "orders")
    f = o.selectExpr("o_orderkey as doc_id", "'bsb' as field_name", "cast(o_custkey % 10000 as string) as value", "0.2D + o_orderkey % 7 / 10D as confidence")
    v = o.where("o_orderkey % 5 > 0").selectExpr("o_orderkey as doc_id", "'bsb' as field_name", "element_at(array('corrected', 'confirmed', 'other'), cast(o_orderkey % 3 as int) + 1) as verdict", "o_orderpriority as new_value", "case when o_orderkey % 4 > 0 then array(1, 2) end as box")
    p = o.selectExpr("o_orderkey as doc_id", "concat('page ', o_custkey, ' ', case when o_orderkey % 2 = 0 then o_orderpriority else '' end) as text")
    r = o.where("o_orderkey % 7 = 0").selectExpr("o_orderkey as doc_id", "upper(o_orderpriority) as text")
    return merges.settle_verdicts(f, v, p, r).select("doc_id", "state", "value", F.round("confidence", 6).alias("confidence"))


#: Labels as forms print them, written for this query, and the field of each; no label is another field's.
PRINTED = [
    tuple(x.split(" > "))
    for x in """
Salutation > title_salutation; First-Name > given_names; Middle Initials > middle_name; SURNAME > family_name; Birth date > date_of_birth; Citizenship status > residency_status; marital_status > marital_status;
No. of Dependents > dependants_count; Home Address > residential_address; Time at address > address_tenure; Past address > previous_address; HousingSituation > housing_situation; Mobile > mobile_number; E-mail > email_address;
Drivers License No > drivers_licence; Travel document > passport_details; Employment status > employment_status; Job title > occupation_industry; Company Name > employer_details; Time in job > employment_tenure;
Annual income > gross_annual_income; Take home pay > net_monthly_income; Variable income > additional_income; Monthly living expenses > monthly_living_expenses; Net worth > asset_holdings; Home loans > liability_mortgages;
Credit card limits > liability_credit_cards; Car loans > liability_other_loans; Requested credit > credit_limit_requested; Balance transfer amount > balance_transfer; Known as > preferred_name; Maiden name > previous_name; Sex > gender;
Country of birth > country_of_birth; Visa subclass > visa_subclass; Visa expires > visa_expiry; Licence State > licence_state; Licence Expiry > licence_expiry; Joint applicant > joint_applicant; Applicant role > applicant_role;
Mailing address > postal_address; Apartment number > unit_level; Street number > street_number; Street name and type > street_name_type; Suburb > suburb_locality; Territory code > state_territory; Previous address tenure > previous_address_tenure;
Address verification document > address_verification_doc; Landline > home_phone; Work telephone > work_phone; Preferred contact method > preferred_contact_method; Contact time > contact_time; Next of kin name > emergency_contact_name;
Emergency phone > emergency_phone; Interpreter > language_interpreter; Workplace Address > employer_address; Switchboard > employer_phone; HR contact person > payroll_contact; Commencement date > employment_start_date;
Previous employer > previous_employer; Previous employment tenure > previous_employment_tenure; Entity type > business_structure; ANZSIC code > anzsic_code; Pay frequency > income_frequency; Gross monthly income > gross_monthly_income;
Novated lease > salary_sacrifice; Overtime earnings > overtime_income; Commission income > bonus_commission; Rental income > rental_income; Dividend income > investment_income; Government benefit > government_benefit;
Income verification document > income_verification_doc; Board payment > rent_board_payment; Telecommunications > utilities_expense; Insurance premiums > insurance_expense; Fuel expense > transport_fuel_expense; Education expenses > childcare_education_expense;
Child support > child_support_paid; HEM benchmark living expenses > hem_benchmark_expense; Offset account balances > savings_balance; Super fund balance > superannuation_balance; Motor vehicle market value > vehicle_value;
Investment property value > investment_property_value; Buy now pay later > bnpl_commitments; HELP student loan debt > hecs_help_debt; Product type requested > product_type_requested; Loan amount requested > loan_amount_requested; Loan purpose > loan_purpose;
Repayment frequency > repayment_frequency; Direct debit > direct_debit_account; Credit_score > credit_score; A.B.N. > abn; Australian Business No > abn; Bank State Branch > bsb; Post code > postcode; Account no > account_number;
Australian Company Number > acn; TFN > tfn; Medicare no > medicare_number; BPAY biller code > bpay_biller_code; Card number > card_number_masked; Favourite colour > none
""".replace("\n", " ").strip().split("; ")
]
_LABELS, _FIELDS = (", ".join(f"'{r[k]}'" for r in PRINTED) for k in (0, 1))


@query(
    f"""with c as (select c_custkey as doc_id, (c_custkey % {len(PRINTED)})::int + 1 as k, c_name from customer),
  l as (select doc_id, 1 as line_no, ([{_FIELDS}])[k] as field_name, c_name as value from c union all select doc_id, 2, ([{_FIELDS}])[(k + 7 - 1) % {len(PRINTED)} + 1], null from c)
select * from l where field_name <> 'none'"""
)
def x8_label_pack(spark, sf_dir):
    """All fields of the catalogue by printed labels: each form has one with a value and one without."""
    c = views.table(spark, sf_dir, "customer").selectExpr("c_custkey as doc_id", f"cast(c_custkey % {len(PRINTED)} as int) as k", "c_name")
    label = F.array(*(F.lit(r[0]) for r in PRINTED))
    lines = c.select(
        "doc_id",
        F.posexplode(F.array(F.lit("Application form"), F.concat(label[F.col("k")], F.element_at(F.array(F.lit(": "), F.lit(" = "), F.lit("\t")), (F.col("doc_id") % 3 + 1).cast("int")), "c_name"), label[(F.col("k") + 7) % len(PRINTED)])).alias("line_no", "line"),
    )
    return match.catalogue_candidates(lines, catalogue_pack(spark)).where("line_no > 0 and (line_no = 1 or value is null)")


ADDRESSES = """l as (select o_orderkey as doc_id, unnest([1, 2, 3]) as line_no, o_custkey as c, o_orderkey % 4 as k from orders),
  c as (select doc_id, line_no, case line_no when 1 then 'residential_address' when 2 then case when k = 0 then 'gross_annual_income' else 'residential_address' end else 'residential_address' end as field_name,
    case line_no when 1 then c || ' Old Road, Formertown' when 2 then case when k = 0 then '$' || c else c || ' New St' end else c || ' Some Lane' end as value,
    case line_no when 1 then 'Previous home address: ' when 2 then case when k = 0 then 'Net income of spouse: ' else 'Current address: ' end else 'Address of employer: ' end as label from l)"""


@query(
    f"""with {ADDRESSES}, s as (select *, least(length(value), 200) + case when field_name = 'gross_annual_income' then -2000 when line_no = 1 then 1000 - 2000 when line_no = 2 then 1000 else -2000 end as score from c),
  r as (select *, row_number() over (partition by doc_id, field_name order by score desc, line_no, value) as n from s), d as (select doc_id, field_name, count(distinct value) as vs from c group by all)
select doc_id, field_name, value, case when vs = 1 then 'matched' else 'ambiguous' end as status from r join d using (doc_id, field_name) where n = 1"""
)
def x9_disambiguation(spark, sf_dir):
    """Current against previous and an employer's addresses; net against gross income."""
    rows = views.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as doc_id",
        "explode(array(named_struct('line_no', 1, 'field_name', 'residential_address', 'value', concat(o_custkey, ' Old Road, Formertown'), 'label', 'Previous home address: '),"
        " case when o_orderkey % 4 = 0 then named_struct('line_no', 2, 'field_name', 'gross_annual_income', 'value', concat('$', o_custkey), 'label', 'Net income of spouse: ') else named_struct('line_no', 2, 'field_name', 'residential_address', 'value', concat(o_custkey, ' New St'), 'label', 'Current address: ') end,"
        " named_struct('line_no', 3, 'field_name', 'residential_address', 'value', concat(o_custkey, ' Some Lane'), 'label', 'Address of employer: '))) as c",
    ).select("doc_id", "c.*")
    return match.choose(rows, match.disambiguated(F.col("field_name"), F.col("label"), F.col("value")))


@query(
    """with o as (select o_orderkey as doc_id, o_custkey as c, o_orderkey % 3 as k from orders),
  l as (select doc_id, c, k, unnest([1, 2, 3]) as line_no from o),
  v as (select doc_id, line_no, case k when 0 then 'given_names' when 1 then 'loan_amount_requested' else 'employer_details' end as field_name,
    case k when 0 then (['Ann ' || c, 'Acme Holdings of the North ' || c, 'Bo'])[line_no] when 1 then (['$' || c || '000,000,000', '$' || c, '$1'])[line_no] else (['Old Firm ' || c, 'New Firm Pty Ltd', 'Longest name of any firm ' || c])[line_no] end as value,
    -- what the words of the line say: for 1000, against -2000
    case k when 0 then ([0, -2000, 0])[line_no] when 1 then ([-2000, 1000, 0])[line_no] else ([-2000, 1000, -2000])[line_no] end as words from l),
  r as (select *, row_number() over (partition by doc_id order by least(length(value), 200) + words desc, line_no) as n from v)
select doc_id, field_name, value, 'ambiguous' as status from r where n = 1"""
)
def x9_other_rules(spark, sf_dir):
    """A person's name against a company's, an amount that is asked for against one that is owed, this employer against a former one."""
    rows = (
        ("given_names", ("First name: ", "concat('Ann ', c)"), ("Name of business: ", "concat('Acme Holdings of the North ', c)"), ("Known as: ", "'Bo'")),
        ("loan_amount_requested", ("Still owing on the loan: ", "concat('$', c, '000,000,000')"), ("Amount requested: ", "concat('$', c)"), ("Fee: ", "'$1'")),
        ("employer_details", ("Previous employer: ", "concat('Old Firm ', c)"), ("Current employer: ", "'New Firm Pty Ltd'"), ("Employer of the spouse: ", "concat('Longest name of any firm ', c)")),
    )
    each = ", ".join(f"array({', '.join(f"named_struct('line_no', {n}, 'field_name', '{field}', 'value', {value}, 'label', '{label}')" for n, (label, value) in enumerate(lines, 1))})" for field, *lines in rows)
    found = views.table(spark, sf_dir, "orders").selectExpr("o_orderkey as doc_id", "o_custkey as c", "cast(o_orderkey % 3 as int) + 1 as k").selectExpr("doc_id", f"explode(element_at(array({each}), k)) as r").select("doc_id", "r.*")
    return match.choose(found, match.disambiguated(F.col("field_name"), F.col("label"), F.col("value")))


@query(
    "select o_orderkey, '0' || lpad((o_custkey % 1000)::varchar, 3, '0') || ' 123 456' as phone, '1/2/' || (1950 + o_orderkey % 50) as date, '$' || o_custkey || '.50' as amount, 'Ann ' || o_custkey as name from orders"
)
def x12_inline_labels(spark, sf_dir):
    """A next label on the line, trailing punctuation, and the shapes of phones, dates and amounts."""
    o = views.table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey",
        extract.clean_value(F.lit("phone"), F.expr("concat('ph 0', lpad(o_custkey % 1000, 3, '0'), ' 123 456 (home)')")).alias("phone"),
        extract.clean_value(F.lit("date"), F.expr("concat('on 1/2/', 1950 + o_orderkey % 50, ';')")).alias("date"),
        extract.clean_value(F.lit("currency"), F.expr("concat('about $', o_custkey, '.50 a year')")).alias("amount"),
        extract.clean_value(F.lit("text"), F.expr("concat('Ann ', o_custkey, '   Date of Birth: 1/2/1950')")).alias("name"),
    )


@query("select o_orderkey, (0.9 + case when length(o_orderkey::varchar) >= 8 then 0.05 else 0 end + case o_orderkey % 3 when 0 then 0.03 when 1 then -0.03 else 0 end)::double as score from orders")
def x13_snippets(spark, sf_dir):
    snippet = F.repeat(F.lit("x"), F.element_at(F.array(F.lit(45), F.lit(24), F.lit(30)), F.expr("cast(o_orderkey % 3 as int) + 1")))
    return views.table(spark, sf_dir, "orders").select("o_orderkey", match.confidence(F.lit("identifier"), F.col("o_orderkey").cast("string"), snippet).cast("double").alias("score"))


@query(
    """with f as (select o_orderkey as doc_id, 2000 + o_custkey % 6000 as p, (['VIC', 'qld', 'SA'])[(o_orderkey % 3 + 1)::int] as state from orders),
  s as (select *, case when p between 3000 and 3999 then 'VIC' when p between 4000 and 4999 then 'QLD' when p between 5000 and 5999 then 'SA' when p between 6000 and 6999 then 'WA' when p between 7000 and 7999 then 'TAS' when p between 2600 and 2618 or p between 2900 and 2920 then 'ACT' else 'NSW' end as own from f)
select doc_id, 'postcode' as field_name, own = upper(state) as valid, case when own = upper(state) then 'ok' else 'postcode_state_mismatch' end as code, case when own = upper(state) then 0.73 else 0.45 end::double as confidence from s
union all select doc_id, 'bsb', true, 'ok', 0.7 from f union all select doc_id, 'state', null, 'no_rule', 0.7 from f"""
)
def x15_state_checked(spark, sf_dir):
    """Every field of a document checked anew with the document's state."""
    o = views.table(spark, sf_dir, "orders")
    rows = [("postcode", "cast(2000 + o_custkey % 6000 as string)"), ("state", "element_at(array('VIC', 'qld', 'SA'), cast(o_orderkey % 3 as int) + 1)"), ("bsb", "'062-000'")]
    every = o.select("o_orderkey", F.explode(F.array(*(F.struct(F.lit(n).alias("field_name"), F.expr(v).alias("value")) for n, v in rows))).alias("f")).selectExpr("o_orderkey as doc_id", "f.*", "0.7D as confidence")
    return match.state_checked(every, "2025-06-30").select("doc_id", "field_name", "valid", "code", "confidence")


@query(
    """with d as (select o_orderkey as doc_id, (300 + o_orderkey % 1200)::int as s, (250 + o_custkey % 900)::int as b, o_orderkey % 3 as k from orders)
select doc_id, case when k > 0 and s between 200 and 1200 then s end as score, case when k < 2 and b between 200 and 1200 then 'business score=' || b else '' end as others from d"""
)
def x16_sibling_scores(spark, sf_dir):
    """A sibling's score after the heading is refused and listed."""
    d = views.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as doc_id",
        "case o_orderkey % 3 when 0 then concat('Credit score / business score: ', 250 + o_custkey % 900) when 1 then concat('Credit score: ', 300 + o_orderkey % 1200, '. Business score: ', 250 + o_custkey % 900) else concat('Credit score: ', 300 + o_orderkey % 1200) end as text",
    )
    out = extract.score_after_heading(d, "credit score", siblings=["business score"])
    return out.select("doc_id", "score", F.array_join(F.transform("others", lambda x: F.concat(x["heading"], F.lit("="), x["score"].cast("string"))), ",").alias("others"))


@query(
    """with o as (select o_orderkey as doc_id, o_custkey as c from orders)
select doc_id, 'applicant' as subject, 1 as entry, 'id' as field_name, c || '-' || doc_id as value, 'line 1' as evidence, 1 as page, case when length(c || '' || doc_id) >= 4 then doc_id % 2 = 0 end as digits_read,
  case when length(c || '' || doc_id) < 4 then 0.7 when doc_id % 2 = 0 then 0.85 else 0.35 end::double as confidence from o
union all select doc_id, 'child', 1, 'id', 'kid', 'line 2', 2, null, 0.7 from o"""
)
def x17_evidence_and_digits(spark, sf_dir):
    """Evidence, page and digit check of nested results."""
    o = views.table(spark, sf_dir, "orders")
    r = o.selectExpr(
        "o_orderkey as doc_id", "map('id', named_struct('value', concat(o_custkey, '-', o_orderkey), 'evidence', 'line 1', 'page', 1)) as applicant", "array(named_struct('relationship', 'child', 'fields', map('id', named_struct('value', 'kid', 'evidence', 'line 2', 'page', 2)))) as others"
    )
    p = o.selectExpr("o_orderkey as doc_id", "1 as page", "concat('No. ', o_custkey, ' / ', case when o_orderkey % 2 = 0 then cast(o_orderkey as string) else 'x' end) as text")
    return extract.checked_extract(extract.flatten_extract(r), p).select("doc_id", "subject", "entry", "field_name", "value", "evidence", "page", "digits_read", "confidence")


@query(
    """select event_id as doc_id, 'k' as field_name, event_type as value, (greatest(0.0, least(1.0, coalesce(value / 20, 0.5))))::double as confidence, 'other' as subject, repeat('e', least(200, (event_id % 300)::int)) as evidence,
  case event_type when 'click' then 'handwriting' else 'print' end as source, case when event_id % 3 = 0 then 'both' else 'regex' end as origin from events"""
)
def x18_enums(spark, sf_dir):
    r = views.table(spark, sf_dir, "events").selectExpr(
        "event_id as doc_id", "' k ' as field_name", "event_type as value", "value / 20 as confidence", "'who' as subject", "repeat('e', cast(event_id % 300 as int)) as evidence", "case event_type when 'click' then 'handwriting' else 'scanner' end as source", "case when event_id % 3 = 0 then 'both' when event_id % 3 = 1 then 'guess' end as origin"
    )
    return match.sanitised(r)


@query(
    r"""with l as (select doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g')) as line from documents), r as (select doc_id, line, 0.5::double as confidence from l where doc_id % 2 = 0 group by all),
  n as (select distinct doc_id, line from l where line <> '' and doc_id % 3 = 0) select * from r union all select doc_id, line, 0.95 from n where not exists (select 1 from r where r.doc_id = n.doc_id and r.line = n.line)"""
)
def x24_native_lines(spark, sf_dir):
    """Readings united with the lines of native text."""
    lines = views.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\\n")).alias("line"))
    return extract.line_confidence(lines.where("doc_id % 2 = 0").withColumn("confidence", F.lit(0.5)), lines.where("doc_id % 3 = 0"))


@query(
    """with v as (select o_orderkey, 'N' || lpad((o_orderkey % 1000)::varchar, (5 + o_orderkey % 4)::int, '0') as c, o_custkey % 3 as s from orders)
select o_orderkey, case when length(c) = 6 then 'not the form of a passport' when s >= 2 then 'the same in ' || s || ' documents' else 'in one document only' end as why from v"""
)
def v10_explanation(spark, sf_dir):
    c = F.expr("concat('N', lpad(o_orderkey % 1000, cast(5 + o_orderkey % 4 as int), '0'))")
    return views.table(spark, sf_dir, "orders").select("o_orderkey", keys.explanation(F.lit("passport"), c, F.col("o_custkey") % 3).alias("why"))


@query(
    """with v as (select o_orderkey, o_orderkey % 31 + 1 as d, o_custkey % 14 + 1 as m, 1940 + o_orderkey % 80 as y, o_orderkey % 6 as k from orders),
  r as (select *, try_cast(y || '-' || lpad(m::varchar, 2, '0') || '-' || lpad(d::varchar, 2, '0') as date) as dmy, try_cast(y || '-' || lpad(d::varchar, 2, '0') || '-' || lpad(m::varchar, 2, '0') as date) as mdy from v)
select o_orderkey, case when k = 5 then false when k = 2 and m > 12 then false when k = 4 then dmy is not null when k = 0 and d <= 12 then dmy is not null or mdy is not null else dmy is not null end as reliable,
  case when k = 5 then regexp_replace('soon ' || d, '[^0-9]', '', 'g') when k = 0 and d <= 12 or dmy is null or (k = 2 and m > 12) then case k when 0 then lpad(d::varchar, 2, '0') || lpad(m::varchar, 2, '0') || y when 1 then y || lpad(m::varchar, 2, '0') || lpad(d::varchar, 2, '0') when 4 then y || m || d else d || '' || y end
    else strftime(dmy, '%Y%m%d') end as key from r"""
)
def v12_dates(spark, sf_dir):
    """Forms of dates, real and not, with their key and whether they are one date."""
    names = "array('Jan', 'February', 'Mar', 'Apr', 'May', 'June', 'July', 'Aug', 'Sept', 'October', 'Nov', 'Dec', 'Foo', 'Bar')"
    raw = F.expr(
        f"case o_orderkey % 6 when 0 then concat(lpad(o_orderkey % 31 + 1, 2, '0'), ' / ', lpad(o_custkey % 14 + 1, 2, '0'), '-', 1940 + o_orderkey % 80)"
        " when 1 then concat(1940 + o_orderkey % 80, '.', lpad(o_custkey % 14 + 1, 2, '0'), '.', lpad(o_orderkey % 31 + 1, 2, '0'))"
        f" when 2 then concat(o_orderkey % 31 + 1, 'th ', element_at({names}, cast(o_custkey % 14 as int) + 1), ' ', 1940 + o_orderkey % 80)"
        f" when 3 then concat(o_orderkey % 31 + 1, element_at({names}, cast(o_custkey % 14 as int) + 1), 1940 + o_orderkey % 80)"
        " when 4 then concat(1940 + o_orderkey % 80, '-', o_custkey % 14 + 1, '-', o_orderkey % 31 + 1) else concat('soon ', o_orderkey % 31 + 1) end"
    )
    return views.table(spark, sf_dir, "orders").select("o_orderkey", dates.dob_reliable(raw).alias("reliable"), dates.dob_key(raw).alias("key"))


RENAMED = """f as (select distinct '/in/d' || (c_custkey % 5) || '/f' || (c_custkey % 7) || (['', '~1', '~2', '~07'])[(c_custkey % 4 + 1)::int] || (['.pdf', '.PNG', '.txt', '', '.jpeg', '.jpg'])[(c_custkey % 6 + 1)::int] as path, c_custkey % 7 as k from customer),
  p as (select path, (['png', 'pdf', 'jpg', null])[(k % 4 + 1)::int] as kind, lower(regexp_extract(path, '(\\.[^.]+)$', 1))[2:] as old, regexp_extract(path, '^([^.~]*(~07)?)', 1) as stem, coalesce(try_cast(regexp_extract(path, '~([1-9])', 1) as int), 0) as number from f),
  r as (select *, lower(stem || '.' || old) as there, lower(stem || '.' || kind) as grp, kind is not null and old <> kind and not (kind = 'jpg' and old = 'jpeg') as moves from p),
  a as (select m.*, row_number() over (partition by grp, number order by path) = 1 and not exists (select 1 from r x where x.there = m.grp and x.number = m.number) as gets from r m where moves),
  u as (select grp, list(distinct number) as used from (select there as grp, number from r union all select grp, number from a where gets) group by 1),
  t as (select a.path, a.stem, a.kind, a.old, case when gets then number else (list_filter(range(0, (n + len(coalesce(used, [])))::bigint), lambda x: not list_contains(coalesce(used, []), x)))[n] end as number
    from (select *, row_number() over (partition by grp, gets order by path) as n from a) a left join u using (grp)),
  o as (select path as "from", stem || case when number > 0 then '~' || number else '' end || '.' || kind as "to", '.' || case when old = '' then '(none)' else old end || ' -> .' || kind as reason from t)"""


@query(f'with {RENAMED} select "from", "to", reason from o')
def v16_rename_plan(spark, sf_dir):
    """Files whose bytes ask for another extension, with names that are free in the whole listing."""
    return verify.rename_plan(renamed_files(spark, sf_dir))


def renamed_files(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer").selectExpr(
        "concat('/in/d', c_custkey % 5, '/f', c_custkey % 7, element_at(array('', '~1', '~2', '~07'), cast(c_custkey % 4 as int) + 1), element_at(array('.pdf', '.PNG', '.txt', '', '.jpeg', '.jpg'), cast(c_custkey % 6 as int) + 1)) as path",
        "element_at(array(X'89504E470D0A', X'255044462D31', X'FFD8FFE0', cast('text' as binary)), cast(c_custkey % 7 % 4 as int) + 1) as head",
    )
    return c.distinct()


@query(f'with {RENAMED} select "to" as "from", "from" as "to" from o')
def v24_undone_renames(spark, sf_dir):
    """The plan's inverse, over the listing that it leaves: every old name comes back."""
    files = renamed_files(spark, sf_dir)
    plan = verify.rename_plan(files).select(F.col("from").alias("path"), F.col("to").alias("target"))
    after = files.select("path").join(plan.select("path"), "path", "left_anti").union(plan.select("target"))
    return verify.restore_plan(plan, after)


@query(
    """select event_id, case event_id % 8 when 0 then 'pdf' when 1 then 'image' when 2 then 'text' when 3 then 'program' when 4 then 'text' when 5 then case when event_id % 3 = 0 then 'text' else 'binary' end when 6 then 'binary' else 'empty' end as kind from events"""
)
def v15_byte_rules(spark, sf_dir):
    """Magic bytes, UTF-8 and UTF-16 text, text that is mostly not Latin, control bytes, and none."""
    head = F.expr(
        "case event_id % 8 when 0 then X'255044462D312E37' when 1 then X'FFD8FFE0' when 2 then cast(concat('plain é ', event_id) as binary) when 3 then X'4D5A9000'"
        " when 4 then X'FFFE680065006C006C006F00' when 5 then cast(case when event_id % 3 = 0 then 'mostly latin letters и' else 'текст по-русски' end as binary)"
        " when 6 then X'0001020304056162' else X'' end"
    )
    return views.table(spark, sf_dir, "events").select("event_id", verify.sniff(head).alias("kind"))


@query(
    with_views("pages")
    + """, j as (select doc_id, page, kind = 'blank' and not alnum > 10 and ink >= 0.05 as fails, probe_conf < 0.2 as again from pages_v) select doc_id as file, bool_or(not (fails and again)) as keep from j group by 1"""
)
def v20_second_look(spark, sf_dir):
    """A page fails only if a second look says so too."""
    p = views.pages(spark, sf_dir).selectExpr("doc_id as file", "page", "kind", "alnum > 10 as has_text", "ink as confidence", "probe_conf")
    return verify.file_keep(verify.confirmed(verify.judge_labels(p, 0.05), p.select("file", "page", (F.col("probe_conf") < 0.2).alias("fails")), ["file", "page"]))


@query("select event_id, event_type as document_type, 'a' || (event_id % 3) || ',b' as review_keys, case when event_id % 2 = 0 then 3 end as pages from events where event_id % 5 > 0 union all select event_id, null, '', null from events where event_id % 5 = 0")
def f19_types_and_keys(spark, sf_dir):
    meta = "case when event_id % 5 = 0 then '{broken' else concat('{\"documentType\": \"', event_type, '\", \"review\": {\"keys\": [\"a', event_id % 3, '\", \"b\"]}', case when event_id % 2 = 0 then ', \"pages\": 3' else '' end, '}') end as meta"
    rows = readers.with_metadata(views.table(spark, sf_dir, "events").selectExpr("event_id", meta), "meta", review=True)
    return rows.select("event_id", "document_type", F.coalesce(F.array_join("review_keys", ","), F.lit("")).alias("review_keys"), "pages")
