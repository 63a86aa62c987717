"""All registered queries of the trade engine, each with the SQL that checks it.

A query takes (spark, sf_dir) and applies one operator to whole tables.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import bags as B
from ..operators import coverage as C
from ..operators import filters as P
from ..operators import finder as X
from ..operators import parts as M
from ..operators import structure as K
from ..operators import traffic as T
from ..operators import windows as D
from ..sources import trade as R
from ..streaming import rate
from . import search

QUERIES = {}
ORACLES = {}


def add(name: str, query, sql: str | None = None, *tables: str) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = R.oracle(sql, *tables)


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


ROUND = "floor(100.0 * n / total + 0.5)"
TEXT = lambda *c: "coalesce(" + ", ".join(f"nullif(trim({x}), '')" for x in c) + ")"
MPN = lambda c: f"nullif(case when regexp_matches(upper(regexp_replace({c}, '\\s+', '', 'g')), '^\\d{{1,3}}([,.]\\d{{3}})+$') then regexp_replace(upper(regexp_replace({c}, '\\s+', '', 'g')), '[,.]', '', 'g') else upper(regexp_replace({c}, '\\s+', '', 'g')) end, '')"
PART = MPN(TEXT("mpn", "mpn_quoted"))
CUSTOMER, SUPPLIER, MAKER = TEXT("customer", "client"), TEXT("supplier_name", "supplier"), TEXT("manufacturer", "clean_mfg")

# ---- cleaning and parsing

FOLD = f"translate(x, '{S.ACCENTED}', '{S.PLAIN}')"
add(
    "i_normalize_header",
    lambda s, d: table(s, d, "part").select("p_partkey", F.concat(F.lit("  Ñº_"), "p_name", F.lit("-É "), "p_brand", F.lit(" (Qty)")).alias("x")).select("p_partkey", S.normalize_header(F.col("x")).alias("header"), S.snake_case(F.col("x")).alias("snake")),
    f"""with t as (select p_partkey, concat('  Ñº_', p_name, '-É ', p_brand, ' (Qty)') as x from part),
    h as (select p_partkey, lower(trim(regexp_replace(regexp_replace(regexp_replace({FOLD}, '[_-]+', ' ', 'g'), '[^A-Za-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))) as header from t)
    select p_partkey, header, replace(header, ' ', '_') as snake from h""",
)
RAW_NUMBER = "case l_linenumber % 6 when 0 then concat('$', cast(cast(floor(l_extendedprice) as bigint) as string)) when 1 then concat(cast(cast(l_quantity as bigint) as string), ' %') when 2 then concat('1,', lpad(cast(cast(l_quantity as bigint) as string), 3, '0')) when 3 then 'n/a' when 4 then concat('-', cast(cast(floor(l_quantity) as bigint) as string)) else '1e3' end"
add(
    "i_parse_number",
    lambda s, d: R.frame(s, d, f"select l_orderkey, l_linenumber, l_partkey, {RAW_NUMBER} as raw from lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.parse_number(F.col("raw")).alias("number"), S.sanitize_scalar(F.col("raw")).alias("stored")),
    f"""with t as (select l_orderkey, l_linenumber, l_partkey, {RAW_NUMBER} as raw from lineitem), b as (select *, try_cast(regexp_replace(raw, '[%,$\\s]', '', 'g') as double) as v from t)
    select l_orderkey, l_linenumber, l_partkey, case when raw like '%\\%%' escape '\\' and v > 1 then v / 100 else v end as number, case when regexp_matches(trim(raw), '^[=+\\-@]') then concat('''', trim(raw)) else trim(raw) end as stored from b""",
)
add(
    "i_gp_rate",
    lambda s, d: table(s, d, "customer").select("c_custkey", S.gp_rate(F.col("c_acctbal") / 50).alias("rate"), S.gp_rate_warns(F.col("c_acctbal") / 50).alias("warns")),
    "select c_custkey, case when abs(c_acctbal / 50) <= 1 then c_acctbal / 50 when abs(c_acctbal / 50) <= 100 then c_acctbal / 50 / 100 end as rate, abs(c_acctbal / 50) > 100 as warns from customer",
)
RAW_DATE = "case o_orderkey % 4 when 0 then concat('200', cast(o_orderkey % 10 as string), '-03-', lpad(cast(o_orderkey % 28 + 1 as string), 2, '0')) when 1 then concat(lpad(cast(o_orderkey % 28 + 1 as string), 2, '0'), '/11/2012') when 2 then cast(40000 + o_orderkey % 5000 as string) else 'soon' end"
add(
    "i_parse_date",
    lambda s, d: R.frame(s, d, f"select o_orderkey, {RAW_DATE} as raw from orders").select("o_orderkey", S.parse_date(F.col("raw")).cast("string").alias("day")),
    f"""with t as (select o_orderkey, {RAW_DATE} as raw from orders)
    select o_orderkey, cast(case when regexp_matches(raw, '^\\d{{5}}$') then date '1970-01-01' + cast(cast(raw as int) - 25569 as int) else coalesce(cast(try_strptime(raw, '%Y-%m-%d') as date), cast(try_strptime(raw, '%d/%m/%Y') as date)) end as varchar) as day from t""",
)
add(
    "i_redact_text",
    lambda s, d: table(s, d, "customer").select("c_custkey", S.redact_diagnostic(F.concat(F.lit("row of "), "c_name", F.lit(" <a"), "c_custkey", F.lit("@mail.com> owes $1,250.50, call +1 (918) 555-0001"))).alias("safe"), S.mask_email(F.concat(F.lit("a"), "c_custkey", F.lit("@mail.com"))).alias("masked")),
    "select c_custkey, concat('row of ', regexp_replace(regexp_replace(c_name, '\\+?\\d[\\d ()-]{7,}\\d', '[phone]', 'g'), '\\d{8,}', '[number]', 'g'), ' <[email]> owes [amount], call [phone]') as safe, concat('a', substr(cast(c_custkey as varchar), 1, 1), '***@mail.com') as masked from customer",
)
add(
    "i_issue_rollup",
    lambda s, d: A.issue_rollup(A.issues(R.records(s, d))),
    f"""with i as (
      select row_index, id, 'missing_mpn' as type, 'high' as severity from records where {TEXT("mpn", "mpn_quoted")} is null union all
      select row_index, id, 'missing_quantity', 'medium' from records where qty is null and req_qty is null union all
      select row_index, id, 'missing_price', 'medium' from records where price is null union all
      select row_index, id, 'missing_margin', 'low' from records where gp_rate is null union all
      select row_index, id, 'technical_error', 'critical' from records where has_errors)
    select type, severity, count(*) as n, min(row_index) as first_row, count(distinct id) as records from i group by type, severity""",
    "records",
)
PENALTY = f"least(60, (case when {TEXT('mpn', 'mpn_quoted')} is null then 20 else 0 end) + (case when qty is null and req_qty is null then 10 else 0 end) + (case when price is null then 10 else 0 end) + (case when gp_rate is null then 3 else 0 end) + (case when has_errors then 30 else 0 end))"
add(
    "a_quality_scores",
    lambda s, d: A.quality_scores(A.issues(R.records(s, d)), "upload_batch_id"),
    f"""with p as (select upload_batch_id, {PENALTY} as p from records)
    select upload_batch_id, count(*) as records, cast(floor(100 - 100.0 * sum(p) / (60 * count(*)) + 0.5) as bigint) as workbook_score, floor(1000.0 * count(*) filter (p = 0) / count(*) + 0.5) / 10 as worker_score from p group by upload_batch_id""",
    "records",
)

# ---- filters and search

FILTERS = {"supplier": "supplier#00000000", "mpn": "p-1", "price": (1000.0, 3000.0), "qty": (5.0, 40.0), "created": ("1996-01-01", "1999-06-30"), "has_errors": False}
add(
    "f_records_filter",
    lambda s, d: P.filter_records(R.active_records(s, d), FILTERS).select("id", "category", "mpn", "price", "qty", "created_at"),
    """select id, category, mpn, price, qty, created_at from active where (lower(supplier) like '%supplier#00000000%' or lower(supplier_name) like '%supplier#00000000%') and (lower(mpn) like '%p-1%' or lower(mpn_quoted) like '%p-1%')
    and price between 1000 and 3000 and coalesce(qty, req_qty) between 5 and 40 and created_at >= timestamp '1996-01-01' and created_at < timestamp '1999-07-01' and not has_errors""",
    "records",
)
add(
    "f_records_filter_by_role",
    lambda s, d: P.filter_records(R.active_records(s, d), FILTERS | {"gp_rate": (0.0, 0.02)}, role="employee").groupBy("category").agg(F.count("*").alias("n")),
    """select category, count(*) as n from active where (lower(mpn) like '%p-1%' or lower(mpn_quoted) like '%p-1%') and coalesce(qty, req_qty) between 5 and 40 and created_at >= timestamp '1996-01-01' and created_at < timestamp '1999-07-01' and not has_errors group by category""",
    "records",
)
add("f_low_margin", lambda s, d: P.low_margin(R.active_records(s, d), 0.03).select("id", "gp_rate", "mpn"), "select id, gp_rate, mpn from active where gp_rate < 0.03", "records")
add("f_compare", lambda s, d: R.active_records(s, d).filter(P.both([P.compare("price", "gte", 1200.0), P.compare("lead_time_weeks", "lt", 3.0)])).select("id", "price", "lead_time_weeks"), "select id, price, lead_time_weeks from active where price >= 1200 and lead_time_weeks < 3", "records")
add(
    "f_missing_mpn_newest",
    lambda s, d: R.active_records(s, d).filter(S.first_text(F.col("mpn"), F.col("mpn_quoted")).isNull()).orderBy(F.desc("created_at"), "id").limit(50).select("id", "created_at"),
    f"select id, created_at from active where {TEXT('mpn', 'mpn_quoted')} is null order by created_at desc, id limit 50",
    "records",
)
add(
    "f_any_column_search",
    lambda s, d: R.active_records(s, d).filter(P.either([S.contains_text(F.col(c), "blue") for c in ("description", "customer", "supplier")] + [S.contains_text(F.col("po"), "PO12")])).select("id", "description", "po"),
    "select id, description, po from active where description ilike '%blue%' or customer ilike '%blue%' or supplier ilike '%blue%' or po ilike '%po12%'",
    "records",
)
add(
    "f_text_search",
    lambda s, d: P.text_search(table(s, d, "part"), F.concat_ws(" ", "p_name", "p_brand", "p_type"), [["red widget", "bolt"]], ["small"]).select("p_partkey", "p_name"),
    "select p_partkey, p_name from part where ((p_name || ' ') like '%red widget %' or regexp_matches(lower(concat_ws(' ', p_name, p_brand, p_type)), '\\bbolt\\b')) and not regexp_matches(lower(concat_ws(' ', p_name, p_brand, p_type)), '\\bsmall\\b')",
)
for me in (0, 1, 2):
    add(
        f"f_visible_uploads_{('admin', 'manager', 'employee')[me]}",
        lambda s, d, me=me: P.visible(R.uploads(s, d), "uploaded_by", R.profiles(s, d), me).select("id", "uploaded_by", "status"),
        f"""select id, uploaded_by, status from uploads where exists (select 1 from profiles o, profiles m where o.id = uploads.uploaded_by and m.id = {me}
        and (m.role = 'admin' or o.id = m.id or (m.role = 'manager' and (o.department = m.department or o.region = m.region))))""",
        "uploads", "profiles",
    )
add("f_redacted_records", lambda s, d: P.redact(R.active_records(s, d), "manager").select("id", "price", "cost", "gp", "po", "supplier", "customer", "mpn"), "select id, cast(null as double) as price, cast(null as double) as cost, cast(null as double) as gp, cast(null as varchar) as po, supplier, customer, mpn from active", "records")
BAG = {"Unit Price": "price", "Proveedor": "category", "Supplier Name": "supplier", "PO #": "po", "MPN": "mpn", "Comisión": "commission", "account_client_name": "category", "Buyer Remarks": "description", "qty": "qty"}
add(
    "f_redacted_bags",
    lambda s, d: P.redact(R.active_records(s, d).select("id", F.create_map(*[x for k, c in BAG.items() for x in (F.lit(k), F.col(c).cast("string"))]).alias("raw")), "manager").select("id", F.explode("raw").alias("name", "value")),
    f"""with e as (select id, unnest([{", ".join(f"'{k}'" for k in BAG)}]) as name, unnest([{", ".join(f"cast({c} as varchar)" for c in BAG.values())}]) as value from active)
    select id, name, case when name not in ('Unit Price', 'PO #', 'Comisión', 'Buyer Remarks') then value end as value from e""",
    "records",
)
add(
    "f_logs",
    lambda s, d: P.filter_logs(R.logs(s, d), level="error", route="/7", since="2024-01-10", until="2024-01-20").select("id", "route", "created_at"),
    "select id, route, created_at from logs where level = 'error' and route like '%/7%' and created_at >= timestamp '2024-01-10' and created_at < timestamp '2024-01-20'",
    "logs",
)
FORM = search.Form(category="RFQ", since=date(1998, 1, 1), until=date(1998, 12, 31), numbers={"qty": ("gt", 30.0), "price": ("lt", 1500.0)})
add(
    "p_executive_search",
    lambda s, d: search.records(R.active_records(s, d), R.profiles(s, d), FORM).select("id", "category", "qty", "price", "created_at"),
    "select id, category, qty, price, created_at from active where category = 'RFQ' and qty > 30 and price < 1500 and created_at >= timestamp '1998-01-01' and created_at < timestamp '1999-01-01'",
    "records",
)
STAFF_FORM = search.Form(supplier="supplier#", employee="nation_1", error="MISSING", since=date(1997, 1, 1), numbers={"lead_time_days": ("gte", 28.0), "gp_rate": ("lt", 0.05), "upload_errors": ("gt", 5)})
add(
    "p_search_everywhere",
    lambda s, d: search.everywhere(STAFF_FORM, R.active_records(s, d), R.uploads(s, d).withColumn("error_count", F.col("orders")), A.issues(R.records(s, d)).select("id", "created_at", F.explode("issues").alias("i")).select("id", "created_at", "i.type", "i.column"), R.profiles(s, d)),
    f"""with p as (select id from profiles where full_name ilike '%nation_1%' or email ilike '%nation_1%'), i as (select id, created_at, unnest(list_filter([case when {TEXT("mpn", "mpn_quoted")} is null then 'missing_mpn' end, case when qty is null and req_qty is null then 'missing_quantity' end, case when price is null then 'missing_price' end, case when gp_rate is null then 'missing_margin' end], lambda x: x is not null)) as type from records)
    select 'record' as entity, id, created_at from active where (supplier ilike '%supplier#%' or supplier_name ilike '%supplier#%') and lead_time_weeks >= 4 and gp_rate < 0.05 and created_at >= timestamp '1997-01-01' and uploaded_by in (from p)
    union all select 'upload', cast(id as varchar), created_at from uploads where orders > 5 and created_at >= timestamp '1997-01-01' and uploaded_by in (from p)
    union all select 'error', id, created_at from i where created_at >= timestamp '1997-01-01' union all select 'person', cast(id as varchar), null from p""",
    "records", "uploads", "profiles",
)
GROUPS = {"mpn": ("active", "mpn", 6), "customer": ("active", "customer", 6), "supplier": ("active", "supplier", 6), "po": ("active", "po", 6), "category": ("active", "category", 6), "description": ("active", "description", 6), "file": ("uploads", "original_file_name", 5), "person": ("profiles", "full_name", 5), "department": ("profiles", "department", 5)}
add(
    "p_all_suggestions",
    lambda s, d: search.all_suggestions("o", R.active_records(s, d), R.uploads(s, d), R.profiles(s, d)),
    " union all ".join(f"select * from (select '{k}' as kind, v as suggestion, row_number() over (order by k) as position from (select min(trim({c})) as v, lower(trim({c})) as k from {t} where {c} ilike '%o%' group by 2)) where position <= {n}" for k, (t, c, n) in GROUPS.items()),
    "records", "uploads", "profiles",
)
add(
    "p_suggestions",
    lambda s, d: search.suggestions(R.active_records(s, d), "p1", {"mpn": "mpn", "customer": "customer", "supplier": "supplier", "po": "po"}, 6),
    """with a as (select 'mpn' as kind, mpn as v from active union all select 'customer', customer from active union all select 'supplier', supplier from active union all select 'po', po from active),
    g as (select kind, min(trim(v)) as suggestion, lower(trim(v)) as k from a where lower(v) like '%p1%' group by kind, lower(trim(v)))
    select kind, suggestion, position from (select kind, suggestion, row_number() over (partition by kind order by k) as position from g) where position <= 6""",
    "records",
)

# ---- aggregations

for name, column, label in (("category", "category", "category"), ("supplier", "supplier_name", SUPPLIER), ("customer", "customer", CUSTOMER)):
    expr = {"category": lambda: F.col("category"), "supplier": lambda: S.first_text(F.col("supplier_name"), F.col("supplier")), "customer": lambda: S.first_text(F.col("customer"), F.col("client"))}[name]
    add(
        f"a_group_count_{name}",
        lambda s, d, expr=expr: A.group_count(R.active_records(s, d), expr()),
        f"with c as (select coalesce(nullif(trim({label}), ''), 'Unspecified') as label, count(*) as n from active group by 1), t as (select sum(n) as total from c) select label, n, cast({ROUND} as bigint) as percent from c, t",
        "records",
    )
add(
    "a_mpn_groups",
    lambda s, d: A.mpn_groups(R.active_records(s, d), 25),
    f"""with m as (select {TEXT("mpn", "mpn_quoted")} as label from active), c as (select label, count(*) as n from m where label is not null group by label), t as (select sum(n) as total from c),
    top as (select label, n, cast({ROUND} as bigint) as percent from c, t order by n desc, label limit 25)
    select * from top union all select 'Missing MPN', count(*), null from m where label is null having count(*) > 0""",
    "records",
)
MONEY = lambda c, n: f"sum(cast(round(coalesce({c}, 0) * 100) as bigint)) / 100.0 as {n}"
add(
    "a_platform_totals",
    lambda s, d: A.platform_totals(R.active_records(s, d), R.uploads(s, d), R.profiles(s, d)),
    f"""select count(*) as total_records, count(distinct coalesce(category, 'Generic')) as categories_detected, {MONEY("qty", "total_qty")}, {MONEY("potential_amount_usd", "total_potential_usd")}, {MONEY("total_price", "total_price")},
    {MONEY("gp", "gross_profit")}, round(coalesce(avg(nullif(gp_rate, 0)), 0), 4) as average_gp_rate, {MONEY("commission", "commission_total")}, count(*) filter (has_errors) as records_with_errors,
    count(*) filter ({CUSTOMER} is null or {SUPPLIER} is null or {TEXT("mpn", "mpn_quoted")} is null or coalesce(qty, req_qty) is null or coalesce(price, total_price) is null) as incomplete_records, count(*) filter ({TEXT("mpn", "mpn_quoted")} is null) as records_missing_mpn,
    (select count(*) from uploads where archived_at is null) as total_uploads, (select max(created_at) from uploads) as last_upload, (select count(*) from profiles where is_active) as active_employees from active""",
    "records", "uploads", "profiles",
)
add(
    "a_breakdowns",
    lambda s, d: A.breakdowns(R.active_records(s, d), R.profiles(s, d)),
    f"""with own as (select category, full_name as uploader, department, role, region, {TEXT("mpn", "mpn_quoted")} as mpn, {CUSTOMER} as customer, {TEXT("supplier", "supplier_name")} as supplier, strftime(created_at, '%Y-%m-%d') as day from active left join profiles on uploaded_by = profiles.id),
    e as (select unnest(['category', 'uploader', 'department', 'role', 'region', 'mpn', 'customer', 'supplier', 'day']) as dimension, unnest([category, uploader, department, role, region, mpn, customer, supplier, day]) as label from own union all select 'active_department', department from profiles where is_active),
    c as (select dimension, coalesce(nullif(trim(label), ''), 'Unspecified') as label, count(*) as n from e group by 1, 2), r as (select *, sum(n) over (partition by dimension) as total, row_number() over (partition by dimension order by n desc, label) as position from c)
    select dimension, label, n, cast({ROUND} as bigint) as percent, position from r where position <= 10""",
    "records", "profiles",
)
add(
    "a_category_modules",
    lambda s, d: A.category_modules(R.active_records(s, d)).select("module", "records", "total_price", "gp", "qty", "gp_rate", "lead_time", "with_errors", "quoted_labels", "suppliers", "customers"),
    f"""select coalesce(category, 'Generic') as module, count(*) as records, {MONEY("total_price", "total_price")}, {MONEY("gp", "gp")}, {MONEY("qty", "qty")}, round(coalesce(avg(nullif(gp_rate, 0)), 0), 4) as gp_rate,
    round(coalesce(avg(nullif(lead_time_weeks, 0)), 0), 2) as lead_time, count(*) filter (has_errors) as with_errors, count(distinct coalesce(nullif(trim(mpn_quoted), ''), 'Unspecified')) as quoted_labels, count(distinct {SUPPLIER}) as suppliers, count(distinct {CUSTOMER}) as customers from active group by 1""",
    "records",
)
add(
    "a_activity_directory",
    lambda s, d: A.activity_directory(R.profiles(s, d), R.uploads(s, d), R.active_records(s, d)),
    """select p.id, full_name, role, department, (select count(*) from uploads u where u.uploaded_by = p.id) as uploads, (select count(*) from active a where a.uploaded_by = p.id) as records, (select max(created_at) from uploads u where u.uploaded_by = p.id) as last_upload from profiles p""",
    "records", "uploads", "profiles",
)
add(
    "a_module_groups",
    lambda s, d: A.module_groups(R.active_records(s, d), {
        "Sales Margin": {"formula errors": F.when(F.col("has_errors"), "Formula error").otherwise("Clean")}, "RFQ": {"generic": F.col("description")}, "Supplier Offers": {"date codes": F.date_format("created_at", "yyyy")},
        "Logistics": {"countries": F.when(F.col("row_index") > 2, "Chile"), "delivery points": F.col("line_status")}, "Generic": {"missing values": F.when(F.col("req_qty").isNull(), "Has missing values").otherwise("Complete")},
    }),
    f"""with m as (select *, coalesce(category, 'Generic') as module from active),
    e as (select module, 'customer' as list, coalesce({CUSTOMER}, 'Unspecified') as label from m union all select module, 'supplier', coalesce({SUPPLIER}, 'Unspecified') from m union all select module, 'mpn', coalesce({TEXT("mpn", "mpn_quoted")}, 'Missing MPN') from m
      union all select module, 'formula errors', case when has_errors then 'Formula error' else 'Clean' end from m where module = 'Sales Margin' union all select module, 'generic', coalesce(nullif(trim(description), ''), 'Unspecified') from m where module = 'RFQ'
      union all select module, 'date codes', strftime(created_at, '%Y') from m where module = 'Supplier Offers' union all select module, 'countries', case when row_index > 2 then 'Chile' else 'Unspecified' end from m where module = 'Logistics'
      union all select module, 'delivery points', line_status from m where module = 'Logistics' union all select module, 'missing values', case when req_qty is null then 'Has missing values' else 'Complete' end from m where module = 'Generic'),
    c as (select module, list, label, count(*) as n, list = 'mpn' and label = 'Missing MPN' as missing from e group by all), w as (select *, sum(n) filter (not missing) over (partition by module, list) as total, row_number() over (partition by module, list order by missing, n desc, label) as position from c)
    select module, list, label, n, case when not missing then cast(floor(100.0 * n / total + 0.5) as bigint) end as percent, position from w where position <= 8""",
    "records",
)
add(
    "a_client_metrics",
    lambda s, d: A.client_metrics(R.active_records(s, d)),
    f"select {CUSTOMER} as client, count(distinct upload_batch_id) as files, count(distinct {PART}) as part_numbers, count(*) filter (coalesce(req_qty, qty) > 0) as demand_lines, count(*) filter (on_hand > 0) as stock_lines from active where {CUSTOMER} is not null group by 1",
    "records",
)
add(
    "a_upload_status",
    lambda s, d: R.uploads(s, d).groupBy("status").agg(F.count("*").alias("n"), F.sum("orders").alias("orders"), F.count_if(F.col("archived_at").isNotNull()).alias("archived"), F.count_if(F.col("orders") == 0).alias("never_used")),
    "select status, count(*) as n, sum(orders) as orders, count(archived_at) as archived, count(*) filter (orders = 0) as never_used from uploads group by status",
    "uploads",
)

# ---- duplicates, latest rows, order and pages

KEYS = ["upload_batch_id", "row_index", "category", "mpn"]
ORDER = lambda: [F.desc("created_at"), F.desc("id")]
DUPS = """with g as (select id, upload_batch_id, row_index, category, mpn, count(*) over w as copies, first_value(id) over o as keeper, row_number() over o as position from active
    window w as (partition by upload_batch_id, row_index, category, mpn), o as (partition by upload_batch_id, row_index, category, mpn order by created_at desc, id desc))"""
add("d_duplicates", lambda s, d: D.duplicates(R.active_records(s, d), KEYS, ORDER()).select("id", *KEYS, "copies", "keeper", "position"), f"{DUPS} select * from g where copies > 1", "records")
add(
    "d_cleanup_plan",
    lambda s, d: D.cleanup_plan(D.duplicates(R.active_records(s, d), KEYS, ORDER()), KEYS),
    f"{DUPS} select upload_batch_id, row_index, category, mpn, max(copies) - 1 as removable, max(keeper) as keeper, case when max(copies) > 10 then 'low' when max(copies) > 3 then 'medium' else 'high' end as confidence from g where copies > 1 group by all",
    "records",
)
add(
    "d_soft_archive",
    lambda s, d: D.archive(R.records(s, d), D.duplicates(R.active_records(s, d), KEYS, ORDER()).filter("position > 1"), "id", F.lit("2024-01-01").cast("timestamp")).groupBy("category").agg(F.count("*").alias("n"), F.count("archived_at").alias("archived"), F.max("archived_at").alias("last")),
    f"{DUPS} select category, count(*) as n, count(case when archived_at is not null or id in (select id from g where copies > 1 and position > 1) then 1 end) as archived, max(case when archived_at is not null then archived_at when id in (select id from g where copies > 1 and position > 1) then timestamp '2024-01-01' end) as last from records group by category",
    "records",
)
KEYED = "select concat(id, '-', cast(row_index as string)) as id, created_at, concat('Office ', cast(uploaded_by as string)) as customer, supplier, supplier_name, mpn, mpn_quoted, case when row_index % 2 = 0 then '' end as po, case when row_index % 3 = 0 then 0.0 when row_index % 3 = 1 then floor(qty / 10) end as qty, floor(req_qty / 10) + 0.5 as req_qty from active"
NUMBER = "case when coalesce(qty, req_qty) = 0 then null when coalesce(qty, req_qty) = floor(coalesce(qty, req_qty)) then cast(cast(coalesce(qty, req_qty) as bigint) as varchar) else cast(coalesce(qty, req_qty) as varchar) end"
add(
    "d_business_key",
    lambda s, d: D.business_key_duplicates((lambda df: s.sql(KEYED.replace("from active", "from {active}"), active=df))(R.active_records(s, d))),
    f"""with t as ({KEYED}), k as (select id, created_at, list_filter([customer, coalesce(supplier, supplier_name), coalesce(mpn, mpn_quoted), po, {NUMBER}], lambda x: x is not null and x <> '') as parts from t),
    j as (select *, lower(array_to_string(parts, '|')) as key from k where len(parts) >= 3), w as (select *, count(*) over (partition by key) as copies, row_number() over (partition by key order by created_at, id) as place from j)
    select id, key, copies, case when place = 1 then copies - 1 else 1 end as issues from w where copies > 1""",
    "records",
)
add(
    "d_latest_turn",
    lambda s, d: D.latest_per_group(table(s, d, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n_chars")), ["conv_id"], ["turn", "role"]),
    "select conv_id, turn, role, length(text) as n_chars from conversations qualify row_number() over (partition by conv_id order by turn desc, role desc, length(text) desc nulls last) = 1",
)
add(
    "d_latest_upload",
    lambda s, d: D.latest_per_group(R.uploads(s, d).select("uploaded_by", "created_at", "id", "status"), ["uploaded_by"], ["created_at", "id"]),
    "select uploaded_by, created_at, id, status from uploads qualify row_number() over (partition by uploaded_by order by created_at desc nulls last, id desc) = 1",
    "uploads",
)
add(
    "d_first_by_key",
    lambda s, d: D.first_by_key(R.active_records(s, d).filter("mpn is not null").select("created_at", "id", "mpn"), F.lower(F.trim("mpn")), ["created_at", "id"]),
    "select created_at, id, mpn from active where mpn is not null qualify row_number() over (partition by lower(trim(mpn)) order by created_at, id, mpn) = 1",
    "records",
)
add("d_page", lambda s, d: D.page(R.active_records(s, d), [F.desc("created_at"), F.col("id"), F.col("potential_amount_usd")], 3, 40).select("id", "created_at"), "select id, created_at from active order by created_at desc, id, potential_amount_usd limit 40 offset 80", "records")
add(
    "d_timeline",
    lambda s, d: D.timeline({"log": R.logs(s, d).filter("level = 'error'").select("created_at", "id", "action"), "upload": R.uploads(s, d).select("created_at", "id", "status")}),
    "select 'log' as source, created_at, id, action, null as status from logs where level = 'error' union all select 'upload', created_at, id, null, status from uploads",
    "logs", "uploads",
)

# ---- joins and sets

add(
    "j_records_with_people",
    lambda s, d: R.active_records(s, d).join(F.broadcast(R.profiles(s, d).select(F.col("id").alias("uploaded_by"), "full_name", "region")), "uploaded_by", "left").select("id", "full_name", "region", "category"),
    "select active.id, full_name, region, category from active left join profiles on uploaded_by = profiles.id",
    "records", "profiles",
)
add("j_uploads_of_people", lambda s, d: R.uploads(s, d).join(R.profiles(s, d).filter(S.contains_text(F.col("full_name"), "nation_1")).select(F.col("id").alias("uploaded_by")), "uploaded_by", "left_semi").select("id", "uploaded_by"), "select id, uploaded_by from uploads where uploaded_by in (select id from profiles where full_name ilike '%nation_1%')", "uploads", "profiles")
add("j_uploads_without_orders", lambda s, d: table(s, d, "customer").join(table(s, d, "orders").filter("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name"), "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
add(
    "j_conversation_replies",
    lambda s, d: (lambda c: c.filter("role = 'user'").alias("q").join(c.filter("role <> 'user'").alias("a"), (F.col("q.conv_id") == F.col("a.conv_id")) & (F.col("a.turn") == F.col("q.turn") + 1), "left").select(F.col("q.conv_id").alias("conv_id"), F.col("q.turn").alias("turn"), F.col("a.role").alias("answered_by"), F.length("a.text").alias("answer_chars")))(table(s, d, "conversations")),
    "select q.conv_id, q.turn, a.role as answered_by, length(a.text) as answer_chars from conversations q left join conversations a on a.conv_id = q.conv_id and a.turn = q.turn + 1 and a.role <> 'user' where q.role = 'user'",
)
add(
    "j_recipients",
    lambda s, d: D.first_by_key(R.profiles(s, d).filter("is_active").select(F.lit(1).alias("rank"), "email").unionByName(R.uploads(s, d).filter("status = 'failed'").select(F.lit(0).alias("rank"), F.concat(F.lit("NATION_"), "uploaded_by", F.lit("@EXAMPLE.com")).alias("email")).distinct()), F.lower("email"), ["rank", "email"]),
    "select rank, email from (select 1 as rank, email from profiles where is_active union select 0, concat('NATION_', uploaded_by, '@EXAMPLE.com') from uploads where status = 'failed') qualify row_number() over (partition by lower(email) order by rank, email) = 1",
    "profiles", "uploads",
)
OFFERED = lambda s, d, side: table(s, d, "lineitem").filter({"open": "l_linestatus = 'O'", "returned": "l_returnflag <> 'N'"}[side]).select("l_partkey", "l_suppkey")
add(
    "s_part_sets",
    lambda s, d: OFFERED(s, d, "open").intersect(OFFERED(s, d, "returned")).withColumn("side", F.lit("both"))
    .unionByName(OFFERED(s, d, "open").subtract(OFFERED(s, d, "returned")).withColumn("side", F.lit("open"))).unionByName(OFFERED(s, d, "returned").subtract(OFFERED(s, d, "open")).withColumn("side", F.lit("returned"))),
    """with a as (select distinct l_partkey, l_suppkey from lineitem where l_linestatus = 'O'), b as (select distinct l_partkey, l_suppkey from lineitem where l_returnflag <> 'N')
    select *, 'both' as side from (from a intersect from b) union all select *, 'open' from (from a except from b) union all select *, 'returned' from (from b except from a)""",
)

# ---- part numbers

add("m_normalize", lambda s, d: R.records(s, d).select("id", S.normalize_mpn(F.col("mpn")).alias("part"), S.review_key(F.col("mpn")).alias("review")), f"select id, {MPN('mpn')} as part, nullif(regexp_replace({MPN('mpn')}, '[^A-Z0-9]', '', 'g'), '') as review from records", "records")
add(
    "m_lookup",
    lambda s, d: M.lookup(R.active_records(s, d), table(s, d, "part").select(F.concat(F.when(F.col("p_partkey") % 17 == 0, F.lit("q-")).otherwise(F.lit("p-")), "p_partkey").alias("mpn"))).select("id", "part", "matched"),
    f"""with want as (select distinct upper(concat(case when p_partkey % 17 = 0 then 'q-' else 'p-' end, p_partkey)) as part from part), e as (select id, part, 'mpn' as matched from (select id, {MPN("mpn")} as part from active) join want using (part))
    select * from e union all select id, part, 'mpn_quoted' from (select id, {MPN("mpn_quoted")} as part from active) join want using (part) where part not in (select part from e)""",
    "records",
)
add("m_suggest", lambda s, d: M.suggest(R.active_records(s, d), "p-10"), f"select part, count(*) as records from (select {MPN('mpn')} as part from active) where part like 'P-10%' group by part order by part <> 'P-10', part limit 12", "records")
RANKED = f"""with own as (select {PART} as part, coalesce({SUPPLIER}, 'Unknown supplier') as supplier, price, lead_time_weeks as l, coalesce(on_hand, qty, 0) as q, gp_rate, has_errors from active where {PART} is not null),
    s as (select part, supplier, count(*) as offers, min(price) as price, min(l) as lead, max(q) as quantity, avg(gp_rate) as gp, count(*) filter (not coalesce(has_errors, false)) as clean from own group by all),
    w as (select *, min(price) over (partition by part) as best, min(lead) over (partition by part) as fast, max(quantity) over (partition by part) as most from s),
    c as (select part, supplier, offers, price, lead, quantity, round(round(gp, 10), 4) as average_gp, floor(100 * ((case when price is null then 0 when price <= best then 45 else greatest(0, 35 - 35 * (price - best) / greatest(best, 1)) end) + (case when lead is null then 0 when lead <= fast then 20 else greatest(0, 15 - (lead - fast)) end)
      + (case when most > 0 then least(20, 20 * quantity / most) else 0 end) + least(10, greatest(0, 20 * coalesce(gp, 0))) + (case when clean = 0 then 0 else 5 end)) + 0.5) / 100 as score,
      concat_ws(',', case when price <= best then 'price' end, case when lead <= fast then 'lead' end, case when quantity >= most and most > 0 then 'quantity' end) as best_at from w),
    r as (select *, row_number() over (partition by part order by score desc, price asc nulls last, supplier) as position from c)"""
OFFERS = f"{RANKED}, o as (select part, count(*) as offers, min(price) as best_price, max(price) as worst_price, min(l) as fastest_lead, max(q) as most_quantity from own group by part)"
add("m_supplier_ranking", lambda s, d: M.supplier_ranking(R.active_records(s, d)), f"{RANKED} select * exclude (best_at) from r", "records")
add("m_offer_summary", lambda s, d: M.offer_summary(R.active_records(s, d)), f"{OFFERS} select o.*, supplier as recommended, score, best_at from o left join r on o.part = r.part and position = 1", "records")
add(
    "m_plain_ranking",
    lambda s, d: M.ranking_for(R.active_records(s, d), "manager"),
    f"with g as (select {PART} as part, coalesce({SUPPLIER}, 'Unknown supplier') as supplier, count(*) as offers, max(coalesce(on_hand, qty)) as quantity, min(lead_time_weeks) as lead from active where {PART} is not null group by 1, 2) select *, row_number() over (partition by part order by lower(supplier), supplier) as position from g",
    "records",
)
add(
    "m_summary_for_role",
    lambda s, d: M.summary_for(R.active_records(s, d), "employee"),
    f"{OFFERS} select part, offers, cast(null as double) as best_price, cast(null as double) as worst_price, fastest_lead, most_quantity, cast(null as varchar) as recommended, cast(null as double) as score, cast(null as varchar) as best_at from o",
    "records",
)
TYPED = "select case l_partkey % 3 when 0 then concat(' ', cast(l_partkey * 1000 + l_linenumber as string)) when 1 then concat('ab ', cast(l_partkey as string)) else concat('1,', lpad(cast(l_partkey % 1000 as string), 3, '0'), ',456') end as mpn from lineitem"
add(
    "m_lookup_candidates",
    lambda s, d: M.lookup_candidates(R.frame(s, d, TYPED)),
    f"""with a as (select distinct mpn from ({TYPED})), n as (select mpn, {MPN("mpn")} as part from a),
    g as (select *, case when regexp_matches(part, '^[0-9]{{4,}}$') then format('{{:,}}', cast(part as bigint)) end as c from n),
    w as (select mpn, list_filter([trim(mpn), part, c, replace(c, ',', '.')], lambda x: x is not null) as ways from g),
    d as (select mpn, list_filter(ways, lambda x, i: list_position(ways, x) = i) as ways from w)
    select mpn, unnest(ways) as candidate, cast(unnest(range(len(ways))) as int) as place from d""",
)
add(
    "m_price_history",
    lambda s, d: M.price_history(R.active_records(s, d), R.uploads(s, d)),
    f"select {PART} as part, strftime(coalesce(u.created_at, a.created_at), '%Y-%m-%d') as day, min(price) as low, max(price) as high, count(*) as n from active a left join uploads u on u.id = upload_batch_id where price is not null and {PART} is not null group by all",
    "records", "uploads",
)

# ---- coverage and opportunities

# What the bags say, worked out by category: see the mapping of ``bags``.
BAG_PART = MPN("coalesce(mpn, mpn_quoted)")
NEEDS = f"""with own as (select id, upload_batch_id, created_at, {BAG_PART} as part, coalesce(category = 'Generic' or (category in ('Supplier Offers', 'Sales Margin') and on_hand is not null), false) as is_stock,
      coalesce(category in ('RFQ', 'Logistics', 'Sales Margin') and (req_qty is not null or (category = 'Logistics' and qty is not null)), false) as is_need, on_hand, case when category = 'Logistics' then coalesce(qty, req_qty) else req_qty end as needed,
      coalesce(customer, client) as customer, coalesce(supplier, supplier_name) as supplier, coalesce(manufacturer, clean_mfg) as maker from active where {BAG_PART} is not null),
    n as (select * exclude (on_hand, needed), case when is_stock then on_hand end as stock_qty, case when is_need then needed end as need_qty from own where is_stock or is_need)"""
COVER = f"""{NEEDS},
    g as (select part, sum(greatest(need_qty, 0)) filter (need_qty is not null) as required, sum(greatest(stock_qty, 0)) filter (stock_qty is not null) as stock, (max(row(created_at, customer)) filter (customer is not null))[2] as customer, (max(row(created_at, supplier)) filter (supplier is not null))[2] as supplier,
      (max(row(created_at, maker)) filter (maker is not null))[2] as maker, count(distinct upload_batch_id) as sources, count(*) as rows from n group by part),
    c as (select *, case when coalesce(required, 0) <= 0 then (case when coalesce(stock, 0) > 0 then 'overstock' else 'unknown' end) when coalesce(stock, 0) <= 0 then 'no_stock' when stock < required then 'partial_stock' when stock > required then 'overstock' else 'in_stock' end as status,
      case when required is not null then greatest(required - coalesce(stock, 0), 0) end as shortage from g)"""
COVERED = lambda s, d: C.coverage(B.stock_and_needs(R.bags(s, d), R.layouts(s, d)), R.partitions(s, d))
add("c_stock_and_needs", lambda s, d: B.stock_and_needs(R.bags(s, d), R.layouts(s, d)), f"{NEEDS} select * from n", "records")
add("c_coverage", COVERED, f"{COVER} select * from c", "records")
add("c_coverage_totals", lambda s, d: C.coverage_totals(COVERED(s, d)), f"{COVER} select count(*) as parts, " + ", ".join(f"count(*) filter (status = '{k}') as {k}" for k in ("in_stock", "partial_stock", "no_stock", "overstock", "unknown")) + ", sum(required) as required, sum(stock) as stock, sum(shortage) as shortage from c", "records")
add("c_coverage_filter", lambda s, d: C.coverage_filter(COVERED(s, d), text="p-1", statuses=["partial_stock", "overstock"], party="brand#3").select("part", "status", "maker"), f"{COVER} select part, status, maker from c where part like '%P-1%' and status in ('partial_stock', 'overstock') and (lower(supplier) = 'brand#3' or lower(maker) = 'brand#3')", "records")
SIGNALS = f"""with own as (select *, {BAG_PART} as part, coalesce(req_qty, qty) as needed, coalesce(category in ('RFQ', 'Logistics', 'Sales Margin'), false) as asked, coalesce(category = 'Supplier Offers' and return_flag = 'R' and on_hand is not null, false) as is_excess,
      coalesce((category = 'Supplier Offers' and line_status <> 'F') or (category = 'Logistics' and line_status = 'F'), false) as approved, coalesce(category = 'Logistics' and qty > 0, false) as received from active where {BAG_PART} is not null),
    t as (select id, upload_batch_id, created_at, part, coalesce(needed > 0 and category is distinct from 'Generic' and (req_qty is not null or asked or on_hand is null), false) as is_demand, coalesce(on_hand > 0, false) as is_stock, is_excess, approved, received, needed, on_hand,
      coalesce(customer, client) as customer, coalesce(supplier, supplier_name) as supplier, coalesce(manufacturer, clean_mfg) as maker from own),
    sig as (select * exclude (needed, on_hand), case when is_demand then needed end as demand, case when is_stock then on_hand end as stock, case when is_excess then greatest(on_hand, 0) end as excess, is_demand and customer is null as no_customer, (is_stock or is_excess) and supplier is null and maker is null as no_party from t)"""
add("o_signals", lambda s, d: B.signals(R.bags(s, d), R.layouts(s, d)), f"{SIGNALS} select * from sig", "records")
for name, sql in (("demand", "is_demand"), ("stock", "is_stock"), ("excess", "is_excess and excess > 0"), ("approved", "approved"), ("received", "received")):
    add(f"o_view_{name}", lambda s, d, name=name: B.view(B.signals(R.bags(s, d), R.layouts(s, d)), name).select("id", "part", "demand", "stock", "excess"), f"{SIGNALS} select id, part, demand, stock, excess from sig where {sql}", "records")
OPP = f"""{SIGNALS},
    g as (select part, coalesce(sum(demand), 0) as d, coalesce(sum(stock), 0) as s, coalesce(sum(excess), 0) as e, bool_or(approved) as approved, bool_or(received) as received, (max(row(created_at, customer)) filter (customer is not null))[2] as customer, (max(row(created_at, supplier)) filter (supplier is not null))[2] as supplier,
      (max(row(created_at, maker)) filter (maker is not null))[2] as maker, count(distinct maker) > 1 as mixed_makers, count(distinct upload_batch_id) as sources,
      max(cast(no_customer as int)) + max(cast(no_party as int)) + max(cast(approved as int)) + max(cast(received as int)) + cast(count(distinct maker) > 1 as int) as flags from sig group by part),
    k as (select *, case when s >= d then 'immediate_sale' when s > 0 then 'partial_sale' when e <= 0 then 'sourcing_needed' end as kind from g where d > 0 union all select *, 'excess_resale' from g where d > 0 and e > 0 union all select *, 'stock_without_demand' from g where d <= 0 and (s > 0 or e > 0)),
    h as (select *, case when d > 0 then nullif(greatest(d - s - case when kind = 'excess_resale' then e else 0 end, 0), 0) end as shortage from k where kind is not null),
    f as (select part, kind, nullif(d, 0) as demand, nullif(s, 0) as stock, nullif(e, 0) as excess, shortage, customer, supplier, maker, mixed_makers, sources, flags,
      greatest(0, least(100, 40 + (case when d > 0 then 10 else 0 end) + (case when s > 0 or e > 0 then 10 else 0 end) + (case when shortage > 0 then 5 else 0 end) + (case when customer is not null then 10 else 0 end) + (case when supplier is not null or maker is not null then 5 else 0 end)
      + (case when approved then 10 else 0 end) + (case when received then 5 else 0 end) + (case when sources > 1 then 5 else 0 end) - least(flags * 5, 20))) as score from h),
    z as (select *, case when score >= 75 then 'high' when score >= 50 then 'medium' else 'low' end as confidence from f)"""
FOUND = lambda s, d: C.opportunities(B.signals(R.bags(s, d), R.layouts(s, d)), partitions=R.partitions(s, d))
add("o_opportunities", FOUND, f"{OPP} select * from z", "records")
add("o_opportunity_totals", lambda s, d: C.opportunity_totals(FOUND(s, d)), f"{OPP} select kind, count(*) as n, sum(demand) as demand, sum(shortage) as shortage, count(*) filter (confidence = 'high') as high from z group by kind", "records")
add(
    "o_top_opportunities",
    lambda s, d: C.top_opportunities(FOUND(s, d)).select("part", "kind", "demand"),
    f"{OPP} select part, kind, demand from z order by list_position(['immediate_sale', 'partial_sale', 'excess_resale', 'sourcing_needed', 'stock_without_demand'], kind), demand desc nulls last, shortage desc nulls last, part limit 50",
    "records",
)
add(
    "o_filtered",
    lambda s, d: C.opportunity_filter(FOUND(s, d), part="p-1", customer="customer#0", supplier="brand#3", maker="brand#3").select("part", "kind", "supplier", "maker"),
    f"{OPP} select part, kind, supplier, maker from z where part like '%P-1%' and lower(customer) like '%customer#0%' and (lower(supplier) like '%brand#3%' or lower(maker) like '%brand#3%')",
    "records",
)
add(
    "o_confidence_page",
    lambda s, d: C.confidence_totals(FOUND(s, d), 200),
    f"{OPP}, p as (select * from z order by list_position(['immediate_sale', 'partial_sale', 'excess_resale', 'sourcing_needed', 'stock_without_demand'], kind), demand desc nulls last, shortage desc nulls last, part limit 200) select count(*) as evaluated, count(*) filter (confidence = 'high') as high, count(*) filter (confidence = 'medium') as medium, count(*) filter (confidence = 'low') as low, (select count(*) from z) as total, (select count(*) from z) > count(*) as truncated from p",
    "records",
)
add("c_newest_uploads", lambda s, d: C.newest_uploads(R.uploads(s, d), 30).select("id", "created_at"), "select id, created_at from uploads order by created_at desc nulls last, id limit 30", "uploads")
add(
    "o_account_clients",
    lambda s, d: C.account_clients(R.active_records(s, d).select(S.normalize_mpn(F.col("mpn")).alias("part"), "upload_batch_id").filter("part is not null").distinct(), table(s, d, "customer").select(F.col("c_custkey").alias("upload_batch_id"), F.concat(F.lit("account "), F.col("c_custkey") % 12).alias("client"))).select("part", F.array_join("clients", ",").alias("clients")),
    f"select part, string_agg(client, ',' order by client) as clients from (select distinct {MPN('mpn')} as part, concat('account ', upload_batch_id % 12) as client from active) where part is not null group by part",
    "records",
)
PROFILED = ["mpn", "customer", "supplier", "price", "gp_rate", "req_qty", "on_hand"]
PROFILE = "with e as (" + " union all ".join(f"select category, '{c}' as \"column\", nullif(trim(cast({c} as varchar)), '') as v from active" for c in PROFILED) + ") "
add(
    "o_structure_profile",
    lambda s, d: C.structure_profile(R.active_records(s, d), PROFILED, "category"),
    PROFILE + """select category, "column", count(*) as rows, count(v) as filled, count(distinct v) as distinct_values, case when count(v) = 0 then 'empty' when count(*) filter (try_cast(v as double) is not null) = count(v) then 'number' else 'text' end as kind, round(count(v) / count(*), 4) as presence from e group by all""",
    "records",
)
# Worked out by hand: the columns of each category's bags (see the mapping of ``bags``), their fields and what follows.
COLUMNS = """select * from (values
    ('Generic', 'Mfg', 'mfg', 'fabricante', 'text', 'fabricante o marca', 1), ('Generic', 'Mfg Partno', 'mfg_partno', 'fabricante', 'text', 'fabricante o marca', 1), ('Generic', 'STOCK QTY', 'stock_qty', 'cantidad', 'number', 'cantidad', 1), ('Generic', 'Vendor', 'vendor', 'proveedor', 'text', 'proveedor', 1),
    ('RFQ', 'Cliente', 'cliente', 'cliente', 'text', 'cliente', 1), ('RFQ', 'Part Number', 'part_number', 'mpn', 'text', 'numero de parte o MPN', 1), ('RFQ', 'REQUIRED QTY', 'required_qty', 'cantidad', 'number', 'cantidad', 2), ('RFQ', 'required_date', 'required_date', 'fecha', 'date', 'fecha', 1),
    ('Logistics', 'BPName', 'bpname', 'mpn', 'text', 'numero de parte o MPN', 1), ('Logistics', 'Item', 'item', null, 'unknown', 'columna Item', 1), ('Logistics', 'RCPT Qty', 'rcpt_qty', 'cantidad', 'number', 'cantidad', 1), ('Logistics', 'estado', 'estado', 'estado', 'status', 'estado del registro', 1),
    ('Supplier Offers', 'Approved', 'approved', null, 'unknown', 'columna Approved', 1), ('Supplier Offers', 'Available Qty', 'available_qty', 'cantidad', 'number', 'cantidad', 1), ('Supplier Offers', 'Excess Qty', 'excess_qty', 'cantidad', 'number', 'cantidad', 1), ('Supplier Offers', 'MPN', 'mpn', 'mpn', 'text', 'numero de parte o MPN', 1),
    ('Sales Margin', 'Description', 'description', null, 'unknown', 'columna Description', 1)) as c(category, name, normalized_name, field, type, meaning, times)"""
BY_CATEGORY = "case detected_category when 'RFQ' then 'cotizacion' when 'Logistics' then (case when n > 0 then 'cotizacion/logistica' else 'general' end) else 'general' end"
CHOSEN = lambda s, d: R.uploads(s, d).select(F.col("id").alias("upload_batch_id"), "detected_category", F.lit(None).cast("string").alias("selected_category"))
TEMPLATES = lambda s, d: K.templates(K.column_profile(R.bag_names(s, d)), CHOSEN(s, d))
add(
    "o_column_profile",
    lambda s, d: K.column_profile(R.bag_names(s, d)),
    f"select upload_batch_id, 'raw_data' as source, name, normalized_name, field, type, meaning, n * times as occurrences, 1.0::double as presence from (select upload_batch_id, category, count(*) as n from active group by all) join ({COLUMNS}) using (category)",
    "records",
)
add(
    "o_templates",
    lambda s, d: TEMPLATES(s, d).withColumn("mappings", F.array_join(F.transform(F.map_entries("mappings"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")),
    f"""with u as (select u.id as upload_batch_id, detected_category, count(a.id) as n from uploads u left join active a on a.upload_batch_id = u.id group by all)
    select upload_batch_id, case when n = 0 then 0 when detected_category = 'Sales Margin' then 1 else 4 end as column_count, {BY_CATEGORY} as detected_template,
      case when n = 0 then '' when detected_category = 'Generic' then 'cantidad=STOCK QTY;fabricante=Mfg;proveedor=Vendor' when detected_category = 'RFQ' then 'cantidad=REQUIRED QTY;cliente=Cliente;fecha=required_date;mpn=Part Number' when detected_category = 'Logistics' then 'cantidad=RCPT Qty;estado=estado;mpn=BPName' when detected_category = 'Supplier Offers' then 'cantidad=Available Qty;mpn=MPN' else '' end as mappings,
      case when n = 0 then 0.35 when detected_category in ('Generic', 'Logistics') then 0.71 when detected_category = 'RFQ' then 0.78 when detected_category = 'Supplier Offers' then 0.64 else 0.5 end::double as confidence from u""",
    "records", "uploads",
)
HEADERS = ["MFG;Part Number;Stock;Unit Cost", "Global Customer Name;MPN", "PriceBook;LeadTime", "Price;Qty", "Plant;Part", "Quotation No", "Sales Order", "Inventory list", "Foo;Bar"]
HEADED = "select c_custkey as upload_batch_id, " + "case c_custkey % 9 " + " ".join(f"when {i} then '{h}'" for i, h in enumerate(HEADERS)) + " end as heads, c_custkey % 5 as total_rows from customer"
add(
    "o_templates_by_headers",
    lambda s, d: K.templates(K.column_profile(R.bags(s, d).filter("1 = 0"), R.frame(s, d, HEADED).select("upload_batch_id", F.split("heads", ";").alias("headers"), "total_rows")), CHOSEN(s, d).withColumn("detected_category", F.lit(None).cast("string"))).select("upload_batch_id", "detected_template", "column_count"),
    "select c_custkey as upload_batch_id, ['inventario', 'cotizacion/logistica', 'pricing/logistica', 'pricing', 'logistica', 'cotizacion', 'compras/ventas', 'inventario', 'general'][c_custkey % 9 + 1] as detected_template, [4, 2, 2, 2, 2, 1, 1, 1, 2][c_custkey % 9 + 1] as column_count from customer",
)
add(
    "c_templates_detected",
    lambda s, d: B.template_of(R.active_records(s, d), R.uploads(s, d), TEMPLATES(s, d)).groupBy("template").agg(F.count("*").alias("n")),
    "select case detected_category when 'RFQ' then 'cotizacion' when 'Logistics' then 'cotizacion/logistica' else 'general' end as template, count(*) as n from active a join uploads u on u.id = a.upload_batch_id group by 1",
    "records", "uploads",
)

ASSIGNED = "select c_custkey as upload_batch_id, concat('account ', cast(c_custkey % 12 as string)) as client from customer union select c_custkey, concat('account ', cast(c_custkey % 7 as string)) from customer where c_custkey % 3 = 0"
OPP_BY_CLIENT = OPP.replace("    g as (select part,", f"    own2 as (select sig.*, client from sig join ({ASSIGNED}) using (upload_batch_id)),\n    g as (select client, part,").replace("from sig group by part)", "from own2 group by client, part)").replace("f as (select part,", "f as (select client, part,")
add(
    "a_client_opportunities",
    lambda s, d: C.client_opportunities(B.signals(R.bags(s, d), R.layouts(s, d)), R.frame(s, d, ASSIGNED), R.partitions(s, d)),
    f"{OPP_BY_CLIENT} select client, count(*) as opportunities, count(*) filter (confidence = 'high') as high_confidence, count(distinct part) as parts from z group by client",
    "records",
)
DECLARED = "select c_custkey as upload_batch_id, c_custkey % 40 as total_rows, case when c_custkey % 4 = 0 then c_custkey % 50 end as imported, case when c_custkey % 5 = 0 then null else 20 end as valid from customer"
add(
    "d_cleanup_summary",
    lambda s, d: D.cleanup_summary(R.active_records(s, d), D.duplicates(R.active_records(s, d), KEYS, ORDER()), R.frame(s, d, DECLARED)),
    f"""{DUPS}, n as (select upload_batch_id, count(*) as active, count(*) filter (copies > 1 and position > 1) as to_archive, coalesce(max(copies) filter (copies > 1), 0) as largest from g group by 1),
    e as (select n.*, coalesce(greatest(total_rows, imported, valid), 0) as expected, active - to_archive as remaining from n left join ({DECLARED}) using (upload_batch_id)), f as (select *, remaining - expected as residual from e)
    select *, residual <> 0 as mismatch, case when to_archive = 0 then 'high' when largest > 10 then 'low' when largest > 3 then 'medium' else 'high' end as confidence, to_archive > 0 and largest <= 10 as safe,
      case when largest > 10 then 'high' when largest > 3 or residual <> 0 then 'medium' else 'low' end as risk from f""",
    "records",
)
FORM_RECORDS = "*, concat('L', row_index) as line_id, case when row_index % 2 = 0 then 'Viet Nam' else 'Chile' end as shipping_point_country, concat_ws(' ', category, mpn, description, supplier) as searchable_text"
RECORD_FORM = {"line_id": "l2", "country": "viet", "query": "rfq small", "department": "Sales", "qty": (2.0, None), "uploaded_by": None}
add(
    "f_records_by_form",
    lambda s, d: P.filter_records(s.sql(f"select {FORM_RECORDS}, department from {{r}} left join {{p}} on uploaded_by = p_id", r=R.active_records(s, d), p=R.profiles(s, d).select(F.col("id").alias("p_id"), "department")), RECORD_FORM).select("id", "line_id", "qty"),
    f"""with f as (select {FORM_RECORDS} from active) select f.id, line_id, qty from f left join profiles p on p.id = uploaded_by where lower(line_id) like '%l2%' and lower(shipping_point_country) like '%viet%'
    and list_has_all(regexp_split_to_array(lower(searchable_text), '[^a-z0-9]+'), ['rfq', 'small']) and department = 'Sales' and coalesce(qty, req_qty) >= 2""",
    "records", "profiles",
)
LOG_MORE = "*, case when action = 'error' then 'import' else 'web' end as module, concat('t', cast(id % 1000 as string)) as trace_id, cast(user_id % 10 as int) as upload_batch_id, concat('user', cast(user_id as string), '@example.com') as user_email, concat(action, ' took long') as message"
add(
    "f_log_explorer",
    lambda s, d: P.filter_logs(s.sql(f"select {LOG_MORE} from {{logs}}", logs=R.logs(s, d)), module="import", upload=3, email="USER1", query="Took", until="2024-01-25").select("id", "trace_id")
    .unionByName(P.filter_logs(s.sql(f"select {LOG_MORE} from {{logs}}", logs=R.logs(s, d)), trace="t7").select("id", "trace_id")),
    f"""with l as (select {LOG_MORE} from logs) select id, trace_id from l where module = 'import' and upload_batch_id = 3 and user_email ilike '%user1%' and (action ilike '%took%' or message ilike '%took%') and created_at < timestamp '2024-01-25'
    union all select id, trace_id from l where trace_id = 't7'""",
    "logs",
)
add(
    "t_finder_expired",
    lambda s, d: T.expired(R.uploads(s, d), T.FINDER_JOBS, "1995-01-20").select("id", F.lit("job").alias("what")).unionByName(T.expired(R.uploads(s, d), T.FINDER_FILES, "1995-01-20").select("id", F.lit("files").alias("what"))),
    "select id, 'job' as what from uploads where created_at + interval 14 days <= timestamp '1995-01-20' union all select id, 'files' from uploads where created_at + interval 72 hours <= timestamp '1995-01-20'",
    "uploads",
)
add(
    "f_sanitized_logs",
    lambda s, d: P.sanitize(s.sql("select event_id, struct(event_type as action, map('api_key', 'k', 'user', concat('user', cast(user_id as string), '@example.com'), 'rawData', 'x', 'note', repeat('ab', 300)) as details, array(array(concat('u', cast(user_id as string), '@a.b'))) as who, sequence(1, 30) as many) as props from {e}", e=table(s, d, "events")), "props")
    .select("event_id", F.to_json("props.details").alias("details"), F.col("props.who")[0][0].alias("who"), F.size("props.many").alias("many")),
    """select event_id, '{"api_key":"<redacted>","user":"us***@example.com","rawData":"<raw-data-redacted>","note":"' || repeat('ab', 250) || '...<truncated>"}' as details, 'u' || substr(cast(user_id as varchar), 1, 1) || '***@a.b' as who, 20 as many from events""",
)

# ---- two-file finder

DEMAND_SQL = "select concat(case when l_partkey % 9 = 0 then 'x ' else 'X-' end, cast(l_partkey as string)) as mpn, case when l_linenumber < 6 then l_quantity * 3 end as q, case when l_partkey % 7 = 1 then 'st  micro' when l_partkey % 7 = 2 then 'TI' when l_partkey % 4 <> 0 then p_brand end as mfg, c_name as who, l_shipdate as due, case when l_linenumber <> 4 then 'ea' end as uom, l_orderkey * 10 + l_linenumber as source_row from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join part on l_partkey = p_partkey where l_linestatus = 'O' and l_returnflag = 'N'"
SUPPLY_SQL = "select concat(case when l_partkey % 6 = 0 then 'Y-' else 'X-' end, cast(l_partkey as string)) as mpn, case when l_linenumber = 7 then - l_quantity else l_quantity * 8 end as q, case when l_suppkey % 10 = 3 then 'Other Maker' when l_partkey % 7 = 1 then 'STMicroelectronics' when l_partkey % 7 = 2 then 'Texas Instruments' else upper(p_brand) end as mfg, case when l_suppkey % 25 = 4 then 'BOX' else 'EA' end as uom, l_orderkey * 10 + l_linenumber as source_row from lineitem join part on l_partkey = p_partkey where l_linestatus = 'F' and l_returnflag = 'A'"


def sides(s, d):
    demand = X.canonical(R.frame(s, d, DEMAND_SQL), "mpn", F.col("q"), "mfg", customer="who", date="due", unit="uom")
    supply = X.canonical(R.frame(s, d, SUPPLY_SQL), "mpn", F.col("q"), "mfg", unit="uom")
    return demand, supply


UPPER = lambda c: f"upper(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"
CLEAN = lambda c: f"nullif(case when {UPPER(c)} in ('TI', 'TEXAS INSTRUMENTS') then 'TEXASINSTRUMENTS' when {UPPER(c)} in ('ST', 'STM', 'ST MICRO') then 'STMICROELECTRONICS' else regexp_replace({UPPER(c)}, '[^A-Z0-9]', '', 'g') end, '')"
FIND = f"""with dr as ({DEMAND_SQL}), sr as ({SUPPLY_SQL}),
    dd as (select {MPN("mpn")} as part, trim(who) as customer, strftime(due, '%Y-%m-%d') as date, upper(uom) as unit, sum(case when q > 0 then q else 0 end) as required, min(source_row) as first_row, min(trim(regexp_replace(mfg, '\\s+', ' ', 'g'))) as maker, count(*) as demand_rows from dr group by 1, 2, 3, 4),
    ss as (select {MPN("mpn")} as part, sum(case when q > 0 then q else 0 end) as supply, list(distinct {CLEAN("mfg")}) filter (mfg is not null) as makers, list(distinct upper(uom)) as units, bool_or(q <= 0) as invalid, bool_or(q < 0) as negative from sr group by 1),
    j as (select dd.*, supply, makers, units, invalid, negative, case when {CLEAN("maker")} is not null and len(makers) > 0 and len(list_filter(makers, lambda m: contains(m, {CLEAN("maker")}) or contains({CLEAN("maker")}, m))) = 0 then 'manufacturer' when unit is not null and len(units) > 0 and not list_contains(units, unit) then 'unit' when required <= 0 then 'quantity' end as review from dd left join ss using (part)),
    e as (select *, case when review is null then required else 0 end as eligible from j),
    b as (select *, greatest(coalesce(supply, 0) - coalesce(sum(eligible) over (partition by part order by date asc nulls last, first_row, customer asc nulls last, unit asc nulls last rows between unbounded preceding and 1 preceding), 0), 0) as before from e),
    r as (select *, least(eligible, before) as allocated from b),
    res as (select part, customer, maker, date, unit, first_row, required, coalesce(supply, 0) as supply, before, allocated, required - allocated as shortage, case when required > 0 then round(100 * allocated / required, 2) end as coverage,
      case when review is not null then 'review_required' when allocated <= 0 then 'sourcing_needed' when allocated >= required then 'full_sale' else 'partial_sale' end as kind,
      case when review = 'manufacturer' then 'review_manufacturer' when review is not null then 'review_quantity' when allocated <= 0 then 'contact_supplier' when allocated >= required then 'offer_full_quantity' else 'offer_available_quantity' end as action,
      supply is not null as exact_part, review is null and before > 0 and required > 0 as usable, review is null and before = required and required > 0 as exact_quantity,
      concat_ws(',', case when review = 'manufacturer' then 'manufacturer_conflict' end, case when review = 'unit' then 'incompatible_unit' end, case when negative then 'negative_available_quantity' end, case when invalid then 'invalid_available_quantity' end,
        case when unit is null or supply is null then 'missing_unit' end, case when len(makers) > 1 then 'multiple_manufacturers' end) as warnings from r)"""
add("x_opportunity_results", lambda s, d: X.match(*sides(s, d)).withColumn("warnings", F.array_join("warnings", ",")), f"{FIND} select * from res")
add("x_summary", lambda s, d: X.summary(X.match(*sides(s, d))), f"{FIND} select count(*) as results, " + ", ".join(f"count(*) filter (kind = '{k}') as {k}" for k in ("full_sale", "partial_sale", "sourcing_needed", "review_required")) + ", sum(allocated) as allocated, sum(shortage) as shortage, count(distinct part) filter (usable) as usable_parts, count(*) filter (exact_quantity) as exact_quantity from res")
add("x_excess", lambda s, d: X.match(*sides(s, d), role="excess").groupBy("kind", "action").agg(F.count("*").alias("n"), F.sum("allocated").alias("allocated")), f"{FIND}, t as (select *, case when kind in ('full_sale', 'partial_sale') then 'excess_resale' else kind end as k, case when kind = 'partial_sale' then 'source_remaining_quantity' else action end as a from res) select k as kind, a as action, count(*) as n, sum(allocated) as allocated from t group by 1, 2")
add("x_history", lambda s, d: X.match(*sides(s, d), role="received_history").groupBy("kind").agg(F.count("*").alias("n"), F.count("allocated").alias("allocated")), f"{FIND} select case when review is null then 'historical_signal' else 'review_required' end as kind, count(*) as n, 0 as allocated from j where supply is not null group by 1")
add("x_supply_only", lambda s, d: X.supply_only(*sides(s, d)), f"{FIND} select part, supply, len(makers) as makers from ss where supply > 0 and part not in (select part from dd)")
add(
    "x_possible_matches",
    lambda s, d: X.possible_matches(*sides(s, d)),
    f"{FIND} select distinct dd.part, ss.part as supply_part, regexp_replace(dd.part, '[^A-Z0-9]', '', 'g') as review from dd join ss on regexp_replace(dd.part, '[^A-Z0-9]', '', 'g') = regexp_replace(ss.part, '[^A-Z0-9]', '', 'g') and dd.part <> ss.part where dd.part not in (select part from ss)",
)

# ---- traffic, alerts, limits

ERR = "coalesce(status_code >= 400 or level in ('error', 'fatal', 'security'), false)"
add("t_per_user", lambda s, d: T.per_user(R.logs(s, d), R.uploads(s, d)), f"select user_id, count(*) as events, count(distinct route) as routes, count(*) filter ({ERR}) as errors, max(created_at) as last_activity, (select count(*) from uploads u where u.uploaded_by = l.user_id) as uploads from logs l where user_id is not null group by user_id", "logs", "uploads")
add("t_per_route", lambda s, d: T.per_route(R.logs(s, d)), f"select route, count(*) as visits, count(distinct user_id) as users, coalesce(cast(floor(avg(duration_ms) filter (duration_ms > 0) + 0.5) as bigint), 0) as mean_ms, count(*) filter ({ERR}) as errors from logs group by route", "logs")
add("t_per_ip", lambda s, d: T.per_ip(R.logs(s, d)), "select ip as address, count(*) as events, min(created_at) as first_seen, max(created_at) as last_seen, count(distinct route) as routes, arg_max_null(user_agent, row(created_at, id)) as agent from logs group by ip", "logs")
for unit in ("hour", "day"):
    add(f"t_{unit}_buckets", lambda s, d, unit=unit: T.buckets(R.logs(s, d), unit), f"select cast(date_trunc('{unit}', created_at) as timestamp) as bucket, count(*) as views, count(distinct coalesce(cast(user_id as varchar), ip)) as visitors from logs where is_page_view group by 1", "logs")
add(
    "t_totals",
    lambda s, d: T.totals(R.logs(s, d)),
    f"""select count(*) as events, count(*) filter (is_page_view) as page_views, count(distinct coalesce(cast(user_id as varchar), ip)) as visitors, count(*) filter ({ERR}) as errors, count(*) filter (status_code between 400 and 499) as client_errors, count(*) filter (status_code >= 500) as server_errors,
    count(*) filter (status_code < 400) as successes, coalesce(round(avg(duration_ms) filter (duration_ms > 0), 2), 0) as mean_ms, count(*) filter (duration_ms > 1500) as slow from logs""",
    "logs",
)
add("t_recent_errors", lambda s, d: T.recent_errors(R.logs(s, d)).select("id", "created_at", "route"), f"select id, created_at, route from logs where {ERR} order by created_at desc, id desc limit 20", "logs")
add("t_error_rollup", lambda s, d: T.error_rollup(R.logs(s, d)), "select level, count(*) as n, count(distinct route) as routes, count(*) filter (duration_ms > 1500) as slow, min(created_at) as first_seen from logs group by level", "logs")
add("t_retention", lambda s, d: T.retained(R.logs(s, d), "2024-01-15", ["purchase"]).groupBy("action").agg(F.count("*").alias("n")), "select action, count(*) as n from logs where created_at >= timestamp '2024-01-15' or action = 'purchase' group by action", "logs")
RULES = "select n_nationkey as rule_id, case n_nationkey % 4 when 0 then 'error' when 1 then 'purchase' when 2 then 'signup' else 'view' end as event_type, n_nationkey % 6 <> 5 as enabled, case n_nationkey % 5 when 0 then null when 1 then 'value_lt' when 2 then 'value_eq' when 3 then 'gp_rate_lt' else 'value_gt' end as condition, cast(case n_nationkey % 5 when 2 then 50 else n_nationkey * 20 end as double) as threshold from nation"
add(
    "e_alerts",
    lambda s, d: T.alerts(table(s, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("action"), F.round("value").alias("value")), R.frame(s, d, RULES).withColumn("recipients", F.when(F.col("rule_id") % 2 == 0, F.array(F.lit("a@x.com"), F.lit("b@x.com"))).otherwise(F.array().cast("array<string>")))),
    f"with r as ({RULES}), h as (select event_id as id, rule_id from events e join r on e.event_type = r.event_type where enabled and (condition is null or (condition = 'value_gt' and round(value) > threshold) or (condition = 'value_lt' and round(value) < threshold) or (condition = 'value_eq' and round(value) = threshold) or (condition = 'gp_rate_lt' and round(value) < case when threshold > 1 then threshold / 100 else threshold end))) select id, rule_id, unnest(case when rule_id % 2 = 0 then ['a@x.com', 'b@x.com'] else ['no-recipient'] end) as recipient from h",
)
REQUESTS = lambda s, d: table(s, d, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"))
add(
    "e_rate_limit",
    lambda s, d: rate.batch_limit(REQUESTS(s, d), 600, 1),
    """with recursive ev as (select user_id as key, event_id as id, cast(ts as timestamp) as ts from events where user_id is not null and ts is not null),
    n as (select key, id, ts, (select min(f.ts) from ev f where f.key = e.key and f.ts >= e.ts + interval 600 seconds) as following from (select key, ts, min(id) as id from ev group by key, ts) e),
    w as (select key, ts, following from n where (key, ts) in (select (key, min(ts)) from ev group by key) union all select n.key, n.ts, n.following from w join n on n.key = w.key and n.ts = w.following),
    p as (select ev.key, ev.id, ev.ts, row_number() over (partition by ev.key, w.ts order by ev.ts, ev.id) as place from ev asof join w on ev.key = w.key and ev.ts >= w.ts)
    select key, id, ts, place <= 1 as allowed from p""",
)

from . import desk  # noqa: E402, F401  (registers its queries too)
