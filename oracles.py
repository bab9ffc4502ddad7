"""DuckDB SQL for the registered queries, written from the rules rather than from the Spark plans."""

from __future__ import annotations

import re

from ledgerbeam.specs import catalogues as C

# ---- the loan book ----------------------------------------------------------------------------------------


def _pick(items: str, key: str) -> str:
    return "[" + ",".join(f"'{i}'" for i in items.split()) + f"][({key} % 7) + 1]"


def _city(k: str) -> str:
    return _pick("Mumbai Pune Jaipur Kochi Hyderabad Patna Surat", k)


def _state(k: str) -> str:
    return _pick("Maharashtra Maharashtra Rajasthan Kerala Telangana Bihar Gujarat", k)


def _pin(k: str) -> str:
    return f"({_pick('400 411 302 682 500 800 395', k)} || lpad(({k} % 1000)::varchar, 3, '0'))"


def _pan(k: str) -> str:
    return (f"('AAA' || substr('CPFTH', ({k} % 5 + 1)::int, 1) || chr((65 + {k} % 26)::int) || lpad(({k} % 10000)::varchar, 4, '0')"
            f" || chr((65 + {k} % 7)::int))")


_BAD = _pick("Maharashtraa Maharashtraa Rajasthaan Keralaa Telanganna Biharr Gujarath", "k")
_PLOT = f"'Plot ' || k || ', Area ' || (k % 97) || ', ' || {_city('k')} || ', ' || {_state('k')} || ' ' || {_pin('k')}"

CUST = f"""cust as (select *, 
  case when k % 41 = 0 and submission_id = 'S3' then c_name || ' | Sons' when k % 43 = 1 then '' else c_name end as borrowerName,
  case when k % 37 = 0 then lower({_pan('k')}) else {_pan('k')} end as pan,
  case c_mktsegment when 'HOUSEHOLD' then 'Proprietorship' when 'FURNITURE' then '2' when 'MACHINERY' then 'Pvt  Ltd' when 'BUILDING' then '40'
    else 'Cooperative Club' end as legalConstitution,
  case when k % 53 = 2 then 'Unit 7, Unknown Place' when k % 6 = 0 then {_PLOT}
    when k % 6 = 1 then 'Plot No-1' || lpad(k::varchar, 6, '0') || ', Area ' || (k % 97) || ', ' || {_city('k')} || ', ' || {_state('k')} || '-' || {_pin('k')}
    when k % 6 = 2 then 'Unit ' || k || ', Area ' || (k % 97) || ', ' || {_city('k')} || ' - ' || {_pin('k')} || '. INDIA'
    when k % 6 = 3 then 'House ' || k || ', Area ' || (k % 97) || ', ' || {_city('k')} || ', ' || {_BAD} || ' ' || {_pin('k')}
    when k % 6 = 4 then 'NA'
    else 'Flat ' || k || ',' || chr(10) || 'Area ' || (k % 97) || ',' || chr(13) || chr(10) || {_city('k')} || ', ' || {_state('k')} || ' India ' || {_pin('k')} end as address,
  case k % 3 when 0 then '9' || lpad(k::varchar, 9, '0') when 1 then '040' || lpad(k::varchar, 8, '0') else '+91 98' || lpad(k::varchar, 8, '0') end as contactNo,
  case when k % 2 = 0 then 'Person ' || k end as relatedName,
  case when k % 2 = 0 then {_pan('(k + 1)')} end as relatedPan,
  case when k % 2 = 0 then {_PLOT} end as relatedAddress
  from (select 'S' || n_regionkey as submission_id, c_custkey as k, c_name, c_mktsegment from customer join nation on c_nationkey = n_nationkey))"""

LOANS = CUST + """, loans as (select cust.*, o_orderkey as row_no, o_orderpriority, o_orderstatus, o_totalprice, o_orderdate::date as d,
  case when o_orderkey % 29 = 0 then 'C' || k else o_orderkey::varchar end as accountNumber,
  case when o_orderkey % 11 = 0 then 'NA' when o_orderkey % 13 = 0 then floor(o_totalprice)::bigint || '.5' else round(o_totalprice * 100)::bigint::varchar end as sanctionedAmount,
  floor(o_totalprice)::bigint::varchar as currentBalance, strftime(o_orderdate, '%d%m%Y') as order_day
  from orders join cust on o_custkey = k)"""

# ---- commercial segment sheets -----------------------------------------------------------------------------

SHEETS = LOANS + f""", bs as (select submission_id, 'B' || k as ac_no, unnest(case when k % 17 = 0 then [k * 2, k * 2 + 1] else [k * 2] end) as row_no, k,
  borrowerName as name, upper(pan) as pan from cust),
asg as (select submission_id, 'B' || k as ac_no, k as row_no, k, case when k % 10 = 3 then '03' when k % 10 = 4 then '' else '01' end as loc,
  {_city('k')} as city, {_pin('k')} as pin, case when k % 21 = 0 then '12' else contactNo end as mobile from cust),
cr as (select submission_id, 'B' || k as ac_no, row_no, k, accountNumber as acct, case when row_no % 47 = 0 then 'soon' else order_day end as sdate,
  case when row_no % 11 = 0 then '' else sanctionedAmount end as amount,
  case row_no % 9 when 0 then 'JPY' when 1 then 'INR' else 'USD' end as cur, case when row_no % 23 = 0 then '' else '0001' end as asset,
  case when row_no % 31 = 0 then '1' else '0' end as wil, case when row_no % 62 = 0 then '01022020' else '' end as wdate from loans),
rec as (select submission_id, ac_no, row_no, k, 1 as flag, 'BS' as tag,
    'BS|||' || name || '||||' || pan || '|||||11|||||||||||||||' as record from bs
  union all select submission_id, ac_no, row_no, k, 2, 'AS', 'AS|' || loc || '||Plot ' || k || '|||' || city || '|||' || pin || '||' || mobile || '||||||' from asg
  union all select submission_id, ac_no, row_no, k, 4, 'CR', 'CR|' || acct || '||' || sdate || '|' || amount || '|' || cur || '|||||||||' || asset || repeat('|', 20) || wil || '|' || wdate || '|' || repeat('|', 8) from cr),
firsts as (select submission_id, ac_no, min(row_no) filter (where tag = 'BS') as first_row from rec group by all)"""

META = """meta as (select 'S' || r_regionkey as submission_id, r_regionkey as r, 'MBR' || lpad(r_regionkey::varchar, 7, '0') as member_id, 'Lender ' || r_name as member_name,
  upper(substr(r_name, 1, 10)) as short_name, date '2026-07-09' + (r_regionkey * 7)::int as reporting, date '2026-08-01' + r_regionkey::int as creation from region)"""

DUPS = """dups as (select * from (select submission_id, ac_no, row_no, acct as account, first_value(row_no) over w as first_row, row_number() over w as rn
  from (select cr.*, first_row as fr from cr join firsts using (submission_id, ac_no)) window w as (partition by submission_id, acct order by fr, row_no)) where rn > 1)"""

_EMPTY = "null::varchar"
ISSUES = SHEETS + ", " + DUPS + f""", issues as (
  select submission_id, 'BS' as tag, ac_no, row_no as row_number, 'borrowerName' as field_key, 'mandatory' as rule, 'error' as severity, {_EMPTY} as value, true as bypassable, 'BS' as sheet from bs where name = ''
  union all select submission_id, 'CR', ac_no, row_no, 'sanctionedAmount', 'mandatory', 'error', null, true, 'CR' from cr where amount = ''
  union all select submission_id, 'CR', ac_no, row_no, 'assetClassification', 'mandatory', 'error', null, true, 'CR' from cr where asset = ''
  union all select submission_id, 'CR', ac_no, row_no, 'sanctionDate', 'date', 'error', sdate, true, 'CR' from cr where not regexp_full_match(sdate, '[0-9]{{8}}')
  union all select submission_id, 'CR', ac_no, row_no, 'currencyCode', 'enum', 'error', cur, true, 'CR' from cr where cur not in ('INR', 'USD', 'EUR', 'GBP')
  union all select submission_id, 'BS', ac_no, row_no, 'borrowerName', 'format', 'error', name, false, 'BS' from bs where contains(name, '|')
  union all select submission_id, 'BS', ac_no, row_no, 'pan', 'format', 'error', pan, true, 'BS' from bs where not regexp_full_match(pan, '[A-Z]{{5}}[0-9]{{4}}[A-Z]')
  union all select submission_id, 'AS', ac_no, row_no, 'mobileNumber', 'format', 'error', mobile, true, 'AS' from asg where not regexp_full_match(replace(replace(mobile, ' ', ''), '-', ''), '[0-9]{{6,15}}')
  union all select submission_id, 'CR', ac_no, row_no, '', 'portal-mandatory', 'error', null, true, 'CR' from cr where wil = '1' and wdate = ''
  union all select submission_id, 'BS', ac_no, min(row_no), 'BS', 'cardinality', 'error', count(*)::varchar, true, 'BS' from bs group by submission_id, ac_no having count(*) <> 1
  union all select asg.submission_id, 'AS', ac_no, first_row, '', 'portal-mandatory', 'error', null, true, 'BS' from asg join firsts using (ac_no) where loc <> '01'
  union all select submission_id, 'CR', ac_no, row_no, 'accountNumber', 'duplicate', 'error', account, true, 'CR' from dups)"""

GATE = ISSUES + ", " + META + """, gated as (select submission_id, coalesce(errors, 0) as errors, 0 as warnings, coalesce(nb, false) as has_non_bypassable, coalesce(errors, 0) = 0 as ok,
  coalesce(errors, 0) = 0 or not nb as passes from meta left join (select submission_id, count(*) as errors, bool_or(not bypassable) as nb from issues group by 1) using (submission_id))"""

_COUNTS = """counts as (select submission_id, count(distinct ac_no) as borrower_count, count(*) filter (where tag = 'CR') as account_count,
  count(*) filter (where tag = 'AS') as address_count, count(*) as segment_count from rec group by 1)"""
_CYCLE = "case when day(x) = day(last_day(x)) then 'ME' when day(x) <= 9 then 'W1' when day(x) <= 16 then 'W2' when day(x) <= 23 then 'W3' else 'ME' end"

FLAGSHIP = "with " + GATE + ", " + _COUNTS + """, out as (
  select submission_id, 0 as band, '' as ac_no, 0 as flag, 0 as row_no, 'HD' as tag, 'HD|' || member_id || '||' || strftime(creation, '%d%m%Y') || '|' || strftime(reporting, '%d%m%Y') || '|01|' as record from meta
  union all select submission_id, 1, ac_no, flag, row_no, tag, record from rec
  union all select submission_id, 2, '', 0, 0, 'TS', 'TS|' || borrower_count || '|' || account_count || '|' from counts)
select out.* exclude (row_no) from out join gated using (submission_id) where passes"""


def _rule(rule: str, base: str = ISSUES) -> str:
    return f"with {base} select submission_id, tag, ac_no, row_number, field_key, severity, value from issues where rule = '{rule}'"


# ---- consumer and microfinance -----------------------------------------------------------------------------

FORM = LOANS + f""", form as (select submission_id, row_no, k,
  case k % 3 when 0 then 'Asha  Rao Devi K' || k when 1 then 'Meera N' || k else 'Lakshmi' || k end as nm,
  case k % 3 when 0 then 'Asha' when 1 then 'Meera' else 'Lakshmi' || k end as n1, case k % 3 when 0 then 'Rao' when 1 then 'N' || k end as n2,
  case k % 3 when 0 then 'Devi K' || k end as n3, case when k % 19 = 0 then '1 Jan 1980' else '05061980' end as dob, (k % 4 + 1)::varchar as gender,
  case when k % 5 > 0 then upper(pan) end as pn, case when k % 3 = 0 then contactNo end as mob, case when k % 7 = 0 then 'u' || k || '@example.org' end as email,
  'Plot ' || k || ' Long Winding Road behind the Old Water Tower in Ward ' || (k % 97) || ' near the Municipal School Building Block ' || (k % 9) as addr,
  {_pin('k')} as pin, case when k % 2 = 0 then '02' end as cat, accountNumber as acct, order_day as opened,
  case when row_no % 11 = 0 then '' when row_no % 13 = 0 then floor(o_totalprice)::bigint || '.5' else sanctionedAmount end as high, currentBalance as bal,
  case row_no % 3 when 0 then '0' when 1 then '250' else '' end as due, case when row_no % 21 > 0 then '00' else '' end as suit,
  case when row_no % 2 = 0 then '02' end as asset, case when row_no % 22 > 0 then '12.5' else '' end as rate from loans)"""


def _tlv(code: str, expr: str) -> str:
    return f"case when coalesce({expr}, '') <> '' then '{code}' || lpad(length({expr})::varchar, 2, '0') || {expr} else '' end"


_CHUNK = "trim(substr(addr, {0}, 40))"
TUDF = "with " + FORM + ", " + META + f""", f as (select form.*, {_CHUNK.format(1)} as a1, {_CHUNK.format(41)} as a2, {_CHUNK.format(81)} as a3, member_id, short_name from form join meta using (submission_id))
select submission_id, row_no, 'PN' as tag, 'PN03N01' || {_tlv('01', 'n1')} || {_tlv('02', 'n2')} || {_tlv('03', 'n3')} || {_tlv('07', 'dob')} || {_tlv('08', 'gender')} as record from f
union all select submission_id, row_no, 'ID', 'ID03I01010201' || {_tlv('02', 'pn')} from f where pn is not null
union all select submission_id, row_no, 'PT', 'PT03T01' || {_tlv('01', 'mob')} || '030201' from f where mob is not null
union all select submission_id, row_no, 'EC', 'EC03C01' || {_tlv('01', 'email')} from f where email is not null
union all select submission_id, row_no, 'PA', 'PA03A01' || {_tlv('01', 'a1')} || {_tlv('02', 'a2')} || {_tlv('03', 'a3')} || '060227' || {_tlv('07', 'pin')} || {_tlv('08', "coalesce(cat, '01')")} from f
union all select submission_id, row_no, 'TL', 'TL04T00' || {_tlv('10', 'member_id')} || {_tlv('02', 'short_name')} || {_tlv('03', 'acct')} || '040205' || '05011' || {_tlv('08', 'opened')}
  || '110831072026' || {_tlv('12', 'high')} || {_tlv('13', 'bal')} || {_tlv('14', "nullif(due, '0')")} || {_tlv('21', 'suit')} || {_tlv('26', "coalesce(asset, '01')")} || {_tlv('38', 'rate')} || '390236' from f
union all select submission_id, row_no, 'ES', 'ES02**' from f"""

_FLAT_REC = ("nm || dob || gender || coalesce(pn, '') || coalesce(mob, '') || addr || '27' || pin || coalesce(cat, '') || {0} || acct || '05' || opened || '31072026' || high || bal || "
             "case row_no % 3 when 0 then '0' when 1 then '250' else '' end || (row_no % 90) || suit || coalesce(asset, '') || case when rate = '' then '' else '12.50' end")
FLAT = "with " + FORM + ", " + META + f""", r as (select submission_id, row_no, {_FLAT_REC.format('member_id')} as rec, row_number() over (partition by submission_id order by row_no) as rn,
  'TUDF' || rpad(member_id, 30, ' ') || rpad(short_name, 16, ' ') || '   ' || strftime(creation, '%d%m%Y') || repeat(' ', 12) || strftime(reporting, '%d%m%Y') || repeat(' ', 74) as head
  from form join meta using (submission_id)) select submission_id, row_no, case when rn = 1 then head || rec else rec end as record from r"""

MFI = LOANS + f""", mrec as (
  select submission_id, 'M' || k as ac_no, k, 1 as flag, k as row_no, 'CNSCRD' as tag, 'CNSCRD|MEM' || k || '|BR1|K' || (k % 12) || '||' || borrowerName || '||||05061980|' || (20 + k % 50) || '|45.5|' ||
    ['F','M','X'][(k % 3) + 1] || '|M01|Key Person|' || case when k % 8 = 0 then 'K99' else 'K02' end || repeat('|', 14) || upper(pan) || repeat('|', 26) as record from cust
  union all select submission_id, 'M' || k, k, 2, k, 'ADRCRD', 'ADRCRD|Plot ' || k || '|MH|' || {_pin('k')} || '|Plot ' || k || '|' || case when k % 9 = 0 then 'ZZ' else 'MH' end || '|' || {_pin('k')} || '||' from cust
  union all select submission_id, 'M' || k, k, 3, row_no, 'ACTCRD', 'ACTCRD|U' || row_no || '|' || accountNumber || '|BR1|K' || (k % 12) || '||31072026|T01|||Farm|S04|||' || strftime(d + interval 288 month, '%d%m%Y')
    || '||||' || currentBalance || '|' || currentBalance || '|' || case when row_no % 3 = 0 then '' else '12' end || '|' || case when row_no % 4 = 0 then '' else 'F03' end || '|500|' || currentBalance || '|0' || repeat('|', 13) from loans)"""

# ---- addresses ---------------------------------------------------------------------------------------------


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


_NEEDLE_ROWS = []
for _i, (_n, _c) in enumerate(C.state_needles()):
    _parts = [p for p in re.split("[^a-z0-9]+", _n) if p]
    _NEEDLE_ROWS.append((_i, _n, _c, r"[\s&.,-]*".join(_parts)))
_FOLDED = r"regexp_replace(trim(address), '[ \t]*[\r\n\t]+[ \t]*', ' ', 'g')"
# The last standalone six-digit run: what follows it holds no further one.
_LAST_PIN = r"nullif(list_last(list_filter(regexp_extract_all({0}, '[0-9]+'), lambda x: length(x) = 6)), null)"
STATES = f"""needles as (select * from (values {_values(_NEEDLE_ROWS)}) t(ord, needle, code, rx)),
names as (select * from (values {_values(C.COMMERCIAL_STATE.items())}) t(code, state_name)),
cities as (select * from (values {_values(C.city_codes().items())}) t(city, code)),
pins as (select * from (values {_values(C.pin_prefix_codes().items())}) t(prefix, code)),
addr as (select k, case when {_FOLDED} = 'NA' then null else {_FOLDED} end as full_text from cust),
hits as (select k, code, length(regexp_extract(l, '(?s)^(.*[^a-z0-9_]|)(' || rx || ')([^a-z].*|)$', 1)) as s,
  length(regexp_extract(l, '(?s)^(.*[^a-z0-9_]|)(' || rx || ')([^a-z].*|)$', 2)) as n from (select k, lower(full_text) as l from addr) a, needles
  where regexp_matches(l, '(?s)^(.*[^a-z0-9_]|)(' || rx || ')([^a-z].*|)$')),
exact as (select k, arg_max(code, (s + n) * 1000 - s) as code, arg_max(s, (s + n) * 1000 - s) as start from hits group by k),
pinned as (select k, {_LAST_PIN.format('full_text')} as pin from addr),
circle as (select k, pin, coalesce(p3.code, p2.code) as circle from pinned left join pins p3 on p3.prefix = substr(pin, 1, 3) left join pins p2 on p2.prefix = substr(pin, 1, 2))"""

FUZZY = STATES + """, words as (select k, full_text, unnest(regexp_extract_all(lower(full_text), '[a-z]+')) as w, generate_subscripts(regexp_extract_all(lower(full_text), '[a-z]+'), 1) as i
  from addr where k not in (select k from exact)),
runs as (select a.k, a.i as lo, a.i + n as hi, case n when 0 then a.w when 1 then a.w || ' ' || b.w else a.w || ' ' || b.w || ' ' || c.w end as run
  from words a cross join (values (0), (1), (2)) t(n) left join words b on b.k = a.k and b.i = a.i + 1 left join words c on c.k = a.k and c.i = a.i + 2
  where n = 0 or (n = 1 and b.w is not null) or (n = 2 and c.w is not null)),
near as (select runs.k, lo, hi, code, needle, ord, run from runs join needles on length(needle) >= 6
  and levenshtein(run, needle) <= case when length(needle) < 9 then 1 else 2 end),
best as (select k, arg_max(code, hi * 1000000 - lo * 1000 - ord) as code, arg_max(run, hi * 1000000 - lo * 1000 - ord) as run from near group by k),
fuzzy as (select best.k, best.code, run, strpos(lower(full_text), run) - 1 as start, substr(full_text, strpos(lower(full_text), run), length(run)) as typed
  from best join circle on circle.k = best.k and circle.circle = best.code join addr on addr.k = best.k)"""

SPLIT = FUZZY + r""", found as (select k, code, start from exact union all select k, code, start from fuzzy),
parts as (select addr.k, full_text, pin, circle, found.code as scode, start,
  regexp_replace(substr(full_text, 1, start::bigint), '[\s,-]+$', '') as before,
  regexp_replace(full_text, '(?i)[.,\s]*india\.?\s*$', '') as tail from addr join circle using (k) left join found using (k)),
p2 as (select *, case when pin is not null then substr(tail, 1, length(tail) - strpos(reverse(tail), reverse(pin)) - 5) end as street from parts),
p3 as (select *, case when start is not null then full_text when street is null then trim(tail) when contains(street, ',')
     then nullif(trim(regexp_replace(regexp_extract(street, '(?s)^(.*),[^,]*$', 1), '[\s,]+$', '')), '') end as line1,
  nullif(trim(case when start is not null then case when contains(before, ',') then regexp_extract(before, '([^,]*)$', 1) else regexp_extract(before, '(\S*)$', 1) end
     else regexp_replace(regexp_replace(regexp_extract(street, '([^,]*)$', 1), '[\s-]*[0-9]{6}\s*$', ''), '[\s,-]+$', '') end), '') as city from p2)
select k, line1, p3.city, coalesce(scode, case when start is null then coalesce(cities.code, circle) end) as state_code, pin from p3 left join cities on cities.city = lower(p3.city)"""

ORACLES: dict[str, str] = {
    "flagship_records": FLAGSHIP,
    "tag_length_value_records": TUDF,
    "flat_consumer_records": FLAT,
    "microfinance_records": f"with {MFI} select submission_id, ac_no, tag, row_no, record from mrec",
    "one_line_blocks": f"with {MFI}, n as (select *, row_number() over (partition by submission_id order by k, flag, row_no) as n from mrec) "
                       "select submission_id, (n - 1) // 100 as block, string_agg(record, '' order by n) as text from n group by all",
    "file_counts": f"with {SHEETS}, {_COUNTS} select * from counts",
    "borrower_tag_counts": f"with {SHEETS} select submission_id, ac_no, tag, count(*) as segments from rec group by all",
    "borrower_order": f"with {SHEETS} select submission_id, ac_no, tag, row_no, first_row as first_seen from rec join firsts using (submission_id, ac_no)",
    "borrower_positions": f"with {SHEETS} select submission_id, ac_no, row_number() over (partition by submission_id order by first_row) as ac_index from firsts",
    "upload_positions": f"with {SHEETS} select submission_id, ac_no, tag, row_no, row_number() over (partition by submission_id order by first_row, flag, row_no) as n "
                        "from rec join firsts using (submission_id, ac_no)",
    "header_trailer": f"with {SHEETS}, {META}, {_COUNTS} select submission_id, 0 as band, 'HD' as tag, 'HD|' || member_id || '||' || strftime(creation, '%d%m%Y') || '|' || strftime(reporting, '%d%m%Y') "
                      f"|| '|' || {_CYCLE.replace('x', 'reporting')} || '|' as record from meta union all select submission_id, 2, 'TS', 'TS|' || borrower_count || '|' || account_count || '|' from counts",
    "fixed_width_headers": f"""with {LOANS}, {META}, n as (select submission_id, count(*) as loans from loans group by 1)
        select submission_id, 'mfi' as layout, 'HDRHMMFI1.9' || rpad(member_id, 10, ' ') || rpad(member_name, 30, ' ') || repeat(' ', 10) || strftime(reporting, '%d%m%Y') || strftime(creation, '%d%m%Y')
          || 'S01' || rpad('pw' || r, 30, ' ') || rpad('INHOUSE', 30, ' ') || rpad('INHOUSE', 30, ' ') || ' ' as record, loans from meta join n using (submission_id)
        union all select submission_id, 'tudf', 'TUDF12' || rpad(member_id, 30, ' ') || rpad(short_name, 16, ' ') || lpad(r::varchar, 2, '0') || strftime(reporting, '%d%m%Y') || rpad('pw' || r, 30, ' ') || 'L00000' || repeat(' ', 48), loans from meta join n using (submission_id)
        union all select submission_id, 'flat', 'TUDF' || rpad(member_id, 30, ' ') || rpad(short_name, 16, ' ') || '   ' || strftime(creation, '%d%m%Y') || repeat(' ', 12) || strftime(reporting, '%d%m%Y') || repeat(' ', 74), loans from meta join n using (submission_id)""",
    "submission_names": f"with {LOANS}, {META}, n as (select submission_id, max(row_no) as last_row from loans group by 1) select submission_id, last_row, member_id || '_Commercial_' || strftime(reporting, '%d%m%Y') || '_' "
                        f"|| strftime(creation, '%d%m%Y') || '_101112_' || {_CYCLE.replace('x', 'reporting')} || '.txt' as file_name, 'submission.CDF' as other_name, member_id || '_issues' as issues_name from meta join n using (submission_id)",
    "gate_decisions": f"with {GATE} select * from gated",
    "run_outcomes": f"with {GATE} select submission_id, errors, warnings, coalesce(f, 0) as failed_rules, case when ok then 'success' when passes then 'bypassed' else 'errors' end as outcome from gated "
                    "left join (select submission_id, count(distinct rule || '/' || field_key || '/' || sheet) as f from issues group by 1) using (submission_id)",
    "record_preview": FLAGSHIP.replace("select out.* exclude (row_no) from out join gated using (submission_id) where passes",
        ", placed as (select out.submission_id, record, row_number() over (partition by out.submission_id order by band, first_row, flag, row_no) as line_no from out join gated using (submission_id) left join firsts using (submission_id, ac_no) where passes) "
        "select submission_id, line_no, case when length(record) > 40 then substr(record, 1, 39) || chr(8230) else record end as line from placed where line_no <= 5"),
    "mandatory_blank": _rule("mandatory"),
    "enum_violations": _rule("enum") + f""" union all select * from (with {LOANS} select submission_id, 'CNSCRD', 'M' || k, k, 'gender', 'error', 'X' from cust where k % 3 = 2
        union all select submission_id, 'CNSCRD', 'M' || k, k, 'keyPersonRelationship', 'error', 'K99' from cust where k % 8 = 0
        union all select submission_id, 'ADRCRD', 'M' || k, k, 'currentState', 'error', 'ZZ' from cust where k % 9 = 0)""",
    "date_violations": _rule("date"),
    "identifier_formats": f"with {ISSUES} select submission_id, tag, ac_no, row_number, field_key, value from issues where rule = 'format' and bypassable",
    "separator_in_values": f"""with {ISSUES} select submission_id, tag, ac_no, row_number, field_key, value, '"' || value || '" has a "|" in it, which ends a field; later fields would move' as message
        from issues where rule = 'format' and not bypassable""",
    "conditional_mandatory": f"""with {LOANS} select submission_id, 'ACTCRD' as tag, 'M' || k as ac_no, row_no as row_number, f as field_key, 'error' as severity, null::varchar as value
        from loans, (values ('numInstallments', 3), ('repaymentFrequency', 4)) t(f, m) where row_no % m = 0 and d + interval 288 month >= date '2022-04-01'""",
    "length_violations": f"with {FORM} select submission_id, 'TL' as tag, 'r' || row_no as ac_no, row_no as row_number, 'accountNumber' as field_key, 'error' as severity, acct || '-' || nm || '-2026' as value from form where length(acct || '-' || nm || '-2026') > 30",
    "blank_form_cells": f"with {FORM} select submission_id, 'TL' as tag, 'r' || row_no as ac_no, row_no as row_number, 'suitFiled' as field_key, 'error' as severity from form where suit = '' "
                        "union all select submission_id, 'TL', 'r' || row_no, row_no, 'rateOfInterest', 'error' from form where rate = ''",
    "cardinality_violations": _rule("cardinality") + f" union all select * from (with {FORM} select submission_id, 'ID', 'r' || row_no, row_no, 'ID', 'error', '0' from form where pn is null)",
    "registered_office_missing": f"""with {SHEETS} select asg.submission_id, ac_no, first_row as row_number, 'The borrower has no address of Location Type 01 (registered office); types given: [' || case when loc = '' then 'blank' else loc end || '].' as message
        from asg join firsts using (ac_no) where loc <> '01'""",
    "wilful_date_missing": f"with {SHEETS} select submission_id, ac_no, row_no as row_number from cr where wil = '1' and wdate = ''",
    "duplicate_accounts": f"with {SHEETS}, {DUPS} select submission_id, ac_no, row_no, account, first_row from dups",
    "own_rules": f"""with {SHEETS},
        yen as (select submission_id, ac_no, count(*) filter (where cur = 'JPY') as yen, count(*) as loans from cr group by all)
        select submission_id, 'CR' as tag, ac_no, row_no as row_number, 'wilfulDefaultDate' as field_key, 'mandatory' as rule, 'error' as severity, null::varchar as value, true as bypassable, null::varchar as message
          from cr where wil = '1' and wdate = ''
        union all select submission_id, 'CR', ac_no, row_no, 'accountNumber', 'yen-account', 'warning', acct, true, 'Account ' || acct || ' is in yen.' from cr where cur = 'JPY' and acct[1] = 'C'
        union all select asg.submission_id, 'AS', ac_no, asg.row_no, '', 'yen-without-phone', 'error', null, true, 'Phone 12 for ' || yen || ' of ' || loans || ' loans.' from asg join yen using (submission_id, ac_no)
          where mobile = '12' and yen > 0
        union all select submission_id, 'CR', ac_no, row_no, 'sanctionDate', 'busy-day', 'error', sdate, false, n || ' loans on one day.' from (select *, count(*) over (partition by submission_id, sdate) as n from cr)
          where n > 2 and cur = 'JPY'
        union all select submission_id, 'CR', '', first_row, '', 'share-of-yen', 'error', null, true, yen || ' of ' || n from (select submission_id, count(*) filter (where cur = 'JPY') as yen, count(*) as n from cr group by 1)
          join (select submission_id, arg_min(row_no, (fr, row_no)) as first_row from cr join (select submission_id, ac_no, first_row as fr from firsts) using (submission_id, ac_no) group by 1) using (submission_id)
          where 100 * yen > 11 * n""",
    "findings_rollup": f"""with {ISSUES} select submission_id, rule, field_key, sheet, min(severity) as severity, count(*) as cells, bool_and(bypassable) as bypassable,
        sheet || case when field_key = '' then '' else ' · ' || field_key end || ' · ' || rule || case when bool_and(bypassable) then '' else ' · not bypassable' end as "where" from issues group by submission_id, rule, field_key, sheet""",
    "issues_by_sheet": f"with {ISSUES} select submission_id, sheet, count(*) as errors, 0 as warnings from issues group by all",
    "repeated_accounts": f"with {LOANS} select submission_id, row_no, accountNumber as value from loans qualify count(*) over (partition by submission_id, accountNumber) > 1",
    "surrounding_blanks": "select doc_id as row_no, 'borrowerName' as field_key, length(text) + 1 as length from documents union all select doc_id, 'address', length(text) from documents "
                          "where regexp_matches(text, '^[\\s\\x{a0}\\x{feff}]|[\\s\\x{a0}\\x{feff}]$')",
    "separator_in_text": "select doc_id, length(text) - length(replace(text, '|', '')) as separators from documents where contains(text, '|')",
    "linebreak_fold": r"select doc_id, md5(f) as folded_md5, length(f) as folded_length from (select doc_id, regexp_replace(text, '[ \t]*[\r\n\t]+[ \t]*', ' ', 'g') as f from documents)",
    "header_normal_forms": "select p_partkey, lower(p_name) || ' / ' || lower(p_type) || ' - x' as header, lower(p_name) || ' / ' || lower(p_type) || '-x' as label, lower(p_name) || ' ' || lower(p_type) || ' - x' as fold from part",
    "legend_lookup": f"""with {LOANS} select row_no, case c_mktsegment when 'HOUSEHOLD' then '30' when 'FURNITURE' then '12' when 'MACHINERY' then '11' when 'BUILDING' then '40' end as constitution,
        case k % 4 when 0 then '03' when 1 then '05' when 2 then '04' end as category, case k % 3 when 0 then '01' else '06' end as industry,
        case o_orderpriority when '1-URGENT' then '01' when '2-HIGH' then '02' when '3-MEDIUM' then '03' when '5-LOW' then '05' end as repayment,
        case when row_no % 23 = 0 then null else ['0001', '0002', '0007', '0012', '0010'][(row_no % 5) + 1] end as asset,
        case o_orderstatus when 'F' then '02' when 'O' then '01' else '04' end as status, case row_no % 6 when 0 then '03' when 1 then '02' end as location,
        case k % 4 when 0 then '51' when 2 then '12' end as relationship from loans""",
    "credit_type_lookup": "select o_orderkey as row_no, case when o_orderkey % 19 = 0 then null else ['0300', '0200', '9003', '9032'][(o_orderkey % 4) + 1] end as credit_code from orders",
    "pan_holder_type": f"""with {CUST} select k, letter as expected, holder from (select k, upper(pan) as p, case c_mktsegment when 'HOUSEHOLD' then 'P' when 'BUILDING' then 'F' when 'AUTOMOBILE' then null else 'C' end as letter,
        case c_mktsegment when 'HOUSEHOLD' then 'individual (proprietor)' when 'BUILDING' then 'firm' else 'company' end as holder from cust) where substr(p, 4, 1) <> letter""",
    "gender_codes": "select c_custkey as k, case c_custkey % 4 when 0 then '01' when 2 then '02' end as code, case c_custkey % 4 when 0 then 'MR' when 2 then 'MS' end as prefix from customer",
    "wilful_codes": "select o_orderkey as row_no, case when o_orderkey % 31 = 0 then '1' else '0' end as code from orders",
    "state_from_text": f"with {CUST}, {STATES} select cust.k, exact.code as state_code from cust left join exact using (k)",
    "state_fuzzy": f"""with {CUST}, {FUZZY} select k, code as state_code, 'State "' || typed || '" in the address looks misspelt; read as ' || state_name || ' (' || code || ').' as note from fuzzy join names using (code)""",
    "pin_extract": f"with {CUST} select k, {_LAST_PIN.format('address')} as pin from cust",
    "pin_circle": f"with {CUST}, {STATES}, e as (select event_id, lpad((event_id * 7919 % 1000000)::varchar, 6, '0') as pin from events) select event_id, pin, coalesce(p3.code, p2.code) as state_code "
                  "from e left join pins p3 on p3.prefix = substr(pin, 1, 3) left join pins p2 on p2.prefix = substr(pin, 1, 2)",
    "pin_state_conflict": f"with {CUST}, {STATES}, e as (select k, (100000 + k * 577 % 750000)::varchar as pin, lpad((k % 38)::varchar, 2, '0') as state from cust) select k, pin, state from e left join pins p3 on p3.prefix = substr(pin, 1, 3) "
                          "left join pins p2 on p2.prefix = substr(pin, 1, 2) where coalesce(p3.code, p2.code) <> state and state in (select code from names) and state not in ('01','06','08','09','18','27','37','77') "
                          "and coalesce(p3.code, p2.code) not in ('01','06','08','09','18','27','37','77')",
    "named_states": "select c_custkey as k, ['11', '25', '07', '36', null, null, '11', '77'][(c_custkey % 8) + 1] as state_code from customer",
    "address_split": f"with {CUST}, {SPLIT}",
    "city_sanity": """select k, unnest(notes) as note from (select c_custkey as k, case c_custkey % 7 when 0 then ['Town "Gujarat" names a state (Gujarat).']
        when 1 then ['Town "Hyderebad": is "HYDEREBAD" meant to be "Hyderabad"?'] when 2 then ['Town "Hitech City Madhapur Hyderabad" seems to hold more than the name of a town.']
        when 4 then ['Town "Sector 5" seems to hold more than the name of a town.'] when 5 then ['Town "Nagpurr": is "NAGPURR" meant to be "Nagpur"?'] else [] end as notes from customer)""",
    "phone_quality": f"""with {CUST} select k, 'Borrower: "' || contactNo || '" begins like a landline and stands in the mobile column.' as note from cust where k % 3 = 1""",
    "date_parse": "select o_orderkey as row_no, case when o_orderkey % 47 = 0 then 'soon' else strftime(o_orderdate, '%d%m%Y') end as ddmmyyyy from orders",
    "serial_date": """with e as (select event_id as i from events) select i as event_id, case i % 3 when 0 then strftime(date '1899-12-30' + (20000 + i % 40000)::int, '%d%m%Y')
        when 2 then strftime(date '1899-12-30' + (30000 + i % 1000)::int, '%d%m%Y')
        else coalesce(strftime(try_strptime(lpad(((1 + i % 31) * 1000000 + (1 + i % 12) * 10000 + 2000 + i % 30)::varchar, 8, '0'), '%d%m%Y'), '%d%m%Y'),
          strftime(date '1899-12-30' + ((1 + i % 31) * 1000000 + (1 + i % 12) * 10000 + 2000 + i % 30)::int, '%d%m%Y')) end as ddmmyyyy from e""",
    "cycle_codes": f"select o_orderkey, cycle, (case cycle when 'W1' then date_trunc('month', x) + interval 8 day when 'W2' then date_trunc('month', x) + interval 15 day when 'W3' then date_trunc('month', x) + interval 22 day else last_day(x) end)::date::varchar as cycle_day "
                   f"from (select o_orderkey, o_orderdate::date as x, {_CYCLE.replace('x', 'o_orderdate')} as cycle from orders)",
    "date_forms": "select o_orderkey, strftime(o_orderdate, '%d%m%Y') as plain, strftime(o_orderdate, '%Y-%m-%d') as iso, strftime(o_orderdate, '%d/%m/%Y') as back from orders",
    "rupee_round": "select o_orderkey, case when o_orderkey % 9 > 1 then floor(round(o_totalprice - 250000, 2)::decimal(18,2) + 0.5)::bigint::varchar end as rupees from orders",
    "number_texts": "select o_orderkey, case o_orderkey % 3 when 0 then o_orderkey::varchar when 1 then o_orderkey || '.25' else o_orderkey || ' kg' end as text from orders",
    "name_split": f"with {FORM} select row_no, n1 as first, n2 as second, n3 as rest from form",
    "address_chunk": f"with {FORM} select row_no, trim(substr(addr, 1, 40)) as line1, nullif(trim(substr(addr, 41, 40)), '') as line2, nullif(trim(substr(addr, 81, 40)), '') as line3 from form",
    "dual_emission": "select o_orderkey as row_no, 0 as seq, '01' as location from orders union all select o_orderkey, 1, case o_orderkey % 6 when 0 then '03' else '02' end from orders where o_orderkey % 6 < 2",
    "facility_fields": f"""with {LOANS} select submission_id, row_no, accountNumber, case when row_no % 47 = 0 then 'soon' else order_day end as sanctionDate,
        case when row_no % 11 = 0 then '' when row_no % 13 = 0 then (floor(o_totalprice)::bigint + 1)::varchar else sanctionedAmount end as sanctionedAmount,
        case when row_no % 19 = 0 then '' else ['0300', '0200', '9003', '9032'][(row_no % 4) + 1] end as creditType,
        case o_orderpriority when '1-URGENT' then '01' when '2-HIGH' then '02' when '3-MEDIUM' then '03' when '5-LOW' then '05' else '' end as repaymentFrequency, '0' as drawingPower, currentBalance,
        case when row_no % 23 = 0 then '' else ['0001', '0002', '0007', '0012', '0010'][(row_no % 5) + 1] end as assetClassification, '0' as amountOverdue,
        case o_orderstatus when 'F' then '02' when 'O' then '01' else '04' end as accountStatus, case when row_no % 31 = 0 then '1' else '0' end as wilfulDefaultStatus,
        case when row_no % 62 = 0 then '01022020' else '' end as wilfulDefaultDate, '00' as suitFiledStatus from loans""",
    "related_person_fields": f"""with {CUST} select k as row_no, '2' as relatedType, case k % 4 when 0 then '51' else '56' end as relationship, case k % 4 when 0 then 'MR' else 'MS' end as namePrefix, relatedName as fullName,
        case k % 4 when 0 then '01' else '02' end as gender, '01011970' as dateOfBirth, relatedPan as rsPan, relatedAddress as rsAddressLine1 from cust where k % 2 = 0""",
    "guarantor_unpivot": """select l_orderkey as row_no, row_number() over (partition by l_orderkey order by l_linenumber) as block, (s % 4 + 1)::varchar as type, s_name as entityName, 'P' || s as pan, 'Shop ' || s as address
        from (select l_orderkey, l_linenumber, max(l_suppkey) as s from lineitem group by all) join supplier on s = s_suppkey""",
    "guarantor_arrays": """with g as (select l_orderkey as row_no, l_linenumber as n, max(l_suppkey) as s from lineitem group by all)
        select row_no, row_number() over (partition by row_no order by n) - 1 as block, case n % 2 when 1 then '2' else '1' end as type,
          case n % 2 when 1 then s_name end as fullName, case n % 2 when 0 then s_name end as entityName from g join supplier on s = s_suppkey""",
    "encode_delimited": f"with {SHEETS} select submission_id, row_no, record from rec where tag = 'BS'",
    "encode_fixed": """with v as (select s_suppkey, 'MF' || s_suppkey as a, s_name as b, 'S01' as c, 'secret' as d, 'INHOUSE' as e from supplier union all select c_custkey, 'C' || c_custkey, c_name || ' and a very long trailing name', 'S02', '', '' from customer)
        select s_suppkey, 'HDRHMMFI1.9' || rpad(a, 10, ' ') || rpad(b, 30, ' ') || repeat(' ', 10) || '3107202605082026' || c || rpad(d, 30, ' ') || rpad(e, 30, ' ') || rpad(e, 30, ' ') || ' ' as record from v""",
    "encode_tlv": f"with {CUST} select k, 'PN03N01' || {_tlv('01', 'borrowerName')} || {_tlv('02', 'relatedName')} || '070805061980' || case when k % 2 = 0 then '08011' else '' end as record from cust",
    "encode_concatenated": "with " + FORM + f" select submission_id, row_no, {_FLAT_REC.format(chr(39) + 'RAW1' + chr(39))} as record from form",
}

# Guarantors of all lines of an order, in block order.
_GTOR = LOANS + f""", gl as (select l_orderkey as row_no, l_linenumber as n, max(l_suppkey) as s from lineitem group by all),
  gt as (select loans.*, s, n, s_name, row_number() over (partition by row_no order by n) - 1 as seq, case when row_no % 3 = 0 then relatedPan end as gpan,
    'Shop ' || s || ', ' || {_city('s')} || ', ' || {_state('s')} || ' ' || {_pin('s')} as gaddr from gl join loans using (row_no) join supplier on s = s_suppkey)"""
ORACLES |= {
    "guarantor_fields": f"""with {_GTOR} select row_no, s_name as gsFullName, case when s % 2 = 0 then '2' else '1' end as gsRelatedType, case when s % 2 = 0 then 'MS' else '' end as gsNamePrefix,
        case when s % 2 = 0 then '02' else '' end as gsGender, case when s % 2 = 0 then '02011970' else '' end as gsDateOfBirth, coalesce(gpan, '') as gsPan, gaddr as gsAddressLine1 from gt""",
    "same_person_conflict": f"""with {_GTOR} select row_no, seq, 'gsAddressLine1' as field_key from gt where gpan is not null
        union all select row_no, seq, 'relatedDob' from gt where gpan is not null and s % 2 = 0""",
}

# ---- reconciliation ----------------------------------------------------------------------------------------

_FILES = """g as (select 'S' || (o_custkey % 5) as submission_id, o_orderkey as ord, 'CR|' || o_orderkey || '|' || round(o_totalprice * 100)::bigint || '|INR' as line from orders),
f as (select submission_id, ord, case when ord % 50 = 0 then substr(line, 1, length(line) - 3) || 'USD' when ord % 77 = 0 then line || '|' else line end as line from g),
gl as (select submission_id, row_number() over w as line_no, coalesce(sum(length(line) + 2) over (w rows between unbounded preceding and 1 preceding), 0)::bigint as off, line from g window w as (partition by submission_id order by ord)),
fl as (select submission_id, row_number() over w as line_no, line from f window w as (partition by submission_id order by ord)),
diff as (select submission_id, line_no, off as "offset", gl.line as expected, fl.line as actual from gl join fl using (submission_id, line_no) where gl.line <> fl.line),
bytes as (select *, unnest(list_filter(range(1, greatest(length(expected), length(actual)) + 1), lambda i: substr(expected, i, 1) <> substr(actual, i, 1))) as col_no from diff)"""
_BYTE_COLS = """submission_id, "offset" + col_no - 1 as "offset", line_no, col_no, nullif(ascii(substr(expected, col_no, 1)), 0) as expected, nullif(ascii(substr(actual, col_no, 1)), 0) as actual,
  substr(expected, greatest(col_no - 24, 1), col_no + 24 - greatest(col_no - 24, 1)) as expected_context, substr(actual, greatest(col_no - 24, 1), col_no + 24 - greatest(col_no - 24, 1)) as actual_context"""
ORACLES |= {
    "compare_lines": f"with {_FILES} select * from diff",
    "compare_bytes": f"with {_FILES} select {_BYTE_COLS} from bytes",
    "first_differences": f"with {_FILES} select submission_id, row_number() over (partition by submission_id order by \"offset\" + col_no) as n, line_no, col_no from bytes qualify n <= 10",
    "comparison_line_ends": """with g as (select 'S' || (o_custkey % 5) as submission_id, o_orderkey as ord, 'CR|' || o_orderkey as line from orders),
        n as (select submission_id, ord, line, row_number() over (partition by submission_id order by ord) as k, count(*) over (partition by submission_id) as c from g),
        shifted as (select submission_id, sum(len(list_filter(range(1, greatest(length(a.line), coalesce(length(b.line), 0)) + 1), lambda i: substr(a.line, i, 1) <> substr(coalesce(b.line, ''), i, 1))) + if(b.line is null, 2, 0)) as d
          from n a left join (select submission_id, k - 1 as k, line from n) b using (submission_id, k) where submission_id = 'S2' group by 1),
        s as (select submission_id, count(*) as c, sum(length(line) + 2)::bigint as bytes, arg_min(length(line), ord) as top from g group by 1)
        select submission_id, submission_id not in ('S0', 'S1', 'S2') as match, bytes as generated_length,
          (bytes - case submission_id when 'S0' then c when 'S1' then 2 when 'S2' then top + 2 else 0 end)::bigint as reference_length,
          least(case submission_id when 'S0' then 2 * c when 'S1' then 2 when 'S2' then d else 0 end, 50)::bigint as diff_count, submission_id not in ('S1', 'S2') as loose_match
        from s left join shifted using (submission_id)""",
    "comparison_summary": f"""with {_FILES}, b as (select submission_id, count(*) as n, min("offset" + col_no - 1) as o, min(line_no) as l, arg_min(col_no, "offset" + col_no) as c from bytes group by 1),
        s as (select submission_id, sum(length(g.line) + 2)::bigint as gl from g group by 1), t as (select submission_id, sum(length(f.line) + 2)::bigint as rl from f group by 1)
        select submission_id, false as match, gl as generated_length, rl as reference_length, least(n, 50)::bigint as diff_count, n > 50 as truncated,
        'Files differ: ' || case when n > 50 then '50+' else n::varchar end || ' byte positions; first at offset ' || o || ' (line ' || l || ', col ' || c || ').' as summary from s join t using (submission_id) join b using (submission_id)""",
}

# ---- sheets ------------------------------------------------------------------------------------------------

_BOOKS = "books as (select 'W' || c_nationkey as submission_id, c_nationkey as n, count(*) as rows from customer group by all)"
ORACLES |= {
    "header_rows": f"with {_BOOKS} select submission_id, 'Data' as sheet, n % 5 + 1 as header_row from books",
    "header_scores": f"with {_BOOKS} select submission_id, 'Data' as sheet, n % 5 + 1 as row_no, 4 as score from books",
    "column_bindings": f"with {_BOOKS} select submission_id, 'Data' as sheet, n % 5 + 1 as header_row, col_no, key from books, lateral (values ('borrowerName', 1), ('accountNumber', 2), ('businessCategory', 4 + n % 3), ('businessIndustryType', 9)) t(key, col_no)",
    "sheet_rows": "select 'W' || c_nationkey as submission_id, c_nationkey % 5 + 2 + c_custkey as row_no, c_name as borrowerName, 'ACC' || c_custkey as accountNumber, c_mktsegment as businessCategory from customer",
    "lineage_cells": f"with {_BOOKS} select submission_id, field, letter from books, lateral (values ('borrowerName', 'A'), ('accountNumber', 'B'), ('businessCategory', chr((68 + n % 3)::int)), ('businessIndustryType', 'I')) t(field, letter)",
}

_MISSING = "(values (0, 'error', 'AS', 'Address Line 1'), (1, 'error', 'CR', 'Facility / Loan Activation / Sanction Date'), (2, 'error', 'CR', 'Sanctioned Amount/ Notional Amount of Contract'), " \
           "(3, 'error', 'CR', 'Asset Classification/Number of days past due NDPD'), (4, 'warning', 'BS', 'businessCategory')) f(k, severity, sheet, field)"
_BOOK_ROWS = "b as (select 'W' || c_nationkey as submission_id, c_nationkey % 5 + 2 + c_custkey as row, c_nationkey % 3 as shift, c_mktsegment as segment, c_custkey as ck, c_name from customer)"
ORACLES |= {
    "workbook_issue_listing": f"""with {_BOOK_ROWS} select submission_id, row_number() over (partition by submission_id order by severity, row, k) as n, severity, sheet, row, case when k = 4 then chr((68 + shift)::int) end as column,
        case when k = 4 then chr((68 + shift)::int) || row else '' end as cell, field, case when k = 4 then 'Business Category: the legend has no entry for "' || segment || '".' else field || ': a value must be given' end as message
        from b, {_MISSING}""",
    "workbook_records": f"""with {_BOOK_ROWS} select submission_id, 1 as band, 'r' || row as ac_no, tag, record from b, lateral (values
          ('BS', 'BS|HO||' || c_name || repeat('|', 24)), ('AS', 'AS|01|||||||||079|||||||'), ('CR', 'CR|ACC' || ck || '||||INR||||0|||||||0||||||||||||||||||0||00||||||||')) t(tag, record)
        union all select submission_id, 0, '', 'HD', 'HD|MBR' || submission_id || '||05082026|31072026|ME|' from b group by 1
        union all select submission_id, 2, '', 'TS', 'TS|' || count(*) || '|' || count(*) || '|' from b group by 1""",
    "stream_read_back": f"select submission_id, tag, record, count(*) as records from ({TUDF}) group by all",
}
