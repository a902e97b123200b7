"""DuckDB twins of the registered queries, written independently of their Spark plans."""

from __future__ import annotations

from casewright import dims

C = r"""c as (
  select o.o_orderkey as complaint_id, cast(o.o_orderdate as date) as date_received, strftime(o.o_orderdate, '%Y-%m') as month, k.c_mktsegment as product, lower(k.c_mktsegment) as segment,
         o.o_orderpriority as issue, 'Company ' || cast(o.o_custkey % 40 as varchar) || case o.o_custkey % 4 when 0 then ', INC.' when 1 then ' LLC' when 2 then ' Corp' else ' Co.' end as company,
         n.n_name as state, lpad(cast(o.o_custkey % 97 as varchar), 3, '0') || 'XX' as zip_code, o.o_orderpriority as submitted_via,
         case o.o_orderstatus when 'F' then 'Closed with non-monetary relief' when 'P' then 'Closed with explanation' else 'In progress' end as company_response,
         case when d.text is null or trim(d.text) = '' then 0 else 1 end as has_narrative, coalesce(d.text, '') as narrative
  from orders o join customer k on o.o_custkey = k.c_custkey join nation n on k.c_nationkey = n.n_nationkey left join documents d on d.doc_id = o.o_orderkey)"""
S = C + r""", w as (select *, trim(regexp_replace(lower(regexp_replace(narrative, '\b[xX]{2,}(?:[/\-\s][xX]{2,})*\b', ' ', 'g')), '[^a-z0-9]+', ' ', 'g')) as norm from c where has_narrative = 1),
s as (select * exclude (narrative), substr(sha1(norm), 1, 16) as hash from w where len(string_split(norm, ' ')) >= 25),
f as (select *, case when count(*) over (partition by hash) >= 2 then 1 else 0 end as templated from s)"""
POP = """pop as (select 'NATION_' || k as state, y as year, cast((k + 1) * 100000 + (y - 1995) * 1000 as bigint) as population from range(24) a(k), range(1995, 2000) b(y)),
latest as (select state, population from pop where year = 1999)"""
AS_OF, CUT = "2001-08", "date '1998-11-30'"
OUT = "('NATION_24', '')"
M = "cast(month || '-01' as date) as month_start"
CNT = "count(*) as complaints, cast(sum(has_narrative) as bigint) as narratives"
SPAN = "count(*) as n, min(date_received) as first_date, max(date_received) as last_date"
NORM_CO = r"trim(regexp_replace(regexp_replace(trim(regexp_replace(replace(regexp_replace(upper(coalesce({c}, '')), '[.,;:''\"()\[\]/\\]+', ' ', 'g'), '&', ' AND '), '\s+', ' ', 'g')), '^THE ', ''), '( (" + "|".join(sorted(dims.LEGAL_FORMS, key=lambda s: (-len(s), s))) + r"))+$', ''))"
KEY = NORM_CO.replace("{c}", "company")


def _values(rows) -> str:
    return "(values " + ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in r) + ")" for r in rows) + ")"


def q(ctes: str, body: str) -> str:
    return f"with {ctes}\n{body}"


def rr(*cols: str, d: int = 6) -> str:
    return ", ".join(f'round(cast({c} as double), {d}) as {c}' for c in cols)


FILLED = "cnt as (select {e} as entity, cast(month || '-01' as date) as m, count(*) as n from c where month < '" + AS_OF + "' group by all), span as (select entity, min(m) as lo, max(m) as hi from cnt group by 1), spine as (select entity, cast(unnest(generate_series(lo, hi, interval 1 month)) as date) as m from span), filled as (select entity, m as month_start, coalesce(n, 0) as complaints from spine left join cnt using (entity, m))"
ZED = """z1 as (select *, count(*) over t as k, median(complaints) over t as med, stddev_samp(complaints) over t as sd from filled window t as (partition by entity order by month_start rows between 12 preceding and 1 preceding)),
z2 as (select *, case when k >= 6 then med end as baseline, case when k >= 6 then abs(complaints - med) end as r from z1),
z3 as (select *, case when count(r) over t >= 6 then median(r) over t * 1.4826 end as mad from z2 window t as (partition by entity order by month_start rows between 12 preceding and 1 preceding)),
z4 as (select *, case when mad > 0 then mad else nullif(case when k >= 6 then sd end, 0) end as scale from z3),
z as (select *, (complaints - baseline) / scale as z from z4)"""
BURST = C + ", " + FILLED.replace("{e}", KEY) + ", " + ZED + ", hits as (select *, case when baseline > 0 then round(complaints / baseline, 2) end as multiple from z where z >= 2.5 and complaints >= 5 and entity in (select entity from cnt group by 1 having max(n) >= 5))"
EVENTS = "ev as (select a as entity, cast(b as date) as event_date, c as description from " + _values([("COMPANY 1", "1996-03-10", "first event"), ("COMPANY 5", "1997-06-20", "second event"), ("COMPANY 9", "1998-02-01", "third event"), ("COMPANY 13", "1999-05-05", "fourth event"), ("COMPANY 30", "1996-09-09", "fifth event")]) + " t(a, b, c))"
EXPLAINED = EVENTS + ", x as (select h.entity, h.month_start, h.z, event_date, description, abs(date_diff('day', event_date, h.month_start + 14)) as gap from hits h left join ev on ev.entity = h.entity and abs(date_diff('day', event_date, h.month_start + 14)) <= 120), best as (select * from x qualify row_number() over (partition by entity, month_start order by gap nulls last, event_date, description) = 1)"
RATES = C + ", " + POP + f", cy as (select state, year(date_received) as year, count(*) as complaints from c where state not in {OUT} group by all), rates as (select cy.state, cy.year, complaints, coalesce(p.population, l.population) as population, p.population is null as carried_forward, complaints / coalesce(p.population, l.population) * 100000 as rate_per_100k from cy left join pop p on p.state = cy.state and p.year = cy.year join latest l on l.state = cy.state)"
MIX = C + ", mc as (select {p} as period, submitted_via as channel, count(*) as n from c group by all), mix as (select *, cast(sum(n) over (partition by period) as bigint) as total, n / sum(n) over (partition by period) as share from mc)"
SPLIT = S + ", " + POP + f", sp as (select state, cast(sum(templated) as bigint) as templated, cast(sum(1 - templated) as bigint) as organic from f where segment = 'automobile' and month like '1996-%' and state not in {OUT} group by 1 having count(*) >= 1), split as (select sp.*, templated / population * 100000 as templated_per_100k, organic / population * 100000 as organic_per_100k from sp join latest using (state))"
CLOSED = S + ", cl as (select * from f where month like '1996-%' and company_response not in ('In progress', ''))"
RVT = S + ", " + POP + f", tot as (select state, count(*) as complaints from c where segment = 'automobile' and month like '1996-%' and state not in {OUT} group by 1), sh as (select state, count(*) as narratives, sum(templated) as t from f where segment = 'automobile' group by 1 having count(*) >= 2), rvt as (select tot.state, complaints, round(complaints / population * 100000, 1) as rate_per_100k, narratives, round(100 * t / narratives, 1) as templated_pct from tot join latest using (state) join sh using (state))"
RELIEF_PCT = ", ".join(f"round(100 * count(*) filter (company_response in {r}) / count(*), {d}) as {n}" for n, r, d in (("relief_pct", "('Closed with monetary relief', 'Closed with non-monetary relief')", 2), ("monetary_pct", "('Closed with monetary relief')", 3), ("nonmonetary_pct", "('Closed with non-monetary relief')", 2), ("explanation_pct", "('Closed with explanation')", 2)))
I = S + f", k as (select *, {KEY} as co from s), kc as (select *, {KEY} as co from c)"
T_STATE = "select hash, state, month, count(*) as n from k group by all union all select 'ALLNARRS', state, month, count(*) from k group by all"
T_COMP = "select hash, co as company, month, count(*) as n from k group by all union all select 'ALLNARRS', co, month, count(*) from k group by all"
T_RELIEF = "select segment, month, hash, case when company_response like '%relief' then 1 else 0 end as relieved, count(*) as n from k where company_response not in ('In progress', '') group by all"
IDX = {
    "text_month": "select hash, month, count(*) as n from k group by all",
    "text_state_month": T_STATE,
    "text_company_month": T_COMP,
    "monthly": f"select segment, month, {CNT} from c group by all",
    "company_month": f"select co as company, segment, month, {CNT} from kc group by all",
    "state_month": f"select state, month, {CNT} from c group by all",
    "relief_month": T_RELIEF,
}
MONTHS = f"mo as (select distinct month from c where month < '{AS_OF}')"
T2 = "tm as (select hash from s group by 1 having count(*) >= 2)"
EMIT = I + ", " + MONTHS + ", " + T2 + ", " + POP
M12 = "(select month from mo order by month desc limit 12)"
E_TREND = "trend as (select month, count(*) as narratives, count(*) filter (hash in (select hash from tm)) as templated, round(100 * count(*) filter (hash in (select hash from tm)) / count(*), 2) as pct from s where month < '" + AS_OF + "' group by 1 having count(*) >= 5)"
E_VOL = "sg as (select segment, row_number() over (order by count(*) desc, segment) as rank from c group by 1), vol as (select sg.segment, mo.month, sg.rank, count(c.month) as complaints from sg cross join mo left join c on c.segment = sg.segment and c.month = mo.month group by all)"
E_STATES = f"st as (select state, count(*) as complaints from c where month in {M12} and state not in {OUT} group by 1), sc as (select state, count(*) as scored, count(*) filter (hash in (select hash from tm)) as t from s where month in {M12} group by 1), states as (select st.state, complaints, round(complaints / population * 100000, 1) as per_100k, case when scored >= 5 then round(100 * t / scored, 1) end as templated_pct from st join latest using (state) left join sc using (state))"
E_COMP = f"cc as (select co as company, {CNT} from kc where month in {M12} group by 1 order by complaints desc, company limit 20), csh as (select co as company, count(*) as scored, count(*) filter (hash in (select hash from tm)) as t from k where month in {M12} group by 1), comps as (select cc.*, case when scored >= 5 then round(100 * t / scored, 1) end as templated_pct from cc left join csh using (company) where company <> '')"
E_HEAD = "head as (select (select count(*) from c) as complaints, (select cast(sum(has_narrative) as bigint) from c) as narratives, count(*) as scored_narratives, count(*) filter (hash in (select hash from tm)) as templated, (select count(*) from tm) as distinct_templates, round(100 * count(*) filter (hash in (select hash from tm)) / count(*), 2) as templated_pct from s)"
LABELS = [(x, s) for s, xs in dims.SEGMENTS.items() for x in xs]
NORM_D = "d as (select doc_id, trim(regexp_replace(lower(regexp_replace(coalesce(text, ''), '\\b[xX]{2,}(?:[/\\-\\s][xX]{2,})*\\b', ' ', 'g')), '[^a-z0-9]+', ' ', 'g')) as norm from documents), e as (select doc_id, case when norm = '' then [] else string_split(norm, ' ') end as t, norm from d)"
WINDOW = "time_bucket(interval '{w}', ts, timestamp '1970-01-01')"

ORACLE = {
    "templated_share_by_month": q(S, "select segment, month, count(*) as narratives, cast(sum(templated) as bigint) as templated, round(100 * sum(templated) / count(*), 2) as pct from f group by all"),
    "templated_share_by_state": q(S, "select segment, state, count(*) as narratives, cast(sum(templated) as bigint) as templated, round(100 * sum(templated) / count(*), 2) as pct from f group by all"),
    "templated_share_combined": q(S, "select month, count(*) as narratives, cast(sum(templated) as bigint) as templated, case when count(*) >= 10 then round(100 * sum(templated) / count(*), 2) end as pct from f group by all"),
    "templating_headline": q(S, "select cast(sum(n) as bigint) as scored, count(*) as distinct_texts, count(*) filter (n >= 2) as templates, cast(coalesce(sum(n) filter (n >= 2), 0) as bigint) as complaints_in_templates, cast(coalesce(sum(n) filter (n >= 2), 0) as bigint) as exact_dup_any, cast(0 as bigint) as dup_outside_templates from (select hash, count(*) as n from s group by 1)"),
    "template_set": q(S, "select hash, count(*) as n from s group by 1 having count(*) >= 2"),
    "exact_duplicate_groups": q(S, "select hash, count(*) as size, count(distinct company) as companies, count(distinct state) as states, min(date_received) as first_date, max(date_received) as last_date, min(complaint_id) as first_id, array_to_string(list_sort(list(complaint_id))[1:50], ',') as ids from s group by 1 having count(*) >= 2"),
    "template_lifespan": q(S, "select band, coalesce(count(p.hash), 0) as templates, cast(coalesce(sum(n), 0) as bigint) as complaints, coalesce(list_sort(list(firms) filter (p.hash is not null))[cast(floor(count(p.hash) / 2) as bigint) + 1], 0) as median_firms from (values (0, 90, 'under 3 months'), (90, 365, '3-12 months'), (365, 730, '1-2 years'), (730, 100000, 'over 2 years')) b(lo, hi, band) left join (select hash, date_diff('day', min(date_received), max(date_received)) as days, count(*) as n, count(distinct company) as firms from f where templated = 1 group by 1) p on p.days >= b.lo and p.days < b.hi group by band"),
    "template_long_lived": q(S, "select cast(coalesce(sum(n), 0) as bigint) as long_lived_complaints from (select count(*) as n, date_diff('day', min(date_received), max(date_received)) as days from f where templated = 1 group by hash) where days >= 365"),
    "dow_profile": q(S, "select templated, cast(isodow(date_received) - 1 as integer) as weekday, count(*) as n, round(100 * count(*) / sum(count(*)) over (partition by templated), 2) as pct, round(100 * sum(case when isodow(date_received) >= 6 then count(*) else 0 end) over (partition by templated) / sum(count(*)) over (partition by templated), 2) as weekend_pct from f where segment = 'automobile' group by templated, isodow(date_received)"),
    "monthly_counts": q(C, f"select month, {CNT}, {M} from c where month < '{AS_OF}' group by month"),
    "monthly_by_channel": q(C, f"select month, submitted_via, {CNT}, {M} from c where month < '{AS_OF}' group by month, submitted_via"),
    "daily_counts": q(C, f"select date_received, {CNT} from c where segment = 'automobile' and date_received between date '1996-01-01' and date '1997-12-31' group by 1"),
    "gap_filled_series": q(C.replace("on d.doc_id = o.o_orderkey)", "on d.doc_id = o.o_orderkey where o.o_orderkey % 3 = 0)") + ", " + FILLED.replace("{e}", "company"), "select entity as company, month_start, complaints from filled"),
    "gap_filled_companies": q(C + ", " + FILLED.replace("{e}", "company"), "select entity as company, month_start, complaints from filled"),
    "segment_and_all": q(C, f"select segment, month, {CNT} from c where segment in ('automobile', 'building') group by all union all select 'ALL_SELECTED', month, {CNT} from c where segment in ('automobile', 'building') group by month"),
    "coverage": q(C, f"select {SPAN}, cast(sum(has_narrative) as bigint) as narratives, count(distinct company) as companies, count(distinct state) as states from c"),
    "segment_counts": q(C, f"select segment, {SPAN} from c group by 1"),
    "narrative_coverage": q(C, f"select month, {CNT}, round(100 * sum(has_narrative) / count(*), 2) as coverage_pct from c where month >= '1996-01' group by 1"),
    "label_windows": q(C, f"select product, segment, {SPAN} from c group by all"),
    "thin_months": q(C, "select count(*) as thin_months, cast(sum(n - h) as bigint) as hidden, min(month) as first_month, max(month) as last_month from (select month, count(*) as n, sum(has_narrative) as h from c group by 1) where 100 * h < 5 * n"),
    "size_estimate": q(C, f"select product, {CNT}, cast(sum(has_narrative) * 2000 + (count(*) - sum(has_narrative)) * 250 as bigint) as bytes from c group by 1"),
    "company_normalize": q(C, f"select distinct company, {KEY} as key from c"),
    "company_group_counts": q(C, f"select {KEY} as company_group, {CNT} from c group by 1"),
    "segment_crosswalk": f"with l as (select * from {_values(LABELS)} t(label, segment)), p as (select label as product from l union all select unnest([' Mortgage ', 'MORTGAGE', 'Widgets', '', null, '   '])) select product, case when product is null or product = '' then 'unmapped:<blank>' else coalesce(segment, 'unmapped:' || trim(product)) end as segment from p left join l on lower(l.label) = lower(trim(product))",
    "unmapped_labels": q(C, f"select distinct product from c where lower(product) not in (select lower(label) from {_values(LABELS)} t(label, segment))"),
    "display_names": "select * from (values ('CNG OF THE WEST', 'CNG of the West'), ('BANK OF AMERICA', 'Bank of America'), ('TransUnion', 'TransUnion'), ('THE LDF', 'The Ldf'), ('A AND B', 'A and B'), ('', '')) t(company, shown)",
    "robust_z_trailing": q(C + ", " + FILLED.replace("{e}", "segment") + ", " + ZED, f"select entity as segment, month_start, complaints, {rr('baseline', 'scale', 'z')} from z"),
    "segment_bursts": q(C + ", " + FILLED.replace("{e}", "segment") + ", " + ZED, f"select entity as segment, month_start, complaints, {rr('baseline', 'scale', 'z')}, round(case when baseline > 0 then round(complaints / baseline, 2) end, 6) as multiple from z where z >= 2"),
    "company_bursts": q(BURST, f"select entity, month_start, complaints, {rr('baseline', 'scale', 'z', 'multiple')} from hits"),
    "burst_event_join": q(BURST + ", " + EXPLAINED, f"select entity, month_start, {rr('z')}, event_date, description, cast(gap as integer) as gap from best"),
    "bursts_explained": q(BURST + ", " + EXPLAINED, "select count(*) as bursts, count(*) filter (coalesce(description, '') <> '') as explained from best"),
    "new_entrants": q(C, "select company, month as first_month, a as first_month_complaints, cast(total as bigint) as total from (select company, month, count(*) filter (segment in ('automobile', 'building', 'machinery')) as a, min(month) over (partition by company) as fm, sum(count(*)) over (partition by company) as total from c where company <> '' group by company, month) where month = fm and a >= 3"),
    "company_lockstep": q(C, f"select company, min_by(n, month) as first_n, max_by(n, month) as last_n, round(max_by(n, month) / min_by(n, month), 6) as ratio from (select company, month, count(*) as n from c where month between '2000-07' and '2001-06' group by all) group by 1"),
    "channel_mix": q(MIX.replace("{p}", "month"), f"select period, channel, n, total, {rr('share')} from mix"),
    "channel_mix_year": q(MIX.replace("{p}", "substr(month, 1, 4)"), f"select period, channel, n, total, {rr('share')} from mix"),
    "channel_pivot": q(MIX.replace("{p}", "month"), "select period, max(total) as total, " + ", ".join(f"coalesce(max(n) filter (channel = '{ch}'), 0) as \"{ch}\", round(coalesce(max(share) filter (channel = '{ch}'), 0), 6) as \"{ch}_share\"" for ch in ("1-URGENT", "2-HIGH")) + " from mix group by 1"),
    "channel_shift": q(MIX.replace("{p}", "month") + f", sd as (select *, case when a >= cast({CUT} - interval 18 month as date) and a < {CUT} then 'pre' when a >= {CUT} and a <= cast({CUT} + interval 18 month as date) then 'post' end as side from (select *, cast(period || '-01' as date) as a from mix)), ln as (select count(distinct period) filter (side = 'pre') as p, count(distinct period) filter (side = 'post') as q from sd), ag as (select channel, coalesce(sum(share) filter (side = 'pre'), 0) / any_value(p) as ps, coalesce(sum(share) filter (side = 'post'), 0) / any_value(q) as qs, cast(coalesce(sum(n) filter (side = 'pre'), 0) as bigint) as pn, cast(coalesce(sum(n) filter (side = 'post'), 0) as bigint) as qn from sd, ln group by 1)", "select channel, round(ps, 5) as pre_share, round(qs, 5) as post_share, round((qs - ps) * 100, 3) as share_change_pp, pn as pre_complaints, qn as post_complaints, case when pn > 0 then round((qn / pn - 1) * 100, 1) end as pct_volume_change from ag"),
    "state_year_rates": q(RATES, f"select state, cast(year as integer) as year, complaints, population, carried_forward, {rr('rate_per_100k')} from rates"),
    "excluded_states": q(C, f"select count(*) filter (state in {OUT}) as excluded from c"),
    "rate_anomalies": q(RATES + ", a1 as (select *, median(rate_per_100k) over (partition by year) as med, stddev_samp(rate_per_100k) over (partition by year) as sd from rates where year >= 1996), a2 as (select *, median(abs(rate_per_100k - med)) over (partition by year) as mad from a1)", f"select state, cast(year as integer) as year, complaints, population, carried_forward, {rr('rate_per_100k')}, round(med, 6) as median, round((rate_per_100k - med) / case when mad > 0 then mad * 1.4826 else nullif(sd, 0) end, 6) as robust_z, round(rate_per_100k / nullif(med, 0), 6) as ratio_to_median from a2"),
    "state_rate_changes": q(
        C + ", " + POP + f", sides as (select *, case when date_received < {CUT} then 'pre' else 'post' end as side from c where date_received >= date '1996-11-30' and date_received <= date '2000-11-30' and state not in {OUT}), cy as (select state, side, year(date_received) as year, count(*) as n from sides group by all), rt as (select cy.state, side, n / coalesce(p.population, l.population) * 100000 as r from cy left join pop p on p.state = cy.state and p.year = cy.year join latest l on l.state = cy.state), pv as (select state, avg(r) filter (side = 'pre') as pre_rate, avg(r) filter (side = 'post') as post_rate from rt group by 1), ok as (select *, (post_rate / pre_rate - 1) * 100 as pct_change, (sum(post_rate) over () / sum(pre_rate) over () - 1) * 100 as national_pct_change from pv where pre_rate is not null and post_rate is not null)",
        f"select state, {rr('pre_rate', 'post_rate', 'pct_change', 'national_pct_change')}, round(pct_change - national_pct_change, 6) as excess_pp from ok",
    ),
    "zip_concentration": q(C + f", zs as (select state, substr(zip_code, 1, 3) as zip3, count(*) as n from c where state not in {OUT} group by all), zt as (select *, sum(n) over (partition by state) as t from zs)", "select state, cast(sum(n) as bigint) as complaints, count(*) as zip3_count, round(sum(n * n) / (sum(n) * sum(n)), 4) as hhi, min_by(zip3, struct_pack(a := -n, b := zip3)) as top_zip3, round(max(n) / sum(n), 4) as top_share from zt group by 1 having sum(n) >= 50"),
    "rate_vs_templating": q(RVT, "select * from rvt"),
    "rate_templating_corr": q(RVT, "select count(*) as n, case when count(*) > 2 then round(covar_pop(rate_per_100k, templated_pct) / nullif(stddev_pop(rate_per_100k) * stddev_pop(templated_pct), 0), 6) end as r from rvt"),
    "issue_topk": q(C, "select cast(y as integer) as grp, issue, n from (select year(date_received) as y, issue, count(*) as n from c group by all) qualify row_number() over (partition by y order by n desc, issue) <= 3"),
    "channel_by_year": q(C, "select cast(year(date_received) as integer) as year, submitted_via, count(*) as n from c group by all"),
    "rate_ratio": q(SPLIT, f"select state, templated, organic, {rr('templated_per_100k', 'organic_per_100k')}, round(templated_per_100k / greatest(organic_per_100k, 0.01), 6) as ratio from split"),
    "against_others": q(C, "select month, m as complaints, o as others, round(case when m > 0 then log10(m) end, 6) as log_complaints, round(case when o > 0 then log10(o) end, 6) as log_others from (select month, count(*) filter (segment = 'automobile') as m, count(*) filter (segment <> 'automobile') as o from c where month >= '1995-01' group by 1) where m > 0"),
    "display_formats": q(C, "select month, strftime(cast(month || '-01' as date), '%B %Y') as label, format('{:,}', count(*)) as cases, printf('%.2f%%', 100.0::double * sum(has_narrative) / count(*)) as coverage from c group by month"),
    "escaped_texts": "select doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;') as shown from documents",
    "coverage_ends": q(C + ", m as (select month, count(*) as complaints from c group by 1)", "select month, complaints from m qualify row_number() over (order by month) <= 7 or row_number() over (order by month desc) <= 4"),
    "top_templates": q(S + ", t as (select hash, count(*) as size, min(complaint_id) as complaint_id from s group by 1 order by size desc, complaint_id limit 12)", "select hash, size, complaint_id, c.issue, substr(trim(regexp_replace(narrative, '\\s+', ' ', 'g')), 1, 300) as exemplar from t join c using (complaint_id)"),
    "idx_backfill_companies": q(I + f", tc as ({T_COMP}), big as (select co as company from kc group by 1 order by count(*) desc, company limit 10)", "select hash, company, month, n from tc where company in (select company from big)"),
    "idx_merge": q(I, f"select co as company, segment, month, {CNT} from kc group by all"),
    "extraction_resumed": q(C, "select month, has_narrative, count(*) as n, count(distinct complaint_id) as ids from c where date_received between date '1992-01-01' and date '2001-12-31' group by all"),
    "geo_split": q(SPLIT, f"select state, templated, organic, {rr('templated_per_100k', 'organic_per_100k')} from split"),
    "geo_split_stats": q(SPLIT, "select count(*) as states, " + ", ".join(f"round(max({c}_per_100k) / greatest(min({c}_per_100k), 1e-9), 5) as {c}_max_min, round(stddev_pop({c}_per_100k) / nullif(avg({c}_per_100k), 0), 5) as {c}_cv" for c in ("templated", "organic")) + ", round(covar_pop(templated_per_100k, organic_per_100k) / nullif(stddev_pop(templated_per_100k) * stddev_pop(organic_per_100k), 0), 5) as r from split"),
    "relief_mix": q(CLOSED, f"select segment, templated, count(*) as n, {RELIEF_PCT} from cl group by all"),
    "relief_breakdown": q(CLOSED, "select segment, templated, company_response, count(*) as n from cl group by all"),
    "relief_factor": q(CLOSED + f", rm as (select segment, templated, {RELIEF_PCT} from cl group by all)", "select a.segment, a.relief_pct as templated_pct, b.relief_pct as organic_pct, round(b.relief_pct / greatest(a.relief_pct, 0.01), 6) as factor from rm a join rm b on a.segment = b.segment and a.templated = 1 and b.templated = 0"),
    "respondent_monthly_ilike": q(C, "select month, count(*) as n from c where company ilike '%company 1,%' or company ilike '%company 2 %' group by 1 having count(*) > 3"),
    "product_issue_topk": q(C, "select product, issue, count(*) as n from c where company ilike '%company 1%' and month like '1997-%' group by all order by n desc, product, issue limit 6"),
    "respondent_samples": q(C, "select complaint_id, date_received, state, issue, substr(narrative, 1, 320) as txt from c where company ilike '%company 1%' and has_narrative = 1 and month like '1997-1%' order by complaint_id limit 3"),
    "tail_daily": q(C, "select date_received, count(*) as n, cast(sum(has_narrative) as bigint) as narr from c where date_received >= date '2001-07-01' group by 1"),
    "nearest_event": q(C + ", ev as (select * from (values (0, 'first', date '1998-11-30'), (1, 'second', date '1999-03-14'), (2, 'third', date '1999-01-31')) t(ord, name, event_date)), dd as (select distinct date_received from c)", "select date_received, arg_min(name, struct_pack(g := abs(date_diff('day', event_date, date_received)), o := ord)) as nearest_event, cast(min(abs(date_diff('day', event_date, date_received))) as integer) as nearest_gap from dd, ev group by 1"),
    "competing_events": q(C + ", ev as (select a as segment, cast(b as date) as event_date, c as description from " + _values([("automobile", "1998-10-01", "tariff"), ("automobile", "1997-01-01", "too early"), ("building", "1999-03-01", "permit rule"), ("machinery", "1998-12-01", "strike")]) + " t(a, b, c))", f"select segment, event_date, description, cast(abs(date_diff('day', event_date, {CUT})) as integer) as gap from ev where segment in (select segment from c) and abs(date_diff('day', event_date, {CUT})) <= 180"),
    **{f"idx_{n}": q(I, body) for n, body in IDX.items()},
    "idx_refresh_equals_rebuild": q(I, IDX["company_month"]),
    "idx_prune": q(
        I + f", rare as (select hash from s group by 1 having count(*) < 2), top as (select co from kc group by 1 order by count(*) desc, co limit 10), a as ({T_STATE}), b as ({T_COMP}), r as ({T_RELIEF}), rf as (select segment, month, case when hash in (select hash from rare) then '' else hash end as h, relieved, sum(n) as n from r group by all)",
        "select month, count(*) as rows, cast(sum(n) as bigint) as n, 'text_state_month' as tbl from a where hash not in (select hash from rare) group by month union all select month, count(*), cast(sum(n) as bigint), 'text_company_month' from b where hash not in (select hash from rare) and company in (select co from top) group by month union all select month, count(*), cast(sum(n) as bigint), 'relief_month' from rf group by month",
    ),
    "idx_stats": q(I, " union all ".join(f"select '{n}' as \"table\", count(*) as rows from ({body})" for n, body in IDX.items())),
    "emit_headline": q(EMIT + ", " + E_HEAD, "select * from head"),
    "emit_trend": q(EMIT + ", " + E_TREND, "select * from trend"),
    "emit_volume": q(EMIT + ", " + E_VOL, "select segment, month, cast(rank as integer) as rank, complaints from vol"),
    "emit_states": q(EMIT + ", " + E_STATES, "select * from states"),
    "emit_companies": q(EMIT + ", " + E_COMP, "select * from comps"),
    "emit_relief": q(EMIT + ", rel as (select segment, hash in (select hash from tm) as t, case when company_response like '%relief' then 1 else 0 end as ok from s where company_response not in ('In progress', '') and month in (select month from mo order by month desc limit 24))", "select segment, count(*) filter (t) as t_closed, round(100 * count(*) filter (t and ok = 1) / count(*) filter (t), 1) as t_relief_pct, count(*) filter (not t) as o_closed, round(100 * count(*) filter (not t and ok = 1) / count(*) filter (not t), 1) as o_relief_pct from rel group by 1 having count(*) filter (t) >= 3 and count(*) filter (not t) >= 3"),
    "payload_checks": q(
        EMIT + ", " + ", ".join((E_HEAD, E_TREND, E_VOL, E_STATES, E_COMP)),
        "select 'complaints' as \"check\", (select complaints >= 10000 from head) as ok union all select 'templated_pct', (select templated_pct between 1 and 70 from head) union all select 'trend_points', (select count(*) >= 60 from trend) union all select 'states', (select count(*) >= 20 from states) union all select 'companies', (select count(*) >= 8 from comps) union all select 'fresh', date_diff('day', date '2001-08-01', date '2001-08-15') <= 75 union all select 'tail_not_zero', (select coalesce(max(pct), 1) > 0 from (select pct from trend order by month desc limit 3)) union all select 'volume', (select coalesce(sum(complaints), 0) >= 5000 from vol)",
    ),
    "upsert_latest": q(C + ", u as (select complaint_id, case when complaint_id % 10 = 0 then 'changed' else company end as company, case when complaint_id % 10 = 0 and complaint_id % 20 <> 0 then 'new text' else narrative end as narrative from c)", "select complaint_id, company, case when narrative <> '' then 1 else 0 end as has_narrative, md5(narrative) as narrative_md5 from u"),
    "population_unpivot": "select n_name as state, cast(y as integer) as year, cast(case when y = 2020 and n_nationkey < 5 then 77 else n_nationkey * 1000 + y end as bigint) as population from nation, (values (2019), (2020)) t(y)",
    "sextile_buckets": q(RATES + ", v as (select state, rate_per_100k as x from rates where year = 1997), l as (select list_sort(list(x)) as xs, count(*) as n from v)", "select state, cast(len(list_filter([xs[cast(floor(n * i / 6) as bigint) + 1] for i in range(1, 6)], lambda b: b <= x)) as integer) as bucket from v, l"),
    "histogram_26": q(RATES + ", v as (select rate_per_100k as x from rates where year = 1997), t as (select max(x) * 1.05 as top from v), h as (select least(cast(floor(x * 26 / top) as integer), 25) as bin, count(*) as n from v, t where x >= 0 group by 1)", "select cast(b.bin as integer) as bin, round(b.bin * top / 26, 6) as low, round((b.bin + 1) * top / 26, 6) as high, coalesce(n, 0) as n from range(26) b(bin) cross join t left join h on h.bin = b.bin"),
    "cluster_size_bands": q(S, "select case when n = 2 then '2' when n < 10 then '3-9' when n < 50 then '10-49' when n < 500 then '50-499' when n < 5000 then '500-4999' else '5000+' end as band, count(*) as clusters, cast(sum(n) as bigint) as complaints from (select count(*) as n from s group by hash having count(*) >= 2) group by 1"),
    "bucket_counts": q(C, " union all ".join(f"select '{f}' as field, {f} as key, count(*) as doc_count from c group by {f}" for f in ("product", "state", "submitted_via"))),
    "time_index": q(C + ", " + FILLED.replace("{e}", "segment") + ", ti as (select entity, month_start, row_number() over (partition by entity order by month_start) - 1 as t, case when month_start >= date '1998-11-01' then 1 else 0 end as post from filled)", "select entity as series, month_start, cast(t as integer) as t, cast(post as integer) as post, cast(greatest(sum(post) over (partition by entity order by month_start rows unbounded preceding) - 1, 0) as bigint) as t_post from ti"),
    "ordinals": "select i as id, i || case when i % 100 between 11 and 20 then 'th' when i % 10 = 1 then 'st' when i % 10 = 2 then 'nd' when i % 10 = 3 then 'rd' else 'th' end as shown from range(32) t(i)",
    "shingle_stats": q(NORM_D, "select doc_id, len(t) as tokens, case when len(t) = 0 then 0 when len(t) < 5 then 1 else len(list_distinct([array_to_string(t[i:i + 4], ' ') for i in range(1, len(t) - 3)])) end as shingles from e"),
    "jaccard_pairs_exact": "with d as (select item_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') as t from benchmark), g as (select item_id, list_distinct(case when len(t) < 2 then t else [array_to_string(t[i:i + 1], ' ') for i in range(1, len(t))] end) as g from d), p as (select a.item_id as a, b.item_id as b, len(list_intersect(a.g, b.g)) as common, len(a.g) as na, len(b.g) as nb from g a join g b on a.item_id < b.item_id) select a, b, common, round(common / (na + nb - common), 6) as jaccard from p where common > 0",
    "events_tumbling": f"select {WINDOW.format(w='1 day')} as start, {WINDOW.format(w='1 day')} + interval 1 day as \"end\", event_type, count(*) as n, round(sum(value), 4) as total from events group by all",
    "events_sliding": f"select s as start, s + interval 2 day as \"end\", event_type, count(*) as n, round(sum(value), 4) as total from (select unnest([{WINDOW.format(w='1 day')}, {WINDOW.format(w='1 day')} - interval 1 day]) as s, event_type, value from events) group by all",
    "events_session": "with a as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 2 hour or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as first from events), b as (select *, sum(first) over (partition by user_id order by ts rows unbounded preceding) as k from a) select user_id, min(ts) as start, max(ts) + interval 2 hour as \"end\", count(*) as n from b group by user_id, k",
    "events_late_dedup": "select event_type, count(*) as n, round(sum(value), 3) as total from events group by 1",
}
