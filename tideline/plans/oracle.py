"""DuckDB SQL for the named queries."""

from __future__ import annotations

import re

from ..schema import LAG_EDGES, LAG_LABELS, QUANTILES, THRESHOLDS

PERIOD = "last_day(date '1996-01-01' + to_months(cast((l_orderkey * 7) % 24 as int) * 3 + 2))"
RAW = f"""raw as (
 select cast(l_orderkey % 97 as bigint) as cik, lpad(cast(l_orderkey as varchar), 10, '0') as adsh,
  case when l_orderkey % 20 = 0 then '10-K/A' when l_orderkey % 23 = 0 then '10-Q/A' when l_orderkey % 4 = 1 then '10-K' when l_orderkey % 31 = 0 then '8-K' else '10-Q' end as form,
  {PERIOD} + cast(30 + l_orderkey % 30 as int) as filed, {PERIOD} as period,
  case l_returnflag when 'A' then 'Assets' when 'N' then 'NetIncomeLoss' else 'StockholdersEquity' end as tag,
  concat('us-gaap/', cast(1996 + cast((l_orderkey * 7) % 24 as int) // 4 as varchar)) as version,
  last_day(date '1996-01-01' + to_months(cast((l_orderkey * 7) % 24 as int) * 3 + 2 - 12 * (l_linenumber % 3))) as ddate,
  case when l_returnflag = 'N' then 4 else 0 end as qtrs,
  case when l_linestatus = 'O' then 'USD' else 'shares' end as uom,
  cast(case when l_discount = 0.05 then null
       else (case when l_orderkey % 50 = 0 then 0
                  else 1000 + (l_orderkey % 97) * 13 % 977 + case l_returnflag when 'A' then 5000 when 'N' then (l_orderkey % 97) * 29 % 311 else 0 end end
            + case when l_discount >= 0.09 then cast(l_quantity as int) else 0 end)
            * case when l_tax = 0.08 and l_discount < 0.02 then 1000 else 1 end end as double) as value,
  l_partkey, l_suppkey
 from lineitem)"""
KEPT_FORM = "form in ('10-K','10-Q','10-K/A','10-Q/A')"
KEY = "cik, tag, ddate, qtrs, uom"
OBS = f"""{RAW},
obs as (
 select cik, adsh, tag, ddate, qtrs, uom, min(form) form, min(filed) filed, min(period) period, min(version) as version, min(value) as value
 from raw where {KEPT_FORM} group by cik, adsh, tag, ddate, qtrs, uom
 having count(distinct value) + max(case when value is null then 1 else 0 end) <= 1)"""


def life(source: str, config, name: str = "") -> str:
    """CTEs of the observation series, events and census of ``source``."""
    ratio = "v_new / nullif(v_old, 0)"
    log = f"log10(case when {ratio} > 0 and not isinf({ratio}) then {ratio} end)"
    return f"""ser{name} as (
 select *, lag(value) over w as v_old, lag(adsh) over w as adsh_old, lag(form) over w as form_old, lag(filed) over w as filed_old, lag(version) over w as version_old, first_value(filed) over w as filed_first
 from {source} where value is not null window w as (partition by {KEY} order by filed, adsh)),
chg{name} as (select * rename (value as v_new) from ser{name} where v_old is not null and v_old <> value),
ev{name} as (
 select {KEY}, cast(row_number() over (partition by {KEY} order by filed, adsh) as int) as seq, v_old, v_new, v_new - v_old as abs_delta,
  abs(v_new - v_old) / greatest(abs(v_old), abs(v_new), 1.0) as rel_delta, adsh_old, adsh as adsh_new, form_old, form as form_new, filed_old, filed as filed_new,
  cast(filed - filed_old as int) as lag_days, cast(filed - filed_first as int) as lag_since_first_days, version_old, version as version_new,
  version_old <> version as version_changed, form like '%/A' as is_amendment,
  cast(case when abs({log} - round({log})) < 1e-6 and round({log}) <> 0 then round({log}) end as tinyint) as scale_exponent
 from chg{name}),
cen{name} as (
 select c.*, n_distinct_val >= 2 as revised, cast(n_distinct_val - 1 as int) as n_revisions, abs(v_final - v_first) / greatest(abs(v_first), 1.0) as magnitude, v_first = 0 as from_zero,
  cast(filed_final - filed_first as int) as lag_days, cast(date '{config.window_end}' - filed_first as int) as obs_window_days,
  date '{config.window_end}' - filed_first < {config.right_truncation_days} as right_censored, filed_first < date '{config.left_cutoff}' as left_censored_window,
  ddate < period_first - 31 as first_is_comparative, filed_first < date '{config.left_cutoff}' or ddate < period_first - 31 as left_censored,
  coalesce(ever_amendment, false) as ever_amendment, coalesce(ever_scale_change, false) as ever_scale_change
 from (select {KEY}, count(*) as n_obs, count(distinct value) as n_distinct_val, arg_min(value, (filed, adsh)) as v_first, arg_max(value, (filed, adsh)) as v_final,
        min(filed) as filed_first, max(filed) as filed_final, arg_min(period, (filed, adsh)) as period_first from {source} where value is not null group by all) c
 left join (select {KEY}, bool_or(is_amendment) as ever_amendment, bool_or(scale_exponent is not null) as ever_scale_change from ev{name} group by all) f using ({KEY}))"""


GROUPS = """grp as (select unnest(['all', 'drop_right', 'drop_left', 'drop_both']) as censoring)"""


def keeps(r: str) -> str:
    return f"(g.censoring = 'all' or (g.censoring = 'drop_right' and not {r}.right_censored) or (g.censoring = 'drop_left' and not {r}.left_censored) or (g.censoring = 'drop_both' and not {r}.right_censored and not {r}.left_censored))"


QUANTILE_ROWS = f"(select unnest([{', '.join(map(str, QUANTILES))}]) as quantile)"


def quantiles(rows: str, by: list[str], count: str, cells: str) -> str:
    """Nearest-rank quantiles of column v of ``rows``, for every row of ``cells``."""
    names = ", ".join(by)
    return f"""ranked as (select {names}, v, row_number() over (partition by {names} order by v) as k, count(*) over (partition by {names}) as n from ({rows}) where v is not null),
want as (select * from ({cells}) cross join {QUANTILE_ROWS})
select {', '.join('w.' + c for c in by)}, coalesce(s.n, 0) as {count}, w.quantile, r.v as value
from want w left join (select distinct {names}, n from ranked) s on {' and '.join(f's.{c} = w.{c}' for c in by)}
left join ranked r on {' and '.join(f'r.{c} = w.{c}' for c in by)} and r.k = floor((s.n - 1) * w.quantile + 0.5) + 1"""


SUB = """sub as (
 select distinct adsh, cast(cik as varchar) as cik, form, period, filed, cast(year(period) as varchar) as fy,
  (case when cik % 7 = 0 then filed - 1 else filed end) + to_hours(cast(15 + cik % 3 as int)) + to_minutes(30) as accepted from raw)"""
NUM = """num as (
 select adsh, tag, version, ddate, case when l_partkey % 37 = 0 then '7' when l_partkey % 41 = 0 then '4.0' else cast(qtrs as varchar) end as qtrs, uom,
  case when l_suppkey % 10 = 0 then 'Axis=Member;' when l_suppkey % 10 = 1 then '  ' end as segments, case when l_suppkey % 15 = 2 then 'PARENT' end as coreg, value from raw)"""
INTEGER = "case when regexp_full_match(qtrs, '[0-9]+') then cast(qtrs as int) end"
AUDIT = f"""{RAW}, {SUB}, {NUM},
judged as (
 select n.*, {INTEGER.replace('qtrs', 'n.qtrs')} as q, s.cik, s.form, s.period, s.filed, s.fy, s.accepted,
  case when coalesce(trim(segments), '') <> '' or coalesce(trim(coreg), '') <> '' then 'drop_segments'
       when coalesce({INTEGER.replace('qtrs', 'n.qtrs')}, -1) not in (0, 1, 2, 3, 4) then 'drop_qtrs'
       when s.adsh is null then 'drop_form'
       when tag = 'StockholdersEquity' and version = 'us-gaap/1999' then 'drop_custom' end as reason
 from num n left join (select * from sub where {KEPT_FORM}) s using (adsh)),
grouped as (
 select adsh, tag, ddate, q, uom, count(*) as n, count(distinct value) + max(case when value is null then 1 else 0 end) as nv, min(value) as value, min(cik) as cik, min(form) as form,
  min(period) as period, min(filed) as filed, min(accepted) as accepted, min(version) as version
 from judged where reason is null group by all)"""


def choices(source: str, days: str) -> str:
    """CTEs ``cho``: what each program reads in each world, for each day; one definition per program."""
    items = "case when tag = 'Assets' and qtrs = 0 then 'assets' when tag = 'NetIncomeLoss' and qtrs = 4 then 'ni' when tag = 'StockholdersEquity' and qtrs = 0 then 'eq' end"
    newest = "qualify row_number() over (partition by world, asof, cik, item order by ddate desc, filed desc, adsh desc, uom desc) = 1"
    cols = "world, asof, cik, item, ddate, filed, adsh, uom, value"
    return f"""days as (select unnest([{days}]) as asof),
base as (select w.world, d.asof, f.cik, {items} as item, f.ddate, f.filed, f.adsh, f.uom, f.value
 from {source} f, days d, (select unnest(['pit', 'rev']) as world) w where {items} is not null and (w.world = 'rev' or f.filed <= d.asof)),
cho as (
 select 'correct' as program, * from (select {cols} from base where ddate <= asof and filed <= asof {newest})
 union all select 'naive', * from (select {cols} from base where ddate <= asof {newest})
 union all select 'lookahead', * from (select {cols} from base where ddate <= asof + 365 {newest})
 union all select 'restated', * from (
  select b.world, b.asof, b.cik, b.item, b.ddate, b.filed, b.adsh, b.uom, b.value from base b
  join (select world, asof, cik, item, max(ddate) as ddate from base where ddate <= asof and filed <= asof group by all) p using (world, asof, cik, item, ddate)
  qualify row_number() over (partition by b.world, b.asof, b.cik, b.item order by b.filed desc, b.adsh desc, b.uom desc) = 1))"""


def scores(n: int) -> str:
    return f"""wide as (select program, world, asof, cik, max(case when item = 'assets' then value end) as assets, max(case when item = 'ni' then value end) as ni, max(case when item = 'eq' then value end) as eq from cho group by all),
uni as (select * from wide where assets > 0 qualify row_number() over (partition by program, world, asof order by assets desc, cik) <= {n}),
roes as (select program, world, asof, cik, ni / eq as roe from uni where eq <> 0 and ni is not null),
moments as (select program, world, asof, avg(roe) as m, stddev_samp(roe) as s, count(*) as n from roes group by all),
pan as (select program, world, asof, cik, (roe - m) / s as value from roes join moments using (program, world, asof) where n >= 2 and s > 0)"""


CELLS = """cel as (select *, coalesce(abs(y_pit - y_rev) / (abs(y_pit) + 1e-12) > 1e-6, true) as differs
 from (select program, asof, cik, max(case when world = 'pit' then value end) as y_pit, max(case when world = 'rev' then value end) as y_rev from pan group by all)),
both_ as (select * from cel where y_pit is not null and y_rev is not null),
rnk as (select program, asof, rank() over (partition by program, asof order by round(y_pit, 9)) + (count(*) over (partition by program, asof, round(y_pit, 9)) - 1) / 2 as ra,
 rank() over (partition by program, asof order by round(y_rev, 9)) + (count(*) over (partition by program, asof, round(y_rev, 9)) - 1) / 2 as rb from both_),
rsum as (select program, asof, cast(count(*) as double) as n, sum(ra) as sa, sum(rb) as sb, sum(ra * ra) as saa, sum(rb * rb) as sbb, sum(ra * rb) as sab, sum((ra - rb) * (ra - rb)) as dd, count(distinct ra) as na, count(distinct rb) as nb from rnk group by all),
trm as (select program, asof, 1 - case when na = n and nb = n then 1 - 6.0 * dd / (n * (n * n - 1)) else (n * sab - sa * sb) / sqrt((n * saa - sa * sa) * (n * sbb - sb * sb)) end as term
 from rsum where n >= 2 and n * saa - sa * sa <> 0 and n * sbb - sb * sb <> 0),
lam as (select c.program, c.n_diff / c.n_cells as lambda_cell, coalesce(t.lambda_rank, 0) as lambda_rank, c.n_cells, c.n_diff
 from (select program, count(*) as n_cells, count(case when differs then 1 end) as n_diff from cel group by all) c left join (select program, avg(term) as lambda_rank from trm group by all) t using (program))"""


def truncated(n: int, points: str) -> str:
    """CTE ``trn``: failures by program, from ``cho`` over full facts and over facts cut at each point."""
    return f"""points as (select unnest([{points}]) as point),
tbase as (select p.point, d.asof, f.cik, f.item, f.ddate, f.filed, f.adsh, f.uom, f.value from (select * from base where world = 'rev') f join days d on f.asof = d.asof join points p on d.asof <= p.point),
tcho as (
 select program, point, cutoff, asof, cik, item, value from (
  select 'correct' as program, c.cutoff, t.* from tbase t, (select unnest([false, true]) as cutoff) c where (not c.cutoff or ddate <= point) and ddate <= asof and filed <= asof
  union all select 'naive', c.cutoff, t.* from tbase t, (select unnest([false, true]) as cutoff) c where (not c.cutoff or ddate <= point) and ddate <= asof
  union all select 'lookahead', c.cutoff, t.* from tbase t, (select unnest([false, true]) as cutoff) c where (not c.cutoff or ddate <= point) and ddate <= asof + 365)
 qualify row_number() over (partition by program, point, cutoff, asof, cik, item order by ddate desc, filed desc, adsh desc, uom desc) = 1
 union all
 select 'restated', point, cutoff, asof, cik, item, value from (
  select c.cutoff, t.*, max(case when ddate <= asof and filed <= asof then ddate end) over (partition by point, c.cutoff, asof, cik, item) as chosen
  from tbase t, (select unnest([false, true]) as cutoff) c where not c.cutoff or ddate <= point)
 where ddate = chosen qualify row_number() over (partition by point, cutoff, asof, cik, item order by filed desc, adsh desc, uom desc) = 1),
twide as (select program, point, cutoff, asof, cik, max(case when item = 'assets' then value end) as assets, max(case when item = 'ni' then value end) as ni, max(case when item = 'eq' then value end) as eq from tcho group by all),
tuni as (select * from twide where assets > 0 qualify row_number() over (partition by program, point, cutoff, asof order by assets desc, cik) <= {n}),
troe as (select program, point, cutoff, asof, cik, ni / eq as roe, count(*) over g as n, min(ni / eq) over g as lo, max(ni / eq) over g as hi from tuni where eq <> 0 and ni is not null window g as (partition by program, point, cutoff, asof)),
tok as (select * from troe where n >= 2 and lo < hi),
bad as (select distinct program, point, asof from (select program, point, asof, cik from tok group by all having count(*) = 1 or min(roe) <> max(roe))),
trn as (select p.program, count(b.point) as n_failures from (select unnest(['correct', 'naive', 'lookahead', 'restated']) as program) p left join bad b using (program) group by all)"""


def users(size: int, days: str, points: str) -> str:
    """CTEs ``pan`` and ``trn`` of the user programs: companies with most assets as the latest view, the as-of view and a year ahead show them."""
    newest = "qualify row_number() over (partition by program, world, point, asof, cik order by ddate desc, filed desc, adsh desc, uom desc) = 1"
    return f"""udays as (select unnest([{days}]) as asof),
upoints as (select null::date as point union all select unnest([{points}])),
uall as (select p.program, w.world, c.point, d.asof, f.cik, f.ddate, f.filed, f.adsh, f.uom, f.value
 from obs f, udays d, upoints c, (select unnest(['largest', 'largest_known', 'largest_ahead']) as program) p, (select unnest(['pit', 'rev']) as world) w
 where f.tag = 'Assets' and f.qtrs = 0 and (c.point is null or (w.world = 'rev' and d.asof <= c.point and f.ddate <= c.point))
  and f.ddate <= d.asof + case when p.program = 'largest_ahead' then 365 else 0 end and (f.filed <= d.asof or (w.world = 'rev' and p.program <> 'largest_known'))),
unew as (select * from uall {newest}),
utop as (select * from unew where value > 0 qualify row_number() over (partition by program, world, point, asof order by value desc, cik) <= {size}),
pan as (select program, world, asof, cik, value from utop where point is null),
ufull as (select a.program, a.asof, c.point, a.cik, a.value, false as cuts from utop a, upoints c where a.world = 'rev' and a.point is null and a.asof <= c.point),
ucut as (select program, asof, point, cik, value, true as cuts from utop where point is not null),
ubad as (select distinct program, asof, point from (select program, asof, point, cik from (select * from ufull union all select * from ucut) group by all having count(*) = 1 or min(value) <> max(value))),
trn as (select p.program, count(b.point) as n_failures from (select unnest(['largest', 'largest_known', 'largest_ahead']) as program) p left join ubad b using (program) group by all)"""


def statements(as_of, config, days, points, size, rules) -> dict[str, str]:
    day, day_list, point_list = f"date '{as_of}'", ", ".join(f"date '{d}'" for d in days), ", ".join(f"date '{d}'" for d in points)
    lives = f"with {OBS}, {life('obs', config)}, {GROUPS}, evf as (select e.*, c.n_obs, c.right_censored, c.left_censored from ev e left join cen c using ({KEY}))"
    newest = f"qualify row_number() over (partition by {KEY} order by filed desc, adsh desc) = 1"
    many = f"dy as (select unnest([{day_list}]) as asof), pit as (select d.asof, o.* from obs o join dy d on o.filed <= d.asof qualify row_number() over (partition by d.asof, {KEY} order by filed desc, adsh desc) = 1)"
    out = {
        "raw_facts": f"with {RAW} select * exclude (l_partkey, l_suppkey) from raw",
        "observations": f"with {OBS} select * from obs",
        "filter_counts": f"""with {AUDIT} select r.reason, cast(coalesce(c.n, 0) as bigint) as n_rows from
            (select unnest(['drop_segments', 'drop_qtrs', 'drop_form', 'drop_custom', 'drop_ambiguous', 'drop_duplicate', 'kept']) as reason) r left join
            (select reason, count(*) as n from judged where reason is not null group by all
             union all select 'drop_ambiguous', sum(case when nv > 1 then n else 0 end) from grouped
             union all select 'drop_duplicate', sum(case when nv = 1 then n - 1 else 0 end) from grouped
             union all select 'kept', count(case when nv = 1 then 1 end) from grouped) c using (reason)""",
        "ingested": f"with {AUDIT} select cast(cik as bigint) as cik, adsh, form, filed, accepted, period, tag, version, ddate, q as qtrs, uom, value, cast(year(filed) as int) as filed_year from grouped where nv = 1",
        "custom_tag_anti": f"with {RAW}, {NUM} select tag, version, count(*) as n_rows from num n where not exists (select 1 from (select distinct tag, version from raw where tag = 'StockholdersEquity' and version = 'us-gaap/1999') c where c.tag = n.tag and c.version = n.version) group by all",
        "qtrs_cast_filter": f"with {RAW}, {NUM} select qtrs, count(*) as n_rows, count(case when {INTEGER} in (0, 1, 2, 3, 4) then 1 end) as n_kept from num group by all",
        "blank_filter": f"with {RAW}, {NUM} select coalesce(trim(segments), '') = '' as no_segments, coalesce(trim(coreg), '') = '' as no_coreg, count(*) as n_rows from num group by all",
        "pk_violations": f"with {RAW} select adsh, tag, ddate, qtrs, uom, count(*) as n from raw where {KEPT_FORM} group by all having count(*) > 1 order by n desc, adsh, tag, ddate, qtrs, uom limit 10",
        "summary": f"with {OBS} select count(*) as n_rows, count(distinct cik) as n_cik, count(distinct tag) as n_tag, count(distinct adsh) as n_adsh, min(filed) as filed_min, max(filed) as filed_max, min(ddate) as ddate_min, max(ddate) as ddate_max from obs",
        "by_form": f"with {OBS} select form, count(*) as n_rows from obs group by all",
        "business_key_count": f"with {OBS} select count(*) as n_keys from (select distinct {KEY} from obs)",
        "load_filtered": f"with {OBS} select * from obs where cik in (1, 2, 3, 5, 8) and tag in ('Assets', 'NetIncomeLoss') and ddate <= {day} and qtrs = 0",
        "load_years": f"with {OBS} select cast(year(filed) as int) as filed_year, form, count(*) as n_rows, sum(value) as sum_value from obs where year(filed) in (1998, 2000) group by all",
        "company_sample": f"with {OBS} select cik from (select distinct cik from obs) order by md5(concat(cik, ':7')), cik limit 20",
        "as_of": f"with {OBS} select * from obs where filed <= {day} {newest}",
        "latest": f"with {OBS} select * from obs {newest}",
        "diff_worlds": f"""with {OBS}, p as (select * from obs where filed <= {day} {newest}), r as (select * from obs {newest})
            select {KEY}, p.value as value_pit, p.filed as filed_pit, p.adsh as adsh_pit, r.value as value_rev, r.filed as filed_rev, r.adsh as adsh_rev from p join r using ({KEY}) where p.value is distinct from r.value""",
        "events": f"{lives} select * from ev",
        "census_of_arrivals": f"{lives} select * from cen",
        "events_of_arrivals": f"{lives} select * from ev",
        "version_intervals": f"""with {OBS}, iv as (select *, coalesce(lead(filed) over w, date '9999-12-31') as known_to, last_value(value) over (partition by {KEY} order by filed, adsh rows between unbounded preceding and unbounded following) as value_rev
            from obs window w as (partition by {KEY} order by filed, adsh)) select {KEY}, adsh, value, filed as known_from, known_to, value_rev from iv where filed < known_to""",
        "as_of_days": f"with {OBS}, {many} select * from pit",
        "as_of_stored": f"with {OBS} select * from obs where filed <= {day} {newest}",
        "diff_worlds_days": f"""with {OBS}, {many}, r as (select * from obs {newest})
            select p.asof, {KEY}, p.value as value_pit, p.filed as filed_pit, p.adsh as adsh_pit, r.value as value_rev, r.filed as filed_rev, r.adsh as adsh_rev from pit p join r using ({KEY}) where p.value is distinct from r.value""",
        "event_seq": f"{lives} select {KEY}, adsh_new, seq from ev",
        "event_lags": f"{lives} select lag_days, lag_since_first_days, count(*) as n_events from ev group by all",
        "scale_exponent": f"{lives} select cast(scale_exponent as int) as scale_exponent, count(*) as n_events from ev group by all",
        "census": f"{lives} select * from cen",
        "census_flags": f"{lives} select revised, from_zero, ever_amendment, ever_scale_change, right_censored, left_censored_window, first_is_comparative, left_censored, count(*) as n_keys from cen group by all",
        "freeze_first_filed": f"with {OBS} select {KEY}, adsh, first_value(value) over (partition by {KEY} order by filed, adsh) as value from obs",
        "frozen_census": f"with {OBS}, fz as (select * replace (first_value(value) over (partition by {KEY} order by filed, adsh) as value) from obs), {life('fz', config)} select tag, count(*) as n_keys, cast(sum(n_obs) as bigint) as n_obs, count(case when revised then 1 end) as n_revised, sum(v_final) as sum_final from cen group by all",
        "frozen_events": f"with {OBS}, fz as (select * replace (first_value(value) over (partition by {KEY} order by filed, adsh) as value) from obs), {life('fz', config, 'z')}, {life('obs', config)} select tag, n_events, coalesce(n, 0) as n_frozen from (select tag, count(*) as n_events from ev group by all) left join (select tag, count(*) as n from evz group by all) using (tag)",
    }
    merged = f"""{OBS}, mp as (select * replace (case when tag = 'Assets' then 'StockholdersEquity' else tag end as tag) from obs where value is not null),
        mg as (select {KEY}, adsh, min(form) as form, min(filed) as filed, min(period) as period, min(version) as version, min(value) as value from mp group by {KEY}, adsh having count(distinct value) = 1)"""
    out |= {
        "merged_conflicts": f"with {merged} select count(*) as n_conflicts from (select 1 from mp group by {KEY}, adsh having count(distinct value) > 1)",
        "merged_events": f"with {merged}, {life('mg', config)} select {KEY}, seq, v_old, v_new, rel_delta, adsh_old, adsh_new, lag_days, version_changed from ev",
        "merged_census": f"with {merged}, {life('mg', config)} select {KEY}, n_obs, n_distinct_val, v_first, v_final, revised, left_censored from cen",
    }
    share = "case when {b} > 0 then {a} / {b} end"
    multi = f"(select g.censoring, count(*) as n from grp g join cen c on {keeps('c')} and c.n_obs >= 2 group by all)"

    def parts(rows: str, columns: dict[str, str], count: str, total: str, ratio_name: str) -> str:
        counts = ", ".join(f"count(case when {cond} then 1 end) as {name}" for name, cond in columns.items())
        each = " union all ".join(f"select censoring, '{name}' as category, {name} as {count}, {share.format(a=name, b=total)} as {ratio_name} from cnt" for name in columns)
        return f"{lives}, cnt as (select g.censoring, count(r.cik) as n, {counts} from grp g left join {rows} r on {keeps('r')} group by all) {each}"

    lag = f"(select g.censoring, m.measure, case when m.measure = 'since_first' then e.lag_since_first_days else e.lag_days end as v, q.qtrs from evf e join grp g on {keeps('e')}, (select unnest(['since_first', 'adjacent']) as measure) m, lateral (select unnest(['all', cast(e.qtrs as varchar)]) as qtrs) q)"
    lag_cells = "select * from grp, (select unnest(['since_first', 'adjacent']) as measure), (select unnest(['all', '0', '1', '2', '3', '4']) as qtrs)"
    bins = "case " + " ".join(f"when v < {e} then '{l}'" for e, l in zip(LAG_EDGES, LAG_LABELS)) + f" else '{LAG_LABELS[-1]}' end"
    by_tag = f"select g.censoring, c.tag, count(*) as n_keys_multi, count(case when c.revised then 1 end) as rv from grp g join cen c on {keeps('c')} and c.n_obs >= 2 group by all"
    out |= {
        "rate_by_threshold": f"""{lives} select g.censoring, t.threshold, coalesce(m.n, 0) as n_keys_multi, coalesce(h.n, 0) as n_keys_revised, {share.format(a='coalesce(h.n, 0)', b='m.n')} as rate
            from grp g cross join (select unnest([{', '.join(map(str, THRESHOLDS))}]) as threshold) t left join {multi} m on m.censoring = g.censoring
            left join (select g.censoring, t.threshold, count(distinct ({KEY.replace('cik', 'e.cik')})) as n from evf e join grp g on {keeps('e')} cross join (select unnest([{', '.join(map(str, THRESHOLDS))}]) as threshold) t where e.n_obs >= 2 and e.rel_delta > t.threshold group by all) h
             on h.censoring = g.censoring and h.threshold = t.threshold""",
        "magnitude_quantiles": f"{lives}, " + quantiles(f"select g.censoring, s.scale_filter, c.magnitude as v from cen c join grp g on {keeps('c')} join (select unnest(['with_scale', 'without_scale']) as scale_filter) s on s.scale_filter = 'with_scale' or not c.ever_scale_change where c.revised and not c.from_zero", ["censoring", "scale_filter"], "n_keys", "select * from grp, (select unnest(['with_scale', 'without_scale']) as scale_filter)"),
        "rel_delta_quantiles": f"{lives}, " + quantiles(f"select g.censoring, e.rel_delta as v from evf e join grp g on {keeps('e')}", ["censoring"], "n_events", "select * from grp"),
        "census_composition": parts("(select * from cen where revised)", {"revised_total": "r.cik is not null", "from_zero": "from_zero", "ever_scale_change": "ever_scale_change", "ever_amendment": "ever_amendment", "in_magnitude_stats": "not from_zero"}, "n_keys", "n", "share_of_revised"),
        "left_censoring_sources": f"{lives} select left_censored_window, first_is_comparative, count(*) as n_keys_multi, count(case when revised then 1 end) as n_keys_revised, count(case when revised then 1 end) / count(*) as rate from cen where n_obs >= 2 group by all",
        "lag_quantiles": f"{lives}, " + quantiles(f"select * from {lag}", ["censoring", "measure", "qtrs"], "n_events", lag_cells),
        "lag_bins": f"""{lives}, b as (select censoring, measure, qtrs, {bins} as bin_days, count(*) as n from {lag} group by all)
            select c.censoring, c.measure, c.qtrs, c.bin_days, coalesce(b.n, 0) as n_events, coalesce(b.n, 0) / nullif(sum(coalesce(b.n, 0)) over (partition by c.censoring, c.measure, c.qtrs), 0) as share
            from (select * from ({lag_cells}), (select unnest([{', '.join(f"'{l}'" for l in LAG_LABELS)}]) as bin_days)) c left join b using (censoring, measure, qtrs, bin_days)""",
        "rate_by_tag": f"""{lives}, hit as (select censoring, tag, count(*) as n from (select distinct g.censoring, e.cik, e.tag, e.ddate, e.qtrs, e.uom from evf e join grp g on {keeps('e')} where e.n_obs >= 2) group by all)
            select m.censoring, m.tag, m.n_keys_multi, coalesce(h.n, 0) as n_keys_revised, coalesce(h.n, 0) / m.n_keys_multi as rate from ({by_tag}) m left join hit h using (censoring, tag)
            qualify row_number() over (partition by m.censoring order by m.n_keys_multi desc, m.tag) <= 20""",
        "rate_by_tag_highest": f"{lives} select censoring, tag, n_keys_multi, rv as n_keys_revised, rv / n_keys_multi as rate from ({by_tag}) where n_keys_multi >= 100 qualify row_number() over (partition by censoring order by rv / n_keys_multi desc, tag) <= 20",
        "silent_vs_amendment": parts("evf", {"silent": "not is_amendment", "amendment": "is_amendment"}, "n_events", "n", "share"),
        "version_and_scale_share": parts("evf", {"version_changed": "version_changed", "scale_change": "scale_exponent in (-9, -6, -3, 3, 6, 9)"}, "n_events", "n", "share"),
        "accepted_after_1600": f"""with {AUDIT}, f as (select distinct adsh, filed, accepted from grouped where nv = 1), c as (select count(*) as n, count(case when hour(accepted) >= 16 then 1 end) as late, count(case when cast(accepted as date) < filed then 1 end) as rolled,
            count(case when hour(accepted) >= 16 and not cast(accepted as date) < filed then 1 end) as affected from f)
            select 'n/a' as censoring, n as n_filings, late as n_after_1600, late / n as share_after_1600, rolled as n_rolled_next_day, affected as n_same_day_after_1600, affected / n as share_affected from c""",
        "lag_histogram": f"{lives}, cut as (select quantile_cont(lag_since_first_days, 0.995) as cut from evf) select cast(floor(lag_since_first_days / 15) as bigint) as bin, count(*) as n from evf, cut where lag_since_first_days <= cut group by all",
        "magnitude_histogram": f"{lives} select cast(floor(magnitude / 0.005) as bigint) as bin, count(*) as n from cen where revised and not from_zero and not ever_scale_change group by all",
    }
    r = rules
    out["filter_counts_of_files"] = out["filter_counts"]
    quarter = "concat(year({0}), 'q', quarter({0}))"
    by_quarter = f"""{AUDIT}, fq as (select distinct adsh, {quarter.format('filed')} as quarter from raw)"""
    out |= {
        "archive_counts": f"""with {by_quarter}, gq as (select * from grouped join fq using (adsh)), cq as (
            select quarter, reason, count(*) as n from judged join fq using (adsh) where reason is not null group by all
            union all select quarter, 'drop_ambiguous', sum(case when nv > 1 then n else 0 end) from gq group by all
            union all select quarter, 'drop_duplicate', sum(case when nv = 1 then n - 1 else 0 end) from gq group by all
            union all select quarter, 'kept', count(case when nv = 1 then 1 end) from gq group by all)
            select q.quarter, r.reason, cast(coalesce(c.n, 0) as bigint) as n_rows from (select distinct quarter from fq) q
            cross join (select unnest(['drop_segments', 'drop_qtrs', 'drop_form', 'drop_custom', 'drop_ambiguous', 'drop_duplicate', 'kept']) as reason) r left join cq c using (quarter, reason)""",
        "archive_observations": f"with {by_quarter} select quarter, cast(cik as bigint) as cik, adsh, form, filed, accepted, period, cast(year(period) as int) as fy, tag, version, ddate, q as qtrs, uom, value, cast(year(filed) as int) as filed_year from grouped join fq using (adsh) where nv = 1",
        "archive_header_drift": f"with {by_quarter} select quarter, count(*) as n_filings, cast(0 as bigint) as n_drifted from fq group by all",
    }
    late = "filed >= date '1999-01-01'"
    used = f"""{OBS}, stk as (select * replace (case when {late} and tag = 'Assets' then 'AssetsTotal' when {late} and tag = 'NetIncomeLoss' then 'ProfitLoss' when {late} and tag = 'StockholdersEquity' and cik % 2 = 0 then 'EquityOther' else tag end as tag,
        case when {late} and tag = 'NetIncomeLoss' then value * 1.75 else value end as value) from obs)"""
    usage = "(select year(filed) as year, tag, count(*) as n from {s} group by all)"
    recent = f"coalesce(sum(case when year between {r.recent[0]} and {r.recent[1]} then n end), 0)"
    dying = f"(select tag, max(n) as peak, cast({recent} as bigint) as recent from {usage} group by all having max(n) >= {r.min_peak} and {recent} < {r.decay} * max(n))"
    early = f"coalesce(sum(case when year <= {r.early} then n end), 0)"
    rising = f"(select tag, cast({early} as bigint) as early, cast({recent} as bigint) as recent from {usage} group by all having {recent} >= {r.min_peak} and {recent} > {r.growth} * {early})"
    slot = "cik, ddate, qtrs, uom"
    succ = f"""(select old_tag, new_tag, count(distinct cik) as support_ciks from (
        select l.tag as old_tag, f.tag as new_tag, f.cik from (select tag, {slot}, max(filed) as last from stk where tag in (select tag from {dying.format(s='stk')}) group by all) l
        join stk f using ({slot}) where f.tag <> l.tag and f.filed > l.last and f.tag in (select tag from {rising.format(s='stk')})) group by old_tag, new_tag
        qualify row_number() over (partition by old_tag order by count(distinct cik) desc, new_tag) <= {r.top})"""
    prs = "(select * from (values ('Assets', 'AssetsTotal'), ('EquityOther', 'AssetsTotal'), ('NetIncomeLoss', 'ProfitLoss'), ('Assets', 'Absent')) t(old_tag, new_tag))"
    fin = f"(select tag, {slot}, arg_max(struct_pack(v := value), (filed, adsh)).v as value from stk group by all)"
    agr = f"""(select p.old_tag, p.new_tag, count(rel) as shared_keys, coalesce(count(case when rel < 1e-9 then 1 end) / nullif(count(rel), 0), 0) as exact_agreement, round(coalesce(median(rel), 1), 12) as median_rel_diff
        from {{p}} p left join (select a.tag as old_tag, b.tag as new_tag, abs(b.value - a.value) / greatest(abs(a.value), abs(b.value), 1.0) as rel from {fin} a join {fin} b using ({slot}) where a.value is not null and b.value is not null) x using (old_tag, new_tag) group by all)"""
    coo = f"""(select p.old_tag, p.new_tag, coalesce(coalesce(x.n, 0) / least(a.n + 0 * b.n, b.n + 0 * a.n), 1) as cooccurrence from {{p}} p
        left join (select tag, count(distinct adsh) as n from stk group by all) a on a.tag = p.old_tag left join (select tag, count(distinct adsh) as n from stk group by all) b on b.tag = p.new_tag
        left join (select s.tag as old_tag, t.tag as new_tag, count(distinct s.adsh) as n from stk s join stk t using (adsh) group by all) x on x.old_tag = p.old_tag and x.new_tag = p.new_tag)"""
    det = f"""sup as (select * from {succ} where support_ciks >= {r.min_support}),
        det as (select s.old_tag, s.new_tag, d.peak as old_peak, d.recent as old_recent, s.support_ciks, a.shared_keys, a.exact_agreement, a.median_rel_diff, c.cooccurrence,
         a.shared_keys >= {r.min_shared} and a.exact_agreement >= {r.min_agreement} and a.median_rel_diff <= {r.max_median} as accepted
         from sup s join {dying.format(s='stk')} d on d.tag = s.old_tag join {agr.format(p='sup')} a using (old_tag, new_tag) join {coo.format(p='sup')} c using (old_tag, new_tag))"""
    out |= {
        "usage_by_year": f"with {OBS} select cast(year(filed) as int) as year, tag, count(*) as n from obs group by all",
        "dying_tags": f"with {used} select * from {dying.format(s='stk')}",
        "rising_tags": f"with {used} select * from {rising.format(s='stk')}",
        "successors": f"with {used} select * from {succ}",
        "agreement": f"with {used} select * from {agr.format(p=prs)}",
        "cooccurrence": f"with {used} select * from {coo.format(p=prs)}",
        "rename_candidates": f"with {used}, {det} select * from det",
        "rename_classes": f"""with recursive {used}, {det}, lnk as (select old_tag as a, new_tag as b from det where accepted union select new_tag, old_tag from det where accepted),
            rch as (select a, b from lnk union select r.a, l.b from rch r join lnk l on l.a = r.b) select a as tag, greatest(a, max(b)) as representative from rch group by a""",
    }
    world = f"with {OBS}, {choices('obs', day_list)}, {scores(size)}"
    one = f"with {OBS}, {choices('obs', day)}, {scores(size)}"
    out |= {
        "newest_period": f"with {OBS} select cik, ddate, value, filed, adsh, uom from obs where tag = 'Assets' and ddate <= {day} qualify row_number() over (partition by cik order by ddate desc, filed desc, adsh desc, uom desc) = 1",
        "universe_topn": f"{one} select cik, assets as value from uni where program = 'correct' and world = 'pit'",
        "programs_one_day": f"{one} select program, cik, round(value, 9) as value from pan where world = 'rev'",
        "roe_zscore": f"{one} select cik, round(value, 9) as value from pan where program = 'correct' and world = 'rev'",
    }
    for name in ("correct", "naive", "lookahead", "restated"):
        out[f"panel_{name}"] = f"{world} select world, asof, cik, round(value, 9) as value from pan where program = '{name}'"
    trn = truncated(size, point_list)
    user = f"with {OBS}, {users(size, day_list, point_list)}"
    judged = """n_failures = 0 as truncation_pass, lambda_cell, round(lambda_rank, 9) as lambda_rank, n_cells, n_diff, coalesce(lambda_cell, 0) = 0 as vintage_pass,
            case when n_failures = 0 and coalesce(lambda_cell, 0) = 0 then 'clean' when n_failures = 0 then 'silent_leak' when coalesce(lambda_cell, 0) = 0 then 'obvious_bug' else 'double_failure' end as verdict from trn left join lam using (program)"""
    out |= {
        "verdict_user": f"{user}, {CELLS} select program, {judged}",
        "panel_of_functions": f"{world} select program, world, asof, cik, round(value, 9) as value from pan",
        "panel_user": f"{user} select program, world, asof, cik, value from pan",
        "truncation_user": f"{user} select program, n_failures from trn",
        "lambda_user": f"{user}, {CELLS} select program, lambda_cell, round(lambda_rank, 9) as lambda_rank, n_cells, n_diff from lam",
    }
    control = []
    for k, offset in enumerate((0, 60)):
        shifted = ", ".join(f"date '{d}' + {offset}" for d in days)
        for j, (name, source) in enumerate((("original", "obs"), ("no-revision", "fz"))):
            ctes = f"{choices(source, shifted)}, {scores(size)}, {CELLS}"
            control.append(f"select {offset} as offset_days, '{name}' as data, * replace (round(lambda_rank, 9) as lambda_rank) from (with {ctes} select * from lam)")
    out |= {
        "lambda_cell": f"{world}, {CELLS} select program, lambda_cell, n_cells, n_diff from lam",
        "lambda_rank": f"{world}, {CELLS} select program, round(lambda_rank, 9) as lambda_rank from lam",
        "lambda_by_date": f"{world}, {CELLS} select c.program, c.asof, count(case when differs then 1 end) / count(*) as lambda_cell, round(any_value(t.term), 9) as lambda_rank from cel c left join trm t using (program, asof) group by all",
        "truncation_check": f"with {OBS}, {choices('obs', day_list)}, {trn} select * from trn",
        "verdict": f"{world}, {CELLS}, {trn} select program, {judged}",
        "restatement_control": f"with {OBS}, fz as (select * replace (first_value(value) over (partition by {KEY} order by filed, adsh) as value) from obs) {' union all '.join(control)}",
        "month_end": "select distinct cast(o_orderdate as date) as day, last_day(case when day(o_orderdate) >= 15 then cast(o_orderdate as date) else cast(o_orderdate as date) - to_months(1) end) as month_end from orders",
        "qtrs_from_dates": """select n_qtrs, count(*) as n_rows from (select cast(case when o_orderkey % 5 = 0 then 0 else greatest(1, round(((year(e) - year(s)) * 12 + month(e) - month(s)) / 3)) end as int) as n_qtrs
            from (select o_orderkey, cast(o_orderdate as date) as s, cast(o_orderdate as date) + cast(o_orderkey % 500 as int) as e from orders)) group by all""",
    }
    match = "cik, tag, uom, ddate, qtrs, filed"
    second = f"""{OBS}, sec0 as (select {match}, case when cik % 11 = 3 then value * 1.5 when cik % 13 = 4 then null else value end as value from obs where right(adsh, 1) in ('0', '1', '2', '3', '4', '5', '6')),
        sec as (select * from sec0 union all select * replace (value + 1 as value) from sec0 where cik % 17 = 5),
        ou as (select {match}, count(distinct value) as nv, min(value) as value from obs where value is not null group by all),
        su as (select {match}, count(distinct value) + max(case when value is null then 1 else 0 end) as nv, min(value) as value_cf from sec group by all),
        jn as (select {match}, value, value_cf, abs(value_cf - value) / greatest(abs(value), abs(value_cf), 1.0) as rel from (select * exclude (nv) from ou where nv = 1) join (select * exclude (nv) from su where nv = 1) using ({match}))"""
    out |= {
        "crosscheck_summary": f"""with {second}, s as (select (select count(*) from obs where value is not null) as our_rows, (select count(*) from ou where nv = 1) as our_unique_keys, (select count(*) from ou where nv > 1) as our_ambiguous_keys,
            (select count(*) from sec) as companyfacts_rows, (select count(*) from su where nv = 1) as companyfacts_unique_keys, (select count(*) from su where nv > 1) as companyfacts_ambiguous_keys,
            (select count(*) from jn) as matched_observations, (select count(*) from jn where rel > 1e-9) as n_conflicts, (select round(coalesce(median(rel), 0), 12) from jn where rel > 1e-9) as conflict_rel_median)
            select *, coalesce(matched_observations / nullif(our_unique_keys, 0), 0) as match_rate_of_ours, coalesce(1 - n_conflicts / nullif(matched_observations, 0), 0) as value_agreement from s""",
        "crosscheck_conflicts": f"with {second} select * from jn where rel > 1e-9",
        "json_flatten": f"with {OBS} select cik, tag, uom, count(*) as n_rows, cast(sum(case when qtrs = 0 then 0 else 4 end) as bigint) as sum_qtrs, max(ddate) as last_ddate, sum(value) as sum_value from obs group by all",
        "json_flatten_whole": f"with {OBS} select cik, tag, uom, ddate, qtrs, filed, value from obs",
    }
    return {name: re.sub(r"\basof\b", '"asof"', sql) for name, sql in out.items()}  # a word of the dialect
