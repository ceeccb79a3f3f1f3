"""SQL twins of the queries that SQL can express."""

#: Fixed values, kept apart from the operator's own: what people type for a missing id.
MISSING = "('', 'na', 'n/a', 'n.a.', 'n.a', 'n-a', 'nan', 'nil', 'null', 'none', 'unknown', 'unk', 'undefined', 'missing', 'tbd', 'tba', 'not-known', 'not-available', 'not-set', 'no-id', '?', '??', '.', '/', '\\', '*', 'x')"


def _norm(col: str) -> str:
    return f"translate(lower(trim({col})), '_ ', '--')"


REACH = f"""
with recursive e as (select distinct episode_index as ep, {_norm('operator_id')} as op, {_norm('scene_id')} as sc, source_episode_index as src from episodes where episode_index is not null),
op as (select ep, op as k from e where op is not null and op not in {MISSING} and not regexp_full_match(op, '-*')),
sc as (select ep, sc as k from e where sc is not null and sc not in {MISSING} and not regexp_full_match(sc, '-*')),
links as (
  select a.ep, b.k from op a join (select k, min(ep) as m from op group by k) h using (k) join (select min(ep) as k, k as kk from op group by k) b on b.kk = a.k
  union select a.ep, b.k from sc a join (select min(ep) as k, k as kk from sc group by k) b on b.kk = a.k
  union select e.ep, e.src from e join (select distinct ep from e) x on x.ep = e.src),
both_ways as (select ep as a, k as b from links where ep <> k union select k, ep from links where ep <> k),
reach as (select distinct ep as a, ep as b from e union select r.a, w.b from reach r join both_ways w on r.b = w.a),
grp as (select a as episode_index, min(b) as g from reach group by a)
"""

#: Dealing as a recursion over size bands, from the largest roots down; lists hold a band's roots in the order of their hash.
DEAL = REACH + """,
sz as (select g, count(*)::double as n from grp group by g),
sp as (select g, n, floor(log2(n))::integer as band, ('0x' || substr(md5(g::varchar || ':7'), 1, 13))::bigint as h from sz),
li as (select *, sum(n) over (partition by band order by h, g rows unbounded preceding) - n / 2 as mid from sp),
bd as (select band, row_number() over (order by band desc) as b, sum(n) as whole, count(*) as roots, list(n order by h, g) as ns, list(mid order by h, g) as mids, list(g order by h, g) as gs from li group by band),
tg as (select list(split_name order by fraction desc, split_name) as names, list(fraction order by fraction desc, split_name) as f from split_targets),
deal as (
  select 0::bigint as b, list_transform(f, lambda x: x / list_sum(f) * total) as lack, null::bigint[] as gs, null::bigint[] as tos from tg, (select sum(n) as total from sz)
  union all
  select b, list_transform(range(1, len(lack) + 1), lambda i: lack[i] - coalesce(list_sum(list_transform(list_filter(range(1, len(ns) + 1), lambda k: tos[k] = i), lambda k: ns[k])), 0)), gs, tos from (
    select *, list_transform(mids, lambda m: 1 + len(list_filter(ends, lambda x: x <= m))) as tos from (
      select *, list_transform(range(1, len(kept) + 1), lambda i: case when i >= list_max(list_filter(range(1, len(kept) + 1), lambda j: kept[j] > 0)) then 1e300 else whole * list_sum(kept[1:i]) / list_sum(kept) end) as ends from (
        select *, case when list_sum(due) > 0 then due else list_transform(range(1, len(short) + 1), lambda i: case when i = list_position(short, list_max(short)) then 1.0 else 0.0 end) end as kept from (
          select *, list_transform(short, lambda x: case when x / list_sum(short) * roots >= 0.5 then x / list_sum(short) else 0.0 end) as due from (
            select bd.b, bd.whole, bd.roots, bd.ns, bd.mids, bd.gs, lack, list_transform(lack, lambda x: greatest(x, 0.0)) as short from deal join bd on bd.b = deal.b + 1)))))),
dealt as (select unnest(gs) as g, unnest(tos) as k from deal where b > 0),
splits as (select grp.episode_index, grp.g, names[k] as split_name from grp join dealt on dealt.g = grp.g, tg)
"""

#: Words of a text: without case, accents, width forms and invisible characters.
_WIDE = "".join(chr(0xFF01 + k) for k in range(94)).replace("'", "''")
_PLAIN = "".join(chr(0x21 + k) for k in range(94)).replace("'", "''")
WORDS = f"regexp_extract_all(replace(lower(strip_accents(translate(regexp_replace(text, '[\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{2064}}\\x{{FEFF}}\\x{{00AD}}]', '', 'g'), '{_WIDE}', '{_PLAIN}'))), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+')"
LEAKS = f"""
with d as (select doc_id, {WORDS} as w from documents where text is not null),
i as (select item_id, w, least(13, len(w)) as n from (select item_id, {WORDS} as w from eval_items where item_id is not null and text is not null) where len(w) > 0),
iw as (select distinct item_id, n, array_to_string(w[k:k + n - 1], ' ') as g from i, unnest(range(1, len(w) - n + 2)) t(k)),
ns as (select distinct n from i),
dw as (select doc_id, n, array_to_string(w[k:k + n - 1], ' ') as g from (select doc_id, w, n from d, ns where len(w) >= n), unnest(range(1, len(w) - n + 2)) t(k))
select distinct doc_id, item_id from dw join iw using (n, g)
"""

NEAREST = """
with f as (select distinct episode_index, "index", timestamp::double as t from frames where timestamp is not null and not isnan(timestamp) and episode_index is not null and "index" is not null),
s as (select distinct sample_id, x.episode_index, x.timestamp as t, c.tolerance_s as tol from sensor_samples x join sync_configs c using (sensor_key) where x.timestamp is not null),
near as (select sample_id, f."index" as i, abs(s.t - f.t) as dt, row_number() over (partition by sample_id order by abs(s.t - f.t), f."index") as rn
  from s join f on s.episode_index = f.episode_index and abs(s.t - f.t) <= s.tol)
"""

CUT = """
with d as (select distinct f.task_index, "index", "complementary_info.advantage_v1"::double as x, k.keep_pct from frames f join keep_targets k using (task_index)
  where "index" is not null and "complementary_info.advantage_v1" is not null and not isnan("complementary_info.advantage_v1")),
r as (select *, count(*) over (partition by task_index) as n, count(*) over (partition by task_index order by x desc range between unbounded preceding and current row) as ge from d),
cut as (select task_index, max(x) as cutoff from r where ge * 100 >= keep_pct * n group by task_index)
"""

ORACLES = {
    "p1_found": REACH + "select episode_index, g as group_episode_index from grp",
    "p1_forest_sizes": REACH + 'select g as "group", count(*) as episodes, count(*) - 1 as edges from grp group by g',
    "p1_splits": DEAL + 'select episode_index, g as "group", split_name from splits',
    "p1_frames": DEAL + 'select f.episode_index, f."index", s.split_name from (select distinct episode_index, "index" from frames) f left join splits s on s.episode_index = f.episode_index',
    "p1_report": DEAL + """, fc as (select episode_index, count(distinct "index") as m from frames group by 1),
      j as (select s.split_name, count(s.episode_index) as episodes, coalesce(sum(m), 0)::bigint as frames from splits s full outer join fc on fc.episode_index = s.episode_index group by 1)
      select coalesce(t.split_name, j.split_name) as split_name, t.fraction as target, coalesce(episodes, 0) as episodes, coalesce(frames, 0) as frames, coalesce(episodes, 0) / (select sum(episodes) from j) as episode_share, coalesce(frames, 0) / (select sum(frames) from j) as frame_share
      from split_targets t full outer join j on j.split_name = t.split_name""",
    "p6_found": LEAKS,
    "p2_found": NEAREST + 'select sample_id, i as "index" from near where rn = 1',
    "p2_all": NEAREST + 'select a.sample_id, b.i as "index", round(b.dt, 6) as dt from (select distinct sample_id from sensor_samples) a left join near b on a.sample_id = b.sample_id and b.rn = 1',
    "p3_found": CUT + 'select d.task_index, d."index" from d join cut using (task_index) where d.x >= cut.cutoff',
    "p3_cutoffs": CUT + """select k.task_index, k.keep_pct::double as keep_pct, count(d.x) as n_counted, any_value(cut.cutoff) as cutoff, count(case when d.x >= cut.cutoff then 1 end) as n_kept
from keep_targets k left join d on d.task_index = k.task_index left join cut on cut.task_index = k.task_index group by k.task_index, k.keep_pct""",
}
