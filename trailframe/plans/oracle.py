"""The registered queries once more, as SQL for an independent engine.

The statements are written from the operator definitions, not from the Spark
plans: they use plain windows and joins where the library scans blocks.
"""

from __future__ import annotations

from trailframe.config import (
    CONJUNCTIONS,
    HISTORY_SENTENCE,
    PROMPT_WITH_FRONTIERS,
    PROMPT_WITHOUT_FRONTIERS,
)

K = "cast(json_extract_string(props, '$.k') as int)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


NAV_STEPS = f"""
nav_steps as (
  select 'root' || (user_id % 2) as root, cast(user_id as bigint) as task_idx, e, k, step,
    's' || (user_id % 10) as scene_id, cast(user_id as varchar) as task_id,
    'walk to room ' || (user_id % 7) || ' and wait' as instruction,
    case when k < 3 then null when k < 6 then 0 when k < 75 then 1 when k < 88 then 2 else 3 end as action,
    (step % 23) >= 20 as floor_transition, (step % 13) = 12 as is_endpoint,
    case when e % 3 = 0 then 0 when e % 3 = 1 then k % 4 end as traj_status,
    case when e % 4 <> 3 then (e * 7) % 640 end as traj_u,
    case when e % 4 <> 3 then (e * 11) % 480 end as traj_v,
    case when e % 5 <> 4 then ((e * 3) % 80) / 4.0e0 end as traj_x,
    case when e % 5 <> 4 then ((e * 5) % 80) / 4.0e0 end as traj_z,
    (e % 11) % 4 as n_cand, case when k % 5 = 0 then (e % 17) % 5 end as expert_idx,
    value / 10 as goal_distance, e % 3 as floor_id, (e % 80) / 4.0e0 as floor_height
  from (select user_id, event_id as e, {K} as k, value,
          row_number() over (partition by user_id order by ts, event_id) - 1 as step from events)
),
nav_cands as (
  select s.task_idx, s.step, i,
    case when (e + i) % 9 <> 0 then (e * 13 + i * 131) % 640 end as u,
    case when (e + i) % 9 <> 0 then (e * 17 + i * 97) % 480 end as v,
    ((e * 3 + i * 5 + 3) % 80) / 4.0e0 as x, ((e * 5 + i * 7 + 2) % 80) / 4.0e0 as z,
    case when (e + i) % 9 = 0 then 1 when (e + i) % 10 = 7 then null else ((e % 13) + i) % 4 end as vis
  from nav_steps s join (values (0), (1), (2)) as c(i) on i < s.n_cand
)"""

NEAREST = """
cand_dist as (
  select s.task_idx, s.step, i,
    case when traj_x is not null then sqrt((x - traj_x) * (x - traj_x) + (z - traj_z) * (z - traj_z))
         when traj_u is not null and u is not null
         then sqrt(cast((u - traj_u) * (u - traj_u) + (v - traj_v) * (v - traj_v) as double)) end as d
  from nav_steps s join nav_cands using (task_idx, step)
),
nearest as (
  select task_idx, step, d as near_dist, i as near_idx from cand_dist where d is not null
  qualify row_number() over (partition by task_idx, step order by d, i) = 1
)"""


def classified(version: int, metres: float = 2.0, pixels: float = 100.0) -> str:
    legacy = version < 3
    search = f"near_dist < case when traj_x is not null then {metres} else {pixels} end"
    match = f"""case when expert_idx between 0 and n_cand - 1 then expert_idx
            {'when ' + search + ' then near_idx' if legacy else ''} end"""
    flagged = f"""case when expert_idx is not null then expert_idx
            {'when ' + search + ' then near_idx' if legacy else ''} end"""
    target = "false" if legacy else "is_endpoint and traj_status = 0 and traj_u is not null"
    return f"""{NAV_STEPS},{NEAREST},
matched as (
  select s.*, near_dist, near_idx, {match} as match_idx, {flagged} as flag_idx,
    coalesce({target}, false) as sees_target
  from nav_steps s left join nearest using (task_idx, step)
),
classified as (
  select m.*,
    case when action is null then null when action = 0 then 'stop' when floor_transition then 'action'
         when sees_target then 'target' when a.vis = 0 then 'frontier' else 'action' end as mode,
    coalesce(action <> 0, false) and not floor_transition and (sees_target or coalesce(b.vis = 0, false))
      as coord_supervised,
    case when sees_target then traj_u else a.u end as hit_u,
    case when sees_target then traj_v else a.v end as hit_v
  from matched m
  left join nav_cands a on a.task_idx = m.task_idx and a.step = m.step and a.i = match_idx
  left join nav_cands b on b.task_idx = m.task_idx and b.step = m.step and b.i = flag_idx
),
valid as (
  select *, row_number() over (partition by task_idx order by step) - 1 as pos
  from classified where action is not null {'and action <> 0' if legacy else ''}
)"""


def indexed(version: int, metres: float = 2.0) -> str:
    """Adds positions, de-duplication and sequence lengths (look-ahead 3)."""
    return f"""{classified(version, metres)},
breaks as (
  select *,
    case when mode = 'action' and lag(mode) over w = 'action' and lag(action) over w = action
         then 0 else 1 end as new_run,
    case when lag(action) over w = action and lag(floor_transition) over w = floor_transition
              and not coord_supervised then 0 else 1 end as new_seq
  from valid window w as (partition by task_idx order by pos)
),
runs as (
  select *, sum(new_run) over w as run, sum(new_seq) over w as seq
  from breaks window w as (partition by task_idx order by pos rows unbounded preceding)
),
indexed as (
  select *,
    case when mode = 'action' then (row_number() over r - 1) % 4 = 0 else true end as is_sample,
    case when mode = 'action' then least(4, count(*) over (partition by task_idx, run) - row_number() over r + 1)
         else 1 end as absorbed,
    case when action = 0 then 1
         else least(4, count(*) over (partition by task_idx, seq) - row_number() over q + 1) end as emitted
  from runs
  window r as (partition by task_idx, run order by pos), q as (partition by task_idx, seq order by pos)
)"""


HISTORY = """
slots as (
  select task_idx, step, pos, slot,
    case when pos <= 8 then slot when slot = 7 then pos - 1
         else cast(floor(slot * ((pos - 1) / 7.0e0)) as bigint) end as wanted
  from indexed cross join range(8) as t(slot) where is_sample and slot < pos
),
history as (
  select a.task_idx, a.step, string_agg(cast(b.step as varchar), ',' order by slot) as hist,
    string_agg(printf('%s/%s/%s/rgb/step_%04d.jpg', b.root, b.scene_id, b.task_id, b.step), ' ' order by slot)
      as hist_paths, count(*) as n_hist
  from slots a join valid b on b.task_idx = a.task_idx and b.pos = a.wanted group by all
)"""



def history_frames(version: int) -> str:
    return f"""with {indexed(version)},{HISTORY}
select task_idx, step, coalesce(n_hist, 0) as frames, coalesce(hist, '') as history
from indexed left join history using (task_idx, step) where is_sample"""


FRONTIERS = """
frontiers as (
  select task_idx, step, '[' || string_agg('(' || u || ', ' || v || ')', ', ' order by i) || ']' as listed,
    count(*) as n_front
  from nav_cands join nav_steps using (task_idx, step)
  where u is not null and vis = 0 and not floor_transition group by all
)"""


def seeded(n: int, *keys: str, seed: int = 42) -> str:
    text = " || '|' || ".join([f"cast({k} as varchar)" for k in keys] + [f"'{seed}'"])
    return f"(cast('0x' || substr(md5({text}), 1, 15) as bigint) % {n})"


def samples(version: int) -> str:
    phrases = "[" + ", ".join(quoted(c) for c in CONJUNCTIONS) + "]"
    name = "case action when 0 then 'STOP' when 1 then 'FORWARD' when 2 then 'TURN_LEFT' else 'TURN_RIGHT' end"
    return f"""{indexed(version)},{HISTORY},{FRONTIERS},
sampled as (
  select i.*, coalesce(n_hist, 0) as n_hist, hist, hist_paths, listed, coalesce(n_front, 0) as n_front,
    case when n_front > 0 then replace({quoted(PROMPT_WITH_FRONTIERS)}, '<frontiers_coord>', listed)
         else {quoted(PROMPT_WITHOUT_FRONTIERS)} end as template,
    {phrases}[{seeded(5, 'root', 'i.task_idx', 'i.step')} + 1] as phrase,
    case mode when 'stop' then 'STOP'
      when 'frontier' then '<frontiers_coord> (' || hit_u || ', ' || hit_v || ')'
      when 'target' then '<target> (' || hit_u || ', ' || hit_v || ')'
      else '<action> ' || array_to_string(list_transform(range(emitted), lambda n: {name}), ' ') end as response
  from indexed i left join history using (task_idx, step) left join frontiers using (task_idx, step)
  where is_sample
),
samples as (
  select *, replace(replace(replace(
    case when n_hist > 0 then replace(template, '<history>', repeat('<image>', n_hist))
         else replace(replace(template, {quoted(HISTORY_SENTENCE)}, ''), '<history>', '') end,
    '<instruction>', instruction), '<conjunction>', phrase), '<image>', '<image>') as prompt
  from sampled
)"""


# -- derived documents ------------------------------------------------------------

DOCUMENTS = f"""{NAV_STEPS},
flawed as (
  select *, (task_idx // 4) % 8 as defect, task_idx % 4 as kind,
    max(step) over (partition by task_idx) as last_step from nav_steps
),
doc_steps as (
  select *, case when defect <> 6 then action when step = last_step then 0 when action = 0 then 1 else action end
      as doc_action,
    floor_transition and defect <> 6 as doc_transition, is_endpoint and defect <> 6 as doc_endpoint
  from flawed where defect <> 2
),
doc_tasks as (
  select task_idx as user_no, task_id, kind, defect, kind || '-' || (task_idx // 400) as root,
    case kind when 1 then 2 when 2 then 4 else 3 end as schema_version, kind in (0, 3) as v3,
    row_number() over (partition by kind, task_idx // 400 order by task_idx) - 1 as task_no,
    case when defect = 2 then 0 else last_step + 1 end as n_actions
  from (select distinct task_idx, task_id, kind, defect, last_step from flawed)
),
doc_stops as (
  select task_idx as user_no, string_agg(cast(step as varchar), ', ' order by step) as stops,
    count(*) as n_stops, max(step) as last_stop, max(last_step) as last_step
  from doc_steps where doc_action = 0 group by task_idx
)"""


def _rule(name: str, condition: str, detail: str = "null", tables: str = "doc_tasks t left join doc_stops s using (user_no)") -> str:
    return f"""with {DOCUMENTS}
select root, task_no as task_idx, cast(null as bigint) as step, '{name}' as rule, {detail} as detail
from {tables} where {condition}"""


def _step_rule(name: str, condition: str) -> str:
    return f"""with {DOCUMENTS}
select t.root, task_no as task_idx, step, '{name}' as rule, cast(null as varchar) as detail
from doc_steps d join doc_tasks t on t.user_no = d.task_idx where v3 and {condition}"""


# -- conversations, tokens ------------------------------------------------------------

TURNS = """
turns as (
  select conv_id, turn,
    case role when 'user' then 'human' when 'assistant' then 'gpt' else role end as speaker,
    case when role = 'user' and conv_id % 3 = 0 and turn <= 1 then '<video>' || chr(10) || text else text end as value,
    case when conv_id % 3 = 1 then 1 else 8 end as n_frames from conversations
),
flat as (
  select conv_id,
    coalesce(string_agg(case when speaker = 'human' then
        case when contains(value, '<video>')
             then repeat('<image>', n_frames) || chr(10) || replace(replace(value, '<video>' || chr(10), ''), '<video>', '')
             else value end end, '' order by turn), '') as prompt,
    coalesce(arg_max(value, turn) filter (speaker = 'gpt'), '') as response, max(n_frames) as n_images
  from turns group by conv_id
)"""

TOKENS = """
tokens as (
  select doc_id, list_transform(string_split(text, ' '), lambda w: length(w)) as ids from documents
),
responses as (
  select *, case when doc_id % 3 = 0 then [99, 98] else ids[5:7] end as response from tokens
)"""


def last_at(ids: str, pattern: str) -> str:
    return f"""case when len({pattern}) = 0 then len({ids}) else coalesce(list_max(list_filter(
      range(len({ids}) - len({pattern}) + 1), lambda i: {ids}[i + 1 : i + len({pattern})] = {pattern})), -1) end"""


LABELS = f"""{TOKENS},
cut as (select doc_id, ids, response from responses),
found as (
  select *, {last_at('ids', '[2, 3]')} as marker_at, {last_at('ids', 'response')} as response_at,
    list_max(list_filter(range(len(ids)), lambda i: ids[i + 1] = 7)) as last_eos from cut
),
starts as (
  select *, case when marker_at >= 0 then marker_at + 2 when response_at >= 0 then response_at
                 else len(ids) // 2 end as loss_start from found
),
labelled as (
  select *, list_transform(range(len(ids)), lambda i: case when i = last_eos then ids[i + 1]
      when ids[i + 1] = 7 or i < loss_start then -100 else ids[i + 1] end) as labels from starts
)"""

# -- measures ---------------------------------------------------------------------------

EPISODES = f"""
episode_steps as (
  select cast(user_id as bigint) as episode_id, e, step, ((e * 3) % 80) / 4.0e0 as x, 0.0e0 as y,
    ((e * 5) % 80) / 4.0e0 as z, value / 10 as distance_to_goal, k / 100.0e0 as spl
  from (select user_id, event_id as e, value, {K} as k,
          row_number() over (partition by user_id order by ts, event_id) - 1 as step from events)
),
legs as (
  select *, coalesce(sqrt((x - lag(x) over w) * (x - lag(x) over w) + (z - lag(z) over w) * (z - lag(z) over w)), 0) as leg
  from episode_steps window w as (partition by episode_id order by step)
),
running as (
  select *, sum(leg) over w as path_length, min(distance_to_goal) over w as oracle_navigation_error,
    max(case when distance_to_goal < 3.0 then 1.0e0 else 0.0e0 end) over w as oracle_success,
    greatest(max(case when step > 0 then spl end) over w, 0.0e0) as oracle_spl,
    first_value(distance_to_goal) over w as start, cast(step as double) as steps_taken
  from legs window w as (partition by episode_id order by step rows unbounded preceding)
),
measured as (select *, start / nullif(greatest(start, path_length), 0) as pl from running)"""


def _running(name: str) -> str:
    return f"with {EPISODES} select episode_id, step, round({name}, 6) as {name} from measured"


FINAL = f"""{EPISODES},
final as (
  select episode_id, max(path_length) as path_length, min(oracle_navigation_error) as oracle_navigation_error,
    max(oracle_success) as oracle_success, max(oracle_spl) as oracle_spl, arg_max(pl, step) as pl,
    max(steps_taken) as steps_taken, max(x) as farthest_x from measured group by episode_id
)"""
_MEASURES = ("path_length", "oracle_navigation_error", "oracle_success", "oracle_spl", "pl", "steps_taken")

# A sixth of the steps is missing, a tenth comes too late.
GAPS = (
    FINAL.replace("from episode_steps window", "from episode_steps where e % 6 <> 1 and e % 10 <> 3 window")
    .replace("first_value(distance_to_goal) over w", "max(case when step = 0 then distance_to_goal end) over w")
    .replace("cast(step as double)", "cast(count(case when step > 0 then 1 end) over w as double)")
)


def _final(*names: str) -> str:
    return f"with {FINAL} select episode_id, {', '.join(f'round({n}, 6) as {n}' for n in names)} from final"


# -- maps ---------------------------------------------------------------------------------

MAP_POINTS = f"""{EPISODES},
placed as (
  select episode_id as map_id, step, cast(trunc(z / 0.3125) as bigint) as r, cast(trunc(x / 0.3125) as bigint) as c
  from episode_steps
),
moved as (
  select episode_id as map_id, step, cast(trunc((z - 2.5) / 0.3125) as bigint) as r,
    cast(trunc((x - 2.5) / 0.3125) as bigint) as c from episode_steps
),
mirrored as (select map_id, step, r as row1, c as col1, 63 - c as row2, r as col2 from placed),
paired as (
  select a.map_id, a.step, a.r as row1, a.c as col1, b.r as row2, b.c as col2
  from placed a join placed b on b.map_id = a.map_id and b.step = a.step + 1
)"""


def _dots(segments: str, gap: int, name: str) -> str:
    return f"""
{name}_len as (
  select *, sqrt(cast((row2 - row1) * (row2 - row1) + (col2 - col1) * (col2 - col1) as double)) as length from {segments}
),
{name} as (
  select map_id, step, i,
    cast(trunc(row1 * (1.0e0 - i * {gap}.0e0 / length) + row2 * (i * {gap}.0e0 / length) + 0.5e0) as bigint) as r,
    cast(trunc(col1 * (1.0e0 - i * {gap}.0e0 / length) + col2 * (i * {gap}.0e0 / length) + 0.5e0) as bigint) as c
  from {name}_len, lateral (select unnest(range(cast(ceil(length / {gap}.0e0) as bigint))) as i) where length > 0
)"""


def _dashes(dots: str, name: str) -> str:
    return f"""
{name} as (
  select a.map_id, a.step, a.r as row1, a.c as col1, b.r as row2, b.c as col2
  from {dots} a join {dots} b on b.map_id = a.map_id and b.step = a.step and b.i = a.i + 1 where b.i % 2 = 1
)"""


def _lines(segments: str, name: str) -> str:
    return f"""
{name}_span as (select *, greatest(abs(row2 - row1), abs(col2 - col1)) as n from {segments}),
{name} as (
  select map_id, step,
    case when n = 0 then row1 else row1 + cast(floor(((row2 - row1) * k * 2 + n) / (n * 2.0e0)) as bigint) end as r,
    case when n = 0 then col1 else col1 + cast(floor(((col2 - col1) * k * 2 + n) / (n * 2.0e0)) as bigint) end as c
  from {name}_span, lateral (select unnest(range(n + 1)) as k)
)"""


def _square(points: str, name: str, half: int = 2) -> str:
    return f"""
{name} as (
  select p.map_id, p.step, r + dr as r, c + dc as c from {points} p, range(-{half}, {half + 1}) a(dr), range(-{half}, {half + 1}) b(dc)
  where r + dr between 0 and 63 and c + dc between 0 and 63
)"""


def _triangle(points: str, name: str, half: int) -> str:
    return f"""
{name} as (
  select p.map_id, p.step, r + dr as r, c + dc as c from {points} p, range(-{half}, {half + 1}) a(dr), range(-{half}, {half + 1}) b(dc)
  where abs(dc) <= (dr + {half}) // 2 and r + dr between 0 and 63 and c + dc between 0 and 63
)"""


def _layer(rows: str, code: int) -> str:
    return f"select distinct map_id, r as row, c as col, {code} as code from {rows}"


INSIDE = "where r between 0 and 63 and c between 0 and 63"
STARTS = "starts as (select * from placed where step = 0), goals as (select * from placed where step = 5)"
PALETTE = """
palette(code, r, g, b) as (values (0, 255, 255, 255), (1, 150, 150, 150), (2, 50, 50, 50), (3, 150, 150, 150),
  (4, 0, 0, 200), (5, 150, 150, 150), (6, 200, 0, 0), (7, 0, 200, 0), (8, 245, 150, 150), (9, 0, 175, 0),
  (10, 0, 0, 0), (11, 0, 0, 0), (12, 255, 255, 0), (13, 255, 165, 0), (14, 0, 150, 0))"""
RASTER = """
raster as (
  select vec_id as map_id, label, i, i // 8 as r, i % 8 as c, cast(embedding[i + 1] as double) as v
  from embeddings, range(64) t(i)
)"""
NODES = """
nodes as (
  select cast(label as varchar) as scene_id, vec_id as node_id, cast(embedding[1] as double) as x,
    cast(embedding[2] as double) * 5 as y, cast(embedding[3] as double) as z from embeddings
)"""
WALKS = f"""{EPISODES},{NODES},
walks as (
  select episode_id, cast(episode_id % 10 as varchar) as scene_id, step,
    ((e * 3) % 80) / 100.0e0 - 0.4e0 as x, ((e * 5) % 80) / 100.0e0 - 0.4e0 as z from episode_steps
),
ranked_starts as (
  select episode_id, n.scene_id, node_id, row_number() over (partition by episode_id
    order by sqrt((n.x - w.x) * (n.x - w.x) + (n.z - w.z) * (n.z - w.z)), node_id) as place
  from walks w join nodes n using (scene_id) where step = 0
),
hops as (
  select scene_id, node_id as src, lead(node_id, 1) over s as one, lead(node_id, 3) over s as three
  from nodes window s as (partition by scene_id order by node_id)
),
edges as (
  select scene_id, src, one as dst, src * 2 as edge_order from hops where one is not null
  union all select scene_id, src, three, src * 2 + 1 from hops where three is not null
),
options as (
  select o.*, n.x as to_x, n.z as to_z from (
    select scene_id, src as node_id, dst as to_id, edge_order + 1 as rank from edges
    union all select scene_id, dst, src, edge_order + 1 from edges
    union all select scene_id, node_id, node_id, 0 from nodes) o
  join nodes n on n.scene_id = o.scene_id and n.node_id = o.to_id
)"""


def _resized(rows: int, cols: int) -> str:
    return f"""with {RASTER}
select map_id, a.i as out_row, b.i as out_col, round(avg(v), 6) as value
from raster join range({rows}) a(i) on r >= floor(a.i * 8 / {rows}.0e0) and r < ceil((a.i + 1) * 8 / {rows}.0e0)
join range({cols}) b(i) on c >= floor(b.i * 8 / {cols}.0e0) and c < ceil((b.i + 1) * 8 / {cols}.0e0)
group by all"""


WANTED = f"""{NAV_STEPS},
wanted as (
  select root, printf('%s/%s/rgb/step_%04d.jpg', scene_id, task_id, step) as rel_path, scene_id, step,
    printf('%s/rgb/step_%04d', task_id, step) as below, printf('%s/%s/rgb/step_%04d', scene_id, task_id, step) as bare
  from nav_steps where action is not null
)"""

NEAREST_NODE = f"""with {NODES},
pairs as (
  select p.node_id as point_id, n.node_id, sqrt((n.x - (p.x + 0.05)) * (n.x - (p.x + 0.05)) + (n.z - p.z) * (n.z - p.z)) as d
  from nodes p join nodes n using (scene_id)
)
select point_id, node_id, round(d, 6) as distance from pairs
qualify row_number() over (partition by point_id order by d, node_id) = 1"""

_NEXT = """paired as (
  select * from (select map_id, step, r as row1, c as col1, lead(r) over p as row2, lead(c) over p as col2 from placed
    window p as (partition by map_id order by step)) where row2 is not null
)"""
_PAIRED = MAP_POINTS[MAP_POINTS.index("paired as (") :]
GAP_POINTS = MAP_POINTS.replace(_PAIRED, _NEXT).replace(
    "  from episode_steps\n),\nmoved", "  from episode_steps where step % 5 <> 2 and step <> 7\n),\nmoved"
)

TRACKED = f"""with recursive {WALKS},
tracked as (
  select episode_id, cast(-1 as bigint) as step, node_id from ranked_starts where place = 1
  union all
  select episode_id, step, to_id from (
    select w.episode_id, w.step, o.to_id, row_number() over (partition by w.episode_id
      order by sqrt((to_x - w.x) * (to_x - w.x) + (to_z - w.z) * (to_z - w.z)), rank) as place
    from tracked t join walks w on w.episode_id = t.episode_id and w.step = t.step + 1
    join options o on o.scene_id = w.scene_id and o.node_id = t.node_id) where place = 1
)
select episode_id, step, node_id from tracked where step >= 0"""


ORACLES: dict[str, str] = {
    "S1_load_tasks": f"""with {DOCUMENTS}
select cast(kind as varchar) as root, task_no as task_idx, task_id, schema_version, n_actions,
  case when defect in (0, 1) then null else 'goal' end as goal_world, defect in (4, 5, 6) as success from doc_tasks""",
    # The list of a root's only document holds the tasks of all its parts.
    "S1_load_large_tasks": f"""with {DOCUMENTS}
select cast(kind as varchar) as root, row_number() over (partition by kind order by user_no // 400, task_no) - 1 as task_idx, task_id, schema_version, n_actions,
  case when defect in (0, 1) then null else 'goal' end as goal_world, defect in (4, 5, 6) as success from doc_tasks""",
    "S3_load_large_conversations": f"""with {TURNS}
select row_number() over (order by conv_id) - 1 as item_idx, case when conv_id % 3 = 0 then 'v' || conv_id end as video_path,
  n_images, md5(prompt) as prompt_md5, md5(response) as response_md5 from flat""",
    "S2_union_roots": f"""with {DOCUMENTS}
select case when kind in (0, 2) then 'even' else 'odd' end as root, case when kind in (0, 2) then 1 else 0 end as root_no,
  task_id, schema_version, true as unique_key, task_no as task_idx from doc_tasks""",
    "S1_corrupt_documents": f"""with {DOCUMENTS}
select distinct root, cast(null as varchar) as task_id, 'unreadable_document' as rule from doc_tasks where kind = 1
union all
select root, task_id, 'unreadable_field' from doc_tasks t where kind = 3
  and exists (select 1 from doc_steps d where d.task_idx = t.user_no and d.step = 0 and doc_action = 1)""",
    "V1_empty_document": f"""with {DOCUMENTS}
select distinct root, case kind when 2 then 'schema_version' else 'generation_config' end as rule,
  case kind when 2 then '4' else 'update_interval, waypoint_radius_m' end as detail from doc_tasks where kind in (2, 3)""",
    "S3_corrupt_items": """
select conv_id // 50 as file, case when conv_id // 50 % 3 = 1 then 0 else count(distinct conv_id) end as items,
  case when conv_id // 50 % 3 = 1 then 'unreadable_file' end as reason from conversations group by conv_id // 50""",
    "S4_two_roots": f"""with {WANTED},
store as (
  select case step % 4 when 1 then '*' else scene_id end as store,
    case step % 4 when 0 then below when 1 then bare else rel_path end as key from wanted where step % 4 <> 3
  union all select '*', rel_path from wanted where step % 8 = 0
),
tries as (
  select rel_path, unnest([0, 1, 2, 3, 4, 5]) as priority,
    unnest([scene_id, scene_id, scene_id, '*', '*', '*']) as store,
    unnest([below, bare, rel_path, below, bare, rel_path]) as key from wanted
),
best as (
  select rel_path, priority, store, key from tries join store using (store, key)
  qualify row_number() over (partition by rel_path order by priority) = 1
)
select r.root, w.rel_path, priority, store, key, r.root || ':' || store || ':' || key as content
from (select distinct rel_path from wanted) w cross join (values ('a'), ('b')) r(root) left join best using (rel_path)""",
    "S3_load_conversations": f"""with {TURNS},
items as (select *, conv_id // 50 as file, row_number() over (partition by conv_id // 50 order by conv_id) - 1 as item_idx from flat)
select file, item_idx, case when conv_id % 5 <> 0 then 'c' || conv_id else cast(item_idx as varchar) end as item_id,
  case when conv_id % 3 = 0 then 'v' || conv_id end as video_path, n_images, md5(prompt) as prompt_md5,
  md5(response) as response_md5 from items""",
    "S4_resolve_images": f"""with {WANTED},
store as (
  select case step % 4 when 1 then '*' else scene_id end as store,
    case step % 4 when 0 then below when 1 then bare else rel_path end as key from wanted where step % 4 <> 3
  union all select '*', rel_path from wanted where step % 8 = 0
),
tries as (
  select root, rel_path, unnest([0, 1, 2, 3, 4, 5]) as priority,
    unnest([scene_id, scene_id, scene_id, '*', '*', '*']) as store,
    unnest([below, bare, rel_path, below, bare, rel_path]) as key from wanted
),
best as (
  select root, rel_path, priority, store, key from tries join store using (store, key)
  qualify row_number() over (partition by root, rel_path order by priority) = 1
)
select w.root, w.rel_path, priority, store, key, store || ':' || key as content
from wanted w left join best using (root, rel_path)""",
    "S7_mixed_corpus": f"""with {samples(3)},{TURNS}
select 'navigation' as kind, root as source, task_idx || '/' || step as sample_id, md5(prompt) as prompt_md5, response,
  concat_ws(' ', hist_paths, printf('%s/%s/%s/rgb/step_%04d.jpg', root, scene_id, task_id, step)) as images,
  coalesce(n_hist, 0) + 1 as n_images from samples
union all
select 'conversation', 'chat', 'c' || conv_id, md5(prompt), response, '', n_images from flat""",
    "A4_collate": f"""with {samples(3)},{TURNS},
texts as (
  select 'navigation/' || root || '/' || task_idx || '/' || step as key, prompt, response from samples
  union all select 'conversation/chat/c' || conv_id, prompt, response from flat
),
coded as (
  select key, list_transform(string_split(response, ' '), lambda w: length(w)) as response,
    list_concat(list_concat(list_transform(string_split(prompt, ' '), lambda w: length(w)), [2, 3]),
      list_concat(list_transform(string_split(response, ' '), lambda w: length(w)), [7]))[1:4096] as ids from texts
),
found as (
  select *, {last_at('ids', '[2, 3]')} as marker_at, {last_at('ids', 'response')} as response_at,
    list_max(list_filter(range(len(ids)), lambda i: ids[i + 1] = 7)) as last_eos from coded
),
starts as (
  select *, case when marker_at >= 0 then marker_at + 2 when response_at >= 0 then response_at
                 else len(ids) // 2 end as loss_start from found
),
numbered as (
  select *, {seeded(2**60, 'key')} as number, list_transform(range(len(ids)), lambda i: case when i = last_eos then ids[i + 1]
      when ids[i + 1] = 7 or i < loss_start then -100 else ids[i + 1] end) as labels from starts
),
placed as (
  select *, number % shards as shard, (row_number() over (partition by number % shards order by number, key) - 1) // 8 as batch_id
  from numbered, (select greatest(1, cast(ceil(count(*) / 65536.0) as bigint)) as shards from numbered)
),
sized as (select *, max(len(ids)) over (partition by shard, batch_id) - len(ids) as missing, len(ids) as n from placed)
select key, shard, batch_id,
  md5(array_to_string(list_concat(ids, list_transform(range(missing), lambda i: 0)), ',')) as input_ids,
  md5(array_to_string(list_concat(labels, list_transform(range(missing), lambda i: -100)), ',')) as labels,
  md5(array_to_string(list_transform(range(n + missing), lambda i: case when i < n then 1 else 0 end), ',')) as attention_mask
from sized""",
    "S5_check_image_files": f"""with {WANTED}
select rel_path as path, case when step % 4 = 3 then 'missing' else 'empty' end as reason
from wanted where step % 4 = 3 or step % 5 = 0""",
    "S6_corpus_counts": f"""with {indexed(3)}
select coalesce(root, 'total') as root, sum(tasks)::bigint as tasks, sum(samples)::bigint as samples from (
  select root, count(distinct task_idx) as tasks, 0 as samples from nav_steps group by root
  union all select root, 0, count(*) from indexed where is_sample group by root) group by rollup (root)""",
    "P1_explode_steps": f"""with {DOCUMENTS},
listed as (
  select task_idx, step, string_agg(coalesce(cast(u as varchar), 'null'), ',' order by i) as cand_u,
    string_agg(coalesce(cast(vis as varchar), 'null'), ',' order by i) as cand_vis from nav_cands group by all
)
select task_id, step, doc_action as action, n_cand as n_pix, n_cand as n_world, n_cand as n_vis,
  coalesce(cand_u, '') as cand_u, coalesce(cand_vis, '') as cand_vis, traj_u as traj_px_u, traj_v as traj_px_v, traj_x,
  traj_status, doc_endpoint as is_endpoint, doc_transition as floor_transition, expert_idx,
  case when defect = 3 and step = last_step then null else floor_id end as floor_id, floor_height
from doc_steps left join listed using (task_idx, step)""",
    **{
        f"P2_valid_steps_v{v}": f"with {classified(v)} select task_idx, step, action, pos from valid" for v in (2, 3)
    },
    "P3_visible_frontiers": f"""with {NAV_STEPS}
select s.task_idx, s.step, count(i) as n_frontiers, coalesce(string_agg(u || ':' || v, ',' order by i), '') as frontiers
from nav_steps s left join nav_cands c on c.task_idx = s.task_idx and c.step = s.step and u is not null and vis = 0
  and not floor_transition group by all""",
    "P4_image_path": f"""with {NAV_STEPS}
select task_idx, step, printf('%s/%s/%s/rgb/step_%04d.jpg', root, scene_id, task_id, step) as path,
  printf('%s/%s/%s/rgb/step_%04d.jpg', root, scene_id, task_id, step + 9990) as far_path from nav_steps""",
    "P5_action_display": f"""select event_id as e,
  case {K} % 6 when 0 then 'STOP' when 1 then 'FORWARD' when 2 then 'TURN_LEFT' when 3 then 'TURN_RIGHT'
    else 'UNKNOWN(' || ({K} % 6) || ')' end as name,
  case {K} % 6 when 0 then '⏹' when 1 then '↑' when 2 then '←' when 3 then '→'
    else 'UNKNOWN(' || ({K} % 6) || ')' end as symbol from events""",
    "P6_format_coords": f"""with {NAV_STEPS}
select s.task_idx, s.step, '[' || coalesce(string_agg('(' || u || ', ' || v || ')', ', ' order by i) filter (u is not null), '') || ']'
  as listed from nav_steps s left join nav_cands c on c.task_idx = s.task_idx and c.step = s.step group by s.task_idx, s.step""",
    "P7_build_prompt": f"with {samples(3)} select task_idx, step, prompt from samples",
    "P8_build_response": f"""with {samples(3)}
select task_idx, step, response, length(response) as range_end,
  case mode when 'stop' then 0 when 'frontier' then 17 else 8 end as content_start from samples""",
    **{
        f"P9_assemble_sample_v{v}": f"""with {samples(v)}
select root, task_idx, step, mode as output_mode, prompt, response,
  concat_ws(' ', hist_paths, printf('%s/%s/%s/rgb/step_%04d.jpg', root, scene_id, task_id, step)) as images,
  case when mode in ('target', 'frontier') then hit_u end as label_coords_u,
  case when mode in ('target', 'frontier') then hit_v end as label_coords_v,
  case when mode = 'action' then array_to_string(list_transform(range(emitted), lambda n: action), ',') end as action_sequence,
  floor_transition, floor_id, floor_height from samples"""
        for v in (2, 3)
    },
    "P10_content_parts": f"""with {TURNS},
cut as (select conv_id, n_images, string_split(prompt, '<image>') as seg from flat),
pieces as (
  select conv_id, i, 0 as half, 'text' as type, seg[i + 1] as text, null as image_idx
  from cut, lateral (select unnest(range(len(seg))) as i) where seg[i + 1] <> ''
  union all
  select conv_id, i, 1, 'image', null, i from cut, lateral (select unnest(range(len(seg) - 1)) as i) where i < n_images
)
select conv_id, row_number() over (partition by conv_id order by i, half) - 1 as part, type, text, image_idx from pieces""",
    "P11_endpoint_flag_v2": f"with {NAV_STEPS} select task_idx, step, false as endpoint from nav_steps",
    "P11_endpoint_flag_v3": f"with {NAV_STEPS} select task_idx, step, is_endpoint as endpoint from nav_steps",
    "V1_schema_version": _rule("schema_version", "kind = 2", "'4'"),
    "V2_generation_config": _rule("generation_config", "kind = 3", "'update_interval, waypoint_radius_m'"),
    "V3_required_keys": _rule("required_keys", "v3 and defect = 0", "'goal_world, final_geodesic_distance'"),
    "V4_goal_metadata": _rule("goal_metadata", "v3 and defect in (0, 1)", "cast(null as varchar)"),
    "V5_no_actions": _rule("no_actions", "v3 and defect = 2", "cast(null as varchar)"),
    "V6_array_lengths": _rule("array_lengths", "v3 and defect = 3", "'floor_ids'"),
    "V7_success_mismatch": _rule("success_mismatch", "v3 and defect = 4", "'max_steps'"),
    "V8_unverifiable_stop": _rule(
        "unverifiable_stop",
        "v3 and defect = 5 and not coalesce(n_stops = 1 and last_stop = last_step, false)",
        "coalesce(stops, '')",
    ),
    "V9_failed_with_stop": _rule("failed_with_stop", "v3 and defect not in (5, 6) and n_stops > 0", "stops"),
    "V10_transition_supervised": _step_rule(
        "transition_supervised",
        "doc_transition and (n_cand > 0 or traj_u is not null or expert_idx is not null or doc_endpoint)",
    ),
    "V11_invalid_endpoint": _step_rule("invalid_endpoint", "doc_endpoint and not coalesce(goal_distance <= 3.0, false)"),
    "V12_legacy_summary": f"""with {DOCUMENTS},
counted as (
  select (select count(*) from doc_steps where kind = 1 and doc_action = 0) as skipped_stops,
    (select count(*) from doc_steps where kind = 1 and traj_u is not null) as disabled_target_frames,
    (select count(*) from doc_tasks where kind = 1 and n_actions = 0) as abnormal_tasks
)
select * from counted""",
    "D1_closest_candidate": f"""with {NAV_STEPS},{NEAREST}
select task_idx, step, near_idx as idx, round(near_dist, 6) as dist from nav_steps left join nearest using (task_idx, step)""",
    **{
        name: f"""with {classified(v, metres)}
select task_idx, step, mode, case when mode in ('target', 'frontier') then hit_u end as label_u,
  case when mode in ('target', 'frontier') then hit_v end as label_v, coord_supervised from classified"""
        for name, v, metres in (
            ("D2_output_mode_v2", 2, 2.0),
            ("D2_output_mode_v3", 3, 2.0),
            ("D3_match_threshold_3m_v2", 2, 3.0),
        )
    },
    **{
        f"D4_coord_supervised_v{v}": f"""with {classified(v)}
select task_idx, count(*) filter (coord_supervised) as supervised,
  count(*) filter (mode in ('target', 'frontier')) as labelled,
  count(*) filter (coord_supervised <> coalesce(mode in ('target', 'frontier'), false)) as different
from classified group by task_idx"""
        for v in (2, 3)
    },
    **{
        f"W1_sample_index_v{v}": f"""with {indexed(v)}
select root, task_idx, step, mode, absorbed, emitted from indexed where is_sample"""
        for v in (2, 3)
    },
    **{
        f"W2_action_sequence_v{v}": f"""with {indexed(v)}
select task_idx, step, array_to_string(list_transform(range(emitted), lambda n: action), ',') as sequence from indexed"""
        for v in (2, 3)
    },
    **{f"W3_history_frames_v{v}": history_frames(v) for v in (2, 3)},
    **{
        # Two long tasks; each change of the user is an interruption.
        f"W3_history_many_gaps_v{v}": history_frames(v).replace(
            "cast(user_id as bigint) as task_idx, e, k, step,",
            "cast(user_id % 2 as bigint) as task_idx, e, k, user_id * 1000 + step as step,",
        )
        for v in (2, 3)
    },
    "W4_video_frame_plan": """with videos as (
  select conv_id, case when conv_id % 9 = 0 then null when conv_id % 7 = 0 then 0 when conv_id % 5 = 0
      then sum(length(text))::bigint % 8 else sum(length(text))::bigint end as n from conversations group by conv_id
)
select conv_id, slot, case when n > 0 then case when slot = 7 then n - 1
    else cast(floor(slot * ((n - 1) / 7.0e0)) as bigint) end end as frame_no,
  not coalesce(n > 0, false) as is_placeholder,
  case when n is null then 'not_found' when n <= 0 then 'no_frames' end as reason
from videos, range(8) t(slot)""",
    **{
        f"A1_mode_stats_v{v}": f"""with {indexed(v)}
select m.mode, count(i.mode) as samples from (values ('frontier'), ('target'), ('action'), ('stop')) m(mode)
left join indexed i on i.mode = m.mode and is_sample group by m.mode"""
        for v in (2, 3)
    },
    "A2_flatten_conversation": f"with {TURNS} select conv_id, prompt, response, n_images from flat",
    "A3_pad_batch": f"""with {LABELS},
numbered as (select *, {seeded(2**60, 'doc_id')} as number from labelled),
placed as (
  select *, number % shards as shard, (row_number() over (partition by number % shards order by number, doc_id) - 1) // 8 as batch_id
  from numbered, (select greatest(1, cast(ceil(count(*) / 65536.0) as bigint)) as shards from documents)
),
sized as (select *, max(len(ids)) over (partition by shard, batch_id) - len(ids) as missing, len(ids) as n from placed)
select doc_id, shard, batch_id,
  array_to_string(list_concat(ids, list_transform(range(missing), lambda i: 0)), ',') as input_ids,
  array_to_string(list_concat(labels, list_transform(range(missing), lambda i: -100)), ',') as labels,
  array_to_string(list_transform(range(n + missing), lambda i: case when i < n then 1 else 0 end), ',') as attention_mask
from sized""",
    "T1_last_subsequence": f"""with {TOKENS}
select doc_id, {last_at('ids', '[2, 3]')} as marker_at, {last_at('ids', 'response')} as response_at, len(ids) as empty_at
from responses""",
    "T2_mask_labels": f"with {LABELS} select doc_id, loss_start, array_to_string(labels, ',') as labels from labelled",
    "T3_truncate_ids": f"""with {TOKENS}
select doc_id, least(len(ids), 4096) as length, array_to_string(ids[1:4096], ',') as input_ids from tokens""",
    "T4_attention_mask": f"""with {TOKENS}
select doc_id, array_to_string(list_transform(ids, lambda t: 1), ',') as mask from tokens""",
    "M0_euclidean": f"""with {EPISODES}
select episode_id, step, round(sqrt((x - distance_to_goal) * (x - distance_to_goal) + (y - spl) * (y - spl)
  + (z - 1.0) * (z - 1.0)), 6) as distance from episode_steps""",
    "M1_path_length": _running("path_length"),
    "M2_oracle_navigation_error": _running("oracle_navigation_error"),
    "M3_oracle_success": _running("oracle_success"),
    "M4_oracle_spl": _running("oracle_spl"),
    "M5_pl_ratio": _running("pl"),
    "M6_steps_taken": _running("steps_taken"),
    "M7_measure_table": _final(*_MEASURES, "farthest_x"),
    "M8_stream_measures": _final(*_MEASURES),
    "M8_stream_measures_gaps": f"""with {GAPS}
select e.episode_id, e.late_rows, {', '.join(f'round({n}, 6) as {n}' for n in _MEASURES)}
from (select episode_id, count(*) filter (e % 10 = 3) as late_rows from episode_steps where e % 6 <> 1 group by episode_id) e
left join final using (episode_id)""",
    "G1_to_grid": f"""with {EPISODES}
select episode_id as map_id, step, cast(trunc((z - 2.0e0) / (16.0e0 / 48)) as bigint) as row,
  cast(trunc((x - 1.0e0) / (16.0e0 / 64)) as bigint) as col from episode_steps""",
    "G2_colorize_cells": f"""with {RASTER},{PALETTE},
cells as (
  select map_id, r as row, c as col, cast(floor(abs(v) * 1000) as bigint) % 16 as code,
    cast(floor(abs(v) * 10000) as bigint) % 2 as fog from raster
),
dimmed as (select *, case when code <> 0 and fog = 0 then 2 else 1 end as part from cells)
select map_id, row, col, r // part as r, g // part as g, b // part as b from dimmed left join palette using (code)""",
    "G3_densify_segment_dotted": f"""with {MAP_POINTS},{_dots('mirrored', 15, 'dots')}
select map_id, step, r as row, c as col from dots""",
    "G3_densify_segment_dashed": f"""with {MAP_POINTS},{_dots('mirrored', 10, 'dots')},{_dashes('dots', 'dashes')},{_lines('dashes', 'lines')}
select map_id, step, r as row, c as col from lines""",
    "G3_densify_segment_filled": f"""with {MAP_POINTS},{_lines('mirrored', 'lines')}
select map_id, step, r as row, c as col from lines""",
    "G4_stamp_square": f"with {MAP_POINTS},{_square('placed', 'squares')} select map_id, step, r as row, c as col from squares",
    "G5_stamp_triangle": f"""with {MAP_POINTS},{_triangle('placed', 'triangles', 2)}
select map_id, step, r as row, c as col from triangles""",
    "G6_reference_path_layer": f"""with {MAP_POINTS},{_dots('paired', 10, 'dots')},{_dashes('dots', 'dashes')},{_lines('dashes', 'lines')},
{_square('placed', 'squares')}
select distinct map_id, r as row, c as col, 14 as code from (select map_id, r, c from lines {INSIDE}
  union all select map_id, r, c from squares)""",
    "G6_reference_path_gaps": f"""with {GAP_POINTS},{_dots('paired', 10, 'dots')},{_dashes('dots', 'dashes')},{_lines('dashes', 'lines')},
{_square('placed', 'squares')}
select distinct map_id, r as row, c as col, 14 as code from (select map_id, r, c from lines {INSIDE}
  union all select map_id, r, c from squares)""",
    "G7_straight_path_gaps": f"with {GAP_POINTS},{_lines('paired', 'lines')} {_layer('lines', 14)} {INSIDE}",
    "G7_straight_path_layer": f"with {MAP_POINTS},{_lines('paired', 'lines')} {_layer('lines', 14)} {INSIDE}",
    "G8_endpoints_layer": f"""with {MAP_POINTS},{STARTS},{_square('starts', 'first')},{_square('goals', 'last')}
select map_id, row, col, max(code) as code from ({_layer('first', 4)} union all {_layer('last', 6)}) group by all""",
    "G9_waypoint_layer_prediction": f"""with {MAP_POINTS},
shown as (select * from moved where r > 0 and r < 64 and c > 0 and c < 64),{_triangle('shown', 'triangles', 2)}
{_layer('triangles', 12)}""",
    "G9_waypoint_layer_oracle": f"with {MAP_POINTS},{_triangle('moved', 'triangles', 1)} {_layer('triangles', 13)}",
    "G10_nearest_node": NEAREST_NODE,
    "G11_track_nearest_node": TRACKED,
    "G11_track_tiles": TRACKED,
    "G10_nearest_node_deep": NEAREST_NODE,
    "G10_points_without_nodes": f"""with {NODES},
points as (
  select node_id as point_id, case when node_id % 5 = 0 then 'nowhere' else scene_id end as scene_id,
    case when node_id % 7 <> 0 then x + 0.05 end as x, z from nodes
),
pairs as (
  select p.point_id, n.node_id, sqrt((n.x - p.x) * (n.x - p.x) + (n.z - p.z) * (n.z - p.z)) as d
  from points p join nodes n using (scene_id) where p.x is not null and n.node_id % 3 <> 0
),
best as (select *, row_number() over (partition by point_id order by d, node_id) as place from pairs)
select p.point_id, b.node_id, round(b.d, 6) as distance from points p
left join best b on b.point_id = p.point_id and place = 1""",
    "G11_track_gaps": f"""with recursive {WALKS},
kept as (
  select *, row_number() over (partition by episode_id order by step) - 1 as place from walks
  where not (step between 14 and 40 or (episode_id % 3 = 0 and step < 5) or (step % 11 = 3))
),
tracked as (
  select episode_id, cast(-1 as bigint) as place, cast(-1 as bigint) as step, node_id from ranked_starts
  where place = 1 and episode_id % 5 <> 4
  union all
  select episode_id, place, step, to_id from (
    select w.episode_id, w.place, w.step, o.to_id, row_number() over (partition by w.episode_id
      order by sqrt((to_x - w.x) * (to_x - w.x) + (to_z - w.z) * (to_z - w.z)), rank) as choice
    from tracked t join kept w on w.episode_id = t.episode_id and w.place = t.place + 1
    join options o on o.scene_id = w.scene_id and o.node_id = t.node_id) where choice = 1
)
select k.episode_id, k.step, t.node_id from kept k left join tracked t on t.episode_id = k.episode_id and t.place = k.place""",
    "G12_same_floor_nodes": f"""with recursive {NODES},{RASTER},
valid as (
  select distinct cast(label as varchar) as scene_id, i as r, cast(floor(abs(v) * 1000) as bigint) % 64 as c from raster
),
entry as (select scene_id, arg_min(x, node_id) + 0.05 as sx, arg_min(z, node_id) as sz from nodes group by scene_id),
floors as (
  select scene_id, y as floor_y from entry join nodes using (scene_id)
  qualify row_number() over (partition by scene_id order by sqrt((x - sx) * (x - sx) + (z - sz) * (z - sz)), node_id) = 1
),
near as (
  select * from (select scene_id, node_id, cast(trunc((z - -0.4e0) / (abs(0.4e0 - -0.4e0) / 64)) as bigint) as r,
      cast(trunc((x - -0.4e0) / (abs(0.4e0 - -0.4e0) / 64)) as bigint) as c
    from nodes join floors using (scene_id) where abs(y - floor_y) < 1.0)
  where r between 0 and 63 and c between 0 and 63
),
drawn as (
  select n.* from near n join valid v using (scene_id, r, c)
  union
  select n.* from drawn d join near n on n.scene_id = d.scene_id and n.node_id > d.node_id
    and abs(n.r - d.r) <= 2 and abs(n.c - d.c) <= 2
),
marked as (select scene_id as map_id, node_id as step, r, c from drawn),{_square('marked', 'squares')}
{_layer('squares', 7)}""",
    "G13_resize_area_4x4": _resized(4, 4),
    "G13_resize_area_3x5": _resized(3, 5),
    "G14_compose_layers": f"""with {MAP_POINTS},{_lines('paired', 'lines')},{STARTS},{_square('starts', 'first')},{_square('goals', 'last')},
{_triangle('moved', 'triangles', 1)},
stacked as (
  select 0 as z, * from ({_layer('lines', 14)} {INSIDE}) union all select 1, * from ({_layer('first', 4)})
  union all select 2, * from ({_layer('last', 6)}) union all select 3, * from ({_layer('triangles', 13)})
)
select map_id, row, col, arg_max(code, z) as code from stacked group by all""",
    "R1_resample_failed": f"""with {indexed(3)},
marked as (select task_idx, step, mode, step % 4 = 3 as failed, {seeded(2**60, 'task_idx', 'step')} as number from indexed where is_sample),
total as (select count(*) as n, cast(ceil(count(*) / 65536.0) as bigint) as buckets from marked where not failed),
good as (
  select m.*, row_number() over (order by number % buckets, number, task_idx, step) - 1 as place from marked m, total
  where not failed
),
lost as (select task_idx, step, {seeded(2**60, 'task_idx', 'step', seed=43)} % n as place from marked, total where failed)
select task_idx, step, mode, task_idx as from_task_idx, step as from_step, false as replaced from good
union all
select l.task_idx, l.step, g.mode, g.task_idx, g.step, true from lost l join good g using (place)""",
}
