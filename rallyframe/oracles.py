"""DuckDB SQL for the queries, written from the definitions and apart from the operators."""

from __future__ import annotations

_H = ("(1.49576825363e-2 * {x} + 5.13622264648e-3 * {y} - 4.57291682326e0) / (1.0272445293e-3 * {y} + 1e0)", "(2.40696922776e1 - 3.597861327e-2 * {y}) / (1.0272445293e-3 * {y} + 1e0)")


def _court(x: str, y: str) -> tuple[str, str]:
    return _H[0].format(x=x, y=y), _H[1].format(x=x, y=y)


#: Named parts in an order in which each uses only those before it.
PARTS: dict[str, str] = {
    "ball_raw": """
      select match_id, t + 90 * cast((t - t % 400) / 400 as bigint) as frame_idx,
             case when event_type = 'error' then null else cast(140 + abs((t * 13) % 2000 - 1000) + (v % 5) - 2 as double) end as x_px,
             case when event_type = 'error' then null
                  else cast(80 + abs((t * 11) % 1120 - 560) + (cast((v - v % 5) / 5 as bigint) % 5) - 2 as double) end as y_px,
             case when event_type = 'error' then 0e0 else cast(50 + v % 50 as double) / 1e2 end as confidence
      from (select user_id % 4 as match_id, event_type, cast(round(value * 100) as bigint) as v,
                   row_number() over (partition by user_id % 4 order by ts, event_id) - 1 as t from events) as r""",
    "players": f"""
      select match_id, frame_idx, track_id, det_seq, x as foot_x_px, y as foot_y_px, {_court('x', 'y')[0]} as foot_x_m, {_court('x', 'y')[1]} as foot_y_m
      from (select match_id, frame_idx, k as track_id, k - 1 as det_seq, cast(300 + 170 * (k - 1) + abs((t * (3 + k)) % 200 - 100) as double) as x,
                   cast(case when k % 2 = 1 then 80 + 60 * k else 480 end + abs((t * (2 + k)) % 160 - 80) as double) as y
            from (select match_id, frame_idx, row_number() over (partition by match_id order by frame_idx) - 1 as t from ball_raw) as f
            cross join (values (1), (2), (3), (4), (5)) as r(k)
            where frame_idx % 2 = 0 and (t * 7 + k * 3) % 11 <> 0 and not (k = 5 and t % 3 = 0)) as g""",
    "poses": """
      select match_id, frame_idx, track_id as pose_seq, foot_x_px + (frame_idx % 7) * 25 - 60 as px, foot_y_px as py, foot_y_px - 140 as ls_y,
             foot_y_px - 138 as rs_y, foot_y_px - 140 - ((frame_idx + track_id) % 5) * 20 + 30 as lw_y, foot_y_px - 120 as rw_y,
             cast(frame_idx % 3 as double) / 3e0 as ls_c, 9e-1 as rs_c, cast(frame_idx % 10 as double) / 1e1 as lw_c, 5e-1 as rw_c
      from players where frame_idx % 4 = 0""",
    "steps": f"""
      select *, {_court('x', 'y')[0]} as cx, {_court('x', 'y')[1]} as cy
      from (select match_id, frame_idx, x_px as x, y_px as y, x_px - lag(x_px) over w as vx0, (lead(x_px) over w) - x_px as vx1,
                   y_px - lag(y_px) over w as vy0, (lead(y_px) over w) - y_px as vy1, count(*) over (partition by match_id) as n_visible
            from ball_raw where x_px is not null window w as (partition by match_id order by frame_idx)) as q""",
    "peaks": """
      select * from steps where n_visible >= 5 and sqrt((vx1 - vx0) * (vx1 - vx0) + (vy1 - vy0) * (vy1 - vy0)) >= 25e0""",
    "hits": """
      select match_id, frame_idx, 'hit' as type, x, y, track_id, 8e-1 as confidence
      from (select b.match_id, b.frame_idx, b.x, b.y, p.track_id, sqrt((p.foot_x_m - b.cx) * (p.foot_x_m - b.cx) + (p.foot_y_m - b.cy) * (p.foot_y_m - b.cy)) as dist,
                   row_number() over (partition by b.match_id, b.frame_idx order by abs(p.frame_idx - b.frame_idx), case when p.frame_idx < b.frame_idx then 1 else 0 end,
                     sqrt((p.foot_x_m - b.cx) * (p.foot_x_m - b.cx) + (p.foot_y_m - b.cy) * (p.foot_y_m - b.cy)), p.det_seq) as rn
            from peaks b join players p on p.match_id = b.match_id and p.frame_idx between b.frame_idx - 6 and b.frame_idx + 6) as z
      where rn = 1 and dist < 2.5e0""",
    "bounces": """
      select match_id, frame_idx, 'bounce' as type, x, y, cast(null as int) as track_id, 6e-1 as confidence from steps where n_visible >= 5 and vy0 > 4 and vy1 < -4""",
    "walls": """
      select match_id, frame_idx, 'wall_hit' as type, x, y, cast(null as int) as track_id, 65e-2 as confidence from steps
      where n_visible >= 5 and ((cx < 8e-1 and vx0 < -3 and vx1 > 3) or (cx > 10 - 8e-1 and vx0 > 3 and vx1 < -3)
        or (cy < 8e-1 and vy0 < -3 and vy1 > 3) or (cy > 20 - 8e-1 and vy0 > 3 and vy1 < -3))""",
    "candidates": "select * from hits union all select * from bounces union all select * from walls",
    "kept": """
      select match_id, type, min(frame_idx) as f from candidates group by match_id, type
      union all
      select k.match_id, k.type, min(c.frame_idx) from kept k join candidates c on c.match_id = k.match_id and c.type = k.type and c.frame_idx >= k.f + 8
      group by k.match_id, k.type""",
    "ev": "select c.* from candidates c join kept k on k.match_id = c.match_id and k.type = c.type and k.f = c.frame_idx",
    "pmap": """
      select match_id, track_id, cast(rn - 1 as int) as player_id, detections
      from (select *, row_number() over (partition by match_id order by detections desc, first_frame, first_seq) as rn
            from (select match_id, track_id, count(*) as detections, min(frame_idx) as first_frame, arg_min(det_seq, frame_idx * 100 + det_seq) as first_seq
                  from players group by match_id, track_id) as c) as d
      where rn <= 4""",
    "tracked": "select p.*, m.player_id from players p join pmap m on m.match_id = p.match_id and m.track_id = p.track_id",
    "slots": "select match_id, player_id from (select distinct match_id from pmap) as m cross join (values (0), (1), (2), (3)) as s(player_id)",
    "ral": """
      select match_id, rally_idx, min(frame_idx) as start_frame, max(frame_idx) as end_frame, max_by(track_id, frame_idx) filter (where type = 'hit') as last_track
      from (select *, sum(fresh) over (partition by match_id order by frame_idx range unbounded preceding) as rally_idx
            from (select *, case when frame_idx - lag(frame_idx) over (partition by match_id order by frame_idx) > 60 then 1 else 0 end as fresh from ev) as a) as b
      group by match_id, rally_idx""",
    "outc": """
      select r.match_id, r.rally_idx, case when count(s.frame_idx) = 0 then 'unknown'
               when max_by(s.cx < 6e-1 or s.cx > 10 - 6e-1 or s.cy < 6e-1 or s.cy > 20 - 6e-1, s.frame_idx) then 'error' else 'winner' end as outcome
      from ral r left join steps s on s.match_id = r.match_id and s.frame_idx between r.end_frame - 20 and r.end_frame + 10
      group by r.match_id, r.rally_idx""",
    "won": """
      select s.match_id, s.player_id, count(*) filter (where o.outcome = 'winner') as winners, count(*) filter (where o.outcome = 'error') as errors
      from slots s left join pmap m on m.match_id = s.match_id and m.player_id = s.player_id
      left join ral r on r.match_id = m.match_id and r.last_track = m.track_id
      left join outc o on o.match_id = r.match_id and o.rally_idx = r.rally_idx
      group by s.match_id, s.player_id""",
    "dist": """
      select s.match_id, s.player_id, round(coalesce(sum(step) filter (where step < 5), 0), 2) as distance_m
      from slots s left join (
        select match_id, player_id, sqrt((foot_x_m - lag(foot_x_m) over w) * (foot_x_m - lag(foot_x_m) over w) + (foot_y_m - lag(foot_y_m) over w) * (foot_y_m - lag(foot_y_m) over w)) as step
        from tracked window w as (partition by match_id, player_id order by frame_idx, det_seq)) as t on t.match_id = s.match_id and t.player_id = s.player_id
      group by s.match_id, s.player_id""",
    "heat": """
      select match_id, player_id, ix + 5e-1 as x, iy + 5e-1 as y, n / total as weight
      from (select *, sum(n) over (partition by match_id, player_id) as total
            from (select match_id, player_id, cast(floor(least(greatest(foot_x_m, 0), 9.99e0)) as int) as ix, cast(floor(least(greatest(foot_y_m, 0), 19.99e0)) as int) as iy, count(*) as n
                  from tracked group by all) as c) as d
      where n / total > 0.001""",
    "matched": """
      select match_id, frame_idx, track_id, pose_seq
      from (select *, row_number() over (partition by match_id, frame_idx, track_id order by pose_seq desc) as again
            from (select q.match_id, q.frame_idx, q.pose_seq, p.track_id, sqrt((p.foot_x_px - q.px) * (p.foot_x_px - q.px) + (p.foot_y_px - q.py) * (p.foot_y_px - q.py)) as d,
                         row_number() over (partition by q.match_id, q.frame_idx, q.pose_seq order by abs(p.frame_idx - q.frame_idx), case when p.frame_idx < q.frame_idx then 1 else 0 end,
                           sqrt((p.foot_x_px - q.px) * (p.foot_x_px - q.px) + (p.foot_y_px - q.py) * (p.foot_y_px - q.py)), p.det_seq) as rn
                  from poses q join players p on p.match_id = q.match_id and p.frame_idx between q.frame_idx - 6 and q.frame_idx + 6) as a
            where rn = 1 and d < 120) as b
      where again = 1""",
    "before": """
      select e.match_id, e.frame_idx, median(s.y) as median_y from ev e left join steps s on s.match_id = e.match_id and s.frame_idx >= e.frame_idx - 12 and s.frame_idx < e.frame_idx
      where e.type = 'hit' group by e.match_id, e.frame_idx""",
    "after": """
      select match_id, frame_idx, coalesce(avg(px), 0) as speed_px, coalesce(avg(m), 0) * 30 as speed_ms
      from (select e.match_id, e.frame_idx, sqrt((s.x - lag(s.x) over w) * (s.x - lag(s.x) over w) + (s.y - lag(s.y) over w) * (s.y - lag(s.y) over w)) as px,
                   sqrt((s.cx - lag(s.cx) over w) * (s.cx - lag(s.cx) over w) + (s.cy - lag(s.cy) over w) * (s.cy - lag(s.cy) over w)) as m
            from ev e left join steps s on s.match_id = e.match_id and s.frame_idx between e.frame_idx and e.frame_idx + 6
            where e.type = 'hit' window w as (partition by e.match_id, e.frame_idx order by s.frame_idx)) as a
      group by match_id, frame_idx""",
    "feat": """
      select e.match_id, e.frame_idx, e.track_id, b.median_y, a.speed_px, a.speed_ms,
             coalesce(b.median_y <> 0 and b.median_y < e.y - 30, false) as ball_high,
             coalesce(p.foot_y_m > 7 and p.foot_y_m < 13, false) as at_net, coalesce(p.foot_y_m < 4.5e0 or p.foot_y_m > 15.5e0, false) as at_back,
             coalesce(greatest(q.lw_c, q.rw_c) > 35e-2 and (case when q.lw_c >= q.rw_c then q.lw_y else q.rw_y end)
               < (case when least(q.ls_c, q.rs_c) > 35e-2 then least(q.ls_y, q.rs_y) else (case when q.lw_c >= q.rw_c then q.lw_y else q.rw_y end) + 50 end) - 25, false) as arm_above,
             coalesce(greatest(q.lw_c, q.rw_c) > 35e-2 and (case when q.lw_c >= q.rw_c then q.lw_y else q.rw_y end)
               < (case when least(q.ls_c, q.rs_c) > 35e-2 then least(q.ls_y, q.rs_y) else (case when q.lw_c >= q.rw_c then q.lw_y else q.rw_y end) + 50 end) + 15, false) as arm_high
      from ev e join before b on b.match_id = e.match_id and b.frame_idx = e.frame_idx join after a on a.match_id = e.match_id and a.frame_idx = e.frame_idx
      left join (select match_id, frame_idx, track_id, arg_min(foot_y_m, det_seq) as foot_y_m from players group by all) p on p.match_id = e.match_id and p.frame_idx = e.frame_idx and p.track_id = e.track_id
      left join matched m on m.match_id = e.match_id and m.frame_idx = e.frame_idx and m.track_id = e.track_id
      left join poses q on q.match_id = m.match_id and q.frame_idx = m.frame_idx and q.pose_seq = m.pose_seq
      where e.type = 'hit'""",
    "shot": """
      select match_id, frame_idx, track_id,
             case when arm_above and ball_high then 'smash' when ball_high and speed_ms > 18 and (at_back or at_net) then 'smash'
                  when arm_high and at_back and ball_high then 'bandeja' when ball_high and speed_ms > 6 and at_back then 'bandeja'
                  when at_net and not arm_above and not ball_high then 'volley' when at_net and speed_ms > 6 then 'volley' else 'other' end as shot_type,
             case when arm_above and ball_high then 82e-2 when ball_high and speed_ms > 18 and (at_back or at_net) then 62e-2
                  when arm_high and at_back and ball_high then 65e-2 when ball_high and speed_ms > 6 and at_back then 5e-1
                  when at_net and not arm_above and not ball_high then 6e-1 when at_net and speed_ms > 6 then 45e-2 else 4e-1 end as confidence
      from feat""",
    "cross_tab": """
      select s.match_id, s.player_id, t.shot_type, count(h.frame_idx) as n
      from slots s cross join (values ('smash'), ('volley'), ('bandeja'), ('other')) as t(shot_type)
      left join pmap m on m.match_id = s.match_id and m.player_id = s.player_id
      left join shot h on h.match_id = m.match_id and h.track_id = m.track_id and h.shot_type = t.shot_type
      group by s.match_id, s.player_id, t.shot_type""",
    "boxed": """
      select *, cast(floor(frame_idx / 2) as bigint) as chunk_idx, foot_x_px - 20 - frame_idx % 7 as x1, foot_y_px - 1505e-1 as y1, foot_x_px + 20 + frame_idx % 5 as x2,
             foot_y_px as y2, cast(50 + (frame_idx * 7 + track_id * 13) % 50 as double) / 1e2 as confidence from tracked""",
    "crops": """
      select * from (
        select b.match_id, b.player_id, b.frame_idx, b.x1, b.y1, b.x2, b.y2,
               b.confidence * case when b.chunk_idx >= floor(n.n_chunks / 3) and b.chunk_idx < floor(n.n_chunks * 2 / 3) then 2e0 else 1e0 end as score,
               row_number() over (partition by b.match_id, b.player_id order by b.confidence * case when b.chunk_idx >= floor(n.n_chunks / 3) and b.chunk_idx < floor(n.n_chunks * 2 / 3) then 2e0 else 1e0 end desc, b.chunk_idx, b.det_seq) as rn
        from boxed b join (select match_id, cast(floor(max(frame_idx) / 2) + 1 as bigint) as n_chunks from ball_raw group by match_id) n on n.match_id = b.match_id) as z
      where rn = 1""",
    "match_list": """
      select cast(o_orderkey as varchar) as id, concat('Match ', cast(o_orderkey as varchar)) as title, o_orderkey, o_custkey,
             case o_orderkey % 5 when 0 then 'uploading' when 1 then 'queued' when 2 then 'processing' when 3 then 'completed' else 'failed' end as status,
             cast(case o_orderkey % 5 when 3 then 100 when 2 then o_orderkey % 100 else 0 end as int) as progress, o_orderdate as created_at
      from orders""",
}
_USES = {name: [other for other in PARTS if other != name and f" {other} " in f" {' '.join(sql.replace('(', ' ').replace(')', ' ').split())} "] for name, sql in PARTS.items()}


def _with(query: str, changed: dict[str, str] | None = None, between: str = "") -> str:
    """The query behind the parts it needs, some of them changed; `between` follows the ball's part."""
    known = PARTS | (changed or {})
    words = f" {' '.join(query.replace('(', ' ').replace(')', ' ').split())} "
    need, queue = set(), [p for p in PARTS if f" {p} " in words]
    while queue:
        part = queue.pop()
        if part not in need:
            need.add(part)
            queue += _USES[part]
    parts = ", ".join(f"{p} as ({known[p]})" + between * (p == "ball_raw") for p in PARTS if p in need)
    return f"with recursive {parts} {query}" if parts else query


_KALMAN = """
, r as (select *, row_number() over (partition by match_id order by frame_idx) as n from ball_raw),
first_seen as (select match_id, arg_min(x_px, n) as x, arg_min(y_px, n) as y from r where x_px is not null group by match_id),
k as (
  select match_id, cast(0 as bigint) as n, x, y, 0e0 as vx, 0e0 as vy, 100e0 as a, 0e0 as b, 100e0 as c, 0 as misses, cast(0 as bigint) as frame_idx, false as shown, 0e0 as confidence from first_seen
  union all
  select match_id, n, case when seen then px + k0 * (zx - px) else px end, case when seen then py + k0 * (zy - py) else py end,
         case when seen then vx + k1 * (zx - px) else vx end, case when seen then vy + k1 * (zy - py) else vy end,
         case when seen then (1 - k0) * a else a end, case when seen then (1 - k0) * b else b end, case when seen then c - k1 * b else c end,
         case when seen then 0 else misses + 1 end, frame_idx, seen or misses < 6, case when seen then confidence when misses < 6 then 3e-1 else confidence end
  from (select *, a / (a + 25e0) as k0, b / (a + 25e0) as k1
        from (select k.match_id, r.n, k.x + k.vx as px, k.y + k.vy as py, k.vx, k.vy, k.a + 2 * k.b + k.c + 8e-1 as a, k.b + k.c as b, k.c + 8e-1 as c, k.misses,
                     r.frame_idx, r.x_px is not null as seen, r.x_px as zx, r.y_px as zy, r.confidence
              from k join r on r.match_id = k.match_id and r.n = k.n + 1) as s) as g)
select match_id, frame_idx, round(case when shown then x end, 4) as x_px, round(case when shown then y end, 4) as y_px, confidence from k where n > 0"""

_QUERIES: dict[str, str] = {
    "ball_kinematics": "select match_id, frame_idx, vx0, vy0, round(sqrt((vx1 - vx0) * (vx1 - vx0) + (vy1 - vy0) * (vy1 - vy0)), 6) as acceleration from steps ",
    "pixel_to_court": "select match_id, frame_idx, round(cx, 6) as cx, round(cy, 6) as cy from steps ",
    "estimated_corners": """
      select match_id, corner, x, y from (
        select match_id, unnest(['tl', 'tr', 'br', 'bl']) as corner, unnest([tx, w - tx, w - bx, bx]) as x, unnest([ty, ty, by_, by_]) as y
        from (select match_id, w, cast(floor(w * 22e-2) as bigint) as tx, cast(floor(h * 1e-1) as bigint) as ty, cast(floor(w * 6e-2) as bigint) as bx, cast(floor(h * 93e-2) as bigint) as by_
              from (select distinct user_id % 16 as match_id, 1280 + 16 * (user_id % 16) as w, 720 + 8 * (user_id % 16) as h from events) as v) as c) as d""",
    "corner_order": """
      select g, 'tl' as corner, arg_min(x, (x + y) * 10 + idx) as x, arg_min(y, (x + y) * 10 + idx) as y from pts group by g
      union all select g, 'tr', arg_min(x, (y - x) * 10 + idx), arg_min(y, (y - x) * 10 + idx) from pts group by g
      union all select g, 'br', arg_min(x, -(x + y) * 10 + idx), arg_min(y, -(x + y) * 10 + idx) from pts group by g
      union all select g, 'bl', arg_min(x, -(y - x) * 10 + idx), arg_min(y, -(y - x) * 10 + idx) from pts group by g""",
    "in_court_filter": """
      select match_id, frame_idx, track_id, fx, fy from (
        select *, (bx - ax) * (fy - ay) - (by_ - ay) * (fx - ax) as s1, (cx - bx) * (fy - by_) - (cy - by_) * (fx - bx) as s2,
               (dx - cx) * (fy - cy) - (dy - cy) * (fx - cx) as s3, (ax - dx) * (fy - dy) - (ay - dy) * (fx - dx) as s4
        from (select match_id, frame_idx, track_id, foot_x_px * 17e-1 - 3335e-1 as fx, foot_y_px * 15e-1 - 977e-1 as fy from players ) as p
        cross join (select max(x) filter (where i = 0) as ax, max(y) filter (where i = 0) as ay, max(x) filter (where i = 1) as bx, max(y) filter (where i = 1) as by_,
                           max(x) filter (where i = 2) as cx, max(y) filter (where i = 2) as cy, max(x) filter (where i = 3) as dx, max(y) filter (where i = 3) as dy
                    from (select i, x + (x - mx) * (50 / greatest(sqrt((x - mx) * (x - mx) + (y - my) * (y - my)), 1)) as x, y + (y - my) * (50 / greatest(sqrt((x - mx) * (x - mx) + (y - my) * (y - my)), 1)) as y
                          from (select *, avg(x) over () as mx, avg(y) over () as my from (values (0, 281e0, 72e0), (1, 999e0, 72e0), (2, 1204e0, 669e0), (3, 76e0, 669e0)) as c(i, x, y)) as m) as e) as q) as z
      where (s1 >= 0 and s2 >= 0 and s3 >= 0 and s4 >= 0) or (s1 <= 0 and s2 <= 0 and s3 <= 0 and s4 <= 0)""",
    "sample_frames": """
      select match_id, cast(s as int) as sample, cast(floor(s * greatest(e - 1, 0) / 29) as bigint) as frame_idx
      from (select match_id, case when least(n_frames, floor(fps * 5)) < 1 then least(n_frames, 30) else least(n_frames, floor(fps * 5)) end as e
            from (select user_id % 16 as match_id, 24e0 + user_id % 16 as fps, count(*) as n_frames from events group by all) as v) as q cross join range(30) as r(s)""",
    "inference_control": "select match_id, frame_idx, row_number() over (partition by match_id order by frame_idx) >= 3 and frame_idx % 2 = 0 as infer from ball_raw ",
    "hit_events": "select match_id, frame_idx, track_id, confidence from hits ",
    "hit_events_pixels": """
      select match_id, frame_idx, track_id from (
        select b.match_id, b.frame_idx, p.track_id, sqrt((p.foot_x_px - b.x) * (p.foot_x_px - b.x) + (p.foot_y_px - b.y) * (p.foot_y_px - b.y)) as dist,
               row_number() over (partition by b.match_id, b.frame_idx order by abs(p.frame_idx - b.frame_idx), case when p.frame_idx < b.frame_idx then 1 else 0 end,
                 sqrt((p.foot_x_px - b.x) * (p.foot_x_px - b.x) + (p.foot_y_px - b.y) * (p.foot_y_px - b.y)), p.det_seq) as rn
        from peaks b join players p on p.match_id = b.match_id and p.frame_idx between b.frame_idx - 6 and b.frame_idx + 6) as z where rn = 1 and dist < 100""",
    "bounce_events": "select match_id, frame_idx, x, y from bounces ",
    "wall_hit_events": "select match_id, frame_idx, x, y from walls ",
    "events_dedup": "select match_id, type, frame_idx, track_id from ev ",
    "rallies": "select r.match_id, cast(rally_idx as bigint) as rally_idx, start_frame, end_frame, last_track, m.player_id as last_player from ral r left join pmap m on m.match_id = r.match_id and m.track_id = r.last_track",
    "player_map": "select match_id, track_id, player_id, detections from pmap ",
    "player_distance": "select match_id, player_id, distance_m from dist ",
    "player_heatmap": "select match_id, player_id, x, y, round(weight, 6) as weight from heat ",
    "rally_outcomes": "select match_id, cast(rally_idx as bigint) as rally_idx, outcome from outc ",
    "winners_errors": "select match_id, player_id, winners, errors from won ",
    "shot_features": "select match_id, frame_idx, track_id, round(median_y, 6) as median_y, round(speed_px, 6) as speed_px, round(speed_ms, 6) as speed_ms, ball_high, at_net, at_back, arm_above, arm_high from feat ",
    "shot_types": "select match_id, frame_idx, track_id, shot_type, confidence from shot ",
    "shot_crosstab": "select match_id, player_id, shot_type, n from cross_tab ",
    "gap_runs": """
      select match_id, min(frame_idx) as first_frame, max(frame_idx) as last_frame, count(*) as n_rows, min(n) > 1 and max(n) < max(total) as interior
      from (select *, n - row_number() over (partition by match_id, hidden order by frame_idx) as island
            from (select match_id, frame_idx, x_px is null as hidden, row_number() over (partition by match_id order by frame_idx) as n, count(*) over (partition by match_id) as total from ball_raw ) as a) as b
      where hidden group by match_id, island""",
    "pose_match": "select match_id, frame_idx, track_id, pose_seq from matched ",
    "pose_targets": """
      select distinct match_id, frame_idx + d as frame_idx from (select match_id, frame_idx, row_number() over (partition by match_id order by frame_idx) as rn from ball_raw where x_px is not null) as b
      cross join range(-4, 5) as r(d) where rn <= 500""",
    "best_crop": "select match_id, player_id, frame_idx, round(score, 6) as score from crops ",
    "crop_bbox": """
      select match_id, player_id, frame_idx, greatest(0, cast(trunc(x1) as int) - 24) as "left", greatest(0, cast(trunc(y1) as int) - 24) as top,
             least(1280, cast(trunc(x2) as int) + 24) as "right", least(720, cast(trunc(y2) as int) + 24) as bottom from crops """,
    "heatmap_centroid": """
      select frame, round(case when peak >= 5e-1 then sx / sw * 160 end, 6) as x, round(case when peak >= 5e-1 then sy / sw * 90 end, 6) as y, round(peak, 6) as confidence
      from (select frame, max(w) as peak, sum(w) filter (where w > 3e-1) as sw, sum(w * (pos % 8)) filter (where w > 3e-1) as sx, sum(w * floor(pos / 8)) filter (where w > 3e-1) as sy
            from (select frame, pos, least(1e0, abs(cast(e as double)) * 3) as w from (select vec_id as frame, unnest(range(len(embedding))) as pos, unnest(embedding) as e from embeddings) as u) as c
            group by frame) as g""",
    "ball_candidate_best": """
      select f.match_id, f.frame_idx, b.x, b.y, round(case when b.score is null then 0 when b.score > 85e-2 then 85e-2 else b.score end, 6) as confidence
      from (select distinct user_id % 4 as match_id, cast(floor(event_id / 3) as bigint) as frame_idx from events) f
      left join (select * from (select *, row_number() over (partition by match_id, frame_idx order by score desc, seq) as rn
                                from (select *, circ * 65e-2 + brightness * 35e-2 as score
                                      from (select user_id % 4 as match_id, cast(floor(event_id / 3) as bigint) as frame_idx, event_id % 3 as seq, cast(event_id * 7 % 500 as double) as area,
                                                   4 * pi() * cast(event_id * 7 % 500 as double) / (cast(10 + event_id * 11 % 60 as double) * cast(10 + event_id * 11 % 60 as double)) as circ,
                                                   cast(event_id * 13 % 100 as double) / 1e2 as brightness, cast(event_id % 1280 as double) as x, cast(event_id % 720 as double) as y from events) as a
                                      where area >= 6 and area <= 420 and circ >= 3e-1) as s) as t where rn = 1 and score > 42e-2) b on b.match_id = f.match_id and b.frame_idx = f.frame_idx""",
    "median_corners": """
      select match_id, corner, median(x) as x, median(y) as y
      from (select user_id % 4 as match_id, event_id % 4 as corner, cast(event_id * 37 % 1280 as double) as x, cast(event_id * 53 % 720 as double) as y from events where event_type <> 'error') as d group by all""",
    "court_strategy": """
      select match_id, case when coalesce(lines, colour) is null then 'estimated' when lines is not null then 'lines' else 'colour' end as strategy, coalesce(lines, colour, 0) as corner_x
      from (select event_id as match_id, case when event_id % 3 = 0 then event_id % 1280 end as lines, case when event_id % 4 = 0 then event_id % 640 end as colour from events) as s""",
    "match_list_topk": "select id, title, status, progress, created_at from match_list order by created_at desc, id desc limit 50",
    "match_read": "select id, title, status, progress from match_list where id = '37'",
    "stats_read_totals": """
      select s.match_id, s.total_shots, coalesce(r.n, 0) as rallies_count from (select match_id, cast(sum(n) as bigint) as total_shots from cross_tab group by match_id) s
      left join (select match_id, count(*) as n from ral group by match_id) r on r.match_id = s.match_id""",
    "stats_players": """
      select d.match_id, d.player_id, d.distance_m, w.winners, w.errors, cast(c.total as bigint) as shots from dist d join won w on w.match_id = d.match_id and w.player_id = d.player_id
      join (select match_id, player_id, sum(n) as total from cross_tab group by all) c on c.match_id = d.match_id and c.player_id = d.player_id""",
    "shot_share": """
      select match_id, player_id, shot_type, n, round(n / greatest(sum(n) over (partition by match_id, player_id), 1), 6) as share from cross_tab """,
    "shot_pivot": """
      select match_id, player_id, cast(sum(n) filter (where shot_type = 'smash') as bigint) as smash, cast(sum(n) filter (where shot_type = 'volley') as bigint) as volley,
             cast(sum(n) filter (where shot_type = 'bandeja') as bigint) as bandeja, cast(sum(n) filter (where shot_type = 'other') as bigint) as other, cast(sum(n) as bigint) as total
      from cross_tab group by match_id, player_id""",
    "summary_cards": """
      select d.match_id, cast(round(d.s / 4) as bigint) as mean_distance, cast(w.total_winners as bigint) as total_winners, cast(c.total_shots as bigint) as total_shots, coalesce(r.n, 0) as rallies_count, r.mean_rally_frames
      from (select match_id, sum(distance_m) as s from dist group by match_id) d join (select match_id, sum(winners) as total_winners from won group by match_id) w on w.match_id = d.match_id
      join (select match_id, sum(n) as total_shots from cross_tab group by match_id) c on c.match_id = d.match_id
      left join (select match_id, count(*) as n, round(avg(end_frame - start_frame), 6) as mean_rally_frames from ral group by match_id) r on r.match_id = d.match_id""",
    "heat_marks": "select match_id, player_id, x, y, round(sqrt(weight) * 30, 6) as radius, round(least(weight * 12, 9e-1), 6) as opacity from heat ",
    "display_names": """
      select id, p as player_id, case when o_orderkey % 3 > 0 and p < 2 and (case p when 0 then concat('C', o_custkey) else '' end) <> '' then concat('C', o_custkey) else concat('P', p + 1) end as name
      from match_list cross join range(4) as r(p)""",
    "any_name": "select id, o_orderkey % 3 > 0 as has_names from match_list ",
    "delete_cascade": "select id, status from match_list where status <> 'failed'",
    "job_transitions": """
      select q.id, q.action, m.status, case when m.status = 'uploading' and action = 'start' then 'queued' when m.status = 'queued' and action = 'begin' then 'processing'
               when m.status = 'processing' and action = 'finish' then 'completed' when m.status = 'processing' and action = 'fail' then 'failed'
               when m.status = 'failed' and action = 'retry' then 'processing' else m.status end as new_status,
             case when m.status is null then 404 when (m.status = 'uploading' and action = 'start') or (m.status = 'queued' and action = 'begin') or (m.status = 'processing' and action in ('finish', 'fail'))
               or (m.status = 'failed' and action = 'retry') then 200 else 409 end as code
      from (select cast(case when o_orderkey % 7 = 0 then -o_orderkey else o_orderkey end as varchar) as id,
                   ['start', 'begin', 'finish', 'fail', 'retry'][cast(o_custkey % 5 as int) + 1] as action from orders) q left join match_list m on m.id = q.id""",
    "upload_check": "select id, o_orderkey * 1000000 - 5000000 as size_bytes, case when o_orderkey * 1000000 - 5000000 <= 0 then 422 when o_orderkey * 1000000 - 5000000 > 2147483648 then 413 else 200 end as code from match_list ",
}


#: Corners of samples in turning order to homographies: ordered, medians, the projective map of the unit square inverted.
_CAL = """
, pts as (
  select event_id % 4 as match_id, event_id // 16 as sample, (event_id // 4) % 4 as idx,
         cast([281, 999, 1204, 76][((event_id // 4) + (event_id // 16)) % 4 + 1] + (event_id * 7) % 9 - 4 + 6 * (event_id % 4) as double) as x,
         cast([72, 72, 669, 669][((event_id // 4) + (event_id // 16)) % 4 + 1] + (event_id * 5) % 7 - 3 + 3 * (event_id % 4) as double) as y
  from events where (event_id // 16) % 6 <> 5),
sorted_pts as (
  select match_id, sample, arg_min({'x': x, 'y': y}, (x + y) * 100 + idx) as tl, arg_min({'x': x, 'y': y}, (y - x) * 100 + idx) as tr,
         arg_min({'x': x, 'y': y}, -(x + y) * 100 + idx) as br, arg_min({'x': x, 'y': y}, (x - y) * 100 + idx) as bl
  from pts group by match_id, sample),
quads as (
  select match_id, median(bl.x) as x0, median(bl.y) as y0, median(br.x) as x1, median(br.y) as y1, median(tr.x) as x2, median(tr.y) as y2, median(tl.x) as x3, median(tl.y) as y3, false as estimated
  from sorted_pts group by match_id
  union all select distinct user_id % 5, 76, 669, 1204, 669, 999, 72, 281, 72, true from events where user_id % 5 = 4),
sides as (
  select *, ((x0 - x1 + x2 - x3) * (y3 - y2) - (x3 - x2) * (y0 - y1 + y2 - y3)) / ((x1 - x2) * (y3 - y2) - (x3 - x2) * (y1 - y2)) as g,
         ((x1 - x2) * (y0 - y1 + y2 - y3) - (x0 - x1 + x2 - x3) * (y1 - y2)) / ((x1 - x2) * (y3 - y2) - (x3 - x2) * (y1 - y2)) as h from quads),
maps as (select *, x1 - x0 + g * x1 as a, x3 - x0 + h * x3 as b, y1 - y0 + g * y1 as d, y3 - y0 + h * y3 as e from sides),
cal as (
  select match_id, estimated, [(e - y0 * h) * 10 / (a * e - b * d), (x0 * h - b) * 10 / (a * e - b * d), (b * y0 - x0 * e) * 10 / (a * e - b * d),
         (y0 * g - d) * 20 / (a * e - b * d), (a - x0 * g) * 20 / (a * e - b * d), (x0 * d - a * y0) * 20 / (a * e - b * d),
         (d * h - e * g) / (a * e - b * d), (b * g - a * h) / (a * e - b * d), 1e0] as m from maps)"""
_CAL_X, _CAL_Y = ("(m[{0}] * x + m[{1}] * y + m[{2}]) / (m[7] * x + m[8] * y + m[9])".format(*n) for n in ((1, 2, 3), (4, 5, 6)))


def _calibrated() -> dict[str, str]:
    """The parts that map to the court, by each match's homography."""
    steps, players = PARTS["steps"], PARTS["players"]
    plain = _court("x", "y")
    steps = steps.replace(plain[0], _CAL_X).replace(plain[1], _CAL_Y).replace("select *,", "select q.*,").replace("as q", "as q join cal c on c.match_id = q.match_id")
    players = players.replace(plain[0], _CAL_X).replace(plain[1], _CAL_Y).replace("select match_id, frame_idx, track_id", "select g.match_id, frame_idx, track_id", 1).replace("as g", "as g join cal c on c.match_id = g.match_id")
    return {"steps": steps, "players": players}


#: Gaps in turn, as what was filled before counts; a parabola by normal equations and Cramer's rule, frames from the gap on.
_FILL = """
, r as materialized (select *, row_number() over (partition by match_id order by frame_idx) as n, count(*) over (partition by match_id) as total from ball_raw),
hidden as materialized (select *, n - row_number() over (partition by match_id order by n) as island from r where x_px is null),
gaps as materialized (
  select match_id, min(n) as a, max(n) + 1 as b, min(frame_idx) as f0, list(frame_idx order by n) as frames, row_number() over (partition by match_id order by min(n)) as g
  from hidden group by match_id, island, total having count(*) <= 6 and min(n) > 1 and max(n) < total),
near as materialized (
  select s.match_id, s.g, list({'n': r.n, 'f': r.frame_idx, 'x': r.x_px, 'y': r.y_px} order by r.n) as pts
  from gaps s join r on r.match_id = s.match_id and r.x_px is not null and r.n between s.a - 5 and s.b + 4 group by s.match_id, s.g),
k as (
  select distinct match_id, cast(0 as bigint) as g, [{'n': cast(0 as bigint), 'f': cast(0 as bigint), 'x': 0e0, 'y': 0e0}] as filled from gaps
  union all
  select match_id, g, list_filter(filled, lambda q: q.n > 0 and q.n >= a - 40) || case
    when m >= 3 then list_transform(range(len(frames)), lambda i: {'n': a + i, 'f': frames[i + 1],
      'x': (dx0 + dx1 * (frames[i + 1] - f0) + dx2 * (frames[i + 1] - f0) * (frames[i + 1] - f0)) / d, 'y': (dy0 + dy1 * (frames[i + 1] - f0) + dy2 * (frames[i + 1] - f0) * (frames[i + 1] - f0)) / d})
    when m = 2 then list_transform(range(len(frames)), lambda i: {'n': a + i, 'f': frames[i + 1],
      'x': pts[1].x + (pts[2].x - pts[1].x) * (frames[i + 1] - pts[1].f) / greatest(pts[2].f - pts[1].f, 1), 'y': pts[1].y + (pts[2].y - pts[1].y) * (frames[i + 1] - pts[1].f) / greatest(pts[2].f - pts[1].f, 1)})
    else [] end
  from (
    select *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) as d,
           x0 * (s2 * s4 - s3 * s3) - s1 * (x1 * s4 - x2 * s3) + s2 * (x1 * s3 - x2 * s2) as dx0, s0 * (x1 * s4 - x2 * s3) - x0 * (s1 * s4 - s2 * s3) + s2 * (s1 * x2 - s2 * x1) as dx1,
           s0 * (s2 * x2 - s3 * x1) - s1 * (s1 * x2 - s2 * x1) + x0 * (s1 * s3 - s2 * s2) as dx2,
           y0 * (s2 * s4 - s3 * s3) - s1 * (y1 * s4 - y2 * s3) + s2 * (y1 * s3 - y2 * s2) as dy0, s0 * (y1 * s4 - y2 * s3) - y0 * (s1 * s4 - s2 * s3) + s2 * (s1 * y2 - s2 * y1) as dy1,
           s0 * (s2 * y2 - s3 * y1) - s1 * (s1 * y2 - s2 * y1) + y0 * (s1 * s3 - s2 * s2) as dy2
    from (
      select *, len(pts) as m, cast(len(pts) as double) as s0, list_sum([t for t in ts]) as s1, list_sum([t * t for t in ts]) as s2, list_sum([t * t * t for t in ts]) as s3, list_sum([t * t * t * t for t in ts]) as s4,
             list_sum([q.x for q in pts]) as x0, list_sum([q.x * (q.f - f0) for q in pts]) as x1, list_sum([q.x * (q.f - f0) * (q.f - f0) for q in pts]) as x2,
             list_sum([q.y for q in pts]) as y0, list_sum([q.y * (q.f - f0) for q in pts]) as y1, list_sum([q.y * (q.f - f0) * (q.f - f0) for q in pts]) as y2
      from (
        select *, [cast(q.f - f0 as double) for q in pts] as ts
        from (select k.match_id, s.g, s.a, s.f0, s.frames, k.filled, list_filter(k.filled, lambda q: q.n > 0 and q.n >= s.a - 5) || coalesce(e.pts, []) as pts
              from k join gaps s on s.match_id = k.match_id and s.g = k.g + 1 left join near e on e.match_id = s.match_id and e.g = s.g) as j) as j) as j) as j),
done as (select distinct match_id, q.n, q.x, q.y from (select match_id, unnest(filled) as q from k) as u where q.n > 0)
select r.match_id, r.frame_idx, round(coalesce(r.x_px, d.x) + 1e-6, 2) as x_px, round(coalesce(r.y_px, d.y) + 1e-6, 2) as y_px, case when d.n is null then r.confidence else 3e-1 end as confidence
from r left join done d on d.match_id = r.match_id and d.n = r.n"""

_LOG = """
with recursive u as (
  select user_id % 64 as match_id, event_id * 37 % 101 as progress, row_number() over (partition by user_id % 64 order by event_id) as n from events),
k as (
  select distinct match_id, cast(0 as bigint) as n, cast(-1 as bigint) as last, false as kept, cast(0 as bigint) as progress from u
  union all
  select k.match_id, u.n, case when u.progress >= k.last + 5 or u.progress >= 100 then u.progress else k.last end, u.progress >= k.last + 5 or u.progress >= 100, u.progress
  from k join u on u.match_id = k.match_id and u.n = k.n + 1)
select match_id, cast(progress as int) as progress from k where kept"""

_CELLS = """
  cells as (
  select distinct match_id, frame_idx, y, px + unnest(range(wide + 1)) as x from (
    select match_id, frame_idx, px, wide, py + unnest(range(wide + 1)) as y from (
      select user_id % 4 as match_id, event_id // 200 as frame_idx, (event_id * 37 + event_id // 7) % 38 as px, event_id * 11 % 22 as py, case when event_id % 4 = 0 then 2 else 0 end as wide from events)))"""
_OPENED = _CELLS + """,
  shrunk as (
  select c.* from cells c join cells a on a.match_id = c.match_id and a.frame_idx = c.frame_idx and a.y = c.y - 1 and a.x = c.x
  join cells b on b.match_id = c.match_id and b.frame_idx = c.frame_idx and b.y = c.y and b.x = c.x - 1),
  open as (select distinct match_id, frame_idx, y + dy as y, x + dx as x from shrunk, (values (0, 0), (-1, 0), (0, -1)) as t(dy, dx))"""

_PLAIN = {
    "mask_opened": f"""
      with {_OPENED}
      select match_id, frame_idx, y, min(x) as x0, max(x) as x1
      from (select *, x - row_number() over (partition by match_id, frame_idx, y order by x) as island from open) group by match_id, frame_idx, y, island""",
    "mask_components": f"""
      with recursive {_OPENED},
      reach as (
      select match_id, frame_idx, y, x, y * 1000 + x as label from open union
      select o.match_id, o.frame_idx, o.y, o.x, r.label from reach r join open o on o.match_id = r.match_id and o.frame_idx = r.frame_idx and abs(o.y - r.y) <= 1 and abs(o.x - r.x) <= 1),
      least as (select match_id, frame_idx, y, x, min(label) as label from reach group by all),
      sums as (select match_id, frame_idx, label, count(*) as n_pixels, min(x) as "left", min(y) as top, max(x) as "right", max(y) as bottom from least group by match_id, frame_idx, label)
      select match_id, frame_idx, cast(row_number() over (partition by match_id, frame_idx order by label) - 1 as int) as component, n_pixels, "left", top, "right", bottom from sums""",
    "court_lines": f"""
      with {_CELLS},
      v as (
      select match_id, frame_idx, cast(angle as int) as angle, cast(floor(round(x * cos(angle * pi() / 180) + y * sin(angle * pi() / 180), 9) + 0.5) as int) as "offset", count(*) as votes
      from cells, range(180) t(angle) group by all having count(*) >= 9)
      select * from v where not exists (
        select 1 from v o where o.match_id = v.match_id and o.frame_idx = v.frame_idx and abs(o.angle - v.angle) <= 1 and abs(o."offset" - v."offset") <= 1
        and (o.votes > v.votes or o.votes = v.votes and (o.angle < v.angle or o.angle = v.angle and o."offset" < v."offset")))""",
    "frame_index": "select event_id // 500 as clip, event_id % 500 as frame_idx, event_id % 500 // 12 * 12 as key_frame, event_id % 500 % 12 = 0 as key, round((event_id % 500) / 25e0, 6) as seconds, "
    "length(repeat(event_type || ':' || event_id || ';', cast(1 + event_id % 7 as int))) as size, md5(repeat(event_type || ':' || event_id || ';', cast(1 + event_id % 7 as int))) as digest from events",
    "frame_range": "select event_id // 500 as clip, event_id % 500 as frame_idx, repeat(event_type || ':' || event_id || ';', cast(1 + event_id % 7 as int)) as payload "
    "from events where event_id % 500 between 100 and 250 and event_id % 500 % 3 = 0",
    "ball_strided": "select match_id, frame_idx from ball_raw where frame_idx % 3 = 0",
    "foot_points": "select match_id, frame_idx, track_id, (x1 + x2) / 2 as x, y2 as y from boxed ",
    "cascade_counts": """
      select 'matches' as name, count(*) as n from match_list where status <> 'failed'
      union all select 'lines', count(*) from lineitem where not exists (select 1 from match_list m where m.id = cast(l_orderkey as varchar) and m.status = 'failed')""",
    "process_jobs": """
      select j.id, case when j.i = 1 then 'failed' when w.match_id is null then 'failed' else 'completed' end as status, cast(case when w.match_id is null then 0 else 100 end as int) as progress,
             case when j.i = 5 then 'OSError: no such video' when w.match_id is null and j.i <> 1 then concat('no tracks for match ', j.id) end as error_message, w.total_shots, w.rallies_count,
             cast(case when w.match_id is not null then 4 end as int) as crops, case when w.match_id is not null then false end as estimated
      from (select cast(i as varchar) as id, i from range(6) as r(i)) j
      left join (select c.match_id, c.total_shots, coalesce(r.n, 0) as rallies_count from (select match_id, cast(sum(n) as bigint) as total_shots from cross_tab group by match_id) c
                 left join (select match_id, count(*) as n from ral group by match_id) r on r.match_id = c.match_id where c.match_id <> 1) w on w.match_id = j.i""",
    "stats_saved": "select cast(c_custkey as varchar) as match_id, case when c_nationkey % 3 = 0 then c_nationkey + 100 else c_nationkey end as v, cast(case when c_nationkey % 3 = 0 then 1 end as int) as later from customer",
    "match_with_stats": "select m.id, m.status, s.n as total_shots from match_list m left join (select l_orderkey, count(*) as n from lineitem where l_orderkey % 3 = 0 group by l_orderkey) s on s.l_orderkey = m.o_orderkey",
    "crop_urls": """
      select id as match_id, player, concat('http://host/api/matches/', id, '/crops/', player) as url
      from (select id, unnest(['0', cast(1 + o_custkey % 3 as varchar)]) as player from match_list where o_orderkey % 2 = 0) q""",
    "players_by_number": """
      select o_orderkey as match_id, cast(row_number() over (partition by o_orderkey order by player) - 1 as int) as place, cast(player as int) as player, cast(value as bigint) as value
      from (select o_orderkey, unnest([10, o_custkey % 9, 9]) as player, unnest([1, 2, 3]) as value from match_list) q""",
    "stats_dump": """
      select o_orderkey as match_id, concat('{"total":', o_custkey, ',"rallies":[', o_orderkey, ',1],"status":"', o_orderstatus, '"}') as document from orders""",
}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, sql in _QUERIES.items():
        if name == "corner_order":
            sql = "with pts as (select cast(floor(event_id / 4) as bigint) as g, event_id % 4 as idx, event_id * 37 % 1280 as x, event_id * 53 % 720 as y from events)" + sql
            out[name] = sql
        else:
            out[name] = _with(sql)
    out["kalman_smooth"] = f"with recursive ball_raw as ({PARTS['ball_raw']})" + _KALMAN
    out["kalman_live"], out["events_live"] = out["kalman_smooth"], out["events_dedup"]
    rally = _QUERIES["rallies"]
    smooth = _KALMAN.replace("select match_id, frame_idx, round(case when shown then x end, 4) as x_px, round(case when shown then y end, 4) as y_px, confidence from k where n > 0", ", smooth as (select match_id, frame_idx, case when shown then x end as x_px, case when shown then y end as y_px from k where n > 0)")
    out["rallies_smoothed"] = _with(rally, {"steps": PARTS["steps"].replace("ball_raw", "smooth")}, smooth)
    out["calibrated_rallies"] = _with(rally, _calibrated(), _CAL)
    out["calibration_table"] = f"with {_CAL.lstrip()[2:]} select match_id, estimated, cast(unnest(range(9)) as int) as entry, round(unnest(m), 6) + 0e0 as value from cal"
    out["progress_log"] = _LOG
    out["quadratic_fill"] = f"with recursive ball_raw as ({PARTS['ball_raw']})" + _FILL
    return out | {name: _with(sql) for name, sql in _PLAIN.items()}
