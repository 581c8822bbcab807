"""Independent SQL for the registered queries, over the same tables."""

from __future__ import annotations

from kinewatch.operators.manifests import SUBJECTS
from kinewatch.plans import fixtures as X
from kinewatch.params import Thresholds
from kinewatch.plans.fixtures import duck

K = "source_id, session_id, track_id"


def ctes(*parts: tuple[str, str]) -> str:
    return "with recursive " + ",\n".join(f"{name} as ({body})" for name, body in parts)


def features(obs: str = X.TRACKED, th: Thresholds = Thresholds(), frames: str = X.FRAMES) -> list[tuple[str, str]]:
    win = f"(partition by {K} order by timestamp_seconds)"
    ends = f"rows between {th.smoothing_window - 1} preceding and current row)"
    names = {
        "ar": "aspect_ratio_width_over_height", "dx": "center_dx_pixels", "dy": "center_dy_pixels",
        "dxw": "center_dx_frame_width", "dyh": "center_dy_frame_height",
        "dyp": "center_dy_person_height", "vp": "vertical_speed_pixels_per_second",
        "vf": "vertical_speed_frame_height_per_second"}
    smooth = ", ".join(
        f"case when is_first then {s} else avg(case when not is_first then {s} end) over "
        f"(partition by {K} order by timestamp_seconds {ends} end as {n}" for s, n in names.items())
    raw = ", ".join(f"{s} as {n}" for s, n in names.items())
    return [
        ("obs", duck(obs)),
        ("frames", duck(frames)),
        ("lagged", f"""select *, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy, y2 - y1 as ht,
            lag(timestamp_seconds) over {win} as pt, lag((x1 + x2) / 2) over {win} as pcx,
            lag((y1 + y2) / 2) over {win} as pcy, lag(y2 - y1) over {win} as ph from obs"""),
        ("feat", """select *, pt is null as is_first, (x2 - x1) / (y2 - y1) as ar,
            coalesce(cx - pcx, 0) as dx, coalesce(cy - pcy, 0) as dy,
            coalesce((cx - pcx) / frame_width, 0) as dxw, coalesce((cy - pcy) / frame_height, 0) as dyh,
            coalesce((cy - pcy) / greatest(ph, 1.0), 0) as dyp,
            coalesce((cy - pcy) / (timestamp_seconds - pt), 0) as vp,
            coalesce((cy - pcy) / frame_height / (timestamp_seconds - pt), 0) as vf,
            coalesce(timestamp_seconds - pt, 1e-9) as elapsed_seconds from lagged"""),
        ("named", f"select *, {raw} from feat"),
        ("smooth", f"""select {K}, frame_id, timestamp_seconds, class_name, detection_id, x1, y1, x2, y2,
            elapsed_seconds, {smooth} from feat"""),
        ("sig", f"""select *, ratio_signal or speed_signal or falling_posture or lying_posture as fall_signal,
            speed_signal or falling_posture as candidate_trigger
            from (select *, aspect_ratio_width_over_height >= {th.aspect_ratio_fall_min} as ratio_signal,
            vertical_speed_frame_height_per_second >= {th.vertical_speed_min} as speed_signal,
            class_name = 'falling' as falling_posture, class_name = 'lying' as lying_posture,
            (class_name in ('standing', 'sitting', 'person')
              and aspect_ratio_width_over_height <= {th.upright_aspect_ratio_max}) as upright_signal from smooth)"""),
    ]


def motion(obs: str = X.SPARSE, expire: bool = True, th: Thresholds = Thresholds(),
           frames: str = X.FRAMES) -> list[tuple[str, str]]:
    names = "['upright', 'suspected', 'falling', 'lying', 'recovering', 'resolved']"
    gone = f"""union all select {K}, timestamp_seconds, frame_id, true, gap, false, false, false, false,
            false, false from expiry""" if expire else ""
    return features(obs, th, frames) + [
        ("nexts", f"""select {K}, timestamp_seconds as last_seen, lead(timestamp_seconds) over
            (partition by {K} order by timestamp_seconds) as nt from obs"""),
        ("expiry", f"""select n.source_id, n.session_id, n.track_id, n.last_seen,
            arg_min(f.frame_id, f.timestamp_seconds) as frame_id,
            min(f.timestamp_seconds) as timestamp_seconds,
            min(f.timestamp_seconds) - n.last_seen as gap
            from nexts n join frames f on f.source_id = n.source_id and f.session_id = n.session_id
              and f.timestamp_seconds - n.last_seen > {th.track_timeout}
              and (n.nt is null or f.timestamp_seconds < n.nt)
            group by n.source_id, n.session_id, n.track_id, n.last_seen, n.nt"""),
        ("line", f"""select *, row_number() over (partition by {K} order by t) as rn from (
            select {K}, timestamp_seconds as t, frame_id, false as x, cast(0 as double) as gap,
              candidate_trigger as trig, fall_signal as fall, upright_signal as up,
              lying_posture as lie, speed_signal as spd, falling_posture as fal from sig {gone})"""),
        ("run", f"""select {K}, cast(0 as bigint) as rn, 0 as s, t as e, -1 as prev,
              cast(null as bigint) as frame_id, cast(null as double) as t, cast(0 as double) as el,
              false as spd, false as fal, false as lie, false as x, cast(0 as double) as gap
            from line where rn = 1
          union all
          select source_id, session_id, track_id, rn, n, case when n <> s then t else e end, s, frame_id,
              t, el, spd, fal, lie, x, gap
          from (select q.*, case when x then (case when s in (1, 2, 3, 4) then 5 else s end)
                  when s = 0 and trig then 1 when s = 1 and up and not fall then 0
                  when s = 1 and el + 1e-9 >= {th.suspect_duration} then 2
                  when s = 2 and (lie or el + 1e-9 >= {th.lying_duration}) then 3
                  when s = 3 and up then 4 when s = 4 and fall then 2
                  when s = 4 and el + 1e-9 >= {th.suspect_duration} and up then 5
                  when s = 5 and fall then 1 else s end as n
                from (select l.*, r.s, r.e, l.t - r.e as el from run r join line l
                      on l.source_id = r.source_id and l.session_id = r.session_id
                      and l.track_id = r.track_id and l.rn = r.rn + 1) q)"""),
        ("moves", f"""select {K}, frame_id, t as timestamp_seconds, {names}[prev + 1] as previous_state,
            {names}[s + 1] as next_state,
            case when x then printf('track timed out after %.3fs', gap)
              when prev = 0 then 'candidate triggered by ' || concat_ws(', ',
                case when spd then 'downward speed threshold' end,
                case when fal then 'configured falling posture' end)
              when prev = 1 and s = 0 then 'candidate cleared by upright posture and aspect ratio'
              when prev = 1 then printf('fall evidence persisted for %.3fs', el)
              when prev = 2 and lie then 'configured lying posture observed'
              when prev = 2 then printf('falling state persisted for %.3fs', el)
              when prev = 3 then 'upright evidence observed after lying state'
              when prev = 4 and s = 2 then 'fall evidence returned during recovery'
              when prev = 4 then printf('upright recovery persisted for %.3fs', el)
              else 'new fall evidence after resolved state' end as reason
            from run where rn > 0 and s <> prev"""),
    ]


def lifecycle(moves: list[tuple[str, str]] | None = None) -> list[tuple[str, str]]:
    """Event fold as a recursion over each track's state changes."""
    on = "m.source_id = f.source_id and m.session_id = f.session_id"
    return (moves or motion()) + [
        ("marks", f"""select m.*, row_number() over (partition by {K} order by timestamp_seconds) as rn,
            (select min(struct_pack(t := f.timestamp_seconds, f := f.frame_id)) from frames f
              where {on} and f.timestamp_seconds - m.timestamp_seconds > 10.0) as d,
            (select min(struct_pack(t := f.timestamp_seconds, f := f.frame_id)) from frames f
              where {on} and f.timestamp_seconds >= m.timestamp_seconds + 1.0) as w
            from moves m"""),
        ("ev", f"""select {K}, cast(0 as bigint) as rn, 0 as no, false as act,
              cast(null as double) as pt, cast(null as bigint) as pf, cast(null as double) as pdt,
              cast(null as bigint) as pdf, cast(null as bigint) as sf, cast(null as double) as st,
              cast(null as double) as dt, cast(null as bigint) as df, cast(null as double) as en,
              cast(null as bigint) as ef, cast('active' as varchar) as status,
              cast(null as double) as lie, cast(null as double) as sup, cast(null as double) as wt,
              cast(null as bigint) as wf, cast(null as double) as rt, cast(null as bigint) as rf,
              cast(null as double) as rl, cast(null as double) as ren
            from marks where rn = 1
          union all
          select source_id, session_id, track_id, rn, no,
              act and not late, pt, pf, pdt, pdf, sf, st, dt, df,
              case when late then t else en end, case when late then f else ef end,
              case when late then 'timed_out' else status end, lie, sup, wt, wf,
              case when rt is null and no > 0 and (en is not null or late or wt <= t) then t else rt end,
              case when rt is null and no > 0 and (en is not null or late or wt <= t) then f else rf end,
              case when rt is null and no > 0 and (en is not null or late or wt <= t) then lie else rl end,
              case when rt is null and no > 0 and (en is not null or late or wt <= t)
                then case when late then t else en end else ren end
          from (select *, act and dt is not null and dt <= t as late from (
            select source_id, session_id, track_id, rn, t, f,
              case when fresh then no + 1 else no end as no,
              case when act and nx = 'resolved' then false when act then true
                when fresh or merge then true else false end as act,
              case when act then pt when nx = 'suspected' then t when nx in ('upright', 'resolved') or rise then null else pt end as pt,
              case when act then pf when nx = 'suspected' then f when nx in ('upright', 'resolved') or rise then null else pf end as pf,
              case when act then pdt when nx = 'suspected' then mdt when nx in ('upright', 'resolved') or rise then null else pdt end as pdt,
              case when act then pdf when nx = 'suspected' then mdf when nx in ('upright', 'resolved') or rise then null else pdf end as pdf,
              case when fresh then coalesce(pf, f) else sf end as sf,
              case when fresh then coalesce(pt, t) else st end as st,
              case when fresh then case when pt is null then mdt else pdt end else dt end as dt,
              case when fresh then case when pt is null then mdf else pdf end else df end as df,
              case when act and nx = 'resolved' then t when fresh or merge then null else en end as en,
              case when act and nx = 'resolved' then f when fresh or merge then null else ef end as ef,
              case when act and nx = 'resolved' then 'resolved' when fresh or merge then 'active' else status end as status,
              case when act and nx = 'lying' then t when fresh then case when nx = 'lying' then t end else lie end as lie,
              case when fresh then null when hush then coalesce(pt, t) else sup end as sup,
              case when (act or fresh) and nx = 'lying' then mwt when fresh then null else wt end as wt,
              case when (act or fresh) and nx = 'lying' then mwf when fresh then null else wf end as wf,
              case when fresh then null else rt end as rt, case when fresh then null else rf end as rf,
              case when fresh then null else rl end as rl, case when fresh then null else ren end as ren
            from (select *,
                rise and no > 0 and coalesce(pt, t) - en <= 2.0 as merge,
                rise and no > 0 and coalesce(pt, t) - en > 2.0 and coalesce(pt, t) - en <= 5.0 as hush,
                rise and (no = 0 or coalesce(pt, t) - en > 5.0) as fresh
              from (select *, not act and nx in ('falling', 'lying') as rise from (
                select m.source_id, m.session_id, m.track_id, m.rn, m.timestamp_seconds as t, m.frame_id as f,
                  m.next_state as nx, m.d.t as mdt, m.d.f as mdf, m.w.t as mwt, m.w.f as mwf,
                  e.no, e.pt, e.pf, e.pdt, e.pdf, e.sf, e.st, e.dt, e.df, e.lie, e.sup, e.wt, e.wf,
                  e.act and not coalesce(e.dt < m.timestamp_seconds, false) as act,
                  case when e.act and e.dt < m.timestamp_seconds then e.dt else e.en end as en,
                  case when e.act and e.dt < m.timestamp_seconds then e.df else e.ef end as ef,
                  case when e.act and e.dt < m.timestamp_seconds then 'timed_out' else e.status end as status,
                  case when e.rt is not null or not e.act then e.rt
                    when e.wt < m.timestamp_seconds and (e.dt is null or e.wt < e.dt) then e.wt
                    when e.dt < m.timestamp_seconds then e.dt end as rt,
                  case when e.rt is not null or not e.act then e.rf
                    when e.wt < m.timestamp_seconds and (e.dt is null or e.wt < e.dt) then e.wf
                    when e.dt < m.timestamp_seconds then e.df end as rf,
                  case when e.rt is not null or not e.act then e.rl
                    when e.wt < m.timestamp_seconds and (e.dt is null or e.wt < e.dt) then e.lie
                    when e.dt < m.timestamp_seconds then e.lie end as rl,
                  case when e.rt is not null or not e.act then e.ren
                    when e.wt < m.timestamp_seconds and (e.dt is null or e.wt < e.dt) then null
                    when e.dt < m.timestamp_seconds then e.dt end as ren
                from ev e join marks m on m.source_id = e.source_id and m.session_id = e.session_id
                  and m.track_id = e.track_id and m.rn = e.rn + 1)))))"""),
        # what happens to the running event after its track's last change, or before the next event
        ("events_out", f"""select {K}, sf as start_frame, st as start_time,
            case when act and df is not null then df else ef end as end_frame,
            case when act and dt is not null then dt else en end as end_time,
            case when act and dt is not null then 'timed_out' else status end as status,
            lie as lying_started_at_seconds, sup as cooldown_suppressed_candidate_at,
            case when rt is not null or not act then rf
              when wt is not null and (dt is null or wt < dt) then wf else df end as review_frame,
            case when rt is not null or not act then rt
              when wt is not null and (dt is null or wt < dt) then wt else dt end as review_time,
            case when rt is not null or not act then rl else lie end as review_lying,
            case when rt is not null or not act then ren
              when wt is not null and (dt is null or wt < dt) then null else dt end as review_end
            from (select *, row_number() over (partition by {K}, no order by rn desc) as back
                  from ev where no > 0) where back = 1"""),
    ]


def partition_sql(subject: str) -> str:
    whens = " ".join(f"when {subject} in ({', '.join(map(str, m))}) then '{n}'"
                     for n, m in SUBJECTS.items())
    return f"case {whens} end"


CLIPS = f"""select *, {partition_sql('subject_id')} as partition,
    'fall29/' || regexp_replace(relative_path, '\\.[^./]+$', '') as video_id
  from (select *, try_cast(nullif(regexp_extract(relative_path, '(?:^|/)SBJ_(\\d+)_LOC(\\d+)(?:/|$)', 1), '') as int) as subject_id,
      try_cast(nullif(regexp_extract(relative_path, '(?:^|/)SBJ_(\\d+)_LOC(\\d+)(?:/|$)', 2), '') as int) as location_id,
      lower(split_part(relative_path, '/', 1)) as label
    from ({X.CLIPS})) where subject_id is not null"""

KEPT = f"select * from ({CLIPS}) qualify row_number() over (partition by sha256 order by relative_path) = 1"

METRICS = """count(*) as clips, count(*) filter (where expected_fall and predicted_fall) as true_positive_clips,
  count(*) filter (where not expected_fall and predicted_fall) as false_positive_clips,
  count(*) filter (where expected_fall and not predicted_fall) as false_negative_clips,
  count(*) filter (where not expected_fall and not predicted_fall) as true_negative_clips"""


def ratios(inner: str, keys: str) -> str:
    return f"""select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) end as f1
  from (select {keys}, clips, true_positive_clips, false_positive_clips, false_negative_clips, true_negative_clips,
    true_positive_clips / nullif(true_positive_clips + false_positive_clips, 0)::double as precision,
    true_positive_clips / nullif(true_positive_clips + false_negative_clips, 0)::double as recall,
    true_negative_clips / nullif(true_negative_clips + false_positive_clips, 0)::double as specificity
  from ({inner}))"""


PAIRS = """select g.source_id, g.session_id, g.track_id, g.event_id as ground_truth_id, p.event_id as predicted_id,
    greatest(0, least(g.end_time, p.end_time) - greatest(g.start_time, p.start_time))
      / (greatest(g.end_time, p.end_time) - least(g.start_time, p.start_time)) as temporal_iou,
    p.start_time - g.start_time as start_delay_seconds
  from gt g join pr p on g.source_id = p.source_id and g.session_id = p.session_id and g.track_id = p.track_id"""


def pairs() -> list[tuple[str, str]]:
    return [("gt", duck(X.TRUTH)), ("pr", duck(X.PREDICTIONS)),
            ("cand", f"select * from ({PAIRS}) where temporal_iou >= 0.3 or abs(start_delay_seconds) <= 0.5")]


def matches() -> list[tuple[str, str]]:
    """Greedy matching as a recursion over each track's ordered pairs."""
    return pairs() + [
        ("ranked", f"""select *, row_number() over (partition by {K} order by temporal_iou desc,
            abs(start_delay_seconds), ground_truth_id, predicted_id) as rn from cand"""),
        ("greedy", f"""select {K}, cast(0 as bigint) as rn, cast([] as varchar[]) as ug, cast([] as varchar[]) as up,
              false as won, '' as g, '' as p from ranked where rn = 1
            union all
            select r.source_id, r.session_id, r.track_id, r.rn,
              case when list_contains(w.ug, r.ground_truth_id) or list_contains(w.up, r.predicted_id) then w.ug
                else list_append(w.ug, r.ground_truth_id) end,
              case when list_contains(w.ug, r.ground_truth_id) or list_contains(w.up, r.predicted_id) then w.up
                else list_append(w.up, r.predicted_id) end,
              not (list_contains(w.ug, r.ground_truth_id) or list_contains(w.up, r.predicted_id)),
              r.ground_truth_id, r.predicted_id
            from greedy w join ranked r on r.source_id = w.source_id and r.session_id = w.session_id
              and r.track_id = w.track_id and r.rn = w.rn + 1"""),
        ("matched", """select c.ground_truth_id, c.predicted_id, c.temporal_iou, c.start_delay_seconds
            from greedy w join cand c on c.ground_truth_id = w.g and c.predicted_id = w.p where w.won"""),
    ]


HASHED = f"""select image_id, split, md5(cast(px as varchar)) as sha,
    list_transform(range(0, 64), lambda i: case when px[cast(i + i // 8 + 1 as int)] > px[cast(i + i // 8 + 2 as int)] then 1 else 0 end) as bits
  from ({X.PIXELS_DUCK})"""
NEAR = f"""select a.split as first_split, b.split as second_split, a.image_id as first_id, b.image_id as second_id,
    list_sum(list_transform(list_zip(a.bits, b.bits), lambda z: abs(z[1] - z[2])))::bigint as distance
  from hashed a join hashed b on a.split < b.split and a.sha <> b.sha"""
