"""Small tables for tests, and plain loops that say what the operators must give."""

from __future__ import annotations

import random

from kinewatch.functions.scalars import REASONS
from kinewatch.params import EventParams, PostureGroups, Thresholds

OBS = ("source_id string, session_id string, track_id int, frame_id long, timestamp_seconds double, "
       "frame_width int, frame_height int, class_name string, x1 double, y1 double, x2 double, "
       "y2 double, confidence double, detection_id string")
FRAME = ("source_id string, session_id string, frame_id long, timestamp_seconds double, "
         "frame_width int, frame_height int")


def obs_row(frame, t, box, name, track=7, source="source", session="session", size=(100, 100)):
    return (source, session, track, frame, float(t), *size, name, *map(float, box), 0.9,
            f"{source}-{session}-{track}-{frame}")


def frame_row(frame, t, source="source", session="session", size=(100, 100)):
    return (source, session, frame, float(t), *size)


def random_video(seed: int, frames: int = 150, tracks: int = 3, step: float = 0.2):
    """Observations and frames of one scope with gaps, falls and recoveries."""
    rng = random.Random(seed)
    obs, rows = [], []
    names = ["standing", "standing", "sitting", "bending", "falling", "lying", "lying"]
    for f in range(frames):
        t = round(f * step + rng.random() * 0.05, 4)
        rows.append(frame_row(f, t, f"cam{seed}", "s", (640, 480)))
        for k in range(tracks):
            if (f // 12 + k) % 5 == 4 and rng.random() < 0.9:  # longer absences
                continue
            if rng.random() < 0.1:
                continue
            name = rng.choice(names)
            w, h = (160, 60) if name == "lying" else (rng.uniform(40, 120), rng.uniform(80, 160))
            x, y = rng.uniform(0, 400), rng.uniform(0, 300)
            obs.append(obs_row(f, t, (x, y, x + w, y + h), name, k, f"cam{seed}", "s", (640, 480)))
    return obs, rows


def replay(obs, frames, th: Thresholds = Thresholds(), p: EventParams = EventParams(),
           g: PostureGroups = PostureGroups()):
    """Frame by frame: state changes, change rows and review rows of one scope."""
    by_frame: dict = {}
    for o in obs:
        by_frame.setdefault(o[3], []).append(o)
    tracks: dict = {}
    events: dict = {}
    changes, reviews, moves = [], [], []

    def reason_signals(fast, falling):
        return REASONS["trigger"] + ", ".join(
            REASONS[k] for k, on in (("speed", fast), ("falling", falling)) if on)

    def snapshot(e):
        return (e["track"], e["sf"], e["st"], e["ef"], e["et"], e["status"], e["lying"], e["hush"],
                tuple(e["reasons"]))

    def on_change(k, f, t, after, why):
        s = tracks[k]
        e = s["event"]
        if s["active"]:
            e["reasons"].append(why)
            if after == "lying":
                e["lying"] = t
            if after == "resolved":
                e.update(ef=f, et=t, status="resolved")
                s["active"] = False
            changes.append((f, snapshot(e)))
            return
        if after == "suspected":
            s["pending"] = (f, t, why)
        elif after in ("upright", "resolved"):
            s["pending"] = None
        elif after in ("falling", "lying"):
            sf, st, sw = s["pending"] or (f, t, why)
            s["pending"] = None
            reasons = [sw] + ([why] if why != sw else [])
            if e is not None:
                gap = st - e["et"]
                if gap <= p.merge_gap:
                    e.update(ef=None, et=None, status="active")
                    e["reasons"] += ["merged: " + r for r in reasons]
                    s["active"] = True
                    changes.append((f, snapshot(e)))
                    return
                if gap <= p.cooldown:
                    e["hush"] = st
                    changes.append((f, snapshot(e)))
                    return
            e = dict(track=k, sf=sf, st=st, ef=None, et=None, status="active",
                     lying=t if after == "lying" else None, hush=None, reasons=reasons, seen=False)
            s["event"], s["active"] = e, True
            events[(k, sf)] = e
            changes.append((f, snapshot(e)))

    def move(k, f, t, after, why):
        s = tracks[k]
        moves.append((k, f, s["state"], after, why))
        s["state"], s["entered"] = after, t
        on_change(k, f, t, after, why)

    for _, _, f, t, _, _ in frames:
        here = by_frame.get(f, [])
        for o in here:
            k, height, name = o[2], o[6], o[7].lower()
            x1, y1, x2, y2 = o[8:12]
            s = tracks.setdefault(k, dict(state="upright", entered=t, last=None, hist=[], event=None,
                                          active=False, pending=None))
            cy, aspect, speed = (y1 + y2) / 2, (x2 - x1) / (y2 - y1), 0.0
            if s["last"] is not None:
                speed = (cy - s["last"][1]) / height / (t - s["last"][0])
                s["hist"] = (s["hist"] + [(aspect, speed)])[-th.smoothing_window:]
                aspect = sum(a for a, _ in s["hist"]) / len(s["hist"])
                speed = sum(v for _, v in s["hist"]) / len(s["hist"])
            s["last"] = (t, cy)
            falling, lying = name in g.fall, name in g.lying
            fast = speed >= th.vertical_speed_min
            fall = fast or falling or lying or aspect >= th.aspect_ratio_fall_min
            up = name in g.upright and aspect <= th.upright_aspect_ratio_max
            spent, st = t - s["entered"], s["state"]
            long = spent + 1e-9 >= th.suspect_duration
            held = spent + 1e-9 >= th.lying_duration
            if st == "upright" and (fast or falling):
                move(k, f, t, "suspected", reason_signals(fast, falling))
            elif st == "suspected" and up and not fall:
                move(k, f, t, "upright", REASONS["cleared"])
            elif st == "suspected" and long:
                move(k, f, t, "falling", f"{REASONS['persisted']}{spent:.3f}s")
            elif st == "falling" and (lying or held):
                move(k, f, t, "lying", REASONS["lying"] if lying else f"{REASONS['held']}{spent:.3f}s")
            elif st == "lying" and up:
                move(k, f, t, "recovering", REASONS["upright"])
            elif st == "recovering" and fall:
                move(k, f, t, "falling", REASONS["returned"])
            elif st == "recovering" and long and up:
                move(k, f, t, "resolved", f"{REASONS['recovered']}{spent:.3f}s")
            elif st == "resolved" and fall:
                move(k, f, t, "suspected", REASONS["again"])
        for k, s in tracks.items():
            gap = t - s["last"][0]
            if gap > th.track_timeout and s["state"] not in ("upright", "resolved"):
                move(k, f, t, "resolved", f"{REASONS['expired']}{gap:.3f}s")
        for s in tracks.values():
            e = s["event"]
            if s["active"] and t - e["st"] > p.timeout:
                e.update(ef=f, et=t, status="timed_out")
                e["reasons"].append("event timeout reached")
                s["active"] = False
                changes.append((f, snapshot(e)))
        for e in events.values():
            waited = e["lying"] is not None and t >= e["lying"] + p.after_offset
            if not e["seen"] and (waited or e["et"] is not None):
                e["seen"] = True
                reviews.append((f, snapshot(e), tracks[e["track"]]["state"]))
    return moves, changes, reviews
