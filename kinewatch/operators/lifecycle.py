"""Event bookkeeping of one track, shared by the batch and the streaming operator."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from kinewatch.params import STATES, EventParams

LIFECYCLE_COLUMNS = [
    "kind", "seq", "frame_id", "timestamp_seconds", "start_frame", "start_time", "end_frame",
    "end_time", "status", "lying_started_at_seconds", "cooldown_suppressed_candidate_at",
    "transition_reasons", "temporal_state",
]
LIFECYCLE_TYPES = (
    "kind string, seq int, frame_id long, timestamp_seconds double, start_frame long, "
    "start_time double, end_frame long, end_time double, status string, "
    "lying_started_at_seconds double, cooldown_suppressed_candidate_at double, "
    "transition_reasons array<string>, temporal_state string"
)

#: Quiet time since the latest event: name of the class and the parameter that bounds it, nearest first; beyond is `far`.
GAPS = [("merging", "merge_gap"), ("cooling", "cooldown")]

#: What a state change does: (phase, next state) -> steps, in order. Pairs that aren't named do nothing.
CHANGES = {("open", state): ("note", "tell") for state in STATES} | {
    ("open", "lying"): ("note", "lie", "tell"),
    ("open", "resolved"): ("note", "end", "tell"),
    ("merging", "falling"): ("drop", "reopen", "tell"),
    ("merging", "lying"): ("drop", "reopen", "tell"),
    ("cooling", "falling"): ("drop", "suppress", "tell"),
    ("cooling", "lying"): ("drop", "suppress", "tell"),
    ("far", "falling"): ("drop", "open", "tell"),
    ("far", "lying"): ("drop", "open", "lie", "tell"),
} | {(phase, state): steps for phase in ("merging", "cooling", "far")
     for state, steps in (("suspected", ("hold",)), ("upright", ("drop",)), ("resolved", ("drop",)))}


@dataclass
class Mark:
    """A state change that may become the start of an event."""

    frame_id: int
    t: float
    reason: str
    deadline: tuple[int, float] | None = None  # first frame past the timeout, where it is known


@dataclass
class Event:
    start_frame: int
    start_time: float
    reasons: list[str]
    deadline: tuple[int, float] | None = None
    end_frame: int | None = None
    end_time: float | None = None
    status: str = "active"
    lying_at: float | None = None
    suppressed_at: float | None = None
    reviewed: bool = False
    seq: int = 0


@dataclass
class Episodes:
    """Pending candidate plus the latest event of one track; older events never change again."""

    params: EventParams
    pending: Mark | None = None
    event: Event | None = None
    active: bool = False
    state: str = "upright"
    due: tuple[int, float] | None = None  # first frame at which the lying wait is over, if known
    out: list[tuple] = field(default_factory=list)

    def emit(self, kind: str, frame_id: int, t: float) -> None:
        e = self.event
        e.seq += 1
        self.out.append((
            kind, e.seq, frame_id, t, e.start_frame, e.start_time, e.end_frame, e.end_time,
            e.status, e.lying_at, e.suppressed_at, list(e.reasons), self.state))

    def close(self, frame_id: int, t: float, status: str) -> None:
        self.event.end_frame, self.event.end_time, self.event.status = frame_id, t, status
        self.active = False

    def time_out(self, frame_id: int, t: float) -> None:
        self.close(frame_id, t, "timed_out")
        self.event.reasons.append("event timeout reached")
        self.emit("change", frame_id, t)

    def review(self, frame_id: int, t: float) -> None:
        self.event.reviewed = True
        self.emit("review", frame_id, t)

    def phase(self, start: Mark) -> str:
        """`open` while an event runs, else how far `start` is from the end of the latest one."""
        if self.active:
            return "open"
        quiet = start.t - self.event.end_time if self.event is not None else float("inf")
        return next((name for name, bound in GAPS if quiet <= getattr(self.params, bound)), "far")

    def transition(self, mark: Mark, after: str, due: tuple[int, float] | None = None) -> None:
        """Runs the steps that CHANGES names for this phase and state."""
        self.state = after
        start = self.pending or mark
        texts = list(dict.fromkeys((start.reason, mark.reason)))
        for step in CHANGES.get((self.phase(start), after), ()):
            match step:
                case "hold":
                    self.pending = mark
                case "drop":
                    self.pending = None
                case "open":
                    self.event, self.active, self.due = Event(start.frame_id, start.t, texts, start.deadline), True, None
                case "reopen":
                    self.event.end_frame, self.event.end_time, self.event.status = None, None, "active"
                    self.event.reasons += [f"merged: {text}" for text in texts]
                    self.active = True
                case "suppress":
                    self.event.suppressed_at = start.t
                case "note":
                    self.event.reasons.append(mark.reason)
                case "lie":
                    self.event.lying_at, self.due = mark.t, due
                case "end":
                    self.close(mark.frame_id, mark.t, "resolved")
                case "tell":
                    self.emit("change", mark.frame_id, mark.t)

    # --- batch: frames are known in advance ------------------------------------------------------

    def advance(self, until: float) -> None:
        """Timeout and review that fall on frames strictly before `until`."""
        if not self.active:
            return
        e = self.event
        if not e.reviewed and self.due and self.due[1] < until and (
                e.deadline is None or self.due[1] < e.deadline[1]):
            self.review(*self.due)
        if e.deadline and e.deadline[1] < until:
            self.time_out(*e.deadline)
            if not e.reviewed:
                self.review(*e.deadline)

    def settle(self, frame_id: int, t: float) -> None:
        """Timeout and review on the frame of the state change just applied."""
        e = self.event
        if self.active and e.deadline and e.deadline[1] <= t:
            self.time_out(frame_id, t)
        if e is not None and not e.reviewed and (
                e.end_time is not None or (self.due is not None and self.due[1] <= t)):
            self.review(frame_id, t)

    # --- stream: frames arrive one by one --------------------------------------------------------

    def on_frame(self, frame_id: int, t: float) -> None:
        e = self.event
        if e is None:
            return
        if self.active and t - e.start_time > self.params.timeout:
            self.time_out(frame_id, t)
        waited = e.lying_at is not None and t >= e.lying_at + self.params.after_offset
        if not e.reviewed and (waited or e.end_time is not None):
            self.review(frame_id, t)

    def dump(self) -> dict:
        return {"pending": self.pending and asdict(self.pending),
                "event": self.event and asdict(self.event),
                "active": self.active, "state": self.state}

    @classmethod
    def load(cls, params: EventParams, saved: dict) -> Episodes:
        return cls(params, saved["pending"] and Mark(**saved["pending"]),
                   saved["event"] and Event(**saved["event"]), saved["active"], saved["state"])
