"""The motion-state automaton as one table, from which the batch fold and the stream build their steps."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinewatch.functions.scalars import REASONS
from kinewatch.params import FALLING, LYING, RECOVERING, RESOLVED, SUSPECTED, UPRIGHT, Thresholds


class Edge(NamedTuple):
    source: int
    target: int
    evidence: frozenset[str]  # all of it must be there
    reason: str  # key of its text


def _edge(source: int, target: int, evidence: str, reason: str) -> Edge:
    return Edge(source, target, frozenset(evidence.split()), reason)


#: The first edge of a state whose evidence is complete is taken. `waited` and `held`: the suspect and the lying duration are over.
EDGES = (
    *(_edge(state, RESOLVED, "expired", "expired") for state in (SUSPECTED, FALLING, LYING, RECOVERING)),
    _edge(UPRIGHT, SUSPECTED, "trigger", "trigger"),
    _edge(SUSPECTED, UPRIGHT, "upright calm", "cleared"),
    _edge(SUSPECTED, FALLING, "waited", "persisted"),
    _edge(FALLING, LYING, "lying", "lying"),
    _edge(FALLING, LYING, "held", "held"),
    _edge(LYING, RECOVERING, "upright", "upright"),
    _edge(RECOVERING, FALLING, "fall", "returned"),
    _edge(RECOVERING, RESOLVED, "waited upright", "recovered"),
    _edge(RESOLVED, SUSPECTED, "fall", "again"),
)
#: Reasons whose text ends with the seconds spent in the state, or unseen.
WITH_SECONDS = {"persisted", "held", "recovered", "expired"}
SLACK = 1e-9  # of a duration


def evidence_of(signals: Mapping, spent, th: Thresholds) -> dict:
    """Evidence by name, of Columns or of plain values: signals (expired, trigger, fall, upright, lying) and time in state."""
    plain = not isinstance(spent, Column)
    return {**signals, "calm": not signals["fall"] if plain else ~signals["fall"],
            "waited": spent + SLACK >= th.suspect_duration, "held": spent + SLACK >= th.lying_duration}


def next_state(state: Column, evidence: Mapping[str, Column]) -> Column:
    """Code of the state after one row."""
    out = None
    for e in EDGES:
        fits = state == e.source
        for name in sorted(e.evidence):
            fits = fits & evidence[name]
        out = F.when(fits, F.lit(e.target)) if out is None else out.when(fits, F.lit(e.target))
    return out.otherwise(state)


def step(state: int, evidence: Mapping[str, bool]) -> Edge | None:
    """The edge taken by one row, if any."""
    return next((e for e in EDGES if e.source == state and all(evidence[n] for n in e.evidence)), None)


def reason_text(edge: Edge, seconds: float, signals: list[str]) -> str:
    """Text of an edge: with its seconds, or with the signals that triggered it."""
    if edge.reason == "trigger":
        return REASONS["trigger"] + ", ".join(REASONS[s] for s in signals)
    return REASONS[edge.reason] + (f"{seconds:.3f}s" if edge.reason in WITH_SECONDS else "")
