"""Column helpers. Every function takes columns and returns one column, native but for `canonical_text`."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def temporal_iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Overlap over the hull of two intervals; 0 when they are disjoint or the hull is empty."""
    overlap = F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    hull = F.greatest(a_end, b_end) - F.least(a_start, b_start)
    return F.when(hull > 0, overlap / hull).otherwise(F.lit(0.0))


def safe_ratio(num: Column, den: Column) -> Column:
    """num/den, null when the denominator is zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def f1(precision: Column, recall: Column) -> Column:
    """Harmonic mean, null when either side is null or both are zero."""
    return F.try_divide(2 * precision * recall, precision + recall)


def canonical_sha256(**fields: Column) -> Column:
    """Digest of the named fields as compact JSON with sorted keys."""
    body = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.sha2(F.to_json(body, {"ignoreNullFields": "false"}), 256)


@F.pandas_udf(StringType())
def canonical_text(text: pd.Series) -> pd.Series:
    """Any JSON text with the keys of all its objects sorted, without blanks and escapes; null where it isn't JSON."""

    def one(value: str | None) -> str | None:
        try:
            return None if value is None else json.dumps(json.loads(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return text.map(one)


def canonical_text_sha256(text: Column) -> Column:
    """Digest of any JSON value, equal for equal values whatever the order of their keys."""
    return F.sha2(canonical_text(text), 256)


def file_digest(content: Column, algorithm: str = "sha256") -> Column:
    if algorithm == "md5":
        return F.md5(content)
    if algorithm == "sha256":
        return F.sha2(content, 256)
    raise ValueError(f"unsupported digest: {algorithm}")


def difference_hash(pixels: Column) -> Column:
    """64-bit gradient hash of 72 row-major gray values (8 rows of 9), most significant bit first."""

    def step(acc: Column, i: Column) -> Column:
        # i counts the 64 comparisons; every finished row skips one extra pixel
        at = i + F.floor(i / 8).cast("int") + 1
        bit = F.element_at(pixels, at) > F.element_at(pixels, at + 1)
        return F.shiftleft(acc, 1).bitwiseOR(F.when(bit, F.lit(1)).otherwise(F.lit(0)).cast("long"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), step)


def hash_hex(value: Column) -> Column:
    """16 lower-case hex digits of a signed 64-bit hash."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def hamming_distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


# Sensitive-text patterns in the order they are applied, and their replacements.
REDACTIONS = [
    (r"(?i)(authorization\s*[:=]\s*(?:bearer\s+)?)[^\s,;]+", "$1[REDACTED]"),
    (r"(?i)((?:api[_-]?key|token|secret|password)\s*[:=]\s*)[^\s,;]+", "$1[REDACTED]"),
    (r"(?i)data:image/[^;]+;base64,[A-Za-z0-9+/=]+", "[REDACTED_IMAGE]"),
    (r"\bsk-[A-Za-z0-9_-]{12,}\b", "[REDACTED_IMAGE]"),
]


def redact_text(text: Column) -> Column:
    for pattern, replacement in REDACTIONS:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def session_id(prefix: Column, seed: Column) -> Column:
    """Readable prefix with dashes for blanks, plus 12 hex digits that depend only on the seed."""
    name = F.regexp_replace(F.regexp_replace(prefix, r"^\s+|\s+$", ""), r"\s+", "-")
    return F.concat(
        F.when(name == "", F.lit("run")).otherwise(name),
        F.lit("-"),
        F.substring(F.sha2(seed.cast("string"), 256), 1, 12),
    )


def percentile_linear(value: Column, quantile: float) -> Column:
    """Exact percentile, linear between the two neighbors of (n-1)*q."""
    return F.percentile(value, F.lit(quantile))


def resolve_class_name(
    class_id: Column, class_names: dict[int, str], aliases: dict[str, str], raw: Column | None = None
) -> Column:
    """Model's own name, else configured name, else class_<id>; then the alias."""
    parts = [] if raw is None else [raw]
    if class_names:
        parts.append(F.try_element_at(_literal_map(class_names, "int"), class_id.cast("int")))
    parts.append(F.concat(F.lit("class_"), class_id.cast("string")))
    name = F.coalesce(*parts)
    if not aliases:
        return name
    return F.coalesce(F.try_element_at(_literal_map(aliases, "string"), name), name)


def _literal_map(items: dict, key_type: str) -> Column:
    flat: list[Column] = []
    for key, value in items.items():
        flat += [F.lit(key).cast(key_type), F.lit(value)]
    return F.create_map(*flat)


def portable_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def is_sha256(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[0-9a-f]{64}\z"), F.lit(False))


def is_commit(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[0-9a-f]{40}\z"), F.lit(False))


def half_even(value: Column) -> Column:
    """Round half to even, as a whole number."""
    return F.bround(value).cast("long")


def in_group(name: Column, members: tuple[str, ...]) -> Column:
    return F.lower(name).isin(*[m.lower() for m in members]) if members else F.lit(False)


def strictly_after(start: Column, delay: float | Column) -> Column:
    """Least double x with x - start > delay, so that an equi/range search keeps that comparison.

    start + delay may miss it by a rounding step, so the neighbors on both sides are tried too.
    """
    base = start + delay
    steps = F.array(*[base * F.lit(1.0 + k * 2.220446049250313e-16) for k in (-2, -1, 0, 1, 2, 3)])
    return F.array_min(F.filter(steps, lambda x: x - start > delay))


# Reason texts of a state change.
REASONS = {
    "trigger": "candidate triggered by ",
    "speed": "downward speed threshold",
    "falling": "configured falling posture",
    "cleared": "candidate cleared by upright posture and aspect ratio",
    "persisted": "fall evidence persisted for ",
    "lying": "configured lying posture observed",
    "held": "falling state persisted for ",
    "upright": "upright evidence observed after lying state",
    "returned": "fall evidence returned during recovery",
    "recovered": "upright recovery persisted for ",
    "again": "new fall evidence after resolved state",
    "expired": "track timed out after ",
}


def transition_reason(
    before: Column, after: Column, elapsed: Column, speed: Column, falling: Column,
    lying: Column, expired: Column, gap: Column,
) -> Column:
    """Text for one state change; before/after are state names, times have three decimals."""

    def timed(key: str, seconds: Column) -> Column:
        return F.format_string(REASONS[key] + "%.3fs", seconds)

    signals = F.concat_ws(
        ", ",
        F.when(speed, F.lit(REASONS["speed"])),
        F.when(falling, F.lit(REASONS["falling"])),
    )
    return (
        F.when(expired, timed("expired", gap))
        .when(before == "upright", F.concat(F.lit(REASONS["trigger"]), signals))
        .when((before == "suspected") & (after == "upright"), F.lit(REASONS["cleared"]))
        .when(before == "suspected", timed("persisted", elapsed))
        .when((before == "falling") & lying, F.lit(REASONS["lying"]))
        .when(before == "falling", timed("held", elapsed))
        .when(before == "lying", F.lit(REASONS["upright"]))
        .when((before == "recovering") & (after == "falling"), F.lit(REASONS["returned"]))
        .when(before == "recovering", timed("recovered", elapsed))
        .otherwise(F.lit(REASONS["again"]))
    )
