"""Review requests, provider attempts, and the alert decision."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinewatch.params import AlertPolicy, ReviewPolicy

# What a provider answer may contain.
DECISIONS = ("fall", "not_fall", "uncertain")
RISKS = ("low", "medium", "high", "unknown")
PAYLOAD_KEYS = ("decision", "confidence", "reason", "attempt_to_stand", "risk_level",
                "model_recommends_alert")
PAYLOAD = ("decision string, confidence double, reason string, attempt_to_stand boolean, "
           "risk_level string, model_recommends_alert boolean")
ASSESSMENT = (PAYLOAD + ", provider string, model string, input_mode string, latency_ms double, "
              "schema_valid boolean, provider_success boolean, input_tokens long, output_tokens long")


@dataclass(frozen=True)
class Provider:
    name: str
    is_cloud: bool = False
    supports_images: bool = True
    max_images: int = 16


def validate_payload(df: DataFrame, col: str) -> DataFrame:
    """Parses a JSON answer and adds `payload` and `schema_valid`; extra or mistyped keys fail."""
    text = F.col(col)
    keys = F.json_object_keys(text)
    p = F.from_json(text, PAYLOAD)

    def given(key: str) -> Column:
        return F.coalesce(F.array_contains(keys, key), F.lit(False))

    def non_null(key: str) -> Column:
        return F.get_json_object(text, f"$.{key}").isNotNull()

    def typed(key: str) -> Column:
        return ~non_null(key) | p[key].isNotNull()

    ok = (
        keys.isNotNull()
        & (F.size(F.array_except(keys, F.array(*[F.lit(k) for k in PAYLOAD_KEYS]))) == 0)
        & p["decision"].isin(*DECISIONS)
        & (F.length(p["reason"]) > 0)
        & typed("confidence") & (p["confidence"].isNull() | p["confidence"].between(0.0, 1.0))
        & typed("attempt_to_stand") & typed("model_recommends_alert")
        & (~given("risk_level") | p["risk_level"].isin(*RISKS))
    )
    full = p.withField("risk_level", F.coalesce(p["risk_level"], F.lit("unknown")))
    return df.withColumn("schema_valid", F.coalesce(ok, F.lit(False))).withColumn(
        "payload", F.when(F.col("schema_valid"), full))


def gate_review_requests(requests: DataFrame, providers: list[Provider],
                         policy: ReviewPolicy) -> tuple[DataFrame, DataFrame]:
    """(allowed, blocked) requests per provider.

    Images reach a cloud provider only with configured and per-request consent; providers without
    image support get none; the rest are cut to the smaller of both limits.
    """
    options = F.array(*[
        F.struct(F.lit(p.name).alias("provider"), F.lit(p.is_cloud).alias("is_cloud"),
                 F.lit(p.supports_images).alias("supports_images"),
                 F.lit(min(p.max_images, policy.max_images)).alias("limit")) for p in providers])
    rows = requests.withColumn("_p", F.explode(options))
    has_images = F.size("image_refs") > 0
    consent = F.lit(policy.allow_cloud_images) & F.coalesce("cloud_image_consent", F.lit(False))
    rows = rows.withColumn("_blocked", F.col("_p.is_cloud") & has_images & ~consent)
    none = F.slice("image_refs", 1, 0)
    kept = F.when(F.col("_p.supports_images"), F.slice("image_refs", F.lit(1), F.col("_p.limit")))
    allowed = (rows.filter(~F.col("_blocked")).withColumn("provider", F.col("_p.provider"))
               .withColumn("image_refs", F.coalesce(kept, none)).drop("_p", "_blocked"))
    reason = F.concat(F.lit("cloud image review by "), F.col("_p.provider"),
                      F.lit(" requires both configured and per-request consent"))
    blocked = (rows.filter("_blocked").withColumn("provider", F.col("_p.provider"))
               .withColumn("reason", reason).drop("_p", "_blocked"))
    return allowed, blocked


def rule_provider(requests: DataFrame, decision: str = "fall") -> DataFrame:
    """Deterministic assessment for tests and demos."""
    if decision not in DECISIONS:
        raise ValueError(f"unknown decision: {decision}")
    is_fall = decision == "fall"
    values = {
        "decision": F.lit(decision),
        "confidence": F.lit(None if decision == "uncertain" else 1.0).cast("double"),
        "reason": F.lit("MOCK deterministic assessment; not model or benchmark evidence"),
        "attempt_to_stand": F.lit(None).cast("boolean"),
        "risk_level": F.lit("high" if is_fall else "unknown"),
        "model_recommends_alert": F.lit(is_fall),
        "provider": F.lit("mock"),
        "model": F.lit("deterministic-rule-v1"),
        "input_mode": F.when(F.size("image_refs") > 0, F.lit("images_and_text"))
        .otherwise(F.lit("text")),
        "latency_ms": F.lit(0.0),
        "schema_valid": F.lit(True),
        "provider_success": F.lit(True),
        "input_tokens": F.lit(None).cast("long"),
        "output_tokens": F.lit(None).cast("long"),
    }
    return requests.select("event_id", *[c.alias(n) for n, c in values.items()])


class ReviewError(Exception):
    """An expected provider failure: it becomes data, any other error stops the job."""


def review_with(requests: DataFrame, name: str,
                provider_factory: Callable[[], Callable[[dict], dict]]) -> DataFrame:
    """Runs a user provider over requests, one client per partition, and returns attempts.

    The provider gets a request as a dict and returns assessment fields.
    """
    fields = [f.strip().split(" ")[0] for f in ASSESSMENT.split(",")]
    schema = "event_id string, asked string, ok boolean, error string, " + ASSESSMENT

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        review = provider_factory()
        for pdf in batches:
            rows = []
            for request in pdf.to_dict("records"):
                try:
                    answer, error = review(request), None
                except ReviewError as exc:
                    answer, error = {}, f"{name}: {type(exc).__name__}: {exc}"
                rows.append((request["event_id"], name, error is None, error,
                             *[answer.get(f) for f in fields]))
            out = pd.DataFrame(
                rows, columns=["event_id", "asked", "ok", "error", *fields])
            for c in ("input_tokens", "output_tokens"):
                out[c] = out[c].astype("Int64")
            for c in ("confidence", "latency_ms"):
                out[c] = out[c].astype("Float64")
            yield out

    return requests.mapInPandas(run, schema)


def resolve_assessments(attempts: DataFrame, policy: ReviewPolicy) -> DataFrame:
    """First success in the configured order per event; the first failure before it is recorded.

    attempts: event_id, provider, ok, decision, error, and optionally `blocked` (a refused consent,
    which ends the chain). Only the configured providers are kept, so a row holds a handful of them.
    """
    names = list(policy.providers) if policy.allow_fallback else list(policy.providers[:1])
    refused = F.col("blocked") if "blocked" in attempts.columns else F.lit(False)
    entry = F.struct("ok", "decision", "error", refused.alias("blocked"))
    seen = attempts.groupBy("event_id").agg(
        *[F.max(F.when(F.col("provider") == n, entry)).alias(f"_{i}") for i, n in enumerate(names)])

    def link(i: int, n: str) -> Column:
        a = F.col(f"_{i}")
        off = n == "mock" and not policy.allow_mock
        text = (F.when(a.isNull(), F.lit(f"provider not registered: {n}"))
                .when(F.lit(off), F.lit("mock provider is disabled"))
                .when(~a["ok"] | a["blocked"], a["error"]))
        return F.struct(
            F.lit(i).alias("i"), F.lit(n).alias("provider"), a["decision"].alias("decision"),
            text.alias("failure"),
            (a.isNotNull() & ~F.lit(off) & F.coalesce(a["blocked"], F.lit(False))).alias("stop"))

    chain = seen.select("event_id", F.array(*[link(i, n) for i, n in enumerate(names)]).alias("c"))
    chain = chain.withColumn("_end", F.array_min(F.transform(
        "c", lambda x: F.when(x["stop"], x["i"]).otherwise(F.lit(len(names))))))
    hits = F.filter("c", lambda x: x["failure"].isNull() & (x["i"] < F.col("_end")))
    chain = chain.withColumn("hit", F.when(F.size(hits) > 0, F.element_at(hits, 1)))
    fails = F.filter("c", lambda x: x["failure"].isNotNull() & (
        x["i"] < F.coalesce(F.col("hit.i"), F.lit(len(names)))) & (x["i"] <= F.col("_end")))
    first = F.when(F.size(fails) > 0, F.element_at(fails, 1)["failure"])
    refusal = F.filter("c", lambda x: x["stop"])
    return chain.select(
        "event_id", F.col("hit.provider").alias("provider"), F.col("hit.decision").alias("decision"),
        F.when(F.col("hit").isNotNull(), first).alias("fallback_reason"),
        F.when(F.col("hit").isNull(), F.when(
            F.size(refusal) > 0, F.element_at(refusal, 1)["failure"]).otherwise(first))
        .alias("failure"))


def decide_alerts(events: DataFrame, assessments: DataFrame, policy: AlertPolicy) -> DataFrame:
    """One decision per event with its temporal_state; a model's recommendation is only recorded."""
    a = F.struct("decision", "provider_success", "schema_valid", "model_recommends_alert")
    rows = events.select("event_id", "temporal_state").join(
        assessments.select("event_id", a.alias("a")), "event_id", "left")
    a = F.col("a")
    usable = F.coalesce(a["provider_success"] & a["schema_valid"], F.lit(False))
    risky = F.lit(policy.high_temporal_risk_can_alert) & F.col("temporal_state").isin(
        "falling", "lying")
    on_fall = usable & (a["decision"] == "fall") & F.lit(policy.alert_on_semantic_fall)
    on_doubt = usable & (a["decision"] == "uncertain") & F.lit(policy.alert_on_semantic_uncertain)
    reasons = F.array_compact(F.array(
        F.when(~usable, F.lit("no successful schema-valid semantic assessment"))
        .when(on_fall, F.lit("schema-valid semantic decision is fall"))
        .when(on_doubt, F.lit("application policy alerts on semantic uncertainty"))
        .otherwise(F.concat(F.lit("application policy does not alert for semantic "), a["decision"])),
        F.when(~usable & risky,
               F.lit("application policy allows high temporal risk without semantics")),
        F.when(a["model_recommends_alert"].isNotNull(), F.concat(
            F.lit("provider recommendation recorded as evidence="),
            a["model_recommends_alert"].cast("string"))),
    ))
    alert = F.when(usable, on_fall | on_doubt).otherwise(risky)
    return rows.select("event_id", "temporal_state", alert.alias("should_alert"),
                       reasons.alias("reasons"))


def with_event_context(events: DataFrame, roles: Column | None = None) -> DataFrame:
    """Adds the JSON text a reviewer sees; missing values stay visible as null."""
    body = F.struct(
        "event_id", F.col("start_time").alias("start_time_seconds"),
        F.col("end_time").alias("end_time_seconds"), "status", "transition_reasons",
        (roles if roles is not None else F.array().cast("array<string>")).alias("keyframe_roles"))
    return events.withColumn("text_context", F.to_json(body, {"ignoreNullFields": "false"}))
