"""The ingestion gate: each draft's first failure decides, and what passes is deduplicated and appended."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from millrace.functions.keys import json_string, utc_text
from millrace.operators.append import classify_append
from millrace.operators.privacy import governing_decision, policy_decision, retraction_target
from millrace.shared import materialize

#: Schemas of messages, systems that have channels, with the payload field of the channel's own id, and what a message must tell.
MESSAGE_SCHEMAS = ("schema:slack-message", "schema:gmail-message", "schema:discord-message")
CHANNEL_SYSTEMS = {"sys:slack": "channel_id", "sys:gmail": "account_id", "sys:discord": "channel_id"}
CHANNEL_KEYS = ["source_instance", "communication_channel_kind", "communication_channel_external_id", "communication_sender_id", "communication_thread_ref"]
CLOCK_SKEW_SECONDS = 600


#: JSON types and what they are in Python.
KINDS = {"string": str, "object": dict, "array": list, "boolean": bool, "number": (int, float), "integer": int, "null": type(None)}


def _problem(value, spec: dict, where: str) -> str | None:
    """The first rule of a JSON Schema (type, enum, const, required, properties, items, bounds, pattern) that a value breaks, at any depth."""
    types = spec.get("type", [])
    types = [types] if isinstance(types, str) else types
    if types and not any(isinstance(value, KINDS[t]) and (t == "boolean" or not isinstance(value, bool)) or t == "integer" and isinstance(value, float) and value.is_integer() for t in types if t in KINDS):
        return f"{where} is not {' or '.join(types)}"
    if "enum" in spec and value not in spec["enum"] or "const" in spec and value != spec["const"]:
        return f"{where} is not allowed"
    if isinstance(value, str):
        if not spec.get("minLength", 0) <= len(value) <= spec.get("maxLength", len(value)):
            return f"{where} is too short or too long"
        if "pattern" in spec and not re.search(spec["pattern"], value):
            return f"{where} does not match its pattern"
    if isinstance(value, (int, float)) and not isinstance(value, bool) and not spec.get("minimum", value) <= value <= spec.get("maximum", value):
        return f"{where} is out of bounds"
    if isinstance(value, dict):
        rules = spec.get("properties", {})
        for field in spec.get("required", []):
            if field not in value:
                return f"missing {field}" if where == "payload" else f"{where} misses {field}"
        for field, rule in rules.items():
            if field in value and (found := _problem(value[field], rule, field if where == "payload" else f"{where}.{field}")):
                return found
        if spec.get("additionalProperties") is False and (more := sorted(value.keys() - rules.keys())):
            return f"{where} has {more[0]}"
    if isinstance(value, list):
        if not spec.get("minItems", 0) <= len(value) <= spec.get("maxItems", len(value)):
            return f"{where} has too few or too many items"
        for i, item in enumerate(value):
            if "items" in spec and (found := _problem(item, spec["items"], f"{where}[{i}]")):
                return found
    return None


def schema_problem(schemas: dict[str, dict]):
    """A vectorized check of (schema name, payload JSON) against the schema, at any depth: what is wrong, or null. A payload is an object unless its schema says otherwise."""

    def one(name: str, text: str | None) -> str | None:
        try:
            value = json.loads(text or "null")
        except ValueError:
            return "payload is not JSON"
        return _problem(value, {"type": "object"} | (schemas.get(name) or {}), "payload")

    @pandas_udf("string")
    def problem(schema: pd.Series, payload: pd.Series) -> pd.Series:
        return pd.Series([one(s, p) for s, p in zip(schema, payload, strict=True)], dtype=object)

    return problem


def undeclared(schemas: dict[str, dict]):
    """A vectorized count of payload fields, at any depth, that the schema does not declare."""

    def count(value, spec: dict | None) -> int:
        if isinstance(value, list):
            return sum(count(v, (spec or {}).get("items")) for v in value)
        if not isinstance(value, dict) or spec is None or "properties" not in spec:
            return 0
        known = spec["properties"]
        return sum(1 if k not in known else count(v, known[k]) for k, v in value.items())

    @pandas_udf("long")
    def counted(schema: pd.Series, payload: pd.Series) -> pd.Series:
        return pd.Series([count(json.loads(p or "null"), schemas.get(s)) for s, p in zip(schema, payload, strict=True)])

    return counted


def meta(name: str) -> Column:
    """A string of a draft's metadata; null for any other type."""
    return json_string(F.col("meta"), f"$.{name}")


def channel_context(rows: DataFrame, channels: DataFrame) -> DataFrame:
    """rows (drafts) with is_message, channel (the row of channels that they name, or null) and reply_due_at.

    A draft is a message if its system has channels and its schema is a message's. A channel is looked up by the id that metadata
    give, else by kind, source instance and external id.
    """
    optional = {"default_consent_scope": "string", "freshness_threshold_seconds": "long", "break_glass_channel": "boolean", "break_glass_senders": "array<string>"}
    have = [F.col(n) if n in channels.columns else F.lit(None).cast(t).alias(n) for n, t in optional.items()]
    row = F.struct("id", "kind", "source_instance_id", "external_id", "enabled", "reply_slo_seconds", *have)
    by_id = channels.select(F.col("id").alias("told_id"), row.alias("by_id"))
    by_place = channels.select(F.concat(F.lit("sys:"), "kind").alias("told_system"), F.col("source_instance_id").alias("told_instance"), F.col("external_id").alias("told_external"), row.alias("by_place"))
    is_message = F.coalesce(F.col("source_system").isin(*CHANNEL_SYSTEMS) & F.col("schema").isin(*MESSAGE_SCHEMAS), F.lit(False))
    rows = rows.withColumns({"is_message": is_message, "told_id": F.when(is_message, meta("communication_channel_id"))})
    place = F.col("is_message") & F.col("told_id").isNull()
    rows = rows.withColumns({"told_system": F.when(place, F.col("source_system")), "told_instance": F.when(place, meta("source_instance")), "told_external": F.when(place, meta("communication_channel_external_id"))})
    rows = rows.join(by_id, "told_id", "left").join(by_place, ["told_system", "told_instance", "told_external"], "left").withColumn("channel", F.coalesce("by_id", "by_place"))
    due = F.timestamp_micros(F.unix_micros("published") + F.col("channel.reply_slo_seconds") * 1_000_000)
    return rows.withColumn("reply_due_at", due).drop("told_id", "told_system", "told_instance", "told_external", "by_id", "by_place")


def communication_meta() -> Column:
    """A message's metadata with what its channel adds: the keys that name channel, sender and thread, and an object with all of it."""
    c = lambda n: F.col(f"channel.{n}")
    told = F.struct(
        c("id").alias("channel_id"), c("kind"), c("source_instance_id").alias("source_instance"), c("external_id"), meta("communication_sender_id").alias("sender"), meta("communication_thread_ref").alias("thread_ref"), c("reply_slo_seconds"),
        utc_text(F.col("reply_due_at")).alias("reply_due_at"), c("freshness_threshold_seconds"), c("break_glass_channel"), c("break_glass_senders"))
    more = F.struct(c("id").alias("communication_channel_id"), c("kind").alias("communication_channel_kind"), c("external_id").alias("communication_channel_external_id"), told.alias("communication"))
    new = F.parse_json(F.to_json(more, {"ignoreNullFields": "false"})).cast("map<string, variant>")
    old = F.map_filter(F.parse_json("meta").cast("map<string, variant>"), lambda k, _: ~k.isin("communication_channel_id", "communication_channel_kind", "communication_channel_external_id", "communication"))
    return F.to_json(F.map_concat(old, new))


def gate(drafts: DataFrame, observers: DataFrame, schemas: dict[str, dict], channels: DataFrame, decisions: DataFrame, blobs: DataFrame, now: str) -> DataFrame:
    """drafts with outcome (accepted, rejected or quarantined), reason, and for messages of a known channel reply_due_at. An accepted message's meta tells its channel.

    observers: observer, source_system, schemas (array; empty or * allows all), authority_model, capture_model;
    schemas: name to a JSON Schema with x-version and x-observers; channels: the dimension table; decisions:
    consent decisions; blobs: blob_ref. The small dimension tables join by equality; the first failing check
    in order gives the reason. A draft has its observer's authority, or is of dual reference; it has its observer's capture. A heartbeat
    is lake authoritative (or dual) and an event, whoever its observer is. Consent is the newest decision about the subject and, for
    messages, their sender and channel; without one it is the channel's default. Policy is asked for a canonical write
    of the system with the draft's authority, so a draft of dual reference needs review. Drafts of one page may share anything, their keys too: consent is
    asked for by subject and identifiers, attachments by their list.
    """
    spark = drafts.sparkSession
    declared = spark.createDataFrame([(n, s.get("x-version", "1.0.0"), s.get("x-observers", [])) for n, s in schemas.items()], "schema string, declared_version string, declared_observers array<string>")
    known = observers.select("observer", F.col("source_system").alias("own_system"), F.col("schemas").alias("own_schemas"), F.col("authority_model").alias("own_authority"), F.col("capture_model").alias("own_capture"), F.lit(True).alias("known"))
    rows = channel_context(drafts.join(known, "observer", "left").join(declared, "schema", "left"), channels)
    told = F.when(F.col("is_message"), F.array_compact(F.array(meta("communication_sender_id"), meta("communication_channel_external_id"))))
    rows = rows.withColumn("told", told).withColumns({"asks": F.to_json(F.struct("subject", "told")), "lists": F.to_json(F.struct("attachments"))})
    status = governing_decision(rows.select("asks", "subject", "told").dropDuplicates(["asks"]), decisions, "asks", "subject", "told")
    rows = rows.join(status, "asks", "left")
    wanted = drafts.where(F.size("attachments") > 0).select(F.to_json(F.struct("attachments")).alias("lists"), "attachments").dropDuplicates(["lists"]).select("lists", F.explode("attachments").alias("blob_ref"))
    lacking = wanted.join(blobs.select("blob_ref").distinct(), "blob_ref", "left_anti").select("lists", F.lit(True).alias("lacks_blob")).distinct()
    rows = rows.join(lacking, "lists", "left").withColumn("schema_problem", schema_problem(schemas)("schema", "payload"))
    heartbeat, is_message = F.col("schema") == "schema:observer-heartbeat", F.col("is_message")
    authority = F.when(heartbeat, F.lit("lake_authoritative")).otherwise(F.col("own_authority"))
    capture = F.when(heartbeat, F.lit("event")).otherwise(F.col("own_capture"))
    any_schema = (F.size("own_schemas") == 0) | F.array_contains("own_schemas", "*") | F.array_contains("own_schemas", F.col("schema"))
    lacks_key = F.exists(F.array(*[meta(k) for k in CHANNEL_KEYS]), lambda v: v.isNull())
    c = lambda n: F.col(f"channel.{n}")
    differs = (F.concat(F.lit("sys:"), c("kind")) != F.col("source_system")) | (c("source_instance_id") != meta("source_instance")) | (c("external_id") != meta("communication_channel_external_id"))
    payload_id = json_string(F.col("payload"), "$.channel_id")
    for system, field in CHANNEL_SYSTEMS.items():
        payload_id = F.when(F.col("source_system") == system, json_string(F.col("payload"), f"$.{field}")).otherwise(payload_id)
    decided = policy_decision(F.lit("system_admin"), F.lit("write_canonical"), F.coalesce("status", c("default_consent_scope"), F.lit("restricted_capture")), F.lit("internal"), F.lit("production"), F.col("authority_model"))
    checks = [
        (F.col("known").isNull(), "rejected", "unknown observer"),
        (F.col("declared_version").isNull() | (F.col("schema_version") != F.col("declared_version")), "rejected", "unknown schema version"),
        (F.col("source_system").isNull() | (F.col("source_system") != F.col("own_system")), "rejected", "source system mismatch"),
        (~any_schema, "rejected", "schema not allowed for observer"),
        (~F.col("authority_model").eqNullSafe(authority) & ~F.col("authority_model").eqNullSafe("dual_reference"), "rejected", "authority mismatch"),
        (~F.col("capture_model").eqNullSafe(capture), "rejected", "capture mismatch"),
        ((F.size("declared_observers") > 0) & ~F.array_contains("declared_observers", F.col("observer")), "rejected", "observer not named by schema"),
        (F.col("schema_problem").isNotNull(), "rejected", "invalid payload"),
        (~retraction_target(F.col("meta"))["valid"], "rejected", "invalid retraction"),
        (is_message & lacks_key, "quarantined", "missing channel metadata"),
        (is_message & F.col("channel").isNull(), "quarantined", "unregistered channel"),
        (is_message & ~F.coalesce(c("enabled"), F.lit(False)), "quarantined", "disabled channel"),
        (is_message & differs, "quarantined", "channel is another's"),
        (is_message & ~payload_id.eqNullSafe(meta("communication_channel_external_id")), "quarantined", "channel differs from payload"),
        (decided["decision"] == "deny", "quarantined", "policy denied"),
        (decided["decision"] == "require_review", "quarantined", "policy review required"),
        (F.col("lacks_blob"), "rejected", "missing attachment"),
        (F.col("published") > F.to_timestamp(F.lit(now)) + F.expr(f"interval {CLOCK_SKEW_SECONDS} seconds"), "quarantined", "clock skew"),
    ]
    outcome, reason = F.lit("accepted"), F.lit(None).cast("string")
    for test, what, why in reversed(checks):
        test = F.coalesce(test, F.lit(False))
        outcome, reason = F.when(test, what).otherwise(outcome), F.when(test, why).otherwise(reason)
    rows = rows.withColumns({"outcome": outcome, "reason": reason})
    full = F.when((F.col("outcome") == "accepted") & is_message, communication_meta()).otherwise(F.col("meta"))
    return rows.select(*[full.alias("meta") if n == "meta" else n for n in drafts.columns], "outcome", "reason", "reply_due_at")


def ingest_page(gated: DataFrame, lake: DataFrame | None = None, content: str = "canonical", seq: str = "seq", atomic: bool = False) -> DataFrame:
    """gated (what gate() gives, with seq and canonical) with result: ingested, duplicate, rejected or quarantined, and reason.

    What the gate accepts goes on to the append: equal content of a known key is a duplicate, other content a collision and
    quarantined. Nothing that the gate refuses claims a key. atomic: if any draft of the page is refused, none is
    ingested (page refused).
    """
    names = gated.columns
    accepted = classify_append(gated.where("outcome = 'accepted'").drop("outcome", "reason"), lake, content=content, seq=seq)
    judged = accepted.select(*[n for n in names if n not in ("outcome", "reason")], F.col("outcome").alias("result"), F.when(F.col("outcome") == "conflict", "canonical collision").alias("reason"))
    judged = judged.withColumn("result", F.when(F.col("result") == "appended", "ingested").when(F.col("result") == "conflict", "quarantined").otherwise(F.col("result")))
    refused = gated.where("outcome <> 'accepted'").select(*[n for n in names if n not in ("outcome", "reason")], F.col("outcome").alias("result"), "reason")
    page = judged.unionByName(refused)
    if not atomic:
        return page
    page = materialize(page, "page")
    if page.where("result not in ('ingested', 'duplicate')").isEmpty():
        return page
    good = F.col("result") == "ingested"
    return page.withColumns({"result": F.when(good, "rejected").otherwise(F.col("result")), "reason": F.when(good, "page refused").otherwise(F.col("reason"))})


def dead_letters(page: DataFrame, now: str) -> DataFrame:
    """What ingest_page refused, as rows to append to the dead letters: idempotency_key, result, reason, at."""
    return page.where("result in ('rejected', 'quarantined')").select("idempotency_key", "result", "reason", F.to_timestamp(F.lit(now)).alias("at"))


def evolution_problems(old: dict, new: dict, old_version: str, new_version: str) -> list[str]:
    """What forbids a schema's new version: it must be later, and in one major version fields keep their meaning."""
    from millrace.functions.keys import parse_version

    a, b = parse_version(old_version), parse_version(new_version)
    out = [] if b > a else ["version does not increase"]
    if a[0] == b[0]:
        before, after = old.get("properties", {}), new.get("properties", {})
        if sorted(old.get("required", [])) != sorted(new.get("required", [])):
            out.append("required fields change")
        out += [f"{f} is removed" for f in sorted(before.keys() - after.keys())]
        out += [f"{f} is redefined" for f in sorted(before.keys() & after.keys()) if before[f] != after[f]]
        if after.keys() - before.keys() and a[1] == b[1]:
            out.append("new fields need a new minor version")
    return out
