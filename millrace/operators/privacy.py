"""Consent, retraction, masking and policy."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from millrace.functions.keys import json_string

def latest_decisions(decisions: DataFrame, key: str) -> DataFrame:
    """key, status of the last decision by (published, recorded_at, id): order of arrival does not matter."""
    return decisions.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by("status", F.struct("published", "recorded_at", "id")).alias("status"))


def governing_decision(rows: DataFrame, decisions: DataFrame, id: str = "id", subject: str = "subject", keys: str = "keys") -> DataFrame:
    """id, status of the newest decision by (published, recorded_at, id) about a row's subject or one of its identifiers.

    rows: id, subject, keys (identifiers; null for none); decisions: subject, identifier (or null), status, published,
    recorded_at, id. A decision counts for its subject and for its identifier. Rows without any are not in the result.
    """
    order = F.struct("published", "recorded_at", F.col("id").alias("decision_id"), "status")
    about = decisions.select(F.explode(F.array(F.struct(F.lit("subject").alias("kind"), F.col("subject").alias("key")), F.struct(F.lit("identifier").alias("kind"), F.col("identifier").alias("key")))).alias("x"), order.alias("at"))
    latest = about.where("x.key is not null").groupBy("x.kind", "x.key").agg(F.max("at").alias("at"))
    named = F.concat(F.array(F.struct(F.lit("subject").alias("kind"), F.col(subject).alias("key"))), F.transform(F.coalesce(keys, F.array().cast("array<string>")), lambda k: F.struct(F.lit("identifier").alias("kind"), k.alias("key"))))
    asked = rows.select(F.col(id).alias("row_id"), F.explode(named).alias("x")).select("row_id", "x.kind", "x.key")
    return asked.join(latest, ["kind", "key"]).groupBy("row_id").agg(F.max("at").alias("at")).select(F.col("row_id").alias(id), "at.status")


def retraction_target(meta: Column) -> Column:
    """struct<observation_id, source_object_id, valid> of meta.retracts, null where meta has none.

    It is valid if it is an object of these two fields alone, both strings, and names at least one target.
    """
    target = F.get_json_object(meta, "$.retracts")
    fields, text = F.json_object_keys(target), lambda n: F.nullif(F.trim(json_string(target, f"$.{n}")), F.lit(""))
    typed = F.forall(fields, lambda f: ((f == "observation_id") & json_string(target, "$.observation_id").isNotNull()) | ((f == "source_object_id") & json_string(target, "$.source_object_id").isNotNull()))
    one, other = text("observation_id"), text("source_object_id")
    valid = F.coalesce(typed & (one.isNotNull() | other.isNotNull()), F.lit(False))
    there = F.array_contains(F.json_object_keys(meta), "retracts")
    return F.when(there, F.struct(F.when(valid, one).alias("observation_id"), F.when(valid, other).alias("source_object_id"), valid.alias("valid")))


def visible(rows: DataFrame, decisions: DataFrame, retractions: DataFrame, id: str = "id", object_id: str = "object_id", subject: str = "subject", keys: str = "keys") -> DataFrame:
    """Rows that neither a retraction nor the newest consent decision about their subject and identifiers hides.

    decisions as in governing_decision; only opted_out hides, and no decision leaves a row visible. retractions:
    observation_id, source_object_id (either may be null), and optionally valid: one that is not valid hides everything.
    Of rows that say so (schema, meta), consent decisions and retracting rows are hidden themselves. All joins are anti joins on equal
    keys; rows without keys or object id are not touched by those.
    """
    names = rows.columns
    if "valid" in retractions.columns and not retractions.where("not valid").isEmpty():
        return rows.where("false")
    if "schema" in names:
        rows = rows.where(F.coalesce(F.col("schema") != "schema:consent-decision", F.lit(True)))
    if "meta" in names:
        rows = rows.where(retraction_target(F.col("meta")).isNull())
    gone = retractions.select(F.col("observation_id").alias(id)).where(F.col(id).isNotNull()).distinct()
    gone_objects = retractions.select(F.col("source_object_id").alias(object_id)).where(F.col(object_id).isNotNull()).distinct()
    hidden = governing_decision(rows, decisions, id, subject, keys).where("status = 'opted_out'").select(id)
    return rows.join(gone, id, "left_anti").join(gone_objects, object_id, "left_anti").join(hidden, id, "left_anti").select(*names)


# ---- masking

RANK = {"public": 0, "internal": 1, "restricted": 2, "highly_sensitive": 3}


def mask_column(value: Column, level: str, viewer: str, strategy: str) -> Column:
    """A top-level column as a viewer sees it: redact, hash (of its JSON text) or exclude (null)."""
    if RANK[level] <= RANK[viewer]:
        return value
    if strategy == "redact":
        return F.lit("[REDACTED]")
    if strategy == "hash":
        return F.sha2(F.to_json(F.struct(value.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(value.alias("v")))) - 6).cast("binary"), 256)
    return F.lit(None).cast("string")


GONE = object()


def kept_value(value):
    """Without objects of visibility false: they leave arrays, and are null as children; GONE if the value is one."""
    if isinstance(value, dict):
        if value.get("visibility", value.get("Visibility")) is False:
            return GONE
        return {k: None if (v := kept_value(child)) is GONE else v for k, child in value.items()}
    if isinstance(value, list):
        return [v for v in map(kept_value, value) if v is not GONE]
    return value


def shown(value):
    """kept_value, or null for what is hidden as a whole."""
    kept = kept_value(value)
    return None if kept is GONE else kept


def _mask(value, path: str, strategy: str) -> bool:
    if isinstance(value, list):
        return any([_mask(v, path, strategy) for v in value])
    if not isinstance(value, dict):
        return False
    head, _, rest = path.partition(".")
    if head not in value:
        return any([_mask(v, path, strategy) for v in value.values()])
    if rest:
        return _mask(value[head], rest, strategy)
    if strategy == "exclude":
        del value[head]
    elif strategy == "redact":
        value[head] = "[REDACTED]"
    else:
        value[head] = hashlib.sha256(json.dumps(value[head], sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    return True


def mask_payload(viewer: str, fields: list[tuple[str, str, str]]):
    """A vectorized function over JSON text, for fields (dotted path, level, strategy) at any depth; with nested objects of visibility false removed."""
    hidden = [(path, strategy) for path, level, strategy in fields if RANK[level] > RANK[viewer]]

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        value = shown(json.loads(text))
        for path, strategy in hidden:
            _mask(value, path, strategy)
        return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))

    @pandas_udf("string")
    def masked(payload: pd.Series) -> pd.Series:
        return payload.map(one)

    return masked


# ---- policy

#: The capabilities of each role, and the capability that an operation needs.
CAPABILITIES = {
    "system_admin": ["read_registry", "search_catalog", "read_own_projection", "read_shared_projection", "run_projection_draft", "request_write_preview", "submit_proposal", "approve_proposal", "execute_managed_canonical_write", "export_data", "read_audit_trail"],
    "researcher": ["read_registry", "search_catalog", "read_own_projection", "read_shared_projection", "run_projection_draft", "request_write_preview", "submit_proposal"],
    "resident": ["read_own_projection", "search_catalog"],
    "external": ["search_catalog"],
    "agent": ["read_registry", "search_catalog", "run_projection_draft", "request_write_preview", "submit_proposal"],
}
NEEDED = {
    "read": "read_shared_projection", "write_canonical": "execute_managed_canonical_write", "write_annotation": "submit_proposal", "write_proposal": "submit_proposal",
    "export": "export_data", "publish": "approve_proposal", "run_build": "run_projection_draft", "read_restricted": "read_shared_projection",
}


def policy_decision(role: Column, operation: Column, consent: Column, scope: Column, environment: Column, authority: Column) -> Column:
    """struct<decision, reason>: consent first, then capability, then what needs review, else allow."""
    lookup = F.create_map(*[F.lit(x) for op, cap in NEEDED.items() for x in (op, cap)])
    granted = F.create_map(*[x for r, caps in CAPABILITIES.items() for x in (F.lit(r), F.array(*map(F.lit, caps)))])
    able = F.coalesce(F.array_contains(F.element_at(granted, role), F.element_at(lookup, operation)), F.lit(False))
    triggers = F.array_compact(
        F.array(
            F.when((operation == "export") & (scope == "highly_sensitive"), F.lit("high_sensitivity_export")),
            F.when((operation == "write_canonical") & (authority == "dual_reference"), F.lit("dual_reference_canonical_write")),
            F.when((environment == "export") & (scope == "restricted"), F.lit("restricted_data_export")),
            F.when(operation == "publish", F.lit("publication_review")),
        )
    )
    made = lambda decision, reason: F.struct(F.lit(decision).alias("decision"), reason.alias("reason"))
    return (
        F.when(consent == "opted_out", made("deny", F.lit("consent_opted_out")))
        .when(~able, made("deny", F.lit("insufficient_capability")))
        .when(F.size(triggers) > 0, made("require_review", F.array_join(triggers, ", ")))
        .otherwise(made("allow", F.lit("")))
    )
