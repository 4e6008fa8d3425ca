"""Scalar expressions: keys, identifiers, times, versions and labels. All are built-in functions."""

from __future__ import annotations

import base64
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _typed(doc: Column, path: str, kind: str) -> Column:
    value = F.try_variant_get(F.try_parse_json(doc), path, "variant")
    return F.when(F.schema_of_variant(value) == kind.upper(), F.try_variant_get(F.try_parse_json(doc), path, kind))


def json_string(doc: Column, path: str) -> Column:
    """A string at a JSON path; null for any other type."""
    return _typed(doc, path, "string")


def json_bool(doc: Column, path: str) -> Column:
    return _typed(doc, path, "boolean")


def utc_text(time: Column) -> Column:
    """A UTC time with as many digits after the second (none, three or six) as it needs."""
    micros = F.pmod(F.unix_micros(time), F.lit(1_000_000))
    form = lambda p: F.date_format(F.to_utc_timestamp(time, F.current_timezone()), f"yyyy-MM-dd'T'HH:mm:ss{p}'Z'")
    return F.when(micros == 0, form("")).when(micros % 1000 == 0, form(".SSS")).otherwise(form(".SSSSSS"))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def identity_key(source: Column, object_id: Column, canonical: Column) -> Column:
    return F.concat_ws(":", source, object_id, sha256(canonical))


def source_key(kind: str, *parts: Column) -> Column:
    """Keys of source objects: message, edit, delete, reaction, file (slack), revision (gslides), heartbeat."""
    forms = {
        "message": ("slack", "{0}", "{1}"),
        "edit": ("slack", "{0}", "{1}", "edit", "{2}"),
        "delete": ("slack", "{0}", "{1}", "delete"),
        "reaction": ("slack", "{0}", "{1}", "react", "{2}", "{3}"),
        "file": ("slack", "{0}", "{1}", "file", "{2}"),
        "revision": ("gslides", "{0}", "rev", "{1}"),
        "heartbeat": ("heartbeat", "{0}", "{1}"),
    }
    return F.concat_ws(":", *[parts[int(p[1])] if p[0] == "{" else F.lit(p) for p in forms[kind]])


def name_key(name: Column) -> Column:
    return F.lower(F.trim(name))


def identifier_key(kind: Column, value: Column, source: Column) -> Column:
    """Emails and names share one namespace and ignore case; other identifiers belong to their source."""
    shared = F.lower(kind).isin("email", "name")
    clean = F.trim(value)
    return F.when(clean != "", F.concat_ws("|", F.lower(kind), F.when(shared, F.lit("*")).otherwise(F.lower(source)), F.when(shared, F.lower(clean)).otherwise(clean)))


def slack_time(ts: Column) -> Column:
    """seconds.fraction to a timestamp; null for anything else."""
    ok = ts.rlike(r"^[0-9]+\.[0-9]+$")
    micros = F.rpad(F.substring(F.regexp_extract(ts, r"\.([0-9]+)$", 1), 1, 6), 6, "0")
    return F.when(ok, F.timestamp_micros((F.regexp_extract(ts, r"^([0-9]+)\.", 1).cast("long") * 1_000_000 + micros.cast("long"))))


def rfc3339(text: Column) -> Column:
    """A time with an offset; null if it is not valid."""
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), F.try_to_timestamp(F.regexp_replace(F.upper(text), "T", " ")))


def semver(text: Column) -> Column:
    """struct<major, minor, patch>, which sorts as versions do; null if it is not major.minor.patch."""
    parts = F.split(text, r"\.")
    return F.when(text.rlike(r"^\d+\.\d+\.\d+$"), F.struct(*[parts[i].cast("int").alias(n) for i, n in enumerate(("major", "minor", "patch"))]))


def agent_name(created_by: Column, lineage: Column) -> Column:
    """What follows agent:, or the last part of a lineage .../agent/<name>."""
    named = F.regexp_extract(F.coalesce(created_by, F.lit("")), r"^agent:(.+)$", 1)
    tail = F.regexp_extract(F.coalesce(lineage, F.lit("")), r"/agent/([^/]+)$", 1)
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(tail, F.lit("")))


def label_key(label: Column) -> Column:
    """ASCII lower case, white space collapsed."""
    lower = F.translate(label, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lower, r"(?U)\s+", " "))


def _trimmed(text: Column) -> Column:
    """Without white space (of any script) at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def labels_in(text: Column) -> Column:
    """array<struct<label, value>> of lines 'label: value' (ASCII or full-width colon), in order.

    A label has 2 to 30 characters and is neither made of digits and dots nor a URL's scheme. White space after the colon
    may go over line ends, so a value on the next line counts; a value may be empty.
    """
    #: Fixed value: a line with a label.
    pattern = F.lit(r"(?Umd)^\s*([^\n:：]{1,30}?)\s*[：:]\s*(.*)")
    both = F.zip_with(F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2)), lambda a, b: F.struct(_trimmed(a).alias("label"), _trimmed(b).alias("value")))
    return F.filter(both, lambda x: (F.length(x["label"]) >= 2) & ~x["label"].rlike(r"^[0-9.]+\z") & ~F.lower(x["label"]).isin("http", "https"))


def richness(email: Column, generated_email: Column, name: Column, bio: Column, picture: Column, gallery: Column, attributes: Column) -> Column:
    """Score of a profile: 10, 4, 4, 12, 6 points for what is there, 2 for a gallery image, 1 for an attribute."""
    there = lambda c, n: F.when(c.isNotNull(), n).otherwise(0)
    full = lambda c, n: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", n).otherwise(0)
    many = lambda c: F.coalesce(F.size(c), F.lit(0))
    return there(email, 10) + there(generated_email, 4) + full(name, 4) + full(bio, 12) + there(picture, 6) + 2 * many(gallery) + many(attributes)


def normalized_profile(profiles: DataFrame, text: list[str], email: list[str], url: list[str]) -> DataFrame:
    """profiles with trimmed texts and urls and lower-case addresses, null for what is blank; generated_email only where there is no email."""
    clean = lambda c: F.nullif(_trimmed(F.col(c)), F.lit(""))
    out = profiles.withColumns({c: clean(c) for c in (*text, *url)} | {c: F.lower(clean(c)) for c in email})
    return out.withColumn("generated_email", F.when(F.col("email").isNull(), F.col("generated_email"))) if "generated_email" in email else out


def privacy_keys(subject: Column, meta: Column, payload: Column) -> Column:
    """Subject, sender and the identifiers of a payload: what consent decisions may name."""
    fields = [F.get_json_object(payload, f"$.{n}") for n in ("identifier", "user_id", "from", "author_id", "email")]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(subject, F.get_json_object(meta, "$.communication_sender_id"), *fields))))


def encode_cursor(fields: dict) -> str:
    return base64.urlsafe_b64encode(json.dumps(fields, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(cursor: str, scope: str | None = None) -> dict:
    """The fields of a cursor; a cursor of another scope, or one that was altered, is an error."""
    try:
        fields = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except ValueError as e:
        raise ValueError("invalid cursor") from e
    if not isinstance(fields, dict) or scope is not None and fields.get("scope") != scope:
        raise ValueError("cursor of another scope")
    return fields


def parse_version(text: str) -> tuple[int, int, int]:
    m = re.fullmatch(r"(\d+)\.(\d+)\.(\d+)", text)
    if not m:
        raise ValueError(f"not a version: {text}")
    return int(m[1]), int(m[2]), int(m[3])
