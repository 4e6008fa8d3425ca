"""The corpus of a workspace: chat messages, and the parts of its objects' snapshots, as rows of the corpus schema.

One snapshot makes many rows: a document one for each chunk, a spreadsheet one for each row of each tab. Nested parts are typed
variants that generators take apart, so that a part's number is its place in the tree. Each service reads the
snapshots of its own; text of any value is gathered in Arrow batches, for presentations alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from millrace.functions.keys import json_string
from millrace.functions.text import nfkc
from millrace.operators.corpus import Config, drive_allowed, slack_allowed
from millrace.shared import materialize

SNAPSHOT = "schema:workspace-object-snapshot"
NULLS = {"ignoreNullFields": "false"}


def string_of(value: Column) -> Column:
    """The string that a variant is; null for any other type."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def string_in(value: Column, path: str) -> Column:
    """A string within a variant; null for any other type."""
    return string_of(F.try_variant_get(value, path, "variant"))


def told(path: str) -> Column:
    """A string of the parsed payload; null for any other type."""
    return string_in(F.col("v"), f"$.{path}")


def parts_of(value: Column, path: str, *fields: str) -> Column:
    """The items of an array within a variant, taken apart in one cast: these fields of each, which are null if it is no object; null for any other type."""
    return F.try_variant_get(value, path, f"array<struct<{', '.join(f if ':' in f else f + ': variant' for f in fields)}>>")


def may_name(text: str, key: str) -> Column:
    """Whether a JSON text may hold an ASCII string: it stands there as it is, or some of it is escaped as \\u00... . A search in bytes, which spares most texts a parse."""
    return F.contains(F.col(text), F.lit(key)) | F.contains(F.col(text), F.lit("u00"))  # a backslash is frequent in quoted JSON, and slow to look for


def filled(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def value_text(value) -> str:
    """All strings of a JSON value, one a line, fields in alphabetical order; values of other types are empty lines."""
    if isinstance(value, str):
        return value
    items = value if isinstance(value, list) else [value[k] for k in sorted(value)] if isinstance(value, dict) else []
    return "\n".join(map(value_text, items))


@pandas_udf(StringType())
def gathered_text(payloads: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The text of a presentation: of its slides, if it has them, else of the whole payload."""

    def one(payload: str) -> str:
        value = json.loads(payload)
        native = value.get("native") if isinstance(value, dict) else None
        slides = native.get("slides") if isinstance(native, dict) else None
        return value_text(slides if isinstance(slides, list) else value)

    for batch in payloads:
        yield batch.map(one, na_action="ignore")


def form_response_sheets(observations: DataFrame) -> DataFrame:
    """sheet_id of the spreadsheets that forms, by their snapshots, write responses to."""
    named = observations.where((F.col("schema") == SNAPSHOT) & may_name("payload", "linkedSheetId"))
    forms = json_string(F.col("payload"), "$.artifact.service") == "forms"
    return named.where(forms).select(json_string(F.col("payload"), "$.metadata.linkedSheetId").alias("sheet_id")).where("sheet_id is not null").distinct()


def _named(*fields: Column) -> Column:
    return F.to_json(F.struct(F.col("id").alias("observation_id"), *fields), NULLS)


def _part(text: Column, number: Column | None = None, tab: Column | None = None, place: Column | None = None, anchor: Column | None = None) -> Column:
    fields = {"text": text, "number": number, "tab": tab, "place": place, "anchor": anchor}
    return F.struct(*[(F.lit(None) if c is None else c).cast("string").alias(n) for n, c in fields.items()])


def doc_parts() -> Column:
    """A part for each chunk, numbered."""
    return F.transform(parts_of(F.col("v"), "$.native.chunks", "heading", "text", "anchor"), lambda x, i: _part(string_of(x["text"]), i, place=string_of(x["heading"]), anchor=string_of(x["anchor"])))


def sheet_parts() -> Column:
    """A part for each spreadsheet row: its cells, each after its header, one a line."""

    def line(cell: Column) -> Column:
        return F.when(F.coalesce(cell["header"], F.lit("")) == "", cell["value"]).otherwise(F.concat_ws(": ", cell["header"], cell["value"]))

    def part(tab: Column, x: Column) -> Column:
        number = F.when(F.schema_of_variant(x["rowNumber"]) == "BIGINT", F.try_variant_get(x["rowNumber"], "$", "bigint"))
        cells = F.transform(x["cells"], lambda c: F.struct(string_of(c["header"]).alias("header"), string_of(c["value"]).alias("value")))
        cells = F.filter(cells, lambda c: c["value"].isNotNull())
        return _part(F.array_join(F.transform(cells, line), "\n"), F.greatest(F.coalesce(number, F.lit(0)), F.lit(0)), tab)

    def rows(t: Column) -> Column:
        tab = F.coalesce(string_of(t["name"]), F.lit("Sheet"))
        return F.coalesce(F.transform(t["rows"], lambda x: part(tab, x)), F.array())

    tabs = parts_of(F.col("v"), "$.native.tabs", "name", "rows: array<struct<rowNumber: variant, cells: array<struct<header: variant, value: variant>>>>")
    return F.flatten(F.transform(tabs, rows))


def form_parts() -> Column:
    """A part for each form, with its questions, and for the fact of each response; what was answered is left out."""
    kind = F.coalesce("kind", F.lit(""))
    fact = F.concat(F.coalesce(told("response.respondent"), F.lit("unknown")), F.lit(" answered at "), F.coalesce(told("response.submittedAt"), F.lit("")))
    questions = F.filter(F.transform(parts_of(F.col("v"), "$.native.questions", "title"), lambda q: string_of(q["title"])), lambda t: t.isNotNull())
    asked = F.concat("title", F.lit("\n"), F.coalesce(F.array_join(questions, "\n"), F.lit("")))
    return F.when(kind != "form-response-content", F.array(_part(F.when(kind == "form-response-fact", fact).otherwise(asked), kind, place=kind)))


def slide_parts() -> Column:
    return F.array(_part(F.col("gathered")))


def drive_parts() -> Column:
    return F.when(F.col("shared"), F.array(_part(F.coalesce(told("native.text"), F.col("title")), place=F.col("kind"))))


def slack_rows(rows: DataFrame, config: Config) -> DataFrame:
    """A row for each message of a channel that is allowed."""
    channel = told("channel_name")
    place, ts = F.coalesce(told("channel_id"), channel), F.coalesce(told("ts"), F.lit(""))
    meta = _named(F.coalesce(json_string(F.col("meta"), "$.object_id"), F.col("id")).alias("source_object_id"), place.alias("channel_id"), told("user_name").alias("author"))
    return rows.where(slack_allowed(config)).withColumn("v", F.try_parse_json("payload")).select(
        F.concat_ws(":", F.lit("corpus:slack"), place, ts).alias("record_id"), F.lit("slack").alias("source_type"), F.coalesce(told("permalink"), F.concat(F.lit("slack://"), place, F.lit("/"), ts)).alias("anchor_url"), channel.alias("source_title"),
        F.concat(F.lit("#"), channel).alias("source_location"), F.col("published").alias("timestamp"), F.coalesce(told("text"), F.lit("")).alias("text"), told("thread_ts").alias("thread_ts"), channel.alias("container"), meta.alias("metadata"))


def workspace_corpus(observations: DataFrame, config: Config = Config()) -> DataFrame:
    """Corpus rows of messages and workspace snapshots (id, schema, payload, meta, published) that privacy leaves; other schemas make none.

    Retracting observations make none. Spreadsheets that hold responses go by their flag or by a form that names them (if the
    config excludes them), files that are not shared as it asks for, and all objects whose owner or author opted out. A payload that is not
    JSON makes no rows; a snapshot without parts of its service's kind makes none either, but forms, presentations and files make one each.
    """
    retracts = F.when(may_name("meta", "retracts"), F.array_contains(F.json_object_keys("meta"), "retracts"))
    kept = observations.where(F.col("schema").isin("schema:slack-message", SNAPSHOT) & ~F.coalesce(retracts, F.lit(False)))
    rows = kept.where(F.col("schema") == SNAPSHOT).select("id", "published", "payload").repartition("id")  # files hold snapshots of one service, whose parts are more work a byte or less
    rows = rows.withColumn("v", F.try_parse_json("payload"))
    out = [F.coalesce(told(path).isin(*config.opted_out_people), F.lit(False)) for path in ("relations.owner", "owner", "author") if config.opted_out_people]
    fields = {"service": told("artifact.service"), "title": F.coalesce(told("title"), F.lit("Untitled")), "uri": F.coalesce(told("artifact.canonicalUri"), F.lit("")), "folder": told("artifact.containerId"), "object_id": told("artifact.sourceObjectId"), "kind": told("artifact.objectType")}
    rows = rows.withColumns(fields | {"allowed": ~reduce(or_, out, F.lit(False))})  # no filter on what is parsed: that would be pushed below the parse and repeat it
    service = F.col("service")
    source, linked, level = F.col("object_id").alias("source_object_id"), told("metadata.linkedSheetId").alias("linked_sheet_id"), told("metadata.sharingLevel").alias("sharing_level")
    rows = rows.withColumns({
        "metadata": F.when(service == "forms", _named(source, linked)).when(service == "drive", _named(source, level)).otherwise(_named(source)),
        "shared": F.when(service == "drive", drive_allowed(config)),
        "gathered": gathered_text(F.when((service == "slides") & F.col("allowed"), F.col("payload"))),  # others reach Python as nulls
    }).drop("payload")
    sheet = sheet_parts()
    if config.exclude_form_response_sheets:
        linked = materialize(form_response_sheets(observations), "linked-sheets")  # its size is known then: snapshots are shuffled for it only if it is large
        rows = rows.join(linked.select(F.col("sheet_id").alias("object_id"), F.lit(True).alias("linked")), "object_id", "left")
        flag = F.try_variant_get("v", "$.metadata.formResponseSheet", "variant")
        flagged = (F.schema_of_variant(flag) == "BOOLEAN") & F.try_variant_get(flag, "$", "boolean")
        sheet = F.when(~F.coalesce(flagged, F.lit(False)) & F.col("linked").isNull(), sheet)
    parts = F.when(service == "docs", doc_parts()).when(service == "sheets", sheet).when(service == "forms", form_parts()).when(service == "slides", slide_parts()).when(service == "drive", drive_parts())
    each = rows.select("id", "published", "title", "service", "uri", "folder", "metadata", F.explode(F.when(F.col("allowed"), parts)).alias("p")).select("*", "p.*")  # one pass over all services
    each = each.where(filled(F.col("text")) | ~service.isin("docs", "sheets"))
    sheets, range_ = service == "sheets", F.concat(F.lit("#gid="), "tab", F.lit("&range="), "number", F.lit(":"), "number")
    found = slack_rows(kept.where(F.col("schema") == "schema:slack-message"), config).unionByName(each.select(
        F.concat_ws(":", F.lit("corpus"), "service", "id", "tab", "number").alias("record_id"), service.alias("source_type"), F.coalesce(F.concat("uri", F.when(sheets, range_).otherwise(F.concat(F.lit("#"), "anchor"))), "uri").alias("anchor_url"), F.col("title").alias("source_title"),
        F.when(sheets, F.concat("tab", F.lit(" row "), "number")).otherwise(F.col("place")).alias("source_location"), F.col("published").alias("timestamp"), "text", F.lit(None).cast("string").alias("thread_ts"), F.when(sheets, F.col("tab")).when(service != "forms", F.col("folder")).alias("container"), "metadata"))
    return found.withColumns({"ts_nanos": F.unix_micros("timestamp") * 1000, "normalized_text": nfkc("text")})
