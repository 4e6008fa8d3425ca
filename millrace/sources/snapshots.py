"""Snapshots of workspace objects (documents, spreadsheets, forms, presentations, files) as observation drafts.

A snapshot's identity is its revision: the key is derived from a canonical tuple, not from the whole payload. Fields that a row lacks are null in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.keys import identity_key, utc_text

SCHEMA = "schema:workspace-object-snapshot"
NULLS = {"ignoreNullFields": "false"}


def _none(name: str) -> Column:
    return F.lit(None).cast("string").alias(name)


def _artifact(service: str, kind: Column | str, id: str, *more: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(F.lit("google").alias("provider"), F.lit(service).alias("service"), kind.alias("objectType"), F.col(id).alias("sourceObjectId"), F.col("canonical_uri").alias("canonicalUri"), *more).alias("artifact")


def _revision() -> Column:
    return F.struct(F.col("revision_id").alias("sourceRevisionId"), utc_text(F.col("modified")).alias("sourceModifiedAt"), F.lit("snapshot").alias("captureMode")).alias("revision")


def snapshot(rows: DataFrame, source: str, container: str, object_id: Column, subject: Column, published: Column, payload: Column, canonical: Column, meta: list[Column] = [], attachments: Column | None = None) -> DataFrame:
    """Drafts of source authority. canonical has its fields in alphabetical order."""
    tuple_ = F.to_json(canonical, NULLS)
    told = F.struct(F.lit("1").alias("sourceAdapterVersion"), object_id.alias("object_id"), tuple_.alias("canonical_json"), F.lit(container).alias("source_container"), *meta)
    return rows.select(
        F.lit(SCHEMA).alias("schema"), F.lit("1.0.0").alias("schema_version"), F.lit(f"obs:{source}-crawler").alias("observer"), F.lit(f"sys:{container}").alias("source_system"), F.lit("source_authoritative").alias("authority_model"),
        F.lit("snapshot").alias("capture_model"), subject.alias("subject"), F.lit(None).cast("string").alias("target"), F.to_json(payload, NULLS).alias("payload"), (F.array().cast("array<string>") if attachments is None else attachments).alias("attachments"),
        published.alias("published"), identity_key(F.lit(container), object_id, tuple_).alias("idempotency_key"), F.to_json(told, NULLS).alias("meta"))


DOCS = "document_id string, revision_id string, title string, canonical_uri string, owner string, modified timestamp, body_text string, headings array<struct<title: string, level: int, text: string, anchor: string>>, links array<string>"


def docs(documents: DataFrame) -> DataFrame:
    """A draft for each document, with a chunk for each heading, or one of its whole body."""
    chunk = lambda heading, level, text, anchor: F.struct(heading.alias("heading"), level.alias("level"), text.alias("text"), anchor.alias("anchor"))
    whole = F.array(chunk(F.lit(None).cast("string"), F.lit(None).cast("int"), F.col("body_text"), F.lit(None).cast("string")))
    rows = documents.withColumn("chunks", F.when(F.size("headings") > 0, F.transform("headings", lambda h: chunk(h["title"], h["level"], h["text"], h["anchor"]))).otherwise(whole))
    payload = F.struct("title", _artifact("docs", "document", "document_id"), _revision(), F.struct(F.lit("inline-json").alias("encoding"), "chunks", "links").alias("native"), F.struct("owner").alias("relations"))
    object_id = F.concat(F.lit("document:"), "document_id", F.lit(":revision:"), "revision_id")
    in_order = F.transform("chunks", lambda c: F.struct(c["anchor"].alias("anchor"), c["heading"].alias("heading"), c["level"].alias("level"), c["text"].alias("text")))
    return snapshot(rows, "gdocs", "google-docs", object_id, F.concat(F.lit("document:gdocs:"), "document_id"), F.col("modified"), payload, F.struct(in_order.alias("chunks"), "document_id", "revision_id"))


SHEETS = "spreadsheet_id string, revision_id string, title string, canonical_uri string, modified timestamp, form_response_sheet boolean, tabs array<struct<name: string, rows: array<array<string>>>>"


def sheets(spreadsheets: DataFrame) -> DataFrame:
    """A draft for each spreadsheet: rows from the second on, each cell with its column's header."""

    def tab(t: Column) -> Column:
        headers = F.coalesce(F.get(t["rows"], F.lit(0)), F.array().cast("array<string>"))
        cells = lambda row: F.transform(row, lambda v, i: F.struct(F.get(headers, i).alias("header"), v.alias("value")))
        numbered = F.transform(t["rows"], lambda row, i: F.struct((i + 1).alias("rowNumber"), cells(row).alias("cells")))
        return F.struct(t["name"].alias("name"), headers.alias("headers"), F.slice(numbered, 2, F.greatest(F.size(numbered) - 1, F.lit(0))).alias("rows"))

    rows = spreadsheets.withColumn("tabs", F.transform("tabs", tab))
    payload = F.struct("title", _artifact("sheets", "spreadsheet", "spreadsheet_id"), _revision(), F.struct(F.lit("inline-json").alias("encoding"), "tabs").alias("native"), F.struct(F.col("form_response_sheet").alias("formResponseSheet")).alias("metadata"))
    in_order = F.transform("tabs", lambda t: F.struct(t["headers"].alias("headers"), t["name"].alias("name"), F.transform(t["rows"], lambda r: F.struct(r["cells"].alias("cells"), r["rowNumber"].alias("rowNumber"))).alias("rows")))
    object_id = F.concat(F.lit("spreadsheet:"), "spreadsheet_id", F.lit(":revision:"), "revision_id")
    return snapshot(rows, "gsheets", "google-sheets", object_id, F.concat(F.lit("document:gsheets:"), "spreadsheet_id"), F.col("modified"), payload, F.struct("revision_id", "spreadsheet_id", in_order.alias("tabs")), [F.col("form_response_sheet")])


FORMS = "form_id string, revision_id string, title string, description string, canonical_uri string, modified timestamp, linked_sheet_id string, questions array<struct<question_id: string, title: string>>, responses array<struct<response_id: string, respondent: string, submitted: timestamp, answers: map<string, string>>>"


def forms(forms: DataFrame) -> DataFrame:
    """Drafts of each form's structure, and of the fact and the content of each response."""
    linked = F.struct(F.col("linked_sheet_id").alias("linkedSheetId")).alias("metadata")
    subject = F.concat(F.lit("document:gforms:"), "form_id")
    kept = lambda kind: [F.lit(kind).alias("form_object_type"), F.col("linked_sheet_id")]
    payload = F.struct("title", "description", _artifact("forms", "form", "form_id"), _revision(), F.struct(F.lit("inline-json").alias("encoding"), "questions").alias("native"), linked)
    object_id = F.concat(F.lit("form:"), "form_id", F.lit(":revision:"), "revision_id")
    structure = snapshot(forms, "gforms", "google-forms", object_id, subject, F.col("modified"), payload, F.struct("form_id", "questions", "revision_id"), kept("form"))
    answered = forms.select("*", F.explode("responses").alias("r")).select("*", "r.*")
    said = lambda *more: F.struct(F.col("response_id").alias("responseId"), "respondent", utc_text(F.col("submitted")).alias("submittedAt"), *more).alias("response")
    object_id = lambda kind: F.concat(F.lit("form:"), "form_id", F.lit(":response:"), "response_id", F.lit(f":{kind}"))
    fact = snapshot(answered, "gforms", "google-forms", object_id("fact"), subject, F.col("submitted"), F.struct("title", _artifact("forms", "form-response-fact", "form_id"), said(), linked), F.struct("form_id", "respondent", "response_id", utc_text(F.col("submitted")).alias("submitted_at")), kept("form-response-fact"))
    content = snapshot(answered, "gforms", "google-forms", object_id("content"), subject, F.col("submitted"), F.struct("title", _artifact("forms", "form-response-content", "form_id"), said("answers")), F.struct(F.map_from_entries(F.array_sort(F.map_entries("answers"))).alias("answers"), "form_id", "response_id"), kept("form-response-content"))
    return structure.unionByName(fact).unionByName(content)


SLIDES = "presentation_id string, revision_id string, title string, canonical_uri string, container_id string, owner string, editors array<string>, viewers array<string>, modified timestamp, native_blob string, rendered_blobs array<string>"


def slides(revisions: DataFrame) -> DataFrame:
    """A draft for each revision of a presentation; its content and renderings are attachments."""
    native = F.struct(F.when(F.col("native_blob").isNull(), "inline-json").otherwise("blob-ref").alias("encoding"), F.col("native_blob").alias("blobRef")).alias("native")
    payload = F.struct("title", _artifact("slides", "presentation", "presentation_id", F.col("container_id").alias("containerId")), _revision(), native, F.struct("owner", "editors", "viewers").alias("relations"))
    blobs = F.array_compact(F.concat(F.coalesce("rendered_blobs", F.array().cast("array<string>")), F.array("native_blob")))
    digests = F.transform(F.filter(blobs, lambda b: b.startswith("blob:sha256:")), lambda b: F.substr(b, F.lit(len("blob:sha256:") + 1)))
    object_id = F.concat(F.lit("presentation:"), "presentation_id", F.lit(":revision:"), "revision_id")
    canonical = F.struct(digests.alias("attachment_sha256"), F.date_format(F.to_utc_timestamp("modified", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("modified_time"), "presentation_id", "revision_id")
    return snapshot(revisions, "gslides", "google-slides", object_id, F.concat(F.lit("document:gslides:"), "presentation_id"), F.col("modified"), payload, canonical, attachments=blobs)


FILES = "file_id string, revision_id string, name string, mime_type string, canonical_uri string, parent_ids array<string>, owner string, sharing_level string, text string, modified timestamp"


def files(files: DataFrame) -> DataFrame:
    """A draft for each file, with its text, folders and how widely it is shared."""
    payload = F.struct(
        F.col("name").alias("title"), _artifact("drive", F.col("mime_type"), "file_id", F.get("parent_ids", F.lit(0)).alias("containerId")), _revision(), F.struct(F.lit("inline-text").alias("encoding"), "text").alias("native"),
        F.struct("owner").alias("relations"), F.struct(F.col("sharing_level").alias("sharingLevel"), F.col("parent_ids").alias("parentIds")).alias("metadata"))
    object_id = F.concat(F.lit("drive-file:"), "file_id", F.lit(":revision:"), "revision_id")
    return snapshot(files, "gdrive", "google-drive", object_id, F.concat(F.lit("document:gdrive:"), "file_id"), F.col("modified"), payload, F.struct("file_id", "revision_id", "sharing_level", "text"))
