"""Payload mappers of document sources: slides, docs, sheets, forms and folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.shared import materialize
from millrace.sources.messages import draft

SLIDES = "presentation_id string, revision_id string, title string, modified timestamp, owner string, editors array<string>, text string, url string"


def slides(revisions: DataFrame) -> DataFrame:
    object_id = F.concat_ws(":", "presentation_id", F.lit("rev"), "revision_id")
    relations = F.struct("editors", "owner")
    artifact = F.struct(F.col("presentation_id").alias("sourceObjectId"), F.col("url").alias("canonicalUri"))
    return draft(revisions, "gslides", "workspace-object-snapshot", object_id, F.concat(F.lit("document:gslides:"), "presentation_id"), F.col("modified"), F.struct("title", relations.alias("relations"), artifact.alias("artifact"), F.struct("text").alias("native")), {})


DOCS = "document_id string, revision_id string, title string, modified timestamp, paragraphs array<struct<style: string, text: string>>"


def doc_chunks(docs: DataFrame) -> DataFrame:
    """document_id, chunk, heading, text: the paragraphs of each document from one heading to the next."""
    step = lambda acc, p: F.when(
        p["style"].startswith("HEADING"), F.concat(acc, F.array(F.struct(p["text"].alias("heading"), F.array().cast("array<string>").alias("lines"))))
    ).otherwise(
        F.concat(
            F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
            F.array(F.struct(F.element_at(acc, -1)["heading"].alias("heading"), F.concat(F.element_at(acc, -1)["lines"], F.array(p["text"])).alias("lines"))),
        )
    )
    start = F.array(F.struct(F.lit("").alias("heading"), F.array().cast("array<string>").alias("lines")))
    chunks = F.filter(F.aggregate("paragraphs", start, step), lambda c: (c["heading"] != "") | (F.size(c["lines"]) > 0))
    return docs.select("document_id", "revision_id", F.posexplode(chunks).alias("chunk", "c")).select("document_id", "revision_id", "chunk", "c.heading", F.array_join("c.lines", "\n").alias("text"))


SHEETS = "spreadsheet_id string, tabs array<struct<title: string, rows: array<array<string>>>>"


def sheet_cells(sheets: DataFrame) -> DataFrame:
    """spreadsheet_id, tab, row, col, value of cells that are not empty."""
    rows = sheets.select("spreadsheet_id", F.explode("tabs").alias("t")).select("spreadsheet_id", F.col("t.title").alias("tab"), F.posexplode("t.rows").alias("row", "cells"))
    return rows.select("spreadsheet_id", "tab", "row", F.posexplode("cells").alias("col", "value")).where("value is not null and value <> ''")


FORMS = "form_id string, title string, linked_sheet_id string, items array<struct<question_id: string, title: string>>, responses array<struct<response_id: string, submitted: timestamp, respondent: string, answers: map<string, string>>>"


def forms(forms: DataFrame) -> DataFrame:
    """Three kinds of drafts: structure, the fact of a response, and its content."""
    structure = draft(forms, "gforms", "form-structure", F.col("form_id"), F.concat(F.lit("form:"), "form_id"), F.lit(0).cast("timestamp"), F.struct("form_id", "title", F.col("linked_sheet_id").alias("linkedSheetId"), "items"), {})
    rows = forms.select("form_id", "title", "items", F.explode("responses").alias("r")).select("form_id", "title", "items", "r.*")
    object_id, subject = F.concat_ws(":", "form_id", "response_id"), F.concat(F.lit("form:"), "form_id")
    fact = draft(rows, "gforms", "form-response", object_id, subject, F.col("submitted"), F.struct("form_id", "response_id", "respondent"), {})
    lines = F.transform(F.filter("items", lambda i: F.element_at(F.col("answers"), i["question_id"]).isNotNull()), lambda i: F.concat(i["title"], F.lit(": "), F.element_at(F.col("answers"), i["question_id"])))
    content = draft(rows, "gforms", "form-response-content", F.concat_ws(":", object_id, F.lit("content")), subject, F.col("submitted"), F.struct("form_id", "response_id", F.array_join(lines, "\n").alias("text")), {})
    return structure.unionByName(fact).unionByName(content)


def files_below(files: DataFrame, roots: list[str]) -> DataFrame:
    """file_id, depth of everything below some folders (files: file_id, parent_id), breadth first; a file with many ways has its least depth."""
    spark = files.sparkSession
    found = spark.createDataFrame([(r, 0) for r in roots], "file_id string, depth int")
    frontier, depth = found, 0
    while not frontier.isEmpty():
        depth += 1
        step = files.join(frontier.select(F.col("file_id").alias("parent_id")), "parent_id").select("file_id").distinct().join(found, "file_id", "left_anti")
        frontier = materialize(step.withColumn("depth", F.lit(depth)), "folders")
        found = found.unionByName(frontier)
        if depth % 16 == 0:  # keeps the plan short
            found = materialize(found, "folders-found")
    return found
