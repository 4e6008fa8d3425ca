"""Snapshots of workspace objects, made from the driver tables, on to the corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import workspace
from millrace.operators.corpus import Config
from millrace.plans.tables import minute, read
from millrace.shared import materialize
from millrace.sources import messages, snapshots

CONFIG = Config(channel_pattern=r"^\d{2}0_", opted_in_channels=("C7",), opted_out_people=("src1", "U3"), excluded_files=("3", "4"), allowed_folders=("f0", "f2"), least_sharing="domain")


def observations(spark, d) -> DataFrame:
    """Documents with a chunk for each line, customers' orders as spreadsheets, suppliers as forms that may write to a customer's spreadsheet,
    conversations as presentations (some with their slides' texts) and as channels, and pages as files."""
    none, one = F.lit(None).cast("string"), F.lit("1")
    text = F.coalesce("text", F.lit(""))
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(F.concat(F.lit("L"), i).alias("title"), F.lit(1).alias("level"), x.alias("text"), F.when(i % 2 == 0, F.concat(F.lit("a"), i)).alias("anchor")))
    lines = F.when(F.col("doc_id") % 4 > 0, lines).otherwise(F.slice(lines, 1, 0))
    docs = snapshots.docs(read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), one.alias("revision_id"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("title"), F.concat(F.lit("https://d/"), "doc_id").alias("canonical_uri"), F.col("source").alias("owner"), minute("doc_id").alias("modified"), text.alias("body_text"), lines.alias("headings"), F.array().cast("array<string>").alias("links")))
    o = read(spark, d, "orders").select("o_custkey", F.struct("o_orderkey", F.array(F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority"))).alias("cells")).alias("row"))
    tables = o.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["cells"]).alias("rows"))
    tab = F.struct(F.lit("Orders").alias("name"), F.concat(F.array(F.array(F.lit("key"), F.lit(""), F.lit("priority"))), "rows").alias("rows"))
    sheets = snapshots.sheets(tables.select(F.col("o_custkey").cast("string").alias("spreadsheet_id"), one.alias("revision_id"), F.concat(F.lit("Customer "), "o_custkey").alias("title"), F.when(F.col("o_custkey") % 5 > 0, F.concat(F.lit("https://s/"), "o_custkey")).alias("canonical_uri"), minute("o_custkey").alias("modified"), (F.col("o_custkey") % 7 == 3).alias("form_response_sheet"), F.array(tab).alias("tabs")))
    k = F.col("s_suppkey")
    question = lambda n: F.struct(F.concat(F.lit("q"), F.lit(n)).alias("question_id"), (F.concat(F.lit(f"Q{n} of "), "s_name") if n < 3 else none).alias("title"))
    said = F.struct(F.lit("r").alias("response_id"), F.when(k % 3 > 0, F.col("s_name")).alias("respondent"), minute("s_suppkey").alias("submitted"), F.create_map(F.lit("q1"), F.lit("secret")).alias("answers"))
    forms = snapshots.forms(read(spark, d, "supplier").select(k.cast("string").alias("form_id"), one.alias("revision_id"), F.col("s_name").alias("title"), none.alias("description"), F.concat(F.lit("https://f/"), k).alias("canonical_uri"), minute("s_suppkey").alias("modified"), F.when(k % 2 == 0, k.cast("string")).alias("linked_sheet_id"), F.array(question(1), question(3), question(2)).alias("questions"), F.array(said).alias("responses")))
    t = read(spark, d, "conversations")
    said = t.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["text"].alias("b"), x["role"].alias("a"), x["turn"].alias("c"))).alias("said"))
    decks = said.select(F.col("conv_id").cast("string").alias("presentation_id"), one.alias("revision_id"), F.lit("Deck").alias("title"), F.concat(F.lit("https://p/"), "conv_id").alias("canonical_uri"), F.when(F.col("conv_id") % 2 == 0, F.lit("folder")).alias("container_id"), F.concat(F.lit("U"), F.col("conv_id") % 5).alias("owner"), F.array(F.lit("e1"), F.lit("e2")).alias("editors"), F.array().cast("array<string>").alias("viewers"), minute("conv_id").alias("modified"), none.alias("native_blob"), F.array().cast("array<string>").alias("rendered_blobs"))
    slides = snapshots.slides(decks).withColumn("n", F.substring_index("subject", ":", -1).cast("long"))
    slides = slides.join(said.withColumnRenamed("conv_id", "n"), "n").withColumn("payload", F.when(F.col("n") % 3 == 0, F.regexp_replace("payload", '"encoding":"inline-json"', "§")).otherwise(F.col("payload")))
    slides = slides.withColumn("payload", F.concat(F.substring_index("payload", "§", 1), F.when(F.col("n") % 3 == 0, F.concat(F.lit('"slides":'), F.to_json("said"), F.lit(","), F.lit('"encoding":"inline-json"'), F.substring_index("payload", "§", -1))).otherwise(F.lit("")))).drop("n", "said")
    levels = F.array(*map(F.lit, ("private", "domain", "anyone-with-link", "public")))
    files = snapshots.files(read(spark, d, "pages").select(F.col("page_id").cast("string").alias("file_id"), one.alias("revision_id"), F.concat(F.lit("page "), "page_id").alias("name"), F.lit("text/html").alias("mime_type"), F.col("url").alias("canonical_uri"), F.array(F.concat(F.lit("f"), F.col("page_id") % 4), F.lit("shared")).alias("parent_ids"), F.lit("anyone").alias("owner"), F.get(levels, (F.col("page_id") % 5).cast("int")).alias("sharing_level"), F.when(F.col("page_id") % 6 > 0, F.col("html")).alias("text"), minute("page_id").alias("modified")))
    stamp, channel = F.concat((F.lit(1_700_000_000) + 60 * F.col("turn")).cast("string"), F.lit(".000100")), F.lpad(F.col("conv_id").cast("string"), 3, "0")
    chat = t.where("conv_id < 1000").select(F.concat(F.lit("C"), "conv_id").alias("channel_id"), F.concat(channel, F.lit("_room")).alias("channel_name"), stamp.alias("ts"), F.concat(F.when(F.col("turn") == 6, F.lit("B")).otherwise(F.lit("U")), "turn").alias("user_id"), F.col("role").alias("user_name"), none.alias("email"), "text", F.when(F.col("turn") > 0, F.lit("1700000000.000100")).alias("thread_ts"), F.lit("api").alias("ingress_kind"), F.lit("message").alias("message_type"), (F.col("conv_id") % 20 > 0).alias("is_public_channel"), (F.col("turn") == 5).alias("is_bot"), F.array().cast(messages.SLACK.rsplit("files ", 1)[1]).alias("files"))
    return reduce(DataFrame.unionByName, (docs, sheets, forms, slides, files, messages.slack(chat))).withColumn("id", F.get_json_object("meta", "$.object_id"))


def workspace_corpus(spark, d):
    lake = materialize(observations(spark, d).select("id", "schema", "payload", "meta", "published"), "workspace-lake")
    return workspace.workspace_corpus(lake, CONFIG).select("record_id", "source_type", "anchor_url", "source_title", "source_location", "timestamp", "text", "thread_ts", "container", "metadata")


_TIME = "make_timestamp((1700000000 + 60 * {}) * 1000000)"
_STAMP = "strftime(make_timestamp((1700000000 + 60 * {}) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"
_META = "'{{\"observation_id\":\"' || {} || '\",\"source_object_id\":\"' || {} || '\"{}}}'"

WORKSPACE_SQL = f"""
WITH split AS (SELECT doc_id, source, lang, generate_subscripts(parts, 1) - 1 AS i, unnest(parts) AS x FROM (SELECT *, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents WHERE doc_id % 4 > 0)),
docs AS (
  SELECT 'document:' || doc_id || ':revision:1' AS id, doc_id, source, lang, i, x, 'L' || i AS heading, CASE WHEN i % 2 = 0 THEN '#a' || i ELSE '' END AS anchor FROM split
  UNION ALL SELECT 'document:' || doc_id || ':revision:1', doc_id, source, lang, 0, coalesce(text, ''), NULL, '' FROM documents WHERE doc_id % 4 = 0),
sheet_rows AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 1 AS n, 'spreadsheet:' || o_custkey || ':revision:1' AS id, CASE WHEN o_custkey % 5 > 0 THEN 'https://s/' || o_custkey ELSE '' END AS uri FROM orders),
forms AS (SELECT *, 'form:' || s_suppkey || ':revision:1' AS id, 'form:' || s_suppkey || ':response:r:fact' AS fact, coalesce('"' || CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END || '"', 'null') AS linked FROM supplier),
decks AS (
  SELECT conv_id, 'presentation:' || conv_id || ':revision:1' AS id, string_agg(role || chr(10) || text || chr(10), chr(10) ORDER BY turn) AS slides,
         concat_ws(chr(10), 'https://p/' || conv_id, CASE WHEN conv_id % 2 = 0 THEN 'folder' ELSE '' END, 'presentation', 'google', 'slides', conv_id, '', 'inline-json', 'e1', 'e2', 'U' || conv_id % 5, '', 'snapshot', {_STAMP.format('conv_id')}, '1', 'Deck') AS whole
  FROM conversations GROUP BY conv_id),
files AS (SELECT *, 'drive-file:' || page_id || ':revision:1' AS id, ['private', 'domain', 'anyone-with-link', 'public'][page_id % 5 + 1] AS level FROM pages),
chat AS (SELECT *, 'C' || conv_id AS place, lpad(CAST(conv_id AS VARCHAR), 3, '0') || '_room' AS channel, (1700000000 + 60 * turn) || '.000100' AS ts FROM conversations WHERE conv_id < 1000)
SELECT 'corpus:docs:' || id || ':' || i AS record_id, 'docs' AS source_type, 'https://d/' || doc_id || anchor AS anchor_url, coalesce(CASE WHEN doc_id % 3 > 0 THEN lang END, 'Untitled') AS source_title, heading AS source_location, {_TIME.format('doc_id')} AS timestamp, x AS text,
  NULL AS thread_ts, NULL AS container, {_META.format('id', 'doc_id', '')} AS metadata FROM docs WHERE regexp_matches(x, '[^\\s\\pZ]') AND coalesce(source, '') <> 'src1'
UNION ALL SELECT 'corpus:sheets:' || id || ':Orders:' || n, 'sheets', uri || '#gid=Orders&range=' || n || ':' || n, 'Customer ' || o_custkey, 'Orders row ' || n, {_TIME.format('o_custkey')}, 'key: ' || o_orderkey || chr(10) || o_orderstatus || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || 'priority: ' || o_orderpriority ELSE '' END,
  NULL, 'Orders', {_META.format('id', 'o_custkey', '')} FROM sheet_rows WHERE o_custkey % 7 <> 3 AND o_custkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)
UNION ALL SELECT 'corpus:forms:' || id || ':form', 'forms', 'https://f/' || s_suppkey, s_name, 'form', {_TIME.format('s_suppkey')}, concat_ws(chr(10), s_name, 'Q1 of ' || s_name, 'Q2 of ' || s_name), NULL, NULL, {_META.format('id', 's_suppkey', ',"linked_sheet_id":' + "' || linked || '")} FROM forms
UNION ALL SELECT 'corpus:forms:' || fact || ':form-response-fact', 'forms', 'https://f/' || s_suppkey, s_name, 'form-response-fact', {_TIME.format('s_suppkey')}, CASE WHEN s_suppkey % 3 > 0 THEN s_name ELSE 'unknown' END || ' answered at ' || {_STAMP.format('s_suppkey')}, NULL, NULL, {_META.format('fact', 's_suppkey', ',"linked_sheet_id":' + "' || linked || '")} FROM forms
UNION ALL SELECT 'corpus:slides:' || id, 'slides', 'https://p/' || conv_id, 'Deck', NULL, {_TIME.format('conv_id')}, CASE WHEN conv_id % 3 = 0 THEN slides ELSE whole END, NULL, CASE WHEN conv_id % 2 = 0 THEN 'folder' END, {_META.format('id', 'conv_id', '')} FROM decks WHERE conv_id % 5 <> 3
UNION ALL SELECT 'corpus:drive:' || id, 'drive', url, 'page ' || page_id, 'text/html', {_TIME.format('page_id')}, CASE WHEN page_id % 6 > 0 THEN html ELSE 'page ' || page_id END, NULL, 'f' || page_id % 4, {_META.format('id', 'page_id', ',"sharing_level":"' + "' || level || '" + '"')} FROM files
  WHERE page_id NOT IN (3, 4) AND page_id % 4 IN (0, 2) AND page_id % 5 IN (1, 2, 3)
UNION ALL SELECT 'corpus:slack:' || place || ':' || ts, 'slack', 'slack://' || place || '/' || ts, channel, '#' || channel, make_timestamp((1700000000 + 60 * turn) * 1000000 + 100), text, CASE WHEN turn > 0 THEN '1700000000.000100' END, channel,
  '{{"observation_id":"' || place || '-' || ts || '","source_object_id":"' || place || '-' || ts || '","channel_id":"' || place || '","author":"' || role || '"}}' FROM chat WHERE conv_id % 20 > 0 AND (conv_id = 7 OR regexp_matches(channel, '^\\d{{2}}0_')) AND turn NOT IN (3, 5, 6)
"""
QUERIES = {"workspace_corpus": (workspace_corpus, WORKSPACE_SQL)}
