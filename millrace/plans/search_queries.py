"""Search, paging and inventory queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import activity, inventory, paging, search
from millrace.plans.tables import CORPUS_SQL, corpus, minute, read
from millrace.shared import new_path

PAGE = ["record_id", "source_type", "container", "timestamp"]
GREP_SQL = f"WITH {CORPUS_SQL} SELECT record_id, source_type, container, timestamp FROM corpus WHERE {{0}} ORDER BY timestamp DESC, record_id LIMIT 100"


def grep_literal(spark, d):
    return search.grep(corpus(spark, d), "thing").select(*PAGE)


def grep_regex(spark, d):
    return search.grep(corpus(spark, d), r"[Tt]h[a-z]+ing[.,]").select(*PAGE)


def grep_and_terms(spark, d):
    return search.grep(corpus(spark, d), "heat [Oo]uld?").select(*PAGE)


FILTERS = search.Filters(source_types=("src1", "src2", "src3"), since="2023-11-14 22:30:00", containers=("en", "fr"))


def grep_filtered_page(spark, d):
    """The second page of a filtered search: after a key, oldest first."""
    return search.grep(corpus(spark, d), "e[a-z]", FILTERS, "date_asc", 20, ["2023-11-14 23:00:00", "40"]).select(*PAGE)


def grep_with_matches(spark, d):
    return search.with_matches(search.grep(corpus(spark, d), r"[Tt]h[a-z]+ing"), r"[Tt]h[a-z]+ing").select("record_id", F.col("ranges").cast("string").alias("ranges"), "snippet")


MATCHES_SQL = f"""
WITH {CORPUS_SQL}, page AS (SELECT record_id, text FROM corpus WHERE regexp_matches(text, '[Tt]h[a-z]+ing') ORDER BY timestamp DESC, record_id LIMIT 100),
m AS (SELECT *, regexp_extract_all(text, '[Tt]h[a-z]+ing') AS hits, string_split_regex(text, '[Tt]h[a-z]+ing') AS rest FROM page),
r AS (SELECT *, length(rest[1]) AS hit, length(text) AS n, list_transform(range(1, least(len(hits), {T.MAX_RANGES}) + 1), lambda i: strlen(array_to_string(rest[1:i], '')) + strlen(array_to_string(hits[1:i - 1], ''))) AS starts FROM m)
SELECT record_id, '[' || array_to_string(list_transform(starts, lambda s, i: '{{' || s || ', ' || (s + strlen(hits[i])) || '}}'), ', ') || ']' AS ranges,
  CASE WHEN n <= {T.SNIPPET_CHARS} THEN text WHEN hit <= {(T.SNIPPET_CHARS - 3) // 2} THEN text[1:{T.SNIPPET_CHARS - 3}] || '...' WHEN hit - {(T.SNIPPET_CHARS - 3) // 2} + {T.SNIPPET_CHARS - 3} >= n THEN '...' || text[n - {T.SNIPPET_CHARS - 3} + 1:n]
    ELSE '...' || text[hit - {(T.SNIPPET_CHARS - 6) // 2} + 1:hit - {(T.SNIPPET_CHARS - 6) // 2} + {T.SNIPPET_CHARS - 6}] || '...' END AS snippet FROM r
"""


def grep_normalized(spark, d):
    found = corpus(spark, d).withColumn("normalized_text", T.nfkc("text"))
    return search.grep(found, "é[a-z]+ê", searched="normalized_text").select(*PAGE)


def grep_indexed(spark, d):
    """The same search over an n-gram index: candidates first, then verified."""
    path = new_path(spark, "ngrams")
    search.write_ngram_index(corpus(spark, d), path)
    return search.grep(search.candidates(corpus(spark, d), path, "thing"), "thing").select(*PAGE)


def match_counts(spark, d):
    return corpus(spark, d).select("record_id", F.regexp_count("text", F.lit("[Tt]h[a-z]+ing")).cast("long").alias("matches"))


def canonical_bodies(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2(T.canonical_body("text").cast("binary"), 256).alias("sha256"))


def source_type_counts(spark, d):
    return inventory.type_counts(corpus(spark, d))


def exact_container(spark, d):
    return search.exact(corpus(spark, d), "container", "de", 50).select(*PAGE)


def link_resolve(spark, d):
    pages = read(spark, d, "pages")
    records = pages.select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("record_id"), F.regexp_extract("url", "^https?://[^/]+/[a-z]+/", 0).alias("anchor_url"), minute("page_id").alias("timestamp"))
    return search.resolve_links(pages.select("page_id", "url"), records).select("page_id", "record_id")


LINK_SQL = """
WITH records AS (SELECT 'page:' || page_id AS record_id, regexp_extract(url, '^https?://[^/]+/[a-z]+/') AS anchor_url, page_id AS tm FROM pages),
best AS (SELECT anchor_url, arg_max(record_id, tm) AS record_id, max(tm) AS tm FROM records WHERE anchor_url <> '' GROUP BY anchor_url),
ranked AS (SELECT p.page_id, b.record_id, row_number() OVER (PARTITION BY p.page_id ORDER BY b.tm DESC, b.record_id) AS nth FROM pages p LEFT JOIN best b ON starts_with(p.url, b.anchor_url))
SELECT page_id, record_id FROM ranked WHERE nth = 1
"""


def history_search(spark, d):
    turns = read(spark, d, "conversations")
    return search.lower_search(turns, "THE", "text", [("conv_id", False), ("turn", False)], 50).select("conv_id", "turn", "role")


def decision_search(spark, d):
    turns = read(spark, d, "conversations").where("role = 'assistant'")
    return search.decision_search(turns, "The AND", ["text"], [("conv_id", False), ("turn", False)], 50).select("conv_id", "turn")


def thread_read(spark, d):
    """The turns of one conversation after its second."""
    turns = read(spark, d, "conversations").where("conv_id = 0")
    return paging.keyset_page(turns, [("turn", False)], 100, [1]).select("turn", "role", "text")


def operational_filter_page(spark, d):
    events = read(spark, d, "events").where("event_type in ('click', 'purchase') and ts between timestamp'2024-01-05' and timestamp'2024-01-20'")
    return paging.keyset_page(events, [("ts", False), ("event_id", False)], 100, ["2024-01-06 00:00:00", 0]).select("event_id", "ts", "user_id", "event_type")


def offset_page(spark, d):
    return paging.offset_page(read(spark, d, "events"), [("ts", True), ("event_id", False)], 40, 20).select("event_id", "event_type")


def byte_budget_page(spark, d):
    rows = read(spark, d, "events").select("event_id", "event_type")
    return paging.byte_budget_page(rows, [("event_id", False)], 1000, 100)


def labelled(spark, d):
    """Whole documents below lines of labels: plain, with a full-width colon, with spaces, and one whose value is the text's first line."""
    n, lang = F.col("doc_id"), F.coalesce("lang", F.lit(""))
    head = F.concat(F.lit("Source: "), "source", F.lit("\nE-mail：u"), n % 7, F.lit("@x.org\n card  number : "), n % 11, F.lit("\nGroup "), n % 5, F.lit(": "), lang, F.lit("\nphone:\n"))
    return read(spark, d, "documents").withColumn("text", F.concat(head, F.coalesce("text", F.lit(""))))


def label_inventory(spark, d):
    """The labels of documents, with their sources as people."""
    return inventory.label_inventory(labelled(spark, d), "source", "text", "doc_id").withColumn("examples", F.array_join("examples", "|"))


#: Fixed value: what a line with a label looks like, as in functions.keys.
LABELS_CTE = r"""
labelled AS (SELECT doc_id, source, 'Source: ' || source || chr(10) || 'E-mail：u' || doc_id % 7 || '@x.org' || chr(10) || ' card  number : ' || doc_id % 11 || chr(10) || 'Group ' || doc_id % 5 || ': ' || coalesce(lang, '') || chr(10) || 'phone:' || chr(10) || coalesce(text, '') AS text FROM documents),
pairs AS (SELECT source, doc_id, regexp_extract_all(text, '(?m)^\s*([^\n:：]{1,30}?)\s*[：:]\s*(.*)', 1) AS ls, regexp_extract_all(text, '(?m)^\s*([^\n:：]{1,30}?)\s*[：:]\s*(.*)', 2) AS vs FROM labelled),
found AS (SELECT source, doc_id, nth, regexp_replace(l, '^\s+|\s+$', '', 'g') AS label, regexp_replace(v, '^\s+|\s+$', '', 'g') AS value FROM (SELECT source, doc_id, unnest(ls) AS l, unnest(vs) AS v, generate_subscripts(ls, 1) AS nth FROM pairs)),
kept AS (SELECT *, trim(regexp_replace(translate(label, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\s+', ' ', 'g')) AS key FROM found WHERE length(label) >= 2 AND NOT regexp_full_match(label, '[0-9.]+') AND lower(label) NOT IN ('http', 'https'))
"""
LABELS_SQL = f"""
WITH {LABELS_CTE}, firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, source ORDER BY doc_id, nth) AS r FROM kept WHERE key <> '') WHERE r = 1),
people AS (SELECT key, count(*) AS people, arg_min(label, (doc_id, nth)) AS label FROM firsts GROUP BY key),
vals AS (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY min((doc_id, nth))) AS r FROM firsts WHERE value <> '' GROUP BY key, value),
ex AS (SELECT key, string_agg(value, '|' ORDER BY value) AS examples FROM vals WHERE r <= 5 GROUP BY key)
SELECT key, label, people, coalesce(examples, '') AS examples FROM people LEFT JOIN ex USING (key)
"""


def import_inventory(spark, d):
    docs = read(spark, d, "documents")
    return inventory.import_inventory(docs.select("source", F.sha2(F.col("text").cast("binary"), 256).alias("identity"), F.col("lang").alias("digest"), F.octet_length("text").cast("long").alias("bytes")))


def source_overlaps(spark, d):
    docs = read(spark, d, "documents")
    return inventory.overlaps(docs.select("source", F.sha2(F.col("text").cast("binary"), 256).alias("identity")))


def partition_window(spark, d):
    """Rows by month of a pruned window of time."""
    rows = read(spark, d, "lineitem").where("l_shipdate >= timestamp'1998-01-01' and l_shipdate < timestamp'2000-01-01'")
    return rows.groupBy(F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")).agg(F.count("*").alias("records"), F.max("l_shipdate").alias("last"))


def timeline_union(spark, d):
    orders = read(spark, d, "orders").select(F.lit("slide").alias("kind"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"))
    events = read(spark, d, "events").select(F.lit("message").alias("kind"), F.col("ts").alias("at"), F.col("event_id").alias("id"), F.col("event_type").alias("title"))
    return activity.timeline(orders, events)


def relation_fingerprint(spark, d):
    return activity.fingerprint(read(spark, d, "orders").select("o_orderkey", "o_orderpriority"))


FINGERPRINT_SQL = """
WITH h AS (SELECT sha256('{"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '"}') AS h FROM orders),
s AS (SELECT count(*) AS n, sum(CAST('0x' || h[1:16] AS UBIGINT)) AS a, sum(CAST('0x' || h[17:32] AS UBIGINT)) AS b, sum(CAST('0x' || h[33:48] AS UBIGINT)) AS c, sum(CAST('0x' || h[49:64] AS UBIGINT)) AS d FROM h),
c3 AS (SELECT *, d % 18446744073709551616 AS d0, c + d // 18446744073709551616 AS c1 FROM s), c2 AS (SELECT *, c1 % 18446744073709551616 AS c0, b + c1 // 18446744073709551616 AS b1 FROM c3), c1 AS (SELECT *, b1 % 18446744073709551616 AS b0, (a + b1 // 18446744073709551616) % 18446744073709551616 AS a0 FROM c2)
SELECT n AS rows, lpad(lower(to_hex(CAST(a0 AS UBIGINT))), 16, '0') || lpad(lower(to_hex(CAST(b0 AS UBIGINT))), 16, '0') || lpad(lower(to_hex(CAST(c0 AS UBIGINT))), 16, '0') || lpad(lower(to_hex(CAST(d0 AS UBIGINT))), 16, '0') AS fingerprint FROM c1
"""


def corpus_watermark(spark, d):
    return activity.watermark(corpus(spark, d))


def set_difference(spark, d):
    nations, suppliers = read(spark, d, "customer").where("c_nationkey % 4 <> 1").select(F.col("c_nationkey").alias("n")).distinct(), read(spark, d, "supplier").where("s_nationkey % 3 <> 1").select(F.col("s_nationkey").alias("n")).distinct()
    return inventory.difference(suppliers, nations)


#: Attributes of the catalogue: name, aliases.
ATTRIBUTES = [(1, "Email", ["email", "mail", "e-mail"]), (2, "Phone", ["tel", "phone", "call"]), (3, "License", ["license", "spdx-license-identifier"]), (4, "Copyright", []), (5, "Key", ["api key", "token"]), (6, "Name", ["author"]), (7, "ail", []), (8, "Card number", ["card"])]


def attribute_suggestions(spark, d):
    """The labels of documents against a catalogue of attributes; a label's first word stands for an AI key."""
    labels = inventory.label_inventory(labelled(spark, d), "source", "text", "doc_id").select("label", F.element_at(F.split("key", " "), 1).alias("ai_key"))
    catalogue = spark.createDataFrame(ATTRIBUTES, "id int, name string, aliases array<string>")
    return inventory.suggest_attributes(labels, catalogue).select("label", "id", "name", "score", "nth")


ATTRIBUTES_SQL = f"""
WITH {LABELS_CTE}, people AS (SELECT key, arg_min(label, (doc_id, nth)) AS label FROM (SELECT *, row_number() OVER (PARTITION BY key, source ORDER BY doc_id, nth) AS r FROM kept WHERE key <> '') WHERE r = 1 GROUP BY key),
c(id, name, aliases) AS (VALUES {", ".join(f"({i}, '{n}', {a})" for i, n, a in ATTRIBUTES)}),
s AS (SELECT p.label, c.id, c.name, CASE WHEN list_contains(c.aliases, p.key) THEN 100 ELSE 0 END + CASE WHEN lower(c.name) = p.key THEN 90 ELSE 0 END AS exact,
  CASE WHEN contains(p.key, lower(c.name)) OR contains(lower(c.name), p.key) THEN 50 ELSE 0 END AS part, CASE WHEN list_contains(c.aliases, string_split(p.key, ' ')[1]) THEN 70 ELSE 0 END AS ai FROM people p, c),
t AS (SELECT label, id, name, CASE WHEN exact > 0 THEN exact ELSE part END + ai AS score FROM s),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY score DESC, name, id) AS INT) AS nth FROM t WHERE score > 0)
SELECT * FROM r WHERE nth <= 5
"""


QUERIES = {
    "grep_literal": (grep_literal, GREP_SQL.format("contains(text, 'thing')")),
    "grep_regex": (grep_regex, GREP_SQL.format("regexp_matches(text, '[Tt]h[a-z]+ing[.,]')")),
    "grep_and_terms": (grep_and_terms, GREP_SQL.format("contains(text, 'heat') AND regexp_matches(text, '[Oo]uld?')")),
    "grep_indexed": (grep_indexed, GREP_SQL.format("contains(text, 'thing')")),
    "grep_normalized": (grep_normalized, GREP_SQL.format("regexp_matches(nfc_normalize(text), 'é[a-z]+ê')")),
    "grep_filtered_page": (
        grep_filtered_page,
        f"WITH {CORPUS_SQL} SELECT record_id, source_type, container, timestamp FROM corpus WHERE regexp_matches(text, 'e[a-z]') AND source_type IN ('src1', 'src2', 'src3') AND container IN ('en', 'fr') AND timestamp >= TIMESTAMP '2023-11-14 22:30:00' AND (timestamp > TIMESTAMP '2023-11-14 23:00:00' OR timestamp = TIMESTAMP '2023-11-14 23:00:00' AND record_id > '40') ORDER BY timestamp, record_id LIMIT 20",
    ),
    "grep_with_matches": (grep_with_matches, MATCHES_SQL),
    "match_counts": (match_counts, "SELECT CAST(doc_id AS VARCHAR) AS record_id, CAST(len(regexp_extract_all(text, '[Tt]h[a-z]+ing')) AS BIGINT) AS matches FROM documents"),
    "canonical_bodies": (canonical_bodies, "SELECT doc_id, sha256(nfc_normalize(replace(text, chr(13) || chr(10), chr(10)))) AS sha256 FROM documents"),
    "source_type_counts": (source_type_counts, "SELECT source AS source_type, count(*) AS records FROM documents GROUP BY source"),
    "exact_container": (exact_container, f"WITH {CORPUS_SQL} SELECT record_id, source_type, container, timestamp FROM corpus WHERE container = 'de' ORDER BY timestamp DESC, record_id LIMIT 50"),
    "link_resolve": (link_resolve, LINK_SQL),
    "history_search": (history_search, "SELECT conv_id, turn, role FROM conversations WHERE contains(lower(text), 'the') ORDER BY conv_id, turn LIMIT 50"),
    "decision_search": (decision_search, "SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND contains(lower(nfc_normalize(text)), 'the') AND contains(lower(nfc_normalize(text)), 'and') ORDER BY conv_id, turn LIMIT 50"),
    "thread_read": (thread_read, "SELECT turn, role, text FROM conversations WHERE conv_id = 0 AND turn > 1 ORDER BY turn LIMIT 100"),
    "operational_filter_page": (
        operational_filter_page,
        "SELECT event_id, ts, user_id, event_type FROM events WHERE event_type IN ('click', 'purchase') AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND (ts > TIMESTAMP '2024-01-06' OR ts = TIMESTAMP '2024-01-06' AND event_id > 0) ORDER BY ts, event_id LIMIT 100",
    ),
    "offset_page": (offset_page, "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 20 OFFSET 40"),
    "byte_budget_page": (
        byte_budget_page,
        """SELECT event_id, event_type FROM (SELECT *, 1 + sum(1 + strlen('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}')) OVER (ORDER BY event_id) AS total FROM (SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 100)) WHERE total <= 1000""",
    ),
    "label_inventory": (label_inventory, LABELS_SQL),
    "import_inventory": (
        import_inventory,
        "SELECT source, CAST(sum(n) AS BIGINT) AS total, count(*) AS \"unique\", CAST(sum(n - 1) AS BIGINT) AS duplicates, CAST(sum(b) AS BIGINT) AS bytes, CAST(sum(CASE WHEN lo <> hi THEN 1 ELSE 0 END) AS BIGINT) AS conflicts FROM (SELECT source, text, count(*) AS n, sum(strlen(text)) AS b, min(lang) AS lo, max(lang) AS hi FROM documents GROUP BY source, text) GROUP BY source",
    ),
    "source_overlaps": (source_overlaps, "SELECT sha256(text) AS identity, count(DISTINCT source) AS sources FROM documents GROUP BY text HAVING count(DISTINCT source) > 1"),
    "partition_window": (partition_window, "SELECT CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month, count(*) AS records, max(l_shipdate) AS last FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '2000-01-01' GROUP BY 1, 2"),
    "timeline_union": (timeline_union, "SELECT 'slide' AS kind, o_orderdate AS at, o_orderkey AS id, o_orderpriority AS title FROM orders UNION ALL SELECT 'message', ts, event_id, event_type FROM events"),
    "relation_fingerprint": (relation_fingerprint, FINGERPRINT_SQL),
    "corpus_watermark": (corpus_watermark, "SELECT coalesce(strftime(max(make_timestamp((1700000000 + 60 * doc_id) * 1000000)), '%Y-%m-%dT%H:%M:%S.%fZ'), 'empty') AS watermark FROM documents"),
    "set_difference": (set_difference, "WITH c AS (SELECT DISTINCT c_nationkey AS n FROM customer WHERE c_nationkey % 4 <> 1), s AS (SELECT DISTINCT s_nationkey AS n FROM supplier WHERE s_nationkey % 3 <> 1) SELECT n, 'added' AS change FROM c WHERE n NOT IN (SELECT n FROM s) UNION ALL SELECT n, 'removed' FROM s WHERE n NOT IN (SELECT n FROM c)"),
    "attribute_suggestions": (attribute_suggestions, ATTRIBUTES_SQL),
}
