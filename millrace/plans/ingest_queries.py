"""Pages through the gate, transcripts, channel snapshots, corpus metadata, lookups of derived records and identity checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import keys as K
from millrace.functions.text import canonical_array
from millrace.operators import corpus as C
from millrace.operators import activity, append, ingest, lake, paging
from millrace.plans.state_queries import GATE_ROWS_SQL, SCHEMAS, _gate_input, _messages
from millrace.plans.tables import minute, read
from millrace.sources import messages


def ingest_page(spark, d):
    """The gate's drafts on to the append: conversations with one opening word share a key, and the lake knows some keys."""
    drafts, observers, channels, decisions, blobs = _gate_input(spark, d)
    word = F.coalesce(F.element_at(F.split(F.get_json_object("payload", "$.content"), " "), 1), F.lit(""))
    drafts = drafts.withColumns({"seq": F.col("subject"), "idempotency_key": F.concat_ws("|", F.col("authority_model"), word), "canonical": F.get_json_object("payload", "$.author_id")})
    gated = ingest.gate(drafts, observers, SCHEMAS, channels, decisions, blobs, "2023-11-14 22:10:00")
    known = gated.where("idempotency_key like '%|T%'").groupBy("idempotency_key").agg(F.min("canonical").alias("canonical"))
    return ingest.ingest_page(gated, known).select("subject", "result", "reason")


PAGE_SQL = f"""
WITH {GATE_ROWS_SQL}, k AS (SELECT *, CASE authority WHEN 'dual' THEN 'dual_reference' WHEN 'source' THEN 'source_authoritative' ELSE 'lake_authoritative' END || '|' || coalesce(string_split(text, ' ')[1], '') AS k, role AS c FROM gated),
known AS (SELECT k, min(c) AS c FROM k WHERE k LIKE '%|T%' GROUP BY k),
a AS (SELECT k.*, known.c AS kc, first_value(k.c) OVER w AS fc, row_number() OVER w AS n FROM k LEFT JOIN known USING (k) WHERE outcome = 'accepted' WINDOW w AS (PARTITION BY k.k ORDER BY subject))
SELECT subject, CASE WHEN kc IS NULL AND n = 1 THEN 'ingested' WHEN c = coalesce(kc, fc) THEN 'duplicate' ELSE 'quarantined' END AS result,
  CASE WHEN NOT (kc IS NULL AND n = 1) AND c <> coalesce(kc, fc) THEN 'canonical collision' END AS reason FROM a
UNION ALL SELECT subject, outcome, reason FROM gated WHERE outcome <> 'accepted'
"""


def transcript_lines(spark, d):
    """Conversations as a transcript: users' texts, assistants' texts or tool calls, and lines about the program."""
    t = read(spark, d, "conversations")
    said = F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("name"))
    called = F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.concat(F.lit("tool"), "turn").alias("name"))
    thought = F.struct(F.lit("thinking").alias("type"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("name"))
    blocks = F.when(F.col("turn") % 4 == 1, F.array(said, called, called)).when(F.col("turn") % 4 == 3, F.array(thought)).otherwise(F.array(thought, said))
    line = lambda content: F.to_json(F.struct(F.col("role").alias("type"), F.concat(F.lit("s"), "conv_id").alias("sessionId"), F.when(F.col("conv_id") % 10 != 3, F.col("turn").cast("string")).alias("uuid"), F.when(F.col("turn") == 2, True).alias("isMeta"), (F.col("conv_id") % 2 == 0).alias("isSidechain"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.struct("role", content.alias("content")).alias("message")))
    rows = t.select(F.concat(F.lit("c"), "conv_id").alias("path"), F.col("turn").alias("line_no"), F.when(F.col("turn") == 5, F.lit("{bad")).when(F.col("role") == "user", line(F.col("text"))).otherwise(line(blocks)).alias("line"))
    return messages.transcript(rows).select("path", "line_no", "kind", "role", "text", "tool_name", "reason")


TRANSCRIPT_SQL = """
WITH t AS (SELECT *, 'c' || conv_id AS path, role = 'assistant' AND turn % 4 = 1 AND turn <> 5 AS called, CASE WHEN turn = 5 THEN NULL WHEN role <> 'user' AND turn % 4 = 3 THEN NULL WHEN trim(text) = '' THEN NULL ELSE text END AS said FROM conversations)
SELECT path, turn AS line_no, CASE WHEN called THEN 'tool_call' ELSE 'message' END AS kind, CASE WHEN turn = 5 OR called THEN NULL ELSE role END AS role, CASE WHEN called THEN NULL ELSE said END AS text, CASE WHEN called THEN 'tool' || turn || '+tool' || turn END AS tool_name,
  CASE WHEN turn = 5 THEN 'malformed line' WHEN role = 'system' THEN 'known type without a message' WHEN role = 'user' AND turn = 2 THEN 'meta line' WHEN role = 'user' AND said IS NULL THEN 'tool result or no text'
    WHEN role = 'assistant' AND NOT called AND said IS NULL THEN 'thinking or no text' WHEN conv_id % 10 = 3 THEN 'no session, id or time' END AS reason FROM t
"""


def channel_snapshots(spark, d):
    """Conversations as channels, a snapshot each, in the minute of their length."""
    t = read(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("n"), F.array_sort(F.collect_set("role")).alias("members"))
    rows = t.select(F.concat(F.lit("C"), "conv_id").alias("channel_id"), F.lit("room").alias("channel_name"), F.lit(None).cast("string").alias("purpose"), F.lit(None).cast("string").alias("topic"), F.size("members").cast("long").alias("member_count"), "members", F.lit(False).alias("is_archived"), minute("n").alias("snapshot_at"))
    return messages.slack_channels(rows).select("subject", "idempotency_key", F.get_json_object("payload", "$.member_count").cast("long").alias("member_count"))


CHANNELS_SQL = "SELECT 'channel:slack:C' || conv_id AS subject, 'slack:channel:C' || conv_id || ':snapshot:' || strftime(make_timestamp((1700000000 + 60 * max(turn)) * 1000000), '%Y-%m-%dT%H:%M') AS idempotency_key, count(DISTINCT role) AS member_count FROM conversations GROUP BY conv_id"


def corpus_metadata(spark, d):
    """What messages can be found and fetched again by."""
    rows = messages.discord(_messages(spark, d)).withColumns({"id": F.col("subject"), "published_nanos": F.lit(None).cast("long")})
    return C.corpus(rows).select("record_id", "metadata")


METADATA_SQL = """
SELECT s AS record_id, '{"observation_id":"' || s || '","schema":"schema:discord-message","source_type":"discord","source_object_id":"ch' || conv_id || ':' || conv_id || '-' || turn || '","privacy_keys":["' || s || '","' || role || '"],"source_system":"sys:discord","thread_key":"discord:thread:'
  || conv_id || '-' || CASE WHEN turn > 0 THEN 0 ELSE turn END || '","author_id":"' || role || '","channel_id":"ch' || conv_id || '","guild_id":"g"' || CASE WHEN turn > 0 THEN ',"referenced_message_id":"' || conv_id || '-0"' ELSE '' END || ',"message_id":"' || conv_id || '-' || turn || '"}' AS metadata
FROM (SELECT *, 'message:discord:ch' || conv_id || ':' || conv_id || '-' || turn AS s FROM conversations) WHERE trim(text) <> ''
"""


def derived_by_observation(spark, d):
    """Derived records (order lines) that refer to some observations (parts and suppliers)."""
    li = read(spark, d, "lineitem")
    records = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_returnflag").alias("kind"), F.array(F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey")).alias("observations"))
    wanted = read(spark, d, "part").where("p_size = 7").select(F.concat(F.lit("p"), "p_partkey").alias("anchor")).unionByName(read(spark, d, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("s"), "s_suppkey").alias("anchor")))
    return lake.by_anchor(records, wanted)


ANCHOR_SQL = """
WITH r AS (SELECT DISTINCT l_orderkey || '-' || l_linenumber AS id, l_returnflag AS kind, unnest(['p' || l_partkey, 's' || l_suppkey]) AS anchor FROM lineitem)
SELECT * FROM r WHERE anchor IN (SELECT 'p' || p_partkey FROM part WHERE p_size = 7 UNION ALL SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal < 0)
"""


def derived_page(spark, d):
    """A page of derived records by (created_at, id)."""
    li = read(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_shipdate").alias("created_at"))
    return paging.keyset_page(li, [("created_at", False), ("id", False)], 100, ["1995-06-17 00:00:00", "5"])


def operational_events(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").cast("string").alias("event_id"), F.col("user_id").alias("stream_id"), "event_type", F.col("ts").alias("occurred_at"))
    return lake.operational_filter(e, "2024-01-05 00:00:00", "2024-01-20 12:00:00", event_type="click", stream_id=None)


def identity_checks(spark, d):
    """Documents as drafts with keys of the second version: some have no object, broken JSON, another's key or a foreign container."""
    docs, n = read(spark, d, "documents"), F.col("doc_id")
    canonical = F.when(n % 7 == 3, F.lit("{")).otherwise(F.to_json(F.struct("n_chars")))
    object_id = F.when(n % 11 != 5, n.cast("string"))
    rows = docs.select("doc_id", F.lit("docs").alias("source"), F.lit("one").alias("source_instance"), object_id.alias("object_id"), F.when(n % 5 < 3, F.concat(F.element_at(F.array(F.lit("one"), F.lit("two"), F.lit("one")), (n % 5 + 1).cast("int")), F.lit(":"), "source")).alias("container"), canonical.alias("canonical"))
    rows = rows.withColumn("idempotency_key", F.when(n % 13 == 1, F.lit("docs:0:x")).otherwise(K.identity_key(F.col("source"), F.col("object_id"), F.col("canonical"))))
    return lake.verified_identities(rows).select("doc_id", "identity_problem")


IDENTITY_CHECK_SQL = """
SELECT doc_id, CASE WHEN doc_id % 11 = 5 THEN 'no object id' WHEN doc_id % 7 = 3 THEN 'canonical JSON is not valid' WHEN doc_id % 13 = 1 THEN 'key is not the derived one' WHEN doc_id % 5 = 1 THEN 'container of another instance' END AS identity_problem FROM documents
"""


def retired_generations(spark, d):
    """Orders as generations of their customers' projections; large ones are pinned."""
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("projection"), F.col("o_orderkey").alias("generation"), F.col("o_orderkey").alias("n"), (F.col("o_totalprice") > 200000).alias("pinned"))
    return append.retired(o, 3)


RETIRED_SQL = "SELECT o_custkey AS projection, o_orderkey AS generation FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS nth FROM orders) WHERE nth > 3 AND o_totalprice <= 200000"


def normalized_profiles(spark, d):
    """Documents' openings as profiles: whatever is blank goes, addresses are lower case, a given address stands above a made one."""
    docs = read(spark, d, "documents").select("doc_id", F.substring("text", 1, 12).alias("name"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit(" A"), "source", F.lit("@X.org "))).alias("email"), F.lit("M@x.org").alias("generated_email"), F.when(F.col("doc_id") % 2 == 0, F.lit("  ")).otherwise(F.col("lang")).alias("bio"), F.lit(" https://x.org/ ").alias("url"))
    return K.normalized_profile(docs, text=["name", "bio"], email=["email", "generated_email"], url=["url"]).select("doc_id", "email", "generated_email", "bio", "url")


PROFILE_SQL = "SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN 'a' || source || '@x.org' END AS email, CASE WHEN doc_id % 3 = 0 THEN 'm@x.org' END AS generated_email, CASE WHEN doc_id % 2 = 1 THEN lang END AS bio, 'https://x.org/' AS url FROM documents"



def event_lookup(spark, d):
    """One event by its id; the comparison reaches the scan."""
    return read(spark, d, "events").where("event_id = 77").limit(1).select("event_id", "user_id", "event_type")


def person_list(spark, d):
    """People by their last activity, those without any last."""
    last = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("person")).agg(F.max("o_orderdate").alias("last_activity"))
    people = read(spark, d, "customer").select(F.col("c_custkey").alias("person")).join(last, "person", "left")
    return paging.keyset_page(people, [("last_activity", True), ("person", False)], 120)


def merged_partitions(spark, d):
    """Order lines of three partitions in one order."""
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return paging.merge_sorted([li.where(F.col("l_returnflag") == f) for f in "ANR"], [("l_orderkey", False), ("l_linenumber", False)])


def export_scan(spark, d):
    """A page of an export that may look at 300 positions."""
    return paging.budgeted_rows(read(spark, d, "events").where("event_type = 'click'").select("event_id"), "event_id", 100, 900, 50, 300)


def changed_leaves(spark, d):
    """Order states as partitions: those with orders past what was committed."""
    o = read(spark, d, "orders")
    last = o.groupBy(F.col("o_orderstatus").alias("leaf_id")).agg(F.max("o_orderkey").alias("last"))
    marks = o.where("o_orderstatus <> 'P' and (o_orderstatus = 'F' or o_orderkey < 500)").groupBy(F.col("o_orderstatus").alias("leaf_id")).agg(F.max("o_orderkey").alias("position"))
    return lake.changed_tails(last, marks)


LEAVES_SQL = """
WITH l AS (SELECT o_orderstatus AS s, max(o_orderkey) AS last FROM orders GROUP BY 1), m AS (SELECT o_orderstatus AS s, max(o_orderkey) AS p FROM orders WHERE o_orderstatus = 'F' OR o_orderstatus <> 'P' AND o_orderkey < 500 GROUP BY 1)
SELECT s AS leaf_id, coalesce(p, 0) AS after, last AS upto FROM l LEFT JOIN m USING (s) WHERE last > coalesce(p, 0)
"""


def profile_scores(spark, d):
    """Richness of profiles, privacy keys, anchors as one sorted array, and sources by channel."""
    docs, n = read(spark, d, "documents"), F.col("doc_id")
    some = lambda m, c: F.when(n % m > 0, c)
    none = F.array().cast("array<string>")
    score = K.richness(some(2, F.lit("a")), some(3, F.lit("b")), F.when(n % 4 > 0, F.lit("n")).otherwise(F.lit(" ")), some(5, F.lit("bio")), some(7, F.lit("p")), F.when(n % 3 == 1, F.array(F.lit("g"), F.lit("h"))).otherwise(none), F.when(n % 3 == 2, F.array(F.lit("t"))))
    meta = F.to_json(F.struct(F.when(n % 2 == 0, F.lit("sender")).alias("communication_sender_id"), F.when(n % 3 == 0, F.lit("ch")).when(n % 3 == 1, F.lit(" ")).alias("communication_channel_id")))
    payload = F.to_json(F.struct(F.when(n % 5 == 0, F.lit("x@y")).alias("email"), F.when(n % 7 == 0, F.col("source")).alias("user_id")))
    rows = docs.select("doc_id", score.cast("long").alias("score"), F.col("source").alias("source_system"), meta.alias("meta"), payload.alias("payload"), canonical_array(F.concat(F.array("lang"), F.array(F.lit("b"), F.lit("a"), F.lit("b")))).alias("anchors"))
    return rows.select("doc_id", "score", "anchors", F.array_join(K.privacy_keys(F.col("source_system"), F.col("meta"), F.col("payload")), ",").alias("keys"), activity.source_of().alias("source"))


SCORES_SQL = """
SELECT doc_id, CAST(CASE WHEN doc_id % 2 > 0 THEN 10 ELSE 0 END + CASE WHEN doc_id % 3 > 0 THEN 4 ELSE 0 END + CASE WHEN doc_id % 4 > 0 THEN 4 ELSE 0 END + CASE WHEN doc_id % 5 > 0 THEN 12 ELSE 0 END + CASE WHEN doc_id % 7 > 0 THEN 6 ELSE 0 END + CASE doc_id % 3 WHEN 1 THEN 4 WHEN 2 THEN 1 ELSE 0 END AS BIGINT) AS score,
  '["' || array_to_string(list_sort(list_distinct(['a', 'b', lang])), '","') || '"]' AS anchors,
  array_to_string(list_sort(list_distinct(list_filter([source, CASE WHEN doc_id % 2 = 0 THEN 'sender' END, CASE WHEN doc_id % 5 = 0 THEN 'x@y' END], lambda x: x IS NOT NULL))), ',') AS keys, CASE WHEN doc_id % 3 = 0 THEN 'ch' ELSE source END AS source FROM documents
"""

QUERIES = {
    "event_lookup": (event_lookup, "SELECT event_id, user_id, event_type FROM events WHERE event_id = 77"),
    "person_list": (person_list, "SELECT c_custkey AS person, max(o_orderdate) AS last_activity FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey ORDER BY last_activity DESC NULLS LAST, person LIMIT 120"),
    "merged_partitions": (merged_partitions, "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem"),
    "export_scan": (export_scan, "SELECT event_id FROM events WHERE event_type = 'click' AND event_id > 100 AND event_id <= 400 ORDER BY event_id LIMIT 50"),
    "changed_leaves": (changed_leaves, LEAVES_SQL),
    "profile_scores": (profile_scores, SCORES_SQL),
    "ingest_page": (ingest_page, PAGE_SQL),
    "transcript_lines": (transcript_lines, TRANSCRIPT_SQL),
    "channel_snapshots": (channel_snapshots, CHANNELS_SQL),
    "corpus_metadata": (corpus_metadata, METADATA_SQL),
    "derived_by_observation": (derived_by_observation, ANCHOR_SQL),
    "derived_page": (derived_page, "SELECT l_orderkey || '-' || l_linenumber AS id, l_shipdate AS created_at FROM lineitem WHERE l_shipdate > TIMESTAMP '1995-06-17' OR l_shipdate = TIMESTAMP '1995-06-17' AND l_orderkey || '-' || l_linenumber > '5' ORDER BY 2, 1 LIMIT 100"),
    "operational_events": (operational_events, "SELECT CAST(event_id AS VARCHAR) AS event_id, user_id AS stream_id, event_type, ts AS occurred_at FROM events WHERE event_type = 'click' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 12:00:00'"),
    "identity_checks": (identity_checks, IDENTITY_CHECK_SQL),
    "retired_generations": (retired_generations, RETIRED_SQL),
    "normalized_profiles": (normalized_profiles, PROFILE_SQL),
}
