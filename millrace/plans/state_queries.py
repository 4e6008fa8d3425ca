"""State machines, identities, graphs, ingestion, corpus and streaming queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import corpus as C
from millrace.operators import graph, identity, ingest, states
from millrace.plans.tables import NOW, minute, read
from millrace.shared import materialize, new_path
from millrace.sources import messages
from millrace.streaming import views

#: Event types of the driver's table as states that they ask for.
ASKED = {"view": "dispatched", "click": "parked", "error": "inconclusive", "purchase": "terminated", "signup": "open"}


def claim_states(spark, d):
    """Days of users as claims, so that not all end in the terminal state."""
    e = read(spark, d, "events")
    asked = F.create_map(*[F.lit(x) for kv in ASKED.items() for x in kv])
    rows = e.select(F.concat_ws("|", "user_id", F.to_date("ts")).alias("claim_id"), F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.element_at(asked, F.col("event_type")).alias("to_state"))
    return states.claim_states(rows)


CLAIM_SQL = """
WITH RECURSIVE e AS (SELECT user_id || '|' || strftime(ts, '%Y-%m-%d') AS k, ts, (MAP {'view': 'dispatched', 'click': 'parked', 'error': 'inconclusive', 'purchase': 'terminated', 'signup': 'open'})[event_type] AS s,
  row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS n FROM events),
nexts(a, b) AS (VALUES ('open', 'dispatched'), ('open', 'inconclusive'), ('open', 'terminated'), ('open', 'parked'), ('dispatched', 'inconclusive'), ('dispatched', 'terminated'), ('dispatched', 'parked'),
  ('inconclusive', 'dispatched'), ('inconclusive', 'terminated'), ('inconclusive', 'parked'), ('parked', 'open'), ('parked', 'dispatched'), ('parked', 'terminated'),
  ('open', 'open'), ('dispatched', 'dispatched'), ('inconclusive', 'inconclusive'), ('parked', 'parked'), ('terminated', 'terminated')),
f AS (SELECT DISTINCT k, CAST(0 AS BIGINT) AS n, 'open' AS state, CAST(0 AS BIGINT) AS taken, CAST(NULL AS TIMESTAMP) AS updated FROM e
  UNION ALL SELECT f.k, e.n, CASE WHEN x.a IS NULL THEN f.state ELSE e.s END, f.taken + CASE WHEN x.a IS NULL THEN 0 ELSE 1 END, CASE WHEN x.a IS NULL THEN f.updated ELSE e.ts END
  FROM f JOIN e ON e.k = f.k AND e.n = f.n + 1 LEFT JOIN nexts x ON x.a = f.state AND x.b = e.s)
SELECT k AS claim_id, state, taken, n - taken AS refused, updated FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC) AS r FROM f) WHERE r = 1
"""


def _card_events(li, malformed=True):
    kind = F.when(F.col("l_returnflag") == "N", "send-record@1").otherwise("reply-approval@1")
    event = states.card_event(kind, F.when(F.col("l_returnflag") == "A", "approved").otherwise("skipped"), F.when(F.col("l_linestatus") == "F", "approved").otherwise("automatic"))
    event = F.when(F.col("l_quantity") <= 45, event) if malformed else event
    return li.select(F.col("l_orderkey").alias("draft_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_shipdate").alias("created_at"), kind.alias("kind"), event.alias("event"))


def card_drafts(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("draft_id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") != "P", F.expr("timestamp'2023-06-01' + make_interval(0, 0, 0, cast(o_custkey % 400 as int))")).alias("expires_at"))


def card_states(spark, d):
    """Orders as drafts, their lines as approvals and sends."""
    return states.cards(card_drafts(spark, d), _card_events(read(spark, d, "lineitem"), malformed=False), NOW).select("draft_id", "state", "updated_at", "taken")


CARD_SQL = f"""
WITH RECURSIVE e AS (SELECT l_orderkey AS k, l_shipdate AS ts, CASE WHEN l_returnflag = 'A' THEN 'approved' WHEN l_returnflag <> 'N' THEN 'skipped' WHEN l_linestatus = 'F' THEN 'send_approved' ELSE 'send_automatic' END AS s,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber || '-' || l_partkey || '-' || l_suppkey) AS n FROM lineitem),
steps(s, a, b) AS (VALUES ('approved', 'pending', 'approved'), ('skipped', 'pending', 'skipped'), ('send_automatic', 'pending', 'sent'), ('send_automatic', 'approved', 'sent'), ('send_approved', 'approved', 'sent')),
f AS (SELECT o_orderkey AS k, CAST(0 AS BIGINT) AS n, 'pending' AS state, CAST(0 AS BIGINT) AS taken, o_orderdate AS updated FROM orders
  UNION ALL SELECT f.k, e.n, coalesce(x.b, f.state), f.taken + CASE WHEN x.b IS NULL THEN 0 ELSE 1 END, CASE WHEN x.b IS NULL THEN f.updated ELSE e.ts END
  FROM f JOIN e ON e.k = f.k AND e.n = f.n + 1 LEFT JOIN steps x ON x.s = e.s AND x.a = f.state),
l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC) AS r FROM f)
SELECT k AS draft_id, CASE WHEN state = 'pending' AND o_orderstatus <> 'P' AND TIMESTAMP '2023-06-01' + to_days(CAST(o_custkey % 400 AS INT)) < TIMESTAMP '{NOW}' THEN 'expired' ELSE state END AS state, updated AS updated_at, taken
FROM l JOIN orders ON o_orderkey = k WHERE r = 1
"""


def _claims(spark, d):
    docs = read(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.lit("claim@1").alias("kind"), F.array("lang").alias("anchors"), F.sha2(F.col("text").cast("binary"), 256).alias("payload_hash"), minute("doc_id").alias("created_at"), "source")


def claim_dedup(spark, d):
    return states.dedup_claims(_claims(spark, d)).select("claim_id", "payload_hash", "absorbed")


def claim_groups(spark, d):
    return states.claim_groups(_claims(spark, d).select(F.col("id").alias("claim_id"), F.array("source", F.lit("lake")).alias("source_refs")))


def claim_history(spark, d):
    """Labels as events of documents' claims, through the claim that stands for all copies of a text; some anchor nothing or ask for nothing."""
    members = states.claim_members(_claims(spark, d))
    n = F.col("doc_id")
    asked = F.element_at(F.array(*[F.lit(s) for s in ("dispatched", "parked", "open", "verified", "inconclusive")], F.lit(None).cast("string")), (n % 6 + 1).cast("int"))
    anchor = F.when(n % 9 == 8, -n).otherwise(n)
    events = read(spark, d, "labels").select(F.col("doc_id").alias("id"), minute("doc_id").alias("created_at"), F.array(anchor, F.floor(anchor / 2)).alias("claims"), asked.alias("to_state"))
    return states.claim_history(events, members).select("claim_id", "id", "from_state", "to_state", "audit")


CLAIM_HISTORY_SQL = """
WITH RECURSIVE m AS (SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY lang, text) AS c FROM documents),
e AS (SELECT doc_id AS id, CASE WHEN doc_id % 9 = 8 THEN -doc_id ELSE doc_id END AS a, (['dispatched', 'parked', 'open', 'verified', 'inconclusive', NULL])[doc_id % 6 + 1] AS s FROM labels),
t AS (SELECT DISTINCT e.id, m.c, e.s FROM (SELECT id, a, s FROM e UNION ALL SELECT id, CAST(floor(a / 2) AS BIGINT), s FROM e) e JOIN m ON m.id = e.a),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY id) AS n FROM t WHERE s IS NOT NULL),
nexts(a, b) AS (VALUES ('open', 'dispatched'), ('open', 'inconclusive'), ('open', 'verified'), ('open', 'parked'), ('dispatched', 'inconclusive'), ('dispatched', 'verified'), ('dispatched', 'parked'),
  ('inconclusive', 'dispatched'), ('inconclusive', 'parked'), ('parked', 'open'), ('parked', 'dispatched'), ('open', 'open'), ('dispatched', 'dispatched'), ('inconclusive', 'inconclusive'), ('parked', 'parked'), ('verified', 'verified')),
f AS (SELECT c, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS was, CAST(NULL AS VARCHAR) AS s, 'open' AS state, true AS ok FROM (SELECT DISTINCT c FROM o)
  UNION ALL SELECT f.c, o.n, o.id, f.state, o.s, CASE WHEN x.a IS NULL THEN f.state ELSE o.s END, x.a IS NOT NULL FROM f JOIN o ON o.c = f.c AND o.n = f.n + 1 LEFT JOIN nexts x ON x.a = f.state AND x.b = o.s)
SELECT c AS claim_id, id, was AS from_state, s AS to_state, CASE WHEN NOT ok THEN 'invalid_transition' END AS audit FROM f WHERE n > 0
UNION ALL SELECT c, id, NULL, NULL, 'invalid_state_event' FROM t WHERE s IS NULL
UNION ALL SELECT NULL, id, NULL, s, 'missing_claim_anchor' FROM e WHERE id NOT IN (SELECT id FROM t)
"""


def card_audit(spark, d):
    """Orders as drafts, of which cancelled ones are unknown; their lines as approvals and sends, some malformed."""
    drafts = read(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("draft_id"))
    return states.card_audit(drafts, _card_events(read(spark, d, "lineitem"))).select("draft_id", "id", "audit")


CARD_AUDIT_SQL = """
WITH RECURSIVE e AS (SELECT l_orderkey AS k, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, l_returnflag <> 'N' AS approval,
  CASE WHEN l_quantity > 45 THEN '?' WHEN l_returnflag = 'A' THEN 'approved' WHEN l_returnflag <> 'N' THEN 'skipped' WHEN l_linestatus = 'F' THEN 'send_approved' ELSE 'send_automatic' END AS s,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber || '-' || l_partkey || '-' || l_suppkey) AS n FROM lineitem),
steps(s, a, b) AS (VALUES ('approved', 'pending', 'approved'), ('skipped', 'pending', 'skipped'), ('send_automatic', 'pending', 'sent'), ('send_automatic', 'approved', 'sent'), ('send_approved', 'approved', 'sent')),
f AS (SELECT o_orderkey AS k, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS id, 'pending' AS was, 'pending' AS state, false AS approval, '' AS s FROM orders WHERE o_orderstatus <> 'P'
  UNION ALL SELECT f.k, e.n, e.id, f.state, coalesce(x.b, f.state), e.approval, CASE WHEN x.b IS NULL THEN CASE WHEN e.s = '?' THEN '?' ELSE 'refused' END ELSE 'taken' END FROM f JOIN e ON e.k = f.k AND e.n = f.n + 1 LEFT JOIN steps x ON x.s = e.s AND x.a = f.state)
SELECT k AS draft_id, id, CASE WHEN approval AND s = '?' AND was = 'pending' THEN 'malformed_approval' WHEN NOT approval AND s = '?' THEN 'malformed_send_record' WHEN NOT approval AND s = 'refused' THEN 'invalid_send_transition' END AS audit
FROM f WHERE n > 0 AND (approval AND s = '?' AND was = 'pending' OR NOT approval AND s <> 'taken')
UNION ALL SELECT k, id, 'unknown_draft_anchor' FROM e WHERE k NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
"""


def _candidates(spark, d):
    """Customers (of two sources) and suppliers; neither the order of sources nor that of candidates follows the other."""
    c, s = read(spark, d, "customer"), read(spark, d, "supplier")
    a = c.select(F.concat(F.lit("c"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("candidate"), F.when(F.col("c_custkey") % 3 == 0, "web").otherwise(F.lit("crm")).alias("source"), F.concat_ws("@", F.col("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("email"), F.concat(F.lit(" Acct "), F.floor("c_acctbal").cast("string")).alias("name"))
    b = s.select(F.concat(F.lit("s"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("candidate"), F.lit("audit").alias("source"), F.concat(F.lit("building@"), F.col("s_nationkey").cast("string")).alias("email"), F.concat(F.lit("acct "), F.floor("s_acctbal").cast("string")).alias("name"))
    return a.unionByName(b)


CANDIDATES_SQL = """cand AS (SELECT 'c' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS candidate, CASE WHEN c_custkey % 3 = 0 THEN 'web' ELSE 'crm' END AS source, lower(c_mktsegment || '@' || c_nationkey) AS email, 'acct ' || CAST(floor(c_acctbal) AS BIGINT) AS name FROM customer
  UNION ALL SELECT 's' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0'), 'audit', 'building@' || s_nationkey, 'acct ' || CAST(floor(s_acctbal) AS BIGINT) FROM supplier)"""


def identity_components(spark, d):
    """Customers and suppliers with equal emails, and all medium pairs by name accepted."""
    candidates = _candidates(spark, d)
    return identity.persons(candidates, identity.name_pairs(candidates))


IDENTITY_SQL = f"""
WITH RECURSIVE {CANDIDATES_SQL},
mail AS (SELECT a.candidate AS a, b.candidate AS b FROM cand a JOIN cand b ON a.email = b.email AND a.source <> b.source),
firsts AS (SELECT name, source, min(candidate) AS c FROM cand GROUP BY name, source), pairs AS (SELECT x.c AS a, y.c AS b FROM firsts x JOIN firsts y ON x.name = y.name AND x.c <> y.c),
edges AS (SELECT a, b FROM mail UNION SELECT b, a FROM mail UNION SELECT a, b FROM pairs),
reach AS (SELECT candidate AS a, candidate AS b FROM cand UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT a AS candidate, min(b) AS person FROM reach GROUP BY a
"""


def name_pairs(spark, d):
    return identity.name_pairs(_candidates(spark, d))


NAME_SQL = f"WITH {CANDIDATES_SQL}, f AS (SELECT name, source, min(candidate) AS c FROM cand GROUP BY name, source), m AS (SELECT name, min(source) AS source, arg_min(c, source) AS a FROM f GROUP BY name) SELECT a, c AS b, f.name AS key FROM f JOIN m ON f.name = m.name AND f.source <> m.source"


def ownership(spark, d):
    """Order lines owned by customers (owner) and suppliers (editor)."""
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", F.array(F.struct(F.concat(F.lit("c"), "o_custkey").alias("key"), F.lit("owner").alias("role")), F.struct(F.concat(F.lit("s"), "l_suppkey").alias("key"), F.lit("editor").alias("role"))).alias("keys"))
    people = read(spark, d, "customer").select(F.col("c_nationkey").alias("person"), F.concat(F.lit("c"), "c_custkey").alias("key")).unionByName(read(spark, d, "supplier").select(F.col("s_nationkey").alias("person"), F.concat(F.lit("s"), "s_suppkey").alias("key")))
    return identity.owned(people, rows.withColumnRenamed("l_orderkey", "observation_id"))


OWNER_SQL = """
SELECT observation_id, person, max(role) AS role FROM (
  SELECT l_orderkey AS observation_id, c_nationkey AS person, 'owner' AS role FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT l_orderkey, s_nationkey, 'editor' FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey) GROUP BY 1, 2
"""


def best_profiles(spark, d):
    docs = read(spark, d, "documents")
    rich = F.when(F.col("n_chars") > 2000, 12).otherwise(0) + F.when(F.col("lang") == "en", 10).otherwise(0)
    return identity.best_profiles(docs.select(F.col("source").alias("person"), rich.alias("richness"), minute("doc_id").alias("created_at"), F.col("doc_id").alias("document_id"))).select("person", "richness", "document_id")


def supersedes_chain(spark, d):
    """A customer's orders: each supersedes the one before it."""
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    decisions = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.array_compact(F.array(before)).alias("supersedes"))
    return graph.superseded(decisions)


SUPERSEDES_SQL = """
WITH o AS (SELECT o_orderkey AS id, lead(o_orderkey) OVER w AS nxt, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lst FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT id, nxt AS replaced_by, CASE WHEN nxt IS NOT NULL THEN lst END AS terminal, nxt IS NULL AS is_current FROM o
"""


def source_roots(spark, d):
    """Orders derived from their lines, lines observed as parts."""
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    none = F.array().cast("array<string>")
    line = F.concat_ws("-", F.lit("line"), "l_orderkey", "l_linenumber")
    lines = li.select(line.alias("id"), F.concat(F.lit("part:"), "l_partkey").alias("part")).groupBy("id").agg(F.collect_set("part").alias("observations")).withColumn("parents", none)
    of = li.groupBy("l_orderkey").agg(F.collect_set(line).alias("parents"))
    orders = o.join(of, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.concat(F.lit("order:"), "o_orderkey").alias("id"), none.alias("observations"), F.coalesce("parents", none).alias("parents"))
    found = graph.source_roots(materialize(orders.unionByName(lines), "supplementals"))
    return found.where("id like 'order:%'").select("id", F.array_join("roots", ",").alias("roots"))


ROOTS_SQL = "SELECT 'order:' || o_orderkey AS id, coalesce(string_agg(DISTINCT 'part:' || l_partkey, ',' ORDER BY 'part:' || l_partkey), '') AS roots FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey"


def session_tree(spark, d):
    t = read(spark, d, "conversations")
    name = lambda turn: F.concat_ws("-", "conv_id", turn)
    return graph.session_tree(t.select(name(F.col("turn").cast("string")).alias("session"), F.when(F.col("turn") > 0, name((F.col("turn") - 1).cast("string"))).alias("parent")))


# ---- ingestion and corpus

SCHEMAS = {"schema:discord-message": {"type": "object", "required": ["content"], "properties": {"content": {"type": "string"}, "channel_id": {"type": "string"}}, "x-version": "1.0.0"}, "schema:observer-heartbeat": {"x-version": "1.0.0"}, "schema:note": {"x-version": "2.0.0"}}


def _messages(spark, d):
    """Conversations as messages of a chat source: a conversation is a channel."""
    t = read(spark, d, "conversations")
    return t.select(
        F.concat(F.lit("ch"), F.col("conv_id").cast("string")).alias("channel_id"), F.concat_ws("-", "conv_id", "turn").alias("message_id"), minute("turn").alias("timestamp"), F.col("role").alias("author_id"), F.col("role").alias("author_name"), F.col("text").alias("content"),
        F.lit(False).alias("is_dm"), F.lit("g").alias("guild_id"), F.lit("guild").alias("guild_name"), F.concat(F.lit("room "), F.col("conv_id").cast("string")).alias("channel_name"), F.array().cast("array<string>").alias("mentions"),
        F.when(F.col("turn") > 0, F.concat(F.col("conv_id").cast("string"), F.lit("-0"))).alias("referenced_message_id"),
    )


def _gate_input(spark, d):
    """Messages of conversations, a draft each, of lake and of dual observers. Every fifth conversation's channel is disabled, every seventh is not registered, every eleventh's drafts refer to the
    source as well. Some first turns are heartbeats of any authority and capture, some senders are numbers, some drafts name a channel by id (their own, another's or none); some have attachments; every other is sent at half a
    second; systems opted out and may have consented again by channel. Drafts of one turn share a key."""
    drafts = messages.discord(_messages(spark, d))
    conv_id, turn = F.regexp_extract("subject", r"ch(\d+):", 1).cast("long"), F.regexp_extract("subject", r"-(\d+)$", 1).cast("long")
    beat = (turn == 0) & (conv_id % 13 == 5)
    named = F.when(conv_id % 19 == 7, conv_id.cast("string")).when(conv_id % 19 == 8, F.lit("0")).when(conv_id % 19 == 9, F.lit("none"))
    more = F.concat(F.lit('{"source_instance":"one",'), F.coalesce(F.concat(F.lit('"communication_channel_id":"channel:'), named, F.lit('",')), F.lit("")), F.expr("substring(meta, 2)"))
    drafts = drafts.withColumns({
        "meta": F.when(conv_id % 17 == 6, F.regexp_replace(more, '"communication_sender_id":"[^"]*"', '"communication_sender_id":7')).otherwise(more),
        "schema": F.when(beat, "schema:observer-heartbeat").otherwise(F.col("schema")),
        "observer": F.when(conv_id % 3 == 1, "obs:dual").otherwise(F.lit("obs:lake")),
        "authority_model": F.when(beat & (conv_id % 4 == 1), "source_authoritative").when(conv_id % 11 == 4, "dual_reference").otherwise(F.lit("lake_authoritative")),
        "capture_model": F.when(beat & (conv_id % 4 == 2), "snapshot").otherwise(F.col("capture_model")),
        "idempotency_key": F.concat(F.lit("turn:"), turn.cast("string")),
        "attachments": F.when(turn % 4 == 3, F.array(F.concat(F.lit("blob:"), (conv_id % 6).cast("string")))).otherwise(F.col("attachments")),
        "published": F.timestamp_micros(F.unix_micros("published") + turn % 2 * 500_000)})
    conv = read(spark, d, "conversations").select("conv_id").distinct()
    channels = conv.where("conv_id % 7 <> 3").select(
        F.concat(F.lit("channel:"), F.col("conv_id").cast("string")).alias("id"), F.lit("discord").alias("kind"), F.lit("one").alias("source_instance_id"), F.concat(F.lit("ch"), F.col("conv_id").cast("string")).alias("external_id"), (F.col("conv_id") % 5 != 2).alias("enabled"), F.lit(3600).cast("long").alias("reply_slo_seconds"),
        F.lit(60).cast("long").alias("freshness_threshold_seconds"))
    observers = spark.createDataFrame([(o, "sys:discord", [], a, "event") for o, a in (("obs:lake", "lake_authoritative"), ("obs:dual", "dual_reference"))], "observer string, source_system string, schemas array<string>, authority_model string, capture_model string")
    old = spark.createDataFrame([("person:x", "user", "opted_out", "a")], "subject string, identifier string, status string, id string").withColumns({"published": minute(1), "recorded_at": minute(1)})
    again = conv.where("conv_id % 2 = 0").select(F.lit("person:y").alias("subject"), F.concat(F.lit("ch"), F.col("conv_id").cast("string")).alias("identifier"), F.lit("unrestricted").alias("status"), F.col("conv_id").cast("string").alias("id"), minute(2).alias("published"), minute(2).alias("recorded_at"))
    blobs = spark.createDataFrame([(f"blob:{i}",) for i in range(5)], "blob_ref string")
    return drafts, observers, channels, old.unionByName(again), blobs


def ingest_gate(spark, d):
    drafts, observers, channels, decisions, blobs = _gate_input(spark, d)
    told = lambda n: F.get_json_object("meta", f"$.communication.{n}").alias(f"told_{n}")
    return ingest.gate(drafts, observers, SCHEMAS, channels, decisions, blobs, "2023-11-14 22:10:00").select("subject", "outcome", "reason", "reply_due_at", told("channel_id"), told("sender"), told("reply_due_at"), told("reply_slo_seconds"), F.get_json_object("meta", "$.communication_thread_ref").alias("thread"))


#: A draft of lake authority passes where its observer has that too, one of dual reference passes everywhere and is reviewed. A draft of a dual observer must be dual, but for heartbeats.
GATE_ROWS_SQL = """
m AS (SELECT 'message:discord:ch' || conv_id || ':' || conv_id || '-' || turn AS subject, conv_id, turn, role, text, make_timestamp((1700000000 + 60 * turn) * 1000000 + turn % 2 * 500000) AS tm, turn = 0 AND conv_id % 13 = 5 AS beat,
  CASE conv_id % 19 WHEN 7 THEN CAST(conv_id AS VARCHAR) WHEN 8 THEN '0' WHEN 9 THEN 'none' END AS named, conv_id % 3 = 1 AS dual_observer FROM conversations),
r AS (SELECT *, CASE WHEN beat AND conv_id % 4 = 1 THEN 'source' WHEN conv_id % 11 = 4 THEN 'dual' ELSE 'lake' END AS authority,
  CASE WHEN beat THEN NULL WHEN named = 'none' THEN NULL WHEN named = '0' THEN 0 WHEN conv_id % 7 <> 3 THEN conv_id END AS channel FROM m),
g AS (SELECT *, CASE WHEN authority <> 'dual' AND (authority <> CASE WHEN beat OR NOT dual_observer THEN 'lake' ELSE 'dual' END) THEN 'authority mismatch' WHEN beat AND conv_id % 4 = 2 THEN 'capture mismatch'
  WHEN NOT beat AND conv_id % 17 = 6 THEN 'missing channel metadata' WHEN NOT beat AND channel IS NULL THEN 'unregistered channel' WHEN NOT beat AND channel % 5 = 2 THEN 'disabled channel' WHEN NOT beat AND channel <> conv_id THEN 'channel is another''s'
  WHEN NOT beat AND role = 'user' AND conv_id % 2 = 1 THEN 'policy denied' WHEN authority = 'dual' THEN 'policy review required'
  WHEN turn % 4 = 3 AND conv_id % 6 = 5 THEN 'missing attachment' WHEN tm > TIMESTAMP '2023-11-14 22:20:00' THEN 'clock skew' END AS reason FROM r),
gated AS (SELECT *, CASE WHEN reason IS NULL THEN 'accepted' WHEN reason IN ('missing attachment', 'authority mismatch', 'capture mismatch') THEN 'rejected' ELSE 'quarantined' END AS outcome,
  reason IS NULL AND NOT beat AS told FROM g)
"""
GATE_SQL = f"""WITH {GATE_ROWS_SQL} SELECT subject, outcome, reason, CASE WHEN channel IS NOT NULL THEN tm + INTERVAL 1 HOUR END AS reply_due_at, CASE WHEN told THEN 'channel:' || channel END AS told_channel_id, CASE WHEN told THEN role END AS told_sender,
  CASE WHEN told THEN strftime(tm + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S') || CASE WHEN turn % 2 = 1 THEN '.500Z' ELSE 'Z' END END AS told_reply_due_at, CASE WHEN told THEN '3600' END AS told_reply_slo_seconds,
  'discord:thread:' || conv_id || '-' || CASE WHEN turn > 0 THEN 0 ELSE turn END AS thread FROM gated"""


def corpus_projection(spark, d):
    drafts = messages.discord(_messages(spark, d))
    rows = drafts.withColumns({"id": F.col("subject"), "published_nanos": F.lit(None).cast("long")})
    return C.corpus(rows).select("record_id", "source_type", "anchor_url", "source_title", "source_location", "timestamp", "text", "thread_ts", "container")


CORPUS_PROJECTION_SQL = """
SELECT 'message:discord:ch' || conv_id || ':' || conv_id || '-' || turn AS record_id, 'discord' AS source_type, 'discord://ch' || conv_id || '/message/' || conv_id || '-' || turn AS anchor_url, 'room ' || conv_id AS source_title, role AS source_location,
  make_timestamp((1700000000 + 60 * turn) * 1000000) AS timestamp, text, 'discord:thread:' || conv_id || '-' || CASE WHEN turn > 0 THEN 0 ELSE turn END AS thread_ts, 'ch' || conv_id AS container FROM conversations WHERE trim(text) <> ''
"""


def undeclared_fields(spark, d):
    """Orders as payloads, with fields at several depths that their schema does not declare in some."""
    o = read(spark, d, "orders")
    extra = lambda cond: F.when(F.expr(cond), 1)
    payload = F.to_json(F.struct("o_orderkey", extra("o_orderstatus = 'F'").alias("x"), F.struct(F.lit(1).alias("a"), extra("o_custkey % 2 = 0").alias("b")).alias("part"), F.array(F.struct(extra("o_custkey % 3 = 0").alias("c"), F.lit(2).alias("d"), extra("o_custkey % 5 = 0").alias("e"))).alias("list")))
    counted = ingest.undeclared({"schema:order": {"properties": {"o_orderkey": {}, "part": {"properties": {"a": {}}}, "list": {"items": {"properties": {"d": {}}}}}}})
    return o.select("o_orderkey", counted(F.lit("schema:order"), payload).alias("undeclared"))


# ---- streaming


def stream_latest_consent(spark, d):
    """The latest status of each user, folded over a stream of the events' files."""
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder = new_path(spark, "stream")
    view = views.KeyedView(spark, f"{folder}/view", "user_id", "event_type", ["ts", "event_id"])
    source = spark.read.parquet(path).select(*schema.names).repartitionByRange(4, "user_id")
    source.write.parquet(f"{folder}/in")  # several files, so that there are several micro-batches
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    views.run_available(stream, view.fold, f"{folder}/checkpoint").awaitTermination()
    return view.current().select("user_id", "event_type")


QUERIES = {
    "claim_states": (claim_states, CLAIM_SQL),
    "card_states": (card_states, CARD_SQL),
    "claim_history": (claim_history, CLAIM_HISTORY_SQL),
    "card_audit": (card_audit, CARD_AUDIT_SQL),
    "claim_dedup": (claim_dedup, "SELECT min(doc_id) AS claim_id, sha256(text) AS payload_hash, count(*) - 1 AS absorbed FROM documents GROUP BY lang, text"),
    "claim_groups": (claim_groups, """SELECT sha256(CASE WHEN source < 'lake' THEN '["' || source || '","lake"]' ELSE '["lake","' || source || '"]' END) AS group_id, count(*) AS claims, min(doc_id) AS first_claim FROM documents GROUP BY source"""),
    "identity_components": (identity_components, IDENTITY_SQL),
    "name_pairs": (name_pairs, NAME_SQL),
    "ownership": (ownership, OWNER_SQL),
    "best_profiles": (
        best_profiles,
        "SELECT source AS person, CAST(r AS INT) AS richness, doc_id AS document_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY r DESC, doc_id DESC) AS n FROM (SELECT source, doc_id, CASE WHEN n_chars > 2000 THEN 12 ELSE 0 END + CASE WHEN lang = 'en' THEN 10 ELSE 0 END AS r FROM documents)) WHERE n = 1",
    ),
    "supersedes_chain": (supersedes_chain, SUPERSEDES_SQL),
    "source_roots": (source_roots, ROOTS_SQL),
    "session_tree": (session_tree, "SELECT conv_id || '-' || turn AS session, conv_id || '-0' AS root, turn AS depth FROM conversations"),
    "ingest_gate": (ingest_gate, GATE_SQL),
    "corpus_projection": (corpus_projection, CORPUS_PROJECTION_SQL),
    "undeclared_fields": (undeclared_fields, "SELECT o_orderkey, CAST(o_orderstatus = 'F' AS BIGINT) + CAST(o_custkey % 2 = 0 AS BIGINT) + CAST(o_custkey % 3 = 0 AS BIGINT) + CAST(o_custkey % 5 = 0 AS BIGINT) AS undeclared FROM orders"),
    "stream_latest_consent": (stream_latest_consent, "SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"),
}
