"""Append, privacy, policy and projection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import activity, append, lake, paging, privacy
from millrace.plans.tables import NOW, minute, read
from millrace.shared import new_path


def idempotent_append(spark, d):
    """Events by a key of user, type and day; their content is the sign of their value."""
    e = read(spark, d, "events")
    rows = e.select(F.col("event_id").alias("seq"), F.concat_ws("|", "user_id", "event_type", F.to_date("ts")).alias("idempotency_key"), F.when(F.col("value") > 10, "high").otherwise("low").alias("canonical"))
    return append.classify_append(rows).select("seq", "idempotency_key", "outcome")


APPEND_SQL = """
WITH r AS (SELECT event_id AS seq, user_id || '|' || event_type || '|' || strftime(ts, '%Y-%m-%d') AS idempotency_key, CASE WHEN value > 10 THEN 'high' ELSE 'low' END AS c FROM events),
f AS (SELECT *, first_value(c) OVER w AS fc, row_number() OVER w AS n FROM r WINDOW w AS (PARTITION BY idempotency_key ORDER BY seq))
SELECT seq, idempotency_key, CASE WHEN n = 1 THEN 'appended' WHEN c = fc THEN 'duplicate' ELSE 'conflict' END AS outcome FROM f
"""


def append_to_lake(spark, d):
    """Documents of all languages against a lake of the English ones."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.concat_ws("|", "source", "n_chars").alias("idempotency_key"), F.sha2(F.col("text").cast("binary"), 256).alias("canonical"), "lang")
    lake = docs.where("lang = 'en'").groupBy("idempotency_key").agg(F.min("canonical").alias("canonical"))
    return append.classify_append(docs, lake).select("seq", "outcome")


LAKE_SQL = """
WITH d AS (SELECT doc_id AS seq, source || '|' || n_chars AS k, sha256(text) AS c, lang FROM documents),
lake AS (SELECT k, min(c) AS c FROM d WHERE lang = 'en' GROUP BY k),
f AS (SELECT d.*, l.c AS known, first_value(d.c) OVER w AS fc, row_number() OVER w AS n FROM d LEFT JOIN lake l USING (k) WINDOW w AS (PARTITION BY d.k ORDER BY d.seq))
SELECT seq, CASE WHEN known IS NULL AND n = 1 THEN 'appended' WHEN c = coalesce(known, fc) THEN 'duplicate' ELSE 'conflict' END AS outcome FROM f
"""


def stream_append(spark, d):
    """Events as requests: the expected version is the number of the user's earlier events, and stale for errors."""
    from pyspark.sql import Window

    e = read(spark, d, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    late = F.sum((F.col("event_type") == "error").cast("int")).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    requests = e.select(F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"), F.col("user_id").alias("stream_id"), F.when(F.col("event_type") == "error", F.lit(0)).otherwise(n - late).cast("int").alias("expected_version"), F.col("event_id").cast("string").alias("idempotency_key"))
    return append.stream_append(requests)


STREAM_APPEND_SQL = """
WITH RECURSIVE r AS (SELECT row_number() OVER w AS seq, user_id AS stream_id, CAST(event_id AS VARCHAR) AS idempotency_key,
  CASE WHEN event_type = 'error' THEN 0 ELSE row_number() OVER w - 1 - sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) END AS expected FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT stream_id, CAST(0 AS BIGINT) AS seq, CAST(0 AS HUGEINT) AS version, false AS taken FROM (SELECT DISTINCT stream_id FROM r)
  UNION ALL SELECT f.stream_id, r.seq, CASE WHEN r.expected = f.version THEN f.version + 1 ELSE f.version END, r.expected = f.version FROM f JOIN r ON r.stream_id = f.stream_id AND r.seq = f.seq + 1)
SELECT CAST(r.seq AS INT) AS seq, r.stream_id, CAST(r.expected AS BIGINT) AS expected_version, r.idempotency_key, CASE WHEN f.taken THEN 'appended' ELSE 'version_conflict' END AS outcome FROM r JOIN f USING (stream_id, seq)
"""


def record_versions(spark, d):
    e = read(spark, d, "events")
    rows = e.select(F.concat_ws("|", "user_id", "event_type").alias("id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "signup", "append_only").otherwise("managed_cache").alias("mutability"))
    return append.record_versions(rows).select("id", "seq", "version", "accepted", "is_current")


VERSIONS_SQL = """
WITH r AS (SELECT user_id || '|' || event_type AS id, event_id AS seq, event_type <> 'signup' AS managed FROM events),
v AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS version FROM r),
a AS (SELECT *, version = 1 OR managed AS accepted FROM v)
SELECT id, seq, CAST(version AS INT) AS version, accepted, row_number() OVER (PARTITION BY id ORDER BY accepted DESC, seq DESC) = 1 AS is_current FROM a
"""


def projection_delta(spark, d):
    """Customers as items; suppliers rename some, and customers in debt are deleted."""
    c, s = read(spark, d, "customer"), read(spark, d, "supplier")
    items = c.select(F.col("c_custkey").alias("item_key"), F.col("c_name").alias("value"))
    gone = c.where("c_acctbal < 0").select(F.col("c_custkey").alias("item_key"), F.lit(None).cast("string").alias("value"), F.lit("delete").alias("op"))
    changed = s.select(F.col("s_suppkey").alias("item_key"), F.col("s_name").alias("value"), F.lit("update").alias("op")).join(gone.select("item_key"), "item_key", "left_anti")
    present = changed.join(items.select("item_key"), "item_key", "left_semi")
    new = changed.join(items.select("item_key"), "item_key", "left_anti").withColumn("op", F.lit("insert"))
    return append.apply_delta(items, present.unionByName(new).unionByName(gone))


DELTA_SQL = """
WITH gone AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0)
SELECT coalesce(c_custkey, s_suppkey) AS item_key, coalesce(s_name, c_name) AS value FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey
WHERE coalesce(c_custkey, s_suppkey) NOT IN (SELECT k FROM gone)
"""


def identity_bridge(spark, d):
    docs = read(spark, d, "documents")
    rows = docs.select(F.concat_ws("|", "source", "lang").alias("v2_key"), F.col("doc_id").alias("append_seq"), F.col("doc_id").cast("string").alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("canonical"))
    return append.identity_bridge(rows)


BRIDGE_SQL = "SELECT source || '|' || lang AS v2_key, CAST(min(doc_id) AS VARCHAR) AS winner, count(*) AS multiplicity, count(DISTINCT text) > 1 AS collision FROM documents GROUP BY 1"


def blob_store(spark, d):
    return append.blob_refs(read(spark, d, "documents").select(F.col("text").cast("binary").alias("data"))).select("blob_ref", F.length("data").cast("long").alias("bytes"))


def orphan_blobs(spark, d):
    """Blobs of documents that no labelled document refers to."""
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    ref = F.concat(F.lit("blob:sha256:"), F.sha2(F.col("text").cast("binary"), 256)).alias("blob_ref")
    return append.orphans(docs.select(ref).distinct(), docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi").select(ref))


def retention(spark, d):
    return append.retained(read(spark, d, "events"), "ts", NOW, 10).select("event_id", "ts")


# ---- privacy


def _decisions(spark, d):
    e = read(spark, d, "events")
    return e.select(
        F.concat(F.lit("user:"), "user_id").alias("subject"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("mail:"), F.col("user_id") % 40)).alias("identifier"), F.when(F.col("event_type") == "error", "opted_out").otherwise("unrestricted").alias("status"),
        F.date_trunc("day", "ts").alias("published"), F.col("ts").alias("recorded_at"), F.col("event_id").cast("string").alias("id"),
    )


def latest_consent(spark, d):
    return privacy.latest_decisions(_decisions(spark, d), "subject")


LATEST_SQL = "SELECT 'user:' || user_id AS subject, CASE WHEN event_type = 'error' THEN 'opted_out' ELSE 'unrestricted' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts) DESC, ts DESC, CAST(event_id AS VARCHAR) DESC) AS n FROM events) WHERE n = 1"


def consent_visible(spark, d):
    """Orders of customers (as users, with a mail address of several) that neither the newest consent about either nor a retraction hides; toxic labels retract by id, open orders by object."""
    mail = F.concat(F.lit("mail:"), F.col("o_custkey") % 97)
    orders = read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.concat_ws("-", "o_custkey", "o_orderstatus").alias("object_id"), F.concat(F.lit("user:"), "o_custkey").alias("subject"), F.array(mail).alias("keys"))
    labels, customers = read(spark, d, "labels"), read(spark, d, "customer")
    gone = labels.where("toxic = 1").select(F.col("doc_id").cast("string").alias("observation_id"), F.lit(None).cast("string").alias("source_object_id"))
    by_object = customers.where("c_acctbal < 0").select(F.lit(None).cast("string").alias("observation_id"), F.concat(F.col("c_custkey").cast("string"), F.lit("-O")).alias("source_object_id"))
    return privacy.visible(orders, _decisions(spark, d), gone.unionByName(by_object)).select("id", "object_id")


VISIBLE_SQL = """
WITH dec AS (SELECT 'user:' || user_id AS s, CASE WHEN event_id % 3 = 0 THEN 'mail:' || user_id % 40 END AS i, event_type = 'error' AS out, date_trunc('day', ts) AS p, ts, CAST(event_id AS VARCHAR) AS e FROM events),
about AS (SELECT s AS k, out, p, ts, e FROM dec UNION ALL SELECT i, out, p, ts, e FROM dec WHERE i IS NOT NULL),
latest AS (SELECT k, out, p, ts, e FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p DESC, ts DESC, e DESC) AS n FROM about) WHERE n = 1),
o AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_custkey || '-' || o_orderstatus AS object_id, ['user:' || o_custkey, 'mail:' || o_custkey % 97] AS ks FROM orders),
best AS (SELECT id, out FROM (SELECT o.id, l.out, row_number() OVER (PARTITION BY o.id ORDER BY p DESC, ts DESC, e DESC) AS n FROM (SELECT id, unnest(ks) AS k FROM o) o JOIN latest l USING (k)) WHERE n = 1)
SELECT id, object_id FROM o WHERE id NOT IN (SELECT id FROM best WHERE out)
AND id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1) AND object_id NOT IN (SELECT c_custkey || '-O' FROM customer WHERE c_acctbal < 0)
"""


def mask_by_scope(spark, d):
    c = read(spark, d, "customer")
    return c.select(
        "c_custkey",
        privacy.mask_column(F.col("c_name"), "internal", "internal", "redact").alias("name"),
        privacy.mask_column(F.col("c_mktsegment"), "restricted", "internal", "redact").alias("segment"),
        privacy.mask_column(F.col("c_name"), "highly_sensitive", "internal", "hash").alias("name_hash"),
        privacy.mask_column(F.col("c_mktsegment"), "restricted", "public", "exclude").alias("excluded"),
    )


MASK_SQL = """SELECT c_custkey, c_name AS name, '[REDACTED]' AS segment, sha256('"' || c_name || '"') AS name_hash, CAST(NULL AS VARCHAR) AS excluded FROM customer"""


def mask_payload(spark, d):
    masked = privacy.mask_payload("public", [("k", "restricted", "hash"), ("absent.k", "restricted", "redact")])
    return read(spark, d, "events").select("event_id", masked("props").alias("props"))


MASK_PAYLOAD_SQL = """SELECT event_id, '{"k":"' || sha256(json_extract_string(props, '$.k')) || '"}' AS props FROM events"""


def policy_decisions(spark, d):
    c = read(spark, d, "customer")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    out = privacy.policy_decision(
        pick(["system_admin", "researcher", "resident", "external", "agent"], key), pick(["read", "write_canonical", "export", "publish"], nation), pick(["unrestricted", "restricted_capture", "opted_out"], key + nation),
        pick(["internal", "restricted", "highly_sensitive"], F.floor(key / 5)), pick(["lake", "export"], F.floor(key / 15)), pick(["lake_authoritative", "dual_reference"], F.floor(key / 30)),
    )
    return c.select("c_custkey", out["decision"].alias("decision"), out["reason"].alias("reason"))


POLICY_SQL = """
WITH p AS (SELECT c_custkey, (['system_admin', 'researcher', 'resident', 'external', 'agent'])[c_custkey % 5 + 1] AS role, (['read', 'write_canonical', 'export', 'publish'])[c_nationkey % 4 + 1] AS op,
  (['unrestricted', 'restricted_capture', 'opted_out'])[(c_custkey + c_nationkey) % 3 + 1] AS consent, (['internal', 'restricted', 'highly_sensitive'])[(c_custkey // 5) % 3 + 1] AS scope,
  (['lake', 'export'])[(c_custkey // 15) % 2 + 1] AS env, (['lake_authoritative', 'dual_reference'])[(c_custkey // 30) % 2 + 1] AS authority FROM customer),
t AS (SELECT *, role = 'system_admin' OR role = 'researcher' AND op = 'read' AS able,
  array_to_string(list_filter([CASE WHEN op = 'export' AND scope = 'highly_sensitive' THEN 'high_sensitivity_export' END, CASE WHEN op = 'write_canonical' AND authority = 'dual_reference' THEN 'dual_reference_canonical_write' END,
  CASE WHEN env = 'export' AND scope = 'restricted' THEN 'restricted_data_export' END, CASE WHEN op = 'publish' THEN 'publication_review' END], lambda x: x IS NOT NULL), ', ') AS triggers FROM p)
SELECT c_custkey, CASE WHEN consent = 'opted_out' OR NOT able THEN 'deny' WHEN triggers <> '' THEN 'require_review' ELSE 'allow' END AS decision,
  CASE WHEN consent = 'opted_out' THEN 'consent_opted_out' WHEN NOT able THEN 'insufficient_capability' ELSE triggers END AS reason FROM t
"""

# ---- projections


def late(time, number):
    """A time that is up to a second later, by a number: times have fractions, in the events that lie behind a limit too."""
    return F.timestamp_micros(F.unix_micros(time.cast("timestamp")) + F.pmod(F.col(number) * 377_717, F.lit(1_000_000)))


LATE_SQL = "make_timestamp(epoch_us({}) + {} * 377717 % 1000000)"


def freshness(spark, d):
    """Events by type and part of a day as sources, whose limits are the whole seconds that their ages come close to."""
    e = read(spark, d, "events")
    at = late(F.col("ts"), "event_id")
    seen = e.select(F.concat_ws(":", "event_type", F.hour("ts")).alias("source"), at.alias("published"), at.alias("recorded_at"))
    limits = seen.groupBy("source").agg(F.max(F.unix_micros("published")).alias("m")).select("source", (F.ceil((F.lit(1_706_659_200_250_000) - F.col("m")) / 1_000_000) - F.length("source") % 2).alias("max_age_seconds"))
    limits = limits.unionByName(spark.createDataFrame([("nothing", 60)], "source string, max_age_seconds long"))
    return activity.freshness(seen, limits, "2024-01-31 00:00:00.25").select("source", "last_at", "age_seconds", "status")


FRESH_SQL = f"""
WITH seen AS (SELECT event_type || ':' || hour(ts) AS source, max({LATE_SQL.format('ts', 'event_id')}) AS last_at FROM events GROUP BY 1),
limits AS (SELECT source, CAST(ceil((1706659200250000 - epoch_us(last_at)) / 1000000) AS BIGINT) - length(source) % 2 AS most FROM seen UNION ALL SELECT 'nothing', 60),
r AS (SELECT l.source, s.last_at, l.most, (1706659200250000 - epoch_us(s.last_at)) // 1000000 AS age_seconds FROM limits l LEFT JOIN seen s USING (source))
SELECT source, last_at, age_seconds, CASE WHEN last_at IS NULL THEN 'unobserved' WHEN age_seconds > most THEN 'missing' ELSE 'fresh' END AS status FROM r
"""


def heartbeat_gaps(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("source"), F.col("ts").alias("received_at"))
    return activity.heartbeat_gaps(e, 86_400)


GAPS_SQL = "SELECT user_id AS source, prev AS gap_start, ts AS gap_end, epoch_us(ts) - epoch_us(prev) AS gap_micros FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events) WHERE epoch_us(ts) - epoch_us(prev) > 86400000000"


def session_summary(spark, d):
    t = read(spark, d, "conversations")
    rows = t.select(F.col("conv_id").alias("session_ref"), minute("turn").alias("published_at"), F.col("role").alias("surface"), F.substring("role", 1, 1).alias("channel"))
    s = activity.sessions(rows)
    return s.select("session_ref", "entries", "first_at", "last_at", F.array_join("surfaces", ",").alias("surfaces"), F.array_join("channels", ",").alias("channels"))


SESSION_SQL = "SELECT conv_id AS session_ref, count(*) AS entries, make_timestamp((1700000000 + 60 * min(turn)) * 1000000) AS first_at, make_timestamp((1700000000 + 60 * max(turn)) * 1000000) AS last_at, string_agg(DISTINCT role, ',' ORDER BY role) AS surfaces, string_agg(DISTINCT substr(role, 1, 1), ',' ORDER BY substr(role, 1, 1)) AS channels FROM conversations GROUP BY conv_id"


def _entries(spark, d):
    e = read(spark, d, "events")
    return e.select(
        F.col("event_id").alias("cursor"), F.col("event_id").cast("string").alias("event_id"), F.col("ts").alias("published_at"), F.lit(0).alias("ordinal"), F.when(F.col("event_type") == "purchase", "commitment").when(F.col("event_type") == "view", "current_state").otherwise("message").alias("record_kind"),
        F.col("user_id").cast("string").alias("record_key"), F.when(F.col("value") > 10, "open").otherwise("closed").alias("record_status"), F.col("props").alias("text"),
    )


def open_commitments(spark, d):
    return activity.open_commitments(_entries(spark, d))


COMMIT_SQL = "SELECT CAST(user_id AS VARCHAR) AS record_key, props AS text, ts AS published_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'purchase') WHERE n = 1 AND value > 10"


def current_state(spark, d):
    return activity.current_state(_entries(spark, d))


STATE_SQL = "SELECT CAST(user_id AS VARCHAR) AS record_key, props AS text, CAST(strlen(props) AS INT) AS bytes, sha256(props) AS sha256 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'view') WHERE n = 1"


def person_activity(spark, d):
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    messages = o.select(F.col("o_custkey").alias("person_id"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("channel"))
    edits = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("person_id"), F.col("l_shipdate").alias("at"))
    return activity.person_activity(messages, edits).withColumn("channels", F.array_join("channels", ","))


PERSON_SQL = """
WITH b AS (SELECT o_custkey AS p, o_orderdate AS tm, o_orderpriority AS c, 1 AS m, 0 AS e FROM orders UNION ALL SELECT o_custkey, l_shipdate, NULL, 0, 1 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT p AS person_id, CAST(sum(m) AS BIGINT) AS messages, CAST(sum(e) AS BIGINT) AS edits, min(tm) AS first_at, max(tm) AS last_at, string_agg(DISTINCT c, ',' ORDER BY c) AS channels FROM b GROUP BY p
"""


def reply_latencies(o, li):
    """Latencies of orders that lines answer."""
    incoming = o.select(F.col("o_orderkey").alias("observation_id"), F.col("o_orderdate").alias("published"), F.expr("o_orderdate + interval 900 days").alias("due_at"))
    drafts = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("draft_id"), F.col("l_orderkey").alias("observation_id")).distinct()
    sends = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("draft_id"), F.col("l_shipdate").alias("sent_at"))
    return activity.reply_latency(incoming, drafts, sends, NOW).select("observation_id", "sent_at", "latency_seconds", "status")


def reply_latency(spark, d):
    """Orders and the lines that answer them, both at fractions of a second."""
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    return reply_latencies(o.withColumn("o_orderdate", late(F.col("o_orderdate"), "o_orderkey")), li.withColumn("l_shipdate", late(F.col("l_shipdate"), "l_partkey")))


REPLY_SQL = f"""
WITH s AS (SELECT l_orderkey AS k, min({LATE_SQL.format('l_shipdate', 'l_partkey')}) AS sent_at FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey, {LATE_SQL.format('o_orderdate', 'o_orderkey')} AS published, {LATE_SQL.format('o_orderdate', 'o_orderkey')} + INTERVAL 900 DAY AS due FROM orders)
SELECT o_orderkey AS observation_id, sent_at, CAST(trunc((epoch_us(sent_at) - epoch_us(published)) / 1000000) AS BIGINT) AS latency_seconds,
  CASE WHEN sent_at <= due THEN 'sent_on_time' WHEN sent_at IS NOT NULL THEN 'sent_late' WHEN TIMESTAMP '{NOW}' > due THEN 'overdue' ELSE 'pending' END AS status FROM o LEFT JOIN s ON o_orderkey = k
"""


def _supplementals(e, kind):
    return e.select(F.col("user_id").alias("project"), kind.alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 4 > 0, F.col("props")).alias("text"), F.when(F.col("value") > 10, "open").otherwise("verified").alias("state"))


def resume_cards(spark, d):
    """Users as projects: last activity, latest summary that is there, and how many parkings and open claims."""
    e = read(spark, d, "events")
    kind = F.when(F.col("event_type") == "signup", "parking@1").when(F.col("event_type") == "click", "claim@1").when(F.col("event_type") == "view", "session-summary@1").otherwise("other")
    return activity.resume(_supplementals(e, kind))


RESUME_SQL = """
SELECT user_id AS project, max(ts) AS last_activity, arg_max(props, (ts, event_id)) FILTER (event_type = 'view' AND event_id % 4 > 0) AS summary, count(*) FILTER (event_type = 'signup') AS parkings, min(ts) FILTER (event_type = 'signup') AS oldest_parking,
  count(*) FILTER (event_type = 'click' AND value > 10) AS open_claims, min(ts) FILTER (event_type = 'click' AND value > 10) AS oldest_claim FROM events GROUP BY user_id
"""


def resume_items(spark, d):
    e = read(spark, d, "events")
    kind = F.when(F.col("event_type") == "signup", "parking@1").when(F.col("event_type") == "click", "claim@1").otherwise("other")
    return activity.resume_items(_supplementals(e, kind)).select("project", "item", "id")


def plan_state(spark, d):
    """Users as projects: parkings are signups, open claims clicks, summaries views; current decisions are purchases."""
    e = read(spark, d, "events")
    kind = F.when(F.col("event_type") == "signup", "parking@1").when(F.col("event_type") == "click", "claim@1").when(F.col("event_type") == "view", "session-summary@1").otherwise("other")
    resumes = activity.resume(_supplementals(e, kind))
    decisions = e.where("event_type = 'purchase'").select(F.col("user_id").alias("project"), (F.col("value") > 10).alias("is_current"), F.col("ts").alias("created_at"))
    return activity.plan_state(resumes, decisions, NOW)


PLAN_SQL = f"""
SELECT user_id AS project, count(*) FILTER (event_type = 'click' AND value > 10) AS open_claims, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(min(ts) FILTER (event_type = 'click' AND value > 10))) // 1000000 AS oldest_claim_seconds,
  count(*) FILTER (event_type = 'signup') AS parkings, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(min(ts) FILTER (event_type = 'signup'))) // 1000000 AS oldest_parking_seconds,
  count(*) FILTER (event_type = 'purchase' AND value > 10) AS decisions, max(ts) FILTER (event_type = 'purchase' AND value > 10) AS last_decision FROM events GROUP BY user_id
"""

def privacy_key_page(spark, d):
    """A page of one key's order lines, from an index of lines by the keys of their parts and suppliers."""
    li = read(spark, d, "lineitem")
    rows = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("append_seq"), F.array(F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey")).alias("keys"))
    path = new_path(spark, "reverse-index")
    lake.write_reverse_index(rows, path)
    return lake.key_page(spark, path, "s7", 1_000, 50)


def audit_page(spark, d):
    """The audit's events after a (time, id)."""
    e = read(spark, d, "events").select("event_id", "ts", "event_type")
    return paging.keyset_page(e, [("ts", False), ("event_id", False)], 50, ["2024-01-10 00:00:00", 300])


def import_sessions(spark, d):
    """Sessions of an import with the manifest of their source; sources that are not listed have none."""
    t = read(spark, d, "conversations").select(F.col("role").alias("source"), F.col("conv_id").alias("session"), minute("turn").alias("published_at"))
    sources = read(spark, d, "region").where("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, "user").otherwise("system").alias("source"), F.col("r_name").alias("manifest"))
    return lake.session_index(t, sources)


def routing_keys(spark, d):
    """Order lines at fractions of a second by the axes of their routing key."""
    li = read(spark, d, "lineitem")
    at = late(F.col("l_shipdate"), "l_partkey")
    rows = li.select("l_orderkey", "l_linenumber", at.alias("published"), F.concat(F.lit("sys:"), "l_linestatus").alias("source_system"), F.when(F.col("l_linenumber") > 1, F.col("l_returnflag")).alias("source_container"), F.when(F.col("l_linenumber") % 2 == 0, F.unix_micros(at) * 1000 + F.col("l_suppkey")).alias("published_nanos"))
    return lake.routing_key(rows).drop("published", "published_nanos", "source_system", "source_container")


ROUTING_SQL = f"""
WITH r AS (SELECT *, {LATE_SQL.format('l_shipdate', 'l_partkey')} AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, strftime(t, '%m') AS coarse_month, strftime(t, '%Y') AS coarse_year, 'sys:' || l_linestatus AS source, CASE WHEN l_linenumber > 1 THEN l_returnflag ELSE '' END AS container,
  strftime(t, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(t) % 1000000 * 1000 + CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey ELSE 0 END AS VARCHAR), 9, '0') || 'Z' AS fine_published FROM r
"""

QUERIES = {
    "privacy_key_page": (privacy_key_page, "SELECT DISTINCT 's7' AS key, l_orderkey * 10 + l_linenumber AS position FROM lineitem WHERE l_suppkey = 7 AND l_orderkey * 10 + l_linenumber > 1000 ORDER BY position LIMIT 50"),
    "audit_page": (audit_page, "SELECT event_id, ts, event_type FROM events WHERE (ts, event_id) > (TIMESTAMP '2024-01-10', 300) ORDER BY ts, event_id LIMIT 50"),
    "import_sessions": (import_sessions, "SELECT role AS source, conv_id AS session, make_timestamp((1700000000 + 60 * min(turn)) * 1000000) AS first_at, make_timestamp((1700000000 + 60 * max(turn)) * 1000000) AS last_at, count(*) AS entries, any_value(r_name) AS manifest FROM conversations JOIN region ON role = CASE r_regionkey WHEN 0 THEN 'user' ELSE 'system' END AND r_regionkey < 2 GROUP BY role, conv_id"),
    "routing_keys": (routing_keys, ROUTING_SQL),
    "idempotent_append": (idempotent_append, APPEND_SQL),
    "append_to_lake": (append_to_lake, LAKE_SQL),
    "stream_append": (stream_append, STREAM_APPEND_SQL),
    "record_versions": (record_versions, VERSIONS_SQL),
    "projection_delta": (projection_delta, DELTA_SQL),
    "identity_bridge": (identity_bridge, BRIDGE_SQL),
    "blob_store": (blob_store, "SELECT DISTINCT 'blob:sha256:' || sha256(text) AS blob_ref, CAST(strlen(text) AS BIGINT) AS bytes FROM documents"),
    "orphan_blobs": (orphan_blobs, "SELECT DISTINCT 'blob:sha256:' || sha256(text) AS blob_ref FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))"),
    "retention": (retention, f"SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY"),
    "latest_consent": (latest_consent, LATEST_SQL),
    "consent_visible": (consent_visible, VISIBLE_SQL),
    "mask_by_scope": (mask_by_scope, MASK_SQL),
    "mask_payload": (mask_payload, MASK_PAYLOAD_SQL),
    "policy_decisions": (policy_decisions, POLICY_SQL),
    "freshness": (freshness, FRESH_SQL),
    "heartbeat_gaps": (heartbeat_gaps, GAPS_SQL),
    "session_summary": (session_summary, SESSION_SQL),
    "open_commitments": (open_commitments, COMMIT_SQL),
    "current_state": (current_state, STATE_SQL),
    "person_activity": (person_activity, PERSON_SQL),
    "reply_latency": (reply_latency, REPLY_SQL),
    "plan_state": (plan_state, PLAN_SQL),
    "resume_cards": (resume_cards, RESUME_SQL),
    "resume_items": (resume_items, "SELECT user_id AS project, CASE WHEN event_type = 'signup' THEN 'parking' ELSE 'open_claim' END AS item, event_id AS id FROM events WHERE event_type = 'signup' OR event_type = 'click' AND value > 10"),
}
