"""Pages of the lake, positions, reverse keys, queues, imports, checks and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import keys as K
from millrace.operators import activity, append, graph, lake, paging, states
from millrace.operators import corpus as C
from millrace.plans.lake_queries import BRIDGE_SQL, REPLY_SQL, SESSION_SQL, late, reply_latencies, reply_latency
from millrace.plans.state_queries import CARD_SQL
from millrace.plans.tables import NOW, corpus, minute, read
from millrace.shared import new_path
from millrace.streaming import folds, journal, people, views


def observation_page(spark, d):
    """The rows of one partition after a position."""
    clicks = read(spark, d, "events").where("event_type = 'click'").select("event_id", "user_id")
    return paging.keyset_page(clicks, [("event_id", False)], 50, [100])


def export_page(spark, d):
    """A page between a cursor and the position that the export pinned."""
    return paging.budgeted_rows(read(spark, d, "events").select("event_id", "event_type"), "event_id", 100, 900, 50)


def items_page(spark, d):
    c = read(spark, d, "customer").select(F.col("c_mktsegment").alias("owner_key"), F.col("c_name").alias("sort_key"), F.col("c_custkey").alias("item_key"))
    return paging.prefix_page(c, ["BUILDING", "MACHINERY"], "C", 50)


def items_by_owner(spark, d):
    return lake.items_by_owner(read(spark, d, "customer").select(F.col("c_mktsegment").alias("owner_key")))


def event_stats(spark, d):
    return lake.stats(read(spark, d, "events"), "event_id")


def stream_heads(spark, d):
    """Customers as streams, of which some have no event."""
    streams = read(spark, d, "customer").select(F.col("c_custkey").alias("stream_id"))
    return lake.positions(streams, read(spark, d, "events").select(F.col("user_id").alias("stream_id"), "event_id"), "stream_id", "event_id")


def watermark_commits(spark, d):
    """Positions that lines commit after those of orders; none goes back."""
    o = read(spark, d, "orders").select(F.lit("orders").alias("projection"), F.col("o_orderstatus").alias("leaf"), F.col("o_orderkey").alias("position"))
    li = read(spark, d, "lineitem").select(F.lit("orders").alias("projection"), F.col("l_linestatus").alias("leaf"), F.col("l_orderkey").alias("position"))
    return views.advanced(o, li)


def privacy_key_rows(spark, d):
    """Orders of which the customer's or the clerk's key belongs to a supplier in debt."""
    o = read(spark, d, "orders").select("o_orderkey", F.array("o_custkey", F.col("o_orderkey") % 1000).alias("keys"))
    wanted = read(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("key"))
    return lake.with_privacy_keys(o, wanted, "o_orderkey").select("o_orderkey")


def missing_anchors(spark, d):
    """Labels of documents that do not have five words or more."""
    docs = read(spark, d, "documents").where(F.size(F.split("text", " ")) >= 5)
    return lake.missing_anchors(read(spark, d, "labels").select("doc_id", "toxic"), docs, "doc_id")


def bridge_readiness(spark, d):
    docs = read(spark, d, "documents")
    candidates = docs.select(F.concat_ws("|", "source", "n_chars").alias("v2_key"), F.sha2(F.col("text").cast("binary"), 256).alias("canonical"))
    gaps = read(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("append_seq"))
    return lake.readiness(candidates, gaps, 150, 120).withColumn("blockers", F.array_join("blockers", ", "))


READINESS_SQL = """
WITH k AS (SELECT source || '|' || n_chars AS k, count(*) AS n, count(DISTINCT text) AS t FROM documents GROUP BY 1), g AS (SELECT count(*) AS n FROM labels WHERE toxic = 1 AND doc_id <= 150),
s AS (SELECT CAST(sum(n) AS BIGINT) AS candidates, count(*) FILTER (n > 1) AS shared_keys, count(*) FILTER (t > 1) AS collisions, (SELECT n FROM g) AS gaps FROM k)
SELECT *, CAST(30 AS BIGINT) AS lag, concat_ws(', ', 'bridge is behind the fence', CASE WHEN gaps > 0 THEN 'open gaps' END, CASE WHEN collisions > 0 THEN 'collisions' END) AS blockers FROM s
"""


def import_outcomes(spark, d):
    docs = read(spark, d, "documents")
    rows = docs.select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("identity"), F.col("lang").alias("digest"), F.when(F.col("n_chars") >= 100, F.col("source")).alias("owner"))
    return lake.import_outcomes(rows).select("doc_id", "outcome")


IMPORT_SQL = """
WITH e AS (SELECT text, min(lang) <> max(lang) AS differ, min(source) <> max(source) AS many FROM documents GROUP BY text)
SELECT doc_id, CASE WHEN differ THEN 'digest_conflict' WHEN n_chars < 100 THEN 'unresolved_owner' WHEN many THEN 'source_overlap' ELSE 'importable' END AS outcome FROM documents JOIN e USING (text)
"""


def session_index(spark, d):
    t = read(spark, d, "conversations")
    return lake.session_index(t.select(F.col("role").alias("source"), F.col("conv_id").alias("session"), minute("turn").alias("published_at")))


SESSION_INDEX_SQL = "SELECT role AS source, conv_id AS session, make_timestamp((1700000000 + 60 * min(turn)) * 1000000) AS first_at, make_timestamp((1700000000 + 60 * max(turn)) * 1000000) AS last_at, count(*) AS entries FROM conversations GROUP BY role, conv_id"


def break_glass_channels(spark, d):
    """Nations as channels, their suppliers as senders."""
    s = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("id")).agg(F.collect_set("s_name").alias("break_glass_senders"), (F.min("s_acctbal") < 0).alias("break_glass_channel"))
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_regionkey") != 2).alias("enabled"))
    return lake.break_glass(s.join(n, "id")).withColumn("senders", F.array_join("senders", ","))


GLASS_SQL = "SELECT s_nationkey AS id, string_agg(DISTINCT s_name, ',' ORDER BY s_name) AS senders FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 2 GROUP BY s_nationkey HAVING min(s_acctbal) < 0"


def health_rollup(spark, d):
    status = F.when(F.col("s_acctbal") < -5000, "unhealthy").when(F.col("s_acctbal") < 0, "degraded").otherwise("ok")
    return activity.health(read(spark, d, "supplier").select(status.alias("status")))


HEALTH_SQL = "SELECT CASE WHEN min(s_acctbal) < -5000 THEN 'unhealthy' WHEN min(s_acctbal) < 0 THEN 'degraded' ELSE 'ok' END AS status FROM supplier"


def poll_queue(spark, d):
    """Orders as threads: open ones are active, others are due by their customer's number."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("thread_ts"), (F.col("o_orderstatus") == "O").alias("active"), F.col("o_custkey").alias("next_poll_generation"))
    return lake.poll_queue(o, 40, 1000)


POLL_SQL = """
SELECT thread_ts, active, next_poll_generation FROM (
  SELECT o_orderkey AS thread_ts, true AS active, o_custkey AS next_poll_generation FROM orders WHERE o_orderstatus = 'O'
  UNION ALL SELECT o_orderkey, false, o_custkey FROM orders WHERE o_orderstatus <> 'O' AND o_custkey <= 40)
ORDER BY active DESC, next_poll_generation, thread_ts LIMIT 1000
"""


def invariant_violations(spark, d):
    docs, labels, o, li = (read(spark, d, n) for n in ("documents", "labels", "orders", "lineitem"))
    return lake.violations(
        {
            "text_twice": docs.groupBy("text").agg(F.count("*").alias("n")).where("n > 1"),
            "label_without_document": lake.missing_anchors(labels, docs, "doc_id"),
            "shipped_before_order": li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate < o_orderdate"),
            "order_without_line": lake.missing_anchors(o.withColumnRenamed("o_orderkey", "l_orderkey"), li, "l_orderkey"),
        }
    )


INVARIANTS_SQL = """
SELECT * FROM (
  SELECT 'text_twice' AS violation, count(*) AS records FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)
  UNION ALL SELECT 'label_without_document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
  UNION ALL SELECT 'shipped_before_order', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate
  UNION ALL SELECT 'order_without_line', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) WHERE records > 0
"""


def claim_queue(spark, d):
    """Order lines as claims of their orders: returned ones of the first ship mode."""
    li = read(spark, d, "lineitem")
    claim = F.struct(F.col("l_linenumber").alias("claim_id"), F.col("l_returnflag").alias("state"), (F.col("l_linestatus") == "F").alias("backfill"), F.when(F.col("l_quantity") > 25, "manual").otherwise("automatic").alias("verification_mode"))
    groups = li.groupBy(F.col("l_orderkey").alias("group_id")).agg(F.collect_list(claim).alias("claims"))
    return lake.claim_queue(groups, "R", True, "manual").select("group_id", F.size("claims").cast("long").alias("claims"))


CLAIM_QUEUE_SQL = "SELECT l_orderkey AS group_id, count(*) AS claims FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 25 GROUP BY l_orderkey"


def card_queue(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("channel"), (F.col("o_totalprice") > 100000).alias("automatic"))
    return lake.card_queue(o, "O", "1-URGENT", True).select("o_orderkey")


def unknown_drafts(spark, d):
    """Lines that anchor an order which is not a draft."""
    drafts = read(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("draft_id"))
    return states.unknown_anchors(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("draft_id"), "l_linenumber"), drafts)


def prior_answers(spark, d):
    t = read(spark, d, "conversations")
    return lake.prior_answers(t.select(F.col("role").alias("question"), F.col("text").alias("answer"), F.array("role").alias("used_queries"), F.col("turn").alias("ts"), F.col("conv_id").alias("id")), "THE", 50).select("id", "ts")


def reference_resolve(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").cast("string").alias("event_id"), F.concat(F.lit("m"), "user_id").alias("source_message_ref"), F.concat(F.lit("blob:"), "event_type").alias("raw_blob_ref"))
    return lake.resolve_reference(e, "m7")


def attribute_paths(spark, d):
    return lake.attribute_paths(read(spark, d, "events"), "event_id", "props").withColumn("examples", F.array_join("examples", ","))


PATHS_SQL = """
WITH f AS (SELECT event_id, json_extract_string(props, '$.k') AS v FROM events WHERE json_exists(props, '$.k')), u AS (SELECT v, min(event_id) AS seen FROM f GROUP BY v ORDER BY seen LIMIT 5)
SELECT 'k' AS path, (SELECT count(DISTINCT event_id) FROM f) AS documents, (SELECT count(*) FROM f) AS occurrences, (SELECT string_agg(v, ',' ORDER BY seen) FROM u) AS examples
"""


def overdue_replies(spark, d):
    return reply_latency(spark, d).where(F.col("status").isin("overdue", "sent_late"))


def visible_blobs(spark, d):
    """Blobs that a labelled document refers to."""
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    blobs = append.blob_refs(docs.select(F.col("text").cast("binary").alias("data"))).select("blob_ref")
    refs = append.blob_refs(docs.join(labels.select("doc_id"), "doc_id", "left_semi").select(F.col("text").cast("binary").alias("data"))).select("blob_ref")
    return blobs.join(refs, "blob_ref", "left_semi")


def slack_corpus(spark, d):
    """Messages of public rooms whose name matches, without bots."""
    t = read(spark, d, "conversations")
    room = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lpad((F.col("conv_id") % 1000).cast("string"), 3, "0"), F.lit("_room"))).otherwise("general")
    payload = F.to_json(F.struct(room.alias("channel_name"), (F.col("conv_id") % 3 != 0).alias("is_public_channel"), (F.col("role") == "system").alias("is_bot"), F.col("role").alias("user_id"), "text", F.concat_ws("-", "conv_id", "turn").alias("ts")))
    rows = t.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.lit("schema:slack-message").alias("schema"), F.lit("subject").alias("subject"), F.lit("observer").alias("observer"), F.lit("sys:slack").alias("source_system"), payload.alias("payload"), minute("turn").alias("published"), F.lit(None).cast("long").alias("published_nanos"))
    return C.corpus(rows).select("record_id", "source_type", "source_title", "source_location", "timestamp", "text", "thread_ts", "container")


SLACK_SQL = """
WITH m AS (SELECT conv_id || '-' || turn AS id, lpad(CAST(conv_id % 1000 AS VARCHAR), 3, '0') || '_room' AS room, * FROM conversations WHERE conv_id % 2 = 0 AND conv_id % 3 <> 0 AND role <> 'system')
SELECT id AS record_id, 'slack' AS source_type, '#' || room AS source_title, CAST(NULL AS VARCHAR) AS source_location, make_timestamp((1700000000 + 60 * turn) * 1000000) AS timestamp, text, id AS thread_ts, room AS container FROM m WHERE trim(text) <> ''
"""


def drive_corpus(spark, d):
    """Parts as files: in an allowed folder, shared widely enough, not excluded, and not the sheet of a form; some are presentations, which the rule for files leaves alone."""
    p = read(spark, d, "part")
    level = F.element_at(F.array(*map(F.lit, ("private", *C.SHARING))), (F.col("p_size") % 5 + 1).cast("int"))
    file = F.to_json(
        F.struct(
            F.struct(F.when(F.col("p_partkey") % 9 > 0, "drive").otherwise(F.lit("slides")).alias("service"), F.col("p_partkey").cast("string").alias("sourceObjectId"), F.lit("drive").alias("containerId")).alias("artifact"), F.struct(F.array(F.col("p_brand")).alias("parentIds"), level.alias("sharingLevel")).alias("metadata"), F.col("p_name").alias("title")
        )
    )
    rows = lambda schema, payload: p.select(F.col("p_partkey").cast("string").alias("id"), F.lit(schema).alias("schema"), F.lit("s").alias("subject"), F.lit("o").alias("observer"), F.lit(None).cast("string").alias("source_system"), payload.alias("payload"), minute("p_partkey").alias("published"), F.lit(None).cast("long").alias("published_nanos"))
    forms = rows("schema:form-response-content", F.to_json(F.struct(F.when(F.col("p_size") > 40, F.col("p_partkey").cast("string")).alias("linkedSheetId"))))
    brands = tuple(f"Brand#{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3, 4, 5))
    config = C.Config(allowed_folders=brands, excluded_files=("1", "2", "3"), least_sharing="domain")
    return C.corpus(rows("schema:workspace-object-snapshot", file).unionByName(forms), config).select("record_id", "source_type", "source_title", "text", "container")


DRIVE_SQL = """
SELECT CAST(p_partkey AS VARCHAR) AS record_id, 'workspace-object-snapshot' AS source_type, p_name AS source_title, p_name AS text, 'drive' AS container FROM part
WHERE (p_partkey % 9 = 0 OR regexp_matches(p_brand, '^Brand#[123][1-5]$') AND p_partkey NOT IN (1, 2, 3) AND p_size % 5 >= 2) AND p_size <= 40 AND trim(p_name) <> ''
"""


def scalar_keys(spark, d):
    t = read(spark, d, "conversations")
    ts = F.concat((F.col("turn") * 60 + 1_700_000_000).cast("string"), F.lit("."), F.lpad(F.col("conv_id").cast("string"), 6, "0"))
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    return t.select(
        "conv_id", "turn", K.slack_time(ts).alias("slack_time"), K.identity_key(F.col("role"), conv, F.col("text")).alias("identity_key"), K.source_key("edit", conv, turn, F.col("role")).alias("edit_key"),
        K.identifier_key(F.lit("Email"), F.concat(F.lit(" A@"), F.col("role"), F.lit(" ")), F.lit("Sys")).alias("email_key"), K.identifier_key(F.lit("user_id"), F.concat(F.lit("U"), conv), F.lit("Sys")).alias("user_key"),
        K.agent_name(F.concat(F.lit("agent:"), F.col("role")), F.lit(None).cast("string")).alias("agent"), K.semver(F.concat_ws(".", conv, turn, F.lit("0")))["minor"].alias("minor"), K.rfc3339(F.concat(F.lit("2024-01-02T03:04:0"), (F.col("turn") % 10).cast("string"), F.lit("+09:00"))).alias("rfc3339"),
        K.json_string(F.to_json(F.struct("role", "turn")), "$.role").alias("role_text"), K.json_string(F.to_json(F.struct("role", "turn")), "$.turn").alias("turn_text"),
    )


SCALAR_SQL = """
SELECT conv_id, turn, make_timestamp((1700000000 + 60 * turn) * 1000000 + conv_id % 1000000) AS slack_time, role || ':' || conv_id || ':' || sha256(text) AS identity_key, 'slack:' || conv_id || ':' || turn || ':edit:' || role AS edit_key,
  'email|*|a@' || lower(role) AS email_key, 'user_id|sys|U' || conv_id AS user_key, role AS agent, CAST(turn AS INT) AS minor, TIMESTAMP '2024-01-01 18:04:00' + to_seconds(turn % 10) AS rfc3339, role AS role_text, CAST(NULL AS VARCHAR) AS turn_text FROM conversations
"""


def published_items(spark, d):
    """Two generations; a reader sees the head, and the older one where it is pinned."""
    store = append.Generations(spark, new_path(spark, "generations"))
    pinned = store.publish(read(spark, d, "supplier").select(F.col("s_suppkey").alias("item_key"), F.col("s_name").alias("value")))
    store.publish(read(spark, d, "customer").select(F.col("c_custkey").alias("item_key"), F.col("c_name").alias("value")))
    return store.read().withColumn("read", F.lit("head")).unionByName(store.read(pinned).withColumn("read", F.lit("pinned"))).select("item_key", "value", "read")


def session_roots(spark, d):
    """How many turns each conversation's tree has, and its depth."""
    t = read(spark, d, "conversations")
    key = lambda turn: F.concat_ws("-", "conv_id", turn.cast("string"))
    tree = graph.session_tree(t.select(key(F.col("turn")).alias("session"), F.when(F.col("turn") > 0, key(F.floor(F.col("turn") / 2))).alias("parent")))
    return tree.groupBy("root").agg(F.count("*").alias("sessions"))


def _stream(spark, rows, order, tag, files=4, at_once=2):
    """A folder of its own, and rows as a stream of files in order, some at a time: at_once in files parts of them, each in as many files as the splits of the input ask for, so that no task writes or reads a whole part."""
    folder, each = new_path(spark, tag), max(1, -(-rows.rdd.getNumPartitions() // files))
    rows.repartitionByRange(files * each, order).write.parquet(f"{folder}/in")
    return folder, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", at_once * each).parquet(f"{folder}/in")


def _run(stream, fold, folder):
    views.run_available(stream, fold, f"{folder}/checkpoint").awaitTermination()


def stream_corpus(spark, d):
    """A corpus kept by micro-batches from a lake of documents and, after some of them, retractions of toxic ones, in files that mix both."""
    docs, toxic = corpus(spark, d), read(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("record_id"))
    lake = docs.select("record_id", "source_type", "container", "timestamp", F.lit(False).alias("retracts")).unionByName(toxic.withColumn("retracts", F.lit(True)), allowMissingColumns=True)
    folder, stream = _stream(spark, lake.withColumn("file", F.hash("record_id", "retracts")), "file", "corpus-view")

    def compute(rows):
        gone = rows.where("retracts").select("record_id")
        return rows.where("not retracts").join(gone, "record_id", "left_anti").select("record_id", "source_type", "container", "timestamp").dropDuplicates(["record_id"])

    view = views.ArrivedView(spark, folder, "record_id", compute)
    _run(stream, view.fold, folder)
    return view.current()


def card_facts(spark, d):
    """Drafts of reply cards and the events about them as facts of one stream: draft_id, kind, id, at, expires_at, event."""
    from millrace.plans import state_queries as S

    events = S._card_events(read(spark, d, "lineitem"), malformed=False)
    drafts = S.card_drafts(spark, d).select("draft_id", F.lit("draft").alias("kind"), F.lit(None).cast(events.schema["id"].dataType).alias("id"), F.col("created_at").alias("at"), "expires_at", F.lit(None).cast("string").alias("event"))
    told = events.select("draft_id", F.lit("event").alias("kind"), "id", F.col("created_at").alias("at"), F.lit(None).cast(drafts.schema["expires_at"].dataType).alias("expires_at"), "event")
    return drafts.unionByName(told)


def stream_cards(spark, d):
    """Reply cards kept by micro-batches from drafts and events alone, whose files are in no order of time."""
    facts = card_facts(spark, d)
    folder, stream = _stream(spark, facts.withColumn("file", F.hash("draft_id", "kind", "id")), "file", "cards-state", 6, 2)
    view = folds.CardsView(spark, folder)
    folds.run_cards(stream.drop("file"), view, f"{folder}/checkpoint")
    return view.current(NOW).select("draft_id", "state", "updated_at", "taken")


CARDS_SQL = f"SELECT * FROM ({CARD_SQL})"


def stream_replies(spark, d):
    """Latencies of replies kept by micro-batches of incoming orders and of sends, in any order."""
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    facts = o.select(F.col("o_orderkey").alias("observation_id"), F.lit("in").alias("kind"), late(F.col("o_orderdate"), "o_orderkey").alias("at"), F.lit(0).alias("line"))
    facts = facts.unionByName(li.select(F.col("l_orderkey").alias("observation_id"), F.lit("sent").alias("kind"), late(F.col("l_shipdate"), "l_partkey").alias("at"), F.col("l_linenumber").cast("int").alias("line")))
    folder, stream = _stream(spark, facts.withColumn("file", F.hash("observation_id", "kind", "line")), "file", "replies-view")

    def compute(rows):
        orders = rows.where("kind = 'in'").select(F.col("observation_id").alias("o_orderkey"), F.col("at").alias("o_orderdate")).distinct()
        return reply_latencies(orders, rows.where("kind = 'sent'").select(F.col("observation_id").alias("l_orderkey"), F.col("line").alias("l_linenumber"), F.col("at").alias("l_shipdate")))

    view = views.ArrivedView(spark, folder, "observation_id", compute)
    _run(stream, view.fold, folder)
    return view.current()


def stream_sessions(spark, d):
    """Summaries of sessions kept by micro-batches of history entries."""
    t = read(spark, d, "conversations")
    rows = t.select(F.col("conv_id").alias("session_ref"), minute("turn").alias("published_at"), F.col("role").alias("surface"), F.substring("role", 1, 1).alias("channel"))
    folder, stream = _stream(spark, rows, "published_at", "sessions-view")
    view = views.ArrivedView(spark, folder, "session_ref", lambda mine: activity.sessions(mine).withColumns({c: F.array_join(c, ",") for c in ("surfaces", "channels")}))
    _run(stream, view.fold, folder)
    return view.current()


def stream_components(spark, d):
    """Components of parts and suppliers kept by micro-batches of order lines: only lines of small quantity join a part and a supplier, so that there are many."""
    edges = read(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.when(F.col("l_quantity") <= 1, F.concat(F.lit("s"), "l_suppkey")).otherwise(F.concat(F.lit("p"), "l_partkey")).alias("b"), "l_orderkey")
    folder, stream = _stream(spark, edges, "l_orderkey", "components-view")
    view = views.ComponentsView(spark, f"{folder}/view")
    _run(stream, view.fold, folder)
    return view.current()


COMPONENTS_SQL = """
WITH RECURSIVE e AS (SELECT DISTINCT 'p' || l_partkey AS a, CASE WHEN l_quantity <= 1 THEN 's' || l_suppkey ELSE 'p' || l_partkey END AS b FROM lineitem), g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS to_node FROM g UNION SELECT r.node, g.b FROM r JOIN g ON r.to_node = g.a)
SELECT node, min(to_node) AS component FROM r GROUP BY node
"""


def stream_bridge(spark, d):
    """The bridge of new identities kept by pages that come in no order of position."""
    docs = read(spark, d, "documents")
    rows = docs.select(F.concat_ws("|", "source", "lang").alias("v2_key"), F.col("doc_id").alias("append_seq"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("canonical"), F.hash("doc_id").alias("file"))
    folder, stream = _stream(spark, rows, "file", "bridge-view")
    view = journal.BridgeView(spark, folder)
    _run(stream, view.fold, folder)
    return view.current()


def stream_people(spark, d):
    """Users as nodes that share addresses and numbers, which some of their events tell: people, their totals and consent, kept by micro-batches in no order of time."""
    e, node = read(spark, d, "events"), F.col("user_id")
    ident = F.when(F.col("event_type") == "purchase", F.concat(F.lit("mail:"), node % 60)).when(F.col("event_type") == "signup", F.concat(F.lit("phone:"), F.floor(node / 3))).when(F.col("event_type") == "click", F.concat(F.lit("uid:"), node))
    decides = (F.col("event_type") == "error") & (F.col("event_id") % 5 == 0)
    facts = e.select(
        F.when(~decides, node).alias("node"), F.when(decides, F.concat(F.lit("mail:"), node % 60)).otherwise(ident).alias("ident"), F.when(F.col("event_type") == "click", "exclusive").otherwise("joins").alias("rule"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("user "), node)).alias("name"), F.lit(1).cast("long").alias("n"), F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id") % 1000).alias("at"), F.col("event_type").alias("channel"),
        F.when(decides, F.when(F.col("value") > 10, "opted_out").otherwise("unrestricted")).alias("status"), F.hash("event_id").alias("file"))
    folder, stream = _stream(spark, facts, "file", "people-view", 4, 2)
    view = people.PeopleView(spark, folder)
    _run(stream.drop("file"), view.fold, folder)
    return view.current().withColumn("channels", F.array_join("channels", ","))


PEOPLE_SQL = """
WITH RECURSIVE f AS (
  SELECT user_id AS node, event_type, event_id, event_type = 'error' AND event_id % 5 = 0 AS decides, ts + to_microseconds(event_id % 1000) AS moment, value,
    CASE event_type WHEN 'purchase' THEN 'mail:' || user_id % 60 WHEN 'signup' THEN 'phone:' || user_id // 3 END AS ident FROM events),
told AS (SELECT * FROM f WHERE NOT decides),
g AS (SELECT DISTINCT a.node AS a, b.node AS b FROM (SELECT DISTINCT node, ident FROM told WHERE ident IS NOT NULL) a JOIN (SELECT DISTINCT node, ident FROM told WHERE ident IS NOT NULL) b USING (ident)),
r AS (SELECT DISTINCT node AS a, node AS b FROM told UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a),
c AS (SELECT a AS node, min(b) AS component FROM r GROUP BY a),
d AS (SELECT 'mail:' || node % 60 AS ident, max({'moment': moment, 'status': CASE WHEN value > 10 THEN 'opted_out' ELSE 'unrestricted' END}) AS decision FROM f WHERE decides GROUP BY 1),
s AS (SELECT component, struct_extract(max(decision), 'status') AS status FROM d JOIN (SELECT DISTINCT component, ident FROM told JOIN c USING (node)) USING (ident) GROUP BY component)
SELECT 'person:component-' || component AS person, count(DISTINCT node) AS nodes, count(*) AS n, min(moment) AS first_at, max(moment) AS last_at, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS channels,
  'user ' || min(node) FILTER (event_id % 3 = 0) AS name, any_value(status) AS status FROM told JOIN c USING (node) LEFT JOIN s USING (component) GROUP BY component
"""


def stream_index(spark, d):
    """An n-gram index kept by micro-batches: turns come in, and those of systems are retracted, in files that mix both; postings by n-gram."""
    t = read(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("record_id"), "role", "text")
    lake = t.select("record_id", "text", F.lit(False).alias("retracts")).unionByName(t.where("role = 'system'").select("record_id", F.lit(None).cast("string").alias("text"), F.lit(True).alias("retracts")))
    folder, stream = _stream(spark, lake.withColumn("file", F.hash("record_id", "retracts")), "file", "index-view")
    arrivals = views.Arrivals(spark, f"{folder}/arrived", "record_id")

    def corpus_of(keys):
        rows = arrivals.of(keys, stream)
        return rows.where("not retracts").select("record_id", "text").join(rows.where("retracts").select("record_id"), "record_id", "left_anti").dropDuplicates(["record_id"])

    view = views.IndexView(spark, f"{folder}/view", corpus_of)

    def fold(batch, number):
        arrivals.take(batch, number)
        view.fold(batch, number)

    _run(stream, fold, folder)
    return view.postings.read().groupBy("ngram").agg(F.count("*").alias("records"))


INDEX_SQL = """
SELECT ngram, count(DISTINCT id) AS records FROM (SELECT conv_id || '-' || turn AS id, unnest(list_transform(range(1, greatest(1, length(text) - 1)), lambda i: text[i:i + 2])) AS ngram FROM conversations WHERE role <> 'system' AND length(text) >= 3) GROUP BY ngram
"""


def stream_freshness(spark, d):
    """The latest time of each source, kept by micro-batches, against the thresholds that the view was made for."""
    e = read(spark, d, "events").select(F.col("event_type").alias("source"), F.col("ts").alias("published"), F.col("ts").alias("recorded_at"))
    folder, stream = _stream(spark, e, "published", "freshness")
    limits = spark.createDataFrame([("click", 3600), ("error", 600), ("view", 10**7), ("nothing", 60)], "source string, max_age_seconds long")
    view = views.FreshnessView(spark, f"{folder}/view", limits)
    _run(stream, view.fold, folder)
    return activity.freshness(view.current(), view.thresholds(), NOW).select("source", "last_at", "status")


STREAM_FRESH_SQL = f"""
WITH limits(source, most) AS (VALUES ('click', 3600), ('error', 600), ('view', 10000000), ('nothing', 60)), seen AS (SELECT event_type AS source, max(ts) AS last_at FROM events GROUP BY 1)
SELECT l.source, s.last_at, CASE WHEN s.last_at IS NULL THEN 'unobserved' WHEN epoch(TIMESTAMP '{NOW}') - floor(epoch(s.last_at)) > most THEN 'missing' ELSE 'fresh' END AS status FROM limits l LEFT JOIN seen s USING (source)
"""

BLOBS_SQL = "SELECT DISTINCT 'blob:sha256:' || sha256(text) AS blob_ref FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"
REPLIES_SQL = f"SELECT * FROM ({REPLY_SQL}) WHERE status IN ('sent_late', 'overdue')"

QUERIES = {
    "observation_page": (observation_page, "SELECT event_id, user_id FROM events WHERE event_type = 'click' AND event_id > 100 ORDER BY event_id LIMIT 50"),
    "export_page": (export_page, "SELECT event_id, event_type FROM events WHERE event_id > 100 AND event_id <= 900 ORDER BY event_id LIMIT 50"),
    "items_page": (items_page, "SELECT c_mktsegment AS owner_key, c_name AS sort_key, c_custkey AS item_key FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND starts_with(c_name, 'C') ORDER BY sort_key, item_key LIMIT 50"),
    "items_by_owner": (items_by_owner, "SELECT c_mktsegment AS owner_key, count(*) AS items FROM customer GROUP BY 1"),
    "event_stats": (event_stats, "SELECT count(*) AS records, coalesce(max(event_id), 0) AS last FROM events"),
    "stream_heads": (stream_heads, "SELECT c_custkey AS stream_id, coalesce(max(event_id), 0) AS last FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey"),
    "watermark_commits": (watermark_commits, "SELECT 'orders' AS projection, leaf, max(position) AS position FROM (SELECT o_orderstatus AS leaf, o_orderkey AS position FROM orders UNION ALL SELECT l_linestatus, l_orderkey FROM lineitem) GROUP BY leaf"),
    "privacy_key_rows": (privacy_key_rows, "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) OR o_orderkey % 1000 IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)"),
    "missing_anchors": (missing_anchors, "SELECT doc_id, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE len(string_split(text, ' ')) >= 5)"),
    "bridge_readiness": (bridge_readiness, READINESS_SQL),
    "import_outcomes": (import_outcomes, IMPORT_SQL),
    "session_index": (session_index, SESSION_INDEX_SQL),
    "break_glass_channels": (break_glass_channels, GLASS_SQL),
    "health_rollup": (health_rollup, HEALTH_SQL),
    "poll_queue": (poll_queue, POLL_SQL),
    "invariant_violations": (invariant_violations, INVARIANTS_SQL),
    "claim_queue": (claim_queue, CLAIM_QUEUE_SQL),
    "card_queue": (card_queue, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' AND o_totalprice > 100000"),
    "unknown_drafts": (unknown_drafts, "SELECT l_orderkey AS draft_id, l_linenumber, 'unknown_draft_anchor' AS audit FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')"),
    "prior_answers": (prior_answers, "SELECT conv_id AS id, turn AS ts FROM conversations WHERE contains(lower(nfc_normalize(text)), 'the') ORDER BY turn DESC, conv_id LIMIT 50"),
    "reference_resolve": (reference_resolve, "SELECT CAST(event_id AS VARCHAR) AS event_id, 'm' || user_id AS source_message_ref, 'blob:' || event_type AS raw_blob_ref FROM events WHERE user_id = 7"),
    "attribute_paths": (attribute_paths, PATHS_SQL),
    "overdue_replies": (overdue_replies, REPLIES_SQL),
    "visible_blobs": (visible_blobs, BLOBS_SQL),
    "slack_corpus": (slack_corpus, SLACK_SQL),
    "drive_corpus": (drive_corpus, DRIVE_SQL),
    "scalar_keys": (scalar_keys, SCALAR_SQL),
    "published_items": (published_items, "SELECT c_custkey AS item_key, c_name AS value, 'head' AS read FROM customer UNION ALL SELECT s_suppkey, s_name, 'pinned' FROM supplier"),
    "session_roots": (session_roots, "SELECT conv_id || '-0' AS root, count(*) AS sessions FROM conversations GROUP BY conv_id"),
    "stream_corpus": (
        stream_corpus,
        "SELECT CAST(doc_id AS VARCHAR) AS record_id, source AS source_type, lang AS container, make_timestamp((1700000000 + 60 * doc_id) * 1000000) AS timestamp FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    ),
    "stream_freshness": (stream_freshness, STREAM_FRESH_SQL),
    "stream_cards": (stream_cards, CARDS_SQL),
    "stream_replies": (stream_replies, REPLY_SQL),
    "stream_sessions": (stream_sessions, SESSION_SQL),
    "stream_components": (stream_components, COMPONENTS_SQL),
    "stream_index": (stream_index, INDEX_SQL),
    "stream_people": (stream_people, PEOPLE_SQL),
    "stream_bridge": (stream_bridge, BRIDGE_SQL),
}
