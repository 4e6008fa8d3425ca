"""Payload mappers: raw exports of message sources to observation drafts, as projections of JSON tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.keys import identity_key, rfc3339, slack_time


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema; a line that is no JSON is a row with its text in _bad."""
    return spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)


def bad_lines(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("_bad").isNotNull()).select("_bad")


def draft(rows: DataFrame, source: str, schema: str, object_id: Column, subject: Column, published: Column, payload: Column, meta: dict[str, Column], attachments: Column | None = None, retracts: Column | None = None, version: str = "1.0.0", key: Column | None = None) -> DataFrame:
    """Drafts with an identity key over the canonical payload, or a key of their own."""
    text = F.to_json(payload)
    fields = [F.lit("1").alias("sourceAdapterVersion"), object_id.alias("object_id"), *[c.alias(k) for k, c in meta.items()]]
    if retracts is not None:
        fields.append(F.when(retracts, F.struct(object_id.alias("source_object_id"))).alias("retracts"))
    return rows.select(
        F.lit(f"schema:{schema}").alias("schema"), F.lit(version).alias("schema_version"), F.lit(f"obs:{source}-crawler").alias("observer"), F.lit(f"sys:{source}").alias("source_system"),
        F.lit("lake_authoritative").alias("authority_model"), F.lit("event").alias("capture_model"), subject.alias("subject"), F.lit(None).cast("string").alias("target"), text.alias("payload"),
        (attachments if attachments is not None else F.array().cast("array<string>")).alias("attachments"), published.alias("published"),
        (identity_key(F.lit(source), object_id, text) if key is None else key).alias("idempotency_key"), F.to_json(F.struct(*fields)).alias("meta"),
    )


SLACK = "channel_id string, channel_name string, ts string, user_id string, user_name string, email string, text string, thread_ts string, ingress_kind string, message_type string, is_public_channel boolean, is_bot boolean, files array<struct<id: string, name: string, blob_ref: string>>"


def slack(messages: DataFrame) -> DataFrame:
    """Messages, edits and deletes; a delete retracts its source object. A row without a valid ts or ingress_kind makes no draft."""
    rows = messages.withColumn("at", slack_time(F.col("ts"))).where("at is not null and ingress_kind is not null")
    names = ["channel_id", "channel_name", "ts", "user_id", "user_name", "text", "ingress_kind", "message_type", "email", "thread_ts", "is_public_channel", "is_bot", "files"]
    object_id = F.concat_ws("-", "channel_id", "ts")
    meta = {
        "communication_channel_kind": F.lit("slack"),
        "communication_channel_external_id": F.col("channel_id"),
        "communication_sender_id": F.col("user_id"),
        "communication_thread_ref": F.concat(F.lit("slack:thread:"), F.coalesce("thread_ts", "ts")),
    }
    attachments = F.array_compact(F.coalesce(F.col("files.blob_ref"), F.array().cast("array<string>")))
    return draft(rows, "slack", "slack-message", object_id, F.concat(F.lit("message:slack:"), object_id), F.col("at"), F.struct(*names), meta, attachments, F.col("message_type") == "delete")


SLACK_CHANNELS = "channel_id string, channel_name string, purpose string, topic string, member_count bigint, members array<string>, is_archived boolean, snapshot_at timestamp"


def slack_channels(snapshots: DataFrame) -> DataFrame:
    """A draft for each snapshot of a channel; two of one minute have one key."""
    names = ["channel_id", "channel_name", "purpose", "topic", "member_count", "members", "is_archived", "snapshot_at"]
    key = F.concat(F.lit("slack:channel:"), "channel_id", F.lit(":snapshot:"), F.date_format("snapshot_at", "yyyy-MM-dd'T'HH:mm"))
    return draft(snapshots, "slack", "slack-channel-snapshot", F.col("channel_id"), F.concat(F.lit("channel:slack:"), "channel_id"), F.col("snapshot_at"), F.struct(*names), {}, key=key)


GMAIL = "account_id string, message_id string, thread_id string, date string, `from` string, `to` array<string>, cc array<string>, subject string, text string, references array<string>, in_reply_to string, labels array<string>"


def gmail(messages: DataFrame) -> DataFrame:
    """RFC 2822 dates; a message without a valid one makes no draft."""
    day = F.regexp_replace("date", r"^\w{3},\s*|\s*\(.*\)$", "")
    at = F.coalesce(F.try_to_timestamp(day, F.lit("d MMM yyyy HH:mm:ss xx")), F.try_to_timestamp(day, F.lit("d MMM yyyy HH:mm:ss z")))
    rows = messages.withColumn("at", at).where("at is not null")
    names = ["account_id", "message_id", "thread_id", "date", "from", "to", "cc", "subject", "text", "references", "in_reply_to", "labels"]
    meta = {
        "communication_channel_kind": F.lit("gmail"),
        "communication_channel_external_id": F.col("account_id"),
        "communication_sender_id": F.col("from"),
        "communication_thread_ref": F.concat(F.lit("gmail:thread:"), "thread_id"),
    }
    return draft(rows, "gmail", "gmail-message", F.col("message_id"), F.concat(F.lit("message:gmail:"), "message_id"), F.col("at"), F.struct(*names), meta)


DISCORD = "channel_id string, message_id string, timestamp timestamp, author_id string, author_name string, content string, is_dm boolean, guild_id string, guild_name string, channel_name string, mentions array<string>, referenced_message_id string"


def discord(messages: DataFrame) -> DataFrame:
    names = ["channel_id", "message_id", "timestamp", "author_id", "author_name", "content", "is_dm", "guild_id", "guild_name", "channel_name", "mentions", "referenced_message_id"]
    meta = {
        "communication_channel_kind": F.lit("discord"),
        "communication_channel_external_id": F.col("channel_id"),
        "communication_sender_id": F.col("author_id"),
        "communication_thread_ref": F.concat(F.lit("discord:thread:"), F.coalesce("referenced_message_id", "message_id")),
    }
    object_id = F.concat_ws(":", "channel_id", "message_id")
    return draft(messages, "discord", "discord-message", object_id, F.concat(F.lit("message:discord:"), object_id), F.col("timestamp"), F.struct(*names), meta)


_ITEM = "array<struct<id: bigint, number: bigint, sha: string, title: string, body: string, message: string, state: string, user: string, html_url: string, created_at: timestamp>>"
GITHUB = "repo string, " + ", ".join(f"{n} {_ITEM}" for n in ("issues", "issue_comments", "pull_requests", "reviews", "review_comments", "commits", "timeline"))
#: Arrays of a dump and the object type of their items.
GITHUB_ARRAYS = {"issues": "issue", "issue_comments": "issue_comment", "pull_requests": "pull_request", "reviews": "pull_request_review", "review_comments": "pull_request_review_comment", "commits": "commit", "timeline": "timeline_event"}


def github(dumps: DataFrame) -> DataFrame:
    """One row for each item of each array of a repository's dump."""
    none = F.array().cast(f"array<struct<object_type: string, x: {_ITEM[6:-1]}>>")

    def tagged_as(kind: str):
        return lambda x: F.struct(F.lit(kind).alias("object_type"), x.alias("x"))

    tagged = F.concat(*[F.coalesce(F.transform(name, tagged_as(kind)), none) for name, kind in GITHUB_ARRAYS.items()])
    rows = dumps.select("repo", F.explode(tagged).alias("t")).select("repo", "t.object_type", "t.x.*")
    object_id = F.concat_ws(":", "repo", "object_type", F.coalesce("sha", F.col("id").cast("string"), F.col("number").cast("string")))
    payload = F.struct("repo", "object_type", "id", "number", "sha", "title", "body", "message", "state", "user", "html_url")
    return draft(rows, "github", "github-event", object_id, F.concat(F.lit("github:"), object_id), F.col("created_at"), payload, {})


CODEX = "timestamp timestamp, type string, payload struct<id: string, cwd: string, parent_id: string, type: string, role: string, name: string, arguments: string, output: string, content: array<struct<type: string, text: string>>>"


def codex(lines: DataFrame, path: str = "path", line_no: str = "line_no") -> DataFrame:
    """Transcript lines (path, line_no and CODEX columns): the session's meta row joins its other rows; a transcript without one makes none."""
    meta_rows = lines.where("type = 'session_meta'").groupBy(path).agg(F.min_by(F.struct("payload.id", "payload.parent_id", "payload.cwd"), line_no).alias("session"))
    items = lines.where("type = 'response_item'").join(meta_rows, path)
    text = F.array_join(F.filter(F.col("payload.content.text"), lambda t: t.isNotNull()), "\n")
    kind = F.when(F.col("payload.type") == "message", "message").when(F.col("payload.type").isin("function_call", "custom_tool_call"), "tool_call").when(F.col("payload.type").endswith("_output"), "tool_result")
    items = items.withColumn("kind", kind).where("kind is not null")
    item = F.struct("kind", F.col("payload.role").alias("role"), text.alias("text"), F.col("payload.name").alias("tool_name"), F.col("payload.arguments").alias("arguments"), F.col("payload.output").alias("output"))
    object_id = F.concat_ws(":", "session.id", F.col(line_no).cast("string"))
    payload = F.struct(F.struct("session.id", "session.parent_id").alias("session"), F.struct(object_id.alias("id")).alias("message"), item.alias("item"))
    return draft(items, "codex", "coding-agent-item", object_id, F.concat(F.lit("message:codex:"), object_id), F.col("timestamp"), payload, {"session_id": F.col("session.id")})


#: Types of transcript lines that hold no message.
TRANSCRIPT_EXTRAS = ["ai-title", "attachment", "file-history-snapshot", "last-prompt", "mode", "permission-mode", "queue-operation", "system"]


def _blocks(content: Column, kind: str, field: str) -> Column:
    """A field of the blocks of one type in a message's content, which is a text or an array of blocks."""
    blocks = F.from_json(content, "array<struct<type: string, text: string, name: string>>")
    found = F.transform(F.filter(blocks, lambda b: (b["type"] == kind) & b[field].isNotNull()), lambda b: b[field])
    return F.coalesce(found, F.array().cast("array<string>"))


def transcript(lines: DataFrame) -> DataFrame:
    """Lines (path, line_no, line: a JSON object) of assistants' transcripts with kind, role, text, tool_name, and why one makes no draft.

    User lines give their text, assistant lines their text or, if they call tools, the tools' names joined by +; lines about
    the program, meta lines, and tool results alone make none; a line of unknown type or without its parts is told apart.
    """
    at = lambda p: F.get_json_object("line", f"$.{p}")
    rows = lines.where("trim(line) <> ''").select("path", "line_no", F.try_parse_json("line").isNotNull().alias("is_json"), at("type").alias("type"), at("sessionId").alias("session_id"), at("uuid").alias("uuid"), at("parentUuid").alias("parent_message_id"), (F.coalesce(at("isSidechain"), F.lit("false")) == "true").alias("is_sidechain"), F.coalesce(at("parentSessionId"), at("parent_session_id")).alias("parent_thread_id"), at("timestamp").alias("time"), (F.coalesce(at("isMeta"), F.lit("false")) == "true").alias("is_meta"), at("message").alias("message"), at("message.role").alias("said_by"), at("message.content").alias("content"), at("name").alias("tool"))
    plain = F.when(~F.startswith(F.ltrim("content"), F.lit("[")), F.col("content"))
    parts = F.filter(F.coalesce(F.when(plain.isNotNull(), F.array(plain)), _blocks(F.col("content"), "text", "text")), lambda t: F.trim(t) != "")
    text, tools = F.when(F.size(parts) > 0, F.array_join(parts, "\n")), F.when(F.col("type") == "assistant", _blocks(F.col("content"), "tool_use", "name"))
    rows = rows.withColumns({"text": text, "tools": F.coalesce(tools, F.array().cast("array<string>"))})
    user, called = F.col("type") == "user", F.size("tools") > 0
    why = (
        F.when(~F.col("is_json"), "malformed line")
        .when(F.col("type").isin(*TRANSCRIPT_EXTRAS), "known type without a message")
        .when(F.col("type").isNull() | ~F.col("type").isin("user", "assistant", "tool_use"), "unknown type")
        .when(user & F.col("is_meta"), "meta line")
        .when((F.col("type") != "tool_use") & F.col("message").isNull(), "no message")
        .when((F.col("type") != "tool_use") & ~F.coalesce(F.col("said_by") == F.col("type"), F.lit(False)), "other role")
        .when((F.col("type") != "tool_use") & F.col("content").isNull(), "no content")
        .when(user & F.col("text").isNull(), "tool result or no text")
        .when((F.col("type") == "assistant") & ~called & F.col("text").isNull(), "thinking or no text")
        .when((F.trim(F.coalesce("session_id", F.lit(""))) == "") | (F.trim(F.coalesce("uuid", F.lit(""))) == "") | rfc3339(F.col("time")).isNull(), "no session, id or time")
    )
    call = (F.col("type") == "tool_use") | called
    return rows.select("path", "line_no", "session_id", "uuid", "parent_message_id", "is_sidechain", "parent_thread_id", rfc3339(F.col("time")).alias("published"), F.when(call, "tool_call").otherwise("message").alias("kind"), F.when(~call, F.col("type")).alias("role"), F.when(~call, F.col("text")).alias("text"), F.when(F.col("type") == "tool_use", F.col("tool")).otherwise(F.when(called, F.array_join("tools", "+"))).alias("tool_name"), why.alias("reason"))


def claude_code(lines: DataFrame) -> DataFrame:
    """Drafts of the lines of transcript() that make one."""
    rows = transcript(lines).where("reason is null")
    object_id, source = F.concat_ws(":", "session_id", "uuid"), F.when(F.col("is_sidechain"), "sidechain").otherwise("main")
    payload = F.struct("session_id", F.col("session_id").alias("transcript_id"), "parent_message_id", "is_sidechain", "parent_thread_id", object_id.alias("object_id"), F.struct("kind", "role", "text", "tool_name").alias("item"))
    meta = {"coding_agent_source": F.lit("claude-code"), "session_id": F.col("session_id"), "transcript_id": F.col("session_id"), "thread_source": source, "parent_thread_id": F.col("parent_thread_id"), "source_container": F.col("session_id")}
    return draft(rows, "claude-code", "coding-agent-message", object_id, F.concat(F.lit("message:claude-code:"), object_id), F.col("published"), payload, meta)


CHAT_TREE = "id string, title string, mapping map<string, struct<id: string, parent: string, message: struct<id: string, author: struct<role: string>, create_time: double, content: struct<parts: array<string>>>>>"


def chat_tree(conversations: DataFrame, ids: list[str] | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Conversation trees to drafts of their messages, with filters by conversation and time. See skipped_nodes for the rest."""
    rows = conversations.where(F.col("id").isin(ids)) if ids else conversations
    rows = rows.select(F.col("id").alias("conversation_id"), "title", F.explode("mapping").alias("node_id", "node"))
    rows = rows.select("conversation_id", "title", "node_id", "node.parent", "node.message").withColumn("text", F.array_join(F.col("message.content.parts"), "\n"))
    rows = rows.withColumn("at", F.timestamp_micros((F.col("message.create_time") * 1_000_000).cast("long"))).where("message is not null and trim(coalesce(text, '')) <> '' and at is not null")
    rows = rows.where(F.col("at") >= F.to_timestamp(F.lit(since))) if since else rows
    rows = rows.where(F.col("at") <= F.to_timestamp(F.lit(until))) if until else rows
    object_id = F.concat_ws(":", "conversation_id", "node_id")
    payload = F.struct(F.col("conversation_id").alias("conversation_uuid"), F.col("node_id").alias("message_uuid"), "parent", "title", F.col("message.author.role").alias("sender"), "text")
    return draft(rows, "chatgpt", "chat-message", object_id, F.concat(F.lit("message:chatgpt:"), object_id), F.col("at"), payload, {})


def skipped_nodes(conversations: DataFrame) -> DataFrame:
    """The audit of nodes that make no draft: no message, no text or no time."""
    rows = conversations.select(F.col("id").alias("conversation_id"), F.explode("mapping").alias("node_id", "node"))
    text = F.trim(F.coalesce(F.array_join(F.col("node.message.content.parts"), "\n"), F.lit("")))
    why = F.when(F.col("node.message").isNull(), "no message").when(text == "", "no text").when(F.col("node.message.create_time").isNull(), "no time")
    return rows.select("conversation_id", "node_id", why.alias("reason")).where("reason is not null")


CHAT_LIST = "uuid string, name string, chat_messages array<struct<uuid: string, sender: string, text: string, created_at: timestamp>>"


def chat_list(conversations: DataFrame) -> DataFrame:
    """Conversations with a list of messages to drafts."""
    rows = conversations.select(F.col("uuid").alias("conversation_uuid"), "name", F.posexplode("chat_messages").alias("ordinal", "m")).select("conversation_uuid", "name", "ordinal", "m.*")
    object_id = F.concat_ws(":", "conversation_uuid", F.coalesce("uuid", F.col("ordinal").cast("string")))
    payload = F.struct("conversation_uuid", F.col("uuid").alias("message_uuid"), "sender", "text", "name")
    return draft(rows, "claude-ai", "claude-message", object_id, F.concat(F.lit("message:claude-ai:"), object_id), F.col("created_at"), payload, {})


def zipped_json(spark: SparkSession, path: str) -> DataFrame:
    """path, name, json of the .json members of zip files (binaryFile), a row for each."""

    def open_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if name.endswith(".json"):
                            yield pd.DataFrame({"path": [p], "name": [name], "json": [z.read(name).decode()]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(open_all, "path string, name string, json string")
