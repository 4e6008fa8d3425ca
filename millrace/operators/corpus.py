"""The searchable corpus: observations of many sources as rows of one schema."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.keys import privacy_keys
from millrace.functions.text import nfkc

#: Source types by source system and by schema, and github object types.
BY_SYSTEM = {"sys:claude-ai": "claude-ai", "sys:claude-code": "claude-code", "sys:codex": "codex", "sys:gmail": "gmail", "sys:discord": "discord"}
GITHUB_TYPES = {"issue": "github-issue", "pull_request": "github-pr", "issue_comment": "github-comment", "pull_request_review": "github-comment", "pull_request_review_comment": "github-comment", "commit": "github-commit"}
CODING = ("claude-code", "codex")
SHARING = ["specific_users", "domain", "anyone_with_link", "public"]


def at(path: str, column: str = "payload") -> Column:
    return F.get_json_object(column, f"$.{path}")


def _choose(value: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value)


def source_type() -> Column:
    """By source system before schema, and github by its object type; else the name after sys: or schema:."""
    github = F.coalesce(_choose(at("object_type"), GITHUB_TYPES), F.lit("github-event"))
    system, schema = F.coalesce("source_system", F.lit("")), F.col("schema")
    slack = (schema == "schema:slack-message") | (system == "sys:slack")
    return (
        F.when(slack, "slack")
        .when((system == "sys:claude-ai") | (schema == "schema:claude-message"), "claude-ai")
        .when((system == "sys:github") | (schema == "schema:github-event"), github)
        .when(system.isin(*CODING) | system.isin("sys:claude-code", "sys:codex"), _choose(system, BY_SYSTEM))
        .when((system == "sys:gmail") | (schema == "schema:gmail-message"), "gmail")
        .when((system == "sys:discord") | (schema == "schema:discord-message"), "discord")
        .when(system.startswith("sys:"), F.substr(system, F.lit(5)))
        .otherwise(F.regexp_replace(schema, "^schema:", ""))
    )


def joined(*parts: Column) -> Column:
    """Parts that are not blank, one a line; null if there is none."""
    kept = F.filter(F.array(*parts), lambda p: p.isNotNull() & (F.trim(p) != ""))
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n"))


def text() -> Column:
    kind = F.col("source_type")
    titled = at("object_type").isin("issue", "pull_request")
    github = F.when(titled, joined(at("title"), at("body"))).when(at("object_type") == "commit", joined(at("message"))).otherwise(joined(at("body"), at("state")))
    return (
        F.when(kind.isin("slack", "claude-ai"), at("text"))
        .when(kind.startswith("github-"), github)
        .when(kind.isin(*CODING), joined(at("item.text"), at("item.tool_name"), at("item.arguments"), at("item.output")))
        .when(kind == "gmail", joined(at("subject"), at("text")))
        .when(kind == "discord", at("content"))
        .when(kind == "workspace-object-snapshot", joined(at("title"), at("native.text")))
        .otherwise(joined(at("text"), at("content"), at("question"), at("answer"), at("title")))
    )


def anchor_url() -> Column:
    """A url of the payload, else one made up from its identifiers."""
    kind, own = F.col("source_type"), F.col("id")
    made = (
        F.when(kind == "claude-ai", F.concat(F.lit("claude-ai://conversation/"), F.coalesce(at("conversation_uuid"), own), F.lit("/message/"), F.coalesce(at("message_uuid"), F.lit(""))))
        .when(kind.startswith("github-"), F.concat(F.lit("github://"), F.coalesce(at("repo"), F.lit("unknown")), F.lit("/"), F.coalesce(at("object_type"), F.lit("event")), F.lit("/"), F.coalesce(at("sha"), at("number"), at("id"), at("event_key"), own)))
        .when(kind.isin(*CODING), F.concat(kind, F.lit("://session/"), F.coalesce(at("session.id"), own), F.lit("/message/"), F.coalesce(at("message.id"), own)))
        .when(kind == "gmail", F.concat(F.lit("gmail://"), F.coalesce(at("account_id"), F.lit("unknown")), F.lit("/message/"), F.coalesce(at("message_id"), own)))
        .when(kind == "discord", F.concat(F.lit("discord://"), F.coalesce(at("channel_id"), F.lit("unknown")), F.lit("/message/"), F.coalesce(at("message_id"), own)))
        .otherwise(F.concat(F.lit("observation://"), own))
    )
    return F.coalesce(at("html_url"), at("url"), at("permalink"), at("artifact.canonicalUri"), made)


def title() -> Column:
    kind = F.col("source_type")
    unknown = lambda c: F.coalesce(c, F.lit("unknown"))
    return (
        F.when(kind == "slack", F.concat(F.lit("#"), unknown(at("channel_name"))))
        .when(kind == "claude-ai", F.concat(F.lit("claude.ai conversation "), unknown(at("conversation_uuid"))))
        .when(kind.isin("github-issue", "github-pr"), F.coalesce(at("title"), F.lit("GitHub item")))
        .when(kind == "github-comment", F.concat(F.lit("GitHub comment in "), unknown(at("repo"))))
        .when(kind == "github-commit", F.concat(F.lit("GitHub commit "), unknown(at("sha"))))
        .when(kind.isin(*CODING), F.concat(kind, F.lit(" session "), unknown(at("session.id"))))
        .when(kind == "gmail", F.coalesce(at("subject"), F.lit("Gmail message")))
        .when(kind == "discord", F.coalesce(at("channel_name"), at("guild_name"), F.lit("Discord message")))
        .otherwise(F.coalesce(at("title"), F.col("subject")))
    )


def location() -> Column:
    kind = F.col("source_type")
    coding = F.when(at("item.kind") == "message", at("item.role")).when(at("item.kind") == "tool_call", F.concat(F.lit("tool:"), at("item.tool_name")))
    return (
        F.when(kind == "slack", at("user_name")).when(kind == "claude-ai", at("sender")).when(kind.startswith("github-"), at("object_type"))
        .when(kind.isin(*CODING), coding).when(kind == "gmail", at("from")).when(kind == "discord", at("author_name"))
    )


def container() -> Column:
    kind = F.col("source_type")
    return (
        F.when(kind == "slack", at("channel_name")).when(kind.startswith("github-"), at("repo")).when(kind == "claude-ai", at("conversation_uuid"))
        .when(kind.isin(*CODING), at("session.id")).when(kind == "gmail", at("account_id")).when(kind == "discord", at("channel_id")).otherwise(at("artifact.containerId"))
    )


def thread_key() -> Column:
    kind = F.col("source_type")
    return (
        F.when(kind == "slack", F.coalesce(at("thread_ts"), at("ts")))
        .when(kind == "claude-ai", F.concat(F.lit("claude-ai:conversation:"), at("conversation_uuid")))
        .when(kind.isin(*CODING), F.concat(kind, F.lit(":session:"), F.coalesce(at("session.parent_id"), at("session.id"))))
        .when(kind == "gmail", F.concat(F.lit("gmail:thread:"), at("thread_id")))
        .when(kind == "discord", F.concat(F.lit("discord:thread:"), F.coalesce(at("referenced_message_id"), at("message_id"))))
    )


#: Payload fields that the metadata of a source type repeats.
METADATA = {
    "gmail": ["account_id", "message_id", "thread_id", "from", "in_reply_to", "references"],
    "discord": ["channel_id", "message_id", "author_id", "guild_id", "referenced_message_id"],
}


def metadata() -> Column:
    """JSON of what a record can be found and fetched again by; fields that are not there are left out."""
    kind, coding = F.col("source_type"), F.col("source_type").isin(*CODING)
    keys = privacy_keys(F.col("subject"), F.col("meta"), F.col("payload"))
    fields = [
        F.col("id").alias("observation_id"), F.col("schema"), kind.alias("source_type"), F.coalesce(at("object_id", "meta"), F.col("id")).alias("source_object_id"),
        F.concat(F.array("subject"), F.array_remove(keys, F.col("subject"))).alias("privacy_keys"), F.col("source_system"), thread_key().alias("thread_key"), at("object_type").alias("object_type"), at("repo").alias("repo"),
    ]
    own = sorted({(f, k) for k, fs in METADATA.items() for f in fs})
    names = list(dict.fromkeys(f for f, _ in own))
    fields += [F.when(kind.isin(*[k for g, k in own if g == f]), at(f)).alias(f) for f in names if f != "message_id"]
    fields += [
        F.when(coding, F.coalesce(at("session_id"), at("session.id"))).alias("session_id"), F.when(coding, F.coalesce(at("parent_thread_id"), at("session.parent_id"))).alias("parent_session_id"),
        F.when(coding, F.coalesce(at("is_sidechain") == "true", F.lit(False))).alias("is_sidechain"), F.coalesce(F.when(coding, F.coalesce(at("object_id"), at("message.id"))), F.when(kind.isin(*[k for g, k in own if g == "message_id"]), at("message_id"))).alias("message_id"),
        F.when(coding, F.coalesce(at("parent_message_uuid"), at("parent_message_id"))).alias("parent_message_id"),
    ]
    return F.to_json(F.struct(*fields))


@dataclass(frozen=True)
class Config:
    channel_pattern: str = r"^\d{3}_"
    opted_in_channels: tuple[str, ...] = ()
    opted_out_people: tuple[str, ...] = ()
    exclude_bots: bool = True
    excluded_files: tuple[str, ...] = ()
    allowed_folders: tuple[str, ...] = ()
    least_sharing: str = "domain"
    exclude_form_response_sheets: bool = True


def _is_true(c: Column) -> Column:
    return F.coalesce(c == "true", F.lit(False))


def slack_allowed(config: Config) -> Column:
    """Public channels that are opted in or match the pattern; no bots, and nobody who opted out."""
    channel = F.coalesce(at("channel_name"), F.lit(""))
    allowed = _is_true(at("is_public_channel")) & at("channel_name").isNotNull()
    opted_in = F.coalesce(channel.isin(*config.opted_in_channels) | at("channel_id").isin(*config.opted_in_channels), F.lit(False)) if config.opted_in_channels else F.lit(False)
    allowed = allowed & (opted_in | channel.rlike(config.channel_pattern))
    if config.exclude_bots:
        allowed = allowed & ~_is_true(at("is_bot")) & ~F.coalesce(at("user_id").startswith("B"), F.lit(False))
    if config.opted_out_people:
        for name in ("user_id", "email", "user_name"):
            allowed = allowed & ~F.coalesce(at(name).isin(*config.opted_out_people), F.lit(False))
    return allowed


def drive_allowed(config: Config) -> Column:
    """Not excluded, in an allowed folder, and shared as widely as asked for; an unknown or private level is that of specific users."""
    parents = F.coalesce(F.from_json(at("metadata.parentIds"), "array<string>"), F.array().cast("array<string>"))
    level = F.coalesce(F.array_position(F.array(*map(F.lit, SHARING)), F.translate(at("metadata.sharingLevel"), "-", "_")), F.lit(0))
    inside = F.arrays_overlap(parents, F.array(*map(F.lit, config.allowed_folders))) if config.allowed_folders else F.lit(False)
    excluded = F.coalesce(at("artifact.sourceObjectId").isin(*config.excluded_files), F.lit(False)) if config.excluded_files else F.lit(False)
    return ~excluded & inside & (F.greatest(level, F.lit(1)) >= 1 + SHARING.index(config.least_sharing))


def linked_sheets(observations: DataFrame) -> DataFrame:
    """Ids of spreadsheets that hold a form's responses."""
    return observations.select(at("linkedSheetId").alias("sheet_id")).where("sheet_id is not null").distinct()


def corpus(observations: DataFrame, config: Config = Config()) -> DataFrame:
    """Corpus rows of observations that are already filtered for privacy; rows without text make none."""
    typed = observations.withColumn("source_type", source_type())
    drive = F.coalesce((F.col("schema") == "schema:workspace-object-snapshot") & (at("artifact.service") == "drive"), F.lit(False))
    content = F.col("schema") == "schema:form-response-content"
    typed = typed if "meta" in typed.columns else typed.withColumn("meta", F.lit("{}"))
    kept = typed.where(~content & F.when(F.col("source_type") == "slack", slack_allowed(config)).when(drive, drive_allowed(config)).otherwise(True))
    sheets = linked_sheets(observations)
    kept = kept.withColumn("file_id", at("artifact.sourceObjectId")).join(sheets, F.col("file_id") == F.col("sheet_id"), "left_anti")
    rows = kept.select(
        F.col("id").alias("record_id"), "source_type", anchor_url().alias("anchor_url"), title().alias("source_title"), location().alias("source_location"),
        F.col("published").alias("timestamp"), F.coalesce("published_nanos", F.unix_micros("published") * 1000).alias("ts_nanos"), text().alias("text"),
        thread_key().alias("thread_ts"), container().alias("container"), metadata().alias("metadata"),
    )
    return rows.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("normalized_text", nfkc("text"))
