"""Aggregating projections: freshness, heartbeats, sessions, state keys, person activity, replies, resume and plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def at(now: str) -> Column:
    return F.to_timestamp(F.lit(now))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Whole seconds from start to end: the difference is cut, not the times."""
    return F.timestamp_diff("SECOND", F.col(start) if isinstance(start, str) else start, F.col(end) if isinstance(end, str) else end)


def source_of() -> Column:
    """What an observation counts for: its channel if meta names one, else its source system."""
    return F.coalesce(F.nullif(F.trim(F.get_json_object("meta", "$.communication_channel_id")), F.lit("")), F.col("source_system"))


def freshness(observations: DataFrame, thresholds: DataFrame, now: str) -> DataFrame:
    """source, max_published, max_recorded, last_at, age_seconds, status for each configured source (source, max_age_seconds).

    Missing if the age is over the threshold, unobserved without an observation.
    """
    seen = observations.groupBy("source").agg(F.max("published").alias("max_published"), F.max("recorded_at").alias("max_recorded"))
    rows = thresholds.join(seen, "source", "left").withColumn("last_at", F.greatest("max_published", "max_recorded"))
    age = seconds_between("last_at", at(now))
    status = F.when(F.col("last_at").isNull(), "unobserved").when(age > F.col("max_age_seconds"), "missing").otherwise("fresh")
    return rows.select("source", "max_published", "max_recorded", "last_at", age.alias("age_seconds"), status.alias("status"))


def heartbeat_gaps(beats: DataFrame, seconds: int, key: str = "source", time: str = "received_at") -> DataFrame:
    """Consecutive heartbeats of a source that are more than so many seconds apart."""
    before = F.lag(time).over(Window.partitionBy(key).orderBy(time))
    gap = F.timestamp_diff("MICROSECOND", F.col("before"), F.col(time))
    return beats.withColumn("before", before).where(gap > seconds * 1_000_000).select(key, F.col("before").alias("gap_start"), F.col(time).alias("gap_end"), gap.alias("gap_micros"))


def sessions(entries: DataFrame) -> DataFrame:
    """A row for each session: how many entries, first and last time, sorted distinct surfaces and channels."""
    return entries.groupBy("session_ref").agg(
        F.count("*").alias("entries"),
        F.min("published_at").alias("first_at"),
        F.max("published_at").alias("last_at"),
        F.array_sort(F.collect_set("surface")).alias("surfaces"),
        F.array_sort(F.collect_set("channel")).alias("channels"),
    )


def timeline_order() -> Column:
    return F.struct("published_at", "ordinal", "cursor", "event_id")


def open_commitments(entries: DataFrame) -> DataFrame:
    """Commitments whose last status in timeline order is open."""
    last = entries.where("record_kind = 'commitment'").groupBy("record_key").agg(F.max_by(F.struct("record_status", "text", "published_at"), timeline_order()).alias("last"))
    return last.where("last.record_status = 'open'").select("record_key", "last.text", "last.published_at")


def current_state(entries: DataFrame) -> DataFrame:
    """Last text of each state key, with its size and digest."""
    last = entries.where("record_kind = 'current_state'").groupBy("record_key").agg(F.max_by("text", timeline_order()).alias("text"))
    return last.select("record_key", "text", F.octet_length("text").alias("bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


def person_activity(messages: DataFrame, edits: DataFrame) -> DataFrame:
    """person_id, messages, edits, first_at, last_at, channels from two relations (person_id, at, channel)."""
    both = messages.select("person_id", "at", "channel", F.lit(1).alias("m"), F.lit(0).alias("e")).unionByName(edits.select("person_id", "at", F.lit(None).cast("string").alias("channel"), F.lit(0).alias("m"), F.lit(1).alias("e")))
    return both.groupBy("person_id").agg(
        F.sum("m").alias("messages"), F.sum("e").alias("edits"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.array_sort(F.collect_set("channel")).alias("channels")
    )


def reply_latency(incoming: DataFrame, drafts: DataFrame, sends: DataFrame, now: str) -> DataFrame:
    """Incoming observations with the earliest send of a draft that answers them, latency and status.

    incoming: observation_id, published, due_at; drafts: draft_id, observation_id (first anchor);
    sends: draft_id (first anchor), sent_at. On time up to and with due_at; overdue only after it.
    """
    first = drafts.join(sends, "draft_id").groupBy("observation_id").agg(F.min("sent_at").alias("sent_at"))
    status = F.when(F.col("sent_at") <= F.col("due_at"), "sent_on_time").when(F.col("sent_at").isNotNull(), "sent_late").when(at(now) > F.col("due_at"), "overdue").otherwise("pending")
    latency = seconds_between("published", "sent_at")
    return incoming.join(first, "observation_id", "left").select("observation_id", "published", "due_at", "sent_at", latency.alias("latency_seconds"), status.alias("status"))


def overdue(latencies: DataFrame) -> DataFrame:
    return latencies.where(F.col("status").isin("overdue", "sent_late")).orderBy("due_at", "observation_id")


def timeline(slides: DataFrame, messages: DataFrame) -> DataFrame:
    """Both relations (kind, at, id, title), newest first."""
    return slides.unionByName(messages, allowMissingColumns=True).orderBy(F.col("at").desc(), "kind", "id")


def resume(supplementals: DataFrame) -> DataFrame:
    """project, last_activity, summary (latest that is not null), numbers and oldest times of parkings and open claims.

    supplementals: project, kind, id, created_at, text, state. The parkings and claims themselves are resume_items.
    """
    parking, claim = F.col("kind") == "parking@1", (F.col("kind") == "claim@1") & (F.col("state") == "open")
    return supplementals.groupBy("project").agg(
        F.max("created_at").alias("last_activity"),
        F.max_by(F.col("text"), F.when((F.col("kind") == "session-summary@1") & F.col("text").isNotNull(), F.struct("created_at", "id"))).alias("summary"),
        F.count_if(parking).alias("parkings"), F.min(F.when(parking, F.col("created_at"))).alias("oldest_parking"),
        F.count_if(F.coalesce(claim, F.lit(False))).alias("open_claims"), F.min(F.when(claim, F.col("created_at"))).alias("oldest_claim"),
    )


def resume_items(supplementals: DataFrame) -> DataFrame:
    """project, item (parking or open_claim), id, created_at, text, in order of time: rows, whatever their number."""
    item = F.when(F.col("kind") == "parking@1", "parking").when((F.col("kind") == "claim@1") & (F.col("state") == "open"), "open_claim")
    return supplementals.withColumn("item", item).where("item is not null").select("project", "item", "id", "created_at", "text").orderBy("project", "item", "created_at", "id")


def plan_state(resumes: DataFrame, decisions: DataFrame, now: str) -> DataFrame:
    """Projects of either side: numbers and oldest ages of open claims and parkings, and how many current decisions."""
    current = decisions.where("is_current").groupBy("project").agg(F.count("*").alias("decisions"), F.max("created_at").alias("last_decision"))
    age = lambda c: seconds_between(c, at(now))
    return resumes.join(current, "project", "full_outer").select(
        "project",
        F.coalesce("open_claims", F.lit(0)).alias("open_claims"),
        age("oldest_claim").alias("oldest_claim_seconds"),
        F.coalesce("parkings", F.lit(0)).alias("parkings"),
        age("oldest_parking").alias("oldest_parking_seconds"),
        F.coalesce("decisions", F.lit(0)).alias("decisions"),
        "last_decision",
    )


def health(checks: DataFrame) -> DataFrame:
    """The worst of unhealthy, degraded, ok."""
    rank = F.when(F.col("status") == "unhealthy", 2).when(F.col("status") == "degraded", 1).otherwise(0)
    return checks.agg(F.element_at(F.array(F.lit("ok"), F.lit("degraded"), F.lit("unhealthy")), F.coalesce(F.max(rank), F.lit(0)) + 1).alias("status"))


def watermark(corpus: DataFrame) -> DataFrame:
    return corpus.agg(F.coalesce(F.date_format(F.max("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit("empty")).alias("watermark"))


def fingerprint(rows: DataFrame) -> DataFrame:
    """Order-independent: the sum of the rows' SHA-256, by four 64-bit limbs, modulo 2**256, as hex; and the number of rows.

    Limbs add up exactly as decimals; carries are passed on in the one row of sums.
    """
    digest = F.sha2(F.to_json(F.struct(*sorted(rows.columns))).cast("binary"), 256)
    limbs = rows.select(*[F.conv(F.substring(digest, 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)").alias(f"l{i}") for i in range(4)])
    sums = limbs.agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(f"l{i}"), F.lit(0)).cast("decimal(38,0)").alias(f"l{i}") for i in range(4)])
    base = F.lit(str(1 << 64)).cast("decimal(38,0)")
    carry, parts = F.lit(0).cast("decimal(38,0)"), []
    for i in (3, 2, 1, 0):
        total = (F.col(f"l{i}") + carry).cast("decimal(38,0)")
        low = (total % base).cast("decimal(20,0)")
        parts.insert(0, F.lpad(F.lower(F.conv(low.cast("string"), 10, 16)), 16, "0"))
        carry = F.floor(total / base).cast("decimal(38,0)") if i else carry
    return sums.select("rows", F.concat(*parts).alias("fingerprint"))
