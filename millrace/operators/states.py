"""State machines folded over ordered events.

An event maps each state to the next one, and such maps compose associatively. Events of a key are
first composed within slices of a fixed number of ordered events, then the slices' maps within the key, so
that no array grows with a burst of events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Which states follow which. A state always may follow itself.
CLAIM_STATES = ["open", "dispatched", "verified", "refuted", "inconclusive", "terminated", "parked"]
CLAIM_NEXT = {
    "open": ["dispatched", "verified", "refuted", "inconclusive", "terminated", "parked"],
    "dispatched": ["verified", "refuted", "inconclusive", "terminated", "parked"],
    "inconclusive": ["dispatched", "terminated", "parked"],
    "parked": ["open", "dispatched", "terminated"],
    "verified": [],
    "refuted": [],
    "terminated": [],
}
VERDICTS = {"consistent": "verified", "inconsistent": "refuted", "inconclusive": "inconclusive"}

CARD_STATES = ["pending", "approved", "skipped", "sent"]
#: What each card event makes of each state; other events leave the state as it is.
CARD_STEPS = {
    "approved": {"pending": "approved"},
    "skipped": {"pending": "skipped"},
    "send_automatic": {"pending": "sent", "approved": "sent"},
    "send_approved": {"approved": "sent"},
}


def claim_steps() -> dict[str, dict[str, str]]:
    """Event (the state that it asks for) to the states from which it is taken."""
    return {to: {a: to for a in CLAIM_STATES if to == a or to in CLAIM_NEXT[a]} for to in CLAIM_STATES}


SLICE = 1024  # events of a key that are folded as one array


def _sliced(events: DataFrame, key: str, order: list[str], event: str, states: list[str], steps: dict[str, dict[str, str]], time: str) -> DataFrame:
    """key, slice, x (time, order, event, moves: the next state's number for each state, -1 if none): a key's ordered events in slices."""
    number = {s: i for i, s in enumerate(states)}
    table = F.create_map(*[x for e, by in steps.items() for x in (F.lit(e), F.array(*[F.lit(number[by[s]] if s in by else -1) for s in states]))])
    moves = F.coalesce(F.element_at(table, F.col(event)), F.array(*[F.lit(-1)] * len(states)))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(time, *order)) - 1  # sorted on disk, whatever a key's length
    return events.select(key, F.floor(nth / SLICE).alias("slice"), F.struct(time, *order, F.col(event).alias("event"), moves.alias("moves")).alias("x"))


def _start(i: Column) -> Column:
    return F.struct(i.cast("int").alias("state"), F.lit(0).cast("long").alias("taken"), F.lit(None).cast("timestamp").alias("updated"))


def _slices(rows: DataFrame, key: str, n: int, time: str) -> DataFrame:
    """key, slice, xs, ends (for each state at the start: state, taken, updated at the end), n."""

    def step(acc: Column, x: Column) -> Column:
        to = F.get(x["moves"], acc["state"])
        ok = to >= 0
        return F.struct(F.when(ok, to).otherwise(acc["state"]).alias("state"), (acc["taken"] + ok.cast("long")).alias("taken"), F.when(ok, x[time]).otherwise(acc["updated"]).alias("updated"))

    parts = rows.groupBy(key, "slice").agg(F.array_sort(F.collect_list("x")).alias("xs"), F.count("*").alias("n"))
    return parts.select(key, "slice", "xs", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.aggregate("xs", _start(i), step)).alias("ends"), "n")


def _compose(acc: Column, p: Column) -> Column:
    end = F.get(p["ends"], acc["state"])
    return F.struct(end["state"].alias("state"), (acc["taken"] + end["taken"]).alias("taken"), F.coalesce(end["updated"], acc["updated"]).alias("updated"))


def fold(events: DataFrame, key: str, order: list[str], event: str, states: list[str], steps: dict[str, dict[str, str]], start: str, time: str) -> DataFrame:
    """key, state, taken (events that were allowed), refused, updated (time of the last one taken).

    events are folded by (time, *order); an event that is not allowed in a state leaves it and is refused.
    """
    parts = _slices(_sliced(events, key, order, event, states, steps, time), key, len(states), time).select(key, F.struct("slice", "ends", "n").alias("part"))
    whole = parts.groupBy(key).agg(F.array_sort(F.collect_list("part")).alias("parts"), F.sum("part.n").alias("n"))  # one in SLICE events
    done = whole.withColumn("end", F.aggregate("parts", _start(F.lit(states.index(start))), _compose))
    return done.select(key, F.element_at(F.array(*map(F.lit, states)), F.col("end.state") + 1).alias("state"), F.col("end.taken").alias("taken"), (F.col("n") - F.col("end.taken")).alias("refused"), F.col("end.updated").alias("updated"))


def history(events: DataFrame, key: str, order: list[str], event: str, states: list[str], steps: dict[str, dict[str, str]], start: str, time: str) -> DataFrame:
    """Every event with the state before it: key, time, *order, event, from_state, to_state (null if refused), taken.

    Taken events are the history of a state, refused ones its audit. The state at the start of each slice comes from the
    composed slices before it.
    """
    names = F.array(*map(F.lit, states))
    parts = _slices(_sliced(events, key, order, event, states, steps, time), key, len(states), time)
    ends = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("slice", "ends"))).alias("all"))

    def append(acc: Column, p: Column) -> Column:
        return F.concat(acc, F.array(F.get(p["ends"], F.element_at(acc, -1))["state"]))

    starts = ends.select(key, F.posexplode(F.aggregate("all", F.array(F.lit(states.index(start))), append)).alias("slice", "begin"))
    rows = parts.select(key, "slice", "xs").join(starts.withColumn("slice", F.col("slice").cast("long")), [key, "slice"])

    def trace(acc: Column, x: Column) -> Column:
        to = F.get(x["moves"], acc["state"])
        out = F.struct(x.alias("x"), acc["state"].alias("from"), to.alias("to"))
        return F.struct(F.when(to >= 0, to).otherwise(acc["state"]).alias("state"), F.concat(acc["out"], F.array(out)).alias("out"))

    kind = f"array<struct<x:{rows.schema['xs'].dataType.elementType.simpleString()},from:int,to:int>>"
    traced = rows.select(key, F.explode(F.aggregate("xs", F.struct(F.col("begin").alias("state"), F.array().cast(kind).alias("out")), trace)["out"]).alias("t"))
    to = F.col("t.to")
    return traced.select(key, *[F.col(f"t.x.{c}").alias(c) for c in (time, *order, "event")], F.element_at(names, F.col("t.from") + 1).alias("from_state"), F.when(to >= 0, F.element_at(names, F.greatest(to, F.lit(0)) + 1)).alias("to_state"), (to >= 0).alias("taken"))


def claim_states(events: DataFrame, key: str = "claim_id", time: str = "created_at") -> DataFrame:
    """State of each claim from its events (claim_id, id, created_at, to_state), by (created_at, id)."""
    return fold(events, key, ["id"], "to_state", CLAIM_STATES, claim_steps(), "open", time)


def event_target(kind: Column, to_state: Column, verdict: Column) -> Column:
    """The state that a transition or a verification result asks for; null if it is not one."""
    named = F.when(to_state.isin(*CLAIM_STATES), to_state)
    verdicts = F.create_map(*[F.lit(x) for v, s in VERDICTS.items() for x in (v, s)])
    return F.when(kind == "claim-transition@1", named).when(kind == "verification-result@1", F.element_at(verdicts, verdict))


def card_event(kind: Column, decision: Column, mode: Column) -> Column:
    return F.when(kind == "reply-approval@1", F.when(decision.isin("approved", "skipped"), decision)).when(kind == "send-record@1", F.when(mode.isin("automatic", "approved"), F.concat(F.lit("send_"), mode)))


def cards(drafts: DataFrame, events: DataFrame, now: str) -> DataFrame:
    """Reply cards: drafts (draft_id, created_at, expires_at) with their state after events (draft_id, id, created_at, event).

    A pending card whose expires_at lies before now is expired. Events of unknown drafts make no card.
    """
    known = events.join(drafts.select("draft_id"), "draft_id", "left_semi")
    folded = fold(known, "draft_id", ["id"], "event", CARD_STATES, CARD_STEPS, "pending", "created_at")
    state = F.coalesce("state", F.lit("pending"))
    expired = (state == "pending") & F.coalesce(F.col("expires_at") < F.to_timestamp(F.lit(now)), F.lit(False))
    return drafts.join(folded, "draft_id", "left").select("draft_id", F.when(expired, "expired").otherwise(state).alias("state"), F.coalesce("updated", "created_at").alias("updated_at"), F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("refused", F.lit(0)).alias("refused"))


def unknown_anchors(events: DataFrame, drafts: DataFrame) -> DataFrame:
    """The audit of events that anchor no known draft."""
    return events.join(drafts.select("draft_id"), "draft_id", "left_anti").withColumn("audit", F.lit("unknown_draft_anchor"))


def claim_members(claims: DataFrame) -> DataFrame:
    """id, claim_id (the representative: first by (created_at, id)), kind, anchors, payload_hash of every claim.

    claims: id, kind, anchors (array), payload_hash, created_at. Claims are copies if kind, the set of anchors and the
    canonical payload are equal. A large group of copies is rows, not an array.
    """
    same = ["kind", "anchors", "payload_hash"]
    rows = claims.withColumn("anchors", F.array_sort(F.array_distinct("anchors")))
    firsts = rows.groupBy(*same).agg(F.min(F.struct("created_at", "id")).alias("first"))
    return rows.join(firsts, same).select("id", F.col("first.id").alias("claim_id"), *same, F.col("first.created_at").alias("created_at"))


def dedup_claims(claims: DataFrame) -> DataFrame:
    """Representatives of copies (see claim_members), with how many claims each absorbs."""
    by = claims.groupBy("kind", F.array_sort(F.array_distinct("anchors")).alias("anchors"), "payload_hash")
    grouped = by.agg(F.min(F.struct("created_at", "id")).alias("first"), F.count("*").alias("n"))
    return grouped.select(F.col("first.id").alias("claim_id"), "kind", "anchors", "payload_hash", F.col("first.created_at").alias("created_at"), (F.col("n") - 1).alias("absorbed"))


def claim_events(events: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events (id, created_at, claims: array of anchored ids, ...) once for each representative that they reach through copies, as claim_id; and the audit of those that reach none or ask for no state."""
    rows = events.join(events.select("id", F.explode("claims").alias("anchor")).join(members.select(F.col("id").alias("anchor"), "claim_id"), "anchor").select("id", "claim_id").distinct(), "id", "left")
    why = F.when(F.col("claim_id").isNull(), "missing_claim_anchor").when(F.col("to_state").isNull(), "invalid_state_event")
    judged = rows.withColumn("audit", why)
    return judged.where("audit is null").drop("audit"), judged.where("audit is not null").select("id", "claim_id", "audit")


def claim_history(events: DataFrame, members: DataFrame) -> DataFrame:
    """claim_id, id, created_at, from_state, to_state, audit: every event of every claim; audit is null for those that were taken."""
    good, audit = claim_events(events, members)
    done = history(good, "claim_id", ["id"], "to_state", CLAIM_STATES, claim_steps(), "open", "created_at")
    done = done.select("claim_id", "id", "created_at", "from_state", F.col("event").alias("to_state"), F.when(~F.col("taken"), "invalid_transition").alias("audit"))
    return done.unionByName(audit.join(events.select("id", "created_at", "to_state"), "id"), allowMissingColumns=True)


def card_audit(drafts: DataFrame, events: DataFrame) -> DataFrame:
    """draft_id, id, audit of card events that change nothing and may not: unknown drafts, sends without or from a wrong state, approvals of no known decision.

    An approval that comes after another one is no fault.
    """
    known = events.join(drafts.select("draft_id"), "draft_id", "left_semi")
    done = history(known.withColumn("asked", F.concat_ws("|", "kind", F.coalesce("event", F.lit("?")))), "draft_id", ["id"], "asked", CARD_STATES, {f"{k}|{e}": by for e, by in CARD_STEPS.items() for k in ("reply-approval@1", "send-record@1")}, "pending", "created_at")
    approval, malformed = F.col("event").startswith("reply-approval@1"), F.col("event").endswith("|?")
    why = F.when(approval & malformed & (F.col("from_state") == "pending"), "malformed_approval").when(~approval & malformed, "malformed_send_record").when(~approval & ~F.col("taken"), "invalid_send_transition")
    return done.withColumn("audit", why).where("audit is not null").select("draft_id", "id", "audit").unionByName(unknown_anchors(events, drafts).select("draft_id", "id", "audit"))


def claim_groups(claims: DataFrame) -> DataFrame:
    """group_id (SHA-256 of the JSON array of the sorted source references), claims, first_claim: claims are counted, never gathered."""
    return claims.groupBy(group_id(F.col("source_refs")).alias("group_id")).agg(F.count("*").alias("claims"), F.min("claim_id").alias("first_claim"))


def group_id(source_refs: Column) -> Column:
    """The group of a claim, as a column of its own row."""
    return F.sha2(F.to_json(F.array_sort(F.array_distinct(source_refs))).cast("binary"), 256)
