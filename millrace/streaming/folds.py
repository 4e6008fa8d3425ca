"""Folds of events into states, kept by a stream: reply cards from drafts and events that arrive in any order, doubled or late.

Facts are kept as they arrive, by micro-batch and bucket of the draft. The cards that a batch touches are folded again from all facts of
theirs, in the order of events and with the fold of the batch operator, so an event that comes after later ones still has its
effect, and one that comes twice, by time and id, counts once. Nothing is held in a worker: a draft's events are sorted by Spark.
The stream's checkpoint tells what has been taken in: a restart goes on where it was, and a batch that runs again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.states import CARD_STATES, CARD_STEPS, fold
from millrace.shared import materialize
from millrace.streaming.views import Arrivals, Buckets, run_available


def fold_cards(facts: DataFrame, key: str) -> DataFrame:
    """The card of each draft in facts (key, kind, id, at_us, expires_us, event, arrival): key, state, updated_us, taken, expires_us. Of a draft or an event that comes again, the one that arrived last counts."""
    draft = F.col("kind") == "draft"
    drafts = facts.where(draft).groupBy(key).agg(F.max_by(F.struct("at_us", "expires_us"), "arrival").alias("draft"))
    events = facts.where(~draft).groupBy(key, "at_us", "id").agg(F.max_by(F.struct("event"), "arrival").alias("e"))
    told = events.where(F.col("e.event").isin(*CARD_STEPS)).select(key, "id", F.timestamp_micros("at_us").alias("at"), "e.event")  # others leave a state as it is
    folded = fold(told, key, ["id"], "event", CARD_STATES, CARD_STEPS, "pending", "at")
    state, updated = F.coalesce("state", F.lit("pending")), F.coalesce(F.unix_micros("updated"), "draft.at_us")
    return drafts.join(folded, key, "left").select(key, state.alias("state"), updated.alias("updated_us"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "draft.expires_us")


class CardsView:
    """The latest card of each draft, as the fold gives it; events of a draft that has not arrived wait for it. A batch that runs again writes the same rows."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "draft_id") -> None:
        self.spark, self.key, self.store = spark, key, Buckets(spark, f"{folder}/cards", key)
        self.arrivals = Arrivals(spark, f"{folder}/arrived", key)

    def fold(self, batch: DataFrame, number: int = 0) -> None:
        self.arrivals.take(batch, number)
        keys = materialize(batch.select(self.key).distinct(), "touched")
        now = fold_cards(self.arrivals.of(keys, batch, "arrival"), self.key)
        buckets = self.store.touched(keys)
        old = self.store.read(buckets)
        self.store.replace(buckets, old.join(keys, self.key, "left_anti").unionByName(now) if old is not None else now)

    def current(self, now: str) -> DataFrame | None:
        """draft_id, state, updated_at, taken, as of a time: a pending card that expires before it is expired."""
        rows = self.store.read()
        if rows is None:
            return None
        expired = (F.col("state") == "pending") & F.coalesce(F.timestamp_micros("expires_us") < F.to_timestamp(F.lit(now)), F.lit(False))
        return rows.select(self.key, F.when(expired, "expired").otherwise(F.col("state")).alias("state"), F.timestamp_micros("updated_us").alias("updated_at"), "taken")


def run_cards(facts: DataFrame, view: CardsView, checkpoint: str) -> None:
    """Folds what a stream of facts (draft_id, kind, id, at, expires_at, event) has by now into a view; goes on from its checkpoint."""
    key = view.key
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(f"{c}_us")
    rows = facts.where(F.col(key).isNotNull() & F.col("at").isNotNull()).select(key, "kind", F.coalesce("id", F.lit("")).alias("id"), micros("at"), micros("expires_at").alias("expires_us"), "event")
    run_available(rows, view.fold, checkpoint).awaitTermination()
