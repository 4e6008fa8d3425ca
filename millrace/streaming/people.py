"""People kept by micro-batches: nodes that share identifiers unite, and their totals and consent unite with them.

A person's aggregate is a commutative monoid: numbers add up, times take the least or greatest, channels unite, the newest
decision wins. When components unite their aggregates do, so no fact is read again. Nodes are numbered as they first appear, and a
person's public name is its least node, so a person keeps the name when later nodes join. An identifier joins its
nodes, or is exclusive: a second node that claims it is an error, and nothing of the batch is taken in.

A batch reads and writes the buckets of what it touches: identifiers, nodes, and the rosters of components that it unites. All that
it changes is first written to a journal. A batch that runs again after a fault is applied from its journal, so sums count it once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.components import connected_components
from millrace.shared import materialize
from millrace.streaming.journal import Journal

FACTS = "node long, ident string, rule string, name string, n long, at timestamp, channel string, status string"


def merged(parts: DataFrame, key: str = "component") -> DataFrame:
    """Aggregates of each key: the monoid's sum of parts (nodes, n, first_at, last_at, channels, called, decision)."""
    return parts.groupBy(key).agg(
        F.sum("nodes").alias("nodes"), F.sum("n").alias("n"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("channels")))).alias("channels"), F.min("called").alias("called"), F.max("decision").alias("decision"))


def parts_of(facts: DataFrame) -> DataFrame:
    """Facts (with component) as parts of their component's aggregate, summed up before they are shuffled; nodes are counted elsewhere."""
    said = F.col("node").isNotNull()
    return facts.where(said).groupBy("component").agg(
        F.lit(0).cast("long").alias("nodes"), F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.array_sort(F.collect_set("channel")).alias("channels"),
        F.min(F.when(F.col("name").isNotNull(), F.struct("node", "name"))).alias("called"), F.max(F.lit(None).cast("struct<at: timestamp, status: string>")).alias("decision"))


class PeopleView:
    """facts: node (its number; null for a decision), ident, rule (joins or exclusive), name, n, at, channel, status (of a decision about an identifier)."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.journal = spark, Journal(spark, folder, {"claims": "ident", "members": "node", "rosters": "component", "people": "component"})

    def fold(self, batch: DataFrame, number: int = 0) -> None:
        self.journal.once(number, lambda: self._note(batch))

    def _note(self, batch: DataFrame) -> None:
        """Notes what a batch changes."""
        facts = materialize(batch.select(*[x.split()[0] for x in FACTS.split(", ")]), "facts")
        decided = F.max(F.when(F.col("status").isNotNull(), F.struct("at", "status"))).alias("decision")
        said = F.when(F.col("status").isNull(), F.col("node"))
        new = materialize(facts.where("ident is not null").groupBy("ident").agg(F.min(said).alias("lo"), F.max(said).alias("hi"), F.max("rule").alias("rule"), decided), "claims")
        old = self.journal.looked_up("claims", new.select("ident"), "ident string, owner long, rule string, decision struct<at: timestamp, status: string>")
        both = new.join(old.select("ident", "owner", F.col("rule").alias("old_rule"), F.col("decision").alias("old_decision")), "ident", "left")
        claims = both.select("ident", F.least("owner", "lo").alias("owner"), F.coalesce("old_rule", "rule").alias("rule"), F.greatest("decision", "old_decision").alias("decision"), "lo", "hi", F.col("owner").alias("before"))
        claims = materialize(claims, "claims")
        bad = claims.where((F.col("rule") == "exclusive") & (F.least("owner", "lo") < F.greatest("before", "hi"))).select("ident").limit(1).collect()
        if bad:
            raise ValueError(f"two nodes claim {bad[0].ident}")
        # Nodes, those that they are joined with, and the components of all of them.
        told = facts.where("status is null and node is not null")
        links = told.where("ident is not null").select("node", "ident").distinct().join(claims.where("rule = 'joins'").select("ident", F.coalesce("before", "owner").alias("to")), "ident")
        nodes = materialize(told.select("node").unionByName(claims.where("owner is not null").select(F.col("owner").alias("node"))).unionByName(claims.where("before is not null").select(F.col("before").alias("node"))).distinct(), "nodes")
        known = materialize(self.journal.looked_up("members", nodes, "node long, component long"), "known")
        placed = materialize(nodes.join(known, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.col("component").isNull().alias("fresh")), "placed")
        of = lambda c: placed.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
        joined = connected_components(links.select(F.col("node").alias("a"), F.col("to").alias("b")).join(of("a"), "a").join(of("b"), "b").select(F.col("a_of").alias("a"), F.col("b_of").alias("b")))
        moves = materialize(placed.select("component").distinct().join(joined.select(F.col("node").alias("component"), F.col("component").alias("now")), "component", "left").select("component", F.coalesce("now", "component").alias("now")), "moves")
        # Members of components that give way, and new ones, have the least node's name.
        rosters = self.journal.looked_up("rosters", moves.select("component"), "component long, node long")
        fresh = placed.where("fresh").select("component", "node")
        moved = materialize(rosters.unionByName(fresh).join(moves, "component").select(F.col("now").alias("component"), "node").distinct(), "moved")
        self.journal.change("claims", claims, claims.select("ident", "owner", "rule", "decision"))
        self.journal.change("members", moved, moved.select("node", "component"))
        self.journal.change("rosters", moves, moved)
        # Aggregates of components that unite, and what the batch adds to them.
        shape = "component long, nodes long, n long, first_at timestamp, last_at timestamp, channels array<string>, called struct<node: bigint, name: string>, decision struct<at: timestamp, status: string>"
        have = self.journal.looked_up("people", moves.select("component"), shape)
        now = placed.join(moves, "component").select("node", F.col("now").alias("component"))
        nothing = lambda c, t: F.lit(None).cast(t).alias(c)
        blank = {x.split(" ", 1)[0]: x.split(" ", 1)[1] for x in ("first_at timestamp", "last_at timestamp", "channels array<string>", "called struct<node: bigint, name: string>")}
        counted = placed.where("fresh").join(moves, "component").select(F.col("now").alias("component"), F.lit(1).cast("long").alias("nodes"), F.lit(0).cast("long").alias("n"), *[nothing(c, t) for c, t in blank.items()], nothing("decision", "struct<at: timestamp, status: string>"))
        heard = claims.where("decision is not null and owner is not null").join(now, F.col("owner") == F.col("node")).select("component", F.lit(0).cast("long").alias("nodes"), F.lit(0).cast("long").alias("n"), *[nothing(c, t) for c, t in blank.items()], "decision")
        parts = have.join(moves, "component").drop("component").withColumnRenamed("now", "component").unionByName(counted).unionByName(heard).unionByName(parts_of(told.join(now, "node")))
        self.journal.change("people", moves, merged(parts))

    def current(self) -> DataFrame | None:
        """person (its public name), nodes, n, first_at, last_at, channels, name (of the least node that has one), status (of the newest decision about its identifiers)."""
        rows = self.journal.tables["people"].read()
        if rows is None:
            return None
        return rows.select(F.concat(F.lit("person:component-"), "component").alias("person"), "nodes", "n", "first_at", "last_at", "channels", F.col("called.name").alias("name"), F.col("decision.status").alias("status"))

    def members(self) -> DataFrame | None:
        return self.journal.tables["members"].read()
