"""Graph operators: source roots, superseding decisions, session trees, and the order of projections."""

from __future__ import annotations

from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.shared import materialize


def terminal_of(links: DataFrame, id: str = "id", next: str = "next") -> DataFrame:
    """id, terminal, hops: where the chain from each id ends; terminal is null on a cycle or a chain into one.

    Pointer doubling: each round doubles the hops, so a chain of n links takes log2(n) rounds. links has one next for each id.
    """
    nodes = links.select(F.col(id).alias("id"), F.col(next).alias("next")).where("next is not null")
    table = materialize(nodes.select("id", F.col("next").alias("at"), F.lit(1).cast("long").alias("hops")), "chain")
    total = table.count()
    span = 1
    while True:
        ahead = table.select(F.col("id").alias("at"), F.col("at").alias("at2"), F.col("hops").alias("hops2"))
        moved = table.join(ahead, "at", "left")
        table = materialize(moved.select("id", F.coalesce("at2", "at").alias("at"), (F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops")), "chain")
        on = table.join(nodes.select(F.col("id").alias("at")), "at", "left_semi")
        span *= 2
        left = on.count()
        if left == 0 or span > total:
            break
    cyclic = on.select("id", F.lit(True).alias("cyclic"))
    return table.join(cyclic, "id", "left").select("id", F.when(F.col("cyclic").isNull(), F.col("at")).alias("terminal"), F.when(F.col("cyclic").isNull(), F.col("hops")).alias("hops"))


def superseded(decisions: DataFrame) -> DataFrame:
    """id, replaced_by (newest that names it), terminal, is_current for decisions (id, created_at, supersedes array)."""
    newer = decisions.select(F.explode("supersedes").alias("old"), F.struct("created_at", "id").alias("by")).groupBy("old").agg(F.max("by").alias("by"))
    links = newer.join(decisions.select(F.col("id").alias("old")), "old", "left_semi").select(F.col("old").alias("id"), F.col("by.id").alias("next"))
    ends = terminal_of(links)
    return decisions.join(links, "id", "left").join(ends, "id", "left").select("id", F.col("next").alias("replaced_by"), "terminal", F.col("next").isNull().alias("is_current"))


def source_roots(supplementals: DataFrame) -> DataFrame:
    """id, roots: the observations at the end of all derivation paths, or the direct anchors if there are none.

    supplementals: id, observations (array), parents (array of supplementals). Round k adds the roots of the ancestors 2**k links
    above, whose pairs are doubled in turn: a chain of n links takes log2(n) rounds of n pairs, and pairs of all ancestors
    are never held. A round that adds no root is the last, with cycles too: a root that is farther away would be new to a node nearer to it.
    """
    jumps = supplementals.select("id", F.explode("parents").alias("at")).where("at is not null")
    roots = supplementals.select("id", F.explode("observations").alias("root")).where("root is not null")
    before, now = -1, 0
    while True:
        ahead = roots.select(F.col("id").alias("at"), "root", F.lit(None).cast(jumps.schema["at"].dataType).alias("at2"))
        ahead = ahead.unionByName(jumps.select(F.col("id").alias("at"), F.lit(None).cast(roots.schema["root"].dataType).alias("root"), F.col("at").alias("at2")))
        steps = materialize(jumps.join(ahead, "at").select("id", "root", "at2"), "steps")  # one join adds roots and doubles links
        roots = roots.unionByName(steps.where("root is not null").select("id", "root"))
        jumps = steps.where("at2 is not null").select("id", F.col("at2").alias("at"))
        if jumps.isEmpty():  # no link goes on: copies of roots fall together below
            break
        roots, jumps = materialize(roots.distinct(), "roots"), materialize(jumps.distinct(), "jumps")
        before, now = now, roots.count()
        if now == before:
            break
    found = roots.groupBy("id").agg(F.array_sort(F.collect_set("root")).alias("roots"))
    direct = F.array_sort(F.array_distinct(F.concat("observations", "parents")))
    return supplementals.join(found, "id", "left").select("id", F.coalesce("roots", direct).alias("roots"))


def session_tree(parents: DataFrame) -> DataFrame:
    """session, root, depth of coding sessions (session, parent); a cycle is an error."""
    ends = terminal_of(parents, "session", "parent")
    if not ends.where("terminal is null").isEmpty():
        raise ValueError("a cycle of sessions")
    joined = parents.join(ends, F.col("session") == F.col("id"), "left")
    return joined.select("session", F.coalesce("terminal", "session").alias("root"), F.coalesce("hops", F.lit(0)).alias("depth"))


def projection_order(sources: dict[str, list[str]]) -> list[str]:
    """Projections so that each comes after its sources; a cycle is an error."""
    try:
        return [*TopologicalSorter(sources).static_order()]
    except CycleError as e:
        raise ValueError(f"cycle of projections: {e.args[1]}") from e


def dependents(sources: dict[str, list[str]], of: str) -> set[str]:
    out: set[str] = set()
    todo = [of]
    while todo:
        now = todo.pop()
        more = {p for p, s in sources.items() if now in s} - out
        out |= more
        todo += more
    return out
