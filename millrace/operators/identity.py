"""Identity: candidates that share an identifier form persons; persons own observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.keys import name_key
from millrace.operators.components import connected_components


def star_edges(keyed: DataFrame, cross_source: bool = False) -> DataFrame:
    """a, b: the least candidate of each key with all others of it (candidate, source, key). Linear in the rows of a key.

    cross_source: candidates of one source are not linked by themselves. The least of one source is then
    linked with the least of every other, and all candidates of other sources with the least of the key.
    """
    keyed = keyed.where(F.col("key").isNotNull())
    if not cross_source:
        least = keyed.groupBy("key").agg(F.min("candidate").alias("a"))
        return keyed.join(least, "key").where("candidate <> a").select("a", F.col("candidate").alias("b"))
    by_source = keyed.groupBy("key", "source").agg(F.min("candidate").alias("m"))
    firsts = by_source.groupBy("key").agg(F.min(F.struct("m", "source")).alias("first"))
    second = by_source.join(firsts, "key").where(F.col("source") != F.col("first.source")).groupBy("key", "first").agg(F.min("m").alias("second"))
    linked = keyed.join(second, "key")  # keys of two sources or more
    to_first = linked.where(F.col("source") != F.col("first.source")).select(F.col("first.m").alias("a"), F.col("candidate").alias("b"))
    to_second = linked.where(F.col("source") == F.col("first.source")).select(F.col("second").alias("a"), F.col("candidate").alias("b"))
    return to_first.unionByName(to_second)


def persons(candidates: DataFrame, accepted: DataFrame | None = None, cross_source: bool = True) -> DataFrame:
    """candidate, person (least candidate): those that share an email, and accepted name pairs (a, b).

    candidates: candidate, source, email, name.
    """
    edges = star_edges(candidates.select("candidate", "source", F.nullif(F.lower(F.trim("email")), F.lit("")).alias("key")), cross_source)
    if accepted is not None:
        edges = edges.unionByName(accepted.select("a", "b"))
    found = connected_components(edges)
    return candidates.join(found, F.col("candidate") == F.col("node"), "left").select("candidate", F.coalesce("component", "candidate").alias("person"))


def name_pairs(candidates: DataFrame) -> DataFrame:
    """Medium pairs (a, b, key) to be accepted or not: for each name, the least candidate of each source, paired with that of the first source by name."""
    keyed = candidates.select("candidate", "source", F.nullif(name_key(F.col("name")), F.lit("")).alias("key")).where("key is not null")
    each = keyed.groupBy("key", "source").agg(F.min("candidate").alias("b"))
    first = each.groupBy("key").agg(F.min(F.struct("source", "b")).alias("first"))
    return each.join(first, "key").where(F.col("source") != F.col("first.source")).select(F.col("first.b").alias("a"), "b", "key")


def owned(identities: DataFrame, observations: DataFrame) -> DataFrame:
    """observation_id, person, role: identities (person, key) against keys of observations (observation_id, keys array<struct<key, role>>).

    A disjunction of equalities is an equi-join on exploded keys. An owner's claim beats an editor's; ties go to the least person.
    """
    keyed = observations.select("observation_id", F.explode("keys").alias("k")).select("observation_id", "k.key", "k.role")
    return keyed.join(identities, "key").groupBy("observation_id", "person").agg(F.max("role").alias("role"))


def best_profiles(profiles: DataFrame) -> DataFrame:
    """The profile of each person with the highest (richness, created_at, document_id)."""
    return profiles.groupBy("person").agg(F.max_by(F.struct("*"), F.struct("richness", "created_at", "document_id")).alias("p")).select("p.*")
