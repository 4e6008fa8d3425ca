"""Inventories: labels in texts, imported history, source types and set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.keys import label_key, labels_in


def label_inventory(texts: DataFrame, person: str, text: str, order: str) -> DataFrame:
    """key (the label as label_key), label (as first seen), people, examples (the first five different values that are not empty, then sorted), most people first.

    A person counts once for a label, with the value of its first place, by (order, place in the text).
    """
    found = texts.select(F.col(person).alias("person"), F.col(order).alias("seen"), F.posexplode(labels_in(F.col(text))).alias("nth", "x"))
    rows = found.select("person", label_key(F.col("x.label")).alias("key"), F.struct("seen", "nth").alias("at"), "x.label", "x.value").where("key <> ''")
    firsts = rows.groupBy("key", "person").agg(F.min(F.struct("at", "label", "value")).alias("f"))
    people = firsts.groupBy("key").agg(F.count("*").alias("people"), F.min_by("f.label", "f.at").alias("label"))
    values = firsts.where("f.value <> ''").groupBy("key", "f.value").agg(F.min("f.at").alias("at"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("at"))
    examples = values.withColumn("r", nth).where("r <= 5").groupBy("key").agg(F.array_sort(F.collect_list("value")).alias("examples"))
    none = F.array().cast("array<string>")
    return people.join(examples, "key", "left").select("key", "label", "people", F.coalesce("examples", none).alias("examples")).orderBy(F.desc("people"), "label")


def import_inventory(records: DataFrame) -> DataFrame:
    """source, total, unique, duplicates, bytes, conflicts (identities with different digests) of records (source, identity, digest, bytes)."""
    each = records.groupBy("source", "identity").agg(F.count("*").alias("n"), F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.sum("bytes").alias("bytes"))
    return each.groupBy("source").agg(
        F.sum("n").alias("total"), F.count("*").alias("unique"), F.sum(F.col("n") - 1).alias("duplicates"), F.sum("bytes").alias("bytes"), F.sum((F.col("lo") != F.col("hi")).cast("long")).alias("conflicts")
    )


def overlaps(records: DataFrame) -> DataFrame:
    """Identities that more than one source has."""
    return records.groupBy("identity").agg(F.countDistinct("source").alias("sources")).where("sources > 1")


def type_counts(corpus: DataFrame, column: str = "source_type") -> DataFrame:
    return corpus.groupBy(column).agg(F.count("*").alias("records"))


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that were added and removed, with how."""
    return new.exceptAll(old).withColumn("change", F.lit("added")).unionByName(old.exceptAll(new).withColumn("change", F.lit("removed")))


def _pieces(text: Column, lengths: Column) -> Column:
    """The different substrings of a text that have one of some lengths."""
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, n))
    return F.array_distinct(F.flatten(F.transform(F.filter(lengths, lambda n: (n > 0) & (n <= F.length(text))), cut)))


def containing(long: DataFrame, short: DataFrame) -> DataFrame:
    """long with the rows of short whose k it contains (long: lk; short: k): an equi-join on the substrings of lk that have a length which occurs in short.

    Lengths are distinct small integers, gathered by aggregation into one row.
    """
    lengths = short.select(F.length("k").alias("n")).distinct().agg(F.array_sort(F.collect_list("n")).alias("lengths"))
    return long.crossJoin(F.broadcast(lengths)).withColumn("k", F.explode(_pieces(F.col("lk"), F.col("lengths")))).drop("lengths").join(short, "k")


def suggest_attributes(labels: DataFrame, attributes: DataFrame, top: int = 5) -> DataFrame:
    """The best attributes for each label: the sum of alias 100, equal name 90 and, if neither, a name within the other 50, and
    of an alias equal to the AI key 70; ties by name and id.

    labels: label, and an optional ai_key, which is then in the result; attributes: id, name, aliases. All scores come from equi-joins, those of
    containment on substrings: of labels (of 30 characters at most, as labels_in gives them) and of names. Empty keys contain nothing.
    """
    keys = [c for c in ("label", "ai_key") if c in labels.columns]
    names = attributes.select("id", "name", F.explode(F.concat(F.array(F.struct(label_key(F.col("name")).alias("k"), F.lit(90).alias("s"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(label_key(a).alias("k"), F.lit(100).alias("s"))))).alias("x"))
    names = names.select("id", "name", "x.k", "x.s")
    wanted = labels.select(*keys, label_key(F.col("label")).alias("lk")).distinct()
    found = wanted.join(names, F.col("lk") == F.col("k")).select(*keys, "id", "name", "s")
    own, asked = names.where("s = 90 and k <> ''").select("id", "name", "k"), wanted.where("lk <> ''")
    within = containing(asked, own).select(*keys, "id", "name")
    around = containing(own.withColumnRenamed("k", "lk"), asked.withColumnRenamed("lk", "k")).select(*keys, "id", "name")
    found = found.unionByName(within.unionByName(around).select(*keys, "id", "name", F.lit(50).alias("s")))
    if "ai_key" in keys:
        found = found.unionByName(wanted.join(names.where("s = 100"), label_key(F.col("ai_key")) == F.col("k")).select(*keys, "id", "name", F.lit(70).alias("s")))
    has = lambda n: F.max((F.col("s") == n).cast("int")) * n
    rules = found.groupBy(*keys, "id", "name").agg(*[has(n).alias(f"s{n}") for n in (100, 90, 50, 70)])
    equal = F.col("s100") + F.col("s90")
    best = rules.select(*keys, "id", "name", (F.when(equal > 0, equal).otherwise(F.col("s50")) + F.col("s70")).alias("score"))
    by = Window.partitionBy(*keys).orderBy(F.desc("score"), "name", "id")
    return best.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= top)
