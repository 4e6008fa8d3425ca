"""Text search over corpus rows: grep with filters and keyset pages, n-gram candidates, exact and prefix lookups."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import paging


@dataclass(frozen=True)
class Filters:
    """Empty lists filter nothing; a row without container fails a list of channels or containers."""

    source_types: tuple[str, ...] = ()
    since: str | None = None
    until: str | None = None
    channels: tuple[str, ...] = ()
    containers: tuple[str, ...] = field(default=())

    def condition(self) -> Column:
        tests = []
        if self.source_types:
            tests.append(F.col("source_type").isin(*self.source_types))
        if self.since:
            tests.append(F.col("timestamp") >= F.to_timestamp(F.lit(self.since)))
        if self.until:
            tests.append(F.col("timestamp") <= F.to_timestamp(F.lit(self.until)))
        if self.channels:
            tests.append(F.coalesce(F.col("container").isin(*self.channels), F.lit(False)))
        if self.containers:
            tests.append(F.coalesce(F.col("container").isin(*self.containers), F.lit(False)))
        return reduce(lambda a, b: a & b, tests, F.lit(True))


ORDERS = {"date_desc": [("timestamp", True), ("record_id", False)], "date_asc": [("timestamp", False), ("record_id", False)]}


def grep(corpus: DataFrame, pattern: str, filters: Filters = Filters(), order: str = "date_desc", limit: int = 100, after: list | None = None, searched: str = "text") -> DataFrame:
    """A page of the rows that match a pattern; filters, match and key are one filter below a top-k."""
    found = corpus.where(filters.condition() & T.matches(F.col(searched), pattern))
    return paging.keyset_page(found, ORDERS[order], limit, after)


def with_matches(page: DataFrame, pattern: str, searched: str = "text", raw: str = "text") -> DataFrame:
    """A page with match ranges (UTF-8 bytes of the searched text) and a snippet of the raw text.

    The page's rows alone reach Python: its limit stays a top-k below, which a Python column would turn into a sort of all rows.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in page.schema)
    return page.mapInArrow(T.matched(pattern, page.columns.index(raw), page.columns.index(searched)), f"{fields}, {T.MATCHED}")


def write_ngram_index(corpus: DataFrame, path: str, searched: str = "text", width: int = 3, buckets: int = 64) -> None:
    """Postings (ngram, record_id) of the distinct n-grams of each row, in folders by a hash of the n-gram."""
    rows = corpus.select("record_id", F.explode(T.ngrams(F.col(searched), width, width)).alias("ngram"))
    placed = rows.withColumn("bucket", F.pmod(F.hash("ngram"), F.lit(buckets)))
    placed.repartition("bucket", F.pmod(F.hash("record_id"), F.lit(8))).sortWithinPartitions("bucket", "ngram").write.partitionBy("bucket").parquet(path)


def rarest(spark: SparkSession, path: str, term: str, most: int = 3, width: int = 3, buckets: int = 64) -> list[str]:
    """Of the n-grams that every match of a term holds, those in the fewest rows; only their buckets are read."""
    grams = [g for g in T.literal_ngrams(term, width) if len(g) == width]
    found = postings(spark, path, grams, buckets).groupBy("ngram").agg(F.count("*").alias("df")).collect()  # a row for each n-gram of a term
    df = {r["ngram"]: r["df"] for r in found}
    return sorted(grams, key=lambda g: (df.get(g, 0), g))[:most]


def postings(spark: SparkSession, path: str, grams: list[str], buckets: int = 64) -> DataFrame:
    """Postings of some n-grams: the filter on bucket prunes folders, that on ngram row groups."""
    table = spark.read.parquet(path)
    if not grams:
        return table.where("false")
    wanted = spark.range(1).select(*[F.pmod(F.hash(F.lit(g)), F.lit(buckets)) for g in grams]).first()
    return table.where(F.col("bucket").isin([*{*wanted}]) & F.col("ngram").isin(grams))


def candidates(corpus: DataFrame, path: str, pattern: str, most: int = 3) -> DataFrame:
    """Rows that can match: they hold the rarest n-grams of every literal term. grep() on them verifies."""
    spark = corpus.sparkSession
    needed = sorted({g for t in T.split_terms(pattern) for g in rarest(spark, path, t, most)})
    if not needed:
        return corpus
    ids = postings(spark, path, needed).groupBy("record_id").agg(F.count("*").alias("n")).where(F.col("n") == len(needed))
    return corpus.join(ids, "record_id", "left_semi")


EXACT = ("record_id", "source_object_id", "thread_key", "session_id", "source_type", "container")


def exact(corpus: DataFrame, column: str, value: str, limit: int = 100, after: list | None = None) -> DataFrame:
    if column not in EXACT:
        raise ValueError(f"not an exact field: {column}")
    return paging.keyset_page(corpus.where(F.col(column) == value), ORDERS["date_desc"], limit, after)


def decision_search(decisions: DataFrame, query: str, columns: list[str], order: list[tuple[str, bool]], limit: int = 20) -> DataFrame:
    """Normal form KC and lower case; all terms if there are several, else the whole query as a substring."""
    hay = F.lower(T.nfkc(F.concat_ws("\n", *columns)))
    terms = [t for t in query.split() if t]
    wanted = terms if len(terms) > 1 else [query]
    return paging.keyset_page(decisions.where(reduce(lambda a, b: a & b, [hay.contains(F.lower(T.nfkc(F.lit(t)))) for t in wanted])), order, limit)


def lower_search(rows: DataFrame, query: str, column: str, order: list[tuple[str, bool]], limit: int = 20) -> DataFrame:
    """Lower-case substring search, as over history entries."""
    return paging.keyset_page(rows.where(F.lower(column).contains(query.lower())), order, limit)


def resolve_links(urls: DataFrame, records: DataFrame) -> DataFrame:
    """url, record_id of the newest record whose anchor_url is a prefix of the url (null if none).

    The prefix join is an equi-join: each url is exploded into its prefixes of the lengths that anchors
    have (lengths are distinct small integers, gathered by aggregation), so no pairs of rows are compared.
    """
    lengths = records.select(F.length("anchor_url").alias("n")).distinct().agg(F.array_sort(F.collect_list("n")).alias("lengths"))
    newest = records.where("anchor_url is not null and anchor_url <> ''").groupBy("anchor_url").agg(F.min(F.struct((-F.unix_micros("timestamp")).alias("age"), "record_id")).alias("best"))
    prefixes = urls.select("url").distinct().crossJoin(F.broadcast(lengths)).select("url", F.explode(F.filter("lengths", lambda n: n <= F.length("url"))).alias("n"))
    found = prefixes.withColumn("anchor_url", F.expr("substring(url, 1, n)")).join(newest, "anchor_url").groupBy("url").agg(F.min("best").alias("best"))
    return urls.join(found, "url", "left").select(*urls.columns, F.col("best.record_id").alias("record_id"))


def thread(corpus: DataFrame, thread_ts: str, newest_first: bool = True, limit: int = 100) -> DataFrame:
    return paging.keyset_page(corpus.where(F.col("thread_ts") == thread_ts), ORDERS["date_desc" if newest_first else "date_asc"], limit)
