"""Ordered pages: keyset, offset and byte-budget pages. Every limit is the page itself, never a cap on the input."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def after_key(keys: list[tuple[str, bool]], values: list) -> Column:
    """Rows that come after values in the order of keys: (column, whether descending); mixed directions are allowed."""
    tests = []
    for i, (name, down) in enumerate(keys):
        same = [F.col(n) == F.lit(v) for (n, _), v in zip(keys[:i], values[:i], strict=True)]
        beyond = F.col(name) < F.lit(values[i]) if down else F.col(name) > F.lit(values[i])
        tests.append(reduce(lambda a, b: a & b, [*same, beyond]))
    return reduce(lambda a, b: a | b, tests)


def in_order(df: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    return df.orderBy(*[F.col(n).desc_nulls_last() if down else F.col(n).asc_nulls_first() for n, down in keys])


def keyset_page(df: DataFrame, keys: list[tuple[str, bool]], limit: int, after: list | None = None) -> DataFrame:
    """limit rows after a key; the plan is a filter (pushed to the scan) and a top-k, not a sort of all rows."""
    return in_order(df.where(after_key(keys, after)) if after else df, keys).limit(limit)


def page_and_next(df: DataFrame, keys: list[tuple[str, bool]], limit: int, after: list | None = None) -> tuple[list, list | None]:
    """The rows of a page and the key to go on after, None if the page is the last; reads one row more than the page."""
    rows = keyset_page(df, keys, limit + 1, after).collect()
    return rows[:limit], [rows[limit - 1][n] for n, _ in keys] if len(rows) > limit else None


def offset_page(df: DataFrame, keys: list[tuple[str, bool]], offset: int = 0, limit: int = 20) -> DataFrame:
    """At most 100 rows from an offset on."""
    return in_order(df, keys).offset(offset).limit(min(limit, 100))


def byte_budget_page(df: DataFrame, keys: list[tuple[str, bool]], budget: int, limit: int, after: list | None = None) -> DataFrame:
    """The longest prefix of a page whose JSON array, with commas and brackets, fits the budget; an error if no row fits."""
    page = keyset_page(df, keys, limit, after)
    size = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns]))) + 1
    order = Window.orderBy(*[F.col(n).desc() if down else F.col(n).asc() for n, down in keys])  # over one bounded page
    sized = page.withColumn("page_bytes", F.sum(size).over(order) + 1)
    first = sized.agg(F.min("page_bytes")).first()[0]
    if first is not None and first > budget:
        raise ValueError("not even the first row fits the budget")
    return sized.where(F.col("page_bytes") <= budget).drop("page_bytes")


def scan_after(df: DataFrame, seq: str, after: int, upto: int | None = None) -> DataFrame:
    """Rows past a position, up to a pinned watermark."""
    rows = df.where(F.col(seq) > after)
    return rows.where(F.col(seq) <= upto) if upto is not None else rows


def budgeted_rows(df: DataFrame, seq: str, after: int, watermark: int, most: int, scan: int | None = None) -> DataFrame:
    """A page of an export: in order of position, between a cursor and the watermark that the export pinned, and at most scan positions on."""
    upto = watermark if scan is None else min(watermark, after + scan)
    return scan_after(df, seq, after, upto).orderBy(seq).limit(most)


def merge_sorted(parts: list[DataFrame], keys: list[tuple[str, bool]], position: str | None = None) -> DataFrame:
    """All partitions of a relation in one order. With position (a row's place in its partition) a partition that is not in that order is an error."""
    for part in parts if position else []:
        now, last = (F.struct(*[F.col(n) for n, _ in keys]), F.lag(F.struct(*[F.col(n) for n, _ in keys])).over(Window.orderBy(position)))
        if not part.select(now.alias("now"), last.alias("last")).where("last > now").isEmpty():
            raise ValueError("a partition is not sorted")
    return in_order(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), keys)


def prefix_page(items: DataFrame, owners: list[str], prefix: str, limit: int, after: tuple[str, str] | None = None) -> DataFrame:
    """Materialized items of some owners whose sort_key starts with a prefix, by (sort_key, item_key)."""
    rows = items.where(F.col("owner_key").isin(owners) & F.col("sort_key").startswith(prefix))
    return keyset_page(rows, [("sort_key", False), ("item_key", False)], limit, list(after) if after else None)
