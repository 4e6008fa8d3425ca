"""URL filters: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

The filter has one 64-bit word for each block; a URL's hash picks a block and sets four bits in its
word. It is built by a grouped bitwise OR, so no task holds more than partial words, and a page passes
as a possible hit if its block has all its bits. Only possible hits take part in the exact join with
the list, which removes false positives. All of it is DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(_lower_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without www. or m. before it, and path without a trailing .html or slashes; query and fragment are gone."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html|/+)$", ""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits (host and all its subdomains, path by prefix), and its verdict."""
    ordered = sorted(rules, key=lambda r: (-len(r.host + r.path), r.host + r.path))
    fits = [((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path) for r in ordered]
    name = F.coalesce(*[F.when(f, F.lit(r.host + r.path)) for f, r in zip(fits, ordered, strict=True)], F.lit(None).cast("string"))
    verdict = F.coalesce(*[F.when(f, F.lit(r.verdict)) for f, r in zip(fits, ordered, strict=True)], F.lit(None).cast("string"))
    return name, verdict


def judge(pages: DataFrame, listed: DataFrame, rules: list[Rule], most_blocks: int = 1 << 17) -> DataFrame:
    """page_id, host, path, rule, verdict, possible_hit of every row of pages (page_id, url).

    listed: url, a canonical URL each; repeats and nulls in it do no harm. A page that fits a rule has
    the rule's verdict; else it is blocked if its canonical URL is listed, and allowed if not. A null
    url has empty host and path and is never listed; repeated pages are judged alike; an empty list blocks nothing.
    Other columns of pages are not read, and the pages are read once: what the filter tells of them is written to a
    table, of which possible hits alone take part in the exact join. The filter's table has at most most_blocks rows
    whatever the list's size (a longer list lets more pages through to that join), so it is broadcast; the list
    itself never is by request.
    """
    listed = common.materialize(listed.select("url").where("url <> ''").distinct(), "listed-urls")
    words, blocks = common.bloom(listed.select(F.xxhash64(F.lit("bloom"), "url").alias("bloom_hash")), listed.count(), most_blocks)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled"), canonical(F.col("host"), F.col("path")).alias("canonical"))
    base = base.withColumn("bloom_hash", F.xxhash64(F.lit("bloom"), "canonical"))
    block, bits = common.bloom_place(F.col("bloom_hash"), blocks)
    probed = base.withColumns({"block": block, "bits": bits}).join(F.broadcast(words), "block", "left")
    hit = F.coalesce(F.col("word").bitwiseAND(F.col("bits")) == F.col("bits"), F.lit(False)) & F.col("ruled").isNull()
    probed = common.materialize(probed.select("page_id", "host", "path", "rule", "ruled", F.when(hit, F.col("canonical")).alias("canonical"), hit.alias("possible_hit")), "probed-urls")
    out = ["page_id", "host", "path", "rule"]
    maybe = probed.where("possible_hit").join(listed.select(F.col("url").alias("canonical"), F.lit(True).alias("is_listed")), "canonical", "left")
    maybe = maybe.select(*out, F.when(F.col("is_listed"), "block").otherwise("allow").alias("verdict"), "possible_hit")
    rest = probed.where("not possible_hit").select(*out, F.coalesce("ruled", F.lit("allow")).alias("verdict"), "possible_hit")
    return rest.unionByName(maybe)
