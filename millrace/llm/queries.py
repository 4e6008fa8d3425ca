"""The training-data queries over the given tables, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontaminate, langid, line_runs, media, packing, path_graph, pii, prefix_trie, repair, rollups, simhash, token_files, tokens, url_filter
from .conversation_sql import OP11_SQL, OP12_SQL


def op1_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.store_texts(common.table(spark, sf_dir, "documents")))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")
    return decontaminate.report(decontaminate.find(docs, benchmark))


OP2_SQL = r"""
WITH word_lists AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM word_lists WHERE len(w) > 0)),
docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
grams AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM docs, (SELECT DISTINCT size FROM wins) WHERE len(w) >= size)),
found AS (SELECT g.doc_id, g.i, g.size, x.item_id FROM grams g JOIN wins x ON g.size = x.size AND g.gram = x.gram),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_shards(spark, token_files.write_shards(common.table(spark, sf_dir, "documents"), common.new_path(spark, "token-files"), tokens.default_path()))


#: The versions of op4: the file of each, in tokenizers' or tiktoken's form.
VERSIONS = {"word-bpe@1": "word_bpe_49k.json", "byte-bpe-multi@2": "byte_bpe_multi_50k.tiktoken"}


def op4_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts every document's token count, revises those of other languages than English under a newer tokenizer, deletes toxic documents, and commits a batch twice, after a snapshot."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    (one, two), newer = VERSIONS, F.coalesce(F.col("lang") != "en", F.lit(False))
    counts = rollups.token_counts(docs.select("doc_id", "source", "lang", "text", F.col("text").alias("again")), tokens.path_of(VERSIONS[one]), "n1")
    counts = rollups.token_counts(counts.withColumnRenamed("again", "text"), tokens.path_of(VERSIONS[two]), "n2", newer)
    counts = common.materialize(counts, "counts")
    first, second, none = rollups.counted(one, F.col("n1")), rollups.counted(two, F.col("n2")), F.lit(None)
    toxic = counts.join(labels.where("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    store = rollups.RollupStore(spark, common.new_path(spark, "rollups"))
    store.commit("1 insert", counts.select(none.alias("before"), first.alias("after")))
    store.commit("2 revise", counts.where(newer).select(first.alias("before"), second.alias("after")))
    store.snapshot()
    store.commit("2 revise", counts.where(newer).select(first.alias("before"), second.alias("after")))
    store.commit("3 delete", toxic.select(F.when(newer, second).otherwise(first).alias("before"), none.alias("after")))
    return store.totals()


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(common.table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.digest(line_runs.remove_later_copies(common.table(spark, sf_dir, "documents")))


OP6_SQL = r"""
WITH raw AS (
  SELECT doc_id, i, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT doc_id, t AS line, i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents), LATERAL (SELECT unnest(parts) AS t, generate_subscripts(parts, 1) AS i))),
ls AS (
  SELECT doc_id, i, words, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line,
         row_number() OVER w AS pos, sum(words) OVER w AS upto FROM raw WHERE words > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
starts AS (
  SELECT a.doc_id, a.pos AS s, min(b.pos) AS e FROM ls a JOIN ls b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos AND a.pos + 49 AND b.upto - a.upto + a.words >= 50 GROUP BY ALL),
ends AS (
  SELECT b.doc_id, max(a.pos) AS s, b.pos AS e FROM ls a JOIN ls b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos AND a.pos + 49 AND b.upto - a.upto + a.words >= 50 GROUP BY b.doc_id, b.pos),
wins AS (SELECT * FROM starts UNION SELECT * FROM ends),
texts AS (
  SELECT w.doc_id, w.s, w.e, string_agg(l.line, chr(10) ORDER BY l.pos) AS run FROM wins w JOIN ls l ON l.doc_id = w.doc_id AND l.pos BETWEEN w.s AND w.e GROUP BY ALL),
later AS (SELECT doc_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS nth FROM texts) WHERE nth > 1),
gone AS (SELECT DISTINCT l.doc_id, l.i FROM ls l JOIN later x ON l.doc_id = x.doc_id AND l.pos BETWEEN x.s AND x.e),
fate AS (
  SELECT r.doc_id, r.i, r.line, r.words, last_value(CASE WHEN r.words > 0 THEN g.i IS NOT NULL END IGNORE NULLS) OVER (PARTITION BY r.doc_id ORDER BY r.i) AS drop_it
  FROM raw r LEFT JOIN gone g ON r.doc_id = g.doc_id AND r.i = g.i)
SELECT doc_id, count(*) FILTER (words > 0) AS n_lines, count(*) FILTER (words > 0 AND drop_it) AS n_gone,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT coalesce(drop_it, false)), '')) AS text_sha256
FROM fate GROUP BY doc_id
"""


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.table(spark, sf_dir, "documents"), tokens.default_path())


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.predict(docs, model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


RULES = [url_filter.Rule("block", "com", "/en/"), url_filter.Rule("allow", "example.com", "/en/7"), url_filter.Rule("allow", "net", "/de/"), url_filter.Rule("block", "example.net", "/de/8"), url_filter.Rule("block", "org", "/es/")]
#: Pages with such a title are junk: their canonical URLs make up the list.
JUNK = r"<title>[^<]*(%%%|###|\*\*\*)"


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    host, path = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    listed = pages.where(F.col("html").rlike(JUNK)).select(url_filter.canonical(host, path).alias("url"))
    return url_filter.judge(pages, listed, RULES).drop("possible_hit")


OP10_SQL = r"""
WITH parts AS (
  SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
split AS (
  SELECT page_id, html, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts),
canon AS (
  SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html|/+)$', '') AS c FROM split),
listed AS (SELECT DISTINCT c FROM canon WHERE regexp_matches(html, '<title>[^<]*(%%%|###|\*\*\*)') AND c <> ''),
rules(verdict, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
ruled AS (
  SELECT page_id, host, path, c, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS ruled
  FROM canon LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id, host, path, c)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN c IN (SELECT c FROM listed) THEN 'block' ELSE 'allow' END) AS verdict FROM ruled
"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rollup(common.table(spark, sf_dir, "conversations"))


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(common.table(spark, sf_dir, "conversations"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return path_graph.without_repeats(common.table(spark, sf_dir, "documents").select("doc_id", "text"), digest="kept_sha256").drop("text")


OP13_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
wins AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM wins WHERE g IN (SELECT g FROM wins GROUP BY g HAVING count(*) > 1)),
removed AS (SELECT r, count(*) AS n_removed FROM gone GROUP BY r),
kept AS (
  SELECT x.r, string_agg(word, ' ' ORDER BY x.k) AS text FROM (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM docs) x ANTI JOIN gone USING (r, k) GROUP BY x.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN removed USING (r) LEFT JOIN kept USING (r)
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_progressive_jpeg, op2_benchmark_decontamination, op3_token_files, op4_token_rollups, op5_pii, op6_line_dedup, op7_best_fit_packing, op8_simhash, op9_language_id, op10_url_filter, op11_prefix_trie, op12_structure_repair, op13_substring_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op2_benchmark_decontamination": OP2_SQL, "op6_line_dedup": OP6_SQL, "op10_url_filter": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op12_structure_repair": OP12_SQL, "op13_substring_dedup": OP13_SQL}