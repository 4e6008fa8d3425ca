"""The corpus pipeline: stages that each take all documents that the one before kept.

docs has doc_id and text, in any case, and any other columns, which all stages but the last return as they are. An empty
table passes through all stages. Null doc_ids come after all others where a stage prefers the least.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common, decontaminate, langid, line_runs, near_copies, packing, tokens


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognised; null texts and those without a letter go.

    Learns from labelled rows that are not held out; repeated rows are judged alike; without labelled rows nothing is kept.
    """
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.keep_identified(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated runs of lines; a document of which nothing is left goes, one without lines stays.

    Of repeated rows the first keeps its lines; n_chars, if there, follows the text.
    """
    total, gone = common.unused(docs, "lines_in_text"), common.unused(docs, "lines_gone")
    done = line_runs.remove_later_copies(docs, counts=(total, gone)).where((F.col(gone) == 0) | (F.col(gone) < F.col(total)))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.select(*[f"`{n}`" for n in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked fingerprints, and of those one of each group of similar texts.

    The least doc_id of a group stays, and one of repeated rows; all texts without words are of one group.
    """
    return near_copies.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs; those without words stay."""
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their place in a sequence; repeated rows and null texts are documents as well."""
    return packing.pack_documents(docs, tokens.default_path())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("best_fit_packing", best_fit_packing)]
#: SQL has neither the trained model nor the tokenizer; tests/llm compares every stage's rows with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialize(docs, f"stage-{name}")
    return docs
