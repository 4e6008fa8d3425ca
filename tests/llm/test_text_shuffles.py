"""Texts that have no copy are not shuffled, also where no join can be broadcast."""

import random

import numpy as np
import pytest

from millrace.llm import common, line_runs, near_copies


def written(spark):
    """Bytes that this session's tasks have written to shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    return sc.statusStore().executorSummary("driver").totalShuffleWrite()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def texts(copies):
    r = random.Random(21)
    line = lambda: " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=90)) for _ in range(60))
    data = [(i, "\n".join(line() for _ in range(4))) for i in range(200)]
    return data + [(200 + k, copies(data[k][1])) for k in range(3)]


def check(spark, data, run):
    table = common.materialize(spark.createDataFrame(data, "doc_id long, text string").repartition(4), "docs")
    before = written(spark)
    found = {r.doc_id: r.text for r in run(table).collect()}
    assert written(spark) - before < sum(len(t) for _, t in data) / 2
    return found


def test_line_dedup_shuffles_texts_with_copies_alone(spark, no_broadcast):
    data = texts(lambda t: t.split("\n")[1] + "\nand more")
    found = check(spark, data, line_runs.remove_later_copies)
    assert found == dict(data) | {200 + k: "and more" for k in range(3)}


def test_near_dedup_shuffles_texts_with_copies_alone(spark, no_broadcast, monkeypatch):
    monkeypatch.setattr(near_copies, "frequent", lambda docs: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))  # its sample would be all of so few texts
    data = texts(lambda t: t + " and more")
    found = check(spark, data, near_copies.keep_one)
    assert found == dict(data[:200])


def test_possible_rows_include_all_that_match(spark):
    rows = spark.range(5000).selectExpr("id", "cast(null as string) as bloom_word")
    named = common.materialize(spark.range(0, 9000, 3).selectExpr("id"), "named")
    told = common.probed(rows, ["id"], named, "some")
    assert told.columns == ["id", "bloom_word", "some"] and told.count() == 5000
    hit = {r.id for r in told.where("some").collect()}
    assert hit >= set(range(0, 5000, 3)) and len(hit) < 2000
    assert told.count() == 5000 and common.probed(rows, ["id"], common.materialize(named.where("false"), "none"), "some").where("some").count() == 0


def test_line_dedup_plans_stay_small(spark, monkeypatch):
    """No plan of line dedup joins the windows of more than one depth: the driver keeps and renews a plan as a whole."""
    joins, write = [], common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, tag, **more: joins.append(df._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin")) or write(df, tag, **more))
    lines = [" ".join(f"w{i}x{j}" for j in range(7)) for i in range(40)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines[5:30])), (3, "\n".join(lines[::-1]))], "doc_id long, text string")
    done = {r.doc_id: r.n_gone for r in line_runs.remove_later_copies(docs).collect()}
    assert done == {1: 0, 2: 25, 3: 0}
    assert max(joins) <= 3
