"""Semantics that the driver tables do not reach, each against a small brute-force version."""

import datetime
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import keys
from millrace.functions import text as T
from millrace.operators import activity, append, components, corpus, graph, identity, ingest, inventory, lake, paging, privacy, search, states, workspace
from millrace.sources import documents, messages, snapshots
from millrace.streaming import folds, journal, people, views
from tests.conftest import SF


def test_terms_and_patterns(spark):
    assert T.split_terms("a  b") == ["a", "b"] and T.split_terms(" ab ") == [" ab "] and T.split_terms("") == [""]
    assert not T.is_portable(r"(a)\1") and not T.is_portable("(?=a)") and T.is_portable(r"a\\1")
    with pytest.raises(ValueError):
        T.matches(F.col("t"), r"(a)\1")
    df = spark.createDataFrame([("x(y z",), ("xy z",)], "t string")
    assert [r.t for r in df.where(T.matches(F.col("t"), "(y z")).collect()] == ["x(y z"]


def test_ranges_are_utf8_bytes_and_snippets_fit(spark):
    text = "é" * 300 + "needle" + "z" * 300
    row = search.with_matches(spark.createDataFrame([(text,), (None,)], "t string"), "needle", "t", "t").select(F.col("ranges").alias("r"), F.col("snippet").alias("s")).collect()
    assert [(x.start, x.end) for x in row[0].r] == [(600, 606)]
    assert len(row[0].s) == 240 and row[0].s.startswith("...") and row[0].s.endswith("...") and "needle" in row[0].s
    assert row[1].r is None and row[1].s is None
    many = search.with_matches(spark.createDataFrame([("a" * 50,)], "t string"), "a", "t", "t").first()
    assert len(many.ranges) == 20 and many.snippet == "a" * 50
    plan = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").cast("string").alias("record_id"), "text", F.timestamp_seconds("doc_id").alias("timestamp"))
    text = search.with_matches(search.grep(plan, "th[a-z]+ing"), "th[a-z]+ing")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=100" in text and text.index("MapInArrow") < text.index("TakeOrderedAndProject") and "rangepartitioning" not in text  # the top-k is below Python


def slow_snippet(text, hit):
    """All windows of the budget, by the marks that they need: the one whose marks agree."""
    n = len(text)
    if n <= 240:
        return text
    found = []
    for marks in ((a, b) for a in (False, True) for b in (False, True)):
        body = 240 - 3 * sum(marks)
        start = max(0, hit - body // 2)
        if start + body > n:
            start = n - body
        if (start > 0, start + body < n) == marks:
            found.append("..." * marks[0] + text[start : start + body] + "..." * marks[1])
    assert found
    return found[0]


def test_snippets_at_all_places():
    for n in (200, 240, 241, 300, 600):
        text = "".join(chr(97 + i % 26) for i in range(n))
        for hit in range(n):
            assert T.snippet_of(text, hit) == slow_snippet(text, hit), (n, hit)


def test_pattern_syntax(spark):
    for good in (r"\p{L}+", r"a\z", r"[[:alpha:]]+", r"[^[:space:]]x", r"(?P<y>\d{2,})", r"(?i)abc", r"a{2}?", r"[a-z&&[^b]]", r"\x{41}", r"\u00e9", r"a|b", r"[]a]", "^x$", "(?:a)*", r"\."):
        assert T.is_portable(good), good
    for bad in (r"(?>a)", "a++", "a*+", r"(a)\1", "(?=a)", "(?!a)", "(?<=a)", r"\Qa\E", "[a", "(a", "*a", r"\k<n>", r"\G", "a)", r"\Z", "(?#c)"):
        assert not T.is_portable(bad), bad
    texts = ["abc", "ÉCOLE 42", "x\n", "x", "a b", "\u0663", "line\rx", "A]", "--", "tab\t"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern, want in {r"^x$": ["x"], r"\p{L}+\s\d+": ["ÉCOLE 42"], "[[:alpha:]]{3}": ["abc", "ÉCOLE 42", "line\rx", "tab\t"], r"\d": ["ÉCOLE 42", "\u0663"], "(?m)^x$": ["x\n", "x"], "e.x": ["line\rx"], "[]]": ["A]"], r"(?i)école": ["ÉCOLE 42"], r"[[:punct:]]": ["A]", "--"]}.items():
        assert sorted(r.t for r in df.where(T.matches(F.col("t"), pattern)).collect()) == sorted(want), pattern
        assert sorted(t for t in texts if T.char_ranges(t, T._compiled(pattern))) == sorted(want), pattern


def test_canonical_json(spark):
    got = spark.createDataFrame([('{"b": 1, "a": "\\ufb01"}',), ("not",)], "j string").select(T.canonical_json("j").alias("c")).collect()
    assert [r.c for r in got] == ['{"a":"fi","b":1}', None]


def test_ngrams_and_candidates(spark, tmp_path):
    words = ["heating", "thing", "ing", "nothing at all", "", "日本語テスト"]
    df = spark.createDataFrame([(str(i), w, i) for i, w in enumerate(words)], "record_id string, text string, n int").withColumn("timestamp", F.timestamp_seconds("n"))
    got = {r.record_id: set(r.g) for r in df.select("record_id", T.ngrams(F.col("text"), 1, 3).alias("g")).collect()}
    assert all(got[str(i)] == {w[j : j + n] for n in (1, 2, 3) for j in range(len(w) - n + 1)} for i, w in enumerate(words))
    search.write_ngram_index(df, f"{tmp_path}/i")
    for q in ("thing", "ing at", "日本語", "t.ing", "zzz"):
        a = search.grep(search.candidates(df, f"{tmp_path}/i", q), q).select("record_id").collect()
        assert a == search.grep(df, q).select("record_id").collect(), q


def test_key_functions(spark):
    df = spark.createDataFrame([("1700000000.000123", "2024-01-02T03:04:05.5+09:00", "1.12.3", '{"a": {"b": "x"}, "n": 3, "t": true}')], "ts string, r string, v string, j string")
    row = df.select(
        keys.slack_time(F.col("ts")).cast("string").alias("ts"), keys.rfc3339(F.col("r")).cast("string").alias("r"), keys.semver(F.col("v")).alias("v"), keys.slack_time(F.lit("17")).alias("bad"), keys.rfc3339(F.lit("2024-13-01T00:00:00Z")).alias("bad2"),
        keys.json_string(F.col("j"), "$.a.b").alias("s"), keys.json_string(F.col("j"), "$.n").alias("not_s"), keys.json_bool(F.col("j"), "$.t").alias("b"),
        keys.source_key("edit", F.lit("C"), F.lit("1.2"), F.lit("3.4")).alias("k"), keys.identifier_key(F.lit("Email"), F.lit(" A@b "), F.lit("S")).alias("e"), keys.identifier_key(F.lit("slack"), F.lit("U1"), F.lit("S")).alias("i"),
        keys.agent_name(F.lit("agent:kay"), F.lit(None)).alias("a1"), keys.agent_name(F.lit("x"), F.lit("lake/agent/zed")).alias("a2"), keys.identity_key(F.lit("s"), F.lit("o"), F.lit("{}")).alias("id"), keys.label_key(F.lit(" Foo \t BAR É")).alias("l"),
    ).first()
    assert row.ts == "2023-11-14 22:13:20.000123" and row.r == "2024-01-01 18:04:05.5" and tuple(row.v) == (1, 12, 3) and row.bad is None and row.bad2 is None
    assert (row.s, row.not_s, row.b, row.k, row.e, row.i) == ("x", None, True, "slack:C:1.2:edit:3.4", "email|*|a@b", "slack|s|U1")
    assert (row.a1, row.a2, row.id, row.l) == ("kay", "zed", "s:o:" + hashlib.sha256(b"{}").hexdigest(), "foo bar É")
    assert keys.decode_cursor(keys.encode_cursor({"scope": "a", "x": 1}), "a")["x"] == 1
    for bad in (keys.encode_cursor({"scope": "b"}), "???"):
        with pytest.raises(ValueError):
            keys.decode_cursor(bad, "a")


def test_pages_cover_all_rows_once(spark):
    data = [(random.Random(i).randint(0, 5), i) for i in range(60)]
    df = spark.createDataFrame(data, "a int, b int")
    order, seen, after = [("a", True), ("b", False)], [], None
    while True:
        page, after = paging.page_and_next(df, order, 7, after)
        seen += [(r.a, r.b) for r in page]
        if after is None:
            break
    assert seen == sorted(data, key=lambda r: (-r[0], r[1]))
    with pytest.raises(ValueError):
        paging.byte_budget_page(df, order, 5, 10)
    placed = spark.createDataFrame([(1, 1), (2, 3), (3, 2)], "place int, k int")
    assert [r.k for r in paging.merge_sorted([placed.where("place < 3"), placed.where("place = 3")], [("k", False)], "place").collect()] == [1, 2, 3]
    with pytest.raises(ValueError):
        paging.merge_sorted([placed], [("k", False)], "place")
    paths = lake.attribute_paths(spark.createDataFrame([(1, '{"a": {"b": [1, "x"]}, "c": null}'), (2, '{"a": {"b": [1]}}'), (3, "no")], "i int, j string"), "i", "j").collect()
    assert [tuple(r) for r in paths] == [("a.b[]", 2, 3, ["1", "x"])]
    with pytest.raises(ValueError):
        lake.poll_queue(df, 5, 1, current=4)


def test_append_twice_is_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "k", "a"), (2, "k", "a"), (3, "k", "b"), (4, None, "c"), (5, None, "c")], "seq int, idempotency_key string, canonical string")
    first = {r.seq: r.outcome for r in append.append(rows, f"{tmp_path}/lake").collect()}
    assert first == {1: "appended", 2: "duplicate", 3: "conflict", 4: "appended", 5: "appended"}
    again = {r.seq: r.outcome for r in append.append(rows.where("idempotency_key = 'k'"), f"{tmp_path}/lake").collect()}
    assert again == {1: "duplicate", 2: "duplicate", 3: "conflict"} and spark.read.parquet(f"{tmp_path}/lake").count() == 3


def test_stream_append_equals_replay(spark):
    rnd = random.Random(4)
    reqs = [(i, rnd.randint(0, 5), rnd.randint(0, 6), f"k{rnd.randint(0, 200)}-{i}") for i in range(200)]
    had = [(0, 1, "old"), (0, 2, "old2"), (1, 1, "x")]
    reqs += [(200, 0, 2, "old"), (201, 1, 5, "x")]
    version, keyset, want = {0: 2, 1: 1}, {(0, "old"), (0, "old2"), (1, "x")}, {}
    for seq, s, v, k in reqs:
        if (s, k) in keyset:
            want[seq] = "duplicate"
        elif v == version.get(s, 0):
            want[seq], version[s] = "appended", v + 1
        else:
            want[seq] = "version_conflict"
    got = append.stream_append(spark.createDataFrame(reqs, "seq int, stream_id int, expected_version int, idempotency_key string"), spark.createDataFrame(had, "stream_id int, stream_version int, idempotency_key string"))
    assert {r.seq: r.outcome for r in got.collect()} == want


def test_delta_rules_and_generations(spark, tmp_path):
    items = spark.createDataFrame([(1, "a"), (2, "b")], "item_key int, value string")
    for bad in ([(1, "x", "insert")], [(3, "x", "update")], [(9, None, "delete")], [(1, "x", "update"), (1, "y", "update")]):
        with pytest.raises(ValueError):
            append.apply_delta(items, spark.createDataFrame(bad, "item_key int, value string, op string"))
    store = append.Generations(spark, str(tmp_path))
    assert store.read() is None
    old = store.publish(items)
    store.publish(items.where("false"))
    assert store.read().count() == 0 and store.read(old).count() == 2
    assert store.rollback(old) == old and store.read().count() == 2
    both = store.publish_all({"records": items, "view": items.where("item_key = 1")})
    assert store.read(relation="view").count() == 1 and store.read(both, "records").count() == 2
    assert len(store.cleanup(1)) == 2 and store.cleanup(1) != [both] and store.read(relation="records").count() == 2


def test_privacy(spark):
    """The newest decision over the subject and all identifiers governs a row."""
    decisions = spark.createDataFrame(
        [("u", None, "opted_out", 1, 1, "a"), ("u", None, "unrestricted", 2, 1, "b"), ("u", None, "opted_out", 1, 9, "c"), ("x", "mail", "opted_out", 5, 5, "d"), ("z", "phone", "unrestricted", 6, 1, "e"), ("mail", None, "unrestricted", 9, 9, "f")],
        "subject string, identifier string, status string, published int, recorded_at int, id string",
    )
    rows = spark.createDataFrame(
        [("1", "o1", "u", None), ("2", "o2", "q", ["mail"]), ("3", "o3", "q", None), ("4", None, "q", ["q"]), ("5", "o5", "q", []), ("6", "o6", "x", ["phone"]), ("7", "o7", "u", ["mail", "none"]), ("8", "o8", "q", ["u"])], "id string, object_id string, subject string, keys array<string>"
    )
    gone = spark.createDataFrame([("4", None), (None, "o5")], "observation_id string, source_object_id string")
    assert sorted(r.id for r in privacy.visible(rows, decisions, gone).collect()) == ["1", "3", "6", "8"]
    odd = rows.withColumns({"schema": F.when(F.col("id") == "3", "schema:consent-decision").otherwise("s"), "meta": F.when(F.col("id") == "1", '{"retracts": null}').otherwise("{}")})
    assert sorted(r.id for r in privacy.visible(odd, decisions, gone).collect()) == ["6", "8"]
    meta = [("{}",), (None,), ('{"retracts": {"observation_id": "a"}}',), ('{"retracts": {"source_object_id": " b "}}',), ('{"retracts": {}}',), ('{"retracts": "a"}',), ('{"retracts": {"observation_id": 1}}',), ('{"retracts": {"observation_id": "a", "x": 1}}',)]
    got = [r.t for r in spark.createDataFrame(meta, "m string").select(privacy.retraction_target(F.col("m")).alias("t")).collect()]
    assert [None if t is None else tuple(t) for t in got] == [None, None, ("a", None, True), (None, "b", True)] + [(None, None, False)] * 4
    broken = gone.withColumn("valid", F.col("observation_id").isNull())
    assert privacy.visible(rows, decisions, broken).count() == 0


def test_mask_payload(spark):
    doc = {"a": {"email": "x", "list": [{"email": 1}, {"visibility": False, "k": 1}]}, "h": {"visibility": False}, "contact": {"phone": "1"}}
    fn = privacy.mask_payload("internal", [("email", "restricted", "redact"), ("contact.phone", "highly_sensitive", "exclude"), ("h", "public", "redact")])
    got = spark.createDataFrame([(json.dumps(doc),), (None,), ('{"visibility": false}',)], "p string").select(fn("p").alias("m")).collect()
    assert json.loads(got[0].m) == {"a": {"email": "[REDACTED]", "list": [{"email": 1}]}, "h": None, "contact": {}}
    assert got[1].m is None and got[2].m == "null"


def test_fold_equals_replay(spark):
    rnd = random.Random(2)
    events = [(rnd.randint(0, 9), i, rnd.randint(0, 300_000), rnd.choice(states.CLAIM_STATES)) for i in range(400)]
    want = {}
    for k in {e[0] for e in events}:
        state, taken, upd = "open", 0, None
        for _, _, t, to in sorted((e for e in events if e[0] == k), key=lambda e: (e[2], e[1])):
            if to == state or to in states.CLAIM_NEXT[state]:
                state, taken, upd = to, taken + 1, t
        want[k] = (state, taken, upd)
    df = spark.createDataFrame(events, "claim_id int, id int, s long, to_state string").withColumn("created_at", F.timestamp_seconds("s"))
    got = {r.claim_id: (r.state, r.taken, r.u) for r in states.claim_states(df).withColumn("u", F.unix_timestamp("updated")).collect()}
    assert got == want


def test_components_and_star_edges(spark):
    rnd = random.Random(3)
    pairs = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, None)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if b is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "a int, b int")).count() == 0
    cand = spark.createDataFrame([("a1", "A", "k"), ("a2", "A", "k"), ("b1", "B", "k"), ("a3", "A", "only"), ("a4", "A", "only")], "candidate string, source string, email string").withColumn("name", F.lit(None).cast("string"))
    assert {r.candidate: r.person for r in identity.persons(cand).collect()} == {"a1": "a1", "a2": "a1", "b1": "a1", "a3": "a3", "a4": "a4"}
    assert identity.persons(cand, cross_source=False).where("person = 'a3'").count() == 2


def test_chains_cycles_and_roots(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 100), (99, 100)]
    got = {r.id: (r.terminal, r.hops) for r in graph.terminal_of(spark.createDataFrame(links, "id int, next int")).collect()}
    assert all(got[i] == (20, 20 - i) for i in range(20)) and all(got[i] == (None, None) for i in (99, 100, 101))
    with pytest.raises(ValueError):
        graph.session_tree(spark.createDataFrame([("a", "b"), ("b", "a")], "session string, parent string"))
    sup = spark.createDataFrame([("s1", ["o1"], []), ("s2", [], ["s1"]), ("s3", ["o2"], ["s2", "s4"]), ("s4", [], ["s3"]), ("s5", [], ["gone"])], "id string, observations array<string>, parents array<string>")
    assert {r.id: r.roots for r in graph.source_roots(sup).collect()} == {"s1": ["o1"], "s2": ["o1"], "s3": ["o1", "o2"], "s4": ["o1", "o2"], "s5": ["gone"]}
    assert graph.projection_order({"c": ["b"], "b": ["a"]}) == ["a", "b", "c"] and graph.dependents({"c": ["b"], "b": ["a"]}, "a") == {"b", "c"}
    with pytest.raises(ValueError):
        graph.projection_order({"a": ["b"], "b": ["a"]})


def test_fingerprint(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "a int, b string")
    total = sum(int(hashlib.sha256(json.dumps({"a": i, "b": f"t{i}"}, separators=(",", ":")).encode()).hexdigest(), 16) for i in range(50)) % (1 << 256)
    got = activity.fingerprint(df.repartition(7)).first()
    assert (got.rows, got.fingerprint) == (50, f"{total:064x}")


def test_gate_order(spark):
    observers = spark.createDataFrame([("o", "sys:s", [], "lake_authoritative", "event"), ("d", "sys:s", [], "dual_reference", "event")], "observer string, source_system string, schemas array<string>, authority_model string, capture_model string")
    base = dict(schema="schema:note", schema_version="1.0.0", observer="o", source_system="sys:s", authority_model="lake_authoritative", capture_model="event", subject="s", target=None, payload='{"t": "x"}', attachments=[], published="2024-01-01 00:00:00", meta="{}")
    cases = {"ok": ({}, "accepted", None), "obs": ({"observer": "?"}, "rejected", "unknown observer"), "ver": ({"schema_version": "9.0.0"}, "rejected", "unknown schema version"), "sys": ({"source_system": None}, "rejected", "source system mismatch"), "auth": ({"authority_model": "source_authoritative"}, "rejected", "authority mismatch"), "pay": ({"payload": "{}"}, "rejected", "invalid payload"), "ret": ({"meta": '{"retracts": {"x": 1}}'}, "rejected", "invalid retraction"), "out": ({"subject": "gone"}, "quarantined", "policy denied"), "dual": ({"observer": "d", "authority_model": "dual_reference"}, "quarantined", "policy review required"), "blob": ({"attachments": ["blob:1"]}, "rejected", "missing attachment"), "late": ({"published": "2024-01-01 00:10:01"}, "quarantined", "clock skew"), "edge": ({"published": "2024-01-01 00:10:00"}, "accepted", None)}
    names = [*base, "idempotency_key"]
    rows = [tuple(({**base, **change, "idempotency_key": k})[n] for n in names) for k, (change, _, _) in cases.items()]
    drafts = spark.createDataFrame(rows, ", ".join(f"{n} {'array<string>' if n == 'attachments' else 'string'}" for n in names)).withColumn("published", F.to_timestamp("published"))
    channels = spark.createDataFrame([], "id string, kind string, source_instance_id string, external_id string, enabled boolean, reply_slo_seconds long")
    decisions = spark.createDataFrame([("gone", None, "opted_out", 1, 1, "a")], "subject string, identifier string, status string, published int, recorded_at int, id string")
    got = ingest.gate(drafts, observers, {"schema:note": {"required": ["t"], "properties": {"t": {"type": "string"}}}}, channels, decisions, spark.createDataFrame([], "blob_ref string"), "2024-01-01 00:00:00")
    assert {r.idempotency_key: (r.outcome, r.reason) for r in got.collect()} == {k: (o, w) for k, (_, o, w) in cases.items()}
    assert ingest.evolution_problems({"properties": {"a": 1}}, {"properties": {"a": 1, "b": 1}}, "1.0.0", "1.0.1") == ["new fields need a new minor version"]


def test_schema_rules_at_depth():
    spec = {"type": "object", "required": ["a"], "properties": {"a": {"type": ["string", "null"], "pattern": "^x", "maxLength": 3}, "b": {"type": "object", "required": ["c"], "additionalProperties": False, "properties": {"c": {"type": "array", "minItems": 1, "items": {"type": "integer", "minimum": 2}}}}, "k": {"const": 1}}}
    good = [{"a": "x"}, {"a": None, "b": {"c": [2, 3.0]}, "more": 1}, {"a": "xyz", "k": 1}]
    bad = {"missing a": {}, "a does not match its pattern": {"a": "y"}, "a is too short or too long": {"a": "xxxx"}, "a is not string or null": {"a": True}, "b misses c": {"a": "x", "b": {}}, "b has d": {"a": "x", "b": {"c": [2], "d": 1}}, "b.c[1] is out of bounds": {"a": "x", "b": {"c": [2, 1]}}, "b.c[0] is not integer": {"a": "x", "b": {"c": [True]}}, "b.c has too few or too many items": {"a": "x", "b": {"c": []}}, "k is not allowed": {"a": "x", "k": 2}, "payload is not object": [1]}
    assert all(ingest._problem(v, spec, "payload") is None for v in good)
    assert [ingest._problem(v, spec, "payload") for v in bad.values()] == [*bad]


def test_atomic_pages_and_dead_letters(spark):
    gated = spark.createDataFrame([(1, "k", "a", "accepted", None), (2, "k", "a", "accepted", None), (3, "j", "b", "accepted", None)], "seq int, idempotency_key string, canonical string, outcome string, reason string")
    bad = spark.createDataFrame([(4, "k", "c", "accepted", None), (5, "z", "c", "rejected", "why")], gated.schema)
    result = lambda page: {r.seq: (r.result, r.reason) for r in page.collect()}
    assert result(ingest.ingest_page(gated, atomic=True)) == {1: ("ingested", None), 2: ("duplicate", None), 3: ("ingested", None)}
    both = gated.unionByName(bad)
    assert result(ingest.ingest_page(both)) == {1: ("ingested", None), 2: ("duplicate", None), 3: ("ingested", None), 4: ("quarantined", "canonical collision"), 5: ("rejected", "why")}
    page = ingest.ingest_page(both, atomic=True)
    assert {k: v[0] for k, v in result(page).items()} == {1: "rejected", 2: "duplicate", 3: "rejected", 4: "quarantined", 5: "rejected"}
    assert ingest.dead_letters(page, "2024-01-01 00:00:00").count() == 4
    with pytest.raises(ValueError):
        lake.operational_filter(gated, "2024-01-02", "2024-01-01")


def test_sources(spark, tmp_path):
    p = tmp_path / "s.jsonl"
    p.write_text('{"channel_id":"C","ts":"1700000000.5","user_id":"U","text":"hi","ingress_kind":"api","message_type":"delete","files":[{"id":"f","blob_ref":"blob:1"}]}\n{bad\n{"channel_id":"C","ts":"x","ingress_kind":"api"}\n')
    raw = messages.read_jsonl(spark, str(p), messages.SLACK).cache()
    assert messages.bad_lines(raw).count() == 1
    (row,) = messages.slack(raw).collect()
    assert row.attachments == ["blob:1"] and json.loads(row.meta)["retracts"] == {"source_object_id": "C-1700000000.5"} and row.subject == "message:slack:C-1700000000.5"
    g = tmp_path / "g.jsonl"
    g.write_text('{"repo":"r","issues":[{"id":1,"title":"t","body":"b","created_at":"2024-01-01T00:00:00Z"}],"commits":[{"sha":"abc","message":"m"}]}\n')
    assert sorted(json.loads(r.payload)["object_type"] for r in messages.github(messages.read_jsonl(spark, str(g), messages.GITHUB)).collect()) == ["commit", "issue"]
    tree = spark.createDataFrame([("c", "t", {"n1": ("n1", None, ("n1", ("user",), 1700000000.0, (["hello"],))), "n2": ("n2", "n1", None)})], messages.CHAT_TREE)
    assert messages.chat_tree(tree).count() == 1 and [r.reason for r in messages.skipped_nodes(tree).collect()] == ["no message"]
    lines = spark.createDataFrame([(2, "response_item", ("", "", "", "message", "user", None, None, None, [("t", "yo")])), (1, "session_meta", ("S", "/", None, None, None, None, None, None, None)), (3, "response_item", ("", "", "", "reasoning", None, None, None, None, None))], "line_no int, type string, " + messages.CODEX.split("type string, ", 1)[1])
    (item,) = messages.codex(lines.withColumns({"path": F.lit("p"), "timestamp": F.timestamp_seconds(F.lit(1))})).collect()
    assert json.loads(item.payload)["session"]["id"] == "S" and json.loads(item.payload)["item"]["text"] == "yo"
    gm = spark.createDataFrame([("a", "m", "t", "Mon, 01 Jan 2024 10:00:00 +0900"), ("a", "m2", "t", "never")], "account_id string, message_id string, thread_id string, date string")
    for c in ("from", "to", "cc", "subject", "text", "references", "in_reply_to", "labels"):
        gm = gm.withColumn(c, F.lit(None).cast("string"))
    assert [str(r.published) for r in messages.gmail(gm).select(F.col("published").cast("string").alias("published")).collect()] == ["2024-01-01 01:00:00"]
    lines = spark.createDataFrame([("p", i, x) for i, x in enumerate(['{"type": "tool_use", "name": "T", "sessionId": "S", "uuid": "u", "timestamp": "2024-01-01T00:00:00Z"}', '{"type": "odd"}', "{}", "", '{"type": "user", "sessionId": "S", "uuid": "v", "parentUuid": "u", "isSidechain": true, "timestamp": "2024-01-01T00:00:01Z", "message": {"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "tool_result"}, {"type": "text", "text": "b"}]}}'])], "path string, line_no int, line string")
    assert {r.line_no: r.reason for r in messages.transcript(lines).collect()} == {0: None, 1: "unknown type", 2: "unknown type", 4: None}
    got = {r.subject: (json.loads(r.payload)["item"], json.loads(r.meta)["thread_source"]) for r in messages.claude_code(lines).collect()}
    assert got == {"message:claude-code:S:u": ({"kind": "tool_call", "tool_name": "T"}, "main"), "message:claude-code:S:v": ({"kind": "message", "role": "user", "text": "a\nb"}, "sidechain")}
    docs = spark.createDataFrame([("d", "r", [("BODY", "pre"), ("HEADING_1", "H"), ("BODY", "a"), ("BODY", "b"), ("HEADING_2", "I")])], "document_id string, revision_id string, paragraphs array<struct<style: string, text: string>>")
    assert [(r.heading, r.text) for r in documents.doc_chunks(docs).orderBy("chunk").collect()] == [("", "pre"), ("H", "a\nb"), ("I", "")]
    files = spark.createDataFrame([("a", "root"), ("b", "a"), ("c", "b"), ("a", "c"), ("z", "y")], "file_id string, parent_id string")
    assert {r.file_id: r.depth for r in documents.files_below(files, ["root"]).collect()} == {"root": 0, "a": 1, "b": 2, "c": 3}
    deep = spark.createDataFrame([(f"n{i}", f"n{i - 1}") for i in range(1, 80)], "file_id string, parent_id string")
    assert documents.files_below(deep, ["n0"]).where("depth = 79").count() == 1
    deck = spark.createDataFrame([("p", "r1", "Deck", None, "own", ["e1"], "words", "http://u")], documents.SLIDES)
    (slide,) = documents.slides(deck).collect()
    assert json.loads(slide.payload) == {"title": "Deck", "relations": {"editors": ["e1"], "owner": "own"}, "artifact": {"sourceObjectId": "p", "canonicalUri": "http://u"}, "native": {"text": "words"}} and json.loads(slide.meta)["object_id"] == "p:rev:r1"
    form = spark.createDataFrame([("f", "Form", "sh", [("q1", "Name"), ("q2", "Age"), ("q3", "Not asked")], [("r1", None, "who", {"q2": "5", "q1": "Ann"})])], documents.FORMS)
    forms = {r.schema: json.loads(r.payload) for r in documents.forms(form).collect()}
    assert forms["schema:form-response-content"]["text"] == "Name: Ann\nAge: 5" and forms["schema:form-structure"]["linkedSheetId"] == "sh" and forms["schema:form-response"]["respondent"] == "who" and len(forms) == 3
    dump = '{"repo":"r",' + ",".join(f'"{n}":[{{"id":{i},"created_at":"2024-01-01T00:00:00Z"}}]' for i, n in enumerate(messages.GITHUB_ARRAYS)) + "}"
    (tmp_path / "all.jsonl").write_text(dump + "\n")
    assert sorted(json.loads(r.payload)["object_type"] for r in messages.github(messages.read_jsonl(spark, str(tmp_path / "all.jsonl"), messages.GITHUB)).collect()) == sorted(messages.GITHUB_ARRAYS.values())
    import zipfile

    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("conversations.json", '[{"uuid": "c"}]')
        z.writestr("readme.txt", "no")
    assert [(r.name, r.json) for r in messages.zipped_json(spark, str(tmp_path / "x.zip")).collect()] == [("conversations.json", '[{"uuid": "c"}]')]
    chats = spark.createDataFrame([("c", "n", [("m", "human", "hi", None), (None, "assistant", "yo", None)])], messages.CHAT_LIST)
    assert sorted(r.subject for r in messages.chat_list(chats).collect()) == ["message:claude-ai:c:1", "message:claude-ai:c:m"]
    sheets = spark.createDataFrame([("s", [("t", [["x", ""], ["y"]])])], documents.SHEETS)
    assert [(r.row, r.col, r.value) for r in documents.sheet_cells(sheets).collect()] == [(0, 0, "x"), (1, 0, "y")]


def test_views_equal_batch(spark, tmp_path):
    rnd = random.Random(5)
    data = [(rnd.randint(0, 5), rnd.randint(0, 50), i, rnd.choice("xyz")) for i in range(90)]
    df = spark.createDataFrame(data, "k int, t int, i int, v string")
    view = views.KeyedView(spark, str(tmp_path / "v"), "k", "v", ["t", "i"])
    for part in range(3):
        batch = df.where(F.col("i") % 3 == part)
        view.fold(batch)
        view.fold(batch)  # a batch that runs again
    assert sorted(map(tuple, view.current().collect())) == sorted(map(tuple, view.reduce(df).collect()))
    assert views.propagate(["a", "b", "c"], {"b": ["a"], "c": []}, lambda n: 1 / (n != "a")) == {"a": "broken", "b": "degraded", "c": "ok"}
    lake = {"rows": [("1", "a"), ("2", "b")]}
    corpus = views.RecomputedView(spark, str(tmp_path / "c"), "record_id", lambda b: b, lambda ids: spark.createDataFrame(lake["rows"], "record_id string, text string").join(ids, "record_id", "left_semi"))
    both = spark.createDataFrame([("1",), ("2",)], "record_id string")
    corpus.fold(both)
    lake["rows"] = [("2", "b2")]  # 1 is retracted, 2 is edited
    corpus.fold(both)
    assert [tuple(r) for r in corpus.current().collect()] == [("2", "b2")]
    lake["rows"] = []
    corpus.fold(both)
    assert corpus.current().count() == 0
    limits = spark.createDataFrame([("a", 1)], "source string, max_age_seconds long")
    views.FreshnessView(spark, str(tmp_path / "f"), limits)
    views.FreshnessView(spark, str(tmp_path / "f"), limits)
    with pytest.raises(ValueError):
        views.FreshnessView(spark, str(tmp_path / "f"), limits.withColumn("max_age_seconds", F.lit(2).cast("long")))


def test_components_under_new_edges(spark, tmp_path):
    rnd = random.Random(8)
    view, seen = views.ComponentsView(spark, str(tmp_path / "v")), []
    for n in (12, 1, 12):
        edges = [(rnd.randint(0, 40), rnd.randint(0, 40)) for _ in range(n)]
        seen += edges
        view.fold(spark.createDataFrame(edges, "a int, b int"))
        want = {r.node: r.component for r in components.connected_components(spark.createDataFrame(seen, "a int, b int")).collect()}
        want |= {a: a for a, b in seen if a == b and a not in want}
        assert {r.node: r.component for r in view.current().collect()} == want


def test_inventory(spark):
    text = spark.createDataFrame([(1, "Name: Ann\nAge：5\nhttp://x\n12.30: z\nx: y\n  City:\n Oslo\nname: later", 1), (2, "name : Bob\nempty:", 2), (2, "Name: no", 3), (3, "nothing here", 4), (4, None, 5)], "p int, t string, n int")
    got = [(r.key, r.label, r.people, r.examples) for r in inventory.label_inventory(text, "p", "t", "n").collect()]
    assert got == [("name", "Name", 2, ["Ann", "Bob"]), ("age", "Age", 1, ["5"]), ("city", "City", 1, ["Oslo"]), ("empty", "empty", 1, [])]


def test_attribute_scores_add_up(spark):
    attributes = spark.createDataFrame([(1, "Name", ["name", "NAME "]), (2, "other", ["name"]), (3, "name", []), (4, "full name", []), (5, "zzz", ["p1"]), (6, "nam", ["P1"]), (7, "", [])], "id int, name string, aliases array<string>")
    labels = spark.createDataFrame([("name", "p1"), ("name", None)], "label string, ai_key string")
    got = {(r.ai_key, r.id): r.score for r in inventory.suggest_attributes(labels, attributes, 9).collect()}
    assert got == {("p1", 1): 190, ("p1", 2): 100, ("p1", 3): 90, ("p1", 4): 50, ("p1", 5): 70, ("p1", 6): 120, (None, 1): 190, (None, 2): 100, (None, 3): 90, (None, 4): 50, (None, 6): 50}
    assert inventory.suggest_attributes(labels.drop("ai_key"), attributes, 2).select("id", "score", "nth").collect() == [(1, 190, 1), (2, 100, 2)]


def test_roots_beyond_64_levels(spark):
    sup = [("s0", ["o"], [])] + [(f"s{i}", [], [f"s{i - 1}"]) for i in range(1, 150)]
    got = graph.source_roots(spark.createDataFrame(sup, "id string, observations array<string>, parents array<string>")).collect()
    assert len(got) == 150 and all(r.roots == ["o"] for r in got)


def test_gate_by_its_rules(spark):
    """Lake and dual observers, heartbeats, drafts that share a key, metadata of other types, channels by id, and what an accepted message tells."""
    observers = spark.createDataFrame([("lake", "sys:slack", [], "lake_authoritative", "event"), ("dual", "sys:slack", [], "dual_reference", "snapshot"), ("n", "sys:notes", [], "lake_authoritative", "event")], "observer string, source_system string, schemas array<string>, authority_model string, capture_model string")
    note = dict(schema="schema:note", schema_version="1.0.0", observer="lake", source_system="sys:slack", authority_model="lake_authoritative", capture_model="event", subject="s", target=None, payload="{}", attachments=[], published="2024-01-01 00:00:00.5", idempotency_key="same", meta="{}")
    meta = {"source_instance": "i", "communication_channel_kind": "slack", "communication_channel_external_id": "C", "communication_sender_id": "U", "communication_thread_ref": "t", "kept": [1, {"a": None}]}
    message = note | {"schema": "schema:slack-message", "payload": '{"channel_id": "C"}', "meta": json.dumps(meta)}
    beat = note | {"schema": "schema:observer-heartbeat", "observer": "dual"}
    told = lambda **more: message | {"meta": json.dumps(meta | more)}
    cases = [
        (note, "accepted", None), (note | {"authority_model": "dual_reference"}, "quarantined", "policy review required"), (note | {"authority_model": "source_authoritative"}, "rejected", "authority mismatch"),
        (note | {"observer": "dual", "capture_model": "snapshot"}, "rejected", "authority mismatch"), (note | {"observer": "dual", "authority_model": "dual_reference"}, "rejected", "capture mismatch"),
        (note | {"observer": "dual", "authority_model": "dual_reference", "capture_model": "snapshot"}, "quarantined", "policy review required"),
        (beat, "accepted", None), (beat | {"capture_model": "snapshot"}, "rejected", "capture mismatch"), (beat | {"authority_model": "source_authoritative"}, "rejected", "authority mismatch"), (beat | {"authority_model": "dual_reference"}, "quarantined", "policy review required"),
        (note | {"subject": "gone"}, "quarantined", "policy denied"), (note | {"subject": "stays"}, "accepted", None), (note | {"attachments": ["b"]}, "rejected", "missing attachment"), (note | {"attachments": ["a"]}, "accepted", None),
        (message, "accepted", None), (told(communication_sender_id=7), "quarantined", "missing channel metadata"), (told(communication_channel_id="c1"), "accepted", None), (told(communication_channel_id=5), "accepted", None),
        (told(communication_channel_id="c9"), "quarantined", "unregistered channel"), (told(communication_channel_id="c2"), "quarantined", "channel is another's"), (told(communication_channel_id="c3"), "quarantined", "disabled channel"),
        (told(source_instance="j"), "quarantined", "unregistered channel"), (message | {"payload": '{"channel_id": 1}'}, "quarantined", "channel differs from payload"), (told(communication_sender_id="V"), "quarantined", "policy denied"),
        (message | {"observer": "n", "source_system": "sys:notes", "meta": "{}"}, "accepted", None),  # a system without channels
    ]
    names = [*note, "nr"]
    drafts = spark.createDataFrame([tuple((case | {"nr": i})[n] for n in names) for i, (case, _, _) in enumerate(cases)], ", ".join(f"{n} {'array<string>' if n == 'attachments' else 'int' if n == 'nr' else 'string'}" for n in names)).withColumn("published", F.to_timestamp("published"))
    channels = spark.createDataFrame([("c1", "slack", "i", "C", True, 90, 5, True, ["boss"]), ("c2", "slack", "i", "D", True, 90, 5, None, None), ("c3", "slack", "i", "C3", False, 90, 5, None, None)], "id string, kind string, source_instance_id string, external_id string, enabled boolean, reply_slo_seconds long, freshness_threshold_seconds long, break_glass_channel boolean, break_glass_senders array<string>")
    decisions = spark.createDataFrame([("gone", None, "opted_out", 1, 1, "a"), ("x", "V", "opted_out", 1, 1, "b")], "subject string, identifier string, status string, published int, recorded_at int, id string")
    schemas = {n: {} for n in ("schema:note", "schema:slack-message", "schema:observer-heartbeat")}
    got = {r.nr: r for r in ingest.gate(drafts, observers, schemas, channels, decisions, spark.createDataFrame([("a",)], "blob_ref string"), "2024-01-01 00:00:00").select("*", F.unix_micros("reply_due_at").alias("due")).collect()}
    assert [(got[i].outcome, got[i].reason) for i in range(len(cases))] == [(o, w) for _, o, w in cases]
    (full,) = {i: json.loads(r.meta) for i, r in got.items() if cases[i][0] is message}.values()
    assert full["kept"] == meta["kept"] and full["communication_channel_id"] == "c1" and full["communication"] == {
        "channel_id": "c1", "kind": "slack", "source_instance": "i", "external_id": "C", "sender": "U", "thread_ref": "t", "reply_slo_seconds": 90, "reply_due_at": "2024-01-01T00:01:30.500Z",
        "freshness_threshold_seconds": 5, "break_glass_channel": True, "break_glass_senders": ["boss"]}
    assert got[14].due == 1704067290_500000 and got[0].due is None and json.loads(got[0].meta) == {} and "communication" not in json.loads(got[23].meta)


def test_workspace_corpus(spark):
    """Parts of snapshots: chunks with their number in the tree, rows without text, values of other types, sheets of responses, folders and owners."""
    snapshot = lambda id, service, kind=None, **more: (id, "schema:workspace-object-snapshot", json.dumps({"title": f"T{id}", **more, "artifact": {"service": service, "objectType": kind, "canonicalUri": f"u{id}", "sourceObjectId": f"o{id}", "containerId": "k", **more.get("artifact", {})}}), "{}")
    chunks = [{"heading": "Intro", "anchor": "h.intro", "text": "Alpha"}, {"text": " 　\n"}, {"heading": 5, "text": 7}, {"heading": "Plan", "text": "Beta"}, "odd", None]
    rows = [{"rowNumber": 2, "cells": [{"header": "Name", "value": "Cable"}, {"header": None, "value": "3"}, {"header": "x", "value": 4}]}, {"rowNumber": 3, "cells": [{}]}, {"rowNumber": -1, "cells": [{"value": "neg"}]}, {"rowNumber": "9", "cells": [{"value": "text"}]}, 5]
    tabs = [{"name": "Items", "rows": rows}, {"rows": [{"cells": [{"value": "nameless"}]}]}, {"name": "none"}]
    observations = [
        snapshot("d", "docs", native={"chunks": chunks}), snapshot("d2", "docs", native={"chunks": {"text": "no array"}}), snapshot("d3", "docs"), snapshot("s", "sheets", native={"tabs": tabs}),
        snapshot("r", "sheets", native={"tabs": tabs}, metadata={"formResponseSheet": True}), snapshot("r2", "sheets", native={"tabs": tabs}), snapshot("f", "forms", "form", native={"questions": [{"title": "A?"}, {"title": 1}, {"title": "B?"}]}, metadata={"linkedSheetId": "or2"}),
        snapshot("f1", "forms", "form-response-fact", response={"respondent": None, "submittedAt": "then"}), snapshot("f2", "forms", "form-response-content", response={"answers": {"q": "secret"}}),
        snapshot("p", "slides", native={"slides": [{"b": "two", "a": ["one", 1, {"z": "in"}]}, "three"]}), snapshot("p2", "slides", relations={"owner": "quits"}), snapshot("v", "drive", "pdf", native={"text": "body"}, metadata={"parentIds": ["in"], "sharingLevel": "anyone-with-link"}),
        snapshot("v2", "drive", "pdf", metadata={"parentIds": ["in"], "sharingLevel": "private"}), snapshot("v3", "drive", "pdf", metadata={"parentIds": ["out"], "sharingLevel": "public"}), snapshot("v4", "drive", "pdf", metadata={"sharingLevel": "public"}), snapshot("x", "other"),
        ("bot", "schema:bot-answer-log", '{"artifact": {"service": "docs"}, "native": {"chunks": [{"text": "out"}]}}', "{}"), ("bad", "schema:workspace-object-snapshot", "{", "{}"), ("gone", "schema:workspace-object-snapshot", snapshot("d", "docs", native={"chunks": chunks})[2], '{"retracts": {}}'), (None, "schema:workspace-object-snapshot", None, None),
        ("m", "schema:slack-message", '{"channel_name": "001_a", "channel_id": "C", "ts": "1.2", "text": "hi", "user_name": "U", "is_public_channel": true}', '{"object_id": "C-1.2"}'), ("m2", "schema:slack-message", '{"channel_name": "001_a", "text": "hi"}', "{}"),
    ]
    table = spark.createDataFrame(observations, "id string, schema string, payload string, meta string").withColumn("published", F.timestamp_seconds(F.lit(5)))
    config = corpus.Config(opted_out_people=("quits",), allowed_folders=("in",))
    got = {r.record_id: r for r in workspace.workspace_corpus(table, config).collect()}
    assert sorted(got) == sorted(["corpus:docs:d:0", "corpus:docs:d:3", "corpus:sheets:s:Items:2", "corpus:sheets:s:Items:0", "corpus:sheets:s:Sheet:0", "corpus:forms:f:form", "corpus:forms:f1:form-response-fact", "corpus:slides:p", "corpus:drive:v", "corpus:slack:C:1.2"])
    assert (got["corpus:docs:d:0"].anchor_url, got["corpus:docs:d:0"].source_location, got["corpus:docs:d:3"].anchor_url) == ("ud#h.intro", "Intro", "ud")
    assert (got["corpus:sheets:s:Items:2"].text, got["corpus:sheets:s:Items:2"].source_location, got["corpus:sheets:s:Items:2"].anchor_url) == ("Name: Cable\n3", "Items row 2", "us#gid=Items&range=2:2")
    assert got["corpus:forms:f:form"].text == "Tf\nA?\nB?" and got["corpus:forms:f1:form-response-fact"].text == "unknown answered at then" and json.loads(got["corpus:forms:f:form"].metadata)["linked_sheet_id"] == "or2"
    assert got["corpus:slides:p"].text == "one\n\nin\ntwo\nthree" and got["corpus:drive:v"].text == "body" and json.loads(got["corpus:slack:C:1.2"].metadata) == {"observation_id": "m", "source_object_id": "C-1.2", "channel_id": "C", "author": "U"}
    kept = workspace.workspace_corpus(table, corpus.Config(exclude_form_response_sheets=False, allowed_folders=("in",), least_sharing="specific_users"))
    assert kept.where("source_type = 'sheets'").count() == 12 and kept.where("source_type = 'drive'").count() == 2 and kept.where("record_id = 'corpus:slides:p2'").count() == 1
    assert workspace.workspace_corpus(table.where("false")).count() == 0



def test_workspace_corpus_parses_once(spark):
    """Each payload is parsed once, and snapshots travel as text, dealt by id; names that JSON escapes are found all the same."""
    snapshot = lambda id, service, meta="{}", **more: (id, "schema:workspace-object-snapshot", json.dumps({"title": id, **more, "artifact": {"service": service, "objectType": "form", "sourceObjectId": id}}).replace("linkedS", r"linked\u0053"), meta)
    tabs = [{"name": "T", "rows": [{"rowNumber": 2, "cells": [{"value": "x"}]}]}]
    observations = [snapshot("s", "sheets", native={"tabs": tabs}), snapshot("s2", "sheets", native={"tabs": tabs}), snapshot("s3", "sheets", native={"tabs": tabs}, metadata={"formResponseSheet": "true"}), snapshot("f", "forms", metadata={"linkedSheetId": "s"}), snapshot("f2", "forms", r'{"\u0072etracts": {}}'), snapshot("f3", "forms", '{"text": "retracts"}')]
    table = spark.createDataFrame(observations, "id string, schema string, payload string, meta string").withColumn("published", F.timestamp_seconds(F.lit(5)))
    found = workspace.workspace_corpus(table, corpus.Config(opted_out_people=("quits",)))
    assert sorted(r.record_id for r in found.collect()) == ["corpus:forms:f3:form", "corpus:forms:f:form", "corpus:sheets:s2:T:2", "corpus:sheets:s3:T:2"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(payload") == 2 and plan.count("RepartitionByExpression") == 1  # of snapshots and of messages


def test_snapshots_reach_the_corpus(spark):
    deck = snapshots.slides(spark.createDataFrame([("p", "r", "Deck", "http://p", None, "own", ["e"], None, None, "blob:sha256:n", ["blob:sha256:a", "b"])], snapshots.SLIDES).withColumn("modified", F.timestamp_micros(F.lit(1_500_000))))
    (row,) = deck.collect()
    assert row.attachments == ["blob:sha256:a", "b", "blob:sha256:n"] and json.loads(row.payload)["native"] == {"encoding": "blob-ref", "blobRef": "blob:sha256:n"} and json.loads(row.payload)["revision"]["sourceModifiedAt"] == "1970-01-01T00:00:01.500Z"
    assert json.loads(json.loads(row.meta)["canonical_json"]) == {"attachment_sha256": ["a", "n"], "modified_time": "1970-01-01T00:00:01.500000Z", "presentation_id": "p", "revision_id": "r"} and row.authority_model == "source_authoritative"
    sheet = snapshots.sheets(spark.createDataFrame([("s", "r", "Sheet", None, None, False, [("T", [["a", "b"], ["1", "2", "3"]]), ("E", [])])], snapshots.SHEETS).withColumn("modified", F.timestamp_seconds(F.lit(1))))
    both = workspace.workspace_corpus(deck.unionByName(sheet).withColumn("id", F.get_json_object("meta", "$.object_id")))
    assert {r.source_type: r.text for r in both.collect() if r.source_type == "sheets"} == {"sheets": "a: 1\nb: 2\n3"} and both.where("source_type = 'slides' and text like '%Deck'").count() == 1


def test_cards_fold_what_has_arrived(spark, tmp_path):
    """After each run the cards are those of the facts that have arrived: drafts after their events, events out of order, doubled files, and a restart."""
    facts = "draft_id long, kind string, id string, at timestamp, expires_at timestamp, event string"
    rnd, ts = random.Random(21), lambda s: datetime.datetime.fromtimestamp(1_700_000_000 + s, datetime.UTC).replace(tzinfo=None)
    rows = [(d, "draft", None, ts(d), ts(500) if d % 2 else None, None) for d in range(20)]
    rows += [(d, "event", f"e{k}", ts(rnd.randint(0, 6)), None, rnd.choice([*states.CARD_STEPS, "noise", None])) for d in range(22) for k in range(rnd.randint(0, 6))]
    rnd.shuffle(rows)
    parts = [rows[:30], rows[30:31], rows[25:60], rows[60:]]
    view, seen = folds.CardsView(spark, str(tmp_path / "view")), []
    for n, part in enumerate(parts):
        spark.createDataFrame(part, facts).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        seen += part
        folds.run_cards(spark.readStream.schema(facts).parquet(f"{tmp_path}/in/*"), view, str(tmp_path / "checkpoint"))
        arrived = spark.createDataFrame(seen, facts).distinct()
        drafts = arrived.where("kind = 'draft'").select("draft_id", F.col("at").alias("created_at"), "expires_at")
        events = arrived.where("kind = 'event'").select("draft_id", "id", F.col("at").alias("created_at"), "event")
        now = "2023-11-14 22:21:41"
        want = states.cards(drafts, events, now).select("draft_id", "state", "updated_at", "taken")
        assert sorted(map(tuple, view.current(now).collect())) == sorted(map(tuple, want.collect())), n


def test_views_read_nothing_that_has_not_arrived(spark, tmp_path):
    """A view over part of the rows equals the batch result of that part; a batch that runs again changes nothing; the number of buckets stays."""
    rows = spark.createDataFrame([(k % 5, k) for k in range(40)], "key long, n long")
    compute = lambda r: r.distinct().groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    view = views.ArrivedView(spark, str(tmp_path), "key", compute)
    for number, part in enumerate((rows.where("n < 7"), rows.where("n % 2 = 0"), rows.where("n % 2 = 0"), rows)):
        for _ in range(2):
            view.fold(part, number)
        arrived = [rows.where("n < 7"), rows.where("n % 2 = 0"), rows.where("n % 2 = 0"), rows][: number + 1]
        want = compute(arrived[0] if number == 0 else arrived[0].unionByName(arrived[1]) if number < 3 else rows)
        assert sorted(map(tuple, view.current().collect())) == sorted(map(tuple, want.collect()))
    assert views.Buckets(spark, f"{tmp_path}/view", "key", 7).n == 32 and views.Buckets(spark, f"{tmp_path}/none", "key", 7).n == 7


def test_roots_of_cycles_and_wide_graphs(spark):
    """Random graphs with cycles against a walk."""
    rnd = random.Random(31)
    ids = [f"s{i}" for i in range(60)]
    sup = [(i, [f"o{rnd.randrange(9)}"] if rnd.random() < 0.2 else [], rnd.sample(ids, rnd.choice([0, 1, 1, 2, 3]))) for i in ids]
    parents, own = {i: p for i, _, p in sup}, {i: o for i, o, _ in sup}

    def walked(start):
        seen, todo = {start}, [start]
        while todo:
            for p in parents[todo.pop()]:
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        return sorted({o for i in seen for o in own[i]})

    got = {r.id: r.roots for r in graph.source_roots(spark.createDataFrame(sup, "id string, observations array<string>, parents array<string>")).collect()}
    assert got == {i: walked(i) or sorted(set(own[i] + parents[i])) for i in ids}


def test_people_after_each_batch(spark, tmp_path):
    """After each batch people equal those of all facts so far; a batch that runs again counts once; names stay; a second claim is an error and changes nothing."""
    rnd, ts = random.Random(41), lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    facts, at = [], iter(range(10**6))
    for _ in range(70):
        node, kind = rnd.randrange(40), rnd.random()
        if kind < 0.15:
            facts.append((None, f"mail:{rnd.randrange(30)}", "joins", None, None, ts(next(at)), None, rnd.choice(["opted_out", "unrestricted"])))
        else:
            ident, rule = (f"mail:{rnd.choice([node % 30, rnd.randrange(30)])}", "joins") if kind < 0.5 else (f"uid:{node}", "exclusive") if kind < 0.8 else (None, None)
            facts.append((node, ident, rule, f"n{node}" if rnd.random() < 0.5 else None, rnd.randrange(5), ts(next(at)), rnd.choice("abc"), None))
    view, seen, names = people.PeopleView(spark, str(tmp_path)), [], {}
    for number, part in enumerate((facts[:25], facts[25:50], facts[50:])):
        batch = spark.createDataFrame(part, people.FACTS)
        view.fold(batch, number)
        if number == 1:
            view.fold(batch, number)  # again, from its journal
        seen += part
        nodes = sorted({f[0] for f in seen if f[0] is not None})
        root = {n: n for n in nodes}
        claims = {}
        for f in seen:
            if f[0] is not None and f[2] == "joins":
                claims.setdefault(f[1], set()).add(f[0])
        for _ in nodes:
            for members in claims.values():
                least = min(root[m] for m in members)
                root = {n: least if r in {root[m] for m in members} else r for n, r in root.items()}
        want = {}
        for n in nodes:
            want.setdefault(root[n], []).append(n)
        got = {r.person: r for r in view.current().collect()}
        assert set(got) == {f"person:component-{c}" for c in want}
        for c, members in want.items():
            mine, r = [f for f in seen if f[0] in members], got[f"person:component-{c}"]
            known = {i for i, m in claims.items() if m & set(members)}
            decided = max(((f[5], f[7]) for f in seen if f[7] and f[1] in known), default=(None, None))[1]
            called = min(((f[0], f[3]) for f in mine if f[3]), default=(None, None))[1]
            assert (r.nodes, r.n, r.first_at, r.last_at, r.channels, r.name, r.status) == (len(members), sum(f[4] for f in mine), min(f[5] for f in mine), max(f[5] for f in mine), sorted({f[6] for f in mine}), called, decided)
        assert all(root[n] <= names.get(n, n) for n in nodes)  # a name only gives way to an older one
        names = dict(root)
    before = sorted(view.current().collect(), key=repr)
    owner = next(f for f in seen if f[2] == "exclusive")
    with pytest.raises(ValueError):
        view.fold(spark.createDataFrame([(owner[0] + 1, owner[1], "exclusive", None, 1, ts(9), "a", None)], people.FACTS), 9)
    assert sorted(view.current().collect(), key=repr) == before


def test_bridge_pages_in_any_order(spark, tmp_path):
    """Pages in several orders, one of them twice, give the one-shot bridge; null keys make no state."""
    rnd = random.Random(51)
    rows = [(f"k{rnd.randrange(12)}" if i % 9 else None, i, f"r{i}", rnd.choice(["a", "b", None]) if i % 2 else "a") for i in range(90)]
    schema = "v2_key string, append_seq long, id string, canonical string"
    want = append.identity_bridge(spark.createDataFrame(rows, schema).where("v2_key is not null").fillna("", ["canonical"]))
    want = sorted(map(tuple, want.select("v2_key", "winner", "multiplicity", "collision").collect()))
    for order in ((0, 1, 2), (2, 0, 0, 1)):
        view = journal.BridgeView(spark, str(tmp_path / str(order)))
        for page in order:
            view.fold(spark.createDataFrame(rows[30 * page : 30 * page + 30], schema), page)
        assert sorted(map(tuple, view.current().collect())) == want


def test_key_pages_skip_row_groups(spark, tmp_path):
    """A page's conditions reach the scan, and of an index with many row groups it reads few rows."""
    rows = spark.range(40_000).select(F.col("id").alias("append_seq"), F.array(F.concat(F.lit("k"), F.lpad((F.col("id") % 100).cast("string"), 3, "0")), F.lit("all")).alias("keys"))
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", "20000")
    try:
        lake.write_reverse_index(rows, str(tmp_path / "index"))
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
    for key, after, want in (("k042", 20_000, [20_042 + 100 * i for i in range(5)]), ("all", 39_996, [39_997, 39_998, 39_999]), ("none", 0, [])):
        page = lake.key_page(spark, str(tmp_path / "index"), key, after, 5)
        assert [r.position for r in page.collect()] == want
        plan = page._jdf.queryExecution().executedPlan()
        assert "EqualTo(key" in plan.toString() and "GreaterThan(position" in plan.toString()
        scan = (plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan).collectLeaves().head()
        read = scan.metrics().apply("numOutputRows").value()
        assert read <= 8_000, (key, read)  # of 80,000
    with pytest.raises(ValueError):
        lake.session_index(spark.createDataFrame([("s", i, None) for i in range(3)], "source string, session int, published_at timestamp"), most=2)


def test_routing_key_keeps_nanoseconds_beyond_the_second(spark):
    """Nanoseconds count from published's second, as in the SQL; those that reach the next second do not start again at 0."""
    rows = spark.createDataFrame([(1, 999_999, 500), (2, 999_999, 6000), (3, 5, 7)], "k long, us long, ns long")
    rows = rows.select("k", F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("us")).alias("published"), (F.lit(1_700_000_000_000_000_000) + F.col("us") * 1000 + F.col("ns")).alias("published_nanos"), F.lit("s").alias("source_system"), F.lit("c").alias("source_container"))
    got = {r.k: r.fine_published for r in lake.routing_key(rows).collect()}
    assert got == {1: "2023-11-14T22:13:20.999999500Z", 2: "2023-11-14T22:13:20.100000500Z", 3: "2023-11-14T22:13:20.000005007Z"}


def test_cards_are_folded_without_python_state(spark):
    """What arrived last of a draft or an event counts, noise and events of unknown drafts do not; no row goes through Python."""
    rows = [(1, "draft", "", 0, None, None, 0), (1, "draft", "", 5, 9, None, 1), (1, "event", "a", 7, None, "approved", 0), (1, "event", "a", 7, None, "skipped", 1), (1, "event", "b", 8, None, "noise", 1), (2, "event", "a", 1, None, "approved", 0), (3, "draft", "", 2, 4, None, 0)]
    facts = spark.createDataFrame(rows, "draft_id long, kind string, id string, at_us long, expires_us long, event string, arrival long")
    cards = folds.fold_cards(facts, "draft_id")
    assert {tuple(r) for r in cards.collect()} == {(1, "skipped", 7, 1, 9), (3, "pending", 2, 0, 4)}
    assert "Python" not in cards._jdf.queryExecution().executedPlan().toString()


def test_parts_of_a_stream_are_many_files(spark):
    """A stream's part is in as many files as the input's splits ask for, and one trigger takes them all; a bucket that is large is written by several tasks."""
    from millrace.plans import record_queries

    folder, stream = record_queries._stream(spark, spark.range(0, 4000, 1, 16), "id", "parts")
    batches = []
    record_queries._run(stream, lambda batch, number: batches.append((number, batch.count())), folder)
    assert [k for k, _ in batches] == [0, 1] and sum(n for _, n in batches) == 4000 and len(spark.read.parquet(f"{folder}/in").inputFiles()) == 16
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2k")
        store = views.Buckets(spark, f"{folder}/table", "k", 1)
        store.replace([0], spark.range(0, 20000, 1, 16).select(F.lit(1).alias("k"), "id"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert store.read().count() == 20000 and len(store.read([0]).inputFiles()) > 2


def test_ngrams_are_made_in_slices(spark, monkeypatch):
    """A batch's n-grams go to Arrow a few texts at a time; nulls and empty texts keep their places."""
    import pyarrow as pa

    made = []
    array = pa.array
    monkeypatch.setattr(T, "NGRAM_CHARS", 4)
    monkeypatch.setattr(T.pa, "array", lambda rows, *kind: made.append(len(rows)) or array(rows, *kind))
    got = T._ngrams.func(array(["abcd", None, "", "aaa", "xy", "abc"]), array([3] * 6))
    assert got.to_pylist() == [["abc", "bcd"], None, [], ["aaa"], [], ["abc"]] and made == [1, 4, 1] and got.type == pa.list_(pa.string())


def test_source_roots_of_one_link_take_one_join(spark, monkeypatch):
    """Without a second link nothing is doubled or written again; copies of an id and of a link add nothing."""
    written = []
    monkeypatch.setattr(graph, "materialize", lambda df, tag: written.append(tag) or df.localCheckpoint())
    sup = [("o1", [], ["l1", "l2", "l1"]), ("o1", [], ["l2"]), ("o2", [], []), ("o3", ["x"], ["none"]), ("l1", ["p"], []), ("l2", ["q", "p", None], [])]
    got = graph.source_roots(spark.createDataFrame(sup, "id string, observations array<string>, parents array<string>"))
    assert sorted((r.id, tuple(x for x in r.roots if x)) for r in got.collect()) == [("l1", ("p",)), ("l2", ("p", "q")), ("o1", ("p", "q")), ("o1", ("p", "q")), ("o2", ()), ("o3", ("x",))]
    assert written == ["steps"]


def test_component_rounds_of_few_edges_shuffle_nothing(spark, monkeypatch):
    """Few edges are one partition, whose plan has no exchange by node; with more the components are the same."""
    plans, write = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, tag, **more: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, tag, **more))
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 1), (129, 101)]
    edges = spark.createDataFrame(pairs, "a int, b int")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
    assert len(plans) > 3 and not any("Exchange hashpartitioning" in p for p in plans[1:])
    assert {r.node: r.component for r in components.connected_components(edges, few=0).collect()} == got
