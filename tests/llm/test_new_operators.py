"""Prefix trie, structure repair and substring dedup against brute-force versions, odd rows included."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import common, path_graph, prefix_trie, repair

TURNS = "conv_id long, turn long, role string, text string, conv string, g1 string"


def answer(df, names):
    return sorted((tuple(r) for r in df.select(*names.split()).collect()), key=repr)


TRIE = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256"


def brute_trie(rows):
    """All prefixes of rebuilt conversations in a dictionary; rows have different turns within a conversation."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in own.items()}
    rebuilt, nodes, kids, leaves, saved = {}, defaultdict(list), Counter(), Counter(), Counter()
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - c % 100, [])[:h] + ts[h:]
        for d in range(len(rebuilt[c]) + 1):
            nodes[tuple(rebuilt[c][:d])].append(c)
    for n in nodes:
        if n:
            kids[n[:-1]] += 1
    for n, members in nodes.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not kids[n]
            saved[n[:d]] += (len(members) - 1) * len(n[-1][1]) if n else 0
    ends = lambda n: ",".join(str(c) for c in sorted(nodes[n]) if len(rebuilt[c]) == len(n))
    return sorted(((min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n], hashlib.sha256(ends(n).encode()).hexdigest()) for n, m in nodes.items()), key=repr)


def conversations(seed, many=300):
    """Few texts, so that prefixes are shared; long ones, gaps, null turns, roles and texts, and bases that are missing or short."""
    r, out = random.Random(seed), []
    for c in range(many):
        if c % 100 == 0 and r.random() < 0.3:
            continue
        turns = r.sample(range(3000), r.choice([1, 2, 3, 5, 8, 8, 40])) if c != 7 else range(150)
        for k, t in enumerate(sorted(turns)):
            turn = None if k == 0 and r.random() < 0.2 else t
            out.append((c, turn, r.choice(["user", "assistant", "system", "tool", None]), r.choice(["", " \n", None, "Yes.", "no", "héllo! ", "a.b?", "x" * 5000]), "c", "g"))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed):
    rows = conversations(seed)
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    assert answer(prefix_trie.rollup(df), TRIE) == brute_trie(rows)


def test_trie_of_a_conversation_over_many_partitions(spark):
    """One conversation has most rows: places and sums go on from partition to partition; its digest of ends is pieced together."""
    rows = [(100, t, "user", str(t % 7), "c", "g") for t in range(150)] + [(c, 0, "user", "same", "c", "g") for c in range(101, 400)] + [(None, 1, "user", "x", "c", "g")]
    spark.conf.set("spark.sql.shuffle.partitions", 11)
    try:
        assert answer(prefix_trie.rollup(spark.createDataFrame(rows, TURNS)), TRIE) == brute_trie(rows)
        ends = spark.createDataFrame([(k % 2, 5, k) for k in range(5000)], "g1 long, g2 long, conv_id long")
        want = [(k, hashlib.sha256(",".join(map(str, range(k, 5000, 2))).encode()).hexdigest()) for k in (0, 1)]
        assert sorted((r.g1, r.ends_sha256) for r in prefix_trie.ends_digest(ends, 200).collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_trie_of_ties_and_nothing(spark):
    tied = [(5, 1, "user", "b", "c", "g"), (5, 1, "user", "a", "c", "g"), (5, 1, "user", "a", "c", "g"), (5, 1, None, None, "c", "g")]
    got = prefix_trie.rollup(spark.createDataFrame(tied, TURNS)).collect()
    assert sorted(prefix_trie.rollup(spark.createDataFrame(tied[::-1], TURNS)).collect()) == sorted(got)  # the order of rows does not matter
    assert prefix_trie.rollup(spark.createDataFrame([], TURNS)).count() == 0


def test_sums_that_wrap(spark):
    r = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, (200, 2))
    rows = spark.createDataFrame(r.tolist(), "a long, b long")
    got = rows.select("a", "b", prefix_trie.wrap_add(rows.a, rows.b).alias("s"), prefix_trie.wrap_minus(rows.a, rows.b).alias("d")).collect()
    wrap = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
    assert all((x.s, x.d) == (wrap(x.a + x.b), wrap(x.a - x.b)) for x in got)


REPAIR = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256"
FOLLOWS = {0: 2, 1: 2, 2: 3, 3: 2}


def cheapest(seq, faults):
    """cost, audit, lines of the best edits: for each state the least (cost, audit), turn by turn."""

    def grown(states):
        for _ in range(2):
            for q, (cost, audit, lines) in [*states.items()]:
                more = (cost + 5, audit + "I", (*lines, "user:" if FOLLOWS[q] == 2 else "assistant:"))
                if FOLLOWS[q] not in states or more[:2] < states[FOLLOWS[q]][:2]:
                    states[FOLLOWS[q]] = more
        return states

    states = grown({0: (0, "", ())})
    for (_, role, text), fault in zip(seq, faults, strict=True):
        now = {}
        for q, (cost, audit, lines) in states.items():
            moves = [(q, 2, "D", ())]
            if fault not in ("blank", "duplicate"):
                cut = 5 * (fault == "truncated")
                for to, letter in {(1, "s")} if q == 0 else ():
                    moves += [(to, cut, "K", (f"{role}:{text}",))] if role[:1] == letter else []
                to = FOLLOWS[q]
                moves += [(to, cut, "K", (f"{role}:{text}",))] if role[:1] == " sua"[to] else []
                moves += [(to, cut + 1, "R", (f"{['', '', 'user', 'assistant'][to]}:{text}",))]
            for to, more, letter, line in moves:
                if to not in now or (cost + more, audit + letter) < now[to][:2]:
                    now[to] = (cost + more, audit + letter, lines + line)
        states = grown(now)
    return min((states[q] for q in (0, 3) if q in states), key=lambda x: x[:2])


def brute_repair(rows):
    convs = {r[0]: [] for r in rows}
    for c, turn, role, text, *_ in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[c] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for c, seq in convs.items():
        seq.sort(key=lambda x: (x[0] is not None, x[0] or 0))
        turns, seen, faults = {x[0] for x in seq} - {None}, set(), []
        for _, role, text in seq:
            end = text.strip(" \t\n\x0b\f\r")[-1:]
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else None)
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(seq, seq[1:]))
        cost, audit, lines = cheapest(seq, faults)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((c, gaps, *[faults.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "bits"), [(3, 10), (4, 3), (5, 1)])
def test_repair(spark, seed, bits, monkeypatch):
    """With small blocks, so that conversations have many of them, too."""
    monkeypatch.setattr(repair, "BLOCK_BITS", bits)
    r = random.Random(seed)
    rows = [(c, t, r.choice(["user", "assistant", "assistant", "user", "system"]), f"{r.choice(['a', 'b', 'ü', ''])}{t // 2}{r.choice(['.', '!', '', ' ?', ''])}", "c", "g") for c in range(150) for t in r.sample(range(60), r.randint(1, 24))]
    rows += [x for x in conversations(seed, 60) if x[0] != 7] + [(None, 3, "user", "Hi.", "c", "g"), (None, 4, "assistant", "Ho.", "c", "g"), (900, None, None, None, "c", "g")]
    seen = set()
    rows = [x for x in rows if not (x[:2] in seen or seen.add(x[:2]))]  # one row a turn: ties have an order of their own
    assert answer(repair.report(spark.createDataFrame(rows, TURNS).repartition(5)), REPAIR) == brute_repair(rows)


def test_repair_of_every_short_conversation():
    """All conversations of up to five turns of all classes, in numpy alone, against all edits."""
    r = random.Random(7)
    for _ in range(300):
        codes = [r.choice([0, 1, 2, 3, 4, 5, 8, 9, 10, 11]) for _ in range(r.randint(0, 5))]
        seq = [(None, {0: "system", 1: "user", 2: "assistant", 3: "x"}[c & 3], "t") for c in codes]
        faults = ["blank" if c & 4 else "truncated" if c & 8 else None for c in codes]
        first = np.where(np.arange(4) == 0, 0, repair.FAR)[None]
        letters, _, cost = repair.edits([bytes(codes)], first, repair.ENDS[None], np.array([0]), np.array([True]))
        want = cheapest(seq, faults)
        assert (int(cost[0]), letters[0].decode().translate(str.maketrans("UAua", "IIRR"))) == want[:2]


def test_repair_of_ties_and_nothing(spark):
    tied = [(5, 1, "user", "b.", "c", "g"), (5, 1, "assistant", "a.", "c", "g"), (5, 1, "assistant", "a.", "c", "g"), (5, 1, None, None, "c", "g")]
    assert repair.report(spark.createDataFrame(tied, TURNS)).collect() == repair.report(spark.createDataFrame(tied[::-1], TURNS)).collect()
    assert repair.report(spark.createDataFrame([], TURNS)).count() == 0


SPANS = "doc_id n_words n_removed kept_sha256"


def brute_spans(rows, size=35):
    cut = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    n = Counter(tuple(w[i : i + size]) for w in cut for i in range(len(w) - size + 1))
    out = []
    for (doc_id, _), w in zip(rows, cut, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if n[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return sorted(out, key=repr)


def planted(seed):
    """Passages of 33 to 120 words at changing places, copies, near copies, repeats within a text, and runs of one word."""
    r = random.Random(seed)
    word = lambda: r.choice(["a", "b", "ä", "c" * 9]) if r.random() < 0.1 else f"w{r.randrange(5000)}"
    passages = [[word() for _ in range(n)] for n in (33, 34, 35, 36, 50, 63, 64, 120)]
    texts = []
    for _ in range(120):
        w = []
        for _ in range(r.randint(0, 4)):
            w += [word() for _ in range(r.choice([0, 1, 5, 40]))] + r.choice([[], *passages])
        texts.append(r.choice([" ", "\n", "\t \n"]).join(w) + r.choice(["", " ", "\n"]))
    texts += texts[:10] + [t.replace("w1", "v1", 1) for t in texts[:20]] + ["x " * 34, "x " * 35, "x " * 36, "y " * 400, "ab " * 100 + "end", "", None, " \n", "q" * 600_000, " ".join(f"u{k}" for k in range(70_000)), " ".join(f"u{k}" for k in range(30_000, 66_000))]
    return [(k if k % 11 else None, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings(spark, seed, tmp_path):
    rows = planted(seed)
    spark.createDataFrame([(*x, 1, "s") for x in rows], "doc_id long, text string, n_words int, spans string").repartition(4).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    done = common.materialize(path_graph.without_repeats(docs, digest="kept_sha256"), "done")
    assert done.columns == ["doc_id", "text", "n_words", "spans", "n_words_", "n_removed", "kept_sha256"]
    got = done.withColumnRenamed("n_words", "old").withColumnRenamed("n_words_", "n_words")
    assert answer(got, SPANS) == brute_spans(rows)
    assert all(r.kept_sha256 == hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest() for r in done.collect())
    assert path_graph.without_repeats(docs).columns == done.columns[:-1]
    assert done.where("n_removed = 0").select("text").subtract(docs.select("text")).isEmpty()
    assert path_graph.without_repeats(docs.where("false")).count() == 0
    assert path_graph.without_repeats(docs.where("doc_id < 3 and text is null")).count() == 0


def test_chunks_and_names(monkeypatch):
    """Names do not depend on where a chunk or a piece of the text begins."""
    r = random.Random(5)
    text = " ".join(r.choice(["one", "two", "three", "vier", "fünf"]) for _ in range(3000)).encode()
    starts, ends = path_graph.words_of(text)
    assert [text[a:b] for a, b in zip(starts, ends, strict=True)] == text.split()
    whole = path_graph.word_names(text, starts, ends, 1)
    assert (whole == path_graph.word_names(text, starts, ends, 1, 100)).all()
    assert len(set(whole.tolist())) == 5
    long = path_graph.Named(text).named(np.arange(len(starts) - 34), 35)[0]
    monkeypatch.setattr(path_graph, "CHUNK", 64)
    _, s1, _, first, n = path_graph.segments(text, 35)
    assert first.tolist() == [0, *np.cumsum(n)[:-1].tolist()] and n.sum() == len(starts) - 34
    assert (s1 == path_graph.Named(text).named(first, n + 34)[0]).all() and len(long) == len(starts) - 34
    assert (path_graph.Named(text[starts[7] :]).named(np.arange(50), 35)[0] == long[7:57]).all()
    assert [x.tolist() for x in path_graph.spread(np.array([5, 9, 2]), np.array([2, 0, 3]))] == [[5, 6, 2, 3, 4], [0, 1, 0, 1, 2]]
