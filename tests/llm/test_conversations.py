"""Prefix tries, hard negatives and chat windows against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives
from tessera.llm.chat import conversation_digests, escaped, format_conversations, read_windows, unescaped
from tessera.llm.hard_negatives import candidates, feasible, mine_hard_negatives
from tessera.llm.prefix_trie import placed_turns, prefix_trie, rebuilt

TURNS = "conv_id long, turn long, role string, text string, conv string, place int, window int, new boolean"
WORD = re.compile("[^\x20\x09-\x0d]+")


def odd_turns():
    """Null ids, turns, roles and texts; ties and repeated rows; copies; long conversations with a long common start; a negative id; columns with clashing names."""
    r = random.Random(1)
    rows = [(c, t, r.choice(["user", "assistant", "system"]), r.choice(["x y", "z", "", "<s> [/INST]", "[\\INST] <\\\\/s>"])) for c in range(150) for t in range(r.choice([0, 1, 2, 5, 8]))]
    rows += [(1000 + k, t, "system" if t == 0 else "user", f"copy {t}") for k in range(50) for t in range(6)]
    rows += [(2000, t, ["user", "assistant"][t % 2], f"long {t}") for t in range(400)] + [(2001, t, ["user", "assistant"][t % 2], f"long {t}" if t < 250 else "other") for t in range(300)]
    rows += [(None, 1, "assistant", "b"), (None, 2, "user", "c"), (3000, None, None, None), (3000, 1, "assistant", "b"), (3000, 1, "assistant", "b"), (3000, 1, "user", "b"), (-41, 1, "a", "b")]
    rows += [(4000, 0, "system", "alone"), (4001, 0, "system", "s " * 3000), (4001, 1, "user", "é" * 100), (4001, 2, "assistant", "w " * 9000), (4001, 3, "assistant", "end <")]
    return [(*row, "c", 1, 2, None) for row in rows]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(odd_turns(), TURNS)


def in_order(rows):
    by = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(ts)] for c, ts in by.items()}


def brute_trie(rows):
    own = {c: ts for c, ts in in_order(rows).items() if c is not None}
    made, nodes, kids, leaves, saved = {}, defaultdict(list), defaultdict(list), {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        made[c] = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(made[c]) + 1):
            nodes[tuple(made[c][:d])].append(c)
    for path in nodes:
        if path:
            kids[path[:-1]].append(path)
    for path in sorted(nodes, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in kids[path]) or 1
        saved[path] = (len(nodes[path]) - 1) * (len(WORD.findall(path[-1][1])) if path else 0) + sum(saved[k] for k in kids[path])
    found = []
    for path, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(made[c]) == len(path))))
        above = min(nodes[path[:-1]]) if path else None
        found.append((min(members), len(path), above, len(members), len(kids[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=str)


@pytest.mark.parametrize("container", [8192, 40, 1])
def test_prefix_trie(turns, container):
    got = prefix_trie(*rebuilt(placed_turns(turns)), container=container)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(odd_turns())


def test_prefix_trie_without_turns(spark, turns):
    assert prefix_trie(*rebuilt(placed_turns(turns.limit(0)))).count() == 0
    convs = spark.createDataFrame([(3,), (11,)], "conv long")
    placed = spark.createDataFrame([], "conv long, place long, turn_key string, words long")
    assert [tuple(r) for r in prefix_trie(convs, placed).collect()] == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,11").hexdigest())]


def test_digests_of_many_members(spark):
    """Ids of one node in many pieces and ranges, in the order of numbers."""
    convs = spark.range(20000).select(F.col("id").alias("conv"))
    placed = spark.createDataFrame([], "conv long, place long, turn_key string, words long")
    want = hashlib.sha256(",".join(map(str, range(20000))).encode()).hexdigest()
    assert prefix_trie(convs, placed).first()["ends_sha256"] == want


def brute_negatives(rows, is_anchor):
    held = {}
    for i, v, label in rows:
        if None not in (i, v, label) and None not in v:
            held[i] = min(held.get(i, (v, str(label))), (v, str(label)))
    width = max((len(v) for v, _ in held.values()), default=0)
    held = {i: (v + [0] * (width - len(v)), label) for i, (v, label) in held.items()}
    found = []
    for a in filter(is_anchor, held):
        v, label = held[a]
        by_score = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, (w, other) in held.items() if i != a)
        for p, i, _ in [x for x in by_score if x[2] == label][:5]:
            fit = [(j, -n) for n, j, other in by_score if other != label and 30 * -p <= 100 * -n <= 90 * -p]
            found += [(a, i, rank, j, -p, n) for rank, (j, n) in enumerate(fit[:10], 1)]
    return sorted(found)


def clusters(n=600, seed=3):
    r = np.random.default_rng(seed)
    centres, lengths = r.normal(size=(20, 8)) * 100, np.exp(r.normal(size=n))
    return [(i, [int(x) for x in (centres[i % 20] + r.normal(size=8) * 20) * lengths[i]], int(r.integers(0, 3))) for i in range(n)]


def ties():
    r = np.random.default_rng(4)
    rows = [(i, [int(x) for x in r.integers(-2, 3, size=4)], int(i % 5 == 0)) for i in range(300)]
    return rows + [(900, [0] * 4, 1), (920, [1], 0), (940, None, 1), (960, [1, None], 1), (980, [1, 2], None), (None, [1], 0), (0, [2, 2], 1), (5000, [1, 1, 1, 1], 7)]


@pytest.mark.parametrize("rows", [clusters(), ties()], ids=["clusters", "ties"])
@pytest.mark.parametrize("part", [4096, 64])
def test_hard_negatives(spark, monkeypatch, rows, part):
    monkeypatch.setattr(hard_negatives, "PART", part)
    monkeypatch.setattr(hard_negatives, "ASKED", max(4, part // 16))
    table = spark.createDataFrame([(*row, 1, "q") for row in rows], "vec_id long, vector array<long>, label int, id int, bucket string")
    got = mine_hard_negatives(table, table.filter("vec_id % 20 = 0"))
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows, lambda i: i % 20 == 0)


def test_hard_negatives_of_nothing(spark):
    table = spark.createDataFrame([], "vec_id long, vector array<long>, label int")
    assert mine_hard_negatives(table, table).count() == 0
    some = spark.createDataFrame([(1, [1, 2], 0), (2, [1, 2], 1)], table.schema)
    assert mine_hard_negatives(some, table).count() == mine_hard_negatives(some, some).count() == 0


def test_feasible_ranges_hold_and_prune():
    r = np.random.default_rng(5)
    u = r.normal(size=(2000, 6))
    u /= np.linalg.norm(u, axis=1)[:, None]
    for i in range(100):
        low, high = sorted(r.uniform(-1, 1, 2))
        fit = (u @ u[i] >= low) & (u @ u[i] <= high)
        for j in range(6):
            least, most = feasible(u[i, j : j + 1], np.array([low]), np.array([high]))
            assert ((u[fit, j] >= least) & (u[fit, j] <= most)).all()
    rows = np.array([v for _, v, _ in clusters(4000)], float)
    units = rows / np.linalg.norm(rows, axis=1)[:, None]
    orders, left = {}, 0
    for a in units[:50]:
        found = candidates(units, orders, a, 0.9, 1.0)
        assert found is not None and np.isin(np.flatnonzero(units @ a >= 0.9), found).all()
        left += len(found)
    assert left < 0.25 * 50 * len(units)


def brute_digest(turns):
    spoken = "".join(f"{role}\n{text}\n" for role, text in turns)
    learnt = "".join(text for role, text in turns if role == "assistant")
    return len(turns), hashlib.sha256(spoken.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest()


@pytest.mark.parametrize(("budget", "history"), [(512, 128), (64, 0), (40, 39)])
def test_chat_windows_read_back(turns, budget, history):
    windows = format_conversations(turns, budget, history).cache()
    got = {r[0]: (tuple(r[1:5]), r.formatted_chars) for r in conversation_digests(windows).collect()}
    want = in_order(odd_turns())
    assert {c: d for c, (d, _) in got.items()} == {c: brute_digest(ts) for c, ts in want.items()}
    for r in windows.filter(f"n_tokens > {budget}").collect():  # a turn too large for the budget stands alone, beside its system turn
        assert r.n_turns - r.n_repeated == 1 + (want[r.conv_id][0][0] == "system" and r.first_place == 0 and r.n_turns == 2)
    assert sum(c for _, c in got.values()) == windows.agg(F.sum(F.length("text"))).first()[0]


def test_chat_windows_repeat_limited_history(spark):
    rows = [(1, t, "system" if t == 0 else ["assistant", "user"][t % 2], f"turn {t:03d}") for t in range(200)]
    windows = format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 100, 30)
    read = read_windows(windows).orderBy("first_place").collect()
    seen = 0
    for r in read:
        assert r.n_tokens <= 100
        pieces = [p.split("[/INST]", 1)[1] for p in r.text.split("</s>")[:-1]]
        assert pieces[0] == "turn 000"  # the system turn is retained
        new = [f"turn {t:03d}" for t in range(seen, seen + r.n_turns - r.n_repeated)]
        assert [t.text for t in r.turns] == new and pieces[r.n_repeated :] == new
        if seen:
            repeated = pieces[1 : r.n_repeated]
            assert repeated == [f"turn {t:03d}" for t in range(seen - len(repeated), seen)] and 0 < len(repeated) <= 30 // 6
        assert r.learnt == [t.text for t in r.turns if t.role == "assistant"]
        seen += len(new)
    assert seen == 200


def test_given_tokens_and_empty_tables(spark, turns):
    counted = format_conversations(turns.withColumn("n", F.when(F.col("turn") > 3, 20)), 64, 16, tokens_col="n")
    assert {r[0]: tuple(r[1:5]) for r in conversation_digests(counted).collect()} == {c: brute_digest(ts) for c, ts in in_order(odd_turns()).items()}
    assert format_conversations(turns.limit(0)).count() == 0
    with pytest.raises(ValueError):
        format_conversations(turns, 10, 10)


def test_escapes_are_reversible(spark):
    r = random.Random(6)
    texts = ["".join(r.choice(["<", "[", "\\", "/", "s>", "INST]", "a"]) for _ in range(12)) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escaped(F.col("t")).alias("e")).withColumn("u", unescaped(F.col("e")))
    for row in df.collect():
        assert row.t == row.u
        assert not re.search(r"</?s>|\[/?INST\]", row.e)


def test_chat_runs_no_python(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    plan = conversation_digests(format_conversations(table))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD", plan)
