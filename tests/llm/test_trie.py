"""The prefix trie and its contraction against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.llm import trie
from strataflow.session import table

TURNS = "conv_id long, turn long, role string, text string"


def words(text):
    return len(text.encode().split())


def brute(rows, branch=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    convs = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if branch else 0
        convs[c] = own.get(c - c % 20, [])[:h] + t[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in sorted(convs.items()):
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
        ends[tuple(t)].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * words(k[-1][1]) if k else 0
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return Counter((m[0], len(k), members[k[:-1]][0] if k else None, len(m), kids[k], leaves[k], saved[k], sha(ends[k])) for k, m in members.items())


def of(frame):
    return Counter(tuple(r) for r in frame.collect())


def branched(frame):
    conv = F.col("conv_id")
    return trie.prefix_trie(frame, base=conv - conv % 20, head=F.pmod(F.crc32(conv.cast("string")), F.lit(4)))


def test_query_equals_brute_force(spark, sf_dir):
    from strataflow.llm.queries import QUERIES

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()
    assert of(QUERIES["op13_contracted_trie"](spark, sf_dir)) == brute([tuple(r) for r in rows])


def odd_rows():
    rng = random.Random(2)
    say = lambda: rng.choice(["a", "b c", "d e f", "", None, "Ünï\x0bx \xa0y"])
    rows = [(c, t, rng.choice(["user", "assistant", None]), say()) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(100, t, "user", f"t{t} x") for t in range(300)]  # two long copies and one that leaves late
    rows += [(123, t, "user", f"t{t} x") for t in range(300)] + [(140, t, "user", f"t{t} x" if t < 250 else "other") for t in range(260)]
    rows += [(200 + c, t, "u", "same words here") for c in range(80) for t in range(3)]
    rows += [(500, None, "u", "first"), (500, None, "u", "first"), (500, None, None, None), (500, 1, "u", "last"), (501, 3, "a", "x"), (501, 3, "a", "x"), (501, 3, "a", "x")]
    rows += [(None, 0, "user", "nobody's"), (None, None, None, None), (619, 0, "u", "alone"), (-7, 0, "u", "minus")]
    return rows


@pytest.mark.parametrize("branch", [True, False])
def test_odd_rows(spark, branch):
    rows = [r for r in odd_rows() if r[0] != -7] if branch else odd_rows()
    frame = spark.createDataFrame(rows, TURNS).withColumn("depth", F.lit("clash")).withColumn("p", F.lit(0)).withColumn("id", F.lit(None))
    got = of(branched(frame) if branch else trie.prefix_trie(frame))
    assert got == brute(rows, branch)


def test_long_conversations_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(trie, "PARTITION_ROWS", 40)
    monkeypatch.setattr(trie, "RUN", 30)
    rows = odd_rows()
    rows = [r for r in rows if r[0] != -7]
    assert of(branched(spark.createDataFrame(rows, TURNS).repartition(5))) == brute(rows)


def test_pieces_of_hashed_lists(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 3)
    rows = spark.range(40).selectExpr("id % 3 as depth", "id % 2 as k1", "cast(0 as long) as k2", "id * 37 % 41 - 5 as conv_id")
    got = {(r.depth, r.k1): r.list_sha256 for r in trie.list_hashes(rows).collect()}
    by = defaultdict(list)
    for r in rows.collect():
        by[r.depth, r.k1].append(r.conv_id)
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in by.items()}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "caterpillar", "forest", "one"])
def test_contraction(spark, shape):
    rng = random.Random(shape)
    n = {"one": 1, "chain": 200}.get(shape, 150)
    parent = {
        "random": lambda i: rng.randrange(i),
        "chain": lambda i: i - 1,
        "star": lambda i: 0,
        "caterpillar": lambda i: i - 1 if i % 2 else max(0, i - 3),
        "forest": lambda i: rng.choice([None, rng.randrange(i), i - 1]),
        "one": lambda i: None,
    }[shape]
    rows = [(i, parent(i) if i else None, rng.randrange(5), rng.randrange(100)) for i in range(n)]
    total = {i: [a, b] for i, _, a, b in rows}
    for i, p, _, _ in reversed(rows):
        if p is not None:
            total[p][0] += total[i][0]
            total[p][1] += total[i][1]
    frame = spark.createDataFrame(rows, "id long, parent long, leaves long, saved long")
    got = trie.contract(frame).collect()
    assert {r.id: [r.leaves, r.saved] for r in got} == total and len(got) == n


def test_running_states():
    rng = np.random.default_rng(1)
    d = rng.integers(0, int(trie.PRIME), (50, 4))
    start = np.repeat([0, 7, 8, 30], [7, 1, 22, 20])
    got = trie.running(d, start)
    for col in range(4):
        state = 0
        for i in range(50):
            state = (0 if i == start[i] else state) * int(trie.BASES[col]) + int(d[i, col])
            state %= int(trie.PRIME)
            assert got[i, col] == state


def test_empty_table_and_turnless(spark):
    assert trie.prefix_trie(spark.createDataFrame([], TURNS)).collect() == []
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "u", "x")], TURNS)).count() == 0
    # 619 and 39 lend from conversations that aren't there
    rows = [(c, 0, "u", "x") for c in (619, 39, 38)]
    assert of(branched(spark.createDataFrame(rows, TURNS))) == brute(rows)
