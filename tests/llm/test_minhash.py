"""Near-duplicates by 5-word Jaccard similarity, against brute force."""

import random

import pytest

import corpus_pipeline
from strataflow.llm import minhash
from strataflow.session import table


def brute(rows, least=0.8):
    """(doc_id, component_id) of rows (doc_id, text)."""
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i, s in enumerate(sets):
        for j in range(i):
            if s == sets[j] or s and sets[j] and len(s & sets[j]) / len(s | sets[j]) >= least:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    ids = [[rows[k][0] for k, h in enumerate(group) if h == g and rows[k][0] is not None] for g in group]
    return [(r[0], min(i) if i else None) for r, i in zip(rows, ids, strict=True)]


def key(r):
    return tuple((v is None, v) for v in r)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(5000)}" for _ in range(120)]
    out = [(100, " ".join(base))]
    for k in range(40):  # near copies with 0 to 4 words changed: similarity from 0.7 to 1
        words = list(base)
        for at in rnd.sample(range(len(words)), k % 5):
            words[at] = f"x{rnd.randrange(10**6)}"
        out.append((101 + k, " ".join(words)))
    out += [(k, " ".join(f"y{rnd.randrange(5000)}" for _ in range(80))) for k in range(30)]
    return out + [(None, " ".join(base[:-1])), (None, None), (60, ""), (61, "  "), (70, "one two"), (71, "One  two"), (72, "one two three"), (5, out[-1][1])]


@pytest.mark.parametrize("block", [64, 7])
def test_near_duplicates(spark, rows, block):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in minhash.near_duplicates(docs, block).select("doc_id", "component_id").collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def chain_of(n, seed=1, step=12, size=100):
    """Texts in a chain: neighbours share all but ``step`` of their words, 0.78 alike; no pair reaches 0.8."""
    rnd = random.Random(seed)
    words = [f"c{seed}-{rnd.randrange(10**9)}" for _ in range(size + step * n)]
    return [" ".join(words[k * step : k * step + size]) for k in range(n)]


def test_unlike_texts_in_chains_meet_only_where_they_share_a_band(spark):
    rows = list(enumerate(chain_of(300) + chain_of(40, 2, 6)))  # the second chain's neighbours are 0.88 alike
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert got == {i: i if i < 300 else 300 for i, _ in rows}
    # sets meet only where a pair shares a band, and sketches leave few of the unlike ones
    sets = [minhash.shingles(t) for _, t in rows[:300]]
    bands = [set(minhash.sketch(s)[0].tolist()) for s in sets]
    share = sum(bool(bands[i] & bands[j]) for i in range(300) for j in range(i))
    left = minhash.across(*inputs(spark, sets, {}), 64).collect()
    by = {}
    for r in left:
        by.setdefault((r.i, r.j), set()).add(r.node)
    names = {minhash.set_key(s): k for k, s in enumerate(sets)}
    met = {(a, b) for group in by.values() for a in group for b in group if a < b}
    assert len(met) <= share < 4 * 300
    assert sum(abs(names[a] - names[b]) > 2 for a, b in met) < 10 and len(met) < 2 * 300


def inputs(spark, sets, group, cell=lambda k: k):
    """keyed, known and nodes of ``minhash.across`` for sets, known groups by place, and each node in a cell of its own."""
    names = [minhash.set_key(s) for s in sets]
    sketches = [minhash.sketch(s) for s in sets]
    keyed = spark.createDataFrame([(k, b, p) for k, (bands, _) in zip(names, sketches, strict=True) for p, b in enumerate(bands.tolist())], "node long, band long, place int")
    known = spark.createDataFrame([(names[k], names[g]) for k, g in group.items()], "node long, known long")
    rows = [(n, cell(k), minhash.set_print(s), len(s), low, bands.tolist()) for k, (n, s, (bands, low)) in enumerate(zip(names, sets, sketches, strict=True))]
    return keyed, known, spark.createDataFrame(rows, "node long, cell long, fp long, n int, low binary, bands array<long>")


@pytest.mark.parametrize("block", [1024, 5])
def test_cells_that_meet(spark, block):
    """All pairs of unlike known groups meet, none within the largest group."""
    import numpy as np

    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = [np.sort(np.r_[base, rng.integers(0, 1 << 63, 3, dtype=np.uint64)]) for _ in range(40)]
    group = {k: 0 if k < 25 else k // 4 * 4 for k in range(40)}
    names = [minhash.set_key(s) for s in sets]
    for cell in (lambda k: k, lambda k: k % 3):
        left = minhash.across(*inputs(spark, sets, group, cell), block).collect()
        by = {}
        for r in left:
            by.setdefault((r.i, r.j), {0: set(), 1: set()})[r.side].add(r.node)
        met = {frozenset((a, b)) for (i, j), s in by.items() for a in s[0] for b in (s[1] if i != j else s[0]) if a != b}
        want = {frozenset((names[a], names[b])) for a in range(40) for b in range(a) if group[a] != group[b]}
        assert want <= met and len(left) == len({(r.i, r.j, r.node) for r in left})
        assert cell(5) != 5 or met == want
        got = minhash._links  # one link for each pair of groups that has none, and no more in a cell
        import pyarrow as pa

        table = pa.table({"side": pa.array([0] * 40, pa.int32()), "node": pa.array(names), "known": pa.array([group[k] for k in range(40)], pa.int64()), "fp": pa.array([minhash.set_print(s) for s in sets]), "n": pa.array([len(s) for s in sets], pa.int32()), "low": pa.array([minhash.sketch(s)[1] for s in sets], pa.binary()), "hashes": pa.array([s.tobytes() for s in sets], pa.binary())})
        assert got(table).num_rows == len(set(group.values())) - 1


def test_small_sets_are_not_judged_by_fingerprints():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    at = np.arange(1)
    for size, shared in ((5, 4), (9, 8), (50, 45)):
        lost = 0
        for _ in range(300):
            union = rng.integers(0, 1 << 63, 2 * size - shared, dtype=np.uint64)
            rows = [np.sort(union[:size]), np.sort(np.r_[union[:shared], union[size:]])]
            if not minhash.similar(*rows):
                continue
            table = pa.table({"fp": [minhash.set_print(s) for s in rows], "n": pa.array([size] * 2, pa.int32()), "low": pa.array([minhash.sketch(s)[1] for s in rows], pa.binary())})
            both = minhash.Sketches(table)
            lost += both.agree(at, both, at + 1)[0] < minhash.AGREE
        assert lost == 0


def test_similar_at_the_bound():
    import numpy as np

    a = np.arange(10, dtype=np.uint64)
    assert minhash.similar(a, a[:8]) and not minhash.similar(a, a[:7])
    assert not minhash.similar(a, a[:0]) and minhash.similar(a[:0], a[:0])


def test_dedup_stage_keeps_no_similar_pair(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = table(spark, sf_dir, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = {a for a, b in brute(rows) if a == b}
    assert {r.doc_id for r in corpus_pipeline.dedup_stage(spark, docs, sf_dir).select("doc_id").collect()} == want


def test_dedup_stage_on_null_and_repeated_ids(spark, rows):
    docs = spark.createDataFrame([*rows, (70, "another text"), (None, rows[0][1]), rows[1]], "doc_id long, text string").selectExpr("*", "'clash' as key", "0 as node")
    got = [tuple(r)[:2] for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()]
    left = [(None if r[0] is None else r[0], r[1]) for r in got]
    assert len(left) == len(set(left)) and (70, "another text") in left and (70, "one two") in left
    # no two rows that stay are alike, and each row that went is in the group of one that stayed
    assert sorted(brute([(k, t) for k, (_, t) in enumerate(left)])) == [(k, k) for k in range(len(left))]
    every = [*rows, (70, "another text"), (None, rows[0][1]), rows[1]]
    group = [g for _, g in brute([(k, t) for k, (_, t) in enumerate(every)])]
    assert len(left) == len(set(group))
