"""Near-duplicates by wide SimHash fingerprints: candidates by segments and chains, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from test_minhash import brute, chain_of, key, rows  # noqa: F401

import corpus_pipeline
from strataflow.llm import minhash, wide_simhash


@pytest.mark.parametrize(("block", "small"), [(4096, 1024), (7, 5)])
def test_near_duplicates(spark, rows, block, small, monkeypatch):  # noqa: F811
    monkeypatch.setattr(wide_simhash, "BLOCK", small)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in wide_simhash.near_duplicates(docs, block).select("doc_id", "component_id").collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_dedup_stage_takes_its_candidates_from_simhash(spark, rows, monkeypatch):  # noqa: F811
    def replaced(*_):
        raise AssertionError("MinHash in place of SimHash")

    for name in ("near_duplicates", "across"):
        monkeypatch.setattr(minhash, name, replaced)
    docs = spark.createDataFrame([r for r in rows if r[0] is not None], "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.dedup_stage(spark, docs, "").select("doc_id").collect()}
    assert kept == {a for a, b in brute([r for r in rows if r[0] is not None]) if a == b}


def test_chains_of_unlike_texts(spark):
    docs = list(enumerate(chain_of(300) + chain_of(40, 2, 6)))  # the second chain's neighbours are 0.88 alike
    got = {r.doc_id: r.component_id for r in wide_simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: i if i < 300 else 300 for i, _ in docs}


def edited(n, seed=7):
    """Near copies of one text with 1 to 12 words changed, many of them alike to none."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(5000)}" for _ in range(150)]
    out = []
    for k in range(n):
        words = list(base)
        for at in rnd.sample(range(len(words)), 1 + k % 12):
            words[at] = f"x{rnd.randrange(10**6)}"
        out.append((k, " ".join(words)))
    return out


def test_a_large_group_makes_few_rows(spark, monkeypatch):
    docs, made = edited(240), []
    plain = wide_simhash.cut

    def counted(df):
        out = plain(df)
        made.append(out.count())
        return out

    monkeypatch.setattr(wide_simhash, "cut", counted)
    got = [tuple(r) for r in wide_simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "component_id").collect()]
    assert sorted(got) == sorted(brute(docs))
    sets = [minhash.shingles(t) for _, t in docs]
    unlike = {i: c for i, c in got}
    close = sum(unlike[i] != unlike[j] and len(np.intersect1d(sets[i], sets[j])) * 3 >= 2 * len(np.union1d(sets[i], sets[j])) for i in range(240) for j in range(i))
    assert max(made) <= close + 16 * 240  # pairs near the bound, and first links


def test_budgets_and_segments():
    for nodes in (100, 10**6, 10**10):
        bits, count = wide_simhash.segments(nodes)
        assert (1 - (1 - wide_simhash.APART) ** bits) ** count <= wide_simhash.LOSS
    rng = np.random.default_rng(2)
    for n in (64, 300):
        for _ in range(40):
            union = rng.integers(0, 1 << 63, n + n // 4, dtype=np.uint64)
            pair = [np.sort(union[: n + n // 8]), np.sort(np.r_[union[:n], union[n + n // 8 :]])]
            table = pa.table({"n": [len(s) for s in pair], "print": [wide_simhash.wide_print(s, 64) for s in pair]})
            bits = wide_simhash.Prints(table).apart(np.array([0]), np.array([1]))[0]
            assert minhash.similar(*pair) and 0 <= bits < 0.19 * 4096


def test_similar_small_sets_share_a_prefix():
    rng = np.random.default_rng(4)
    for size, shared in ((5, 4), (10, 9), (50, 45), (79, 71), (64, 64)):
        for _ in range(100):
            union = rng.integers(0, 1 << 63, 2 * size - shared, dtype=np.uint64)
            pair = [np.sort(union[:size]), np.sort(np.r_[union[:shared], union[size:]])]
            if minhash.similar(*pair):
                assert np.intersect1d(*map(wide_simhash.prefix, pair)).size
