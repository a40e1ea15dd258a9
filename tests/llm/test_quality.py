"""The pairwise ranking against brute force: features, the loss over spelt-out pairs, and its minimum."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strataflow.llm import quality

TEXTS = [None, "", " \n\t", "Aa bb1 Aa bb1 Aa bb1 ü!", "x\nx\ny\n\nx", "ÄÖ ß ### ||| 12,5 € 中", "word " * 500, "#", "a b c", "e\x0bf\x85g"]


def brute_kind(c):
    if ord(c) < 128:
        return "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c
    return "a" if c.islower() else "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c


def brute_grams(text):
    t = " " + "".join(map(brute_kind, text or "")) + " "
    out = Counter()
    for k in range(1, len(t) - 1):
        out.update([t[k], t[k - 1 : k + 1], t[k - 1 : k + 2]])
    return out


@pytest.mark.parametrize("chunk", [1, 5, 1 << 18])
def test_grams_equal_brute_force(monkeypatch, chunk):
    monkeypatch.setattr(quality, "CHUNK", chunk)
    counts = quality.slot_counts(pa.array(TEXTS))
    for k, t in enumerate(TEXTS):
        kind, _ = quality.kinds_of(pa.array([t], pa.string()))
        assert "".join(map(chr, kind)) == " " + "".join(map(brute_kind, t or "")) + " "
        own = Counter(quality.grams(kind).ravel().tolist())
        assert sum(own.values()) == sum(brute_grams(t).values())
        assert {s: int(c) for s, c in enumerate(counts[k]) if c} == own
    # the same n-gram has the same slot wherever it stands
    one, two = (quality.grams(quality.kinds_of(pa.array([t]))[0]) for t in ("x#1b y", "q#7c?"))
    assert (one[1:3] == two[1:3]).all()


def brute_shape(text):
    t = text or ""
    w = t.encode().split()
    w = [x.decode() for x in w]
    g = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    lines = [x for x in t.split("\n") if x]
    share = lambda a: len(set(a)) / len(a) if a else 1.0
    return [math.log1p(len(w)), min(sum(map(len, w)) / max(len(w), 1), 30.0), math.sqrt(share(w)), share(g), share(lines)]


def test_shapes_equal_brute_force():
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice("ab cd ef\n").strip() + rng.choice(["", "\n", "x"]) for _ in range(rng.randint(0, 40))) for _ in range(80)]
    assert np.allclose(quality.shapes(pa.array(texts)), [brute_shape(t) for t in texts])


def test_pairs_and_minimum_equal_brute_force():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (50, 4))
    y = (x[:, 0] - x[:, 1] + rng.normal(0, 1, 50) > 0).astype(int)
    better, worse = quality.draw_pairs(y, 5)
    assert (y[better] == 1).all() and (y[worse] == 0).all() and len(better) == 5 * min(y.sum(), (1 - y).sum())
    w = rng.normal(0, 1, 4)
    brute = lambda v, z: sum(math.log1p(math.exp(-float((z[a] - z[b]) @ v))) for a, b in zip(better, worse, strict=True)) / len(better) + 0.5 * 0.01 * float(v @ v)
    loss, slope, _ = quality.pair_loss(w, x, better, worse, 0.01)
    assert abs(loss - brute(w, x)) < 1e-9
    for j in range(4):
        step = np.zeros(4)
        step[j] = 1e-5
        assert abs((brute(w + step, x) - brute(w - step, x)) / 2e-5 - slope[j]) < 1e-6
    fitted = quality.fit_pairs(x, y, (), 5, 0.01)
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-9)
    best = brute(np.array(fitted.weights), z)
    assert all(brute(np.array(fitted.weights) + rng.normal(0, 0.05, 4), z) >= best - 1e-9 for _ in range(50))
    # the cut is the quantile of scores with the fewest wrong labels
    score = fitted.score(x)
    wrong = ((score >= quality.CUT) != (y == 1)).sum()
    assert wrong == min(min(((score >= c) != (y == 1)).sum() for c in score), (y == 1).sum())


def test_clashing_labels_and_repeats(spark):
    rng = random.Random(2)
    good = lambda: " ".join(f"{rng.choice('abcdef')}{rng.choice('xyz')}{rng.choice('mno')}" for _ in range(60)) + "."
    texts = [good() if k % 3 else "### BUY!!! " * 30 + str(k) for k in range(150)]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)] + [(500, texts[1], "x"), (500, texts[1], "x"), (None, None, None)], "doc_id long, text string, score string")
    labels = [(k, int(k % 3 > 0), 0) for k in range(150)] + [(500, 0, 0), (0, 1, 0), (None, 0, 0), (1, None, 0)]
    ranking = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = quality.score_documents(docs, ranking).collect()
    assert len(got) == 153 and sum(r.doc_id == 500 for r in got) == 2
    assert sum(r.predicted != int(r.doc_id % 3 > 0) for r in got if r.doc_id is not None and r.doc_id < 150) <= 1
    kept = quality.keep_good(docs, ranking)
    assert kept.schema == docs.schema and kept.count() == sum(r.predicted for r in got)
