"""Language mixtures against a brute-force expectation-maximisation over every set of languages."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa

from strataflow.llm import langid


def model_of(rng, names=("a", "b", "c")):
    counts = rng.dirichlet(np.full(langid.BUCKETS, 0.02), len(names)) + 1e-7
    return langid.Model(names, np.log(counts / counts.sum(axis=1, keepdims=True)))


def brute_fit(buckets, model, chosen):
    """Proportions and log likelihood of one set of languages, after many steps."""
    p = {k: [math.exp(model.log_p[k, b]) for b in buckets] for k in chosen}
    pi = dict.fromkeys(chosen, 1 / len(chosen))
    for _ in range(3000):
        new = dict.fromkeys(chosen, 0.0)
        for e in range(len(buckets)):
            total = sum(pi[k] * p[k][e] for k in chosen)
            for k in chosen:
                new[k] += pi[k] * p[k][e] / total / len(buckets)
        pi = new
    return pi, sum(math.log(sum(pi[k] * p[k][e] for k in chosen)) for e in range(len(buckets)))


def brute_mixture(buckets, model):
    best = None
    for n in range(1, len(model.languages) + 1):
        for chosen in itertools.combinations(range(len(model.languages)), n):
            pi, fit = brute_fit(buckets, model, chosen)
            score = fit - langid.PENALTY * math.log(max(len(buckets), 2)) / 2 * n
            if best is None or score > best[0]:
                best = (score, pi)
    return best[1]


def test_mixtures_equal_brute_force():
    rng = np.random.default_rng(5)
    model = model_of(rng)
    p = np.exp(model.log_p)
    shares = [(1, 0, 0), (0, 1, 0), (0.5, 0.5, 0), (0.2, 0.8, 0), (0.3, 0.3, 0.4), (0, 0.15, 0.85)]
    texts = [rng.choice(langid.BUCKETS, 60, p=np.array(s) @ p) for s in shares]
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    got = langid.mixtures(row, np.concatenate(texts), len(texts), model)
    for k, t in enumerate(texts):
        want = brute_mixture(t.tolist(), model)
        assert {i for i in range(3) if got[k, i] > 0} == set(want)
        assert all(abs(got[k, i] - v) < 0.05 for i, v in want.items())


def test_a_text_alone_gets_the_same_mixture():
    rng = np.random.default_rng(9)
    model = model_of(rng)
    p = np.exp(model.log_p)
    texts = [rng.choice(langid.BUCKETS, rng.integers(2, 120), p=rng.dirichlet((0.4, 0.4, 0.4)) @ p) for _ in range(150)]
    together = langid.mixtures(np.repeat(np.arange(len(texts)), [len(t) for t in texts]), np.concatenate(texts), len(texts), model)
    for k, t in enumerate(texts):
        assert langid.mixtures(np.zeros(len(t), np.int64), t, 1, model)[0].tolist() == together[k].tolist()


def brute_grams(text):
    t = "".join(c if c.isalpha() else " " for c in " " + (text or "").lower() + " ")
    return [t[k - 1 : k + 2] for k in range(1, len(t) - 1) if t[k] != " "]


def test_grams_equal_brute_force():
    texts = [None, "", "12 !", "Ab c", "ÀÉ-x", "a" * 5000, "İstanbul ß", "Ab c"]
    row, bucket, has = langid.grams(pa.array(texts, pa.string()))
    names = {}
    for k, t in enumerate(texts):
        want = brute_grams(t)
        own = bucket[row == k].tolist()
        assert len(own) == len(want) and has[k] == bool(want)
        assert all(names.setdefault(g, b) == b for g, b in zip(want, own, strict=True))


def test_long_repeated_and_tied_texts(spark):
    rng = random.Random(3)
    voices = {"xx": ["kata", "mori", "sato"], "yy": ["schrift", "pfung", "echtz"]}
    say = lambda k, n: " ".join("".join(rng.choice(voices[k]) for _ in range(2)) for _ in range(n))
    rows = [(i, say(k, 40), k) for i, k in enumerate(["xx", "yy"] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    odd = [(500, say("yy", 60000), None), (501, say("xx", 9), "yy"), (501, say("xx", 9), "yy"), (502, "\u4e2d\u6587", None)]
    got = langid.identify(docs.union(spark.createDataFrame(odd, docs.schema)), model).collect()
    assert len(got) == 84 and all(0 <= r.score <= 1 for r in got)
    assert [r.lang_pred for r in got if r.doc_id == 500] == ["yy"] and [r.lang_pred for r in got if r.doc_id == 501] == ["xx", "xx"]
    same = langid.Model(("a", "b"), np.log(np.full((2, langid.BUCKETS), 1 / langid.BUCKETS)))
    tied = langid.mixtures(np.zeros(5, np.int64), np.arange(5), 1, same)  # the first leaves first among equals
    assert tied.tolist() == [[0.0, 1.0]]
