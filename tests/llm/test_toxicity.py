"""The counterfactual fit against brute force, and its data: swaps, labels of copies, repeated rows."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from strataflow.llm import toxicity
from strataflow.llm.toxicity import Rows

FEATURES = ["men", "women", "wome~", "idiot", "calm"]
KINDS = (("men", "women"), ("absent", "calm"))


def rows_of(dense, y):
    dense = np.array(dense)
    row, feature = np.nonzero(dense)
    return Rows(row, feature, dense[row, feature], dense.sum(axis=1) + 3.0, np.array(y, dtype=float))


@pytest.fixture
def small():
    rng = np.random.default_rng(4)
    dense = rng.poisson(0.7, (60, len(FEATURES)))
    dense[:, 2] = dense[:, 1]  # a beginning goes with its word
    y = (rng.random(60) < 1 / (1 + np.exp(1 - 2 * dense[:, 3] - dense[:, 1]))).astype(float)
    return dense, y


def brute_swaps(dense):
    out = []
    index = {f: i for i, f in enumerate(FEATURES)}
    for kind in KINDS:
        for k, t in enumerate(kind):
            o = kind[(k + 1) % len(kind)]
            if t not in index:
                continue
            for x in dense:
                if x[index[t]]:
                    after = x.astype(float).copy()
                    for f in toxicity.features_of(t):
                        if f in index:
                            after[index[f]] -= x[index[t]]
                    for f in toxicity.features_of(o):
                        if f in index:
                            after[index[f]] += x[index[t]]
                    out.append(np.log1p(after) - np.log1p(x))
    return np.array(out)


def brute_loss(w, dense, y, counterfactual, ridge):
    d = len(FEATURES)
    total = 0.0
    for x, t in zip(dense, y, strict=True):
        odds = sum(w[j] * math.log1p(x[j]) for j in range(d)) + w[d] * math.log1p(x.sum() + 3) + w[d + 1]
        p = 1 / (1 + math.exp(-odds))
        total -= (t * math.log(p) + (1 - t) * math.log(1 - p)) / len(y)
    moved = brute_swaps(dense) @ w[:d]
    return total + 0.5 * ridge * sum(v * v for v in w[: d + 1]) + 0.5 * counterfactual * (moved**2).mean()


def test_swaps_equal_brute_force(small):
    dense, y = small
    i, j, v, n = toxicity.swaps(rows_of(dense, y), FEATURES, KINDS)
    got = np.zeros((len(FEATURES), len(FEATURES)))
    np.add.at(got, (i, j), v)
    want = brute_swaps(dense)
    assert n == len(want) and np.allclose(got, want.T @ want / n)


@pytest.mark.parametrize("counterfactual", [0.0, 1.0, 50.0])
def test_fit_is_the_minimum(small, counterfactual):
    dense, y = small
    m = toxicity.fit_rows(rows_of(dense, y), FEATURES, KINDS, counterfactual, 0.01)
    w = np.array([*(m.weights[f] for f in FEATURES), m.length, m.bias])
    best = brute_loss(w, dense, y, counterfactual, 0.01)
    for j in range(len(w)):  # a numeric slope of zero in each direction
        step = np.zeros(len(w))
        step[j] = 1e-4
        slope = (brute_loss(w + step, dense, y, counterfactual, 0.01) - brute_loss(w - step, dense, y, counterfactual, 0.01)) / 2e-4
        assert abs(slope) < 2e-4
    rng = np.random.default_rng(1)
    assert all(brute_loss(w + rng.normal(0, 0.1, len(w)), dense, y, counterfactual, 0.01) >= best for _ in range(30))


def test_penalty_holds_at_any_number_of_rows():
    dense, y = np.array([[0, 1, 1, 1, 0], [0, 1, 1, 0, 0], [0, 0, 0, 1, 0], [0, 0, 0, 0, 1], [0, 1, 1, 0, 0], [1, 0, 0, 0, 0]]), [1, 1, 1, 0, 1, 0]
    weights = [toxicity.fit_rows(rows_of(np.tile(dense, (k, 1)), y * k), FEATURES, KINDS, 1.0, 0.01).weights for k in (20, 200)]
    assert abs(weights[0]["women"] - weights[1]["women"]) < 1e-3
    free = toxicity.fit_rows(rows_of(np.tile(dense, (20, 1)), y * 20), FEATURES, KINDS, 0.0, 0.01).weights
    held = toxicity.fit_rows(rows_of(np.tile(dense, (20, 1)), y * 20), FEATURES, KINDS, 30.0, 0.01).weights
    gap = lambda w: w["women"] + w["wome~"] - w["men"]
    assert gap(held) < gap(free) / 3 and held["idiot"] > 1


def test_feature_counts_equal_brute_force():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["Foobar!", "foo", "(ÉTÉ)", "été", "###", "foobarbaz", "a\x0bb"]) for _ in range(rng.randint(0, 30))) for _ in range(50)] + [None, "", " \n"]
    row, feature, count, names, n_words = toxicity.feature_counts(pa.array(texts))
    got = {}
    for r, f, c in zip(row.tolist(), feature.tolist(), count.tolist(), strict=True):
        got.setdefault(r, {})[names[f].as_py()] = c
    for k, t in enumerate(texts):
        words = [w for w in (x.strip(toxicity.SIGNS).lower() for x in (t or "").split()) if w]
        want = {}
        for w in words:
            for f in toxicity.features_of(w):
                want[f] = want.get(f, 0) + 1
        assert got.get(k, {}) == want and n_words[k] == len(words)


DOCS = "doc_id long, text string"


def test_terms_are_found_and_false_alarms_fall(spark):
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(1500):
        toxic = rng.random() < 0.3
        words = [f"w{rng.randint(0, 200)}" for _ in range(30)]
        if toxic:
            words[3] = rng.choice(["idiot", "scum", "moron"])
        # one group is spoken of in toxic texts more often than another, in the same frame
        if rng.random() < 0.4:
            words += ["those", "aaland" if rng.random() < (0.9 if toxic else 0.1) else "bbland", "people"]
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    d, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(d, lab, terms={"lands": ["aaland", "bbland"]})
    assert model.n_swaps > 100
    neutral = spark.createDataFrame([(9000 + i, " ".join(f"w{rng.randint(0, 200)}" for _ in range(30)) + " those aaland people") for i in range(50)], DOCS)
    assert toxicity.score_documents(neutral, model).where("predicted = 1").count() == 0
    assert abs(sum(model.weights.get(f, 0) for f in toxicity.features_of("aaland")) - sum(model.weights.get(f, 0) for f in toxicity.features_of("bbland"))) < 1


def test_kinds_are_found_in_frames(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        name = rng.choice(["aaland", "bbland"]) if toxic or rng.random() < 0.3 else "ccland"
        docs.append((i, f"w{rng.randint(0, 99)} those {name} people " + ("idiot" if toxic else "fine")))
        labels.append((i, 1, int(toxic)))
    model = toxicity.train(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert ("aaland", "bbland") in model.kinds


def test_repeats_clashes_and_odd_texts(spark):
    docs = [(i, "fine words here " + str(i)) for i in range(60)] + [(100 + i, "vile rude stuff " + str(i)) for i in range(60)]
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 1, 1) for i in range(60)] + [(100, 1, 0), (101, None, None), (None, 1, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    d = spark.createDataFrame(docs, DOCS)
    model = toxicity.train(d.union(d.where("doc_id < 5")), lab)
    odd = spark.createDataFrame([(None, None), (200, ""), (200, ""), (201, "vile " * 200000), (202, "### !!! \x85")], DOCS)
    got = toxicity.score_documents(d.union(odd), model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 125 and all(0 <= r.score <= 1 for r in got)
    assert all(by[i].predicted == 0 for i in range(60)) and all(by[100 + i].predicted == 1 for i in range(60))
    assert by[None].score == by[200].score and not by[None].held_out
    one = toxicity.train(d, lab.where("toxic = 0"))
    assert toxicity.score_documents(d, one).where("predicted = 1").count() == 0
