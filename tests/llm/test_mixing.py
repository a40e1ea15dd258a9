"""Mixing against brute force: targets, epochs, running sums, odd rows."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strataflow.llm import mixing
from strataflow.session import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BLANKS = " \t\n\x0b\x0c\r"


def words(text):
    for b in BLANKS:
        text = (text or "").replace(b, " ")
    return [w for w in text.split(" ") if w]


def brute_targets(sizes, share=1.5, epochs=2, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, target, free = share * sum(sizes.values()), {}, set(order)
    while free:
        rate = left / sum(weight[s] for s in free)
        full = {s for s in free if epochs * sizes[s] <= rate * weight[s]}
        if not full:
            return target | {s: rate * weight[s] for s in free}
        for s in full:
            target[s] = float(epochs * sizes[s])
            left -= target[s]
        free -= full
    return target


def brute(rows, **k):
    sizes, by = Counter(), defaultdict(list)
    for i, text, source in rows:
        n, text = len(words(text)), text or ""
        ink = [c for c in text if c not in BLANKS]
        w = min(1.0, max(2.0**-10, sum(c.isalpha() for c in ink) / len(ink) if ink else 1.0))
        u = (int(hashlib.md5(f"mix:{'' if i is None else i}:{text}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        sizes[source] += n
        by[source].append((-math.log(u) / w, i is not None, i or 0, n))
    target = brute_targets(sizes, **k)
    out = []
    for s, docs in by.items():
        whole = min(2, math.floor(target[s] / sizes[s])) if sizes[s] else 0
        rest, before = math.floor(target[s] - whole * sizes[s] + 0.5), 0
        for _, there, i, n in sorted(docs):
            out.append((i if there else None, n, sizes[s], round(target[s], 6), whole * n + min(n, max(0, rest - before))))
            before += n
    return Counter(out)


def of(frame):
    return Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in frame.collect())


def test_query_equals_brute_force(spark, sf_dir):
    from strataflow.llm.queries import QUERIES

    docs = table(spark, sf_dir, "documents")
    got = QUERIES["op12_exponential_mixing"](spark, sf_dir)
    assert got.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")]
    assert of(got) == brute([(r.doc_id, r.text, r.source) for r in docs.collect()])


def odd_rows():
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["ab", "12", "é#", "x", "Wort\x0bzwei", "…"]) for _ in range(n))
    rows = [(i, text(rng.randint(0, 40)), rng.choice(["a", "b", "Z", "é", "𝄞", "", None])) for i in range(300)]
    rows += [(1000 + i, text(20), "hot") for i in range(300)]
    rows += [(None, None, None), (None, None, None), (None, "", "a"), (None, "one two", "b"), (5, "twice twice", "b"), (5, "twice twice", "b"), (7, None, "blank"), (8, " \t", "blank"), (9, "w " * 50000, "long"), (10, "\x85\xa0 y", "long")]
    return rows


def test_odd_rows_in_any_partitioning(spark):
    rows = odd_rows()
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS).withColumn("target", F.lit("clash")).withColumn("range", F.lit(1)).withColumn("key", F.lit("x"))
    want = brute(rows)
    assert of(mixing.mix(docs, range_rows=20)) == want
    assert of(mixing.mix(docs.repartition(9))) == want


def test_sources_meet_their_targets(spark):
    rows = odd_rows()
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS)
    got = mixing.mix(docs, range_rows=30).collect()
    by = defaultdict(int)
    for r in got:
        by[r.source_size, r.target] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    assert all(abs(n - target) <= 0.5 for (_, target), n in by.items()) and len(by) > 5
    assert abs(sum(by.values()) - 1.5 * sum(r.size for r in got)) <= len(by)


def test_weights_act(spark):
    """A document of three times the weight is drawn more often, by the ratio that exponential keys give."""
    rows = [(i, "a b c d e f g h i j", "en", "s", 0) for i in range(4000)]
    docs = spark.createDataFrame(rows, DOCS)
    weight = F.when(F.col("doc_id") % 2 == 0, 0.75).otherwise(0.25)
    got = mixing.mix(docs, weight, share=0.2, range_rows=100).collect()
    heavy, light = (sum(r.taken for r in got if r.doc_id % 2 == k) for k in (0, 1))
    # P(key < t) is 1 - exp(-w t); t makes both add up to 0.2 of the rows
    t = min((abs(2 - math.exp(-0.75 * x) - math.exp(-0.25 * x) - 0.4), x) for x in (k / 1000 for k in range(1, 3000)))[1]
    assert heavy / light == pytest.approx((1 - math.exp(-0.75 * t)) / (1 - math.exp(-0.25 * t)), rel=0.1)


def test_ranges_are_ordered_and_bounded(spark):
    for w in (1.0, 0.3, 2.0**-10):
        keys = spark.range(20000).select((-F.log((F.col("id") + 0.5) / 20000) / w).alias("key"))
        got = keys.select("key", mixing.key_range(F.col("key"), 200).alias("range")).groupBy("range").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy("range").collect()
        assert all(a.high < b.low for a, b in zip(got, got[1:], strict=False)) and 0 <= got[0].range and got[-1].range < 200
        assert max(r.n for r in got) <= 22 * 100


def test_targets_with_capped_sources(spark):
    sizes = {"a": 10, "b": 1000, "c": 3, "d": 0, None: 500}
    frame = spark.createDataFrame([(s is None, s or "", n) for s, n in sizes.items()], "no_source boolean, source string, source_size long")
    got = {None if r.no_source else r.source: r.target for r in mixing.targets(frame).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_numbered(spark):
    frame = spark.createDataFrame([(k % 3 == 0, f"s{k * 7919 % 1000:03}") for k in range(500)], "no_source boolean, source string")
    got = sorted(mixing.numbered(frame, "no_source", "source").collect(), key=lambda r: r.place)
    assert [r.place for r in got] == list(range(500)) and [(r.no_source, r.source) for r in got] == sorted((r.no_source, r.source) for r in got)


def test_empty_table_and_no_words(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    assert of(mixing.mix(spark.createDataFrame([(1, None, "en", "s", 0), (2, " ", "en", None, 0)], DOCS))) == Counter({(1, 0, 0, 0.0, 0): 1, (2, 0, 0, 0.0, 0): 1})
