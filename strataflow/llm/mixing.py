"""Mixing sources to target weights: weighted sampling by exponential keys within token budgets."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.llm.sql import BLANK, words
from strataflow.session import cut, scratch_path

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: The mix holds this share of all words; a source gives at most ``EPOCHS`` times its own.
SHARE, EPOCHS = 1.5, 2
#: Quality weights are held between this and 1.
LEAST_WEIGHT = 2.0**-10
#: Rows of a range of keys, on average.
RANGE_ROWS = 5_000
SEED = "mix"
#: Random numbers are the first 48 bits of a digest.
BITS = 48


def quality_weight(text: Column) -> Column:
    """The share of letters among the signs of ``text`` that aren't blank; 1 for a text without any."""
    ink = F.length(F.regexp_replace(text, BLANK, ""))
    return F.when(ink > 0, F.length(F.regexp_replace(text, r"[^\p{L}]+", "")) / ink).otherwise(F.lit(1.0))


def uniform(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number between 0 and 1 that follows from the seed, the id and the text alone."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text))
    return (F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("double") + 0.5) / 2.0**BITS


def key_range(key: Column, n: Column | int) -> Column:
    """Which of ``n`` ranges of keys, in rising order, ``key`` is in.

    The ranges split the mean of the key's distributions at weights 1, 1/2, 1/4 and so on, so
    that whatever weights documents have, no range draws more than 22 times its share of them.
    """
    steps = 1 - int(math.log2(LEAST_WEIGHT))
    share = sum((F.lit(1.0) - F.exp(-key * 2.0**-k) for k in range(steps)), F.lit(0.0)) / steps
    return F.least(F.floor(share * n), F.lit(n) - 1).cast("long")


def numbered(frame: DataFrame, *order: str) -> DataFrame:
    """Adds ``place``, from 0 in the order of columns that tell all rows apart, by ranges on top of the rows of the ranges before."""
    part = cut(frame.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = part.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", (F.expr("sum(__n) over (order by __part)") - F.col("__n")).alias("__before"))
    own = F.expr(f"row_number() over (partition by __part order by {', '.join(order)})")
    return part.withColumn("__own", own).join(before, "__part").withColumn("place", F.col("__before") + F.col("__own") - 1).drop("__part", "__own", "__before")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Adds ``target`` to (no_source, source, source_size): the words that each source is to give.

    Sources take ``weights`` in turn, by code point, null last. ``share`` of all words is split
    by weight; what would go above ``epochs`` times a source's size is split anew among the
    others until none is above. Each round is one aggregate over the sources.
    """
    ranked = numbered(sources, "no_source", "source")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("place"), F.lit(len(weights))).cast("int"))
    ranked = cut(ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(epochs)).drop("place"))
    all_words = ranked.agg(F.sum("source_size").alias("n")).first().n or 0
    rate, held = None, None
    while True:
        full = F.lit(False) if rate is None else F.col("most") <= F.col("weight") * rate
        now = ranked.agg(F.count(F.when(full, 1)).alias("held"), F.sum(F.when(full, F.col("most"))).alias("given"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        if now.held == held or not now.weight:
            break
        held, rate = now.held, (share * all_words - (now.given or 0.0)) / now.weight
    return ranked.select("no_source", "source", "source_size", F.least(F.col("most"), F.col("weight") * F.lit(rate or 0.0)).alias("target"))


def mix(docs: DataFrame, weight: Column | None = None, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row: how many of its words the mix takes.

    A source gives as many whole epochs as its target holds; the rest of the target goes to
    the documents of the smallest keys (a unit exponential over the document's weight, by
    default ``quality_weight``), in a running sum of sizes. The document in which the sum
    reaches the target gives its first words only, so that a source meets its target to half
    a word and no document gives more than ``epochs`` times its size.

    Keys follow from seed, id and text, so that reruns and other partitionings agree. The sum
    runs within ranges of keys on top of the totals of the ranges before, so that a source
    may hold any share of the rows. Rows of one id, text and source can't be told apart and
    lie in one range. A null text has no words; null or repeated ids and null sources (a
    source of their own, last) are kept, other columns ignored, an empty table gives no rows.
    """
    spark = docs.sparkSession
    n = docs.count()
    ranges = max(1, n // range_rows)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # texts without words have nothing to take: they go to any range
    spread = (F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << BITS)) + 0.5) / 2.0**BITS
    drawn = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").isNull().alias("no_source"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.size(words(text)).cast("long").alias("size"),
        (quality_weight(text) if weight is None else weight).cast("double").alias("weight"),
        uniform(F.col("doc_id"), text, seed).alias("u"),
    )
    held = F.when(F.col("weight") > LEAST_WEIGHT, F.least(F.col("weight"), F.lit(1.0))).otherwise(LEAST_WEIGHT)
    held = F.when(F.isnan("weight"), LEAST_WEIGHT).otherwise(held)
    drawn = drawn.withColumn("key", -F.log(F.when(F.col("size") > 0, F.col("u")).otherwise(spread)) / held).drop("weight", "u")
    path = scratch_path(spark, "mixing-keys")
    drawn.withColumn("range", key_range(F.col("key"), ranges)).write.parquet(path)
    rows = spark.read.parquet(path)

    totals = rows.groupBy("no_source", "source", "range").agg(F.sum("size").alias("words"))
    goal = targets(totals.groupBy("no_source", "source").agg(F.sum("words").alias("source_size")), weights, share, epochs)
    before = F.expr("sum(words) over (partition by no_source, source order by range) - words")
    base = totals.withColumn("base", before).drop("words").join(goal, ["no_source", "source"])

    found = rows.join(base, ["no_source", "source", "range"])
    own = F.expr("base + sum(size) over (partition by no_source, source, range order by key, doc_id, size rows between unbounded preceding and current row) - size")
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(epochs), F.floor(F.col("target") / F.col("source_size")))).otherwise(0)
    rest = F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 0.5)
    part = F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("before")))
    found = found.withColumn("before", own).withColumn("whole", whole.cast("long"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + part).cast("long").alias("taken"))
