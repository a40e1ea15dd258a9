"""Bootstrap statistics from weight tables.

A weight table says how often each unit (well or block) is drawn in each repetition. It
comes from Spark's own hash, so that a repetition is the same wherever it runs, and the
statistics are ordinary weighted aggregations by repetition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) that depends on ``keys`` alone."""
    return (F.pmod(F.xxhash64(*keys), F.lit(1 << 40)).cast("double")) / F.lit(float(1 << 40))


def _poisson_bounds(most: int = 8) -> np.ndarray:
    """The ends of the uniform numbers that stand for 0, 1, ... and ``most`` - 1."""
    out, total = [], 0.0
    for k in range(most):
        total += math.exp(-1) / math.factorial(k)
        out.append(total)
    return np.array(out)


def poisson_weight(u: Column, most: int = 8) -> Column:
    """A Poisson(1) count from a uniform number, cut at ``most``: the large-sample form of drawing with replacement."""
    out = F.lit(most)
    for k, t in reversed(list(enumerate(_poisson_bounds(most).tolist()))):
        out = F.when(u < t, F.lit(k)).otherwise(out)
    return out


def weights(units: DataFrame, unit: str, repetitions: int, seed: int = 0) -> DataFrame:
    """(rep, unit, w) with w > 0 for each repetition."""
    reps = units.select(unit).distinct().select(unit, F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))).alias("rep"))
    return reps.withColumn("w", poisson_weight(uniform(F.col(unit), F.col("rep"), F.lit(seed))).cast("double")).where("w > 0")


def fixed_weights(units: DataFrame, repetitions: int) -> DataFrame:
    """(code, rep, c): weights that any engine can compute, (code * 31 + rep * 17 + code * rep) mod 4."""
    reps = units.select("code", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))).alias("rep"))
    return reps.withColumn("c", ((F.col("code") * 31 + F.col("rep") * 17 + F.col("code") * F.col("rep")) % 4).cast("double"))


class Draw(Protocol):
    """How often a unit is drawn in a repetition, as a column and, from the unit's key, in numpy; both give the same numbers."""

    def column(self, rep: Column, *unit: Column) -> Column: ...

    def key(self, *unit: Column) -> Column: ...

    def of(self, keys: np.ndarray, reps: np.ndarray) -> np.ndarray: ...


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _hash_int(value: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of an int from 0 on top of the hash ``h`` of the keys before it."""
    h = (h + _P5 + np.uint64(4)) ^ (value.astype(np.uint64) * _P1)
    return _mixed(((h << np.uint64(23)) | (h >> np.uint64(41))) * _P2 + _P3)


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    h ^= h >> np.uint64(32)
    return h


def poisson_counts(repetitions: int, seed: int, *keys: np.ndarray) -> np.ndarray:
    """(units, repetitions): Poisson counts that follow from the units' long ``keys``, the repetition and ``seed``; a hash gives two repetitions 32 bits each."""
    h = np.full(len(keys[0]), seed, np.uint64)
    for k in keys:
        h = _mixed((h + _P5) ^ (k.astype(np.int64).view(np.uint64) * _P1))
    h = _mixed(h[:, None] + np.arange(1, (repetitions + 1) // 2 + 1, dtype=np.uint64) * _P1)
    u = h.view(np.uint32)[:, :repetitions]
    out = np.zeros(u.shape, np.uint8)
    for bound in _poisson_bounds():
        out += u >= np.uint32(min(math.ceil(bound * (1 << 32)), (1 << 32) - 1))
    return out.astype(np.float64)


@dataclass(frozen=True)
class PoissonDraw:
    """Poisson counts that follow from a hash of unit, repetition and seed."""

    seed: int

    def column(self, rep: Column, *unit: Column) -> Column:
        return poisson_weight(uniform(*unit, rep, F.lit(self.seed))).cast("double")

    def key(self, *unit: Column) -> Column:
        return F.xxhash64(*unit)

    def of(self, keys: np.ndarray, reps: np.ndarray) -> np.ndarray:
        h = _hash_int(np.array([self.seed]), _hash_int(reps[None, :], keys.astype(np.int64).view(np.uint64)[:, None]))
        u = (h & np.uint64((1 << 40) - 1)).astype(np.float64) / float(1 << 40)
        return np.searchsorted(_poisson_bounds(), u, side="right").astype(np.float64)


@dataclass(frozen=True)
class GivenDraw:
    """Counts that any engine can compute: (code * 31 + rep * 17 + code * rep) mod 4."""

    def column(self, rep: Column, *unit: Column) -> Column:
        (code,) = unit
        return ((code * 31 + rep * 17 + code * rep) % 4).cast("double")

    def key(self, *unit: Column) -> Column:
        return unit[0].cast("long")

    def of(self, keys: np.ndarray, reps: np.ndarray) -> np.ndarray:
        code, rep = keys.astype(np.int64)[:, None], reps.astype(np.int64)[None, :]
        return np.fmod(code * 31 + rep * 17 + code * rep, 4).astype(np.float64)


@dataclass(frozen=True)
class OnceAlso:
    """``draw``, and in repetition ``point`` every unit once."""

    draw: Draw
    point: int

    def column(self, rep: Column, *unit: Column) -> Column:
        return F.when(rep == self.point, 1.0).otherwise(self.draw.column(rep, *unit))

    def key(self, *unit: Column) -> Column:
        return self.draw.key(*unit)

    def of(self, keys: np.ndarray, reps: np.ndarray) -> np.ndarray:
        out = np.ones((len(keys), len(reps)))
        drawn = reps != self.point
        out[:, drawn] = self.draw.of(keys, reps[drawn])
        return out


#: Weights that a task of auc_by_repetition holds at a time.
HELD_WEIGHTS = 1 << 20


def _mann_whitney(batches: Iterator[pd.DataFrame], draw: Draw, reps: np.ndarray, others: list[str], held: int) -> Iterator[pd.DataFrame]:
    """(what, low, rep, pos, neg, inner) of rows in the order of what and s: for each repetition the weights of both labels and the sum over positives of the negatives below, ties half."""
    zero = lambda: np.zeros(len(reps))
    what, low, tie, pos, neg, inner, tie_pos, tie_neg = None, None, None, zero(), zero(), zero(), zero(), zero()

    def whole() -> pd.DataFrame:
        return pd.DataFrame({"what": what, "low": low, "rep": reps, "pos": pos + tie_pos, "neg": neg + tie_neg, "inner": inner + tie_pos * (neg + tie_neg / 2)})

    step = max(1, held // len(reps))
    for pdf in batches:
        names = pdf["what"].to_numpy()
        ends = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(pdf)]
        spans = [(i, min(i + step, b)) for a, b in zip(ends, ends[1:], strict=False) for i in range(a, b, step)]
        for a, b in spans:
            if names[a] != what:
                if what is not None:
                    yield whole()
                what, low, tie, pos, neg, inner, tie_pos, tie_neg = names[a], pdf["s"].iloc[a], None, zero(), zero(), zero(), zero(), zero()
            s, y = pdf["s"].to_numpy()[a:b], pdf["y"].to_numpy()[a:b, None]
            w = draw.of(pdf["k"].to_numpy()[a:b], reps)
            for k in others:
                w *= draw.of(pdf[k].to_numpy()[a:b], reps) > 0
            starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            p, n = np.add.reduceat(w * y, starts, axis=0), np.add.reduceat(w * (1 - y), starts, axis=0)
            if s[0] == tie:
                p[0] += tie_pos
                n[0] += tie_neg
            else:
                inner += tie_pos * (neg + tie_neg / 2)
                pos += tie_pos
                neg += tie_neg
            below = neg + np.cumsum(n, axis=0) - n
            inner += (p[:-1] * (below[:-1] + n[:-1] / 2)).sum(axis=0)
            pos += p[:-1].sum(axis=0)
            neg += n[:-1].sum(axis=0)
            tie, tie_pos, tie_neg = s[-1], p[-1], n[-1]
    if what is not None:
        yield whole()


def auc_by_repetition(rows: DataFrame, label: str, score: str, unit: str, draw: Draw, repetitions: int | list[int], also: tuple[str, ...] = (), what: str | None = None) -> DataFrame:
    """(what, rep, auc): Mann-Whitney AUC in each repetition, ties half; a row counts as often as its ``unit`` is drawn, and only if the units ``also`` are.

    Rows are sorted by score once, in ranges, and weights follow from the keys: a task goes
    along its range with all repetitions at a time and gives a row for each, so that rows
    and repetitions never multiply in a shuffle. Null where a label has no weight.
    """
    held, reps = HELD_WEIGHTS, np.arange(repetitions) if isinstance(repetitions, int) else np.array(repetitions)
    others = [f"k{i}" for i in range(len(also))]
    keys = [draw.key(F.col(unit)).alias("k"), *[draw.key(F.col(c)).alias(k) for c, k in zip(also, others, strict=True)]]
    have = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    have = have.select((F.col(what) if what else F.lit("")).cast("string").alias("what"), F.col(score).cast("double").alias("s"), (F.col(label) == 1).cast("double").alias("y"), *keys)
    placed = have.repartitionByRange("what", "s").sortWithinPartitions("what", "s")
    parts = placed.mapInPandas(lambda it: _mann_whitney(it, draw, reps, others, held), "what string, low double, rep int, pos double, neg double, inner double")
    below = F.expr("sum(neg) over (partition by what, rep order by low rows between unbounded preceding and current row) - neg")
    both = F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))
    return parts.withColumn("below", below).groupBy("what", "rep").agg((F.sum(F.col("inner") + F.col("pos") * F.col("below")) / both).alias("auc"))


#: Rows among which the last ones of an exact sample are ranked.
RANKED_ROWS = 50_000


def exact_sample(frame: DataFrame, n: int, keys: list[str], seed: int = 0, number: Column | None = None) -> DataFrame:
    """Exactly ``n`` rows of ``frame`` (all if it has fewer), the same wherever its rows lie: those of the smallest hashes of ``keys`` and ``seed``, or
    of the smallest ``number`` (from 0 to below 2^63).

    Counts by range of hashes find the range in which the n-th smallest lies, finer and
    finer until it holds few rows; only that range is ranked. ``keys`` tell the rows apart;
    rows that don't differ in them are ordered among themselves by chance.
    """
    if n <= 0:
        return frame.where("false")
    if (inside := frame.count()) <= n:
        return frame
    keyed = frame.withColumn("__h", F.shiftrightunsigned(F.xxhash64(*keys, F.lit(seed)), 1) if number is None else number)
    lead = lambda bits: F.shiftright("__h", 63 - bits)
    bits, at, before = 0, 0, 0
    while inside > RANKED_ROWS and bits < 60:
        own = keyed.where(lead(bits) == at).groupBy(lead(bits + 12).alias("k")).agg(F.count("*").alias("rows"))
        for k, rows in sorted((r.k, r.rows) for r in own.collect()):  # 4,096 at most
            if before + rows >= n:
                bits, at, inside = bits + 12, k, rows
                break
            before += rows
    last = keyed.where(lead(bits) == at).orderBy("__h", *keys).limit(n - before)
    return keyed.where(lead(bits) < at).unionByName(last).drop("__h")


def interval(frame: DataFrame, value: str, keys: tuple[str, ...] = (), least_valid: int = 10) -> DataFrame:
    """n_valid, 2.5 % and 97.5 % points of ``value`` over repetitions; null with fewer than ``least_valid`` valid ones."""
    valid = frame.where(F.col(value).isNotNull() & ~F.isnan(value))
    q = lambda p: F.when(F.count("*") >= least_valid, F.expr(f"percentile({value}, {p}D)"))
    return valid.groupBy(*keys).agg(F.count("*").alias("n_valid"), q(0.025).alias("low"), q(0.975).alias("high"))
