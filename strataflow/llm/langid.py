"""Language identification by mixtures of n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.llm.text import slices

#: Buckets of hashed letter trigrams.
BUCKETS = 1 << 13
#: Smoothing of bucket counts, and the penalty of a language in units of log(n)/2.
SMOOTHING, PENALTY = 0.5, 2.0
#: Expectation-maximisation ends where no proportion moves by more than this in a step, or after so many steps.
STILL, STEPS = 2e-3, 60
#: Texts of a matrix at most.
ROWS = 256
NONE = "und"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of each letter trigram of each text, and which texts have a letter.

    Letters are in lower case; anything else is a break. Each letter gives the trigram around
    it, with breaks on either side where it begins or ends a word.
    """
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    # a break before each text keeps neighbours apart
    joined = " ".join(["", *low.to_pylist(), ""])
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    size = pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    row = np.repeat(np.arange(len(texts)), size)
    letter = (code >= 97) & (code <= 122)
    high = np.flatnonzero(code >= 128)
    if len(high):
        distinct, back = np.unique(code[high], return_inverse=True)
        letter[high] = np.array([chr(c).isalpha() for c in distinct.tolist()], bool)[back]
    c = np.where(letter, code, 32).astype(np.uint32)
    # the trigram around each letter, the text's own breaks included
    mid = np.flatnonzero(letter)
    h = (c[mid - 1] * np.uint32(0x9E3779B1)) ^ (c[mid] * np.uint32(0x85EBCA77)) ^ (c[mid + 1] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    bucket = (h >> np.uint32(32 - 13)).astype(np.int64)
    own = row[mid - 1]
    has = np.zeros(len(texts), bool)
    has[own] = True
    return own, bucket, has


@dataclass(frozen=True)
class Model:
    """Log likelihood of each bucket by language."""

    languages: tuple[str, ...]
    log_p: np.ndarray  # languages x BUCKETS


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in slices(batch):
            row, bucket, _ = grams(part.column("text"))
            langs = part.column("lang").dictionary_encode()
            codes = langs.indices.to_numpy()[row]
            names = langs.dictionary.to_pylist()
            counts = np.bincount(codes * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
            for name, c in zip(names, counts, strict=True):
                total[name] = total.get(name, 0) + c
    for name, c in total.items():
        b = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(b), pa.string()), pa.array(b, pa.int32()), pa.array(c[b], pa.int64())], names=["lang", "bucket", "n"])


def train(docs: DataFrame, smoothing: float = SMOOTHING) -> Model:
    """Bucket counts by language over all documents with a language whose id isn't held out.

    Each task adds up its own texts; the driver gets a count for each language and bucket.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counted = known.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counted.toPandas()
    languages = tuple(sorted(got["lang"].unique()))
    counts = np.full((len(languages), BUCKETS), smoothing)
    if len(got):
        place = {x: i for i, x in enumerate(languages)}
        np.add.at(counts, (got["lang"].map(place).to_numpy(), got["bucket"].to_numpy()), got["n"].to_numpy())
    return Model(languages, np.log(counts / counts.sum(axis=1, keepdims=True)))


def mixtures(row: np.ndarray, bucket: np.ndarray, n: int, model: Model, steps: int = STEPS, penalty: float = PENALTY) -> np.ndarray:
    """Language proportions of ``n`` texts (n x languages); a text without n-grams has none.

    All languages start in each text's set. Expectation-maximisation fits the proportions;
    then the smallest language leaves and the fit is repeated, down to a single language. Of
    these sets the one with the highest log likelihood less ``penalty`` * log(n-grams) / 2
    per language is the answer. A fit ends where no proportion of the text moves by more than
    STILL, or after ``steps``.
    """
    size = len(model.languages)
    out = np.zeros((n, size))
    if not size or not len(row):
        return out
    key, count = np.unique(row * BUCKETS + bucket, return_counts=True)
    r, b = key // BUCKETS, key % BUCKETS
    p = np.exp(model.log_p[:, b])  # languages x entries
    grams_of = np.bincount(r, weights=count, minlength=n)
    fee = penalty * np.log(np.maximum(grams_of, 2)) / 2
    starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    there = r[starts]
    alive = np.ones((n, size), bool)
    best = np.full(n, -np.inf)
    pi = np.full((n, size), 1.0 / size)
    for k in range(size, 0, -1):
        moving, own, at = there, slice(None), starts
        for _ in range(steps if k > 1 else 1):
            chances = p[:, own]
            ratio = count[own] / (np.einsum("le,le->e", chances, pi.T[:, r[own]]) + 1e-300)
            now = pi[moving] * np.stack([np.add.reduceat(chances[i] * ratio, at) for i in range(size)], axis=1)
            now /= np.maximum(now.sum(axis=1, keepdims=True), 1e-300)
            still = np.abs(now - pi[moving]).max(axis=1) <= STILL
            pi[moving] = now
            if still.all():
                break
            if still.any():
                # a text that has come to rest is left alone, so that its neighbours don't matter
                moving = moving[~still]
                inside = np.zeros(n, bool)
                inside[moving] = True
                own = np.flatnonzero(inside[r])
                at = np.flatnonzero(np.r_[True, r[own][1:] != r[own][:-1]])
        mix = np.einsum("le,le->e", p, pi.T[:, r]) + 1e-300
        fit = np.full(n, -np.inf)
        fit[there] = np.add.reduceat(count * np.log(mix), starts) - fee[there] * k
        better = fit > best
        best[better] = fit[better]
        out[better] = pi[better]
        if k > 1:
            least = np.where(alive, pi, np.inf).argmin(axis=1)
            alive[np.arange(n), least] = False
            pi = np.where(alive, np.maximum(pi, 1e-6), 0.0)
            pi /= pi.sum(axis=1, keepdims=True)
    return out


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    names = np.array([*model.languages, NONE], dtype=object)
    for batch in batches:
        for wide in slices(batch):
            for a in range(0, wide.num_rows, ROWS):
                part = wide.slice(a, ROWS)
                row, bucket, has = grams(part.column("text"))
                pi = mixtures(row, bucket, part.num_rows, model)
                known = has & (len(model.languages) > 0)
                best = np.where(known, pi.argmax(axis=1) if len(model.languages) else 0, len(model.languages))
                score = np.where(known, pi.max(axis=1) if len(model.languages) else 0.0, 0.0)
                mixed = [[names[i] for i in np.flatnonzero(x > 0)] for x in pi]
                shares = [x[x > 0].tolist() for x in pi]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(names[best].tolist(), pa.string()), pa.array(np.clip(score, 0.0, 1.0)), pa.array(mixed, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                    names=["doc_id", "lang_pred", "score", "languages", "proportions"],
                )


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages and proportions of every row.

    lang_pred is the language with the largest proportion, and score that proportion; a null
    text, or one without letters, has ``und`` and 0. Among languages with equal shares the first by name leaves first.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = src.mapInArrow(lambda it: _predict(it, model), "doc_id long, lang_pred string, score double, languages array<string>, proportions array<double>")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages", "proportions")
