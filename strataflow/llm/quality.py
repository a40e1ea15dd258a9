"""Quality scores by Bradley-Terry pairwise ranking over learned features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.llm.optimise import conjugate
from strataflow.llm.text import slices, words_of
from strataflow.session import cut

#: Labelled rows that the ranking is fitted on, at most; the first by a hash of doc_id.
TRAIN_ROWS = 20_000
#: Preference pairs drawn for each row of the rarer label.
PAIRS_PER_ROW = 20
#: Slots of hashed n-grams, as a power of two; and the evidence that a slot needs to be a feature: documents, and standard errors of its log odds.
SLOT_BITS, MIN_DOCS, MIN_Z = 10, 5, 3.0
#: Weight of the ridge beside the mean loss of a pair.
RIDGE = 1e-3
#: Scores from this on are predicted as label 1.
CUT = 0.7
#: Texts of a matrix, signs that are hashed at once, and bytes of text of a slice, at most (a longer text stands alone).
ROWS, CHUNK, SLICE_BYTES = 256, 1 << 18, 1 << 21

#: What a text's n-grams don't tell: its size and how much of it repeats.
SHAPE = ("log_words", "word_length", "distinct_words", "distinct_windows", "distinct_lines")


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(32 - SLOT_BITS)


def kinds_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The kinds of all signs of the texts, with a blank before each text and behind the last, and where each text begins.

    A letter stands for its case only and a digit for any digit, so that n-grams tell how a
    text is written and not what it is about.
    """
    texts = pc.fill_null(texts, "")
    kind = np.frombuffer(" ".join(["", *texts.to_pylist(), ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4").copy()
    begin = np.r_[0, np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)] + 1
    kind[(kind >= 97) & (kind <= 122)] = 97
    kind[(kind >= 65) & (kind <= 90)] = 65
    kind[(kind >= 48) & (kind <= 57)] = 48
    high = np.flatnonzero(kind >= 128)
    if len(high):
        distinct, back = np.unique(kind[high], return_inverse=True)
        kind[high] = np.array([97 if c.islower() else 65 if c.isupper() else 97 if c.isalpha() else 48 if c.isdigit() else ord(c) for c in map(chr, distinct.tolist())], dtype=np.uint32)[back]
    return kind, begin


def grams(kind: np.ndarray) -> np.ndarray:
    """Signs x 3: the slots of the one, two and three signs around each sign but the first and the last."""
    a, b, d = kind[:-2] * np.uint32(0x9E3779B1), kind[1:-1] * np.uint32(0x85EBCA77), kind[2:] * np.uint32(0xC2B2AE3D)
    return np.stack([_mix(b + np.uint32(1)), _mix((a ^ b) + np.uint32(2)), _mix((a ^ b ^ d) + np.uint32(3))], axis=1)


def slot_counts(texts: pa.Array) -> np.ndarray:
    """Texts x slots: how often each slot occurs. Texts of any length are taken CHUNK signs at a time."""
    kind, begin = kinds_of(texts)
    width, n = 1 << SLOT_BITS, len(texts)
    total = np.zeros((n + 1, width), np.int64)
    for a in range(1, len(kind) - 1, CHUNK):
        b = min(a + CHUNK, len(kind) - 1)
        first, last = np.searchsorted(begin, [a, b - 1], side="right") - 1
        # the texts of this chunk and its signs of each; a text's own blank in front goes to the row behind the last text
        edges = np.clip(begin[first : last + 2], a, b)
        row = np.repeat(np.arange(last - first + 1), np.diff(edges))
        slot = grams(kind[a - 1 : b + 1])
        blank = begin[first + 1 : last + 2] - 1 - a
        row[blank[(blank >= 0) & (blank < b - a)]] = last - first + 1
        counts = np.bincount((row[:, None] * width + slot).ravel(), minlength=(last - first + 2) * width).reshape(-1, width)
        total[first : last + 1] += counts[: last - first + 1]
    return total[:n]


def shapes(texts: pa.Array) -> np.ndarray:
    """Texts x SHAPE. Texts without words have no repeats."""
    n = len(texts)
    rows, codes, distinct = words_of(texts)
    words = np.bincount(rows, minlength=n).astype(float)
    chars = np.bincount(rows, weights=pc.utf8_length(distinct).to_numpy(zero_copy_only=False)[codes] if len(codes) else None, minlength=n)
    unique = lambda r, key: np.bincount(_firsts(r, key), minlength=n).astype(float)
    same = rows[:-2] == rows[2:] if len(rows) > 2 else np.zeros(0, bool)
    c = codes.astype(np.uint64)
    triple = (c[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x165667B19E3779F9) ^ c[2:] if len(c) > 2 else np.zeros(0, np.uint64)
    windows = np.maximum(words - 2, 0)
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    line_rows, lines = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists).dictionary_encode()
    full = (pc.binary_length(lines.dictionary).to_numpy(zero_copy_only=False) > 0)[lines.indices.to_numpy()]
    line_rows, line_codes = line_rows[full], lines.indices.to_numpy()[full].astype(np.uint64)
    n_lines = np.bincount(line_rows, minlength=n).astype(float)
    share = lambda part, whole: np.where(whole > 0, part / np.maximum(whole, 1), 1.0)
    return np.stack(
        [
            np.log1p(words),
            np.minimum(chars / np.maximum(words, 1), 30.0),
            np.sqrt(share(unique(rows, c), words)),
            share(unique(rows[:-2][same], triple[same]), windows),
            share(unique(line_rows, line_codes), n_lines),
        ],
        axis=1,
    )


def _firsts(rows: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The rows of the distinct (row, key)."""
    order = np.lexsort((key, rows))
    r, k = rows[order], key[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    return r[new]


def features_of(texts: pa.Array, slots: np.ndarray) -> np.ndarray:
    """Texts x (SHAPE, then each of ``slots``): the logarithm of a slot's hits in a thousand n-grams."""
    out = []
    for a in range(0, max(len(texts), 1), ROWS):
        part = texts.slice(a, ROWS)
        counts = slot_counts(part)
        out.append(np.concatenate([shapes(part), np.log1p(1000 * counts[:, slots] / np.maximum(counts.sum(axis=1), 1)[:, None])], axis=1))
    return np.concatenate(out)


@dataclass(frozen=True)
class Ranking:
    """A linear score of the features, centred and scaled so that CUT is the chosen quantile."""

    slots: tuple[int, ...]
    weights: tuple[float, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    cut: float
    spread: float
    quantile: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores of features (rows x features), from 0 to 1."""
        total = ((x - np.array(self.means)) / np.array(self.scales)) @ np.array(self.weights)
        odds = np.log(CUT / (1 - CUT)) + (total - self.cut) / self.spread
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def draw_pairs(y: np.ndarray, pairs_per_row: int = PAIRS_PER_ROW, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Preference pairs (a row of label 1, a row of label 0), so many for each row of the rarer label."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng = np.random.default_rng(seed)
    n = min(len(good), len(bad)) * pairs_per_row
    return rng.choice(good, n), rng.choice(bad, n)


def pair_loss(w: np.ndarray, z: np.ndarray, better: np.ndarray, worse: np.ndarray, ridge: float = RIDGE) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean logistic loss of score differences with the ridge, its gradient, and each pair's curvature."""
    s = z @ w
    gap = s[better] - s[worse]
    p = 1 / (1 + np.exp(-np.clip(gap, -30, 30)))
    pull = np.bincount(better, p - 1, minlength=len(z)) - np.bincount(worse, p - 1, minlength=len(z))
    return float(np.logaddexp(0, -gap).mean() + 0.5 * ridge * w @ w), z.T @ pull / len(gap) + ridge * w, p * (1 - p) / len(gap)


def fit_pairs(x: np.ndarray, y: np.ndarray, slots: tuple[int, ...] = (), pairs_per_row: int = PAIRS_PER_ROW, ridge: float = RIDGE, seed: int = 0) -> Ranking:
    """Bradley-Terry weights from pairs (a row of label 1, a row of label 0).

    The chance that the first is preferred is the logistic of the difference of scores, so
    the loss is logistic on feature differences; Newton steps minimise it, without a row for
    each pair. The threshold is the quantile of all training scores that gives the fewest
    wrong labels. With one label only, all scores are equal, on that label's side of the cut.
    """
    d = x.shape[1]
    means, scales = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(d), np.ones(d))
    better, worse = draw_pairs(y, pairs_per_row, seed)
    if not len(better):
        side = -1.0 if (y == 0).any() else 1.0
        return Ranking(slots, (0.0,) * d, tuple(means.tolist()), tuple(scales.tolist()), -side, 1.0, 0.0)
    z = (x - means) / scales
    w = np.zeros(d)
    loss, slope, bend = pair_loss(w, z, better, worse, ridge)
    for _ in range(40):

        def times(v: np.ndarray, bend: np.ndarray = bend) -> np.ndarray:
            s = z @ v
            u = bend * (s[better] - s[worse])
            return z.T @ (np.bincount(better, u, minlength=len(z)) - np.bincount(worse, u, minlength=len(z))) + ridge * v

        step = conjugate(times, slope, np.ones(d), near=min(0.1, np.sqrt(np.sqrt(slope @ slope))))
        size = 1.0
        while True:  # halve until the loss falls
            new = pair_loss(w - size * step, z, better, worse, ridge)
            if new[0] <= loss - 1e-4 * size * slope @ step or size < 1e-6:
                break
            size /= 2
        w = w - size * step
        done = loss - new[0] < 1e-9
        loss, slope, bend = new
        if done:
            break
    s = z @ w
    order = np.argsort(s, kind="stable")
    # wrong labels if the k lowest scores are rejected
    wrong = np.r_[(y == 0).sum(), (y == 0).sum() + np.cumsum(np.where(y[order] == 1, 1, -1))]
    k = int(np.argmin(wrong))
    low, high = s[order[max(k - 1, 0)]], s[order[min(k, len(s) - 1)]]
    return Ranking(slots, tuple(w.tolist()), tuple(means.tolist()), tuple(scales.tolist()), float((low + high) / 2), float(s.std() / 4 + 1e-9), k / len(s))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _slot_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, 1 << SLOT_BITS), np.int64)
    for batch in batches:
        for wide in slices(batch, most=SLICE_BYTES):
            for a in range(0, wide.num_rows, ROWS):
                part = wide.slice(a, ROWS)
                has = slot_counts(part.column("text")) > 0
                y = part.column("quality").to_numpy()
                for label in (0, 1):
                    total[label] += has[y == label].sum(axis=0)
    used = np.flatnonzero(total.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[1, used]), pa.array(total[0, used])], names=["slot", "docs_1", "docs_0"])


def _features(batches: Iterator[pa.RecordBatch], slots: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, most=SLICE_BYTES):
            x = features_of(part.column("text"), slots).astype(np.float32)
            wide = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([part.column("h"), part.column("quality"), wide], names=["h", "quality", "x"])


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Ranking:
    """Fit on the distinct texts of at most ``train_rows`` labelled documents whose id isn't held out.

    Copies have one voice; copies whose labels differ count as the worse one. The chosen
    labels (a bounded number) are broadcast. Slots are counted by label on the cluster; the
    driver gets the features of the chosen rows, of the slots that tell the labels apart.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    labelled = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id").select("quality", "text")
    rows = cut(labelled.groupBy(F.xxhash64("text").alias("h")).agg(F.min("quality").alias("quality"), F.first("text").alias("text")))
    n1, n0 = (float(v) for v in rows.agg(F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0)).first())
    counted = rows.select("quality", "text").mapInArrow(_slot_docs, "slot int, docs_1 long, docs_0 long").groupBy("slot").agg(F.sum("docs_1").alias("a"), F.sum("docs_0").alias("b")).toArrow()
    a, b = counted.column("a").to_numpy(), counted.column("b").to_numpy()
    log_odds = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5))
    error = np.sqrt(1 / (a + 0.5) + 1 / (n1 - a + 0.5) + 1 / (b + 0.5) + 1 / (n0 - b + 0.5))
    slots = np.sort(counted.column("slot").to_numpy()[(a + b >= MIN_DOCS) & (np.abs(log_odds / error) >= MIN_Z)]).astype(np.int64)
    got = rows.mapInArrow(lambda it: _features(it, slots), "h long, quality int, x array<float>").orderBy("h").toArrow().combine_chunks()
    x = pc.list_flatten(got.column("x")).to_numpy().reshape(got.num_rows, -1) if got.num_rows else np.zeros((0, len(SHAPE) + len(slots)), np.float32)
    return fit_pairs(x, got.column("quality").to_numpy(), tuple(slots.tolist()))


def _score(batches: Iterator[pa.RecordBatch], ranking: Ranking, keep: bool) -> Iterator[pa.RecordBatch]:
    slots = np.array(ranking.slots, dtype=np.int64)
    for batch in batches:
        for part in slices(batch, most=SLICE_BYTES):
            score = ranking.score(features_of(part.column("text"), slots))
            if keep:
                yield part.filter(pa.array(score >= CUT))
            else:
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], names=["doc_id", "score"])


def score_documents(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, repeated rows as often as they occur; a null text is empty."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = src.mapInArrow(lambda it: _score(it, ranking, False), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """The rows of ``docs`` that are predicted as label 1, with their columns as they are."""
    return docs.mapInArrow(lambda it: _score(it, ranking, True), docs.schema)
