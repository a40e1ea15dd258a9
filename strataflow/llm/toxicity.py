"""Toxicity scores from a counterfactually regularised linear classifier."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.llm.optimise import conjugate
from strataflow.llm.text import slices, words_of
from strataflow.session import cut

#: Labelled rows that the classifier is fitted on, at most; the first by a hash of doc_id.
TRAIN_ROWS = 20_000
#: Evidence that a word or word beginning needs to be a feature: documents, and standard errors of its log odds.
MIN_DOCS, MIN_Z = 5, 3.0
#: A word is taken for an identity term if it occurs in so many documents of either label and leans to the toxic ones.
TERM_DOCS, TERM_Z = 5, 1.0
#: Weights of the mean squared score change under swaps, and of the ridge, beside the mean loss of a row.
COUNTERFACTUAL, RIDGE = 1.0, 0.0003
#: Letters of word beginnings; a beginning is written with TAIL behind it.
BEGINNINGS, TAIL = (3, 4, 5, 6, 7), "~"
#: Folds whose scores by models of the other folds place the cut.
FOLDS = 3
CUT = 0.7
#: Signs that may stand around a word.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Neutral names of groups, by kind; terms of a kind are swapped for each other.
IDENTITY_TERMS = {
    "gender": ["women", "men", "woman", "man", "girls", "boys", "female", "male", "transgender", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"],
    "religion": ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    "origin": ["black", "white", "asian", "african", "european", "american", "mexican", "arab", "chinese", "indian"],
    "orientation": ["gay", "lesbian", "straight", "bisexual", "homosexual", "heterosexual"],
    "age_health": ["old", "young", "elderly", "disabled", "deaf", "blind"],
}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def features_of(word: str) -> list[str]:
    """The features of a bare word: itself and its beginnings."""
    return [word, *[word[:k] + TAIL for k in BEGINNINGS if len(word) > k]]


def bare_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and code of each word, and the distinct words in lower case without signs around them; codes may share a word."""
    rows, codes, distinct = words_of(texts)
    return rows, codes, pc.utf8_trim(pc.utf8_lower(distinct), SIGNS)


def feature_counts(texts: pa.Array, known: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Row, feature and count of each text's features in order, the features' names, and each text's number of words.

    With ``known`` only its features count, and a feature is its place there.
    """
    rows, codes, bare = bare_words(texts)
    size = pc.utf8_length(bare)
    forms = [pc.if_else(pc.greater(size, 0), bare, None)]
    forms += [pc.if_else(pc.greater(size, k), pc.binary_join_element_wise(pc.utf8_slice_codeunits(bare, 0, k), TAIL, ""), None) for k in BEGINNINGS]
    coded = pa.concat_arrays([f.cast(pa.string()) for f in forms]).dictionary_encode()
    names = coded.dictionary
    place = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    n_words = np.bincount(rows[place[: len(bare)][codes] >= 0] if len(codes) else [], minlength=len(texts))
    if known is not None:
        where = pc.fill_null(pc.index_in(names, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        place = np.where(place >= 0, where[place], -1) if len(where) else place
        names = known
    found = []
    for own in place.reshape(len(forms), -1):
        f = own[codes] if len(codes) else np.zeros(0, np.int64)
        found.append((rows.astype(np.int64) * max(len(names), 1) + f)[f >= 0])
    key, count = np.unique(np.concatenate(found), return_counts=True)
    return key // max(len(names), 1), key % max(len(names), 1), count, names, n_words


@dataclass(frozen=True)
class Model:
    """Log odds from features' log counts, the logarithm of the words and a bias; ``kinds`` and ``n_swaps`` tell what was swapped."""

    bias: float
    length: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)
    kinds: tuple[tuple[str, ...], ...] = ()
    n_swaps: int = 0


@dataclass(frozen=True)
class Rows:
    """Sparse training rows: entries (row, feature, count), the words of each row, and labels from 0 to 1."""

    row: np.ndarray
    feature: np.ndarray
    count: np.ndarray
    n_words: np.ndarray
    y: np.ndarray

    def take(self, which: np.ndarray) -> Rows:
        keep = which[self.row]
        return Rows((np.cumsum(which) - 1)[self.row[keep]], self.feature[keep], self.count[keep], self.n_words[which], self.y[which])


def swaps(rows: Rows, features: list[str], kinds: tuple[tuple[str, ...], ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The mean of the products of score changes under swaps, as entries (feature, feature, value), and the number of swaps.

    In a row that has a term, all of the term's occurrences become the next term of its kind,
    and after the last one the first; beginnings move with their words. A swap changes the
    log counts of both terms' features only, so that each term adds a small square matrix.
    """
    index = {f: i for i, f in enumerate(features)}
    partner = {t: kind[(k + 1) % len(kind)] for kind in kinds for k, t in enumerate(kind) if len(kind) > 1}
    order = np.lexsort((rows.feature, rows.row))
    row, feature, count = rows.row[order], rows.feature[order], rows.count[order]
    span = max(len(features), 1)
    key = row * span + feature

    def own(r: np.ndarray, f: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(key, r * span + f), max(len(key) - 1, 0))
        return np.where(key[at] == r * span + f, count[at], 0)

    by_feature = np.argsort(feature, kind="stable")
    starts = np.searchsorted(feature[by_feature], np.arange(len(features) + 1))
    out, n = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0
    for term, other in partner.items():
        if term not in index or term == other:
            continue
        hit = by_feature[starts[index[term]] : starts[index[term] + 1]]
        r, times = row[hit], count[hit]
        here = {index[f] for f in features_of(term) if f in index}
        there = {index[f] for f in features_of(other) if f in index}
        moved = np.array(sorted(here ^ there), dtype=np.int64)
        change = np.stack([np.log1p(own(r, f) + (times if f in there else -times)) - np.log1p(own(r, f)) for f in moved.tolist()])
        out.append((np.repeat(moved, len(moved)), np.tile(moved, len(moved)), (change @ change.T).ravel()))
        n += len(r)
    i, j, v = (np.concatenate(x) for x in zip(*out, strict=True))
    return i, j, v / max(n, 1), n


def objective(w: np.ndarray, rows: Rows, d: int, changes: tuple, counterfactual: float, ridge: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The penalised mean loss of weights (features, length, bias), its gradient, and each row's curvature."""
    n = max(len(rows.y), 1)
    value, length = np.log1p(rows.count), np.log1p(rows.n_words)
    odds = np.bincount(rows.row, value * w[rows.feature], minlength=len(rows.y))[: len(rows.y)] + w[d] * length + w[d + 1]
    p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    loss = (np.logaddexp(0, odds) - rows.y * odds).sum() / n
    slope = _back((p - rows.y) / n, rows, value, length, d)
    pull = np.r_[np.full(d + 1, ridge), 0.0]
    i, j, v, _ = changes
    moved = counterfactual * np.bincount(i, v * w[j], minlength=d + 2)
    loss += 0.5 * (pull * w * w).sum() + 0.5 * moved @ w
    return float(loss), slope + pull * w + moved, p * (1 - p)


def _back(u: np.ndarray, rows: Rows, value: np.ndarray, length: np.ndarray, d: int) -> np.ndarray:
    return np.r_[np.bincount(rows.feature, value * u[rows.row], minlength=d)[:d], (u * length).sum(), u.sum()]


def fit_rows(rows: Rows, features: list[str], kinds: tuple[tuple[str, ...], ...] = (), counterfactual: float = COUNTERFACTUAL, ridge: float = RIDGE, start: Model | None = None) -> Model:
    """Newton steps by conjugate gradients on the mean logistic loss with the counterfactual penalty.

    Each swap's squared change of the log odds is penalised by its mean over swaps, so that
    terms that come with toxic rows only by habit end up with nearly equal weights, whatever
    the number of rows. Rows are sparse; no matrix of features by features is built. The
    loss is convex: ``start`` only saves steps.
    """
    d, n = len(features), len(rows.y)
    rate = float(np.clip(rows.y.mean() if n else 0.0, 1e-3, 1 - 1e-3))
    w = np.zeros(d + 2)
    w[d + 1] = np.log(rate / (1 - rate))
    if not n or not d or rows.y.min() == rows.y.max():
        return Model(float(w[d + 1]), kinds=kinds)
    if start is not None and start.weights:
        w = np.array([*(start.weights[f] for f in features), start.length, start.bias])
    changes = swaps(rows, features, kinds)
    i, j, v, k = changes
    value, length = np.log1p(rows.count), np.log1p(rows.n_words)
    pull = np.r_[np.full(d + 1, ridge), 1e-9]
    diagonal = counterfactual * np.bincount(i[i == j], v[i == j], minlength=d + 2)
    loss, slope, bend = objective(w, rows, d, changes, counterfactual, ridge)
    for _ in range(60):
        u = (bend + 1e-9) / n

        def times(x: np.ndarray, u: np.ndarray = u) -> np.ndarray:
            odds = np.bincount(rows.row, value * x[rows.feature], minlength=n)[:n] + x[d] * length + x[d + 1]
            return _back(u * odds, rows, value, length, d) + pull * x + counterfactual * np.bincount(i, v * x[j], minlength=d + 2)

        scale = np.r_[np.bincount(rows.feature, value**2 * u[rows.row], minlength=d)[:d], (u * length**2).sum(), u.sum()] + pull + diagonal
        step = conjugate(times, slope, scale, near=min(0.1, np.sqrt(np.sqrt(slope @ slope))))
        size = 1.0
        while True:  # halve until the loss falls
            new = objective(w - size * step, rows, d, changes, counterfactual, ridge)
            if new[0] <= loss - 1e-4 * size * slope @ step or size < 1e-6:
                break
            size /= 2
        w = w - size * step
        done = loss - new[0] < 1e-9
        loss, slope, bend = new
        if done:
            break
    return Model(float(w[d + 1]), float(w[d]), dict(zip(features, w[:d].tolist(), strict=True)), kinds, k)


def odds_of(rows: Rows, features: list[str], model: Model) -> np.ndarray:
    w = np.array([model.weights.get(f, 0.0) for f in features])
    return np.bincount(rows.row, np.log1p(rows.count) * w[rows.feature], minlength=len(rows.y))[: len(rows.y)] + model.length * np.log1p(rows.n_words) + model.bias


def place_cut(odds: np.ndarray, y: np.ndarray) -> float:
    """The log odds that part labels with the fewest errors, in the middle of their gap."""
    order = np.argsort(odds, kind="stable")
    s, label = odds[order], y[order] >= 0.5
    errors = np.r_[(~label).sum(), (~label).sum() + np.cumsum(np.where(label, 1, -1))]
    k = int(np.argmin(errors))
    if not 0 < k < len(s):
        return 0.0
    return float((s[k - 1] + s[k]) / 2)


def fit(rows: Rows, features: list[str], kinds: tuple[tuple[str, ...], ...] = ()) -> Model:
    """The model of all rows, shifted so that CUT lies where scores from models of the other folds part the labels best."""
    model = fit_rows(rows, features, kinds)
    if not model.weights:
        return model
    fold, odds = np.arange(len(rows.y)) % FOLDS, np.zeros(len(rows.y))
    for k in range(FOLDS):
        own = fold == k
        odds[own] = odds_of(rows.take(own), features, fit_rows(rows.take(~own), features, kinds, start=model))
    shift = np.log(CUT / (1 - CUT)) - place_cut(odds, rows.y)
    return Model(model.bias + float(shift), model.length, model.weights, model.kinds, model.n_swaps)


def _feature_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            row, feature, _, names, _ = feature_counts(part.column("text"))
            y = part.column("toxic").to_numpy(zero_copy_only=False)
            one = np.bincount(feature, y[row], minlength=len(names)) if len(row) else np.zeros(len(names))
            all_ = np.bincount(feature, minlength=len(names)) if len(row) else np.zeros(len(names))
            yield pa.RecordBatch.from_arrays([names, pa.array(one), pa.array(all_ - one)], names=["feature", "docs_1", "docs_0"])


def _frames(batches: Iterator[pa.RecordBatch], terms: list[str]) -> Iterator[pa.RecordBatch]:
    known = pa.array(terms, pa.string())
    for batch in batches:
        for part in slices(batch):
            rows, codes, bare = bare_words(part.column("text"))
            place = pc.fill_null(pc.index_in(bare, known), -1).to_numpy(zero_copy_only=False)
            own = place[codes] if len(codes) else codes
            mid = np.flatnonzero(own[1:-1] >= 0) + 1 if len(codes) > 2 else np.zeros(0, np.int64)
            blank = pc.equal(bare, "").to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0, bool)
            mid = mid[(rows[mid - 1] == rows[mid]) & (rows[mid + 1] == rows[mid]) & ~blank[mid - 1] & ~blank[mid + 1]]
            sides = [bare.take(pa.array(codes[mid + k])) for k in (-1, 1)]
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(*sides, " "), pa.array(own[mid].astype(np.int32)), pa.array(rows[mid].astype(np.int64))], names=["frame", "term", "row"])


def _sparse_rows(batches: Iterator[pa.RecordBatch], features: list[str]) -> Iterator[pa.RecordBatch]:
    known = pa.array(features, pa.string())
    for batch in batches:
        for part in slices(batch):
            row, feature, count, _, n_words = feature_counts(part.column("text"), known)
            ends = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32))) for v in (feature, count)]
            yield pa.RecordBatch.from_arrays([part.column("h"), part.column("toxic"), pa.array(n_words.astype(np.int64)), *lists], names=["h", "toxic", "n_words", "features", "counts"])


def find_kinds(rows: DataFrame, counted: DataFrame, least: int = 2) -> tuple[tuple[str, ...], ...]:
    """Identity terms found in labelled rows, by kind.

    Candidates are words that documents of both labels use and that lean to the toxic ones,
    as names of groups do that people are insulted for. Candidates that stand in one frame
    (between the same two words) are of a kind; a term takes the frame in which it occurs
    most often, ties go to the first by name. A kind has two terms or more.
    """
    lean = F.col("log_odds") / F.col("error")
    found = counted.where(~F.col("feature").endswith(TAIL) & (F.col("docs_1") >= TERM_DOCS) & (F.col("docs_0") >= TERM_DOCS) & (lean >= TERM_Z))
    terms = sorted(r[0] for r in found.select("feature").collect())
    if not terms:
        return ()
    frames = rows.select("text").mapInArrow(lambda it: _frames(it, terms), "frame string, term int, row long").groupBy("frame", "term").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    shared = frames.withColumn("terms", F.expr("count(*) over (partition by frame)")).where("terms > 1")
    best = shared.withColumn("k", F.expr("row_number() over (partition by term order by n desc, frame)")).where("k = 1")
    groups: dict[str, list[str]] = {}
    for r in best.select("frame", "term").collect():
        groups.setdefault(r["frame"], []).append(terms[r["term"]])
    return tuple(tuple(sorted(g)) for _, g in sorted(groups.items()) if len(g) > 1)


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, terms: dict[str, list[str]] | None = None) -> Model:
    """Fit on the distinct texts of at most ``train_rows`` labelled documents whose id isn't held out.

    Copies have one voice: their label is the mean of their labels. The chosen labels (a
    bounded number) are broadcast; features are counted and identity terms found on the
    cluster. The driver gets the names of the features that tell the labels apart and, of
    each chosen row, which of these it has how often. ``terms`` are lists of identity terms
    by kind, besides those found. Without labels of both kinds all scores are equal.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.avg("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    labelled = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id").select("toxic", "text")
    rows = cut(labelled.groupBy(F.xxhash64("text").alias("h")).agg(F.avg("toxic").alias("toxic"), F.first("text").alias("text")))
    total, positive = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0.0))).first()
    a, b = F.col("docs_1"), F.col("docs_0")
    n1, n0 = float(positive), float(total - positive)
    counted = rows.select("toxic", "text").mapInArrow(_feature_docs, "feature string, docs_1 double, docs_0 double").groupBy("feature").agg(F.sum("docs_1").alias("docs_1"), F.sum("docs_0").alias("docs_0"))
    counted = counted.withColumn("log_odds", F.log((a + 0.5) / (n1 - a + 0.5)) - F.log((b + 0.5) / (n0 - b + 0.5)))
    counted = cut(counted.withColumn("error", F.sqrt(1 / (a + 0.5) + 1 / (n1 - a + 0.5) + 1 / (b + 0.5) + 1 / (n0 - b + 0.5))).where(a + b >= MIN_DOCS))
    named = IDENTITY_TERMS if terms is None else terms
    kinds = (*(tuple(g) for _, g in sorted(named.items())), *find_kinds(rows, counted))
    wanted = sorted({t for kind in kinds for t in kind})
    telling = counted.where((F.abs(F.col("log_odds") / F.col("error")) >= MIN_Z) | F.col("feature").isin(wanted))
    features = sorted(r[0] for r in telling.select("feature").collect())
    got = rows.mapInArrow(lambda it: _sparse_rows(it, features), "h long, toxic double, n_words long, features array<int>, counts array<int>").orderBy("h").toArrow().combine_chunks()
    flat = lambda name: pc.list_flatten(got.column(name)).to_numpy().astype(np.int64)
    sizes = pc.list_value_length(got.column("features")).to_numpy()
    sparse = Rows(np.repeat(np.arange(got.num_rows), sizes), flat("features"), flat("counts"), got.column("n_words").to_numpy().astype(float), got.column("toxic").to_numpy())
    del got
    return fit(sparse, features, kinds)


def _score(batches: Iterator[pa.RecordBatch], features: list[str], weights: np.ndarray, length: float, bias: float) -> Iterator[pa.RecordBatch]:
    known = pa.array(features, pa.string())
    for batch in batches:
        for part in slices(batch):
            row, feature, count, _, n_words = feature_counts(part.column("text"), known)
            own = np.bincount(row, np.log1p(count) * weights[feature], minlength=part.num_rows) if len(row) else np.zeros(part.num_rows)
            odds = own + length * np.log1p(n_words) + bias
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(odds, -30, 30))))], names=["doc_id", "score"])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; a null or blank text gets the bias alone, repeated rows stay."""
    features = sorted(model.weights)
    weights = np.array([model.weights[w] for w in features], dtype=float)
    length, bias = model.length, model.bias
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = src.mapInArrow(lambda it: _score(it, features, weights, length, bias), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
