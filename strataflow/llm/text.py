"""Helpers on Arrow batches of texts: words by dictionary, token ids by word."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts of one slice come to about this many bytes, so a task's memory doesn't follow the batch.
SLICE_BYTES = 6_000_000
#: Units whose ids one worker keeps, some 75 MB.
CACHE_UNITS = 500_000


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut ``batch`` into runs of rows with about ``most`` bytes of ``column`` (a longer text stands alone)."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, n], strict=True):
        yield batch.slice(int(a), int(b - a))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row of each word, its code, and the distinct words; words lie between ASCII white space.

    Null and blank texts have no words.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    coded = pc.list_flatten(lists).dictionary_encode()
    codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    blank = pc.index(words, "").as_py()
    if blank >= 0:
        keep = codes != blank
        rows, codes = rows[keep], codes[keep]
    return rows, codes, words


#: Letters that the tokenizer's normaliser maps one by one, then ASCII signs that it keeps together.
SIMPLE = r"^(?P<stem>[A-Za-z\x{00c0}-\x{00d6}\x{00d8}-\x{00f6}\x{00f8}-\x{00ff}]*)(?P<sign>[!-&(-/:;=?@\[-`{-~]*)$"


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds:
    """Ids by unit (a run of letters, a run of signs, or another whole word), in one growing array.

    ``path`` is a lower-casing byte-level BPE with word ends, which never merges across units.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.letters = byte_letters()
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.at, self.size, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0
        self.add([""], [[]])

    def unit(self, text: str) -> list[int]:
        """Ids of lower-case letters or of signs: a single run of the vocabulary's merges."""
        text = text if text.isascii() else "".join(map(self.letters.__getitem__, text.encode()))
        return [x.id for x in self.encoder.model.tokenize(text)]

    def places(self, words: pa.Array) -> np.ndarray:
        """Two places in ``at`` and ``size`` for each distinct word: its letters' and its signs'."""
        both = pc.extract_regex(words, SIMPLE)
        hard = np.flatnonzero(pc.is_null(both).to_numpy(zero_copy_only=False))
        stems = pc.utf8_lower(pc.fill_null(pc.struct_field(both, "stem"), "")).dictionary_encode()
        signs = pc.fill_null(pc.struct_field(both, "sign"), "").dictionary_encode()
        units = [*stems.dictionary.to_pylist(), *signs.dictionary.to_pylist()]
        rest = words.take(pa.array(hard)).to_pylist()
        if len(self.place) + len(units) + len(rest) > CACHE_UNITS:
            self.clear()
        new = [u for u in dict.fromkeys(units) if u not in self.place]
        self.add(new, list(map(self.unit, new)))
        new = [w for w in rest if w not in self.place]
        self.add(new, [e.ids for e in self.encoder.encode_batch(new, add_special_tokens=False)])
        got = np.fromiter(map(self.place.__getitem__, units), np.int64, len(units))
        out = np.empty((len(words), 2), np.int64)
        out[:, 0] = got[stems.indices.to_numpy()]
        out[:, 1] = got[signs.indices.to_numpy() + len(stems.dictionary)]
        out[hard, 0] = [self.place[w] for w in rest]
        return out

    def add(self, units: list[str], ids: list[list[int]]) -> None:
        k, n = len(self.place), len(self.place) + len(units)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(size.sum()))
        if n > len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros(n, np.int64)]) for x in (self.at, self.size))
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(self.used + len(flat), np.uint32)])
        self.at[k:n], self.size[k:n] = self.used + np.cumsum(size) - size, size
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.place.update(zip(units, range(k, n), strict=True))


_WORKER: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's one ``WordIds``, for the path asked for last."""
    if path not in _WORKER:
        _WORKER.clear()
        _WORKER[path] = WordIds(path)
    return _WORKER[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_ids(texts: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, each text followed by ``end_id``, and the n + 1 offsets of the texts.

    The tokenizer drops white space and never merges across it, so each distinct word is
    encoded once and the texts are put together from the words' ids.
    """
    n = len(texts)
    offsets = np.zeros(n + 1, np.int64)
    if not n:
        return np.zeros(0, np.uint32), offsets
    rows, codes, words = words_of(texts)
    known = word_ids(path)
    place = known.places(words)[codes].ravel()
    sizes = known.size[place]
    per_text = np.bincount(rows, weights=sizes.reshape(-1, 2).sum(axis=1), minlength=n).astype(np.int64)
    np.cumsum(per_text + 1, out=offsets[1:])
    ids = np.full(offsets[-1], end_id, np.uint32)
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    # from the places in the table to all places of the output that don't hold an end id
    source = np.arange(total) + np.repeat(known.at[place] - (ends - sizes), sizes)
    target = np.ones(len(ids), bool)
    target[offsets[1:] - 1] = False
    ids[target] = known.flat[source]
    return ids, offsets
