"""Re-Pair grammar compression of token ids, a grammar for each shard."""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm.text import default_tokenizer, slices, token_ids
from strataflow.session import scratch_path

END_ID = 2
#: Ids of a shard at least; a shard ends with the first document that reaches it.
SHARD_IDS = 1 << 20
#: Documents of a part at most, on average: as many are sorted in a task.
PART_DOCS = 20_000
#: In each round all pairs found at least so often get a nonterminal, until there are none. A rule is two symbols, so that a pair found twice would save nothing.
MIN_COUNT = 3

MAGIC = b"RPG2"
HEAD = struct.Struct("<4sIIIQ")
#: Slots of the table that a round's pairs are looked up in first, as a power of two.
TABLE_BITS = 20

SHARD_SCHEMA = "part int, shard int, first_id long, n_docs long, n_ids long, doc_ids array<long>, n_symbols long, body binary"


def compress(ids: np.ndarray, ends: np.ndarray, rounds: int | None = None, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, their ends for each document, rules as pairs, and the terminals.

    A symbol below the number of terminals is the terminal at that place, the others are
    rules. Each round counts all neighbouring pairs within documents, gives each frequent one
    a nonterminal, and replaces them from left to right without overlap; pairs of
    nonterminals pair up in later rounds, which go on until no pair is frequent (or for
    ``rounds``). ``ends`` are the n running totals of ids.
    """
    there = np.zeros(int(ids.max()) + 1 if len(ids) else 0, bool)
    there[ids] = True
    terminals, first = np.flatnonzero(there), int(there.sum())
    seq = (np.cumsum(there) - 1)[ids]
    last = np.zeros(len(seq), bool)
    last[ends[np.diff(ends, prepend=0) > 0] - 1] = True
    owner_ends = ends.copy()
    rules = np.zeros((0, 2), np.int64)
    for _ in itertools.count() if rounds is None else range(rounds):
        span = first + len(rules)
        seq = seq.astype(np.uint32 if span < 1 << 16 else np.uint64)
        key = seq[:-1] * seq.dtype.type(span) + seq[1:]
        open_ = ~last[:-1]
        ordered = np.sort(key[open_])
        if not len(ordered):
            break
        starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        pairs = ordered[starts[np.diff(np.r_[starts, len(ordered)]) >= min_count]]
        if not len(pairs):
            break
        # a table by hash leads to the pair; only pairs that share a slot are searched for
        slot = lambda k: (k.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - TABLE_BITS)
        table = np.full(1 << TABLE_BITS, -1, np.int32)
        table[slot(pairs)] = np.arange(len(pairs), dtype=np.int32)
        at = table[slot(key)]
        where = np.flatnonzero((at >= 0) & open_)
        at, own = at[where].astype(np.int64), key[where]
        other = np.flatnonzero(pairs[at] != own)
        at[other] = np.minimum(np.searchsorted(pairs, own[other]), len(pairs) - 1)
        hit = pairs[at] == own
        where, at = where[hit], at[hit]
        # of a run of overlapping hits every other one is replaced
        new_run = np.r_[True, np.diff(where) > 1]
        run_start = where[np.maximum.accumulate(np.where(new_run, np.arange(len(where)), 0))]
        even = (where - run_start) % 2 == 0
        where, at = where[even], at[even]
        # a pair may lose its hits to overlaps; one that keeps a single hit gets no rule
        used = np.bincount(at, minlength=len(pairs)) > 1
        if not used.any():
            break
        where, at = where[used[at]], (np.cumsum(used) - 1)[at[used[at]]]
        pairs = pairs[used].astype(np.int64)
        seq = seq.astype(np.int64)
        seq[where] = span + at
        keep = np.ones(len(seq), bool)
        keep[where + 1] = False
        last[where] = last[where + 1]
        owner_ends = owner_ends - np.searchsorted(where, owner_ends - 1)
        seq, last = seq[keep], last[keep]
        rules = np.concatenate([rules, np.stack([pairs // span, pairs % span], axis=1)])
    return seq.astype(np.int64), owner_ends, rules, terminals


def rule_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids that each rule expands to; a rule refers to earlier symbols only."""
    return _expand_table(rules, first)[1]


def _expand_table(rules: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """All rules' expansions in a row, and their lengths."""
    lengths = np.ones(len(rules), np.int64)
    a, b = (rules[:, 0], rules[:, 1]) if len(rules) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    size = lambda x: np.where(x < first, 1, lengths[np.maximum(x - first, 0)] if len(rules) else 1)
    # the rules of one round refer to earlier rounds only; as many passes as rounds settle all
    while True:
        now = size(a) + size(b)
        if (now == lengths).all():
            break
        lengths = now
    order = np.argsort(lengths, kind="stable")
    at = np.zeros(len(rules), np.int64)
    at[order] = np.cumsum(lengths[order]) - lengths[order]
    flat = np.zeros(int(lengths.sum()), np.int64)
    for n in np.unique(lengths):
        own = np.flatnonzero(lengths == n)
        for side, shift in ((a, None), (b, a)):
            s = side[own]
            start = at[own] + (size(shift[own]) if shift is not None else 0)
            leaf = s < first
            flat[start[leaf]] = s[leaf]
            inner, to = s[~leaf] - first, start[~leaf]
            count = lengths[inner]
            step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            flat[np.repeat(to, count) + step] = flat[np.repeat(at[inner], count) + step]
    return flat, lengths


def expand(seq: np.ndarray, rules: np.ndarray, first: int, table: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The ids of ``seq``."""
    flat, lengths = table or _expand_table(rules, first)
    by_length = np.argsort(lengths, kind="stable")
    at = np.zeros(len(rules), np.int64)
    at[by_length] = np.cumsum(lengths[by_length]) - lengths[by_length]
    inner = seq >= first
    size = np.ones(len(seq), np.int64)
    size[inner] = lengths[seq[inner] - first]
    # a leaf reads itself from behind the table
    source = np.zeros(len(seq), np.int64)
    source[inner] = at[seq[inner] - first]
    source[~inner] = len(flat) + np.flatnonzero(~inner)
    both = np.concatenate([flat, seq])
    begin = np.cumsum(size) - size
    return both[np.repeat(source - begin, size) + np.arange(int(size.sum()))].astype(np.uint32)


def pack_bits(values: np.ndarray) -> bytes:
    """A byte with the bits that the largest value needs, then all values in so many bits each, lowest bit first."""
    v = np.ascontiguousarray(values, dtype="<u4")
    width = max(int(v.max()).bit_length(), 1) if len(v) else 1
    out = [bytes([width])]
    for a in range(0, len(v), 1 << 16):  # whole bytes at any width
        bits = np.unpackbits(v[a : a + (1 << 16)].view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
        out.append(np.packbits(bits, bitorder="little").tobytes())
    return b"".join(out)


def unpack_bits(body: bytes | memoryview, at: int, count: int, begin: int = 0) -> np.ndarray:
    """``count`` values from the ``begin``-th on of what ``pack_bits`` put at ``at``."""
    width = body[at]
    low = begin * width
    raw = np.frombuffer(body, np.uint8, (low + count * width + 7) // 8 - low // 8, at + 1 + low // 8)
    out = np.empty(count, np.int64)
    for a in range(0, count, 1 << 16):
        n = min(1 << 16, count - a)
        skip = low % 8 + a * width
        bits = np.unpackbits(raw[skip // 8 : (skip + n * width + 7) // 8], bitorder="little")[skip % 8 :][: n * width].reshape(n, width)
        wide = np.zeros((n, 32), np.uint8)
        wide[:, :width] = bits
        out[a : a + n] = np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()
    return out


def packed_bytes(body: bytes | memoryview, at: int, count: int) -> int:
    return 1 + (count * body[at] + 7) // 8


def write_shard(ids: np.ndarray, ends: np.ndarray) -> tuple[bytes, int]:
    """The shard's bytes and its number of symbols.

    Head (magic, documents, terminals, rules, symbols), then packed in as many bits as each
    needs: the terminals (each less the one before), the rules as pairs, the rules' expansion
    lengths, each document's number of symbols and of ids, and the symbols.
    """
    seq, ends_in, rules, terminals = compress(ids, ends)
    head = HEAD.pack(MAGIC, len(ends), len(terminals), len(rules), len(seq))
    parts = [np.diff(terminals.astype(np.int64), prepend=0), rules.ravel(), rule_lengths(rules, len(terminals)), np.diff(ends_in, prepend=0), np.diff(ends, prepend=0), seq]
    return head + b"".join(map(pack_bits, parts)), len(seq)


class Shard:
    """A shard's bytes, opened; ``doc(k)`` decodes one document without the others."""

    def __init__(self, body: bytes):
        magic, docs, terminals, rules, self.symbols = HEAD.unpack_from(body)
        if magic != MAGIC:
            raise ValueError("not a grammar shard")
        at, got = HEAD.size, []
        for count in (terminals, 2 * rules, rules, docs, docs):
            got.append(unpack_bits(body, at, count))
            at += packed_bytes(body, at, count)
        self.terminals, self.lengths = np.cumsum(got[0]), got[2]
        self.rules, self.ends_in, self.ends = got[1].reshape(-1, 2), np.cumsum(got[3]), np.cumsum(got[4])
        self.body, self.at = body, at
        self.table = _expand_table(self.rules, len(self.terminals))

    def _ids(self, begin: int, count: int) -> np.ndarray:
        seq = unpack_bits(self.body, self.at, count, begin)
        return self.terminals[expand(seq, self.rules, len(self.terminals), self.table)].astype(np.uint32)

    def doc(self, k: int) -> np.ndarray:
        a = int(self.ends_in[k - 1]) if k else 0
        return self._ids(a, int(self.ends_in[k]) - a)

    def all(self) -> np.ndarray:
        return self._ids(0, self.symbols)


def _shards(batches: Iterator[pa.RecordBatch], path: str, end_id: int, shard_ids: int) -> Iterator[pa.RecordBatch]:
    part, shard, before = TaskContext.get().partitionId(), 0, 0
    docs: list = []
    ids: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    held = 0

    def flush() -> pa.RecordBatch:
        nonlocal docs, ids, sizes, held, shard, before
        ends = np.cumsum(np.concatenate(sizes))
        body, symbols = write_shard(np.concatenate(ids), ends)
        row = [[part], [shard], [before], [len(docs)], [int(ends[-1])], [docs], [symbols], [body]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary()]
        docs, ids, sizes, held, shard, before = [], [], [], 0, shard + 1, before + held
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=["part", "shard", "first_id", "n_docs", "n_ids", "doc_ids", "n_symbols", "body"])

    for batch in batches:
        for piece in slices(batch):
            got, offsets = token_ids(piece.column("text"), path, end_id)
            names, size, a = piece.column("doc_id").to_pylist(), np.diff(offsets), 0
            while a < len(names):
                # documents up to the one that fills the shard
                b = min(len(names), a + 1 + int(np.searchsorted(np.cumsum(size[a:]), shard_ids - held)))
                docs += names[a:b]
                ids.append(got[offsets[a] : offsets[b]])
                sizes.append(size[a:b])
                held += int(offsets[b] - offsets[a])
                a = b
                if held >= shard_ids:
                    yield flush()
    if docs:
        yield flush()


def write(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Encode ``docs`` and write its shards to ``path`` in ascending doc_id order.

    Spark writes a row for each shard: its place (``part``, ``shard``), counts, the doc_ids
    and the shard's bytes, so that any store that Spark reaches will do. A null text is empty;
    a null doc_id comes first; documents of one doc_id are ordered by their texts' hash. An
    empty table gives no shards.
    """
    spark = docs.sparkSession
    tokens = tokenizer_path or default_tokenizer()
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-src.count() // PART_DOCS), 1)
    ranged = src.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ranged.mapInArrow(lambda it: _shards(it, tokens, end_id, shard_ids), SHARD_SCHEMA).write.parquet(path)


def _decode(batches: Iterator[pa.RecordBatch], before: dict[int, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            shard = Shard(batch.column("body")[row].as_py())
            base = before[batch.column("part")[row].as_py()] + batch.column("first_id")[row].as_py()
            raw = memoryview(shard.all().astype("<u4")).cast("B")
            starts = np.r_[0, shard.ends[:-1]]
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), shard.ends.tolist(), strict=True)]
            cols = [batch.column("doc_ids")[row].values, pa.array(starts + base), pa.array(shard.ends - starts), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the shards at ``path``: doc_id, start, n_tokens, ids_crc32, all from the decoded ids.

    The driver adds up one number for each part, that is for each task of the writing job.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    before, total = {}, 0
    for part, n in sorted(tuple(r) for r in shards.groupBy("part").agg(F.sum("n_ids")).collect()):
        before[part] = total
        total += n
    return shards.select("part", "first_id", "doc_ids", "body").mapInArrow(lambda it: _decode(it, before), "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read_back(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Write ``docs`` to a fresh path in the shared folder and read it back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "grammar")
    write(docs, path, tokenizer_path)
    return read(spark, path)
