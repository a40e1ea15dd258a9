"""Near-duplicates by SimHash where similar texts' fingerprints differ in many bits: 5-word shingles, similarity of 0.8 or more.

At that similarity a bit of two fingerprints differs with a probability of up to ``APART``, so
that 64 bits give no index. Fingerprints here have some thousand bits, on a ring of segments.
A chain starts where a segment has no differing bit, which files the fingerprint; behind it
the chain keeps within budgets of differing bits, and then the Hamming check on the whole
fingerprint and whole sets of shingles decide.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.minhash import LEAST, Compared, in_blocks, in_pairs, set_key, shingles, similar
from strataflow.llm.simhash import Forest, name_groups, text_key
from strataflow.llm.text import slices
from strataflow.operators.components import connected_components
from strataflow.session import cut, scratch_path

#: The probability that a bit differs at ``LEAST``, at most: of two sets of SMALL shingles or more (the angle gives 0.1515 for large ones), and of smaller ones.
APART, APART_SMALL = 0.154, 0.1875
#: Sets under SMALL shingles are filed under their smallest hashes instead, with all that may be similar to them; no pair of these is missed.
SMALL = 64
WITH_SMALL = math.ceil(SMALL / LEAST)
#: The probability that a pair at ``LEAST`` has no segment in common, and that it has more differing bits than a budget.
LOSS, OVER = 1e-6, 1e-7
#: Bits of a fingerprint at least, of its first part in the Hamming check, and of each of a chain's three steps behind the first segment.
PRINT, HEAD, STEP = 4096, 1024, 64
#: What filing a fingerprint under one more segment costs (a row of 32 bytes shuffled, held on disk and sorted), in comparisons of two chains.
KEY_COST = 512
#: Rows of a segment's value that are compared at once to find which meet any other, that are joined by first links, and that meet in a task.
BLOCK, FIRST, MEET = 1024, 256, 4096
#: Of so many segments one is looked at for the first links.
EACH = 8
#: Nodes of a cell, whose sets meet those of another cell in a task.
CELL = 256

_LANES = np.uint64(0x0101010101010101)


def segments(nodes: int) -> tuple[int, int]:
    """Bits of a segment and how many segments, for so many fingerprints: the least work for a loss of ``LOSS``."""

    def count(bits: int) -> int:
        return math.ceil(math.log(LOSS) / math.log1p(-((1 - APART) ** bits)))

    best = min(range(8, 41), key=lambda b: count(b) * (KEY_COST + nodes / 2.0 ** (b + 1)))
    return best, count(best)


def budget(bits: int, apart: float) -> int:
    """The least number of differing bits that is exceeded with a probability of ``OVER`` at most."""
    over, k = 1.0, -1
    while over > OVER:
        k += 1
        over -= math.exp(math.lgamma(bits + 1) - math.lgamma(k + 1) - math.lgamma(bits - k + 1) + k * math.log(apart) + (bits - k) * math.log1p(-apart))
    return k


def wide_print(own: np.ndarray, words: int) -> bytes:
    """The SimHash of a set of shingles in ``words`` times 64 bits: a bit is 1 if set in over half of their hashes."""
    counts = np.zeros((8, 8 * words), np.int64)
    salt = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for a in range(0, len(own), 255):  # so many fit the bytes that count
        x = own[a : a + 255, None] + salt
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        for k in range(8):
            counts[k] += ((x >> np.uint64(k)) & _LANES).sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits(2 * counts > len(own), axis=0, bitorder="little").tobytes()


def prefix(own: np.ndarray) -> np.ndarray:
    """The smallest hashes of a set, so many that similar sets have one in common."""
    return own[: len(own) - math.ceil(LEAST * len(own) - 1e-9) + 1]


SIGNED = "doc_id long, key long, node long, n int, print binary, small array<long>"


def _signatures(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            sets = [shingles(t or "") for t in part.column("text").to_pylist()]
            small = [prefix(s).view(np.int64).tolist() if len(s) < WITH_SMALL else [] for s in sets]
            own = [pa.array([set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([wide_print(s, words) for s in sets], pa.binary()), pa.array(small, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), *own], names=[c.split()[0] for c in SIGNED.split(", ")])


def _long(ring: np.ndarray, at: int, bits: int) -> np.ndarray:
    """``bits`` bits of each row's ring as a long."""
    packed = np.packbits(ring[:, at : at + bits], axis=1, bitorder="little")
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, 8 - packed.shape[1])))).view(np.int64)[:, 0]


FILED = "bucket long, node long, one long, two long, three long"


def _filed(batches: Iterator[pa.RecordBatch], bits: int, count: int) -> Iterator[pa.RecordBatch]:
    """Each fingerprint under the value of every segment, with the chain's three steps behind it; small sets under hashes, in negative buckets."""
    for whole in batches:
        for a in range(0, whole.num_rows, 2048):
            batch = whole.slice(a, 2048)
            node, n = batch.column("node").to_numpy(), batch.column("n").to_numpy()
            ring = np.unpackbits(np.frombuffer(b"".join(batch.column("print").to_pylist()), np.uint8).reshape(len(n), -1), axis=1, bitorder="little")[:, : bits * count]
            ring = np.concatenate([ring, ring[:, : 3 * STEP + bits]], axis=1)
            small = batch.column("small").to_pylist()
            at = np.repeat(np.arange(len(n)), [len(s) for s in small])
            named = np.array([h for s in small for h in s], np.int64) | np.iinfo(np.int64).min
            out = [(named, at, 0)]
            large = np.flatnonzero(n >= SMALL)
            out += [(_long(ring[large], k * bits, bits) * count + k, large, (k + 1) * bits) for k in range(count)]
            for bucket, rows, behind in out:
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket, node[rows], _long(ring[rows], behind, STEP), _long(ring[rows], behind + STEP, STEP), _long(ring[rows], behind + 2 * STEP, STEP))], names=[c.split()[0] for c in FILED.split(", ")])


def _starts(table: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    new = np.arange(table.num_rows) == 0
    for c in keys:
        x = table.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return new


def _in_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], of: Callable[[pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``of`` whole groups of a stream sorted by ``keys``."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        last = int(np.flatnonzero(_starts(table, keys))[-1])  # its group may go on
        if last:
            yield of(table.slice(0, last).combine_chunks())
        held = table.slice(last)
    if held is not None:
        yield of(held.combine_chunks())


def _left(new: np.ndarray) -> np.ndarray:
    """How many rows of its group follow each row, itself included."""
    size = np.diff(np.r_[np.flatnonzero(new), len(new)])
    return np.repeat(np.flatnonzero(new) + size, size) - np.arange(len(new))


MET = "bucket long, part int, node long"


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a stream sorted by bucket whose chain keeps its budgets with some other row's of the bucket; ``part`` counts its rows by ``FIRST``.

    Of a bucket with over ``BLOCK`` rows every one passes, as it comes.
    """
    allowed = {s: [budget(k * STEP, p) for k in (1, 2, 3)] for s, p in ((False, APART), (True, APART_SMALL))}

    def met(bucket: np.ndarray, node: np.ndarray, *steps: np.ndarray) -> pa.RecordBatch:
        left = _left(np.r_[True, bucket[1:] != bucket[:-1]])
        few, found = bucket < 0, np.zeros(len(bucket), bool)
        most = [np.where(few, allowed[True][k], allowed[False][k]) for k in range(3)]
        rows, words = np.arange(len(bucket)), [x.view(np.uint64) for x in steps]
        for shift in range(1, int(left.max(initial=0))):
            rows = rows[left[rows] > shift]
            p, bits = rows, np.zeros(len(rows), np.int64)
            for word, limit in zip(words, most, strict=True):
                bits = bits + np.bitwise_count(word[p] ^ word[p + shift])
                near = bits <= limit[p]
                p, bits = p[near], bits[near]
            found[p] = found[p + shift] = True
        bucket, node = bucket[found], node[found]
        new = np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)]
        start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        return rows_of(bucket, (np.arange(len(new)) - start) // FIRST, node)

    def rows_of(bucket: np.ndarray, part: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(part.astype(np.int32)), pa.array(node)], names=[c.split()[0] for c in MET.split(", ")])

    held, passing, passed = [np.zeros(0, np.int64)] * 5, None, 0
    for batch in batches:
        rows = [batch.column(c).to_numpy() for c in ("bucket", "node", "one", "two", "three")]
        if passing is not None:
            own = int(np.searchsorted(rows[0], passing, "right"))
            if own:
                yield rows_of(rows[0][:own], (passed + np.arange(own)) // FIRST, rows[1][:own])
                passed += own
            rows = [x[own:] for x in rows]
            if not len(rows[0]):
                continue
            passing = None
        held = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        if not len(held[0]):
            continue
        last = int(np.searchsorted(held[0], held[0][-1]))
        # buckets of over BLOCK rows that end within the batch
        size = _left(np.r_[True, held[0][1:] != held[0][:-1]])
        begin = np.flatnonzero(np.r_[True, held[0][1:] != held[0][:-1]])
        for a in begin[(size[begin] > BLOCK) & (begin < last)].tolist():
            yield rows_of(held[0][a : a + size[a]], np.arange(size[a]) // FIRST, held[1][a : a + size[a]])
        keep = np.ones(last, bool)
        for a in begin[(size[begin] > BLOCK) & (begin < last)].tolist():
            keep[a : a + size[a]] = False
        if keep.any():
            yield met(*[x[:last][keep] for x in held])
        held = [x[last:] for x in held]
        if len(held[0]) > BLOCK:
            passing, passed = held[0][0], len(held[0])
            yield rows_of(held[0], np.arange(passed) // FIRST, held[1])
            held = [x[:0] for x in held]
    if len(held[0]):
        yield met(*held)


class Prints:
    """Fingerprints and sizes of a table's sets."""

    def __init__(self, table: pa.Table):
        self.n = table.column("n").to_numpy().astype(np.int64)
        self.words = np.frombuffer(b"".join(table.column("print").to_pylist()), np.uint64).reshape(len(self.n), -1)
        bits = 64 * self.words.shape[1] if len(self.n) else PRINT
        self.head, self.whole = ((budget(b, APART), budget(b, APART_SMALL)) for b in (HEAD, bits))

    def apart(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Differing bits of each pair; -1 for pairs that sizes or the Hamming check rule out."""
        small, large = np.minimum(self.n[p], self.n[q]), np.maximum(self.n[p], self.n[q])
        out, at = np.full(len(p), -1), np.flatnonzero(small >= LEAST * large)
        for a in range(0, len(at), 1 << 12):
            own = at[a : a + (1 << 12)]
            for words, most in ((HEAD // 64, self.head), (None, self.whole)):
                bits = np.bitwise_count(self.words[p[own], :words] ^ self.words[q[own], :words]).sum(axis=1, dtype=np.int64)
                near = bits <= np.where(small[own] < SMALL, most[1], most[0])
                own, bits = own[near], bits[near]
            out[own] = bits
        return out


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _first_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nearest pairs that join the nodes of each part of a bucket, so far as the Hamming check lets any."""

    def links(table: pa.Table) -> pa.RecordBatch:
        left, prints, node = _left(_starts(table, ("bucket", "part"))), Prints(table), table.column("node").to_numpy()
        found, rows = [np.zeros((3, 0), np.int64)], np.arange(len(left))
        for shift in range(1, int(left.max(initial=0))):
            rows = rows[left[rows] > shift]
            bits = prints.apart(rows, rows + shift)
            found.append(np.stack([bits, rows, rows + shift])[:, bits >= 0])
        found = np.concatenate(found, axis=1)
        forest = Forest(len(left))
        chosen = [(p, q) for _, p, q in found[:, np.argsort(found[0], kind="stable")].T.tolist() if forest.join(p, q)]
        p, q = np.array(chosen, np.int64).reshape(-1, 2).T
        return _pair_batch(node[p], node[q])

    return _in_groups(batches, ("bucket", "part"), links)


def _pairs(batches: Iterator[pa.RecordBatch], bits: int, count: int) -> Iterator[pa.RecordBatch]:
    """The pairs of different known groups that the Hamming check leaves, each under the first segment that it has in common."""

    def pairs(table: pa.Table) -> pa.RecordBatch:
        bucket, i, j, side, node, known = (table.column(c).to_numpy() for c in ("band", "i", "j", "side", "node", "known"))
        left, prints = _left(_starts(table, ("band", "i", "j"))), Prints(table)
        found, rows = [np.zeros((2, 0), np.int64)], np.arange(len(left))
        for shift in range(1, int(left.max(initial=0))):
            rows = rows[left[rows] > shift]
            p = rows[((i[rows] == j[rows]) | (side[rows] != side[rows + shift])) & (known[rows] != known[rows + shift])]
            p = p[prints.apart(p, p + shift) >= 0]
            place = bucket[p] % count
            ring = np.unpackbits((prints.words[p] ^ prints.words[p + shift]).view(np.uint8), axis=1, bitorder="little")[:, : bits * count]
            first = ring.reshape(len(p), count, bits).any(axis=2).argmin(axis=1)
            p = p[(bucket[p] < 0) | (first == place)]
            found.append(np.stack([p, p + shift]))
        p, q = np.concatenate(found, axis=1)
        return _pair_batch(node[p], node[q])

    return _in_groups(batches, ("band", "i", "j"), pairs)


def _alike(pairs: pa.Table, rows: pa.Table) -> pa.Table:
    """The similar ones of two cells' pairs (a, b); ``rows`` has their sets."""
    sets = {k: np.frombuffer(h, np.uint64) for k, h in zip(rows.column("node").to_pylist(), rows.column("hashes").to_pylist(), strict=True)}
    keep = [similar(sets[a], sets[b]) for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True)]
    return pairs.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def alike(compared: Compared, pairs: DataFrame) -> DataFrame:
    """The similar ones of (a, b). Nodes are dealt to cells, so that a set goes once to each pair of cells that needs it, not to each pair."""
    sets = compared.sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    cells = max(1, math.ceil(sets.count() / CELL))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(cells))
    placed = pairs.select(F.least(at("a"), at("b")).alias("i"), F.greatest(at("a"), at("b")).alias("j"), "a", "b")
    named = placed.select(F.col("i").alias("k"), F.col("j").alias("l"), F.explode(F.array("a", "b")).alias("node")).distinct().join(sets, "node")
    return cut(placed.groupBy("i", "j").cogroup(named.groupBy("k", "l")).applyInArrow(_alike, "a long, b long"))


def near_duplicates(docs: DataFrame, block: int = MEET) -> DataFrame:
    """doc_id, key (the text's), group and component_id (the smallest doc_id reachable over pairs of similarity ``LEAST`` or more) of every row.

    Rows with one set of shingles are one node. Fingerprints are filed under the segments of
    their ring, and those stay whose chain from a common segment keeps its budgets with some
    other's. The nearest pairs of some segments are looked at first; their links make known
    groups. Then all pairs that have a segment in common, keep the Hamming check and are of
    different known groups are looked at. Null and repeated doc_ids are reported as
    ``simhash.near_duplicates`` does.
    """
    spark = docs.sparkSession

    def kept(rows: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, "simhash-" + name)
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    bits, count = segments(docs.count())
    words = -(-max(PRINT, bits * count) // 64)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key(F.col("text")).alias("key"))
    signed = kept(src.mapInArrow(lambda it: _signatures(it, words), SIGNED), "wide")
    nodes = kept(signed.dropDuplicates(["node"]), "nodes")
    filed = nodes.select("node", "n", "print", "small").mapInArrow(lambda it: _filed(it, bits, count), FILED)
    met = kept(filed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meetings, MET), "met")

    prints = nodes.select("node", "n", "print")
    compared = Compared(src, nodes.select("node", "doc_id", "key"))
    some = met.where(f"bucket < 0 or bucket % {count} % {EACH} = 0").join(prints, "node")
    first = some.repartition("bucket", "part").sortWithinPartitions("bucket", "part").mapInArrow(_first_links, "a long, b long").distinct()
    settled = alike(compared, cut(first))
    known = cut(connected_components(settled).withColumnRenamed("component", "known"))

    members = met.join(known, "node", "left").select(F.col("bucket").alias("band"), "node", F.coalesce("known", "node").alias("known"))
    dealt, order = in_pairs(in_blocks(members, block)).join(prints, "node"), ["band", "i", "j"]
    left = cut(dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(lambda it: _pairs(it, bits, count), "a long, b long").distinct())
    links = settled if left.isEmpty() else settled.union(alike(compared, left))
    return name_groups(signed.select("doc_id", "key", "node"), links, "node").select("doc_id", "key", "group", "component_id")
