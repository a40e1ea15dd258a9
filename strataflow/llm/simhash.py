"""SimHash near-duplicates with pigeonring candidate filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.llm.sql import unused
from strataflow.llm.text import slices
from strataflow.operators.components import connected_components
from strataflow.session import scratch_path

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: Fingerprints of one key that a task compares at once; larger keys go to block pairs.
BLOCK = 4096
#: Keys up to this size are compared together, pair by pair.
SMALL = 64

#: Parts into which a component's fingerprints are dealt where its smallest doc_id meets them.
SALTS = 32


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text, as an unsigned integer."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(size)
        starts = (ends - size).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=False)]
    bits = np.zeros(64, np.int64)
    whole = np.array(hashes, dtype="<u8")
    for a in range(0, len(whole), 1 << 14):
        part = whole[a : a + (1 << 14)]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(whole), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            prints = np.array([fingerprint(t or "", width) for t in part.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of each row; null or blank texts have 0."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(lambda it: _fingerprints(it, width), "doc_id long, fp long")


# --- pairs ------------------------------------------------------------------------------


def bounds(most: int) -> list[int]:
    """Ends of the ring's segments: one segment more than differing bits, so that a chain's budget of l segments is l - 1 bits."""
    return [round(64 * k / (most + 1)) for k in range(most + 2)]


def segments_of(diff: np.ndarray, ends: list[int]) -> list[np.ndarray]:
    """Differing bits in each segment."""
    return [np.bitwise_count((diff >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)).astype(np.int16) for a, b in zip(ends, ends[1:], strict=False)]


def chain_from(x: np.ndarray, y: np.ndarray, start: int | np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Whether the chain that begins at segment ``start`` of the ring keeps within its proportional budgets.

    With m segments that differ in d(0..m-1) bits and a total of at most ``most``, some start
    s has d(s) + ... + d(s+l-1) <= l * most / m for every length l. With most + 1 segments
    these budgets are 0, 1, 2, ... bits.
    """
    ends = bounds(most)
    d, m = np.stack(segments_of(x ^ y, ends)), most + 1
    total, good = np.zeros(x.shape, np.int16), np.ones(x.shape, bool)
    for k in range(m - 1):
        at = (start + k) % m
        total += d[at] if np.isscalar(at) else np.take_along_axis(d, np.broadcast_to(at, x.shape)[None], 0)[0]
        good &= total <= k
    return good


def ring_chain(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Whether any start of a ring of eight segments has a chain within its budgets; all pairs at most ``most`` bits apart have."""
    d = segments_of(x ^ y, list(range(0, 65, 8)))
    found = np.zeros(x.shape, bool)
    for s in range(8):
        total, good = np.zeros(x.shape, np.int16), np.ones(x.shape, bool)
        for k in range(7):
            total = total + d[(s + k) % 8]
            good &= total * 8 <= (k + 1) * most
        found |= good
    return found


#: What filing a fingerprint under one more key costs (a row shuffled and sorted), in comparisons of two fingerprints.
KEY_COST = 64


def chain_masks(most: int = MAX_BITS, depth: int = 2) -> list[int]:
    """The masks of a fingerprint's index keys, equally many for each start of the ring.

    A viable chain has no differing bit in its first segment and at most ``depth - 1`` in the
    ``depth - 1`` segments behind it. Of the halves of these, twice as many as there may be
    bits, ``depth - 1`` are equal too: a key is the first segment and one choice of that many
    halves. A depth of 2, 3 or 4 gives 2, 6 or 20 keys for each start, of 19, 25 or 32 bits at
    four differing bits.
    """
    ends = bounds(most)
    bits = lambda a, b: ((1 << b) - 1) ^ ((1 << a) - 1)
    if most == 0:
        return [(1 << 64) - 1]
    behind = min(depth - 1, most)
    out = []
    for s in range(most + 1):
        halves = []
        for n in ((s + k) % (most + 1) for k in range(1, behind + 1)):
            half = (ends[n] + ends[n + 1]) // 2
            halves += [bits(ends[n], half), bits(half, ends[n + 1])]
        out += [bits(ends[s], ends[s + 1]) | sum(chosen) for chosen in combinations(halves, behind)]
    return out


def key_depth(fingerprints: int, most: int = MAX_BITS) -> int:
    """How far along the chain the keys reach for so many fingerprints: the depth, up to 4, of the least work.

    Work is what each fingerprint's keys cost to file, and to compare with the unlike ones that
    share a key. Any depth finds the same links.
    """

    def work(depth: int) -> float:
        masks = chain_masks(most, depth)
        return sum(KEY_COST + fingerprints / 2.0 ** (m.bit_count() + 1) for m in masks)

    return min(range(2, 5), key=work)


def near(x: np.ndarray, y: np.ndarray, start: int | np.ndarray, most: int) -> np.ndarray:
    """Whether pairs are at most ``most`` bits apart, of those with a viable chain from ``start``."""
    good = chain_from(x, y, start, most)
    good[good] = np.bitwise_count(x[good] ^ y[good]) <= most
    return good


class Forest:
    """Trees over positions; ``join`` tells whether a link joins two trees."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        u, v = self.root(i), self.root(j)
        self.parent[max(u, v)] = min(u, v)
        return u != v


def links(prints: np.ndarray, start: int, most: int = MAX_BITS, others: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among ``prints`` (and ``others``) with a chain from ``start``, as positions in their row.

    Of the pairs it returns those that join two trees, so that the connected groups are those
    of all links and no group is spelt out in pairs. With ``others`` only the pairs between
    the two sides are looked at.
    """
    both = prints if others is None else np.concatenate([prints, others])
    forest, out = Forest(len(both)), []
    step = max(1, (1 << 20) // max(1, len(both)))
    for a in range(0, len(prints), step):
        rows = np.arange(a, min(len(prints), a + step))
        cols = np.arange(a + 1, len(prints)) if others is None else np.arange(len(prints), len(both))
        if not len(cols):
            continue
        x, y = np.broadcast_arrays(both[rows][:, None], both[cols][None, :])
        i, j = np.nonzero(near(x, y, start, most))
        i, j = rows[i], cols[j]
        out += [(p, q) for p, q in zip(i[i < j].tolist(), j[i < j].tolist(), strict=True) if forest.join(p, q)]
    return np.array([p for p, _ in out], dtype=np.int64), np.array([q for _, q in out], dtype=np.int64)


EDGE = "a long, b long, bucket long, start int"


def _edge_batch(a: np.ndarray, b: np.ndarray, bucket: np.ndarray | None = None, start: np.ndarray | None = None) -> pa.RecordBatch:
    rest = [pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int32())] if bucket is None else [pa.array(bucket), pa.array(start)]
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), *rest], names=["a", "b", "bucket", "start"])


def _small_buckets(batches: Iterator[pa.RecordBatch], most: int, block: int) -> Iterator[pa.RecordBatch]:
    """Links in each bucket of a stream sorted by bucket; a bucket of over ``block`` passes through with its key."""
    key, fp, start = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    large = None  # the key of a bucket that is passing through

    def done(key: np.ndarray, fp: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        # pairs of small buckets by their distance in the stream, all buckets at once
        left = np.repeat(starts + sizes, sizes) - np.arange(len(key))  # rows of the bucket from here on
        left[np.repeat(sizes > SMALL, sizes)] = 0
        u = fp.view(np.uint64)
        pairs = []
        for shift in range(1, SMALL):
            i = np.flatnonzero(left > shift)
            if not len(i):
                break
            good = near(u[i], u[i + shift], start[i], most)
            pairs.append(np.stack([i[good], i[good] + shift]))
        found = np.concatenate(pairs, axis=1).T.tolist() if pairs else []
        forest = Forest(len(key)) if found else None
        found = [(i, j) for i, j in found if forest.join(i, j)]
        for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            i, j = links(u[s : s + n], int(start[s]), most)
            found += list(zip((i + s).tolist(), (j + s).tolist(), strict=True))
        both = np.array(found, dtype=np.int64).reshape(-1, 2)
        yield _edge_batch(fp[both[:, 0]], fp[both[:, 1]])

    for batch in batches:
        k, f, s = (batch.column(c).to_numpy() for c in ("bucket", "fp", "start"))
        if large is not None:
            own = k == large
            yield _edge_batch(f[own], f[own], k[own], s[own])
            k, f, s = k[~own], f[~own], s[~own]
            if not len(k):
                continue
            large = None
        key, fp, start = np.concatenate([key, k]), np.concatenate([fp, f]), np.concatenate([start, s])
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))
        # the last bucket may go on in the next batch
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        big = np.repeat(sizes > block, sizes)
        head = np.arange(len(key)) < cut
        if (big & head).any():
            yield _edge_batch(fp[big & head], fp[big & head], key[big & head], start[big & head])
        if (head & ~big).any():
            yield from done(key[head & ~big], fp[head & ~big], start[head & ~big])
        key, fp, start = key[cut:], fp[cut:], start[cut:]
        if len(key) > block:
            large = int(key[-1])
            yield _edge_batch(fp, fp, key, start)
            key, fp, start = key[:0], fp[:0], start[:0]
    if len(key):
        yield from done(key, fp, start)


def _block_pair(table: pa.Table, most: int) -> pa.Table:
    side = table.column("side").to_numpy()
    order = np.lexsort((table.column("fp").to_numpy(), side))
    side, fp = side[order], table.column("fp").to_numpy()[order]
    x, y = fp[side == 0], fp[side == 1]
    both = np.concatenate([x, y])
    i, j = links(x.view(np.uint64), table.column("start")[0].as_py(), most, y.view(np.uint64) if len(y) else None)
    return pa.Table.from_batches([_edge_batch(both[i], both[j])])


def chain_keys(distinct: DataFrame, most: int = MAX_BITS, depth: int = 2) -> DataFrame:
    """(bucket, fp, start) of the distinct fingerprints ``fp``, a row for each of ``chain_masks``: ten at four bits and a depth of 2."""
    signed = [m - (1 << 64) if m >> 63 else m for m in chain_masks(most, depth)]
    each = len(signed) // (most + 1)
    choice = F.posexplode(F.array(*[F.lit(m) for m in signed]))
    keyed = distinct.select("fp", choice.alias("k", "mask"))
    # a 64-bit hash may put two keys together, which adds comparisons but no link
    return keyed.select(F.xxhash64(F.col("fp").bitwiseAND(F.col("mask")), "k").alias("bucket"), "fp", F.floor(F.col("k") / each).cast("int").alias("start"))


def fingerprint_links(distinct: DataFrame, most: int = MAX_BITS, block: int = BLOCK, depth: int = 2) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` that give the groups of all links.

    The ring's chains are the index: each fingerprint is filed under the first segment of
    every start, with halves of the segments behind it as far as ``depth`` reaches, and only
    fingerprints of one key are led along the chain from that start; those that keep its budgets get the Hamming check. Keys are
    compared in sorted streams; those with more than ``block`` rows are dealt to pairs of
    blocks instead, with every pair of blocks compared.
    """
    spark = distinct.sparkSession
    stream = chain_keys(distinct, most, depth).repartition("bucket").sortWithinPartitions("bucket")
    path = scratch_path(spark, "simhash-links")
    stream.mapInArrow(lambda it: _small_buckets(it, most, block), EDGE).write.parquet(path)
    got = spark.read.schema(EDGE).parquet(path)
    edges = got.where("bucket is null").select("a", "b").distinct()
    large = got.where("bucket is not null").select("bucket", F.col("a").alias("fp"), "start")
    if large.isEmpty():
        return edges
    blocks = large.groupBy("bucket").count().select("bucket", F.ceil(F.col("count") / block).cast("int").alias("n"))
    dealt = large.join(blocks, "bucket").withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("n")).cast("int"))
    pairs = dealt.select("bucket", "fp", "start", "own", F.explode(F.expr("sequence(0, n - 1)")).alias("other"))
    pairs = pairs.select("bucket", "fp", "start", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))
    more = pairs.groupBy("bucket", "i", "j").applyInArrow(lambda t: _block_pair(t, most), EDGE).select("a", "b")
    return edges.union(more).distinct()


def name_groups(rows: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """``rows`` with ``group`` (the smallest node of its component) and ``component_id`` (the component's smallest doc_id).

    ``rows`` has doc_id and ``node``; ``edges`` are links (a, b) between nodes. A component may
    hold many nodes: its smallest doc_id is sent to SALTS parts among which they are dealt.
    """
    nodes = rows.groupBy(node).agg(F.min("doc_id").alias("first"))
    linked = connected_components(edges).withColumnRenamed("node", "__node")
    named = nodes.join(linked, nodes[node] == linked["__node"]).select(node, "first", "component", F.pmod(F.hash(node), F.lit(SALTS)).alias("salt"))
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id")).select("component", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # repeated parts look small once compressed, so that join isn't left to a broadcast
    many = named.join(lowest.hint("merge"), ["component", "salt"]).select(node, F.col("component").alias("group"), "component_id")
    single = nodes.join(linked, nodes[node] == linked["__node"], "left_anti").select(node, F.col(node).alias("group"), F.col("first").alias("component_id"))
    return rows.join(many.unionByName(single), node)


def near_duplicates(docs: DataFrame, width: int = SHINGLE, most: int = MAX_BITS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) of every row.

    Rows with one fingerprint are one node, so copies are never expanded into pairs. A null
    doc_id is reported as is and never names a component that has another id; a repeated row
    is reported as often as it occurs; an empty table gives no rows.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "simhash-prints")
    fingerprints(docs, width).write.parquet(path)
    prints = spark.read.schema("doc_id long, fp long").parquet(path)
    links = fingerprint_links(prints.select("fp").distinct(), most, depth=key_depth(prints.count(), most))
    return name_groups(prints, links, "fp").select("doc_id", "fp", "component_id")


def text_key(text: Column) -> Column:
    """The address of a row's text; a null text has its own."""
    return F.xxhash64(text.cast("string"), text.isNull())


def representatives(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: that of its smallest doc_id, a null doc_id after all others.

    ``found`` has doc_id, ``key`` (the ``text_key``) and ``group`` of every row. Rows are told
    apart by doc_id and text together: rows that repeat an id with texts of different groups
    all stay, and of a group's rows with one id and different texts that of the smallest key
    stays. Of rows with the same id and text, one stays.
    """
    counted = found.groupBy("group", "doc_id", "key").agg(F.count("*").alias("n"))
    best = counted.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "n")).alias("f"))
    lead, address, rows, own = unused(docs, "__id", "__key", "__rows", "__own")
    best = best.select(F.col("f.doc_id").alias(lead), F.col("f.key").alias(address), F.col("f.n").alias(rows))
    keyed = docs.withColumn(own, text_key(docs["text"]))
    kept = keyed.join(best, keyed["doc_id"].eqNullSafe(best[lead]) & (keyed[own] == best[address]))
    single = kept.where(F.col(rows) == 1).select(*docs.columns)
    if best.where(F.col(rows) > 1).isEmpty():
        return single
    again = kept.where(F.col(rows) > 1).dropDuplicates([lead, address]).select(*docs.columns)
    return single.unionByName(again)
