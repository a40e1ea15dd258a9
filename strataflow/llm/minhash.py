"""The near-dedup of corpora: similarity of 5-word shingles of 0.8 or more.

Fingerprints of 64 bits differ in 5 to 20 bits at that similarity, and no index of segments is
selective with such budgets. MinHash bands find candidates instead: only texts that share a
band are compared. Their SimHash fingerprints go through the pigeonring's chains and the
Hamming check, their sketches have to agree, and whole sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.simhash import SALTS, SEED, Forest, name_groups, ring_chain, text_key
from strataflow.llm.text import slices
from strataflow.operators.components import connected_components
from strataflow.session import cut, scratch_path

SHINGLE = 5
LEAST = 0.8
#: A pair of similarity s shares no band with probability (1 - s^ROWS)^BANDS: 5e-8 at 0.8.
BANDS, ROWS = 32, 4
#: Differing bits of 64 that candidates may have. At a similarity of 0.8 a bit differs with probability 0.16 at most, so that more differ in 3 of 100 million pairs.
BITS = 28
#: With fewer shingles on one side a pair's fingerprints decide nothing.
SMALL_SET = 64
#: Of the BANDS * ROWS smallest hashes' low bytes so many have to agree; at 0.8 fewer do in 2 of 100 million pairs.
AGREE = 76
#: Rows of a band whose sketches meet in a task; larger bands go to pairs of blocks.
BLOCK = 1024
#: Nodes of one hub whose sets meet in a task.
CELL = 512

_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(text: str, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a shorter text is one shingle, a blank one has none."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size)
    digest = xxhash.xxh64_intdigest
    spans = zip((ends - size).tolist(), (ends[width - 1 :] - 1).tolist(), strict=False)
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64))


def set_key(own: np.ndarray) -> int:
    """One signed 64-bit name for a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64))


def sketch(own: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The keys of a set's bands, and the low bytes of its smallest hashes; sets with the same smallest hashes in a band have its key in common."""
    low = np.full(len(_FACTORS), np.iinfo(np.uint32).max, np.uint32)
    short = (own >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(short), 1 << 11):
        low = np.minimum(low, (_FACTORS[:, None] * short[None, a : a + (1 << 11)]).min(axis=1))
    rows = low.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(rows[k].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64), low.astype(np.uint8).tobytes()


def set_print(own: np.ndarray) -> int:
    """The signed 64-bit SimHash of a set of shingles: a bit is 1 if set in over half of them."""
    bits = np.zeros(64, np.int64)
    for a in range(0, len(own), 1 << 14):
        bits += np.unpackbits(own[a : a + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(own), bitorder="little").view(np.int64)[0])


SIGNED = "doc_id long, key long, node long, n int, fp long, low binary, bands array<long>"
SKETCH = ("fp", "n", "low")


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            sets = [shingles(t or "") for t in part.column("text").to_pylist()]
            sketches = [sketch(s) for s in sets]
            keys = np.concatenate([k for k, _ in sketches]) if sets else np.zeros(0, np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32)), pa.array(keys))
            own = [pa.array([f(s) for s in sets], t) for f, t in ((set_key, pa.int64()), (len, pa.int32()), (set_print, pa.int64()))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), *own, pa.array([low for _, low in sketches], pa.binary()), bands], names=["doc_id", "key", "node", "n", "fp", "low", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            sets = [shingles(t or "") for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "hashes"])


def similar(x: np.ndarray, y: np.ndarray, least: float = LEAST) -> bool:
    """Whether two sorted sets have a Jaccard similarity of at least ``least``."""
    small, large = sorted((len(x), len(y)))
    if not small:
        return not large
    if small / large < least:
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return both / (small + large - both) >= least


class Sketches:
    """Fingerprints, sizes and low bytes of a batch's sets."""

    def __init__(self, table: pa.Table | pa.RecordBatch, prefix: str = ""):
        column = lambda c: table.column(prefix + c)
        self.fp, self.n = column("fp").to_numpy().view(np.uint64), column("n").to_numpy().astype(np.int64)
        self.low = np.frombuffer(b"".join(column("low").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)

    def agree(self, i: np.ndarray, other: Sketches, j: np.ndarray) -> np.ndarray:
        """How many low bytes agree in each pair; 0 for pairs that sizes, chains of segments or the Hamming check rule out."""
        small, large = np.minimum(self.n[i], other.n[j]), np.maximum(self.n[i], other.n[j])
        good = small >= LEAST * large
        tested = np.flatnonzero(good & (small >= SMALL_SET))
        x, y = self.fp[i[tested]], other.fp[j[tested]]
        near = ring_chain(x, y, BITS)
        near[near] = np.bitwise_count(x[near] ^ y[near]) <= BITS
        good[tested] = near
        out = np.zeros(len(i), np.int32)
        at = np.flatnonzero(good)
        for k in range(0, len(at), 1 << 14):
            own = at[k : k + (1 << 14)]
            out[own] = (self.low[i[own]] == other.low[j[own]]).sum(axis=1)
        return out


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The given pairs (a, b) that sketches leave."""
    for batch in batches:
        at = np.arange(batch.num_rows)
        keep = Sketches(batch, "a_").agree(at, Sketches(batch, "b_"), at) >= AGREE
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The given pairs (a, b) whose sets are similar."""
    for batch in batches:
        keep = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(batch.column("a_hashes"), batch.column("b_hashes"), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


MEETING = "i long, j long, side int, node long"


def _band_meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which nodes' sets have to meet, in a stream sorted by band and blocks.

    Of the pairs of one band whose known groups differ, those count whose sketches agree and
    that have no earlier band in common. Their nodes are named with the two cells that are to
    meet, so that many pairs between two cells name each node once.
    """

    def meetings(table: pa.Table) -> pa.RecordBatch:
        place, i, j, side, node, known, cell = (table.column(c).to_numpy() for c in ("place", "i", "j", "side", "node", "known", "cell"))
        new = starts_of(table)
        size = np.diff(np.r_[np.flatnonzero(new), len(new)])
        left = np.repeat(np.flatnonzero(new) + size, size) - np.arange(len(new))
        sketches, bands, found = Sketches(table), table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS), []
        for shift in range(1, int(size.max(initial=0))):
            p = np.flatnonzero(left > shift)
            q = p + shift
            p, q = (x[((i[p] == j[p]) | (side[p] != side[q])) & (known[p] != known[q])] for x in (p, q))
            keep = sketches.agree(p, sketches, q) >= AGREE
            p, q = p[keep], q[keep]
            keep = (bands[p] == bands[q]).argmax(axis=1) == place[p]
            found.append(np.stack([p[keep], q[keep]]))
        p, q = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        low, high = np.minimum(cell[p], cell[q]), np.maximum(cell[p], cell[q])
        rows = np.concatenate([np.stack([low, high, (cell[x] != low).astype(np.int64), node[x]], axis=1) for x in (p, q)])
        rows = np.unique(rows, axis=0) if len(rows) else rows
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2].astype(np.int32)), pa.array(rows[:, 3])], names=[c.split()[0] for c in MEETING.split(", ")])

    def starts_of(table: pa.Table) -> np.ndarray:
        new = np.arange(table.num_rows) == 0
        for c in ("band", "i", "j"):
            x = table.column(c).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return new

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        last = int(np.flatnonzero(starts_of(table))[-1])  # its group may go on
        if last:
            yield meetings(table.slice(0, last).combine_chunks())
        held = table.slice(last)
    if held is not None:
        yield meetings(held.combine_chunks())


def _links(table: pa.Table) -> pa.Table:
    """Similar pairs among the sets of one cell, or between two, that join known groups: a spanning forest of all such pairs."""
    side, node = table.column("side").to_numpy(), table.column("node").to_numpy()
    known = np.unique(table.column("known").to_numpy(), return_inverse=True)[1]
    sketches = Sketches(table)
    sets = [np.frombuffer(h, np.uint64) for h in table.column("hashes").to_pylist()]
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if len(two):
        p, q = (x.ravel() for x in np.meshgrid(one, two, indexing="ij"))
    else:
        p, q = (one[x] for x in np.triu_indices(len(one), 1))
    p, q = p[known[p] != known[q]], q[known[p] != known[q]]
    agree = sketches.agree(p, sketches, q)
    order = np.argsort(-agree, kind="stable")
    order = order[agree[order] >= AGREE]
    forest, found = Forest(int(known.max(initial=-1)) + 1), []
    # the likeliest first: pairs of groups that a link has joined needn't be looked at
    for x, y in zip(p[order].tolist(), q[order].tolist(), strict=True):
        if forest.root(known[x]) != forest.root(known[y]) and similar(sets[x], sets[y]):
            forest.join(known[x], known[y])
            found.append((int(node[x]), int(node[y])))
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


class Compared:
    """Compares pairs of nodes: sketches first, whole sets for those that they leave."""

    def __init__(self, texts: DataFrame, nodes: DataFrame):
        #: texts by key and doc_id, and a row for each node with its sketch and one of its texts' keys and ids
        self.texts, self.nodes = texts, nodes

    def attach(self, pairs: DataFrame, frame: DataFrame, end: str, other: str, columns: tuple[str, ...]) -> DataFrame:
        """``pairs`` with ``columns`` of ``frame`` for ``end``, prefixed by it. An end may be in many pairs: its row goes to the parts that its partners are in."""
        salted = pairs.withColumn("salt", F.pmod(F.hash(other), F.lit(SALTS)))
        rows = salted.select(end, "salt").distinct().join(frame.select(F.col("node").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns]), end)
        return salted.join(rows.hint("merge"), [end, "salt"]).drop("salt")

    def likely(self, pairs: DataFrame) -> DataFrame:
        for end, other in (("a", "b"), ("b", "a")):
            pairs = self.attach(pairs, self.nodes, end, other, SKETCH)
        return cut(pairs.mapInArrow(_likely, "a long, b long"))

    def sets(self, inside: DataFrame) -> DataFrame:
        """(node, hashes) of the nodes ``inside``, made of their texts and of these alone."""
        spark = inside.sparkSession
        chosen = self.nodes.join(inside, "node", "left_semi").select(F.col("key").alias("own"), F.col("doc_id").alias("its"))
        path, schema = scratch_path(spark, "minhash-sets"), "node long, hashes binary"
        # rows that are repeated give their set again, which repeats comparisons and no more
        own = (self.texts["key"] == chosen["own"]) & self.texts["doc_id"].eqNullSafe(chosen["its"])
        self.texts.join(chosen, own, "left_semi").select("text").mapInArrow(_sets, schema).write.parquet(path)
        return spark.read.schema(schema).parquet(path)

    def similar(self, pairs: DataFrame) -> DataFrame:
        """The similar ones of (a, b)."""
        sets = self.sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        for end, other in (("a", "b"), ("b", "a")):
            pairs = self.attach(pairs, sets, end, other, ("hashes",))
        return cut(pairs.mapInArrow(_similar, "a long, b long"))

    def links(self, meetings: DataFrame, known: DataFrame) -> DataFrame:
        """The links (a, b) that join known groups, of the cells that ``meetings`` brings together."""
        sets = self.sets(meetings.select("node").distinct())
        rows = meetings.join(known, "node", "left").withColumn("known", F.coalesce("known", "node"))
        rows = rows.join(self.nodes.select("node", *SKETCH), "node").join(sets, "node").select("i", "j", "side", "node", "known", *SKETCH, "hashes")
        return cut(rows.groupBy("i", "j").applyInArrow(_links, "a long, b long"))


def in_blocks(members: DataFrame, block: int) -> DataFrame:
    """``members`` (band, node, known) of the bands with more than one ``known``, dealt to blocks ``own`` that meet all others up to ``last``.

    Blocks of the largest known group come last and meet those of the rest alone.
    """
    counts = members.groupBy("band", "known").agg(F.count("*").alias("n")).groupBy("band").agg(F.max(F.struct("n", "known")).alias("l"), F.sum("n").alias("n"))
    # blocks of the rest come first, then those of the largest known group
    mixed = counts.where("l.n < n").select("band", F.col("l.known").alias("large"), F.ceil((F.col("n") - F.col("l.n")) / block).cast("int").alias("rest"), F.ceil(F.col("l.n") / block).cast("int").alias("bulk"))
    mixed = mixed.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    members = members.withColumn("salt", F.pmod(F.hash("node"), F.lit(SALTS))).join(mixed.hint("merge"), ["band", "salt"]).drop("salt")
    inside, lot = F.col("known") == F.col("large"), F.xxhash64("node", F.lit(7))
    dealt = members.withColumn("own", F.when(inside, F.col("rest") + F.pmod(lot, F.col("bulk"))).otherwise(F.pmod(lot, F.col("rest"))).cast("int"))
    return dealt.withColumn("last", F.when(inside, F.col("rest") - 1).otherwise(F.col("rest") + F.col("bulk") - 1)).drop("large", "rest", "bulk")


def in_pairs(dealt: DataFrame) -> DataFrame:
    """Rows of ``in_blocks`` once for each pair (i, j) of blocks that theirs is in, with the side that they are on."""
    each = dealt.select("*", F.explode(F.expr("sequence(0, last)")).alias("other"))
    return each.select(*[c for c in dealt.columns if c not in ("own", "last")], F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))


def across(keyed: DataFrame, known: DataFrame, nodes: DataFrame, block: int) -> DataFrame:
    """``MEETING`` rows for the nodes that share a band (``keyed``: node, band, place), lie in different ``known`` groups and whose sketches agree.

    ``nodes`` has node, its cell, its sketch and bands. Of a band, the nodes outside its
    largest known group meet all others, in pairs of blocks, so that a band of copies costs as
    many comparisons as it has members times those outside.
    """
    members = keyed.join(known, "node", "left").select("band", "place", "node", F.coalesce("known", "node").alias("known"))
    dealt = in_pairs(in_blocks(members, block).join(nodes.select("node", "cell", *SKETCH, "bands"), "node"))
    dealt = dealt.select("band", "place", "i", "j", "side", "node", "known", "cell", *SKETCH, "bands")
    order = ["band", "i", "j"]
    return dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(_band_meetings, MEETING).distinct()


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, key (the text's), group and component_id (the smallest doc_id reachable over pairs of similarity ``LEAST`` or more) of every row.

    Rows with one set of shingles are one node. First each node is compared with one hub, the
    smallest node of a band, of its hubs the one that it shares most bands with; the links
    make known groups. Then all pairs that share a band and whose known groups differ are
    looked at by their sketches, and what these leave by whole sets. For that the nodes of one
    hub are dealt to cells; two cells meet where a pair between them is left, with the nodes of
    such pairs alone, so that neither pairs nor all members of a group become rows. Null and
    repeated doc_ids are reported as ``simhash.near_duplicates`` does.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key(F.col("text")).alias("key"))
    path = scratch_path(spark, "minhash-signatures")
    src.mapInArrow(_signatures, SIGNED).write.parquet(path)
    signed = spark.read.schema(SIGNED).parquet(path)
    path = scratch_path(spark, "minhash-nodes")
    signed.dropDuplicates(["node"]).select("node", "doc_id", "key", *SKETCH, "bands").write.parquet(path)
    nodes = spark.read.parquet(path)
    keyed = nodes.select("node", F.posexplode("bands").alias("place", "band"))
    # a band may be that of many nodes: its smallest one is sent to SALTS parts
    keyed = keyed.withColumn("salt", F.pmod(F.hash("node"), F.lit(SALTS)))
    hubs = keyed.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").select("band", "hub", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    path = scratch_path(spark, "minhash-shared")
    keyed.join(hubs.hint("merge"), ["band", "salt"]).select("node", "band", "place", "hub").write.parquet(path)
    keyed = spark.read.parquet(path)
    best = keyed.where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("shared")).groupBy("node").agg(F.max(F.struct("shared", "hub")).alias("b"))
    best = cut(best.select("node", F.col("b.hub").alias("hub")))
    compared = Compared(src, nodes)
    settled = compared.similar(compared.likely(best.select(F.col("node").alias("a"), F.col("hub").alias("b"))))
    known = cut(connected_components(settled).withColumnRenamed("component", "known"))

    # a hub that follows no other is with its followers; a hub may have any share of the nodes
    cells = best.groupBy("hub").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cells")).select("hub", "cells", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    placed = best.withColumn("salt", F.pmod(F.hash("node"), F.lit(SALTS))).join(cells.hint("merge"), ["hub", "salt"]).select("node", "hub", F.pmod(F.xxhash64("node", F.lit(9)), F.col("cells")).alias("own"))
    placed = nodes.select("node", *SKETCH, "bands").join(placed, "node", "left").select("node", F.xxhash64(F.coalesce("hub", "node"), F.coalesce("own", F.lit(0).cast("long"))).alias("cell"), *SKETCH, "bands")
    left = cut(across(keyed.select("node", "band", "place"), known, placed, block))
    named_by = lambda edges: name_groups(signed.select("doc_id", "key", "node"), edges, "node").select("doc_id", "key", "group", "component_id")
    if left.isEmpty():
        return named_by(settled)
    return named_by(settled.union(compared.links(left, known)))
