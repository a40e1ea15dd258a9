"""Best-fit packing of token sequences by large-item matching."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.text import default_tokenizer, slices, token_ids
from strataflow.session import scratch_path

CAPACITY = 4096
END_ID = 1
#: Documents of a packing shard, on average. Each shard leaves about one sequence part-filled.
SHARD_DOCS = 16_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int], int]:
    """Bin and offset of each item, and the number of bins.

    Items above a third of the capacity share a bin with at most one other such item: the
    largest is matched with the largest that still fits beside it. The rest, in falling
    order, go to the fullest bin with room for them, or to a new bin.
    """
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    used: list[int] = []
    large = [i for i in order if lengths[i] * 3 > capacity]
    rising = large[::-1]
    sizes = [lengths[i] for i in rising]
    free = [True] * len(rising)
    prev = list(range(-1, len(rising) - 1))  # next free item downwards, with path compression

    def down(j: int) -> int:
        seen = []
        while j >= 0 and not free[j]:
            seen.append(j)
            j = prev[j]
        for s in seen:
            prev[s] = j
        return j

    for j in range(len(rising) - 1, -1, -1):
        if not free[j]:
            continue
        free[j] = False
        i = rising[j]
        bins[i], offsets[i] = len(used), 0
        used.append(lengths[i])
        mate = down(min(j, bisect.bisect_right(sizes, capacity - lengths[i])) - 1)
        if mate >= 0:
            free[mate] = False
            m = rising[mate]
            bins[m], offsets[m] = len(used) - 1, used[-1]
            used[-1] += lengths[m]
    rooms: dict[int, list[int]] = {}
    for b in range(len(used) - 1, -1, -1):
        rooms.setdefault(capacity - used[b], []).append(b)
    levels = sorted(rooms)
    for i in order[len(large) :]:
        size = lengths[i]
        at = bisect.bisect_left(levels, size)
        if at == len(levels):
            b = len(used)
            used.append(0)
        else:
            room = levels[at]
            b = rooms[room].pop()
            if not rooms[room]:
                del rooms[room], levels[at]
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        left = capacity - used[b]
        if left not in rooms:
            rooms[left] = []
            bisect.insort(levels, left)
        rooms[left].append(b)
    return bins, offsets, len(used)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    row = 0
    for batch in batches:
        for part in slices(batch):
            ids, offsets = token_ids(part.column("text"), path, end_id)
            docs = part.column("doc_id").to_pylist()
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "salt")}
            blobs = []
            raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
            for d, a, b in zip(docs, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                for k, s in enumerate(range(0, b - a, capacity)):
                    e = min(b - a, s + capacity)
                    bits = raw[4 * (a + s) : 4 * (a + e)]
                    for c, v in zip(out, (d, k, s, e - s, zlib.crc32(bits), row), strict=True):
                        out[c].append(v)
                    if keep_ids:
                        blobs.append(bytes(bits))
                row += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            cols = [pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(blobs, pa.binary())] * keep_ids, names=[*out] + ["ids"] * keep_ids)


def pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32, salt.

    A null text is empty and has the end id alone; only documents of over ``capacity`` ids
    are cut. ``keep_ids`` adds the piece's ids as little-endian unsigned 32-bit integers.
    ``salt`` is the document's place in its task; it deals repeated rows to different shards.
    """
    path = tokenizer_path or default_tokenizer()
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(lambda it: _pieces(it, path, capacity, end_id, keep_ids), PIECES + (", ids binary" if keep_ids else ""))


def _pack_shard(key, table: pa.Table, capacity: int) -> pa.Table:
    # the same rows in any order get the same places
    table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("salt", "ascending")])
    bins, offsets, _ = pack(table.column("length").to_pylist(), capacity)
    first = key[0].as_py() << 32
    ids = pa.array(np.array(bins, dtype=np.int64) + first, pa.int64())
    return table.select(["doc_id", "piece", "start", "length", "ids_crc32"]).append_column("sequence_id", ids).append_column("offset", pa.array(offsets, pa.int64()))


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Where each piece of each document lies in the packed sequences.

    Pieces are dealt by hash to shards of about ``shard_docs`` documents; each shard is
    packed on its own by ``pack``, so the number of shards follows the input and no task
    holds more than its shard's lengths (the ids don't travel). ``sequence_id`` is the shard
    times 2^32 plus the bin. Repeated rows are packed as often as they occur, a null doc_id
    is kept, an empty table gives no rows.
    """
    shards = max(1, -(-docs.count() // shard_docs))
    got = pieces(docs, tokenizer_path, capacity, end_id)
    got = got.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "salt", "ids_crc32"), F.lit(shards)))
    return got.groupBy("shard").applyInArrow(lambda key, t: _pack_shard(key, t, capacity), PLACED)


def _pack_rows(key, table: pa.Table, capacity: int) -> pa.Table:
    """As ``_pack_shard``, with the pieces' ``salt``, which tells all of them apart."""
    table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("salt", "ascending")])
    return _pack_shard(key, table, capacity).append_column("salt", table.column("salt"))


def sequences(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The packed sequences themselves: sequence_id, length and ids (little-endian unsigned 32-bit).

    The pieces are written once with a number of their own, packed without their ids, and
    meet these again by number, so that rows with one id, or none, keep their own texts. A
    sequence holds at most ``capacity`` ids, so its pieces fit any task.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "packing-pieces")
    pieces(docs, tokenizer_path, capacity, end_id, keep_ids=True).withColumn("salt", F.monotonically_increasing_id()).write.parquet(path)
    held = spark.read.schema(PIECES + ", ids binary").parquet(path)
    shards = max(1, -(-held.where("piece = 0").count() // shard_docs))
    dealt = held.drop("ids").withColumn("shard", F.pmod(F.xxhash64("salt"), F.lit(shards)))
    placed = dealt.groupBy("shard").applyInArrow(lambda key, t: _pack_rows(key, t, capacity), PLACED + ", salt long")
    both = placed.select("sequence_id", "offset", "length", "salt").join(held.select("salt", "ids"), "salt")
    return both.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")).select("sequence_id", "length", F.expr("aggregate(parts, X'', (s, p) -> concat(s, p.ids))").alias("ids"))
