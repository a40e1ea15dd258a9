"""The prefix trie of conversations, with subtree totals by parallel tree contraction."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.llm.sql import INK
from strataflow.session import cut, scratch_path

#: A prefix is named by four residues: its turns' digests in Horner form, modulo a prime below 2^31.
PRIME = np.int64((1 << 31) - 1)
SEED = 13
BASES = np.random.default_rng(SEED).integers(1 << 20, int(PRIME) - 1, 4)
INVERSES = np.array([pow(int(b), -1, int(PRIME)) for b in BASES])
#: Turns of one conversation that meet their conversation's row in one part, and turns of a sorted partition.
RUN, PARTITION_ROWS = 100_000, 500_000
#: Signs of a text by which rows of one turn and role are ordered; beyond them its digest decides.
LEAD = 16
#: Ids of a piece of a list that is to be hashed.
PIECE = 1 << 16

STATES = "pid int, conv_id long, p long, s1 long, s2 long, h1 long, h2 long, words long"
SETTLED = "conv_id long, p long, s1 long, s2 long, h1 long, h2 long, words long"
STEPS = "conv_id long, depth long, k1 long, k2 long, p1 long, p2 long, words long, last boolean"
KEY = ["depth", "k1", "k2"]
ROOT = -1
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


# --- names of prefixes ---


def residues(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Four residues of each row, from two longs that hold two each."""
    a, b = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
    return np.stack([a >> 31, a & PRIME, b >> 31, b & PRIME], axis=1)


def longs(r: np.ndarray) -> list[pa.Array]:
    return [pa.array(r[:, 0] << 31 | r[:, 1]), pa.array(r[:, 2] << 31 | r[:, 3])]


def powers(base: np.ndarray, exponents: np.ndarray) -> np.ndarray:
    """Each base to each exponent, modulo the prime: a row for each exponent."""
    out, square = np.ones((len(exponents), 4), np.int64), base.astype(np.int64)
    for bit in range(int(exponents.max(initial=0)).bit_length()):
        out = np.where((exponents >> bit & 1)[:, None] == 1, out * square % PRIME, out)
        square = square * square % PRIME
    return out


def running(digests: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The state after each row: the digests from row ``start`` of it to itself, in Horner form."""
    at = np.arange(len(digests))
    total = np.cumsum(digests * powers(INVERSES, at) % PRIME, axis=0) % PRIME
    before = np.where(start[:, None] > 0, total[start - 1], 0)
    return (total - before) % PRIME * powers(BASES, at) % PRIME


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers and states of sorted turns within their conversation's part of this partition."""
    pid, last, count, state = TaskContext.get().partitionId(), None, 0, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv = batch.column("conv_id").to_numpy()
        start = np.maximum.accumulate(np.where(np.r_[True, conv[1:] != conv[:-1]], np.arange(n), 0))
        own, p = running(residues(batch.column("h1"), batch.column("h2")), start), np.arange(n) - start + 1
        if last == conv[0]:
            same = start == 0
            own[same] = (own[same] + state * powers(BASES, p[same])) % PRIME
            p[same] += count
        last, count, state = conv[-1], p[-1], own[-1]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, pid, np.int32)), batch.column("conv_id"), pa.array(p), *longs(own), *(batch.column(c) for c in ("h1", "h2", "words"))], names=[c.split()[0] for c in STATES.split(", ")])


def _settle(batches: Iterator[pa.RecordBatch], carried: dict[tuple[int, int], tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Adds what a conversation's earlier partitions hold."""
    by_pid: dict[int, list[int]] = {}
    for pid, conv in carried:
        by_pid.setdefault(pid, []).append(conv)
    for batch in batches:
        pids, conv, p = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("pid", "conv_id", "p"))
        own, place = residues(batch.column("s1"), batch.column("s2")), p.copy()
        for pid in np.unique(pids).tolist():
            for c in by_pid.get(pid, ()):
                same, (before, state) = (pids == pid) & (conv == c), carried[pid, c]
                own[same] = (own[same] + state * powers(BASES, p[same])) % PRIME
                place[same] += before
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(place), *longs(own), *(batch.column(c) for c in ("h1", "h2", "words"))], names=[c.split()[0] for c in SETTLED.split(", ")])


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, the text's first LEAD signs, the digest of both (120 bits in two longs) and the text's words, of all rows with a conv_id."""
    own = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    own = own.withColumn("md5", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    # 15 hex digits are 60 bits, 30 for each of two residues
    bits = lambda at: F.conv(F.substring("md5", at, 15), 16, 10).cast("long")
    spread = lambda x: F.shiftleft(F.shiftright(x, 30), 31).bitwiseOR(x.bitwiseAND(F.lit((1 << 30) - 1)))
    return own.select("conv_id", "turn", "role", F.substring("text", 1, LEAD).alias("start"), spread(bits(1)).alias("h1"), spread(bits(16)).alias("h2"), F.regexp_count("text", F.lit(INK + "+")).cast("long").alias("words"))


def settled_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, p (the turn's place, from 1), state and digest, and words of every turn.

    Turns are sorted by range and numbered and summed up within partitions; a conversation
    that goes over several of them carries its earlier partitions' counts and states along,
    as states of neighbouring parts add up. Equal turns go by role, then by the text's first
    LEAD signs and its digest; only rows that are equal in all are ordered by where they lie.
    """
    spark = conversations.sparkSession
    path = scratch_path(spark, "trie-turns")
    digests(conversations).withColumn("lies", F.monotonically_increasing_id()).write.parquet(path)
    turns = spark.read.parquet(path)
    order = ["conv_id", "turn", "role", "start", "h1", "h2", "lies"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + turns.count() // PARTITION_ROWS)
    path = scratch_path(spark, "trie-states")
    turns.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_states, STATES).write.parquet(path)
    states = spark.read.schema(STATES).parquet(path)
    runs = states.groupBy("conv_id", "pid").agg(F.max(F.struct("p", "s1", "s2")).alias("end"))
    # at most two conversations of a partition lie in others as well
    wide = runs.groupBy("conv_id").agg(F.collect_list(F.struct("pid", "end")).alias("runs")).where("size(runs) > 1").collect()
    carried = {}
    for r in wide:
        count, state = 0, np.zeros(4, np.int64)
        for pid, end in sorted(r.runs):
            if count:
                carried[pid, r.conv_id] = (count, state)
            own = residues(pa.array([end.s1]), pa.array([end.s2]))[0]
            state = (state * powers(BASES, np.array([end.p]))[0] + own) % PRIME
            count += end.p
    return states.mapInArrow(lambda it: _settle(it, carried), SETTLED) if carried else states.drop("pid")


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Depth and names of rebuilt turns: their conversation's state before it took its own turns goes under their own."""
    for batch in batches:
        p, skip, lead, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("p", "skip", "lead", "n_all"))
        own, digest, under, less = (residues(batch.column(x + "1"), batch.column(x + "2")) for x in ("s", "h", "g", "o"))
        state = ((under - less) % PRIME * powers(BASES, p - skip) + own) % PRIME
        parent = (state - digest) % PRIME * INVERSES % PRIME
        depth = p - skip + lead
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(depth), *longs(state), *longs(parent), batch.column("words"), pa.array(depth == n)], names=[c.split()[0] for c in STEPS.split(", ")])


def steps(conversations: DataFrame, base: Column | None, head: Column | None, most_head: int) -> tuple[DataFrame, DataFrame]:
    """A row for each turn of each rebuilt conversation (its depth, its prefix' name and its parent's), and conv_id and n_all of all conversations."""
    turns = settled_turns(conversations)
    state = F.struct("p", "s1", "s2", "h1", "h2", "words")
    convs = turns.groupBy("conv_id").agg(F.max("p").alias("n"), F.array_sort(F.collect_list(F.when(F.col("p") <= most_head, state))).alias("heads"))
    convs = cut(convs.withColumn("base", F.lit(None).cast("long") if base is None else base).withColumn("skip", (F.lit(0) if head is None else head).cast("long")))
    lender = convs.select(F.col("conv_id").alias("base"), F.slice("heads", 1, most_head).alias("lent"))
    convs = convs.join(lender, "base", "left").withColumn("lead", F.when(F.col("lent").isNull(), 0).otherwise(F.least("skip", F.size("lent"))).cast("long"))
    convs = convs.withColumn("n_all", F.col("lead") + F.greatest(F.lit(0), F.col("n") - F.col("skip")))
    at = lambda states, k, x: F.coalesce(F.get(states, (k - 1).cast("int"))[x], F.lit(0).cast("long"))
    under = [at(F.col("lent"), F.col("lead"), f"s{k}").alias(f"g{k}") for k in (1, 2)]
    less = [at(F.col("heads"), F.col("skip"), f"s{k}").alias(f"o{k}") for k in (1, 2)]
    known = convs.select("conv_id", "skip", "lead", "n_all", *under, *less, F.explode(F.expr(f"sequence(0, (n - 1) div {RUN})")).alias("run"))
    own = turns.withColumn("run", F.expr(f"(p - 1) div {RUN}")).join(known, ["conv_id", "run"]).where("p > skip").drop("run")
    none = F.lit(0).cast("long")
    lent = convs.select("conv_id", "n_all", F.explode(F.expr("slice(lent, 1, int(lead))")).alias("t")).select("conv_id", "n_all", "t.*")
    lent = lent.select("*", *[none.alias(c) for c in ("skip", "lead", "g1", "g2", "o1", "o2")])
    spark, path = conversations.sparkSession, scratch_path(conversations.sparkSession, "trie-steps")
    own.unionByName(lent).mapInArrow(_steps, STEPS).write.parquet(path)
    return spark.read.schema(STEPS).parquet(path), convs.select("conv_id", "n_all")


# --- tree contraction ---


def contract(tree: DataFrame) -> DataFrame:
    """(id, leaves, saved): the sums of ``leaves`` and ``saved`` over each node's subtree.

    ``tree`` has id, parent (null for roots), leaves and saved. Each round rakes all leaves,
    adding their sums to their parents', then compresses chains: of the nodes with a single
    child, those whose random number is below its parent's and child's go out, the child
    moves up and the sums go to the parent. No two neighbours go out at once, and a third of
    a long chain does, so that rounds grow with the logarithm of the tree. Going back over
    the rounds, what went out gets its own sums and its child's subtree. Each half of a
    round is checkpointed.
    """
    active, raked, rounds = tree.select("id", "parent", "leaves", "saved"), [], []
    while True:
        kids = active.where("parent is not null").groupBy("parent").agg(F.count("*").alias("kids")).withColumnRenamed("parent", "id")
        own = active.join(kids, "id", "left")
        up = own.where("kids is null and parent is not null").groupBy("parent").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"), F.count("*").alias("gone")).withColumnRenamed("parent", "id")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        own = cut(own.join(up, "id", "left").select("id", "parent", "kids", (F.col("kids") - zero("gone")).alias("left"), (F.col("leaves") + zero("l")).alias("leaves"), (F.col("saved") + zero("s")).alias("saved")))
        raked.append(own.where("kids is null").select("id", "leaves", "saved"))
        rest = own.where("kids is not null")
        # the one child that is left of a node is the smallest that is left
        child = rest.where("parent is not null").groupBy("parent").agg(F.min("id").alias("child")).withColumnRenamed("parent", "id")
        chance = lambda c, k=len(rounds): F.xxhash64(F.col(c), F.lit(k))
        out = (F.col("left") == 1) & (chance("id") < chance("parent")) & (chance("id") < chance("child"))
        rest = cut(rest.join(child, "id", "left").select("id", "parent", "child", "leaves", "saved", F.coalesce(out, F.lit(False)).alias("out")))
        counts = rest.agg(F.count("*").alias("n"), F.count_if("out").alias("out")).first()
        if not counts.n:
            break
        gone, active = rest.where("out"), rest.where("not out").select("id", "parent", "leaves", "saved")
        if counts.out:
            rounds.append(gone.select("id", "child", "leaves", "saved"))
            moved = gone.select(F.col("child").alias("id"), F.col("parent").alias("higher"))
            sums = gone.groupBy("parent").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s")).withColumnRenamed("parent", "id")
            active = active.join(moved, "id", "left").join(sums, "id", "left")
            active = active.select("id", F.coalesce("higher", "parent").alias("parent"), (F.col("leaves") + zero("l")).alias("leaves"), (F.col("saved") + zero("s")).alias("saved"))
    total = raked[0]
    for r in raked[1:]:
        total = total.union(r)
    for gone in reversed(rounds):
        below = total.select(F.col("id").alias("child"), F.col("leaves").alias("l"), F.col("saved").alias("s"))
        total = total.union(cut(gone.join(below, "child").select("id", F.col("leaves") + F.col("l"), F.col("saved") + F.col("s"))))
    return total


# --- hashes of lists ---


def _piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in KEY]
        ids = batch.column("conv_id").to_pylist()
        new = np.zeros(len(ids), bool)
        for k in keys:
            new |= np.r_[True, k[1:] != k[:-1]][: len(ids)]
        starts = [x for a, b in zip(np.flatnonzero(new).tolist(), [*np.flatnonzero(new).tolist()[1:], len(ids)], strict=True) for x in range(a, b, PIECE)]
        ends = [*starts[1:], len(ids)]
        at = pa.array(starts, pa.int64())
        text = [",".join(map(str, ids[a:b])) for a, b in zip(starts, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in KEY), batch.column("conv_id").take(at), pa.array(text, pa.string())], names=[*KEY, "first", "text"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash for each run of pieces of a key; pieces are taken in one by one."""
    open_, digest = None, None
    for batch in batches:
        done: list[tuple] = []
        for *key, text in zip(*(batch.column(c).to_pylist() for c in [*KEY, "text"]), strict=True):
            if key == open_:
                digest.update(b"," + text.encode())
                continue
            if open_:
                done.append((*open_, digest.hexdigest()))
            open_, digest = key, hashlib.sha256(text.encode())
        yield _hash_batch(done)
    if open_:
        yield _hash_batch([(*open_, digest.hexdigest())])


def _hash_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), pa.array([r[3] for r in rows], pa.string())], names=[*KEY, "list_sha256"])


def list_hashes(rows: DataFrame) -> DataFrame:
    """(depth, k1, k2, list_sha256): the SHA-256 of each key's conv_ids, rising and joined by commas.

    Ids are sorted by range, whatever key they have, and written as pieces of text; a key's
    pieces are then hashed in turn. That last step is one stream for each key, as the hash
    asks for, but holds one batch at a time.
    """
    key = ", ".join(f"{c} long" for c in KEY)
    pieces = rows.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(_piece_rows, f"{key}, first long, text string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_hashes, f"{key}, list_sha256 string")


# --- the trie ---


def prefix_trie(conversations: DataFrame, base: Column | None = None, head: Column | None = None, most_head: int = 3) -> DataFrame:
    """A row for each distinct sequence of first turns (role, text) of the conversations, from the empty one.

    ``conversations`` has conv_id, turn, role and text; turns go by ``turn``, null first,
    then by role and text (its first LEAD signs, then its digest). Null roles and texts are empty, rows without conv_id are
    left out, other columns are ignored. A conversation may be a branch of another one: with
    ``base`` and ``head`` (columns over conv_id; ``head`` is at most ``most_head``) its first
    ``head`` turns are those of conversation ``base``, all if that has fewer and none if
    there is no such conversation, in place of its own first ``head``.

    Columns: conv_id, the smallest member (a conversation that begins so); depth;
    parent_conv_id, the parent's conv_id; n_convs, members; n_children; n_leaves, childless
    nodes of the subtree; saved_tokens, the sum over the subtree of (n_convs - 1) times the
    words of the node's last text; ends_sha256, the hash of the members that end here, rising
    and joined by commas. An empty table gives no rows.

    A chain that only one conversation takes is compressed beforehand into a leaf that saves
    nothing; all that is shared goes through ``contract``.
    """
    spark = conversations.sparkSession
    rows, convs = steps(conversations, base, head, most_head)
    first = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.count_if(F.col("n_all") == 0).alias("ends"), F.max(F.when(F.col("n_all") == 0, F.col("conv_id"))).alias("ender")).first()
    if not first.n:
        return spark.createDataFrame([], NODES)
    ends = F.count_if("last").alias("n_ends"), F.max(F.when(F.col("last"), F.col("conv_id"))).alias("ender")
    nodes = rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), *ends)
    path = scratch_path(spark, "trie-nodes")
    nodes.withColumn("id", F.monotonically_increasing_id()).write.parquet(path)
    nodes = spark.read.parquet(path)

    shared = nodes.where("n_convs > 1").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    # the root may have any share of the nodes as children, and is known
    top = nodes.where("depth = 1").withColumns({"parent": F.lit(ROOT).cast("long"), "parent_conv_id": F.lit(first.conv_id).cast("long")})
    root = spark.createDataFrame([(0, 0, 0, first.conv_id, first.n, 0, first.ends, first.ender, ROOT, None, None)], "depth long, k1 long, k2 long, conv_id long, n_convs long, words long, n_ends long, ender long, id long, parent long, parent_conv_id long")
    linked = nodes.where("depth > 1").join(shared, ["depth", "p1", "p2"], "left").unionByName(top).drop("p1", "p2").unionByName(root)
    path = scratch_path(spark, "trie-linked")
    linked.write.parquet(path)
    linked = spark.read.schema(linked.schema).parquet(path)

    many = (F.col("n_convs") > 1) | (F.col("depth") == 0)
    kids = linked.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children"), F.count_if(F.expr("n_convs = 1")).alias("tails")).withColumnRenamed("parent", "id")
    inner = cut(linked.where(many).join(kids, "id", "left").select("id", "parent", "n_convs", "words", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("tails", F.lit(0)).alias("tails")))
    own_leaves = F.when(F.col("n_children") == 0, 1).otherwise(F.col("tails")).cast("long")
    totals = contract(inner.select("id", "parent", own_leaves.alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved")))
    totals = totals.join(inner.select("id", "n_children"), "id")

    several = linked.where("n_ends > 1").select(*KEY)
    zero = F.lit(0).cast("long")
    turnless = convs.where("n_all = 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id")
    lists = list_hashes(rows.where("last").select(*KEY, "conv_id").unionByName(turnless).join(several, KEY, "left_semi"))
    out = linked.join(totals, "id", "left").join(lists, KEY, "left")
    return out.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.coalesce("n_children", F.lit(1) - F.col("n_ends")).alias("n_children"),
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("list_sha256", F.sha2(F.coalesce(F.col("ender").cast("string"), F.lit("")), 256)).alias("ends_sha256"),
    )
