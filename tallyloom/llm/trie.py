"""The prefix trie of conversations, with totals of subtrees, by time-forward processing.

1. Turns get places in their conversation by a range sort and counts carried from range to range, so that one very long
   conversation lies in many ranges. Conversations are rebuilt around shared openings.
2. A node is a depth and the exclusive or of 128-bit hashes of (place, role, text) of all turns up to it; a second range
   sort carries these along a conversation. Grouping by them gives members, smallest member and children.
3. A node's name is (smallest member, depth). In the order of names every parent comes before its children. Ranges of
   names are shards. A shard is read by reverse level order: each node takes what its children sent out of a priority
   queue, adds it up and sends the sum forward to its parent. A queue beyond a bound spills sorted runs.
4. Sums for parents in other shards go across shard roots: first what each shard owes to nodes of other shards, then, as
   all links between shards lead to earlier ones, along links doubled in each round. With what came from outside known,
   each shard is processed once more, and its totals are final.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

ROWS = 200_000  # turns or nodes of one range
QUEUED = 100_000  # messages that a shard's queue holds in memory
CHUNK = 8192  # numbers of conversations in one row on the way to a digest


class SpillingQueue:
    """A priority queue of (key, value) that keeps `most` entries in memory and sorted runs of the rest in task-private
    temporary files, which have no name and end with the task. Least key first."""

    def __init__(self, most: int = QUEUED) -> None:
        self.most, self.heap, self.heads, self.runs = most, [], [], []

    def push(self, key: tuple, value: tuple) -> None:
        heapq.heappush(self.heap, (key, value))
        if len(self.heap) > self.most:
            self._spill()

    def _spill(self) -> None:
        self.heap.sort()
        keep, run = self.heap[: self.most // 2], self.heap[self.most // 2 :]
        self.heap = keep  # sorted lists are heaps
        f = tempfile.TemporaryFile()
        for i in range(0, len(run), 1000):
            pickle.dump(run[i : i + 1000], f)
        f.seek(0)
        self.runs.append((f, iter(())))
        self._next(len(self.runs) - 1)

    def _next(self, k: int) -> None:
        f, part = self.runs[k]
        entry = next(part, None)
        if entry is None:
            try:
                part = iter(pickle.load(f))
            except EOFError:
                f.close()
                return
            entry = next(part)
            self.runs[k] = (f, part)
        heapq.heappush(self.heads, (*entry, k))

    def pop_at(self, key: tuple) -> Iterator[tuple]:
        """Takes out and gives the values of all entries at this key; no earlier key may be left."""
        while True:
            own = self.heap[0] if self.heap else None
            run = self.heads[0] if self.heads else None
            if own is not None and (run is None or own[0] <= run[0]):
                if own[0] != key:
                    return
                yield heapq.heappop(self.heap)[1]
            elif run is not None and run[0] == key:
                _, value, k = heapq.heappop(self.heads)
                self._next(k)
                yield value
            else:
                return


def _ranges(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.repartitionByRange(max(1, n), *order).sortWithinPartitions(*order)


def _parts(df: DataFrame, rows: int) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, rows // ROWS)


def _carried(scanned: DataFrame, *sums: Column) -> DataFrame:
    """part, conv_id and, for a conversation that began in an earlier range, what those ranges hold of it.

    scanned has part (number of its range), conv_id and nth (place of the row in the conversation's rows of the range).
    """
    last = scanned.groupBy("part").agg(F.max("conv_id").alias("conv_id"))  # one row for each range
    tails = scanned.join(F.broadcast(last), ["part", "conv_id"]).groupBy("part", "conv_id").agg(*sums)
    return tails


def _number(batches):
    """Adds part and nth to rows sorted by conversation, and hashes of what a turn says, without the texts."""
    part, now, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        ids = batch.column("conv_id").to_numpy()
        nth = np.empty(len(ids), np.int64)
        for i, c in enumerate(ids.tolist()):
            n = n + 1 if c == now else 0
            nth[i], now = n, c
        role, text = batch.column("role").to_pylist(), batch.column("text").to_pylist()
        said = [hashlib.blake2b(b"%d:" % len(r := x.encode()) + r + y.encode(), digest_size=16).digest() for x, y in zip(role, text, strict=True)]
        h = np.frombuffer(b"".join(said), "<i8").reshape(-1, 2)
        cols = [batch.column("conv_id"), pa.array(np.full(len(ids), part, np.int32)), pa.array(nth), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array([len(y) for y in text], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["conv_id", "part", "nth", "h1", "h2", "chars"])


def _placed(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 0), h1, h2, chars of every turn with a conv_id."""
    t = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"),
    ).where("conv_id is not null")
    order = _ranges(t, _parts(t, t.count()), "conv_id", "turn", "role", "text", "row").select("conv_id", "role", "text")
    scanned = written(order.mapInArrow(_number, "conv_id long, part int, nth long, h1 long, h2 long, chars long"), "turns")
    tails = _carried(scanned, F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tails = tails.select("conv_id", "part", F.sum("n").over(before).alias("n"))  # one row for each range at most
    first = scanned.groupBy("part").agg(F.min("conv_id").alias("conv_id"))
    # the range before the one in question ends with the conversation that this one begins with
    carry = first.alias("a").join(tails.alias("b"), (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.part") < F.col("a.part")))
    carry = carry.groupBy(F.col("a.part").alias("part"), F.col("a.conv_id").alias("conv_id")).agg(F.max("n").alias("n"))
    return scanned.join(F.broadcast(carry), ["part", "conv_id"], "left").select("conv_id", (F.col("nth") + F.coalesce("n", F.lit(0))).alias("place"), "h1", "h2", "chars")


def _rebuilt(placed: DataFrame, group: int, most_shared: int) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, h1, h2, chars of rebuilt turns; conv_id, total of rebuilt conversations)."""
    sizes = written(placed.groupBy("conv_id").agg(F.max("place").alias("last")).selectExpr("conv_id", "last + 1 as n"), "sizes")
    kept = F.crc32(F.col("conv_id").cast("string")) % most_shared
    convs = sizes.select("conv_id", "n", kept.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    heads = placed.where(F.col("place") < most_shared - 1).where(F.col("conv_id") % group == 0)
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "h1", "h2", "chars"))).alias("head"))  # a few turns
    convs = convs.join(heads, "base", "left")
    given = F.least(F.col("h"), F.coalesce(F.size("head"), F.lit(0)))
    convs = convs.withColumn("head", F.when(given > 0, F.slice("head", 1, F.greatest(given, F.lit(1))))).withColumn("m", F.when(F.col("head").isNull(), 0).otherwise(given))
    convs = written(convs.select("conv_id", "h", "m", "head", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")), "conversations")
    own = placed.join(convs.select("conv_id", "h", "m"), "conv_id").where("place >= h").selectExpr("conv_id", "place - h + m + 1 as depth", "h1", "h2", "chars")
    shared = convs.select("conv_id", F.explode("head").alias("t")).selectExpr("conv_id", "t.place + 1 as depth", "t.h1", "t.h2", "t.chars")
    salted = [F.xxhash64("depth", "h1", "h2", F.lit(k)).alias(f"x{k}") for k in (1, 2)]
    return own.unionByName(shared).select("conv_id", "depth", *salted, "chars"), convs.select("conv_id", "total")


def _along(batches):
    """Running exclusive or of x1 and x2 along each conversation, within the range."""
    part, now, a, b = TaskContext.get().partitionId(), None, 0, 0
    for batch in batches:
        ids, x1, x2 = (batch.column(c).to_numpy() for c in ("conv_id", "x1", "x2"))
        if not len(ids):
            continue
        new = np.concatenate([[ids[0] != now], ids[1:] != ids[:-1]])
        begin = np.maximum.accumulate(np.where(new, np.arange(len(ids)), -1))
        out = []
        for x, carry in ((x1, a), (x2, b)):
            run = np.bitwise_xor.accumulate(x)
            before = np.where(begin > 0, run[begin - 1], 0)
            out.append(np.where(begin >= 0, run ^ before, run ^ carry))
        now, a, b = ids[-1], out[0][-1], out[1][-1]
        cols = [batch.column("conv_id"), pa.array(np.full(len(ids), part, np.int32)), batch.column("depth"), batch.column("x1"), batch.column("x2"), pa.array(out[0]), pa.array(out[1]), batch.column("chars")]
        yield pa.RecordBatch.from_arrays(cols, ["conv_id", "part", "depth", "x1", "x2", "p1", "p2", "chars"])


def _prefixes(rebuilt: DataFrame) -> DataFrame:
    """conv_id, depth, p1, p2 (the turns up to here), q1, q2 (those up to the turn before), chars."""
    n = rebuilt.count()
    scanned = written(_ranges(rebuilt, _parts(rebuilt, n), "conv_id", "depth").mapInArrow(_along, "conv_id long, part int, depth long, x1 long, x2 long, p1 long, p2 long, chars long"), "prefixes")
    tails = _carried(scanned, F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    first = scanned.groupBy("part").agg(F.min("conv_id").alias("conv_id"))
    carry = first.alias("a").join(tails.alias("b"), (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.part") < F.col("a.part")))
    carry = carry.groupBy(F.col("a.part").alias("part"), F.col("a.conv_id").alias("conv_id")).agg(F.bit_xor("x1").alias("c1"), F.bit_xor("x2").alias("c2"))
    t = scanned.join(F.broadcast(carry), ["part", "conv_id"], "left")
    for k in "12":
        t = t.withColumn(f"p{k}", F.col(f"p{k}").bitwiseXOR(F.coalesce(F.col(f"c{k}"), F.lit(0).cast("long")))).withColumn(f"q{k}", F.col(f"p{k}").bitwiseXOR(F.col(f"x{k}")))
    return t.select("conv_id", "depth", "p1", "p2", "q1", "q2", "chars")


def _nodes(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes with their names, parents' names and shards: see `prefix_trie`, without the totals."""
    grouped = prefixes.groupBy("depth", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.min("chars").alias("chars"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "conv_id", "n_convs", none.alias("q1"), none.alias("q2"), zero.alias("chars"))
    grouped = written(grouped.unionByName(root), "grouped")
    n = grouped.count()
    named = written(_ranges(grouped, _parts(grouped, n), "conv_id", "depth").withColumn("shard", F.spark_partition_id()), "nodes")
    # a parent's name for each of its children; parents are unique, a parent of very many children is split by Spark
    parents = named.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"), F.col("shard").alias("parent_shard"))
    named = written(named.join(parents, ["depth", "q1", "q2"], "left"), "linked")
    links = named.where("parent_conv_id is not null").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    links = links.agg(F.count("*").alias("n_children"), F.max(F.col("shard") != F.col("parent_shard")).alias("receives"))
    nodes = named.join(links, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", zero)).withColumn("receives", F.coalesce("receives", F.lit(False)))
    return written(nodes, "counted")


_SHARD = ["conv_id", "depth", "parent_conv_id", "inside", "receives", "leaves", "saved"]
_UP = "conv_id long, depth long, leaves long, saved long, parent_conv_id long, kind int"


def _forward(final: bool):
    """Time-forward processing of the shards that a partition holds, one after the other, each in reverse level order.

    final: every node with its totals (kind 0). Otherwise what leaves the shard: its roots (kind 1: totals and the parent's
    name), and of each node that other shards send to, the name of its root in the shard (kind 2, in leaves and saved).
    """

    def run(batches):
        shard, queue = None, SpillingQueue()
        out: list[tuple] = []
        for batch in batches:
            for c, d, parent, inside, receives, leaves, saved, s in zip(*(batch.column(k).to_pylist() for k in [*_SHARD, "shard"]), strict=True):
                if s != shard:
                    shard, queue = s, SpillingQueue()
                names = []
                for more_leaves, more_saved, more in queue.pop_at((-d, -c)):
                    leaves += more_leaves
                    saved += more_saved
                    names += more
                if receives and not final:
                    names.append((c, d))
                if final:
                    out.append((c, d, leaves, saved, parent, 0))
                if inside:
                    queue.push((1 - d, -parent), (leaves, saved, names))
                elif not final:
                    out.append((c, d, leaves, saved, parent, 1))
                    out += [(*name, c, d, None, 2) for name in names]
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, [pa.int64()] * 5 + [pa.int32()], strict=True)], ["conv_id", "depth", "leaves", "saved", "parent_conv_id", "kind"])
                out = []

    return run


def _process(nodes: DataFrame, final: bool) -> DataFrame:
    """nodes: the columns of _SHARD and shard. A shard is sorted by Spark and streamed, so it may exceed memory."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = nodes.select(*_SHARD, "shard").repartition(n, "shard")
    return shards.sortWithinPartitions("shard", F.col("depth").desc(), F.col("conv_id").desc()).mapInArrow(_forward(final), _UP)


def _from_outside(leaving: DataFrame) -> DataFrame:
    """conv_id, depth, leaves, saved: what nodes get from other shards in all, given what leaves each shard.

    Shard roots form a tree of their own: the root above a root is the one of its parent's shard part. Links lead to
    earlier shards, so doubling them takes as many rounds as the logarithm of their number at most.
    """
    roots = leaving.where("kind = 1 and parent_conv_id is not null")
    labels = leaving.where("kind = 2").selectExpr("conv_id as parent_conv_id", "depth as parent_depth", "leaves as up_conv", "saved as up_depth")
    roots = roots.selectExpr("conv_id", "depth", "leaves", "saved", "parent_conv_id", "depth - 1 as parent_depth").join(labels, ["parent_conv_id", "parent_depth"])
    roots = written(roots, "shard-roots")
    # those that nothing hangs from have their sum already: only the others need rounds
    sums = roots.groupBy(F.col("up_conv").alias("conv_id"), F.col("up_depth").alias("depth")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    inner = roots.join(sums.select("conv_id", "depth", F.col("leaves").alias("l2"), F.col("saved").alias("s2")), ["conv_id", "depth"])
    inner = written(inner.selectExpr("conv_id", "depth", "l2 as leaves", "s2 as saved", "up_conv", "up_depth"), "inner-roots")
    gained = inner  # what lies below a root, without itself, as far as 2^round links
    while not inner.isEmpty():
        add = inner.groupBy(F.col("up_conv").alias("conv_id"), F.col("up_depth").alias("depth")).agg(F.sum("leaves").alias("l2"), F.sum("saved").alias("s2"))
        ups = inner.selectExpr("conv_id as up_conv", "depth as up_depth", "up_conv as far_conv", "up_depth as far_depth")
        total = gained.join(add, ["conv_id", "depth"], "left").selectExpr("conv_id", "depth", "leaves + coalesce(l2, 0) as leaves", "saved + coalesce(s2, 0) as saved", "up_conv", "up_depth")
        gained = written(total, "gained")
        far = inner.select("conv_id", "depth", "up_conv", "up_depth").join(ups, ["up_conv", "up_depth"]).selectExpr("conv_id", "depth", "far_conv as up_conv", "far_depth as up_depth")
        inner = written(far.join(gained.select("conv_id", "depth", "leaves", "saved"), ["conv_id", "depth"]), "inner-roots")
    whole = roots.join(gained.selectExpr("conv_id", "depth", "leaves as l2", "saved as s2"), ["conv_id", "depth"], "left")
    whole = whole.selectExpr("parent_conv_id as conv_id", "parent_depth as depth", "leaves + coalesce(l2, 0) as leaves", "saved + coalesce(s2, 0) as saved")
    return whole.groupBy("conv_id", "depth").agg(F.sum("leaves").alias("l2"), F.sum("saved").alias("s2"))


def _totals(nodes: DataFrame) -> DataFrame:
    """conv_id, depth, n_leaves, saved_tokens of all nodes."""
    own = nodes.select(
        "conv_id", "depth", "parent_conv_id", F.coalesce(F.col("parent_shard") == F.col("shard"), F.lit(False)).alias("inside"), "receives",
        (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), "shard",
    )
    leaving = written(_process(own, final=False), "leaving")
    outside = written(_from_outside(leaving), "outside")
    own = own.join(outside, ["conv_id", "depth"], "left")
    own = own.withColumn("leaves", F.col("leaves") + F.coalesce("l2", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("s2", F.lit(0)))
    return _process(own, final=True).selectExpr("conv_id", "depth", "leaves as n_leaves", "saved as saved_tokens")


def _chunks(batches):
    """Rows sorted by node and conv_id, as decimal numbers joined by commas, CHUNK of them in a row at most."""
    now, have, first = None, [], 0
    row = lambda: pa.RecordBatch.from_pylist([{"depth": now[0], "p1": now[1], "p2": now[2], "first": first, "ids": ",".join(have)}])
    rows = []
    for batch in batches:
        for key, c in zip(zip(*(batch.column(k).to_pylist() for k in ("depth", "p1", "p2")), strict=True), batch.column("conv_id").to_pylist(), strict=True):
            if have and (key != now or len(have) == CHUNK):
                rows.append(row())
                have = []
            if not have:
                now, first = key, c
            have.append(str(c))
        if rows:
            yield from pa.Table.from_batches(rows).combine_chunks().to_batches()
            rows = []
    if have:
        yield row()


def _digests(batches):
    """SHA-256 of each node's chunks, streamed in order: one state in memory, however many there are."""
    now, state, out = None, None, []
    done = lambda: out.append({"depth": now[0], "p1": now[1], "p2": now[2], "ends_sha256": state.hexdigest()})
    schema = pa.schema([("depth", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("ends_sha256", pa.string())])
    for batch in batches:
        for key, ids in zip(zip(*(batch.column(k).to_pylist() for k in ("depth", "p1", "p2")), strict=True), batch.column("ids").to_pylist(), strict=True):
            if key == now:
                state.update(b",")
            else:
                if now is not None:
                    done()
                now, state = key, hashlib.sha256()
            state.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if now is not None:
        done()
        yield pa.RecordBatch.from_pylist(out, schema)


def _ends(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """depth, p1, p2, ends_sha256 of nodes at which conversations end."""
    zero = F.lit(0).cast("long")
    at = prefixes.join(convs, "conv_id").where("depth = total").select("conv_id", "depth", "p1", "p2")
    at = at.unionByName(convs.where("total = 0").select("conv_id", zero.alias("depth"), zero.alias("p1"), zero.alias("p2")))
    order = _ranges(at, _parts(at, convs.count()), "depth", "p1", "p2", "conv_id")
    chunks = order.mapInArrow(_chunks, "depth long, p1 long, p2 long, first long, ids string")
    n = int(at.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return chunks.repartition(n, "depth", "p1", "p2").sortWithinPartitions("depth", "p1", "p2", "first").mapInArrow(_digests, "depth long, p1 long, p2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, group: int = 100, most_shared: int = 6) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations; see the module for the method.

    turns: conv_id long, turn, role string, text string; other columns are left out. A conversation's turns go by turn
    (nulls first), then role, then text; null roles and texts are empty; repeated rows are turns of their own. Rows with a
    null conv_id take no part. Conversation c is rebuilt from the first h turns of c - c % group (all if it has fewer, none
    if there is none) and its own turns after its first h, h being the unsigned crc32 of c in decimal, modulo most_shared.

    conv_id (smallest member), depth (0: the textless root), parent_conv_id (null for the root), n_convs (members), n_children,
    n_leaves (nodes without children in its subtree, itself included), saved_tokens (summed over the subtree: members
    less one, times the code points of the last text), ends_sha256 (of the conv_ids of members that end here, ascending,
    decimal, comma-joined). No rows: no nodes. Sequences of turns are told apart by 128-bit hashes.
    """
    rebuilt, convs = _rebuilt(_placed(turns), group, most_shared)
    prefixes = _prefixes(rebuilt)
    nodes = _nodes(prefixes, convs)
    totals = _totals(nodes)
    out = nodes.join(totals, ["conv_id", "depth"]).join(_ends(prefixes, convs), ["depth", "p1", "p2"], "left")
    ends = F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends.alias("ends_sha256"))
