"""Sequence packing by a grouping genetic algorithm over islands.

Pieces of documents are dealt into groups by a hash. Each group is packed by several islands, each with a population of
packings started from best-fit decreasing in a perturbed order. A crossover injects whole well-filled bins of one parent
into another, empties the bins that hold any of their pieces, and best-fits the pieces displaced. After each epoch an
island's best packing migrates to the next island. Every island evolves for one epoch at least, which also gathers the
free space in few bins; later epochs end at once where no packing can have fewer bins. The best of a group is kept; its
badly filled bins are opened and their pieces go on to a next, smaller round of groups, until one group holds them all.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, trim, written
from .tokens import MOST, WordEncoder

GROUP = 4000  # pieces of one group
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2, 3, 8, 5
WELL = 0.995  # filling from which a bin is kept between rounds
GROUP_BITS, BIN_BITS = 31, 28  # of a sequence_id, below the round: the group, an int, and its bin, more than a group holds


def _pieces(path: str, capacity: int, end_id: int, cached: int, slice_bytes: int):
    def run(batches):
        trim()
        encoder, end = WordEncoder.at(path, cached), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                cols: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
                texts = [x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()]
                for d, raw in zip(part.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                    raw += end
                    for p, at in enumerate(range(0, len(raw) // 4, capacity)):
                        ids = raw[4 * at : 4 * (at + capacity)]
                        for c, v in zip(cols.values(), (d, p, at, len(ids) // 4, zlib.crc32(ids)), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "piece" else pa.int64()) for k, v in cols.items()})

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, cached: int = MOST, slice_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents with their end id, those over capacity cut into pieces.

    A worker keeps the ids of `cached` words and encodes about slice_bytes of text at once; both only set its memory.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_pieces(tokenizer, capacity, end_id, cached, slice_bytes), "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Bins:
    """Open bins by free space, for best fit."""

    def __init__(self, capacity: int, bins: list[list[int]], size: list[int]) -> None:
        self.size, self.bins = size, bins
        self.free = [capacity - sum(size[i] for i in b) for b in bins]
        self.capacity = capacity
        self.order = sorted((f, i) for i, f in enumerate(self.free) if f)

    def put(self, item: int) -> None:
        need = self.size[item]
        at = bisect.bisect_left(self.order, (need, -1))
        if at == len(self.order):
            b, free = len(self.bins), self.capacity
            self.bins.append([])
            self.free.append(free)
        else:
            free, b = self.order.pop(at)
        self.bins[b].append(item)
        self.free[b] = free - need
        if free > need:
            bisect.insort(self.order, (free - need, b))


def _fill(size: list[int], items, capacity: int, bins: list[list[int]]) -> list[list[int]]:
    found = _Bins(capacity, bins, size)
    for i in items:
        found.put(i)
    return found.bins


def _loads(bins: list[list[int]], size: list[int]) -> list[int]:
    return [sum([size[i] for i in b]) for b in bins]


def _fitness(loads: list[int], capacity: int) -> float:
    """Fewer bins first; among as many, the more unequally they are filled the better."""
    fill = np.array(loads) / capacity
    return float((fill**2).sum() / (len(loads) + 1) - len(loads))


def _cross(one: list[list[int]], two: list[list[int]], size: list[int], capacity: int, rng) -> list[list[int]]:
    """A child of one: it takes whole well-filled bins of two, and best-fits the pieces displaced by them.

    Mutation: bins filled badly are opened, and a few bins at random too, so that their space can be put together anew.
    """
    full = [b for b, n in zip(two, _loads(two, size), strict=True) if n >= WELL * capacity and len(b) > 1]
    take = [full[i] for i in rng.permutation(len(full))[: -(-len(full) // 3)]]
    inside = {i for b in take for i in b}
    kept, displaced = [list(b) for b in take], []
    luck = rng.random(len(one))
    for b, n, r in zip(one, _loads(one, size), luck.tolist(), strict=True):
        clash = not inside.isdisjoint(b)
        if clash or n < 0.9 * capacity or r < 0.02:
            displaced += [i for i in b if i not in inside] if clash else b
        else:
            kept.append(list(b))
    return _fill(size, sorted(displaced, key=lambda i: -size[i] * (1 + 0.1 * float(rng.random()))), capacity, kept)


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])


def _to_bytes(bins: list[list[int]], n: int) -> bytes:
    out = np.zeros(n, "<u4")
    for b, items in enumerate(bins):
        out[items] = b
    return out.tobytes()


def _from_bytes(raw: bytes) -> list[list[int]]:
    of = np.frombuffer(raw, "<u4")
    bins: list[list[int]] = [[] for _ in range(int(of.max(initial=0)) + 1)]
    for i, b in enumerate(of.tolist()):
        bins[b].append(i)
    return bins


def _evolve(capacity: int, epoch: int):
    """One epoch of one island: its population and the migrants, if any, to its new population."""

    def run(items: pa.Table, packings: pa.Table) -> pa.Table:
        if not items.num_rows:
            return pa.table({"grp": pa.array([], pa.int32()), "island": pa.array([], pa.int32()), "packing": pa.array([], pa.binary()), "fitness": pa.array([], pa.float64())})
        group, island = items["grp"][0].as_py(), items["island"][0].as_py()
        size = _ordered(items)["length"].to_pylist()
        least = -(-sum(size) // capacity)
        rng = np.random.default_rng([group, island, epoch])
        people = [_from_bytes(p) for p in sorted(packings["packing"].to_pylist())]
        while len(people) < POPULATION:  # an island starts from best-fit decreasing, and from orders near it
            noise = np.array(size) * (1 + (0.15 * rng.random(len(size)) if people or island else 0))
            people.append(_fill(size, np.argsort(-noise, kind="stable").tolist(), capacity, []))
        score = [_fitness(_loads(b, size), capacity) for b in people]
        for _ in range(GENERATIONS):
            if epoch and any(len(b) == least for b in people):
                break  # as few bins as any packing of these pieces can have
            order = np.argsort(score)
            one, two = order[-1], order[int(rng.integers(len(order)))]  # one with itself: mutation alone
            child = _cross(people[one], people[two], size, capacity, rng)
            value = _fitness(_loads(child, size), capacity)
            if value > score[order[0]]:
                people[order[0]], score[order[0]] = child, value
        best = np.argsort(score)[::-1][:POPULATION]
        return pa.table({"grp": pa.array([group] * len(best), pa.int32()), "island": pa.array([island] * len(best), pa.int32()), "packing": pa.array([_to_bytes(people[i], len(size)) for i in best], pa.binary()), "fitness": pa.array([score[i] for i in best])})

    return run


def _settle(capacity: int, round_: int, last: bool):
    def run(items: pa.Table, packings: pa.Table) -> pa.Table:
        items = _ordered(items)
        fitness = packings["fitness"].to_pylist()
        raw = packings["packing"].to_pylist()
        bins = _from_bytes(raw[max(range(len(raw)), key=lambda i: (fitness[i], raw[i]))]) if raw else []
        size, n = items["length"].to_pylist(), items.num_rows
        sequence, offset = [-1] * n, [0] * n
        group = items["grp"][0].as_py() if n else 0
        filled = [members for members in bins if last or sum(size[i] for i in members) >= WELL * capacity]
        for b, members in enumerate(filled):
            at = 0
            for i in members:
                sequence[i], offset[i] = (((round_ << GROUP_BITS) + group) << BIN_BITS) + b, at
                at += size[i]
        return pa.table({c: items[c] for c in _PIECE} | {"sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64())})

    return run


_PIECE = ("doc_id", "piece", "start", "length", "ids_crc32")
_PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _dealt(left: DataFrame, groups: int, round_: int) -> DataFrame:
    """left with grp: by a hash of the whole piece and, of equal pieces, each one's number, so no id or text fills a group."""
    each = left.groupBy(*_PIECE).agg(F.count("*").alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return each.select(*_PIECE, F.pmod(F.xxhash64(*_PIECE, "copy", F.lit(round_)), F.lit(groups)).cast("int").alias("grp"))


def pack(items: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32; 0 < length <= capacity).

    Every piece is in one sequence; places in a sequence are gapless from 0. Ties and repeated rows are packed like any
    others; null doc_ids too. No pieces: no rows.
    """
    left, done, n, round_ = items, [], items.count(), 0
    while n:
        groups = max(1, n // GROUP)
        last = groups == 1 or round_ == 6
        dealt = written(_dealt(left, groups, round_), "dealt")
        islands = dealt.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
        state = None
        for epoch in range(EPOCHS):
            if state is None:
                start = items.sparkSession.createDataFrame([], "grp int, island int, packing binary, fitness double")
            else:  # everyone stays, and each island's best also goes to the next
                best = state.groupBy("grp", "island").agg(F.max(F.struct("fitness", "packing")).alias("m"))
                moved = best.selectExpr("grp", f"(island + 1) % {ISLANDS} as island", "m.packing as packing", "m.fitness as fitness")
                start = state.unionByName(moved)
            keys = ["grp", "island"]
            state = islands.groupBy(*keys).cogroup(start.groupBy(*keys)).applyInArrow(_evolve(capacity, epoch), "grp int, island int, packing binary, fitness double")
        state = written(state, "packings")
        packed = written(dealt.groupBy("grp").cogroup(state.groupBy("grp")).applyInArrow(_settle(capacity, round_, last), _PIECE_SCHEMA), "packed")
        done.append(packed.where("sequence_id >= 0"))
        left = packed.where("sequence_id < 0").drop("sequence_id", "offset")
        n = 0 if last else left.count()
        round_ += 1
    out = done[0] if done else items.selectExpr("*", "0L as sequence_id", "0L as offset")
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, cached: int = MOST, slice_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs (doc_id, text).

    Null or empty text: the end id alone. Texts of any length are cut, never dropped. Other columns are left out.
    """
    return pack(written(pieces(docs, tokenizer, capacity, end_id, cached, slice_bytes), "pieces"), capacity)
