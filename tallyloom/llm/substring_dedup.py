"""Substring deduplication by joining windows of words.

Every position of a document starts a suffix; only its first `words` words, a window, matter.
1. Documents are put in blocks by ranges of doc_id with about equal bytes. A block sends each bucket, by a hash of the
   window, the digests (88 bits) of its distinct windows, so a passage costs a block one entry however often it occurs there.
2. Each bucket merges the lists. As blocks are in order of doc_id, the first block of a digest owns it. Every block gets
   back one bit per entry: "a smaller block has this".
3. Each block marks the windows so told and those that an earlier document of its own has; runs of marked windows are
   the maximal repeats, and their words are removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from . import words as W
from .shared import others, slices

BLOCK_BYTES = 6 << 20  # text in one block of documents
CELLS = 1 << 17  # ranges of doc_id whose bytes are summed to cut blocks
TAIL = np.uint64(0x2545F4914F6CDD1D)
BUCKET = 1 << 20  # suffixes that one task merges
DIGEST = 11  # bytes of a window's digest: among 2 * 10^13 windows less than one false match is expected


def _cuts(table: DataFrame, block_bytes: int) -> tuple[int, tuple[int, int, np.ndarray, np.ndarray]]:
    """(bytes in all, (shift, first cell, first block of each cell, blocks of each cell)): doc_id >> shift is a cell, CELLS at most.

    Small neighbouring cells share a block; a large cell has several, of equal ranges of doc_id.
    """
    ends = table.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    if ends.a is None:
        return 0, (0, 0, np.zeros(1, np.int64), np.ones(1, np.int64))
    shift = next(k for k in range(64) if (ends.b >> k) - (ends.a >> k) < CELLS)
    low = ends.a >> shift
    sums = table.groupBy((F.shiftright("doc_id", shift) - F.lit(low)).cast("int").alias("cell")).agg(F.sum(F.octet_length("text")).alias("n")).toArrow()  # CELLS rows at most
    size = np.zeros((ends.b >> shift) - low + 1, np.int64)
    size[sums["cell"].to_numpy()] = sums["n"].fill_null(0).to_numpy()
    before = np.cumsum(size) - size
    many = np.minimum(-(-size // block_bytes), 1 << shift)
    large = many > 1
    step = np.ones(len(size), bool)  # a cell opens a block: the first, one in or after a large cell, or where a multiple is passed
    step[1:] = large[1:] | large[:-1] | (before[1:] // block_bytes != before[:-1] // block_bytes)
    many = np.maximum(many, 1)
    opened = np.where(step, many, 0)
    return int(size.sum()), (shift, low, np.cumsum(opened) - np.where(large, many, 1), many)


def _deal(shift: int, low: int, first: np.ndarray, many: np.ndarray):
    """Compressed texts with the block of their doc_id."""

    def run(batches):
        codec = pa.Codec("zstd")
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            cell = (ids >> shift) - low
            inside = (ids & ((1 << shift) - 1)).astype(np.float64) / 2.0**shift
            block = first[cell] + np.minimum((inside * many[cell]).astype(np.int64), many[cell] - 1)
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            z = pa.array([codec.compress(x, asbytes=True) for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), batch.column("doc_id"), z, pa.array([len(x) for x in texts], pa.int64()), batch.column("rest")], ["block", "doc_id", "z", "size", "rest"])

    return run


def _opened(table: pa.Table) -> tuple[pa.Table, list[bytes], np.ndarray, np.ndarray]:
    """The block in order of doc_id: (rows, texts, word hashes, first word of each document)."""
    tokens.release()
    table = table.sort_by("doc_id")
    codec = pa.Codec("zstd")
    texts = [codec.decompress(z, n, asbytes=True) for z, n in zip(table["z"].to_pylist(), table["size"].to_pylist(), strict=True)]
    raw, at = W.text_bytes(pa.array(texts, pa.large_binary()))
    s, e, per = W.split(raw, at, W.not_space())
    return table, texts, W.hashes(raw, s, e), per


def _suffixes(h: np.ndarray, per: np.ndarray, depth: int, buckets: int):
    """(starts, digests of the distinct windows, their first start, index of each start's window, order by bucket, cuts)."""
    starts = W.whole(per, depth)
    none = np.zeros(0, np.uint64)
    head = W.combine(h, depth)[starts] if len(starts) else none
    tail = (W.combine(W.mix(h ^ TAIL), depth)[starts] if len(starts) else none) >> np.uint64(64 - 8 * (DIGEST - 8))
    distinct, first, inverse = np.unique(head, return_index=True, return_inverse=True)
    if (tail != tail[first][inverse]).any():  # two windows with one head
        _, first, inverse = np.unique(np.rec.fromarrays([head, tail]), return_index=True, return_inverse=True)
        distinct = head[first]
    bucket = W.mix(distinct) % np.uint64(buckets)
    order = np.argsort(bucket.astype(np.int64), kind="stable")
    digests = np.concatenate([distinct.view(np.uint8).reshape(-1, 8), tail[first].view(np.uint8).reshape(-1, 8)[:, : DIGEST - 8]], 1)
    return starts, digests, first, inverse, order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _send(depth: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        table, _, h, per = _opened(table.select(["doc_id", "z", "size"]))
        _, digests, _, _, order, cuts = _suffixes(h, per, depth, buckets)
        has = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
        blobs = [digests[order[cuts[b] : cuts[b + 1]]].tobytes() for b in has]
        return pa.table({"bucket": pa.array(has, pa.int32()), "block": pa.array([block] * len(has), pa.int32()), "suffixes": pa.array(blobs, pa.binary())})

    return run


def _merge(table: pa.Table) -> pa.Table:
    """Nodes of one bucket: bits of those entries whose node an earlier block owns."""
    table = table.sort_by("block")
    parts = [np.frombuffer(x.as_py(), np.uint8).reshape(-1, DIGEST) for x in table["suffixes"]]
    ends = np.cumsum([0] + [len(x) for x in parts])
    every = np.concatenate(parts)
    head = np.ascontiguousarray(every[:, :8]).view(np.uint64)[:, 0]
    tail = np.zeros((len(every), 4), np.uint8)
    tail[:, : DIGEST - 8] = every[:, 8:]
    tail = tail.view(np.uint32)[:, 0]
    del every
    order = np.argsort(head, kind="stable")  # equal windows stay in order of block
    same = head[order[1:]] == head[order[:-1]]
    if (tail[order[1:]] != tail[order[:-1]])[same].any():
        order = np.lexsort((tail, head))
        same = head[order[1:]] == head[order[:-1]]
    again = np.zeros(len(head), bool)
    again[order[1:]] = same & (tail[order[1:]] == tail[order[:-1]])
    got = [(b, again[i:j]) for b, i, j in zip(table["block"].to_pylist(), ends[:-1], ends[1:], strict=True)]
    got = [(b, x) for b, x in got if x.any()]
    bucket = table["bucket"][0].as_py()
    return pa.table({"block": pa.array([b for b, _ in got], pa.int32()), "bucket": pa.array([bucket] * len(got), pa.int32()), "seen": pa.array([np.packbits(x).tobytes() for _, x in got], pa.binary())})


def _unnamed(rejoin: bool):
    """Rows without a doc_id, whole."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()]
                words = [x.split() for x in texts]
                out = [b" ".join(w) for w in words] if rejoin else texts
                kind = pa.list_(pa.list_(pa.int64()))
                cols = [part.column("doc_id"), pa.array([x.decode("utf-8", "replace") for x in out], pa.string()), pa.array([len(w) for w in words], pa.int64()), pa.array([[] for _ in texts], kind), part.column("rest")]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text", "n_words", "spans", "rest"])

    return run


def _remove(depth: int, buckets: int, rejoin: bool, rest: pa.DataType):
    def kept(text: bytes, keep: list[bool]) -> bytes:
        if rejoin:
            found = text.split()
            return b" ".join(found if all(keep) else [w for w, k in zip(found, keep, strict=True) if k])
        if all(keep):
            return text
        raw = np.frombuffer(text, np.uint8)
        s, e, _ = W.split(raw, np.array([0, len(raw)]), W.not_space())
        drop = np.zeros(len(raw) + 1, np.int64)
        gone = ~np.array(keep)
        after = np.append(s[1:], len(raw))[gone]  # a removed word takes the space behind it along
        np.add.at(drop, s[gone], 1)
        np.add.at(drop, after, -1)
        return raw[np.cumsum(drop)[:-1] == 0].tobytes()

    def run(docs: pa.Table, seen: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "n_words": pa.array([], pa.int64()), "spans": pa.array([], pa.list_(pa.list_(pa.int64()))), "rest": pa.array([], rest)})
        docs, texts, h, per = _opened(docs)
        gone = np.zeros(per[-1] + 1, np.int64)
        starts, digests, first, inverse, order, cuts = _suffixes(h, per, depth, buckets)
        told = np.zeros(len(digests), bool)
        for b, bits in zip(seen["bucket"].to_pylist(), seen["seen"].to_pylist(), strict=True):
            at = order[cuts[b] : cuts[b + 1]]
            told[at] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(at)).astype(bool)
        doc = np.repeat(docs["doc_id"].to_numpy(), np.diff(per))[starts] if len(starts) else np.zeros(0, np.int64)
        hit = starts[told[inverse] | (doc > doc[first][inverse])]  # rows are in order of doc_id
        np.add.at(gone, hit, 1)
        np.add.at(gone, hit + depth, -1)
        gone = np.cumsum(gone)[:-1] > 0
        keep = (~gone).tolist()
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
        spans: list[list[list[int]]] = [[] for _ in texts]
        for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            d = int(np.searchsorted(per, i, side="right")) - 1
            while i < j:  # marked words of neighbouring documents touch
                stop = min(j, int(per[d + 1]))
                if stop > i:
                    spans[d].append([i - int(per[d]), stop - int(per[d])])
                i, d = stop, d + 1
        out = [kept(t, keep[per[d] : per[d + 1]]).decode("utf-8", "replace") for d, t in enumerate(texts)]
        return pa.table({"doc_id": docs["doc_id"], "text": pa.array(out, pa.string()), "n_words": pa.array(np.diff(per)), "spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))), "rest": docs["rest"]})

    return run


def remove_repeats(docs: DataFrame, words: int = 13, rejoin: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Removes every word covered by a window of `words` words that also starts in a document with a smaller doc_id.

    docs: doc_id long, text string and any other columns. Words are ``[^\\x20\\x09-\\x0D]+``; windows are judged on the
    input. Returns doc_id, text (what is kept), n_words, spans (array of [first, end) word numbers removed: the maximal
    repeats) and rest (the other columns). rejoin: kept words joined by one space, else the white space stays.

    No rows: none come back. Null or empty text: no words. Null doc_id: the row is returned whole and is nobody's predecessor. Rows with one
    doc_id, repeated or not, share a block and are not each other's predecessors. Two windows are the same if their
    digests of 88 bits are.
    """
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), others(docs, "doc_id", "text"))
    unnamed, table = table.where("doc_id is null"), table.where("doc_id is not null")
    n_bytes, cuts = _cuts(table, block_bytes)
    buckets = max(1, n_bytes // 6 // BUCKET)
    rest = table.schema["rest"].dataType
    # both groupings by block read one exchange, so texts are shuffled once
    dealt = table.mapInArrow(_deal(*cuts), T.StructType([T.StructField("block", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("z", T.BinaryType()), T.StructField("size", T.LongType()), T.StructField("rest", rest)]))
    sent = dealt.groupBy("block").applyInArrow(_send(words, buckets), "bucket int, block int, suffixes binary")
    seen = sent.groupBy("bucket").applyInArrow(_merge, "block int, bucket int, seen binary")
    from pyspark.sql.pandas.types import to_arrow_type

    kind = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("rest", rest)])
    out = dealt.groupBy("block").cogroup(seen.groupBy("block")).applyInArrow(_remove(words, buckets, rejoin, to_arrow_type(rest)), kind)
    return out.unionByName(unnamed.mapInArrow(_unnamed(rejoin), kind))


def removed(spans: str = "spans"):
    """Number of words in an array of [first, end) spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
