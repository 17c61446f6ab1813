"""SimHash near-duplicates found with Golay-code fuzzy keys.

A document's 64-bit fingerprint is cut into three segments of 21, 21 and 22 bits, each padded to the 23 bits of the
perfect binary Golay code. Two fingerprints with 4 different bits at most have two segments with 2 errors at most
between them (pigeonhole). A segment's keys are the codewords nearest to it and to each vector one bit away: 6 at most,
and two segments 2 bits apart share one. The key of a pair of segments is a pair of codeword numbers (24 bits).

Fingerprints, not documents, are joined: copies share one. Each mapper sends a bucket of keys one packed list, and the
bucket verifies the fingerprints of one key by their different bits. A key that many fingerprints share is searched
breadth first, so that its cost and its edges follow its members and not their pairs. Edges leave a bucket as a
spanning forest; components of the whole graph are found by alternating large-star and small-star joins.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from . import words as W
from .shared import delete, new_path, slices, written

SEGMENTS = ((0, 21), (21, 21), (42, 22))  # fixed: first bit and length
PAIRS = ((0, 1), (0, 2), (1, 2))
GENERATOR = 0xC75  # x^11+x^10+x^6+x^5+x^4+x^2+1: generates the (23, 12) Golay code
PER_BUCKET = 1 << 21  # entries (key, fingerprint) that one task merges


class Golay:
    """Nearest-codeword numbers (12 bits) of 23-bit vectors, by a syndrome table of 2048 entries."""

    def __init__(self) -> None:
        self.of_bit = np.array([self._syndrome(1 << i) for i in range(23)], np.int32)
        self.leader = np.zeros(2048, np.int32)
        for n in range(4):  # the code is perfect: each syndrome has one error pattern of weight 3 at most
            for bits in _choose(23, n):
                s = 0
                for b in bits:
                    s ^= int(self.of_bit[b])
                self.leader[s] = sum(1 << b for b in bits)

    @staticmethod
    def _syndrome(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GENERATOR << (i - 11)
        return x

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        for i in range(23):
            out ^= np.where(x >> i & 1, self.of_bit[i], 0).astype(np.int32)
        return out

    def keys(self, x: np.ndarray, used: int) -> np.ndarray:
        """Per vector, sorted distinct numbers of the codewords nearest to it and its neighbours in the used bits; -1 fills."""
        s = self.syndrome(x)
        found = [(x ^ self.leader[s]) >> 11]
        found += [((x ^ 1 << i) ^ self.leader[s ^ self.of_bit[i]]) >> 11 for i in range(used)]
        k = np.sort(np.stack(found, 1), 1)
        k[:, 1:][k[:, 1:] == k[:, :-1]] = 4096
        k = np.sort(k, 1)
        k = k[:, : max(1, int((k < 4096).sum(1).max(initial=1)))]
        return np.where(k == 4096, -1, k)


def _choose(n: int, k: int):
    from itertools import combinations

    return combinations(range(n), k)


def _prints(shingle: int, seed: int):
    digest = xxhash.xxh64_intdigest

    def one(text: bytes) -> int:
        found = text.lower().split()  # bytes: A-Z and ASCII white space only
        if not found:
            return 0
        joined, k = b" ".join(found), min(shingle, len(found))
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
        starts = np.concatenate([[0], ends[:-1]])
        spans = zip(starts[: len(found) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)
        h = np.array([digest(joined[i:j], seed) for i, j in spans], "<u8")
        votes = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        return int.from_bytes(np.packbits(votes * 2 > len(h), bitorder="little").tobytes(), "little")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                got = np.array([one(x or b"") for x in part.column("text").cast(pa.binary()).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(got.view(np.int64))], ["doc_id", "print"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 5, seed: int = 42) -> DataFrame:
    """doc_id, print (64 bits as a long): a bit is set if it is in more than half the shingles' XXH64 hashes.

    Texts are lower-cased in A-Z; words are ``[^\\x20\\x09-\\x0D]+``. Fewer words than `shingle`: all of them are one
    shingle. No words, or a null text: zero.
    """
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_prints(shingle, seed), "doc_id long, print long")


def _keys(buckets: int):
    def run(batches):
        code = Golay()
        for batch in batches:
            x = batch.column("print").to_numpy().view(np.uint64)
            seg = [code.keys((x >> np.uint64(at)).astype(np.int64) & ((1 << n) - 1), n) for at, n in SEGMENTS]
            all_keys, all_x = [], []
            for p, (a, b) in enumerate(PAIRS):
                for i in range(seg[a].shape[1]):
                    for j in range(seg[b].shape[1]):
                        ok = (seg[a][:, i] >= 0) & (seg[b][:, j] >= 0)
                        all_keys.append((p << 24) + (seg[a][ok, i].astype(np.int64) << 12) + seg[b][ok, j])
                        all_x.append(x[ok])
            keys, xs = np.concatenate(all_keys).astype(np.uint32), np.concatenate(all_x)
            bucket = (keys * np.uint32(2654435761) >> np.uint32(8)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            has = np.flatnonzero(np.diff(cuts))
            part = [order[cuts[b] : cuts[b + 1]] for b in has]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(has.astype(np.int32)), "keys": pa.array([keys[i].tobytes() for i in part], pa.binary()), "prints": pa.array([xs[i].tobytes() for i in part], pa.binary())})

    return run


def _search(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Edges that connect what is connected among x: each member is compared with those not reached yet."""
    edges, left = [], np.arange(1, len(x))
    queue = [0]
    while len(left):
        at = queue.pop() if queue else None
        if at is None:
            at, left = int(left[0]), left[1:]
        near = np.bitwise_count(x[left] ^ x[at]) <= bits
        if near.any():
            got = left[near]
            edges.append(np.stack([np.full(len(got), x[at]), x[got]], 1))
            queue += got.tolist()
            left = left[~near]
    return edges


def _forest(edges: np.ndarray) -> np.ndarray:
    """(member, least member of its component) of the components in edges."""
    nodes, ends = np.unique(edges, return_inverse=True)
    a, b = ends.reshape(edges.shape).T
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return np.stack([nodes[other], nodes[label[other]]], 1)


def _links(bits: int):
    def run(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(k, np.uint32) for k in table["keys"].to_pylist()])
        x = np.concatenate([np.frombuffer(k, np.uint64) for k in table["prints"].to_pylist()])
        order = np.argsort(keys, kind="stable")
        keys, x = keys[order], x[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.append(first, len(keys)))
        edges = []
        for i, n in zip(first[size > 16].tolist(), size[size > 16].tolist(), strict=True):
            edges += _search(x[i : i + n], bits)
        small = size <= 16
        end = np.repeat(np.where(small, first + size, 0), size)  # of the run each entry is in; 0: it is done
        for d in range(1, 16):
            i = np.flatnonzero(np.arange(len(x)) + d < end)
            if not len(i):
                break
            i = i[np.bitwise_count(x[i] ^ x[i + d]) <= bits]
            edges.append(np.stack([x[i], x[i + d]], 1))
        found = _forest(np.concatenate(edges)) if any(len(e) for e in edges) else np.zeros((0, 2), np.uint64)
        return pa.table({"a": pa.array(found[:, 0].astype(np.uint64).view(np.int64)), "b": pa.array(found[:, 1].astype(np.uint64).view(np.int64))})

    return run


def links(prints: DataFrame, bits: int = 4) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all those linked by `bits` different bits at most.

    prints: a column print, distinct. bits: 4 at most, the bound that the keys are made for.
    """
    if bits > 4:
        raise ValueError("the keys find every link up to 4 different bits only")
    buckets = max(1, prints.count() * 64 // PER_BUCKET)
    sent = prints.select("print").mapInArrow(_keys(buckets), "bucket int, keys binary, prints binary")
    return sent.groupBy("bucket").applyInArrow(_links(bits), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of the edges (a, b) with the least node that it is connected to.

    Alternates large-star and small-star steps as joins with each node's least neighbour, so no node's neighbours meet
    in one group; each round is a checkpoint in the shared folder.
    """
    edges = written(edges.where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), "edges")
    while True:
        both = edges.union(edges.selectExpr("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").selectExpr("b a", "m b").where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").selectExpr("b a", "m b").union(low.selectExpr("a", "m b")).where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct()
        new = small.checkpoint()
        deep = new.join(new.selectExpr("b a").distinct(), "a", "left_semi").limit(1).count()  # a root that has a root
        many = new.groupBy("a").count().where("count > 1").limit(1).count()
        edges = new
        if not deep and not many:
            return edges.selectExpr("a node", "b root").union(edges.selectExpr("b", "b").distinct())


def near_duplicates(docs: DataFrame, shingle: int = 5, bits: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, print, component_id: the smallest doc_id reachable by links between fingerprints, its own included.

    docs: doc_id long, text string; other columns are left out. Null or empty texts have fingerprint zero and are linked
    like any other. Rows with a null doc_id keep it, and give no component its number unless all its ids are null.
    Repeated rows come back as often as they were given.
    """
    prints = written(fingerprints(docs, shingle, seed), "prints")
    distinct = written(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct, bits)).withColumnRenamed("node", "print")
    rooted = distinct.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
    first = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(first, "root").select("print", "component_id"), "print").select("doc_id", "print", "component_id")


# Near duplicates by shingle similarity. A first round joins what the same keys, over two fingerprints of word pairs, find
# cheaply: word pairs change less than longer shingles, so texts with similar shingle sets have close prints. A second
# round is exact: of two sets as similar as asked, both hold one of the rarest few shingles of either (prefix filter), so
# all pairs that share one, could be similar by their sizes and places, and are not yet in one component are verified.

SEEDS = (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))
SKETCH_BUCKET = 1 << 19  # entries of sketches that one task merges
BUCKETS = 64  # at least: a node goes to about 36 of them at any size, so what is shuffled follows the input
SET_BYTES = 32 << 20  # of shingle sets in one bucket of their table
JOIN_BUCKET = 1 << 21  # entries (shingle, node) of the exact round that one task joins
FREQUENT = 1 << 20  # shingles whose count orders them
CLOSE = 26  # of 128 bits: texts of similarity 0.8 in five-word shingles differ in about 12


def _words(part: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(each row's key: the digest of its lower-case words, word hashes, first word of each row)."""
    keys = [hashlib.md5(b" ".join((x or b"").lower().split())).digest() for x in part.column("text").cast(pa.binary()).to_pylist()]
    raw, at = W.text_bytes(part.column("text"))
    raw = W.lower_ascii()[raw]
    starts, ends, per = W.split(raw, at, W.not_space())
    return keys, W.hashes(raw, starts, ends), per


def _word_key(text: str):
    """The key of `_words` as a column."""
    spaced = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " "))
    return F.unhex(F.md5(F.translate(spaced, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").cast("binary")))


def _sketches(batches):
    """Per row: key of its word sequence, and two fingerprints of its distinct word pairs (repeats count once, as in the sets)."""
    tokens.release()
    for batch in batches:
        for part in slices(batch, "text"):
            keys, h, per = _words(part)
            prints = [[], []]
            for i, j in zip(per[:-1].tolist(), per[1:].tolist(), strict=True):
                own = h[i:j]
                pairs = np.unique(W.combine(own, 2) if j - i > 1 else own)
                for seed, out in zip(SEEDS, prints, strict=True):
                    bits = np.unpackbits(W.mix(pairs ^ seed).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    out.append(int.from_bytes(np.packbits(bits.sum(0, dtype=np.int64) * 2 > len(pairs), bitorder="little").tobytes(), "little"))
            a, b = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in prints)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(keys, pa.binary()), a, b], ["doc_id", "key", "p0", "p1"])


def _sketch_keys(buckets: int):
    def run(batches):
        code = Golay()
        for batch in batches:
            node = batch.column("node").to_numpy()
            prints = [batch.column(c).to_numpy().view(np.uint64) for c in ("p0", "p1")]
            keys, rows = [], []
            for which, x in enumerate(prints):
                seg = [code.keys((x >> np.uint64(at)).astype(np.int64) & ((1 << n) - 1), n) for at, n in SEGMENTS]
                for p, (a, b) in enumerate(PAIRS):
                    for i in range(seg[a].shape[1]):
                        for j in range(seg[b].shape[1]):
                            ok = np.flatnonzero((seg[a][:, i] >= 0) & (seg[b][:, j] >= 0))
                            keys.append(((which * 3 + p) << 24) + (seg[a][ok, i].astype(np.int64) << 12) + seg[b][ok, j])
                            rows.append(ok)
            keys, rows = np.concatenate(keys).astype(np.uint32), np.concatenate(rows)
            # by the first segment's codeword, of which a print has 6 at most for each pair of segments: so a node goes
            # to 36 buckets at most, however many there are; more buckets than codewords split by the second's
            first, second = keys >> np.uint32(12), keys & np.uint32(4095)
            split = np.uint32(max(1, -(-buckets // 8192)))
            bucket = ((first * split + second % split) * np.uint32(2654435761) >> np.uint32(8)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            has = np.flatnonzero(np.diff(cuts))
            parts = [order[cuts[b] : cuts[b + 1]] for b in has]
            # a bucket gets each node of the batch once, and entries (key, place among those nodes)
            cols = {"bucket": pa.array(has.astype(np.int32)), "keys": [], "rows": [], "nodes": [], "prints": []}
            for i in parts:
                local, inverse = np.unique(rows[i], return_inverse=True)
                cols["keys"].append(keys[i].tobytes())
                cols["rows"].append(inverse.astype(np.uint32).tobytes())
                cols["nodes"].append(node[local].tobytes())
                cols["prints"].append(np.stack([p[local] for p in prints], 1).tobytes())
            yield pa.RecordBatch.from_pydict({k: v if k == "bucket" else pa.array(v, pa.binary()) for k, v in cols.items()})

    return run


def _candidates(table: pa.Table) -> pa.Table:
    """Close pairs for the first round: of the partners that a node has in the bucket the nearest and the next by number.

    In a key of over 16 nodes a node is compared with its cluster's first and its neighbour only.
    """
    keys, at, nodes, prints, base = [], [], [], [], 0
    for k, r, n, p in zip(*(table[c].to_pylist() for c in ("keys", "rows", "nodes", "prints")), strict=True):
        keys.append(np.frombuffer(k, np.uint32))
        at.append(np.frombuffer(r, np.uint32).astype(np.int64) + base)
        nodes.append(np.frombuffer(n, np.int64))
        prints.append(np.frombuffer(p, np.uint64).reshape(-1, 2))
        base += len(nodes[-1])
    keys, at, nodes, prints = np.concatenate(keys), np.concatenate(at), np.concatenate(nodes), np.concatenate(prints)
    order = np.lexsort((nodes[at], keys))  # in a run, smaller nodes first: they lead clusters
    keys, at = keys[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(first, len(keys)))
    apart = lambda i, j: np.bitwise_count(prints[i] ^ prints[j]).sum(-1)
    # nodes that several mappers sent are one; pairs are numbers lower * count + higher, kept distinct as they come
    names, same = np.unique(nodes, return_inverse=True)
    found, waiting, held = np.zeros(0, np.int64), [], 0

    def note(i, j):
        nonlocal found, waiting, held
        i, j = np.minimum(same[i], same[j]), np.maximum(same[i], same[j])
        waiting.append((i * len(names) + j)[i != j])
        held += len(i)
        if held > 1 << 20:
            found, waiting, held = np.unique(np.concatenate([found, *waiting])), [], 0

    for i, n in zip(first[size > 16].tolist(), size[size > 16].tolist(), strict=True):
        left = at[i : i + n]
        near = apart(left[:-1], left[1:]) <= CLOSE
        note(left[:-1][near], left[1:][near])
        while len(left) > 1:
            lead, left = left[0], left[1:]
            near = apart(left, lead) <= CLOSE
            note(np.full(int(near.sum()), lead), left[near])
            left = left[~near]
    end = np.repeat(np.where(size <= 16, first + size, 0), size)
    for d in range(1, 16):
        i = np.flatnonzero(np.arange(len(at)) + d < end)
        if not len(i):
            break
        i = i[apart(at[i], at[i + d]) <= CLOSE]
        note(at[i], at[i + d])
    found = np.unique(np.concatenate([found, *waiting]))
    where = np.zeros(len(names), np.int64)
    where[same] = np.arange(len(nodes))
    a, b = found // max(1, len(names)), found % max(1, len(names))
    gap = apart(where[a], where[b]) if len(a) else np.zeros(0, np.int64)
    end, other, far, pair = np.concatenate([a, b]), np.concatenate([b, a]), np.tile(gap, 2), np.tile(np.arange(len(a)), 2)
    stay = np.zeros(len(a), bool)
    step = np.abs(other - end)  # ties go to the next by number, so no node is the partner of very many
    for order in (np.lexsort((step, end)), np.lexsort((step, far, end))):
        stay[pair[order[np.flatnonzero(np.diff(end[order], prepend=-1))]]] = True
    return pa.table({"a": pa.array(names[a[stay]]), "b": pa.array(names[b[stay]])})


def _shingle_sets(shingle: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                keys, h, per = _words(part)
                sets = [np.unique((W.combine(h[i:j], min(shingle, max(1, j - i))) >> np.uint64(32)).astype(np.uint32)).tobytes() for i, j in zip(per[:-1].tolist(), per[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["doc_id", "key", "shingles"])

    return run


def _tallies(batches):
    """Per batch: shingles that several of its nodes have, and how many do."""
    for batch in batches:
        sets = batch.column("shingles").to_pylist()
        found, n = np.unique(np.frombuffer(b"".join(sets), np.uint32), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found[n > 1].astype(np.int64)), pa.array(n[n > 1])], ["shingle", "n"])


def _frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that most nodes have, FREQUENT at most, and a lower bound of how many have each.

    They only order the shingles of a set. Any order gives the same pairs in the end; rare shingles first give few to verify.
    """
    top = sets.mapInArrow(_tallies, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    shingle, n = top["shingle"].to_numpy(), top["n"].to_numpy()
    order = np.argsort(shingle)
    return shingle[order].astype(np.uint32), n[order].astype(np.int32)


def _prefix(u: np.ndarray, similarity: float, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set, one of which it shares with every set similar to it."""
    seen = np.zeros(len(u), np.int32)
    if len(known) and len(u):
        at = np.minimum(np.searchsorted(known, u), len(known) - 1)
        seen = np.where(known[at] == u, counts[at], 0)
    return u[np.lexsort((u, seen))][: len(u) - int(np.ceil(similarity * len(u) - 1e-9)) + 1]


def _deal(buckets: int, similarity: float, known: np.ndarray, counts: np.ndarray):
    """One row for each batch and bucket: entries (shingle, place among the row's nodes, place in the prefix)."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1 << 12):
                part = batch.slice(start, 1 << 12)
                node, root = (part.column(c).to_numpy() for c in ("node", "root"))
                sets = [np.frombuffer(x, np.uint32) for x in part.column("shingles").to_pylist()]
                size = np.array([len(x) for x in sets], np.int32)
                prefixes = [_prefix(x, similarity, known, counts) for x in sets]
                per = np.array([len(x) for x in prefixes], np.int64)
                keys = np.concatenate(prefixes)
                rows = np.repeat(np.arange(len(per)), per)
                place = np.minimum(np.arange(len(keys)) - np.repeat(np.cumsum(per) - per, per), 65535)
                bucket = (W.mix(keys.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                has = np.flatnonzero(np.diff(cuts))
                cols: dict = {c: [] for c in ("keys", "rows", "places", "nodes", "roots", "sizes")}
                for b in has:
                    i = order[cuts[b] : cuts[b + 1]]
                    local, inverse = np.unique(rows[i], return_inverse=True)
                    parts = (keys[i], inverse.astype(np.uint16), place[i].astype(np.uint16), node[local], root[local], size[local])
                    for c, x in zip(cols.values(), parts, strict=True):
                        c.append(x.tobytes())
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(has.astype(np.int32))} | {c: pa.array(x, pa.binary()) for c, x in cols.items()})

    return run


def _crossing(similarity: float):
    """All pairs that share a shingle of their prefixes, lie in two components, and may be similar by size and place."""
    rate = similarity / (1 + similarity)

    def run(table: pa.Table) -> pa.Table:
        cols: dict = {"keys": np.uint32, "rows": np.uint16, "places": np.uint16, "nodes": np.int64, "roots": np.int64, "sizes": np.int32}
        got = {c: [np.frombuffer(x, t) for x in table[c].to_pylist()] for c, t in cols.items()}
        base = np.cumsum([0] + [len(x) for x in got["nodes"]])
        at = np.concatenate([x + b for x, b in zip(got["rows"], base, strict=False)])
        keys, place, nodes, roots, sizes = (np.concatenate(got[c]) for c in ("keys", "places", "nodes", "roots", "sizes"))
        del got
        order = np.lexsort((sizes[at], keys))
        keys, at, place = keys[order], at[order], place[order].astype(np.int64)
        first = np.flatnonzero(np.diff(keys, prepend=keys[:1] + np.uint32(1)) != 0)
        many = np.diff(np.append(first, len(keys)))
        root = roots[at]
        differ = np.minimum.reduceat(root, first) != np.maximum.reduceat(root, first)
        stay = np.repeat(differ, many)
        at, place, root, many = at[stay], place[stay], root[stay], many[differ]
        first = np.cumsum(many) - many
        size = sizes[at].astype(np.int64)
        found, waiting, held = np.zeros(0, np.int64), [], 0

        def note(i, j):
            nonlocal found, waiting, held
            least = rate * (size[i] + size[j]) - 1e-9
            most = np.minimum(size[i] - place[i], size[j] - place[j])  # of the shared shingles, if this is their first
            ok = (root[i] != root[j]) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9) & (most >= least)
            x, y = np.broadcast_to(at[i], ok.shape)[ok], at[j][ok]
            waiting.append(np.minimum(x, y) * len(nodes) + np.maximum(x, y))
            held += len(x)
            if held > 1 << 20:
                found, waiting, held = np.unique(np.concatenate([found, *waiting])), [], 0

        for i, n in zip(first[many > 64].tolist(), many[many > 64].tolist(), strict=True):
            group, own = np.arange(i, i + n), root[i : i + n]
            names, n_own = np.unique(own, return_counts=True)
            for k in group[own != names[n_own.argmax()]].tolist():  # members of the largest component meet the others here
                low, high = np.searchsorted(size[i : i + n], [similarity * size[k] - 1e-9, size[k] / similarity + 1e-9])
                note(k, group[low : high + 1])
        end = np.repeat(np.where(many <= 64, first + many, 0), many)
        for d in range(1, 64):
            i = np.flatnonzero(np.arange(len(at)) + d < end)
            if not len(i):
                break
            note(i, i + d)
        found = np.unique(np.concatenate([found, *waiting]))
        return pa.table({"a": pa.array(nodes[found // max(1, len(nodes))]), "b": pa.array(nodes[found % max(1, len(nodes))])})

    return run


def _verified(similarity: float):
    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                u, v = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                small, large = (u, v) if len(u) < len(v) else (v, u)
                both = 0
                if len(small) >= similarity * len(large) and len(small):  # length bound
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    both = int((large[at] == small).sum())
                ok.append(both >= similarity * (len(u) + len(v) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _named(rows: DataFrame) -> DataFrame:
    """rows with `id`: doc_id, or for a null doc_id a number above all ids, one for each key."""
    most = rows.agg(F.max("doc_id").alias("most"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")).first()
    if not most.nulls:
        return rows.withColumn("id", F.col("doc_id"))
    keys = rows.where("doc_id is null").select("key").distinct().withColumn("n", F.monotonically_increasing_id())
    keys = written(keys.select("key", (F.col("n") + F.lit(max(most.most or 0, 0) + 1)).alias("__id")), "unnamed")
    unnamed = rows.where("doc_id is null").join(keys, "key").withColumnRenamed("__id", "id")
    return rows.where("doc_id is not null").withColumn("id", F.col("doc_id")).unionByName(unnamed)


def similar_classes(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, key, id, least: the class of every row of docs (doc_id, text) by its smallest id.

    Rows are linked if their words agree (A-Z lower-cased), or if their sets of `shingle`-word shingles have a Jaccard
    similarity of at least `similarity` (of 32-bit hashes); a class is all that links connect. Fingerprints of word pairs
    find most links first. Every other pair that shares a shingle of its prefixes is then verified unless its ends are
    already in one component, so no link between two components is missed.

    id is doc_id; rows with a null doc_id get an id above all others, one for each word sequence (key), and are linked like
    any other. Rows of one doc_id are one document: its shingles are those of the row with the least key. Null or empty
    texts have no words and are copies of each other. doc_ids must leave room above them: 2^62 at most.
    """
    spark = docs.sparkSession
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = _named(written(table.mapInArrow(_sketches, "doc_id long, key binary, p0 long, p1 long"), "sketches"))
    # a node is a word sequence, named by the smallest id of its rows
    one = rows.groupBy("id").agg(F.min(F.struct("key", "p0", "p1")).alias("m")).select("id", "m.*")
    nodes = written(one.groupBy("key").agg(F.min("id").alias("node"), F.first("p0").alias("p0"), F.first("p1").alias("p1")), "nodes")
    buckets = max(BUCKETS, nodes.count() * 160 // SKETCH_BUCKET)
    sent = nodes.select("node", "p0", "p1").mapInArrow(_sketch_keys(buckets), "bucket int, keys binary, rows binary, nodes binary, prints binary")
    at = [new_path(spark, n) for n in ("pairs", "sets", "crossing")]
    sent.groupBy("bucket").applyInArrow(_candidates, "a long, b long").distinct().write.parquet(at[0])
    pairs = spark.read.schema("a long, b long").parquet(at[0])
    name = f"shingle_sets_{uuid.uuid4().hex}"
    sets = _set_table(table, rows, nodes, shingle, name, at[1])

    def verified(some: DataFrame) -> DataFrame:
        joined = some.join(sets.selectExpr("node as a", "shingles as x").hint("merge"), "a").join(sets.selectExpr("node as b", "shingles as y").hint("merge"), "b")
        return joined.select("a", "b", "x", "y").mapInArrow(_verified(similarity), "a long, b long")

    # first what the fingerprints have found, which joins dense groups
    edges = written(verified(pairs), "edges")
    roots = written(components(edges), "roots")
    # then, exactly, what still lies between components
    size = F.length("shingles") / 4
    entries = sets.agg(F.sum(size - F.ceil(similarity * size) + 1).alias("n")).first()["n"] or 0
    dealt = sets.join(roots.hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "shingles")
    dealt = dealt.mapInArrow(_deal(max(BUCKETS, int(entries) // JOIN_BUCKET), similarity, *_frequent(sets)), "bucket int, keys binary, rows binary, places binary, nodes binary, roots binary, sizes binary")
    dealt.groupBy("bucket").applyInArrow(_crossing(similarity), "a long, b long").selectExpr("least(a, b) a", "greatest(a, b) b").distinct().write.parquet(at[2])
    more = written(verified(spark.read.schema("a long, b long").parquet(at[2])), "edges")
    if not more.isEmpty():
        roots = written(components(edges.unionByName(more)), "roots")
    spark.sql(f"drop table {name}")
    for path in at:
        delete(spark, path)
    same = one.select("id", "key").join(nodes.select("key", "node"), "key").join(roots, "node", "left").select("id", F.coalesce("root", "node").alias("least"))
    return rows.select("doc_id", "key", "id").join(same, "id")


def _set_table(table: DataFrame, rows: DataFrame, nodes: DataFrame, shingle: int, name: str, path: str) -> DataFrame:
    """node, shingles of all nodes with words, as a table bucketed by node: its joins shuffle the other side only."""
    found = table.mapInArrow(_shingle_sets(shingle), "doc_id long, key binary, shingles binary").where("length(shingles) > 0")
    named = found.where("doc_id is not null").withColumnRenamed("doc_id", "node")
    if not rows.where("doc_id is null").isEmpty():
        ids = rows.where("doc_id is null").select("key", F.col("id").alias("node")).distinct()
        named = named.unionByName(found.where("doc_id is null").drop("doc_id").join(ids, "key").dropDuplicates(["key"]).select("node", "key", "shingles"))
    n_bytes = table.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    n = max(BUCKETS, n_bytes // SET_BYTES)
    kept = named.repartition(n, "node").join(nodes.select("node").hint("merge"), "node", "left_semi")
    sets = kept.groupBy("node").agg(F.min(F.struct("key", "shingles")).alias("m")).select("node", "m.shingles")
    sets.write.option("compression", "none").bucketBy(n, "node").sortBy("node").option("path", path).saveAsTable(name)
    return table.sparkSession.table(name)


def keep_first(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs (all columns) that stay: of each class of similar texts the row with the smallest doc_id.

    Of several rows with that id the one with the least text stays. Rows with a null doc_id come after all others; one of
    them stays if its class holds no row with an id.
    """
    from pyspark.sql import Window

    found = written(similar_classes(docs.select("doc_id", "text"), shingle, similarity).where("id = least"), "first")
    # merge: what is shuffled follows the input at every size
    kept = docs.where("doc_id is not null").join(found.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    if not kept.groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = kept.withColumn("__row", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where("__row = 1").drop("__row")
    alone = found.where("doc_id is null").select("key").distinct()
    if alone.isEmpty():
        return kept.select(*docs.columns)
    unnamed = docs.where("doc_id is null").withColumn("__key", _word_key("text")).join(alone.withColumnRenamed("key", "__key"), "__key", "left_semi")
    return kept.select(*docs.columns).unionByName(unnamed.dropDuplicates(["__key"]).select(*docs.columns))
