"""Collocations by set-oriented relational mining.

R(k) is the relation of all occurrences of frequent phrases of k words: (piece, position, phrase), sorted by piece and
position. One step makes R(k + 1): R(k) is merge-joined with itself where a position follows another in the same piece,
the joined rows are grouped and counted by phrase, and a semi-join with the frequent phrases keeps the rest out before
they are extended. Both halves of a frequent phrase are frequent, so nothing is lost.

A relation is kept packed: one row for each block of texts, with sorted arrays of positions and phrases. Positions count
the words of a block and skip one at the end of each piece, so `following` means "adjacent in one piece", and a join needs
no shuffle. For the grouping a block sends its distinct phrases with their counts to buckets, by a hash; a bucket adds
them up and tells each block the numbers of the frequent ones. A very common phrase is one entry for each block. Every
relation and every bucket's answer is written to the shared folder before the next step reads it.

Phrases are compared as words or as pairs of numbers of frequent phrases, never by hashes alone; only inside a block are
words told apart by 64-bit hashes.
"""

from __future__ import annotations

import re
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import delete, new_path, trim, written

BLOCK_BYTES = 4 << 20  # text of one block; longer texts are cut between pieces
BUCKET = 1 << 18  # entries that one bucket adds up, about
SALTS = 64  # parts of a language that are ranked apart before their first rows are ranked together
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_END = re.compile(rb"[.,;:!?\x0A-\x0D]")
_RELATION = "block long, places binary, phrases binary, keys binary, counts binary, n_keys long, totals array<struct<lang: string, n: long>>"
_MERGED = "block long, `at` int, told binary, id long, word string, lang string, prefix long, suffix long, f long"


_SCHEMA = pa.schema(
    [("block", pa.int64()), ("places", pa.binary()), ("phrases", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary()), ("n_keys", pa.int64())]
    + [("totals", pa.list_(pa.struct([("lang", pa.string()), ("n", pa.int64())])))]
)


def _pack(x: np.ndarray) -> bytes:
    """Array bytes, like places together, compressed; the first 8 bytes are the length."""
    raw = x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 6).compress(raw, asbytes=True)


def _unpack(z: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(pa.Codec("zstd").decompress(z[8:], int.from_bytes(z[:8], "little"), asbytes=True), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).reshape(-1)


def _pack_keys(keys: pa.Array) -> bytes:
    """A binary array in two packed parts: lengths and bytes."""
    at = np.frombuffer(keys.buffers()[1], np.int64, len(keys) + 1, keys.offset * 8)
    size, data = _pack(np.diff(at).astype("<u4")), keys.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return len(size).to_bytes(8, "little") + size + _pack(raw)


def _unpack_keys(z: bytes) -> pa.Array:
    n = int.from_bytes(z[:8], "little")
    at = np.concatenate([[0], np.cumsum(_unpack(z[8 : 8 + n], "<u4"), dtype=np.int64)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(_unpack(z[8 + n :], "u1"))])


def _texts(batches):
    """(lang, bytes) of all texts; a text longer than a block comes in parts that end where a piece does."""
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
            raw, at = text.as_py() or b"", 0
            while len(raw) - at > BLOCK_BYTES and (end := _END.search(raw, at + BLOCK_BYTES)):
                yield lang, raw[at : end.end()]
                at = end.end()
            yield lang, raw[at:] if at else raw


def _relation(block: int, places: np.ndarray, phrases: np.ndarray, keys: pa.Array, counts: np.ndarray, totals: list) -> pa.RecordBatch:
    row = {"block": block, "places": _pack(np.diff(places, prepend=0).astype("<u4")), "phrases": _pack(phrases.astype("<u4")), "keys": _pack_keys(keys), "counts": _pack(counts.astype("<i8")), "n_keys": len(keys), "totals": totals}
    return pa.RecordBatch.from_pylist([row], _SCHEMA)


def _first(block: int, texts: list[tuple[str, bytes]]) -> pa.RecordBatch | None:
    """All word occurrences of one block; a key is the word, a space, its language."""
    names = sorted({lang for lang, _ in texts})
    raw, at = W.text_bytes(pa.array([x for _, x in texts], pa.large_binary()))
    raw = W.lower_ascii()[raw]
    ends = np.zeros(256, bool)
    ends[list(PIECE_ENDS)] = True
    inside = ~ends
    inside[[0x20, 0x09]] = False
    s, e, per = W.split(raw, at, inside)
    if not len(s):
        return None
    gone = np.cumsum(ends[raw])[s]  # ends of pieces before each word
    broken = np.concatenate([[False], gone[1:] != gone[:-1]])
    broken[per[1:-1][per[1:-1] < len(s)]] = True
    places = np.arange(len(s)) + np.cumsum(broken)
    lang = np.repeat(np.array([names.index(x) for x, _ in texts]), np.diff(per))
    h = W.mix(W.hashes(raw, s, e) + lang.astype(np.uint64))
    _, first, phrases, counts = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    data, codes = raw.tobytes(), [b" " + x.encode() for x in names]
    keys = pa.array([data[i:j] + codes[k] for i, j, k in zip(s[first].tolist(), e[first].tolist(), lang[first].tolist(), strict=True)], pa.large_binary())
    n = np.bincount(lang, minlength=len(names)).tolist()
    return _relation(block, places, phrases, keys, counts, [{"lang": x, "n": k} for x, k in zip(names, n, strict=True)])


def _occurrences(batches):
    """The word relation, block by block."""
    task, number = TaskContext.get(), count()
    have, size = [], 0
    block = lambda: ((task.partitionId() if task else 0) << 32) + next(number)
    for lang, text in _texts(batches):
        if have and size + len(text) > BLOCK_BYTES:
            if (row := _first(block(), have)) is not None:
                yield row
            have, size = [], 0
        have.append((lang, text))
        size += len(text)
    if have and (row := _first(block(), have)) is not None:
        yield row
    trim()


def _bucket(keys: pa.Array, buckets: int) -> np.ndarray:
    at = np.frombuffer(keys.buffers()[1], np.int64, len(keys) + 1, keys.offset * 8)
    return W.hashes(np.frombuffer(keys.buffers()[2], np.uint8), at[:-1], at[1:]) % np.uint64(buckets)


def _in_buckets(keys: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of keys by bucket, where each bucket begins in it)."""
    to = _bucket(keys, buckets)
    order = np.argsort(to, kind="stable")
    return order, np.searchsorted(to[order], np.arange(buckets + 1, dtype=np.uint64))


def _send(buckets: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, counts = _unpack_keys(row["keys"]), _unpack(row["counts"], "<i8")
                order, cuts = _in_buckets(keys, buckets)
                keys, counts = keys.take(pa.array(order)), counts[order]
                has = np.flatnonzero(np.diff(cuts)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(has, pa.int32()), pa.array([row["block"]] * len(has), pa.int64()), pa.array(cuts[has], pa.int32()),
                        pa.array([_pack_keys(keys.slice(cuts[b], cuts[b + 1] - cuts[b])) for b in has], pa.binary()),
                        pa.array([_pack(counts[cuts[b] : cuts[b + 1]]) for b in has], pa.binary()),
                    ],
                    ["bucket", "block", "at", "keys", "counts"],
                )

    return run


def _merge(least: int, single: bool):
    """One bucket: frequent phrases with numbers and counts, and to each block the numbers (plus 1) of its entries, or 0."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        parts = [_unpack_keys(x) for x in table["keys"].to_pylist()]
        code = pa.concat_arrays(parts).dictionary_encode()
        which = code.indices.to_numpy()
        n = np.zeros(len(code.dictionary), np.int64)
        np.add.at(n, which, np.concatenate([_unpack(x, "<i8") for x in table["counts"].to_pylist()]))
        often = n >= least
        number = np.where(often, np.cumsum(often), 0).astype("<u4")
        cuts = np.cumsum([0] + [len(x) for x in parts])
        told = [number[which[i:j]] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        back = [k for k, x in enumerate(told) if x.any()]
        keys = code.dictionary.filter(pa.array(often)).to_pylist()
        ids = (table["bucket"][0].as_py() << 32) + np.arange(len(keys))
        word, lang, prefix, suffix = [], [], None, None
        if single:
            word, _, lang = zip(*(k.partition(b" ") for k in keys), strict=True) if keys else ([], [], [])
            word, lang = [x.decode("utf-8", "replace") for x in word], [x.decode() for x in lang]
        else:
            pairs = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            prefix, suffix = pairs[:, 0], pairs[:, 1]
        none = lambda k, kind: pa.nulls(k, kind)
        a, b = len(back), len(keys)
        both = lambda x, y: pa.concat_arrays([x, y])
        blocks, at = table["block"].to_pylist(), table["at"].to_pylist()
        return pa.table(
            {
                "block": both(pa.array([blocks[k] for k in back], pa.int64()), none(b, pa.int64())),
                "at": both(pa.array([at[k] for k in back], pa.int32()), none(b, pa.int32())),
                "told": both(pa.array([table["bucket"][0].as_py().to_bytes(8, "little") + _pack(told[k]) for k in back], pa.binary()), none(b, pa.binary())),
                "id": both(none(a, pa.int64()), pa.array(ids, pa.int64())),
                "word": both(none(a, pa.string()), pa.array(word, pa.string()) if single else none(b, pa.string())),
                "lang": both(none(a, pa.string()), pa.array(lang, pa.string()) if single else none(b, pa.string())),
                "prefix": both(none(a, pa.int64()), none(b, pa.int64()) if single else pa.array(prefix, pa.int64())),
                "suffix": both(none(a, pa.int64()), none(b, pa.int64()) if single else pa.array(suffix, pa.int64())),
                "f": both(none(a, pa.int64()), pa.array(n[often], pa.int64())),
            }
        )

    return run


def _extend(buckets: int):
    """Semi-join of a block's occurrences with the frequent phrases, then the merge join of those that follow each other."""

    def run(relation: pa.Table, answers: pa.Table) -> pa.Table:
        if not relation.num_rows or not answers.num_rows:
            return _SCHEMA.empty_table()
        row = relation.to_pylist()[0]
        keys = _unpack_keys(row["keys"])
        order, _ = _in_buckets(keys, buckets)
        ids = np.full(len(keys), -1, np.int64)
        for at, told in zip(answers["at"].to_pylist(), answers["told"].to_pylist(), strict=True):
            number = _unpack(told[8:], "<u4").astype(np.int64)
            ids[order[at : at + len(number)]] = np.where(number > 0, (int.from_bytes(told[:8], "little") << 32) + number - 1, -1)
        places = np.cumsum(_unpack(row["places"], "<u4"), dtype=np.int64)
        phrases = _unpack(row["phrases"], "<u4")
        known = ids >= 0
        stay = known[phrases]
        places, phrases = places[stay], phrases[stay]
        follows = np.flatnonzero(places[1:] == places[:-1] + 1)
        if not len(follows):
            return _SCHEMA.empty_table()
        # both numbers of a pair fit in 32 bits inside a block
        pair = (phrases[follows].astype(np.uint64) << np.uint64(32)) | phrases[follows + 1]
        distinct, now, counts = np.unique(pair, return_inverse=True, return_counts=True)
        two = np.stack([ids[distinct >> np.uint64(32)], ids[distinct & np.uint64(0xFFFFFFFF)]], 1).astype("<i8")
        offsets = np.arange(len(two) + 1, dtype=np.int64) * 16
        new = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(two), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(two))])
        return pa.Table.from_batches([_relation(row["block"], places[follows], now, new, counts, [])])

    return run


def frequent(docs: DataFrame, least: int, longest: int) -> tuple[list[DataFrame], DataFrame]:
    """([frequent phrases of 1, 2, ... words], totals): id, word and lang or prefix and suffix, f; and lang, n.

    prefix and suffix are ids of a phrase's words without the last, without the first, in the list's table before.
    """
    spark = docs.sparkSession
    table = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    relation = written(table.mapInArrow(_occurrences, _RELATION), "occurrences-1")
    totals = written(relation.select(F.explode("totals").alias("t")).groupBy("t.lang").agg(F.sum("t.n").alias("n")), "totals")
    tables: list[DataFrame] = []
    for k in range(1, longest + 1):
        entries = relation.agg(F.sum("n_keys").alias("n")).first().n or 0
        buckets = max(1, min(entries // BUCKET + 16, 1 << 30)) if entries else 1
        sent = relation.select("block", "keys", "counts").mapInArrow(_send(buckets), "bucket int, block long, `at` int, keys binary, counts binary")
        merged = written(sent.groupBy("bucket").applyInArrow(_merge(least, k == 1), _MERGED), f"merged-{k}")
        columns = ["id", "word", "lang", "f"] if k == 1 else ["id", "prefix", "suffix", "f"]
        tables.append(written(merged.where("id is not null").select(*columns), f"frequent-{k}"))
        if k == longest or tables[-1].isEmpty():
            _drop(merged, relation)
            break
        answers = merged.where("block is not null").select("block", "at", "told")
        new = relation.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_extend(buckets), _RELATION)
        longer = written(new, f"occurrences-{k + 1}")
        _drop(merged, relation)
        relation = longer
    assert spark is docs.sparkSession
    return tables, totals


def _drop(*tables: DataFrame) -> None:
    for t in tables:
        for path in {f.rpartition("/")[0] for f in t.inputFiles()}:
            delete(t.sparkSession, path)


def _cuts(a: Column, n: Column) -> Column:
    """The cut with the least score, ties to the first: struct(score, k, l, r)."""
    wide = lambda c: c.cast("decimal(38,0)")  # noqa: E731  exact: counts are below 10^17, so products of two and 1000 fit
    each = F.transform(
        F.arrays_zip("pre", "suf"),
        lambda x, i: F.struct(F.call_function("div", wide(F.lit(1000)) * wide(a) * wide(n), wide(x["pre"]) * wide(x["suf"])).alias("score"), i.alias("k"), x["pre"].alias("l"), x["suf"].alias("r")),
    )
    return F.array_min(each)


def mine(docs: DataFrame, least: int = 100, longest: int = 5, cover: int = 100, top: int = 2000) -> DataFrame:
    """The `top` collocations of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    docs: lang string, text string; other columns are left out. A-Z is lower-cased, texts are split at
    ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at spaces and tabs into words. Phrases of 2 to `longest` words that occur
    a >= `least` times in pieces of a language of n words are cut in two where 1000 a n / (l r), rounded down, is least (l
    and r: how often the parts occur; the first such cut). A phrase inside a longer one that has at least `cover` per cent
    of its occurrences is left out. Order: score, a (both descending), phrase (its UTF-8 bytes).

    Null lang: "und"; null or empty text: no words. Rows with equal ids or texts count each. Texts of any length: longer
    ones than a block are cut between pieces. No rows, or nothing frequent: no rows.
    """
    tables, totals = frequent(docs, least, longest)
    now = tables[0].join(totals, "lang").select("id", "lang", "n", F.col("word").alias("phrase"), F.col("word").alias("tail"), "f", F.expr("array()").cast("array<bigint>").alias("pre"), F.expr("array()").cast("array<bigint>").alias("suf"))
    found: list[DataFrame] = []
    for t in tables[1:]:
        p, s = now.alias("p"), now.select("id", "tail", "f", "suf").alias("s")
        longer = t.alias("t").join(p, F.expr("t.prefix = p.id")).join(s, F.expr("t.suffix = s.id"))
        now = longer.selectExpr("t.id", "lang", "n", "concat(phrase, ' ', s.tail) as phrase", "s.tail", "t.f", "concat(pre, array(p.f)) as pre", "concat(array(s.f), s.suf) as suf", "t.prefix", "t.suffix")
        now = written(now, "candidates")
        found.append(now)
    out = None
    for k, c in enumerate(found):
        if k + 1 < len(found):
            inside = found[k + 1].select(F.explode(F.array("prefix", "suffix")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("more"))
            c = c.join(inside, "id", "left").where(f"more is null or 100 * more < {int(cover)} * f").drop("more")
        c = c.select("lang", "phrase", F.col("f").alias("a"), "n", _cuts(F.col("f"), F.col("n")).alias("cut"))
        out = c if out is None else out.unionByName(c)
    kinds = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
    if out is None:
        return docs.sparkSession.createDataFrame([], kinds)
    out = out.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").cast("long").alias("score"), F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    order = "order by score desc, a desc, phrase"
    out = out.withColumn("rank", F.expr(f"row_number() over (partition by lang, salt {order})")).where(F.col("rank") <= top)
    out = out.withColumn("rank", F.expr(f"cast(row_number() over (partition by lang {order}) as bigint)")).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
