"""Benchmark decontamination by a prefix-filtered set join.

An item's windows (10 consecutive words, or a shorter item whole) are the sets; their tokens are word shingles. A
document that holds a window holds every shingle of it, so one necessary shingle is enough to join on: the one that is
rarest in the documents. Where it is found, its place in the window bounds where the window would start and end in the
document (positional and length bounds), and the window is verified word by word.

Benchmark items come in waves of bounded size, each broadcast; the documents are scanned once to count the wave's
shingles and once to join. Documents are never shuffled, and carry what earlier waves found along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .shared import others, slices, trim

WAVE_BYTES = 4 << 20  # item text of one wave
SHINGLE = 4  # words of a shingle; shorter windows are one shingle
_SLOTS = 1 << 20


def _hashed(texts) -> tuple[np.ndarray, np.ndarray]:
    raw, at = W.text_bytes(texts)
    raw = W.lower_ascii()[raw]
    s, e, per = W.split(raw, at, W.alphanumeric())
    return W.hashes(raw, s, e), per


class Windows:
    """Distinct windows of one wave: words (padded), length, items; and their shingles."""

    def __init__(self, items: list[tuple], window: int) -> None:
        h, per = _hashed(pa.array([t for _, t in items], pa.string()))
        seen: dict[bytes, int] = {}
        self.items: list[set[str]] = []
        rows, lengths = [], []
        for (item, _), a, b in zip(items, per[:-1].tolist(), per[1:].tolist(), strict=True):
            n = min(window, b - a)
            for i in range(a, b - n + 1) if n else ():
                key = h[i : i + n].tobytes()
                if key not in seen:
                    seen[key] = len(rows)
                    rows.append(np.concatenate([h[i : i + n], np.zeros(window - n, np.uint64)]))
                    lengths.append(n)
                    self.items.append(set())
                self.items[seen[key]].add(str(item))
        self.words = np.array(rows, np.uint64).reshape(-1, window)
        self.length = np.array(lengths, np.int64)
        self.shingle = np.minimum(self.length, SHINGLE)
        own = [(self._of(w), np.full(n - k + 1, w), np.arange(n - k + 1)) for w, (n, k) in enumerate(zip(lengths, self.shingle.tolist(), strict=True))]
        self.token = np.concatenate([o[0] for o in own]) if own else np.zeros(0, np.uint64)
        self.of = np.concatenate([o[1] for o in own]) if own else np.zeros(0, np.int64)
        self.place = np.concatenate([o[2] for o in own]) if own else np.zeros(0, np.int64)

    def _of(self, w: int) -> np.ndarray:
        return W.combine(self.words[w, : self.length[w]], int(self.shingle[w]))

    def choose(self, count: dict[int, int]) -> None:
        """Keeps each window's rarest shingle, ties to the smaller hash, sorted by shingle."""
        n = np.array([count.get(int(t), 0) for t in self.token.view(np.int64)], np.int64)
        order = np.lexsort((self.token, n, self.of))
        first = order[np.concatenate([[True], np.diff(self.of[order]) > 0])] if len(order) else order
        first = first[np.argsort(self.token[first], kind="stable")]
        self.token, self.of, self.place = self.token[first], self.of[first], self.place[first]


def _lookup(tokens: np.ndarray):
    """Finds which hashes are among the sorted tokens, past a bit table that most fail."""
    table = np.zeros(_SLOTS, bool)
    table[(tokens % np.uint64(_SLOTS)).astype(np.int64)] = True

    def find(h: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(table[(h % np.uint64(_SLOTS)).astype(np.int64)])
        at = np.searchsorted(tokens, h[maybe])
        return maybe[(at < len(tokens)) & (tokens[np.minimum(at, len(tokens) - 1)] == h[maybe])] if len(tokens) else maybe[:0]

    return find


def _count(shared, sizes: list[int]):
    def run(batches):
        tokens = shared.value
        find = _lookup(tokens)
        total = np.zeros(len(tokens), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                h, per = _hashed(part.column("text"))
                for k in sizes:
                    g, ok = W.combine(h, k), W.whole(per, k)
                    hit = find(g)
                    inside = np.zeros(len(g), bool)
                    inside[ok] = True
                    total += np.bincount(np.searchsorted(tokens, g[hit[inside[hit]]]), minlength=len(tokens))
        some = np.flatnonzero(total)
        trim()
        yield pa.RecordBatch.from_pydict({"token": pa.array(tokens[some].view(np.int64)), "n": pa.array(total[some])})

    return run


def _join(shared, keep_text: bool, names: list[str]):
    def run(batches):
        w = shared.value
        find = _lookup(w.token)
        sizes = sorted(set(w.shingle[w.of].tolist()))
        for batch in batches:
            for part in slices(batch, "text"):
                h, per = _hashed(part.column("text"))
                n_docs = part.num_rows
                starts, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for k in sizes:
                    g = W.combine(h, k)
                    at = find(g)
                    lo, hi = np.searchsorted(w.token, g[at], "left"), np.searchsorted(w.token, g[at], "right")
                    entry = np.repeat(lo, hi - lo) + (np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo))
                    pos = np.repeat(at, hi - lo)
                    ok = w.shingle[w.of[entry]] == k
                    starts.append(pos[ok] - w.place[entry[ok]])
                    which.append(w.of[entry[ok]])
                start, win = np.concatenate(starts), np.concatenate(which)
                doc = np.searchsorted(per, np.maximum(start, 0), side="right") - 1
                fits = (start >= 0) & (start + w.length[win] <= per[np.minimum(doc + 1, n_docs)])
                start, win, doc = start[fits], win[fits], doc[fits]
                for j in range(w.words.shape[1]):
                    same = (j >= w.length[win]) | (h[np.minimum(start + j, len(h) - 1)] == w.words[win, j]) if len(start) else np.zeros(0, bool)
                    start, win, doc = start[same], win[same], doc[same]
                gone = np.zeros(len(h) + 1, np.int64)
                np.add.at(gone, start, 1)
                np.add.at(gone, start + w.length[win], -1)
                gone = np.cumsum(gone)[:-1] > 0
                items: dict[int, set[str]] = {}
                for d, x in np.unique(np.stack([doc, win], 1), axis=0).tolist() if len(doc) else ():
                    items.setdefault(d, set()).update(w.items[x])
                spans, found = part.column("spans").to_pylist(), part.column("items").to_pylist()
                for d, more in items.items():
                    now = gone[per[d] : per[d + 1]]
                    for i, j in spans[d]:
                        now[i:j] = True
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], now.view(np.int8), [0]])))
                    spans[d] = edge.reshape(-1, 2).tolist()
                    found[d] = sorted(more | set(found[d]))
                got = {"doc_id": part.column("doc_id"), "n_words": pa.array(np.diff(per)), "spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))), "items": pa.array(found, pa.list_(pa.string())), "rest": part.column("rest")}
                if keep_text:
                    got["text"] = part.column("text")
                yield pa.RecordBatch.from_arrays([got[c] for c in names], names)
        trim()

    return run


def find(docs: DataFrame, items: DataFrame, window: int = 10, keep_text: bool = True) -> DataFrame:
    """doc_id, text (if kept), n_words, spans, items, rest: which words of a document lie in an item's window.

    docs: doc_id long, text string and any columns, which come back in rest. items: item_id, text. Words are
    ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z is lower-cased. spans: array of [first, end) word numbers, merged;
    items: item_ids with an occurring window, as sorted strings.

    Null or empty texts have no words and no windows; items with a null id take no part. Items of one id count as one
    item; repeated documents are judged each for itself. No items: nothing is found.
    """
    spark = docs.sparkSession
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), others(docs, "doc_id", "text"))
    named = items.where("item_id is not null and text is not null").select("item_id", F.col("text").cast("string").alias("text"))
    waves = max(1, -(-(named.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // WAVE_BYTES))
    kind = T.ArrayType(T.ArrayType(T.LongType()))
    out = table.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast(kind), "items": F.array().cast("array<string>")})
    for wave in range(waves):
        w = Windows([tuple(r) for r in named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(waves)) == wave).collect()], window)
        sizes = sorted(set(w.shingle.tolist()))
        tokens = np.unique(w.token)
        counted = table.select("text").mapInArrow(_count(spark.sparkContext.broadcast(tokens), sizes), "token long, n long") if len(tokens) else None
        w.choose({r.token: r.n for r in counted.groupBy("token").agg(F.sum("n").alias("n")).collect()} if counted else {})
        text = keep_text or wave < waves - 1
        names = ["doc_id", *(["text"] if text else []), "n_words", "spans", "items", "rest"]
        schema = T.StructType([T.StructField(c, {"doc_id": T.LongType(), "text": T.StringType(), "n_words": T.LongType(), "spans": kind, "items": T.ArrayType(T.StringType()), "rest": table.schema["rest"].dataType}[c]) for c in names])
        out = out.select("doc_id", "text", "n_words", "spans", "items", "rest").mapInArrow(_join(spark.sparkContext.broadcast(w), text, names), schema)
    return out
