"""Toxicity scores from a lexicon trie intersected with Levenshtein automata, and the context of each hit.

The lexicon is learned from labelled rows: words, and word beginnings, that mark toxic documents and hardly any others.
Its trie and the Levenshtein automata of all its words are walked together as one automaton, whose states (trie nodes
with the edits spent) are made when first needed, so a word is read once, whatever the size of the lexicon. Each hit is
weighed by its edits and by its context window: a hit between quotation marks or after a word of saying counts as
quotation, any other as abuse. A logistic model turns a document's counts into its score.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .labels import held_out, training
from .shared import slices, written

FIT_ROWS = 40_000  # labelled rows, by a hash of doc_id, that the lexicon and the model are learned from
WINDOW = 6  # words before a hit that may turn it into quotation
LEAST, PURE = 4, 0.9  # toxic rows, and share of toxic rows, of a lexicon entry
CHANCE = 0.01  # expected number of entries that are pure by chance
MEMO = 1_000_000  # words whose verdict one Python worker keeps
# Words of saying in the languages of the corpus.
SAYING = frozenset("said says say wrote writes called calls quoted quotes quote dijo dice escribió dit dix écrit sagte sagt schrieb".split())
QUOTES = "\"“”„«»"
FEATURES = ("abuse", "share", "fuzzy", "quoted", "log_words")


def plain(chunk: str) -> str:
    """A word in lower case without marks around it, and with common letter substitutes undone inside it."""
    w = chunk.lower().strip(".,;:!?()[]{}<>'`*_-~&%$#|\"“”„«»…")
    if w.isalpha():
        return w
    return w.translate(_LEET) if any(c.isalpha() for c in w) else w


_LEET = str.maketrans("013457@$!*", "oieastasi*")


class Automaton:
    """Least edits between a word and the entries of a lexicon, up to each entry's bound.

    An entry ending in "*" matches every word that begins with it, without edits. Others allow no edit below 5 letters,
    1 below 9 letters, else 2.
    """

    def __init__(self, entries: list[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.bound, self.ends, self.stems = [0], {}, set()
        for entry in sorted(entries):
            stem = entry.endswith("*")
            word = entry.rstrip("*")
            most = 0 if stem or len(word) < 5 else 1 if len(word) < 9 else 2
            at = 0
            self.bound[0] = max(self.bound[0], most)
            for c in word:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.bound.append(0)
                at = self.children[at][c]
                self.bound[at] = max(self.bound[at], most)
            if stem:
                self.stems.add(at)
            else:
                self.ends[at] = most
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.step: list[dict[str, int]] = []
        self.found: list[int] = []  # edits with which a word may end here, or -1
        self.start = self._state({0: 0})

    def _state(self, edits: dict[int, int]) -> int:
        work = list(edits.items())
        while work:  # letters of an entry that the word lacks
            node, d = work.pop()
            for child in self.children[node].values():
                if d + 1 <= self.bound[child] and d + 1 < edits.get(child, 99):
                    edits[child] = d + 1
                    work.append((child, d + 1))
        key = tuple(sorted(edits.items()))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.step.append({})
            self.found.append(min((d for n, d in key if d <= self.ends.get(n, -1)), default=-1))
        return self.number[key]

    def _next(self, state: int, c: str) -> int:
        edits: dict[int, int] = {}
        for node, d in self.states[state]:
            if node in self.stems and d == 0:  # reached with edits, it is only a place in a longer entry
                edits[node] = 0  # stays: the rest of the word is free
            for letter, child in self.children[node].items():
                cost = d + (letter != c)
                if cost <= self.bound[child] and cost < edits.get(child, 99) or letter == c and cost < edits.get(child, 99) and cost == 0:
                    edits[child] = cost
            if d + 1 <= self.bound[node] and d + 1 < edits.get(node, 99):
                edits[node] = d + 1
        out = self.step[state][c] = self._state(edits)
        return out

    def edits(self, word: str) -> int:
        """Least edits to an entry, -1 if none is near enough."""
        if len(self.states) > 200_000:  # made anew from what is needed next
            self.states, self.number, self.step, self.found = [], {}, [], []
            self.start = self._state({0: 0})
        at = self.start
        for c in word:
            to = self.step[at].get(c)
            at = self._next(at, c) if to is None else to
            if not self.states[at]:
                return -1
        if any(n in self.stems and d == 0 for n, d in self.states[at]):
            return 0
        return self.found[at]


class Scanner:
    """FEATURES of texts; remembers the verdict of words seen."""

    def __init__(self, entries: list[str]) -> None:
        self.automaton, self.memo = Automaton(entries), {}

    def _verdict(self, chunk: bytes) -> int:
        """0: no hit; 1: exact; 2: with edits."""
        e = self.automaton.edits(plain(chunk.decode("utf-8", "replace")))
        out = 0 if e < 0 else 1 if e == 0 else 2
        if len(self.memo) < MEMO:
            self.memo[chunk] = out
        return out

    def features(self, text: bytes) -> list[float]:
        chunks = text.split()
        got = list(map(self.memo.get, chunks))
        if None in got:
            got = [self._verdict(c) if v is None else v for c, v in zip(chunks, got, strict=True)]
        abuse = fuzzy = quoted = 0.0
        if any(got):
            inside = False
            for i, (c, v) in enumerate(zip(chunks, got, strict=True)):
                if not v and c.isalnum():
                    continue
                s = c.decode("utf-8", "replace")
                marks = sum(s.count(q) for q in QUOTES)
                if v:
                    before = [plain(x.decode("utf-8", "replace")) for x in chunks[max(0, i - WINDOW) : i]]
                    if inside or marks > 1 or s[:1] in QUOTES or not SAYING.isdisjoint(before):
                        quoted += 1
                    else:
                        abuse += 1 if v == 1 else 0.7
                        fuzzy += v == 2
                if marks % 2:
                    inside = not inside
        n = max(1, len(chunks))
        return [np.log1p(abuse), np.sqrt((abuse + 0.25 * quoted) / n), np.log1p(fuzzy), np.log1p(quoted), np.log1p(len(chunks)) / 10]


def _keys(text: str) -> set[str]:
    out = set()
    for w in {plain(c) for c in text.split()}:
        if w.isalpha() and 3 <= len(w) <= 40:
            out.add(w)
            out.update(w[:k] + "*" for k in range(4, min(len(w), 8)))
    return out


def _tally(only: frozenset | None):
    def run(batches):
        n: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                got = _keys(text or "")
                n.update(got if only is None else got & only)
            if len(n) > 200_000:
                yield pa.RecordBatch.from_pydict({"entry": pa.array(list(n), pa.string()), "n": pa.array(list(n.values()), pa.int64())})
                n.clear()
        yield pa.RecordBatch.from_pydict({"entry": pa.array(list(n), pa.string()), "n": pa.array(list(n.values()), pa.int64())})

    return run


def _sketch(batches):
    """Rows with the least hash of their runs of four words: copies and most near copies have one sketch."""
    for batch in batches:
        for part in slices(batch, "text"):
            raw, at = W.text_bytes(part.column("text"))
            s, e, per = W.split(raw, at, W.not_space())
            h = W.hashes(raw, s, e)
            whole = W.whole(per, 4)
            doc = np.searchsorted(per, whole, side="right") - 1
            out = np.full(part.num_rows, 2**64 - 1, np.uint64)
            np.minimum.at(out, doc, W.combine(h, 4)[whole] if len(whole) else np.zeros(0, np.uint64))
            short = np.flatnonzero(np.diff(per) < 4)
            out[short] = [np.bitwise_xor.reduce(h[per[i] : per[i + 1]], initial=0) for i in short.tolist()]
            yield pa.RecordBatch.from_arrays([part.column("text"), part.column("y"), pa.array(out.view(np.int64))], ["text", "y", "sketch"])


def learn_lexicon(rows: DataFrame) -> list[str]:
    """Entries from rows (text, y), at most FIT_ROWS of them: words and beginnings that are toxic beyond chance.

    Of rows with one sketch and label (copies) one counts. An entry needs PURE of its rows toxic, and so many that
    CHANCE entries at most would be pure by chance, were labels dealt at random. A beginning covers longer ones; words under
    it stay entries, since a beginning allows no edits. What reaches the driver is bounded by FIT_ROWS.
    """
    schema = "entry string, n long"
    sketched = rows.mapInArrow(_sketch, "text string, y int, sketch long")
    first = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")  # the same copy in every run
    rows = written(sketched.groupBy("y", "sketch").agg(first).select("text", "y", "sketch"), "distinct")
    share = min(0.5, (rows.where("y = 1").count() + 1) / (rows.count() + 2))
    bad = {r.entry: r.n for r in rows.where("y = 1").select("text").mapInArrow(_tally(None), schema).groupBy("entry").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST).collect()}
    least = max(LEAST, int(np.ceil(np.log(max(1, len(bad)) / CHANCE) / np.log(1 / share))))
    bad = {e: n for e, n in bad.items() if n >= least}
    if not bad:
        return []
    good = {r.entry: r.n for r in rows.where("y = 0").select("text").mapInArrow(_tally(frozenset(bad)), schema).groupBy("entry").agg(F.sum("n").alias("n")).collect()}
    pure = {e for e, n in bad.items() if n / (n + good.get(e, 0)) >= PURE and (good.get(e, 0) == 0 or n > 5 * good.get(e, 0) + 5)}
    stems = {e for e in pure if e.endswith("*") and bad[e] >= 2 * least}
    stems = {e for e in stems if not any(e[:k] + "*" in stems for k in range(4, len(e) - 1))}
    # the longest beginning that stands in as many rows: the shorter one is no stronger and may meet other words
    stems = {max((x for x in pure if x.endswith("*") and x[:-1].startswith(e[:-1]) and bad[x] == bad[e]), key=len) for e in stems}
    words = {e for e in pure if not e.endswith("*")}
    # a beginning is an entry only if several words share it; one word alone stands for itself and may be misspelled
    shared = {s for s in stems if len([w for w in words if w.startswith(s[:-1])]) != 1}
    return sorted(shared | words)


def _measure(entries: list[str], label: bool):
    def run(batches):
        scanner = Scanner(entries)
        for batch in batches:
            for part in slices(batch, "text"):
                x = [scanner.features(t or b"") for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("y" if label else "doc_id"), pa.array(x, pa.list_(pa.float64()))], ["y" if label else "doc_id", "x"])

    return run


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    a = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.eye(len(w)) * 0.05, a.T @ (p - y) + 0.05 * w)
        w = w - step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _score(entries: list[str], w: np.ndarray):
    def run(batches):
        scanner = Scanner(entries)
        for batch in batches:
            for part in slices(batch, "text"):
                x = np.array([scanner.features(t or b"") for t in part.column("text").cast(pa.binary()).to_pylist()]).reshape(-1, len(FEATURES))
                p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -500, 500)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold) of every row of docs (doc_id, text).

    labels: doc_id and label (0 or 1); nulls are left out, repeated labels count once. Learned from FIT_ROWS labelled
    rows at most, never held-out ones. Null texts count as empty and are scored too; rows with a null doc_id are scored
    and never learned from. Without labels of both kinds every score is class 1's share (0.5 without any).
    """
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # FIT_ROWS pairs of numbers: under a megabyte, whatever the corpus, so texts are not shuffled
    rows = written(table.join(F.broadcast(training(labels, label, FIT_ROWS)), "doc_id").select("text", "y"), "labelled")
    entries = learn_lexicon(rows)
    got = rows.mapInArrow(_measure(entries, True), "y int, x array<double>").groupBy("x", "y").agg(F.count("*").alias("n")).collect()  # FIT_ROWS at most
    seen = sorted((tuple(r.x), r.y, r.n) for r in got)
    ys = np.array([y for _, y, n in seen for _ in range(n)])
    if len(set(ys.tolist())) == 2:
        w = _fit_logistic(np.array([x for x, _, n in seen for _ in range(n)]), ys)
    else:
        w = np.zeros(len(FEATURES) + 1)
        w[-1] = 500.0 * (2 * float(ys[0]) - 1) if len(ys) else 0.0
    out = table.mapInArrow(_score(entries, w), "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
