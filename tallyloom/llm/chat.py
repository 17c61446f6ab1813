"""Chat formatting as prefix trees.

Conversations that begin with the same turns share those turns' tokens. Each distinct conversation is a path of turns;
paths sorted by the hashes of their turns lie depth first, so neighbours share beginnings. Runs of neighbours make packs
of bounded size: a pack holds a tree whose nodes are turns, their tokens once, depth first. A token's position id counts
along its path, and a node attends to its ancestors, which are given as merged token intervals, and causally to itself.
Ranges of paths, not first turns, are dealt to tasks: a first turn that a third of all conversations share is only
written once more for each pack.

Template of a turn, marks being ids of their own: ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts the
strings that templates use as marks get a backslash after their first character, and backslashes are doubled.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

PACK = 1 << 16  # tokens of a pack; a longer path has a pack of its own
START, END = "<|im_start|>", "<|im_end|>\n"
CONTROL = re.compile(r"\\|<\||</?s>|\[/?INST\]|<</?SYS>>")
PACK_SCHEMA = "ids binary, positions binary, loss binary, nodes array<struct<first: int, last: int, parent: int, attends: array<array<int>>>>, leaves array<struct<path: string, node: int>>"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n|)", lambda m: "\n" if m[1] == "n" else m[1], role)


_loaded: dict[tuple, Coder] = {}


class Coder:
    """Lossless byte-level ids of turns, and two ids of marks after the vocabulary."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.start = max(ranks.values()) + 1
        self.end = self.start + 1

    @classmethod
    def at(cls, path: str, pattern: str) -> Coder:
        if (path, pattern) not in _loaded:
            _loaded[path, pattern] = cls(path, pattern)
        return _loaded[path, pattern]

    def turn(self, role: str, text: str) -> tuple[list[int], list[bool]]:
        """(ids, loss mask) of one turn: an assistant's text bears loss, nothing else."""
        head = [self.start, *self.encoding.encode_ordinary(escape_role(role) + "\n")]
        body = self.encoding.encode_ordinary(escape(text))
        return [*head, *body, self.end], [False] * len(head) + [role == "assistant"] * len(body) + [False]

    def text(self, ids: np.ndarray) -> str:
        """Formatted text of ids."""
        out, at = [], 0
        for i in [*np.flatnonzero(ids >= self.start).tolist(), len(ids)]:
            out.append(self.encoding.decode_bytes(ids[at:i].tolist()))
            if i < len(ids):
                out.append((START if ids[i] == self.start else END).encode())
            at = i + 1
        return b"".join(out).decode()


def _chain(batches):
    """Per conversation: its path (hash of all its turns), the order of paths, and its turns."""
    for batch in batches:
        paths, orders = [], []
        for turns in batch.column("turns").to_pylist():
            key, order = b"", []
            for t in turns:
                role, text = (t["role"] or "").encode(), (t["text"] or "").encode()
                key = hashlib.sha256(b"%b%d:%b%d:%b" % (key, len(role), role, len(text), text)).digest()
                order.append(key[:8])
            paths.append(key.hex())
            orders.append(b"".join(order))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(paths, pa.string()), pa.array(orders, pa.binary()), batch.column("turns")], ["conv_id", "path", "order", "turns"])


class _Tree:
    """A pack in the making."""

    def __init__(self) -> None:
        self.ids, self.positions, self.loss, self.nodes, self.leaves = [], [], [], [], []
        self.branch: list[tuple[bytes, int]] = []  # the last path: (hash of the turns up to here, node)

    def shared(self, keys: list[bytes]) -> int:
        n = 0
        while n < min(len(keys), len(self.branch)) and self.branch[n][0] == keys[n]:
            n += 1
        return n

    def add(self, path: str, keys: list[bytes], turns: list[tuple[list[int], list[bool]]]) -> None:
        del self.branch[self.shared(keys) :]
        for key, (ids, loss) in zip(keys[len(self.branch) :], turns[len(self.branch) :], strict=True):
            parent = self.branch[-1][1] if self.branch else -1
            first = len(self.ids)
            place = self.positions[self.nodes[parent]["last"] - 1] + 1 if self.branch else 0
            attends: list[list[int]] = []
            for _, node in self.branch:
                a, b = self.nodes[node]["first"], self.nodes[node]["last"]
                if attends and attends[-1][1] == a:
                    attends[-1][1] = b
                else:
                    attends.append([a, b])
            self.ids += ids
            self.loss += loss
            self.positions += range(place, place + len(ids))
            self.nodes.append({"first": first, "last": len(self.ids), "parent": parent, "attends": attends})
            self.branch.append((key, len(self.nodes) - 1))
        self.leaves.append({"path": path, "node": self.branch[-1][1] if self.branch else -1})

    def batch(self) -> pa.RecordBatch:
        row = {"ids": np.array(self.ids, "<u4").tobytes(), "positions": np.array(self.positions, "<u4").tobytes(), "loss": np.packbits(np.array(self.loss, bool)).tobytes(), "nodes": self.nodes, "leaves": self.leaves}
        node = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("attends", pa.list_(pa.list_(pa.int32())))])
        leaf = pa.struct([("path", pa.string()), ("node", pa.int32())])
        return pa.RecordBatch.from_pylist([row], pa.schema([("ids", pa.binary()), ("positions", pa.binary()), ("loss", pa.binary()), ("nodes", pa.list_(node)), ("leaves", pa.list_(leaf))]))


def _pack(path_to: str, pattern: str):
    def run(batches):
        coder, tree = Coder.at(path_to, pattern), _Tree()
        for batch in batches:
            for path, order, turns in zip(*(batch.column(c).to_pylist() for c in ("path", "order", "turns")), strict=True):
                keys = [order[i : i + 8] for i in range(0, len(order), 8)]
                coded = [coder.turn(t["role"] or "", t["text"] or "") for t in turns]
                new = sum(len(i) for i, _ in coded[tree.shared(keys) :])
                if tree.leaves and len(tree.ids) + new > PACK:
                    yield tree.batch()
                    tree = _Tree()
                tree.add(path, keys, coded)
        if tree.leaves:
            yield tree.batch()

    return run


def format_trees(turns: DataFrame, tokenizer: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """(packs, members): the tree packs of all conversations, and (conv_id, path) that finds each in a pack's leaves.

    turns: conv_id long, turn, role string, text string; other columns are left out. A conversation's rows go by turn,
    then role and text; null turns come first; null roles and texts are empty. Rows with a null conv_id are one
    conversation. Repeated rows are turns of their own; equal conversations share one path. A conversation is read by
    one task. No rows: no packs. pattern: the byte-level tokenizer's splitting pattern.
    """
    t = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    whole = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(t)).alias("turns"))
    kind = whole.schema["turns"].dataType.simpleString()
    chains = written(whole.mapInArrow(_chain, f"conv_id long, path string, `order` binary, turns {kind}"), "chains")
    distinct = chains.groupBy("path").agg(F.min("order").alias("order"), F.first("turns").alias("turns"))
    n = max(turns.sparkSession.sparkContext.defaultParallelism, chains.count() // 20_000)
    packs = distinct.repartitionByRange(n, "order").sortWithinPartitions("order", "path").mapInArrow(_pack(tokenizer, pattern), PACK_SCHEMA)
    return written(packs, "packs"), chains.select("conv_id", "path")


def _turns(text: str) -> list[tuple[str, str]]:
    """Roles and texts of formatted text."""
    out = []
    for part in text.split(END)[:-1]:
        role, _, body = part.removeprefix(START).partition("\n")
        out.append((unescape_role(role), unescape(body)))
    return out


def _read(path_to: str, pattern: str):
    def run(batches):
        coder = Coder.at(path_to, pattern)
        for batch in batches:
            for row in batch.to_pylist():
                ids, positions = np.frombuffer(row["ids"], "<u4"), np.frombuffer(row["positions"], "<u4")
                loss = np.unpackbits(np.frombuffer(row["loss"], np.uint8), count=len(ids)).astype(bool)
                out = []
                for leaf in row["leaves"]:
                    node = row["nodes"][leaf["node"]] if leaf["node"] >= 0 else {"attends": [], "first": 0, "last": 0}
                    at = np.concatenate([np.arange(a, b) for a, b in [*node["attends"], [node["first"], node["last"]]]])
                    assert (positions[at] == np.arange(len(at))).all(), "a path's positions count from 0"
                    text = coder.text(ids[at])
                    # runs under the mask, each an assistant's text
                    mask = np.concatenate([[0], loss[at].astype(np.int8), [0]])
                    edges = np.flatnonzero(np.diff(mask)).tolist()
                    said = [unescape(coder.text(ids[at[a:b]])) for a, b in list(pairwise(edges))[::2]]
                    out.append({"path": leaf["path"], "formatted": text, "turns": [{"role": r, "text": x} for r, x in _turns(text)], "said": "".join(said)})
                yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("formatted", pa.string()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), ("said", pa.string())]))

    return run


def read_back(packs: DataFrame, tokenizer: str, pattern: str) -> DataFrame:
    """path, formatted, turns (role, text), said (all text under the loss mask, unescaped) of every leaf, from ids alone."""
    return packs.mapInArrow(_read(tokenizer, pattern), "path string, formatted string, turns array<struct<role: string, text: string>>, said string")
