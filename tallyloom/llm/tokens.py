"""Encoding with a tokenizer whose tokens never cross white space, word by word through a bounded cache.

Holds for tokenizers that drop white space before they split text (as the word-end BPE does): the ids of a text are those
of its words in order. Words not seen before are encoded by the library itself, many in one call.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from . import words as W
from .shared import trim

MOST = 2_000_000  # words kept by one Python worker, unless told otherwise; some 30 bytes each
_DELIMITER = "<|endoftext|>"
_loaded: dict[str, WordEncoder] = {}


def release() -> None:
    """Gives back what a reused Python worker keeps for encoding; called by tasks that need the memory."""
    _loaded.clear()
    trim()


def _joined(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    at = np.cumsum([0, *map(len, words)])
    return W.hashes(np.frombuffer(b"".join(words), np.uint8), at[:-1], at[1:]) if words else np.zeros(0, np.uint64)


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, .. (size[0] numbers), then begin[1] and so on."""
    after = np.cumsum(size)
    return np.repeat(begin - (after - size), size) + np.arange(after[-1] if len(after) else 0)


class WordEncoder:
    """The cache is four arrays: sorted 64-bit hashes of words, where each word's ids begin in one flat array, and how many."""

    def __init__(self, path: str, most: int = MOST) -> None:
        self.most = most
        self.tokenizer = Tokenizer.from_file(path)
        self.delimiter = self.tokenizer.token_to_id(_DELIMITER)
        if self.delimiter is None:
            raise ValueError(f"the tokenizer has no {_DELIMITER}")
        self._clear()

    def _clear(self) -> None:
        self.keys, self.begin, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, "<u4")

    @classmethod
    def at(cls, path: str, most: int = MOST) -> WordEncoder:
        """The worker's encoder for this file, loaded once; it keeps about `most` words."""
        if path not in _loaded:
            _loaded[path] = cls(path, most)
        encoder = _loaded[path]
        if len(encoder.keys) > most:
            encoder._clear()
        encoder.most = most
        return encoder

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash in the cache, -1 for those not in it."""
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == h, at, -1) if len(self.keys) else np.full(len(h), -1)

    def _add(self, h: np.ndarray, ids: list[bytes]) -> None:
        """h: sorted hashes not in the cache, each once."""
        if len(self.keys) >= self.most or not len(h):
            return
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        begin = len(self.flat) + np.cumsum(size, dtype=np.int64) - size
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), "<u4")])
        at = np.searchsorted(self.keys, h)
        self.keys, self.begin, self.size = np.insert(self.keys, at, h), np.insert(self.begin, at, begin), np.insert(self.size, at, size)

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        out = {}
        whole = [w for w in words if b"<|" in w]  # may hold a special token: one by one
        for w, e in zip(whole, self.tokenizer.encode_batch([w.decode("utf-8", "replace") for w in whole], add_special_tokens=False), strict=True):
            out[w] = np.array(e.ids, "<u4").tobytes()
        plain = [w for w in words if b"<|" not in w]
        for i in range(0, len(plain), 512):
            part = plain[i : i + 512]
            ids = np.array(self.tokenizer.encode(_DELIMITER.join([w.decode("utf-8", "replace") for w in part]), add_special_tokens=False).ids, "<u4")
            cut = np.flatnonzero(ids == self.delimiter).tolist()
            raw = ids.tobytes()
            out.update(zip(part, [raw[4 * a : 4 * b] for a, b in zip([0, *(c + 1 for c in cut)], [*cut, len(ids)], strict=True)], strict=True))
        return out

    def _learn(self, words: list[bytes], h: np.ndarray) -> list[bytes]:
        """Ids of new words. Latin letters in capitals, or before one mark, are taken from the lower-case word's ids."""
        base, stems = {}, set()
        for w in words:
            body, mark = (w[:-1], w[-1:]) if w[-1:] in (b".", b",") else (w, b"")
            s = body.decode("utf-8", "replace")
            if s.isalpha() and (s.isascii() or max(s) < "Ā"):
                stem = s.lower().encode()
                base[w] = (stem, mark)
                stems.add(stem)
                if mark:
                    stems.add(mark)
            else:
                stems.add(w)
        names = list(stems)
        keys = _joined(names)
        at = self._find(keys)
        known = {w: self.flat[self.begin[k] : self.begin[k] + self.size[k]].tobytes() for w, k in zip(names, at.tolist(), strict=True) if k >= 0}
        known.update(self._encode([w for w, k in zip(names, at.tolist(), strict=True) if k < 0]))
        out = []
        for w in words:
            if w in base:
                stem, mark = base[w]
                out.append(known[stem] + known[mark] if mark else known[stem])
            else:
                out.append(known[w])
        new = at < 0
        every = np.concatenate([h, keys[new]])
        distinct, first = np.unique(every, return_index=True)
        ids = [*out, *(known[w] for w, k in zip(names, new.tolist(), strict=True) if k)]
        self._add(distinct, [ids[k] for k in first.tolist()])
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Per text, its ids as little-endian unsigned 32-bit integers. Equal words (by 64-bit hashes) are looked up once."""
        raw, at = W.text_bytes(pa.array(texts, pa.large_binary()))
        starts, ends, per = W.split(raw, at, W.not_space())  # ASCII white space only, which the tokenizer drops
        if not len(starts):
            return [b""] * len(texts)
        h, first, which = np.unique(W.hashes(raw, starts, ends), return_index=True, return_inverse=True)
        at = self._find(h)
        hit = at >= 0
        size, begin = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        size[hit], begin[hit] = self.size[at[hit]], self.begin[at[hit]]
        flat = self.flat
        if not hit.all():
            data, lost = raw.tobytes(), np.flatnonzero(~hit)
            words = [data[i:j] for i, j in zip(starts[first[lost]].tolist(), ends[first[lost]].tolist(), strict=True)]
            ids = self._learn(words, h[lost])
            size[lost] = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            begin[lost] = len(flat) + np.cumsum(size[lost]) - size[lost]
            flat = np.concatenate([flat, np.frombuffer(b"".join(ids), "<u4")])
        n = size[which]
        out = flat[_spread(begin[which], n)].tobytes()
        cut = np.concatenate([[0], np.cumsum(n)])[per] * 4
        return [out[i:j] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
