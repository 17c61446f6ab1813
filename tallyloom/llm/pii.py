"""Personal data, also where it is disguised, as spans of the source text.

The plain rules (`base_spans`) read the text as it is. Then three transducers rewrite it: look-alike letters and invisible
characters, digits spelled as words, and at/dot disguises. Each is a `Rewrite`: its output, and the places it changed, so
that every place of the output has a source place. The plain rules read the last output, and what they find there goes
back through the transducers to source characters. A span found only so is added; plain spans always stay.

Every pattern reads a text in time linear in its length: repetitions are bounded, or start where none can start before.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .shared import others, slices

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _DOMAIN = "A-Za-z0-9._%+-", "A-Za-z0-9-"
_BEFORE_AT = re.compile(rf"[{_LOCAL}]+\Z")
_AFTER_AT = re.compile(rf"[{_DOMAIN}]+(?:\.[{_DOMAIN}]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

# Letters and digits of other scripts that look like Latin ones, and signs that stand for ASCII signs.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ո": "n", "ց": "g", "ա": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "У": "Y",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "ι": "i", "κ": "k", "γ": "y", "ϲ": "c",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "＠": "@", "﹫": "@", "．": ".", "。": ".", "․": ".", "‧": ".", "·": ".", "＋": "+", "﹢": "+", "＿": "_",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "－": "-", " ": " ", " ": " ", " ": " ", " ": " ", "　": " ",
}
for _first, _ascii, _n in (("０", "0", 10), ("ａ", "a", 26), ("Ａ", "A", 26), ("𝟎", "0", 10), ("𝟬", "0", 10), ("𝐚", "a", 26), ("𝐀", "A", 26), ("𝗮", "a", 26), ("𝗔", "A", 26), ("٠", "0", 10)):
    LOOKALIKES |= {chr(ord(_first) + _k): chr(ord(_ascii) + _k) for _k in range(_n)}
INVISIBLE = "­​‌‍⁠﻿"  # fixed value: soft hyphen, zero-width characters
# Digits as words in English, German, Spanish and French, and words for signs.
DIGIT_WORDS = [
    "zero oh null cero zéro", "one eins uno un", "two zwei dos deux", "three drei tres trois", "four vier cuatro quatre",
    "five fünf cinco cinq", "six sechs seis", "seven sieben siete sept", "eight acht ocho huit", "nine neun nueve neuf",
]
REPEATS = {"double": 2, "doppel": 2, "doble": 2, "triple": 3}
AT_WORDS, DOT_WORDS, PLUS_WORDS = "at arroba arobase klammeraffe", "dot punkt punto point period", "plus más"

_FOREIGN = f"[{''.join(map(re.escape, LOOKALIKES))}]+|[{INVISIBLE}]+"
_VALUE = {w: str(n) for n, words in enumerate(DIGIT_WORDS) for w in words.split()}
_any = lambda words: "|".join(words.split())
_WORD = f"(?:(?:{'|'.join(REPEATS)}) )?(?:{'|'.join(_VALUE)})"
_GAP = r"[ \t\n,()-]{1,3}"
_ITEM = rf"(?:{_WORD}|{_any(DOT_WORDS)}|[0-9]{{1,4}})"
_RUN = re.compile(rf"(?<![\w+])(?:(?:{_any(PLUS_WORDS)}){_GAP}|\+)?{_ITEM}(?:{_GAP}{_ITEM})+(?!\w)", re.IGNORECASE)
_PIECES = re.compile(rf"(?P<plus>{_any(PLUS_WORDS)}|\+)|(?P<word>{_WORD})|(?P<dot>{_any(DOT_WORDS)})|(?P<digits>[0-9]+)|(?P<gap>{_GAP})", re.IGNORECASE)
_HINT = rf"(?i)\b(?:{'|'.join(_VALUE)}){_GAP}(?:{_any(DOT_WORDS)}|{_WORD}|[0-9])"
LEAST_WORDS = 4  # spelled digits that make a run a disguised number
LEAST_SPELLED = 7  # spelled digits of a phone number without a plus

_OPEN, _SHUT = r"[ \t]{0,3}[\[({<][ \t]{0,3}", r"[ \t]{0,3}[\])}>][ \t]{0,3}"
_AT_BOXED, _AT_PLAIN, _AT_WIDE = rf"{_OPEN}(?:{_any(AT_WORDS)}|@){_SHUT}", rf"[ \t]{{1,3}}(?:{_any(AT_WORDS)})[ \t]{{1,3}}", r"[ \t]{0,3}@[ \t]{0,3}"
_DOT_BOXED, _DOT_PLAIN, _DOT_WIDE = rf"{_OPEN}(?:{_any(DOT_WORDS)}|\.){_SHUT}", rf"[ \t]{{1,3}}(?:{_any(DOT_WORDS)})[ \t]{{1,3}}", r"(?:\.|[ \t]{1,3}\.[ \t]{1,3})"
_DOT = f"(?:{_DOT_BOXED}|{_DOT_PLAIN}|{_DOT_WIDE})"
_LABEL = r"[A-Za-z0-9-]{1,63}"
_NAME = r"[A-Za-z0-9_%+-]{1,64}"
# a plain "at" alone is no disguise: its domain must have a disguised dot
_DOMAIN_OPEN = rf"{_LABEL}(?:{_DOT}{_LABEL}){{1,8}}"
_DOMAIN_HIDDEN = rf"{_LABEL}(?:{_DOT_WIDE}{_LABEL}){{0,8}}(?:{_DOT_BOXED}|{_DOT_PLAIN}){_LABEL}(?:{_DOT}{_LABEL}){{0,8}}"
_ADDRESS = re.compile(
    rf"(?<![{_LOCAL}]){_NAME}(?:{_DOT}{_NAME}){{0,8}}?(?:(?:{_AT_BOXED}|{_AT_WIDE}){_DOMAIN_OPEN}|{_AT_PLAIN}{_DOMAIN_HIDDEN})", re.IGNORECASE
)
_SIGNS = re.compile(rf"(?P<at>{_AT_BOXED}|{_AT_PLAIN}|{_AT_WIDE})|(?P<dot>{_DOT_BOXED}|{_DOT_PLAIN}|{_DOT_WIDE})", re.IGNORECASE)
_AT_HINT = rf"(?i)[\[({{<][ \t]{{0,3}}(?:{_any(AT_WORDS)}|@)[ \t]{{0,3}}[\])}}>]|[ \t](?:{_any(AT_WORDS)})[ \t][^.\n]|[ \t]@|@[ \t]|@[^\s@]{{1,200}}(?:{_DOT_BOXED}|{_DOT_PLAIN})"


def luhn(digits: str) -> bool:
    """Whether the check digit of an ASCII digit string holds."""
    even, odd = digits[-2::-2], digits[::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:  # each match has the @ that its local part ends at, and those parts do not hold one
        begin = at
        while begin > done and (found := _BEFORE_AT.search(text, max(done, begin - 256), begin)):
            begin = found.start()
            if begin > max(done, at - 256) and found.end() - found.start() < 256:
                break
        tail = _AFTER_AT.match(text, at + 1) if begin < at else None
        if tail:
            yield begin, tail.end()
            done = tail.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of plain e-mail addresses, IPv4 addresses, card numbers and telephone numbers, sorted.

    Leftmost matches that do not overlap within a kind; a match that fails its check (parts at most 255; 14 to 19 digits
    with a right check digit; 10 to 15 digits) is dropped and not retried.
    """
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


class Rewrite:
    """A text after replacements, and the way from its places back to those of the text before."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]) -> None:
        """edits: (start, end, new string), in order, apart from each other."""
        parts, at, size = [], 0, 0
        self.out, self.out_end, self.first, self.last = [], [], [], []
        for a, b, new in edits:
            parts += [text[at:a], new]
            size += a - at
            self.out.append(size)
            size += len(new)
            self.out_end.append(size)
            self.first.append(a)
            self.last.append(b)
            at = b
        self.text = "".join([*parts, text[at:]])

    def back(self, start: int, end: int) -> tuple[int, int]:
        """Source span of the output span [start, end)."""
        j = bisect_right(self.out, start) - 1
        while j >= 0 and self.out[j] == self.out_end[j] == start:  # what was deleted before the span is not part of it
            j -= 1
        if j >= 0:
            start = self.first[j] if start < self.out_end[j] else self._after(start)
        k = bisect_right(self.out, end - 1) - 1
        if k >= 0:
            end = self.last[k] if end - 1 < self.out_end[k] else end - self.out_end[k] + self.last[k]
        return start, end

    def _after(self, place: int) -> int:
        j = bisect_right(self.out, place) - 1
        return place - self.out_end[j] + self.last[j]

    def changed(self, start: int, end: int) -> bool:
        """Whether an edit lies in the source span."""
        j = bisect_right(self.first, start - 1)
        return j < len(self.first) and self.last[j] <= end and self.first[j] < end


def _letters(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "" if m[0][0] in INVISIBLE else "".join(map(LOOKALIKES.__getitem__, m[0]))) for m in re.finditer(_FOREIGN, text)]


def _number(run: str) -> tuple[str, int]:
    """A run of spelled digits in figures, and how many of its words were digits."""
    out, spelled, last, gap = [], 0, "", ""
    for m in _PIECES.finditer(run):
        kind, s = m.lastgroup, m[0].lower()
        if kind == "gap":
            gap = s
            continue
        if gap and not (kind == "dot" or last in ("dot", "plus") or last == kind == "word"):
            out.append(" ")
        if kind == "word":
            times, _, digit = s.rpartition(" ")
            n = REPEATS.get(times, 1)
            out.append(_VALUE[digit] * n)
            spelled += n
        else:
            out.append({"plus": "+", "dot": "."}.get(kind, s))
        last, gap = kind, ""
    return "".join(out), spelled


def _digits(text: str) -> list[tuple[int, int, str]]:
    found = ((m, *_number(m[0])) for m in _RUN.finditer(text))
    return [(m.start(), m.end(), new) for m, new, spelled in found if spelled >= LEAST_WORDS]


def _addresses(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _ADDRESS.finditer(text):
        for s in _SIGNS.finditer(text, m.start(), m.end()):
            new = "@" if s.lastgroup == "at" else "."
            if s[0] != new:
                out.append((s.start(), s.end(), new))
    return out


# each transducer, and a pattern that only texts with something to rewrite hold
STEPS: tuple[tuple[Callable[[str], list[tuple[int, int, str]]], str], ...] = ((_letters, _FOREIGN), (_digits, _HINT), (_addresses, _AT_HINT))
_SPELLED_PHONE = re.compile(r"(?<![0-9+.])[0-9](?: ?[0-9]){9,14}(?![0-9.])")


def rewritten(texts: list[str]) -> list[list[tuple[Callable, Rewrite]]]:
    """The passes that change something, per text. Which texts a step must read is told for all texts at once."""
    out: list[list[tuple[Callable, Rewrite]]] = [[] for _ in texts]
    now = pa.array(texts, pa.large_string())
    for step, hint in STEPS:
        at = np.flatnonzero(pc.match_substring_regex(now, hint).to_numpy(zero_copy_only=False)).tolist()
        new = {}
        for i in at:
            before = out[i][-1][1].text if out[i] else texts[i]
            if edits := step(before):
                out[i].append((step, Rewrite(before, edits)))
                new[i] = out[i][-1][1].text
        if new:
            now = pa.array([out[i][-1][1].text if out[i] else x for i, x in enumerate(texts)], pa.large_string())
    return out


def spans(text: str, passes: list[tuple[Callable, Rewrite]] | None = None) -> list[tuple[int, int, int, bool]]:
    """(start, kind number, end, whether the plain rules give it), sorted: plain spans, and those found behind disguises.

    passes: what `rewritten` gives for the text. An added span holds a disguise and lies in no plain span of its kind.
    """
    base = base_spans(text)
    out = [(*s, True) for s in base]
    passes = rewritten([text])[0] if passes is None else passes
    if not passes:
        return out
    now = passes[-1][1].text
    found = base_spans(now)
    if any(step is _digits for step, _ in passes):
        cards = [(a, b) for a, k, b in found if k in (1, 2, 3)]
        found += [(m.start(), 3, m.end()) for m in _SPELLED_PHONE.finditer(now) if not any(a < m.end() and m.start() < b for a, b in cards)]
    plain: dict[int, list[tuple[int, int]]] = {}
    for a, k, b in base:
        plain.setdefault(k, []).append((a, b))
    added = set()
    for a, k, b in found:
        changed, spelled = False, 0
        plus = now[a] == "+"
        for step, p in reversed(passes):
            new_a, new_b = p.back(a, b)
            changed |= p.changed(new_a, new_b)
            if step is _digits:
                spelled = sum(_number(p_text)[1] for p_text in _within(p, new_a, new_b, passes, text))
            a, b = new_a, new_b
        if not changed or k == 3 and not plus and spelled < LEAST_SPELLED:
            continue
        near = plain.get(k, [])
        j = bisect_right(near, (a, len(text) + 1)) - 1
        if j < 0 or near[j][1] < b:
            added.add((a, k, b, False))
    return sorted([*out, *added])


def _within(p: Rewrite, a: int, b: int, passes, text: str) -> Iterator[str]:
    """What p replaced inside its source span [a, b)."""
    before = text
    for _, other in passes:
        if other is p:
            break
        before = other.text
    j = bisect_right(p.first, a - 1)
    while j < len(p.first) and p.first[j] < b:
        yield before[p.first[j] : p.last[j]]
        j += 1


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("base", pa.bool_())]))


def _find(rest: pa.DataType, keep_text: bool):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [x or "" for x in part.column("text").to_pylist()]
                found = [[{"start": a, "kind": KINDS[k], "end": b, "base": plain} for a, k, b, plain in spans(x, p)] for x, p in zip(texts, rewritten(texts), strict=True)]
                cols = [part.column("doc_id"), pa.array(texts if keep_text else [None] * len(texts), pa.string()), pa.array(found, _SPAN), part.column("rest").cast(rest)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text", "spans", "rest"])

    return run


def find(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """doc_id, text, spans and rest of docs[doc_id long, text string, any other columns], one row for each row.

    spans: array of struct(start, kind, end, base) by start, then kind in the order of KINDS; code points of the source
    text, end exclusive; base tells whether the plain rules find it. rest: all other columns in one struct (null if there
    are none), so names cannot clash. keep_text false leaves text null.

    Null text counts as empty and has no spans. Rows with a null or repeated doc_id are read like others, each by itself.
    Whole texts are read, in linear time. No rows: none come back. Nothing is shuffled.
    """
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), others(docs, "doc_id", "text"))
    rest = table.schema["rest"].dataType
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())])
    kind = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("spans", T.ArrayType(span)), T.StructField("rest", rest)])
    return table.mapInArrow(_find(to_arrow_type(rest), keep_text), kind)


def redact(found: DataFrame) -> DataFrame:
    """`find`'s rows with every span of text replaced by its kind in brackets, e.g. [EMAIL]; of overlapping spans, the first.

    Touching spans stay two marks; a span that begins inside an earlier one only lengthens what that one hides.
    """
    step = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("done")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(s["end"].alias("at"), F.concat(acc["done"], F.expr("text").substr(acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("done")),
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["done"].alias("done"))),
    )
    hidden = found.withColumn("hidden", step)
    return hidden.withColumn("text", F.expr("concat(hidden.done, substr(text, int(hidden.at) + 1))")).drop("hidden")
