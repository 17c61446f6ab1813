"""op11 to op13: SQL where it can say it, plain versions on small inputs, edge cases."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import check
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.llm import collocations, pii, queries, trie

SMALL = SF.replace("sf0.01", "sf0.001")


@pytest.fixture(scope="module")
def small():
    from compare import duck

    return duck(SMALL)


@pytest.mark.parametrize("name", ["op11_collocations", "op13_trie"])
def test_sql(spark, small, name):
    assert check(queries.queries()[name](spark, SMALL), small, queries.oracle_sql()[name]) >= (name == "op13_trie")


# --- op11


def _mined(docs, least, longest, top, cover=100):
    count: dict = defaultdict(Counter)
    for lang, text in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    count[lang or "und" if lang is None else lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in count.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        often = {p: c for p, c in f.items() if c >= least and len(p) > 1}
        rows = []
        for p, a in often.items():
            if any(len(q) > len(p) and 100 * c >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, c in often.items()):
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -s))
    return sorted(out)


def _as_rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("block", [200, 1 << 20])
def test_mining_against_counting(spark, monkeypatch, block):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", block)
    rng = np.random.default_rng(1)
    words = ["New", "york", "city", "of", "the", "Ünder", "a.b", "x", "tea\tpot", "in!"]
    docs = [(["en", "de", None][i % 3], " ".join(rng.choice(words, int(rng.integers(1, 40))))) for i in range(150)]
    docs += [("en", None), ("en", ""), ("en", "NEW YORK"), ("en", "new york"), ("en", "new york. city"), ("en", "new york " * 200), ("", "odd lang odd lang"), ("de", " \t "), ("de", "...")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "lang string, text string, phrase int").repartition(5)
    want = _mined(docs, 8, 4, 50)
    assert _as_rows(collocations.mine(df, 8, 4, 100, 50)) == want and len(want) > 60
    assert _as_rows(collocations.mine(df, 8, 4, 60, 7)) == _mined(docs, 8, 4, 7, 60)


def test_mining_edges(spark):
    kind = "lang string, text string"
    assert collocations.mine(spark.createDataFrame([], kind)).count() == 0
    assert collocations.mine(spark.createDataFrame([("en", "a b c"), (None, None)], kind)).count() == 0
    hot = spark.createDataFrame([("en", "one two three four five six")] * 300, kind).repartition(6)
    got = _as_rows(collocations.mine(hot))
    assert got == _mined([("en", "one two three four five six")] * 300, 100, 5, 2000) and {len(r[2].split()) for r in got} == {5}


def test_collocation_sums_are_exact(spark):
    big = 10**16

    df = spark.createDataFrame([(big, 9 * big + 7, [big + 1, 3 * big], [big + 3, 2 * big + 1])], "f long, n long, pre array<long>, suf array<long>")
    r = df.select(collocations._cuts(F.col("f"), F.col("n")).alias("c")).first().c
    scores = [1000 * big * (9 * big + 7) // ((big + 1) * (big + 3)), 1000 * big * (9 * big + 7) // (3 * big * (2 * big + 1))]
    assert int(r.score) == min(scores) and r.k == 1


# --- op12

EMAIL, IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD, PHONE = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def _luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _base(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in re.finditer(EMAIL, text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(IP, text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(CARD, text) if 14 <= len(digits(m)) <= 19 and _luhn(digits(m))]
    return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(PHONE, text) if 10 <= len(digits(m)) <= 15])


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab01.@ -+_()é", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == _base(text)
    assert [s[:3] for s in pii.spans(text) if s[3]] == _base(text)


def test_base_spans_of_long_runs():
    for text in ("a" * 700 + "@b.c", "a@b.c_d@e.f+" + "x" * 300 + "@q.r", "4111 1111-1111 1111", "1.2.3.4.5.6.7.8", "0000001.2.3.4 256.1.1.1", "+1 (555) 010-9999."):
        assert pii.base_spans(text) == _base(text)
    assert pii.base_spans("9" * 200_000) == [] and pii.spans("one " * 50_000) == []


DISGUISED = [
    ("john dot doe at example dot com", "email"), ("write to j.smith [at] mail (dot) example [dot] org.", "email"), ("jоhn@exаmple.com", "email"), ("j​ohn@exa​mple.com", "email"),
    ("ann @ example . com", "email"), ("ana arroba correo punto es", "email"), ("ＪＯＥ＠ｘ．ｃｏｍ", "email"), ("call plus four nine one five one two three four five six seven now", "phone"),
    ("five five five, one two three, four five six seven", "phone"), ("card four one one one one one one one one one one one one one one one ok", "card"), ("４１１１ １１１１ １１１１ １１１１", "card"),
    ("host one nine two dot one six eight dot zero dot one", "ip"), ("null eins zwei drei vier fünf sechs sieben acht neun", "phone"), ("192．168．0．1", "ip"), ("＋49 151 1234567", "phone"),
]


@pytest.mark.parametrize(("text", "kind"), DISGUISED)
def test_disguises(text, kind):
    whole = "Ünï: " + text + " (end)"
    for source in (text, whole):
        (a, k, b, _), *rest = [s for s in pii.spans(source) if not s[3]]
        assert pii.KINDS[k] == kind and not rest
        inside = source[a:b]
        assert inside in text and inside[0] not in " \u200b" and inside[-1] not in " .\u200b"


@pytest.mark.parametrize("text", ["look at example.com please", "we looked at one of two or three", "at 10:30 – point. dot", "one, two, three and four", "meet me at noon. It is good", "eins zwei drei", "1–2 and 3—4", "a at b", "über das Haus ·"])
def test_clean_texts(text):
    assert pii.spans(text) == []


def test_find_and_redact(spark):
    rows = [(1, "mail a@b.co and joe at x dot org.", "x"), (None, "10.0.0.1", "y"), (2, None, "z"), (3, "", "z"), (1, "mail a@b.co and joe at x dot org.", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    found = pii.find(df)
    got = sorted(((r.doc_id, [(s.start, s.kind, s.end, s.base) for s in r.spans], r.rest.spans) for r in found.collect()), key=str)
    want = [(5, "email", 11, True), (16, "email", 32, False)]
    assert got == sorted([(1, want, "x"), (1, want, "x"), (None, [(0, "ip", 8, True)], "y"), (2, [], "z"), (3, [], "z")], key=str)
    assert {r.text for r in pii.redact(found).collect()} == {"mail [EMAIL] and [EMAIL].", "[IP]", ""}
    assert pii.find(df.limit(0)).count() == 0


def test_query_of_pii(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.op12_pii(spark, SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        base = _base(docs[r.doc_id])
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in base) for x in range(4)]
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and set(said.split(",")) <= set(r.spans.split(",")) | {""}


# --- op13


def _trie(turns):
    convs = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(convs.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + own[h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = Counter(s[:-1] for s in members if s)
    leaves, saved = Counter(), Counter()
    for s, m in members.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += kids[s] == 0
            saved[s[:d]] += (len(m) - 1) * len(s[-1][1]) if s else 0
    digest = lambda s: hashlib.sha256(",".join(map(str, sorted(c for c in members[s] if built[c] == s))).encode()).hexdigest()
    return sorted((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), kids[s], leaves[s], saved[s], digest(s)) for s, m in members.items()) if members else []


def _trie_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1]))


KIND = "conv_id long, turn long, role string, text string, depth int"


@pytest.mark.parametrize("rows", [200_000, 40])
def test_trie_against_dictionaries(spark, monkeypatch, rows):
    monkeypatch.setattr(trie, "ROWS", rows)  # 40: many ranges and shards
    monkeypatch.setattr(trie, "QUEUED", 10)
    monkeypatch.setattr(trie, "CHUNK", 7)
    rng = np.random.default_rng(4)
    turns = []
    for c in [*range(0, 260), 500, 507, 1007, -3, -103, 10**12]:
        for t in range(int(rng.integers(1, 9))):
            turns.append((c, t, "user" if t % 2 == 0 else "assistant", ["hi", "hello there", "ß€", "", None][int(rng.integers(5))] if t > 1 else "start"))
    turns += [(7, None, None, None), (7, None, None, None), (7, 0, "user", "start"), (None, 1, "user", "x")]
    turns += [(333, t, "user", f"long {t}") for t in range(300)] + [(433, t, "user", f"long {t}") for t in range(280)]  # long paths over many shards
    turns += [(c, 0, "user", "same") for c in range(2000, 2300)]
    df = spark.createDataFrame([(*t, 1) for t in turns], KIND).repartition(7)
    want = _trie(turns)
    assert _trie_rows(trie.prefix_trie(df)) == sorted(want, key=lambda r: (r[0], r[1]))


def test_trie_edges(spark):
    none = spark.createDataFrame([], KIND)
    assert trie.prefix_trie(none).count() == 0
    only_null = spark.createDataFrame([(None, 1, "user", "x", 1)], KIND)
    assert trie.prefix_trie(only_null).count() == 0
    lone = [(5, 0, "user", "x")]
    assert _trie_rows(trie.prefix_trie(spark.createDataFrame([(*t, 1) for t in lone], KIND))) == _trie(lone)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 99)), max_size=200), st.integers(4, 20))
def test_spilling_queue(entries, most):
    q = trie.SpillingQueue(most)
    for k, v in entries:
        q.push((k,), (v,))
    for k in range(31):
        assert sorted(v for (v,) in q.pop_at((k,))) == sorted(v for j, v in entries if j == k)


def test_trie_is_repeatable(spark):
    a, b = (_trie_rows(queries.op13_trie(spark, SMALL)) for _ in range(2))
    assert a == b and a
