"""op3, op4, op5, op7 and the pipeline: held-out accuracy, exact round trips, SQL, edge cases."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from compare import check
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import chat, decontaminate, quality, queries, simhash, toxicity
from tallyloom.llm.shared import written

BYTES = (str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


@pytest.mark.parametrize("name", ["op4_chat", "op7_decontaminate"])
def test_sql(spark, con, name):
    assert check(queries.queries()[name](spark, SF), con, queries.oracle_sql()[name]) > 0


@pytest.mark.parametrize(("name", "label", "least"), [("op3_toxicity", "toxic", 0.9), ("op5_quality", "quality", 0.97)])
def test_held_out(spark, name, label, least):
    rows = queries.queries()[name](spark, SF)
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    j = rows.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    held = [r for r in j if r.held_out]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= (0.5 if label == "toxic" else 0.3)) for r in j)
    assert np.mean([r.predicted == r[label] for r in held]) >= least


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcd", max_size=12))
def test_automaton_against_edit_distance(word):
    entries = ["abcd", "abcda", "bbccdd", "dcbaabcda", "aadd", "cab*"]
    got = toxicity.Automaton(entries).edits(word)
    want = [0] if word.startswith("cab") else []
    for e in entries[:-1]:
        d = _edits(word, e)
        if d <= (0 if len(e) < 5 else 1 if len(e) < 9 else 2):
            want.append(d)
    assert got == min(want, default=-1)


def test_quotation_counts_less():
    s = toxicity.Scanner(["idiot"])
    abuse, quoted, clean = (s.features(t.encode()) for t in ("you are an idiot really", 'he said "idiot" really now', "you are very kind indeed"))
    assert abuse[0] > 0 and abuse[3] == 0 and quoted[0] == 0 and quoted[3] > 0 and clean[:4] == [0, 0, 0, 0]
    assert s.features(b"what an idiott")[2] > 0 and s.features(b"")[0] == 0


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "some words", 5), (3, "x " * 50000, 5), (3, "x " * 50000, 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, None), (2, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for f in (quality.score, toxicity.score):
        rows = f(docs, labels).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
        assert f(docs.where("false"), labels.where("false")).count() == 0
    kept = quality.keep(docs, labels.where("false"))
    assert kept.columns == docs.columns and kept.count() == 5


def test_held_out_labels_are_never_used(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "if(crc32(string(doc_id)) % 5 = 0, 1 - quality, quality) quality", "if(crc32(string(doc_id)) % 5 = 0, 1 - toxic, toxic) toxic")
    for f in (quality.score, toxicity.score):
        a, b = ({r.doc_id: round(r.score, 9) for r in f(docs, x).collect()} for x in (labels, flipped))
        assert a == b


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="\\<|>/s[]INST\nSYn", max_size=40))
def test_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert chat.unescape_role(chat.escape_role(text)) == text
    assert "\n" not in chat.escape_role(text)
    assert all(m not in chat.escape(text) for m in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_chat_trees(spark, monkeypatch):
    hard = "a\\[INST] </s> <|im_end|>\n é\U0001f600"
    rows = []
    for c in range(40):
        rows += [(c, 0, "system", "same start " * 30, "x"), (c, 1, "user", f"question {c % 5}", "x"), (c, 2, "assistant", hard + str(c % 10), "x"), (c, 3, "user\nodd", None, "x"), (c, 4, "assistant", "", "x")]
    rows += [(100, 1, None, "b", "x"), (100, 1, "assistant", "a", "x"), (100, None, "user", "first", "x"), (None, 0, "user", "no id", "x"), (101, 0, "assistant", "w " * 30000, "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path string")
    packs, members = chat.format_trees(turns, *BYTES)
    found = {r.path: r for r in chat.read_back(packs, *BYTES).collect()}
    by: dict = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or "")):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    got = {m.conv_id: found[m.path] for m in members.collect()}
    assert set(got) == set(by)
    for c, want in by.items():
        assert [(t.role, t.text) for t in got[c].turns] == want
        assert got[c].said == "".join(t for r, t in want if r == "assistant")
    shared = packs.selectExpr("sum(octet_length(ids)) n").first().n
    alone = sum(len(chat.Coder.at(*BYTES).turn(r[2] or "", r[3] or "")[0]) * 4 for r in rows)
    assert shared < alone - 14000  # shared turns are written once; conversation 101 has nothing to share
    for p in packs.collect():
        for n in p.nodes:
            assert n.parent < 0 or p.nodes[n.parent].last in [b for _, b in n.attends]
    assert chat.read_back(chat.format_trees(turns.where("false"), *BYTES)[0], *BYTES).count() == 0


def test_decontaminate_edges(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "WAVE_BYTES", 200)
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(60)] + ["É", "x1"]
    items = [(i, " ".join(rng.choice(words, int(n)))) for i, n in enumerate(rng.integers(1, 25, 40))] + [(7, "w1 w2"), (None, "w3"), (50, None), (51, " ?! ")]
    docs = []
    for d in range(80):
        body = list(rng.choice(words, 40))
        if d % 2:
            body[10:10] = items[int(rng.integers(40))][1].upper().replace("É", "É").split()
        docs.append((d, ",  ".join(body), f"s{d}"))
    docs += [(200, None, "n"), (201, "", "e"), (None, items[3][1], "u"), (5, docs[5][1], "s5")]
    df = spark.createDataFrame(docs, "doc_id long, text string, items string")
    got = decontaminate.find(df, spark.createDataFrame(items, "item_id long, text string"), window=10).collect()
    assert len(got) == len(docs)

    def split(t):
        import re

        t = (t or "").translate({c: c + 32 for c in range(65, 91)})
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)

    want = []
    for d, t, s in docs:
        w, hit, names = split(t), set(), set()
        for i, x in items:
            v = split(x) if i is not None else []
            n = min(10, len(v))
            wins = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if n else set()
            at = [j for j in range(len(w) - n + 1) if n and tuple(w[j : j + n]) in wins]
            hit |= {j + k for j in at for k in range(n)}
            names |= {str(i)} if at else set()
        want.append((str(d), s, len(w), sorted(hit), sorted(names)))
    have = [(str(r.doc_id), r.rest["items"], r.n_words, sorted(k for i, j in r.spans for k in range(i, j)), list(r["items"])) for r in got]
    assert sorted(have) == sorted(want)
    assert decontaminate.find(df, df.selectExpr("doc_id item_id", "text").where("false")).where("size(items) > 0").count() == 0


def test_similar_texts(spark):
    rng = np.random.default_rng(6)
    docs = []
    for g in range(30):
        base = [f"t{rng.integers(400)}" for _ in range(int(rng.integers(60, 300)))]
        docs.append((g * 10, " ".join(base), "x"))
        for k in range(1, int(rng.integers(2, 6))):
            near = list(base)
            for at in rng.choice(len(near), max(1, len(near) // 100), replace=False):
                near[at] = "changed"
            docs.append((g * 10 + k, " ".join(near).upper(), "x"))
    docs += [(900, None, "x"), (901, "", "x"), (902, "two words", "x"), (903, "Two  WORDS", "x"), (904, "two other", "x"), (None, "two words", "x"), (None, "nobody else", "x"), (902, "two words", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, key string")
    kept = simhash.keep_first(df).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted([str(g * 10) for g in range(30)] + ["900", "902", "904", "None"])
    near = docs[0][1].split()
    near[3] = "other"
    lone = [(None, "\u00c9 one two", "x"), (None, "\u00e9 one two", "x"), (None, " ".join(near), "x"), (None, "\u00c9  ONE two", "x")]
    kept = simhash.keep_first(df.unionByName(spark.createDataFrame(lone, df.schema))).where("doc_id is null").collect()
    # near copies of rows with ids go; only A-Z is lower-cased; of equal words one row stays
    assert sorted(r.text.lower().split()[-1] for r in kept) == ["else", "two", "two"] and len({r.text[0] for r in kept}) == 3
    assert simhash.keep_first(df.where("false")).count() == 0


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = written(stage(spark, docs, SF), "stage")
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before), name
        if name == "quality classifier":
            known = [d for d in before if labels.get(d) is not None]
            assert np.mean([(d in after) == bool(labels[d]) for d in known]) > 0.97
            n = len(before)
        if name == "substring dedup":
            assert set(after) == set(before) and any(after[d] != before[d] for d in after)
        if name == "benchmark decontamination":
            hit = {r.doc_id for r in decontaminate.find(spark.createDataFrame(list(before.items()), "doc_id long, text string"), spark.read.parquet(f"{SF}/benchmark.parquet")).where("size(items) > 0").collect()}
            assert set(before) - set(after) == hit and hit
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in last} == set(after) and n > len(after)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcd", max_size=12))
def test_automaton_words_under_a_beginning(word):
    entries = ["abcd*", "abcda", "abcdabcdab", "cab*", "cabdd"]
    want = [0] if word.startswith(("abcd", "cab")) else []
    want += [d for e in ("abcda", "abcdabcdab", "cabdd") if (d := _edits(word, e)) <= (1 if len(e) < 9 else 2)]
    assert toxicity.Automaton(entries).edits(word) == min(want, default=-1)


def test_misspelled_word_with_inflections(spark):
    rows = [(f"a{i} b{i} you {('idiot', 'idiots', 'idiotic')[i % 3]} c{i} d{i}", 1) for i in range(150)] + [(f"e{i} f{i} you friend g{i} h{i}", 0) for i in range(150)]
    entries = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, y int"))
    assert any(e.endswith("*") for e in entries) and {"idiot", "idiots"} <= set(entries)
    found = toxicity.Automaton(entries)
    assert [found.edits(w) for w in ("idiot", "idiotas", "iidiot", "idjot", "friend")] == [0, 0, 1, 1, -1]


def test_quality_against_plain_discriminant(spark):
    """op5's scores are one increasing line of log odds that plain covariances, determinants and inverses give."""
    small = SF.replace("sf0.01", "sf0.001")
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    got = {r.doc_id: r.score for r in queries.op5_quality(spark, small).collect()}
    x = {d: np.array(quality.statistics(t)) for d, t in docs.items()}
    rows = {c: np.array([x[d] for d in docs if label.get(d) == c]) for c in (0, 1)}
    n = {c: len(v) for c, v in rows.items()}
    cov = {c: np.cov(v.T, bias=True) for c, v in rows.items()}
    pooled = sum(n[c] * cov[c] for c in cov) / sum(n.values())
    gap = np.zeros(len(docs))
    every = np.array([x[d] for d in docs])
    for c, sign in ((1, 1), (0, -1)):
        weight = max(quality.SHRINK, min(1.0, 2 * len(pooled) / n[c]))
        s = (1 - weight) * cov[c] + weight * pooled
        s = (1 - quality.RIDGE) * s + quality.RIDGE * np.diag(np.maximum(np.diag(s), 1e-6) + 1e-4)
        z = every - rows[c].mean(0)
        gap += sign * (-0.5 * (np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z) + np.linalg.slogdet(s)[1]) + np.log(n[c] + 1))
    fitted = quality.fit(quality.measured(spark.read.parquet(f"{small}/documents.parquet")), spark.read.parquet(f"{small}/labels.parquet"))
    plain = fitted.log_density(every, 1) - fitted.log_density(every, 0) + np.log(fitted.prior[1] / fitted.prior[0])
    assert np.allclose(plain, gap, rtol=1e-6, atol=1e-4)
    score = np.array([got[d] for d in docs])
    want = 1 / (1 + np.exp(-np.clip(fitted.slope * np.clip(gap, -quality.GAP, quality.GAP) + fitted.shift, -500, 500)))
    assert np.abs(score - want).max() < 1e-6 and len(set(np.sign(gap))) == 2


def test_label_samples_of_any_size(spark):
    from tallyloom.llm.labels import training

    df = spark.createDataFrame([(d, d % 2) for d in range(5000)], "doc_id long, quality int")
    whole = sum(zlib.crc32(str(d).encode()) % 5 != 0 for d in range(5000))
    assert training(df, "quality", 10_000).count() == whole and 300 < training(df, "quality", 400).count() < 500
