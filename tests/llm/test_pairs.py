"""op1, op8, op9, op10 against brute force, and their edge cases."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pytest
import xxhash
from compare import check
from conftest import SF

from tallyloom.llm import queries, sharding, simhash, substring_dedup, topk


@pytest.mark.parametrize("name", ["op1_topk", "op9_substring_dedup"])
def test_sql(spark, con, name):
    assert check(queries.queries()[name](spark, SF), con, queries.oracle_sql()[name]) > 0


def test_topk_edges(spark):
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 0.5]), (6, [1.0, 0.5]), (7, [-1.0, 2.0]), (8, [1.0]), (None, [1.0, 1.0]), (50, [1.0, 0.5]), (100, [-0.001, 0.0])]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    got = sorted(map(tuple, topk.top_k(v, v.where("id % 50 = 0"), 5).collect()))
    two = [(i, np.floor(256 * np.array(x))) for i, x in rows if i is not None and x is not None and len(x) == 2 and all(y is not None and np.isfinite(y) for y in x)]
    want = []
    for q, a in [x for x in two if x[0] % 50 == 0]:
        best = sorted(((-int(a @ b), i) for i, b in two if i != q))[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
    assert topk.top_k(v.where("false"), v.where("false")).count() == 0


def test_topk_long_vectors(spark, monkeypatch):
    """Vectors too long for exact doubles, or for scores that fit a long, beside common ones, over several blocks."""
    monkeypatch.setattr(topk, "CANDIDATES", 150)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(600, 8)), 3)
    x[[50, 77, 301]] *= 1e7
    x[400] *= 1e300
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    whole = [[int(np.floor(256.0 * c)) for c in r] for r in x]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(v, v.where("id % 50 = 0"), 5).collect()}
    assert len(got) == 12 * 5
    clip = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    for q in range(0, 600, 50):
        best = sorted(((-clip(sum(a * b for a, b in zip(whole[q], w, strict=True))), i) for i, w in enumerate(whole) if i != q))[:5]
        have = [got[q, r] for r in range(1, 6)]
        assert [s for _, s in have] == [-s for s, _ in best]
        assert q == 400 or [i for i, _ in have] == [i for _, i in best]  # past a long, ties are many


def test_topk_prunes_rightly(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(1500, 40)) * rng.exponential(size=(1500, 1)), 3)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vector array<float>")
    e = np.floor(256.0 * x.astype(np.float32).astype(np.float64))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(v, v.where("id % 100 = 0"), 7).collect()}
    for q in range(0, 1500, 100):
        s = e @ e[q]
        order = [i for i in np.lexsort((np.arange(1500), -s)) if i != q][:7]
        assert [got[q, r] for r in range(1, 8)] == [(i, int(s[i])) for i in order]


def test_sharding(spark):
    docs = spark.createDataFrame([(i, "é" * (i % 7), "x") for i in range(3000)] + [(None, None, "y"), (5, "é" * 5, "x")], "doc_id long, text string, shard string")
    rows = sharding.shard(docs, 24).collect()
    assert len(rows) == 3002
    for r in rows:
        text = b"" if r.doc_id is None else ("é" * (r.doc_id % 7)).encode()
        assert (r["size"], r.text_crc32, r.law) == (len(text) + 8, zlib.crc32(text), "key")
        assert r.grown_shard in (r.shard, 24)
    for s in range(24):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots))) and abs(len(slots) - 125) < 60
    assert 60 < sum(r.grown_shard == 24 for r in rows) < 190
    fewer = {(r.doc_id, r.grown_shard) for r in rows}
    assert fewer == {(r.doc_id, r.shard) for r in sharding.shard(docs, 25).collect()}  # the count alone decides
    heavy = sharding.shard(docs, weights=[1.0, 3.0]).groupBy("shard").count().orderBy("shard").collect()
    assert 2.5 < heavy[1]["count"] / heavy[0]["count"] < 3.6
    assert sharding.shard(docs.where("false")).count() == 0


def _shard(key: int, shards: int) -> int:
    """By the definition: the least -ln(u), u from the seeded hash of key, then shard number."""
    cost = []
    for s in range(shards):
        h = xxhash.xxh64_intdigest(struct.pack("<i", s), xxhash.xxh64_intdigest(struct.pack("<q", key), 42))
        cost.append(-math.log(((h >> 11) + 0.5) / 2**53))
    return cost.index(min(cost))


def test_op8_against_brute_force(spark):
    rows = queries.op8_sharding(spark, SF).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        t = texts[r.doc_id]
        assert (r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) == (len(t) + 8, zlib.crc32(t), "key", _shard(r.doc_id, 24), _shard(r.doc_id, 25))
    for s in range(24):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def test_sharding_one_hot_key(spark, monkeypatch):
    """Rows of one key, equal or not, are numbered in many groups and stay in one shard."""
    monkeypatch.setattr(sharding, "PER_SLOT_GROUP", 50)
    docs = spark.range(2000).selectExpr("if(id < 1500, null, id) as doc_id", "if(id < 700, 'same', cast(id as string)) as text").repartition(4)
    rows = sharding.shard(docs, 5).collect()
    assert len(rows) == 2000 and len({r.shard for r in rows if r.doc_id is None}) == 1
    for s in range(5):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def _print(text: str | None, k: int) -> int:
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    n = min(k, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(len(w) - n + 1)]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def _classes(prints: dict[int, int], bits: int = 4) -> dict[int, int]:
    ids = sorted(prints)
    x = np.array([prints[i] for i in ids], np.uint64)
    label = np.arange(len(ids))
    near = [np.flatnonzero(np.bitwise_count(x ^ v) <= bits) for v in x]
    changed = True
    while changed:
        changed = False
        for i, n in enumerate(near):
            low = label[n].min()
            if low < label[i]:
                label[i], changed = low, True
    return {d: ids[label[i]] for i, d in enumerate(ids)}


def test_simhash_against_brute_force(spark):
    got = {r.doc_id: r for r in queries.op10_simhash(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {d: _print(t, 4) for d, t in texts.items()}
    assert {d: r.fingerprint for d, r in got.items()} == {d: f"{p:016x}" for d, p in prints.items()}
    assert {d: r.component_id for d, r in got.items()} == _classes(prints)


def test_golay_keys_meet(spark):
    """Any two fingerprints up to 4 bits apart share a key of some pair of segments; dense groups link as one."""
    rng = np.random.default_rng(1)
    base = int(rng.integers(2**63))
    x = {base}
    for _ in range(900):  # chains of small steps: many members of one bucket
        p = list(x)[int(rng.integers(len(x)))]
        for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
            p ^= 1 << int(b)
        x.add(p)
    for _ in range(2000):
        p = int(rng.integers(2**63))
        x |= {p, p ^ sum(1 << int(b) for b in rng.choice(64, 4, replace=False))}
    prints = dict(enumerate(sorted(x)))
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints.values()], "print long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    want = _classes(prints)
    seen: dict[int, set[int]] = {}
    for i, p in prints.items():
        v = int(np.uint64(p).view(np.int64))
        seen.setdefault(want[i], set()).add(roots.get(v, v))
    assert all(len(v) == 1 for v in seen.values()) and len(seen) == len({next(iter(v)) for v in seen.values()})


def test_simhash_edges(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n", "c"), (4, long, "d"), (9, long.upper(), "e"), (9, long.upper(), "e"), (None, long, "f"), (None, "other words here now", "g"), (7, "One two", "h"), (8, "one  TWO", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (9, 4), (9, 4), (None, 4), (None, None), (7, 7), (8, 7)], key=str)
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def _brute_repeats(docs: list[tuple[int, str]], k: int) -> dict[int, list[bool]]:
    first: dict[tuple, int] = {}
    split = {d: (t or "").encode().split() for d, t in docs}
    for d in sorted(split):
        w = split[d]
        for i in range(len(w) - k + 1):
            first.setdefault(tuple(w[i : i + k]), d)
    out = {}
    for d, w in split.items():
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < d:
                gone[i : i + k] = [True] * k
        out[d] = gone
    return out


def test_repeats_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BUCKET", 500)
    rng = np.random.default_rng(3)
    share = [" ".join(f"s{j}x{i}" for i in range(30)) for j in range(5)]
    docs = []
    for d in range(120):
        body = [f"v{rng.integers(40)}" for _ in range(60)]
        if d % 3:
            body[20:20] = share[d % 5].split()[: 10 + d % 15]
        docs.append((d * 3 + 1, "  ".join(body) + "\n"))
    docs += [(1000, None), (1001, ""), (1002, " \t "), (1003, docs[5][1]), (1004, "a " * 20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "text as spans", "doc_id as block")
    df = df.unionByName(df.limit(0).unionAll(spark.createDataFrame([(None, docs[5][1], "z", 7)], df.schema)))
    want = _brute_repeats(docs, 13)
    rows = substring_dedup.remove_repeats(df, rejoin=True, block_bytes=4000).collect()
    assert len(rows) == len(docs) + 1
    texts = dict(docs)
    for r in rows:
        if r.doc_id is None:
            assert r.spans == [] and r.rest.spans == "z"
            continue
        gone = [False] * r.n_words
        for i, j in r.spans:
            gone[i:j] = [True] * (j - i)
        assert gone == want[r.doc_id]
        assert r.text == " ".join(w for w, g in zip((texts[r.doc_id] or "").split(), gone, strict=True) if not g)
    plain = {r.doc_id: r.text for r in substring_dedup.remove_repeats(df.where("doc_id is not null"), block_bytes=4000).collect()}
    for d, t in docs:
        assert plain[d].split() == [w for w, g in zip((t or "").split(), want[d], strict=True) if not g]
        assert any(want[d]) or plain[d] == (t or "")
    assert substring_dedup.remove_repeats(df.where("false")).count() == 0


def test_blocks_follow_bytes(spark, monkeypatch):
    """Ids far apart and bunched, long texts among short ones: blocks are in order of doc_id and of about equal bytes."""
    monkeypatch.setattr(substring_dedup, "CELLS", 64)
    rng = np.random.default_rng(12)
    ids = sorted({*range(1000), *(int(x) for x in rng.integers(-(2**62), 2**62, 500)), -(2**63), 2**63 - 1})
    table = spark.createDataFrame([(d, "x" * (3000 if d % 50 == 0 else 100), None) for d in ids], "doc_id long, text string, rest string")
    n_bytes, cuts = substring_dedup._cuts(table, 20_000)
    assert n_bytes == sum(3000 if d % 50 == 0 else 100 for d in ids)
    rows = table.mapInArrow(substring_dedup._deal(*cuts), "block int, doc_id long, z binary, size long, rest string").select("block", "doc_id", "size").collect()
    block = {r.doc_id: r.block for r in rows}
    order = [block[d] for d in ids]
    assert order == sorted(order) and order[0] == 0 and len(set(order)) > 3
    spread = [r for r in rows if not 0 <= r.doc_id < 1000]
    assert max(sum(r["size"] for r in spread if r.block == b) for b in {r.block for r in spread} - {block[0]}) < 60_000


def _similar(texts: dict[int, str], shingle: int = 5, similarity: float = 0.8) -> dict[int, int]:
    sets = {}
    for d, t in texts.items():
        w = t.lower().split()
        k = min(shingle, len(w))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    ids = sorted(texts)
    least = {d: d for d in ids}

    def root(d):
        while least[d] != d:
            d = least[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if root(a) != root(b) and (both := len(sets[a] & sets[b])) >= similarity * (len(sets[a]) + len(sets[b]) - both):
                least[max(root(a), root(b))] = min(root(a), root(b))
    return {d: root(d) for d in ids}


def _same_classes(spark, texts: dict[int, str]) -> int:
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = _similar(texts)
    assert {r.doc_id: r.least for r in simhash.similar_classes(df).collect()} == want
    return len(set(want.values()))


def test_crowded_near_copies(spark):
    """Forms of one template, each far from the others and with one near copy: crowds in which only twins are similar."""
    rng = np.random.default_rng(9)
    texts: dict[int, str] = {}
    base = [f"w{i}" for i in range(250)]
    for n in range(300):
        own = list(base)
        for i in rng.choice(250, 10, replace=False):
            own[i] = f"f{n}x{i}"
        texts[2 * n] = " ".join(own)
        for i in rng.choice(250, 4, replace=False):
            own[i] = f"c{n}x{i}"
        texts[2 * n + 1] = " ".join(own)
    ids = rng.permutation(len(texts)).tolist()
    assert 3 < _same_classes(spark, dict(zip(ids, texts.values(), strict=True))) < len(texts)


def test_all_pairs_of_the_test_table(spark):
    """Every pair of documents with a similarity of 0.8 or more lies in one class, crowded groups included."""
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    sets = {d: {tuple(w[i : i + min(5, len(w))]) for i in range(len(w) - min(5, len(w)) + 1)} for d, t in docs if (w := t.lower().split())}
    holders: dict[tuple, list[int]] = {}
    for d, x in sets.items():
        for g in x:
            holders.setdefault(g, []).append(d)
    # of the sets that share a shingle, those that share one of the rarest fifth: no similar pair shares none of them
    pairs = set()
    for d, x in sets.items():
        for g in sorted(x, key=lambda g: (len(holders[g]), g))[: len(x) - int(np.ceil(0.8 * len(x))) + 1]:
            pairs.update((min(d, e), max(d, e)) for e in holders[g] if e != d)
    close = [(a, b) for a, b in pairs if (both := len(sets[a] & sets[b])) >= 0.8 * (len(sets[a]) + len(sets[b]) - both)]
    least = {r.doc_id: r.least for r in simhash.similar_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(close) > 50 and all(least[a] == least[b] for a, b in close)


def test_repeated_appended_truncated_copies(spark):
    """Copies with a passage repeated, text appended or the end cut, against brute force; repeats leave fingerprints alone."""
    rng = np.random.default_rng(11)
    texts: dict[int, str] = {}
    for n in range(60):
        w = [f"v{rng.integers(5000)}" for _ in range(400)]
        for copy in (w, w + w[100:140] * (5 + 15 * (n % 2)), w + [f"a{n}x{i}" for i in range(60 + n)], w[: 310 + n]):
            texts[len(texts)] = " ".join(copy)
    assert _same_classes(spark, texts) < len(texts)
    rows = spark.createDataFrame([(d, t) for d, t in texts.items() if d % 4 < 2], "doc_id long, text string")
    p = {r.doc_id: np.array([r.p0, r.p1]).view(np.uint64) for r in rows.mapInArrow(simhash._sketches, "doc_id long, key binary, p0 long, p1 long").collect()}
    assert max(int(np.bitwise_count(p[d] ^ p[d + 1]).sum()) for d in range(0, len(texts), 4)) <= 8
