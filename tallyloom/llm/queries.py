"""Queries op1 to op13 over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, decontaminate, packing, pii, quality, shared, sharding, simhash, substring_dedup, token_files, topk, toxicity, trie

WORD_TOKENIZER = "word_bpe_49k.json"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return topk.top_k(v, v.where("id % 50 = 0"), k=5)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


def _tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(WORD_TOKENIZER))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), _tokenizer(), capacity=4096, end_id=1)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), "toxic", threshold=0.5)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary, pattern = str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).selectExpr("-1L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", "'</s>[INST] ok [/INST]' as text")
    packs, members = chat.format_trees(turns.unionByName(hard), vocabulary, pattern)
    each = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = chat.read_back(packs, vocabulary, pattern).select(
        "path",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(each, ""), 256).alias("turns_sha256"),
        F.length("said").cast("long").alias("loss_chars"),
        F.sha2("said", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    return members.join(read, "path").drop("path")


OP4_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(role) + length(text) + len(regexp_extract_all(role, '\\|<\||</?s>|\[/?INST\]|<</?SYS>>')) + len(regexp_extract_all(role, '\n'))
            + len(regexp_extract_all(text, '\\|<\||</?s>|\[/?INST\]|<</?SYS>>')) + 24 AS n FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), "quality", threshold=0.3)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.new_path(spark, "token-files")
    token_files.write(_read(spark, sf_dir, "documents"), path, _tokenizer(), end_id=2)
    return token_files.digests(spark, path)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"), window=10, keep_text=False)
    n_hit = substring_dedup.removed("spans")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents
), b AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[p:p + least(len(ws), 10) - 1], ' ') AS g
  FROM b, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS t(p) WHERE len(ws) > 0
), dw AS (
  SELECT doc_id, p, k, array_to_string(ws[p:p + k - 1], ' ') AS g
  FROM d, (SELECT DISTINCT k FROM bw) AS ks, unnest(range(1, len(ws) - k + 2)) AS t(p)
), hit AS (SELECT doc_id, p, k, item_id FROM dw JOIN bw USING (k, g)),
words AS (SELECT doc_id, count(DISTINCT p + j) AS n_hit FROM hit, unnest(range(0, k)) AS t(j) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents"), shards=24)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4, bits=4, seed=42)
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"), rejoin=True)
    return out.select("doc_id", "n_words", substring_dedup.removed("spans").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), win AS (
  SELECT doc_id, p, array_to_string(ws[p:p+12], ' ') AS g FROM w, unnest(range(1, len(ws) - 11)) AS t(p)
), least AS (SELECT g, min(doc_id) AS first_doc FROM win GROUP BY g),
bad AS (
  SELECT DISTINCT win.doc_id, p + k AS p FROM win JOIN least USING (g), unnest(range(0, 13)) AS t(k) WHERE win.doc_id > first_doc
), tok AS (
  SELECT doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(p)
), kept AS (
  SELECT tok.doc_id, count(*) AS n, count(bad.p) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY tok.p) FILTER (WHERE bad.p IS NULL), '') AS s
  FROM tok LEFT JOIN bad ON tok.doc_id = bad.doc_id AND tok.p = bad.p GROUP BY tok.doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_read(spark, sf_dir, "documents").select("lang", "text"), least=100, longest=5, cover=100, top=2000)


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
  FROM documents, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t(piece)
), n AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM pieces GROUP BY lang),
g AS (
  SELECT lang, ws[p:p + k - 1] AS words FROM pieces, unnest([1, 2, 3, 4, 5]) AS s(k), unnest(range(1, len(ws) - k + 2)) AS t(p)
), f AS (SELECT lang, words, count(*) AS a FROM g GROUP BY lang, words HAVING count(*) >= 100),
c AS (SELECT *, array_to_string(words, ' ') AS phrase FROM f WHERE len(words) > 1),
cut AS (
  SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, n.n, (1000::HUGEINT * c.a * n.n) // (x.a::HUGEINT * y.a) AS score
  FROM c JOIN n ON c.lang = n.lang, unnest([1, 2, 3, 4]) AS t(k), f x, f y
  WHERE k < len(c.words) AND x.lang = c.lang AND y.lang = c.lang AND x.words = c.words[1:k] AND y.words = c.words[k + 1:len(c.words)]
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1
), kept AS (
  SELECT * FROM cut WHERE NOT EXISTS (
    SELECT 1 FROM c o WHERE o.lang = cut.lang AND len(o.phrase) > len(cut.phrase) AND contains(' ' || o.phrase || ' ', ' ' || cut.phrase || ' ') AND 100 * o.a >= 100 * cut.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_read(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.expr(f"cast(size(filter(spans, s -> s.base and s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(F.array_join(F.transform(base, text), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", text), ",").alias("spans"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_read(spark, sf_dir, "conversations"), group=100, most_shared=6)


OP13_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS x
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (SELECT c, list(x ORDER BY p) AS xs FROM t GROUP BY c),
crc AS (  -- crc32 bit by bit: DuckDB has no function for it
  SELECT c, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(c::VARCHAR, ''), lambda d: ascii(d)::UBIGINT)), lambda s, d: list_reduce(list_prepend(xor(s, d), range(8)::UBIGINT[]), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)) AS s FROM own
), h AS (SELECT c, xor(s, 4294967295::UBIGINT) % 6 AS h FROM crc),
built AS (
  SELECT own.c, list_concat(coalesce(b.xs, [])[1:h], own.xs[h + 1:len(own.xs)]) AS xs
  FROM own JOIN h USING (c) LEFT JOIN own b ON b.c = own.c - own.c % 100
), pre AS (SELECT c, d, xs[1:d] AS seq, len(xs) AS total FROM built, unnest(range(0, len(xs) + 1)) AS t(d)),
node AS (
  SELECT d, seq, min(c) AS conv_id, count(*) AS n_convs, coalesce(length(seq[d].text), 0) AS chars,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE total = d), '')) AS ends_sha256
  FROM pre GROUP BY d, seq
), kids AS (SELECT d - 1 AS d, seq[1:d - 1] AS seq, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
below AS (
  SELECT a.d, a.seq, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves, sum((x.n_convs - 1) * x.chars) AS saved
  FROM node x LEFT JOIN kids k ON k.d = x.d AND k.seq = x.seq, unnest(range(0, x.d + 1)) AS t(up) JOIN node a ON a.d = up AND a.seq = x.seq[1:up] GROUP BY a.d, a.seq
)
SELECT node.conv_id, node.d AS depth, p.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n, 0) AS n_children, below.n_leaves, below.saved::BIGINT AS saved_tokens, node.ends_sha256
FROM node LEFT JOIN kids ON kids.d = node.d AND kids.seq = node.seq JOIN below ON below.d = node.d AND below.seq = node.seq
LEFT JOIN node p ON p.d = node.d - 1 AND p.seq = node.seq[1:node.d - 1]
"""


def queries() -> dict:
    return {
        "op1_topk": op1_topk,
        "op2_packing": op2_packing,
        "op3_toxicity": op3_toxicity,
        "op4_chat": op4_chat,
        "op5_quality": op5_quality,
        "op6_token_files": op6_token_files,
        "op7_decontaminate": op7_decontaminate,
        "op8_sharding": op8_sharding,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_simhash": op10_simhash,
        "op11_collocations": op11_collocations,
        "op12_pii": op12_pii,
        "op13_trie": op13_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_topk": OP1_SQL,
        "op4_chat": OP4_SQL,
        "op7_decontaminate": OP7_SQL,
        "op9_substring_dedup": OP9_SQL,
        "op11_collocations": OP11_SQL,
        "op13_trie": OP13_SQL,
    }
