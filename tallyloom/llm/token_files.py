"""Token-id files of directly addressable codes.

An id is cut into chunks of 8 bits, lowest first. Level 0 holds every id's first chunk, level k + 1 the next chunk of
those ids of level k that have one, which level k's continuation bitmap marks. A rank directory (marks before each 512
bits) leads from an id's place in one level to its place in the next, so any token is read without decoding others.

A file is a Parquet table of segments in ascending order of doc_id; a segment holds whole documents, about 65,536 ids.
Levels are stored uncompressed, so their bytes are what `token_at` addresses.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import slices
from .tokens import WordEncoder

SEGMENT = 1 << 16  # ids after which a segment is closed
BLOCK = 512  # bits of a rank block
SCHEMA = "part int, segment int, inside long, n_tokens long, doc_ids array<long>, doc_ends array<long>, levels array<struct<n: long, chunks: binary, more: binary, ranks: binary>>"


def encode_levels(ids: np.ndarray) -> list[dict]:
    """Levels of a sequence of unsigned 32-bit ids."""
    out, rest = [], ids.astype(np.uint32)
    while len(rest):
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        blocks = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64)
        ranks = (np.cumsum(blocks) - blocks).astype("<u4")
        out.append({"n": len(rest), "chunks": (rest & 0xFF).astype(np.uint8).tobytes(), "more": bits.tobytes(), "ranks": ranks.tobytes()})
        rest = rest[more] >> np.uint32(8)
    return out


def decode_levels(levels: list[dict]) -> np.ndarray:
    """All ids of a segment."""
    if not levels:
        return np.zeros(0, np.uint32)
    ids = np.zeros(levels[0]["n"], np.uint32)
    at = np.arange(len(ids))
    for k, level in enumerate(levels):
        ids[at] |= np.frombuffer(level["chunks"], np.uint8).astype(np.uint32) << np.uint32(8 * k)
        at = at[np.unpackbits(np.frombuffer(level["more"], np.uint8), count=level["n"], bitorder="little").astype(bool)]
    return ids


def token_at(levels: list[dict], i: int) -> int:
    """One id of a segment by its place: a chunk, a bit and a rank for each level, whatever the segment's length."""
    out = 0
    for k, level in enumerate(levels):
        out |= level["chunks"][i] << (8 * k)
        if not level["more"][i >> 3] >> (i & 7) & 1:
            break
        first = i // BLOCK * BLOCK
        ones = int.from_bytes(level["more"][first // 8 : i // 8 + 1], "little") & ((1 << (i - first)) - 1)
        i = int.from_bytes(level["ranks"][4 * (first // BLOCK) : 4 * (first // BLOCK) + 4], "little") + ones.bit_count()
    return out


def _encode(path: str, end_id: int):
    def run(batches):
        encoder, end, n, inside = WordEncoder.at(path), np.array([end_id], "<u4").tobytes(), 0, 0
        ids, docs, ends, total, part = [], [], [], 0, 0

        def closed():
            levels = encode_levels(np.frombuffer(b"".join(ids), "<u4"))
            return pa.RecordBatch.from_pylist([{"part": part, "segment": n, "inside": inside, "n_tokens": total, "doc_ids": docs, "doc_ends": ends, "levels": levels}], schema=_ARROW)

        for batch in batches:
            for piece in slices(batch, "text", 4 << 20):
                texts = [x or b"" for x in piece.column("text").cast(pa.binary()).to_pylist()]
                for d, p, raw in zip(piece.column("doc_id").to_pylist(), piece.column("part").to_pylist(), encoder.encode(texts), strict=True):
                    part = p
                    ids += (raw, end)
                    total += len(raw) // 4 + 1
                    docs.append(d), ends.append(total)
                    if total >= SEGMENT:
                        yield closed()
                        ids, docs, ends, total, n, inside = [], [], [], 0, n + 1, inside + total
        if docs:
            yield closed()

    return run


_LEVEL = pa.struct([("n", pa.int64()), ("chunks", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())])
_ARROW = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_ends", pa.list_(pa.int64())), ("levels", pa.list_(_LEVEL))])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Writes the ids of docs (doc_id long, text string; other columns are left out) to path, in ascending doc_id order.

    Null or empty text: the end id alone. A null doc_id sorts first. Repeated rows are written as often as given; rows
    of one doc_id are in order of their texts. No rows: an empty table.
    """
    spark = docs.sparkSession
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = table.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = table.repartitionByRange(max(spark.sparkContext.defaultParallelism, size >> 24), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered = ordered.withColumn("part", F.spark_partition_id())
    ordered.mapInArrow(_encode(tokenizer, end_id), SCHEMA).write.option("compression", "none").parquet(path)


def _decode(batches):
    for batch in batches:
        for row in batch.to_pylist():
            raw = decode_levels(row["levels"]).astype("<u4").tobytes()
            ends = row["doc_ends"]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(row["doc_ids"], pa.int64()),
                "start": pa.array([row["before"] + e for e in [0, *ends[:-1]]], pa.int64()),
                "ids": pa.array([raw[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.binary()),
            })


def _checked(batches):
    for batch in _decode(batches):
        raw = batch.column("ids").to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def _placed(spark: SparkSession, table: DataFrame) -> DataFrame:
    """Segments with `before`: how many ids all earlier segments hold (those of earlier parts, then inside its part)."""
    parts = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for about 16 MB of text
    parts = parts.select("part", F.expr("sum(n) over (order by part) - n").alias("base"))
    if parts.count() <= 1_000_000:  # 16 MB at most; beyond, Spark chooses the join
        parts = F.broadcast(parts)
    return table.join(parts, "part").withColumn("before", F.col("base") + F.col("inside"))


def _segments(spark: SparkSession, path: str) -> DataFrame:
    return _placed(spark, spark.read.schema(SCHEMA).parquet(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), ids (binary, little-endian unsigned 32-bit)."""
    return _segments(spark, path).mapInArrow(_decode, "doc_id long, start long, ids binary")


def _pick(wanted: dict[tuple[int, int], tuple[int, list[int]]]):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                before, places = wanted.get((row["part"], row["inside"]), (0, []))
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array([token_at(row["levels"], p - before) for p in places], pa.int64())], ["place", "id"])

    return run


def tokens(spark: SparkSession, path: str, places: list[int]) -> DataFrame:
    """place, id of the ids at these places (from 0, over all documents), by random access.

    The directory (three numbers of each segment) says which segments hold one; the scan of the levels then asks for those
    parts and segments by their values, so files and row groups without one are not read, and in a segment a chunk, a bit
    and a rank are looked up for each level. Places past the end have no row; repeated ones have one.
    """
    asked = sorted({int(p) for p in places})
    wanted = F.array(*[F.lit(p).cast("long") for p in asked]).cast("array<long>")
    inside = F.filter(wanted, lambda p: (p >= F.col("before")) & (p < F.col("before") + F.col("n_tokens")))
    directory = spark.read.schema(SCHEMA).parquet(path).select("part", "inside", "n_tokens")
    hits = _placed(spark, directory).withColumn("places", inside).where("size(places) > 0").select("part", "inside", "before", "places").collect()  # one for each place at most
    found = {(r.part, r.inside): (r.before, r.places) for r in hits}
    scan = spark.read.schema(SCHEMA).parquet(path).where(F.col("part").isin(sorted({p for p, _ in found})) & F.col("inside").isin(sorted({i for _, i in found})))
    return scan.select("part", "inside", "levels").mapInArrow(_pick(found), "place long, id long")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the ids read back from the files."""
    return _segments(spark, path).mapInArrow(_checked, "doc_id long, start long, n_tokens long, ids_crc32 long")
