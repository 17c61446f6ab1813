"""Exact top-k inner-product search by columnar branch and bound.

Candidates are cut into blocks by a hash of their id, queries likewise; a cell is one block of each, so a task holds two
bounded blocks. In a cell the candidates lie dimension by dimension (one array per dimension), and scores grow by blocks
of dimensions. After each block a candidate's score can rise by at most the product of the norms of what remains of it
and of the query (Cauchy-Schwarz); candidates that cannot reach a query's k-th best score are compacted away. One block of
candidates is searched first; its k-th best scores bound the search of all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

CANDIDATES, QUERIES = 8192, 4096  # rows of a block
FIRST = 512  # candidates scored in full for each query's first bound
STEP = 16  # dimensions of one block


LONG = 2**63


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    """Integer components as doubles, one row for each dimension."""
    flat = column.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    return np.ascontiguousarray(np.floor(256.0 * flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(n, -1).T)


def _exact(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the columns of c with q: in 64-bit integers where they fit, else in Python's."""
    most = len(c) * max(1.0, np.abs(c).max(initial=0)) * max(1.0, np.abs(q).max(initial=0))
    if most < 2**62:
        return q.astype(np.int64) @ c.astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return (whole(c) * whole(q)[:, None]).sum(0)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def _cell(k: int):
    def run(cand: pa.Table, query: pa.Table) -> pa.Table:
        out_q, out_c, out_s = [], [], []
        if cand.num_rows and query.num_rows:
            cid, qid = cand["id"].to_numpy(), query["id"].to_numpy()
            c, q = _matrix(cand["vector"], len(cid)), _matrix(query["vector"], len(qid))
            floors = query["floor"].to_numpy(zero_copy_only=False)  # nan: none known
            dims = len(c)
            # inner products of components up to this are exact in doubles; the few longer vectors are scored apart
            most = np.floor(np.sqrt(2.0**53 / max(1, dims)))
            far = np.flatnonzero(np.abs(c).max(0, initial=0) > most)
            far_q = np.abs(q).max(0, initial=0) > most
            near = np.setdiff1d(np.arange(len(cid)), far)
            far_c, far_id = c[:, far], cid[far]
            c, cid = c[:, near], cid[near]
            cuts = [*range(0, dims, STEP), dims]
            # what is left of each vector after each cut
            c_left = [np.sqrt((c[d:] ** 2).sum(0)) for d in cuts[1:]]
            q_left = [np.sqrt((q[d:] ** 2).sum(0)) for d in cuts[1:]]
            seed = q.T @ c[:, :FIRST]
            for i in range(len(qid)):
                if far_q[i]:
                    alive = np.flatnonzero(cid != qid[i])
                    score = _exact(c[:, alive], q[:, i])
                else:
                    s = seed[i][cid[:FIRST] != qid[i]]
                    floor = np.partition(s, len(s) - k)[len(s) - k] if len(s) >= k else -np.inf
                    floor = np.fmax(floor, floors[i])
                    alive, score = np.flatnonzero(cid != qid[i]), None
                    for b, (d0, d1) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        part = c[d0:d1] if score is None else c[d0:d1, alive]
                        gain = q[d0:d1, i] @ part
                        score = gain[alive] if score is None else score + gain
                        can = score + (q_left[b][i] * c_left[b][alive]) * (1 + 1e-9) + 1e-6 >= floor
                        if not can.all():
                            alive, score = alive[can], score[can]
                    if score is None:
                        score = np.zeros(len(alive))
                ids = cid[alive]
                if len(far):
                    other = np.flatnonzero(far_id != qid[i])
                    ids = np.concatenate([ids, far_id[other]])
                    score = np.concatenate([score.astype(np.int64) if score.dtype == np.float64 else score, _exact(far_c[:, other], q[:, i])])
                top = _best(score, ids, k)
                out_q += [qid[i]] * len(top)
                out_c += ids[top].tolist()
                out_s += [min(max(int(x), -LONG), LONG - 1) for x in score[top]]
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_c, pa.int64()), "score": pa.array(out_s, pa.int64())})

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best candidates, ties to the smaller vec_id.

    vectors, queries: id long, vector array of numbers. A component counts as floor(256 x). Vectors that are null, hold
    a null or non-finite component, or have a null id take no part; only vectors of one length meet. A candidate with the
    query's own id is left out, every other row counts, repeated rows each for themselves. Scores past a long are
    returned as the nearest long, and rank within a block of candidates by their true value.
    """

    def clean(df: DataFrame) -> DataFrame:
        v = F.col("vector")
        ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.select(F.col("id").cast("long").alias("id"), v.cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & v.isNotNull() & ok).withColumn("dim", F.size("vector"))

    cand, query = clean(vectors), clean(queries)
    n_c, n_q = max(1, -(-cand.count() // CANDIDATES)), max(1, -(-query.count() // QUERIES))
    schema = "query_id long, vec_id long, score long"
    cell = ["dim", "cb", "qb"]
    cand = cand.withColumn("cb", F.pmod(F.xxhash64("id"), F.lit(n_c)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    query = query.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(n_q)).cast("int"))

    def searched(part: DataFrame, asked: DataFrame, first: int) -> DataFrame:
        each = asked.withColumn("cb", F.explode(F.sequence(F.lit(first), F.lit(n_c - 1) if first else F.lit(0))))
        return part.groupBy(*cell).cogroup(each.select("id", "vector", "dim", "qb", "cb", "floor").groupBy(*cell)).applyInArrow(_cell(k), schema)

    # the k-th best of one block of candidates is a bound for all others
    found = written(searched(cand.where("cb = 0"), query.withColumn("floor", F.lit(None).cast("double")), 0), "first-block")
    if n_c > 1:
        floors = found.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("floor"))
        bounded = query.join(floors, "id", "left") if query.select("id").distinct().count() == query.count() else query.withColumn("floor", F.lit(None).cast("double"))
        found = found.unionByName(searched(cand.where("cb > 0"), bounded, 1))
    # a query's best of each cell: k rows for each block of candidates
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
