"""Exact top-k search by exhaustive term-at-a-time accumulation.

Components are the terms. The candidates are packed into blocks of a fixed number of vectors; in a
block every dimension has a posting list of the vectors with a weight other than zero there. Queries are packed into
blocks too, and every query block meets every candidate block: the contract's query set against
all rows. In a meeting each query's weights are scattered, term by term, over the postings into a
dense array of scores; the best k are selected by partition, and the partial lists of all blocks merge.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.functions.session import spool
from docweave.llm.blocks import packed

#: Sides of a tile: a query block is sent once for every VECTORS candidates. A tile's scores take 64 MB as numbers of 64 bits.
VECTORS, QUERIES = 8192, 1024


def scores_of(queries: list[np.ndarray], matrix: list[np.ndarray]) -> np.ndarray:
    """Integer inner products (query, vector); vectors may differ in length, missing components count as zero."""
    dims = max((len(v) for v in [*queries, *matrix]), default=0)
    q = np.zeros((len(queries), dims), np.int64)
    m = np.zeros((len(matrix), dims), np.int64)
    for rows, out in ((queries, q), (matrix, m)):
        size = np.array([len(v) for v in rows])
        if len(size) and (size == dims).all():
            out[:] = np.concatenate(rows).reshape(out.shape) if dims else 0
        else:
            for i, v in enumerate(rows):
                out[i, : len(v)] = v
    bound = float((np.abs(q.astype(float)).max(0, initial=0) * np.abs(m.astype(float)).max(0, initial=0)).sum())
    if bound >= 2**62:  # plain whole numbers; what does not fit 64 bits in the end stands at the border
        exact = q.astype(object) @ m.astype(object).T if dims else np.zeros((len(queries), len(matrix)), object)
        return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)
    kind = np.int32 if bound < 2**31 else np.int64
    total = np.zeros((len(queries), len(matrix)), kind)
    q, terms = q.astype(kind), np.ascontiguousarray(m.T.astype(kind))
    for d in range(dims):
        post = np.flatnonzero(terms[d])
        asks = np.flatnonzero(q[:, d])
        if not len(post) or not len(asks):
            continue
        if 2 * len(post) > len(matrix):  # long lists are held whole
            for i in asks:
                total[i] += q[i, d] * terms[d]
        else:
            weight = terms[d][post]
            for i in asks:
                total[i, post] += q[i, d] * weight
    return total


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, by partition selection."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= cut)
    else:
        at = np.arange(len(scores))
    order = np.lexsort((-ids[at], scores[at]))[::-1]
    return at[order][:k]


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v) with floor(scale * x) of each component, of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # beyond 64 bits: the border
    fits = lambda x: F.greatest(F.least(x * F.lit(float(scale)), F.lit(float(2**63 - 1024))), F.lit(-float(2**63)))
    whole = F.transform(v, lambda x: F.floor(fits(x)).cast("long"))
    return vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def narrowed(a: np.ndarray) -> np.ndarray:
    """Whole numbers in the fewest bytes each that hold all of them."""
    least, most = a.min(initial=0), a.max(initial=0)
    return a.astype(next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= least and most <= np.iinfo(k).max))


def vectors_of(flat, size: np.ndarray) -> list[np.ndarray]:
    """The vectors of a block from its buffer of `narrowed` numbers and their lengths."""
    total = int(size.sum(dtype=np.int64))
    return np.split(np.frombuffer(flat, f"i{len(flat) // total}") if total else np.zeros(0, np.int64), np.cumsum(size)[:-1])


def packed_blocks(rows: DataFrame, block_of, name: str) -> DataFrame:
    """One row per block: its ids, vectors one after the other, and their lengths."""

    def pack(t: pa.Table) -> pa.Table:
        v = t.column("v").combine_chunks()
        size = np.asarray(pa.compute.list_value_length(v)).astype(np.int32)
        flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.table([t.column(name).slice(0, 1), pa.array([packed(t.column("id").to_numpy())], pa.binary()), pa.array([packed(narrowed(flat))], pa.binary()), pa.array([packed(size)], pa.binary())], names=[name, f"{name}_ids", f"{name}_flat", f"{name}_size"])

    return rows.withColumn(name, block_of).groupBy(name).applyInArrow(pack, f"{name} int, {name}_ids binary, {name}_flat binary, {name}_size binary")


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """The k highest integer inner products of every query with all other vectors: query_id, rank (from 1), vec_id, score.

    Components become floor(scale * x). `is_query` is a condition on the column `id`. Ties go to the smaller id; fewer
    candidates give fewer rows. Vectors that are null, have a null id or hold null or non-finite components take no
    part; an empty vector scores 0, and a shorter one counts as padded with zeros. Rows that share
    an id stand for one vector, the first in array order. Components and scores beyond 64 bits stand at the border of these. A
    very long vector is handled whole. Other columns are not looked at. An empty table gives an empty result.
    """
    rows = spool(integer_vectors(vectors, id_col, vector_col, scale).groupBy("id").agg(F.min("v").alias("v")), "vectors")
    n = rows.count()
    blocks = max(1, math.ceil(n / VECTORS))
    asks = rows.where(is_query)
    ask_blocks = max(1, math.ceil(asks.count() / QUERIES))
    cand = packed_blocks(rows, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), "c")
    query = packed_blocks(asks, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(ask_blocks)).cast("int"), "q")
    # merged: by the size of the queries their copies for all blocks would seem small enough for a broadcast, which the driver holds whole
    met = query.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).hint("merge").join(cand, "c")

    def meet(batches):
        for b in batches:
            for r in range(b.num_rows):
                raw = {c: b.column(c)[r].as_buffer() for c in b.schema.names if c not in ("c", "q")}
                own = {}
                for side in "cq":
                    own[side] = vectors_of(memoryview(raw[f"{side}_flat"]), np.frombuffer(raw[f"{side}_size"], np.int32))
                ids, asked = np.frombuffer(raw["c_ids"], np.int64), np.frombuffer(raw["q_ids"], np.int64)
                scores = scores_of(own["q"], own["c"])
                out = ([], [], [])
                for i, q in enumerate(asked):
                    other = ids != q
                    s, names = (scores[i], ids) if other.all() else (scores[i][other], ids[other])
                    at = best_of(s, names, k)
                    for column, x in zip(out, (np.full(len(at), q), names[at], s[at].astype(np.int64)), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["query_id", "vec_id", "score"])

    part = met.mapInArrow(meet, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the five best matches of every vector whose id is divisible by 50, against all others."""
    from docweave.functions.session import table

    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


ORACLE = """
WITH f AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM f q JOIN f c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
