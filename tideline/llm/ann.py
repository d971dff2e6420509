"""Maximum inner product search with score-aware (anisotropic) product quantisation.

A vector is cut into subspaces of two dimensions with sixteen centres each, so a code has four bits.
Centres and codes lessen ``|r|^2 + (eta - 1) r_par^2``: the part of the quantisation residual along the
vector, which changes large inner products most, costs ``eta`` times the rest. A query makes a table of
its inner products with all centres; the scan adds up table entries by the codes of every vector (two
codes, a byte, at a time), and the best are scored again from the original vectors.

The index is dealt into blocks of about ``BLOCK_ROWS`` by a hash of the id, each a row of packed arrays, and
of every block the best ``rerank`` are scored again. So what is found doesn't depend on how rows lie, and
the share that is scored again, and with it the recall, doesn't fall as the table grows.

Centres are fitted on a bounded sample in the driver. Every row is encoded and scanned. Queries go to
the rows in blocks of ``QUERY_BLOCK``; a task keeps each query's best so far, so what it sends on grows
with queries and tasks but not with rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.common import slices, table
from tideline.plans.shared import Scratch

SUB, CENTRES, THRESHOLD = 2, 16, 0.2
#: Rows fitted on, at most about; queries in a block; rows of a block of the index, and how many of them, besides
#: as many as are asked for, are scored again.
SAMPLE_ROWS, QUERY_BLOCK, BLOCK_ROWS, RERANK = 8192, 8192, 8192, 96
ROUNDS, SWEEPS = 12, 2


def usable(vector: Column, dim: int) -> Column:
    """Of the dimension, finite, without nulls and not zero."""
    good = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == dim) & F.coalesce(good, F.lit(False)) & F.exists(vector, lambda v: v != 0)


@dataclass(frozen=True)
class Quantiser:
    """centres: (subspaces, 16, 2). Vectors are padded with zeros to whole subspaces, an even number of them."""

    centres: np.ndarray
    dim: int
    eta: float

    def pad(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, len(self.centres) * SUB - x.shape[1]))).reshape(len(x), -1, SUB)

    def codes(self, x: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
        """One code a subspace: the nearest centres, then bettered subspace by subspace."""
        parts = self.pad(x)
        unit = parts / np.sqrt((parts**2).sum(axis=(1, 2)))[:, None, None]
        out = np.empty(parts.shape[:2], np.int64)
        along = np.empty(parts.shape[:2])
        for s, c in enumerate(self.centres):
            out[:, s] = ((parts[:, s, None] - c) ** 2).sum(axis=2).argmin(axis=1)
            along[:, s] = ((parts[:, s] - c[out[:, s]]) * unit[:, s]).sum(axis=1)
        total = along.sum(axis=1)
        for _ in range(sweeps):
            for s, c in enumerate(self.centres):
                rest = parts[:, s, None] - c
                own = (rest * unit[:, s, None]).sum(axis=2)
                cost = (rest**2).sum(axis=2) + (self.eta - 1) * ((total - along[:, s])[:, None] + own) ** 2
                out[:, s] = cost.argmin(axis=1)
                new = own[np.arange(len(x)), out[:, s]]
                total += new - along[:, s]
                along[:, s] = new
        return out

    def pack(self, codes: np.ndarray) -> np.ndarray:
        return (codes[:, 0::2] | codes[:, 1::2] << 4).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, bytes, 256): the sums of the two inner products that a byte stands for."""
        one = np.einsum("qsd,scd->qsc", self.pad(queries), self.centres).astype(np.float32)
        return (one[:, 0::2, None, :] + one[:, 1::2, :, None]).reshape(len(queries), -1, 256)


def fit(sample: np.ndarray, rounds: int = ROUNDS) -> Quantiser:
    """Alternates codes and centres; each centre is the least-squares solution for its vectors given
    what the other subspaces leave along them."""
    dim = sample.shape[1]
    subs = -(-dim // (2 * SUB)) * 2
    eta = max(1.0, (dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    rng = np.random.default_rng(3)
    if len(sample):
        first = sample[rng.permutation(len(sample))[np.arange(CENTRES) % len(sample)]]
        centres = np.pad(first, ((0, 0), (0, subs * SUB - dim))).reshape(CENTRES, subs, SUB).transpose(1, 0, 2).copy()
    else:
        centres = np.zeros((subs, CENTRES, SUB))
    q = Quantiser(centres, dim, eta)
    if not len(sample):
        return q
    parts = q.pad(sample)
    unit = parts / np.sqrt((parts**2).sum(axis=(1, 2)))[:, None, None]
    eye = np.eye(SUB)
    for _ in range(rounds):
        codes = q.codes(sample, 1)
        along = np.stack([((parts[:, s] - q.centres[s][codes[:, s]]) * unit[:, s]).sum(axis=1) for s in range(subs)], 1)
        total = along.sum(axis=1)
        for s in range(subs):
            u = unit[:, s]
            outer = eye + (eta - 1) * u[:, :, None] * u[:, None, :]
            right = parts[:, s] + (eta - 1) * u * (total - along[:, s] + (parts[:, s] * u).sum(axis=1))[:, None]
            for c in range(CENTRES):
                mine = codes[:, s] == c
                if mine.any():
                    q.centres[s, c] = np.linalg.solve(outer[mine].sum(axis=0), right[mine].sum(axis=0))
            new = ((parts[:, s] - q.centres[s][codes[:, s]]) * u).sum(axis=1)
            total += new - along[:, s]
    return q


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the order of the dimensions, so equal rows have equal scores."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * y[:, d]
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


_INDEX = "ids binary, vectors binary, codes binary"


def _encode(quantiser: Quantiser):
    """One row of a block of the index: its ids in order, vectors and codes."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("vec_id", "ascending"), ("vector_hash", "ascending")])
        vectors = _matrix(group.column("vector"), quantiser.dim)
        codes = np.concatenate([quantiser.pack(quantiser.codes(vectors[a : a + 1024])) for a in range(0, len(vectors), 1024)])
        ids = group.column("vec_id").to_numpy()
        return pa.table({n: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for n, v in (("ids", ids), ("vectors", vectors), ("codes", codes))})

    return run


def _best(approx: np.ndarray, n: int) -> np.ndarray:
    """Places of the n largest, ties to the first places."""
    if len(approx) <= n:
        return np.arange(len(approx))
    edge = np.partition(approx, len(approx) - n)[len(approx) - n]
    above = np.flatnonzero(approx > edge)
    return np.concatenate([above, np.flatnonzero(approx == edge)[: n - len(above)]])


def _scan(quantiser: Quantiser, ids: np.ndarray, queries: np.ndarray, k: int, rerank: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(ids)
        for block in slices(batches, (1,), 1):  # one row after the other
            own = np.frombuffer(block.column(0)[0].as_py(), np.int64)
            vectors = np.frombuffer(block.column(1)[0].as_py()).reshape(len(own), quantiser.dim)
            codes = np.frombuffer(block.column(2)[0].as_py(), np.uint8).reshape(len(own), -1).T.astype(np.intp)
            for a in range(0, len(ids), 128):
                some = queries[a : a + 128]
                luts = quantiser.tables(some)
                approx = np.zeros((len(some), len(own)), np.float32)
                for b, at in enumerate(codes):
                    approx += np.take(luts[:, b], at, axis=1)
                picked = [_best(row, rerank + k) for row in approx]
                flat = np.concatenate(picked)
                scores = exact(vectors[flat], np.repeat(some, [len(p) for p in picked], axis=0))
                ends = np.cumsum([len(p) for p in picked])
                for r, (at, score) in enumerate(zip(np.split(flat, ends[:-1]), np.split(scores, ends[:-1]), strict=True)):
                    other = own[at] != ids[a + r]
                    found, score = own[at][other], score[other]
                    if (old := held[a + r]) is not None:
                        found, score = np.concatenate([old[0], found]), np.concatenate([old[1], score])
                    top = np.lexsort((found, -score))[:k]
                    held[a + r] = (found[top], score[top])
        rows = [(q, h) for q, h in zip(ids.tolist(), held, strict=True) if h is not None and len(h[0])]
        for a in range(0, len(rows), 512):
            part = rows[a : a + 512]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([q for q, _ in part], [len(h[0]) for _, h in part])), pa.array(np.concatenate([h[0] for _, h in part])), pa.array(np.concatenate([h[1] for _, h in part]))], ["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, rerank: int = RERANK, sample_rows: int = SAMPLE_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the ``k`` rows of largest inner product found for every
    row for which ``is_query`` holds.

    Scores are exact, in double precision, summed in the order of the dimensions. Ties go to the smaller
    id. A query's own id is never among its results; of rows that repeat an id each is a row, but none is a
    result of a query of that id, which asks with the least of their vectors. Vectors that are null, zero, or hold a null or non-finite component take
    no part, nor do vectors of another dimension than the most frequent one (of equally frequent ones the
    least) or rows without an id. Queries with fewer other rows than ``k`` get all; no rows give none;
    other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("q")).where("vec_id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0")
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    none = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], none)
    dim = sizes[0].d
    rows = rows.where(usable(F.col("vector"), dim)).select("vec_id", F.col("vector").cast("array<double>").alias("vector"), "q")
    share = int(min(1.0, sample_rows / max(sizes[0]["count"], 1)) * (1 << 30)) + 1
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < share).select("vec_id", "vector").toPandas().sort_values("vec_id")
    quantiser = fit(np.array(sample["vector"].tolist(), float).reshape(-1, dim))
    blocks = max(1, -(-sizes[0]["count"] // BLOCK_ROWS))
    dealt = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), "vec_id", "vector", F.xxhash64("vector").alias("vector_hash"))
    index = scratch.keep(dealt.groupBy("block").applyInArrow(_encode(quantiser), _INDEX), "index")
    found: list[DataFrame] = []
    asked = rows.where("q").select("vec_id", "vector")
    block: list = []
    for row in asked.groupBy("vec_id").agg(F.min("vector").alias("vector")).toLocalIterator():
        block.append(row)
        if len(block) == query_block:
            found.append(_block(index, quantiser, block, k, rerank, scratch, len(found)))
            block = []
    if block or not found:
        found.append(_block(index, quantiser, block, k, rerank, None if not found else scratch, len(found)))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _block(index: DataFrame, quantiser: Quantiser, block: list, k: int, rerank: int, scratch: Scratch | None, n: int) -> DataFrame:
    ids = np.array([r.vec_id for r in block], np.int64)
    queries = np.array([r.vector for r in block], float).reshape(len(block), quantiser.dim)
    out = index.mapInArrow(_scan(quantiser, ids, queries, k, rerank), "query_id long, vec_id long, score double")
    return out if scratch is None else scratch.keep(out, f"found{n}")


def op7_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


#: Exact search; the sums run in the order of the dimensions.
OP7_SQL = """
WITH good AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), lambda a, b: a + b) AS score FROM good q JOIN good c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
