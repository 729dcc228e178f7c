"""Operator 4: approximate nearest neighbours by multi-index hashing.

Vectors get binary codes of one bit a dimension (64 at most) from a learned rotation
(iterative quantisation) of the centred vectors.  Codes are cut into substrings of
about log2(rows) bits, and each substring is an index of its own.  A code within
Hamming radius r of the query's has a substring j within r[j] of the query's, for
any r[j] that sum to r - substrings + 1 (pigeonhole); probing every bucket within
r[j] in each index thus retrieves every code within r.  What passes the full code's
radius is reranked by inner product in double precision.

The rotation and the radius are fitted on the SAMPLE rows with the smallest hash: the
radius is the one at which RECALL of the sample's own nearest neighbours are
retrieved, which in a larger table are nearer.  All rows are indexed.  Every
partition of the table indexes its rows and answers all queries, which come in
blocks of QUERY_BLOCK; a search that finds under k widens its radius until it has
k.  Then the best k of each query over all partitions are taken.

Defined cases: vectors that are null, zero, of another dimension than the table's
most frequent one, or hold a null or non-finite component take no part; rows that
repeat a vec_id count once, as the nearest of them, and ask by the vector that
sorts first; null ids take no part; with
fewer than k candidates all are returned; ties go to the smaller vec_id; other
columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import materialize, tidy

SAMPLE, RECALL, QUERY_BLOCK, CHUNK = 4096, 0.97, 8192, 1 << 16
_POP16 = np.bitwise_count(np.arange(1 << 16, dtype=np.uint32)).astype(np.uint8)


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>) of the vectors that take part."""
    ok = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull()).where(ok)
    dim = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("embedding") == (dim["d"] if dim else 0))


class Codes:
    """Learned rotated binary codes."""

    def __init__(self, x: np.ndarray, rounds: int = 30, seed: int = 3):
        self.mean = x.mean(axis=0)
        _, _, vt = np.linalg.svd(x - self.mean, full_matrices=False)
        vt = vt[:64]
        v = (x - self.mean) @ vt.T
        r = np.linalg.qr(np.random.default_rng(seed).normal(size=(vt.shape[0],) * 2))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
            r = (u @ w).T
        self.rotation, self.bits = vt.T @ r, vt.shape[0]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        bits = (x - self.mean) @ self.rotation > 0
        padded = np.zeros((len(x), 64), bool)
        padded[:, : self.bits] = bits
        return np.packbits(padded, axis=1, bitorder="little").view(np.uint64).ravel()


def fit_radius(codes: Codes, x: np.ndarray, k: int, recall: float, n_queries: int = 512) -> int:
    """The Hamming radius that holds a share of the nearest neighbours of some of the sample's vectors."""
    c = codes(x)
    s = x[:n_queries] @ x.T
    s[np.arange(len(s)), np.arange(len(s))] = -np.inf
    near = np.argsort(-s, axis=1)[:, : min(k, len(x) - 1)]
    d = np.sort(np.bitwise_count(c[:n_queries, None] ^ c[near]).ravel())
    return int(d[min(len(d) - 1, int(np.ceil(recall * len(d))))]) if len(d) else 64


class MultiIndex:
    """An index over one chunk of rows: for each substring its rows sorted by value, and where each value begins."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, bits: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.codes = ids[order], vectors[order], codes[order]
        width = int(np.clip(np.log2(max(2, len(ids))), 4, 16))
        m = -(-bits // width)
        cuts = [bits * j // m for j in range(m + 1)]
        self.parts = []
        for lo, hi in zip(cuts, cuts[1:]):
            v = self.substring(self.codes, lo, hi)
            rows = np.argsort(v, kind="stable")
            self.parts.append((lo, hi, rows, np.searchsorted(v[rows], np.arange((1 << (hi - lo)) + 1))))

    @staticmethod
    def substring(codes: np.ndarray, lo: int, hi: int) -> np.ndarray:
        return (codes >> np.uint64(lo) & np.uint64((1 << (hi - lo)) - 1)).astype(np.int64)

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """All rows whose code differs in radius bits at most."""
        m = len(self.parts)
        share = radius - m + 1
        hit = np.zeros(len(self.ids), bool)
        for j, (lo, hi, rows, starts) in enumerate(self.parts):
            r = (share + j) // m  # the parts sum to share
            if r < 0:
                continue
            values = np.flatnonzero(_POP16[np.arange(1 << (hi - lo)) ^ int(self.substring(code, lo, hi))] <= r)
            n = starts[values + 1] - starts[values]
            some = n > 0
            n, first = n[some], starts[values[some]]
            hit[rows[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]] = True
        found = np.flatnonzero(hit)
        return found[np.bitwise_count(self.codes[found] ^ code) <= radius]

    def search(self, qid: int, q: np.ndarray, code: np.uint64, radius: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        while True:
            found = self.within(code, radius)
            found = found[self.ids[found] != qid]
            if len(found) >= k or radius >= 64:
                break
            radius = min(64, radius + 2)
        # rows are summed one by one in the same order, so equal vectors get equal scores
        score = np.ascontiguousarray(self.vectors[found] * q).sum(axis=1)
        if len(found) > k:
            edge = np.partition(score, len(score) - k)[len(score) - k]
            keep = score >= edge
            found, score = found[keep], score[keep]
        order = np.lexsort((self.ids[found], -score))[:k]
        return self.ids[found][order], score[order]


def search(base: DataFrame, is_query, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row of base (vec_id, embedding) that the condition is_query on vec_id names."""
    spark = base.sparkSession
    rows = materialize(usable(base), "vectors")
    sample = np.array([r["embedding"] for r in rows.orderBy(F.xxhash64("vec_id", "embedding")).limit(SAMPLE).select("embedding").collect()], float)
    schema = "query_id bigint, vec_id bigint, score double"
    if len(sample) < 2:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    codes = Codes(sample)
    radius = fit_radius(codes, sample, k, RECALL)
    queries = materialize(rows.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    block_of = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks))
    found = None
    for block in range(n_blocks):
        part = queries.where(block_of == block).toArrow()  # about QUERY_BLOCK vectors
        qid = part.column("vec_id").to_numpy()
        qv = np.array(part.column("embedding").to_pylist(), float).reshape(len(qid), -1)
        asked = spark.sparkContext.broadcast((qid, qv))

        def run(batches, asked=asked):
            qid, qv = asked.value
            qc = codes(qv) if len(qv) else np.zeros(0, np.uint64)

            def answer(ids, vectors):
                x = np.concatenate(vectors)
                index = MultiIndex(np.concatenate(ids), x, codes(x), codes.bits)
                out = [index.search(i, v, c, radius, k) for i, v, c in zip(qid, qv, qc)]
                n = [len(o[0]) for o in out]
                return pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, n), pa.int64()), *[pa.array(np.concatenate([o[j] for o in out]) if out else [], t) for j, t in enumerate((pa.int64(), pa.float64()))]], ["query_id", "vec_id", "score"])

            ids, vectors, held = [], [], 0
            for b in batches:
                if not b.num_rows:
                    continue
                ids.append(b.column("vec_id").to_numpy())
                vectors.append(b.column("embedding").flatten().to_numpy().reshape(b.num_rows, -1))
                held += b.num_rows
                if held >= CHUNK:
                    yield answer(ids, vectors)
                    ids, vectors, held = [], [], 0
            if held:
                yield answer(ids, vectors)

        near = rows.mapInArrow(tidy(run), schema)
        found = near if found is None else found.union(near)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op_rows(base: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The rows whose vec_id is divisible by every, searched among all rows."""
    return search(base, F.pmod(F.col("vec_id"), F.lit(every)) == 0, k)
