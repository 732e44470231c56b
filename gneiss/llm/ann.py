"""Approximate nearest neighbours by multi-index hashing.

Vectors get binary codes from learned rotations: each rotation is fitted to a bounded sample so that the signs of
the rotated vectors lose least (iterative quantisation), and several rotations from different starts make longer
codes. A code is split into 16-bit substrings, each with a table of its own. By the pigeonhole principle a code
within Hamming radius r has some substring within that substring's share of r, so probing the tables retrieves
every code within the radius; those are checked on the whole code and reranked on the vectors in double precision.

Every row is indexed, in blocks of bounded size; a query visits every block. For inner products vectors are first
lifted onto a sphere by one more coordinate, so that the nearest by angle has the largest product.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS = 16


def lift(x: np.ndarray, largest: float) -> np.ndarray:
    """Rows with one more coordinate that brings all of them to the norm ``largest``."""
    rest = np.sqrt(np.maximum(0.0, largest**2 - (x * x).sum(1)))
    return np.concatenate([x, rest[:, None]], axis=1)


class Coder:
    """Learned rotations, the Hamming radius to search, and the norm that vectors are lifted to."""

    def __init__(self, sample: np.ndarray, largest: float, rows: int, k: int, bits: int = 256, steps: int = 12, share: float = 0.985, queries: int = 256):
        self.largest = largest
        v = lift(sample, largest)
        d = v.shape[1]
        many = -(-bits // d)
        self.bits = min(bits, many * d) // BITS * BITS or BITS
        r = np.random.default_rng(0)
        found = []
        for _ in range(-(-self.bits // d)):
            q, _ = np.linalg.qr(r.normal(size=(d, d)))
            for _ in range(steps if len(v) > 1 else 0):
                u, _, w = np.linalg.svd(np.where(v @ q >= 0, 1.0, -1.0).T @ v)
                q = (u @ w).T
            found.append(q)
        self.rotation = np.concatenate(found, axis=1)[:, : self.bits]
        if self.rotation.shape[1] < self.bits:  # d below 16
            self.rotation = np.tile(self.rotation, (1, -(-self.bits // self.rotation.shape[1])))[:, : self.bits]
        # radius: what holds the sample's own nearest, at the rank that k has among all rows
        m = min(queries, len(v))
        self.radius = self.bits
        if len(v) > 1:
            scores = sample[:m] @ sample.T
            scores[np.arange(m), np.arange(m)] = -np.inf
            near = np.argsort(-scores, axis=1)[:, : max(1, min(len(v) - 1, round(k * len(v) / max(1, rows))))]
            codes = self.codes(sample)
            far = np.concatenate([hamming(codes[near[i]], self.query_code(sample[i])) for i in range(m)])
            self.radius = int(np.quantile(far, share))

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(lift(x, self.largest) @ self.rotation >= 0, axis=1).view(np.uint16)

    def query_code(self, q: np.ndarray) -> np.ndarray:
        return np.packbits(np.append(q, 0.0) @ self.rotation >= 0).view(np.uint16)


def hamming(codes: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ q).sum(axis=1, dtype=np.int64)


MASKS = [np.array([sum(1 << b for b in c) for c in combinations(range(BITS), t)], np.uint16) for t in range(4)]


class Table:
    """One substring of all codes of a block: rows by value."""

    def __init__(self, values: np.ndarray):
        self.rows = np.argsort(values, kind="stable")
        self.keys, self.first, self.count = np.unique(values[self.rows], return_index=True, return_counts=True)

    def probe(self, q: np.uint16, within: int, found: np.ndarray) -> None:
        """Marks the rows whose value is within a Hamming distance of ``q``: by looking up the values at that
        distance, or by looking through the values there are, whichever are fewer."""
        if within < 0:
            return
        if within < len(MASKS) and sum(len(m) for m in MASKS[: within + 1]) < len(self.keys):
            probes = np.concatenate(MASKS[: within + 1]) ^ q
            at = np.minimum(np.searchsorted(self.keys, probes), len(self.keys) - 1)
            hit = at[self.keys[at] == probes]
        else:
            hit = np.flatnonzero(np.bitwise_count(self.keys ^ q) <= within)
        if len(hit) == len(self.keys):
            found[:] = True
            return
        count = self.count[hit]
        if count.sum() == 0:
            return
        place = np.repeat(self.first[hit] - np.cumsum(count) + count, count) + np.arange(count.sum())
        found[self.rows[place]] = True


class Index:
    def __init__(self, ids: np.ndarray, x: np.ndarray, coder: Coder):
        self.ids, self.x, self.coder = ids, x, coder
        self.codes = coder.codes(x)
        self.tables = [Table(self.codes[:, t]) for t in range(self.codes.shape[1])]

    def met(self, q: np.ndarray, radius: int) -> np.ndarray:
        """Which rows the tables let through: all within the radius, and others. The substrings' shares add up to
        radius + 1 - tables: if each one were exceeded, the whole distance would exceed the radius."""
        found = np.zeros(len(self.ids), bool)
        spare = radius + 1 - len(self.tables)
        share, more = divmod(spare, len(self.tables))
        for t, table in enumerate(self.tables):
            table.probe(q[t], share + (t < more), found)
        return found

    def within(self, q: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code is within the radius."""
        rows = np.flatnonzero(self.met(q, radius))
        return rows[hamming(self.codes[rows], q) <= radius]

    def search(self, i: int, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best rows found in this block; the radius grows until there are k, or all."""
        q, radius = self.coder.query_code(v), self.coder.radius
        while True:
            rows = self.within(q, radius)
            rows = rows[self.ids[rows] != i]
            if len(rows) >= k or radius >= self.coder.bits:
                break
            radius += max(1, self.coder.bits // 32)
        score = self.x[rows] @ v
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[best]], score[best]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    d = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return d.where("vec_id IS NOT NULL AND v IS NOT NULL").where(whole)


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, sample: int = 4096, block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` (same columns) the ``k`` rows of ``vectors``
    with another id found nearest by inner product, best first, equal scores by smaller id.

    ``sample`` bounds the rows that rotations and radius are learned from; ``block`` the rows one index holds.
    Vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids, nor lengths
    other than the most frequent one. An id that repeats counts once, with its smallest vector. No rows: no rows.
    """
    d = usable(vectors, id_col, vector_col)
    sizes = d.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top")).orderBy(F.desc("rows"), "n").first()
    if sizes is None:
        return d.select("vec_id").limit(0).selectExpr("vec_id AS query_id", "0 AS rank", "vec_id", "0D AS score")
    length, rows, largest = sizes.n, sizes.rows, float(np.sqrt(sizes.top))
    only = lambda x: x.where(F.size("v") == length).groupBy("vec_id").agg(F.min("v").alias("v"))
    d = only(d)
    got = d.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    coder = Coder(np.array(got.v.tolist(), np.float64), largest * (1 + 1e-12), rows, k)
    shared = d.sparkSession.sparkContext.broadcast(coder)
    blocks = max(1, -(-rows // block))
    here = d.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), F.lit(0).alias("kind"), "vec_id", "v")
    asked = only(usable(queries, id_col, vector_col)).select(F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block"), F.lit(1).alias("kind"), "vec_id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, xs, index = None, [], [], None
        for b in batches:
            n = np.asarray(b.column(0)), np.asarray(b.column(1)), np.asarray(b.column(2))
            v = np.asarray(b.column(3).flatten()).reshape(len(b), -1)
            out = []
            edge = np.flatnonzero(np.diff(n[0]) | np.diff(n[1])) + 1
            for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(b)], strict=True):
                if lo == hi:
                    continue
                if n[0][lo] != at:
                    at, ids, xs, index = n[0][lo], [], [], None
                if n[1][lo] == 0:
                    ids.append(n[2][lo:hi].copy())
                    xs.append(v[lo:hi].copy())
                    continue
                if index is None and ids:
                    index = Index(np.concatenate(ids), np.concatenate(xs), shared.value)
                if index is not None:
                    for i, q in zip(n[2][lo:hi].tolist(), v[lo:hi], strict=True):
                        near, score = index.search(i, q, k)
                        out.append((np.full(len(near), i, np.int64), near, score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    dealt = here.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "kind", "vec_id")
    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_multi_index_hashing(spark, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(e, e.where("vec_id % 20 = 0"))
