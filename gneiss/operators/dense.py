"""Exact dense ranking: a stated query set against all rows, in blocks.

A block of queries is a matrix of bounded size that goes to where the vectors are; each task multiplies its batches
with it and keeps the best rows of each query, so what is shuffled is ``k`` rows per query and task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES_AT_ONCE, CELLS = 4096, 500_000


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def batches_of(batches: Iterator[pa.RecordBatch], most: int = 2048) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, most):
            yield b.slice(at, most)


def best_rows(ids: np.ndarray, q: np.ndarray, k: int, earlier: bool, digits: int):
    """Rows (id, group, vector) -> (query_id, group, id, score): the best ``k`` of this task by query, or by query
    and group if groups are not null. ``earlier``: only rows with a smaller id than the query's; else all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int | None, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches_of(batches, max(1, min(2048, CELLS // max(1, len(ids))))):  # scores held at once do not grow with queries
            row = np.asarray(b.column(0))
            score = np.round(q @ matrix(b.column(2)).T, digits)
            score[(row[None, :] >= ids[:, None]) if earlier else (row[None, :] == ids[:, None])] = -np.inf
            codes = b.column(1).dictionary_encode()
            code = np.asarray(codes.indices.fill_null(-1))
            for c in np.unique(code).tolist():
                group = None if c < 0 else codes.dictionary[c].as_py()
                mine = np.flatnonzero(code == c)
                s, i = score[:, mine], np.broadcast_to(row[mine], (len(ids), len(mine)))
                if group in best:
                    s, i = np.concatenate([best[group][0], s], axis=1), np.concatenate([best[group][1], i], axis=1)
                order = np.lexsort((i, -s), axis=1)[:, :k]
                best[group] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        for group, (s, i) in best.items():
            there = np.isfinite(s)
            of = np.nonzero(there)[0]
            yield pa.RecordBatch.from_arrays([pa.array(ids[of]), pa.array([group] * len(of), pa.int64()), pa.array(i[there]), pa.array(s[there])], ["query_id", "group", "id", "score"])

    return run


def best_of(vectors: DataFrame, queries: DataFrame, id_col: str, emb: str, k: int, group: str | None = None, earlier: bool = False, digits: int = 6) -> DataFrame:
    """(query_id, group, id, score): what can be among the best ``k``; the caller ranks. Rows with a null id or vector
    take no part; all vectors have one length."""
    plain = lambda d: d.where(F.col(id_col).isNotNull() & F.col(emb).isNotNull())
    q = plain(queries).select(F.col(id_col).cast("long").alias("id"), F.col(emb).cast("array<double>").alias("v"))
    blocks = max(1, -(-q.count() // QUERIES_AT_ONCE))
    rows = plain(vectors).select(F.col(id_col).cast("long").alias("id"), (F.col(group) if group else F.lit(None)).cast("long").alias("g"), F.col(emb).cast("array<double>").alias("v"))
    out = None
    for part in range(blocks):
        got = q.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == part).toArrow().combine_chunks()
        if not got.num_rows:
            continue
        got = got.to_batches()[0]
        found = rows.mapInArrow(best_rows(np.asarray(got.column(0)), matrix(got.column(1)), k, earlier, digits), "query_id long, group long, id long, score double")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else vectors.sparkSession.createDataFrame([], "query_id long, group long, id long, score double")


def sums_of_products():
    """Rows (group, p, g) -> (group, i, row): this task's sums of P'P and P'G by group, side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches_of(batches):
            group, p, g = np.asarray(b.column(0)), matrix(b.column(1)), matrix(b.column(2))
            for k in np.unique(group).tolist():
                mine = group == k
                s = p[mine].T @ np.concatenate([p[mine], g[mine]], axis=1)
                sums[k] = sums[k] + s if k in sums else s
        for k, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), k)), pa.array(np.arange(len(s), dtype=np.int32)), pa.array(s.tolist(), pa.list_(pa.float64()))], ["group", "i", "row"])

    return run


def linear_maps(pairs: DataFrame) -> DataFrame:
    """(group, map): for rows (group, p, g) of each group the least-squares map X with P X = G, row by row, from
    (P'P) X = P'G. Sums are made where rows are, so what is solved has the size of a vector squared."""
    import pandas as pd

    d = pairs.select(F.col("group").cast("long").alias("group"), F.col("p").cast("array<double>").alias("p"), F.col("g").cast("array<double>").alias("g"))
    part = d.mapInArrow(sums_of_products(), "group long, i int, row array<double>")
    whole = part.select("group", "i", F.posexplode("row").alias("j", "x")).groupBy("group", "i", "j").agg(F.sum("x").alias("x"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["i"].max()) + 1
        s = np.zeros((n, int(pdf["j"].max()) + 1))
        s[pdf["i"], pdf["j"]] = pdf["x"]
        x = np.linalg.lstsq(s[:, :n], s[:, n:], rcond=1e-10)[0]
        return pd.DataFrame({"group": [pdf["group"].iloc[0]], "map": [x.tolist()]})

    return whole.groupBy("group").applyInPandas(solve, "group long, map array<array<double>>")
