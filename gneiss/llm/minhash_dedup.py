"""Near-duplicate documents by min-max hashing.

Of every permutation of a document's word shingles both the smallest and the largest value are kept, so half the
permutations give the same number of signature values, and the two are negatively correlated, which lowers the
variance of the estimate without bias. The values are cut into bands; documents that agree in a band meet.

Copies are folded first: documents with the same shingle set share one representative. Within a bucket every
member is tied to the smallest one only, so buckets make at most as many rows as they have members. The clusters
that these ties make are then confirmed on full shingle sets: exact prefix filtering inside blocks of bounded
size, pairs of blocks for clusters beyond that. Confirmed links make the components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.components import components
from gneiss.llm.store import cut
from gneiss.llm.words import LOWER, M2, M3, Chunk, chunks, grams, mix

EMPTY = np.empty(0, np.uint64)


def shingle_sets(c: Chunk, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of the chunk; a text with fewer words is one shingle."""
    g = grams(c.h, size)
    for start, n in zip(c.start.tolist(), c.size.tolist(), strict=True):
        if n >= size:
            yield np.unique(g[start : start + n - size + 1])
        else:
            yield grams(c.h[start : start + n], n, M3) if n else EMPTY


def multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * M3) | np.uint64(1)


def min_max(s: np.ndarray, by: np.ndarray, values: int) -> np.ndarray:
    """``values`` signature values: the minima, then the maxima, under the permutations x -> x * by."""
    low, high = np.empty(len(by), np.uint64), np.empty(len(by), np.uint64)
    step = max(1, 32768 // len(s))
    for at in range(0, len(by), step):
        m = s[None, :] * by[at : at + step, None]
        m.min(axis=1, out=low[at : at + step])
        m.max(axis=1, out=high[at : at + step])
    return np.concatenate([low, high])[:values]


def signatures(size: int, bands: int, rows: int):
    by = multipliers(-(-bands * rows // 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(bands, dtype=np.uint64) + M2)
        for c in chunks(batches, values=LOWER):
            ids, count, one, two, keys = [], [], [], [], []
            for (i,), s in zip(c.rows, shingle_sets(c, size), strict=True):
                ids.append(i)
                count.append(len(s))
                d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                one.append(int.from_bytes(d[:8], "little", signed=True))
                two.append(int.from_bytes(d[8:], "little", signed=True))
                if len(s) and i is not None:
                    k = salt.copy()
                    for column in min_max(mix(s), by, bands * rows).reshape(bands, rows).T:
                        k = mix(k * M3 + column)
                    keys.append(k.view(np.int64))
                else:
                    keys.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(count, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n", "s1", "s2", "bands"])

    return run


def links_within(ids: list[int], sets: list[np.ndarray], side: np.ndarray | None, top: int, bottom: int) -> list[tuple[int, int]]:
    """Pairs with bottom * intersection >= top * union that join all that such pairs join, at most one fewer than
    there are sets. ``side``: only pairs of unlike sides count. Exact: a linked pair shares one of the rarest
    n - ceil(n * top / bottom) + 1 shingles of either, in any common order of shingles."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    ends = np.cumsum(size)
    _, tok, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df))
    tok = rank[tok]  # rarest first
    own = [np.sort(tok[e - n : e]) for e, n in zip(ends, size, strict=True)]
    prefix = [o[: n - -(-top * n // bottom) + 1] for o, n in zip(own, size.tolist(), strict=True)]
    flat = np.concatenate(prefix)
    who = np.repeat(np.arange(m), [len(p) for p in prefix])
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    label = np.arange(m)
    mark = np.zeros(len(df), bool)
    out = []
    for x in range(m):
        lo, hi = np.searchsorted(flat, prefix[x]), np.searchsorted(flat, prefix[x], "right")
        wide = hi - lo > 1
        if not wide.any():
            continue
        cand = np.unique(np.concatenate([who[a:b] for a, b in zip(lo[wide].tolist(), hi[wide].tolist(), strict=True)]))
        cand = cand[(cand < x) & (label[cand] != label[x])]
        cand = cand[(bottom * np.minimum(size[cand], size[x])) >= top * np.maximum(size[cand], size[x])]
        if side is not None:
            cand = cand[side[cand] != side[x]]
        if not len(cand):
            continue
        mark[own[x]] = True
        while len(cand):
            y, cand = cand[0], cand[1:]
            both = int(np.count_nonzero(mark[own[y]]))
            if bottom * both >= top * (int(size[x]) + int(size[y]) - both):
                out.append((ids[x], ids[y]))
                label[label == label[y]] = label[x]
                cand = cand[label[cand] != label[x]]
        mark[own[x]] = False
    return out


def confirm(size: int, top: int, bottom: int):
    """Input, sorted by cluster and pair of blocks: cluster, i, j, block, doc_id, s1, s2, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen, ids, sets, blocks = None, set(), [], [], []

        def done():
            if len(ids) > 1:
                side = None if at[1] == at[2] else np.array(blocks)
                if found := links_within(ids, sets, side, top, bottom):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

        for c in chunks(batches, text=7, values=LOWER):
            for (cluster, i, j, block, d, s1, s2), s in zip(c.rows, shingle_sets(c, size), strict=True):
                if (cluster, i, j) != at:
                    yield from done()
                    at, seen, ids, sets, blocks = (cluster, i, j), set(), [], [], []
                if (d, s1, s2) in seen:
                    continue
                h = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                if (int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)) == (s1, s2):
                    seen.add((d, s1, s2))
                    ids.append(d)
                    sets.append(s)
                    blocks.append(block)
        yield from done()

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, top: int = 85, bottom: int = 100, bands: int = 25, rows: int = 5, block: int = 2_000_000
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Links join documents with ``bottom`` * intersection >= ``top`` * union of their ``size``-word shingle sets
    (A-Z lower-cased); component_id is the smallest id reachable and ``kept`` marks that document. Candidates come
    from ``bands`` bands of ``rows`` min-max values each: at the threshold of 0.85 a pair is missed with
    probability (1 - 0.85^5)^25 < 5e-7. ``block``: shingles of a cluster that one task holds at a time.

    Null and empty texts and texts without words have no shingles, are linked with nothing and kept. A row with a
    null id is linked with nothing, has a null component and is kept. Repeated rows are copies of each other. Rows
    that share an id count as linked. Other columns are ignored. No rows: no rows.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sig = cut(d.mapInArrow(signatures(size, bands, rows), "doc_id long, n long, s1 long, s2 long, bands array<long>"))
    live = sig.where("n > 0 AND doc_id IS NOT NULL")
    reps = live.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"))
    known = live.join(reps.withColumnRenamed("rep", "doc_id"), ["s1", "s2", "doc_id"])
    keys = known.select("doc_id", F.explode("bands").alias("key"))
    pivots = keys.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("m")).where("m > 1").select("key", "pivot")
    ties = keys.join(pivots, "key").where("doc_id != pivot").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b"))
    cluster = components(ties).withColumnsRenamed({"node": "doc_id", "component": "cluster"})
    member = cut(known.select("doc_id", "s1", "s2", "n").distinct().join(cluster, "doc_id"))
    parts = member.groupBy("cluster").agg(F.ceil(F.sum("n") / F.lit(block)).cast("int").alias("blocks"))
    member = member.join(parts, "cluster").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = member.withColumn("other", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    # merged at every size: as a broadcast join small inputs would have another plan than large ones
    dealt = dealt.hint("merge").join(d, "doc_id").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "doc_id")
    links = dealt.select("cluster", "i", "j", "block", "doc_id", "s1", "s2", "text").mapInArrow(confirm(size, top, bottom), "a long, b long")
    joined = components(links).withColumnRenamed("node", "rep")
    return (
        sig.select("doc_id", "n", "s1", "s2")
        .join(reps, ["s1", "s2"], "left")
        .join(joined, "rep", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def op10_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda z: z <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS node, a AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, w.doc_id) AS component_id, coalesce(m.c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node, min(reach) AS c FROM r GROUP BY node) m ON m.node = w.doc_id
"""
