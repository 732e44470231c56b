"""Suffix-array dedup: every byte covered by a string of ``length`` bytes that starts anywhere else too is removed.

What has to be sorted is narrowed down and dealt out first. Of the ``seed``-byte grams inside a window of
``length`` bytes the one with the smallest hash (the rightmost of equals) is the window's anchor, so equal windows
have equal anchors at the same place. A window belongs to one anchor occurrence, and those of one occurrence make
up its region. Regions of anchors that occur once hold no repeat. Regions that occur whole more than once are
repeats in all their windows, however many copies there are. One copy of each other region of a shared anchor goes
to the anchor's shard, where suffixes and common prefixes come from external induced sorting (``suffix_sort``):
suffixes that share ``length`` bytes with a neighbour are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.ids import told_apart
from gneiss.llm.store import cut, free
from gneiss.llm.suffix_sort import repeated_starts
from gneiss.llm.words import M2, M3, POWERS, VALUE, as_bytes, mix, small

PLACE_BITS = 23  # of the place in a chunk, below the hash, so that the smallest key is the rightmost of equals
PIECE = 1 << 22


def pieces(batches: Iterator[pa.RecordBatch], length: int, at_once: int = 300_000):
    """(ids, offsets, bytes) of texts with a window, many short ones at a time; long ones in pieces that overlap by
    length - 1 bytes, so every window is in one piece."""
    ids, offsets, texts, n = [], [], [], 0
    for b in small(batches):
        for i, t in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
            if i is None or t is None:
                continue
            for at in range(0, max(0, len(t) - length + 1), PIECE):
                ids.append(i)
                offsets.append(at)
                texts.append(t[at : at + PIECE + length - 1])
                n += len(texts[-1])
                if n >= at_once:
                    yield ids, offsets, texts
                    ids, offsets, texts, n = [], [], [], 0
    if ids:
        yield ids, offsets, texts


def least_of(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every ``w`` consecutive values, from running minima of blocks of ``w`` both ways."""
    n = len(x) - w + 1
    pad = np.full(-len(x) % w, np.iinfo(np.uint64).max, np.uint64)
    y = np.concatenate([x, pad]).reshape(-1, w)
    right = np.minimum.accumulate(y, axis=1).ravel()
    left = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[:n], right[w - 1 : w - 1 + n])


def occurrences(length: int, seed: int):
    """(doc_id, first, windows, anchor, region) of every anchor occurrence: its first window and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.uint64((1 << PLACE_BITS) - 1)
        for ids, offsets, texts in pieces(batches, length):
            size = np.array([len(t) for t in texts])
            start = np.cumsum(size) - size
            data = np.frombuffer(b"".join(texts), np.uint8)
            up, down = POWERS(len(data))
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(VALUE[data] * up, out=total[1:])
            grams = mix((total[seed:] - total[:-seed]) * down[: len(data) - seed + 1])
            place = np.arange(len(grams), dtype=np.uint64)
            own = (mask - (least_of((grams & ~mask) | (mask - place), length - seed + 1) & mask)).astype(np.int64)
            of = np.repeat(np.arange(len(texts)), size)
            inside = of[: len(own)] == of[length - 1 :]
            valid = np.flatnonzero(inside)
            anchor = own[valid]
            edge = np.flatnonzero(np.diff(anchor))
            first = valid[np.concatenate([[0], edge + 1])]
            last = valid[np.concatenate([edge, [len(valid) - 1]])]
            at = own[first]
            span = (total[last + length] - total[first]) * down[first]
            shape = (at - first).astype(np.uint64) * np.uint64(1 << 32) + (last - first).astype(np.uint64)
            region = mix(mix(span) + shape * M3)
            doc = of[first]
            where = (first - start[doc] + np.array(offsets)[doc]).astype(np.int32)
            cols = [np.array(ids, np.int64)[doc], where, (last - first + 1).astype(np.int32), mix(grams[at] + M2).view(np.int64), region.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["doc_id", "first", "windows", "anchor", "region"])

    return run


def regions(length: int):
    """Rows (id, text, list of (first, windows, anchor)) -> (anchor, doc_id, first, piece)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 64):
            out: list[tuple] = []
            for i, t, spots in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                for s in spots if t else ():
                    out.append((s["anchor"], i, s["first"], t[s["first"] : s["first"] + s["windows"] + length - 1]))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["anchor", "doc_id", "first", "piece"])

    return run


def sort_shards(length: int, enough: int = 1_500_000):
    """Rows (anchor, doc_id, first, piece) in the order of anchors -> (doc_id, first, end) of repeated windows.
    Whole anchors are sorted together until they make a shard."""

    def shard(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows = list(dict.fromkeys(rows))  # a row that was there twice is one place
        out = []
        for (i, at, _), found in zip(rows, repeated_starts([r[2] for r in rows], length), strict=True):
            if len(found):
                edge = np.flatnonzero(np.diff(found) > 1)
                lo, hi = found[np.concatenate([[0], edge + 1])], found[np.concatenate([edge, [len(found) - 1]])]
                out.append((np.full(len(lo), i, np.int64), (lo + at).astype(np.int32), (hi + at + length).astype(np.int32)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["doc_id", "first", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n, at = [], 0, None
        for b in batches:
            for anchor, i, first, piece in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if anchor != at and n >= enough:
                    yield from shard(rows)
                    rows, n = [], 0
                at = anchor
                rows.append((i, first, piece))
                n += len(piece)
        if rows:
            yield from shard(rows)

    return run


def remove(texts: bool):
    """Rows (id, text, list of (first, end)) -> the result."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            spots = b.column(2)
            flat = pc.list_flatten(spots)
            first, end = np.asarray(pc.struct_field(flat, 0)), np.asarray(pc.struct_field(flat, 1))
            count = np.asarray(pc.fill_null(pc.list_value_length(spots), 0))
            at = 0
            out = []
            for i, t, n in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), count.tolist(), strict=True):
                t = t or b""
                runs, kept = [], t
                if n:
                    order = np.argsort(first[at : at + n], kind="stable")
                    f, e = first[at : at + n][order], np.maximum.accumulate(end[at : at + n][order])
                    new = np.concatenate([[True], f[1:] > e[:-1]])
                    lo, hi = f[new].tolist(), e[np.append(np.flatnonzero(new)[1:] - 1, n - 1)].tolist()
                    runs = list(zip(lo, hi, strict=True))
                    left, parts = 0, []
                    for x, y in runs:
                        parts.append(t[left:x])
                        left = y
                    kept = b"".join([*parts, t[left:]])
                at += n
                out.append((i, len(t), len(t) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), [{"start": x, "end": y} for x, y in runs], kept)[: 6 + texts])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=False)], names[: 6 + texts])

    return run


def dedup_suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, seed: int = 32, texts: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte ranges,
    end exclusive) and, with ``texts``, kept (the bytes that are left).

    Texts are UTF-8 bytes; null is empty. Matches never cross documents, overlaps count, and strings are judged on
    the input. All copies go, not all but one. Rows with a null id take no part and lose nothing. Rows that repeat
    an id with its text are one document, and each row gets its result; texts that share an id are documents of
    their own. Other columns are ignored. Long texts are
    handled in pieces that overlap. A shard holds whole anchors, so its size is bounded by ``sort_shards`` and the
    distinct regions of one anchor; the sorter's queues go to disk beyond their limit.
    """
    if not 0 < seed <= length:
        raise ValueError("seed must be from 1 to length")
    d, back = told_apart(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    occ = d.mapInArrow(occurrences(length, seed), "doc_id long, first int, windows int, anchor long, region long").where("doc_id IS NOT NULL")
    counted = occ.groupBy("anchor").agg(F.count("*").alias("n"), F.min("region").alias("low"), F.max("region").alias("high"))
    shared = cut(counted.where("n > 1").select("anchor", F.expr("low != high").alias("mixed")))  # a table of its own, so that the join below can split hot anchors
    again = cut(occ.hint("merge").join(shared, "anchor"))
    free(shared)
    place = F.struct("doc_id", "first")
    whole = again.groupBy("anchor", "region").agg(F.min(place).alias("one"), F.max(place).alias("other"), F.max("mixed").alias("mixed"), F.max("windows").alias("windows"))
    whole = cut(whole.withColumn("repeats", F.expr("one != other")))
    spots = whole.where("mixed").groupBy("one.doc_id").agg(F.collect_list(F.struct(F.col("one.first").alias("first"), "windows", "anchor")).alias("spots"))
    found = d.hint("merge").join(spots, "doc_id").select("doc_id", "text", "spots").mapInArrow(regions(length), "anchor long, doc_id long, first int, piece binary")
    found = found.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "first").mapInArrow(sort_shards(length), "doc_id long, first int, end int")
    copies = again.join(whole.where("repeats").select("anchor", "region"), ["anchor", "region"], "left_semi")
    spans = found.unionByName(copies.select("doc_id", "first", (F.col("first") + F.col("windows") + F.lit(length - 1)).cast("int").alias("end")))
    marks = cut(spans.groupBy("doc_id").agg(F.collect_list(F.struct("first", "end")).alias("marks")))
    free(again)
    free(whole)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>" + ", kept binary" * texts
    return back(d.hint("merge").join(marks, "doc_id", "left").select("doc_id", "text", "marks").mapInArrow(remove(texts), schema))


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_suffixes(docs, texts=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP1_SQL = """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS t, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, unnest(range(0, octet_length(t) - 199)) AS i, t FROM b WHERE octet_length(t) >= 200),
h AS (SELECT doc_id, i, md5(array_slice(t, i + 1, i + 200)) AS h FROM w),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1),
f AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200, true) AS new FROM r),
g AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f),
s AS (SELECT doc_id, run, min(i) AS lo, max(i) + 200 AS hi FROM g GROUP BY ALL),
p AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS z FROM s
      UNION ALL SELECT doc_id, max(hi) AS a, NULL AS z FROM s GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(CASE WHEN z IS NULL THEN substr(x, 2 * a + 1) ELSE substr(x, 2 * a + 1, 2 * (z - a)) END, '' ORDER BY a) AS kept FROM p JOIN b USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, sum(hi - lo) AS gone, count(*) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, octet_length(t)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(CASE WHEN gone IS NULL THEN t ELSE unhex(kept) END) AS kept_sha256
FROM b LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""
