"""Substring dedup by seeds: word windows that already occur earlier are removed.

Seeds are winnowed anchors: of the ``seed``-word grams inside a window of ``window`` words, the one with the
smallest hash (the rightmost of equals) is the window's anchor. Equal windows choose the same anchor at the same
place, so equal windows are among those of one anchor. A window belongs to one anchor occurrence, and the windows of
one occurrence are consecutive; they make up its region, which is as far as a match at the seed can reach.

* An occurrence whose whole region stands earlier too is a repeat in all its windows: regions that match as a
  whole need no look at single windows, however many copies there are.
* The first occurrences of an anchor's different regions are not joined in pairs and extended word by word, which
  would make a hot anchor's work grow with the square of its regions: their windows are grouped by a 128-bit hash.
  What is found is what extension of the pairs would find.

Windows that follow each other make repeats of at least ``window`` words; the words that they cover go.
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
from gneiss.llm.words import M1, M2, M3, POWERS, Chunk, as_bytes, chunks, grams, mix, small

OCCURRENCES = "doc_id long, pos int, anchor long, region long"


def owners(h: np.ndarray, window: int, seed: int) -> np.ndarray:
    """For each window start, the place of the gram that is the window's anchor."""
    g = grams(h, seed, M3)
    at = np.arange(len(g), dtype=np.int32)
    w, span = window - seed + 1, 1

    def halves(best: np.ndarray, at: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(best) - by
        right = best[by:] <= best[:n]  # the rightmost of equals
        return np.where(right, best[by:], best[:n]), np.where(right, at[by:], at[:n])

    while 2 * span <= w:
        g, at = halves(g, at, span)
        span *= 2
    if span < w:
        g, at = halves(g, at, w - span)
    return at


def valid_windows(c: Chunk, window: int) -> np.ndarray:
    """Which windows of the chunk lie inside one text of a row that has an id."""
    named = np.array([r[0] is not None for r in c.rows], bool)
    n = max(0, len(c.h) - window + 1)
    return (c.of[:n] == c.of[window - 1 :]) & named[c.of[:n]]


def marked_windows(c: Chunk, places: list[list[int] | None], window: int, seed: int) -> np.ndarray:
    """Which windows have their anchor at one of the places listed for their row."""
    at = np.zeros(len(c.h), bool)
    for start, p in zip(c.start.tolist(), places, strict=True):
        if p:
            p = np.array(p, np.int64)
            at[start + p[p < len(c.h) - start]] = True
    return valid_windows(c, window) & at[owners(c.h, window, seed)]


def occurrences(window: int, seed: int):
    """(doc_id, pos, anchor, region) of every anchor occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches):
            valid = np.flatnonzero(valid_windows(c, window))
            if not len(valid):
                continue
            own = owners(c.h, window, seed)[valid]
            cut = np.flatnonzero(np.diff(own))
            first = valid[np.concatenate([[0], cut + 1])]
            last = valid[np.concatenate([cut, [len(own) - 1]])]
            at = own[np.concatenate([[0], cut + 1])]
            doc = c.of[first]
            # a region is the words first .. last + window - 1: a difference of prefix sums weighted by place
            up, down = POWERS(len(c.h))
            total = np.zeros(len(c.h) + 1, np.uint64)
            np.cumsum(mix(c.h + M2) * up, out=total[1:])
            span = (total[last + window] - total[first]) * down[first]
            shape = (at - first).astype(np.uint64) * np.uint64(1 << 24) + (last - first).astype(np.uint64)
            anchor = grams(c.h, seed, M3)[at]
            ids = np.array([r[0] or 0 for r in c.rows], np.int64)[doc]  # windows of rows without an id are not valid
            cols = [ids, (at - c.start[doc]).astype(np.int32), anchor.view(np.int64), mix(mix(span) + shape * M3).view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["doc_id", "pos", "anchor", "region"])

    return run


def expand(window: int, seed: int):
    """(doc_id, start, two hashes) of the windows of the anchor occurrences listed for a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches):
            if len(c.h) < window:
                continue
            at = np.flatnonzero(marked_windows(c, [r[1] for r in c.rows], window, seed))
            doc = c.of[at]
            ids = np.array([r[0] or 0 for r in c.rows], np.int64)[doc]  # windows of rows without an id are not valid
            cols = [ids, (at - c.start[doc]).astype(np.int32), grams(c.h, window, M1)[at].view(np.int64), grams(c.h, window, M2)[at].view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["doc_id", "start", "h1", "h2"])

    return run


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>"


def remove(window: int, seed: int, texts: bool):
    """Rows (id, text, places, starts) -> the result."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span] + [pa.binary()] * texts
        cols = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
        if texts:
            cols[-1] = cols[-1].cast(pa.string())
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"][: len(cols)])

    def row(i, n: int, keep: list[bytes], runs: list) -> tuple:
        kept = b" ".join(keep)
        return (i, n, n - len(keep), hashlib.sha256(kept).hexdigest(), runs, kept)[: 5 + texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            marked = pc.or_(pc.is_valid(b.column(3)), pc.greater(pc.fill_null(pc.list_value_length(b.column(2)), 0), 0))
            plain = b.filter(pc.invert(marked))
            if plain.num_rows:
                words = [t.split() if t else [] for t in as_bytes(plain.column(1))]
                yield batch([row(i, len(w), w, []) for i, w in zip(plain.column(0).to_pylist(), words, strict=True)])
            if plain.num_rows == b.num_rows:
                continue
            for c in chunks([b.filter(marked)]):
                hit = marked_windows(c, [r[1] for r in c.rows], window, seed) if len(c.h) >= window else np.zeros(0, bool)
                for start, n, r in zip(c.start.tolist(), c.size.tolist(), c.rows, strict=True):
                    if r[2]:
                        s = np.array(r[2], np.int64)
                        hit[start + s[s <= n - window]] = True
                edge = np.zeros(len(c.h) + 1, np.int64)
                at = np.flatnonzero(hit)
                edge[at] += 1
                edge[at + window] -= 1
                covered = np.cumsum(edge[:-1]) > 0
                out = []
                for start, w, r in zip(c.start.tolist(), (t.split() if t else [] for t in c.texts), c.rows, strict=True):
                    gone = covered[start : start + len(w)]
                    step = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).tolist()
                    keep, after = [], 0
                    for x, y in zip(step[::2], step[1::2], strict=True):
                        keep += w[after:x]
                        after = y
                    out.append(row(r[0], len(w), keep + w[after:], [{"start": x, "end": y} for x, y in zip(step[::2], step[1::2], strict=True)]))
                yield batch(out)

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, seed: int = 5, texts: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, spans (removed word ranges, end
    exclusive) and, with ``texts``, kept_text (kept words joined by one space).

    A window of ``window`` words is removed if its words also start earlier: in a document with a smaller id, or
    before it in the same one. Judged on the input. Null or empty texts and texts without words: no words, hash
    of the empty string. Rows with a null id take no part and lose nothing. Rows that repeat an id with its text
    are one document, and each row gets its result; texts that share an id are documents of their own, in the order
    of a hash. Other columns are ignored, whatever their names. Long texts are handled whole, a batch of rows at a time. Nothing
    is gathered per anchor: joins and counts on anchors are split or summed before they are dealt out.
    """
    if not 0 < seed <= window:
        raise ValueError("seed must be from 1 to window")
    d, back = told_apart(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    occ = d.mapInArrow(occurrences(window, seed), OCCURRENCES)
    low, high = F.min("region").alias("low"), F.max("region").alias("high")
    shared = cut(occ.groupBy("anchor").agg(F.count("*").alias("n"), low, high).where("n > 1").select("anchor", F.expr("low != high").alias("mixed")))  # a table of its own, so that the join below can split hot anchors
    again = cut(occ.hint("merge").join(shared, "anchor"))
    free(shared)
    first = F.min(F.struct("doc_id", "pos")).alias("first")
    firsts = again.groupBy("anchor", "region").agg(first, F.max("mixed").alias("mixed"))
    kinds = again.select("doc_id", "pos", F.lit(0).alias("kind")).unionByName(
        firsts.select("first.doc_id", "first.pos", F.when(F.col("mixed"), 2).otherwise(1).alias("kind"))
    )
    of = lambda k: F.collect_set(F.when(F.col("kind") >= k, F.col("pos")))
    per_doc = kinds.groupBy("doc_id").agg(of(0).alias("every"), of(1).alias("first"), of(2).alias("loose"))
    marks = cut(per_doc.select("doc_id", F.array_except("every", "first").alias("places"), "loose"))
    free(again)
    windows = d.join(marks.where("size(loose) > 0"), "doc_id").select("doc_id", "text", "loose").mapInArrow(expand(window, seed), "doc_id long, start int, h1 long, h2 long")
    here = F.struct("doc_id", "start")
    early = windows.groupBy("h1", "h2").agg(F.min(here).alias("early"), F.max(here).alias("late")).where("early != late").select("h1", "h2", "early")
    late = windows.join(early, ["h1", "h2"]).where((F.col("doc_id") != F.col("early.doc_id")) | (F.col("start") != F.col("early.start")))
    starts = late.groupBy("doc_id").agg(F.collect_set("start").alias("starts"))
    marked = marks.select("doc_id", "places").join(starts, "doc_id", "left")
    schema = RESULT + ", kept_text string" * texts
    return back(d.join(marked, "doc_id", "left").select("doc_id", "text", "places", "starts").mapInArrow(remove(window, seed, texts), schema))


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_substrings(docs, texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("spans").cast("long").alias("n_spans"))


OP9_SQL = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda z: z <> '') AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM w, LATERAL (SELECT unnest(range(1, len(w) - 18)) AS i)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM s),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM r WHERE n > 1),
e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
k AS (SELECT e.doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY e.i) AS t FROM e LEFT JOIN c ON c.doc_id = e.doc_id AND c.i = e.i WHERE c.i IS NULL GROUP BY e.doc_id),
g AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c)
SELECT w.doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(kept, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256, (SELECT count(DISTINCT run) FROM g WHERE g.doc_id = w.doc_id) AS n_spans
FROM w LEFT JOIN k USING (doc_id)
"""
