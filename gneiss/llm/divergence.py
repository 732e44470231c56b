"""Source divergence: which sources of a language differ most, and in which terms.

A term's probability in a group (language and source) and in a language is 1 + floor(scale (count + 5) / (N + 5 V))
over the V terms that enough of the language's documents have. All of it is done in whole numbers.

Pairs of sources: the sum over all kept terms of absolute differences is that of two sources without any term, V times
the difference of what no occurrence gives, corrected for the terms that one or the other has, which needs only how
many terms of a group have each count, and for the terms that both have, which the terms' postings give. Nothing is
made for terms that a group lacks.

Terms of a group: terms go in buckets by their count there. A bucket's largest probability less the least that the
language gives one of its terms bounds every difference in it. Buckets are evaluated best bound first, in rounds over
all groups, until every bucket not yet seen is bounded strictly below the group's k-th difference.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.store import cut, free
from gneiss.llm.words import as_bytes, small

#: Bytes of terms, A-Z as a-z; all others are spaces. Bytes of characters beyond ASCII are terms'.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
TERMS_AT_ONCE, PAIRS_AT_ONCE, GROUPS_TO_ALL = 300_000, 2_000_000, 20_000
SCALE_STEPS = (31_250, 32_000)  # their product is the scale


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, text) -> (lang, source, term, n, docs): occurrences and documents, summed here as far as
    memory of a bounded number of terms allows, and a row with a null term for each group."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    groups: set[tuple[str, str]] = set()

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            m = len(n) + ((lang, source) not in groups)
            groups.add((lang, source))
            terms = pa.array([*n, *[None] * (m - len(n))], pa.binary()).cast(pa.string())
            numbers = [pa.array([*c, *[0] * (m - len(n))], pa.int64()) for c in (n.values(), map(docs.__getitem__, n))]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * m, pa.string()), pa.array([source] * m, pa.string()), terms, *numbers], ["lang", "source", "term", "n", "docs"])
        counts.clear()

    for b in small(batches):
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), strict=True):
            n, docs = counts[lang, source]
            terms = text.translate(TERM_BYTES).split()
            n.update(terms)
            docs.update(set(terms))
        if sum(len(n) for n, _ in counts.values()) > TERMS_AT_ONCE:
            yield from rows()
    yield from rows()


def probability(count: str, total: str, kept: str) -> Column:
    """1 + floor(scale (count + 5) / (total + 5 kept)), without a product over 2^63 up to 2.9e14 occurrences; 0 where
    nothing is kept."""
    a, b = SCALE_STEPS
    of = f"({total} + 5 * {kept})"
    return F.expr(f"CASE WHEN {kept} > 0 THEN 1 + ((({count} + 5) * {a}) div {of}) * {b} + (((({count} + 5) * {a}) % {of}) * {b}) div {of} ELSE 0 END")


def both_have(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, term, source, p, p0) in the order of (lang, term) -> (lang, source, item, value): what the terms
    that two sources have add to their difference, summed over a bounded number of pairs of postings."""

    def sums(t: pa.RecordBatch, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        names = t.column(2).dictionary_encode()
        langs = t.column(0).dictionary_encode()
        code = np.asarray(langs.indices).astype(np.int64) * len(names.dictionary) + np.asarray(names.indices)
        group, code = np.unique(code, return_inverse=True)
        p, p0 = np.asarray(t.column(3)), np.asarray(t.column(4))
        later = np.repeat(size.cumsum(), size) - np.arange(t.num_rows) - 1  # postings of the term behind this one
        done, at = later.cumsum(), 0
        while at < t.num_rows:
            to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
            many = later[at:to]
            i = np.repeat(np.arange(at, to), many)
            j = i + 1 + np.arange(len(i)) - np.repeat(many.cumsum() - many, many)
            at = to
            if not len(i):
                continue
            value = np.abs(p[i] - p[j]) - np.abs(p[i] - p0[j]) - np.abs(p0[i] - p[j]) + np.abs(p0[i] - p0[j])
            key = np.minimum(code[i], code[j]) * len(group) + np.maximum(code[i], code[j])
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            total = np.add.reduceat(value[order], first)
            a, b = np.divmod(key[first], len(group))
            source = lambda c: names.dictionary.take(pa.array(group[c] % len(names.dictionary)))
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(group[a] // len(names.dictionary))), source(a), source(b), pa.array(total)], ["lang", "source", "item", "value"])

    rest: pa.RecordBatch | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = b if rest is None else pa.concat_batches([rest, b])
        lang, term = (np.asarray(t.column(c).dictionary_encode().indices) for c in (0, 1))
        first = np.flatnonzero(np.concatenate([[True], (lang[1:] != lang[:-1]) | (term[1:] != term[:-1])]))
        yield from sums(t.slice(0, first[-1]), np.diff(first))
        rest = t.slice(first[-1])  # the term may go on in the next batch
    if rest is not None:
        yield from sums(rest, np.array([rest.num_rows]))


def pairs(scored: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    """(lang, source, item, value): for each two sources of a language."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    other = F.broadcast(other) if few else other
    apart = lambda a, b: F.abs(F.col(a) - F.col(b))
    base = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", (F.col("kept") * apart("p0", "q0")).alias("value"))
    counts = scored.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("m"))
    one = counts.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("m") * (apart("p", "q0") - apart("p0", "q0"))).alias("value"))
    postings = scored.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term")
    two = postings.mapInArrow(both_have, "lang string, source string, item string, value long")
    turned = lambda d: d.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    parts = base.unionByName(one).unionByName(turned(one)).unionByName(two).unionByName(turned(two))
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def top_terms(scored: DataFrame, top: int, at_first: int = 512) -> DataFrame:
    """(lang, source, item, value, rank): the ``top`` terms of each group that stand out most from its language."""
    spark = scored.sparkSession
    group = ["lang", "source"]
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("value"), "item"))
    bound = scored.groupBy(*group, "bucket").agg((F.max("p") - F.min("q")).alias("bound"), F.count("*").alias("m")).where("bound > 0")
    by_bound = Window.partitionBy(*group).orderBy(F.desc("bound"), "bucket")  # some hundred buckets a group at most
    buckets = cut(bound.withColumn("before", F.coalesce(F.sum("m").over(by_bound.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    best = cut(spark.createDataFrame([], "lang string, source string, item string, value long, rank int"))
    since, upto = 0, at_first
    while True:
        kth = best.where(F.col("rank") == top).select(*group, F.col("value").alias("kth"))
        left = buckets.where(F.col("before") >= since).join(kth, group, "left").where("kth IS NULL OR bound >= kth")
        now = cut(left.where(F.col("before") < upto).select(*group, "bucket"))
        if now.isEmpty():
            if left.isEmpty():
                break
        else:
            found = scored.where("p > q").join(now, [*group, "bucket"]).select(*group, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
            before, best = best, cut(best.drop("rank").unionByName(found).withColumn("rank", rank).where(F.col("rank") <= top))
            free(before)
        free(now)
        since, upto = upto, upto * 16
    free(buckets)
    return best


def divergence(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has every other source of the language with its summed
    difference, part ``term`` up to ``top`` terms more probable in the group than in the language.

    ``least``: documents of a language that must have a term. Null texts, languages and sources are read as empty
    ones; a group without terms is compared like any other; a language without kept terms has differences of 0;
    repeated rows count each; equal values are ranked by item; other columns are ignored; no rows give no rows.
    """
    d = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    each = d.mapInArrow(count_terms, "lang string, source string, term string, n long, docs long")
    counts = cut(each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = cut(counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).select("lang", "term", "n_lang"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n_lang").alias("total_lang"))
    postings = cut(counts.where("term IS NOT NULL").drop("docs").join(kept, ["lang", "term"]))
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "kept", "total_lang")])
    groups = cut(groups.withColumn("p0", probability("0", "total", "kept")))
    free(kept)
    free(counts)
    few = groups.count() <= GROUPS_TO_ALL
    own = F.broadcast(groups) if few else groups
    p, q = probability("n", "total", "kept"), probability("n_lang", "total_lang", "kept")
    bucket = F.floor(F.log2("n") * 8).cast("int")
    scored = cut(postings.join(own, ["lang", "source"]).select("lang", "source", "term", p.alias("p"), q.alias("q"), "p0", bucket.alias("bucket")))
    free(postings)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ["lang", "source", F.col("part"), "item", "value", "rank"]
    pair = pairs(scored, groups, few).withColumns({"rank": rank, "part": F.lit("pair")}).select(columns)
    term = top_terms(scored, top).withColumn("part", F.lit("term")).select(columns)
    out = cut(pair.unionByName(term))
    free(scored)
    free(groups)
    return out


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
o AS (SELECT id, lang, source, unnest(t) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n_lang FROM o GROUP BY ALL HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS kept, sum(n_lang) AS total_lang FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY ALL),
c AS (SELECT g.lang, g.source, k.term, k.n_lang, coalesce(n.n, 0) AS n, sum(coalesce(n.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
    FROM g JOIN k USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
p AS (SELECT c.*, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * kept)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (n_lang + 5)) // (total_lang + 5 * kept)::HUGEINT AS q FROM c JOIN v USING (lang)),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
        WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
s AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r)
SELECT * FROM s WHERE part = 'pair' OR rank <= 50
"""
