"""Importance resampling towards a target distribution of hashed n-gram features.

Distinct features are a dictionary: their strings are counted over the whole corpus, each distinct one is hashed once,
and buckets are sums over the dictionary. Buckets of the target against those of the corpus give gains, which are
joined back by feature to what each document has.

Features with a share of at least one in ``HEAVY`` of all occurrences are at most ``HEAVY`` strings, and their bytes
at most ``HEAVY`` times those of a mean occurrence; their gains go to every task. What documents have besides is
joined by feature, none of which is in more than one in ``HEAVY`` of the rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.store import cut, free
from gneiss.llm.words import as_bytes, small
from gneiss.operators.ranges import numbered

#: Bytes of words, A-Z as a-z; all others are spaces. Bytes of characters beyond ASCII are words'.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
HEAVY, STRINGS_AT_ONCE, NGRAMS_AT_ONCE = 50_000, 300_000, 200_000


def runs(words: list[bytes], sizes: tuple[int, int]) -> Iterator[list[bytes]]:
    """All runs of consecutive words, repeats kept, in lists of a bounded length."""
    for n in range(sizes[0], sizes[1] + 1):
        if n == 1:
            yield words
            continue
        for at in range(0, len(words) - n + 1, NGRAMS_AT_ONCE):
            here = words[at : at + NGRAMS_AT_ONCE + n - 1]
            yield [b" ".join(w) for w in zip(*(here[k:] for k in range(n)), strict=False)]


def dictionary(docs: DataFrame, text_col: str, sizes: tuple[int, int]) -> DataFrame:
    """(feature, n): occurrences of each distinct feature; tasks sum as far as their memory allows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64())], ["feature", "n"])
            n.clear()
            return out

        for b in small(batches):
            for text in as_bytes(b.column(0)):
                for features in runs((text or b"").translate(WORD_BYTES).split(), sizes):
                    n.update(features)
                    if len(n) > STRINGS_AT_ONCE:
                        yield rows()
        yield rows()

    each = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "feature string, n long")
    return each.groupBy("feature").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) for each bucket that the corpus has: floor(1000 ln of the smoothed shares' quotient). Two
    dictionaries with buckets become at most ``buckets`` rows."""
    of = lambda d, name: d.groupBy("bucket").agg(F.sum("n").alias(name))
    total = lambda d, name: d.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name))
    both = of(corpus, "s").join(of(target, "t"), "bucket", "left").na.fill(0, ["t"])
    both = both.crossJoin(F.broadcast(total(corpus, "all_s"))).crossJoin(F.broadcast(total(target, "all_t")))  # one row each
    s, t, all_s, all_t = (F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t"))
    ratio = ((t + 1) * (all_s + buckets)) / ((s + 1) * (all_t + buckets))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def weigh(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, sizes: tuple[int, int], total: int) -> DataFrame:
    """(doc_id, n_words, n_features, gain): each document's gains summed. ``known``: (feature, n, gain)."""
    spark = docs.sparkSession
    heavy = known.where(F.col("n") * HEAVY >= total).select("feature", "gain").toArrow()  # HEAVY rows at most
    shared = spark.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = dict(zip(as_bytes(shared.value["feature"]), shared.value["gain"].to_pylist(), strict=True))
        for b in small(batches):
            n_words, n_features, sums, rare, counts = [], [], [], [], []
            for text in as_bytes(b.column(1)):
                words = (text or b"").translate(WORD_BYTES).split()
                here, n, mine = 0, 0, Counter()
                for features in runs(words, sizes):
                    n += len(features)
                    found = [gain.get(f) for f in features]
                    if None in found:
                        mine.update([f for f, g in zip(features, found, strict=True) if g is None])
                        found = [g for g in found if g is not None]
                    here += sum(found)
                n_words.append(len(words))
                n_features.append(n)
                sums.append(here)
                rare.append(len(mine))
                counts.append(mine)
            ends = np.cumsum([0, *rare])
            strings = pa.array([f for c in counts for f in c], pa.binary()).cast(pa.string())
            times = pa.array([k for c in counts for k in c.values()], pa.int64())
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (strings, times)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.int64()) for x in (n_words, n_features, sums)], *lists], ["doc_id", "n_words", "n_features", "gain", "rare", "times"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    each = d.mapInArrow(run, "doc_id long, n_words long, n_features long, gain long, rare array<string>, times array<long>")
    each = cut(each.withColumn("row", F.monotonically_increasing_id()))  # written, so that a row keeps its number
    features = each.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("feature"), F.col("x.times").alias("times"))
    rest = features.join(known.select("feature", F.col("gain").alias("g")), "feature").groupBy("row").agg(F.sum(F.col("g") * F.col("times")).alias("more"))
    out = cut(each.drop("rare", "times").join(rest, "row", "left").withColumn("gain", F.col("gain") + F.coalesce("more", F.lit(0))).drop("more"))
    free(each)
    return out


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: tuple[int, int] = (1, 1), buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: str = "2024") -> DataFrame:
    """(doc_id, n_features, weight, score, rank, n_words) for each row of ``docs``: which are drawn, without
    replacement, by their feature gains towards ``target`` and a Gumbel number of their id (rank null: not drawn).

    Of the N rows with ``least_words`` words, floor(percent N / 100) are drawn. Null and empty texts have no features
    and weight 0. Rows that repeat are weighed and drawn each, equal scores by id, null ids (drawn as an empty id)
    last, rows that share an id and a score in the order of the table. No rows give no rows; an empty target is one
    without features; other columns are ignored. Texts are read whole.
    """
    bucketed = lambda d, c: dictionary(d, c, sizes).withColumn("bucket", F.crc32("feature") % buckets)
    words = cut(bucketed(docs, text_col))
    gain = cut(gains(words, bucketed(target, text_col), buckets))
    known = cut(words.join(F.broadcast(gain), "bucket").select("feature", "n", "gain"))  # a row a bucket
    total = words.agg(F.sum("n")).first()[0] or 0
    free(words)
    weighed = weigh(docs, known, id_col, text_col, sizes, total)
    free(known)
    free(gain)
    weight = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = weighed.withColumn("weight", weight).withColumn("score", F.col("weight") + gumbel)
    able = scored.where(F.col("n_words") >= least_words).select("row", "doc_id", "score")
    drawn = able.count() * percent // 100
    order = [-F.col("score"), F.col("doc_id").isNull(), "doc_id", "row"]
    ranks = numbered(able, [], order).where(F.col("rank") <= drawn).select("row", "rank")
    return scored.join(ranks, "row", "left").select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("n_words")


OP13_SQL = r"""
WITH x AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
f AS (SELECT id, unnest(w) AS f FROM x),
tf AS (SELECT unnest(w) AS f FROM b),
names AS (SELECT f, hex(f) AS code FROM (SELECT f FROM f UNION SELECT f FROM tf)),
buckets AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(0, length(code) // 2), lambda i: [('0x' || substr(code, 2 * i + 1, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, y: CASE WHEN y >= 0 THEN xor(c, y) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) % 10000 AS bucket FROM names),
s AS (SELECT bucket, count(*) AS s FROM f JOIN buckets USING (f) GROUP BY ALL),
t AS (SELECT bucket, count(*) AS t FROM tf JOIN buckets USING (f) GROUP BY ALL),
g AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM tf) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT id, sum(gain) AS gain FROM f JOIN buckets USING (f) JOIN g USING (bucket) GROUP BY ALL),
w AS (SELECT id, doc_id, len(w) AS n_features, CASE WHEN len(w) = 0 THEN 0 ELSE floor(gain::DOUBLE / len(w)) END::BIGINT AS weight FROM x LEFT JOIN m USING (id)),
sc AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM w),
r AS (SELECT id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sc WHERE n_features >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM sc LEFT JOIN r USING (id)
"""
