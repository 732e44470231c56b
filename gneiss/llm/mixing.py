"""Mixing sources to target weights by Poisson replication.

A source that should make up ``weight`` of the mixture is repeated ``weight * total / size`` times on average. Each
document draws its own count from the Poisson distribution with that mean, by inverting its distribution function
at a uniform number made from a hash of the seed and the document's id: the same document gets the same count on
any cluster, whatever else is in the table, and expected sizes meet the targets. Copies are then dealt out and
ordered by another hash, which shuffles globally without a sort over everything.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.store import cut

SOURCES_TO_ALL = 5_000  # rows of rates that go to every task; more are joined by key
LARGEST_PART = 500.0  # exp(-rate) stays far from the smallest double; larger rates are sums of independent parts


def uniform(*parts) -> Column:
    """A number from 0 (included) to 1 (not included) made of 52 bits of a hash."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def distribution(rate: Column) -> Column:
    """The Poisson distribution function at 0, 1, ... as far as double precision tells it from 1; ends with 1."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    # product and sum go along; each element is the sum so far
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    return F.concat(F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["all"]), F.array(F.lit(1.0)))


def rates(docs: DataFrame, text_col: str = "text", source_col: str = "source", weights: dict[str | None, float] | None = None, temperature: float = 0.5) -> DataFrame:
    """(source, size, rate): size in characters. ``weights`` gives target weights by source, and a source that is
    not named gets none; without it a source's weight is its size to the power of ``temperature``."""
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.coalesce(F.length(text_col), F.lit(0))).alias("size"))
    if weights is None:
        w = F.pow(F.col("size").cast("double"), F.lit(float(temperature)))
    else:
        w = F.lit(0.0)
        for name, value in weights.items():
            if value < 0:
                raise ValueError("weights must not be negative")
            w = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(w)
    s = sizes.withColumn("w", F.when(F.col("size") > 0, w).otherwise(F.lit(0.0)))
    total = s.agg(F.sum("size").cast("double").alias("total"), F.sum("w").alias("all_w"))
    rate = F.when((F.col("size") > 0) & (F.col("all_w") > 0), F.col("w") / F.col("all_w") * F.col("total") / F.col("size")).otherwise(F.lit(0.0))
    return s.crossJoin(F.broadcast(total)).select("source", "size", rate.alias("rate"))  # one row on the right


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict[str | None, float] | None = None, temperature: float = 0.5, seed: str = "mix") -> DataFrame:
    """The rows of ``docs``, each as often as drawn, with ``copy`` (from 1) and ``shuffle_key`` (columns of ``docs``
    with these names give way), in shuffled order.

    A null source is a source of its own. Null and empty texts have no size, so they come as often as their source
    does; a source of such texts only is left out. Rows that repeat an id are drawn alike; rows with a null id
    draw by their text. No rows: no rows. The draw of a row depends on the seed, its id and its source's rate only.
    """
    names = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    rate = rates(docs, text_col, source_col, weights, temperature)
    part = F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_PART)).cast("int")
    table = rate.select(F.col("source").alias("__mix_source"), part.alias("__mix_parts"), distribution(F.col("rate") / part).alias("__mix_cdf"), (F.col("rate") > 0).alias("__mix_any"))
    table = cut(table)  # a row a source
    table = F.broadcast(table) if table.count() <= SOURCES_TO_ALL else table
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))

    def draw(k: Column) -> Column:
        u = uniform(F.lit(seed), key, k.cast("string"))
        return F.size(F.filter("__mix_cdf", lambda c: c < u))

    count = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("__mix_parts")), draw), F.lit(0), lambda a, x: a + x)
    out = docs.select(names).join(table, F.col(source_col).eqNullSafe(F.col("__mix_source"))).where("__mix_any").withColumn("__mix_n", count).where("__mix_n > 0")
    out = out.select(*names, F.explode(F.sequence(F.lit(1), F.col("__mix_n"))).alias("copy"))
    out = out.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed + "-order"), key, F.col("copy").cast("string"))))
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op2_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = """
WITH RECURSIVE s AS (
  SELECT source, sum(coalesce(length(text), 0)) AS size FROM documents GROUP BY source
), w AS (
  SELECT source, size, CASE WHEN size > 0 THEN pow(size::DOUBLE, 0.5) ELSE 0.0 END AS w FROM s
), r AS (
  SELECT source, w / (SELECT sum(w) FROM w) * (SELECT sum(size)::DOUBLE FROM w) / size AS rate FROM w WHERE size > 0
), p AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM r
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM p WHERE k < ceil(rate + 12 * sqrt(rate) + 30)
), u AS (
  SELECT *, ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))) || ':1'), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents
), n AS (
  SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, count(*) AS n
  FROM u JOIN p ON u.source IS NOT DISTINCT FROM p.source AND p.c < u.u
  GROUP BY ALL
)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy,
       md5('mix-order:' || coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))) || ':' || copy) AS shuffle_key
FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM n)
"""
