"""Analysis of the results of competing systems."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.operators.ranges import numbered, running


def succeeded(proof: Column, time: Column, timeout: float) -> Column:
    """A proof and a time strictly below the timeout; unknown is failure."""
    return F.coalesce(proof.isNotNull() & (time < timeout), F.lit(False))


def first_per_key(results: DataFrame, key: list[str], order: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    return results.withColumn("_n", n).where("_n = 1").drop("_n")


def last_per_key(results: DataFrame, key: list[str], order: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))
    return results.withColumn("_n", n).where("_n = 1").drop("_n")


def summary(results: DataFrame, by: list[str], success: str = "success") -> DataFrame:
    ok = F.col(success).cast("int")
    return results.groupBy(*by).agg(F.round(F.avg(ok), 6).alias("rate"), F.sum(ok).cast("long").alias("n_success"), F.count(success).alias("n"))


def joint(a: DataFrame, b: DataFrame, key: list[str], timeout: float, normalised: bool = False) -> DataFrame:
    """Two systems as one: the earlier time of the two (an unknown one is ignored), twice it if both ran on half the
    budget each; success if either had it and that time is in time."""
    x = a.select(*key, F.col("time").alias("t1"), F.col("success").alias("s1"))
    y = b.select(*key, F.col("time").alias("t2"), F.col("success").alias("s2"))
    t = F.least("t1", "t2") * (2 if normalised else 1)
    either = F.coalesce("s1", F.lit(False)) | F.coalesce("s2", F.lit(False))
    return x.join(y, key, "full").select(*key, t.alias("time"), (either & F.coalesce(t < timeout, F.lit(False))).alias("success"))


def regions(results: DataFrame, key: list[str], system: str, systems: list[str]) -> DataFrame:
    """(key, mask): bit i is set if system i has the key."""
    bit = reduce(lambda acc, s: F.when(F.col(system) == s[1], 1 << s[0]).otherwise(acc), enumerate(systems), F.lit(0))
    return results.where(F.col(system).isin(systems)).select(*key, bit.alias("_b")).distinct().groupBy(*key).agg(F.sum("_b").cast("int").alias("mask"))


def mutual(results: DataFrame, key: list[str], system: str, n: int) -> DataFrame:
    return results.select(*key, system).distinct().groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") == n).drop("_n")


def curve(results: DataFrame, by: list[str], time: str, tie: str) -> DataFrame:
    """How many a system had solved by each time; a system may have any number of results."""
    return numbered(results, by, [time, tie], "solved").withColumn("solved", F.col("solved").cast("int"))


def bucket(value: Column, ranges: list[tuple[int, int | None]]) -> Column:
    """The first range that holds the value, both ends included, as text."""
    out = F.lit(None).cast("string")
    for lo, hi in reversed(ranges):
        inside = value >= lo if hi is None else value.between(lo, hi)
        out = F.when(inside, f"{lo}+" if hi is None else f"{lo}-{hi}").otherwise(out)
    return out


def margin(p: Column, n: Column) -> Column:
    return 1.96 * F.sqrt(p * (1 - p) / n)


def recall(hits: DataFrame, ks: list[int]) -> DataFrame:
    """(k, strict, micro) of rows (hits_on, num_premises). Strict: share of rows with all positives at rank k or
    better, rows without positives included; micro: positives at rank k or better among all."""
    every = hits.select("hits_on", "num_premises", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    found = F.size(F.filter("hits_on", lambda h: h <= F.col("k")))
    return every.groupBy("k").agg(F.round(F.avg((found == F.col("num_premises")).cast("int")), 6).alias("strict"), F.round(F.try_divide(F.sum(found), F.sum("num_premises")), 6).alias("micro"))


def spread(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, mean, median, longest) of the values of each group, exactly, null for a group that has none.

    Values are counted where they are and the counts summed along each group's values in ranges, so no task holds a
    group's values: the median is half the sum of the values that half and half the rows and one more come up to.
    """
    counts = rows.groupBy(*by, value).agg(F.count(value).alias("_n"))
    along = running(counts, by, [F.col(value)], {"_upto": F.col("_n")})
    all_of = counts.groupBy(*[F.col(c).alias(f"_key{k}") for k, c in enumerate(by)]).agg(F.sum("_n").alias("_all"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_key{k}")) for k, c in enumerate(by)])
    reached = lambda half: F.min(F.when((F.col("_upto") >= half) & (F.col("_n") > 0), F.col(value)))
    low, high = reached(F.floor((F.col("_all") + 1) / 2)), reached(F.floor(F.col("_all") / 2) + 1)
    mean = F.sum(F.col(value) * F.col("_n")) / F.sum("_n")
    return along.join(all_of, same).groupBy(*by).agg(mean.alias("mean"), ((low + high) / 2).alias("median"), F.max(value).alias("longest"))
