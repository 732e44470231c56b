"""Ordered steps of proofs: prefixes, remainders, sessions, budgets, hit positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.operators.ranges import running


def prefix(step: Column, by: list[str], order: list[str], start: Column | None = None) -> Column:
    """What was written before each row, without the row itself."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.array_join(F.collect_list(step).over(w), "")
    return before if start is None else F.concat(start, before)


def remaining(step: Column, by: list[str], order: list[str]) -> Column:
    """This row and all after it, as an array."""
    return F.collect_list(step).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(0, Window.unboundedFollowing))


def whole_text(steps: DataFrame, by: list[str], order: str, text: str, alias: str = "proof_text") -> DataFrame:
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda s: s[text]), "")
    return steps.groupBy(*by).agg(joined.alias(alias))


def sessions(rows: DataFrame, by: list[str], order: list[str], value: str, alias: str = "session") -> DataFrame:
    """Numbers runs of an equal value, from 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    return rows.withColumn("_new", new).withColumn(alias, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def within_budget(rows: DataFrame, by: list[str], order: list[str], tokens: Column, budget: int | Column) -> DataFrame:
    """Ranked rows as long as their tokens fit: it stops at the first overflow."""
    return running(rows, by, order, {"used": tokens}).where(F.col("used") <= budget)


def truncate(tokens: Column, n: int, front: bool) -> Column:
    """The last ``n`` tokens if cut at the front (0 keeps all), else the first ``n``."""
    if front:
        return tokens if n == 0 else F.slice(tokens, F.greatest(F.size(tokens) - n + 1, F.lit(1)), F.lit(n))
    return F.slice(tokens, 1, n) if n else F.array().cast("array<string>")


def line_suffix(lines: Column, size: Column, most: int) -> Column:
    """The longest run of last lines whose sizes add up to at most ``most``; none if the last alone is larger."""
    back = F.reverse(F.arrays_zip(lines.alias("line"), size.alias("size")))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(True).alias("open"), F.array().cast("array<string>").alias("kept"))

    def step(acc, x):
        fits = acc["open"] & (acc["sum"] + x["size"] <= most)
        return F.struct(F.when(fits, acc["sum"] + x["size"]).otherwise(acc["sum"]).alias("sum"), fits.alias("open"), F.when(fits, F.concat(F.array(x["line"]), acc["kept"])).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(back, start, step, lambda acc: acc["kept"])


def hits(ranks: DataFrame, positives: DataFrame, by: str, item: str) -> DataFrame:
    """(by, num_premises, hits_on): ranks at which positives stand, in order; all positives count, found or not."""
    n = positives.groupBy(by).agg(F.count("*").alias("num_premises"))
    found = ranks.join(positives, [by, item]).groupBy(by).agg(F.sort_array(F.collect_list("rank")).alias("hits_on"))
    return n.join(found, by, "left").withColumn("hits_on", F.coalesce("hits_on", F.array().cast("array<int>")))
