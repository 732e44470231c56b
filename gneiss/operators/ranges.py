"""Running sums and ranks along a key's rows, however many rows a key has.

Rows are dealt out in ranges of (key, order), so that a hot key has as many tasks as its rows need. A range's own sums
start from what the key has in earlier ranges. At most one key goes on over each border of two ranges, so these
starts are fewer rows than there are ranges, and are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.store import cut


def in_ranges(rows: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """The rows as a written table, with the range of the keys that each is in as ``_range``. Equal keys share one."""
    dealt = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    return cut(dealt.withColumn("_range", F.spark_partition_id()))  # ranges are drawn once


def starts(ranged: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """(_range, key, sums): what a key has in the ranges before one in which it goes on; fewer rows than ranges."""
    of_key = Window.partitionBy(*by).orderBy("_range")
    totals = ranged.groupBy("_range", *by).agg(*[F.sum(c).alias(c) for c in sums])
    earlier = [F.sum(c).over(of_key.rowsBetween(Window.unboundedPreceding, -1)).alias(c) for c in sums]
    return totals.select("_range", *by, F.row_number().over(of_key).alias("_nth"), *earlier).where("_nth > 1").drop("_nth")


def running(rows: DataFrame, by: list[str], order: list[Column | str], sums: dict[str, Column], frame: str = "rows", parts: int | None = None) -> DataFrame:
    """``rows`` with running sums along each key, by name; ``order`` is ascending.

    ``frame``: "rows" sums up to the row itself (the order should then tell all rows of a key apart), "peers" takes in
    all rows of the same place, "before" only those of earlier places. Null keys are one key; null summands count as
    nothing; a sum over nothing is 0; no key at all makes all rows one.
    """
    names = {f"_sum{k}": F.coalesce(c, F.lit(0)) for k, c in enumerate(sums.values())}
    keys = {f"_key{k}": F.col(c) for k, c in enumerate(by)}
    place = {f"_place{k}": F.col(c) if isinstance(c, str) else c for k, c in enumerate(order)}
    ranged = in_ranges(rows.withColumns(names | keys | place), [*keys, *place], parts)
    along = Window.partitionBy("_range", *keys).orderBy(*place)
    upto = along.rowsBetween(Window.unboundedPreceding, 0) if frame == "rows" else along.rangeBetween(Window.unboundedPreceding, 0)
    same_place = Window.partitionBy("_range", *keys, *place)
    here = {f"{c}_here": F.sum(c).over(upto) - (F.sum(c).over(same_place) if frame == "before" else 0) for c in names}
    first = starts(ranged, [*keys], [*names])
    first = first.select(F.col("_range").alias("_at"), *[F.col(k).alias(f"{k}_at") for k in keys], *[F.col(c).alias(f"{c}_start") for c in names])
    match = F.col("_range") == F.col("_at")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"{k}_at"))
    out = ranged.withColumns(here).join(F.broadcast(first), match, "left")
    total = [(F.col(f"{c}_here") + F.coalesce(f"{c}_start", F.lit(0))).alias(name) for c, name in zip(names, sums, strict=True)]
    return out.select(*[c for c in rows.columns if c not in sums], *total)


def numbered(rows: DataFrame, by: list[str], order: list[Column | str], name: str = "rank", parts: int | None = None) -> DataFrame:
    """``rows`` with their number in their key from 1, in an order that tells them apart."""
    return running(rows, by, order, {name: F.lit(1).cast("long")}, parts=parts)
