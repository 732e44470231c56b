"""Running sums over ranges against plain windows, and that no task holds a hot key."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gneiss.operators import ranges


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(1)
    data = [(r.choice(["hot"] * 8 + ["a", "b", None]), r.randrange(40), i, r.choice([None, r.randrange(-5, 50)]), "x") for i in range(2000)]
    return spark.createDataFrame(data, "key string, at int, id int, n long, _sum0 string").drop("_sum0").cache()


def bag(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=str)


@pytest.mark.parametrize("by", [["key"], []])
@pytest.mark.parametrize("frame", ["rows", "peers", "before"])
def test_equals_a_window(rows, by, frame):
    order = ["at", "id"] if frame == "rows" else ["at"]
    got = ranges.running(rows, by, order, {"n_sum": F.col("n"), "count": F.lit(1)}, frame, parts=8)
    w = Window.partitionBy(*by).orderBy(*order)
    w = {"rows": w.rowsBetween(Window.unboundedPreceding, 0), "peers": w.rangeBetween(Window.unboundedPreceding, 0), "before": w.rangeBetween(Window.unboundedPreceding, -1)}[frame]
    want = rows.withColumns({"n_sum": F.coalesce(F.sum("n").over(w), F.lit(0)), "count": F.count(F.lit(1)).over(w)})
    assert got.columns == ["key", "at", "id", "n", "n_sum", "count"]
    assert bag(got, "id", "n_sum", "count") == bag(want, "id", "n_sum", "count")


def test_a_hot_key_has_many_tasks(spark):
    one = spark.range(8000).select(F.lit("k").alias("key"), F.col("id").alias("at"))
    ranged = ranges.in_ranges(one, ["key", "at"], 8)
    sizes = [r["count"] for r in ranged.groupBy("_range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 8000 / 8
    first = ranges.starts(ranged.withColumn("n", F.lit(1)), ["key"], ["n"]).collect()
    assert len(first) == 7  # one start for each border
    got = ranges.numbered(one, ["key"], ["at"], parts=8)
    assert got.where("rank <> at + 1").isEmpty() and got.count() == 8000


def test_starts_are_fewer_than_ranges(spark):
    many = spark.range(5000).select((F.col("id") % 1000).alias("key"), F.col("id").alias("at"), F.lit(1).alias("n"))
    assert ranges.starts(ranges.in_ranges(many, ["key", "at"], 6), ["key"], ["n"]).count() <= 5


def test_no_rows(spark):
    none = spark.createDataFrame([], "key string, at int")
    assert ranges.numbered(none, ["key"], ["at"]).collect() == []
