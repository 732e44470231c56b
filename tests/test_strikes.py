"""A stream with a state for each worker, stopped and started again, against one result after another."""

import random

from pyspark.sql import functions as F

from gneiss.operators import evaluation as E
from gneiss.streaming.resume import follow
from gneiss.streaming.strikes import GROUPS, until_stopped


def counted(rows, limit=3):
    out, strikes = [], {}
    for worker, at, failed in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        if (n := strikes.get(worker, 0)) < limit:
            strikes[worker] = n = n + 1 if failed is not False else 0
            out.append((worker, at, n, n >= limit))
    return out


def test_strikes_go_on_over_restarts(spark, tmp_path):
    pick = random.Random(1)
    rows = [(pick.choice(["a", "b", "c", "d", None]), i, pick.choice([True, False, False, None])) for i in range(120)]
    rows += [("only", 200, True), ("only", 210, True), ("only", 220, True), ("only", 230, False), ("none", None, True)]
    parts = [[r for r in rows if r[1] is None or r[1] < 40], [], [r for r in rows if r[1] is not None and 40 <= r[1] < 210], [r for r in rows if r[1] is not None and r[1] >= 210]]
    source, out, done = (str(tmp_path / x) for x in ("in", "out", "done"))
    schema = "worker string, at long, failed boolean"

    def run():
        follow(spark, source, schema, lambda d: d, out, done, "parquet", lambda s: until_stopped(s, "worker", ["at"], "failed"), files=1).awaitTermination()

    for part in parts:
        spark.createDataFrame(part[::-1], schema).coalesce(1).write.mode("append").parquet(source)
        run()
    run()  # nothing new
    got = [(r.worker, r.at, r.strikes, r.stop) for r in spark.read.parquet(out).collect()]
    key = lambda r: (r[0] or "", r[1] or 0)
    assert sorted(got, key=key) == sorted(counted(rows), key=key)
    assert ("only", 220, 3, True) in got and not any(r[:2] == ("only", 230) for r in got)


def test_spread_equals_buffers_of_values(spark):
    pick = random.Random(2)
    rows = [(pick.choice(["x", "y", None]), pick.randrange(3), pick.choice([None, *range(-4, 9)])) for _ in range(400)]
    rows += [("hot", 0, pick.randrange(50)) for _ in range(2001)] + [("empty", 0, None), ("one", 0, 7)]
    d = spark.createDataFrame(rows, "g string, h int, v long")
    want = d.groupBy("g", "h").agg(F.avg("v").alias("mean"), F.median("v").alias("median"), F.max("v").alias("longest"))
    as_set = lambda t: {(r.g, r.h, None if r.mean is None else round(r.mean, 9), r["median"], r.longest) for r in t.collect()}
    assert as_set(E.spread(d, ["g", "h"], "v")) == as_set(want)
    assert E.spread(d.limit(0), ["g"], "v").collect() == []


def test_workers_share_calls(spark, tmp_path):
    """5,000 workers with a few results each are one call a group, and each is counted on its own."""
    source, out, done = (str(tmp_path / x) for x in ("in", "out", "done"))
    rows = [(w, i, (w * 7 + i * i) % 5 < 3) for w in range(5000) for i in range(4)]
    schema = "worker long, at long, failed boolean"
    calls = []
    for late in (False, True):
        spark.createDataFrame([r for r in rows if (r[1] > 1) == late], schema).write.mode("append").parquet(source)
        q = follow(spark, source, schema, lambda d: d, out, done, "parquet", lambda s: until_stopped(s, "worker", ["at"], "failed"))
        q.awaitTermination()
        calls.append(max(op["numRowsUpdated"] for p in q.recentProgress for op in p["stateOperators"]))
    got = [(r.worker, r.at, r.strikes, r.stop) for r in spark.read.parquet(out).collect()]
    assert sorted(got) == sorted(counted(rows))
    assert all(0 < n <= GROUPS for n in calls)
