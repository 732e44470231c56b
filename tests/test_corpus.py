"""Laws of dedup, interning, splits, sampling, steps, examples and evaluation."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gneiss.operators import corpus as C
from gneiss.operators import evaluation as E
from gneiss.operators import examples as X
from gneiss.operators import linkage as L
from gneiss.operators import steps as S

LOOSE = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


@LOOSE
@given(st.lists(st.text(alphabet="ab\n ", max_size=3), max_size=12))
def test_keep_first_laws(spark, lines):
    d = spark.createDataFrame(list(enumerate(lines)), "pos long, line string")
    kept = C.keep_first(d, ["line"], ["pos"]).collect()
    assert sorted(r.line for r in kept) == sorted(set(lines))
    assert {r.line: r.pos for r in kept} == {x: lines.index(x) for x in set(lines)}


@LOOSE
@given(st.lists(st.sampled_from("abcdefg"), max_size=15))
def test_intern_is_dense_and_idempotent(spark, values):
    d = spark.createDataFrame(list(enumerate(values)), "pos long, v string")
    first = C.intern(d, ["v"], "pos")
    ids = {r.v: r.db_idx for r in first.collect()}
    order = sorted(set(values), key=values.index)
    assert ids == {v: i for i, v in enumerate(order, 1)}
    more = spark.createDataFrame([(0, "zz"), *enumerate(values, 1)], "pos long, v string")
    again = {r.v: r.db_idx for r in C.intern(more, ["v"], "pos", first).collect()}
    assert again == ids | {"zz": len(ids) + 1}


def test_split_laws(spark):
    rows = [(f"{p}/{i}", p, f"t{(i * 7 + len(p) * 3 + j) % 40}") for p in ["foo0", "foo1", "bar0", "bar1", "baz0", "baz1", "baz2"] for i in range(5) for j in range(2)]
    d = spark.createDataFrame(rows, "file string, project string, text string")
    split = {r.file: r.split for r in C.leakage_safe_split(d, F.col("project").startswith("foo"), F.col("project").startswith("bar")).collect()}
    texts = {}
    for f, p, t in rows:
        if f in split:
            assert split[f] == {"foo": "test", "bar": "val", "baz": "train"}[p[:3]]
            texts.setdefault(split[f], set()).add(t)
    assert not texts["test"] & texts.get("val", set()) and not texts.get("train", set()) & (texts["test"] | texts.get("val", set()))
    for f, p, t in rows:
        if f not in split:
            mine = {x for g, _, x in rows if g == f}
            assert mine & (texts["test"] | (texts.get("val", set()) if p.startswith("baz") else set()))
    n = C.proportional_split(d, "file", 0.8, 0.1).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in n} == {"train": 28, "val": 3, "test": 4}


def test_filters_and_sampling(spark):
    d = spark.createDataFrame([("LEMMA", "x/lib/coq/theories/a.v"), ("LEMMA", "b.v"), ("TACTIC", "b.v"), ("NOTATION", "x/lib/coq/theories/a.v")], "k string, p string")
    got = {n: [r.v for r in d.select(C.named_filter(n, F.col("k"), F.col("p")).alias("v")).collect()] for n in C.FILTERS}
    assert got == {"all": [True] * 4, "proj": [False, True, True, False], "thm": [True, True, False, False], "proj-thm": [False, True, False, False]}
    rows = spark.range(50).select((F.col("id") % 3).alias("g"), F.col("id").alias("i"))
    a = C.sample_per_group(rows, ["g"], C.hash_order("x", F.col("i")), 4)
    assert sorted(r["count"] for r in a.groupBy("g").count().collect()) == [4, 4, 4]
    assert sorted(a.collect()) == sorted(C.sample_per_group(rows.repartition(3), ["g"], C.hash_order("x", F.col("i")), 4).collect())


@pytest.mark.parametrize(("purity", "n"), [(0.5, 4), (1.0, 2), (0.3, 6), (0, 9)])
def test_purity(spark, purity, n):
    p = spark.createDataFrame([(1, i) for i in range(2)], "q long, i long")
    m = spark.createDataFrame([(1, i) for i in range(10, 19)] + [(2, 5)], "q long, i long")
    assert C.purity_mix(p, m.where("q = 1"), "q", "i", purity).count() == n
    assert C.purity_mix(p.where("false"), m, "q", "i", 0.5).count() == 0


def test_steps(spark):
    d = spark.createDataFrame([(1, i, t) for i, t in enumerate("abc")] + [(2, 0, "x")], "p long, i int, t string")
    got = sorted((r.p, r.i, r.v) for r in d.select("p", "i", S.prefix(F.col("t"), ["p"], ["i"]).alias("v")).collect())
    assert got == [(1, 0, ""), (1, 1, "a"), (1, 2, "ab"), (2, 0, "")]
    left = sorted((r.p, r.i, r.v) for r in d.select("p", "i", S.remaining(F.col("t"), ["p"], ["i"]).alias("v")).collect())
    assert left[0] == (1, 0, ["a", "b", "c"]) and left[2] == (1, 2, ["c"])
    b = spark.createDataFrame([(1, i, n) for i, n in enumerate([3, 4, 1])], "q long, i int, n int")
    assert [r.i for r in S.within_budget(b, ["q"], ["i"], F.col("n"), 6).collect()] == [0]
    r = spark.createDataFrame([(1, i, v) for i, v in enumerate(["a", "a", None, None, "b", "a"])], "u long, i int, v string")
    assert [x.session for x in S.sessions(r, ["u"], ["i"], "v").orderBy("i").collect()] == [1, 1, 2, 2, 3, 4]


@LOOSE
@given(st.lists(st.integers(0, 9), max_size=8), st.integers(1, 25))
def test_line_suffix_is_maximal(spark, sizes, most):
    d = spark.createDataFrame([([str(i) for i in range(len(sizes))], sizes)], "l array<string>, s array<long>")
    kept = d.select(S.line_suffix(F.col("l"), F.col("s"), most).alias("v")).first().v
    n = len(kept)
    assert kept == [str(i) for i in range(len(sizes) - n, len(sizes))]
    assert sum(sizes[len(sizes) - n :]) <= most and (n == len(sizes) or sum(sizes[len(sizes) - n - 1 :]) > most)


def test_truncation(spark):
    d = spark.createDataFrame([(list("abcd"),)], "t array<string>")
    got = [d.select(S.truncate(F.col("t"), n, f).alias("v")).first().v for n, f in ((2, True), (2, False), (0, True), (9, True))]
    assert got == [["c", "d"], ["a", "b"], list("abcd"), list("abcd")]


def test_negative_quota(spark):
    pos = spark.createDataFrame([(1, 100), (2, 200), (3, 300)], "s long, i long")
    rows = [(1, i, i < 4) for i in range(10)] + [(2, i, i < 5) for i in range(6)] + [(3, 1, True)]
    n = X.negatives("s", pos, spark.createDataFrame(rows, "s long, i long, own boolean"), "i", 4, 1).groupBy("s", "own").count().collect()
    assert {(r.s, r.own): r["count"] for r in n} == {(1, True): 1, (1, False): 3, (2, True): 4}


def test_venn_joint_curve_recall(spark):
    rows = [("A", k) for k in (1, 2, 3)] + [("B", k) for k in (2, 3, 4)] + [("C", k) for k in (3, 5)]
    d = spark.createDataFrame(rows, "sys string, k long")
    m = {r.k: r.mask for r in E.regions(d, ["k"], "sys", ["A", "B", "C"]).collect()}
    assert m == {1: 1, 2: 3, 3: 7, 4: 2, 5: 4}
    assert [r.k for r in E.mutual(d, ["k"], "sys", 3).collect()] == [3]
    a = spark.createDataFrame([(1, 5.0, True), (2, None, False)], "k long, time double, success boolean")
    b = spark.createDataFrame([(1, 3.0, True), (2, 8.0, True), (3, 10.0, True)], "k long, time double, success boolean")
    assert {r.k: (r.time, r.success) for r in E.joint(a, b, ["k"], 10).collect()} == {1: (3.0, True), 2: (8.0, True), 3: (10.0, False)}
    assert {r.k: r.success for r in E.joint(a, b, ["k"], 10, True).collect()} == {1: True, 2: False, 3: False}
    h = spark.createDataFrame([([], 0), ([1, 5], 2), ([2], 3)], "hits_on array<int>, num_premises long")
    assert [(r.k, r.strict, r.micro) for r in E.recall(h, [1, 5]).orderBy("k").collect()] == [(1, 0.333333, 0.2), (5, 0.666667, 0.6)]
    assert [r.v for r in spark.range(4).select(E.bucket(F.col("id"), [(0, 1), (2, None)]).alias("v")).collect()] == ["0-1", "0-1", "2+", "2+"]


@LOOSE
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 12)), max_size=6), st.lists(st.tuples(st.integers(0, 30), st.integers(0, 12)), max_size=6))
def test_interval_overlap(spark, xs, ys):
    a = spark.createDataFrame([(i, 0, s, s + n) for i, (s, n) in enumerate(xs)], "a long, g long, a_start long, a_end long")
    b = spark.createDataFrame([(i, 0, s, s + n) for i, (s, n) in enumerate(ys)], "b long, g long, b_start long, b_end long")
    want = sorted((i, j) for i, (s, n) in enumerate(xs) for j, (t, m) in enumerate(ys) if n and m and s < t + m and t < s + n)
    assert sorted((r.a, r.b) for r in L.overlap(a, b, ["g"], 5).collect()) == want


def test_ancestors_and_names(spark):
    p = spark.createDataFrame([("a/b/c.v",), ("x/y.v",)], "path string")
    w = spark.createDataFrame([("a/b", 2), ("a", 1), ("q", 0)], "folder string, pos long")
    assert [(r.path, r.folder) for r in L.first_ancestor(p, w, "path", "folder", "pos").collect()] == [("a/b/c.v", "a")]
    d = spark.createDataFrame([("AbsInt-CompCert",), ("other",)], "p string")
    assert [r.v for r in d.select(L.renamed(F.col("p")).alias("v")).collect()] == ["compcert", "other"]


def test_visible_premises_are_met_in_chunks(spark, monkeypatch):
    """All pairs, once, by brute force; those of one large file are made by several tasks."""
    monkeypatch.setattr(C, "CHUNK", 3)
    premises = [("hot", i) for i in range(0, 200)] + [("a", i) for i in range(200, 207)] + [("alone", 300), (None, 400)]
    steps = [("hot", 120), ("a", 203), ("a", 999), ("none", 50), (None, 500)]
    edges = [("a", "hot"), ("a", "hot"), ("a", "a"), ("hot", "alone"), ("none", "alone"), ("a", "missing")]
    p, s = spark.createDataFrame(premises, "file string, premise_id long"), spark.createDataFrame(steps, "file string, step_id long")
    got = C.visible_premises(s, p, spark.createDataFrame(edges, "file string, dep string"), "file", "step_id", "premise_id")
    pairs = {(f, x) for f, x in edges if f != x}
    want = [(x, i, f == g) for f, x in steps for g, i in premises if (f is not None and f == g and i < x) or (f, g) in pairs]
    assert sorted((r.step_id, r.premise_id, r.own) for r in got.collect()) == sorted(want)
    assert got.where("file = 'a'").select(F.spark_partition_id()).distinct().count() > 1
