"""Importance resampling against its contract, done document by document in Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from gneiss.llm import queries
from gneiss.llm import resampling as R
from tests.llm.helpers import awkward, corpus, documents
from tests.oracle import compare, connect

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, sizes):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + n]) for n in range(sizes[0], sizes[1] + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, sizes=(1, 1), buckets=10_000, least=20, percent=10):
    at = lambda f: zlib.crc32(f.encode()) % buckets
    docs = [(i, *features(t, sizes)) for i, t in rows]
    s = Counter(at(f) for _, _, fs in docs for f in fs)
    t = Counter(at(f) for x in target for f in features(x, sizes)[1])
    a, b = sum(s.values()), sum(t.values())
    gain = {k: math.floor(1000 * math.log((t[k] + 1) * (a + buckets) / ((s[k] + 1) * (b + buckets)))) for k in s}
    out = []
    for k, (i, n, fs) in enumerate(docs):
        weight = sum(gain[at(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n, k])
    able = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[6]))
    for rank, x in enumerate(able[: len(able) * percent // 100], 1):
        x[4] = rank
    return sorted((tuple(x[:5]) for x in out), key=str)


def result(df):
    return sorted((tuple(r) for r in df.drop("n_words").collect()), key=str)


@pytest.mark.parametrize("sizes", [(1, 1), (1, 2), (2, 3)])
@pytest.mark.parametrize("heavy", [50_000, 40])
def test_equals_brute_force(spark, monkeypatch, sizes, heavy):
    """Also with few features that go to every task, so that most are joined."""
    monkeypatch.setattr(R, "HEAVY", heavy)
    monkeypatch.setattr(R, "NGRAMS_AT_ONCE", 7)
    rows = [(i, t.title()) for i, t in corpus(3, 80)]
    target = [t for _, t in corpus(3, 80)[::9]] + ["É é 12 x", None]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    assert result(R.resample(documents(spark, rows), goal, sizes=sizes, buckets=97, percent=30)) == brute(rows, target, sizes, 97, percent=30)


def test_what_goes_to_every_task_is_bounded(spark, monkeypatch):
    """Features that are heavy are at most HEAVY, however the corpus is made."""
    monkeypatch.setattr(R, "HEAVY", 10)
    d = R.dictionary(documents(spark, corpus(4, 50)), "text", (1, 1))
    total = d.groupBy().sum("n").first()[0]
    assert d.where(d.n * R.HEAVY >= total).count() <= R.HEAVY
    r = random.Random(1)
    even = documents(spark, [(i, " ".join(r.choice("abcdefghij") for _ in range(100))) for i in range(20)])
    d = R.dictionary(even, "text", (1, 1))
    assert d.where(d.n * R.HEAVY >= 2000).count() <= R.HEAVY


def test_dictionary_goes_out_in_parts(spark, monkeypatch):
    monkeypatch.setattr(R, "STRINGS_AT_ONCE", 5)
    rows = corpus(6, 30)
    want = Counter(f for _, t in rows for f in features(t, (1, 1))[1])
    assert {r.feature: r.n for r in R.dictionary(documents(spark, rows), "text", (1, 1)).collect()} == want


def test_awkward_rows(spark):
    rows = awkward() + [(None, None), (30, "ÀB aB 1x " * 30), (31, "-- ,, \x00"), (32, "x" * 9000)]
    goal = spark.createDataFrame([("one two same",), (None,)], "text string")
    for least, percent in ((1, 100), (20, 50)):
        assert result(R.resample(documents(spark, rows), goal, least_words=least, percent=percent)) == brute(rows, ["one two same"], least=least, percent=percent)
    none = spark.createDataFrame([], "text string")
    assert result(R.resample(documents(spark, rows), none)) == brute(rows, [])
    assert result(R.resample(documents(spark, []), goal)) == []


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    compare(queries.QUERIES["op13_importance_resampling"](spark, sf), connect(sf), queries.ORACLES["op13_importance_resampling"])
