"""Operators from nested configurations equal those called by hand; pickles are read without running them."""

import dataclasses
import enum
import json
import os
import pathlib
import pickle

import pytest
from pyspark.sql import functions as F

from gneiss import configuration as K
from gneiss.operators import corpus as C
from gneiss.operators import examples as E
from gneiss.operators import retrieval as R
from gneiss.sources.pickles import read_pickles, unpickled


def test_a_text_of_each_kind(spark):
    pytest.importorskip("yaml")
    rows = [(i, f"lemma {i} of {'abc'[i % 3]}", ["LEMMA", "DEFINITION", "THEOREM", "OTHER"][i % 4], "lib/coq/theories/a.v" if i % 5 == 0 else "b.v") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, path string")
    asks = spark.createDataFrame([(0, "lemma a"), (1, "b 7")], "item_id long, text string")
    kind, path = F.col("kind"), F.col("path")
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    for name in C.FILTERS:
        assert same(docs.where(K.from_yaml("filter", f"alias: {name}")(kind, path)), docs.where(C.named_filter(name, kind, path)))
    text = "alias: premise\nlibrary_excludes: [LEMMA]\nother_excludes: [OTHER, THEOREM]"
    assert same(docs.where(K.from_yaml("filter", text)(kind, path)), docs.where(C.premise_filter(kind, path, ("LEMMA",), ("OTHER", "THEOREM"))))
    assert same(K.from_yaml("ranker", "{alias: bm25, k: 3}")(docs, asks), R.bm25_topk(docs, asks, k=3))
    assert same(K.from_yaml("ranker", "{alias: tf-idf, k: 3}")(docs, asks), R.tfidf_topk(docs, asks, k=3))
    text = "alias: filtered\nfilter: {alias: every, filters: [{alias: proj}, {alias: thm}]}\nranker:\n  alias: bm25\n  k: 4"
    hand = R.bm25_topk(docs.where(C.named_filter("proj-thm", kind, path)), asks, k=4)
    assert same(K.from_yaml("search", text)(docs, asks), hand) and hand.count() == 8
    say = [F.lit(x) for x in ("state", "script")] + [F.array(F.lit("p"), F.lit("q")), F.array(F.lit("r"))]
    assert same(docs.select(K.from_yaml("prompt", "alias: proof-premise")(*say)), docs.select(E.proof_premise(*say)))
    files = docs.select(F.concat("path", "text").alias("file"), kind.alias("project"), "text")
    assert same(K.from_yaml("split", "{alias: proportional, train: 0.5, val: 0.2, seed: 3}")(files), C.proportional_split(files, "file", 0.5, 0.2, "3"))
    assert same(K.from_yaml("split", "{alias: leakage-safe, test: [LEMMA], val: [OTHER]}")(files), C.leakage_safe_split(files, F.col("project") == "LEMMA", F.col("project") == "OTHER"))


@pytest.mark.parametrize(
    ("conf", "where"),
    [
        ({"alias": "none such"}, r"search\.alias: no search"),
        ({}, "search: a mapping"),
        ({"alias": "filtered", "filter": {"alias": "proj"}}, r"search\.ranker: missing"),
        ({"alias": "filtered", "filter": {"alias": "proj"}, "ranker": {"alias": "bm25", "top": 3}}, r"search\.ranker\.top: bm25 takes \['k'\]"),
        ({"alias": "filtered", "filter": "proj", "ranker": {"alias": "bm25"}}, r"search\.filter: a mapping"),
        ({"alias": "filtered", "filter": {"alias": "every", "filters": [{"alias": "proj"}, {"alias": "x"}]}, "ranker": {"alias": "bm25"}}, r"search\.filter\.filters\[1\]\.alias: no filter"),
    ],
)
def test_what_is_wrong_is_said_with_its_place(conf, where):
    with pytest.raises(ValueError, match=where):
        K.build("search", conf)


@dataclasses.dataclass
class StepResult:
    step_idx: int
    hits_on: list


@dataclasses.dataclass
class ProofResult:
    file: pathlib.Path
    step_results: list
    seen: set


class Kind(enum.Enum):
    LEMMA = "lemma"


class Attack:
    def __reduce__(self):
        return os.system, ("echo run > /tmp/gneiss-attack",)


def test_pickles(spark, tmp_path):
    good = ProofResult(pathlib.PurePosixPath("/a/b.v"), [StepResult(0, [1, 4]), StepResult(1, [])], {"y", "x"})
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/deep/good.pkl").write_bytes(pickle.dumps(good))
    (tmp_path / "in/bad.pkl").write_bytes(pickle.dumps([1, Attack()]))
    (tmp_path / "in/cut.pkl").write_bytes(pickle.dumps(good)[:-9])
    (tmp_path / "in/other.txt").write_bytes(b"no pickle")
    got = {r.path.rsplit("/", 1)[1]: r for r in read_pickles(spark, str(tmp_path / "in"), ["StepResult", "ProofResult"]).collect()}
    assert sorted(got) == ["bad.pkl", "cut.pkl", "good.pkl"]
    steps = [{"step_idx": 0, "hits_on": [1, 4]}, {"step_idx": 1, "hits_on": []}]
    assert json.loads(got["good.pkl"].value) == {"file": "/a/b.v", "step_results": steps, "seen": ["x", "y"]}
    assert got["good.pkl"].refused is None
    assert got["bad.pkl"].value is None and "system is not allowed" in got["bad.pkl"].refused
    assert got["cut.pkl"].value is None and got["cut.pkl"].refused
    assert not os.path.exists("/tmp/gneiss-attack")


def test_pickles_of_columns(spark):
    rows = [(bytearray(pickle.dumps(x)),) for x in ({"a": None, "b": [1.5, "é"]}, Kind.LEMMA, eval)] + [(None,)]
    d = spark.createDataFrame(rows, "content binary").coalesce(1)
    got = [tuple(r.r) for r in d.select(unpickled(F.col("content"), ["Kind"]).alias("r")).collect()]
    assert got[:2] == [('{"a": null, "b": [1.5, "é"]}', None), ('{"given": ["lemma"]}', None)]
    assert got[2][0] is None and "eval is not allowed" in got[2][1]
    assert got[3] == (None, None)
