"""What is counted or cut is worked out without moving texts."""

import random

from pyspark.sql import functions as F

from gneiss.functions import text as T
from gneiss.operators import ranges
from gneiss.operators import retrieval as R
from gneiss.plans import retrieval, steps


def test_first_tokens_are_those_of_the_whole_text(spark):
    r = random.Random(5)
    texts = [None, "", " ", "a", "x" * 500, "x" * 47 + " y", "x" * 48 + " y", "x" * 40 + " y " + "z" * 90 + " w", ": " * 200 + "a b c d"]
    texts += ["".join(r.choice("ab ,: é") for _ in range(r.randrange(120))) for _ in range(300)]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    got = d.select(T.first_tokens(F.col("text"), 3).alias("a"), F.slice(T.tokens(F.col("text")), 1, 3).alias("b"))
    assert got.where("NOT (a <=> b)").count() == 0


def test_budget_deals_out_counts_and_no_texts(spark, monkeypatch):
    dealt, plain = [], ranges.cut
    monkeypatch.setattr(ranges, "cut", lambda df: dealt.append(df.columns) or plain(df))
    assert steps.token_budget(spark, "/root/testdata/sf0.001").count()
    assert dealt and not any("text" in c for c in dealt)


def test_document_frequency_counts_an_id_once(spark):
    rows = [(1, "a b a"), (2, "b"), (2, "b c"), (None, "d"), (None, "d e"), (3, None), (4, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.term: r.df for r in R.document_frequency(d, "doc_id", "text").collect()} == {"a": 1, "b": 2, "c": 1, "d": 1, "e": 1}


def test_document_frequency_sums_before_the_shuffle(spark):
    """Documents of an id of their own are not dealt out term by term: their distinct terms go into the sums at once."""
    plan = retrieval.doc_freq_idf(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(array_distinct(" in plan
