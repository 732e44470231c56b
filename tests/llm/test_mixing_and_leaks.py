"""Mixing, decontamination, the pipeline's stages, and the whole queries against their oracles."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gneiss.llm import queries
from gneiss.llm.decontamination import NUMBER_WORDS, UNITS, contaminated, decontaminate
from gneiss.llm.mixing import mix, rates
from gneiss.llm.store import cut
from tests.llm.helpers import LONG, awkward, documents
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name])


def test_expected_repetitions(spark):
    rows = [(i, "x" * 10, ["a", "b", "c", None][i % 4]) for i in range(8000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copy", F.lit(9))
    r = {x.source: x.rate for x in rates(d, weights={"a": 3.0, "b": 1.0, None: 0.0}).collect()}
    assert r == {"a": pytest.approx(3.0), "b": pytest.approx(1.0), "c": 0.0, None: 0.0}
    out = mix(d, weights={"a": 3.0, "b": 1.0})
    n = {x.source: x["count"] for x in out.groupBy("source").count().collect()}
    assert abs(n["a"] - 6000) < 300 and abs(n["b"] - 2000) < 200 and set(n) == {"a", "b"}
    again = mix(d.repartition(3), weights={"a": 3.0, "b": 1.0})
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))
    counts = np.array([x["count"] for x in out.where("source = 'a'").groupBy("doc_id").count().collect()])
    assert abs((2000 - len(counts)) / 2000 - np.exp(-3)) < 0.02  # documents that were never drawn
    big = spark.createDataFrame([(1, "x", "a"), (2, "y" * 5000, "b")], "doc_id long, text string, source string")
    m = mix(big, weights={"a": 1.0, "b": 0.0}).count()
    assert abs(m - 5001) < 400  # a rate far beyond one part


def test_mixing_awkward(spark):
    d = documents(spark, awkward())
    out = mix(d, temperature=1.0)
    assert "copy" in out.columns
    assert {r.text for r in out.collect()} <= {t for _, t in awkward()}
    plan = mix(d)._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan  # rates go to documents, not documents to rates
    nobody = spark.createDataFrame([(None, f"text {i}", "a") for i in range(400)], "doc_id long, text string, source string")
    drawn = mix(nobody, temperature=1.0).collect()  # a rate of 1
    assert 300 < len(drawn) < 500 and 200 < len({r.text for r in drawn}) < 300 and len({r.shuffle_key for r in drawn}) == len(drawn)
    assert mix(documents(spark, [])).count() == 0
    assert mix(documents(spark, [(1, None), (2, "")])).count() == 0
    with pytest.raises(ValueError):
        rates(d, weights={"a": -1.0})


QUESTION = "Tom Baker has 5 apples and 3 pears, then Tom eats 5 apples; how many fruits remain in 2 km?"


@pytest.mark.parametrize(
    ("text", "hit"),
    [
        ("So " + QUESTION, True),
        ("intro words here. " + QUESTION.lower() + " and more", True),
        ("we ask: Anna Smith has 7 apples and 4 pears, then Anna eats 7 apples; how many fruits remain in 9 miles?", True),
        ("we ask: Anna Smith has 7 apples and 4 pears, then Bob eats 8 apples", False),
        ("apples and pears are fruits that Tom likes and eats every day of the week", False),
        ("", False),
        (None, False),
    ],
)
def test_templates(spark, text, hit):
    b = spark.createDataFrame([(1, QUESTION), (2, "short"), (3, None), (None, QUESTION)], "item_id long, text string")
    got = contaminated(documents(spark, [(7, text)]), b, share=0.75).collect()
    assert [(r.doc_id, r.item_id) for r in got] == ([(7, 1)] if hit else [])


def test_numbers_as_words(spark):
    item = "A farmer sells nine kg of rice for five dollars a bag; how much do eight kg cost?"
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [
        (1, "It says: a farmer sells 4 kg of rice for 7 dollars a bag; how much do 3 kg cost?"),
        (2, "It says: a farmer sells four kg of rice for seven dollars a bag; how much do three kg cost?"),
        (3, "It says: a farmer sells four kg of rice for four dollars a bag; how much do four kg cost?"),
        (4, "Nine, five and eight are numbers that a farmer knows."),
    ]
    assert {r.doc_id for r in contaminated(documents(spark, rows), b).collect()} == {1, 2}


def plain_tokens(text):
    """(lower-case token, kind) as the module's docstring says, character by character."""
    out, end, data = [], 0, "\n" + text + "\n\n"
    for m in re.finditer(r"(?:[0-9A-Za-z\x80-\U0010ffff]|(?<=[0-9])[.,](?=[0-9]))+", data):
        t = m.group()
        starts = any(c in ".!?\n" for c in data[end : m.start()])
        low = "".join(c.lower() if c < "\x80" else c for c in t)
        kind = 1 if any(c in "0123456789" for c in t) or low in NUMBER_WORDS else 2 if ("A" <= t[0] <= "Z" or "\xc0" <= t[0] <= "\xde") and not starts else 0
        if kind == 0 and low in UNITS and out and out[-1][1] == 1:
            kind = 3
        out.append((low, kind))
        end = m.end()
    return out


def brute_found(text, item, size=8, shortest=5, enough=13, share=0.5):
    d, b = plain_tokens(text), plain_tokens(item)
    if not b:
        return False
    s, places = min(size, len(b)), set()
    for diagonal in range(-len(b), len(d)):
        to_doc, to_item = {}, {}
        for at in range(len(b) - s + 1):
            if not 0 <= at + diagonal <= len(d) - s:
                continue
            x, y = b[at : at + s], d[at + diagonal : at + diagonal + s]
            for reading in (0, 1, 2):
                if reading < 2 and len(b) < shortest:
                    continue
                k = lambda t, reading=reading: 0 if reading == 2 or (reading == 1 and t[1] == 2) else t[1]
                form = lambda w: [t[0] if not k(t) else k(t) for t in w]
                if form(x) != form(y) or 2 * sum(not k(t) for t in x) < s:
                    continue
                one, two = dict(to_doc), dict(to_item)
                if all(one.setdefault((k(u), u[0]), v[0]) == v[0] and two.setdefault((k(u), v[0]), u[0]) == u[0] for u, v in zip(x, y, strict=True) if k(u)):
                    to_doc, to_item = one, two
                    places |= set(range(at, at + s))
    return len(places) >= min(enough, -(-share * len(b) // 1))


def test_planted_items_against_brute_force(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))

    def slot():
        k = r.random()
        return str(r.randint(1, 3)) if k < 0.1 else r.choice(["Anna", "Bob", "Ünal"]) if k < 0.25 else f"{r.randint(1, 3)} {r.choice(['km', 'miles', 'kg'])}" if k < 0.35 else word() + r.choice(["", "", "", ",", "."])

    def again(text):
        """The same question with other values; now and then one value is changed out of step."""
        swap = {"Anna": "Carl", "Bob": "Dora", "Ünal": "Emil", "1": "7", "2": "8", "3": "9", "km": "miles", "miles": "km", "kg": "lb"}
        return " ".join(swap.get(w, w) if r.random() < 0.97 else w for w in text.split())

    items = [(i, " ".join(slot() for _ in range(r.choice([2, 4, 6, 9, 20, 40])))) for i in range(30)]
    items += [(30, items[4][1]), (4, items[4][1]), (31, "12 13 14 15 16 17 18 19"), (32, "?!")]
    rows = []
    for d in range(120):
        words = [slot() for _ in range(r.randint(10, 120))]
        if r.random() < 0.7:
            text = r.choice(items)[1]
            k = r.random()
            at = r.randrange(len(words))
            words[at:at] = (text.upper() if k < 0.2 else again(text) if k < 0.7 else text).split()
        rows.append((d, " ".join(words)))
    rows += [(3, rows[5][1]), (3, rows[3][1]), (None, rows[4][1] + " " + items[5][1])]
    want = {(i, j) for i, t in rows for j, x in items if brute_found(t, x)}
    assert len(want) > 60
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = contaminated(documents(spark, rows), b)
    assert {(x.doc_id, x.item_id) for x in got.collect()} == want
    tight = contaminated(documents(spark, rows), b, most_bits=256)
    assert sorted(map(str, tight.collect())) == sorted(map(str, got.collect()))
    bad = {t for _, t in rows if any(brute_found(t, x) for _, x in items)}
    assert {(x.doc_id, x.text) for x in decontaminate(documents(spark, rows), b).collect()} == {(i, t) for i, t in rows if t not in bad}


def test_long_and_short_items(spark):
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(60_000))
    b = spark.createDataFrame([(1, long), (2, "blue green red white"), (3, "")], "item_id long, text string")
    rows = [(1, "so: blue green red white!"), (2, "blue green red black"), (3, " ".join(long.split()[500:530])), (4, "a"), (5, long + " x")]
    assert {(r.doc_id, r.item_id) for r in contaminated(documents(spark, rows), b).collect()} == {(1, 2), (3, 1), (5, 1)}


def test_decontamination_awkward(spark):
    b = spark.createDataFrame([(1, LONG[:200])], "item_id long, text string")
    got = {x.doc_id for x in contaminated(documents(spark, awkward()), b).collect()}
    assert got == {4, 9}
    assert decontaminate(documents(spark, awkward()), b).count() == len(awkward()) - 2
    none = b.where("false")
    assert contaminated(documents(spark, awkward()), none).count() == 0 and contaminated(documents(spark, []), b).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = {r.item_id: r.text.split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF))
        if name != "mixing":
            assert docs.columns == corpus_pipeline.COLUMNS
            assert docs.count() <= n
            n = docs.count()
        if name == "language_id":
            assert n == spark.read.parquet(f"{SF}/documents.parquet").where("text RLIKE '[A-Za-z]'").count()
        if name == "decontamination":
            for r in docs.collect():
                flat = " ".join(r.text.split())
                assert not any(" ".join(w) in flat for w in bench.values())
    assert docs.count() > 0 and {"copy", "shuffle_key"} <= set(docs.columns)


def test_pipeline_drops_languages_that_were_not_learned(spark):
    r = random.Random(1)
    texts = [
        "To jest zwykły tekst w języku polskim, którego nikt tutaj nie uczył się rozpoznawać przed testem",
        "Tämä on tavallinen suomenkielinen teksti jota malli ei ole koskaan nähnyt eikä siksi tunne",
        "Это обычный русский текст, который модель никогда раньше не видела",
        "".join(r.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(300)),
    ]
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(corpus_pipeline.COLUMNS)
    odd = spark.createDataFrame([(10**9 + i, t, None, "s", 0) for i, t in enumerate(texts)], known.schema)
    kept = {x.doc_id for x in corpus_pipeline.language_id(spark, known.unionByName(odd), SF).select("doc_id").collect()}
    assert kept == {x.doc_id for x in known.where(r"text RLIKE '[A-Za-z]'").select("doc_id").collect()}


def test_pipeline_stages_on_planted_rows(spark):
    rows = [(1, "the quick brown fox jumps over the lazy dog near the river bank today"), (2, "1234 5678"), (3, None), (4, ""), (1, "the quick brown fox jumps over the lazy dog near the river bank today"), (5, "the quick brown fox jumps over the lazy dog near the river bank today")]
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    one = corpus_pipeline.language_id(spark, d, SF)
    assert sorted(r.doc_id for r in one.collect()) == [1, 1, 5]
    near = corpus_pipeline.near_dedup(spark, d.where("text IS NOT NULL"), SF)
    assert sorted(r.doc_id for r in near.collect()) == [1, 2, 4]
    lines = corpus_pipeline.line_dedup(spark, d.where("text IS NOT NULL"), SF)
    assert sorted(r.doc_id for r in lines.collect()) == [1, 1, 2, 4]
