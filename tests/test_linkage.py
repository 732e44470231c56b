"""Records against file contents: places of many statements, likeness of names, the outcomes of linking."""

import random

import pytest

from gneiss.operators import linkage as L

PLACES = "file long, theorem long, line int, column int, end_line int, end_column int"


def place(text: str, i: int) -> tuple[int, int]:
    lines = text[: i + 1].split("\n")
    return len(lines) - 1, len(lines[-1]) - 1


def places(text: str, statement: str) -> list[tuple]:
    out = []
    for i in range(len(text)):
        if statement and text.startswith(statement, i):
            (line, column), (end, last) = place(text, i), place(text, i + len(statement) - 1)
            out.append((i, line, column, end, last + 1))
    return out


@pytest.fixture(scope="module")
def corpus():
    pick = random.Random(5)
    word = lambda n: "".join(pick.choice("ab\n") for _ in range(n))
    files = [(f, word(pick.randrange(40))) for f in range(60)] + [(60, None), (61, "")]
    records = [(pick.randrange(64), r, word(pick.randrange(5))) for r in range(400)]
    records += [(None, 400, "a"), (3, 401, None), (3, 402, "b"), (3, 403, "b")]
    return files, records


@pytest.mark.parametrize("block", [1, 1000])
def test_found_in(spark, corpus, block):
    files, records = corpus
    f, r = spark.createDataFrame(files, "file long, text string"), spark.createDataFrame(records, "file long, record long, statement string")
    got = sorted(map(tuple, L.found_in(f, r, "file", "text", "statement", block).collect()))
    asked = {(k, s) for k, _, s in records if s}
    assert got == sorted((k, s, *hit) for k, t in files if t for q, s in asked if q == k for hit in places(t, s))


def test_places_of_many_files_share_batches(spark):
    """What is handed on is dealt in batches of places, not of files."""
    from pyspark.sql import functions as F

    files = spark.range(300).select(F.col("id").alias("file"), F.lit("a b a").alias("text"), F.lit("a").alias("statement")).coalesce(1)
    found = L.found_in(files, files, "file", "text", "statement")
    assert found.count() == 600
    assert "MapInArrow" in found._jdf.queryExecution().toString() and "MapInPandas" not in found._jdf.queryExecution().toString()


def test_found_in_places_outside_the_first_plane(spark):
    f = spark.createDataFrame([("x", "é\U0001f600aa\n\U0001f600aaa")], "k string, t string")
    r = spark.createDataFrame([("x", "aa"), ("x", "a\n\U0001f600"), ("y", "aa")], "k string, s string")
    got = sorted(map(tuple, L.found_in(f, r, "k", "t", "s").collect()))
    assert got == [("x", "a\n\U0001f600", 3, 0, 3, 1, 1), ("x", "aa", 2, 0, 2, 0, 4), ("x", "aa", 6, 1, 1, 1, 3), ("x", "aa", 7, 1, 2, 1, 4)]
    assert L.found_in(f.limit(0), r, "k", "t", "s").collect() == []


def test_same_names_against_all_pairs(spark, corpus):
    rows = [r for r in corpus[1] if r[0] is not None and r[2] is not None]
    got = L.same_names(spark.createDataFrame(rows, "file long, record long, statement string"), "file", "statement", "record").collect()
    like = lambda a, b: a[0] == b[0] and (a[2] in b[2] or b[2] in a[2])
    want = {a[1]: (sum(like(a, b) for b in rows), sum(like(a, b) and b[1] < a[1] for b in rows)) for a in rows}
    assert {r.record: (r.n_same, r.nth) for r in got} == want


def test_same_names_of_one_hot_name_are_no_pairs(spark):
    rows = [(0, i, "ab" if i % 3 else f"x{i}") for i in range(3000)]
    got = L.same_names(spark.createDataFrame(rows, "file long, record long, statement string"), "file", "statement", "record")
    one = {r.record: (r.n_same, r.nth) for r in got.where("statement = 'ab'").collect()}
    ids = [i for i in range(3000) if i % 3]
    assert one == {i: (2000, n) for n, i in enumerate(ids)}


def linked(files, records, theorems, bad):
    """One record after another, as the outcomes are defined."""
    texts, out = dict(files), {}
    for f, r, s in records:
        if f not in texts:
            out[r] = ("file missing", None)
            continue
        hits = places(texts[f] or "", s or "")
        met = [(hit[0], t[2:4], t[1]) for hit in hits for t in theorems if t[0] == f and (hit[1], hit[2]) < (t[4], t[5]) and (t[2], t[3]) < (hit[3], hit[4])]
        met = [t for *_, t in sorted(met)]
        if not hits or not met:
            out[r] = ("theorem mismatch" if hits else "theorem missing", None)
            continue
        if len(met) == 1:
            out[r] = ("linked", met[0])
            continue
        peers = sorted(q for g, q, u in records if g == f and u is not None and (u in s or s in u))
        gone = sorted({n for g, u, n in bad if (g, u) == (f, s)})
        at = peers.index(r)
        if at in gone:
            out[r] = ("bad theorem", None)
        elif len(peers) - len(gone) != len(met):
            out[r] = ("ambiguous", None)
        else:
            out[r] = ("linked", met[at - sum(n < at for n in gone)])
    return out


def test_link_against_one_record_after_another(spark, corpus):
    files, records = corpus
    theorems = []
    for f, t in files:
        for n, line in enumerate((t or "").split("\n")):
            if n % 3 != 1 and line:
                theorems.append((f, f * 100 + n, n, 0, n, len(line)))
    bad = [(3, "b", 0), (3, "b", 1), *((f, s, 0) for f, _, s in records[::9] if f is not None)]
    want = linked(files, records, theorems, bad)
    # more of the outcomes that need as many records as candidates
    got = L.link(
        spark.createDataFrame(records, "file long, record long, statement string"),
        spark.createDataFrame(files, "file long, text string"),
        spark.createDataFrame(theorems, PLACES),
        spark.createDataFrame(bad, "file long, statement string, nth int"),
    ).collect()
    assert {r.record: (r.mode, r.theorem) for r in got} == want
    assert len(got) == len(records)
    assert {m for m, _ in want.values()} == {"file missing", "theorem missing", "theorem mismatch", "linked", "ambiguous", "bad theorem"}


def test_theorem_steps(spark):
    steps = [("f", 4, "Lemma a :\n  x.", 3), ("f", 5, "Lemma a : x. ", 3), ("f", 9, "Lemma a : x.", 7), ("g", 1, "Lemma a : x.", 3), ("f", 10, None, 3)]
    theorems = [("f", 0, " Lemma  a : x.", 3), ("f", 1, "a :", 7), ("f", 2, "Lemma a : x.", 8), ("g", 0, "Lemma b", 3), ("f", 3, None, 3), ("f", 5, "", 7)]
    got = L.theorem_steps(spark.createDataFrame(theorems, "file string, theorem long, statement string, line int"), spark.createDataFrame(steps, "file string, step long, text string, line int"))
    assert {(r.file, r.theorem): r.step for r in got.collect()} == {("f", 0): 4, ("f", 1): 9, ("f", 2): None, ("g", 0): None, ("f", 3): None, ("f", 5): 9}
