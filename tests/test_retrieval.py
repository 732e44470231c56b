"""Ranking functions against plain Python, on small corpora with ties, empties and terms in all documents."""

import math
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gneiss.operators import retrieval as R

WORDS = st.lists(st.sampled_from("a b c d e f".split()), max_size=6).map(" ".join)


def bm25(query, docs):
    toks = [d.split() for d in docs]
    n, avg = len(docs), sum(map(len, toks)) / len(docs)
    df = Counter(t for d in toks for t in set(d))
    out = []
    for d in toks:
        tf = Counter(d)
        out.append(sum(math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * tf[t] * 2.8 / (tf[t] + 1.8 * (0.25 + 0.75 * len(d) / avg)) for t in query.split() if tf[t]))
    return out


def tfidf(query, docs):
    toks, q = [d.split() for d in docs], Counter(query.split())
    df = Counter(t for d in toks for t in set(d))
    out = []
    for d in toks:
        tf = Counter(d)
        out.append(sum((0.5 + 0.5 * c / max(q.values())) * tf[t] / len(d) * math.log(len(docs) / df[t]) ** 2 for t, c in q.items() if tf[t]))
    return out


def expected(score, query, docs, k):
    s = [(-round(x, 6), i) for i, x in enumerate(score(query, docs))]
    return [(i, pytest.approx(-x, abs=2e-6)) for x, i in sorted(s)[:k]]


@pytest.mark.parametrize(("run", "score"), [(R.bm25_topk, bm25), (R.tfidf_topk, tfidf)])
@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(docs=st.lists(WORDS, min_size=1, max_size=9), query=WORDS.filter(bool))
def test_ranking(spark, run, score, docs, query):
    if not any(d.split() for d in docs):
        return
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    q = spark.createDataFrame([(1, query)], "item_id long, text string")
    got = {r.doc_id: r.score for r in run(d, q, k=4).collect()}
    want = [-round(x, 5) for x in score(query, docs)]
    assert len(got) == min(4, len(docs))
    for i, s in got.items():
        assert s == pytest.approx(-want[i], abs=1e-5)
    left = [-want[i] for i in range(len(docs)) if i not in got]
    assert not left or min(got.values()) >= max(left) - 2e-5


def test_single_document(spark):
    d = spark.createDataFrame([(0, "x")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "x"), (2, "x x")], "item_id long, text string")
    s = {r.item_id: r.score for r in R.bm25_topk(d, q).collect()}
    assert s == {1: pytest.approx(math.log(4 / 3), abs=1e-6), 2: pytest.approx(2 * math.log(4 / 3), abs=1e-6)}


def test_no_query_terms(spark):
    d = spark.createDataFrame([(0, "x"), (1, None)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "")], "item_id long, text string")
    assert [(r.doc_id, r.score) for r in R.bm25_topk(d, q, k=5).orderBy("rank").collect()] == [(0, 0.0), (1, 0.0)]


def test_visible_equals_recount(spark):
    docs = [(i, "f" if i % 2 else "g", i, t) for i, t in enumerate(["a b", "a", "b b c", "a c", "c", "a b c", "", "b"])]
    d = spark.createDataFrame(docs, "doc_id long, source string, line long, text string")
    q = spark.createDataFrame([(1, "f", 7, "a b b"), (2, "g", 6, "c a"), (3, "f", 1, "a")], "query_id long, source string, line long, query string")
    for kind, score in (("bm25", bm25), ("tfidf", tfidf)):
        got = {(r.query_id, r.doc_id): r.score for r in R.visible_topk(d, q, kind, k=99).collect()}
        want = {}
        for qid, f, line, text in ((1, "f", 7, "a b b"), (2, "g", 6, "c a"), (3, "f", 1, "a")):
            seen = [x for x in docs if x[1] == f and x[2] < line]
            if seen:
                for x, s in zip(seen, score(text, [x[3] for x in seen]), strict=True):
                    want[qid, x[0]] = pytest.approx(s, abs=2e-6)
        assert got == want


def test_group_cut(spark):
    rows = [(1, r, g) for r, g in enumerate("aabacbdce", 1)]
    d = spark.createDataFrame(rows, "q long, rank int, g string")
    got = sorted(r.rank for r in R.cut_at_group(d, ["q"], ["g"], 3).collect())
    assert got == [1, 2, 3, 4, 5]  # the third distinct group comes at rank 5
    assert sorted((r.g, r.rank) for r in R.first_of_group(d, ["q"], ["g"]).collect()) == [("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 5)]


def test_gather_keeps_order_and_repeats(spark):
    v = spark.createDataFrame([(i, [float(i)]) for i in range(1, 6)], "vec_id long, embedding array<double>")
    for ids in ([1, 2, 3, 4, 5], [5, 4, 3, 2, 1], [5, 3, 3, 4, 3, 1, 1, 2, 1], [9]):
        w = spark.createDataFrame(list(enumerate(ids)), "pos long, vec_id long")
        got = [r.embedding for r in R.gather(v, w).orderBy("pos").collect()]
        assert got == [[float(i)] if i < 6 else None for i in ids]


def test_declared_names(spark):
    d = spark.createDataFrame([("Definition foo := 1.",), ("CoFixpoint bar x := y",), ("Module Type m.\n",), ("Lemma no : x.",)], "t string")
    from pyspark.sql import functions as F

    assert [r.n for r in d.select(R.declared_name(F.col("t")).alias("n")).collect()][:2] == ["foo", "bar"]


def test_linear_maps_are_least_squares(spark):
    import numpy as np

    from gneiss.plans.retrieval import linear_map_scores

    got = {r.vec_id: r.score for r in linear_map_scores(spark, "/root/testdata/sf0.01").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").where("embedding IS NOT NULL").orderBy("vec_id").collect()
    want = {}
    for label in {r.label for r in rows}:
        mine = [r for r in rows if r.label == label]
        x = np.array([r.embedding for r in mine], np.float64)
        pairs = list(range(len(mine) - 1))
        p, g = x[pairs], x[[k + 1 for k in pairs]]
        m = np.linalg.pinv(p, rcond=1e-6) @ g
        want |= dict(zip([r.vec_id for r in mine], (x @ m @ x[-1]).tolist(), strict=True))
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in got) < 1e-5


def test_dense_blocks(spark, monkeypatch):
    from gneiss.operators import dense

    monkeypatch.setattr(dense, "QUERIES_AT_ONCE", 2)
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(7)] + [(9, None), (None, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in R.dense_topk(v, v.where("vec_id < 5"), k=2).collect()}
    assert got[0, 1] == (1, 1.0) and got[2, 1] == (5, 5.0) and got[2, 2] == (1, 3.0) and len(got) == 10


DOCS = [(i, "fgh"[i % 3], i, t) for i, t in enumerate(["a b", "a", "b b c", "a c", "c", "a b c", "", "b", "a a", "b c", None, "c"])]
# g is reached from f twice, z is not there, h depends on itself
EDGES = [("f", "g"), ("f", "g"), ("f", "z"), ("h", "h"), ("h", "f"), ("z", "f"), (None, "f"), ("g", None)]
ASKS = [(1, "f", 7, "a b b"), (2, "g", 6, "c a"), (3, "f", 0, "a"), (4, "h", 12, ""), (5, "z", 5, "b"), (6, "f", 3, None), (7, None, 3, "a")]


def seen_by(file, line):
    deps = {d for f, d in EDGES if f == file and d not in (file, None)}
    return [x for x in DOCS if x[1] in deps or (x[1] == file and x[2] < line)]


def dependency_tables(spark):
    d = spark.createDataFrame(DOCS, "doc_id long, source string, line long, text string")
    return d, spark.createDataFrame(ASKS, "query_id long, source string, line long, query string"), spark.createDataFrame(EDGES, "file string, dep string")


def test_dependencies_equal_recount(spark, monkeypatch):
    from gneiss.operators import sparse

    monkeypatch.setattr(sparse, "QUERIES_AT_ONCE", 4)  # several blocks
    d, q, edges = dependency_tables(spark)
    for kind, score in (("bm25", bm25), ("tfidf", tfidf)):
        got = {(r.query_id, r.doc_id): r.score for r in R.visible_topk(d, q, kind, k=99, edges=edges).collect()}
        want = {}
        for qid, file, line, text in ASKS:
            seen = seen_by(file, line) if file else []
            if seen:
                scores = score(text, [x[3] or "" for x in seen]) if text else [0.0] * len(seen)
                want |= {(qid, x[0]): pytest.approx(s, abs=2e-6) for x, s in zip(seen, scores, strict=True)}
        assert got == want


def test_places_are_those_of_the_whole_ranking(spark, monkeypatch):
    """However far down, with ties; what a query does not see has no place."""
    from gneiss.operators import sparse

    monkeypatch.setattr(sparse, "CELLS", 9)  # small pieces
    d, q, edges = dependency_tables(spark)
    wanted = spark.createDataFrame([(a, i) for a in range(1, 8) for i in range(12)] + [(1, None), (None, 1), (99, 1)], "qid long, id long")
    for e in (edges, None):
        whole = {(r.query_id, r.doc_id): (r["rank"], r.score) for r in R.visible_topk(d, q, "bm25", k=99, edges=e).collect()}
        got = {(r.qid, r.id): (r["rank"], r.score) for r in sparse.places(d, q, wanted, "bm25", "doc_id", "text", "query_id", "query", "source", "line", e).collect()}
        assert got == whole


def test_rank_far_down(spark):
    from gneiss.operators import sparse

    d = spark.createDataFrame([(i, "x" if i < 600 else "x y") for i in range(1000)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "y")], "item_id long, text string")
    wanted = spark.createDataFrame([(1, 599), (1, 600), (1, 0)], "qid long, id long")
    assert {r.id: r["rank"] for r in sparse.places(d, q, wanted, "bm25", "doc_id", "text", "item_id", "text").collect()} == {600: 1, 0: 401, 599: 1000}


@pytest.mark.parametrize("kind", ["bm25", "tfidf"])
def test_rows_that_cannot_be_among_the_best_are_not_scored(spark, kind, monkeypatch):
    """Of 400 rows that a query sees few are scored, and the best are those of scoring all; ties go to smaller ids."""
    import numpy as np
    import pyarrow as pa

    from gneiss.operators import sparse

    rng = np.random.default_rng(1)
    n, k, terms = 400, 3, np.arange(1, 41)
    h = [np.sort(rng.choice(terms, 8, replace=False)) for _ in range(n // 2)] * 2  # all rows twice
    tf = [rng.integers(1, 4, 8) for _ in range(n // 2)] * 2
    size = np.array([int(x.sum()) for x in tf])
    rows = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([""] * n), pa.array([0] * n), pa.array(size), pa.array([x.tolist() for x in h]), pa.array([x.tolist() for x in tf])], ["id", "file", "line", "size", "h", "tf"])
    df = {t: sum(t in x for x in h) for t in terms.tolist()}
    asked = [{"qid": q, "file": "", "at": 1, "h": t, "f": 1, "n": n if t == 0 else df.get(t, 0), "size": int(size.sum())} for q in range(5) for t in [0, *(rng.choice(terms, 6, replace=False).tolist() if q else [99])]]
    block = sparse.Block(pa.Table.from_pylist(asked), {}, kind, 1.8, 0.75)
    want = {}
    for j, ids, s in block.scored(iter([rows])):
        want[j] = [(int(i), float(x)) for x, i in sorted(zip(-s, ids, strict=True))[:k]]
    scored = []
    plain = sparse.Postings.scores
    monkeypatch.setattr(sparse.Postings, "scores", lambda p, part, j, some: scored.append(len(some)) or plain(p, part, j, some))
    got = sparse.best_in_task(type("B", (), {"value": block}), k)(iter([rows.slice(at, 50) for at in range(0, n, 50)]))
    found = {}
    for r in pa.Table.from_batches(got).to_pylist():
        found.setdefault(r["qid"], []).append((r["id"], r["score"]))
    assert {q: [(i, pytest.approx(-s, abs=2e-6)) for i, s in want[q]] for q in want} == found
    assert sum(scored) < 5 * n / 3


def test_scores_held_at_once_do_not_grow_with_queries(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from gneiss.operators import dense

    sizes = []
    plain = dense.matrix
    monkeypatch.setattr(dense, "matrix", lambda c: sizes.append(len(c)) or plain(c))
    q = np.random.default_rng(0).random((4096, 2))
    rows = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([None] * 300, pa.int64()), pa.array([[1.0, float(i)] for i in range(300)])], ["id", "g", "v"])
    got = pa.Table.from_batches(dense.best_rows(np.arange(4096) + 1000, q, 2, False, 6)(iter([rows])))
    assert got.num_rows == 2 * 4096 and sum(sizes) == 300
    assert max(sizes) * 4096 <= dense.CELLS


def test_rare_terms_are_added_where_they_meet(monkeypatch):
    """Sums are those of a product of whole matrices, but no matrix has a column for every term."""
    import numpy as np
    import pyarrow as pa

    from gneiss.operators import sparse

    rng = np.random.default_rng(3)
    n, common, rare = 60, np.arange(1, 6), np.arange(100, 20_100)
    h = [np.concatenate([common, np.sort(rng.choice(rare, 300, replace=False))]) for _ in range(n)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([""] * n), pa.array([0] * n), pa.array([400] * n), pa.array(h), pa.array([np.ones(305, np.int64)] * n)], ["id", "file", "line", "size", "h", "tf"])
    terms = {q: np.concatenate([common, rng.choice(rare, 400, replace=False)]) for q in range(50)}
    df = dict(zip(*np.unique(np.concatenate(h), return_counts=True), strict=True))
    asked = [{"qid": q, "file": "", "at": 1, "h": t, "f": 1, "n": n if t == 0 else int(df.get(t, 0)), "size": 400 * n} for q in terms for t in [0, *terms[q].tolist()]]
    cells, plain = [], np.zeros
    monkeypatch.setattr(sparse.np, "zeros", lambda shape, *a: cells.append(int(np.prod(shape))) or plain(shape, *a))
    monkeypatch.setattr(sparse, "CELLS", 1000)  # a few at a time
    block = sparse.Block(pa.Table.from_pylist(asked), {}, "bm25", 1.8, 0.75)
    got = {(j, int(i)): s for j, ids, score in block.scored(iter([rows])) for i, s in zip(ids, score, strict=True)}
    for q, mine in terms.items():
        for i, its in enumerate(h):
            want = sum(np.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * 2.8 / 2.8 for t in set(mine.tolist()) & set(its.tolist()))
            assert got[q, i] == pytest.approx(want, abs=2e-6)
    best = pa.Table.from_batches(sparse.best_in_task(type("B", (), {"value": block}), 4)(iter([rows]))).to_pylist()
    for q in terms:
        want = sorted(((-got[q, i], i) for i in range(n)))[:4]
        assert [(r["id"], r["score"]) for r in best if r["qid"] == q] == [(i, pytest.approx(-s, abs=2e-6)) for s, i in want]
    assert max(cells) < len(rare)


def test_document_terms_are_counted_where_the_text_is(spark):
    from pyspark.sql import functions as F

    from gneiss.operators import sparse

    d = spark.createDataFrame([(1, "a b a c a"), (2, None), (3, "z"), (4, "b  b")], "doc_id long, text string")
    vocabulary = spark.createDataFrame([("a",), ("b",)], "t string").select(F.xxhash64("t").alias("h")).union(spark.createDataFrame([(0,)], "h long"))
    rows = sparse.document_terms(d, vocabulary, "doc_id", "text", F.lit(""), F.lit(0).cast("long"))
    name = {r.h: r.t for r in spark.createDataFrame([("a",), ("b",)], "t string").withColumn("h", F.xxhash64("t")).collect()} | {0: ""}
    got = {r.id: (r.size, dict(zip([name[x] for x in r.h], r.tf, strict=True))) for r in rows.collect()}
    assert got == {1: (5, {"": 1, "a": 3, "b": 1}), 2: (0, {"": 1}), 3: (1, {"": 1}), 4: (2, {"": 1, "b": 2})}
    assert "Exchange" not in rows._jdf.queryExecution().toString()


def test_a_task_keeps_rows_up_to_its_last_group(spark):
    """One group is most of the rows: what a task keeps follows the groups, not the longest of them."""
    from pyspark.sql import functions as F

    from gneiss.operators import sparse

    of = lambda i: i // 1000
    ids = [5 * 1000 + j for j in range(400)] + [g * 1000 + j for g in (1, 2, 3, 4, 6, 7) for j in range(g % 4 + 1)]
    words = "a b c d e f".split()
    docs = [(i, "f", of(i), " ".join(words[(i + j) % 6] for j in range(i % 5))) for i in ids]
    d = spark.createDataFrame(docs, "doc_id long, source string, line long, text string").repartition(3)
    q = spark.createDataFrame([(1, "f", 9, "a b c"), (2, "f", 7, "e"), (3, "f", 9, "")], "query_id long, source string, line long, query string")
    rows = lambda x: sorted(R.cut_at_group(x.withColumn("g", F.floor(F.col("doc_id") / 1000)), ["query_id"], ["g"], 3).select("query_id", "rank", "doc_id", "score").collect())
    assert rows(R.visible_topk(d, q, k=3, group_of=of)) == rows(R.visible_topk(d, q, k=len(ids)))
    late = d.where("line != 5").unionByName(d.where("line = 5").withColumn("text", F.lit("f"))).coalesce(1)
    kept = sparse.best_of(late, q.where("query_id = 1"), "bm25", "doc_id", "text", "query_id", "query", 3, "source", "line", group_of=of)
    assert 0 < kept.count() <= 20  # of 400 in one group


def test_terms_are_counted_where_documents_are(spark, monkeypatch):
    """A batch gives one row for each stretch and term, however many documents have it; where query lines are too many
    for each task, statistics are the same."""
    import numpy as np
    import pyarrow as pa

    from gneiss.operators import sparse

    class Shared:
        def __init__(self, value):
            self.value = value

    n = 900
    rows = pa.RecordBatch.from_arrays([pa.array(["f", "g", "f"] * (n // 3)), pa.array(range(n)), pa.array([2] * n), pa.array([[0, 7]] * n)], ["file", "line", "size", "h"])
    every = Shared(np.full(sparse.SLOTS // 8, 255, np.uint8))
    got = [r for b in sparse.counted(every, Shared({"f": np.array([300]), "h": np.array([5])}), False)(iter([rows])) for r in b.to_pylist()]
    assert sorted((r["file"], r["stretch"], r["h"], r["n"], r["size"]) for r in got) == [("f", 0, 0, 200, 400), ("f", 0, 7, 200, 400), ("f", 1, 0, 400, 800), ("f", 1, 7, 400, 800), ("g", 0, 0, 300, 600), ("g", 0, 7, 300, 600)]

    docs = [(i, "fgé"[i % 3], i, " ".join("a b c d".split()[: i % 5])) for i in range(40)]
    d = spark.createDataFrame(docs, "doc_id long, source string, line long, text string")
    q = spark.createDataFrame([(1, "f", 7, "a b b"), (2, "g", 36, "c a"), (3, "f", 30, "d"), (4, "é", 50, "b c"), (5, "x", 1, "a")], "query_id long, source string, line long, query string")
    edges = spark.createDataFrame([("f", "é"), ("x", "g")], "file string, dep string")
    run = lambda e: sorted(R.visible_topk(d, q, "bm25", k=9, edges=e).collect())
    few = [run(None), run(edges)]
    monkeypatch.setattr(sparse, "POINTS_AT_ONCE", 0)
    assert [run(None), run(edges)] == few


def test_every_proof_asks_with_its_first_step(spark):
    from gneiss import catalog
    from gneiss.plans.proofs import STEP
    from tests.oracle import compare, connect

    con = connect("/root/testdata/sf0.01")
    df = catalog.QUERIES["first_step_retrieval"](spark, "/root/testdata/sf0.01").cache()
    compare(df, con, catalog.ORACLES["first_step_retrieval"])
    asked = {r.query_id // STEP for r in df.select("query_id").distinct().collect()}
    later = {c for (c,) in con.sql("SELECT conv_id FROM conversations WHERE turn = 0 AND text <> '' AND conv_id >= 20").fetchall()}  # others of their file are before them
    assert len(later) > 70 and later <= asked


@pytest.mark.parametrize("kind", ["bm25", "tfidf"])
def test_queries_that_see_files_whole_are_scored_together(kind, monkeypatch):
    """Queries of a file with dependencies are few parts, and a piece's rows are scored for all queries at once."""
    import numpy as np
    import pyarrow as pa

    from gneiss.operators import sparse

    rng = np.random.default_rng(5)
    n, queries, k = 200, 300, 3
    h = [np.sort(rng.choice(np.arange(1, 60), rng.integers(0, 9), replace=False)) for _ in range(n)]
    tf = [rng.integers(1, 4, len(x)) for x in h]
    size = [int(x.sum()) for x in tf]
    file, line = ["f" if i % 3 else "g" for i in range(n)], list(range(n))
    rows = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(file), pa.array(line), pa.array(size), pa.array(h), pa.array(tf)], ["id", "file", "line", "size", "h", "tf"])
    asked, terms = [], {q: rng.choice(np.arange(1, 80), 5, replace=False).tolist() for q in range(queries)}
    for q in terms:
        seen = [i for i in range(n) if file[i] == "g" or line[i] < q]
        asked += [{"qid": q, "file": "f", "at": q, "h": t, "f": 1, "n": len(seen) if t == 0 else sum(t in h[i] for i in seen), "size": sum(size[i] for i in seen)} for t in [0, *terms[q]]]
    block = sparse.Block(pa.Table.from_pylist(asked), {"f": ["g"]}, kind, 1.8, 0.75)
    assert len(block.parts) == 1
    monkeypatch.setattr(sparse, "ENTRIES", 50)  # some pairs at a time
    monkeypatch.setattr(sparse, "ROWS", 64)
    calls, plain = [], sparse.Postings.scores
    monkeypatch.setattr(sparse.Postings, "scores", lambda p, part, q, some: calls.append(len(some)) or plain(p, part, q, some))
    got = {}
    for r in pa.Table.from_batches(sparse.best_in_task(type("B", (), {"value": block}), k)(iter([rows.slice(0, 90), rows.slice(90)]))).to_pylist():
        got.setdefault(r["qid"], []).append((r["id"], r["score"]))
    assert len(calls) < 20
    for q in terms:
        mine = [a for a in asked if a["qid"] == q]
        every, total = mine[0]["n"], mine[0]["size"]
        scores = []
        for i in [i for i in range(n) if file[i] == "g" or line[i] < q]:
            s = 0.0
            for a in mine[1:]:
                for t, c in zip(h[i].tolist(), tf[i].tolist(), strict=True):
                    if t == a["h"] and kind == "bm25":
                        s += math.log((every - a["n"] + 0.5) / (a["n"] + 0.5) + 1) * c * 2.8 / (c + 1.8 * (0.25 + 0.75 * size[i] * every / total))
                    elif t == a["h"]:
                        s += c / size[i] * math.log(every / a["n"]) ** 2
            scores.append((-round(s, 6), i))
        assert [(i, pytest.approx(-s, abs=2e-6)) for s, i in sorted(scores)[:k]] == got[q]
