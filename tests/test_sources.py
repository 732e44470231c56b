"""Readers, writers and incremental work on files made here."""

import json

import pytest
from pyspark.sql import functions as F

from gneiss.sources import files as S
from gneiss.streaming.resume import follow, not_yet


def document(file, premises):
    meta = json.dumps({"file": file, "workspace": "w", "repository": "repos/r"})
    steps = [{"term": "t", "step": {"text": " auto.", "context": []}, "n_step": 1, "goals": ["H: x\n\nP"]}]
    return json.dumps({"file_context": [meta, *map(json.dumps, premises)], "proofs": [{"theorem": {"term": "t"}, "steps": steps}]}, indent=1)


@pytest.fixture
def docs(spark, tmp_path):
    (tmp_path / "a.v").write_text(document("a", [{"type": "stored", "id": 2}, {"type": "LEMMA", "text": "L", "file_path": "p", "module": ["m"], "line": 3}]))
    (tmp_path / "b.v").write_text(document("b", []))
    return S.read_documents(spark, str(tmp_path))


def test_documents(spark, docs):
    assert sorted((r.dp_name, r.file, r.repository) for r in S.file_metadata(docs).collect()) == [("a.v", "a", "repos/r"), ("b.v", "b", "repos/r")]
    sentences = spark.createDataFrame([(1, "x", "f", "[]", "TermType.LEMMA", 1), (2, "y", "g", '["k"]', "TermType.FACT", 4)], S.SENTENCE_COLUMNS)
    got = sorted((r.pos, r.text, r.sentence_type, r.module) for r in S.file_premises(docs, sentences).collect())
    assert got == [(1, "y", "FACT", ["k"]), (2, "L", "LEMMA", ["m"])]
    with pytest.raises(Exception, match="not found exactly once"):
        S.file_premises(docs, sentences.where("db_idx = 1")).collect()
    s = S.steps(docs).where("dp_name = 'a.v'").first()
    assert (s.proof_idx, s.step_idx, s.text, s.goals[0].hyps, s.goals[0].goal) == (0, 0, " auto.", ["H: x"], "P")


def test_round_trip(spark, docs, tmp_path):
    sentences = spark.createDataFrame([(2, "y", "g", '["k"]', "TermType.FACT", 4)], S.SENTENCE_COLUMNS)
    p = S.file_premises(docs, sentences).where("db_idx IS NOT NULL")
    S.write_documents(S.file_metadata(docs), p, docs.select("dp_name", "proofs"), str(tmp_path / "out"))
    back = spark.read.schema(S.DOCUMENT).json(str(tmp_path / "out"))
    assert sorted(map(len, (r.file_context for r in back.collect()))) == [1, 2]
    with pytest.raises(Exception, match="exist"):
        S.write_documents(S.file_metadata(docs), p, docs.select("dp_name", "proofs"), str(tmp_path / "out"))


def test_results_and_logs(spark, tmp_path):
    (tmp_path / "r/x").mkdir(parents=True)
    (tmp_path / "r/x/1-2.json").write_text(json.dumps({"thm": {"project": "p", "path": "a.v", "line": 1, "column": 2}, "proof": "auto.", "time": 1.5, "n_attempts": 3}))
    (tmp_path / "r/2-2.json").write_text(json.dumps({"thm": {"project": "p", "path": "a.v", "line": 2, "column": 2}, "proof": None}))
    r = S.read_results(spark, str(tmp_path / "r"))
    assert sorted((x.line, x.proof, x.time) for x in r.collect()) == [(1, "auto.", 1.5), (2, None, None)]
    assert S.read_results(spark, str(tmp_path / "r"), recursive=False).count() == 1
    (tmp_path / "e.json").write_text(json.dumps({"results": [{"thm": {"project": "p", "path": "b", "line": 7, "column": 0}, "proof": "x", "time": 2.0, "n_attempts": 1}]}))
    assert [(x.pos, x.line, x.time) for x in S.read_evaluation(spark, str(tmp_path / "e.json")).collect()] == [(0, 7, 2.0)]
    (tmp_path / "log.json").write_text('{"epoch":1,"loss":2.0,"step":5}\n{"epoch":1,"eval_loss":1.0,"step":5}\n')
    assert sorted(x.is_eval for x in S.read_log(spark, str(tmp_path / "log.json")).collect()) == [False, True]
    (tmp_path / "m.csv").write_text("step,train\n1,0.5\n2,\n")
    assert [(x.step, x.train) for x in S.read_metrics(spark, str(tmp_path / "m.csv"), "train").collect()] == [(1, 0.5)]
    d = spark.createDataFrame([("a/checkpoint-12",), ("a/checkpoint-9",), ("b",)], "p string")
    assert d.agg(F.max(S.checkpoint_number(F.col("p")))).first()[0] == 12


def test_tools(spark, tmp_path):
    (tmp_path / "a-proofs.txt").write_text(json.dumps([["proj", "f.v", "M", "thm x"], {"status": "SUCCESS", "time_taken": 2.5}]) + "\n" + json.dumps([["proj", "f.v", "M", "thm y"], {"status": "FAILURE"}]) + "\n")
    got = sorted((r.theorem, r.success, r.time) for r in S.read_tool_lines(spark, str(tmp_path)).collect())
    assert got == [("thm x", True, 2.5), ("thm y", False, None)]
    (tmp_path / "t").mkdir()
    (tmp_path / "t/12.json").write_text(json.dumps({"file": "f", "theorem": "t", "success": True, "stdout": "synth with cache (auto).\r\nNo more goals."}))
    r = S.read_tool_files(spark, str(tmp_path / "t")).first()
    assert (r.file_idx, r.proof) == (12, "auto")


def test_sources_and_vectors(spark, tmp_path):
    (tmp_path / "s/d").mkdir(parents=True)
    (tmp_path / "s/d/a.v").write_text("x\ny\n")
    (tmp_path / "s/d/b.txt").write_text("no")
    assert [r.lines for r in S.find_sources(spark, str(tmp_path / "s")).collect()] == [["x", "y", ""]]
    v = spark.range(5).select(F.col("id").alias("idx"), F.array(F.col("id").cast("float")).alias("emb"))
    out = str(tmp_path / "v")
    S.write_vectors(v.where("idx < 2"), out, 2)
    S.write_vectors(v, out, 2)
    assert spark.read.parquet(out).count() == 5
    assert sorted(r.idx for r in S.read_vector_page(spark, out, 1).collect()) == [2, 3]
    assert S.read_vector_page(spark, out, 9).count() == 0


def test_incremental(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.range(4).withColumnRenamed("id", "k")
    assert not_yet(rows, out, ["k"]).count() == 4
    rows.where("k < 3").write.parquet(out)
    assert [r.k for r in not_yet(rows, out, ["k"]).collect()] == [3]
    (tmp_path / "in").mkdir()
    run = lambda: follow(spark, str(tmp_path / "in"), "k long", lambda d: d.withColumn("v", F.col("k") * 2), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    for n in range(2):
        (tmp_path / f"in/{n}.json").write_text('{"k": %d}\n' % n)
        run()
    run()
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [0, 2]


def test_human_rows(spark, tmp_path):
    row = {"file": "p/a/b/c.v", "raw_file": "p/a/b/c.v", "theorem": " Lemma x :\n\t y. ", "time": 3, "success": True, "modules": ["M"], "file_idx": None, "proof": "now auto.", "num_deps": 2, "num_proj_deps": 1, "num_proofs_available": 9}
    for n in range(2):
        (tmp_path / f"{n}.json").write_text(json.dumps(row | {"num_deps": n}, indent=1))
    got = S.read_human(spark, str(tmp_path)).orderBy("num_deps").collect()
    assert [(r.file, r.raw_file, r.theorem, r.time, r.modules, r.num_deps) for r in got] == [("p/c.v", "p/a/b/c.v", "Lemma x : y.", 3.0, ["M"], n) for n in range(2)]
