"""Scalar functions against values worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from gneiss.functions import structure as X
from gneiss.functions import text as T


def value(spark, column, **row):
    return spark.createDataFrame([row]).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("statement", "name"),
    [("Theorem foo: x = y.", "foo"), ("Lemma bar (n: nat).", "bar"), ("nothing", "Anon"), ("", "Anon"), ("Instance a:b.", "a")],
)
def test_theorem_name(spark, statement, name):
    assert value(spark, T.theorem_name(F.col("s")), s=statement) == name


def test_paths(spark):
    assert value(spark, T.data_point_name(F.col("p")), p="/x/repos/a/b/c.v") == "a-b-c.v"
    assert value(spark, T.data_point_name(F.col("p")), p="/x/c.v") is None
    assert value(spark, T.strip_parents(F.col("p")), p="../../a/../b") == "a/../b"
    assert value(spark, T.rebase(F.col("p"), "/old", "/new"), p="/old/x") == "/new/x"
    assert value(spark, T.same_file(F.col("p"), F.col("q")), p="../b/c.v", q="a/b/c.v") is True
    assert value(spark, T.same_file(F.col("p"), F.col("q")), p="b/d.v", q="a/b/c.v") is False
    assert value(spark, T.strip_owner(F.col("p"), ["coq-community", "thery"]), p="thery-PolTac/x.v") == "PolTac/x.v"
    assert value(spark, T.ends_of_path(F.col("p")), p="a/b/c/d.v") == "a/d.v"
    assert value(spark, T.owner_and_repo(F.col("p")), p="git@host:own/rep.git") == "own/rep"
    assert value(spark, T.from_repos(F.col("p")), p="/d/repos/a/b") == "repos/a/b"


@pytest.mark.parametrize(("s", "n"), [("Proof. intros. simpl. Qed.", 2), ("auto", 1), ("a; b. c.", 3), ("", 1)])
def test_proof_length(spark, s, n):
    assert value(spark, T.proof_length(F.col("s")), s=s) == n


def test_goal_tokens(spark):
    row = spark.sql("SELECT named_struct('hyps', array('n, m: nat', 'H: n = m'), 'goal', 'm = n') g")
    out = row.select(T.goal_tokens(F.col("g")).alias("t")).first().t
    assert (out.hyps, out.goal) == (["nat"], [])
    row = spark.sql("SELECT named_struct('hyps', array('H: a::b', 'bare x'), 'goal', 'c') g")
    out = row.select(T.goal_tokens(F.col("g")).alias("t")).first().t
    assert (out.hyps, out.goal) == (["ab", "bare", "x"], ["c"])


def test_goal_codec(spark):
    got = spark.range(1).select(T.goal_parts(F.lit("a\nb\n\nP")).alias("v")).first().v
    assert (got.hyps, got.goal) == (["a", "b"], "P")
    got = spark.range(1).select(T.goal_parts(F.lit("\n\nP")).alias("v")).first().v
    assert (got.hyps, got.goal) == ([""], "P")
    assert spark.range(1).select(T.goal_parts(F.lit("a\n\nb\n\nc")).alias("v")).first().v is None


def test_positions(spark):
    d = spark.createDataFrame([("a\nbc\ndef",)], "t string")
    at = d.select(T.line_of(F.col("t"), F.lit(3)).alias("l"), T.column_of(F.col("t"), F.lit(3)).alias("c")).first()
    assert (at.l, at.c) == (1, 1)
    cut = lambda *p: d.select(T.text_between(F.col("t"), *map(F.lit, p)).alias("v")).first().v
    assert (cut(1, 0, 1, 2), cut(0, 0, 2, 1), cut(0, 1, 1, 1)) == ("bc", "a\nbc\nd", "\nb")


def test_tool_output(spark):
    out = "x\x1b[32m only 1: synth with cache (only 1: auto; simpl).\r\nNo more subgoals."
    assert value(spark, T.tool_proof(F.col("s")), s=out) == "auto; simpl"
    assert value(spark, T.tool_proof(F.col("s")), s="nothing") is None
    assert value(spark, T.code_fence(F.col("s")), s="```coq\nauto.\n```") == "auto."
    assert value(spark, T.code_fence(F.col("s")), s="auto.") == "auto."


def test_scores_and_costs(spark):
    assert spark.range(1).select(T.goal_score(F.lit("abc"), F.array(F.lit("abd"), F.lit("xyzw"))).alias("v")).first().v == 1
    assert spark.range(1).select(T.goal_score(F.lit("abc"), F.array().cast("array<string>")).alias("v")).first().v == 3
    assert spark.range(1).select(T.cost(F.lit("gpt-4o"), F.lit(10), F.lit(2)).alias("v")).first().v == pytest.approx(8e-5)
    assert spark.range(1).select(T.cost(F.lit("none"), F.lit(10), F.lit(2)).alias("v")).first().v is None


def test_names_and_prompts(spark):
    assert value(spark, T.fill("Goal: %s\nProve it with %s.", F.col("a"), F.col("b")), a="P", b="auto") == "Goal: P\nProve it with auto."
    assert value(spark, T.output_name(F.col("a"), F.col("b")), a="w", b="x/y.v") == "w-x-y.v"
    info = value(spark, T.file_info(F.col("p")), p="/d/repos/r/a/b.v")
    assert tuple(info) == ("r-a-b.v", "repos/r/a/b.v", "repos/r", "repos/r")
    assert value(spark, T.without_prefix(F.col("p"), "ab/"), p="ab/c") == "c"
    with pytest.raises(Exception, match="no prefix"):
        value(spark, T.without_prefix(F.col("p"), "ab/"), p="c")


def test_comments():
    assert X.strip_comments("a (* b (* c *) *) d") == "a  d"
    assert X.strip_comments('"(* q *)" x') == '"(* q *)" x'
    assert X.strip_comments("") == ""
    assert X.strip_comments("a *) b") == "a *) b"


def test_trees():
    tree = {"loc": 1, "t": ["fun", "x", {"location": 3, "v": "x"}]}
    assert X.without_locations(tree) == {"t": ["fun", "x", {"v": "x"}]}
    assert json.dumps(X.without_locations([])) == "[]"


def test_tokens_are_what_the_pattern_matches(spark):
    """Every character, alone and between letters, by the pattern and by ``tokens``; matches are not looked for one by one."""
    texts = [c if alone else f"a{c}b {c}{c}" for c in map(chr, [*range(1, 0xD800), *range(0xE000, 0x10000), 0x1F600]) for alone in (True, False)]
    d = spark.createDataFrame([(t,) for t in [*texts, "", "  ", " a  b ", None]], "text string")
    pattern = F.regexp_extract_all("text", F.lit(T.TOKEN), F.lit(0))
    assert d.where(~T.tokens(F.col("text")).eqNullSafe(pattern)).count() == 0
    assert "regexp" not in str(T.tokens(F.col("text")))
