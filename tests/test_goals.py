"""Goals up to names: given cases, and all readings of variables tried on small obligations."""

import itertools
import json
import random

from gneiss.functions import goals as G


def use(name):
    return {"v": ["CRef", {"v": ["Ser_Qualid", ["DirPath", []], ["Id", name]]}, None], "loc": [1, 2]}


def eq(a, b):
    return ["CNotation", None, [["InConstrEntry"], "_ = _"], [[use(a), use(b)], [], []]]


def exists(name, body):
    return ["CNotation", [body, [["CLocalAssum", [{"v": ["Name", ["Id", name]], "loc": 3}], "nat"]]]]


def goal(tree, *hyps):
    return {"goal": tree, "hyps": [{"ids": ids, "ast": ast} for ids, ast in hyps]}


ONE = goal(eq("x3", "x2"), (["H1"], eq("x1", "x3")), (["H2"], eq("x1", "x2")), (["H3"], eq("x1", "x2")))
TWO = goal(eq("x3", "x2"), (["H1"], eq("x1", "x3")), (["H2"], eq("x1", "x2")))
MORE = goal(eq("x3", "x2"), *[(h["ids"], h["ast"]) for h in ONE["hyps"]], (["H4"], ["CApp", use("foo"), use("x1")]))
OTHER = goal(["CApp", use("S"), eq("x3", "x2")], *[(h["ids"], h["ast"]) for h in ONE["hyps"]])


def test_goals_of_one_statement():
    assert G.as_hard_as(ONE, TWO) and G.as_hard_as(TWO, ONE)
    assert not G.as_hard_as(MORE, ONE) and not G.as_hard_as(MORE, TWO)
    assert G.as_hard_as(ONE, MORE) and G.as_hard_as(TWO, MORE)
    for x in (ONE, TWO, MORE):
        assert not G.as_hard_as(OTHER, x) and not G.as_hard_as(x, OTHER)


def test_choices_of_hypotheses_are_taken_back():
    """Taking the first hypothesis that fits would bind a, b to b, c and leave nothing for the next."""
    typed = (["a", "b", "c"], "nat")
    less = lambda x, y: ["CApp", "lt", use(x), use(y)]
    a = goal("False", typed, (["H1"], eq("a", "b")), (["H2"], less("b", "a")), (["H3"], eq("b", "c")))
    b = goal("False", typed, (["H1"], eq("b", "c")), (["H2"], less("b", "a")), (["H3"], eq("a", "b")))
    assert G.as_hard_as(a, b) and G.as_hard_as(b, a)
    assert not G.as_hard_as(a, goal("False", typed, (["H1"], eq("b", "c")), (["H2"], less("b", "a"))))


def test_variables_that_the_goal_settles_have_equal_types():
    a = goal(use("x"), (["x"], "nat"))
    assert G.as_hard_as(a, goal(use("n"), (["n"], "nat")))
    assert not G.as_hard_as(a, goal(use("n"), (["n"], "bool"), (["m"], "nat")))
    assert not G.as_hard_as(a, goal(use("zero"), (["n"], "nat")))  # no variable there
    assert G.as_hard_as(goal(use("zero")), goal(use("zero"), (["n"], "nat")))


def test_bound_names():
    free = {"n"}
    assert G.unified(exists("h", eq("h", "x")), exists("k", eq("k", "n")), {"x": None}, free) == {"x": "n"}
    assert G.unified(exists("h", eq("h", "x")), exists("k", eq("h", "n")), {"x": None}, free) is None
    assert G.unified(eq("x", "x"), eq("n", "m"), {"x": None}, {"n", "m"}) is None
    assert G.unified(exists("x", use("x")), exists("n", use("n")), {"x": None}, free) == {"x": None}


def test_leaves():
    for x, y, same in [(1, True, False), (1, 1.0, False), (None, None, True), (None, 0, False), ([], [], True), ([], {}, False), ({}, [], False), ("a", ["a"], False)]:
        assert (G.unified(x, y, {}, set()) is not None) is same
    assert G.unified({"loc": 1, "a": 2}, {"loc": 9, "a": 2}, {}, set()) == {}
    assert G.unified({"a": 2, "b": 1}, {"a": 2, "c": 1}, {}, set()) is None


def test_deep_trees():
    deep = use("x")
    for _ in range(20_000):
        deep = [deep, 1]
    assert G.unified(deep, deep, {}, set()) == {}


def test_against_all_readings():
    pick, yes = random.Random(3), 0
    kinds = ["nat", "bool"]

    def some():
        names = [f"v{i}" for i in range(pick.randint(1, 3))]
        typed = {n: pick.choice(kinds) for n in names}
        facts = [(pick.choice("RS"), pick.choice(names), pick.choice(names)) for _ in range(pick.randint(0, 4))]
        about = pick.choice(names)
        hyps = [([n], t) for n, t in typed.items()] + [([f"H{i}"], ["CApp", r, use(x), use(y)]) for i, (r, x, y) in enumerate(facts)]
        pick.shuffle(hyps)
        return typed, facts, about, goal(use(about), *hyps)

    for _ in range(1500):
        (t1, f1, g1, a), (t2, f2, g2, b) = some(), some()
        want = set(t1.values()) <= set(t2.values()) and any(
            f[g1] == g2 and t1[g1] == t2[g2] and all((r, f[x], f[y]) in f2 for r, x, y in f1)
            for f in (dict(zip(t1, to, strict=True)) for to in itertools.product(t2, repeat=len(t1)))
        )
        assert G.as_hard_as(a, b) is want
        yes += want
    assert 100 < yes < 1400


def test_sets_of_goals(spark):
    one, two = goal("A"), goal("B")
    rows = [([one, two], [two, one]), ([one], [one, one]), ([one], [two]), ([], [one]), ([one], []), ([MORE, ONE], [TWO])]
    d = spark.createDataFrame([(json.dumps(g), json.dumps(n)) for g, n in rows] + [(None, "[]")], "given string, needed string")
    got = [r.v for r in d.coalesce(1).select(G.covers("given", "needed").alias("v")).collect()]
    assert got == [True, True, False, False, True, True, None]
