"""Goals that differ by the names of their variables only: trees unified, hypotheses covered, sets of goals compared.

A tree is what a parser writes as JSON. ``["Ser_Qualid", path, ["Id", name]]`` uses a name, ``["Name", ["Id", name]]``
binds one, and ``loc`` says where something stands. An obligation is ``{"hyps": [{"ids": [...], "ast": tree}], "goal":
tree}``; its variables are the ids of its hypotheses.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Heads of nodes that use, bind and introduce names, and the key of locations.
USE, BIND, INTRODUCE, PLACE = "Ser_Qualid", "Name", "CLocalAssum", "loc"


def name_in(tree, head: str) -> str | None:
    """The name that a node of this head uses or binds."""
    if isinstance(tree, list) and tree and tree[0] == head and isinstance(tree[-1], list) and len(tree[-1]) == 2 and tree[-1][0] == "Id":
        return tree[-1][1]
    return None


def introduces(tree) -> bool:
    """Whether a node, or what leads it, introduces names."""
    while isinstance(tree, list) and tree:
        tree = tree[0]
    return tree == INTRODUCE


def unified(a, b, bound: dict[str, str | None], free: set[str]) -> dict[str, str | None] | None:
    """``bound`` with the variables of ``a`` that equality with ``b`` settles, each once, by names out of ``free``;
    None if no reading makes the trees equal. Names bound inside the trees stand for each other, first of all, and
    from where they are introduced to the end; among siblings those that introduce names come first. Two variables
    may get one name. Locations do not count.
    """
    bound, inner, work = dict(bound), {}, [(a, b)]
    while work:
        x, y = work.pop()
        if (used := name_in(x, USE)) is not None:
            to = name_in(y, USE)
            if to is None:
                return None
            if used in inner:
                same = inner[used] == to
            elif used not in bound:
                same = x[1:] == y[1:]
            elif bound[used] is None:
                same = to in free
                bound[used] = to
            else:
                same = bound[used] == to
            if not same:
                return None
        elif (binder := name_in(x, BIND)) is not None:
            if (to := name_in(y, BIND)) is None:
                return None
            inner[binder] = to
        elif isinstance(x, dict):
            keys = [k for k in x if k != PLACE]
            if not isinstance(y, dict) or len(x) != len(y) or not all(k in y for k in keys):
                return None
            work += [(x[k], y[k]) for k in reversed(keys)]
        elif isinstance(x, list):
            if not isinstance(y, list) or len(x) != len(y):
                return None
            work += reversed(sorted(zip(x, y, strict=True), key=lambda pair: not introduces(pair[0])))
        elif type(x) is not type(y) or x != y:
            return None
    return bound


def types_of(obligation: dict) -> dict:
    """variable -> the tree of its hypothesis, the first if several name it."""
    out: dict = {}
    for h in obligation["hyps"]:
        for name in h["ids"]:
            out.setdefault(name, h["ast"])
    return out


def as_hard_as(a: dict, b: dict) -> bool:
    """Whether a proof of ``a`` proves ``b``: goals are equal under some reading of a's variables as b's, variables
    that the goal settles are of equal types, and each hypothesis of ``a`` is one of ``b``, several may be the same.

    Which hypothesis of ``b`` is taken settles more variables, so all choices are tried, a state of names never twice.
    """
    mine, others = types_of(a), types_of(b)
    free = set(others)
    names = unified(a["goal"], b["goal"], dict.fromkeys(mine), free)
    for name, tree in mine.items():
        if names is None:
            return False
        if names[name] is not None:
            names = unified(tree, others[names[name]], names, free)
    if names is None:
        return False
    work, seen = [(0, names)], set()
    while work:
        covered, names = work.pop()
        if covered == len(a["hyps"]):
            return True
        for h in b["hyps"]:
            more = unified(a["hyps"][covered]["ast"], h["ast"], names, free)
            if more is not None and (state := (covered + 1, frozenset(more.items()))) not in seen:
                seen.add(state)
                work.append((covered + 1, more))
    return False


def cover(given: list[dict], needed: list[dict]) -> bool:
    """Whether each obligation needed has one given that is as hard; one may serve for several."""
    return all(any(as_hard_as(g, n) for g in given) for n in needed)


def each(f, *columns: pd.Series) -> pd.Series:
    """``f`` of JSON values, null where one of them is."""
    return pd.Series([None if None in row else f(*map(json.loads, row)) for row in zip(*columns, strict=True)], dtype="object")


@F.pandas_udf(T.BooleanType())
def alpha_equal(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two closed trees are equal but for the names that they bind."""
    return each(lambda x, y: unified(x, y, {}, set()) is not None, a, b)


@F.pandas_udf(T.BooleanType())
def hard_as(a: pd.Series, b: pd.Series) -> pd.Series:
    """``as_hard_as`` on JSON."""
    return each(as_hard_as, a, b)


@F.pandas_udf(T.BooleanType())
def covers(given: pd.Series, needed: pd.Series) -> pd.Series:
    """``cover`` on JSON lists."""
    return each(cover, given, needed)
