"""Functions on nested structure that have no column expression: batches of rows go through Arrow."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


MARK = re.compile(r'\(\*|\*\)|"')


def strip_comments(s: str) -> str:
    """Text outside ``(* ... *)``, which nest; quotes are looked through, so marks inside them do not count. A quote
    after a backslash is none. Goes from mark to mark, not from character to character."""
    out, depth, quoted, kept, at = [], 0, False, 0, 0
    while m := MARK.search(s, at):
        i, at = m.start(), m.end()
        if m.group() == '"':
            if i == 0 or s[i - 1] != "\\":
                quoted = not quoted
        elif quoted:
            at = i + 1
        elif m.group() == "(*":
            if not depth:
                out.append(s[kept:i])
            depth += 1
            kept = at
        elif depth:
            depth -= 1
            kept = at
        else:
            at = i + 1
    if not depth:
        out.append(s[kept:])
    return "".join(out)


@F.pandas_udf(T.StringType())
def without_comments(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else strip_comments(x))


LOCATIONS = frozenset({"loc", "location"})


def without_locations(tree):
    if isinstance(tree, dict):
        return {k: without_locations(v) for k, v in tree.items() if k not in LOCATIONS}
    return [without_locations(x) for x in tree] if isinstance(tree, list) else tree


@F.pandas_udf(T.StringType())
def unlocated(tree: pd.Series) -> pd.Series:
    """``without_locations`` on JSON."""
    return tree.map(lambda x: None if x is None else json.dumps(without_locations(json.loads(x)), separators=(",", ":"), ensure_ascii=False))
