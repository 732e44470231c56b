"""Nested configurations, as YAML or mappings, to operators: ``alias`` says which one, the other keys are its arguments.

An argument that is itself a configuration is built first; what it may be is the kind that the argument is named after.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.operators import corpus as C
from gneiss.operators import examples as X  # noqa: F401  registers the collators
from gneiss.operators import retrieval as R
from gneiss.registry import CHOICES, choice, choose

ALIAS = "alias"


def build(kind: str, conf: Mapping, at: str | None = None):
    """The operator of a kind that ``conf`` describes. What is unknown or missing is refused with where it stands."""
    at = at or kind
    if not isinstance(conf, Mapping) or ALIAS not in conf:
        raise ValueError(f"{at}: a mapping with {ALIAS} is needed")
    try:
        make = choose(kind, conf[ALIAS])
    except ValueError as e:
        raise ValueError(f"{at}.{ALIAS}: {e}") from None
    takes = inspect.signature(make).parameters
    if unknown := [k for k in conf if k != ALIAS and k not in takes]:
        raise ValueError(f"{at}.{unknown[0]}: {conf[ALIAS]} takes {sorted(takes)}")
    if missing := [k for k, p in takes.items() if p.default is p.empty and k not in conf]:
        raise ValueError(f"{at}.{missing[0]}: missing")
    return make(**{k: part(k, v, f"{at}.{k}") for k, v in conf.items() if k != ALIAS})


def part(name: str, value, at: str):
    """An argument: lists are named in the plural of their kind."""
    if isinstance(value, list):
        return [part(name.removesuffix("s"), v, f"{at}[{n}]") for n, v in enumerate(value)]
    if name in CHOICES or (isinstance(value, Mapping) and ALIAS in value):
        return build(name, value, at)
    return value


def from_yaml(kind: str, text: str):
    """``build`` from YAML text; only plain values are read."""
    try:
        import yaml
    except ImportError as e:
        raise ImportError("YAML configurations need PyYAML; give build a mapping instead") from e
    return build(kind, yaml.safe_load(text))


Filter = Callable[[Column, Column], Column]
Ranker = Callable[[DataFrame, DataFrame], DataFrame]


def named(name: str) -> Callable[[], Filter]:
    return lambda: lambda kind, path: C.named_filter(name, kind, path)


for _name in C.FILTERS:
    choice("filter", _name)(named(_name))


@choice("filter", "premise")
def premise(library_excludes: list = (), other_excludes: list = (), general_excludes: list = ()) -> Filter:
    return lambda kind, path: C.premise_filter(kind, path, tuple(library_excludes), tuple(other_excludes), tuple(general_excludes))


@choice("filter", "every")
def every(filters: list) -> Filter:
    """What passes all of some filters."""

    def passes(kind: Column, path: Column) -> Column:
        out = F.lit(True)
        for f in filters:
            out = out & f(kind, path)
        return out

    return passes


@choice("ranker", "bm25")
def bm25(k: int = 10) -> Ranker:
    return lambda docs, queries: R.bm25_topk(docs, queries, k=k)


@choice("ranker", "tf-idf")
def tf_idf(k: int = 10) -> Ranker:
    return lambda docs, queries: R.tfidf_topk(docs, queries, k=k)


@choice("search", "filtered")
def filtered(filter: Callable, ranker: Callable) -> Callable:  # noqa: A002  named after its kind
    """Rows (doc_id, text, kind, path) that pass a filter, ranked for queries."""
    return lambda docs, queries: ranker(docs.where(filter(F.col("kind"), F.col("path"))).select("doc_id", "text"), queries)


def written(name: str) -> Callable[[], Callable]:
    return lambda: choose("collator", name)


for _name in CHOICES["collator"]:
    choice("prompt", _name)(written(_name))


@choice("split", "proportional")
def proportional(train: float, val: float, seed: str = "0") -> Callable:
    return lambda files: C.proportional_split(files, "file", train, val, str(seed))


@choice("split", "leakage-safe")
def leakage_safe(test: list, val: list) -> Callable:
    """Rows (file, project, text), test and validation by names of projects."""
    return lambda files: C.leakage_safe_split(files, F.col("project").isin(*test), F.col("project").isin(*val))
