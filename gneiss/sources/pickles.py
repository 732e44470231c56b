"""Pickled results: their values as JSON, without running what they name."""

from __future__ import annotations

import io
import json
import pickle
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Fields:
    """Stands for an object of a class that is not loaded: what it was made of."""

    def __init__(self, *given):
        if given:
            self.given = list(given)


def joined(*parts: str) -> str:
    return "/".join(parts).replace("//", "/", 1)


# Classes of paths, whose pickles are their parts.
PATHS = {"PosixPath", "PurePosixPath"}


class Reader(pickle.Unpickler):
    """Unpickles plain values and objects of classes of the given names, as ``Fields``; other names are refused."""

    def __init__(self, data: bytes, allowed: frozenset[str]):
        super().__init__(io.BytesIO(data))
        self.allowed = allowed

    def find_class(self, module: str, name: str):
        if module.split(".")[0] == "pathlib" and name in PATHS:
            return joined
        if name in self.allowed:
            return Fields
        raise pickle.UnpicklingError(f"{module}.{name} is not allowed")


def plain(value):
    if isinstance(value, Fields):
        return vars(value)
    if isinstance(value, set | frozenset):
        return sorted(value)
    raise TypeError(f"{type(value).__name__} has no JSON")


def unpickled(content: Column, classes: Iterable[str] = ()) -> Column:
    """STRUCT(value, refused): the JSON of a pickle, or why there is none. Objects of the classes named are their
    fields, sets are sorted lists, paths are texts. Null gives nulls. Nothing that a pickle names is imported or run."""
    allowed = frozenset(classes)

    @F.pandas_udf(T.StructType().add("value", "string").add("refused", "string"))
    def read(data: pd.Series) -> pd.DataFrame:
        out = []
        for x in data:
            try:
                out.append((None if x is None else json.dumps(Reader(bytes(x), allowed).load(), default=plain, ensure_ascii=False), None))
            except Exception as e:  # noqa: BLE001  a broken pickle can raise anything; what it raised is the result
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["value", "refused"])

    return read(content)


@F.pandas_udf(T.BinaryType())
def pickled(value: pd.Series) -> pd.Series:
    """The pickle of a JSON value."""
    return value.map(lambda x: None if x is None else pickle.dumps(json.loads(x)))


def read_pickles(spark: SparkSession, folder: str, classes: Iterable[str] = (), glob: str = "*.pkl") -> DataFrame:
    """(path, value, refused) of the pickles anywhere below a folder, one row a file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", unpickled(F.col("content"), classes).alias("r")).select("path", "r.*")
