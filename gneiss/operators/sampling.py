"""Sampling without replacement, by naming positions instead of ordering pairs.

A group's rows are numbered once. A keyed permutation of the numbers below the group's size then says which row is
the i-th of a sample, for any number of samples of the same group, without looking at the others: what is joined is
one row for each drawn one.

The permutation is a balanced Feistel network over the next even number of bits; a value that falls outside goes
round again, which ends after less than four steps on average.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType

from gneiss.operators.ranges import numbered

ROUNDS, STEP, MODULUS = 4, 40503, 1 << 32
MULTIPLIERS = 2654435761, 1540483477, 2146121005  # odd; the last two are below 2^31, so that products fit


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where the permutation of 0..n-1 that ``key`` (below 2^32) names takes ``x``; n is below 2^50."""
    bits = np.ones(len(n), np.int64)
    while (short := (np.int64(1) << (2 * bits)) < n).any():
        bits[short] += 1
    mask = (np.int64(1) << bits) - 1
    out, todo = x.astype(np.int64), np.arange(len(x))
    while len(todo):
        b, m, k = bits[todo], mask[todo], key[todo].astype(np.int64)
        left, right = out[todo] >> b, out[todo] & m
        for r in range(ROUNDS):
            y = (right * MULTIPLIERS[0] + k + r * STEP) % MODULUS
            y = (y ^ (y >> 15)) * MULTIPLIERS[1] % MODULUS
            y = (y ^ (y >> 13)) * MULTIPLIERS[2] % MODULUS
            left, right = right, left ^ (y >> (32 - b))
        out[todo] = left << b | right
        todo = todo[out[todo] >= n[todo]]
    return out


@pandas_udf(ArrayType(LongType()))
def draws(key: pd.Series, n: pd.Series, many: pd.Series) -> pd.Series:
    """The first ``many`` of 1..n in the order that ``key`` names; all of them if there are no more."""
    size, count = n.to_numpy(np.int64), np.minimum(many.to_numpy(np.int64), n.to_numpy(np.int64)).clip(0)
    ends = count.cumsum()
    nth = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count)
    found = permuted(nth, np.repeat(size, count), np.repeat(key.to_numpy(np.int64), count)) + 1
    return pd.Series([x.tolist() for x in np.split(found, ends[:-1])] if len(ends) else [])


def key_of(*parts: Column | str) -> Column:
    """A number below 2^32 from the parts, the same in every engine."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def drawn(asks: DataFrame, pool: DataFrame, group: list[str], item: str, size: str, many: str, key: str) -> DataFrame:
    """Each row of ``asks`` (group, the pool group's ``size``, how ``many``, a ``key``) with the items drawn for it,
    one row each. Items of a group differ; null groups draw nothing."""
    rows = numbered(pool.select(*group, item), group, [item], "_at")
    wanted = asks.withColumn("_at", F.explode(draws(F.col(key), F.col(size), F.col(many))))
    return wanted.join(rows, [*group, "_at"]).drop("_at")
