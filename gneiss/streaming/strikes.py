"""Workers that stop after failures in a row, as a stream with the state of each worker, kept by groups of workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Groups that workers are dealt to, each with its own state. Fixed value: a checkpoint holds one state a group.
GROUPS = 1024


def in_order(columns: list[pd.Series]) -> np.ndarray:
    """Places of the rows in the order of the columns, nulls first; rows that are alike keep theirs."""
    arrays = [c.to_numpy() for c in columns]
    if any(x.dtype.kind not in "iufMb" for x in arrays):
        rows = pd.DataFrame({k: pd.Series(x) for k, x in enumerate(arrays)})
        return rows.sort_values([*rows.columns], kind="stable", na_position="first").index.to_numpy()
    keys = [k for x in arrays for k in ((x,) if x.dtype.kind in "iub" else (~pd.isna(x), x))]
    return np.lexsort(keys[::-1])


def until_stopped(results: DataFrame, worker: str, order: list[str], failed: str, limit: int = 3) -> DataFrame:
    """(worker, order, strikes, stop): the results of a stream that their workers came to, how many failures in a row
    each ends, and whether the worker stops there, which is at ``limit``. A worker has no results after that.

    The state, kept in the checkpoint, is a number for each worker whose last result was a failure, so that a stream that
    is stopped and started again goes on counting. Workers are dealt to a fixed number of groups, as a call for each worker
    costs more than its rows. Micro-batches come in order; a group's rows of one micro-batch are put in order here, null
    places first, and are held by one task, so the files of a trigger bound them. Unknown ``failed`` is a failure.
    """
    kinds = {f.name: f.dataType.simpleString() for f in results.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (worker, *order)) + ", strikes int, stop boolean"
    state_schema = f"workers array<{kinds[worker]}>, strikes array<int>"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows = pd.concat(batches, ignore_index=True)
        if rows.empty:
            return
        code, names = pd.factorize(rows[worker], use_na_sentinel=False)
        names = [None if pd.isna(x) else x for x in names.tolist()]
        before = np.array([known.get(x, 0) for x in names])
        rows, code = rows[before[code] < limit], code[before[code] < limit]
        place = in_order([pd.Series(code), *(rows[c] for c in order)])
        rows, code = rows.take(place), code[place]
        bad = rows[failed].isna().to_numpy() | rows[failed].fillna(True).to_numpy(bool)
        at = np.arange(len(code))
        new = np.ones(len(code), bool)
        new[1:] = code[1:] != code[:-1]
        start = np.maximum.accumulate(np.where(new, at, 0))  # each worker's first row
        good = np.maximum.accumulate(np.where(bad, -1, at))  # the last success up to each row
        counts = np.where(good >= start, at - good, at - start + 1 + before[code])
        hit = np.cumsum(counts >= limit) - (counts >= limit)
        kept = hit == hit[start]  # no row of the worker before it reached the limit
        rows, code, counts = rows[kept], code[kept], counts[kept]
        last = np.flatnonzero(np.append(code[1:] != code[:-1], True)[: len(code)])
        known |= {names[c]: n for c, n in zip(code[last].tolist(), counts[last].tolist(), strict=True)}
        failing = {x: n for x, n in known.items() if n}
        state.update(([*failing], [*failing.values()]))
        yield pd.DataFrame({c: rows[c] for c in (worker, *order)} | {"strikes": counts.astype(np.int32), "stop": counts >= limit})

    group = F.pmod(F.xxhash64(worker), F.lit(GROUPS))
    dealt = results.withColumn("_group", group).groupBy("_group")
    return dealt.applyInPandasWithState(step, schema, state_schema, "append", GroupStateTimeout.NoTimeout)
