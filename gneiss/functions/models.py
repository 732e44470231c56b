"""Where models plug in: an encoder is a function from a batch of texts to an array of vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.registry import choice


@choice("encoder", "hash")
def hash_encoder(texts: list[str]) -> np.ndarray:
    """The bytes of each text's sha256 as 32 numbers: a stand-in that needs no model."""
    return np.array([list(hashlib.sha256(t.encode()).digest()) for t in texts], np.float32).reshape(len(texts), 32)


def mean_pool(states: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
    """Mean of token states, over the mask if there is one, at length one."""
    m = np.ones(states.shape[:2]) if mask is None else mask
    x = (states * m[:, :, None]).sum(1) / np.maximum(m.sum(1), 1e-9)[:, None]
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def encode(rows: DataFrame, text: str, encoder: Callable[[list[str]], np.ndarray], key: str = "id", batch: int = 128) -> DataFrame:
    """(key, emb): encoded a batch at a time where the rows are; null texts have a null vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                texts = part.column(1).to_pylist()
                there = [t for t in texts if t is not None]
                found = iter(encoder(there).astype(np.float32).tolist() if there else [])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if t is None else next(found) for t in texts], pa.list_(pa.float32()))], ["id", "emb"])

    return rows.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(run, "id long, emb array<float>")


# What a candidate proof must not contain.
FORBIDDEN = ("Theorem", "Lemma", "Proposition", "Remark", "Corollary", "Property", "Admitted.", "admit.", "Abort.")


@choice("checker", "stub")
def stub_checker(proof: str) -> str:
    """COMPLETE, VALID or INVALID without a prover: by how a text ends and by content that is not allowed."""
    if any(x in proof for x in FORBIDDEN):
        return "INVALID"
    return "COMPLETE" if proof.rstrip().endswith("Qed.") else "VALID"
