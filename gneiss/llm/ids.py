"""Telling apart documents that share an id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.store import cut
from gneiss.operators.corpus import intern


def told_apart(d: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``d`` (doc_id, text) with an id for each pair of id and text, and what gives a result its ids back.

    Where no id has several texts, which one pass tells, ids stay as they are. Else all pairs are numbered in the
    order of (id, hash of the text), so that earlier ids stay earlier. Null ids stay null.
    """
    known = d.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("version"))
    several = known.groupBy("doc_id").agg((F.min("version") != F.max("version")).alias("several")).where("several")
    if several.isEmpty():
        return d, lambda out: out
    number = cut(intern(known.distinct(), ["doc_id", "version"], "doc_id"))
    numbered = d.withColumn("version", F.xxhash64("text")).join(number, ["doc_id", "version"], "left").select(F.col("db_idx").alias("doc_id"), "text")

    def back(out: DataFrame) -> DataFrame:
        names = number.select(F.col("db_idx").alias("__gneiss_at"), F.col("doc_id").alias("__gneiss_id"))
        rest = [c for c in out.columns if c != "doc_id"]
        return out.join(names, F.col("doc_id") == F.col("__gneiss_at"), "left").select(F.col("__gneiss_id").alias("doc_id"), *rest)

    return numbered, back
