"""Training examples and prompts from steps, premises and proofs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.operators.sampling import drawn, key_of
from gneiss.registry import choice

# Section tags of the prompts.
STATE, SCRIPT, PREMISES, PROOFS, TACTIC = "\n[STATE]\n", "\n[SCRIPT]\n", "\n[PREMISES]\n", "\n[PROOFS]\n", "\n[TACTIC]\n"
GOAL_SEPARATOR, PAIR_SEPARATOR = "\n[GOAL]\n", "\n[SEP]\n"


def best_last(passages: Column) -> Column:
    return F.array_join(F.reverse(passages), "\n")


@choice("collator", "basic")
def basic(state: Column, script: Column, premises: Column = None, proofs: Column = None) -> Column:
    return F.concat(F.lit(STATE), state, F.lit(SCRIPT), script, F.lit(TACTIC))


@choice("collator", "premise")
def premise(state: Column, script: Column, premises: Column, proofs: Column = None) -> Column:
    return F.concat(F.lit(PREMISES), best_last(premises), basic(state, script))


@choice("collator", "proof")
def proof(state: Column, script: Column, premises: Column, proofs: Column) -> Column:
    return F.concat(F.lit(PROOFS), best_last(proofs), basic(state, script))


@choice("collator", "proof-premise")
def proof_premise(state: Column, script: Column, premises: Column, proofs: Column) -> Column:
    return F.concat(F.lit(PREMISES), best_last(premises), F.lit(PROOFS), best_last(proofs), basic(state, script))


@choice("collator", "no-script")
def no_script(state: Column, script: Column, premises: Column, proofs: Column) -> Column:
    return F.concat(F.lit(PREMISES), best_last(premises), F.lit(PROOFS), best_last(proofs), F.lit(STATE), state, F.lit(TACTIC))


def context(prefix: Column, goals: Column) -> Column:
    numbered = F.transform(goals, lambda g, i: F.concat(F.lit("Goal "), (i + 1).cast("string"), F.lit(":\n"), g))
    return F.concat(prefix, F.lit("\n\n"), F.array_join(numbered, "\n\n"))


def negatives(step: str, positives: DataFrame, available: DataFrame, item: str, total: int, in_file: int) -> DataFrame:
    """(step, positive, negative, own): ``total`` sampled negatives for each positive. A step with fewer negatives
    gives none; at most ``in_file`` come from the step's own file, more only if others cannot fill the rest.
    ``available``: step, item, own; positives must not be among them. Rows read and made are linear in the positives
    and in what is available: a positive's sample is named by places, pairs are not ordered."""
    n = available.groupBy(step).agg(F.count_if("own").alias("_own"), F.count_if(~F.col("own")).alias("_other"))
    n = n.where(F.col("_own") + F.col("_other") >= total)
    want = F.when(F.lit(in_file) + F.col("_other") < total, F.least(F.lit(total), "_own")).otherwise(F.least(F.lit(in_file), "_own")).cast("long")
    each = positives.select(step, F.col(item).alias("positive")).join(n.withColumn("_want", want), step)
    side = lambda own, size, many: F.struct(F.lit(own).alias("own"), size.alias("_size"), many.alias("_many"))
    sides = F.explode(F.array(side(True, F.col("_own"), F.col("_want")), side(False, F.col("_other"), F.lit(total) - F.col("_want"))))
    asks = each.select(step, "positive", sides.alias("_side")).select(step, "positive", "_side.*")
    asks = asks.where("_many > 0").withColumn("_key", key_of("neg", F.col(step), F.col("positive"), F.col("own").cast("int")))
    return drawn(asks, available, [step, "own"], item, "_size", "_many", "_key").select(step, "positive", F.col(item).alias("negative"), "own")
