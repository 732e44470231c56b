"""The corpus pipeline: documents in, a mixed, clean, deduplicated corpus out.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; what it returns is written as
Parquet and read again before the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.decontamination import decontaminate
from gneiss.llm.language_id import UNDETERMINED, identify, train
from gneiss.llm.line_dedup import dedup_lines
from gneiss.llm.minhash_dedup import near_duplicates
from gneiss.llm.mixing import mix
from gneiss.llm.store import cut, free

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A language is believed from a score on that lies this far from what two even decisions give (0.25) to the lowest of
#: a text that was learned from: it follows the corpus and stays below what real documents score.
BELIEF, EVEN = 0.5, 0.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (no letters, no text, or no belief) and writes the predicted one. Rows
    that repeat are judged alike; an id may be null; a long text is read whole; where nothing can be learned, nothing
    is kept."""
    model = train(docs)
    least = EVEN + BELIEF * max(0.0, model.lowest - EVEN) if model else 0.0
    found = identify(docs, model, keep=("text", "source", "n_chars"))
    known = found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least))
    return known.withColumnRenamed("lang_pred", "lang").select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines like an earlier one, and documents of which nothing is left. Rows with a null id or text are
    left as they are."""
    out = dedup_lines(docs).where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five-word shingles, similarity of 0.8 or more. Rows
    that are equal count as one; rows that share an id are judged by their own text. The smallest id stays (a null
    one last), of equal ids the row with the smallest hash."""
    d = docs.select(COLUMNS).withColumn("__row", F.xxhash64(*COLUMNS))
    group = near_duplicates(d, id_col="__row", size=5, top=80, bottom=100, bands=30, rows=4).select(F.col("doc_id").alias("__row"), "component_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row"))
    kept = d.select("__row", "doc_id").distinct().join(group, "__row").groupBy("component_id").agg(first.alias("first")).select("first.__row")
    return d.join(kept, "__row", "left_semi").dropDuplicates(["__row"]).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, also with other values in its slots. Null and empty texts hold
    nothing; rows that repeat or share an id are judged by their own text; without items or rows nothing is dropped."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and thins out documents until sources have their target weights, and shuffles. A null source is a
    source; rows that repeat an id are drawn alike, rows without one by their text; no rows give no rows."""
    return mix(docs.select(COLUMNS))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Learned machines and fuzzy components have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; each stage's table goes once the next one is written. The last stage reads
    the table before it, which stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        free(before)
    return STAGES[-1][1](spark, docs, sf_dir)
