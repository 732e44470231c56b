"""Sparse and dense retrieval over all documents or over what is visible to each query.

Scores are rounded to six digits and equal ones ranked by key, so that ranks do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import text as T
from gneiss.operators import dense, sparse
from gneiss.store import cut


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf, len): one row for each term of each document."""
    d = docs.select(F.col(id_col), T.tokens(F.col(text_col)).alias("_t"))
    return d.select(id_col, F.size("_t").alias("len"), F.explode("_t").alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def corpus_size(docs: DataFrame, text_col: str) -> DataFrame:
    """One row: number of documents and average length, empty ones included."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg(F.size(T.tokens(F.col(text_col)))).alias("avg_len"))


def document_frequency(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, df). Terms are summed where documents are; only documents that are several rows of one id are brought
    together first."""
    again = cut(docs.groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1"))  # its size is known
    same = docs[id_col].eqNullSafe(again["_id"])
    once = docs.join(again, same, "left_anti").select(F.explode(F.array_distinct(T.tokens(F.col(text_col)))).alias("term"))
    several = term_counts(docs.join(again, same, "left_semi"), id_col, text_col).select("term")
    return once.unionByName(several).groupBy("term").agg(F.count("*").alias("df"))


def ranked(scores: DataFrame, by: list[str], id_col: str, k: int, score: str = "score") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), F.col(id_col)))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def bm25_topk(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", qid: str = "item_id", qtext: str = "text", k: int = 20) -> DataFrame:
    """(qid, rank, id, score): BM25 over all documents; query terms count as often as they occur."""
    best = sparse.best_of(docs, queries, "bm25", id_col, text_col, qid, qtext, k)
    return ranked(best, ["qid"], "id", k).select(F.col("qid").alias(qid), "rank", F.col("id").alias(id_col), "score")


def tfidf_topk(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", qid: str = "item_id", qtext: str = "text", k: int = 20) -> DataFrame:
    """(qid, rank, id, score): unnormalised TF-IDF product over distinct query terms."""
    best = sparse.best_of(docs, queries, "tfidf", id_col, text_col, qid, qtext, k)
    return ranked(best, ["qid"], "id", k).select(F.col("qid").alias(qid), "rank", F.col("id").alias(id_col), "score")


def visible_topk(docs: DataFrame, queries: DataFrame, kind: str = "bm25", id_col: str = "doc_id", text_col: str = "text", file_col: str = "source", line_col: str = "line", qid: str = "query_id", qtext: str = "query", k: int = 5, edges: DataFrame | None = None, group_of: Callable | None = None) -> DataFrame:
    """(qid, rank, id, score) over the documents of the query's file on earlier lines, and of the files that its file
    depends on by ``edges`` (file, dep), with statistics of just these. Every visible document is ranked, those
    without a shared term with score 0. With ``group_of``, from an array of ids to one of groups, the rows up to the one
    that brings the ``k``-th distinct group are there, and some after it."""
    best = sparse.best_of(docs, queries, kind, id_col, text_col, qid, qtext, k, file_col, line_col, edges, group_of=group_of)
    if group_of is not None:
        rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
        return best.select(F.col("qid").alias(qid), rank.alias("rank"), F.col("id").alias(id_col), "score")
    return ranked(best, ["qid"], "id", k).select(F.col("qid").alias(qid), "rank", F.col("id").alias(id_col), "score")


def cut_at_group(ranks: DataFrame, by: list[str], group: list[str], k: int) -> DataFrame:
    """Rows up to and including the one with the first occurrence of the ``k``-th distinct group."""
    order = Window.partitionBy(*by).orderBy("rank")
    first = F.row_number().over(Window.partitionBy(*by, *group).orderBy("rank")) == 1
    out = ranks.withColumn("_first", first.cast("int"))
    return out.withColumn("_before", F.coalesce(F.sum("_first").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("_before") < k).drop("_first", "_before")


def first_of_group(ranks: DataFrame, by: list[str], group: list[str]) -> DataFrame:
    """One row per group: its best rank, ranked anew."""
    best = ranks.groupBy(*by, *group).agg(F.min("rank").alias("best"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("best")))


#: Statement keywords that give a name, in the order in which they are tried.
NAME_FORMS = ("Definition", "Fixpoint", "CoFixpoint", "Inductive", "CoInductive", "Variant", "Class", "Module Type", "Module", "Instance")
#: Weight of a name that only hypotheses hold, and of the standard library.
HYPOTHESIS_WEIGHT, LIBRARY_WEIGHT, LIBRARY = 0.7, 0.5, "lib/coq/theories"


def declared_name(text: Column, forms: tuple[str, ...] = NAME_FORMS) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, rf"{f}\s+(\S+?){T.NAME_END}", 1), F.lit("")) for f in forms])


def lookup_rank(premises: DataFrame, queries: DataFrame, name: Column, qid: str, goal_ids: str, hyp_ids: str, id_col: str, path: Column, k: int | None = None) -> DataFrame:
    """Premises whose declared name the query mentions: 1 in the goal, 0.7 in a hypothesis, half of it from the
    standard library; all others are dropped."""
    p = premises.select(F.col(id_col), name.alias("name"), path.contains(LIBRARY).alias("library")).where("name IS NOT NULL")
    ids = queries.select(qid, F.explode(goal_ids).alias("name"), F.lit(1.0).alias("w")).unionByName(queries.select(qid, F.explode(hyp_ids).alias("name"), F.lit(HYPOTHESIS_WEIGHT).alias("w")))
    ids = ids.groupBy(qid, "name").agg(F.max("w").alias("w"))
    scores = p.join(ids, "name").select(qid, id_col, (F.col("w") * F.when(F.col("library"), LIBRARY_WEIGHT).otherwise(1.0)).alias("score"))
    return ranked(scores, [qid], id_col, k or (1 << 30))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def dense_topk(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", emb: str = "embedding", k: int = 5, rounds: int = 6) -> DataFrame:
    """(query_id, rank, id, score) by dot product; a stated query set against all rows."""
    s = dense.best_of(vectors, queries, id_col, emb, k, digits=rounds).select("query_id", F.col("id").alias(id_col), "score")
    return ranked(s, ["query_id"], id_col, k).select("query_id", "rank", id_col, "score")


def rerank(ranks: DataFrame, by: list[str], id_col: str, score: Column, take: int) -> DataFrame:
    """The first ``take`` of a ranking, ordered anew by another score."""
    out = ranks.where(F.col("rank") <= take).withColumn("rerank_score", score)
    return out.withColumn("rerank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("rerank_score"), id_col)))


def gather(vectors: DataFrame, wanted: DataFrame, id_col: str = "vec_id", pos: str = "pos") -> DataFrame:
    """Vectors in the order of the ids asked for, repeats included; an unknown id gives a null vector."""
    return wanted.join(vectors, id_col, "left")


def pages(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Fixed-size pages of a dense id starting at 0."""
    return rows.withColumn("page", F.floor(F.col(order) / size).cast("int"))
