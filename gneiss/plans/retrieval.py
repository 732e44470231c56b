"""Queries of sparse and dense retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.functions import text as T
from gneiss.operators import dense
from gneiss.operators import retrieval as R
from gneiss.operators.corpus import intern
from gneiss.operators.ranges import numbered
from gneiss.registry import query, table

TOKENS = f"regexp_extract_all(coalesce(text, ''), '{T.TOKEN}')"
STATS = f"""
d AS (SELECT doc_id, source, {TOKENS} AS t FROM documents),
q AS (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark),
tf AS (SELECT doc_id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
n AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d)
"""
TOP = """
p AS (SELECT item_id, doc_id, coalesce(score, 0.0) AS score FROM (SELECT DISTINCT item_id FROM benchmark) CROSS JOIN (SELECT doc_id FROM documents) LEFT JOIN s USING (item_id, doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM p)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 20
"""


@query(
    "tokenize_counts",
    f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY ALL",
)
def tokenize_counts(spark, sf_dir):
    return R.term_counts(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "term", "tf")


@query("doc_freq_idf", f"WITH {STATS} SELECT term, df, round(ln((SELECT n FROM n) / df), 6) AS idf FROM df")
def doc_freq_idf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    df = R.document_frequency(docs, "doc_id", "text")
    return df.crossJoin(F.broadcast(docs.agg(F.count("*").alias("n")))).select("term", "df", F.round(F.log(F.col("n") / F.col("df")), 6).alias("idf"))


@query("avg_doc_len", f"WITH {STATS} SELECT n AS n_docs, round(a, 6) AS avg_len FROM n")
def avg_doc_len(spark, sf_dir):
    return R.corpus_size(table(spark, sf_dir, "documents"), "text").select("n_docs", F.round("avg_len", 6).alias("avg_len"))


@query(
    "bm25_topk",
    f"""WITH {STATS}, qf AS (SELECT item_id, term, count(*) AS f FROM q GROUP BY ALL),
    s AS (SELECT item_id, doc_id, round(sum(f * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.8 / (tf + 1.8 * (0.25 + 0.75 * len / a))), 6) AS score
          FROM qf JOIN tf USING (term) JOIN df USING (term), n GROUP BY ALL), {TOP}""",
)
def bm25_topk(spark, sf_dir):
    return R.bm25_topk(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "tfidf_topk",
    f"""WITH {STATS}, qf AS (SELECT item_id, term, count(*) AS f FROM q GROUP BY ALL),
    qt AS (SELECT *, 0.5 + 0.5 * f / max(f) OVER (PARTITION BY item_id) AS qtf FROM qf),
    s AS (SELECT item_id, doc_id, round(sum(qtf * tf / len * ln(n / df) * ln(n / df)), 6) AS score
          FROM qt JOIN tf USING (term) JOIN df USING (term), n GROUP BY ALL), {TOP}""",
)
def tfidf_topk(spark, sf_dir):
    return R.tfidf_topk(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


VISIBLE = f"""
d AS (SELECT doc_id, source, {TOKENS} AS t FROM documents),
q AS (SELECT doc_id AS query_id, source, {TOKENS} AS t FROM documents WHERE doc_id % 50 = 0),
v AS (SELECT query_id, d.doc_id, d.t, q.t AS qt FROM q JOIN d ON d.source = q.source AND d.doc_id < q.query_id),
n AS (SELECT query_id, count(*) AS n, sum(len(t)) / count(*) AS a FROM v GROUP BY ALL),
tf AS (SELECT query_id, doc_id, term, any_value(len) AS len, count(*) AS tf FROM (SELECT query_id, doc_id, len(t) AS len, unnest(t) AS term FROM v) GROUP BY ALL),
df AS (SELECT query_id, term, count(*) AS df FROM tf GROUP BY ALL),
qf AS (SELECT query_id, term, count(*) AS f FROM (SELECT query_id, unnest(t) AS term FROM q) GROUP BY ALL),
"""
VISIBLE_TOP = """
p AS (SELECT query_id, doc_id, coalesce(score, 0.0) AS score FROM v LEFT JOIN s USING (query_id, doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 5
"""


def visible(spark, sf_dir, kind):
    docs = table(spark, sf_dir, "documents").withColumn("line", F.col("doc_id"))
    asks = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "source", "line", F.col("text").alias("query"))
    return R.visible_topk(docs, asks, kind)


@query(
    "bm25_visible_topk",
    f"""WITH {VISIBLE} s AS (SELECT query_id, doc_id, round(sum(f * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.8 / (tf + 1.8 * (0.25 + 0.75 * len / a))), 6) AS score
    FROM qf JOIN tf USING (query_id, term) JOIN df USING (query_id, term) JOIN n USING (query_id) GROUP BY ALL), {VISIBLE_TOP}""",
)
def bm25_visible_topk(spark, sf_dir):
    return visible(spark, sf_dir, "bm25")


@query(
    "tfidf_visible_topk",
    f"""WITH {VISIBLE} s AS (SELECT query_id, doc_id, round(sum((0.5 + 0.5 * f / top) * tf / len * ln(n / df) * ln(n / df)), 6) AS score
    FROM qf JOIN (SELECT query_id, max(f) AS top FROM qf GROUP BY ALL) USING (query_id) JOIN tf USING (query_id, term) JOIN df USING (query_id, term) JOIN n USING (query_id) GROUP BY ALL), {VISIBLE_TOP}""",
)
def tfidf_visible_topk(spark, sf_dir):
    return visible(spark, sf_dir, "tfidf")


@query(
    "lookup_rank",
    f"""WITH p AS (SELECT doc_id, regexp_extract(text, '([A-Za-z]+)', 1) AS name, source IN ('src0', 'src1') AS library FROM documents),
    b AS (SELECT item_id, {TOKENS} AS t FROM benchmark),
    i AS (SELECT item_id, unnest(t[1:10]) AS name, 1.0 AS w FROM b UNION ALL SELECT item_id, unnest(t[11:]) AS name, 0.7 AS w FROM b),
    j AS (SELECT item_id, name, max(w) AS w FROM i GROUP BY ALL),
    s AS (SELECT item_id, doc_id, w * CASE WHEN library THEN 0.5 ELSE 1.0 END AS score FROM p JOIN j USING (name) WHERE name <> '')
    SELECT item_id, doc_id, round(score, 6)::DOUBLE AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""",
)
def lookup_rank(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    name = F.nullif(F.regexp_extract("text", "([A-Za-z]+)", 1), F.lit(""))
    path = F.when(F.col("source").isin("src0", "src1"), F.lit(R.LIBRARY)).otherwise(F.col("source"))
    t = T.tokens(F.col("text"))
    b = table(spark, sf_dir, "benchmark").select("item_id", F.slice(t, 1, 10).alias("goal"), F.when(F.size(t) > 10, F.slice(t, F.lit(11), F.size(t))).otherwise(F.array().cast("array<string>")).alias("hyps"))
    out = R.lookup_rank(docs, b, name, "item_id", "goal", "hyps", "doc_id", path, 10)
    return out.select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


DOT = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE))"


@query(
    "dense_topk",
    f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, round({DOT}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""",
)
def dense_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return R.dense_topk(e, e.where("vec_id % 50 = 0"))


@query(
    "dense_proof_topk",
    f"""WITH s AS (SELECT a.vec_id AS query_id, b.label, b.vec_id, round({DOT}, 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id < a.vec_id WHERE a.vec_id % 50 = 0),
    g AS (SELECT query_id, label, max(score) AS score, arg_min(vec_id, (-score, vec_id)) AS vec_id FROM s GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM g)
    SELECT query_id, rank::INTEGER AS rank, label, vec_id, score FROM r WHERE rank <= 3""",
)
def dense_proof_topk(spark, sf_dir):
    """The best earlier vector of each label, and the best three labels by it."""
    e = table(spark, sf_dir, "embeddings")
    s = dense.best_of(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 1, "label", earlier=True)
    s = s.select("query_id", F.col("group").cast("int").alias("label"), F.col("id").alias("vec_id"), "score")
    g = s.groupBy("query_id", "label").agg(F.max("score").alias("score"), F.min_by("vec_id", F.struct(-F.col("score"), "vec_id")).alias("vec_id"))
    return R.ranked(g, ["query_id"], "vec_id", 3).select("query_id", "rank", "label", "vec_id", "score")


@query(
    "vector_gather",
    """WITH w AS (SELECT row_number() OVER (ORDER BY e.vec_id, k) AS pos, e.vec_id * 7 + k * 13 AS vec_id FROM embeddings e, (SELECT unnest([0, 1]) AS k))
    SELECT pos, w.vec_id, round(e.embedding[1]::DOUBLE, 6) AS first, round(e.embedding[64]::DOUBLE, 6) AS last FROM w LEFT JOIN embeddings e USING (vec_id)""",
)
def vector_gather(spark, sf_dir):
    """Two ids for each row, known or not, in order; places are given out by ranges."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    w = e.select(F.col("vec_id").alias("v"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    w = intern(w.withColumn("at", F.struct("v", "k")), ["v", "k"], "at").select(F.col("db_idx").alias("pos"), (F.col("v") * 7 + F.col("k") * 13).alias("vec_id"))
    g = R.gather(e, w)
    return g.select("pos", "vec_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"), F.round(F.get("embedding", F.lit(63)).cast("double"), 6).alias("last"))


@query(
    "vector_pages",
    "SELECT (vec_id // 128)::INTEGER AS page, count(*) AS n, min(vec_id) AS first, max(vec_id) AS last FROM embeddings GROUP BY ALL",
)
def vector_pages(spark, sf_dir):
    return R.pages(table(spark, sf_dir, "embeddings"), "vec_id", 128).groupBy("page").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last"))


@query(
    "rerank_two_stage",
    f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, b.label, round({DOT}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s),
    t AS (SELECT *, (label * 37 + vec_id * 11) % 101 AS rs FROM r WHERE rank <= 10)
    SELECT query_id, rank::INTEGER AS rank, vec_id, rs::DOUBLE AS rerank_score, (row_number() OVER (PARTITION BY query_id ORDER BY rs DESC, vec_id))::INTEGER AS rerank FROM t""",
)
def rerank_two_stage(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    ranks = R.dense_topk(e, e.where("vec_id % 50 = 0"), k=10).join(e.select("vec_id", "label"), "vec_id")
    score = ((F.col("label") * 37 + F.col("vec_id") * 11) % 101).cast("double")
    return R.rerank(ranks, ["query_id"], "vec_id", score, 10).select("query_id", "rank", "vec_id", "rerank_score", "rerank")


@query("linear_map_scores")
def linear_map_scores(spark, sf_dir):
    """The map from premises to the contexts that used them (here a vector's successor of its label), by label, and
    the score of every mapped premise for the label's query, its vector with the largest id."""
    e = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL AND label IS NOT NULL").select("vec_id", F.col("label").cast("long").alias("group"), "embedding")
    place = numbered(e.select("group", "vec_id"), ["group"], ["vec_id"], "nth")
    at = e.join(place, ["group", "vec_id"])
    after = at.select("group", (F.col("nth") - 1).alias("nth"), F.col("embedding").alias("g"))  # the successor by its place, so that no label is one task
    maps = dense.linear_maps(at.join(after, ["group", "nth"]).select("group", F.col("embedding").alias("p"), "g"))
    asked = e.groupBy("group").agg(F.max_by("embedding", "vec_id").alias("q"))
    v = maps.join(asked, "group").select("group", F.transform("map", lambda row: R.dot(row, F.col("q"))).alias("v"))  # one row per label
    return e.join(v, "group").select("vec_id", F.col("group").cast("int").alias("label"), F.round(R.dot(F.col("embedding"), F.col("v")), 6).alias("score"))
