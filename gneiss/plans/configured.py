"""Queries built from configurations, and results read from pickles."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.configuration import build
from gneiss.operators import corpus as C
from gneiss.plans import retrieval  # noqa: F401  has the oracle of bm25_topk
from gneiss.registry import ORACLES, query, table
from gneiss.sources.pickles import pickled, unpickled

SEARCH = {"alias": "filtered", "filter": {"alias": "every", "filters": [{"alias": "proj"}, {"alias": "premise", "general_excludes": ["DEFINITION", "OTHER"]}]}, "ranker": {"alias": "bm25", "k": 20}}
PASSES = "(SELECT * FROM documents WHERE source NOT IN ('src0', 'src1') AND doc_id % 2 = 0)"


@query("configured_search", ORACLES["bm25_topk"].replace("FROM documents", f"FROM {PASSES} AS passed"))
def configured_search(spark, sf_dir):
    """BM25 over what a filter of a filter and a list of kinds lets through, all of it named in a configuration."""
    kind = F.get(F.array(*map(F.lit, ("LEMMA", "DEFINITION", "THEOREM", "OTHER"))), (F.col("doc_id") % 4).cast("int"))
    path = F.when(F.col("source").isin("src0", "src1"), F.lit(f"{C.LIBRARY}/a.v")).otherwise(F.col("source"))
    docs = table(spark, sf_dir, "documents").where("source IS NOT NULL").select("doc_id", "text", kind.alias("kind"), path.alias("path"))
    return build("search", SEARCH)(docs, table(spark, sf_dir, "benchmark"))


@query(
    "configured_split",
    """WITH f AS (SELECT DISTINCT source || '-' || (doc_id % 97) AS file FROM documents WHERE source IS NOT NULL), r AS (SELECT file, row_number() OVER (ORDER BY md5('7:' || file)) AS n, count(*) OVER () AS many FROM f)
    SELECT file, CASE WHEN n <= floor(many * 0.5) THEN 'train' WHEN n <= floor(many * 0.5) + floor(many * 0.25) THEN 'val' ELSE 'test' END AS split FROM r""",
)
def configured_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("source IS NOT NULL")
    files = d.select(F.concat_ws("-", "source", F.col("doc_id") % 97).alias("file"))
    return build("split", {"alias": "proportional", "train": 0.5, "val": 0.25, "seed": 7})(files)


@query(
    "pickled_results",
    """WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations WHERE text IS NOT NULL), h AS (SELECT conv_id, turn, unnest(w) AS word, generate_subscripts(w, 1) AS rank FROM w)
    SELECT conv_id AS proof, turn AS step_idx, rank::INTEGER AS hit FROM h WHERE contains(word, 'th')""",
)
def pickled_results(spark, sf_dir):
    """Results of steps as pickles, read back without what pickles can run: one row a hit."""
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    hits = F.filter(F.transform(F.split("text", " ", -1), lambda w, i: F.when(w.contains("th"), i + 1)), lambda i: i.isNotNull())
    step = F.struct(F.col("turn").alias("step_idx"), hits.alias("hits_on"))
    files = c.select(pickled(F.to_json(F.struct(F.col("conv_id").alias("proof"), F.array(step).alias("step_results")))).alias("content"))
    value = F.from_json(unpickled(F.col("content"))["value"], "proof long, step_results array<struct<step_idx: long, hits_on: array<int>>>")
    steps = files.select(value.alias("v")).select("v.proof", F.inline("v.step_results"))
    return steps.select("proof", "step_idx", F.explode("hits_on").alias("hit"))
