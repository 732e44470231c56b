"""Queries of filters, lookups and combinations that the other modules do not show."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gneiss.functions import models as M
from gneiss.functions import text as T
from gneiss.operators import corpus as C
from gneiss.operators import steps as S
from gneiss.registry import choose, query, table


@query("admitted_drop", "SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) > 0 AND NOT regexp_matches(arg_max(text, turn), '(he|en)\\.$')")
def admitted_drop(spark, sf_dir):
    """Proofs whose last step ends in a forbidden way are left out."""
    last = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("last"))
    return last.where(~F.col("last").rlike(r"(he|en)\.$")).select("conv_id")


@query("theorem_texts", "SELECT source, count(DISTINCT text) AS n FROM documents WHERE lang <> 'es' GROUP BY source")
def theorem_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("lang != 'es'").groupBy("source").agg(F.count_distinct("text").alias("n"))


@query("project_filter", "SELECT doc_id FROM documents WHERE split_part(source || '/' || lang, '/', 1) IN ('src1', 'src7')")
def project_filter(spark, sf_dir):
    first = F.split_part(F.concat_ws("/", "source", "lang"), F.lit("/"), F.lit(1))
    return table(spark, sf_dir, "documents").where(first.isin("src1", "src7")).select("doc_id")


@query("restrict_to_keys", "SELECT event_type, min(event_id) AS event_id, user_id FROM events WHERE user_id IN (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system') GROUP BY event_type, user_id")
def restrict_to_keys(spark, sf_dir):
    keys = table(spark, sf_dir, "conversations").where("role = 'system'").select(F.col("conv_id").alias("user_id")).distinct()
    e = C.keep_first(table(spark, sf_dir, "events").select("event_type", "event_id", "user_id"), ["event_type", "user_id"], ["event_id"])
    return e.join(keys, "user_id", "left_semi").select("event_type", "event_id", "user_id")


@query("find_proof_by_name", "SELECT arg_min(doc_id, doc_id) AS doc_id, count(*) AS n FROM documents WHERE contains(text, 'ing') AND source = 'src1'")
def find_proof_by_name(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.col("text").contains("ing") & (F.col("source") == "src1"))
    return d.agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query(
    "shorter_than_other",
    """WITH n AS (SELECT conv_id, sum(length(text)) AS n FROM conversations GROUP BY ALL), p AS (SELECT a.conv_id, a.n AS mine, b.n AS other FROM n a JOIN n b ON b.conv_id = a.conv_id + 1 WHERE a.n < b.n),
    r AS (SELECT *, row_number() OVER (ORDER BY md5('pairs:' || conv_id)) AS r FROM p) SELECT conv_id, mine::BIGINT AS mine, other::BIGINT AS other FROM r WHERE r <= 20""",
)
def shorter_than_other(spark, sf_dir):
    """A sample of 20 pairs: the size of the sample is the feature."""
    n = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("mine"))
    p = n.join(n.select((F.col("conv_id") - 1).alias("conv_id"), F.col("mine").alias("other")), "conv_id").where("mine < other")
    return p.orderBy(C.hash_order("pairs", F.col("conv_id"))).limit(20)


@query("complete_rows", "SELECT user_id FROM events WHERE value < 80 GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def complete_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    wide = e.where("value < 80").groupBy("user_id").pivot("event_type", [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]).agg(F.first("value"))
    return wide.dropna().select("user_id")


@query("cache_join", "SELECT d.doc_id, coalesce(l.quality, d.n_chars % 2)::BIGINT AS value, l.quality IS NOT NULL AS cached FROM documents d LEFT JOIN labels l USING (doc_id)")
def cache_join(spark, sf_dir):
    """What was worked out before is taken, the rest is worked out now."""
    cached = table(spark, sf_dir, "labels").select("doc_id", "quality")
    j = table(spark, sf_dir, "documents").join(cached, "doc_id", "left")
    return j.select("doc_id", F.coalesce(F.col("quality").cast("long"), F.col("n_chars") % 2).alias("value"), F.col("quality").isNotNull().alias("cached"))


@query("keys_in_range", "SELECT DISTINCT source, lang FROM documents WHERE n_chars BETWEEN 500 AND 900")
def keys_in_range(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("n_chars").between(500, 900)).select("source", "lang").distinct()


@query("union_labelled", "SELECT 'all' AS label, lang, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'long', lang, count(*) FROM documents WHERE n_chars > 2000 GROUP BY ALL")
def union_labelled(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    count = lambda x, name: x.groupBy("lang").agg(F.count("*").alias("n")).select(F.lit(name).alias("label"), "lang", "n")
    return count(d, "all").unionByName(count(d.where("n_chars > 2000"), "long"))


@query("search_attempts", "SELECT event_type, sum(coalesce((props->>'$.k')::BIGINT, 1))::BIGINT AS attempts, count(*) AS n FROM events WHERE value < 50 GROUP BY event_type")
def search_attempts(spark, sf_dir):
    """Attempts of successful searches: as counted, or one where no count is there."""
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(1))
    return table(spark, sf_dir, "events").where("value < 50").groupBy("event_type").agg(F.sum(k).alias("attempts"), F.count("*").alias("n"))


@query("minimum_loss", "SELECT min(value) FILTER (WHERE event_id % 2 = 0) AS train, min(value) FILTER (WHERE event_id % 2 = 1) AS eval FROM events")
def minimum_loss(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.agg(F.min(F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("train"), F.min(F.when(F.col("event_id") % 2 == 1, F.col("value"))).alias("eval"))


@query("stored_result_first_match", "SELECT doc_id, arg_min(v, o) AS v FROM (SELECT doc_id, 1 AS o, 'label' || quality AS v FROM labels UNION ALL SELECT doc_id, 2, 'lang' || lang FROM documents WHERE doc_id % 2 = 0) GROUP BY doc_id")
def stored_result_first_match(spark, sf_dir):
    a = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("o"), F.concat(F.lit("label"), F.col("quality").cast("string")).alias("v"))
    b = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select("doc_id", F.lit(2).alias("o"), F.concat(F.lit("lang"), "lang").alias("v"))
    return a.unionByName(b).groupBy("doc_id").agg(F.min_by("v", "o").alias("v"))


@query("common_records", "SELECT source || '/' || lang AS file, trim(regexp_replace(text, '\\s+', ' ', 'g')) = text AS plain, doc_id % 3 <> 1 AS success, CASE WHEN doc_id % 3 = 0 THEN n_chars / 10.0 WHEN doc_id % 3 = 2 THEN n_chars / 20.0 END AS time FROM documents")
def common_records(spark, sf_dir):
    """Three systems with records of their own as one: a time in tenths, no time for a failure, a time in twentieths."""
    d = table(spark, sf_dir, "documents")
    plain = (T.normalize_ws(F.col("text")) == F.col("text")).alias("plain")
    file = F.concat_ws("/", "source", "lang").alias("file")
    a = d.where("doc_id % 3 = 0").select(file, plain, F.lit(True).alias("success"), (F.col("n_chars") / 10.0).cast("double").alias("time"))
    b = d.where("doc_id % 3 = 1").select(file, plain, F.lit(False).alias("success"), F.lit(None).cast("double").alias("time"))
    c = d.where("doc_id % 3 = 2").select(file, plain, F.lit(True).alias("success"), (F.col("n_chars") / 20.0).cast("double").alias("time"))
    return a.unionByName(b).unionByName(c)


@query("steps_in_order", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS step, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations")
def steps_in_order(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(w).cast("long").alias("step"), F.lead("turn").over(w).alias("after"))


@query("external_shuffle", "SELECT doc_id, text, row_number() OVER (ORDER BY md5('shuffle:' || doc_id), doc_id) AS pos FROM documents")
def external_shuffle(spark, sf_dir):
    """All rows with their place in an order drawn from a hash: places are given out by ranges, whose sort spills."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    place = C.intern(d.select("doc_id", F.struct(C.hash_order("shuffle", F.col("doc_id")), "doc_id").alias("k")), ["doc_id"], "k")
    return d.join(place.withColumnRenamed("db_idx", "pos"), "doc_id")


@query("hash_encoder", "SELECT doc_id AS id, upper(sha256(text)) AS bytes FROM documents")
def hash_encoder(spark, sf_dir):
    """The stand-in encoder's vectors, written as the bytes they are made of."""
    e = M.encode(table(spark, sf_dir, "documents"), "text", choose("encoder", "hash"), "doc_id")
    return e.select("id", F.array_join(F.transform("emb", lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), "").alias("bytes"))


@query("whole_proof_length", "SELECT conv_id, sum(length(text))::BIGINT AS n FROM conversations GROUP BY conv_id")
def whole_proof_length(spark, sf_dir):
    return S.whole_text(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text").select("conv_id", F.length("proof_text").cast("long").alias("n"))
