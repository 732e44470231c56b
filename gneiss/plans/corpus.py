"""Queries of interning, deduplication, availability and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.functions import text as T
from gneiss.operators import corpus as C
from gneiss.operators.ranges import running
from gneiss.registry import query, table


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(
    "intern_sentences",
    """WITH f AS (SELECT text, lang, min(doc_id) AS first FROM documents GROUP BY ALL)
    SELECT md5(text) AS text_md5, lang, row_number() OVER (ORDER BY first, text, lang) AS db_idx FROM f""",
)
def intern_sentences(spark, sf_dir):
    return C.intern(docs(spark, sf_dir), ["text", "lang"], "doc_id").select(F.md5("text").alias("text_md5"), "lang", "db_idx")


@query(
    "sentence_lookup",
    "SELECT d.doc_id, d.lang, d.source FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
)
def sentence_lookup(spark, sf_dir):
    ids = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    return docs(spark, sf_dir).join(ids, "doc_id", "left_semi").select("doc_id", "lang", "source")


@query("sentence_lookup_by_value", "SELECT a.doc_id, min(b.doc_id) AS first_id, count(*) AS n FROM documents a JOIN documents b ON a.text = b.text AND a.lang = b.lang GROUP BY ALL")
def sentence_lookup_by_value(spark, sf_dir):
    d = docs(spark, sf_dir)
    one = d.groupBy("text", "lang").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    return d.join(one, ["text", "lang"]).select("doc_id", "first_id", "n")


@query("dedup_exact", "SELECT md5(text) AS text_md5, count(*) AS copies FROM documents GROUP BY text")
def dedup_exact(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("text").agg(F.count("*").alias("copies")).select(F.md5("text").alias("text_md5"), "copies")


@query("dedup_keep_first", "SELECT min(doc_id) AS doc_id, source FROM documents GROUP BY source, trim(text)")
def dedup_keep_first(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("t", F.trim("text"))
    return C.keep_first(d.select("doc_id", "source", "t"), ["source", "t"], ["doc_id"]).select("doc_id", "source")


@query("dup_counts", "SELECT source, count(*) AS n, count(DISTINCT text) AS n_distinct, count(*) - count(DISTINCT text) AS duplicates FROM documents GROUP BY source")
def dup_counts(spark, sf_dir):
    g = docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("text").alias("n_distinct"))
    return g.withColumn("duplicates", F.col("n") - F.col("n_distinct"))


@query(
    "premise_filter",
    """SELECT doc_id, CASE WHEN source IN ('src0', 'src1', 'src2') THEN NOT lang IN ('en', 'fr') ELSE NOT lang IN ('de') END AS kept
    FROM documents WHERE lang <> 'es'""",
)
def premise_filter(spark, sf_dir):
    d = docs(spark, sf_dir)
    inside = F.col("source").isin("src0", "src1", "src2")
    general = C.premise_filter(F.col("lang"), F.col("source"), (), (), ("es",), inside)
    own = C.premise_filter(F.col("lang"), F.col("source"), ("en", "fr"), ("de",), (), inside)
    return d.where(general).select("doc_id", own.alias("kept"))


@query(
    "in_out_file_partition",
    """WITH p AS (SELECT DISTINCT 'a/' || source || '.v' AS path, text FROM documents),
    f AS (SELECT DISTINCT '../' || source || '.v' AS file FROM documents)
    SELECT file, count(*) FILTER (WHERE ends_with(path, substr(file, 4))) AS in_file, count(*) FILTER (WHERE NOT ends_with(path, substr(file, 4))) AS out_of_file FROM f CROSS JOIN p GROUP BY ALL""",
)
def in_out_file_partition(spark, sf_dir):
    """Counts per file: paths are matched once per distinct pair of paths, premises are counted per path before."""
    d = docs(spark, sf_dir)
    p = d.select(F.concat(F.lit("a/"), "source", F.lit(".v")).alias("path"), "text").distinct().groupBy("path").agg(F.count("*").alias("n"))
    f = d.select(F.concat(F.lit("../"), "source", F.lit(".v")).alias("file")).distinct()
    same = T.same_file(F.col("path"), F.col("file"))
    own = f.join(p.withColumn("end", F.element_at(F.split("path", "/", -1), -1)), F.element_at(F.split("file", "/", -1), -1) == F.col("end")).where(same).groupBy("file").agg(F.sum("n").alias("in_file"))
    total = p.agg(F.sum("n").alias("total"))
    return f.join(own, "file", "left").crossJoin(F.broadcast(total)).select("file", F.coalesce("in_file", F.lit(0)).alias("in_file"), (F.col("total") - F.coalesce("in_file", F.lit(0))).alias("out_of_file"))


@query(
    "visible_counts",
    "SELECT a.doc_id, count(b.doc_id) AS n_visible FROM documents a LEFT JOIN documents b ON a.source = b.source AND b.doc_id < a.doc_id GROUP BY a.doc_id",
)
def visible_counts(spark, sf_dir):
    """Earlier premises of the file, counted as a running sum instead of a self-join."""
    d = running(docs(spark, sf_dir).select("doc_id", "source"), ["source"], ["doc_id"], {"n_visible": F.lit(1).cast("long")}, "before")
    return d.select("doc_id", F.when(F.col("source").isNull(), 0).otherwise(F.col("n_visible")).alias("n_visible"))


@query(
    "dependency_edges",
    """WITH p AS (SELECT source AS file, 'repos/' || source || '/' || lang || '.v' AS path, doc_id AS pos FROM documents),
    n AS (SELECT file, replace(regexp_extract(path, 'repos/(.*\\.v)', 1), '/', '-') AS dep, pos FROM p)
    SELECT file, dep, min(pos) AS first_pos FROM n WHERE NOT contains(dep, file || '-e') AND NOT contains(file || '-e', dep) GROUP BY ALL""",
)
def dependency_edges(spark, sf_dir):
    path = F.concat(F.lit("repos/"), "source", F.lit("/"), "lang", F.lit(".v"))
    n = docs(spark, sf_dir).select(F.col("source").alias("file"), T.data_point_name(path).alias("dep"), F.col("doc_id").alias("pos"))
    own = F.concat("file", F.lit("-e"))
    return n.where(~F.col("dep").contains(own) & ~own.contains(F.col("dep"))).groupBy("file", "dep").agg(F.min("pos").alias("first_pos"))



SPLIT = """
WITH f AS (SELECT DISTINCT source || '-' || lang AS file, source, text FROM documents),
t AS (SELECT * FROM f WHERE source IN ('src0', 'src1')),
v0 AS (SELECT * FROM f WHERE source IN ('src2', 'src3')),
v AS (SELECT * FROM v0 WHERE file NOT IN (SELECT file FROM v0 WHERE text IN (SELECT text FROM t))),
r0 AS (SELECT * FROM f WHERE source NOT IN ('src0', 'src1', 'src2', 'src3')),
r AS (SELECT * FROM r0 WHERE file NOT IN (SELECT file FROM r0 WHERE text IN (SELECT text FROM t UNION ALL SELECT text FROM v))),
s AS (SELECT DISTINCT file, 'test' AS split FROM t UNION ALL SELECT DISTINCT file, 'val' FROM v UNION ALL SELECT DISTINCT file, 'train' FROM r)
"""


def predefined(spark, sf_dir):
    f = docs(spark, sf_dir).select(F.concat_ws("-", "source", "lang").alias("file"), "source", "text")
    return C.leakage_safe_split(f, F.col("source").isin("src0", "src1"), F.col("source").isin("src2", "src3"))


@query("split_predefined", SPLIT + "SELECT * FROM s")
def split_predefined(spark, sf_dir):
    return predefined(spark, sf_dir)


@query(
    "split_leak_check",
    SPLIT + "SELECT a.split AS split_a, b.split AS split_b, count(DISTINCT d.text) AS shared FROM s a JOIN documents d ON a.file = d.source || '-' || d.lang JOIN documents e ON d.text = e.text JOIN s b ON b.file = e.source || '-' || e.lang WHERE a.split < b.split GROUP BY ALL",
)
def split_leak_check(spark, sf_dir):
    """Texts that two splits share; no rows are expected."""
    d = docs(spark, sf_dir).select(F.concat_ws("-", "source", "lang").alias("file"), "text").join(predefined(spark, sf_dir), "file").select("text", "split").distinct()
    o = d.select("text", F.col("split").alias("split_b"))
    return d.withColumnRenamed("split", "split_a").join(o, "text").where("split_a < split_b").groupBy("split_a", "split_b").agg(F.count("*").alias("shared"))


@query(
    "split_random",
    """WITH f AS (SELECT DISTINCT source || '-' || lang AS file FROM documents),
    r AS (SELECT file, row_number() OVER (ORDER BY md5('0:' || file)) AS i, (SELECT count(*) FROM f) AS n FROM f)
    SELECT file, CASE WHEN i <= floor(n * 0.8) THEN 'train' WHEN i <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM r""",
)
def split_random(spark, sf_dir):
    return C.proportional_split(docs(spark, sf_dir).select(F.concat_ws("-", "source", "lang").alias("file")), "file", 0.8, 0.1)


@query("split_test_only", "SELECT DISTINCT source || '-' || lang AS file, 'test' AS split FROM documents WHERE source IN ('src4', 'src5')")
def split_test_only(spark, sf_dir):
    return docs(spark, sf_dir).where(F.col("source").isin("src4", "src5")).select(F.concat_ws("-", "source", "lang").alias("file"), F.lit("test").alias("split")).distinct()


@query(
    "split_lookup",
    SPLIT + "SELECT d.doc_id, coalesce(s.split, 'none') AS split FROM documents d LEFT JOIN s ON s.file = d.source || '-' || d.lang",
)
def split_lookup(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.concat_ws("-", "source", "lang").alias("file"))
    return d.join(predefined(spark, sf_dir), "file", "left").select("doc_id", F.coalesce("split", F.lit("none")).alias("split"))


@query(
    "shuffled_step_index",
    """SELECT row_number() OVER (ORDER BY role, md5('idx:' || conv_id || ':' || turn), conv_id, turn) AS pos, role, conv_id, turn FROM conversations""",
)
def shuffled_step_index(spark, sf_dir):
    """Steps of each role in shuffled order, one index over all; places are given out by ranges."""
    key = C.hash_order("idx", F.col("conv_id"), F.col("turn"))
    c = table(spark, sf_dir, "conversations").select("role", "conv_id", "turn", F.struct("role", key, "conv_id", "turn").alias("k"))
    return C.intern(c, ["role", "conv_id", "turn"], "k").select(F.col("db_idx").alias("pos"), "role", "conv_id", "turn")


@query(
    "sample_failures",
    """WITH f AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('s:' || event_id)) AS r FROM events WHERE value >= 50)
    SELECT event_type, event_id FROM f WHERE r <= 12""",
)
def sample_failures(spark, sf_dir):
    f = table(spark, sf_dir, "events").where("value >= 50")
    return C.sample_per_group(f, ["event_type"], C.hash_order("s", F.col("event_id")), 12).select("event_type", "event_id")


@query(
    "theorem_lines",
    "SELECT source, string_agg(doc_id, ',' ORDER BY doc_id) AS lines, count(*) AS n FROM documents GROUP BY source",
)
def theorem_lines(spark, sf_dir):
    lines = F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), ",")
    return docs(spark, sf_dir).groupBy("source").agg(lines.alias("lines"), F.count("*").alias("n"))


@query(
    "file_theorem_index",
    "SELECT source || '-' || lang AS file, count(DISTINCT text) AS n_theorems, count(DISTINCT text) FILTER (WHERE n_chars > 500) AS n_long FROM documents GROUP BY ALL",
)
def file_theorem_index(spark, sf_dir):
    return docs(spark, sf_dir).groupBy(F.concat_ws("-", "source", "lang").alias("file")).agg(F.count_distinct("text").alias("n_theorems"), F.count_distinct(F.when(F.col("n_chars") > 500, F.col("text"))).alias("n_long"))


@query("missing_outputs", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_outputs(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("unique_files", "SELECT DISTINCT source, lang FROM documents")
def unique_files(spark, sf_dir):
    return docs(spark, sf_dir).select("source", "lang").distinct()


@query("union_keep_first", "SELECT doc_id, min(o) AS origin FROM (SELECT doc_id, 1 AS o FROM labels UNION ALL SELECT doc_id, 2 FROM documents) GROUP BY doc_id")
def union_keep_first(spark, sf_dir):
    a = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("origin"))
    b = docs(spark, sf_dir).select("doc_id", F.lit(2).alias("origin"))
    return C.keep_first(a.unionByName(b), ["doc_id"], ["origin"])


@query(
    "oracle_purity_mix",
    """WITH l AS (SELECT d.source, d.doc_id, coalesce(l.quality, 0) = 1 AS good FROM documents d LEFT JOIN labels l USING (doc_id)),
    n AS (SELECT source, floor(count(*) / 0.4) - count(*) AS n FROM l WHERE good GROUP BY ALL),
    g AS (SELECT l.*, row_number() OVER (PARTITION BY source ORDER BY md5('purity:' || source || ':' || doc_id)) AS r FROM l WHERE NOT good)
    SELECT source, doc_id, true AS positive FROM l WHERE good UNION ALL SELECT source, doc_id, false FROM g JOIN n USING (source) WHERE r <= n""",
)
def oracle_purity_mix(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    d = docs(spark, sf_dir).select("source", "doc_id")
    return C.purity_mix(d.join(good, "doc_id", "left_semi"), d.join(good, "doc_id", "left_anti"), "source", "doc_id", 0.4)
