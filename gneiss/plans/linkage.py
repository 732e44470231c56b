"""Queries of record linkage and positions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gneiss.functions import text as T
from gneiss.operators import linkage as L
from gneiss.registry import query, table

FOUND = """
f AS (SELECT doc_id, regexp_extract(text, '\\S+') AS needle, string_split(text, chr(10)) AS t FROM documents),
l AS (SELECT doc_id, needle, unnest(t) AS line, generate_subscripts(t, 1) - 1 AS n FROM f WHERE needle <> ''),
s AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM l),
o AS (SELECT doc_id, needle, line, n, base, unnest(range(0, length(line))) AS col FROM s),
h AS (SELECT doc_id, base + col AS spot, n, col FROM o WHERE substr(line, col + 1, length(needle)) = needle)
"""


def found(spark, sf_dir):
    """Every place in its document where the document's first word stands."""
    f = table(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_extract("text", r"\S+", 0).alias("needle"))
    return L.found_in(f, f, "doc_id", "text", "needle")


@query("occurrence_linkage", f"WITH {FOUND} SELECT doc_id, count(*) AS n, min(spot)::INTEGER AS first, max(spot)::INTEGER AS last FROM h GROUP BY doc_id")
def occurrence_linkage(spark, sf_dir):
    return found(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("spot").alias("first"), F.max("spot").alias("last"))


@query(
    "offset_to_pos",
    f"WITH {FOUND} SELECT doc_id, spot::INTEGER AS spot, n::INTEGER AS line, col::INTEGER AS col FROM h WHERE spot > 0",
)
def offset_to_pos(spark, sf_dir):
    return found(spark, sf_dir).where("spot > 0").select("doc_id", "spot", "line", F.col("column").alias("col"))


@query(
    "text_slice",
    "WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, md5(CASE WHEN len(l) > 2 THEN substr(l[1], 4) || chr(10) || l[2] || chr(10) || substr(l[3], 1, 5) ELSE substr(l[1], 4, 7) END) AS slice_md5 FROM d",
)
def text_slice(spark, sf_dir):
    t = F.col("text")
    many = F.size(F.split(t, "\n", -1)) > 2
    s = T.text_between(t, F.lit(0), F.lit(3), F.when(many, 2).otherwise(0), F.when(many, 5).otherwise(10))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(s).alias("slice_md5"))


@query(
    "interval_overlap",
    """WITH a AS (SELECT event_id AS a_id, user_id, (event_id * 37) % 5000 AS a_start, (event_id * 37) % 5000 + 40 + event_id % 30 AS a_end FROM events WHERE event_id % 2 = 0),
    b AS (SELECT event_id AS b_id, user_id, (event_id * 53) % 5000 AS b_start, (event_id * 53) % 5000 + 25 + event_id % 50 AS b_end FROM events WHERE event_id % 2 = 1)
    SELECT a_id, b_id FROM a JOIN b USING (user_id) WHERE a_start < b_end AND b_start < a_end""",
)
def interval_overlap(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    a = e.where("event_id % 2 = 0").select(i.alias("a_id"), "user_id", (i * 37 % 5000).alias("a_start"), (i * 37 % 5000 + 40 + i % 30).alias("a_end"))
    b = e.where("event_id % 2 = 1").select(i.alias("b_id"), "user_id", (i * 53 % 5000).alias("b_start"), (i * 53 % 5000 + 25 + i % 50).alias("b_end"))
    return L.overlap(a, b, ["user_id"], 128).select("a_id", "b_id")


RECORDS = """
r0 AS (SELECT doc_id, unnest(string_split(text, '. ')) AS s, generate_subscripts(string_split(text, '. '), 1) - 1 AS pos FROM documents),
r AS (SELECT CASE WHEN pos % 7 = 6 THEN doc_id + 1 ELSE doc_id END AS file, doc_id * 1000000 + pos AS record, regexp_extract(s, '\\S+') AS statement FROM r0),
l AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
k AS (SELECT DISTINCT file, statement FROM r WHERE statement <> ''),
o AS (SELECT file, statement, n, line, unnest(range(0, length(line))) AS col FROM l JOIN k USING (file) WHERE contains(line, statement)),
h AS (SELECT file, statement, n, col FROM o WHERE substr(line, col + 1, length(statement)) = statement),
m AS (SELECT file, statement, n, col, file * 1000000 + n AS theorem FROM h WHERE n % 3 <> 1),
c AS (SELECT file, statement, count(*) AS n, list(theorem ORDER BY n, col) AS t FROM m GROUP BY ALL),
p AS (SELECT a.file, a.record, count(*) AS same, count(*) FILTER (WHERE b.record < a.record) AS nth FROM r a JOIN r b ON a.file = b.file AND (contains(a.statement, b.statement) OR contains(b.statement, a.statement)) GROUP BY ALL),
j AS (SELECT r.*, c.n, c.t, p.nth, p.same - (length(statement) = 2)::INT AS same, nth - (length(statement) = 2 AND nth > 0)::INT AS own,
    CASE WHEN d.doc_id IS NULL THEN 'file missing' WHEN f.file IS NULL THEN 'theorem missing' WHEN c.n IS NULL THEN 'theorem mismatch' WHEN c.n = 1 THEN 'linked'
    WHEN length(statement) = 2 AND nth = 0 THEN 'bad theorem' WHEN p.same - (length(statement) = 2)::INT <> c.n THEN 'ambiguous' ELSE 'linked' END AS mode
    FROM r LEFT JOIN (SELECT DISTINCT doc_id FROM documents) d ON d.doc_id = r.file LEFT JOIN (SELECT DISTINCT file, statement FROM h) f USING (file, statement) LEFT JOIN c USING (file, statement) LEFT JOIN p USING (file, record))
"""


def records(spark, sf_dir):
    """The first word of each sentence as a record of its document; each seventh sentence is asked of the next one."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", r"\. ", -1)).alias("pos", "s"))
    file = F.when(F.col("pos") % 7 == 6, F.col("doc_id") + 1).otherwise(F.col("doc_id"))
    return d.select(file.alias("file"), (F.col("doc_id") * 1000000 + F.col("pos")).alias("record"), F.regexp_extract("s", r"\S+", 0).alias("statement"))


def linked(spark, sf_dir):
    """Records linked to theorems: the lines of a document but each third; of records of two letters the first is bad."""
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), "text")
    lines = files.select("file", F.posexplode(F.split("text", "\n", -1)).alias("line", "s")).where("line % 3 != 1")
    theorems = lines.select("file", (F.col("file") * 1000000 + F.col("line")).alias("theorem"), "line", F.lit(0).alias("column"), F.col("line").alias("end_line"), F.length("s").alias("end_column"))
    asked = records(spark, sf_dir)
    bad = asked.where(F.length("statement") == 2).select("file", "statement", F.lit(0).alias("nth")).distinct()
    return L.link(asked, files, theorems, bad)


@query("record_linkage", f"WITH {RECORDS} SELECT file, record, mode, CASE WHEN mode = 'linked' THEN CASE WHEN n = 1 THEN t[1] ELSE t[own + 1] END END AS theorem FROM j")
def record_linkage(spark, sf_dir):
    return linked(spark, sf_dir)


@query("linkage_modes", f"WITH {RECORDS} SELECT mode, count(*) AS records FROM j GROUP BY mode")
def linkage_modes(spark, sf_dir):
    return linked(spark, sf_dir).groupBy("mode").agg(F.count("*").alias("records"))


@query("project_rename", "SELECT doc_id, CASE source WHEN 'src1' THEN 'alpha' WHEN 'src2' THEN 'beta' ELSE source END AS project FROM documents")
def project_rename(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", L.renamed(F.col("source"), {"src1": "alpha", "src2": "beta"}).alias("project"))


@query(
    "inter_file_indices",
    "SELECT doc_id AS idx FROM documents WHERE source || '-' || lang IN (SELECT DISTINCT source || '-' || lang FROM documents WHERE source IN ('src0', 'src1') AND lang <> 'en')",
)
def inter_file_indices(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.concat_ws("-", "source", "lang").alias("file"))
    return d.join(d.where("source IN ('src0', 'src1') AND lang != 'en'").select("file").distinct(), "file", "left_semi").select(F.col("doc_id").alias("idx"))


@query(
    "workspace_of_path",
    """WITH p AS (SELECT page_id, regexp_replace(url, '^https?://|[?#].*$', '', 'g') AS path FROM pages), w AS (SELECT folder, row_number() OVER (ORDER BY length(folder), folder) AS pos FROM (SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS folder FROM p WHERE page_id % 3 = 0)),
    j AS (SELECT page_id, folder, row_number() OVER (PARTITION BY page_id ORDER BY pos, folder) AS n FROM p JOIN w ON path = folder OR starts_with(path, folder || '/'))
    SELECT page_id, folder FROM j WHERE n = 1""",
)
def workspace_of_path(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"^https?://|[?#].*$", "").alias("path"))
    w = p.where("page_id % 3 = 0").select(F.concat_ws("/", F.split_part("path", F.lit("/"), F.lit(1)), F.split_part("path", F.lit("/"), F.lit(2))).alias("folder")).distinct()
    w = w.withColumn("pos", F.struct(F.length("folder"), "folder"))
    one = L.first_ancestor(p.select("path").distinct(), w, "path", "folder", "pos").select("path", "folder")
    return p.join(one, "path").select("page_id", "folder")


@query(
    "fuzzy_same_theorem",
    """WITH d AS (SELECT doc_id, source, regexp_extract(text, '\\S+(\\s+\\S+)?') AS t FROM documents WHERE source IS NOT NULL AND text IS NOT NULL) SELECT a.doc_id, count(*)::INTEGER AS n_same, (count(*) FILTER (WHERE b.doc_id < a.doc_id))::INTEGER AS ordinal FROM d a JOIN d b ON a.source = b.source AND (contains(a.t, b.t) OR contains(b.t, a.t)) GROUP BY a.doc_id""",
)
def fuzzy_same_theorem(spark, sf_dir):
    """Theorems of a file are the same if the name of one (the first two words here) holds the other's."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.regexp_extract("text", r"\S+(\s+\S+)?", 0).alias("t"))
    return L.same_names(d, "source", "t", "doc_id").select("doc_id", F.col("n_same").cast("int").alias("n_same"), F.col("nth").cast("int").alias("ordinal"))


@query(
    "theorem_steps",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
    c AS (SELECT doc_id, line, unnest(string_split(s, '. ')) AS s, generate_subscripts(string_split(s, '. '), 1) - 1 AS pos FROM l),
    st AS (SELECT doc_id AS file, line, line * 10000 + pos AS step, trim(regexp_replace(s, '\\s+', ' ', 'g')) AS s FROM c),
    t AS (SELECT doc_id AS file, line * 10000 + pos AS theorem, line + (doc_id % 7 = 0)::INT AS line, regexp_extract(s, '\\S+') AS said FROM c WHERE pos = 1)
    SELECT t.file, t.theorem, min(step) AS step FROM t LEFT JOIN st ON st.file = t.file AND st.line = t.line AND contains(st.s, said) GROUP BY ALL""",
)
def theorem_steps(spark, sf_dir):
    """Sentences are steps; the first word of each line's second one is looked for on its line, or on the next."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n", -1)).alias("line", "s"))
    steps = lines.select("file", "line", F.posexplode(F.split("s", r"\. ", -1)).alias("pos", "text")).withColumn("step", F.col("line").cast("long") * 10000 + F.col("pos"))
    late = (F.col("file") % 7 == 0).cast("int")
    theorems = steps.where("pos = 1").select("file", F.col("step").alias("theorem"), F.concat(F.lit(" \n"), F.regexp_extract("text", r"\S+", 0)).alias("statement"), (F.col("line") + late).alias("line"))
    return L.theorem_steps(theorems, steps).select("file", "theorem", "step")


@query(
    "theorem_at_line",
    "SELECT e.event_id, d.doc_id FROM events e JOIN documents d ON d.doc_id = e.event_id % 1000 AND d.source = 'src' || (e.user_id % 20)",
)
def theorem_at_line(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 1000).alias("doc_id"), F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source"))
    return e.join(table(spark, sf_dir, "documents").select("doc_id", "source"), ["doc_id", "source"]).select("event_id", "doc_id")


@query("file_hash_groups", "SELECT source, count(DISTINCT sha256(text)) AS n_contents, min(sha256(text)) AS least FROM documents GROUP BY source")
def file_hash_groups(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count_distinct(F.sha2("text", 256)).alias("n_contents"), F.min(F.sha2("text", 256)).alias("least"))


@query(
    "candidate_dedup",
    """WITH c AS (SELECT conv_id, trim(split_part(text, '.', 1)) AS t, length(text) % 17 AS score, turn FROM conversations),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, t ORDER BY score DESC, turn) AS n FROM c),
    s AS (SELECT conv_id, t, score, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, t DESC) AS rank FROM r WHERE n = 1)
    SELECT conv_id, rank::INTEGER AS rank, t AS tactic, score::INTEGER AS score FROM s""",
)
def candidate_dedup(spark, sf_dir):
    """Candidates cut at the stop string, compared without outer spaces, best score first, then larger text."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.trim(F.substring_index("text", ".", 1)).alias("tactic"), (F.length("text") % 17).alias("score"))
    best = c.groupBy("conv_id", "tactic").agg(F.max("score").alias("score"))
    return best.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), F.desc("tactic"))).alias("rank"), "tactic", "score")
