"""Queries over what a step can see through its file's dependencies.

A document is a sentence of its file ``source/lang.v``, its id its line; conversations are the proofs of the files
``source.v``. A text that stands first in another file is a premise from there, so the files depend on each other by
the texts that they share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions import text as T
from gneiss.operators import corpus as C
from gneiss.operators import retrieval as R
from gneiss.operators import steps as S
from gneiss.operators.ranges import running
from gneiss.plans.retrieval import TOKENS, VISIBLE_TOP
from gneiss.registry import query, table


def path_of(by_lang: bool) -> Column:
    return F.concat(F.lit("repos/"), "source", *([F.lit("/"), "lang"] if by_lang else []), F.lit(".v"))


def file_edges(spark, sf_dir: str, by_lang: bool = True) -> DataFrame:
    """(file, dep, first_pos) of the files of ``documents``."""
    d = table(spark, sf_dir, "documents").select(path_of(by_lang).alias("path"), "doc_id", F.sha2("text", 256).alias("sentence"))
    first = d.groupBy("sentence").agg(F.min_by("path", "doc_id").alias("origin"))
    return C.dependencies(d.join(first, "sentence"), "path", "origin", "doc_id")


def edges_sql(by_lang: bool) -> str:
    path = "'repos/' || source || '/' || lang || '.v'" if by_lang else "'repos/' || source || '.v'"
    return f"""
d0 AS (SELECT doc_id, text, {path} AS path FROM documents),
d1 AS (SELECT a.path, substr(b.origin, 7) AS name, a.doc_id FROM d0 a JOIN (SELECT text, arg_min(path, doc_id) AS origin FROM d0 GROUP BY text) b USING (text)),
e AS (SELECT replace(substr(path, 7), '/', '-') AS file, replace(name, '/', '-') AS dep, min(doc_id) AS first_pos FROM d1 WHERE NOT contains(path, name) AND NOT contains(name, path) GROUP BY ALL)"""


@query("file_dependencies", f"WITH {edges_sql(True)} SELECT * FROM e")
def file_dependencies(spark, sf_dir):
    return file_edges(spark, sf_dir)


DEPENDENT = f"""{edges_sql(True)},
d AS (SELECT doc_id, source || '-' || lang || '.v' AS file, {TOKENS} AS t FROM documents),
q AS (SELECT doc_id AS query_id, file, t FROM d WHERE doc_id % 50 = 0),
v AS (SELECT query_id, d.doc_id, d.t, q.t AS qt FROM q JOIN d ON d.file = q.file AND d.doc_id < q.query_id
    UNION ALL SELECT query_id, d.doc_id, d.t, q.t FROM q JOIN e ON e.file = q.file JOIN d ON d.file = e.dep),
n AS (SELECT query_id, count(*) AS n, sum(len(t)) / count(*) AS a FROM v GROUP BY ALL),
tf AS (SELECT query_id, doc_id, term, any_value(len) AS len, count(*) AS tf FROM (SELECT query_id, doc_id, len(t) AS len, unnest(t) AS term FROM v) GROUP BY ALL),
df AS (SELECT query_id, term, count(*) AS df FROM tf GROUP BY ALL),
qf AS (SELECT query_id, term, count(*) AS f FROM (SELECT query_id, unnest(t) AS term FROM q) GROUP BY ALL),
"""


def dependency_topk(spark, sf_dir, kind):
    name = T.data_point_name(path_of(True))
    docs = table(spark, sf_dir, "documents").withColumns({"line": F.col("doc_id"), "file": name})
    asks = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "file", "line", F.col("text").alias("query"))
    return R.visible_topk(docs, asks, kind, file_col="file", edges=file_edges(spark, sf_dir))


@query(
    "bm25_dependency_topk",
    f"""WITH {DEPENDENT} s AS (SELECT query_id, doc_id, round(sum(f * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.8 / (tf + 1.8 * (0.25 + 0.75 * len / a))), 6) AS score
    FROM qf JOIN tf USING (query_id, term) JOIN df USING (query_id, term) JOIN n USING (query_id) GROUP BY ALL), {VISIBLE_TOP}""",
)
def bm25_dependency_topk(spark, sf_dir):
    return dependency_topk(spark, sf_dir, "bm25")


@query(
    "tfidf_dependency_topk",
    f"""WITH {DEPENDENT} s AS (SELECT query_id, doc_id, round(sum((0.5 + 0.5 * f / top) * tf / len * ln(n / df) * ln(n / df)), 6) AS score
    FROM qf JOIN (SELECT query_id, max(f) AS top FROM qf GROUP BY ALL) USING (query_id) JOIN tf USING (query_id, term) JOIN df USING (query_id, term) JOIN n USING (query_id) GROUP BY ALL), {VISIBLE_TOP}""",
)
def tfidf_dependency_topk(spark, sf_dir):
    return dependency_topk(spark, sf_dir, "tfidf")


@query(
    "visible_premise_counts",
    f"""WITH {edges_sql(True)}, d AS (SELECT doc_id, source || '-' || lang || '.v' AS file FROM documents),
    w AS (SELECT e.file, count(*) AS n FROM e JOIN d ON d.file = e.dep GROUP BY ALL)
    SELECT doc_id, row_number() OVER (PARTITION BY file ORDER BY doc_id) - 1 AS in_file, coalesce(n, 0) AS out_of_file FROM d LEFT JOIN w USING (file)""",
)
def visible_premise_counts(spark, sf_dir):
    """How many premises each step sees, composed of running sums and sums over edges: no pair is made."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.data_point_name(path_of(True)).alias("file"))
    other = C.of_dependencies(file_edges(spark, sf_dir), d.groupBy("file").agg(F.count("*").alias("out_of_file")), "out_of_file")
    own = running(d, ["file"], ["doc_id"], {"in_file": F.lit(1).cast("long")}, "before")
    return own.join(other, "file", "left").select("doc_id", "in_file", F.coalesce("out_of_file", F.lit(0)).alias("out_of_file"))


@query(
    "step_premises",
    f"""WITH {edges_sql(True)}, d AS (SELECT doc_id, source || '-' || lang || '.v' AS file FROM documents), q AS (SELECT doc_id AS step_id, file FROM d WHERE doc_id % 50 = 0)
    SELECT step_id, doc_id AS premise_id, true AS own FROM q JOIN d USING (file) WHERE doc_id < step_id
    UNION ALL SELECT step_id, doc_id, false FROM q JOIN e USING (file) JOIN d ON d.file = e.dep""",
)
def step_premises(spark, sf_dir):
    """Each step of a stated set with all premises that it sees."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.data_point_name(path_of(True)).alias("file"))
    asks = d.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "step_id")
    return C.visible_premises(asks, d.withColumnRenamed("doc_id", "premise_id"), file_edges(spark, sf_dir), "file", "step_id", "premise_id").select("step_id", "premise_id", "own")


@query(
    "positive_premises",
    f"""WITH {edges_sql(True)},
    d AS (SELECT doc_id, source || '-' || lang || '.v' AS file, lang, string_split(text, chr(10)) AS t FROM documents),
    l AS (SELECT doc_id, file, lang, unnest(t) AS line, generate_subscripts(t, 1) AS pos FROM d),
    o AS (SELECT line, min(doc_id) AS premise_id, arg_min(file, doc_id) AS from_file, arg_min(lang, doc_id) AS kind FROM l WHERE trim(line) <> '' GROUP BY line),
    u AS (SELECT doc_id AS step_id, file, premise_id, from_file, min(pos) AS pos FROM l JOIN o USING (line) WHERE premise_id <> doc_id AND kind <> 'es' GROUP BY ALL),
    k AS (SELECT u.* FROM u WHERE from_file = file AND premise_id < step_id UNION ALL SELECT u.* FROM u JOIN e ON e.file = u.file AND e.dep = u.from_file)
    SELECT step_id, premise_id, row_number() OVER (PARTITION BY step_id ORDER BY pos, premise_id) AS nth FROM k""",
)
def positive_premises(spark, sf_dir):
    """The premises that a step really used, in order: its lines are sentences, each of which belongs to the document
    where it stands first; those of a kind that the filter leaves out, or of files that the step does not see, are
    no positives."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.data_point_name(path_of(True)).alias("file"), "lang", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("sentence", F.sha2("line", 256))
    first = d.where("trim(line) != ''").groupBy("sentence").agg(F.min("doc_id").alias("premise_id"), F.min_by(F.struct("file", "lang"), "doc_id").alias("at"))
    kept = first.where(C.premise_filter(F.col("at.lang"), F.col("at.file"), general_excludes=("es",))).select("sentence", "premise_id", F.col("at.file").alias("premise_file"))
    used = d.join(kept, "sentence").where("premise_id != doc_id").groupBy(F.col("doc_id").alias("step_id"), "file", "premise_id", "premise_file").agg(F.min("pos").alias("pos"))
    return C.positives(used, file_edges(spark, sf_dir), "step_id", "file", "premise_id", "premise_file", "pos").select("step_id", "premise_id", "nth")


PROOFS = f"""{edges_sql(False)}, c AS (SELECT DISTINCT conv_id, 'src' || (conv_id % 20) || '.v' AS file FROM conversations)"""


def proofs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return c.withColumn("file", F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string"), F.lit(".v")))


@query(
    "available_proofs",
    f"""WITH {PROOFS}, q AS (SELECT * FROM c WHERE conv_id % 50 = 0)
    SELECT q.conv_id, c.conv_id AS available FROM q JOIN c ON c.file = q.file AND c.conv_id < q.conv_id
    UNION ALL SELECT q.conv_id, c.conv_id FROM q JOIN e ON e.file = q.file JOIN c ON c.file = e.dep""",
)
def available_proofs(spark, sf_dir):
    """The proofs that each proof of a stated set can see: earlier ones of its file, all of its dependencies'."""
    c = proofs(spark, sf_dir)
    other = c.withColumnRenamed("conv_id", "available")
    return C.visible_premises(c.where("conv_id % 50 = 0"), other, file_edges(spark, sf_dir, False), "file", "conv_id", "available").select("conv_id", "available")


@query(
    "available_proof_counts",
    f"""WITH {PROOFS}, w AS (SELECT e.file, count(*) AS n, count(DISTINCT e.dep) AS deps FROM e JOIN c ON c.file = e.dep GROUP BY ALL)
    SELECT conv_id, row_number() OVER (PARTITION BY file ORDER BY conv_id) - 1 + coalesce(n, 0) AS available, coalesce(deps, 0) AS dependencies FROM c LEFT JOIN w USING (file)""",
)
def available_proof_counts(spark, sf_dir):
    """How many proofs every proof can see, and how many files with proofs its file depends on."""
    c = proofs(spark, sf_dir)
    per_file = c.groupBy("file").agg(F.count("*").alias("n"), F.lit(1).cast("long").alias("dependencies"))
    other = C.of_dependencies(file_edges(spark, sf_dir, False), per_file, "n", "dependencies")
    own = running(c, ["file"], ["conv_id"], {"own": F.lit(1).cast("long")}, "before")
    return own.join(other, "file", "left").select("conv_id", (F.col("own") + F.coalesce("n", F.lit(0))).alias("available"), F.coalesce("dependencies", F.lit(0)).alias("dependencies"))


@query(
    "dependency_counts",
    f"""WITH {edges_sql(True)}, n AS (SELECT file, count(*) AS n_deps FROM e GROUP BY ALL)
    SELECT replace(substr(path, 7), '/', '-') AS file, count(DISTINCT name) - 1 AS n_paths, any_value(coalesce(n_deps, 0)) AS n_deps FROM d1 LEFT JOIN n ON n.file = replace(substr(path, 7), '/', '-') GROUP BY ALL""",
)
def dependency_counts(spark, sf_dir):
    """Per file: how many paths its premises come from, itself not counted, and on how many files it depends."""
    d = table(spark, sf_dir, "documents").select(path_of(True).alias("path"), "doc_id", F.sha2("text", 256).alias("sentence"))
    origin = d.groupBy("sentence").agg(F.min_by("path", "doc_id").alias("origin"))
    paths = d.join(origin, "sentence").groupBy(T.data_point_name(F.col("path")).alias("file")).agg((F.count_distinct("origin") - 1).alias("n_paths"))
    n = file_edges(spark, sf_dir).groupBy("file").agg(F.count("*").alias("n_deps"))
    return paths.join(n, "file", "left").select("file", "n_paths", F.coalesce("n_deps", F.lit(0)).alias("n_deps"))


@query("dependency_count_join", f"WITH {edges_sql(True)}, n AS (SELECT file, count(*) AS n_deps FROM e GROUP BY ALL) SELECT doc_id, coalesce(n_deps, 0) AS n_deps FROM documents LEFT JOIN n ON n.file = source || '-' || lang || '.v'")
def dependency_count_join(spark, sf_dir):
    """Each theorem with the number of files that its file depends on, worked out once a file."""
    n = file_edges(spark, sf_dir).groupBy("file").agg(F.count("*").alias("n_deps"))
    d = table(spark, sf_dir, "documents").select("doc_id", T.data_point_name(path_of(True)).alias("file"))
    return d.join(n, "file", "left").select("doc_id", F.coalesce("n_deps", F.lit(0)).alias("n_deps"))


@query(
    "human_baseline",
    f"""WITH {PROOFS}, l AS (SELECT conv_id, arg_max(text, turn) AS last, count(*) AS n_steps, string_agg(text, '' ORDER BY turn) AS proof FROM conversations GROUP BY ALL),
    w AS (SELECT e.file, sum(k) AS n FROM e JOIN (SELECT file, count(*) AS k FROM c GROUP BY ALL) x ON x.file = e.dep GROUP BY ALL), n AS (SELECT file, count(*) AS n_deps FROM e GROUP BY ALL),
    a AS (SELECT conv_id, file, row_number() OVER (PARTITION BY file ORDER BY conv_id) - 1 AS nth FROM c)
    SELECT file, nth, conv_id, md5(proof) AS proof_md5, n_steps, coalesce(n_deps, 0) AS n_deps, (nth + coalesce(n, 0))::BIGINT AS n_available FROM a JOIN l USING (conv_id) LEFT JOIN w USING (file) LEFT JOIN n USING (file)
    WHERE file IN ('src0.v', 'src1.v') AND NOT contains(last, 'Defined')""",
)
def human_baseline(spark, sf_dir):
    """Proofs of the test files that nothing else is built on, with what their writers had: dependencies of the file
    and proofs that were there before, in it and in them."""
    c = proofs(spark, sf_dir)
    edges = file_edges(spark, sf_dir, False)
    n = edges.groupBy("file").agg(F.count("*").alias("n_deps"))
    there = C.of_dependencies(edges, c.groupBy("file").agg(F.count("*").alias("n")), "n")
    place = running(c, ["file"], ["conv_id"], {"nth": F.lit(1).cast("long")}, "before").where(F.col("file").isin("src0.v", "src1.v"))
    turns = table(spark, sf_dir, "conversations")
    last = S.whole_text(turns, ["conv_id"], "turn", "text").join(turns.groupBy("conv_id").agg(F.max_by("text", "turn").alias("last"), F.count("*").alias("n_steps")), "conv_id")
    rows = place.join(last.where(~F.col("last").contains("Defined")), "conv_id").join(there, "file", "left").join(n, "file", "left")
    return rows.select("file", "nth", "conv_id", F.md5("proof_text").alias("proof_md5"), "n_steps", F.coalesce("n_deps", F.lit(0)).alias("n_deps"), (F.col("nth") + F.coalesce("n", F.lit(0))).alias("n_available"))
