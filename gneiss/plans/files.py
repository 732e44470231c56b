"""Queries that write tables with the writers, read them back with the readers, and return what came back."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from gneiss.functions import text as T
from gneiss.operators import corpus as C
from gneiss.operators.ranges import numbered
from gneiss.registry import query, table
from gneiss.sources import files as S
from gneiss.store import shared_folder
from gneiss.streaming.resume import follow, not_yet
from gneiss.streaming.strikes import until_stopped


def folder(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/gneiss-files-{uuid.uuid4().hex}"


def written_documents(spark, sf_dir):
    """A document file for each source: its documents are the premises, conversations are the proofs."""
    d = table(spark, sf_dir, "documents").where("source IS NOT NULL").select(F.concat("source", F.lit(".v")).alias("dp_name"), "source", "doc_id", "text")
    files = d.select("dp_name", F.concat(F.lit("repos/"), "source", F.lit(".v")).alias("file"), "source").distinct().select("dp_name", "file", F.col("source").alias("workspace"), F.lit("repos/r").alias("repository"))
    premises = numbered(d.select("dp_name", "doc_id"), ["dp_name"], ["doc_id"], "pos").select("dp_name", F.col("pos").cast("int").alias("pos"), F.col("doc_id").alias("db_idx"))
    c = table(spark, sf_dir, "conversations").select(F.concat(F.lit("src"), F.col("conv_id") % 20, F.lit(".v")).alias("dp_name"), "conv_id", "turn", "role", "text")
    step = F.struct(F.col("role").alias("term"), F.struct("text", F.array().cast("array<string>").alias("context")).alias("step"), F.col("turn").cast("int").alias("n_step"), F.array("role").alias("goals"))
    proofs = c.groupBy("dp_name", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", step.alias("s")))).alias("x"))
    proof = F.struct(F.struct(F.col("conv_id").cast("string").alias("term")).alias("theorem"), F.transform("x", lambda x: x["s"]).alias("steps"))
    proofs = proofs.groupBy("dp_name").agg(F.transform(F.sort_array(F.collect_list(F.struct("conv_id", proof.alias("p")))), lambda x: x["p"]).alias("proofs"))
    path = folder(spark)
    S.write_documents(files, premises, proofs, path)
    return S.read_documents(spark, path, "*.json")


@query(
    "document_steps",
    """WITH f AS (SELECT DISTINCT source || '.v' AS dp_name FROM documents WHERE source IS NOT NULL),
    c AS (SELECT 'src' || (conv_id % 20) || '.v' AS dp_name, conv_id, turn, text FROM conversations)
    SELECT dp_name, (dense_rank() OVER (PARTITION BY dp_name ORDER BY conv_id) - 1)::INTEGER AS proof_idx, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS step_idx, turn::INTEGER AS n_step, md5(text) AS text_md5
    FROM c JOIN f USING (dp_name)""",
)
def document_steps(spark, sf_dir):
    return S.steps(written_documents(spark, sf_dir)).select("dp_name", "proof_idx", "step_idx", "n_step", F.md5("text").alias("text_md5"))


@query("file_metadata_scan", "SELECT DISTINCT source || '.v' AS dp_name, 'repos/' || source || '.v' AS file, source AS workspace, 'repos/r' AS repository FROM documents WHERE source IS NOT NULL")
def file_metadata_scan(spark, sf_dir):
    return S.file_metadata(written_documents(spark, sf_dir))


@query(
    "file_premises_decode",
    "SELECT source || '.v' AS dp_name, (row_number() OVER (PARTITION BY source ORDER BY doc_id))::INTEGER AS pos, doc_id AS db_idx, md5(text) AS text_md5, 'LEMMA' AS sentence_type FROM documents WHERE source IS NOT NULL",
)
def file_premises_decode(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    sentences = d.select(F.col("doc_id").alias("db_idx"), "text", F.col("source").alias("file_path"), F.lit('["m"]').alias("module"), F.lit("TermType.LEMMA").alias("sentence_type"), F.lit(1).alias("line"))
    return S.file_premises(written_documents(spark, sf_dir), sentences).select("dp_name", "pos", "db_idx", F.md5("text").alias("text_md5"), "sentence_type")


@query("source_files", "SELECT source, (sum(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1) + 1)::BIGINT AS n_lines FROM documents WHERE source IS NOT NULL GROUP BY source")
def source_files(spark, sf_dir):
    """Text files found below a folder, split into lines; a file ends with a line end."""
    d = table(spark, sf_dir, "documents").where("source IS NOT NULL").select("source", F.coalesce("text", F.lit("")).alias("value"))
    path = folder(spark)
    d.repartition("source").write.partitionBy("source").text(path)
    found = S.find_sources(spark, path, "*.txt")
    return found.groupBy(F.regexp_extract("path", "/source=([^/]+)/", 1).alias("source")).agg(F.sum(F.size("lines")).cast("long").alias("n_lines"))


RESULTS = "SELECT r_name AS project, n_name || '.v' AS path, n_nationkey::INTEGER AS line, n_regionkey::INTEGER AS \"column\", n_name || ' auto.' AS proof, n_nationkey / 4.0::DOUBLE AS time, (n_nationkey % 3)::INTEGER AS n_attempts FROM nation JOIN region ON r_regionkey = n_regionkey"


def theorem_results(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    thm = F.struct(F.col("r_name").alias("project"), F.concat("n_name", F.lit(".v")).alias("path"), F.col("n_nationkey").cast("int").alias("line"), F.col("n_regionkey").cast("int").alias("column"))
    return n.select(thm.alias("thm"), F.concat("n_name", F.lit(" auto.")).alias("proof"), (F.col("n_nationkey") / 4).alias("time"), (F.col("n_nationkey") % 3).cast("int").alias("n_attempts"))


@query("result_tree", RESULTS)
def result_tree(spark, sf_dir):
    path = folder(spark)
    S.write_results(theorem_results(spark, sf_dir), path)
    return S.read_results(spark, path).drop("file")


@query("flat_results", RESULTS)
def flat_results(spark, sf_dir):
    path = folder(spark)
    theorem_results(spark, sf_dir).write.option("maxRecordsPerFile", 1).json(path)
    return S.read_results(spark, path, recursive=False).drop("file")


@query("evaluation_document", f"SELECT (row_number() OVER (ORDER BY project, path, line) - 1)::INTEGER AS pos, * FROM ({RESULTS})")
def evaluation_document(spark, sf_dir):
    path = folder(spark)
    S.write_evaluation(theorem_results(spark, sf_dir), path, ["thm.project", "thm.path", "thm.line"])
    return S.read_evaluation(spark, path)


@query("tool_lines", "SELECT event_type AS project, user_id::VARCHAR AS file, 'M' AS module, event_id::VARCHAR AS theorem, value < 50 AS success, value AS time FROM events")
def tool_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    head = F.to_json(F.array("event_type", F.col("user_id").cast("string"), F.lit("M"), F.col("event_id").cast("string")))
    tail = F.to_json(F.struct(F.when(F.col("value") < 50, "SUCCESS").otherwise("FAILURE").alias("status"), F.col("value").alias("time_taken")))
    path = folder(spark)
    e.select(F.concat(F.lit("["), head, F.lit(", "), tail, F.lit("]")).alias("value")).write.text(path)
    return S.read_tool_lines(spark, path, "*.txt")


@query("tool_files", "SELECT 'f' || n_regionkey AS file, n_name AS theorem, n_nationkey % 2 = 0 AS success, CASE WHEN n_nationkey % 2 = 0 THEN 'intros ' || n_name END AS proof FROM nation")
def tool_files(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    done = F.col("n_nationkey") % 2 == 0
    out = F.when(done, F.concat(F.lit("\x1b[32monly 1: synth with cache (intros "), "n_name", F.lit(").\r\nNo more goals.\x1b[0m"))).otherwise("failed")
    path = folder(spark)
    n.select(F.concat(F.lit("f"), "n_regionkey").alias("file"), F.col("n_name").alias("theorem"), done.alias("success"), F.lit(1.0).alias("synth_time"), out.alias("stdout")).write.option("maxRecordsPerFile", 1).json(path)
    return S.read_tool_files(spark, path).select("file", "theorem", "success", "proof")


@query(
    "human_rows",
    """SELECT o_orderkey % 1000 AS file_idx, 'p' || o_custkey % 7 || '/' || o_orderkey || '.v' AS file, 'Lemma l' || o_orderkey || ' : ' || o_orderpriority AS theorem, o_totalprice AS time,
    o_orderstatus = 'F' AS success, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS proof, array_to_string(['M', o_orderstatus], '.') AS module, (o_custkey % 11)::INTEGER AS num_deps FROM orders""",
)
def human_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    done, path = F.col("o_orderstatus") == "F", folder(spark)
    rows = o.select(
        F.concat(F.lit("p"), F.col("o_custkey") % 7, F.lit("/deep/er/"), "o_orderkey", F.lit(".v")).alias("file"),
        F.concat(F.lit("  Lemma l"), "o_orderkey", F.lit(" \n\t: "), "o_orderpriority", F.lit("\n")).alias("theorem"),
        F.col("o_totalprice").alias("time"), done.alias("success"), F.array(F.lit("M"), "o_orderstatus").alias("modules"),
        (F.col("o_orderkey") % 1000).alias("file_idx"), F.when(done, F.col("o_orderpriority")).alias("proof"), (F.col("o_custkey") % 11).alias("num_deps"),
    )
    rows.write.json(path)
    back = S.read_human(spark, path, multi_line=False)
    return back.select(F.col("file_idx").cast("long").alias("file_idx"), "file", "theorem", "time", "success", "proof", F.array_join("modules", ".").alias("module"), "num_deps")


@query("training_log_read", "SELECT event_id AS step, CASE WHEN event_id % 5 = 0 THEN NULL ELSE round(value, 6) END AS loss, CASE WHEN event_id % 5 = 0 THEN round(value, 6) END AS eval_loss, event_id % 5 = 0 AS is_eval FROM events")
def training_log_read(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    asked = F.col("event_id") % 5 == 0
    path = folder(spark)
    S.write_log(e.select(F.col("event_id").alias("step"), F.when(~asked, F.col("value")).alias("loss"), F.when(asked, F.col("value")).alias("eval_loss")), path)
    return S.read_log(spark, path).select("step", F.round("loss", 6).alias("loss"), F.round("eval_loss", 6).alias("eval_loss"), "is_eval")


@query("metrics_csv", "SELECT event_id AS step, round(value, 6) AS loss FROM events WHERE event_id % 3 <> 0")
def metrics_csv(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("loss"))
    path = folder(spark)
    e.write.csv(path, header=True)
    return S.read_metrics(spark, path, "loss").select("step", F.round("loss", 6).alias("loss"))


@query("vector_page_read", "SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings WHERE vec_id // 16 = 1")
def vector_page_read(spark, sf_dir):
    """Pages are written twice, the second time over what is there; one page is read."""
    e = table(spark, sf_dir, "embeddings")
    path = folder(spark)
    for rows in (e.where("vec_id < 24"), e):
        S.write_vectors(rows.where("vec_id < 16") if rows is not e else e, path, 16, "vec_id", table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return S.read_vector_page(spark, path, 1).select("vec_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


@query("example_pages", "SELECT conv_id, turn, md5(text) AS text_md5 FROM conversations WHERE conv_id % 20 = 3")
def example_pages(spark, sf_dir):
    """Examples as JSON lines in a folder for each source file, of which one page is read when it is asked for."""
    c = table(spark, sf_dir, "conversations").select(F.concat(F.lit("src"), F.col("conv_id") % 20).alias("dp_name"), "conv_id", "turn", "text")
    path = folder(spark)
    S.write_examples(c, path)
    return S.read_examples(spark, path, "src3").select("conv_id", "turn", F.md5("text").alias("text_md5"))


@query("retrieved_pages", "SELECT source AS dp_name, (row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id))::INTEGER AS rank, doc_id FROM documents WHERE source IS NOT NULL")
def retrieved_pages(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("source IS NOT NULL").select(F.col("source").alias("dp_name"), "n_chars", "doc_id")
    rows = numbered(d, ["dp_name"], [-F.col("n_chars"), "doc_id"]).select("dp_name", F.col("rank").cast("int").alias("rank"), "doc_id")
    path = folder(spark)
    S.write_retrieved(rows, path)
    return spark.read.parquet(path).select("dp_name", "rank", "doc_id")


@query("summary_csv", "SELECT event_type AS system, user_id, event_id, row_number() OVER (ORDER BY event_type, user_id, event_id) AS pos FROM events")
def summary_csv(spark, sf_dir):
    """A summary written in order; rows are numbered as they stand in the files."""
    path = folder(spark)
    S.write_summary(table(spark, sf_dir, "events").select(F.col("event_type").alias("system"), "user_id", "event_id"), path, ["system", "user_id", "event_id"])
    back = spark.read.schema("system string, user_id long, event_id long").csv(path, header=True)
    place = back.select("*", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return numbered(place, [], ["file", "block", "at"], "pos").select("system", "user_id", "event_id", "pos")


@query("split_files", "SELECT source AS file, CASE WHEN source IN ('src0', 'src1') THEN 'test' WHEN source = 'src2' THEN 'val' ELSE 'train' END AS split FROM documents WHERE source IS NOT NULL GROUP BY source")
def split_files(spark, sf_dir):
    f = table(spark, sf_dir, "documents").where("source IS NOT NULL").select(F.col("source").alias("file")).distinct()
    split = F.when(F.col("file").isin("src0", "src1"), "test").when(F.col("file") == "src2", "val").otherwise("train")
    path = folder(spark)
    S.write_split(f.withColumn("split", split), path)
    return spark.read.schema("file string, split string").json(path)


@query("line_table", "SELECT source AS file, string_agg(doc_id, ',' ORDER BY doc_id) AS lines FROM documents WHERE source IS NOT NULL GROUP BY source")
def line_table(spark, sf_dir):
    path = folder(spark)
    S.write_lines_of_files(table(spark, sf_dir, "documents").where("source IS NOT NULL"), path, "source", "doc_id")
    back = spark.read.schema("file string, lines array<long>").json(path)
    return back.select("file", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


@query("shuffled_index_file", "SELECT row_number() OVER (ORDER BY md5('file:' || doc_id), doc_id) AS pos, doc_id FROM documents")
def shuffled_index_file(spark, sf_dir):
    key = C.hash_order("file", F.col("doc_id"))
    index = C.intern(table(spark, sf_dir, "documents").select("doc_id", F.struct(key, "doc_id").alias("k")), ["doc_id"], "k").withColumnRenamed("db_idx", "pos")
    path = folder(spark)
    S.write_shuffled_index(index, path)
    return spark.read.schema("pos long, doc_id long").json(path)


@query("attempt_log", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, event_type AS action FROM events")
def attempt_log(spark, sf_dir):
    """Attempts appended in two parts and read back in the order of time."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    path = folder(spark)
    for part in (0, 1):
        S.write_log(e.where(F.col("event_id") % 2 == part).withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp"))), path)
    back = spark.read.schema("user_id long, event_id long, ts long, event_type string").json(path)
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return back.select("user_id", "event_id", n.cast("long").alias("attempt"), F.col("event_type").alias("action"))


@query("resumed_outputs", "SELECT doc_id, md5(text) AS text_md5, doc_id % 3 = 0 AS first_run FROM documents")
def resumed_outputs(spark, sf_dir):
    """A run that stopped after a third is resumed: only what has no output is done."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("text_md5"))
    path = folder(spark)
    d.where("doc_id % 3 = 0").withColumn("first_run", F.lit(True)).write.parquet(path)
    not_yet(d, path, ["doc_id"]).withColumn("first_run", F.lit(False)).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query(
    "stopped_workers",
    """WITH e AS (SELECT user_id, event_id, ts, coalesce(value >= 50, true) AS failed FROM events),
    o AS (SELECT *, sum((NOT failed)::INT) OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id ROWS UNBOUNDED PRECEDING) AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id) AS n FROM e),
    s AS (SELECT *, sum(failed::INT) OVER (PARTITION BY user_id, run ORDER BY n ROWS UNBOUNDED PRECEDING) AS strikes FROM o),
    f AS (SELECT user_id, min(n) AS last FROM s WHERE strikes >= 3 GROUP BY user_id)
    SELECT s.user_id, event_id, strikes::INTEGER AS strikes, strikes >= 3 AS stop FROM s LEFT JOIN f ON s.user_id IS NOT DISTINCT FROM f.user_id WHERE last IS NULL OR n <= last""",
)
def stopped_workers(spark, sf_dir):
    """Users stop at the third failure in a row. Events arrive in two parts, and the stream is started again for the
    second over the first's checkpoint."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("value") >= 50).alias("failed"))
    parts, out, done = folder(spark), folder(spark), folder(spark)
    day = F.to_date("ts")
    half = F.broadcast(e.agg(F.date_add(F.min(day), F.floor(F.date_diff(F.max(day), F.min(day)) / 2).cast("int")).alias("half")))  # one row
    split = e.crossJoin(half).withColumn("late", F.coalesce(day > F.col("half"), F.lit(False))).drop("half")
    for late in (False, True):
        split.where(F.col("late") == late).drop("late").write.mode("append").parquet(parts)
        count = lambda new: until_stopped(new, "user_id", ["ts", "event_id"], "failed")
        follow(spark, parts, e.schema, lambda rows: rows, out, done, "parquet", count).awaitTermination()
    return spark.read.schema("user_id long, event_id long, strikes int, stop boolean").parquet(out).select("user_id", "event_id", "strikes", "stop")


@query(
    "path_functions",
    """WITH p AS (SELECT doc_id, '../../data/repos/' || source || '/' || lang || '.v' AS path FROM documents)
    SELECT doc_id, 'x/' || substr(path, 7) AS rebased, substr(path, 7) AS plain, substr(path, 12) AS inner_path, replace(substr(path, 18), '/', '-') AS dp_name, substr(path, 12) AS file, 'repos/' || split_part(path, '/', 5) AS workspace, 'data-' || split_part(path, '/', 5) AS output, substr(path, 4) AS rest FROM p""",
)
def path_functions(spark, sf_dir):
    path = F.concat(F.lit("../../data/repos/"), "source", F.lit("/"), "lang", F.lit(".v"))
    p = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "source")
    p = p.withColumn("info", T.file_info(F.col("path")))
    return p.select("doc_id", T.rebase(F.col("path"), "../../", "x/").alias("rebased"), T.strip_parents(F.col("path")).alias("plain"), T.from_repos(F.col("path")).alias("inner_path"), "info.dp_name", "info.file", "info.workspace", T.output_name(F.lit("data"), F.col("source")).alias("output"), T.without_prefix(F.col("path"), "../").alias("rest"))


@query(
    "prompt_functions",
    """SELECT doc_id, md5(coalesce(text, '')) AS body_md5, md5('Prove ' || lang || ' in ' || source || '.') AS prompt_md5, 'own/' || source AS remote, 'a,b,' || source || ',' || lang AS goals FROM documents""",
)
def prompt_functions(spark, sf_dir):
    """The text inside a code fence, a filled prompt, the owner and name of a remote, and all goals in order."""
    d = table(spark, sf_dir, "documents")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    whole = F.md5(F.coalesce("text", F.lit("")))
    fence = T.code_fence(F.concat(F.lit("```coq\n"), text, F.lit("\n```")))
    goals = T.all_goals(F.array(F.lit("a")), F.array(F.array(F.lit("b")), F.array("source")), F.array("lang"))
    remote = T.owner_and_repo(F.concat(F.lit("git@host:own/"), "source", F.lit(".git")))
    return d.select("doc_id", F.when(fence == text, whole).alias("body_md5"), F.md5(T.fill("Prove %s in %s.", F.col("lang"), F.col("source"))).alias("prompt_md5"), remote.alias("remote"), F.array_join(goals, ",").alias("goals"))


@query("definition_bodies", "SELECT doc_id, 'fun ' || lang || ' => ' || n_chars AS body FROM documents")
def definition_bodies(spark, sf_dir):
    s = F.concat(F.lit("Definition d :=\n  fun "), "lang", F.lit(" => "), F.col("n_chars").cast("string"), F.lit(" ."))
    return table(spark, sf_dir, "documents").select("doc_id", T.definition_body(s).alias("body"))


@query(
    "goal_token_counts",
    f"""WITH d AS (SELECT doc_id, 'x' || (doc_id % 3) AS name, regexp_extract_all(coalesce(replace(text, ':', ' '), ''), '{T.TOKEN}') AS t, regexp_extract_all(lang || ' x0 x1', '{T.TOKEN}') AS g FROM documents)
    SELECT doc_id, len(list_filter(t, lambda z: z <> name)) AS n_hyps, array_to_string(list_filter(g, lambda z: z <> name), ' ') AS goal FROM d""",
)
def goal_token_counts(spark, sf_dir):
    """Tokens of a goal whose one hypothesis is named x0, x1 or x2 and says the document's text; the name goes."""
    d = table(spark, sf_dir, "documents")
    hyp = F.concat(F.lit("x"), (F.col("doc_id") % 3).cast("string"), F.lit(":"), F.replace(F.coalesce("text", F.lit("")), F.lit(":"), F.lit(" ")))
    goal = F.struct(F.array(hyp).alias("hyps"), F.concat("lang", F.lit(" x0 x1")).alias("goal"))
    d = d.select("doc_id", T.goal_tokens(goal).alias("t"))
    return d.select("doc_id", F.size("t.hyps").cast("long").alias("n_hyps"), F.array_join("t.goal", " ").alias("goal"))


KIND = "['LEMMA', 'DEFINITION', 'THEOREM', 'OTHER'][1 + doc_id % 4]"


@query(
    "named_filters",
    f"""WITH d AS (SELECT doc_id, source IN ('src0', 'src1') AS library, {KIND} IN ('LEMMA', 'THEOREM') AS thm FROM documents WHERE source IS NOT NULL)
    SELECT doc_id, true AS "all", NOT library AS proj, thm, NOT library AND thm AS "proj-thm" FROM d""",
)
def named_filters(spark, sf_dir):
    kind = F.get(F.array(*map(F.lit, ("LEMMA", "DEFINITION", "THEOREM", "OTHER"))), (F.col("doc_id") % 4).cast("int"))
    path = F.when(F.col("source").isin("src0", "src1"), F.lit(f"{C.LIBRARY}/a.v")).otherwise(F.col("source"))
    d = table(spark, sf_dir, "documents").where("source IS NOT NULL").select("doc_id", kind.alias("kind"), path.alias("path"))
    return d.select("doc_id", *[C.named_filter(name, F.col("kind"), F.col("path")).alias(name) for name in C.FILTERS])
