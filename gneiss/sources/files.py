"""Readers and writers of corpora, results, logs and vector pages.

Schemas are fixed, so nothing is inferred and only the columns that are asked for are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.functions import text as T

SENTENCE = "struct<type:string,id:bigint,text:string,file_path:string,module:array<string>,sentence_type:string,line:int>"
STEP = "struct<term:string,step:struct<text:string,context:array<string>>,n_step:int,goals:array<string>>"
DOCUMENT = f"file_context array<string>, proofs array<struct<theorem:struct<term:string>,steps:array<{STEP}>>>"
METADATA = "file string, workspace string, repository string"
RESULT = "thm struct<project:string,path:string,line:int,column:int>, proof string, time double, n_attempts int"
LOG = "epoch double, learning_rate double, loss double, step long, eval_loss double, eval_runtime double"
SENTENCE_COLUMNS = "db_idx long, text string, file_path string, module string, sentence_type string, line int"


def read_documents(spark: SparkSession, path: str, glob: str = "*.v*") -> DataFrame:
    """One row per document file, with its name; the JSON may span lines. Below a folder that ``write_documents``
    wrote (``glob`` of its part files), the name is that of the file's folder."""
    at = F.col("_metadata.file_path")
    folder = F.nullif(F.regexp_extract(at, "/dp_name=([^/]+)/", 1), F.lit(""))
    read = spark.read.schema(DOCUMENT).json(path, multiLine=True, pathGlobFilter=glob, recursiveFileLookup=True)
    return read.withColumn("dp_name", F.coalesce(folder, F.element_at(F.split(at, "/"), -1)))


def file_metadata(documents: DataFrame) -> DataFrame:
    """(dp_name, file, workspace, repository): the first line of the context; premises are not looked at."""
    return documents.select("dp_name", F.from_json(F.get("file_context", F.lit(0)), METADATA).alias("m")).select("dp_name", "m.*")


def file_premises(documents: DataFrame, sentences: DataFrame | None = None) -> DataFrame:
    """(dp_name, pos, sentence columns): later lines of the context; stored ones are looked up by id, which must be
    there exactly once."""
    rows = documents.select("dp_name", F.posexplode("file_context").alias("pos", "j")).where("pos > 0")
    rows = rows.select("dp_name", "pos", F.from_json("j", SENTENCE).alias("s"))
    explicit = rows.where("s.type != 'stored'").select("dp_name", "pos", F.lit(None).cast("long").alias("db_idx"), "s.text", "s.file_path", "s.module", F.coalesce("s.sentence_type", "s.type").alias("sentence_type"), "s.line")
    stored = rows.where("s.type = 'stored'").select("dp_name", "pos", F.col("s.id").alias("db_idx"))
    if sentences is None:
        return explicit
    n = F.count("*").over(Window.partitionBy("dp_name", "pos"))
    looked = stored.join(sentences, "db_idx", "left").withColumn("_n", n)
    right = (F.col("_n") == 1) & F.col("text").isNotNull()
    looked = looked.withColumn("text", F.when(right, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("sentence id not found exactly once: "), F.col("db_idx").cast("string"))).cast("string")))
    module = F.from_json("module", "array<string>") if dict(sentences.dtypes)["module"] == "string" else F.col("module")
    kind = F.element_at(F.split("sentence_type", r"\."), -1)
    return explicit.unionByName(looked.select("dp_name", "pos", "db_idx", "text", "file_path", module.alias("module"), kind.alias("sentence_type"), "line"))


def steps(documents: DataFrame) -> DataFrame:
    """(dp_name, proof_idx, step_idx, text, n_step, goals): every step in order."""
    p = documents.select("dp_name", F.posexplode("proofs").alias("proof_idx", "p"))
    s = p.select("dp_name", "proof_idx", F.posexplode("p.steps").alias("step_idx", "s"))
    return s.select("dp_name", "proof_idx", "step_idx", F.col("s.step.text").alias("text"), F.col("s.n_step").alias("n_step"), F.transform("s.goals", T.goal_parts).alias("goals"))


def find_sources(spark: SparkSession, path: str, glob: str = "*.v") -> DataFrame:
    """(path, length, lines) of source files below a folder."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return b.select("path", "length", F.split(F.decode("content", "UTF-8"), "\n", -1).alias("lines"))


def read_results(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(project, path, line, column, proof, time, n_attempts, file) of result files, one JSON each."""
    r = spark.read.schema(RESULT).json(path, multiLine=True, recursiveFileLookup=recursive, pathGlobFilter="*.json")
    return r.select("thm.*", "proof", "time", "n_attempts", F.col("_metadata.file_path").alias("file"))


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """One document with a list of results, one row each in list order."""
    d = spark.read.schema(f"results array<struct<{RESULT.replace(' struct<', ':struct<').replace(' string', ':string').replace(' double', ':double').replace(' int', ':int')}>>").json(path, multiLine=True)
    return d.select(F.posexplode("results").alias("pos", "r")).select("pos", "r.thm.*", "r.proof", "r.time", "r.n_attempts")


def read_tool_lines(spark: SparkSession, path: str, glob: str = "*proofs.txt") -> DataFrame:
    """JSON lines of a tool: an array of positional metadata and an object with a status."""
    v = F.from_json("value", "array<variant>")
    d = spark.read.text(path, pathGlobFilter=glob, recursiveFileLookup=True).select(v.alias("v"))
    get = lambda k: F.variant_get(F.get("v", F.lit(0)), f"$[{k}]", "string")
    more = lambda name, kind="string": F.try_variant_get(F.get("v", F.lit(1)), f"$.{name}", kind)
    return d.select(get(0).alias("project"), get(1).alias("file"), get(2).alias("module"), get(3).alias("theorem"), (more("status") == "SUCCESS").alias("success"), more("time_taken", "double").alias("time"))


def read_tool_files(spark: SparkSession, path: str) -> DataFrame:
    """One JSON per theorem; the number in the file's name is the theorem's place in its file."""
    d = spark.read.schema("file string, theorem string, success boolean, synth_time double, stdout string").json(path, multiLine=True, recursiveFileLookup=True)
    idx = F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)\.(?:json|v)$", 1)
    return d.select("*", F.nullif(idx, F.lit("")).cast("int").alias("file_idx"), T.tool_proof(F.col("stdout")).alias("proof"))


# The fields of a record that all systems share.
RECORD = "file string, raw_file string, theorem string, time double, success boolean, modules array<string>, file_idx int, proof string, num_deps int, num_proj_deps int, num_proofs_available int"


def read_human(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Records of what people proved: theorems with single spaces, files as first and last part of their path. One JSON
    a file as it is exported, or one a line without ``multi_line``."""
    d = spark.read.schema(RECORD).json(path, multiLine=multi_line)
    return d.withColumns({"theorem": T.normalize_ws(F.col("theorem")), "file": T.ends_of_path(F.col("file"))})


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a training log; those with an evaluation loss are evaluations."""
    return spark.read.schema(LOG).json(path).withColumn("is_eval", F.col("eval_loss").isNotNull())


def read_metrics(spark: SparkSession, path: str, value: str) -> DataFrame:
    return spark.read.csv(path, header=True).where(F.col(value).isNotNull()).select(F.col("step").cast("long"), F.col(value).cast("double"))


def checkpoint_number(path) -> F.Column:
    return F.nullif(F.regexp_extract(path, r"checkpoint-(\d+)", 1), F.lit("")).cast("int")


def read_vector_page(spark: SparkSession, path: str, page: int) -> DataFrame:
    """Only the files of that page are read; no rows if there is none."""
    return spark.read.parquet(path).where(F.col("page") == page)


def write_vectors(vectors: DataFrame, path: str, size: int, id_col: str = "idx", source: DataFrame | None = None) -> None:
    """Pages of ``size`` consecutive ids, as folders; pages that are there already stay as they are. With ``source``
    (a column ``text`` in the order of ``id``), its sha256 and the page size are written beside the pages."""
    from gneiss.streaming.resume import not_yet

    rows = vectors.withColumn("page", F.floor(F.col(id_col) / size).cast("int"))
    not_yet(rows, path, ["page"]).write.mode("append").partitionBy("page").parquet(path)
    if source is not None:  # a hash of sorted row hashes: rows are hashed where they are
        each = source.select(F.sha2(F.concat_ws(":", F.col("id").cast("string"), "text"), 256).alias("h"))
        part = each.groupBy(F.substring("h", 1, 3).alias("p")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"))
        whole = part.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), ""), 256).alias("source_sha256"))
        whole.withColumn("page_size", F.lit(size)).write.mode("overwrite").json(path.rstrip("/") + "-metadata")


def write_examples(examples: DataFrame, path: str, by: str = "dp_name") -> None:
    """JSON lines, a folder for each source file; never over an output that is there."""
    examples.write.mode("errorifexists").partitionBy(by).json(path)


def write_retrieved(ranks: DataFrame, path: str, by: str = "dp_name") -> None:
    ranks.repartition(by).write.mode("errorifexists").partitionBy(by).parquet(path)


def write_summary(rows: DataFrame, path: str, order: list[str]) -> None:
    """CSV in order: sorted ranges, whose files follow each other by name, so that no task writes everything."""
    rows.orderBy(*order).write.mode("errorifexists").csv(path, header=True)


def write_results(results: DataFrame, path: str) -> None:
    """One JSON file for each theorem, in folders of its project, path and line. Columns of ``RESULT``."""
    place = {name: F.col(f"thm.{name}") for name in ("project", "path", "line")}
    folders = {f"by_{name}": value for name, value in place.items()}
    rows = results.select("thm", "proof", "time", "n_attempts").withColumns(folders)
    rows.write.mode("errorifexists").option("maxRecordsPerFile", 1).partitionBy(*folders).json(path)


def write_evaluation(results: DataFrame, path: str, order: list[str]) -> None:
    """One document that lists all results in the canonical order of theorems; a document is one value by its
    nature, so this is for results of one evaluation."""
    keyed = results.select(F.struct(*order).alias("k"), F.struct("thm", "proof", "time", "n_attempts").alias("r"))
    one = keyed.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "r"))), lambda x: x["r"]).alias("results"))
    one.write.mode("errorifexists").json(path)


def write_split(files: DataFrame, path: str, split_col: str = "split") -> None:
    """JSON lines, a folder for each split."""
    files.write.mode("errorifexists").partitionBy(split_col).json(path)


def write_lines_of_files(lines: DataFrame, path: str, file_col: str, line_col: str) -> None:
    """JSON lines of a file and the sorted lines where its theorems begin."""
    rows = lines.groupBy(F.col(file_col).alias("file")).agg(F.sort_array(F.collect_list(line_col)).alias("lines"))
    rows.write.mode("errorifexists").json(path)


def write_shuffled_index(index: DataFrame, path: str, pos: str = "pos") -> None:
    """JSON lines in the order of the index."""
    index.orderBy(pos).write.mode("errorifexists").json(path)


def write_log(rows: DataFrame, path: str) -> None:
    """Attempts as they come; what is there stays."""
    rows.write.mode("append").json(path)


def read_examples(spark: SparkSession, path: str, file: str, by: str = "dp_name") -> DataFrame:
    """The page of one source file; only its folder is read."""
    return spark.read.json(path).where(F.col(by) == file)

def write_documents(files: DataFrame, premises: DataFrame, proofs: DataFrame, path: str, stored: bool = True) -> None:
    """Documents as JSON: metadata first, then a line for each premise, as its id or in full."""
    one = F.struct(F.lit("stored").alias("type"), F.col("db_idx").alias("id")) if stored else F.struct(F.lit("explicit").alias("type"), "text", "file_path", "module", "sentence_type", "line")
    lines = premises.groupBy("dp_name").agg(F.sort_array(F.collect_list(F.struct("pos", F.to_json(one).alias("j")))).alias("p"))
    head = F.array(F.to_json(F.struct("file", "workspace", "repository")))
    rest = F.coalesce(F.transform("p", lambda x: x["j"]), F.array().cast("array<string>"))
    out = files.join(lines, "dp_name", "left").join(proofs, "dp_name", "left").select("dp_name", F.concat(head, rest).alias("file_context"), "proofs")
    out.write.mode("errorifexists").partitionBy("dp_name").json(path)
