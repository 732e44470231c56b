"""Interning, deduplication, availability, splits and sampling over the corpus tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import text as T
from gneiss.operators.ranges import numbered
from gneiss.store import cut

# Kinds of statements that the named filters leave out, from the standard library and from elsewhere.
NOT_THEOREMS = (
    "DEFINITION", "NOTATION", "INDUCTIVE", "COINDUCTIVE", "RECORD", "CLASS", "INSTANCE", "FIXPOINT", "COFIXPOINT",
    "SCHEME", "VARIANT", "OBLIGATION", "TACTIC", "RELATION", "SETOID", "FUNCTION", "DERIVE", "OTHER",
)
EVERYTHING = NOT_THEOREMS + ("THEOREM", "LEMMA", "FACT", "REMARK", "COROLLARY", "PROPOSITION", "PROPERTY")
FILTERS = {
    "all": ((), ()),
    "proj": (EVERYTHING, ()),
    "thm": (NOT_THEOREMS, NOT_THEOREMS),
    "proj-thm": (EVERYTHING, NOT_THEOREMS),
}
LIBRARY = "lib/coq/theories"


def premise_filter(kind: Column, path: Column, library_excludes: tuple = (), other_excludes: tuple = (), general_excludes: tuple = (), library: str | Column = LIBRARY) -> Column:
    """Whether a premise passes: its kind is not left out in general, nor for where it comes from."""
    inside = path.contains(library) if isinstance(library, str) else library
    return ~kind.isin(*general_excludes) & F.when(inside, ~kind.isin(*library_excludes)).otherwise(~kind.isin(*other_excludes))


def named_filter(name: str, kind: Column, path: Column) -> Column:
    return premise_filter(kind, path, *FILTERS[name])


def hash_order(*parts: Column | str) -> Column:
    """A key that shuffles the same way in every engine."""
    return F.md5(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def intern(rows: DataFrame, key: list[str], order: str, known: DataFrame | None = None) -> DataFrame:
    """(key columns, db_idx from 1): one id per distinct value in order of first sight; values in ``known`` keep
    theirs. Ids are dense: counts of the range-partitioned values are summed before ids are given out, so no task
    holds all values."""
    first = rows.groupBy(*key).agg(F.min(order).alias("_first"))
    start = F.lit(0)
    if known is not None:
        first = first.join(known.select(*key), key, "left_anti")
        start = F.lit(known.agg(F.coalesce(F.max("db_idx"), F.lit(0))).first()[0])
    spark = rows.sparkSession
    sorted_ = cut(first.repartitionByRange("_first", *key).withColumn("_p", F.spark_partition_id()))  # ranges are drawn once
    counts = {r._p: r.n for r in sorted_.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # one row per range
    base, total = [], 0
    for p in sorted(counts):
        base.append((p, total))
        total += counts[p]
    offsets = F.broadcast(spark.createDataFrame(base or [(0, 0)], "_p int, _base long"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy("_first", *key))
    new = sorted_.join(offsets, "_p").select(*key, (start + F.col("_base") + within).cast("long").alias("db_idx"))
    return new if known is None else known.select(*key, "db_idx").unionByName(new)


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def dependencies(premises: DataFrame, path: str, origin: str, pos: str) -> DataFrame:
    """(file, dep, first_pos): the files that a file's premises come from, with the position of the first. ``path``
    is of the file itself, ``origin`` of the premise; one that contains the other's name is the same file. Paths that
    are not under ``repos`` are of no data point and give nothing."""
    name = F.nullif(F.regexp_extract(origin, r"repos/(.*\.v)", 1), F.lit(""))
    d = premises.select(T.data_point_name(F.col(path)).alias("file"), T.data_point_name(F.col(origin)).alias("dep"), name.alias("_name"), F.col(path).alias("_path"), F.col(pos).alias("_pos"))
    return d.where(~F.col("_path").contains(F.col("_name")) & ~F.col("_name").contains(F.col("_path"))).groupBy("file", "dep").agg(F.min("_pos").alias("first_pos"))


def of_dependencies(edges: DataFrame, per_file: DataFrame, *values: str) -> DataFrame:
    """(file, sums of the values over the files that it depends on); files that are not there add nothing."""
    e = edges.select("file", "dep").where("file != dep").distinct()
    return e.join(per_file.withColumnRenamed("file", "dep"), "dep").groupBy("file").agg(*[F.sum(v).alias(v) for v in values])


#: Premises of a file that are met at once.
CHUNK = 512


def visible_premises(steps: DataFrame, premises: DataFrame, edges: DataFrame, file: str, line: str, premise_line: str) -> DataFrame:
    """Steps with each premise they can see and whether it is their file's ``own``: those of their own file on earlier
    lines, and all of the files that it depends on. The pairs are the result; sums over them need no pair. A file's
    premises are dealt to chunks, each of which is met by the steps that see the file: a task has some chunks, and
    writes the premises of one again and again in the same order, which packs well."""
    e = edges.select(F.col("file").alias(file), F.col("dep").alias("_dep"), F.lit(False).alias("own")).where(F.col(file) != F.col("_dep")).distinct()
    asks = steps.withColumns({"_dep": F.col(file), "own": F.lit(True)}).unionByName(steps.join(e, file))
    parts = int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # rows are few and pairs are many: these are not merged
    chunks = premises.groupBy(F.col(file).alias("_dep")).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("_chunks"))
    asks = asks.join(chunks, "_dep").withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).drop("_chunks")
    there = premises.withColumnRenamed(file, "_dep").join(chunks, "_dep")
    there = there.withColumn("_chunk", F.pmod(F.xxhash64(premise_line), "_chunks").cast("int")).drop("_chunks")
    pairs = asks.repartition(parts, "_dep", "_chunk").join(there.repartition(parts, "_dep", "_chunk"), ["_dep", "_chunk"])
    return pairs.where(~F.col("own") | (F.col(premise_line) < F.col(line))).drop("_dep", "_chunk")


def positives(used: DataFrame, edges: DataFrame, step: str, file: str, premise: str, premise_file: str, pos: str) -> DataFrame:
    """``used`` (a step with a premise that it used) without premises that the step cannot see, numbered per step in
    the order of ``pos`` as ``nth``. A premise of the step's own file counts from an earlier line only."""
    e = edges.select(F.col("file").alias(file), F.col("dep").alias(premise_file)).where(F.col(file) != F.col(premise_file)).distinct()
    own = used.where((F.col(file) == F.col(premise_file)) & (F.col(premise) < F.col(step)))
    seen = own.unionByName(used.join(e, [file, premise_file], "left_semi"))
    return seen.withColumn("nth", F.row_number().over(Window.partitionBy(step).orderBy(pos, premise)).cast("long"))


def leakage_safe_split(files: DataFrame, test: Column, val: Column, file: str = "file", text: str = "text") -> DataFrame:
    """(file, split) of the rows (file, project, text): test and validation by project; a validation file that
    shares a text with test is dropped, and so is a training file that shares one with test or kept validation."""
    f = files.select(file, text, F.when(test, "test").when(val, "val").otherwise("train").alias("split")).distinct()
    t, v, r = (f.where(F.col("split") == s) for s in ("test", "val", "train"))
    leak = lambda a, b: a.join(b.select(text).distinct(), text, "left_semi").select(file).distinct()
    v = v.join(leak(v, t), file, "left_anti")
    r = r.join(leak(r, t.unionByName(v)), file, "left_anti")
    return t.unionByName(v).unionByName(r).select(file, "split").distinct()


def proportional_split(files: DataFrame, file: str, train: float, val: float, seed: str = "0") -> DataFrame:
    """(file, split): shuffled, the first floor(train n) and the next floor(val n), the rest for test. The rank of a
    file is what its hash has below it, counted over ranges, not in one task."""
    key = hash_order(seed, F.col(file))
    d = files.select(file).distinct().withColumn("_k", key)
    ranked = intern(d, ["_k"], "_k").join(d, "_k")
    n = d.agg(F.count("*").alias("_n"))
    a, b = F.floor(F.col("_n") * train), F.floor(F.col("_n") * val)
    return ranked.crossJoin(F.broadcast(n)).select(file, F.when(F.col("db_idx") <= a, "train").when(F.col("db_idx") <= a + b, "val").otherwise("test").alias("split"))


def sample_per_group(rows: DataFrame, by: list[str], key: Column, n: int | Column) -> DataFrame:
    """At most ``n`` rows of each group, in the order of a hash: sampling without replacement."""
    r = F.row_number().over(Window.partitionBy(*by).orderBy(key))
    return rows.withColumn("_r", r).where(F.col("_r") <= n).drop("_r")


def purity_mix(positives: DataFrame, negatives: DataFrame, by: str, item: str, purity: float) -> DataFrame:
    """Positives and as many sampled negatives as the purity asks for: int(n / purity) in all. Purity 0: only
    negatives; no positives: nothing."""
    if purity == 0:
        return negatives.select(by, item, F.lit(False).alias("positive"))
    n = positives.groupBy(by).agg((F.floor(F.count("*") / F.lit(purity)) - F.count("*")).alias("_n"))
    order = hash_order("purity", F.col(by), F.col(item))
    chosen = numbered(negatives, [by], [order, item], "_r").join(n, by).where("_r <= _n")
    return positives.select(by, item, F.lit(True).alias("positive")).unionByName(chosen.select(by, item, F.lit(False).alias("positive")))
