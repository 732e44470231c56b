"""Record linkage: occurrences of texts in files, overlapping ranges, classified failures."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import text as T
from gneiss.operators.ranges import numbered
from gneiss.store import cut

#: Places as one number: lines of fewer characters than this.
LINE = 1 << 31
#: Lines in one bin when ranges of places meet.
BIN = 32
#: Files whose texts a task holds as Python strings, and places that it holds before it hands them on.
FILES_AT_ONCE, PLACES_AT_ONCE = 64, 10_000

# Names of projects that differ between data sets.
PROJECT_NAMES = {
    ".": "compcert",
    "AbsInt-CompCert": "compcert",
    "coq-community-buchberger": "buchberger",
    "coq-community-coq-ext-lib": "ext-lib",
    "coq-community-dblib": "dblib",
    "coq-community-fourcolor": "fourcolor",
    "coq-community-hoare-tut": "hoare-tut",
    "coq-community-huffman": "huffman",
    "coq-community-math-classes": "math-classes",
    "coq-community-reglang": "reglang",
    "coq-community-zorns-lemma": "zorns-lemma",
    "coq-contribs-zfc": "zfc",
    "thery-PolTac": "poltac",
    "Coq-BB5": "bb5",
    "PnVRocqLib": "pnvrocqlib",
    "semantic-preservation": "semantic-preservation",
}


def renamed(project: Column, names: dict[str, str] = PROJECT_NAMES) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.element_at(table, project), project)


def found_in(files: DataFrame, records: DataFrame, by: str, text: str, statement: str, block: int = 1000) -> DataFrame:
    """(by, statement, spot, line, column, end_line, end_column): every place, overlapping ones included, where a
    statement of a record stands in the file of its key.

    A file's distinct statements are dealt to blocks of about ``block``, and one automaton a block goes once over the
    text, so a text is copied once a block and read in linear time, whatever is found. Lines and columns count from 0;
    the end is the place after the last character, on that character's line. A line break is the last place of no line:
    it counts as column -1 of the next. Null or empty statements and null texts have no places.
    """
    needles = records.select(F.col(by).alias("_file"), F.col(statement).alias("_needle")).where("_needle != ''").distinct()
    many = needles.groupBy("_file").agg(F.count("*").alias("_n"))
    dealt = needles.join(many, "_file").withColumn("_block", F.pmod(F.xxhash64("_needle"), F.ceil(F.col("_n") / block)))
    blocks = dealt.groupBy("_file", "_block").agg(F.collect_list("_needle").alias("_needles"))
    met = files.select(F.col(by).alias("_file"), F.col(text).alias("_text")).where("_text IS NOT NULL").join(blocks, "_file").select("_file", "_text", "_needles")
    kind = files.schema[by].dataType.simpleString()
    names = [by, statement, "spot", "line", "column", "end_line", "end_column"]
    schema = f"`{by}` {kind}, `{statement}` string, " + ", ".join(f"{c} int" for c in names[2:])

    def places(breaks: np.ndarray, spots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        line = np.searchsorted(breaks, spots, side="right") - 1
        return line, spots - breaks[line] - 1

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, FILES_AT_ONCE):
                b = whole.slice(at, FILES_AT_ONCE)
                for k, (content, some) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                    tree = ahocorasick.Automaton()
                    for x in some:
                        tree.add_word(x, x)
                    tree.make_automaton()
                    breaks = np.array([-1, *(m.start() for m in re.finditer("\n", content))])
                    hits = tree.iter(content)
                    while part := list(islice(hits, 10_000)):  # what is held does not grow with what is found
                        last = np.array([e for e, _ in part])
                        said = [x for _, x in part]
                        first = last - np.array(list(map(len, said))) + 1
                        (line, column), (end_line, end_column) = places(breaks, first), places(breaks, last)
                        numbers = [pa.array(c, pa.int32()) for c in (first, line, column, end_line, end_column + 1)]
                        file = pa.chunked_array([b.column(0).slice(k, 1)]).take(pa.array(np.zeros(len(part), np.int64))).combine_chunks()
                        held.append(pa.RecordBatch.from_arrays([file, pa.array(said, pa.string()), *numbers], names))
                        n += len(part)
                        if n >= PLACES_AT_ONCE:  # files with few places share a batch
                            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                            held, n = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return met.mapInArrow(search, schema)


def overlap(a: DataFrame, b: DataFrame, by: list[str], width: int) -> DataFrame:
    """Pairs of half-open ranges (a_start, a_end) and (b_start, b_end) that meet. Ranges are dealt to bins of
    ``width``; a pair is kept in the bin where the later of the two starts, so it comes once."""
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.greatest(F.col(e) - 1, F.col(s))) / width)))
    x = a.where("a_start < a_end").withColumn("_bin", bins("a_start", "a_end"))
    y = b.where("b_start < b_end").withColumn("_bin", bins("b_start", "b_end"))
    meet = x.join(y, [*by, "_bin"]).where("a_start < b_end AND b_start < a_end")
    return meet.where(F.col("_bin") == F.floor(F.greatest("a_start", "b_start") / width)).drop("_bin")


def first_ancestor(paths: DataFrame, folders: DataFrame, path: str, folder: str, order: str) -> DataFrame:
    """The first folder, in order, that is an ancestor of a path: the path's own ancestors are looked up, so paths
    are not compared with all folders."""
    parts = F.split(F.col(path), "/", -1)
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    j = paths.withColumn(folder, F.explode(up)).join(folders, folder)
    n = F.row_number().over(Window.partitionBy(path).orderBy(order, folder))
    return j.withColumn("_n", n).where("_n = 1").drop("_n")


def containments(names: DataFrame, group: str, name: str, size: int = 3) -> DataFrame:
    """(group, t, u): each distinct name t with each name u of its group that it holds, itself included. Both sides
    meet on the first ``size`` characters of u; shorter names, which are few distinct ones, meet on all they have."""
    n = names.select(F.col(group).alias("_g"), F.col(name).alias("_t")).distinct()
    small = F.col("_t").alias("_u")
    lengths = F.sequence(F.lit(0), F.least(F.length("_t"), F.lit(size)))
    begins = n.select("_g", small, F.substring("_t", 1, size).alias("_k"))
    pieces = F.flatten(F.transform(lengths, lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length("_t") - k + 1, F.lit(1))), lambda i: F.substring("_t", i, k))))
    inside = n.select("_g", "_t", F.explode(F.array_distinct(pieces)).alias("_k"))
    met = inside.join(begins, ["_g", "_k"]).where(F.col("_t").contains(F.col("_u")))
    return met.select(F.col("_g").alias(group), F.col("_t").alias("t"), F.col("_u").alias("u"))


def same_names(records: DataFrame, group: str, name: str, order: str) -> DataFrame:
    """``records`` with ``n_same``, how many of the group have a name that holds theirs or is held by it, themselves
    included, and ``nth``, how many of those come before in ``order``, which tells records of a group apart.

    Names are compared, not records: a name's peers are listed once a name that they go with, so that many records of
    one name are as many rows and not as many pairs.
    """
    one = containments(records.where(F.col(group).isNotNull() & F.col(name).isNotNull()), group, name)
    pairs = one.unionByName(one.where("t != u").select(group, F.col("u").alias("t"), F.col("t").alias("u"))).distinct()
    mine = records.select(group, F.col(name).alias("u"), F.col(order).alias("_o"))
    listed = numbered(mine.join(pairs, [group, "u"]), [group, "t"], ["_o"], "_nth")
    many = listed.groupBy(group, "t").agg(F.count("*").alias("n_same"))
    own = listed.where("t = u").select(group, "t", "_o", (F.col("_nth") - 1).alias("nth")).join(many, [group, "t"])
    return records.join(own.withColumnsRenamed({"t": name, "_o": order}), [group, name, order])


def theorem_steps(theorems: DataFrame, steps: DataFrame) -> DataFrame:
    """``theorems`` (file, theorem, statement, line) with ``step``: the first of the ``steps`` (file, step, text, line) of
    the file that begins on the theorem's line and holds its statement, both with single spaces; null if none does."""
    here = steps.select("file", "line", "step", T.normalize_ws(F.col("text")).alias("_text"))
    asked = theorems.withColumn("_said", T.normalize_ws(F.col("statement")))
    met = asked.join(here, ["file", "line"]).where(F.col("_text").contains(F.col("_said")))
    first = met.groupBy("file", "theorem").agg(F.min("step").alias("step"))
    return theorems.join(first, ["file", "theorem"], "left")


def link(records: DataFrame, files: DataFrame, theorems: DataFrame, bad: DataFrame) -> DataFrame:
    """(file, record, mode, theorem): which theorem each record of another tool is, or why that cannot be told.

    ``records`` (file, record, statement): ``record`` tells those of a file apart and orders them. ``files`` (file,
    text). ``theorems`` (file, theorem, line, column, end_line, end_column), ends open. ``bad`` (file, statement, nth):
    places among the records of like statements that are known to have no theorem.

    A record's candidates are the theorems that a place of its statement meets, once for each place. None of one:
    "file missing" (no such file), "theorem missing" (not in the text) or "theorem mismatch" (no theorem there). One is
    the record's. Of several, a record takes the one at its own number among the file's records of like statements (one
    holds the other); if there are not as many of these as candidates it is "ambiguous", and if its number is a bad one
    it is a "bad theorem". Records without a file or a statement have their file missing or their theorem missing.
    """
    hits = cut(found_in(files, records, "file", "text", "statement"))  # texts are searched once
    place = lambda line, column: F.col(line).cast("long") * LINE + F.col(column)
    a = hits.select("file", "statement", place("line", "column").alias("a_start"), place("end_line", "end_column").alias("a_end"))
    b = theorems.select("file", "theorem", place("line", "column").alias("b_start"), place("end_line", "end_column").alias("b_end"))
    met = cut(overlap(a, b, ["file"], BIN * LINE).select("file", "statement", "a_start", "b_start", "theorem"))
    count = met.groupBy("file", "statement").agg(F.count("*").alias("n"), F.min("theorem").alias("only"))
    several = count.where("n > 1")
    found = hits.groupBy("file", "statement").agg(F.lit(True).alias("found"))

    # records with several candidates, and which of them is theirs
    peers = records.join(several.select("file").distinct(), "file", "left_semi").select("file", "statement", "record")
    known = bad.groupBy("file", "statement").agg(F.sort_array(F.collect_set(F.col("nth").cast("long"))).alias("out"))
    like = same_names(peers, "file", "statement", "record").join(several.select("file", "statement", "n"), ["file", "statement"])
    like = like.join(known, ["file", "statement"], "left").withColumn("out", F.coalesce("out", F.array().cast("array<bigint>")))
    before = F.size(F.filter("out", lambda i: i < F.col("nth")))
    like = like.select(
        "file", "statement", "record",
        F.when(F.array_contains("out", F.col("nth")), "bad theorem").when(F.col("n_same") - F.size("out") != F.col("n"), "ambiguous").otherwise("linked").alias("choice"),
        (F.col("nth") - before + 1).alias("at"),
    )
    ordered = numbered(met.join(several.select("file", "statement"), ["file", "statement"]), ["file", "statement"], ["a_start", "b_start", "theorem"], "at")
    chosen = like.join(ordered.select("file", "statement", "at", F.col("theorem").alias("chosen")), ["file", "statement", "at"], "left").drop("at", "statement")

    there = files.select("file").distinct().withColumn("there", F.lit(True))
    r = records.select("file", "record", "statement").join(there, "file", "left").join(found, ["file", "statement"], "left")
    r = r.join(count, ["file", "statement"], "left").join(chosen, ["file", "record"], "left")
    mode = (
        F.when(F.col("there").isNull(), "file missing")
        .when(F.col("found").isNull(), "theorem missing")
        .when(F.col("n").isNull(), "theorem mismatch")
        .when(F.col("n") == 1, "linked")
        .otherwise(F.col("choice"))
    )
    return r.withColumn("mode", mode).select("file", "record", "mode", F.when(F.col("mode") == "linked", F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("chosen"))).alias("theorem"))
