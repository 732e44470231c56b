"""Fuzzy line dedup by MinHash, in DataFrame functions only.

A line is the set of its character shingles: the ``k`` characters from each character on; a line of fewer
characters is one shingle. Shingles are hashed once; the permutations are the hash with constants xored in, whose
minima are taken in one aggregate that also folds equal lines. Minima are banded for high recall.

Within a bucket lines are tied to its pivot, the most central line, which meets most others over all its buckets;
ties are checked by the exact Jaccard similarity of the shingle sets. Then the pivot is done there, lines that were
linked are one component, and what is still in several components gets another pivot, for a few rounds. What is
apart even then is compared exactly: all pairs of small buckets, and in large ones, where template lines meet, all
pairs that share one of their rarest shingles, as any pair at the threshold does. Of a component the first
occurrence in the order of (id, line number) stays.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.components import components
from gneiss.llm.store import cut, free

#: Shingles that are hashed in one row.
BLOCK = 8


def starts(points: Column, k: int) -> Column:
    """Where the shingles of a line begin in its code points of four bytes each; one, if it has no more than ``k``."""
    return F.sequence(F.lit(0), F.greatest(F.lit(0), F.octet_length(points) - F.lit(4 * k)), F.lit(4))


def shingle(points: Column, at: Column, k: int) -> Column:
    """The hash of the ``k`` characters from there on. Bytes are cut out at once, where characters are searched."""
    return F.xxhash64(F.substring(points, at + 1, F.lit(4 * k)))


def hashed(line: Column, k: int) -> Column:
    """The shingle hashes, with repeats; never empty."""
    points = F.array(F.encode(line, "UTF-32"))  # in an array, so that it is made once and not for each shingle
    return F.transform(points, lambda b: F.transform(starts(b, k), lambda i: shingle(b, i, k)))[0]


def blocks(lines: DataFrame, k: int) -> DataFrame:
    """A row for every ``BLOCK`` shingles of a line, with their hashes as columns h0, h1, ... instead of ``line``. At the
    end of a line its last shingle is repeated."""
    names = [c for c in lines.columns if c != "line"]
    each = lines.select(*names, F.encode("line", "UTF-32").alias("b"))
    each = each.withColumn("last", F.greatest(F.lit(0), F.octet_length("b") - F.lit(4 * k)))
    each = each.select(*names, "b", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(4 * BLOCK))).alias("i"))
    return each.select(*names, *[shingle(F.col("b"), F.least(F.col("i") + 4 * j, F.col("last")), k).alias(f"h{j}") for j in range(BLOCK)])


def rare_pairs(sets: DataFrame, k: int, threshold: float, front: int = 8) -> DataFrame:
    """(a, b): all pairs of unlike components that can reach the threshold, and few others. ``sets``: d1, c, line, n.

    Prefix filtering with shingles in the order of (lines that have them, hash): of a pair at the threshold, the
    first common shingle is among the first n - ceil(t n) + 1 of the larger set and among the first
    n - ceil(2 t / (1 + t) n) + 1 of the smaller, and enough shingles stand behind it in both. Where two lines also
    share one of the ``front`` shingles before it in both, they have met there, and the pair is not made again: lines
    over one passage share long runs. ``front`` only bounds how often a pair is made; none is lost by it."""
    each = sets.select("d1", "c", "n", F.explode(F.array_distinct(hashed(F.col("line"), k))).alias("h"))
    each = each.join(each.groupBy("h").agg(F.count("*").alias("df")), "h")
    ranked = each.groupBy("d1", "c", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("s"))
    upto = lambda part: (F.col("n") - F.ceil(F.col("n") * part - 1e-9) + 1).cast("int")
    ranked = ranked.select("d1", "c", "n", upto(2 * threshold / (1 + threshold)).alias("own"), F.slice("s", 1, upto(threshold)).alias("s"))
    ranked = ranked.select("d1", "c", "n", "own", F.col("s.h").alias("prefix"), F.posexplode("s").alias("i", "s")).where("s.df > 1")
    before = F.slice("prefix", F.greatest(F.lit(1), F.col("i") + 1 - front), F.least(F.col("i"), F.lit(front)))
    ranked = cut(ranked.select("d1", "c", "n", "own", "i", F.col("s.h").alias("h"), before.alias("before")))
    x = ranked.where("i < own").select("h", F.col("d1").alias("a"), F.col("c").alias("ac"), F.col("n").alias("an"), F.col("i").alias("ai"), F.col("before").alias("af"))
    y = ranked.select("h", F.col("d1").alias("b"), F.col("c").alias("bc"), F.col("n").alias("bn"), F.col("i").alias("bi"), F.col("before").alias("bf"))
    fits = (F.col("an") >= threshold * F.col("bn")) & (F.least(F.col("an") - F.col("ai"), F.col("bn") - F.col("bi")) >= (F.col("an") + F.col("bn")) * (threshold / (1 + threshold)) - 1e-9)
    return x.join(y, "h").where("ac != bc AND (an < bn OR (an = bn AND a < b))").where(fits).where(~F.arrays_overlap("af", "bf")).select("a", "b", "ac", "bc")


def signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def line_groups(lines: DataFrame, k: int, threshold: float, bands: int, rows: int, rounds: int = 4, small: int = 16) -> tuple[DataFrame, DataFrame]:
    """(line hashes that stand for several lines; the component of every line hash that is linked with another).
    ``lines``: doc_id, line, d1, d2. Lines whose hashes collide have no links. ``rounds``: pivots of a bucket;
    ``small``: members of a bucket that are left apart by them up to which all its pairs are made."""
    r = random.Random(11)
    masks = [signed(r.getrandbits(64)) for _ in range(bands * rows)]
    # the least of a block first: the aggregate is updated once for a block and not for each shingle
    minima = [F.min(F.least(*[F.col(f"h{j}").bitwiseXOR(F.lit(m)) for j in range(BLOCK)])).alias(f"m{i}") for i, m in enumerate(masks)]
    folded = blocks(lines.select("doc_id", "d1", "d2", "line"), k).groupBy("d1").agg(F.min("d2").alias("low"), F.max("d2").alias("high"), F.min("doc_id").alias("doc_id"), *minima)
    keys = F.array(*[F.xxhash64(F.lit(b), *[F.col(f"m{b * rows + i}") for i in range(rows)]) for b in range(bands)])
    folded = cut(folded.select("d1", "doc_id", (F.col("low") != F.col("high")).alias("clash"), keys.alias("keys")))
    clash = cut(folded.where("clash").select("d1"))
    folded = folded.where("NOT clash")
    key = folded.select(F.col("d1").alias("node"), F.explode("keys").alias("key"))
    shared = cut(key.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1"))
    central = cut(shared.groupBy("node").agg(F.sum("n").alias("met")))
    wanted = cut(folded.select("d1", "doc_id").join(central.select(F.col("node").alias("d1")), "d1", "left_semi"))
    text = lines.select("doc_id", "d1", "line").join(wanted, ["d1", "doc_id"]).groupBy("d1").agg(F.first("line").alias("line"))
    sets = cut(text.select("d1", "line", F.size(F.array_distinct(hashed(F.col("line"), k))).alias("n")))
    left = cut(shared.join(central, "node").select("key", "node", "met", F.col("node").alias("c")))
    for table in (folded, shared, central, wanted):
        free(table)

    def confirmed(ties: DataFrame) -> DataFrame:
        """By size first; then texts are carried, as sets are eight times as large."""
        of = lambda name, n, line: sets.select(F.col("d1").alias(name), *([F.col("n").alias(n)] if n else [F.col("line").alias(line)]))
        near = F.least("an", "bn") >= threshold * F.greatest("an", "bn")
        ties = ties.join(of("a", "an", None), "a").join(of("b", "bn", None), "b").where(near)
        both = F.size(F.array_intersect(hashed(F.col("x"), k), hashed(F.col("y"), k)))
        like = F.exists(F.array(both), lambda m: m >= threshold * (F.col("an") + F.col("bn") - m))  # counted once
        return ties.join(of("a", None, "x"), "a").join(of("b", None, "y"), "b").where(like).select("a", "b", "ac", "bc")

    def pairs(ties: DataFrame) -> DataFrame:
        """Each pair of different components once, smaller hash first."""
        turned = F.col("a") > F.col("b")
        way = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x)
        return ties.where("ac != bc").select(way("a", "b"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"), way("ac", "bc"), F.when(turned, F.col("ac")).otherwise(F.col("bc")).alias("bc")).distinct()

    group, tested = None, None
    for last in [False] * rounds + [True]:
        if last:
            size = cut(left.groupBy("key").agg(F.count("*").alias("m")))
            few = left.join(size.where(F.col("m") <= small), "key")
            few = few.select("key", F.col("node").alias("a"), F.col("c").alias("ac")).join(few.select("key", F.col("node").alias("b"), F.col("c").alias("bc")), "key").where("a < b")
            many = left.join(size.where(F.col("m") > small), "key").select(F.col("node").alias("d1"), "c").distinct().join(sets, "d1")
            asked = pairs(few.select("a", "b", "ac", "bc").unionByName(rare_pairs(many, k, threshold)))
        else:
            pivots = cut(left.groupBy("key").agg(F.max(F.struct("met", "node", "c")).alias("p")).select("key", F.col("p.node").alias("b"), F.col("p.c").alias("bc")))
            left = left.join(pivots, "key")
            asked = pairs(left.select(F.col("node").alias("a"), F.col("c").alias("ac"), "b", "bc"))
        if tested is not None:
            asked = asked.join(tested, ["a", "b"], "left_anti")
        asked = cut(asked)
        links = cut(confirmed(asked).select(F.col("ac").alias("a"), F.col("bc").alias("b")))
        merged = components(links).withColumnsRenamed({"node": "c", "component": "to"})
        free(links)
        if group is None:
            group = merged.withColumnsRenamed({"c": "node", "to": "c"})
        else:
            group = group.join(merged, "c", "left").select("node", F.coalesce("to", "c").alias("c")).unionByName(merged.select(F.col("c").alias("node"), F.col("to").alias("c")).join(group, "node", "left_anti"))
        group = cut(group)
        if last:
            break
        tested = asked.select("a", "b") if tested is None else tested.unionByName(asked.select("a", "b"))
        # a pivot is done in its bucket; buckets within one component are done
        left = left.where("node != b").join(group.select("node", F.col("c").alias("to")), "node", "left").select("key", "node", "met", F.coalesce("to", "c").alias("c"))
        left = cut(left)
        open_ = left.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low != high").select("key")
        left = cut(left.join(open_, "key"))
        if left.isEmpty():
            break
    return clash, group


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 10, threshold: float = 0.8, bands: int = 9, rows: int = 3) -> DataFrame:
    """The rows of ``docs`` with the text that is left, n_lines and n_removed (columns with these names give way).

    Lines are what stands between line ends. Of each component of similar lines (Jaccard similarity of at least
    ``threshold``) the first occurrence is kept and the others are removed, in the same document too. Blank lines
    are never removed. A pair at the threshold of 0.8 meets in a band with probability 1 - (1 - 0.8^3)^9 = 0.998,
    one at 0.9 with 0.99999; no pair that meets is left out. Lines whose hashes collide are only compared for
    equality. Null texts stay null and have no lines; an empty text is one blank line. Rows with a null id take no
    part; rows that repeat an id with its text are one document, with another text they are documents of their
    own, ordered by a hash of it. Long lines and texts are whole. No rows: no rows.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    split = F.split("text", "\n", -1)
    lines = d.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(split).alias("pos", "line")).where(F.col("line").rlike(r"\S"))
    lines = lines.withColumns({"d1": F.xxhash64("line"), "d2": F.xxhash64(F.lit(7), "line")})
    clash, group = line_groups(lines, k, threshold, bands, rows)
    known = lines.select("doc_id", "version", "pos", "d1", "d2").join(clash.withColumn("clash", F.lit(True)), "d1", "left").join(group.withColumnRenamed("node", "d1"), "d1", "left")
    known = cut(known.select("doc_id", "version", "pos", F.when(F.col("clash"), F.xxhash64("d1", "d2")).otherwise(F.coalesce("c", "d1")).alias("component")))
    place = F.struct("doc_id", "version", "pos")
    first = cut(known.groupBy("component").agg(F.min(place).alias("first"), F.max(place).alias("final")).where("first != final").select("component", "first"))
    gone = known.join(first, "component").where(place != F.col("first"))
    drop = gone.groupBy(F.col("doc_id").alias("__gneiss_id"), F.col("version").alias("__gneiss_version")).agg(F.collect_set("pos").alias("__gneiss_drop"))
    size = F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1
    own = (docs[id_col].cast("long") == drop["__gneiss_id"]) & (F.xxhash64(docs[text_col]) == drop["__gneiss_version"])
    out = docs.select(names).join(drop, own, "left")
    # split once, as a column of its own: inside the function below it would be split again for every line
    out = out.withColumn("__gneiss_lines", F.when(F.col("__gneiss_drop").isNotNull(), F.split(F.col(text_col), "\n", -1)))
    every = F.col("__gneiss_lines")
    kept = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col("__gneiss_drop"))
    left = F.array_join(F.transform(kept, lambda i: F.get(every, i)), "\n")
    text = F.when(F.col("__gneiss_drop").isNull(), F.col(text_col)).otherwise(left)
    out = out.select(*[text.alias(c) if c == text_col else F.col(c) for c in names], F.coalesce(size, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("__gneiss_drop"), F.lit(0)).cast("long").alias("n_removed"))
    return out


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(t) AS line, generate_subscripts(t, 1) AS pos FROM d),
n AS (SELECT line, row_number() OVER (ORDER BY line) AS id FROM (SELECT DISTINCT line FROM l WHERE regexp_matches(line, '[^ \t\n\f\r\x0b]'))),
s AS (SELECT DISTINCT id, substr(line, i, 10) AS g FROM (SELECT id, line, unnest(range(1, greatest(length(line) - 9, 1) + 1)) AS i FROM n)),
z AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
k AS (SELECT a, b FROM p JOIN z x ON x.id = a JOIN z y ON y.id = b WHERE 10 * common >= 8 * (x.n + y.n - common)),
e AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r AS (SELECT a AS id, a AS reach FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.reach = e.a),
c AS (SELECT id, min(reach) AS c FROM r GROUP BY id),
o AS (SELECT doc_id, pos, line, coalesce(c, n.id) AS c FROM l LEFT JOIN n USING (line) LEFT JOIN c USING (id)),
f AS (SELECT *, c IS NOT NULL AND row_number() OVER (PARTITION BY c ORDER BY doc_id, pos) > 1 AS gone FROM o),
t AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, CASE WHEN d.text IS NOT NULL THEN sha256(kept) END AS kept_sha256 FROM documents d LEFT JOIN t USING (doc_id)
"""
