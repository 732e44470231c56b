"""Queries of scalar functions, and of the few that need Python."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gneiss.functions import goals as G
from gneiss.functions import structure as X
from gneiss.functions import text as T
from gneiss.functions.models import FORBIDDEN
from gneiss.operators.ranges import numbered
from gneiss.registry import query, table


@query(
    "theorem_name",
    "SELECT doc_id, CASE WHEN regexp_extract(text, '\\S+\\s+(\\S+?)[\\[\\]\\{\\}\\(\\):=,\\s]', 1) = '' THEN 'Anon' ELSE regexp_extract(text, '\\S+\\s+(\\S+?)[\\[\\]\\{\\}\\(\\):=,\\s]', 1) END AS name FROM documents",
)
def theorem_name(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.theorem_name(F.col("text")).alias("name"))


@query("normalize_ws", "SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS normal_md5 FROM documents")
def normalize_ws(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_ws(F.col("text"))).alias("normal_md5"))


@query(
    "path_clean",
    """WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages),
    s AS (SELECT page_id, CASE WHEN starts_with(path, 'm.') THEN substr(path, 3) ELSE path END AS path FROM p)
    SELECT page_id, split_part(path, '/', 1) || '/' || string_split(path, '/')[-1] AS path FROM s""",
)
def path_clean(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    p = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    p = p.withColumn("path", T.rebase(F.col("path"), "m.", ""))
    return p.select("page_id", T.ends_of_path(F.col("path")).alias("path"))


@query("data_point_name", "SELECT doc_id, replace(regexp_extract('x/repos/' || source || '/' || lang || '.v', 'repos/(.*\\.v)', 1), '/', '-') AS name, source || '/' || lang || '.v/' || doc_id || '-' || n_chars AS thm_key FROM documents")
def data_point_name(spark, sf_dir):
    path = F.concat(F.lit("x/repos/"), "source", F.lit("/"), "lang", F.lit(".v"))
    key = T.theorem_key(F.col("source"), F.concat("lang", F.lit(".v")), F.col("doc_id"), F.col("n_chars"))
    return table(spark, sf_dir, "documents").select("doc_id", T.data_point_name(path).alias("name"), key.alias("thm_key"))


@query("md5_key", "SELECT conv_id, turn, md5(conv_id || chr(10) || turn || chr(10) || text) AS key FROM conversations")
def md5_key(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.md5_key(F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("text")).alias("key"))


@query("sha256_key", "SELECT doc_id, sha256(text) AS key FROM documents")
def sha256_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"))


@query(
    "ansi_strip",
    "WITH s AS (SELECT doc_id, chr(27) || '[31m' || text || chr(27) || '[0m only 1: x' AS s FROM documents) SELECT doc_id, replace(regexp_replace(s, '\\x1b\\[\\d+m', '', 'g'), 'only 1: ', '') AS plain FROM s",
)
def ansi_strip(spark, sf_dir):
    s = F.concat(F.lit("\x1b[31m"), F.col("text"), F.lit("\x1b[0m only 1: x"))
    return table(spark, sf_dir, "documents").select("doc_id", F.replace(T.strip_ansi(s), F.lit("only 1: "), F.lit("")).alias("plain"))


@query(
    "goal_codec",
    "WITH g AS (SELECT conv_id, string_agg(replace(text, chr(10), ' '), chr(10) ORDER BY turn) AS h, min(role) AS goal FROM conversations GROUP BY conv_id) SELECT conv_id, h || chr(10) || chr(10) || goal AS goal_text, goal, len(string_split(h, chr(10)))::INTEGER AS n_hyps FROM g",
)
def goal_codec(spark, sf_dir):
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.replace("text", F.lit("\n"), F.lit(" ")).alias("t")))), lambda x: x["t"]).alias("h"), F.min("role").alias("goal"))
    g = g.withColumn("goal_text", T.goal_text(F.col("h"), F.col("goal"))).withColumn("back", T.goal_parts(F.concat(F.array_join("h", "\n"), F.lit("\n\n"), F.col("goal"))))
    return g.select("conv_id", "goal_text", F.col("back.goal").alias("goal"), F.size("back.hyps").alias("n_hyps"))


@query(
    "goal_score",
    "SELECT p_partkey, least(length(p_name), CASE WHEN abs(length(p_type) - length(p_name)) > length(p_name) THEN length(p_name) ELSE levenshtein(p_type, p_name) END)::INTEGER AS score FROM part",
)
def goal_score(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.goal_score(F.col("p_name"), F.array("p_type")).alias("score"))


@query(
    "goal_list_scores",
    """WITH g AS (SELECT l_orderkey, p_name AS goal, [p_type, p_brand, p_size::VARCHAR] AS hyps FROM lineitem JOIN part ON p_partkey = l_partkey),
    s AS (SELECT l_orderkey, goal, least(length(goal), list_min(list_transform(hyps, lambda h: levenshtein(goal, h)))) AS d FROM g)
    SELECT l_orderkey, round(-sum(d / length(goal)), 6) AS normalised, (-sum(d))::BIGINT AS plain FROM s GROUP BY l_orderkey""",
)
def goal_list_scores(spark, sf_dir):
    """The goals of an order are the names of its parts, each with three hypotheses."""
    hyps, name = F.array("p_type", "p_brand", F.col("p_size").cast("string")), F.col("p_name")
    parts = table(spark, sf_dir, "part").select("p_partkey", T.goal_score(name, hyps, True).alias("normalised"), T.goal_score(name, hyps).alias("plain"))
    goals = table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return goals.groupBy("l_orderkey").agg(F.round(T.goals_score(F.col("normalised")), 6).alias("normalised"), T.goals_score(F.col("plain")).alias("plain"))


@query("forbidden_content", "SELECT doc_id, regexp_matches(text, 'Theorem|Lemma|Proposition|Remark|Corollary|Property|Admitted\\.|admit\\.|Abort\\.') AS forbidden, regexp_matches(trim(text), '^[*+-]*$') AS focus_only FROM documents")
def forbidden_content(spark, sf_dir):
    forbidden = reduce(Column.__or__, [F.col("text").contains(x) for x in FORBIDDEN])
    return table(spark, sf_dir, "documents").select("doc_id", forbidden.alias("forbidden"), F.trim("text").rlike(r"^[*+-]*$").alias("focus_only"))


@query("success_key_json", """SELECT conv_id, turn, '{"file":"' || role || '","proof_idx":' || conv_id || ',"step_idx":' || turn || '}' AS step_id FROM conversations""")
def success_key_json(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct(F.col("role").alias("file"), F.col("conv_id").alias("proof_idx"), F.col("turn").alias("step_idx"))).alias("step_id"))


@query("attention_mask", "WITH t AS (SELECT doc_id, [n_chars % 5, n_chars % 7, doc_id % 5, doc_id % 7] AS ids FROM documents) SELECT doc_id, array_to_string(list_transform([1, 2, 3, 4], lambda i: CASE WHEN list_position(ids, 3) > 0 AND i >= list_position(ids, 3) THEN 1 ELSE 0 END), ',') AS mask FROM t")
def attention_mask(spark, sf_dir):
    ids = F.array(F.col("n_chars") % 5, F.col("n_chars") % 7, F.col("doc_id") % 5, F.col("doc_id") % 7)
    mask = T.position_of_section(ids, 3)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(mask, lambda x: x.cast("string")), ",").alias("mask"))


@query("last_characters", "SELECT doc_id, right(text, 255) AS name FROM documents")
def last_characters(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.last_characters(F.col("text"), 255).alias("name"))


@query("json_props", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("kill_comments", """SELECT doc_id, md5('a  "(* q *)" ' || replace(replace(replace(text, '(*', ''), '*)', ''), '"', '')) AS plain_md5 FROM documents""")
def kill_comments(spark, sf_dir):
    """Nested comments are removed; quoted ones outside comments stay."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("a (* b (* c *) *) \"(* q *)\" "), F.regexp_replace("text", r'\(\*|\*\)|"', ""), F.lit("(* \"*)\" *)")).alias("s"))
    return d.select("doc_id", F.md5(X.without_comments("s")).alias("plain_md5"))


@query("alpha_equiv", "SELECT doc_id, coalesce(text, '') = coalesce(text, '') AND doc_id % 3 = doc_id % 2 AND doc_id % 5 <> 0 AS equal FROM documents")
def alpha_equiv(spark, sf_dir):
    """Syntax trees that are equal up to the names that they bind; locations do not count, free names do."""
    d = table(spark, sf_dir, "documents")

    def tree(bound: str, used, n: int):
        text, loc = F.to_json(F.array(F.coalesce("text", F.lit("")))), F.coalesce("doc_id" if n == 2 else "n_chars", F.lit(0)).cast("string")
        use = F.concat(F.lit('["Ser_Qualid",["DirPath",[]],["Id","'), used, F.lit('"]]'))
        body = F.concat(F.lit('["CApp",'), text, F.lit(","), use, F.lit(","), (F.col("doc_id") % n).cast("string"), F.lit("]"))
        return F.concat(F.lit('["CLambdaN",{"loc":'), loc, F.lit(',"v":'), body, F.lit(f'}},["CLocalAssum",["Name",["Id","{bound}"]]]]'))

    free = F.when(F.col("doc_id") % 5 == 0, F.lit("x-bound")).otherwise(F.lit("y-bound"))
    return d.select("doc_id", G.alpha_equal(tree("x-bound", F.lit("x-bound"), 3), tree("y-bound", free, 2)).alias("equal"))


@query(
    "goals_as_hard",
    """WITH h AS (SELECT DISTINCT l_orderkey AS k, l_linestatus AS r, l_partkey % 3 AS i, l_suppkey % 3 AS j FROM lineitem),
    n AS (SELECT o_orderkey AS k, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS other FROM orders),
    p AS (SELECT k, other, m, [m % 3, m // 3 % 3, m // 9] AS f FROM n, range(27) t(m) WHERE other IS NOT NULL),
    g AS (SELECT * FROM p WHERE f[k % 3 + 1] = other % 3),
    w AS (SELECT g.k, g.m FROM g JOIN h a ON a.k = g.k LEFT JOIN h b ON b.k = g.other AND b.r = a.r AND b.i = g.f[a.i + 1] AND b.j = g.f[a.j + 1] WHERE b.k IS NULL),
    s AS (SELECT DISTINCT k FROM (SELECT k, m FROM g EXCEPT SELECT k, m FROM w))
    SELECT n.k AS goal, n.other AS other, s.k IS NOT NULL AS as_hard FROM n LEFT JOIN s USING (k) WHERE n.other IS NOT NULL""",
)
def goals_as_hard(spark, sf_dir):
    """Whether an order's goal is as hard as that of its customer's next order: each line is a hypothesis that relates
    two of three variables, the goal is about one; how variables correspond has to be found."""
    use = lambda n: F.concat(F.lit('["Ser_Qualid",["DirPath",[]],["Id","x'), n.cast("string"), F.lit('"]]'))
    line = F.concat(
        F.lit('{"ids":["H'), F.col("l_linenumber").cast("string"), F.lit('"],"ast":["CApp",'), F.to_json(F.array("l_linestatus")), F.lit(","),
        use(F.col("l_partkey") % 3), F.lit(","), use(F.col("l_suppkey") % 3), F.lit("]}"),
    )
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("goal")).agg(F.array_join(F.sort_array(F.collect_list(line)), ",").alias("lines"))
    types, goal = F.lit('{"hyps":[{"ids":["x0","x1","x2"],"ast":"nat"}'), F.concat(F.lit('],"goal":["CApp","G",'), use(F.col("goal") % 3), F.lit("]}"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("goal"), "o_custkey")
    asked = orders.join(lines, "goal", "left").select("goal", F.concat(types, F.coalesce(F.concat(F.lit(","), "lines"), F.lit("")), goal).alias("tree"))
    turn = numbered(orders, ["o_custkey"], ["goal"], "n")
    pairs = turn.join(turn.select("o_custkey", F.col("goal").alias("other"), (F.col("n") - 1).alias("n")), ["o_custkey", "n"]).select("goal", "other")
    both = pairs.join(asked, "goal").join(asked.withColumnsRenamed({"goal": "other", "tree": "other_tree"}), "other")
    return both.select("goal", "other", G.hard_as("tree", "other_tree").alias("as_hard"))


@query(
    "obligation_coverage",
    """WITH s AS (SELECT o_orderkey AS k, list(DISTINCT l_linenumber % 4) AS given, list(DISTINCT l_suppkey % 4) AS needed FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
    SELECT k, len(list_filter(needed, lambda z: NOT list_contains(given, z))) = 0 AS covered FROM s""",
)
def obligation_coverage(spark, sf_dir):
    """Whether every obligation that is needed has one given that is as hard."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    goals = lambda c: F.to_json(F.transform(F.collect_set(F.col(c) % 4), lambda x: F.struct(F.array().cast("array<string>").alias("hyps"), x.alias("goal"))))
    s = o.groupBy(F.col("o_orderkey").alias("k")).agg(goals("l_linenumber").alias("given"), goals("l_suppkey").alias("needed"))
    return s.select("k", G.covers("given", "needed").alias("covered"))


@query("located_trees", "SELECT event_id, '{\"k\":' || (props->>'$.k') || ',\"tree\":[\"f\",' || user_id || ']}' AS tree FROM events")
def located_trees(spark, sf_dir):
    """Trees without what says where they stand in a file."""
    k = F.get_json_object("props", "$.k").cast("long")
    inner = F.struct(k.alias("k"), F.array(F.lit("f"), F.col("user_id").cast("string")).alias("tree"), F.struct(F.col("event_id").alias("line")).alias("loc"), F.lit("here").alias("location"))
    text = F.regexp_replace(F.to_json(inner), r'"(\d+)"', "$1")
    return table(spark, sf_dir, "events").select("event_id", X.unlocated(text).alias("tree"))
