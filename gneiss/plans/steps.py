"""Queries over ordered steps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gneiss.functions import text as T
from gneiss.operators import steps as S
from gneiss.operators.ranges import numbered
from gneiss.registry import query, table
from gneiss.store import cut


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


@query(
    "proof_prefix",
    """SELECT conv_id, turn, md5(coalesce(string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS prefix_md5 FROM conversations""",
)
def proof_prefix(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", F.md5(S.prefix(F.col("text"), ["conv_id"], ["turn"])).alias("prefix_md5"))


@query(
    "remaining_steps",
    """SELECT conv_id, turn, count(*) OVER w AS n_left, md5(string_agg(text, '|') OVER w) AS rest_md5 FROM conversations
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
)
def remaining_steps(spark, sf_dir):
    d = turns(spark, sf_dir).withColumn("rest", S.remaining(F.col("text"), ["conv_id"], ["turn"]))
    return d.select("conv_id", "turn", F.size("rest").cast("long").alias("n_left"), F.md5(F.array_join("rest", "|")).alias("rest_md5"))


@query("proof_text", "SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS proof_md5, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY conv_id")
def proof_text(spark, sf_dir):
    return S.whole_text(turns(spark, sf_dir), ["conv_id"], "turn", "text").select("conv_id", F.md5("proof_text").alias("proof_md5"), F.length("proof_text").cast("long").alias("n_chars"))


@query(
    "sessionize_steps",
    """WITH l AS (SELECT *, event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, user_id, (sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::INTEGER AS session FROM l""",
)
def sessionize_steps(spark, sf_dir):
    return S.sessions(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "user_id", "session")


@query(
    "token_budget",
    f"""WITH t AS (SELECT doc_id, source, len(regexp_extract_all(text, '{T.TOKEN}')) AS n FROM documents),
    u AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM t)
    SELECT source, doc_id, used::BIGINT AS used FROM u WHERE used <= 4000""",
)
def token_budget(spark, sf_dir):
    d = cut(table(spark, sf_dir, "documents").select("source", "doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n")))  # read twice
    return S.within_budget(d, ["source"], ["doc_id"], F.col("n"), 4000).select("source", "doc_id", "used")


@query("truncate_front", f"SELECT doc_id, array_to_string(regexp_extract_all(text, '{T.TOKEN}')[-20:], ' ') AS kept FROM documents")
def truncate_front(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(S.truncate(T.tokens(F.col("text")), 20, True), " ").alias("kept"))


@query("truncate_back", f"SELECT doc_id, array_to_string(regexp_extract_all(text, '{T.TOKEN}')[1:20], ' ') AS kept FROM documents")
def truncate_back(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.first_tokens(F.col("text"), 20), " ").alias("kept"))


@query(
    "truncate_lines",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    s AS (SELECT *, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS used FROM l)
    SELECT d.doc_id, coalesce(md5(k), md5('')) AS kept_md5 FROM documents d LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS k FROM s WHERE used <= 400 GROUP BY doc_id) USING (doc_id)""",
)
def truncate_lines(spark, sf_dir):
    lines = F.split("text", "\n", -1)
    kept = S.line_suffix(lines, F.transform(lines, lambda x: F.length(x).cast("long")), 400)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(kept, "\n")).alias("kept_md5"))


@query(
    "prefix_lines",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
    SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY i)) AS before_md5 FROM l WHERE i <= 3 GROUP BY doc_id""",
)
def prefix_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(F.slice(F.split("text", "\n", -1), 1, 3), "\n")).alias("before_md5"))


@query(
    "neighbour_check",
    """SELECT conv_id, turn, coalesce(lag(turn) OVER w < turn, true) AND coalesce(turn < lead(turn) OVER w, true) AS in_order FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
)
def neighbour_check(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    ok = F.coalesce(F.lag("turn").over(w) < F.col("turn"), F.lit(True)) & F.coalesce(F.col("turn") < F.lead("turn").over(w), F.lit(True))
    return turns(spark, sf_dir).select("conv_id", "turn", ok.alias("in_order"))


@query(
    "strike_runs",
    """WITH e AS (SELECT *, value >= 50 AS failed FROM events), l AS (SELECT *, failed IS DISTINCT FROM lag(failed) OVER w AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM l)
    SELECT user_id, run::INTEGER AS run, count(*) AS strikes FROM s WHERE failed GROUP BY ALL HAVING count(*) >= 3""",
)
def strike_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("failed", F.col("value") >= 50)
    return S.sessions(e, ["user_id"], ["ts", "event_id"], "failed", "run").where("failed").groupBy("user_id", "run").agg(F.count("*").alias("strikes")).where("strikes >= 3")


@query(
    "proof_independence",
    """WITH l AS (SELECT conv_id, arg_max(text, turn) AS last, count(*) AS n FROM conversations GROUP BY conv_id)
    SELECT conv_id, NOT contains(last, 'the') AS independent, NOT regexp_matches(last, '(Admitted|Aborted)\\.$') AS finished FROM l""",
)
def proof_independence(spark, sf_dir):
    last = turns(spark, sf_dir).groupBy("conv_id").agg(F.max_by("text", "turn").alias("last"))
    return last.select("conv_id", (~F.col("last").contains("the")).alias("independent"), (~F.col("last").rlike(r"(Admitted|Aborted)\.$")).alias("finished"))


@query(
    "occurrence_ordinal",
    "SELECT doc_id, (row_number() OVER (PARTITION BY trim(regexp_replace(text, '\\s+', ' ', 'g')) ORDER BY doc_id) - 1)::INTEGER AS ordinal FROM documents",
)
def occurrence_ordinal(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize_ws(F.col("text")), 256).alias("statement"))
    return numbered(d, ["statement"], ["doc_id"], "nth").select("doc_id", (F.col("nth") - 1).cast("int").alias("ordinal"))
