"""Queries that analyse results. Systems are event types, theorems are users, times are values."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gneiss.functions import text as T
from gneiss.operators import evaluation as E
from gneiss.operators import sparse
from gneiss.operators import steps as S
from gneiss.registry import query, table

R = "r AS (SELECT event_type AS system, user_id, event_id, value AS time, value < 50 AS success, user_id % 7 AS project FROM events)"
K = f"WITH {R}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY system, user_id ORDER BY event_id) AS n FROM r) WHERE n = 1)"


def results(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("system"), "user_id", "event_id", F.col("value").alias("time"), E.succeeded(F.col("event_id"), F.col("value"), 50).alias("success"), (F.col("user_id") % 7).alias("project"))


def keyed(spark, sf_dir):
    return E.first_per_key(results(spark, sf_dir), ["system", "user_id"], "event_id")


@query("summary_by_project", f"WITH {R} SELECT system, project, round(avg(success::INT), 6) AS rate, sum(success::INT)::BIGINT AS n_success, count(*) AS n FROM r GROUP BY ALL")
def summary_by_project(spark, sf_dir):
    return E.summary(results(spark, sf_dir), ["system", "project"])


@query("totals", f"WITH {R} SELECT system, round(avg(success::INT), 6) AS rate, sum(success::INT)::BIGINT AS n_success, count(*) AS n FROM r GROUP BY ALL")
def totals(spark, sf_dir):
    return E.summary(results(spark, sf_dir), ["system"])


@query("attempted_counts", f"{K} SELECT system, count(*) AS attempted, count(*) FILTER (WHERE success) AS correct FROM k GROUP BY ALL")
def attempted_counts(spark, sf_dir):
    return keyed(spark, sf_dir).groupBy("system").agg(F.count("*").alias("attempted"), F.count_if("success").alias("correct"))


PAIR = f"""{K}, s AS (SELECT system, dense_rank() OVER (ORDER BY system) AS i FROM (SELECT DISTINCT system FROM k)),
a AS (SELECT user_id, time, success FROM k JOIN s USING (system) WHERE i = 1 AND user_id % 3 <> 0),
b AS (SELECT user_id, time, success FROM k JOIN s USING (system) WHERE i = 2 AND user_id % 4 <> 0)"""


def pair(spark, sf_dir):
    k = keyed(spark, sf_dir)
    i = k.select("system").distinct().withColumn("i", F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy("system")))
    k = k.join(F.broadcast(i.where("i <= 3")), "system")  # three systems at most
    return k.where("i = 1 AND user_id % 3 <> 0"), k.where("i = 2 AND user_id % 4 <> 0"), k


@query("joint_eval", f"{PAIR} SELECT user_id, least(a.time, b.time) AS time, coalesce((coalesce(a.success, false) OR coalesce(b.success, false)) AND least(a.time, b.time) < 30, false) AS success FROM a FULL JOIN b USING (user_id)")
def joint_eval(spark, sf_dir):
    a, b, _ = pair(spark, sf_dir)
    return E.joint(a, b, ["user_id"], 30)


@query("joint_eval_normalized", f"{PAIR} SELECT user_id, 2 * least(a.time, b.time) AS time, coalesce((coalesce(a.success, false) OR coalesce(b.success, false)) AND 2 * least(a.time, b.time) < 30, false) AS success FROM a FULL JOIN b USING (user_id)")
def joint_eval_normalized(spark, sf_dir):
    a, b, _ = pair(spark, sf_dir)
    return E.joint(a, b, ["user_id"], 30, normalised=True)


TOP3 = f"{K}, s AS (SELECT system, dense_rank() OVER (ORDER BY system) AS i FROM (SELECT DISTINCT system FROM k)), t AS (SELECT i, user_id FROM k JOIN s USING (system) WHERE i <= 3 AND success), m AS (SELECT user_id, sum(DISTINCT 1 << (i - 1))::INTEGER AS mask FROM t GROUP BY ALL)"


def masks(spark, sf_dir):
    _, _, k = pair(spark, sf_dir)
    return k.where("success").select("user_id", F.expr("shiftleft(1, i - 1)").alias("b")).distinct().groupBy("user_id").agg(F.sum("b").cast("int").alias("mask"))


@query("venn3", f"{TOP3} SELECT mask, count(*) AS n, min(user_id) AS first FROM m GROUP BY mask")
def venn3(spark, sf_dir):
    return masks(spark, sf_dir).groupBy("mask").agg(F.count("*").alias("n"), F.min("user_id").alias("first"))


@query("venn2", f"{TOP3} SELECT mask & 3 AS mask, count(*) AS n FROM m WHERE mask & 3 > 0 GROUP BY 1")
def venn2(spark, sf_dir):
    return masks(spark, sf_dir).withColumn("mask", F.expr("mask & 3")).where("mask > 0").groupBy("mask").agg(F.count("*").alias("n"))


@query("mutual_keys", f"{K} SELECT user_id FROM k GROUP BY user_id HAVING count(DISTINCT system) = (SELECT count(DISTINCT system) FROM k)")
def mutual_keys(spark, sf_dir):
    k = keyed(spark, sf_dir)
    n = k.select("system").distinct().count()
    return E.mutual(k, ["user_id"], "system", n)


@query("nonduplicate_keys", "SELECT user_id, event_type AS system FROM events GROUP BY ALL HAVING count(*) = 1")
def nonduplicate_keys(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.col("event_type").alias("system")).agg(F.count("*").alias("n")).where("n = 1").drop("n")


@query("union_success", f"{K} SELECT count(DISTINCT user_id) AS n_solved FROM k WHERE success")
def union_success(spark, sf_dir):
    return keyed(spark, sf_dir).where("success").agg(F.count_distinct("user_id").alias("n_solved"))


@query("same_key_set", f"{TOP3} SELECT (SELECT count(*) FROM (SELECT user_id FROM t WHERE i = 1 EXCEPT SELECT user_id FROM t WHERE i = 2)) AS only_first, (SELECT count(*) FROM (SELECT user_id FROM t WHERE i = 2 EXCEPT SELECT user_id FROM t WHERE i = 1)) AS only_second")
def same_key_set(spark, sf_dir):
    m = masks(spark, sf_dir)
    return m.agg(F.count_if(F.expr("mask & 3 = 1")).alias("only_first"), F.count_if(F.expr("mask & 3 = 2")).alias("only_second"))


@query("first_only", f"{TOP3} SELECT user_id FROM m WHERE mask = 1")
def first_only(spark, sf_dir):
    _, _, k = pair(spark, sf_dir)
    ok = k.where("success")
    return ok.where("i = 1").select("user_id").join(ok.where("i > 1").select("user_id"), "user_id", "left_anti").distinct()


@query("a_beats_b", f"{TOP3} SELECT a.user_id FROM t a JOIN k b ON a.user_id = b.user_id JOIN s ON s.system = b.system WHERE a.i = 1 AND s.i = 2 AND NOT b.success")
def a_beats_b(spark, sf_dir):
    _, _, k = pair(spark, sf_dir)
    return k.where("i = 1 AND success").select("user_id").join(k.where("i = 2 AND NOT success").select("user_id"), "user_id")


@query("all_systems_compare", f"{K} SELECT user_id, bool_and(success) AS all_succeed, round(min(time), 6) AS best_time FROM k GROUP BY ALL")
def all_systems_compare(spark, sf_dir):
    return keyed(spark, sf_dir).groupBy("user_id").agg(F.bool_and("success").alias("all_succeed"), F.round(F.min("time"), 6).alias("best_time"))


@query("last_success", f"WITH {R} SELECT system, user_id, max(event_id) AS event_id FROM r WHERE success GROUP BY ALL")
def last_success(spark, sf_dir):
    return E.last_per_key(results(spark, sf_dir).where("success"), ["system", "user_id"], "event_id").select("system", "user_id", "event_id")


@query("time_curve", f"{K} SELECT system, user_id, time, (row_number() OVER (PARTITION BY system ORDER BY time, user_id))::INTEGER AS solved FROM k WHERE success")
def time_curve(spark, sf_dir):
    return E.curve(keyed(spark, sf_dir).where("success"), ["system"], "time", "user_id").select("system", "user_id", "time", "solved")


@query("attempt_curve", f"WITH {R}, a AS (SELECT system, user_id, count(*) AS attempts FROM r GROUP BY ALL HAVING bool_or(success)) SELECT system, attempts, user_id, (row_number() OVER (PARTITION BY system ORDER BY attempts, user_id))::INTEGER AS solved FROM a")
def attempt_curve(spark, sf_dir):
    a = results(spark, sf_dir).groupBy("system", "user_id").agg(F.count("*").alias("attempts"), F.bool_or("success").alias("ok")).where("ok")
    return E.curve(a, ["system"], "attempts", "user_id").select("system", "attempts", "user_id", "solved")


RANGES = [(1, 2), (3, 4), (5, 6), (7, None)]


@query(
    "length_buckets",
    f"""{K}, c AS (SELECT conv_id, count(*) AS len FROM conversations GROUP BY ALL), j AS (SELECT k.*, len FROM k JOIN c ON c.conv_id = k.user_id)
    SELECT system, CASE WHEN len BETWEEN 1 AND 2 THEN '1-2' WHEN len BETWEEN 3 AND 4 THEN '3-4' WHEN len BETWEEN 5 AND 6 THEN '5-6' ELSE '7+' END AS bucket, count(*) AS n, round(avg(success::INT), 6) AS rate FROM j GROUP BY ALL""",
)
def length_buckets(spark, sf_dir):
    n = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("user_id")).agg(F.count("*").alias("len"))
    j = keyed(spark, sf_dir).join(n, "user_id").withColumn("bucket", E.bucket(F.col("len"), RANGES))
    return j.groupBy("system", "bucket").agg(F.count("*").alias("n"), F.round(F.avg(F.col("success").cast("int")), 6).alias("rate"))


@query(
    "dependency_buckets",
    f"""{K}, d AS (SELECT doc_id % 150 AS user_id, count(DISTINCT source) - 1 AS deps FROM documents GROUP BY ALL), j AS (SELECT k.*, deps FROM k JOIN d USING (user_id))
    SELECT system, CASE WHEN deps BETWEEN 0 AND 0 THEN '0-0' WHEN deps BETWEEN 1 AND 1 THEN '1-1' ELSE '2+' END AS bucket, count(*) AS n, count(*) FILTER (WHERE success) AS n_success FROM j GROUP BY ALL""",
)
def dependency_buckets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 150).alias("user_id")).agg((F.count_distinct("source") - 1).alias("deps"))
    j = keyed(spark, sf_dir).join(d, "user_id").withColumn("bucket", E.bucket(F.col("deps"), [(0, 0), (1, 1), (2, None)]))
    return j.groupBy("system", "bucket").agg(F.count("*").alias("n"), F.count_if("success").alias("n_success"))


@query(
    "bucket_rates_unpivot",
    f"""{K}, b AS (SELECT user_id % 4 AS bucket, system, avg(success::INT) AS rate FROM k GROUP BY ALL) SELECT bucket, system, round(rate * 100, 4) AS percent FROM b""",
)
def bucket_rates_unpivot(spark, sf_dir):
    k = keyed(spark, sf_dir).withColumn("bucket", F.col("user_id") % 4)
    wide = k.groupBy("bucket").pivot("system").agg(F.avg(F.col("success").cast("int")))
    names = [c for c in wide.columns if c != "bucket"]
    return wide.unpivot("bucket", names, "system", "rate").where("rate IS NOT NULL").select("bucket", "system", F.round(F.col("rate") * 100, 4).alias("percent"))


@query("proof_length_stats", "WITH p AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS t FROM conversations GROUP BY ALL), n AS (SELECT conv_id % 5 AS grp, len(regexp_split_to_array(regexp_replace(t, '^\\s+|\\s+$', '', 'g'), '[.;]\\s+')) AS n FROM p) SELECT grp, round(avg(n), 6) AS mean, median(n)::DOUBLE AS median, max(n)::INTEGER AS longest FROM n GROUP BY grp")
def proof_length_stats(spark, sf_dir):
    p = S.whole_text(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text").select((F.col("conv_id") % 5).alias("grp"), T.proof_length(F.col("proof_text")).alias("n"))
    return E.spread(p, ["grp"], "n").withColumn("mean", F.round("mean", 6))


@query("edit_distance_stats", "WITH d AS (SELECT p_partkey % 10 AS grp, levenshtein(p_name, p_type) AS d FROM part) SELECT grp, round(avg(d), 6) AS mean, median(d)::DOUBLE AS median FROM d GROUP BY grp")
def edit_distance_stats(spark, sf_dir):
    d = table(spark, sf_dir, "part").select((F.col("p_partkey") % 10).alias("grp"), T.edit_distance(F.col("p_name"), F.col("p_type")).alias("d"))
    return E.spread(d, ["grp"], "d").select("grp", F.round("mean", 6).alias("mean"), "median")


@query("error_fraction", "SELECT event_type AS system, round(avg((value > 90)::INT), 6) AS errors FROM events GROUP BY ALL")
def error_fraction(spark, sf_dir):
    time = F.when(F.col("value") <= 90, F.col("value"))
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("system")).agg(F.round(F.avg(time.isNull().cast("int")), 6).alias("errors"))


@query("margin_of_error", f"{K}, g AS (SELECT system, avg(success::INT) AS p, count(*) AS n FROM k GROUP BY ALL) SELECT system, round(p, 6) AS rate, round(1.96 * sqrt(p * (1 - p) / n), 6) AS margin FROM g")
def margin_of_error(spark, sf_dir):
    g = keyed(spark, sf_dir).groupBy("system").agg(F.avg(F.col("success").cast("int")).alias("p"), F.count("*").alias("n"))
    return g.select("system", F.round("p", 6).alias("rate"), F.round(E.margin(F.col("p"), F.col("n")), 6).alias("margin"))


@query("cost_total", "SELECT role, round(sum(length(text) * CASE role WHEN 'user' THEN 5e-6 ELSE 0.15e-6 END + 10 * CASE role WHEN 'user' THEN 15e-6 ELSE 0.6e-6 END), 6) AS cost FROM conversations GROUP BY role")
def cost_total(spark, sf_dir):
    model = F.when(F.col("role") == "user", "gpt-4o").otherwise("gpt-4o-mini")
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.round(F.sum(T.cost(model, F.length("text"), F.lit(10))), 6).alias("cost"))


def pivoted(name, column, n):
    """Rates by group and system, groups that some system lacks left out."""
    sql = f"{K}, g AS (SELECT {column} % {n} AS grp, system, round(avg(success::INT), 6) AS rate FROM k GROUP BY ALL) SELECT grp, count(*) AS systems, max(rate) AS best, min(rate) AS worst FROM g GROUP BY grp HAVING count(*) = (SELECT count(DISTINCT system) FROM k)"

    def run(spark, sf_dir):
        wide = keyed(spark, sf_dir).groupBy((F.col(column) % n).alias("grp")).pivot("system").agg(F.round(F.avg(F.col("success").cast("int")), 6)).dropna()
        names = [F.col(f"`{c}`") for c in wide.columns if c != "grp"]
        return wide.select("grp", F.lit(len(names)).cast("long").alias("systems"), F.greatest(*names).alias("best"), F.least(*names).alias("worst"))

    return query(name, sql)(run)


pivoted("pivot_rates", "user_id", 7)


@query("type_origin_pivot", "SELECT lang, round(avg(n_chars) FILTER (WHERE source IN ('src0', 'src1')), 6) AS library, round(avg(n_chars) FILTER (WHERE source NOT IN ('src0', 'src1')), 6) AS local, count(*) AS n FROM documents GROUP BY lang")
def type_origin_pivot(spark, sf_dir):
    origin = F.when(F.col("source").isin("src0", "src1"), "library").otherwise("local")
    d = table(spark, sf_dir, "documents")
    wide = d.withColumn("o", origin).groupBy("lang").pivot("o", ["library", "local"]).agg(F.round(F.avg("n_chars"), 6))
    return wide.join(d.groupBy("lang").agg(F.count("*").alias("n")), "lang")


@query("outcome_matrix", f"{K} SELECT user_id, string_agg(system || '=' || CASE WHEN time > 90 THEN 'Error' WHEN success THEN 'Success' ELSE 'Failure' END, ',' ORDER BY system) AS outcomes FROM k GROUP BY user_id")
def outcome_matrix(spark, sf_dir):
    o = F.when(F.col("time") > 90, "Error").when(F.col("success"), "Success").otherwise("Failure")
    g = keyed(spark, sf_dir).groupBy("user_id").agg(F.sort_array(F.collect_list(F.concat("system", F.lit("="), o))).alias("o"))
    return g.select("user_id", F.array_join("o", ",").alias("outcomes"))


@query("corpus_counts", "SELECT count(DISTINCT source) AS repos, count(*) AS proofs, sum(n_chars)::BIGINT AS chars, max(n_chars) AS longest FROM documents")
def corpus_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count_distinct("source").alias("repos"), F.count("*").alias("proofs"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


@query("steps_per_proof", "SELECT n_steps, count(*) AS proofs FROM (SELECT conv_id, count(*) AS n_steps FROM conversations GROUP BY ALL) GROUP BY ALL")
def steps_per_proof(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_steps")).groupBy("n_steps").agg(F.count("*").alias("proofs"))


@query("totals_with_sum_row", "SELECT coalesce(lang, 'Total') AS lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (lang)")
def totals_with_sum_row(spark, sf_dir):
    return table(spark, sf_dir, "documents").rollup("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")).select(F.coalesce("lang", F.lit("Total")).alias("lang"), "n", "chars")


@query("unknown_token_counts", "SELECT c AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^\\x00-\\x7f]')) AS c FROM documents) GROUP BY c")
def unknown_token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x00-\x7f]"), F.lit(0))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def hit_rows(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1").select((F.floor(F.col("doc_id") / 25) % 40).alias("item_id"), "doc_id").distinct()
    good = good.join(table(spark, sf_dir, "benchmark").select("item_id"), "item_id", "left_semi")
    ranks = sparse.places(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), good.select(F.col("item_id").alias("qid"), F.col("doc_id").alias("id")), "bm25", "doc_id", "text", "item_id", "text")
    return S.hits(ranks.select(F.col("qid").alias("item_id"), F.col("id").alias("doc_id"), F.col("rank").cast("int").alias("rank")), good, "item_id", "doc_id")


from gneiss.plans.retrieval import STATS  # noqa: E402

HITS = f"""WITH {STATS}, qf AS (SELECT item_id, term, count(*) AS f FROM q GROUP BY ALL),
s AS (SELECT item_id, doc_id, round(sum(f * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.8 / (tf + 1.8 * (0.25 + 0.75 * len / a))), 6) AS score FROM qf JOIN tf USING (term) JOIN df USING (term), n GROUP BY ALL),
p AS (SELECT b.item_id, d.doc_id, coalesce(score, 0.0) AS score FROM (SELECT DISTINCT item_id FROM benchmark) b CROSS JOIN documents d LEFT JOIN s USING (item_id, doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM p),
g AS (SELECT DISTINCT (doc_id // 25) % 40 AS item_id, doc_id FROM labels WHERE quality = 1 AND (doc_id // 25) % 40 IN (SELECT item_id FROM benchmark)),
h AS (SELECT g.item_id, count(*) AS num_premises, coalesce(list_sort(list(rank)), []) AS hits_on FROM g JOIN r USING (item_id, doc_id) GROUP BY g.item_id)"""


@query("hits_on", f"{HITS} SELECT item_id, num_premises, array_to_string(hits_on, ',') AS hits_on FROM h")
def hits_on(spark, sf_dir):
    return hit_rows(spark, sf_dir).select("item_id", "num_premises", F.array_join(F.transform("hits_on", lambda x: x.cast("string")), ",").alias("hits_on"))


@query("recall_table", f"{HITS}, k AS (SELECT unnest([1, 10, 50, 100, 200, 500]) AS k), f AS (SELECT k, num_premises, len(list_filter(hits_on, lambda z: z <= k)) AS found FROM h, k) SELECT k, round(avg((found = num_premises)::INT), 6) AS strict, round(sum(found) / sum(num_premises), 6) AS micro FROM f GROUP BY k")
def recall_table(spark, sf_dir):
    return E.recall(hit_rows(spark, sf_dir), [1, 10, 50, 100, 200, 500])


@query("training_log_parse", "SELECT event_type, min((props->>'$.k')::BIGINT) AS least, max((props->>'$.k')::BIGINT) AS most, count(*) FILTER (WHERE (props->>'$.k')::BIGINT % 2 = 0) AS n_eval FROM events GROUP BY event_type")
def training_log_parse(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.min("k").alias("least"), F.max("k").alias("most"), F.count_if(F.col("k") % 2 == 0).alias("n_eval"))


@query("latest_checkpoint", "SELECT event_type, max(regexp_extract('checkpoint-' || event_id, 'checkpoint-(\\d+)', 1)::BIGINT) AS step, arg_max(round(value, 6), event_id) AS loss FROM events GROUP BY event_type")
def latest_checkpoint(spark, sf_dir):
    step = F.regexp_extract(F.concat(F.lit("checkpoint-"), F.col("event_id").cast("string")), r"checkpoint-(\d+)", 1).cast("long")
    return table(spark, sf_dir, "events").withColumn("step", step).groupBy("event_type").agg(F.max("step").alias("step"), F.max_by(F.round("value", 6), "step").alias("loss"))


@query("relative_gain", "SELECT round((max(n) - min(n)) / min(n), 6)::DOUBLE AS gain FROM (SELECT event_type, count(*) FILTER (WHERE value < 50)::DOUBLE AS n FROM events GROUP BY ALL)")
def relative_gain(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("value") < 50).alias("n"))
    return n.agg(F.round(F.try_divide(F.max("n") - F.min("n"), F.min("n")), 6).alias("gain"))


@query("grouped_results", f"WITH {R} SELECT project, count(*) AS n, md5(string_agg(event_id, ',' ORDER BY event_id)) AS ids_md5 FROM r WHERE success GROUP BY project")
def grouped_results(spark, sf_dir):
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x.cast("string")), ",")
    return results(spark, sf_dir).where("success").groupBy("project").agg(F.count("*").alias("n"), F.md5(ids).alias("ids_md5"))


@query("side_by_side_totals", f"{K} SELECT project, count(*) FILTER (WHERE success) AS n_success, count(*) AS n, count(DISTINCT system) AS systems FROM k GROUP BY project")
def side_by_side_totals(spark, sf_dir):
    return keyed(spark, sf_dir).groupBy("project").agg(F.count_if("success").alias("n_success"), F.count("*").alias("n"), F.count_distinct("system").alias("systems"))


@query("pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY ALL")
def pricing_summary(spark, sf_dir):
    """The summary shape (mean, sum, count by key) at bench scale."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("order_buckets", "SELECT CASE WHEN n BETWEEN 1 AND 2 THEN '1-2' WHEN n BETWEEN 3 AND 4 THEN '3-4' WHEN n BETWEEN 5 AND 6 THEN '5-6' ELSE '7+' END AS bucket, count(*) AS orders, round(avg((o_totalprice < 150000)::INT), 6) AS rate FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) ON o_orderkey = l_orderkey GROUP BY 1")
def order_buckets(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = table(spark, sf_dir, "orders").join(n, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.groupBy(E.bucket(F.col("n"), RANGES).alias("bucket")).agg(F.count("*").alias("orders"), F.round(F.avg((F.col("o_totalprice") < 150000).cast("int")), 6).alias("rate"))
