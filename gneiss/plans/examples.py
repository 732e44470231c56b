"""Queries that build training examples and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.operators import examples as E
from gneiss.operators import steps as S
from gneiss.operators.ranges import numbered
from gneiss.registry import CHOICES, choose, query, table

CONV = """
c AS (SELECT conv_id, turn, text, conv_id % 20 AS src, coalesce(string_agg(text, '') OVER w, '') AS script,
      string_agg(text, chr(10) || '[GOAL]' || chr(10)) OVER r AS state, string_agg(text, '|') OVER f AS rest
      FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
      r AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), f AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
p AS (SELECT src, string_agg(head, chr(10) ORDER BY rank DESC) AS premises FROM (SELECT doc_id % 20 AS src, text AS head, row_number() OVER (PARTITION BY doc_id % 20 ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 4 GROUP BY src),
q AS (SELECT src, string_agg(head, chr(10) ORDER BY rank DESC) AS proofs FROM (SELECT item_id % 20 AS src, text AS head, row_number() OVER (PARTITION BY item_id % 20 ORDER BY item_id) AS rank FROM benchmark) WHERE rank <= 2 GROUP BY src),
x AS (SELECT c.*, coalesce(premises, '') AS premises, coalesce(proofs, '') AS proofs FROM c LEFT JOIN p USING (src) LEFT JOIN q USING (src))
"""
N = "chr(10)"
SQL_STATE = f"{N} || '[STATE]' || {N} || state"
SQL_SCRIPT = f"{N} || '[SCRIPT]' || {N} || script"
SQL_PREM = f"{N} || '[PREMISES]' || {N} || premises"
SQL_PROOF = f"{N} || '[PROOFS]' || {N} || proofs"
SQL_END = f"{N} || '[TACTIC]' || {N} || text"


def lm(spark, sf_dir):
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations")
    goals = F.collect_list("text").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-1, 0))
    c = c.select("conv_id", "turn", "text", (F.col("conv_id") % 20).alias("src"), S.prefix(F.col("text"), ["conv_id"], ["turn"]).alias("script"), F.array_join(goals, E.GOAL_SEPARATOR).alias("state"), S.remaining(F.col("text"), ["conv_id"], ["turn"]).alias("next_steps"))

    def top(name, key, order, k):
        from gneiss.operators.retrieval import ranked

        d = table(spark, sf_dir, name).select((F.col(key) % 20).alias("src"), F.col("text").alias("head"), order.alias("score"), key)
        rows = ranked(d, ["src"], key, k).groupBy("src").agg(F.sort_array(F.collect_list(F.struct("rank", "head"))).alias("r"))
        return rows.select("src", F.transform("r", lambda x: x["head"]).alias(name))

    docs = top("documents", "doc_id", F.col("n_chars"), 4).withColumnRenamed("documents", "premises")
    proofs = top("benchmark", "item_id", F.lit(0), 2).withColumnRenamed("benchmark", "proofs")
    none = F.array().cast("array<string>")
    return c.join(docs, "src", "left").join(proofs, "src", "left").withColumns({"premises": F.coalesce("premises", none), "proofs": F.coalesce("proofs", none)})


@query(
    "lm_examples",
    f"WITH {CONV} SELECT conv_id, turn, md5(script) AS script_md5, md5(state) AS state_md5, md5(rest) AS next_md5, md5(premises) AS premises_md5, md5(proofs) AS proofs_md5 FROM x",
)
def lm_examples(spark, sf_dir):
    return lm(spark, sf_dir).select("conv_id", "turn", F.md5("script").alias("script_md5"), F.md5("state").alias("state_md5"), F.md5(F.array_join("next_steps", "|")).alias("next_md5"), F.md5(E.best_last(F.col("premises"))).alias("premises_md5"), F.md5(E.best_last(F.col("proofs"))).alias("proofs_md5"))


FORMS = {
    "basic": f"{SQL_STATE} || {SQL_SCRIPT} || {SQL_END}",
    "premise": f"{SQL_PREM} || {SQL_STATE} || {SQL_SCRIPT} || {SQL_END}",
    "proof": f"{SQL_PROOF} || {SQL_STATE} || {SQL_SCRIPT} || {SQL_END}",
    "proof-premise": f"{SQL_PREM} || {SQL_PROOF} || {SQL_STATE} || {SQL_SCRIPT} || {SQL_END}",
    "no-script": f"{SQL_PREM} || {SQL_PROOF} || {SQL_STATE} || {SQL_END}",
}


def prompt(alias):
    def run(spark, sf_dir):
        d = lm(spark, sf_dir)
        text = choose("collator", alias)(F.col("state"), F.col("script"), F.col("premises"), F.col("proofs"))
        return d.select("conv_id", "turn", F.md5(F.concat(text, F.get("next_steps", F.lit(0)))).alias("prompt_md5"))

    return run


for alias in CHOICES["collator"]:
    query(f"prompt_collate_{alias.replace('-', '_')}", f"WITH {CONV} SELECT conv_id, turn, md5({FORMS[alias]}) AS prompt_md5 FROM x")(prompt(alias))


@query(
    "context_format",
    """WITH g AS (SELECT conv_id, string_agg('Goal ' || (turn + 1) || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS goals, arg_min(text, turn) AS first FROM conversations GROUP BY conv_id)
    SELECT conv_id, first || chr(10) || chr(10) || goals AS context FROM g""",
)
def context_format(spark, sf_dir):
    rows = F.sort_array(F.collect_list(F.struct("turn", "text")))
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(rows.alias("r"))
    return g.select("conv_id", E.context(F.get("r", F.lit(0))["text"], F.transform("r", lambda x: x["text"])).alias("context"))


def labelled(spark, sf_dir):
    """Steps are benchmark items; premises are documents of the block of 50 ids that the item's id points to."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    d = table(spark, sf_dir, "documents").select("doc_id", (F.floor(F.col("doc_id") / 25) % 40).alias("item_id"), (F.col("source") == "src3").alias("own"))
    d = d.join(table(spark, sf_dir, "benchmark").select("item_id").distinct(), "item_id", "left_semi")
    return d.join(good, "doc_id", "left_semi"), d.join(good, "doc_id", "left_anti")


PAIRS = """
b AS (SELECT DISTINCT item_id FROM benchmark),
d AS (SELECT doc_id, (doc_id // 25) % 40 AS item_id, source = 'src3' AS own FROM documents WHERE (doc_id // 25) % 40 IN (SELECT item_id FROM b)),
pos AS (SELECT item_id, doc_id AS positive FROM d WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
neg AS (SELECT item_id, doc_id, own FROM d WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1))
"""


def feistel_sql(rows: str) -> str:
    """``rows`` (key, n, x and others) with x taken through the keyed permutation once."""
    out = f"(SELECT * EXCLUDE x, x >> bits AS l, x & ((1::BIGINT << bits) - 1) AS r FROM {rows})"
    for k in range(4):
        out = f"(SELECT *, (r * 2654435761 + key + {k} * 40503) % 4294967296 AS y FROM {out})"
        out = f"(SELECT * EXCLUDE y, xor(y, y >> 15) * 1540483477 % 4294967296 AS y FROM {out})"
        out = f"(SELECT * EXCLUDE y, xor(y, y >> 13) * 2146121005 % 4294967296 AS y FROM {out})"
        out = f"(SELECT * EXCLUDE (l, r, y), r AS l, xor(l, y >> (32 - bits)) AS r FROM {out})"
    return f"(SELECT * EXCLUDE (l, r), (l << bits) | r AS x FROM {out})"


@query(
    "select_examples",
    f"""WITH RECURSIVE {PAIRS}, c AS (SELECT item_id, count(*) FILTER (WHERE own) AS o, count(*) FILTER (WHERE NOT own) AS x FROM neg GROUP BY ALL HAVING count(*) >= 6),
    w AS (SELECT item_id, o, x, CASE WHEN 1 + x < 6 THEN least(6, o) ELSE least(1, o) END AS want FROM c),
    a AS (SELECT item_id, positive, true AS own, o AS n, want AS many FROM pos JOIN w USING (item_id) UNION ALL SELECT item_id, positive, false, x, 6 - want FROM pos JOIN w USING (item_id)),
    d0 AS (SELECT *, ('0x' || substr(md5('neg:' || item_id || ':' || positive || ':' || own::INT), 1, 8))::BIGINT AS key, greatest(1, ceil(log2(n) / 2 - 1e-12))::BIGINT AS bits, unnest(range(0, least(many, n))) AS x FROM a),
    walk AS (SELECT * FROM {feistel_sql('d0')} UNION ALL SELECT * FROM {feistel_sql('(SELECT * FROM walk WHERE x >= n)')}),
    p AS (SELECT item_id, own, doc_id, row_number() OVER (PARTITION BY item_id, own ORDER BY doc_id) - 1 AS x FROM neg)
    SELECT item_id, positive, doc_id AS negative, own FROM (SELECT * FROM walk WHERE x < n) JOIN p USING (item_id, own, x)""",
)
def select_examples(spark, sf_dir):
    pos, neg = labelled(spark, sf_dir)
    return E.negatives("item_id", pos.select("item_id", "doc_id"), neg.select("item_id", "doc_id", "own"), "doc_id", 6, 1)


@query(
    "rerank_examples",
    f"""WITH {PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY doc_id DESC) AS rank FROM neg),
    r AS (SELECT item_id, positive, doc_id, row_number() OVER (PARTITION BY item_id, positive ORDER BY md5('rr:' || positive || ':' || doc_id)) AS r FROM pos JOIN k USING (item_id) WHERE rank <= 12)
    SELECT item_id, positive, positive AS premise, true AS label FROM pos UNION ALL SELECT item_id, positive, doc_id, false FROM r WHERE r <= 3""",
)
def rerank_examples(spark, sf_dir):
    from gneiss.operators.corpus import hash_order, sample_per_group
    from gneiss.operators.retrieval import ranked

    pos, neg = labelled(spark, sf_dir)
    pos = pos.select("item_id", F.col("doc_id").alias("positive"))
    bank = ranked(neg.withColumn("score", F.col("doc_id")), ["item_id"], "doc_id", 12).select("item_id", "doc_id")
    n = sample_per_group(pos.join(bank, "item_id"), ["item_id", "positive"], hash_order("rr", F.col("positive"), F.col("doc_id")), 3)
    yes = pos.select("item_id", "positive", F.col("positive").alias("premise"), F.lit(True).alias("label"))
    return yes.unionByName(n.select("item_id", "positive", F.col("doc_id").alias("premise"), F.lit(False).alias("label")))


@query(
    "lemma_examples",
    f"""WITH {PAIRS}, r AS (SELECT p.item_id, p.positive, d.doc_id, row_number() OVER (PARTITION BY p.item_id, p.positive ORDER BY d.doc_id) AS rank FROM pos p JOIN d ON d.item_id = p.item_id AND d.doc_id <> p.positive)
    SELECT item_id, positive AS target, string_agg(doc_id, ',' ORDER BY rank) AS relevant FROM r WHERE rank <= 5 GROUP BY ALL""",
)
def lemma_examples(spark, sf_dir):
    """The five best premises besides the target are among the six best of the group."""
    from gneiss.operators.retrieval import ranked

    pos, neg = labelled(spark, sf_dir)
    six = ranked(pos.unionByName(neg).select("item_id", "doc_id").withColumn("score", F.lit(0)), ["item_id"], "doc_id", 6)
    best = six.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))).alias("best"))
    rows = pos.select("item_id", F.col("doc_id").alias("target")).join(best, "item_id")
    other = F.slice(F.filter(F.transform("best", lambda x: x["doc_id"]), lambda i: i != F.col("target")), 1, 5)
    return rows.where(F.size(other) > 0).select("item_id", "target", F.array_join(F.transform(other, lambda i: i.cast("string")), ",").alias("relevant"))


@query(
    "contrastive_labels",
    f"""WITH {PAIRS}, x AS (SELECT item_id, positive, (row_number() OVER (ORDER BY item_id, positive) - 1) // 8 AS batch FROM pos)
    SELECT a.item_id, a.positive, b.positive AS premise, a.item_id = b.item_id AS label FROM x a JOIN x b USING (batch)""",
)
def contrastive_labels(spark, sf_dir):
    """Batches of eight examples: each against every premise of its batch; those of its own item are positives."""
    pos, _ = labelled(spark, sf_dir)
    a = numbered(pos.select("item_id", F.col("doc_id").alias("positive")), [], ["item_id", "positive"], "nth").select("item_id", "positive", F.floor((F.col("nth") - 1) / 8).alias("batch"))
    b = a.select(F.col("item_id").alias("other"), F.col("positive").alias("premise"), "batch")
    return a.join(b, "batch").select("item_id", "positive", "premise", (F.col("item_id") == F.col("other")).alias("label"))


@query("rerank_pair_text", f"SELECT d.doc_id, md5(d.text || {N} || '[SEP]' || {N} || b.text) AS pair_md5 FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40")
def rerank_pair_text(spark, sf_dir):
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("context"))
    return d.join(b, F.col("item_id") == F.col("doc_id") % 40).select("doc_id", F.md5(F.concat("text", F.lit(E.PAIR_SEPARATOR), "context")).alias("pair_md5"))


@query(
    "join_best_last",
    "SELECT source, string_agg(text, chr(10) ORDER BY rank DESC) AS passages FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 5 GROUP BY source",
)
def join_best_last(spark, sf_dir):
    from gneiss.operators.retrieval import ranked

    d = ranked(table(spark, sf_dir, "documents").withColumn("score", F.lit(0)), ["source"], "doc_id", 5)
    return d.groupBy("source").agg(E.best_last(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col("text").alias("t")))), lambda x: x["t"])).alias("passages"))
