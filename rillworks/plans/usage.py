"""Evaluation, usage, conversation and graph queries over events, conversations, vectors and keys of the star schema."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as e
from ..operators import graph as g
from ..operators import leiden as lm
from ..operators import usage as u
from .finance import table
from .search import _dense_sql, dense_queries, points
from ..operators.search import dense_topk


def _judged(spark: SparkSession, d: str, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Hits of every hundredth vector among all others; a vector of the same label is relevant."""
    hits = dense_topk(dense_queries(spark, d), points(spark, d).where("doc_id % 100 <> 0"), k).select("query_id", F.col("doc_id").alias("item_id"), "rank")
    p = points(spark, d)
    q = p.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "label")
    return hits, p.where("doc_id % 100 <> 0").select(F.col("doc_id").alias("item_id"), "label").join(F.broadcast(q), "label").select("query_id", "item_id", F.lit(True).alias("relevant"))


def e1_e3_e4_retrieval(spark: SparkSession, d: str) -> DataFrame:
    return e.retrieval_measures(*_judged(spark, d), 10)


def e2_answer_recall(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").selectExpr("doc_id - doc_id % 100 AS query_id", "doc_id % 100 + 1 AS rank", "text")
    answers = table(spark, d, "documents").where("doc_id % 100 = 0").selectExpr("doc_id AS query_id", "CASE WHEN doc_id % 3 = 0 THEN concat('x', text) ELSE text END AS answer")
    return e.answer_recall(docs, answers, 100)


def e5_supported_share(spark: SparkSession, d: str) -> DataFrame:
    return e.supported_share(table(spark, d, "events").select("event_type", (F.col("value") > 30).alias("supported")), "event_type")


def e6_answer_relevancy(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    return e.answer_relevancy(dense_queries(spark, d), p.where("doc_id % 100 <> 0").select((F.col("doc_id") - F.col("doc_id") % 100).alias("query_id"), "vector"))


def e7_expected_score(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey AS id", "l_linenumber AS score", "-l_discount * 10 AS logprob")
    return e.expected_score(rows, "id")


def e8_diagnose(spark: SparkSession, d: str) -> DataFrame:
    m = [F.expr(f"((l_orderkey * {a} + l_linenumber) % 10) / 10e0") for a in (1, 3, 7, 11)]
    return table(spark, d, "lineitem").groupBy(e.diagnose(*m).alias("case")).agg(F.count("*").alias("n"))


def e9_field_scores(spark: SparkSession, d: str) -> DataFrame:
    gold = table(spark, d, "part").selectExpr("p_partkey", "p_retailprice AS value")
    return e.field_scores(gold.where("p_partkey % 7 <> 0").withColumn("value", F.expr("value * (1 + (p_partkey % 4) * 0.005e0)")), gold.where("p_partkey % 11 <> 0"), ["p_partkey"])


def e9_citation_scores(spark: SparkSession, d: str) -> DataFrame:
    """Events as claims, six to an answer; each cites none, one or two sources; some claims have no evidence."""
    rows = table(spark, d, "events").selectExpr("event_id div 6 % 3 AS config", "event_id div 6 AS answer_id", "event_id % 6 AS claim_no", "event_id", "user_id")
    cited = rows.selectExpr("answer_id", "claim_no", "explode(CASE WHEN event_id % 7 = 0 THEN array() WHEN event_id % 3 = 0 THEN array(user_id % 5, event_id % 5) ELSE array(user_id % 5) END) AS source_id")
    return e.citation_scores(rows, cited, rows.where("user_id % 9 > 0").selectExpr("answer_id", "claim_no", "event_id % 5 AS source_id"), ["config"])


def e10_compare_configs(spark: SparkSession, d: str) -> DataFrame:
    hits, judged = _judged(spark, d)
    configs = spark.createDataFrame([("three", 3), ("ten", 10)], "config string, k int")
    many = hits.join(F.broadcast(configs), F.col("rank") <= F.col("k")).drop("k")
    return e.retrieval_measures(many, judged.crossJoin(F.broadcast(configs.select("config"))), 10, ["config"])


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """Events as spans: trace = user and day, a chain of four and then leaves below the first."""
    return table(spark, d, "events").selectExpr("event_id div 8 AS trace_id", "event_id AS span_id", "CASE WHEN event_id % 8 = 0 THEN NULL WHEN event_id % 8 < 4 THEN event_id - 1 ELSE event_id - event_id % 8 END AS parent_id", "cast(value * 10 as bigint) AS duration_ms", "event_id % 100 AS tokens", "event_type", "user_id", "value", "ts")


def t1_token_cost(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").selectExpr("event_id", "CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS model", "event_id * 10 AS prompt_tokens", "event_id AS completion_tokens")
    return u.token_cost(rows, spark.createDataFrame([("a", 0.59, 0.79), ("b", 3.0, 15.0)], "model string, p_in double, p_out double")).select("event_id", F.round("cost", 8).alias("cost"))


def t2_cached_cost(spark: SparkSession, d: str) -> DataFrame:
    c = u.cached_token_cost(F.col("event_id"), F.col("event_id") * 3, F.col("user_id") * 7, F.lit(500), 3.0, 15.0)
    return table(spark, d, "events").select("event_id", c.alias("c")).select("event_id", "c.input_tokens", F.round("c.cost", 8).alias("cost"))


def t3_stage_latency(spark: SparkSession, d: str) -> DataFrame:
    return u.stage_latency(table(spark, d, "events").selectExpr("CASE event_id % 4 WHEN 0 THEN 'retrieval' WHEN 1 THEN 'rerank' WHEN 2 THEN 'first_token' ELSE 'stream' END AS stage", "value * 20 AS ms"))


def t4_trace_rollup(spark: SparkSession, d: str) -> DataFrame:
    return u.trace_rollup(_spans(spark, d))


def t4_trace_report(spark: SparkSession, d: str) -> DataFrame:
    """Two spans of three are generations, by one of three models, of which one has no price; two scores a trace and more."""
    spans = _spans(spark, d).selectExpr("trace_id", "span_id", "parent_id", "duration_ms", "CASE span_id % 3 WHEN 0 THEN 'event' ELSE 'generation' END AS kind", "CASE span_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS model", "tokens * 10 AS prompt_tokens", "CASE WHEN span_id % 5 > 0 THEN tokens END AS completion_tokens")
    scores = table(spark, d, "events").selectExpr("event_id div 8 AS trace_id", "CASE WHEN event_id % 2 = 0 THEN 'faithfulness' ELSE 'feedback' END AS name", "(event_id % 7) / 7e0 AS value").where("trace_id % 6 > 0")
    out = u.trace_report(spans, spark.createDataFrame([("a", 0.59, 0.79), ("b", 3.0, 15.0)], "model string, p_in double, p_out double"), scores)
    return out.select("trace_id", "n_spans", "tokens", "depth", "n_generations", "n_events", F.round("cost", 8).alias("cost"), *(F.round(F.try_element_at("scores", F.lit(k)), 6).alias(k) for k in ("faithfulness", "feedback")))


def t5_hard_failures(spark: SparkSession, d: str) -> DataFrame:
    return u.hard_failures(_spans(spark, d).selectExpr("trace_id", "tokens % 13 AS feedback", "CASE WHEN tokens % 5 = 0 THEN NULL ELSE (tokens % 50) / 20e0 END AS faithfulness"))


def t6_ab_report(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").selectExpr("user_id % 2 AS arm", "event_type = 'purchase' AS win", "(event_id % 10) / 10e0 AS faithfulness", "event_id % 777 AS tokens")
    return u.ab_report(rows)


def t7_sample_traces(spark: SparkSession, d: str) -> DataFrame:
    return u.sample_traces(table(spark, d, "events").selectExpr("event_id AS trace_id", "event_type = 'error' AS error", "user_id % 50 = 0 AS vip"))


def t8_loop_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return u.loop_tokens(rows, "conv_id", "turn", "n").select("conv_id", "turn", "context", "sent")


def t9_api_metrics(spark: SparkSession, d: str) -> DataFrame:
    return u.api_metrics(table(spark, d, "events").select(F.col("event_type").alias("route"), (F.col("user_id") % 3).alias("key"), "ts", (F.col("user_id") % 10 == 0).alias("error"), (F.col("event_id") / 100).alias("cost"), F.col("value").alias("ms")))


def t9_sketched_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_type").alias("route"), (F.col("user_id") % 3).alias("key"), "ts", (F.col("user_id") % 10 == 0).alias("error"), (F.col("event_id") / 100).alias("cost"), F.expr("CASE WHEN event_id % 13 > 0 THEN value - 20 END").alias("ms"))
    q = lambda i: F.round(F.col("quantiles")[i], 4)
    return u.sketched_metrics(rows, every="1 day", probs=(0.0, 0.5, 0.95)).select("route", "key", "start", "calls", "errors", F.round("cost", 2).alias("cost"), q(0).alias("least"), q(1).alias("p50"), q(2).alias("p95"))


def t10_usage_stats(spark: SparkSession, d: str) -> DataFrame:
    out = u.usage_stats(table(spark, d, "events").select("event_type", F.date_trunc("day", "ts").cast("date").cast("string").alias("day"), "user_id"), ["event_type", "day"])
    return out.select(F.coalesce("event_type", F.lit("all")).alias("event_type"), F.coalesce("day", F.lit("all")).alias("day"), "calls", "users", F.col("level").cast("long").alias("level"))


def t10_usage_report(spark: SparkSession, d: str) -> DataFrame:
    """Calls of bots 1 to 19 whose names begin with 1, or are 7, in the middle of the time, by course and bot; some bots have no course."""
    rows = table(spark, d, "events").select((F.col("user_id") % 20).cast("string").alias("bot"), "ts", "user_id")
    groups = rows.select("bot").distinct().where("bot % 3 > 0").withColumn("course", F.concat(F.lit("course "), F.expr("cast(bot % 4 as string)")))
    return u.usage_report(rows, groups, ["course", "bot"], *_SPAN, ["1*", "7"]).select("course", "bot", "calls", "users", F.col("level").cast("long").alias("level"))


_SPAN = ("2024-01-05 00:00:00", "2024-01-20 12:00:00")


def t11_status_mix(spark: SparkSession, d: str) -> DataFrame:
    return u.status_mix(table(spark, d, "events").select((F.col("user_id") % 20).alias("bot"), F.col("event_type").alias("status")), "bot")


def t12_rate_violations(spark: SparkSession, d: str) -> DataFrame:
    return u.rate_violations(table(spark, d, "events"), "event_type", "1 hour", 3)


def t13_escalation_context(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    return u.escalation_context(rows.unionByName(rows.where("turn % 2 = 0")), 4).select("conv_id", F.md5("context").alias("context"))


def t14_conversation_window(spark: SparkSession, d: str) -> DataFrame:
    return u.conversation_window(table(spark, d, "conversations"), 2).select("conv_id", "turn", "role")


def t15_last_human_message(spark: SparkSession, d: str) -> DataFrame:
    return u.last_human_message(table(spark, d, "conversations")).select("conv_id", "turn", F.md5("text").alias("text"))


def t16_merge_messages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return u.merge_messages(rows.where("turn < 4"), rows.where("turn >= 2").withColumn("role", F.lit("edited")))


def _memories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").selectExpr("conv_id % 20 AS user_id", "conv_id * 100 + turn AS pos", "CASE WHEN turn % 3 = 0 THEN '  ' ELSE concat(' ', text, ' ') END AS memory")


def t17_save_memory(spark: SparkSession, d: str) -> DataFrame:
    return u.save_memory(_memories(spark, d))


def t18_retrieve_memory(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "nation").selectExpr("n_nationkey AS user_id", "CASE n_nationkey % 3 WHEN 0 THEN 'The zq' WHEN 1 THEN 'ER' ELSE 'qqqq' END AS query")
    return u.retrieve_memory(u.save_memory(_memories(spark, d)), q)


def t19_distinct_in_order(spark: SparkSession, d: str) -> DataFrame:
    return u.distinct_in_order(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type").select("user_id", F.array_join("values", ",").alias("agents"))


def t20_collect_tool_outputs(spark: SparkSession, d: str) -> DataFrame:
    return u.collect_tool_outputs(table(spark, d, "conversations"), "th").select("conv_id", F.md5("outputs").alias("outputs"))


def t20_research_result(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").withColumn("agent", F.expr("CASE WHEN turn % 4 > 0 THEN concat('agent', cast(turn % 3 as string)) END")).withColumn("sources", F.expr("CASE WHEN turn % 3 = 0 THEN NULL ELSE array(concat('s', cast((turn * 7 + conv_id) % 5 as string)), concat('s', cast(turn % 2 as string))) END"))
    return u.research_result(rows, "th").select("conv_id", F.md5("outputs").alias("outputs"), F.array_join(F.array_sort("sources"), ",").alias("sources"), F.array_join("agents", ",").alias("agents"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Customers to nations to regions, suppliers to nations."""
    a = table(spark, d, "customer").selectExpr("concat('c', c_custkey) AS src", "'lives_in' AS rel", "concat('n', c_nationkey) AS dst", "1 AS weight")
    b = table(spark, d, "nation").selectExpr("concat('n', n_nationkey)", "'part_of'", "concat('r', n_regionkey)", "1")
    c = table(spark, d, "supplier").selectExpr("concat('s', s_suppkey)", "CASE WHEN s_suppkey % 5 = 0 THEN 'owns' ELSE 'lives_in' END", "concat('n', s_nationkey)", "1")
    return a.union(b).union(c)


_EDGES = "edges AS (SELECT 'c' || c_custkey AS src, 'lives_in' AS rel, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 'n' || n_nationkey, 'part_of', 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'owns' ELSE 'lives_in' END, 'n' || s_nationkey FROM supplier)"


def _vertices(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    return e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select("id", F.expr("CASE substring(id, 1, 1) WHEN 'c' THEN 'customer' WHEN 's' THEN 'supplier' WHEN 'n' THEN 'nation' ELSE 'region' END").alias("type"))


def g1_build_graph(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").selectExpr("concat('p', l_partkey % 100) AS src", "'sold_by' AS rel", "concat('s', l_suppkey) AS dst", "l_quantity AS weight")
    aliases = table(spark, d, "nation").selectExpr("concat('p', n_nationkey) AS alias", "concat('p', n_nationkey % 5) AS name")
    return g.build_graph(t, aliases)


def g2_check_schema(spark: SparkSession, d: str) -> DataFrame:
    allowed = spark.createDataFrame([("customer", "lives_in", "nation"), ("supplier", "lives_in", "nation"), ("nation", "part_of", "region")], "src_type string, rel string, dst_type string")
    return g.check_schema(_edges(spark, d), _vertices(spark, d), allowed).select("src", "rel", "dst")


def g3_k_hop(spark: SparkSession, d: str) -> DataFrame:
    return g.k_hop(_edges(spark, d), _vertices(spark, d).where("id IN ('c1', 'r2')").select("id"), 2)


def g4_match_count(spark: SparkSession, d: str) -> DataFrame:
    return g.match_count(_edges(spark, d), _vertices(spark, d), "lives_in", "id <> 'n3'")


def g5_communities(spark: SparkSession, d: str) -> DataFrame:
    return g.community_levels(_edges(spark, d))


def g5_leiden(spark: SparkSession, d: str) -> DataFrame:
    return lm.leiden(_edges(spark, d), passes=2, rounds=6)


def g5_modularity(spark: SparkSession, d: str) -> DataFrame:
    """Of the communities by label propagation."""
    edges = _edges(spark, d)
    return lm.modularity(edges, g.communities(edges)).select(F.round("modularity", 8).alias("modularity"))


def g6_community_report(spark: SparkSession, d: str) -> DataFrame:
    return g.community_report(g.communities(_edges(spark, d)), _edges(spark, d))


def g7_global_answer(spark: SparkSession, d: str) -> DataFrame:
    return g.global_answer(table(spark, d, "events").selectExpr("user_id AS question_id", "event_id AS part_id", "cast(value as int) % 100 AS rating"), 10, 3)


def g8_fact_check(spark: SparkSession, d: str) -> DataFrame:
    claims = table(spark, d, "customer").selectExpr("concat('c', c_custkey) AS src", "'lives_in' AS rel", "concat('n', CASE WHEN c_custkey % 9 = 0 THEN 99 ELSE c_nationkey END) AS dst")
    return g.fact_check(claims, _edges(spark, d))


QUERIES = {q.__name__: q for q in (
    e1_e3_e4_retrieval, e2_answer_recall, e5_supported_share, e6_answer_relevancy, e7_expected_score, e8_diagnose, e9_field_scores, e9_citation_scores, e10_compare_configs, t1_token_cost, t2_cached_cost, t3_stage_latency, t4_trace_rollup, t4_trace_report, t5_hard_failures, t6_ab_report, t7_sample_traces, t8_loop_tokens, t9_api_metrics, t9_sketched_metrics, t10_usage_stats, t10_usage_report,
    t11_status_mix, t12_rate_violations, t13_escalation_context, t14_conversation_window, t15_last_human_message, t16_merge_messages, t17_save_memory, t18_retrieve_memory, t19_distinct_in_order, t20_collect_tool_outputs, t20_research_result, g1_build_graph, g2_check_schema, g3_k_hop, g4_match_count, g5_communities, g5_leiden, g5_modularity, g6_community_report, g7_global_answer, g8_fact_check,
)}

_HITS = f"{_dense_sql(10, 'p.vec_id % 100 <> 0')}, j AS (SELECT query_id, a.label = b.label AS v, rank FROM dense JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = doc_id), n AS (SELECT a.vec_id AS query_id, COUNT(*) AS n FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 100 = 0 AND b.vec_id % 100 <> 0 GROUP BY 1)"


def _measures(k: int) -> str:
    return (
        f"SELECT ROUND(AVG(COALESCE(hit, 0) / 10), 6) AS precision, ROUND(AVG(COALESCE(hit, 0) / n), 6) AS recall, ROUND(AVG(COALESCE(1 / first, 0)), 6) AS mrr, ROUND(AVG(COALESCE(dcg, 0) / (SELECT SUM(1 / log2(i + 1)) FROM range(1, 11) r(i) WHERE i <= n)), 6) AS ndcg, ROUND(AVG(COALESCE(ps / hit, 0)), 6) AS context_precision FROM n LEFT JOIN "
        f"(SELECT query_id, SUM(v::INT) AS hit, MIN(rank) FILTER (v) AS first, SUM(v::INT / log2(rank + 1)) AS dcg, SUM(s / rank) FILTER (v) AS ps FROM (SELECT *, SUM(v::INT) OVER (PARTITION BY query_id ORDER BY rank) AS s FROM j WHERE rank <= {k}) GROUP BY 1) USING (query_id)"
    )


_MEM = "raw AS (SELECT conv_id % 20 AS user_id, conv_id * 100 + turn AS pos, CASE WHEN turn % 3 = 0 THEN '' ELSE trim(text, ' ') END AS memory FROM conversations), mem AS (SELECT user_id, memory, MIN(pos) AS pos, COUNT(*) OVER (PARTITION BY user_id) > 10 AS consolidate FROM raw WHERE memory <> '' GROUP BY 1, 2)"


def _spread(edges: str, name: str, rounds: int = 5) -> str:
    """Label propagation over edges: {name}_0 to {name}_{rounds} hold each vertex's label after so many rounds."""
    steps = [
        f"{name}_b AS (SELECT src, dst, CAST(SUM(weight) AS DOUBLE) AS w FROM (SELECT src, dst, weight FROM {edges} UNION ALL SELECT dst, src, weight FROM {edges}) GROUP BY 1, 2)",
        f"{name}_v AS MATERIALIZED (SELECT * FROM {name}_b UNION ALL SELECT src, src, SUM(w) / 2 FROM {name}_b GROUP BY src)",
        f"{name}_0 AS (SELECT DISTINCT src AS id, src AS community FROM {name}_v)",
    ]
    for k in range(rounds):
        votes = f"SELECT v.src AS id, l.community, SUM(w) AS s FROM {name}_v v JOIN {name}_{k} l ON l.id = v.dst GROUP BY 1, 2"
        steps.append(f"{name}_{k + 1} AS MATERIALIZED (SELECT id, community FROM ({votes}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, community) = 1)")
    return ", ".join(steps)


def _merged(level: int) -> str:
    """Communities of the communities of the level below, as l{level} with between{level}."""
    ends = f"edges e JOIN l{level - 1} a ON a.id = e.src JOIN l{level - 1} b ON b.id = e.dst WHERE a.community <> b.community"
    between = f"between{level} AS MATERIALIZED (SELECT a.community AS src, b.community AS dst, COUNT(*) AS weight FROM {ends} GROUP BY 1, 2)"
    labels = f"l{level} AS MATERIALIZED (SELECT l.id, COALESCE(c.community, l.community) AS community FROM l{level - 1} l LEFT JOIN c{level}_5 c ON c.id = l.community)"
    return f"{between}, {_spread(f'between{level}', f'c{level}')}, {labels}"


_LABELS = f"{_EDGES}, ones AS (SELECT src, dst, 1 AS weight FROM edges), {_spread('ones', 'c0')}, l0 AS (SELECT * FROM c0_5)"

ORACLES = {
    "e1_e3_e4_retrieval": f"WITH {_HITS} {_measures(10)}",
    "e2_answer_recall": "WITH a AS (SELECT doc_id AS q, substring(CASE WHEN doc_id % 3 = 0 THEN 'x' || text ELSE text END, 1, 50) AS a FROM documents WHERE doc_id % 100 = 0), f AS (SELECT q, MAX(CASE WHEN contains(text, a) THEN 1 ELSE 0 END) AS v FROM a JOIN documents ON doc_id - doc_id % 100 = q GROUP BY 1) SELECT ROUND(AVG(v), 6) AS recall FROM f",
    "e5_supported_share": "SELECT event_type, ROUND(AVG(CASE WHEN value > 30 THEN 1e0 ELSE 0e0 END), 6) AS share FROM events GROUP BY 1",
    "e6_answer_relevancy": "SELECT q.vec_id AS query_id, ROUND(AVG(list_cosine_similarity(q.embedding::DOUBLE[], g.embedding::DOUBLE[])), 6) AS relevancy FROM embeddings q JOIN embeddings g ON g.vec_id - g.vec_id % 100 = q.vec_id WHERE q.vec_id % 100 = 0 AND g.vec_id % 100 <> 0 GROUP BY 1",
    "e7_expected_score": "SELECT l_orderkey AS id, ROUND(SUM(l_linenumber * exp(-l_discount * 10)) / SUM(exp(-l_discount * 10)), 6) AS expected FROM lineitem GROUP BY 1",
    "e8_diagnose": "WITH m AS (SELECT (l_orderkey + l_linenumber) % 10 >= 7 AS r, (l_orderkey * 3 + l_linenumber) % 10 >= 7 AS p, (l_orderkey * 7 + l_linenumber) % 10 >= 7 AS f, (l_orderkey * 11 + l_linenumber) % 10 >= 7 AS a FROM lineitem) SELECT CASE WHEN NOT r AND NOT p AND NOT f THEN 'retriever_broken' WHEN NOT r AND p THEN 'retrieves_too_little' WHEN r AND NOT p THEN 'too_much_noise' WHEN NOT r THEN 'mixed' WHEN NOT f AND a THEN 'hallucination' WHEN f AND NOT a THEN 'off_topic' WHEN NOT f THEN 'weak_model' ELSE 'healthy' END AS \"case\", COUNT(*) AS n FROM m GROUP BY 1",
    "e9_field_scores": "WITH f AS (SELECT p_partkey, p_retailprice * (1 + (p_partkey % 4) * 0.005e0) AS a FROM part WHERE p_partkey % 7 <> 0), g AS (SELECT p_partkey, p_retailprice AS b FROM part WHERE p_partkey % 11 <> 0), j AS (SELECT a, b FROM f FULL JOIN g USING (p_partkey)) SELECT ROUND(COUNT(*) FILTER (abs(a - b) <= 0.01e0 * abs(b)) / COUNT(b), 6) AS numeric_accuracy, ROUND(COUNT(*) FILTER (a IS NOT NULL AND b IS NOT NULL) / COUNT(a), 6) AS precision, ROUND(COUNT(*) FILTER (a IS NOT NULL AND b IS NOT NULL) / COUNT(b), 6) AS recall, ROUND(2 * COUNT(*) FILTER (a IS NOT NULL AND b IS NOT NULL) / (COUNT(a) + COUNT(b)), 6) AS f1 FROM j",
    "e10_compare_configs": f"WITH {_HITS} SELECT 'ten' AS config, * FROM ({_measures(10)}) UNION ALL SELECT 'three', * FROM ({_measures(3)})",
    "t1_token_cost": "SELECT event_id, ROUND(CASE event_id % 3 WHEN 0 THEN event_id * 10 / 1e6 * 0.59e0 + event_id / 1e6 * 0.79e0 WHEN 1 THEN event_id * 10 / 1e6 * 3 + event_id / 1e6 * 15 END, 8) AS cost FROM events",
    "t2_cached_cost": "SELECT event_id, event_id * 4 + user_id * 7 AS input_tokens, ROUND((event_id + event_id * 3 * 1.25e0 + user_id * 7 * 0.1e0) / 1e6 * 3 + 500 / 1e6 * 15, 8) AS cost FROM events",
    "t3_stage_latency": "WITH s AS (SELECT event_id % 4 AS k, value * 20 AS ms FROM events) SELECT ['retrieval', 'rerank', 'first_token', 'stream'][k + 1] AS stage, COUNT(*) AS n, ROUND(AVG(ms), 4) AS mean_ms, ROUND(quantile_cont(ms, 0.95), 4) AS p95_ms, COUNT(*) FILTER (ms > [800, 500, 2000, 1000000000][k + 1]) AS n_slow FROM s GROUP BY k",
    "t4_trace_rollup": "SELECT event_id // 8 AS trace_id, COUNT(*) AS n_spans, MAX(CASE WHEN event_id % 8 = 0 THEN CAST(trunc(value * 10) AS BIGINT) END) AS duration_ms, CAST(SUM(event_id % 100) AS BIGINT) AS tokens, CASE WHEN COUNT(*) >= 4 THEN 4 ELSE COUNT(*) END AS depth FROM events GROUP BY 1",
    "t5_hard_failures": "SELECT DISTINCT event_id // 8 AS trace_id FROM events WHERE event_id % 100 % 13 = 0 OR (event_id % 100 % 5 <> 0 AND (event_id % 100 % 50) / 20e0 < 0.7)",
    "t6_ab_report": "SELECT user_id % 2 AS arm, COUNT(*) AS n, ROUND(AVG(CASE WHEN event_type = 'purchase' THEN 1e0 ELSE 0e0 END), 6) AS win_rate, ROUND(AVG((event_id % 10) / 10e0), 6) AS faithfulness, ROUND(AVG(event_id % 777), 4) AS tokens FROM events GROUP BY 1",
    "t8_loop_tokens": "WITH c AS (SELECT conv_id, turn, SUM(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS context FROM conversations) SELECT conv_id, turn, CAST(context AS BIGINT) AS context, CAST(SUM(context) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sent FROM c",
    "t9_api_metrics": "SELECT event_type AS route, user_id % 3 AS key, date_trunc('hour', ts) AS hour, COUNT(*) AS calls, COUNT(*) FILTER (user_id % 10 = 0) AS errors, ROUND(COUNT(*) FILTER (user_id % 10 = 0) / COUNT(*), 6) AS error_rate, ROUND(SUM(event_id / 100), 4) AS cost, ROUND(quantile_cont(value, 0.5), 4) AS p50, ROUND(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY 1, 2, 3",
    "t9_sketched_metrics": "WITH v AS (SELECT event_type AS route, user_id % 3 AS key, date_trunc('day', ts) AS start, user_id % 10 = 0 AS error, event_id / 100 AS cost, CASE WHEN event_id % 13 > 0 THEN value - 20 END AS ms FROM events), "
    "b AS (SELECT *, CASE WHEN ms IS NULL THEN NULL WHEN ms = 0 THEN 0 ELSE sign(ms) * (1048576 + ceil(ln(abs(ms)) / ln(1.01e0 / 0.99e0))) END AS bucket FROM v), g AS (SELECT route, key, start, COUNT(*) AS calls, COUNT(*) FILTER (error) AS errors, ROUND(SUM(cost), 2) AS cost, COUNT(ms) AS known FROM b GROUP BY 1, 2, 3), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY route, key, start ORDER BY bucket) AS r FROM b WHERE bucket IS NOT NULL), x AS (SELECT *, CASE WHEN bucket = 0 THEN 0 ELSE sign(bucket) * 2 / (1.01e0 / 0.99e0 + 1) * pow(1.01e0 / 0.99e0, abs(bucket) - 1048576) END AS v FROM o) "
    "SELECT route, key, start, calls, errors, g.cost, ROUND(MAX(v) FILTER (r = 1), 4) AS least, ROUND(MAX(v) FILTER (r = greatest(1, ceil(0.5e0 * known))), 4) AS p50, ROUND(MAX(v) FILTER (r = greatest(1, ceil(0.95e0 * known))), 4) AS p95 FROM g LEFT JOIN x USING (route, key, start) GROUP BY 1, 2, 3, 4, 5, 6",
    "t4_trace_report": "WITH s AS (SELECT event_id // 8 AS trace_id, event_id, event_id % 100 AS t, event_id % 3 > 0 AS gen, event_id % 100 * 10 AS pin, CASE WHEN event_id % 5 > 0 THEN event_id % 100 END AS pout FROM events), "
    "a AS (SELECT trace_id, COUNT(*) AS n_spans, CAST(SUM(pin + COALESCE(pout, 0)) AS BIGINT) AS tokens, CASE WHEN COUNT(*) >= 4 THEN 4 ELSE COUNT(*) END AS depth, COUNT(*) FILTER (gen) AS n_generations, COUNT(*) FILTER (NOT gen) AS n_events, SUM(CASE WHEN gen AND event_id % 4 = 0 THEN pin / 1e6 * 0.59e0 + pout / 1e6 * 0.79e0 WHEN gen AND event_id % 4 = 1 THEN pin / 1e6 * 3e0 + pout / 1e6 * 15e0 END) AS cost FROM s GROUP BY 1), "
    "c AS (SELECT event_id // 8 AS trace_id, AVG((event_id % 7) / 7e0) FILTER (event_id % 2 = 0) AS faithfulness, AVG((event_id % 7) / 7e0) FILTER (event_id % 2 = 1) AS feedback FROM events WHERE event_id // 8 % 6 > 0 GROUP BY 1) "
    "SELECT trace_id, n_spans, tokens, depth, n_generations, n_events, ROUND(cost, 8) AS cost, ROUND(faithfulness, 6) AS faithfulness, ROUND(feedback, 6) AS feedback FROM a LEFT JOIN c USING (trace_id)",
    "t10_usage_report": f"WITH x AS (SELECT CAST(user_id % 20 AS VARCHAR) AS bot, CASE WHEN user_id % 20 % 3 > 0 THEN 'course ' || user_id % 20 % 4 END AS course, user_id FROM events WHERE ts >= TIMESTAMP '{_SPAN[0]}' AND ts < TIMESTAMP '{_SPAN[1]}') SELECT course, bot, COUNT(*) AS calls, COUNT(DISTINCT user_id) AS users, CAST(GROUPING(course, bot) AS BIGINT) AS level FROM x WHERE bot = '7' OR starts_with(bot, '1') GROUP BY CUBE (course, bot)",
    "t20_research_result": "WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 4 > 0 THEN 'agent' || turn % 3 END AS agent, CASE WHEN turn % 3 = 0 THEN [] ELSE ['s' || (turn * 7 + conv_id) % 5, 's' || turn % 2] END AS sources, role, text FROM conversations), o AS (SELECT conv_id, md5(COALESCE(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (role = 'assistant' AND contains(text, 'th')), 'none')) AS outputs FROM r GROUP BY 1), "
    "s AS (SELECT conv_id, string_agg(DISTINCT x, ',' ORDER BY x) AS sources FROM r, UNNEST(sources) v(x) GROUP BY 1), f AS (SELECT conv_id, agent, MIN(turn) AS t FROM r WHERE agent IS NOT NULL GROUP BY 1, 2), a AS (SELECT conv_id, string_agg(agent, ',' ORDER BY t) AS agents FROM f GROUP BY 1) SELECT o.conv_id, outputs, COALESCE(sources, '') AS sources, COALESCE(agents, '') AS agents FROM o LEFT JOIN s USING (conv_id) LEFT JOIN a USING (conv_id)",
    "e9_citation_scores": "WITH r AS (SELECT event_id // 6 % 3 AS config, event_id // 6 AS a, event_id % 5 AS e, user_id % 9 > 0 AS known, list_distinct(CASE WHEN event_id % 7 = 0 THEN [] WHEN event_id % 3 = 0 THEN [user_id % 5, event_id % 5] ELSE [user_id % 5] END) AS cited FROM events), x AS (SELECT *, len(cited) AS n, known AND list_contains(cited, e) AS hit FROM r), "
    "b AS (SELECT config, a, bool_or(NOT known) AS bare FROM x GROUP BY 1, 2), h AS (SELECT config, ROUND(COUNT(*) FILTER (bare) / COUNT(*), 6) AS hallucination_rate FROM b GROUP BY 1) "
    "SELECT config, COUNT(*) AS claims, CAST(SUM(n) AS BIGINT) AS citations, ROUND(COUNT(*) FILTER (hit) / SUM(n), 6) AS citation_accuracy, ROUND(COUNT(*) FILTER (hit) / COUNT(*), 6) AS citation_completeness, ROUND(COUNT(*) FILTER (NOT known) / COUNT(*), 6) AS unsupported_rate, hallucination_rate FROM x JOIN h USING (config) GROUP BY 1, hallucination_rate",
    "t10_usage_stats": "WITH x AS (SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, user_id FROM events) SELECT COALESCE(event_type, 'all') AS event_type, COALESCE(day, 'all') AS day, COUNT(*) AS calls, COUNT(DISTINCT user_id) AS users, CAST(GROUPING(event_type, day) AS BIGINT) AS level FROM x GROUP BY CUBE (event_type, day)",
    "t11_status_mix": "WITH n AS (SELECT user_id % 20 AS bot, event_type AS status, COUNT(*) AS n FROM events GROUP BY 1, 2) SELECT bot, status, n, ROUND(n / SUM(n) OVER (PARTITION BY bot), 6) AS share FROM n",
    "t12_rate_violations": "SELECT event_type, date_trunc('hour', ts) AS start, COUNT(*) AS n FROM events GROUP BY 1, 2 HAVING COUNT(*) > 3",
    "t13_escalation_context": "WITH r AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4) SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS context FROM r GROUP BY 1",
    "t14_conversation_window": "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4",
    "t15_last_human_message": "SELECT conv_id, MAX(turn) AS turn, md5(arg_max(text, turn)) AS text FROM conversations WHERE role = 'user' GROUP BY 1",
    "t16_merge_messages": "SELECT conv_id, turn, CASE WHEN turn >= 2 THEN 'edited' ELSE role END AS role FROM conversations",
    "t17_save_memory": f"WITH {_MEM} SELECT user_id, memory, pos, consolidate FROM mem",
    "t18_retrieve_memory": f"WITH {_MEM}, h AS (SELECT user_id, pos, memory, CASE user_id % 3 WHEN 0 THEN contains(lower(memory), 'the') OR contains(lower(memory), 'zq') WHEN 1 THEN contains(lower(memory), 'er') ELSE contains(lower(memory), 'qqqq') END AS hit FROM mem WHERE user_id < 25) SELECT user_id, pos, memory FROM h QUALIFY hit OR NOT bool_or(hit) OVER (PARTITION BY user_id)",
    "t19_distinct_in_order": "WITH f AS (SELECT user_id, event_type, MIN(event_id) AS k FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ',' ORDER BY k) AS agents FROM f GROUP BY 1",
    "t20_collect_tool_outputs": "SELECT conv_id, md5(COALESCE(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (role = 'assistant' AND contains(text, 'th')), 'none')) AS outputs FROM conversations GROUP BY 1",
    "g1_build_graph": "SELECT CASE WHEN l_partkey % 100 < 25 THEN 'p' || (l_partkey % 100 % 5) ELSE 'p' || (l_partkey % 100) END AS src, 'sold_by' AS rel, 's' || l_suppkey AS dst, SUM(l_quantity) AS weight FROM lineitem GROUP BY 1, 2, 3",
    "g2_check_schema": f"WITH {_EDGES} SELECT * FROM edges WHERE rel = 'owns'",
    "g3_k_hop": f"WITH RECURSIVE {_EDGES}, nb AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), h AS (SELECT 'c1' AS id, 0 AS hop UNION SELECT 'r2', 0 UNION SELECT dst, hop + 1 FROM h JOIN nb ON src = id WHERE hop < 2) SELECT id, MIN(hop) AS hop FROM h GROUP BY 1",
    "g4_match_count": f"WITH {_EDGES} SELECT dst, COUNT(*) AS n FROM edges WHERE rel = 'lives_in' AND dst <> 'n3' GROUP BY 1",
    "g5_communities": f"WITH {_LABELS}, {_merged(1)}, {_merged(2)}, levels AS (SELECT id, 0 AS level, community FROM l0 UNION ALL SELECT id, 1, community FROM l1 WHERE EXISTS (FROM between1) UNION ALL SELECT id, 2, community FROM l2 WHERE EXISTS (FROM between2)) SELECT a.id, a.level, a.community, b.community AS parent FROM levels a LEFT JOIN levels b ON b.id = a.id AND b.level = a.level + 1",
    "g5_modularity": f"WITH {_LABELS}, k AS (SELECT id, COUNT(*) AS k FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1), t AS (SELECT community, SUM(k) AS k FROM k JOIN l0 USING (id) GROUP BY 1), i AS (SELECT COUNT(*) AS n FROM edges e JOIN l0 a ON a.id = e.src JOIN l0 b ON b.id = e.dst WHERE a.community = b.community) "
    "SELECT ROUND(2 * (SELECT n FROM i) / SUM(k) - SUM(k * k) / (SUM(k) * SUM(k)), 8) AS modularity FROM t",
    "g6_community_report": f"WITH {_LABELS}, degrees AS (SELECT id, COUNT(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1), ranked AS (SELECT community, id, row_number() OVER (PARTITION BY community ORDER BY degree DESC NULLS LAST, id) AS k FROM l0 LEFT JOIN degrees USING (id)), nodes AS (SELECT community, COUNT(*) AS n_nodes, string_agg(id, ',' ORDER BY k) FILTER (k <= 3) AS top FROM ranked GROUP BY 1), inner_edges AS (SELECT a.community, COUNT(*) AS n FROM edges e JOIN l0 a ON a.id = e.src JOIN l0 b ON b.id = e.dst WHERE a.community = b.community GROUP BY 1) SELECT community, n_nodes, COALESCE(n, 0) AS n_edges, top FROM nodes LEFT JOIN inner_edges USING (community)",
    "g7_global_answer": "SELECT user_id AS question_id, event_id AS part_id, CAST(trunc(value) AS INT) % 100 AS rating, row_number() OVER (PARTITION BY user_id ORDER BY CAST(trunc(value) AS INT) % 100 DESC, event_id) AS rank FROM events WHERE CAST(trunc(value) AS INT) % 100 >= 10 QUALIFY rank <= 3",
    "g8_fact_check": f"WITH {_EDGES}, c AS (SELECT 'c' || c_custkey AS src, 'lives_in' AS rel, 'n' || CASE WHEN c_custkey % 9 = 0 THEN 99 ELSE c_nationkey END AS dst FROM customer) SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = c.src AND e.rel = c.rel AND e.dst = c.dst)",
}
