"""Cost, latency, traces, usage and conversations."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cut import cut
from .filters import prefix_filter
from .quantiles import at_rank, bucket, exact_quantiles, ordered_buckets, same
from .search import small

# Limits in ms by stage; factors of the base price for writing and reading cached input.
STAGE_LIMITS = {"retrieval": 800, "rerank": 500, "first_token": 2000}
CACHE_WRITE, CACHE_READ = 1.25, 0.1


def token_cost(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """The rows (model, prompt_tokens, completion_tokens) with cost, by prices (model, p_in, p_out) per million; null for a model without a price."""
    return rows.join(small(prices), "model", "left").withColumn("cost", F.col("prompt_tokens") / 1e6 * F.col("p_in") + F.col("completion_tokens") / 1e6 * F.col("p_out")).drop("p_in", "p_out")


def cached_token_cost(plain: Column, written: Column, read: Column, output: Column, p_in: float, p_out: float) -> Column:
    return F.struct((plain + written + read).alias("input_tokens"), ((plain + written * CACHE_WRITE + read * CACHE_READ) / 1e6 * p_in + output / 1e6 * p_out).alias("cost"))


def stage_latency(rows: DataFrame, by: str = "stage", ms: str = "ms") -> DataFrame:
    limit = F.create_map(*(F.lit(x) for kv in STAGE_LIMITS.items() for x in kv))
    slow = F.sum(F.when(F.col(ms) > F.coalesce(F.try_element_at(limit, F.col(by)), F.lit(1 << 30)), 1).otherwise(0))
    out = rows.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(ms), 4).alias("mean_ms"), slow.alias("n_slow"))
    q = exact_quantiles(rows, [by], ms, [0.95]).select(F.col(by).alias(f"{by}_"), F.round(F.col("quantiles")[0], 4).alias("p95_ms"))
    return out.join(q, same([by]), "left").select(by, "n", "mean_ms", "p95_ms", "n_slow")


def trace_rollup(spans: DataFrame) -> DataFrame:
    """trace_id: spans, the root's duration, tokens, depth of the tree below roots; spans whose chain of parents doesn't end at a root have no depth.

    Each round doubles the steps up that a span knows, so a chain of n spans takes log2 n rounds."""
    up = cut(spans.select("trace_id", "span_id", F.col("parent_id").alias("up"), F.lit(1).cast("long").alias("depth")), "depth")
    most = up.groupBy("trace_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(int(most).bit_length()):
        over = up.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_d"))
        known = up.where("up IS NULL")
        up = cut(known.unionByName(up.where("up IS NOT NULL").join(over, ["trace_id", "up"]).select("trace_id", "span_id", F.col("_up").alias("up"), (F.col("depth") + F.col("_d")).alias("depth"))), "depth")
        if up.where("up IS NOT NULL").isEmpty():
            break
    deep = up.where("up IS NULL").groupBy("trace_id").agg(F.max("depth").cast("int").alias("depth"))
    sums = spans.groupBy("trace_id").agg(F.count("*").alias("n_spans"), F.max(F.when(F.col("parent_id").isNull(), F.col("duration_ms"))).alias("duration_ms"), F.sum("tokens").alias("tokens"))
    return sums.join(deep, "trace_id", "left")


def trace_report(spans: DataFrame, prices: DataFrame, scores: DataFrame) -> DataFrame:
    """trace_rollup with n_generations, n_events, cost and scores: the cost of the trace's generations by prices (model, p_in, p_out), null if none has one; scores (trace_id, name, value) as a map of the mean of each name.

    Spans have trace_id, span_id, parent_id, kind (span, generation, event), duration_ms, model, prompt_tokens and completion_tokens. Scores of traces without spans are left out.
    """
    spans = spans.withColumn("tokens", F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0)))
    costs = token_cost(spans, prices).groupBy("trace_id").agg(F.sum(F.when(F.col("kind") == "generation", 1).otherwise(0)).alias("n_generations"), F.sum(F.when(F.col("kind") == "event", 1).otherwise(0)).alias("n_events"), F.sum(F.when(F.col("kind") == "generation", F.col("cost"))).alias("cost"))
    means = scores.groupBy("trace_id", "name").agg(F.avg("value").alias("value")).groupBy("trace_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("scores"))
    return trace_rollup(spans).join(costs, "trace_id").join(means, "trace_id", "left")


def hard_failures(traces: DataFrame) -> DataFrame:
    return traces.where("feedback = 0 OR faithfulness < 0.7").select("trace_id").distinct()


def ab_arm(user: Column) -> Column:
    return F.pmod(F.xxhash64(user), F.lit(2)).cast("int")


def ab_report(rows: DataFrame, arm: str = "arm") -> DataFrame:
    return rows.groupBy(arm).agg(F.count("*").alias("n"), F.round(F.avg(F.col("win").cast("double")), 6).alias("win_rate"), F.round(F.avg("faithfulness"), 6).alias("faithfulness"), F.round(F.avg("tokens"), 4).alias("tokens"))


def sample_traces(traces: DataFrame, share: float = 0.1, seed: int = 7) -> DataFrame:
    """All errors and all traces of VIPs, of the others a share by hash: the same ones at every run."""
    return traces.where(F.col("error") | F.col("vip") | (F.pmod(F.xxhash64("trace_id", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20))))


def loop_tokens(rows: DataFrame, by: str, order: str, tokens: str) -> DataFrame:
    """Tokens sent when each turn sends all turns so far: a running sum of running sums."""
    w = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("context", F.sum(tokens).over(w)).withColumn("sent", F.sum("context").over(w))


def api_metrics(rows: DataFrame) -> DataFrame:
    """route, key, hour, calls, errors, error_rate, cost, p50, p95 of ms, for rows with route, key, ts, error, cost, ms. Quantiles are exact and counted over ranges of values, so no task orders a route's rows."""
    by, errors = ["route", "key", "hour"], F.sum(F.col("error").cast("int"))
    rows = rows.withColumn("hour", F.date_trunc("hour", "ts"))
    out = rows.groupBy(*by).agg(F.count("*").alias("calls"), errors.alias("errors"), F.round(errors / F.count("*"), 6).alias("error_rate"), F.round(F.sum("cost"), 4).alias("cost"))
    q = exact_quantiles(rows, by, "ms", [0.5, 0.95]).select(*(F.col(c).alias(f"{c}_") for c in by), *(F.round(F.col("quantiles")[i], 4).alias(k) for i, k in enumerate(("p50", "p95"))))
    return out.join(q, same(by), "left").select(*by, "calls", "errors", "error_rate", "cost", "p50", "p95")


def sketched_metrics(rows: DataFrame, by: Sequence[str] = ("route", "key"), every: str = "1 hour", probs: Sequence[float] = (0.5, 0.95), alpha: float = 0.01) -> DataFrame:
    """by, start, calls, errors, cost, quantiles of ms in each span of time: api_metrics by a sketch, whose quantiles lie within a share of `alpha` of the value at that rank.

    Counts of buckets are aggregated first, so a hot route's rows meet as a few thousand counts. Takes a streaming frame with a watermark too: the
    state is those counts, and a span's row comes once the watermark has passed it; rows later than that are left out.
    """
    parts = rows.groupBy(F.window("ts", every), *by, bucket(F.col("ms"), alpha).alias("bucket")).agg(F.count("*").alias("n"), F.sum(F.col("error").cast("long")).alias("errors"), F.sum(F.col("cost").cast("decimal(28,6)")).alias("cost"))
    known = F.sum(F.when(F.col("bucket").isNotNull(), F.col("n")))
    out = parts.groupBy("window", *by).agg(F.sum("n").alias("calls"), F.sum("errors").alias("errors"), F.sum("cost").cast("double").alias("cost"), known.alias("known"), ordered_buckets().alias("b"))
    return out.select(*by, F.col("window.start").alias("start"), "calls", "errors", "cost", F.array(*(at_rank(F.col("b"), F.col("known"), p, alpha) for p in probs)).alias("quantiles"))


def usage_stats(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Calls and users for every combination of the columns; null stands for all."""
    return rows.cube(*by).agg(F.count("*").alias("calls"), F.countDistinct("user_id").alias("users"), F.grouping_id().alias("level"))


def usage_report(rows: DataFrame, groups: DataFrame, by: Sequence[str], start: str | None = None, end: str | None = None, bots: Sequence[str] = ()) -> DataFrame:
    """usage_stats over calls (bot, ts, user_id) joined with the mapping of bots to courses and classes (bot, ...): from `start` on and before `end`, for bots that `bots` names, where a trailing * means any ending; none names all.

    Filters reach the scan. A bot without a mapping has nulls for what the mapping says, which level tells from those that stand for all.
    """
    if start is not None:
        rows = rows.where(F.col("ts") >= F.to_timestamp(F.lit(start)))
    if end is not None:
        rows = rows.where(F.col("ts") < F.to_timestamp(F.lit(end)))
    return usage_stats(prefix_filter(rows, "bot", bots).join(small(groups), "bot", "left"), by)


def status_mix(rows: DataFrame, by: str, status: str = "status") -> DataFrame:
    n = rows.groupBy(by, status).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy(by)), 6))


def rate_violations(rows: DataFrame, key: str, every: str = "1 minute", most: int = 120, ts: str = "ts") -> DataFrame:
    """key, start, n of the spans of time with more than `most` rows. Takes a streaming frame with a watermark too."""
    return rows.groupBy(key, F.window(ts, every)).agg(F.count("*").alias("n")).where(F.col("n") > most).select(key, F.col("window.start").alias("start"), "n")


def conversation_window(rows: DataFrame, k: int = 6) -> DataFrame:
    """The last k exchanges, two messages each, of every conversation."""
    back = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    return rows.withColumn("_back", back).where(F.col("_back") <= 2 * k).drop("_back")


def last_human_message(rows: DataFrame, role: str = "user") -> DataFrame:
    return rows.where(F.col("role") == role).groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"), F.max("turn").alias("turn"))


def escalation_context(rows: DataFrame, n: int = 10, key: Sequence[str] = ("conv_id", "turn")) -> DataFrame:
    """conv_id, context: the last n turns, a message id once, in order."""
    w = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = rows.dropDuplicates(list(key)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    return last.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("x")))), lambda r: r["x"]), "\n").alias("context"))


def merge_messages(old: DataFrame, new: DataFrame, key: Sequence[str] = ("conv_id", "turn")) -> DataFrame:
    """Appends; a message with a known id replaces it."""
    return old.join(new.select(*key), list(key), "left_anti").unionByName(new)


def save_memory(rows: DataFrame, most: int = 10) -> DataFrame:
    """user_id, pos, memory trimmed, blank and repeated ones gone, the first place kept; `consolidate` if a user has more than `most`."""
    kept = rows.withColumn("memory", F.trim("memory")).where("memory <> ''").groupBy("user_id", "memory").agg(F.min("pos").alias("pos"))
    return kept.withColumn("consolidate", F.count("*").over(W.partitionBy("user_id")) > most)


def retrieve_memory(memories: DataFrame, queries: DataFrame) -> DataFrame:
    """Of each user's memories those that contain a word of the user's query (user_id, query), regardless of case; all if none does."""
    rows = memories.join(queries, "user_id").withColumn("hit", F.exists(F.split(F.lower("query"), r"\s+"), lambda w: (w != "") & F.contains(F.lower("memory"), w)))
    return rows.withColumn("any", F.max("hit").over(W.partitionBy("user_id"))).where("hit OR NOT any").select("user_id", "pos", "memory")


def distinct_in_order(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """by, values: each value once, in order of its first place."""
    return rows.groupBy(by).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])).alias("values"))


def collect_tool_outputs(rows: DataFrame, tag: str, role: str = "assistant", default: str = "none") -> DataFrame:
    """conv_id, outputs: messages of the role that carry the tag, in order, a blank line between; the default where there is none."""
    found = rows.where((F.col("role") == role) & F.contains("text", F.lit(tag))).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("outputs"))
    return rows.select("conv_id").distinct().join(found, "conv_id", "left").withColumn("outputs", F.coalesce("outputs", F.lit(default)))


def research_result(rows: DataFrame, tag: str, role: str = "assistant", default: str = "none") -> DataFrame:
    """conv_id, outputs, sources, agents: collect_tool_outputs with the sources (an array a message) and agents of all messages of the conversation, each once, in order of their first turn."""
    first = lambda value: distinct_in_order(value, "conv_id", "turn", "v")
    sources = first(rows.select("conv_id", "turn", F.explode("sources").alias("v")).where("v IS NOT NULL").groupBy("conv_id", "v").agg(F.min("turn").alias("turn")))
    agents = first(rows.where("agent IS NOT NULL").groupBy("conv_id", F.col("agent").alias("v")).agg(F.min("turn").alias("turn")))
    out = collect_tool_outputs(rows, tag, role, default)
    none = F.array().cast("array<string>")
    for name, x in (("sources", sources), ("agents", agents)):
        out = out.join(x.withColumnRenamed("values", name), "conv_id", "left").withColumn(name, F.coalesce(name, none))
    return out
