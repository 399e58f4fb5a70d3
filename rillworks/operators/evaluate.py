"""Measures of retrieval and of answers."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vector import cosine


def _mean(c: Column, name: str) -> Column:
    return F.round(F.avg(c), 6).alias(name)


def retrieval_measures(hits: DataFrame, judgements: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """precision (relevant of the first k, over k), recall, mrr, ndcg and context_precision at k, means over all queries that have a judgement.

    hits: query_id, item_id, rank; judgements: query_id, item_id, relevant. `by` are columns of both that tell configurations apart.
    """
    keys = [*by, "query_id"]
    good = judgements.where("relevant").select(*keys, "item_id").distinct()
    n = judgements.groupBy(*keys).agg(F.sum(F.col("relevant").cast("int")).alias("n_relevant"))
    rows = hits.where(F.col("rank") <= k).join(good.withColumn("v", F.lit(1)), [*keys, "item_id"], "left").withColumn("v", F.coalesce("v", F.lit(0)))
    so_far = F.sum("v").over(W.partitionBy(*keys).orderBy("rank"))
    rows = rows.withColumn("p", F.when(F.col("v") == 1, so_far / F.col("rank")))
    each = rows.groupBy(*keys).agg(F.sum("v").alias("hit"), F.min(F.when(F.col("v") == 1, F.col("rank"))).alias("first"), F.sum(F.col("v") / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum("p").alias("ps"))
    each = n.join(each, keys, "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("n_relevant", F.lit(k)).cast("int"))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    hit = F.coalesce("hit", F.lit(0))
    measures = [
        _mean(hit / k, "precision"), _mean(F.coalesce(hit / F.nullif("n_relevant", F.lit(0)), F.lit(0.0)), "recall"), _mean(F.coalesce(1 / F.col("first"), F.lit(0.0)), "mrr"),
        _mean(F.when(F.col("n_relevant") > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0), "ndcg"), _mean(F.coalesce(F.col("ps") / F.nullif(hit, F.lit(0)), F.lit(0.0)), "context_precision"),
    ]
    return each.groupBy(*by).agg(*measures) if by else each.agg(*measures)


def answer_recall(hits: DataFrame, answers: DataFrame, k: int, begin: int = 50) -> DataFrame:
    """The share of queries whose answer's first `begin` characters stand in one of the first k texts."""
    found = answers.join(hits.where(F.col("rank") <= k), "query_id", "left").groupBy("query_id").agg(F.max(F.coalesce(F.contains("text", F.substring("answer", 1, begin)), F.lit(False)).cast("int")).alias("v"))
    return found.agg(_mean(F.col("v"), "recall"))


def supported_share(claims: DataFrame, by: str, verdict: str = "supported") -> DataFrame:
    """Context recall, faithfulness: supported claims over all."""
    return claims.groupBy(by).agg(_mean(F.col(verdict).cast("double"), "share"))


def answer_relevancy(questions: DataFrame, generated: DataFrame) -> DataFrame:
    """query_id, relevancy: the mean cosine of a question's vector with those of the questions that its answer would fit."""
    rows = generated.select("query_id", F.col("vector").alias("_g")).join(questions.select("query_id", "vector"), "query_id")
    return rows.groupBy("query_id").agg(_mean(cosine(F.col("vector"), F.col("_g")), "relevancy"))


def expected_score(rows: DataFrame, key: str, score: str = "score", logprob: str = "logprob") -> DataFrame:
    """The mean score under the softmax of log-probabilities."""
    top = F.max(logprob).over(W.partitionBy(key))
    rows = rows.withColumn("_w", F.exp(F.col(logprob) - top))
    return rows.groupBy(key).agg(F.round(F.sum(F.col(score) * F.col("_w")) / F.sum("_w"), 6).alias("expected"))


def diagnose(recall: Column, precision: Column, faithfulness: Column, relevancy: Column, low: float = 0.7) -> Column:
    """The first case of the table that fits, from low and high measures."""
    r, p, f, a = (x >= low for x in (recall, precision, faithfulness, relevancy))
    return F.when(~r & ~p & ~f, "retriever_broken").when(~r & p, "retrieves_too_little").when(r & ~p, "too_much_noise").when(r & p & ~f & a, "hallucination").when(r & p & f & ~a, "off_topic").when(r & p & ~f & ~a, "weak_model").when(r & p & f & a, "healthy").otherwise("mixed")


def field_scores(found: DataFrame, gold: DataFrame, keys: Sequence[str], tolerance: float = 0.01) -> DataFrame:
    """numeric_accuracy (gold values met within the relative tolerance), precision, recall and f1 of fields present."""
    both = found.select(*keys, F.col("value").alias("a")).join(gold.select(*keys, F.col("value").alias("b")), list(keys), "full_outer")
    near = F.when(F.col("b") == 0, F.col("a") == 0).otherwise(F.abs(F.col("a") - F.col("b")) <= tolerance * F.abs("b"))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    s = both.agg(one(F.coalesce(near, F.lit(False))).alias("ok"), one(F.col("b").isNotNull()).alias("g"), one(F.col("a").isNotNull()).alias("f"), one(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("m"))
    return s.select(F.round(F.col("ok") / F.col("g"), 6).alias("numeric_accuracy"), F.round(F.col("m") / F.col("f"), 6).alias("precision"), F.round(F.col("m") / F.col("g"), 6).alias("recall"), F.round(2 * F.col("m") / (F.col("f") + F.col("g")), 6).alias("f1"))


def citation_scores(claims: DataFrame, citations: DataFrame, evidence: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, claims, citations, citation_accuracy (citations that name evidence of their claim), citation_completeness (claims with such a citation), unsupported_rate (claims without any evidence), hallucination_rate (answers with such a claim).

    claims: by, answer_id, claim_no; citations and evidence: answer_id, claim_no, source_id. A source counts once a claim; citations of no claim count as wrong, with nulls for `by`.
    """
    key = ["answer_id", "claim_no"]
    true = evidence.select(*key, "source_id").distinct().withColumn("true", F.lit(1))
    cited = citations.select(*key, "source_id").distinct().join(true, [*key, "source_id"], "left").groupBy(*key).agg(F.count("*").alias("cited"), F.sum(F.coalesce("true", F.lit(0))).alias("right"))
    known = true.groupBy(*key).agg(F.count("*").alias("known"))
    rows = claims.select(*by, *key).distinct().withColumn("claim", F.lit(1)).join(cited, key, "full_outer").join(known, key, "left").na.fill(0, ["claim", "cited", "right", "known"])
    answers = rows.groupBy(*by, "answer_id").agg(F.sum("claim").alias("claims"), F.sum("cited").alias("citations"), F.sum("right").alias("right"), F.sum(F.when((F.col("claim") == 1) & (F.col("right") > 0), 1).otherwise(0)).alias("complete"), F.sum(F.when((F.col("claim") == 1) & (F.col("known") == 0), 1).otherwise(0)).alias("bare"))
    share = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    total, one = lambda c: F.sum(c), lambda c: F.sum(F.when(c, 1).otherwise(0))
    return answers.groupBy(*by).agg(total("claims").alias("claims"), total("citations").alias("citations"), share(total("right"), total("citations")).alias("citation_accuracy"), share(total("complete"), total("claims")).alias("citation_completeness"), share(total("bare"), total("claims")).alias("unsupported_rate"), share(one(F.col("bare") > 0), one(F.col("claims") > 0)).alias("hallucination_rate"))
