"""Detection and classification queries over boxes, scores and small grids made of order lines, labels and vectors."""

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes as b
from ..operators import classify as c
from ..operators import detect as x
from ..operators import drift as dr
from .finance import table

#: Boxes of an order's lines: the same text in Spark and in DuckDB.
_BOX = {
    "image_id": "l_orderkey", "box_id": "l_orderkey * 10 + l_linenumber", "class_id": "CAST(l_linenumber % 2 AS INT)", "x1": "(l_partkey % 40) * 1e0", "y1": "(l_suppkey % 40) * 1e0",
    "x2": "(l_partkey % 40) + l_quantity * 2e0 + 8e0", "y2": "(l_suppkey % 40) + l_quantity + 30e0", "score": "((l_orderkey * 7 + l_linenumber * 13) % 97) / 97e0", "noise": "(l_orderkey * 3 + l_linenumber) % 11",
}
_BOXES = "boxes AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in _BOX.items()) + " FROM lineitem), pred AS (SELECT image_id, box_id, class_id, x1 + noise AS x1, y1 + noise AS y1, x2, y2 + noise * 2 AS y2, score FROM boxes WHERE noise <> 4), truth AS (SELECT * FROM boxes WHERE noise <> 7)"


def boxes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(*(f"{v} AS {k}" for k, v in _BOX.items()))


def predicted(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).where("noise <> 4").selectExpr("image_id", "box_id", "class_id", "x1 + noise AS x1", "y1 + noise AS y1", "x2", "y2 + noise * 2 AS y2", "score")


def truth(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).where("noise <> 7")


def d1_d2_pairwise_iou(spark: SparkSession, d: str) -> DataFrame:
    return x.pairwise_iou(predicted(spark, d), truth(spark, d)).select("a_id", "b_id", F.round("iou", 10).alias("iou"))


def d3_nms(spark: SparkSession, d: str) -> DataFrame:
    return x.nms(predicted(spark, d))


def d4_corners(spark: SparkSession, d: str) -> DataFrame:
    s = b.yolo_to_xyxy(F.col("x1") / 100, F.col("y1") / 100, (F.col("x2") - F.col("x1")) / 200, (F.col("y2") - F.col("y1")) / 200, F.lit(640.0), F.lit(480.0))
    t = b.xywh_to_xyxy(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return boxes(spark, d).select("box_id", s.alias("s"), t.alias("t")).select("box_id", *(F.round(f"s.{k}", 6).alias(k) for k in ("x1", "y1", "x2", "y2")), F.round("t.x2", 6).alias("right"))


def _matched(spark: SparkSession, d: str, least: float = 0.5) -> DataFrame:
    return x.match_detections(predicted(spark, d), truth(spark, d), least)


def d5_match(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d).groupBy("class_id", "tp").agg(F.count("*").alias("n"))


def _curve(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall of detections marked as hits by their noise."""
    rows = predicted(spark, d).join(boxes(spark, d).select("box_id", "noise"), "box_id").withColumn("tp", F.col("noise") < 6)
    return x.pr_curve(rows, truth(spark, d).groupBy("class_id").agg(F.count("*").alias("n_truth")))


def d6_pr_curve(spark: SparkSession, d: str) -> DataFrame:
    return _curve(spark, d).select("box_id", "cum_tp", "cum_fp", F.round("precision", 10).alias("precision"), F.round("recall", 10).alias("recall"))


def d7_average_precision(spark: SparkSession, d: str) -> DataFrame:
    return x.average_precision(_curve(spark, d)).select("class_id", F.round("ap", 6).alias("ap"))


def d8_mean_ap(spark: SparkSession, d: str) -> DataFrame:
    return x.mean_ap(predicted(spark, d), truth(spark, d))


def d8_mean_ap_by_size(spark: SparkSession, d: str) -> DataFrame:
    """Boxes half as large again, so that all three bands have some."""
    larger = lambda rows: rows.withColumns({k: F.col(k) * 1.5 for k in ("x1", "y1", "x2", "y2")})
    return x.mean_ap_by_size(larger(predicted(spark, d)), larger(truth(spark, d)))


def d8_size_bands(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).groupBy(x.size_band(b.box()).alias("band")).agg(F.count("*").alias("n"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return rows.selectExpr("doc_id AS id", "quality AS y", "(n_chars % 97 + quality * 20) / 117e0 AS score", "quality AS label", "CASE WHEN n_chars % 5 = 0 THEN 1 - quality ELSE quality END AS predicted", "lang")


_SCORED = "scored AS (SELECT doc_id AS id, quality AS y, (n_chars % 97 + quality * 20) / 117e0 AS score, quality AS label, CASE WHEN n_chars % 5 = 0 THEN 1 - quality ELSE quality END AS predicted, lang FROM labels JOIN documents USING (doc_id))"
_CUTS = [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]


def d9_roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return x.roc_auc(scored(spark, d), by=["lang"]).select("lang", F.round("auc", 6).alias("auc"))


def d9_roc_curve(spark: SparkSession, d: str) -> DataFrame:
    return x.roc_curve(scored(spark, d), by=["lang"]).select("lang", F.round("threshold", 6).alias("threshold"), F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


def d9_ks_gini(spark: SparkSession, d: str) -> DataFrame:
    return dr.ks_statistic(scored(spark, d), by=["lang"]).select("lang", F.round("ks", 6).alias("ks"), F.round("gini", 6).alias("gini"))


def d10_pr_auc(spark: SparkSession, d: str) -> DataFrame:
    return x.pr_auc(scored(spark, d)).select(F.round("ap", 6).alias("ap"), F.round("baseline", 6).alias("baseline"))


def d11_threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return x.threshold_sweep(scored(spark, d), _CUTS).select("threshold", "tp", "fp", "fn", "tn", *(F.round(k, 6).alias(k) for k in ("precision", "recall", "f1")))


def _costs(spark: SparkSession, d: str) -> DataFrame:
    rows = x.threshold_sweep(scored(spark, d), _CUTS)
    return rows.select("threshold", "f1", x.cost_from_rates(F.col("precision"), F.col("recall"), F.lit(99)).alias("k")).select("threshold", "f1", "k.*")


def d12_cost(spark: SparkSession, d: str) -> DataFrame:
    return _costs(spark, d).drop("f1")


def d13_best_threshold(spark: SparkSession, d: str) -> DataFrame:
    a, k = x.best_threshold(_costs(spark, d)), x.best_threshold(_costs(spark, d), "cost", False)
    return a.select(F.lit("f1").alias("metric"), "threshold").unionByName(k.select(F.lit("cost").alias("metric"), "threshold"))


def d14_confusion(spark: SparkSession, d: str) -> DataFrame:
    return c.confusion(scored(spark, d)).crossJoin(F.broadcast(c.accuracy(scored(spark, d)))).withColumn("accuracy", F.round("accuracy", 6))


def d15_report(spark: SparkSession, d: str) -> DataFrame:
    return c.classification_report(scored(spark, d)).select("class", *(F.round(k, 6).alias(k) for k in ("precision", "recall", "f1")), "support")


def d16_overfit_gap(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d).groupBy("lang").agg(F.avg(F.when(F.col("id") % 5 < 4, (F.col("label") == F.col("predicted")).cast("double"))).alias("t"), F.avg(F.when(F.col("id") % 5 == 4, (F.col("label") == F.col("predicted")).cast("double"))).alias("v"))
    return rows.select("lang", c.overfit_gap(F.col("t"), F.col("v"), 0.0).alias("g")).select("lang", F.round("g.gap", 6).alias("gap"), "g.overfit")


def d17_mean_loss(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_returnflag", F.array(*(F.expr(v) for v in ("l_quantity / 10", "l_discount * 30", "l_tax * 40"))).alias("x"), F.expr("cast(l_orderkey % 3 as int)").alias("y"))
    return rows.groupBy("l_returnflag").agg(F.round(F.avg(c.cross_entropy(F.col("x"), F.col("y"))), 6).alias("loss"), F.round(F.avg(c.softmax(F.col("x"))[0]), 6).alias("p0"))


def d18_pixel_iou(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").selectExpr("cast(l_partkey % 4 as int) AS truth", "cast(CASE WHEN l_suppkey % 3 = 0 THEN (l_partkey + 1) % 4 ELSE l_partkey % 4 END as int) AS predicted")
    return c.pixel_iou(rows, [0, 1, 2, 3, 9]).select("class", F.round("iou", 6).alias("iou"), F.round("dice", 6).alias("dice"))


def d19_split(spark: SparkSession, d: str) -> DataFrame:
    return c.split_80_20(table(spark, d, "documents").select("doc_id"), "doc_id").groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_ids"))


def d20_mixup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), F.array(F.col("label").cast("double")).alias("y"))
    pairs = rows.select("id", ((F.col("id") * 7 + 3) % rows.count()).alias("other"))
    return c.mixup(rows, pairs).select("id", F.round(F.col("x")[0], 5).alias("x0"), F.round(F.col("x")[63], 5).alias("x63"), F.round(F.col("y")[0], 5).alias("y"))


def d20_mixup_permuted(spark: SparkSession, d: str) -> DataFrame:
    """At weights from Beta(1, 1), which SQL can say too."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), F.array(F.col("label").cast("double")).alias("y"))
    out = c.mixup_permuted(rows, 1.0, 7)
    return out.select("id", "other", F.round("weight", 6).alias("weight"), F.round(F.col("x")[0], 5).alias("x0"), F.round(F.col("y")[0], 5).alias("y"))


def d21_channel_normalize(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.expr("transform(sequence(0, 11), i -> cast((o_orderkey * 31 + i * 17) % 256 as int))").alias("p"))
    out = rows.select("o_orderkey", c.channel_normalize(F.col("p")).alias("v"))
    return out.select("o_orderkey", F.round(F.col("v")[1], 6).alias("r1"), F.round(F.col("v")[4], 6).alias("g0"), F.round(F.col("v")[11], 6).alias("b3"))


def d22_standardize(spark: SparkSession, d: str) -> DataFrame:
    return c.standardize(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal").select("c_custkey", F.round("c_acctbal", 5).alias("z"))


_PIX = "o_orderkey % 20 AS image_id, CAST(o_orderkey // 20 % 10 AS INT) AS y, CAST(o_custkey % 10 AS INT) AS x, CAST(o_custkey % 256 AS DOUBLE) AS v"


def d23_uneven_lighting(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").selectExpr(*_PIX.replace("//", "div").split(", "))
    return x.uneven_lighting(rows, 10, 10).select("image_id", F.round("spread", 5).alias("spread"), "uneven")


def d23_uneven_equal_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of two by two pixels; the last two rows and columns belong to none."""
    rows = table(spark, d, "orders").selectExpr(*_PIX.replace("//", "div").split(", "))
    return x.uneven_lighting(rows, 10, 10, equal=True).select("image_id", F.round("spread", 5).alias("spread"), "uneven")


def _contours(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr("l_orderkey AS image_id", "l_quantity * l_linenumber * 4 AS area", "l_quantity * 2e0 * (l_linenumber - 1) AS perimeter")


def d24_filter_defects(spark: SparkSession, d: str) -> DataFrame:
    rows = _contours(spark, d)
    parts = [x.filter_defects(rows, 100, 100, m).groupBy(F.lit(m).alias("mode")).agg(F.count("*").alias("n"), F.sum("area").alias("area")) for m in ("region", "edge")]
    return parts[0].unionByName(parts[1])


def d25_circularity(spark: SparkSession, d: str) -> DataFrame:
    return _contours(spark, d).groupBy("image_id").agg(F.round(F.sum(b.circularity(F.col("area"), F.col("perimeter"))), 5).alias("c"))


def d26_image_verdict(spark: SparkSession, d: str) -> DataFrame:
    images = table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"))
    return x.image_verdict(images, x.filter_defects(_contours(spark, d), 100, 100))


def d27_anchor_kmeans(spark: SparkSession, d: str) -> DataFrame:
    return x.anchor_kmeans(boxes(spark, d).selectExpr("x2 - x1 AS w", "y2 - y1 AS h")).select("anchor_no", F.round("w", 6).alias("w"), F.round("h", 6).alias("h"), "n")


def d28_label_counts(spark: SparkSession, d: str) -> DataFrame:
    return x.label_counts(boxes(spark, d).withColumn("split", F.when(F.col("image_id") % 5 == 0, "test").otherwise("train")))


def d29_defect_rate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("ts", (F.col("event_type") == "error").alias("fail"))
    return x.defect_rate(rows, alert=0.1).select("start", "n", F.round("rate", 6).alias("rate"), "alert")


_EDGES = [5.0, 10.0, 20.0, 40.0, 80.0]


def d29_confidence_drift(spark: SparkSession, d: str) -> DataFrame:
    """Each day's values against those of every fifth event, over given edges; some values are missing."""
    rows = table(spark, d, "events").selectExpr("event_id", "ts", "CASE WHEN event_id % 17 > 0 THEN value * (1 + event_id % 3) END AS v")
    return dr.value_drift(rows.where("event_id % 5 > 0"), rows.where("event_id % 5 = 0"), "v", "1 day", _EDGES).select("start", "n", F.round("psi", 6).alias("psi"), "drift")


def d29_relabel_queue(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").selectExpr("event_id", "(event_id * 37 % 1000) / 1000e0 AS confidence")
    return x.relabel_queue(rows)


def d30_latency_budget(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", x.latency_budget(F.col("p_size").cast("double"), F.lit(0.5), F.col("p_retailprice") / 100, F.lit(20.0)).alias("s")).select("p_partkey", F.round("s.budget", 6).alias("budget"), F.round("s.used", 6).alias("used"), "s.fits")


def d31_misclassified(spark: SparkSession, d: str) -> DataFrame:
    return c.misclassified(scored(spark, d)).select("id", "label", "predicted")


def d32_decode_anchor(spark: SparkSession, d: str) -> DataFrame:
    t = [F.expr(e) for e in ("l_discount * 4", "l_tax * 3 - 0.1e0", "l_discount - 0.05e0", "l_tax", "cast(l_partkey % 13 as double)", "cast(l_suppkey % 13 as double)", "40e0", "160e0", "32e0")]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", b.decode_anchor(*t).alias("s")).select("l_orderkey", "l_linenumber", *(F.round(f"s.{k}", 4).alias(k) for k in ("x1", "y1", "x2", "y2")))


def d33_centerness(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(b.centerness_score(F.col("l_quantity"), F.col("l_linenumber").cast("double"), F.expr("l_partkey % 50 + 1e0"), F.expr("l_suppkey % 50 + 1e0"), F.col("l_discount")), 6).alias("s"))


QUERIES = {q.__name__: q for q in (
    d1_d2_pairwise_iou, d3_nms, d4_corners, d5_match, d6_pr_curve, d7_average_precision, d8_mean_ap, d8_mean_ap_by_size, d8_size_bands, d9_roc_auc, d9_roc_curve, d9_ks_gini, d10_pr_auc, d11_threshold_sweep, d12_cost, d13_best_threshold, d14_confusion, d15_report, d16_overfit_gap, d17_mean_loss, d18_pixel_iou, d19_split,
    d20_mixup, d20_mixup_permuted, d21_channel_normalize, d22_standardize, d23_uneven_lighting, d23_uneven_equal_cells, d24_filter_defects, d25_circularity, d26_image_verdict, d27_anchor_kmeans, d28_label_counts, d29_defect_rate, d29_confidence_drift, d29_relabel_queue, d30_latency_budget, d31_misclassified, d32_decode_anchor, d33_centerness,
)}

_INTER = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
_AREA = "greatest(0, {0}.x2 - {0}.x1) * greatest(0, {0}.y2 - {0}.y1)"
_IOU = f"{_INTER} / ({_AREA.format('a')} + {_AREA.format('b')} - {_INTER})"
_CURVE = (
    f"{_BOXES}, p AS (SELECT pred.*, noise < 6 AS tp FROM pred JOIN boxes USING (box_id)), n AS (SELECT class_id, COUNT(*) AS n FROM truth GROUP BY 1), cum AS (SELECT box_id, p.class_id, image_id, score, SUM(CASE WHEN tp THEN 1 ELSE 0 END) OVER w AS t, COUNT(*) OVER w AS k, n FROM p JOIN n USING (class_id) WINDOW w AS (PARTITION BY p.class_id ORDER BY score DESC, image_id, box_id ROWS UNBOUNDED PRECEDING)), "
    "curve AS (SELECT *, t / k AS precision, t / n AS recall FROM cum)"
)
_SWEEP = f"{_SCORED}, th AS (SELECT UNNEST([" + ", ".join(f"{v}e0" for v in _CUTS) + "]) AS threshold), s AS (SELECT threshold, COUNT(*) FILTER (score >= threshold AND y = 1) AS tp, COUNT(*) FILTER (score >= threshold AND y = 0) AS fp, COUNT(*) FILTER (score < threshold AND y = 1) AS fn, COUNT(*) FILTER (score < threshold AND y = 0) AS tn FROM scored, th GROUP BY 1), r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0e0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0e0 END AS recall FROM s), f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0e0 END AS f1 FROM r)"
_COST = f"{_SWEEP}, c AS (SELECT threshold, f1, round_even(recall * 99, 0) AS tp, CASE WHEN precision > 0 THEN round_even(round_even(recall * 99, 0) / precision - round_even(recall * 99, 0), 0) ELSE 0e0 END AS fp FROM f), k AS (SELECT threshold, f1, CAST(tp AS BIGINT) AS tp, CAST(99 - tp AS BIGINT) AS fn, CAST(fp AS BIGINT) AS fp, (99 - tp) * 100 + fp * 10 AS cost FROM c)"
_SM = "list_sum(list_transform(x, lambda v: exp(v - list_max(x))))"

#: Boxes in the order of their scores; each is kept unless one that was kept before overlaps it by a half.
_KEPT = (
    f"{_BOXES}, ordered AS MATERIALIZED (SELECT image_id, box_id, {{{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}}} AS b, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, box_id, x1, y1, x2, y2) AS r FROM pred WHERE score >= 0.25), "
    "seen AS (SELECT image_id, box_id, r, TRUE AS keep, [b] AS kept FROM ordered WHERE r = 1 UNION ALL SELECT image_id, box_id, r, keep, CASE WHEN keep THEN list_append(kept, b) ELSE kept END FROM (SELECT o.image_id, o.box_id, o.r, o.b, s.kept, len(list_filter(s.kept, lambda a: {iou} >= 0.5)) = 0 AS keep FROM seen s JOIN ordered o ON o.image_id = s.image_id AND o.r = s.r + 1))"
).format(iou=_IOU.replace("b.", "o.b."))
#: Detections in the order of their scores; each takes the truth that it overlaps most of those that are free.
_TAKEN = (
    f"{_BOXES}, pairs AS (SELECT a.image_id, b.class_id, a.box_id, b.box_id AS b_id, MAX({_IOU}) AS iou FROM pred a JOIN truth b USING (image_id) WHERE {_INTER} > 0 AND {_IOU} > 0.5 - 1e-12 GROUP BY ALL), near AS (SELECT image_id, class_id, box_id, list(b_id ORDER BY iou DESC, b_id) AS near FROM pairs GROUP BY ALL), "
    "dets AS MATERIALIZED (SELECT image_id, class_id, COALESCE(near, []) AS near, row_number() OVER (PARTITION BY image_id, class_id ORDER BY score DESC, box_id) AS r FROM pred LEFT JOIN near USING (image_id, class_id, box_id)), "
    "taken AS (SELECT image_id, class_id, r, near[1] AS pick, near[1:1] AS got FROM dets WHERE r = 1 UNION ALL SELECT image_id, class_id, r, free[1], list_concat(got, free[1:1]) FROM (SELECT d.image_id, d.class_id, d.r, t.got, list_filter(d.near, lambda x: NOT list_contains(t.got, x)) AS free FROM taken t JOIN dets d ON d.image_id = t.image_id AND d.class_id = t.class_id AND d.r = t.r + 1))"
)
_SHARED = "least(b.w, c.w) * least(b.h, c.h)"


def _nearest(k: int) -> str:
    """Each shape with the centre after k rounds that it shares most with."""
    return f"SELECT b.w, b.h, b.n, c.i FROM shapes b, centres{k} c QUALIFY row_number() OVER (PARTITION BY b.w, b.h ORDER BY {_SHARED} / (b.w * b.h + c.w * c.h - {_SHARED}) DESC, c.i) = 1"


def _centres(rounds: int = 10, k: int = 5) -> str:
    """Shapes of boxes, and their centres after each round."""
    starts = " UNION ALL ".join(f"SELECT {i} AS i, quantile_cont(w, {(i + 0.5) / k}) AS w, quantile_cont(h, {(i + 0.5) / k}) AS h FROM sides" for i in range(k))
    steps = ["sides AS (SELECT CAST(x2 - x1 AS DOUBLE) AS w, CAST(y2 - y1 AS DOUBLE) AS h FROM boxes WHERE x2 > x1 AND y2 > y1)", "shapes AS MATERIALIZED (SELECT w, h, COUNT(*) AS n FROM sides GROUP BY 1, 2)", f"centres0 AS ({starts})"]
    for r in range(rounds):
        means = f"SELECT i, SUM(w * n) / SUM(n) AS w, SUM(h * n) / SUM(n) AS h FROM ({_nearest(r)}) GROUP BY 1"
        steps.append(f"centres{r + 1} AS MATERIALIZED (SELECT i, COALESCE(m.w, c.w) AS w, COALESCE(m.h, c.h) AS h FROM centres{r} c LEFT JOIN ({means}) m USING (i))")
    return ", ".join(steps)


ORACLES = {
    "d1_d2_pairwise_iou": f"WITH {_BOXES} SELECT a.box_id AS a_id, b.box_id AS b_id, ROUND({_IOU}, 10) AS iou FROM pred a JOIN truth b ON a.image_id = b.image_id WHERE {_INTER} > 0",
    "d3_nms": f"WITH RECURSIVE {_KEPT} SELECT image_id, box_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY r) - 1 AS INTEGER) AS keep_rank FROM seen WHERE keep",
    "d5_match": f"WITH RECURSIVE {_TAKEN} SELECT class_id, pick IS NOT NULL AS tp, COUNT(*) AS n FROM taken GROUP BY 1, 2",
    "d4_corners": f"WITH {_BOXES} SELECT box_id, ROUND((x1 / 100 - (x2 - x1) / 400) * 640, 6) AS x1, ROUND((y1 / 100 - (y2 - y1) / 400) * 480, 6) AS y1, ROUND((x1 / 100 + (x2 - x1) / 400) * 640, 6) AS x2, ROUND((y1 / 100 + (y2 - y1) / 400) * 480, 6) AS y2, ROUND(x1 + x2, 6) AS \"right\" FROM boxes",
    "d6_pr_curve": f"WITH {_CURVE} SELECT box_id, CAST(t AS BIGINT) AS cum_tp, CAST(k - t AS BIGINT) AS cum_fp, ROUND(precision, 10) AS precision, ROUND(recall, 10) AS recall FROM curve",
    "d7_average_precision": f"WITH {_CURVE}, e AS (SELECT class_id, MAX(precision) OVER (PARTITION BY class_id ORDER BY score DESC, image_id, box_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env, recall - COALESCE(lag(recall) OVER (PARTITION BY class_id ORDER BY score DESC, image_id, box_id), 0) AS step FROM curve) SELECT class_id, ROUND(SUM(env * step), 6) AS ap FROM e GROUP BY 1",
    "d8_size_bands": f"WITH {_BOXES} SELECT CASE WHEN (x2 - x1) * (y2 - y1) < 1024 THEN 'S' WHEN (x2 - x1) * (y2 - y1) < 9216 THEN 'M' ELSE 'L' END AS band, COUNT(*) AS n FROM boxes GROUP BY 1",
    "d9_roc_auc": f"WITH {_SCORED}, a AS (SELECT lang, ROUND(AVG(CASE WHEN p.score > n.score THEN 1e0 WHEN p.score = n.score THEN 0.5e0 ELSE 0e0 END), 6) AS auc FROM (SELECT * FROM scored WHERE y = 1) p JOIN (SELECT * FROM scored WHERE y = 0) n USING (lang) GROUP BY 1) SELECT lang, auc FROM (SELECT DISTINCT lang FROM scored) LEFT JOIN a USING (lang)",
    "d10_pr_auc": f"WITH {_SCORED}, g AS (SELECT score, SUM(y) AS p, COUNT(*) AS m FROM scored GROUP BY 1), w AS (SELECT p, SUM(p) OVER (ORDER BY score DESC) / SUM(m) OVER (ORDER BY score DESC) AS pr, m FROM g) SELECT ROUND(SUM(p * pr) / SUM(p), 6) AS ap, ROUND(SUM(p) / SUM(m), 6) AS baseline FROM w",
    "d11_threshold_sweep": f"WITH {_SWEEP} SELECT threshold, tp, fp, fn, tn, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(f1, 6) AS f1 FROM f",
    "d12_cost": f"WITH {_COST} SELECT threshold, tp, fn, fp, cost FROM k",
    "d13_best_threshold": f"WITH {_COST} SELECT 'f1' AS metric, (SELECT threshold FROM k ORDER BY f1 DESC, threshold LIMIT 1) AS threshold UNION ALL SELECT 'cost', (SELECT threshold FROM k ORDER BY cost, threshold LIMIT 1)",
    "d14_confusion": f"WITH {_SCORED} SELECT label, predicted, COUNT(*) AS n, (SELECT ROUND(AVG(CASE WHEN label = predicted THEN 1e0 ELSE 0e0 END), 6) FROM scored) AS accuracy FROM scored GROUP BY 1, 2",
    "d15_report": f"WITH {_SCORED}, k AS (SELECT UNNEST([0, 1]) AS k), e AS (SELECT k, COUNT(*) FILTER (label = k AND predicted = k) AS hit, COUNT(*) FILTER (predicted = k) AS called, COUNT(*) FILTER (label = k) AS support FROM scored, k GROUP BY 1), r AS (SELECT CAST(k AS VARCHAR) AS class, hit / called AS precision, hit / support AS recall, 2 * hit / (called + support) AS f1, support FROM e) SELECT class, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(f1, 6) AS f1, support FROM r UNION ALL SELECT 'macro avg', ROUND(AVG(precision), 6), ROUND(AVG(recall), 6), ROUND(AVG(f1), 6), CAST(SUM(support) AS BIGINT) FROM r UNION ALL SELECT 'weighted avg', ROUND(SUM(precision * support) / SUM(support), 6), ROUND(SUM(recall * support) / SUM(support), 6), ROUND(SUM(f1 * support) / SUM(support), 6), CAST(SUM(support) AS BIGINT) FROM r",
    "d16_overfit_gap": f"WITH {_SCORED}, g AS (SELECT lang, AVG(CASE WHEN label = predicted THEN 1e0 ELSE 0e0 END) FILTER (id % 5 < 4) - AVG(CASE WHEN label = predicted THEN 1e0 ELSE 0e0 END) FILTER (id % 5 = 4) AS gap FROM scored GROUP BY 1) SELECT lang, ROUND(gap, 6) AS gap, gap > 0 AS overfit FROM g",
    "d17_mean_loss": f"WITH r AS (SELECT l_returnflag, [l_quantity / 10, l_discount * 30, l_tax * 40] AS x, l_orderkey % 3 AS y FROM lineitem) SELECT l_returnflag, ROUND(AVG(list_max(x) + ln({_SM}) - x[y + 1]), 6) AS loss, ROUND(AVG(exp(x[1] - list_max(x)) / {_SM}), 6) AS p0 FROM r GROUP BY 1",
    "d18_pixel_iou": "WITH p AS (SELECT l_partkey % 4 AS t, CASE WHEN l_suppkey % 3 = 0 THEN (l_partkey + 1) % 4 ELSE l_partkey % 4 END AS q FROM lineitem), k AS (SELECT UNNEST([0, 1, 2, 3, 9]) AS class), s AS (SELECT class, COUNT(*) FILTER (t = class AND q = class) AS i, COUNT(*) FILTER (t = class) AS a, COUNT(*) FILTER (q = class) AS b FROM p, k GROUP BY 1) SELECT class, CASE WHEN a + b = i THEN 1e0 ELSE ROUND(i / (a + b - i), 6) END AS iou, ROUND((2 * i + 1e-6) / (a + b + 1e-6), 6) AS dice FROM s",
    "d19_split": "SELECT 'train' AS split, CAST(floor(COUNT(*) * 0.8e0) AS BIGINT) AS n, CAST(floor(COUNT(*) * 0.8e0) AS BIGINT) AS n_ids FROM documents UNION ALL SELECT 'validation', CAST(COUNT(*) - floor(COUNT(*) * 0.8e0) AS BIGINT), CAST(COUNT(*) - floor(COUNT(*) * 0.8e0) AS BIGINT) FROM documents",
    "d20_mixup": "SELECT a.vec_id AS id, ROUND(0.6e0 * a.embedding[1]::DOUBLE + 0.4e0 * b.embedding[1]::DOUBLE, 5) AS x0, ROUND(0.6e0 * a.embedding[64]::DOUBLE + 0.4e0 * b.embedding[64]::DOUBLE, 5) AS x63, ROUND(0.6e0 * a.label + 0.4e0 * b.label, 5) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id * 7 + 3) % (SELECT COUNT(*) FROM embeddings)",
    "d21_channel_normalize": "SELECT o_orderkey, ROUND(((o_orderkey * 31 + 51) % 256 / 255e0 - 0.485e0) / 0.229e0, 6) AS r1, ROUND(((o_orderkey * 31 + 17) % 256 / 255e0 - 0.456e0) / 0.224e0, 6) AS g0, ROUND(((o_orderkey * 31 + 187) % 256 / 255e0 - 0.406e0) / 0.225e0, 6) AS b3 FROM orders",
    "d22_standardize": "SELECT c_custkey, ROUND((c_acctbal - (SELECT AVG(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer), 5) AS z FROM customer",
    "d20_mixup_permuted": "WITH o AS (SELECT vec_id, row_number() OVER (ORDER BY md5('7:first:' || vec_id)) AS a, row_number() OVER (ORDER BY md5('7:second:' || vec_id)) AS b, CAST('0x' || substr(md5('7:weight:' || vec_id), 1, 8) AS BIGINT) / 4294967296e0 AS w FROM embeddings), "
    "p AS (SELECT o.vec_id AS id, q.vec_id AS other, o.w FROM o JOIN o q ON o.a = q.b) SELECT id, other, ROUND(w, 6) AS weight, ROUND(w * a.embedding[1]::DOUBLE + (1 - w) * b.embedding[1]::DOUBLE, 5) AS x0, ROUND(w * a.label + (1 - w) * b.label, 5) AS y FROM p JOIN embeddings a ON a.vec_id = id JOIN embeddings b ON b.vec_id = other",
    "d23_uneven_equal_cells": f"WITH p AS (SELECT {_PIX} FROM orders), m AS (SELECT image_id, y // 2 AS cy, x // 2 AS cx, AVG(v) AS m FROM p WHERE y < 8 AND x < 8 GROUP BY 1, 2, 3) SELECT image_id, ROUND(stddev_pop(m), 5) AS spread, stddev_pop(m) > 8 AS uneven FROM m GROUP BY 1",
    "d23_uneven_lighting": f"WITH p AS (SELECT {_PIX} FROM orders), m AS (SELECT image_id, y * 4 // 10 AS cy, x * 4 // 10 AS cx, AVG(v) AS m FROM p GROUP BY 1, 2, 3) SELECT image_id, ROUND(stddev_pop(m), 5) AS spread, stddev_pop(m) > 8 AS uneven FROM m GROUP BY 1",
    "d24_filter_defects": "WITH c AS (SELECT l_quantity * l_linenumber * 4 AS area FROM lineitem) SELECT 'region' AS mode, COUNT(*) AS n, SUM(area) AS area FROM c WHERE area > 300 AND area < 800 UNION ALL SELECT 'edge', COUNT(*), SUM(area) FROM c WHERE area > 50",
    "d25_circularity": f"SELECT l_orderkey AS image_id, ROUND(SUM(CASE WHEN l_linenumber > 1 THEN 4 * {math.pi!r}::DOUBLE * (l_quantity * l_linenumber * 4) / pow(l_quantity * 2e0 * (l_linenumber - 1), 2) END), 5) AS c FROM lineitem GROUP BY 1",
    "d26_image_verdict": "SELECT o_orderkey AS image_id, COUNT(l_orderkey) AS n_defects, COUNT(l_orderkey) > 0 AS is_defective FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity * l_linenumber * 4 > 300 AND l_quantity * l_linenumber * 4 < 800 GROUP BY 1",
    "d27_anchor_kmeans": f"WITH {_BOXES}, {_centres()} SELECT i AS anchor_no, ROUND(c.w, 6) AS w, ROUND(c.h, 6) AS h, SUM(a.n)::BIGINT AS n FROM ({_nearest(10)}) a JOIN centres10 c USING (i) GROUP BY 1, 2, 3",
    "d28_label_counts": f"WITH {_BOXES} SELECT CASE WHEN image_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, class_id, COUNT(*) AS n_boxes, COUNT(DISTINCT image_id) AS n_images FROM boxes GROUP BY 1, 2",
    "d9_roc_curve": f"WITH {_SCORED}, c AS (SELECT lang, score, SUM(y) AS p, SUM(1 - y) AS n FROM scored GROUP BY 1, 2) SELECT lang, ROUND(score, 6) AS threshold, ROUND(SUM(p) OVER w / SUM(p) OVER (PARTITION BY lang), 6) AS tpr, ROUND(SUM(n) OVER w / SUM(n) OVER (PARTITION BY lang), 6) AS fpr FROM c WINDOW w AS (PARTITION BY lang ORDER BY score DESC)",
    "d9_ks_gini": f"WITH {_SCORED}, c AS (SELECT lang, score, SUM(y) AS p, SUM(1 - y) AS n FROM scored GROUP BY 1, 2), r AS (SELECT lang, p, n, SUM(p) OVER w AS up, SUM(n) OVER w AS un, SUM(p) OVER (PARTITION BY lang) AS tp, SUM(n) OVER (PARTITION BY lang) AS tn FROM c WINDOW w AS (PARTITION BY lang ORDER BY score)) "
    "SELECT lang, ROUND(MAX(abs(up / NULLIF(tp, 0) - un / NULLIF(tn, 0))), 6) AS ks, ROUND(2 * SUM(p * (un - n / 2)) / NULLIF(MAX(tp) * MAX(tn), 0) - 1, 6) AS gini FROM r GROUP BY 1",
    "d29_confidence_drift": "WITH v AS (SELECT event_id, date_trunc('day', ts) AS start, CASE WHEN event_id % 17 > 0 THEN value * (1 + event_id % 3) END AS v FROM events), b AS (SELECT event_id % 5 = 0 AS known, start, CASE WHEN v IS NULL THEN 6 ELSE (v >= 5)::INT + (v >= 10)::INT + (v >= 20)::INT + (v >= 40)::INT + (v >= 80)::INT END AS bin FROM v), "
    "e AS (SELECT k.bin, (COUNT(b.bin) + 0.5e0) / ((SELECT COUNT(*) FROM b WHERE known) + 3.5e0) AS p FROM range(7) k(bin) LEFT JOIN b ON b.bin = k.bin AND known GROUP BY 1), d AS (SELECT start, COUNT(*) AS n FROM b WHERE NOT known GROUP BY 1), "
    "a AS (SELECT d.start, d.n, e.bin, e.p, (COUNT(b.bin) + 0.5e0) / (d.n + 3.5e0) AS q FROM d CROSS JOIN e LEFT JOIN b ON NOT b.known AND b.start = d.start AND b.bin = e.bin GROUP BY 1, 2, 3, 4), s AS (SELECT start, n, SUM((q - p) * ln(q / p)) AS psi FROM a GROUP BY 1, 2) "
    "SELECT start, n, ROUND(psi, 6) AS psi, CASE WHEN psi >= 0.25 THEN 'major' WHEN psi >= 0.1 THEN 'moderate' ELSE 'none' END AS drift FROM s",
    "d29_relabel_queue": "SELECT event_id, (event_id * 37 % 1000) / 1000e0 AS confidence FROM events WHERE (event_id * 37 % 1000) BETWEEN 400 AND 600",
    "d29_defect_rate": "SELECT date_trunc('hour', ts) AS start, COUNT(*) AS n, ROUND(AVG(CASE WHEN event_type = 'error' THEN 1e0 ELSE 0e0 END), 6) AS rate, AVG(CASE WHEN event_type = 'error' THEN 1e0 ELSE 0e0 END) > 0.1 AS alert FROM events GROUP BY 1",
    "d30_latency_budget": "SELECT p_partkey, ROUND(p_size / 0.5e0, 6) AS budget, ROUND(p_retailprice / 100 + 20, 6) AS used, p_retailprice / 100 + 20 <= p_size / 0.5e0 AS fits FROM part",
    "d31_misclassified": f"WITH {_SCORED} SELECT id, label, predicted FROM scored WHERE label <> predicted ORDER BY id LIMIT 12",
    "d32_decode_anchor": "WITH p AS (SELECT *, (1 / (1 + exp(-(l_discount * 4))) + l_partkey % 13) * 32 AS x, (1 / (1 + exp(-(l_tax * 3 - 0.1e0))) + l_suppkey % 13) * 32 AS y, 40 * exp(l_discount - 0.05e0) AS w, 160 * exp(l_tax) AS h FROM lineitem) SELECT l_orderkey, l_linenumber, ROUND(x - w / 2, 4) AS x1, ROUND(y - h / 2, 4) AS y1, ROUND(x + w / 2, 4) AS x2, ROUND(y + h / 2, 4) AS y2 FROM p",
    "d33_centerness": "WITH p AS (SELECT *, l_quantity AS l, CAST(l_linenumber AS DOUBLE) AS t, l_partkey % 50 + 1e0 AS r, l_suppkey % 50 + 1e0 AS b FROM lineitem) SELECT l_orderkey, l_linenumber, ROUND(sqrt(least(l, r) / greatest(l, r) * (least(t, b) / greatest(t, b))) * l_discount, 6) AS s FROM p",
}
