"""Mean average precision over all images, at all ten thresholds, against a plain version."""

import random

import pytest
from pyspark.sql import functions as F

from rillworks.operators import detect as operators
from rillworks.plans import detect


def iou(a, b):
    both = max(0, min(a.x2, b.x2) - max(a.x1, b.x1)) * max(0, min(a.y2, b.y2) - max(a.y1, b.y1))
    area = lambda r: max(0, r.x2 - r.x1) * max(0, r.y2 - r.y1)
    return both / (area(a) + area(b) - both) if both else 0


def plain(predicted, truth, least):
    found = []
    for k in {t.class_id for t in truth}:
        own, taken, curve, hits = [t for t in truth if t.class_id == k], set(), [], 0
        for n, p in enumerate(sorted((p for p in predicted if p.class_id == k), key=lambda p: (-p.score, p.image_id, p.box_id)), 1):
            near = sorted((-iou(p, t), t.box_id) for t in own if t.image_id == p.image_id and t.box_id not in taken)
            if near and -near[0][0] >= least - 1e-12:
                taken.add(near[0][1])
                hits += 1
            curve.append((hits / n, hits / len(own)))
        found.append(sum(max(q for q, _ in curve[i:]) * (r - (curve[i - 1][1] if i else 0)) for i, (_, r) in enumerate(curve)))
    return sum(found) / len(found)


def test_all_images_and_thresholds(spark, tmp_path):
    rng = random.Random(4)
    rows = [(o, n, rng.randrange(200), rng.randrange(200), float(rng.randrange(1, 50))) for o in range(1, 45) for n in range(1, 6)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    predicted, truth = (f(spark, str(tmp_path)).withColumn("score", F.col("score").cast("double")).collect() for f in (detect.predicted, detect.truth))
    out = {round(r.threshold, 2): r.map for r in detect.d8_mean_ap(spark, str(tmp_path)).collect()}
    assert sorted(out) == [x / 100 for x in range(50, 100, 5)]
    assert out == pytest.approx({t: plain(predicted, truth, t) for t in out}, abs=2e-6) and out[0.5] > 0


def test_curve_over_ranges(spark, monkeypatch):
    """One class with most rows and tied scores, dealt over many ranges and blocks."""
    rng = random.Random(8)
    rows = [(i // 7, i, int(i % 11 == 0), rng.choice([0.5, 0.5, rng.random()]), rng.random() < 0.4) for i in range(3000)] + [(0, 9000, 1, None, True)]
    counts = spark.createDataFrame([(0, 2000), (1, 300)], "class_id int, n_truth long")
    matched = spark.createDataFrame(rows, "image_id long, box_id long, class_id int, score double, tp boolean")
    monkeypatch.setattr(operators, "PLACES", 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        curve = operators.pr_curve(matched, counts)
        got = {r.box_id: (r.cum_tp, r.cum_fp) for r in curve.collect()}
        ap = {r.class_id: r.ap for r in operators.average_precision(curve).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert curve.columns == matched.columns[2:3] + [c for c in matched.columns if c != "class_id"] + ["n_truth", "cum_tp", "cum_fp", "precision", "recall"]
    want, areas = {}, {}
    for k, n in ((0, 2000), (1, 300)):
        hits, points = 0, []
        for at, r in enumerate(sorted((r for r in rows if r[2] == k), key=lambda r: (r[3] is None, -(r[3] or 0), r[0], r[1])), 1):
            hits += r[4]
            want[r[1]] = (hits, at - hits)
            points.append((hits / at, hits / n))
        top, areas[k] = 0, 0
        for i in range(len(points) - 1, -1, -1):
            top = max(top, points[i][0])
            areas[k] += top * (points[i][1] - (points[i - 1][1] if i else 0))
    assert got == want
    assert ap == pytest.approx(areas)


def test_blocks_and_contested_truths(spark, tmp_path, monkeypatch):
    """Equal ids and truths that many detections want, over many small ranges and blocks; each detection and truth is one row to the end, however many bands and thresholds there are."""
    rng = random.Random(6)
    box = lambda: (x := rng.randrange(30), y := rng.randrange(30), x + rng.randrange(0, 40), y + rng.randrange(0, 40))
    rows = lambda n: [(rng.randrange(12), rng.randrange(2), i, *map(float, box()), rng.random()) for i in range(n)]
    schema = "image_id long, class_id int, box_id long, x1 double, y1 double, x2 double, y2 double, score double"
    predicted, truth = spark.createDataFrame(rows(400), schema), spark.createDataFrame(rows(200), schema)
    explained = []
    monkeypatch.setattr(operators, "cut", lambda rows, name: explained.append(rows.schema.simpleString()) or rows.localCheckpoint())
    monkeypatch.setattr(operators, "PAIRS", 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")
    try:
        got = {round(r.threshold, 2): r.map for r in operators.mean_ap(predicted, truth, (0.3, 0.5, 0.7)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == pytest.approx({t: plain(predicted.collect(), truth.collect(), t) for t in got}, abs=2e-6) and len(got) == 3
    assert explained and not any("near" in x or "tp0" in x for x in explained)
    assert "outcomes:array<tinyint>" in explained[0]
