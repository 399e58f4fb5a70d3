"""Small knowledge graphs: vertices (id, type) and edges (src, rel, dst, weight)."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cut import cut, spread


def build_graph(triples: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """src, rel, dst, weight: triples with their entities' aliases (alias, name) merged, weights summed."""
    if aliases is not None:
        for side in ("src", "dst"):
            triples = triples.join(aliases.select(F.col("alias").alias(side), F.col("name").alias(f"_{side}")), side, "left").withColumn(side, F.coalesce(f"_{side}", side)).drop(f"_{side}")
    return triples.groupBy("src", "rel", "dst").agg(F.sum("weight").alias("weight"))


def check_schema(edges: DataFrame, vertices: DataFrame, allowed: DataFrame) -> DataFrame:
    """The edges whose (type, relation, type) isn't allowed; a vertex without a type never is."""
    typed = edges.join(vertices.select(F.col("id").alias("src"), F.col("type").alias("src_type")), "src", "left").join(vertices.select(F.col("id").alias("dst"), F.col("type").alias("dst_type")), "dst", "left")
    return typed.join(allowed, ["src_type", "rel", "dst_type"], "left_anti")


def k_hop(edges: DataFrame, seeds: DataFrame, k: int = 2) -> DataFrame:
    """id, hop: vertices within k steps of the seeds (id) along edges in either direction, with the fewest steps."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = seeds.select("id").distinct().withColumn("hop", F.lit(0))
    front = seen
    for n in range(1, k + 1):
        front = front.select(F.col("id").alias("src")).join(both, "src").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hop", F.lit(n))
        seen = seen.unionByName(front)
    return seen


def match_count(edges: DataFrame, vertices: DataFrame, rel: str, where: str) -> DataFrame:
    """dst, n: sources that the relation links to each target that meets the predicate."""
    return edges.where(F.col("rel") == rel).join(vertices.where(where).select(F.col("id").alias("dst")), "dst").groupBy("dst").agg(F.count("*").alias("n"))


def communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """id, community by label propagation: each round a vertex takes the label that its neighbours' weights and, with half of their sum, its own favour, the smallest among equals."""
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.sum("weight").cast("double").alias("weight"))
    both = both.unionByName(both.groupBy("src").agg((F.sum("weight") / 2).alias("weight")).select("src", F.col("src").alias("dst"), "weight"))
    labels = both.select(F.col("src").alias("id"), F.col("src").alias("community")).distinct()
    for _ in range(rounds):
        votes = both.join(spread(labels.select(F.col("id").alias("dst"), "community")), "dst").groupBy("src", "community").agg(F.sum("weight").alias("v"))
        best = F.row_number().over(W.partitionBy("src").orderBy(F.desc("v"), "community"))
        labels = cut(votes.withColumn("k", best).where("k = 1").select(F.col("src").alias("id"), "community"))
    return labels


def community_levels(edges: DataFrame, levels: int = 3, rounds: int = 5) -> DataFrame:
    """id, level, community, parent: communities of the vertices at level 0, then of the communities as vertices, with the weights between them summed; a level ends where nothing joins."""
    labels = cut(communities(edges, rounds), "level")
    out = labels.select("id", F.lit(0).alias("level"), "community")
    for level in range(1, levels):
        ends = edges.join(spread(labels.select(F.col("id").alias("src"), F.col("community").alias("_a"))), "src").join(spread(labels.select(F.col("id").alias("dst"), F.col("community").alias("_b"))), "dst")
        between = cut(ends.where("_a != _b").groupBy("_a", "_b").agg(F.sum("weight").alias("weight")).select(F.col("_a").alias("src"), F.col("_b").alias("dst"), "weight"), "between")
        if between.isEmpty():
            break
        above = communities(between, rounds).select(F.col("id").alias("community"), F.col("community").alias("_up"))
        labels = cut(labels.join(spread(above), "community", "left").select("id", F.coalesce("_up", "community").alias("community")), "level")
        out = out.unionByName(labels.select("id", F.lit(level).alias("level"), "community"))
    up = out.select("id", (F.col("level") - 1).alias("level"), F.col("community").alias("parent"))
    return out.join(up, ["id", "level"], "left").select("id", "level", "community", "parent")


def community_report(labels: DataFrame, edges: DataFrame, top: int = 3) -> DataFrame:
    """community, nodes, inner edges, and its members of highest degree."""
    ends = edges.join(spread(labels.select(F.col("id").alias("src"), F.col("community").alias("a"))), "src").join(spread(labels.select(F.col("id").alias("dst"), F.col("community").alias("b"))), "dst")
    inner = ends.where("a = b").groupBy(F.col("a").alias("community")).agg(F.count("*").alias("n_edges"))
    degree = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    # the limit stands apart from the count, so that tasks pass on the first few of a community only
    ranked = labels.join(degree, "id", "left").withColumn("k", F.row_number().over(W.partitionBy("community").orderBy(F.desc_nulls_last("degree"), "id"))).where(F.col("k") <= top)
    first = ranked.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"].cast("string")), ",").alias("top"))
    nodes = labels.groupBy("community").agg(F.count("*").alias("n_nodes")).join(first, "community")
    return nodes.join(inner, "community", "left").select("community", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), "top")


def global_answer(ratings: DataFrame, least: float = 1.0, k: int = 5) -> DataFrame:
    """Of each question's rated partial answers (question_id, part_id, rating 0 to 100) the best k from `least` on."""
    w = W.partitionBy("question_id").orderBy(F.desc("rating"), "part_id")
    return ratings.where(F.col("rating") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fact_check(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """Claims (src, rel, dst) without an edge."""
    return claims.join(edges.select("src", "rel", "dst"), ["src", "rel", "dst"], "left_anti")
