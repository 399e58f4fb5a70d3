"""Communities by modularity: moves of vertices, refinement into parts that hang together, and the same again on the parts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cut import cut, spread


def links_of(edges: DataFrame) -> DataFrame:
    """a, b, w: each pair of vertices in both directions, weights of all edges (src, dst, weight) between them summed; loops once."""
    pairs = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("weight").cast("double").alias("w")).where("w > 0")
    return pairs.unionByName(pairs.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def strengths(links: DataFrame) -> DataFrame:
    """id, k: the weights at each vertex; a loop has two ends."""
    return links.groupBy(F.col("a").alias("id")).agg(F.sum(F.when(F.col("a") == F.col("b"), 2 * F.col("w")).otherwise(F.col("w"))).alias("k"))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: the share of the weight inside communities of labels (id, community), less the share that vertices of these strengths would have by chance."""
    links = links_of(edges)
    ends = links.join(spread(labels.select(F.col("id").alias("a"), F.col("community").alias("_a"))), "a").join(spread(labels.select(F.col("id").alias("b"), F.col("community").alias("_b"))), "b")
    inner = ends.where("_a = _b").agg(F.sum(F.when(F.col("a") == F.col("b"), 2 * F.col("w")).otherwise(F.col("w"))).alias("inside"))
    own = strengths(links).join(spread(labels), "id").groupBy("community").agg(F.sum("k").alias("k"))
    sums = own.agg(F.sum("k").alias("all"), F.sum(F.col("k") * F.col("k")).alias("squares"))
    return inner.crossJoin(sums).select((F.coalesce("inside", F.lit(0.0)) / F.col("all") - resolution * F.col("squares") / (F.col("all") * F.col("all"))).alias("modularity"))  # of one row each


def _active(id: str, turn: int, seed: int) -> Column:
    """About half of the vertices, others each turn, so that neighbours seldom move at once."""
    return F.pmod(F.xxhash64(id, F.lit(turn), F.lit(seed)), F.lit(2)) == 0


def _moved(links: DataFrame, nodes: DataFrame, total: float, rounds: int, resolution: float, seed: int) -> DataFrame:
    """nodes (id, k, c) after rounds in which the active vertices go to the neighbouring community with the largest gain, the smallest label among equals. The best of all rounds' partitions counts, as moves at once can spoil one another."""
    between = cut(links.where("a <> b"), "links")
    best, best_q, still = nodes, None, 0
    for turn in range(rounds + 1):
        own = nodes.groupBy("c").agg(F.sum("k").alias("tot"))
        near = between.join(spread(nodes.select(F.col("id").alias("b"), F.col("c").alias("to"))), "b").groupBy("a", "to").agg(F.sum("w").alias("w"))
        near = cut(near.join(spread(nodes.select(F.col("id").alias("a"), "k", "c")), "a"), "near")
        q = (near.where("to = c").agg(F.sum("w")).first()[0] or 0.0) / total - resolution * (own.agg(F.sum(F.col("tot") * F.col("tot"))).first()[0] or 0.0) / total**2
        if best_q is None or q > best_q + 1e-12:
            best, best_q = nodes, q
        if turn == rounds or still == 2:
            break
        options = near.join(spread(own.withColumnRenamed("c", "to")), "to")
        gain = F.col("w") - resolution * F.col("k") * (F.col("tot") - F.when(F.col("to") == F.col("c"), F.col("k")).otherwise(0.0)) / total
        choice = options.groupBy("a", "k", "c").agg(F.min(F.struct((-F.round(gain, 9)).alias("down"), F.col("to"))).alias("x"), F.max(F.when(F.col("to") == F.col("c"), gain)).alias("stay")).join(spread(own), "c")
        stay = F.coalesce("stay", -resolution * F.col("k") * (F.col("tot") - F.col("k")) / total)
        moves = cut(choice.where((-F.col("x.down") > stay + 1e-9) & (F.col("x.to") != F.col("c")) & _active("a", turn, seed)).select(F.col("a").alias("id"), F.col("x.to").alias("to")), "moves")
        still = still + 1 if moves.isEmpty() else 0
        if not still:
            nodes = cut(nodes.join(spread(moves), "id", "left").select("id", "k", F.coalesce("to", "c").alias("c")), "nodes")
    return best


def _refined(links: DataFrame, nodes: DataFrame, total: float, rounds: int, resolution: float, seed: int) -> DataFrame:
    """id, k, c, part: each community in parts that hang together. All vertices begin alone; one that still is may join a part of its community that it is linked with, if that gains and no one of that part is about to move."""
    ends = links.where("a <> b").join(spread(nodes.select(F.col("id").alias("a"), F.col("c").alias("_a"))), "a").join(spread(nodes.select(F.col("id").alias("b"), F.col("c").alias("_b"))), "b")
    inner = cut(ends.where("_a = _b").select("a", "b", "w"), "inner")
    parts = nodes.withColumn("part", F.col("id"))
    for turn in range(rounds):
        own = parts.groupBy("part").agg(F.sum("k").alias("tot"), F.count("*").alias("n"))
        marked = parts.join(spread(own), "part").withColumn("free", (F.col("n") == 1) & _active("id", turn, seed + 1))
        options = inner.join(spread(marked.where("free").select(F.col("id").alias("a"), "k")), "a").join(spread(marked.where("NOT free").select(F.col("id").alias("b"), F.col("part").alias("to"), "tot")), "b")
        gain = F.col("w") - resolution * F.col("k") * F.col("tot") / total
        chosen = options.groupBy("a", "k", "to", "tot").agg(F.sum("w").alias("w")).where(gain > 1e-9).groupBy("a").agg(F.min(F.struct((-F.round(gain, 9)).alias("down"), "to")).alias("x"))
        moves = cut(chosen.select(F.col("a").alias("id"), F.col("x.to").alias("to")), "moves")
        if turn and moves.isEmpty():
            break
        parts = cut(parts.join(spread(moves), "id", "left").select("id", "k", "c", F.coalesce("to", "part").alias("part")), "parts")
    return parts


def connected(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, root: the smallest vertex that each of nodes (id) is linked with, itself included. Labels spread to neighbours and then to what their labels point to, so rounds grow with the logarithm of a chain."""
    labels = cut(nodes.select("id", F.col("id").alias("root")).distinct(), "roots")
    while True:
        low = links.join(spread(labels.select(F.col("id").alias("b"), "root")), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("low"))
        near = cut(labels.join(spread(low), "id", "left").select("id", F.least("root", F.coalesce("low", "root")).alias("root")), "roots")
        jumped = near.join(spread(near.select(F.col("id").alias("root"), F.col("root").alias("up"))), "root").select("id", F.least("root", "up").alias("root"))
        after = cut(jumped, "roots")
        if after.join(spread(labels.withColumnRenamed("root", "old")), "id").where("root <> old").isEmpty():
            return after
        labels = after


def leiden(edges: DataFrame, passes: int = 4, rounds: int = 8, resolution: float = 1.0, seed: int = 0) -> DataFrame:
    """id, community (its smallest vertex) for each vertex of edges (src, dst, weight), as undirected ones; weights of 0 or less don't count.

    Each pass moves vertices by their gain of modularity, refines communities into connected parts, and goes on with the parts as vertices, which
    begin in their communities; passes end when nothing joins. At last a community that fell apart is split, which never lowers modularity,
    so each hangs together. All steps are joins and partial aggregates, written out; the driver gets sums.
    """
    links = cut(links_of(edges), "links")
    nodes = cut(strengths(links).withColumn("c", F.col("id")), "nodes")
    total, first, labels = nodes.agg(F.sum("k")).first()[0] or 0.0, links, nodes.select("id", F.col("id").alias("node"))
    for turn in range(passes if total else 0):
        nodes = _moved(links, nodes, total, rounds, resolution, seed + 100 * turn)
        parts = _refined(links, nodes, total, rounds, resolution, seed + 100 * turn)
        n, left = parts.agg(F.count("*"), F.countDistinct("part")).first()
        if n == left:
            break
        part = parts.select(F.col("id").alias("node"), "part")
        labels = cut(labels.join(spread(part), "node").select("id", F.col("part").alias("node")), "labels")
        links = cut(links.join(spread(part.select(F.col("node").alias("a"), F.col("part").alias("_a"))), "a").join(spread(part.select(F.col("node").alias("b"), F.col("part").alias("_b"))), "b").groupBy(F.col("_a").alias("a"), F.col("_b").alias("b")).agg(F.sum("w").alias("w")), "links")
        nodes = cut(parts.groupBy(F.col("part").alias("id")).agg(F.sum("k").alias("k"), F.min("c").alias("c")), "nodes")
    else:
        nodes = _moved(links, nodes, total, rounds, resolution, seed) if total else nodes
    found = cut(labels.join(spread(nodes.select(F.col("id").alias("node"), "c")), "node").select("id", "c"), "found")
    ends = first.where("a <> b").join(spread(found.select(F.col("id").alias("a"), F.col("c").alias("_a"))), "a").join(spread(found.select(F.col("id").alias("b"), F.col("c").alias("_b"))), "b")
    return connected(cut(ends.where("_a = _b").select("a", "b"), "inner"), found).select("id", F.col("root").alias("community"))
