"""Communities by modularity: at least as good as label propagation, and each hangs together."""

import random

import pytest

from rillworks.operators import graph, leiden

EDGE = "src long, dst long, weight double"


def ring(n, k):
    """Cliques of k in a ring, each linked with the next."""
    return [(c * k + i, c * k + j, 1.0) for c in range(n) for i in range(k) for j in range(i)] + [(c * k, (c + 1) % n * k + 1, 1.0) for c in range(n)]


def planted(n, groups, inside, outside, seed):
    rng = random.Random(seed)
    return [(i, j, rng.choice([1.0, 2.0])) for i in range(n) for j in range(i) if rng.random() < (inside if i % groups == j % groups else outside)]


def quality(edges, label):
    total = 2 * sum(w for *_, w in edges)
    k, inner = {}, 0.0
    for a, b, w in edges:
        k[a], k[b] = k.get(a, 0) + w, k.get(b, 0) + w
        inner += 2 * w * (label[a] == label[b])
    sums = {}
    for v, x in k.items():
        sums[label[v]] = sums.get(label[v], 0) + x
    return inner / total - sum(x * x for x in sums.values()) / total**2


def pieces(edges, label):
    """The parts that the edges within communities connect."""
    root = {v: v for v in label}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b, _ in edges:
        if label[a] == label[b]:
            root[find(a)] = find(b)
    return len({find(v) for v in root})


@pytest.mark.parametrize("edges,least", [(ring(6, 5), 0.72), (planted(80, 4, 0.35, 0.03, 1), 0.42)])
def test_against_label_propagation(spark, edges, least):
    df = spark.createDataFrame(edges, EDGE).repartition(3)
    label = {r.id: r.community for r in leiden.leiden(df, passes=2, rounds=6).collect()}
    assert label.keys() == {v for e in edges for v in e[:2]}
    assert pieces(edges, label) == len(set(label.values()))
    spread = {r.id: r.community for r in graph.communities(df).collect()}
    assert quality(edges, label) >= max(least, quality(edges, spread))
    for found in (label, spread):
        rows = spark.createDataFrame(list(found.items()), "id long, community long")
        assert leiden.modularity(df, rows).first()[0] == pytest.approx(quality(edges, found))


def test_loops_repeated_edges_and_none(spark):
    """Loops count at both ends, repeated edges add up, weights of 0 don't count; a graph without edges has no vertices."""
    rows = [(1, 2, 1.0), (2, 1, 1.0), (3, 3, 4.0), (3, 4, 0.5), (4, 5, 3.0), (6, 7, 0.0)]
    df = spark.createDataFrame(rows, EDGE)
    got = {r.id: r.community for r in leiden.leiden(df, passes=2, rounds=4).collect()}
    assert got.keys() == {1, 2, 3, 4, 5} and got[1] == got[2] == 1 and got[4] == got[5] and got[1] != got[4]
    assert leiden.leiden(df.where("false")).collect() == []


def test_components_of_a_chain(spark):
    both = [(i, i + 1) for i in range(40)] + [(100, 101)]
    links = spark.createDataFrame([*both, *((b, a) for a, b in both)], "a long, b long")
    nodes = spark.createDataFrame([(v,) for v in {x for e in both for x in e} | {500}], "id long")
    assert {r.id: r.root for r in leiden.connected(links, nodes).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 500: 500}
