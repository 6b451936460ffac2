"""Communities against the greedy merging of pairs that they replace, and modularity against its definition."""

import random
from collections import defaultdict

import pytest

from tessera.operators import communities as c
from tessera.operators import graph

SCHEMA = "head string, tail string"


def greedy(edges):
    """The pair of communities whose merger raises modularity most is merged, until none raises it."""
    pairs = {(min(e), max(e)) for e in edges if e[0] != e[1]}
    m, degree, near = len(pairs), defaultdict(int), defaultdict(lambda: defaultdict(int))
    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
        near[a][b] += 1
        near[b][a] += 1
    members = {v: [v] for v in degree}
    while True:
        best = min(((-(2 * m * w - degree[a] * degree[b]), a, b) for a in sorted(members) for b, w in near[a].items() if a < b), default=None)
        if best is None or best[0] >= 0:
            return list(members.values())
        _, a, b = best
        members[a] += members.pop(b)
        degree[a] += degree.pop(b)
        for x, w in near.pop(b).items():
            near[x].pop(b, None)
            if x != a:
                near[a][x] += w
                near[x][a] += w


def quality(edges, groups):
    of = {v: i for i, g in enumerate(groups) for v in g}
    pairs = {(min(e), max(e)) for e in edges if e[0] != e[1]}
    degree = defaultdict(int)
    for a, b in pairs:
        degree[of[a]] += 1
        degree[of[b]] += 1
    return sum(of[a] == of[b] for a, b in pairs) / len(pairs) - sum(d * d for d in degree.values()) / (2 * len(pairs)) ** 2


def planted(groups, size, inside, between, seed):
    rng = random.Random(seed)
    name = lambda i: f"v{i:03d}"
    n = groups * size
    edges = [(name(i), name(j)) for i in range(n) for j in range(i) if rng.random() < (inside if i // size == j // size else between)]
    return [e if rng.random() < 0.5 else e[::-1] for e in edges] + edges[:5] + [(name(0), name(0))]


@pytest.mark.parametrize("shape", [(6, 12, 0.6, 0.02, 1), (4, 15, 0.5, 0.1, 2)])
def test_modularity_is_not_below_the_greedy_one(spark, shape):
    edges = planted(*shape)
    df = spark.createDataFrame(edges, SCHEMA)
    found = c.communities(df, 1)
    groups = defaultdict(list)
    for r in found.collect():
        groups[r.community].append(r.name)
    assert sorted(v for g in groups.values() for v in g) == sorted({v for e in edges for v in e if e[0] != e[1]})
    assert all(k == min(g) for k, g in groups.items())
    got = quality(edges, list(groups.values()))
    assert got >= quality(edges, greedy(edges))
    row = c.modularity(df, found).first()
    assert abs(row.modularity - got) < 1e-12 and row.n_communities == len(groups)


def test_clear_communities_are_found(spark):
    ring = lambda p, n: [(f"{p}{i}", f"{p}{j}") for i in range(n) for j in range(i)]
    edges = ring("a", 6) + ring("b", 7) + [("a0", "b0"), ("x", "y"), ("y", None), ("z", "z")]
    df = spark.createDataFrame(edges, SCHEMA)
    found = defaultdict(set)
    for r in c.communities(df).collect():
        found[r.community].add(r.name)
    assert found == {"a0": {f"a{i}" for i in range(6)}, "b0": {f"b{i}" for i in range(7)}, "x": {"x", "y"}}
    facts = graph.community_facts(df.selectExpr("head", "'r' AS relation", "tail"), c.communities(df))
    assert facts.count() == 15 + 21 + 1
    assert c.communities(spark.createDataFrame([], SCHEMA)).count() == 0
    assert c.modularity(spark.createDataFrame([], SCHEMA), c.communities(df)).first().modularity is None


def test_names_outside_the_partition_stand_alone(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c")], SCHEMA)
    row = c.modularity(df, spark.createDataFrame([("k", "a"), ("k", "b")], "community string, name string")).first()
    assert (row.n_edges, row.n_inside, row.n_communities) == (2, 1, 2) and abs(row.modularity - (0.5 - (9 + 1) / 16)) < 1e-12
