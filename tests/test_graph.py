"""Graph jobs against plain-Python references on small random graphs."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from crateflow.operators import graph as G


def _graph(spark, edges, hubs, n, seeds):
    v = spark.createDataFrame([(i, 1 if i in seeds else 0) for i in range(n)], "id long, in_collection int")
    e = spark.createDataFrame(edges or [(0, 0)], "id_artist_from long, id_artist_to long")
    und = G.undirected(e)
    h = spark.createDataFrame(hubs or [(-1, -1)], "hub long, id long").filter("hub >= 0")
    return G.Graph(v, und, h)


def _adj(n, edges, hubs):
    adj = {i: set() for i in range(n)}
    for a, b in edges:
        if a != b:
            adj[a].add(b)
            adj[b].add(a)
    groups = {}
    for h, i in hubs:
        groups.setdefault(h, set()).add(i)
    for mem in groups.values():
        if len(mem) >= 2:
            for a in mem:
                adj[a] |= mem - {a}
    return adj


def _bfs(adj, s):
    d = {s: 0}
    q = deque([s])
    while q:
        u = q.popleft()
        for w in adj[u]:
            if w not in d:
                d[w] = d[u] + 1
                q.append(w)
    return d


def _random(seed, n=14):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(n // 2)]
    hubs = [(h, rng.randrange(n)) for h in range(4) for _ in range(rng.randint(2, 4))]
    seeds = set(rng.sample(range(n), 4))
    return n, edges, sorted(set(hubs)), seeds


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_neighbourhood_components_connectors(spark, seed):
    n, edges, hubs, seeds = _random(seed)
    g = _graph(spark, edges, hubs, n, seeds)
    adj = _adj(n, edges, hubs)
    sd = spark.createDataFrame([(s,) for s in seeds], "id long")
    # k-hop neighbourhood
    want = {}
    for s in seeds:
        for v, d in _bfs(adj, s).items():
            if d <= 2:
                want[v] = min(d, want.get(v, 99))
    got = {r.id: r.dist for r in G.neighbourhood(g, sd, 2).collect()}
    assert got == want
    # components: smallest id reachable
    comp = {}
    for v in range(n):
        comp[v] = min(_bfs(adj, v))
    assert {r.id: r.component for r in G.connected_components(g).collect()} == comp
    # connectors: v on a shortest s-t path for seeds s, t
    dist = {s: _bfs(adj, s) for s in seeds}
    conn = set(seeds)
    for s in seeds:
        for t in seeds:
            if t in dist[s]:
                for v, dv in dist[s].items():
                    dt = _bfs(adj, v).get(t)
                    if dt is not None and dv + dt == dist[s][t]:
                        conn.add(v)
    assert {r.id for r in G.shortest_path_connectors(g, sd, sd).collect()} == conn
    # one source: paths from it to every seed
    s = min(seeds)
    one = {v for t in seeds if t in dist[s] for v, d in dist[s].items() if d + _bfs(adj, v).get(t, 99) == dist[s][t]}
    assert {r.id for r in G.shortest_path_connectors(g, sd.filter(f"id = {s}"), sd).collect()} == one | {s}


def _regions(n, edges, hubs, seeds):
    """Plain version of the connectors: nearest seeds, where they differ across an edge, all ways back."""
    adj = _adj(n, edges, hubs)
    dist = {s: _bfs(adj, s) for s in seeds}
    near = {v: min((d[v] for d in dist.values() if v in d), default=None) for v in range(n)}
    own = {v: {s for s in seeds if dist[s].get(v) == near[v]} for v in range(n) if near[v] is not None}
    found = {v for v in own if len(own[v]) > 1 or any(own[u] != own[v] for u in adj[v])}
    work = list(found)
    while work:
        v = work.pop()
        for u in adj[v]:
            if near[u] == near[v] - 1 and u not in found:
                found.add(u)
                work.append(u)
    return found | set(seeds), adj, dist


@pytest.mark.parametrize("seed", [21, 22, 23, 24])
def test_region_connectors(spark, seed):
    n, edges, hubs, seeds = _random(seed, n=24)
    g = _graph(spark, edges, hubs, n, seeds)
    want, adj, dist = _regions(n, edges, hubs, seeds)
    got = {r.id for r in G.region_connectors(g, spark.createDataFrame([(s,) for s in seeds], "id long")).collect()}
    assert got == want
    # seeds that reach each other still do, and with the near vertices every shortest path of these graphs is kept
    kept = {v: adj[v] & got for v in got}
    assert all((t in _bfs(kept, s)) == (t in dist[s]) for s in seeds for t in seeds)
    near = {v for s in seeds for v, d in dist[s].items() if d <= 2}
    assert {v for s in seeds for t in seeds if t in dist[s] for v in dist[s] if dist[s][v] + dist[t].get(v, 99) == dist[s][t]} <= got | near


def test_a_path_between_two_collected_artists_beside_many_hubs_stays(spark):
    # ten collected artists with many neighbours each, and far from them a path 1..8 with collected ends
    edges = [(i, i + 1) for i in range(1, 8)]
    seeds, hubs, at = {1, 8}, [], 20
    for h in range(10):
        hubs += [(h, at + i) for i in range(6)]
        seeds.add(at)
        at += 6
    g = _graph(spark, edges, hubs, at, seeds)
    keep = {r.id for r in G.relevant_vertices(g).collect()}
    assert set(range(1, 9)) <= keep and not {r.id_artist for r in G.artist_ignore(g).collect()} & set(range(1, 9))


def test_connectors_without_seeds_or_with_one(spark):
    g = _graph(spark, [(0, 1), (1, 2)], [], 3, set())
    none = spark.createDataFrame([], "id long")
    assert G.region_connectors(g, none).count() == 0 and G.relevant_vertices(g).count() == 0
    assert [r.id for r in G.region_connectors(g, spark.createDataFrame([(1,)], "id long")).collect()] == [1]


def test_connectors_path_example(spark):
    # path s-a-b-c-t, seeds s and t, radius 1: b is kept only by the path
    g = _graph(spark, [(0, 1), (1, 2), (2, 3), (3, 4)], [], 5, {0, 4})
    sd = spark.createDataFrame([(0,), (4,)], "id long")
    near = {r.id for r in G.neighbourhood(g, sd, 1).collect()}
    assert near == {0, 1, 3, 4}
    assert {r.id for r in G.relevant_vertices(g, k=1).collect()} == {0, 1, 2, 3, 4}


def test_unreachable_component_excluded(spark):
    g = _graph(spark, [(0, 1), (2, 3)], [], 4, {0})
    assert {r.id_artist for r in G.artist_ignore(g).collect()} == {2, 3}


def test_crowded_hub_stays_linear(spark):
    members = 3000
    g = _graph(spark, [(members, members + 1)], [(1, i) for i in range(members + 1)], members + 2, {0, members + 1})
    sd = spark.createDataFrame([(0,), (members + 1,)], "id long")
    assert {r.id for r in G.shortest_path_connectors(g, sd, sd).collect()} == {0, members, members + 1}


def test_components_of_a_long_path(spark):
    n = 5000
    g = _graph(spark, [(i, i + 1) for i in range(n - 1)], [], n, {0})
    assert [(r.component, r["count"]) for r in G.connected_components(g).groupBy("component").count().collect()] == [(0, n)]
