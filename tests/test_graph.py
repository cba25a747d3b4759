"""Path-based centralities against a few-line Python BFS / Brandes on small graphs."""

import random
from collections import deque

import pytest

from lexiflow.operators import graph as G


def py_measures(edges):
    nodes = sorted({u for e in edges for u in e})
    adj = {u: sorted({d for s, d in edges if s == u and d != u}) for u in nodes}
    n = len(nodes)
    bc = {u: 0.0 for u in nodes}
    dist_all = {}
    for s in nodes:
        dist, sigma, order, preds = {s: 0}, {s: 1}, [], {u: [] for u in nodes}
        q = deque([s])
        while q:
            v = q.popleft()
            order.append(v)
            for w in adj[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    sigma[w] = 0
                    q.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    preds[w].append(v)
        dist_all[s] = dist
        delta = {u: 0.0 for u in nodes}
        for w in reversed(order):
            for v in preds[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                bc[w] += delta[w]
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    bc = {u: b * scale for u, b in bc.items()}
    cc = {}
    for u in nodes:
        ds = [dist_all[s][u] for s in nodes if u in dist_all[s]]
        r, tot = len(ds), sum(ds)
        cc[u] = ((r - 1) / tot) * ((r - 1) / (n - 1)) if tot > 0 and n > 1 else 0.0
    return bc, cc


SHAPES = {
    "path": [("a", "b"), ("b", "c"), ("c", "d")],
    "cycle": [("a", "b"), ("b", "c"), ("c", "a")],
    "star": [("h", x) for x in "pqrs"] + [(x, "h") for x in "pq"],
    "two_components": [("a", "b"), ("c", "d"), ("d", "e")],
    "self_loop_reciprocal": [("a", "a"), ("a", "b"), ("b", "a"), ("b", "c")],
}


def _edges_df(spark, edges):
    return spark.createDataFrame([(s, d, 1) for s, d in edges], "src string, dst string, weight long")


@pytest.mark.parametrize("shape", sorted(SHAPES))
def test_shapes(spark, shape):
    edges = SHAPES[shape]
    df = _edges_df(spark, edges)
    bc_want, cc_want = py_measures(edges)
    paths = G.shortest_paths(df)
    bc = {r["node"]: r["centrality"] for r in G.betweenness_centrality(df, paths).collect()}
    cc = {r["node"]: r["centrality"] for r in G.closeness_centrality(df, paths).collect()}
    for u in bc_want:
        assert abs(bc[u] - bc_want[u]) < 1e-12, (shape, u)
        assert abs(cc[u] - cc_want[u]) < 1e-12, (shape, u)


def test_random_graphs(spark):
    rnd = random.Random(3)
    for _ in range(3):
        nodes = [f"n{i}" for i in range(rnd.randint(3, 9))]
        edges = sorted({(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(rnd.randint(3, 18))})
        df = _edges_df(spark, edges)
        bc_want, cc_want = py_measures(edges)
        bc = {r["node"]: r["centrality"] for r in G.betweenness_centrality(df).collect()}
        cc = {r["node"]: r["centrality"] for r in G.closeness_centrality(df).collect()}
        for u in bc_want:
            assert abs(bc[u] - bc_want[u]) < 1e-9
            assert abs(cc[u] - cc_want[u]) < 1e-9


def test_batches_of_sources_keep_the_state_bounded(spark, monkeypatch):
    """Many small batches give the same measures; no level of a batch has more rows than its bound."""
    rnd = random.Random(5)
    nodes = [f"n{i:03d}" for i in range(100)]
    edges = sorted({(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(170)})
    df = _edges_df(spark, edges)
    bc_want, cc_want = py_measures(edges)
    n = len(bc_want)
    assert G._batches(n, G.WORD, n) == [(i, min(i + 64, n)) for i in range(0, n, 64)]  # one word a batch
    assert G._batches(n, 1, 40 * n) == [(i, min(i + 40, n)) for i in range(0, n, 40)]
    sizes = []
    real = G.cut_lineage

    def watched(frame, *args):
        out = real(frame, *args)
        sizes.append((len(out.columns), out.count()))
        return out

    monkeypatch.setattr(G, "cut_lineage", watched)
    cc = {r["node"]: r["centrality"] for r in G.closeness_centrality(df, state_rows=n).collect()}
    assert max(c for k, c in sizes if k == 3) <= n  # (word, node, bits) and sums per node: 64 sources a row
    sizes.clear()
    bc = {r["node"]: r["centrality"] for r in G.betweenness_centrality(df, state_rows=60 * n).collect()}
    assert max(c for _, c in sizes) <= 60 * n < n * n
    for u in bc_want:
        assert abs(bc[u] - bc_want[u]) < 1e-9 and abs(cc[u] - cc_want[u]) < 1e-9


def test_dense_index_numbers_in_order(spark):
    from lexiflow.session import dense_index
    words = [f"w{(i * 7919) % 1000:04d}" for i in range(1000)]
    frame = spark.createDataFrame([(w,) for w in words], "w string").repartition(7)
    assert [(r.w, r["index"]) for r in sorted(dense_index(frame, "w").collect())] == [(w, i) for i, w in enumerate(sorted(words))]
    assert dense_index(frame.limit(0), "w").collect() == []


def test_reciprocal_and_degree(spark):
    df = _edges_df(spark, SHAPES["self_loop_reciprocal"])
    rec = {(r["src"], r["dst"]): r["reciprocal"] for r in G.reciprocal_edges(df).collect()}
    assert rec == {("a", "a"): True, ("a", "b"): True, ("b", "a"): True, ("b", "c"): False}
    deg = {r["node"]: r["centrality"] for r in G.degree_centrality(df).collect()}
    assert deg == {"a": 2.0, "b": 1.5, "c": 0.5}


def test_contract_and_foreground(spark):
    df = spark.createDataFrame([("x1", "y1", 8), ("x2", "y1", 1), ("y1", "x1", 27), ("z", "x1", 5)],
                               "src string, dst string, weight long")
    attr = spark.createDataFrame([("x1", "X"), ("x2", "X"), ("y1", "Y")], "node string, attr string")
    got = {(r["src"], r["dst"]): r["weight"] for r in G.contract(df, attr).collect()}
    assert got == {("X", "Y"): 9, ("Y", "X"): 27}
    kept = {(r["src"], r["dst"]): r["weight"] for r in G.contract(df, attr, keep_unmapped=True).collect()}
    assert kept[("z", "X")] == 5
    fg = {(r["src"], r["dst"]) for r in G.foreground_edges(df, k=2).where("foreground").collect()}
    assert fg == {("y1", "x1"), ("x1", "y1")}
