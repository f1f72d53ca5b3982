"""The layout of a graph against dense eigenvectors."""

import numpy as np
import pytest

from moltabula.operators import layout
from moltabula.plans.table_queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
EDGES = "ordinal bigint, neighbour bigint, score double"


def dense(pairs):
    """Nodes, degrees, normalised operator of directed pairs: greatest of repeated ones, then p + q - pq."""
    best = {}
    for a, b, w in pairs:
        if None not in (a, b, w) and a != b and w > 0:
            best[a, b] = max(best.get((a, b), 0.0), min(w, 1.0))
    nodes = sorted({x for pair in best for x in pair})
    at = {x: i for i, x in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for (a, b), w in best.items():
        m[at[a], at[b]] = w
    m = m + m.T - m * m.T
    d = m.sum(axis=1)
    return nodes, d, m / np.sqrt(np.outer(d, d))


def placed(spark, pairs, **more):
    edges = layout.symmetric_edges(spark.createDataFrame(pairs, EDGES))
    rows = layout.graph_layout(edges, **more).collect()
    return {r.a: r for r in rows}


def checked(got, nodes, d, s, tol):
    assert sorted(got) == nodes
    values = np.linalg.eigvalsh(s)[::-1]
    vectors = np.array([[got[x].component_1, got[x].component_2] for x in nodes]) * np.sqrt(d)[:, None]
    first = got[nodes[0]]
    for j, (value, residual) in enumerate([(first.eigenvalue_1, first.residual_1), (first.eigenvalue_2, first.residual_2)]):
        v = vectors[:, j]
        off = np.linalg.norm(s @ v - value * v)
        assert abs(np.linalg.norm(v) - 1) < 1e-6 and off <= tol and abs(off - residual) < 1e-5
        assert abs(value - values[j + 1]) < 1e-3 and v[np.abs(v).argmax()] > 0
        assert abs(v @ np.sqrt(d)) / np.sqrt(d.sum()) < 1e-6
    assert abs(vectors[:, 0] @ vectors[:, 1]) < 1e-6


def ring(n, seed=1):
    rng = np.random.default_rng(seed)
    pairs = [(i, (i + s) % n, float(rng.uniform(0.3, 1))) for i in range(n) for s in (1, 2)]
    return pairs + [(i, int(rng.integers(0, n)), 0.4) for i in range(0, n, 3)]


def test_vectors_of_a_random_graph(spark):
    pairs = ring(60)
    pairs += [(i, 0, 0.2) for i in range(1, 40)]  # one node is the neighbour of most
    pairs += pairs[:5] + [(3, 3, 1.0), (4, None, 0.5), (5, 6, None), (7, 8, 0.0), (9, 10, 1.5)]
    checked(placed(spark, pairs), *dense(pairs), tol=1e-3)


def test_start_changes_nothing_but_the_way(spark):
    pairs = ring(40, seed=2)
    nodes, d, s = dense(pairs)
    start = spark.createDataFrame([(i, float(np.cos(i / 6)), float("nan") if i % 9 == 0 else float(i)) for i in range(30)] + [(99, 1.0, None)], "a int, x double, y double")
    checked(placed(spark, pairs, start=start), nodes, d, s, tol=1e-3)


def test_parts_lie_apart(spark):
    pairs = [(a + x, b + x, 1.0) for x in (0, 10, 20) for a in range(5) for b in range(5) if a < b]
    got = placed(spark, pairs)
    where = {x: {(round(got[i + x].component_1, 3), round(got[i + x].component_2, 3)) for i in range(5)} for x in (0, 10, 20)}
    assert all(len(v) == 1 for v in where.values()) and len(set.union(*where.values())) == 3
    assert abs(got[0].eigenvalue_1 - 1) < 1e-6 and abs(got[0].eigenvalue_2 - 1) < 1e-6


def test_two_nodes_and_none(spark):
    got = placed(spark, [(4, 9, 0.5)])
    assert got[4].component_1 == pytest.approx(1.0 / np.sqrt(2 * 0.5)) and got[9].component_1 == pytest.approx(-got[4].component_1)
    assert got[4].eigenvalue_1 == pytest.approx(-1) and got[4].component_2 == 0 and got[4].eigenvalue_2 is None
    assert placed(spark, []) == {} and placed(spark, [(1, 1, 1.0), (2, None, 1.0)]) == {}


def test_groups_in_a_row_settle(spark):
    rng = np.random.default_rng(1)
    pairs = [(20 * c + i, 20 * c + int(j), float(rng.uniform(0.3, 1))) for c in range(12) for i in range(20) for j in rng.integers(0, 20, 4)]
    pairs += [(20 * c, 20 * c + 20, 0.3) for c in range(11)]
    checked(placed(spark, pairs), *dense(pairs), tol=1e-3)


def test_slices_and_blocks_change_nothing(spark):
    pairs = ring(60) + [(i, 0, 0.2) for i in range(1, 40)]
    whole, cut = placed(spark, pairs), placed(spark, pairs, slice_nodes=9, block_edges=40)
    checked(cut, *dense(pairs), tol=1e-3)
    assert all(cut[x] == pytest.approx(whole[x], abs=1e-6) for x in whole)


def test_query_is_settled(spark):
    rows = QUERIES["graph_layout"](spark, FOLDER).collect()
    assert len({r.vec_id for r in rows}) == len(rows) == spark.read.parquet(f"{FOLDER}/embeddings.parquet").count()
    assert all(0 <= r.residual_1 <= 1e-3 and 0 <= r.residual_2 <= 1e-3 and r.component_1 is not None for r in rows)
    assert len({(r.component_1, r.component_2) for r in rows}) > len(rows) // 2
