"""Golden diagrams, and random graphs against a model that rebuilds everything at each threshold."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from cliquora.operators import persistence

INF = math.inf


def run(spark, graphs, max_q):
    rows = [(c, u, v, float(w)) for c, g in enumerate(graphs) for u, v, w in g]
    edges = spark.createDataFrame(rows, "complex_id long, u long, v long, w double")
    out = {c: [] for c in range(len(graphs))}
    for r in persistence.persistent_communities(edges, max_q).collect():
        assert r.size == len(r.members)
        out[r.complex_id].append((r.q, r.birth, r.death, tuple(r.members)))
    return {c: sorted(x) for c, x in out.items()}


def iv(q, birth, death, members):
    return q, float(birth), float(death), tuple(map(int, members))


TRIANGLE = [(0, 1, 1), (1, 2, 2), (0, 2, 3)]
TRI = [iv(0, 1, INF, "012"), iv(1, 1, INF, "012"), iv(1, 2, 3, "12"), iv(2, 3, INF, "012")]
SQUARE = [(0, 1, 1), (1, 2, 1), (2, 3, 1), (0, 3, 1), (0, 2, 2)]
K4 = [(u, v, 1) for u, v in itertools.combinations(range(4), 2)] + [(4, 0, 2), (4, 1, 3), (4, 2, 4), (4, 3, 5)]
DIRTY = [(1, 1, 0.5), (0, 1, 1), (1, 0, 2), (0, 1, 3), (1, 2, math.nan), (1, 2, INF)]


def test_golden(spark):
    got = run(spark, [[], [(0, 1, 0.5)], TRIANGLE, SQUARE, K4, [(v, u, w) for u, v, w in K4], DIRTY], None)
    assert got[0] == [] and got[1] == [iv(0, 0.5, INF, "01"), iv(1, 0.5, INF, "01")]
    assert got[2] == sorted(TRI)
    assert got[3] == sorted([iv(0, 1, INF, "0123"), iv(1, 1, 2, "03"), iv(1, 1, 2, "12"), iv(1, 1, 2, "23"), iv(1, 1, INF, "0123"), iv(2, 2, INF, "012"), iv(2, 2, INF, "023")])
    want = [iv(0, 1, INF, "01234"), iv(1, 1, INF, "01234"), iv(1, 2, 3, "04"), iv(2, 1, INF, "01234"), iv(2, 3, 4, "014"), iv(3, 1, INF, "01234"), iv(3, 4, 5, "0124"), iv(4, 5, INF, "01234")]
    assert got[4] == got[5] == sorted(want)
    assert got[6] == [iv(0, 1, INF, "01"), iv(1, 1, INF, "01")]
    assert run(spark, [TRIANGLE], 1)[0] == sorted(t for t in TRI if t[0] < 2)
    with pytest.raises(ValueError):
        run(spark, [TRIANGLE], -1)


def cliques_at(n, edges):
    e = set(edges)
    return [set(c) for k in range(2, n + 1) for c in itertools.combinations(range(n), k) if all(x in e for x in itertools.combinations(c, 2))]


def rebuilt(n, edges, max_q):
    """Maximal cliques of every threshold's graph, grouped by their intersections."""
    out, alive = [], {}
    times = sorted({w for _, _, w in edges})
    for t in times:
        every = cliques_at(n, [(u, v) for u, v, w in edges if w <= t])
        maximal = [c for c in every if not any(c < d for d in every)]
        top = max(map(len, maximal)) - 1
        now = {}
        for q in range(min(top, max_q if max_q is not None else top) + 1):
            left = [c for c in maximal if len(c) > q]
            groups = []
            while left:
                group = [left.pop()]
                for c in group:
                    near = [d for d in left if len(c & d) > q]
                    left = [d for d in left if d not in near]
                    group += near
                groups.append(group)
            now[q] = groups
        after = {}
        for q, groups in now.items():
            for group in groups:
                own = [(b, m, cs) for b, m, cs in alive.get(q, []) if any(c <= d and len(c) > q for c in cs for d in group)]
                members = tuple(sorted(set().union(*group)))
                if own:
                    own.sort(key=lambda x: (x[0], -len(x[1]), x[1]))
                    out += [(q, b, t, m) for b, m, _ in own[1:]]
                after.setdefault(q, []).append((own[0][0] if own else t, members, group))
        alive = after
    return sorted(out + [(q, b, INF, m) for q, x in alive.items() for b, m, _ in x])


def drawn(seed):
    r = random.Random(seed)
    n = r.randint(4, 7)
    p, grid = r.choice([0.25, 0.5, 0.85, 1]), r.choice([4, 10, 1000])
    return n, [(u, v, float(r.randrange(grid))) for u, v in itertools.combinations(range(n), 2) if r.random() < p]


@pytest.mark.parametrize("max_q", [None, 0, 1, 2, 4])
def test_random_graphs(spark, max_q):
    graphs = [drawn(100 * (max_q or 7) + i) for i in range(40)]
    got = run(spark, [g for _, g in graphs], max_q)
    for c, (n, g) in enumerate(graphs):
        assert got[c] == (rebuilt(n, g, max_q) if g else [])


def test_both_plans_agree_on_more_vertices(spark):
    r = random.Random(1)
    graphs = [[(u, v, float(r.randrange(6))) for u, v in itertools.combinations(range(70), 2) if r.random() < 0.06]]
    whole = run(spark, graphs, None)[0]
    assert run(spark, graphs, 2)[0] == [x for x in whole if x[0] <= 2]


def test_inputs(spark):
    matrix = spark.createDataFrame([(0, [0.0, 1.0, 3.0]), (1, [1.0, 0.0, 2.0]), (2, [math.nan, math.nan, 0.0])], "i long, row array<double>")
    got = sorted((r.q, r.birth, r.death, tuple(r.members)) for r in persistence.of_distance_matrix(matrix).collect())
    assert got == sorted(TRI)
    with pytest.raises(ValueError):
        persistence.of_distance_matrix(matrix.where("i < 2"))
    rows = spark.createDataFrame([(float(u), float(v), float(w)) for u, v, w in TRIANGLE], "u double, v double, w double")
    assert persistence.of_edge_rows(rows).count() == 4
    for bad in (-1.0, 0.5, 2.0**33, None):
        with pytest.raises(ValueError):
            persistence.of_edge_rows(rows.unionByName(spark.createDataFrame([(bad, 1.0, 1.0)], rows.schema)))
    with pytest.raises(ValueError):
        persistence.of_edge_rows(rows.drop("w"))
    near = rows.withColumn("w", F.col("w") + 0.004)
    assert sorted(r.birth for r in persistence.of_edge_rows(near, digits=1).collect()) == [1.0, 1.0, 2.0, 3.0]


def whole(df):
    return sorted((r.complex_id, r.q, r.birth, r.death, tuple(r.members)) for r in df.collect())


def test_ranges_of_weights(spark):
    """However a graph's weights are cut into ranges, each a task of its own, the intervals are those of one sweep."""
    r = random.Random(3)
    rows = [(c, u, v, w) for c in range(40) for u, v, w in drawn(900 + c)[1]]
    rows += [(50, u, v, float(r.randrange(6))) for u, v in itertools.combinations(range(60), 2) if r.random() < 0.1]
    rows += [(51, u, v, r.random()) for u, v in itertools.combinations(range(15), 2)] + [(52, 0, 1, 1.0)]
    edges = spark.createDataFrame(rows, "complex_id long, u long, v long, w double")
    one = whole(persistence.dense(edges, 10**9))
    assert len(one) > 900
    for at_most in (1, 2, 5, 40):
        assert whole(persistence.dense(edges, at_most)) == one


def test_a_large_graph_is_several_tasks(spark):
    r = random.Random(5)
    rows = sorted({(min(u, v), max(u, v)) for u, v in ((r.randrange(1500), r.randrange(1500)) for _ in range(5200)) if u != v})
    edges = spark.createDataFrame([(0, u, v, float(r.randrange(1000))) for u, v in rows], "complex_id long, u long, v long, w double")
    cut = persistence.ranges(edges, persistence.RANGE)
    sizes = [x["count"] for x in cut.groupBy("at").count().collect()]
    assert len(rows) > 5000 and len(sizes) >= 8 and max(sizes) < 2 * persistence.RANGE
    assert whole(persistence.persistent_communities(edges)) == whole(persistence.dense(edges, 10**9))


def test_births_up_a_long_chain(spark):
    nodes = [(0, i, i + 1 if i < 90 else None, float(i) if i in (7, 40) else None) for i in range(91)] + [(0, 200, 40, 3.0), (1, 5, None, 2.0)]
    found = persistence.births(spark.createDataFrame(nodes, "complex_id long, node long, up long, birth double"))
    want = {(0, i): (None if i < 7 else 7.0 if i < 40 else 3.0) for i in range(91)} | {(0, 200): 3.0, (1, 5): 2.0}
    assert {(r.complex_id, r.node): r.birth for r in found.collect()} == want


def test_large_graphs_go_by_connected_parts(spark):
    import random

    from cliquora.operators import persistence

    r = random.Random(5)
    one = [(u, v, float(r.randint(1, 6))) for u in range(9) for v in range(u + 1, 9) if r.random() < 0.6]
    edges = spark.createDataFrame([(c, u + 9 * k, v + 9 * k, w) for c in "ab" for k in range(2) for u, v, w in one], "complex_id string, u long, v long, w double")
    rows, parts = persistence.parted(edges)
    assert parts.count() == 4 and rows.groupBy("complex_id").count().where(f"count = {len(one)}").count() == 4
    found = sorted((r.complex_id, r.q, r.birth, r.death, tuple(r.members)) for r in persistence.dense(edges, len(one) + 1).collect())
    want = sorted((c, q, b, d, tuple(x + 9 * k for x in m)) for c in "ab" for k in range(2) for q, b, d, m in persistence.swept(one))
    assert found == want
