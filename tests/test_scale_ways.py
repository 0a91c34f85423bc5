"""The ways for large inputs give what the plain ones give; transformers with isolated vertices; diagrams; exact permutation tests."""

import itertools
import random
import time

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from cliquora import functions, ml
from cliquora.model import SimplicialComplex
from cliquora.operators import cliques, components, ensemble, pairs, persistence, vectors


def drawn(spark, n=60, vertices=25, seed=1, complexes=2):
    r = random.Random(seed)
    rows = [(c, s, r.sample(range(vertices), r.randint(0, 7))) for c in range(complexes) for s in range(n)]
    return SimplicialComplex(spark.createDataFrame(rows, "complex_id long, sid long, members array<long>"))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_hot_vertices(spark):
    k = drawn(spark)
    want = rows(pairs.pairs(k))
    assert rows(pairs.pairs(k, heavy=5)) == want == rows(pairs.pairs(k, heavy=1)) and len(want) > 500


def test_numbering_by_ranges(spark):
    r = random.Random(2)
    found = spark.createDataFrame([(c, m) for c in range(3) for m in {tuple(sorted(r.sample(range(9), 3))) for _ in range(60)}], "complex_id long, members array<long>")
    want = rows(cliques.numbered(found))
    assert rows(cliques.numbered(found.repartition(5), ranked=10)) == want
    assert cliques.numbered(found.where("false"), ranked=-1).count() == 0


def plain_components(k):
    """(complex_id, q, sid, least sid) by flooding, level by level."""
    own, out = {}, []
    for r in k.simplices.collect():
        own.setdefault(r.complex_id, {})[r.sid] = set(r.members)
    for c, sets in own.items():
        for q in range(max(map(len, sets.values()))):
            left = {s for s in sets if len(sets[s]) > q}
            while left:
                found = [min(left)]
                left.discard(found[0])
                for x in found:
                    near = {y for y in left if len(sets[x] & sets[y]) > q}
                    left -= near
                    found += near
                out += [(c, q, x, found[0]) for x in found]
    return sorted(out)


def test_merge_tree(spark):
    k = drawn(spark, 80, 30, 3)
    want = plain_components(k)
    assert rows(components.q_components(k).select("complex_id", "q", "sid", "component")) == want
    n = {}
    for c, q, sid, component in want:
        n[c, q] = n.get((c, q), 0) + (sid == component)
    assert rows(vectors.first_structure_vector(k)) == sorted((c, q, x) for (c, q), x in n.items())
    for q in range(4):
        assert rows(components.components_at(k, q)) == [(c, s, x) for c, p, s, x in want if p == q]


def test_merge_tree_of_a_long_chain(spark):
    """Links of rising weight: every simplex chooses the next one, so that one round's pointers go all the way."""
    n = 200
    chain = spark.createDataFrame([(0, s, list(range(s * (s - 1) // 2, s * (s + 1) // 2 + s + 1))) for s in range(1, n)], "complex_id long, sid long, members array<long>")
    k = SimplicialComplex(chain)
    assert rows(components.q_components(k).select("complex_id", "q", "sid", "component")) == plain_components(k)
    alone = SimplicialComplex(spark.createDataFrame([(0, 1, [1]), (0, 2, [2, 3]), (1, 1, [])], "complex_id long, sid long, members array<long>"))
    assert rows(components.q_components(alone).select("q", "sid", "component")) == [(0, 1, 1), (0, 2, 2), (1, 2, 2)]
    assert components.q_components(SimplicialComplex(alone.simplices.where("false"))).count() == 0


def test_no_task_holds_a_complex(spark):
    """The most rows that reach one Python call stay below a complex's simplices; there is no grouped Python at all."""
    k = drawn(spark, 80, 30, 3)
    plan = components.q_components(k)._jdf.queryExecution().toString()
    assert "FlatMap" not in plan


def test_overlaps(spark):
    k = drawn(spark)
    for least in (1, 2, 3, 5):
        want = rows(pairs.pairs(k).where(F.col("shared") >= least))
        assert rows(pairs.overlaps(k, least)) == want == rows(pairs.overlaps(k, least, heavy=3))


def test_overlaps_meet_fewer(spark):
    """A vertex that all simplices have brings no pairs together where two shared vertices are asked for."""
    k = SimplicialComplex(spark.createDataFrame([(0, s, [0, 10 + s, 1000 + s // 2]) for s in range(60)], "complex_id long, sid long, members array<long>"))
    assert rows(pairs.overlaps(k, 2)) == [(0, s, s + 1, 2) for s in range(0, 60, 2)]
    assert rows(pairs.overlaps(k, 3)) == []


def test_whole_graphs_in_a_task(spark):
    r = random.Random(4)
    edges = spark.createDataFrame([(c, u, v) for c in range(4) for u, v in itertools.combinations(range(14), 2) if r.random() < 0.5], "complex_id long, u long, v long")
    assert rows(cliques.maximal_cliques(edges, by_graph=True)) == rows(cliques.maximal_cliques(edges))


def test_no_clique_size_is_cut(spark):
    path = spark.createDataFrame([(0, u, v) for u, v in itertools.combinations(range(11), 2)], "complex_id long, u long, v long")
    assert [r["count"] for r in cliques.k_cliques(path).groupBy("size").count().orderBy("size").collect()] == [11, 55, 165, 330, 462, 462, 330, 165, 55, 11, 1]


def test_cliques_of_a_hub_by_levels(spark):
    """A hub of 3000 leaves has no later neighbour but those of as many edges; births are the largest weights."""
    weight = {(u, v): float((7 * u + 3 * v) % 23) for u, v in [*itertools.combinations(range(5), 2), *((0, leaf) for leaf in range(5, 3005)), *((5, leaf) for leaf in range(6, 9))]}
    edges = spark.createDataFrame([(0, u, v, w) for (u, v), w in weight.items()], "complex_id long, u long, v long, w double")
    rows_of = cliques.by_degree(edges).groupBy("x").count().collect()
    assert max(r["count"] for r in rows_of) ** 2 <= 2 * len(weight) and 0 not in {r.x for r in rows_of}
    got = {tuple(r.members): r.birth for r in cliques.k_cliques(edges).where("size > 1").collect()}
    larger = [c for k in (3, 4, 5) for c in itertools.combinations(range(5), k)] + [(0, 5, leaf) for leaf in range(6, 9)]
    assert got == {c: max(weight[e] for e in itertools.combinations(c, 2)) for c in [*weight, *larger]}


def test_transformer_keeps_isolated_vertices(spark):
    edges = spark.createDataFrame([(0, 0, 2), (1, None, None), (2, 0, 1), (2, 1, 2), (2, 0, 2)], "complex_id long, u long, v long")
    matrices = {0: [[0, 0, 1], [0, 0, 0], [1, 0, 0]], 1: [[0] * 3] * 3, 2: [[0, 1, 1], [1, 0, 1], [1, 1, 0]]}
    adjacency = spark.createDataFrame([(c, i, row) for c, m in matrices.items() for i, row in enumerate(m)], "complex_id long, i long, row array<int>")
    sites = spark.createDataFrame([(c, v) for c in range(3) for v in range(3)], "complex_id long, vertex long")
    step = {"metrics": ["fsv"], "max_order": 2, "fill_value": 0.0, "flatten": True}
    want = {0: [2, 1, 0], 1: [3, 0, 0], 2: [1, 1, 1]}
    for found in (ml.GradedParameters(n_vertices=3, **step).transform(edges), ml.GradedParameters(vertices=sites, **step).transform(edges), ml.GradedParameters(**step).transform(adjacency)):
        assert {r.complex_id: r.features for r in found.collect()} == want


def test_diagrams(spark):
    edges = spark.createDataFrame([(0, 0, 1, 1.0), (0, 1, 2, 2.0), (0, 0, 2, 3.0)], "complex_id long, u long, v long, w double")
    seen = Observation("seen")
    d = persistence.Diagram(persistence.persistent_communities(edges, statistics=seen))
    assert len(d) == 4 and d[0] == (0, 1.0, float("inf"), [0, 1, 2]) and d[2] == (1, 2.0, 3.0, [1, 2]) and d.members(2) == [1, 2] and d.size(3) == 3
    for i in (-1, 4):
        with pytest.raises(IndexError):
            d[i]
    assert [r.q for r in d.to_dataframe().collect()] == [0, 1, 1, 2] and rows(d.numbered().select("i", "q")) == [(0, 0), (1, 1), (2, 1), (3, 2)]
    assert d.to_dataframe().columns == ["q", "birth", "death", "size", "members"]
    assert seen.get == {"intervals": 4, "lasting": 3, "highest_q": 2, "most_members": 3}


def test_whole_sweep_of_thirty_vertices():
    r = random.Random(7)
    edges = [(u, v, r.random()) for u, v in itertools.combinations(range(30), 2)]
    began = time.time()
    found = persistence.swept(edges)
    assert time.time() - began < 60
    # one community of each level lasts, and there are as many levels as vertices
    assert sorted(q for q, _, death, _ in found if death == float("inf")) == list(range(30))
    assert all(birth < death and len(members) > q for q, birth, death, members in found)


def test_dense_projections(spark):
    k = drawn(spark, 12, 9, 5)
    want = {(r.complex_id, r.i, r.j): r.value for r in ensemble.dense_projection(k, 1, weighted=True).collect()}
    got = ensemble.projection_rows(k, 1, weighted=True).collect()
    n = k.incidence().agg(F.max("vertex")).first()[0] + 1
    assert len(got) == 2 * n and all(len(r.row) == n for r in got)
    assert {(r.complex_id, r.i, j): x for r in got for j, x in enumerate(r.row) if x} == want


def test_subsets(spark):
    df = spark.createDataFrame([([],), ([4],), ([1, 2, 5, 9],)], "m array<long>")
    for k in (0, 1, 2, 4, 5):
        got = [sorted(map(tuple, r[0])) for r in df.select(functions.subsets(F.col("m"), k)).collect()]
        assert got == [sorted(itertools.combinations(m, k)) if k else [] for m in ([], [4], [1, 2, 5, 9])]


def test_exact_p_values(spark):
    # three graphs a group; every dealing of the labels is one of 20 teams of three
    graphs = {"a0": [(0, 1), (0, 2), (1, 2)], "a1": [(0, 1), (0, 2), (1, 2)], "a2": [(0, 1), (0, 2), (1, 2)], "b0": [(0, 1)], "b1": [(0, 1)], "b2": []}
    edges = spark.createDataFrame([(g, *e) for g, es in graphs.items() for e in es], "sample_id string, u long, v long")
    samples = spark.createDataFrame([(g, g[0]) for g in graphs], "sample_id string, grp string")
    sites = spark.range(3).withColumnRenamed("id", "vertex")
    n = 400
    got = {(r.q, r.vector): (r.value, r.p_value) for r in ensemble.permutation_test(edges, sites, samples, "a", "b", n, 0.5, ["fsv"]).collect()}

    def fsv(team):
        kept = [e for e in itertools.combinations(range(3), 2) if sum(e in graphs[g] for g in team) / len(team) > 0.5]
        return {0: {0: 1, 3: 1}.get(len(kept), 0) if len(kept) != 1 else 2} if kept else {0: 3}

    teams = {}
    for r in ensemble.shuffled(samples, n).collect():
        teams.setdefault(r.resample, {}).setdefault(r.grp, []).append(r.sample_id)
    stat = {i: fsv(t["a"])[0] - fsv(t["b"])[0] for i, t in teams.items()}
    above, below = sum(stat[i] >= stat[0] for i in range(1, n + 1)), sum(stat[i] <= stat[0] for i in range(1, n + 1))
    assert got[0, "fsv"] == (stat[0], pytest.approx(min(1, 2 * (min(above, below) + 1) / (n + 1))))


def test_hubs_are_peeled(spark):
    """A star of 3000 leaves whose centre is in a clique too: no task gets more than four times the degeneracy of neighbours."""
    leaves = spark.range(100, 3100).select(F.lit(0).cast("long").alias("complex_id"), F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    clique = spark.createDataFrame([(0, u, v) for u, v in itertools.combinations(range(8), 2)], "complex_id long, u long, v long")
    edges = leaves.unionByName(clique)
    most = cliques.later_links(edges).where("b is null").groupBy("v").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert most <= 4 * 7
    found = cliques.maximal_cliques(edges)
    assert found.count() == 3001
    assert [r.members for r in found.where(F.size("members") > 2).collect()] == [list(range(8))]


def test_hub_cliques_and_cores_against_plain(spark):
    r = random.Random(9)
    graphs = {c: [(u, v) for u, v in itertools.combinations(range(16), 2) if r.random() < p] for c, p in enumerate((0.15, 0.4, 0.7, 1.0))}
    edges = spark.createDataFrame([(c, *e) for c, es in graphs.items() for e in es], "complex_id long, u long, v long")
    assert rows(cliques.maximal_cliques(edges, hub=0)) == rows(cliques.maximal_cliques(edges))
    want = []
    for c, es in graphs.items():
        near, k = {}, 0
        for u, v in es:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
        while near:
            v = min(near, key=lambda x: len(near[x]))
            k = max(k, len(near[v]))
            want.append((c, v, k))
            for n in near.pop(v):
                near[n].discard(v)
    assert rows(cliques.core_numbers(edges).select("complex_id", "vertex", "core")) == sorted(want)
    assert cliques.core_numbers(edges.where("false")).count() == 0 and cliques.hub_cliques(edges.where("false")).count() == 0
