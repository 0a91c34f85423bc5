"""Golden values of small complexes, and random ones against plain Python."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from cliquora import ml
from cliquora.model import SimplicialComplex, named_vectors
from cliquora.operators import cliques, components, ensemble, pairs, vectors

Q6 = [{0, 1, 2}, {1, 2, 3}, {3, 4, 5}, {6, 7}]
Q7 = [set(map(int, s.split())) for s in "0 3 4 6 8|0 4 7|2|0 3|3|4|2 4 8|1 7|0 1 3 7|2|2 5 7 9|1 4 7|2 4|7|7|8|5 6 7 8|3 5 6 8|4 5 6 9|4 6".split("|")]


def table(spark, *complexes):
    rows = [(c, i, sorted(s)) for c, own in enumerate(complexes) for i, s in enumerate(own)]
    return SimplicialComplex(spark.createDataFrame(rows, "complex_id long, sid long, members array<bigint>"))


def vector(df, c=0):
    return [r.value for r in df.where(F.col("complex_id") == c).orderBy("q").collect()]


def plain_components(own, q):
    left = {i for i, s in enumerate(own) if len(s) > q}
    out = []
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            i = todo.pop()
            group.add(i)
            near = {j for j in left if len(own[i] & own[j]) > q}
            left -= near
            todo += near
        out.append(sorted(group))
    return sorted(out)


def test_golden_vectors(spark):
    k = table(spark, Q6, Q7)
    assert vector(vectors.simplex_count(k)) == [0, 1, 3] and vector(vectors.simplex_count(k), 1) == [7, 4, 3, 5, 1]
    assert vector(vectors.second_structure_vector(k)) == [4, 4, 3] and vector(vectors.second_structure_vector(k), 1) == [20, 13, 9, 6, 1]
    assert vector(vectors.first_structure_vector(k)) == [2, 3, 3] and vector(vectors.first_structure_vector(k), 1) == [1, 1, 7, 6, 1]
    assert vector(vectors.third_structure_vector(k)) == [0.5, 0.25, 0] and vector(vectors.third_structure_vector(k), 1) == pytest.approx([0.95, 0.923076923, 0.222222222, 0, 0])
    assert vector(pairs.shared_faces(k)) == [1, 1, 0] and vector(pairs.shared_faces(k), 1) == [68, 19, 2, 0, 0]
    e = vector(vectors.entropy(k))
    assert e[0] is None and e[1:] == pytest.approx([1, 0.968392514])
    assert vector(vectors.entropy(k), 1) == pytest.approx([0.962961065, 0.979569765, 0.935944697, 0.947172622, 1])
    assert [r.value for r in vectors.dimensionality(k).where("complex_id = 1").orderBy("vertex").collect()] == [4, 3, 5, 5, 8, 4, 5, 8, 5, 2]


@pytest.mark.parametrize("own", [[], [{0}], [{0, 1}], [{0}, {1}], [{0, 1}, {1, 2}], Q6, Q7, [set(), {3, 4}, {3, 4}]])
def test_components(spark, own):
    k = table(spark, own)
    got = {}
    for r in components.q_components(k).collect():
        got.setdefault(r.q, {}).setdefault(r.component, []).append(r.sid)
    top = max([len(s) for s in own], default=0)
    assert {q: sorted(map(sorted, g.values())) for q, g in got.items()} == {q: plain_components(own, q) for q in range(top)}
    assert all(c == min(s) for g in got.values() for c, s in g.items())


def test_empty_and_bounds(spark):
    k = table(spark, [set(), set()])
    assert [r.value for r in vectors.order(k).collect()] == [-1] and vectors.graded(k).count() == 0
    assert vectors.counts(table(spark, [{2, 9}])).first()[1:] == (1, 10)
    for q in (-1, 3):
        with pytest.raises(IndexError):
            components.components_at(table(spark, Q6), q)
    with pytest.raises(TypeError):
        pairs.simplex_column(k, "x")
    with pytest.raises(KeyError):
        vectors.named(vectors.graded(table(spark, Q6)), "none")
    assert named_vectors(["FSV", "Shared faces count", "fsv", "shared faces count", "?"]) == ["fsv", "faces"]
    with pytest.raises(ValueError):
        named_vectors(["?"], strict=True)


def test_pairs_and_eccentricity(spark):
    k = table(spark, [{0, 1, 2}, {1, 2, 3, 4}, {9}, set(), {1, 2}])
    own = [{0, 1, 2}, {1, 2, 3, 4}, {9}, set(), {1, 2}]
    dense = {(r.i, r.j): r.value for r in pairs.connectivity(k, dense=True).collect()}
    assert dense == {(i, j): len(a & b) - 1 for i, a in enumerate(own) for j, b in enumerate(own)}
    least = {r.sid: r.value for r in pairs.family_eccentricity(k).collect()}
    for i, a in enumerate(own):
        want = min((len(a - b) / len(a) for j, b in enumerate(own) if j != i), default=None) if a else None
        assert least[i] == (pytest.approx(want) if want is not None else None)
    assert pairs.eccentricity_of(k, 0).first().value == pytest.approx(1 / 3) and pairs.eccentricity_of(k, {0, 1, 2}).first().value == 0
    assert pairs.eccentricity_of(k, 0, [2]).first().value == 1 and pairs.eccentricity_of(k, 3).first().value is None


def test_occupation_and_matrix(spark):
    k = table(spark, Q6)
    assert [r.value for r in vectors.occupation_array(k, 2).orderBy("vertex").collect()] == [1, 2, 2, 2, 1, 1, 0, 0]
    assert sum(r.value for r in vectors.occupation_probability(k, 2).collect()) == pytest.approx(1)
    assert [tuple(r)[2:] for r in vectors.incidence_matrix(k, list(range(8))).orderBy("sid").collect()][3] == (0, 0, 0, 0, 0, 0, 1, 1)
    assert sorted(r.sid for r in vectors.upper_skeleton(k, 2).simplices.collect()) == [0, 1, 2]
    assert vectors.full_characterisation(k).order.first().value == 2
    assert [r.sid for r in cliques.without_absorbed(table(spark, [{0, 1}, {0, 1, 2}, {0, 1, 2}, {5}]).simplices).orderBy("sid").collect()] == [1, 3]


def graph(r, n, p):
    return [e for e in itertools.combinations(range(n), 2) if r.random() < p]


def plain_cliques(n, edges):
    """All cliques by testing every subset."""
    e = set(edges)
    return [set(c) for k in range(1, n + 1) for c in itertools.combinations(range(n), k) if all(x in e for x in itertools.combinations(c, 2))]


def test_cliques(spark):
    r = random.Random(4)
    graphs = [graph(r, 8, p) for p in (0, 0.3, 0.6, 0.9, 1)]
    edges = spark.createDataFrame([(c, u, v) for c, g in enumerate(graphs) for u, v in g], "complex_id long, u long, v long")
    sites = spark.createDataFrame([(c, v) for c in range(5) for v in range(8)], "complex_id long, vertex long")
    maximal = {c: [] for c in range(5)}
    for x in cliques.maximal_cliques(edges, sites).collect():
        maximal[x.complex_id].append(x.members)
    every = {c: [] for c in range(5)}
    for x in cliques.k_cliques(edges).where("size > 1").collect():
        every[x.complex_id].append(x.members)
    for c, g in enumerate(graphs):
        all_ = plain_cliques(8, g)
        assert sorted(maximal[c]) == sorted(sorted(a) for a in all_ if not any(a < b for b in all_))
        assert sorted(every[c]) == sorted(sorted(a) for a in all_ if len(a) > 1)


def test_graph_components_with_a_cap(spark):
    g = [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3), (3, 4)]
    edges = spark.createDataFrame([(0, u, v) for u, v in g], "complex_id long, u long, v long")
    sites = spark.range(6).select(F.lit(0).cast("long").alias("complex_id"), F.col("id").alias("vertex"))
    found = lambda cap: sorted((r.q, r.vertices) for r in components.graph_components(edges, sites, cap).collect())
    assert found(None) == [(0, [0, 1, 2, 3, 4]), (0, [5]), (1, [0, 1, 2, 3]), (1, [3, 4]), (2, [0, 1, 2]), (2, [1, 2, 3])]
    assert found(2) == [(0, [0, 1, 2, 3, 4]), (0, [5])] + sorted((1, list(e)) for e in g)
    assert found(0) == found(1) == [(0, [v]) for v in range(6)]


def test_projection_and_filter(spark):
    k = table(spark, Q6)
    count = {}
    for s in Q6:
        for e in itertools.combinations(sorted(s), 2) if len(s) > 2 else ():
            count[e] = count.get(e, 0) + 1
    assert {(r.u, r.v): r.value for r in ensemble.projection(k, 2, weighted=True).collect()} == count
    assert ensemble.dense_projection(k, 2).count() == 2 * len(count)
    edges = spark.createDataFrame([(0, 0, 1, 0.5), (0, 0, 2, 2.0), (0, 1, 2, 3.0), (0, 2, 3, 4.0)], "complex_id long, u long, v long, w double")
    assert ensemble.clique_filter(edges, 2).count() == 3 and ensemble.clique_filter(edges, 2, F.col("w") > 1).count() == 0
    assert ensemble.clique_filter(edges, 1, lambda e: e.where("w > 1")).count() == 3


def test_consensus(spark):
    # in 19 of 20 samples (just the threshold: out), in 20 of 20, and in 1 of 1
    rows = [("a", i, 0, 1) for i in range(20)] + [("a", i, 1, 2) for i in range(19)] + [("b", 0, 1, 2)]
    edges = spark.createDataFrame(rows, "grp string, sample long, u long, v long")
    sizes = spark.createDataFrame([("a", 20), ("b", 1)], "grp string, n long")
    assert sorted(map(tuple, ensemble.consensus(edges, sizes).collect())) == [("a", 0, 1), ("b", 1, 2)]
    sites = spark.createDataFrame([(g, v) for g in "ab" for v in range(3)], "grp string, vertex long")
    assert {r.value for r in ensemble.consensus_statistic(edges, sites, sizes, "a", "b").collect()} == {0.0}


def test_padding_and_forms(spark):
    k = table(spark, [{0}], Q6)
    v = vectors.graded(k, ["fsv", "simplices"])
    assert vectors.padded(v).count() == 2 * 2 * 3 and vectors.padded(v, 0).count() == 4
    assert vectors.padded(v, 4, -1.0).where("value = -1").count() == 2 * (4 + 2)
    wide = vectors.wide(v, ["fsv", "simplices"])
    assert sorted(map(tuple, vectors.long(wide, ["fsv", "simplices"]).select("complex_id", "q", "vector", "value").collect())) == sorted(map(tuple, v.collect()))
    assert {r.complex_id: r.features for r in vectors.flattened(vectors.padded(v, 1)).collect()} == {0: [1, 1, None, None], 1: [2, 0, 3, 1]}
    assert vectors.value_at(v, 2, "fsv").first().value == 3


def test_transformers(spark):
    edges = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 0, 2), (1, 0, 1)], "complex_id long, u long, v long")
    out = ml.GradedParameters(metrics=["fsv", "ssv"], max_order=2, fill_value=0.0, flatten=True).transform(edges)
    assert {r.complex_id: r.features for r in out.collect()} == {0: [1, 1, 1, 1, 1, 1], 1: [1, 1, 1, 1, 0, 0]}
    k = table(spark, Q6).simplices
    assert ml.SimplexProjection(q=1).transform(k).count() == 3 + 2 + 3 + 1 and ml.QComponents(q=1).transform(k).count() == 4
    assert ml.GraphCliqueFilter(q=2).transform(edges.withColumn("w", F.lit(1.0))).count() == 3
    with pytest.raises(TypeError):
        ml.QComponents(r=1)


def test_permutation(spark):
    rows = [(f"a{i}", u, v) for i in range(5) for u, v in ((0, 1), (0, 2), (1, 2))] + [(f"b{i}", 0, 1) for i in range(5)]
    edges = spark.createDataFrame(rows, "sample_id string, u long, v long")
    samples = spark.createDataFrame([(f"{g}{i}", g) for g in "ab" for i in range(5)], "sample_id string, grp string")
    sites = spark.range(3).withColumnRenamed("id", "vertex")
    got = {(r.q, r.vector): (r.value, r.p_value) for r in ensemble.permutation_test(edges, sites, samples, "a", "b", 19, 0.5, ["fsv"]).collect()}
    assert got[0, "fsv"][0] == -1 and all(0 < p <= 1 for _, p in got.values())
    dealt = ensemble.shuffled(samples, 7)
    assert dealt.groupBy("resample", "grp").count().where("count <> 5").count() == 0 and dealt.where("resample > 0").count() == 70


def test_attribute_operators(spark):
    k = table(spark, Q6)
    assert vector(k.first_structure_vector()) == [2, 3, 3]
    with pytest.raises(AttributeError):
        k.nothing  # noqa: B018
    assert math.isclose(sum(r.value for r in k.occupation_probability(1).collect()), 1)
