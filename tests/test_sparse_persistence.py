"""Persistence of all levels where a large graph has few cliques: they are listed, and no task holds a graph's ranges."""

import itertools
import random
import time

from cliquora.operators import cliques, persistence


def whole(found):
    return sorted((r.complex_id, r.q, r.birth, r.death, tuple(r.members)) for r in found.collect())


def test_few_cliques_are_listed(spark, monkeypatch):
    r = random.Random(8)
    edges = {(u, v): float(r.randint(1, 5)) for u in range(90) for v in r.sample(range(90), 2) if u < v}
    edges |= {e: float(r.randint(1, 5)) for e in itertools.combinations(range(4), 2)}
    rows = spark.createDataFrame([(c, u, v, w) for c in (0, 1) for (u, v), w in edges.items()], "complex_id long, u long, v long, w double")
    one = whole(persistence.dense(rows, 10**9))

    def ranges(*_):
        raise AssertionError("goes by ranges")

    monkeypatch.setattr(persistence, "dense_parts", ranges)
    assert whole(persistence.dense(rows, 20)) == one and any(x[1] > 2 for x in one)


def test_many_cliques_are_not(spark):
    edges = spark.createDataFrame([(0, u, v, 1.0) for u, v in itertools.combinations(range(12), 2)], "complex_id long, u long, v long, w double")
    assert cliques.few_cliques(edges, 400) is None
    assert cliques.few_cliques(edges, 4096).count() == 4095


def test_a_step_of_many_births():
    n = 20_000
    began = time.time()
    found = persistence.sweep([(1.0, (v,)) for v in range(n)], [(1.0, (v,), (v + 1,)) for v in range(n - 1)])
    assert found == [(1.0, float("inf"), list(range(n)))] and time.time() - began < 10
