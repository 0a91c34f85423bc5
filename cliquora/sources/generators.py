"""Generated graphs: preferential attachment, and graphs of a given degree sequence. One task a sample, seeded by its number."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

EDGES = "complex_id long, u long, v long"


def attached(n: int, m: int, seed: int) -> list[tuple[int, int]]:
    """n vertices; each new one links to m others, drawn in proportion to their degree."""
    if not 1 <= m < n:
        raise ValueError("1 <= m < n is needed")
    r = random.Random(seed)
    ends = list(range(m))
    edges = []
    for v in range(m, n):
        # the first newcomer links to all; then every end of an edge is a ticket
        drawn: set[int] = set(range(m)) if v == m else set()
        while len(drawn) < m:
            drawn.add(r.choice(ends))
        edges += [(u, v) for u in sorted(drawn)]
        ends = ([] if v == m else ends) + [x for u in sorted(drawn) for x in (u, v)]
    return edges


def scale_free_graphs(spark: SparkSession, n: int, m: int, n_samples: int) -> DataFrame:
    """Edges of n_samples graphs; sample i is seeded with i."""

    def make(batches):
        for batch in batches:
            for i in batch["id"]:
                yield pd.DataFrame([(i, u, v) for u, v in attached(n, m, int(i))], columns=["complex_id", "u", "v"])

    return spark.range(n_samples).repartition(max(1, min(n_samples, 200))).mapInPandas(make, EDGES)


def realised(degrees: list[int]) -> list[tuple[int, int]] | None:
    """Edges of a simple graph with these degrees: the vertex of the largest rest links to the next largest; None if there is none."""
    left = {v: d for v, d in enumerate(degrees)}
    if any(d < 0 for d in degrees) or sum(degrees) % 2:
        return None
    edges = []
    while left:
        v = max(left, key=lambda x: (left[x], -x))
        d = left.pop(v)
        others = sorted(left, key=lambda x: (-left[x], x))[:d]
        if len(others) < d or any(left[x] == 0 for x in others):
            return None
        for x in others:
            left[x] -= 1
            edges.append((min(v, x), max(v, x)))
    return sorted(edges)


def degree_graphs(degrees: DataFrame) -> DataFrame:
    """degrees (complex_id, degrees ARRAY) -> edges; a sequence that no graph has gives one row without ends."""

    def make(batches):
        for batch in batches:
            for i, d in zip(batch["complex_id"], batch["degrees"], strict=True):
                edges = realised([int(x) for x in d])
                rows = [(i, None, None)] if edges is None else [(i, u, v) for u, v in edges]
                yield pd.DataFrame({"complex_id": [r[0] for r in rows], "u": pd.array([r[1] for r in rows], "Int64"), "v": pd.array([r[2] for r in rows], "Int64")})

    return degrees.select("complex_id", "degrees").mapInPandas(make, EDGES)
