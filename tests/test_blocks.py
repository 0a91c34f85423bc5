"""Intersections counted by pairs of blocks: nothing of a pair is shuffled, and forests keep every level's components."""

import random

import pyarrow as pa

from cliquora.operators import blocks, components, pairs
from tests.test_scale_ways import drawn, plain_components, rows


def test_pairs_are_not_shuffled(spark):
    plan = pairs.overlaps(drawn(spark), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "members" not in plan


def test_forests_keep_components(spark):
    k = drawn(spark)
    every, links = rows(pairs.pairs(k)), rows(pairs.forests(k, heavy=25))
    assert set(links) <= set(every) and 4 * len(links) < len(every)
    assert rows(components.q_components(k, pairs.forests(k, heavy=25)).select("complex_id", "q", "sid", "component")) == plain_components(k)


def test_dense_vertices_by_products(monkeypatch):
    monkeypatch.setattr(blocks, "CHUNK", 50)
    r = random.Random(3)
    sets = [sorted(r.sample(range(40), r.randint(5, 30))) for _ in range(30)]
    has = [x for x in ([i for i, m in enumerate(sets) if v in m] for v in range(40)) if x]
    column = pa.array(has, pa.list_(pa.int64()))
    both = {f"{name}_{end}": column for name in ("sids", "sizes") for end in "ij"}
    table = pa.table({"complex_id": pa.array([0] * len(has), pa.int64()), "word": pa.array([False] * len(has)), **both})
    want = [[len(set(a) & set(b)) for b in sets] for a in sets]
    for batch in (1 << 16, 1):  # one by one, then by products
        monkeypatch.setattr(blocks, "BATCH", batch)
        assert blocks.counted(table)[0].tolist() == want
