"""Bit sets, compressed rows and fitted transformers, against plain versions; and the queries of both against SQL."""

import random
import tempfile

import duckdb
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from cliquora import catalog, ml
from cliquora.model import SimplicialComplex
from cliquora.operators import bitsets, pairs
from cliquora.sources import compressed

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def sets():
    draw = random.Random(4)
    rows = [(g, s, sorted(draw.sample(range(200), draw.randint(0, 40))), sorted(draw.sample(range(200), draw.randint(0, 40)))) for g in (0, 1) for s in range(30)]
    return [(g, s, [63, 64, 127, 128] if s == 0 else a, b) for g, s, a, b in rows]


def test_words_are_sets(spark, sets):
    rows = spark.createDataFrame(sets, "complex_id long, sid long, a array<long>, b array<long>")
    inc = lambda c: rows.select("complex_id", "sid", F.explode(c).alias("vertex"))
    a, b = bitsets.words(inc("a")), bitsets.words(inc("b"))
    plain = lambda op: sorted((g, s, v) for g, s, x, y in sets for v in op(set(x), set(y)))
    assert found(bitsets.members(a)) == plain(lambda x, y: x)
    assert found(bitsets.members(bitsets.union(a, b))) == plain(set.union)
    assert found(bitsets.members(bitsets.intersection(a, b))) == plain(set.intersection)
    assert found(bitsets.members(bitsets.difference(a, b))) == plain(set.difference)
    assert found(bitsets.sizes(a)) == sorted((g, s, len(x)) for g, s, x, _ in sets if x)
    assert {(r.complex_id, r.bucket) for r in bitsets.union_of_sets(a).collect()} == {(g, v // 64) for g, _, x, _ in sets for v in x}


@pytest.mark.parametrize("dense", [1, 8, 10**6])
@pytest.mark.parametrize("heavy", [3, 20_000])
def test_overlaps_by_words(spark, sets, dense, heavy):
    # one vertex that all have, and one complex without dense vertices
    rows = [(g, s, sorted({*a, 500} if g == 0 else {*a})) for g, s, a, _ in sets] + [(2, s, [s]) for s in range(20)]
    k = SimplicialComplex(spark.createDataFrame(rows, "complex_id long, sid long, members array<long>"))
    plain = sorted((g, i, j, len(set(x) & set(y))) for g, i, x in rows for h, j, y in rows if g == h and i < j and set(x) & set(y))
    assert found(bitsets.pairs_by_words(k, dense, heavy)) == plain == found(pairs.pairs(k))


def test_no_simplices_no_words(spark):
    k = SimplicialComplex(spark.createDataFrame([], "complex_id long, sid long, members array<long>"))
    assert bitsets.pairs_by_words(k).count() == bitsets.words(k.incidence()).count() == 0


@pytest.mark.parametrize("ranges", [1, 7])
def test_compressed_rows(spark, ranges):
    draw = random.Random(5)
    rows = [(g, draw.randint(0, 2), float(draw.randint(0, 5)), draw.choice([6.0, float("inf")]), sorted(draw.sample(range(50), draw.randint(0, 9)))) for g in (0, 1) for _ in range(150)]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "complex_id long, q int, birth double, death double, members array<long>")
    path = tempfile.mkdtemp(prefix="cliquora-tests-")
    compressed.write(df, f"{path}/one", ranges)
    intervals, members = compressed.read(spark, f"{path}/one")
    flat = {(r.complex_id, r.position): r.vertex for r in members.collect()}
    expected = []
    for g in (0, 1):
        own, at = sorted(r[1:] for r in rows if r[0] == g), 0
        for i, (q, birth, death, m) in enumerate(own):
            expected.append((g, i, q, birth, death, at, at + len(m)))
            assert [flat[g, p] for p in range(at, at + len(m))] == m
            at += len(m)
    assert found(intervals.select("complex_id", "i", "q", "birth", "death", "first", "last")) == expected and len(flat) == sum(len(r[4]) for r in rows)
    back = compressed.intervals(spark, f"{path}/one")
    assert found(back.drop("i", "size")) == sorted(rows)
    compressed.write(df.where("false"), f"{path}/none", ranges)
    assert compressed.intervals(spark, f"{path}/none").count() == 0


def test_fitted_pipeline_is_saved(spark):
    edges = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("a", 0, 2), ("b", 0, 1), ("b", 3, 4)], "complex_id string, u long, v long")
    path = tempfile.mkdtemp(prefix="cliquora-tests-")
    Pipeline(stages=[ml.GradedEstimator(metrics=["fsv", "ssv"], fill_value=-1.0)]).write().save(f"{path}/e")
    model = Pipeline.load(f"{path}/e").fit(edges)
    model.write().save(f"{path}/m")
    back = PipelineModel.load(f"{path}/m")
    told = ml.GradedParameters(metrics=["fsv", "ssv"], max_order=2, fill_value=-1.0, n_vertices=5)
    assert found(model.transform(edges)) == found(back.transform(edges)) == found(told.transform(edges))
    # a larger graph is cut, a graph without edges has the learned vertices
    other = spark.createDataFrame([("c", i, j) for i in range(4) for j in range(i)] + [("d", None, None)], "complex_id string, u long, v long")
    rows = found(back.transform(other))
    assert max(r[1] for r in rows) == 2 and ("d", 0, "fsv", 5.0) in rows and ("d", 1, "fsv", -1.0) in rows
    ml.SimplexProjection(q=2, weighted=True).write().save(f"{path}/s")
    assert ml.SimplexProjection.load(f"{path}/s").get("q") == 2


@pytest.mark.parametrize("name", "shared_faces_words served_overlaps vertex_words word_sets diagram_offsets diagram_members graded_fitted".split())
def test_query_equals_sql(spark, name):
    base = duckdb.connect()
    for t in TABLES:
        base.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, DATA)
    own = sorted(got.columns)
    sql = base.execute(catalog.ORACLES[name])
    order = [[c[0] for c in sql.description].index(c) for c in own]
    assert sorted(map(str, (tuple(r[i] for i in order) for r in sql.fetchall()))) == sorted(map(str, (tuple(r) for r in got.select(*own).collect())))
