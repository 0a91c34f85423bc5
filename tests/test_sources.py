"""Readers, generators and the driver contract."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cliquora.model import SimplicialComplex
from cliquora.sources import datasets, generators, matrices

DATA = "/root/testdata/sf0.001"


def test_coauthors(spark, tmp_path):
    simplices, years = [[5, 3, 5], [1], [2, 9]], [2001, 1999, 2001]
    (tmp_path / "x-nverts.txt").write_text("".join(f"{len(s)}\n" for s in simplices))
    (tmp_path / "x-simplices.txt").write_text("".join(f"{v}\n" for s in simplices for v in s))
    (tmp_path / "x-times.txt").write_text("".join(f"{y}\n" for y in years))
    datasets.register("x", str(tmp_path), "x")
    got = sorted(map(tuple, datasets.load_dataset(spark, "x").collect()), key=lambda r: r[1])
    assert got == [(y, i, s) for i, (y, s) in enumerate(zip(years, simplices, strict=True))]
    k = SimplicialComplex(datasets.load_dataset(spark, "x").select("sid", F.col("vertices").alias("members")))
    assert {r.sid: r.dim for r in k.dims().collect()} == {0: 1, 1: 0, 2: 1}
    with pytest.raises(ValueError):
        datasets.load_dataset(spark, "y")


@pytest.mark.parametrize("block", ["128m", "200b"])
def test_coauthors_in_many_files(spark, tmp_path, block):
    """Folders of files that are read by ranges of bytes, against the lists that they were written from."""
    simplices = [[(7 * i + j) % 101 for j in range(i % 5)] for i in range(400)]
    years = [1950 + i % 60 for i in range(400)]
    texts = {"nverts": [len(x) for x in simplices], "simplices": [v for x in simplices for v in x], "times": years}
    for text, values in texts.items():
        folder, cuts = tmp_path / f"y-{text}.txt", [0, 3, 3, 50, 51, len(values)]
        folder.mkdir()
        names = [f"part-{i:05}-a.txt" for i in (0, 1, 2, 99999)] + ["part-100000-a.txt"]
        for own, start, end in zip(names, cuts, cuts[1:], strict=False):
            (folder / own).write_text("".join(f"{v}\n" for v in values[start:end]))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        datasets.register("many", str(tmp_path), "y")
        found = datasets.load_dataset(spark, "many").collect()
        parts = spark.read.text(str(tmp_path / "y-simplices.txt")).select("_metadata.file_path", "_metadata.file_block_start").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert sorted((r.sid, r.year, r.vertices) for r in found) == [(i, y, x) for i, (y, x) in enumerate(zip(years, simplices, strict=True))]
    assert parts > 8 if block == "200b" else parts == 4


def test_adjacency(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0, 0.0]), (1, [0.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0])], "i long, row array<double>")
    assert sorted(r.members for r in SimplicialComplex.from_adjacency(rows).simplices.collect()) == [[0, 1], [2]]
    ends = spark.createDataFrame([(1, 0), (0, 1), (2, 2)], "u long, v long")
    assert [tuple(r) for r in matrices.edges_of_pairs(ends).collect()] == [(0, 0, 1)]


def test_generators(spark):
    edges = generators.scale_free_graphs(spark, 30, 3, 4)
    assert {r["count"] for r in edges.groupBy("complex_id").count().collect()} == {27 * 3}
    assert sorted(edges.collect()) == sorted(generators.scale_free_graphs(spark, 30, 3, 4).collect())
    wanted = spark.createDataFrame([(0, [2, 2, 2, 1, 1]), (1, [3, 1]), (2, [1])], "complex_id long, degrees array<int>")
    got = generators.degree_graphs(wanted)
    degree = {}
    for r in got.where("complex_id = 0").collect():
        degree[r.u], degree[r.v] = degree.get(r.u, 0) + 1, degree.get(r.v, 0) + 1
    assert degree == {0: 2, 1: 2, 2: 2, 3: 1, 4: 1} and got.where("u is null").count() == 2


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["bundle", "ssv", "connectivity", "graph_components_capped", "persistence_capped", "consensus_vectors", "edge_cleaning", "coauthors"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in "nation customer supplier orders lineitem embeddings".split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = entry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    tidy = lambda rows: sorted([tuple(str(round(x, 6) + 0.0) if isinstance(x, float) else str(x) for x in r) for r in rows])
    want = con.execute(f"select {', '.join(columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert tidy(map(tuple, got.select(columns).collect())) == tidy(want)


def test_lines_of_one_number_go_by_supplier(spark, tmp_path):
    from cliquora.plans import views
    from cliquora.sources import datasets

    spark.createDataFrame([(1, 2, 9), (1, 1, 7), (1, 1, 3), (1, 1, 5)], "l_orderkey long, l_linenumber int, l_suppkey long").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("select 1L as o_orderkey, date'2020-01-01' as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    found = datasets.read_coauthors(spark, views.coauthor_files(spark, str(tmp_path)), "orders").collect()
    assert [list(r.vertices) for r in found] == [[3, 5, 7, 9]]
