"""What a task holds does not grow with the input: rows are dealt to as many tasks as there are rows for."""

from pyspark.sql import functions as F

from cliquora import catalog
from cliquora.model import SimplicialComplex
from cliquora.operators import cliques, pairs
from cliquora.operators.durable import dealt
from cliquora.plans import views

SF = "/root/testdata/sf0.1"


def test_parts_go_by_the_rows(spark):
    rows = spark.range(250_000)
    assert dealt(rows, 250_000, "id").rdd.getNumPartitions() == 3 and dealt(rows.where("false"), 0, "id").count() == 0


def test_the_orders_words_are_dealt_by_the_lines(spark):
    """vertex_words: one exchange, of more parts than the session's four."""
    lines = views.read(spark, SF, "lineitem").count()
    assert catalog.QUERIES["vertex_words"](spark, SF).rdd.getNumPartitions() == 1 + lines // 100_000 > 4


def test_pairs_of_suppliers_are_dealt_by_the_lines(spark):
    """core_numbers, hub_cliques: orders by themselves, and pairs by their first supplier, ranks included."""
    plan = views.supplier_neighbours(spark, SF)._jdf.queryExecution().executedPlan().toString()
    lines = views.read(spark, SF, "lineitem").count()
    assert "hashpartitioning(o#" in plan and plan.count(f", {1 + lines // 100_000}), REPARTITION_BY_NUM") >= 2 and "hashpartitioning(u#" in plan


def test_roots_are_searched_in_several_tasks(spark):
    """hub_cliques, maximal_cliques: very many roots of few rows each."""
    edges = spark.range(5000).select(F.lit(0).cast("long").alias("complex_id"), F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    for hub in (0, 1000):
        found = cliques.maximal_cliques(edges, hub=hub).select("members", F.spark_partition_id().alias("part")).collect()
        assert sorted(tuple(r.members) for r in found) == [(i, i + 1) for i in range(5000)]
    rows = edges.select("complex_id", F.col("u").alias("v"))
    parts = cliques.of_roots(rows, edges).applyInPandas(lambda g: g, rows.schema).select(F.spark_partition_id()).distinct().count()
    assert parts == 3


def test_connectivity_counts_pairs_once(spark):
    k = SimplicialComplex(spark.createDataFrame([(0, [1, 2, 3]), (1, [2, 3]), (2, [3, 9]), (3, [7])], "sid long, members array<long>"))
    found = pairs.connectivity(k)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") == 1
    want = {(0, 1, 1), (0, 2, 0), (1, 2, 0)}
    assert sorted((r.i, r.j, r.value) for r in found.collect()) == sorted([*want, *((j, i, v) for i, j, v in want), (0, 0, 2), (1, 1, 1), (2, 2, 1), (3, 3, 0)])
