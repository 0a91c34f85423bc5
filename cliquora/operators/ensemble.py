"""Many graphs at once: projections, clique filters, consensus graphs, differences of their vectors, permutation tests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cliquora.model import SimplicialComplex
from cliquora.operators.durable import durable
from cliquora.operators.vectors import graded, padded


def projection(k, q: int = 0, weighted: bool = False) -> DataFrame:
    """(complex_id, u, v, value), u < v: vertex pairs within a simplex of dimension q or more; 1, or in how many."""
    a = k.simplices.where(F.size("members") > q).select("complex_id", F.posexplode("members").alias("at", "u"), "members")
    both = a.select("complex_id", "u", F.explode(F.expr("slice(members, at + 2, size(members))")).alias("v"))
    n = both.groupBy("complex_id", "u", "v").agg(F.count("*").alias("value"))
    return n if weighted else n.withColumn("value", F.lit(1).cast("long"))


def dense_projection(k, q: int = 0, weighted: bool = False) -> DataFrame:
    """(complex_id, i, j, value), both triangles, of the pairs that are not 0; the matrix has one row more than the largest vertex of all complexes."""
    p = projection(k, q, weighted)
    return p.select("complex_id", F.col("u").alias("i"), F.col("v").alias("j"), "value").unionByName(p.select("complex_id", F.col("v").alias("i"), F.col("u").alias("j"), "value"))


def projection_rows(k, q: int = 0, weighted: bool = False) -> DataFrame:
    """(complex_id, i, row ARRAY): the dense matrix of each complex, all as large as the largest vertex of any asks for."""
    n = k.incidence().agg((F.coalesce(F.max("vertex"), F.lit(-1)) + 1).alias("n")).first().n
    cells = dense_projection(k, q, weighted).groupBy("complex_id", "i").agg(F.map_from_entries(F.collect_list(F.struct("j", "value"))).alias("at"))
    places = F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")) if n else F.array().cast("array<bigint>")
    every = k.simplices.select("complex_id").distinct().select("complex_id", F.explode(places).alias("i"))
    row = F.transform(places, lambda j: F.coalesce(F.try_element_at("at", j), F.lit(0).cast("long")))
    return every.join(cells, ["complex_id", "i"], "left").select("complex_id", "i", row.alias("row"))


def clique_filter(edges: DataFrame, q: int, threshold: Callable[[DataFrame], DataFrame] | Column | None = None) -> DataFrame:
    """The weighted edges that lie in a maximal clique of dimension q or more, with their weights.

    threshold (a DataFrame function or a condition) chooses the edges for the clique search only.
    """
    searched = edges if threshold is None else threshold(edges) if callable(threshold) and not isinstance(threshold, Column) else edges.where(threshold)
    k = SimplicialComplex.from_graph(searched.select("complex_id", "u", "v"))
    return edges.join(projection(k, q).drop("value"), ["complex_id", "u", "v"], "left_semi")


def consensus(edges: DataFrame, samples: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(grp, u, v): edges (grp, sample, u, v) that more than the threshold's share of a group's samples has.

    samples (grp, n): how many there are, with or without edges.
    """
    n = edges.select("grp", "sample", "u", "v").distinct().groupBy("grp", "u", "v").agg(F.count("*").alias("has"))
    return n.join(samples, "grp").where(F.col("has") / F.col("n") > threshold).select("grp", "u", "v")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(q, vector, value): vectors a - b; what one of them lacks or leaves undefined makes 0."""
    both = a.select("q", "vector", F.col("value").alias("a")).join(b.select("q", "vector", F.col("value").alias("b")), ["q", "vector"], "full")
    return both.select("q", "vector", F.coalesce(F.col("a") - F.col("b"), F.lit(0.0)).alias("value"))


def consensus_vectors(edges: DataFrame, vertices: DataFrame, samples: DataFrame, threshold: float = 0.95, names=None) -> DataFrame:
    """(complex_id = grp, q, vector, value) of the groups' consensus graphs over the same vertices (grp, vertex)."""
    agreed = consensus(edges, samples, threshold).withColumnRenamed("grp", "complex_id")
    return graded(SimplicialComplex.from_graph(agreed, vertices.withColumnRenamed("grp", "complex_id")), names)


def consensus_statistic(edges: DataFrame, vertices: DataFrame, samples: DataFrame, first, second, threshold: float = 0.95, names=None) -> DataFrame:
    """(q, vector, value): the first group's vectors less the second's."""
    found = padded(consensus_vectors(edges, vertices, samples, threshold, names))
    return difference(found.where(F.col("complex_id") == first), found.where(F.col("complex_id") == second))


def shuffled(samples: DataFrame, n_resamples: int, seed: int = 0) -> DataFrame:
    """(resample, sample_id, grp): group labels dealt anew, as many of each as there are; a hash orders each resample.

    samples (sample_id, grp): one row a graph. Resample 0 has the labels as they are.
    """
    labels = samples.select("grp", F.row_number().over(W.orderBy("grp", "sample_id")).alias("place"))
    every = samples.select("sample_id", F.explode(F.sequence(F.lit(1), F.lit(n_resamples))).alias("resample"))
    order = W.partitionBy("resample").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("resample").cast("string"), F.col("sample_id").cast("string"))), "sample_id")
    dealt = every.withColumn("place", F.row_number().over(order)).join(labels, "place").select("resample", "sample_id", "grp")
    return samples.select(F.lit(0).alias("resample"), "sample_id", "grp").unionByName(dealt)


def permutation_test(edges: DataFrame, vertices: DataFrame, samples: DataFrame, first, second, n_resamples: int = 10_000, threshold: float = 0.95, names=None, seed: int = 0) -> DataFrame:
    """(q, vector, value, p_value): the consensus statistic and its two-sided p-value under exchanged labels.

    edges (sample_id, u, v), vertices (vertex), samples (sample_id, grp). All resamples are one plan. A group's consensus depends on
    which samples it has, so that each distinct set of samples (a team) is one complex, however many resamples deal it: with n
    samples a group there are at most C(2n, n) of them. Two-sided as twice the smaller tail, with the observed one counted, at most
    1; values that differ by 1e-9 or less are equal.
    """
    dealt = shuffled(samples, n_resamples, seed)
    teams = dealt.groupBy("resample", "grp").agg(F.sort_array(F.collect_list("sample_id")).alias("own"))
    teams = durable(teams.select("resample", "grp", "own", F.md5(F.concat_ws("\x1f", "own")).alias("team")))
    distinct = durable(teams.select("team", "own").dropDuplicates(["team"]))
    has = distinct.select(F.col("team").alias("grp"), F.explode("own").alias("sample_id")).join(edges, "sample_id").select("grp", F.col("sample_id").alias("sample"), "u", "v")
    rows = consensus(has, distinct.select(F.col("team").alias("grp"), F.size("own").alias("n")), threshold).withColumnRenamed("grp", "complex_id")
    sites = vertices.agg(F.collect_set("vertex").alias("all"))  # one row, as long as the graphs have vertices
    sites = distinct.select(F.col("team").alias("complex_id")).join(F.broadcast(sites)).select("complex_id", F.explode("all").alias("vertex"))
    found = durable(padded(graded(SimplicialComplex.from_graph(rows, sites, by_graph=True), names)))
    sign = F.when(F.col("grp") == str(first), 1.0).when(F.col("grp") == str(second), -1.0)
    both = teams.select("resample", F.col("grp").cast("string").alias("grp"), F.col("team").alias("complex_id")).join(found, "complex_id")
    # a value that is undefined in either group makes the difference 0
    stat = both.groupBy("resample", "q", "vector").agg(F.when(F.count("value") == 2, F.sum(sign * F.col("value"))).otherwise(0.0).alias("value"))
    seen = stat.where("resample = 0").select("q", "vector", F.col("value").alias("observed"))
    tails = stat.join(seen, ["q", "vector"]).groupBy("q", "vector", "observed").agg(
        F.count_if((F.col("resample") > 0) & (F.col("value") >= F.col("observed") - 1e-9)).alias("above"),
        F.count_if((F.col("resample") > 0) & (F.col("value") <= F.col("observed") + 1e-9)).alias("below"))
    p = F.least(F.lit(1.0), 2 * (F.least("above", "below") + 1) / (n_resamples + 1))
    return tails.select("q", "vector", F.col("observed").alias("value"), p.alias("p_value"))


def median_panel(vectors: DataFrame, hue: str = "grp") -> DataFrame:
    """(vector, q, hue, value): the medians that a point plot with one panel for each vector shows."""
    return vectors.groupBy("vector", "q", hue).agg(F.median("value").alias("value"))


def starred(p_values: DataFrame, level: float = 0.05) -> DataFrame:
    """The (q, vector) whose p-value is below the level."""
    return p_values.where(F.col("p_value") < level).select("q", "vector")
