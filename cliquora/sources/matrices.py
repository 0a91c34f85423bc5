"""Graphs from matrices (i, row ARRAY<DOUBLE>; optional complex_id) and from edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliquora.functions import finite, is_vertex_id


def keyed(df: DataFrame) -> DataFrame:
    return df if "complex_id" in df.columns else df.withColumn("complex_id", F.lit(0).cast("long"))


def cells(rows: DataFrame) -> DataFrame:
    return keyed(rows).select("complex_id", F.col("i").cast("long").alias("i"), F.posexplode("row").alias("j", "w")).withColumn("j", F.col("j").cast("long"))


def vertices_of_matrix(rows: DataFrame) -> DataFrame:
    return keyed(rows).select("complex_id", F.col("i").cast("long").alias("vertex"))


def edges_of_adjacency(rows: DataFrame) -> DataFrame:
    """Nonzero entries, either triangle; loops don't count."""
    return edges_of_pairs(cells(rows).where("w <> 0").select("complex_id", F.col("i").alias("u"), F.col("j").alias("v")))


def edges_of_pairs(pairs: DataFrame) -> DataFrame:
    """Distinct undirected edges u < v of any pairs (u, v)."""
    return keyed(pairs).where("u <> v").select("complex_id", F.least("u", "v").cast("long").alias("u"), F.greatest("u", "v").cast("long").alias("v")).distinct()


def edges_of_distances(rows: DataFrame) -> DataFrame:
    """The finite entries of the strict upper triangle. Rows that are not as long as the matrix is high raise an error."""
    sizes = keyed(rows).groupBy("complex_id").agg(F.count("*").alias("n"), F.min(F.size("row")).alias("low"), F.max(F.size("row")).alias("high"))
    if not sizes.where("low <> n or high <> n").isEmpty():
        raise ValueError("a distance matrix must be square")
    found = cells(rows).withColumn("w", F.col("w").cast("double"))
    return found.where((F.col("i") < F.col("j")) & finite(F.col("w"))).select("complex_id", F.col("i").alias("u"), F.col("j").alias("v"), "w")


def edges_of_rows(rows: DataFrame) -> DataFrame:
    """Weighted edges (u, v, w) of numbers; ids that are no whole numbers from 0 to 2**32 - 1 raise an error."""
    missing = {"u", "v", "w"} - set(rows.columns)
    if missing:
        raise ValueError(f"edge rows need u, v and w; missing: {sorted(missing)}")
    bad = ~F.coalesce(is_vertex_id(F.col("u")) & is_vertex_id(F.col("v")), F.lit(False))
    if not rows.where(bad).isEmpty():
        raise ValueError("vertex ids must be whole numbers from 0 to 4294967295")
    return keyed(rows).select("complex_id", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col("w").cast("double").alias("w"))


def clean_edges(edges: DataFrame) -> DataFrame:
    """Finite weights, no loops, u < v, of duplicates the least weight."""
    ends = F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
    return keyed(edges).where((F.col("u") != F.col("v")) & finite(F.col("w"))).groupBy("complex_id", *ends).agg(F.min(F.col("w") + 0.0).alias("w"))
