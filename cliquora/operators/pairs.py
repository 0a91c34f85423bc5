"""Pairs of simplices that share vertices, and what follows from the size of their intersection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliquora.operators.blocks import all_of, forest_of, met


def pairs(k, heavy: int | None = None) -> DataFrame:
    """(complex_id, i, j, shared) of all pairs of simplices that share a vertex; never all pairs of simplices.

    Blocks of simplices (of `heavy` each, by default blocks.BLOCK) meet where they share vertices, and a task counts all pairs of two blocks.
    """
    return met(k.simplices, all_of(1), heavy).select("complex_id", "i", "j", "shared")


def overlaps(k, least: int, heavy: int | None = None) -> DataFrame:
    """(complex_id, i, j, shared) of the pairs that share `least` vertices or more. The others don't leave the task that counts them.

    Simplices below `least` vertices are left out.
    """
    rows = k.simplices.where(F.size("members") >= least)
    return met(rows, all_of(max(1, least)), heavy).select("complex_id", "i", "j", "shared")


def forests(k, least: int = 1, heavy: int | None = None) -> DataFrame:
    """(complex_id, i, j, shared) of the pairs that keep simplices connected at every level, of those that share `least` vertices or more.

    A task leaves a spanning forest of the largest intersections of two blocks: fewer links than they have simplices.
    """
    rows = k.simplices.where(F.size("members") >= least)
    return met(rows, forest_of(least), heavy).select("complex_id", "i", "j", "shared")


def shared_faces(k, found: DataFrame | None = None) -> DataFrame:
    """(complex_id, q, value): pairs of simplices whose intersection has exactly q + 1 vertices, for q up to the order."""
    from cliquora.operators.vectors import levels

    found = pairs(k) if found is None else found
    found = found.groupBy("complex_id", (F.col("shared") - 1).cast("int").alias("q")).agg(F.count("*").alias("n"))
    return levels(k).join(found, ["complex_id", "q"], "left").select("complex_id", "q", F.coalesce("n", F.lit(0)).alias("value"))


def connectivity(k, dense: bool = False) -> DataFrame:
    """(complex_id, i, j, value): size of the intersection less one; the diagonal is the dimension.

    Disjoint pairs (-1) are rows only if dense, which is the square of the number of simplices.
    """
    ends = F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("x")
    both = pairs(k).select("complex_id", ends, (F.col("shared") - 1).alias("value")).select("complex_id", "x.i", "x.j", "value")  # pairs are counted once
    diagonal = k.dims().select("complex_id", F.col("sid").alias("i"), F.col("sid").alias("j"), F.col("dim").cast("long").alias("value"))
    found = both.unionByName(diagonal)
    if not dense:
        return found
    ids = k.simplices.select("complex_id", F.col("sid").alias("i"))
    return ids.join(ids.withColumnRenamed("i", "j"), "complex_id").join(found, ["complex_id", "i", "j"], "left").select("complex_id", "i", "j", F.coalesce("value", F.lit(-1)).alias("value"))


def eccentricity(k) -> DataFrame:
    """(complex_id, i, j, value): the share of i outside j, of pairs that intersect, both ways. Disjoint pairs have 1."""
    found = met(k.simplices, all_of(1))
    ends = F.explode(F.array(F.struct("i", "j", F.col("size_i").alias("n")), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col("size_j").alias("n")))).alias("x")
    both = found.select("complex_id", "shared", ends)
    return both.select("complex_id", "x.i", "x.j", (1 - F.col("shared") / F.col("x.n")).alias("value"))


def family_eccentricity(k) -> DataFrame:
    """(complex_id, sid, value): the least eccentricity of each simplex to any other; NULL for empty and for single simplices."""
    near = eccentricity(k).groupBy("complex_id", F.col("i").alias("sid")).agg(F.min("value").alias("least"))
    n = k.simplices.groupBy("complex_id").agg(F.count("*").alias("n"))
    rows = k.simplices.select("complex_id", "sid", F.size("members").alias("size")).join(n, "complex_id").join(near, ["complex_id", "sid"], "left")
    return rows.select("complex_id", "sid", F.when((F.col("n") > 1) & (F.col("size") > 0), F.coalesce("least", F.lit(1.0))).alias("value"))


def simplex_column(k, simplex) -> Column:
    """A simplex given as an index of the first complex or as a set of vertices, as an array column."""
    if isinstance(simplex, bool) or not isinstance(simplex, (int, set, frozenset)):
        raise TypeError("a simplex is an index or a set of vertices")
    if isinstance(simplex, int):
        row = k.simplices.where(F.col("sid") == simplex).select("members").first()
        if row is None:
            raise IndexError(f"no simplex {simplex}")
        simplex = row.members
    return F.array(*[F.lit(v).cast("long") for v in sorted(simplex)]).cast("array<bigint>")


def eccentricity_of(k, simplex, family=None) -> DataFrame:
    """(value): the least eccentricity of one simplex to the family's simplices.

    family: sids; None takes all of them, but for the simplex itself where it is given by its index.
    """
    from cliquora.functions import eccentricity as one

    rows = k.simplices
    if family is not None:
        rows = rows.where(F.col("sid").isin([int(x) for x in family]))
    elif isinstance(simplex, int):
        rows = rows.where(F.col("sid") != simplex)
    return rows.agg(F.min(one(simplex_column(k, simplex), F.col("members"))).alias("value"))
