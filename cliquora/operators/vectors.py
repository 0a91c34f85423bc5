"""Structure vectors, occupation, entropy and the bundles of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cliquora.model import Report, SimplicialComplex, named_vectors
from cliquora.operators.components import merges
from cliquora.operators.durable import durable
from cliquora.operators.pairs import forests, pairs, shared_faces

AT = ["complex_id", "q"]


def order(k) -> DataFrame:
    """(complex_id, value): the largest dimension; -1 without simplices in a complex that has only empty ones."""
    return k.dims().groupBy("complex_id").agg(F.coalesce(F.max("dim"), F.lit(-1)).alias("value"))


def levels(k) -> DataFrame:
    """(complex_id, q) for q from 0 to the order."""
    return order(k).where("value >= 0").select("complex_id", F.explode(F.sequence(F.lit(0), F.col("value"))).alias("q"))


def at_least(df: DataFrame) -> DataFrame:
    """value at each q -> the sum of the values from q up."""
    w = W.partitionBy("complex_id").orderBy(F.col("q").desc()).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("value", F.sum("value").over(w))


def simplex_count(k) -> DataFrame:
    """(complex_id, q, value): simplices of dimension q; levels without any have 0."""
    n = k.dims().groupBy("complex_id", F.col("dim").alias("q")).agg(F.count("*").alias("n"))
    return levels(k).join(n, AT, "left").select(*AT, F.coalesce("n", F.lit(0)).alias("value"))


def second_structure_vector(k) -> DataFrame:
    """Simplices of dimension q or more."""
    return at_least(simplex_count(k))


def _merges(k, found: DataFrame | None = None) -> DataFrame:
    """Links of the spanning forest that hold at q: each makes one component less."""
    n = merges(forests(k) if found is None else found)
    return at_least(levels(k).join(n, AT, "left").select(*AT, F.coalesce("n", F.lit(0)).alias("value")))


def _structure(k, found: DataFrame | None = None) -> DataFrame:
    """(complex_id, q, simplices, ssv, fsv, tsv): one spanning forest answers all."""
    count = simplex_count(k).withColumnRenamed("value", "simplices")
    w = W.partitionBy("complex_id").orderBy(F.col("q").desc()).rowsBetween(W.unboundedPreceding, 0)
    rows = count.join(_merges(k, found).withColumnRenamed("value", "merged"), AT).withColumn("ssv", F.sum("simplices").over(w))
    rows = rows.withColumn("fsv", F.col("ssv") - F.col("merged"))
    return rows.select(*AT, "simplices", "ssv", "fsv", F.when(F.col("ssv") == 0, 0.0).otherwise(1 - F.col("fsv") / F.col("ssv")).alias("tsv"))


def first_structure_vector(k) -> DataFrame:
    """Components at q."""
    return _structure(k).select(*AT, F.col("fsv").alias("value"))


def third_structure_vector(k) -> DataFrame:
    """1 - components / simplices of dimension q or more."""
    return _structure(k).select(*AT, F.col("tsv").alias("value"))


def occupation(k, q: int | None = None) -> DataFrame:
    """(complex_id, q, vertex, value): simplices of dimension exactly q that have the vertex; absent vertices have no row."""
    rows = k.simplices.select("complex_id", (F.size("members") - 1).alias("q"), F.explode("members").alias("vertex"))
    rows = rows if q is None else rows.where(F.col("q") == q)
    return rows.groupBy(*AT, "vertex").agg(F.count("*").alias("value"))


def occupation_array(k, q: int) -> DataFrame:
    """(complex_id, vertex, value) for every vertex from 0 to the largest, with zeros."""
    n = k.incidence().groupBy("complex_id").agg(F.max("vertex").alias("last"))
    every = n.select("complex_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("vertex"))
    return every.join(occupation(k, q).drop("q"), ["complex_id", "vertex"], "left").select("complex_id", "vertex", F.coalesce("value", F.lit(0)).alias("value"))


def occupation_probability(k, q: int | None = None) -> DataFrame:
    n = occupation(k, q)
    return n.select(*AT, "vertex", (F.col("value") / F.sum("value").over(W.partitionBy(*AT))).alias("value"))


def entropy(k) -> DataFrame:
    """(complex_id, q, value): entropy of the occupation over that of an even one; NULL for one occupied vertex or none."""
    p = occupation_probability(k)
    e = p.groupBy(*AT).agg(F.count("*").alias("n"), (-F.sum(F.col("value") * F.log10("value"))).alias("h"))
    return levels(k).join(e, AT, "left").select(*AT, F.when(F.col("n") > 1, F.col("h") / F.log10("n")).alias("value"))


def dimensionality(k) -> DataFrame:
    """(complex_id, vertex, value): simplices that have the vertex."""
    return k.incidence().groupBy("complex_id", "vertex").agg(F.count("*").alias("value"))


def upper_skeleton(k, q: int) -> SimplicialComplex:
    """The simplices of dimension q or more, under their own ids."""
    return SimplicialComplex(k.simplices.where(F.size("members") > q))


def incidence_matrix(k, vertices: list[int]) -> DataFrame:
    """(complex_id, sid, one 0/1 column for each vertex)."""
    return k.incidence().groupBy("complex_id", "sid").pivot("vertex", vertices).agg(F.lit(1)).fillna(0)


def counts(k) -> DataFrame:
    """(complex_id, num_simplices, num_vertices): vertices are counted up to the largest id."""
    n = k.simplices.groupBy("complex_id").agg(F.count("*").alias("num_simplices"), F.max(F.array_max("members")).alias("last"))
    return n.select("complex_id", "num_simplices", (F.coalesce("last", F.lit(-1)) + 1).alias("num_vertices"))


def vertices(k) -> DataFrame:
    return k.incidence().select("complex_id", "vertex").distinct()


def graded(k, names=None, strict: bool = False) -> DataFrame:
    """(complex_id, q, vector, value) of the wanted vectors; only their branches are in the plan."""
    wanted = named_vectors(names, strict)

    parts = []
    own = [n for n in wanted if n in ("simplices", "ssv", "fsv", "tsv")]
    found = durable(pairs(k)) if {"fsv", "tsv", "faces"} & set(wanted) else None
    if {"fsv", "tsv"} & set(own):
        rows = _structure(k, found)
    elif own:
        rows = simplex_count(k).withColumnRenamed("value", "simplices").join(second_structure_vector(k).withColumnRenamed("value", "ssv"), AT)
    if own:
        stacked = F.array(*[F.struct(F.lit(n).alias("vector"), F.col(n).cast("double").alias("value")) for n in own])
        parts.append(rows.select(*AT, F.explode(stacked).alias("x")).select(*AT, "x.*"))
    if "faces" in wanted:
        parts.append(shared_faces(k, found).select(*AT, F.lit("faces").alias("vector"), F.col("value").cast("double").alias("value")))
    if "entropy" in wanted:
        parts.append(entropy(k).select(*AT, F.lit("entropy").alias("vector"), "value"))
    if not parts:
        return levels(k).where("false").select(*AT, F.lit("").alias("vector"), F.lit(0.0).alias("value"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def full_characterisation(k) -> Report:
    return Report(graded(k), dimensionality(k), order(k))


def value_at(vectors: DataFrame, q: int, vector: str | None = None) -> DataFrame:
    """The rows of one q; IndexError where there is none."""
    rows = vectors.where(F.col("q") == q)
    rows = rows if vector is None else rows.where(F.col("vector") == vector)
    if q < 0 or rows.isEmpty():
        raise IndexError(f"no level {q}")
    return rows


def named(vectors: DataFrame, vector: str) -> DataFrame:
    """The rows of one vector; KeyError where there is none."""
    rows = vectors.where(F.col("vector") == vector)
    if rows.isEmpty():
        raise KeyError(vector)
    return rows


def padded(vectors: DataFrame, max_order: int | None = None, fill: float | None = None) -> DataFrame:
    """Every vector from q = 0 to max_order (by default the largest q of any), cut or filled."""
    if max_order is None:
        max_order = vectors.agg(F.max("q")).first()[0]  # one number
        if max_order is None:
            return vectors.select("complex_id", "q", "vector", "value")
    every = vectors.select("complex_id", "vector").distinct().withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(max_order))))
    out = every.join(vectors, ["complex_id", "vector", "q"], "left")
    return out.select("complex_id", "q", "vector", F.coalesce("value", F.lit(fill).cast("double")).alias("value"))


def wide(vectors: DataFrame, names=None) -> DataFrame:
    return vectors.groupBy(*AT).pivot("vector", named_vectors(names)).agg(F.first("value"))


def long(table: DataFrame, names=None) -> DataFrame:
    return table.unpivot(AT, named_vectors(names), "vector", "value")


def flattened(vectors: DataFrame) -> DataFrame:
    """(complex_id, features ARRAY): values by q and vector."""
    return vectors.groupBy("complex_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("q", "vector", "value"))), lambda x: x["value"]).alias("features"))
