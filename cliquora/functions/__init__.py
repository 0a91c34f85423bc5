"""Column functions on sorted vertex arrays (sets)."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(w: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return w.isNotNull() & ~F.isnan(w) & (F.abs(w) != float("inf"))


def intersection(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_intersect(a, b))


def difference(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_except(a, b))


def union(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_union(a, b))


def union_of_rows(members: Column) -> Column:
    """Aggregate: the union of all rows' sets."""
    return F.sort_array(F.array_distinct(F.flatten(F.collect_list(members))))


def with_member(a: Column, x: Column) -> Column:
    return F.sort_array(F.array_distinct(F.array_append(a, x)))


def without_member(a: Column, x: Column) -> Column:
    return F.array_remove(a, x)


def shared_face_dim(a: Column, b: Column) -> Column:
    """Size of the intersection, less one."""
    return F.size(F.array_intersect(a, b)) - 1


def eccentricity(a: Column, b: Column) -> Column:
    """The share of a that lies outside b; NULL for an empty a."""
    return F.when(F.size(a) > 0, F.size(F.array_except(a, b)) / F.size(a))


def faces(members: Column) -> Column:
    """All subsets with one member less; none of an empty set, the empty one of a singleton is left out."""
    drop = lambda i: F.concat(F.slice(members, 1, i - 1), F.slice(members, i + 1, F.size(members)))
    return F.when(F.size(members) > 1, F.transform(F.sequence(F.lit(1), F.size(members)), drop)).otherwise(F.array().cast("array<array<bigint>>"))


def subsets(members: Column, k: int) -> Column:
    """All subsets of k members; none for k below 1 or above the size."""
    if k < 1:
        return F.array().cast("array<array<bigint>>")
    start = F.array(F.array().cast("array<bigint>"))
    grown = F.aggregate(members, start, lambda acc, x: F.concat(acc, F.transform(F.filter(acc, lambda s: F.size(s) < k), lambda s: F.array_append(s, x))))
    return F.filter(grown, lambda s: F.size(s) == k)


def is_vertex_id(x: Column) -> Column:
    """A whole number from 0 to the largest unsigned 32-bit one."""
    return (x == F.floor(x)) & x.between(0, 4294967295)
