"""Schemas and the wrapper around a table of simplices.

All tables carry `complex_id`, so that one complex and an ensemble of many are the same plan. Undefined values are NULL.

simplices  (complex_id, sid, members ARRAY<LONG>)    members sorted, distinct; may be empty (dim -1)
incidence  (complex_id, sid, vertex)
pairs      (complex_id, i, j, shared)                 i < j, shared = size of the intersection, at least 1
graph      edges (complex_id, u, v) with u < v, vertices (complex_id, vertex)
vectors    (complex_id, q, vector, value DOUBLE)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Short and full names of the graded vectors.
VECTORS = {
    "fsv": "First structure vector",
    "ssv": "Second structure vector",
    "tsv": "Third structure vector",
    "entropy": "Topological entropy",
    "simplices": "Simplex count",
    "faces": "Shared faces count",
}


def named_vectors(names=None, strict: bool = False) -> list[str]:
    """Short names of the wanted vectors: abbreviations in any case, full names as written, each once, in order.

    Unknown names are left out, or with strict raise a ValueError.
    """
    if names is None:
        return list(VECTORS)
    full = {v: k for k, v in VECTORS.items()}
    found = []
    for name in names:
        short = full.get(name) or (name.lower() if name.lower() in VECTORS else None)
        if short is None and strict:
            raise ValueError(f"unknown vector {name!r}")
        if short and short not in found:
            found.append(short)
    return found


@dataclass
class Report:
    """A full characterisation: graded vectors, vertex parameters (both DataFrames) and the order of each complex."""

    graded: DataFrame
    vertices: DataFrame
    order: DataFrame


class SimplicialComplex:
    """One or many complexes as a table of simplices, with the operators as methods."""

    def __init__(self, simplices: DataFrame):
        """simplices: (sid, members) or (complex_id, sid, members). Members are deduplicated within a simplex, simplices are not."""
        if "complex_id" not in simplices.columns:
            simplices = simplices.withColumn("complex_id", F.lit(0).cast("long"))
        self.simplices = simplices.select("complex_id", "sid", F.sort_array(F.array_distinct("members")).alias("members"))

    @classmethod
    def from_graph(cls, edges: DataFrame, vertices: DataFrame | None = None, by_graph: bool = False) -> SimplicialComplex:
        """The maximal cliques of a graph; isolated vertices are simplices of dimension 0. by_graph: one task searches a whole graph.

        They are searched once and written to the checkpoint folder: every vector reads them several times.
        """
        from cliquora.operators.cliques import maximal_cliques, numbered
        from cliquora.operators.durable import durable

        return cls(durable(numbered(maximal_cliques(edges, vertices, by_graph))))

    @classmethod
    def from_adjacency(cls, rows: DataFrame) -> SimplicialComplex:
        """rows (i, row ARRAY): any nonzero entry is an undirected edge."""
        from cliquora.sources.matrices import edges_of_adjacency, vertices_of_matrix

        return cls.from_graph(edges_of_adjacency(rows), vertices_of_matrix(rows))

    def incidence(self) -> DataFrame:
        return self.simplices.select("complex_id", "sid", F.explode("members").alias("vertex"))

    def dims(self) -> DataFrame:
        return self.simplices.select("complex_id", "sid", (F.size("members") - 1).alias("dim"))

    def __getattr__(self, name: str):
        """Operators of the vectors, pairs and components modules, applied to this complex."""
        from cliquora.operators import components, pairs, vectors

        for module in (vectors, pairs, components):
            operator = getattr(module, name, None)
            if callable(operator) and getattr(operator, "__module__", "") == module.__name__:
                return lambda *a, **k: operator(self, *a, **k)
        raise AttributeError(name)
