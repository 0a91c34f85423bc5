"""The registered queries of the engine's own operators, each over whole tables, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliquora import functions, ml
from cliquora.model import SimplicialComplex
from cliquora.operators import bitsets, cliques, components, ensemble, pairs, persistence, vectors
from cliquora.operators.durable import shared_folder
from cliquora.plans import views
from cliquora.plans.oracles import ORACLES
from cliquora.sources import compressed, datasets, generators, matrices

joined = lambda c: F.array_join(c, " ")
digits = lambda df, n=6: df.withColumn("value", F.round("value", n))


def on_orders(operator):
    return lambda s, d: operator(views.orders_complex(s, d)).drop("complex_id")


def on_suppliers(operator):
    return lambda s, d: operator(views.suppliers_complex(s, d)).drop("complex_id")


def on_nations(operator):
    return lambda s, d: operator(views.nation_complex(s, d)).drop("complex_id")


def full(k) -> DataFrame:
    r = vectors.full_characterisation(k)
    graded = r.graded.select(F.lit("graded").alias("kind"), F.col("q").cast("long").alias("at"), F.col("vector").alias("name"), F.round("value", 6).alias("value"))
    vertex = r.vertices.select(F.lit("vertex").alias("kind"), F.col("vertex").alias("at"), F.lit("dimensionality").alias("name"), F.col("value").cast("double").alias("value"))
    order = r.order.select(F.lit("order").alias("kind"), F.lit(0).cast("long").alias("at"), F.lit("order").alias("name"), F.col("value").cast("double").alias("value"))
    return graded.unionByName(vertex).unionByName(order)


def diagram(found: DataFrame) -> DataFrame:
    return found.select("q", "birth", "death", "size", joined("members").alias("members"))


def edge_of_first(s, d) -> DataFrame:
    """The maximal cliques through the graph's first edge."""
    edges = views.nation_graph(s, d).select("complex_id", "u", "v")
    first = edges.orderBy("u", "v").first()
    found = cliques.maximal_cliques(edges, views.nation_vertices(s, d))
    return (found.where("false") if first is None else cliques.edge_cliques(found, first.u, first.v)).select(joined("members").alias("members"))


def sample_counts(s, d) -> DataFrame:
    return views.samples(s, d).groupBy("grp").agg(F.count("*").alias("n"))


def group_vertices(s, d) -> DataFrame:
    groups = s.createDataFrame([("kept",), ("returned",)], "grp string").withColumn("complex_id", views.zero())
    return groups.join(views.nation_vertices(s, d), "complex_id").select("grp", "vertex")


def sample_vectors(s, d) -> DataFrame:
    name = F.concat_ws(" ", "grp", "sample").alias("complex_id")
    edges = views.yearly(s, d).select(name, "u", "v")
    vertices = edges.select("complex_id").distinct().withColumn("zero", F.lit(0).cast("long")).join(views.nation_vertices(s, d).withColumnRenamed("complex_id", "zero"), "zero").select("complex_id", "vertex")
    return vectors.graded(SimplicialComplex.from_graph(edges, vertices))


def permutation(s, d) -> DataFrame:
    """The difference of the groups' consensus vectors under 10 000 exchanges of the labels."""
    name = F.concat_ws(" ", "grp", "sample").alias("sample_id")
    edges = views.yearly(s, d).select(name, "u", "v")
    samples = views.samples(s, d).select(name, "grp")
    found = ensemble.permutation_test(edges, views.nation_vertices(s, d).select("vertex"), samples, "kept", "returned")
    return digits(found).withColumn("p_value", F.round("p_value", 9))


def coauthors(s, d) -> DataFrame:
    rows = datasets.read_coauthors(s, views.coauthor_files(s, d), "orders")
    return rows.select("year", "sid", joined("vertices").alias("vertices")).orderBy("year", "sid")


def scale_free(s, d) -> DataFrame:
    """Of seeded graphs what holds whatever the seed: edges, vertices, and that each newcomer brings m edges."""
    n, m = 60, 3
    edges = generators.scale_free_graphs(s, n, m, 20)
    newcomers = edges.groupBy("complex_id", "v").agg(F.count("*").alias("n")).groupBy("complex_id").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    ends = edges.select("complex_id", F.explode(F.array("u", "v")).alias("x")).groupBy("complex_id").agg(F.count_distinct("x").alias("vertices"), F.expr("count(*) div 2").alias("edges"))
    return ends.join(newcomers, "complex_id")


def degree_graph(s, d) -> DataFrame:
    """The degrees of a graph made from the nation graph's degrees: the same."""
    both = cliques.both_ways(views.nation_graph(s, d))
    n = views.nation_vertices(s, d).join(both.groupBy(F.col("v").alias("vertex")).agg(F.count("*").alias("n")), "vertex", "left")
    degrees = n.groupBy("complex_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("vertex", F.coalesce("n", F.lit(0)).alias("n")))), lambda x: x["n"]).alias("degrees"))
    made = cliques.both_ways(generators.degree_graphs(degrees))
    return made.groupBy(F.col("v").alias("vertex")).agg(F.count_distinct("n").alias("degree"))


def set_functions(s, d) -> DataFrame:
    """Each order's suppliers with and without the first three suppliers, by the functions on sets."""
    k = views.orders_complex(s, d).simplices
    some = F.array(*[F.lit(x).cast("long") for x in (1, 2, 3)])
    m = F.col("members")
    return k.select("sid", joined(functions.difference(m, some)).alias("less"), joined(functions.union(m, some)).alias("more"), joined(functions.intersection(m, some)).alias("both"),
                    joined(functions.with_member(m, F.lit(0).cast("long"))).alias("with_zero"), joined(functions.without_member(m, F.array_min(m))).alias("without_first"),
                    functions.shared_face_dim(m, some).cast("long").alias("face"), F.round(functions.eccentricity(m, some), 6).alias("value"),
                    F.size(functions.faces(m)).cast("long").alias("n_faces"), F.size(functions.subsets(m, 3)).cast("long").alias("n_triples"))


def vertex_ids(s, d) -> DataFrame:
    """How many prices are whole numbers that could be vertex ids."""
    own = functions.is_vertex_id(F.col("l_extendedprice")).alias("is_id")
    return views.read(s, d, "lineitem").select(own).groupBy("is_id").agg(F.count("*").alias("n"))


def dataset_of_samples(s, d) -> DataFrame:
    return views.yearly(s, d).select(F.concat_ws(" ", "grp", "sample").alias("complex_id"), "u", "v")


def union_of_stars(s, d) -> DataFrame:
    k = views.star_complexes(s, d).simplices
    return k.groupBy("complex_id").agg(joined(functions.union_of_rows(F.col("members"))).alias("members"))


def word_sets(s, d) -> DataFrame:
    """Each supplier's parts that were returned (a) and not (b), as words: sizes of what both, either and the first alone have."""
    a, b = (bitsets.words(views.delivered(s, d, x)) for x in (True, False))
    sizes = lambda found, name: bitsets.sizes(found).select("sid", F.lit(name).alias("op"), "value")
    return sizes(bitsets.intersection(a, b), "both").unionByName(sizes(bitsets.union(a, b), "either")).unionByName(sizes(bitsets.difference(a, b), "returned"))


def graded_fitted(s, d) -> DataFrame:
    """The samples' vectors by a pipeline that learned order and vertices from all of them, was saved and loaded again."""
    samples = dataset_of_samples(s, d)
    folder = f"{shared_folder(samples)}/fitted-{uuid.uuid4().hex}"
    Pipeline(stages=[ml.GradedEstimator(metrics=["fsv", "ssv", "entropy"], fill_value=-1.0)]).fit(samples).write().save(folder)
    return digits(PipelineModel.load(folder).transform(samples))


QUERIES = {
    "bundle": on_nations(lambda k: digits(vectors.graded(k))),
    "simplex_count": on_orders(vectors.simplex_count),
    "ssv": on_orders(vectors.second_structure_vector),
    "order": on_orders(vectors.order),
    "counts": on_orders(vectors.counts),
    "vertices": on_orders(vectors.vertices),
    "dims": on_orders(lambda k: k.dims()),
    "occupation": on_orders(vectors.occupation),
    "occupation_probability": on_orders(lambda k: digits(vectors.occupation_probability(k), 9)),
    "entropy": on_orders(lambda k: digits(vectors.entropy(k))),
    "dimensionality": on_orders(vectors.dimensionality),
    "skeleton": on_orders(lambda k: vectors.upper_skeleton(k, 3).simplices.select("complex_id", "sid", joined("members").alias("members"))),
    "incidence": on_orders(lambda k: k.incidence()),
    "incidence_matrix": on_nations(lambda k: vectors.incidence_matrix(k, list(range(25))).withColumnsRenamed({str(v): f"v{v}" for v in range(25)})),
    "shared_faces": on_suppliers(pairs.shared_faces),
    "overlaps": on_suppliers(lambda k: pairs.overlaps(k, 3)),
    "shared_faces_words": on_suppliers(lambda k: pairs.shared_faces(k, bitsets.pairs_by_words(k))),
    "served_overlaps": lambda s, d: bitsets.pairs_by_words(views.served_complex(s, d)).drop("complex_id"),
    "vertex_words": on_orders(lambda k: bitsets.words(k.incidence())),
    "word_sets": word_sets,
    "connectivity": on_suppliers(pairs.connectivity),
    "connectivity_dense": on_nations(lambda k: pairs.connectivity(k, dense=True)),
    "eccentricity": on_suppliers(lambda k: digits(pairs.eccentricity(k))),
    "family_eccentricity": on_suppliers(lambda k: digits(pairs.family_eccentricity(k))),
    "maximal_cliques": lambda s, d: cliques.maximal_cliques(views.nation_graph(s, d).select("complex_id", "u", "v"), views.nation_vertices(s, d)).select(joined("members").alias("members"), F.size("members").alias("size")),
    "core_numbers": lambda s, d: cliques.core_numbers(views.supplier_neighbours(s, d)).drop("complex_id"),
    "hub_cliques": lambda s, d: cliques.maximal_cliques(views.supplier_neighbours(s, d), hub=0).select(joined("members").alias("members"), F.size("members").alias("size")),
    "k_cliques": lambda s, d: cliques.k_cliques(views.nation_graph(s, d).select("complex_id", "u", "v"), 5).select(joined("members").alias("members"), "size"),
    "edge_cliques": edge_of_first,
    "components": on_nations(components.q_components),
    "fsv": on_nations(vectors.first_structure_vector),
    "tsv": on_nations(lambda k: digits(vectors.third_structure_vector(k))),
    "full_characterisation": lambda s, d: full(views.nation_complex(s, d)),
    "graph_components": lambda s, d: components.graph_components(views.nation_graph(s, d).select("complex_id", "u", "v"), views.nation_vertices(s, d)).select("q", joined("vertices").alias("vertices")),
    "graph_components_capped": lambda s, d: components.graph_components(views.nation_graph(s, d).select("complex_id", "u", "v"), views.nation_vertices(s, d), 3).select("q", joined("vertices").alias("vertices")),
    "projection": on_nations(lambda k: ensemble.projection(k, 2)),
    "projection_weighted": on_nations(lambda k: ensemble.projection(k, 2, weighted=True)),
    "clique_filter": lambda s, d: ensemble.clique_filter(views.nation_graph(s, d), 4).drop("complex_id"),
    "edge_cleaning": lambda s, d: matrices.clean_edges(views.read(s, d, "lineitem").select(F.col("l_suppkey").cast("long").alias("u"), F.col("l_partkey").cast("long").alias("v"), F.col("l_extendedprice").cast("double").alias("w"))).drop("complex_id"),
    "persistence": lambda s, d: diagram(persistence.persistent_communities(views.region_distances(s, d))),
    "persistence_capped": lambda s, d: diagram(persistence.persistent_communities(views.nation_distances(s, d), 1)),
    "persistence_q0": lambda s, d: diagram(persistence.persistent_communities(views.nation_distances(s, d), 0)),
    "persistence_matrix": lambda s, d: diagram(persistence.of_distance_matrix(views.label_matrix(s, d), 2)),
    "persistence_quantised": lambda s, d: diagram(persistence.persistent_communities(views.region_distances(s, d), digits=-2)),
    "diagram_sizes": lambda s, d: persistence.persistent_communities(views.region_distances(s, d)).groupBy("q", "size").agg(F.count("*").alias("value")),
    "consensus": lambda s, d: ensemble.consensus(views.yearly(s, d), sample_counts(s, d)),
    "consensus_vectors": lambda s, d: digits(ensemble.consensus_vectors(views.yearly(s, d), group_vertices(s, d), sample_counts(s, d))).withColumnRenamed("complex_id", "grp"),
    "consensus_difference": lambda s, d: digits(ensemble.consensus_statistic(views.yearly(s, d), group_vertices(s, d), sample_counts(s, d), "kept", "returned")),
    "padded_vectors": lambda s, d: digits(vectors.padded(sample_vectors(s, d))).withColumnRenamed("complex_id", "g"),
    "long_to_wide": lambda s, d: vectors.wide(digits(vectors.graded(views.nation_complex(s, d)))).drop("complex_id"),
    "median_panel": lambda s, d: digits(ensemble.median_panel(sample_vectors(s, d).withColumn("grp", F.split("complex_id", " ")[0]))),
    "permutation_test": permutation,
    "suppliers_fsv": on_suppliers(vectors.first_structure_vector),
    "suppliers_tsv": on_suppliers(lambda k: digits(vectors.third_structure_vector(k))),
    "suppliers_components": on_suppliers(components.q_components),
    "suppliers_components_at": on_suppliers(lambda k: components.components_at(k, 2)),
    "adjacency": lambda s, d: SimplicialComplex.from_adjacency(views.adjacency_rows(s, d)).simplices.select("sid", joined("members").alias("members")),
    "edge_rows": lambda s, d: diagram(persistence.of_edge_rows(views.nation_distances(s, d).select(F.col("u").cast("double"), F.col("v").cast("double"), "w"), 1)),
    "edge_pairs": lambda s, d: matrices.edges_of_pairs(views.read(s, d, "lineitem").select(F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v"))).drop("complex_id"),
    "coauthors": coauthors,
    "scale_free": scale_free,
    "degree_graph": degree_graph,
    "components_at": on_nations(lambda k: components.components_at(k, 2)),
    "graded_named": on_nations(lambda k: digits(vectors.graded(k, ["SSV", "Topological entropy", "nothing", "fsv", "ssv"]))),
    "vectors_at": on_nations(lambda k: digits(vectors.value_at(vectors.graded(k), 1))),
    "vector_named": on_nations(lambda k: digits(vectors.named(vectors.graded(k), "entropy"))),
    "eccentricity_of": lambda s, d: digits(pairs.eccentricity_of(views.nation_complex(s, d), 0)).unionAll(digits(pairs.eccentricity_of(views.nation_complex(s, d), {0, 1, 2}))),
    "absorbed": lambda s, d: cliques.without_absorbed(views.star_complexes(s, d).simplices).select("complex_id", "sid", joined("members").alias("members")),
    "union_of_rows": union_of_stars,
    "persistence_suppliers": lambda s, d: diagram(persistence.persistent_communities(views.supplier_neighbours(s, d))),
    "persistence_ranges": lambda s, d: diagram(persistence.dense(views.supplier_neighbours(s, d), 128).withColumn("size", F.size("members"))),
    "diagram_access": lambda s, d: persistence.Diagram(persistence.persistent_communities(views.nation_distances(s, d), 1)).numbered().withColumn("members", joined("members")),
    "diagram_offsets": lambda s, d: compressed.read(s, views.compressed_diagram(s, d))[0].drop("complex_id"),
    "diagram_members": lambda s, d: compressed.read(s, views.compressed_diagram(s, d))[1].drop("complex_id"),
    "projection_rows": on_nations(lambda k: ensemble.projection_rows(k, 2, weighted=True).withColumn("row", joined("row"))),
    "component_labels": on_nations(lambda k: ml.QComponents(q=1).transform(k.simplices)),
    "graded_transformer": lambda s, d: digits(ml.GradedParameters(metrics=["fsv", "ssv", "entropy"], max_order=6, fill_value=-1.0, n_vertices=25).transform(dataset_of_samples(s, d))),
    "graded_fitted": graded_fitted,
    "projection_transformer": on_nations(lambda k: ml.SimplexProjection(q=2, weighted=True).transform(k.simplices)),
    "filter_transformer": lambda s, d: ml.GraphCliqueFilter(q=4).transform(views.nation_graph(s, d)).drop("complex_id"),
    "occupation_array": on_nations(lambda k: vectors.occupation_array(k, 5)),
    "set_functions": set_functions,
    "vertex_ids": vertex_ids,
}
__all__ = ["ORACLES", "QUERIES"]
