"""Cliques of graphs: maximal ones by a search of each vertex's surroundings, all up to a size by joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cliquora.operators.durable import dealt, durable, looped


def both_ways(edges: DataFrame) -> DataFrame:
    """(complex_id, v, n): every edge from either end."""
    return edges.select("complex_id", F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("v").alias("n")), F.struct(F.col("v").alias("v"), F.col("u").alias("n")))).alias("e")).select("complex_id", "e.*")


def search(near: dict[int, set[int]], root: int) -> list[list[int]]:
    """The maximal cliques of which root is the least vertex, among root's neighbours (near: of each the neighbours among them)."""
    found = []
    # (clique, candidates, excluded): candidates later than root, excluded earlier ones and those that are done
    stack = [([root], {v for v in near if v > root}, {v for v in near if v < root})]
    while stack:
        clique, candidates, excluded = stack.pop()
        if not candidates and not excluded:
            found.append(sorted(clique))
            continue
        if not candidates:
            continue
        pivot = max(candidates | excluded, key=lambda v: len(near[v] & candidates))
        for v in sorted(candidates - near[pivot]):
            stack.append(([*clique, v], candidates & near[v], excluded & near[v]))
            candidates = candidates - {v}
            excluded = excluded | {v}
    return found


def core_numbers(edges: DataFrame) -> DataFrame:
    """(complex_id, vertex, core): the largest k such that the vertex is in a part of the graph in which all have k neighbours or more.

    Every vertex starts from its degree and takes, round by round, the largest h such that h of its neighbours stand at h or more;
    where nothing moves these are the core numbers. Neighbours are counted by where they stand, so that no task lists a hub's.
    """
    both = durable(both_ways(edges).distinct())
    now = looped(both.groupBy("complex_id", F.col("v").alias("vertex")).agg(F.count("*").alias("core")))
    while True:
        stands = both.join(now.select("complex_id", F.col("vertex").alias("n"), F.col("core").alias("at")), ["complex_id", "n"])
        stands = stands.join(now.select("complex_id", F.col("vertex").alias("v"), "core"), ["complex_id", "v"])
        counts = stands.groupBy("complex_id", "v", "core", F.least("at", "core").alias("at")).agg(F.count("*").alias("c"))
        so_far = F.sum("c").over(W.partitionBy("complex_id", "v").orderBy(F.col("at").desc()))
        least = counts.withColumn("h", F.least("at", so_far)).groupBy("complex_id", F.col("v").alias("vertex")).agg(F.max("core").alias("before"), F.max("h").alias("core"))
        after = looped(least)
        now = after.drop("before")
        if after.where("core < before").isEmpty():
            return now


#: Edges whose roots a task searches, about: a root's rows are few bytes, and Spark would put very many roots into one task.
ROOTS = 2000


def of_roots(rows: DataFrame, edges: DataFrame):
    """rows grouped by complex_id and v, in as many parts as the edges ask for."""
    return dealt(rows, edges.count(), "complex_id", "v", share=ROOTS).groupBy("complex_id", "v")


#: Neighbours of a vertex that are taken to one task whatever the graph; with more, the order of peeling decides whose task they go to.
HUB = 1000


def peeled(edges: DataFrame) -> DataFrame:
    """(complex_id, vertex, layer): in each round the vertices of at most twice the average degree of what is left go.

    At least half go in a round, so that the rounds are logarithmic. A vertex has at most four times the graph's degeneracy of
    neighbours in its own layer and later ones.
    """
    left, layer = looped(both_ways(edges).distinct()), 0
    out = None
    while True:
        degrees = left.groupBy("complex_id", "v").agg(F.count("*").alias("n"))
        bound = degrees.groupBy("complex_id").agg((2 * F.avg("n")).alias("bound"))
        gone = looped(degrees.join(bound, "complex_id").where("n <= bound").select("complex_id", F.col("v").alias("vertex"), F.lit(layer).alias("layer")))
        if gone.isEmpty():
            return gone if out is None else out
        out = gone if out is None else out.unionByName(gone)
        end = lambda x: gone.select("complex_id", F.col("vertex").alias(x))  # noqa: B023, E731
        rest = left.join(end("v"), ["complex_id", "v"], "left_anti").join(end("n"), ["complex_id", "n"], "left_anti").select("complex_id", "v", "n")
        # a vertex whose last neighbours have gone goes with the next round, under a layer of its own
        alone = left.select("complex_id", "v").distinct().join(end("v"), ["complex_id", "v"], "left_anti").join(rest.select("complex_id", "v").distinct(), ["complex_id", "v"], "left_anti")
        out = out.unionByName(looped(alone.select("complex_id", F.col("v").alias("vertex"), F.lit(layer + 1).alias("layer"))))
        left, layer = looped(rest), layer + 2


def rooted(near: dict[int, set[int]], root: int) -> list[list[int]]:
    """The cliques of root and of its later neighbours (near: of each the neighbours among them) that none of these can join."""
    found = []
    stack = [([root], set(near), set())]
    while stack:
        clique, candidates, excluded = stack.pop()
        if not candidates:
            if not excluded:
                found.append(sorted(clique))
            continue
        pivot = max(candidates | excluded, key=lambda v: len(near[v] & candidates))
        for v in sorted(candidates - near[pivot]):
            stack.append(([*clique, v], candidates & near[v], excluded & near[v]))
            candidates = candidates - {v}
            excluded = excluded | {v}
    return found


def later_links(edges: DataFrame) -> DataFrame:
    """(complex_id, v, a, b): of each vertex the later neighbours in the order of peeling (b is null) and the links a-b among these."""
    at = peeled(edges)
    place = lambda x: at.select("complex_id", F.col("vertex").alias(x), F.struct("layer", "vertex").alias(f"{x}_at"))
    star = both_ways(edges).distinct().join(place("v"), ["complex_id", "v"]).join(place("n"), ["complex_id", "n"]).where("v_at < n_at").select("complex_id", "v", "n")
    star = durable(star)
    a, b = star.withColumnRenamed("n", "a"), star.withColumnRenamed("n", "b")
    links = a.join(star.select("complex_id", F.col("v").alias("a"), F.col("n").alias("b")), ["complex_id", "a"]).join(b, ["complex_id", "v", "b"], "left_semi")
    return star.select("complex_id", "v", F.col("n").alias("a"), F.lit(None).cast("long").alias("b")).unionByName(links.select("complex_id", "v", "a", "b"))


def hub_cliques(edges: DataFrame) -> DataFrame:
    """(complex_id, members): the maximal cliques, where no task has more of a vertex's neighbours than four times the degeneracy.

    A root's task has its later neighbours only. A clique that it finds is one of the graph's unless an earlier vertex is linked with all
    of it: such vertices are looked for among the neighbours of the clique's member with the fewest, by joins, and what they can
    join goes by an anti join.
    """
    kind = edges.schema["complex_id"].dataType.simpleString()
    edges = durable(edges.select("complex_id", "u", "v").distinct())

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lone, linked = pdf[pdf["b"].isna()], pdf[pdf["b"].notna()]
        near = {int(n): set() for n in lone["a"]}
        for x, y in zip(linked["a"].astype(int), linked["b"].astype(int), strict=True):
            near[x].add(y)
            near[y].add(x)
        found = rooted(near, int(key[1]))
        return pd.DataFrame({"complex_id": pd.Series([key[0]] * len(found), dtype=object), "members": pd.Series(found, dtype=object)})

    found = of_roots(later_links(edges), edges).applyInPandas(run, f"complex_id {kind}, members array<bigint>")
    found = durable(found)
    both = durable(both_ways(edges))
    degrees = both.groupBy("complex_id", "v").agg(F.count("*").alias("n"))
    fewest = found.select("complex_id", "members", F.explode("members").alias("v")).join(degrees, ["complex_id", "v"]).groupBy("complex_id", "members").agg(F.min(F.struct("n", "v")).alias("few"))
    # neighbours of that member outside the clique; of them those that are linked with each other member
    beside = fewest.select("complex_id", "members", F.col("few.v").alias("v")).join(both, ["complex_id", "v"]).where(~F.array_contains("members", F.col("n")))
    beside = beside.select("complex_id", "members", F.col("n").alias("x"), F.explode(F.array_except("members", F.array("v"))).alias("v"))
    joins = beside.join(both.select("complex_id", "v", F.col("n").alias("x")), ["complex_id", "v", "x"], "left_semi")
    gone = joins.groupBy("complex_id", "members", "x").agg(F.count("*").alias("n")).where("n = size(members) - 1").select("complex_id", "members").distinct()
    return found.join(gone, ["complex_id", "members"], "left_anti")


def maximal_cliques(edges: DataFrame, vertices: DataFrame | None = None, by_graph: bool = False, hub: int = HUB) -> DataFrame:
    """(complex_id, members) of edges (complex_id, u, v), u < v. Vertices without an edge are cliques of their own.

    A task gets one vertex, its neighbours and the edges among them (a triangle join), so that a graph spreads over the cluster.
    by_graph: a task gets whole graphs, for ensembles of many small ones. In graphs where a vertex has more than `hub` neighbours, the
    order of peeling bounds what a task gets (hub_cliques).
    """
    edges = edges if by_graph else durable(edges.select("complex_id", "u", "v"))
    if not by_graph and not both_ways(edges).groupBy("complex_id", "v").agg(F.count("*").alias("n")).where(F.col("n") > hub).isEmpty():
        return with_lone(hub_cliques(edges), edges, vertices)
    star = both_ways(edges)
    kind = edges.schema["complex_id"].dataType.simpleString()
    schema = f"complex_id {kind}, members array<bigint>"

    def named(name, found):
        return pd.DataFrame({"complex_id": pd.Series([name] * len(found), dtype=object), "members": pd.Series(found, dtype=object)})

    def whole(key, pdf):
        near: dict[int, set[int]] = {}
        for x, y in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
            near.setdefault(x, set()).add(y)
            near.setdefault(y, set()).add(x)
        return named(key[0], [c for v in near for c in search({n: near[n] & near[v] for n in near[v]}, v)])

    a, b = star.withColumnRenamed("n", "a"), star.withColumnRenamed("n", "b")
    # links among the neighbours of v: a-b is an edge, and both are neighbours of v
    links = a.join(edges.select("complex_id", F.col("u").alias("a"), F.col("v").alias("b")), ["complex_id", "a"]).join(b, ["complex_id", "v", "b"], "left_semi")
    rows = star.select("complex_id", "v", F.col("n").alias("a"), F.lit(None).cast("long").alias("b")).unionByName(links.select("complex_id", "v", "a", "b"))

    def cliques(key, pdf):
        lone, linked = pdf[pdf["b"].isna()], pdf[pdf["b"].notna()]
        near = {int(n): set() for n in lone["a"]}
        for x, y in zip(linked["a"].astype(int), linked["b"].astype(int), strict=True):
            near[x].add(y)
            near[y].add(x)
        return named(key[0], search(near, int(key[1])))

    out = edges.select("complex_id", "u", "v").groupBy("complex_id").applyInPandas(whole, schema) if by_graph else of_roots(rows, edges).applyInPandas(cliques, schema)
    return with_lone(out, edges, vertices)


def with_lone(found: DataFrame, edges: DataFrame, vertices: DataFrame | None) -> DataFrame:
    """Cliques, and each vertex without an edge as one of its own."""
    if vertices is None:
        return found
    linked = both_ways(edges).select("complex_id", F.col("v").alias("vertex")).distinct()
    return found.unionByName(vertices.join(linked, ["complex_id", "vertex"], "left_anti").distinct().select("complex_id", F.array("vertex").alias("members")))


#: Cliques of one graph that are ranked in one task.
RANKED = 1_000_000


def numbered(cliques: DataFrame, ranked: int = RANKED) -> DataFrame:
    """(complex_id, sid, members): positions in the order of the members, from 0 in each complex.

    A graph of more than `ranked` cliques is ranked in two steps: the cliques are dealt to tasks by ranges of members, and each task
    goes on counting where those before it end.
    """
    cliques = durable(cliques)
    most = cliques.groupBy("complex_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= ranked:
        return cliques.withColumn("sid", (F.row_number().over(W.partitionBy("complex_id").orderBy("members")) - 1).cast("long")).select("complex_id", "sid", "members")
    dealt = durable(cliques.repartitionByRange("complex_id", "members").sortWithinPartitions("complex_id", "members"))
    dealt = dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    own = dealt.groupBy("complex_id", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(W.partitionBy("complex_id").orderBy("part")) - F.col("n")
    starts = own.select("complex_id", "part", (before - F.col("first")).alias("start"))
    return dealt.join(starts, ["complex_id", "part"]).select("complex_id", (F.col("at") + F.col("start")).alias("sid"), "members")


def by_degree(edges: DataFrame) -> DataFrame:
    """(complex_id, x, y, w): each edge from the end of fewer edges (of equal ones the lesser) to the other.

    So no vertex has more than sqrt(2 m) later neighbours, of m edges; a hub has only other hubs.
    """
    degree = both_ways(edges).groupBy("complex_id", "v").agg(F.count("*").alias("n"))
    for end in "uv":
        edges = edges.join(degree.select("complex_id", F.col("v").alias(end), F.col("n").alias("n_" + end)), ["complex_id", end])
    ends = F.array_sort(F.array(F.struct(F.col("n_u").alias("n"), F.col("u").alias("at")), F.struct(F.col("n_v").alias("n"), F.col("v").alias("at"))))
    return edges.select("complex_id", ends[0]["at"].alias("x"), ends[1]["at"].alias("y"), "w")


def few_cliques(edges: DataFrame, limit: int) -> DataFrame | None:
    """k_cliques of all sizes; None if there are more than limit, which is told by the first level that passes it."""
    return k_cliques(edges, limit=limit)


def k_cliques(edges: DataFrame, most: int | None = None, limit: int | None = None) -> DataFrame | None:
    """(complex_id, size, members, birth): all cliques up to a size, by extension with later common neighbours.

    birth is the largest weight of its edges where edges have a weight w (null for single vertices), else null. Vertices are in the
    order of by_degree, so that a row has sqrt(2 m) neighbours at most. Each level is a join with the adjacency and is written to the
    checkpoint folder. limit: None is given where there are more cliques than that.
    """
    weighted = "w" in edges.columns
    edges = edges.withColumn("w", F.coalesce("w", F.lit(0.0)) if weighted else F.lit(0.0))
    # of each vertex its later neighbours, with the weights
    later = by_degree(edges).groupBy("complex_id", "x").agg(F.collect_list(F.struct("y", "w")).alias("later"))
    ends = both_ways(edges).select("complex_id", F.col("v").alias("x")).distinct()
    near = durable(ends.join(later, ["complex_id", "x"], "left").withColumn("later", F.coalesce("later", F.array().cast(later.schema["later"].dataType))))
    # common: the later neighbours of all members, with the largest weight of an edge to a member
    level = near.select("complex_id", F.array("x").alias("members"), F.col("later").alias("common"), F.lit(None).cast("double").alias("birth"))
    out, size, n = level, 1, 0
    while most is None or size < most:
        step = level.select("complex_id", "members", "common", "birth", F.explode("common").alias("new")).select("*", F.col("new.y").alias("x")).join(near, ["complex_id", "x"])
        # in order, a neighbour of both stands beside itself
        step = step.withColumn("sorted", F.array_sort(F.concat("common", "later")))
        twins = F.transform("sorted", lambda c, i: F.when(F.get("sorted", i + 1)["y"] == c["y"], F.struct(c["y"].alias("y"), F.greatest(c["w"], F.get("sorted", i + 1)["w"]).alias("w"))))
        both = F.filter(twins, lambda c: c.isNotNull()).alias("common")
        level = durable(step.select("complex_id", F.array_append("members", F.col("x")).alias("members"), both, F.greatest("birth", "new.w").alias("birth")))
        if level.isEmpty():
            break
        n += 0 if limit is None else level.count()
        if limit is not None and n > limit:
            return None
        out, size = out.unionByName(level), size + 1
    return out.select("complex_id", F.size("members").alias("size"), F.array_sort("members").alias("members"), F.col("birth") if weighted else F.lit(None).cast("double").alias("birth"))


def edge_cliques(cliques: DataFrame, u: int, v: int) -> DataFrame:
    """Those that contain both ends of an edge."""
    return cliques.where(F.array_contains("members", u) & F.array_contains("members", v))


def without_absorbed(simplices: DataFrame) -> DataFrame:
    """Simplices that are no part of another one; of equal ones that of the least sid."""
    from cliquora.model import SimplicialComplex
    from cliquora.operators.pairs import pairs

    k = SimplicialComplex(simplices)
    found = pairs(k)
    size = k.simplices.select("complex_id", "sid", F.size("members").alias("n"))
    both = found.join(size.withColumnRenamed("sid", "i").withColumnRenamed("n", "ni"), ["complex_id", "i"]).join(size.withColumnRenamed("sid", "j").withColumnRenamed("n", "nj"), ["complex_id", "j"])
    gone = both.where("shared = nj").select("complex_id", F.col("j").alias("sid")).unionByName(both.where("shared = ni and ni < nj").select("complex_id", F.col("i").alias("sid"))).distinct()
    return k.simplices.join(gone, ["complex_id", "sid"], "left_anti")
