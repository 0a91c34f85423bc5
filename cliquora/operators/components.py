"""q-connected components for all q at once, from one merge tree of each complex.

Simplices that share q + 1 vertices are linked at every level up to q. Components merge in rounds: each takes its best link (of the most
shared vertices, ties by the simplices' ids), the links chosen form trees, and each tree is one component of the next round. A round at
least halves the components that have links, joins and aggregates only, and no task holds a complex.

The rounds answer every level. Along the chosen links the number of shared vertices doesn't fall, and no link that leaves a tree shares
more than the best link of the simplex where it starts. So at level q a component whose best link holds there (shares more than q
vertices) is connected with its whole tree's root, and one whose best link doesn't is complete: what holds at q of the simplices
below it is one component. A simplex climbs the rounds, and the least best link on its way tells at which levels it stops where. Links come from the tasks that count intersections, as forests.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliquora.operators.durable import MAX_BROADCAST, durable, looped
from cliquora.operators.pairs import forests

ROUNDS = 60


class Union:
    """Disjoint sets with path halving; the root is the least member."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up = self.up
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def thinned(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows that a spanning forest of the largest intersections needs."""
    pdf = pdf.sort_values(["shared", "i", "j"], ascending=[False, True, True])
    sets = Union()
    keep = [sets.join((c, i), (c, j)) for c, i, j in zip(pdf["complex_id"], pdf["i"], pdf["j"], strict=True)]
    return pdf[keep]


def own_forests(found: DataFrame) -> DataFrame:
    """Of each task's pairs those that its own spanning forest needs: (complex_id, i, j, shared)."""

    def partly(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, waiting = None, []
        for batch in batches:
            waiting.append(batch)
            # what is kept is sorted again only when as much has come in
            if sum(map(len, waiting)) >= (0 if kept is None else len(kept)):
                kept, waiting = thinned(pd.concat(waiting if kept is None else [kept, *waiting])), []
        if waiting:
            kept = thinned(pd.concat(waiting if kept is None else [kept, *waiting]))
        if kept is not None:
            yield kept

    found = found.select("complex_id", "i", "j", "shared")
    return found.mapInPandas(partly, found.schema)


def roots_of(chosen: DataFrame, near) -> DataFrame:
    """(complex_id, node, shared, root) of chosen links (complex_id, node, to, shared): pointers are doubled until all stand at a root.

    Of two nodes that chose each other, the lesser is the root. near: a hint for the joined side.
    """
    back = near(chosen.select("complex_id", F.col("node").alias("to"), F.col("to").alias("back")))
    root = F.when((F.col("back") == F.col("node")) & (F.col("node") < F.col("to")), F.col("node")).otherwise(F.col("to"))
    up = chosen.join(back, ["complex_id", "to"]).select("complex_id", "node", "shared", root.alias("root"))

    def doubled(up: DataFrame) -> DataFrame:
        above = near(up.select("complex_id", F.col("node").alias("root"), F.col("root").alias("next")))
        return up.join(above, ["complex_id", "root"]).select("complex_id", "node", "shared", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved"))

    for _ in range(ROUNDS):
        up = looped(doubled(doubled(up)))
        moved = not up.where("moved").isEmpty()
        up = up.drop("moved")
        if not moved:
            return up
    raise ValueError("the pointers do not settle")


def merge_tree(found: DataFrame) -> list[DataFrame]:
    """The rounds of pairs (complex_id, i, j, shared), each (complex_id, node, shared, root): a component's best link and its tree's root.

    Components that have no link in a round have no row. Nodes other than their root are links of a spanning forest. Rounds of few
    rows come with a hint to send them to all tasks.
    """
    at = F.struct("shared", (-F.col("i")).alias("i"), (-F.col("j")).alias("j"))  # no two links are equal in this order
    links = looped(own_forests(found).select("complex_id", F.col("i").alias("a"), F.col("j").alias("b"), at.alias("at")))
    rounds: list[DataFrame] = []
    while n := links.count():
        if len(rounds) > ROUNDS:
            raise ValueError("the components do not settle")
        near = F.broadcast if 2 * n <= MAX_BROADCAST else lambda rows: rows  # a link has two ends, so there are no more nodes
        both = links.unionByName(links.select("complex_id", F.col("b").alias("a"), F.col("a").alias("b"), "at"))
        best = both.groupBy("complex_id", "a").agg(F.max(F.struct("at", "b")).alias("best"))
        up = near(roots_of(looped(best.select("complex_id", F.col("a").alias("node"), F.col("best.b").alias("to"), F.col("best.at.shared").alias("shared"))), near))
        rounds.append(up)
        name = lambda end: near(up.select("complex_id", F.col("node").alias(end), F.col("root").alias(f"{end}_")))  # noqa: B023, E731
        links = links.join(name("a"), ["complex_id", "a"]).join(name("b"), ["complex_id", "b"]).where("a_ <> b_")
        links = looped(links.groupBy("complex_id", F.least("a_", "b_").alias("a"), F.greatest("a_", "b_").alias("b")).agg(F.max("at").alias("at")))
    return rounds


def merges(found: DataFrame) -> DataFrame:
    """(complex_id, q, n): how many links of the spanning forest share exactly q + 1 vertices."""
    rounds = merge_tree(found)
    none = found.select("complex_id", F.lit(0).alias("q"), F.lit(0).cast("long").alias("n")).where("false")
    out = none.select("complex_id", "q")
    for up in rounds:
        out = out.unionByName(up.where("node <> root").select("complex_id", (F.col("shared") - 1).cast("int").alias("q")))
    return out.groupBy("complex_id", "q").agg(F.count("*").alias("n"))


def stars(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of the edges (a, b) is connected with. Nodes are of any ordered type."""
    edges = durable(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    state = None
    for _ in range(ROUNDS):
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("mark")).first()
        if now == state or not now.n:
            break
        state = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        edges = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        least = edges.groupBy("b").agg(F.min("a").alias("m"))
        edges = durable(edges.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct())
    else:
        raise ValueError("the components do not settle")
    least = edges.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("node"), "root")
    return least.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def q_components(k, found: DataFrame | None = None) -> DataFrame:
    """(complex_id, q, sid, component): component is the least sid of its simplices. found: the pairs of k, if they are there."""
    rounds = merge_tree(forests(k) if found is None else found)
    # where each simplex stands, the levels below `open` at which it goes on, and the stops: node and levels
    none = F.array().cast("array<struct<node:bigint,first:bigint,last:bigint,round:int>>")
    rows = k.dims().where("dim >= 0").select("complex_id", "sid", F.col("sid").cast("long").alias("node"), (F.col("dim") + 1).cast("long").alias("open"), none.alias("stops"))
    stop = lambda first, n: F.struct("node", first.cast("long").alias("first"), (F.col("open") - 1).alias("last"), F.lit(n).alias("round"))
    for n, up in enumerate(rounds):
        shared = F.coalesce("shared", F.lit(0))
        rows = rows.join(up, ["complex_id", "node"], "left")
        stops = F.when(shared < F.col("open"), F.array_append("stops", stop(shared, n))).otherwise(F.col("stops"))
        rows = rows.select("complex_id", "sid", F.coalesce("root", "node").alias("node"), F.least("open", shared).alias("open"), stops.alias("stops"))
    last = F.when(F.col("open") > 0, F.array_append("stops", stop(F.lit(0), len(rounds)))).otherwise(F.col("stops"))
    stopped = rows.select("complex_id", "sid", F.explode(last).alias("x")).select("complex_id", "sid", "x.node", "x.round", F.explode(F.sequence("x.first", "x.last")).alias("q"))
    stopped = stopped.withColumn("q", F.col("q").cast("int"))
    alone = stopped.where("round = 0").select("complex_id", "q", "sid", F.col("sid").alias("component"))
    if not rounds:
        return alone
    met = durable(stopped.where("round > 0").drop("round"))
    least = met.groupBy("complex_id", "q", "node").agg(F.min("sid").alias("component"))
    return alone.unionByName(met.join(least, ["complex_id", "q", "node"]).select("complex_id", "q", "sid", "component"))


def components_at(k, q: int) -> DataFrame:
    """(complex_id, sid, component) at one q; IndexError below 0 and above the order of every complex.

    Only pairs that share more than q vertices are linked, and of those only what the tasks' forests need.
    """
    from cliquora.operators.vectors import order

    top = order(k).agg(F.max("value")).first()[0]
    if q < 0 or top is None or q > top:
        raise IndexError(f"no level {q}")
    node = lambda s: F.struct("complex_id", F.col(s).alias("sid"))
    roots = stars(forests(k, q + 1).select(node("i").alias("a"), node("j").alias("b"))).select("node.*", F.col("root.sid").alias("root"))
    rows = k.dims().where(F.col("dim") >= q).select("complex_id", "sid")
    return rows.join(roots, ["complex_id", "sid"], "left").select("complex_id", "sid", F.coalesce("root", "sid").alias("component"))


def component_vertices(k) -> DataFrame:
    """(complex_id, q, component, vertices): the union of each component's simplices."""
    found = q_components(k).join(k.incidence(), ["complex_id", "sid"])
    return found.groupBy("complex_id", "q", "component").agg(F.sort_array(F.collect_set("vertex")).alias("vertices"))


def graph_components(edges: DataFrame, vertices: DataFrame | None = None, max_clique_size: int | None = None) -> DataFrame:
    """(complex_id, q, vertices) of a graph's cliques.

    max_clique_size cuts the search: levels below it are unaffected, the top level q = size - 1 has each clique alone (if the
    graph has a larger one). 0 counts as 1.
    """
    from cliquora.model import SimplicialComplex
    from cliquora.operators.cliques import k_cliques

    whole = component_vertices(SimplicialComplex.from_graph(edges, vertices)).select("complex_id", "q", "vertices")
    if max_clique_size is None:
        return whole
    size = max(1, max_clique_size)
    top = k_cliques(edges, size).where(F.col("size") == size).select("complex_id", F.lit(size - 1).alias("q"), F.col("members").alias("vertices"))
    if size == 1 and vertices is not None:
        top = vertices.distinct().select("complex_id", F.lit(0).alias("q"), F.array("vertex").alias("vertices"))
    return whole.where(F.col("q") < size - 1).unionByName(top)
