"""Communities of each dimension as the edge-weight threshold rises: where they are born, and where they merge.

Two plans give the same intervals.

`capped` (a max_q is given): at level q the objects are the (q+1)-cliques, born with their heaviest edge (at q = 0 the vertices,
born with their lightest edge), and the links are the (q+2)-cliques, each joining its faces. That equals q-connectedness of the
maximal cliques: within a clique any two (q+1)-subsets are joined by swapping one vertex at a time. Cliques come from joins, links
are thinned to a spanning forest in each task, and a level of a graph is one group: it sweeps its thresholds once.

`dense` (no max_q: all levels): the number of cliques may explode, so only maximal ones are held. A large graph is cut into its
connected parts, whose communities never meet, each a graph from here on. If these have FEW cliques an edge or less (counted level by
level), `capped` goes up to the largest one: a range's task holds all that is lighter, which grows with the square of a sparse graph.
Else a graph's weights are cut into
ranges of about RANGE edges, each a task of its own. It builds the graph of all lighter edges, finds its maximal cliques and their
communities at every level, and lets the weights of its range rise once: an edge's new maximal cliques are searched among the common
neighbours of its ends, compared with those that there are (numpy, on bit sets), and join their communities. Two tasks number the
communities at the border between their ranges alike (by level and least clique). What came before a range is older than all that is
born in it, so a task settles by itself what becomes of its own; communities from before that merge leave rows (what merged, into
what), and so do those that reach the next range. Births then go up these rows, by doubled pointers, and tell who has lived on.

Edges are cleaned first (finite, no loops, the lightest of duplicates); equal weights are one step. A community's members are the
union of its cliques' vertices. When communities merge, the one born first lives on, then the larger, then the one of smaller
members; the others end with the members that they had before the step. Nothing is reported that is born and ends in one step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cliquora.operators.cliques import few_cliques, k_cliques
from cliquora.operators.components import Union, stars
from cliquora.operators.durable import durable, looped, sized
from cliquora.sources.matrices import clean_edges, edges_of_distances, edges_of_rows

INF = float("inf")
#: Stands for the birth of what was born before a range of weights.
BEFORE = -INF
#: Cliques for each edge up to which all of them are listed.
FEW = 6
#: Edges that a task lets rise, and the most borders between such ranges in a graph; a node's number has the range above so many bits.
RANGE, CUTS, NODE = 512, 63, 40


def elder(candidates: list[tuple[float, list[int]]]) -> int:
    """Which of (birth, members) lives on."""
    return min(range(len(candidates)), key=lambda i: (candidates[i][0], -len(candidates[i][1]), candidates[i][1]))


def sweep(objects: list[tuple[float, tuple[int, ...]]], links: list[tuple[float, tuple, tuple]]) -> list[tuple[float, float, list[int]]]:
    """(birth, death, members) of one level. objects: (birth, vertices); links: (weight, object, object)."""
    out, sets = [], Union()
    state: dict[tuple, tuple[float, frozenset]] = {}  # of each root
    steps: dict[float, tuple[list, list]] = {}
    for birth, members in objects:
        steps.setdefault(birth, ([], []))[0].append(members)
    for weight, a, b in links:
        steps.setdefault(weight, ([], []))[1].append((a, b))
    for t in sorted(steps):
        born, joined = steps[t]
        touched, new = set(), set(born)
        old: dict[tuple, list] = {}  # new roots and the communities that they had before the step
        for members in born:
            sets.root(members)
            touched.add(members)
        for a, b in joined:
            touched |= {sets.root(a), sets.root(b)}
            sets.join(a, b)
        for x in touched:
            old.setdefault(sets.root(x), []).append(x)
        for root, parts in old.items():
            before = [state.pop(x) for x in parts if x in state]
            fresh = [x for x in parts if x in new] if len(before) < len(parts) else []
            members = frozenset().union(*(m for _, m in before), *fresh)
            if not before:
                state[root] = (t, members)
                continue
            ranked = [(birth, sorted(m)) for birth, m in before]
            first = elder(ranked)
            out += [(birth, t, m) for i, (birth, m) in enumerate(ranked) if i != first]
            state[root] = (ranked[first][0], members)
    return out + [(birth, INF, sorted(m)) for birth, m in state.values()]


def capped(edges: DataFrame, max_q: int, cliques: DataFrame | None = None) -> DataFrame:
    """cliques: those of up to max_q + 2 vertices, if they are there."""
    kind = edges.schema["complex_id"].dataType.simpleString()
    cliques = durable(k_cliques(edges, max_q + 2)) if cliques is None else cliques
    births = edges.select("complex_id", F.explode(F.array("u", "v")).alias("v"), "w").groupBy("complex_id", "v").agg(F.min("w").alias("birth"))
    zero = births.select("complex_id", F.lit(0).alias("q"), "birth", F.array("v").alias("a"), F.lit(None).cast("array<bigint>").alias("b"))
    objects = cliques.where((F.col("size") >= 2) & (F.col("size") <= max_q + 1)).select("complex_id", (F.col("size") - 1).alias("q"), "birth", F.col("members").alias("a"), F.lit(None).cast("array<bigint>").alias("b"))
    # a star from the face without the first vertex to every other one
    drop = lambda i: F.concat(F.slice("members", F.lit(1), i - 1), F.slice("members", i + 1, F.size("members")))
    links = cliques.where("size >= 2").select("complex_id", (F.col("size") - 2).alias("q"), "birth", drop(F.lit(1)).alias("a"), F.explode(F.transform(F.sequence(F.lit(2), F.size("members")), drop)).alias("b"))

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            rows = (batch if kept is None else pd.concat([kept, batch])).sort_values("birth")
            sets = Union()
            kept = rows[[sets.join((c, q, tuple(a)), (c, q, tuple(b))) for c, q, a, b in zip(rows["complex_id"], rows["q"], rows["a"], rows["b"], strict=True)]]
        if kept is not None:
            yield kept

    rows = zero.unionByName(objects).unionByName(links.mapInPandas(thin, links.schema))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, joined = [], []
        for birth, a, b in zip(pdf["birth"], pdf["a"], pdf["b"], strict=True):
            if b is None:
                own.append((birth, tuple(map(int, a))))
            else:
                joined.append((birth, tuple(map(int, a)), tuple(map(int, b))))
        found = sweep(own, joined)
        return pd.DataFrame({"complex_id": pdf["complex_id"].iloc[0], "q": pdf["q"].iloc[0], "birth": [r[0] for r in found], "death": [r[1] for r in found], "members": pd.Series([r[2] for r in found], dtype=object)})

    return rows.groupBy("complex_id", "q").applyInPandas(run, f"complex_id {kind}, q int, birth double, death double, members array<bigint>")


def packed(sets: list[int], words: int) -> np.ndarray:
    """Sets of vertices, given as bits of an integer, as rows of 64-bit words."""
    return np.frombuffer(b"".join(x.to_bytes(8 * words, "little") for x in sets), np.uint64).reshape(-1, words)


def bits(x: int) -> list[int]:
    out = []
    while x:
        low = x & -x
        out.append(low.bit_length() - 1)
        x ^= low
    return out


def grown(near: list[int], clique: int, candidates: int, done: int) -> list[int]:
    """The maximal cliques, as bits, of a clique with some of the candidates and none of the done. near: each vertex's neighbours, as bits."""
    found = []
    stack = [(clique, candidates, done)]
    while stack:
        clique, candidates, done = stack.pop()
        if not candidates:
            if not done:
                found.append(clique)
            continue
        # branch on what the pivot, the vertex with the most candidates among its neighbours, is not linked with
        best, skip = -1, 0
        rest = candidates | done
        while rest:
            low = rest & -rest
            rest ^= low
            own = near[low.bit_length() - 1]
            n = (own & candidates).bit_count()
            if n > best:
                best, skip = n, own
        rest = candidates & ~skip
        while rest:
            low = rest & -rest
            rest ^= low
            own = near[low.bit_length() - 1]
            stack.append((clique | low, candidates & own, done & own))
            candidates ^= low
            done |= low
    return found


def around(near: list[int], u: int, v: int) -> list[int]:
    """The maximal cliques that have the edge u-v."""
    return grown(near, 1 << u | 1 << v, near[u] & near[v], 0)


def grouped(meets: np.ndarray, homes: np.ndarray, n_old: int) -> np.ndarray:
    """The group of each node: n_old communities, then the new cliques (one row of meets each). homes: the node of each column.

    Least labels run from rows to columns and back until none changes.
    """
    n_new = len(meets)
    group = np.arange(n_old + n_new, dtype=np.int32)
    far = np.int32(n_old + n_new)
    while True:
        least = np.minimum(np.where(meets, group[homes], far).min(axis=1, initial=far), group[n_old:])
        down = np.where(meets, least[:, None], far).min(axis=0, initial=far)
        after = group.copy()
        after[n_old:] = least
        np.minimum.at(after, homes, down)
        if (after == group).all():
            return group
        group = after


class Sweep:
    """The maximal cliques of one growing graph, and their communities at every level.

    An edge only makes cliques that have both its ends, and only ends cliques that one end can join. An ended clique is part of a
    new one, so that its community goes on there; nothing else has to be looked at.
    """

    def __init__(self, n: int):
        self.words = max(1, -(-n // 64))
        self.near = [0] * n
        self.alive: list[int] = []
        self.rows = np.empty((0, self.words), np.uint64)
        self.homes = np.empty((0, 0), np.int64)  # of each clique and level the community's number, -1 above its dimension
        self.communities: list[dict[int, tuple[float, int]]] = []  # at each level: number -> birth, members
        self.next = 0
        self.out: list[tuple[int, float, float, list[int]]] = []
        self.joined: list[tuple[int, int, float, int, int]] = []  # of communities from before: number, level, when they merged, members, into what

    def start(self, edges: list[tuple[int, int]]) -> None:
        """The graph of these edges: its maximal cliques, their communities, numbered in canonical order and born before all others."""
        for u, v in edges:
            self.near[u] |= 1 << v
            self.near[v] |= 1 << u
        for v, own in enumerate(self.near):
            if own:
                later = own >> (v + 1) << (v + 1)
                self.alive += grown(self.near, 1 << v, later, own ^ later)
        self.rows = packed(self.alive, self.words)
        sizes = self.sizes()
        self.homes = np.full((len(self.alive), int(sizes.max(initial=0))), -1, np.int64)
        for i in range(len(self.alive)):
            shared = np.bitwise_count(self.rows[:i] & self.rows[i]).sum(axis=1)
            for q in range(int(sizes[i])):
                column = self.homes[:i, q]
                met = np.unique(column[shared > q])
                self.homes[i, q] = i
                if len(met):
                    column[np.isin(column, met)] = i
        every = self.canonical()
        self.communities = [{} for _ in range(self.homes.shape[1])]
        homes = np.full_like(self.homes, -1)
        for number, (q, old) in enumerate(every):
            own = np.flatnonzero(self.homes[:, q] == old)
            homes[own, q] = number
            members = 0
            for i in own.tolist():
                members |= self.alive[i]
            self.communities[q][number] = BEFORE, members
        self.homes, self.next = homes, len(every)

    def sizes(self) -> np.ndarray:
        return np.bitwise_count(self.rows).sum(axis=1, dtype=np.int64)

    def canonical(self) -> list[tuple[int, int]]:
        """(level, number) of all communities, by level and by the least of their cliques: alike in every task that has this graph."""
        places = {c: i for i, c in enumerate(sorted(self.alive, key=bits))}
        at, sizes, out = np.array([places[c] for c in self.alive], np.int64), self.sizes(), []
        for q in range(int(sizes.max(initial=0))):
            own = np.flatnonzero(sizes > q)
            numbers, where = np.unique(self.homes[own, q], return_inverse=True)
            least = np.full(len(numbers), len(places))
            np.minimum.at(least, where, at[own])
            out += [(q, int(numbers[i])) for i in np.argsort(least)]
        return out

    def step(self, t: float, edges: list[tuple[int, int]]) -> None:
        near, born, ended = self.near, [], set()
        for u, v in edges:
            one, two = 1 << u, 1 << v
            # a clique with u that lies within v's surroundings grows by v, and the other way round
            within = ((one, near[v]), (two, near[u]))
            near[u] |= two
            near[v] |= one
            fresh = around(near, u, v)
            ended |= {c for c in born if any(c & end and not c & ~(end | own) for end, own in within)}
            born += fresh
            for end, own in within:
                e, o = packed([end], self.words)[0], packed([end | own], self.words)[0]
                hit = ((self.rows & e).any(axis=1)) & ~((self.rows & ~o).any(axis=1))
                ended |= {self.alive[i] for i in np.flatnonzero(hit).tolist()}
        if not born:
            return
        rows = packed(born, self.words)
        sizes = np.bitwise_count(rows).sum(axis=1, dtype=np.int64)
        every = np.concatenate([self.rows, rows])
        shared = np.zeros((len(born), len(every)), np.int16)
        for w in range(self.words):
            shared += np.bitwise_count(rows[:, w, None] & every[None, :, w]).astype(np.int16)
        levels = max(self.homes.shape[1], int(sizes.max()))
        homes = np.full((len(every), levels), -1, np.int64)
        homes[: len(self.rows), : self.homes.shape[1]] = self.homes
        while len(self.communities) < levels:
            self.communities.append({})
        n_before = len(self.rows)
        for q in range(int(sizes.max())):
            own = np.flatnonzero(sizes > q)
            meets = shared[own] > q
            old = np.flatnonzero(meets[:, :n_before].any(axis=0))
            numbers, at = np.unique(homes[old, q], return_inverse=True)
            columns = np.concatenate([old, n_before + own])
            nodes = np.concatenate([at, len(numbers) + np.arange(len(own))]).astype(np.int32)
            group = grouped(meets[:, columns], nodes, len(numbers))
            self.merge(q, t, group, numbers, own, born, homes, n_before)
        keep = np.array([c not in ended for c in [*self.alive, *born]], bool)
        self.alive = [c for c, k in zip([*self.alive, *born], keep.tolist(), strict=True) if k]
        self.rows, self.homes = every[keep], homes[keep]

    def merge(self, q: int, t: float, group, numbers, own, born, homes, n_before: int) -> None:
        """Communities of one group become one, under the elder's birth."""
        found, alike = self.communities[q], {}
        for i, g in enumerate(group.tolist()):
            alike.setdefault(g, ([], []))[i >= len(numbers)].append(i)
        for old, new in alike.values():
            fresh = [own[i - len(numbers)] for i in new]
            if not fresh:
                continue
            members = 0
            for i in fresh:
                members |= born[i]
            if old:
                parts = [(int(numbers[i]), *found.pop(int(numbers[i]))) for i in old]
                before = [p for p in parts if p[1] == BEFORE]
                if len(before) > 1:  # who of them is the eldest is told by what came before
                    number, birth = self.next, BEFORE
                    self.next += 1
                    self.joined += [(p, q, t, m, number) for p, _, m in before]
                    self.out += [(q, b, t, bits(m)) for _, b, m in parts if b != BEFORE]
                else:
                    ranked = [(b, bits(m)) for _, b, m in parts] if len(parts) > 1 else []
                    first = elder(ranked) if ranked else 0
                    self.out += [(q, b, t, m) for i, (b, m) in enumerate(ranked) if i != first]
                    number, birth = parts[first][:2]
                for _, _, m in parts:
                    members |= m
                gone = [p[0] for p in parts if p[0] != number]
                if gone:
                    column = homes[:n_before, q]
                    column[np.isin(column, gone)] = number
            else:
                number, birth = self.next, t
                self.next += 1
            found[number] = birth, members
            homes[[n_before + i for i in fresh], q] = number

    def rows_of(self, at: int, last: bool) -> list[tuple[int | None, int | None, int, float | None, float | None, list[int] | None]]:
        """(node, up, q, birth, death, members) of range `at`: settled intervals without a node, and what the other ranges settle.

        node: a community from before this range, or one that reaches the next; up: what it merges into, or is there.
        """
        here, there = at << NODE, (at + 1) << NODE
        out = [(None, None, *r) for r in self.out]
        out += [(here | i, here | up, q, None, t, bits(m)) for i, q, t, m, up in self.joined]
        if last:
            for q, own in enumerate(self.communities):
                out += [(None, None, q, b, INF, bits(m)) if b != BEFORE else (here | i, None, q, None, INF, bits(m)) for i, (b, m) in own.items()]
            return out
        for place, (q, i) in enumerate(self.canonical()):
            birth = self.communities[q][i][0]
            out.append((here | i, there | place, q, None if birth == BEFORE else birth, None, None))
        return out


def swept_range(edges: list[tuple[int, int, float]], before: list[tuple[int, int]], at: int, last: bool) -> list[tuple]:
    """(node, up, q, birth, death, members) of one range of a graph's weighted edges, at all levels; before: the lighter edges."""
    names = sorted({x for e in (*edges, *before) for x in e[:2]})
    place = {x: i for i, x in enumerate(names)}
    steps: dict[float, list[tuple[int, int]]] = {}
    for u, v, w in edges:
        steps.setdefault(w, []).append((place[u], place[v]))
    sweep = Sweep(len(names))
    if before:
        sweep.start([(place[u], place[v]) for u, v in before])
    for t in sorted(steps):
        sweep.step(t, steps[t])
    return [(*r[:5], None if r[5] is None else [names[i] for i in r[5]]) for r in sweep.rows_of(at, last)]


def swept(edges: list[tuple[int, int, float]]) -> list[tuple[int, float, float, list[int]]]:
    """(q, birth, death, members) of one graph's weighted edges, at all levels."""
    return [r[2:] for r in swept_range(edges, [], 0, True)]


def ranges(edges: DataFrame, at_most: int) -> DataFrame:
    """Edges with `at`, the range of their weight, and `n`, the number of ranges: about at_most edges each, equal weights together.

    The borders are quantiles, which tasks sketch before the shuffle; a graph has CUTS + 1 ranges at most.
    """
    cuts = [i / (CUTS + 1) for i in range(1, CUTS + 1)]
    own = edges.groupBy("complex_id").agg(F.percentile_approx("w", cuts, 10_000).alias("cuts"), F.count("*").alias("edges"))
    every = F.greatest(F.lit(1), F.floor((CUTS + 1) / F.ceil(F.col("edges") / at_most)).cast("int"))  # of the cuts one in so many is a border
    borders = F.array_distinct(F.filter("cuts", lambda c, i: (i + 1) % F.col("every") == 0))
    own = own.withColumn("every", every).select("complex_id", F.when(F.col("edges") > at_most, borders).otherwise(F.array().cast("array<double>")).alias("borders"))
    rows = edges.join(own, "complex_id").withColumn("at", F.size(F.filter("borders", lambda b: b < F.col("w"))))
    return rows.select("complex_id", "u", "v", "w", "at", (F.size("borders") + 1).alias("n"))


def births(nodes: DataFrame) -> DataFrame:
    """(complex_id, node, birth): the least birth of what has gone into each node, over rows (complex_id, node, up, birth)."""
    rows = looped(nodes.select("complex_id", "node", "up", "birth"))
    while not rows.where("up is not null").isEmpty():
        given = rows.where("up is not null").groupBy("complex_id", F.col("up").alias("node")).agg(F.min("birth").alias("given"))
        above = rows.select("complex_id", F.col("node").alias("up"), F.col("up").alias("above"))
        rows = rows.join(given, ["complex_id", "node"], "left").join(above, ["complex_id", "up"], "left")
        rows = looped(rows.select("complex_id", "node", F.col("above").alias("up"), F.least("birth", "given").alias("birth")))
    return rows.drop("up")


def parted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges whose complex_id is the number of their connected part, and (part, name) of the parts, name being the complex's."""
    end = lambda x: F.struct("complex_id", F.col(x).alias("x"))
    roots = stars(edges.select(end("u").alias("a"), end("v").alias("b")))
    parts = durable(roots.select("root").distinct().withColumn("part", F.monotonically_increasing_id()))
    own = roots.join(sized(parts), "root").select(F.col("node.complex_id").alias("complex_id"), F.col("node.x").alias("u"), "part")
    rows = edges.join(own, ["complex_id", "u"]).select(F.col("part").alias("complex_id"), "u", "v", "w")
    return durable(rows), parts.select("part", F.col("root.complex_id").alias("name"))


def dense(edges: DataFrame, at_most: int | None = None) -> DataFrame:
    """The intervals of all levels. at_most: edges that a task lets rise, after all lighter ones of their connected part (RANGE).

    Communities of two parts never meet, so that graphs of more edges are cut into their connected parts. Where these have few cliques,
    all of them are listed, and a task sweeps a level of a part.
    """
    at_most = RANGE if at_most is None else at_most
    edges = durable(edges.select("complex_id", "u", "v", "w"))
    if edges.groupBy("complex_id").agg(F.count("*").alias("n")).where(F.col("n") > at_most).isEmpty():
        return dense_parts(edges, at_most)
    rows, parts = parted(edges)
    cliques = few_cliques(rows, FEW * rows.count())
    if cliques is None:
        found = dense_parts(rows, at_most)
    else:
        top = cliques.agg(F.max("size")).first()[0]
        found = capped(rows, top - 1, cliques)
    found = found.withColumnRenamed("complex_id", "part").join(sized(parts), "part")
    return found.select(F.col("name").alias("complex_id"), "q", "birth", "death", "members")


def dense_parts(edges: DataFrame, at_most: int) -> DataFrame:
    """dense, of edges whose complex_id tells what goes to one task."""
    kind = edges.schema["complex_id"].dataType.simpleString()
    rows = ranges(edges, at_most)
    rows = rows.withColumn("task", F.explode(F.sequence("at", F.col("n") - 1)))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["at"] == key[1]
        ends = lambda part: zip(part["u"].tolist(), part["v"].tolist(), strict=True)
        weights = pdf["w"][own].tolist()
        found = swept_range([(u, v, w) for (u, v), w in zip(ends(pdf[own]), weights, strict=True)], list(ends(pdf[~own])), int(key[1]), bool(key[1] == pdf["n"].iloc[0] - 1))
        node, up, q, birth, death, members = zip(*found, strict=True) if found else [()] * 6
        whole = lambda x: pd.Series(x, dtype="Int64")
        return pd.DataFrame({"complex_id": pd.Series([key[0]] * len(q), dtype=object), "node": whole(node), "up": whole(up), "q": q, "birth": pd.Series(birth, dtype="Float64"), "death": pd.Series(death, dtype="Float64"), "members": pd.Series(members, dtype=object)})

    found = rows.groupBy("complex_id", "task").applyInPandas(run, f"complex_id {kind}, node long, up long, q int, birth double, death double, members array<bigint>")
    found = durable(found)
    settled = found.where("node is null").select("complex_id", "q", "birth", "death", "members")
    nodes = found.where("node is not null")
    if nodes.isEmpty():
        return settled
    ended = nodes.where("death is not null").drop("birth").join(births(nodes), ["complex_id", "node"])
    # of those that merge at once the eldest lives on, under the name of what they merge into
    place = F.row_number().over(W.partitionBy("complex_id", F.coalesce("up", -1 - F.col("node"))).orderBy("birth", F.size("members").desc(), "members"))
    ended = ended.withColumn("place", place).where("place > 1 or up is null")
    return settled.unionByName(ended.select("complex_id", "q", "birth", "death", "members"))


def persistent_communities(edges: DataFrame, max_q: int | None = None, digits: int | None = None, statistics: Observation | None = None) -> DataFrame:
    """(complex_id, q, birth, death, size, members) of weighted edges (complex_id, u, v, w). digits: rounds the weights first.

    death is infinite for communities that last. statistics: gets the numbers of intervals and of lasting ones, the highest q and the
    most members, once an action has run.
    """
    if max_q is not None and max_q < 0:
        raise ValueError("max_q must not be negative")
    own = edges if digits is None else edges.withColumn("w", F.round("w", digits))
    own = clean_edges(own)
    found = dense(own) if max_q is None else capped(own, max_q)
    found = found.select("complex_id", "q", "birth", "death", F.size("members").alias("size"), "members")
    if statistics is None:
        return found
    lasting = F.sum((F.col("death") == INF).cast("long"))
    return found.observe(statistics, F.count("*").alias("intervals"), lasting.alias("lasting"), F.max("q").alias("highest_q"), F.max("size").alias("most_members"))


class Diagram:
    """The intervals of one complex, in canonical order: by q, birth, death and members."""

    def __init__(self, found: DataFrame):
        self.found = found

    def to_dataframe(self) -> DataFrame:
        return self.found.orderBy("q", "birth", "death", "members").select("q", "birth", "death", "size", "members")

    def numbered(self) -> DataFrame:
        """With the place i of each interval, from 0. One complex's intervals are ranked in one task."""
        place = F.row_number().over(W.partitionBy("complex_id").orderBy("q", "birth", "death", "members")) - 1
        return self.found.select(place.cast("long").alias("i"), "q", "birth", "death", "size", "members")

    def __len__(self) -> int:
        return self.found.count()

    def row(self, i: int):
        found = self.to_dataframe().offset(i).limit(1).collect() if i >= 0 else []
        if not found:
            raise IndexError(f"no interval {i}")
        return found[0]

    def __getitem__(self, i: int) -> tuple:
        r = self.row(i)
        return r.q, r.birth, r.death, list(r.members)

    def members(self, i: int) -> list[int]:
        return list(self.row(i).members)

    def size(self, i: int) -> int:
        return self.row(i)["size"]


def of_distance_matrix(rows: DataFrame, max_q: int | None = None, digits: int | None = None) -> DataFrame:
    return persistent_communities(edges_of_distances(rows), max_q, digits)


def of_edge_rows(rows: DataFrame, max_q: int | None = None, digits: int | None = None) -> DataFrame:
    return persistent_communities(edges_of_rows(rows), max_q, digits)
