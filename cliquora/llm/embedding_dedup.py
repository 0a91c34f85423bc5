"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products within them, one representative a group.

1. Equal vectors of a label are one class, found by a 128-bit hash: copies are counted, never compared with each other.
2. Spherical k-means is fitted on at most SAMPLE classes (drawn by the hash; the number of cells follows the largest label, at most
   CELLS). Every class goes to the cell of its nearest centroid, so that the index covers all rows.
3. Near vectors may lie on either side of a border. A class also visits each cell of a lower number whose border is near:
   (cosine to its own centroid - cosine to that one) <= margin * distance of the centroids, the left side being the distance to the border
   times that of the centroids. A margin of sin(angle of the threshold) loses nothing; a vector at random that far away crosses the
   border by that over the root of the dimension, and DEVIATIONS times this is the margin here (exact up to 16 dimensions).
   Visits to lower numbers only: a pair of different cells meets in the lower one, and only there.
4. Within a label's cell, residents are compared with residents and visitors by products of blocks of unit vectors in double
   precision. A cell of more than TILE classes is dealt to tiles, and each pair of tiles is a group of its own: no task has a large cell.
   A block gives a row for each class with links: how many vectors it is linked with (copies counted) and one link of a
   spanning forest. Pairs themselves never leave a block, so that a group of n near copies gives n rows a block.
5. Components by alternating stars over the forests; the least id of a component stays.

Vectors that are null, empty, zero, or hold nulls or non-finite numbers, and vectors without a label, link with nothing: they are kept
alone. Vectors of different lengths are never compared. Repeated rows link with each other like any copies. A null id never stands for
a group unless it is alone. Only the three named columns are read. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliquora.llm.common import durable, sized
from cliquora.operators.components import stars

LEAST = 0.98
#: Classes that the cells are fitted on, classes that a cell of the largest label should have, and the most cells.
SAMPLE, CELL, CELLS, ROUNDS = 65_536, 512, 4096, 8
DEVIATIONS, TILE = 4.0, 2048
#: A class of more vectors than this is joined by a broadcast of such classes.
HOT = 1000
NO_ID = 2**63 - 1


def is_sound(vector: str = "embedding") -> Column:
    """Whether a vector has a direction."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that squares neither vanish nor overflow."""
    x = np.asarray(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def k_means(x: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of unit vectors by cosine, as unit vectors. Starts from vectors spread over the sample; a cell left empty keeps its centroid."""
    found = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(rounds):
        home = np.concatenate([(x[i : i + 4096] @ found.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(found)
        np.add.at(total, home, x)
        size = np.sqrt((total * total).sum(axis=1, keepdims=True))
        found = np.where(size > 1e-12, total / np.maximum(size, 1e-12), found)
    return found


def classes_of(vectors: DataFrame) -> DataFrame:
    """(h, g, label, embedding, id, copies) of sound, labelled vectors (id, h, g, label, embedding): one row for equal ones."""
    return vectors.groupBy("h", "g").agg(F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding"), F.min("id").alias("id"), F.count("*").alias("copies"))


def fit(classes: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> dict[int, np.ndarray]:
    """Centroids by the vectors' length. The sample is bounded; which classes are in it depends on their hash alone."""
    n = classes.count()
    largest = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    chosen = classes.select("h", "g", "embedding")
    if n > sample:  # the limit is never met but by chance: the share of hashes is set for fewer
        chosen = chosen.where(F.pmod(F.col("h"), F.lit(1 << 30)) < int(0.98 * sample / n * (1 << 30))).limit(sample)
    rows = chosen.sort("h", "g").select("embedding").toArrow().column(0).combine_chunks() if n else pa.array([], pa.list_(pa.float32()))
    found, sizes = {}, rows.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes).tolist():
        own = rows.filter(pa.array(sizes == dim))
        cells = max(8, min(CELLS, -(-largest // cell), len(own) // 8))
        found[dim] = k_means(unit(matrix(own, dim)), cells)
    return found


def margin(dim: int, least: float = LEAST, deviations: float = DEVIATIONS) -> float:
    """The distance from a border within which a vector visits the other side."""
    return math.sqrt(max(0.0, 1 - least * least)) * min(1.0, deviations / math.sqrt(dim))


def assigned(classes: DataFrame, centroids: dict[int, np.ndarray], least: float = LEAST, deviations: float = DEVIATIONS) -> DataFrame:
    """Classes with dim and cells: the first is a class's home, the others it visits."""

    def near(own: np.ndarray, dim: int) -> list[list[int]]:
        if dim not in centroids:
            return [[0]] * len(own)
        c, out = centroids[dim], []
        apart = np.sqrt(np.maximum(0.0, 2 - 2 * (c @ c.T)))
        for i in range(0, len(own), 1024):
            s = unit(own[i : i + 1024]) @ c.T
            home = s.argmax(axis=1)
            gap = s[np.arange(len(s)), home][:, None] - s
            visits = (gap <= margin(dim, least, deviations) * apart[home] + 1e-9) & (np.arange(len(c))[None, :] < home[:, None])
            out += [[h, *np.flatnonzero(v).tolist()] for h, v in zip(home.tolist(), visits, strict=True)]
        return out

    def run(batches):
        for batch in batches:
            vectors = batch.column("embedding")
            sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
            cells: list = [None] * len(sizes)
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                for i, found in zip(own.tolist(), near(matrix(vectors.take(pa.array(own)), dim), dim), strict=True):
                    cells[i] = found
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int32()), pa.array(cells, pa.list_(pa.int32()))], [*batch.schema.names, "dim", "cells"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    return classes.mapInArrow(run, f"{kinds}, dim int, cells array<int>")


def forest(linked: np.ndarray) -> np.ndarray:
    """The least place that each is connected with, of a symmetric matrix of links."""
    n = len(linked)
    group = np.arange(n)
    while True:
        least = np.minimum(group, np.where(linked, group[None, :], n).min(axis=1, initial=n))
        least = np.minimum(least, least[least])
        if (least == group).all():
            return group
        group = least


def compared(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """(id, h, links, root_id, root_h) of one block's classes (id, h, copies, embedding, resident, left): those with links.

    left: of the lower tile. Of a block of one tile all are. A pair of two visitors meets elsewhere.
    """
    pdf = pdf.sort_values(["id", "h"], ignore_index=True)
    x = unit(np.stack(pdf["embedding"].to_numpy()))
    resident, left, copies = pdf["resident"].to_numpy(bool), pdf["left"].to_numpy(bool), pdf["copies"].to_numpy(np.int64)
    linked = x @ x.T >= least if left.all() else np.zeros((len(x), len(x)), bool)
    if not left.all():
        linked[np.ix_(left, ~left)] = x[left] @ x[~left].T >= least
        linked |= linked.T
    linked &= resident[:, None] | resident[None, :]
    np.fill_diagonal(linked, False)
    own = np.flatnonzero(linked.any(axis=1))
    linked, copies = linked[np.ix_(own, own)], copies[own]
    ids, hashes = pdf["id"].to_numpy(np.int64)[own], pdf["h"].to_numpy(np.int64)[own]
    root = forest(linked) if len(own) else own
    links = linked @ copies if len(own) else own
    return pd.DataFrame({"id": ids, "h": hashes, "links": links.astype(np.int64), "root_id": ids[root], "root_h": hashes[root]})


def linked_classes(classes: DataFrame, least: float = LEAST, tile: int = TILE) -> DataFrame:
    """(id, h, links, root_id, root_h) a block and class with links, of assigned classes."""
    rows = classes.select("label", "dim", "id", "h", "copies", "embedding", F.posexplode("cells").alias("visit", "cell"))
    at = ["label", "dim", "cell"]
    crowded = durable(rows.groupBy(*at).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")).where("tiles > 1"))
    rows = rows.select(*at, "id", "h", "copies", "embedding", (F.col("visit") == 0).alias("resident")).join(sized(crowded), at, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = F.pmod(F.shiftright("h", 20), F.col("tiles")).cast("int")
    rows = rows.withColumn("own", own).select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    rows = rows.select(*at, "id", "h", "copies", "embedding", "resident", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"))
    return rows.groupBy(*at, "i", "j").applyInPandas(lambda pdf: compared(pdf, least), "id long, h long, links long, root_id long, root_h long")


def near_duplicates(vectors: DataFrame, least: float = LEAST, deviations: float = DEVIATIONS, sample: int = SAMPLE, cell: int = CELL, tile: int = TILE, hot: int = HOT) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of vectors (vec_id, embedding, label)."""
    own = vectors.select("vec_id", "embedding", "label")
    rows = own.withColumns({"sound": is_sound() & F.col("label").isNotNull(), "id": F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)), "h": F.xxhash64("label", "embedding"), "g": F.xxhash64(F.lit("second"), "embedding", "label")})
    classes = durable(classes_of(rows.where("sound")))
    classes = durable(assigned(classes, fit(classes, sample, cell), least, deviations))
    found = durable(linked_classes(classes, least, tile))
    node = lambda i, h: F.struct(F.col(i).alias("id"), F.col(h).alias("h"))
    roots = stars(found.select(node("id", "h").alias("a"), node("root_id", "root_h").alias("b"))).select("node.*", F.col("root.id").alias("component"))
    links = found.groupBy("id", "h").agg(F.sum("links").alias("links"))
    # a class's own copies are linked with each other
    told = classes.select("id", "h", "g", "copies").join(links, ["id", "h"], "left").join(roots, ["id", "h"], "left")
    told = durable(told.select("h", "g", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")))
    one = F.when(F.col("component") != NO_ID, F.col("component"))
    ids, names = rows.where("sound").select("vec_id", "h", "g"), ["vec_id", "n_links", one.alias("component_id")]
    many = sized(durable(told.where(F.col("copies") > hot).drop("copies")))
    out = ids.join(many, ["h", "g"]).select(*names)
    out = out.unionByName(ids.join(many, ["h", "g"], "left_anti").join(told.where(F.col("copies") <= hot), ["h", "g"]).select(*names))
    out = out.unionByName(rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: All pairs of a label, in double precision, and the closure of the links.
ORACLE = """
WITH RECURSIVE sound AS (
  SELECT row_number() OVER () AS row_, vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
good AS (
  SELECT * FROM sound WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND list_bool_and(list_transform(x, lambda v: v IS NOT NULL AND isfinite(v))) AND list_bool_or(list_transform(x, lambda v: v <> 0))),
links AS (
  SELECT a.row_ AS a, b.row_ AS b, b.vec_id AS other FROM good a JOIN good b ON a.label = b.label AND a.row_ <> b.row_ AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
reach AS (
  SELECT row_ AS a, row_ AS b FROM sound
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS row_, min(vec_id) AS component_id FROM (SELECT r.a, s.vec_id FROM reach r JOIN sound s ON r.b = s.row_) GROUP BY a),
counts AS (SELECT a AS row_, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM sound JOIN least USING (row_) LEFT JOIN counts USING (row_)
"""
