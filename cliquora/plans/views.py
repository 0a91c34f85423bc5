"""Complexes and graphs over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cliquora.model import SimplicialComplex
from cliquora.operators.durable import SHARE, dealt, durable, shared_folder
from cliquora.operators.persistence import persistent_communities
from cliquora.sources import compressed


def zero():
    return F.lit(0).cast("long").alias("complex_id")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def complex_of(rows: DataFrame, sid: str, vertex: str, n: int) -> SimplicialComplex:
    """A simplex for each sid of the rows (n of them)."""
    own = dealt(rows.select(F.col(sid).cast("long").alias("sid"), F.col(vertex).cast("long").alias("vertex")), n, "sid")
    return SimplicialComplex(own.groupBy("sid").agg(F.collect_set("vertex").alias("members")))


def orders_complex(spark, sf_dir) -> SimplicialComplex:
    """A simplex is an order, its vertices are the suppliers."""
    lines = read(spark, sf_dir, "lineitem")
    return complex_of(lines, "l_orderkey", "l_suppkey", lines.count())


def suppliers_complex(spark, sf_dir) -> SimplicialComplex:
    """A simplex is a supplier, its vertices are the parts it has delivered."""
    lines = read(spark, sf_dir, "lineitem")
    return complex_of(lines, "l_suppkey", "l_partkey", lines.count())


def served_complex(spark, sf_dir) -> SimplicialComplex:
    """A simplex is a supplier, its vertices are the nations of those who have ordered from it."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    return complex_of(lines.join(o, "l_orderkey").join(c, "o_custkey"), "l_suppkey", "c_nationkey", lines.count())


def delivered(spark, sf_dir, returned: bool) -> DataFrame:
    """(complex_id, sid, vertex): suppliers and the parts of theirs that were, or were not, returned."""
    rows = read(spark, sf_dir, "lineitem").where((F.col("l_returnflag") == "R") == F.lit(returned))
    return rows.select(zero(), F.col("l_suppkey").cast("long").alias("sid"), F.col("l_partkey").cast("long").alias("vertex")).distinct()


def trade(spark, sf_dir) -> DataFrame:
    """(year, flag, u, v, n): lineitems between the nations of customer and supplier, u < v."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("cn"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("sn"))
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.year("o_orderdate").alias("year"))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag").join(o, "l_orderkey").join(c, "o_custkey").join(s, "l_suppkey")
    rows = rows.where("cn <> sn").select("year", (F.col("l_returnflag") == "R").alias("flag"), F.least("cn", "sn").alias("u"), F.greatest("cn", "sn").alias("v"))
    return rows.groupBy("year", "flag", "u", "v").agg(F.count("*").alias("n"))


def nation_weights(spark, sf_dir) -> DataFrame:
    """(complex_id, u, v, n) of all years."""
    return trade(spark, sf_dir).groupBy("u", "v").agg(F.sum("n").alias("n")).select(zero(), "u", "v", "n")


def nation_vertices(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "nation").select(zero(), F.col("n_nationkey").cast("long").alias("vertex"))


def nation_graph(spark, sf_dir) -> DataFrame:
    """Pairs of nations that trade more than the average pair: (complex_id, u, v, n)."""
    rows = nation_weights(spark, sf_dir).withColumn("mean", F.avg("n").over(W.partitionBy("complex_id")))
    return rows.where("n > mean").drop("mean")


def nation_complex(spark, sf_dir) -> SimplicialComplex:
    return SimplicialComplex.from_graph(nation_graph(spark, sf_dir), nation_vertices(spark, sf_dir))


def nation_distances(spark, sf_dir) -> DataFrame:
    """(complex_id, u, v, w): the more trade, the nearer; eight steps of equal width."""
    rows = nation_weights(spark, sf_dir)
    all_ = W.partitionBy("complex_id")
    top, low = F.max("n").over(all_), F.min("n").over(all_)
    return rows.select("complex_id", "u", "v", F.expr("cast(0 as double)").alias("zero"), top.alias("top"), low.alias("low"), "n").select("complex_id", "u", "v", F.expr("cast(((top - n) * 8) div (top - low + 1) as double)").alias("w"))


def region_distances(spark, sf_dir) -> DataFrame:
    """(complex_id, u, v, w) between the regions of customer and supplier."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_regionkey").cast("long").alias("r"))
    rows = trade(spark, sf_dir).groupBy("u", "v").agg(F.sum("n").alias("n"))
    rows = rows.join(n.select(F.col("k").alias("u"), F.col("r").alias("a")), "u").join(n.select(F.col("k").alias("v"), F.col("r").alias("b")), "v").where("a <> b")
    rows = rows.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.sum("n").alias("n"))
    return rows.select(zero(), "u", "v", (-F.col("n")).cast("double").alias("w"))


def label_matrix(spark, sf_dir) -> DataFrame:
    """(i, row): squared distances of the embeddings' label means, in the order of the labels, in units of 1e-6."""
    e = read(spark, sf_dir, "embeddings").where("label is not null").select("label", F.posexplode("embedding").alias("d", "x"))
    mean = e.groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    both = mean.alias("a").join(mean.alias("b"), "d").groupBy(F.col("a.label").alias("a"), F.col("b.label").alias("b")).agg(F.sum(F.pow(F.col("a.x") - F.col("b.x"), 2)).alias("w"))
    rows = both.groupBy("a").agg(F.transform(F.sort_array(F.collect_list(F.struct("b", "w"))), lambda x: F.round(x["w"], 3)).alias("row"))
    return rows.select((F.row_number().over(W.orderBy("a")) - 1).cast("long").alias("i"), "row")


def yearly(spark, sf_dir) -> DataFrame:
    """(grp, sample, u, v): each year's and flag's pairs of nations above that sample's average."""
    rows = trade(spark, sf_dir).withColumn("mean", F.avg("n").over(W.partitionBy("year", "flag")))
    return rows.where("n > mean").select(F.when(F.col("flag"), "returned").otherwise("kept").alias("grp"), F.col("year").alias("sample"), "u", "v")


def samples(spark, sf_dir) -> DataFrame:
    """(grp, sample) of every year with orders that were delivered."""
    return trade(spark, sf_dir).select(F.when(F.col("flag"), "returned").otherwise("kept").alias("grp"), F.col("year").alias("sample")).distinct()


def supplier_neighbours(spark, sf_dir, nearest: int = 3) -> DataFrame:
    """(complex_id, u, v, w): each supplier and those that share the most orders with it; the more orders, the nearer.

    Orders' lines are dealt to tasks by the order, and pairs by their first supplier, which both counts and ranks want.
    """
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("o"), F.col("l_suppkey").cast("long").alias("s"))
    size = lines.count()
    rows = dealt(lines, size, "o").distinct()
    both = rows.alias("a").join(rows.alias("b"), (F.col("a.o") == F.col("b.o")) & (F.col("a.s") != F.col("b.s"))).select(F.col("a.s").alias("u"), F.col("b.s").alias("v"))
    n = dealt(both, size, "u", share=SHARE).groupBy("u", "v").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("u").orderBy(F.col("n").desc(), "v"))
    near = n.withColumn("place", place).where(F.col("place") <= nearest)
    return near.select(zero(), F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), (-F.col("n")).cast("double").alias("w")).distinct()


def star_complexes(spark, sf_dir) -> SimplicialComplex:
    """A complex for each year and flag; a simplex is a nation with its later neighbours."""
    rows = yearly(spark, sf_dir)
    name = F.concat_ws(" ", "grp", "sample").alias("complex_id")
    return SimplicialComplex(rows.groupBy(name, F.col("u").alias("sid")).agg(F.collect_set("v").alias("members")))


def adjacency_rows(spark, sf_dir) -> DataFrame:
    """(i, row ARRAY<INT>): the adjacency matrix of the nation graph."""
    edges = nation_graph(spark, sf_dir).select("u", "v")
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    own = both.groupBy(F.col("u").alias("i")).agg(F.collect_set("v").alias("near"))
    every = nation_vertices(spark, sf_dir).select(F.col("vertex").alias("i"))
    places = every.agg(F.sort_array(F.collect_list("i")).alias("all"))
    rows = every.join(own, "i", "left").join(F.broadcast(places))
    return rows.select("i", F.transform("all", lambda j: F.coalesce(F.array_contains("near", j), F.lit(False)).cast("int")).alias("row"))


def coauthor_files(spark, sf_dir) -> str:
    """The folder of three texts in the format of co-authorship data sets: orders in order, their suppliers line by line (lines of one number by supplier), their years.

    Written to the shared checkpoint folder; each text is a folder of files, by ranges of the order.
    """
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), "l_linenumber", "l_suppkey")
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"), F.year("o_orderdate").alias("year"))
    orders = orders.join(lines.groupBy("o").agg(F.count("*").alias("n")), "o", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    durable(spark.range(1))  # sets the folder where it is unset
    folder = f"{spark.sparkContext.getCheckpointDir()}/coauthors-{uuid.uuid4().hex}"
    for name, rows, value in (("nverts", orders.orderBy("o"), "n"), ("simplices", lines.orderBy("o", "l_linenumber", "l_suppkey"), "l_suppkey"), ("times", orders.orderBy("o"), "year")):
        rows.select(F.col(value).cast("string").alias("value")).write.text(f"{folder}/orders-{name}.txt")
    return folder


def compressed_diagram(spark, sf_dir) -> str:
    """The folder of the nation graph's intervals (up to q = 1), written in compressed rows to the shared checkpoint folder."""
    found = persistent_communities(nation_distances(spark, sf_dir), 1)
    path = f"{shared_folder(found)}/diagram-{uuid.uuid4().hex}"
    compressed.write(found, path)
    return path
