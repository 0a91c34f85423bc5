"""Intervals in compressed rows: members of all intervals behind one another, and where each interval's begin and end.

intervals (complex_id, i, q, birth, death, first, last)   i from 0 in the order of q, birth, death and members; members are at
                                                          first <= position < last
members   (complex_id, position, vertex)

Both are Parquet tables, written by all tasks. Places are global without one task that counts: intervals are dealt to ranges of their
order, a range's rows and members are summed, and the sums of the ranges before it are added to its own running ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cliquora.operators.durable import durable

ORDER = ["q", "birth", "death", "members"]


def placed(found: DataFrame, ranges: int | None = None) -> DataFrame:
    """found (complex_id, q, birth, death, members) with i, first and last; ranges: how many, by default the shuffle's partitions.

    A complex has as many sums as ranges, so that their running totals are small. Equal intervals are placed in any order: their rows
    are equal. An interval without members has first = last.
    """
    keys = ["complex_id", *ORDER]
    dealt = found.repartitionByRange(*keys) if ranges is None else found.repartitionByRange(ranges, *keys)
    dealt = durable(dealt.select(*keys, F.spark_partition_id().alias("range")))
    here = ["complex_id", "range"]
    sums = dealt.groupBy(*here).agg(F.count("*").alias("rows"), F.sum(F.size("members")).cast("long").alias("n"))
    before = W.partitionBy("complex_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long")
    sums = sums.select(*here, so_far("rows").alias("rows"), so_far("n").alias("n"))
    own = W.partitionBy(*here).orderBy(*ORDER)
    size = F.size("members").cast("long")
    rows = dealt.withColumns({"place": F.row_number().over(own) - 1, "end": F.sum(size).over(own.rowsBetween(W.unboundedPreceding, 0))})
    last = F.col("n") + F.col("end")
    return rows.join(sums, here).select("complex_id", (F.col("rows") + F.col("place")).alias("i"), *ORDER, (last - size).alias("first"), last.alias("last"))


def write(found: DataFrame, path: str, ranges: int | None = None, mode: str = "errorifexists") -> None:
    """Both tables in the folder path, from intervals (complex_id, q, birth, death, members); files keep the order of the ranges."""
    rows = durable(placed(found, ranges))
    rows.drop("members").write.mode(mode).parquet(f"{path}/intervals")
    flat = rows.select("complex_id", "first", F.posexplode("members").alias("k", "vertex"))
    flat.select("complex_id", (F.col("first") + F.col("k")).alias("position"), "vertex").write.mode(mode).parquet(f"{path}/members")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(intervals, members) of a folder."""
    return spark.read.parquet(f"{path}/intervals"), spark.read.parquet(f"{path}/members")


def intervals(spark: SparkSession, path: str) -> DataFrame:
    """(complex_id, i, q, birth, death, size, members) of a folder: each interval asks for its positions, which meet the members by equality."""
    rows, members = read(spark, path)
    key = ["complex_id", "i", "q", "birth", "death"]
    some = rows.where("last > first").select(*key, F.explode(F.sequence(F.col("first"), F.col("last") - 1)).alias("position"))
    met = some.join(members, ["complex_id", "position"]).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("position", "vertex"))).alias("at"))
    full = met.select(*key, F.transform("at", lambda x: x["vertex"]).alias("members"))
    none = rows.where("last = first").select(*key, F.array().cast("array<bigint>").alias("members"))
    return full.unionByName(none).withColumn("size", F.size("members")).select(*key, "size", "members")
