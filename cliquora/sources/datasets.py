"""Timestamped hypergraphs in three parallel texts: sizes, vertices, times.

A text is a file, or a folder of files as Spark writes them, which follow one another in the order of their names (shorter names first,
as part 100000 comes after part 99999). Files that can be split are read by ranges of bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cliquora.operators.durable import durable, sized

#: Name -> (folder, file prefix) of data sets on local or shared storage; register() adds to it. Nothing is downloaded.
DATASETS: dict[str, tuple[str, str]] = {}


def register(name: str, folder: str, prefix: str) -> None:
    DATASETS[name] = (folder, prefix)


def numbered_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(line, name): the numbers of a text with their line numbers from 0. Empty lines count, but have no row.

    Line numbers come in two steps, so that no task sees the whole text: the lines of each range of bytes, then the ranges' starts.
    A line belongs to the range that it begins in, and the lines of a range have consecutive ids. A folder without files has no rows.
    """
    where = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    lines = spark.read.text(path).select(*where, F.monotonically_increasing_id().alias("id"), F.trim("value").alias("value"))
    counts = lines.groupBy("file", "at").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.sum("n").over(W.orderBy(F.length("file"), "file", "at")) - F.col("n")
    starts = sized(durable(counts.select("file", "at", (before - F.col("first")).alias("shift"))))
    return lines.join(starts, ["file", "at"]).where("value <> ''").select((F.col("id") + F.col("shift")).alias("line"), F.col("value").cast("long").alias(name))


def read_coauthors(spark: SparkSession, folder: str, prefix: str) -> DataFrame:
    """(year, sid, vertices): sid is the position in the files; vertices as written, not deduplicated, in order."""
    sizes = numbered_lines(spark, f"{folder}/{prefix}-nverts.txt", "n")
    vertices = numbered_lines(spark, f"{folder}/{prefix}-simplices.txt", "vertex")
    years = numbered_lines(spark, f"{folder}/{prefix}-times.txt", "year")
    # running sums in two steps: blocks of lines, then within a block
    block = F.floor(F.col("line") / 65536)
    blocks = sizes.groupBy(block.alias("block")).agg(F.sum("n").alias("total"))
    blocks = blocks.select("block", (F.sum("total").over(W.orderBy("block")) - F.col("total")).alias("before"))
    own = sizes.withColumn("block", block).join(sized(durable(blocks)), "block")
    start = F.col("before") + F.sum("n").over(W.partitionBy("block").orderBy("line")) - F.col("n")
    # every slot of a simplex is a line of the vertex file: an equi-join instead of a range join
    slots = own.select(F.col("line").alias("sid"), "n", start.alias("start")).where("n > 0").select("sid", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("line"))
    members = slots.join(vertices, "line").groupBy("sid").agg(F.transform(F.sort_array(F.collect_list(F.struct("line", "vertex"))), lambda x: x["vertex"]).alias("vertices"))
    rows = years.withColumnRenamed("line", "sid").join(members, "sid", "left")
    return rows.select(F.col("year").cast("int").alias("year"), "sid", F.coalesce("vertices", F.array().cast("array<bigint>")).alias("vertices"))


def load_dataset(spark: SparkSession, name: str) -> DataFrame:
    if name not in DATASETS:
        raise ValueError(f"unknown data set {name!r}; registered: {sorted(DATASETS)}")
    return read_coauthors(spark, *DATASETS[name])
