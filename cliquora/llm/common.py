"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliquora.operators.durable import durable

__all__ = ["GAP", "SPACE", "WORD", "durable", "let", "n_words", "named", "positive_hash", "row_hash", "running", "sized", "table", "text_of", "words"]

#: The characters that separate words, and the words between them.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def n_words(column: str | Column) -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def words(text: Column) -> Column:
    """The words of a text that isn't null, as an array."""
    bare = F.trim(text, F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def let(value: Column, body) -> Column:
    """body(value), where value is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Items that a running total copies at a time.
RUN = 256


def running(items: Column, zero: Column, add) -> Column:
    """The totals up to and with each item, of the items' type; add is associative and zero its neutral element.

    An array grows by copying, so that totals run within blocks of RUN items, and from block to block.
    """
    def within(own: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.filter(own, lambda _: F.lit(False)).alias("all"))
        step = lambda acc, x: let(add(acc["at"], x), lambda now: F.struct(now.alias("at"), F.concat(acc["all"], F.array(now)).alias("all")))
        return F.aggregate(own, start, step)["all"]

    def joined(blocks: Column) -> Column:
        before = within(F.transform(blocks, lambda b: F.aggregate(b, zero, add)), zero)
        return let(before, lambda sums: F.flatten(F.transform(blocks, lambda b, i: within(b, F.coalesce(F.get(sums, i - 1), zero)))))

    blocks = lambda own: F.transform(F.sequence(F.lit(1), F.size(own), F.lit(RUN)), lambda i: F.slice(own, i, RUN))
    return let(items, lambda own: F.when(F.size(own) == 0, own).otherwise(let(blocks(own), joined)))


def positive_hash(*columns: Column) -> Column:
    """A 60-bit hash that other SQL engines can compute too."""
    key = F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def named(column: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def row_hash(rows: DataFrame, *without: str) -> Column:
    """A hash of all columns but those left out, of any name and type.

    What has no hash of its own (maps, variants) goes by its JSON, a map by its entries in order; of maps within other types, entries
    in another order give another hash.
    """
    def hashable(field) -> Column:
        c, kind = named(field.name), field.dataType.simpleString()
        if kind.startswith("map<"):
            return F.sort_array(F.transform(F.map_entries(c), lambda e: F.to_json(F.struct(e.alias("entry")))))
        return F.to_json(F.struct(c.alias("value"))) if "map<" in kind or "variant" in kind else c

    columns = [hashable(f) for f in rows.schema.fields if f.name not in without]
    return F.xxhash64(*columns) if columns else F.lit(0).cast("long")


#: Rows of a few numbers each that are sent to all tasks at most.
MAX_BROADCAST = 1_000_000


def sized(rows: DataFrame) -> DataFrame:
    """rows (written ones: they are counted) with a hint to send them to all tasks, where they are few enough."""
    return F.broadcast(rows) if rows.count() <= MAX_BROADCAST else rows
