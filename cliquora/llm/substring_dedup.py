r"""Substring dedup by line hashing, with long lines cut where their own words say.

Units. A text's lines, and within a line its pieces: a piece ends after a word whose hash with the word before it is 0 mod CUT
(five words on average), or with the line. Where a piece ends depends on two neighbouring words alone, so that an equal passage
is cut alike wherever it stands, in the middle of a line too; equal lines have equal pieces. Units are normalised (case folded,
words joined by one space) and hashed to 128 bits.

Rank. Units are shuffled once, by digest, and those of a digest sorted by rank. The occurrence of the least (key, text hash,
position) stays, every other one is a repeat; rows without a key rank last, so that a null key keeps a unit only where no other row
has it.

Removal. Repeats that follow one another make a run, which goes from its first unit to its last; lines without a word lie between
units and go with a run around them. min_words leaves runs of fewer words alone; by default (1) every repeat goes.

Removed spans keep their offsets in the original text (code points, end exclusive); the rest of the text is what lies between.
Null and empty texts have no units and stay as they are. Repeated rows with the same key and text are one text. Ties don't occur:
the rank is total. A very long text is cut in blocks of bounded size; its units are rows, never one array in a fold. A unit that
very many texts have is sorted in one task, which spills beyond its memory. Columns of documents are never renamed, and none of
theirs can clash with this module's. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: One in CUT pairs of words ends a unit. Characters of a text that are cut at a time.
CUT, BLOCK = 5, 1 << 20

SEED = 42
UNITS = "key {kind}, copy long, start array<long>, end array<long>, words array<int>, high array<long>, low array<long>"


def word_edges(piece: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The start and end of each word, and the number of line feeds before it."""
    codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    return starts, ends, np.searchsorted(np.flatnonzero(codes == 10), starts)


def last_words(words: list[bytes], line: np.ndarray, cut: int, before: bytes | None = None) -> np.ndarray:
    """Which words end a unit: the last ones of lines, and those whose hash with the word before in their line is 0 mod cut.

    line: the line feeds before each word since the word `before`.
    """
    own = np.fromiter(map(crc32, words), np.uint64, len(words))
    earlier = np.concatenate([np.array([crc32(before or b"")], np.uint64), own])[:-1]
    new_line = np.diff(line, prepend=line[:1] * 0 if before is not None else -1) != 0
    mixed = (own * np.uint64(31) + earlier) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    ends = (mixed % np.uint64(cut) == 0) & ~new_line
    ends |= np.concatenate([new_line[1:], [True]])[: len(words)]
    return np.flatnonzero(ends)


def units_of(text: str, cut: int = CUT, block: int = BLOCK) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, words, digest) of each unit, in order."""
    at, size, before = 0, block, None
    while at < len(text):
        piece, final = text[at : at + size], at + size >= len(text)
        starts, ends, line = word_edges(piece)
        words = piece.casefold().encode("utf-8", "surrogatepass").split()
        lasts = last_words(words, line, cut, before)
        if not final:
            # the last word may go on in the next block, and then it ends no unit yet; nor does the word before a line's end unseen
            lasts = lasts[lasts < len(words) - 1]
            if not len(lasts):
                # a unit longer than the block is read with more
                size *= 2
                continue
        first = 0
        for last in lasts.tolist():
            yield at + int(starts[first]), at + int(ends[last]), last + 1 - first, xxhash.xxh3_128_intdigest(b" ".join(words[first : last + 1]), SEED)
            first = last + 1
        if final:
            return
        at, size, before = at + int(ends[first - 1]), block, words[first - 1]


def units(documents: DataFrame, key: str = "doc_id", text: str = "text", cut: int = CUT) -> DataFrame:
    """A row for each unit: key, copy (the text's hash), unit (its number), start, end, words, high and low (the digest)."""
    kind = documents.schema[key].dataType.simpleString()
    half = (1 << 64) - 1

    def cut_up(batches):
        for batch in batches:
            sizes, columns = [], []
            for t in batch.column(2):
                own = np.array([(a, b, n, d >> 64, d & half) for a, b, n, d in units_of(t.as_py() or "", cut)], np.uint64).reshape(-1, 5)
                sizes.append(len(own))
                columns.append(own)
            ends = pa.array(np.cumsum([0, *sizes]).astype(np.int32))
            rows = np.concatenate([np.empty((0, 5), np.uint64), *columns]).view(np.int64)
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(rows[:, i]), pa.int64()).cast(pa.int32() if i == 2 else pa.int64())) for i in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["key", "copy", "start", "end", "words", "high", "low"])

    # rows with equal keys are told apart by the text's hash; equal rows are one
    copy = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    lists = documents.select(F.col(key).alias("key"), copy.alias("copy"), F.col(text).alias("text_")).mapInArrow(cut_up, UNITS.format(kind=kind))
    each = lists.select("key", "copy", F.posexplode(F.arrays_zip("start", "end", "words", "high", "low")).alias("unit", "u"))
    return each.select("key", "copy", "unit", "u.start", "u.end", "u.words", "u.high", "u.low")


def repeated_spans(documents: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 1, cut: int = CUT) -> DataFrame:
    """A row for each span that goes: key, copy (the text's hash), start, end, words, keeper (the key of the text that keeps the span's first unit)."""
    each = units(documents, key, text, cut).withColumn("none", F.col("key").isNull())
    rank = F.struct("none", "key", "copy", "unit")
    ranked = W.partitionBy("high", "low").orderBy("none", "key", "copy", "unit").rowsBetween(W.unboundedPreceding, W.currentRow)
    repeats = each.withColumn("first", F.first(rank).over(ranked)).where(~rank.eqNullSafe(F.col("first")))
    # one shuffle by text serves both the repeated rows and the runs
    repeats = repeats.select("key", "copy", "unit", "start", "end", "words", F.col("first.key").alias("keeper")).repartition("key", "copy")
    repeats = repeats.dropDuplicates(["key", "copy", "unit"])
    # units that follow one another have the same number less their place among the text's repeats
    place = F.row_number().over(W.partitionBy("key", "copy").orderBy("unit"))
    runs = repeats.withColumn("run", F.col("unit") - place).groupBy("key", "copy", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"), F.min_by("keeper", "unit").alias("keeper"))
    return runs.where(F.col("words") >= min_words).select(F.col("key").alias(key), "copy", "start", "end", "words", "keeper")


def cut_out(text: str | None, starts, ends) -> str | None:
    """What is left without the spans; the line feed after a span that is whole lines goes with it."""
    if text is None or starts is None:
        return text
    out, at = [], 0
    for a, b in sorted(zip(starts, ends, strict=True)):
        out.append(text[at:a])
        at = b + 1 if text[b : b + 1] == "\n" and (a == 0 or text[a - 1] == "\n") else b
    return "".join([*out, text[at:]])


def remove_spans(documents: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """documents with what is left of each text, all other columns as they are."""
    own = spans.groupBy(F.col(key).alias("key_"), F.col("copy").alias("copy_")).agg(F.collect_list("start").alias("starts_"), F.collect_list("end").alias("ends_"))
    rows = documents.select(F.struct("*").alias("row_"), F.col(key).alias("own_key_"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("own_copy_"))
    rows = rows.join(own, F.col("own_key_").eqNullSafe(F.col("key_")) & (F.col("own_copy_") == F.col("copy_")), "left")

    @F.pandas_udf("string")
    def left(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([cut_out(*x) for x in zip(texts, starts, ends, strict=True)], dtype=object)

    return rows.withColumn("left_", left("row_." + text, "starts_", "ends_")).select(*[F.col("left_").alias(c) if c == text else F.col("row_")[c].alias(c) for c in documents.columns])
