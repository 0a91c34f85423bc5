"""Ranked lexical search of many queries at once: a join whose thresholds are seeded by stored impacts.

1. Each text is read once and becomes one row: how many terms it has, and of the terms that any query asks for the numbers and counts.
   The queries' terms are numbered a part of at most VOCABULARY at a time, so that what a task holds is bounded; more terms take more passes.
2. A posting's impact is what it adds to a score before the term's weight. Of each term the number of postings at each impact is kept
   (a count that tasks combine before the shuffle), which gives its document frequency, its largest impact and its kth largest one.
3. An item's kth score is at least the largest weighted kth impact of its terms: k documents have that from one term alone. Its terms are
   put in descending order of what they can add at most. Where the sum of the bounds from a term on (the suffix) is below the threshold,
   no document that has only terms from there on is among the best k: these terms make no candidates. They are the frequent ones.
4. The other terms' postings make the candidates, with what these terms add. The kth largest of those sums is a threshold again; a
   candidate stays if its sum and the bound of the terms left out reach it.
5. Those that stay are scored exactly from their rows, over all terms of the item, and ranked.

Nothing is cut: ties at a threshold stay, and a term of fewer than k postings seeds nothing.

Null texts have no terms. An item without terms that stand in any document has no rows. Repeated documents are ranked each by itself;
of equal scores the least id is first, null before all. Items of one id are answered each by itself. A very long text costs its length.
Only the named columns are read. An empty table of documents or items gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cliquora.llm.common import durable, sized

BEST = 20
#: Terms that a task looks up at a time: some tens of MB.
VOCABULARY = 200_000
#: Bytes as they count: A-Z as a-z, other ASCII characters but digits and letters as a space, all bytes of other characters as they are.
BYTES = bytes(b if b > 127 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(BYTES).split()


def text_bytes(rows: DataFrame) -> Column:
    return F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("text")


def vocabulary(items: DataFrame) -> DataFrame:
    """(term): the distinct terms of all texts."""

    def listed(batches):
        for batch in batches:
            found = set()
            for text in batch.column(0):
                found.update(terms(text.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([t.decode() for t in found], pa.string())], ["term"])

    return items.select(text_bytes(items)).mapInArrow(listed, "term string").distinct()


def numbered_terms(items: DataFrame, most: int = VOCABULARY) -> list[dict[bytes, int]]:
    """The items' terms with their numbers, in parts of about `most`: each a bounded table that goes to the tasks of one pass."""
    own = durable(vocabulary(items))
    parts, found, n = -(-own.count() // most), [], 0
    for part in range(parts):
        names = sorted(r.term.encode() for r in own.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == part).collect())
        found.append({name: n + i for i, name in enumerate(names)})
        n += len(names)
    return found or [{}]


def indexed(rows: DataFrame, name: str, number: dict[bytes, int]) -> DataFrame:
    """(row, name, n, tids, tfs): a row a text, with its number of terms and the counts of those that are numbered."""

    def read(batches):
        look_up = number.get
        for batch in batches:
            n, sizes, tids, tfs = [], [0], [], []
            for text in batch.column(2):
                own = terms(text.as_py())
                counts = Counter(map(look_up, own))
                counts.pop(None, None)
                n.append(len(own))
                tids += counts.keys()
                tfs += counts.values()
                sizes.append(len(tids))
            ends = pa.array(sizes, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.array(x, np.int64))) for x in (tids, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), *lists], ["row", name, "n", "tids", "tfs"])

    own = rows.select(F.monotonically_increasing_id().alias("row"), name, text_bytes(rows))
    kind = rows.schema[name].dataType.simpleString()
    return own.mapInArrow(read, f"row long, `{name}` {kind}, n long, tids array<long>, tfs array<long>")


def postings(index: DataFrame, *columns: str) -> DataFrame:
    """(columns, tid, tf) of an index."""
    return index.select(*columns, F.inline(F.arrays_zip(F.col("tids").alias("tid"), F.col("tfs").alias("tf"))))


def statistics(posted: DataFrame, documents: int, best: int) -> DataFrame:
    """(tid, weight, top, kth): a term's weight, its largest impact and its kth largest one (0 with fewer postings)."""
    counts = posted.groupBy("tid", "impact").agg(F.count("*").alias("c"))
    so_far = F.sum("c").over(W.partitionBy("tid").orderBy(F.col("impact").desc()).rowsBetween(W.unboundedPreceding, 0))
    own = counts.withColumn("so_far", so_far).groupBy("tid").agg(F.sum("c").alias("df"), F.max("impact").alias("top"), F.max(F.when(F.col("so_far") >= best, F.col("impact"))).alias("kth"))
    weight = F.floor(1000 * F.log((2.0 * documents + 2) / (2 * F.col("df") + 1)))
    return own.select("tid", weight.alias("weight"), "top", F.coalesce("kth", F.lit(0)).alias("kth"))


def search(documents: DataFrame, items: DataFrame, best: int = BEST, most: int = VOCABULARY) -> DataFrame:
    """(item_id, rank, doc_id, score): the best documents (doc_id, text) of each item (item_id, text)."""
    items = items.select("item_id", "text")
    parts = numbered_terms(items, most)
    read = lambda rows, name: [durable(indexed(rows, name, part)) for part in parts]
    union = lambda tables: tables[0] if len(tables) == 1 else union([tables[0].unionByName(tables[1]), *tables[2:]])
    texts, asked = read(documents, "doc_id"), read(items, "item_id")
    total = texts[0].agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    length = F.expr(f"(cast(25 as decimal(38,0)) * n * {total.documents}) div {max(total.length, 1)}")  # the product may pass 64 bits
    index = union(texts).withColumn("m", 75 + length)
    impact = F.expr("(1000000000 * tf) div (1000 * tf + 12 * m)").alias("impact")
    posted = postings(index, "row", "m").select("row", "tid", impact)

    stats = durable(statistics(posted, total.documents, best))
    own = postings(union(asked).withColumnRenamed("row", "item"), "item", "item_id").join(sized(stats), "tid")
    own = own.select("item", "item_id", "tid", (F.col("tf") * F.col("weight")).alias("weight"), (F.col("tf") * F.col("weight") * F.col("top")).alias("bound"), (F.col("tf") * F.col("weight") * F.col("kth")).alias("seed"))
    suffix = F.sum("bound").over(W.partitionBy("item").orderBy("bound", "tid").rowsBetween(W.unboundedPreceding, 0))
    own = own.withColumn("threshold", F.greatest(F.max("seed").over(W.partitionBy("item")), F.lit(1))).withColumn("suffix", suffix)
    own = durable(own.withColumn("seeks", F.col("suffix") >= F.col("threshold")))
    # what the terms that make no candidates can add: the largest suffix below the threshold
    left = own.groupBy("item").agg(F.max("threshold").alias("threshold"), F.coalesce(F.max(F.when(~F.col("seeks"), F.col("suffix"))), F.lit(0)).alias("rest"))

    seeking = sized(durable(own.where("seeks").select("item", "tid", "weight")))
    partly = durable(posted.join(seeking, "tid").groupBy("item", "row").agg(F.sum(F.col("weight") * F.col("impact")).alias("part")).join(sized(durable(left)), "item").where("part + rest >= threshold"))
    place = F.row_number().over(W.partitionBy("item").orderBy(F.col("part").desc(), "row"))
    kth = durable(partly.withColumn("place", place).where(F.col("place") <= best).where(F.col("place") == best).select("item", F.col("part").alias("kth")))
    stay = durable(partly.join(sized(kth), "item", "left").where("part + rest >= coalesce(kth, 0)").select("item", "row"))

    rows = index.join(sized(stay), "row")
    every = sized(own.select("item", "item_id", "tid", "weight"))
    scored = postings(rows, "item", "row", "doc_id", "m").select("item", "row", "doc_id", "tid", impact).join(every, ["item", "tid"])
    scored = scored.groupBy("item", "item_id", "row", "doc_id").agg(F.sum(F.col("weight") * F.col("impact")).alias("score")).where("score > 0")
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.col("score").desc(), "doc_id", "row"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score")


#: The same in SQL, over all pairs of an item and a document that share a term.
ORACLE = r"""
WITH cut AS (SELECT row_number() OVER () AS row_, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
sized AS (SELECT row_, doc_id, len(terms)::BIGINT AS n, terms FROM cut WHERE len(terms) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM sized),
posted AS (SELECT row_, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT row_, doc_id, n, unnest(terms) AS term FROM sized) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM posted, total GROUP BY term, docs),
asked AS (
  SELECT item, item_id, term, count(*)::BIGINT AS times FROM (
    SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
scored AS (
  SELECT item, item_id, row_, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN posted USING (term), total GROUP BY item, item_id, row_, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST, row_) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
