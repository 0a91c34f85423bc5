"""SimHash near-duplicates by pivot distance tables.

1. Each text gets a 64-bit fingerprint of its shingles (Python: hashing is the cost, and numpy counts the bits).
2. Equal fingerprints are one class: all further work is on distinct fingerprints, so large groups of copies cost nothing.
3. The pivot table has the Hamming distances of every fingerprint to two kinds of reference fingerprints. BLOCKS pivots each have
   ones in one block of bits, and one pivot is zero: (distance to zero + size of the block - distance to the block's pivot) / 2 is
   how many ones a fingerprint has in the block, so that these coordinates move in few places. PIVOTS more have well-mixed bits.
4. Candidates come from the table: a pair at `most` bits or fewer has equal block coordinates but in `most` blocks at the most.
   So fingerprints meet in a cell for each choice of `most` blocks that don't count, by the coordinates of all others.
5. No coordinate differs by more than the distance: pairs whose distances to a well-mixed pivot differ by more are discarded.
   Survivors are verified exactly.
6. Cells of more than CELL fingerprints would mean many pairs. Their fingerprints (crowded ones) are compared with each other
   another exact way: each gives itself and all points within half of `most` (rounded up) bits, and two are within `most` bits only
   if they share a point. For two bits that is 65 rows a fingerprint. Pairs of a point are not formed: its fingerprints are linked
   with its least one, which connects the same fingerprints if `most` is even, as two of them are then within `most` bits; for an
   odd one the pairs at a point are formed and verified.
7. Components by alternating large and small stars over the links, each round written to the checkpoint folder.

At any size this is at most C(BLOCKS, most) + 65 rows and C(BLOCKS, most) * CELL pairs a fingerprint.

Null and empty texts have the fingerprint zero and link like any other. Ties and repeated rows fall into one class; a null key is
never the least one, unless it is alone. A very long text costs its length, and its hashes are counted in blocks. Only the two named
columns are read. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliquora.llm.common import durable, sized
from cliquora.operators.components import stars

SHINGLE, SEED, MOST = 3, 42, 2
#: At most 8 well-mixed pivots and 14 blocks fit in the two numbers of the table.
PIVOTS, BLOCKS, CELL = 8, 10, 256


def hashes(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle: lower-case A-Z, words between ASCII white space, joined by one space."""
    own = text.lower().split()
    if not own:
        return np.empty(0, np.uint64)
    line = b" ".join(own)
    if len(own) <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    sizes = np.fromiter(map(len, own), np.int64, len(own)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    digest, seed = xxhash.xxh64_intdigest, SEED
    return np.fromiter((digest(line[a:b], seed) for a, b in zip(starts[: len(own) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, len(own) - width + 1)


def fingerprint(own: np.ndarray) -> int:
    """Bit b is 1 if more than half of the hashes have it. As a signed 64-bit number."""
    if not len(own):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(own), 1 << 16):
        bits = np.unpackbits(own[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(own), bitorder="little").view("<i8")[0])


def with_fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """key, fp (signed 64 bits) of every row."""

    def marked(batches):
        for batch in batches:
            fps = [fingerprint(hashes(t.as_py() or b"", width)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], [key, "fp"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, F.col(text).cast("binary").alias("text_")).mapInArrow(marked, f"`{key}` {kind}, fp long")


def signed(x: int) -> int:
    """An unsigned 64-bit number as a signed one."""
    return x - (1 << 64) if x >> 63 else x


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints, as signed numbers: well-mixed bits, the same at every run."""
    return [signed(xxhash.xxh64_intdigest(b"pivot %d" % i, SEED)) for i in range(n)]


def block_pivots(n: int = BLOCKS) -> list[tuple[int, int]]:
    """Of each block of bits the pivot that has its bits (signed), and its size."""
    edges = [64 * i // n for i in range(n + 1)]
    return [(signed(((1 << (b - a)) - 1) << a), b - a) for a, b in zip(edges, edges[1:], strict=False)]


def distance(fp: Column, pivot: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(pivot))).cast("long")


def with_table(fingerprints: DataFrame) -> DataFrame:
    """fp with its pivot table in two numbers: near_ (block coordinates, 4 bits each) and far_ (distances to mixed pivots, 8 bits each)."""
    fp = F.col("fp")
    near, far = F.lit(0).cast("long"), F.lit(0).cast("long")
    for i, (pivot, size) in enumerate(block_pivots()):
        ones = F.shiftright(distance(fp, 0) + size - distance(fp, pivot), 1)
        near = near.bitwiseOR(F.shiftleft(ones, 4 * i))
    for i, pivot in enumerate(pivots()):
        far = far.bitwiseOR(F.shiftleft(distance(fp, pivot), 8 * i))
    return fingerprints.select("fp", near.alias("near_"), far.alias("far_"))


def cells(most: int) -> Column:
    """A cell for each choice of `most` blocks: which ones, and the coordinates of all others."""
    out = []
    for i, free in enumerate(combinations(range(BLOCKS), most)):
        kept = sum(15 << 4 * k for k in range(BLOCKS) if k not in free)
        out.append(F.col("near_").bitwiseAND(F.lit(kept)).bitwiseOR(F.lit(i << 4 * BLOCKS)))
    return F.array(*out)


def within(most: int) -> Column:
    """No distance of a to a mixed pivot differs from b's by more than `most`."""
    close = F.lit(True)
    for i in range(PIVOTS):
        own = lambda x, i=i: F.shiftright(F.col(x), 8 * i).bitwiseAND(F.lit(255))
        close = close & (F.abs(own("ta") - own("tb")) <= most)
    return close


def at_points(crowded: DataFrame, most: int) -> DataFrame:
    """Links a < b that connect all crowded fingerprints at `most` bits or fewer, through points between them."""
    half = (most + 1) // 2
    if half > 2:
        raise ValueError("large cells have no affordable exact way beyond four bits")
    flips = [signed(sum(1 << i for i in c)) for n in range(half + 1) for c in combinations(range(64), n)]
    around = crowded.select("fp", F.explode(F.array(*[F.lit(x) for x in flips])).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))
    least = around.groupBy("at").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    if most % 2 == 0:
        return around.join(least, "at").where("fp != a").select("a", F.col("fp").alias("b"))
    shared = around.join(least, "at").select("at", "fp")
    both = shared.alias("l").join(shared.alias("r"), (F.col("l.at") == F.col("r.at")) & (F.col("l.fp") < F.col("r.fp"))).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
    return both.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most)


def links(fingerprints: DataFrame, most: int = MOST, cell: int = CELL) -> DataFrame:
    """Links a < b that connect all distinct fingerprints (column fp) at most `most` bits apart."""
    placed = with_table(fingerprints).select("fp", "far_", F.explode(cells(most)).alias("cell"))
    large = durable(placed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > cell).select("cell"))
    some = not large.isEmpty()
    small = placed.join(sized(large), "cell", "left_anti") if some else placed
    a = small.select("cell", F.col("fp").alias("a"), F.col("far_").alias("ta"))
    b = small.select("cell", F.col("fp").alias("b"), F.col("far_").alias("tb"))
    exact = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most
    found = a.join(b, (a["cell"] == b["cell"]) & (F.col("a") < F.col("b")) & within(most) & exact).select("a", "b")
    if some:
        found = found.unionByName(at_points(placed.join(sized(large), "cell", "left_semi").select("fp").distinct(), most))
    return found.distinct()


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE, most: int = MOST) -> DataFrame:
    """key, fp, component_id (the least key that is reachable, itself included) of every row."""
    marked = durable(with_fingerprints(documents, key, text, width))
    distinct = durable(marked.groupBy("fp").agg(F.min(key).alias("least")))
    found = stars(links(distinct.select("fp"), most))
    classes = distinct.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = durable(classes)
    # only classes of several fingerprints need another one's least key
    merged = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = classes.join(merged, "root").select("fp", "component_id")
    return marked.join(of_fp, "fp").select(key, "fp", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
