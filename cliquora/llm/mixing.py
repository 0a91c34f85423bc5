"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

1. One pass over the texts makes a slim table (id, source, size, hash), written to the checkpoint folder.
2. Targets: a share of all words is dealt to the sources by weight; no source gets more than `cap` times its words, and what
   it can't take is dealt again by weight, until none is above. That is the water level of min(level * weight, cap * size).
3. A source's target is so many whole copies of all its rows and a rest. For the rest, words are summed by source and the
   leading bits of the row's hash; the running sum crosses the rest in one bucket of each source. Only that bucket is
   refined by the next bits, until a source's bucket holds one hash. The rows with a smaller hash are in, those of the
   boundary hash if that comes nearer to the target.
4. A filter on the hash decides each row. Nothing is sorted, and no group meets in a task: sums are combined before each
   shuffle, and a row finds its source's threshold in a broadcast table while there are at most MAX_BROADCAST sources, else
   in a join that Spark splits where it is skewed.

Null texts have size 0. The null source is a source like others, the last in order. Rows with equal keys (ids; a null id is one)
share one hash and so one fate: a source misses its target by half of the words of the rows of one key at most, which is half a
document where ids are unique. The windows over sources (ranks, the water level) have one row a source and run in one task: that
is meant for up to some millions of sources. A very long text is one size. Columns with clashing names are neither read nor lost:
keys and rows travel in a struct. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cliquora.llm.common import durable, n_words, positive_hash

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2
BITS, STEP = 60, 10
MAX_BROADCAST = 50_000


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size -> with weight and target (double). One row a source comes in and goes out."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int")).cast("long")
    s = sources.withColumn("weight", weight)
    # In order of cap * size / weight the sources that get all they can take come first. Were all before one such sources, the
    # rest would be shared at the level below; it is right at the first source that can take its share, and falls from there.
    full = W.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = full.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(0).alias("all"))
    s = s.withColumns({
        "before": F.coalesce(F.sum("source_size").over(before), F.lit(0)),
        "left": F.sum("weight").over(full.rowsBetween(0, W.unboundedFollowing)),
        "total": F.sum("source_size").over(everything),
    })
    level = (F.lit(share) * F.col("total") - F.lit(cap) * F.col("before")) / F.col("left")
    fits = F.lit(cap) * F.col("source_size") >= level * F.col("weight")
    s = s.withColumn("level", F.max(F.when(fits, level)).over(everything))
    top = (F.lit(cap) * F.col("source_size")).cast("double")
    target = F.least(top, F.coalesce(F.col("level") * F.col("weight"), top))
    return s.select("source", "source_size", "weight", target.alias("target"))


def beside(rows: DataFrame, small: DataFrame, few: bool) -> DataFrame:
    """rows with their source's row of small (columns source_, ...)."""
    return rows.join(F.broadcast(small) if few else small, F.col("source").eqNullSafe(F.col("source_")), "inner").drop("source_")


def plan_of(slim: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> tuple[DataFrame, bool]:
    """Of rows (source, size, hash_) the plan: source_, source_size, target, whole (copies of every row), last (the greatest hash that has one more); and whether its rows are few."""
    sums = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sums, weights, share, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = durable(plan.withColumnRenamed("source", "source_"))
    few = plan.count() <= MAX_BROADCAST
    # state: of each source that isn't decided the bucket that the rest falls in (its leading bits) and the words before it.
    state = plan.where("rest > 0").select("source_", "rest", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("below"))
    ends = None
    for shift in range(BITS - STEP, -1, -STEP):
        inside = beside(slim.where("size > 0"), state, few).where(F.shiftright("hash_", shift + STEP) == F.col("bucket"))
        cells = inside.groupBy("source", "rest", "below", F.shiftright("hash_", shift).alias("cell")).agg(
            F.sum("size").alias("words"), F.min("hash_").alias("low"), F.max("hash_").alias("high"))
        upto = W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
        cells = cells.withColumn("below", F.col("below") + F.coalesce(F.sum("words").over(upto), F.lit(0)))
        cut = cells.where("below < rest and rest <= below + words")
        cut = durable(cut.select(F.col("source").alias("source_"), "rest", F.col("cell").alias("bucket"), "below", "words", "low", "high"))
        done = cut.where("low = high").select("source_", F.expr("case when below + words - rest < rest - below then low else low - 1 end").alias("last"))
        ends = done if ends is None else ends.unionByName(done)
        state = cut.where("low < high").select("source_", "rest", "bucket", "below")
        if state.isEmpty():
            break
    plan = plan.join(ends.withColumnRenamed("source_", "s_"), F.col("source_").eqNullSafe(F.col("s_")), "left")
    return plan.select("source_", "source_size", "target", "whole", F.coalesce("last", F.lit(-1).cast("long")).alias("last")), few


def copies_of() -> Column:
    """How often a row beside its source's plan is taken whole."""
    return F.col("whole") + F.when(F.col("hash_") <= F.col("last"), 1).otherwise(0)


def mix(documents: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, keys=("doc_id",)) -> DataFrame:
    """The keys, size, source_size, target, copies (long: times the row is taken whole), taken (long)."""
    slim = durable(documents.select(F.struct(*keys).alias("keys_"), "source", n_words("text").alias("size"), positive_hash(*[F.col(k) for k in keys]).alias("hash_")))
    plan, few = plan_of(slim, weights, share, cap)
    out = beside(slim, plan, few)
    return out.select("keys_.*", "size", "source_size", "target", copies_of().alias("copies"), (copies_of() * F.col("size")).alias("taken"))


def take(documents: DataFrame, by: list[Column], weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """The rows of documents, each as often as the mix takes it; rows that are equal in all columns of `by` share one fate.

    The thresholds are applied to the rows as they are read: the texts are not shuffled, unless there are very many sources.
    """
    slim = durable(documents.select("source", n_words("text").alias("size"), positive_hash(*by).alias("hash_")))
    plan, few = plan_of(slim, weights, share, cap)
    rows = beside(documents.select(F.struct("*").alias("row_"), "source", positive_hash(*by).alias("hash_")), plan, few)
    return rows.where(copies_of() > 0).select("row_", F.explode(F.sequence(F.lit(1).cast("long"), copies_of())).alias("copy_")).select("row_.*")


ORACLE = r"""
with slim as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15))::bigint as h
  from documents),
sums as (select source, sum(size)::bigint as source_size from slim group by source),
weighed as (
  select *, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight from sums),
running as (
  select *, coalesce(sum(source_size) over (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as before_,
         sum(weight) over (order by source_size / weight, source nulls last rows between current row and unbounded following) as left_,
         sum(source_size) over () as total
  from weighed),
levels as (
  select *, max(case when 2 * source_size >= (1.5::double * total::double - 2 * before_::double) / left_::double * weight
                     then (1.5::double * total::double - 2 * before_::double) / left_::double end) over () as level
  from running),
plan as (
  select source, source_size, least(2.0::double * source_size, coalesce(level * weight, 2.0::double * source_size)) as target from levels),
split as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from plan),
ranked as (
  select s.doc_id, s.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size as rest,
         sum(s.size) over (partition by s.source order by s.h) as upto,
         sum(s.size) over (partition by s.source order by s.h) - sum(s.size) over (partition by s.source, s.h) as below
  from slim s join split p on s.source is not distinct from p.source)
select doc_id, size::bigint as size, source_size, target, copies::bigint as copies, (copies * size)::bigint as taken
from (select *, whole + case when rest > 0 and (upto <= rest or (below < rest and upto - rest < rest - below)) then 1 else 0 end as copies from ranked)
"""
