"""A Merkle manifest of a table, with a proof for each row that is found by looking coordinates up.

Leaves are digests of a row's fields. Each `lang` is a tree: its leaves in the order of doc_id, GROUP consecutive nodes under one
parent, until one is left. Those subroots, in the order of lang, are the leaves of one more tree (TOP), whose root stands for the table.

1. Leaves get their places: they are dealt to tasks by ranges of (lang, doc_id, leaf), and each task counts on where those before it
   end, so that a language with nearly all rows is spread like any other.
2. Levels are built from the leaves up, GROUP nodes a group, and written: a table of (tree, level, pos, digest).
3. A proof needs no walk: place and number of leaves tell where the siblings of every level stand. A leaf explodes these coordinates
   and joins the table of nodes. The few nodes of the high levels, which very many leaves ask for, are sent to all tasks (HIGH bounds
   their number); the others are wanted by a bounded share of the leaves and are joined by a shuffle.
4. A leaf's siblings are put in order, concatenated for the digest of the proof, and folded with the leaf up to the root.

Null fields are `-` in a leaf, a null lang is a tree of its own before all others, and null ids come first in a tree. Rows of one id are
in the order of their leaves; rows that are equal altogether have equal leaves at neighbouring places, each with its own proof. Very
long texts cost their length (the digest is taken where the row is read). Only the five fields are read, so that other columns can't
clash. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cliquora.llm.common import durable, sized

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
GROUP, BITS = 8, 3
#: The tree above the languages' trees; those have numbers from 0.
TOP = -1
#: Nodes of high levels that are sent to all tasks at most: about 100 bytes each.
HIGH = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_of(*fields: Column) -> Column:
    """The digest of fields, each `-` where null, else its length in bytes, a colon and the value."""
    coded = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*coded), 256)


def tampered_text() -> Column:
    """The text with A-Z in lower case where 3 divides the CRC-32 of the id; else as it is."""
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))


def leaves(documents: DataFrame, altered: Column | None = None) -> DataFrame:
    """(doc_id, lang, leaf, found): found is the leaf of the row as it is met later, with `altered` for its text."""
    own = documents.select(*FIELDS)
    text = F.col("text") if altered is None else altered
    return own.select("doc_id", "lang", leaf_of(*map(F.col, FIELDS)).alias("leaf"), leaf_of(*map(F.col, FIELDS[:-1]), text).alias("found"))


def counted(dealt: DataFrame, group: list[str]) -> DataFrame:
    """Rows that are sorted within and between their tasks, with their place in the group from 0 and the group's size n."""
    dealt = dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    own = durable(dealt.groupBy(*group, "part").agg(F.count("*").alias("rows"), F.min("at").alias("first")))
    every, before = W.partitionBy(*group), W.partitionBy(*group).orderBy("part")
    starts = own.select(*[F.col(g).alias(f"{g}_") for g in group], F.col("part").alias("part_"), (F.sum("rows").over(before) - F.col("rows") - F.col("first")).alias("start"), F.sum("rows").over(every).alias("n"))
    on = F.col("part") == F.col("part_")
    for g in group:
        on &= F.col(g).eqNullSafe(F.col(f"{g}_"))
    return dealt.join(sized(durable(starts)), on).withColumn("pos", F.col("at") + F.col("start")).drop("part", "part_", "at", "start", *[f"{g}_" for g in group])


def placed(own: DataFrame) -> DataFrame:
    """Leaves with tree (the number of the lang), pos (the place in it) and n (the tree's leaves)."""
    dealt = durable(durable(own).repartitionByRange("lang", "doc_id", "leaf").sortWithinPartitions("lang", "doc_id", "leaf"))
    rows = counted(dealt, ["lang"])
    langs = durable(durable(dealt.select("lang").distinct()).repartitionByRange("lang").sortWithinPartitions("lang"))
    trees = counted(langs.withColumn("all", F.lit(0)), ["all"]).select(F.col("lang").alias("lang_"), F.col("pos").alias("tree"))
    return rows.join(sized(durable(trees)), F.col("lang").eqNullSafe(F.col("lang_"))).drop("lang_", "lang")


def built(own: DataFrame, most: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """Trees from their leaves (tree, pos, n, digest): all nodes but the roots, (tree, level, pos, digest); the roots (tree, digest); nodes by level.

    most: the leaves of the largest tree.
    """
    level, now, nodes, roots, sizes = 0, own, None, own.where("n = 1").select("tree", "digest"), []
    while GROUP**level < most:
        here = now.where(F.col("n") > GROUP**level)
        listed = here.select("tree", F.lit(level).alias("level"), "pos", "digest")
        nodes = listed if nodes is None else nodes.unionByName(listed)
        sizes.append(here.count())
        children = F.sort_array(F.collect_list(F.struct("pos", "digest")))
        joined = F.array_join(F.transform(children, lambda c: F.lower(F.hex(c["digest"]))), "")
        now = durable(here.groupBy("tree", "n", F.shiftright("pos", BITS).alias("pos")).agg(F.unhex(F.sha2(joined, 256)).alias("digest")))
        level += 1
        roots = roots.unionByName(now.where((F.col("n") <= GROUP**level) & (F.col("n") > GROUP ** (level - 1))).select("tree", "digest"))
    if nodes is None:
        nodes = own.where("false").select("tree", F.lit(0).alias("level"), "pos", "digest")
    return nodes, roots, sizes


def split_at(sizes: list[int], most: int) -> int:
    """The least level from which on there are at most so many nodes."""
    level = len(sizes)
    while level and sum(sizes[level - 1 :]) <= most:
        level -= 1
    return level


#: Twice the group's size: a level's codes are this far apart.
STEP = 2 * GROUP
#: How many levels below the root a tree of n leaves has.
HEIGHT = f"size(filter(sequence(0, 20), l -> shiftleft(1L, {BITS} * l) < {{n}}))"


def coordinates(trees: int) -> Column:
    """Where a leaf's siblings stand, of all levels of its tree and of the tree above: an array of (code, tree, level, pos).

    code: STEP for each level up to the root, plus the place in the group, plus GROUP right of the leaf's own node. It orders the
    siblings, and tells level and side.
    """

    def run(tree: str, pos: str, n: str, height: str, before: str) -> str:
        own = f"shiftright({pos}, {BITS} * l)"
        first, last = f"shiftleft(shiftright({own}, {BITS}), {BITS})", f"shiftright({n} - 1, {BITS} * l)"
        places = f"filter(sequence({first}, least({first} + {GROUP - 1}, {last})), p -> p != {own})"
        code = f"cast({STEP} * (l + {before}) + p % {GROUP} + if(p > {own}, {GROUP}, 0) as int)"
        return f"flatten(transform(slice(sequence(0, {height}), 1, {height}), l -> transform({places}, p -> named_struct('code', {code}, 'tree', {tree}, 'level', l, 'pos', p))))"

    return F.expr(f"concat({run('tree', 'pos', 'n', 'height', '0')}, {run(f'{TOP}L', 'tree', f'{trees}L', 'above', 'height')})")


def folded() -> Column:
    """The root that a leaf's digest `found` and its siblings (code, hex) give, over height + above levels."""
    side = lambda first: f"array_join(transform(filter(siblings, x -> x.code >= {first} and x.code < {first} + {GROUP}), x -> x.hex), '')"
    steps = "slice(sequence(0, height + above), 1, height + above)"
    return F.expr(f"aggregate({steps}, found, (node, s) -> sha2(concat({side(f'{STEP} * s')}, node, {side(f'{STEP} * s + {GROUP}')}), 256))")


def manifest(own: DataFrame, high: int = HIGH) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of leaves (doc_id, lang, leaf, found).

    high: nodes that are sent to all tasks at most, of the languages' trees and of the tree above each.
    """
    rows = durable(placed(own).withColumn("height", F.expr(HEIGHT.format(n="n"))))
    most = rows.agg(F.max("n")).first()[0]
    if most is None:
        return rows.select("doc_id", "leaf", *[F.lit("").alias(c) for c in ("subroot", "root", "proof_sha256", "folded_root")], F.lit(True).alias("verified"))
    nodes, subroots, sizes = built(rows.select("tree", "pos", "n", F.unhex("leaf").alias("digest")), most)
    subroots = durable(subroots)
    trees = subroots.count()
    above, roots, top_sizes = built(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(trees).cast("long").alias("n"), "digest"), trees)
    root = roots.select(F.lower(F.hex("digest"))).first()[0]
    rows = rows.withColumn("above", F.expr(HEIGHT.format(n=f"{trees}L")))
    low, top_low = split_at(sizes, high), split_at(top_sizes, high)
    is_low = ((F.col("tree") != TOP) & (F.col("level") < low)) | ((F.col("tree") == TOP) & (F.col("level") < top_low))
    nodes = nodes.unionByName(above)
    wanted = rows.select(F.col("tree").alias("tree_"), F.col("pos").alias("pos_"), F.explode(coordinates(trees)).alias("at")).select("tree_", "pos_", "at.*")
    at = ["tree", "level", "pos"]
    sibling = F.struct("code", "digest").alias("sibling")
    found = wanted.where(~is_low).join(F.broadcast(nodes.where(~is_low)), at).select("tree_", "pos_", sibling)
    if low or top_low:
        found = found.unionByName(wanted.where(is_low).join(nodes.where(is_low), at).select("tree_", "pos_", sibling))
    proofs = found.groupBy(F.col("tree_").alias("tree"), F.col("pos_").alias("pos")).agg(F.sort_array(F.collect_list("sibling")).alias("siblings"))
    own_root = subroots.select("tree", F.lower(F.hex("digest")).alias("subroot"))
    out = rows.join(proofs, ["tree", "pos"], "left").join(sized(own_root), "tree")
    coded = F.transform("siblings", lambda x: F.struct(x["code"].alias("code"), F.lower(F.hex(x["digest"])).alias("hex")))
    out = out.withColumn("siblings", F.coalesce(coded, F.array().cast("array<struct<code:int,hex:string>>")))
    proof = F.sha2(F.array_join(F.transform("siblings", lambda x: x["hex"]), ""), 256)
    out = out.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), proof.alias("proof_sha256"), folded().alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The same in SQL. CRC-32 is worked out byte by byte; the trees grow level by level in a recursion.
ORACLE = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS b))),
rows_ AS (
  SELECT row_number() OVER () AS row_, doc_id, lang, text, source, n_chars, CAST(doc_id AS varchar) AS id FROM documents),
crc AS (
  SELECT row_, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(id) + 1), lambda i: ascii(id[i])::BIGINT)),
    lambda c, b: xor(t[1 + (xor(c, b) % 256)], c // 256)), 4294967295) AS crc FROM rows_, crc_table),
coded AS (
  SELECT row_, doc_id, lang, coalesce(octet_length(encode(id)) || ':' || id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
    || coalesce(octet_length(encode(n_chars::varchar)) || ':' || n_chars, '-') AS head, text,
    CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM rows_ JOIN crc USING (row_)),
leaves AS (
  SELECT row_, doc_id, lang, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf, sha256(head || coalesce(octet_length(encode(other)) || ':' || other, '-')) AS found FROM coded),
langs AS (SELECT lang, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT lang FROM leaves)),
placed AS (
  SELECT l.*, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, row_) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n
  FROM leaves l JOIN langs g ON l.lang IS NOT DISTINCT FROM g.lang),
low AS (
  SELECT tree, 0 AS level, pos, n AS own, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 8, (any_value(own) + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM low WHERE own > 1 GROUP BY tree, level, pos // 8),
subroots AS (SELECT tree, level AS height, digest AS subroot FROM low WHERE own = 1),
top AS (
  SELECT 0 AS level, tree AS pos, (SELECT count(*) FROM subroots) AS own, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, (any_value(own) + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM top WHERE own > 1 GROUP BY level, pos // 8),
steps AS (
  SELECT p.row_, x.level AS step, x.pos AS place, p.pos // CAST(8 ** x.level AS bigint) AS own, x.digest FROM placed p JOIN low x ON x.tree = p.tree AND x.own > 1 AND x.pos // 8 = p.pos // CAST(8 ** (x.level + 1) AS bigint)
  UNION ALL
  SELECT p.row_, s.height + x.level, x.pos, p.tree // CAST(8 ** x.level AS bigint), x.digest FROM placed p JOIN subroots s USING (tree) JOIN top x ON x.own > 1 AND x.pos // 8 = p.tree // CAST(8 ** (x.level + 1) AS bigint)),
sides AS (
  SELECT row_, step, coalesce(string_agg(digest, '' ORDER BY place) FILTER (place < own), '') AS before, coalesce(string_agg(digest, '' ORDER BY place) FILTER (place > own), '') AS after FROM steps GROUP BY row_, step),
climb AS (
  SELECT row_, 0 AS step, found AS node FROM placed
  UNION ALL
  SELECT row_, step + 1, sha256(before || node || after) FROM climb JOIN sides USING (row_, step)),
done AS (SELECT row_, arg_max(node, step) AS folded_root FROM climb GROUP BY row_),
proofs AS (SELECT row_, sha256(string_agg(before || after, '' ORDER BY step)) AS proof_sha256 FROM sides GROUP BY row_)
SELECT doc_id, leaf, subroot, (SELECT digest FROM top WHERE own = 1) AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = (SELECT digest FROM top WHERE own = 1) AS verified
FROM placed JOIN subroots USING (tree) JOIN done USING (row_) LEFT JOIN proofs USING (row_)
"""
