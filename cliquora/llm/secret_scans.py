r"""Secret scans: fixed patterns and a pair of character Markov models, in DataFrame operations only.

Patterns give the base spans. For the models, candidates are runs of CANDIDATE characters; one model has the transitions of
random strings, the other those of ordinary identifiers, both counted from labelled samples with add-one smoothing. A
candidate that touches no base span is a secret if its mean log-likelihood ratio a transition is above a threshold that is
calibrated on held-out samples.

Positions are code points. Java splits a text at a pattern's matches, so a match starts after all earlier pieces and matches.
Null and empty texts have no spans. Ties: spans that start together are ordered by kind. Repeated rows give equal results. A
very long candidate is scored in one walk over its characters. An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliquora.llm.common import let, running, text_of

#: Kind to pattern, and the shortest string that counts (of the group for assign).
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Runs of hex digits that are long enough: found at once, a run being one match of [0-9a-f]+ too.
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "markov")
#: The models' states; every other character shares the last one.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
STATES = len(ALPHABET) + 1
#: Labelled samples: so many random strings, and the words of so many documents.
RANDOM_STRINGS, MAX_DOCUMENTS = 4000, 1000

Spans = "array<struct<start:int,end:int,kind:int>>"
Parts = "array<struct<start:int,end:int,kind:int,part:string>>"


def bare(found: Column) -> Column:
    """Spans without their parts."""
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def apart(found: Column, base: Column) -> Column:
    """The spans of found, which don't overlap one another, that touch none of base.

    One touches a base span if and only if the largest end of the base spans that start before its own end is beyond its start:
    one sort and one running maximum, however many spans there are.
    """
    edges = F.sort_array(F.concat(
        F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("is_base"), b["end"].alias("reach"), F.lit(-1).alias("which"))),
        F.transform(found, lambda x, i: F.struct(x["end"].alias("at"), F.lit(0).alias("is_base"), F.lit(0).alias("reach"), i.alias("which"))),
    ))
    def free(e: Column) -> Column:
        reach = running(F.transform(e, lambda x: x["reach"]), F.lit(0), lambda a, x: F.greatest(a, x))
        own = let(reach, lambda r: F.filter(F.transform(e, lambda x, i: F.struct(x["which"].alias("which"), F.get(r, i).alias("reach"))), lambda x: x["which"] >= 0))
        # a found span's edge is its end, so that the edges are in the order of the spans
        return let(own, lambda o: F.filter(found, lambda x, i: F.get(o, i)["reach"] <= x["start"]))
    return F.when((F.size(found) > 0) & (F.size(base) > 0), let(edges, free)).otherwise(found)


def spans(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """The spans of a pattern's matches whose group, their part, has `least` characters or more; null where there are none."""
    def placed(gaps: Column, whole: Column, part: Column) -> Column:
        lengths = F.zip_with(F.slice(gaps, 1, F.size(whole)), whole, lambda g, w: F.length(g) + F.length(w))
        one = lambda ends: lambda w, i: F.struct((F.get(ends, i) - F.length(w)).alias("start"), F.get(ends, i).alias("end"), F.lit(kind).alias("kind"), F.get(part, i).alias("part"))
        found = let(running(lengths, F.lit(0), lambda a, x: a + x), lambda ends: F.filter(F.transform(whole, one(ends)), lambda s: F.length(s["part"]) >= least))
        return F.when(F.size(whole) > 0, found)

    # each list is found once a text, not once a match
    matches = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    parts = lambda whole, body: body(whole) if group == 0 else let(matches(group), body)
    return let(F.split(text, pattern), lambda gaps: let(matches(0), lambda whole: parts(whole, lambda part: placed(gaps, whole, part))))


@dataclass(frozen=True)
class Models:
    #: Of each pair of states log(P random / P ordinary), and of each state as a first character.
    ratios: tuple[float, ...]
    threshold: float

    def mean_ratio(self, string: Column) -> Column:
        table = F.from_json(F.lit("[" + ",".join(f"{r:.5f}" for r in self.ratios) + "]"), "array<double>")
        state_of = {c: i for i, c in enumerate(ALPHABET)}
        states = F.from_json(F.lit("[" + ",".join(str(state_of.get(chr(i), STATES - 1)) for i in range(128)) + "]"), "array<int>")
        state = lambda c: F.coalesce(F.get(states, F.ascii(c)), F.lit(STATES - 1))
        walk = lambda s: F.aggregate(
            F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s)), lambda a, b: F.get(table, a * STATES + b)),
            F.lit(0.0), lambda acc, x: acc + x) / F.greatest(F.size(s) - 1, F.lit(1))
        return let(F.transform(F.split(string, ""), state), walk)


def labelled_samples(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """string, random (1 or 0): digests in four alphabets, and words of documents alone and joined like identifiers."""
    ids = spark.range(RANDOM_STRINGS)
    digest = F.sha2(F.concat(F.lit("random "), F.col("id").cast("string")), 256)
    coded = F.base64(F.unhex(digest))
    forms = F.array(F.substring(digest, 1, 40), F.substring(F.regexp_replace(coded, "[+/=]", ""), 1, 32), F.substring(coded, 1, 40), F.substring(F.regexp_replace(F.upper(coded), "[^A-Z0-9]", ""), 1, 24))
    random = ids.select(F.explode(forms).alias("string"), F.lit(1).alias("random"))
    # ids alone are ranked, so that no task gathers texts
    ids = documents.where("text is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_DOCUMENTS)
    few = documents.where("text is not null").select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    plain = F.filter(F.split(F.regexp_replace("text", r"[^A-Za-z_]+", " "), " "), lambda w: (F.length(w) >= 3) & (F.length(w) <= 40))
    own = few.select(F.explode(let(plain, lambda w: F.transform(w, lambda x, i: F.struct(x.alias("a"), F.coalesce(F.get(w, i + 1), F.lit("id")).alias("b"), F.coalesce(F.get(w, i + 2), F.lit("name")).alias("c"), (i % 8).alias("k"))))).alias("w"))
    a, b, c, k = (F.col(f"w.{x}") for x in "abck")
    joined = (
        F.when(k == 0, F.concat(F.lower(a), F.lit("_"), F.lower(b), F.lit("_"), F.lower(c))).when(k == 1, F.concat(F.lower(a), F.initcap(b), F.initcap(c)))
        .when(k == 2, F.concat(F.lower(a), F.lit("-"), F.lower(b), F.lit("-"), F.lower(c))).when(k == 3, F.concat(F.upper(a), F.lit("_"), F.upper(b), F.lit("_2024")))
        .when(k == 4, F.concat(F.lower(a), F.lit("/"), F.lower(b), F.lit("/"), F.lower(c), F.lit("01"))).when(k == 5, F.concat(F.lower(a), F.lower(b), F.lower(c))).otherwise(a)
    )
    return random.unionByName(own.select(joined.alias("string"), F.lit(0).alias("random")))


def train(samples: DataFrame) -> Models:
    """Transition counts of half of the samples by a hash; the threshold from the other half's strings of 20 characters or more.

    Counts meet as at most 2 * 128 * 128 sums; no string goes to the driver.
    """
    half = F.pmod(F.xxhash64("string"), F.lit(2)) == 0
    pairs = samples.where(half).select("random", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("string") - 1, F.lit(1))), lambda i: F.substr(F.col("string"), i, F.lit(2)))).alias("pair"))
    state_of = {c: i for i, c in enumerate(ALPHABET)}
    counts = [[0] * STATES * STATES, [0] * STATES * STATES]
    for r in pairs.groupBy("random", "pair").count().where(F.length("pair") == 2).collect():
        a, b = (state_of.get(c, STATES - 1) for c in r["pair"])
        counts[r["random"]][a * STATES + b] += r["count"]
    ratios = []
    for a in range(STATES):
        rows = [counts[k][a * STATES : (a + 1) * STATES] for k in (1, 0)]
        totals = [sum(r) + STATES for r in rows]
        ratios += [math.log((x + 1) / totals[0]) - math.log((y + 1) / totals[1]) for x, y in zip(*rows, strict=True)]
    models = Models(tuple(ratios), 0.0)
    scored = samples.where(~half & (F.length("string") >= 20)).select("random", models.mean_ratio(F.col("string")).alias("ratio"))
    ends = {r["random"]: r for r in scored.groupBy("random").agg(F.percentile_approx("ratio", 0.01).alias("low"), F.percentile_approx("ratio", 0.999).alias("high")).collect()}
    low, high = (ends[1]["low"] if 1 in ends else 1.0), (ends[0]["high"] if 0 in ends else 0.0)
    return Models(tuple(ratios), max(0.1, (low + high) / 2))


def scan(documents: DataFrame, models: Models, keys=("doc_id",), text: str = "text") -> DataFrame:
    """The keys and s_spans (array of start, end, kind by start and kind) of every row."""
    rows = documents.select(*keys, text_of(text).alias("s_text"))
    none = F.array().cast(Spans)
    t = F.col("s_text")
    found = [
        (r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", spans(t, ASSIGN, 0, 2, 8)),
        (r"AKIA[A-Z0-9]{12}", spans(t, ACCESS, 1, 0, 16)),
        (r"[0-9a-f]{32}", spans(t, HEX, 2, 0, 32)),
    ]
    rows = rows.withColumn("s_base", F.concat(*[F.coalesce(F.when(t.rlike(hint), bare(s)), none) for hint, s in found]))
    # candidates, each with its place; those that touch a base span are known already
    rows = rows.withColumn("s_candidates", F.coalesce(F.when(t.rlike(CANDIDATE), spans(t, CANDIDATE, 3, 0, 20)), F.array().cast(Parts)))
    rows = rows.withColumn("s_candidates", apart(F.col("s_candidates"), F.col("s_base")))
    secret = lambda x: models.mean_ratio(x["part"]) >= models.threshold
    rows = rows.withColumn("s_more", F.when(F.size("s_candidates") > 0, bare(F.filter("s_candidates", secret))).otherwise(none))
    return rows.select(*keys, F.sort_array("s_base").alias("s_base"), F.sort_array(F.concat("s_base", "s_more")).alias("s_spans"), "s_text")


def listed(found: Column) -> Column:
    """kind:start:end, joined by commas, by start and kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.sort_array(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))), one), ",")


def digest(found: DataFrame, keys=("doc_id",)) -> DataFrame:
    """What scan found as counts, a digest of the base spans, and the spans as a string."""
    of = lambda k: F.size(F.filter("s_base", lambda s: s["kind"] == k)).cast("long")
    return found.select(*keys, of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(listed(F.col("s_base")), 256).alias("base_sha256"), listed(F.col("s_spans")).alias("spans"))


#: Characters of a block: what is taken from a text by position is taken from the blocks that it lies in.
BLOCK = 1024


def redact(documents: DataFrame, models: Models, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """documents with every secret replaced by mark (overlapping spans become one), all other columns as they are.

    Spark counts a text's characters from its start, so that a text with secrets is cut into blocks once, and a piece between two
    secrets costs its own length and a block's.
    """
    found = scan(documents.select(F.struct("*").alias("s_row"), F.col(text).alias("s_input")), models, ["s_row"], "s_input")

    def between(blocks: Column, at: Column, to: Column) -> Column:
        """The characters from at to before to."""
        first = F.floor(at / BLOCK).cast("int")
        own = F.slice(blocks, first + 1, F.greatest(F.floor((to - 1) / BLOCK).cast("int") - first + 1, F.lit(0)))
        return F.substr(F.array_join(own, ""), F.pmod(at, F.lit(BLOCK)) + 1, to - at)

    def clean(blocks: Column, ends: Column) -> Column:
        piece = lambda s, at: F.when(s["start"] >= at, F.concat(between(blocks, at, s["start"]), F.lit(mark))).otherwise("")
        pieces = F.transform("s_spans", lambda s, i: let(F.coalesce(F.get(ends, i - 1), F.lit(0)), lambda at: piece(s, at)))
        return F.concat(F.array_join(pieces, ""), F.substr(F.col("s_text"), F.element_at(ends, -1) + 1, F.length("s_text")))

    blocks = F.regexp_extract_all("s_text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    ends = running(F.transform("s_spans", lambda s: s["end"]), F.lit(0), lambda a, x: F.greatest(a, x))
    whole = let(blocks, lambda b: let(ends, lambda e: clean(b, e)))
    redacted = F.when(F.size("s_spans") > 0, whole).otherwise(F.col(f"s_row.{text}"))
    kept = lambda c: F.col("s_row.`" + c.replace("`", "``") + "`").alias(c)
    return found.withColumn("s_clean", redacted).select(*[F.col("s_clean").alias(text) if c == text else kept(c) for c in documents.columns])
