r"""Quality rules: a learned decision list over text statistics, in DataFrame operations only.

Statistics are columns of one narrow pass over the texts: words `[^\x20\x09-\x0D]+`, lines, and the words that lie in 8-word
windows found twice or more (windows are compared by 64-bit hashes; equal ones meet by sorting a text's own windows).

The list is learned by sequential covering. A rule grows by the threshold condition with the best information gain on two
thirds of the labelled rows, is pruned on the other third (conditions go while that raises its accuracy there), and is kept if
it is right there in LEAST_ACCURACY of the rows it covers; covered rows leave, and the next rule is grown. The list becomes one
ordered CASE expression: the first rule that holds rejects a text, and a text that no rule covers is kept.

Null texts have no words. Empty and null texts fail the base rule. Null ratios don't occur (denominators are at least 1).
Without usable labels the list is empty. Repeated rows are judged alike; of labelled rows with one id the least is fitted on, and
of conditions with equal gains the first. A very long text is one row's arrays (its words' hashes and windows, sorted within the
text), some thirty bytes a word. An empty table gives no rows. Internal columns start with `q_`; columns of the input with such
names are not disturbed because only the key and the text are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliquora.llm.common import SPACE, words

WINDOW = 8
#: At most so many labelled rows are fitted on, the first by a hash of doc_id.
MAX_LABELLED = 4000
CUTS, MAX_CONDITIONS, MAX_RULES, LEAST_COVER, LEAST_ACCURACY = 24, 3, 12, 8, 0.95
FEATURES = ("f_symbols", "f_word_length", "f_dup_lines", "f_repeats", "f_upper", "f_exclaim", "f_distinct", "f_line_words", "f_digits", "f_words")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(rows: DataFrame, keys: list[str], text: str, features=FEATURES, counts=COUNTS) -> DataFrame:
    """The keys and the named ones of COUNTS and FEATURES of every row; no others are computed."""
    t = rows.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("q_text"))
    t = t.withColumns({"q_words": words(F.col("q_text")), "q_lines": F.filter(F.split("q_text", "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "")})
    t = t.withColumns({
        "n_words": F.size("q_words").cast("long"),
        "word_chars": F.length(F.array_join("q_words", "")).cast("long"),
        "n_symbols": F.regexp_count("q_text", F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
        "q_hashes": F.transform("q_words", lambda w: F.xxhash64(w)),
    })
    window = lambda i: F.xxhash64(*[F.get("q_hashes", i + k) for k in range(WINDOW)])
    none = F.array().cast("array<bigint>")
    t = t.withColumn("q_windows", F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("q_hashes") - WINDOW), window)).otherwise(none))
    # texts without a repeated window, nearly all, end here; in others equal windows become neighbours
    again = F.size(F.array_distinct("q_windows")) < F.size("q_windows")
    placed = F.sort_array(F.transform("q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    t = t.withColumn("q_sorted", F.when(again, placed))
    same = lambda x, i: F.coalesce(F.get("q_sorted", i)["h"] == x["h"], F.lit(False))
    at = F.sort_array(F.transform(F.filter("q_sorted", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))
    t = t.withColumn("q_at", F.when(F.col("q_sorted").isNotNull(), at))
    covered = F.transform("q_at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("q_at", i + 1) - p, F.lit(WINDOW))))
    t = t.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    per_word = lambda c: c / F.greatest(F.col("n_words"), F.lit(1))
    n_lines = F.greatest(F.size("q_lines"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    of = dict(zip(FEATURES, (
        per_word(F.col("n_symbols")),
        per_word(F.col("word_chars")),
        F.col("n_dup_lines") / n_lines,
        per_word(F.col("n_repeat_words")),
        F.length(F.regexp_replace("q_text", r"[^\p{Lu}]+", "")) / chars,
        per_word(F.length("q_text") - F.length(F.replace("q_text", F.lit("!"), F.lit("")))),
        per_word(F.size(F.array_distinct("q_hashes"))),
        F.col("n_words") / n_lines,
        F.length(F.regexp_replace("q_text", r"[^0-9]+", "")) / chars,
        F.log1p(F.col("n_words")),
    ), strict=True))
    return beyond(t, keys, [F.col(c) for c in counts] + [of[n].cast("double").alias(n) for n in features])


def beyond(t: DataFrame, keys: list[str], columns: list[Column]) -> DataFrame:
    """t.select(*keys, *columns), beyond which no filter is pushed down: there it would hold the whole statistics many times over."""
    return t.select(*keys, F.explode(F.array(F.struct(*columns))).alias("q_s")).select(*keys, "q_s.*")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    covered: int
    right: int

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return f"reject if {' and '.join(map(str, self.conditions))} (right {self.right} of {self.covered})"


def labelled_statistics(documents: DataFrame, labels: DataFrame) -> list[tuple]:
    """Rows of (is bad, FEATURES...) for at most MAX_LABELLED labelled texts."""
    usable = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("q_quality"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    stats = statistics(rows, ["doc_id", "q_quality"], "text")
    # of rows with the same id the least: however many share it, the sample stays as large
    stats = stats.groupBy("doc_id", "q_quality").agg(F.min(F.struct(*FEATURES)).alias("least")).select("doc_id", "q_quality", "least.*")
    return sorted((int(r.q_quality == 0), *[r[f] for f in FEATURES], r.doc_id) for r in stats.collect())


def learn(rows: list[tuple]) -> list[Rule]:
    """Sequential covering; sets of rows are the bits of whole numbers, so that a condition's cover costs one `and`."""
    if not rows:
        return []
    rows = sorted(rows, key=lambda r: r[-1])
    grow = sum(1 << i for i in range(len(rows)) if i % 3)
    every = (1 << len(rows)) - 1
    bad = sum(1 << i for i, r in enumerate(rows) if r[0])
    options: list[tuple[Condition, int]] = []
    for f, name in enumerate(FEATURES, 1):
        values = sorted({r[f] for r in rows})
        ranked = sorted(r[f] for r in rows)
        # between the quantiles of all rows, and between those of the bad ones
        marked = sorted(r[f] for r in rows if r[0]) or ranked
        picks = {s[int(q * (len(s) - 1) / CUTS)] for s in (ranked, marked) for q in range(CUTS + 1)}
        after = dict(zip(values, values[1:], strict=False))
        for v in sorted(picks):
            if v in after:
                cut = (v + after[v]) / 2
                above = sum(1 << i for i, r in enumerate(rows) if r[f] > cut)
                options += [(Condition(name, True, cut), above), (Condition(name, False, cut), every & ~above)]
    rules: list[Rule] = []
    left = every
    while len(rules) < MAX_RULES:
        cover, chosen = left & grow, []
        while len(chosen) < MAX_CONDITIONS:
            p, n = (cover & bad).bit_count(), (cover & ~bad).bit_count()
            if not p or not n:
                break
            best = (0.0, None, 0)
            for condition, mask in options:
                p1, n1 = (cover & mask & bad).bit_count(), (cover & mask & ~bad).bit_count()
                if p1 >= LEAST_COVER:
                    gain = p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p / (p + n)))
                    if gain > best[0] + 1e-9:
                        best = (gain, condition, mask)
            if best[1] is None:
                break
            chosen.append((best[1], best[2]))
            cover &= best[2]
        if not chosen:
            break

        def held(conditions, left=left) -> tuple[int, int]:
            mask = left & ~grow
            for _, m in conditions:
                mask &= m
            return (mask & bad).bit_count(), mask.bit_count()

        worth = lambda cs: (2 * held(cs)[0] - held(cs)[1]) / max(1, held(cs)[1])
        while len(chosen) > 1 and (shorter := max(([*chosen[:i], *chosen[i + 1 :]] for i in range(len(chosen))), key=worth)) and worth(shorter) >= worth(chosen):
            chosen = shorter
        right, covered = held(chosen)
        if not covered or right < LEAST_ACCURACY * covered:
            break
        rules.append(Rule(tuple(c for c, _ in chosen), covered, right))
        taken = left
        for _, m in chosen:
            taken &= m
        left &= ~taken
    return rules


def decision(rules: list[Rule]) -> tuple[Column, Column]:
    """(verdict: kept or not, number of the rule that decided, null if none did)."""
    kept, by = F.lit(True), F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        kept, by = F.when(rule.column(), False).otherwise(kept), F.when(rule.column(), i).otherwise(by)
    return kept, by


def apply_rules(documents: DataFrame, rules: list[Rule], keys=("doc_id",), text: str = "text", counts=COUNTS) -> DataFrame:
    """The keys, the counts (n_words and n_repeat_words are needed), base_failed, kept, rule. Of the features only what the rules name is computed."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    kept, by = decision(rules)
    named = [f for f in FEATURES if any(c.feature == f for rule in rules for c in rule.conditions)]
    stats = statistics(documents, list(keys), text, named, counts).withColumns({"base_failed": failed, "q_kept": kept, "rule": by})
    return stats.select(*keys, *counts, "base_failed", (~F.col("base_failed") & F.col("q_kept")).alias("kept"), "rule")


def keep_good(documents: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows of documents that are kept, with the columns they have (one struct carries them past the statistics)."""
    judged = apply_rules(documents.select(F.struct("*").alias("q_row"), F.col(text).alias("q_input")), rules, ["q_row"], "q_input", ("n_words", "n_repeat_words"))
    return judged.where("kept").select("q_row.*")
