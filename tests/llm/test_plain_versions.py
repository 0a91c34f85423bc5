"""Learned verdicts, sound features, scores, extracted pages and the whole pipeline against plain versions."""

import hashlib
import math
import re
from html.parser import HTMLParser

import corpus_pipeline
import duckdb
import numpy as np
import pytest
import tokenizers
import xxhash
import zstandard

from cliquora.llm import media_columns, quality_rules, queries, secret_scans, toxicity
from cliquora.llm.common import table
from tests.llm import test_near_copies, test_operators as plain

DATA = "/root/testdata/sf0.001"


def rows_of(name, columns):
    return duckdb.sql(f"select {columns} from '{DATA}/{name}.parquet'").fetchall()


# 1. The verdict of a decision list


def plain_features(text):
    text = text or ""
    n, chars, symbols, dup, repeats = plain.plain_counts(text)
    own, lines = plain.WORD.findall(text), [x for x in text.split("\n") if plain.WORD.search(x)]
    per = max(1, n)
    return {
        "f_symbols": symbols / per, "f_word_length": chars / per, "f_dup_lines": dup / max(1, len(lines)), "f_repeats": repeats / per, "f_upper": sum(c.isupper() for c in text) / max(1, chars),
        "f_exclaim": text.count("!") / per, "f_distinct": len(set(own)) / per, "f_line_words": n / max(1, len(lines)), "f_digits": sum(c in "0123456789" for c in text) / max(1, chars), "f_words": math.log1p(n),
    }


def plain_verdict(text, rules):
    n, _, _, _, repeats = plain.plain_counts(text)
    own = plain_features(text)
    by = next((i for i, rule in enumerate(rules, 1) if all((own[c.feature] > c.threshold) == c.above for c in rule.conditions)), None)
    failed = n < 20 or 100 * repeats > 30 * n
    return not failed and by is None, by


def test_quality_verdicts(spark):
    rules = queries.quality_of(spark, DATA)
    # and for each feature a list of one rule at the feature's median, so that each one's value is told apart
    texts = dict(rows_of("documents", "doc_id, text"))
    known = [plain_features(t) for t in texts.values()]
    lists = [rules]
    for name in quality_rules.FEATURES:
        values = sorted({f[name] for f in known})
        middle = (values[len(values) // 2] + values[len(values) // 2 - 1]) / 2
        lists.append([quality_rules.Rule((quality_rules.Condition(name, True, middle),), 1, 1), quality_rules.Rule((quality_rules.Condition(name, False, values[0] + 1e-9),), 1, 1)])
    for made in lists:
        got = {r.doc_id: (r.kept, r.rule) for r in quality_rules.apply_rules(table(spark, DATA, "documents"), made).collect()}
        assert got == {k: plain_verdict(t, made) for k, t in texts.items()}
        assert made is rules or len({by for _, by in got.values()}) > 1


def test_bad_rows_are_rejected(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op1_quality_rules(spark, folder).join(table(spark, folder, "labels"), "doc_id").where("not base_failed").collect()
    bad = [r.kept for r in got if r.quality == 0]
    assert bad and sum(bad) <= 0.1 * len(bad)


# 2. Resampling and features, one sample at a time


def plain_feature(name, pcm):
    size = [abs(x) for x in pcm]
    crossings = sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:], strict=False))
    n, parts, at = len(pcm), [], 0
    for i in range(8):
        width = n // 8 + (i < n % 8)
        parts.append(str(sum(size[at : at + width]) // max(1, width)))
        at += width
    return f"{name};n={n};peak={max(size)};mean={sum(size) // n};zc={crossings};parts={'.'.join(parts)}"


def test_sound_features(spark):
    texts = ["", "short", "word " * 300, "ÄÖ\n" * 700, "\x00\x01 zz" * 90]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for tag, name in media_columns.NAMES.items():
        stored = media_columns.store_telephony(df, "text", codec=tag)
        told = {r.doc_id: r for r in media_columns.describe(stored).collect()}
        for r in stored.collect():
            payload = media_columns.pad(texts[r.doc_id].encode())
            if tag == media_columns.IMA:
                pcm = [x for i in range(0, len(payload), 576) for x in plain.plain_ima(np.frombuffer(payload[i : i + 576], np.uint8))]
            else:
                pcm = [int(media_columns.TABLES[tag][b]) for b in payload]
            own = lambda i: pcm[min(max(i, 0), len(pcm) - 1)]
            fine = [x for i in range(len(pcm)) for x in (pcm[i], max(-32768, min(32767, (19 * (own(i) + own(i + 1)) - 3 * (own(i - 1) + own(i + 2)) + 16) >> 5)))]
            assert np.frombuffer(media_columns.read_wav(r.pcm)[1], "<i2").tolist() == fine
            assert told[r.doc_id].feature == plain_feature(name, pcm)


# 4. Scores


def test_scores(spark):
    documents, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    model = toxicity.train(toxicity.training_rows(documents, labels))

    def length(window, content):
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False).compress(window))

    texts = dict(rows_of("documents", "doc_id, text"))
    got = {r.doc_id: r for r in toxicity.score_toxicity(documents, model).collect()}
    for k in sorted(texts)[:40]:
        own = re.sub(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]", b" ", (texts[k] or "").encode().lower()).split()
        cut = [b" " + b" ".join(own[i : i + 6]) + b" " for i in range(0, len(own), 6)][:60]
        if len(own) > 360 or any(len(w) > 256 for w in cut):
            continue
        gains = [length(w, model.ordinary) - length(w, model.toxic) for w in cut]
        hits, clear = sum(g >= model.margin for g in gains), sum(g >= model.margin + 3 for g in gains)
        z = sum(w * x for w, x in zip(model.weights, (1, math.log1p(hits), math.log1p(clear), 100 * clear / max(1, len(cut)), math.log1p(len(cut))), strict=True))
        assert (got[k].n_windows, got[k].n_hits, got[k].n_clear) == (len(cut), hits, clear)
        assert got[k].score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


# 7. Pages by a rule written for their template


class Article(HTMLParser):
    """What stands in <article>, without what is no text of it."""

    LEFT_OUT = {"script", "style", "nav", "aside", "footer", "form", "header", "noscript", "button"}
    BLOCKS = {"p", "h1", "h2", "h3", "h4", "li", "ul", "ol", "blockquote", "div", "pre", "article", "section", "table", "tr", "td", "th", "br", "figure", "figcaption"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.out, self.blocks = False, 0, [""]

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside = True
        if self.inside and (self.out or tag in self.LEFT_OUT or {"ad", "comments", "share", "related", "cookie"} & set(dict(attrs).get("class", "").split())):
            self.out += tag not in {"br", "img", "hr", "p", "li"} or not self.out
        if tag in self.BLOCKS:
            self.blocks.append("")

    def handle_endtag(self, tag):
        if self.inside and self.out and tag not in {"p", "li"}:
            self.out -= 1
        if tag == "article":
            self.inside = False
        if tag in self.BLOCKS:
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside and not self.out:
            self.blocks[-1] += data


def test_pages_of_the_table(spark):
    pages = dict(rows_of("pages", "page_id, html"))
    got = {r.page_id: r.text for r in queries.op7_html_extraction(spark, DATA).collect()}
    assert got.keys() == pages.keys()
    same = 0
    for k, page in pages.items():
        own = Article()
        own.feed(page or "")
        own.close()
        want = "\n".join(t for b in own.blocks if (t := " ".join(b.split())))
        same += got[k] == want
    assert same >= 0.95 * len(pages), same


# The pipeline


def plain_near(docs):
    """One row of each component: docs are (doc_id, text, source), with ids of their own."""
    docs = sorted(docs)
    least = test_near_copies.plain([t for _, t, _ in docs])
    return [d for i, d in enumerate(docs) if least[i] == i]


def plain_redacted(models, text):
    want, at = "", 0
    spans = sorted((s, e) for s, _, e in plain.plain_base(text) + plain.plain_models(models, text))
    for s, e in spans:
        if s >= at:
            want += (text or "")[at:s] + "[secret]"
        at = max(at, e)
    return want + text[at:] if spans else text


def plain_mixed(docs):
    def place(d, t, s):
        own = xxhash.xxh64_intdigest(t.encode(), 42)
        name = "\x1f".join([str(d), s or "", str(own - (1 << 64) if own >> 63 else own)])
        return int(hashlib.md5(name.encode()).hexdigest()[:15], 16)

    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len(plain.WORD.findall(t))
    target, out = plain.plain_targets(sizes), []
    for source in sizes:
        whole = int(target[source] // sizes[source]) if sizes[source] else 0
        rest, before = target[source] - whole * sizes[source], 0
        for _, d, t in sorted((place(d, t, s), d, t) for d, t, s in docs if s == source):
            n = len(plain.WORD.findall(t))
            more = rest > 0 and (before + n <= rest or (before < rest and before + n - rest < rest - before))
            out += [(d, t)] * (whole + more)
            before += n
    return out


def test_the_pipeline(spark):
    docs = [(d, t, s) for d, t, s in rows_of("documents", "doc_id, text, source") if t is not None]
    assert len({d for d, _, _ in docs}) == len(docs)
    rules = queries.quality_of(spark, DATA)
    good = [x for x in docs if plain_verdict(x[1], rules)[0]]
    alone = plain_near(good)
    assert 20 < len(alone) < len(good) < len(docs)
    frame = spark.createDataFrame(alone, "doc_id long, text string, source string")
    models = secret_scans.train(secret_scans.labelled_samples(spark, frame))
    clean = [(d, plain_redacted(models, t), s) for d, t, s in alone]
    mixed = plain_mixed(clean)
    encode = tokenizers.Tokenizer.from_file(queries.vocabulary()).encode
    want = sorted((d, len(encode(t, add_special_tokens=False).ids) + 1) for d, t in mixed)
    got = corpus_pipeline.run(spark, DATA).collect()
    assert sum(r.length for r in got) == sum(n for _, n in want)
    pieces = {}
    for r in got:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    copies = {k: want.count(k) for k in set(want)}
    assert pieces.keys() == copies.keys()
    for k, own in pieces.items():
        covered = np.zeros(k[1], int)
        for start, length in own:
            covered[start : start + length] += 1
        assert (covered == copies[k]).all()
    # sequences are full but for each partition's last, and gapless from 0
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024


