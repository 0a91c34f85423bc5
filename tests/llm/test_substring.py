"""Substring dedup: spans against a plain version, planted passages, edges."""

import random
import re
from zlib import crc32

import duckdb
import pytest

from cliquora.llm import queries, substring_dedup


def prose(n, r):
    return " ".join("".join(r.choices("abcdefghijklm", k=r.randint(2, 9))) for _ in range(n))


def plain_units(text, cut=substring_dedup.CUT):
    """(start, end, words, normalised unit), word by word."""
    out, own, before = [], [], None
    found = list(re.finditer(r"[^\x20\x09-\x0D]+", text))
    for i, m in enumerate(found):
        word = m[0].casefold().encode()
        after = text[m.end() : found[i + 1].start()] if i + 1 < len(found) else "\n"
        own.append((m.start(), m.end(), word))
        ends = "\n" in after
        if before is not None:
            ends = ends or ((crc32(word) * 31 + crc32(before)) * 0x9E3779B97F4A7C15 % 2**64 >> 40) % cut == 0
        before = None if "\n" in after else word
        if ends:
            out.append((own[0][0], own[-1][1], len(own), b" ".join(w for *_, w in own)))
            own = []
    return out


def plain_spans(rows, min_words=1, cut=substring_dedup.CUT):
    """{(key, text): [(start, end, words, keeper)]} with keys that are not null and rows that have one text each."""
    rows = sorted({(k, t) for k, t in rows if t})
    first, out = {}, {}
    for k, t in rows:
        for i, u in enumerate(plain_units(t, cut)):
            first.setdefault(u[3], (k, t, i))
    for k, t in rows:
        run = None
        for i, (a, b, n, u) in enumerate(plain_units(t, cut)):
            if first[u] == (k, t, i):
                run = None
            elif run:
                run[1:3] = b, run[2] + n
            else:
                run = [a, b, n, first[u][0]]
                out.setdefault((k, t), []).append(run)
    return {k: own for k, v in out.items() if (own := [tuple(x) for x in v if x[2] >= min_words])}


def found(df, **more):
    out = {}
    for x in sorted(substring_dedup.repeated_spans(df, **more).collect(), key=lambda x: (str(x.doc_id), x.copy, x.start)):
        out.setdefault(x.doc_id, []).append((x.start, x.end, x.words, x.keeper))
    return out


def test_units_of_blocks_are_those_of_the_whole():
    r = random.Random(1)
    text = "\n".join(prose(r.choice([0, 1, 3, 200]), r) + " " * r.randint(0, 40) for _ in range(40)) + "\tStraße ẞ " + "x" * 500
    want = [u[:3] for u in plain_units(text)]
    for block in (1, 7, 64, 300, 10**6):
        assert [u[:3] for u in substring_dedup.units_of(text, block=block)] == want
    assert not list(substring_dedup.units_of(" \n\t ")) and not list(substring_dedup.units_of(""))


@pytest.mark.parametrize("min_words", [1, queries.PASSAGE])
def test_spans_of_a_table(spark, min_words):
    path = "/root/testdata/sf0.001/documents.parquet"
    rows = duckdb.sql(f"select doc_id, text from '{path}'").fetchall()
    want = {k[0]: v for k, v in plain_spans(rows, min_words).items()}
    assert found(spark.read.parquet(path), min_words=min_words) == want
    if min_words > 1:
        got = {}
        for x in sorted(queries.op8_substring_dedup(spark, "/root/testdata/sf0.001").collect()):
            got.setdefault(x.doc_id, []).append((x.start, x.end, x.n_words, x.kept_doc_id))
        assert got == want


def test_passages_within_lines_are_found(spark):
    r = random.Random(5)
    passages = [prose(60, r) for _ in range(30)]
    texts = [" ".join([prose(r.randint(1, 90), r), p.upper() if i % 2 else p, prose(r.randint(1, 90), r)]) for i in range(2) for p in passages]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = found(df, min_words=queries.PASSAGE)
    assert len(got) >= 27 and all(k >= 30 and v[0][3] == k - 30 for k, v in got.items())
    for k, v in got.items():
        assert all(passages[k - 30].lower().find(texts[k][a:b].lower()) >= 0 for a, b, *_ in v)


def test_passages_of_50_words_are_caught(spark):
    r = random.Random(8)
    passages = [prose(r.randint(50, 59), r) for _ in range(300)]
    texts = [f"{prose(r.randint(1, 90), r)} {p} {prose(r.randint(1, 90), r)}" for _ in range(2) for p in passages]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, prose(200, r)) for i in range(50)]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"), min_words=queries.PASSAGE)
    assert len(got) >= 291 and all(300 <= k < 600 for k in got)


def test_removal(spark):
    r = random.Random(3)
    passage, other = prose(60, r), prose(30, r) + "\n\n" + prose(30, r)
    texts = [f"{prose(9, r)}\n{passage}\n{prose(5, r)}", f"{passage.upper()}\nend", f"x\n{other}", f"y y\n{other}\nz", "short line\n" + prose(70, r), "short line\n" + prose(70, r), None, "", passage]
    columns = "doc_id long, text string, spans string, key_ int, copy_ int, copy string, left_ int, row_ int"
    df = spark.createDataFrame([(i, t, "clash", i, 2, "c", 4, 5) for i, t in enumerate(texts)] + [(1, texts[1], "clash", 1, 2, "c", 4, 5)], columns)
    got = found(df)
    at = texts[3].index(other)
    assert got == {1: [(0, len(passage), 60, 0)], 3: [(at, at + len(other), 60, 2)], 5: [(0, 10, 2, 4)], 8: [(0, len(passage), 60, 0)]}
    assert set(found(df, min_words=50)) == {1, 3, 8}
    whole = substring_dedup.remove_spans(df, substring_dedup.repeated_spans(df))
    left = {x.doc_id: x for x in whole.collect()}
    assert whole.columns == df.columns and whole.count() == df.count()
    assert left[0].text == texts[0] and left[1].text == "end" and left[3].text == "y y\nz" and left[8].text == "" and left[6].text is None and left[5].text == texts[5][11:]
    assert all((x.spans, x.key_, x.copy_, x.copy, x.left_, x.row_) == ("clash", i, 2, "c", 4, 5) for i, x in left.items())
    assert substring_dedup.repeated_spans(df.where("false")).count() == 0
    assert substring_dedup.remove_spans(df.where("false"), substring_dedup.repeated_spans(df)).count() == 0


def test_keys(spark):
    r = random.Random(4)
    line = prose(20, r)
    # without a key: last in rank; two texts of one key: told apart; equal rows: one text
    df = spark.createDataFrame([(None, line), (7, f"{line}\nb"), (7, f"a\n{line}"), (7, f"a\n{line}"), (9, line + "\n" + line)], "doc_id long, text string")
    got = found(df)
    assert got[None] == [(0, len(line), 20, 7)] and len(got[7]) == 1 and got[9] == [(0, 2 * len(line) + 1, 40, 7)]
    alone = spark.createDataFrame([(None, line), (None, f"{line}\nb")], "doc_id long, text string")
    assert found(alone)[None][0][3] is None and substring_dedup.repeated_spans(alone).count() == 1


def test_long_text_of_repeats(spark):
    df = spark.createDataFrame([(1, "same line again\n" * 100_000), (2, "word " * 300_000)], "doc_id long, text string")
    got = found(df)
    assert len(got[1]) == 1 and got[1][0][2] == 3 * 99_999 and sum(x[2] for x in got.get(2, [])) < 300_000
    left = {x.doc_id: x.text for x in substring_dedup.remove_spans(df, substring_dedup.repeated_spans(df)).collect()}
    assert left[1] == "same line again\n"
