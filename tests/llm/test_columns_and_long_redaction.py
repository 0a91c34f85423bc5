"""Columns of any name and type through every stage, ids that are texts, and texts with very many secrets."""

import re
import time

import corpus_pipeline
import pytest

from cliquora.llm import common, secret_scans
from tests.llm import test_operators as plain

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id string, text string, lang string, source string, n_chars long, `a.b` string, `c``d` int, tags map<string,int>, deep array<map<string,int>>"


@pytest.fixture(scope="module")
def rows(spark):
    body = [plain.prose(60 + 5 * i) for i in range(6)]
    row = lambda i, t, tags: (i, t, "en", "ab"[len(t) % 2], len(t), "dot", 1, tags, [tags])
    found = [row(f"doc {i}", t, {"x": i, "y": 2}) for i, t in enumerate(body)]
    # repeated rows, a copy with a later id, and copies without an id, which all go
    found += [found[0], row("doc 9", body[0], {"x": 0}), row(None, body[1], {"x": 1}), row(None, body[2], None)]
    return spark.createDataFrame(found, SCHEMA)


def test_any_columns(spark, rows):
    docs = rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).checkpoint()
        assert docs.columns == rows.columns, name
        if name == "near_dedup":
            kept = docs.collect()
            ids = [r.doc_id for r in kept]
            assert None not in ids and len(ids) == len(set(ids)) and "doc 0" in ids and "doc 9" not in ids
            assert all(r.tags["y"] == 2 and r["a.b"] == "dot" and r["c`d"] == 1 for r in kept)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r.doc_id for r in packed.collect()} <= {f"doc {i}" for i in range(6)}


def test_row_hash(spark):
    same = spark.sql("select map('x', 1, 'y', 2) as `a.b`, 1 as other union all select map('y', 2, 'x', 1), 2 union all select map('x', 1), 3 union all select null, 4")
    found = [r[0] for r in same.select(common.row_hash(same, "other")).collect()]
    assert found[0] == found[1] and len(set(found)) == 3


def test_redaction_across_blocks(spark):
    models = secret_scans.Models(tuple(0.0 for _ in range(secret_scans.STATES**2)), 1.0)
    secret = f"token={'Ab3' * 5}"
    texts = ["\U0001f600\n" * n + secret + " é" * m + secret + " end" for n in (0, 1, 500, 509, 512, 513, 1020) for m in (1, 2, 498, 512, 1025)]
    texts += [secret, secret + "\n", "none", "", None, " ".join([secret] * 700)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in secret_scans.redact(docs, models).collect()}
    assert got == {i: None if t is None else t.replace(secret, "[secret]") for i, t in enumerate(texts)}


def test_many_secrets_in_one_text(spark):
    models = secret_scans.Models(tuple(0.0 for _ in range(secret_scans.STATES**2)), 1.0)
    text = " ".join(f"word{i} token=Ab3Ab3Ab{i:05d}" for i in range(20_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    got = secret_scans.redact(docs, models).first().text
    assert got == re.sub(r"token=\w+", "[secret]", text)
    print("seconds", time.time() - began)
    assert time.time() - began < 60
