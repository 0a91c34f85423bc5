"""Each stage against a plain version of it, on rows with nulls, copies, secrets and clashing columns; and run() as a whole."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import types as T

from cliquora.llm import queries, quality_rules, secret_scans
from tests.llm import test_operators as plain

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    long = " ".join(f"word{i}" for i in range(300))
    rows = [(i, t, "en", [None, "a", "b"][i % 3], len(t or ""), "clash", i) for i, t in enumerate(plain.TEXTS)]
    rows += [(200 + i, long + (" more" if i else ""), None, "a", None, None, None) for i in range(4)]
    rows += [(None, plain.prose(60), "en", "a", 5, "x", 1), (None, plain.prose(70), "en", None, 5, "x", 1), (300, f"{plain.prose(40)} token={'Ab3' * 8} end", "en", "b", 1, "x", 1)]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(("doc_id", "text", "lang", "source", "n_chars", "kept", "size"), (T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.LongType(), T.StringType(), T.IntegerType()), strict=True)])
    return spark.createDataFrame(rows, schema)


def test_stages(spark, documents):
    rows, stages = documents, dict(corpus_pipeline.STAGES)
    columns = documents.columns

    good = stages["quality"](spark, rows, DATA).checkpoint()
    kept = {tuple(r) for r in good.collect()}
    judged = quality_rules.apply_rules(rows, queries.quality_of(spark, DATA), ["doc_id", "text"]).collect()
    assert good.columns == columns and kept == {tuple(r) for r in rows.collect() if any(j.kept and (j.doc_id, j.text) == (r.doc_id, r.text) for j in judged)}
    assert sum(r[0] is None for r in kept) == 2

    alone = stages["near_dedup"](spark, good, DATA).checkpoint()
    found = alone.collect()
    ids = {r.doc_id for r in found if r.doc_id is not None}
    least = plain.plain_components({r.doc_id: plain.plain_fingerprint(r.text) for r in good.collect() if r.doc_id is not None})
    assert alone.columns == columns and ids == set(least.values()) and sum(r.doc_id is None for r in found) == 2
    assert 200 in ids and not {201, 202, 203} & ids

    clean = stages["secrets"](spark, alone, DATA).checkpoint()
    models = secret_scans.train(secret_scans.labelled_samples(spark, alone))
    before = {r.doc_id: r.text for r in found if r.doc_id is not None}
    for r in clean.collect():
        if r.doc_id is not None:
            assert r.n_chars == len(r.text) and (r.text == before[r.doc_id]) == (not plain.plain_base(before[r.doc_id]) and not plain.plain_models(models, before[r.doc_id]))
            assert not plain.plain_base(r.text)
    assert clean.columns == columns and clean.count() == alone.count()

    mixed = stages["mix"](spark, clean, DATA).checkpoint()
    sizes, taken, longest = {}, {}, {}
    for r in clean.collect():
        n = len(re.findall(plain.WORD, r.text))
        sizes[r.source] = sizes.get(r.source, 0) + n
        # rows without an id share one fate
        longest[r.source] = max(longest.get(r.source, 0), n) + (n if r.doc_id is None else 0)
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + len(re.findall(plain.WORD, r.text))
    target = plain.plain_targets(sizes)
    assert mixed.columns == columns and all(abs(taken.get(k, 0) - target[k]) <= longest[k] + 60 for k in sizes)

    packed = stages["pack"](spark, mixed, DATA)
    assert packed.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    once = mixed.where("doc_id is not null").dropDuplicates(["doc_id"])
    plain.check_packing(stages["pack"](spark, once, DATA).collect(), {r.doc_id: r.text for r in once.collect()})


def test_empty_tables_pass(spark, documents):
    rows = documents.where("false")
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, DATA)
    assert rows.count() == 0


def test_run(spark):
    got = corpus_pipeline.run(spark, DATA)
    assert got.count() > 0 and len(corpus_pipeline.STAGES) == 5
