"""Embedding near-dedup, the Merkle manifest and ranked search against plain versions, edge cases included."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cliquora.llm import embedding_dedup, merkle, queries, ranked_search
from cliquora.llm.common import table

DATA = "/root/testdata/sf0.001"


# 11. Embeddings


def plain_links(rows, least=0.98):
    """vec_id -> (n_links, component_id, kept) for unique ids."""
    def sound(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    units = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v, label in rows if label is not None and sound(v)}
    label = {i: x for i, _, x in rows}
    up = {i: i for i, _, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    n = Counter()
    own = sorted(units)
    for a, i in enumerate(own):
        for j in own[a + 1 :]:
            if label[i] == label[j] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least:
                n[i] += 1
                n[j] += 1
                up[max(root(i), root(j))] = min(root(i), root(j))
    return {i: (n[i], root(i), root(i) == i) for i in up}


def found_links(df):
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"]
    rows = df.collect()
    assert len({r.vec_id for r in rows}) == len(rows)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows}


VECTORS = "vec_id long, embedding array<double>, label int, h string, cell int, copies int"


def clouds(seed, n, dim, groups):
    """Near copies around centres, at cosines on both sides of 0.98, and lone vectors."""
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i % 3:
            base = np.random.default_rng(10_000 + i % groups).normal(size=dim)
            v = base + r.normal(size=dim) * r.choice([0.0, 0.05, 0.1, 0.14])
        else:
            v = r.normal(size=dim)
        rows.append((i, [float(x) for x in v], int(i % 2)))
    return rows


def test_vectors_of_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (9, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (6, [1.0, 0.0], None), (7, None, 1), (8, [], 1), (10, [0.0, 0.0], 1), (11, [nan, 1.0], 1),
            (12, [inf, 1.0], 1), (13, [1.0, None], 1), (14, [1.0, 0.0, 0.0], 1), (15, [-1.0, 0.0], 1), (16, [1e-200, 1e-203], 1), (17, [1e200, 1e190], 1), (18, [-0.0, 1.0], 1), (19, [0.0, 1.0], 1)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS)
    got = found_links(embedding_dedup.near_duplicates(df))
    one = (4, 3, False)
    assert {i: got[i] for i in (3, 5, 9, 16, 17)} == {3: (4, 3, True), 5: one, 9: one, 16: one, 17: one}
    assert got[18] == (1, 18, True) and got[19] == (1, 18, False)
    assert all(got[i] == (0, i, True) for i in (4, 6, 7, 8, 10, 11, 12, 13, 14, 15))
    assert embedding_dedup.near_duplicates(df.where("false")).collect() == []
    assert [tuple(r) for r in embedding_dedup.near_duplicates(df.where("vec_id = 7")).collect()] == [(7, 0, 7, True)]


def test_null_and_repeated_ids(spark):
    rows = [(None, [1.0, 0.0], 1), (4, [1.0, 0.01], 1), (4, [1.0, 0.01], 1), (None, [0.0, 1.0], 1)]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS)).collect()), key=str)
    assert got == sorted([(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (None, 0, None, True)], key=str)


@pytest.mark.parametrize("settings", [{}, {"cell": 4}, {"cell": 4, "tile": 7, "hot": 1}, {"cell": 10_000, "tile": 16}])
def test_vectors_against_all_pairs(spark, settings):
    """At 12 dimensions the margin is exact, so that no link is missed whatever the cells and tiles."""
    rows = clouds(3, 400, 12, 9) + [(1000 + i, [1.0] * 12, 1) for i in range(40)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS)
    assert found_links(embedding_dedup.near_duplicates(df, **settings)) == plain_links(rows)


def test_recall_across_borders(spark):
    """64 dimensions, many small cells: links across borders that the margin catches, and what no visits at all would lose."""
    rows = [(i, v, 1) for i, v, _ in clouds(5, 900, 64, 40)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS)
    plain = sum(n for n, _, _ in plain_links(rows).values())
    links = lambda deviations: sum(n for n, _, _ in found_links(embedding_dedup.near_duplicates(df, cell=8, deviations=deviations)).values())
    assert plain > 2000 and links(4.0) >= 0.999 * plain and links(-1.0) < links(4.0)


def test_sampled_centroids_index_every_row(spark):
    rows = clouds(7, 300, 12, 9)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS)
    assert found_links(embedding_dedup.near_duplicates(df, sample=64, cell=8)) == plain_links(rows)


# 12. Merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def coded(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def plain_tree(nodes):
    """The root, and of each node the siblings by level with the place of the node among them."""
    paths = [[] for _ in nodes]
    places, level = list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, p in enumerate(places):
            run = level[p // 8 * 8 : p // 8 * 8 + 8]
            paths[i].append((run[: p % 8], run[p % 8 + 1 :]))
        level = [sha(*level[i : i + 8]) for i in range(0, len(level), 8)]
        places = [p // 8 for p in places]
    return level[0], paths


def plain_manifest(rows):
    leaf = lambda r: sha(*map(coded, r))

    def other(r):
        if r[0] is None or zlib.crc32(str(r[0]).encode()) % 3 or r[4] is None:
            return r
        return (*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4]))

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    out, roots, own = [], [], []
    for lang in langs:
        part = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, paths = plain_tree([leaf(r) for r in part])
        roots.append(root)
        own.append((part, paths))
    root, above = plain_tree(roots)
    for (part, paths), subroot, top in zip(own, roots, above, strict=True):
        for r, path in zip(part, paths, strict=True):
            node = leaf(other(r))
            for left, right in [*path, *top]:
                node = sha(*left, node, *right)
            out.append((r[0], leaf(r), subroot, root, sha(*(x for left, right in [*path, *top] for x in [*left, *right])), node, node == root))
    return sorted(out, key=str)


DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf int, tree int, pos int"


def manifest_of(spark, rows, **settings):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], DOCS)
    found = merkle.manifest(merkle.leaves(df, merkle.tampered_text()), **settings)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def many_rows():
    rows = [(i * 7 % 601, f"s{i % 5}", "en", i, f"Text {i} ÄÖ") for i in range(601)] + [(1000 + i, None, f"l{i:02}", None, "ab" if i % 2 else "AB") for i in range(20)]
    rows += [(2000 + i, "s", None, 3, None if i % 3 else "") for i in range(9)] + [(None, "s", "fr", 1, "X Y"), (None, None, "fr", None, None), (7, "s", "en", 0, "again"), (7, "s", "en", 0, "again")]
    return rows + [(3000, "s", "é", 1, "Q" * 300_000), (3001, "s", "z", 1, "q")]


@pytest.mark.parametrize("high", [merkle.HIGH, 80, 0])
def test_manifest_against_plain(spark, high):
    """high: with 0, all levels are joined by shuffles."""
    assert manifest_of(spark, many_rows(), high=high) == plain_manifest(many_rows())


def test_manifest_of_few(spark):
    assert manifest_of(spark, []) == []
    one = [(5, "s", "en", 1, "A")]
    assert manifest_of(spark, one) == plain_manifest(one)
    for n in (8, 9, 65):
        rows = [(i, "s", "en", 1, "a") for i in range(n)]
        assert manifest_of(spark, rows) == plain_manifest(rows)


def test_manifest_tells_tampering(spark):
    got = queries.op12_merkle_manifest(spark, DATA).collect()
    plain = {r.doc_id: r for r in table(spark, DATA, "documents").collect()}
    assert len(got) == len(plain)
    for r in got:
        tampered = zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and re.search("[A-Z]", plain[r.doc_id].text)
        assert r.verified == (not tampered)


# 13. Ranked search


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_ranks(docs, items, best=20):
    own = [(i, Counter(plain_terms(t))) for i, t in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    n, length = len(own), sum(x[2] for x in own)
    df = Counter(t for _, c, _ in own for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        asked = Counter(plain_terms(text))
        scores = []
        for i, c, size in own:
            m = 75 + 25 * size * n // length
            score = sum(q * weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            if score > 0:
                scores.append((-score, i is not None, i or 0, i))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scores)[:best])]
    return sorted(out, key=str)


def ranks_of(spark, docs, items, **settings):
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in docs], "doc_id long, text string, row int, n int, item int")
    items = spark.createDataFrame([(*r, 1, 2, 3) for r in items], "item_id long, text string, tid int, score int, row int")
    found = ranked_search.search(docs, items, **settings)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def words_of(seed, n, size):
    """Texts of words by a power law, with repeats, ties and some equal texts."""
    r = np.random.default_rng(seed)
    return [" ".join(f"w{int(x) % 300}" for x in r.zipf(1.3, int(r.integers(1, size)))) for _ in range(n)]


@pytest.mark.parametrize("most", [ranked_search.VOCABULARY, 20])
def test_search_against_plain(spark, most):
    docs = list(enumerate(words_of(1, 600, 40))) + [(700, None), (701, ""), (702, " \n!?"), (703, "W1 w1é Ünï w2-w2 ¡w3! 5_5"), (None, "w250 w1"), (9, "w250 w1"), (9, "w250 w1"), (704, "w7 w8 " * 30_000)]
    items = list(enumerate(words_of(2, 25, 30))) + [(50, None), (51, "nothing here"), (52, "w1 W1 w1é ünÏ"), (None, "w250 w3"), (3, "w250 w3"), (3, "w250 w3"), (53, "w1")]
    assert ranks_of(spark, docs, items, most=most) == plain_ranks(docs, items)


def test_search_small_and_empty(spark):
    assert ranks_of(spark, [], [(1, "a")]) == [] and ranks_of(spark, [(1, "a")], []) == [] and ranks_of(spark, [(1, None)], [(1, "a")]) == []
    docs, items = [(i, "a b" if i % 2 else "a") for i in range(60)], [(1, "a b"), (2, "b"), (3, "a")]
    assert ranks_of(spark, docs, items) == plain_ranks(docs, items)
    assert ranks_of(spark, docs, items, best=3) == plain_ranks(docs, items, 3)


def test_search_prunes_frequent_terms(spark):
    """What is safe to leave out is left out: a term in every document makes no candidates beside a rare one that k documents have."""
    docs = [(i, "the " * (1 + i % 3) + ("rare" if i < 30 else "other")) for i in range(500)]
    assert ranks_of(spark, docs, [(1, "the rare")]) == plain_ranks(docs, [(1, "the rare")])
