import random

import numpy as np
import pytest

from groupwise.llm import jaccard_join
from groupwise.llm.shingles import shingle_sets
from tests.llm import brute
from tests.llm.fixtures import TEXTS, documents, empty


def families(seed, n=250):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    while len(texts) < n:
        if texts and r.random() < 0.75:
            w = r.choice(texts[-12:] if r.random() < 0.7 else texts).split()
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
                at = r.randrange(len(w) + 1)
                w[at : at + r.randint(0, 2)] = r.choices(vocabulary, k=r.randint(0, 2))
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(r.choices(vocabulary, k=r.choice([0, 1, 2, 3, 5, 9, 12, 20, 40, 80, 150]))))
    return list(enumerate(texts))


def test_shingle_sets():
    for words in (1, 3, 5):
        for t, s in zip(TEXTS.values(), shingle_sets(TEXTS.values(), words), strict=True):
            assert len(s) == len(brute.shingles(t, words))
            assert (np.diff(s.astype(object)) > 0).all()


@pytest.mark.parametrize(("num", "den"), [(9, 10), (4, 5)])
def test_similar_sets_share_a_signature(num, den):
    r = np.random.default_rng(5)
    for _ in range(400):
        n = int(r.choice([1, 4, 5, 9, 10, 11, 19, 30, 60, 150, 400, 900]))
        common = r.integers(0, 1 << 63, n).astype(np.uint64)
        most = n * (den - num) // num
        extra = int(r.integers(0, most + 1))
        left = int(r.integers(0, extra + 1))
        more = r.integers(0, 1 << 63, extra).astype(np.uint64)
        a, b = np.sort(np.concatenate([common, more[:left]])), np.sort(np.concatenate([common, more[left:]]))
        assert den * n >= num * (n + extra)
        assert len(np.intersect1d(jaccard_join.signatures(a, num, den), jaccard_join.signatures(b, num, den)))


def test_cells_never_rule_out_a_link():
    r = np.random.default_rng(6)
    ruled_out = 0
    for _ in range(300):
        n = int(r.choice([5, 20, 64, 300, 900]))
        common = r.integers(0, 1 << 63, n).astype(np.uint64) << np.uint64(1)
        extra = int(r.integers(0, n // 2 + 1))
        more = r.integers(0, 1 << 63, extra).astype(np.uint64) << np.uint64(1)
        a, b = np.sort(np.concatenate([common, more[: extra // 3]])), np.sort(np.concatenate([common, more[extra // 3 :]]))
        found = jaccard_join.may_link([len(a), len(b)], [jaccard_join.cell_counts(a), jaccard_join.cell_counts(b)], 4, 5)
        if 5 * n >= 4 * (n + extra):
            assert found
        ruled_out += not found
    assert ruled_out > 50
    # a row without a bound connects all rows, with one pair a row
    for k in range(3):
        cells = [b"\1" * 8] * 3
        cells[k] = b""
        assert sorted(jaccard_join.may_link([3, 3, 3], cells, 4, 5)) == [(k, j) for j in range(3) if j != k]


@pytest.mark.parametrize("small", [64, 3])
@pytest.mark.parametrize(("words", "num", "den"), [(3, 9, 10), (5, 4, 5)])
def test_classes_against_brute_force(spark, monkeypatch, words, num, den, small):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "HELD_SMALL", small)
    monkeypatch.setattr(jaccard_join, "HELD", 5_000)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "TILE", 2)
    rows = families(words)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.classes(df, words, num, den).collect())
    assert found == brute.jaccard_classes(rows, words, num, den)
    assert len({f[2] for f in found}) < len(found) - 20


def test_families_of_many_components(spark, monkeypatch):
    """Rows that share a signature, but few links: families stay open and are compared tile by tile."""
    for name, n in (("SMALL", 2), ("HELD_SMALL", 2), ("BLOCK", 5), ("TILE", 2)):
        monkeypatch.setattr(jaccard_join, name, n)
    r = random.Random(12)
    head = [f"h{i}" for i in range(30)]
    rows = []
    for i in range(140):  # the head is shared by all; tails make some of them similar enough
        tail = [f"t{r.randrange(12)}x{k}" for k in range(r.choice([3, 6, 9, 12]))]
        rows.append((i, " ".join(head + tail)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for words, num, den in ((1, 4, 5), (1, 9, 10), (2, 4, 5)):
        found = sorted((c["doc_id"], c["n_shingles"], c["component_id"]) for c in jaccard_join.classes(df, words, num, den).collect())
        assert found == brute.jaccard_classes(rows, words, num, den)
        assert 1 < len({f[2] for f in found}) < 140


def test_a_signature_of_many_rows_that_do_not_link(spark, monkeypatch):
    """A bucket above the limit is compared group by group, in rounds; its rows don't become one family."""
    monkeypatch.setattr(jaccard_join, "SMALL", 10)
    monkeypatch.setattr(jaccard_join, "ROUND", 2)
    head = " ".join(f"h{k}" for k in range(100))
    rows = [(i, head + "".join(f" t{i}x{k}" for k in range(100))) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " more") for i in range(0, 60, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = jaccard_join._set_rows(df, 1)
    met = jaccard_join._candidates(df, sets, 1, 4, 5)
    assert {(r["a"], r["b"]) for r in met.collect()} == {(100 + i, i) for i in range(0, 60, 9)}
    found = sorted((c["doc_id"], c["n_shingles"], c["component_id"]) for c in jaccard_join.classes(df, 1, 4, 5).collect())
    assert found == brute.jaccard_classes(rows, 1, 4, 5)


def test_sets_share_few_empty_choices():
    r, params = np.random.default_rng(9), (24, 2, 1, 3)
    sets = [np.sort(r.integers(0, 1 << 63, 120).astype(np.uint64) << np.uint64(1)) for _ in range(400)]
    signatures = [set(jaccard_join.band_signatures(s, jaccard_join.mix(s), 3, params).tolist()) for s in sets]
    shared = sum(len(a & b) for k, a in enumerate(signatures) for b in signatures[:k])
    assert shared < 0.08 * 400 * 399 / 2


def test_blocks_are_cut_by_counts(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 10)
    rows = spark.createDataFrame([(i, 5 + i % 3, i % 4 if i < 400 else 9) for i in range(408)], "doc_id long, n long, family long")
    found, read = jaccard_join._blocked(rows, ["n"], [rows["n"]])
    assert read.count() == 12
    held = {}
    for r in found.collect():
        assert (r["block"] is None) == (r["family"] == 9)
        held.setdefault((r["family"], r["block"]), []).append(r["n"])
    sizes = {k: len(v) for k, v in held.items() if k[1] is not None}
    assert max(sizes.values()) < 30 and {k[1] for k in sizes} <= set(range(10))
    for f in range(4):
        mean = [np.mean(held[f, b]) for b in sorted(b for g, b in sizes if g == f)]
        assert mean == sorted(mean)


def test_awkward_rows(spark):
    docs = documents(spark, [(200 + i, TEXTS[0], "en", None, None, 3, "y") for i in range(40)])
    found = jaccard_join.classes(docs, 3, 9, 10).collect()
    assert len(found) == docs.count()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found if r["doc_id"] is not None) == brute.jaccard_classes(rows, 3, 9, 10)
    assert [r["component_id"] for r in found if r["doc_id"] is None] == [None]
    assert jaccard_join.classes(empty(docs)).count() == 0
