import random
import time

import numpy as np

from groupwise.llm import suffix_dedup
from groupwise.llm.suffix_array import permuted_common_prefixes, suffix_array
from tests.llm import brute
from tests.llm.fixtures import BASE, TEXTS, documents, empty


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(0)
    for _ in range(1500):
        t = np.append(np.tile(r.integers(1, r.integers(2, 7), r.integers(1, 40)), r.integers(1, 4)), 0)
        sa, symbols = suffix_array(t), t.tolist()
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: symbols[i:])
        common = permuted_common_prefixes(t.astype(np.uint8), sa, 20)
        for a, b in zip(sa[:-1], sa[1:], strict=True):
            n = 0
            while n < 20 and max(a, b) + n < len(t) and symbols[a + n] == symbols[b + n]:
                n += 1
            assert common[b] == n


def corpus(seed, n=120):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdeé\x00", k=r.randint(1, 9))) for _ in range(300)]
    passages = [" ".join(r.choices(words, k=r.randint(8, 60))) for _ in range(8)]
    texts = []
    for _ in range(n):
        parts = [" ".join(r.choices(words, k=r.randint(0, 60)))]
        for _ in range(r.choice([0, 0, 1, 2])):
            p = r.choice(passages)
            a = r.randrange(len(p) // 2)
            parts.append(p[a : a + r.randint(10, len(p))])
            parts.append(" ".join(r.choices(words, k=r.randint(0, 20))))
        texts.append(r.choice(texts) if texts and r.random() < 0.1 else "".join(parts))
    return list(enumerate([*texts, "ab" * 400, "ba" * 300, "x" * 49, "x" * 50, "x" * 700]))


def check(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted(tuple(r) for r in suffix_dedup.digests(df).collect())
    assert found == brute.removed_bytes(rows)
    assert sum(f[2] for f in found) > 1000


def test_against_brute_force(spark):
    check(spark, corpus(1))


def test_many_segments_of_a_name(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MANY_SEGMENTS", 2)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 500)
    monkeypatch.setattr(suffix_dedup, "SEGMENT_WINDOWS", 7)
    check(spark, corpus(2, 80))


def test_a_line_in_all_texts(spark, monkeypatch):
    """The finer minimiser can't split such a line's segments; windows go one by one."""
    monkeypatch.setattr(suffix_dedup, "MANY_SEGMENTS", 20)
    r = random.Random(7)
    other = lambda n: "".join(r.choices("abcdefghij ", k=n))
    for length, common in ((60, 5), (60, 0), (90, 50_000)):
        monkeypatch.setattr(suffix_dedup, "COMMON_WINDOWS", common)
        line = "".join(r.choices("KLMNOPQRST ", k=length))
        check(spark, [(i, other(r.randint(40, 90)) + line + other(r.randint(40, 90))) for i in range(150)])


def test_pieces_of_several_batches_are_one(spark):
    """A segment met in many batches gives no more rows than one met once."""
    r = random.Random(4)
    segments = ["".join(r.choices("ab", k=60)).encode() for _ in range(5)] + [b"ab" * 40]
    rows = [(1, 2, k, 0, bytearray(x), 100 * b + k) for b in range(30) for k, x in enumerate(segments)]
    pieces = spark.createDataFrame(rows, suffix_dedup.PIECES).repartition(6)
    found, _ = suffix_dedup._by_window(pieces, 50)
    plain = sorted(map(tuple, suffix_dedup._settled(pieces, 50).collect()))
    least = lambda rows: {(s, a + k): f for _, s, a, n, f in sorted(rows, key=lambda r: -r[4]) for k in range(n)}
    found = sorted(map(tuple, found.collect()))
    assert least(found) == least(plain) and len(found) <= 2 * len(segments)


def test_texts_with_one_hash_are_told_apart(spark, monkeypatch):
    keys = suffix_dedup._keys
    monkeypatch.setattr(suffix_dedup, "_keys", lambda *a: [*keys(*a)[:2], (keys(*a)[2] % 4).alias("text_hash"), keys(*a)[3]])
    check(spark, corpus(5, 60))


def test_texts_in_small_slices(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 3_000)
    check(spark, corpus(6, 80))
    rows = corpus(3)
    texts = [t.encode() for _, t in rows]
    whole = [tuple(map(int, r)) for at, own, *more in suffix_dedup.named_runs(texts, 50) for r in zip(own + at, *more)]
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    assert [tuple(map(int, r)) for at, own, *more in suffix_dedup.named_runs(texts, 50) for r in zip(own + at, *more)] == whole


def test_arrays_are_filled_with_what_is_comparable(monkeypatch):
    """Shards over many batches: lone segments and those without a common window take no room in an array."""
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 20_000)
    r, found, built = random.Random(4), {}, []

    class Dealt:
        repartition = sortWithinPartitions = lambda self, *_: self

        def mapInArrow(self, run, _):
            found["run"] = run

    build = suffix_dedup.shard_first_documents
    monkeypatch.setattr(suffix_dedup, "shard_first_documents", lambda s, *a: built.append(sum(map(len, s))) or build(s, *a))
    rows = []
    for shard in range(1000):
        made = [r.randbytes(r.randint(50, 90)) for _ in range(1 + shard % 3)]
        if shard % 50 == 1:
            made.append(b"+" + made[0] + b"+")
        rows += [(shard, shard, k, 0, m, 10 * k + o) for k, m in enumerate(made) for o in (7, 3, 5)]
    suffix_dedup._settled(Dealt(), 50)
    batches = [suffix_dedup._pieces(rows[k : k + 37]) for k in range(0, len(rows), 37)]
    first = {}
    for b in found["run"](iter(batches)):
        for name, seg_hash, at, windows, owner in zip(*(c.to_pylist() for c in b.columns), strict=True):
            first.update({(name, seg_hash, at + k): owner for k in range(windows)})
    least = {}
    for shard, _, k, _, m, owner in rows:
        for at in range(len(m) - 49):
            least[shard, m[at : at + 50]] = min(owner, least.get((shard, m[at : at + 50]), owner))
    assert first == {(shard, k, at): least[shard, m[at : at + 50]] for shard, _, k, _, m, _ in rows for at in range(len(m) - 49)}
    assert len(built) == 1


def test_comparable_segments_have_a_window_twice():
    r = random.Random(2)
    segments = [("".join(r.choices("ab", k=r.randint(8, 14)))).encode() for _ in range(40)]
    count = {}
    for s in segments:
        for k in range(len(s) - 7):
            count[s[k : k + 8]] = count.get(s[k : k + 8], 0) + 1
    expected = [any(count[s[k : k + 8]] > 1 for k in range(len(s) - 7)) for s in segments]
    assert suffix_dedup.comparable(segments, 8).tolist() == expected and len(set(expected)) == 2


def test_periods_and_runs_cost_no_more():
    """Steps of a scan do not follow runs or periods symbol by symbol."""
    r = np.random.default_rng(1)
    seconds = {}
    for name, t in {"random": r.integers(1, 27, 100_000), "one symbol": np.ones(100_000, int), "two": np.tile([1, 2], 50_000), "seven": np.tile([3, 1, 2, 5, 4, 2, 6], 14_286)}.items():
        times = []
        for _ in range(3):
            began = time.perf_counter()
            suffix_array(np.append(t, 0))
            times.append(time.perf_counter() - began)
        seconds[name] = min(times) / len(t)
    assert max(seconds.values()) < 3 * seconds["random"], seconds


def test_awkward_rows(spark):
    docs = documents(spark, [(300, TEXTS[7] + BASE, "fr", None, None, None, None), (301, TEXTS[7] + BASE, "fr", None, None, None, None), (302, BASE, "", "", 0, 0, ""), (302, BASE + "x", "", "", 0, 0, "")])
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = suffix_dedup.digests(docs).collect()
    assert sorted(tuple(r) for r in found if r["doc_id"] is not None) == sorted(brute.removed_bytes([r for r in rows if r[0] is not None]))
    assert [(r["n_removed"], r["n_spans"]) for r in found if r["doc_id"] is None] == [(0, 0)]
    assert suffix_dedup.digests(empty(docs)).count() == 0
    kept = suffix_dedup.remove(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert {r["text"] for r in kept.where("doc_id in (1, 301)").collect()} == {""}
    inner = ["__hash", "__id", "spans", "whole", "rest", "digest", "text_hash", "none"]
    clash = docs.selectExpr("doc_id", "text", *[f"{k} as `{c}`" for k, c in enumerate(inner)])
    assert sorted(map(str, suffix_dedup.remove(clash).select("doc_id", "text").collect())) == sorted(map(str, kept.select("doc_id", "text").collect()))
    assert {tuple(r)[2:] for r in suffix_dedup.remove(clash).collect()} == {tuple(range(len(inner)))}
