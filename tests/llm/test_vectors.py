import numpy as np

from groupwise.llm import vector_dedup
from tests.llm import brute
from tests.llm.fixtures import empty, vectors


def usable(r):
    v = r["embedding"]
    return r["vec_id"] is not None and r["label"] is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute_force(rows, limit=0.98):
    ok = [(k, r["vec_id"], r["label"], np.array(r["embedding"], float)) for k, r in enumerate(rows) if usable(r)]
    links, count = [], {}
    for n, (k, a, la, v) in enumerate(ok):
        for j, b, lb, w in ok[:n]:
            if la == lb and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= limit:
                links.append((a, b))
                count[k] = count.get(k, 0) + 1
                count[j] = count.get(j, 0) + 1
    comp = brute.component_ids([r["vec_id"] for r in rows if r["vec_id"] is not None], links)
    return sorted((r["vec_id"], count.get(k, 0), comp[r["vec_id"]], r["vec_id"] == comp[r["vec_id"]]) for k, r in enumerate(rows) if r["vec_id"] is not None), len(links)


def found(df):
    return sorted(tuple(r) for r in vector_dedup.near_duplicates(df).collect() if r["vec_id"] is not None)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "ROWS", 16)
    df = vectors(spark, n=400, dim=16)
    expected, n = brute_force(df.collect())
    got = found(df)
    assert n > 60 and len(got) == len(expected)
    assert sum(g[1] for g in got) >= 0.95 * sum(e[1] for e in expected)
    assert all(g[1] <= e[1] and g[2] >= e[2] for g, e in zip(got, expected, strict=True))
    assert np.mean([g == e for g, e in zip(got, expected, strict=True)]) > 0.95
    assert [tuple(r)[1:] for r in vector_dedup.near_duplicates(df).collect() if r["vec_id"] is None] == [(0, None, None)]
    assert vector_dedup.near_duplicates(empty(df)).count() == 0


def test_one_large_family_in_many_dimensions(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "ROWS", 64)
    r = np.random.default_rng(3)
    centre = r.normal(size=48)
    near = centre + r.normal(size=(300, 48)) * 0.08
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate([*near, *r.normal(size=(300, 48)), centre, centre])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    expected, n = brute_force(df.collect())
    got = found(df)
    assert n > 30_000
    assert sum(g[1] for g in got) >= 0.98 * sum(e[1] for e in expected)
    assert [g[2] for g in got] == [e[2] for e in expected]
