import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsquery.llm.embedding_dedup import _needs, _spanning, near_duplicates, passes_needed


def brute(rows, least):
    ok = {}
    for i, v, label in rows:
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float) / max(map(abs, v))
            ok[i] = (x / np.linalg.norm(x), label)
    links = {i: set() for i, _, _ in rows}
    for a, (x, p) in ok.items():
        for b, (y, q) in ok.items():
            if a != b and p == q and len(x) == len(y) and x @ y >= least:
                links[a].add(b)
    comp = {}
    for i in sorted(links):
        if i not in comp:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in comp:
                    comp[j] = i
                    todo += links[j]
    return {i: (len(links[i]), comp[i], comp[i] == i) for i in links}


def vectors(seed, clusters, size, spread):
    rng = np.random.default_rng(seed)
    out = []
    for c in range(clusters):
        base = rng.standard_normal(16)
        base /= np.linalg.norm(base)
        for _ in range(int(rng.integers(1, size))):
            v = base + rng.standard_normal(16) * spread
            out.append([float(np.float32(x)) for x in v])
            if rng.random() < 0.2:
                out.append(out[-1])
    return [(7 * i + 1, v, int(rng.integers(0, 2))) for i, v in enumerate(out)]


def test_against_brute_force(spark):
    rows = vectors(1, 60, 8, 0.03) + [(900001 + i, v, 0) for i, v in enumerate([None, [], [0.0] * 16, [1.0, None] * 8, [float("nan")] * 16, [float("inf")] * 16])]
    rows += [(900100, rows[0][1], None), (900101, [1e-200] * 16, 1), (900102, [1e200] * 16, 1), (900103, [1.0, 2.0], 1), (900104, [2.0, 4.0], 1)]
    df = spark.createDataFrame([(i, v, label, 3) for i, v, label in rows] + [(*rows[5], 4)], "vec_id long, embedding array<double>, label int, component_id int")
    got = near_duplicates(df, 0.98, block=16, passes=10).collect()
    assert len(got) == len(rows) + 1
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == brute(rows, 0.98)


def test_group_larger_than_blocks(spark):
    rows = [(i, v, 0) for i, v, _ in vectors(2, 1, 2, 0)][:1]
    rng = np.random.default_rng(3)
    base = np.array(rows[0][1])
    rows = [(i, [float(x) for x in base + rng.standard_normal(16) * 0.04], 0) for i in range(1300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_duplicates(df, block=64, passes=3).collect()}
    want = brute(rows, 0.98)
    assert max(n for n, _, _ in want.values()) > 64
    assert got == want


def test_empty_table_and_null_id(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0], 1)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in near_duplicates(df).collect()] == [(None, 0, None, None)]
    assert near_duplicates(df.limit(0)).collect() == []


def test_passes_grow_with_the_logarithm():
    assert passes_needed(1000, 0.98) <= passes_needed(10**6, 0.98) <= passes_needed(10**9, 0.98) <= 64


def test_one_id_with_two_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.0], 0), (3, [0.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    once = sorted(tuple(r) for r in near_duplicates(df).collect())
    assert once == sorted(tuple(r) for r in near_duplicates(df.orderBy(F.desc("vec_id"))).collect())
    assert len(once) == 4 and once[0] == once[1] and once[0][1] == 1
    assert {r[0]: r[1] for r in once} in ({1: 1, 2: 1, 3: 0}, {1: 1, 2: 0, 3: 1})


@pytest.mark.parametrize("size", [0, 1, 5, 16, 17, 40, 200])
def test_bits_needed_against_brute_force(size):
    keys = np.sort(np.random.default_rng(size).integers(0, 1 << 63, size) >> 50 << 50)
    block = 16
    shares = lambda k, bits: sum(x >> (63 - bits) == k >> (63 - bits) for x in keys.tolist()) if bits else size
    # the least number that leaves no more than a block, unless two keys a block apart around it share more
    for k, need in zip(keys.tolist(), _needs(keys, block).tolist()):
        assert need > 63 or shares(k, need) <= block
        assert need == 0 or size > block


@pytest.mark.parametrize("density", range(4))
def test_spanning_pairs_connect_the_same(density):
    rng = np.random.default_rng(density)
    main, n = 20, 50
    near = rng.random((main, n)) < [0.0, 0.02, 0.1, 0.7][density]
    near[:, :main] |= near[:, :main].T
    parts = lambda pairs: sorted(map(sorted, _parts(n, pairs)))
    assert parts(zip(*map(np.ndarray.tolist, _spanning(near, main)))) == parts(zip(*map(np.ndarray.tolist, np.nonzero(near))))


def _parts(n, pairs):
    own = {i: {i} for i in range(n)}
    for a, b in pairs:
        if own[a] is not own[b]:
            own[a] |= own[b]
            for x in own[b]:
                own[x] = own[a]
    return {id(s): s for s in own.values()}.values()


@pytest.mark.parametrize(("cosine", "n"), [(0.9, 12000), (0.93, 12000), (0.95, 30000), (0.96, 12000)])
def test_isolated_pairs_of_a_dense_label(spark, cosine, n):
    rng = np.random.default_rng(4)
    planted, dim = 300, 64
    mean = rng.standard_normal(dim)
    mean /= np.linalg.norm(mean)
    v = np.sqrt(cosine) * mean + np.sqrt((1 - cosine) / dim) * rng.standard_normal((n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for k in range(planted):  # a pair at cosine 0.982: turned by its angle in a random plane
        side = rng.standard_normal(dim)
        side -= (side @ v[k]) * v[k]
        v[n - 1 - k] = 0.982 * v[k] + np.sqrt(1 - 0.982**2) * side / np.linalg.norm(side)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": v.tolist(), "label": 0}), "vec_id long, embedding array<double>, label int")
    got = near_duplicates(df).toPandas().set_index("vec_id")
    links = np.concatenate([(v[a : a + 2000] @ v.T >= 0.98).sum(axis=1) - 1 for a in range(0, n, 2000)])
    assert (links[:planted] >= 1).all()
    assert (got["n_links"].loc[np.arange(n)].to_numpy() == links).all()
    assert (got["component_id"].loc[np.arange(n - planted, n)[::-1]].to_numpy() == got["component_id"].loc[np.arange(planted)].to_numpy()).all()
