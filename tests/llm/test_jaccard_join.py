import random
import re

import numpy as np
import pytest

from newsquery.llm import jaccard_join as jj
from newsquery.llm.common import components, forest, shingle_sets


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(texts, n, percent):
    """Components over all pairs of exact shingle sets."""
    sets = {i: shingles(t, n) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = top(a), top(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), top(i)) for i in ids}


def corpus(seed):
    """Families of near copies around the threshold, passages that many texts share, exact copies, and short texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["The", "of", "and"]) if rng.random() < 0.3 else f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(60)]
    texts = [None, "", "  \n", "one", "One", "one two", "one two\tthree", "ONE TWO THREE", "é É", "é é"]
    for size in (12, 40, 150, 400):
        for _ in range(6):
            base = [word() for _ in range(size)]
            for copy in range(7):
                own = list(base)
                for _ in range(rng.randrange(0, max(2, size // 20))):
                    own[rng.randrange(len(own))] = word()
                if rng.random() < 0.3:
                    own = own[: -rng.randrange(1, max(2, size // 10))]
                texts.append(" ".join(own))
            texts.append(" ".join(base))
    for _ in range(40):
        own = [word() for _ in range(rng.choice([20, 100]))]
        texts.append(" ".join(own[:10] + passage + own[10:]))
    return {10 * i + 3: t for i, t in enumerate(texts)}


@pytest.mark.parametrize("n,percent,seed", [(3, 90, 1), (5, 80, 2)])
def test_components_against_brute_force(spark, n, percent, seed):
    texts = corpus(seed)
    rows = [(i, t, 7) for i, t in texts.items()]
    random.Random(0).shuffle(rows)
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, n int")
    got = jj.jaccard_components(docs, n, percent).collect()
    assert len(got) == len(rows) + 1
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(texts, n, percent)


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (4, "A b c d"), (None, None)], "doc_id long, text string")
    got = sorted(jj.jaccard_components(docs, 3, 90).collect(), key=str)
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in got if r["doc_id"]) == [(4, 2, 4), (5, 2, 4)]
    assert len(got) == 4
    assert jj.jaccard_components(docs.limit(0)).collect() == []


def test_shingle_sets_equal_plain_ones():
    texts = ["a b c d", "A  b\tc\nd", "a b", "b a", "", None, "x\x0by z", "a b c a b c"]
    hashed = shingle_sets(texts, 3)
    assert [len(s) for s in hashed] == [len(shingles(t, 3)) for t in texts]
    assert (hashed[0] == hashed[1]).all() and hashed[2][0] != hashed[3][0]


def test_linked_sets_share_a_signature():
    """For any classes of tokens, and sizes at which the levels change."""
    rng = np.random.default_rng(4)
    for trial in range(300):
        percent = (90, 80)[trial % 2]
        n = int(rng.integers(9, 600))
        base = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        drop = int(rng.integers(0, jj.missing(len(base), percent) + 1))
        other = np.unique(np.concatenate([rng.permutation(base)[drop:], rng.integers(0, 2**64, int(rng.integers(0, 1 + len(base) // 10)), dtype=np.uint64)]))
        if not jj.linked(base, other, percent) or len(base) == len(other) and (base == other).all():
            continue
        share = rng.random()
        kind = lambda t: np.where(t % np.uint64(1000) < np.uint64(1000 * share), 2 + (t >> np.uint64(20)) % np.uint64(2), 1).astype(np.int8)  # noqa: B023, E731
        found = []
        for tokens in (base, other):
            own = set()
            for lev in jj.levels(len(tokens), percent):
                part = jj._below(tokens, lev)
                rare, many = jj.signatures(part, kind(part), len(tokens), lev, percent)
                own |= set(rare.tolist()) | set(many.tolist())
            found.append(own)
        assert found[0] & found[1]
        sketches = [(t[: jj.sketch_size(len(t), percent)] >> np.uint64(32)).astype(np.uint32) for t in (base, other)]
        assert jj._may_link(sketches[0], len(base), sketches[1], len(other), percent)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 600)] + [(7, 7), (None, 8)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 600)}
    assert len(forest(4, np.array([0, 1, 2, 0]), np.array([1, 2, 0, 3]))) == 3


def test_block_links_against_sets():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**64, 6000, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base[:100])[: int(rng.integers(85, 101))], base[int(k) : int(k) + 5]])) for k in rng.integers(100, 5000, 60)]
    for right in (None, sets[25:]):
        left = sets if right is None else sets[:25]
        x, y = jj.block_links(left, right, 80)
        want = {(i, j) for i in range(len(left)) for j in range(len(right or left)) if (right or i < j) and jj.linked(left[i], (right or left)[j], 80)}
        assert set(zip(x.tolist(), y.tolist())) == want and want


def test_group_larger_than_a_block(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    texts = {}
    for i in range(400):
        own = list(base)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        texts[i] = " ".join(own + [f"y{rng.randrange(10**6)}"] * rng.randrange(1, 9))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jj.jaccard_components(docs, 3, 90).collect()} == brute(texts, 3, 90)
