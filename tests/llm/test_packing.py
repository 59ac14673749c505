import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from newsquery.llm.common import tokenizer_path
from newsquery.llm import packing
from newsquery.llm.packing import best_fit, bin_completion, fillings, id_encoder, lower_bound, pack_documents, piece_bounds, slots


def optimum(items, capacity):
    """The least number of bins, by trying all subsets for the first item's bin."""
    if not items:
        return 0
    head, rest = items[0], items[1:]
    best = len(items)
    for k in range(len(rest) + 1):
        for chosen in combinations(range(len(rest)), k):
            if head + sum(rest[i] for i in chosen) <= capacity:
                best = min(best, 1 + optimum([x for i, x in enumerate(rest) if i not in chosen], capacity))
    return best


def test_bin_completion_against_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        items = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 8))), reverse=True)
        patterns, bound = bin_completion(Counter(items), 20)
        assert Counter(n for p, t in patterns for n in p * t) == Counter(items)
        assert all(sum(p) <= 20 for p, _ in patterns)
        n, least = sum(t for _, t in patterns), optimum(items, 20)
        assert bound <= least <= n <= sum(t for _, t in best_fit(Counter(items), 20))
        assert n == least, items


def all_fillings(room, counts):
    """Every filling that is not dominated, by the definition: no piece left out could take the place of some of its pieces."""
    items = [n for n, c in counts.items() for _ in range(min(c, room // n))]
    found = {tuple(sorted(x, reverse=True)) for k in range(len(items) + 1) for x in combinations(items, k) if sum(x) <= room}
    out = set()
    for f in found:
        waste, worse = room - sum(f), False
        for y in (n for n, c in counts.items() if c > f.count(n)):
            for k in range(len(f) + 1):
                worse |= any(max(0, y - waste) <= sum(x) < y or k > 1 and sum(x) == y for x in combinations(f, k))
        if not worse:
            out.add(f)
    return out


@pytest.mark.parametrize("tolerance", [0, 1, 3, 50])
def test_undominated_fillings_against_brute_force(tolerance):
    rng = random.Random(tolerance)
    for _ in range(60):
        counts, room = {n: rng.randint(1, 3) for n in rng.sample(range(1, 13), rng.randint(0, 4))}, rng.randint(0, 16)
        got = list(fillings(room, counts, tolerance))
        assert len(got) == len({g for g in got if g is not None}) + got.count(None)
        assert {g for g in got if g is not None} == all_fillings(room, counts), (room, counts)


def test_bin_completion_beats_best_fit():
    rng, fewer = random.Random(2), 0
    for _ in range(20):
        counts = Counter(rng.randint(20, 500) for _ in range(120))
        patterns, bound = bin_completion(counts, 1024)
        n, plain = sum(t for _, t in patterns), sum(t for _, t in best_fit(counts, 1024))
        assert bound <= n <= plain
        fewer += n < plain or plain == bound
    assert fewer == 20


def test_histogram_of_any_count():
    rng = random.Random(5)
    counts = {n: rng.randint(0, 10**9) for n in range(1, 1025)}
    patterns, bound = bin_completion(counts, 1024)
    got = Counter()
    for p, t in patterns:
        for n in p:
            got[n] += t
    assert got == Counter({n: c for n, c in counts.items() if c})
    assert sum(t for _, t in patterns) <= bound * 1.0001 + 1
    assert len(slots(patterns)) < 20000


def test_many_pieces_beside_the_longest():
    # 2 * 206 + 3 * 204 = 1024; best fit puts five of 204 together and wastes the rest
    patterns, bound = bin_completion(Counter({206: 2000, 204: 3000}), 1024)
    assert sum(t for _, t in patterns) == bound == 1000


@pytest.mark.parametrize("n,want", [(1, [(0, 1)]), (10, [(0, 10)]), (11, [(0, 1), (1, 10)]), (20, [(0, 10), (10, 10)]), (25, [(0, 5), (5, 10), (15, 10)])])
def test_piece_bounds(n, want):
    assert piece_bounds(n, 10) == want


@pytest.mark.parametrize("most_parts", [1, 100, 1 << 17])
def test_ids_equal_the_library(monkeypatch, most_parts):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "MOST_PARTS", most_parts)
    model = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(7)
    texts = ["", " ", "\n\n a  b ", "<|endoftext|> x<|endoftext|>", "it's we'll 'tis", "東京 is ２０", "a b c\x85d\x1c", "ñandú Привет 123abc", "x" * 3000, "🙂🙂 ok", "a \n", "  b", "x\n", "  y z", "a b\x1fc d", "trailing ", " leading", "two  spaces here", "plain words only here"]
    texts += ["".join(rng.choice(["the", " ", "  ", "\n", "é", "12", "'s", "...", "Ж", "\t", " a", "\xa0", "字"]) for _ in range(rng.randint(1, 400))) for _ in range(300)]
    encode = id_encoder.__wrapped__("byte_bpe_50k.json")
    for at in range(0, len(texts), 50):
        for text, ids in zip(texts[at : at + 50], encode(pa.array(texts[at : at + 50]))):
            assert ids.tolist() == model.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("char", [" ", "\n", "\t", "a", "é"])
def test_very_long_runs(char):
    from tokenizers import Tokenizer

    text = "word" + char * 3_000_000 + "word end"
    ids = id_encoder("byte_bpe_50k.json")(pa.array([text]))[0]
    assert ids.tolist() == Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids


def test_other_vocabularies_go_to_the_library():
    from tokenizers import Tokenizer

    texts = ["Some words, HERE and  there", "", "<|endoftext|> x"]
    model = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    assert [x.tolist() for x in id_encoder("word_bpe_49k.json")(pa.array(texts))] == [model.encode(t, add_special_tokens=False).ids for t in texts]


def test_pack_round_trip(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(11)
    texts = [None, "", "a"] + [" ".join(rng.choice(["one", "two", "drei", "quatre"]) for _ in range(rng.choice([3, 50, 900, 1023, 1024, 3000]))) for _ in range(60)] + ["same text here"] * 40
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    got = pack_documents(docs).toPandas()
    ids = {i: model.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    for i, own in got.groupby("doc_id"):
        own = own.sort_values("piece")
        assert [(s, n) for s, n in zip(own.start, own.length)] == piece_bounds(len(ids[i]), 1024)
        assert own.ids_crc32.tolist() == [zlib.crc32(np.array(ids[i][s : s + n], "<u4").tobytes()) for s, n in zip(own.start, own.length)]
    assert set(got.doc_id) == set(ids)
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()][:-1] and own.length.sum() <= 1024
    counts = defaultdict(int, Counter(got.length))
    assert got.sequence_id.nunique() == lower_bound(counts, 1024)


def test_pack_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
