import random

import pytest

from newsquery.llm.common import slices, tokenizer_path
from newsquery.llm.token_counts import split_safely, token_counts

ODD = ["", None, " ", "a", "  two  spaces\n\n\tand tabs ", "naïve façade — “quotes” 東京 🙂", "<s> special </s> <unk>", "▁x ▁y", "a b", "word " * 9000, "x" * 5000, "1 2 3 " * 4000 + "\n end"]


def test_slices():
    assert list(slices([], 5)) == []
    assert list(slices([0, 0], 5)) == [(0, 2)]
    assert list(slices([9, 1, 1, 9], 5)) == [(0, 1), (1, 3), (3, 4)]


def test_split_keeps_all_text():
    text = "alpha beta, gamma  delta epsilon " * 50
    parts = split_safely(text, 40)
    assert " ".join(parts) == text and len(parts) > 10


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_counts_equal_whole_texts(spark, name):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(["the ", "Öl ", "x1 ", ". ", "\n", " ", "éa", "abc "]) for _ in range(rng.randint(1, 3000))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "a b", "y"), (3, "a", "z")], "doc_id long, text string, n_tokens string")
    got = {r["doc_id"]: r for r in token_counts(docs, name, batch_bytes=500, part_chars=64).collect()}
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
        count = lambda t: len(model.encode(t))
    else:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(tokenizer_path(name))
        count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    assert len(got) == len(texts) + 1 and None in got
    for i, t in enumerate(texts):
        n = count(t or "")
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 4096), i


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []
