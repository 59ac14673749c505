"""Token counts: texts are encoded in Arrow batches that return lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tokenizer_path

#: A space that may be cut away: no piece holds a space after another character, and the piece model puts one
#: in front of every text it is given, so what stands on the two sides is encoded alike together and apart.
_SAFE = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


def split_safely(text: str, most: int) -> list[str]:
    """Parts of about ``most`` characters, cut at safe spaces only; a text without such a space stays whole."""
    parts, start = [], 0
    while len(text) - start > most:
        cut = _SAFE.search(text, start + most)
        if not cut:
            break
        parts.append(text[start : cut.start()])
        start = cut.end()
    return [*parts, text[start:]]


@lru_cache(maxsize=4)
def _encoder(name: str):
    """(function from texts to token counts, whether texts may be split) of the vocabulary file ``name``."""
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
        inner = any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))
        alone = model.encode("a") == model.encode("x a")[-1:]  # a space is put in front of a text
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], alone and not inner
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path(name))
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)], False


def token_counts(
    docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, batch_bytes: int = 1 << 20, part_chars: int = 1 << 15
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text.

    One narrow stage: no shuffle, and texts never leave the executor. Each Arrow batch is regrouped by bytes
    into calls of about ``batch_bytes``; texts over ``part_chars`` are split at spaces between ASCII letters or
    digits, where the vocabulary allows it. A text without such spaces, or for another vocabulary, is one call.

    Null and empty texts: 0 bytes, 0 tokens, not over the limit. A null id is kept as null. Repeated rows give
    repeated rows. Other columns, whatever their names, are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encode, may_split = _encoder(vocabulary)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            sizes = pc.binary_length(texts).cast(pa.int64())
            totals = [0] * len(texts)
            parts: list[str] = []
            owner: list[int] = []
            for i, text in enumerate(texts):
                own = split_safely(text.as_py(), part_chars) if may_split else [text.as_py()]
                parts += own
                owner += [i] * len(own)
            for a, b in slices(map(len, parts), batch_bytes):
                for i, n in zip(owner[a:b], encode(parts[a:b])):
                    totals[i] += n
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(totals, pa.int64()), pa.array([n > limit for n in totals])], ["id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
