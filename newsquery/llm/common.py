"""What the corpus operators share: tables, written intermediates, word hashes and components."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_scratch: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the folder, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediates: spark.checkpoint.dir, or one folder of our own where it is unset and all runs in one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share: intermediates are written there")
    if not _own_scratch:
        _own_scratch.append(tempfile.mkdtemp(prefix="newsquery-"))
        atexit.register(shutil.rmtree, _own_scratch[0], ignore_errors=True)
    return f"file://{_own_scratch[0]}"


def materialise(df: DataFrame, name: str, made: list[DataFrame] | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there, so lost executors cost no recomputation.

    The frame joins the list ``made`` of those that the caller will ``discard``.
    """
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[path] = back
    if made is not None:
        made.append(back)
    return back


_written: dict[str, DataFrame] = {}


def discard(*frames: DataFrame) -> None:
    """Deletes the files of materialised frames that nothing reads any more."""
    for path in [p for p, df in _written.items() if any(df is x for x in frames)]:
        spark = _written.pop(path).sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


# --- bitmaps: sets of bounded size that tasks test against ------------------------------------


def buckets(column, bits: int):
    """The bit of a value: by its 64-bit hash."""
    return F.pmod(F.xxhash64(column), F.lit(1 << bits))


def bits_for(rows: int, per_row: int = 32, least: int = 20, most: int = 30) -> int:
    """Bits of a bitmap that so many rows leave mostly empty; 2^30 bits (128 MB) at most."""
    return min(most, max(least, (max(1, rows) * per_row - 1).bit_length()))


def bitmap(df: DataFrame, bucket, bits: int) -> np.ndarray:
    """The set of a frame's buckets as 2^bits bits: that is its size, whatever the frame's.

    Values may share a bit, so a test can only say "perhaps" or "no". Tasks gather the buckets of 2^15 bits each and
    send them packed, so the driver gets no more than the bitmap.
    """

    def pack(batches):
        for batch in batches:
            packed = []
            for low in batch.column(1).to_pylist():
                chunk = np.zeros(1 << 15, np.uint8)
                chunk[low] = 1
                packed.append(np.packbits(chunk, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["chunk", "packed"])

    out = np.zeros(max(1 << 12, 1 << (bits - 3)), np.uint8)
    parts = df.select(F.shiftright(bucket.cast("int"), 15).alias("chunk"), bucket.cast("int").bitwiseAND(F.lit((1 << 15) - 1)).alias("low")).groupBy("chunk").agg(F.collect_set("low").alias("low"))
    for r in parts.mapInArrow(pack, "chunk int, packed binary").collect():
        out[r["chunk"] << 12 : (r["chunk"] + 1) << 12] = np.frombuffer(r["packed"], np.uint8)
    return out


def in_bitmap(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def held_out(doc_id) -> F.Column:
    """True for the fifth of the documents that no model learns from (crc32 of the id as text)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def in_share(column, share) -> F.Column:
    """True for that share of the values, by their hash as a fraction: no share is too small to choose anything."""
    whole = 1 << 62
    return F.pmod(F.xxhash64(column), F.lit(whole)).cast("double") < F.lit(float(whole)) * share


def is_held_out(doc_id: int | None) -> bool | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % 5 == 0


# --- hashes of words and word n-grams over whole Arrow batches -------------------------------

_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * _U(pow(base, k, 1 << 64))
        k += m
    return out


def words_of(texts: Iterable[str | None], letters_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Hashes of all words of all texts, at once.

    A word is a run of bytes other than space and 0x09-0x0D, with A-Z made lower case; with ``letters_only``
    ASCII bytes other than letters and digits end words too. Returns the words' hashes, their first and last
    byte, the number of words before each text's end, and the bytes. Null texts count as empty.
    """
    encoded = [t.encode() if t else b"" for t in texts]
    ends = np.cumsum(np.fromiter((len(e) + 1 for e in encoded), np.int64, len(encoded)))
    data = b"\n".join(encoded) + b"\n"
    a = np.frombuffer(data, np.uint8)
    a = a + ((a >= 65) & (a <= 90)).astype(np.uint8) * np.uint8(32)
    if letters_only:
        inside = (a >= 128) | ((a >= 97) & (a <= 122)) | ((a >= 48) & (a <= 57))
    else:
        inside = ~((a == 32) | ((a >= 9) & (a <= 13)))
    before = np.concatenate(([False], inside[:-1]))
    first, last = np.flatnonzero(inside & ~before), np.flatnonzero(~inside & before)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + _U(1)) * _powers(len(a), _BASE), out=sums[1:])
    h = (sums[last] - sums[first]) * _powers(len(a), _INVERSE)[first]
    return mix(h ^ mix((last - first).astype(np.uint64))), first, last, np.searchsorted(first, ends), data


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words that start at each word (of one text or of several in a row)."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    h = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        h = mix(h * _U(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k] + _U(k + 1))
    return h


def shingle_sets(texts: Iterable[str | None], n: int) -> list[np.ndarray]:
    """Each text's distinct hashed n-word shingles in rising order; fewer words are one shingle, none an empty set."""
    words, _, _, ends, _ = words_of(texts)
    grams, out, start = ngram_hashes(words, n), [], 0
    for end in ends.tolist():
        if end - start >= n:
            out.append(np.unique(grams[start : end - n + 1]))
        else:
            out.append(ngram_hashes(words[start:end], end - start) if end > start else np.empty(0, np.uint64))
        start = end
    return out


def slices(lengths: Iterable[int], most: int) -> Iterable[tuple[int, int]]:
    """Cuts a row of lengths into runs of about ``most`` in sum, so that work is balanced by bytes and not by rows."""
    start = total = end = 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
        end = i + 1
    if end > start:
        yield start, end


# --- components -------------------------------------------------------------------------------


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100, made: list[DataFrame] | None = None) -> DataFrame:
    """(id, component): for each node of an edge, the smallest node that it reaches.

    Alternating large-star and small-star rounds. Every round is two aggregations and two equi-joins, its
    result is written, and nothing but counts reaches the driver. It ends when every node has one edge, to a node
    that has none of its own. Rounds grow with the logarithm of the longest path; RuntimeError after ``most_rounds``
    instead of an unfinished answer. Nulls in either end are no edge; loops and repeated edges are harmless. The
    result reads a written frame, which joins ``made``.
    """
    spark = edges.sparkSession
    now = materialise(
        edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).filter("u is not null and v is not null and u <> v").distinct(), "edges"
    )
    for _ in range(most_rounds):
        if _are_stars(now):
            if made is not None:
                made.append(now)
            stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
            return stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        before, now = now, materialise(small.filter("u <> v").distinct(), "stars")
        discard(before)
    raise RuntimeError(f"components are not united after {most_rounds} rounds")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every upper end of an edge has that edge alone and is no lower end."""
    return edges.groupBy("u").count().filter("count > 1").isEmpty() and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Of edges between 0..n-1, those of a spanning forest: the same components with fewer rows."""
    parent = list(range(n))
    kept = []
    for x, y in zip(left.tolist(), right.tolist()):
        p, q = x, y
        while parent[p] != p:
            parent[p] = p = parent[parent[p]]
        while parent[q] != q:
            parent[q] = q = parent[parent[q]]
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine; executors resolve it themselves."""
    import public_tokenizers

    return public_tokenizers.path(name)
