"""N-gram Jaccard join by token-combination prefixes.

The tokens are hashed word shingles. Of each set only the tokens below a hash threshold are looked at, a part of the
universe chosen by the set's size; among them rare tokens go before frequent ones. A set's prefix is extended until
it outweighs all tokens that a partner may lack: a rare token counts one, and m tokens of a frequent class with
combinations of k count m - k + 1. Then two linked sets share a rare token or a k-combination of their prefixes:
at most ``missing`` tokens of the set whose prefix ends first are absent from the other one, which is fewer than it
takes to break all of its signatures. This holds for any order and any classes, if only all sets use the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, bits_for, buckets, components, discard, forest, in_bitmap, materialise, mix, shingle_sets

#: Tokens in more sets than these are of class 2 and 3, indexed by combinations of two and of three.
RARE, FREQUENT = 4, 64

@lru_cache(maxsize=65536)
def missing(n: int, percent: int) -> int:
    """The most tokens of a set of n that a linked set may lack."""
    return n - -(-percent * n // 100)


@lru_cache(maxsize=65536)
def level(n: int, percent: int) -> int:
    """The part 2^(-level/4) of the universe that sets of n tokens are indexed by: it leaves enough tokens nearly always."""
    wanted, out = 1.3 * (100 - percent) / 100 * n + 12, 0
    while out < 40 and (kept := n * 2 ** (-(out + 1) / 4)) - 3 * math.sqrt(kept) >= wanted:
        out += 1
    return out


def levels(n: int, percent: int) -> range:
    """The levels of all sizes that a linked set may have."""
    return range(level(-(-percent * n // 100), percent), level(100 * n // percent, percent) + 1)


@lru_cache(maxsize=256)
def parts(lev: int, percent: int) -> dict[int, int]:
    """Combinations are formed within so many parts of a class, by hash: about five tokens a part for pairs, seven for triples."""
    n = 1
    while level(n, percent) < lev:
        n += max(1, n // 50)
    need = missing(n, percent) + 1
    return {2: max(2, need // 4), 3: max(2, need // 5)}


def _below(tokens: np.ndarray, lev: int) -> np.ndarray:
    return tokens[: np.searchsorted(tokens, np.uint64(min(2**64 - 1, int(2 ** (64 - lev / 4)))), side="right")]


def sketch_size(n: int, percent: int) -> int:
    return missing(n, percent) + 1 + max(16, missing(n, percent) // 3)


def signatures(tokens: np.ndarray, classes: np.ndarray, n: int, lev: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The prefix's signatures: of rare tokens, and of combinations of frequent ones.

    Tokens that don't suffice to extend the prefix (they are too few by chance) are all signatures of the second
    sort: two linked sets that both fall short share one of them, and one that falls short is found by what the
    other has.
    """
    need = missing(n, percent) + 1
    salt = np.uint64(lev + 1)
    order = np.lexsort((tokens, classes))
    rare = tokens[order[: int((classes == 1).sum())]][:need]
    got, groups, out = len(rare), {}, [np.empty(0, np.uint64)]
    for i in order[len(rare) :].tolist():
        if got >= need:
            break
        k = int(classes[i])
        token = int(tokens[i])
        group = groups.setdefault((k, token % parts(lev, percent)[k]), [])
        if len(group) >= k - 1:
            got += 1
            sums = [sum(c) + token for c in combinations(group, k - 1)]
            out.append(mix(np.array([s & (2**64 - 1) for s in sums], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt + np.uint64(k << 32)))
        group.append(token)
    if got < need:
        out.append(mix(tokens + np.uint64(1 << 40) + salt))
    return mix(rare + salt), np.unique(np.concatenate(out))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exactly, for two rising arrays of distinct tokens."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _may_link(a: np.ndarray, n: int, b: np.ndarray, m: int, percent: int) -> bool:
    """False only if the sketches (the first 32 bits of each set's smallest hashes) prove that too many tokens differ."""
    if 100 * min(n, m) < percent * max(n, m):
        return False
    end = min(a[-1] if len(a) < n else 2**32, b[-1] if len(b) < m else 2**32)
    x, y = np.unique(a[a < end]), np.unique(b[b < end])
    both = len(np.intersect1d(x, y, assume_unique=True))
    return len(x) - both <= missing(n, percent) and len(y) - both <= missing(m, percent)


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def _sets(docs: DataFrame, n: int, rows: int = 256) -> DataFrame:
    """(id, n, s1, s2): size and 128-bit hash of each document's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                sets = shingle_sets(batch.column(1).to_pylist(), n)
                marks = [[np.add.reduce(mix(s + np.uint64(c))).view(np.int64) for s in sets] for c in (1, 2)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(m, pa.int64()) for m in marks)], ["id", "n", "s1", "s2"])

    return docs.mapInArrow(run, "id long, n long, s1 long, s2 long")


def _indexed(docs: DataFrame, n: int, percent: int, rows: int = 256) -> DataFrame:
    """(id, n, s1, s2, kept, sketch): also the tokens that sets are indexed by, and the smallest of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                sets = shingle_sets(batch.column(1).to_pylist(), n)
                marks = [[np.add.reduce(mix(s + np.uint64(c))).view(np.int64) for s in sets] for c in (1, 2)]
                kept = [_below(s, levels(len(s), percent)[0]).tobytes() for s in sets]
                sketch = [(s[: sketch_size(len(s), percent)] >> np.uint64(32)).astype(np.uint32).tobytes() for s in sets]
                arrays = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(m, pa.int64()) for m in marks), pa.array(kept, pa.binary()), pa.array(sketch, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "s1", "s2", "kept", "sketch"])

    return docs.mapInArrow(run, "id long, n long, s1 long, s2 long, kept binary, sketch binary")


def _tokens(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64))], ["token"])

    return classes.select("kept").mapInArrow(run, "token long")


def _signed(classes: DataFrame, percent: int, two: np.ndarray, three: np.ndarray, bits: int, only: np.ndarray | None = None) -> DataFrame:
    """(sig, many, id, n) of every class and signature; of those in the bitmap ``only``, if given. many: a combination."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_sig, out_many, out_at = [np.empty(0, np.uint64)], [np.empty(0, bool)], [np.empty(0, np.int64)]
            sizes = _column(batch, "n")
            for at, (n, kept) in enumerate(zip(sizes, _column(batch, "kept"))):
                tokens = np.frombuffer(kept, np.uint64)
                bucket = (mix(tokens) & np.uint64((1 << bits) - 1)).astype(np.int64)
                kinds = 1 + in_bitmap(two, bucket).astype(np.int8) + in_bitmap(three, bucket)
                for lev in levels(n, percent):
                    part = _below(tokens, lev)
                    rare, many = signatures(part, kinds[: len(part)], n, lev, percent)
                    sigs, sort = np.concatenate([rare, many]), np.repeat([False, True], [len(rare), len(many)])
                    if only is not None:
                        keep = in_bitmap(only, (mix(sigs) & np.uint64((1 << bits) - 1)).astype(np.int64))
                        sigs, sort = sigs[keep], sort[keep]
                    out_sig.append(sigs)
                    out_many.append(sort)
                    out_at.append(np.full(len(sigs), at))
            at = pa.array(np.concatenate(out_at))
            own = batch.select(["id", "n"]).take(at)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_sig).view(np.int64)), pa.array(np.concatenate(out_many)), own.column(0), own.column(1)], ["sig", "many", "id", "n"])

    return classes.select("id", "n", "kept").mapInArrow(run, "sig long, many boolean, id long, n long")


def _mixed(df: DataFrame, name: str, bits: int) -> DataFrame:
    """The bits of 64-bit values, as tasks compute them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array((mix(batch.column(0).to_numpy().view(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int32))], ["bucket"])

    return df.select(name).mapInArrow(run, "bucket int")


def _pruned(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those that the sketches don't rule out."""
    of = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_may_link(np.frombuffer(x, np.uint32), n, np.frombuffer(y, np.uint32), m, percent) for x, n, y, m in zip(*(_column(batch, c) for c in ("sa", "na", "sb", "nb")))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(run, "a long, b long")


def _whole_sets(docs: DataFrame, need: DataFrame, n: int) -> DataFrame:
    """``need`` (with a column id) joined to the whole shingle sets of its documents.

    Only documents that occur in it are shuffled: a bitmap of their ids, of fixed size, filters the scan.
    """
    bits = bits_for(need.count(), 8)
    wanted = bitmap(need, buckets("id", bits), bits)

    def sets(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = whole.filter(pa.array(in_bitmap(wanted, whole.column(2).to_numpy())))
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(batch.column(1).to_pylist(), n)], pa.binary())], ["id", "tokens"])

    return docs.filter("id is not null").withColumn("bucket", buckets("id", bits)).mapInArrow(sets, "id long, tokens binary").join(need, "id")


def _verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int, made: list[DataFrame], salts: int = 64) -> DataFrame:
    """Of the pairs (a, b) those whose whole sets are linked.

    Pairs are dealt by (a, salt of b), and a task holds one set of each a at a time, so no document has too many
    partners.
    """
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)))
    need = materialise(dealt.select(F.col("a").alias("id"), "a", "salt").distinct().unionByName(dealt.select(F.col("b").alias("id"), "a", "salt").distinct()), "partners", made)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, held = None, []
        for batch in batches:
            out = []
            for i, a, salt, tokens in zip(*(_column(batch, c) for c in ("id", "a", "salt", "tokens"))):
                tokens = np.frombuffer(tokens, np.uint64)
                if (a, salt) != hub:
                    hub, held = (a, salt), []
                if i == a:
                    held.append(tokens)
                elif any(linked(tokens, x, percent) for x in held):
                    out.append((a, i))
            columns = list(zip(*out)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    rows = _whole_sets(docs, need, n).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("id") != F.col("a"))
    return rows.select("id", "a", "salt", "tokens").mapInArrow(verify, "a long, b long").distinct()


def block_links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs of two rows of sets (``right`` None: of one), by products of their membership matrices."""
    both = left if right is None else left + right
    sizes = np.array([len(s) for s in both], np.int64)
    tokens, at = np.unique(np.concatenate(both), return_inverse=True)
    common = np.zeros((len(left), len(both) if right is None else len(right)), np.float32)
    owner = np.repeat(np.arange(len(both)), sizes)
    for start in range(0, len(tokens), 4096):  # so many tokens at a time: the matrices' size is bounded
        inside = (at >= start) & (at < start + 4096)
        m = np.zeros((len(both), min(4096, len(tokens) - start)), np.float32)
        m[owner[inside], at[inside] - start] = 1
        common += m[: len(left)] @ (m if right is None else m[len(left) :]).T
    a, b = sizes[: len(left)], sizes if right is None else sizes[len(left) :]
    both_sides = np.rint(common).astype(np.int64)
    near = 100 * both_sides >= percent * (a[:, None] + b[None, :] - both_sides)
    if right is None:
        near &= np.arange(len(left))[:, None] < np.arange(len(left))[None, :]
    return np.nonzero(near)


def _compared(groups: DataFrame, docs: DataFrame, n: int, percent: int, made: list[DataFrame], block: int = 256) -> DataFrame:
    """(a, b): of the links within each group (id, comp, n) a set with the same components.

    Groups of up to ``block`` documents are compared whole. A larger group is cut by size (linked sets differ by one
    step at most) and by hash into blocks, and pairs of blocks are compared: a task holds two blocks at a time, and
    returns a spanning forest of their links.
    """
    step = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent))
    total = groups.groupBy("comp").agg(F.count("*").alias("total"))
    rows = groups.join(total, "comp").withColumn("step", F.when(F.col("total") > block, step).otherwise(F.lit(0)).cast("int"))
    cells = rows.groupBy("comp", "step").agg(F.ceil(F.count("*") / block).cast("int").alias("cut"))
    rows = rows.join(cells, ["comp", "step"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("cut")).cast("int"))
    rows = materialise(rows.select("id", "comp", "step", "cut", "own"), "cells", made)
    other = rows.select("comp", "step", F.col("cut").alias("cuts")).distinct()
    unit = lambda s, t, i, j: F.struct("comp", s.cast("int").alias("s"), t.cast("int").alias("t"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    every = lambda first, last: F.explode(F.sequence(first, last))
    zero = F.lit(0)
    col = F.col
    mine = rows.select("id", "comp", "step", "own", every(col("own"), col("cut") - 1).alias("j")).select("id", zero.alias("side"), unit(col("step"), col("step"), col("own"), col("j")).alias("unit"))
    theirs = rows.filter("own > 0").select("id", "comp", "step", "own", every(zero, col("own") - 1).alias("i")).select("id", F.lit(1).alias("side"), unit(col("step"), col("step"), col("i"), col("own")).alias("unit"))
    up = rows.join(other.withColumn("step", col("step") - 1), ["comp", "step"]).select("id", "comp", "step", "own", every(zero, col("cuts") - 1).alias("j")).select("id", zero.alias("side"), unit(col("step"), col("step") + 1, col("own"), col("j")).alias("unit"))
    down = rows.join(other.withColumn("step", col("step") + 1), ["comp", "step"]).select("id", "comp", "step", "own", every(zero, col("cuts") - 1).alias("i")).select("id", F.lit(1).alias("side"), unit(col("step") - 1, col("step"), col("i"), col("own")).alias("unit"))
    need = materialise(mine.unionByName(theirs).unionByName(up).unionByName(down).select("id", "side", "unit.*"), "units", made)
    names = ["comp", "s", "t", "i", "j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        sides: tuple[dict, dict] = ({}, {})

        def done() -> list[tuple[int, int]]:
            left, right = sides
            if held is None or len(left) + len(right) < 2 or not left:
                return []
            if held[1] == held[2] and held[3] == held[4]:
                ids = list(left)
                return [(ids[x], ids[y]) for x, y in forest(len(ids), *block_links(list(left.values()), None, percent))]
            if not right:
                return []
            ids = [*left, *right]
            x, y = block_links(list(left.values()), list(right.values()), percent)
            return [(ids[p], ids[q]) for p, q in forest(len(ids), x, y + len(left))]

        def arrow(found: list) -> pa.RecordBatch:
            columns = list(zip(*found)) or [(), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

        for batch in batches:
            out = []
            for i, side, tokens, *key in zip(*(_column(batch, c) for c in ("id", "side", "tokens", *names))):
                if tuple(key) != held:
                    out += done()
                    held, sides = tuple(key), ({}, {})
                sides[side][i] = np.frombuffer(tokens, np.uint64)
            yield arrow(out)
        yield arrow(done())

    found = _whole_sets(docs, need, n).repartition(*names).sortWithinPartitions(*names)
    return found.select("id", "side", "tokens", *names).mapInArrow(compare, "a long, b long")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every whole text: the groups that links make.

    Two texts are linked if 100 * |common n-word shingles| >= percent * |all|. Words are runs of bytes other than
    space and 0x09-0x0D, A-Z in lower case; a text of fewer than n words is one shingle. Exact but for collisions
    of 64-bit hashes. Equal sets are one class from the start. Sets that share a rare token are compared pair by pair,
    those that combinations of frequent tokens tie together group by group, in blocks.

    Null and empty texts: no shingles, linked with nothing. Null ids take part in no link and get their class's
    component, or null. Rows that repeat an id are one document. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    made: list[DataFrame] = []  # frames to delete once links are known
    lasting: list[DataFrame] = []  # and once components are
    small = materialise(_sets(rows, n), "sets", lasting)
    reps = small.filter("n > 0 and id is not null").groupBy("s1", "s2", "n").agg(F.min("id").alias("rep"))
    whole = _indexed(rows.filter("id is not null"), n, percent).filter("n > 0")
    classes = materialise(whole.groupBy("s1", "s2", "n").agg(F.min("id").alias("id"), F.first("kept").alias("kept"), F.first("sketch").alias("sketch")).drop("s1", "s2"), "classes", made)
    frequent = materialise(_tokens(classes).groupBy("token").agg(F.count("*").alias("df")).filter(F.col("df") > RARE), "frequent", made)
    # a frequent token takes a bit; rare ones that share it only change sides
    bits = bits_for(frequent.count(), 16)
    two = bitmap(_mixed(frequent, "token", bits), F.col("bucket"), bits)
    three = bitmap(_mixed(frequent.filter(F.col("df") > FREQUENT), "token", bits), F.col("bucket"), bits)

    signed = _signed(classes, percent, two, three, bits)
    shared = materialise(signed.groupBy("sig", "many").agg(F.count("*").alias("k"), F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b"), "shared", made)
    more = shared.filter("k > 2").select("sig", "many", "a")
    again = _signed(classes, percent, two, three, bits, only=bitmap(_mixed(more, "sig", bits), F.col("bucket"), bits))
    several = materialise(again.join(more, ["sig", "many"]), "several", made)
    # a rare token stands in few sets: their pairs are taken one by one
    few = several.filter("not many")
    x, y = few.select("sig", F.col("id").alias("x"), F.col("n").alias("nx")), few.select("sig", F.col("id").alias("y"), F.col("n").alias("ny"))
    fits = F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent
    pairs = x.join(y, "sig").filter((F.col("x") < F.col("y")) & fits).select(F.col("x").alias("a"), F.col("y").alias("b"))
    pairs = shared.filter("k = 2 and not many").select("a", "b").unionByName(pairs).distinct()
    links = materialise(_verified(_pruned(pairs, classes, percent), rows, n, percent, made), "links", lasting)
    # combinations tie together groups of any size: these are compared in blocks, not pair by pair
    ties = shared.filter("many").select("a", "b").unionByName(several.filter("many and a < id").select("a", F.col("id").alias("b"))).distinct()
    groups = components(ties, made=made).withColumnRenamed("component", "comp").join(classes.select("id", "n"), "id").dropDuplicates(["id"])
    dense = materialise(_compared(groups, rows, n, percent, made), "links", lasting)

    discard(*made)
    found = components(links.unionByName(dense), made=lasting).withColumnRenamed("id", "rep")
    labels = reps.join(found, "rep", "left").select("s1", "s2", "n", F.coalesce("component", "rep").alias("component"))
    # empty sets, which all are equal, have no part in the join
    out = small.filter("n > 0").join(labels, ["s1", "s2", "n"], "left").unionByName(small.filter("n = 0").withColumn("component", F.lit(None).cast("long")))
    out = materialise(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")), "groups")
    discard(*lasting)
    return out
