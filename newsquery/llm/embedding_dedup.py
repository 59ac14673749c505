"""Embedding near-duplicates by sorted projection passes.

A pass gives each vector the signs of its products with random directions, concatenated to a key, and orders all
vectors by (label, key): close vectors mostly share a long beginning of the key and come to stand near each other.
Each is compared with its neighbours in a bounded window, and verified pairs are united over the passes. Groups
larger than a window are completed exactly: the members of each united group are compared in blocks, so that every
link within it is counted. What can be missed is only a link between vectors that no chain of verified pairs
connects. How long a beginning must be to come down to a window is measured from the keys, for each vector in each
pass; a vector whose links may still be missed with more than a stated probability goes through further passes, or is
compared with all such vectors of its label where that is cheaper, as in dense labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, discard, forest, materialise

#: Rows of a window block: each block is compared with itself and the next one.
BLOCK = 256
#: Blocks that go to a task as one tile; the block behind them goes with them.
TILE = 8
#: Passes that are sorted and compared at once: their copies of the vectors are what is shuffled at a time.
AT_ONCE = 4
#: The probability that a link between vectors no chain connects may be missed with.
MISS = 1e-4


def _agreeing(cosine: float) -> float:
    """The chance that a random direction gives two vectors at this cosine the same sign."""
    return 1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi


def passes_needed(n: int, least_cosine: float, block: int = BLOCK, miss: float = MISS) -> int:
    """Passes to begin with: a pair at the least cosine of n scattered vectors has then stood in one window with probability 1 - ``miss``.

    n scattered vectors need log2(n / block) leading signs to come down to a block, and as many as a block holds
    need one pass. Others need more; ``_unsettled`` measures which.
    """
    if n <= block:
        return 1
    near = _agreeing(least_cosine) ** max(1.0, math.log2(n / block))
    return max(3, math.ceil(math.log(miss) / math.log(max(1e-12, 1 - near * 0.9))))


def _passes(n: Column, least_cosine: float, block: int) -> Column:
    """``passes_needed`` of a column."""
    near = F.pow(F.lit(_agreeing(least_cosine)), F.greatest(F.lit(1.0), F.log2(n / block)))
    return F.when(n <= block, 1).otherwise(F.greatest(F.lit(3), F.ceil(math.log(MISS) / F.log(F.greatest(F.lit(1e-12), 1 - near * 0.9))).cast("int")))


def _unit_rows(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of length 1 in double precision; the largest magnitude is divided out first, so that no square vanishes or overflows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, dim, v, h1, h2) of what can be compared at all, in the vectors' own precision if that is float."""
    v = F.col(vector_col)
    own = vectors.schema[vector_col].dataType.elementType.simpleString()
    rows = vectors.filter(v.isNotNull() & F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (F.size(v) > 0))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.size(v).alias("dim"), v.cast("array<float>" if own == "float" else "array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(fine).select("*", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2"))


def _keys(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """(id, label, dim, keys): 63 concatenated signs for each of the row's passes, the first most significant."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = np.int64(1) << np.arange(62, -1, -1, dtype=np.int64)
        for batch in batches:
            dims, passes = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            keys: list = [None] * len(dims)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                if dim not in planes:
                    planes[dim] = np.random.default_rng(seed + dim).standard_normal((dim, most * 63))
                signs = (_unit_rows(batch.column(3).take(pa.array(at)), dim) @ planes[dim] > 0).reshape(len(at), most, 63)
                for i, k in zip(at.tolist(), (signs * weights).sum(axis=2)):
                    keys[i] = k[: passes[i]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(keys, pa.list_(pa.int64()))], ["id", "label", "dim", "keys"])

    return rows.select("id", "label", "dim", "v", "passes").mapInArrow(run, "id long, label string, dim int, keys array<long>")


def _ranked(keys: DataFrame, first: int) -> DataFrame:
    """(id, pass, key, rank): the place of each vector in the order of (label, pass, key), for the passes from ``first`` on that go at once.

    Range partitions are sorted apart and numbered inside; the driver gets one row count for each partition.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n, dtype=np.int64))], ["id", "pass", "key", "part", "at"])
            at += n

    order = ["label", "dim", "pass", "key", "id"]
    each = keys.select("id", "label", "dim", F.posexplode(F.slice("keys", first + 1, AT_ONCE)).alias("pass", "key"))
    placed = materialise(each.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "pass", "key").mapInArrow(number, "id long, pass int, key long, part int, at long"), "order")
    starts, total = [], 0
    for part, n in sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()):
        starts.append((part, total))
        total += n
    # one row for each partition of the sort
    start = placed.sparkSession.createDataFrame(starts, "part int, start long")
    return placed.join(F.broadcast(start), "part").select("id", "pass", "key", (F.col("start") + F.col("at")).alias("rank"))


def _common_bits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of the 63 leading bits are equal."""
    differ = x ^ y
    high = differ >> 32  # in halves, which doubles hold exactly
    return 63 - np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], np.frexp((differ & 0xFFFFFFFF).astype(np.float64))[1])


def _spanning(near: np.ndarray, main: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect what the pairs of ``near`` connect, at most one for each column; its rows are the first ``main`` columns."""
    n = near.shape[1]
    x, y = np.nonzero(near)
    x, y = x[x != y], y[x != y]
    if len(x) <= 4 * n:
        kept = np.array(forest(n, x, y), np.int64).reshape(-1, 2)
        return kept[:, 0], kept[:, 1]
    root = np.arange(n)
    while True:  # the least number that reaches each, by whole rows and columns
        left = np.minimum(root[:main], np.where(near, root, n).min(axis=1))
        after = np.minimum(root, np.where(near, left[:, None], n).min(axis=0))
        after[:main] = np.minimum(after[:main], left)
        after = after[after]
        if (after == root).all():
            at = np.flatnonzero(root != np.arange(n))
            return at, root[at]
        root = after


def _needs(keys: np.ndarray, block: int) -> np.ndarray:
    """For each of some sorted keys the least number of leading bits that no more than ``block`` of them, itself among them, share.

    All between two keys a block apart share what these two share. 0: there are no more than ``block`` keys around.
    """
    apart = np.zeros(max(0, len(keys) - block) + 2 * block, np.int64)
    apart[block : len(apart) - block] = _common_bits(keys[:-block], keys[block:]) + 1
    return np.lib.stride_tricks.sliding_window_view(apart, block + 1).max(axis=1)[: len(keys)] if len(keys) > block else np.zeros(len(keys), np.int64)


def _windows(rows: DataFrame, ranked: DataFrame, least: float, block: int) -> DataFrame:
    """(a, b, need): pairs that connect what the verified pairs of each block with itself and the next connect, need -1.

    And for each vector and pass rows (id, pass, need): see ``_needs``. Vectors that agree on so many signs stand in
    one window. It is the largest over the vector's rows, as those around a tile's edge are known in two tiles.
    """
    tile = TILE * block

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank").combine_chunks()
        rank, ids, passes, keys, dims = (table.column(c).to_numpy() for c in ("rank", "id", "pass", "key", "dim"))
        labels = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        main = int((table.column("main").to_numpy() == 1).sum())  # the block behind them has the highest ranks
        parts = np.flatnonzero((np.diff(labels) != 0) | (np.diff(dims) != 0) | (np.diff(passes) != 0)) + 1
        a, b, need = [], [], []
        for lo, hi in zip([0, *parts.tolist()], [*parts.tolist(), len(ids)]):
            a.append(ids[lo:hi])
            b.append(passes[lo:hi].astype(np.int64))
            need.append(_needs(keys[lo:hi], block))
            v = _unit_rows(table.column("v").slice(lo, hi - lo), int(dims[lo]))
            x, y = [], []
            edges = np.unique(np.append(np.arange(rank[0], rank[-1] + 1, block) - rank[0], [lo]))
            for at in edges[(edges >= lo) & (edges < min(hi, main))].tolist():
                # `at` begins a block of the tile, or the part within one
                end = min(hi, main, (at // block + 1) * block)
                near = v[at - lo : end - lo] @ v[at - lo : min(hi, (at // block + 2) * block) - lo].T >= least
                i, j = _spanning(near, end - at)
                x.append(i + at)
                y.append(j + at)
            if x:
                for i, j in forest(len(ids), np.concatenate(x), np.concatenate(y)):
                    a.append(ids[[i]])
                    b.append(ids[[j]])
                    need.append(np.array([-1]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b), "need": np.concatenate(need).astype(np.int64)})

    own, offset = F.struct(F.floor(F.col("rank") / tile).alias("g"), F.lit(1).alias("main")), F.pmod("rank", F.lit(tile))
    behind = F.struct((F.floor(F.col("rank") / tile) - 1).alias("g"), F.lit(0).alias("main"))
    both = ranked.withColumn("w", F.explode(F.when(offset < block, F.array(own, behind)).otherwise(F.array(own))))
    units = rows.select("id", "label", "dim", "v").join(both.select("id", "pass", "key", "rank", "w.g", "w.main").filter("g >= 0"), "id")
    return units.groupBy("g").applyInArrow(compare, "a long, b long, need long")


def _unsettled(needs: DataFrame, least: float, miss: float) -> DataFrame:
    """(id, left): vectors with a link that all passes so far miss with more than ``miss``, and about how many passes that still takes.

    ``needs``: (id, pass, need). A pair agrees on so many signs, and stands in one window, with at least the chance
    of a pair at the least cosine. Needs of 64 are longer than a key: such a pass says nothing about the vector.
    """
    each = needs.groupBy("id", "pass").agg(F.max("need").alias("need"))
    gain = F.when(F.col("need") == 0, 1e9).when(F.col("need") > 63, 0.0).otherwise(-F.log1p(-F.least(F.pow(F.lit(_agreeing(least)), F.col("need")), F.lit(1 - 1e-12))))
    sums = each.groupBy("id").agg(F.sum(gain).alias("sure"), F.count("*").alias("passes"))
    wanted = -math.log(miss)
    return sums.filter(F.col("sure") < wanted).select("id", F.when(F.col("sure") > 0, (wanted - F.col("sure")) * F.col("passes") / F.col("sure")).otherwise(F.lit(float("inf"))).alias("left"))


def _paired(rows: DataFrame, keys: list[str], block: int) -> DataFrame:
    """``rows`` with (mine, i, j): cut by hash into blocks within each value of ``keys``, once for every pair (i, j) of blocks that has theirs."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("rows"))
    cut = rows.join(sizes, keys).withColumn("parts", F.ceil(F.col("rows") / block)).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("parts")))
    return cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).drop("other")


def _compared(rows: DataFrame, least: float, block: int = 2048) -> DataFrame:
    """(a, b) of pairs that connect all verified pairs of ``rows`` (id, label, dim, v): every pair of blocks of a label is a unit."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("mine", "ascending"), ("id", "ascending")]).combine_chunks()
        ids, mine, i = table.column("id").to_numpy(), table.column("mine").to_numpy(), table.column("i")[0].as_py()
        v, main = _unit_rows(table.column("v"), table.column("dim")[0].as_py()), int((mine == i).sum())
        near = [v[at : min(at + BLOCK, main)] @ v.T >= least for at in range(0, main, BLOCK)]
        found = [np.nonzero(x) for x in near]
        x, y = np.concatenate([p + k * BLOCK for k, (p, _) in enumerate(found)] or [[]]), np.concatenate([q for _, q in found] or [[]])
        if len(x) <= 8 * len(ids):
            kept = np.array(forest(len(ids), x.astype(np.int64), y.astype(np.int64)), np.int64).reshape(-1, 2).T
        else:
            kept = _spanning(np.concatenate(near), main)
        return pa.table({"a": ids[kept[0]], "b": ids[kept[1]]})

    return _paired(rows, ["label", "dim"], block).select("id", "label", "dim", "v", "mine", "i", "j").groupBy("label", "dim", "i", "j").applyInArrow(compare, "a long, b long")


def _links(classes: DataFrame, least: float, passes: int | None, block: int, seed: int, miss: float = MISS) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b) of verified pairs that connect whatever links connect, but for a chance of ``miss`` a link; and the files it is read from.

    The first round takes as many passes over each label as its size needs. While some vectors are unsettled, a round
    takes further passes over these alone, or compares them in full with each other if that is fewer products than
    the passes they still need.
    """
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).select("label", "dim", (F.lit(passes) if passes else _passes(F.col("n"), least, block)).alias("passes"))
    rows, made, edges, needs, at = classes.join(sizes, ["label", "dim"]), [], None, None, 0
    most = sizes.agg(F.max("passes")).first()[0] or 1
    while True:
        keys = materialise(_keys(rows, most, seed + 1_000_003 * at), "keys")
        for first in range(0, most, AT_ONCE):
            found = materialise(_windows(rows, _ranked(keys, first), least, block), "pairs")
            made.append(found)
            own, need = found.filter("need < 0").select("a", "b"), found.filter("need >= 0").select(F.col("a").alias("id"), (F.col("b") + at + first).alias("pass"), "need")
            edges, needs = (own, need) if edges is None else (edges.unionByName(own), needs.unionByName(need))
        discard(keys)
        at += most
        rows = materialise(classes.join(_unsettled(needs.join(rows.select("id"), "id", "left_semi"), least, miss), "id"), "unsettled")
        made.append(rows)
        # one row: sums over the labels
        cost = rows.groupBy("label", "dim").agg(F.count("*").alias("n"), F.max("left").alias("left")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n") / 2).alias("full"), F.max("left").alias("left")).first()
        if not cost["n"]:
            return edges, made
        if cost["full"] <= cost["left"] * cost["n"] * 1.5 * block:
            made.append(materialise(_compared(rows.select("id", "label", "dim", "v"), least), "pairs"))
            return edges.unionByName(made[-1]), made
        most = min(8, math.ceil(cost["left"]))
        rows = rows.drop("left").withColumn("passes", F.lit(most))


def _counted(members: DataFrame, least: float, block: int = 512) -> DataFrame:
    """(id, links): how many vectors of its group each is linked to, by comparing all of the group in blocks.

    ``members``: (id, comp, dim, v, copies). A group of up to ``block`` rows is one unit, and about ``block`` rows of
    small groups go to a worker at once; a larger one is cut into blocks by hash and every pair of blocks is a unit
    of its own. Units return sums, not pairs.
    """
    spread = max(1, members.count() // block)

    def count(table: pa.Table) -> pa.Table:
        table = table.sort_by([("comp", "ascending"), ("mine", "ascending")]).combine_chunks()
        comp, ids, mine, copies = (table.column(c).to_numpy() for c in ("comp", "id", "mine", "copies"))
        i, j, dims = (table.column(c).to_numpy() for c in ("i", "j", "dim"))
        edges = [0, *(np.flatnonzero(np.diff(comp)) + 1).tolist(), len(ids)]
        out_ids, out_links = [], []
        for lo, hi in zip(edges, edges[1:]):
            v, c = _unit_rows(table.column("v").slice(lo, hi - lo), int(dims[lo])), copies[lo:hi]
            if i[lo] == j[lo]:
                near = v @ v.T >= least
                np.fill_diagonal(near, False)
                links = near @ c
            else:
                main = int((mine[lo:hi] == i[lo]).sum())
                near = v[:main] @ v[main:].T >= least
                links = np.append(near @ c[main:], near.T @ c[:main])
            out_ids.append(ids[lo:hi])
            out_links.append(links.astype(np.int64))
        return pa.table({"id": np.concatenate(out_ids), "links": np.concatenate(out_links)})

    # the blocks of a large group are apart already; whole small groups share a unit
    large = F.col("parts") > 1
    units = _paired(members, ["comp"], block).withColumn("unit", F.when(large, F.xxhash64("comp", "i", "j")).otherwise(F.pmod(F.xxhash64("comp"), F.lit(spread))))
    return units.select("id", "comp", "dim", "v", "copies", "mine", "i", "j", "unit", large.alias("large")).groupBy("unit", "large").applyInArrow(count, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, least_cosine: float = 0.98, passes: int | None = None, block: int = BLOCK, seed: int = 17, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) of every vector.

    Linked are two vectors of equal, non-null labels and equal length whose cosine in double precision is at least
    ``least_cosine``. Equal vectors are one class from the start, so that copies cost nothing. ``passes``: to
    begin with, by default as many as ``passes_needed`` says for the number of classes of each label.

    Vectors that are null, empty, zero or hold nulls or non-finite numbers, and those with a null label, link with
    nothing: n_links 0, a component of their own. Null ids: n_links 0, component null, kept null. Rows that repeat
    an id count as one vector, the one whose (label, length, hash) is the smallest if they differ, and are all returned.
    """
    usable, key = _usable(vectors, id_col, vector_col, label_col), ["label", "dim", "h1", "h2"]
    own = materialise(usable.groupBy("id").agg(F.min(F.struct(*key)).alias("k")).select("id", "k.*"), "own")
    reps = materialise(own.groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "reps")
    classes = materialise(usable.join(reps.withColumnRenamed("rep", "id"), ["id", *key]).dropDuplicates(["id"]).select("id", "label", "dim", "v", "copies"), "classes")
    edges, made = _links(classes.drop("copies"), least_cosine, passes, block, seed)
    groups = materialise(components(edges, made=made).withColumnRenamed("component", "comp"), "groups")
    discard(*made)
    links = materialise(_counted(classes.join(groups, "id").select("id", "comp", "dim", "v", "copies"), least_cosine), "links")
    known = own.join(reps, key).select("id", "rep", "copies").join(groups.withColumnRenamed("id", "rep"), "rep", "left").join(links.withColumnRenamed("id", "rep"), "rep", "left")
    known = materialise(known.select(F.col("id").alias("__id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("comp", "rep").alias("component_id")), "known")
    discard(own, reps, classes, groups, links)
    out = vectors.select(F.col(id_col).cast("long").alias("__own")).join(known, F.col("__own") == F.col("__id"), "left")
    component = F.coalesce("component_id", "__own")
    return out.select(F.col("__own").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("__own") == component).alias("kept"))
