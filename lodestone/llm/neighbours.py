"""The k most similar other vectors of every vector: a forest of sorted hash strings.

Each tree gives every vector a string of 128 bits: 64 signs of random projections, then 16
bits each of the parity of projections cut into steps of four widths, ever finer, which tell
near-copies apart whose signs are all the same. A tree is the sorted array of its strings, cut
into ranges over the cluster; each range also holds ``HALO`` places of both ranges beside it.

1. Descent: in each tree the longest prefix that a vector shares with others is that with its
   neighbours in the array; the number of places that share each shorter prefix follows from
   the prefixes that places next to each other share.
2. Ascent: all trees go up from the longest prefix together, bit by bit, until the places that
   share a prefix of that length with the vector number ``BUDGET`` x log2 n over all trees.
3. Cosines of these candidates are taken exactly and the best of all trees merged by vector.

The length reached tells the chance of having missed a neighbour as near as the k-th found: one
at a cosine shares a prefix of a length with a known chance in each tree. Where that chance is
above ``MISS``, as for vectors without near neighbours and those of which a tree could not give
all places of the prefix, as more than ``HALO`` lie on one side, more trees follow, ``MORE`` at a
time, until it is at ``SURE``. They are cut into leaves of about ``LEAF`` places instead of
sorted. Vectors that would need so many trees that it costs as much, and the last few, are
compared with all others, in blocks. That part grows with their number times that of all
vectors. Neighbours below a cosine that the caller doesn't ask for keep no vector open.

Equal vectors are one class with its smallest id as representative; only classes enter the
trees and each brings its k + 1 smallest ids, so that any number of copies stays cheap and
ties go to the smaller ids. Ranges are cut by (tree, string, salted id): near-copies with one
string can't make a range large, and each tree has another order among them.

Records without data, of another length than their dim or than the wanted one, without a
range, or all zero are unusable. Only the latest record of a key counts; of several at the
same time the largest. Fewer than two usable vectors give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import cut, drop, ship

DIM = 96
K = 5
TREES = 12
BUDGET = 600
HALO = 1024
MISS = 0.02
#: Chance of loss at which a vector that was given further trees is settled.
SURE = 0.005
BLOCK = 256
SIDE = 8_192
SIDES = 16
MOST_SIDE = 65_536
RANGE_ROWS = 32_768
SEED = 20_251
BITS = 64
MORE = 8
LEAF = 2_048
#: Places in leaves are about so many times as dear as those in blocks; fewer vectors than these are not worth the shuffle.
LEAF_PRICE = 3
LEAST_ASKED = 16_384
WIDTHS = (0.5, 0.125, 0.03, 0.008)
FINE = BITS // len(WIDTHS)
#: More than single precision and rounding to six decimals take from a cosine.
MARGIN = 4e-6

NEAR = "near array<struct<minus:double,other:bigint>>"


def planes(dim: int, trees: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Projections of the signs, those of the fine bits divided by their widths, and shifts of the latter."""
    pick = np.random.default_rng(SEED)
    signs, fine = (pick.standard_normal((dim, trees * BITS)).astype(np.float32) for _ in range(2))
    width = np.tile(np.repeat(np.array(WIDTHS, np.float32), FINE), trees)
    return signs, fine / width, pick.random(trees * BITS).astype(np.float32)


def usable_vectors(records: DataFrame, keys: DataFrame, dim: int = DIM) -> DataFrame:
    """(unit_id, v_min, v_max, data binary) of the latest usable record of each key in ``keys``."""
    last = records.select("unit_id", F.struct("written_at", "dim", "v_min", "v_max", "data").alias("r")).groupBy("unit_id").agg(F.max("r").alias("r")).select("unit_id", "r.*")
    fit = last.where((F.col("dim") == dim) & (F.size("data") == dim) & F.col("v_min").isNotNull() & F.col("v_max").isNotNull() & ~F.exists("data", lambda x: x.isNull() | (x < 0) | (x > 255)))
    span = F.col("v_max").cast("double") - F.col("v_min").cast("double")
    fit = fit.where(F.exists("data", lambda x: F.col("v_min").cast("double") + x / F.lit(255.0) * span != 0))
    known = keys.select(F.col(keys.columns[0]).alias("__id")).distinct()
    return fit.join(known, F.col("unit_id") == F.col("__id"), "left_semi").select("unit_id", "v_min", "v_max", "data")


def _pack(records: DataFrame) -> DataFrame:
    """Elements as one byte each."""
    ship(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.uint8)
            size = len(flat) // max(1, len(lists))
            data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(lists), [None, pa.py_buffer(flat.tobytes())]) if len(lists) else pa.array([], pa.binary(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), data.cast(pa.binary())], names=["unit_id", "v_min", "v_max", "data"])

    return records.mapInArrow(run, "unit_id bigint, v_min float, v_max float, data binary")


def _vectors(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    """Dequantized vectors of unit length, in doubles."""
    raw = np.frombuffer(b"".join(table.column("data").to_pylist()), np.uint8).reshape(table.num_rows, -1).astype(np.float64)
    low = table.column("v_min").to_numpy().astype(np.float64)[:, None]
    high = table.column("v_max").to_numpy().astype(np.float64)[:, None]
    vectors = low + raw / 255 * (high - low)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def hash_strings(classes: DataFrame, trees: int = TREES) -> DataFrame:
    """(unit_id, v_min, v_max, data, hashes array<bigint>, fines array<bigint>), two halves of a string per tree."""
    ship(classes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _vectors(batch).astype(np.float32)
            if own is None:
                own = planes(vectors.shape[1], trees)
            signs, fine, shift = own
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * trees)
            halves = []
            for bits in (vectors @ signs > 0, np.floor(vectors @ fine + shift).astype(np.int32) & 1 == 1):
                packed = np.packbits(bits.reshape(-1, trees, BITS), axis=2).reshape(-1).view(">i8").astype(np.int64)
                halves.append(pa.ListArray.from_arrays(offsets, pa.array(packed)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *halves], names=["unit_id", "v_min", "v_max", "data", "hashes", "fines"])

    return classes.mapInArrow(run, "unit_id bigint, v_min float, v_max float, data binary, hashes array<bigint>, fines array<bigint>")


def closest(sims: np.ndarray, queries: np.ndarray, others: np.ndarray, ids: np.ndarray, take: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id and cosine of the ``take`` most similar others of each query, by rounded cosine, then id. Places of ``sims`` under -1 don't count,
    nor, where it is given, those under ``least`` of a query."""
    if least is not None and least.min(initial=1.0) > -1:
        bar = least.astype(np.float32) - np.float32(MARGIN)
    else:
        want = min(take, sims.shape[1])
        bar = np.partition(sims, -want, axis=1)[:, -want] - MARGIN
    row, col = np.nonzero(sims >= np.maximum(bar, -1.5)[:, None])
    # one pair alone always gives the same sum, unlike a product of matrices
    cosines = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", queries[row[i : i + 65_536]], others[col[i : i + 65_536]]) for i in range(0, len(row), 65_536))])
    cosines = np.round(cosines, 6)
    order = np.lexsort((ids[col], -cosines, row))
    row, other, cosines = row[order], ids[col[order]], cosines[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < take
    return row[first], other[first], cosines[first]


def _lists(n: int, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Array:
    """One list (minus cosine, other) for each of ``n`` rows."""
    rows, other, cosines = (np.concatenate(x) for x in zip(*found))
    items = pa.StructArray.from_arrays([pa.array(-cosines), pa.array(other.astype(np.int64))], names=["minus", "other"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), items)


def shared_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of leading bits that hash strings have in common."""
    differing = (a ^ b).view(np.uint64)
    length = np.zeros(len(differing), np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        same = differing >> np.uint64(BITS - step) == 0
        length[same] += step
        differing = np.where(same, differing << np.uint64(step), differing)
    return np.where(a == b, BITS, length)


def beside(hashes: np.ndarray, fines: np.ndarray) -> np.ndarray:
    """Bits that each place of a sorted array shares with the next one."""
    shared = shared_prefix(hashes[:-1], hashes[1:])
    return np.where(shared == BITS, BITS + shared_prefix(fines[:-1], fines[1:]), shared)


def descend(lcp: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of a sorted array the lengths of prefixes at which more others share it, from the longest match on, and
    how many more: flat, as length * 2^20 + number, with offsets. Numbers add up to no more than ``budget``."""
    n = len(lcp) + 1
    known = np.zeros(n, np.int64)
    rows, steps = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for length in np.unique(lcp)[::-1].tolist():
        run = np.concatenate([[0], np.cumsum(lcp < length)])
        others = np.minimum(np.bincount(run)[run] - 1, budget)
        more = np.flatnonzero(others > known)
        rows.append(more)
        steps.append((length << 20) + others[more] - known[more])
        known = others
        if known.min() >= budget:
            break
    row, step = np.concatenate(rows), np.concatenate(steps)
    order = np.argsort(row, kind="stable")
    return step[order], np.searchsorted(row[order], np.arange(n + 1))


def ascend(steps: np.ndarray, bounds: np.ndarray, budget: int) -> np.ndarray:
    """Length of prefix at which all trees together give ``budget`` others to each vector; 0 where they never do."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    length, more = steps >> 20, steps & ((1 << 20) - 1)
    order = np.lexsort((-length, owner))
    total = np.concatenate([[0], np.cumsum(more[order])])
    enough = np.flatnonzero(total[1:] - total[bounds[owner]] >= budget)
    out = np.zeros(n, np.int64)
    first = np.append(True, owner[enough][1:] != owner[enough][:-1]) if len(enough) else np.zeros(0, bool)
    out[owner[enough[first]]] = length[order][enough[first]]
    return out


def block_of(lcp: np.ndarray, lengths: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[begin, end) of the places that share a prefix of the given length with each of ``places``."""
    begin, end = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
    for length in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == length)
        edges = np.concatenate([[0], np.flatnonzero(lcp < length) + 1, [len(lcp) + 1]])
        at = np.searchsorted(edges, places[own], side="right")
        begin[own], end[own] = edges[at - 1], edges[at]
    return begin, end


def _segments(tree: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = [0, *(np.flatnonzero(np.diff(tree)) + 1).tolist(), len(tree)]
    return zip(edges, edges[1:])


def depths(hashed: DataFrame, n: int, trees: int, budget: int) -> DataFrame:
    """(unit_id, depth, places array<struct<tree, range, side>>): length of prefix at which the ascent ends, and where a vector stands in each tree.

    ``side`` is -1 or 1 for places that the range before or behind has in its halo too. Only strings and ids are shuffled.
    """
    most = max(1, math.ceil(n * trees / RANGE_ROWS))

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        number, rows = TaskContext.get().partitionId(), table.num_rows
        tree, hashes, fines = (table.column(c).to_numpy() for c in ("tree", "hash", "fine"))
        for a, b in _segments(tree):
            steps, bounds = descend(beside(hashes[a:b], fines[a:b]), budget)
            side = np.where(np.arange(a, b) < HALO, -1, 0) + np.where(np.arange(a, b) >= rows - HALO, 1, 0)
            if rows < 2 * HALO:  # a small range is in both
                side = np.where((np.arange(a, b) < HALO) & (np.arange(a, b) >= rows - HALO), 2, side)
            columns = [table.column("unit_id").slice(a, b - a).combine_chunks(), pa.array(tree[a:b]), pa.array(np.full(b - a, number, np.int32)), pa.array(side.astype(np.int32)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(steps.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(columns, names=["unit_id", "tree", "range", "side", "steps"])

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = batch.column(1)
            depth = ascend(steps.flatten().to_numpy().astype(np.int64), steps.offsets.to_numpy().astype(np.int64) - steps.offsets[0].as_py(), budget)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(depth.astype(np.int32)), batch.column(2)], names=["unit_id", "depth", "places"])

    forest = hashed.select("unit_id", F.posexplode(F.arrays_zip("hashes", "fines")).alias("tree", "h")).select("tree", F.col("h.hashes").alias("hash"), F.col("h.fines").alias("fine"), F.xxhash64("unit_id", "tree").alias("salt"), "unit_id")
    ordered = forest.repartitionByRange(most, "tree", "hash", "fine", "salt").sortWithinPartitions("tree", "hash", "fine", "salt")
    found = ordered.mapInArrow(down, "unit_id bigint, tree int, range int, side int, steps array<int>")
    by_unit = found.groupBy("unit_id").agg(F.flatten(F.collect_list("steps")).alias("steps"), F.collect_list(F.struct("tree", "range", "side")).alias("places"))
    return by_unit.mapInArrow(up, "unit_id bigint, depth int, places array<struct<tree:int,range:int,side:int>>")


def class_candidates(hashed: DataFrame, n: int, k: int = K, trees: int = TREES, budget: int = BUDGET) -> DataFrame:
    """(unit_id, near, depth, whole): each class with its most similar classes in each tree, the prefix reached, and whether all places that share it were there."""
    reached = depths(hashed, n, trees, max(k + 1, math.ceil(budget * math.log2(max(2, n)))))
    side = F.col("p.side")
    ranges = F.array_compact(F.array(F.struct(F.col("p.range").alias("range"), F.lit(True).alias("asks")), F.when((side == -1) | (side == 2), F.struct((F.col("p.range") - 1).alias("range"), F.lit(False).alias("asks"))), F.when(side >= 1, F.struct((F.col("p.range") + 1).alias("range"), F.lit(False).alias("asks")))))
    placed = (
        reached.join(hashed, "unit_id")
        .select("unit_id", "depth", "v_min", "v_max", "data", "hashes", "fines", F.explode("places").alias("p"))
        .select("unit_id", "depth", "v_min", "v_max", "data", F.col("p.tree").alias("tree"), F.get("hashes", "p.tree").alias("hash"), F.get("fines", "p.tree").alias("fine"), F.explode(ranges).alias("r"))
        .select("unit_id", "depth", "v_min", "v_max", "data", "tree", "hash", "fine", F.xxhash64("unit_id", "tree").alias("salt"), "r.range", "r.asks")
    )

    def run(table: pa.Table) -> pa.Table:
        tree, hashes, fines, salt = (table.column(c).to_numpy() for c in ("tree", "hash", "fine", "salt"))
        table = table.take(pa.array(np.lexsort((salt, fines, hashes, tree))))
        tree, hashes, fines, ids, depth = (table.column(c).to_numpy() for c in ("tree", "hash", "fine", "unit_id", "depth"))
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        out: list[pa.Table] = []
        for a, b in _segments(tree):
            vectors, own = _vectors(table.slice(a, b - a)), ids[a:b]
            single = vectors.astype(np.float32)
            query = np.flatnonzero(asks[a:b])
            begin, end = block_of(beside(hashes[a:b], fines[a:b]), depth[a:b][query], query)
            whole = (begin + a > 0) & (end + a < len(tree)) & (query - begin <= HALO) & (end - query <= HALO + 1)
            begin, end = np.maximum(begin, query - HALO), np.minimum(end, query + HALO + 1)
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            for c in range(0, len(query), BLOCK):
                part = slice(c, min(len(query), c + BLOCK))
                lo, hi = int(begin[part].min()), int(end[part].max())
                sims = single[query[part]] @ single[lo:hi].T
                column = np.arange(lo, hi)
                sims[(column < begin[part, None]) | (column >= end[part, None]) | (column == query[part, None])] = -2
                row, other, cosines = closest(sims, vectors[query[part]], vectors[lo:hi], own[lo:hi], k + 1)
                found.append((row + c, other, cosines))
            out.append(pa.table({"unit_id": own[query], "near": _lists(len(query), found), "depth": depth[a:b][query], "whole": whole}))
        return pa.concat_tables(out)

    return placed.groupBy("range").applyInArrow(run, f"unit_id bigint, {NEAR}, depth int, whole boolean")


def merged(k: int) -> Column:
    """The k + 1 best of the lists of a vector."""
    return F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k + 1).alias("near")


def kth_cosine(k: int, least: float) -> Column:
    """Cosine that another vector must have to count: that of the k-th of ``near``, and ``least``."""
    return F.greatest(F.lit(least), F.least(F.lit(1.0), F.when(F.size("near") >= k, -F.col("near")[k - 1]["minus"]).otherwise(-1.0)))


def chance_of_loss(n: int, k: int, least: float = -1.0) -> Column:
    """Chance that no tree with all places of the prefix, and none of those with leaves of depths ``more``, had a neighbour as near as the k-th of ``near`` and ``least``."""
    cosine = kth_cosine(k, least)
    same = 1 - F.acos(cosine) / math.pi
    signs = F.pow(same, F.least("depth", F.lit(BITS)))
    distance, fine = F.sqrt(2 - 2 * cosine), F.lit(1.0)
    for i, width in enumerate(WIDTHS):
        # a projection of the difference is 0.8 of it on average
        bits = F.greatest(F.lit(0), F.least(F.lit(FINE), F.col("depth") - BITS - i * FINE))
        fine = fine * F.pow(F.greatest(F.lit(0.5), 1 - 0.8 * distance / width), bits)
    loss = F.aggregate("more", F.pow(1 - signs * fine, "whole"), lambda x, depth: x * (1 - F.pow(same, depth)))
    return loss if least > -1 else F.when(F.size("near") >= k, loss).otherwise(F.when(F.size("near") < n - 1, 1.0).otherwise(0.0))


def trees_needed(n: int, k: int, least: float) -> Column:
    """About how many more trees bring ``loss`` down to SURE."""
    same = 1 - F.acos(kth_cosine(k, least)) / math.pi
    return F.log(SURE / F.col("loss")) / F.log(1 - F.least(F.lit(0.999), F.greatest(F.lit(1e-9), F.pow(same, math.log2(max(2.0, n / LEAF))))))


def leaves(words: np.ndarray, depth: int, most: int = 2 * LEAF) -> Iterator[tuple[np.ndarray, int]]:
    """Places of each part of at most ``most`` words that share a prefix, and its length: all share ``depth`` bits already. Equal words stay together."""
    words = words.view(np.uint64)
    order = np.argsort(words, kind="stable")
    ordered, parts = words[order], [(0, len(words), depth)]
    while parts:
        a, b, depth = parts.pop()
        if b - a <= most or depth == BITS:
            yield order[a:b], depth
            continue
        shift = np.uint64(BITS - 1 - depth)
        middle = a + int(np.searchsorted(ordered[a:b] >> shift & np.uint64(1), 1))
        parts += [(x, y, depth + 1) for x, y in ((a, middle), (middle, b)) if x < y]


def more_candidates(classes: DataFrame, asked: DataFrame, n: int, k: int, number: int) -> DataFrame:
    """(unit_id, near, depth): what each of ``asked`` (unit_id, least) shares a leaf with in each of MORE further trees, at a cosine of ``least`` or more, and the depth of the leaf."""
    low = max(0, int(math.log2(max(1.0, n / LEAF))))
    columns = ["unit_id", "v_min", "v_max", "data", "least"]

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = None
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _vectors(batch).astype(np.float32)
            if signs is None:
                signs = np.random.default_rng([SEED, number]).standard_normal((vectors.shape[1], MORE * BITS)).astype(np.float32)
            words = np.packbits((vectors @ signs > 0).reshape(-1, MORE, BITS), axis=2).view(">i8").astype(np.int64).reshape(-1, MORE)
            for tree in range(MORE):
                word = words[:, tree].copy()
                cell = (word.view(np.uint64) >> np.uint64(1) >> np.uint64(BITS - 1 - low)).astype(np.int64) * MORE + tree
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(word), pa.array(cell)], names=[*columns, "word", "cell"])

    def run(cell: pa.Table) -> pa.Table:
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        asks = pc.is_valid(cell.column("least")).to_numpy(zero_copy_only=False)
        least = cell.column("least").fill_null(2.0).to_numpy()
        own, near, depths_ = [], [pa.array([], pa.list_(pa.struct([("minus", pa.float64()), ("other", pa.int64())])))], []
        for places, depth in leaves(cell.column("word").to_numpy(), low):
            asking = np.flatnonzero(asks[places])
            if not len(asking):
                continue
            part = cell.take(pa.array(places))
            vectors, ids, bar = _vectors(part), part.column("unit_id").to_numpy(), least[places]
            single, found = vectors.astype(np.float32), [empty]
            for a in range(0, len(asking), BLOCK):
                query = asking[a : a + BLOCK]
                sims = single[query] @ single.T
                sims[np.arange(len(query)), query] = -2
                row, other, cosines = closest(sims, vectors[query], vectors, ids, k + 1, bar[query])
                found.append((row + a, other, cosines))
            own.append(ids[asking])
            near.append(_lists(len(asking), found))
            depths_.append(np.full(len(asking), depth, np.int32))
        return pa.table({"unit_id": np.concatenate([np.zeros(0, np.int64), *own]), "near": pa.chunked_array(near), "depth": np.concatenate([np.zeros(0, np.int32), *depths_])})

    ship(classes.sparkSession)
    rows = classes.select(*columns[:-1]).hint("merge").join(asked, "unit_id", "left").select(*columns)
    planted = rows.mapInArrow(plant, "unit_id bigint, v_min float, v_max float, data binary, least double, word bigint, cell bigint")
    return planted.groupBy("cell").applyInArrow(run, f"unit_id bigint, {NEAR}, depth int")


def settle(found: DataFrame, classes: DataFrame, n: int, k: int, least: float) -> tuple[list[DataFrame], DataFrame]:
    """Frames of vectors at a ``loss`` of MISS or less, those after more trees at SURE or less, and what is left open."""
    settled, left, number, enough = [], [], 0, MISS
    while True:
        settled.append(found.where(F.col("loss") <= enough))
        open_ = found.where(F.col("loss") > enough)
        fit = F.coalesce(trees_needed(n, k, least) * LEAF * LEAF_PRICE <= n, F.lit(False))
        left.append(open_.where(~fit))
        asked = open_.where(fit)
        if asked.count() < LEAST_ASKED:
            left.append(asked)
            break
        more = more_candidates(classes, asked.select("unit_id", kth_cosine(k, least).alias("least")), n, k, number)
        by_unit = more.groupBy("unit_id").agg(F.flatten(F.collect_list("near")).alias("new"), F.collect_list("depth").alias("depths"))
        both = asked.hint("merge").join(by_unit, "unit_id").select("unit_id", F.slice(F.array_sort(F.array_distinct(F.concat("near", "new"))), 1, k + 1).alias("near"), "depth", "whole", F.concat("more", "depths").alias("more"))
        found = cut(both.withColumn("loss", chance_of_loss(n, k, least)))
        number, enough = number + 1, SURE
    rest = left[0]
    for frame in left[1:]:
        rest = rest.unionByName(frame)
    return settled, rest


def among_all(queries: DataFrame, classes: DataFrame, n: int, k: int) -> DataFrame:
    """(unit_id, near): the most similar of all classes at a cosine of ``least`` or more for each query, exactly; one list for each block of classes."""
    side = min(MOST_SIDE, max(SIDE, math.ceil(n / SIDES)))
    chunks, blocks = max(1, math.ceil(queries.count() / side)), max(1, math.ceil(n / side))

    def run(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by("unit_id")
        asked, all_ = cell.filter(cell.column("asked")), cell.filter(pc.invert(cell.column("asked")))
        own, ids = asked.column("unit_id").to_numpy(), all_.column("unit_id").to_numpy()
        if not len(own) or not len(ids):
            return pa.table({"unit_id": pa.array([], pa.int64()), "near": _lists(0, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))])})
        queries, others = _vectors(asked), _vectors(all_)
        single, least = others.astype(np.float32), asked.column("least").to_numpy()
        place = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
        found = []
        for a in range(0, len(own), BLOCK):
            b = min(len(own), a + BLOCK)
            sims = queries[a:b].astype(np.float32) @ single.T
            self_ = np.flatnonzero(ids[place[a:b]] == own[a:b])
            sims[self_, place[a:b][self_]] = -2
            row, other, cosines = closest(sims, queries[a:b], others, ids, k + 1, least[a:b])
            found.append((row + a, other, cosines))
        return pa.table({"unit_id": pa.array(own), "near": _lists(len(own), found)})

    columns = ["unit_id", "v_min", "v_max", "data"]
    chunk, block = F.pmod(F.xxhash64("unit_id"), F.lit(chunks)), F.pmod(F.xxhash64("unit_id"), F.lit(blocks))
    left = queries.select(*columns, "least", F.lit(True).alias("asked"), chunk.alias("c"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    right = classes.select(*columns, F.lit(-1.0).alias("least"), F.lit(False).alias("asked"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("c"), block.alias("b"))
    cells = left.unionByName(right).select(*columns, "least", "asked", (F.col("c") * blocks + F.col("b")).alias("cell"))
    return cells.groupBy("cell").applyInArrow(run, f"unit_id bigint, {NEAR}")


def nearest(records: DataFrame, keys: DataFrame, k: int = K, dim: int = DIM, trees: int = TREES, budget: int = BUDGET, least: float = -1.0) -> DataFrame:
    """(unit_id, other, cosine, rank): the k most similar other vectors of every vector, cosine rounded to six decimals. Those below ``least`` need not be there."""
    packed = _pack(usable_vectors(records, keys, dim)).withColumn("content", F.sha2(F.concat("data", F.encode(F.concat_ws("|", F.col("v_min").cast("string"), F.col("v_max").cast("string")), "UTF-8")), 256))
    rows = cut(packed)
    firsts = rows.groupBy("content").agg(F.min("unit_id").alias("rep"))
    members = cut(rows.join(firsts, "content").select("unit_id", "rep"))
    classes = rows.join(members.where("unit_id = rep").select("unit_id"), "unit_id", "left_semi").select("unit_id", "v_min", "v_max", "data")
    hashed = cut(hash_strings(classes, trees))
    n = hashed.count()
    # the best classes of each class, over all trees
    forest = class_candidates(hashed, n, k, trees, budget).groupBy("unit_id").agg(merged(k), F.first("depth").alias("depth"), F.count_if("whole").alias("whole"))
    found = cut(forest.withColumn("more", F.array().cast("array<int>")).withColumn("loss", chance_of_loss(n, k, least)))
    settled, left = settle(found, hashed, n, k, least)
    queries = hashed.join(left.select("unit_id", kth_cosine(k, least).alias("least")), "unit_id")
    best = among_all(queries, hashed, n, k).groupBy("unit_id").agg(merged(k))
    for frame in settled:
        best = best.unionByName(frame.select("unit_id", "near"))
    best_classes = best.select("unit_id", F.explode("near").alias("x")).select("unit_id", F.col("x.other").alias("other"), (-F.col("x.minus")).alias("cosine"))
    own = hashed.select("unit_id", F.col("unit_id").alias("other"), F.lit(1.0).alias("cosine"))
    # k + 1 smallest ids of each class stand for it; the limit runs before the shuffle
    few = members.withColumn("rn", F.row_number().over(Window.partitionBy("rep").orderBy("unit_id"))).where(F.col("rn") <= k + 1).select(F.col("rep").alias("other"), F.col("unit_id").alias("id"))
    spread = best_classes.unionByName(own).join(few, "other")
    lists = spread.groupBy(F.col("unit_id").alias("rep")).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("minus"), "id"))), 1, k + 1).alias("near"))
    each = members.join(lists, "rep").select("unit_id", F.slice(F.filter("near", lambda x: x["id"] != F.col("unit_id")), 1, k).alias("near"))
    return each.select("unit_id", F.posexplode("near").alias("at", "n")).select("unit_id", F.col("n.id").alias("other"), (-F.col("n.minus")).alias("cosine"), (F.col("at") + 1).alias("rank"))


def similar_pairs(neighbours: DataFrame, threshold: float = 0.80) -> DataFrame:
    """(unit_a, unit_b), smaller first, of units of which one is among the nearest of the other at ``threshold`` or more."""
    return neighbours.where(F.col("cosine") >= threshold).select(F.least("unit_id", "other").alias("unit_a"), F.greatest("unit_id", "other").alias("unit_b")).distinct()
