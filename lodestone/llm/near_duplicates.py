"""Near-duplicate texts with small edits: bottom-k sketches from one hash function.

A text is the set of its runs of three consecutive words, each as a 63-bit hash. Texts with
the same set are one class with its smallest id as representative. A class retains the
smallest hashes of its set: all of a set of up to ``SKETCH``, of a larger one those below
2^63 / 2^level, between SKETCH / 2 and SKETCH of them. Sketches of one level end at the same
hash, so two of them together are a sketch of the union of both sets; pairs are compared at
the level of the larger set.

Inverted lists of retained values generate the pairs. Each sketch is ordered from rare to hot
values, as counts of all values in ``BUCKETS`` buckets tell, and only its beginning is listed:
a set of n values has at most 0.25 n values that a larger partner at 0.60 lacks and at most
0.40 n that a smaller one lacks, so one more value must meet. A text enters the lists of its
first 0.25 n + 1 values to be found by larger texts and those of its first 0.40 n + 1 values
to look for smaller ones. Headers that make less than 0.6 of a text therefore make no pairs,
whatever the number of texts that share them. Where a sketch is a sample, both shares are
widened by 4.9 standard deviations. Lists of hot values are laid out as a grid of cells of
about ``CELL`` x ``CELL`` texts before any shuffle.

The union of two sketches filters the pairs, in two steps. Values that met, and the places of
the last one in both orders, bound what both sketches can share; then the sketches themselves,
16 bits a value, tell what they share. A pair stays only if that reaches 0.375 of the sum of
both sizes (0.60 of the union), less 4.9 standard deviations for samples. Sets of
up to SKETCH values lose nothing by either step; of larger ones a pair at exactly 0.60 gets
lost with a chance of about one in a million. Exact Jaccard over the whole sets verifies the
rest.

Null and short texts and texts of under three words have no pairs. Repeated rows count once,
rows without an id not at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.bpe import mixed, word_keys
from lodestone.session import cut, drop, ship

MIN_CHARS = 200
RUN = 3
SKETCH = 256
BUCKETS = 1 << 22
BUCKETS_IN_ROW = 1 << 14
PART_VALUES = 1 << 20
CELL = 1000
DEVIATIONS = 4.9
SENT_IDS = 1_000_000
THRESHOLD = (3, 5)  # 0.60 as a fraction, so that the last comparison is exact
PART_BYTES = 1 << 18

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), 95, *range(97, 123)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += np.uint8(32)


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of all texts as one flat array, and the offsets of each text."""
    whole = b"\n".join([*texts, b""])
    raw = np.frombuffer(whole, np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    text_begin = np.cumsum(sizes) - sizes
    word = WORD_BYTE[raw]
    edge = np.diff(np.concatenate([[0], word.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    one = word_keys(LOWER[raw], begin, end)
    if len(one) < RUN:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    text = np.searchsorted(text_begin, begin, side="right") - 1
    many = one[: len(one) - RUN + 1].copy()
    for i in range(1, RUN):
        many = mixed(many * np.uint64(0x9E3779B97F4A7C15) + one[i : len(one) - RUN + 1 + i])
    inside = text[: len(many)] == text[RUN - 1 :]
    many, text = many[inside], text[: len(inside)][inside]
    many >>= np.uint64(1)  # 63 bits: signed and unsigned order are the same
    order = np.lexsort((many, text))
    many, text = many[order], text[order]
    fresh = np.append(True, (many[1:] != many[:-1]) | (text[1:] != text[:-1])) if len(many) else np.zeros(0, bool)
    many, text = many[fresh], text[fresh]
    return many, np.searchsorted(text, np.arange(len(texts) + 1))


def _parts(sizes: list[int]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, s in enumerate(sizes):
        size += s
        if size >= PART_BYTES or i == len(sizes) - 1:
            yield begin, i + 1
            begin, size = i + 1, 0


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


def hot_values(texts: DataFrame) -> tuple[np.ndarray, int]:
    """About how many texts have the values of each of BUCKETS buckets, and the median of these counts.

    Rare values that fall into one bucket add up to nearly the same everywhere, so that hot ones
    stand out at any size; the order of values need not be exact, only the same for all texts.
    """
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.uint32)
        parts, size = [], 0

        def add() -> None:
            counts[:] += np.bincount(np.concatenate([np.zeros(0, np.int64), *parts]), minlength=BUCKETS).astype(np.uint32)

        for batch in batches:
            bodies = batch.column(0).cast(pa.binary()).to_pylist()
            for a, b in _parts([len(x) for x in bodies]):
                parts.append(_bucket(shingle_sets(bodies[a:b])[0]))
                size += len(parts[-1])
                if size >= PART_VALUES:
                    add()
                    parts, size = [], 0
        add()
        rows = np.minimum(counts, 0xFFFF).astype("<u2").reshape(-1, BUCKETS_IN_ROW)
        for i in np.flatnonzero(rows.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([rows[i].tobytes()], pa.binary())], names=["part", "n"])

    def total(rows: pa.Table) -> pa.Table:
        n = np.zeros(BUCKETS_IN_ROW, np.int64)
        for x in rows.column("n"):
            n += np.frombuffer(x.as_py(), "<u2")
        return pa.table({"part": rows.column("part").slice(0, 1), "n": pa.array([np.minimum(n, 0xFFFFFFFF).astype("<u4").tobytes()], pa.binary())})

    counted = cut(texts.select("body").mapInArrow(run, "part int, n binary").groupBy("part").applyInArrow(total, "part int, n binary"))
    counts = np.zeros((BUCKETS // BUCKETS_IN_ROW, BUCKETS_IN_ROW), np.uint32)
    for part, n in counted.collect():
        counts[part] = np.frombuffer(n, "<u4")
    drop(counted)
    return counts.reshape(-1), int(np.median(counts))


def _bucket(values: np.ndarray) -> np.ndarray:
    return (values & np.uint64(BUCKETS - 1)).astype(np.int64)


def level_of(n: np.ndarray) -> np.ndarray:
    """Smallest level at which a set of n values keeps about SKETCH values or less."""
    return np.ceil(np.log2(np.maximum(n, 1) / SKETCH)).clip(0).astype(np.int64)


def listed(values: np.ndarray, bounds: np.ndarray, counts: np.ndarray, usual: int) -> tuple[np.ndarray, ...]:
    """Sketches of texts as one row each text and level: text, sample size, number of values listed to be found, whether it looks for
    others; then keys and numbers of cells of the listed values in order, as flat arrays with offsets."""
    p, q = THRESHOLD
    n = np.diff(bounds)
    own, above = level_of(n), level_of(n * q // p)
    two = np.flatnonzero((above > own) & (n > 0))
    text = np.concatenate([np.flatnonzero(n > 0), two])
    level = np.concatenate([own[n > 0], above[two]])
    looks = np.arange(len(text)) < len(text) - len(two)
    order = np.lexsort((level, text))
    text, level, looks = text[order], level[order], looks[order]
    # a text's values ascend, so a sample is its beginning
    row_of = np.repeat(np.arange(len(text)), n[text])
    at = np.arange(len(row_of)) - np.repeat(np.cumsum(n[text]) - n[text], n[text]) + bounds[text][row_of]
    inside = values[at] < (np.uint64(1 << 63) >> level[row_of].astype(np.uint64))
    row_of, value = row_of[inside], values[at[inside]]
    size = np.bincount(row_of, minlength=len(text))
    weight = counts[_bucket(value)].astype(np.int64)
    order = np.lexsort((value, weight, row_of))
    value, weight = value[order], weight[order]
    start = np.cumsum(size) - size
    rank = np.arange(len(value)) - np.repeat(start, size)
    # most values of a sketch that a larger (0.25) or a smaller partner (0.40) lacks
    spread = np.where(level > 0, DEVIATIONS * np.sqrt(size), 0.0)
    extra = (level > 0).astype(np.int64)
    # 2 t / (1 + t) of a set is in a partner as large, t of it in any partner, for t = p / q
    found = np.minimum(size, size * (q - p) // (q + p) + np.floor(spread * (2 * p * (q - p)) ** 0.5 / (q + p)).astype(np.int64) + extra + 1)
    looking = np.minimum(size, size * (q - p) // q + np.floor(spread * (p * (q - p)) ** 0.5 / q).astype(np.int64) + extra + 1)
    kept = rank < np.repeat(np.where(looks, looking, found), size)
    key = mixed(value + np.repeat(level, size).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    cells = np.maximum(1, -((usual - weight) // CELL)).astype(np.int32)
    many = np.add.reduceat(kept, start) if len(start) and len(kept) else np.zeros(len(text), np.int64)
    return text, size, found, looks, key[kept], cells[kept], np.concatenate([[0], np.cumsum(many)])


def set_keys(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums that identify each set."""
    n = np.diff(bounds)
    filled = n > 0
    out = np.zeros((2, len(n)), np.uint64)
    if len(values):
        out[0, filled] = np.add.reduceat(mixed(values), bounds[:-1][filled])
        out[1, filled] = np.add.reduceat(mixed(values ^ np.uint64(0xA0761D6478BD642F)), bounds[:-1][filled])
    return out[0].view(np.int64), out[1].view(np.int64)


ROWS = "id bigint, set_a bigint, set_b bigint, n bigint, s int, n_found int, looks boolean, keys array<bigint>, cells array<int>"


def sketches(texts: DataFrame, counts: np.ndarray, usual: int) -> DataFrame:
    """Listed parts of the sketches of all texts, see ROWS: one row for each text and level. No shuffle.

    The counts of BUCKETS buckets are 4 bytes each.
    """
    ship(texts.sparkSession)
    sent = texts.sparkSession.sparkContext.broadcast((counts, usual))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(1).cast(pa.binary()).to_pylist()
            ids = batch.column(0)
            for a, b in _parts([len(x) for x in bodies]):
                values, bounds = shingle_sets(bodies[a:b])
                text, size, found, looks, key, cells, ends = listed(values, bounds, *sent.value)
                set_a, set_b = set_keys(values, bounds)
                offsets = pa.array(ends.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(text + a)), pa.array(set_a[text]), pa.array(set_b[text]), pa.array(np.diff(bounds)[text]), pa.array(size.astype(np.int32)), pa.array(found.astype(np.int32)), pa.array(looks), _lists(key, ends), pa.ListArray.from_arrays(offsets, pa.array(cells))],
                    names=["id", "set_a", "set_b", "n", "s", "n_found", "looks", "keys", "cells"],
                )

    return texts.mapInArrow(run, ROWS)


def short_sketches(texts: DataFrame) -> DataFrame:
    """(id, set_a, set_b, sketch binary): two sums that identify the set, and 16 bits of each value of its sketch, from the smallest value on. No shuffle."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(1).cast(pa.binary()).to_pylist()
            for a, b in _parts([len(x) for x in bodies]):
                values, bounds = shingle_sets(bodies[a:b])
                n = np.diff(bounds)
                filled = np.flatnonzero(n > 0)
                owner = np.repeat(np.arange(b - a), n)
                kept = values < (np.uint64(1 << 63) >> level_of(n).astype(np.uint64)[owner])
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner[kept], minlength=b - a))]) * 2
                short = (values[kept] & np.uint64(0xFFFF)).astype("<u2").tobytes()
                sketch = [short[ends[i] : ends[i + 1]] for i in filled.tolist()]
                set_a, set_b = set_keys(values, bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(filled)), pa.array(set_a[filled]), pa.array(set_b[filled]), pa.array(sketch, pa.binary())], names=["id", "set_a", "set_b", "sketch"])

    return texts.mapInArrow(run, "id bigint, set_a bigint, set_b bigint, sketch binary")


def shared(a: list[bytes], b: list[bytes], size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Values that the first ``size`` ones of two sketches have in common, as often as both have them; never less than the true number."""
    n = len(a)
    flat = []
    for sketch, size in ((a, size_a), (b, size_b)):
        value = np.frombuffer(b"".join(x[: 2 * k] for x, k in zip(sketch, size.tolist())), "<u2").astype(np.uint64)
        key = np.sort(value | np.repeat(np.arange(n, dtype=np.uint64), size) << np.uint64(16))
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        flat.append((key[first], np.diff(np.append(first, len(key)))))
    _, i, j = np.intersect1d(flat[0][0], flat[1][0], assume_unique=True, return_indices=True)
    return np.bincount((flat[0][0][i] >> np.uint64(16)).astype(np.int64), np.minimum(flat[0][1][i], flat[1][1][j]), n).astype(np.int64)


def full_sets(texts: DataFrame) -> DataFrame:
    """(id, hashes array<bigint>): the whole set of each text. No shuffle."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(1).cast(pa.binary()).to_pylist()
            for a, b in _parts([len(x) for x in bodies]):
                values, bounds = shingle_sets(bodies[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _lists(values, bounds)], names=["id", "hashes"])

    return texts.mapInArrow(run, "id bigint, hashes array<bigint>")


def value_lists(rows: DataFrame) -> DataFrame:
    """(key, rep, info) of values of at least two classes: set size, sample size, place and role; 1 is to be found, 2 looks for others, 3 both.

    Copies are reduced to one class before and while they are shuffled. Of a hot value with c cells a side, a class stands in c cells to be
    found and in c cells to look: the one they have in common joins every two classes once.
    """
    classes = rows.groupBy("set_a", "set_b", "looks").agg(F.min_by(F.struct("id", "n", "s", "n_found", "keys", "cells"), "id").alias("r")).select(F.col("r.id").alias("rep"), F.col("r.n").alias("n"), F.col("r.s").alias("s"), F.col("r.n_found").alias("n_found"), "looks", F.posexplode(F.arrays_zip("r.keys", "r.cells")).alias("at", "v"))
    place = F.col("at") + 1
    flat = classes.select(F.col("v.keys").alias("key"), F.col("v.cells").alias("cells"), "rep", _packed(F.col("n"), F.col("s"), place).alias("info"), ((place <= F.col("n_found")).cast("int") + F.col("looks").cast("int") * 2).alias("role"))
    cells, own = F.col("cells"), F.pmod(F.xxhash64("rep"), F.col("cells")).cast("int")
    one = lambda key, role: F.struct(key.alias("key"), role.cast("bigint").alias("role"))
    row = F.sequence(F.lit(0), cells - 1)
    found = F.transform(row, lambda other: one(F.xxhash64("key", own, other), F.lit(1)))
    looks = F.transform(row, lambda other: one(F.xxhash64("key", other, own), F.lit(2)))
    places = F.when(cells == 1, F.array(one(F.col("key"), F.col("role")))).otherwise(F.concat(F.when(F.col("role") % 2 == 1, found).otherwise(F.array()), F.when(F.col("role") >= 2, looks).otherwise(F.array())))
    spread = flat.select(F.explode(places).alias("p"), "rep", "info").select("p.key", "rep", (F.shiftleft("info", 2) + F.col("p.role")).alias("info"))
    here = Window.partitionBy("key")
    many = spread.withColumns({"all": F.count("*").over(here), "there": F.count_if(F.col("info") % 2 == 1).over(here)})
    return many.where("all > 1 AND there > 0").select(*spread.columns)


def _packed(n: Column, s: Column, at: Column) -> Column:
    """Set size, sample size and place as one number; the latter two are below 2^12 (SKETCH and what a sample can vary)."""
    return F.shiftleft(n.cast("bigint"), 24) + F.shiftleft(s.cast("bigint"), 12) + at


def _side(lists: DataFrame, role: int, end: str) -> DataFrame:
    """Rows of one role with their numbers unpacked; names end in ``end``."""
    info = F.col("info")
    part = lambda bits: (F.shiftright(info, bits).bitwiseAND(F.lit((1 << 12) - 1))).cast("int")
    return lists.where(info.bitwiseAND(F.lit(role)) != 0).select("key", F.col("rep").alias(f"rep_{end}"), F.shiftright(info, 26).alias(f"n_{end}"), part(14).alias(f"s_{end}"), part(2).alias(f"at_{end}"))


def candidate_pairs(lists: DataFrame) -> DataFrame:
    """(rep_a, rep_b, s_a, s_b, needed) of classes that meet in a list and whose union of sketches can have enough common values."""
    p, q = THRESHOLD
    a, b = _side(lists, 1, "a"), _side(lists, 2, "b")
    both = (F.col("s_a") + F.col("s_b")).cast("int")
    share = both * F.lit(p / (p + q))
    sample = F.sqrt(both) * (DEVIATIONS * (p * (q - p) * q / (p + q)) ** 0.5 / (p + q)) + 2
    needed = F.when(F.col("n_b") > SKETCH, F.floor(share - sample)).otherwise(F.ceil(both * F.lit(p) / F.lit(p + q)))
    larger = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("rep_a") < F.col("rep_b")))
    left = F.least(F.col("s_a") - F.col("at_a"), F.col("s_b") - F.col("at_b"))
    met = a.hint("merge").join(b, "key").where(larger & (F.col("n_a") * q >= F.col("n_b") * p) & (F.least("at_a", "at_b") + left >= needed))
    return met.groupBy("rep_a", "rep_b").agg(F.count("*").alias("met"), F.min(left).alias("left"), F.first("s_a").alias("s_a"), F.first("s_b").alias("s_b"), F.first(needed).alias("needed")).where(F.col("met") + F.col("left") >= F.col("needed")).select("rep_a", "rep_b", "s_a", "s_b", "needed")


def estimated_pairs(pairs: DataFrame, short: DataFrame) -> DataFrame:
    """(rep_a, rep_b) of pairs whose sketches share as many values as needed."""
    own = short.select("id", "sketch").hint("merge")
    both = pairs.join(own.toDF("rep_a", "sketch_a"), "rep_a").join(own.toDF("rep_b", "sketch_b"), "rep_b").select("rep_a", "rep_b", "sketch_a", "sketch_b", "s_a", "s_b", "needed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size_a, size_b, needed = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (4, 5, 6))
            enough = shared(batch.column(2).to_pylist(), batch.column(3).to_pylist(), size_a, size_b) >= needed
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["rep_a", "rep_b"]).filter(pa.array(enough))

    return both.mapInArrow(run, "rep_a bigint, rep_b bigint")


def class_members(sets: DataFrame) -> DataFrame:
    """(id, rep) of equal sets."""
    sets = sets.select("id", "set_a", "set_b")
    firsts = sets.groupBy("set_a", "set_b").agg(F.min("id").alias("rep"))
    return sets.hint("merge").join(firsts, ["set_a", "set_b"]).select("id", "rep").distinct()


def near_duplicate_classes(texts: DataFrame, key: str = "id", text: str = "body", min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """Links (rep_a, rep_b, common, either) between different classes and members (id, rep) of all classes."""
    long = texts.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("body")).where((F.length(text) >= min_chars) & F.col(key).isNotNull())
    lists = cut(value_lists(sketches(long, *hot_values(long))))
    met = cut(candidate_pairs(lists))
    drop(lists)
    short = cut(short_sketches(long))
    members = cut(class_members(short))
    pairs = cut(estimated_pairs(met, short).distinct())
    drop(met, short)
    wanted = cut(pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("id")).distinct())
    # texts are shuffled only where the ids, 8 bytes each, are too many to be sent
    wanted = wanted.hint("broadcast" if wanted.count() <= SENT_IDS else "merge")
    sets = cut(full_sets(long.join(wanted, "id", "left_semi")).dropDuplicates(["id"]))
    p, q = THRESHOLD
    one = pairs.hint("merge").join(sets.toDF("rep_a", "set_a"), "rep_a")
    exact = one.hint("merge").join(sets.toDF("rep_b", "set_b"), "rep_b").select("rep_a", "rep_b", F.size(F.array_intersect("set_a", "set_b")).alias("common"), F.size("set_a").alias("na"), F.size("set_b").alias("nb"))
    links = exact.withColumn("either", F.col("na") + F.col("nb") - F.col("common")).where(F.col("common") * q >= F.col("either") * p)
    links = cut(links.select("rep_a", "rep_b", "common", "either"))
    drop(sets, pairs)
    return links, members


def near_duplicate_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b), smaller first, of all members of linked classes and of each class itself."""
    a, b = members.toDF("id_1", "rep_a"), members.toDF("id_2", "rep_b")
    across = links.select("rep_a", "rep_b").join(a, "rep_a").join(b, "rep_b").select("id_1", "id_2")
    within = a.join(b, (F.col("rep_a") == F.col("rep_b")) & (F.col("id_1") < F.col("id_2"))).select("id_1", "id_2")
    return across.unionByName(within).select(F.least("id_1", "id_2").alias("id_a"), F.greatest("id_1", "id_2").alias("id_b"))


def group_labels(links: DataFrame, members: DataFrame, rounds: int = 30) -> DataFrame:
    """(id, group_id, n_links): group of each text as the smallest id reachable over links, and its number of links.

    Labels spread by repeated minimum over neighbours with pointer jumping; every round is
    written to the checkpoint folder. Raises if ``rounds`` don't suffice.
    """
    edges = cut(links.select(F.explode(F.array(F.struct(F.col("rep_a").alias("u"), F.col("rep_b").alias("v")), F.struct(F.col("rep_b").alias("u"), F.col("rep_a").alias("v")))).alias("e")).select("e.*"))
    labels = cut(members.select(F.col("rep").alias("u")).distinct().withColumn("label", F.col("u")))
    for _ in range(rounds):
        offered = edges.join(labels.toDF("v", "label"), "v").groupBy("u").agg(F.min("label").alias("offer"))
        lower = labels.join(offered, "u", "left").select("u", F.least("label", F.coalesce("offer", "label")).alias("label"), F.col("label").alias("old"))
        jumped = lower.join(labels.toDF("label", "next"), "label", "left").select("u", F.least("label", F.coalesce("next", "label")).alias("label"), "old")
        labels = cut(jumped)
        if labels.where("label <> old").isEmpty():
            sizes = members.groupBy("rep").agg(F.count("*").alias("copies"))
            degree = edges.join(sizes.toDF("v", "copies"), "v").groupBy(F.col("u").alias("rep")).agg(F.sum("copies").alias("across"))
            named = members.join(labels.select(F.col("u").alias("rep"), F.col("label").alias("group_id")), "rep").join(sizes, "rep").join(degree, "rep", "left")
            return named.select("id", "group_id", (F.col("copies") - 1 + F.coalesce("across", F.lit(0))).alias("n_links"))
        labels = labels.select("u", "label")
    raise RuntimeError(f"labels did not settle in {rounds} rounds")
