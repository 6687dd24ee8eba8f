"""Filling fixed-capacity containers: first-fit decreasing with a tournament tree.

Documents go to randomised groups by a hash of their key; each group is packed on its own,
so no task ever sees more than about GROUP_ITEMS items, whatever the size of the corpus.
At most one container a group stays far from full, which is lost in the noise at that size.

Only documents above the capacity are split: into full containers and one rest, which is
packed like any other item. Documents of size 0 (null or empty texts) take no space and get
a place in the first container of their group. Ties are broken by key, so a rerun gives the
same packing. Repeated keys are items of their own, told apart by ``copy``.
Rows without a key cannot be placed and are left out.
"""

from __future__ import annotations

import math
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import TOKENIZER, TOKENIZER_DIR, token_counts
from lodestone.session import cut, ship

CAPACITY = 2048
GROUP_ITEMS = 20_000

PACKED = "container bigint, position int, start int, doc_id bigint, copy int, piece int, piece_start bigint, n_tokens int"


class TournamentTree:
    """Room left in each container, with the winner (most room) of each pair of subtrees above."""

    def __init__(self, leaves: int, capacity: int) -> None:
        self.width = 1 << max(0, leaves - 1).bit_length()
        self.room = [capacity] * (2 * self.width)

    def first_fit(self, size: int) -> int:
        """Puts an item into the leftmost container with room for it."""
        room, at = self.room, 1
        while at < self.width:
            at *= 2
            if room[at] < size:
                at += 1
        room[at] -= size
        leaf = at - self.width
        at //= 2
        while at:
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
            at //= 2
        return leaf


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Container of each item; the items come sorted from large to small and fit a container."""
    tree = TournamentTree(max(1, len(sizes)), capacity)
    return [tree.first_fit(s) for s in sizes]


def pack_group(keys: np.ndarray, copies: np.ndarray, sizes: np.ndarray, group: int, capacity: int) -> dict[str, np.ndarray]:
    """All pieces of one group with their containers and positions."""
    whole = np.where(sizes > capacity, sizes // capacity, 0)
    rest = sizes - whole * capacity
    has_rest = (rest > 0) | (sizes == 0)
    item = np.concatenate([np.repeat(np.arange(len(keys)), whole), np.flatnonzero(has_rest)])
    piece = np.concatenate([np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole), whole[has_rest]]).astype(np.int64)
    size = np.concatenate([np.full(whole.sum(), capacity, np.int64), rest[has_rest]])
    order = np.lexsort((piece, copies[item], keys[item], -size))
    item, piece, size = item[order], piece[order], size[order]
    own = np.array(first_fit_decreasing(size.tolist(), capacity), np.int64)
    by_bin = np.argsort(own, kind="stable")
    own, item, piece, size = own[by_bin], item[by_bin], piece[by_bin], size[by_bin]
    bin_begin = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    spans = np.diff(np.append(bin_begin, len(own)))
    before = np.cumsum(size) - size
    return {
        "container": group * (1 << 32) + own,
        "position": (np.arange(len(own)) - np.repeat(bin_begin, spans)).astype(np.int32),
        "start": (before - np.repeat(before[bin_begin], spans)).astype(np.int32),
        "doc_id": keys[item],
        "copy": copies[item].astype(np.int32),
        "piece": piece.astype(np.int32),
        "piece_start": piece * capacity,
        "n_tokens": size.astype(np.int32),
    }


def pack(sizes: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, n_items: int | None = None) -> DataFrame:
    """(doc_id, n_tokens) to containers; see PACKED for the columns.

    One shuffle of (key, size) rows, and one of counted keys. ``n_items`` saves the count that sets the number of groups. A key with more
    than half a group of rows is spread over slices of it; there are at most 2 n / ``group_items`` such keys, which come to the driver and are sent.
    """
    ship(sizes.sparkSession)
    n_groups = max(1, math.ceil((sizes.count() if n_items is None else n_items) / group_items))
    rows = sizes.select(F.col("doc_id").cast("bigint"), F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).cast("bigint").alias("n_tokens")).where("doc_id IS NOT NULL")
    hot = rows.groupBy("doc_id").agg(F.ceil(F.count("*") * 2 / F.lit(group_items)).cast("bigint").alias("slices")).where("slices > 1").toArrow()
    if hot.num_rows:
        rows = rows.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(sizes.sparkSession.createDataFrame(hot)), "doc_id", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
        rows = rows.withColumn("slice", F.pmod(F.xxhash64("row"), F.col("slices"))).drop("row")
    else:
        rows = rows.withColumns({"slices": F.lit(1).cast("bigint"), "slice": F.lit(0).cast("bigint")})
    grouped = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", F.when(F.col("slice") > 0, F.col("slice")), F.lit(17)), F.lit(n_groups)).cast("bigint"))

    def run(group: tuple, table: pa.Table) -> pa.Table:
        keys, own, slice_, slices = (table.column(c).to_numpy() for c in ("doc_id", "n_tokens", "slice", "slices"))
        order = np.lexsort((own, slice_, keys))
        keys, own, slice_, slices = keys[order], own[order], slice_[order], slices[order]
        fresh = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (slice_[1:] != slice_[:-1])))
        copies = (np.arange(len(keys)) - np.repeat(fresh, np.diff(np.append(fresh, len(keys))))) * slices + slice_
        return pa.table(pack_group(keys, copies, own, group[0].as_py(), capacity))

    return grouped.groupBy("grp").applyInArrow(run, PACKED)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer_dir: str = TOKENIZER_DIR, name: str = TOKENIZER) -> DataFrame:
    """Containers of documents sized in tokens of a public tokenizer. The sizes are made once."""
    return pack(cut(token_counts(docs, tokenizer_dir=tokenizer_dir, name=name)), capacity)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(n_containers, n_pieces, n_tokens, filled) of a packing."""
    return packed.agg(F.countDistinct("container").alias("n_containers"), F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("n_tokens")).withColumn("filled", F.col("n_tokens") / (F.col("n_containers") * F.lit(float(capacity))))
