"""Splitting oversized texts at natural boundaries by dynamic programming.

A text of n characters becomes pieces [s_i, e_i) of at most ``limit`` characters with
s_0 = 0, s_{i+1} = e_i - overlap and a last e of n: the pieces after their overlap, joined,
give the text back exactly. Among all chains of boundary positions (ends of lines, statements
and words) the one with the least sum of cut penalties and size imbalance is taken; of other
places, for texts without natural ones, the cheapest of each ``GRAIN`` characters. The penalty of a cut counts both places it
makes, the end of one piece and the begin of the next, which lies ``overlap`` before it.

Sizes are in Unicode code points. Null texts and texts within the limit are not split. A line
end pair (CR LF) and a base character with its combining marks are only cut where no other
place is in reach; a text without any natural place is cut evenly.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.session import ship

LIMIT = 4000
OVERLAP = 200
GRAIN = 40

# Penalties of places, from the most natural one on. Size imbalance costs at most about 1 a piece.
BLANK_LINE, SHALLOW_LINE, LINE, STATEMENT, WORD, ANY, NEVER = 0.0, 0.3, 1.0, 3.0, 5.0, 12.0, 40.0
BEGIN_WEIGHT = 0.5


def place_penalties(text: str) -> np.ndarray:
    """Penalty of cutting before each position 0..n."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    cost = np.full(n + 1, ANY)
    before = points
    after = np.append(points[1:], 0)  # after[i] follows the place i + 1, that lies behind before[i]
    white = (before == 32) | (before == 9)
    cost[1:][white & ~((after == 32) | (after == 9))] = WORD
    cost[1:][np.isin(before, [ord(c) for c in ",;)]}>"])] = WORD
    cost[1:][np.isin(before, [ord(c) for c in ";}"])] = STATEMENT
    ends = np.flatnonzero(before == 10)
    if len(ends):
        begins = ends + 1
        cost[begins] = LINE
        # a line's indent: its first character that is neither blank nor tab
        solid = np.flatnonzero((points != 32) & (points != 9))
        at = np.searchsorted(solid, begins)
        there = at < len(solid)
        first = np.where(there, solid[np.minimum(at, len(solid) - 1)] if len(solid) else 0, n)
        indent = first - begins
        head = np.where(first < n, points[np.minimum(first, n - 1)], 10)
        blank = (head == 10) | (head == 13)
        closes = np.isin(head, [ord(c) for c in ")]}"])
        shallow = np.median(indent[~blank]) if (~blank).any() else 0
        cost[begins[~blank & ~closes & (indent <= shallow)]] = SHALLOW_LINE
        previous_blank = np.append(False, blank[:-1])
        cost[begins[previous_blank & ~blank]] = BLANK_LINE
    pair = np.flatnonzero((before == 13) & (after == 10)) + 1
    cost[pair] = NEVER
    if n and points.max() > 0x2FF:
        joined = [i for i in np.flatnonzero(points > 0x2FF).tolist() if points[i] == 0x200D or unicodedata.combining(text[i]) or 0xFE00 <= points[i] <= 0xFE0F]
        cost[joined] = NEVER
    cost[0] = cost[n] = 0.0
    return cost


def split_places(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """[begin, end) of each piece."""
    n = len(text)
    if not 0 <= overlap < limit - GRAIN:
        raise ValueError("overlap must be well below limit")
    if n <= limit:
        return [(0, n)]
    place = place_penalties(text)
    back = np.zeros(n + 1)
    back[overlap:] = place[: n + 1 - overlap]
    cost = place + BEGIN_WEIGHT * back
    cost[: overlap + 1] = np.inf  # a cut there would not move on
    natural = np.flatnonzero((place[:n] < ANY) & np.isfinite(cost[:n]))
    # the best place of each grain, the later one of equals
    grains = -(-n // GRAIN)
    padded = np.full(grains * GRAIN, np.inf)
    padded[: n] = cost[:n]
    rows = padded.reshape(grains, GRAIN)[:, ::-1]
    best = GRAIN - 1 - rows.argmin(axis=1)
    ends = np.arange(grains) * GRAIN + best
    ends = ends[np.isfinite(padded[ends])]
    # and the places that give the fewest pieces
    ends = np.append(np.union1d(np.union1d(ends, natural), np.arange(limit, n, limit - overlap)), n)
    own = np.append(cost[ends[:-1]], 0.0)
    step = limit - overlap
    pieces = -(-(n - overlap) // step)
    even = (n - overlap) / pieces
    firsts = np.searchsorted(ends, ends - step).tolist()
    least = np.where(ends <= limit, own + ((ends - overlap - even) / even) ** 2, np.inf)
    came = np.full(len(ends), -1)
    share = ends / even
    for j, lo in enumerate(firsts):
        if lo < j:
            off = (share[j] - 1.0) - share[lo:j]
            off *= off
            off += least[lo:j]
            k = int(off.argmin())
            if off[k] + own[j] < least[j]:
                least[j], came[j] = off[k] + own[j], lo + k
    chain = [len(ends) - 1]
    while came[chain[-1]] >= 0:
        chain.append(int(came[chain[-1]]))
    cuts = ends[chain[::-1]].tolist()
    return [(0 if i == 0 else cuts[i - 1] - overlap, e) for i, e in enumerate(cuts)]


def split_oversized(units: DataFrame, key: str = "id", text: str = "body", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece, begin, n_chars, text) for every distinct row with more than ``limit`` characters.

    The size filter runs before any Python; only texts to be split reach it. Pieces of rows
    repeated as a whole come once; for that the oversized texts, and no others, are shuffled.
    """
    ship(units.sparkSession)
    long = units.select(F.col(key), F.col(text)).where(F.length(text) > limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owners, numbers, begins, sizes, texts = batch.column(0), [], [], [], [], []
            for row, value in enumerate(batch.column(1).to_pylist()):
                for number, (a, b) in enumerate(split_places(value, limit, overlap)):
                    owners.append(row)
                    numbers.append(number)
                    begins.append(a)
                    sizes.append(b - a)
                    texts.append(value[a:b])
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(owners, pa.int64())), pa.array(numbers, pa.int32()), pa.array(begins, pa.int64()), pa.array(sizes, pa.int32()), pa.array(texts, pa.string())], names=[key, "piece", "begin", "n_chars", "text"])

    schema = T.StructType([T.StructField(key, units.schema[key].dataType), T.StructField("piece", T.IntegerType()), T.StructField("begin", T.LongType()), T.StructField("n_chars", T.IntegerType()), T.StructField("text", T.StringType())])
    return long.distinct().mapInArrow(run, schema)
