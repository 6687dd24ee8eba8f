"""How well a name matches a query."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import ascii_lower

BOOST_OVER, MAX_PREFIX, SCALE = 0.7, 4, 0.1


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    mine = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    theirs = [c for c, t in zip(b, taken) if t]
    swapped = sum(x != y for x, y in zip(mine, theirs)) // 2
    m = len(mine)
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler_text(a: str, b: str) -> float:
    """Jaro similarity, raised by a common prefix of up to four characters where it exceeds 0.7."""
    score = jaro(a, b)
    if score <= BOOST_OVER:
        return score
    prefix = 0
    for x, y in zip(a[:MAX_PREFIX], b[:MAX_PREFIX]):
        if x != y:
            break
        prefix += 1
    return min(1.0, score + SCALE * prefix * (1 - score))


@F.pandas_udf(T.DoubleType())
def jaro_winkler(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    known: dict[tuple[str, str], float] = {}
    for left, right in pairs:
        out = []
        for a, b in zip(left, right):
            if a is None or b is None:
                out.append(None)
                continue
            if (a, b) not in known:
                if len(known) > 100_000:
                    known.clear()
                known[(a, b)] = jaro_winkler_text(a, b)
            out.append(known[(a, b)])
        yield pd.Series(out, dtype="float64")


def name_match_score(query: Column, name: Column) -> Column:
    """1.0 equal, 0.9 prefix, 0.7 contained, 0.5 any word of the query contained, else 0.4 of the similarity to its first word."""
    q, n = ascii_lower(query), ascii_lower(name)
    words = F.filter(F.split(q, r"\s+"), lambda w: w != "")
    exact = F.when(n == q, 1.0).when(n.startswith(q), 0.9).when(n.contains(q), 0.7).when(F.exists(words, lambda w: n.contains(w)), 0.5)
    return F.coalesce(exact, F.lit(0.4) * jaro_winkler(F.coalesce(F.get(words, F.lit(0)), F.lit("")), n))
