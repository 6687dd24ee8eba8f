import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import chunking


def holds(text, limit, overlap):
    parts = chunking.split_places(text, limit, overlap)
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    assert all(0 < b - a <= limit for a, b in parts) or text == ""
    assert all(c == b - overlap for (_, b), (c, _) in zip(parts, parts[1:]))
    assert "".join(text[a + (overlap if i else 0) : b] for i, (a, b) in enumerate(parts)) == text
    return parts


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet="ab {};\n\r\té́😀", max_size=900), st.sampled_from([(120, 20), (200, 0), (100, 50)]))
def test_any_text_comes_back(text, sizes):
    holds(text, *sizes)


@pytest.mark.parametrize("n", [4001, 4040, 4200, 7800, 7801, 200_000])
def test_without_natural_places(n):
    parts = holds("x" * n, 4000, 200)
    assert len(parts) == -(-(n - 200) // 3800)


def test_cuts_at_lines_and_blank_lines():
    text = "\n".join("    call(%d);" % i if i % 20 else "}\n\nfn f%d() {" % i for i in range(900))
    parts = holds(text, 4000, 200)
    assert all(text[b - 1] == "\n" for _, b in parts[:-1])


def test_line_end_pairs_and_marks_stay_whole():
    text = ("word\r\n" * 3000)[:15_000]
    assert not any(text[b - 1] == "\r" and text[b] == "\n" for _, b in holds(text, 4000, 200)[:-1])
    text = "é" * 4000
    assert all(text[b] != "́" for _, b in holds(text, 4000, 200)[:-1])


def test_table(spark):
    rows = [(1, "a" * 4001, "x"), (1, "a" * 4001, "x"), (2, "b" * 4000, "y"), (3, None, None), (4, "", "")]
    units = spark.createDataFrame(rows, "id long, body string, piece string")
    out = chunking.split_oversized(units).collect()
    assert sorted((r["id"], r["piece"], r["n_chars"] <= 4000) for r in out) == [(1, 0, True), (1, 1, True)]
    assert chunking.split_oversized(units.where("false")).count() == 0
    with pytest.raises(ValueError):
        chunking.split_places("x" * 500, 100, 99)


def chain_cost(text, ends, limit, overlap):
    place, n = chunking.place_penalties(text), len(text)
    even = (n - overlap) / -(-(n - overlap) // (limit - overlap))
    moves = [b - a for a, b in zip([overlap, *ends], ends)]
    return sum(place[e] + chunking.BEGIN_WEIGHT * place[e - overlap] for e in ends[:-1]) + sum(((m - even) / even) ** 2 for m in moves)


def test_no_chain_of_natural_places_is_better():
    pick = random.Random(4)
    limit, overlap = 300, 20
    for _ in range(40):
        text = "".join("    " * pick.randint(0, 2) + "ab" * pick.randint(1, 5) + pick.choice([";", "()", "{", ""]) + "\n" * pick.choice([1, 1, 1, 2]) for _ in range(90))
        n = len(text)
        place = chunking.place_penalties(text)
        places = [e for e in range(overlap + 1, n) if place[e] < chunking.ANY] + [n]
        even = (n - overlap) / -(-(n - overlap) // (limit - overlap))
        least = {}
        for e in places:
            own = 0 if e == n else place[e] + chunking.BEGIN_WEIGHT * place[e - overlap]
            ways = [((e - overlap - even) / even) ** 2] if e <= limit else []
            ways += [least[s] + ((e - s - even) / even) ** 2 for s in places if e - (limit - overlap) <= s < e and s in least]
            if ways:
                least[e] = own + min(ways)
        ends = [e for _, e in chunking.split_places(text, limit, overlap)]
        assert chain_cost(text, ends, limit, overlap) <= least[n] + 1e-9
