import random
import re

from lodestone.llm import near_duplicates as nd


def runs(text):
    w = re.findall(r"[a-z0-9_]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def brute(rows):
    rows = {i: b for i, b in rows if b and len(b) >= 200}
    sets = {i: runs(b) for i, b in rows.items()}
    out = set()
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 3:
                out.add((a, b))
    return out


def found(spark, rows):
    units = spark.createDataFrame([(i, b, "x") for i, b in rows], "id long, body string, rep string")
    links, members = nd.near_duplicate_classes(units)
    pairs = [tuple(r) for r in nd.near_duplicate_pairs(links, members).collect()]
    assert len(pairs) == len(set(pairs))
    return set(pairs), (links, members)


def corpus(seed=1, n=60):
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, k = [], 0
    for _ in range(n):
        base = [pick.choice(words) for _ in range(pick.randint(30, 160))]
        for _ in range(pick.randint(1, 4)):
            own = list(base)
            for _ in range(pick.randint(0, 9)):
                own[pick.randrange(len(own))] = pick.choice(words)
            k += 1
            rows.append((k, " ".join(own).replace("w1", "W1") + "  // " + "é" * 220))
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    assert found(spark, rows)[0] == brute(rows)


def test_copies_hot_values_and_short_texts(spark):
    common = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 2
    pick = random.Random(2)
    rows = [(i, common + " ".join(f"v{pick.randint(0, 10**6)}" for _ in range(60))) for i in range(1, 80)]
    rows += [(100 + i, rows[0][1]) for i in range(40)] + [(200, "short text"), (201, None), (202, ""), (203, "-" * 300), (204, "one two" + " " * 300), (5, rows[4][1])]
    got, (links, members) = found(spark, rows)
    assert got == brute(rows)
    groups = {r["id"]: (r["group_id"], r["n_links"]) for r in nd.group_labels(links, members).collect()}
    assert groups[1] == (1, 40) and groups[139] == (1, 40)


def test_groups_join_chains(spark):
    words = [f"t{i}" for i in range(150)]
    texts = [" ".join(words[s : s + 100]) + " " + "x" * 3 for s in range(0, 50, 12)]
    rows = list(enumerate(texts, 1))
    got, parts = found(spark, rows)
    assert got == brute(rows)
    groups = {r["id"]: r["group_id"] for r in nd.group_labels(*parts).collect()}
    assert len(set(groups.values())) == 1


def test_no_rows(spark):
    assert found(spark, [])[0] == set()


def headed(n, share, length=200, seed=4):
    """Texts that share a header and nothing else."""
    pick = random.Random(seed)
    header = " ".join(f"h{i}" for i in range(int(length * share)))
    return [(i, header + " " + " ".join(f"u{pick.randrange(10**9)}" for _ in range(length - int(length * share)))) for i in range(1, n + 1)]


def test_header_makes_no_pairs(spark):
    """Half of a text shared by all texts (similarity about 0.33), and two thirds (0.5)."""
    for share, length in ((0.5, 200), (0.66, 200), (0.4, 900)):
        rows = headed(1000, share, length)
        copy = rows[7][1].split(" ")
        copy[-3:] = ["x1", "x2", "x3"]
        units = spark.createDataFrame([*rows, (5000, " ".join(copy))], "id long, body string")
        lists = nd.value_lists(nd.sketches(units, *nd.hot_values(units)))
        pairs = {(r["rep_a"], r["rep_b"]) for r in nd.candidate_pairs(lists).collect()}
        assert (8, 5000) in pairs or (5000, 8) in pairs
        assert len(pairs) < 10 * len(rows)


def test_long_texts(spark):
    pick = random.Random(9)
    rows, k = [], 0
    for n in (300, 500, 900, 2500):
        for _ in range(6):
            base = [f"w{pick.randrange(5000)}" for _ in range(n)]
            for edits in (0, n // 40, n // 12):
                own = list(base[: n - pick.choice((0, n // 10))])
                for _ in range(edits):
                    own[pick.randrange(len(own))] = f"e{pick.randrange(10**6)}"
                k += 1
                rows.append((k, " ".join(own)))
    assert found(spark, rows)[0] == brute(rows)


def test_hot_lists_in_cells(spark, monkeypatch):
    monkeypatch.setattr(nd, "CELL", 7)
    rows = headed(60, 0.85, 120)
    assert found(spark, rows)[0] == brute(rows)


def test_headers_of_many_families_make_no_pairs(spark):
    """Half of a text shared by six texts each, in so many families that shared values number 137,200."""
    pick = random.Random(11)
    rows = []
    for family in range(1400):
        header = " ".join(f"f{family}h{i}" for i in range(100))
        rows += [(len(rows) + i + 1, header + " " + " ".join(f"u{pick.randrange(10**9)}" for _ in range(100))) for i in range(6)]
    copy = rows[7][1].split(" ")
    copy[-3:] = ["x1", "x2", "x3"]
    units = spark.createDataFrame([*rows, (20_000, " ".join(copy))], "id long, body string")
    pairs = {(r["rep_a"], r["rep_b"]) for r in nd.candidate_pairs(nd.value_lists(nd.sketches(units, *nd.hot_values(units)))).collect()}
    assert (8, 20_000) in pairs or (20_000, 8) in pairs
    assert len(pairs) < 100
