import os
import random
import re

import numpy as np
import pytest

from lodestone.llm import reading_level as rl

EASY = "the cat sat on a mat and saw the big dog run to the red car".split()
HARD = "notwithstanding idiosyncratic canonicalization presupposes multidimensional reconciliation undeniably corroborates architectural interdependence".split()


def text(pick, grade):
    out = []
    for _ in range(12):
        words = [pick.choice(HARD if pick.random() < (grade - 1) / 5 else EASY) for _ in range(4 + 4 * grade)]
        out.append(" ".join(words).capitalize() + ".")
    return " ".join(out)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, doc_kind string, grade string")


def test_held_out_grades(spark):
    pick = random.Random(4)
    grades = {i: 1 + i % 5 for i in range(300)}
    rows = [(i, text(pick, g), "en" if i % 3 else "EN-us", "readme", "x") for i, g in grades.items()]
    labels = spark.createDataFrame([(i, "a", g) for i, g in grades.items() if i < 150] + [(1, "b", None)], "doc_id long, rater string, grade int")
    got = {r["doc_id"]: r["grade"] for r in rl.reading_levels(docs(spark, rows), labels).collect()}
    held = [i for i in grades if i >= 150]
    assert np.mean([abs(got[i] - grades[i]) for i in held]) < 0.6
    assert np.mean([(got[i] >= 3.5) == (grades[i] >= 4) for i in held]) > 0.9


@pytest.mark.parametrize("head", [1 << 16, 3, 0])
def test_coverage_rank_against_counting(spark, monkeypatch, head):
    monkeypatch.setattr(rl, "HEAD_WORDS", head)
    pick = random.Random(7)
    vocabulary = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)]
    weights = [1 / (i + 1) for i in range(100)]
    texts = {i: " ".join(pick.choices(vocabulary, weights, k=pick.randint(1, 60))) + "." for i in range(80)}
    parts = rl.features(docs(spark, [(i, t, "en", None, None) for i, t in texts.items()]))
    got = {r["doc_id"]: r["coverage_rank"] for r in rl.coverage_ranks(parts, rl.word_ranks(parts), 0.5).collect()}
    counts = {}
    for t in texts.values():
        for w in re.findall("[a-z]+", t):
            counts[w] = counts.get(w, 0) + 1
    rank = {w: sum(c >= n for c in counts.values()) for w, n in counts.items()}
    for i, t in texts.items():
        own = sorted(rank[w] for w in re.findall("[a-z]+", t))
        assert got[i] == own[-(-len(own) // 2) - 1]


def test_code_is_left_out():
    prose = "One two three four. Five six seven eight nine."
    code = "# Title of it\n\n```py\nmore words in code here.\n```\n\n    indented code words\nTraceback (most recent call last):\n  File \"a.py\", line 3, in f\nWidgetError: it broke\n\n" + prose.replace("Five", "Five `inline code words` ") + "\n~~~\nnever closed words"
    a, b = (rl.text_features([t]) for t in (prose, code))
    assert a[0][0] == b[0][0] == 9 and a[1][0] == b[1][0] == 2 and sorted(a[4]) == sorted(b[4])


def test_batches_equal_single_texts():
    texts = ["", "One two three.", "\n", "# only a title", "é ü word's\r\n\r\nnext one here now", "```\nopen", "a" * 5000]
    together = rl.text_features(texts)
    for i, t in enumerate(texts):
        alone = rl.text_features([t])
        for k in range(4):
            assert np.array_equal(together[k][i], alone[k][0], equal_nan=True)
        assert together[4][together[6][i] : together[6][i + 1]].tolist() == alone[4].tolist()


def test_odd_rows(spark):
    rows = [(1, None, "en", "readme", None), (2, "", "en", "readme", None), (3, " \n ", "en", "readme", None), (4, "One two three four.", "de", "readme", None), (5, "One two three four.", None, "readme", None), (6, "One two three four.", "en", "codefile", None), (7, "```\nx\n```", "en", "issue", None), (8, "One two three four five.", "en_GB", None, None), (8, "One two three four five.", "en_GB", None, None)]
    none = spark.createDataFrame([], "doc_id long, rater string, grade int")
    got = {r["doc_id"]: r["grade"] for r in rl.reading_levels(docs(spark, rows), none).collect()}
    assert got == {7: None, 8: None}
    assert rl.reading_levels(docs(spark, []), none).count() == 0


def test_held_out_grades(spark):
    """Grades of labelled documents that took no part in a fit, in five folds: F1 of the grades 4 and 5."""
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("test tables are not here")
    labels = spark.read.parquet(f"{folder}/reading_labels.parquet")
    rows = rl.reading_levels(spark.read.parquet(f"{folder}/documents.parquet"), labels).toPandas()
    mean = labels.where("grade IS NOT NULL").toPandas().groupby("doc_id").grade.mean()
    rows = rows[rows.doc_id.isin(mean.index)].dropna(subset=["coverage_rank", "log_sentence", "word_length"])
    x = np.column_stack([np.ones(len(rows)), np.log1p(rows.coverage_rank), rows.log_sentence, rows.word_length])
    y, fold, found = mean[rows.doc_id].to_numpy(), np.arange(len(rows)) % 5, np.zeros(len(rows))
    for f in range(5):
        k = np.linalg.lstsq(x[fold != f], y[fold != f], rcond=None)[0]
        found[fold == f] = x[fold == f] @ k
    both = ((found >= 3.5) & (y >= 3.5)).sum()
    assert 2 * both / ((found >= 3.5).sum() + (y >= 3.5).sum()) >= 0.85
