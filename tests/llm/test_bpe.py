import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZER_DIR}/{bpe.TOKENIZER}.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def ours(texts):
    ids, bounds = bpe.encoder().encode(texts)
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


CASES = ["", " ", "a", "don't we'll I'M 's 't", "a\x1cb \x85 x　y", "aaaa" * 500, "x" * 20_000, "<|endoftext|> ordinary", "\r\n\r\n  \t x  ", "été 中文 😀👩‍👩‍👧 ½²", "ab " * 3000, "'", " '", "\n's", "'rest 'veto 'llama"]


def test_cases(public):
    assert ours(CASES) == [public(t) for t in CASES]
    assert bpe.encoder().counts(CASES).tolist() == [len(public(t)) for t in CASES]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"])), max_size=6))
def test_any_text(public, texts):
    assert ours(texts) == [public(t) for t in texts]


def test_mixed_white_space_and_apostrophes(public):
    pick = random.Random(5)
    texts = ["".join(pick.choice(" '\n\tsStreélZ9_-") for _ in range(30)) for _ in range(400)]
    assert ours(texts) == [public(t) for t in texts]


def test_cache_that_overflows_changes_nothing(public, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    own = bpe.Encoder(f"{bpe.TOKENIZER_DIR}/{bpe.TOKENIZER}.json")
    for text in ["one two three", "four five six", "one two seven"]:
        assert own.encode([text])[0].tolist() == public(text)


def test_table(spark, public):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (3, ""), (None, "x")], "doc_id long, text string")
    rows = sorted((r["doc_id"] or 0, tuple(r["ids"])) for r in bpe.encode_column(docs).collect())
    assert rows == [(0, tuple(public("x"))), (1, tuple(public("a b"))), (2, ()), (3, ()), (3, ())]
    assert {(r["doc_id"], r["n_tokens"]) for r in bpe.token_counts(docs).collect()} == {(1, 2), (2, 0), (3, 0), (None, 1)}
    assert bpe.corpus_token_stats(bpe.encode_column(docs)).first().asDict() == {"n_docs": 5, "n_empty": 3, "n_tokens": 3, "longest": 2}
    assert bpe.encode_column(docs.where("false")).count() == 0


def thue_morse(n, a="a", b="b"):
    word = a
    while len(word) < n:
        word += "".join(b if c == a else a for c in word)
    return word


def test_words_that_collide_under_every_polynomial(public):
    first = thue_morse(2048)
    second = first.translate(str.maketrans("ab", "ba"))
    own = bpe.Encoder(f"{bpe.TOKENIZER_DIR}/{bpe.TOKENIZER}.json")
    for text in (first, second, f"{first} {second}", f"{second} {first}"):
        assert own.encode([text])[0].tolist() == public(text)


def test_words_with_one_key_are_told_apart(public, monkeypatch):
    """Whatever the keys are worth: with keys of two bits every word still gets its own ids."""
    keys = bpe.word_keys
    monkeypatch.setattr(bpe, "word_keys", lambda *a: keys(*a) & bpe.np.uint64(3))
    own = bpe.Encoder(f"{bpe.TOKENIZER_DIR}/{bpe.TOKENIZER}.json")
    pick = random.Random(8)
    for _ in range(20):
        text = " ".join("".join(pick.choice("ab") for _ in range(pick.choice((1, 2, 3, 70, 300)))) for _ in range(30))
        assert own.encode([text])[0].tolist() == public(text)
