"""Ids by pieces equal the ids of whole texts."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docweave.llm import tokens

WHOLE = Tokenizer.from_file(tokens.VOCABULARY)


def whole(texts):
    return [WHOLE.encode(t or "", add_special_tokens=False).ids for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\x0b\x1c\x85\xa0#'se\u0301\u0300\u03a3A\u00e9<|>endoftext12.,"),
                                  st.characters(codec="utf-8")), max_size=60))
def test_pieces_equal_whole(text):
    texts = [text, "", None, text[::-1], f"A{text}. a{text},", text + "\n" + text]
    assert [x.tolist() for x in tokens.encoded(pa.array(texts))] == whole(texts)


def test_cache_starts_anew_and_long_texts(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 50)
    monkeypatch.setattr(tokens, "STRETCH", 500)
    monkeypatch.setattr(tokens, "STRETCH_TEXTS", 3)
    monkeypatch.setattr(tokens, "LONG", 2000)
    tokens.encoder.cache_clear()
    rng = np.random.default_rng(0)
    for _ in range(40):
        texts = [" ".join(f"Word{chr(97 + i % 26) * (i // 26)}{rng.choice(['', '.', ',', '..', '<|endoftext|>'])}"
                          for i in rng.integers(0, 200, int(rng.integers(0, 90))).tolist()) for _ in range(5)]
        assert [x.tolist() for x in tokens.encoded(pa.array(texts))] == whole(texts)
        assert tokens.encoder(tokens.VOCABULARY).kept < 600
    text = "Long  text, of. words\n" * 500 + "x" * 3000 + "\u00e9"
    assert [x.tolist() for x in tokens.encoded(pa.array([text, "a", text]))] == whole([text, "a", text])
    tokens.encoder.cache_clear()


def test_sliced_column():
    column = pa.array(["a b", None, "c. d", "e"]).slice(1, 3)
    assert [x.tolist() for x in tokens.encoded(column)] == whole([None, "c. d", "e"])


def test_hash_table():
    table = tokens.HashTable(64)
    rng = np.random.default_rng(1)
    a = rng.integers(0, 8, 40).astype(np.uint64)  # many share a slot
    b = np.arange(40).astype(np.uint64)
    table.add(a[:20], b[:20], np.arange(20))
    table.add(a[20:], b[20:], np.arange(20, 40))
    assert table.find(a, b).tolist() == list(range(40))
    assert table.find(a, b + np.uint64(100)).tolist() == [-1] * 40


def test_pieces_that_collide_in_polynomial_hashes():
    """Thue-Morse words and their complements: equal polynomial hashes modulo 2^64, whatever the base."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
        other = word.translate(str.maketrans("ab", "ba"))
        texts = [word, other, f"x {other} {word}"]
        assert [x.tolist() for x in tokens.encoded(pa.array(texts))] == whole(texts), len(word)


def test_keys_are_the_pieces():
    rng = np.random.default_rng(2)
    pieces = {bytes(rng.choice([0, 1, 97, 98, 255], int(n)).astype(np.uint8)) for n in rng.integers(1, 17, 3000)}
    pieces = sorted(pieces)
    data = np.frombuffer(b" ".join([b"", *pieces, b" " * tokens.SHORT]), np.uint8).copy()
    length = np.array([len(p) for p in pieces])
    begin = 1 + np.cumsum(length + 1) - (length + 1)
    a, b = tokens.piece_keys(data, begin, length)
    assert len(set(zip(a.tolist(), b.tolist(), strict=True))) == len(pieces)
