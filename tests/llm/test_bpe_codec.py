import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tarnwater.llm.bpe_codec import Codec, encode_decode

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = ["", " ", "Don't STOP 's", "a<|endoftext|>b<|startoftext|>", "<|ENDOFTEXT|>", "İstanbul ΟΔΟΣ Σ", "été 日本語", "12 345x", "🙂🙂", "\x00\x01 a\u0085b", "x" * 5000, "ab" * 4000 + "!"]


@pytest.fixture(scope="module")
def both():
    return Codec(open(PATH, encoding="utf-8").read(), leaf=16, window=3), Tokenizer.from_file(PATH)


def same(both, strings):
    mine, library = both
    for s, (n, ids, decoded) in zip(strings, mine(strings)):
        want = library.encode(s, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)) and n == len(want)
        assert decoded == library.decode(want, skip_special_tokens=False)


def test_hard_cases(both):
    same(both, HARD)


def test_long_words_join_exactly(both):
    rng = random.Random(5)
    syllables = ["tion", "th", "e", "ing", "an", "er", "on", "re", "ha", "é", "ß", "st", "q", "z"]
    same(both, ["".join(rng.choices(syllables, k=rng.randint(10, 900))) for _ in range(120)])
    same(both, ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(10, 900))) for _ in range(60)])
    same(both, ["".join(rng.choices("!?-_*=/", k=rng.randint(10, 900))) for _ in range(60)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" '<|>sSEe"), st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"])), max_size=200), max_size=4))
def test_any_text(both, strings):
    same(both, strings)


def test_operator(spark):
    rows = [(i, s) for i, s in enumerate(HARD)] + [(5, None), (5, None), (None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids")
    library = Tokenizer.from_file(PATH)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, s in rows:
        ids = library.encode(s or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(encode_decode(docs, PATH, keep_texts=False).collect(), key=str) == sorted(want, key=str)
    assert encode_decode(docs, PATH).count() == len(rows)
    assert encode_decode(docs.limit(0), PATH).count() == 0


def test_another_sort_of_tokenizer_is_refused():
    with pytest.raises(ValueError):
        Codec(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())


def test_white_space_and_controls(both):
    same(both, ["a\x1cb\x1dc d\x1f", "a\x85b\xa0c\u2028d\u3000e", "\u180ea \ufeffb", "Ǆ ǅ ﬁ e\u0301 e \u0301", "DON'T don't'll '"])
