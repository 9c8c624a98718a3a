import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tarnwater.llm.token_counts import Transducer, at_spaces, count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = ["", " ", "  ", "a  b", "a \n b", "\n\n", "don't 's ''s ('s \n's  's", "'re 'rest 'v 've've'll 'lx 'l", "x'", "'", "'r", "'l", "'r ", "\t'll", "a<|endoftext|>b <|endoftext|>",
        "\U0010ffff a\U0010ffff", "été 12²३ 日本語 　 x y  z", "a" * 3000, " " * 700 + "x", "'s's's", "1'd2'm", "...'t", "🙂🙂 'S 'T", "\x00 \x1c\x1d a\x85b᠎c"]


@pytest.fixture(scope="module")
def both():
    return Transducer(open(PATH, encoding="utf-8").read()), Tokenizer.from_file(PATH)


def test_hard_cases(both):
    mine, library = both
    assert mine(HARD).tolist() == [len(e.ids) for e in library.encode_batch(HARD, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'stmdrvel.19ab é"), st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"])), max_size=600), max_size=4))
def test_any_text(both, strings):
    mine, library = both
    assert mine(strings).tolist() == [len(e.ids) for e in library.encode_batch(strings, add_special_tokens=False)]


def test_cut_texts(both):
    mine, library = both
    text = "".join(HARD) * 3
    assert "".join(at_spaces(text, 9)) == text
    assert mine(list(at_spaces(text, 9))).sum() - mine(list(at_spaces(text, 10**9)))[0] == 0


def test_operator(spark):
    rows = [(i, s, 1) for i, s in enumerate(HARD)] + [(7, None, 2), (7, None, 2), (None, "x y", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    library = Tokenizer.from_file(PATH)
    got = sorted(count_tokens(docs, PATH, limit=5).collect(), key=str)
    want = [(i, len((s or "").encode()), len(library.encode(s or "", add_special_tokens=False).ids)) for i, s, _ in rows]
    assert got == sorted([(*w, w[2] > 5) for w in want], key=str)
    assert count_tokens(docs.limit(0), PATH).count() == 0


def test_strings_that_collide_modulo_powers_of_two(both):
    mine, library = both
    thue_morse = [bin(i).count("1") % 2 for i in range(1024)]
    strings = ["".join("ab"[x ^ k] for x in thue_morse) for k in (0, 1)]
    want = [len(library.encode(s, add_special_tokens=False).ids) for s in strings]
    assert mine(strings).tolist() == want and mine(strings[::-1]).tolist() == want[::-1]


def test_equal_hashes_are_told_apart(monkeypatch, both):
    """Even if all pretokens of a length had one hash, counts would be right."""
    from tarnwater.llm import token_counts

    monkeypatch.setattr(token_counts, "span_hashes", lambda prefix, a, b: (b - a).astype("uint64"))
    mine, library = Transducer(open(PATH, encoding="utf-8").read()), both[1]
    strings = ["the cat xqz abc zzz", "dog qqq the", *HARD]
    for _ in range(2):
        assert mine(strings).tolist() == [len(e.ids) for e in library.encode_batch(strings, add_special_tokens=False)]


def test_another_sort_of_tokenizer_is_refused():
    with pytest.raises(ValueError):
        Transducer(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
