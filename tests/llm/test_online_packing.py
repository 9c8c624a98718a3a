import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tarnwater.llm import online_packing
from tarnwater.llm.online_packing import Windows, ids_of, pack_online, stretches

PATH = public_tokenizers.path("word_bpe_49k.json")


def held(rows, documents, capacity):
    """Every id of every document (a list of lists) is in one piece; sequences have no gap and no padding."""
    inside = defaultdict(list)
    for doc, start, length, crc, total, sequence, offset in rows:
        inside[sequence].append((offset, length))
    for parts in inside.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)
    assert sum(sum(n for _, n in parts) < capacity for parts in inside.values()) <= capacity.bit_length()
    want = sorted((zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids)) for ids in documents)
    by = defaultdict(list)
    for doc, start, length, crc, total, sequence, offset in rows:
        by[doc].append((start, length, crc, total))
    return by, want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(1, 4))
def test_windows(lengths, most):
    space = Windows(0, 16, most)
    docs = [np.arange(n, dtype="<u4") + 100 * k for k, n in enumerate(lengths)]
    done = []
    for k, ids in enumerate(docs):
        done += space.place(k, 0, len(ids), ids.tobytes())
        assert len(space.open) <= most
    done += space.finish()
    rows = [(d, s, len(i) // 4, zlib.crc32(i), t, w, o) for d, s, t, i, w, o in done]
    by, _ = held(rows, docs, 16)
    assert len(by) == len(docs)
    for k, ids in enumerate(docs):
        at = 0
        for start, length, crc, total in sorted(by[k]):
            assert start == at and total == len(ids)
            assert crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)


def test_ids_are_those_of_the_library():
    library = Tokenizer.from_file(PATH)
    rnd = random.Random(2)
    some = ["Hello", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\u2003", "İ", "Σ", "ΑΣ", "ς", "é", "e\u0301", "\u0301", "<|endoftext|>", "<|", "|>", "'s", "'LL", "12", "½", "日本", "🙂", "ﬁ", "_", "-", "\x00", "ß", "ǅ", "x" * 600]
    coded = ids_of(open(PATH, encoding="utf-8").read())
    for k in range(3000):
        text = "".join(rnd.choices(some, k=rnd.randint(0, 12)))
        assert coded(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)
    plain = [chr(c) for c in range(0x250) if chr(c) != "İ"]
    for k in range(2000):
        text = "".join(rnd.choices(plain, k=12))
        assert coded(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)
    text = " ".join(rnd.choices(some, k=400))
    assert b"".join(coded(x) for x in stretches(text, 50)) == coded(text) and "".join(stretches(text, 50)) == text


def test_best_fit():
    space = Windows(0, 16, 3)
    for k, n in enumerate((12, 9, 5)):  # 12 and 9 + 5
        space.place(k, 0, n, bytes(4 * n))
    assert sorted(w[0] for w in space.open) == [12, 14]
    space.place(3, 0, 2, bytes(8))  # the fullest that holds it
    assert sorted(w[0] for w in space.open) == [12]


@pytest.mark.parametrize("merged", [64, 2])
def test_pack_documents(spark, monkeypatch, merged):
    monkeypatch.setattr(online_packing, "MERGED", merged)
    texts = ["", None, "Hello World", "a b c " * 300, "x" * 5000, "naïve <|endoftext|> word's", "one two"] * 5 + ["tail word " * 4000, "\x1c odd space"]
    rows = [(k if k % 7 else None, t, "x", "y") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, `group` string").repartition(5)
    library = Tokenizer.from_file(PATH)
    coded = [library.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    got = [tuple(r) for r in pack_online(docs, PATH, capacity=256, windows=2).collect()]
    by, _ = held(got, coded, 256)
    for k, ids in enumerate(coded):
        if k % 7 == 0:
            continue
        at = 0
        for start, length, crc, total in sorted(by[k]):
            assert start == at and total == len(ids)
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    assert sum(p[1] for p in by[None]) == sum(len(ids) for k, ids in enumerate(coded) if k % 7 == 0)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    got = pack_online(docs, PATH)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() == 0


def test_repeated_rows_and_text_ids(spark):
    docs = spark.createDataFrame([("k", "same text")] * 300, "doc_id string, text string")
    got = pack_online(docs, PATH, capacity=64).collect()
    assert sum(r.length for r in got) == 300 * 3 and len({r.doc_id for r in got}) == 1
    assert {r.doc_tokens for r in got} == {3}
