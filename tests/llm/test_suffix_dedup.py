import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwater.llm import passages as passages_module
from tarnwater.llm.suffix_dedup import factors, remove_repeats


@settings(max_examples=200, deadline=None)
@given(st.text("ab", max_size=40), st.integers(1, 9))
def test_factors(text, length):
    data = text.encode()
    positions = list(range(len(data)))

    def common(p, q):
        n = 0
        while n < length and p + n < len(data) and q + n < len(data) and data[p + n] == data[q + n]:
            n += 1
        return n

    earlier, later = factors(data, positions, length)
    assert earlier.tolist() == [max((common(p, q) for q in range(p)), default=0) for p in positions]
    assert later.tolist() == [max((common(p, q) for q in range(p + 1, len(data))), default=0) for p in positions]


def brute(rows, length, keep):
    """{row number: (n_bytes, n_removed, n_spans, kept)} by a table of all windows."""
    texts = [(t or "").encode() for _, t in rows]
    rank = [(i is not None, i or 0) for i, _ in rows]
    seen = {}
    for k, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            seen.setdefault(t[p : p + length], set()).add((rank[k], k if keep == "none" else t, p))
    out = []
    for k, t in enumerate(texts):
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            me = (rank[k], k if keep == "none" else t, p)
            others = seen[t[p : p + length]]
            if len(others) > 1 if keep == "none" else any((o[0], o[2]) < (me[0], me[2]) for o in others if o[0] != me[0] or o[1] == me[1]):
                gone[p : p + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((rows[k][0], len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n, letters="abcdefghij é\n": "".join(rng.choices(letters, k=n))
    passages = [text(n) for n in (15, 30, 60, 200)]
    out = []
    for _ in range(60):
        parts = [text(rng.randint(0, 50)) for _ in range(rng.randint(1, 3))]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        out.append("".join(parts))
    for _ in range(40):
        out.append(text(rng.randint(0, 9)) + passages[1] + text(rng.randint(0, 9)))
    base = text(150)
    for _ in range(15):
        at = rng.randrange(150)
        out.append(base[:at] + "#" + base[at + 1 :])
    out += [out[0], out[0], "a" * 300, "ab" * 100, None, "", passages[3]]
    rng.shuffle(out)
    return [(k * 3, t) for k, t in enumerate(out)]


@pytest.mark.parametrize("length,group,keep", [(20, 256, "none"), (20, 4, "none"), (25, 4, "first"), (40, 256, "first")])
def test_against_brute_force(spark, length, group, keep):
    rows = corpus(length + group)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS t", "2 AS start").repartition(5)
    got = remove_repeats(docs, length, keep, group=group).collect()
    want = brute(rows, length, keep)
    assert sorted([(r[0], r[1], r[2], r[3], bytes(r[4])) for r in got], key=str) == want
    assert 0 < sum(w[2] > 0 for w in want) < len(want)


def test_edges(spark):
    schema = "doc_id long, text string"
    assert remove_repeats(spark.createDataFrame([], schema), 10).count() == 0
    rows = [(1, "x" * 8 + "y" * 8), (1, "x" * 8 + "y" * 8), (None, "x" * 8 + "y" * 8), (2, None)]
    docs = spark.createDataFrame(rows, schema)
    assert sorted((r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeats(docs, 10, "none").collect()) == [(0, 0, 0)] + [(16, 16, 1)] * 3
    assert sorted((r.doc_id or 0, r.n_removed) for r in remove_repeats(docs, 10, "first").collect()) == [(0, 0), (1, 16), (1, 16), (2, 0)]
    # longer than a piece of the search for anchors
    text = "".join(random.Random(1).choices("abcdefgh", k=(1 << 20) + 5000))
    docs = spark.createDataFrame([(1, text), (2, text[(1 << 20) - 700 : (1 << 20) + 900])], schema)
    assert sorted((r.doc_id, r.n_removed, r.n_spans) for r in remove_repeats(docs, 400, "none").collect()) == [(1, 1600, 1), (2, 1600, 1)]


def brute_words(texts, words):
    """Words under runs of `words` words that another text of the list has, by a table of all windows."""
    split = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    seen = {}
    for k, w in enumerate(split):
        for p in range(len(w) - words + 1):
            seen.setdefault(tuple(w[p : p + words]), set()).add(k)
    out = []
    for w in split:
        under = [False] * len(w)
        for p in range(len(w) - words + 1):
            if len(seen[tuple(w[p : p + words])]) > 1:
                under[p : p + words] = [True] * words
        out.append(sum(under))
    return out


def test_passages_of_few_bytes_are_told(spark):
    rng = random.Random(7)
    text = lambda n: " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(n))
    passage = " ".join("".join(rng.choices("fgh", k=4)) for _ in range(51))
    short, own = " ".join(passage.split()[:50]), " ".join("".join(rng.choices("xyz", k=5)) for _ in range(60))
    assert len(passage) < 400
    rows = [f"{text(30)} {passage} {text(20)}", f"{text(5)}\t{passage.replace(' ', chr(10))}  {text(9)}", f"{text(9)} {short} {text(9)}", f"{own} {text(3)} {own}", text(70), text(70)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in remove_repeats(docs, 400, "none", words=51).collect()}
    assert [got[k].n_repeated_words for k in range(6)] == [51, 51, 0, 0, 0, 0] == brute_words(rows, 51)
    assert [got[k].n_removed for k in range(6)] == [0] * 6
    assert "n_repeated_words" not in remove_repeats(docs, 400, "none").columns


@pytest.mark.parametrize("words,piece", [(12, 64), (5, 1 << 18)])
def test_repeated_words_against_brute_force(spark, monkeypatch, words, piece):
    rng = random.Random(words)
    text = lambda n: "".join(rng.choice(["a", "b", "éß", "x" * rng.randint(60, 200), "c"]) + rng.choice([" ", "\n", " \t", "\u00a0 "]) for _ in range(n))
    passages = [text(n) for n in (4, 11, 12, 13, 30, 80)]
    rows = []
    for _ in range(80):
        parts = [text(rng.randint(0, 25)) for _ in range(3)]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randrange(4), rng.choice(passages)[rng.randint(0, 5) :])
        rows.append(rng.choice(["", "\n "]) + "".join(parts))
    base = passages[5].split()
    rows += [" ".join([*base[:at], "#", *base[at + 1 :]]) for at in rng.sample(range(len(base)), 15)]
    rows += [rows[0], rows[0], "a " * 30, "a " * 30, "a " * 4, "a " * 4, None, "", "  ", "q" * 3000]
    # pieces are cut in this process here, and in workers below as they are there
    monkeypatch.setattr(passages_module, "PIECE", piece)
    monkeypatch.setattr(passages_module, "WORDS", 40)
    data = "".join(r or "" for r in rows).encode()
    offsets = np.cumsum([0, *(len((r or "").encode()) for r in rows)])
    values, first = passages_module.word_hashes(np.frombuffer(data, np.uint8), offsets)
    split = [w for r in rows for w in (r or "").encode().split()]
    assert np.diff(first).tolist() == [len((r or "").encode().split()) for r in rows]
    assert len(set(values.tolist())) == len(set(split)) == len(set(zip(values.tolist(), split)))
    docs = spark.createDataFrame([(k % 90, t) for k, t in enumerate(rows)], "doc_id long, text string").repartition(4)
    got = remove_repeats(docs, 400, "none", words=words).join(docs.selectExpr("doc_id", "octet_length(coalesce(text, '')) AS n_bytes", "text"), ["doc_id", "n_bytes"])
    assert sorted((r.doc_id, r.text or "", r.n_repeated_words) for r in got.collect()) == sorted((k % 90, t or "", n) for k, (t, n) in enumerate(zip(rows, brute_words(rows, words))))
