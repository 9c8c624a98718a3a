import math
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwater.llm import lexical_search
from tarnwater.llm.lexical_search import Trees, counted, rank_key, search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def plain(docs, items, k=20):
    """Every document scored for every item."""
    bags = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    count, length = sum(n > 0 for *_, n in bags), sum(n for *_, n in bags)
    held = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        scored = []
        for d, bag, n in bags:
            m = 75 + (25 * n * count // length if length else 0)
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * held[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m)) for t in terms(text) if t in bag)
            if s > 0:
                scored.append((-s, rank_key(d), d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aBZ09 _-\x00\x7fé ß.", max_size=60), st.integers(1, 9))
def test_terms(text, most):
    assert counted(text.encode(), most) == Counter(t.encode() for t in terms(text))


def test_bounded_search_finds_what_scoring_all_finds():
    rng = np.random.default_rng(5)
    for size in (1, 15, 17, 300):
        ids = rng.permutation(size).tolist()
        n = size * 6
        cells = np.unique(np.stack([rng.integers(0, 12, n), rng.integers(0, size, n)], 1), axis=0)
        tf, m = rng.integers(1, 4, len(cells)), rng.integers(75, 130, size)
        trees = Trees(cells[:, 0].astype(np.int32), cells[:, 1], tf, ids, m)
        query, weights = np.array([1, 4, 5, 99], np.int32), np.array([700, 20, 1, 9])
        score = np.zeros(size, np.int64)
        for (t, d), f in zip(cells, tf):
            if t in query:
                score[d] += weights[list(query).index(t)] * (10**9 * f // (1000 * f + 12 * m[d]))
        want = sorted(((int(s), (True, i)) for s, i in zip(score, ids) if s > 0), key=lambda f: (-f[0], f[1]))[:20]
        assert trees.search(query, weights, [], 20, 1) == want


def test_search(spark, monkeypatch):
    rnd = random.Random(3)
    words = ["alpha", "Beta", "GAMMA", "delta", "été", "x1", "zeta", "eta"]
    docs = [(i * 7 % 101, " ".join(rnd.choices(words, k=rnd.randint(0, 30)))) for i in range(100)]
    docs += [(200 + i, "same text alpha beta") for i in range(60)] + [(None, "alpha null"), (500, None), (501, ""), (502, "!!!"), (503, "long alpha " * 3000)]
    items = [(1, "alpha beta beta"), (2, "gamma, ZETA; x1"), (3, None), (4, ""), (5, "nowhere"), (6, "same text"), (None, "eta"), (1, "alpha beta beta"), (7, "ÉTÉ été")]
    d = spark.createDataFrame([(a, b, 1, "k") for a, b in docs], "doc_id long, text string, score int, ids string").repartition(7)
    q = spark.createDataFrame([(a, b, 3) for a, b in items], "item_id long, text string, rank int")
    want = plain(docs, list(dict.fromkeys(items)))
    assert sorted((tuple(r) for r in search(d, q).collect()), key=str) == want
    monkeypatch.setattr(lexical_search, "BLOCK", 4)  # queries in several blocks, small ranges, no probes
    monkeypatch.setattr(lexical_search, "RANGE", 16)
    monkeypatch.setattr(lexical_search, "PROBE", 2)
    assert sorted((tuple(r) for r in search(d, q).collect()), key=str) == want


def test_empty_tables_and_text_ids(spark):
    d, q = spark.createDataFrame([], "doc_id string, text string"), spark.createDataFrame([("a", "b")], "item_id string, text string")
    assert search(d, q).count() == 0
    full = spark.createDataFrame([("d2", "b c"), ("d1", "b c")], "doc_id string, text string")
    assert search(full, q.limit(0)).count() == 0
    assert [(r.doc_id, r["rank"]) for r in search(full, q).orderBy("rank").collect()] == [("d1", 1), ("d2", 2)]
    assert search(full, q).schema["rank"].dataType.simpleString() == "int"
