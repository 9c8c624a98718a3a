import os
import random
import re

import duckdb
import pyarrow as pa
import pytest

from tarnwater.llm.shingle_join import link, set_keys, sets_of


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))
    top = lambda i: i if root[i] == i else top(root[i])
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), doc), doc)
    return sorted((doc, len(sets[i]), least[top(i)]) for i, (doc, _) in enumerate(rows))


def corpus(seed=7):
    rng = random.Random(seed)
    pool = ["".join(rng.choices("abcdefgé", k=rng.randint(1, 6))) for _ in range(400)]
    words = lambda n: [rng.choice(pool) for _ in range(n)]
    texts, passage = [], words(30)
    for _ in range(40):
        base = words(rng.choice([2, 5, 30, 120, 200]))
        if rng.random() < 0.4:
            base += passage
        for _ in range(rng.choice([1, 1, 2, 5])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(pool)
            texts.append(rng.choice([" ", "\t", "  \n"]).join(copy))
    base = words(150)
    for _ in range(120):  # one large group, some of it too far from its centre
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
            copy[rng.randrange(len(copy))] = rng.choice(pool)
        texts.append(" ".join(copy))
    texts += [texts[3].upper(), texts[3]] + ["", None, "  \n", "One", "one", "É", "é", "one two", "one two three four", "x " * 3000]
    rng.shuffle(texts)
    return [(i * 2 + 1, t) for i, t in enumerate(texts)]


def test_sets():
    texts = [t or "" for _, t in corpus()]
    column = pa.array(["skipped"] + texts, pa.string()).slice(1)
    elements, start = sets_of(column, 4)
    keys = set_keys(elements, start)
    by_key, by_set, seen = {}, {}, {}
    for t, k, a, b in zip(texts, keys.to_pylist(), start[:-1], start[1:]):
        s = frozenset(shingles(t, 4))
        assert b - a == len(s) and len(set(elements[a:b].tolist())) == b - a
        assert by_key.setdefault(k, s) == s and by_set.setdefault(s, k) == k
        for e in elements[a:b].tolist():
            seen[e] = seen.get(e, 0) + 1
    want = {}
    for s in (shingles(t, 4) for t in texts):
        for e in s:
            want[e] = want.get(e, 0) + 1
    assert sorted(seen.values()) == sorted(want.values())


@pytest.mark.parametrize("size,percent,block", [(4, 85, 512), (2, 80, 16)])
def test_against_brute_force(spark, size, percent, block):
    rows = corpus(size)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS n").repartition(6)
    got = sorted(map(tuple, link(docs, size, percent, block=block).collect()))
    want = brute(rows, size, percent)
    assert got == want and len({w[2] for w in want}) < len(want) - 60


def test_edges(spark):
    schema = "doc_id long, text string"
    assert link(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, None), (2, "")]
    assert sorted(map(tuple, link(spark.createDataFrame(rows, schema)).collect()), key=str) == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 0, None), (2, 0, 2)], key=str)


def test_same_as_sql(spark):
    from tarnwater.llm.queries import ORACLE_SQL, QUERIES

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("tables are not here")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = sorted(con.execute(ORACLE_SQL["op6_shingle_join"]).fetchall())
    assert sorted(map(tuple, QUERIES["op6_shingle_join"](spark, data).collect())) == want


def test_strings_that_collide_modulo_powers_of_two(spark):
    thue_morse = [bin(i).count("1") % 2 for i in range(1024)]
    a, b = ("".join("ab"[x ^ k] for x in thue_morse) for k in (0, 1))
    rows = [(1, a), (2, b)]
    assert sorted(map(tuple, link(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == [(1, 1, 1), (2, 1, 2)]


def test_large_group_of_long_near_copies(spark):
    """Some copies are too far from the centre to link with it, but link with others."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.choice([5, 40, 60, 75])):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, link(docs, 5, 80, block=16).collect())) == brute(rows, 5, 80)


def test_products_in_steps(monkeypatch):
    import numpy as np

    from tarnwater.llm import shingle_join

    rng = np.random.default_rng(1)
    lists = [np.unique(rng.integers(0, 50, 20)) for _ in range(12)]
    values, owner = np.concatenate(lists), np.repeat(np.arange(12), [len(x) for x in lists])
    want = [[len(np.intersect1d(x, y)) for y in lists] for x in lists]
    for dense in (1 << 22, 40, 1):
        monkeypatch.setattr(shingle_join, "DENSE", dense)
        got = shingle_join.products(values, owner, np.arange(12), np.arange(12), 12)
        assert (got + np.diag([len(x) for x in lists]) * 0)[~np.eye(12, dtype=bool)].tolist() == np.array(want)[~np.eye(12, dtype=bool)].tolist()


def test_sketch_summed_in_two_steps(spark, monkeypatch):
    from tarnwater.llm import shingle_join

    monkeypatch.setattr(shingle_join, "SKETCH_GROUP", 1)
    rows = corpus(3)[:60]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, link(docs).collect())) == brute(rows, 4, 85)


@pytest.mark.parametrize("frequent,long", [(2, 2048), (20, 2048), (2, 12)])
def test_many_classes_with_frequent_elements(spark, monkeypatch, frequent, long):
    """Unlike short documents of frequent words, compared in blocks, by a join, or both."""
    from tarnwater.llm import shingle_join

    monkeypatch.setattr(shingle_join, "FREQUENT", frequent)
    monkeypatch.setattr(shingle_join, "LONG", long)
    rng = random.Random(5)
    rows = [(i, " ".join(rng.sample([f"w{k}" for k in range(40)], rng.randrange(8, 32)))) for i in range(400)]
    rows += [(1000 + i, t) for i, (_, t) in enumerate(corpus(9)[:120])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows, 1, 62)
    assert sorted(map(tuple, link(docs, 1, 62, block=32).collect())) == want
    assert 20 < len({w[2] for w in want}) < 500
