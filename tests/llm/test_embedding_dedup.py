import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwater.llm.components import components
from tarnwater.llm.embedding_dedup import forest, link, plan


def brute(rows, threshold):
    """(vec_id, n_links, component_id) of (vec_id, vector, label)."""
    n, root = len(rows), list(range(len(rows)))
    links = [0] * n
    top = lambda i: i if root[i] == i else top(root[i])
    ok = [v is not None and lab is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(np.float32(rows[k][1]), np.float64) for k in (i, j))
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    root[top(i)] = top(j)
    least = {}
    for i in range(n):
        least[top(i)] = min(least.get(top(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], links[i], least[top(i)], rows[i][0] == least[top(i)]) for i in range(n))


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows, i = [], 0
    for label in (0, 1, 2):
        for _ in range(25):
            centre = rng.standard_normal(16)
            for _ in range(int(rng.integers(1, 9))):
                rows.append((i, [float(x) for x in centre + 0.27 * rng.standard_normal(16) * (rng.random() < 0.8)], label))
                i += 1
    rows += [(i + k, rows[5][1], 0) for k in range(30)] + [(i + 40, rows[5][1], 1), (i + 41, None, 1), (i + 42, [0.0] * 16, 1), (i + 43, [1.0, None] * 8, 1), (i + 44, [float("nan")] * 16, 1), (i + 45, [float("inf")] * 16, 1), (i + 46, rows[5][1], None), (i + 47, [1.0, 2.0], 1), (i + 48, [2.0, 4.0], 1), (i + 49, [], 1)]
    random.Random(2).shuffle(rows)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS rep", "2 AS key").repartition(3)
    want = brute(rows, 0.93)
    assert sum(w[1] > 0 for w in want) > 60
    for args in ({"recall": 1 - 1e-9}, {"recall": 1 - 1e-9, "block_size": 5}):
        assert sorted(map(tuple, link(table, **args).collect())) == want
    assert link(table.limit(0)).count() == 0
    twice = link(spark.createDataFrame([(1, [1.0, 0.0], 1)] * 2, table.schema.names[:3] and "vec_id long, embedding array<float>, label int")).collect()
    assert [tuple(r) for r in twice] == [(1, 1, 1, True)] * 2


def test_recall_at_the_threshold():
    for n in (1, 100, 10_000, 10**8):
        bits, tables = plan(n, 0.93)
        assert 1 - (1 - (1 - np.arccos(0.93) / np.pi) ** bits) ** tables >= 0.998


def test_ids_that_repeat_or_are_null(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (None, [0.0, -1.0], 1), (None, [0.5, 0.01], 1), (7, [0.5, -0.0], 1)]
    got = link(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    want = [(1, 2, 1, True), (1, 0, 1, True), (None, 0, None, True), (None, 2, 1, False), (7, 2, 1, False)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_recall_as_measured(spark):
    rng = np.random.default_rng(6)
    a, b = rng.standard_normal((2, 2000, 48))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.9301 * a + np.sqrt(1 - 0.9301**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    rows = [(i + 2000 * k, [float(x) for x in v[i]], 1) for k, v in enumerate((a, b)) for i in range(2000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    for args in ({}, {"bucket": 48}):
        found = {r.vec_id: r for r in link(table, **args).collect()}
        assert sum(found[2000 + i].component_id == i for i in range(2000)) >= 0.99 * 2000
        assert all(r.n_links <= 1 for r in found.values())


edges = st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), max_size=25)


def reached(pairs):
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


@settings(max_examples=100, deadline=None)
@given(edges)
def test_forest(pairs):
    want = reached(pairs)
    i, j = np.array(pairs, int).reshape(-1, 2).T
    got = forest(15, i, j)
    assert all(got[x] == want.get(x, x) for x in range(15))


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(60)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7)]
    pairs = [(1000 - a, 1000 - b) if rng.random() < 0.5 and a < 200 else (a, b) for a, b in pairs]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = reached([p for p in pairs if p[0] != p[1]])
    assert got == want
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
