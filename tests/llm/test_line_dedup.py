import random

from tarnwater.llm.line_dedup import drop_repeated_lines


def brute(rows, least):
    """{(id, text): kept text}: every pair of equal runs of at least `least` characters, the later one deleted."""
    docs = sorted({(i, t) for i, t in rows if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0))
    split = [[(p, s) for p, s in enumerate(t.split("\n")) if s.strip()] for _, t in docs]
    gone = [set() for _ in docs]
    for b in range(len(docs)):
        for a in range(b + 1):
            for j in range(len(split[b])):
                for i in range(len(split[a]) if a < b else j):
                    k = 0
                    while i + k < len(split[a]) and j + k < len(split[b]) and split[a][i + k][1] == split[b][j + k][1]:
                        k += 1
                    if sum(len(s) for _, s in split[b][j : j + k]) >= least:
                        gone[b] |= set(range(split[b][j][0], split[b][j + k - 1][0] + 1))
    return {d: "\n".join(s for p, s in enumerate(d[1].split("\n")) if p not in g) for d, g in zip(docs, gone)}


def test_against_brute_force(spark):
    rng = random.Random(6)
    pool = ["a" * 12, "bb", "ccccc", "", "  ", "dé" * 4, "e", "é", "fffff fff", "g" * 30]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, rows[3][1]), (3, rows[3][1]), (None, rows[5][1]), (80, "\n".join(["h" * 30] * 9)), (81, "x\n" * 300 + "y" * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' AS lang", "1 AS r", "2 AS pos").repartition(5)
    for least in (10, 20):
        want = brute(rows, least)
        got = drop_repeated_lines(docs, least).collect()
        assert len(got) == len(rows) and got[0].__fields__ == docs.columns + ["n_lines", "n_removed"]
        texts = {(i, t): want.get((i, t)) for i, t in rows}
        assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, ((i, texts[i, t]) for i, t in rows)))
        n = {(r.doc_id, r.n_lines, r.n_removed) for r in got}
        assert {(i, len(t.split("\n")) if t is not None else 0, len(t.split("\n")) - len(want[i, t].split("\n")) if t and want[i, t] != "" else None) for i, t in rows if t and want[i, t]} <= n
    assert drop_repeated_lines(docs.limit(0)).count() == 0


def test_same_as_sql(spark):
    import os

    import duckdb
    import pytest

    from tarnwater.llm.queries import ORACLE_SQL, QUERIES

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("tables are not here")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = sorted(con.execute(ORACLE_SQL["op7_line_dedup"]).fetchall())
    got = sorted(map(tuple, QUERIES["op7_line_dedup"](spark, data).collect()))
    assert got == want and sum(r[2] for r in got) > 0


def test_clashing_names_and_long_texts(spark):
    line = "z" * 250
    rows = [(1, line + "\nown", 5, True, 7, "d"), (2, "x\n" + line, 6, False, 8, "e"), (3, "\n".join(f"line {i}" for i in range(20000)), 0, None, 0, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, flags boolean, n_removed int, gone string").selectExpr("*", "7 AS DOC", "1 AS _h")
    got = {r.doc_id: r for r in drop_repeated_lines(docs).collect()}
    assert list(got[1].__fields__) == docs.columns + ["n_lines_", "n_removed_"]
    assert (got[2].text, got[2].n_lines, got[2].n_removed, got[2].n_lines_, got[2].n_removed_, got[2].flags, got[2].gone) == ("x", 6, 8, 2, 1, False, "e")
    assert got[3].text == rows[2][1] and got[3].n_lines_ == 20000 and got[1].text == rows[0][1]
