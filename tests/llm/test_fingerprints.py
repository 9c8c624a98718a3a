import hashlib
import random

from tarnwater.llm.fingerprints import PrefixHashes, compare_with_edits, edited, fingerprint, likeness


def test_spans_and_extensions():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choices("abé", k=rng.randint(0, 40))) for _ in "ab")
        x, y = PrefixHashes(a), PrefixHashes(b)
        i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
        n = rng.randint(0, min(len(a) - i, len(b) - j))
        assert x.equal(i, y, j, n) == (a[i : i + n] == b[j : j + n])
        k = x.extension(i, y, j)
        assert a[i : i + k] == b[j : j + k] and (i + k == len(a) or j + k == len(b) or a[i + k] != b[j + k])
        k = x.extension_back(i, y, j)
        assert a[i - k : i] == b[j - k : j] and (i == k or j == k or a[i - k - 1] != b[j - k - 1])


def test_likeness_follows_jaccard():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklm", k=7)) for _ in range(900)]
    a, b, c = " ".join(words[:600]), " ".join(words[:400] + words[600:800]), " ".join(words[800:])
    marks = [PrefixHashes(t).fingerprint() for t in (a, b, c)]
    assert abs(likeness(marks[0], marks[1]) - 0.5) < 0.2 and likeness(marks[0], marks[2]) < 0.05
    assert likeness("", "") == 1 and likeness("", marks[0]) == 0
    assert PrefixHashes("a").fingerprint() != PrefixHashes("b").fingerprint()


def test_operator(spark):
    rng = random.Random(5)
    rows = [(i * 3, "".join(rng.choices("ab é", k=rng.choice([0, 1, 2, 3, 9, 200])))) for i in range(120)] + [(400, None)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS part", "1 AS guest").repartition(5)
    got = {r.doc_id: r for r in compare_with_edits(docs).collect()}
    ordered = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for (i, t), (_, u) in zip(ordered, ordered[1:] + ordered[:1]):
        t, u, r = t or "", u or "", got[i]
        e = edited(t, u)
        marks = [PrefixHashes(x).fingerprint() for x in (t, e, u)]
        assert r[1:5] == (len(t), hashlib.sha256(e.encode()).hexdigest(), marks[0], marks[1])
        assert (r.near_edited, r.near_next) == (likeness(marks[0], marks[1]), likeness(marks[0], marks[2]))
        assert t[: r.same_prefix] == e[: r.same_prefix] and t[r.same_prefix : r.same_prefix + 1] != e[r.same_prefix : r.same_prefix + 1] or t == e
    assert {r.doc_id: r.fingerprint for r in fingerprint(docs).collect()} == {i: r.fingerprint for i, r in got.items()}


def test_ties_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "abc"), (1, "abc"), (None, "xyzxyz"), (None, None), (2, "q" * 30)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_chars, r.edited_sha256) for r in compare_with_edits(docs).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    # descending: 2, 1, 1, then the nulls in the order of texts, then round to 2
    assert got == sorted([(False, 2, 30, sha("q" * 20 + "abc")), (False, 1, 3, sha("aba")), (False, 1, 3, sha("ab")), (True, 0, 0, sha("")), (True, 0, 6, sha("xyzxqq"))])
    assert compare_with_edits(docs.limit(1)).count() == 1
    assert compare_with_edits(docs.where("doc_id = 99")).count() == 0


def in_a_row(rows):
    """(doc_id, sha256 of the edited text, likeness to the next) by the definition, in one list."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), len(r[1])))
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        yield str(i), hashlib.sha256(edited(t, u).encode()).hexdigest(), likeness(PrefixHashes(t).fingerprint(), PrefixHashes(u).fingerprint())


def test_one_id_with_most_rows(spark):
    rows = [(None, "ab" * (k // 3)) for k in range(600)] + [(5, "c" * k) for k in range(300)] + [(1 << 60 | k, f"{k} words") for k in range(9, 0, -1)] + [(k - 40, "few") for k in range(45)]
    rows = [r for r in rows if r[0] != 5 or r[1]] + [(None, None)] * 40_000
    random.Random(7).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = compare_with_edits(docs).select("doc_id", "edited_sha256", "near_next").collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == sorted(in_a_row(rows))


def test_ids_beyond_doubles_and_a_long_text(spark):
    rows = [((1 << 62) + 3 * k, f"text {k} " * (k % 7)) for k in range(300)] + [(1, "long " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = compare_with_edits(docs).select("doc_id", "edited_sha256", "near_next").collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == sorted(in_a_row(rows))
