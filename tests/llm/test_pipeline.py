import os
import re

import pytest

import corpus_pipeline
from tarnwater.llm import language_id, secret_scan
from tarnwater.llm.packing import SIZES

from test_line_dedup import brute as brute_lines
from test_shingle_join import brute as brute_shingles

from test_language_id import brute as brute_language
from test_secret_scan import stated

DATA = "/root/testdata/sf0.001"


def brute_redacted(text, model):
    """The stated patterns, and other tokens whose pairs of characters add up to the bound, marked character by character."""
    code = {c: i + 1 for i, c in enumerate(secret_scan.ALPHABET)}
    spans = [(a, b) for a, b, _ in stated(text)]
    taken = [any(a <= i < b for a, b in spans) for i in range(len(text))]
    for m in re.finditer("[A-Za-z0-9+/_=-]{8,}", text):
        if not any(taken[m.start() : m.end()]):
            codes = [0, *(code[c] for c in m[0])]
            if sum(model.ratio[x, y] for x, y in zip(codes, codes[1:])) >= 12:
                spans.append(m.span())
    out, a = "", 0
    for start, end in sorted(spans):
        if start >= a:
            out += text[a:start] + "[SECRET]"
        a = max(a, end)
    return out + text[a:]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are not here")
def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "12", "en", "s", 2), (10**6 + 2, "", None, None, None)], docs.schema)
    docs = docs.union(extra)
    columns = docs.columns
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, DATA))
        out.append((name, docs))
        if name != "packing":
            assert docs.columns == columns
    rows = {name: sorted((r.doc_id, r.text) for r in d.select("doc_id", "text").collect()) for name, d in out[:-1]}

    raw = spark.read.parquet(f"{DATA}/documents.parquet").union(extra)
    told = brute_language([(r.text, r.lang) for r in raw.where(~language_id.held_out()).collect()])
    pairs = sorted((r.doc_id, r.text) for r in raw.select("doc_id", "text").collect())
    assert rows["language_id"] == [(i, t) for i, t in pairs for label, p in [told(t)] if label and p >= 0.5]
    assert 0 < len(pairs) - len(rows["language_id"]) < 10

    kept = brute_lines(rows["language_id"], 200)
    assert rows["line_dedup"] == sorted((i, kept[i, t]) for i, t in rows["language_id"] if kept[i, t] == t or kept[i, t].strip())

    groups = brute_shingles(rows["line_dedup"], 5, 80)
    assert rows["near_duplicates"] == [r for r, g in zip(rows["line_dedup"], groups) if g[0] == g[2]]

    secrets = secret_scan.train(out[2][1])
    assert rows["secret_scan"] == [(i, brute_redacted(t, secrets)) for i, t in rows["near_duplicates"]]
    assert all(r.n_chars == len(r.text) for r in out[3][1].collect())

    words, bins = {}, {}
    for r in out[4][1].collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + r.length
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    assert words == {i: len(t.split()) for i, t in rows["secret_scan"]}
    for members in bins.values():
        used = sum(r.length for r in members)
        assert {r.capacity for r in members} == {min(s for s in SIZES if s >= used)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_near_duplicates_by_row(spark):
    """Repeated rows, null ids and ids with several texts: one row of each group stays."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    near = lambda k: text(k) + " more"
    rows = [(1, text(0)), (1, text(0)), (1, text(0))]  # a repeated row
    rows += [(None, text(1)), (None, text(1)), (None, near(1)), (7, near(1))]  # copies without an id beside one with
    rows += [(None, text(2)), (None, text(2))]  # no id at all
    rows += [(3, text(3)), (9, near(3)), (9, text(4)), (12, near(4))]  # an id of which one text is near a lesser id
    rows += [(4, ""), (4, ""), (None, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    want = [(1, text(0)), (7, near(1)), (None, text(2)), (3, text(3)), (9, text(4)), (4, ""), (4, ""), (None, " ")]
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, want))


def test_clashing_names(spark):
    """Columns of other names pass through all stages but the last."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    names = ["flags", "n_lines", "maybe", "_slot", "_place", "_key", "key", "gone", "doc", "n", "component_id", "bin_id", "n_removed", "score"]
    docs = corpus_pipeline.stored(docs.selectExpr("*", *(f"doc_id + {k} AS {c}" for k, c in enumerate(names))))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.columns, corpus_pipeline.stored(stage(spark, docs, DATA))
        assert docs.columns == before
        assert docs.count() > 0 and docs.where(" OR ".join(f"{c} <> doc_id + {k}" for k, c in enumerate(names))).isEmpty()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() > 0
