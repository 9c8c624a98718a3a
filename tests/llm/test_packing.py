import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwater.llm.packing import best_fit, pack, pack_block, price

SIZES = (8, 16, 32)


def plain(lengths, sizes):
    """Best fit by trying every open bin."""
    bins = []
    places = []
    for k, n in enumerate(lengths):
        fits = [(room, b) for b, (room, _) in enumerate(bins) if room >= n]
        if fits:
            b = min(fits)[1]
        else:
            rest = sum(lengths[k:])
            size = min((c for c in sizes if c >= n), key=lambda c: (price(c) / min(c, rest), -c))
            bins.append([size, 0])
            b = len(bins) - 1
        places.append((b, bins[b][1]))
        bins[b][0] -= n
        bins[b][1] += n
    return places, [used for _, used in bins]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_best_fit(lengths):
    lengths.sort(reverse=True)
    assert best_fit(lengths, SIZES) == plain(lengths, SIZES)
    placed = pack_block(lengths, SIZES) if lengths else []
    used = {}
    for n, (b, offset, capacity) in zip(lengths, placed):
        assert offset == used.get(b, (0, 0))[0] and offset + n <= capacity
        used[b] = (offset + n, capacity)
    assert all(c == min(s for s in SIZES if s >= n) for n, c in used.values())
    assert sum(price(c) for _, c in used.values()) <= sum(price(min(s for s in SIZES if s >= n)) for n in lengths) + 1e-9


def test_operator(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["wörd"] * rng.choice([1, 3, 9, 30, 100]))) for i in range(300)] + [(300, None), (301, ""), (302, " \n "), (303, "a " * 5000), (303, "a " * 5000), (None, "b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS length", "2 AS piece").repartition(4)
    got = pack(docs, sizes=SIZES, block=64).collect()
    want = sorted((-1 if i is None else i, len((t or "").split())) for i, t in rows)
    total = {}
    for r in got:
        key = -1 if r.doc_id is None else r.doc_id
        total[key] = total.get(key, 0) + r.length
        assert r.start == r.piece * 32 and (r.bin_id is None) == (r.length == 0)
    assert total == {i: sum(n for j, n in want if j == i) for i, _ in want}
    bins = {}
    for r in got:
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    for members in bins.values():
        end = 0
        for r in sorted(members, key=lambda r: r.bin_offset):
            assert r.bin_offset == end
            end += r.length
        assert {r.capacity for r in members} == {min(s for s in SIZES if s >= end)}
    # the same rows dealt otherwise are packed alike
    again = pack(docs.repartition(2, F.rand(3)), sizes=SIZES, block=64)
    assert sorted(map(str, again.collect())) == sorted(map(str, got))
    assert pack(docs.limit(0)).count() == 0


def test_one_id_fills_no_block(spark):
    """A third of the rows have no id and another third the same id: no block holds much more than its share."""
    docs = spark.range(6000).selectExpr("CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN -1 ELSE id END AS doc_id", "IF(id % 2 = 0, 5, 1 + id % 40) AS n")
    got = pack(docs, length=F.col("n"), sizes=SIZES, block=100).collect()
    assert sum(r.length for r in got) == docs.agg(F.sum("n")).first()[0]
    blocks = {}
    for r in got:
        blocks[r.bin_id >> 32] = blocks.get(r.bin_id >> 32, 0) + 1
    assert len(blocks) > 50 and max(blocks.values()) < 400
