import hashlib
import random
import sys
import zlib
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwater.llm.conversation_repair import AFTER, BLANK, CUT, DUPLICATE, NEEDED, NONE, Lattice, code, damaged, edited, repair

sys.setrecursionlimit(20000)  # brute force goes as deep as a conversation is long
WHITE = " \t\n\x0b\x0c\r"


def plain(rows):
    """(cost, audit) by trying all edits; inserts before a row and at the end, two at most in a row."""

    @lru_cache(maxsize=None)
    def best(i, state, run):
        found = [(0, "")] if i == len(rows) and state in (0, 3) else []
        if run < 3:
            found += [(3 + c, "I" + a) for c, a in best(i, AFTER[state][NEEDED[state]], run + 1)]
        if i < len(rows):
            role, fault = rows[i]
            found += [(4 + c, "D" + a) for c, a in best(i + 1, state, 0)]
            if fault in (NONE, CUT):
                extra = 3 if fault == CUT else 0
                if role[:1] in AFTER[state]:
                    found += [(extra + c, "K" + a) for c, a in best(i + 1, AFTER[state][role[:1]], 0)]
                found += [(3 + extra + c, "R" + a) for c, a in best(i + 1, AFTER[state][NEEDED[state]], 0)]
        return sorted(found)[:1]

    return best(0, 0, 0)[0]


ROWS = st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", " "]), st.sampled_from([NONE, NONE, BLANK, DUPLICATE, CUT])), max_size=14)


@settings(max_examples=400, deadline=None)
@given(ROWS, st.integers(1, 5))
def test_least_cost_and_audit(rows, chunk):
    codes = bytes(code(r, f) for r, f in rows)
    want = plain(rows)
    assert Lattice().finish(codes) == want
    search = Lattice()
    for a in range(0, len(codes), chunk):
        search.read(codes[a : a + chunk])
    assert search.finish() == want
    made, _ = edited([r for r, _ in rows], [""] * len(rows), want[1])
    initials = "".join(r[:1] for r, _, _ in made)
    assert initials.removeprefix("s") == "ua" * (len(initials) // 2) and (initials != "s")


def test_long_conversation_stays_cheap():
    rnd = random.Random(1)
    codes = bytes(code(rnd.choice(["user", "assistant", "system", "x"]), rnd.choice([NONE, CUT, BLANK])) for _ in range(4000))
    search = Lattice()
    for a in range(0, len(codes), 100):
        search.read(codes[a : a + 100])
        assert max(len(a) for _, a in search.sources.values()) < 400  # what paths share is not carried along
    assert search.finish() == Lattice().finish(codes)


def brute(rows):
    """id -> report, from (id, turn, role, text) after damage; ids without rows have None for a turn's row."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv and (r, x) != ("gone", "gone")))
        seen, faults, judged, pairs = set(), [0, 0, 0, 0], [], 0
        for known, turn, role, text in mine:
            kept = text.strip(WHITE)
            fault = BLANK if not kept else DUPLICATE if (role, text) in seen else NONE if kept[-1] in ".!?" else CUT
            seen.add((role, text))
            faults[fault] += 1
            if judged:
                pairs += judged[-1][0][:1] + role[:1] not in ("su", "ua", "au")
            judged.append((role, fault))
        cost, audit = plain(judged)
        turns = {t for known, t, *_ in mine if known}
        made, _ = edited([r for r, _ in judged], [m[3] for m in mine], audit)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, faults[BLANK], faults[DUPLICATE], faults[CUT], pairs, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t, _ in made).encode()).hexdigest())
    return out


def some_rows(seed=4):
    rnd = random.Random(seed)
    texts = ["Hello.", "Hi", "What?", "", "  \t", "A long answer!", "Same.", "ok\x0b", "dot. ", None]
    rows = []
    for conv in [None, *range(30)]:
        for turn in range(rnd.randint(1, 9)):
            rows.append((conv, rnd.choice([turn, turn, turn, None, turn + 3]), rnd.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None]), rnd.choice(texts)))
    rows += rnd.choices(rows, k=10)
    rows += [(7, t, rnd.choice(["user", "assistant"]), rnd.choice(texts[:6])) for t in range(400)]  # most rows are of one conversation
    rows += [(99, 1, "gone", "gone"), (3, 50, "gone", "gone"), (7, 5000, "gone", "gone")]
    return rows


@pytest.mark.parametrize("chunk,spread", [(512, False), (3, False), (512, True), (7, True)])
def test_rows_match_brute_force(spark, chunk, spread):
    """Whole conversations, such as are cut into chunks, and a large one that several tasks share."""
    if spread:
        name = "spark.sql.adaptive.coalescePartitions.enabled"
        before = spark.conf.get(name)
        spark.conf.set(name, "false")
        try:
            compare(spark, chunk)
        finally:
            spark.conf.set(name, before)
    else:
        compare(spark, chunk)


def compare(spark, chunk):
    rows = some_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, codes string")
    df = df.withColumn("away", (F.col("role") == "gone") & (F.col("text") == "gone"))
    got = {r[0]: tuple(r)[1:] for r in repair(df, gone="away", chunk=chunk).collect()}
    want = brute(rows)
    assert got == want and got[99] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    turns = repair(df, gone="away", chunk=chunk, keep="turns").collect()
    for conv, report in want.items():
        mine = sorted((r for r in turns if r.conv_id == conv), key=lambda r: r.place)
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in mine).encode()).hexdigest() == report[-1]
        assert [r.edit for r in mine] == [e for e in report[-2] if e != "D"]


def test_long_text_empty_table_and_text_ids(spark):
    df = spark.createDataFrame([("a", 1, "user", "word " * 400000 + "?"), ("a", 2, "assistant", "Yes."), ("b", 1, "user", "Hi.")], "conv_id string, turn long, role string, text string")
    got = {r.conv_id: r for r in repair(df).collect()}
    assert (got["a"].cost, got["a"].audit, got["b"].cost, got["b"].audit) == (0, "KK", 3, "KI")
    assert repair(df.limit(0)).count() == 0 and repair(df.limit(0), keep="turns").count() == 0


def test_damage(spark):
    rows = spark.range(2000).select(F.lit(5).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.lit("A. B! C?").alias("text"))
    kinds = {f: 0 for f in range(20)}
    for t in range(2000):
        kinds[zlib.crc32(f"5:{t}".encode()) % 20] += 1
    got = damaged(rows)
    assert got.where("gone").count() == kinds[0] and got.where("NOT gone AND text = ''").count() == kinds[1]
    assert got.where("text = 'A B C'").count() == kinds[2] and got.where("role = 'user'").count() == kinds[4]
    assert got.count() == 2000 + kinds[3]
    odd = spark.createDataFrame([(None, None, None, None)], "conv_id long, turn long, role string, text string")
    assert damaged(odd).where("gone").count() == (zlib.crc32(b" : ") % 20 == 0)
