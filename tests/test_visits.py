"""Visits that lose nothing: arrival order, whole histories, final answers; the landed source."""

import json
import os

import pytest

from tarnwater.operators import crawl
from tarnwater.operators.store import Store
from tarnwater.sources import landed, payloads
from tarnwater.streaming import jobs

RANK = json.dumps({"rank_game": {"level": 22.0, "rank_score": 5000.25}})


def profile(level=22.0, shown=True):
    rank = json.dumps({"rank_game": {"level": level, "rank_score": 1.5}})
    return json.dumps({"player": {"info": {"name": "me", "rank_game_1001019": rank}}, "visibility": {"match_history": shown}})


def page(*uids):
    return json.dumps([{"match_uid": u, "match_map_id": 5.0, "game_mode_id": 2} for u in uids])


def detail(uid):
    return json.dumps({"match_uid": uid, "match_players": []})


class Source:
    """Responses as lists of tuples, in the order in which they arrived."""

    def __init__(self, spark, profiles=(), pages=(), details=()):
        self.spark, self.profiles, self.pages, self.details = spark, profiles, pages, details

    def boards(self):
        return self.spark.createDataFrame([], "hero_id int, raw string"), self.spark.createDataFrame([], "raw string")

    def responses(self, claimed):
        made = lambda rows, schema: self.spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema + ", landed_at int")
        return made(self.profiles, "uid long, http_status int, raw string"), made(self.pages, "uid long, skip int, http_status int, raw string"), made(self.details, "match_uid string, http_status int, raw string")


def store_of(spark, path, *uids, last=None):
    store = Store(spark, str(path))
    store.commit({"players": spark.createDataFrame([(u, "claimed", last, 5, 0) for u in uids], "uid long, crawl_status string, last_crawled_at long, claimed_at long, created_at long")})
    return store


def visit(store, source, now=1000, full=3):
    done = crawl.visit(store, *source.responses(None), 19, now, full)
    people = {r.uid: (r.crawl_status, r.last_crawled_at) for r in store.read("players").collect()}
    return done, people, sorted(r.match_uid for r in store.read("matches").collect())


ANSWERS = [(503, None, "error", 1000), (429, None, "pending", None), (403, None, "pending", None), (200, "<html>", "error", 1000), (None, None, "error", 1000), (404, None, "done", 1000), (200, '{"match_uid": null}', "done", 1000)]


def test_a_match_without_a_final_answer_keeps_its_visit_open(spark, tmp_path):
    """The newer match is stored; the failed one comes with the next visit, which reads the whole history again. One player a case."""
    store = store_of(spark, tmp_path / "store", *range(len(ANSWERS)), last=7)
    profiles = [(k, 200, profile()) for k in range(len(ANSWERS))]
    pages = [(k, 0, 200, page(f"new{k}", f"lost{k}")) for k in range(len(ANSWERS))]
    answers = [(f"new{k}", 200, detail(f"new{k}")) for k in range(len(ANSWERS))] + [(f"lost{k}", status, raw) for k, (status, raw, *_) in enumerate(ANSWERS) if status]
    done, people, matches = visit(store, Source(spark, profiles, pages, answers))
    assert people == {k: (want, stamp) for k, (*_, want, stamp) in enumerate(ANSWERS)} and matches == [f"new{k}" for k in range(len(ANSWERS))]
    assert (done.finished, done.released) == (5, 2)
    open_ = [k for k, (*_, want, _) in enumerate(ANSWERS) if want != "done"]
    source = Source(spark, profiles, pages, answers + [(f"lost{k}", 200, detail(f"lost{k}")) for k in open_])
    crawl.tick(store, source.boards, 10000, lambda x: None)
    assert crawl.claim(store, 1, 10, 10000) == len(open_)
    _, people, matches = visit(store, source, 10001)
    assert all(people[k] == ("done", 10001 if k in open_ else 1000) for k in people) and matches == sorted([f"new{k}" for k in range(len(ANSWERS))] + [f"lost{k}" for k in open_])


HISTORIES = [
    ([(0, 200, "<html>")], "error", []), ([], "error", []), ([(0, 200, "[]")], "done", []),
    ([(0, 200, "abc"), (6, 200, "g")], "error", ["a", "b", "c"]),  # page 3 never landed: 6 isn't reached
    ([(0, 200, "abc"), (3, 503, None), (6, 200, "g")], "error", ["a", "b", "c"]),
    ([(0, 200, "abc"), (3, 429, None)], "pending", ["a", "b", "c"]),
    ([(0, 200, "abc"), (3, 200, "d")], "done", ["a", "b", "c", "d"]),
    ([(0, 200, "abc"), (3, 503, None), (3, 200, "d")], "done", ["a", "b", "c", "d"]),  # the later landing counts
    ([(3, 200, "d")], "error", []),
]


def test_pages_are_whole_or_the_visit_is_not_done(spark, tmp_path):
    store = store_of(spark, tmp_path / "store", *range(len(HISTORIES)))
    made = lambda k, raw: page(*(f"{m}{k}" for m in raw)) if raw and raw.isalpha() else raw
    pages = [(k, skip, status, made(k, raw)) for k, (landed_, *_) in enumerate(HISTORIES) for skip, status, raw in landed_]
    details = [(f"{m}{k}", 200, detail(f"{m}{k}")) for m in "abcdg" for k in range(len(HISTORIES))]
    _, people, found = visit(store, Source(spark, [(k, 200, profile()) for k in range(len(HISTORIES))], pages, details))
    assert {k: (people[k][0], [m[0] for m in found if m[1:] == str(k)]) for k in people} == {k: (want, matches) for k, (_, want, matches) in enumerate(HISTORIES)}


def test_a_revisit_needs_no_page_behind_a_known_match(spark, tmp_path):
    store = store_of(spark, tmp_path / "store", 1, last=7)
    store.commit({"matches": spark.createDataFrame([("b",)], "match_uid string")})
    pages = [(1, 0, 200, page("a", "b", "c")), (1, 3, 503, None)]
    _, people, found = visit(store, Source(spark, [(1, 200, profile())], pages, [("a", 200, detail("a"))]))
    assert (people[1], found) == (("done", 1000), ["a", "b"])


PROFILES = [
    ([(503, None), (200, profile())], ("done", 22)), ([(200, profile()), (503, None)], ("error", None)), ([(200, profile(20.0)), (200, profile(25.0)), (200, profile(14.0))], ("done", 14)),
    ([(200, profile(20.0)), (200, profile(9.0))], ("skipped_floor", 9)), ([(200, profile()), (429, None)], ("pending", None)), ([(403, "")], ("pending", None)), ([(418, profile())], ("done", 22)), ([(500, profile())], ("error", None)),
]


def test_the_newest_profile_counts(spark, tmp_path):
    store = store_of(spark, tmp_path / "store", *range(len(PROFILES)), last=3)
    visit(store, Source(spark, [(k, *p) for k, (landed_, _) in enumerate(PROFILES) for p in landed_], [(k, 0, 200, "[]") for k in range(len(PROFILES))]))
    rows = {r.uid: r for r in store.read("players").collect()}
    assert {k: (r.crawl_status, r.latest_known_level) for k, r in rows.items()} == {k: want for k, (_, want) in enumerate(PROFILES)}
    assert all(r.last_crawled_at == (3 if r.crawl_status == "pending" else 1000) for r in rows.values())  # put back before its history was read: the stamp stays


def test_the_run_rests_and_gives_up(spark, tmp_path):
    """A source that answers 429 only is not asked forever; whoever stops the run finds the queue as it was."""
    store = store_of(spark, tmp_path / "store", 1)
    store.commit({"players": spark.createDataFrame([(1, "pending", 0), (2, "pending", 0)], "uid long, crawl_status string, created_at long")})
    said, rests = [], []
    source = Source(spark, [(1, 429, None), (2, 200, profile(5.0))])
    assert crawl.run(store, source, 19, clock=lambda: 50, batch=1, say=said.append, sleep=rests.append, rest=9, patience=2) == 2
    assert sum(rests) == 18 and {r.uid: r.crawl_status for r in store.read("players").collect()} == {1: "pending", 2: "pending"}
    assert crawl.run(store, source, 19, clock=lambda: 51, batch=5, say=said.append, sleep=rests.append, patience=2) == 3  # one finishes, then two in vain
    assert {r.uid: r.crawl_status for r in store.read("players").collect()} == {1: "pending", 2: "skipped_floor"}
    assert "round 1: 1 visits finished, 1 put back; matches=0 pending=1 skipped_floor=1 " in said[-3]


def test_profiles_are_parsed_once(spark):
    raw = spark.createDataFrame([(1, profile())], "uid long, raw string")
    plan = payloads.profiles(raw, 19).where("visible")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 2  # the document and the rank in it


def test_newest(spark):
    rows = spark.createDataFrame([(1, "a", 5), (1, "b", 7), (1, "c", None), (None, "d", 1), (None, None, 2)], "k int, raw string, landed_at int")
    assert {tuple(r) for r in payloads.newest(rows, "k").select("k", "raw").collect()} == {(1, "b"), (None, None)}
    assert payloads.newest(rows).first().raw == "b" and payloads.newest(rows.limit(0)).count() == 0


# -- the data source ------------------------------------------------------------------------------
LINES = [{"uid": i, "http_status": 200, "raw": "x" * (i * 37 % 90) + "é"} for i in range(200)]


def write(folder, name, lines, at=None):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    if at:
        os.utime(folder / name, (at, at))


def load(spark, path, kind="profiles", **options):
    return landed.register(spark).read.format("landed").options(kind=kind, **options).load(str(path))


@pytest.mark.parametrize("split,block", [(1 << 25, 1 << 22), (700, 64), (97, 1000), (64, 7)])
def test_splits_hold_each_line_once(spark, tmp_path, split, block):
    write(tmp_path / "in", "a.json", LINES[:150])
    write(tmp_path / "in", "b.json", LINES[150:])
    write(tmp_path / "in", "_c.json", LINES)
    got = load(spark, tmp_path / "in", split=split, block=block)
    assert got.rdd.getNumPartitions() >= (1 if split > 1 << 20 else 15)
    rows = got.collect()
    assert sorted((r.uid, r.raw) for r in rows) == [(x["uid"], x["raw"]) for x in LINES]
    assert all(r.place == len(("\n".join(map(json.dumps, LINES[:k])) + "\n").encode()) for r in rows if r.file.endswith("a.json") and (k := r.uid))


def test_lines_that_are_no_records(spark, tmp_path):
    write(tmp_path / "in", "a.json", ['{"uid": 1, "http_status": 200, "raw": "r", "more": 5, "landed_at": 44}', "<html>", "", "[1]", '{"uid": "7", "http_status": 2.5, "raw": 3}', "{"], at=9)
    rows = load(spark, tmp_path / "in").orderBy("place").collect()
    assert [(r.uid, r.http_status, r.raw, r.landed_at) for r in rows] == [(1, 200, "r", 44), (None, None, "<html>", 9000000), (None, None, "[1]", 9000000), (None, None, None, 9000000), (None, None, "{", 9000000)]
    assert load(spark, tmp_path / "none").count() == 0
    with pytest.raises(Exception):
        load(spark, tmp_path / "in", kind="other").count()


def test_arrival_order_of_files(spark, tmp_path):
    write(tmp_path / "profiles", "b.json", [{"uid": 1, "raw": "old"}, {"uid": 2, "raw": "one"}, {"uid": 2, "raw": "two"}], at=100)
    write(tmp_path / "profiles", "a.json", [{"uid": 1, "raw": "new"}], at=200)
    got = payloads.newest(payloads.Landed(spark, str(tmp_path)).read("profiles"), "uid")
    assert {(r.uid, r.raw) for r in got.collect()} == {(1, "new"), (2, "two")}


def test_stream_goes_on_at_its_offset(spark, tmp_path):
    folder, out = tmp_path / "profiles", str(tmp_path / "out")
    source = payloads.Landed(spark, str(tmp_path))
    for k, n in enumerate((3, 2, 0)):
        if n:
            write(folder, f"{9 - k}.json", LINES[k * 10 : k * 10 + n], at=1000 + k)
        query = source.stream("profiles", settle=0).select("uid", "raw").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert sorted(r.uid for r in spark.read.schema("uid long").parquet(out).collect()) == [0, 1, 2] + [10, 11] * (k > 0)  # each file once
    write(folder, "late.json", LINES[50:51])
    assert landed.StreamReader({"path": str(folder), "kind": "profiles", "settle": "3600"}).latestOffset()["file"].endswith("8.json")  # too young


def test_the_crawl_as_a_stream(spark, tmp_path):
    """Profile, page and match land one after the other; the visit goes on with each and ends with the last, a restart between them all."""
    source = payloads.Landed(spark, str(tmp_path / "landed"))
    store = store_of(spark, tmp_path / "store", 1, 2, last=7)
    now = 1000
    lands = [
        ("profiles", [{"uid": 1, "http_status": 200, "raw": profile()}, {"uid": 2, "http_status": 200, "raw": profile(), "landed_at": 1}]), ("pages", [{"uid": 1, "skip": 0, "http_status": 200, "raw": page("a", "b", "c")}]),
        ("details", [{"match_uid": m, "http_status": 200, "raw": detail(m)} for m in "ab"]), ("pages", [{"uid": 1, "skip": 3, "http_status": 200, "raw": "[]"}]), ("details", [{"match_uid": "c", "http_status": 404}]),
    ]
    told, said = [], []
    for k in ("profiles", "pages", "details"):
        (tmp_path / "landed" / k).mkdir(parents=True)
    for n, (kind, lines) in enumerate(lands):
        write(tmp_path / "landed" / kind, f"{n}.json", lines, at=100 + n)
        jobs.crawl_stream(source, store, 19, str(tmp_path / "check"), clock=lambda: now, full=3, say=said.append, options={"settle": 0}).awaitTermination()
        people = {r.uid: (r.crawl_status, r.last_crawled_at) for r in store.read("players").collect()}
        told.append((people[1], sorted(r.match_uid for r in store.read("matches").collect())))
        assert people[2] == ("claimed", 7)  # its profile is older than its claim
    assert told == [(("claimed", None), []), (("claimed", None), []), (("claimed", None), ["a", "b"]), (("claimed", None), ["a", "b"]), (("done", 1000), ["a", "b"])]
    assert said == [f"batch {n}: {int(n == 4)} visits finished, 0 put back" for n in range(5)]


def test_text_source(spark, tmp_path):
    (tmp_path / "p-7.json").write_text("one\ntwo")
    (tmp_path / "p-x.json").write_text("three")
    got = payloads.landed(spark, str(tmp_path), keys={"uid": ("p-([^.]*)", "long")})
    assert sorted((r.raw, r.uid) for r in got.where("uid = 7").collect()) == [("one", 7), ("two", 7)] and got.where("uid IS NULL").count() == 1
    assert sorted(r.raw for r in payloads.landed(spark, str(tmp_path), whole=True).collect()) == ["one\ntwo", "three"]
