"""The crawl's operators on small, invented fixtures."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwater import schemas
from tarnwater.functions.devalue import unflatten
from tarnwater.functions.expressions import below_floor, eta_text, reaches_floor
from tarnwater.operators import changelog, folds, frontier, history, ingest, metrics, quality, seeding, shred, states
from tarnwater.operators.store import Store
from tarnwater.sources import payloads
from tarnwater.streaming import jobs


def match(uid="m1", players=12, bans=6, **over):
    doc = {
        "match_uid": uid, "match_time_stamp": 100, "match_play_duration": 600.5, "game_mode_id": 2, "mvp_uid": 1, "mvp_hero_id": 11, "svp_uid": 2, "svp_hero_id": 12, "replay_id": "12345678901",
        "dynamic_fields": {"ban_pick_info": [{"battle_side": float(b % 2), "hero_id": 1000.0 + b, "round_idx": float(b), "is_pick": 0.0} for b in range(bans)]},
        "match_players": [
            {"player_uid": 500 + p, "nick_name": f"n{p}", "camp": p % 2, "cur_hero_id": 10 + p, "is_win": int(p % 2 == 1), "k": p, "d": 1, "a": 2, "total_hero_damage": 5.5, "total_hero_heal": 0.0, "total_damage_taken": 1.0, "session_hit_rate": 0.5,
             "dynamic_fields": {"add_score": 10.5, "level": 22.0, "new_level": 23.0, "new_score": 4000.0 + p}, "player_heroes": [{"hero_id": 10 + p, "k": 1, "d": 0, "a": 1, "play_time": 9.5}, {"hero_id": 30, "k": 0, "d": 0, "a": 0, "play_time": 1.0}]}
            for p in range(players)
        ],
    }
    return doc | over


def raw(spark, docs):
    return spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d), i) for i, d in enumerate(docs)], "raw string, seq long")


def test_shredding(spark):
    good, bad = shred.admitted(payloads.matches(raw(spark, [match()])))
    made = {k: v.collect() for k, v in shred.shred(good, 19, 7).items()}
    assert {k: len(v) for k, v in made.items()} == {"matches": 1, "match_bans": 6, "match_players": 12, "match_player_heroes": 24, "heroes": 19}
    m = made["matches"][0]
    assert (m.replay_id, m.winner_side, m.map_id, m.season, m.game_mode_id) == (12345678901, 1, None, 19, 2)
    assert sorted(b.hero_id for b in made["match_bans"]) == list(range(1000, 1006))
    assert made["match_players"][0].new_level == 23 and bad.count() == 0


@pytest.mark.parametrize("doc,ok", [
    ({"dynamic_fields": None}, True), ({"dynamic_fields": {"ban_pick_info": None}}, True), ({"replay_id": "none"}, True), ({"match_uid": None}, False),
    ({"match_players": [{"nick_name": "x"}]}, False), ({"dynamic_fields": {"ban_pick_info": [{"hero_id": 1.0}]}}, False), ({"match_players": [{"player_uid": 1, "player_heroes": [{"k": 1}]}]}, False), ({"match_players": None}, True),
])
def test_a_match_enters_whole_or_not(spark, doc, ok):
    good, bad = shred.admitted(payloads.matches(raw(spark, [match() | doc, match("m2"), "{cut off", "[]"])))
    assert (good.count(), bad.count()) == ((2, 2) if ok else (1, 3))
    if ok and doc.get("replay_id"):
        assert shred.match_rows(good, 1, 1).where("match_uid = 'm1'").first().replay_id is None


def flat(value):
    """A flat reference array of a nested value."""
    slots = []

    def add(v):
        at = len(slots)
        slots.append(None)
        slots[at] = {k: add(x) for k, x in v.items()} if isinstance(v, dict) else [add(x) for x in v] if isinstance(v, list) else v
        return at

    slots.append(None)
    slots[0] = {"data": add({"page": value})}
    return json.dumps(slots)


nested = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=4), lambda c: st.lists(c, min_size=3, max_size=4) | st.dictionaries(st.text(max_size=3), c, max_size=3), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(nested)
def test_flat_arrays_resolve(value):
    assert json.loads(unflatten(flat(value))) == value


def test_flat_array_oddities():
    tell = lambda *slots: unflatten(json.dumps([{"data": 1}, *slots]))
    assert tell({"p": 2}, {"a": 3, "b": -1, "c": 4, "d": 5, "e": 6}, ["Reactive", 7], ["Date", "2026-01-01"], ["Ref", 7], True, [8, 8], "x") == '{"a":["x","x"],"b":null,"c":"2026-01-01","d":["x","x"],"e":true}'
    assert tell({"p": 2}, [2, 3, 3], "y") == '[null,"y","y"]'  # a cycle ends as null
    assert tell({"p": 2}, ["EmptyRef", 2]) == "null"
    assert tell({"a": 2, "b": 2}, "v") == '{"a":"v","b":"v"}'
    assert [unflatten(t) for t in ("", "{}", "[]", "[1]", "null", "[{}]")] == [None] * 6
    doubled = [{"data": 1}, {"p": 2}] + [[k, k] for k in range(3, 60)] + ["x"]
    assert unflatten(json.dumps(doubled)) is None  # 2**57 places
    assert unflatten(json.dumps(doubled[:1] + [{"p": 2}] + [[k, k] for k in range(3, 12)] + ["x"])).count("x") == 2**9
    deep = [{"data": 1}] + [[i + 1] for i in range(1, 20000)] + ["end"]
    assert unflatten(json.dumps(deep[:1] + [{"p": 2}] + deep[2:900] + ["end"])).endswith(']')


def test_flat_arrays_resolve_natively(spark):
    """The recursive query gives what the resolver in Python gives: shared and cyclic references, wrappers, oddities."""
    import random

    from tarnwater.functions.devalue_native import resolved

    rnd, docs = random.Random(8), []
    for _ in range(150):
        n = rnd.randint(2, 9)
        ref = lambda: rnd.choice([rnd.randint(1, n), rnd.randint(1, n), rnd.randint(1, n), -1, n + 5, "s", None, True])  # noqa: B023, E731
        slot = lambda: rnd.choice([[ref() for _ in range(rnd.randint(0, 3))], {k: ref() for k in rnd.sample("abcé", rnd.randint(0, 3))}, [rnd.choice(sorted(["Reactive", "Ref", "Date", "other"])), ref()], 'q"\\\n', "v", 7, -3, False, None])  # noqa: B023, E731
        docs.append(json.dumps([{"data": ref()} | rnd.choice([{}, {"x": 1}])] + [slot() for _ in range(n)], ensure_ascii=False))
    docs += ["", "{}", "[]", "[1]", "null", "[{}]", None, "[1", '[{"data":{"a":1}},5]', '[{"data":1},["Ref",2],["Ref",1]]', '[{"data":1},{"a":2},[2,3,3],"y"]']
    rows = spark.createDataFrame(list(enumerate(docs)), "id int, raw string")
    got = {r.id: r.resolved for r in resolved(rows).collect()}
    want = {i: None if d is None else unflatten(d) for i, d in enumerate(docs)}
    wrong = [(docs[i], got[i], want[i]) for i in want if got[i] != want[i]]
    assert not wrong, wrong[:3]


def test_flat_arrays_resolve_natively_beyond_the_row_limit(spark):
    """The walk takes as many rows as there are places, whatever the session allows a recursion."""
    from tarnwater.functions.devalue_native import resolved

    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "10")
    try:
        rows = spark.range(20).selectExpr("id", """concat('[{"data":1},{"a":2},[3,3],', id, ']') AS raw""")
        assert sorted(map(tuple, resolved(rows).collect())) == [(i, f"[{i},{i}]") for i in range(20)]
    finally:
        spark.conf.set(limit, before)


def test_matches_are_parsed_once_to_be_counted(spark, tmp_path):
    """Those that enter and those that don't are told apart in one pass."""
    from tarnwater.plans import registry

    docs = ['{"match_uid":"1","match_players":[{"player_uid":5}]}', '{"match_uid":"2","match_players":[{}]}', '{"match_uid":', "{}", None]
    got = shred.admission_counts(payloads.matches(spark.createDataFrame([(d,) for d in docs], "raw string")))
    assert tuple(got.first()) == (1, 4)
    items = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    spark.createDataFrame([(k, 1, 1, 1, 1.0, 1.0, 0.0, 0.0, "R", "F") for k in (1, 17, 19)], items).write.parquet(str(tmp_path / "lineitem.parquet"))
    counted = registry.admit_quarantine(spark, str(tmp_path))
    assert tuple(counted.first()) == (1, 2) and counted._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_rows_of_matches_are_dealt_once(spark, tmp_path):
    """What is merged into a table of matches is shuffled once, by part, and merged as it is without parts."""
    store = Store(spark, str(tmp_path / "store"))
    old = spark.createDataFrame([("a", 1, 0, 5, 1), ("b", 1, 0, 6, None)], schemas.schema("match_bans")).coalesce(1)
    new = [("a", 1, 0, 5, 0, 2, 0), ("a", 1, 0, 5, None, 1, 9), ("c", 1, 0, 5, 3, 1, 1), ("c", 1, 0, 5, 4, 1, 2), ("d", 2, 1, 5, 1, None, 0)]
    new = spark.createDataFrame(new, schemas.TABLES["match_bans"] + ", seq long, pos int")
    dealt, plain = ingest.upsert(old, new, "match_bans", store.part("match_bans")), ingest.upsert(old, new, "match_bans")
    want = {("a", 1, 0, 5, 0), ("b", 1, 0, 6, None), ("c", 1, 0, 5, 4), ("d", 2, 1, 5, 1)}
    assert set(map(tuple, dealt.drop("part").collect())) == set(map(tuple, plain.collect())) == want
    dealt.collect()
    plan = dealt._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning(part") == plan.count("Exchange ") == 1
    store.commit({"match_bans": dealt})
    assert set(map(tuple, store.read("match_bans").collect())) == want
    assert all(r.part == r.of for r in dealt.select("part", store.part("match_bans").alias("of")).collect())


def test_boards_and_profiles(spark):
    board = flat({"players": [{"name": "a", "uid": "7", "rank": {"rank_game_id": 19}}, {"name": "b", "uid": "x", "rank": {"rank_game_id": 19}}]})
    rows = spark.createDataFrame([(board,)], "raw string")
    assert payloads.current_season(spark.createDataFrame([(flat({"players": [{"name": "b", "uid": "x", "rank": {"rank_game_id": 20}}]}),)], "raw string")) == 20
    assert payloads.current_season(rows) == 19 and [r.uid for r in payloads.global_board(rows).collect()] == [7]
    with pytest.raises(ValueError):
        payloads.current_season(spark.createDataFrame([(flat({"players": []}),)], "raw string"))
    hero = spark.createDataFrame([(5, json.dumps({"players": [{"player_uid": 1}, {"player_uid": None}, {"player_uid": 3}]}))], "hero_id int, raw string")
    assert [(r.pos, r.uid) for r in payloads.hero_board(hero).collect()] == [(0, 1), (2, 3)]
    rank = json.dumps({"rank_game": {"level": 22.0, "rank_score": 5000.25}})
    docs = [{"player": {"info": {"rank_game_1001019": rank}}, "visibility": {"match_history": True, "platform": "pc"}}, {"player": {"info": {"rank_game_1001019": "[1"}}, "visibility": {"match_history": False}}, {"player": {}}, {}]
    got = payloads.profiles(spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(9, "x")], "uid long, raw string"), 19).collect()
    assert [(r.uid, r.latest_known_level, r.latest_known_score, r.visible) for r in got] == [(0, 22, 5000.25, True), (1, None, None, False), (2, None, None, False), (3, None, None, False), (9, None, None, False)]


def test_history_pages(spark):
    page = lambda n, skip: json.dumps([{"match_uid": f"h{skip + i}", "match_map_id": 5.0, "game_mode_id": 2 if i else 1} for i in range(n)])
    pages = spark.createDataFrame([(1, 0, page(20, 0)), (1, 20, page(3, 20)), (1, 40, page(20, 40)), (2, 0, "[]")], "uid long, skip int, raw string")
    entries = payloads.history(pages)
    assert entries.count() == 19 + 2
    other = json.dumps([{"match_uid": "x", "game_mode_id": 1}] * 20)
    rows = [(1, 0, page(20, 0)), (1, 20, "[]"), (1, 40, page(20, 40)), (2, 0, other), (2, 20, page(20, 20)), (3, 0, other[:100]), (3, 20, page(20, 0)), (4, 0, json.dumps([{"match_uid": "y", "game_mode_id": 1}])), (4, 20, page(3, 0))]
    entries = payloads.history(spark.createDataFrame(rows, "uid long, skip int, raw string"))
    assert {(r.uid, r.skip) for r in entries.collect()} == {(1, 0), (2, 20)}  # an empty, an unreadable, a short page of another mode end it


@pytest.mark.parametrize("revisit,want", [(False, ["a", "c"]), (True, ["a"])])
def test_scan_stops_only_on_a_revisit(spark, revisit, want):
    entries = spark.createDataFrame([(1, 0, i, u) for i, u in enumerate("abac")], "uid long, skip int, pos int, match_uid string")
    known = spark.createDataFrame([("b",)], "match_uid string")
    seen = spark.createDataFrame([(1, 5 if revisit else None)], "uid long, last_crawled_at long")
    assert sorted(r.match_uid for r in history.scan(entries, known, seen).collect()) == want


def test_floor(spark):
    rows = spark.createDataFrame([(None,), (12,), (13,)], "level int")
    assert [tuple(r) for r in rows.select(reaches_floor("level"), below_floor("level")).collect()] == [(False, False), (False, True), (True, False)]


def snapshot(spark, rows):
    return spark.createDataFrame(rows, "uid long, crawl_status string, last_crawled_at long, claimed_at long")


def test_requeue_matrix(spark):
    now = 10**6
    statuses = ["pending", "claimed", "done", "error", "skipped_floor", "skipped_private", "not_indexed"]
    rows, i = [], 0
    for s in statuses:
        for last in (None, now - 50000, now - 43200, now - 4000, now - 10):
            for claimed in (None, now - 4000, now - 3600, now - 10):
                rows.append((i, s, last, claimed))
                i += 1
    want = []
    for i, s, last, claimed in rows:
        if s == "done" and last is not None and last < now - 43200:
            want.append((i, "pending", last, claimed))
        elif s == "error" and last is not None and last < now - 3600:
            want.append((i, "pending", None, claimed))
        elif s == "claimed" and claimed is not None and claimed < now - 3600:
            want.append((i, "pending", None, None))
        else:
            want.append((i, s, last, claimed))
    table = snapshot(spark, rows)
    assert sorted(map(tuple, states.requeue(table, now).collect())) == want
    changed = sum(a != b for a, b in zip(rows, want))
    assert sum(states.requeue_counts(table, now).first()) == changed


def test_claims_are_disjoint_and_come_back(spark):
    table = snapshot(spark, [(i, "pending", None, None) for i in range(10)] + [(10, "done", 5, None)])
    queue = table.withColumns({"discovery_hero_id": F.lit(1), "created_at": F.lit(0)}).where("crawl_status = 'pending'")
    none = spark.createDataFrame([], "hero_id int")
    first = frontier.assign(frontier.top(queue, none, "hero_id", 4), 2)
    held = states.claim(table, first, 99)
    assert [r.uid for r in held.where("crawl_status = 'claimed' AND claimed_at = 99").orderBy("uid").collect()] == [0, 1, 2, 3]
    assert sorted((r.uid, r.worker) for r in first.collect()) == [(0, 0), (1, 1), (2, 0), (3, 1)]
    assert states.claim(held, first, 100).where("claimed_at = 100").count() == 0  # already taken
    assert sorted(map(tuple, states.release(held).collect())) == sorted(map(tuple, table.collect()))
    assert states.finish(held, spark.createDataFrame([(0, "error")], "uid long, outcome string"), 77).where("uid = 0").first()[1:] == ("error", 77, None)


def test_frontier_prefers_low_coverage_and_untagged_last(spark):
    queue = spark.createDataFrame([(1, 10, 0), (2, 20, 0), (3, None, 0), (4, 30, 1), (5, 30, 0)], "uid long, discovery_hero_id int, created_at long")
    facts = spark.createDataFrame([(10,)] * 5 + [(20,)] * 2, "hero_id int")
    assert [r.uid for r in frontier.top(queue, facts, "hero_id", 9).collect()] == [5, 4, 2, 1, 3]


def test_seeding_precedence(spark):
    heroes = spark.createDataFrame([(7, 0, 1, "a"), (3, 1, 1, "b"), (3, 0, 2, "c")], "hero_id int, pos int, uid long, nick_name string")
    board = spark.createDataFrame([(0, 1, "d"), (1, 5, None), (2, None, "e"), (3, 9, "f")], "pos int, uid long, nick_name string")
    found = seeding.new_seeds(seeding.seeds(heroes, board), spark.createDataFrame([(9,)], "uid long"))
    assert sorted(map(tuple, found.collect()), key=str) == [(1, 3, "b"), (2, 3, "c"), (5, None, None)]


writes = st.lists(st.tuples(st.integers(0, 2), st.sets(st.sampled_from(["a", "b", "c"])), st.none() | st.integers(0, 9)), max_size=12)


@settings(max_examples=15, deadline=None)
@given(writes, st.integers(0, 12))
def test_fold_is_a_replay(spark, log, cut):
    rows = [(k, sorted(cols), *(v if c in cols else None for c in "abc"), i) for i, (k, cols, v) in enumerate(log)]
    schema = "k int, set_cols array<string>, a int, b int, c int, seq long"
    state = {}
    for k, cols, a, b, c, _ in rows:
        row = state.setdefault(k, {})
        for name, v in zip("abc", (a, b, c)):
            if name in cols and not (name == "c" and "c" in row):
                row[name] = v
    want = sorted((k, *(r.get(x) for x in "abc")) for k, r in state.items())
    got = changelog.fold(spark.createDataFrame(rows + rows[:cut], schema), ["k"], ["a", "b"], ["c"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_progress_line(spark):
    players = snapshot(spark, [(i, "done", 1000 - i, None) for i in range(5)] + [(10 + i, "pending", None, None) for i in range(10)])
    matches = spark.createDataFrame([("m",)], "match_uid string")
    segs = spark.createDataFrame([(h,) for h, n in ((1, 1), (2, 2), (3, 3), (4, 4)) for _ in range(n)], "hero_id int")
    assert metrics.progress_line(players, matches, segs, 1000, 60) == "matches=1 done=5 pending=10 hero_coverage(min/median/max)=1/3/4 rate=5.0/min eta_to_drain_queue=~2m"
    assert tuple(metrics.spread(spark.createDataFrame([], "covered long")).first()) == (0, 0, 0)
    assert not metrics.drained(players).first()[0] and metrics.drained(players.where("uid < 5")).first()[0]
    assert metrics.progress_line(players.limit(0), matches, segs.limit(0), 1, 60).endswith("hero_coverage(min/median/max)=0/0/0 rate=0.0/min eta_to_drain_queue=queue empty")
    assert (eta_text("hours", 2.25), eta_text("days", 3.0), eta_text("unknown", None)) == ("~2.2h", "~3.0d", "unknown (no recent throughput)")


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.sampled_from([0.1, 2.0, 2.5])), max_size=30))
def test_pace(spark, steps):
    delay, streak = 1.0, 0
    for failed, latency in steps:
        if failed:
            delay, streak = min(8.0, delay * 2), 0
        elif latency > 2:
            delay, streak = min(8.0, delay * 1.5), 0
        else:
            streak += 1
            delay = max(0.2, delay * 0.95) if streak >= 3 else delay
    log = spark.createDataFrame([(1, i, f, x) for i, (f, x) in enumerate(steps)], "client long, seq long, failed boolean, latency double")
    assert [tuple(r) for r in folds.adaptive_delay(log).collect()] == ([(1, delay, streak)] if steps else [])


def test_folds_gather_no_log(spark):
    """A client's responses come in many batches; no row and no task holds its log."""
    log = spark.range(3000).selectExpr("IF(id % 3 = 0, NULL, IF(id % 3 = 1, 1L, 7L)) AS client", "(id * 7) % 3001 AS seq", "double(id % 97) AS at", "IF(id % 11 = 0, NULL, id % 13 = 0) AS failed", "CASE id % 17 WHEN 0 THEN NULL WHEN 1 THEN double('NaN') ELSE id % 17 / 7 END AS latency")
    want = {}
    for r in sorted(log.collect(), key=lambda r: r.seq):
        delay, streak = want.get(r.client, (1.0, 0))
        slow = r.latency is not None and (r.latency > 2 or r.latency != r.latency)
        if r.failed or slow:
            want[r.client] = min(8.0, delay * (2 if r.failed else 1.5)), 0
        else:
            want[r.client] = max(0.2, delay * 0.95) if streak >= 2 else delay, streak + 1
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)
    try:
        assert {r.client: (r.delay, r.streak) for r in folds.adaptive_delay(log).collect()} == want
        assert sum(r.openings > 0 for r in folds.circuit(log, threshold=2, cooldown=9).collect()) == 3
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    for df in (folds.adaptive_delay(log), folds.circuit(log)):
        assert "collect_list" not in df._jdf.queryExecution().toString()


def paced(steps, state=(1.0, 0)):
    for kind in steps:
        state = folds.delay_step(state, kind == folds.FAILED, kind == folds.TARDY)
    return state


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([folds.FAST, folds.FAST, folds.TARDY, folds.FAILED]), st.integers(1, 90)), max_size=12), st.integers(1, 4), st.floats(0.2, 8.0), st.integers(0, 5))
def test_maps_of_stretches(runs, cut, delay, streak):
    """Put together, the maps of the stretches of a log do what its steps do, bit for bit, to any state."""
    steps, maps, whole = [k for k, n in runs for _ in range(n)], [], folds.Pace()
    for a in range(0, len(runs), cut):
        m = folds.Pace()
        for run in runs[a : a + cut]:
            m.add(*run)
        maps.append(m.state())
        whole.then(m)
    state = delay, streak
    for m in maps:
        state = folds.applied(state, *m)
    assert state == paced(steps, (delay, streak)) == folds.applied((delay, streak), *whole.state())
    assert not whole.met or not whole.runs


def test_a_large_client_is_spread_over_tasks(spark):
    log = spark.range(40000).selectExpr("1L AS client", "id AS seq", "double(id) AS at", "xxhash64(id) % 5 = 0 AS failed", "double(abs(xxhash64(id, 1L)) % 30) / 10 AS latency")
    size = log.sparkSession.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    log.sparkSession.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        maps, rows = folds.pace_maps(log), folds.circuit_log(log)
        found = maps.collect()
        assert len({r.part for r in found}) == 4 and len(found) == 4 and all(r.met and not r.kinds for r in found)  # one constant each
        counts = [r["count"] for r in rows.groupBy("part").count().collect()]
        assert len(counts) == 4 and max(counts) < 2 * min(counts) and sum(counts) < 20000
        state = (1.0, 0)
        for r in log.orderBy("seq").collect():
            state = folds.delay_step(state, r.failed, r.latency > 2)
        assert tuple(folds.adaptive_delay(log).first())[1:] == state
    finally:
        log.sparkSession.conf.set("spark.sql.adaptive.coalescePartitions.enabled", size)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.sampled_from([None, 0.0, 1.0, 2.0, 5.0, 9.0, float("nan")]), st.booleans() | st.none(), st.booleans()), max_size=40))
def test_circuit_is_a_replay(spark, responses):
    state = {}
    for client, at, failed, bad in responses:
        failures, unreadable, openings, until = state.get(client, (0, 0, 0, None))
        if not (at is not None and until is not None and at < until):
            failures = failures + 1 if failed else 0
            unreadable = unreadable if failed else unreadable + 1 if bad else 0
            if failures >= 2 and failed or bad and not failed and unreadable >= 2:
                openings, until = openings + 1, None if at is None or at != at else at + 3
        state[client] = failures, unreadable, openings, until
    log = spark.createDataFrame([(c, i, *r) for i, (c, *r) in enumerate(responses)], "client int, seq int, at double, failed boolean, bad_json boolean")
    got = {r.client: (r.failures, r.unreadable, r.openings, r.open_until) for r in folds.circuit(log, threshold=2, cooldown=3).collect()}
    assert got == state


def test_pace_from_batch_to_batch(spark, tmp_path):
    """The state goes on from one micro-batch and start to the next; null and NaN count as in the batch form."""
    log = spark.createDataFrame([(i % 3, i, i % 5 == 0 if i % 7 else None, [0.1, None, float("nan"), 2.5][i * 7 % 4 if i % 3 else 0]) for i in range(240)], "client long, seq long, failed boolean, latency double")
    log = log.withColumn("ts", F.timestamp_seconds(F.col("seq") + 1000))
    out, check, landed = (str(tmp_path / x) for x in ("out", "check", "landed"))
    (tmp_path / "landed").mkdir()
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    for part in (0, 1, 2, None):  # the last start finds nothing new
        if part is not None:
            log.where(f"seq div 80 = {part}").orderBy(F.desc("seq")).coalesce(1).write.mode("append").parquet(landed)
        got = jobs.pace(stream, out, check)()
    want = {(r.client, r.delay, r.streak, 80) for r in folds.adaptive_delay(log).collect()}
    assert {tuple(r) for r in got.collect()} == want and len(want) == 3


def test_circuit_opens_again_at_once(spark):
    at = [*range(10), 200.0, 310.0, 311.0]
    log = spark.createDataFrame([(1, i, float(t), t != 311.0) for i, t in enumerate(at)], "client long, seq long, at double, failed boolean")
    assert tuple(folds.circuit(log).first()) == (1, 11, 2, 610.0)


def test_quality(spark):
    m = spark.createDataFrame([("a", 1), ("b", 1), ("c", None)], "match_uid string, winner_side int")
    p = spark.createDataFrame([("a", 1, 1), ("a", 0, 0), ("b", 0, 1), ("b", 1, 1), ("d", 1, 1)], "match_uid string, camp int, is_win int")
    assert sorted(r.match_uid for r in quality.winner_conflicts(m, p).collect()) == ["b", "c"]
    assert [r.match_uid for r in quality.orphans(p, m, "match_uid").collect()] == ["d"]
    assert sorted(r.match_uid for r in quality.duplicates(p, ["match_uid"]).collect()) == ["a", "b"]
    assert [r.match_uid for r in quality.group_sizes(p, "match_uid", 2).collect()] == ["d"]


def rows(df):
    return sorted(map(str, df.collect()))


def test_store_versions(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        Store.readonly(spark, path)
    store = Store(spark, path)
    assert store.read("players").count() == 0
    store.commit({"heroes": spark.createDataFrame([(1,)], "hero_id int")})
    before = Store.readonly(spark, path).read("heroes")
    store.commit({"heroes": spark.createDataFrame([(1, 5), (2, 6)], "hero_id int, first_seen_at long")})
    assert rows(before) == ["Row(hero_id=1, first_seen_at=None, last_seeded_at=None)"]  # a reader keeps its version
    assert store.read("heroes").count() == 2 and store.version() == 1
    with pytest.raises(PermissionError):
        Store.readonly(spark, path).commit({})


def parts_of(store):
    return {name: dict(at) for name, at in store.manifest()["tables"].items()}


def test_a_batch_writes_the_parts_it_touches(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), parts=8)
    ingest.ingest(store, raw(spark, [match(f"m{i}", players=1) | {"match_players": [{"player_uid": i, "cur_hero_id": 5.0, "player_heroes": [{"hero_id": 5.0}]}]} for i in range(60)]), 19, 50)
    before = parts_of(store)
    assert all(len(before[n]) == 8 for n in ("matches", "match_players", "match_player_heroes", "players"))
    ingest.ingest(store, raw(spark, [match("m7", players=1) | {"match_players": [{"player_uid": 7, "k": 3.0, "cur_hero_id": 5.0, "player_heroes": [{"hero_id": 5.0}, {"hero_id": 6.0}]}]}]), 19, 60)
    after = parts_of(store)
    for name in ("matches", "match_bans", "match_players", "match_player_heroes", "players", "heroes"):
        assert sum(after[name][p] != before[name].get(p) for p in after[name]) == (1 if name != "heroes" else len({p for p in after[name] if after[name][p] != before[name].get(p)})), name
    assert store.read("matches").count() == 60 and store.read("match_players").where("k = 3").count() == 1
    assert {tuple(r) for r in store.read("hero_coverage").collect()} == {(5, 60), (6, 1)}
    assert Store(spark, str(tmp_path / "store"), parts=99).parts == 8  # a store keeps its number of parts


def test_old_versions_go(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), parts=2)
    for i in range(5):
        store.commit({"heroes": spark.createDataFrame([(h, i) for h in range(20)], "hero_id int, first_seen_at long")})
    files = lambda: sorted(str(p.relative_to(tmp_path)) for p in (tmp_path / "store" / "heroes").glob("*/part=*"))
    assert len(files()) == 10 and store.vacuum() == 0  # all are young
    assert store.vacuum(now=10**10) == 8 and len(files()) == 2 and store.read("heroes").where("first_seen_at = 4").count() == 20
    assert store.vacuum(now=10**10) == 0 and store.version() == 4


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2), st.integers(0, 2)), max_size=5), min_size=1, max_size=3))
def test_kept_coverage_is_the_full_count(spark, batches):
    import tempfile

    store = Store(spark, tempfile.mkdtemp(), parts=2)
    for batch in batches:
        docs = [match(f"m{m}", players=0) | {"match_players": [{"player_uid": p, "player_heroes": [{"hero_id": float(h)}, {"hero_id": float(h)}]}]} for m, p, h in batch]
        ingest.ingest(store, raw(spark, docs), 19, 5)
    full = frontier.coverage(store.read("match_player_heroes"), "hero_id")
    assert sorted(map(tuple, store.read("hero_coverage").collect())) == sorted(map(tuple, full.collect()))


def test_ingest_is_idempotent_and_keeps_first_tags(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    seeded = spark.createDataFrame([(500, None, "done", 3), (501, 77, "pending", 3)], "uid long, discovery_hero_id int, crawl_status string, created_at long")
    store.commit({"players": seeded})
    docs = raw(spark, [match(), match("m2", players=1), "{"])
    assert ingest.ingest(store, docs, 19, 50).count() == 1
    first = {n: rows(store.read(n)) for n in schemas.TABLES}
    ingest.ingest(store, docs, 19, 50)
    assert {n: rows(store.read(n)) for n in schemas.TABLES} == first
    people = {r.uid: r for r in store.read("players").collect()}
    assert len(people) == 12 and people[500].discovery_hero_id is None and people[501].discovery_hero_id == 77 and people[502].discovery_hero_id == 12
    assert (people[500].crawl_status, people[500].created_at, people[502].crawl_status, people[502].created_at) == ("done", 3, "pending", 50)
    assert people[500].latest_known_score == 4000.0 and store.read("match_players").count() == 13


def land(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def test_pace_puts_late_responses_in_their_place(spark, tmp_path):
    """A response that comes a batch late is folded where it belongs; a restart goes on; untouched clients aren't written again."""
    schema = "client long, seq long, ts timestamp, failed boolean, latency double"
    at = lambda s: __import__("datetime").datetime.fromtimestamp(10**6 + s)
    every = [(c, i, at(i), (i * c) % 4 == 1, 0.1) for c in (1, 2) for i in range(40)]
    late = [r for r in every if r[0] == 1 and r[1] in (12, 17)]
    first = [r for r in every if r[1] < 20 and r not in late]
    second = late + [r for r in every if r[0] == 1 and r[1] >= 20]
    paths = {x: str(tmp_path / x) for x in ("in", "out", "check")}
    for k, rows_ in enumerate((first, second)):
        land(spark, paths["in"], rows_, schema)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(paths["in"])
        read = jobs.pace(stream, paths["out"], paths["check"], late="15 seconds")
    want = {(c, *paced([folds.FAILED if f else folds.FAST for x, i, _, f, _ in every if x == c and (c == 1 or i < 20)]), 40 if c == 1 else 20) for c in (1, 2)}
    assert {tuple(r) for r in read().collect()} == want
    written = [sorted({r.client for r in spark.read.schema("client long").parquet(f"{paths['out']}/v{n}").collect()}) for n in jobs.whole_versions(spark, paths["out"])]
    assert [w for w in written if w] == [[1, 2], [1]]


def test_pace_sends_no_messages_for_each_client(spark, tmp_path):
    """The state of clients comes and goes beside their rows."""
    land(spark, tmp_path / "in", [(c, 0, "2024-01-01 00:00:00", c % 2 == 1, 0.1) for c in range(50)], "client long, seq long, ts string, failed boolean, latency double")
    stream = spark.readStream.schema("client long, seq long, ts string, failed boolean, latency double").parquet(str(tmp_path / "in"))
    got = jobs.pace(stream, str(tmp_path / "out"), str(tmp_path / "check"))()
    assert {tuple(r) for r in got.collect()} == {(c, 2.0, 0, 1) if c % 2 else (c, 1.0, 1, 1) for c in range(50)}
    assert [r.operatorName for r in spark.read.format("state-metadata").load(str(tmp_path / "check")).collect()] == ["applyInPandasWithState"]


def test_idle_clients_are_forgotten(spark, tmp_path):
    schema = "client long, seq long, ts timestamp, failed boolean, latency double"
    at = lambda s: __import__("datetime").datetime.fromtimestamp(10**6 + s)
    for rows_ in ([(1, 0, at(0), True, 0.1), (2, 0, at(0), True, 0.1)], [(2, 1, at(500), True, 0.1)], [(2, 2, at(9000), True, 0.1)], [(1, 9, at(9001), True, 0.1)]):
        land(spark, tmp_path / "in", rows_, schema)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        read = jobs.pace(stream, str(tmp_path / "out"), str(tmp_path / "check"), late="1 second", idle=1000000)
    assert {tuple(r)[0]: tuple(r)[1:] for r in read().collect()}[1] == (2.0, 0, 1)  # begun anew


def test_run_until_stops_between_batches(spark, tmp_path):
    for i in range(3):
        land(spark, tmp_path / "in", [(i,)], "i int")
    seen = []
    start = lambda: spark.readStream.schema("i int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).writeStream.foreachBatch(lambda df, n: seen.append(df.count())).option("checkpointLocation", str(tmp_path / "check"))
    query = start().start()
    assert not jobs.run_until(query, lambda: len(seen) >= 1, poll=0.05) and not query.isActive
    before = len(seen)
    assert jobs.run_until(start().trigger(availableNow=True).start(), lambda: False, poll=0.05)
    assert before >= 1 and sum(seen) == 3  # what was stopped goes on where it was


def test_streams_say_what_they_do(spark, tmp_path):
    import time

    said = []
    listener = jobs.Progress(said.append)
    spark.streams.addListener(listener)
    try:
        land(spark, tmp_path / "in", [(1,), (2,)], "i int")
        query = spark.readStream.schema("i int").parquet(str(tmp_path / "in")).observe("seen", F.max("i").alias("top")).writeStream.format("noop").queryName("numbers").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
        for _ in range(100):
            if said and said[-1].endswith("ended"):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert said[0] == "stream numbers started" and said[1].startswith("batch 0: 2 rows, ") and said[1].endswith(" seen: top=2") and said[-1].endswith(" ended")


def test_streams(spark, tmp_path):
    for i, docs in enumerate(([match()], [match("m2"), match("m3", players=2)])):
        raw(spark, docs).withColumn("seq", F.col("seq") + 10 * i).coalesce(1).write.mode("append").parquet(str(tmp_path / "landed"))
    store = Store(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema("raw string, seq long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "landed"))
    for _ in range(2):  # the second start finds nothing new
        jobs.ingest_stream(stream, store, 19, 5, str(tmp_path / "check")).awaitTermination()
    assert store.version() == 1 and store.read("matches").count() == 3


def test_versions_of_a_match(spark, tmp_path):
    """Whatever the order of the rows and however they are batched, the last version stays whole."""
    old, new = match(), match()
    new["match_time_stamp"], new["match_players"][0]["k"] = 999, 77.0
    for k, batches in enumerate(([[2, 1]], [[1, 2]], [[1], [2]])):
        store = Store(spark, str(tmp_path / f"store{k}"))
        for batch in batches:
            docs = spark.createDataFrame([(json.dumps(new if seq == 2 else old), seq) for seq in batch], "raw string, seq long")
            ingest.ingest(store, docs, 19, 50)
        assert store.read("matches").first().match_time_stamp == 999
        assert store.read("match_players").where(f"player_uid = {new['match_players'][0]['player_uid']}").first().k == 77


def test_documents_are_parsed_once(spark):
    good, _ = shred.admitted(payloads.matches(raw(spark, [match()])))
    plan = shred.player_rows(good)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_repeated_outcomes_make_no_rows(spark):
    got = states.finish(snapshot(spark, [(1, "claimed", None, 5)]), spark.createDataFrame([(1, "done", 1), (1, "error", 2), (1, "done", 0)], "uid long, outcome string, n int"), 9)
    assert [tuple(r) for r in got.collect()] == [(1, "error", 9, None)]
    got = states.finish(snapshot(spark, [(1, "claimed", None, 5)]), spark.createDataFrame([(1, "done", 3), (1, "error", 2)], "uid long, outcome string, n int"), 9, "n")
    assert [r.crawl_status for r in got.collect()] == ["done"]


def test_latest_stream_after_a_restart(spark, tmp_path):
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "k int, at int, v string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("k int, at int, v string").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second start has nothing to do, and finds what the first left
        read = jobs.latest_stream(stream(), str(tmp_path / "out"), str(tmp_path / "check"), ["k"], [F.desc("at")])
        assert [tuple(r) for r in read().collect()] == [(1, 2, "b")]


def test_unreadable_bodies_open_the_circuit_too(spark):
    log = spark.createDataFrame([(1, i, float(i), False, True) for i in range(3)] + [(2, 0, 0.0, False, True), (2, 1, 1.0, True, False), (2, 2, 2.0, False, True), (3, 0, 0.0, False, True), (3, 1, 1.0, False, False), (3, 2, 2.0, False, True)], "client int, seq int, at double, failed boolean, bad_json boolean")
    got = {r.client: (r.failures, r.unreadable, r.openings) for r in folds.circuit(log, threshold=2, cooldown=1).collect()}
    assert got == {1: (0, 3, 2), 2: (0, 2, 1), 3: (0, 1, 0)}


def test_crawl_from_landed_responses(spark, tmp_path, capsys):
    """Boards, profiles, histories and details in a folder; the loop drains the queue."""
    from tarnwater.__main__ import main
    from tarnwater.operators import crawl

    rank = json.dumps({"rank_game": {"level": 22.0, "rank_score": 5000.25}})
    profile = lambda shown: json.dumps({"player": {"info": {"name": "me", "rank_game_1001019": rank}}, "visibility": {"match_history": shown}})
    page = json.dumps([{"match_uid": "m1", "match_map_id": 5.0, "game_mode_id": 2}, {"match_uid": "gone", "game_mode_id": 2}, {"match_uid": "bad", "game_mode_id": 2}])
    landed = {
        "hero_boards": [{"hero_id": 12, "raw": json.dumps({"players": [{"player_uid": 1, "info": {"name": "one"}}]})}],
        "global_board": [{"raw": flat({"players": [{"name": "two", "uid": "2", "rank": {"rank_game_id": 19}}, {"name": "three", "uid": "3", "rank": {"rank_game_id": 19}}]})}],
        "profiles": [{"uid": 1, "http_status": 200, "raw": profile(True)}, {"uid": 2, "http_status": 404, "raw": None}, {"uid": 3, "http_status": 200, "raw": profile(False)}],
        "pages": [{"uid": 1, "skip": 0, "raw": page}, {"uid": 3, "skip": 0, "raw": page}],
        "details": [{"match_uid": "m1", "http_status": 200, "raw": json.dumps(match("m1", players=1))}, {"match_uid": "gone", "http_status": 404, "raw": None}, {"match_uid": "bad", "http_status": 200, "raw": "{\"match_uid\": null}"}],
    }
    for kind, docs in landed.items():
        (tmp_path / "landed" / kind).mkdir(parents=True)
        (tmp_path / "landed" / kind / "a.json").write_text("\n".join(map(json.dumps, docs)))
    path = str(tmp_path / "store")
    store = Store(spark, path)
    store.commit({"heroes": spark.createDataFrame([(12,)], "hero_id int")})
    said = []
    rounds = crawl.run(store, payloads.Landed(spark, str(tmp_path / "landed")), 19, clock=lambda: 1000, say=said.append)
    people = {r.uid: r for r in store.read("players").collect()}
    assert said[:2] == ["3 players seeded", "put back: 0 done, 0 error, 0 claimed"] and rounds == 2  # the match brings a player, whose profile never landed
    assert [x.split(" hero_")[0] for x in said[2:]] == ["round 1: 3 visits finished, 0 put back; matches=1 done=1 not_indexed=1 pending=1 skipped_private=1", "round 2: 1 visits finished, 0 put back; matches=1 done=1 error=1 not_indexed=1 skipped_private=1"]
    assert {i: p.crawl_status for i, p in people.items() if i < 4} == {1: "done", 2: "not_indexed", 3: "skipped_private"}
    assert (people[1].nick_name, people[1].discovery_hero_id, people[1].latest_known_score, people[2].nick_name, people[2].discovery_hero_id) == ("me", 12, 5000.25, "two", None)
    assert {p.crawl_status for i, p in people.items() if i > 3} == {"error"}
    assert [(r.match_uid, r.map_id) for r in store.read("matches").collect()] == [("m1", 5)]
    assert {r.hero_id: r.last_seeded_at for r in store.read("heroes").collect()}[12] == 1000
    assert crawl.run(store, payloads.Landed(spark, str(tmp_path / "landed")), 19, stop=lambda: True, say=said.append) == 0

    class Broken:
        def boards(self):
            raise OSError("no answer")

    assert crawl.tick(store, Broken().boards, 10**6, said.append) == {"done": 1, "error": 1, "claimed": 0}  # players are put back all the same
    assert "no answer" in said[-2] and store.read("players").where("crawl_status = 'pending'").count() > 0
    main(["--store", path, "--status"])
    assert capsys.readouterr().out.startswith("matches=1 ")
    with pytest.raises(SystemExit):
        main(["--store", path, "--status", "--workers", "0"])
