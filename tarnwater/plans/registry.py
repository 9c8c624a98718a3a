"""Every registered query with its DuckDB oracle.

The tables of the crawl do not exist among the driver's, so the operators run on tables in the same
role: customers as queue entries tagged by nation, orders as matches, line items as players and
bans of matches, events as state changes and as a log of responses.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.devalue import resolve
from ..functions.devalue_native import resolved
from ..functions.expressions import eta, rank_blob, response_class
from ..operators import analytics, changelog, crawl, folds, frontier, history, ingest, metrics, quality, seeding, shred, states
from ..operators.store import Store, folder
from ..sources import payloads
from ..streaming import jobs

QUERIES = {}
ORACLE_SQL = {}

#: Every query measures time against this instant, in seconds.
NOW = 1706659200  # 2024-01-31
STATUS = {"view": "pending", "click": "claimed", "purchase": "done", "error": "error", "signup": "not_indexed"}

# -- oracle fragments -----------------------------------------------------------------------------
_STATUS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()) + " END"
_PLAYERS = f"""latest AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events),
    players AS (SELECT user_id AS uid, {_STATUS_SQL} AS crawl_status,
                       CASE WHEN event_id % 7 <> 0 THEN epoch_us(ts) // 1000000 - (user_id % 5) * 20000 END AS last_crawled_at,
                       CASE WHEN event_type = 'click' AND event_id % 11 <> 0 THEN epoch_us(ts) // 1000000 END AS claimed_at
                FROM latest WHERE rn = 1)"""
_LOG = "log AS (SELECT user_id AS client, epoch_us(ts) * 1000 + event_id % 1000 AS seq, epoch_us(ts) / 1000000.0::DOUBLE AS sec, event_type = 'error' AS failed, value / 20 AS latency FROM events)"
_ENTRIES = """entries AS (SELECT o_custkey AS uid, (rn // 5) * 5 AS skip, rn % 5 AS pos, CASE WHEN (o_custkey + rn // 5) % 4 = 0 THEN 4 ELSE 5 END AS page_size, m AS match_uid
                FROM (SELECT *, o_orderkey // 3 AS m, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) - 1 AS rn FROM orders)),
    known AS (SELECT DISTINCT l_orderkey // 3 AS match_uid FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey % 3 = 0),
    visited AS (SELECT c_custkey AS uid, CASE WHEN c_custkey % 2 = 0 THEN 1 END AS last_crawled_at FROM customer)"""
_MATCHES = """matches AS (SELECT o_orderkey AS match_uid, o_orderstatus AS season, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS winner_side FROM orders),
    mplayers AS (SELECT DISTINCT l_orderkey AS match_uid, l_partkey AS player_uid, l_extendedprice AS new_score, l_discount AS add_score, CAST(l_suppkey % 2 + 1 AS INT) AS camp, CAST(l_linestatus = 'F' AS INT) AS is_win FROM lineitem WHERE l_returnflag <> 'R'),
    bans AS (SELECT DISTINCT l_orderkey AS match_uid, l_linenumber AS round_idx, CAST(l_suppkey % 2 AS INT) AS battle_side, CAST(l_suppkey AS INT) AS hero_id, 0 AS is_pick FROM lineitem WHERE l_returnflag = 'R')"""


def query(sql=None):
    """Register a function (spark, sf_dir) under its own name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# -- tables in their roles ------------------------------------------------------------------------
def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c):
    """Microseconds since 1970 of a timestamp without zone, read as UTC."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})")


def entries_to_crawl(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    tag = F.when(F.col("c_custkey") % 10 != 0, F.col("c_nationkey"))
    return c.select(F.col("c_custkey").alias("uid"), tag.alias("discovery_hero_id"), (F.col("c_custkey") % 3).alias("created_at"))


def segments(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey")
    c = table(spark, sf_dir, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("hero_id"))
    return o.join(c, "o_custkey").select("hero_id")


def players(spark, sf_dir):
    e = changelog.latest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    seconds = (micros("ts") / 1000000).cast("long")
    status = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])[F.col("event_type")]
    return e.select(
        F.col("user_id").alias("uid"), status.alias("crawl_status"),
        F.when(F.col("event_id") % 7 != 0, seconds - F.col("user_id") % 5 * 20000).alias("last_crawled_at"),
        F.when((F.col("event_type") == "click") & (F.col("event_id") % 11 != 0), seconds).alias("claimed_at"),
    )


def log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("client"), (micros("ts") * 1000 + F.col("event_id") % 1000).alias("seq"), (micros("ts") / F.lit(1000000.0)).alias("at"), (F.col("event_type") == "error").alias("failed"), (F.col("value") / 20).alias("latency"))


def history_entries(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.floor(F.col("o_orderkey") / 3).alias("match_uid"), (F.row_number().over(w) - 1).alias("rn"))
    page = F.floor(F.col("rn") / 5)
    return rows.select(F.col("o_custkey").alias("uid"), (page * 5).alias("skip"), (F.col("rn") % 5).cast("long").alias("pos"), F.when((F.col("o_custkey") + page) % 4 == 0, 4).otherwise(5).alias("page_size"), "match_uid")


def known_matches(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_suppkey % 3 = 0").select(F.floor(F.col("l_orderkey") / 3).alias("match_uid")).distinct()


def visited(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid"), F.when(F.col("c_custkey") % 2 == 0, 1).alias("last_crawled_at"))


def match_tables(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    matches = o.select(F.col("o_orderkey").alias("match_uid"), F.col("o_orderstatus").alias("season"), F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(2).alias("winner_side"))
    people = li.where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("match_uid"), F.col("l_partkey").alias("player_uid"), F.col("l_extendedprice").alias("new_score"), F.col("l_discount").alias("add_score"), (F.col("l_suppkey") % 2 + 1).cast("int").alias("camp"), (F.col("l_linestatus") == "F").cast("int").alias("is_win")).distinct()
    bans = li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("match_uid"), F.col("l_linenumber").alias("round_idx"), (F.col("l_suppkey") % 2).cast("int").alias("battle_side"), F.col("l_suppkey").cast("int").alias("hero_id"), F.lit(0).alias("is_pick")).distinct()
    return matches, people, bans


# -- frontier and state ---------------------------------------------------------------------------
_COV = """cov AS (SELECT c.c_nationkey AS hero_id FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_nationkey < 20),
    cnt AS (SELECT hero_id, count(*) AS covered FROM cov GROUP BY 1),
    q AS (SELECT c_custkey AS uid, CASE WHEN c_custkey % 10 <> 0 THEN c_nationkey END AS tag, c_custkey % 3 AS created_at FROM customer),
    ranked AS (SELECT uid, created_at, covered, CAST(CASE WHEN tag IS NULL THEN 999999999 ELSE coalesce(covered, 0) END AS BIGINT) AS priority FROM q LEFT JOIN cnt ON tag = hero_id)"""


@query(f"WITH {_COV} SELECT uid, created_at, covered, priority FROM ranked ORDER BY priority, created_at, uid LIMIT 50")
def frontier_topk(spark, sf_dir):
    """Work items of the least covered tag first, untagged ones last."""
    return frontier.top(entries_to_crawl(spark, sf_dir), segments(spark, sf_dir), "hero_id", 50).select("uid", "created_at", "covered", F.col("priority").cast("long").alias("priority"))


@query(f"WITH {_COV} SELECT uid, CAST(row_number() OVER (ORDER BY priority, created_at, uid) - 1 AS BIGINT) AS slot, CAST((row_number() OVER (ORDER BY priority, created_at, uid) - 1) % 3 AS BIGINT) AS worker FROM ranked ORDER BY priority, created_at, uid LIMIT 30")
def claim_batch(spark, sf_dir):
    """A batch of the queue dealt to three workers."""
    top = frontier.top(entries_to_crawl(spark, sf_dir), segments(spark, sf_dir), "hero_id", 30)
    return frontier.assign(top, 3).select("uid", F.col("slot").cast("long").alias("slot"), F.col("worker").cast("long").alias("worker"))


@query(f"WITH {_PLAYERS} SELECT uid, CASE WHEN crawl_status = 'pending' AND uid % 2 = 0 THEN 'claimed' ELSE crawl_status END AS crawl_status, last_crawled_at, CASE WHEN crawl_status = 'pending' AND uid % 2 = 0 THEN {NOW} ELSE claimed_at END AS claimed_at FROM players")
def claim_pending(spark, sf_dir):
    """Chosen entries become claimed, if they are pending."""
    rows = players(spark, sf_dir)
    return states.claim(rows, rows.where("uid % 2 = 0"), NOW)


@query(f"WITH {_PLAYERS} SELECT uid, CASE WHEN crawl_status = 'claimed' THEN 'pending' ELSE crawl_status END AS crawl_status, last_crawled_at, CASE WHEN crawl_status = 'claimed' THEN NULL ELSE claimed_at END AS claimed_at FROM players")
def release_claims(spark, sf_dir):
    """Claims given back."""
    return states.release(players(spark, sf_dir))


@query(f"WITH {_PLAYERS} SELECT uid, CASE WHEN uid % 3 = 0 THEN 'error' ELSE crawl_status END AS crawl_status, CASE WHEN uid % 3 = 0 THEN {NOW} ELSE last_crawled_at END AS last_crawled_at, CASE WHEN uid % 3 = 0 THEN NULL ELSE claimed_at END AS claimed_at FROM players")
def terminal_status(spark, sf_dir):
    """Outcomes of visits written."""
    rows = players(spark, sf_dir)
    return states.finish(rows, rows.where("uid % 3 = 0").select("uid", F.lit("error").alias("outcome")), NOW)


_STALE = {"done": f"crawl_status = 'done' AND last_crawled_at < {NOW - 43200}", "error": f"crawl_status = 'error' AND last_crawled_at < {NOW - 3600}", "claimed": f"crawl_status = 'claimed' AND claimed_at < {NOW - 3600}"}


@query(f"""WITH {_PLAYERS} SELECT uid, CASE WHEN {_STALE['done']} OR {_STALE['error']} OR {_STALE['claimed']} THEN 'pending' ELSE crawl_status END AS crawl_status,
    CASE WHEN {_STALE['error']} OR {_STALE['claimed']} THEN NULL ELSE last_crawled_at END AS last_crawled_at, CASE WHEN {_STALE['claimed']} THEN NULL ELSE claimed_at END AS claimed_at FROM players""")
def requeue_stale(spark, sf_dir):
    """Entries whose time is over return to the queue."""
    return states.requeue(players(spark, sf_dir), NOW)


@query(f"WITH {_PLAYERS} SELECT count(*) FILTER ({_STALE['done']}) AS n_done, count(*) FILTER ({_STALE['error']}) AS n_error, count(*) FILTER ({_STALE['claimed']}) AS n_claimed FROM players")
def requeue_counts(spark, sf_dir):
    """How many would return, by kind."""
    return states.requeue_counts(players(spark, sf_dir), NOW)


@query("""SELECT event_id AS uid, CASE WHEN value < 13 AND event_id % 2 = 0 THEN 'skipped_floor' WHEN event_type = 'error' THEN 'not_indexed' WHEN event_type = 'signup' THEN 'skipped_private'
    WHEN event_type <> 'view' AND value / 2 < 13 THEN 'skipped_floor' ELSE 'done' END AS outcome FROM events""")
def crawl_classifier(spark, sf_dir):
    """The chain of rules that ends a visit."""
    e = table(spark, sf_dir, "events")
    visits = e.select(F.col("event_id").alias("uid"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("known_level"), F.when(F.col("event_type") == "error", 404).otherwise(200).alias("http_status"), (F.col("event_type") != "signup").alias("visible"), F.when(F.col("event_type") != "view", F.col("value") / 2).alias("level"))
    return visits.select("uid", states.classify(visits).alias("outcome"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'done' END AS status, event_type NOT IN ('error', 'purchase') AS released, event_type IN ('click', 'view') AS backs_off FROM events""")
def outcome_routing(spark, sf_dir):
    """What each way in which a visit ends leads to."""
    kind = F.create_map(*[F.lit(x) for kv in {"error": "fetch_failed", "purchase": "finished", "click": "circuit_open", "view": "limited", "signup": "crashed"}.items() for x in kv])
    return table(spark, sf_dir, "events").withColumn("kind", kind[F.col("event_type")]).select("event_id", *states.route("kind"))


# -- change log -----------------------------------------------------------------------------------
@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_suppkey DESC, l_partkey DESC) AS rn FROM lineitem) WHERE rn = 1""")
def upsert_latest(spark, sf_dir):
    """The last write of each key."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    last = changelog.fold(changelog.writes(rows, ["l_partkey", "l_suppkey", "l_quantity"], F.struct("l_shipdate", "l_suppkey", "l_partkey")), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity"])
    return last


@query("""SELECT user_id, arg_min_null(CASE WHEN event_id % 3 <> 0 THEN event_type END, event_id) AS tag FROM events GROUP BY 1""")
def first_tag_wins(spark, sf_dir):
    """The first write of a column stays, null included."""
    rows = table(spark, sf_dir, "events").withColumn("tag", F.when(F.col("event_id") % 3 != 0, F.col("event_type")))
    return changelog.earliest_value(rows, ["user_id"], "tag", "event_id")


@query("""SELECT user_id, arg_max_null(CASE WHEN event_id % 5 <> 0 THEN value END, event_id) FILTER (event_type <> 'view') AS score, arg_max_null(event_type, event_id) FILTER (event_id % 2 = 0) AS kind, arg_min_null(props, event_id) FILTER (event_type = 'signup') AS origin FROM events GROUP BY 1""")
def partial_upsert_fold(spark, sf_dir):
    """Writes of some columns each: absent ones stay, nulls overwrite, first ones hold."""
    e = table(spark, sf_dir, "events")
    written = F.array_compact(F.array(F.when(F.col("event_type") != "view", "score"), F.when(F.col("event_id") % 2 == 0, "kind"), F.when(F.col("event_type") == "signup", "origin")))
    rows = e.select("user_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("score"), F.col("event_type").alias("kind"), F.col("props").alias("origin"), F.col("event_id").alias("seq"), written.alias("set_cols"))
    return changelog.fold(rows, ["user_id"], ["score", "kind"], ["origin"])


# -- histories ------------------------------------------------------------------------------------
_SCAN = f"""WITH {_ENTRIES},
    k AS (SELECT e.*, v.last_crawled_at IS NOT NULL AS revisit, kn.match_uid IS NOT NULL OR row_number() OVER (PARTITION BY e.uid, e.match_uid ORDER BY skip, pos) > 1 AS is_known
          FROM entries e LEFT JOIN known kn USING (match_uid) LEFT JOIN visited v ON v.uid = e.uid),
    m AS (SELECT *, bool_or(is_known) OVER (PARTITION BY uid ORDER BY skip, pos) AS met FROM k)
    SELECT uid, skip, pos, match_uid FROM m WHERE NOT is_known AND """


@query(_SCAN + "NOT revisit")
def history_first_crawl(spark, sf_dir):
    """First visits take every unknown entry."""
    v = visited(spark, sf_dir)
    found = history.scan(history_entries(spark, sf_dir), known_matches(spark, sf_dir), v)
    return found.join(v.where("last_crawled_at IS NULL"), "uid", "left_semi").select("uid", "skip", "pos", "match_uid")


@query(_SCAN + "revisit AND NOT met")
def history_revisit(spark, sf_dir):
    """Revisits stop at the first known entry."""
    v = visited(spark, sf_dir)
    found = history.scan(history_entries(spark, sf_dir), known_matches(spark, sf_dir), v)
    return found.join(v.where("last_crawled_at IS NOT NULL"), "uid", "left_semi").select("uid", "skip", "pos", "match_uid")


def landed_pages(spark, sf_dir):
    """Raw pages of the histories: some short, some empty, some with entries of another mode or of none; some are
    missing, have failed, were limited or can't be read; some were landed before, shorter, without a status."""
    e = history_entries(spark, sf_dir)
    page = F.floor(F.col("skip") / 5)
    mode = F.when(F.col("match_uid") % 5 == 0, 1.0).when(F.col("match_uid") % 7 != 0, 2.0)
    entry = F.struct(F.col("match_uid").cast("string").alias("match_uid"), F.lit(5.0).alias("match_map_id"), mode.alias("game_mode_id"))
    sent = F.col("pos") < F.when((F.col("uid") + page) % 11 == 0, 0).otherwise(F.col("page_size"))
    content = F.sort_array(F.collect_list(F.when(sent, F.struct("pos", entry.alias("entry")))))
    rows = e.groupBy("uid", "skip").agg(content.alias("page")).where((F.col("uid") * 7 + page) % 13 != 5)
    raw = F.to_json(F.transform("page", lambda x: x["entry"]))
    turn = (F.col("uid") + page * 2) % 17
    now = rows.select("uid", "skip", F.when(turn == 3, 503).when(turn == 4, 429).otherwise(200).alias("http_status"), F.when((F.col("uid") + page * 3) % 19 == 7, "<html>").otherwise(raw).alias("raw"), F.lit(2).alias("landed_at"))
    before = rows.where((F.col("uid") + page) % 3 == 0).select("uid", "skip", F.lit(200).alias("http_status"), F.lit('[{"match_uid":"0"}]').alias("raw"), F.lit(1).alias("landed_at"))
    return now.unionByName(before)


_PAGES = """sent AS (SELECT uid, skip, pos, match_uid, CASE WHEN match_uid % 5 = 0 THEN 1 WHEN match_uid % 7 <> 0 THEN 2 END AS mode FROM entries WHERE pos < CASE WHEN (uid + skip // 5) % 11 = 0 THEN 0 ELSE page_size END),
    pg AS (SELECT uid, skip, count(sent.pos) AS n, CASE WHEN (uid + skip // 5 * 2) % 17 = 3 THEN 'failed' WHEN (uid + skip // 5 * 2) % 17 = 4 THEN 'limited' WHEN (uid + skip // 5 * 3) % 19 = 7 THEN 'failed' ELSE 'ok' END AS kind,
                  skip = (row_number() OVER (PARTITION BY uid ORDER BY skip) - 1) * 5 AS here
           FROM (SELECT DISTINCT uid, skip FROM entries WHERE (uid * 7 + skip // 5) % 13 <> 5) LEFT JOIN sent USING (uid, skip) GROUP BY 1, 2),
    t AS (SELECT *, coalesce(bool_or(NOT here OR kind <> 'ok' OR n < 5) OVER (PARTITION BY uid ORDER BY skip ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended FROM pg),
    reached AS (SELECT uid, skip, n, kind FROM t WHERE here AND NOT ended),
    listed AS (SELECT uid, skip, pos, match_uid FROM sent JOIN reached USING (uid, skip) WHERE kind = 'ok' AND coalesce(mode, 2) = 2)"""


@query(f"WITH {_ENTRIES}, {_PAGES} SELECT uid, skip, pos, CAST(match_uid AS VARCHAR) AS match_uid FROM listed")
def page_termination(spark, sf_dir):
    """Nothing after a page that is not full (be it empty or of other modes altogether), that is missing or that
    can't be read; of a page that was landed twice the later one counts."""
    return payloads.history(landed_pages(spark, sf_dir), full=5).select("uid", "skip", F.col("pos").cast("long").alias("pos"), "match_uid")


@query(f"WITH {_ENTRIES} SELECT uid, skip, pos, match_uid FROM entries ANTI JOIN known USING (match_uid)")
def known_antijoin(spark, sf_dir):
    """Entries that the store does not have."""
    return history.unknown(history_entries(spark, sf_dir), known_matches(spark, sf_dir)).select("uid", "skip", "pos", "match_uid")


@query(f"""WITH {_ENTRIES}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_uid ORDER BY uid, skip, pos) AS rn FROM entries) WHERE rn = 1)
    SELECT f.match_uid, f.uid, o_orderpriority AS map_id FROM f LEFT JOIN orders ON o_orderkey = f.match_uid AND o_orderstatus = 'F'""")
def history_detail_join(spark, sf_dir):
    """One fetch per match, with its detail where there is one."""
    detail = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("match_uid"), F.col("o_orderpriority").alias("map_id"))
    return history.with_details(history.work_list(history_entries(spark, sf_dir)), detail).select("match_uid", "uid", "map_id")


# -- seeding --------------------------------------------------------------------------------------
@query("""WITH s AS (SELECT o_custkey AS uid, CAST(o_orderkey % 40 AS INT) AS tag, 0 AS src, o_orderkey % 40 AS h, o_orderkey AS p FROM orders WHERE o_orderstatus = 'F'
        UNION ALL SELECT o_custkey, NULL, 1, 0, o_orderkey FROM orders WHERE o_orderstatus <> 'F'),
    f AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY src, h, p) AS rn FROM s)
    SELECT uid, tag FROM f WHERE rn = 1 AND uid NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)""")
def seed_precedence(spark, sf_dir):
    """Hero boards before the global one; known ids are no seeds."""
    o = table(spark, sf_dir, "orders")
    heroes = o.where("o_orderstatus = 'F'").select((F.col("o_orderkey") % 40).cast("int").alias("hero_id"), F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("uid"), F.lit("h").alias("nick_name"))
    everyone = o.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("uid"), F.lit("g").alias("nick_name"))
    stored = table(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("uid"))
    return seeding.new_seeds(seeding.seeds(heroes, everyone), stored).select("uid", "tag")


_BOARDS = f"""h AS (SELECT CAST(range AS INT) AS hero_id, CASE range % 4 WHEN 1 THEN {NOW - 100} WHEN 0 THEN NULL ELSE {NOW - 100000} END AS last_seeded_at FROM range(40)),
    board AS (SELECT CAST(o_orderkey % 40 AS INT) AS hero_id, o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 10 <> 7),
    due AS (SELECT hero_id FROM h WHERE (last_seeded_at IS NULL OR last_seeded_at < {NOW - 86400}) AND hero_id IN (SELECT hero_id FROM board))"""


def boards(spark, sf_dir):
    """(players, heroes, hero boards, global board): every tenth hero's board is broken, some were read lately."""
    o = table(spark, sf_dir, "orders")
    entry = F.struct(F.col("o_custkey").alias("player_uid"), F.struct(F.concat(F.lit("b"), "o_orderkey").alias("name")).alias("info"))
    board = F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", entry.alias("e")))), lambda x: x["e"])
    heroes = o.where("o_orderstatus = 'F'").groupBy((F.col("o_orderkey") % 40).cast("int").alias("hero_id")).agg(board.alias("players"))
    heroes = heroes.select("hero_id", F.when(F.col("hero_id") % 10 == 7, "{broken").otherwise(F.to_json(F.struct("players"))).alias("raw"))
    everyone = o.where("o_orderstatus <> 'F'").select(F.format_string('[{"data":1},{"page":2},{"players":3},[4],{"name":5,"uid":6,"rank":7},"c%s","%s",{"rank_game_id":8},19]', "o_custkey", "o_custkey").alias("raw"))
    i = F.col("hero_id") % 4
    stamps = spark.range(40).select(F.col("id").cast("int").alias("hero_id")).withColumn("last_seeded_at", F.when(i == 1, NOW - 100).when(i != 0, NOW - 100000).cast("long"))
    stored = table(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("uid"))
    return stored, stamps, heroes, everyone


@query(f"""WITH {_BOARDS}, s AS (SELECT o_custkey AS uid, 'b' || o_orderkey AS nick_name, hero_id AS tag, 0 AS src, hero_id AS h, o_orderkey AS p FROM board JOIN due USING (hero_id)
        UNION ALL SELECT o_custkey, 'c' || o_custkey, NULL, 1, 0, 0 FROM orders WHERE o_orderstatus <> 'F'),
    f AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY src, h, p) AS rn FROM s)
    SELECT uid, nick_name, tag AS discovery_hero_id, 'pending' AS crawl_status, {NOW} AS created_at FROM f WHERE rn = 1 AND uid NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)""")
def reseed(spark, sf_dir):
    """Players that raw boards bring, with names, tags and status."""
    return seeding.reseeded(*boards(spark, sf_dir), NOW)[0]


@query(f"WITH {_BOARDS} SELECT hero_id, CASE WHEN hero_id IN (SELECT hero_id FROM due) THEN {NOW} ELSE last_seeded_at END AS last_seeded_at FROM h")
def reseed_stamps(spark, sf_dir):
    """Heroes whose boards were read are stamped; a broken board is left for the next time."""
    return seeding.reseeded(*boards(spark, sf_dir), NOW)[1]


# -- visits ---------------------------------------------------------------------------------------
_VISITS = """v AS (SELECT c_custkey AS uid, 'n' || c_custkey AS name, c_nationkey AS lvl, c_acctbal, CASE WHEN c_custkey % 13 = 0 THEN 5 END AS known,
        CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 404 WHEN c_custkey % 17 = 0 THEN 503 WHEN c_custkey % 29 = 0 THEN 429 WHEN c_custkey % 31 = 0 THEN 418 ELSE 200 END AS status, c_custkey % 23 = 0 AS broken, c_custkey % 5 <> 0 AS visible, c_custkey % 3 = 0 AS other FROM customer),
    o AS (SELECT *, CASE WHEN known < 13 THEN 'skipped_floor' WHEN status IS NULL OR status = 503 OR (status IN (200, 418) AND broken) THEN 'error' WHEN status = 429 THEN 'limited' WHEN status = 404 THEN 'not_indexed' WHEN NOT visible THEN 'skipped_private' WHEN NOT other AND lvl < 13 THEN 'skipped_floor' ELSE 'done' END AS outcome,
        known IS NULL AND coalesce(status, 0) IN (200, 418) AND NOT broken AS profiled FROM v)"""


def landed_profiles(spark, sf_dir):
    """Raw profiles: some not there, failed, limited, not found or broken; every fourth was landed before, with a
    level that no longer holds, as a success or a failure."""
    c, i = table(spark, sf_dir, "customer"), F.col("c_custkey")
    rank = lambda level: F.to_json(F.struct(F.struct(level.cast("double").alias("level"), F.col("c_acctbal").alias("rank_score")).alias("rank_game")))
    info = lambda level: F.create_map(F.lit("name"), F.concat(F.lit("n"), i), F.when(i % 3 == 0, "rank_game_1001018").otherwise("rank_game_1001019"), rank(level))
    raw = lambda level: F.to_json(F.struct(F.struct(info(level).alias("info")).alias("player"), F.struct((i % 5 != 0).alias("match_history")).alias("visibility")))
    status = F.when(i % 11 == 0, 404).when(i % 17 == 0, 503).when(i % 29 == 0, 429).when(i % 31 == 0, 418).otherwise(200)
    rows = c.where(i % 19 != 0)
    now = rows.select(i.alias("uid"), status.alias("http_status"), F.when(i % 23 == 0, "<html>").otherwise(raw(F.col("c_nationkey"))).alias("raw"), F.lit(2).alias("landed_at"))
    before = rows.where(i % 4 == 0).select(i.alias("uid"), F.when(i % 8 == 0, 503).otherwise(200).alias("http_status"), raw(F.lit(99)).alias("raw"), F.lit(1).alias("landed_at"))
    return before.unionByName(now)


def claimed_players(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid"), F.when(F.col("c_custkey") % 13 == 0, 5).alias("latest_known_level"), F.when(F.col("c_custkey") % 2 == 0, 1).alias("last_crawled_at"))


_PROFILES = "SELECT uid, outcome, profiled, CASE WHEN profiled THEN name END AS nick_name, CASE WHEN profiled AND NOT other THEN CAST(lvl AS INT) END AS latest_known_level, CASE WHEN profiled AND NOT other THEN c_acctbal END AS latest_known_score FROM o"


@query(f"WITH {_VISITS} {_PROFILES}")
def crawl_batch(spark, sf_dir):
    """Outcomes and profiles of all visits of a round; of repeated responses the newest counts."""
    seen = crawl.visits(claimed_players(spark, sf_dir), landed_profiles(spark, sf_dir), 19)
    return seen.select("uid", "outcome", "profiled", *(F.when(F.col("profiled"), F.col(c)).alias(c) for c in ("nick_name", "latest_known_level", "latest_known_score")))


@query(f"WITH {_VISITS} {_PROFILES}")
def landed_source(spark, sf_dir):
    """The same from files of JSON lines, read by the data source in the order of their arrival."""
    at = folder(spark)
    rows = landed_profiles(spark, sf_dir)
    rows.select(F.to_json(F.struct("uid", "http_status", "raw", "landed_at")).alias("value")).write.text(f"{at}/profiles")
    seen = crawl.visits(claimed_players(spark, sf_dir), payloads.Landed(spark, at).read("profiles"), 19)
    return seen.select("uid", "outcome", "profiled", *(F.when(F.col("profiled"), F.col(c)).alias(c) for c in ("nick_name", "latest_known_level", "latest_known_score")))


_FOUND = f"""{_VISITS}, {_ENTRIES}, {_PAGES}, r AS (SELECT listed.* FROM listed JOIN o USING (uid) WHERE outcome = 'done'),
    k AS (SELECT r.*, r.uid % 2 = 0 AS revisit, kn.match_uid IS NOT NULL OR row_number() OVER (PARTITION BY r.uid, r.match_uid ORDER BY skip, pos) > 1 AS is_known FROM r LEFT JOIN known kn USING (match_uid)),
    m AS (SELECT *, bool_or(is_known) OVER (PARTITION BY uid ORDER BY skip, pos) AS met FROM k)"""


def known_uids(spark, sf_dir):
    return known_matches(spark, sf_dir).select(F.col("match_uid").cast("string").alias("match_uid"))


@query(f"WITH {_FOUND} SELECT CAST(match_uid AS VARCHAR) AS match_uid, min(uid) AS uid, 5 AS map_id FROM m WHERE NOT is_known AND (NOT revisit OR NOT met) GROUP BY match_uid")
def crawl_fetches(spark, sf_dir):
    """The matches that a round of visits has to fetch, each once."""
    claimed = claimed_players(spark, sf_dir)
    seen = crawl.visits(claimed, landed_profiles(spark, sf_dir), 19)
    return crawl.to_fetch(seen, claimed, landed_pages(spark, sf_dir), known_uids(spark, sf_dir), full=5).select("match_uid", "uid", "map_id")


def landed_details(spark, sf_dir):
    """Raw details: some failed, limited, not found, malformed, unreadable or not there; some had failed before."""
    m = F.col("m")
    rows = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 3).alias("m")).distinct().where(m % 29 != 4)
    raw = F.when(m % 29 == 5, '{"match_uid":null}').when(m % 29 == 6, "<html>").otherwise(F.to_json(F.struct(m.cast("string").alias("match_uid"))))
    now = rows.select(m.cast("string").alias("match_uid"), F.when(m % 29 == 1, 503).when(m % 29 == 2, 429).when(m % 29 == 3, 404).otherwise(200).alias("http_status"), raw.alias("raw"), F.lit(5).alias("landed_at"))
    before = rows.where(m % 7 == 0).select(m.cast("string").alias("match_uid"), F.lit(503).alias("http_status"), F.lit(None).cast("string").alias("raw"), F.lit(4).alias("landed_at"))
    return now.unionByName(before)


@query(f"""WITH {_FOUND}, stops AS (SELECT uid, min(skip * 100 + pos) AS stop FROM m WHERE revisit AND is_known GROUP BY 1),
    tail AS (SELECT o.uid, max(reached.skip) AS skip, arg_max(kind, reached.skip) AS kind, arg_max(n, reached.skip) AS n FROM o LEFT JOIN reached USING (uid) WHERE outcome = 'done' GROUP BY 1),
    holes AS (SELECT uid, CASE WHEN kind = 'ok' THEN skip + 5 ELSE coalesce(skip, 0) END AS skip, -1 AS pos, CASE WHEN kind = 'limited' THEN 'limited' ELSE 'failed' END AS kind FROM tail WHERE kind IS NULL OR kind <> 'ok' OR n >= 5),
    trouble AS (SELECT uid, skip, pos, kind FROM holes LEFT JOIN stops USING (uid) WHERE stop IS NULL OR skip * 100 + pos < stop
        UNION ALL SELECT uid, skip, pos, CASE WHEN match_uid % 29 = 2 THEN 'limited' ELSE 'failed' END FROM m WHERE NOT is_known AND (NOT revisit OR NOT met) AND match_uid % 29 IN (1, 2, 4, 6)),
    f AS (SELECT uid, arg_min(kind, skip * 100 + pos) AS kind, min(skip * 100 + pos) AS spot FROM trouble GROUP BY 1)
    SELECT uid, CASE WHEN f.kind IS NULL THEN outcome WHEN f.kind = 'limited' THEN 'limited' ELSE 'error' END AS outcome, CAST((spot + 1) // 100 AS BIGINT) AS skip, CAST(spot - (spot + 1) // 100 * 100 AS BIGINT) AS pos FROM o LEFT JOIN f USING (uid)""")
def visit_completeness(spark, sf_dir):
    """How visits end once their pages and details are held against what they wanted, and where the first gap is."""
    claimed, known = claimed_players(spark, sf_dir), known_uids(spark, sf_dir)
    seen = crawl.visits(claimed, landed_profiles(spark, sf_dir), 19)
    reached, found = crawl.read_histories(seen, claimed, landed_pages(spark, sf_dir), known, full=5)
    answers = payloads.answers(landed_details(spark, sf_dir))
    return crawl.complete(seen, history.troubles(found, reached, seen.where("outcome = 'done'"), answers, full=5))


@query("""SELECT s_suppkey, last_seeded_at FROM (SELECT s_suppkey, max(epoch_us(l_shipdate) // 1000000) FILTER (l_returnflag = 'R' AND l_suppkey % 4 <> 0) AS last_seeded_at FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1) WHERE last_seeded_at IS NULL OR last_seeded_at < 995000000""")
def stale_sources(spark, sf_dir):
    """Boards to read again."""
    seen = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_suppkey % 4 <> 0").select(F.col("l_suppkey").alias("s_suppkey"), (micros("l_shipdate") / 1000000).cast("long").alias("at"))
    sources = table(spark, sf_dir, "supplier").select("s_suppkey").join(seen.groupBy("s_suppkey").agg(F.max("at").alias("last_seeded_at")), "s_suppkey", "left")
    return seeding.stale_sources(sources, 995000000)


# -- metrics --------------------------------------------------------------------------------------
@query(f"WITH {_PLAYERS} SELECT crawl_status, count(*) AS n FROM players GROUP BY 1")
def status_counts(spark, sf_dir):
    return metrics.status_counts(players(spark, sf_dir))


@query("SELECT count(*) AS n FROM orders")
def match_count(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("n"))


@query(f"WITH {_COV} SELECT hero_id, covered FROM cnt")
def hero_coverage(spark, sf_dir):
    return frontier.coverage(segments(spark, sf_dir), "hero_id")


@query("WITH c AS (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey), l AS (SELECT list(n ORDER BY n) AS s FROM c) SELECT coalesce(s[1], 0) AS low, coalesce(s[len(s) // 2 + 1], 0) AS median, coalesce(s[len(s)], 0) AS high FROM l")
def coverage_min_median_max(spark, sf_dir):
    """Least, upper median and greatest coverage."""
    return metrics.spread(frontier.coverage(table(spark, sf_dir, "lineitem"), "l_suppkey"))


@query(f"WITH {_PLAYERS} SELECT count(*) FILTER (last_crawled_at >= {NOW - 86400}) AS n, count(*) FILTER (last_crawled_at >= {NOW - 86400}) / 1440.0::DOUBLE AS per_minute FROM players")
def recent_throughput(spark, sf_dir):
    return metrics.recent(players(spark, sf_dir), NOW, 86400)


@query("""WITH q AS (SELECT c_nationkey, count(*) FILTER (c_acctbal > 9000) AS pending, count(*) FILTER (c_acctbal < 0) / 30.0::DOUBLE * (c_nationkey % 3) AS rate FROM customer GROUP BY 1), m AS (SELECT *, CASE WHEN rate > 0 THEN pending / rate END AS minutes FROM q)
    SELECT c_nationkey, CASE WHEN pending = 0 THEN 'empty' WHEN rate <= 0 THEN 'unknown' WHEN minutes < 60 THEN 'minutes' WHEN minutes < 2880 THEN 'hours' ELSE 'days' END AS unit,
    CASE WHEN pending > 0 AND rate > 0 THEN CASE WHEN minutes < 60 THEN minutes WHEN minutes < 2880 THEN minutes / 60 ELSE minutes / 1440 END END AS amount FROM m""")
def eta_bucket(spark, sf_dir):
    """Time until each queue is empty, in its unit."""
    q = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") > 9000).alias("pending"), (F.count_if(F.col("c_acctbal") < 0) / F.lit(30.0)).alias("rate")).withColumn("rate", F.col("rate") * (F.col("c_nationkey") % 3))
    unit, amount = eta(F.col("pending"), F.nullif(F.col("rate"), F.lit(0.0)))
    unit = F.when(F.col("pending") == 0, "empty").when(F.col("rate") <= 0, "unknown").otherwise(unit)
    return q.select("c_nationkey", unit.alias("unit"), amount.alias("amount"))


@query(f"WITH {_PLAYERS} SELECT count(*) = 0 AS drained FROM players WHERE crawl_status IN ('pending', 'claimed')")
def queue_drained(spark, sf_dir):
    return metrics.drained(players(spark, sf_dir))


@query(f"""WITH {_PLAYERS}, {_COV}, c AS (SELECT crawl_status, count(*) AS n FROM players GROUP BY 1), l AS (SELECT list(covered ORDER BY covered) AS s FROM cnt),
    r AS (SELECT count(*) FILTER (crawl_status = 'pending') AS pending, count(*) FILTER (last_crawled_at >= {NOW - 86400}) / 1440.0::DOUBLE AS rate FROM players), e AS (SELECT *, CASE WHEN rate > 0 THEN pending / rate END AS minutes FROM r)
    SELECT 'matches=' || (SELECT count(*) FROM orders) || ' ' || (SELECT string_agg(crawl_status || '=' || n, ' ' ORDER BY crawl_status) FROM c)
        || ' hero_coverage(min/median/max)=' || (SELECT coalesce(s[1], 0) || '/' || coalesce(s[len(s) // 2 + 1], 0) || '/' || coalesce(s[len(s)], 0) FROM l)
        || ' rate=' || printf('%.1f', rate) || '/min eta_to_drain_queue=' || CASE WHEN pending = 0 THEN 'queue empty' WHEN rate <= 0 THEN 'unknown (no recent throughput)' WHEN minutes < 60 THEN printf('~%.0fm', minutes) WHEN minutes / 60 < 48 THEN printf('~%.1fh', minutes / 60) ELSE printf('~%.1fd', minutes / 1440) END AS line FROM e""")
def progress_line(spark, sf_dir):
    """The line that operators read."""
    line = metrics.progress_line(players(spark, sf_dir), table(spark, sf_dir, "orders"), segments(spark, sf_dir), NOW, 86400)
    return spark.createDataFrame([(line,)], "line string")


# -- shredding ------------------------------------------------------------------------------------
def landed_matches(spark, sf_dir):
    """Raw match documents made of orders and line items: every 17th lacks a player's id, every 19th is cut off."""
    of = ("l_linenumber", "l_partkey", "l_suppkey", "is_win", "l_quantity", "l_discount", "l_extendedprice", "l_tax", "is_ban")  # what moves, in the order of players
    li = table(spark, sf_dir, "lineitem").withColumns({"is_win": F.col("l_linestatus") == "F", "is_ban": F.col("l_returnflag") == "R"})
    docs = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*of))).alias("x"))

    def person(e):
        hero = F.struct((e["l_suppkey"] % 50).cast("double").alias("hero_id"), e["l_quantity"].alias("k"), F.lit(1.0).alias("d"), F.lit(2.0).alias("a"), e["l_tax"].alias("play_time"))
        fields = F.struct(e["l_discount"].alias("add_score"), F.lit(22.0).alias("level"), F.lit(22.0).alias("new_level"), e["l_extendedprice"].alias("new_score"))
        return F.struct(
            F.when((F.col("l_orderkey") % 17 != 0) | (e["l_linenumber"] != 1), e["l_partkey"]).alias("player_uid"), F.concat(F.lit("p"), e["l_partkey"]).alias("nick_name"), (e["l_suppkey"] % 2).cast("double").alias("camp"),
            (e["l_suppkey"] % 50).cast("double").alias("cur_hero_id"), e["is_win"].cast("double").alias("is_win"), e["l_quantity"].alias("k"), fields.alias("dynamic_fields"), F.array(hero).alias("player_heroes"),
        )

    def ban(e):
        return F.struct(e["l_linenumber"].cast("double").alias("round_idx"), F.lit(1.0).alias("battle_side"), (e["l_partkey"] % 50).cast("double").alias("hero_id"), F.lit(0.0).alias("is_pick"))

    doc = F.struct(
        F.col("l_orderkey").cast("string").alias("match_uid"), F.col("l_orderkey").alias("match_time_stamp"), F.concat(F.lit("9"), F.col("l_orderkey")).alias("replay_id"),
        F.struct(F.transform(F.filter("x", lambda e: e["is_ban"]), ban).alias("ban_pick_info")).alias("dynamic_fields"), F.transform("x", person).alias("match_players"),
    )
    raw = F.to_json(doc)
    return docs.select(F.when(F.col("l_orderkey") % 19 == 0, F.substring(raw, 1, 40)).otherwise(raw).alias("raw"), F.col("l_orderkey").alias("seq"))


_OK = "l_orderkey % 19 <> 0 AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 17 = 0 AND l_linenumber = 1)"


def admitted_matches(spark, sf_dir):
    return shred.admitted(payloads.matches(landed_matches(spark, sf_dir)))


@query(f"SELECT count(DISTINCT l_orderkey) FILTER ({_OK}) AS admitted, count(DISTINCT l_orderkey) FILTER (NOT ({_OK})) AS rejected FROM lineitem")
def admit_quarantine(spark, sf_dir):
    """Matches that enter whole and those that do not at all."""
    return shred.admission_counts(payloads.matches(landed_matches(spark, sf_dir)))


@query(f"SELECT CAST(l_orderkey AS VARCHAR) AS match_uid, l_partkey AS player_uid, CAST(l_suppkey % 2 AS INT) AS camp, CAST(l_quantity AS INT) AS k, l_discount AS add_score, l_extendedprice AS new_score, 22 AS new_level FROM lineitem WHERE {_OK}")
def shred_players(spark, sf_dir):
    """Players of nested matches."""
    return shred.player_rows(admitted_matches(spark, sf_dir)[0]).select("match_uid", "player_uid", "camp", "k", "add_score", "new_score", "new_level")


@query(f"SELECT CAST(l_orderkey AS VARCHAR) AS match_uid, l_linenumber AS round_idx, 1 AS battle_side, CAST(l_partkey % 50 AS INT) AS hero_id, 0 AS is_pick FROM lineitem WHERE {_OK} AND l_returnflag = 'R'")
def shred_bans(spark, sf_dir):
    """Bans of nested matches."""
    return shred.ban_rows(admitted_matches(spark, sf_dir)[0]).drop("seq", "pos")


@query(f"SELECT CAST(l_orderkey AS VARCHAR) AS match_uid, l_partkey AS player_uid, CAST(l_suppkey % 50 AS INT) AS hero_id, CAST(l_quantity AS INT) AS k, l_tax AS play_time FROM lineitem WHERE {_OK}")
def shred_segments(spark, sf_dir):
    """Two levels down: hero segments of players of matches."""
    return shred.segment_rows(admitted_matches(spark, sf_dir)[0]).select("match_uid", "player_uid", "hero_id", "k", "play_time")


@query(f"SELECT DISTINCT CAST(h AS INT) AS hero_id FROM (SELECT l_suppkey % 50 AS h FROM lineitem WHERE {_OK} UNION ALL SELECT l_partkey % 50 FROM lineitem WHERE {_OK} AND l_returnflag = 'R')")
def heroes_seen(spark, sf_dir):
    return shred.heroes_seen(admitted_matches(spark, sf_dir)[0])


@query(f"""WITH w AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem WHERE {_OK} AND l_linestatus = 'F')
    SELECT CAST(m.k AS VARCHAR) AS match_uid, CAST('9' || m.k AS BIGINT) AS replay_id, CAST(l_suppkey % 2 AS INT) AS winner_side FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE {_OK}) m LEFT JOIN w ON l_orderkey = m.k AND rn = 1""")
def first_match_element(spark, sf_dir):
    """Camp of the first winner, and the replay id out of its text."""
    return shred.match_rows(admitted_matches(spark, sf_dir)[0], 19, NOW).select("match_uid", "replay_id", "winner_side")


@query("SELECT conv_id, turn, role, length(text) AS n FROM conversations")
def shred_reassemble(spark, sf_dir):
    """Turns into arrays and back."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return c.select("conv_id", F.inline("turns")).select("conv_id", "turn", "role", F.char_length("text").cast("long").alias("n"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k DOUBLE")["k"].cast("int").alias("k"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 7 <> 0 THEN CAST(c_nationkey AS INT) END AS level, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 7 <> 0 THEN c_acctbal END AS score FROM customer")
def rank_blob_of_season(spark, sf_dir):
    """Doubly encoded ranks under a key that depends on the season; null where missing or broken."""
    inner = F.to_json(F.struct(F.struct(F.col("c_nationkey").cast("double").alias("level"), F.col("c_acctbal").alias("rank_score")).alias("rank_game")))
    info = F.create_map(F.when(F.col("c_custkey") % 3 == 0, "rank_game_1001018").otherwise("rank_game_1001019"), F.when(F.col("c_custkey") % 7 == 0, "{broken").otherwise(inner))
    raw = table(spark, sf_dir, "customer").select("c_custkey", F.to_json(F.struct(F.struct(info.alias("info")).alias("player"))).alias("raw"))
    return raw.withColumn("r", rank_blob("raw", F.lit(19))).select("c_custkey", "r.level", "r.score")


_RESOLVED = """SELECT c_custkey, '{"players":[{"name":"' || c_name || '","uid":' || c_custkey || '},{"name":"' || c_name || '","uid":' || c_custkey || '}]}' AS resolved FROM customer"""


def flat_arrays(spark, sf_dir):
    """Flat reference arrays, one per customer, with a wrapper and a shared entry."""
    head = '[{"data":1},{"page":2},["Reactive",3],{"players":4},[5,5],{"uid":6,"name":7},'
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit(head), F.col("c_custkey").cast("string"), F.lit(',"'), F.col("c_name"), F.lit('"]')).alias("raw"))


@query(_RESOLVED)
def devalue_resolve(spark, sf_dir):
    """Flat reference arrays resolved in Arrow batches."""
    return flat_arrays(spark, sf_dir).select("c_custkey", resolve("raw").alias("resolved"))


@query(_RESOLVED)
def devalue_native(spark, sf_dir):
    """The same as one recursive query."""
    return resolved(flat_arrays(spark, sf_dir).withColumnRenamed("c_custkey", "id")).withColumnRenamed("id", "c_custkey")


# -- quality and analysis -------------------------------------------------------------------------
@query(f"WITH {_MATCHES} SELECT match_uid, count(*) AS n FROM mplayers GROUP BY 1 HAVING count(*) <> 3")
def group_size_violations(spark, sf_dir):
    return quality.group_sizes(match_tables(spark, sf_dir)[1], "match_uid", 3)


@query(f"WITH {_MATCHES}, s AS (SELECT match_uid, min(camp) AS low, max(camp) AS high FROM mplayers WHERE is_win <> 0 GROUP BY 1) SELECT match_uid, winner_side, low, high FROM matches LEFT JOIN s USING (match_uid) WHERE low IS NULL OR low <> high OR winner_side <> low")
def winner_consistency(spark, sf_dir):
    return quality.winner_conflicts(*match_tables(spark, sf_dir)[:2])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ANTI JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey")
def fk_orphans(spark, sf_dir):
    parents = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return quality.orphans(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), parents, "l_orderkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def pk_duplicates(spark, sf_dir):
    return quality.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT count(*) FILTER (event_type = 'signup') AS missing, count(*) AS n FROM events")
def attrition(spark, sf_dir):
    return quality.attrition(table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "signup", 404).otherwise(200).alias("http_status")))


@query(f"WITH {_MATCHES} SELECT match_uid, player_uid, season, round_idx, hero_id, new_score - add_score AS pre_score FROM mplayers JOIN matches USING (match_uid) JOIN bans USING (match_uid)")
def regression_join(spark, sf_dir):
    """Matches, players and bans, one row for each pair of the latter."""
    return analytics.exploded(*match_tables(spark, sf_dir)).select("match_uid", "player_uid", "season", "round_idx", "hero_id", "pre_score")


@query(f"""WITH {_MATCHES}, b AS (SELECT match_uid, string_agg(round_idx || ':' || hero_id, ',' ORDER BY round_idx, battle_side, hero_id) AS bans FROM bans GROUP BY 1) SELECT match_uid, player_uid, season, bans, new_score - add_score AS pre_score FROM mplayers JOIN matches USING (match_uid) LEFT JOIN b USING (match_uid)""")
def regression_nested(spark, sf_dir):
    """The same without fan-out: bans in one ordered list."""
    rows = analytics.nested(*match_tables(spark, sf_dir))
    return rows.select("match_uid", "player_uid", "season", F.array_join(F.transform("bans", lambda b: F.concat_ws(":", b["round_idx"], b["hero_id"])), ",").alias("bans"), "pre_score")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice - l_discount AS pre_score FROM lineitem")
def pre_score(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("new_score"), F.col("l_discount").alias("add_score"))
    return analytics.before_score(rows).drop("new_score", "add_score")


# -- responses ------------------------------------------------------------------------------------
@query("""WITH r AS (SELECT event_id, event_type = 'signup' AS broken, CASE event_id % 7 WHEN 0 THEN 404 WHEN 1 THEN 429 WHEN 2 THEN 403 WHEN 3 THEN 503 WHEN 4 THEN 418 ELSE 200 END AS code FROM events)
    SELECT event_id, CASE WHEN broken THEN 'failed' WHEN code = 404 THEN 'missing' WHEN code IN (429, 403) THEN 'limited' WHEN code >= 500 THEN 'failed' ELSE 'ok' END AS class FROM r""")
def status_classification(spark, sf_dir):
    code = F.element_at(F.array(*map(F.lit, (404, 429, 403, 503, 418, 200, 200))), (F.col("event_id") % 7 + 1).cast("int"))
    e = table(spark, sf_dir, "events").select("event_id", code.alias("status"), (F.col("event_type") == "signup").alias("broken"))
    return e.select("event_id", response_class("status", F.col("broken")).alias("class"))


@query(f"WITH {_LOG}, i AS (SELECT *, count(*) FILTER (NOT failed) OVER (PARTITION BY client ORDER BY seq) AS island FROM log) SELECT client, min(seq) AS first, count(*) AS length FROM i WHERE failed GROUP BY client, island HAVING count(*) >= 2")
def failure_streaks(spark, sf_dir):
    return folds.failure_streaks(log(spark, sf_dir))


_PACE = f"""WITH RECURSIVE {_LOG}, o AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY seq) AS i, count(*) OVER (PARTITION BY client) AS n FROM log),
    f AS (SELECT DISTINCT client, 0::BIGINT AS i, 1.0::DOUBLE AS delay, 0 AS streak FROM log
          UNION ALL SELECT o.client, o.i, CASE WHEN failed THEN least(8.0::DOUBLE, delay * 2.0::DOUBLE) WHEN latency > 2.0 THEN least(8.0::DOUBLE, delay * 1.5::DOUBLE) WHEN streak + 1 >= 3 THEN greatest(0.2::DOUBLE, delay * 0.95::DOUBLE) ELSE delay END,
                 CASE WHEN failed OR latency > 2.0 THEN 0 ELSE streak + 1 END FROM f JOIN o ON o.client = f.client AND o.i = f.i + 1)"""


@query(_PACE + " SELECT f.client, delay, streak FROM f JOIN (SELECT client, max(i) AS i FROM f GROUP BY 1) USING (client, i)")
def adaptive_delay(spark, sf_dir):
    """The pace that each client's log leads to."""
    return folds.adaptive_delay(log(spark, sf_dir))


@query(f"""WITH RECURSIVE {_LOG}, o AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY seq) AS i FROM log),
    f AS (SELECT DISTINCT client, 0::BIGINT AS i, 0 AS failures, 0 AS openings, NULL::DOUBLE AS open_until FROM log
          UNION ALL SELECT o.client, o.i, CASE WHEN coalesce(sec < open_until, false) THEN failures WHEN failed THEN failures + 1 ELSE 0 END,
                 CASE WHEN NOT coalesce(sec < open_until, false) AND failed AND failures + 1 >= 2 THEN openings + 1 ELSE openings END,
                 CASE WHEN NOT coalesce(sec < open_until, false) AND failed AND failures + 1 >= 2 THEN sec + 20000 ELSE open_until END FROM f JOIN o ON o.client = f.client AND o.i = f.i + 1)
    SELECT f.client, failures, openings, open_until FROM f JOIN (SELECT client, max(i) AS i FROM f GROUP BY 1) USING (client, i)""")
def circuit_breaker(spark, sf_dir):
    """Openings of the breaker, with a low threshold and a long pause."""
    return folds.circuit(log(spark, sf_dir), threshold=2, cooldown=20000)


@query(f"""WITH RECURSIVE {_LOG.replace("event_type = 'error' AS failed", "event_type = 'error' AS failed, event_type = 'click' AS bad")}, o AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY seq) AS i FROM log),
    f AS (SELECT DISTINCT client, 0::BIGINT AS i, 0 AS failures, 0 AS unreadable, 0 AS openings, NULL::DOUBLE AS open_until FROM log
          UNION ALL SELECT o.client, o.i, CASE WHEN coalesce(sec < open_until, false) THEN failures WHEN failed THEN failures + 1 ELSE 0 END,
                 CASE WHEN coalesce(sec < open_until, false) OR failed THEN unreadable WHEN bad THEN unreadable + 1 ELSE 0 END,
                 CASE WHEN NOT coalesce(sec < open_until, false) AND (failed AND failures + 1 >= 2 OR bad AND unreadable + 1 >= 2) THEN openings + 1 ELSE openings END,
                 CASE WHEN NOT coalesce(sec < open_until, false) AND (failed AND failures + 1 >= 2 OR bad AND unreadable + 1 >= 2) THEN sec + 20000 ELSE open_until END FROM f JOIN o ON o.client = f.client AND o.i = f.i + 1)
    SELECT f.client, failures, unreadable, openings, open_until FROM f JOIN (SELECT client, max(i) AS i FROM f GROUP BY 1) USING (client, i)""")
def unreadable_breaker(spark, sf_dir):
    """The breaker with its second counter, of successes whose body can't be read."""
    bad = table(spark, sf_dir, "events").select((micros("ts") * 1000 + F.col("event_id") % 1000).alias("seq"), F.col("user_id").alias("client"), (F.col("event_type") == "click").alias("bad_json"))
    return folds.circuit(log(spark, sf_dir).join(bad, ["client", "seq"]), threshold=2, cooldown=20000)


@query("""WITH a AS (SELECT event_id // 3 AS request, event_id % 3 AS attempt, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'limited' WHEN 'signup' THEN 'missing' WHEN 'purchase' THEN 'failed' ELSE 'ok' END AS kind FROM events),
    l AS (SELECT request, count(*) AS attempts, arg_max(kind, attempt) AS kind FROM a GROUP BY 1)
    SELECT request, attempts, CASE WHEN kind IN ('ok', 'missing') THEN kind WHEN attempts >= 3 AND kind = 'limited' THEN 'rate_limited' WHEN attempts >= 3 THEN 'fetch_failed' ELSE 'retry' END AS outcome FROM l""")
def exhausted_retries(spark, sf_dir):
    """What a request came to after its attempts."""
    kind = F.create_map(*[F.lit(x) for kv in {"error": "failed", "click": "limited", "signup": "missing", "purchase": "failed", "view": "ok"}.items() for x in kv])
    e = table(spark, sf_dir, "events")
    return folds.last_attempts(e.select(F.floor(F.col("event_id") / 3).alias("request"), (F.col("event_id") % 3).alias("attempt"), kind[F.col("event_type")].alias("kind")))


@query("""WITH a AS (SELECT event_id // 8 AS request, event_id % 8 // 3 AS parse, event_id % 8 % 3 AS attempt, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'limited' WHEN 'signup' THEN 'missing' ELSE 'ok' END AS kind, event_type = 'view' AND event_id % 4 <> 0 AS readable FROM events),
    c AS (SELECT request, parse, min(attempt) FILTER (kind IN ('ok', 'missing')) AS f, arg_max(kind, attempt) AS last, count(*) AS n FROM a GROUP BY 1, 2),
    r AS (SELECT c.request, c.parse, n, CASE WHEN kind = 'missing' THEN 'missing' WHEN kind = 'ok' AND readable THEN 'ok' WHEN kind = 'ok' THEN 'unreadable' WHEN n >= 3 AND last = 'limited' THEN 'rate_limited' WHEN n >= 3 THEN 'fetch_failed' ELSE 'retry' END AS result
          FROM c LEFT JOIN a ON a.request = c.request AND a.parse = c.parse AND a.attempt = c.f)
    SELECT request, coalesce(arg_min(result, parse) FILTER (result <> 'unreadable'), CASE WHEN count(*) >= 3 THEN 'unreadable' ELSE 'retry' END) AS outcome, CAST(sum(n) AS BIGINT) AS attempts FROM r GROUP BY 1""")
def request_outcomes(spark, sf_dir):
    """What requests came to that are made again while their bodies can't be read."""
    kind = F.create_map(*[F.lit(x) for kv in {"error": "failed", "click": "limited", "signup": "missing", "purchase": "ok", "view": "ok"}.items() for x in kv])
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    log = e.select(F.floor(i / 8).alias("request"), F.floor(i % 8 / 3).alias("parse"), (i % 8 % 3).alias("attempt"), kind[F.col("event_type")].alias("kind"), ((F.col("event_type") == "view") & (i % 4 != 0)).alias("readable"))
    return folds.request_outcomes(log)


# -- the store ------------------------------------------------------------------------------------
@query("""WITH p AS (SELECT user_id, user_id * 10 + event_id % 3 AS player_uid, event_id, value FROM events UNION ALL SELECT user_id, user_id * 10 + 5, event_id, -value FROM events),
    q AS (SELECT user_id, player_uid, arg_max_null(value, event_id) AS new_score FROM p GROUP BY 1, 2), m AS (SELECT user_id, max(event_id) AS match_time_stamp FROM events GROUP BY 1)
    SELECT CAST(user_id AS VARCHAR) AS match_uid, player_uid, match_time_stamp, new_score FROM q JOIN m USING (user_id)""")
def ingest_versions(spark, sf_dir):
    """Many versions of a match in one batch: of each row of each table the last written stays."""
    person = lambda uid, score: F.struct(uid.alias("player_uid"), F.struct(score.alias("new_score")).alias("dynamic_fields"))
    people = F.array(person(F.col("user_id") * 10 + F.col("event_id") % 3, F.col("value")), person(F.col("user_id") * 10 + 5, -F.col("value")))
    doc = F.struct(F.col("user_id").cast("string").alias("match_uid"), F.col("event_id").alias("match_time_stamp"), people.alias("match_players"))
    raw = table(spark, sf_dir, "events").select(F.to_json(doc).alias("raw"), F.col("event_id").alias("seq"))
    store = Store(spark, folder(spark))
    ingest.ingest(store, raw, 19, NOW)
    return store.read("match_players").join(store.read("matches"), "match_uid").select("match_uid", "player_uid", "match_time_stamp", "new_score")


@query(f"SELECT CAST(l_suppkey % 50 AS INT) AS hero_id, count(DISTINCT (l_orderkey, l_partkey)) AS covered FROM lineitem WHERE {_OK} GROUP BY 1")
def maintained_coverage(spark, sf_dir):
    """The coverage that a store keeps, behind two batches of which the second repeats a part of the first."""
    raw, store = landed_matches(spark, sf_dir), Store(spark, folder(spark))
    for batch in ("seq % 2 = 0", "seq % 2 = 1 OR seq % 3 = 0"):
        ingest.ingest(store, raw.where(batch), 19, NOW)
    return store.read("hero_coverage")


# -- streams --------------------------------------------------------------------------------------
def event_stream(spark, sf_dir):
    """The events as a stream of files."""
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/events.parquet*")


@query("SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def stream_latest(spark, sf_dir):
    """The latest event of each user, merged batch by batch."""
    at = folder(spark)
    read = jobs.latest_stream(event_stream(spark, sf_dir), f"{at}/out", f"{at}/checkpoint", ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return read().select("event_id", "user_id", "event_type", "value")


@query("""WITH w AS (SELECT epoch_us(ts) // 3600000000 - unnest(range(0, 6)) AS h FROM events WHERE event_type = 'purchase') SELECT h * 3600 AS start, count(*) AS n, count(*) / 360.0::DOUBLE AS per_minute FROM w GROUP BY 1""")
def sliding_throughput(spark, sf_dir):
    """Purchases in windows of six hours, an hour apart."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").withColumn("ts", F.timestamp_micros(micros("ts")))
    return jobs.throughput(e, "360 minutes", "60 minutes").select((F.unix_micros("start") / 1000000).cast("long").alias("start"), "n", "per_minute")


@query(_PACE + " SELECT f.client, delay, streak, i AS n FROM f JOIN (SELECT client, max(i) AS i FROM f GROUP BY 1) USING (client, i)")
def stream_pace(spark, sf_dir):
    """The adaptive pace in a stateful operator, over micro-batches of a week each, some responses late."""
    at = folder(spark)
    rows = deliveries(spark, sf_dir, f"{at}/in", late=(F.col("event_id") % 10 == 0) & (F.col("behind") < 10800))
    rows = rows.select(F.col("user_id").alias("client"), (micros("ts") * 1000 + F.col("event_id") % 1000).alias("seq"), "ts", (F.col("event_type") == "error").alias("failed"), (F.col("value") / 20).alias("latency"))
    splits = table(spark, sf_dir, "events").rdd.getNumPartitions()  # the state grows with the table
    return jobs.pace(rows, f"{at}/out", f"{at}/checkpoint", late="6 hours", partitions=max(8, splits))()


#: The ends of the weeks in which events are delivered, in seconds; files of a week.
FILES = 8
WEEKS = [1704067200 + 604800 * k for k in range(1, 5)]


def deliveries(spark, sf_dir, at, late=None, again=None, lost=None):
    """The events as a stream of files, a micro-batch a week in the order of time. What `late` holds for comes with the next week, what
    `lost` holds for two weeks later, what `again` holds for comes a week later once more; all may use `behind`, the seconds
    between an event and the end of its week."""
    seconds, last = micros("ts") / 1000000, len(WEEKS) - 1
    week = F.greatest(F.lit(0), F.least(F.floor((seconds - WEEKS[0]) / 604800) + 1, F.lit(last))).cast("int")
    rows = table(spark, sf_dir, "events").withColumn("week", week)
    rows = rows.withColumn("behind", F.array(*map(F.lit, WEEKS))[F.col("week")] - seconds)
    given = lambda x, weeks: F.lit(False) if x is None else x & (F.col("week") + weeks <= last)
    late, again, lost = given(late, 1), given(again, 1), given(lost, 2)
    comes = F.array(F.col("week") + F.when(lost, 2).when(late, 1).otherwise(0), F.when(again, F.col("week") + 1))
    rows = rows.withColumn("comes", F.explode(F.array_compact(comes))).drop("week", "behind")
    for k in range(len(WEEKS)):
        rows.where(F.col("comes") == k).drop("comes").repartition(FILES).write.mode("append").parquet(at)
    return spark.readStream.schema(rows.drop("comes").schema).option("maxFilesPerTrigger", FILES).parquet(at)


@query("SELECT event_id, user_id, event_type FROM events")
def stream_distinct(spark, sf_dir):
    """Events of which a third of the last two days of each week is delivered twice, each once."""
    at = folder(spark)
    rows = deliveries(spark, sf_dir, f"{at}/in", again=(F.col("event_id") % 3 == 0) & (F.col("behind") < 172800))
    return jobs.distinct_stream(rows, f"{at}/out", f"{at}/checkpoint", ["event_id"], late="8 days")().select("event_id", "user_id", "event_type")


@query(f"""WITH e AS (SELECT *, epoch_us(ts) AS us, greatest(0, least((epoch_us(ts) // 1000000 - {WEEKS[0]} + 604800) // 604800, 3)) AS week FROM events),
    d AS (SELECT *, ({WEEKS[0]} + week * 604800) * 1000000 - us AS behind FROM e),
    w AS (SELECT us // 3600000000 - unnest(range(0, 6)) AS h FROM d WHERE event_type = 'purchase' AND NOT (week < 2 AND event_id % 10 = 1 AND behind BETWEEN 172800000000 AND 345600000000))
    SELECT h * 3600 AS start, count(*) AS n, count(*) / 360.0::DOUBLE AS per_minute FROM w
    WHERE (h + 6) * 3600000 <= (SELECT max(us) // 1000 FROM d WHERE event_type = 'purchase') - 21600000 GROUP BY 1""")
def stream_throughput(spark, sf_dir):
    """The sliding windows on a stream, in append mode: events that come three hours late still count, those that come a week late no longer, and
    the last windows stay open."""
    at, i, behind = folder(spark), F.col("event_id") % 10, F.col("behind")
    rows = deliveries(spark, sf_dir, f"{at}/in", late=(i == 0) & (behind < 10800), lost=(i == 1) & behind.between(172800, 345600))
    rows = rows.where("event_type = 'purchase'").withColumn("ts", F.col("ts").cast("timestamp"))
    read = jobs.throughput_stream(rows, f"{at}/out", f"{at}/checkpoint", window="360 minutes", slide="60 minutes", late="6 hours")
    return read().select((F.unix_micros("start") / 1000000).cast("long").alias("start"), "n", "per_minute")
