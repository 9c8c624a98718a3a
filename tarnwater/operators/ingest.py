"""From raw matches to new versions of all tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..sources.payloads import matches as parse
from .frontier import coverage, stored_coverage
from .shred import admissible, shred

#: Cuts of a part, by which rows are dealt to tasks while they are merged.
CUTS = 8


def upsert(current, rows, name, part=None):
    """current with rows merged in by key: rows write the columns they have, whole rows at a time,
    the latest by (seq, doc, pos) last. Of rows that agree in these, one and the same counts for all columns.
    part: the part of the table in which a row lies, as a column; rows are then dealt by it once, to be merged and written as
    they lie, and the result has it as `part`. Without it rows of a key are combined before the shuffle."""
    key, fields = schemas.KEYS[name], schemas.schema(name)
    other = [f.name for f in fields if f.name not in key]
    have = [c for c in rows.columns if c in other]
    last = [c for c in have if c not in schemas.FIRST_WINS.get(name, [])]
    first, kept = [c for c in have if c not in last], [c for c in other if c not in have]
    types = {f.name: f.dataType for f in fields}
    place = ("seq", "doc", "pos")
    at = lambda *values: [x.cast("long").alias(f"_{c}") for x, c in zip(values, place)]
    zero = F.lit(0)
    old = current.select(*key, *other, F.lit(False).alias("_new"), *at(F.lit(-1), zero, zero))
    new = rows.select(*((F.col(c) if c in key or c in have else F.lit(None)).cast(types[c]).alias(c) for c in (*key, *other)), F.lit(True).alias("_new"), *at(*(F.col(c) if c in rows.columns else zero for c in place)))
    every, by = old.unionByName(new), key
    if part is not None:
        every = every.withColumns({"part": part, "_cut": F.pmod(F.shiftright(F.xxhash64(key[0]), 32), F.lit(CUTS))}).repartition("part", "_cut")
        by = ["part", "_cut", *key]
    order = [f"_{c}" for c in place]
    of = {"_last": (last, F.max(F.struct(*order, *last))), "_first": (first, F.min(F.struct(*order, *first))), "_kept": (kept, F.max(F.when(~F.col("_new"), F.struct(*kept) if kept else None)))}
    home = {c: name for name, (columns, _) in of.items() for c in columns}
    merged = every.groupBy(*by).agg(*(f.alias(name) for name, (columns, f) in of.items() if columns))
    return merged.select(*(F.col(f"{home[f.name]}.{f.name}" if f.name in home else f.name) for f in fields), *(["part"] if part is not None else []))


def discovered(parsed):
    """(uid, nick_name, latest_known_score, latest_known_level, discovery_hero_id, seq, doc, pos) of players in matches."""
    p = parsed.select("seq", "doc", F.posexplode("match.match_players").alias("pos", "p"))
    return p.select(F.col("p.player_uid").alias("uid"), "p.nick_name", F.col("p.dynamic_fields.new_score").alias("latest_known_score"), F.col("p.dynamic_fields.new_level").cast("int").alias("latest_known_level"), F.col("p.cur_hero_id").cast("int").alias("discovery_hero_id"), "seq", "doc", "pos")


def ingest(store, raw, season, now):
    """Merge raw matches (raw, seq, optionally map_id) into the store as one commit; returns what
    was rejected, as a table beside the others. Rows are written in the order of seq, those of one
    document in their order there, so the result doesn't depend on how documents are batched; of two
    versions of a match with one seq, one and the same counts in all tables. Running it again with
    the same input changes nothing but fetch times. Documents are parsed once, into a table that goes
    when the commit is done. Only the parts of the tables that the documents' keys lie in are read and
    written again, and the coverage of heroes is adjusted by what is new."""
    parsed = parse(raw).select("*", admissible().alias("admitted"), F.xxhash64("raw").alias("doc"))
    lean = {"raw": F.when(~F.col("admitted"), F.col("raw")), "match": F.when(F.col("admitted"), F.col("match"))}  # of each document what is read again
    with store.staged(parsed.withColumns(lean)) as parsed:
        tables, parts = merged(store, parsed.where("admitted"), season, now)
        rejected = store.put("_rejected", parsed.where("NOT admitted").select(raw.columns))
        store.commit(tables, parts)
    return rejected


def merged(store, good, season, now):
    """(name -> new state of every part of a table that admitted documents change, name -> these parts)."""
    map_id = "map_id" if "map_id" in good.columns else None
    of_matches = store.touched(good.select("match.match_uid"), "matches")
    rows, parts, tables = shred(good, season, now, map_id), {}, {}
    rows["players"] = discovered(good).withColumn("created_at", F.lit(now).cast("long"))
    for name, new in rows.items():
        matched = schemas.PARTED[name] == "match_uid"  # few rows a key
        parts[name] = of_matches if matched else store.touched(new.select(schemas.PARTED[name]), name)
        tables[name] = upsert(store.read(name, parts[name]), new, name, store.part(name) if matched else None)
    tables["players"] = tables["players"].withColumn("crawl_status", F.coalesce("crawl_status", F.lit("pending")))
    tables["hero_coverage"] = covered(store, rows["match_player_heroes"], parts["match_player_heroes"])
    return tables, parts


def covered(store, segments, parts):
    """hero_coverage behind new segments: each hero's count grows by the segments that the store did not have. They
    are looked for in the parts that change; a store without the counts has them made once of all its segments."""
    key = schemas.KEYS["match_player_heroes"]
    fresh = segments.select(*key).distinct().join(store.read("match_player_heroes", parts).select(*key), key, "left_anti")
    return stored_coverage(store).unionByName(coverage(fresh, "hero_id")).groupBy("hero_id").agg(F.sum("covered").alias("covered"))
