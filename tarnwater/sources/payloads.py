"""Readers of landed payloads: one JSON document per line or file, kept raw and parsed by schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions.devalue import resolve
from ..functions.expressions import RANK, history_visible, rank_text, response_class
from ..operators.history import chain
from . import landed as source
from .landed import ARRIVAL

#: The competitive mode, entries of a full page.
COMPETITIVE, PAGE_SIZE = 2, 20


def landed(spark, path, whole=False, keys=None):
    """(raw, path) of landed files: a document per line, or per file. keys: name -> (pattern with one
    group, type) of further columns that the path of a file holds, such as an id or an offset."""
    rows = spark.read.text(path, wholetext=whole).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("path"))
    return rows.withColumns({c: F.nullif(F.regexp_extract("path", pattern, 1), F.lit("")).try_cast(kind) for c, (pattern, kind) in (keys or {}).items()})


class Landed:
    """The responses that a fetcher has put into a folder, as files of JSON lines in a folder for each kind
    (see landed.KINDS), with their arrival. A key may be landed again and again; the newest response counts."""

    def __init__(self, spark, path):
        self.spark, self.path = source.register(spark), path.rstrip("/")

    def read(self, kind):
        return self.spark.read.format("landed").option("kind", kind).load(f"{self.path}/{kind}")

    def stream(self, kind, **options):
        """The same as a stream, which goes on behind the last file that a run with its checkpoint has read."""
        return self.spark.readStream.format("landed").options(kind=kind, **options).load(f"{self.path}/{kind}")

    def boards(self):
        return newest(self.read("hero_boards"), "hero_id"), newest(self.read("global_board"))

    def responses(self, claimed):
        mine = lambda kind: self.read(kind).join(claimed.select("uid"), "uid", "left_semi")
        return mine("profiles"), mine("pages"), self.read("details")


def newest(rows, *keys):
    """One row per key (of all rows, without keys): the one that arrived last, by what columns of ARRIVAL there are. Of rows
    that arrived alike one and the same is taken, whatever their order. Combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    at = F.struct(*(c for c in ARRIVAL if c in rest), F.xxhash64(*rest).alias("_tie"))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("_row")).where("_row IS NOT NULL").select(*keys, "_row.*")


def status(rows):
    """The HTTP status of responses; those that came with a body but without a status were successes."""
    given = F.when(F.col("raw").isNotNull(), 200)
    return F.coalesce("http_status", given) if "http_status" in rows.columns else given


def once(raw, parsed, name):
    """raw with a parsed struct, which is made once for each row: a generator's output is not
    taken apart by the optimizer, as a projection's is, to be parsed again for every use."""
    return raw.select("*", F.explode(F.array(parsed)).alias(name))


def matches(raw):
    """raw documents with the parsed match and whether it was readable at all."""
    parsed = F.from_json("raw", schemas.MATCH + ", _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"})
    return once(raw, parsed, "match").withColumn("readable", F.col("match").isNotNull() & F.col("match._corrupt").isNull())


def pages(raw):
    """(uid, skip, kind, page_size, page) of pages (uid, skip, raw, optionally http_status), the newest of each
    skip: as many entries as were sent, of whatever mode. kind is that of the response; a success that
    can't be read has failed."""
    rows = newest(raw, "uid", "skip")
    rows = once(rows.select("uid", "skip", "raw", status(rows).alias("http_status")), F.from_json("raw", schemas.HISTORY_PAGE), "page")
    kind = F.when(F.col("http_status").isNull(), "failed").otherwise(response_class("http_status", F.lit(False)))
    kind = F.when((kind == "ok") & F.col("page").isNull(), "failed").otherwise(kind)
    return rows.select("uid", "skip", kind.alias("kind"), F.coalesce(F.size("page"), F.lit(0)).alias("page_size"), "page")


def entries(pages, mode=COMPETITIVE):
    """(uid, skip, pos, page_size, match_uid, map_id) of parsed pages. An entry of another mode is
    left out; one whose mode is not given passes, as the source was asked for the mode."""
    rows = pages.select("uid", "skip", "page_size", F.posexplode("page").alias("pos", "entry"))
    rows = rows.where(F.coalesce(F.col("entry.game_mode_id") == mode, F.lit(True)))
    return rows.select("uid", "skip", "pos", "page_size", "entry.match_uid", F.col("entry.match_map_id").cast("int").alias("map_id"))


def history(raw, mode=COMPETITIVE, full=PAGE_SIZE):
    """Entries of the pages (uid, skip, raw) that a reader comes to who starts at 0 and stops at the first
    page that is not full, is missing or can't be read."""
    return entries(chain(pages(raw), full).where("kind = 'ok'"), mode)


def answers(raw):
    """(match_uid, kind, raw) of details (match_uid, raw, optionally http_status), the newest of each match: ok,
    malformed, missing, limited or failed. The first three are final, as asking again would not help."""
    from ..operators.shred import admissible

    rows = newest(raw, "match_uid")
    rows = matches(rows.select("match_uid", F.col("raw"), status(rows).alias("http_status")))
    kind = F.when(F.col("http_status").isNull(), "failed").otherwise(response_class("http_status", F.lit(False)))
    kind = F.when(kind != "ok", kind).when(~F.col("readable"), "failed").when(~admissible(), "malformed").otherwise("ok")
    return rows.select("match_uid", kind.alias("kind"), "raw")


def profiles(raw, season):
    """(uid, readable, nick_name, latest_known_level, latest_known_score, visibility_json, visible) of profiles
    (uid, raw), beside what other columns they have. A document is parsed once, and the rank in it once."""
    parsed = F.from_json("raw", schemas.PROFILE + ", _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"})
    rows = once(raw, parsed, "doc")
    rows = once(rows, F.from_json(rank_text(F.col("doc.player.info"), F.lit(season)), RANK)["rank_game"], "rank")
    flags = F.transform_values("doc.visibility", lambda k, v: v == "true")
    rest = [c for c in raw.columns if c not in ("uid", "raw")]
    return rows.select(
        "uid", *rest, (F.col("doc").isNotNull() & F.col("doc._corrupt").isNull()).alias("readable"), F.try_element_at("doc.player.info", F.lit("name")).alias("nick_name"),
        F.col("rank.level").cast("int").alias("latest_known_level"), F.col("rank.rank_score").alias("latest_known_score"), F.to_json("doc.visibility").alias("visibility_json"), history_visible(flags).alias("visible"),
    )


def hero_board(raw):
    """(hero_id, pos, uid, nick_name) of boards (hero_id, raw); entries without a player go."""
    board = F.from_json("raw", schemas.HERO_BOARD)["players"]
    rows = raw.select("hero_id", F.posexplode(board).alias("pos", "entry"))
    return rows.select("hero_id", "pos", F.col("entry.player_uid").alias("uid"), F.col("entry.info.name").alias("nick_name")).where("uid IS NOT NULL")


def readable_boards(raw):
    """The boards (hero_id, raw) that can be read at all."""
    return raw.where(F.from_json("raw", schemas.HERO_BOARD)["players"].isNotNull())


def global_board(raw):
    """(pos, uid, nick_name, season) of flat-array payloads (raw); entries without a numeric id go."""
    board = F.from_json(resolve("raw"), schemas.GLOBAL_BOARD)["players"]
    rows = raw.select(F.posexplode(board).alias("pos", "entry"))
    return rows.select("pos", F.expr("try_cast(entry.uid AS BIGINT)").alias("uid"), F.col("entry.name").alias("nick_name"), F.col("entry.rank.rank_game_id").alias("season")).where("uid IS NOT NULL")


def current_season(raw):
    """The season that the first entry of the global board carries, whatever its id; an error where it has none."""
    board = F.from_json(resolve("raw"), schemas.GLOBAL_BOARD)["players"]
    row = raw.select(F.get(board, 0)["rank"]["rank_game_id"].alias("season")).first()
    if row is None or row.season is None:
        raise ValueError("the global board names no season")
    return row.season
