"""Line dedup by winnowing over line hashes, with DataFrame functions only.

A run is a sequence of consecutive non-blank lines. From every line the shortest window of at least
`least` characters is taken, forwards and backwards; the least line hash of a window is its
fingerprint, so two documents that share a run of that size are sure to share a fingerprint. Windows
whose fingerprint occurs at one position only go. Those that are left are compared whole, by two hashes
over all of their lines, instead of position by position: a window whose lines are those of one
at an earlier place (by id, then position) is deleted. Windows overlap from line to line, so
together they are the later repeated runs, whole.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import free_name, stored

#: Characters that a repeated run has at least, line ends not counted.
LEAST = 200
BLANK = r"^\s*$"


def lines_of(text):
    return F.split(text, "\n", -1)


def key_of(id_col, text_col):
    """The key of a document: its id as a number (null before all others) and two hashes of its text."""
    return F.struct(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(text_col).alias("h"), F.xxhash64(F.lit(1), text_col).alias("k"))


def windows(docs, least, id_col="doc_id", text_col="text"):
    """Every shortest window: document, number of its lines, first and last position, fingerprint
    and its position, two hashes of the lines."""
    rows = docs.select(key_of(id_col, text_col).alias("doc"), lines_of(F.col(text_col)).alias("lines"))
    rows = rows.select("doc", F.size("lines").alias("n"), F.posexplode("lines").alias("pos", "line"))
    rows = rows.where(~F.col("line").rlike(BLANK))
    rows = rows.select("doc", "n", "pos", F.xxhash64("line").alias("hash"), F.xxhash64(F.lit(1), "line").alias("other"), F.char_length("line").cast("long").alias("size"))
    rows = rows.repartition("doc").dropDuplicates(["doc", "pos"])  # a repeated row is the same document
    doc = Window.partitionBy("doc")
    rows = rows.withColumn("upto", F.sum("size").over(doc.orderBy("pos"))).withColumn("since", F.col("upto") - F.col("size"))
    rows = rows.withColumn("total", F.max("upto").over(doc))
    # the window that ends at a line: all that end less than `least` characters before it does;
    # the one that starts at a line: all that start less than `least` characters after it
    back = doc.orderBy("upto").rangeBetween(1 - least, 0)
    forth = doc.orderBy("since").rangeBetween(0, least - 1)

    def window(over, fits):
        mark = F.min(F.struct("hash", "pos")).over(over)
        parts = F.struct(F.min("pos").over(over).alias("start"), F.max("pos").over(over).alias("end"), mark.alias("mark"), F.xxhash64(F.collect_list("hash").over(over)).alias("c1"), F.xxhash64(F.lit(1), F.collect_list("other").over(over)).alias("c2"))
        return F.when(fits, parts)

    rows = rows.withColumns({"back": window(back, F.col("upto") >= least), "forth": window(forth, F.col("total") - F.col("since") >= least)})
    found = rows.select("doc", "n", F.explode(F.array_distinct(F.array("back", "forth"))).alias("w")).where("w IS NOT NULL")
    return found.select("doc", "n", "w.start", "w.end", F.col("w.mark.hash").alias("mark"), F.col("w.mark.pos").alias("mark_pos"), "w.c1", "w.c2")


def repeated_lines(docs, least=LEAST, id_col="doc_id", text_col="text"):
    """(doc, gone): for each document with a later repeated run, whether each of its lines goes."""
    found = stored(windows(docs, least, id_col, text_col))
    place = F.struct("doc", "mark_pos")
    marks = found.groupBy("mark").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a < b").select("mark")
    some = stored(found.join(marks, "mark", "left_semi"), cut=[found])
    place = F.struct("doc", "start")
    firsts = some.groupBy("c1", "c2").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a < b").select("c1", "c2", "a")
    later = some.join(firsts, ["c1", "c2"]).where(place > F.col("a"))
    gone = later.select("doc", F.explode(F.sequence("start", "end")).alias("pos"), F.lit(True).alias("gone"))
    every = later.select("doc", "n").distinct().select("doc", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"), F.lit(False).alias("gone"))
    flags = gone.union(every).groupBy("doc", "pos").agg(F.max("gone").alias("gone"))
    flags = flags.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("pos", "gone"))).alias("flags"))
    return flags.select("doc", F.transform("flags", lambda x: x["gone"]).alias("gone"))


def drop_repeated_lines(docs, least=LEAST, id_col="doc_id", text_col="text"):
    """docs with later repeated runs of lines deleted, and n_lines, n_removed (long).

    Of equal runs of at least `least` characters the one at the least (id, position) stays. Blank
    lines are no part of runs and stay where they are not inside a deleted one. Rows with equal
    ids and texts are one document, and all of them keep the same lines; null ids come first. A
    null text has no lines and stays null; an empty one has one blank line. An empty table gives
    an empty result. Other columns of docs stay, whatever their names: where there is an n_lines
    or n_removed, the count is called n_lines_ or n_removed_. Documents and lines are told apart
    by 128 bits of hashes.
    """
    key, gone, n_lines, n_removed = (free_name(docs, c) for c in ("doc", "gone", "n_lines", "n_removed"))
    flags = repeated_lines(docs, least, id_col, text_col)
    flags = flags.select(F.col("doc").alias(key), F.col("gone").alias(gone))
    rows = docs.withColumn(key, key_of(id_col, text_col)).join(flags, key, "left")
    lines = lines_of(F.col(text_col))
    kept = F.filter(F.zip_with(lines, gone, lambda line, out: F.when(~out, line)), lambda line: line.isNotNull())
    n = F.coalesce(F.size(lines), F.lit(0))
    out = rows.withColumns({
        n_lines: F.when(F.col(text_col).isNull(), 0).otherwise(n).cast("long"),
        n_removed: F.coalesce(F.size(F.filter(gone, lambda out: out)), F.lit(0)).cast("long"),
        text_col: F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")),
    })
    return out.select(*docs.columns, n_lines, n_removed)


def oracle(least=LEAST, blank=r"^\s*$"):
    """DuckDB SQL for the rows that the query returns, straight from the definition."""
    return rf"""
    WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
    k AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r,
                 sum(length(line)) OVER (PARTITION BY doc_id ORDER BY pos) AS upto
          FROM l WHERE NOT regexp_matches(line, '{blank}')),
    d AS (SELECT doc_id, list(line ORDER BY r) AS ls, list(pos ORDER BY r) AS ps, list(upto ORDER BY r) AS us FROM k GROUP BY doc_id),
    s AS (SELECT doc_id, r AS a, (SELECT min(e.r) FROM k e WHERE e.doc_id = k.doc_id AND e.upto >= k.upto - length(k.line) + {least}) AS b FROM k
          UNION
          SELECT doc_id, (SELECT max(e.r) FROM k e WHERE e.doc_id = k.doc_id AND e.upto - length(e.line) <= k.upto - {least}), r FROM k),
    w AS (SELECT doc_id, ps[a] AS p, ps[b] AS q, array_to_string(ls[a:b], chr(10)) AS c FROM s JOIN d USING (doc_id) WHERE a IS NOT NULL AND b IS NOT NULL),
    f AS (SELECT c, min((doc_id, p)) AS first FROM w GROUP BY c),
    g AS (SELECT DISTINCT doc_id, unnest(range(p, q + 1)) AS pos FROM w JOIN f USING (c) WHERE (doc_id, p) > first),
    t AS (SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '') AS kept
          FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
    SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM documents LEFT JOIN t USING (doc_id)
    """
